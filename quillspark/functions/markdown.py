"""Markdown as rows: lines, headings, links, citation markers and definitions, frontmatter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line_no (from 1), line; LF ends lines, and a last LF begins no further line."""
    lines = F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n", -1)
    return docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc).alias("doc"), F.posexplode(lines).alias("pos", "line")).select("doc", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


FENCE = r"(?m)^ {0,3}(?:```|~~~)[^\n]*$"


def outside_code(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line_no, line of the lines outside fenced code; fences themselves are left out too.

    The text is cut at its fences within the row, so that nothing is shuffled;
    of two pieces that a fence parts both end in what is left of its line.
    """
    docs = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc).alias("doc"), F.regexp_replace(F.col(text), r"\n\z", "").alias("text"))
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.array().cast("array<struct<at:bigint,piece:string>>").alias("out"))
    placed = F.aggregate(
        F.split("text", FENCE, -1), start,
        lambda a, p: F.struct((a["at"] + F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))).cast("bigint").alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), p.alias("piece")))).alias("out")),
        lambda a: a["out"],
    )
    pieces = docs.select("doc", placed.alias("pieces")).select("doc", F.size("pieces").alias("n"), F.posexplode("pieces").alias("k", "p")).where("k % 2 = 0")
    cut = F.split("p.piece", "\n", -1)
    lines = pieces.select("doc", "n", "k", F.col("p.at").alias("at"), F.size(cut).alias("m"), F.posexplode(cut).alias("i", "line"))
    rest_of_fence = ((F.col("i") == 0) & (F.col("k") > 0)) | ((F.col("i") == F.col("m") - 1) & (F.col("k") < F.col("n") - 1))
    return lines.where(~rest_of_fence).select("doc", (F.col("at") + F.col("i")).cast("bigint").alias("line_no"), "line")


def headings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line_no, level, title of ATX headings."""
    lines = outside_code(docs, doc, text).where(F.col("line").rlike(r"^#{1,6} +\S"))
    return lines.select("doc", "line_no", F.length(F.regexp_extract("line", "^(#+)", 1)).cast("bigint").alias("level"), F.regexp_extract("line", r"^#+ +(.*?)[ \t\r]*$", 1).alias("title"))


def section_extents(heads: DataFrame) -> DataFrame:
    """Headings with the line before the next heading of the same or a higher level (null: to the end).

    The next such heading is found in an array of the document's headings, so
    that no pairs of headings are ever joined.
    """
    w = Window.partitionBy("doc")
    every = F.array_sort(F.collect_list(F.struct("line_no", "level")).over(w))
    after = F.filter("every", lambda h: (h["line_no"] > F.col("line_no")) & (h["level"] <= F.col("level")))
    return heads.withColumn("every", every).withColumn("end_line", F.when(F.size(after) > 0, F.element_at(after, 1)["line_no"] - 1)).drop("every")


def skipped_levels(heads: DataFrame) -> DataFrame:
    """Headings more than one level below the heading before them."""
    before = F.lag("level").over(Window.partitionBy("doc").orderBy("line_no"))
    return heads.withColumn("before", F.coalesce(before, F.lit(0))).where("level > before + 1")


def markers(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line_no, citation_id of every marker [^id] outside definitions, code spans and fenced code."""
    line = F.regexp_replace(F.regexp_replace("line", r"`[^`]*`", ""), r"^\[\^[^\]\s]+\]:", "")
    lines = outside_code(docs.where(F.col(text).contains("[^")), doc, text).where(F.col("line").contains("[^"))
    return lines.select("doc", "line_no", F.explode(F.regexp_extract_all(line, F.lit(r"\[\^([^\]\s]+)\]"), F.lit(1))).alias("citation_id"))


def definitions(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line_no, citation_id, body of every [^id]: definition."""
    lines = outside_code(docs.where(F.col(text).contains("[^")), doc, text).where(F.col("line").startswith("[^"))
    pattern = r"^\[\^([^\]\s]+)\]:\s*(.*)$"
    return lines.where(F.col("line").rlike(pattern)).select("doc", "line_no", F.regexp_extract("line", pattern, 1).alias("citation_id"), F.regexp_extract("line", pattern, 2).alias("body"))


def links(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line_no, label, destination of inline links outside code."""
    lines = outside_code(docs.where(F.col(text).contains("](")), doc, text).where(F.col("line").contains("]("))
    line = F.regexp_replace("line", r"`[^`]*`", "")
    found = F.explode(F.regexp_extract_all(line, F.lit(r"(\[[^\]\[]*\]\([^()\s]+\))"), F.lit(1)))
    return lines.select("doc", "line_no", found.alias("link")).select("doc", "line_no", F.regexp_extract("link", r"^\[([^\]]*)\]", 1).alias("label"), F.regexp_extract("link", r"\]\(([^)]*)\)$", 1).alias("destination"))


def relations(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line_no, label, destination, note of bullets of the form - [label](destination): note."""
    pattern = r"(?d)^- \[([^\]]+)\]\(([^()\s]+)\): (.+)$"  # (?d): only LF ends lines
    lines = numbered_lines(docs, doc, text).where(F.col("line").startswith("- [")).where(F.col("line").rlike(pattern))
    return lines.select("doc", "line_no", *[F.regexp_extract("line", pattern, k).alias(n) for k, n in ((1, "label"), (2, "destination"), (3, "note"))])


def line_offsets(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line_no, offset: where each physical line begins, in code points; CR, LF and CRLF end lines."""
    pieces = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.posexplode(F.split(F.col(text), r"(?<=\n)|(?<=\r)(?!\n)", -1)).alias("i", "piece"))
    before = F.sum(F.length("piece")).over(Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return pieces.select("doc", (F.col("i") + 1).cast("bigint").alias("line_no"), F.coalesce(before, F.lit(0)).cast("bigint").alias("offset"))


def running_text(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line_no, line of the lines outside code, headings and definitions."""
    return outside_code(docs, doc, text).where(~F.col("line").rlike(r"^#{1,6} +\S|^\[\^[^\]\s]+\]:"))


def frontmatter(text: Column) -> Column:
    """Map of the keys of a leading --- block; null without one. Values lose their quotes."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---(\n|$)", 1)
    rows = F.filter(F.split(block, "\n"), lambda r: r.rlike(r"^[A-Za-z_][\w-]*: ?"))
    pairs = F.transform(rows, lambda r: F.struct(F.regexp_extract(r, r"^([^:]+):", 1), F.regexp_replace(F.regexp_extract(r, r"^[^:]+: ?(.*)$", 1), r'^"(.*)"$', "$1")))
    return F.when(text.rlike(r"(?s)^---\n.*?\n---(\n|$)"), F.map_from_entries(pairs))


def inline_list(value: Column) -> Column:
    """Items of [a, b]; null if it isn't a list."""
    items = F.transform(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), ","), lambda x: F.btrim(x, F.lit(" \"'")))
    return F.when(value.rlike(r"^\[.*\]$"), F.filter(items, lambda x: x != ""))


def body(text: Column) -> Column:
    """Text after the frontmatter."""
    return F.regexp_replace(text, r"(?s)^---\n.*?\n---(\n|$)", "")
