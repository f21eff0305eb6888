"""The link graph of Markdown records: resolving, reciprocity, ambiguity, first mentions, the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.strings import resolve_link, title_escape, whole_token


def repeated(df: DataFrame, key: list[str], name: str = "n") -> DataFrame:
    """Rows whose key several rows have; keys are counted before rows are joined, so that a hot key is no hot window."""
    many = df.groupBy(*key).agg(F.count("*").alias(name)).where(F.col(name) > 1)
    return df.join(many, key)


def resolved(links: DataFrame, base: Column) -> DataFrame:
    """Links with the path they lead to (null if it isn't canonical or leaves the tree) and their fragment."""
    return links.withColumn("target", resolve_link(F.col("destination"), base)).withColumn("fragment", F.nullif(F.regexp_extract("destination", "#(.*)$", 1), F.lit("")))


def link_problems(links: DataFrame, records: DataFrame) -> DataFrame:
    """doc, line_no, destination, code of links that lead nowhere, to themselves or in a wrong spelling.

    :param links: doc, line_no, destination, target, fragment; :param records: doc.
    """
    known = records.select(F.col("doc").alias("target"), F.lit(True).alias("known")).distinct()
    code = F.when(F.col("target").isNull(), "link_destination_invalid").when(F.col("target") == F.col("doc"), "link_self").when(F.col("known").isNull(), "link_target_missing").when(F.col("fragment").isNotNull(), "link_fragment_invalid")
    return links.join(known, "target", "left").select("doc", "line_no", "destination", code.alias("code")).where("code is not null")


def one_way(edges: DataFrame) -> DataFrame:
    """Edges (a, b) without (b, a)."""
    return edges.select("a", "b").distinct().join(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct(), ["a", "b"], "left_anti")


def relation_problems(edges: DataFrame, kinds: DataFrame, allowed: str) -> DataFrame:
    """a, b, code of declared relations to nothing, to themselves, to a wrong kind, or not returned.

    :param edges: a, b; :param kinds: doc, kind.
    """
    target = kinds.select(F.col("doc").alias("b"), "kind").distinct()
    code = F.when(F.col("b").isNull(), "relationship_destination_invalid").when(F.col("a") == F.col("b"), "relationship_self").when(F.col("kind").isNull(), "relationship_target_missing").when(F.col("kind") != allowed, "relationship_target_kind_invalid")
    own = edges.select("a", "b").distinct().join(target, "b", "left").select("a", "b", code.alias("code")).where("code is not null")
    return own.unionByName(one_way(edges.where("a <> b")).select("a", "b", F.lit("relationship_not_reciprocal").alias("code")))


def ambiguous_names(names: DataFrame) -> DataFrame:
    """Names (compared without case) that several documents have: name, n_docs."""
    return names.select(F.lower("name").alias("name"), "doc").distinct().groupBy("name").agg(F.count("*").alias("n_docs")).where("n_docs > 1")


def first_mentions(lines: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """First line and column at which a document names any of the names as a whole token; of two at one place the longer."""
    line = F.col("line")
    places = F.array(*[F.struct(F.when(line.rlike(whole_token(n)), F.length(F.regexp_extract(line, f"(?s)^(.*?){whole_token(n)}", 1)) + 1).cast("bigint").alias("at"), F.lit(-len(n)).alias("long"), F.lit(n).alias("name")) for n in names])
    found = lines.withColumn("hit", F.array_min(F.filter(places, lambda p: p["at"].isNotNull()))).where("hit is not null")
    first = found.groupBy("doc").agg(F.min(F.struct("line_no", "hit")).alias("m"))
    return first.select("doc", F.col("m.line_no").alias("line_no"), F.col("m.hit.at").alias("column"), F.col("m.hit.name").alias("name"))


def unlinked_mentions(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """First mentions that lie inside no link label: containment within the line, joined on the line.

    :param mentions: doc, line_no, column, name; :param links: doc, line_no, from_column, to_column.
    """
    end = F.col("column") + F.length("name") - 1
    covered = mentions.join(links, ["doc", "line_no"]).where((F.col("from_column") <= F.col("column")) & (end <= F.col("to_column"))).select("doc", "line_no", "column").distinct()
    return mentions.join(covered, ["doc", "line_no", "column"], "left_anti")


def label_spans(lines: DataFrame) -> DataFrame:
    """doc, line_no, from_column, to_column of the labels of inline links."""
    found = lines.where(F.col("line").contains("](")).withColumn("links", F.regexp_extract_all("line", F.lit(r"(\[[^\]\[]*\]\([^()\s]+\))"), F.lit(1)))
    spans = F.transform("links", lambda k: F.struct((F.expr("0") + F.position(k, F.col("line")) + 1).cast("bigint").alias("a"), (F.expr("0") + F.position(k, F.col("line")) + F.locate("](", k) - 2).cast("bigint").alias("b")))
    return found.select("doc", "line_no", F.explode(F.array_distinct(spans)).alias("s")).select("doc", "line_no", F.col("s.a").alias("from_column"), F.col("s.b").alias("to_column"))


def index_lines(records: DataFrame) -> DataFrame:
    """Lines of the index in order: pages, then questions, by path.

    :param records: path, title, kind.
    """
    line = F.concat(F.lit("- ["), title_escape(F.col("title")), F.lit("]("), F.col("path"), F.lit(")"))
    return records.where("kind in ('page', 'question')").select((F.col("kind") == "question").cast("int").alias("part"), "path", line.alias("line")).orderBy("part", "path")

