"""Literal multi-term line search with context, pages and a completeness proof."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.markdown import numbered_lines
from quillspark.functions.strings import whole_token
from quillspark.operators.ordering import page_index, paged, run_proof

PASSES = ("discovery", "expansion", "verification")
SCOPES = ("sources", "wiki")


@dataclass(frozen=True)
class SearchRequest:
    """A validated request: terms are literal and case-sensitive, a line matches if it holds any of them."""

    terms: tuple[str, ...]
    scope: str = "sources"
    search_pass: str = "discovery"
    context: int = 0
    page_size: int = 100
    source_ids: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.terms or len(set(self.terms)) != len(self.terms):
            raise ValueError("terms must be given, each once")
        if any(not t.strip() or any(c in t for c in "\r\n\0") for t in self.terms):
            raise ValueError("a term may not be blank or hold line ends or NUL")
        if not 0 <= self.context <= 20:
            raise ValueError("context is 0 to 20 lines")
        if not 1 <= self.page_size <= 500:
            raise ValueError("a page has 1 to 500 rows")
        if self.scope not in SCOPES or self.search_pass not in PASSES:
            raise ValueError("unknown scope or pass")


def any_term(c: Column, terms: tuple[str, ...]) -> Column:
    out = F.contains(c, F.lit(terms[0]))
    for t in terms[1:]:
        out = out | F.contains(c, F.lit(t))
    return out


def first_term(c: Column, terms: tuple[str, ...]) -> Column:
    """The first given term that the text holds."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(t)), F.lit(t)) for t in terms])


def held_terms(c: Column, terms: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t))


def candidates(docs: DataFrame, text: str, terms: tuple[str, ...]) -> DataFrame:
    """Documents with a hit: the whole text is tested first, so that the filter reaches the scan."""
    return docs.where(any_term(F.col(text), terms))


def matching_lines(docs: DataFrame, doc: str, text: str, terms: tuple[str, ...]) -> DataFrame:
    """doc, line_no, line of lines with a hit."""
    return numbered_lines(candidates(docs, text, terms), doc, text).where(any_term(F.col("line"), terms))


def lines_with_context(docs: DataFrame, doc: str, text: str, terms: tuple[str, ...], context: int) -> DataFrame:
    """doc, line_no, line, kind (match or context); overlapping windows are merged."""
    lines = F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n", -1)
    both = F.struct(lines.alias("lines"), F.transform(lines, lambda x: any_term(x, terms)).alias("hits"))

    def near(b: Column) -> Column:
        """Lines within the row that a hit is near to: nothing is shuffled."""
        first = lambda i: F.greatest(F.lit(1), i + 1 - context)
        flagged = F.transform(b["lines"], lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), x.alias("line"), F.get(b["hits"], i).alias("hit"), F.exists(F.slice(b["hits"], first(i), i + 2 + context - first(i)), lambda h: h).alias("near")))
        return F.filter(flagged, lambda x: x["near"])

    # both arrays are bound once, as a lambda's variable
    kept = candidates(docs, text, terms).select(F.col(doc).alias("doc"), F.explode(F.flatten(F.transform(F.array(both), near))).alias("x"))
    return kept.select("doc", "x.line_no", "x.line", F.when(F.col("x.hit"), "match").otherwise("context").alias("kind"))


def search_pages(docs: DataFrame, doc: str, text: str, request: SearchRequest) -> DataFrame:
    """The rows of a run with ordinal and page; a run without a hit has no rows and one empty page (see run_summary)."""
    return paged(lines_with_context(docs, doc, text, request.terms, request.context), ["doc", "line_no"], request.page_size)


def run_index(pages: DataFrame) -> DataFrame:
    return page_index(pages, F.concat_ws("\0", F.col("doc").cast("string"), F.col("line_no").cast("string"), "kind", "line"))


def run_summary(pages: DataFrame) -> DataFrame:
    """Proof of a run; a run without hits has one empty page."""
    return run_proof(run_index(pages)).withColumn("n_pages", F.greatest("n_pages", F.lit(1)))


def verify_run(pages: DataFrame, proof: DataFrame) -> DataFrame:
    """One row: whether the rows still give the proof."""
    now = run_summary(pages).select(F.struct("n_pages", "n_matches", "complete", "digest").alias("now"), F.lit(1).alias("k"))
    then = proof.select(F.struct("n_pages", "n_matches", "complete", "digest").alias("then"), F.lit(1).alias("k"))
    return now.join(then, "k").select((F.col("now") == F.col("then")).alias("verified"))


def first_hits(matches: DataFrame) -> DataFrame:
    """First matching line of each document."""
    return matches.groupBy("doc").agg(F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("line"))


def terms_of_documents(matches: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Sorted terms that each document's matching lines hold; at most as many as asked for."""
    return matches.select("doc", F.explode(held_terms(F.col("line"), terms)).alias("term")).groupBy("doc").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def restricted(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Documents whose key is among the ids; an id that no document has is an error, not an empty result."""
    unknown = ids.select(key).distinct().join(docs.select(key), key, "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown ids: {[r[0] for r in unknown]}")
    return docs.join(ids.select(key).distinct(), key, "left_semi")


def active_representations(records: DataFrame) -> DataFrame:
    """Sources whose active derivation can be searched."""
    return records.where("active_derivation_id is not null and state in ('ok', 'warning')")


def link_candidates(docs: DataFrame, doc: str, text: str, target: str, names: tuple[str, ...]) -> DataFrame:
    """First line of every other record that names the target as a whole token, and the name found."""
    lines = numbered_lines(candidates(docs.where(F.col(doc) != target), text, names), doc, text)
    found = F.coalesce(*[F.when(F.col("line").rlike(whole_token(n)), F.lit(n)) for n in names])
    hits = lines.withColumn("term", found).where("term is not null")
    return hits.groupBy("doc").agg(F.min_by(F.struct("line_no", "line", "term"), "line_no").alias("hit")).select("doc", "hit.*")
