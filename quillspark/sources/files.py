"""File trees as tables: inventory, wiki records, delimited and JSON content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.markdown import frontmatter
from quillspark.functions.strings import suffix
from quillspark.operators.extraction import sniff_media_type

# fixed values: names that are never sources; tools' temporary and lock files are known by their form
IGNORED_NAMES = (".gitkeep", ".keep", ".DS_Store")
IGNORED_ROOTS = ("_versions", "_web")
MAX_DESCRIPTOR_BYTES = 64 << 10


def is_ignored(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return name.isin(*IGNORED_NAMES) | F.element_at(F.split(path, "/"), 1).isin(*IGNORED_ROOTS) | name.rlike(r"^\.[a-z]+-tmp-|\.[a-z]+\.lock$")


def relative_path(path: Column, root: str) -> Column:
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/*" + root.lstrip("/").rstrip("/") + "/", "")


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file under a folder: path (relative), byte_size, modified, media_type, extension, sha256, and the fields of URL descriptors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(relative_path(F.col("path"), root).alias("path"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified"), "content").where(~is_ignored(F.col("path")))
    text = F.when(F.col("path").endswith(".url.md") & (F.col("byte_size") <= MAX_DESCRIPTOR_BYTES) & F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    fields = descriptor(text)
    return rows.select("path", "byte_size", "modified", sniff_media_type(F.col("content"), F.col("path")).alias("media_type"), suffix(F.col("path")).alias("extension"), F.sha2("content", 256).alias("sha256"), fields["url"].alias("url"), fields["description"].alias("description"), fields["added"].alias("added"))


def descriptor(text: Column) -> Column:
    """url, description, added of a URL descriptor: exactly the keys kind, url, description, added; null otherwise."""
    keys = frontmatter(text)
    good = (F.array_sort(F.map_keys(keys)) == F.array(*[F.lit(k) for k in ("added", "description", "kind", "url")])) & (F.element_at(keys, "kind") == "url")
    return F.when(good, F.struct(F.try_element_at(keys, F.lit("url")).alias("url"), F.try_element_at(keys, F.lit("description")).alias("description"), F.try_element_at(keys, F.lit("added")).try_cast("date").alias("added")))


def wiki_records(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path and text of the .md files directly in the folders."""
    return spark.read.option("wholetext", "true").option("pathGlobFilter", "*.md").text(folders).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A CSV or TSV file as it stands; malformed rows fail."""
    return spark.read.csv(path, sep=separator, mode="FAILFAST", header=False, multiLine=True)
