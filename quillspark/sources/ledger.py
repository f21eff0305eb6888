"""The ledger, event logs, registries and published snapshots as stored tables."""

from __future__ import annotations

import json
import os
import tomllib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANCHORS = "array<struct<kind:string,value:string>>"
FINGERPRINT = "struct<path:string,byte_size:bigint,mtime_ns:bigint>"
RETRIEVAL = "array<struct<requested_url:string,final_url:string,redirects:array<string>,retrieved_at:string,detected_media_type:string,byte_size:bigint,sha256:string,approval_event_id:string,approval_recorded_at:string,approval_scope:string,approval_note:string>>"
#: Maps are declared: inference would make a field of every key.
RECORD = (
    "source_id string, schema_version int, current_raw_path string, previous_raw_paths array<string>, media_type string, byte_size bigint, state string, "
    f"versions map<string,struct<sha256:string,raw_path:string,byte_size:bigint,fingerprint:{FINGERPRINT},first_seen_at:string,retrieval_events:{RETRIEVAL}>>, active_content_sha256 string, "
    f"derivations map<string,struct<derivation_id:string,source_sha256:string,extractor_id:string,extractor_version:string,config_sha256:string,output_path:string,output_sha256:string,output_byte_size:bigint,output_mtime_ns:bigint,quality_state:string,anchors:{ANCHORS},created_at:string,method:string,method_metadata:map<string,string>>>, active_derivation_id string, "
    "last_attempt struct<input_sha256:string,extractor_id:string,extractor_version:string,config_sha256:string,prerequisite_digest:string,outcome:string,attempted_at:string,diagnostic_codes:array<string>>, "
    "diagnostics array<struct<code:string,message:string,path:string,details:string>>, created_at string, inspected_at string, updated_at string, "
    "adoption_events array<struct<prior_sha256:string,adopted_sha256:string,approval_note:string,recorded_at:string>>, "
    f"url_descriptor struct<url:string,description:string,added:date,fingerprint:{FINGERPRINT}>"
)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All shards src_*.json; a broken one fails the read."""
    return spark.read.schema(RECORD).option("multiLine", "true").option("mode", "FAILFAST").option("pathGlobFilter", "src_*.json").json(folder)


def misnamed(records: DataFrame) -> DataFrame:
    """Records whose file isn't named after them."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return records.select("source_id", name.alias("file")).where("source_id <> file")


def versions(records: DataFrame) -> DataFrame:
    return records.select("source_id", F.explode("versions").alias("key", "v")).select("source_id", "v.*")


def derivations(records: DataFrame) -> DataFrame:
    return records.select("source_id", F.explode("derivations").alias("key", "d")).select("source_id", "d.*")


def adoptions(records: DataFrame) -> DataFrame:
    return records.select("source_id", F.posexplode("adoption_events").alias("ordinal", "e")).select("source_id", "ordinal", "e.*")


def active(records: DataFrame) -> DataFrame:
    """source_id and the derivation that is active now."""
    return records.select("source_id", F.try_element_at("derivations", F.col("active_derivation_id")).alias("d")).where("d is not null").select("source_id", "d.*")


def unheld_pointers(records: DataFrame) -> DataFrame:
    """Records whose active content or derivation isn't among what they hold."""
    bad = lambda c, m: F.col(c).isNotNull() & F.try_element_at(m, F.col(c)).isNull()
    code = F.when(bad("active_content_sha256", "versions"), "active_version_missing").when(bad("active_derivation_id", "derivations"), "active_derivation_missing")
    return records.select("source_id", code.alias("code")).where("code is not null")


def publish(df: DataFrame, root: str) -> str:
    """Write a new snapshot folder, then switch the pointer at once; what was published before stays readable.

    The pointer is written and renamed through the folder's own file system, so
    that a shared store serves as well as a local one.
    """
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(os.path.join(root, name))
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = lambda n: jvm.org.apache.hadoop.fs.Path(os.path.join(root, n))
    temporary = path(f".current-{uuid.uuid4().hex}")
    stream = temporary.getFileSystem(conf).create(temporary, True)
    stream.writeBytes(json.dumps({"snapshot": name}))
    stream.close()
    overwrite = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = df.sparkSession.sparkContext._gateway.new_array(overwrite, 1)
    options[0] = overwrite.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.getFileSystem(conf).getUri(), conf).rename(temporary, path("CURRENT"), options)
    return name


def published(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot that the pointer names; one never switched to isn't seen."""
    pointer = spark.read.text(os.path.join(root, "CURRENT")).first()[0]
    return spark.read.parquet(os.path.join(root, json.loads(pointer)["snapshot"]))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and the old ones whose key has none."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def collisions(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Keys under which other content is already stored."""
    return new.select(key, F.col(content).alias("new")).join(old.select(key, F.col(content).alias("old")), key).where("new <> old")


def write_events(events: DataFrame, path: str) -> None:
    """Append events of a result as JSON lines."""
    events.write.mode("append").json(path)


def handoff_collisions(items: DataFrame) -> DataFrame:
    """handoff_ids that stand for more than one body."""
    return items.groupBy("handoff_id").agg(F.count_distinct("body").alias("n_bodies")).where("n_bodies > 1")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Extractors of a TOML file: extractor_id, ordinal, media_types, extensions; the file is read by the driver."""
    with open(path, "rb") as f:
        items = tomllib.load(f).get("extractors", [])
    rows = [(i["id"], k, list(i.get("media_types", [])), list(i.get("extensions", []))) for k, i in enumerate(items)]
    return spark.createDataFrame(rows, T.StructType().add("extractor_id", "string").add("ordinal", "int").add("media_types", "array<string>").add("extensions", "array<string>"))


def choose_extractor(rows: list[tuple[str, list[str], list[str]]], path: Column, media: Column) -> Column:
    """Extractor of a file: the first that names its media type, else the one with the longest matching suffix.

    The registry is a short list and becomes part of the plan, so nothing is joined.
    """
    by_type = F.coalesce(*[F.when(media.isin(*types), F.lit(e)) for e, types, _ in rows if types], F.lit(None).cast("string"))
    suffixes = sorted(((s, e, k) for k, (e, _, ss) in enumerate(rows) for s in ss), key=lambda x: (-len(x[0]), x[2]))
    return F.coalesce(by_type, *[F.when(F.lower(path).endswith(s), F.lit(e)) for s, e, _ in suffixes])
