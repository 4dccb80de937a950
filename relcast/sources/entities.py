"""Reading and writing release entities: JSON documents, lockfiles, reports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas are given, never inferred; a document that doesn't fit goes to ``corrupt``.
AUTHORING = """
kind string, schema_version string, metadata struct<document_id string>,
notetypes array<struct<id string, kind string, original_stock_kind string, name string>>,
notes array<struct<id string, notetype_id string, deck_name string, fields map<string, string>, tags array<string>>>,
media array<struct<id string, desired_filename string, source struct<kind string, path string, data_base64 string>, declared_mime string>>,
_corrupt_record string
"""
NORMALIZED = """
kind string, document_id string, resolved_identity string, schema_version string,
notetypes array<struct<id string, kind string, name string, original_stock_kind string, original_id bigint, css string,
  fields array<struct<name string, ord int, config_id bigint, tag int, prevent_deletion boolean, sort boolean>>,
  templates array<struct<name string, ord int, config_id bigint, question_format string, answer_format string, browser_question_format string,
    browser_answer_format string, target_deck_name string, browser_font_name string, browser_font_size int,
    generation_requirement struct<kind string, field_names array<string>>>>,
  field_metadata array<struct<field_name string, label string, role_hint string>>>>,
notes array<struct<id string, notetype_id string, deck_name string, fields map<string, string>, tags array<string>, mtime_secs bigint>>,
media_objects array<struct<id string, object_ref string, blake3 string, sha1 string, size_bytes bigint, mime string>>,
media_bindings array<struct<id string, export_filename string, object_id string>>,
media_references array<struct<owner_kind string, owner_id string, location_kind string, location_name string, raw_ref string, ref_kind string, resolution_status string, media_id string, skip_reason string>>,
_corrupt_record string
"""
REPORT = """
kind string, observation_status string, source_kind string, artifact_fingerprint string, missing_domains array<string>,
observations map<string, array<variant>>, _corrupt_record string
"""
LOCKFILE = """
schema_version string, project_stable_id string, writer_policy_ref string,
identity_index struct<schema_version string, notes array<struct<stable_id string, normalized_note_id string, guid string, current_guid_candidate string, entry_lifecycle string>>>,
_corrupt_record string
"""


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON file, with its path."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("source_path", F.col("_metadata.file_path"))


def entity(documents: DataFrame, name: str) -> DataFrame:
    """The rows of an entity with their place in the document."""
    rows = documents.where("_corrupt_record IS NULL").select("source_path", F.posexplode(name).alias("ord", "__row"))
    return rows.select("source_path", "ord", "__row.*")


def read_reports(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Observations of two inspect reports as one long table with ``side``."""
    sides = [read_documents(spark, path, REPORT).withColumn("side", F.lit(side)) for side, path in (("left", left), ("right", right))]
    rows = sides[0].unionByName(sides[1]).where("_corrupt_record IS NULL").select("side", F.explode("observations").alias("domain", "rows"))
    opened = rows.select("side", "domain", F.posexplode("rows").alias("ord", "v"))
    return opened.select("side", "domain", F.expr("try_variant_get(v, '$.selector', 'string')").alias("selector"), projected(F.col("domain"), F.to_json("v")).alias("payload"), F.expr("try_variant_get(v, '$.evidence_refs', 'array<string>')").alias("evidence"), F.col("ord").cast("bigint").alias("ord"))


@F.pandas_udf(T.StringType())
def projected(domains: pd.Series, payloads: pd.Series) -> pd.Series:
    """JSON without what no diff compares: selectors and evidence at any depth, and in media the ids of bindings and objects."""

    def clean(value, gone):
        if isinstance(value, dict):
            return {k: clean(v, gone) for k, v in value.items() if k not in gone}
        return [clean(v, gone) for v in value] if isinstance(value, list) else value

    base = {"selector", "evidence_refs"}
    return payloads.combine(domains, lambda p, d: json.dumps(clean(json.loads(p), base | ({"binding_id", "object_id", "object_ref"} if d == "media" else set())), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def read_lockfile(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a lockfile: stable_id, normalized_note_id, guid, lifecycle, ord."""
    rows = read_documents(spark, path, LOCKFILE).select(F.posexplode("identity_index.notes").alias("ord", "e"))
    return rows.select("e.stable_id", "e.normalized_note_id", "e.guid", F.col("e.entry_lifecycle").alias("lifecycle"), F.col("ord").cast("bigint").alias("ord"))


def write_lockfile(entries: DataFrame, path: str) -> None:
    """Entries in order of stable id, as JSON lines; range partitions keep the order without one task for all.

    They are written beside the old lockfile and take its name when they are whole, so that a failed job leaves the old one.
    """
    made, spark = f"{path}.next", entries.sparkSession
    entries.repartitionByRange("stable_id").sortWithinPartitions("stable_id").write.mode("overwrite").json(made)
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(place(path), True)
    if not files.rename(place(made), place(path)):
        raise OSError(f"the lockfile stays under {made}")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of a collection, a parquet folder each."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines, a row each, with the columns in their order; null values are left out."""
    reports.write.mode("overwrite").json(path)


def product_notes(documents: DataFrame) -> DataFrame:
    """Notes of product documents (raw JSON in ``body``), of known and unknown kinds."""
    parsed = documents.select("document_id", F.posexplode(F.expr("variant_get(parse_json(body), '$.notes', 'array<variant>')")).alias("ord", "v"))
    get = lambda path, kind="string": F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    known = get("kind").isin("basic", "cloze", "image_occlusion", "custom")
    return parsed.select("document_id", "ord", get("kind").alias("kind"), get("stable_id").alias("stable_id"), get("note_type_id").alias("note_type_id"), F.when(~known, F.to_json("v")).alias("unknown"))
