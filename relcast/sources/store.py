"""A content-addressed store of media as a table, and template bundles."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest manifest and text file of a bundle.
MANIFEST, LARGEST = "anki-template.yaml", 1 << 20


def object_path(digest: Column) -> Column:
    """``objects/aa/bb/<digest>``."""
    return F.concat_ws("/", F.lit("objects"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def objects(files: DataFrame) -> DataFrame:
    """(digest, sha1, size, path, content) of each content once; ``files`` has path and content."""
    made = files.select(F.sha2("content", 256).alias("digest"), F.sha1("content").alias("sha1"), F.length("content").cast("bigint").alias("size"), "content")
    return made.dropDuplicates(["digest"]).withColumn("path", object_path(F.col("digest")))


def add_objects(files: DataFrame, store: str) -> None:
    """Write the objects that the store (a parquet folder) lacks; repeating it adds nothing."""
    spark, new = files.sparkSession, objects(files)
    try:
        known = spark.read.parquet(store).select("digest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    if known is not None:
        new = new.join(known, "digest", "left_anti")
    new.withColumn("shelf", F.substring("digest", 1, 1)).write.mode("append").partitionBy("shelf").parquet(store)


def verified(store: DataFrame) -> DataFrame:
    """Objects whose content no longer has the digest or size that names it."""
    return store.where((F.sha2("content", 256) != F.col("digest")) | (F.length("content") != F.col("size"))).select("digest")


def read_bundle(spark: SparkSession, root: str) -> DataFrame:
    """(name, text) of a template bundle's manifest and the files it names; paths out of the bundle are refused.

    A bundle is a small folder that its author keeps; the driver reads it. The manifest is YAML, or JSON, which YAML includes.
    """
    root = os.path.realpath(root)

    def text(name: str) -> str:
        path = os.path.realpath(os.path.join(root, name))
        if os.path.isabs(name) or os.path.commonpath([root, path]) != root or not os.path.isfile(path):
            raise ValueError(f"bundle path {name!r} isn't a file of the bundle")
        if os.path.getsize(path) > LARGEST:
            raise ValueError(f"bundle file {name!r} is too large")
        with open(path, encoding="utf-8") as f:
            return f.read()

    source = text(MANIFEST)
    try:
        manifest = json.loads(source)
    except ValueError:
        import yaml

        manifest = yaml.safe_load(source)
    files = [manifest[k] for k in manifest if k.endswith("_file")]
    for template in manifest["note_type"]["templates"]:
        files += [template[k] for k in template if k.endswith("_file")]
    return spark.createDataFrame([(MANIFEST, json.dumps(manifest, sort_keys=True))] + [(name, text(name)) for name in sorted(set(files))], "name string, text string")
