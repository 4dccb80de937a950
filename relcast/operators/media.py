"""Media: content-addressed objects, names and budgets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.text import mime_of_name
from .cards import numbered

#: Fixed value: the largest inline medium.
INLINE_LIMIT = 65_536


def inline_bytes(base64: Column, limit: int = INLINE_LIMIT) -> Column:
    """Decoded content; null if it can't be decoded, or if the most it could be is over the limit (tested before decoding)."""
    base64 = F.regexp_replace(base64, r"\s", "")
    most = F.floor((F.length(base64) + 3) / 4) * 3
    return F.when(most <= limit, F.try_to_binary(base64, F.lit("base64")))


def is_inside(path: Column) -> Column:
    """Relative, without ``.`` or ``..`` components."""
    return ~path.rlike(r"^/") & ~F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))


def object_roles(media: DataFrame) -> DataFrame:
    """Media (ord, filename, digest) with what becomes of each.

    ``new_object`` is the first of its digest, ``deduped`` a later one; a name that is met again is ``merged`` for the
    same digest and a ``conflict`` for another.
    """
    first_of = lambda key: Window.partitionBy(key).orderBy("ord")
    named = media.withColumn("owner", F.first("digest").over(first_of("filename"))).withColumn("nth", F.row_number().over(first_of("filename")))
    named = named.withColumn("binding", F.when(F.col("nth") == 1, "bound").when(F.col("owner") == F.col("digest"), "merged").otherwise("conflict"))
    role = F.when(F.row_number().over(first_of("digest")) == 1, "new_object").otherwise("deduped")
    return named.withColumn("object", role).drop("owner", "nth")


def within_budget(objects: DataFrame, limit: int) -> DataFrame:
    """Objects in order (grp, ord, size) with ``kept``: one that would pass the limit is skipped and not counted.

    The running total depends on every earlier choice, so a group is read in order; groups go side by side. A task reads its rows as a
    sorted stream and holds one total.
    """

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = object(), 0
        for frame in frames:
            kept = []
            for grp, size in zip(frame.column("grp").to_pylist(), frame.column("size").to_pylist(), strict=True):
                if grp != at:
                    at, total = grp, 0
                kept.append(total + size <= limit)
                total += size if kept[-1] else 0
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(kept, pa.bool_())], [*frame.schema.names, "kept"])

    rows = objects.select("grp", F.col("ord").cast("bigint").alias("ord"), F.col("size").cast("bigint").alias("size")).repartition("grp").sortWithinPartitions("grp", "ord", "size")
    return rows.mapInArrow(run, f"grp {rows.schema['grp'].dataType.simpleString()}, ord bigint, size bigint, kept boolean")


def media_summary(objects: DataFrame, bindings: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: bindings, distinct objects and their bytes, missing, unsafe and unused references."""
    distinct = objects.groupBy("digest").agg(F.max("size").alias("size")).agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))
    used = resolved.where("resolution_status = 'resolved'").select(F.col("media_id").alias("id"))
    counts = [bindings.agg(F.count("*").alias("bindings")), resolved.agg(F.count_if(F.col("resolution_status") == "missing").alias("missing"), F.count_if("unsafe").alias("unsafe")), bindings.join(used, "id", "left_anti").agg(F.count("*").alias("unused"))]
    for one in counts:  # one row each
        distinct = distinct.join(F.broadcast(one))
    return distinct


def staged_status(manifest: DataFrame, staged: DataFrame) -> DataFrame:
    """Manifest entries (filename, size, sha1) against what is staged: ok, missing, size_mismatch or digest_mismatch."""
    found = staged.select("filename", F.col("size").alias("s"), F.col("sha1").alias("h"))
    status = F.when(F.col("s").isNull(), "missing").when(F.col("s") != F.col("size"), "size_mismatch").when(F.col("h") != F.col("sha1"), "digest_mismatch").otherwise("ok")
    return manifest.join(found, "filename", "left").select("filename", status.alias("status"))


def changed_sources(registered: DataFrame, now: DataFrame) -> DataFrame:
    """Registered media whose source has another digest or size by now."""
    joined = registered.join(now.select("filename", F.col("digest").alias("d"), F.col("size").alias("s")), "filename")
    return joined.where(~(F.col("d").eqNullSafe(F.col("digest")) & F.col("s").eqNullSafe(F.col("size")))).select("filename", F.lit("MEDIA.SOURCE_CHANGED").alias("code"))


def raster_size(name: Column, content: Column) -> Column:
    """struct(width, height) of a PNG, JPEG, GIF or WebP by its name, from its header; null for others and for broken headers.

    Only contents with the sign of a JPEG go to a Python worker, as the place of their frame header varies.
    """
    head = F.hex(F.substring(content, 1, 30))
    digits = lambda at, n: F.substring(head, 2 * at + 1, 2 * n)
    big = lambda at, n: F.conv(digits(at, n), 16, 10).cast("bigint")
    little = lambda at, n: F.conv(F.concat(*[digits(at + i, 1) for i in reversed(range(n))]), 16, 10).cast("bigint")
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    webp = head.startswith("52494646") & (digits(8, 4) == "57454250")
    packed = little(21, 4)
    is_jpeg = head.startswith("FFD8FF")
    jpeg = udfs.jpeg_size(F.when(is_jpeg, content))
    found = (
        F.when(head.startswith("89504E470D0A1A0A") & (F.length(head) >= 48), size(big(16, 4), big(20, 4)))
        .when(head.startswith("47494638") & (F.length(head) >= 20), size(little(6, 2), little(8, 2)))
        .when(webp & (F.length(head) == 60) & (digits(12, 4) == "56503820") & (digits(23, 3) == "9D012A"), size(little(26, 2).bitwiseAND(0x3FFF), little(28, 2).bitwiseAND(0x3FFF)))
        .when(webp & (F.length(head) >= 50) & (digits(12, 4) == "5650384C") & (digits(20, 1) == "2F"), size(packed.bitwiseAND(0x3FFF) + 1, F.shiftright(packed, 14).bitwiseAND(0x3FFF) + 1))
        .when(webp & (F.length(head) == 60) & (digits(12, 4) == "56503858"), size(little(24, 3) + 1, little(27, 3) + 1))
        .when(is_jpeg & jpeg["width"].isNotNull(), jpeg)
    )
    return F.when(mime_of_name(name).isin("image/png", "image/jpeg", "image/gif", "image/webp"), found)


#: The order of references in a document.
REFERENCE_ORDER = ("owner_kind", "owner_id", "location_kind", "location_name", "raw_ref", "ref_kind", "resolution_status", "media_id", "skip_reason")


def ordered_references(resolved: DataFrame) -> DataFrame:
    """References with ``place``, from 1, in the order of a document; null counts as empty."""
    keys = [F.coalesce(c, F.lit("")).alias(f"__{c}") for c in REFERENCE_ORDER]
    names = [f"__{c}" for c in REFERENCE_ORDER]
    return numbered(resolved.select("*", *keys), names, "place").drop(*names)


def ordered_bindings(bindings: DataFrame) -> DataFrame:
    """Bindings with ``place``, from 1, by name and id."""
    return numbered(bindings, ["export_filename", "id"], "place")
