"""Release-shaped frames, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_id() -> F.Column:
    return F.concat(F.lit("doc:"), F.col("doc_id"))


def notes(docs: DataFrame, current: bool) -> DataFrame:
    """(id, doc_id, deck, tags, text, ord): the current release lacks every 10th document and changes every 7th, the previous one lacks every 11th."""
    kept = docs.where(F.col("doc_id") % (10 if current else 11) != 0)
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")) if current else F.col("text")
    return kept.select(doc_id().alias("id"), "doc_id", F.concat("lang", F.lit("::"), "source").alias("deck"), F.array("lang", "source").alias("tags"), text.alias("text"), F.col("doc_id").alias("ord"), "lang", "source")


def current_index(docs: DataFrame) -> DataFrame:
    return notes(docs, True).select(F.col("id").alias("normalized_note_id"), F.col("id").alias("stable_id"), F.concat(F.lit("cand-"), "doc_id").alias("candidate"))


def previous_index(docs: DataFrame) -> DataFrame:
    return notes(docs, False).select(F.col("id").alias("stable_id"), F.concat(F.lit("prev-"), "doc_id").alias("guid"), "ord")


def lockfile(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id % 3 = 0").select(doc_id().alias("stable_id"), F.concat(F.lit("lock-"), "doc_id").alias("guid"), F.col("doc_id").alias("ord"))


def cloze_notes(part: DataFrame) -> DataFrame:
    """(id, ord, text): no deletion where the size is a multiple of 5, a repeated one where it is a multiple of 3."""
    pair = F.concat(F.lit("{{c1::"), "p_name", F.lit("}} by {{c2::"), "p_brand", F.lit("}}"))
    more = F.when(F.col("p_size") % 3 == 0, F.concat(pair, F.lit(" and {{c1::"), "p_type", F.lit("}}"))).otherwise(pair)
    return part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(more).alias("text"), "p_type", "p_size")


def file_name() -> F.Column:
    return F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("."), F.lit("png"))


def reference_text(part: DataFrame) -> DataFrame:
    """(id, text): an image of each part, remote for every 4th, with a space for every 5th; a sound for every 3rd."""
    key = F.col("p_partkey")
    src = F.when(key % 4 == 0, F.concat(F.lit("https://example.com/"), file_name())).when(key % 5 == 0, F.concat(F.lit("my "), file_name())).otherwise(file_name())
    sound = F.when(key % 3 == 0, F.concat(F.lit("[sound:part"), key, F.lit(".mp3]"))).otherwise("")
    return part.select(F.concat(F.lit("part:"), key).alias("id"), F.concat(F.lit('<img src="'), src, F.lit('">'), sound).alias("text"))


def references(part: DataFrame) -> DataFrame:
    """(owner_id, ref_kind, raw_ref, is_url) by the native extraction."""
    from ..functions.text import attribute_refs, sound_refs

    text = reference_text(part)
    images = text.select(F.col("id").alias("owner_id"), F.lit("html_src").alias("ref_kind"), F.explode(attribute_refs(F.col("text"), "src")).alias("raw_ref"), F.lit(True).alias("is_url"))
    return images.unionByName(text.select(F.col("id").alias("owner_id"), F.lit("sound").alias("ref_kind"), F.explode(sound_refs(F.col("text"))).alias("raw_ref"), F.lit(False).alias("is_url")))


def bindings(part: DataFrame) -> DataFrame:
    """The images of parts with even keys, one for each name."""
    return part.where("p_partkey % 2 = 0").groupBy(file_name().alias("export_filename")).agg(F.concat(F.lit("media:"), F.min("p_partkey")).alias("id"))


def media(docs: DataFrame) -> DataFrame:
    """(ord, filename, digest, size): a file of each document; 40 names in all for every 25th one."""
    name = F.when(F.col("doc_id") % 25 == 0, F.concat(F.lit("shared"), F.col("doc_id") % 40)).otherwise(F.concat(F.lit("doc"), "doc_id"))
    return docs.select(F.col("doc_id").alias("ord"), F.concat(name, F.lit(".txt")).alias("filename"), F.sha1(F.coalesce("text", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"), "lang", "source")


def type_parts(part: DataFrame, current: bool) -> DataFrame:
    """(type_id, type_name, parts): a type for each part with a field and templates; the current version differs by key."""
    key = F.col("p_partkey")
    kept = part.where(key % (17 if current else 19) != 0)
    name = F.when((key % 7 == 0) & F.lit(current), F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))

    def piece(kind: str, ident, label, place, config) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), ident.alias("key"), label.alias("name"), place.cast("int").alias("ord"), config.cast("bigint").alias("config_id"))

    now = F.lit(current)
    field = piece("field", F.lit("front"), F.when(now & (key % 5 == 0), "Vorderseite").otherwise("Front"), F.when(now & (key % 11 == 0), 1).otherwise(0), F.when(now & (key % 13 == 0), key + 1).otherwise(key))
    card = piece("template", F.lit("card"), F.when(now & (key % 6 == 0), "Karte").otherwise("Card"), F.when(now & (key % 10 == 0), 1).otherwise(0), F.when(now & (key % 14 == 0), key + 2).otherwise(key))
    extra = piece("template", F.lit("extra"), F.lit("Extra"), F.lit(1), key)
    there = key % (8 if current else 9) == 0
    return kept.select(F.concat(F.lit("type:"), key).alias("type_id"), name.alias("type_name"), F.when(there, F.array(field, card, extra)).otherwise(F.array(field, card)).alias("parts"))


def diagnostics(events: DataFrame) -> DataFrame:
    """(ord, level, code, summary, path, domain, stage, source) of events; repeated on purpose."""
    code = F.concat(F.lit("UPDATE."), F.upper("event_type"))
    level = F.element_at(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), (F.col("user_id") % 3 + 1).cast("int"))
    return events.select(F.col("event_id").alias("ord"), level.alias("level"), code.alias("code"), F.concat(F.lit("user "), F.col("user_id") % 20).alias("summary"), F.concat(F.lit("/users/"), F.col("user_id") % 20).alias("path"), F.lit("update").alias("domain"), F.lit("reconcile").alias("stage"), F.concat(F.lit("event:"), "event_id").alias("source"))
