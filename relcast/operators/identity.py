"""Stable identities from content: canonical payload, digest, precedence, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.text import json_text, unix_newlines
from .order import running

#: Fixed values.
NAMESPACE = "afid:v1:"
BASIC_RECIPE, CLOZE_RECIPE, MASK_RECIPE = "basic.core.v1", "cloze.core.v2", "io.core.v2"


def payload(components: Column, family: str, key: Column | str, recipe: Column | str) -> Column:
    """Canonical JSON of an identity; ``components`` is canonical JSON."""
    text = lambda c: json_text(F.lit(c) if isinstance(c, str) else c)
    return F.concat(F.lit('{"algo_version":1,"components":'), components, F.lit(',"notetype_family":'), text(family), F.lit(',"notetype_key":'), text(key), F.lit(',"recipe_id":'), text(recipe), F.lit("}"))


def selected_fields(*fields: tuple[str, Column]) -> Column:
    """Components of named field texts."""
    rows = [F.concat(F.lit('{"name":'), json_text(F.lit(name)), F.lit(',"value":'), json_text(value), F.lit("}")) for name, value in fields]
    return F.concat(F.lit('{"selected_fields":['), F.concat_ws(",", *rows), F.lit("]}"))


def basic_payload(front: Column, nfc: bool = True) -> Column:
    """Payload of a basic note by its front. ``nfc=False`` is for text that is known to be in normal form."""
    # only text beyond ASCII can change under NFC, so only that goes to Python
    value = F.when(front.rlike(r"[^\x00-\x7F]"), udfs.identity_text(front)).otherwise(unix_newlines(front)) if nfc else unix_newlines(front)
    return payload(selected_fields(("front", value)), "stock", "basic", BASIC_RECIPE)


def cloze_payload(text: Column) -> Column:
    """Payload of a cloze text by the exact scanner; null if the text is malformed."""
    return payload(udfs.cloze_components(text), "stock", "cloze", CLOZE_RECIPE)


def cloze_skeleton(text: Column) -> Column:
    """Skeleton of a well-formed cloze text: each deletion is a marker, backslashes and literal markers are escaped."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("[[CLOZE]]"), F.lit("\\[[CLOZE]]"))
    return F.regexp_replace(escaped, r"(?s)\{\{c[0-9]+::.*?\}\}", "[[CLOZE]]")


def mask_payload(anchor: Column, width: Column, height: Column, mode: Column, shapes: Column) -> Column:
    """Payload of image masks: sorted shapes (structs x, y, width, height), the image's digest and its size."""
    ordered = F.array_sort(F.transform(shapes, lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["width"].alias("w"), r["height"].alias("h"))))
    drawn = F.array_join(F.transform(ordered, lambda r: F.concat(F.lit('{"h_px":'), r["h"], F.lit(',"shape":"rect","w_px":'), r["w"], F.lit(',"x_px":'), r["x"], F.lit(',"y_px":'), r["y"], F.lit("}"))), ",")
    parts = F.concat(F.lit('{"image_anchor":'), json_text(anchor), F.lit(',"image_height_px":'), height, F.lit(',"image_width_px":'), width, F.lit(',"occlusion_mode":'), json_text(mode), F.lit(',"shapes":['), drawn, F.lit("]}"))
    return payload(parts, "stock", "image_occlusion", MASK_RECIPE)


def mask_issue(width: Column, height: Column, shapes: Column) -> Column:
    """Why masks have no identity: none, empty, outside the image, or repeated."""
    outside = F.exists(shapes, lambda r: (r["x"] + r["width"] > width) | (r["y"] + r["height"] > height))
    return F.when(F.size(shapes) == 0, "EMPTY").when(F.exists(shapes, lambda r: (r["width"] == 0) | (r["height"] == 0)), "ZERO_SIZE").when(outside, "OUT_OF_BOUNDS").when(F.size(F.array_distinct(shapes)) < F.size(shapes), "DUPLICATE")


def custom_payload(family_key: Column, recipe: Column, fields: Column) -> Column:
    """Payload of a custom type over its recipe's fields (a map of key to text), by key."""
    entries = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(F.lit('{"key":'), json_text(e["key"]), F.lit(',"value":'), json_text(unix_newlines(e["value"])), F.lit("}")))
    return payload(F.concat(F.lit('{"selected_fields":['), F.array_join(entries, ","), F.lit("]}")), "custom", family_key, recipe)


def stable_id(canonical: Column) -> Column:
    return F.concat(F.lit(NAMESPACE), udfs.blake3_of(canonical))


def resolved(notes: DataFrame) -> DataFrame:
    """Notes with identity and its provenance: a unique explicit id, else the override, the type's recipe, the stock recipe, or a generated id.

    ``notes`` has ord, explicit_id, override_id, recipe_id and stock_id (null where a note has none).
    """
    counts = notes.where("explicit_id IS NOT NULL").groupBy("explicit_id").agg(F.count("*").alias("__n"))
    joined = notes.join(counts, "explicit_id", "left")
    unique = F.when(F.col("__n") == 1, F.col("explicit_id"))
    chosen = F.coalesce(unique, "stock_id", "override_id", "recipe_id", F.concat(F.lit("generated:"), F.col("ord") + 1))
    origin = F.when(unique.isNotNull(), "explicit").when(F.col("stock_id").isNotNull(), "stock").when(F.col("override_id").isNotNull(), "override").when(F.col("recipe_id").isNotNull(), "recipe").otherwise("generated")
    return joined.select("ord", chosen.alias("stable_id"), origin.alias("provenance"))


def identity_issues(notes: DataFrame) -> DataFrame:
    """(stable_id, issue): ids that several notes have, told apart by whether their payloads agree."""
    grouped = notes.groupBy("stable_id").agg(F.count("*").alias("n"), F.count_distinct("payload").alias("payloads"))
    return grouped.where("n > 1").select("stable_id", F.when(F.col("payloads") > 1, "STABLE_ID_COLLISION").otherwise("DUPLICATE_PAYLOAD").alias("issue"))


def generated_ids(notes: DataFrame, taken: DataFrame) -> DataFrame:
    """Notes (deck, ord) with ``id`` generated:<deck>:<n>; the numbers of a deck go up in order and leave out taken ids.

    ``taken`` has stable_id. The jth taken number t of a deck lies before its note i if t - j < i, so a note's number is its
    place and the count of such t. Places and counts are running sums, so no deck is numbered in one task.
    """
    name, one = r"(?s)^generated:(.*):([1-9][0-9]{0,17})$", F.lit(1).cast("bigint")
    used = taken.select(F.regexp_extract("stable_id", name, 1).alias("deck"), F.regexp_extract("stable_id", name, 2).alias("n")).where("n <> ''")
    used = running(used.select("deck", F.col("n").cast("bigint").alias("n")).distinct(), ["deck"], ["n"], one, "j")
    placed = running(notes, ["deck"], ["ord"], one, "place")
    marks = placed.select("deck", "place", "ord", F.lit(1).alias("kind")).unionByName(used.select("deck", (F.col("n") - F.col("j") + 1).alias("place"), F.lit(None).cast(notes.schema["ord"].dataType).alias("ord"), F.lit(0).alias("kind")))
    counted = running(marks, ["deck"], ["place", "kind"], F.when(F.col("kind") == 0, one).otherwise(F.lit(0).cast("bigint")), "before").where("kind = 1")
    return counted.select(F.concat(F.lit("generated:"), "deck", F.lit(":"), F.col("place") + F.col("before")).alias("id"), "deck", "ord")
