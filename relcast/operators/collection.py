"""The tables of a collection: rows with numbers in place of ids, as a package stores them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.text import field_checksum, joined_fields
from .cards import card_decks, deck_registry, numbered, plan_cards, sort_field, sorted_fields


def collection_tables(notes: DataFrame, notetypes: DataFrame, assigned: DataFrame) -> dict[str, DataFrame]:
    """decks, notetypes, fields, templates, notes, cards and tags of a release.

    ``notes`` has id, ord, notetype_id, deck_name, fields (map), tags and mtime_secs; ``notetypes`` id, ord, name, kind,
    fields (array of structs name, ord, sort) and templates as ``cards.plan_cards`` takes them; ``assigned`` what
    ``release.reconcile`` gives. Rows are numbered in the order of their ``ord``. A note of an unknown type is left out (a check
    before refuses such a release); a note without a guid has its id; a field without a value is empty.
    """
    types = numbered(notetypes, ["ord", "id"], "ntid")
    opened = types.select("ntid", F.posexplode("fields").alias("place", "f"))
    templates = types.select("ntid", F.posexplode("templates").alias("place", "t")).select("ntid", F.coalesce("t.ord", "place").cast("bigint").alias("ord"), F.col("t.name").alias("name"), F.col("t.target_deck_name").alias("target"))
    decks = deck_registry(notes.select(F.col("deck_name").alias("name")).unionByName(templates.select(F.col("target").alias("name"))).where("name IS NOT NULL"))
    aimed = templates.join(decks.withColumnRenamed("name", "target"), "target", "left")

    kinds = types.select(F.col("id").alias("notetype_id"), "ntid", F.transform(sorted_fields(F.col("fields")), lambda f: f["name"]).alias("names"), sort_field(F.col("fields")).alias("by"))
    guids = assigned.select(F.col("normalized_note_id").alias("id"), F.col("selected_guid").alias("guid"))
    known = notes.join(kinds, "notetype_id").join(guids, "id", "left")
    rows = numbered(known, ["ord", "id"], "note_row")
    value = lambda name: F.coalesce(F.try_element_at("fields", name), F.lit(""))
    first = F.coalesce(F.try_element_at("names", F.lit(1)), F.lit(""))
    stored = rows.select(
        F.col("note_row").alias("id"),
        F.coalesce("guid", "id").alias("guid"),
        F.col("ntid").alias("mid"),
        F.coalesce("mtime_secs", F.lit(1)).cast("bigint").alias("mod"),
        F.array_join("tags", " ").alias("tags"),
        joined_fields(F.transform("names", value)).alias("flds"),
        udfs.exact_strip(value(F.coalesce("by", F.lit("")))).alias("sfld"),
        field_checksum(udfs.exact_strip(value(first))).alias("csum"),
    )
    plain = notetypes.withColumn("fields", F.transform("fields", lambda f: f["name"]))
    planned = card_decks(plan_cards(notes, plain), decks).join(rows.select(F.col("id").alias("note_id"), "note_row"), "note_id")
    cards = numbered(planned.select("note_row", "template_index", "card_ord", "deck_id"), ["note_row", "template_index", "card_ord"], "id")
    return {
        "decks": decks.select(F.col("deck_id").alias("id"), "name"),
        "notetypes": types.select(F.col("ntid").alias("id"), "name"),
        "fields": opened.select("ntid", F.coalesce("f.ord", "place").cast("bigint").alias("ord"), F.col("f.name").alias("name")),
        "templates": aimed.select("ntid", "ord", "name", F.coalesce("deck_id", F.lit(0)).cast("bigint").alias("target_deck_id")),
        "notes": stored,
        "cards": cards.select("id", F.col("note_row").alias("nid"), F.col("deck_id").alias("did"), F.col("card_ord").alias("ord"), F.col("note_row").alias("due")),
        "tags": notes.select(F.explode("tags").alias("tag")).distinct(),
    }
