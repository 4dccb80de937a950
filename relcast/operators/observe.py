"""Observing a release as one long table (domain, selector, payload, evidence, ord), and reading collections back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import evidence_text, selector_text, split_fields
from .cards import DEFAULT_DECK

OBSERVATION = ["domain", "selector", "payload", "evidence", "ord"]


def _row(domain: str, selector: Column, payload: Column, evidence: Column, order: Column) -> list[Column]:
    return [F.lit(domain).alias("domain"), selector.alias("selector"), F.to_json(payload).alias("payload"), F.array(evidence).alias("evidence"), order.cast("bigint").alias("ord")]


def _typed(kind: str, owner: Column, name: Column) -> Column:
    return F.concat(F.lit("notetype[id='"), owner, F.lit(f"']::{kind}["), name, F.lit("]"))


def notetype_observations(notetypes: DataFrame) -> DataFrame:
    """Of types, fields and templates; fields in payloads stand in sorted order."""
    id_ = F.col("id")
    types = notetypes.select(*_row("notetypes", F.concat(F.lit("notetype[id='"), id_, F.lit("']")), F.struct("css", F.size("fields").alias("field_count"), "id", "kind", "name", F.size("templates").alias("template_count")), F.concat(F.lit("notetype:"), id_), F.lit(0)))
    fields = notetypes.select("id", F.posexplode("fields").alias("at", "f"))
    fields = fields.select(*_row("fields", _typed("field", id_, F.col("f.name")), F.struct(F.col("f.name").alias("name"), id_.alias("notetype_id"), F.coalesce("f.ord", "at").alias("ord")), F.concat(F.lit("field:"), id_, F.lit(":"), F.col("f.name")), F.col("at")))
    templates = notetypes.select("id", F.posexplode("templates").alias("at", "t"))
    templates = templates.select(*_row("templates", _typed("template", id_, F.col("t.name")), F.struct(F.col("t.answer_format").alias("answer_format"), F.col("t.name").alias("name"), id_.alias("notetype_id"), F.coalesce("t.ord", "at").alias("ord"), F.col("t.question_format").alias("question_format")), F.concat(F.lit("template:"), id_, F.lit(":"), F.col("t.name")), F.col("at")))
    return types.unionByName(fields).unionByName(templates)


def note_observations(notes: DataFrame) -> DataFrame:
    """Of notes (id, deck, tags, text, ord)."""
    payload = F.struct("deck", "id", F.array_sort("tags").alias("tags"), "text")
    return notes.select(*_row("references", F.concat(F.lit("note[id='"), "id", F.lit("']")), payload, F.concat(F.lit("note:"), "id"), F.col("ord")))


def card_observations(cards: DataFrame) -> DataFrame:
    payload = F.struct("card_ord", F.coalesce("deck_name", F.lit(DEFAULT_DECK)).alias("deck"), "note_id", F.coalesce("template_name", F.lit("<missing template>")).alias("template"))
    place = F.concat("note_id", F.lit(":"), F.col("card_ord").cast("string"))
    return cards.select(*_row("references", F.concat(F.lit("card[note_id='"), "note_id", F.lit("'][ord="), F.col("card_ord").cast("string"), F.lit("]")), payload, F.concat(F.lit("card:"), place), F.lit(0)))


def media_observations(media: DataFrame) -> DataFrame:
    payload = F.struct("filename", "sha1", "size")
    return media.select(*_row("media", F.concat(F.lit("media[filename='"), "filename", F.lit("']")), payload, F.concat(F.lit("media:"), "filename"), F.lit(0)))


def reference_observations(references: DataFrame) -> DataFrame:
    parts = ("owner_kind", "owner_id", "location_kind", "location_name")
    selector = F.concat(F.lit("media-ref"), *[x for p in parts for x in (F.lit(f"[{p}="), selector_text(F.col(p)), F.lit("]"))], F.lit("[ref="), selector_text(F.col("raw_ref")), F.lit("]"))
    evidence = F.concat_ws(":", F.lit("media-ref"), *[evidence_text(F.col(p)) for p in (*parts, "raw_ref")])
    return references.select(*_row("references", selector, F.struct("media_id", "raw_ref", "ref_kind", "resolution_status", "skip_reason"), evidence, F.lit(0)))


def counts(notetypes: DataFrame, notes: DataFrame, cards: DataFrame, media: DataFrame) -> DataFrame:
    """One row of the numbers of everything."""
    out = notetypes.agg(F.count("*").alias("notetype_count"), F.coalesce(F.sum(F.size("templates")), F.lit(0)).cast("bigint").alias("template_count"), F.coalesce(F.sum(F.size("fields")), F.lit(0)).cast("bigint").alias("field_count"))
    for name, rows in (("note_count", notes), ("card_count", cards), ("media_count", media)):
        out = out.join(F.broadcast(rows.agg(F.count("*").alias(name))))  # one row each
    return out


def count_observation(row: DataFrame) -> DataFrame:
    return row.select(*_row("metadata", F.lit("counts"), F.struct(*sorted(row.columns)), F.lit("counts"), F.lit(0)))


# --- collections -----------------------------------------------------------------------------------------------------


def note_decks(cards: DataFrame, decks: DataFrame) -> DataFrame:
    """(note_id, deck): of the card of least ordinal (then deck); ``Default`` where the deck is unknown. ``cards`` has note_id, ord, did."""
    first = cards.groupBy("note_id").agg(F.min_by("did", F.struct("ord", "did")).alias("did"))
    return first.join(decks, "did", "left").select("note_id", F.coalesce("deck", F.lit(DEFAULT_DECK)).alias("deck"))


def card_deck_map(cards: DataFrame, notes: DataFrame, decks: DataFrame) -> DataFrame:
    """(guid, ord, deck) of every card."""
    joined = cards.join(notes, "note_id").join(decks, "did", "left")
    return joined.select("guid", "ord", F.coalesce("deck", F.lit(DEFAULT_DECK)).alias("deck"))


def card_templates(cards: DataFrame, notetypes: DataFrame) -> DataFrame:
    """Cards (note_id, notetype_id, ord) with their template's name; a cloze type's cards all have its first template."""
    opened = notetypes.select(F.col("id").alias("notetype_id"), "kind", F.posexplode("templates").alias("at", "t"))
    by_ord = opened.where("kind <> 'cloze'").select("notetype_id", F.coalesce(F.col("t.ord"), F.col("at")).cast("bigint").alias("ord"), F.col("t.name").alias("plain"))
    first = opened.where("kind = 'cloze' AND at = 0").select("notetype_id", F.col("t.name").alias("cloze"))
    joined = cards.join(by_ord, ["notetype_id", "ord"], "left").join(first, "notetype_id", "left")
    return joined.select("note_id", "notetype_id", "ord", F.coalesce("cloze", "plain", F.lit("<missing template>")).alias("template"))


def collection_notes(notes: DataFrame, names: DataFrame) -> DataFrame:
    """Stored notes (guid, notetype_id, joined) with fields by name; ``names`` has notetype_id and names in order."""
    return notes.join(names, "notetype_id").select("guid", "notetype_id", split_fields(F.col("joined"), F.col("names")).alias("fields"))


def inconsistent_media(referenced: DataFrame, media: DataFrame) -> DataFrame:
    """Referenced local names that the media map lacks."""
    return referenced.select(F.col("local").alias("filename")).where("filename IS NOT NULL").distinct().join(media, "filename", "left_anti")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
