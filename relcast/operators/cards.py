"""Which cards a note makes, and the rows of the collection that they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.text import is_blank, special_field
from .order import running

DEFAULT_DECK = "Default"


def cloze_ords(texts: Column) -> Column:
    """Sorted distinct card ordinals of well-formed cloze texts (an array of strings)."""
    numbers = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(r"(?s)\{\{c([0-9]+)::.+?\}\}"), F.lit(1))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(numbers, lambda n: n.cast("bigint") - 1), lambda n: n >= 0)))


def cloze_fields(template: Column) -> Column:
    """Fields that a template shows through a cloze filter, also in a chain of filters."""
    parts = F.transform(F.regexp_extract_all(template, F.lit(r"(?s)\{\{(.*?)\}\}"), F.lit(1)), lambda e: F.transform(F.split(e, ":"), F.trim))
    chosen = F.filter(parts, lambda p: (F.size(p) > 1) & F.array_contains(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), "cloze") & (F.element_at(p, -1) != ""))
    return F.array_sort(F.array_distinct(F.transform(chosen, lambda p: F.element_at(p, -1))))


def template_names(template: Column) -> Column:
    """Field names that a well-formed template uses, without sections' signs and filters."""
    inner = F.regexp_extract_all(template, F.lit(r"\{\{([^{}!/]*)\}\}"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(inner, lambda e: F.trim(F.element_at(F.split(F.regexp_replace(F.trim(e), "^[#^]", ""), ":"), -1)))))


def card_ordinals(texts: Column) -> Column:
    """Sorted distinct card ordinals of any texts (an array of strings, without null).

    Texts whose deletions are all plain are read natively; others, where a deletion may be empty, open, nested or out of
    range, go to the exact scanner.
    """
    odd = F.exists(texts, lambda t: F.regexp_replace(t, r"\{\{c[1-9][0-9]{0,8}::[^{}]+\}\}", "").contains("{{c"))
    return F.coalesce(udfs.cloze_ordinals_of(F.when(odd, texts)), cloze_ords(texts))


def filled_names(fields: Column) -> Column:
    """Names of the fields (a map) whose text isn't blank; only texts with markup go to the exact scanner."""
    marked = F.exists(F.map_values(fields), lambda v: v.contains("<") | v.contains("&"))
    return F.coalesce(udfs.filled_names(F.when(marked, fields)), F.map_keys(F.map_filter(fields, lambda _, v: ~is_blank(v))))


def generates(kind: Column, names: Column, filled: Column, declared: Column) -> Column:
    """Generation rule: none, all (an empty list holds), or any (an empty list doesn't). ``filled`` are names of filled fields."""
    has = lambda n: F.array_contains(declared, n) & F.array_contains(filled, n)
    return F.when(kind == "none", F.lit(True)).when(kind == "all", F.forall(names, has)).otherwise(F.exists(names, has))


def special_values(card: Column, deck: Column, tags: Column, kind: Column) -> Column:
    """Special field to value, of those that have one."""
    names = [F.lit(name) for name in ("Card", "Deck", "Subdeck", "Tags", "Type")]
    return F.map_filter(F.map_from_arrays(F.array(*names), F.array(*[special_field(n, card, deck, tags, kind) for n in names])), lambda _, v: v.isNotNull())


def plan_cards(notes: DataFrame, notetypes: DataFrame) -> DataFrame:
    """(note_id, template_index, card_ord, template_name, target_deck, deck_name) of every card.

    ``notes`` has id, notetype_id, fields and deck_name, and may have tags; ``notetypes`` id, kind, fields (names) and
    templates with name, ord, question_format, rule_kind, rule_fields and target_deck_name, and may have a name. A template
    without a rule makes a card if its rendered front has text. A cloze type makes a card of its first template for each ordinal.
    """
    kind_name = F.col("name") if "name" in notetypes.columns else F.col("id")
    types = notetypes.select(F.col("id").alias("notetype_id"), "kind", F.col("fields").alias("declared"), "templates", kind_name.alias("type_name"))
    tags = F.col("tags") if "tags" in notes.columns else F.array().cast("array<string>")
    joined = notes.select(F.col("id").alias("note_id"), "notetype_id", "fields", "deck_name", tags.alias("tags")).join(types, "notetype_id")
    each = joined.where("kind <> 'cloze'").select("note_id", "fields", "declared", "deck_name", "tags", "type_name", F.posexplode("templates").alias("template_index", "t"))
    ruled = each.where("t.rule_kind IS NOT NULL").withColumn("filled", filled_names(F.col("fields")))
    ruled = ruled.where(generates(F.col("t.rule_kind"), F.col("t.rule_fields"), F.col("filled"), F.col("declared"))).drop("filled")
    special = special_values(F.col("t.name"), F.col("deck_name"), F.col("tags"), F.col("type_name"))
    free = each.where("t.rule_kind IS NULL AND t.question_format IS NOT NULL")
    free = free.where(udfs.renders_text(F.col("t.question_format"), F.map_filter("fields", lambda _, v: v.isNotNull()), special, F.col("declared")))
    plain = ruled.unionByName(free).select("note_id", "template_index", F.coalesce(F.col("t.ord"), F.col("template_index")).cast("bigint").alias("card_ord"), "t", "deck_name")
    cloze = joined.where("kind = 'cloze'").withColumn("t", F.try_element_at("templates", F.lit(1))).where("t IS NOT NULL")
    values = F.when(F.size("t.rule_fields") > 0, F.transform("t.rule_fields", lambda n: F.try_element_at("fields", n))).otherwise(F.map_values("fields"))
    cloze = cloze.withColumn("texts", F.filter(values, lambda v: v.isNotNull()))
    cloze = cloze.select("note_id", F.lit(0).alias("template_index"), F.explode(card_ordinals(F.col("texts"))).alias("card_ord"), "t", "deck_name")
    return plain.unionByName(cloze).select("note_id", "template_index", "card_ord", F.col("t.name").alias("template_name"), F.col("t.target_deck_name").alias("target_deck"), "deck_name")


def deck_registry(names: DataFrame) -> DataFrame:
    """(name, deck_id): the default deck is 1, the others follow in byte order. ``names`` has name; distinct names are few."""
    others = names.where(F.col("name") != DEFAULT_DECK).distinct()
    numbered = others.select("name", (F.dense_rank().over(Window.orderBy("name")) + 1).cast("bigint").alias("deck_id"))
    return numbered.unionByName(names.sparkSession.range(1).select(F.lit(DEFAULT_DECK).alias("name"), F.lit(1).cast("bigint").alias("deck_id")))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with 1-based places in an order, summed up over ranges of it."""
    return running(rows, [], order, F.lit(1).cast("bigint"), name)


def card_decks(cards: DataFrame, decks: DataFrame) -> DataFrame:
    """Cards with deck_id: of the template's target deck, else of the note's deck, else 1."""
    named = cards.withColumn("__deck", F.coalesce("target_deck", "deck_name")).join(decks.withColumnRenamed("name", "__deck"), "__deck", "left")
    return named.withColumn("deck_id", F.coalesce("deck_id", F.lit(1).cast("bigint"))).drop("__deck")


def target_decks(templates: DataFrame, decks: DataFrame) -> DataFrame:
    """Templates that declare a target deck, with its id; an unknown deck is 0."""
    declared = templates.where("target_deck_name IS NOT NULL").join(decks.select(F.col("name").alias("target_deck_name"), "deck_id"), "target_deck_name", "left")
    return declared.withColumn("deck_id", F.coalesce("deck_id", F.lit(0).cast("bigint")))


def sorted_fields(fields: Column) -> Column:
    """Names in order of (given ord, else position; position); ``fields`` is an array of structs name, ord, sort."""
    placed = F.transform(fields, lambda f, i: F.struct(F.coalesce(f["ord"], i).alias("o"), i.alias("i"), f["name"].alias("name"), f["sort"].alias("sort")))
    return F.array_sort(placed)


def sort_field(fields: Column) -> Column:
    """Name of the field to sort by: the first marked one, else the first."""
    placed = sorted_fields(fields)
    marked = F.filter(placed, lambda f: F.coalesce(f["sort"], F.lit(False)))
    return F.coalesce(F.try_element_at(marked, F.lit(1))["name"], F.try_element_at(placed, F.lit(1))["name"])
