"""Validation of decks, projects and custom types, helper markup, and what validation reports show.

Every rule is a filter that gives rows (code, level, subject); a check is the union of its rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, json_text, replaced_first
from .cards import cloze_fields

STOCK_IDS = ("basic", "cloze", "image_occlusion")


def _found(rows: DataFrame, when: Column, code: str, level: str, subject: Column) -> DataFrame:
    return rows.where(F.coalesce(when, F.lit(False))).select(F.lit(code).alias("code"), F.lit(level).alias("level"), subject.cast("string").alias("subject"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _repeated(rows: DataFrame, key: str, code: str) -> DataFrame:
    """One row for every repetition of a key."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return counts.select(F.lit(code).alias("code"), F.lit("error").alias("level"), F.col(key).alias("subject"), F.explode(F.sequence(F.lit(2).cast("bigint"), "n")).alias("_")).drop("_")


def deck_issues(notes: DataFrame, media: DataFrame) -> DataFrame:
    """Of notes (id, kind, explicit_id, generated, used_override, image, masks): ids, overrides, and masks' images."""
    id_, is_mask = F.col("id"), F.col("kind") == "image_occlusion"
    known = media.select(F.col("name").alias("image")).distinct()
    unknown = notes.where(is_mask).join(known, "image", "left_anti")
    return _all([
        _found(notes, F.trim("explicit_id") == "", "BlankStableId", "error", id_),
        _found(notes, F.col("explicit_id").isNull() & F.col("generated"), "MissingStableId", "warning", id_),
        _repeated(notes, "id", "StableIdDuplicate"),
        _found(notes, F.col("used_override"), "NoteLevelIdentityOverrideUsed", "warning", id_),
        _found(unknown, F.lit(True), "UnknownMediaRef", "error", id_),
        _found(notes, is_mask & (F.col("masks") == 0), "EmptyIoMasks", "error", id_),
    ])


def project_issues(notes: DataFrame, notetypes: DataFrame, fields: DataFrame) -> DataFrame:
    """Of notes (id, notetype_id, stable_id), types (id, has_identity) and fields (notetype_id, key, auto_key)."""
    given = notes.where("stable_id IS NOT NULL AND trim(stable_id) <> ''")
    other = notes.where(~F.col("notetype_id").isin(*STOCK_IDS)).join(notetypes.select(F.col("id").alias("notetype_id")), "notetype_id", "left_anti")
    return _all([
        _found(notes, F.trim("stable_id") == "", "AFID.STABLE_ID_BLANK", "error", F.col("id")),
        _repeated(given, "stable_id", "AFID.STABLE_ID_DUPLICATE"),
        _found(other, F.lit(True), "PROJECT.UNSUPPORTED_NOTE_TYPE", "error", F.col("id")),
        _repeated(notetypes, "id", "NOTETYPE.ID_DUPLICATE"),
        _found(notetypes, ~F.col("has_identity"), "NOTETYPE.IDENTITY_RECIPE_MISSING", "warning", F.col("id")),
        _found(fields, F.col("auto_key"), "NOTETYPE.FIELD_KEY_AUTO_DERIVED", "warning", F.concat("notetype_id", F.lit("."), "key")),
    ])


def custom_type_issues(notetypes: DataFrame) -> DataFrame:
    """Of custom types (id, kind, cloze_field, field_names, fronts, rule_kinds): the rules of cloze types.

    The first rule that a type breaks is told, but of a cloze type with a known field all of the template rules.
    """
    field, fronts = F.col("cloze_field"), F.col("fronts")
    shown = F.flatten(F.transform(fronts, cloze_fields))
    cloze, known = F.col("kind") == "cloze", F.array_contains("field_names", field)
    out = lambda code: F.lit(code)
    codes = (
        F.when(
            F.col("kind") == "normal",
            F.array(F.when(field.isNotNull(), out("PRODUCT.CLOZE_FIELD_UNEXPECTED")), F.when(F.array_contains("rule_kinds", "cloze"), out("TEMPLATE.CLOZE_RULE_REQUIRES_CLOZE_NOTETYPE"))),
        )
        .when(cloze & field.isNull(), F.array(out("PRODUCT.CLOZE_FIELD_REQUIRED")))
        .when(cloze & ~known, F.array(out("PRODUCT.CLOZE_FIELD_UNKNOWN")))
        .when(
            cloze,
            F.array(
                F.when(F.size(fronts) != 1, out("PRODUCT.CLOZE_TEMPLATE_COUNT_INVALID")),
                F.when(~F.array_contains(shown, field), out("PRODUCT.CLOZE_FILTER_REQUIRED")),
                F.when(F.exists(shown, lambda f: f != field), out("PRODUCT.CLOZE_FIELD_MISMATCH")),
            ),
        )
        .otherwise(F.array(out("PRODUCT.NOTE_TYPE_KIND_UNSUPPORTED")))
    )
    return notetypes.select(F.col("id").alias("subject"), F.explode(codes).alias("code")).where("code IS NOT NULL")


def back_extra_panel(answer: Column, title: Column) -> Column:
    """The answer with a panel instead of the first plain back extra, or after its end; the markup is a fixed value."""
    panel = F.concat(F.lit('{{#Back Extra}}<div class="af-back-extra-panel"><h3>'), F.coalesce(title, F.lit("More")), F.lit("</h3>{{Back Extra}}</div>{{/Back Extra}}"))
    plain, bare = F.lit("{{#Back Extra}}<div>{{Back Extra}}</div>{{/Back Extra}}"), F.lit("{{Back Extra}}")
    return F.when(F.contains(answer, plain), replaced_first(answer, plain, panel)).when(F.contains(answer, bare), replaced_first(answer, bare, panel)).otherwise(F.concat(answer, F.lit("\n"), panel))


def helper_issue(kind: Column, helper: Column) -> Column:
    """Null if the helper may be used for the kind of note."""
    wrong = ((helper == "answer_divider") & (kind != "basic")) | ((helper == "back_extra_panel") & ~kind.isin("cloze", "image_occlusion"))
    return F.when(wrong, "PHASE5A.HELPER_SCOPE_INVALID")


def merged_note_data(existing: Column, key: str, value: Column) -> Column:
    """A JSON object with ``key`` set to JSON ``value``, keys sorted; null if it is no object (blank counts as empty)."""
    text = F.when(is_blank(existing), "{}").otherwise(existing)
    object_ = F.when(F.get_json_object(text, "$").isNotNull() & F.ltrim(text).startswith("{"), text)
    entries = F.map_entries(F.from_json(object_, "map<string, variant>"))
    kept = F.transform(F.filter(entries, lambda e: e["key"] != key), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))
    every = F.array_sort(F.concat(kept, F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))))
    return F.concat(F.lit("{"), F.array_join(F.transform(every, lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def card_evidence(observations: DataFrame, by: str) -> DataFrame:
    """(by, evidence): full, degraded or missing evidence of cards among the observations of each report."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    number = lambda name: F.get_json_object("payload", f"$.{name}").isNotNull()
    row = observations.groupBy(by).agg(has((F.col("domain") == "metadata") & number("card_count")).alias("counted"), has((F.col("domain") == "references") & F.startswith("selector", F.lit("card["))).alias("cards"), has((F.col("domain") == "templates") & number("ord")).alias("ords"))
    return row.select(by, F.when(~F.col("counted"), "missing").when(F.col("cards") & F.col("ords"), "full").otherwise("degraded").alias("evidence"))


def product_comparison_status(plain: Column, core_missing: Column, uncompared: Column, left: Column, right: Column) -> Column:
    unavailable = (plain == "unavailable") | core_missing | (left == "missing") | (right == "missing")
    partial = (plain == "partial") | (uncompared > 0) | (left == "degraded") | (right == "degraded")
    return F.when(unavailable, "unavailable").when(partial, "partial").otherwise("complete")


def report_lines(samples: DataFrame) -> DataFrame:
    """(code, line) of a readable report: count and first sources of each code, as ``normalize.samples`` gives them."""
    more = F.when(F.col("n") > F.size("sources"), F.concat(F.lit(" and "), F.col("n") - F.size("sources"), F.lit(" more"))).otherwise("")
    return samples.select("code", F.concat("code", F.lit(": "), "n", F.lit(" ("), F.array_join("sources", ", "), more, F.lit(")")).alias("line"))
