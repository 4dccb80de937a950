"""Import risk: findings from diagnostics and semantic changes, the highest level, and the policy's gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .release import literal_map, semantic_code

#: Levels in order, levels and categories of codes, and what to do.
LEVELS = ("Info", "Low", "Medium", "High", "Critical")
LEVEL_OF = {
    "RISK.TEMPLATE_REMOVED": "Critical",
    "RISK.TEMPLATE_REORDER": "High",
    "RISK.FIELD_REMOVED_OR_RENAMED": "Medium",
    "RISK.CARD_COUNT_CHANGED": "Medium",
    "RISK.MEDIA_REMOVED": "Medium",
    "RISK.NOTE_GUID_DRIFT": "High",
    "RISK.NOTETYPE_CONFIG_ID_DRIFT": "High",
    "RISK.MEDIA_REFERENCE_BROKEN": "High",
    "RISK.BASELINE_UNAVAILABLE": "High",
}
CATEGORY_OF = {
    "RISK.TEMPLATE_REMOVED": "template",
    "RISK.TEMPLATE_REORDER": "template",
    "RISK.FIELD_REMOVED_OR_RENAMED": "field",
    "RISK.CARD_COUNT_CHANGED": "card_count",
    "RISK.MEDIA_REMOVED": "media",
    "RISK.NOTE_GUID_DRIFT": "identity",
    "RISK.NOTETYPE_CONFIG_ID_DRIFT": "notetype",
    "RISK.MEDIA_REFERENCE_BROKEN": "media",
    "RISK.BASELINE_UNAVAILABLE": "baseline",
}
ACTION_OF = {
    "RISK.TEMPLATE_REMOVED": "restore the template or document the card migration",
    "RISK.TEMPLATE_REORDER": "preserve template keys and ordinals for existing cards",
    "RISK.FIELD_REMOVED_OR_RENAMED": "preserve the field key/config id or confirm the migration",
    "RISK.CARD_COUNT_CHANGED": "review expected card generation changes before importing",
    "RISK.MEDIA_REMOVED": "restore removed media or verify no notes reference it",
}
CODE_OF_DIAGNOSTIC = {
    "MEDIA.MISSING_REFERENCE": "RISK.MEDIA_REFERENCE_BROKEN",
    "MEDIA.UNSAFE_REFERENCE": "RISK.MEDIA_REFERENCE_BROKEN",
    "UPDATE.GUID_DERIVATION_DRIFT": "RISK.NOTE_GUID_DRIFT",
    "UPDATE.BASELINE_CONFLICT_GUID": "RISK.NOTE_GUID_DRIFT",
    "UPDATE.GUID_DUPLICATE_AT_RECONCILE": "RISK.NOTE_GUID_DRIFT",
    "UPDATE.GUID_DUPLICATE_IN_BASELINE": "RISK.NOTE_GUID_DRIFT",
    "UPDATE.TEMPLATE_ORD_CHANGED": "RISK.TEMPLATE_REORDER",
    "UPDATE.FIELD_MERGE_ID_CHANGED": "RISK.NOTETYPE_CONFIG_ID_DRIFT",
    "UPDATE.TEMPLATE_MERGE_ID_CHANGED": "RISK.NOTETYPE_CONFIG_ID_DRIFT",
    "UPDATE.FIELD_ORD_CHANGED": "RISK.NOTETYPE_CONFIG_ID_DRIFT",
    "UPDATE.NOTETYPE_SET_CHANGED": "RISK.NOTETYPE_CONFIG_ID_DRIFT",
    "UPDATE.TEMPLATE_SET_CHANGED": "RISK.NOTETYPE_CONFIG_ID_DRIFT",
}


def rank(level: Column) -> Column:
    """Place of a level in the order, from 0; levels are compared by it, never by name."""
    return (F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1).cast("int")


def level_at(place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), place + 1)


def diagnostic_findings(diagnostics: DataFrame) -> DataFrame:
    """Findings of diagnostics (code, level, source); broken media count only as errors."""
    code = literal_map(CODE_OF_DIAGNOSTIC, F.col("code"))
    rows = diagnostics.where(~F.col("code").isin("MEDIA.MISSING_REFERENCE", "MEDIA.UNSAFE_REFERENCE") | (F.col("level") == "error"))
    return rows.select(code.alias("code"), F.concat(F.lit("diagnostic:"), "code").alias("evidence"), "source").where("code IS NOT NULL")


def findings(changes: DataFrame, diagnostics: DataFrame | None = None, unavailable: bool = False) -> DataFrame:
    """(code, level, category, source, evidence, suggested_action) of a comparison.

    A changed card count is High where a template was removed. A reordered template of which a diagnostic tells already
    is one finding, with both as evidence.
    """
    code = semantic_code(F.col("domain"), F.col("category"), F.col("selector"), F.col("message"))
    semantic = changes.select(code.alias("code"), F.concat(F.lit("semantic:"), "selector").alias("evidence"), F.col("selector").alias("source")).where("code IS NOT NULL")
    rows = semantic
    if diagnostics is not None:
        told = diagnostic_findings(diagnostics)
        rows = told.unionByName(semantic)
    merged = F.when(F.col("code") == "RISK.TEMPLATE_REORDER", F.col("source")).otherwise(F.col("evidence"))
    grouped = rows.groupBy("code", "source", merged.alias("__k")).agg(F.array_sort(F.collect_set("evidence")).alias("evidence"))
    removed = grouped.agg(F.coalesce(F.bool_or(F.col("code") == "RISK.TEMPLATE_REMOVED"), F.lit(False)).alias("__removed"))
    full = grouped.join(F.broadcast(removed))
    raised = F.col("__removed") & (F.col("code") == "RISK.CARD_COUNT_CHANGED")
    out = full.select(
        "code",
        F.when(raised, "High").otherwise(literal_map(LEVEL_OF, F.col("code"), "Low")).alias("level"),
        literal_map(CATEGORY_OF, F.col("code")).alias("category"),
        "source",
        F.when(raised, F.array_append("evidence", F.lit("linked:RISK.TEMPLATE_REMOVED"))).otherwise(F.col("evidence")).alias("evidence"),
        literal_map(ACTION_OF, F.col("code")).alias("suggested_action"),
    )
    if unavailable:
        missing = changes.sparkSession.range(1).select(F.lit("RISK.BASELINE_UNAVAILABLE").alias("code"), F.lit("High").alias("level"), F.lit("baseline").alias("category"), F.lit(None).cast("string").alias("source"), F.array(F.lit("baseline")).alias("evidence"), F.lit("verify the previous package path and rebuild with a readable baseline").alias("suggested_action"))
        out = out.unionByName(missing)
    return out


def with_residual(found: DataFrame, changes: DataFrame) -> DataFrame:
    """``found``, or one Low finding where there are changes but no finding."""
    n, m = found.agg(F.count("*").alias("n")), changes.agg(F.count("*").alias("m"))
    residual = n.join(F.broadcast(m)).where("n = 0 AND m > 0").select(F.lit("RISK.ARTIFACT_DIFF").alias("code"), F.lit("Low").alias("level"))
    return found.select("code", "level").unionByName(residual)


def highest(found: DataFrame) -> DataFrame:
    """One row: highest_level (null without findings) and the number of findings."""
    return found.agg(level_at(F.max(rank(F.col("level")))).alias("highest_level"), F.count("*").alias("findings"))


def gate(found: DataFrame, threshold: str | None) -> DataFrame:
    """One row: status, threshold, highest_risk and the blocking codes, distinct and sorted."""
    if threshold is None:
        return highest(found).select(F.lit("not_evaluated").alias("status"), F.lit(None).cast("string").alias("threshold"), F.col("highest_level").alias("highest_risk"), F.array().cast("array<string>").alias("blocking"))
    at_least = rank(F.col("level")) >= LEVELS.index(threshold)
    row = found.agg(F.max(rank(F.col("level"))).alias("top"), F.array_sort(F.collect_set(F.when(at_least, F.col("code")))).alias("blocking"))
    blocked = F.coalesce(F.col("top") >= LEVELS.index(threshold), F.lit(False))
    return row.select(F.when(blocked, "blocked").otherwise("passed").alias("status"), F.lit(threshold).alias("threshold"), level_at(F.col("top")).alias("highest_risk"), "blocking")


def overall_status(*statuses: Column) -> Column:
    """The worst of success, blocked, invalid and error."""
    order = ("success", "blocked", "invalid", "error")
    place = F.greatest(*[F.array_position(F.array(*[F.lit(o) for o in order]), s).cast("int") for s in statuses], F.lit(0))
    return F.element_at(F.array(*[F.lit(o) for o in order]), place)
