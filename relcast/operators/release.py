"""Comparing releases: diff of observations, reconciling of identities, merge safety.

An observation is a row (domain, selector, payload, evidence) of a long table. Identities are rows by stable id. All
joins are equi joins on these keys; nothing is collected or broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_guid

#: The domains that a diff covers, in order, and their hints.
DOMAINS = ("notetypes", "templates", "fields", "media", "metadata", "references")
HINTS = {
    "notetypes": "compare the stock notetype shape and fields",
    "templates": "compare the stock template render formats",
    "fields": "compare the stock field definitions",
    "media": "compare the media layout and payload metadata",
    "metadata": "compare aggregate counts and package metadata",
    "references": "compare note, card, and media-reference selectors",
}


def literal_map(values: dict[str, str], key: Column, default: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_of(domain: Column) -> Column:
    return F.when(domain == "metadata", "low").otherwise("medium")


def hint_of(domain: Column) -> Column:
    return literal_map(HINTS, domain, "compare the selected observation domain")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of greatest ``order`` for each key; one aggregate, combined before the exchange."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__row")).select(*keys, "__row.*")


def comparable(rows: DataFrame, missing: list[str], packaged: bool) -> DataFrame:
    """Observations that a diff compares: of covered domains that no side misses, with a selector.

    Media references are skipped if either side was read from a package.
    """
    kept = rows.where(F.col("domain").isin(*[d for d in DOMAINS if d not in missing]) & F.col("selector").isNotNull())
    return kept.where(~((F.col("domain") == "references") & F.startswith("selector", F.lit("media-ref[")))) if packaged else kept


def diff(left: DataFrame, right: DataFrame, missing: tuple[str, ...] = (), packaged: bool = False) -> DataFrame:
    """Changes from ``left`` to ``right``, both (domain, selector, payload, evidence, ord).

    Payloads are compared by digest, so that the join carries no long text. Of equal selectors the last counts.
    """
    sides = []
    for name, rows in (("l", left), ("r", right)):
        slim = comparable(rows, list(missing), packaged).select("domain", "selector", F.sha2(F.coalesce("payload", F.lit("")), 256).alias("digest"), "evidence", "ord")
        sides.append(last_wins(slim, ["domain", "selector"], "ord").select("domain", "selector", F.col("digest").alias(f"{name}_digest"), F.col("evidence").alias(f"{name}_evidence")))
    both = sides[0].join(sides[1], ["domain", "selector"], "full_outer")
    changed = both.where(~F.col("l_digest").eqNullSafe(F.col("r_digest")))
    category = F.when(F.col("l_digest").isNull(), "added").when(F.col("r_digest").isNull(), "removed").otherwise("modified")
    verb = F.when(F.col("category") == "modified", " changed").when(F.col("category") == "added", " was added").otherwise(" was removed")
    empty = F.array().cast("array<string>")
    return changed.withColumn("category", category).select(
        "category",
        "domain",
        severity_of(F.col("domain")).alias("severity"),
        "selector",
        F.concat("selector", verb).alias("message"),
        hint_of(F.col("domain")).alias("compatibility_hint"),
        F.array_sort(F.array_union(F.coalesce("l_evidence", empty), F.coalesce("r_evidence", empty))).alias("evidence_refs"),
    )


#: Which changes are semantic, and their risk codes.
def semantic_code(domain: Column, category: Column, selector: Column, message: Column) -> Column:
    """Null for a change without risk code. A modified template counts as reordered if its texts contain ``ord``."""
    reordered = F.contains(message, F.lit("ord")) | F.contains(selector, F.lit("ord"))
    counted = (selector == "counts") | F.contains(message, F.lit("counts"))
    return (
        F.when((domain == "templates") & (category == "removed"), "RISK.TEMPLATE_REMOVED")
        .when((domain == "templates") & (category == "modified") & reordered, "RISK.TEMPLATE_REORDER")
        .when((domain == "fields") & (category == "removed"), "RISK.FIELD_REMOVED_OR_RENAMED")
        .when((domain == "media") & (category == "removed"), "RISK.MEDIA_REMOVED")
        .when((domain == "metadata") & (category == "modified") & counted, "RISK.CARD_COUNT_CHANGED")
    )


def change_counts(changes: DataFrame, uncompared: int = 0) -> DataFrame:
    """One row: added, removed, modified, reordered, uncompared."""
    code = semantic_code(F.col("domain"), F.col("category"), F.col("selector"), F.col("message"))
    counted = [F.count_if(F.col("category") == c).alias(c) for c in ("added", "removed", "modified")]
    return changes.agg(*counted, F.count_if(code == "RISK.TEMPLATE_REORDER").alias("reordered"), F.lit(uncompared).cast("bigint").alias("uncompared"))


def observation_status(complete: Column, has_core: Column) -> Column:
    return F.when(complete & has_core, "complete").when(~has_core, "unavailable").otherwise("degraded")


def comparison_status(left: Column, right: Column, uncompared: Column) -> Column:
    """Unavailable if a side is, complete if both are, else partial; demoted if domains weren't compared."""
    plain = F.when((left == "unavailable") | (right == "unavailable"), "unavailable").when((left == "complete") & (right == "complete"), "complete").otherwise("partial")
    return F.when((plain == "complete") & (uncompared > 0), "partial").otherwise(plain)


# --- identities ---------------------------------------------------------------------------------------------------------


def reconcile(current: DataFrame, previous: DataFrame, lockfile: DataFrame) -> DataFrame:
    """A guid for each current note: the previous release's, else the lockfile's, else the derived candidate.

    ``current`` has normalized_note_id, stable_id and candidate; the others stable_id, guid and ord, of which the last
    row of a stable id counts.
    """
    before = last_wins(previous.select("stable_id", "guid", "ord"), ["stable_id"], "ord").select("stable_id", F.col("guid").alias("previous_guid"))
    locked = last_wins(lockfile.select("stable_id", "guid", "ord"), ["stable_id"], "ord").select("stable_id", F.col("guid").alias("locked_guid"))
    joined = current.join(before, "stable_id", "left").join(locked, "stable_id", "left")
    source = F.when(F.col("previous_guid").isNotNull(), "previous_package").when(F.col("locked_guid").isNotNull(), "lockfile").otherwise("current_derivation")
    chosen = joined.withColumn("selected_guid", F.coalesce("previous_guid", "locked_guid", "candidate")).withColumn("source", source)
    conflict = F.coalesce(F.col("previous_guid") != F.col("locked_guid"), F.lit(False))
    drift = (F.col("source") != "current_derivation") & (F.col("selected_guid") != F.col("candidate"))
    return chosen.select(F.coalesce("normalized_note_id", "stable_id").alias("normalized_note_id"), "stable_id", "selected_guid", "candidate", "source", conflict.alias("conflict"), drift.alias("drift"))


def reconcile_counts(assigned: DataFrame) -> DataFrame:
    derived = F.col("source") == "current_derivation"
    return assigned.agg(F.count_if(~derived).alias("preserved"), F.count_if(derived).alias("derived"), F.lit(0).cast("bigint").alias("failed"), F.count_if("conflict").alias("conflicts"))


def duplicate_guids(assigned: DataFrame) -> DataFrame:
    """Guids that more than one note selected; a release with such a guid is refused."""
    return assigned.groupBy("selected_guid").agg(F.count("*").alias("n"), F.min("stable_id").alias("first_stable_id")).where("n > 1")


def require_unique_guids(assigned: DataFrame) -> DataFrame:
    """``assigned``, failing when read if a guid was selected twice."""
    n = F.count("*").over(Window.partitionBy("selected_guid"))
    return assigned.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("UPDATE.GUID_DUPLICATE_AT_RECONCILE: "), "selected_guid"))).otherwise(F.lit(True)).cast("boolean")).drop("__n")


def carry_forward(assigned: DataFrame, lockfile: DataFrame) -> DataFrame:
    """The next lockfile: assignments, and old entries that are absent from the current notes."""
    now = assigned.select("stable_id", F.col("selected_guid").alias("guid"), "normalized_note_id", F.lit("active").alias("lifecycle"))
    gone = lockfile.join(assigned.select("stable_id"), "stable_id", "left_anti")
    return now.unionByName(gone.select("stable_id", "guid", F.lit(None).cast("string").alias("normalized_note_id"), F.lit("absent_from_current").alias("lifecycle")))


def plan_coverage(notes: DataFrame, plan: DataFrame) -> DataFrame:
    """Where a guid plan doesn't cover the notes exactly once: (note_id, issue)."""
    planned = plan.groupBy("note_id").agg(F.count("*").alias("n"))
    both = notes.select("note_id", F.lit(1).alias("there")).join(planned, "note_id", "full_outer")
    issue = F.when(F.col("n").isNull(), "missing_assignment").when(F.col("there").isNull(), "unknown_note").when(F.col("n") > 1, "duplicate_assignment")
    return both.withColumn("issue", issue).where("issue IS NOT NULL").select("note_id", "issue")


def recovered(observed: DataFrame, current: DataFrame, lockfile: DataFrame) -> DataFrame:
    """Observed notes whose guid is a stable id of the current index or the lockfile."""
    known = current.select(F.col("stable_id").alias("guid")).unionByName(lockfile.select(F.col("stable_id").alias("guid"))).distinct()
    return observed.join(known, "guid", "left_semi")


def lockfile_issues(entries: DataFrame) -> DataFrame:
    """(code, subject): entries of a lockfile that break its rules; ``entries`` has stable_id, guid, normalized_note_id and lifecycle."""
    twice = lambda key, code: entries.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(code).alias("code"), F.col(key).alias("subject"))
    differs = entries.where((F.col("lifecycle") == "active") & ~F.col("normalized_note_id").eqNullSafe(F.col("stable_id")))
    bad = entries.where(~is_guid(F.col("guid")))
    rows = twice("stable_id", "LOCKFILE.DUPLICATE_STABLE_ID").unionByName(twice("guid", "LOCKFILE.DUPLICATE_GUID"))
    rows = rows.unionByName(differs.select(F.lit("LOCKFILE.ACTIVE_ID_MISMATCH").alias("code"), F.col("stable_id").alias("subject")))
    return rows.unionByName(bad.select(F.lit("LOCKFILE.INVALID_GUID").alias("code"), F.col("stable_id").alias("subject")))


def strict_current(notes: DataFrame) -> DataFrame:
    """Notes whose ids a strict release refuses: blank or generated."""
    return notes.where((F.trim("stable_id") == "") | F.startswith("stable_id", F.lit("generated:")))


def note_identity(notes: DataFrame, assigned: DataFrame) -> DataFrame:
    """Identity of each note, with defaults where nothing was assigned."""
    joined = notes.join(assigned.select(F.col("normalized_note_id").alias("note_id"), F.col("stable_id").alias("s"), "selected_guid", F.col("source").alias("src")), "note_id", "left")
    return joined.select("note_id", F.coalesce("s", "note_id").alias("stable_id"), F.coalesce("selected_guid", "note_id").alias("guid"), F.coalesce("src", F.lit("current_derivation")).alias("guid_source"))


def embedded_identities(metadata: DataFrame) -> DataFrame:
    """Identities in the note data of an earlier package: ``metadata`` has source_path and payload (JSON).

    Rows of another schema are left out. One without a stable id gives no identity but a limitation, as does an unknown
    provenance; other values that are missing have defaults.
    """
    get = lambda name, default=None: F.coalesce(F.get_json_object("payload", f"$.{name}"), F.lit(default) if isinstance(default, str) or default is None else default)
    rows = metadata.where(get("schema_version") == "identity-note-v1").withColumn("stable_id", get("stable_id"))
    lost = F.col("stable_id").isNull()
    provenance = get("provenance", "unknown_baseline")
    limit = F.when(lost, "identity_metadata_malformed").when(provenance == "unknown_baseline", "unknown_baseline_provenance")
    return rows.select(
        "source_path",
        "stable_id",
        get("selected_anki_guid", F.col("stable_id")).alias("guid"),
        get("current_guid_candidate", F.col("stable_id")).alias("candidate"),
        get("guid_derivation_version", "guid.raw-stable-id.v1").alias("derivation"),
        get("recipe_id", "unknown").alias("recipe_id"),
        get("canonical_payload_hash").alias("payload_hash"),
        provenance.alias("provenance"),
        F.coalesce(get("used_override") == "true", F.lit(False)).alias("used_override"),
        limit.alias("limitation"),
    )


def limitations(rows: DataFrame, by: str, name: str) -> DataFrame:
    """(by, limitations): what limits each baseline, sorted and without repeats."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(name)).alias("limitations"))


def effective_mode(mode: Column, lockfile: Column, compare_to: Column, writes_lockfile: Column) -> Column:
    """struct(mode, code): the mode that build options ask for; writing a lockfile needs its path.

    A mode that isn't given (null) is strict if there is a lockfile or a release to compare to, or else disabled.
    """
    refused = F.coalesce(writes_lockfile, F.lit(False)) & lockfile.isNull()
    chosen = F.coalesce(mode, F.when(lockfile.isNotNull() | compare_to.isNotNull(), "strict").otherwise("disabled"))
    return F.struct(F.when(~refused, chosen).alias("mode"), F.when(refused, "UPDATE.LOCKFILE_PATH_REQUIRED").alias("code"))


def missing_project_id(lockfile_required: Column) -> Column:
    """struct(limitation, code, severity) of a release whose project has no stable id."""
    severity = F.when(lockfile_required, "error").otherwise("warning")
    return F.struct(F.lit("project_stable_id_missing").alias("limitation"), F.lit("UPDATE.PROJECT_STABLE_ID_MISSING").alias("code"), severity.alias("severity"))


def inspected_source(staging: Column, staging_there: Column, package: Column, package_there: Column) -> Column:
    """struct(kind, ref): what of a build result is inspected: what is there, staging first; else what is named; null if nothing is."""
    out = lambda kind, ref: F.struct(F.lit(kind).alias("kind"), ref.alias("ref"))
    named = F.when(staging.isNotNull(), out("staging", staging)).when(package.isNotNull(), out("package", package))
    return F.when(staging.isNotNull() & staging_there, out("staging", staging)).when(package.isNotNull() & package_there, out("package", package)).otherwise(named)


# --- merge safety ---------------------------------------------------------------------------------------------------------


def merge_safety(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(code, severity, source, message): changes of record types that endanger merging into an existing collection.

    Both have type_id, type_name and ``parts``, an array of structs (kind ``field`` or ``template``, key, name, ord,
    config_id). Added and removed fields are no finding, templates are.
    """
    c, b = (df.select("type_id", F.col("type_name").alias(f"{p}_name"), F.col("parts").alias(f"{p}_parts")) for p, df in (("c", current), ("b", baseline)))
    types = c.join(b, "type_id", "full_outer")

    def out(code: str, message: str, severity: str = "warning", source: Column | None = None) -> Column:
        return F.struct(F.lit(f"UPDATE.{code}").alias("code"), F.lit(severity).alias("severity"), (F.col("type_id") if source is None else source).alias("source"), F.lit(message).alias("message"))

    whole = F.when(F.col("b_name").isNull(), out("NOTETYPE_SET_CHANGED", "change_kind=added; notetype was added")).when(F.col("c_name").isNull(), out("NOTETYPE_SET_CHANGED", "change_kind=removed; notetype was removed")).when(F.col("c_name") != F.col("b_name"), out("NOTETYPE_RENAMED", "notetype name changed"))
    found = types.select(whole.alias("f")).where("f IS NOT NULL").select("f.*")
    kept = types.where("c_name IS NOT NULL AND b_name IS NOT NULL")
    sides = [kept.select("type_id", F.inline(f"{p}_parts")).select("type_id", "kind", "key", *[F.col(x).alias(f"{p}_{x}") for x in ("name", "ord", "config_id")]) for p in "cb"]
    parts = sides[0].join(sides[1], ["type_id", "kind", "key"], "full_outer")
    both = F.col("c_name").isNotNull() & F.col("b_name").isNotNull()
    same_id = F.col("c_config_id").eqNullSafe(F.col("b_config_id"))
    is_field, is_template = F.col("kind") == "field", F.col("kind") == "template"
    spot = F.concat(F.lit("notetype[id='"), "type_id", F.lit("']::template["), "c_name", F.lit("]"))
    issues = F.array(
        F.when(is_template & F.col("b_name").isNull(), out("TEMPLATE_SET_CHANGED", "change_kind=added; template was added")),
        F.when(is_template & F.col("c_name").isNull(), out("TEMPLATE_SET_CHANGED", "change_kind=removed; template was removed")),
        F.when(both & is_field & ~same_id, out("FIELD_MERGE_ID_CHANGED", "field config id changed", "error")),
        F.when(both & is_field & same_id & (F.col("c_name") != F.col("b_name")), out("FIELD_RENAMED", "field name changed")),
        F.when(both & is_field & same_id & (F.col("c_ord") != F.col("b_ord")), out("FIELD_ORD_CHANGED", "field ord changed")),
        F.when(both & is_template & ~same_id, out("TEMPLATE_MERGE_ID_CHANGED", "template config id changed", "error")),
        F.when(both & is_template & same_id & (F.col("c_name") != F.col("b_name")), out("TEMPLATE_RENAMED", "template name changed")),
        F.when(both & is_template & same_id & (F.col("c_ord") != F.col("b_ord")), out("TEMPLATE_ORD_CHANGED", "template ord changed", source=spot)),
    )
    return found.unionByName(parts.select(F.inline(F.filter(issues, lambda x: x.isNotNull()))))


def regrouped(parts: DataFrame) -> DataFrame:
    """Parts of record types, gathered under their type in order."""
    return parts.groupBy("type_id").agg(F.array_sort(F.collect_list(F.struct("kind", "ord", "key", "name", "config_id"))).alias("parts"))
