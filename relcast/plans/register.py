"""The registered queries, each an operator over derived frames, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import udfs
from ..operators import cards, collection, identity, media, normalize, observe, release, risk, selectors, validate
from ..sources import store
from . import frames
from .frames import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Frames of the twins, as common table expressions.
CTES = {
    "cur": "SELECT 'doc:' || doc_id AS id, doc_id, lang || '::' || source AS deck, lang, source, CASE WHEN doc_id % 7 = 0 THEN text || ' v2' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0",
    "prev": "SELECT 'doc:' || doc_id AS id, doc_id, lang || '::' || source AS deck, lang, source, text FROM documents WHERE doc_id % 11 <> 0",
    "lock": "SELECT 'doc:' || doc_id AS id, doc_id, 'lock-' || doc_id AS guid FROM documents WHERE doc_id % 3 = 0",
    "obs": """SELECT coalesce(c.id, p.id) AS id, CASE WHEN p.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' ELSE 'modified' END AS category
      FROM cur c FULL JOIN prev p ON c.id = p.id WHERE p.id IS NULL OR c.id IS NULL OR c.text IS DISTINCT FROM p.text OR c.deck IS DISTINCT FROM p.deck""",
    "assigned": """SELECT c.id AS stable_id, coalesce('prev-' || p.doc_id, l.guid, 'cand-' || c.doc_id) AS selected_guid, 'cand-' || c.doc_id AS candidate,
      CASE WHEN p.id IS NOT NULL THEN 'previous_package' WHEN l.id IS NOT NULL THEN 'lockfile' ELSE 'current_derivation' END AS source,
      p.id IS NOT NULL AND l.id IS NOT NULL AS conflict, p.id IS NOT NULL OR l.id IS NOT NULL AS drift
      FROM cur c LEFT JOIN prev p ON p.id = c.id LEFT JOIN lock l ON l.id = c.id""",
    "cloze": """SELECT 'part:' || p_partkey AS id, p_partkey AS ord, p_size, p_type, CASE WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 3 = 0 THEN '{{c1::' || p_name || '}} by {{c2::' || p_brand || '}} and {{c1::' || p_type || '}}'
      ELSE '{{c1::' || p_name || '}} by {{c2::' || p_brand || '}}' END AS text FROM part""",
    "refs": """SELECT 'part:' || p_partkey AS owner_id, 'html_src' AS ref_kind, CASE WHEN p_partkey % 4 = 0 THEN 'https://example.com/' || replace(p_name, ' ', '_') || '.png' WHEN p_partkey % 5 = 0 THEN 'my ' || replace(p_name, ' ', '_') || '.png' ELSE replace(p_name, ' ', '_') || '.png' END AS raw_ref FROM part
      UNION ALL SELECT 'part:' || p_partkey, 'sound', 'part' || p_partkey || '.mp3' FROM part WHERE p_partkey % 3 = 0""",
    "bound": "SELECT replace(p_name, ' ', '_') || '.png' AS export_filename, 'media:' || min(p_partkey) AS id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1",
    "resolved": """SELECT r.*, CASE WHEN raw_ref LIKE 'https:%' THEN 'skipped' WHEN NOT regexp_full_match(raw_ref, '[A-Za-z0-9._-]*') THEN 'skipped' WHEN b.id IS NOT NULL THEN 'resolved' ELSE 'missing' END AS resolution_status,
      CASE WHEN raw_ref NOT LIKE 'https:%' AND regexp_full_match(raw_ref, '[A-Za-z0-9._-]*') THEN b.id END AS media_id,
      CASE WHEN raw_ref LIKE 'https:%' THEN 'external-url' WHEN NOT regexp_full_match(raw_ref, '[A-Za-z0-9._-]*') THEN 'helper-unsafe-character' END AS skip_reason
      FROM refs r LEFT JOIN bound b ON b.export_filename = r.raw_ref""",
    "media": "SELECT doc_id AS ord, CASE WHEN doc_id % 25 = 0 THEN 'shared' || (doc_id % 40) ELSE 'doc' || doc_id END || '.txt' AS filename, sha1(coalesce(text, '')) AS digest, strlen(coalesce(text, ''))::BIGINT AS size, lang, source FROM documents",
    "diag": "SELECT event_id AS ord, CASE user_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS level, 'UPDATE.' || upper(event_type) AS code, 'user ' || (user_id % 20) AS summary, '/users/' || (user_id % 20) AS path, 'event:' || event_id AS source FROM events",
    "types": """SELECT 'type:' || p_partkey AS type_id, p_partkey AS k, p_partkey % 17 <> 0 AS c, p_partkey % 19 <> 0 AS b FROM part""",
}


def query(sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query, with its twin over the named frames."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = ("WITH " + ", ".join(f"{name} AS ({CTES[name]})" for name in uses) + " " if uses else "") + sql
        return f

    return add


def joined(c: Column | str) -> Column:
    return F.array_join(c, ",")


# --- comparing releases -------------------------------------------------------------------------------------------------


def changes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return release.diff(observe.note_observations(frames.notes(docs, False)), observe.note_observations(frames.notes(docs, True)))


@query(
    """SELECT category, 'references' AS domain, 'medium' AS severity, 'note[id=''' || id || ''']' AS selector,
    'note[id=''' || id || ''']' || CASE category WHEN 'modified' THEN ' changed' WHEN 'added' THEN ' was added' ELSE ' was removed' END AS message,
    'compare note, card, and media-reference selectors' AS compatibility_hint, 'note:' || id AS evidence_refs FROM obs""",
    ("cur", "prev", "obs"),
)
def release_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_of(spark, sf_dir).withColumn("evidence_refs", joined("evidence_refs"))


@query("SELECT count(*) FILTER (category = 'added') AS added, count(*) FILTER (category = 'removed') AS removed, count(*) FILTER (category = 'modified') AS modified, 0::BIGINT AS reordered, 0::BIGINT AS uncompared FROM obs", ("cur", "prev", "obs"))
def release_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.change_counts(changes_of(spark, sf_dir))


@query(
    """SELECT source, l, r, CASE WHEN 'unavailable' IN (l, r) THEN 'unavailable' WHEN l = 'complete' AND r = 'complete' THEN CASE WHEN missing > 0 THEN 'partial' ELSE 'complete' END ELSE 'partial' END AS status FROM (
      SELECT source, CASE WHEN count(*) FILTER (doc_id % 2 = 0) = 0 THEN 'unavailable' WHEN bool_and(quality IS NOT NULL) FILTER (doc_id % 2 = 0) THEN 'complete' ELSE 'degraded' END AS l,
        CASE WHEN count(*) FILTER (doc_id % 2 = 1) = 0 THEN 'unavailable' WHEN bool_and(lang IS NOT NULL) FILTER (doc_id % 2 = 1) THEN 'complete' ELSE 'degraded' END AS r, count(*) FILTER (lang IS NULL) AS missing
      FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)"""
)
def diff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    even, odd = F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1
    sides = rows.groupBy("source").agg(
        F.coalesce(F.bool_and(F.when(even, F.col("quality").isNotNull())), F.lit(True)).alias("l_all"), (F.count_if(even) > 0).alias("l_core"),
        F.coalesce(F.bool_and(F.when(odd, F.col("lang").isNotNull())), F.lit(True)).alias("r_all"), (F.count_if(odd) > 0).alias("r_core"), F.count_if(F.col("lang").isNull()).alias("missing"),
    )
    status = sides.select("source", release.observation_status(F.col("l_all"), F.col("l_core")).alias("l"), release.observation_status(F.col("r_all"), F.col("r_core")).alias("r"), "missing")
    return status.select("source", "l", "r", release.comparison_status(F.col("l"), F.col("r"), F.col("missing")).alias("status"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return release.reconcile(frames.current_index(docs), frames.previous_index(docs), frames.lockfile(docs))


RECONCILED = ("cur", "prev", "lock", "assigned")


@query("SELECT stable_id AS normalized_note_id, * FROM assigned", RECONCILED)
def guid_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir)


@query("SELECT count(*) FILTER (source <> 'current_derivation') AS preserved, count(*) FILTER (source = 'current_derivation') AS derived, 0::BIGINT AS failed, count(*) FILTER (conflict) AS conflicts FROM assigned", RECONCILED)
def guid_reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.reconcile_counts(assigned(spark, sf_dir))


@query("SELECT stable_id, selected_guid AS guid, stable_id AS normalized_note_id, 'active' AS lifecycle FROM assigned UNION ALL SELECT id, guid, NULL, 'absent_from_current' FROM lock WHERE id NOT IN (SELECT id FROM cur)", RECONCILED)
def lockfile_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.carry_forward(assigned(spark, sf_dir), frames.lockfile(table(spark, sf_dir, "documents")))


@query("SELECT sha1(text) AS selected_guid, count(*) AS n, min('doc:' || doc_id) AS first_stable_id FROM documents GROUP BY text HAVING count(*) > 1")
def guid_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.duplicate_guids(table(spark, sf_dir, "documents").select(frames.doc_id().alias("stable_id"), F.sha1("text").alias("selected_guid")))


@query(
    """SELECT coalesce(n.id, p.id) AS note_id, CASE WHEN p.n IS NULL THEN 'missing_assignment' WHEN n.id IS NULL THEN 'unknown_note' ELSE 'duplicate_assignment' END AS issue
    FROM cur n FULL JOIN (SELECT id, count(*) AS n FROM (SELECT id FROM prev UNION ALL SELECT id FROM prev WHERE doc_id % 13 = 0) GROUP BY id) p ON p.id = n.id WHERE p.n IS NULL OR n.id IS NULL OR p.n > 1""",
    ("cur", "prev"),
)
def guid_plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planned = frames.notes(docs, False).select(F.col("id").alias("note_id"), "doc_id")
    planned = planned.unionByName(planned.where("doc_id % 13 = 0"))
    return release.plan_coverage(frames.notes(docs, True).select(F.col("id").alias("note_id")), planned)


@query("SELECT item_id, 'doc:' || item_id AS guid FROM benchmark WHERE 'doc:' || item_id IN (SELECT id FROM cur UNION SELECT id FROM lock)", ("cur", "lock"))
def baseline_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    observed = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("doc:"), "item_id").alias("guid"))
    return release.recovered(observed, frames.current_index(docs), frames.lockfile(docs))


@query("SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def index_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return release.last_wins(rows, ["conv_id"], "turn").select("conv_id", "role", "text")


@query(
    """SELECT 'LOCKFILE.DUPLICATE_GUID' AS code, sha1(text) AS subject FROM documents GROUP BY text HAVING count(*) > 1
    UNION ALL SELECT 'LOCKFILE.ACTIVE_ID_MISMATCH', 'doc:' || doc_id FROM documents WHERE doc_id % 29 = 0
    UNION ALL SELECT 'LOCKFILE.INVALID_GUID', 'doc:' || doc_id FROM documents WHERE text IS NULL"""
)
def lockfile_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shown = F.when(F.col("doc_id") % 29 == 0, F.lit("other")).otherwise(frames.doc_id())
    return release.lockfile_issues(docs.select(frames.doc_id().alias("stable_id"), F.coalesce(F.sha1("text"), F.lit("")).alias("guid"), shown.alias("normalized_note_id"), F.lit("active").alias("lifecycle")))


@query("SELECT 'generated:' || doc_id AS stable_id FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT ' ' FROM documents WHERE doc_id % 9 = 1")
def strict_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("generated:"), "doc_id")).when(F.col("doc_id") % 9 == 1, " ").otherwise(frames.doc_id())
    return release.strict_current(docs.select(ids.alias("stable_id")))


@query("SELECT n.id AS note_id, coalesce(a.stable_id, n.id) AS stable_id, coalesce(selected_guid, n.id) AS guid, coalesce(a.source, 'current_derivation') AS guid_source FROM (SELECT 'doc:' || doc_id AS id FROM documents) n LEFT JOIN assigned a ON a.stable_id = n.id", RECONCILED)
def note_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.note_identity(table(spark, sf_dir, "documents").select(frames.doc_id().alias("note_id")), assigned(spark, sf_dir))


@query(
    """SELECT 'UPDATE.NOTETYPE_SET_CHANGED' AS code, 'warning' AS severity, type_id AS source, 'change_kind=added; notetype was added' AS message FROM types WHERE c AND NOT b
    UNION ALL SELECT 'UPDATE.NOTETYPE_SET_CHANGED', 'warning', type_id, 'change_kind=removed; notetype was removed' FROM types WHERE b AND NOT c
    UNION ALL SELECT 'UPDATE.NOTETYPE_RENAMED', 'warning', type_id, 'notetype name changed' FROM types WHERE b AND c AND k % 7 = 0
    UNION ALL SELECT 'UPDATE.TEMPLATE_SET_CHANGED', 'warning', type_id, 'change_kind=added; template was added' FROM types WHERE b AND c AND k % 8 = 0 AND k % 9 <> 0
    UNION ALL SELECT 'UPDATE.TEMPLATE_SET_CHANGED', 'warning', type_id, 'change_kind=removed; template was removed' FROM types WHERE b AND c AND k % 9 = 0 AND k % 8 <> 0
    UNION ALL SELECT 'UPDATE.FIELD_MERGE_ID_CHANGED', 'error', type_id, 'field config id changed' FROM types WHERE b AND c AND k % 13 = 0
    UNION ALL SELECT 'UPDATE.FIELD_RENAMED', 'warning', type_id, 'field name changed' FROM types WHERE b AND c AND k % 13 <> 0 AND k % 5 = 0
    UNION ALL SELECT 'UPDATE.FIELD_ORD_CHANGED', 'warning', type_id, 'field ord changed' FROM types WHERE b AND c AND k % 13 <> 0 AND k % 11 = 0
    UNION ALL SELECT 'UPDATE.TEMPLATE_MERGE_ID_CHANGED', 'error', type_id, 'template config id changed' FROM types WHERE b AND c AND k % 14 = 0
    UNION ALL SELECT 'UPDATE.TEMPLATE_RENAMED', 'warning', type_id, 'template name changed' FROM types WHERE b AND c AND k % 14 <> 0 AND k % 6 = 0
    UNION ALL SELECT 'UPDATE.TEMPLATE_ORD_CHANGED', 'warning', 'notetype[id=''' || type_id || ''']::template[' || CASE WHEN k % 6 = 0 THEN 'Karte' ELSE 'Card' END || ']', 'template ord changed' FROM types WHERE b AND c AND k % 14 <> 0 AND k % 10 = 0""",
    ("types",),
)
def merge_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return release.merge_safety(frames.type_parts(part, True), frames.type_parts(part, False))


@query(
    """SELECT type_id, 'field,' || CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END || ',front;template,' || CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END || ',card' || CASE WHEN k % 8 = 0 THEN ';template,1,extra' ELSE '' END AS parts FROM types WHERE c""",
    ("types",),
)
def parts_regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = frames.type_parts(table(spark, sf_dir, "part"), True).select("type_id", F.inline("parts"))
    return release.regrouped(opened).select("type_id", F.array_join(F.transform("parts", lambda p: F.concat_ws(",", p["kind"], p["ord"].cast("string"), p["key"])), ";").alias("parts"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name ELSE 'field:config:' || (p_size % 4) END AS merge_key FROM part")
def merge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.merge_key("field", F.col("p_name"), F.col("p_size") % 4).alias("merge_key"))


@query("SELECT coalesce(a.k, b.k) AS p_partkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.e, []), coalesce(b.e, [])))), ',') AS evidence FROM (SELECT p_partkey AS k, ['part:' || p_brand, 'type:' || p_type] AS e FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey AS k, ['part:' || p_brand, 'size:' || p_size] AS e FROM part WHERE p_partkey % 4 <> 0) b ON a.k = b.k")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    left = part.where("p_partkey % 3 <> 0").select("p_partkey", F.array(F.concat(F.lit("part:"), "p_brand"), F.concat(F.lit("type:"), "p_type")).alias("a"))
    right = part.where("p_partkey % 4 <> 0").select("p_partkey", F.array(F.concat(F.lit("part:"), "p_brand"), F.concat(F.lit("size:"), "p_size")).alias("b"))
    empty = F.array().cast("array<string>")
    return left.join(right, "p_partkey", "full_outer").select("p_partkey", joined(F.array_sort(F.array_union(F.coalesce("a", empty), F.coalesce("b", empty)))).alias("evidence"))


# --- risk ------------------------------------------------------------------------------------------------------------------


def type_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of templates, media and counts, from parts and documents."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    domain = F.when(key % 4 == 0, "templates").when(key % 4 == 1, "fields").when(key % 4 == 2, "media").otherwise("metadata")
    category = F.when(key % 3 == 0, "removed").when(key % 3 == 1, "modified").otherwise("added")
    selector = F.when(key % 4 == 3, "counts").otherwise(F.concat(domain, F.lit(":"), F.when(key % 5 == 0, "ord").otherwise("x"), key))
    rows = part.select(domain.alias("domain"), category.alias("category"), selector.alias("selector"))
    return rows.withColumn("message", F.concat("selector", F.lit(" changed"))).distinct()


CTES["chg"] = """SELECT DISTINCT domain, category, CASE WHEN domain = 'metadata' THEN 'counts' ELSE domain || ':' || CASE WHEN k % 5 = 0 THEN 'ord' ELSE 'x' END || k END AS selector FROM (
  SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'templates' WHEN 1 THEN 'fields' WHEN 2 THEN 'media' ELSE 'metadata' END AS domain, CASE p_partkey % 3 WHEN 0 THEN 'removed' WHEN 1 THEN 'modified' ELSE 'added' END AS category FROM part)"""
CTES["found"] = """SELECT * FROM (SELECT CASE WHEN domain = 'templates' AND category = 'removed' THEN 'RISK.TEMPLATE_REMOVED' WHEN domain = 'templates' AND category = 'modified' AND contains(selector, 'ord') THEN 'RISK.TEMPLATE_REORDER'
  WHEN domain = 'fields' AND category = 'removed' THEN 'RISK.FIELD_REMOVED_OR_RENAMED' WHEN domain = 'media' AND category = 'removed' THEN 'RISK.MEDIA_REMOVED' WHEN domain = 'metadata' AND category = 'modified' THEN 'RISK.CARD_COUNT_CHANGED' END AS code, selector FROM chg) WHERE code IS NOT NULL"""
CTES["leveled"] = """SELECT *, CASE code WHEN 'RISK.TEMPLATE_REMOVED' THEN 'Critical' WHEN 'RISK.TEMPLATE_REORDER' THEN 'High' WHEN 'RISK.CARD_COUNT_CHANGED' THEN CASE WHEN (SELECT count(*) FROM found WHERE code = 'RISK.TEMPLATE_REMOVED') > 0 THEN 'High' ELSE 'Medium' END ELSE 'Medium' END AS level FROM found"""
RISKS = ("chg", "found", "leveled")


@query(
    """SELECT code, level, CASE code WHEN 'RISK.FIELD_REMOVED_OR_RENAMED' THEN 'field' WHEN 'RISK.MEDIA_REMOVED' THEN 'media' WHEN 'RISK.CARD_COUNT_CHANGED' THEN 'card_count' ELSE 'template' END AS category, selector AS source,
    'semantic:' || selector || CASE WHEN code = 'RISK.CARD_COUNT_CHANGED' AND level = 'High' THEN ',linked:RISK.TEMPLATE_REMOVED' ELSE '' END AS evidence,
    CASE code WHEN 'RISK.TEMPLATE_REMOVED' THEN 'restore the template or document the card migration' WHEN 'RISK.TEMPLATE_REORDER' THEN 'preserve template keys and ordinals for existing cards' WHEN 'RISK.FIELD_REMOVED_OR_RENAMED' THEN 'preserve the field key/config id or confirm the migration'
      WHEN 'RISK.CARD_COUNT_CHANGED' THEN 'review expected card generation changes before importing' ELSE 'restore removed media or verify no notes reference it' END AS suggested_action FROM leveled""",
    RISKS,
)
def risk_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.findings(type_changes(spark, sf_dir)).withColumn("evidence", joined("evidence"))


@query("SELECT arg_max(level, list_position(['Info', 'Low', 'Medium', 'High', 'Critical'], level)) AS highest_level, count(*) AS findings FROM leveled", RISKS)
def risk_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.highest(risk.findings(type_changes(spark, sf_dir)))


@query("SELECT CASE WHEN count(*) FILTER (level IN ('High', 'Critical')) > 0 THEN 'blocked' ELSE 'passed' END AS status, 'High' AS threshold, arg_max(level, list_position(['Info', 'Low', 'Medium', 'High', 'Critical'], level)) AS highest_risk, array_to_string(list_sort(list_distinct(list(code) FILTER (level IN ('High', 'Critical')))), ',') AS blocking FROM leveled", RISKS)
def policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.gate(risk.findings(type_changes(spark, sf_dir)), "High").withColumn("blocking", joined("blocking"))


@query("SELECT 'RISK.ARTIFACT_DIFF' AS code, 'Low' AS level FROM obs HAVING count(*) > 0", ("cur", "prev", "obs"))
def risk_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = changes_of(spark, sf_dir)
    return risk.with_residual(risk.findings(changes), changes)


@query("SELECT doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'unavailable' WHEN toxic = 1 THEN 'partial' ELSE 'complete' END AS comparison_status, CASE WHEN quality = 0 AND toxic = 0 THEN 'high' WHEN toxic = 1 THEN 'medium' ELSE 'low' END AS overall_level FROM labels")
def normalize_merge_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    found = normalize.merge_risk(F.col("quality") == 0, F.when(F.col("toxic") == 1, "ref").otherwise(""), F.when(F.col("toxic") == 1, "identity_index").otherwise("package"))
    return labels.select("doc_id", found.alias("r")).select("doc_id", "r.*")


@query("SELECT code, level, count(*) AS n FROM (SELECT code, CASE WHEN level = 'error' AND ord % 2 = 0 THEN 'warning' ELSE level END AS level FROM diag) GROUP BY ALL", ("diag",))
def downgraded_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.diagnostics(table(spark, sf_dir, "events"))
    return rows.select("code", normalize.downgraded(F.col("level"), F.col("code"), F.col("ord") % 2 == 0).alias("level")).groupBy("code", "level").agg(F.count("*").alias("n"))


@query("SELECT user_id, CASE max(r) WHEN 4 THEN 'error' WHEN 3 THEN 'invalid' WHEN 2 THEN 'blocked' ELSE 'success' END AS status FROM (SELECT user_id, 1 + event_id % 4 AS r FROM events) GROUP BY user_id")
def build_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array(*[F.lit(s) for s in ("success", "blocked", "invalid", "error")])
    each = table(spark, sf_dir, "events").select("user_id", F.element_at(order, (F.col("event_id") % 4 + 1).cast("int")).alias("s"))
    worst = each.groupBy("user_id").agg(F.max(F.array_position(order, F.col("s"))).cast("int").alias("m"))
    return worst.select("user_id", risk.overall_status(F.element_at(order, F.col("m")), F.lit("success")).alias("status"))


# --- normalizing -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS note_id, lang AS notetype_id, 'PHASE3.UNKNOWN_NOTETYPE_ID' AS code FROM documents WHERE lang NOT IN (SELECT lang FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 1)")
def unknown_notetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    known = docs.join(table(spark, sf_dir, "labels").where("quality = 0 AND toxic = 1"), "doc_id").select(F.col("lang").alias("id")).distinct()
    return normalize.unknown_notetypes(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("notetype_id")), known)


@query(
    """SELECT event_id AS note_id, array_to_string(list_sort(list_filter(want, lambda x: NOT list_contains(have, x))), ',') AS missing, array_to_string(list_sort(list_filter(have, lambda x: NOT list_contains(want, x))), ',') AS unknown
    FROM (SELECT event_id, json_keys(props::JSON) AS have, CASE event_type WHEN 'click' THEN ['k', 'z'] ELSE ['k'] END AS want FROM events WHERE props IS NOT NULL) WHERE len(missing) > 0 OR len(unknown) > 0"""
)
def field_set_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("props IS NOT NULL")
    notes = events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "click").otherwise("other").alias("notetype_id"), F.from_json("props", "map<string,string>").alias("fields"))
    types = spark.range(2).select(F.when(F.col("id") == 0, "click").otherwise("other").alias("id"), F.transform(F.when(F.col("id") == 0, F.array(F.lit("k"), F.lit("z"))).otherwise(F.array(F.lit("k"))), lambda n: F.struct(n.alias("name"))).alias("fields"))
    found = normalize.field_set_mismatch(notes, types)
    return found.select("note_id", joined("missing").alias("missing"), joined("unknown").alias("unknown"))


@query("SELECT digest AS key, ord FROM (SELECT sha1(text) AS digest, doc_id AS ord, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.duplicates(table(spark, sf_dir, "documents").select(F.sha1("text").alias("key"), F.col("doc_id").alias("ord")), "key", "ord")


@query("SELECT min(ord) AS ord, level, code, summary, path FROM diag GROUP BY level, code, summary, path", ("diag",))
def diagnostics_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.first_wins(frames.diagnostics(table(spark, sf_dir, "events")), normalize.DIAGNOSTIC_KEY, "ord").select("ord", "level", "code", "summary", "path")


@query("SELECT code, count(*) AS n, array_to_string(list_slice(list(source ORDER BY ord), 1, 3), ',') AS sources FROM diag GROUP BY code", ("diag",))
def diagnostics_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.samples(frames.diagnostics(table(spark, sf_dir, "events"))).withColumn("sources", joined("sources"))


@query("SELECT count(*) FILTER (level = 'warning') AS warnings, arg_min(code, ord) FILTER (level = 'error') AS first_error, CASE WHEN count(*) FILTER (level = 'error') > 0 THEN 'invalid' ELSE 'success' END AS status FROM diag", ("diag",))
def diagnostics_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.build_status(frames.diagnostics(table(spark, sf_dir, "events")))


@query("SELECT level, code, path, summary, row_number() OVER (ORDER BY list_position(['error', 'warning', 'info'], level), path, code, summary) AS place FROM (SELECT DISTINCT level, code, path, summary FROM diag)", ("diag",))
def diagnostics_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted report; the distinct diagnostics are few, so their places are counted in one task."""
    from pyspark.sql import Window

    rows = frames.diagnostics(table(spark, sf_dir, "events")).select("level", "code", "path", "summary").distinct()
    return normalize.ordered(rows).withColumn("place", F.row_number().over(Window.orderBy(normalize.severity_rank(F.col("level")), "path", "code", "summary")).cast("bigint"))


@query(
    """SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 1 THEN 'cloze' ELSE 'normal' END AS kind, CASE n_nationkey % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'cloze' END AS original_stock_kind, n_name AS name,
    CASE n_nationkey % 4 WHEN 0 THEN 'Front,Back' WHEN 1 THEN 'Text,Back Extra' WHEN 2 THEN 'Own' END AS fields, CASE n_nationkey % 4 WHEN 0 THEN 'Card 1' WHEN 1 THEN 'Cloze' WHEN 2 THEN 'T' END AS templates, CASE n_nationkey % 4 WHEN 3 THEN 'UNSUPPORTED_KIND' END AS issue FROM nation"""
)
def stock_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey") % 4
    kind = F.when(key == 0, "basic").when(key == 1, "cloze").when(key == 2, "own").otherwise("strange")
    own_fields = F.when(key == 2, F.from_json(F.lit('[{"name":"Own","ord":0}]'), normalize.NOTETYPE_FIELDS))
    own_templates = F.when(key == 2, F.from_json(F.lit('[{"name":"T","ord":0,"question_format":"{{Own}}","answer_format":"{{Own}}"}]'), normalize.NOTETYPE_TEMPLATES))
    types = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), kind.alias("kind"), F.col("n_name").alias("name"), own_fields.alias("fields"), own_templates.alias("templates"))
    full = normalize.expand_stock(types, normalize.stock_catalog(spark))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    return full.select("id", "kind", "original_stock_kind", "name", names("fields").alias("fields"), names("templates").alias("templates"), "issue")


@query("SELECT r_regionkey AS id, true AS fields_equal, r_regionkey % 2 = 0 AS templates_equal, r_regionkey % 3 = 0 AS css_equal FROM region")
def stock_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = normalize.stock_catalog(spark)
    types = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.lit("cloze").alias("original_stock_kind")).join(catalog, F.col("stock") == F.col("original_stock_kind"))
    changed = F.transform("stock_templates", lambda t: t.withField("question_format", F.lit("other")))
    claimed = types.select("id", "original_stock_kind", F.col("stock_fields").alias("fields"), F.when(F.col("id") % 2 == 0, F.col("stock_templates")).otherwise(changed).alias("templates"), F.when(F.col("id") % 3 == 0, F.col("stock_css")).otherwise("x").alias("css"))
    return normalize.same_shape(claimed, catalog)


@query(
    """SELECT 'note' AS owner_kind, 'part:' || p_partkey AS owner_id, 'field' AS location_kind, 'Name' AS location_name, p_name AS text FROM part
    UNION ALL SELECT 'note', 'part:' || p_partkey, 'field', 'Brand', p_brand FROM part
    UNION ALL SELECT 'notetype', 'supplier:' || s_suppkey, 'question_format', 'Card', '{{Front}} ' || s_name FROM supplier UNION ALL SELECT 'notetype', 'supplier:' || s_suppkey, 'answer_format', 'Card', s_name FROM supplier
    UNION ALL SELECT 'notetype', 'supplier:' || s_suppkey, 'browser_question_format', 'Card', s_name FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT 'notetype', 'supplier:' || s_suppkey, 'css', '', '.card {}' FROM supplier"""
)
def surfaces_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    notes = part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.create_map(F.lit("Name"), "p_name", F.lit("Brand"), "p_brand").alias("fields"))
    template = F.struct(F.lit("Card").alias("name"), F.concat(F.lit("{{Front}} "), "s_name").alias("question_format"), F.col("s_name").alias("answer_format"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("browser_question_format"), F.lit(None).cast("string").alias("browser_answer_format"))
    types = supplier.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.array(template).alias("templates"), F.lit(".card {}").alias("css"))
    return normalize.surfaces(notes, types)


@query("SELECT 'part:' || p_partkey AS id, p_partkey % 4 = 0 AS refused FROM part")
def template_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), "p_partkey")
    wrapped = tx.wrapped_front(F.lit("{{A}}"), F.when(F.col("p_partkey") % 4 == 0, "any").otherwise("all"), F.array(F.lit("A"), F.lit("B")))
    return rows.select("id", (wrapped == "{{#A}}{{A}}{{/A}}{{^A}}{{#B}}{{A}}{{/B}}{{/A}}").alias("refused"))


@query(
    """SELECT 'part:' || p_partkey AS id, '{Back=' || CASE WHEN p_partkey % 2 = 0 THEN '<img src="' || p_partkey || '.png">' ELSE '' END || ';Front=' || p_name || '}' AS fields,
    concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'PRODUCT.FIELD_UNKNOWN:extra' END, CASE WHEN p_partkey % 2 <> 0 THEN 'PRODUCT.MEDIA_UNKNOWN:m' || p_partkey END) AS issues FROM part"""
)
def product_lowering(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    content = lambda kind, value, m: F.struct(F.lit(kind).alias("kind"), value.alias("value"), m.alias("media_id"))
    none = F.lit(None).cast("string")
    base = F.create_map(F.lit("front"), content("text", F.col("p_name"), none), F.lit("back"), content("image", none, F.concat(F.lit("m"), "p_partkey")))
    more = F.map_concat(base, F.create_map(F.lit("extra"), content("text", F.lit("x"), none)))
    notes = part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lit("t").alias("notetype_id"), F.when(F.col("p_partkey") % 5 == 0, more).otherwise(base).alias("contents"))
    fields = spark.createDataFrame([("t", "front", "Front", True), ("t", "back", "Back", False)], "notetype_id string, key string, name string, required boolean")
    files = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("m"), "p_partkey").alias("id"), F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("export_as"))
    lowered = normalize.lower_notes(notes, fields, files)
    shown = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), F.lit("}"))
    return lowered.select("id", shown.alias("fields"), joined("issues").alias("issues"))


@query("SELECT n_nationkey AS id, '.card {}' || CASE WHEN n_regionkey < 3 THEN chr(10) || '@font-face { font-family: \"' || r_name || '\"; src: url(\"' || r_regionkey || '.woff2\"); }' ELSE chr(10) END AS css FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def font_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    fonts = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").alias("notetype_id"), F.col("r_name").alias("family"), F.col("n_regionkey").alias("asset_id"))
    assets = region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("id"), F.concat(F.col("r_regionkey").cast("string"), F.lit(".woff2")).alias("export_as"))
    return normalize.append_fonts(nation.select(F.col("n_nationkey").alias("id"), F.lit(".card {}").alias("css")), fonts, assets).select("id", F.when(F.col("css") == ".card {}", F.lit(".card {}\n")).otherwise(F.col("css")).alias("css"))


@query("SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'det:' || doc_id ELSE 'ext:' || source END AS identity FROM documents")
def document_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("doc_id") % 2 == 0, "default").otherwise("external")
    return table(spark, sf_dir, "documents").select("doc_id", normalize.document_identity(mode, F.col("doc_id").cast("string"), F.col("source"), F.lit("")).alias("identity"))


# --- references and media -----------------------------------------------------------------------------------------------


@query("SELECT owner_id, raw_ref FROM refs WHERE ref_kind = 'sound'", ("refs",))
def ref_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.references(table(spark, sf_dir, "part")).where("ref_kind = 'sound'").select("owner_id", "raw_ref")


@query("SELECT owner_id, raw_ref FROM refs WHERE ref_kind = 'html_src'", ("refs",))
def ref_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.references(table(spark, sf_dir, "part")).where("ref_kind = 'html_src'").select("owner_id", "raw_ref")


@query("SELECT owner_id, ref_kind, raw_ref FROM refs", ("refs",))
def ref_scan_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the exact scanner, on the texts that may hold a reference at all."""
    rows = frames.reference_text(table(spark, sf_dir, "part")).where("text LIKE '%<%' OR text LIKE '%[sound:%'")
    found = rows.select(F.col("id").alias("owner_id"), F.explode(udfs.references_of(F.col("text"), F.lit(False))).alias("r"))
    return found.select("owner_id", F.col("r.kind").alias("ref_kind"), F.col("r.raw").alias("raw_ref"))


@query("SELECT owner_id, raw_ref, CASE WHEN raw_ref LIKE 'https:%' THEN 'skipped' WHEN contains(raw_ref, ' ') THEN 'unsafe' ELSE 'local' END AS status, CASE WHEN raw_ref LIKE 'https:%' THEN 'external-url' WHEN contains(raw_ref, ' ') THEN 'helper-unsafe-character' END AS reason, CASE WHEN NOT contains(raw_ref, ' ') AND raw_ref NOT LIKE 'https:%' THEN raw_ref END AS local FROM refs", ("refs",))
def ref_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.references(table(spark, sf_dir, "part")).withColumn("c", tx.classified(F.col("raw_ref"), F.col("is_url")))
    return rows.select("owner_id", "raw_ref", "c.status", "c.reason", "c.local")


@query("SELECT owner_id, ref_kind, raw_ref, resolution_status, media_id, skip_reason FROM resolved", ("refs", "bound", "resolved"))
def ref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    found = normalize.resolve_references(frames.references(part), frames.bindings(part))
    return found.select("owner_id", "ref_kind", "raw_ref", "resolution_status", "media_id", "skip_reason")


@query("SELECT id, export_filename FROM bound WHERE id NOT IN (SELECT media_id FROM resolved WHERE resolution_status = 'resolved')", ("refs", "bound", "resolved"))
def unused_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return normalize.unused_bindings(frames.bindings(part), normalize.resolve_references(frames.references(part), frames.bindings(part))).select("id", "export_filename")


@query(
    """SELECT (SELECT count(DISTINCT digest) FROM media) AS objects, (SELECT sum(s)::BIGINT FROM (SELECT max(size) AS s FROM media GROUP BY digest)) AS bytes, (SELECT count(*) FROM bound) AS bindings,
    (SELECT count(*) FROM resolved WHERE resolution_status = 'missing') AS missing, (SELECT count(*) FROM resolved WHERE skip_reason = 'helper-unsafe-character') AS unsafe,
    (SELECT count(*) FROM bound WHERE id NOT IN (SELECT media_id FROM resolved WHERE resolution_status = 'resolved')) AS unused""",
    ("media", "refs", "bound", "resolved"),
)
def media_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    resolved = normalize.resolve_references(frames.references(part), frames.bindings(part))
    return media.media_summary(frames.media(table(spark, sf_dir, "documents")), frames.bindings(part), resolved)


@query(
    """SELECT ord, filename, digest, CASE WHEN row_number() OVER (PARTITION BY filename ORDER BY ord) = 1 THEN 'bound' WHEN first(digest) OVER (PARTITION BY filename ORDER BY ord) = digest THEN 'merged' ELSE 'conflict' END AS binding,
    CASE WHEN row_number() OVER (PARTITION BY digest ORDER BY ord) = 1 THEN 'new_object' ELSE 'deduped' END AS object FROM media""",
    ("media",),
)
def media_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.object_roles(frames.media(table(spark, sf_dir, "documents"))).select("ord", "filename", "digest", "binding", "object")


@query(
    """, ranked AS (SELECT lang || source AS grp, ord, size, row_number() OVER (PARTITION BY lang || source ORDER BY ord) AS n FROM media),
    fold AS (SELECT grp, ord, size, n, size <= 50000 AS kept, CASE WHEN size <= 50000 THEN size ELSE 0 END AS total FROM ranked WHERE n = 1
      UNION ALL SELECT r.grp, r.ord, r.size, r.n, f.total + r.size <= 50000, CASE WHEN f.total + r.size <= 50000 THEN f.total + r.size ELSE f.total END FROM fold f JOIN ranked r ON r.grp = f.grp AND r.n = f.n + 1)
    SELECT grp, ord, size, kept FROM fold""",
    ("media",),
)
def media_greedy_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = frames.media(table(spark, sf_dir, "documents")).select(F.concat("lang", "source").alias("grp"), "ord", "size")
    return media.within_budget(objects, 50_000)


ORACLE_SQL["media_greedy_cap"] = ORACLE_SQL["media_greedy_cap"].replace("WITH media", "WITH RECURSIVE media", 1).replace(") , ranked", "), ranked", 1)


@query("SELECT 'part:' || p_partkey AS filename, CASE WHEN p_partkey % 7 = 0 THEN 'missing' WHEN p_partkey % 5 = 0 THEN 'size_mismatch' WHEN p_partkey % 3 = 0 THEN 'digest_mismatch' ELSE 'ok' END AS status FROM part")
def staged_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    manifest = part.select(F.concat(F.lit("part:"), key).alias("filename"), F.length("p_name").alias("size"), F.sha1("p_name").alias("sha1"))
    staged = part.where(key % 7 != 0).select(F.concat(F.lit("part:"), key).alias("filename"), (F.length("p_name") + F.when(key % 5 == 0, 1).otherwise(0)).alias("size"), F.when(key % 3 == 0, F.sha1("p_brand")).otherwise(F.sha1("p_name")).alias("sha1"))
    return media.staged_status(manifest, staged)


@query("SELECT page_id, 'text/html' AS sniffed, false AS high, CASE page_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/css' ELSE 'text/html' END AS mime FROM pages")
def media_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, found = F.col("page_id"), tx.sniffed(F.encode("html", "utf-8"))
    name = F.concat(F.lit("page."), F.when(key % 4 == 1, "PNG").when(key % 4 == 2, "css").otherwise("unknown"))
    rows = table(spark, sf_dir, "pages").select("page_id", found.alias("s"), F.when(key % 4 == 0, "text/plain").alias("declared"), name.alias("name"))
    return rows.select("page_id", F.col("s.mime").alias("sniffed"), F.col("s.high").alias("high"), tx.effective_mime(F.col("declared"), F.col("s"), F.col("name")).alias("mime"))


@query("SELECT doc_id, strlen(text)::BIGINT AS size FROM documents WHERE (strlen(text) + 2) // 3 * 3 <= 65536")
def inline_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", media.inline_bytes(F.base64(F.encode("text", "utf-8"))).alias("b"))
    return rows.where("b IS NOT NULL").select("doc_id", F.octet_length("b").cast("bigint").alias("size"))


@query("SELECT p_partkey, p_partkey % 4 = 0 AS safe, p_partkey % 3 = 0 AS inside FROM part")
def path_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", tx.is_safe_filename(F.when(key % 4 == 0, F.concat(F.lit("a-"), key, F.lit(".png"))).when(key % 4 == 1, "..").otherwise("a b/c")).alias("safe"), media.is_inside(F.when(key % 3 == 0, "a/b").when(key % 3 == 1, "a/../b").otherwise("/a")).alias("inside"))


@query("SELECT owner_kind, owner_id, ref_kind, raw_ref, row_number() OVER (ORDER BY owner_kind, owner_id, raw_ref, ref_kind, resolution_status) AS place FROM (SELECT 'note' AS owner_kind, * FROM resolved)", ("refs", "bound", "resolved"))
def references_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    spot = frames.references(part).select(F.lit("note").alias("owner_kind"), "*", F.lit("field").alias("location_kind"), F.lit("Name").alias("location_name"))
    return media.ordered_references(normalize.resolve_references(spot, frames.bindings(part))).select("owner_kind", "owner_id", "ref_kind", "raw_ref", "place")


@query("SELECT export_filename, id, row_number() OVER (ORDER BY export_filename, id) AS place FROM bound", ("bound",))
def bindings_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.ordered_bindings(frames.bindings(table(spark, sf_dir, "part"))).select("export_filename", "id", "place")


@query("SELECT owner_id, array_to_string(list(raw_ref ORDER BY ref_kind DESC), '|') AS refs FROM refs GROUP BY owner_id", ("refs",))
def legacy_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.reference_text(table(spark, sf_dir, "part"))
    return rows.select(F.col("id").alias("owner_id"), F.array_join(tx.legacy_refs(F.col("text")), "|").alias("refs"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/p' || page_id WHEN 1 THEN 'outer/a' WHEN 2 THEN '' END AS path FROM pages")
def artifact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    reference = F.when(key % 4 == 0, F.concat(F.lit("out/a//p"), key)).when(key % 4 == 1, "outer/./a").when(key % 4 == 2, "out/").otherwise("out/../a")
    return table(spark, sf_dir, "pages").select("page_id", tx.artifact_path(reference, F.lit("out/")).alias("path"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS limitations FROM events GROUP BY user_id")
def baseline_limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.limitations(table(spark, sf_dir, "events"), "user_id", "event_type").withColumn("limitations", joined("limitations"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'report_only' WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN 'strict' ELSE 'disabled' END AS mode,
    CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 'UPDATE.LOCKFILE_PATH_REQUIRED' END AS code, CASE WHEN p_partkey % 3 = 0 THEN 'error' ELSE 'warning' END AS severity,
    CASE WHEN p_partkey % 5 = 0 THEN 'staging' WHEN p_partkey % 2 = 0 THEN 'package' WHEN p_partkey % 3 = 0 THEN 'staging' ELSE 'package' END AS inspected FROM part"""
)
def build_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options and results of a build for each part."""
    key = F.col("p_partkey")
    path = lambda n: F.when(key % n == 0, F.concat(F.lit("path"), key))
    chosen = release.effective_mode(F.when(key % 5 == 0, "report_only"), path(3), path(7), key % 2 == 0)
    staging = F.when((key % 5 == 0) | (key % 3 == 0), "staging")
    source = release.inspected_source(staging, key % 5 == 0, F.lit("package"), key % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", chosen["mode"].alias("mode"), chosen["code"].alias("code"), release.missing_project_id(key % 3 == 0)["severity"].alias("severity"), source["kind"].alias("inspected"))


# --- text and identity ---------------------------------------------------------------------------------------------------

CTES["stripped"] = r"""SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:script\b[^>]*>.*?</script\s*|style\b[^>]*>.*?</style\s*)>', '', 'g'), '(?s)<[^>]*>', '', 'g'),
  '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(160), ' ') AS text FROM pages"""


@query("SELECT page_id, text FROM stripped", ("stripped",))
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query("SELECT page_id, text FROM stripped", ("stripped",))
def html_strip_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", udfs.exact_strip(F.col("html")).alias("text"))


@query("SELECT page_id, ('0x' || substr(sha1(text), 1, 8))::BIGINT AS checksum FROM stripped", ("stripped",))
def field_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.field_checksum(tx.strip_html(F.col("html"))).alias("checksum"))


CTES["payloads"] = """SELECT doc_id, '{"algo_version":1,"components":{"selected_fields":[{"name":"front","value":' || to_json(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)))::VARCHAR || '}]},"notetype_family":"stock","notetype_key":"basic","recipe_id":"basic.core.v1"}' AS canonical FROM documents"""


@query("SELECT doc_id, canonical FROM payloads", ("payloads",))
def canonical_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", identity.basic_payload(F.col("text")).alias("canonical"))


@query("SELECT doc_id, 'sha:v1:' || sha256(canonical) AS stable_id FROM payloads", ("payloads",))
def stable_id_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("sha:v1:"), F.sha2(identity.basic_payload(F.col("text")), 256)).alias("stable_id"))


@query()
def stable_id_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = udfs.stable_config_id(F.lit("field"), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", identity.stable_id(identity.basic_payload(F.col("text"))).alias("stable_id"), config.alias("config_id"))


@query("SELECT id, 'artifact:' || sha1('{\"Brand\":' || to_json(p_brand)::VARCHAR || ',\"Name\":' || to_json(p_name)::VARCHAR || '}') AS fingerprint FROM (SELECT 'part:' || p_partkey AS id, * FROM part)")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("Name"), F.col("p_name"), F.lit("Brand"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), tx.fingerprint("artifact", tx.canonical_map(fields)).alias("fingerprint"))


@query("SELECT id, CASE WHEN p_size % 5 = 0 THEN text WHEN p_size % 3 = 0 THEN '[[CLOZE]] by [[CLOZE]] and [[CLOZE]]' ELSE '[[CLOZE]] by [[CLOZE]]' END AS skeleton FROM cloze", ("cloze",))
def cloze_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.cloze_notes(table(spark, sf_dir, "part")).select("id", identity.cloze_skeleton(F.col("text")).alias("skeleton"))


@query()
def cloze_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.cloze_notes(table(spark, sf_dir, "part")).where("text LIKE '%{{c%'")
    return rows.select("id", identity.stable_id(identity.cloze_payload(F.col("text"))).alias("stable_id"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'ZERO_SIZE' WHEN p_size + 11 > 40 THEN 'OUT_OF_BOUNDS' END AS issue,
    '{"algo_version":1,"components":{"image_anchor":"' || sha1(p_name) || '","image_height_px":40,"image_width_px":40,"occlusion_mode":"hide_all_guess_one","shapes":[{"h_px":5,"shape":"rect","w_px":10,"x_px":1,"y_px":2},{"h_px":5,"shape":"rect","w_px":' || CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 10 END || ',"x_px":' || (p_size + 1) || ',"y_px":2}]},"notetype_family":"stock","notetype_key":"image_occlusion","recipe_id":"io.core.v2"}' AS payload FROM part"""
)
def mask_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rect = lambda x, w: F.struct(x.cast("bigint").alias("x"), F.lit(2).cast("bigint").alias("y"), w.cast("bigint").alias("width"), F.lit(5).cast("bigint").alias("height"))
    width = F.when(F.col("p_partkey") % 6 == 0, 0).otherwise(10)
    rows = table(spark, sf_dir, "part").withColumn("shapes", F.array(rect(F.col("p_size") + 1, width), rect(F.lit(1), F.lit(10))))
    return rows.select("p_partkey", identity.mask_issue(F.lit(40), F.lit(40), F.col("shapes")).alias("issue"), identity.mask_payload(F.sha1("p_name"), F.lit(40).cast("string"), F.lit(40).cast("string"), F.lit("hide_all_guess_one"), F.col("shapes")).alias("payload"))


@query("SELECT doc_id AS ord, CASE WHEN doc_id % 5 = 0 THEN 'own:' || doc_id WHEN doc_id % 3 = 0 THEN 'stock:' || doc_id WHEN doc_id % 2 = 0 THEN 'recipe:' || doc_id ELSE 'generated:' || (doc_id + 1) END AS stable_id, CASE WHEN doc_id % 5 = 0 THEN 'explicit' WHEN doc_id % 3 = 0 THEN 'stock' WHEN doc_id % 2 = 0 THEN 'recipe' ELSE 'generated' END AS provenance FROM documents")
def identity_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    explicit = F.when(key % 5 == 0, F.concat(F.lit("own:"), key)).when(key % 7 == 0, "twice")
    rows = table(spark, sf_dir, "documents").select(key.alias("ord"), explicit.alias("explicit_id"), F.lit(None).cast("string").alias("override_id"), F.when(key % 2 == 0, F.concat(F.lit("recipe:"), key)).alias("recipe_id"), F.when(key % 3 == 0, F.concat(F.lit("stock:"), key)).alias("stock_id"))
    return identity.resolved(rows)


@query("SELECT sha1(text) AS stable_id, CASE WHEN count(DISTINCT source) > 1 THEN 'STABLE_ID_COLLISION' ELSE 'DUPLICATE_PAYLOAD' END AS issue FROM documents GROUP BY text HAVING count(*) > 1")
def identity_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identity_issues(table(spark, sf_dir, "documents").select(F.sha1("text").alias("stable_id"), F.col("source").alias("payload")))


@query(
    """, named AS (SELECT coalesce(deck, 'Default') AS deck, doc_id FROM cur),
    used AS (SELECT DISTINCT deck, doc_id % 40 + 1 AS n FROM named WHERE doc_id % 3 = 0),
    numbers AS (SELECT deck, unnest(range(1, count(*) + 42)) AS n FROM named GROUP BY deck),
    free AS (SELECT deck, n, row_number() OVER (PARTITION BY deck ORDER BY n) AS place FROM numbers ANTI JOIN used USING (deck, n)),
    placed AS (SELECT deck, doc_id, row_number() OVER (PARTITION BY deck ORDER BY doc_id) AS place FROM named)
    SELECT 'generated:' || deck || ':' || n AS id, deck, doc_id AS ord FROM placed JOIN free USING (deck, place)""",
    ("cur",),
)
def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third note has a generated id already, many of them the same."""
    notes = frames.notes(table(spark, sf_dir, "documents"), True).select(F.coalesce("deck", F.lit("Default")).alias("deck"), F.col("doc_id").alias("ord"))
    taken = F.concat(F.lit("generated:"), "deck", F.lit(":"), F.col("ord") % 40 + 1)
    return identity.generated_ids(notes, notes.where("ord % 3 = 0").select(taken.alias("stable_id")))


@query("SELECT doc_id, source AS subdeck, lang || ' ' || source AS tags FROM documents")
def subdeck(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.notes(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id") * 11 + 1), False)
    special = lambda name: tx.special_field(F.lit(name), F.lit("Card 1"), F.col("deck"), F.col("tags"), F.lit("Basic"))
    return rows.select(((F.col("doc_id") - 1) / 11).cast("bigint").alias("doc_id"), special("Subdeck").alias("subdeck"), special("Tags").alias("tags"))


@query("SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS template_key, lower(replace(p_name, ' ', '_')) AS field_key, replace(replace(p_type, '&', '&amp;'), '<', '&lt;') AS escaped, '''' || p_brand || '\\[x\\]''' AS selector FROM part")
def derived_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.derived_template_key(F.col("p_name")).alias("template_key"), tx.derived_field_key(F.concat(F.lit(" "), "p_name", F.lit("!"))).alias("field_key"), tx.escape_html(F.col("p_type")).alias("escaped"), tx.selector_text(F.concat("p_brand", F.lit("[x]"))).alias("selector"))


@query("SELECT doc_id, 'note[id=''doc:' || doc_id || ''']' AS selector FROM documents WHERE doc_id = 17")
def selector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "documents").select("doc_id", F.lit("note").alias("kind"), F.create_map(F.lit("id"), frames.doc_id()).alias("attributes"))
    return selectors.matching(selectors.parse("note[id='doc:17']"), targets).select("doc_id", F.concat(F.lit("note[id='doc:"), "doc_id", F.lit("']")).alias("selector"))


# --- cards and collections ------------------------------------------------------------------------------------------------


def odd_cloze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloze texts with a deletion that is open, out of range, empty, zero or nested at the end of some."""
    rows, size = frames.cloze_notes(table(spark, sf_dir, "part")), F.col("p_size")
    end = F.when(size % 7 == 0, "{{c3::open").when(size % 11 == 0, "{{c99999999999::x}}").when(size % 13 == 0, "{{c4::}}").when(size % 17 == 0, "{{c0::x}}").when(size % 19 == 0, "{{c6::a {{c7::b}} }}").otherwise("")
    return rows.withColumn("text", F.concat("text", end))


CTES["odd_cloze"] = """SELECT id, p_size % 7 = 0 OR p_size % 11 = 0 OR p_size % 13 = 0 OR p_size % 17 = 0 OR p_size % 19 = 0 AS malformed,
  array_to_string(list_concat(CASE WHEN p_size % 5 = 0 THEN [] ELSE ['0', '1'] END, CASE WHEN p_size % 7 = 0 OR p_size % 11 = 0 THEN [] WHEN p_size % 13 = 0 THEN ['3'] WHEN p_size % 17 = 0 THEN [] WHEN p_size % 19 = 0 THEN ['5'] ELSE [] END), ',') AS ords FROM cloze"""


@query("SELECT id, ords FROM odd_cloze", ("cloze", "odd_cloze"))
def cloze_ords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_cloze(spark, sf_dir).select("id", joined(cards.card_ordinals(F.array("text")).cast("array<string>")).alias("ords"))


@query("SELECT id, ords, malformed FROM odd_cloze", ("cloze", "odd_cloze"))
def cloze_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = odd_cloze(spark, sf_dir).select("id", udfs.cloze_scan(F.col("text")).alias("s"))
    return rows.select("id", joined(F.col("s.ords").cast("array<string>")).alias("ords"), F.col("s.malformed").alias("malformed"))


def card_types(spark: SparkSession) -> DataFrame:
    """A plain type with three generation rules and a template without one, and a cloze type."""
    made = "array<struct<name string, ord int, question_format string, rule_kind string, rule_fields array<string>, target_deck_name string>>"
    rule = ("All", None, "", "all", ["Text", "Extra"], None), ("Any", 5, "", "any", ["Text", "Extra"], "Target"), ("None", None, "", "none", [], None)
    rows = [
        ("plain", "normal", ["Text", "Extra"], [*rule, ("Default", None, "{{^Extra}}<hr>{{/Extra}}{{#Extra}}{{hint:Text}} {{/Extra}}", None, None, None)]),
        ("cloze", "cloze", ["Text"], [("Cloze", None, "", "cloze", ["Text"], None)]),
    ]
    return spark.createDataFrame(rows, f"id string, kind string, fields array<string>, templates {made}")


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.cloze_notes(table(spark, sf_dir, "part"))
    extra = F.when(F.col("p_size") % 8 == 0, "<b><!-- <i> --></b>&nbsp;").when(F.col("p_size") % 4 == 0, "<b></b>").otherwise(F.col("p_type"))
    notes = rows.select("id", F.when(F.col("ord") % 2 == 0, "cloze").otherwise("plain").alias("notetype_id"), F.create_map(F.lit("Text"), F.col("text"), F.lit("Extra"), extra).alias("fields"), F.concat(F.lit("deck"), F.col("ord") % 3).alias("deck_name"))
    return cards.plan_cards(notes, card_types(spark))


CTES["planned"] = """SELECT id AS note_id, 0 AS template_index, unnest([0, 1])::BIGINT AS card_ord, 'Cloze' AS template_name, NULL AS target_deck, 'deck' || (ord % 3) AS deck_name, ord FROM cloze WHERE ord % 2 = 0 AND p_size % 5 <> 0
  UNION ALL SELECT id, 0, 0, 'All', NULL, 'deck' || (ord % 3), ord FROM cloze WHERE ord % 2 = 1 AND p_size % 4 <> 0 UNION ALL SELECT id, 1, 5, 'Any', 'Target', 'deck' || (ord % 3), ord FROM cloze WHERE ord % 2 = 1 UNION ALL SELECT id, 2, 2, 'None', NULL, 'deck' || (ord % 3), ord FROM cloze WHERE ord % 2 = 1
  UNION ALL SELECT id, 3, 3, 'Default', NULL, 'deck' || (ord % 3), ord FROM cloze WHERE ord % 2 = 1 AND p_size % 4 <> 0"""


@query("SELECT note_id, template_index, card_ord, template_name, target_deck, deck_name FROM planned", ("cloze", "planned"))
def card_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir)


@query("SELECT template_name, count(*) AS cards FROM planned GROUP BY ALL", ("cloze", "planned"))
def generation_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).groupBy("template_name").agg(F.count("*").alias("cards"))


@query("SELECT id, p_size % 5 <> 0 AS generates FROM cloze", ("cloze",))
def default_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered front has text: a section on a field that is blank markup for every 5th size."""
    rows = frames.cloze_notes(table(spark, sf_dir, "part"))
    field = F.when(F.col("p_size") % 5 == 0, "<div><br></div>").otherwise(F.col("text"))
    return rows.select("id", udfs.renders_text(F.lit("{{#Text}}{{Text}} {{/Text}}"), F.create_map(F.lit("Text"), field), F.create_map(F.lit("Type"), F.lit("Basic")), F.array(F.lit("Text"))).alias("generates"))


@query("SELECT name, (dense_rank() OVER (ORDER BY name) + 1)::BIGINT AS deck_id FROM (SELECT DISTINCT lang || '::' || source AS name FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) UNION ALL SELECT 'Default', 1")
def deck_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("::"), "source").alias("name")).where("name IS NOT NULL")
    return cards.deck_registry(names)


@query(
    """, decks AS (SELECT name, dense_rank() OVER (ORDER BY name) + 1 AS deck_id FROM (SELECT DISTINCT coalesce(target_deck, deck_name) AS name FROM planned))
    SELECT row_number() OVER (ORDER BY ord, template_index, card_ord) AS card_id, note_id, card_ord, deck_id::BIGINT AS deck_id FROM planned JOIN decks ON name = coalesce(target_deck, deck_name)""",
    ("cloze", "planned"),
)
def card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planned(spark, sf_dir)
    decks = cards.deck_registry(rows.select(F.coalesce("target_deck", "deck_name").alias("name")))
    placed = cards.numbered(rows.withColumn("ord", F.substring_index("note_id", ":", -1).cast("bigint")), ["ord", "template_index", "card_ord"], "card_id")
    return cards.card_decks(placed, decks).select("card_id", "note_id", "card_ord", "deck_id")


def collected(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A note of each part: even ones of a plain type, odd ones of a type whose order of fields is turned round."""
    key, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    notes = part.select(
        F.concat(F.lit("part:"), key).alias("id"), key.alias("ord"), F.when(key % 2 == 0, "plain").otherwise("turned").alias("notetype_id"), F.concat(F.lit("deck"), key % 3).alias("deck_name"),
        F.create_map(F.lit("Front"), "p_name", F.lit("Back"), "p_brand").alias("fields"), F.array("p_type", "p_brand").alias("tags"), F.when(key % 5 == 0, key).alias("mtime_secs"),
    )
    types = spark.createDataFrame(
        [
            ("plain", 0, "Plain", "normal", [("Front", None, None), ("Back", None, None)], [("Card 1", None, "{{Front}}", "any", ["Front"], None)]),
            ("turned", 1, "Turned", "normal", [("Front", 1, None), ("Back", 0, True)], [("Card 1", 0, "{{Front}}", "all", ["Front"], None), ("Card 2", 1, "{{Back}}", "any", ["Back"], "Target")]),
        ],
        "id string, ord int, name string, kind string, fields array<struct<name string, ord int, sort boolean>>, templates array<struct<name string, ord int, question_format string, rule_kind string, rule_fields array<string>, target_deck_name string>>",
    )
    guids = notes.where("ord % 3 = 0").select(F.col("id").alias("normalized_note_id"), F.concat(F.lit("guid-"), "ord").alias("selected_guid"))
    return collection.collection_tables(notes, types, guids)


@query(
    """SELECT row_number() OVER (ORDER BY p_partkey) AS id, CASE WHEN p_partkey % 3 = 0 THEN 'guid-' || p_partkey ELSE 'part:' || p_partkey END AS guid, 1::BIGINT + p_partkey % 2 AS mid, CASE WHEN p_partkey % 5 = 0 THEN p_partkey ELSE 1 END::BIGINT AS mod, p_type || ' ' || p_brand AS tags,
    CASE WHEN p_partkey % 2 = 0 THEN p_name || chr(31) || p_brand ELSE p_brand || chr(31) || p_name END AS flds, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS sfld, ('0x' || substr(sha1(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END), 1, 8))::BIGINT AS csum FROM part"""
)
def collection_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collected(spark, sf_dir)["notes"]


@query(
    """SELECT row_number() OVER (ORDER BY nid, ord) AS id, nid, CASE ord WHEN 1 THEN 2 ELSE 3 + k % 3 END::BIGINT AS did, ord, nid AS due
    FROM (SELECT k, nid, unnest(CASE WHEN k % 2 = 0 THEN [0] ELSE [0, 1] END)::BIGINT AS ord FROM (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) AS nid FROM part))"""
)
def collection_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collected(spark, sf_dir)["cards"]


@query("SELECT DISTINCT tag FROM (SELECT p_type AS tag FROM part UNION ALL SELECT p_brand FROM part)")
def collection_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collected(spark, sf_dir)["tags"]


@query("SELECT count(*) AS notetype_count, 4::BIGINT + count(*) - 1 AS template_count, 3::BIGINT AS field_count, (SELECT count(*) FROM part) AS note_count, (SELECT count(*) FROM planned) AS card_count, (SELECT count(*) FROM media) AS media_count FROM (VALUES (1), (2))", ("cloze", "planned", "media"))
def inspect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.counts(card_types(spark), table(spark, sf_dir, "part"), planned(spark, sf_dir), frames.media(table(spark, sf_dir, "documents")))


@query("SELECT l_orderkey AS note_id, arg_min(coalesce(s_name, 'Default'), l_linenumber::BIGINT * 1000000000 + l_suppkey) AS deck FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 <> 0) ON s_suppkey = l_suppkey GROUP BY l_orderkey")
def first_card_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("ord"), F.col("l_suppkey").alias("did"))
    return observe.note_decks(rows, table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("did"), F.col("s_name").alias("deck")))


@query("SELECT 'order-' || o_orderkey AS guid, l_linenumber AS ord, coalesce(s_name, 'Default') AS deck FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 <> 0) ON s_suppkey = l_suppkey")
def card_deck_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("ord"), F.col("l_suppkey").alias("did"))
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note_id"), F.concat(F.lit("order-"), "o_orderkey").alias("guid"))
    return observe.card_deck_map(rows, notes, table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("did"), F.col("s_name").alias("deck")))


@query("SELECT l_orderkey AS note_id, 'plain' AS notetype_id, l_linenumber::BIGINT AS ord, CASE l_linenumber WHEN 2 THEN 'None' WHEN 3 THEN 'Default' WHEN 5 THEN 'Any' ELSE '<missing template>' END AS template FROM lineitem")
def card_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.lit("plain").alias("notetype_id"), F.col("l_linenumber").cast("bigint").alias("ord"))
    return observe.card_templates(rows, card_types(spark))


@query("SELECT DISTINCT raw_ref AS filename FROM resolved WHERE resolution_status = 'missing'", ("refs", "bound", "resolved"))
def media_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    refs = frames.references(part).withColumn("c", tx.classified(F.col("raw_ref"), F.col("is_url"))).select(F.col("c.local").alias("local"))
    return observe.inconsistent_media(refs, frames.bindings(part).select(F.col("export_filename").alias("filename")))


@query("SELECT 'part:' || p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'Nam' ELSE '' END AS unknown, 'Brand' AS cloze FROM part")
def template_unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("p_size") % 4 == 0, "{{#Name}}{{Nam}}{{/Name}} {{cloze:Brand}} {{Tags}}").otherwise("{{Name}} {{hint:cloze:Brand}} {{Tags}}")
    known = F.array(*[F.lit(x) for x in ("Name", "Brand", *sorted({"Card", "CardFlag", "Deck", "FrontSide", "Subdeck", "Tags", "Type"}))])
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), source.alias("s"))
    return rows.select("id", joined(F.array_sort(F.array_except(cards.template_names(F.col("s")), known))).alias("unknown"), joined(cards.cloze_fields(F.col("s"))).alias("cloze"))


@query("SELECT 'part:' || p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'TEMPLATE.RENDER_FIELD_UNKNOWN' ELSE 'TEMPLATE.FILTER_UNKNOWN' END AS code, CASE WHEN p_size % 4 = 0 THEN 9 ELSE 9 END AS byte_offset FROM part")
def template_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("p_size") % 4 == 0, "{{Name}} {{Nam}}").otherwise("{{Name}} {{strange:Name}}")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.explode(udfs.template_issues(source, F.array(F.lit("Name")))).alias("i"))
    return rows.select("id", "i.code", "i.byte_offset")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || chr(31) || p_name ELSE p_name || chr(31) || p_brand END AS joined, CASE WHEN p_size % 3 = 0 THEN 'Brand' WHEN p_size % 2 = 0 THEN 'Brand' ELSE 'Name' END AS sort_field FROM part")
def sort_field_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    fields = F.array(F.struct(F.lit("Name").alias("name"), F.when(even, 1).otherwise(0).alias("ord"), F.lit(False).alias("sort")), F.struct(F.lit("Brand").alias("name"), F.when(even, 0).otherwise(1).alias("ord"), (F.col("p_size") % 3 == 0).alias("sort")))
    values = F.create_map(F.lit("Name"), F.col("p_name"), F.lit("Brand"), F.col("p_brand"))
    rows = table(spark, sf_dir, "part").withColumn("fields", fields).withColumn("values", values)
    return rows.select("p_partkey", tx.joined_fields(F.transform(cards.sorted_fields(F.col("fields")), lambda f: F.element_at(F.col("values"), f["name"]))).alias("joined"), cards.sort_field(F.col("fields")).alias("sort_field"))


@query("SELECT DISTINCT unnest([lang, source]) AS tag FROM documents")
def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.array("lang", "source")).alias("tag")).distinct()


@query("SELECT 'notes' AS name, count(*) AS n FROM documents UNION ALL SELECT 'cards', count(*) FROM lineitem UNION ALL SELECT 'decks', count(*) FROM supplier")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.table_counts({"notes": table(spark, sf_dir, "documents"), "cards": table(spark, sf_dir, "lineitem"), "decks": table(spark, sf_dir, "supplier")})


@query("SELECT 'part:' || p_partkey AS id, '{{c1' || CASE WHEN p_size % 2 = 0 THEN ',2' ELSE '' END || '::image-occlusion:rect:left=' || p_size || ':top=2:width=10:height=5}}<br>' AS markup FROM part")
def mask_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("p_size") % 2 == 0, "hide_one_guess_one").otherwise("hide_all_guess_one")
    rect = F.struct(F.col("p_size").alias("x"), F.lit(2).alias("y"), F.lit(10).alias("width"), F.lit(5).alias("height"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), tx.mask_markup(mode, F.array(rect)).alias("markup"))


# --- validation ------------------------------------------------------------------------------------------------------------


@query(
    """SELECT 'BlankStableId' AS code, 'error' AS level, 'p' || (p_partkey % 1500) AS subject FROM part WHERE p_partkey % 8 = 0
    UNION ALL SELECT 'MissingStableId', 'warning', 'p' || (p_partkey % 1500) FROM part WHERE p_partkey % 8 = 1 AND p_partkey % 2 = 1
    UNION ALL SELECT 'StableIdDuplicate', 'error', id FROM (SELECT 'p' || (p_partkey % 1500) AS id, row_number() OVER (PARTITION BY p_partkey % 1500) AS n FROM part) WHERE n > 1
    UNION ALL SELECT 'NoteLevelIdentityOverrideUsed', 'warning', 'p' || (p_partkey % 1500) FROM part WHERE p_partkey % 10 = 0
    UNION ALL SELECT 'UnknownMediaRef', 'error', 'p' || (p_partkey % 1500) FROM part WHERE p_partkey % 3 = 0 AND p_size > 30
    UNION ALL SELECT 'EmptyIoMasks', 'error', 'p' || (p_partkey % 1500) FROM part WHERE p_partkey % 3 = 0 AND p_size % 5 = 0"""
)
def deck_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    explicit = F.when(key % 8 == 0, " ").when(key % 8 != 1, F.concat(F.lit("x"), key))
    notes = part.select(F.concat(F.lit("p"), key % 1500).alias("id"), F.when(key % 3 == 0, "image_occlusion").otherwise("basic").alias("kind"), explicit.alias("explicit_id"), (key % 2 == 1).alias("generated"), (key % 10 == 0).alias("used_override"), F.concat(F.lit("size"), "p_size").alias("image"), (F.col("p_size") % 5).alias("masks"))
    return validate.deck_issues(notes, part.where("p_size <= 30").select(F.concat(F.lit("size"), "p_size").alias("name")))


@query(
    """SELECT 'AFID.STABLE_ID_BLANK' AS code, 'error' AS level, 'doc:' || doc_id AS subject FROM documents WHERE doc_id % 9 = 0
    UNION ALL SELECT 'AFID.STABLE_ID_DUPLICATE', 'error', s FROM (SELECT sha1(text) AS s, row_number() OVER (PARTITION BY text) AS n FROM documents WHERE doc_id % 9 <> 0) WHERE n > 1
    UNION ALL SELECT 'PROJECT.UNSUPPORTED_NOTE_TYPE', 'error', 'doc:' || doc_id FROM documents WHERE lang = 'es'
    UNION ALL SELECT 'NOTETYPE.ID_DUPLICATE', 'error', 'de' UNION ALL SELECT 'NOTETYPE.IDENTITY_RECIPE_MISSING', 'warning', 'fr' UNION ALL SELECT 'NOTETYPE.FIELD_KEY_AUTO_DERIVED', 'warning', 'de.front'"""
)
def project_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select(frames.doc_id().alias("id"), F.when(F.col("lang") == "en", "basic").otherwise(F.col("lang")).alias("notetype_id"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.sha1("text")).alias("stable_id"))
    types = spark.createDataFrame([("de", True), ("de", True), ("fr", False)], "id string, has_identity boolean")
    return validate.project_issues(notes, types, spark.createDataFrame([("de", "front", True), ("de", "back", False)], "notetype_id string, key string, auto_key boolean"))


@query(
    """SELECT 'part:' || p_partkey AS subject, unnest(CASE p_partkey % 8 WHEN 0 THEN ['PRODUCT.CLOZE_FIELD_UNEXPECTED', 'TEMPLATE.CLOZE_RULE_REQUIRES_CLOZE_NOTETYPE'] WHEN 1 THEN ['PRODUCT.CLOZE_FIELD_REQUIRED'] WHEN 2 THEN ['PRODUCT.CLOZE_FIELD_UNKNOWN']
      WHEN 3 THEN ['PRODUCT.CLOZE_TEMPLATE_COUNT_INVALID', 'PRODUCT.CLOZE_FIELD_MISMATCH'] WHEN 4 THEN ['PRODUCT.CLOZE_FILTER_REQUIRED'] WHEN 5 THEN ['PRODUCT.NOTE_TYPE_KIND_UNSUPPORTED'] ELSE [] END) AS code FROM part"""
)
def custom_cloze_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("p_partkey") % 8
    kind = F.when(case.isin(0, 7), "normal").when(case == 5, "odd").otherwise("cloze")
    field = F.when(case == 2, "Nope").when(~case.isin(1, 7), "Text")
    fronts = F.when(case == 3, F.array(F.lit("{{cloze:Text}}"), F.lit("{{cloze:Extra}}"))).when(case == 4, F.array(F.lit("{{Text}}"))).otherwise(F.array(F.lit("{{hint:cloze:Text}}")))
    rules = F.when(case == 0, F.array(F.lit("cloze"))).otherwise(F.array(F.lit("all")))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), kind.alias("kind"), field.alias("cloze_field"), F.array(F.lit("Text"), F.lit("Extra")).alias("field_names"), fronts.alias("fronts"), rules.alias("rule_kinds"))
    return validate.custom_type_issues(rows)


CTES["panel"] = """SELECT 'part:' || p_partkey AS id, p_partkey % 3 AS c, '{{#Back Extra}}<div class="af-back-extra-panel"><h3>' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'More' END || '</h3>{{Back Extra}}</div>{{/Back Extra}}' AS p FROM part"""


@query("SELECT id, CASE c WHEN 0 THEN 'a ' || p || ' b' WHEN 1 THEN p || ' {{Back Extra}}' ELSE 'plain' || chr(10) || p END AS answer, CASE c WHEN 0 THEN 'PHASE5A.HELPER_SCOPE_INVALID' END AS issue FROM panel", ("panel",))
def helper_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("p_partkey") % 3
    answer = F.when(case == 0, "a {{#Back Extra}}<div>{{Back Extra}}</div>{{/Back Extra}} b").when(case == 1, "{{Back Extra}} {{Back Extra}}").otherwise("plain")
    made = validate.back_extra_panel(answer, F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")))
    kind = F.when(case == 0, "basic").otherwise("cloze")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), made.alias("answer"), validate.helper_issue(kind, F.lit("back_extra_panel")).alias("issue"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"identity\":{\"id\":' || user_id || '}}' WHEN 1 THEN '{\"a\":1,\"identity\":{\"id\":' || user_id || '},\"k\":\"v\"}' END AS data FROM events")
def note_data_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("event_id") % 3
    existing = F.when(case == 0, " ").when(case == 1, '{"k": "v", "identity": 5, "a": 1}').otherwise("[1]")
    return table(spark, sf_dir, "events").select("event_id", validate.merged_note_data(existing, "identity", F.concat(F.lit('{"id":'), "user_id", F.lit("}"))).alias("data"))


@query(
    """SELECT source, CASE WHEN source IN ('src1', 'src2') THEN 'missing' WHEN source IN ('src3', 'src4') THEN 'degraded' ELSE 'full' END AS evidence,
    CASE WHEN source IN ('src1', 'src2') THEN 'unavailable' WHEN source IN ('src3', 'src4') THEN 'partial' ELSE 'complete' END AS status FROM (SELECT DISTINCT source FROM documents)"""
)
def comparison_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.explode(F.array(F.lit("metadata"), F.lit("references"), F.lit("templates"))).alias("domain"))
    bare = ((F.col("domain") == "metadata") & F.col("source").isin("src1", "src2")) | ((F.col("domain") == "templates") & (F.col("source") == "src3"))
    payload = F.when(bare, "{}").when(F.col("domain") == "metadata", '{"card_count":3}').otherwise('{"ord":0}')
    selector = F.when((F.col("domain") == "references") & (F.col("source") != "src4"), "card[note_id='a'][ord=0]").otherwise("x")
    found = validate.card_evidence(rows.select("source", "domain", payload.alias("payload"), selector.alias("selector")), "source")
    return found.select("source", "evidence", validate.product_comparison_status(F.lit("complete"), F.lit(False), F.lit(0), F.lit("full"), F.col("evidence")).alias("status"))


@query("SELECT code, code || ': ' || n || ' (' || s || CASE WHEN n > 3 THEN ' and ' || (n - 3) || ' more' ELSE '' END || ')' AS line FROM (SELECT code, count(*) AS n, array_to_string(list_slice(list(source ORDER BY ord), 1, 3), ', ') AS s FROM diag GROUP BY code)", ("diag",))
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.report_lines(normalize.samples(frames.diagnostics(table(spark, sf_dir, "events"))))


@query("SELECT sha256(text) AS digest, sha1(text) AS sha1, strlen(text)::BIGINT AS size, 'objects/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS path FROM documents GROUP BY text")
def media_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(frames.doc_id().alias("path"), F.encode("text", "utf-8").alias("content"))
    return store.objects(files).select("digest", "sha1", "size", "path")
