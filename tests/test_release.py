import io
import zipfile

import pytest
from pyspark.sql import functions as F

from relcast.operators import cards, identity, media, normalize, release, risk
from relcast.sources import entities, package, store

OBSERVATION = "domain string, selector string, payload string, evidence array<string>, ord bigint"
INDEX = "normalized_note_id string, stable_id string, candidate string"
LOCK = "stable_id string, guid string, ord bigint"


def observed(spark, rows):
    return spark.createDataFrame([(d, s, p, [f"e:{s}"], i) for i, (d, s, p) in enumerate(rows)], OBSERVATION)


def summary(df):
    return sorted((r.category, r.domain, r.selector) for r in df.collect())


def test_diff(spark):
    left = observed(spark, [("notetypes", "a", "1"), ("notetypes", "b", "1"), ("references", "media-ref[x]", "1"), ("field_metadata", "m", "1"), ("media", "a", "1"), ("media", "a", "2")])
    right = observed(spark, [("notetypes", "a", "2"), ("notetypes", "c", "1"), ("references", "media-ref[x]", "2"), ("field_metadata", "m", "2"), ("media", "a", "2")])
    changes = release.diff(left, right)
    assert summary(changes) == [("added", "notetypes", "c"), ("modified", "notetypes", "a"), ("modified", "references", "media-ref[x]"), ("removed", "notetypes", "b")]
    assert summary(release.diff(left, right, packaged=True)) == [x for x in summary(changes) if x[1] != "references"]
    assert summary(release.diff(left, right, missing=("notetypes",))) == [("modified", "references", "media-ref[x]")]


def test_diff_of_itself_is_empty_and_diff_mirrors(spark):
    left, right = observed(spark, [("media", "a", "1"), ("media", "b", "1")]), observed(spark, [("media", "b", "2"), ("media", "c", "1")])
    assert release.diff(left, left).count() == 0
    swap = {"added": "removed", "removed": "added", "modified": "modified"}
    assert summary(release.diff(right, left)) == sorted((swap[c], d, s) for c, d, s in summary(release.diff(left, right)))
    assert summary(release.diff(left.repartition(7), right.repartition(5))) == summary(release.diff(left, right))


def test_reorder_is_read_from_text(spark):
    changes = observed(spark, []).selectExpr("domain", "selector").union(spark.createDataFrame([("templates", "word"), ("templates", "x")], "domain string, selector string"))
    codes = changes.select(release.semantic_code(F.col("domain"), F.lit("modified"), F.col("selector"), F.concat("selector", F.lit(" changed"))).alias("c")).collect()
    assert [r.c for r in codes] == ["RISK.TEMPLATE_REORDER", None]


def test_reconcile_priority(spark):
    current = spark.createDataFrame([("n1", "s1", "c1"), ("n2", "s2", "c2"), (None, "s3", "c3")], INDEX)
    previous = spark.createDataFrame([("s1", "old", 0), ("s1", "p1", 1)], LOCK)
    locked = spark.createDataFrame([("s1", "l1", 0), ("s2", "l2", 1), ("s9", "l9", 2)], LOCK)
    out = release.reconcile(current, previous, locked)
    got = {r.stable_id: (r.normalized_note_id, r.selected_guid, r.source, r.conflict, r.drift) for r in out.collect()}
    assert got == {"s1": ("n1", "p1", "previous_package", True, True), "s2": ("n2", "l2", "lockfile", False, True), "s3": ("s3", "c3", "current_derivation", False, False)}
    assert release.reconcile_counts(out).first().asDict() == {"preserved": 2, "derived": 1, "failed": 0, "conflicts": 1}
    carried = release.carry_forward(out, locked)
    assert {(r.stable_id, r.guid, r.lifecycle) for r in carried.collect()} == {("s1", "p1", "active"), ("s2", "l2", "active"), ("s3", "c3", "active"), ("s9", "l9", "absent_from_current")}
    again = release.reconcile(current, previous.limit(0), carried.select("stable_id", "guid", F.lit(0).cast("bigint").alias("ord")))
    assert {(r.stable_id, r.selected_guid) for r in again.collect()} == {("s1", "p1"), ("s2", "l2"), ("s3", "c3")}


def test_a_guid_chosen_twice_is_refused(spark):
    rows = spark.createDataFrame([("s1", "g"), ("s2", "g"), ("s3", "h")], "stable_id string, selected_guid string")
    assert [tuple(r) for r in release.duplicate_guids(rows).collect()] == [("g", 2, "s1")]
    with pytest.raises(Exception, match="GUID_DUPLICATE_AT_RECONCILE"):
        release.require_unique_guids(rows).collect()
    assert release.require_unique_guids(rows.where("stable_id <> 's2'")).count() == 2


def test_risk(spark):
    rows = [("templates", "removed", "t1"), ("metadata", "modified", "counts"), ("media", "removed", "m"), ("media", "added", "x")]
    changes = spark.createDataFrame([(*r, f"{r[2]} changed") for r in rows], "domain string, category string, selector string, message string")
    told = spark.createDataFrame([("UPDATE.GUID_DERIVATION_DRIFT", "warning", "n"), ("MEDIA.MISSING_REFERENCE", "warning", "n"), ("MEDIA.MISSING_REFERENCE", "error", "n"), ("OTHER", "error", "n")], "code string, level string, source string")
    found = risk.findings(changes, told)
    assert {(r.code, r.level) for r in found.collect()} == {("RISK.TEMPLATE_REMOVED", "Critical"), ("RISK.CARD_COUNT_CHANGED", "High"), ("RISK.MEDIA_REMOVED", "Medium"), ("RISK.NOTE_GUID_DRIFT", "High"), ("RISK.MEDIA_REFERENCE_BROKEN", "High")}
    assert risk.highest(found).first().highest_level == "Critical"
    assert risk.gate(found, "Critical").first().asDict() == {"status": "blocked", "threshold": "Critical", "highest_risk": "Critical", "blocking": ["RISK.TEMPLATE_REMOVED"]}
    none = risk.findings(changes.where("category = 'added'"))
    assert [r.code for r in risk.with_residual(none, changes).collect()] == ["RISK.ARTIFACT_DIFF"]
    assert risk.gate(none, "Low").first().status == "passed" and risk.gate(found, None).first().status == "not_evaluated"
    assert {r.code for r in risk.findings(changes.limit(0), unavailable=True).collect()} == {"RISK.BASELINE_UNAVAILABLE"}


def test_reordered_template_with_diagnostic_is_one_finding(spark):
    changes = spark.createDataFrame([("templates", "modified", "t[ord]", "t[ord] changed")], "domain string, category string, selector string, message string")
    told = spark.createDataFrame([("UPDATE.TEMPLATE_ORD_CHANGED", "warning", "t[ord]")], "code string, level string, source string")
    (row,) = risk.findings(changes, told).collect()
    assert row.code == "RISK.TEMPLATE_REORDER" and row.evidence == ["diagnostic:UPDATE.TEMPLATE_ORD_CHANGED", "semantic:t[ord]"]


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 1, 9), ("a", 2, 5), ("b", 0, 11)], "grp string, ord bigint, size bigint")
    assert {(r.grp, r.ord): r.kept for r in media.within_budget(rows, 10).collect()} == {("a", 0): True, ("a", 1): False, ("a", 2): True, ("b", 0): False}


def test_two_phase_numbers(spark):
    rows = spark.range(0, 1000).selectExpr("(id * 7919) % 1000 * 3 AS ord")
    got = [(r.ord, r.n) for r in cards.numbered(rows.repartition(5), ["ord"], "n").orderBy("ord").collect()]
    assert got == [(i * 3, i + 1) for i in range(1000)]


def test_empty_generation_rules(spark):
    df = spark.createDataFrame([("all", []), ("any", []), ("none", ["x"])], "k string, n array<string>")
    names = F.array(F.lit("a"))
    assert [r.g for r in df.select(cards.generates(F.col("k"), F.col("n"), names, names).alias("g")).collect()] == [True, False, True]


def test_templates_without_a_rule(spark):
    """The front decides: literal text, shown fields, sections, special fields, and markup that leaves nothing."""
    fronts = ["{{A}}", "{{B}}", "{{#B}}x{{/B}}", "{{^B}}x{{/B}}", "{{! A }}", "<br>", "{{#A}}{{#B}}x{{/B}}{{/A}}", "{{Tags}}", "{{Deck}}", "{{hint:A}}", "{{^A}}x", "{{#Gone}}x{{/Gone}}", "{{C}}", "{{open"]
    made = "array<struct<name string, ord int, question_format string, rule_kind string, rule_fields array<string>, target_deck_name string>>"
    types = spark.createDataFrame([("t", "normal", ["A", "B", "C"], [(f, None, f, None, None, None) for f in fronts])], f"id string, kind string, fields array<string>, templates {made}")
    notes = spark.createDataFrame([("n", "t", {"A": "<b>word</b>", "B": "<div><br></div>&nbsp;", "C": "<img src=a.png>"}, "deck")], "id string, notetype_id string, fields map<string, string>, deck_name string")
    assert {r.template_name for r in cards.plan_cards(notes, types).collect()} == {"{{A}}", "{{^B}}x{{/B}}", "{{Deck}}", "{{hint:A}}", "{{C}}", "{{open"}


def test_malformed_deletions_make_the_cards_of_the_scanner(spark):
    df = spark.createDataFrame([(["{{c1::}}"],), (["{{c99999999999::x}}", "{{c2::y}}"],), (["{{c3::a}}{{c1::b}}"],), ([],), (["{{c2::{x} }}"],)], "t array<string>")
    assert [r.o for r in df.select(cards.card_ordinals(F.col("t")).alias("o")).collect()] == [[0], [1], [0, 2], [], [1]]


def test_generated_ids_leave_out_taken_ones(spark):
    notes = spark.createDataFrame([("d", i) for i in range(7)] + [("e:1", 0)], "deck string, ord bigint")
    taken = spark.createDataFrame([(x,) for x in ("generated:d:1", "generated:d:3", "generated:d:4", "generated:d:4", "generated:d:04", "generated:d:x", "generated:e:1:2", "generated:d:400", "own", None)], "stable_id string")
    got = {(r.deck, r.ord): r.id for r in identity.generated_ids(notes, taken).collect()}
    assert [got["d", i] for i in range(7)] == [f"generated:d:{n}" for n in (2, 5, 6, 7, 8, 9, 10)] and got["e:1", 0] == "generated:e:1:1"


def test_missing_reference_and_unused_binding(spark):
    refs = spark.createDataFrame([("a.png", True), ("b.png", True), ("http://x", True)], "raw_ref string, is_url boolean")
    bound = spark.createDataFrame([("m1", "a.png"), ("m2", "c.png")], "id string, export_filename string")
    found = normalize.resolve_references(refs, bound)
    assert {(r.raw_ref, r.resolution_status, r.media_id) for r in found.collect()} == {("a.png", "resolved", "m1"), ("b.png", "missing", None), ("http://x", "skipped", None)}
    assert [r.id for r in normalize.unused_bindings(bound, found).collect()] == ["m2"]


def test_inline_limit_is_tested_before_decoding(spark):
    df = spark.createDataFrame([("aGk=",), ("a" * 400,), ("%%%",)], "b string")
    assert [r.x for r in df.select(media.inline_bytes(F.col("b"), 100).alias("x")).collect()] == [bytearray(b"hi"), None, None]


def test_documents_are_read_with_a_schema(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"kind": "authoring", "metadata": {"document_id": "d"}, "notes": [{"id": "n1", "notetype_id": "t", "fields": {"Front": "x"}}, {"id": "n2"}]}')
    (tmp_path / "b.json").write_text("{broken")
    rows = entities.entity(entities.read_documents(spark, str(tmp_path), entities.AUTHORING), "notes").collect()
    assert [(r.ord, r.id, r.fields) for r in rows] == [(0, "n1", {"Front": "x"}), (1, "n2", None)]


def test_reports_are_projected(spark, tmp_path):
    for side, extra in (("left", "1"), ("right", "2")):
        (tmp_path / f"{side}.json").write_text('{"kind": "inspect", "observations": {"media": [{"selector": "m", "filename": "f", "object_id": "%s", "evidence_refs": ["e%s"]}]}}' % (extra, extra))
    rows = entities.read_reports(spark, str(tmp_path / "left.json"), str(tmp_path / "right.json"))
    left, right = (rows.where(F.col("side") == s).drop("side") for s in ("left", "right"))
    assert [r.payload for r in left.collect()] == ['{"filename":"f"}'] and release.diff(left, right).count() == 0


def test_unknown_kinds_are_kept(spark):
    body = '{"notes": [{"kind": "basic", "stable_id": "s"}, {"kind": "strange", "x": 1}]}'
    rows = entities.product_notes(spark.createDataFrame([("d", body)], "document_id string, body string")).collect()
    assert [(r.kind, r.stable_id, r.unknown) for r in rows] == [("basic", "s", None), ("strange", None, '{"kind":"strange","x":1}')]


def test_lockfile_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([("s2", "g2"), ("s1", "g1")], "stable_id string, guid string")
    entities.write_lockfile(entries, str(tmp_path / "lock"))
    assert {tuple(r) for r in spark.read.schema("stable_id string, guid string").json(str(tmp_path / "lock")).collect()} == {("s1", "g1"), ("s2", "g2")}


def test_package_round_trip(spark, tmp_path):
    notes = spark.createDataFrame([(1, "g1", 5, "t", "a\x1fb", "a", 7, 1)], "id bigint, guid string, mid bigint, tags string, flds string, sfld string, csum bigint, mtime bigint")
    path = str(tmp_path / "x.zip")
    assert len(package.write_package(notes, {"a.png": b"12345", "b.png": b"6"}, path)) == 40
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("meta", bytes([8, 3]))
        z.writestr("media", bytes([10, 7, 10, 5]) + b"a.png")
    (tmp_path / "latest.zip").write_bytes(made.getvalue())
    files = package.read_packages(spark, str(tmp_path / "*.zip"))
    rows = {(r.path.rsplit("/", 1)[1], r.entry): r for r in package.inspect_packages(files).collect()}
    assert rows["x.zip", "0"].size == 5 and rows["x.zip", "0"].version == "legacy1" and rows["x.zip", "1"].name == "b.png"
    assert rows["broken.zip", None].issue.startswith("unreadable")
    assert rows["latest.zip", "0"].issue == "missing_payload" and rows["latest.zip", "0"].version == "latest" and rows["latest.zip", "collection"].issue == "missing_collection"
    table = package.collection_tables(files.where("path LIKE '%/x.zip'"), "SELECT guid, flds FROM notes", "guid string, flds string").collect()
    assert [(r.guid, r.flds) for r in table] == [("g1", "a\x1fb")]


def test_fold_of_releases(spark, tmp_path):
    from relcast.streaming.fold import fold_releases

    source, sink = tmp_path / "in", tmp_path / "out"
    for release_no in (1, 2):
        spark.createDataFrame([("s1", f"c{release_no}", release_no)] + [("s2", "d", 2)] * (release_no == 2), "stable_id string, candidate string, release bigint").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("stable_id string, candidate string, release bigint").parquet(str(source))
        fold_releases(stream).writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = {(r.stable_id, r.releases): (r.guid, r.source) for r in spark.read.parquet(str(sink)).collect()}
    assert rows == {("s1", 1): ("c1", "current_derivation"), ("s1", 2): ("c1", "lockfile"), ("s2", 1): ("d", "current_derivation")}


def test_store_takes_each_content_once(spark, tmp_path):
    folder = str(tmp_path / "store")
    files = spark.createDataFrame([("a", b"1"), ("b", b"1"), ("c", b"22")], "path string, content binary")
    for _ in range(2):
        store.add_objects(files, folder)
    store.add_objects(spark.createDataFrame([("d", b"333")], "path string, content binary"), folder)
    assert sorted(r.size for r in spark.read.parquet(folder).collect()) == [1, 2, 3]
    assert store.verified(spark.read.parquet(folder)).count() == 0


def test_bundles_stay_inside_their_folder(spark, tmp_path):
    root = tmp_path / "bundle"
    root.mkdir()
    (root / "front.html").write_text("{{Front}}")
    manifest = '{"note_type": {"id": "t", "templates": [{"key": "k", "front_file": "%s"}]}}'
    (root / "anki-template.yaml").write_text(manifest % "front.html")
    assert {r.name: r.text for r in store.read_bundle(spark, str(root)).collect()}["front.html"] == "{{Front}}"
    (tmp_path / "secret.html").write_text("x")
    for name in ("../secret.html", "missing.html", str(tmp_path / "secret.html")):
        (root / "anki-template.yaml").write_text(manifest % name)
        with pytest.raises(ValueError, match="bundle"):
            store.read_bundle(spark, str(root))
