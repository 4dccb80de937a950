import io
import struct
import zipfile

from pyspark.sql import functions as F

from relcast.functions import text as tx
from relcast.operators import media, normalize, release
from relcast.plans import register
from relcast.sources import entities, package


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'binary' if isinstance(v, bytes) else 'string'}" for i, v in enumerate(values)))
    return df.select(column.alias("x")).first().x


def jpeg(width, height, extra=b""):
    frame = b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00"
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + extra + frame + b"\xff\xd9"


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


def test_raster_sizes(spark):
    lossless = b"\x2f" + struct.pack("<I", 639 | 479 << 14) + bytes(8)
    rows = {
        ("a.png", b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)): (640, 480),
        ("a.gif", b"GIF89a" + struct.pack("<HH", 300, 7)): (300, 7),
        ("a.jpg", jpeg(70_00, 513)): (7000, 513),
        ("a.jpeg", jpeg(5, 6, b"\xff\xc4\x00\x03\x01\xff\xff")[:-2] + b"\xff\xd9"): (5, 6),
        ("b.jpg", b"\xff\xd8\xff\xe0\x00\x40"): None,
        ("c.jpg", b"\xff\xd8\xff\xc4\x00\x02\xff\xda\x00\x00\x00\x00"): None,
        ("a.webp", webp(b"VP8 ", b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 800, 600))): (800, 600),
        ("b.webp", webp(b"VP8L", lossless)): (640, 480),
        ("c.webp", webp(b"VP8X", bytes(4) + (99_999).to_bytes(3, "little") + (0).to_bytes(3, "little"))): (100_000, 1),
        ("d.webp", webp(b"VP8 ", b"\x00\x00\x00\x9d\x01")): None,
        ("a.svg", b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)): None,
        ("e.png", b""): None,
    }
    df = spark.createDataFrame([*rows, ("n.png", None)], "name string, content binary")
    got = {r.name: None if r.s is None else tuple(r.s) for r in df.select("name", media.raster_size(F.col("name"), F.col("content")).alias("s")).collect()}
    assert got == {name: size for (name, _), size in rows.items()} | {"n.png": None}


def test_legacy_references(spark):
    cases = {
        "data='d' src=\"a b\" [sound:x.mp3] src=bare> src=": ["x.mp3", "a b", "bare", "d"],
        "src=> src='a&amp;b'": ["", "a&b"],
        "src='open src=\"never\" data=d": ["d"],
        "[sound:open src=s t": ["s"],
        "": [],
    }
    for text, want in cases.items():
        assert one(spark, tx.legacy_refs(F.col("c0")), text) == want


def test_artifact_paths(spark):
    want = {"p/x": "x", "p/./x//y": "x/y", "px/y": "px/y", "./p/x": "p/x", "p": "", "/p/x": None, "p/../x": None, "p/..x": "..x", "p/q/x": "q/x"}
    assert {r: one(spark, tx.artifact_path(F.col("c0"), F.lit("p/")), r) for r in want} == want
    assert one(spark, tx.artifact_path(F.col("c0"), F.lit("")), "a/b") == "a/b"


def test_modes(spark):
    none = F.lit(None).cast("string")
    mode = lambda *c: spark.range(1).select(release.effective_mode(*c).alias("m")).first().m
    assert tuple(mode(none, none, none, F.lit(False))) == ("disabled", None)
    assert tuple(mode(none, none, F.lit("x"), F.lit(False))) == ("strict", None)
    assert tuple(mode(F.lit("disabled"), F.lit("l"), none, F.lit(True))) == ("disabled", None)
    assert tuple(mode(F.lit("strict"), none, none, F.lit(True))) == (None, "UPDATE.LOCKFILE_PATH_REQUIRED")
    source = lambda *c: spark.range(1).select(release.inspected_source(*c).alias("m")).first().m
    assert source(none, F.lit(False), none, F.lit(False)) is None
    assert tuple(source(F.lit("s"), F.lit(False), F.lit("p"), F.lit(True))) == ("package", "p")
    assert tuple(source(F.lit("s"), F.lit(False), F.lit("p"), F.lit(False))) == ("staging", "s")


def test_collection_tables(spark, sf_dir):
    made = register.collected(spark, sf_dir)
    rows = lambda name, *columns: sorted(tuple(r) for r in made[name].select(*columns).collect())
    assert rows("decks", "id", "name") == [(1, "Default"), (2, "Target"), (3, "deck0"), (4, "deck1"), (5, "deck2")]
    assert rows("notetypes", "id", "name") == [(1, "Plain"), (2, "Turned")]
    assert rows("fields", "ntid", "ord", "name") == [(1, 0, "Front"), (1, 1, "Back"), (2, 0, "Back"), (2, 1, "Front")]
    assert rows("templates", "ntid", "ord", "name", "target_deck_id") == [(1, 0, "Card 1", 0), (2, 0, "Card 1", 0), (2, 1, "Card 2", 2)]


def test_lockfile_is_replaced_whole(spark, tmp_path):
    path, schema = str(tmp_path / "lock"), "stable_id string, guid string"
    entities.write_lockfile(spark.createDataFrame([("a", "1"), ("b", "2")], schema), path)
    entities.write_lockfile(spark.createDataFrame([("c", "3")], schema), path)
    assert [tuple(r) for r in spark.read.schema(schema).json(path).collect()] == [("c", "3")]
    broken = spark.createDataFrame([("d", "4")], schema).withColumn("guid", F.raise_error(F.lit("no")).cast("string"))
    try:
        entities.write_lockfile(broken, path)
        raise AssertionError("the job should have failed")
    except Exception as e:
        assert "no" in str(e)
    assert [tuple(r) for r in spark.read.schema(schema).json(path).collect()] == [("c", "3")]


def test_broken_packages_give_no_rows(spark):
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as archive:
        archive.writestr("collection.anki21b", b"\x28\xb5\x2f\xfdno")
    none = io.BytesIO()
    with zipfile.ZipFile(none, "w") as archive:
        archive.writestr("media", b"{}")
    files = spark.createDataFrame([("a", b"no archive"), ("b", empty.getvalue()), ("c", none.getvalue())], "path string, content binary")
    assert package.collection_tables(files, "SELECT id FROM notes", "id bigint").count() == 0


def test_stock_image_occlusion(spark):
    schema = f"id string, kind string, name string, fields {normalize.NOTETYPE_FIELDS}, templates {normalize.NOTETYPE_TEMPLATES}"
    row = normalize.expand_stock(spark.createDataFrame([("io", "image_occlusion", None, None, None)], schema), normalize.stock_catalog(spark)).first()
    assert (row.kind, row.name, row.issue, [f.name for f in row.fields]) == ("cloze", "Image Occlusion", None, ["Occlusion", "Image", "Header", "Back Extra", "Comments"])
    front, back = row.templates[0].question_format, row.templates[0].answer_format
    assert front.endswith("</script>\n") and back.startswith(front) and back.endswith("{{#Back Extra}}<div>{{Back Extra}}</div>{{/Back Extra}}\n")
    assert row.css.startswith("#image-occlusion-canvas {\n") and row.css.endswith("    background-color: white;\n}\n")


def test_embedded_identities_and_reports(spark, tmp_path):
    texts = [
        '{"schema_version":"identity-note-v1","stable_id":"a","selected_anki_guid":"g","provenance":"explicit","used_override":true}',
        '{"schema_version":"identity-note-v1","stable_id":"b"}',
        '{"schema_version":"identity-note-v1"}',
        '{"schema_version":"other","stable_id":"c"}',
        "no json",
        None,
    ]
    rows = release.embedded_identities(spark.createDataFrame([("p", t) for t in texts], "source_path string, payload string"))
    got = {r.stable_id: (r.guid, r.candidate, r.recipe_id, r.provenance, r.used_override, r.limitation) for r in rows.collect()}
    assert got == {
        "a": ("g", "a", "unknown", "explicit", True, None),
        "b": ("b", "b", "unknown", "unknown_baseline", False, "unknown_baseline_provenance"),
        None: (None, None, "unknown", "unknown_baseline", False, "identity_metadata_malformed"),
    }
    found = release.limitations(rows, "source_path", "limitation").first()
    assert found.limitations == ["identity_metadata_malformed", "unknown_baseline_provenance"]
    entities.write_reports(rows.select("stable_id", "guid"), str(tmp_path / "report"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "report")).collect()) == ['{"stable_id":"a","guid":"g"}', '{"stable_id":"b","guid":"b"}', "{}"]
