"""From written documents to resolved ones: expansion of stock types, unpivoting of surfaces, resolving references, checks.

Checks return rows of one schema (stage_rank, ord, level, code, path, summary), so that all of them can be united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import classified

#: The stock record types.
CLOZE_CSS = ".cloze {\n    font-weight: bold;\n    color: blue;\n}\n.nightMode .cloze {\n    color: lightblue;\n}\n"
OCCLUSION_FRONT = """{{#Header}}<div>{{Header}}</div>{{/Header}}
<div style="display: none">{{cloze:Occlusion}}</div>
<div id="err"></div>
<div id="image-occlusion-container">
    {{Image}}
    <canvas id="image-occlusion-canvas"></canvas>
</div>
<script>
try {
    anki.imageOcclusion.setup();
} catch (exc) {
    document.getElementById("err").innerHTML = `Error loading image occlusion<br><br>${exc}`;
}
</script>
"""
OCCLUSION_BACK = f"""{OCCLUSION_FRONT}
<div><button id="toggle">Toggle Masks</button></div>
{{{{#Back Extra}}}}<div>{{{{Back Extra}}}}</div>{{{{/Back Extra}}}}
"""
OCCLUSION_CSS = """#image-occlusion-canvas {
    --inactive-shape-color: #ffeba2;
    --active-shape-color: #ff8e8e;
    --inactive-shape-border: 1px #212121;
    --active-shape-border: 1px #212121;
    --highlight-shape-color: #ff8e8e00;
    --highlight-shape-border: 1px #ff8e8e;
}

.card {
    font-family: arial;
    font-size: 20px;
    text-align: center;
    color: black;
    background-color: white;
}
"""
STOCK = (
    ("basic", "normal", "Basic", ["Front", "Back"], [("Card 1", "{{Front}}", "{{FrontSide}}\n\n<hr id=answer>\n\n{{Back}}")], ""),
    ("cloze", "cloze", "Cloze", ["Text", "Back Extra"], [("Cloze", "{{cloze:Text}}", "{{cloze:Text}}<br>\n{{Back Extra}}")], CLOZE_CSS),
    ("image_occlusion", "cloze", "Image Occlusion", ["Occlusion", "Image", "Header", "Back Extra", "Comments"], [("Image Occlusion", OCCLUSION_FRONT, OCCLUSION_BACK)], OCCLUSION_CSS),
)
NOTETYPE_FIELDS = "array<struct<name string, ord int>>"
NOTETYPE_TEMPLATES = "array<struct<name string, ord int, question_format string, answer_format string>>"


def stock_catalog(spark: SparkSession) -> DataFrame:
    """The stock types as rows; three of them, so a join with it is planned as a broadcast."""
    rows = [(stock, kind, name, list(enumerate(fields)), list(enumerate(templates)), css) for stock, kind, name, fields, templates, css in STOCK]
    made = [(s, k, n, [(f, i) for i, f in fields], [(t[0], i, t[1], t[2]) for i, t in templates], css) for s, k, n, fields, templates, css in rows]
    return spark.createDataFrame(made, f"stock string, stock_kind string, stock_name string, stock_fields {NOTETYPE_FIELDS}, stock_templates {NOTETYPE_TEMPLATES}, stock_css string")


def expand_stock(notetypes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Types with fields and templates: their own, or the stock's; ``issue`` says why a type has neither.

    ``notetypes`` has id, kind, name, fields and templates (null if not given).
    """
    joined = notetypes.join(F.broadcast(catalog), notetypes["kind"] == catalog["stock"], "left")
    given, half = F.col("fields").isNotNull() & F.col("templates").isNotNull(), F.col("fields").isNull() != F.col("templates").isNull()
    issue = F.when(half, "PARTIAL_PAYLOAD").when(~given & F.col("stock").isNull(), "UNSUPPORTED_KIND")
    return joined.select(
        "id",
        F.coalesce("stock_kind", F.lit("normal")).alias("kind"),
        F.col("stock").alias("original_stock_kind"),
        F.coalesce("name", "stock_name").alias("name"),
        F.when(given, F.col("fields")).when(~half, F.col("stock_fields")).alias("fields"),
        F.when(given, F.col("templates")).when(~half, F.col("stock_templates")).alias("templates"),
        F.when(~given, F.col("stock_css")).alias("css"),
        issue.alias("issue"),
    )


def same_shape(notetypes: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, fields_equal, templates_equal, css_equal) of the types that claim to be stock."""
    joined = notetypes.join(F.broadcast(catalog), notetypes["original_stock_kind"] == catalog["stock"])
    names = lambda c: F.transform(F.array_sort(F.transform(c, lambda f: F.struct(f["ord"], f["name"]))), lambda f: f["name"])
    return joined.select("id", names("fields").eqNullSafe(names("stock_fields")).alias("fields_equal"), F.col("templates").eqNullSafe(F.col("stock_templates")).alias("templates_equal"), F.col("css").eqNullSafe(F.col("stock_css")).alias("css_equal"))


def surfaces(notes: DataFrame, notetypes: DataFrame) -> DataFrame:
    """(owner_kind, owner_id, location_kind, location_name, text): everything that may hold references."""
    fields = notes.select(F.lit("note").alias("owner_kind"), F.col("id").alias("owner_id"), F.lit("field").alias("location_kind"), F.explode("fields").alias("location_name", "text"))
    sides = F.array(*[F.struct(F.lit(c).alias("location_kind"), F.col(c).alias("text")) for c in ("question_format", "answer_format", "browser_question_format", "browser_answer_format")])
    opened = notetypes.select("id", F.inline("templates"))
    for c in ("browser_question_format", "browser_answer_format"):
        if c not in opened.columns:
            opened = opened.withColumn(c, F.lit(None).cast("string"))
    templates = opened.select("id", "name", F.inline(sides)).select(F.lit("notetype").alias("owner_kind"), F.col("id").alias("owner_id"), "location_kind", F.col("name").alias("location_name"), "text")
    css = notetypes.select(F.lit("notetype").alias("owner_kind"), F.col("id").alias("owner_id"), F.lit("css").alias("location_kind"), F.lit("").alias("location_name"), F.col("css").alias("text"))
    return fields.unionByName(templates).unionByName(css).where("text IS NOT NULL")


def resolve_references(references: DataFrame, bindings: DataFrame) -> DataFrame:
    """References (with raw_ref and is_url) with resolution_status, media_id and skip_reason.

    The binding's export_filename must equal the local name; what isn't local is skipped with a reason.
    """
    sorted_out = references.withColumn("__c", classified(F.col("raw_ref"), F.col("is_url")))
    known = bindings.select(F.col("export_filename").alias("__name"), F.col("id").alias("__media"))
    joined = sorted_out.join(known, F.col("__c.local") == F.col("__name"), "left")
    status = F.when(F.col("__c.status") != "local", "skipped").when(F.col("__media").isNotNull(), "resolved").otherwise("missing")
    return joined.select(*references.columns, status.alias("resolution_status"), F.col("__media").alias("media_id"), F.col("__c.reason").alias("skip_reason"), (F.col("__c.status") == "unsafe").alias("unsafe"))


def unused_bindings(bindings: DataFrame, resolved: DataFrame) -> DataFrame:
    return bindings.join(resolved.where("resolution_status = 'resolved'").select(F.col("media_id").alias("id")), "id", "left_anti")


def dangling(rows: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key isn't in ``target``."""
    return rows.join(target.select(F.col(target_key).alias(key)), key, "left_anti")


def unknown_notetypes(notes: DataFrame, notetypes: DataFrame) -> DataFrame:
    return dangling(notes, "notetype_id", notetypes, "id").select(F.col("id").alias("note_id"), "notetype_id", F.lit("PHASE3.UNKNOWN_NOTETYPE_ID").alias("code"))


def field_set_mismatch(notes: DataFrame, notetypes: DataFrame) -> DataFrame:
    """Notes whose field names aren't exactly those of their type: (note_id, missing, unknown)."""
    declared = notetypes.select(F.col("id").alias("notetype_id"), F.transform("fields", lambda f: f["name"]).alias("declared"))
    both = notes.select(F.col("id").alias("note_id"), "notetype_id", F.map_keys("fields").alias("given")).join(declared, "notetype_id")
    lists = both.select("note_id", F.array_sort(F.array_except("declared", "given")).alias("missing"), F.array_sort(F.array_except("given", "declared")).alias("unknown"))
    return lists.where((F.size("missing") > 0) | (F.size("unknown") > 0))


def duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) of every row that repeats an earlier key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n > 1").select(key, order)


def invalid_rows(notes: DataFrame, notetypes: DataFrame, objects: DataFrame) -> DataFrame:
    """(code, subject): values that no document may have."""
    checks = [
        notes.where("mtime_secs < 1").select(F.lit("NOTE.MTIME_INVALID").alias("code"), F.col("id").alias("subject")),
        notetypes.where("kind NOT IN ('normal', 'cloze')").select(F.lit("NOTETYPE.KIND_INVALID").alias("code"), F.col("id").alias("subject")),
        objects.where(~object_is_sound(F.col("id"), F.col("object_ref"), F.col("digest"), F.col("sha1"), F.col("mime"))).select(F.lit("MEDIA.OBJECT_INVALID").alias("code"), F.col("id").alias("subject")),
    ]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


def object_is_sound(id_: Column, ref: Column, digest: Column, sha1: Column, mime: Column) -> Column:
    named = (id_ == F.concat(F.lit("obj:blake3:"), digest)) & (ref == F.concat(F.lit("media://blake3/"), digest))
    return F.coalesce(named & digest.rlike("^[0-9a-f]{64}$") & sha1.rlike("^[0-9a-f]{40}$") & (F.trim(mime) != ""), F.lit(False))


def document_identity(mode: Column, document_id: Column, external: Column, nonce: Column) -> Column:
    """``det:``, ``ext:`` or ``rnd:`` id; the nonce of a random one is the caller's."""
    return F.when(mode == "external", F.concat(F.lit("ext:"), external)).when(mode == "random", F.concat(F.lit("rnd:"), nonce)).otherwise(F.concat(F.lit("det:"), document_id))


def merge_risk(strict: Column, baseline_ref: Column, kind: Column) -> Column:
    """struct(comparison_status, overall_level) of a comparison context."""
    out = lambda s, l: F.struct(F.lit(s).alias("comparison_status"), F.lit(l).alias("overall_level"))  # noqa: E731, E741
    return F.when(strict & (F.trim(F.coalesce(baseline_ref, F.lit(""))) == ""), out("unavailable", "high")).when(kind == "identity_index", out("partial", "medium")).otherwise(out("complete", "low"))


# --- lowering ----------------------------------------------------------------------------------------------------------


def lower_notes(notes: DataFrame, fields: DataFrame, media: DataFrame) -> DataFrame:
    """Product notes to plain ones: keys become field names and contents text.

    ``notes`` has id, notetype_id and contents (map of key to struct kind, value, media_id), ``fields`` notetype_id, key,
    name and required, ``media`` id and export_as. Unknown keys, missing required fields and missing media are listed in
    ``issues``; missing media render as empty text.
    """
    declared = fields.groupBy("notetype_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "name")))).alias("names"), F.array_sort(F.collect_list(F.when(F.col("required"), F.col("key")))).alias("needed"))
    parts = notes.select("id", "notetype_id", F.explode_outer("contents").alias("key", "content"))
    known = media.select(F.col("id").alias("__media"), "export_as")
    joined = parts.join(declared.select("notetype_id", "names"), "notetype_id", "left").join(known, F.col("content.media_id") == F.col("__media"), "left")
    file = F.coalesce("export_as", F.lit(""))
    text = F.when(F.col("content.kind") == "image", F.when(file != "", F.concat(F.lit('<img src="'), file, F.lit('">'))).otherwise("")).when(F.col("content.kind") == "audio", F.when(file != "", F.concat(F.lit("[sound:"), file, F.lit("]"))).otherwise("")).otherwise(F.col("content.value"))
    name = F.try_element_at("names", F.col("key"))
    lost = F.col("content.media_id").isNotNull() & F.col("__media").isNull()
    issue = F.when(F.col("key").isNotNull() & name.isNull(), F.concat(F.lit("PRODUCT.FIELD_UNKNOWN:"), "key")).when(lost, F.concat(F.lit("PRODUCT.MEDIA_UNKNOWN:"), F.col("content.media_id")))
    rows = joined.select("id", "notetype_id", "key", name.alias("name"), text.alias("text"), issue.alias("issue"))
    grouped = rows.groupBy("id", "notetype_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "text"))))).alias("fields"), F.array_sort(F.collect_list("issue")).alias("found"), F.collect_set("key").alias("keys"))
    full = grouped.join(declared.select("notetype_id", "needed"), "notetype_id", "left")
    absent = F.transform(F.array_except(F.coalesce("needed", F.array().cast("array<string>")), "keys"), lambda k: F.concat(F.lit("PRODUCT.FIELD_REQUIRED:"), k))
    return full.select("id", "notetype_id", "fields", F.array_sort(F.concat("found", absent)).alias("issues"))


def append_fonts(notetypes: DataFrame, fonts: DataFrame, assets: DataFrame) -> DataFrame:
    """Style sheets with an ``@font-face`` rule for every font binding whose type and asset exist, in order of family."""
    bound = fonts.join(assets.select(F.col("id").alias("asset_id"), "export_as"), "asset_id").groupBy("notetype_id").agg(F.array_sort(F.collect_list(F.struct("family", "export_as"))).alias("faces"))
    rule = lambda f: F.concat(F.lit('@font-face { font-family: "'), f["family"], F.lit('"; src: url("'), f["export_as"], F.lit('"); }'))
    joined = notetypes.join(bound, notetypes["id"] == bound["notetype_id"], "left")
    return joined.select("id", F.concat_ws("\n", "css", F.array_join(F.transform("faces", rule), "\n")).alias("css"))


def source_paths(diagnostics: DataFrame, paths: DataFrame) -> DataFrame:
    """Diagnostics with the product path of their target: of the exact key, its owner or its document."""
    for place, key in enumerate(("path_key", "owner_key", "document_key")):
        diagnostics = diagnostics.join(paths.select(F.col("key").alias(key), F.col("source_path").alias(f"__p{place}")), key, "left")
    return diagnostics.withColumn("source_path", F.coalesce("__p0", "__p1", "__p2")).drop("__p0", "__p1", "__p2")


# --- diagnostics ----------------------------------------------------------------------------------------------------------

DIAGNOSTIC_KEY = ["level", "code", "summary", "path", "domain", "stage"]
SEVERITIES = ("error", "warning", "info")


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def samples(diagnostics: DataFrame, n: int = 3) -> DataFrame:
    """(code, n, sources): count and first sources of each code; only ``n`` rows of a code leave a task for the list."""
    counts = diagnostics.groupBy("code").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("code").orderBy("ord"))
    first = diagnostics.withColumn("__n", place).where(F.col("__n") <= n).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("__n", "source"))).alias("s"))
    return counts.join(first, "code").select("code", "n", F.transform("s", lambda r: r["source"]).alias("sources"))


def severity_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), level)


def ordered(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.orderBy(severity_rank(F.col("level")), F.coalesce("path", F.lit("")), "code", "summary")


def downgraded(level: Column, code: Column, report_only: Column) -> Column:
    """Errors about updates and comparisons are warnings where a release only reports them."""
    return F.when(report_only & (level == "error") & code.rlike(r"^(UPDATE|COMPARE)\."), "warning").otherwise(level)


def united(*stages: DataFrame) -> DataFrame:
    """All diagnostics, with the place of their stage; order by (stage_rank, ord)."""
    out = None
    for rank, rows in enumerate(stages):
        rows = rows.withColumn("stage_rank", F.lit(rank))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def build_status(diagnostics: DataFrame) -> DataFrame:
    """One row: warnings, first error code and whether the result is invalid."""
    error = F.col("level") == "error"
    return diagnostics.agg(F.count_if(F.col("level") == "warning").alias("warnings"), F.min_by(F.when(error, F.col("code")), F.when(error, F.col("ord"))).alias("first_error"), F.when(F.coalesce(F.bool_or(error), F.lit(False)), "invalid").otherwise("success").alias("status"))
