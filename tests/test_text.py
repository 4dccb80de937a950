import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relcast.functions import scanners
from relcast.functions import text as tx
from relcast.functions.blake3 import blake3_hex
from relcast.operators import identity, selectors
from relcast.plans import register
from tests import twins

#: Own probes of the rules: entities, tags, comments, raw text, quoted signs, media and where their name is looked for.
STRIPPED = [
    ("", ""),
    ("no markup at all", "no markup at all"),
    ("5 &lt; 6 &amp;&amp; 7 &#62; 6", "5 < 6 && 7 > 6"),
    ("<p class=x>one</p>, <em>two</em>", "one, two"),
    ("x<!-- <img src=no.gif> -->y", "xy"),
    ("<STYLE>p { color: red }</STYLE>kept<script>if (a < b) { go('</p>') }</script>", "kept"),
    ("3 < 4", "3 < 4"),
    ("ends in <i", "ends in <i"),
    ("<p title='a > b'>quoted</p>", "quoted"),
    ("look:<img width=4 src='a b.gif' alt=x>", "look: a b.gif "),
    ("<Img Src = q&#46;webp >", " q.webp "),
    ("<object type=x data='d.pdf'>inside</object>", " d.pdf inside"),
    ("<audio src=one.ogg></audio><video src=two.mkv></video>", " one.ogg  two.mkv "),
    ("<p src=none.gif>no medium</p>", "no medium"),
    ("<img title='src=none.gif'>", ""),
]


@pytest.mark.parametrize(("html", "plain"), STRIPPED)
def test_strip_html(html, plain):
    assert scanners.strip_html(html) == plain


#: Entities are closed by a semicolon; what isn't one stays as it is written.
ENTITIES = [
    ("<title>a&amp;&amp</title><p>Tea", "a&&ampTea"),
    ("&amp&amp;&quot &copy2 &notin &notin;", "&amp&&quot &copy2 &notin ∉"),
    ("&amp;amp; &amp;&#35;38; &&lt;", "&amp; &#38; &<"),
    ("&nosuch; &; &#; &#x; &#xD800; &#1114112; &#65 &#" + "9" * 5000 + ";", "&nosuch; &; &#; &#x; &#xD800; &#1114112; &#65 &#" + "9" * 5000 + ";"),
    ("&#" + "0" * 5000 + "65; &#x42; &#X43; &#128;", "A B C \x80"),
]


@pytest.mark.parametrize(("html", "plain"), ENTITIES)
def test_entities_are_closed(html, plain):
    assert scanners.strip_html(html) == plain


def test_strip_queries_equal_their_twins_on_cut_entities(spark, tmp_path):
    pages = [(1, "<head><title>a&amp;&amp</title></head><body>Tea &quot;x&quot</body>"), (2, "&copy<b>x</b>&middot<i>y</i>&amp;quot;"), (3, None)]
    spark.createDataFrame(pages, "page_id bigint, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    for name in ("html_strip", "html_strip_exact"):
        assert twins.rows_of(register.QUERIES[name](spark, str(tmp_path))) == twins.twin_rows(twins.connect(str(tmp_path)), register.ORACLE_SQL[name])


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_strip_html_takes_any_text(html):
    assert isinstance(scanners.strip_html(html), str)


@settings(max_examples=100, deadline=None)
@given(st.sampled_from(["img", "audio", "video", "source", "object"]), st.sampled_from(["src", "data"]), st.from_regex(r"[A-Za-z0-9_.-]{1,32}", fullmatch=True), st.sampled_from(['"', "'", ""]), st.from_regex(r"[A-Za-z0-9_-]{0,12}", fullmatch=True), st.from_regex(r"[A-Za-z0-9_ >-]{0,12}", fullmatch=True))
def test_media_names_survive(tag, attr, name, quote, before, after):
    assert scanners.strip_html(f'<{tag} title="{before} >" {attr}={quote}{name}{quote} data-note="{after}">') == f" {name} "


def test_checksums(spark):
    """The first 32 bits of the SHA-1 of the plain text."""
    texts = ["", "one", "ünï", " picture.gif ", "a\nb" * 300]
    df = spark.createDataFrame([(t, int(hashlib.sha1(t.encode()).hexdigest()[:8], 16)) for t in texts], "t string, n bigint")
    assert df.where(tx.field_checksum(F.col("t")) != F.col("n")).count() == 0


REFERENCES = [
    ("hero.png", True, "local", None, "hero.png"),
    ("", True, "skipped", "empty-ref", None),
    ("   ", True, "skipped", "empty-ref", None),
    ("{{Image}}", True, "skipped", "dynamic-template-expression", None),
    ("a.png?x={{y}}", True, "local", None, "a.png"),
    ("//host/a.png", True, "skipped", "protocol-relative-url", None),
    ("DATA:image/png;base64,AA", True, "skipped", "data-uri", None),
    ("https://host/a.png", True, "skipped", "external-url", None),
    ("a%2", True, "unsafe", "invalid-percent-encoding", None),
    ("a%ff.png", True, "unsafe", "invalid-percent-encoding", None),
    ("%20", True, "skipped", "empty-ref", None),
    ("%2e%2e", True, "unsafe", "decoded-dot-path", None),
    ("a%2Fb.png", True, "unsafe", "decoded-path-separator", None),
    ("a\\b.png", False, "unsafe", "decoded-path-separator", None),
    ("bg%5Fone.png?v=1#f", True, "local", None, "bg_one.png"),
    ("space%20name.png", True, "unsafe", "helper-unsafe-character", None),
    ("space%20name.mp3", False, "unsafe", "helper-unsafe-character", None),
    ("a+b.png", True, "unsafe", "helper-unsafe-character", None),
    (" hero.png ", False, "local", None, "hero.png"),
    (" hero.png ", True, "unsafe", "helper-unsafe-character", None),
]


def test_classification(spark):
    df = spark.createDataFrame(REFERENCES, "raw string, is_url boolean, status string, reason string, local string")
    got = df.withColumn("c", tx.classified(F.col("raw"), F.col("is_url"))).collect()
    assert [(r.raw, r.c.status, r.c.reason, r.c.local) for r in got] == [(r.raw, r.status, r.reason, r.local) for r in got]


def test_reference_scan():
    found = scanners.references('[sound:bell.mp3] <img src="hero.png"><source src=\'clip.webm\'><object data=diagram.svg></object>\n<style>.card { background: url("bg%20one.png?v=1#f"); }</style><p style="background:url(in.png)">')
    assert [(r["kind"], r["raw"]) for r in found] == [("sound", "bell.mp3"), ("html_src", "hero.png"), ("html_src", "clip.webm"), ("html_object_data", "diagram.svg"), ("css_url", "bg%20one.png?v=1#f"), ("css_url", "in.png")]
    assert found[4]["line"] == 2


def test_css_urls():
    assert scanners.css_urls(".a { background: url( hero.png); } .b { background: url(hero.png ); } .c { background: url(   ); }") == [("hero.png", 1), ("hero.png", 1), ("   ", 1)]
    assert scanners.css_urls(".bad { background: url(bad.png; }\n.ok { background: url(ok.png); }") == [("ok.png", 2)]
    assert scanners.css_urls("/* url(no.png) */ a{b:url('x\\'y.png')} my-url(z.png)") == [("x\\'y.png", 1)]


#: Own probes: order and repeats, no deletion, each way to be malformed, and what still counts then.
CLOZE = [
    ("no braces", [], False),
    ("{{Field}} {{cat}}", [], False),
    ("{{c3::late}} and {{c2::early::hint}}, again {{c3::late}}", [1, 2], False),
    ("{{c12::x}}", [11], False),
    ("{{c4::}}", [3], True),
    ("{{c0::nothing}}", [], True),
    ("{{c5 x}} {{c1::ok}}", [0], True),
    ("{{c::x}} {{c1::ok}}", [0], True),
    ("{{c1::ok}} {{c2::open", [0], True),
    ("{{c7::around {{c8::within}}", [6], True),
    ("{{c4294967296::x}}{{c1::ok}}", [0], True),
]


@pytest.mark.parametrize(("source", "ords", "malformed"), CLOZE)
def test_cloze_ordinals(source, ords, malformed):
    assert scanners.cloze_ordinals(source) == (ords, malformed)


TEMPLATES = [
    ("{{Front}}", []),
    ("}}", ["SYNTAX_INVALID"]),
    ("{{Front", ["SYNTAX_INVALID"]),
    ("{{ }}", ["SYNTAX_INVALID"]),
    ("{{#Front}}x", ["SECTION_MISMATCH"]),
    ("{{#Front}}{{/Back}}", ["SECTION_MISMATCH"]),
    ("{{/Front}}", ["SECTION_MISMATCH"]),
    ("{{Nope}}", ["RENDER_FIELD_UNKNOWN"]),
    ("{{odd:Front}}", ["FILTER_UNKNOWN"]),
    ("{{hint:cloze:Front}} {{Tags}} {{! note}}", []),
]


@pytest.mark.parametrize(("source", "codes"), TEMPLATES)
def test_template_issues(source, codes):
    assert [i["code"] for i in scanners.template_issues(source, ["Front", "Back"])] == [f"TEMPLATE.{c}" for c in codes]


def test_template_offsets_are_in_bytes():
    assert scanners.template_issues("é{{Nope}}", [])[0]["byte_offset"] == 2


def test_blake3_of_the_specification():
    data = bytes(i % 251 for i in range(5000))
    assert blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3_hex(data[:1]) == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert blake3_hex(data[:1025]) == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert blake3_hex(data[:4096]) == "015094013f57a5277b59d8475c0501042c0b642e531b0a1c8f58d2163229e969"


IDENTITIES = [
    ("basic", "hola", "afid:v1:b836a16e47a09798127f94f8f98596dcd2cba5ec035d289b40b53105f56d4f3b"),
    ("cloze", "Capital of {{c1::France::country}} is {{c2::Paris::city}}", "afid:v1:6da7fb8b7dc4709145024214643bcbe40a04f2040ed13c0b01081cc9f1e63042"),
    ("cloze", "A {{c1::B}} C", "afid:v1:a3c267daac1606186f6360b3e41c375c63ac35ccb54ac9b5fb75dc654d042cb6"),
    ("cloze", "Capital of {{c1::France is Paris", None),
]


def test_identities(spark):
    df = spark.createDataFrame(IDENTITIES, "kind string, t string, want string")
    made = df.withColumn("got", F.when(F.col("kind") == "basic", identity.stable_id(identity.basic_payload(F.col("t")))).otherwise(identity.stable_id(identity.cloze_payload(F.col("t")))))
    assert [r.got for r in made.collect()] == [w for _, _, w in IDENTITIES]


def test_mask_identity_ignores_order(spark):
    rect = "struct<x bigint, y bigint, width bigint, height bigint>"
    df = spark.createDataFrame([([(100, 40, 30, 40), (10, 20, 30, 40)],), ([(10, 20, 30, 40), (100, 40, 30, 40)],)], f"s array<{rect}>")
    size = lambda n: F.lit(n).cast("string")
    made = df.select(identity.stable_id(identity.mask_payload(F.lit("19b6af3663413eb7104f5c5537d910c6d94d6f6f"), size(228), size(86), F.lit("hide_all_guess_one"), F.col("s"))).alias("i"))
    assert {r.i for r in made.collect()} == {"afid:v1:160885c35c11555ed3e35dbf963ed4b699fa6b4ab95681ae0955e163d6f0f286"}


def test_identity_text_is_in_normal_form_with_unix_lines(spark):
    df = spark.createDataFrame([("é\r\nx\r ",), ("a\r\nb",)], "t string")
    values = [json.loads(r.p)["components"]["selected_fields"][0]["value"] for r in df.select(identity.basic_payload(F.col("t")).alias("p")).collect()]
    assert values == ["é\nx\n ", "a\nb"]


def test_control_characters_have_lower_case_hex(spark):
    assert spark.range(1).select(tx.json_text(F.lit("a\x1fb\x0b")).alias("j")).first().j == '"a\\u001fb\\u000b"'


@pytest.mark.parametrize(
    ("source", "reason"),
    [("", "Empty"), ("note[id='n1']/fields[12]", "ArrayIndexNotAllowed"), ("note", "InvalidPredicate"), ("note[id='n1'][deck='d1']", "InvalidPredicate"), ("note[id=n1]", "InvalidPredicate"), ("note[id='a',id='b']", "InvalidPredicate"), ("note[id='a',]", "InvalidPredicate")],
)
def test_bad_selectors(source, reason):
    with pytest.raises(selectors.SelectorError) as e:
        selectors.parse(source)
    assert e.value.reason == reason


def test_selectors(spark):
    assert selectors.parse("note[id='a/b']").predicates == (("id", "a/b"),)
    assert selectors.parse("note[id='x[12]y', k=\"a,b]\"]").predicates == (("id", "x[12]y"), ("k", "a,b]"))
    df = spark.createDataFrame([("note", {"id": "1"}), ("note", {"id": "2"}), ("note", {"id": "2"})], "kind string, attributes map<string, string>")
    assert selectors.resolve(selectors.parse("note[id='1']"), df).attributes == {"id": "1"}
    for source, reason in (("note[id='3']", "Unmatched"), ("note[id='2']", "Ambiguous"), ("card[id='1']", "Unmatched")):
        with pytest.raises(selectors.SelectorError) as e:
            selectors.resolve(selectors.parse(source), df)
        assert e.value.reason == reason


def test_wrapped_fronts(spark):
    df = spark.createDataFrame([("all", ["A", "B"]), ("any", ["A", "B"]), ("any", []), ("none", ["A"])], "k string, f array<string>")
    got = [r.w for r in df.select(tx.wrapped_front(F.lit("x"), F.col("k"), F.col("f")).alias("w")).collect()]
    assert got == ["{{#A}}{{#B}}x{{/B}}{{/A}}", "{{#A}}x{{/A}}{{^A}}{{#B}}x{{/B}}{{/A}}", "", "x"]


SNIFFS = [
    (b"\xff\xf1\x50\x80", "audio/aac", True), (b"\xff\xf8", "audio/aac", True), (b"\xff\xf4", None, None),
    (b"\0\0\0\x18ftypM4A ", "audio/mp4", True), (b"\0\0\0\x18ftypisom", "video/mp4", True), (b"\0\0\0\x18ftypiso", None, None),
    (b"\x1a\x45\xdf\xa3" + b"\x9f" * 2043 + b"WebM", "video/webm", True), (b"\x1a\x45\xdf\xa3" + b"\x9f" * 2044 + b"webm", None, None),
    (b"\0\1\0\0\0\x0c\0\x80\0\x03\0\x40", "font/ttf", True), (b"true\0\x08\0\x80\0\x03\0\0", "font/ttf", True), (b"OTTO\0\x01\0\x10\0\0\0\0", "font/otf", True), (b"\0\1\0\0\0\x0c\0\x80\0\x03\0\x41", None, None), (b"\0\1\0\0\0\0\0\0\0\0\0\0", None, None),
    (b"just words\n", "text/plain", False), (b"\n <Head>", "text/html", False), (b"const a = 1", "text/javascript", False), (b" @import 'a'", "text/css", False), (b".a { b: c }", "text/css", False), (b".a b", "text/plain", False),
    (b"", None, None), (b"nul\0", None, None), ("\u00fc".encode(), None, None), (b"x" * 8192 + b"\xff", "text/plain", False), (b"%PDF-1.7", "application/pdf", True),
]


def test_sniffed_kinds(spark):
    rows = spark.createDataFrame([(i, bytearray(b)) for i, (b, _, _) in enumerate(SNIFFS)], "i int, b binary").select("i", tx.sniffed(F.col("b")).alias("s"))
    assert [(r.s and r.s.mime, r.s and r.s.high) for r in rows.orderBy("i").collect()] == [(m, h) for _, m, h in SNIFFS]
