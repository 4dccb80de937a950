"""Scalar functions over columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Media types by file extension.
MIME_BY_EXTENSION = {
    "aac": "audio/aac", "css": "text/css", "gif": "image/gif", "htm": "text/html", "html": "text/html", "jpeg": "image/jpeg",
    "jpg": "image/jpeg", "js": "text/javascript", "m4a": "audio/mp4", "m4v": "video/mp4", "mjs": "text/javascript",
    "mp3": "audio/mpeg", "mp4": "video/mp4", "oga": "audio/ogg", "ogg": "audio/ogg", "opus": "audio/opus", "otf": "font/otf",
    "pdf": "application/pdf", "png": "image/png", "svg": "image/svg+xml", "ttf": "font/ttf", "wav": "audio/wav",
    "weba": "audio/webm", "webm": "video/webm", "webp": "image/webp", "woff": "font/woff", "woff2": "font/woff2",
}
OCTET_STREAM = "application/octet-stream"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


# --- HTML ---------------------------------------------------------------------------------------------------------


def decode_entities(c: Column) -> Column:
    """The entities of well-formed text; ``&amp;`` last, so that nothing is decoded twice."""
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.replace(c, F.lit(" "), F.lit(" "))


def strip_html(c: Column) -> Column:
    """Plain text of well-formed HTML: no comments, scripts, styles or tags; a medium becomes its file name between spaces.

    ``scanners.strip_html`` has the exact rules for malformed input.
    """
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    c = F.regexp_replace(c, r"""(?is)<(?:img|audio|video|source|object)\b[^>]*?\s(?:src|data)\s*=\s*["']([^"']*)["'][^>]*>""", " $1 ")
    return decode_entities(F.regexp_replace(c, r"(?s)<[^>]*>", ""))


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def is_blank(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", " ")) == ""


# --- digests and canonical forms ------------------------------------------------------------------------------------


def field_checksum(stripped: Column) -> Column:
    """The first four SHA-1 bytes as a number."""
    return F.conv(F.substring(F.sha1(stripped), 1, 8), 16, 10).cast("bigint")


def fingerprint(prefix: str, canonical: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.sha1(canonical))


def canonical_map(c: Column) -> Column:
    """JSON of a map with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def json_text(c: Column) -> Column:
    """A JSON string; control characters have lower-case hex digits."""
    quoted = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    for code in ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"):
        quoted = F.replace(quoted, F.lit(f"\\u{code}"), F.lit(f"\\u{code.lower()}"))
    return quoted


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


# --- references -------------------------------------------------------------------------------------------------------


def percent_decoded(c: Column) -> Column:
    """Strictly decoded, ``+`` untouched; null where the escapes are no valid UTF-8."""
    broken = c.rlike("%(?![0-9A-Fa-f]{2})")
    plain = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    # the decoder puts a replacement character for bytes that are no UTF-8
    replaced = F.contains(plain, F.lit("\ufffd")) & ~F.contains(c, F.lit("\ufffd")) & ~F.contains(F.upper(c), F.lit("%EF%BF%BD"))
    return F.when(~broken & ~replaced, plain)


def classified(raw: Column, is_url: Column) -> Column:
    """struct(status, reason, local): what a raw reference is; the first rule that fits decides."""
    value = F.when(is_url, raw).otherwise(F.trim(raw))
    path = F.when(is_url, F.regexp_replace(value, r"(?s)[?#].*$", "")).otherwise(value)
    local = F.when(is_url, percent_decoded(path)).otherwise(value)

    def out(status: str, reason: str | None, name: Column | None = None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"), (F.lit(None).cast("string") if name is None else name).alias("local"))

    return (
        F.when(is_blank(value), out("skipped", "empty-ref"))
        .when(F.contains(path, F.lit("{{")) | F.contains(path, F.lit("}}")), out("skipped", "dynamic-template-expression"))
        .when(F.startswith(value, F.lit("//")), out("skipped", "protocol-relative-url"))
        .when(F.startswith(ascii_lower(value), F.lit("data:")), out("skipped", "data-uri"))
        .when(value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), out("skipped", "external-url"))
        .when(local.isNull(), out("unsafe", "invalid-percent-encoding"))
        .when(is_blank(local), out("skipped", "empty-ref"))
        .when(local.isin(".", ".."), out("unsafe", "decoded-dot-path"))
        .when(local.rlike(r"[/\\]"), out("unsafe", "decoded-path-separator"))
        .when(~local.rlike(r"\A[A-Za-z0-9._-]*\z"), out("unsafe", "helper-unsafe-character"))
        .otherwise(out("local", None, local))
    )


def sound_refs(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[sound:([^\]]*)\]"), F.lit(1)), lambda r: decode_entities(F.trim(r)))


def attribute_refs(c: Column, name: str) -> Column:
    """Quoted values of an attribute of any start tag, for well-formed HTML."""
    found = F.regexp_extract_all(c, F.lit(rf"""(?is)<[a-z][^>]*?\s{name}\s*=\s*"([^"]*)\""""), F.lit(1))
    return F.transform(found, decode_entities)


def legacy_refs(c: Column) -> Column:
    """References by plain search, as an old reader finds them: sounds, then ``src=``, then ``data=``.

    An attribute may stand anywhere, also outside of tags; a quote that isn't closed ends the search.
    """
    found = [F.regexp_extract_all(c, F.lit(r"\[sound:([^\]]*)\]"), F.lit(1))]
    for name in ("src", "data"):
        whole = F.regexp_extract_all(c, F.lit(rf"""(?sU){name}=(?:"[^"]*"|'[^']*'|["'].*|(?!["']|\z)[^\s>]*)"""), F.lit(0))
        values = F.transform(whole, lambda m: F.regexp_replace(m, r"\A[a-z]+=", ""))
        closed = F.filter(values, lambda v: ~v.rlike(r"""(?s)\A(?:"[^"]*|'[^']*)\z"""))
        found.append(F.transform(closed, lambda v: F.regexp_replace(v, r"""(?s)\A(["'])(.*)\1\z""", "$2")))
    return F.transform(F.concat(*found), decode_entities)


def css_urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"""(?i)url\(\s*["']?([^"')]*?)["']?\s*\)"""), F.lit(1))


def line_of(c: Column, before: Column) -> Column:
    """1 + line breaks in the part of ``c`` before a position (0-based)."""
    head = F.substr(c, F.lit(1), before)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


# --- media ------------------------------------------------------------------------------------------------------------


def is_safe_filename(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z0-9._-]+\z") & ~c.isin(".", "..")


def artifact_path(reference: Column, prefix: Column) -> Column:
    """The reference under its root, without the prefix if that is a prefix by whole components; null if it leaves the root."""
    split = lambda c: F.filter(F.split(c, "/"), lambda p, i: (p != "") & ((p != ".") | (i == 0)))
    parts, lead = split(reference), split(F.regexp_replace(prefix, "/+$", ""))
    rest = F.when(F.slice(parts, F.lit(1), F.size(lead)) == lead, F.slice(parts, F.size(lead) + 1, F.size(parts))).otherwise(parts)
    return F.when(~F.startswith(reference, F.lit("/")) & ~F.array_contains(parts, ".."), F.array_join(F.filter(rest, lambda p: p != "."), "/"))


def mime_of_name(c: Column) -> Column:
    """By extension; null if that is unknown."""
    table = F.create_map(*[F.lit(x) for pair in sorted(MIME_BY_EXTENSION.items()) for x in pair])
    return F.try_element_at(table, F.regexp_extract(ascii_lower(c), r"\.([^.]*)$", 1))


def is_sfnt(head: Column) -> Column:
    """Whether the numbers of a font's table directory agree; ``head`` is the hex of the first bytes."""
    tables, search, selector, shift = (F.conv(F.substring(head, at, 4), 16, 10).cast("bigint") for at in (9, 13, 17, 21))
    log = F.length(F.bin(tables)) - 1
    return (F.length(head) >= 24) & tables.between(1, 512) & (selector == log) & (search == F.pow(F.lit(2.0), log) * 16) & (shift == tables * 16 - search)


def text_mime(plain: Column) -> Column:
    """Of an ASCII text: html, javascript, css, or plain."""
    trimmed = F.regexp_replace(plain, r"\A[ \t\n\r]+", "")
    low, first = ascii_lower(F.substring(trimmed, 1, 128)), F.substring(trimmed, 1, 1024)
    css = low.rlike(r"\A@(charset|import|font-face|media)") | (first.rlike(r"\A[.#:*\[]") & F.contains(first, F.lit("{")) & F.contains(first, F.lit("}")))
    html, script = low.rlike(r"\A<(!doctype html|html|head|body)"), low.rlike(r"\A(import|export|function|const|let|var) ")
    return F.when(html, "text/html").when(script, "text/javascript").when(css, "text/css").otherwise("text/plain")


def sniffed(content: Column) -> Column:
    """struct(mime, high): by the first bytes (high), or by what the text looks like (low)."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.lower(F.ltrim(content.cast("string")))
    sample = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    is_mp4 = (F.length(head) >= 24) & (F.substring(head, 9, 8) == "66747970")

    def out(mime: str, high: bool) -> Column:
        return F.struct(F.lit(mime).alias("mime"), F.lit(high).alias("high"))

    return (
        F.when(head.startswith("89504E470D0A1A0A"), out("image/png", True))
        .when(head.startswith("FFD8FF"), out("image/jpeg", True))
        .when(head.startswith("474946383761") | head.startswith("474946383961"), out("image/gif", True))
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), out("image/webp", True))
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57415645"), out("audio/wav", True))
        .when(head.startswith("494433"), out("audio/mpeg", True))
        .when(head.startswith("4F676753"), out("audio/ogg", True))
        .when(head.rlike("^FFF[0189]"), out("audio/aac", True))
        .when(is_mp4 & F.substring(head, 17, 8).isin("4D344120", "4D344220", "4D345020"), out("audio/mp4", True))
        .when(is_mp4, out("video/mp4", True))
        .when(head.startswith("1A45DFA3") & F.contains(ascii_lower(F.substring(sample, 1, 2051)), F.lit("webm")), out("video/webm", True))
        .when(head.startswith("25504446"), out("application/pdf", True))
        .when(head.startswith("774F4646"), out("font/woff", True))
        .when(head.startswith("774F4632"), out("font/woff2", True))
        .when((head.startswith("00010000") | head.startswith("74727565")) & is_sfnt(head), out("font/ttf", True))
        .when(head.startswith("4F54544F") & is_sfnt(head), out("font/otf", True))
        .when(text.startswith("<svg"), out("image/svg+xml", False))
        .when(text.startswith("<!doctype html") | text.startswith("<html"), out("text/html", False))
        .when(sample.rlike(r"\A[\x20-\x7E\t\n\r]+\z"), F.struct(text_mime(sample).alias("mime"), F.lit(False).alias("high")))
    )


def effective_mime(declared: Column, found: Column, name: Column) -> Column:
    """A sure sniff, else what was declared, the extension's, an unsure sniff, or octets."""
    return F.coalesce(F.when(found["high"], found["mime"]), F.when(~is_blank(declared), declared), mime_of_name(name), found["mime"], F.lit(OCTET_STREAM))


# --- names, selectors, keys ---------------------------------------------------------------------------------------------


def selector_text(c: Column) -> Column:
    """Quoted and escaped for a selector."""
    for char, escape in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("[", "\\["), ("]", "\\]"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(char), F.lit(escape))
    return F.concat(F.lit("'"), c, F.lit("'"))


def evidence_text(c: Column) -> Column:
    for char, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(char), F.lit(escape))
    return c


def merge_key(kind: str, name: Column, config_id: Column) -> Column:
    return F.when(F.coalesce(config_id, F.lit(0)) != 0, F.concat(F.lit(f"{kind}:config:"), config_id)).otherwise(name)


def derived_template_key(name: Column) -> Column:
    return F.replace(ascii_lower(name), F.lit(" "), F.lit("_"))


def derived_field_key(name: Column) -> Column:
    return F.regexp_replace(ascii_lower(F.regexp_replace(F.trim(name), "[^A-Za-z0-9]", "_")), "^_+|_+$", "")


def subdeck(deck: Column) -> Column:
    return F.element_at(F.split(deck, "::"), -1)


def special_field(field: Column, card: Column, deck: Column, tags: Column, kind: Column) -> Column:
    return F.when(field == "Card", card).when(field == "Deck", deck).when(field == "Subdeck", subdeck(deck)).when(field == "Tags", F.array_join(tags, " ")).when(field == "Type", kind)


def joined_fields(values: Column) -> Column:
    return F.array_join(values, "\u001f")


def split_fields(joined: Column, names: Column) -> Column:
    """name to value, as many as both have."""
    parts = F.split(joined, "\u001f")
    n = F.least(F.size(parts), F.size(names))
    return F.map_from_arrays(F.slice(names, 1, n), F.slice(parts, 1, n))


def is_guid(c: Column) -> Column:
    return (c != "") & (F.octet_length(c) <= 255) & ~c.rlike(r"\p{Cntrl}|[\x{80}-\x{9f}]")


def debug_quoted(c: Column) -> Column:
    """A path in double quotes with escapes, for messages."""
    for char, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), c, F.lit('"'))


def replaced_first(c: Column, old: Column, new: Column) -> Column:
    at = F.instr(c, old) if not isinstance(old, str) else F.instr(c, F.lit(old))
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), new, F.substr(c, at + F.length(old)))).otherwise(c)


def wrapped_front(front: Column, kind: Column, fields: Column) -> Column:
    """A front inside the sections that its generation rule asks for.

    ``all`` nests the front in a section of every field. ``any`` guards it by the first field and puts the same for the
    other fields into that field's inverted section, so the front stands once for each field; an empty list gives empty text.
    """

    def section(field: Column, inner: Column, sign: str = "#") -> Column:
        return F.concat(F.lit("{{" + sign), field, F.lit("}}"), inner, F.lit("{{/"), field, F.lit("}}"))

    every = F.aggregate(F.reverse(fields), front, lambda inner, f: section(f, inner))
    some = F.aggregate(F.reverse(fields), F.lit(""), lambda rest, f: F.concat(section(f, front), F.when(rest == "", "").otherwise(section(f, rest, "^"))))
    return F.when(kind == "all", every).when(kind == "any", some).otherwise(front)


def mask_markup(mode: Column, shapes: Column) -> Column:
    """Markup of rectangles, each a deletion and a line break; the prefixes of the two modes are fixed values."""
    prefix = F.when(mode == "hide_one_guess_one", "c1,2").otherwise("c1")
    drawn = F.transform(shapes, lambda r: F.concat(F.lit("{{"), prefix, F.lit("::image-occlusion:rect:left="), r["x"], F.lit(":top="), r["y"], F.lit(":width="), r["width"], F.lit(":height="), r["height"], F.lit("}}<br>")))
    return F.array_join(drawn, "")
