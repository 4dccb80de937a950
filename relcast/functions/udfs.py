"""Arrow-batched forms of the exact scanners, to be called only on rows that a cheap native test lets through."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scanners
from .blake3 import blake3_hex

#: Types are objects, since no session is there yet when this module is imported.
REFERENCES = T.ArrayType(T.StructType().add("kind", T.StringType()).add("raw", T.StringType()).add("is_url", T.BooleanType()).add("line", T.IntegerType()))
ISSUES = T.ArrayType(T.StructType().add("code", T.StringType()).add("severity", T.StringType()).add("message", T.StringType()).add("byte_offset", T.IntegerType()))
SCAN = T.StructType().add("ords", T.ArrayType(T.LongType())).add("malformed", T.BooleanType())
SIZE = T.StructType().add("width", T.LongType()).add("height", T.LongType())


def _each(values: pd.Series, f) -> pd.Series:
    return values.map(lambda v: None if v is None else f(v))


@F.pandas_udf(T.StringType())
def strip_html_exact(values: pd.Series) -> pd.Series:
    return _each(values, scanners.strip_html)


@F.pandas_udf(T.StringType())
def identity_text(values: pd.Series) -> pd.Series:
    return _each(values, scanners.identity_text)


@F.pandas_udf(T.StringType())
def blake3_of(values: pd.Series) -> pd.Series:
    return _each(values, lambda v: blake3_hex(v.encode()))


@F.pandas_udf(T.LongType())
def stable_config_id(namespace: pd.Series, kind: pd.Series, key: pd.Series) -> pd.Series:
    made = [blake3_hex(f"{n}\0{t}\0{k}".encode())[:16] for n, t, k in zip(namespace, kind, key, strict=True)]
    return pd.Series([int(h, 16) & 0x7FFFFFFFFFFFFFFF for h in made])


@F.pandas_udf(REFERENCES)
def references_of(values: pd.Series, is_css: pd.Series) -> pd.Series:
    return pd.Series([[] if v is None else scanners.references(v, bool(c)) for v, c in zip(values, is_css, strict=True)])


@F.pandas_udf(ISSUES)
def template_issues(sources: pd.Series, fields: pd.Series) -> pd.Series:
    return pd.Series([[] if s is None else scanners.template_issues(s, list(f)) for s, f in zip(sources, fields, strict=True)])


@F.pandas_udf(SCAN)
def cloze_scan(values: pd.Series) -> pd.DataFrame:
    found = [scanners.cloze_ordinals(v or "") for v in values]
    return pd.DataFrame({"ords": [o for o, _ in found], "malformed": [m for _, m in found]})


@F.pandas_udf(T.ArrayType(T.LongType()))
def cloze_ordinals_of(texts: pd.Series) -> pd.Series:
    """Ordinals of several texts together; null where there are no texts to look at."""
    return _each(texts, lambda values: sorted({n for v in values if v is not None for n in scanners.cloze_ordinals(v)[0]}))


@F.pandas_udf(T.ArrayType(T.StringType()))
def filled_names(fields: pd.Series) -> pd.Series:
    """Names of the fields whose text isn't blank without markup; null for null."""
    return _each(fields, lambda entries: [name for name, value in dict(entries).items() if scanners.strip_html(value or "").strip()])


@F.pandas_udf(T.StringType())
def cloze_components(values: pd.Series) -> pd.Series:
    """Canonical JSON of the components; null where the text is malformed."""

    def made(text: str) -> str | None:
        try:
            return scanners.canonical_json(scanners.cloze_identity(text))
        except ValueError:
            return None

    return _each(values, made)


@F.pandas_udf(T.BooleanType())
def renders_text(front: pd.Series, fields: pd.Series, special: pd.Series, declared: pd.Series) -> pd.Series:
    return pd.Series([scanners.renders_text(f, dict(a), dict(s), list(d)) for f, a, s, d in zip(front, fields, special, declared, strict=True)])


@F.pandas_udf(SIZE)
def jpeg_size(contents: pd.Series) -> pd.DataFrame:
    """Width and height of JPEG images, from the first frame header that their segments lead to; null where there is none."""

    def read(body: bytes | None) -> tuple[int | None, int | None]:
        at = 2
        while body is not None and at + 9 <= len(body) and body[at] == 0xFF:
            marker = body[at + 1]
            if marker == 0xFF:  # a filling byte
                at += 1
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(body[at + 7 : at + 9], "big"), int.from_bytes(body[at + 5 : at + 7], "big")
            else:
                at += 2 + int.from_bytes(body[at + 2 : at + 4], "big")
        return None, None

    return pd.DataFrame([read(b) for b in contents], columns=["width", "height"]).astype("Int64")


def exact_strip(c: Column) -> Column:
    """Text without ``<`` or ``&`` is plain already."""
    return F.when(c.contains("<") | c.contains("&"), strip_html_exact(c)).otherwise(c)


def register(spark) -> None:
    """Make the scanners callable from SQL."""
    for name, f in (("strip_html", strip_html_exact), ("identity_text", identity_text), ("blake3", blake3_of), ("media_references", references_of), ("template_issues", template_issues), ("cloze_scan", cloze_scan), ("cloze_components", cloze_components)):
        spark.udf.register(name, f)
