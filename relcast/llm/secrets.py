"""Secret scan: an Aho-Corasick automaton finds keywords, anchored regular expressions run only where one was found.

Kinds, in this order: assign, access and hex (the base), then github and npm, tokens whose last six characters are the
base-62 CRC-32 of the thirty before them; one with another checksum is no secret. A run of hex digits has no keyword, so
it is found by its run.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batches, per_text, texts

KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a whole run: a run is taken to its end, and shorter ones fail
CHECKED = {"github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])"), "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")}
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

Span = tuple[int, int, int]  # start, place in KINDS, end; code points


def base62_crc(payload: str) -> str:
    value, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def folded(text: str) -> str:
    """The text with A-Z in lower case and every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate({c: c + 32 for c in range(65, 91)})


def scan(text: str, keywords: ahocorasick.Automaton) -> list[Span]:
    """All secrets of a text, by start and kind. Of each kind the leftmost, not overlapping; short ones count as nothing."""
    near: dict[str, list[int]] = {}
    for end, (kind, size) in keywords.iter(folded(text)):
        near.setdefault(kind, []).append(end + 1 - size)
    spans: list[Span] = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for kind, starts in near.items():
        done = 0
        for start in sorted(starts):
            if start < done:
                continue
            if kind == "assign":
                if m := ASSIGN.match(text, start):
                    done = m.end()
                    if len(m[2]) >= 6:
                        spans.append((start, 0, done))
            elif kind == "access":
                if m := ACCESS.match(text, start):
                    done = m.end()
                    if done - start >= 20:
                        spans.append((start, 1, done))
            elif m := CHECKED[kind].match(text, start):
                if (start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_")) and base62_crc(m[1]) == m[2]:
                    done = m.end()
                    spans.append((start, KINDS.index(kind), done))
    return sorted(spans)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """The text with every secret, overlapping ones as one, replaced by ``mark``."""
    out, at, last = [], 0, 0
    for start, _, end in spans:
        if start >= last:
            out += [text[at:start], mark]
        at = last = max(last, end)
    return "".join([*out, text[at:]])


def _scanner() -> Callable[[list], dict[str, pa.Array]]:
    keywords = automaton()

    def work(batch: list[bytes | None]) -> dict[str, pa.Array]:
        found = [scan((t or b"").decode("utf-8", "replace"), keywords) for t in batch]
        base = [[s for s in spans if s[1] < 3] for spans in found]
        counts = {f"n_{KINDS[k]}": pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in range(3)}
        return counts | {"base_sha256": pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()), "spans": pa.array([joined(s) for s in found], pa.string())}

    return work


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, by start).

    A null text is empty and has no spans; ids may be null or repeated; other columns are left out, so their names can't
    clash; a long text is scanned whole; an empty table gives an empty result. One pass without exchange.
    """
    return per_text(docs, [id_col], text_col, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", _scanner)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each secret in the text replaced by ``[REDACTED]`` and ``length_col`` set to the new length.

    All rows and columns stay. Null texts stay null and texts without a secret as they are.
    """
    at, size_at = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else None
    if not isinstance(docs.schema[at].dataType, T.StringType):
        raise TypeError(f"{text_col} is no string")
    names = [f"c{i}" for i in range(len(docs.columns))]  # by place, so that equal names do no harm
    plain = docs.toDF(*names)

    def run(frames):
        keywords = automaton()
        for batch in batches(frames, names[at]):
            columns = list(batch.columns)
            new, sizes = [], columns[size_at].to_pylist() if size_at is not None else None
            for row, raw in enumerate(texts(batch, names[at])):
                text = None if raw is None else raw.decode("utf-8", "replace")
                if text and (spans := scan(text, keywords)):
                    text = redacted(text, spans)
                    if sizes is not None:
                        sizes[row] = len(text)
                new.append(text)
            columns[at] = pa.array(new, columns[at].type)
            if sizes is not None:
                columns[size_at] = pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
