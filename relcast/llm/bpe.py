"""Byte-level BPE by DuckDB recursive queries, one database in each Python worker.

A text is split by the tokenizer's pattern. Words that the worker has not met yet go to DuckDB, where token-position rows
join the merge table (left token, right token, rank); each step of a recursive query contracts the leftmost pair of least
rank of each word, until no word has a pair. Decoding joins the tokens with the vocabulary and aggregates their bytes in
order. A word of more than ``LONG`` bytes would take very many steps, so such words have a query over rows of their own, in
which a step contracts all pairs of least rank, from left to right, up to the first that gives rise to a pair of less rank.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import per_text

LONG = 96
#: A worker keeps the tokens of so many words and pieces and then starts anew.
KEPT_WORDS = 500_000
#: A space at an end of the text or beside other white space (as Python has it, which includes all that the pattern has).
ODD_SPACE = re.compile(r"\A | \Z| \s|\s ")

#: A word's tokens are a list; a step unnests it to rows (word, position, token, next token), which join the merge table.
#: Rank and position are one number, so the least is the leftmost pair of least rank.
ENCODE = """
WITH RECURSIVE step(w, ids, done) AS (
  SELECT w, ids, false FROM start
  UNION ALL
  SELECT s.w,
    CASE WHEN k IS NULL THEN ids ELSE list_concat(list_concat(ids[:(k & 255)], [(k >> 8)::INTEGER]), ids[(k & 255) + 3:]) END,
    k IS NULL
  FROM (SELECT w, ids FROM step WHERE NOT done) s
  LEFT JOIN (
    SELECT w, min((rank::BIGINT << 8) | p) AS k
    FROM (SELECT w, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, unnest(range(len(ids) - 1)) AS p FROM step WHERE NOT done) pairs
    JOIN merges ON merges.l = pairs.l AND merges.r = pairs.r
    GROUP BY w
  ) best USING (w)
)
SELECT w, ids FROM step WHERE done
"""
#: Rows (step, word, position, token), for ``$steps`` steps at most. Of pairs that overlap, every other one from the left is
#: contracted; ``wary`` are pairs whose token has an early pair (one of less rank than the token) with a neighbour.
ENCODE_LONG = """
WITH RECURSIVE step(n, w, p, id) AS (
  SELECT 0, w, p, id FROM start
  UNION ALL
  SELECT n + 1, w, p, id
  FROM (
    SELECT n, w, p, CASE WHEN hit THEN k ELSE id END AS id, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY p), false) AS gone
    FROM (
      SELECT *, best AND p <= coalesce(min(CASE WHEN best AND wary THEN p END) OVER (PARTITION BY w), p)
        AND (p - max(CASE WHEN NOT best THEN p ELSE 0 END) OVER (PARTITION BY w ORDER BY p ROWS UNBOUNDED PRECEDING)) % 2 = 1 AS hit
      FROM (
        SELECT n, w, t.id, p, min(rank) OVER (PARTITION BY w) AS k, coalesce(rank = min(rank) OVER (PARTITION BY w), false) AS best,
          e.l IS NOT NULL OR f.l IS NOT NULL OR g.l IS NOT NULL AS wary
        FROM (
          SELECT n, w, id, row_number() OVER place AS p, lag(id) OVER place AS before, lead(id) OVER place AS next, lead(id, 2) OVER place AS after
          FROM step WHERE n < $steps WINDOW place AS (PARTITION BY w ORDER BY p)) t
        LEFT JOIN merges m ON m.l = t.id AND m.r = t.next
        LEFT JOIN early e ON e.l = t.before AND e.r = m.rank
        LEFT JOIN early f ON f.l = m.rank AND f.r = t.after
        LEFT JOIN early g ON g.l = m.rank AND g.r = m.rank)
      WHERE k IS NOT NULL))
  WHERE NOT gone)
SELECT s.w, s.p, s.id, s.n FROM step s JOIN (SELECT w, max(n) AS n FROM step GROUP BY w) USING (w, n) ORDER BY s.w, s.p
"""
#: Rows that a query over rows may make in all its steps, unless one step makes more.
LONG_ROWS = 100_000
DECODE = "SELECT d, list(bytes ORDER BY p) AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY d ORDER BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encodes and decodes with one vocabulary; ranks are ids."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.plain: dict[bytes, bytes] = {}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], rank) for t, rank in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, rank = (np.array(x, np.int32) for x in zip(*pairs, strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "120MB", "allocator_flush_threshold": "4MB", "temp_directory": "", "preserve_insertion_order": False})
        self._table("merges", pa.table({"l": left, "r": right, "rank": rank}))
        early = rank < np.maximum(left, right)
        self._table("early", pa.table({"l": left[early], "r": right[early]}))
        self._table("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("arriving", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arriving")
        self.db.unregister("arriving")

    def contracted_long(self, words: list[bytes]) -> list[bytes]:
        """As ``contracted``, by the query over rows; words that aren't done after its steps go on in the next query."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        rows = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "p": np.concatenate([np.arange(n) for n in sizes]), "id": self.single[np.frombuffer(b"".join(words), np.uint8)]})
        while rows.num_rows:
            steps = max(1, LONG_ROWS // rows.num_rows)
            self._table("start", rows)
            got = self.db.sql(ENCODE_LONG, params={"steps": steps}).to_arrow_table()
            n, w, ids = (got.column(c).to_numpy() for c in ("n", "w", "id"))
            ends = np.searchsorted(w, np.arange(len(words) + 1))
            for k in np.unique(w[n < steps]).tolist():
                out[k] = ids[ends[k] : ends[k + 1]].astype("<u4").tobytes()
            rows = got.filter(pa.array(n == steps)).select(["w", "p", "id"])
        return out

    def contracted(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The tokens of words, as little-endian unsigned 32-bit integers."""
        out, held, rows = {}, [], 0
        for w in [w for w in words if len(w) > LONG]:
            if held and rows + len(w) > LONG_ROWS // 10:
                out.update(zip(held, self.contracted_long(held), strict=True))
                held, rows = [], 0
            held, rows = [*held, w], rows + len(w)
        if held:
            out.update(zip(held, self.contracted_long(held), strict=True))
        short = [w for w in words if len(w) <= LONG]
        for k in range(0, len(short), 20_000):
            part = short[k : k + 20_000]
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in part])]).astype(np.int32)
            ids = self.single[np.frombuffer(b"".join(part), np.uint8)]
            self._table("start", pa.table({"w": np.arange(len(part), dtype=np.int32), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))}))
            got = self.db.sql(ENCODE).to_arrow_table().combine_chunks()
            lists = got.column("ids").combine_chunks()
            flat, offsets = lists.values.to_numpy().astype("<u4").tobytes(), lists.offsets.to_pylist()
            for row, w in enumerate(got.column("w").to_pylist()):
                out[part[w]] = flat[4 * offsets[row] : 4 * offsets[row + 1]]
        return out

    def forget(self) -> None:
        """Start anew with no words; a task that ends leaves none behind."""
        self.words, self.pieces, self.plain = {}, {}, {}

    def split(self, piece: str) -> list[str]:
        """The pattern's matches in a piece with a space before it; plain words need no pattern."""
        if piece.isalpha():
            return [" " + piece]
        if piece[:-1].isalpha() and piece[-1] in ".,":
            return [" " + piece[:-1], piece[-1]]
        return self.pattern.findall(" " + piece)

    def learn(self, words: set[str]) -> None:
        """Put the tokens of words that aren't known yet into ``words``, and what these decode to into ``plain``."""
        if new := list(words.difference(self.words)):
            coded = self.contracted([w.encode() for w in new])
            self.words.update((w, coded[w.encode()]) for w in new)
            runs = list(set(coded.values()))
            self.plain.update(zip(runs, self.decode_runs(runs), strict=True))

    def encode(self, batch: list[str]) -> list[list[bytes]]:
        """The tokens of each text, in runs that follow each other.

        A match of the pattern never goes on over a space between two other characters, so a text is cut before such
        spaces and equal pieces are looked up. A text with other white space beside a space is split whole.
        """
        if len(self.words) + len(self.pieces) > KEPT_WORDS:
            self.forget()
        cuts = [None if ODD_SPACE.search(text) else text.split(" ") for text in batch]
        whole = [self.pattern.findall(text if pieces is None else pieces[0]) for text, pieces in zip(batch, cuts, strict=True)]
        new = {p: self.split(p) for p in set().union(*(pieces[1:] for pieces in cuts if pieces)).difference(self.pieces)}
        self.learn(set().union(*whole, *new.values()))
        word, plain = self.words, self.plain
        for piece, words in new.items():
            if len(words) == 1:
                self.pieces[piece] = word[words[0]]
            else:
                runs = [word[w] for w in words]
                self.pieces[piece] = run = b"".join(runs)
                plain[run] = b"".join([plain[r] for r in runs])
        known = self.pieces
        return [[word[w] for w in words] + ([known[p] for p in pieces[1:]] if pieces else []) for words, pieces in zip(whole, cuts, strict=True)]

    def decode_runs(self, runs: list[bytes]) -> list[bytes]:
        """The bytes of each run of tokens: rows (run, position, token) join the vocabulary and are aggregated in order."""
        out = [b""] * len(runs)
        for k in range(0, len(runs), 40_000):
            part = runs[k : k + 40_000]
            sizes = np.array([len(ids) // 4 for ids in part], np.int64)
            if not sizes.sum():
                continue
            ends = np.cumsum(sizes)
            self._table("tokens", pa.table({"d": np.repeat(np.arange(len(part)), sizes), "p": np.arange(ends[-1]) - np.repeat(ends - sizes, sizes), "id": np.frombuffer(b"".join(part), "<u4").astype(np.int32)}))
            got = self.db.sql(DECODE).to_arrow_table().combine_chunks()
            lists = got.column("bytes").combine_chunks()
            # the tokens of a list lie side by side in one buffer
            values = lists.values.cast(pa.large_binary())
            ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1][lists.offsets.to_numpy()].tolist()
            buffer = values.buffers()[2].to_pybytes()
            for row, d in enumerate(got.column("d").to_pylist()):
                out[k + d] = buffer[ends[row] : ends[row + 1]]
        return out

    def decode(self, batch: list[list[bytes]]) -> list[bytes]:
        """The bytes of each list of runs of tokens; equal runs are decoded once."""
        plain = self.plain
        if new := list(set().union(*batch).difference(plain)):
            plain.update(zip(new, self.decode_runs(new), strict=True))
        return [b"".join(map(plain.__getitem__, runs)) for runs in batch]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; a worker serves many tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _coder(path: str, pattern: str, ids: bool) -> Callable[[], Callable[[list], dict[str, pa.Array]]]:
    def make() -> Callable[[list], dict[str, pa.Array]]:
        own = codec(path, pattern)

        def work(batch: list[bytes | None]) -> dict[str, pa.Array]:
            runs = own.encode([(t or b"").decode("utf-8", "replace") for t in batch])
            plain = own.decode(runs)
            coded = [b"".join(r) for r in runs]
            out = {"n_tokens": pa.array([len(c) // 4 for c in coded], pa.int64()), "ids_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in plain], pa.string())}
            return out | ({"ids": pa.array(coded, pa.binary())} if ids else {})

        work.close = own.forget
        return work

    return make


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), ids: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves.

    ids are little-endian unsigned 32-bit integers. A null text is empty and has no tokens. Repeated rows and null ids
    stay; ``keep`` names columns to carry, all others are left out. A long text is encoded whole; an empty table gives an
    empty result. One pass without exchange.
    """
    return per_text(docs, [id_col, *keep], text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary" if ids else ""), _coder(path, pattern, ids), rows=4096, size=1 << 20)
