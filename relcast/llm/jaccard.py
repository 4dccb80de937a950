"""N-gram Jaccard join: documents whose shingle sets are similar, with their components, by signature trees.

Trees need neighbourhoods of bounded size, and these lose no link: a pair of similar sets of sizes a and b differs in at most
D = (a + b) (100 - over) / (100 + over) tokens, so if tokens are dealt to D + 1 parts, one part is equal in both. Sizes fall
into classes so that similar sets are in the same class or in neighbouring ones; of each different set, the hash of each
part is sent for its own class and, if it can have larger partners, for the next. Beside the hash lie parity bits of the next parts, which
similar sets nearly share (``PartKeys``), so sets that have a part in common by chance aren't united. Candidate groups
are cut into chunks, a signature tree joins each chunk, and trees of two chunks are traversed together wherever the
group isn't one component yet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, batches, cut, give_back, per_text, texts
from .components import Forest, components
from .signature_tree import TreeJoin

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass(frozen=True)
class JaccardParams:
    shingle: int = 5  # words
    over: int = 80  # two sets link when 100 * intersection >= over * union
    chunk: int = 256  # sets in a tree
    chain: int = 8  # parts whose parity lies beside a key
    piece: int = 2048  # rows of a key that are compared at once
    sample: int = 32  # of so many documents one is looked at for common keys,
    common_rows: int = 16  # which are those that so many documents of the sample have, if most of them differ,
    common_keys: int = 1 << 16  # and no more than so many; a key more or less changes the work, not the result
    broadcast_rows: int = 1_000_000  # candidates up to so many (of 24 bytes) are broadcast to the texts, more are joined by a shuffle


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse, as far as the longest batch needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = n + n // 4
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, INVERSE))
        return self.up, self.down


BYTES = mix(np.arange(1, 257, dtype=np.uint64))
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def shingle_sets(batch: list[bytes | None], size: int, powers: Powers) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; A-Z count as lower case.

    A text of fewer words than ``size`` has one shingle, all its words; one without words has none.
    """
    low = [(t or b"").lower() for t in batch]
    raw = np.frombuffer(b"\n".join([*low, b""]), np.uint8)
    space = SPACES[raw]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    up, down = powers.upto(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * up[: len(raw)])])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in low]]))
    out, step = [], np.uint64(BASE)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * step + words[k : k + len(rolled)]
    rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            tokens = np.sort(rolled[a : b - size + 1])
            out.append(tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])])
        elif b > a:
            value = np.zeros(1, np.uint64)
            for w in words[a:b]:
                value = value * step + w
            out.append(mix(value + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class SizeClasses:
    """Classes of sizes [low, high]: two similar sets are in one class or in neighbouring ones.

    A class deals the 64-bit space of tokens to ``parts`` equal ranges, more than the tokens in which two of its sets may differ.
    """

    def __init__(self, over: int, more: float = 0.25):
        low = [1]
        while low[-1] < 1 << 40:
            low.append(100 * (100 * low[-1] // over) // over + 1)
        self.low, self.over = np.array(low, np.int64), over
        needed = self.differ(2 * (self.low[1:] - 1)) + 1
        self.parts = needed + np.where(needed > 1, np.ceil(needed * more), 0).astype(np.int64)

    def differ(self, both: np.ndarray) -> np.ndarray:
        """The most tokens in which similar sets differ that have ``both`` tokens together."""
        return both * (100 - self.over) // (100 + self.over)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


class PartKeys:
    """Keys of sets: hashes of the tokens in a part, each with the parity bits of the ``chain`` parts that follow.

    Say two similar sets differ in b[j] tokens of part j of m, and in D in all. The numbers 1 - b[j] are at most 1 and their
    sum is m - D, so by the cycle lemma there are m - D parts from which every run of l parts (the last part is followed by
    the first) has fewer than l differing tokens. Such a part is equal in both sets, and the following ``chain`` parts
    differ in ``chain`` tokens at most, so their parities (bit t is odd if an odd number of tokens hash to t) differ in as
    many bits at most. That tells most sets that share a part by chance, without sending them.

    A set that can differ from its partners in d tokens sends its d + 1 largest parts (of equal size those of greater
    hash). No pair is lost: the m - D good parts are in one order for both sets, each set leaves out at most m - 1 - D parts at
    the low end of the order, and so both send the last of the good ones. Empty and tiny parts, which sets have in common by chance,
    are seldom sent.

    Rows of keys in ``common`` (sorted), which many different sets have, become rows of ``chain`` + 1 longer keys: the
    tokens of the following parts are dealt to so many shares, one of which is equal as well.
    """

    def __init__(self, over: int, chain: int, common: np.ndarray | None = None):
        self.classes, self.chain, self.common = SizeClasses(over), chain, common if common is not None else np.empty(0, np.uint64)

    def __call__(self, sets: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, parity, n, id); n is the size of the set. At most 4,096 sets."""
        sizes = np.array([len(s) for s in sets], np.int64)
        own, made = self.classes.of(np.maximum(sizes, 1)), []
        for up in (0, 1):
            cls = own + up
            on = np.flatnonzero((sizes > 0) & ((up == 0) | (100 * sizes // self.classes.over >= self.classes.low[cls])))
            if len(on):
                made.append(self.rows(np.concatenate([sets[i] for i in on]), sizes[on], cls[on], ids[on]))
        if not made:
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*made, strict=True))

    def rows(self, flat: np.ndarray, sizes: np.ndarray, cls: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """``flat`` has the sorted tokens of one set after the other, so the parts lie one after the other as well."""
        parts = self.classes.parts[cls]
        base, total = np.cumsum(parts) - parts, int(parts.sum())
        wide = np.repeat(parts.astype(np.uint64), sizes)
        place = np.repeat(base, sizes) + (((flat >> np.uint64(32)) * wide) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(place, minlength=total)
        ends = np.cumsum(counts)
        value = mix(flat + np.uint64(2))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        odd = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.uint64(1) << (value >> np.uint64(58)))])
        of = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(total) - base[of]
        key = mix((sums[ends] - sums[ends - counts]) ^ mix(number.astype(np.uint64) + (cls[of].astype(np.uint64) << np.uint64(40)) + np.uint64(3)))
        largest = np.minimum(100 * sizes // self.classes.over, self.classes.low[cls + 1] - 1)
        left = np.maximum(parts - 1 - self.classes.differ(sizes + largest), 0)
        order = np.argsort((of.astype(np.uint64) << np.uint64(51)) | (np.minimum(counts, 4095).astype(np.uint64) << np.uint64(39)) | (key >> np.uint64(25)))
        kept = np.sort(order[number >= left[of]])
        key, of, number = key[kept], of[kept], number[kept]
        ahead = np.minimum(self.chain, parts - 1)[of]
        stop = number + ahead
        first, last = base[of], base[of] + parts[of] - 1
        direct = odd[ends[np.minimum(kept + ahead, last)]] ^ odd[ends[kept]]
        around = odd[ends[first + np.maximum(stop - parts[of], 0)]] ^ odd[ends[first] - counts[first]]
        parity = direct ^ np.where(stop >= parts[of], around, np.uint64(0))
        if len(self.common) and len(hot := np.flatnonzero(self.common[np.minimum(np.searchsorted(self.common, key), len(self.common) - 1)] == key)):
            more = self.longer(value, ends, counts, key[hot], kept[hot], ahead[hot], first[hot], last[hot])
            rest, shares = np.setdiff1d(np.arange(len(key)), hot), self.chain + 1
            key, at = np.concatenate([key[rest], more]), np.concatenate([rest, np.repeat(hot, shares)])
            parity, of = parity[at], of[at]
        return key, parity, sizes[of], ids[of]

    def longer(self, value: np.ndarray, ends: np.ndarray, counts: np.ndarray, key: np.ndarray, part: np.ndarray, ahead: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each key ``chain`` + 1 keys, each with a share of the tokens in the following parts."""
        shares = self.chain + 1
        sums = np.zeros((len(key), shares), np.uint64)
        for step in range(1, self.chain + 1):
            on = np.flatnonzero(ahead >= step)
            at = part[on] + step
            at = np.where(at > last[on], at - (last[on] - first[on] + 1), at)
            size = counts[at]
            row = np.repeat(on, size)
            token = value[np.repeat(ends[at] - size, size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
            np.add.at(sums, (row, (token % np.uint64(shares)).astype(np.int64)), token)
        return mix(sums ^ mix(key[:, None] + np.arange(1, shares + 1, dtype=np.uint64)[None, :])).ravel()


def thinned(keys: np.ndarray, parities: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key, parity and size once, with its least id; ids that had them in common get a key of their own with their least id.

    So a key that a third of the rows have leaves a batch as few rows. Common keys of a batch are joined to stars first.
    """
    if not len(keys):
        return keys, parities, sizes, ids
    order = np.argsort(keys, kind="stable")
    keys, parities, sizes, ids = (x[order] for x in (keys, parities, sizes, ids))
    same = np.concatenate([[False], keys[1:] == keys[:-1]])
    several = same | np.concatenate([same[1:], [False]])
    if not several.any():
        return keys, parities, sizes, ids
    some = np.flatnonzero(several)
    some = some[np.lexsort((ids[some], sizes[some], parities[some], keys[some]))]
    new = np.concatenate([[True], np.any([x[some][1:] != x[some][:-1] for x in (keys, parities, sizes)], 0)])
    least = ids[some[new]][np.cumsum(new) - 1]
    on = ~new & (ids[some] != least)
    forest = Forest()
    for a, b in np.unique(np.stack([ids[some][on], least[on]], 1), axis=0).tolist():
        forest.join(a, b)
    pairs = np.array(forest.stars(), np.int64).reshape(-1, 2)
    link = mix(mix(pairs[:, 0].astype(np.uint64)) + pairs[:, 1].astype(np.uint64) * np.uint64(BASE))
    kept, none = np.concatenate([np.flatnonzero(~several), some[new]]), np.zeros(len(link), np.int64)
    rows = (link, none.view(np.uint64), none, pairs[:, 0]), (link, none.view(np.uint64), none, pairs[:, 1])
    return tuple(np.concatenate([x[kept], a, b]) for x, a, b in zip((keys, parities, sizes, ids), *rows, strict=True))


def summaries(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, m, f1, f2): size, least token and a 128-bit fingerprint of each document's set."""

    def make():
        powers = Powers()

        def work(batch):
            sets = shingle_sets(batch, size, powers)
            prints = np.array([[mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(BASE)).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            return {"n": pa.array([len(s) for s in sets], pa.int64()), "m": pa.array(np.array([s[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)), "f1": pa.array(prints[:, 0].copy()), "f2": pa.array(prints[:, 1].copy())}

        return work

    return per_text(docs, ["id"], "text", "n bigint, m bigint, f1 bigint, f2 bigint", make)


def part_rows(docs: DataFrame, params: JaccardParams, common: np.ndarray | None = None) -> DataFrame:
    """(key, parity, n, id) of the sets of ``docs`` (id, text), in one pass."""

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, keys_of = Powers(), PartKeys(params.over, params.chain, common)
        for batch in batches(frames, "text", 4096):
            made = thinned(*keys_of(shingle_sets(texts(batch, "text"), params.shingle, powers), batch.column("id").to_numpy()))
            for k in range(0, len(made[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000].view(np.int64)) for x in made], ["key", "parity", "n", "id"])
        del powers, keys_of
        give_back()

    return docs.select("id", "text").mapInArrow(run, "key bigint, parity bigint, n bigint, id bigint")


def common_keys(docs: DataFrame, params: JaccardParams) -> np.ndarray:
    """Sorted keys that many documents of a sample have, most of them without the parity of the one beside them.

    They come of passages that documents share; ``PartKeys`` makes them longer, so that no task meets all documents with
    such a passage. Keys of near copies aren't among them.
    """
    rows = part_rows(docs.where(F.pmod(F.xxhash64("id"), F.lit(params.sample)) == 0), params)
    beside = F.lag("parity").over(Window.partitionBy("key").orderBy("id"))
    far = rows.withColumn("far", (F.bit_count(F.col("parity").bitwiseXOR(beside)) > params.chain).cast("int"))
    found = far.groupBy("key").agg(F.count("*").alias("n"), F.avg("far").alias("far")).where((F.col("n") >= params.common_rows) & (F.col("far") > 0.5))
    return np.sort(np.array([r["key"] for r in found.orderBy(F.col("n").desc(), "key").limit(params.common_keys).select("key").collect()], np.int64).view(np.uint64))


def near_pairs(group: np.ndarray, parity: np.ndarray, sizes: np.ndarray, side: np.ndarray, most: int, over: int) -> np.ndarray:
    """For each row the place of the first row that it hangs together with.

    Rows of a group and of different sides hang together if their sizes can agree and their parities differ in no more
    bits than ``most`` and than similar sets of their sizes have different tokens. ``group`` is sorted; sides -1 are
    compared with each other. Rows are compared with the next, the one after it and so on; groups that are one component already are left.
    """
    top, at = np.arange(len(group)), np.arange(len(group))
    step = 1
    while len(at):
        at = at[at + step < len(group)]
        at = at[group[at + step] == group[at]]
        other = at + step
        both = sizes[at] + sizes[other]
        near = np.bitwise_count(parity[at] ^ parity[other]) <= np.minimum(both * (100 - over) // (100 + over), most)
        near &= (100 * np.minimum(sizes[at], sizes[other]) >= over * np.maximum(sizes[at], sizes[other])) & ((side[at] < 0) | (side[at] != side[other])) & (top[at] != top[other])
        for a, b in zip(at[near].tolist(), other[near].tolist(), strict=True):
            a, b = root(top, a), root(top, b)
            top[max(a, b)] = min(a, b)
        while not np.array_equal(up := top[top], top):
            top = up
        if step & (step - 1) == 0 and len(at):
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            apart = np.minimum.reduceat(top, starts) != np.maximum.reduceat(top, starts)
            at = at[apart[np.searchsorted(starts, at, side="right") - 1]]
        step += 1
    return top


def root(top: np.ndarray, at: int) -> int:
    while top[at] != at:
        at = int(top[at])
    return at


def candidate_edges(docs: DataFrame, params: JaccardParams) -> DataFrame:
    """(a, b): edges that join all sets of ``docs`` (id, text) that may be similar.

    One exchange of (key, parity, n, id) rows; the few keys that several rows have are written. The rows of a key that has
    too many for one task are compared by pairs of pieces.
    """
    rows = part_rows(docs, params, common_keys(docs, params))
    shared = cut(rows.withColumn("k", F.count("*").over(Window.partitionBy("key"))).where("k > 1"))
    pieces, facts = F.ceil(F.col("k") / params.piece), ["parity", "n", "id"]
    met = shared.select("key", *facts, F.pmod(F.xxhash64("parity"), pieces).alias("c"), F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("d"))
    met = met.select("key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), *facts, F.when(F.col("c") == F.col("d"), -1).otherwise((F.col("c") > F.col("d")).cast("int")).alias("side"))
    names = ["key", "i", "j", *facts]
    ordered = met.repartition("key", "i", "j").sortWithinPartitions(*names)

    def edges(held: list[np.ndarray]) -> pa.RecordBatch:
        key, i, j, parity, sizes, ids, side = held
        differs = lambda *columns: np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], 0)])
        group = np.cumsum(differs(key, i, j))
        new = differs(group, parity, sizes)
        first = np.flatnonzero(new)
        top = first[near_pairs(group[first], parity[first].view(np.uint64), sizes[first], side[first], params.chain, params.over)]
        a, b = ids, ids[top[np.cumsum(new) - 1]]
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c])) for c in (0, 1)], ["a", "b"])

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for frame in frames:
            new = [frame.column(name).to_numpy().astype(np.int64) for name in (*names, "side")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) < 100_000:
                continue
            # the last key goes on in the next frame
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            if len(last):
                yield edges([x[: last[-1] + 1] for x in held])
                held = [x[last[-1] + 1 :] for x in held]
        if held is not None and len(held[0]):
            yield edges(held)
        del held
        give_back()

    return ordered.mapInArrow(run, "a bigint, b bigint")


def chunked(members: DataFrame, params: JaccardParams) -> DataFrame:
    """(id, grp, n, chunk, many): candidate sets by group, and their chunk; ``many`` if the group has more than one.

    ``members`` has id, grp, n and m, and only groups of two sets or more. A large group is dealt by the least token, which
    similar sets mostly share, and where too many share it by the id.
    """
    sized, pieces = cut(members), lambda c: F.ceil(F.col(c) / params.chunk)
    groups = cut(sized.groupBy("grp").agg(F.count("*").alias("g")))
    dealt = cut(sized.join(groups, "grp").withColumn("bucket", F.pmod("m", pieces("g"))))
    buckets = cut(dealt.groupBy("grp", "bucket").agg(F.count("*").alias("k")))
    chunk = F.when(F.col("g") <= params.chunk, 0).otherwise(F.col("bucket") * (1 << 32) + F.pmod(F.xxhash64("id"), pieces("k")) + 1)
    return dealt.join(buckets, ["grp", "bucket"]).select("id", "grp", "n", chunk.alias("chunk"), (F.col("g") > params.chunk).alias("many"))


def with_sets(docs: DataFrame, rows: DataFrame, count: int, params: JaccardParams) -> DataFrame:
    """``rows`` (id and others) with the tokens of the documents, read again from the texts."""
    found = docs.join(F.broadcast(rows) if count <= params.broadcast_rows else rows, "id")

    def make():
        powers = Powers()
        return lambda batch: {"tokens": pa.array([s.tobytes() for s in shingle_sets(batch, params.shingle, powers)], pa.binary())}

    return per_text(found, rows.columns, "text", "tokens binary", make)


def tree_links(rows: DataFrame, keys: list[str], over: int) -> DataFrame:
    """(a, b): links that join the rows of each group of ``keys`` by signature trees.

    ``rows`` has the keys, id and tokens. If it has side and label too, labels are known components, sides 0 and 1 of a group
    are two trees that are traversed together, and rows of side 2 are one tree. A task meets its groups one after the other.
    """
    crossed = "side" in rows.columns
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys)

    def joined(held: list[tuple]) -> list[tuple[int, int]]:
        # an id with several texts has a row for each that has words, in one component from the start
        held = sorted({row for row in held if row[1]})
        if len(held) < 2:
            return []
        join = TreeJoin([np.frombuffer(row[1], np.uint64) for row in held], over, [row[3] if crossed else row[0] for row in held])
        sides = [[i for i, row in enumerate(held) if row[2] == side] for side in (0, 1)]
        if all(sides):
            join.across(join.tree(sides[0]), join.tree(sides[1]))
        elif not any(sides):
            join.within(join.tree(list(range(len(held)))))
        forest = Forest()
        for i, j in join.links:
            forest.join(held[i][0], held[j][0])
        return forest.stars()

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []
        for frame in frames:
            columns = [frame.column(k).to_pylist() for k in keys]
            extra = [frame.column("side").to_pylist(), frame.column("label").to_pylist()] if crossed else [[None] * frame.num_rows] * 2
            for key, *row in zip(zip(*columns, strict=True), frame.column("id").to_pylist(), frame.column("tokens").to_pylist(), *extra, strict=True):
                if key != at:
                    if len(held) > 1:
                        out += joined(held)
                    at, held = key, []
                held.append(tuple(row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
                out = []
        if len(held) > 1 and (out := joined(held)):
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint")


def crossing(chunks: DataFrame, labels: DataFrame, over: int) -> DataFrame:
    """(grp, i, j, rows): pairs of chunks whose sizes can agree and that aren't one component together."""
    known = chunks.where("many").join(labels.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").withColumn("label", F.coalesce("label", "id"))
    nodes = known.groupBy("grp", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("k"))
    torn = nodes.groupBy("grp").agg(F.min("l").alias("least"), F.max("m").alias("most")).where("least <> most").select("grp")
    nodes = cut(nodes.join(torn, "grp", "left_semi"))
    left, right = (nodes.select("grp", *[F.col(c).alias(f"{c}_{side}") for c in ("chunk", "low", "high", "l", "m", "k")]) for side in "ij")
    fits = (F.col("high_i") * 100 >= F.col("low_j") * over) & (F.col("high_j") * 100 >= F.col("low_i") * over)
    apart = ~((F.col("l_i") == F.col("m_i")) & (F.col("l_j") == F.col("m_j")) & (F.col("l_i") == F.col("l_j")))
    return left.join(right, "grp").where((F.col("chunk_i") < F.col("chunk_j")) & fits & apart).select("grp", F.col("chunk_i").alias("i"), F.col("chunk_j").alias("j"), (F.col("k_i") + F.col("k_j")).alias("rows"))


def rest_links(docs: DataFrame, chunks: DataFrame, labels: DataFrame, pairs: DataFrame, params: JaccardParams) -> DataFrame:
    """(a, b): links between the chunks of a group that ``pairs`` (grp, i, j) names."""
    torn = chunks.join(pairs.select("grp").distinct(), "grp", "left_semi")
    held = cut(torn.join(labels.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select("id", "grp", "chunk", F.coalesce("label", "id").alias("label")))
    side = lambda chunk, n: F.struct(F.col(chunk).alias("chunk"), F.lit(n).alias("side"))
    ends = pairs.select("grp", "i", "j", F.inline(F.array(side("i", 0), side("j", 1))))
    met = with_sets(docs, held, held.count(), params).join(ends, ["grp", "chunk"]).select("grp", "i", "j", "side", "id", "label", "tokens")
    return tree_links(met, ["grp", "i", "j"], params.over)


def jaccard_components(docs: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles and component_id, the least id that links lead to, itself included.

    ``docs`` needs integer ids. Null texts and texts without words have no shingles and link with nothing; rows with a null id get a null
    component; rows with one id are one node, whose links are those of all its rows. Equal sets are one class, joined
    through its least id. Other columns are left out; an empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sized = cut(summaries(plain, params.shingle))
    classes = cut(sized.where("n > 0 AND id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep")))
    members = cut(sized.where("n > 0 AND id IS NOT NULL").join(classes, ["n", "f1", "f2"]).select("id", "n", "m", "rep"))
    copies = cut(members.groupBy("id").agg(F.bool_and(F.col("id") != F.col("rep")).alias("copy")).where("copy").select("id"))
    written = plain.where("id IS NOT NULL AND text IS NOT NULL")
    # more copies than may be broadcast send their keys as well, of which each batch keeps one
    differing = written.join(F.broadcast(copies), "id", "left_anti") if copies.count() <= params.broadcast_rows else written
    groups = components(candidate_edges(differing, params)).select("id", F.col("label").alias("grp"))
    sets = cut(members.where("id = rep").select("id", "n", "m").distinct().join(groups, "id"))
    several = sets.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select("grp")
    chunks = cut(chunked(sets.join(several, "grp", "left_semi"), params))
    links = cut(tree_links(with_sets(plain, chunks.select("id", "grp", "chunk"), chunks.count(), params), ["grp", "chunk"], params.over))
    labels = components(links)
    pairs = cut(crossing(chunks, labels, params.over))
    if not pairs.isEmpty():
        links = cut(links.unionByName(rest_links(plain, chunks, labels, pairs, params)))
        labels = components(links)
    # links between rows of one id with different texts go through the id
    twice = members.groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most")
    if not twice.isEmpty():
        same = members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        labels = components(links.unionByName(same))
        reps = labels.withColumnRenamed("id", "of")
        full = sized.join(reps, sized["id"] == reps["of"], "left")
        return full.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "id")).otherwise(F.col("id")).alias("component_id"))
    found = members.join(labels.withColumnRenamed("id", "of"), F.col("rep") == F.col("of"), "left").select("id", "n", F.coalesce("label", "rep").alias("component_id"))
    empty = sized.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all columns, but of each component only the document of least id.

    Of equal rows (id and text) with words one stays; an id's rows with different texts stay or go together; rows without
    words or id all stay.
    """
    found = jaccard_components(docs, params, id_col, text_col)
    gone = cut(found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("gone")).distinct())
    names = [f"c{i}" for i in range(len(docs.columns))]  # by place, so that equal names do no harm
    at, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    kept = docs.toDF(*names).join(gone, F.col(at) == F.col("gone"), "left_anti")
    twice = cut(found.where("n_shingles > 0").groupBy(F.col(id_col).alias("again")).agg(F.count("*").alias("k")).where("k > 1 AND again IS NOT NULL").select("again"))
    if not twice.isEmpty():
        words, several = F.coalesce(F.col(text).rlike(WORD), F.lit(False)), F.col(at) == F.col("again")
        once = kept.where(words).join(twice, several, "left_semi").dropDuplicates([at, text])
        kept = kept.where(~words).unionByName(kept.where(words).join(twice, several, "left_anti")).unionByName(once)
    return kept.toDF(*docs.columns)
