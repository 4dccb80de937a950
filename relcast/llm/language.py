"""Language identification with bit-sliced Bloom filters of character n-grams.

For every language the model has the n-grams that make up at least a given share of its text. All languages share one
Bloom filter whose slots are words of bits, one bit for each language: and-ing the slots of an n-gram's hashes gives the
set of languages that contain it. A text's hits are counted by language, the hits that the filter's false positives would
give are taken off, and the language with most hits left is the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, per_text, texts

MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LanguageParams:
    sizes: tuple[int, ...] = (3, 4)  # of n-grams, in characters
    share: float = 1e-4  # least share of a language's n-grams; at most 1 / share n-grams of a size pass, so the model is bounded
    docs_per_language: int = 4000  # the counts are of about so many whole texts of a language, chosen by a hash of their id
    slots: int = 1 << 19
    hashes: int = 2
    seed: int = 11


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]  # by code point
    grams: tuple[np.ndarray, ...]  # of each language, hashed
    prior: int  # place of the language with most documents
    params: LanguageParams


def letters_table() -> np.ndarray:
    """1 for code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def folded(raw: bytes | None, letters: np.ndarray) -> np.ndarray | None:
    """Code points of the text in lower case, each run of other characters than letters one space; None without a letter."""
    points = np.frombuffer((raw or b"").decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[points]
    if not is_letter.any():
        return None
    points = np.where(is_letter, points, np.uint32(32))
    space = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return np.concatenate([[32], points[keep], [32]]).astype(np.uint64)


def grams(points: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all n-grams of a size that don't have a space inside."""
    if len(points) < size:
        return np.empty(0, np.uint64)
    n = len(points) - size + 1
    out, inside = np.full(n, size, np.uint64), np.zeros(n, bool)
    for k in range(size):
        part = points[k : k + n]
        out = (out * np.uint64(0x100000001B3)) ^ part
        if 0 < k < size - 1:
            inside |= part == 32
    out = out[~inside] * MIX
    return out ^ (out >> np.uint64(29))


def build_filter(model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(slices, slots) words of bits, and each language's rate of false positives."""
    p, slices = model.params, -(-max(1, len(model.languages)) // 64)
    bits, rate = np.zeros((slices, p.slots), np.uint64), np.zeros(len(model.languages))
    for lang, hashed in enumerate(model.grams):
        bit = np.uint64(1 << (lang % 64))
        for slot in slots_of(hashed, p):
            np.bitwise_or.at(bits[lang // 64], slot, bit)
        rate[lang] = float(((bits[lang // 64] & bit) != 0).mean()) ** p.hashes
    return bits, rate


def slots_of(hashed: np.ndarray, p: LanguageParams) -> list[np.ndarray]:
    step = (hashed >> np.uint64(32)) | np.uint64(1)
    return [((hashed + np.uint64(k) * step) % np.uint64(p.slots)).astype(np.int64) for k in range(p.hashes)]


def fit_languages(docs: DataFrame, params: LanguageParams = LanguageParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the rows of ``docs`` that have text and language; the caller leaves out what is held out.

    n-grams are counted on executors and summed; what reaches the driver is a count and at most ``1 / share`` n-grams for each
    language and size. Facts by language are joined as small tables, so plans don't grow with the number of languages.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes, key=lambda x: x.encode()))
    if not languages:
        return LanguageModel((), (), 0, params)
    chance = F.pmod(F.xxhash64(F.lit(params.seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    known = docs.sparkSession.createDataFrame([(lang, place, min(1.0, params.docs_per_language / sizes[lang])) for place, lang in enumerate(languages)], "lang string, place int, share double")
    sample = labelled.withColumn("chance", chance).join(F.broadcast(known), "lang").where("chance < share").select("place", "text")

    def count(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letters_table()
        for batch in batches(frames, "text", 2048, 2 << 20):
            held: dict[tuple[int, int], list[np.ndarray]] = {}
            for lang, raw in zip(batch.column("place").to_pylist(), texts(batch, "text"), strict=True):
                if (points := folded(raw, letters)) is not None:
                    for size in params.sizes:
                        held.setdefault((lang, size), []).append(grams(points, size))
            for (lang, size), parts in held.items():
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), lang, np.int32)), pa.array(np.full(len(n), size, np.int32)), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["place", "size", "gram", "n"])

    counts = cut(sample.mapInArrow(count, "place int, size int, gram bigint, n bigint").groupBy("place", "size", "gram").agg(F.sum("n").alias("n")))
    least = counts.groupBy("place", "size").agg((F.sum("n") * params.share).alias("least"))
    rows: list[list[int]] = [[] for _ in languages]
    for r in counts.join(F.broadcast(least), ["place", "size"]).where("n >= least").select("place", "gram").collect():
        rows[r["place"]].append(r["gram"])
    return LanguageModel(languages, tuple(np.sort(np.array(r, np.int64)).view(np.uint64) for r in rows), max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k)), params)


def _predictor(model: LanguageModel) -> Callable[[], Callable[[list], dict[str, pa.Array]]]:
    def make() -> Callable[[list], dict[str, pa.Array]]:
        letters, (bits, rate) = letters_table(), build_filter(model)

        def predict(raw: bytes | None) -> tuple[str, float]:
            points = folded(raw, letters)
            if points is None or not model.languages:
                return "und", 0.0
            left = np.zeros(len(model.languages))
            for size in model.params.sizes:
                hashed = grams(points, size)
                sets = [np.bitwise_and.reduce([row[slot] for slot in slots_of(hashed, model.params)]) for row in bits]
                for lang in range(len(left)):
                    hits = np.count_nonzero(sets[lang // 64] & np.uint64(1 << (lang % 64)))
                    left[lang] += max(0.0, (hits - len(hashed) * rate[lang]) / max(1e-9, 1 - rate[lang]))
            if left.sum() <= 0:
                return model.languages[model.prior], 0.0
            best = int(left.argmax())
            return model.languages[best], float(left[best] / left.sum())

        def work(batch: list[bytes | None]) -> dict[str, pa.Array]:
            found = [predict(t) for t in batch]
            return {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}

        return work

    return make


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, lang_pred and score (the language's share of all hits, 0 to 1).

    A null text and one without a letter is ``und`` with score 0, and so is every text if nothing was learned. A text
    with no known n-gram gets the language with most documents and score 0; ties go to the first language by code point.
    Repeated rows and null ids stay, other columns are left out, a long text is read whole, an empty table gives an empty
    result. One pass without exchange.
    """
    return per_text(docs, [id_col], text_col, "lang_pred string, score double", _predictor(model))


def held_out(doc_id):
    """Whether a document is never learned from: crc32 of the id as text is divisible by 5 (a null id counts as empty)."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "utf-8")) % 5 == 0
