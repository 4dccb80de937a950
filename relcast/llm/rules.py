"""Quality rules with risk-controlled cutoffs.

Each rule is a share of a text (symbols, repeated lines, ...) that speaks against it. Labelled documents are the holdout:
for a stratum and a rule, the cutoff goes down from 1 step by step as long as an exact binomial test shows that at most
``risk`` of the good documents would be rejected. Steps are tested in a fixed order and end at the first failure, so they
need no correction; strata and rules share ``error`` by Bonferroni, and rules share ``risk``. With too few labels no cutoff
passes and the rule rejects nothing.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, cut, per_text

SPACE = b"\x20\t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Rules: name, and numerator and denominator among the features.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "upper": ("n_upper", "word_chars"),
    "exclaims": ("n_exclaims", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "adjacent": ("n_adjacent", "n_words"),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims", "n_adjacent")


@dataclass(frozen=True)
class RuleParams:
    risk: float = 0.02  # most good documents of a stratum that the rules may reject together
    error: float = 0.05  # chance that this fails in any stratum
    steps: int = 256  # cutoffs are multiples of 1 / steps


def byte_classes() -> np.ndarray:
    """1 white space, 2 goes on with a character, 3 symbol, 4 A-Z, 5 exclamation mark, else 0."""
    out = np.zeros(256, np.uint8)
    out[0x80:0xC0], out[65:91], out[33] = 2, 4, 5
    out[list(SPACE)], out[list(SYMBOLS)] = 1, 3
    return out


def measure(raw: bytes | None, classes: np.ndarray) -> tuple[int, ...]:
    """FEATURES of a text; a null text has no words."""
    if not raw:
        return (0,) * len(FEATURES)
    words = raw.split()
    kind = np.bincount(classes[np.frombuffer(raw, np.uint8)], minlength=6).tolist()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n, repeated, adjacent = len(words), 0, 0
    if n > 1:
        code = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        adjacent = int((code[1:] == code[:-1]).sum())
        if n > 3:
            window = (code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:]
            order = np.argsort(window)
            same = window[order[1:]] == window[order[:-1]]
            if same.any():
                twice = np.zeros(n - 2, bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                covered = np.zeros(n, bool)
                for k in range(3):
                    covered[k : k + n - 2] |= twice
                repeated = int(covered.sum())
    return n, sum(kind) - kind[1] - kind[2], kind[3], len(lines) - len(set(lines)), repeated, len(lines), kind[4], kind[5], adjacent


def _measurer() -> Callable[[list], dict[str, pa.Array]]:
    classes = byte_classes()

    def work(batch: list[bytes | None]) -> dict[str, pa.Array]:
        columns = zip(*[measure(t, classes) for t in batch], strict=True)
        return {name: pa.array(values, pa.int64()) for name, values in zip(FEATURES, columns, strict=True)}

    return work


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """FEATURES of every text, in one pass without exchange."""
    return per_text(docs, keep, text_col, ", ".join(f"{name} bigint" for name in FEATURES), _measurer)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def step_of(rule: str, steps: int) -> Column:
    """The rule's share as a whole number of steps, 0 to ``steps``."""
    over, under = RULES[rule]
    return F.when(F.col(under) > 0, F.least(F.floor(F.col(over) * steps / F.col(under)), F.lit(steps))).otherwise(0).cast("int")


def stirling_rest(n: int) -> float:
    """log n! less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    x = 1.0 / n
    return x * (1 / 12 - x * x * (1 / 360 - x * x * (1 / 1260 - x * x * (1 / 1680 - x * x / 1188))))


def deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where x is near the mean."""
    d = (x - mean) / mean
    if abs(d) > 0.1:
        return x * math.log(x / mean) + mean - x
    # (1 + d) log(1 + d) - d = d^2 / 2 - d^3 / 6 + d^4 / 12 - ...
    return mean * math.fsum((-1) ** j * d**j / (j * (j - 1)) for j in range(2, 24))


def exactly(k: int, n: int, p: float) -> float:
    """Chance of k of n, each with chance p, by Loader's expansion: the logarithms of factorials don't cancel each other."""
    if k in (0, n):
        return math.exp(n * (math.log1p(-p) if k == 0 else math.log(p)))
    log = stirling_rest(n) - stirling_rest(k) - stirling_rest(n - k) - deviance(k, n * p) - deviance(n - k, n * (1 - p))
    return math.exp(log) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def at_most(k: int, n: int, p: float) -> float:
    """Chance of at most k of n, each with chance p: all terms down from k (or up from k + 1) that count in a float."""
    if k >= n:
        return 1.0
    down = k <= n * p
    at, step = (k, -1) if down else (k + 1, 1)
    total, term, width = 0.0, exactly(at, n, p), 1 << 14
    while 0 <= at <= n and term > total * 1e-18:
        i = np.arange(at, max(-1, at - width) if down else min(n + 1, at + width), step, dtype=np.float64)
        ratio = i * (1 - p) / ((n - i + 1) * p) if down else (n - i) * p / ((i + 1) * (1 - p))
        terms = term * np.concatenate([[1.0], np.cumprod(ratio)])
        total, term, at = total + math.fsum(terms[:-1]), float(terms[-1]), at + step * len(i)
    return min(1.0, total) if down else max(0.0, 1.0 - total)


def certified(rejected: list[int], total: int, risk: float, error: float) -> int | None:
    """The least cutoff, in steps, for which at most ``risk`` of good documents are rejected; None if there is none.

    ``rejected[c]`` is how many of the ``total`` good documents have at least c steps.
    """
    found = None
    for c in range(len(rejected) - 1, 0, -1):
        k = rejected[c]
        if k > risk * total or at_most(k, total, risk) > error:
            break
        found = c
    return found


def fit_cutoffs(features: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """(stratum, rule, cutoff): cutoffs in steps, where one is certified.

    ``features`` has id, stratum and FEATURES, ``labels`` id and good (boolean). All labelled rows count; a task gets the
    counts by step of a stratum and rule, the driver the number of these. Documents that fail the base rules are no
    evidence about the others.
    """
    good = features.where(~base_failed()).join(labels.where("good").select("id").distinct(), "id")
    steps = F.array(*[F.struct(F.lit(rule).alias("rule"), step_of(rule, params.steps).alias("step")) for rule in RULES])
    counts = good.select("stratum", F.inline(steps)).groupBy("stratum", "rule", "step").agg(F.count("*").alias("n"))
    tables = cut(counts.groupBy("stratum", "rule").agg(F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("counts")))
    risk, error = params.risk / len(RULES), params.error / max(1, tables.count())

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            cutoffs = []
            for entries in frame.column("counts").to_pylist():
                by_step = [0] * (params.steps + 1)
                for step, n in entries:
                    by_step[step] = n
                rejected = np.cumsum(by_step[::-1])[::-1].tolist()
                cutoffs.append(certified(rejected, rejected[0], risk, error))
            yield pa.RecordBatch.from_arrays([frame.column("stratum"), frame.column("rule"), pa.array(cutoffs, pa.int32())], ["stratum", "rule", "cutoff"])

    return tables.mapInArrow(run, "stratum string, rule string, cutoff int").where("cutoff IS NOT NULL")


def judge_quality(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: id, FEATURES, base_failed and kept.

    A null text has no words and fails the base; documents with a null stratum are a stratum of their own; rows of
    ``labels`` with null id or label are no labels, label 1 means good, and a document is good if any label says so.
    Repeated rows stay; other columns are left out; without labels only the base decides; an empty table gives an empty
    result. The features are measured in one pass over the texts and written, since cutoffs and verdicts both need them.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(stratum_col).cast("string")), F.lit("n")).alias("stratum"), F.col(text_col).alias("text"))
    features = cut(measured(keyed, ["id", "stratum"]))
    known = labels.select(F.col(label_id).alias("id"), (F.col(label_col) == 1).alias("good")).dropna()
    cutoffs = cut(fit_cutoffs(features, known, params).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")))
    fires = reduce(operator.or_, [step_of(rule, params.steps) >= F.element_at("cutoffs", F.lit(rule)) for rule in RULES])
    judged = beside(features, cutoffs, "stratum", "left")
    return judged.select(F.col("id").alias(id_col), *FEATURES, base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce(fires, F.lit(False))).alias("kept"))
