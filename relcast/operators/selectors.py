"""Selectors ``kind[key='value',...]``: parsing, and finding the one row that a selector names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SelectorError(ValueError):
    """``reason``: Empty, ArrayIndexNotAllowed, InvalidPredicate, Unmatched or Ambiguous."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


@dataclass(frozen=True)
class Selector:
    kind: str
    predicates: tuple[tuple[str, str], ...]

    def condition(self) -> Column:
        """A native filter on columns kind and attributes (a map)."""
        out = F.col("kind") == self.kind
        for key, value in self.predicates:
            out = out & (F.try_element_at("attributes", F.lit(key)) == value)
        return out


NAME = r"[A-Za-z_][A-Za-z0-9_-]*"
PREDICATE = re.compile(rf"""\s*({NAME})\s*=\s*(?:'([^']*)'|"([^"]*)")\s*(,|\Z)""")
QUOTED = re.compile(r"""'[^']*'|"[^"]*\"""")


def parse(text: str) -> Selector:
    text = text.strip()
    if not text:
        raise SelectorError("Empty")
    if re.search(r"\[\s*[0-9]+\s*\]", QUOTED.sub("''", text)):
        raise SelectorError("ArrayIndexNotAllowed")
    m = re.fullmatch(rf"({NAME})\s*\[(.*)\]", text, re.DOTALL)
    if not m or not m[2].strip():
        raise SelectorError("InvalidPredicate")
    found: dict[str, str] = {}
    inner, at = m[2], 0
    while at < len(inner):
        p = PREDICATE.match(inner, at)
        if not p or p[1] in found or (p[4] == "," and not inner[p.end() :].strip()):
            raise SelectorError("InvalidPredicate")
        found[p[1]], at = p[2] if p[2] is not None else p[3], p.end()
    return Selector(m[1], tuple(found.items()))


def matching(selector: Selector, targets: DataFrame) -> DataFrame:
    return targets.where(selector.condition())


def resolve(selector: Selector, targets: DataFrame):
    """The one row that matches; two are enough to know that there are several."""
    rows = matching(selector, targets).limit(2).collect()
    if len(rows) != 1:
        raise SelectorError("Ambiguous" if rows else "Unmatched")
    return rows[0]
