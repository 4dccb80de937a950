"""Folding a stream of releases: the lockfile's state by stable id, kept from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stable_id string, guid string, source string, releases bigint"
STATE = "guid string, releases bigint"


def fold_releases(notes: DataFrame) -> DataFrame:
    """For a stream of (stable_id, candidate, release): the guid of each note, that of its first release for good.

    State is one guid for each stable id; rows of a batch are taken in order of release.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("release")
        guid, releases = state.get if state.exists else (None, 0)
        out = []
        for candidate in rows["candidate"]:
            source = "lockfile" if guid is not None else "current_derivation"
            guid, releases = guid if guid is not None else candidate, releases + 1
            out.append((key[0], guid, source, releases))
        state.update((guid, releases))
        yield pd.DataFrame(out, columns=["stable_id", "guid", "source", "releases"])

    return notes.groupBy("stable_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
