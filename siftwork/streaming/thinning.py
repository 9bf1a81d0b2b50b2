"""Streaming form of the minimum-gap thinning (an extension of ours): the state of a subject is its last accepted moment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwork.session import prepare


def thin_stream(moments: DataFrame, subject: str, t: str, gap: float) -> DataFrame:
    """(subject, t) of moments ``gap`` or more after the last accepted one; moments are taken in the order of their micro-batches."""
    prepare(moments.sparkSession)
    kinds = dict(moments.dtypes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1000.0
        kept = []
        for x in sorted(x for pdf in frames for x in pdf[t]):
            if x > 0 and x - last >= gap:
                kept.append(x)
                last = x
        state.update((last,))
        yield pd.DataFrame({subject: [key[0]] * len(kept), t: kept})

    schema = f"`{subject}` {kinds[subject]}, `{t}` double"
    return moments.select(subject, moments[t].cast("double").alias(t)).groupBy(subject).applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.NoTimeout)
