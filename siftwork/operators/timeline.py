"""Sampling of timelines: change scores, adaptive threshold, minimum gap, uniform fill.

A timeline is one subject's moments in order. Its scans are sequential, so each
runs inside its subject; subjects are spread over tasks. All take (subject, t)
and break ties by an id column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import numeric
from siftwork.session import prepare

MIN_GAP, UNIFORM_GAP = 0.35, 0.5
#: Equal to no subject.
_NONE = object()


def change_scores(df: DataFrame, subject: str, t: str, tie: str, value: str, scale: float = 1.0) -> DataFrame:
    """Add score: the size of the change against the moment before, over ``scale`` (0 for the first)."""
    before = F.lag(value).over(Window.partitionBy(subject).orderBy(t, tie))
    return df.withColumn("score", F.coalesce(F.abs(F.col(value) - before) / scale, F.lit(0.0)))


def wanted_scenes(target: Column) -> Column:
    return F.greatest(F.lit(4), F.bround(target * 0.62).cast("int"))


def adaptive_threshold(scored: DataFrame, targets: DataFrame, subject: str, initial: float = 0.32) -> DataFrame:
    """(subject, threshold, scenes, wanted): the threshold a subject is cut with.

    Thresholds are tried in order up to the first whose count is within 35 % of
    the wanted one; of those tried, the count nearest to it wins, the earlier
    one on ties. All thresholds are counted in one pass.
    """
    tried = numeric.scene_thresholds(initial)
    counts = scored.groupBy(subject).agg(*[F.count_if(F.col("score") > t).alias(f"n{i}") for i, t in enumerate(tried)])
    rows = targets.join(counts, subject, "left").withColumn("wanted", wanted_scenes(F.col("target")))
    trials = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("threshold"), F.coalesce(f"n{i}", F.lit(0)).alias("scenes")) for i, t in enumerate(tried)])
    within = lambda x: (x["scenes"] >= F.col("wanted") * 0.65) & (x["scenes"] <= F.col("wanted") * 1.35)
    last = F.coalesce(F.get(F.filter(trials, within), 0)["ord"], F.lit(len(tried) - 1))
    run = F.filter(trials, lambda x: x["ord"] <= last)
    best = F.array_min(F.transform(run, lambda x: F.struct(F.abs(x["scenes"] - F.col("wanted")).alias("off"), x["ord"].alias("ord"), x["threshold"].alias("threshold"), x["scenes"].alias("scenes"))))
    return rows.select(subject, best["threshold"].alias("threshold"), best["scenes"].alias("scenes"), "wanted")


def thin(moments: DataFrame, subject: str, t: str, gap: float, most: str | int | None = None) -> DataFrame:
    """(subject, t, sequence): moments after 0 which lie ``gap`` or more after the last one accepted, ``most`` at most.

    Acceptance depends on the last accepted moment, so a subject is one sorted
    stream through a task; only that moment and a count are held, however long
    the subject is, and the search jumps from one accepted moment to the next.
    """
    prepare(moments.sparkSession)
    cap = F.lit(1 << 62) if most is None else F.lit(most) if isinstance(most, int) else F.col(most)
    rows = moments.select(F.col(subject), F.col(t).cast("double").alias("t"), cap.cast("long").alias("cap")).filter("t > 0")
    kind = rows.schema[subject].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, count = _NONE, 0.0, 0
        for batch in batches:
            names, times, caps = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            rows_, numbers = [], []
            for low, high in zip(cuts, cuts[1:], strict=False):
                if names[low] != current:
                    current, last, count = names[low], -1000.0, 0
                i = low
                while i < high and count < caps[low]:
                    i += int(np.searchsorted(times[i:high], last + gap))
                    while i > low and times[i - 1] - last >= gap:  # the sum rounds: the difference decides
                        i -= 1
                    while i < high and not times[i] - last >= gap:
                        i += 1
                    if i < high:
                        last, count = float(times[i]), count + 1
                        rows_.append(i)
                        numbers.append(count)
            at = pa.array(rows_, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32())], ["subject", "t", "sequence"])

    ordered = rows.repartition(subject).sortWithinPartitions(subject, "t")
    return ordered.mapInArrow(run, f"`{subject}` {kind}, t double, sequence int")


def uniform_fill(subjects: DataFrame, accepted: DataFrame, subject: str, gap: float = UNIFORM_GAP) -> DataFrame:
    """(subject, t, sequence): even moments that fill a subject up to its target.

    ``subjects``: subject, duration, target. Twice as many candidates as moments
    are missing are scanned in order of time until enough lie ``gap`` from all
    accepted ones, those added included; with few conflicts the early part of
    the timeline is covered first.
    """
    have = accepted.groupBy(subject).agg(F.collect_list(F.col("t").cast("double")).alias("have"))
    rows = subjects.join(have, subject, "left").withColumn("have", F.coalesce("have", F.array().cast("array<double>")))
    rows = rows.withColumn("needed", F.greatest(F.lit(1), F.col("target") - F.size("have"))).withColumn("candidates", numeric.evenly_spaced(F.col("duration"), F.col("needed") * 2))

    def step(s: Column, x: Column) -> Column:
        # candidates ascend, so of those added the last one is the nearest
        apart = F.forall(F.col("have"), lambda y: F.abs(y - x) >= gap) & F.coalesce(x - F.try_element_at(s, F.lit(-1)) >= gap, F.lit(True))
        return F.when((F.size(s) < F.col("needed")) & apart, F.concat(s, F.array(x))).otherwise(s)

    added = rows.select(subject, F.aggregate("candidates", F.array().cast("array<double>"), step).alias("added"))
    return added.select(subject, F.posexplode("added").alias("i", "t")).select(subject, "t", (F.col("i") + 1).alias("sequence"))


def nearest_moment(wanted: DataFrame, moments: DataFrame, subject: str, t: str, payload: list[str]) -> DataFrame:
    """Join each wanted moment to the subject's nearest row (ties: the earlier): the row before and the row after, found by a window."""
    rows = moments.select(subject, F.col(t).cast("double").alias("t"), F.struct(F.col(t).cast("double").alias("at"), *payload).alias("_row"), F.lit(0).alias("_want"))
    asked = wanted.select(subject, F.col("t").cast("double").alias("t"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(1).alias("_want"))
    both = rows.unionByName(asked)
    w = Window.partitionBy(subject).orderBy("t", "_want")
    before = F.last("_row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_row", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("_b", before).withColumn("_a", after).filter("_want = 1")
    near = F.when(F.col("_b").isNull() | ((F.col("_a.at") - F.col("t")) < (F.col("t") - F.col("_b.at"))), F.col("_a")).otherwise(F.col("_b"))
    return found.select(subject, "t", near.alias("row"))


def frame_ids(frames: DataFrame, subject: str, t: str, tie: str) -> DataFrame:
    """Add frame_id FRM-<subject>-0001 … in order of time over all statuses."""
    n = F.row_number().over(Window.partitionBy(subject).orderBy(t, tie))
    return frames.withColumn("frame_id", F.format_string("FRM-%s-%04d", F.col(subject).cast("string"), n))


def kept_guard(frames: DataFrame, subject: str, least: int = 3) -> DataFrame:
    """Subjects of which too few frames are kept: (subject, kept)."""
    return frames.groupBy(subject).agg(F.count_if(F.col("status") == "kept").alias("kept")).filter(F.col("kept") < least)
