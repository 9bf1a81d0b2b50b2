"""SimHash fingerprints, and a search within a Hamming radius over permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import kernels as K
from siftwork.session import prepare

BITS = 128
#: Characters of text in a range of consecutive documents, and the most ranges: of a larger corpus, ranges get longer.
RANGE_CHARS, MOST_RANGES = 16_000_000, 100_000
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2) - 1


def simhash(texts: pa.Array) -> np.ndarray:
    """Fingerprints (rows x 16 bytes): every pair of consecutive words votes with its hash's bits, weighted by its count.

    Words are separated by white space and lower-cased in A-Z; a text of one
    word votes with that word; without words the fingerprint is zero.
    """
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    lanes = np.arange(BITS // 8) * 256
    for low, high in K.pieces(texts, 1 << 20):
        for a in range(low, high, 256):
            n = min(high - a, 256)
            data, offsets = K.text_buffer(texts.slice(a, n))
            _, hashes, first = K.words(data, offsets, K.SPACE_LOWER)
            if not len(hashes):
                continue
            row = np.repeat(np.arange(n), np.diff(first))
            pair = row[1:] == row[:-1]
            lone = np.diff(first) == 1
            term = np.r_[K.shingles(hashes, 2)[pair], hashes[first[:-1][lone]]]
            row = np.r_[row[:-1][pair], np.flatnonzero(lone)]
            votes = np.zeros(n * len(lanes) * 256, np.int64)
            for x in range(0, len(term), 1 << 16):  # bounded working arrays for very long texts
                some = term[x : x + (1 << 16)]
                both = np.column_stack([some, K.mix(some ^ np.uint64(K.BASE))]).view(np.uint8).reshape(len(some), BITS // 8)
                at = (row[x : x + (1 << 16), None] * (len(lanes) * 256)) + lanes + both
                top = int(at.max()) + 1
                base = int(at.min())
                votes[base:top] += np.bincount((at - base).reshape(-1), minlength=top - base)
            signed = votes.reshape(n, len(lanes), 256) @ _SIGNS
            out[a : a + n] = np.packbits(signed > 0, axis=2).reshape(n, -1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, 0 to 1."""
    return 1.0 - np.bitwise_count(a ^ b).sum(1) / BITS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) per row; null texts count as empty. ``fingerprint`` is lowercase hex."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([x.tobytes().hex() for x in simhash(batch.column(2))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "n_chars", "fingerprint"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_probes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text and compare with the edited and the next text.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)

    Documents are dealt in ranges of ascending id; the first of each range also
    goes to the range before (that of the first range to the last), so every
    range is read in order with one document of look-ahead. Null texts are empty, null
    ids come first, rows with one id are ordered by text. An empty table gives
    an empty result.
    """
    spark = prepare(docs.sparkSession)
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), place.alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if not size["rows"]:
        return spark.createDataFrame([], schema)
    ranges = min(max(1, -(-(size["n"] or 0) // RANGE_CHARS)), MOST_RANGES)
    cuts = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("place", cuts, max(10_000, 4 * ranges)).alias("c")).first()["c"] if cuts else []
    bounds = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("long")
    def dealt(x):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, x.to_numpy(), "right"))

    keyed = rows.withColumn("range", dealt("place"))
    firsts = sorted((r["range"], r["least"]) for r in keyed.groupBy("range").agg(F.min("place").alias("least")).collect())  # one row a range
    copies = spark.createDataFrame([(least, firsts[i - 1][0]) for i, (_, least) in enumerate(firsts)], "least long, to long")
    # the few rows that open a range, found by their id; a bounded table of one row a range
    opening = rows.join(F.broadcast(copies), rows["place"] == copies["least"]).select("doc_id", "place", "text", F.col("to").alias("range"), F.lit(1).alias("copy"))
    both = keyed.select("doc_id", "place", "text", "range", F.lit(0).alias("copy")).unionByName(opening)
    ordered = both.repartition(len(firsts), "range").sortWithinPartitions("range", "copy", "place", "text").select("doc_id", "text", "range", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (id, text, range) that waits for the next text
        ended = None
        for whole in batches:
            for low, high in K.pieces(whole.column(1), 2 << 20):
                batch = whole.slice(low, high - low)
                ids, texts, nexts = [], [], []
                for doc, text, part, copy in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if held is not None and held[2] == part:
                        ids.append(held[0])
                        texts.append(held[1])
                        nexts.append(text)
                    held = None if copy or ended == part else (doc, text, part)
                    ended = part if copy else ended
                if ids:
                    yield _probe(ids, texts, nexts)

    return ordered.mapInArrow(run, schema)


def _probe(ids: list[int | None], texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    edited = [edited_text(t, n) for t, n in zip(texts, nexts, strict=True)]
    # the next text of one row is nearly always the text of the row after it
    known = {t: i for i, t in enumerate(texts)}
    extra = list(dict.fromkeys(n for n in nexts if n not in known))
    all_ = simhash(pa.array(texts + extra, pa.large_string()))
    known |= {t: len(texts) + i for i, t in enumerate(extra)}
    own, following, changed = all_[: len(texts)], all_[[known[n] for n in nexts]], simhash(pa.array(edited, pa.large_string()))
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([x.tobytes().hex() for x in own]), pa.array([x.tobytes().hex() for x in changed]), pa.array(likeness(own, changed)), pa.array(likeness(own, following)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(q, p, distance): all fingerprints p of ``prints`` within ``radius`` bits of each fingerprint q of ``queries``, both distinct.

    Both tables have fingerprint (hex); rows with equal ones are one, so copies
    are not expanded to pairs. The bits are cut in radius + 1 blocks; one of
    them is equal in any two fingerprints within the radius, so a table permuted
    by each block in turn and joined on it finds all of them, and a pair counts
    in the first block that it shares. Null fingerprints match nothing.
    """
    digits = BITS // 4
    cuts = [round(i * digits / (radius + 1)) for i in range(radius + 2)]
    spans = list(zip(cuts, cuts[1:], strict=False))

    def tables(df: DataFrame, name: str) -> DataFrame:
        blocks = F.array(*[F.struct(F.lit(i).alias("i"), F.substring("fingerprint", a + 1, b - a).alias("bits")) for i, (a, b) in enumerate(spans)])
        return df.select("fingerprint").filter("fingerprint is not null").distinct().select(F.col("fingerprint").alias(name), F.explode(blocks).alias("block"))

    halves = [(1 + 8 * i, 8) for i in range(digits // 8)]
    apart = sum((F.bit_count(F.conv(F.substring("q", a, n), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("p", a, n), 16, 10).cast("long"))) for a, n in halves), F.lit(0))
    shared = F.coalesce(*[F.when(F.substring("q", a + 1, b - a) == F.substring("p", a + 1, b - a), F.lit(i)) for i, (a, b) in enumerate(spans)])
    near = tables(queries, "q").join(tables(prints, "p"), "block").filter(F.col("block.i") == shared).withColumn("distance", apart.cast("long"))
    return near.filter(F.col("distance") <= radius).select("q", "p", "distance")


def neighbours(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, n_within, nearest) per row of ``queries``: how many rows of ``prints`` lie within ``radius`` bits, itself aside, and the least distance (null: none).

    ``queries`` are rows of ``prints`` (doc_id, fingerprint). Rows of one
    fingerprint are counted, not paired.
    """
    sizes = prints.groupBy(F.col("fingerprint").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    found = within_radius(prints, queries, radius).join(sizes, "p")
    others = F.col("n") - F.when(F.col("distance") == 0, 1).otherwise(0)
    found = found.groupBy(F.col("q").alias("fingerprint")).agg(F.sum(others).alias("n_within"), F.min(F.when(others > 0, F.col("distance"))).alias("nearest"))
    return queries.join(found, "fingerprint", "left").select("doc_id", "fingerprint", F.coalesce("n_within", F.lit(0).cast("long")).alias("n_within"), "nearest")
