"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are partitioned by their number of shingles (powers of two). Each
partition keeps, of every item, a min-wise sketch: its smallest shingle hashes.
The sketch length of a partition is the number of shingles that a document may
miss at the wanted containment, plus one, for the partition's largest item; so
a document that contains enough of an item contains an entry of its sketch, and
the search loses nothing however long the document is. All shingles of a
document are probed; candidates are verified shingle by shingle on their words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import kernels as K
from siftwork.session import prepare

#: Item text in one broadcast: larger sets are searched in several blocks.
BLOCK_BYTES = 16_000_000


def normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, spans, hashes and first words of the lower-cased rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = K.text_buffer(pc.utf8_lower(column))
    spans, hashes, first = K.words(data, offsets, K.ALNUM_LOWER)
    return data, spans, hashes, first


def joined(data: np.ndarray, spans: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A row's words joined by single blanks and the place of each."""
    parts = [data[a:b].tobytes() for a, b in spans]
    return b" ".join(parts), np.r_[0, np.cumsum([len(p) + 1 for p in parts])].astype(np.int64)


@dataclass
class Index:
    """Items of one block: shingle length, shingle hashes, first word of each, the words and their places; sketch hashes by shingle length."""

    items: list[tuple[int | None, int, np.ndarray, np.ndarray, bytes, np.ndarray]] = field(default_factory=list)
    sketches: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    needs: list[int] = field(default_factory=list)


def build(ids: list[int | None], texts: pa.Array, words: int, percent: int) -> Index:
    index = Index()
    data, spans, hashes, first = normal(texts)
    parts: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, item in enumerate(ids):
        mine = hashes[first[i] : first[i + 1]]
        if not len(mine):
            continue
        k = min(words, len(mine))
        found, at = np.unique(K.shingles(mine, k), return_index=True)
        text, place = joined(data, spans[first[i] : first[i + 1]])
        parts[k, int(len(found)).bit_length()].append(len(index.items))
        index.items.append((item, k, found, at, text, place.astype(np.int32)))
        index.needs.append(-(-percent * len(found) // 100))
    sketches: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
    for (k, _), members in parts.items():
        largest = max(len(index.items[m][2]) for m in members)
        length = largest - -(-percent * largest // 100) + 1
        for m in members:
            sketches[k].append((index.items[m][2][:length], m))  # sorted: the smallest hashes
    for k, found in sketches.items():
        flat = np.concatenate([h for h, _ in found])
        owner = np.repeat([m for _, m in found], [len(h) for h, _ in found])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        bits = max(16, int(len(flat) * 16).bit_length())
        filter_ = np.zeros(1 << bits, bool)
        filter_[flat >> np.uint64(64 - bits)] = True
        index.sketches[k] = (flat, owner, filter_)
    return index


def search(index: Index, texts: pa.Array, percent: int) -> Iterator[tuple[int, int, int]]:
    """(row, item number, shared shingles) of every row that contains enough of an item."""
    data, spans, hashes, first = normal(texts)
    for k, (flat, owner, filter_) in index.sketches.items():
        grams = K.shingles(hashes, k)  # those across rows are skipped below
        shift = np.uint64(64 - (len(filter_) - 1).bit_length())
        at = np.flatnonzero(filter_[grams >> shift])
        low = np.searchsorted(flat, grams[at])
        hit = low < len(flat)
        hit[hit] = flat[low[hit]] == grams[at[hit]]
        at, low = at[hit], low[hit]
        row = np.searchsorted(first, at, "right") - 1
        inside = at + k <= first[row + 1]
        at, low, row = at[inside], low[inside], row[inside]
        for r in np.unique(row):
            candidates = set()
            for h in np.unique(grams[at[row == r]]):
                a, b = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
                candidates.update(owner[a:b].tolist())
            own, where = np.unique(grams[first[r] : first[r + 1] - k + 1], return_index=True)
            text = place = None
            for m in sorted(candidates):
                _, _, item, start, words, at_word = index.items[m]
                spot = np.minimum(np.searchsorted(own, item), len(own) - 1)
                same = np.flatnonzero(own[spot] == item)
                if len(same) < index.needs[m]:
                    continue
                if text is None:
                    text, place = joined(data, spans[first[r] : first[r + 1]])
                begin, end = at_word[start[same]], at_word[start[same] + k] - 1
                shared = sum(text[place[w] : place[w + k] - 1] == words[x:y] for x, y, w in zip(begin, end, where[spot[same]], strict=True))
                if shared >= index.needs[m]:
                    yield int(r), m, shared


def _indexes(items: DataFrame, item_id: str, item_text: str, words: int, percent: int) -> list:
    """Broadcast indexes of all items, BLOCK_BYTES of text each."""
    spark = prepare(items.sparkSession)
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    size = tests.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = int(-(-size // BLOCK_BYTES)) or 1
    out = []
    for b in range(blocks):
        held = (tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)).toArrow()
        out.append(spark.sparkContext.broadcast(build(held.column(0).to_pylist(), held.column(1), words, percent)))
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every document holding enough of an item.

    Words are runs of letters, digits and non-ASCII characters, lower-cased; an
    item's distinct shingles of ``words`` words (an item with fewer words is one
    shingle) must occur in the document to ``percent`` at least. Items and
    documents without words match nothing. Rows with null or repeated ids count
    as rows of their own; only the four named columns are read. Items are
    broadcast in blocks of BLOCK_BYTES of text, each block searched in a pass of
    its own over all documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, item_id bigint, n_item_shingles bigint, n_shared bigint, containment double"
    out = None
    for index in _indexes(items, item_id, item_text, words, percent):

        @K.tidy
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low, high in K.pieces(whole.column(1)):
                    batch = whole.slice(low, high - low)
                    found = list(search(index.value, batch.column(1), percent))
                    if found:
                        items = [index.value.items[m] for _, m, _ in found]
                        sizes = np.array([len(x[2]) for x in items], np.int64)
                        shared = np.array([s for _, _, s in found], np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([r for r, _, _ in found])), pa.array([x[0] for x in items], pa.int64()), pa.array(sizes), pa.array(shared), pa.array(shared / sizes)],
                            ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"],
                        )

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, whole, that hold enough of no item, as :func:`contaminated` finds it.

    Each row is judged by its own text while it passes, whatever its id, so
    nothing is joined; blocks of items are filters one behind the other.
    """
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    out = docs
    for index in _indexes(items, item_id, item_text, words, percent):

        @K.tidy
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low, high in K.pieces(whole.column(at)):
                    batch = whole.slice(low, high - low)
                    keep = np.ones(len(batch), bool)
                    keep[[r for r, _, _ in search(index.value, batch.column(at), percent)]] = False
                    yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
