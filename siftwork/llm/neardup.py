"""Near-duplicate classes by HyperMinHash banding, confirmed on full shingle sets.

1. One pass per text: its distinct word shingles, a digest of the whole set and
   a one-permutation HyperMinHash sketch. A register holds the leading-zero
   count and MANTISSA following bits of the smallest hash of its bucket; empty
   registers borrow a filled one chosen by hash, so that every register of two
   sets agrees with the probability of their Jaccard similarity.
2. Equal sets collapse to one class (their smallest id); only classes go on.
3. Bands of ROWS registers are aggregated by value. Every class of a band value
   is compared with the smallest class there, never with all others; those whose
   collision-corrected estimate is far too low go on with a hub of their own.
   Connected classes form a family: classes that might be linked, directly or
   over others.
4. Families are resolved exactly: a search over full sets finds every component
   and emits a spanning tree, not all pairs. Families over the memory bound are
   cut in blocks, each pair of blocks being searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import kernels as K
from siftwork.llm.graph import components
from siftwork.session import prepare, stored

REGISTERS, ROWS, MANTISSA = 256, 6, 10
BANDS = REGISTERS // ROWS
#: Probability that registers of different values agree by chance: about 2**-MANTISSA over the leading-zero levels.
COLLISION = 2.0 ** -(MANTISSA + 1)
#: Pairs estimated under this similarity form no family. The standard error of an estimate is 0.03.
FAMILY = 0.3
#: Hubs that a band tries.
ROUNDS = 2
#: Shingles of a family (or pair of blocks) that a task holds at a time.
HELD = 3_000_000


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers (uint16) of sorted distinct hashes; at least one hash."""
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = hashes[first] << np.uint64(8)
    zeros = np.full(len(rest), 0, np.uint64)
    x = rest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        small = x < (np.uint64(1) << np.uint64(64 - step))
        zeros[small] += np.uint64(step)
        x[small] <<= np.uint64(step)
    mantissa = (x << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(REGISTERS, np.uint16)
    full = np.zeros(REGISTERS, bool)
    out[bucket[first]] = ((np.minimum(zeros, np.uint64(62)) + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa
    full[bucket[first]] = True
    empty, turn = np.flatnonzero(~full), 0
    while len(empty):  # the probe order depends on register and turn only
        turn += 1
        probe = (K.mix((empty + turn * REGISTERS).astype(np.uint64)) >> np.uint64(56)).astype(np.int64)
        hit = full[probe]
        out[empty[hit]] = out[probe[hit]]
        empty = empty[~hit]
    return out


def profile(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, registers) per row; set_key and registers are null for texts without words."""
    schema = "doc_id bigint, n_shingles bigint, set_key binary, registers binary"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in K.pieces(whole.column(1)):
                batch = whole.slice(low, high - low)
                data, offsets = K.text_buffer(batch.column(1))
                _, hashes, first = K.words(data, offsets, K.SPACE_LOWER)
                sizes, keys, registers = [], [], []
                for i in range(len(batch)):
                    found = K.row_shingles(hashes[first[i] : first[i + 1]], k)
                    sizes.append(len(found))
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    registers.append(sketch(found).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(registers, pa.binary())],
                    ["doc_id", "n_shingles", "set_key", "registers"],
                )

    return rows.mapInArrow(run, schema)


def _bands(classes: DataFrame) -> DataFrame:
    """(cls, band): one long per class and band, its number mixed in."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(batch), REGISTERS)
            value = np.zeros((len(batch), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for j in range(ROWS):
                value = K.mix(value ^ flat[:, j : BANDS * ROWS : ROWS])
            cls = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(value.reshape(-1).view(np.int64))], ["cls", "band"])

    return classes.select("cls", "registers").mapInArrow(run, "cls bigint, band bigint")


def _estimates(pairs: DataFrame) -> DataFrame:
    """(u, v, near): whether the corrected estimate of pairs (u, v, a, b: registers) reaches FAMILY."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), REGISTERS) for c in ("a", "b"))
            agree = (a == b).mean(1)
            near = (agree - COLLISION) / (1 - COLLISION) >= FAMILY
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(near)], ["u", "v", "near"])

    return pairs.mapInArrow(run, "u bigint, v bigint, near boolean")


def _family_links(bands: DataFrame, registers: DataFrame) -> DataFrame:
    """Links (u, v) that put all classes of a band which might be linked into one family.

    In each band the smallest class is the hub and all others are estimated
    against it. Those that are far from it are no less near to each other: they
    form a band of their own with a new hub, and so on; after ROUNDS rounds the
    rest of a band is linked without an estimate, so no pair that shares a band
    is lost.
    """
    links = None
    for turn in range(ROUNDS + 1):
        hubs = bands.groupBy("band").agg(F.min("cls").alias("hub"), F.max("cls").alias("last")).filter("hub < last")
        rows = stored(bands.join(hubs.select("band", "hub"), "band").filter("cls <> hub").select("band", F.col("hub").alias("u"), F.col("cls").alias("v")), "banded")
        pairs = rows.select("u", "v").distinct()
        if turn == ROUNDS:
            return links.unionByName(pairs)
        pairs = pairs.join(registers.select(F.col("cls").alias("v"), F.col("registers").alias("b")), "v").join(registers.select(F.col("cls").alias("u"), F.col("registers").alias("a")), "u")
        judged = stored(_estimates(pairs.select("u", "v", "a", "b")), "estimates")
        near = judged.filter("near").select("u", "v")
        links = near if links is None else links.unionByName(near)
        far = judged.filter("not near").select("u", "v")
        if far.isEmpty():
            return links
        bands = rows.join(far, ["u", "v"], "left_semi").select("band", F.col("v").alias("cls"))
    return links


def spanning_links(ids: list[int], sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links (id, root) of a forest with the components of the exact graph 100 * |a & b| >= percent * |a | b|.

    A graph search: each reached set is compared on full sets with those of the
    unreached ones that share one of its rarest shingles. As a link needs
    ceil(percent / 100 * |a|) common shingles, a partner cannot avoid the
    |a| - that + 1 rarest ones, so no link is lost. Near copies leave the
    search when reached, so the work is far from all pairs.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)]
    frequency = np.bincount(flat, minlength=len(vocabulary))
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(flat, kind="stable")]
    posted = np.r_[0, np.cumsum(frequency)]
    marked = np.zeros(len(vocabulary), bool)
    unreached = np.ones(len(sets), bool)

    def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())

    for root in np.argsort(np.array(ids, np.int64), kind="stable"):
        if not unreached[root]:
            continue
        unreached[root] = False
        front = [int(root)]
        while front:
            v = front.pop()
            mine = flat[starts[v] : starts[v + 1]]
            need = -(-percent * len(mine) // 100)
            rare = mine[np.argsort(frequency[mine], kind="stable")[: len(mine) - need + 1]]
            sharing = owners[spans(posted[rare], frequency[rare])]
            sharing = np.unique(sharing[unreached[sharing]])
            if not len(sharing):
                continue
            lengths = sizes[sharing]
            marked[mine] = True
            both = np.add.reduceat(marked[flat[spans(starts[sharing], lengths)]], np.r_[0, np.cumsum(lengths)[:-1]], dtype=np.int64)
            marked[mine] = False
            near = sharing[100 * both >= percent * (lengths + sizes[v] - both)]
            unreached[near] = False
            for w in near.tolist():
                yield ids[w], ids[root]
            front.extend(near.tolist())


def _resolve(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Spanning links (u, v) of the rows (task, cls, text), which come sorted by task."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, sets = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                links = list(spanning_links(ids, sets, percent))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])

        for whole in batches:
            for low, high in K.pieces(whole.column(2)):
                batch = whole.slice(low, high - low)
                data, offsets = K.text_buffer(batch.column(2))
                _, hashes, first = K.words(data, offsets, K.SPACE_LOWER)
                for i, (t, cls) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    if t != task:
                        yield from done()
                        task, ids, sets = t, [], []
                    ids.append(cls)
                    sets.append(K.row_shingles(hashes[first[i] : first[i + 1]], k))
        yield from done()

    return members.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Words are separated by white space and lower-cased in A-Z; a text with fewer
    words than ``shingle_words`` is one shingle; null texts and texts without
    words have no shingle and link with nothing, nor do rows with a null id,
    whose component is null. Rows that share an id are given the smallest
    component of any of them. Only ``id_col`` and ``text_col`` are read. An empty table
    gives an empty result. ``percent`` is the least Jaccard similarity of a link
    (from about 60 on, as banding finds pairs of 0.8 with a probability of
    1 - 3e-6 and pairs of 0.6 with 0.86).
    """
    prepare(docs.sparkSession)
    rows = stored(profile(docs, id_col, text_col, shingle_words), "profile")
    known = rows.filter("set_key is not null and doc_id is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("cls"), F.min("n_shingles").alias("n_shingles"), F.min("registers").alias("registers"))
    classes = stored(classes, "classes")

    # classes of fewer than 4 shingles can only reach 0.75 against a different set
    wide = classes if percent < 80 else classes.filter("n_shingles >= 4")
    bands = stored(_bands(wide), "bands")
    families = components(_family_links(bands, classes.select("cls", "registers")))

    # a class of several ids with equal text: one row stands for it
    texts = docs.select(F.col(id_col).cast("long").alias("cls"), F.col(text_col).alias("text"))
    members = stored(families.select(F.col("node").alias("cls"), F.col("component").alias("family")).join(classes.select("cls", "n_shingles"), "cls"), "members")
    load = members.groupBy("family").agg(F.sum("n_shingles").alias("load"))
    load = load.withColumn("blocks", F.when(F.col("load") <= HELD, 1).otherwise(F.ceil(2 * F.col("load") / HELD)).cast("int"))
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = members.join(load, "family").select("cls", "family", mine.alias("i"), other.alias("j"))
    placed = placed.select("cls", F.xxhash64("family", F.least("i", "j"), F.greatest("i", "j")).alias("task"))
    # merged at every size: a small table would be broadcast and hide how the exchange of texts grows
    work = placed.hint("merge").join(texts, "cls").select("task", "cls", "text").repartition("task").sortWithinPartitions("task")
    links = components(_resolve(work, shingle_words, percent))

    resolved = classes.join(links.withColumnRenamed("node", "cls"), "cls", "left").select("set_key", F.coalesce("component", "cls").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(resolved, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
