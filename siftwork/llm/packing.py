"""Cost-balanced packing of token streams into sequences of bounded length, with little padding."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import kernels as K
from siftwork.llm.tokens import encoder
from siftwork.session import prepare

CAPACITY = 1024
#: Attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Tokens packed together; documents of a group share no sequence with others.
GROUP = 1 << 20
#: A group has one sequence in so many more than its tokens fill, so that most documents fit whole: padding of 0.4 %.
SPARE = 256
#: Bytes of text encoded at a time.
PIECE = 4 << 20


def capacities(total: int, capacity: int) -> list[int]:
    """Lengths of the sequences open for ``total`` tokens."""
    return [capacity] * -(-total * (SPARE + 1) // (SPARE * capacity))


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these token counts.

    A document's full-capacity parts are sequences of their own. The remainders,
    in descending length, go to the sequence of lowest cost which has room; when
    none at all has room for the whole, the cheapest is filled and the rest goes
    back in line.
    """
    out, sequence, line = [], 0, []
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            line.append((-(n % capacity), d, n - n % capacity))
    room = capacities(-sum(x[0] for x in line), capacity)
    filled = [0] * len(room)
    heapq.heapify(line)
    # lengths never rise, so a sequence with room for one remainder has room for the next until it takes one
    cost = [0.0] * len(room)
    fits: list[tuple[float, int]] = []  # with room for the length in turn, by cost
    tight = [(-r, i) for i, r in enumerate(room)]  # the others, by room
    cheapest = [(0.0, i) for i in range(len(room))]  # all, by cost; entries of an earlier cost are skipped
    heapq.heapify(tight)
    while line:
        n, d, start = heapq.heappop(line)
        n = -n
        while tight and -tight[0][0] >= n:
            i = heapq.heappop(tight)[1]
            if room[i]:
                heapq.heappush(fits, (cost[i], i))
        if fits:
            i = heapq.heappop(fits)[1]
        else:  # none fits: the cheapest takes what it can
            while True:
                c, i = heapq.heappop(cheapest)
                if room[i] and c == cost[i]:
                    break
        m = min(n, room[i])
        out.append((d, start, m, sequence + i, filled[i]))
        filled[i] += m
        room[i] -= m
        cost[i] += linear * m + quadratic * m * m
        if room[i]:
            heapq.heappush(cheapest, (cost[i], i))
            heapq.heappush(tight, (-room[i], i))
        if m < n:
            heapq.heappush(line, (m - n, d, start + m))
    return out


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = True
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) per piece.

    Every task packs its own documents in groups of about GROUP tokens, so no
    exchange is needed and memory is bounded. Null and empty texts are the end
    id alone; ids may be null or repeat (each row is a document). ``ids`` holds
    little-endian unsigned 32-bit ids. Only ``id_col`` and ``text_col`` are
    read. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kinds = [*[pa.int64()] * 7, *[pa.binary()] * with_ids]

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, end_id)
        sequence = TaskContext.get().partitionId() << 36
        ids: list[int | None] = []
        streams: list[np.ndarray] = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            found = assign([len(s) for s in streams], capacity, linear, quadratic)
            columns: list[list] = [[] for _ in names]
            for d, start, length, k, offset in found:
                part = streams[d][start : start + length].astype("<u4").tobytes()
                row = (ids[d], start, length, zlib.crc32(part), len(streams[d]), sequence + k, offset, part)
                for c, x in zip(columns, row, strict=False):
                    c.append(x)
            sequence += 1 + max((x[3] for x in found), default=-1)
            for low in range(0, len(found), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c[low : low + 4096], k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for low, high in K.pieces(batch.column(1), PIECE):
                some = batch.slice(low, high - low)
                new, offsets = encode.encode(some.column(1))
                for doc, a, b in zip(some.column(0).to_pylist(), offsets, offsets[1:], strict=False):
                    ids.append(doc)
                    streams.append(new[a:b])
                    held += int(b - a)
                    if held >= GROUP:
                        yield from packed()
                        ids, streams, held = [], [], 0
        if streams:
            yield from packed()

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names)
    return rows.mapInArrow(run, schema)
