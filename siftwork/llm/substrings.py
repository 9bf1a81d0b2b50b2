"""Substring de-duplication by recompression: locally consistent names reveal repeats, windows verify them.

Rounds name runs of equal symbols, then pairs whose first symbol has coin L and
second coin R. Names are 64-bit hashes of what they stand for, so they are global
without any exchange, and equal substrings get equal names in their interior.
Every symbol carries the span of words on which its parse depends. A window of
words is represented by its anchor: of the symbols whose dependence lies inside
the window, the one of the highest level and smallest name. Equal windows have
equal anchors, so it is enough to bring together what shares an anchor name.
Windows of 13 words use one round, so symbols are words, runs and one layer of
pairs; a window's hash decides, its anchor only routes it.

Tasks group their windows by anchor, drop those for which they have seen a
smaller document, first within a chunk of text and then against a table that a
task carries from chunk to chunk (so a passage that stands everywhere sends few
rows a task), and send the rest by anchor: 16 bits of the name, the place of the
first window, and each window's 64-bit hash, so that a window is identified by
80 bits and the bucket where it is met. Receivers find the smallest document of each window; covered words are
then removed from the texts. A row is known by its id, and where ids repeat by
the hash of its text too: rows equal in both lose the same words.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm import kernels as K
from siftwork.session import prepare

WINDOW = 13
#: Words parsed at a time.
BLOCK = 1 << 17
#: Bytes of text that a task groups at a time, and characters of the corpus for each receiver.
CHUNK, BUCKET_CHARS = 4 << 20, 6_000_000
#: Slots (a power of two) of the table of windows that a task has seen: 22 bytes each.
SEEN = 1 << 20


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window inside a row: first word, hash, anchor word and anchor name."""
    n = len(hashes)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(np.arange(n) + size <= first[row + 1]) if n else np.zeros(0, np.int64)
    up, down = K.powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    value = K.mix((sums[inside + size] - sums[inside]) * down[inside])
    del sums
    anchor, key = np.zeros(n, np.int64), np.zeros(n, np.uint64)
    for low in range(0, n, BLOCK):
        # a symbol depends on words of its window only, so a block needs one window of context
        high, a, b = min(low + BLOCK, n), max(0, low - size), min(low + BLOCK + 2 * size, n)
        at, best = _anchors(hashes[a:b], row[a:b], size)
        anchor[low:high], key[low:high] = at[low - a : high - a] + a, best[low - a : high - a]
    return inside, value, anchor[inside], key[inside]


def _anchors(names: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor word and name of the window that starts at each word."""
    n = len(names)
    p = np.arange(n)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    # best[d][p]: the smallest key among symbols whose dependence starts at word p and has d words or fewer
    best = np.full((size + 1, n + size), none)
    best[1, :n] = (names >> np.uint64(2)) | np.uint64(3 << 62)  # a word depends on itself only
    start, end, low, high = p, p + 1, p, p + 1
    levels = min(3, max(1, size.bit_length() - 3))  # fewer consecutive windows share a higher symbol, as its dependence is wider
    for level in range(1, levels + 1):
        # runs of one name: that a run ends depends on the symbols beside it
        at = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])])
        count = np.diff(np.r_[at, len(names)])
        names, owner = np.where(count > 1, K.mix(names[at] ^ (count.astype(np.uint64) * np.uint64(K.BASE))), names[at]), owner[at]
        start, end = start[at], end[at + count - 1]
        yes = np.ones(len(at), bool)
        ends = (low[at], high[at], low[at + count - 1], high[at + count - 1])  # dependences of the first and last of each run
        low, high = _beside(np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), start, owner, yes, yes, *ends)
        # pairs L R: they cannot overlap and depend on their parts only; a lone symbol depends on the neighbour that its coin awaits
        coin = (K.mix(names ^ np.uint64(level)) & np.uint64(1)).astype(bool)
        left = np.flatnonzero(coin[:-1] & ~coin[1:] & (owner[:-1] == owner[1:]))
        lone_low, lone_high = _beside(low, high, start, owner, ~coin, coin, low, high, low, high)
        lone_low[left], lone_high[left] = np.minimum(low[left], low[left + 1]), np.maximum(high[left], high[left + 1])
        pair = K.mix(names[left] * np.uint64(K.BASE) + names[left + 1])
        names, end = names.copy(), end.copy()
        names[left], end[left] = pair, end[left + 1]
        stay = np.ones(len(names), bool)
        stay[left + 1] = False
        names, owner, start, end, low, high = (x[stay] for x in (names, owner, start, end, lone_low, lone_high))
        width = high - low
        ok = (width <= size) & (low >= 0)
        np.minimum.at(best.reshape(-1), width[ok] * (n + size) + low[ok], (names[ok] >> np.uint64(2)) | np.uint64((levels - level) << 62))
    for d in range(2, size + 1):
        np.minimum(best[d], best[d - 1], out=best[d])
    key, anchor = np.full(n, none), np.zeros(n, np.int64)
    for j in range(size):  # dependences that start j words into the window; ties: the first
        own = best[size - j, j : n + j]
        better = own < key
        np.copyto(key, own, where=better)
        np.copyto(anchor, p + j, where=better)
    return anchor, key


def _beside(low: np.ndarray, high: np.ndarray, start: np.ndarray, owner: np.ndarray, before: np.ndarray, after: np.ndarray, *ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dependence joined with that of the neighbours, where asked for; at the edge of a text it leaves the text.

    ``ends``: dependence (low, high) of what the symbol before sees of a symbol
    (its first part), and of what the symbol after sees (its last part).
    """
    first_low, first_high, last_low, last_high = ends
    same = owner[1:] == owner[:-1]
    new_low, new_high = low.copy(), high.copy()
    where = np.flatnonzero(before[1:] & same) + 1
    new_low[where] = np.minimum(new_low[where], last_low[where - 1])
    new_high[where] = np.maximum(new_high[where], last_high[where - 1])
    where = np.flatnonzero(after[:-1] & same)
    new_low[where] = np.minimum(new_low[where], first_low[where + 1])
    new_high[where] = np.maximum(new_high[where], first_high[where + 1])
    edge = before & np.r_[True, ~same] | after & np.r_[~same, True]
    new_low[edge] = start[edge] - (1 << 40)
    return new_low, new_high


class Seen:
    """Windows of a task's earlier chunks with their smallest document. What is met again stays; the rest makes room for newer ones.

    It only saves rows: a window that it has lost is sent and found by its receiver.
    """

    def __init__(self) -> None:
        self.value, self.key, self.doc = np.zeros(SEEN, np.uint64), np.zeros(SEEN, np.uint32), np.zeros(SEEN, np.int64)
        self.used, self.hot = np.zeros(SEEN, bool), np.zeros(SEEN, bool)
        self.shift = np.uint64(65 - SEEN.bit_length())

    def later(self, value: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which windows a smaller document of an earlier chunk holds; equal windows have the same document here."""
        slot, short = (value >> self.shift).astype(np.int64), (key >> np.uint64(32)).astype(np.uint32)
        met = self.used[slot] & (self.value[slot] == value) & (self.key[slot] == short)
        gone = met & (self.doc[slot] < doc)
        self.hot[slot[met]] = True
        fresh = np.flatnonzero(np.where(met, ~gone, ~self.hot[slot]))
        slot = slot[fresh]
        self.value[slot], self.key[slot], self.doc[slot], self.used[slot] = value[fresh], short[fresh], doc[fresh], True
        return gone


def _groups(docs: np.ndarray, parts: np.ndarray | None, first: np.ndarray, hashes: np.ndarray, size: int, buckets: int, homes: int, seen: Seen | None = None) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload) of a chunk; docs: the rows' ids, parts: what tells rows of one id apart. Places that a smaller document seen by the task repeats go to bucket -1 - home."""
    at, value, anchor, key = windows(hashes, first, size)
    if not len(at):
        return
    row = np.searchsorted(first, at, "right") - 1
    position = (at - first[row]).astype(np.int64)
    doc = docs[row]
    order = np.lexsort((doc, value))
    v, d = value[order], doc[order]
    head = np.r_[True, v[1:] != v[:-1]]
    least = np.empty(len(doc), np.int64)
    least[order] = d[np.flatnonzero(head)][np.cumsum(head) - 1]
    gone = doc > least
    del order, v, d, head, least
    if seen is not None:
        rest = np.flatnonzero(~gone)
        gone[rest[seen.later(value[rest], key[rest], doc[rest])]] = True
    if gone.any():
        for home, payload in _by_home(doc[gone], None if parts is None else parts[row[gone]], position[gone], homes):
            yield -1 - home, payload
        at, value, anchor, key, doc, position, row = (x[~gone] for x in (at, value, anchor, key, doc, position, row))
        if not len(at):
            return
    # consecutive windows with one anchor occurrence; a word may anchor them under several names
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]
    begin = np.flatnonzero(new)
    count = np.diff(np.r_[begin, len(at)])
    name = key[begin]
    bucket = (K.mix(name) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        mine = order[a:b]
        length = count[mine]
        flat = np.repeat(begin[mine] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
        heads = begin[mine]
        columns = [
            (name[mine] >> np.uint64(20)).astype(np.uint16).tobytes(), length.astype(np.uint8).tobytes(), _planes(_steps(doc[heads].view(np.uint64))),
            _planes(_steps(position[heads].astype(np.uint64))), value[flat].tobytes(), b"" if parts is None else _planes(_steps(parts[row[heads]].view(np.uint64))),
        ]
        yield int(bucket[mine[0]]), struct.pack("<ii?", len(mine), len(flat), parts is not None) + b"".join(columns)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours modulo 2**64, the first one from 0."""
    out = x.copy()
    out[1:] -= x[:-1]
    return out


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, and so on: small numbers leave long runs of zeros to the exchange's compression.

    Differences that go down are folded to small numbers too.
    """
    folded = (x << np.uint64(1)) ^ (np.uint64(0) - (x >> np.uint64(63)))
    return folded.view(np.uint8).reshape(-1, 8).T.tobytes()


def _joined(payload: bytes, n: int, at: int) -> np.ndarray:
    """The numbers whose steps were written by ``_planes``."""
    x = np.ascontiguousarray(np.frombuffer(payload, np.uint8, 8 * n, at).reshape(8, n).T).view(np.uint64).reshape(-1)
    return np.cumsum((x >> np.uint64(1)) ^ (np.uint64(0) - (x & np.uint64(1))), dtype=np.uint64)


def _read(payload: bytes) -> tuple[np.ndarray, ...]:
    """Anchor name, hash, document, part and position by window."""
    n, total, parted = struct.unpack_from("<ii?", payload)
    at = struct.calcsize("<ii?")
    name, length = np.frombuffer(payload, np.uint16, n, at), np.frombuffer(payload, np.uint8, n, at + 2 * n).astype(np.int64)
    at += 3 * n
    doc, position = _joined(payload, n, at).view(np.int64), _joined(payload, n, at + 8 * n).view(np.int64)
    value = np.frombuffer(payload, np.uint64, total, at + 16 * n)
    part = _joined(payload, n, at + 16 * n + 8 * total).view(np.int64) if parted else np.zeros(n, np.int64)
    step = np.arange(total) - np.repeat(np.r_[0, np.cumsum(length)[:-1]], length)
    return np.repeat(name, length), value, np.repeat(doc, length), np.repeat(part, length), np.repeat(position, length) + step


def _by_home(doc: np.ndarray, part: np.ndarray | None, position: np.ndarray, homes: int) -> Iterator[tuple[int, bytes]]:
    """(home, payload) of the places (document, part, first word), one row for each home."""
    home = (doc if part is None else doc ^ part) % homes
    order = np.argsort(home, kind="stable")
    cut = np.r_[0, np.flatnonzero(np.diff(home[order])) + 1, len(order)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        mine = order[a:b]
        columns = [doc[mine].astype("<i8").tobytes(), position[mine].astype("<u4").tobytes(), b"" if part is None else part[mine].astype("<i8").tobytes()]
        yield int(home[mine[0]]), struct.pack("<i?", len(mine), part is not None) + b"".join(columns)


def _places(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, part and first word of each place."""
    n, parted = struct.unpack_from("<i?", payload)
    part = np.frombuffer(payload, "<i8", n, 5 + 12 * n) if parted else np.zeros(n, np.int64)
    return np.frombuffer(payload, "<i8", n, 5), part, np.frombuffer(payload, "<u4", n, 5 + 8 * n)


def _rows(found: list[tuple[int, bytes]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names)


def repeated_windows(keyed: DataFrame, window: int, buckets: int, homes: int, parted: bool) -> DataFrame:
    """(home, places): first words of windows that also start in a smaller document, for all documents of a home; a home has several rows.

    ``keyed`` has id, part (longs; part is used where ``parted``) and text; a
    document's home is its id, with the bits of its part flipped, modulo ``homes``.
    """

    @K.tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for whole in batches:
            for low, high in K.pieces(whole.column(2), CHUNK):
                some = whole.slice(low, high - low)
                data, offsets = K.text_buffer(some.column(2))
                _, hashes, first = K.words(data, offsets, K.SPACE)
                parts = some.column(1).to_numpy() if parted else None
                found = list(_groups(some.column(0).to_numpy(), parts, first, hashes, window, buckets, homes, seen))
                del data, offsets, hashes, first, some  # not held while the next chunk is grouped
                out = _rows(found, ["bucket", "payload"])
                del found
                yield out
                del out
                K.give_back()

    @K.tidy
    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        current = None

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            read = [_read(x) for x in held]
            held.clear()
            name, value, doc, part, position = (np.concatenate(x) for x in zip(*read, strict=True))
            del read
            order = np.lexsort((doc, value, name))
            a, b, d = name[order], value[order], doc[order]
            head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
            gone = order[d > least]
            if len(gone):
                yield _rows(list(_by_home(doc[gone], part[gone] if parted else None, position[gone], homes)), ["home", "places"])

        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                payload = payload.as_py()
                if bucket < 0:  # found by the sender
                    yield _rows([(-1 - bucket, payload)], ["home", "places"])
                    continue
                if bucket != current:
                    yield from done()
                    current = bucket
                held.append(payload)
        yield from done()

    sent = keyed.select("id", "part", "text").mapInArrow(send, "bucket bigint, payload binary")
    # rows of negative buckets need no partner: they are spread
    spread = F.when(F.col("bucket") < 0, F.xxhash64("payload")).otherwise(F.col("bucket"))
    return sent.repartition(buckets, spread).sortWithinPartitions("bucket").mapInArrow(receive, "home bigint, places binary")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_spacing: bool = False) -> DataFrame:
    """All columns of ``docs`` with the text cut, and n_words, n_removed.

    A word goes when a window of ``window`` consecutive words that covers it also
    starts in a document with a smaller id; windows are judged on the input.
    Words are separated by white space. What is kept is joined by single blanks,
    or with ``keep_spacing`` keeps its white space (one blank where words went).
    A null text stays null with 0 words. Rows with one id are separate texts,
    none smaller than the other; rows with a null id neither lose words nor take
    any from others. Columns called n_words or n_removed are replaced.
    """
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    number = F.col(f"`{id_col}`").cast("long")
    repeats = rows.select(number.alias("id")).filter("id is not null").groupBy("id").count().agg(F.max("count").alias("most")).first()
    parted = (repeats["most"] or 1) > 1
    struct_ = F.struct(*[F.col(f"`{c}`") for c in names if c != text_col])
    text = F.col(f"`{text_col}`")
    part = F.xxhash64(text) if parted else F.lit(0).cast("long")
    keyed = rows.select(number.alias("id"), part.alias("part"), text.alias("text"), struct_.alias("rest"))
    size = keyed.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(-(-size // BUCKET_CHARS)))
    homes = next(n for n in range(buckets | 1, 1 << 62, 2) if all(n % p for p in range(3, int(n**0.5) + 1, 2)))  # a prime: even for keys in steps
    places = repeated_windows(keyed.filter("id is not null and text is not null"), window, buckets, homes, parted)
    rest_type = keyed.schema["rest"].dataType
    # rows with a null id have no places: they are spread by text
    home = F.pmod(F.coalesce(F.col("id").bitwiseXOR(F.col("part")), F.xxhash64("text")), F.lit(homes).cast("long"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("part", "long"), ("text", "string"), ("rest", rest_type))]
    tagged = keyed.select(home.alias("home"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("places"), "id", "part", "text", "rest").unionByName(
        places.select("home", F.lit(0).alias("kind"), "places", *none)
    )

    @K.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        docs = parts = at = None
        for batch in batches:
            homes_, kinds, places, ids, parts_, texts = (batch.column(i) for i in range(6))
            keep, out, counts, removed = [], [], [], []
            for i, (home, kind, doc, part) in enumerate(zip(homes_.to_pylist(), kinds.to_pylist(), ids.to_pylist(), parts_.to_pylist(), strict=True)):
                if home != current:
                    current, held, docs = home, [], None
                if kind == 0:  # all places of a home come before its texts
                    held.append(_places(places[i].as_py()))
                    continue
                if docs is None:
                    docs, parts, at = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
                    order = np.lexsort((parts, docs))
                    docs, parts, at, held = docs[order], parts[order], at[order], []
                gone = at[:0]
                if doc is not None:
                    mine = slice(np.searchsorted(docs, doc), np.searchsorted(docs, doc, "right"))
                    gone = at[mine][np.searchsorted(parts[mine], part) : np.searchsorted(parts[mine], part, "right")]
                text, n, r = _cut(texts[i].as_py(), gone, window, keep_spacing)
                keep.append(i)
                out.append(text)
                counts.append(n)
                removed.append(r)
            yield pa.RecordBatch.from_arrays(
                [batch.column(6).take(pa.array(keep, pa.int64())), pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], ["rest", "text", "n_words", "n_removed"]
            )

    ordered = tagged.repartition("home").sortWithinPartitions("home", "kind", "id")
    schema = T.StructType([T.StructField("rest", rest_type), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = ordered.mapInArrow(cut, schema)
    columns = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in names]
    return done.select(*columns, "n_words", "n_removed")


def _cut(text: str | None, gone: np.ndarray, window: int, keep_spacing: bool) -> tuple[str | None, int, int]:
    if text is None:
        return None, 0, 0
    raw = text.encode()
    if keep_spacing:
        data = np.frombuffer(raw, np.uint8)
        spans, _, _ = K.words(data, np.array([0, len(raw)]), K.SPACE)
        n = len(spans)
    else:
        parts = raw.split()
        n = len(parts)
    if not len(gone):
        return (text if keep_spacing else b" ".join(parts).decode()), n, 0
    change = np.zeros(n + window + 1, np.int64)
    at = gone.astype(np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    kept = np.flatnonzero(np.cumsum(change)[:n] == 0)
    if keep_spacing:
        cuts = np.flatnonzero(np.diff(kept) > 1)
        firsts, lasts = kept[np.r_[0, cuts + 1]] if len(kept) else kept, kept[np.r_[cuts, len(kept) - 1]] if len(kept) else kept
        return b" ".join(raw[spans[a, 0] : spans[b, 1]] for a, b in zip(firsts, lasts, strict=True)).decode(), n, n - len(kept)
    return b" ".join([parts[i] for i in kept]).decode(), n, n - len(kept)
