"""Token ids in Arrow stream-file format: fixed-size-list batches of equal-length sequences and their masks.

Documents are put in ascending id order by a range exchange. Each partition
encodes its documents as one id stream, cut in sequences of equal length, and
writes two Arrow files: the sequences (``ids`` and ``mask``, fixed-size lists)
and the documents (``doc_id``, ``start`` in the file, ``n_tokens``). A reader
maps a file and slices any sequence or document without copying. Ids take 16
bits where the vocabulary allows. Files get their final name when complete, so
a repeated task replaces what a lost one left.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import kernels as K
from siftwork.llm.tokens import encoder
from siftwork.session import prepare, scratch_path, stored

SEQUENCE = 2048
#: Sequences in a record batch.
BATCH = 256
#: Characters of text in a file, and the most files: of a larger corpus, files get longer.
FILE_CHARS, MOST_FILES = 24_000_000, 200_000
#: Bytes of text encoded at a time.
PIECE = 4 << 20


def _open(uri: str):
    """File system and path of a folder: a local path, or a URI (file:/x counts as file:///x)."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class _Writer:
    """Streams ids into fixed-size-list batches, and document rows beside them."""

    def __init__(self, folder: str, part: int, dtype: np.dtype, sequence: int) -> None:
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.names = [f"{base}/{kind}-{part:06d}.arrow" for kind in ("tokens", "documents")]
        self.temporary = [f"{x}.{uuid.uuid4().hex}" for x in self.names]
        self.dtype, self.sequence, self.total, self.held, self.size = dtype, sequence, 0, [], 0
        unit = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(unit, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(x) for x in self.temporary]
        self.files = [pa.ipc.new_file(s, k) for s, k in zip(self.sinks, (self.schema, self.index), strict=True)]

    def add(self, ids: pa.Array, encoded: np.ndarray, offsets: np.ndarray) -> None:
        starts, lengths = self.total + offsets[:-1], np.diff(offsets)
        self.files[1].write_batch(pa.record_batch([ids, pa.array(starts), pa.array(lengths)], schema=self.index))
        self.total += len(encoded)
        self.held.append(encoded)
        self.size += len(encoded)
        if self.size >= BATCH * self.sequence:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        stream = np.concatenate([np.zeros(0, self.dtype), *self.held])
        whole = BATCH * self.sequence
        for low in range(0, len(stream), whole):
            part = stream[low : low + whole]
            if len(part) < whole and not last:
                break
            n = -(-len(part) // self.sequence)
            mask = np.zeros(n * self.sequence, bool)
            mask[: len(part)] = True
            part = np.r_[part, np.zeros(n * self.sequence - len(part), self.dtype)]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (part, mask)]
            self.files[0].write_batch(pa.record_batch(lists, schema=self.schema))
        rest = len(stream) % whole if not last else 0
        self.held, self.size = [stream[len(stream) - rest :]] if rest else [], rest

    def close(self) -> list[str]:
        self._flush(last=True)
        for f, s in zip(self.files, self.sinks, strict=True):
            f.close()
            s.close()
        for old, new in zip(self.temporary, self.names, strict=True):
            self.fs.move(old, new)
        return self.names


class TokenFile:
    """Random access to a written file; slices of mapped local files are views."""

    def __init__(self, folder: str, part: int) -> None:
        fs, base = _open(folder)
        sources = []
        for kind in ("tokens", "documents"):
            name = f"{base}/{kind}-{part:06d}.arrow"
            sources.append(pa.memory_map(name) if fs.type_name == "local" else fs.open_input_file(name))
        self.tokens, self.documents = (pa.ipc.open_file(s) for s in sources)
        self.sequence_length = self.tokens.schema.field("ids").type.list_size
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def _batch(self, i: int) -> np.ndarray:
        if self._held[0] != i:
            self._held = (i, self.tokens.get_batch(i).column(0).flatten().to_numpy())
        return self._held[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask (false: padding) of sequence i, both as views of the file; the mask stays in Arrow's bits."""
        batch = self.tokens.get_batch(i // BATCH)
        return batch.column(0)[i % BATCH].values.to_numpy(), batch.column(1)[i % BATCH].values

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from start on, in one view for each record batch touched."""
        whole = BATCH * self.sequence_length
        while n > 0:
            part = self._batch(start // whole)[start % whole : start % whole + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Write all documents in ascending id order; (part, n_docs, n_tokens) per file pair.

    Null and empty texts hold the end id only. Null ids come first; rows with
    one id are ordered by text. An empty table writes no file.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = min(max(1, -(-size // FILE_CHARS)), MOST_FILES)
    ordered = rows.repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, n = TaskContext.get().partitionId(), None, 0
        encode = encoder(tokenizer_path, end_id)
        for batch in batches:
            for low, high in K.pieces(batch.column(1), PIECE):
                some = batch.slice(low, high - low)
                writer = writer or _Writer(folder, part, encode.dtype, sequence)
                writer.add(some.column(0), *encode.encode(some.column(1)))
                n += len(some)
        pa.default_memory_pool().release_unused()  # the worker goes on with other tasks
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([writer.total])], ["part", "n_docs", "n_tokens"])

    return stored(ordered.mapInArrow(run, "part bigint, n_docs bigint, n_tokens bigint"), "manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, read from the files; start counts the ids of all files before.

    The driver sees one row for each file.
    """
    spark = prepare(manifest.sparkSession)
    files, before = [], 0
    for r in manifest.orderBy("part").collect():
        files.append((r["part"], before))
        before += r["n_tokens"]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(folder, part)
                for i in range(file.documents.num_record_batches):
                    rows = file.documents.get_batch(i)
                    crcs = []
                    for start, n in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                        crc = 0
                        for ids in file.ids(start, n):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    starts = pa.array(rows.column(1).to_numpy() + base)
                    yield pa.RecordBatch.from_arrays([rows.column(0), starts, rows.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    each = spark.createDataFrame(files, "part bigint, base bigint").repartition(min(len(files), 4096))
    return each.mapInArrow(run, schema)


def token_folder(docs: DataFrame) -> str:
    return scratch_path(docs.sparkSession, "tokens")
