"""Report sinks: one JSON document, JSON lines, media copies, and overwrite rules."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = "1.0"


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """One JSON document: two blanks of indent, characters as they are, a line feed at the end."""
    text = json.dumps({"schema_version": SCHEMA_VERSION, **document}, ensure_ascii=False, indent=2, default=str) + "\n"
    conf = spark._jsc.hadoopConfiguration()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_rows(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines in a folder; an existing folder is an error unless it may be overwritten."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def status_lines(row: dict) -> list[str]:
    """KEY<tab>value lines of a summary."""
    return [f"{k.upper()}\t{v}" for k, v in row.items()]


def copy_files(files: DataFrame, folder: str) -> int:
    """Copy (path, destination) rows into a folder; tasks stream their own files. Returns how many."""

    def uri(path: str) -> str:
        return "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path

    def save(batches):
        import shutil

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, at = fs.FileSystem.from_uri(uri(path))
                store, base = fs.FileSystem.from_uri(uri(folder))
                store.create_dir(base, recursive=True)
                with source.open_input_stream(at) as data, store.open_output_stream(f"{base}/{name}") as out:
                    shutil.copyfileobj(data, out, 4 << 20)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    return files.select("path", "destination").mapInArrow(save, "n bigint").groupBy().sum("n").first()[0] or 0
