"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import kernels as K
from siftwork.session import prepare

#: Character n-gram lengths and hash bits.
GRAMS = (1, 2, 3)
BITS = 16
#: Numbers in the broadcast matrix (16 MB): with more languages than it has room for at BITS bits, grams are hashed to fewer buckets.
MOST_WEIGHTS = 1 << 22
#: In a score, the evidence of a text counts as that of so many n-grams at most, so that scores stay apart from 1.
EVIDENCE = 200.0
#: Characters of a text hashed as one piece, and characters scored at a time.
PIECE, BATCH = 1 << 18, 1 << 18


def bits_for(languages: int) -> int:
    return max(1, min(BITS, MOST_WEIGHTS.bit_length() - 1 - max(0, languages - 1).bit_length()))


def gram_buckets(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram of the lower-cased texts, each padded with a blank at both ends."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    row = np.repeat(np.arange(len(padded), dtype=np.int32), lengths)
    rows, out = [], []
    for n in GRAMS:
        if len(points) < n:
            continue
        key = points[: len(points) - n + 1].copy()
        for j in range(1, n):
            key <<= np.uint64(21)
            key |= points[j : len(points) - n + 1 + j]
        key += np.uint64(n << 60)
        key *= np.uint64(0x9E3779B97F4A7C15)
        bucket = (key >> np.uint64(64 - bits)).astype(np.int32)
        same = row[: len(bucket)] == row[n - 1 :]  # a gram lies in one text
        rows.append(row[: len(bucket)][same])
        out.append(bucket[same])
    return np.concatenate(rows), np.concatenate(out)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts with a letter in pieces, with their rows, about BATCH characters at a time."""
    rows, some, held = [], [], 0
    for i, t in enumerate(texts):
        if not K.has_letter(t):
            continue
        for low in range(0, len(t), PIECE):
            rows.append(i)
            some.append(t[low : low + PIECE])
            held += len(some[-1])
            if held >= BATCH:
                yield rows, some
                rows, some, held = [], [], 0
    if some:
        yield rows, some


@dataclass
class Model:
    """Languages in order, and log probabilities: prior by language, likelihood by bucket and language."""

    languages: list[str]
    prior: np.ndarray
    weight: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each text by language, and its number of n-grams; 0 n-grams for a text without a letter.

        A batch of texts is one sparse matrix of (text, bucket, count), whose
        rows are multiplied with the weights and summed.
        """
        bits = len(self.weight).bit_length() - 1
        total, grams = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for rows, some in _pieces(texts):
            row, bucket = gram_buckets(some, bits)
            cell = (row.astype(np.int64) << bits) | bucket
            if len(some) << bits <= 1 << 22:  # few texts: counted in place
                counts = np.bincount(cell, minlength=0)
                cell = np.flatnonzero(counts)
                counts = counts[cell]
            else:
                cell, counts = np.unique(cell, return_counts=True)
            row, bucket = cell >> bits, cell & ((1 << bits) - 1)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            of = np.array(rows)[row[first]]
            for x in range(len(self.languages)):  # one language at a time: working arrays of one number a cell
                np.add.at(total[:, x], of, np.add.reduceat(self.weight[bucket, x] * counts, first))
            np.add.at(grams, of, np.add.reduceat(counts, first))
        return total, grams

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and fit of each text.

        The language is the likeliest by the whole text; ties go to the first
        name. ``fit`` is by how much (in nats an n-gram) it explains the text
        better than a model to which all n-grams are alike: at 0 or less the
        text is in none of the languages.
        """
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        total, grams = self.scores(texts)
        known = grams > 0
        best = np.argmax(self.prior + total, axis=1)
        at = np.arange(len(texts))
        x = self.prior + total * np.minimum(1.0, EVIDENCE / np.maximum(grams, 1))[:, None]
        x = np.exp(x - x.max(axis=1, keepdims=True))
        fit = total[at, best] / np.maximum(grams, 1) + np.log(len(self.weight))
        names = [self.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return names, np.where(known, x[at, best] / x.sum(axis=1), 0.0), np.where(known, fit, 0.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model:
    """Fit on every row with a text and a label.

    Tasks count n-grams of their rows in numpy and emit one row for each
    (language, bucket) seen; Spark sums them. The driver receives MOST_WEIGHTS
    sums at most, whatever the corpus and the number of languages. No labelled
    row with a letter: no language.
    """
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    bits = bits_for(rows.select(F.count_distinct("lang")).first()[0])

    @K.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for low, high in K.pieces(batch.column(0)):
                texts, names = batch.column(0).slice(low, high - low).to_pylist(), batch.column(1).slice(low, high - low).to_pylist()
                code = {n: i for i, n in enumerate(dict.fromkeys(names))}
                for t, n in zip(texts, names, strict=True):
                    if K.has_letter(t):
                        docs[n] = docs.get(n, 0) + 1
                        if n not in sums:
                            sums[n] = np.zeros(1 << bits, np.int64)
                of = np.array([code[n] for n in names])
                for at, some in _pieces(texts):
                    row, bucket = gram_buckets(some, bits)
                    lang_of = of[np.array(at)][row]
                    for n, i in code.items():
                        if n in sums:
                            sums[n] += np.bincount(bucket[lang_of == i], minlength=1 << bits)
        for name, seen in sums.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[seen[at], docs[name]])],
                ["lang", "bucket", "n"],
            )

    counted = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode() if len(found) else None
    if names is None:
        return Model([], np.zeros(0), np.zeros((1 << bits, 0), np.float32))
    listed = names.dictionary.to_pylist() if not isinstance(names, pa.ChunkedArray) else names.chunk(0).dictionary.to_pylist()
    place = np.argsort(np.array(listed, object), kind="stable")
    rank = np.empty(len(listed), np.int64)
    rank[place] = np.arange(len(listed))
    indices = names.indices if not isinstance(names, pa.ChunkedArray) else names.chunk(0).indices
    lang_of, bucket, n = rank[indices.to_numpy()], found.column("bucket").to_numpy(), found.column("n").to_numpy()
    grams = bucket >= 0
    seen = np.full((1 << bits, len(listed)), smoothing)
    seen[bucket[grams], lang_of[grams]] += n[grams]
    prior = np.zeros(len(listed))
    prior[lang_of[~grams]] = np.log(n[~grams])
    return Model([listed[i] for i in place], prior, np.log(seen / seen.sum(0)).astype(np.float32))


def predict(df: DataFrame, model: Model, text: str = "text", fit_col: str | None = None) -> DataFrame:
    """Append lang_pred and score (0 to 1) to every row, with ``fit_col`` the fit under that name too; earlier columns of these names are replaced.

    Null texts and texts without a letter get 'und' and 0; so does every row
    when the model has seen no language. Ties go to the first name in order.
    """
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # MOST_WEIGHTS float32 at most

    @F.pandas_udf("lang_pred string, score double, fit double")
    def guess(texts):
        import pandas as pd

        found = shared.value.predict(texts.where(texts.notna(), None).tolist())
        K.give_back()
        return pd.DataFrame(dict(zip(("lang_pred", "score", "fit"), found, strict=True)))

    added = ["lang_pred", "score", *([fit_col] if fit_col else [])]
    kept = [c for c in df.columns if c.lower() not in [a.lower() for a in added]]
    name = fresh(kept, "guess")
    out = df.select(*[F.col(f"`{c}`") for c in kept], guess(F.col(f"`{text}`")).alias(name))
    return out.select(*[F.col(f"`{c}`") for c in kept], f"{name}.lang_pred", f"{name}.score", *([F.col(f"{name}.fit").alias(fit_col)] if fit_col else []))


def recognised(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text has a letter and is better explained by one of the languages than by chance (``fit`` above 0)."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        names, _, fits = shared.value.predict(texts.where(texts.notna(), None).tolist())
        K.give_back()
        return pd.Series([n != "und" for n in names]) & pd.Series(fits > 0)

    return df.filter(known(F.col(f"`{text}`")))


def fresh(taken: list[str], name: str) -> str:
    """A column name like this one that is not taken."""
    while name.lower() in [c.lower() for c in taken]:
        name += "_"
    return name


def lettered(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text has a letter."""
    prepare(df.sparkSession)

    @F.pandas_udf("boolean")
    def has(texts):
        return texts.map(K.has_letter).astype(bool)

    return df.filter(has(F.col(f"`{text}`")))
