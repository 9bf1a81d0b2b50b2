"""The pipeline against a plain rewrite of its stages on the hard small tables."""

import re
import zlib

import numpy as np
from test_brute_force import LOWER, components, docs, encoded, plain_model, plain_scores, sf_dir, shingles  # noqa: F401

import corpus_pipeline as P
from siftwork.llm import queries as Q


def cut(text, gone):
    """The text without its removed words; what stood between kept words stays, one blank where words went."""
    raw, out = text.encode(), b""
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    last = None
    for i, (a, b) in enumerate(spans):
        if not gone[i]:
            out += (raw[spans[last][1] : a] if last == i - 1 else b" ") if last is not None else b""
            out += raw[a:b]
            last = i
    return out.decode()


def plain(docs, items):
    model = plain_model(zip(docs.text, docs.lang))
    rows = []
    for i, t in zip(docs.doc_id, docs.text):
        if t and any(c.isalpha() for c in t):
            scores, n = plain_scores(model, t)
            best = max(scores, key=lambda x: sum(scores[x]))
            if scores[best][1] / n + np.log(65536) > 0:  # better than all n-grams alike
                rows.append((i, t))
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets.append(shingles(w, 5) if len(w) >= 5 else {tuple(w)} if w else set())
    rows = [r for n, (r, root) in enumerate(zip(rows, components(sets, 80))) if root == n]
    first, kept = {}, []
    for i, t in rows:
        w = t.encode().split()
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 12):
            if first.setdefault(tuple(w[p : p + 13]), i) < i:
                gone[p : p + 13] = True
        if not gone.any():
            kept.append((i, t))
        elif not gone.all():
            kept.append((i, cut(t, gone)))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    tests = []
    for x in items:
        w = word.findall((x or "").lower())
        if w:
            tests.append((min(5, len(w)), shingles(w, min(5, len(w)))))
    return [(i, t) for i, t in kept if not any(100 * len(s & shingles(word.findall(t.lower()), k)) >= 80 * len(s) for k, s in tests)]


def test_pipeline_matches_plain_stages(spark, sf_dir, docs):  # noqa: F811
    import pandas as pd
    import pyarrow.parquet as pq

    out = P.run(spark, sf_dir).toPandas()
    items = pq.read_table(f"{sf_dir}/benchmark.parquet")["text"].to_pylist()
    want = pd.DataFrame(plain(docs, items), columns=["doc_id", "text"])
    assert sorted(set(out.doc_id)) == sorted(want.doc_id)
    ids = dict(zip(want.doc_id, encoded(want, "byte_bpe_50k.json", 0)))
    for doc, pieces in out.groupby("doc_id"):
        pieces = pieces.sort_values("start")
        assert (pieces.doc_tokens == len(ids[doc])).all() and pieces.length.sum() == len(ids[doc])
        for r in pieces.itertuples():
            assert r.ids == np.array(ids[doc][r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][r.start : r.start + r.length], "<u4").tobytes())


def test_stages_keep_the_columns(spark, sf_dir):  # noqa: F811
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language ID", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "packing"]
    for _, stage in P.STAGES[:4]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert Q.queries()["pipeline"] is Q.pipeline


def test_unlabelled_corpus_stays(spark):
    rows = [(1, "some text", None), (2, "12 34", None), (3, None, None), (4, "", "en"), (5, "\u65e5\u672c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(P.language(spark, docs, "").collect()) == [rows[0], rows[4]]
    assert sorted(r.doc_id for r in P.language(spark, docs.replace("12 34", "b", "text").fillna("en", "lang"), "").collect()) == [1, 2, 5]


def test_repeated_rows_are_near_duplicates(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, a + " x"), (3, b), (4, c), (5, c + " y"), (5, a), (5, "z"), (6, None), (6, None), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, P.near_duplicates(spark, docs, "").collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (4, c), (5, "z"), (6, None), (6, None)], key=str)
    alone = spark.createDataFrame([(None, a), (None, a + " x"), (7, b)], "doc_id long, text string")
    assert sorted(r.text[:1] for r in P.near_duplicates(spark, alone, "").collect()) == ["a", "b"]


def test_a_language_that_explains_nothing_is_rejected(spark):
    words = "the quick brown fox jumps over a lazy dog and runs away from it".split()
    rows = [(i, " ".join(words[(i + j) % len(words)] for j in range(400)), "en") for i in range(40)]
    rows += [(100, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059", None), (101, "the dog", None), (102, "\u0434\u043e\u043c \u0438 \u0441\u0430\u0434", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in P.language(spark, docs, "").collect()} == set(range(40)) | {101}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _row string, _cls string, row string, n_words string, score string, lang_pred string"


def test_stages_leave_clashing_columns_alone(spark, sf_dir):  # noqa: F811
    text = lambda x: " ".join(f"{x}{i} and" for i in range(40))
    mine = ("I", "R", "C", "row", "W", "S", "L")
    rows = [(1, text("a"), "en", "s", 9, *mine), (2, text("a") + " more", "en", "s", 9, *mine), (3, "new " + text("a"), "en", None, None, *mine), (4, text("b"), None, "s", 9, *mine)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for more in ([], [(4, text("c"), "en", "s", 9, *mine)]):  # unique and repeated ids
        out = spark.createDataFrame(rows + more, COLUMNS)
        for _, stage in P.STAGES[:4]:
            out = stage(spark, out, sf_dir)
            assert out.schema.names == docs.schema.names
            assert {tuple(r)[5:] for r in out.collect()} == {mine}
    assert P.packed(spark, docs, sf_dir).select("doc_id").distinct().count() == 4


def test_stages_of_an_empty_table(spark, sf_dir):  # noqa: F811
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_contaminated_rows_go_by_their_own_text(spark, sf_dir):  # noqa: F811
    import pyarrow.parquet as pq

    item = max((x or "" for x in pq.read_table(f"{sf_dir}/benchmark.parquet")["text"].to_pylist()), key=len)
    docs = spark.createDataFrame([(None, "x " + item), (1, item), (1, "clean text here"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, P.decontaminated(spark, docs, sf_dir).collect()), key=str) == sorted([(1, "clean text here"), (2, None)], key=str)
