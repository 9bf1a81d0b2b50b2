"""Kernels and operator parts: random cases, empty tables, null and repeated ids."""

import ctypes
import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.llm import chat, decontamination, fingerprints, kernels, langid, licenses, neardup, packing, substrings, token_files, urls
from siftwork.llm.graph import components
from siftwork.llm.queries import tokenizer_file

DOCS = "doc_id long, text string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab|\\\n<", max_size=8), st.text(alphabet="<|\\im_endstar>\n x", max_size=40)), max_size=5))
def test_chat_round_trip(turns):
    assert chat.parse("".join(chat.render_turn(r, t)[0] for r, t in turns)) == turns


def test_chat_grammar_rejects():
    for bad in ("x", "<|im_start|>user", "<|im_start|>user\nx", "<|im_start|>user\nx<|im_end|>", "<|im_start|>user\na<|b<|im_end|>\n"):
        with pytest.raises(ValueError):
            chat.parse(bad)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\x0b", max_size=30), min_size=1, max_size=8))
def test_words_match_split(texts):
    data, offsets = kernels.text_buffer(pa.array(texts))
    spans, hashes, first = kernels.words(data, offsets, kernels.SPACE)
    found = [[data[a:b].tobytes() for a, b in spans[first[i] : first[i + 1]]] for i in range(len(texts))]
    assert found == [t.encode().split() for t in texts]
    names = {}
    for w, h in zip((w for f in found for w in f), hashes.tolist()):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_words_across_pieces(monkeypatch):
    monkeypatch.setattr(kernels, "PIECE", 7)
    texts = ["abcdefghijklmnopqrstuvwxyz abc de", "", "f" * 30, "g h"]
    data, offsets = kernels.text_buffer(pa.array(texts))
    spans, _, first = kernels.words(data, offsets, kernels.SPACE)
    assert [[data[a:b].tobytes() for a, b in spans[first[i] : first[i + 1]]] for i in range(4)] == [t.encode().split() for t in texts]


@pytest.mark.parametrize("size", [2, 5, 13, 40])
def test_equal_windows_have_equal_anchors(size, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 97)
    rng = random.Random(size)
    for alphabet in (2, 5, 400):
        rows = []
        for _ in range(60):
            row = [rng.randrange(alphabet) for _ in range(rng.randrange(120))]
            if rows and rng.random() < 0.7:
                other = rng.choice(rows)
                at = rng.randrange(len(other) + 1)
                row[len(row) // 2 : len(row) // 2] = other[at : at + 3 * size]
            rows.append(row)
        first = np.r_[0, np.cumsum([len(r) for r in rows])]
        flat = np.array([x for r in rows for x in r], np.uint64)
        at, value, _, key = substrings.windows(kernels.mix(flat + np.uint64(1)), first, size)
        assert len(at) == sum(max(0, len(r) - size + 1) for r in rows)
        seen, back = {}, {}
        for p, v, k in zip(at, value.tolist(), key.tolist()):
            w = tuple(flat[p : p + size].tolist())
            assert seen.setdefault(w, (v, k)) == (v, k)
            assert back.setdefault(v, w) == w


def test_spanning_links_match_all_pairs():
    rng = random.Random(3)
    for percent in (80, 60, 95):
        base = [rng.getrandbits(63) for _ in range(40)]
        sets = []
        for _ in range(120):
            s = set(base)
            for _ in range(rng.randrange(12)):
                s.discard(rng.choice(base))
                s.add(rng.getrandbits(63))
            sets.append(s)
        ids = rng.sample(range(10_000), len(sets))
        parent = {i: i for i in ids}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in zip(ids, sets):
            for j, b in zip(ids, sets):
                if i < j and 100 * len(a & b) >= percent * len(a | b):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
        want = {i: find(i) for i in ids}
        got = {i: i for i in ids}
        for u, v in neardup.spanning_links(ids, [np.array(sorted(s), np.uint64) for s in sets], percent):
            got[u] = v
        assert got == want


def test_blocks_of_large_families(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HELD", 400)
    rng = random.Random(5)
    base = [f"t{i}" for i in range(60)]
    texts = []
    for _ in range(80):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"n{rng.randrange(1000)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    blocked = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, shingle_words=2).collect()}
    monkeypatch.setattr(neardup, "HELD", 10**7)
    assert blocked == {r.doc_id: r.component_id for r in neardup.near_duplicates(df, shingle_words=2).collect()}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, common in ((400, 300), (20, 16), (6, 5)):
        errors = []
        for _ in range(50):
            x = np.unique(rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64))
            x = kernels.mix(rng.permutation(x))
            a, b = neardup.sketch(np.sort(x[:n])), neardup.sketch(np.sort(x[n - common :]))
            errors.append((a == b).mean() - common / len(x))
        assert abs(np.mean(errors)) < 0.06


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60))
def test_assign_places_every_token_once(lengths):
    pieces = packing.assign(lengths)
    for d, n in enumerate(lengths):
        spans = sorted((s, m) for doc, s, m, _, _ in pieces if doc == d)
        assert [s for s, _ in spans] == list(np.cumsum([0] + [m for _, m in spans])[:-1]) and sum(m for _, m in spans) == n
    by = {}
    for _, _, m, k, o in pieces:
        by.setdefault(k, []).append((o, m))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == list(np.cumsum([0] + [m for _, m in spans])[:-1])
        assert sum(m for _, m in spans) <= 1024
    # padding: one sequence in SPARE, and what the last one leaves
    assert 1024 * len(by) - sum(lengths) <= sum(lengths) / packing.SPARE + 1024


def test_packing_balances_cost():
    rng = random.Random(1)
    lengths = [rng.randrange(10, 900) for _ in range(500)]
    pieces = packing.assign(lengths)
    cost = {}
    for _, _, m, k, _ in pieces:
        cost[k] = cost.get(k, 0) + m + m * m / 512
    assert max(cost.values()) < 2 * np.median(list(cost.values()))
    assert len(pieces) < 1.3 * len(lengths)


def test_token_file_access(spark):
    df = spark.createDataFrame([(i, f"text number {i} " * (i % 50)) for i in range(300)], DOCS)
    folder = token_files.token_folder(df)
    manifest = token_files.write_token_files(df, tokenizer_file("word_bpe_49k.json"), 2, folder, sequence=16).collect()
    assert sum(r.n_docs for r in manifest) == 300
    for r in manifest:
        f = token_files.TokenFile(folder, r.part)
        n = -(-r.n_tokens // 16)
        ids = np.concatenate([f.sequence(i)[0] for i in range(n)])
        mask = np.concatenate([f.sequence(i)[1].to_numpy(zero_copy_only=False) for i in range(n)])
        batch = f.tokens.get_batch(0)
        view, bits = f.sequence(1)  # no copies: the views lie in the mapped file
        column = batch.column(0).flatten()
        assert view.ctypes.data == column.buffers()[1].address + 16 * view.itemsize
        assert bits.buffers()[1].address == batch.column(1).flatten().buffers()[1].address and bits.offset == 16
        assert mask.sum() == r.n_tokens and mask[: r.n_tokens].all()
        assert (np.concatenate(list(f.ids(0, r.n_tokens))) == ids[: r.n_tokens]).all()


def test_hamming_search(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(20)]
    rows = [(i, f"{base[i % 20] ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(6))):032x}") for i in range(200)] + [(999, None)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    asked = df.filter("doc_id % 10 = 0")
    apart = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count()
    got = sorted((r.q, r.p, r.distance) for r in fingerprints.within_radius(df, asked, 3).collect())
    assert got == sorted({(x, y, apart(x, y)) for a, x in rows[:-1] if a % 10 == 0 for _, y in rows[:-1] if apart(x, y) <= 3})
    near = {r.doc_id: (r.n_within, r.nearest) for r in fingerprints.neighbours(df, asked, 3).collect()}
    for a, x in rows[:-1:10]:
        mine = [d for b, y in rows[:-1] if a != b and (d := apart(x, y)) <= 3]
        assert near[a] == (len(mine), min(mine) if mine else None)


def operators(df, spark):
    bench = spark.createDataFrame([(1, "some text to look for here")], "item_id long, text string")
    folder = token_files.token_folder(df)
    byte = tokenizer_file("byte_bpe_50k.json")
    return {
        "probes": fingerprints.edit_probes(df),
        "prints": fingerprints.fingerprints(df),
        "tokens": token_files.read_token_files(token_files.write_token_files(df, byte, 0, folder), folder),
        "contaminated": decontamination.contaminated(df, bench).select("doc_id").distinct(),
        "licenses": licenses.scan(df),
        "packing": packing.pack_documents(df, byte, 0).select("doc_id", "doc_tokens").distinct(),
        "neardup": neardup.near_duplicates(df),
        "language": langid.predict(df, langid.fit(df.withColumn("lang", F.lit("en")))),
        "clean": decontamination.clean(df, bench),
        "substrings": substrings.without_repeats(df),
    }


def test_empty_tables(spark):
    for name, out in operators(spark.createDataFrame([], DOCS), spark).items():
        assert out.count() == 0, name
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_conversations(chat.written(chat.format_conversations(empty))).count() == 0
    rules, listed = urls.default_tables(spark)
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urls.filter_urls(pages.limit(0), rules, listed).count() == 0
    assert [r.verdict for r in urls.filter_urls(pages, rules.limit(0), listed.limit(0)).collect()] == ["allow"]
    assert decontamination.contaminated(spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    text = " ".join(f"v{i}" for i in range(40))
    rows = [(None, text), (None, None), (1, text), (1, text), (1, "other " + text), (2, text), (2, None), (None, text)]
    df = spark.createDataFrame(rows, DOCS)
    for name, out in operators(df, spark).items():
        if name not in ("contaminated", "packing"):
            assert out.count() == len(rows), name
    found = decontamination.contaminated(df, spark.createDataFrame([(1, "v1 v2 v3 v4 v5 v6 v7"), (1, "v1 v2 v3 v4 v5 v6 v7"), (None, "other v0 v1 v2 v3")], "item_id long, text string"))
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == sorted([(d, 1) for d in (None, None, 1, 1, 1, 2) for _ in range(2)] + [(1, None)], key=str)
    pieces = packing.pack_documents(df, tokenizer_file("byte_bpe_50k.json"), 0).collect()
    alone = packing.pack_documents(df.filter("doc_id = 2 and text is not null"), tokenizer_file("byte_bpe_50k.json"), 0).collect()
    assert sum(r.length for r in pieces) == 5 * sum(r.length for r in alone) + 2 + packing.pack_documents(df.filter("text like 'other%'"), tokenizer_file("byte_bpe_50k.json"), 0).first().doc_tokens
    turns = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, None, None, None), (3, 1, "assistant", "b"), (3, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    read = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_conversations(chat.written(chat.format_conversations(turns.withColumn("place", F.lit(1))))).collect()}
    assert read == {None: (3, 0), 3: (2, 2)}
    cut = [(r.doc_id, r.n_removed) for r in substrings.without_repeats(df).collect()]
    assert sorted(cut, key=str) == sorted([(None, 0), (None, 0), (None, 0), (1, 0), (1, 0), (1, 0), (2, 40), (2, 0)], key=str)
    ends = [(r.start, r.n_tokens) for r in operators(df, spark)["tokens"].orderBy("start").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def test_spacing_is_kept(spark):
    text = "\n".join(f"v{i}" for i in range(20))
    df = spark.createDataFrame([(1, text, 5), (2, f"new\tline {text}  and more", 6)], DOCS + ", `odd name` int")
    out = {r.doc_id: r for r in substrings.without_repeats(df, keep_spacing=True).collect()}
    assert out[1].text == text and out[2].text == "new\tline and more" and out[2]["odd name"] == 6


def test_repeats_across_chunks_with_runs(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 300)  # matches must be found by the receivers
    rng = random.Random(7)
    word = lambda: f"v{rng.randrange(50)}"
    rows = []
    for _ in range(150):  # windows of one run: a symbol just fits in, with other words to its left in each copy
        run = [word()] + [word()] * rng.randrange(8, 13) + [word() for _ in range(4)]
        rows += [" ".join([*(word() for _ in range(rng.randrange(1, 4))), *run, word()]) for _ in range(3)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    first, want = {}, {}
    for i, t in rows:
        w = t.split()
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 12):
            if first.setdefault(tuple(w[p : p + 13]), i) < i:
                gone[p : p + 13] = True
        want[i] = int(gone.sum())
    got = {r.doc_id: r.n_removed for r in substrings.without_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want


def test_long_text_outweighs_the_prior():
    weight = np.full((1 << langid.BITS, 2), np.log(1e-4), np.float32)
    weight[:, 1] += 0.04  # a little likelier, n-gram by n-gram
    model = langid.Model(["common", "rare"], np.log([10_000.0, 1.0]), weight)
    names, scores, fits = model.predict(["word " * 4, None, "word " * 1000, "12"])
    assert names == ["common", "und", "rare", "und"]
    assert 0 < scores[2] < 0.9 and scores[1] == scores[3] == 0 and (fits[[0, 2]] > 0).all()


def test_documents_are_cut_only_where_nothing_has_room():
    rng = random.Random(8)
    for _ in range(60):
        lengths = [rng.choice((rng.randrange(1, 1024), rng.randrange(1, 120))) for _ in range(rng.randrange(1, 80))]
        room, cost = packing.capacities(sum(lengths), 1024), {}
        line, want = sorted((-n, d, 0) for d, n in enumerate(lengths)), []
        while line:
            n, d, start = line.pop(0)
            open_ = sorted((cost.get(i, 0.0), i) for i, r in enumerate(room) if r)
            i = next((i for _, i in open_ if room[i] >= -n), open_[0][1])
            m = min(-n, room[i])
            want.append((d, start, m, i))
            room[i] -= m
            cost[i] = cost.get(i, 0.0) + m + m * m / 512
            if m < -n:
                line = sorted([*line, (n + m, d, start + m)])
        assert [x[:4] for x in packing.assign(lengths)] == want


def test_batches_score_like_single_texts(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdé xyz日") for _ in range(rng.randrange(60))) for _ in range(300)]
    weight = np.log(np.random.default_rng(1).random((1 << 10, 5)).astype(np.float32) + 0.01)
    model = langid.Model(list("abcde"), np.zeros(5), weight)
    single = [model.scores([t]) for t in texts]
    monkeypatch.setattr(langid, "BATCH", 500)
    total, grams = model.scores(texts)
    assert grams.tolist() == [g[0] for _, g in single] and np.allclose(total, np.concatenate([t for t, _ in single]), rtol=1e-4)


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_WEIGHTS", 1 << 10)
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03}") for i in range(300)]
    model = langid.fit(spark.createDataFrame(rows, DOCS + ", lang string"))
    assert len(model.languages) == 300 and model.weight.size <= 1 << 10 and langid.bits_for(4) == 8 and langid.bits_for(5) == 7


def passages(rows, size=13):
    first, want = {}, Counter()
    for i, t in sorted(rows):
        w = t.split()
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), i)
    for i, t in rows:
        w = t.split()
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone[p : p + size] = True
        want[i, t, int(gone.sum())] += 1
    return want


@pytest.mark.parametrize("slots", [1 << 6, 1 << 21])
def test_hashed_ids_and_hot_passages(spark, monkeypatch, slots):
    monkeypatch.setattr(substrings, "CHUNK", 600)
    monkeypatch.setattr(substrings, "BUCKET_CHARS", 2000)
    monkeypatch.setattr(substrings, "SEEN", slots)
    rng = random.Random(9)
    hot = " ".join(f"h{i}" for i in range(30))
    text = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 40)))
    rows = [(rng.randrange(-(1 << 63), 1 << 63), f"{text()} {hot} {text()}") for _ in range(150)]
    rows += [(-8 * 10**18, hot), (8 * 10**18, hot), (8 * 10**18, hot + " and"), (8 * 10**18, hot), (-(1 << 63), "begin " + hot), ((1 << 63) - 1, "x " + hot + " y")]
    rows += [(i, rows[rng.randrange(150)][1]) for i in range(40)]
    rng.shuffle(rows)
    out = substrings.without_repeats(spark.createDataFrame(rows, DOCS).withColumn("whole", F.col("text")).repartition(3)).collect()
    assert Counter((r.doc_id, r.whole, r.n_removed) for r in out) == passages(rows)
    unique = list({i: (i, t) for i, t in rows}.values())
    out = substrings.without_repeats(spark.createDataFrame(unique, DOCS).withColumn("whole", F.col("text")).repartition(3)).collect()
    assert Counter((r.doc_id, r.whole, r.n_removed) for r in out) == passages(unique)


def test_seen_windows_thin_hot_passages(monkeypatch):
    monkeypatch.setattr(substrings, "SEEN", 1 << 12)
    seen, rng = substrings.Seen(), np.random.default_rng(2)
    hot = kernels.mix(np.arange(1, 31, dtype=np.uint64))
    sent = 0
    for chunk in range(50):
        value = np.r_[hot, rng.integers(0, 1 << 63, 500, dtype=np.uint64)]
        sent += int((~seen.later(value, kernels.mix(value.copy()), np.full(len(value), chunk))[:30]).sum())
    assert sent <= 60  # 30 windows in 50 chunks


@pytest.mark.parametrize("text", ["mit license mit license mit license", "by nc by nc by nc by nc by nc", "of the software of the software of the software", "permission notice permission notice"])
def test_repeated_scraps_are_no_license(spark, text):
    r = licenses.scan(spark.createDataFrame([(1, text)], DOCS)).first()
    assert (r.labels, r.score) == ("", 0.0)


def test_license_texts_are_found(spark):
    rng = random.Random(6)
    noise = " ".join(f"code{i}" for i in range(200))
    rows, want = [], {}
    for i, (text, label) in enumerate(licenses.TEMPLATES):
        w = text.split()
        rows.append((i, f"{noise} {text.upper()} {noise} {text}"))
        want[i] = (label, 1.0)
        if len(w) > 40:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), "word")
            rows.append((100 + i, f"{noise} {' '.join(w)}"))
            want[100 + i] = (label, None)
    for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect():
        label, score = want[r.doc_id]
        assert label in r.labels.split(",") and (r.score == score if score else r.score >= 0.7)


def test_hubs_are_joined_in_parts(spark, monkeypatch):
    from siftwork.llm import graph

    monkeypatch.setattr(graph, "HEAVY", 5)
    edges = [(1, i) for i in range(2, 400)] + [(i, i + 1000) for i in range(2, 300)] + [(5000, i) for i in range(6000, 6100)] + [(6050, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {1} and len(got) == len({x for e in edges for x in e})


def test_members_far_from_the_hub_of_a_band_meet(spark, monkeypatch):
    """Two near copies whose every shared band has a third, dissimilar class as its hub."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    near = list(base)
    near[30] = "changed"
    far = [f"f{rng.randrange(10**6)}" for _ in range(60)]
    df = spark.createDataFrame([(0, " ".join(far)), (1, " ".join(base)), (2, " ".join(near))], DOCS)
    whole = neardup._bands

    def poisoned(classes):  # the dissimilar class takes every band of the others
        out = whole(classes)
        return out.unionByName(out.select(F.lit(0).cast("long").alias("cls"), "band")).distinct()

    monkeypatch.setattr(neardup, "_bands", poisoned)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, shingle_words=2).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_recall_at_the_threshold(spark):
    """Pairs of 0.80 to 0.86 similarity, each in a family of its own: nearly all must be linked."""
    rng = random.Random(12)
    rows, pairs = [], []
    for g in range(400):
        n = rng.choice((20, 60, 200))
        a = [f"g{g}w{i}" for i in range(n)]
        b = list(a)
        sa = {tuple(a[i : i + 2]) for i in range(n - 1)}
        while True:
            c = list(b)
            c[rng.randrange(n)] = f"n{rng.random()}"
            sc = {tuple(c[i : i + 2]) for i in range(n - 1)}
            if 100 * len(sa & sc) < 80 * len(sa | sc):
                break
            b = c
        if b != a:
            pairs.append((2 * g, 2 * g + 1))
            rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(b))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle_words=2).collect()}
    assert len(pairs) > 300 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_many_listed_urls_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(urls, "BROADCAST_KEYS", 0)
    listed = [(f"h{i}.example", "/" + "p" * (i % 40)) for i in range(20_000)]
    pages = [(i, f"http://www.h{i}.example/{'p' * 20}/x") for i in range(0, 40_000, 37)] + [(None, None), (None, None), (7, "http://hot.example/")] * 50
    rules, _ = urls.default_tables(spark)
    out = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), rules, spark.createDataFrame(listed, "host string, path string")).collect()
    assert len(out) == len(pages)
    for r in out:
        if r.host.startswith("www.h"):
            i = int(r.host[5:-8])
            assert r.verdict == ("block" if i < 20_000 and i % 40 <= 20 else "allow")
        else:
            assert r.verdict == "allow"


RETAINED = """
import ctypes, re
from unittest import mock
import numpy as np, pyarrow as pa
from siftwork.llm import substrings

class Frame:  # keeps the functions that it is given
    runs = []
    def mapInArrow(self, run, schema):
        self.runs.append(run)
        return self
    def __lt__(self, other):
        return self
    def __getattr__(self, name):
        return lambda *a, **k: self

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

with mock.patch.object(substrings, "F", Frame()):
    substrings.repeated_windows(Frame(), 13, 50, 53, False)
rng = np.random.default_rng(1)
texts = [" ".join(map(str, rng.integers(1000, 99999, 350))) for _ in range(6000)]
for turn in range(2):
    for out in Frame.runs[0](iter([pa.record_batch([pa.array(range(6000)), pa.nulls(6000, pa.int64()), pa.array(texts)], ["id", "part", "text"])])):
        pass
del out
before = held()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
print(before - held())
"""


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim") or not Path("/proc/self/smaps_rollup").exists(), reason="needs glibc and Linux")
def test_substring_tasks_hand_freed_memory_back():
    """A worker keeps little of a task's working memory when the task has ended."""
    root = str(Path(substrings.__file__).resolve().parents[2])
    run = subprocess.run([sys.executable, "-c", RETAINED], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120, check=True)
    assert float(run.stdout) < 25


def test_tidy_hands_back_when_a_task_ends_or_is_left(monkeypatch):
    calls = []
    monkeypatch.setattr(kernels, "give_back", lambda: calls.append(1))
    run = kernels.tidy(lambda batches: (b for b in batches))
    assert list(run(iter([1, 2]))) == [1, 2] and calls == [1]
    left = run(iter([1, 2]))
    next(left)
    left.close()
    assert calls == [1, 1]
