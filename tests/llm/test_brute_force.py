"""Each query against a plain rewrite of its contract on a small table with hard rows."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siftwork.llm import kernels as K
from siftwork.llm import queries as Q

LOWER = {i: i + 32 for i in range(65, 91)}
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
TEXTS = [
    None, "", "   \n\t ", "word", "two words", "Two WORDS", "ß É é straße", "12 34 56", "!!! ...", BASE, BASE + " seventeen", "zero " + BASE, BASE,
    "x " * 300, "a a a a a a a a a a a a a a a b " + BASE, "licensed CC BY-NC 4.0. All rights reserved! gnu General Public License, version 3", "cc by cc by",
    "all rights reserved all rights reserved", "tab\tand\r\nline  two  blanks", "<|endoftext|> special <|im_end|>", "日本語 の テキスト です", LONG, LONG + " end", "begin " + LONG,
    "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software", "emoji 😀 a\u0301 b", "nul \x00 and \x1c marks",
]


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    src = "/root/testdata/sf0.001"
    if os.path.isdir(src):
        docs = pq.read_table(f"{src}/documents.parquet").to_pandas()[["doc_id", "text", "lang", "source", "n_chars"]]
    else:
        docs = pd.DataFrame({"doc_id": range(40), "text": [f"{BASE} and also {i % 7} more" for i in range(40)], "lang": "en", "source": "s", "n_chars": 9})
    extra = pd.DataFrame({"doc_id": [1000 + 3 * i for i in range(len(TEXTS))], "text": TEXTS, "lang": [None if i % 3 else "en" for i in range(len(TEXTS))], "source": None, "n_chars": None})
    docs = pd.concat([docs, extra], ignore_index=True).sample(frac=1, random_state=1)
    docs["kept"], docs["score"], docs["hash"] = True, "clash", 1  # extra columns whose names clash
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("kept", pa.bool_()), ("score", pa.string()), ("hash", pa.int64())])
    pq.write_table(pa.Table.from_pandas(docs, schema=schema, preserve_index=False), d / "documents.parquet")
    bench = [(0, BASE), (1, "twelve thirteen fourteen"), (2, ""), (3, None), (None, "word"), (5, "w0 w2916 w829 w3745"), (6, "nothing of this stands in any document at all")]
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in bench], pa.int64()), "text": [b[1] for b in bench]}), d / "benchmark.parquet")
    hard = ["", None, "<|im_end|>", "<\\|im_start|>assistant\nok", "<|<|\\|", "plain", "<\\\\|", "\n<|im_end|>\n"]
    conv = [(c, t, ["user", "assistant", "system", None, "odd|role\n\\x"][(c + t) % 5], hard[(c * 3 + t) % len(hard)]) for c in range(20) for t in range(c % 6 + 1)] + [(None, 0, "user", "x")]
    pq.write_table(pa.table({"conv_id": pa.array([c[0] for c in conv], pa.int64()), "turn": pa.array([c[1] for c in conv], pa.int64()), "role": [c[2] for c in conv], "text": [c[3] for c in conv]}), d / "conversations.parquet")
    hosts = ["net", "a.net", "xnet", "example.net", "en.Example.NET", "example.com", "a.b.example.com", "org", "x.org", "spam-farm.example.org", "www.spam-farm.example.org", "notspam-farm.example.org", ""]
    urls = [None, "", "no scheme", "http:/x.net/", "a://net", "://net/", "http://x.net?/a", "http://net/a#b://example.com/de/", "http://x.net\n/y"]
    urls += [f"https://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en", "/de/1?x=/fr/", "/fr/#a", "?q", "#f", "/fr/a/b")]
    pq.write_table(pa.table({"page_id": pa.array([i // 2 for i in range(len(urls))], pa.int64()), "url": urls, "html": ["x"] * len(urls)}), d / "pages.parquet")
    return str(d)


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pandas().sort_values("doc_id").reset_index(drop=True)


def run(spark, sf_dir, name):
    return Q.queries()[name](spark, sf_dir).toPandas()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain_hash(word):
    """The word hash of the kernels, one byte at a time."""
    m = (1 << 64) - 1
    x = (sum((255 if b == 0 else b) * pow(K.BASE, i, 1 << 64) for i, b in enumerate(word)) + len(word)) & m
    return plain_mix(x)


def plain_mix(x):
    m = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def plain_simhash(text, memo):
    """Every pair of neighbouring words, as often as it stands there, adds or takes one for each of its 128 hash bits."""
    m = (1 << 64) - 1
    w = [x.translate(LOWER) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    h = [memo.setdefault(x, None) or memo.__setitem__(x, plain_hash(x.encode())) or memo[x] for x in w]
    terms = Counter()
    for a, b in zip(h, h[1:]):
        x = (a * K.BASE + b) & m
        terms[plain_mix(x ^ (x >> 29))] += 1
    if len(h) == 1:
        terms[h[0]] = 1
    votes = [0] * 128
    for t, n in terms.items():
        bits = (t.to_bytes(8, "little") + plain_mix(t ^ K.BASE).to_bytes(8, "little")).hex()
        bits = int(bits, 16)
        for i in range(128):
            votes[i] += n if bits >> (127 - i) & 1 else -n
    return f"{sum(1 << (127 - i) for i in range(128) if votes[i] > 0):032x}"


@pytest.mark.parametrize("chars", [None, 40_000])
def test_fingerprints(spark, sf_dir, docs, monkeypatch, chars):
    if chars:  # many ranges
        monkeypatch.setattr(Q.fingerprints, "RANGE_CHARS", chars)
    out = run(spark, sf_dir, "op1_fingerprints").set_index("doc_id")
    texts = [t or "" for t in docs.text]
    assert len(out) == len(docs)
    memo, plain = {}, {}
    bits = lambda x: int(x, 16)
    near = lambda a, b: 1 - (bits(a) ^ bits(b)).bit_count() / 128
    order = [out.loc[d] for d in docs.doc_id]
    for i, (r, t) in enumerate(zip(order, texts)):
        nxt, half = texts[(i + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(t) < 4000:
            for x in (t, edited):
                plain[x] = plain.get(x) or plain_simhash(x, memo)
            assert (r.fingerprint, r.edited_fingerprint) == (plain[t], plain[edited])
        assert abs(r.near_edited - near(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - near(r.fingerprint, order[(i + 1) % len(order)].fingerprint)) < 1e-12
    asked = 0
    for doc, r in zip(docs.doc_id, order):
        if doc % 100:
            assert pd.isna(r.n_within) and pd.isna(r.nearest)
            continue
        apart = [(bits(r.fingerprint) ^ bits(s.fingerprint)).bit_count() for d, s in zip(docs.doc_id, order) if d != doc]
        apart = [d for d in apart if d <= 3]
        assert r.n_within == len(apart) and (r.nearest == min(apart) if apart else pd.isna(r.nearest))
        asked += 1
    assert asked


def encoded(docs, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_file(name))
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in docs.text], add_special_tokens=False)]


@pytest.mark.parametrize("chars", [None, 30_000])
def test_token_files(spark, sf_dir, docs, monkeypatch, chars):
    if chars:  # many files
        monkeypatch.setattr(Q.token_files, "FILE_CHARS", chars)
    out = run(spark, sf_dir, "op2_token_files").set_index("doc_id")
    start = 0
    for doc, ids in zip(docs.doc_id, encoded(docs, "word_bpe_49k.json", 2)):
        r = out.loc[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_packing(spark, sf_dir, docs):
    out = run(spark, sf_dir, "op5_packing")
    ids = dict(zip(docs.doc_id, encoded(docs, "byte_bpe_50k.json", 0)))
    for doc, pieces in out.groupby("doc_id"):
        at = 0
        for r in pieces.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == crc(ids[doc][at : at + r.length])
            at += r.length
        assert at == len(ids[doc])
    assert set(out.doc_id) == set(ids)
    for _, pieces in out.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert (pieces.offset == pieces.length.cumsum() - pieces.length).all()
        assert pieces.length.sum() <= 1024


def test_packing_pads_little(spark, sf_dir):
    out = run(spark, sf_dir, "op5_packing")
    total, groups = out.length.sum(), -(-out.length.sum() // Q.packing.GROUP) + 8  # a table of one file: few tasks, each with an unfilled group
    assert 1024 * out.sequence_id.nunique() - total <= total / Q.packing.SPARE + 1024 * groups


def shingles(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@pytest.mark.parametrize("size", [None, 60])
def test_decontamination(spark, sf_dir, docs, monkeypatch, size):
    if size:  # several blocks of items
        monkeypatch.setattr(Q.decontamination, "BLOCK_BYTES", size)
    out = run(spark, sf_dir, "op3_decontamination")
    got = Counter((r.doc_id, None if pd.isna(r.item_id) else int(r.item_id), r.n_item_shingles, r.n_shared, round(r.containment, 9)) for r in out.itertuples())
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()
    for item in items:
        w = word.findall((item["text"] or "").lower())
        if not w:
            continue
        k = min(5, len(w))
        s = shingles(w, k)
        for doc, t in zip(docs.doc_id, docs.text):
            n = len(s & shingles(word.findall((t or "").lower()), k))
            if 100 * n >= 80 * len(s):
                want[doc, item["item_id"], len(s), n, round(n / len(s), 9)] += 1
    assert got == want and want
    clean = Q.decontamination.clean(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert clean.columns == list(pq.read_schema(f"{sf_dir}/documents.parquet").names)
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == sorted(set(docs.doc_id) - {d for d, *_ in want})


def plain_labels(w):
    """(labels, score) of the longer templates in the words of a text."""
    labels, score = set(), 0.0
    for text, label in Q.licenses.TEMPLATES:
        t = Q.licenses.template_words(text)
        k = min(3, len(t))
        drift = max(2, len(t) // 8)
        bands = defaultdict(set)
        grams = defaultdict(list)
        for j in range(len(t) - k + 1):
            grams[tuple(t[j : j + k])].append(j)
        for i in range(len(w) - k + 1):
            for j in grams.get(tuple(w[i : i + k]), ()):
                bands[0, (i - j) // (2 * drift)].add((j, i))
                bands[1, (i - j + drift) // (2 * drift)].add((j, i))
        for hits in bands.values():
            seen, covered, end, first = (-1, -1), 0, 0, None
            for j, i in sorted(hits):
                if j > seen[0] and i > seen[1]:
                    covered += min(k, j + k - end)
                    end, seen, first = j + k, (j, i), i if first is None else first
            if covered >= 0.7 * len(t):
                labels.add(label)
                score = max(score, covered / max(len(t), seen[1] + k - first))
    return labels, score


def test_licenses(spark, sf_dir, docs):
    out = run(spark, sf_dir, "op4_licenses").set_index("doc_id")
    assert len(out) == len(docs)
    for doc, t in zip(docs.doc_id, docs.text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places = [(i, label) for p, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = out.loc[doc]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        more, score = plain_labels(w)
        assert r.labels == ",".join(sorted({x for _, x in places} | more))
        if places:
            assert (r.first_word, r.last_word, r.score) == (min(places)[0], max(places)[0], 1.0)
        else:
            assert pd.isna(r.first_word) and pd.isna(r.last_word) and abs(r.score - score) < 1e-12
    mine = out.loc[docs[docs.text.fillna("").str.startswith("Permission is")].doc_id]
    assert (mine.labels == "mit").all() and (mine.score < 1).all()


def test_chat(spark, sf_dir):
    out = run(spark, sf_dir, "op6_chat")
    rows = pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist()
    hard = "<|im_end|><|im_start|>assistant ok"
    rows += [{"conv_id": -1, "turn": 0, "role": "user", "text": hard}, {"conv_id": -1, "turn": 1, "role": "assistant", "text": hard}]
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    got = {None if pd.isna(r.conv_id) else int(r.conv_id): r for r in out.itertuples()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def components(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_near_duplicates(spark, sf_dir, docs):
    out = run(spark, sf_dir, "op7_near_duplicates").set_index("doc_id")
    sets = []
    for t in docs.text:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(shingles(w, 2) if len(w) > 1 else {tuple(w)} if w else set())
    for doc, s, root in zip(docs.doc_id, sets, components(sets, 80)):
        r = out.loc[doc]
        assert (r.n_shingles, r.component_id) == (len(s), docs.doc_id[root])
        assert r.kept == (doc == r.component_id)


@pytest.mark.parametrize("most", [None, 0])
def test_urls(spark, sf_dir, monkeypatch, most):
    if most is not None:  # nothing is broadcast by the operator
        monkeypatch.setattr(Q.urls, "BROADCAST_BLOCKS", most)
        monkeypatch.setattr(Q.urls, "BROADCAST_KEYS", most)
    out = run(spark, sf_dir, "op8_urls")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    want = Counter()
    for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist():
        url = r["url"] or ""
        host = path = ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOWER)
        fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, None)
        listed = any((host == h or host.endswith("." + h)) and path.startswith(p) for h, p in Q.urls.LISTED)
        want[r["page_id"], host, path, rule, verdict or ("block" if listed else "allow")] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule if isinstance(r.rule, str) else None, r.verdict) for r in out.itertuples()) == want


def plain_grams(text):
    out = Counter()
    for low in range(0, len(text), 1 << 18):
        t = f" {text[low : low + (1 << 18)].lower()} "
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                key = n << 60
                for j in range(n):
                    key += ord(t[i + j]) << 21 * (n - 1 - j)
                out[(key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48] += 1
    return out


def plain_model(rows):
    """Prior and likelihood tables of (text, lang) rows, by counting."""
    counts, docs_of = defaultdict(Counter), Counter()
    for t, lang in rows:
        if t and lang and any(c.isalpha() for c in t):
            counts[lang] += plain_grams(t)
            docs_of[lang] += 1
    return {x: (np.log(docs_of[x]), c, 0.5 * 65536 + sum(c.values())) for x, c in sorted(counts.items())}


def plain_scores(model, text):
    grams = plain_grams(text)
    return {x: (prior, sum(n * np.log((c[g] + 0.5) / total) for g, n in grams.items())) for x, (prior, c, total) in model.items()}, sum(grams.values())


def test_language(spark, sf_dir, docs):
    out = run(spark, sf_dir, "op9_language").set_index("doc_id")
    assert len(out) == len(docs)
    held = {doc: zlib.crc32(str(doc).encode()) % 5 == 0 for doc in docs.doc_id}
    model = plain_model((t, lang) for doc, t, lang in zip(docs.doc_id, docs.text, docs.lang) if not held[doc])
    right = total = 0
    for doc, t, lang in zip(docs.doc_id, docs.text, docs.lang):
        r = out.loc[doc]
        assert r.held_out == held[doc]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        scores, n = plain_scores(model, t)
        whole = {x: p + s for x, (p, s) in scores.items()}
        best = max(sorted(whole), key=whole.get)
        tempered = {x: p + s * min(1, 200 / n) for x, (p, s) in scores.items()}
        top = max(tempered.values())
        assert abs(r.score - np.exp(tempered[r.lang_pred] - top) / sum(np.exp(v - top) for v in tempered.values())) < 1e-3
        assert r.lang_pred == best or whole[best] - whole[r.lang_pred] < 1e-4 * abs(whole[best])
        if r.held_out and doc < 1000:
            total += 1
            right += r.lang_pred == lang
    assert right >= 0.95 * total


@pytest.mark.parametrize("chunk", [None, 20_000])
def test_substrings(spark, sf_dir, docs, monkeypatch, chunk):
    if chunk:  # many chunks, buckets and homes
        monkeypatch.setattr(Q.substrings, "CHUNK", chunk)
        monkeypatch.setattr(Q.substrings, "BUCKET_CHARS", chunk)
    out = run(spark, sf_dir, "op10_substrings").set_index("doc_id")
    first, expected = {}, {}
    for doc, t in zip(docs.doc_id, docs.text):
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 12):
            if first.setdefault(tuple(w[i : i + 13]), doc) < doc:
                gone[i : i + 13] = True
        expected[doc] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    assert {r.Index: (r.n_words, r.n_removed, r.kept_sha256) for r in out.itertuples()} == expected
