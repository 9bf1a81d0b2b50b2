"""The encoder against the library on whole texts, for the known tokenizer kinds and for others."""

import json
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siftwork.llm import tokens
from siftwork.llm.queries import tokenizer_file

ALPHABET = [*"abcdeAB'st.,!12 \n\t\r", "  ", "\n\n", "ß", "É", "İ", "ı", "ǅ", "日本", "ǘ", "é", "<|endoftext|>", "'ll", " 's", " word", " Other", "\x0b", "\xa0", " "]


def texts(n=3000, odd=True):
    rng = random.Random(3)
    chosen = ALPHABET if odd else ALPHABET[:-3]
    out = ["".join(rng.choice(chosen) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [*out, None, "", " ", "\n", "  ", "a ", " a", "\n\na\n\n", "a  b", "x" * 500 + " y"]


def variant(path, tmp_path, change):
    kind = json.loads(Tokenizer.from_file(path).to_str())
    change(kind)
    out = tmp_path / "tokenizer.json"
    out.write_text(json.dumps(kind))
    return str(out)


def same(path, end=7):
    encode = tokens.Encoder(path, end)
    for odd in (True, False):
        rows = texts(odd=odd)
        ids, offsets = encode.encode(pa.array(rows))
        want = [e.ids + [end] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in rows], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    return encode


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_known_kinds(name, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 2000)
    monkeypatch.setattr(tokens, "MEMO", 300)  # chunks are forgotten and learned again
    encode = same(tokenizer_file(name))
    assert encode.memo and encode.older


def prefix(kind):
    kind["pre_tokenizer"]["add_prefix_space"] = True


def split_first(kind):
    step = {"type": "Split", "pattern": {"Regex": "\\p{N}{1,3}"}, "behavior": "Isolated", "invert": False}
    kind["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [step, kind["pre_tokenizer"]]}


def lower(kind):
    kind["normalizer"] = {"type": "Lowercase"}


@pytest.mark.parametrize("change", [prefix, split_first, lower])
def test_other_definitions_are_encoded_whole(change, tmp_path):
    encode = same(variant(tokenizer_file("byte_bpe_50k.json"), tmp_path, change))
    assert not encode.memo


def test_rows_of_a_slice():
    encode = tokens.Encoder(tokenizer_file("byte_bpe_50k.json"), 0)
    column = pa.array(["one", "two words", None, "three more words"])
    ids, offsets = encode.encode(column)
    some, cut = encode.encode(column.slice(1, 2))
    assert some.tolist() == ids[offsets[1] : offsets[3]].tolist() and cut.tolist() == (offsets[1:4] - offsets[1]).tolist()
    assert encode.encode(column.slice(0, 0))[1].tolist() == [0]
