"""Tokenizers-library encoding with a memo of independent chunks, exact to encoding whole texts.

Both supported tokenizer kinds cut a text at white space before merging: a word
with the white space before it is encoded alike wherever it stands. Arrow splits
a batch of texts and names its distinct chunks; a worker has the library encode
each new chunk once, and the ids of all texts are gathered from those of the
chunks. Texts with anything for which this does not hold (control characters,
rare white space, special-token strings) are encoded whole, and so is every text
of a tokenizer whose definition is not exactly one of the two known.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from siftwork.llm import kernels as K

#: Chunks in each of the two generations that a worker keeps (some 50 MB). What is met again moves on to the younger one.
MEMO = 250_000
#: Bytes of text whose chunks are named together.
GROUP = 4 << 20
# The pre-token patterns of the two tokenizer kinds and the byte-level alphabet.
WORD_KIND = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_KIND = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = {b: b for b in _PRINTED} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}
_LEVELS = "".join(chr(BYTE_LEVEL[b]) for b in range(256))
# Normaliser and pre-tokenizer of the two kinds, whole; a definition that differs anywhere is not theirs.
_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
BYTE_DEFINITION = (None, _LEVEL | {"use_regex": True})
WORD_DEFINITION = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_KIND}, "behavior": "Removed", "invert": True}, _LEVEL | {"use_regex": False}]},
)
#: Control characters and white space of other kinds than blank, tab, line feed and return; invisible marks.
ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
#: In a byte-level chunk, white space other than one blank is written in these codes; START marks that none stands before it.
CODES, START, END, WHOLE = {" ": "\x02", "\n": "\x03", "\t": "\x04", "\r": "\x05"}, "\x01", "\x06", "\x07"
_CODE, _PLAIN = str.maketrans(CODES), str.maketrans({v: k for k, v in CODES.items()})
_RUN, _RUNS = re.compile("[ \n\t\r]{2,}|[\n\t\r]"), ("  ", "\n\n", " \n", "\n ", "\t", "\r")
#: Chunks with other than common Latin characters take the library's whole path.
UNUSUAL = re.compile("[^\x01-\x05\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]")
#: Longer chunks are not kept.
LONGEST = 64


class Encoder:
    """Encode texts to little-endian ids of ``dtype``, each text with the end id appended."""

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        definition = (kind.get("normalizer"), kind.get("pre_tokenizer"))
        model = kind.get("model") or {}
        plain = kind.get("truncation") is None and kind.get("padding") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("byte_fallback")
        specials = kind.get("added_tokens") or []
        plain = plain and not any(t.get("normalized") for t in specials)
        #: white space dropped: chunks are the words; else byte level: a chunk is a word with the white space before it
        self.drops_space = plain and definition == WORD_DEFINITION
        self.by_space = plain and definition == BYTE_DEFINITION
        self.split = regex.compile(WORD_KIND if self.drops_space else BYTE_KIND)
        #: a text with any of these is encoded whole
        self.strings = [t["content"] for t in specials]
        size = max([self.tokenizer.get_vocab_size() - 1, end_id, *(t["id"] for t in specials)])
        self.dtype = np.dtype("<u2") if size < 1 << 16 else np.dtype("<u4")
        assert sys.byteorder == "little"
        self.end = np.array([end_id], self.dtype).tobytes()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new chunks: the library's pre-tokens of Latin chunks go to its BPE model, other chunks through all of it.

        A pre-token is a chunk itself, and is looked up and kept as one.
        """
        found, rest = {}, []
        code = "H" if self.dtype.itemsize == 2 else "I"
        model, split, lower = self.tokenizer.model.tokenize, self.split.findall, self.drops_space
        memo, older, unusual = self.memo.get, self.older.get, UNUSUAL.search
        for c in chunks:
            if c.isalpha():
                if not c.isascii() and unusual(c):
                    rest.append(c)
                elif c not in found:
                    level = c.lower() if lower else " " + c
                    found[c] = array(code, [t.id for t in model(charmap_decode(level.encode(), "strict", _LEVELS)[0])]).tobytes()
                continue
            if unusual(c):
                rest.append(c)
                continue
            ids = []
            for x in split(c.lower() if lower else self._plain(c)):
                name = x if lower else x[1:] if x[0] == " " else START + x
                known = memo(name)
                if known is None:
                    known = older(name)
                if known is None:
                    known = found.get(name)
                if known is None:
                    known = found[name] = array(code, [t.id for t in model(charmap_decode(x.encode(), "strict", _LEVELS)[0])]).tobytes()
                ids.append(known)
            found[c] = ids[0] if len(ids) == 1 else b"".join(ids)
        if rest:
            found.update(zip(rest, self._encode(rest if lower else [self._plain(c) for c in rest]), strict=True))
        return found

    @staticmethod
    def _plain(chunk: str) -> str:
        """The text that a byte-level chunk stands for."""
        if chunk.startswith(START):
            return chunk[1:]
        return chunk.translate(_PLAIN) if chunk and chunk[0] < "\x06" else " " + chunk

    def _marked(self, text: str) -> str:
        """The text with one blank before every chunk but the first, and the end mark."""
        if self.drops_space:
            for x in "\n\t\r":
                if x in text:
                    text = text.replace(x, " ")
            return f"{text} {END}"
        if any(x in text for x in _RUNS):
            text = _RUN.sub(lambda m: " " + m[0].translate(_CODE), text)
        elif "\n" in text:
            text = text.replace("\n", " " + CODES["\n"])
        return f"{START}{text} {END}"

    def _whole(self, text: str) -> bool:
        return not (self.drops_space or self.by_space) or ODD.search(text) is not None or any(x in text for x in self.strings)

    def _ids(self, keys: list[str], alone: dict[str, bytes]) -> list[bytes]:
        """Ids of distinct chunks; ``alone`` has those of whole texts and of the end."""
        out = list(map(self.memo.get, keys))
        absent = [x for x, y in zip(keys, out, strict=True) if y is None]
        if absent:
            older = self.older
            found = {x: older[x] for x in absent if x in older}
            found.update(self._learn([x for x in absent if x not in found and x not in alone]))
            if len(self.memo) + len(found) > MEMO:
                self.memo, self.older = {}, self.memo
            self.memo.update((c, v) for c, v in found.items() if len(c) <= LONGEST)
            out = [(alone[x] if x in alone else found[x]) if y is None else y for x, y in zip(keys, out, strict=True)]
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, each row (null: empty) with the end id, and the rows' offsets in it."""
        parts, sizes = [], [np.zeros(1, np.int64)]
        for low, high in K.pieces(column, GROUP):
            ids, offsets = self._group(column.slice(low, high - low).to_pylist())
            parts.append(ids)
            sizes.append(np.diff(offsets))
        return np.concatenate(parts) if parts else np.zeros(0, self.dtype), np.cumsum(np.concatenate(sizes))

    def _group(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        alone = {END: self.end}
        marked, whole = [], []
        for t in texts:
            t = t or ""
            if self._whole(t):
                marked.append(f"{WHOLE}{len(whole)} {END}")
                whole.append(t)
            else:
                marked.append(self._marked(t))
        alone |= {f"{WHOLE}{i}": x for i, x in enumerate(self._encode(whole))}
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        named = lists.flatten().dictionary_encode()
        known = self._ids(named.dictionary.to_numpy(zero_copy_only=False).tolist(), alone)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(known), self.dtype)
        starts = np.cumsum(sizes) - sizes
        which = named.indices.to_numpy()
        length = sizes[which]
        ends = np.cumsum(length)
        at = np.repeat(starts[which] - (ends - length), length)
        at += np.arange(len(at))
        rows = np.r_[0, ends][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return flat[at], rows


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """The worker's encoder, kept between tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]
