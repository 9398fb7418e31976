"""BPE encoding and decoding with a public vocabulary file (operator 6).

Every pre-token is encoded by a priority queue of merge ranks over a doubly linked list of symbols:
the lowest rank (leftmost on ties) is merged first, and queue entries whose symbols have changed since
they were pushed are skipped. Decoding joins the ids' vocabulary strings, with one space between them
as the library does for a file that names no decoder.

Defined results: null and empty texts have no tokens (the digests are those of the empty string);
repeated rows encode alike; other columns of the input are not looked at. A word of any length costs
O(n log n), whatever its length. The vocabulary is read on the driver and broadcast (49,408 strings whatever the corpus).
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import map_rows

#: Words whose codes a worker keeps; the older half goes when it is full.
CACHE_WORDS = 250_000



def _ranges(kind: str) -> str:
    """A character class's inside for all code points of a general category."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: The splitting pattern of the vocabulary file, with white space spelled out.
_SPACES = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+".format(L=_ranges("L"), N=_ranges("N"), S=_SPACES))
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")


#: Bits of an id, and of a place in a word; longer words have as many as they need.
_BITS, _WIDTH = 20, 24
_ID = (1 << _BITS) - 1


class _Cache(dict):
    """Values by word, made when first asked for; the older half goes when it is full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str):
        return self.put(word, self.make(word))

    def put(self, word: str, got: str) -> str:
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                for old in [*self][: CACHE_WORDS // 2]:
                    del self[old]
            self[word] = got
        return got


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(spare))
        spare += b not in shown
    return out


class WordCodec:
    """Encoder and decoder for a vocabulary with an end-of-word suffix."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, special: dict[str, int]):
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in special.items()}
        self.vocab, self.suffix, self.special = vocab, suffix, special
        self.rank = {}
        for r, (a, b) in enumerate(m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges):
            if a in vocab and b in vocab:
                self.rank.setdefault(vocab[a] << _BITS | vocab[b], r << _BITS | vocab[a + b])
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        self.last = {vocab[c]: vocab[c + suffix] for c in letters}
        self.by_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.string_of: dict[str, str] = _Cache(self._string)
        self.ids_of: dict[str, str] = _Cache(self._ids)

    @classmethod
    def from_json(cls, text: str) -> WordCodec:
        spec = json.loads(text)
        model = spec["model"]
        return cls(model["vocab"], model["merges"], model["end_of_word_suffix"] or "", {t["content"]: t["id"] for t in spec["added_tokens"]})

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token. A queue entry is rank, merged id and position; it is stale unless its position still awaits it."""
        first, rank = self.first, self.rank.get
        ids = [first[b] for b in word.encode("utf-8", "replace")]
        ids[-1] = self.last[ids[-1]]
        n = len(ids)
        if n == 1:
            return ids
        width = max(_WIDTH, n.bit_length())
        place = (1 << width) - 1
        awaited = [rank(ids[i] << _BITS | ids[i + 1], 0) for i in range(n - 1)]
        queue = []
        for i, m in enumerate(awaited):
            if m:
                awaited[i] = m = m << width | i
                queue.append(m)
        if not queue:
            return ids
        awaited.append(0)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & place
            if awaited[i] != top:
                continue
            ids[i] = made = top >> width & _ID
            j = after[i]
            awaited[j] = 0
            after[i] = k = after[j]
            m = 0
            if k < n:
                before[k] = i
                if m := rank(made << _BITS | ids[k], 0):
                    m = m << width | i
                    heappush(queue, m)
            awaited[i] = m
            h = before[i]
            if h >= 0:
                if m := rank(ids[h] << _BITS | made, 0):
                    m = m << width | h
                    heappush(queue, m)
                awaited[h] = m
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if text.isascii():
            return _SPLIT_ASCII.findall(text.lower())
        return _SPLIT.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part in self.by_special.split(text or "") if self.by_special else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for w in self.words(part):
                    out += self.word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])

    def piece(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        return [i for w in self.words(text) for i in self.word(w)]

    def _ids(self, text: str) -> str:
        known, strings = self.ids_of.get, self.string_of.get
        ids, shown = [], []
        for w in self.words(text):
            if (held := known(w)) is not None and (string := strings(w)) is not None:
                ids.append(held)
                shown.append(string)
            else:
                made = self.word(w)
                ids.append(" ".join(map(str, made)))
                shown.append(self.decode(made))
        self.string_of.put(text, " ".join(shown))
        return " ".join(ids)

    def _string(self, text: str) -> str:
        return self.decode(self.piece(text))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by a space, decoded text): encode and decode, by cached stretches without white space.

        No pre-token and no composed letter crosses white space. Python also splits at bytes 28 to 31, which
        the vocabulary's pattern takes as symbols, so texts that hold them, or special tokens, go the plain way.
        """
        text = text or ""
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            ids = self.encode(text)
            return len(ids), " ".join(map(str, ids)), self.decode(ids)
        parts = text.split()
        ids = " ".join(filter(None, map(self.ids_of.__getitem__, parts)))
        return ids.count(" ") + bool(ids), ids, " ".join(filter(None, map(self.string_of.__getitem__, parts)))


_codecs: dict[str, WordCodec] = {}


class _Shared:
    """A broadcast vocabulary with a stable key, so that a reused worker parses it once."""

    def __init__(self, held, key: str):
        self.held, self.key = held, key

    def codec(self) -> WordCodec:
        if self.key not in _codecs:
            _codecs.clear()
            _codecs[self.key] = WordCodec.from_json(self.held.value)
        return _codecs[self.key]


def _share(df: DataFrame, path: str) -> _Shared:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return _Shared(df.sparkSession.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest())


def _encode_step(columns: list, shared: _Shared) -> list:
    codec = shared.codec()
    return [columns[0], [codec.encode(t) for t in columns[1]]]


def _decode_step(columns: list, shared: _Shared) -> list:
    codec = shared.codec()
    return [columns[0], [codec.decode(ids or []) for ids in columns[1]]]


def _digest_step(columns: list, shared: _Shared) -> list:
    codec = shared.codec()
    out: list[list] = [columns[0], [], [], []]
    for t in columns[1]:
        n, ids, decoded = codec.digest(t)
        out[1].append(n)
        out[2].append(hashlib.sha256(ids.encode()).hexdigest())
        out[3].append(hashlib.sha256(decoded.encode()).hexdigest())
    return out


def _tokens_step(columns: list, shared: _Shared) -> list:
    codec = shared.codec()
    out: list[list] = [columns[0], [], [], [], []]
    for t in columns[1]:
        n, ids, decoded = codec.digest(t)
        out[1].append(n)
        out[2].append(np.array(ids.split(" ") if ids else [], np.int32))
        out[3].append(hashlib.sha256(ids.encode()).hexdigest())
        out[4].append(hashlib.sha256(decoded.encode()).hexdigest())
    return out


def tokenised(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every text."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, _tokens_step, "doc_id long,n_tokens long,ids array<int>,ids_sha256 string,decoded_sha256 string", _share(df, path))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text."""
    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _encode_step, "doc_id long,ids array<int>", _share(df, path))


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the text that the library's decode gives for every id list."""
    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), _decode_step, "doc_id long,decoded string", _share(df, path))


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) in one narrow pass."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, _digest_step, "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string", _share(df, path))
