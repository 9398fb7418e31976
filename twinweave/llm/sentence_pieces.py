"""SentencePiece encoding and decoding with a merge-type model file (operator 13).

A merge-type model joins, again and again, the neighbouring symbols whose joint string is the piece of highest score
(leftmost of equals). Its result is found here without a queue, by a table of prefixes:

* Every prefix of a text has one encoding, so one last token, and the encoding without that token is the encoding of a
  shorter prefix. An Aho-Corasick automaton gives the pieces that end at a place; the one whose predecessor, the last
  token of the prefix before it, is *compatible* with it is the last token there. Ids are then recovered from the end.
* Two tokens are compatible if the merges that built them would not have joined anything across their seam. Both are
  taken apart along the seam, and their merges are followed in the order of scores: at no time may the two symbols at
  the seam form a piece that is due before one of them is joined away from it. Answers are kept by pair.

No piece of a usual model has a space behind another character, or neighbours that no piece holds, so texts fall into
stretches and segments that are encoded by themselves; codes of frequent ones are kept, up to a bound. For a model that
does have such pieces a text is one stretch. Characters that are no piece become their UTF-8 bytes, one byte piece each.

Defined results: null and empty texts have no tokens (the digests are those of the empty string); repeated rows encode
alike; other columns of the input are not looked at. The work on a stretch grows with its length times the length of the
longest piece. The model (some 32,000 pieces whatever the corpus) is read on the driver and broadcast.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import map_rows

#: What a worker keeps: stretches of a text, segments of stretches, pairs of tokens; the older half goes when one is full.
KEPT_STRETCHES, KEPT_SEGMENTS, KEPT_PAIRS = 500_000, 200_000, 400_000
#: Longer strings are not kept.
KEPT_LENGTH = 64
#: How the format writes a space, and its kinds of pieces.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
_BITS = 20
_NEVER = 1 << 60


class Kept(dict):
    """Values by key, made when first asked for."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        got = self.make(key)
        if not isinstance(key, str) or len(key) <= KEPT_LENGTH:
            if len(self) >= self.most:
                for old in [*self][: self.most // 2]:
                    del self[old]
            self[key] = got
        return got


def _inside(chars) -> str:
    """A character class's inside for the characters, as ranges."""
    out, codes = [], sorted(map(ord, chars))
    for k, c in enumerate(codes):
        if not k or codes[k - 1] != c - 1:
            out.append([c, c])
        out[-1][1] = c
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _connected(pieces) -> list[set[str]]:
    """Characters in classes: neighbours in some piece are of one class. Spaces belong to none."""
    up: dict[str, str] = {}

    def top(c: str) -> str:
        while (above := up.setdefault(c, c)) != c:
            up[c] = c = up[above]
        return c

    for piece in pieces:
        held = piece.replace(" ", "")
        for a in held:
            up[top(a)] = top(held[0])
    classes: dict[str, set[str]] = {}
    for c in list(up):
        classes.setdefault(top(c), set()).add(c)
    return list(classes.values())


class PieceCodec:
    """Encoder and decoder of one model: (piece, score, kind) by id, a space written as a space."""

    def __init__(self, pieces: list[tuple[str, float, int]], unknown_surface: str = " ⁇ "):
        self.strings = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        if any(k in (USER_DEFINED, UNUSED) for k in self.kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.unknown_surface = unknown_surface
        self.id_of = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.bytes_of = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.byte_at = {i: b for b, i in self.bytes_of.items()}
        if len(self.bytes_of) != 256:
            raise ValueError("models without byte pieces are not supported")
        levels = sorted({-s for _, s, k in pieces if k == NORMAL})
        #: Due dates of merges: equal scores have the same.
        self.due = {p: bisect_left(levels, -s) for p, s, k in pieces if k == NORMAL}
        if " " not in self.id_of or any(c not in self.id_of for p in self.id_of for c in p):
            raise ValueError("models with pieces of characters that are no pieces, or without the space, are not supported")
        self.length = [len(p) for p in self.strings]
        self.decimal = [str(i) for i in range(len(self.strings))]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.spines: dict[tuple[str, int], tuple[list[str], list[int]]] = {}

        known = {c for p in self.id_of for c in p}
        others = f"[^{_inside(known)}]"
        self.whole = any(" " in p.lstrip(" ") for p in self.id_of)
        if self.whole:
            self.segments = re.compile(f"{others}|[{_inside(known)}]+")
        else:
            classes = sorted(_connected(self.id_of), key=len, reverse=True)
            doubled = {a for p in self.id_of for a, b in zip(p, p[1:], strict=False) if a == b}
            singles = [c for x in classes if len(x) == 1 for c in x - doubled]
            several = [x for x in classes if not x <= {*singles}]
            runs = [f" *[{_inside(x)}]+" for x in several] + ([f" *[{_inside(singles)}]"] if singles else [])
            self.segments = re.compile("|".join([*runs, " +", others]))
        self.stretches = re.compile(" +[^ ]*")
        self.pairs = Kept(self._compatible, KEPT_PAIRS)
        self.coded = Kept(self._segment, KEPT_SEGMENTS)
        self.shown = Kept(self._stretch, KEPT_STRETCHES)

    @classmethod
    def from_bytes(cls, model: bytes) -> PieceCodec:
        """From a model file. Only merge-type models that leave the text as it is, but for a space in front, are read."""
        from sentencepiece import sentencepiece_model_pb2 as format_

        held = format_.ModelProto()
        held.ParseFromString(model)
        norm = held.normalizer_spec
        plain = held.trainer_spec.model_type == 2 and not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if not plain or held.trainer_spec.treat_whitespace_as_suffix or held.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only merge-type models without normalisation, with a space in front, are supported")
        return cls([(p.piece.replace(SPACE, " ") if p.type == NORMAL else p.piece, p.score, p.type) for p in held.pieces], held.trainer_spec.unk_surface)

    # --- how a piece is built

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two symbols of the last merge that builds a piece from its characters; none if the merges build something else."""
        if piece not in self.halves:
            symbols, last = [*piece], None
            while len(symbols) > 1:
                due, k = min((self.due.get(symbols[k] + symbols[k + 1], _NEVER), k) for k in range(len(symbols) - 1))
                if due == _NEVER:
                    last = None
                    break
                last = (symbols[k], symbols[k + 1])
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            self.halves[piece] = last
        return self.halves[piece]

    def spine(self, piece: str, side: int) -> tuple[list[str], list[int]]:
        """The symbols that stood at an end (side 0: the first, 1: the last) while a piece was built, and when each was joined away."""
        if (piece, side) not in self.spines:
            symbols, until = [piece], [_NEVER]
            while len(symbols[-1]) > 1:
                until.append(self.due[symbols[-1]])
                symbols.append(self.split(symbols[-1])[side])
            self.spines[piece, side] = (symbols[::-1], until[::-1])
        return self.spines[piece, side]

    def _compatible(self, pair: int) -> bool:
        """Whether one token can stand before another: nothing is joined across the seam while the merges of both run."""
        before, after = self.strings[pair >> _BITS], self.strings[pair & (1 << _BITS) - 1]
        if len(after) > 1 and self.split(after) is None:
            return False
        (left, left_until), (right, right_until) = self.spine(before, 1), self.spine(after, 0)
        i = j = 0
        due = self.due.get
        while True:
            p, q = left_until[i], right_until[j]
            # of merges that are due together the leftmost comes first: within the left token, across, within the right one
            across = due(left[i] + right[j], _NEVER)
            if across < p and across <= q:
                return False
            if p == q == _NEVER:
                return True
            if p <= q:
                i += 1
            else:
                j += 1

    # --- encoding

    def last_tokens(self, text: str) -> list[int]:
        """The last token of every prefix of a text of known characters."""
        last = [-1] * (len(text) + 1)
        pairs = self.pairs
        for end, (token, n) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                at = end - n
                if pairs[last[at] << _BITS | token] if at else n == 1 or self.split(text[:n]) is not None:
                    last[end] = token
        return last

    def piece_ids(self, text: str) -> list[int]:
        """Ids of a text of known characters, from its end backwards."""
        last, length, out, at = self.last_tokens(text), self.length, [], len(text)
        while at:
            out.append(token := last[at])
            at -= length[token]
        return out[::-1]

    def _segment(self, segment: str) -> tuple[str, str]:
        if len(segment) == 1 and segment not in self.id_of:
            ids = [self.bytes_of[b] for b in segment.encode("utf-8", "replace")]
            return ",".join(map(str, ids)), self.surface(ids)
        # normal pieces spell the segment itself
        return ",".join([self.decimal[i] for i in self.piece_ids(segment)]), segment

    def _stretch(self, stretch: str) -> tuple[str, str]:
        found = self.segments.findall(stretch)
        if len(found) == 1:
            return self.coded[found[0]]
        made = [*map(self.coded.__getitem__, found)]
        shown = "".join([x[1] for x in made])
        return ",".join([x[0] for x in made]), stretch if shown == stretch else shown

    def parts(self, text: str | None) -> list[tuple[str, str]]:
        """(ids, surface) of each stretch of a text."""
        if not text:
            return []
        spaced = " " + text.replace(SPACE, " ")
        return [*map(self.shown.__getitem__, [spaced] if self.whole else self.stretches.findall(spaced))]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _ in self.parts(text) for i in ids.split(",")]

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by a comma, decoded text)."""
        parts = self.parts(text)
        if not parts:
            return 0, "", ""
        ids = ",".join([x[0] for x in parts])
        return ids.count(",") + 1, ids, "".join([x[1] for x in parts])[1:]  # the space that was put in front

    # --- decoding

    def surface(self, ids: list[int]) -> str:
        """The strings of pieces one after another; bytes become the characters that they spell, or replacement characters."""
        out: list[str] = []
        waiting = bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                waiting.append(self.byte_at[i])
                continue
            if waiting:
                out.append(_spelled(bytes(waiting)))
                waiting.clear()
            out.append(self.strings[i] if self.kinds[i] == NORMAL else self.unknown_surface if self.kinds[i] == UNKNOWN else "")
        if waiting:
            out.append(_spelled(bytes(waiting)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; one space at its front goes, as encoding puts one there."""
        first = next((k for k, i in enumerate(ids) if self.kinds[i] != CONTROL), len(ids))
        text = self.surface(ids[first:])
        return text[1:] if first < len(ids) and self.kinds[ids[first]] == NORMAL and text.startswith(" ") else text


def _spelled(data: bytes) -> str:
    """Bytes as UTF-8; each byte that is part of no character becomes a replacement character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            at += n
        return "".join(out)


# --- on Spark

_codecs: dict[str, PieceCodec] = {}


class _Shared:
    """A broadcast model with a stable key, so that a reused worker reads it once."""

    def __init__(self, held, key: str):
        self.held, self.key = held, key

    def codec(self) -> PieceCodec:
        if self.key not in _codecs:
            _codecs.clear()
            _codecs[self.key] = PieceCodec.from_bytes(self.held.value)
        return _codecs[self.key]


def _share(df: DataFrame, path: str) -> _Shared:
    with open(path, "rb") as f:
        model = f.read()
    return _Shared(df.sparkSession.sparkContext.broadcast(model), hashlib.sha256(model).hexdigest())


def _encode_step(columns: list, shared: _Shared) -> list:
    return [columns[0], [shared.codec().encode(t) for t in columns[1]]]


def _decode_step(columns: list, shared: _Shared) -> list:
    return [columns[0], [shared.codec().decode(ids or []) for ids in columns[1]]]


def _digest_step(columns: list, shared: _Shared) -> list:
    codec = shared.codec()
    out: list[list] = [columns[0], [], [], []]
    for t in columns[1]:
        n, ids, decoded = codec.digest(t)
        out[1].append(n)
        out[2].append(hashlib.sha256(ids.encode()).hexdigest())
        out[3].append(hashlib.sha256(decoded.encode()).hexdigest())
    return out


def _rows(df: DataFrame, id_col: str, column: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(column).alias(name))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every text."""
    return map_rows(_rows(df, id_col, text_col, "text"), _encode_step, "doc_id long,ids array<int>", _share(df, path))


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the text of every list of ids."""
    return map_rows(_rows(df, id_col, ids_col, "ids"), _decode_step, "doc_id long,decoded string", _share(df, path))


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) in one narrow pass."""
    return map_rows(_rows(df, id_col, text_col, "text"), _digest_step, "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string", _share(df, path))
