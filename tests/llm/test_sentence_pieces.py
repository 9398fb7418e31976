"""SentencePiece codec: equal to the library in ids and text, compatibility against plain merging, other models, long and odd texts."""

import hashlib
import random
import time

import pytest
import sentencepiece

from tests.llm.helpers import ODD_TEXTS, documents
from twinweave.llm import sentence_pieces
from twinweave.llm.queries import PIECE_MODEL
from twinweave.llm.sentence_pieces import BYTE, CONTROL, NORMAL, UNKNOWN, PieceCodec

MIXED = [" ", "  ", "▁", "the ", " th", "in", "ing", "12", "3", ".", ",", "((", "\n", "\t", "é", "漢", "字", "İ", "😀", "\x00", "==", "Ñ", "пр", "　", "\xa0", "<s>", "<0x0A>", "<unk>", "⁇"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(PIECE_MODEL, "rb") as f:
        return PieceCodec.from_bytes(f.read())


def same(codec, library, text):
    ids = library.encode(text)
    assert codec.encode(text) == ids, text
    assert codec.digest(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids)), text
    assert codec.decode(ids) == library.decode(ids)


def test_equal_to_the_library(codec, library):
    rng = random.Random(2)
    pieces = list(codec.id_of)
    for k in range(12000):
        parts = (MIXED, pieces, "abcdefghilmnoprstuéè ")[k % 3]
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))
        same(codec, library, text if k % 5 else text.replace(" ", ""))


def test_runs_of_spaces(codec, library):
    for k in range(80):
        for text in (" " * k, "a" + " " * k + "b", " " * k + "\n" + "▁" * k, "the" + " " * k):
            same(codec, library, text)


def test_decoding_any_ids(codec, library):
    rng = random.Random(3)
    hard = [*range(0, 3), *(3 + b for b in (0xE6, 0xBC, 0xA2, 0xF0, 0x9F, 0x98, 0x80, 0xC3, 0xED, 0xA0, 0xFF)), 259, 28705]
    for _ in range(8000):
        ids = [rng.choice((rng.randrange(32000), rng.choice(hard))) for _ in range(rng.randint(0, 9))]
        assert codec.decode(ids) == library.decode(ids), ids


def merged(codec, text):
    """Plain rounds: the neighbours with the earliest due date are joined, the leftmost of equals."""
    symbols = [*text]
    while len(symbols) > 1:
        due, k = min((codec.due.get(symbols[k] + symbols[k + 1], 1 << 60), k) for k in range(len(symbols) - 1))
        if due == 1 << 60:
            break
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
    return [codec.id_of[s] for s in symbols]


def test_compatible_pairs_are_those_that_merging_leaves(codec):
    rng = random.Random(4)
    ids = [i for i, n in enumerate(codec.length) if codec.kinds[i] == NORMAL]
    short = [i for i in ids if codec.length[i] < 4]
    spaces = [i for i in ids if not codec.strings[i].strip(" ")]
    found = 0
    for k in range(20000):
        a, b = rng.choice((ids, short, spaces)[k % 3]), rng.choice((short, ids, spaces)[k % 3])
        want = merged(codec, codec.strings[a] + codec.strings[b]) == [a, b]
        assert codec.pairs[a << 20 | b] == want, (codec.strings[a], codec.strings[b])
        found += want
    assert 1000 < found < 19000


def tiny(*pieces, kinds=()):
    """A model of the given (piece, score), all single characters and all bytes."""
    head = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), *((f"<0x{b:02X}>", 0.0, BYTE) for b in range(256))]
    chars = sorted({" "} | {c for p, _ in pieces for c in p})
    return PieceCodec(head + [(p, s, NORMAL) for p, s in pieces] + [(c, -1000.0 - k, NORMAL) for k, c in enumerate(chars)])


def test_other_models_against_plain_merging():
    """Equal scores, pieces that their own merges never build, and pieces with a space inside, which makes a text one stretch."""
    rng = random.Random(5)
    models = [
        tiny(("ab", -1), ("bc", -2), ("abc", -3), ("aa", -4), ("aaaa", -5)),
        tiny(("aa", -1), ("aaa", -1), ("aaaaa", -1), ("ba", -1), ("ab", -1)),
        tiny(("bc", -1), ("abc", -2), ("ab", -3), (" a", -4), ("c a", -5), ("xyz", -6)),
    ]
    assert [m.whole for m in models] == [False, False, True]
    assert models[2].split("xyz") is None
    for m in models:
        known = sorted({c for p in m.id_of for c in p})
        for _ in range(4000):
            text = "".join(rng.choice(known) for _ in range(rng.randint(1, 14)))
            assert m.encode(text) == merged(m, " " + text), text


def test_models_that_are_not_read():
    head = [("<unk>", 0.0, UNKNOWN), *((f"<0x{b:02X}>", 0.0, BYTE) for b in range(256))]
    for bad in ([("a", 0.0, sentence_pieces.USER_DEFINED)], [("ab", 0.0, NORMAL), (" ", 0.0, NORMAL)], [("a", 0.0, NORMAL)]):
        with pytest.raises(ValueError, match="not supported"):
            PieceCodec(head + bad)
    with pytest.raises(ValueError, match="byte"):
        PieceCodec([("<unk>", 0.0, UNKNOWN), ("a", 0.0, NORMAL)])


def test_long_stretches_take_time_in_proportion(codec, library):
    for part in ("ab", "=", " ", "the", "漢", "x1", "😀"):
        text = part * (100_000 // len(part))
        same(codec, library, text)
    began = time.process_time()
    codec.encode("abcdefgh" * 40_000)
    once = time.process_time() - began
    began = time.process_time()
    codec.encode("abcdefgi" * 160_000)
    assert time.process_time() - began < 12 * once + 1


def test_what_is_kept_is_bounded():
    kept = sentence_pieces.Kept(lambda k: k, 10)
    assert [kept[str(i)] for i in range(100)] == [str(i) for i in range(100)] and len(kept) <= 10
    assert kept["y" * 100] == "y" * 100 and "y" * 100 not in kept


def test_operator_on_odd_rows(spark, library):
    frame = documents(spark, ODD_TEXTS, extra=["ids", "n_tokens"])
    rows = {r["doc_id"]: r for r in sentence_pieces.digests(frame, PIECE_MODEL).collect()}
    for i, text in enumerate(ODD_TEXTS):
        ids = library.encode(text or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    coded = sentence_pieces.encode(frame, PIECE_MODEL)
    back = {r["doc_id"]: r["decoded"] for r in sentence_pieces.decode(coded, PIECE_MODEL).collect()}
    assert back == {i: (t or "") for i, t in enumerate(ODD_TEXTS)}
    assert sentence_pieces.digests(frame.limit(0), PIECE_MODEL).count() == 0
    assert sentence_pieces.decode(coded.selectExpr("doc_id", "cast(null as array<int>) ids").limit(1), PIECE_MODEL).first()["decoded"] == ""


def test_frequent_words_are_coded_once_and_spell_themselves(library, monkeypatch):
    """200,000 words come twice: the second time none is coded again; the text of pieces of known characters is not put together again."""
    with open(PIECE_MODEL, "rb") as f:
        own = PieceCodec.from_bytes(f.read())
    text = " ".join(f"{a}{b}{c}" for a in ("the", "in", "of", "er") for b in map(str, range(500)) for c in map(str, range(1000, 1100)))
    monkeypatch.setattr(own, "surface", None)
    first = own.digest(text)
    monkeypatch.setattr(own.shown, "make", None)
    assert own.digest(text) == first
    ids = library.encode(text)
    assert first == (len(ids), ",".join(map(str, ids)), text)
