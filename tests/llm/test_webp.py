"""Lossless WebP: round trips over every transform, prefix groups, cache and copies; payloads; the operator."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ODD_TEXTS, documents
from twinweave.llm import webp
from twinweave.llm.webp import CROSS_COLOUR, PALETTE, PREDICTOR, SUBTRACT_GREEN


def picture(rng, h, w, colours=None):
    if colours:
        return rng.integers(0, 2**32, colours).astype(np.uint32)[rng.integers(0, colours, (h, w))]
    c = np.cumsum(rng.integers(0, 3, (h, w, 4)), axis=1).astype(np.uint32) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def chains(rng, h, w):
    cut = lambda n, bits: -(-n >> bits)
    return [
        [],
        [(SUBTRACT_GREEN,)],
        [(PREDICTOR, 2, rng.integers(0, 16, (cut(h, 2), cut(w, 2))))],
        [(CROSS_COLOUR, 3, rng.integers(0, 2**32, (cut(h, 3), cut(w, 3))))],
        [(PREDICTOR, 3, rng.integers(0, 14, (cut(h, 3), cut(w, 3)))), (CROSS_COLOUR, 2, rng.integers(0, 2**32, (cut(h, 2), cut(w, 2)))), (SUBTRACT_GREEN,)],
    ]


@pytest.mark.parametrize("h,w", [(1, 1), (3, 5), (17, 33), (40, 21)])
@pytest.mark.parametrize("colours", [None, 2, 3, 9, 40])
def test_round_trips(h, w, colours):
    rng = np.random.default_rng(h * 100 + w)
    image = picture(rng, h, w, colours)
    for chain in chains(rng, h, w) + ([[(PALETTE,)]] if colours else []):
        for cache, meta in ((0, 0), (1, 0), (6, 0), (11, 2), (0, 2)):
            assert np.array_equal(webp.decode(webp.encode_image(image, chain, cache, meta)), image)


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    rng = np.random.default_rng(mode)
    image = picture(rng, 9, 11)
    assert np.array_equal(webp.decode(webp.encode_image(image, [(PREDICTOR, 2, np.full((3, 3), mode))])), image)


def test_a_stream_written_by_hand():
    """One pixel: no transforms, no cache, one group of five simple codes of one symbol each."""
    bits = [(0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    for symbol in (30, 20, 40, 255):  # green, red, blue, alpha
        bits += [(1, 1), (0, 1), (1, 1), (symbol, 8)]
    bits += [(1, 1), (0, 1), (0, 1), (0, 1)]  # distance
    value = at = 0
    for v, n in bits:
        value |= v << at
        at += n
    body = b"\x2f" + value.to_bytes((at + 7) // 8, "little")
    pad = b"\0" * (len(body) % 2)
    data = b"RIFF" + (12 + len(body) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad
    assert webp.decode(data).tolist() == [[255 << 24 | 20 << 16 | 30 << 8 | 40]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=400) | st.builds(lambda a, n: a * n, st.binary(min_size=1, max_size=70), st.integers(1, 40)), min_size=1, max_size=6))
def test_payloads(raw):
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    payload, at = webp.padded(data, offsets)
    for r, media, lo, hi in zip(raw, webp.encode_payloads(payload, at), at[:-1], at[1:], strict=True):
        gray = (webp.decode(media) >> np.uint32(8)).astype(np.uint8).reshape(-1)[: hi - lo]
        assert gray.tobytes() == r + bytes(hi - lo - len(r)) and (hi - lo) % 64 == 0 and hi > lo


def test_code_lengths_are_complete_and_short():
    rng = np.random.default_rng(2)
    for _ in range(50):
        counts = np.maximum(0, (rng.pareto(0.3, rng.integers(2, 280)) * 5).astype(np.int64) % 10**9)
        lengths = webp.code_lengths(counts)
        used = lengths[lengths > 0]
        assert lengths.max() <= 12 and (len(used) < 2 or (2.0**-used).sum() == 1.0)
        assert set(np.flatnonzero(lengths)) == set(np.flatnonzero(counts))


def test_wide_payload():
    payload = np.random.default_rng(1).integers(0, 200, 64 * 16384 + 64).astype(np.uint8)
    (media,) = webp.encode_payloads(payload, np.array([0, len(payload)]))
    assert np.array_equal((webp.decode(media) >> np.uint32(8)).astype(np.uint8).reshape(-1)[: len(payload)], payload)


@pytest.mark.parametrize("bad", [b"", b"RIFF0000WEBPVP8 ", b"RIFF\0\0\0\0WEBPVP8L\x05\0\0\0\x2f\0\0\0\xff"])
def test_bad_files_are_errors(bad):
    with pytest.raises((ValueError, IndexError)):
        webp.decode(bad)


def test_operator(spark):
    texts = [*ODD_TEXTS, "tab\0 and zero"]
    docs = documents(spark, texts, extra=["media", "n_bytes", "feature"])
    rows = {r["doc_id"]: r for r in webp.read_back(webp.store(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, (len(raw) + 63) // 64 * 64) - len(raw))
        assert rows[i]["n_bytes"] == len(raw) and rows[i]["payload_bytes"] == len(payload)
        assert rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and rows[i]["tail_crc32"] == zlib.crc32(payload[-64:])
    assert rows[7]["media_sha256"] == rows[8]["media_sha256"] and rows[0]["feature"] == rows[1]["feature"]
    assert webp.read_back(webp.store(docs.limit(0))).count() == 0


def test_files_made_elsewhere():
    """The lossless sample that browsers are commonly tested with: one transparent pixel, written by the format's own encoder."""
    sample = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(sample).tolist() == [[0]]
    assert [x.tolist() for x in webp.decode_parts(sample + sample)] == [[[0]], [[0]]]


def test_texts_larger_than_an_image(spark, monkeypatch):
    """With a smaller limit, long texts become several files; what is read back is whole."""
    texts = ["", "short", "x" * 64, "0123456789" * 50, "abc" * 1000]
    payload = [t.encode().ljust(max(64, -(-len(t) // 64) * 64), b"\0") for t in texts]
    data = np.frombuffer(b"".join(payload), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(p) for p in payload])])
    monkeypatch.setattr(webp, "MOST", 256)
    files = webp.encode_parts(data, at)
    for p, f in zip(payload, files, strict=True):
        images = webp.decode_parts(f)
        assert len(images) == -(-len(p) // 256)
        assert b"".join(((x >> np.uint32(8)).astype(np.uint8).reshape(-1)[: len(p) - 256 * k]).tobytes() for k, x in enumerate(images)) == p
