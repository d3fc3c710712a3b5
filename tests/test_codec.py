"""Binary forms: exact round trips, limits, and refusals."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.operators import codec


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=40))
def test_varints(values):
    data = codec.varints(np.array(values, np.uint64))
    assert codec.from_varints(data).tolist() == values
    if values:
        with pytest.raises(ValueError):
            codec.from_varints(data[:-1] + bytes([data[-1] | 0x80]))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 10**12), max_size=130), st.data())
def test_blocks(ids, data):
    ids = np.array(sorted(ids), np.int64)
    freqs = np.array(data.draw(st.lists(st.integers(1, 10**6), min_size=len(ids), max_size=len(ids))), np.int64)
    base = data.draw(st.integers(0, int(ids[0]))) if len(ids) else 0
    back = codec.decode_block(codec.encode_block(ids, freqs, base), len(ids), base)
    assert back[0].tolist() == ids.tolist() and back[1].tolist() == freqs.tolist()


@pytest.mark.parametrize("width", range(18))
def test_widths(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 128):
        values = rng.integers(0, 1 << width, n) if width else np.zeros(n, np.int64)
        data = codec.pack(values, width)
        assert len(data) == codec.packed_size(n, width) if width and n else data == b""
        assert codec.unpack(data, n, width).tolist() == values.tolist()


def test_refusals():
    for bad in ([3, 3], [5, 4]):
        with pytest.raises(ValueError):
            codec.encode_block(np.array(bad), np.array([1, 1]), 0)
    with pytest.raises(ValueError):
        codec.encode_block(np.array([1]), np.array([0]), 0)


@settings(max_examples=200, deadline=None)
@given(st.floats(1e-30, 1e30))
def test_float_up(x):
    up = codec.float_up(x)
    assert up >= x and np.float32(up) == up and up <= x * (1 + 2e-7)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abéж日", max_size=8), max_size=20))
def test_words(words):
    words = sorted(words)
    assert codec.decode_words(codec.encode_words(words)) == words


@pytest.mark.parametrize("n", [0, 1, 50, 51, 52, 1024])
def test_sets(n):
    places = np.sort(np.random.default_rng(n).choice(1024, n, replace=False))
    kind, data = codec.encode_set(places, 1024)
    assert kind == ("dense" if n >= 0.05 * 1024 else "sparse")
    assert codec.decode_set(kind, data).tolist() == places.tolist()


def test_frames(spark):
    rows = [("b", i * 7, 1 + i % 3) for i in range(300)] + [("a", 5, 2)]
    posts = spark.createDataFrame(rows, "term string, doc_id bigint, tf bigint")
    blocks = codec.encoded_postings(posts, 128)
    assert sorted((r.term, r.block, r["count"]) for r in blocks.collect()) == [("a", 0, 1), ("b", 0, 128), ("b", 1, 128), ("b", 2, 44)]
    assert sorted(map(tuple, codec.decoded_postings(blocks).collect())) == sorted(rows)
    assert codec.encoded_postings(posts.limit(0)).count() == 0
    ids = spark.createDataFrame([(3,), (3,), (70_000,), (None,)], "doc_id bigint")
    assert sorted(r[0] for r in codec.decoded_ids(codec.encoded_ids(ids)).collect()) == [3, 70_000]
