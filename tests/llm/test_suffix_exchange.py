"""Operator 1's exchange: what batches send and what buckets answer, without Spark where none is needed."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import exchange, suffixes

SIZE = 10 << 30
"""Bytes of text in 6 GB of Parquet."""


def batch(seed: int, n: int = 60, copies: int = 1) -> pa.Table:
    draw = random.Random(seed)
    say = lambda k: " ".join(f"{draw.choice(['alpha', 'béta', 'gamma'])}{draw.randrange(1000)}" for _ in range(k))
    shared = "a passage of the licence that a third of all documents hold, word for word and line by line"
    texts = [say(80) + shared + say(80) for _ in range(n)]
    return pa.table({"id": pa.array(range(n * copies), pa.int64()), "text": pa.array(texts * copies), "batch": pa.array([seed] * n * copies, pa.int32())})


def classes(k: int):
    return lambda hashes: np.full(len(hashes), k, np.uint8)


@pytest.fixture(scope="module")
def sizes(spark):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(exchange, "text_bytes", lambda docs, text: SIZE)
        return exchange.Exchange(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "doc_id", "text").sizes


def test_a_batch_sends_few_rows_however_large_the_corpus(sizes):
    """Batches times buckets grow with the square of the corpus: at 6 GB a row must still hold many regions, not one or two."""
    dealt = batch(1, 400)
    assert len(suffixes.regions(*exchange.parts(dealt)[:2], 50)[0]) > 5 * 2**sizes.bucket_bits
    sent = suffixes.send(dealt, classes(1), sizes, 50)
    assert sent.num_rows <= 2**sizes.bucket_bits <= SIZE >> 22
    assert sent.column("bucket").to_pylist() == sorted(set(sent.column("bucket").to_pylist()))


def test_anchors_of_thousands_of_documents_stay_regions(sizes):
    """In a large corpus many passages have thousands of documents. Their strings, sent one by one, are ten times the bytes."""
    size = lambda k: sum(map(len, suffixes.send(batch(1), classes(k), sizes, 50).column("widths").to_pylist()))
    assert size(1) == size(15) < size(16) / 5


def test_answers_whatever_the_shares(sizes, monkeypatch):
    sent = pa.concat_tables([suffixes.send(batch(k % 3), classes(1), sizes, 50) for k in range(4)])
    out = []
    for most in (1, 1 << 12, 1 << 30):
        monkeypatch.setattr(suffixes, "INDEX_BYTES", most)
        out.append(suffixes.answer(sent, 50))
    assert out[0].equals(out[1]) and out[0].equals(out[2])
    assert out[0].column("bucket").equals(sent.column("bucket"))


@pytest.mark.parametrize("rank", [1, 16])
def test_regions_of_copies_are_sent_once(sizes, rank):
    one, many = (suffixes.send(batch(2, 8, n), classes(rank), sizes, 50) for n in (1, 5))
    assert one.column("data").equals(many.column("data")) and one.column("docs").equals(many.column("docs"))


def test_equal_keys_do_not_merge_slices():
    raw = np.frombuffer(b"0123456789abcdef0123456789abcdeX0123456789abcdef", np.uint8)
    words, begin, width = suffixes.words_of(raw), np.array([0, 16, 32, 32]), np.array([16, 16, 16, 15])
    assert suffixes.new_slices(words, begin, width, np.zeros(4, np.uint64)).tolist() == [True, True, True, True]
    assert suffixes.new_slices(words, begin[[0, 2, 1]], width[:3], np.zeros(3, np.uint64)).tolist() == [True, False, True]
    assert suffixes.joined(raw, begin, width).tobytes() == b"".join(raw[a : a + n].tobytes() for a, n in zip(begin, width, strict=True))


def test_a_transform_of_a_text_knows_every_string():
    draw = random.Random(5)
    texts = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(30, 60))) for _ in range(200)]
    size = np.array([len(t) for t in texts])
    docs = np.array([draw.randrange(1000) for _ in texts])
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum(size + 1) - 1
    valid = np.arange(len(text)) + 24 <= np.repeat(ends, size + 1)
    index = suffixes.RunLengthIndex(text, np.repeat(docs, size + 1), valid, 24)
    holders: dict[bytes, int] = {}
    strings = [(t[k : k + 24], d) for t, d in zip(texts, docs.tolist(), strict=True) for k in range(len(t) - 23)]
    for s, d in strings:
        holders[s] = min(d, holders.get(s, d))
    assert index.stream(text, ends - size, size, 24).tolist() == [holders[s] for s, _ in strings]
