import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import bpe

PATH, PATTERN = bpe.default_tokenizer()


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def ids(text):
    import numpy as np

    return np.frombuffer(bpe.encoder(PATH, PATTERN).encode(text), "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_equals_library(text):
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.encoder(PATH, PATTERN).ranks, special_tokens={})
    assert ids(text) == known.encode_ordinary(text)
    assert bpe.encoder(PATH, PATTERN).decode(bpe.encoder(PATH, PATTERN).encode(text)) == text.encode()


def test_long_pre_tokens(known):
    rng = random.Random(1)
    for text in ("a" * 5000, "ab" * 3000, "".join(rng.choice("abcdeé") for _ in range(8000)), " " * 3000 + "x", "=" * 999, "的" * 2000, ""):
        assert ids(text) == known.encode_ordinary(text)


def test_queue_order():
    q = bpe.RankQueue(60000)
    for r in (50000, 3, 64, 4096, 3, 0):
        q.push(r, r)
    assert [q.pop()[0] for _ in range(5)] == [0, 3, 64, 4096, 50000]
    assert not q.top


def test_lower_rank_after_merge():
    """A vocabulary whose merges form pairs of lower rank than their own."""
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"ab": 5, b"abc": 1, b"bc": 4, b"cab": 3}
    e = bpe.Encoder(ranks, r"\w+")
    known = tiktoken.Encoding("t", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        import numpy as np

        assert np.frombuffer(e.encode(text), "<u4").tolist() == known.encode_ordinary(text), text


def test_frame(spark, known):
    import hashlib
    import struct

    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello  world's\n\nend 123", "z"), (3, "Hello  world's\n\nend 123", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(tuple(r) for r in bpe.report(df).collect())
    want = []
    for d, t, _ in rows:
        i = known.encode_ordinary(t or "")
        want.append((d, len(i), hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.report(df.limit(0)).count() == 0
