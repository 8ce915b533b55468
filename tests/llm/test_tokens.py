import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.llm import tokens

if not Path(tokens.VOCABULARY).exists():
    pytest.skip("no vocabulary", allow_module_level=True)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(texts, tokenizer):
    import regex

    got, words = tokens.load().texts(pa.array(texts, pa.string()))
    assert got.tolist() == [len(tokenizer.encode_ordinary(t or "")) for t in texts]
    assert words.tolist() == [len(regex.findall(PATTERN, t or "")) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aabst'rvel dm \n\t.,!0123é中文 ñ😀THEing", max_size=80), max_size=8))
def test_as_the_tokenizer_counts(tokenizer, texts):
    check(texts, tokenizer)


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=200))
def test_any_characters(tokenizer, text):
    check([text], tokenizer)


def test_long_words_and_texts(tokenizer):
    check(["a" * 700, "ab" * 400, " " * 900 + "x", "xyz" * 20_000, None, "", "\n", "it's we're 'tis x'", "'r", "'l", "日本語" * 300, "the end. " * 30_000], tokenizer)


@pytest.mark.parametrize("letters,size", [("abcdefghijklmnop", 40_000), ("ab", 9_000), ("etaoin", 5_000), ("a", 7_000), ("x", 1_025)])
def test_words_in_chunks(tokenizer, letters, size):
    """Of random letters, whose chunks agree with the ones before, and of runs, whose chunks must be run again from the state before them."""
    import random

    rnd = random.Random(size)
    word = "".join(rnd.choice(letters) for _ in range(size))
    check([word, f"{word[:3000]} {word}{'=' * 3000}{word[:1500]}"], tokenizer)


def test_memory_of_long_words_is_that_of_chunks():
    import random
    import tracemalloc

    rnd = random.Random(2)
    counter = tokens.load()
    peaks = []
    for size in (150_000, 600_000):
        text = pa.array(["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=size))])
        tracemalloc.start()
        counter.texts(text)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 300e6


def test_test_documents(spark, small, tokenizer):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r.n_tokens for r in tokens.op8_token_counts(spark, small).collect()}
    assert got == {i: len(tokenizer.encode_ordinary(t)) for i, t in texts.items()}


def test_scan_of_chunks_is_a_run_through_all():
    to, _ = tokens.splitter()
    kinds = np.random.default_rng(1).integers(0, tokens.CLASSES, (16, 37)).astype(np.uint8)
    state, want = tokens.FRESH, []
    for chunk in kinds.T:
        want.append(state)
        for k in chunk:
            state = to[state, k]
    assert tokens.first_states(kinds, to).tolist() == want


def test_odd_documents(odd, none):
    rows = tokens.token_counts(odd).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert tokens.token_counts(none).isEmpty()
    with pytest.raises(ValueError):
        tokens.Counter({b"a": 0})
