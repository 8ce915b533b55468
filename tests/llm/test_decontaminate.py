import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from moraine.llm import decontaminate as D

RND = random.Random(3)
WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st", "lo")]
COMMON = ["the", "of", "and", "to", "in", "was"]


def prose(n, rnd):
    return [rnd.choice(COMMON) if rnd.random() < 0.4 else rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n)]


def text(words):
    return " ".join(words[: len(words) // 2]).capitalize() + ". " + " ".join(words[len(words) // 2 :]).capitalize() + "."


@pytest.fixture(scope="module")
def case(spark):
    rnd = random.Random(11)
    items = [prose(rnd.randint(15, 60), rnd) for _ in range(40)]
    docs, leaks = [], set()
    for i in range(300):
        body = prose(rnd.randint(5, 400), rnd)
        if i % 3 == 0:
            j = i // 3 % 40
            leak = list(items[j])
            if i % 2:  # a paraphrase: a word in seven is another
                leak = [rnd.choice(WORDS) + "x" if k % 7 == 3 else w for k, w in enumerate(leak)]
            at = rnd.randint(0, len(body))
            body[at:at] = leak
            leaks.add((i, j))
        elif i % 3 == 1:  # a fifth of an item is no leak
            j = i % 40
            body[3:3] = items[j][: len(items[j]) // 5]
        docs.append((i, " ".join(body)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(j, text(w)) for j, w in enumerate(items)], "item_id long, text string"), leaks


def test_leaks_and_only_leaks(case):
    docs, bench, leaks = case
    found = {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()}
    assert len(found & leaks) >= 0.98 * len(leaks)
    assert found <= leaks
    assert {r.doc_id for r in D.decontaminate(docs, bench).collect()} == set(range(300)) - {i for i, _ in found}


def test_test_documents(spark, small):
    """Against all windows of all documents: whoever holds an item word for word is found, no one else."""
    found = {(r.doc_id, r.item_id) for r in D.op1_decontamination(spark, small).collect()}
    words = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    assert found == {(i, j) for i, t in docs.items() for j, b in items.items() if b in t}


def test_items_at_once_change_nothing(case, monkeypatch):
    docs, bench, _ = case
    every = sorted(map(tuple, D.leaks(docs, bench).collect()))
    for n in (1, 7):
        monkeypatch.setattr(D, "_ITEMS_AT_ONCE", n)
        assert sorted(map(tuple, D.leaks(docs, bench).collect())) == every


def brute_leaks(docs, items):
    """The rule by itself: every window of every item's length in every document, without retrieval; words weighted as in the operator's judgement."""
    found = set()
    for i, body in docs:
        for j, item in items:
            m = len(item)
            for at in range(0, max(1, len(body) - m + 1), 2):
                window = body[max(0, at - m // 2) : at + m + m // 2]
                if D.lcs([w for w in window if w in set(item)], item) >= D.EXACT * m:
                    found.add((i, j))
                    break
    return found


def test_as_brute_force_finds_them(spark):
    """Whatever holds enough of an item's words in order is found, wherever it lies, and nothing much less."""
    rnd = random.Random(23)
    items = [(j, prose(rnd.randint(10, 70), rnd)) for j in range(25)]
    docs = []
    for i in range(160):
        body = prose(rnd.randint(0, 300), rnd)
        for _ in range(rnd.choice([0, 1, 2])):
            _, item = rnd.choice(items)
            p = rnd.choice([0.0, 0.1, 0.2, 0.3])
            at = rnd.randint(0, len(body))
            body[at:at] = [rnd.choice(WORDS) + "q" if rnd.random() < p else w for w in item]
        docs.append((i, body))
    want = brute_leaks(docs, items)
    rows = D.leaks(spark.createDataFrame([(i, " ".join(b)) for i, b in docs], "doc_id long, text string"), spark.createDataFrame([(j, text(w)) for j, w in items], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(want) > 80 and len(want & got) >= 0.98 * len(want)
    assert all(r.share >= D.PARAPHRASE for r in rows) and len(got - want) <= 0.1 * len(want)


def test_far_apart_words(spark):
    """Gaps beyond 16 bits keep their length, and memory follows the words that are known."""
    import tracemalloc

    item = " ".join(WORDS[:20])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    hole = " ".join("zzz" for _ in range(70_000))
    rows = [(1, f"{item} {hole} {item}"), (2, " ".join(WORDS[:10]) + f" {hole} " + " ".join(WORDS[10:20])), (3, f"{hole} {item}")]
    assert {r.doc_id for r in D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()} == {1, 3}
    items = D.Items([1, 2], [item, " ".join(WORDS[20:60] * 20)])
    words = np.tile(np.arange(20), 2_000).astype(items.kind)
    gaps = np.full(len(words), 500, np.uint16)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2_000)), *(pa.array([x[k : k + 20].tobytes() for k in range(0, len(x), 20)], pa.binary()) for x in (words, gaps))], names=["doc_id", "words", "gaps"])
    vectors = np.random.default_rng(0).standard_normal((len(items.vocabulary), D.RANK))
    tracemalloc.start()
    list(D._search(items, np.ones(len(items.vocabulary)), vectors, 0.99)([batch]))
    assert tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()


def test_odd_documents(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (None, "a b c"), (2, ""), (3, "?!"), (4, "One"), (4, "One"), (5, odd.where("doc_id = 2").first().text)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(odd, bench).collect()} == {(9, 4), (1, 5), (2, 5)}
    assert D.leaks(none, bench).isEmpty() and D.leaks(odd, bench.where("false")).isEmpty()
    out = D.decontaminate(odd, bench)
    assert out.columns == odd.columns and out.count() == odd.count() - 5


def test_vectors_are_those_of_a_full_decomposition(spark, case):
    """The sketch's leading space holds as much of the Gram matrix as the exact one, up to a tenth."""
    docs, bench, _ = case
    rows = bench.collect()
    items = D.Items([r.item_id for r in rows], [r.text for r in rows])
    reduced = docs.select("doc_id", "text").mapInArrow(D._reduce(items), "doc_id long, words binary, gaps binary")
    idf, vectors = D._svd(reduced, items, 30, 1)
    size, x = len(items.vocabulary), []
    for batch in reduced.toArrow().to_batches():
        for _, number, place, offs in D._groups(batch, items.kind):
            passage = np.unique(D._cells(place, offs, D.PASSAGE), return_inverse=True)[1]
            m = np.zeros((passage.max() + 1, size))
            np.add.at(m, (passage, number), idf[number])
            x.append(m / np.linalg.norm(m, axis=1, keepdims=True))
    own = np.zeros((len(rows), size))
    for i, w in enumerate(items.words):
        np.add.at(own[i], w, idf[w])
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    a = np.concatenate(x)
    g = a.T @ a / len(a) + own.T @ own / len(own)
    best = np.linalg.eigvalsh(g)[::-1][:30].sum()
    assert np.allclose(vectors.T @ vectors, np.eye(30), atol=1e-6) and np.trace(vectors.T @ g @ vectors) > 0.85 * best


@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=90))
def test_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert D.lcs(a, b) == table[-1][-1]


@given(st.lists(st.integers(1, 20), min_size=1, max_size=12))
def test_segment_sums(lens):
    rng = np.random.default_rng(0)
    table = np.vstack([rng.random((9, 3)), np.zeros((1, 3))]).astype(np.float32)
    index = rng.integers(0, 9, sum(lens))
    cuts = np.cumsum([0, *lens[:-1]])
    assert np.allclose(D.segment_sums(table, index, cuts), np.add.reduceat(table[index], cuts, axis=0), atol=1e-5)
