import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.llm import components, jaccard

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def brute(rows, n, threshold):
    """(doc, least document of its group) by comparing all pairs."""
    sets = defaultdict(set)
    for i, text in rows:
        words = WORD.findall((text or "").lower().encode())
        if i is not None and words:
            sets[i] |= {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {(i, top(i)) for i in sets if top(i) != i}


def found(spark, rows, n=5, threshold=0.4):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {tuple(r) for r in jaccard.near_copies(df, threshold, n).collect()}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randint(0, 30))
    passage = [word() for _ in range(60)]
    rows, ids = [], iter(rnd.sample(range(10_000), 1000))
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([1, 3, 6, 40, 150]))]
        if rnd.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rnd.choice([1, 1, 2, 5, 9])):
            p = rnd.choice([0, 0.03, 0.08, 0.15])
            rows.append((next(ids), " ".join(word() if rnd.random() < p else w for w in base)))
    return rows


@pytest.mark.parametrize("seed,threshold", [(1, 0.4), (2, 0.4), (3, 0.7), (4, 1.0), (5, 0.25)])
def test_all_groups_of_brute_force(spark, seed, threshold):
    rows = corpus(seed)
    assert found(spark, rows, 5, threshold) == brute(rows, 5, threshold)


@pytest.mark.parametrize("block", [1, 3, 50])
def test_blocks_in_parts(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(6)
    assert found(spark, rows) == brute(rows, 5, 0.4)


def test_test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {tuple(r) for r in jaccard.op10_ngram_jaccard(spark, small).collect()}
    assert got == brute(docs.select("doc_id", "text").collect(), jaccard.N, jaccard.THRESHOLD)


def brute_pairs(rows, n, threshold):
    sets = defaultdict(set)
    for i, text in rows:
        words = WORD.findall((text or "").lower().encode())
        if i is not None and words:
            sets[i] |= {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}
    index = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    return {pair: x for pair, x in index.items() if x >= threshold - 1e-9}


def pairs_of(frame):
    rows = frame.collect()
    assert len({(r.doc_a, r.doc_b) for r in rows}) == len(rows)
    return {(r.doc_a, r.doc_b): pytest.approx(r.jaccard) for r in rows}


@pytest.mark.parametrize("seed,threshold,block", [(1, 0.4, 10_000), (4, 1.0, 10_000), (5, 0.25, 10_000), (6, 0.4, 1), (7, 0.4, 3)])
def test_all_pairs_of_brute_force(spark, monkeypatch, seed, threshold, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(seed)
    rows += [(20_000 + i, text) for i, (_, text) in enumerate(rows[:20])]
    got = pairs_of(jaccard.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), threshold, 5))
    assert got == brute_pairs(rows, 5, threshold)


def test_pairs_of_test_documents(spark, odd, none, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert pairs_of(jaccard.near_pairs(docs)) == brute_pairs(docs.select("doc_id", "text").collect(), jaccard.N, jaccard.THRESHOLD)
    assert pairs_of(jaccard.near_pairs(odd)) == {(1, 2): 1.0} and jaccard.near_pairs(none).isEmpty()


def brute_classes(rows, n, threshold):
    links = Counter(i for pair in brute_pairs(rows, n, threshold) for i in pair)
    group = dict(brute(rows, n, threshold))
    return sorted((i, group.get(i, i), links[i]) for i in {i for i, _ in rows if i is not None})


def test_registered_classes(spark, odd, none, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = jaccard.QUERIES["op10_ngram_jaccard"](spark, small)
    assert got.columns == ["doc_id", "class_id", "links"] and sorted(map(tuple, got.collect())) == brute_classes(docs, jaccard.N, jaccard.THRESHOLD)
    assert sorted(map(tuple, jaccard.near_classes(odd).collect())) == [(1, 1, 1), (2, 1, 1), *((i, i, 0) for i in range(3, 11))]
    assert jaccard.near_classes(none).isEmpty()


@pytest.mark.parametrize("seed,threshold,block", [(1, 0.4, 10_000), (4, 1.0, 10_000), (5, 0.25, 3), (6, 0.4, 1)])
def test_all_links_of_brute_force(spark, monkeypatch, seed, threshold, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(seed)
    rows += [(20_000 + i, text) for i, (_, text) in enumerate(rows[:20])]
    got = jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), threshold, 5)
    assert sorted(map(tuple, got.collect())) == brute_classes(rows, 5, threshold)


def test_large_classes_are_a_row_a_document(spark):
    """Two texts, each with 1,500 near copies in two copies: nine million pairs, 6,000 rows."""
    rnd = random.Random(9)
    rows = []
    for k in range(2):
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(100)]
        for i in range(1500):
            text = list(base)
            text[rnd.randrange(100)] = f"z{i}"
            rows += [(4 * i + 2 * k, " ".join(text)), (4 * i + 2 * k + 1, " ".join(text))]
    got = jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.class_id, r.links) for r in got) == {(0, 2999): 3000, (2, 2999): 3000}


@pytest.mark.parametrize("heavy,cells,columns", [(64, 2_000_000, 1024), (0, 40, 3), (2, 7, 1), (4, 200, 1024)])
@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_matches_of_lists_and_matrices(monkeypatch, heavy, cells, columns, threshold):
    for name, value in (("_HEAVY", heavy), ("_CELLS", cells), ("_COLUMNS", columns)):
        monkeypatch.setattr(jaccard, name, value)
    for seed in range(30):
        rnd = random.Random(seed)
        bases = [rnd.sample(range(400), rnd.choice([3, 20, 40])) for _ in range(4)]
        sets = [{x if rnd.random() < 0.9 else rnd.randrange(400) for x in rnd.choice(bases)} for _ in range(rnd.choice([1, 5, 40]))]
        member = np.array([rnd.random() < 0.7 for _ in sets])
        asks = np.ones(len(sets), dtype=bool) if seed % 3 else ~member
        sizes = np.array([len(s) + rnd.choice([0, 0, 3]) for s in sets])
        want = {}
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(a & b)
                if asks[i] and member[j] and (i < j or not member[i]) and i != j and both and both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9:
                    want[i, j] = both
        got = [x for part in jaccard._matches(sizes, [np.array(sorted(s), dtype=np.uint64) for s in sets], member, asks, threshold) for x in zip(*(y.tolist() for y in part), strict=True)]
        assert len(got) == len(want) and {(i, j): n for i, j, n in got} == want


def test_many_copies_of_one_text(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
    rows = [(i, " ".join(f"z{rnd.randint(0, 99)}" if rnd.random() < 0.02 else w for w in base)) for i in range(700)]
    assert found(spark, rows) == {(i, 0) for i in range(1, 700)}


@pytest.mark.parametrize("seed", [0, 1])
def test_rows_that_repeat_an_id(spark, seed):
    """A document is all its rows, in whatever order they come."""
    rnd = random.Random(seed)
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    rows = [(1, words(0, 60)), (1, words(100, 120)), (2, words(100, 120))] + corpus(8)
    rows += [(i, other) for (i, _), (_, other) in zip(rows[3:60:4], rows[10:60:3], strict=False)] + rows[5:9]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + seed * 4)
    assert pairs_of(jaccard.near_pairs(df)) == brute_pairs(rows, 5, 0.4)
    kept = jaccard.keep_one(df).collect()
    least = {i: min(t for j, t in rows if j == i) for i, _ in rows}
    gone = {i for i, _ in brute(rows, 5, 0.4)}
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((i, t) for i, t in least.items() if i not in gone)


def test_a_long_chain_is_no_block(spark, tmp_path):
    """Documents that each share half with the next, and match none: what a task is sent follows the documents, not the chain."""
    m = 50_000
    text = lambda k: " ".join(f"c{k}x{j}" for j in range(20))
    docs = spark.range(m).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 39), j -> concat('c', id + j div 20, 'x', j % 20))) as text")
    assert docs.where("doc_id = 3").first().text == f"{text(3)} {text(4)}"
    inside, copies = jaccard._blocks(docs, 0.4, 5, f"file://{tmp_path}")
    parts = inside.groupBy("part", "sub", "chunk").count().agg({"count": "max"}).first()[0]
    assert m <= inside.count() <= 2 * m and parts <= jaccard.BLOCK and copies.isEmpty()
    assert jaccard.near_pairs(docs).isEmpty()


def test_odd_documents(spark, odd, none):
    assert {tuple(r) for r in jaccard.near_copies(odd).collect()} == {(2, 1)}
    out = jaccard.keep_one(odd)
    assert out.columns == odd.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 3, 4, 5, None, None, 6, 7, 8, 9, 10])
    assert jaccard.near_copies(none).isEmpty() and jaccard.keep_one(none).isEmpty()
    with pytest.raises(ValueError):
        jaccard.near_copies(odd, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=25), st.sets(st.integers(0, 45), min_size=1), st.integers(1, 12))
def test_t_occurrence_search(sets, query, need):
    grams = np.array([g for s in sets for g in sorted(s)], dtype=np.uint64)
    owner = np.array([i for i, s in enumerate(sets) for _ in s])
    ids, counts = jaccard.Lists(grams, owner).search(np.array(sorted(query), dtype=np.uint64), need)
    assert dict(zip(ids.tolist(), counts.tolist(), strict=True)) == {i: len(s & query) for i, s in enumerate(sets) if len(s & query) >= need}


@pytest.mark.parametrize("n", [0, 1, 40])
def test_components(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(100, 99), (99, 98), (7, 7)] * (n > 0)
    got = {tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == ({(i, 0) for i in range(1, n + 1)} | {(99, 98), (100, 98)} if n else set())
