import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from moraine.llm import kneser_ney as K
from moraine.llm import langid

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def brute(texts):
    """A function that gives a text's log probability under the bigram model of the texts."""
    seq = lambda t: ["<s>", *WORD.findall(t.lower().encode()), "</s>"]
    pairs = Counter(p for t in texts if WORD.search(t.encode()) for p in zip(seq(t), seq(t)[1:], strict=False))
    total, kinds, cont = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (u, w), c in pairs.items():
        total[u] += c
        kinds[u][min(c, 3) - 1] += 1
        cont[w] += 1

    def discount(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        return K.discounts(n)

    d2, d1, all_ = discount(pairs.values()), discount(cont.values()), sum(cont.values())
    free = sum(d1[min(c, 3)] for c in cont.values()) / all_ / (len(cont) + 1)
    one = lambda w: max(cont[w] - d1[min(cont[w], 3)], 0) / all_ + free

    def two(u, w):
        if not total[u]:
            return one(w)
        return max(pairs[u, w] - d2[min(pairs[u, w], 3)], 0) / total[u] + sum(a * b for a, b in zip(kinds[u], d2[1:], strict=True)) / total[u] * one(w)

    vocabulary = [*cont, "never seen"]
    return lambda t: sum(math.log(two(u, w)) for u, w in zip(seq(t), seq(t)[1:], strict=False)), lambda u: sum(two(u, w) for w in vocabulary)


def test_as_counted_by_hand(spark, small):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    log_prob, mass = brute(texts.values())
    assert all(math.isclose(mass(u), 1, rel_tol=1e-9) for u in ("<s>", b"the", b"and"))
    for r in K.op2_lm_scoring(spark, small).collect():
        assert math.isclose(r.log_prob, log_prob(texts[r.doc_id]), rel_tol=1e-9)
        assert math.isclose(r.perplexity, math.exp(-r.log_prob / r.n_tokens))


def test_texts_that_the_model_has_not_seen(spark):
    texts = ["a b c a b", "a b d", "c a b a"]
    model = K.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    log_prob, _ = brute(texts)
    new = spark.createDataFrame([(1, "b zebra a"), (2, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in K.score(new, model).collect()}
    assert math.isclose(got[1].log_prob, log_prob("b zebra a")) and math.isclose(got[2].log_prob, log_prob("a b c")) and got[1].perplexity > got[2].perplexity


def test_odd_documents_of_the_language_model(spark, odd, none):
    model = K.train(odd)
    rows = K.score(odd, model).collect()
    assert len(rows) == odd.count()
    assert all((r.perplexity is None) == (r.doc_id in (3, 4, 5, 8) or r.n_tokens == 0) and r.log_prob <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id == 9} == {2} and [r.n_tokens for r in rows if r.doc_id == 6] == [120_001]
    assert K.score(none, model).isEmpty()
    empty = K.score(odd, K.train(none)).collect()
    assert all(r.log_prob == 0 for r in empty)


def brute_of_order(texts, order):
    """As `brute`, for any order: plain counts for n-grams of that order and those that begin a text, else the number of words before."""
    seq = lambda t: ["<s>", *WORD.findall(t.lower().encode()), "</s>"]
    plain = [Counter() for _ in range(order + 1)]
    for s in (seq(t) for t in texts if WORD.search(t.encode())):
        for k in range(1, order + 1):
            plain[k].update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
    counts = [None, *(Counter() for _ in range(order))]
    for k in range(1, order + 1):
        if k < order:
            counts[k].update(g[1:] for g in plain[k + 1])
        counts[k].update({g: c for g, c in plain[k].items() if k == order or k > 1 and g[0] == "<s>"})
    d = [None, *(K.discounts([sum(c == j for c in level.values()) for j in (1, 2, 3, 4)]) for level in counts[1:])]
    by = [defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            by[k][g[:-1]].append(c)

    total = [{g: (sum(own), sum(d[k][min(c, 3)] for c in own)) for g, own in level.items()} for k, level in enumerate(by)]

    def p(context, w):
        k = len(context) + 1
        lower = 1 / (len(counts[1]) + 1) if k == 1 else p(context[1:], w)
        if context not in total[k]:
            return lower
        c, (all_, free) = counts[k][*context, w], total[k][context]
        return (max(c - d[k][min(c, 3)], 0) + free * lower) / all_

    def log_prob(t):
        s = seq(t)
        return sum(math.log(p(tuple(s[max(0, i - order + 1) : i]), s[i])) for i in range(1, len(s)))

    return log_prob


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders_as_counted_by_hand(spark, small, order):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id % 2 = 0")
    texts = dict(docs.select("doc_id", "text").collect()) | {-1: "b zebra a", -2: "the"}
    log_prob = brute_of_order([t for i, t in texts.items() if i >= 0], order)
    model = K.train(docs, order)
    new = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in K.score(new, model).collect():
        assert math.isclose(r.log_prob, log_prob(texts[r.doc_id]) if r.n_tokens else 0, rel_tol=1e-9)


def test_registered_order_sees_more_than_pairs(spark, odd, none, small):
    assert K.QUERIES["op2_lm_scoring"].keywords["order"] >= 3
    model = K.train(spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "d b e"] * 5)], "doc_id long, text string"), K.ORDER)
    rows = {r.doc_id: r for r in K.score(spark.createDataFrame([(1, "a b c"), (2, "a b e")], "doc_id long, text string"), model).collect()}
    assert rows[1].perplexity < rows[2].perplexity
    rows = K.score(odd, K.train(odd, K.ORDER)).collect()
    assert len(rows) == odd.count() and all(r.log_prob <= 0 for r in rows)
    assert all(r.log_prob == 0 for r in K.score(odd, K.train(none, K.ORDER)).collect())


@pytest.mark.parametrize("n", [(0, 0, 0, 0), (5, 0, 0, 0), (0, 3, 1, 0), (100, 40, 20, 11)])
def test_discounts_stay_within_counts(n):
    d = K.discounts(n)
    assert d[0] == 0 and all(0 <= d[k] < k for k in (1, 2, 3))


def test_languages_held_out(spark, small):
    """Half of the documents train, the other half is told at 99 % or better."""
    folder = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("n_chars > 40")
    filters = langid.train(docs.where("doc_id % 2 = 0"))
    rows = langid.identify(docs.where("doc_id % 2 = 1"), filters).collect()
    assert sum(r.lang == r.predicted for r in rows) >= 0.99 * len(rows)


def test_filters_hold_what_was_put_in():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**32, 3000, dtype=np.uint64).astype(np.uint32) for _ in range(9)]
    filters = langid.Filters([f"l{i}" for i in range(9)], sets)
    assert filters.masks.dtype == np.uint16
    for i, s in enumerate(sets):
        assert ((filters.languages_of(s) >> i) & 1).all()
    other = rng.integers(0, 2**32, 50_000, dtype=np.uint64).astype(np.uint32)
    share = filters.shares(other, np.array([0, len(other)]))[0]
    rate = [((filters.languages_of(other) >> i) & 1).mean() for i in range(9)]
    assert np.allclose(rate, filters.false, atol=0.01) and (share < 0.01).all()  # false positives are as the fill says, and taken off


def test_odd_documents_of_languages(spark, odd, none, small):
    filters = langid.train(spark.read.parquet(f"{small}/documents.parquet"))
    rows = langid.identify(odd, filters).collect()
    assert len(rows) == odd.count()
    assert {r.predicted for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    assert langid.identify(none, filters).isEmpty()
    assert {r.predicted for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.Filters([str(i) for i in range(65)], [])


def test_more_than_64_languages(spark):
    """Each of 150 languages has letters of its own; the labels of all are found."""
    word = lambda i: chr(0x4E00 + 7 * i) + chr(0x4E01 + 7 * i) + chr(0x4E02 + 7 * i)
    rows = [(1000 * i + k, f"{word(i)} {word(i)}{word(i)} " * 5, f"l{i}") for i in range(150) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.train(docs)
    assert len(filters.languages) == 150 and filters.masks.shape[0] == 3
    found = langid.identify(docs, filters).collect()
    assert len(found) == len(rows) and all(r.lang == r.predicted for r in found)


@pytest.mark.parametrize("languages", [3, 70])
def test_languages_as_exact_sets_have_them(spark, languages):
    """Against sets of n-grams: whatever a set holds the filter holds, and what it holds besides is as much as the fill says; decisions agree."""
    import random

    import numpy as np
    import pyarrow as pa

    rnd = random.Random(languages)
    words = [["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)] for _ in range(languages)]
    text = lambda k, n: " ".join(rnd.choice(words[k]) for _ in range(n))
    rows = [(languages * j + k, text(k, 60), f"l{k:02d}") for k in range(languages) for j in range(6)]
    filters = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    of = lambda t: set(langid.grams(pa.array([t]))[0].tolist())
    sets = [set().union(*(of(t) for _, t, lang in rows if lang == f"l{k:02d}")) for k in range(languages)]
    for k in range(languages):
        mask = filters.languages_of(np.array(sorted(sets[k]), dtype=np.uint32))
        assert filters.bit(mask, k).all()
    other = np.array(sorted(of(" ".join("".join(rnd.choice("qxzjkvw") for _ in range(7)) for _ in range(3000))) - set().union(*sets)), dtype=np.uint32)
    found = np.mean([filters.bit(filters.languages_of(other), k).mean() for k in range(languages)])
    assert found < 2 * filters.false.mean() + 0.01
    new = [(i, text(i % languages, 30)) for i in range(3 * languages)]
    exact = {i: max(range(languages), key=lambda k, t=t: (len(of(t) & sets[k]), -k)) for i, t in new}
    got = {r.doc_id: r.predicted for r in langid.identify(spark.createDataFrame(new, "doc_id long, text string"), filters).collect()}
    assert got == {i: f"l{k:02d}" for i, k in exact.items()}


def test_of_equal_shares_the_first_language_wins(spark):
    rows = [(i, "the same words in both of them", lang) for i, lang in enumerate(["zz", "aa", "mm"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.predicted, r.margin) for r in langid.identify(docs, langid.train(docs)).collect()} == {("aa", 0.0)}


def test_rare_grams_count_whatever_the_size_of_training(spark):
    """One threshold: an n-gram met once is kept while once is the least share or more."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(900)), "aa") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r.share == 1 for r in langid.identify(docs, langid.train(docs)).collect())
    assert all(r.share < 1 for r in langid.identify(docs, langid.train(docs, share=1e-3)).collect())


@pytest.mark.parametrize("order,most", [(2, 50), (2, 2**32 - 1), (3, 1), (3, 50), (3, 2**21 - 1), (3, 2**21), (3, 2**32 - 1), (4, 50)])
def test_sums_of_ngrams(order, most):
    """Words of few bits are sorted as one number, wider ones column by column: the same sums."""
    rng = np.random.default_rng(order)
    for n in (0, 1, 500):
        words = (rng.integers(0, 5, (order, n)) * (most // 4 or 1)).clip(0, most).astype(np.uint32)
        weights = rng.integers(1, 1 << 40, n)
        for w in (None, weights):
            distinct, sums = K._summed(words, w)
            want = Counter()
            for column, x in zip(words.T.tolist(), ([1] * n if w is None else w.tolist()), strict=True):
                want[tuple(column)] += x
            assert [tuple(c) for c in distinct.T.tolist()] == sorted(want) and sums.tolist() == [want[c] for c in sorted(want)]
            assert distinct.dtype == np.uint32


def test_sums_cost_less_than_sorting_columns():
    words = np.random.default_rng(1).integers(0, 1 << 18, (3, 500_000)).astype(np.uint32)

    def least(f):
        times = []
        for _ in range(5):
            begun = time.process_time()
            f()
            times.append(time.process_time() - begun)
        return min(times)

    assert least(lambda: K._summed(words)) < 0.8 * least(lambda: np.lexsort(words[::-1]))


@pytest.mark.parametrize("size", [1, 2, 40, 5000])
def test_shelves_give_what_was_put_in(tmp_path, size):
    rng = np.random.default_rng(size)
    hashes = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
    values = rng.integers(1, 1 << 17, (len(hashes), 2))
    K._write(f"{tmp_path}/s", "a", **K._shelved(hashes, values))
    shelf = K.Files(f"{tmp_path}/s")("a")
    assert all(type(x) is np.ndarray for x in shelf.values())
    asked = np.unique(np.concatenate([hashes[::2], rng.integers(0, 1 << 64, size, dtype=np.uint64)]))
    there, got = K._looked_up(shelf, asked, 2)
    at = np.flatnonzero(np.isin(asked, hashes))
    assert there.tolist() == at.tolist() and (got == values[np.searchsorted(hashes, asked[at])]).all()
