"""Benchmark decontamination by latent semantic retrieval.

1. One pass over the corpus reduces every document to the words that occur in any benchmark item, with their
   places (a word outside that vocabulary can neither be retrieved by nor matched with an item).
2. The document frequency of each word over all passages, then the randomised SVD of the TF-IDF passages: each
   task multiplies its passages' Gram matrix with a seeded Gaussian block, the sums are added up by slices, and the single-pass
   Nyström formula gives the leading right singular vectors. The items are passages too, weighted
   to half of the energy so that the latent space resolves them. What moves is vocabulary x rank, whatever the corpus.
3. Overlapping windows of every document, at the scale of each item's length, are compared with the items by cosine in that space.
4. Of a candidate the longest common subsequence of words decides: `EXACT` of the item's words in order are a leak; from
   `PARAPHRASE` on it is one if most of the item's informative words and its answer (the last sentence) are there too.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .exchange import binary, bounded_batches, drop, partition_keys, saved, without, workspace

RANK, OVERSAMPLE, PASSAGE = 64, 8, 64
COSINE, EXACT, PARAPHRASE, ANSWER = 0.5, 0.6, 0.4, 0.7
SMALLEST, CERTAIN_WORDS = 16, 8
#: Items are compared with the windows of a slice so many at a time, which changes no result.
_ITEMS_AT_ONCE = 500
_SLICE_WORDS = 150_000
_SUMS = 16


class Items:
    """The items of a benchmark as word numbers; sent to every task, its size is that of the benchmark."""

    def __init__(self, ids: list[int], texts: list[str]):
        words, offs = tk.tokens(pa.array(texts, pa.large_string()))
        self.vocabulary = np.unique(words)
        number = np.searchsorted(self.vocabulary, words)
        self.words = [number[a:b] for a, b in zip(offs, offs[1:], strict=False)]
        self.ids = ids
        self.lengths = np.diff(offs)
        answers = [[x for x in re.split(r"[.!?\n]+", t) if tk.tokens(pa.array([x], pa.large_string()))[0].size][-1:] or [""] for t in texts]
        found, at = tk.tokens(pa.array([a[0] for a in answers], pa.large_string()))
        found = np.searchsorted(self.vocabulary, found)
        self.answers = [np.unique(found[a:b]) for a, b in zip(at, at[1:], strict=False)]
        self.scale = np.maximum(SMALLEST, 2 ** np.ceil(np.log2(np.maximum(self.lengths, 1))).astype(np.int64))
        self.kind = np.uint16 if len(self.vocabulary) <= 65536 else np.uint32
        slot = (self.vocabulary >> np.uint64(44)).astype(np.int64)
        self.slots = np.full(1 << 20, -1, dtype=np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.slots[slot[1:][slot[1:] == slot[:-1]]] = -2  # more than one word: searched

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, word numbers) of the hashes that are in the vocabulary."""
        at = self.slots[(hashes >> np.uint64(44)).astype(np.int64)]
        place = np.flatnonzero(at != -1)
        at, own = at[place], hashes[place]
        many = np.flatnonzero(at == -2)
        at[many] = np.minimum(np.searchsorted(self.vocabulary, own[many]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == own
        return place[same], at[same]


def _reduce(items: Items):
    """Documents to the numbers of vocabulary words and the gaps between their places, in 16 bits or, where a document has wider ones, 32."""

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                words, offs = tk.tokens(part.column("text"))
                place, number = items.find(words)
                cuts = np.searchsorted(place, offs)
                first = offs[:-1][np.repeat(np.arange(len(offs) - 1), np.diff(cuts))]
                gap = np.diff(place, prepend=0)
                own = np.zeros(len(place), dtype=bool)
                own[cuts[:-1][np.diff(cuts) > 0]] = True
                gap = np.where(own, place - first, gap)
                narrow, number = gap.astype(np.uint16), number.astype(items.kind)
                wide = {int(np.searchsorted(cuts, i, "right")) - 1 for i in np.flatnonzero(gap > 65535)}
                gaps = [(gap[a:b].astype(np.uint32) if i in wide else narrow[a:b]).tobytes() for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                cols = [part.column("doc_id"), binary([number[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]), binary(gaps)]
                some = pa.array(np.diff(cuts) > 0)
                yield pa.RecordBatch.from_arrays([c.filter(some) for c in cols], names=["doc_id", "words", "gaps"])

    return run


def _groups(batch: pa.RecordBatch, kind, most: int = _SLICE_WORDS):
    """(rows, word numbers, places, n + 1 offsets) of parts of a batch of about `most` words."""
    words, gaps = batch.column("words").to_pylist(), batch.column("gaps").to_pylist()
    size = np.dtype(kind).itemsize
    counts = np.array([len(w) // size for w in words], dtype=np.int64)
    part = np.cumsum(counts) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            number = np.frombuffer(b"".join(words[a:b]), kind).astype(np.int64)
            if any(2 * n != len(g) for n, g in zip(counts[a:b], gaps[a:b], strict=True)):
                gap = np.concatenate([np.frombuffer(g, np.uint16 if 2 * n == len(g) else np.uint32).astype(np.int64) for n, g in zip(counts[a:b], gaps[a:b], strict=True)])
            else:
                gap = np.frombuffer(b"".join(gaps[a:b]), np.uint16).astype(np.int64)
            offs = np.concatenate([[0], np.cumsum(counts[a:b])])
            total = np.cumsum(gap)
            before = np.concatenate([[0], total])[offs[:-1]]
            yield range(a, b), number, total - np.repeat(before, counts[a:b]), offs


def _cells(place: np.ndarray, offs: np.ndarray, width: int, align: int = 1) -> np.ndarray:
    """The running number of each word's cell of `width` words. A document begins at a multiple of `align` cells; three stay free after it."""
    counts = np.diff(offs)
    last = np.where(counts > 0, place[np.maximum(offs[1:] - 1, 0)] // width, 0) + 4
    last = -(-last // align) * align
    return place // width + np.repeat(np.cumsum(last) - last, counts)


def segment_sums(table: np.ndarray, index: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the rows table[index] from each of the cuts to the next; the last row of table is zero. Eight rows at a time."""
    lens = np.diff(np.append(cuts, len(index)))
    blocks = -(-lens // 8)
    first = np.cumsum(blocks) - blocks
    padded = np.full(int(blocks.sum()) * 8, len(table) - 1, dtype=np.int64)
    padded[np.arange(len(index)) + np.repeat(8 * first - cuts, lens)] = index
    padded = padded.reshape(-1, 8)
    out = table[padded[:, 0]]
    for c in range(1, 8):
        out += table[padded[:, c]]
    if len(out) == len(cuts):
        return out
    return segment_sums(np.vstack([out, np.zeros_like(out[:1])]), np.arange(len(out)), first)


def _slices_of(sums: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(sums.astype(np.float64), len(keys))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(range(len(keys)), pa.int32()), binary([p.tobytes() for p in parts])], names=["key", "part", "sums"])


def _add(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(data, np.float64)
    if total:
        parts = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), binary([total[p].tobytes() for p in parts])], names=["part", "sums"])


def _summed(df: DataFrame, task, shape: tuple[int, ...]) -> np.ndarray:
    """Adds up one array of each task, slice by slice in the executors; the driver gets one array."""
    keys = partition_keys(_SUMS)
    rows = df.mapInArrow(tk.trimmed(task(keys)), "key int, part int, sums binary").repartition(_SUMS, "key").mapInArrow(tk.trimmed(_add), "part int, sums binary").collect()
    if not rows:
        return np.zeros(shape)
    return np.concatenate([np.frombuffer(bytes(r.sums), np.float64) for r in sorted(rows, key=lambda r: r.part)]).reshape(shape)


def _frequencies(items: Items):
    def task(keys):
        def run(batches):
            count, seen = np.zeros(len(items.vocabulary) + 1), False
            for batch in batches:
                for _, number, place, offs in _groups(batch, items.kind, 1_000_000):
                    cell = _cells(place, offs, PASSAGE)
                    pair = np.unique(_narrow(cell * len(items.vocabulary) + number))
                    count[:-1] += np.bincount(pair % len(items.vocabulary), minlength=len(items.vocabulary))
                    count[-1] += len(np.flatnonzero(np.diff(cell, prepend=-1)))
                    seen = True
            if seen:
                yield _slices_of(count, keys)

        return run

    return task


def _narrow(key: np.ndarray) -> np.ndarray:
    return key.astype(np.uint32) if len(key) and key.max() < 1 << 32 else key


def _lengths(number: np.ndarray, passage: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The length of each passage's TF-IDF vector; passage: ascending from 0, each there."""
    key = np.sort(_narrow(passage * len(idf) + number))
    cuts = np.flatnonzero(np.diff(key.astype(np.int64), prepend=-1))
    tf, pair = np.diff(np.append(cuts, len(key))), key[cuts].astype(np.int64)
    return np.sqrt(np.maximum(np.bincount(pair // len(idf), weights=(tf * idf[pair % len(idf)]) ** 2), 1e-12))


def _gram_times(number: np.ndarray, passage: np.ndarray, idf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """X'X block for the TF-IDF passages X of length 1 given by their words; table: idf * block and a row of zeros."""
    cuts = np.flatnonzero(np.diff(passage, prepend=-1))
    scores = segment_sums(table, number, cuts) / _lengths(number, passage, idf)[:, None].astype(np.float32) ** 2
    order = np.argsort(number.astype(np.uint16) if len(idf) <= 65536 else number, kind="stable")
    number = number[order]
    cuts = np.flatnonzero(np.diff(number, prepend=-1))
    out = np.zeros((len(idf), table.shape[1]))
    own = number[cuts]
    out[own] = segment_sums(np.vstack([scores, np.zeros_like(scores[:1])]), passage[order], cuts) * idf[own][:, None]
    return out


def _with_zero(table: np.ndarray) -> np.ndarray:
    return np.vstack([table, np.zeros((1, table.shape[1]))]).astype(np.float32)


def _sketch(items: Items, idf: np.ndarray, block: np.ndarray):
    table = _with_zero(block * idf[:, None])

    def task(keys):
        def run(batches):
            total = np.zeros(block.shape)
            seen = False
            for batch in batches:
                for _, number, place, offs in _groups(batch, items.kind):
                    passage = np.cumsum(np.diff(_cells(place, offs, PASSAGE), prepend=-1) != 0) - 1
                    total += _gram_times(number, passage, idf, table)
                    seen = True
            if seen:
                yield _slices_of(total, keys)

        return run

    return task


def _svd(reduced: DataFrame, items: Items, rank: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(idf of each word, leading right singular vectors) of the TF-IDF passages of corpus and benchmark."""
    size = len(items.vocabulary)
    df = _summed(reduced, _frequencies(items), (size + 1,))
    idf = np.log((df[-1] + len(items.ids) + 1) / (df[:-1] + 1)) + 1e-3
    width = min(size, rank + OVERSAMPLE)
    block = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
    corpus = _summed(reduced, _sketch(items, idf, block), (size, width))
    number = np.concatenate(items.words)
    passage = np.repeat(np.arange(len(items.ids)), items.lengths)
    own = _gram_times(number, passage, idf, _with_zero(block * idf[:, None]))
    y = corpus / max(df[-1], 1) + own / len(items.ids)
    shift = 1e-7 * max(np.linalg.norm(y), 1e-12)
    y = y + shift * block
    small = block.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-12 * max(values.max(), 1e-30)))
    u, _, _ = np.linalg.svd(y @ root, full_matrices=False)
    return idf, u[:, :rank]


def lcs(a, b) -> int:
    """Length of the longest common subsequence, 64 and more places at a time in one integer."""
    where: dict[int, int] = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _contiguous(number: np.ndarray, place: np.ndarray, item: np.ndarray) -> bool:
    m = len(item)
    return any(place[i + m - 1] - place[i] == m - 1 and (number[i : i + m] == item).all() for i in range(len(number) - m + 1))


def _search(items: Items, idf: np.ndarray, vectors: np.ndarray, cosine: float):
    table = _with_zero(vectors * idf[:, None])
    latent = np.stack([table[w].sum(axis=0) for w in items.words])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    of_scale = [(int(x), np.flatnonzero(items.scale == x)) for x in np.unique(items.scale)]
    scales = [(x, which[k : k + _ITEMS_AT_ONCE]) for x, which in of_scale for k in range(0, len(which), _ITEMS_AT_ONCE)]
    own = [np.unique(w) for w in items.words]
    lists = [w.tolist() for w in items.words]
    mass = np.array([idf[w].sum() for w in own])

    def pairs_of(number, lo, hi, item):
        """(candidate, word, how often) for the words of the item in each candidate's region."""
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        word = number[np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)]
        key = item[which] * len(idf) + word
        at = np.minimum(np.searchsorted(item_keys, key), len(item_keys) - 1)
        inside = item_keys[at] == key
        key = np.sort(which[inside] * len(item_keys) + at[inside])
        cuts = np.flatnonzero(np.diff(key, prepend=-1))
        return key[cuts] // len(item_keys), key[cuts] % len(item_keys), np.diff(np.append(cuts, len(key)))

    item_keys, item_counts = np.unique(np.repeat(np.arange(len(lists)), items.lengths) * len(idf) + np.concatenate(items.words), return_counts=True)

    def possible(number, lo, hi, item) -> np.ndarray:
        """The candidates whose words, in whatever order, could satisfy `judge`."""
        which, word, count = pairs_of(number, lo, hi, item)
        most = np.bincount(which, np.minimum(count, item_counts[word]), len(lo))
        informed = np.bincount(which, idf[item_keys[word] % len(idf)], len(lo)) / mass[item]
        m = items.lengths[item]
        return (most >= EXACT * m - 1e-9) | (most >= PARAPHRASE * m - 1e-9) & (informed >= EXACT - 1e-9)

    def informative(words: np.ndarray, number: np.ndarray) -> float:
        """The share of the words' inverse document frequency that is there; common words hardly count."""
        return float(idf[words] @ np.isin(words, number) / idf[words].sum())

    def judge(number: np.ndarray, place: np.ndarray, j: int) -> float:
        m, inside = len(lists[j]), set(lists[j])
        share = lcs([x for x in number.tolist() if x in inside], lists[j]) / m
        if m < CERTAIN_WORDS:
            return 1.0 if share == 1 and _contiguous(number, place, items.words[j]) else 0.0
        if share >= EXACT:
            return share
        if share < PARAPHRASE or informative(own[j], number) < EXACT or informative(items.answers[j], number) < ANSWER:
            return 0.0
        return share

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for rows, number, place, offs in _groups(batch, items.kind):
                best: dict[tuple[int, int], float] = {}
                fine = _cells(place, offs, SMALLEST // 2)
                cuts = np.flatnonzero(np.diff(fine, prepend=-1))
                if not len(cuts):
                    continue
                cells, sums = fine[cuts], segment_sums(table, number, cuts)  # of the cells that have words
                half, window = 1, None  # fine cells in half a window
                for scale, which in scales:
                    while half < scale // SMALLEST:
                        cuts = np.flatnonzero(np.diff(cells // 2, prepend=-1))
                        two = np.flatnonzero(np.diff(np.append(cuts, len(cells))) == 2)
                        added = sums[cuts]
                        added[two] += sums[cuts[two] + 1]
                        cells, sums, half, window = cells[cuts] // 2, added, half * 2, None
                    if window is None:  # begins with every cell that has words and with the one before it
                        starts = np.union1d(cells, cells[cells > 0] - 1)
                        window = np.zeros((len(starts), sums.shape[1]), dtype=np.float32)
                        window[np.searchsorted(starts, cells)] = sums
                        before = cells > 0
                        window[np.searchsorted(starts, cells[before] - 1)] += sums[before]
                        norm = np.sqrt(np.einsum("ij,ij->i", window, window))
                    some = np.flatnonzero(norm > 1e-6)
                    r, c = np.nonzero(window[some] @ latent[which].T >= cosine * norm[some][:, None])
                    begin, item = starts[some[r]] * half, which[c]
                    # a region reaches half a window beyond the window on both sides, within its document
                    lo, hi = np.searchsorted(fine, begin - half), np.searchsorted(fine, begin + 3 * half)
                    doc, last = np.searchsorted(offs, lo, "right") - 1, np.searchsorted(offs, hi, "left")
                    regions = [(doc, lo, np.minimum(hi, offs[np.minimum(doc + 1, len(offs) - 1)]), item)]
                    k = 1
                    while (more := np.flatnonzero(doc + k < last)).size:  # regions over the ends of documents
                        d = doc[more] + k
                        regions.append((d, np.maximum(lo[more], offs[d]), np.minimum(hi[more], offs[d + 1]), item[more]))
                        k += 1
                    d, lo, hi, item = (np.concatenate(x) for x in zip(*regions, strict=True))
                    full = np.flatnonzero(hi - lo >= PARAPHRASE * items.lengths[item] - 1e-9)
                    d, lo, hi, item = d[full], lo[full], hi[full], item[full]
                    if not len(d):
                        continue
                    for x in np.flatnonzero(possible(number, lo, hi, item)).tolist():
                        pair = int(d[x]), int(item[x])
                        if best.get(pair, 0) < 1:
                            a, b = lo[x], hi[x]
                            share = judge(number[a:b], place[a:b], pair[1])
                            if share > best.get(pair, 0):
                                best[pair] = share
                if best:
                    pairs = sorted(best)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(ids[rows[d]]) for d, _ in pairs]), pa.array([int(items.ids[j]) for _, j in pairs]), pa.array([float(best[p]) for p in pairs])], names=["doc_id", "item_id", "share"]
                    )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE, seed: int = 17) -> DataFrame:
    """(doc_id, item_id, share): documents that hold a benchmark item or a paraphrase; share of the item's words found in order.

    docs: doc_id, text; benchmark: item_id, text; other columns are not read. Rows with a null id or text and texts
    without words match nothing. An item of fewer than 8 words matches only word for word. Repeated rows of a
    document give one row for each item, with the largest share; repeated item ids likewise. No items
    or no documents give no rows. The benchmark is taken to the driver; the corpus never is. Words, weights and the latent space are
    those of the whole benchmark, and memory follows the words of a text that are in it, not the text's length.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").orderBy("item_id", "text").collect()
    rows = [r for r in rows if tk.tokens(pa.array([r.text], pa.large_string()))[0].size]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    if not rows:
        return spark.createDataFrame([], "doc_id long, item_id long, share double")
    folder = workspace(spark)
    items = Items([r.item_id for r in rows], [r.text for r in rows])
    reduced = saved(texts.mapInArrow(tk.trimmed(_reduce(items)), "doc_id long, words binary, gaps binary"), folder, "reduced")
    idf, vectors = _svd(reduced, items, rank, seed)
    hits = saved(reduced.mapInArrow(tk.trimmed(_search(items, idf, vectors, cosine)), "doc_id long, item_id long, share double"), folder, "hits")
    drop(spark, f"{folder}/reduced")
    return hits.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, all columns kept; rows without doc_id or text stay."""
    return without(docs, leaks(docs, benchmark).select("doc_id"))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE: dict[str, str] = {}
