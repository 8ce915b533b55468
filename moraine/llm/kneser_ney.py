"""Interpolated modified Kneser-Ney model of any order from 2: counted in Spark, kept as sorted hash arrays, mapped into memory for scoring.

1. The words are counted and numbered, the most frequent of each shard first, so that numbers are exact and mostly small. The
   numbering is sorted arrays of hashes in files, which the tasks that count map like those that score.
2. N-grams of the highest order go, once for each task's share of them, to the task that owns their context; it sums the counts, writes a
   shard of n-grams and contexts with what is known of them, and passes on what follows the first word of each: the count of the next lower order is
   the number of different words before it (continuations). An n-gram that begins with the begin mark has no word before it and keeps
   its plain count. So on down to bigrams, whose owners pass on what is known of each word. Between orders the counts are written to
   the shared folder, so that a lost executor costs tasks of one order and the shuffle of the order before is gone.

No word or n-gram is pruned and none is left out of the counts: the model grows with the corpus.

Discounts follow Chen and Goodman's closed form from the counts of counts of each order. A scoring task maps the shards (so its memory is
that of a slice of text) and looks its n-grams up in ascending order.

Words are told apart by 64 bits of hash, counts are by word number and exact. A shard is sorted by a 64-bit hash of the n-gram, of which it keeps 32 bits and,
by a directory, as many as tell its places apart but for about 16: an n-gram that isn't there is taken for one that is once in some 10^8 look-ups.
A document is one sequence with a begin and an end mark. The unigram distribution is interpolated with a uniform one over the vocabulary and one unknown word.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .exchange import binary, bounded_batches, drop, pack_sorted, partition_keys, partitions, saved, target, unpack_sorted, workspace

#: Order of the registered query.
ORDER = 3
NONE, BEGIN, END, FIRST, UNKNOWN = 0, 1, 2, 3, 0xFFFFFFFF
_FLUSH = 4_000_000
_STATS = 5  # total, n1, n2, n3 or more, continuations
_WORDS = "key int, words binary, more binary, counts binary"
_GRAMS = "key int, pairs binary, rest binary, more binary, counts binary, many binary"


def _write(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Arrays as one file, written aside and renamed: a task that runs again replaces its own with the same."""
    os.makedirs(folder, exist_ok=True)
    arrays = {k: np.ascontiguousarray(a) for k, a in arrays.items()}
    places = np.cumsum([0, *(-(-a.nbytes // 8) * 8 for a in arrays.values())]).tolist()
    head = json.dumps({k: (a.dtype.str, a.shape, at) for (k, a), at in zip(arrays.items(), places, strict=False)}).encode()
    head += b" " * (-len(head) % 8)
    aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(aside, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(aside, f"{folder}/{name}")


class Files:
    """The files of a folder, mapped when first asked for."""

    def __init__(self, folder: str):
        self.folder = folder
        self.open: dict[str, dict[str, np.ndarray] | None] = {}

    def __call__(self, name: str) -> dict[str, np.ndarray] | None:
        if name not in self.open:
            path = f"{self.folder}/{name}"
            self.open[name] = self._mapped(path) if os.path.exists(path) else None
        return self.open[name]

    @staticmethod
    def _mapped(path: str) -> dict[str, np.ndarray]:
        raw = np.asarray(np.memmap(path, np.uint8, "r"))  # as a plain array, whose parts cost less to take
        begin = 8 + int.from_bytes(raw[:8].tobytes(), "little")
        out = {}
        for name, (kind, shape, at) in json.loads(raw[8:begin].tobytes()).items():
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            out[name] = raw[begin + at : begin + at + size].view(kind).reshape(shape)
        return out


def _by_shard(shard: np.ndarray, shards: int):
    """(shard, rows that go there) of those that get any."""
    shard = shard.astype(np.uint16 if shards <= 1 << 16 else np.int64)  # short numbers are sorted by radix
    order = np.argsort(shard, kind="stable")
    cuts = np.append(0, np.cumsum(np.bincount(shard, minlength=shards)))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), order[cuts[s] : cuts[s + 1]]


class Vocabulary:
    """Numbers of words: FIRST + shards * rank in the shard + shard."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    def opened(self):
        files = Files(self.folder)

        def numbers(hashes: np.ndarray) -> np.ndarray:
            distinct, back = np.unique(hashes, return_inverse=True)
            out = np.full(len(distinct), UNKNOWN, dtype=np.uint32)
            for s, rows in _by_shard(target(tk.mix(distinct), self.shards), self.shards):
                if own := files(f"vocabulary-{s}"):
                    at = np.minimum(np.searchsorted(own["keys"], distinct[rows]), len(own["keys"]) - 1)
                    same = np.asarray(own["keys"][at]) == distinct[rows]
                    out[rows[same]] = FIRST + own["ranks"][at[same]].astype(np.int64) * self.shards + s
            return out[back]

        return numbers


def _grams(texts: pa.Array, n: int, numbers) -> tuple[np.ndarray, np.ndarray]:
    """(words by place in the n-gram: n rows, a column for each place but the first of a text; number of its text). Before a text is NONE.

    A text is its words between marks; a null text and one without words has no marks either.
    """
    words, offs = tk.tokens(texts)
    size = np.diff(offs)
    some = size > 0
    full = np.where(some, size + 2, 0)
    ends = np.cumsum(full)
    seq = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
    seq[(ends - full)[some]] = BEGIN
    seq[ends[some] - 1] = END
    seq[np.arange(len(words)) + np.repeat((ends - full) + 1 - offs[:-1], size)] = numbers(words)
    text = np.repeat(np.arange(len(size)), np.maximum(full - 1, 0))
    local = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(full - 1, 0)) - np.maximum(full - 1, 0), np.maximum(full - 1, 0)) + 1
    at = (ends - full)[text] + local
    return np.stack([np.where(local >= k, seq[np.maximum(at - k, 0)], np.uint32(NONE)) for k in range(n - 1, -1, -1)]), text


def _hashed(words: np.ndarray) -> np.ndarray:
    out = np.zeros(words.shape[1], dtype=np.uint64)
    for w in words:
        out = tk.mix(out * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(1))
    return out


def _summed(words: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns in the order of their words, with how many there are or the sum of their weights."""
    size, bits = len(words), int(words.max(initial=0)).bit_length()
    packed = size * bits <= 64
    if packed:  # as one number
        key = words[0].astype(np.uint64)
        for w in words[1:]:
            key = key << np.uint64(bits) | w
        order = None if weights is None else np.argsort(key)
        key = np.sort(key) if order is None else key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort([*words[:1:-1], words[0].astype(np.uint64) << np.uint64(32) | words[1]])
        words = words[:, order]
        new = (words[:, 1:] != words[:, :-1]).any(axis=0)
    rows = words.shape[1]
    cuts = np.flatnonzero(np.concatenate([np.ones(min(rows, 1), dtype=bool), new]))
    if packed:
        mask = np.uint64((1 << bits) - 1)
        distinct = np.stack([(key[cuts] >> np.uint64(bits * k) & mask).astype(np.uint32) for k in range(size - 1, -1, -1)])
    else:
        distinct = words[:, cuts]
    return distinct, np.diff(np.append(cuts, rows)) if weights is None else np.add.reduceat(weights[order], cuts) if len(cuts) else weights[:0]


def _counts_out(n: np.ndarray) -> tuple[bytes, bytes]:
    more = np.flatnonzero(n > 1)
    return np.diff(more, prepend=0).astype(np.uint16 if len(n) < 65536 else np.uint32).tobytes(), n[more].astype(np.uint32 if not len(more) or n.max() < 1 << 32 else np.uint64).tobytes()


def _counts_in(size: int, more: bytes, n: bytes) -> np.ndarray:
    c = np.ones(size, dtype=np.int64)
    at = np.cumsum(np.frombuffer(more, np.uint16 if size < 65536 else np.uint32), dtype=np.int64)
    c[at] = np.frombuffer(n, np.uint32 if len(n) == 4 * len(at) else np.uint64)
    return c


def _planes(values: np.ndarray) -> bytes:
    """uint32 in byte planes: word numbers are small mostly, so the upper planes compress away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _owner(words: np.ndarray) -> np.ndarray:
    """What n-grams are placed by: bigrams by themselves, longer ones by their context."""
    return tk.mix(_hashed(words[:-1] if len(words) > 2 else words))


def _sent(keys: np.ndarray, words: np.ndarray, counts: np.ndarray, many: bytes = b"") -> pa.RecordBatch:
    """N-grams of ascending words for their owners; many: what the first row says of the order above."""
    p = target(_owner(words), len(keys))
    order = np.argsort(p, kind="stable")
    words, counts, cuts = words[:, order], counts[order], np.searchsorted(p[order], np.arange(len(keys) + 1))
    rows = []
    for k in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[k], cuts[k + 1])
        pairs = words[0, s].astype(np.uint64) << np.uint64(32) | words[1, s]
        rows.append((int(keys[k]), pack_sorted(pairs), b"".join(_planes(w[s]) for w in words[2:]), *_counts_out(counts[s]), b"" if rows else many))
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *map(binary, map(list, cols[1:]))], names=["key", "pairs", "rest", "more", "counts", "many"])


def _received(rows: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    words, counts = [], []
    for data, rest, more, n, _ in rows:
        pairs = unpack_sorted(data)
        size = 4 * len(pairs)
        words.append(np.stack([(pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32), *(_from_planes(rest[k * size : (k + 1) * size]) for k in range(order - 2))]))
        counts.append(_counts_in(len(pairs), more, n))
    return _summed(np.concatenate(words, axis=1), np.concatenate(counts))


def _held(batches) -> dict[int, list]:
    """The rows of each shard that a task owns: it sees all of them before it can sum."""
    held: dict[int, list] = {}
    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(key, []).append(row)
    return held


def _count_words(keys: np.ndarray):
    def run(batches):
        held, size = [], 0

        def flush():
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            rows = [(int(keys[s]), pack_sorted(words[at]), *_counts_out(counts[at])) for s, at in _by_shard(target(tk.mix(words), len(keys)), len(keys))]
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *map(binary, map(list, cols[1:]))], names=["key", "words", "more", "counts"])

        for batch in batches:
            for part in tk.slices(batch, "text"):
                words, _ = tk.tokens(part.column("text"))
                if len(words):
                    held.append(words)
                    size += len(words)
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _number_words(keys: np.ndarray, folder: str):
    number = {int(k): i for i, k in enumerate(keys)}

    def run(batches):
        held = _held(batches)
        while held:
            key, rows = held.popitem()
            parts = [unpack_sorted(w) for w, _, _ in rows]
            counts = np.concatenate([_counts_in(len(w), *r[1:]) for w, r in zip(parts, rows, strict=True)])
            words, back = np.unique(np.concatenate(parts), return_inverse=True)
            count = np.bincount(back, counts, len(words))
            ranks = np.empty(len(words), dtype=np.uint32)
            ranks[np.lexsort((words, -count))] = np.arange(len(words))
            _write(folder, f"vocabulary-{number[key]}", keys=words, ranks=ranks)
            yield pa.RecordBatch.from_arrays([pa.array([len(words)], pa.int64())], names=["size"])

    return run


def _count_grams(keys: np.ndarray, order: int, vocabulary: Vocabulary):
    most = 2 * _FLUSH // order

    def run(batches):
        numbers = vocabulary.opened()
        held, size = [], 0
        for batch in batches:
            for part in tk.slices(batch, "text"):
                held.append(_grams(part.column("text"), order, numbers)[0])
                size += held[-1].shape[1]
                if size >= most:
                    yield _sent(keys, *_summed(np.concatenate(held, axis=1)))
                    held, size = [], 0
        if size:
            yield _sent(keys, *_summed(np.concatenate(held, axis=1)))

    return run


def _coded(values: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of at most four numbers, the first the largest, as one byte each: the place in a table of the 255 most frequent; the others are kept aside with their places."""
    code = np.full(len(values), 255, dtype=np.uint8)
    fits = np.flatnonzero(values[:, 0] < 1 << 16)
    packed = np.zeros(len(fits), dtype=np.uint64)
    for k in range(values.shape[1]):
        packed |= values[fits, k].astype(np.uint64) << np.uint64(16 * k)
    kinds, first, back, n = np.unique(packed, return_index=True, return_inverse=True, return_counts=True)
    top = np.argsort(-n, kind="stable")[:255]
    of_kind = np.full(len(kinds), 255, dtype=np.uint8)
    of_kind[top] = np.arange(len(top))
    code[fits] = of_kind[back]
    wide = np.flatnonzero(code == 255)
    return {"code": code, "table": values[fits[first[top]]].astype(np.int64), "place": wide, "wide": values[wide].astype(np.int64)}


def _shelved(hashes: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
    """Values by the hash of their n-gram: a directory of the uppermost bits, the next 32 of each, and the values' codes, all in the order of the hashes."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    bits = max(0, len(hashes).bit_length() - 5)
    upper = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), dtype=np.uint64)
    starts = np.searchsorted(upper, np.arange((1 << bits) + 1, dtype=np.uint64))
    return {"starts": starts.astype(np.uint32 if len(hashes) < 1 << 32 else np.uint64), "keys": ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32), **_coded(values[order])}


def _looked_up(shelf: dict[str, np.ndarray], hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the ascending hashes are there, their values)."""
    starts, keys = shelf["starts"], shelf["keys"]
    bits = (len(starts) - 1).bit_length() - 1
    upper = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)
    wanted = ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    low, high = starts[upper].astype(np.int64), starts[upper + 1].astype(np.int64)
    step = 1 << int((high - low).max(initial=0)).bit_length() >> 1
    while step:  # bisection, all hashes at once
        last = low + (step - 1)
        low += ((keys[np.minimum(last, len(keys) - 1)] < wanted) & (last < high)) * step
        step >>= 1
    at = np.minimum(low, len(keys) - 1)
    there = np.flatnonzero((low < high) & (keys[at] == wanted))
    at = at[there]
    code = np.asarray(shelf["code"][at])
    out = np.zeros((len(at), width), dtype=np.int64)
    plain = code < 255
    out[plain] = shelf["table"][code[plain]]
    if not plain.all():
        out[~plain] = shelf["wide"][np.searchsorted(shelf["place"], at[~plain])]
    return there, out


def _of_contexts(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(total, how many of 1, 2, 3 or more) of the counts from each of the places on."""
    return np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1)


def _level(keys: np.ndarray, folder: str, order: int):
    """Sums a shard's n-grams of an order of 3 or more, writes it and passes on the counts of the order below."""
    number = {int(k): i for i, k in enumerate(keys)}

    def run(batches):
        held = _held(batches)
        while held:
            key, rows = held.popitem()
            words, counts = _received(rows, order)
            del rows
            real = words[0] != NONE
            own, c = words[:, real], counts[real]
            if len(c):
                _write(folder, f"grams{order}-{number[key]}", **_shelved(_hashed(own), c[:, None]))
                at = np.flatnonzero(np.concatenate([[True], (own[:-1, 1:] != own[:-1, :-1]).any(axis=0)]))
                _write(folder, f"contexts{order}-{number[key]}", **_shelved(_hashed(own[:-1, at]), _of_contexts(c, at)))
            many = np.bincount(np.minimum(c, 5), minlength=6)[1:5].astype(np.int64)
            yield _sent(keys, *_summed(words[1:], np.where(real, 1, counts)), many.tobytes())

    return run


def _by_word(keys: np.ndarray, words: np.ndarray, stats: np.ndarray):
    """Rows of (words, statistics) for the shards of the words; stats: (word, _STATS)."""
    for s, at in _by_shard(words.astype(np.int64) % len(keys), len(keys)):
        yield int(keys[s]), _planes(words[at]), stats[at].astype(np.uint32 if stats[at].max() < 1 << 32 else np.uint64).T.tobytes()


def _bigrams(keys: np.ndarray, folder: str):
    """Sums a shard's bigrams, writes it, and passes on the statistics of words and the counts of counts."""
    number = {int(k): i for i, k in enumerate(keys)}

    def run(batches):
        held = _held(batches)
        while held:
            key, rows = held.popitem()
            words, counts = _received(rows, 2)
            _write(folder, f"grams2-{number[key]}", **_shelved(_hashed(words), counts[:, None]))
            context, at = np.unique(words[0], return_index=True)
            after, n = np.unique(words[1], return_counts=True)
            each = np.union1d(context, after)
            total = np.zeros((len(each), _STATS), dtype=np.int64)
            total[np.searchsorted(each, context), :4] = _of_contexts(counts, at)
            total[np.searchsorted(each, after), 4] = n
            many = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64)
            rows = list(_by_word(keys, each, total))
            cols = list(zip(*rows, strict=True))
            tags = [many.tobytes()] + [b""] * (len(rows) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), binary(list(cols[1])), binary(list(cols[2])), binary(tags)], names=["key", "words", "stats", "many"])

    return run


def _words(keys: np.ndarray, folder: str):
    """Adds up the statistics of a shard's words and writes them by number; one row of what the discounts need."""
    number = {int(k): i for i, k in enumerate(keys)}

    def run(batches):
        for key, rows in _held(batches).items():
            words = np.concatenate([_from_planes(w) for w, _, _ in rows]).astype(np.int64) // len(keys)
            stats = np.concatenate([np.frombuffer(s, np.uint32 if len(s) == len(w) * _STATS else np.uint64).reshape(_STATS, -1).T.astype(np.int64) for w, s, _ in rows])
            many = np.sum([np.zeros(4, dtype=np.int64), *(np.frombuffer(m, np.int64) for _, _, m in rows if m)], axis=0)
            total = np.zeros((int(words.max()) + 1, _STATS), dtype=np.int64)
            np.add.at(total, words, stats)
            _write(folder, f"words-{number[key]}", stats=total if total.max() >= 1 << 32 else total.astype(np.uint32))
            c = total[:, 4]
            cont = np.bincount(np.minimum(c[c > 0], 5), minlength=6)[1:5]
            sums = np.concatenate([many, cont, [int((c > 0).sum()), int(c.sum())]])
            yield pa.RecordBatch.from_arrays([binary([sums.astype(np.int64).tobytes()])], names=["sums"])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts for counts of 0, 1, 2 and 3 or more from the numbers n of items counted 1 to 4 times; kept within [0, count]."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([0.0, *(min(max(x, 0.0), k + 0.999) for k, x in enumerate(d))])


class Model:
    """A model in a folder that all workers can map."""

    def __init__(self, folder: str, shards: int, sums: np.ndarray, higher: np.ndarray):
        """higher: counts of counts of each order from 3."""
        self.folder, self.shards, self.order = folder, shards, 2 + len(higher)
        self.vocabulary = Vocabulary(folder, shards)
        self.discount = {2: discounts(sums[:4])} | {k: discounts(n) for k, n in enumerate(higher, 3)}
        self.word_discount = discounts(sums[4:8])
        self.size, self.total = int(sums[8]), int(sums[9])
        n1, n2 = sums[4], sums[5]
        spent = self.word_discount[1] * n1 + self.word_discount[2] * n2 + self.word_discount[3] * (self.size - n1 - n2)
        self.uniform = float(spent / self.total / (self.size + 1)) if self.total else 1.0

    def open(self) -> Maps:
        return Maps(self)


class Maps:
    def __init__(self, model: Model):
        self.m = model
        self.files = Files(model.folder)
        self.numbers = model.vocabulary.opened()

    def _find(self, kind: str, words: np.ndarray, width: int, owner: np.ndarray) -> np.ndarray:
        """What is known of n-grams, zeros for those that aren't there."""
        hashes = _hashed(words)
        order = np.argsort(hashes)
        hashes = hashes[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        distinct, first, back = hashes[new], order[new], np.empty(len(order), dtype=np.int64)
        back[order] = np.cumsum(new) - 1
        out = np.zeros((len(distinct), width), dtype=np.int64)
        for s, rows in _by_shard(target(owner[first], self.m.shards), self.m.shards):
            if shelf := self.files(f"{kind}-{s}"):
                there, got = _looked_up(shelf, distinct[rows], width)
                out[rows[there]] = got
        return out[back]

    def _stats(self, words: np.ndarray) -> np.ndarray:
        """What is known of words."""
        distinct, back = np.unique(words, return_inverse=True)
        out = np.zeros((len(distinct), _STATS), dtype=np.int64)
        for s, rows in _by_shard(distinct.astype(np.int64) % self.m.shards, self.m.shards):
            if own := self.files(f"words-{s}"):
                at = distinct[rows].astype(np.int64) // self.m.shards
                inside = (at < len(own["stats"])) & (distinct[rows] != UNKNOWN)
                out[rows[inside]] = own["stats"][at[inside]]
        return out[back]

    def log_probabilities(self, words: np.ndarray) -> np.ndarray:
        """Natural logarithms of P(last word | the words before it) for n-grams of the model's order."""
        m = self.m
        cont = self._stats(words[-1])[:, 4]
        p = np.maximum(cont - m.word_discount[np.minimum(cont, 3)], 0) / max(m.total, 1) + m.uniform
        for k in range(2, m.order + 1):
            at = np.flatnonzero(words[-k] != NONE)
            own = words[-k:, at]
            count = self._find(f"grams{k}", own, 1, _owner(own))[:, 0]
            context = self._stats(own[0]) if k == 2 else self._find(f"contexts{k}", own[:-1], 4, _owner(own))
            p[at] = self._mixed(count, context, m.discount[k], p[at])
        return np.log(p)

    @staticmethod
    def _mixed(count: np.ndarray, context: np.ndarray, discount: np.ndarray, lower: np.ndarray) -> np.ndarray:
        total = np.maximum(context[:, 0], 1)
        weight = np.where(context[:, 0] > 0, context[:, 1:4] @ discount[1:] / total, 1.0)
        return np.maximum(count - discount[np.minimum(count, 3)], 0) / total + weight * lower


def _local(folder: str) -> str:
    """A shared folder as a path that workers can map: it must be mounted, a file system as such can't be."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"{folder}: scoring maps files, so the shared folder must be mounted (file:)")
    return folder


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _added(rows: list, size: int) -> np.ndarray:
    return np.sum([np.zeros(size, dtype=np.int64), *(np.frombuffer(bytes(r[0]), np.int64) for r in rows)], axis=0)


def train(docs: DataFrame, order: int = 2) -> Model:
    """Counts every text of docs; rows with null or wordless texts add nothing. The model stays in the shared folder.

    More than 2^32 - 4 different words, or as many as one shard can't number evenly with the others, raise ValueError.
    """
    if order < 2:
        raise ValueError("order is 2 or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    base = workspace(spark)
    folder = f"{_local(base)}/model"
    keys = partition_keys(p := partitions(spark))
    texts = _texts(docs).select("text").where("text is not null")
    sizes = saved(texts.mapInArrow(tk.trimmed(_count_words(keys)), _WORDS).repartition(p, "key").mapInArrow(tk.trimmed(_number_words(keys, folder)), "size long"), base, "vocabulary")
    if FIRST + p * (sizes.agg(F.max("size")).first()[0] or 0) >= UNKNOWN:
        raise ValueError("too many different words to be numbered in 32 bits")
    rows = texts.mapInArrow(tk.trimmed(_count_grams(keys, order, Vocabulary(folder, p))), _GRAMS)
    higher = []
    for k in range(order, 2, -1):
        rows = saved(rows.repartition(p, "key").mapInArrow(tk.trimmed(_level(keys, folder, k)), _GRAMS), base, f"level{k}")
        higher.insert(0, _added(rows.where("length(many) > 0").select("many").collect(), 4))
        if k < order:
            drop(spark, f"{base}/level{k + 1}")
    stats = saved(rows.repartition(p, "key").mapInArrow(tk.trimmed(_bigrams(keys, folder)), "key int, words binary, stats binary, many binary"), base, "stats")
    if order > 2:
        drop(spark, f"{base}/level3")
    sums = saved(stats.repartition(p, "key").mapInArrow(tk.trimmed(_words(keys, folder)), "sums binary"), base, "sums").collect()
    return Model(folder, p, _added(sums, 10), np.array(higher, dtype=np.int64).reshape(-1, 4))


def _score(model: Model):
    most = min(16 << 20, max(tk.SLICE_BYTES, model.shards << 15))  # the more shards, the more look-ups for each visit to one

    def run(batches):
        maps = model.open()
        for batch in batches:
            for part in tk.slices(batch, "text", most):
                words, text = _grams(part.column("text"), model.order, maps.numbers)
                logs = maps.log_probabilities(words)
                n = np.bincount(text, minlength=part.num_rows)
                total = np.bincount(text, logs, part.num_rows)
                some = n > 0
                perplexity = np.exp(-total / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(total), pa.array(perplexity, mask=~some)], names=["doc_id", "n_tokens", "log_prob", "perplexity"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every row, repeated or not; n_tokens counts words and the end mark.

    A null text and one without words have 0 tokens, log_prob 0 and a null perplexity. Whole texts are scored. Other columns are
    not read. An empty table gives no rows. With a model of nothing every word has the same probability, 1.
    """
    return _texts(docs).mapInArrow(tk.trimmed(_score(model)), "doc_id long, n_tokens long, log_prob double, perplexity double")


def op2_lm_scoring(spark, sf_dir: str, order: int = 2) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, order))


QUERIES = {"op2_lm_scoring": partial(op2_lm_scoring, order=ORDER)}
ORACLE: dict[str, str] = {}
