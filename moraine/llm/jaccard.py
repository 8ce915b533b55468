"""N-gram Jaccard join: near copies by T-occurrence search over inverted lists (DivideSkip).

Two documents match if the Jaccard index of their sets of word n-grams reaches `threshold`. Matching
documents need an overlap of at least T = ceil(threshold * size) with either set, which is used twice:

1. Over all documents, as shuffles of packed arrays. The n-grams are counted exactly; a document of
   which fewer than T n-grams occur anywhere else can match nothing and goes. Documents with equal sets
   go on as one. Every other has a home, by the least hash of its n-grams, so that most near copies
   share theirs. Of the documents that go on, two that match share one of their rarest (shared - T + 1)
   n-grams: the task that owns such an n-gram sends its documents to the other homes that it occurs in,
   unless sizes or the n-grams left after it rule out a match with all documents there.
2. Within a home each of its documents and every visitor is held against the documents at home. For links and pairs
   (`near_classes`, `near_pairs`) overlaps are counted: n-grams in few documents by merging their lists, those that
   many have by products of 0-1 matrices, one for each set of documents that such n-grams connect (`_matches`). For groups
   (`near_copies`) the lists are searched by DivideSkip: the short lists of a query are merged, ids found there T - L times or
   more are looked up in the L long lists by binary search, and those that reach the overlap are kept; documents that match
   already through a third one are not compared again. Nothing else is skipped, and no list or candidate set is capped. A home of
   more than `BLOCK` documents or `BLOCK_GRAMS` n-grams is cut by a hash of doc_id; its documents visit the other parts.

So the work follows the documents and the homes that each could have a match in, not the size of a chain of documents that share something.
A group is a connected component of matching documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as tk
from .components import connected_components, forest
from .exchange import binary, bounded_batches, drop, pack_sorted, partition_keys, partitions, saved, target, unpack_sorted, without, workspace

N, THRESHOLD = 5, 0.4
#: The most documents and n-grams that a task indexes, about: a home of more is cut into parts that are searched in tasks of their own.
BLOCK, BLOCK_GRAMS = 10_000, 4_000_000
_FLUSH = 1_000_000
_PAIR_ROWS = 200_000
#: An n-gram that more documents of a part have is a column of a matrix. The most cells of one, and of places that are merged at once.
_HEAVY, _CELLS, _COLUMNS = 64, 2_000_000, 1024
_BLOCKS = "key int, docs binary, sizes binary, grams binary, owner binary"
_PROBES = "key int, docs binary, sizes binary, homes binary, grams binary, owner binary, left binary"
_DOCS = "doc_id long, size int, grams binary, home long, sig long"


def _need(size, threshold: float):
    return np.maximum(1, np.ceil(threshold * size - 1e-9)).astype(np.int64)


def _block(keys: np.ndarray, docs: np.ndarray, of_docs: dict[str, np.ndarray], grams: np.ndarray, owner: np.ndarray, left: np.ndarray | None = None) -> pa.RecordBatch:
    """Cuts postings into one row for each partition; of_docs: what is sent with each document, owner: index into docs."""
    p = target(grams, len(keys))
    order = np.lexsort((grams, p))
    grams, owner, p = grams[order], owner[order], p[order]
    left = None if left is None else left[order].astype(np.int32)
    cuts = np.searchsorted(p, np.arange(len(keys) + 1))
    rows = []
    for k in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[k], cuts[k + 1]
        used, local = np.unique(owner[a:b], return_inverse=True)
        small = local.astype(np.uint16 if len(used) <= 65536 else np.uint32)
        rows.append((int(keys[k]), docs[used].tobytes(), *(x[used].astype(np.int32).tobytes() for x in of_docs.values()), pack_sorted(grams[a:b]), small.tobytes(), *([] if left is None else [left[a:b].tobytes()])))
    cols = list(zip(*rows, strict=True))
    names = ["key", "docs", *of_docs, "grams", "owner", *([] if left is None else ["left"])]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *map(binary, map(list, cols[1:]))], names=names)


def _postings(n: int, keys: np.ndarray):
    def run(batches):
        held, docs_seen, count = [], 0, 0

        def flush():
            d, s, g, o = (np.concatenate(x) for x in zip(*held, strict=True))
            return _block(keys, d, {"sizes": s}, g, o)

        for batch in batches:
            for part in tk.slices(batch, "text"):
                words, offs = tk.tokens(part.column("text"))
                grams, text = tk.unique_per_text(*tk.ngrams(words, offs, n))
                sizes = np.bincount(text, minlength=part.num_rows)
                held.append((part.column("doc_id").to_numpy(), sizes, grams, text + docs_seen))
                docs_seen, count = docs_seen + part.num_rows, count + len(grams)
                if count >= _FLUSH or docs_seen >= 60_000:
                    if count:
                        yield flush()
                    held, docs_seen, count = [], 0, 0
        if count:
            yield flush()

    return run


def _read_blocks(batches) -> tuple[np.ndarray, ...] | None:
    """(documents, the least size of their rows, n-grams, document number of each): distinct postings by n-gram and document."""
    docs, sizes, grams, owners = [], [], [], []
    for batch in batches:
        for d, s, g, o in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            g = unpack_sorted(g)
            docs.append(np.frombuffer(d, np.int64))
            sizes.append(np.frombuffer(s, np.int32))
            grams.append(g)
            owners.append(np.frombuffer(o, np.uint16 if len(o) == 2 * len(g) else np.uint32))
    if not docs:
        return None
    known, back = np.unique(np.concatenate(docs), return_inverse=True)
    size = np.full(len(known), np.iinfo(np.int32).max, dtype=np.int32)
    np.minimum.at(size, back, np.concatenate(sizes))
    del back
    owner = np.concatenate([np.searchsorted(known, d).astype(np.uint32)[o] for d, o in zip(docs, owners, strict=True)])
    del docs, sizes, owners
    gram = np.concatenate(grams)
    del grams
    order = np.lexsort((owner, gram))
    gram, owner = gram[order], owner[order]
    del order
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    return (known, size, gram, owner) if new.all() else (known, size, gram[new], owner[new])


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def _shared(keys: np.ndarray):
    """Keeps the n-grams that two documents or more have, with how many have them; sends them back by document."""

    def run(batches):
        got = _read_blocks(batches)
        if got is None:
            return
        known, known_sizes, grams, owner = got
        del got
        length = np.diff(_runs(grams))
        keep = np.repeat(length > 1, length)
        count = np.repeat(length[length > 1], length[length > 1]).astype(np.int32)
        grams, owner = grams[keep], owner[keep]
        if not len(grams):
            return
        docs, sizes = known[owner], known_sizes[owner]
        p = target(tk.mix(docs.view(np.uint64)), len(keys))
        order = np.lexsort((docs, p))
        docs, sizes, grams, count, p = docs[order], sizes[order], grams[order], count[order], p[order]
        cuts = np.searchsorted(p, np.arange(len(keys) + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[k], cuts[k + 1])
            each = _runs(docs[s])
            row = [docs[s][each[:-1]].tobytes(), sizes[s][each[:-1]].tobytes(), grams[s].tobytes(), np.diff(each).astype(np.int32).tobytes(), count[s].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([int(keys[k])], pa.int32()), *(binary([x]) for x in row)], names=["key", "docs", "sizes", "grams", "lengths", "counts"])

    return run


def _survivors(threshold: float):
    """Documents with enough shared n-grams to match any other, their n-grams from the rarest on, their home (by the least n-gram) and a
    signature of the set."""

    def run(batches):
        parts = []
        for batch in batches:
            for d, s, g, n, c in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                n = np.frombuffer(n, np.int32)
                parts.append((np.repeat(np.frombuffer(d, np.int64), n), np.repeat(np.frombuffer(s, np.int32), n), np.frombuffer(g, np.uint64), np.frombuffer(c, np.int32)))
        if not parts:
            return
        docs, sizes, grams, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((grams, count, docs))
        docs, sizes, grams, count = docs[order], sizes[order], grams[order], count[order]
        cuts = _runs(docs)
        least = np.minimum.reduceat(sizes, cuts[:-1])
        home = tk.mix(np.minimum.reduceat(grams, cuts[:-1])).view(np.int64)
        sig = np.add.reduceat(tk.mix(grams), cuts[:-1]).view(np.int64)
        ok = np.flatnonzero(np.diff(cuts) >= _need(least, threshold))
        for at in range(0, len(ok), 2000):
            some = ok[at : at + 2000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs[cuts[some]]), pa.array(least[some]), binary([grams[cuts[i] : cuts[i + 1]].tobytes() for i in some]), pa.array(home[some]), pa.array(sig[some])],
                names=["doc_id", "size", "grams", "home", "sig"],
            )

    return run


def _prefixes(threshold: float, keys: np.ndarray):
    """Each survivor's rarest n-grams, of which two that match must share one, with how many of its n-grams are left from there on."""

    def run(batches):
        for batch in batches:
            docs, sizes, homes = (batch.column(c).to_numpy() for c in ("doc_id", "size", "home"))
            grams = [np.frombuffer(g, np.uint64) for g in batch.column("grams").to_pylist()]
            length = np.array([len(g) for g in grams], dtype=np.int64)
            most = np.maximum(length - _need(sizes, threshold) + 1, 0)
            if most.sum():
                owner = np.repeat(np.arange(len(docs)), most)
                left = length[owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(most) - most, most))
                yield _block(keys, docs, {"sizes": sizes, "homes": homes}, np.concatenate([g[:n] for g, n in zip(grams, most, strict=True)]), owner, left)

    return run


def _visits(threshold: float):
    """(document, home) for the homes beyond a document's own in which one of its rarest n-grams occurs in a document that could match it."""

    def run(batches):
        parts, seen = [], 0
        for batch in batches:
            for d, s, h, g, o, n in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                g = unpack_sorted(g)
                o = np.frombuffer(o, np.uint16 if len(o) == 2 * len(g) else np.uint32)
                parts.append((np.frombuffer(d, np.int64), np.frombuffer(s, np.int32), np.frombuffer(h, np.int32), g, o.astype(np.int64) + seen, np.frombuffer(n, np.int32)))
                seen += len(d) // 8
        if not parts:
            return
        docs, sizes, homes, grams, owner, left = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((homes[owner], grams))
        grams, owner, left = grams[order], owner[order], left[order]
        home, size = homes[owner], sizes[owner].astype(np.float64)
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (home[1:] != home[:-1])
        at = np.flatnonzero(new)  # the documents of one home with the n-gram, together
        group = np.cumsum(new) - 1
        of_run = grams[at]
        least, largest, most = np.minimum.reduceat(size, at), np.maximum.reduceat(size, at), np.maximum.reduceat(left, at)
        last = np.searchsorted(of_run, of_run, "right")[group]
        count = last - group - 1  # the homes after its own
        pairs = np.zeros(0, dtype=np.int64)
        width = int(homes.max()) + 1
        step = np.cumsum(count) // _FLUSH
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(count)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            n = count[a:b]
            i = np.repeat(np.arange(a, b), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + group[i] + 1
            bound = threshold / (1 + threshold) * (size[i] + np.maximum(least[j], threshold * size[i]))
            ok = (largest[j] >= threshold * size[i] - 1e-9) & (least[j] * threshold <= size[i] + 1e-9) & (np.minimum(left[i], most[j]) >= bound - 1e-6)
            pairs = np.union1d(pairs, owner[i[ok]] * width + home[at[j[ok]]])
        for k in range(0, len(pairs), 100_000):
            some = pairs[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(docs[some // width]), pa.array((some % width).astype(np.int32))], names=["doc_id", "part"])

    return run


class Lists:
    """Inverted lists over sets of n-grams: `search` finds the sets that share at least `need` with a query."""

    def __init__(self, grams: np.ndarray, owner: np.ndarray):
        order = np.lexsort((owner, grams))
        self.owner = owner[order]
        self.cuts = _runs(grams[order]) if len(grams) else np.zeros(1, dtype=np.int64)
        self.grams = grams[order][self.cuts[:-1]]
        self.length = np.diff(self.cuts)

    def search(self, query: np.ndarray, need: int, skip=None) -> tuple[np.ndarray, np.ndarray]:
        """(owners, overlaps). skip: given owners, which of them are of no interest."""
        at = np.searchsorted(self.grams, query)
        at = at[at < len(self.grams)] if len(at) and at[-1] >= len(self.grams) else at
        at = at[self.grams[at] == query[: len(at)]]
        none = np.zeros(0, dtype=np.int64)
        if len(at) < need:
            return none, none
        at = at[np.argsort(self.length[at], kind="stable")]
        longest = int(self.length[at[-1]])
        # DivideSkip's split; T - 1 long lists at most, and none where every list is short
        long_ = min(need - 1, int(need / (0.0085 * math.log2(longest + 1) + 1))) if longest > 8 else 0
        split = len(at) - long_
        length = self.length[at[:split]]
        ends = np.cumsum(length)
        where = np.repeat(self.cuts[at[:split]] - (ends - length), length) + np.arange(int(ends[-1]) if split else 0)
        merged = np.sort(self.owner[where], kind="stable")  # the runs are sorted: a merge
        cuts = _runs(merged) if len(merged) else np.zeros(1, dtype=np.int64)
        found, count = merged[cuts[:-1]], np.diff(cuts)
        ok = count >= need - long_
        if skip is not None and ok.any():
            ok[ok] = ~skip(found[ok])
        found, count = found[ok], count[ok]
        for i, k in enumerate(at[split:]):  # the shortest of the long lists first
            if not len(found):
                break
            own = self.owner[self.cuts[k] : self.cuts[k + 1]]
            pos = np.minimum(np.searchsorted(own, found), len(own) - 1)
            count = count + (own[pos] == found)
            left = count + (long_ - 1 - i) >= need
            found, count = found[left], count[left]
        ok = count >= need
        return found[ok], count[ok]


def _groups_of(docs: np.ndarray, sizes: np.ndarray, grams: list[np.ndarray], threshold: float) -> np.ndarray:
    """The label (index of the group's first document) of each document of a block; docs ascend, grams are sorted arrays."""
    m = len(docs)
    label = np.arange(m)
    members: dict[int, list[int]] = {i: [i] for i in range(m)}

    def union(a: int, b: int) -> None:
        a, b = sorted((label[a], label[b]))
        if a != b:
            label[members[b]] = a
            members[a] += members.pop(b)

    key = [g.tobytes() for g in grams]
    same: dict[tuple[int, bytes], int] = {}
    for i in range(m):  # equal sets: those of equal size whose shared n-grams are all of them
        if len(grams[i]) == sizes[i]:
            union(same.setdefault((int(sizes[i]), key[i]), i), i)
    distinct = np.flatnonzero(label == np.arange(m))
    if len(distinct) < 2:
        return label
    lengths = np.array([len(grams[i]) for i in distinct])
    all_grams, owner = np.concatenate([grams[i] for i in distinct]), np.repeat(distinct, lengths)
    needs = _need(sizes, threshold)

    def matches(i: int, found: np.ndarray, count: np.ndarray) -> np.ndarray:
        return found[count >= threshold * (sizes[i] + sizes[found] - count) - 1e-9]

    index, searched = Lists(all_grams, owner), np.zeros(m, dtype=bool)
    for i in distinct:  # the first of each group searches all documents
        if label[i] == i and len(members[i]) == 1 or not searched[label[i]] and label[i] == i:
            searched[i] = True
            for j in matches(i, *index.search(grams[i], int(needs[i]), lambda f, i=i: label[f] == label[i])):
                union(i, j)
    rest = distinct[~searched[distinct]]
    if len(rest):  # the others search the unions of groups, then the members of those that could hold a match
        group = label[owner]
        by_group = Lists(*_distinct(all_grams, group))
        snapshot = label.copy()
        of_group: dict[int, list[int]] = {}
        for j in distinct:
            of_group.setdefault(int(snapshot[j]), []).append(j)
        for i in rest:
            found, _ = by_group.search(grams[i], int(needs[i]), lambda f, i=i: label[f] == label[i])
            for g in found:
                if label[g] == label[i]:
                    continue
                for j in of_group[int(g)]:
                    lo, hi = sorted((int(sizes[i]), int(sizes[j])))
                    if lo >= threshold * hi - 1e-9:
                        both = np.intersect1d(grams[i], grams[j], assume_unique=True).size
                        if both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9:
                            union(i, j)
                            break
    return label


def _distinct(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owner, grams))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], owner[new]


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(documents in ascending order, sizes, sorted n-grams, whether each is at home)."""
    docs = table.column("doc_id").to_numpy()
    order = np.argsort(docs, kind="stable")
    raw = table.column("grams").to_pylist()
    return docs[order], table.column("size").to_numpy().astype(np.int64)[order], [np.sort(np.frombuffer(raw[i], np.uint64)) for i in order], table.column("member").to_numpy()[order]


def _search(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        docs, sizes, grams, _ = _unpacked(table)
        first = docs[_groups_of(docs, sizes, grams, threshold)]
        other = first != docs
        return pa.table({"u": pa.array(docs[other]), "v": pa.array(first[other])})

    return run


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length says."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _matrix(row: np.ndarray, column: np.ndarray, rows: int, columns: int, kind: type) -> np.ndarray:
    out = np.zeros((rows, columns), dtype=kind)
    out[row, column] = 1
    return out


def _matches(sizes: np.ndarray, grams: list[np.ndarray], member: np.ndarray, asks: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, member, overlap) of all that match, in bounded arrays: asks tells the queries; two members meet once, the first as the query.

    Documents that share an n-gram that more than `_HEAVY` members have, or are connected by such ones, are a cluster. Two of a cluster
    get their overlap in those n-grams from a product of matrices, unless they are so sparse that lists are faster, and the rest from lists.
    """
    m, every = len(sizes), np.concatenate([*grams, np.zeros(0, dtype=np.uint64)])
    doc = np.repeat(np.arange(m), [len(g) for g in grams])
    kinds, code = np.unique(every, return_inverse=True)
    at_home = np.bincount(code[member[doc]], minlength=len(kinds))
    at_home[np.bincount(code, minlength=len(kinds)) < 2] = 0
    keep = at_home[code] > 0
    del every, kinds
    code, doc = code[keep], doc[keep]
    own = np.flatnonzero(member[doc])
    owner = doc[own[np.argsort(code[own], kind="stable")]]  # of each n-gram's list one after the other, ascending
    starts = np.cumsum(at_home) - at_home

    cluster, light, columns = np.full(m, -1), np.ones(len(code), dtype=bool), {}
    heavy = np.flatnonzero(at_home[code] > _HEAVY)
    if len(heavy):
        label = np.arange(m)
        node, first = forest(doc[heavy], m + code[heavy])
        label[node[node < m]] = first[node < m]
        order = heavy[np.argsort(label[doc[heavy]], kind="stable")]
        cuts = _runs(label[doc[order]])
        for a, b in zip(cuts, cuts[1:], strict=False):
            of = order[a:b]
            local, column = np.unique(code[of], return_inverse=True)
            asked, here = doc[of][asks[doc[of]]], np.unique(doc[of][member[doc[of]]])
            by_lists = float(at_home[code[of[asks[doc[of]]]]].sum())
            if 250.0 * by_lists > float(len(np.unique(asked))) * len(here) * (len(local) + 50):
                which = label[doc[of[0]]]
                cluster[doc[of]], light[of] = which, False
                columns[int(which)] = (here, doc[of], column, len(local))
    code, doc = code[light], doc[light]
    each = at_home[code]
    work = np.bincount(doc, each, m).astype(np.int64)
    for which, (here, *_) in columns.items():
        work[cluster == which] += len(here)
    first = np.searchsorted(doc, np.arange(m + 1))
    kind = np.float32 if len(sizes) == 0 or sizes.max() < 1 << 24 else np.float64  # both exact

    def passed(q: np.ndarray, d: np.ndarray, count: np.ndarray):
        ok = (count >= threshold * (sizes[q] + sizes[d] - count) - 1e-9) & (~member[q] | (d > q))
        return q[ok], d[ok], count[ok]

    queries = np.flatnonzero(asks & (work > 0))
    queries = queries[np.lexsort((queries, ~member[queries], cluster[queries]))]
    step = np.cumsum(work[queries]) // _CELLS
    new = (step[1:] != step[:-1]) | (cluster[queries[1:]] != cluster[queries[:-1]])
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(queries)]
    held = -1
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        some = queries[a:b]
        at = _places(first[some], first[some + 1] - first[some])
        local = np.repeat(np.arange(len(some)), first[some + 1] - first[some])
        count = np.zeros(0, dtype=np.int64)
        q = d = count
        if int(each[at].sum()) <= 2 * _CELLS:
            met = local[np.repeat(np.arange(len(at)), each[at])] * m + owner[_places(starts[code[at]], each[at])]
            met, count = np.unique(met, return_counts=True)
            q, d = met // m, met % m
        else:  # of few documents with very many n-grams, one after the other
            for i in range(len(some)):
                mine = at[local == i]
                total = np.zeros(m, dtype=np.int64)
                pieces = np.cumsum(each[mine]) // _CELLS
                for part in np.split(mine, np.flatnonzero(np.diff(pieces)) + 1):
                    total += np.bincount(owner[_places(starts[code[part]], each[part])], minlength=m)
                found = np.flatnonzero(total)
                q, d, count = np.append(q, np.full(len(found), i)), np.append(d, found), np.append(count, total[found])
        which = int(cluster[some[0]])
        if which < 0:
            yield passed(some[q], d, count)
            continue
        here, of, column, width = columns[which]
        if held != which:
            place = np.full(m, -1)
            place[here] = np.arange(len(here))
            begin = np.searchsorted(of, np.arange(m + 1))
            held = which
        since = int(np.searchsorted(here, some.min())) if member[some].all() else 0  # members meet those after them
        overlap = np.zeros((len(some), len(here) - since), dtype=kind)
        row = np.full(m, -1)
        row[some] = np.arange(len(some))
        mine = _places(begin[some], begin[some + 1] - begin[some])
        theirs = np.flatnonzero(place[of] >= since)
        for c in range(0, width, _COLUMNS):
            x, y = mine[(column[mine] >= c) & (column[mine] < c + _COLUMNS)], theirs[(column[theirs] >= c) & (column[theirs] < c + _COLUMNS)]
            n = min(_COLUMNS, width - c)
            overlap += _matrix(row[of[x]], column[x] - c, len(some), n, kind) @ _matrix(place[of[y]] - since, column[y] - c, len(here) - since, n, kind).T
        inside = place[d] >= since
        outside = place[d] < 0
        overlap[q[inside], place[d[inside]] - since] += count[inside]
        if outside.any():
            yield passed(some[q[outside]], d[outside], count[outside])
        bound = (threshold / (1 + threshold) * (1 - 1e-5) * sizes).astype(kind)
        q, d = np.nonzero(overlap >= (bound[some] - 1)[:, None] + bound[here[since:]][None, :])
        yield passed(some[q], here[since + d], overlap[q, d].astype(np.int64))


def _task(batches: Iterator[pa.RecordBatch], threshold: float):
    """(the table in the order of its documents, the documents, their sizes, all matches within a part of a home and between it and its visitors); visitors meet each other elsewhere."""
    table = pa.Table.from_batches(batches)
    docs, sizes, grams, member = _unpacked(table)
    table = table.drop_columns("grams").take(pa.array(np.argsort(table.column("doc_id").to_numpy(), kind="stable")))
    asks = np.ones(len(docs), dtype=bool) if table.column("chunk")[0].as_py() == 0 else ~member  # of several tasks with the same part, one compares its own documents
    return table, docs, sizes, _matches(sizes, grams, member, asks, threshold)


def _all_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, docs, sizes, matches = _task(batches, threshold)
        for q, d, count in matches:
            score = count / (sizes[q] + sizes[d] - count)
            x, y = docs[q], docs[d]
            for k in range(0, len(x), _PAIR_ROWS):
                s = slice(k, k + _PAIR_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[s], y[s])), pa.array(np.maximum(x[s], y[s])), pa.array(score[s])], names=["doc_a", "doc_b", "jaccard"])

    return run


def _links(threshold: float):
    """(doc_id, the least document that those found here connect it to, how many it matches here, with their copies) of those that match any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, docs, _, matches = _task(batches, threshold)
        times = table.column("times").to_numpy().astype(np.float64)
        m = len(docs)
        links, label = np.zeros(m), np.arange(m)
        for q, d, _ in matches:
            links += np.bincount(q, times[d], m) + np.bincount(d, times[q], m)
            a, b = label[q], label[d]
            if (apart := a != b).any():
                node, least = forest(a[apart], b[apart])
                to = np.arange(m)
                to[node] = least
                label = to[label]
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(docs[some]), pa.array(docs[label[some]]), pa.array(links[some].astype(np.int64))], names=["doc_id", "least", "links"])

    return run


def _sizes_of_repeated(texts: DataFrame, n: int, folder: str) -> DataFrame | None:
    """(doc_id, size) of the documents that several rows make up, where there are any: how many n-grams those have together."""
    ids = saved(texts.groupBy("doc_id").count().where("count > 1").select("doc_id"), folder, "repeated")
    if ids.isEmpty():
        return None

    def grams(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                g, text = tk.unique_per_text(*tk.ngrams(*tk.tokens(part.column("text")), n))
                yield pa.RecordBatch.from_arrays([pa.array(part.column("doc_id").to_numpy()[text]), pa.array(g.view(np.int64))], names=["doc_id", "gram"])

    rows = texts.join(ids, "doc_id", "left_semi").mapInArrow(tk.trimmed(grams), "doc_id long, gram long")
    return saved(rows.distinct().groupBy("doc_id").agg(F.count("*").cast("int").alias("exact")), folder, "exact")


def _blocks(docs: DataFrame, threshold: float, n: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their shared n-grams by part of a home, as members and as visitors; (u, v): documents u with the same set as v)."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold is in (0, 1], n is 1 or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    keys = partition_keys(p := partitions(spark))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    exact = _sizes_of_repeated(texts, n, folder)
    shared = texts.mapInArrow(tk.trimmed(_postings(n, keys)), _BLOCKS).repartition(p, "key").mapInArrow(tk.trimmed(_shared(keys)), "key int, docs binary, sizes binary, grams binary, lengths binary, counts binary")
    survivors = saved(shared.repartition(p, "key").mapInArrow(tk.trimmed(_survivors(threshold)), _DOCS), folder, "survivors")
    if exact is not None:
        sized = survivors.join(exact, "doc_id", "left").withColumn("size", F.coalesce("exact", "size")).drop("exact")
        survivors = saved(sized.select(*(c.split()[0] for c in _DOCS.split(", "))), folder, "sized")

    same = survivors.where(F.length("grams") == 8 * F.col("size")).select("doc_id", "size", "sig", "home")
    first = same.groupBy("size", "sig", "home").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = saved(same.join(first, ["size", "sig", "home"]).where("doc_id <> v").select(F.col("doc_id").alias("u"), "v"), folder, "copies")

    total = survivors.agg(F.count("*"), F.coalesce(F.sum(F.length("grams")), F.lit(0))).first()
    width = min(1 << 30, max(p, math.ceil(4 * total[0] / BLOCK), math.ceil(total[1] / 2 / BLOCK_GRAMS)))
    homed = survivors.withColumn("home", F.pmod("home", F.lit(width)).cast("int"))
    visits = homed.mapInArrow(tk.trimmed(_prefixes(threshold, keys)), _PROBES).repartition(p, "key").mapInArrow(tk.trimmed(_visits(threshold)), "doc_id long, part int").distinct()
    light = homed.select("doc_id", F.col("home").alias("part"), (F.length("grams") / 8).alias("weight"), F.lit(True).alias("member"))
    visits = visits.join(light.select("doc_id", "weight"), "doc_id").select("doc_id", "part", "weight", F.lit(False).alias("member"))
    placed = light.unionByName(visits).join(copies.select(F.col("u").alias("doc_id")), "doc_id", "left_anti")
    placed = saved(placed, folder, "placed")

    many = lambda who: F.greatest(F.lit(1), F.ceil(F.greatest(F.count_if(who) / BLOCK, F.sum(F.when(who, F.col("weight"))) / BLOCK_GRAMS))).cast("int")
    cut = placed.groupBy("part").agg(many(F.col("member")).alias("subs"), many(~F.col("member")).alias("chunks"))
    draw = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    rows = placed.join(cut, "part").withColumn("own", F.when(F.col("member"), draw(F.col("subs"))))
    # a member is in its own part in every task of it, and visits those before; a visitor is in one task of every part
    spots = F.transform(F.sequence(F.lit(0), F.coalesce("own", F.col("subs") - 1)), lambda s: F.struct(s.alias("sub"), F.coalesce(s == F.col("own"), F.lit(False)).alias("member")))
    rows = rows.select("doc_id", "part", "chunks", F.explode(spots).alias("spot"))
    tasks = F.when(F.col("spot.member"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(draw(F.col("chunks"))))
    rows = rows.select("doc_id", "part", "spot.sub", "spot.member", F.explode(tasks).alias("chunk"))
    return homed.select("doc_id", "size", "grams").join(rows, "doc_id"), copies


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_a, doc_b, jaccard) of every pair of documents whose index is `threshold` or more, doc_a < doc_b; each pair once.

    Words, short and wordless texts, nulls, repeated rows and empty tables are as in `near_copies`. In a group of m copies there are
    m (m - 1) / 2 rows.
    """
    spark = docs.sparkSession
    folder = workspace(spark)
    inside, copies = _blocks(docs, threshold, n, folder)
    found = saved(inside.groupBy("part", "sub", "chunk").applyInArrow(_all_pairs(threshold), "doc_a long, doc_b long, jaccard double"), folder, "pairs")
    drop(spark, f"{folder}/survivors")
    if copies.isEmpty():
        return found
    sets = copies.unionByName(copies.select(F.col("v").alias("u"), "v").distinct())
    a, b = (sets.select(F.col("v").alias(f"v{x}"), F.col("u").alias(f"u{x}")) for x in "ab")
    wide = found.join(a, F.col("doc_a") == F.col("va"), "left").join(b, F.col("doc_b") == F.col("vb"), "left").select(F.coalesce("ua", "doc_a").alias("x"), F.coalesce("ub", "doc_b").alias("y"), "jaccard")
    alike = a.join(b, F.col("va") == F.col("vb")).where("ua < ub").select(F.col("ua").alias("x"), F.col("ub").alias("y"), F.lit(1.0).alias("jaccard"))
    return wide.unionByName(alike).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_id, class_id, links) of every document, once: links is with how many other documents its index is `threshold` or more, and
    class_id the least doc_id of those that such links connect, its own where there are none.

    Words and repeated rows are as in `near_copies`; a text without words and a null text have no links. Rows without doc_id have no row.
    """
    spark = docs.sparkSession
    folder = workspace(spark)
    inside, copies = _blocks(docs, threshold, n, folder)
    times = copies.groupBy(F.col("v").alias("doc_id")).agg((F.count("*") + 1).alias("times"))
    inside = inside.join(times, "doc_id", "left").withColumn("times", F.coalesce("times", F.lit(1)))
    found = saved(inside.groupBy("part", "sub", "chunk").applyInArrow(_links(threshold), "doc_id long, least long, links long"), folder, "found")
    drop(spark, f"{folder}/survivors")
    classes = connected_components(found.select("doc_id", "least").unionByName(copies.select(F.col("u").alias("doc_id"), F.col("v").alias("least"))))
    links = found.select(F.col("doc_id").alias("v"), "links").unionByName(times.select(F.col("doc_id").alias("v"), (F.col("times") - 1).alias("links"))).groupBy("v").agg(F.sum("links").alias("links"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    rows = rows.join(copies.withColumnRenamed("u", "doc_id"), "doc_id", "left").withColumn("v", F.coalesce("v", "doc_id")).join(links, "v", "left")
    rows = rows.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_id, rep_id) for every document that has a near copy: rep_id is the least doc_id of its group.

    The group's least document has no row. Words are those of `textkit.tokens`, so case, punctuation
    and line breaks don't count. A text of 1 to n - 1 words is one n-gram; a text without words, a
    null text and a row without doc_id match nothing. Rows that repeat a doc_id are one document, whose
    n-grams are those of all of them. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = workspace(spark)
    inside, copies = _blocks(docs, threshold, n, folder)
    found = saved(inside.groupBy("part", "sub", "chunk").applyInArrow(_search(threshold), "u long, v long"), folder, "found")
    drop(spark, f"{folder}/survivors")
    return connected_components(found.unionByName(copies)).select(F.col("node").alias("doc_id"), F.col("root").alias("rep_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays; all columns are kept.

    Rows that repeat a doc_id are copies too: the one with the least text stays (a null after all texts; of equal texts that with the
    least hash of the row), whatever the order of the rows. Rows without doc_id stay.
    """
    copies = near_copies(docs, threshold, n).select("doc_id")
    folder = workspace(docs.sparkSession)
    repeated = saved(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1").select("doc_id"), folder, "repeated")
    if repeated.isEmpty():
        return without(docs, copies)
    columns = [f"`{c}`" for c in docs.columns]
    again = docs.join(repeated.withColumnRenamed("doc_id", "__moraine_id"), docs["doc_id"] == F.col("__moraine_id"), "left_semi")
    order = W.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*(F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"}) for c in columns)))
    one = again.withColumn("__moraine_row", F.row_number().over(order)).where("__moraine_row = 1").select(*columns)
    return without(without(docs, repeated).select(*columns).unionByName(one), copies)


def op10_ngram_jaccard(spark, sf_dir: str, form=near_copies) -> DataFrame:
    return form(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_ngram_jaccard": partial(op10_ngram_jaccard, form=near_classes)}
ORACLE: dict[str, str] = {}
