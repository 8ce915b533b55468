"""Token counts by compiled finite-state transducers, equal to those of the byte-level BPE tokenizer compiled.

Two deterministic transducers in a row:

* The splitter reads classes of characters and cuts a text into words as the tokenizer's pattern does. It has 11 states; its transitions emit
  where words begin (a cut can be settled one character late: the pattern looks ahead). A text is cut into chunks that
  are run all at once, from every state: a chunk's result is a map from states to states. The maps are composed by a parallel prefix
  scan, which gives each chunk its true first state, and the chunks are run again from there.
* The counter reads the bytes of a word. A state is the prefix read (made when first met), with the last token of its encoding and the number
  of tokens so far; the transition to a longer prefix carries the change of that number. The last token of a prefix is the one token ending there that is
  compatible with the last token before it: two tokens are if merging in the order of ranks leaves their border alone, which
  is read off the merge trees of both. No merge loop runs over the text. The states are not compiled ahead: they are as many as
  prefixes, so this part is a dynamic program over the vocabulary's hashes that makes those it meets.

Counters are run once for each distinct word of a slice of text, all words a byte at a time. A long word is cut into chunks. What follows a place depends on
the last tokens (and the numbers of tokens) of the places within the longest token before it, so that is a state; each chunk is run from some
bytes before it, all chunks at once, and its number of tokens counts if the state in which it began is that in which the chunk before ended. Chunks
for which it isn't, as in runs of one character, are run again from the true state, equal ones once.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 256
#: Words of more bytes are cut into chunks of STEP, in batches of about CELLS states.
LONG, STEP, CELLS = 1_024, 512, 2_000_000
KNOWN = 2_000_000

# classes of characters: letters by what a contraction needs, numbers, blank, other white space, apostrophe, others, end of text
ONE, TWO, E, ELL, LETTER, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER, STOP = range(11)
CLASSES = 11
# states: a word ended; in letters, numbers, others; after ', 'r or 'v, 'l; one blank, one other space, more space that ends with a blank or not
FRESH, LETTERS, NUMBERS, OTHERS, QUOTE, QUOTE_RV, QUOTE_L, BLANK1, SPACE1, BLANKS, SPACES = range(11)
STATES = 11
HERE, BEFORE = 1, 2  # a word begins with this character, with the one before


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what is emitted) by state and class."""
    to, out = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    letters, others = (ONE, TWO, E, ELL, LETTER), (APOSTROPHE, OTHER)
    first = {**dict.fromkeys(letters, LETTERS), NUMBER: NUMBERS, BLANK: BLANK1, SPACE: SPACE1, APOSTROPHE: QUOTE, OTHER: OTHERS}

    def go(state, kinds, target, emit=0):
        for k in kinds:
            to[state, k], out[state, k] = target, emit

    for state in range(STATES):
        for kind, target in first.items():
            go(state, [kind], target, HERE)
        go(state, [STOP], FRESH)
    go(LETTERS, letters, LETTERS)
    go(NUMBERS, [NUMBER], NUMBERS)
    go(OTHERS, others, OTHERS)
    go(QUOTE, [ONE], FRESH)
    go(QUOTE, [TWO], QUOTE_RV)
    go(QUOTE, [ELL], QUOTE_L)
    go(QUOTE, others, OTHERS)
    for state, last in ((QUOTE_RV, E), (QUOTE_L, ELL)):
        for kind in range(CLASSES):
            to[state, kind], out[state, kind] = to[LETTERS, kind], out[LETTERS, kind] | BEFORE
        go(state, [last], FRESH)
    for state in (BLANK1, BLANKS):
        emit = BEFORE if state == BLANKS else 0
        go(state, letters, LETTERS, emit)
        go(state, [NUMBER], NUMBERS, emit)
        go(state, others, OTHERS, emit)
    for kind, target in first.items():
        go(SPACES, [kind], target, HERE | BEFORE)
    for state in (BLANK1, SPACE1, BLANKS, SPACES):
        go(state, [BLANK], BLANKS)
        go(state, [SPACE], SPACES)
    return to, out


@cache
def _classes() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        g = unicodedata.category(chr(c))[0]
        if g == "L":
            kinds[c] = LETTER
        elif g == "N":
            kinds[c] = NUMBER
    kinds[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    for text, kind in ((" ", BLANK), ("'", APOSTROPHE), ("stmd", ONE), ("rv", TWO), ("e", E), ("l", ELL)):
        kinds[[ord(c) for c in text]] = kind
    return kinds


def first_states(kinds: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The state before each chunk; kinds: (place in the chunk, chunk)."""
    flat = to.astype(np.uint16).ravel()
    maps = np.repeat(np.arange(STATES, dtype=np.uint16)[:, None], kinds.shape[1], axis=1)
    for row in kinds.astype(np.uint16):
        maps = flat[maps * np.uint16(CLASSES) + row]
    maps = maps.astype(np.int64)
    step, chunks = 1, np.arange(kinds.shape[1])
    while step < kinds.shape[1]:  # maps[:, j] becomes the map of the 2 * step chunks that end with j
        maps[:, step:] = maps[maps[:, : kinds.shape[1] - step], chunks[step:]]
        step *= 2
    return np.concatenate([[FRESH], maps[FRESH, :-1]])


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """Where words begin, for a sequence of classes in which every text ends with STOP."""
    to, out = splitter()
    n = len(kinds)
    padded = np.full(-(-n // CHUNK) * CHUNK, STOP, np.uint8)
    padded[:n] = kinds
    by_place = np.ascontiguousarray(padded.reshape(-1, CHUNK).T)
    state = first_states(by_place, to).astype(np.uint16)
    emitted = np.empty_like(by_place)
    flat_to, flat_out = to.astype(np.uint16).ravel(), out.ravel()
    for i, row in enumerate(by_place):
        at = state * np.uint16(CLASSES) + row
        emitted[i] = flat_out[at]
        state = flat_to[at]
    emitted = emitted.T.ravel()[:n]
    begins = (emitted & HERE) > 0
    begins[:-1] |= (emitted[1:] & BEFORE) > 0
    return np.flatnonzero(begins)


_INVERSE = pow(tk._P, -1, 1 << 64)


@cache
def _inverse_powers(n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * _INVERSE & tk._M
    return out


def _raw(data: bytes) -> int:
    h, p = 0, 1
    for b in data:
        h = h + (b + 1) * p & tk._M
        p = p * tk._P & tk._M
    return h


class Counter:
    """The word transducer of a vocabulary (bytes -> rank; all 256 bytes must be there)."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has every byte")
        tokens = sorted(ranks, key=ranks.get)
        self.longest = max(map(len, tokens))
        self.sizes = sorted({len(t) for t in tokens}, reverse=True)
        self.memo: dict[tuple, tuple] = {}
        self.fits_of: dict[tuple[int, int], bool] = {}
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.hash = np.array([_raw(t) for t in tokens], dtype=np.uint64)
        index = {t: i for i, t in enumerate(tokens)}
        # ranks in order without gaps, single bytes first: they are never formed by a merge
        order = np.array([ranks[t] for t in tokens], dtype=np.int64)
        self.rank = np.where(self.length == 1, -1, order)
        self.left, self.right = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        for i, t in enumerate(tokens):
            if len(t) > 1:
                a, b = _last_merge(t, ranks)
                self.left[i], self.right[i] = index[a], index[b]
        sorted_ = np.argsort(self.hash, kind="stable")
        self.keys, self.ids = self.hash[sorted_], sorted_
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.hash >> np.uint64(42)).astype(np.int64)] = True
        self.power = tk._powers(self.longest + 1)
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """The token of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
        ids = self.ids[at]
        same = (self.keys[at] == hashes[some]) & (self.length[ids] == (length if isinstance(length, int) else length[some]))
        out[some[same]] = ids[same]
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between tokens a and b alone: walks the right edge of a's merge tree and the left one of b's back in time."""
        never = np.int64(1) << 40
        ok = np.ones(len(a), dtype=bool)
        a, b = a.copy(), b.copy()
        until_a, until_b = np.full(len(a), never), np.full(len(a), never)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            size = self.length[x] + self.length[y]
            merged = self.find(self.hash[x] + self.hash[y] * self.power[self.length[x]], size)
            rank = np.where((merged >= 0) & (size <= self.longest), self.rank[merged], never)
            crossed = (rank < until_a[live]) & (rank <= until_b[live]) & (rank < never)
            ok[live[crossed]] = False
            later = self.rank[x] > self.rank[y]
            over = (self.rank[x] < 0) & (self.rank[y] < 0)
            until_a[live[later]], a[live[later]] = self.rank[x[later]], self.right[x[later]]
            until_b[live[~later]], b[live[~later]] = self.rank[y[~later]], self.left[y[~later]]
            live = live[~crossed & ~over]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.pairs, key)
        known = np.zeros(len(key), dtype=bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == key[inside]
        if not known.all():
            new = np.unique(key[~known])
            fits = self._compatible(new >> 32, new & 0xFFFFFFFF)
            if len(self.pairs) > KNOWN:
                self.pairs, self.fits = new, fits
                keep = np.unique(key[known])
                if len(keep):
                    new, fits = keep, self._compatible(keep >> 32, keep & 0xFFFFFFFF)
                    self.pairs, self.fits = np.append(self.pairs, new), np.append(self.fits, fits)
            else:
                self.pairs, self.fits = np.append(self.pairs, new), np.append(self.fits, fits)
            order = np.argsort(self.pairs, kind="stable")
            self.pairs, self.fits = self.pairs[order], self.fits[order]
            at = np.searchsorted(self.pairs, key)
        return self.fits[at]

    def _run(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last token, number of tokens) of every prefix of words, by length and word; lens descend."""
        most, n = int(lens[0]), len(lens)
        prefix = np.zeros((most + 1, n), np.uint64)
        last, count = np.zeros((most + 1, n), np.int64), np.zeros((most + 1, n), np.int32)
        inverse, power = _inverse_powers(most + 1), tk._powers(most)
        for i in range(1, most + 1):
            live = int(np.searchsorted(-lens, -i, "right"))  # words of i bytes or more come first
            prefix[i, :live] = prefix[i - 1, :live] + (raw[starts[:live] + i - 1].astype(np.uint64) + np.uint64(1)) * power[i - 1]
            open_ = np.arange(live)
            for size in self.sizes:
                if size > i:
                    continue
                token = self.find((prefix[i, open_] - prefix[i - size, open_]) * inverse[i - size], size)
                hit = np.flatnonzero(token >= 0)
                if not len(hit):
                    continue
                word = open_[hit]
                fits = np.ones(len(hit), dtype=bool) if size == i else self.compatible(last[i - size, word], token[hit])
                word = word[fits]
                last[i, word], count[i, word] = token[hit[fits]], count[i - size, word] + 1
                rest = np.ones(len(open_), dtype=bool)
                rest[hit[fits]] = False
                open_ = open_[rest]
                if not len(open_):
                    break
        return last, count

    def _long(self, data: np.ndarray) -> int:
        """The count of one long word, by chunks."""
        n, w = len(data), self.longest
        begins = np.arange(0, n, STEP)
        starts = np.maximum(begins - 2 * w, 0)
        ends = np.minimum(begins + STEP, n)
        total, state = 0, (np.full(w, -1, np.int64), np.zeros(w, np.int64))  # of the places before the next chunk, the nearest last; -1: none
        for a in range(0, len(begins), each := max(1, CELLS // (STEP + 2 * w))):
            some = np.arange(a, min(a + each, len(begins)))
            some = some[np.argsort(starts[some] - ends[some], kind="stable")]
            last, count = self._run(data, starts[some], ends[some] - starts[some])
            for j in range(a, min(a + each, len(begins))):
                k = int(np.flatnonzero(some == j)[0])
                at, end = int(begins[j] - starts[j]), int(ends[j] - starts[j])
                if j == 0 or self._same(state, self._state(last, count, k, at)):
                    total += int(count[end, k] - count[at, k])
                    state = self._state(last, count, k, end)
                else:
                    added, state = self._again(data, int(begins[j]), int(ends[j]), state)
                    total += added
        return total

    def _state(self, last: np.ndarray, count: np.ndarray, k: int, at: int) -> tuple[np.ndarray, np.ndarray]:
        """(last tokens, numbers of tokens less that at the place itself) of the places from `longest` - 1 before a place up to it."""
        w = self.longest
        tokens, numbers = np.full(w, -1, np.int64), np.zeros(w, np.int64)
        own = slice(max(0, at + 1 - w), at + 1)
        size = own.stop - own.start
        tokens[w - size :], numbers[w - size :] = last[own, k], count[own, k] - count[at, k]
        if own.start == 0:
            tokens[w - size] = -1  # nothing is before the word
        return tokens, numbers

    @staticmethod
    def _same(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
        return bool((a[0] == b[0]).all() and (a[1] == b[1]).all())

    def _again(self, data: np.ndarray, begin: int, end: int, state: tuple[np.ndarray, np.ndarray]) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
        """(tokens of a chunk, the state after it) from the true state before it, a byte at a time."""
        w = self.longest
        first = max(0, begin + 1 - w)
        own = data[first:end]
        key = (own.tobytes(), begin - first, state[0].tobytes(), state[1].tobytes())
        if key not in self.memo:
            if len(self.memo) > 4_096:
                self.memo.clear()
            size = begin - first
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((own.astype(np.uint64) + np.uint64(1)) * tk._powers(len(own)), dtype=np.uint64)])
            inverse = _inverse_powers(len(own) + 1)
            ending: list[list[tuple[int, int]]] = [[] for _ in range(len(own) + 1)]
            for length in self.sizes:
                if length <= len(own):
                    token = self.find((prefix[length:] - prefix[:-length]) * inverse[: len(own) + 1 - length], length)
                    for at in np.flatnonzero(token >= 0).tolist():
                        ending[at + length].append((length, int(token[at])))
            last = state[0][w - 1 - size :].tolist() + [0] * (len(own) - size)
            count = state[1][w - 1 - size :].tolist() + [0] * (len(own) - size)
            for i in range(size + 1, len(own) + 1):
                for length, token in ending[i]:
                    before = last[i - length]
                    if before >= 0 and (before, token) not in self.fits_of:
                        if len(self.fits_of) > KNOWN:
                            self.fits_of.clear()
                        self.fits_of[before, token] = bool(self._compatible(np.array([before]), np.array([token]))[0])
                    if before < 0 or self.fits_of[before, token]:
                        last[i], count[i] = token, count[i - length] + 1
                        break
            tokens, numbers = np.full(w, -1, np.int64), np.zeros(w, np.int64)
            some = min(w, len(own) + 1)
            tokens[w - some :], numbers[w - some :] = last[-some:], np.array(count[-some:]) - count[-1]
            self.memo[key] = count[-1] - count[size], (tokens, numbers)
        return self.memo[key]

    def words(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The number of tokens of each word of raw."""
        hashes = tk.hash_spans(raw, starts, lens)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        counts = np.zeros(len(distinct), np.int32)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        have = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), dtype=bool)
        counts[have] = self.counts[at[have]]
        new = np.flatnonzero(~have)
        size = lens[first[new]]
        for k in new[size > LONG].tolist():
            s = starts[first[k]]
            counts[k] = self._long(raw[s : s + lens[first[k]]])
        short = new[size <= LONG]
        short = short[np.argsort(-lens[first[short]], kind="stable")]
        a = 0
        while a < len(short):
            some = short[a : a + max(1, CELLS // int(lens[first[short[a]]]))]
            own = lens[first[some]]
            counts[some] = self._run(raw, starts[first[some]], own)[1][own, np.arange(len(some))]
            a += len(some)
        if len(new):
            if len(self.known) + len(new) > KNOWN:
                self.known, self.counts = distinct, counts
            else:
                keys, values = np.append(self.known, distinct[new]), np.append(self.counts, counts[new])
                order = np.argsort(keys, kind="stable")
                self.known, self.counts = keys[order], values[order]
        return counts[back]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, words of the splitter) of each text."""
        raw, offs = tk.buffers(texts)
        n = len(offs) - 1
        if not len(raw):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        letter = (raw & 0xC0) != 0x80
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        ends = np.concatenate([[0], np.cumsum(letter)])[offs]
        kinds = np.full(len(chars) + n, STOP, np.uint8)
        kinds[np.arange(len(chars)) + np.repeat(np.arange(n), np.diff(ends))] = _classes()[chars]
        begins = word_starts(kinds)
        text = np.searchsorted(ends[1:] + np.arange(1, n + 1), begins, "right")
        starts = np.flatnonzero(letter)[begins - text]
        lens = np.diff(np.append(starts, len(raw)))
        counts = self.words(raw, starts, lens)
        return np.bincount(text, counts, n).astype(np.int64), np.bincount(text, minlength=n)


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens that a token is merged from."""
    parts = [bytes([b]) for b in token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            raise ValueError(f"{token!r} isn't reached by merges")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@cache
def load(path: str = VOCABULARY) -> Counter:
    """Compiles the vocabulary in a file of `base64 rank` lines."""
    with open(path, "rb") as f:
        return Counter({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())})


def _count(counter: Counter):
    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text", 1 << 20):
                tokens, words = counter.texts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens), pa.array(words)], names=["doc_id", "n_tokens", "n_words"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_words) of every row: tokens of the byte-level BPE vocabulary and words of its splitter.

    The vocabulary is compiled once on the driver. Special tokens are ordinary text. A null or empty text has 0 of both. Whole
    texts are counted, of any length. Repeated rows give repeated rows; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tk.trimmed(_count(load(vocabulary))), "doc_id long, n_tokens long, n_words long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE: dict[str, str] = {}
