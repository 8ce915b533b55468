"""Language identification with bitmask n-gram filters.

One Bloom filter for each language, bit-sliced: a slot holds one bit for each language, so the AND of an n-gram's slots is the set of
all languages that (seem to) contain it, in one look-up for every 64 languages, of which there may be any number. A text's n-grams are looked up,
the bits counted by language, and the counts corrected for the false positives that each filter's fill implies.
N-grams are runs of 4 bytes of the lower-cased text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Training takes about so many documents of a language, chosen by a hash of doc_id.
TRAIN_DOCUMENTS = 2_000
#: An n-gram belongs to a language if it is at least this share of the language's n-grams in training, whatever their number; so there are at most 1 / share of them.
MIN_GRAM_SHARE = 2e-5
HASHES, SLOTS_PER_GRAM = 2, 8
MIN_SHARE = 0.2
UNKNOWN = "und"
_WIDTH = 4


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(4-byte n-grams as uint32, n + 1 offsets); a text begins and ends with a blank, one of fewer than 2 bytes has none; nor are four blanks one."""
    raw, offs = tk.buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    sizes = np.diff(offs)
    padded = np.full(len(raw) + 2 * len(sizes), 32, dtype=np.uint8)
    shift = 2 * np.arange(len(sizes)) + 1
    padded[np.arange(len(raw)) + np.repeat(shift, sizes)] = raw
    padded[(padded < 48) | (padded > 57) & (padded < 65)] = 32  # marks and blanks are alike; digits stay
    wide = padded.astype(np.uint32)
    if len(padded) < _WIDTH:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    all_ = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    begin = offs[:-1] + 2 * np.arange(len(sizes))
    count = np.maximum(sizes + 2 - _WIDTH + 1, 0)
    at = np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)
    found, offs = all_[at], np.concatenate([[0], np.cumsum(count)])
    filled = found != 0x20202020  # blanks alone say nothing
    return found[filled], np.concatenate([[0], np.cumsum(filled)])[offs]


def _count(batches):
    for batch in batches:
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        for part_at, part in _with_rows(batch):
            g, offs = grams(part.column("text"))
            own = langs[part_at : part_at + part.num_rows]
            for lang in sorted(set(own)):
                mine = np.repeat(own == lang, np.diff(offs))
                values, n = np.unique(g[mine], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def _with_rows(batch):
    at = 0
    for part in tk.slices(batch, "text"):
        yield at, part
        at += part.num_rows


class Filters:
    """The bit-sliced filters: `masks` has a slot's languages as bits, in planes of 64 (rows of it) where there are more."""

    def __init__(self, languages: list[str], found: list[np.ndarray]):
        if len(languages) != len(found):
            raise ValueError("each language has its n-grams")
        self.languages = languages
        planes = -(-len(languages) // 64)
        kind = next((k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
        most = max([1, *map(len, found)])
        self.bits = max(10, int(np.ceil(np.log2(most * SLOTS_PER_GRAM))))
        self.masks = np.zeros((planes, 1 << self.bits) if planes > 1 else 1 << self.bits, dtype=kind)
        for i, g in enumerate(found):
            for slots in self.slots(g):
                self._plane(self.masks, i)[slots] |= kind(1 << i % 64)
        self.false = np.array([self.bit(self.masks, i).mean() ** HASHES for i in range(len(languages))])

    @staticmethod
    def _plane(mask: np.ndarray, i: int) -> np.ndarray:
        return mask if mask.ndim == 1 else mask[i // 64]

    def bit(self, mask: np.ndarray, i: int) -> np.ndarray:
        """Language i's bits in masks."""
        kind = self.masks.dtype.type
        return ((self._plane(mask, i) >> kind(i % 64)) & kind(1)).astype(np.uint8)

    def slots(self, g: np.ndarray) -> list[np.ndarray]:
        h = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.uint64((1 << self.bits) - 1)
        return [((h >> np.uint64(31 * k % 40)) & low).astype(np.int64) for k in range(HASHES)]

    def languages_of(self, g: np.ndarray) -> np.ndarray:
        first, *others = self.slots(g)
        mask = self.masks[..., first]
        for slots in others:
            mask = mask & self.masks[..., slots]
        return mask

    def shares(self, g: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(text, language): the corrected share of a text's n-grams that the language contains."""
        mask, n = self.languages_of(g), np.diff(offs)
        out = np.zeros((len(n), len(self.languages)))
        some = np.flatnonzero(n > 0)
        for i, f in enumerate(self.false):
            if len(some):
                hits = np.add.reduceat(self.bit(mask, i), offs[:-1][some], dtype=np.int64)
                out[some, i] = np.maximum(hits / n[some] - f, 0) / (1 - f) if f < 1 else 0
        return out


def train(docs: DataFrame, documents: int = TRAIN_DOCUMENTS, share: float = MIN_GRAM_SHARE) -> Filters:
    """Filters from the rows of docs that have text and lang; about `documents` of each language. Every distinct label is one, of any number.

    `share` is the one threshold: n-grams rarer than that in a language's sample aren't taken for the language's (of a sample of up to 1 / share n-grams, all are).
    """
    labelled = docs.where("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    have = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    wanted = docs.sparkSession.createDataFrame([(lang, min(1.0, documents / n)) for lang, n in have.items()], "lang string, wanted double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = labelled.join(F.broadcast(wanted), "lang").where(draw < F.col("wanted")).select("lang", "text")
    counts = sample.mapInArrow(tk.trimmed(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(total), "lang").where(F.col("n") >= F.col("total") * share).select("lang", "gram").toArrow()
    languages = sorted(have)
    lang = pc.index_in(kept.column("lang"), pa.array(languages, kept.schema.field("lang").type)).to_numpy()
    order = np.argsort(lang, kind="stable")
    gram = kept.column("gram").to_numpy().astype(np.uint32)[order]
    cuts = np.searchsorted(lang[order], np.arange(len(languages) + 1))
    return Filters(languages, [gram[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])


def _decide(filters: Filters, least: float):
    names = np.array([*filters.languages, UNKNOWN], dtype=object)

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                shares = filters.shares(*grams(part.column("text")))
                if not filters.languages:
                    shares = np.zeros((part.num_rows, 1))
                best = shares.argmax(axis=1)
                top = shares[np.arange(len(best)), best]
                second = np.sort(shares, axis=1)[:, -2] if shares.shape[1] > 1 else np.zeros(len(best))
                best = np.where(top >= least, best, len(names) - 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(names[best], pa.string()), pa.array(top), pa.array(top - second)], names=["doc_id", "lang", "predicted", "share", "margin"])

    return run


def identify(docs: DataFrame, filters: Filters, least: float = MIN_SHARE) -> DataFrame:
    """(doc_id, lang, predicted, share, margin) of every row; lang is the input's label or null.

    A null or empty text, and one of which no language holds `least` of the n-grams, is `und`; of equal shares the
    language first in the alphabet wins. Whole texts count. Rows are judged one by one, repeated or not; other columns are not read.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tk.trimmed(_decide(filters, least)), "doc_id long, lang string, predicted string, share double, margin double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))


QUERIES = {"op9_language_id": op9_language_id}
ORACLE: dict[str, str] = {}
