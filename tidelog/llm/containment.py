"""Held-out items inside long documents: size-partitioned MinHash containment search.

A document-wide MinHash cannot see a dozen words among thousands. So both sides are partitioned by
size into passages of ``run`` words, the smallest that counts as a leak; a longer common passage
contains one of these. A passage is the set of its five-word shingles, and its signature the least of
their hashes. A passage of an item that a document contains has the very same shingles there, so its
containment is 1 and one hash function finds it with certainty: no leak is missed. Neighbouring
passages mostly share their least shingle, so only about two signatures in nine differ from the one
before. What the signatures bring up is verified by exact containment of whole ``run``-word shingles.

A larger common part is found by its first passage, so one class of sizes is enough; that classes of larger
passages need not be searched is what makes the search one pass.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.texts import slices, spread

RUN = 12
SHINGLE = 5
#: Bits of the filter of the items' signatures, as a power of two: 16 MB, for some ten million signatures.
FILTER_BITS = 27
#: Passages that a task hands on at a time.
AT_ONCE = 20_000
#: Words whose hashes a worker remembers before it starts anew.
REMEMBERED = 1_000_000
_WORDS = re.compile(r"[^\W_]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC normalisation and lower-casing."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORDS(text.lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def signatures(hashes: np.ndarray, run: int = RUN, shingle: int = SHINGLE) -> np.ndarray:
    """The MinHash of each passage of ``run`` words over its shingles, from the words' hashes; by its first word."""
    shingle = min(shingle, run)
    n = len(hashes) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = len(hashes) - shingle + 1
    s = np.zeros(m, np.uint64)
    for k in range(shingle):
        s = _spread(s + hashes[k : k + m])
    width, have, low = run - shingle + 1, 1, s
    while have < width:  # least of a doubled stretch from two halves that may overlap
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low[:n]


def passages(rows: list[list[str]], run: int, known: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signature of each passage of the rows of words, the row it lies in, and its first word there."""
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.fromiter((known[w] for r in rows for w in r), np.uint64, int(lengths.sum()))
    sig = signatures(flat, run)
    ends = np.cumsum(lengths)
    at = np.arange(len(sig))
    row = np.searchsorted(ends, at, side="right")
    inside = at + run <= ends[row] if len(at) else np.zeros(0, bool)  # a passage ends in its text
    return sig[inside], row[inside], (at - (ends - lengths)[row])[inside] if len(at) else at


def slots(sig: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a signature in a filter of 2^bits bits."""
    mask = np.uint64((1 << bits) - 1)
    return (sig & mask).astype(np.int64), (_spread(sig ^ _MIX) & mask).astype(np.int64)


class Filter:
    """A Bloom filter of signatures: says no only to what isn't among them. Its size is fixed, whatever is in it."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def may_have(self, sig: np.ndarray) -> np.ndarray:
        out = np.ones(len(sig), bool)
        for p in slots(sig, self.bits):
            out &= (self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) != 0
        return out


def _passages(run: int, filtered=None):
    """A function for mapInArrow over (id, text): (id, signature, passage), of the filtered ones only, once for each row."""
    known = _Hashes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only: Filter | None = filtered.value if filtered is not None else None
        for b in slices(batches, 4_000_000):
            if len(known) > REMEMBERED:
                known.clear()
            rows = [words(t) for t in b.column(1).to_pylist()]
            sig, row, at = passages(rows, run, known)
            if only is not None:
                hit = only.may_have(sig)
                sig, row, at = sig[hit], row[hit], at[hit]
            for k in range(0, max(len(sig), 1), AT_ONCE):
                some = slice(k, k + AT_ONCE)
                texts = [" ".join(rows[r][i : i + run]) for r, i in zip(row[some].tolist(), at[some].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[some])), pa.array(sig[some].view(np.int64)), pa.array(texts, pa.string())], ["id", "sig", "passage"])

    return each


def _filter(sigs: DataFrame, bits: int) -> Filter:
    """The filter of the signatures (sig): its bits are put together where the signatures are; 2^bits of them come to the driver at most."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(np.concatenate(slots(b.column(0).to_numpy().view(np.uint64), bits)))
            first = np.flatnonzero(np.append(True, (p[1:] >> 6) != (p[:-1] >> 6))) if len(p) else np.zeros(0, np.int64)
            value = np.bitwise_or.reduceat(np.uint64(1) << (p & 63).astype(np.uint64), first) if len(p) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((p[first] >> 6).astype(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

    got = sigs.mapInArrow(places, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["word"].to_numpy()] = got["value"].to_numpy().view(np.uint64)
    return Filter(out, bits)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = RUN, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id): the document and the item share ``run`` or more consecutive words.

    Each pair comes once, also if rows are repeated. Null and empty texts, texts of fewer than ``run``
    words, and rows without an id have none; other columns are ignored; either table may be empty.

    The items are the stated query set, searched against all documents. However many there are, the
    documents are read once: a filter of 2^filter_bits bits is all that is broadcast, and only passages
    whose signature may be an item's leave the documents' tasks. They meet the items' passages by shuffle
    (by broadcast while Spark measures the items' side to be small), word for word; a passage in very many
    documents is one that AQE splits. A small filter for many items lets more through and changes no result.
    """
    spark = docs.sparkSession
    side = lambda df, id: spread(df.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")))
    out = "id long, sig long, passage string"
    held = side(items, item_id).mapInArrow(_passages(run), out)
    known = spark.sparkContext.broadcast(_filter(held.select("sig"), filter_bits))
    found = side(docs, doc_id).mapInArrow(_passages(run, known), out).toDF("doc", "sig", "passage")
    return found.join(held.toDF("item", "sig", "passage").distinct(), ["sig", "passage"]).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).distinct()
