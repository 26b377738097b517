"""Order MinHash fingerprints: sensitive to edit distance, not only to the set of k-mers.

Character k-mers are numbered by occurrence, so that repeats differ. Numbered
k-mers fall into ``BINS`` bins by hash; in each bin the ``TUPLE`` smallest are
selected, put back into text order, and their tuple is hashed. Two texts agree in a
bin if the same k-mers were selected and stand in the same order in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POLY, mixed, small_batches

K, BINS, TUPLE = 6, 64, 2
#: Numbered k-mers per bin, on average, among which the smallest are looked for first.
NEAR = 8
OCCURRENCE = np.uint64(0xD6E8FEB86659FD93)
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
LOWEST = np.iinfo(np.int64).min


def numbered(text: str, k: int = K) -> np.ndarray:
    """A hash of each k-mer with its occurrence number, in text order; a shorter text is one k-mer."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if not len(code):
        return code
    k = min(k, len(code))
    h = np.zeros(len(code) - k + 1, np.uint64)
    for j in range(k):
        h = h * POLY + code[j : j + len(h)]
    h = mixed(h)
    same = np.sort(h)
    same = same[1:][same[1:] == same[:-1]]
    if len(same):
        again = np.flatnonzero(np.isin(h, same))
        order = again[np.argsort(h[again], kind="stable")]
        new = np.r_[True, h[order[1:]] != h[order[:-1]]]
        first = np.flatnonzero(new)
        nth = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        later = nth > 0  # a first occurrence is the same in texts where it is the only one
        h[order[later]] = mixed(h[order[later]] + nth[later].astype(np.uint64) * OCCURRENCE)
    return h


def signature(text: str, k: int = K, bins: int = BINS) -> np.ndarray:
    """One 16-bit number per bin, 0 where the bin is empty."""
    out = np.zeros(bins, np.uint16)
    h = numbered(text, k)
    if not len(h):
        return out
    width = np.uint64((1 << 64) // bins)
    here = np.arange(len(h))
    if len(h) > 2 * NEAR * bins:
        low = here[h % width < np.uint64(int(width) * NEAR * bins // len(h))]
        if np.bincount((h[low] // width).astype(np.int64), minlength=bins).min() >= TUPLE:
            here = low
    here = here[np.argsort(h[here])]
    own = (h[here] // width).astype(np.int64)
    start = np.searchsorted(own, np.arange(bins))
    count = np.minimum(np.diff(np.r_[start, len(own)]), TUPLE)
    places = np.full((bins, TUPLE), len(h))
    for j in range(TUPLE):
        has = count > j
        places[has, j] = here[start[has] + j]
    places.sort(axis=1)
    value = np.zeros(bins, np.uint64)
    padded = np.r_[h, np.uint64(0)]
    for j in range(TUPLE):
        value = mixed(value * POLY + padded[places[:, j]] + np.uint64(j + 1))
    out[:] = np.maximum(value >> np.uint64(48), np.uint64(1)).astype(np.uint16)
    out[count == 0] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either fills; 1 for two empty texts."""
    filled = (a != 0) | (b != 0)
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by as many code points from the start of the other, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def in_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """block, tail, place, tie, doc_id, text: rows by id range, and the first of each block once more at the end of the one before.

    Bounds are percentiles of the ids, one per shuffle partition, so texts move once.
    """
    spark = docs.sparkSession
    place = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(place.alias("place"))
    cuts = ids.agg(F.percentile_approx("place", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    def block_of(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, places, "right")

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, int] = {}
        for batch in batches:
            places = batch.column("place").to_numpy()
            for b, p in zip(block_of(places).tolist(), places.tolist()):
                if p < first.get(b, p + 1):
                    first[b] = p
        yield pa.RecordBatch.from_arrays([pa.array(first.keys(), pa.int64()), pa.array(first.values(), pa.int64())], names=["block", "first"])

    firsts = ids.mapInArrow(first_of, "block long, first long").groupBy("block").agg(F.min("first").alias("first"))
    heads = sorted((r["block"], r["first"]) for r in firsts.collect())  # one row per block
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    head = dict(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("place").to_numpy()
            block = block_of(places)
            again = np.flatnonzero([head[b] == p for b, p in zip(block.tolist(), places.tolist())])
            rows = pa.array(np.r_[np.arange(len(places)), again])
            cols = [batch.column(c).take(rows) for c in ("place", "tie", "doc_id", "text")]
            where = np.r_[block, [before[b] for b in block[again].tolist()]].astype(np.int64)
            tail = np.r_[np.zeros(len(places), np.int32), np.ones(len(again), np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(tail), *cols], names=["block", "tail", "place", "tie", "doc_id", "text"])

    rows = docs.select(place.alias("place"), F.xxhash64("text").alias("tie"), "doc_id", "text").mapInArrow(
        run, "block long, tail int, place long, tie long, doc_id long, text string")
    return rows, n


def fingerprints(docs: DataFrame, k: int = K, bins: int = BINS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is the one that follows by id, and by a hash of the text
    among equal ids; a row without an id comes before all others, and the first
    follows the last. Null texts are empty; the fingerprint of an empty text is all
    zeros. A table of one row is its own next document; an empty one gives no rows.
    """
    small_batches(docs.sparkSession)
    rows, n = in_blocks(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # block, tail, doc_id, text, signature
        for batch in batches:
            out: list[tuple] = []
            for block, tail, doc, text in zip(*(batch.column(c).to_pylist() for c in ("block", "tail", "doc_id", "text"))):
                text = text or ""
                if last and last[0] == block and last[1]:
                    continue  # the end of the block has its next document
                now = (block, tail, doc, text, signature(text, k, bins))
                if last and last[0] == block:
                    _, _, own_id, own, sig = last
                    new = edited(own, text)
                    new_sig = signature(new, k, bins)
                    out.append((own_id, len(own), hashlib.sha256(new.encode()).hexdigest(), sig.astype(">u2").tobytes().hex(),
                                new_sig.astype(">u2").tobytes().hex(), likeness(sig, new_sig), likeness(sig, now[4])))
                last = now
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            cols = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=COLUMNS)

    ordered = rows.repartition(n, "block").sortWithinPartitions("block", "tail", "place", "tie")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
