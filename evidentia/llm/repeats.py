"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, met by hash range.

A window of a document goes if its word sequence also starts in a document with
a smaller id. Scan tasks hash all windows of a chunk of documents, settle what
repeats inside the chunk, and send one entry per distinct window, with its
smallest document, to the bucket of its hash range. A bucket finds the smallest
document over all chunks and names the windows that go; documents join what was
named and drop the covered words. A window that a third of all documents share
is one entry per chunk in its bucket, so no task gets a hot key's rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, small_batches

WINDOW = 13
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Windows and documents in a chunk, distinct windows in a bucket (means), words remembered by a worker.
CHUNK_WINDOWS, CHUNK_DOCS, BUCKET_WINDOWS, MEMO_WORDS = 2_000_000, 60_000, 2_000_000, 400_000
CHARS_PER_WORD = 6

ASKED = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("place", pa.binary()), ("hashes", pa.binary()),
                   ("doc_id", pa.int64()), ("gone", pa.binary())])
GONE = pa.schema([("doc_id", pa.int64()), ("gone", pa.int64())])
SPAN = re.compile(rb"[^\x20\x09-\x0D]+")


class WordHashes(dict):
    """Eight hash bytes per word, forgotten when too many."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_digest(word)
        return h


def window_hashes(words: list[bytes], memo: WordHashes, window: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of each run of ``window`` words."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(memo.__getitem__, words)), "<u8")
    acc = h[:n].copy()
    for j in range(1, window):
        acc *= BASE
        acc += h[j : j + n]
    acc ^= acc >> np.uint64(31)  # so that the upper bits, which choose the bucket, depend on all
    acc *= BASE
    return acc


def pack_sorted(h: np.ndarray) -> bytes:
    """Ascending hashes as steps of six bytes, or of eight where a step is larger."""
    steps = np.diff(h, prepend=h[:1])
    wide = bool(len(steps) and steps.max() >= 1 << 48)
    body = steps if wide else steps.view(np.uint8).reshape(-1, 8)[:, :6]
    return (b"w" if wide else b"n") + h[:1].tobytes() + body.tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    start = np.frombuffer(b, np.uint64, 1, 1)
    if b[:1] == b"w":
        steps = np.frombuffer(b, np.uint64, -1, 9).copy()
    else:
        six = np.frombuffer(b, np.uint8, -1, 9).reshape(-1, 6)
        steps = np.zeros((len(six), 8), np.uint8)
        steps[:, :6] = six
        steps = steps.view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64) + start


def by_doc(docs: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(docs, kind="stable")
    docs, hashes = docs[order], hashes[order]
    cuts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.empty(0, np.int64)
    for a, b in zip(cuts, np.r_[cuts[1:], len(docs)]):
        yield int(docs[a]), hashes[a:b].tobytes()


def settle(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each hash's first entry with its smallest document, and of entries with a larger one; by hash, document."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
    smallest = d[np.flatnonzero(first)][np.cumsum(first) - 1] if len(h) else d
    again = d != smallest
    again[1:] &= (h[1:] != h[:-1]) | (d[1:] != d[:-1])  # once per document
    return order[first], order[again]


def asked(window: int, buckets: int):
    """Scan task: what each chunk of documents asks of the buckets, and what it settles itself."""

    def chunk(ids: list[int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        table = np.unique(np.array(ids, np.int64))
        place = np.repeat(np.searchsorted(table, np.array(ids, np.int64)), [len(p) for p in parts]).astype(np.uint16)
        hashes = np.concatenate(parts)
        first, again = settle(place, hashes)
        packed = zlib.compress(np.diff(table, prepend=0).tobytes(), 1)
        h, place_of = hashes[first], place[first]
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        rows = [(b, packed, place_of[x:y].tobytes(), pack_sorted(h[x:y]), None, None)
                for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
        for i, (doc, gone) in enumerate(by_doc(table[place[again]], hashes[again])):
            rows.append((i % buckets, None, None, None, doc, gone))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ASKED.types)], schema=ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, ids, parts, held = WordHashes(), [], [], 0
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))):
                h = window_hashes(raw.split(), memo, window) if doc is not None else ()
                if len(h):
                    ids.append(doc)
                    parts.append(h)
                    held += len(h)
                if held >= CHUNK_WINDOWS or len(ids) >= CHUNK_DOCS:
                    yield from chunk(ids, parts)
                    ids, parts, held = [], [], 0
        if ids:
            yield from chunk(ids, parts)

    return run


def answered(group: pa.Table) -> pa.Table:
    """Bucket: a row per document and window that a smaller document holds."""
    asks = group.filter(pa.compute.is_valid(group["hashes"]))
    told = group.filter(pa.compute.is_valid(group["gone"]))
    gone = [np.frombuffer(b, np.int64) for b in told["gone"].to_pylist()]
    of_doc = [np.repeat(np.array(told["doc_id"].to_pylist(), np.int64), [len(g) for g in gone])]
    if asks.num_rows:
        hashes, docs = [], []
        for packed, place, h in zip(*(asks[c].to_pylist() for c in ("docs", "place", "hashes"))):
            table = np.cumsum(np.frombuffer(zlib.decompress(packed), np.int64))
            docs.append(table[np.frombuffer(place, np.uint16)])
            hashes.append(unpack_sorted(h))
        docs, hashes = np.concatenate(docs), np.concatenate(hashes)
        _, again = settle(docs, hashes)
        of_doc.append(docs[again])
        gone.append(hashes[again].view(np.int64))
    return pa.table([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (of_doc, gone)], schema=GONE)


def covered(words: list[bytes], gone: np.ndarray | None, memo: WordHashes, window: int) -> np.ndarray:
    """Whether each word lies in a window that goes."""
    out = np.zeros(len(words) + 1, np.int64)
    if gone is not None:
        h = window_hashes(words, memo, window)
        hit = np.flatnonzero(np.isin(h, gone))
        np.add.at(out, hit, 1)
        np.add.at(out, hit + window, -1)
    return np.cumsum(out)[:-1] > 0


def gone_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and gone, the hashes of the windows to remove, for documents that lose any.

    Documents without an id neither cause removals nor lose words; rows with the
    same id count as one document. Hashes have 64 bits: two different windows
    meet with a chance of about n/2**64 per window of n distinct ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(chars / CHARS_PER_WORD / BUCKET_WINDOWS))
    asks = docs.mapInArrow(asked(window, buckets), "bucket int, docs binary, place binary, hashes binary, doc_id long, gone binary")
    told = asks.groupBy("bucket").applyInArrow(answered, "doc_id long, gone long")
    return told.groupBy("doc_id").agg(F.collect_list("gone").alias("gone"))


def hash_lists(column: pa.Array) -> list[np.ndarray | None]:
    return [x.values.to_numpy().view(np.uint64) if x.is_valid else None for x in column]


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; null and empty texts have no words and the digest of nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            rows = []
            for raw, gone in zip(raw_texts(batch.column("text")), hash_lists(batch.column("gone"))):
                w = raw.split()
                lost = covered(w, gone, memo, window)
                kept = [x for x, out in zip(w, lost.tolist()) if not out] if gone is not None else w
                rows.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, r, s = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = docs.select("doc_id", "text").join(gone_windows(docs, window), "doc_id", "left")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with repeated windows cut from ``text``; ``n_chars``, where there is one, is counted anew.

    Texts that lose nothing stay as they are; in others the maximal runs of kept
    words keep their inner white space and are joined by one space.
    """
    names = docs.columns
    taken = f"gone_{'_'.join(names)}"

    def cut(raw: bytes, gone: np.ndarray, memo: WordHashes) -> bytes:
        spans = [m.span() for m in SPAN.finditer(raw)]
        lost = covered([raw[a:b] for a, b in spans], gone, memo, window)
        edge = np.flatnonzero(np.diff(np.r_[True, lost, True].astype(np.int8)))
        return b" ".join(raw[spans[a][0] : spans[b - 1][1]] for a, b in zip(edge[::2], edge[1::2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            text = batch.column("text")
            new = [None if not ok else cut(raw, gone, memo) if gone is not None else raw
                   for ok, raw, gone in zip(text.is_valid().to_pylist(), raw_texts(text), hash_lists(batch.column(taken)))]
            new = pa.array(new, pa.binary()).cast(pa.string())
            cols = {name: batch.column(name) for name in names} | {"text": new}
            if "n_chars" in cols:
                cols["n_chars"] = pa.compute.utf8_length(new).cast(batch.column("n_chars").type)
            yield pa.RecordBatch.from_pydict(cols)

    gone = gone_windows(docs, window).withColumnRenamed("gone", taken)
    return docs.join(gone, "doc_id", "left").select(*names, taken).mapInArrow(run, docs.schema)
