"""Best-fit packing of token sequences by exact-complement hashing.

Pieces are told apart by length only while packing is planned: the plan works on
the counts of the lengths, at most ``capacity`` numbers, whatever the number of
documents. A length is met by the single, pair or triple of other lengths that
fills its gap exactly, under the counts still available; the rest goes best-fit.
The plan says which run of pieces of each length goes to which run of sequences;
pieces are numbered within their length in two steps, so that a length that a
third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import small_batches

CAPACITY, END_ID, TOKENIZER = 1024, 2, "byte_bpe_50k"
#: Bytes of ids that a worker remembers, and pieces in one group while numbering (mean).
MEMO_BYTES, GROUP = 32_000_000, 200_000
#: Written in a text, the tokenizer reads it as one id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; a parameter of the operator, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes; texts met again in a task are not encoded again."""

    def __init__(self, ranks_file: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.memo: dict[bytes, bytes] = {}
        self.held = 0

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        key = hashlib.blake2b(text.encode(), digest_size=16).digest()
        if key not in self.memo:
            special = {SPECIAL} if SPECIAL in text else set()
            ids = self.core.encode_to_numpy(text, allowed_special=special, disallowed_special=()).astype("<u4").tobytes()
            if self.held + len(ids) > MEMO_BYTES:
                self.memo.clear()
                self.held = 0
            self.memo[key] = ids
            self.held += len(ids)
        return self.memo[key]


_encoders: dict[str, Encoder] = {}


def encoder(ranks_file: str) -> Encoder:
    """One per Python worker, kept over tasks."""
    if ranks_file not in _encoders:
        _encoders[ranks_file] = Encoder(ranks_file)
    return _encoders[ranks_file]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut where longer than ``capacity``.

    The first piece takes what does not fill a whole one. A null or empty text is the end id alone.
    """
    small_batches(docs.sparkSession)
    ranks_file = vocabulary(f"{tokenizer}.tiktoken")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_file)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = enc.encode(text or "") + end
                n, start, k = len(ids) // 4, 0, 0
                length = n % capacity or capacity
                while start < n:
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, k, length = start + length, k + 1, capacity
            cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, PIECES.types)], schema=PIECES)

    return docs.select("doc_id", "text").mapInArrow(run, DDL)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences), using every counted piece once.

    Bounded by the lengths: every step that fills gaps uses up a length or all but one of its pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def consume(*lengths: int) -> None:
        """As many sequences of these lengths as the counts allow."""
        need = {x: lengths.count(x) for x in lengths}
        m = min(int(left[x]) // k for x, k in need.items())
        if m:
            for x, k in need.items():
                left[x] -= m * k
            out.append((lengths, m))

    def pairs(total: int) -> np.ndarray:
        """First halves c <= total - c of the pairs of available lengths with this sum, large first."""
        if total < 2:
            return np.empty(0, np.int64)
        have = left[1:total] > 0
        both = np.flatnonzero(have & have[::-1]) + 1
        return both[(2 * both <= total) & ((2 * both < total) | (left[both] > 1))][::-1]

    consume(capacity)
    for a in range(capacity - 1, 0, -1):
        consume(a, capacity - a)
    for a in range(capacity - 1, 0, -1):
        for b in pairs(capacity - a).tolist() if left[a] else ():
            consume(a, b, capacity - a - b)
    for a in range(capacity - 1, 0, -1):
        for b in np.flatnonzero(left[: min(a, capacity - a) + 1])[::-1].tolist() if left[a] else ():
            for c in pairs(capacity - a - b).tolist() if left[a] and left[b] else ():
                consume(a, b, c, capacity - a - b - c)
    bins: dict[int, list[list]] = {}  # by gap: [lengths, number of sequences]
    for a in range(capacity, 0, -1):
        n = int(left[a])
        gap = a
        while n and gap <= capacity:
            while n and bins.get(gap):
                have = bins[gap].pop()
                each = min(gap // a, n)  # best-fit goes on with the sequence just used, whose gap is the smallest
                m = min(n // each, have[1])
                if m < have[1]:
                    bins[gap].append([have[0], have[1] - m])
                bins.setdefault(gap - each * a, []).append([have[0] + (a,) * each, m])
                n -= m * each
            gap += 1
        each = capacity // a
        if n // each:
            bins.setdefault(capacity - each * a, []).append([(a,) * each, n // each])
        if n % each:
            bins.setdefault(capacity - n % each * a, []).append([(a,) * (n % each), 1])
    return out + [(lengths, m) for groups in bins.values() for lengths, m in groups]


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: columns first rank, first sequence, offset of each run of pieces, by first rank."""
    used: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, m in planned:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + m
            offset += x
        sequence += m
    return {x: np.array(r, np.int64) for x, r in runs.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of all documents with sequence_id and offset, in as few sequences of ``capacity`` tokens as the plan finds.

    Rows with the same doc_id are packed each for itself; a null doc_id is kept.
    The driver sees the counts of at most ``capacity`` lengths and the plan, whose
    size they bound. An empty table gives no rows.
    """
    made = stage(pieces(docs, capacity, tokenizer), "pieces")
    groups = max(1, made.count() // GROUP)
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    parted = made.withColumn("part", part)
    sizes = parted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = stage(sizes.withColumn("base", F.coalesce(before, F.lit(0))), "piece_counts")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = places(plan(counts, capacity))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parted.withColumn("rank", F.row_number().over(order) - 1).join(sizes.drop("n"), ["length", "part"])

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, rank = f["length"].to_numpy(np.int64), f["rank"].to_numpy(np.int64)
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for x in np.unique(length).tolist():
                here, run = np.flatnonzero(length == x), runs[x]
                at = run[np.searchsorted(run[:, 0], rank[here], "right") - 1]
                sequence[here] = at[:, 1] + rank[here] - at[:, 0]
                offset[here] = at[:, 2]
            out = f[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(sequence_id=sequence, offset=offset)

    return (ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
            .mapInPandas(assign, DDL + ", sequence_id long, offset long"))
