"""SimHash near-dedup with a hierarchical index over Gray-ordered fingerprints.

Fingerprints within ``distance`` differing bits are linked. Of ``PARTS`` equal parts
of 64 bits, at least PARTS - distance agree between two linked ones, so distinct
fingerprints go to one bucket for each such choice of parts. A bucket sorts its
fingerprints by Gray rank, in which neighbours differ in few bits; runs of them
form leaves, leaves form nodes, and each node holds the bits on which all of it
agrees. The differences of those bits bound every pair below two nodes, so whole
groups of pairs are dropped at once, and groups already joined are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import raw_texts, small_batches
from .graph import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Members of a leaf, children of a node, pairs compared at once, members above which a bucket is dealt out anew.
LEAF, FAN, AT_ONCE, SPLIT = 16, 8, 200_000, 20_000


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; without words 0."""
    w = raw.lower().split()
    if not w:
        return 0
    joined = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle))))
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], ">u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 65536):
        ones += np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row; null texts have no words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(raw, shingle) for raw in raw_texts(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray order, in which neighbours differ in one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class Joined:
    """Sets of members, each known by its smallest."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def settle(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            self.settle()


def joined(fps: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For distinct fingerprints, the place of the first of each one's linked group; exact."""
    order = np.argsort(gray_rank(fps), kind="stable")
    x = fps[order]
    sets = Joined(len(x))
    levels = []  # of nodes: first and last member, agreed bits, their values
    lo, hi = np.arange(0, len(x), LEAF), np.minimum(np.arange(0, len(x), LEAF) + LEAF, len(x))
    both, some = np.bitwise_and.reduceat(x, lo), np.bitwise_or.reduceat(x, lo)
    levels.append((lo, hi, ~(both ^ some), both))
    while len(lo) > FAN:
        cut = np.arange(0, len(lo), FAN)
        both, some = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(some, cut)
        lo, hi = lo[cut], np.r_[lo[cut[1:]], len(x)]
        levels.append((lo, hi, ~(both ^ some), both))

    def whole(level: int) -> np.ndarray:
        """The set that all of a node is in, or a number of its own."""
        lo, _, _, _ = levels[level]
        low, high = np.minimum.reduceat(sets.root, lo), np.maximum.reduceat(sets.root, lo)
        return np.where(low == high, low, -1 - np.arange(len(lo)))

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        """All members below pairs of leaves."""
        lo, hi, _, _ = levels[0]
        i = (lo[a][:, None] + np.arange(LEAF))[:, :, None]
        j = (lo[b][:, None] + np.arange(LEAF))[:, None, :]
        real = (i < hi[a][:, None, None]) & (j < hi[b][:, None, None]) & (i < j)
        i, j = np.broadcast_to(i, real.shape)[real], np.broadcast_to(j, real.shape)[real]
        near = np.bitwise_count(x[i] ^ x[j]) <= distance
        sets.link(i[near], j[near])

    at_leaf = max(1, AT_ONCE // LEAF**2)
    for a in range(0, len(levels[0][0]), at_leaf):  # inside leaves first: neighbours in Gray order mostly belong together
        leaf = np.arange(a, min(a + at_leaf, len(levels[0][0])))
        compare(leaf, leaf)
    top = len(levels) - 1
    a, b = np.triu_indices(len(levels[top][0]))
    stack = [(top, a, b)]
    while stack:
        level, a, b = stack.pop()
        _, _, mask, value = levels[level]
        keep = (a == b) | (np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b]) <= distance)
        in_one = whole(level)
        keep &= in_one[a] != in_one[b] if level == 0 else ~((in_one[a] == in_one[b]) & (in_one[a] >= 0))
        a, b = a[keep], b[keep]
        if level == 0:
            for k in range(0, len(a), at_leaf):
                in_one = whole(0)
                some = in_one[a[k : k + at_leaf]] != in_one[b[k : k + at_leaf]]
                compare(a[k : k + at_leaf][some], b[k : k + at_leaf][some])
        elif len(a) > AT_ONCE // FAN**2:
            step = max(1, AT_ONCE // FAN**2)
            stack += [(level, a[k : k + step], b[k : k + step]) for k in range(0, len(a), step)]
        elif len(a):
            n = len(levels[level - 1][0])
            i = np.repeat(a * FAN, FAN * FAN) + np.tile(np.repeat(np.arange(FAN), FAN), len(a))
            j = np.repeat(b * FAN, FAN * FAN) + np.tile(np.tile(np.arange(FAN), FAN), len(a))
            real = (i < n) & (j < n) & (i <= j)
            stack.append((level - 1, i[real], j[real]))
    first = np.full(len(x), len(x))
    np.minimum.at(first, sets.settle(), order)
    out = np.empty(len(x), np.int64)
    out[order] = first[sets.root]
    return out


def shared_parts(distance: int, free: list[int]) -> list[int]:
    """Masks, as longs, of the pairs of ``distance`` + 2 parts of these bits; values within ``distance`` agree on one of them."""
    parts = distance + 2
    cut = [free[len(free) * i // parts : len(free) * (i + 1) // parts] for i in range(parts)]
    masks = [sum(1 << b for part in two for b in part) for two in combinations(cut, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def dealt(values: DataFrame, distance: int, split: int) -> DataFrame:
    """(bucket, fp): every distinct fingerprint once for each choice of parts.

    A bucket of over ``split`` members is dealt out again by the same rule on the
    bits it does not share, which loses no link. Those that such buckets
    hold together are in a smaller bucket too.
    """
    masks = shared_parts(distance, list(range(64)))
    first = values.select("fp", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for m in masks])).alias("k"))
    first = first.select("fp", F.col("k.m").alias("m"), F.col("k.v").alias("v"))
    sizes = first.groupBy("m", "v").count().filter(F.col("count") > 1)
    buckets = first.join(sizes, ["m", "v"])
    small = buckets.filter(F.col("count") <= split).select(F.xxhash64("m", "v").alias("bucket"), "fp")
    large = buckets.filter(F.col("count") > split)

    rest = {m: shared_parts(distance, [b for b in range(64) if not (m >> b) & 1]) for m in masks}
    table = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*map(F.lit, rest[m])))])
    large = large.select("fp", "m", "v", F.explode(table[F.col("m")]).alias("n"))
    large = large.select(F.xxhash64("m", "v", "n", F.col("fp").bitwiseAND(F.col("n"))).alias("bucket"), "fp")
    return small.union(large)


def links(values: DataFrame, distance: int = DISTANCE, split: int = SPLIT) -> DataFrame:
    """(a, b): for each bucket, every linked fingerprint with the first of its group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest_b, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def groups(bucket: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[cuts[1:], len(bucket)]
            out_a, out_b = [], []
            two = ends - cuts == 2
            i = cuts[two]
            near = np.bitwise_count((fp[i] ^ fp[i + 1]).view(np.uint64)) <= distance
            out_a.append(fp[i + 1][near])
            out_b.append(fp[i][near])
            for p, q in zip(cuts[ends - cuts > 2].tolist(), ends[ends - cuts > 2].tolist()):
                own = fp[p:q]
                first = joined(own.view(np.uint64), distance)
                other = first != np.arange(len(own))
                out_a.append(own[other])
                out_b.append(own[first[other]])
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

        for f in frames:
            bucket, fp = np.r_[rest_b, f["bucket"].to_numpy()], np.r_[rest_f, f["fp"].to_numpy()]
            if not len(bucket):
                continue
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield from groups(bucket[:cut], fp[:cut])
            rest_b, rest_f = bucket[cut:], fp[cut:]
        if len(rest_b):
            yield from groups(rest_b, rest_f)

    return dealt(values, distance, split).repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, split: int = SPLIT) -> DataFrame:
    """doc_id, fingerprint, component_id of every row: the smallest doc_id reachable over links.

    Texts without words share fingerprint zero and are linked like any other.
    Null ids take part but never name a component that holds another id; rows
    with the same id are answered each for itself. Only distinct fingerprints are
    compared; copies meet in a grouped minimum. An empty table gives no rows.
    """
    made = stage(fingerprints(docs, shingle), "fingerprints")
    values = made.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(values.select("fp"), distance, split))
    known = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = stage(known.select("fp", "root").join(least, "root").select("fp", "component_id"), "known")
    return made.join(known, "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, one of each; a row without an id stays."""
    found = near_duplicates(docs, distance, shingle)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    mark = "_".join(["row", *docs.columns])
    left = docs.join(gone, "doc_id", "left_anti")
    numbered = left.withColumn(mark, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lit(0))))
    return numbered.filter((F.col(mark) == 1) | F.col("doc_id").isNull()).select(*docs.columns)
