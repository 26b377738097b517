"""Product codes of vectors: Lloyd's rounds over cover trees that are built once.

Rows are cut into blocks inside their task. For each of the equal parts of a
vector a block gets a cover tree (its simplified form: a node's children are more
than half of its radius apart, and the node is its own first child). The points
lie in the tree's order, so a subtree is a range and its count and sum come from
cumulative sums. A round walks the trees from their roots: where the triangle
inequality puts every point of a subtree nearer to one entry than to any other,
the whole range is assigned at once; only ambiguous nodes descend, and ambiguous
leaves compare their points one by one.

All sums and squared distances are whole numbers, so the result depends neither on
blocks nor on partitions. Trees are written to the shared folder once; a round
sends parts * entries sums per task to the shuffle and one row per entry to the
driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a block, most points of a leaf, most children of a node.
BLOCK, LEAF, FAN = 4096, 24, 64
#: Share by which a bound must hold, far above the rounding of square roots.
SLACK = 1e-12


@dataclass
class Tree:
    """Points in tree order; node i covers points[low[i]:high[i]], of which the first is its centre.

    ``below`` is the first of its ``fan`` children, which follow each other; a leaf has none.
    """

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    below: np.ndarray
    fan: np.ndarray

    def packed(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(getattr(self, k), t).tobytes() for k, t in FIELDS.items()}

    @staticmethod
    def unpacked(row: dict[str, bytes], width: int) -> Tree:
        got = {k: np.frombuffer(row[k], t) for k, t in FIELDS.items()}
        got["points"] = got["points"].reshape(len(got["order"]), width).astype(np.int64)
        return Tree(**got)


FIELDS = {"points": np.int32, "order": np.int32, "low": np.int32, "high": np.int32, "radius": np.float64, "below": np.int32, "fan": np.int32}


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of every point to every entry."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for j in range(points.shape[1]):
        gap = points[:, j, None] - entries[None, :, j]
        out += gap * gap
    return out


def build(points: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Tree:
    """Cover tree of whole-number points, one row each.

    A node's children are a greedy net of its points at half its radius. Where a
    net would pass ``fan`` centres, what is left joins the nearest of them; radii
    are measured, so bounds hold there too. Equal points end in one leaf.
    """
    order = np.arange(len(points))
    low, high, radius, below, fans = [0], [len(points)], [0.0], [0], [0]
    at = 0
    while at < len(low):
        a, b = low[at], high[at]
        own = points[order[a:b]]
        gap = own - own[0]
        dist = np.sqrt((gap * gap).sum(1, dtype=np.float64))
        radius[at] = float(dist.max())
        if b - a > leaf and radius[at] > 0:
            child = np.full(b - a, -1)
            near = dist
            best = dist.copy()
            left, count = np.arange(b - a), 0
            closest = np.zeros(b - a, np.int64)
            while True:
                member = near <= radius[at] / 2
                child[left[member]] = count
                left, near = left[~member], near[~member]
                count += 1
                if not len(left) or count == fan:
                    break
                gap = own[left] - own[left[0]]
                near = np.sqrt((gap * gap).sum(1, dtype=np.float64))
                closer = left[near < best[left]]
                best[closer] = near[near < best[left]]
                closest[closer] = count
            child[left] = closest[left]
            by_child = np.argsort(child, kind="stable")
            order[a:b] = order[a:b][by_child]
            ends = a + np.cumsum(np.bincount(child, minlength=count))
            below[at], fans[at] = len(low), count
            low += [a, *ends[:-1].tolist()]
            high += ends.tolist()
            radius += [0.0] * count
            below += [0] * count
            fans += [0] * count
        at += 1
    return Tree(points[order], order, *(np.array(x) for x in (low, high, radius, below, fans)))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def assign(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest entry (ties to the lower index) of each point in tree order, and how many points were compared one by one."""
    marks = np.zeros(len(tree.points) + 1, np.int64)
    codes = np.zeros(len(tree.points), np.int64)
    front, compared = np.zeros(1, np.int64), 0
    while len(front):
        sq = squared(tree.points[tree.low[front]], entries)
        rows, best = np.arange(len(front)), sq.argmin(1)
        dist = np.sqrt(sq.astype(np.float64))
        first = dist[rows, best]
        dist[rows, best] = np.inf
        reach = tree.radius[front]
        sure = (reach == 0) | ((first + 2 * reach) * (1 + SLACK) < dist.min(1))
        done = front[sure]
        # marks become codes by a running sum: ranges are disjoint
        np.add.at(marks, tree.low[done], best[sure])
        np.add.at(marks, tree.high[done], -best[sure])
        open_ = front[~sure]
        leaves = open_[tree.fan[open_] == 0]
        loose = ranges(tree.low[leaves], tree.high[leaves] - tree.low[leaves])
        codes[loose] = squared(tree.points[loose], entries).argmin(1)
        compared += len(loose)
        inner = open_[tree.fan[open_] > 0]
        front = ranges(tree.below[inner], tree.fan[inner])
    return codes + np.cumsum(marks)[:-1], compared


def entry_sums(tree: Tree, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and their componentwise sum by entry: differences of cumulative sums where the code changes."""
    cuts = np.flatnonzero(np.diff(codes)) + 1
    low, high = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(codes)]])
    running = np.concatenate([np.zeros((1, tree.points.shape[1]), np.int64), np.cumsum(tree.points, 0)])
    counts, sums = np.zeros(n, np.int64), np.zeros((n, tree.points.shape[1]), np.int64)
    np.add.at(counts, codes[low], high - low)
    np.add.at(sums, codes[low], running[high] - running[low])
    return counts, sums


# --- Spark -----------------------------------------------------------------

def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """floor(SCALE * x), shorter vectors filled up with zeros.

    Held within bounds that keep a squared distance in a long (about 32,000 for x
    at 64 components).
    """
    out = np.zeros((len(vectors), width), np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    bound = min(math.isqrt(2**62 // max(width, 1)) // 2, 2**31 - 1)
    return np.clip(np.floor(out * SCALE), -bound, bound).astype(np.int64)


def planted(vectors: DataFrame, width: int, parts: int, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """One row per block of at most BLOCK vectors: their ids and labels, and a packed tree per part."""
    own = width // parts
    schema = vectors.schema
    tree = "struct<" + ",".join(f"{k}:binary" for k in FIELDS) + ">"
    out = f"ids array<{schema['vec_id'].dataType.simpleString()}>, labels array<{schema['label'].dataType.simpleString()}>, trees array<{tree}>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: pa.Table) -> pa.RecordBatch:
            x = whole_numbers([np.asarray(v, np.float64) for v in held.column("embedding").to_pylist()], width)
            trees = [build(x[:, p * own : (p + 1) * own], leaf, fan).packed() for p in range(parts)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), held.column(c).combine_chunks()) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.struct([(k, pa.binary()) for k in FIELDS])))], ["ids", "labels", "trees"])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                head = batch.slice(0, BLOCK - n)
                held.append(head)
                n += head.num_rows
                batch = batch.slice(head.num_rows)
                if n == BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield block(pa.Table.from_batches(held))

    return stage(vectors.mapInArrow(rows, out), "cover-trees")


def trees_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[Tree]]]:
    for i in range(batch.num_rows):
        yield i, [Tree.unpacked(t, width) for t in batch.column("trees").slice(i, 1).to_pylist()[0]]


def round_sums(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, entry, at, total, n: componentwise sums of the parts nearest to each entry; added up per task, then in the shuffle.

    Vectors without components still leave their counts, at place -1.
    """
    parts, k, width = len(books), *books[0].shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            for _, trees in trees_of(batch, width):
                for p, tree in enumerate(trees):
                    c, s = entry_sums(tree, assign(tree, books[p])[0], k)
                    counts[p] += c
                    sums[p] += s
        part, entry = (x.ravel() for x in np.indices((parts, k)))
        used = counts.ravel() > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[used]), pa.array(entry[used]), pa.array(counts.ravel()[used]), pa.array(list(sums.reshape(parts * k, width)[used]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"])

    found = blocks.select("trees").mapInArrow(rows, "part long, entry long, n long, sums array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    return found.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "total")).groupBy("part", "entry", "at").agg(exact("n"), exact("total"))


def next_books(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry replaced by the floored mean of its parts; unused entries stay. At most a vector's components times entries rows are collected."""
    out = [b.copy() for b in books]
    for r in round_sums(blocks, books).collect():
        if r["at"] is not None:
            out[r["part"]][r["entry"], r["at"]] = int(r["total"]) // int(r["n"])
    return out


def coded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of every vector under the codebooks."""
    types = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema.fields if f.name != "trees"}
    width = books[0].shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees in trees_of(batch, width):
                n = len(trees[0].order)
                codes, errors = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
                for p, tree in enumerate(trees):
                    found = assign(tree, books[p])[0]
                    gap = tree.points - books[p][found]
                    codes[tree.order, p] = found
                    errors[tree.order] += (gap * gap).sum(1)
                text = codes.tobytes().hex()
                step = 2 * len(books)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").slice(i, 1).flatten(), batch.column("labels").slice(i, 1).flatten(),
                     pa.array([text[j * step : (j + 1) * step] for j in range(n)]), pa.array(errors)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(rows, f"vec_id {types['ids']}, label {types['labels']}, code string, error long")


def first_books(vectors: DataFrame, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the ``entries`` smallest ids; rows of one id go by their vectors, rows without an id come last."""
    head = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    x = whole_numbers([np.asarray(r["embedding"], np.float64) for r in head], width)
    return [x[:, p * (width // parts) : (p + 1) * (width // parts)] for p in range(parts)]


def lloyd(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every sound vector, and the final codebooks, one array of entries per part.

    Rows whose vector is null or holds a null or non-finite component are left
    out. Vectors are filled up with zeros to the longest one's length, rounded up
    to a multiple of ``parts``. A table of fewer vectors than entries has as many
    entries as vectors; an empty one has none and gives no rows. At most 256
    entries, so that one is two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    own = vectors.select("vec_id", "embedding", "label").filter(sound(F.col("embedding")))
    longest = own.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts) * parts
    books = first_books(own, width, parts, entries)
    blocks = planted(own, width, parts)
    if not len(books[0]):
        return blocks.select(F.explode("ids").alias("vec_id"), F.get("labels", F.lit(0)).alias("label"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    for _ in range(rounds):
        books = next_books(blocks, books)
    return coded(blocks, books), books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over the label, nulls together), codebooks_sha256.

    The rows are written once; sums per label are added before the shuffle and
    joined to them as a table of its own, whose size decides how. A label_error
    that no long can hold is null.
    """
    found, books = lloyd(vectors, parts, entries, rounds)
    rows = stage(found, "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = stage(rows.groupBy(F.col("label").alias("of_label")).agg(total.try_cast("long").alias("label_error")), "label-errors")
    joined = rows.join(labels, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The result as SQL for vectors of one length: every part against every entry, round by round."""
    sq = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = f"""
  SELECT p.vec_id, p.part, p.x, arg_min(b.entry, {sq}::HUGEINT * 256 + b.entry) AS entry, min({sq})::BIGINT AS sq
  FROM parts p JOIN book# b ON b.part = p.part GROUP BY p.vec_id, p.part, p.x"""
    steps = [f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, part, x[part * (len(x) // {parts}) + 1:(part + 1) * (len(x) // {parts})] AS x FROM kept, range({parts}) AS r(part)),
book0 AS MATERIALIZED (
  SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM parts QUALIFY entry < {entries})"""]
    for i in range(rounds):
        steps.append(f"""near{i} AS MATERIALIZED ({nearest.replace('#', str(i))}),
sums{i} AS (SELECT part, entry, place, sum(x[place])::HUGEINT AS s, count(*) AS n FROM near{i}, range(1, (SELECT max(len(x)) FROM parts) + 1) AS r(place) GROUP BY ALL),
mean{i} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS x FROM sums{i} GROUP BY ALL),
book{i + 1} AS MATERIALIZED (SELECT b.part, coalesce(m.x, b.x) AS x, b.entry FROM book{i} b LEFT JOIN mean{i} m ON m.part = b.part AND m.entry = b.entry)""")
    steps.append(f"""last AS MATERIALIZED ({nearest.replace('#', str(rounds))}),
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(sq)::BIGINT AS error FROM last GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)""")
    return ",\n".join(steps)
