"""Language-model scoring by a probabilistic suffix tree.

A text is a sequence of words closed by an end. Words that make up at least
``SYMBOL`` of all training tokens are symbols of the tree, at most 1 / SYMBOL of
them; the other words, new ones included, share one symbol, in which a word has
its discounted share and new words together have the mass of the discounts. Every
context of up to ``DEPTH`` symbols is a candidate, and is kept where its next-symbol
distribution diverges from that of its suffix by more than its own cost.
Distributions are smoothed into the suffix's, and each symbol is scored in the
state of the longest kept suffix before it.

Counts cover all training documents and all contexts, seen once or often. The tree
is a table per depth that grows with the texts. The last depth is grown in buckets
of whole contexts: chunks of texts ask for their distinct edges and get their
probabilities back. Words frequent enough to be held by every task are at most
1 / FREQUENT; occurrences of others meet their word in a join, in which none is hot
for just that reason.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage, task_count
from .common import POLY, in_fold, mixed, raw_texts, small_batches

FOLDS, HELD_OUT = 5, 1
DEPTH, SEED = 3, 42
#: Least share of all tokens of a symbol; of a word that every task holds.
SYMBOL, FREQUENT = 1e-4, 5e-7
DISCOUNT = 0.75
START, END, RARE, FIRST = 0, 1, 2, 3
BITS = 16
COUNTER_KEYS, SYMBOLS_AT_ONCE, BUCKET_TOKENS = 400_000, 4_000_000, 1_000_000


def lexicon(docs: DataFrame) -> DataFrame:
    """word and n, its count in training texts, of every word of every text; 0 where only others hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        other: set[bytes] = set()

        def told() -> pa.RecordBatch:
            keys = [*seen, *(alone := other - seen.keys())]
            counts = [*seen.values(), *[0] * len(alone)]
            seen.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

        for batch in batches:
            for raw, held_out in zip(raw_texts(batch.column("text")), batch.column("held_out").to_pylist()):
                (other if held_out else seen).update(raw.lower().split())
                if len(seen) + len(other) > COUNTER_KEYS:
                    yield told()
        yield told()

    held_out = in_fold(F.col("doc_id"), FOLDS, HELD_OUT)
    parts = docs.select(held_out.alias("held_out"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Positions:
    """Symbols of many texts as parallel arrays: for each symbol after a start, its contexts within the text."""

    def __init__(self, coded: list[bytes], depth: int):
        self.code = np.frombuffer(b"".join(coded), "<u2").astype(np.int64)
        length = np.array([len(c) // 2 for c in coded], np.int64)
        first = np.cumsum(length) - length
        at = np.ones(len(self.code), bool)
        at[first[length > 0]] = False
        self.at = np.flatnonzero(at)
        self.back = self.at - np.repeat(first, length)[self.at]  # symbols before, the start included
        self.symbol = self.code[self.at]
        self.text = np.repeat(np.arange(len(coded)), length)[self.at]
        self.random = mixed(np.arange(1 << 16, dtype=np.uint64) + POLY)
        self.depth = depth

    def contexts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By depth: which positions have that many symbols before them, the context's hash and its oldest symbol."""
        here, poly, power = np.arange(len(self.at)), np.zeros(len(self.at), np.uint64), np.ones(1, np.uint64)
        yield 0, here, poly, np.zeros(len(self.at), np.int64)
        for k in range(1, self.depth + 1):
            more = self.back[here] >= k
            here, poly = here[more], poly[more]
            oldest = self.code[self.at[here] - k]
            poly = poly + self.random[oldest] * power
            power = power * POLY
            yield k, here, poly, oldest


def parent(context: np.ndarray, oldest: np.ndarray, depth: int) -> np.ndarray:
    """Hash of a context without its oldest symbol."""
    power = np.ones(1, np.uint64)
    for _ in range(depth - 1):
        power = power * POLY
    return context - mixed(oldest.astype(np.uint64) + POLY) * power


def longer(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hash of a context after one more symbol."""
    return context * POLY + mixed(symbol.astype(np.uint64) + POLY)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Staged, in a denser format; shuffle files of this job go at its end, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    was = {key: conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            conf.set(key, value)
        return stage(df, name)
    finally:
        for key, value in was.items():
            conf.unset(key) if value is None else conf.set(key, value)


def packed(coded: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol after a start: the up to ``depth`` symbols before it and itself as one long, 16 bits each, and its text.

    Places before the start are 0 like the start itself, which nothing precedes.
    """
    p = Positions(coded, 0)
    key = p.symbol.astype(np.uint64)
    for k in range(1, depth + 1):
        real = p.back >= k
        key[real] |= p.code[p.at[real] - k].astype(np.uint64) << np.uint64(BITS * k)
    return key.view(np.int64), p.text


def in_chunks(coded: DataFrame) -> DataFrame:
    """ids, rows, held_out: the texts dealt into rows of about SYMBOLS_AT_ONCE symbols, one after the other; each begins at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            cells = [b"".join(held), np.array(row, np.int64).tobytes(), np.array(out, bool).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["ids", "rows", "held_out"])

        held, row, out, size = [], [], [], 0
        for batch in batches:
            held += (ids := batch.column("ids").to_pylist())
            row += batch.column("row").to_pylist()
            out += batch.column("held_out").to_pylist()
            size += sum(map(len, ids)) // 2
            if size >= SYMBOLS_AT_ONCE:
                yield told()
                held, row, out, size = [], [], [], 0
        if held:
            yield told()

    return coded.select("ids", "row", "held_out").mapInArrow(run, "ids binary, rows binary, held_out binary")


def texts_of(ids: bytes) -> list[bytes]:
    """The texts of a chunk."""
    code = np.frombuffer(ids, "<u2")
    return [t.tobytes() for t in np.split(code, np.flatnonzero(code == START)[1:])]


def gram_counts(chunks: DataFrame, depth: int) -> DataFrame:
    """key and n: every context with its symbol that any text holds, and how often training texts do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held_out in zip(batch.column("ids").to_pylist(), batch.column("held_out").to_pylist()):
                key, text = packed(texts_of(ids), depth)
                kinds, at = np.unique(key, return_inverse=True)
                n = np.bincount(at, ~np.frombuffer(held_out, bool)[text], len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], names=["key", "n"])

    return chunks.select("ids", "held_out").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def low(key: Column, symbols: int) -> Column:
    """The last ``symbols`` symbols of a key."""
    return key.bitwiseAND(F.lit((1 << BITS * symbols) - 1))


def smoothed(k: int, counts: DataFrame, above: DataFrame | None, alphabet: int) -> DataFrame:
    """key, n, keep, rest, p of one depth: whether the context is kept, what it leaves to its suffix, and the symbol's probability after it.

    ``above`` is the depth before. A context has at most as many rows as the
    alphabet has symbols, so no window is larger.
    """
    e = counts.withColumn("below", F.lit(1.0 / alphabet))
    if k:
        e = counts.withColumn("low", low(F.col("key"), k)).join(above.select(F.col("key").alias("low"), F.col("p").alias("below")), "low")
    seen = F.col("n") > 0
    w = Window.partitionBy(F.shiftright("key", BITS))
    gain = F.when(seen, F.col("n") * F.log(F.col("n") / F.col("below"))).otherwise(0.0)
    e = e.select("key", "n", "below", F.sum("n").over(w).alias("total"), F.sum(seen.cast("long")).over(w).alias("size"), F.sum(gain).over(w).alias("gain"))
    keep = F.col("total") > 0
    if k:
        keep = keep & (F.col("gain") - F.col("total") * F.log("total") > 0.5 * F.col("size") * F.log(F.col("total") + 1.0))
    if k > 1:  # behind the start there is no longer context
        keep = keep & (F.shiftrightunsigned("key", BITS * (k - 1)) != 0)
    keep = F.coalesce(keep, F.lit(False))
    rest = F.when(keep, DISCOUNT * F.col("size") / F.col("total")).otherwise(1.0)
    own = F.when(keep & seen, (F.col("n") - DISCOUNT) / F.col("total")).otherwise(0.0)
    return e.select("key", "n", keep.alias("keep"), rest.alias("rest"), (own + rest * F.col("below")).alias("p"))


class Tree:
    """The tree as a table per depth. ``p`` of the last depth is the probability of a symbol in the state of the longest kept suffix.

    The look-ups below hold the whole tree as sorted arrays, for small trees;
    scoring asks the tables. State 0 is the empty context.
    """

    def __init__(self, levels: list[DataFrame], alphabet: int):
        self.levels, self.alphabet = levels, alphabet

    @cached_property
    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Back-off and suffix by state, edges by hash of state and symbol with their probabilities, and by depth the hashes of kept contexts and their states."""
        places, back_off, up, edges, p, known = {(): 0}, [1.0], [0], [np.empty(0, np.uint64)], [np.empty(0)], []
        for k, level in enumerate(self.levels):
            rows = level.filter("keep AND n > 0").toPandas()
            key = rows["key"].to_numpy(np.int64)
            own = []
            for c, rest in dict(zip((key >> BITS).tolist(), rows["rest"])).items():
                own.append(name := tuple(c >> BITS * i & (1 << BITS) - 1 for i in reversed(range(k))))
                if not k:
                    back_off[0] = rest
                    continue
                places[name] = len(back_off)
                back_off.append(rest)
                up.append(next(places[name[i:]] for i in range(1, k + 1) if name[i:] in places))
            state = np.array([places[tuple(c >> BITS * i & (1 << BITS) - 1 for i in reversed(range(k)))] for c in (key >> BITS).tolist()], np.int64)
            edges.append(self.key(state, key & (1 << BITS) - 1))
            p.append(rows["p"].to_numpy(float))
            hashes = np.zeros(len(own), np.uint64)
            for i in range(k):
                hashes = longer(hashes, np.array([name[i] for name in own], np.uint64))
            order = np.argsort(hashes)
            known.append((hashes[order], np.array([places[name] for name in own], np.int64)[order]))
        order = np.argsort(all_edges := np.concatenate(edges))
        return np.array(back_off), np.array(up), all_edges[order], np.concatenate(p)[order], known

    back_off = property(lambda self: self.held[0])
    up = property(lambda self: self.held[1])
    edges = property(lambda self: self.held[2])
    p = property(lambda self: self.held[3])
    known = property(lambda self: self.held[4])

    @staticmethod
    def key(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return mixed(state.astype(np.uint64) * POLY + symbol.astype(np.uint64))

    def find(self, k: int, context: np.ndarray) -> np.ndarray:
        """State of a context, -1 where it is not kept."""
        if k >= len(self.known) or not len(self.known[k][0]):
            return np.full(len(context), -1)
        known, state = self.known[k]
        i = np.minimum(np.searchsorted(known, context), len(known) - 1)
        return np.where(known[i] == context, state[i], -1)

    def chance(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Probability of each symbol in its state, smoothed down to the empty context and the alphabet."""
        state, factor, p = state.copy(), np.ones(len(state)), np.zeros(len(state))
        left = np.arange(len(state))
        while len(left) and len(self.edges):
            key = self.key(state[left], symbol[left])
            i = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[i] == key
            p[left[hit]] = factor[left[hit]] * self.p[i[hit]]
            left = left[~hit]
            factor[left] *= self.back_off[state[left]]
            root = state[left] == 0
            p[left[root]] = factor[left[root]] / self.alphabet
            left = left[~root]
            state[left] = self.up[state[left]]
        p[left] = factor[left] / self.alphabet
        return p

    def log_p(self, coded: list[bytes]) -> np.ndarray:
        """log10 probability of each text's symbols."""
        p = Positions(coded, len(self.known) - 1)
        state = np.zeros(len(p.at), np.int64)
        for k, here, context, _ in p.contexts():
            found = self.find(k, context)
            state[here[found >= 0]] = found[found >= 0]
        return np.bincount(p.text, np.log10(self.chance(state, p.symbol)), len(coded))


def grown_tree(coded: DataFrame, alphabet: int, tokens: int, depth: int = DEPTH) -> Tree:
    """The tree of coded texts or of chunks of them, all training ones unless ``held_out`` says otherwise.

    Every context and every edge is counted, tested and kept in tables. What only
    held-out texts hold is counted 0, so that it, too, finds its probability there.
    """
    if not 0 <= depth <= 3:
        raise ValueError("a context and its symbol are one long, so a context has three symbols at most")
    if "rows" not in coded.columns:
        for name, value in (("row", F.lit(0).cast("long")), ("held_out", F.lit(False))):
            coded = coded if name in coded.columns else coded.withColumn(name, value)
        coded = in_chunks(coded)
    counts = [kept(gram_counts(coded, depth), "grams")]
    for k in range(depth, 0, -1):
        fewer = counts[0].groupBy(low(F.col("key"), k).alias("key")).agg(F.sum("n").alias("n"))
        counts.insert(0, kept(fewer, "grams"))
    levels: list[DataFrame] = []
    for k, n in enumerate(counts):
        levels.append(smoothed(k, n, levels[-1] if k else None, alphabet))
    return Tree(levels, alphabet)


class Dealing:
    """Which bucket a context of ``depth`` symbols belongs to: that of its suffix; a frequent suffix has several, chosen by the oldest symbol.

    So a bucket holds whole contexts, and the suffix's probabilities go to its few buckets.
    """

    def __init__(self, depth: int, buckets: int, hot: np.ndarray, deals: np.ndarray):
        self.depth, self.buckets, self.hot, self.deals = depth, buckets, hot, deals

    def split(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix and oldest symbol of the contexts of keys of the last depth."""
        key = key.view(np.uint64)
        suffix = (key >> np.uint64(BITS)) & np.uint64((1 << BITS * max(0, self.depth - 1)) - 1)
        return suffix, key >> np.uint64(BITS * self.depth) if self.depth else np.zeros(len(key), np.uint64)

    def times(self, suffix: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.ones(len(suffix), np.uint64)
        i = np.minimum(np.searchsorted(self.hot, suffix), len(self.hot) - 1)
        return np.where(self.hot[i] == suffix, self.deals[i], np.uint64(1))

    def place(self, suffix: np.ndarray, deal: np.ndarray) -> np.ndarray:
        return (mixed(suffix * POLY + deal) % np.uint64(self.buckets)).astype(np.int64)

    def kinds(self, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk: its distinct edges as suffix, oldest symbol and symbol in one long, sorted; their buckets and the order by bucket; the edge and the text of each place."""
        key, text = packed(texts_of(ids), self.depth)
        suffix, oldest = self.split(key)
        edge = suffix << np.uint64(2 * BITS) | oldest << np.uint64(BITS) | key.view(np.uint64) & np.uint64((1 << BITS) - 1)
        edge, at = np.unique(edge, return_inverse=True)
        suffix, oldest = edge >> np.uint64(2 * BITS), edge >> np.uint64(BITS) & np.uint64((1 << BITS) - 1)
        bucket = self.place(suffix, mixed(oldest + POLY) % self.times(suffix))
        return edge, bucket, np.argsort(bucket, kind="stable"), at, text


def asked(chunks: DataFrame, dealing: Dealing) -> DataFrame:
    """bucket, chunk, edges, n: by bucket the distinct edges of a chunk and how often its training texts have them. Symbols lie together place by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, held_out in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "held_out"))):
                edge, bucket, order, at, text = dealing.kinds(ids)
                n = np.bincount(at, ~np.frombuffer(held_out, bool)[text], len(edge)).astype("<u4")[order]
                edge, bucket = edge[order], bucket[order]
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                rows = [(e.view("<u2").reshape(-1, 4).T.tobytes(), m.tobytes()) for e, m in zip(np.split(edge, first[1:]), np.split(n, first[1:]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[first], pa.int64()), pa.array([chunk] * len(first), pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*rows))],
                    names=["bucket", "chunk", "edges", "n"])

    return chunks.select("chunk", "ids", "held_out").mapInArrow(run, "bucket long, chunk long, edges binary, n binary")


def dealt(above: DataFrame, dealing: Dealing) -> DataFrame:
    """bucket, keys, p: the probabilities of the depth before, in every bucket that holds contexts with that suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            key, p = np.concatenate(keys).view(np.uint64), np.concatenate(ps)
            suffix = key >> np.uint64(BITS)
            times = dealing.times(suffix).astype(np.int64)
            row = np.repeat(np.arange(len(key)), times)
            deal = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
            both = np.unique(dealing.place(suffix[row], deal) * len(key) + row)
            bucket, row = both // len(key), both % len(key)
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            parts = [[x.tobytes() for x in np.split(c[row], first[1:])] for c in (key, p)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64()), *(pa.array(c, pa.binary()) for c in parts)], names=["bucket", "keys", "p"])

        keys, ps, size = [], [], 0
        for batch in batches:
            if batch.num_rows:
                keys.append(batch.column("key").to_numpy())
                ps.append(batch.column("p").to_numpy())
                size += batch.num_rows
            if size >= SYMBOLS_AT_ONCE:
                yield told()
                keys, ps, size = [], [], 0
        if keys:
            yield told()

    return above.select("key", "p").mapInArrow(run, "bucket long, keys binary, p binary")


def answered(asked: DataFrame, above: DataFrame, dealing: Dealing, alphabet: int) -> DataFrame:
    """chunk, bucket, log_p: log10 probability of each edge asked for, in the order of the question.

    The contexts of a bucket are counted over all chunks, tested and smoothed as in ``smoothed``.
    """
    k = dealing.depth

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = [np.frombuffer(e, "<u2").reshape(4, -1).T.copy().view("<u8").ravel() for e in left.column("edges").to_pylist()]
        edge, at = np.unique(np.concatenate([np.empty(0, np.uint64), *lists]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.empty(0), *(np.frombuffer(b, "<u4") for b in left.column("n").to_pylist())]), len(edge))
        below = np.full(len(edge), 1.0 / alphabet)
        suffix = edge >> np.uint64(2 * BITS)
        if k and len(edge):
            key = np.frombuffer(b"".join(right.column("keys").to_pylist()), "<u8")
            order = np.argsort(key)
            place = np.searchsorted(key[order], suffix << np.uint64(BITS) | edge & np.uint64((1 << BITS) - 1))
            below = np.frombuffer(b"".join(right.column("p").to_pylist()), "<f8")[order][place]
        context = edge >> np.uint64(BITS)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(edge) else np.empty(0, np.int64)
        own = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(edge)]))
        seen = n > 0
        total, size = np.bincount(own, n, len(first)), np.bincount(own, seen, len(first))
        gain = np.bincount(own, np.where(seen, n * np.log(np.maximum(n, 1) / below), 0.0), len(first))
        some = np.maximum(total, 1)
        keep = total > 0
        if k:
            keep &= gain - total * np.log(some) > 0.5 * size * np.log(total + 1.0)
        if k > 1:  # behind the start there is no longer context
            head = suffix[first] >> np.uint64(BITS * (k - 2))
            keep &= (head != 0) | (context[first] & np.uint64((1 << BITS) - 1) != 0)
        rest = np.where(keep, DISCOUNT * size / some, 1.0)
        p = np.where(keep[own] & seen, (n - DISCOUNT) / some[own], 0.0) + rest[own] * below
        parts = np.split(np.log10(p)[at], np.cumsum([len(x) for x in lists])[:-1]) if lists else []
        return pa.table({"chunk": left.column("chunk"), "bucket": left.column("bucket"), "log_p": pa.array([x.tobytes() for x in parts], pa.binary())})

    return asked.groupBy("bucket").cogroup(dealt(above, dealing).groupBy("bucket")).applyInArrow(run, "chunk long, bucket long, log_p binary")


def text_scores(chunks: DataFrame, tree: Tree, tokens: int, depth: int) -> DataFrame:
    """row and score: the sum of log10 probabilities of each text, after contexts of ``depth`` symbols above the depths of the tree.

    A chunk asks every bucket once for each of its distinct edges and gets them back in order.
    """
    spark = chunks.sparkSession
    buckets = max(2 * task_count(chunks), tokens // BUCKET_TOKENS)
    above = kept(tree.levels[-1].select("key", "n", "p"), "level")
    often = above.groupBy(F.shiftright("key", BITS).alias("suffix")).agg(F.sum("n").alias("n")).filter(F.col("n") * 4 * buckets > tokens)
    hot = sorted((r["suffix"], -(-r["n"] * 4 * buckets // tokens)) for r in often.collect()) if depth else []
    dealing = Dealing(depth, buckets, np.array([g for g, _ in hot], np.uint64), np.array([d for _, d in hot], np.uint64))
    answers = answered(asked(chunks, dealing), above, dealing, tree.alphabet)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, scores = [np.empty(0, np.int64)], [np.empty(0)]
        for ids, row in zip(left.column("ids").to_pylist(), left.column("rows").to_pylist()):
            edge, _, order, at, text = dealing.kinds(ids)
            by_bucket = sorted(zip(right.column("bucket").to_pylist(), right.column("log_p").to_pylist()))
            log_p = np.empty(len(edge))
            log_p[order] = np.frombuffer(b"".join(b for _, b in by_bucket), "<f8")
            rows.append(np.frombuffer(row, np.int64))
            scores.append(np.bincount(text, log_p[at], len(rows[-1])))
        return pa.table({"row": np.concatenate(rows), "score": np.concatenate(scores)})

    return chunks.select("chunk", "ids", "rows").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, "row long, score double")


class Shares:
    """Probabilities of words within the rare symbol, and of all words under the base."""

    def __init__(self, known: DataFrame, ends: int):
        """From the training words: their number of tokens and kinds, and how many kinds were seen once to four times."""
        seen = [F.sum((F.col("n") == i).cast("long")) for i in range(1, 5)]
        row = known.agg(F.sum("n"), F.count("*"), *seen).first()
        self.tokens, self.kinds = (row[0] or 0) + ends, row[1] + (ends > 0)
        n1, n2, n3, n4 = ((x or 0) for x in row[2:])
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        self.off = np.array([0.0, *(min(max(i - (i + 1) * y * b / a, 0.1), i - 0.1) if a and b else DISCOUNT for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])
        rare = known.filter(F.col("n") < SYMBOL * self.tokens)
        amount = sum((F.when(F.least("n", F.lit(3)) == i, float(self.off[i])).otherwise(0.0) for i in (1, 2, 3)), F.lit(0.0))
        self.rare, freed = rare.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(amount), F.lit(0.0))).first()
        self.new = max(freed, 0.5) / (self.rare + 0.5)  # without rare words, half a token for new ones

    def log_rare(self, n: np.ndarray) -> np.ndarray:
        """log10 share of a word seen n times among the rare ones; of all new ones together for 0."""
        own = np.maximum(n - self.off[np.minimum(n, 3)], 1e-9) / (self.rare + 0.5)
        return np.log10(np.where(n > 0, own, self.new))

    def log_base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


def coded(docs: DataFrame, common: pd.DataFrame, shares: Shares, symbols: int) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, base, score, ids, keys, times: every text in symbols, with the sums over the words that tasks hold.

    keys and times are hashes and counts of the other words.
    """
    session = docs.sparkSession
    n = common["n"].to_numpy()
    rare = np.where(np.arange(len(common)) < symbols, 0.0, shares.log_rare(n))
    code = np.where(np.arange(len(common)) < symbols, FIRST + np.arange(len(common)), RARE)
    sent = session.sparkContext.broadcast((common["word"].str.encode("utf-8").tolist(), code, rare, shares.log_base(n)))
    ends = shares.ends
    end_base = float(shares.log_base(np.array([ends]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, code, rare, base = sent.value
        place = dict(zip(names, range(1, len(names) + 1)))
        code, rare, base = np.r_[RARE, code].astype("<u2"), np.r_[0.0, rare], np.r_[0.0, base]
        edge = np.array([START, END], "<u2")
        for batch in batches:
            rows = []
            for raw in raw_texts(batch.column("text")):
                w = raw.lower().split()
                at = np.array([place.get(x, 0) for x in w], np.int64)
                ids = np.concatenate([edge[:1], code[at], edge[1:]])
                others = Counter(x for x, i in zip(w, at.tolist()) if not i)
                keys = np.array([xxhash.xxh64_intdigest(x, SEED) for x in others], np.uint64)
                rows.append((len(w) + 1, int((at > 0).sum()) + (ends > 0), float(base[at].sum()) + end_base, float(rare[at].sum()), ids.tobytes(),
                             keys.tobytes(), np.array(list(others.values()), "<u4").tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            own = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out")), *own],
                                             names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "ids", "keys", "times"])

    own = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text")
    return own.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, ids binary, keys binary, times binary")


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    As under the base, all words that no training text holds are one symbol. Null
    and empty texts are an end alone. A row without an id trains. Equal rows are
    scored together and come back as often as they were. Words and rows are joined
    by 64-bit hash. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    ends = docs.filter(~in_fold(F.col("doc_id"), FOLDS, HELD_OUT)).count()
    words = kept(lexicon(docs).filter("n > 0"), "lexicon")
    shares = Shares(words, ends)
    shares.ends = ends
    held = words.filter(F.col("n") >= min(FREQUENT, SYMBOL) * shares.tokens).orderBy(F.desc("n"), "word").toArrow().to_pandas()  # at most 1 / FREQUENT
    symbols = int((held["n"] >= SYMBOL * shares.tokens).sum())  # at most 1 / SYMBOL
    texts = kept(coded(docs, held, shares, symbols), "coded")
    chunks = kept(in_chunks(texts).withColumn("chunk", F.monotonically_increasing_id()), "symbols")
    tree = grown_tree(chunks, FIRST + symbols, shares.tokens, max(0, depth - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            total = np.array(batch.column("score").to_pylist(), float)
            keys = [np.frombuffer(b, np.int64) for b in batch.column("keys").to_pylist()]
            times = [np.frombuffer(b, "<u4") for b in batch.column("times").to_pylist()]
            more = np.repeat(np.arange(n), [len(k) for k in keys])
            row = batch.column("row").to_numpy()
            zero = np.zeros(len(more))
            first = lambda c: np.r_[batch.column(c).to_numpy(), zero.astype(np.int64)]
            doc = pa.concat_arrays([batch.column("doc_id"), pa.nulls(len(more), pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[row, row[more]]), doc, pa.array(np.r_[row, *keys]), pa.array(np.r_[np.zeros(n, np.int64), *times].astype(np.int64)),
                 pa.array(first("n_tokens")), pa.array(first("n_known")), pa.array(np.r_[batch.column("base").to_numpy(), zero]), pa.array(np.r_[total, zero])],
                names=["row", "doc_id", "key", "n", "n_tokens", "n_known", "base", "score"])

    rows = texts.drop("held_out", "ids").mapInArrow(run, "row long, doc_id long, key long, n long, n_tokens long, n_known long, base double, score double")
    others = words.filter(F.col("n") < min(FREQUENT, SYMBOL) * shares.tokens).select(F.xxhash64("word").alias("key"), F.col("n").alias("seen"))
    tokens = shares.tokens
    seen = F.coalesce("seen", F.lit(0))
    log10 = lambda x: F.log10(x)
    off = F.element_at(F.array(*[F.lit(float(x)) for x in shares.off]), (F.least(seen, F.lit(3)) + 1).cast("int"))
    rare = log10(F.when(seen > 0, F.greatest(seen - off, F.lit(1e-9)) / F.lit(shares.rare + 0.5)).otherwise(F.lit(shares.new)))
    base = log10((seen + 0.5) / F.lit(tokens + 0.5 * (shares.kinds + 1)))
    part = F.col("n") > 0
    met = rows.join(others, "key", "left").select(
        "row", "doc_id", (F.col("n_tokens") > 0).cast("long").alias("many"), "n_tokens",
        (F.col("n_known") + F.when(part & (seen > 0), F.col("n")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.when(part, F.col("n") * base).otherwise(0.0)).alias("base"),
        (F.col("score") + F.when(part, F.col("n") * rare).otherwise(0.0)).alias("score"))
    none = F.lit(0).cast("long")
    met = met.unionByName(text_scores(chunks, tree, shares.tokens, depth).select(
        "row", F.lit(None).cast("long").alias("doc_id"), none.alias("many"), none.alias("n_tokens"), none.alias("n_known"), F.lit(0.0).alias("base"), "score"))
    sums = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("many", "n_tokens", "n_known", "base", "score")])
    each = lambda c: (F.col(c) / F.col("many"))
    return sums.select(
        "doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), each("n_tokens").cast("long").alias("n_tokens"),
        each("n_known").cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), each("base").alias("base_score"),
        each("score").alias("score"), F.explode(F.array_repeat(F.lit(0), F.col("many").cast("int"))).alias("copy")).drop("copy")
