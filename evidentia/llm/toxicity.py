"""Toxicity by a weighted finite-state pattern grammar.

Words are read into classes (insult, threat, target, negation, report, other) and
small machines are composed over the words of a clause: negation arms for some
words, a report holds to the end of its clause, a target marks what is near it.
A matched insult or threat leaves the grammar as one of sixteen patterns by what
was armed, and each pattern has a weight, so "you are an idiot", "not an idiot"
and "they said idiot" score differently. The insult lexicon (beginnings of words
that documents labelled toxic hold far more often, each weighted by the log of
how much more often) and the weights of the patterns are learned from labels; the
grammar's own values are the prior where labels are silent.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import simhash
from .common import in_fold, raw_texts, small_batches
from .graph import components

CUTOFF, FOLDS, HELD_OUT = 0.7, 3, 1
#: Labelled documents of each class that the lexicon and the weights are fitted on at most, by a hash of the id.
SAMPLE = 20_000
#: Length of stems; documents that a stem needs at least, its lift, and the number of stems that may be found by chance.
STEM, STEM_LONGEST, FEWEST, RATIO, RISK = 4, 9, 4, 5.0, 0.5
#: Weight of a word that the grammar knows and the labels say nothing of: as of a stem with e to this lift.
KNOWN = 4.0
COUNTER_KEYS = 300_000

# Words that the grammar knows before it sees a label.
INSULTS = ["idiot", "moron", "stupid", "imbecile", "scum", "loser", "worthless", "pathetic", "disgusting", "dumbass", "bastard", "bitch", "asshole"]
THREATS = ["kill", "murder", "strangle", "stab", "lynch", "töte", "umbring", "tuerai", "mataré"]
TARGETS = ["you", "your", "you're", "u", "he", "she", "they", "him", "her", "them", "du", "dich", "ihr", "euch", "sie", "er", "tu", "toi", "vous", "il", "elle", "ils", "tú", "vosotros", "él", "ella", "ellos"]
NEGATIONS = ["not", "no", "never", "isn't", "aren't", "wasn't", "don't", "won't", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "jamás"]
REPORTS = ["said", "says", "called", "wrote", "claimed", "quoted", "reported", "accused", "sagte", "nannte", "schrieb", "dit", "appelé", "écrit", "dijo", "llamó", "escribió"]

WORDS = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[\"“”«»„]")
CLAUSE_ENDS = re.compile(r"[.!?;:\n|]+")
QUOTES = set("\"“”«»„")
#: Words that a negation and a target reach over.
NEGATION_REACH, TARGET_REACH = 3, 3
#: Prior weights: of a match by its kind, and what each armed machine adds.
PRIOR = {"insult": 2.5, "threat": 1.0, "aimed": 1.0, "negated": -2.0, "reported": -1.5}
BIAS, SPREAD, ENOUGH = -4.0, 3.0, 5.0
PATTERNS = [(kind, aimed, negated, reported) for kind in ("insult", "threat") for aimed in (0, 1) for negated in (0, 1) for reported in (0, 1)]
PLACE = {p: i for i, p in enumerate(PATTERNS)}


def prior() -> np.ndarray:
    """Of all insults, of all threats, of each pattern beyond that, and of a text without any."""
    beyond = [a * PRIOR["aimed"] + n * PRIOR["negated"] + r * PRIOR["reported"] for _, a, n, r in PATTERNS]
    return np.array([PRIOR["insult"], PRIOR["threat"], *beyond, BIAS])


class Grammar:
    """Recognises the patterns of a text; built once per task from the stems."""

    def __init__(self, stems: dict[str, float]):
        self.trie = ahocorasick.Automaton()
        for stem in {*stems, *THREATS}:
            self.trie.add_word(stem, (len(stem), "insult" if stem in stems else "threat", stems.get(stem, KNOWN)))
        self.trie.make_automaton()
        self.classes = {w: c for c, known in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in known}

    def clause(self, words: list[tuple[int, str]], hits: dict[int, tuple[str, float]], sums: list[float]) -> None:
        """Run the machines over one clause: (place, word), and class and weight of the words that matched, by place."""
        negation = target = reported = 0
        waiting: list[tuple[int, str, int, int, float]] = []  # matches that a target may still follow
        for place, word in words:
            if place in hits:
                kind, weight = hits[place]
                if target:
                    sums[PLACE[kind, 1, int(negation > 0), reported]] += weight
                else:
                    waiting.append((TARGET_REACH, kind, int(negation > 0), reported, weight))
                continue
            known = "report" if word in QUOTES else self.classes.get(word)
            negation = NEGATION_REACH if known == "negation" else max(0, negation - 1)
            target = TARGET_REACH if known == "target" else max(0, target - 1)
            reported = 1 if known == "report" else reported
            later = []
            for left, k, n, r, weight in waiting:
                if known == "target" or left == 1:
                    sums[PLACE[k, int(known == "target"), n, r]] += weight
                else:
                    later.append((left - 1, k, n, r, weight))
            waiting = later
        for _, k, n, r, weight in waiting:
            sums[PLACE[k, 0, n, r]] += weight

    def patterns(self, text: str) -> list[float]:
        """The weight of all matches of each pattern in the whole text; clauses without a matched word are not read."""
        sums = [0.0] * len(PATTERNS)
        low = text.lower()
        hits: dict[int, tuple[str, float]] = {}
        for end, (size, kind, weight) in self.trie.iter(low):
            start = end - size + 1
            if start == 0 or not low[start - 1].isalnum():
                hits[start] = max(hits.get(start, (kind, weight)), (kind, weight), key=lambda h: h[1])
        done = -1
        for start in sorted(hits):
            if start < done:
                continue
            a = b = start
            while a > 0 and low[a - 1] not in ".!?;:\n|":
                a -= 1
            ends = CLAUSE_ENDS.search(low, start)
            b = ends.start() if ends else len(low)
            self.clause([(m.start(), m.group()) for m in WORDS.finditer(low, a, b)], hits, sums)
            done = b
        return sums


def features(sums: np.ndarray) -> np.ndarray:
    """Weights by kind, in steps of a known word up to ENOUGH of them, then of each pattern on a log scale, and a constant."""
    half = len(PATTERNS) // 2
    by_kind = np.stack([sums[:, :half].sum(axis=1), sums[:, half:].sum(axis=1)], axis=1)
    return np.hstack([np.minimum(by_kind / KNOWN, ENOUGH), np.log1p(sums), np.ones((len(sums), 1))])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Most likely weights under the normal prior, by Newton steps; without rows the prior itself."""
    start = prior()
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - (w - start) / SPREAD**2
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / SPREAD**2
        step = np.linalg.solve(bend, slope)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """text and toxic of at most ``limit`` training documents of each class; conflicting labels count as toxic."""
    trained = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
    one = trained.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = one.filter("toxic").orderBy(*order).limit(limit).union(one.filter("not toxic").orderBy(*order).limit(limit))
    # at most 2 * limit ids and flags, under 1 MB: fit to be sent to every executor
    return docs.select("doc_id", "text").join(F.broadcast(stage(some, "labelled")), "doc_id").select("text", "toxic")


def fingerprinted(sample: DataFrame) -> DataFrame:
    """text, toxic and fp, the text's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([simhash.fingerprint(raw) for raw in raw_texts(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), fp], names=["text", "toxic", "fp"])

    return sample.select("text", "toxic").mapInArrow(run, "text string, toxic boolean, fp long")


def distinct_texts(sample: DataFrame) -> DataFrame:
    """text and toxic of one document for each class and group of near-copies: fingerprints as linked by ``simhash``.

    Copies of a document would make its chance beginnings look common. The sample bounds the texts that are moved.
    """
    made = stage(fingerprinted(sample), "sample_fingerprints")
    roots = components(simhash.links(made.select("fp").distinct())).withColumnRenamed("node", "fp")
    known = made.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return known.groupBy("root", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def stem_counts(sample: DataFrame) -> DataFrame:
    """stem, toxic, clean: documents of each class that hold a word with this beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told() -> pa.RecordBatch:
            keys = list(seen)
            out = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(out, names=["stem", "toxic", "n"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = {m.group() for m in WORDS.finditer((text or "").lower())}
                stems = {w[:n] for w in words for n in range(STEM, min(STEM_LONGEST, len(w)) + 1)}
                seen.update((s, bool(toxic)) for s in stems)
                if len(seen) > COUNTER_KEYS:
                    yield told()
        yield told()

    parts = sample.mapInArrow(run, "stem string, toxic boolean, n long")
    of = lambda toxic, what: F.sum(F.when(F.col("toxic") == F.lit(toxic), F.col("n")).otherwise(0)).alias(what)
    return parts.groupBy("stem").agg(of(True, "toxic"), of(False, "clean"))


def tail(hits: int, n: int, p: float) -> float:
    """Chance of at least ``hits`` of ``n`` at rate ``p``."""
    at = lambda k: math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    return min(1.0, sum(at(k) for k in range(hits, min(n, hits + 60) + 1)))


def learned_stems(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Beginnings of words that toxic documents hold far more often than clean ones, each as long as it keeps nearly all its hits, and the log of that lift.

    With them the words that the grammar knows, where labels say anything of them.
    """
    counts = stage(stem_counts(sample), "stems")
    lift = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    counts = counts.withColumn("lift", F.log(lift))
    rows = counts.filter((F.col("toxic") >= FEWEST) & (F.col("lift") >= math.log(RATIO))).collect()  # bounded by the sample
    known = counts.filter(F.col("stem").isin(INSULTS) & (F.col("toxic") + F.col("clean") >= FEWEST)).collect()
    lifts = {r["stem"]: r["lift"] for r in rows}
    tried = max(1, counts.filter(F.col("toxic") + F.col("clean") >= FEWEST).count())  # rarer ones could not pass
    rate = lambda r: (r["clean"] + 1) / (n_clean + 2)
    hits = {r["stem"]: r["toxic"] for r in rows if tail(r["toxic"], n_toxic, rate(r)) <= RISK / tried}
    longer: dict[str, int] = {}
    for stem, n in hits.items():
        longer[stem[:-1]] = max(longer.get(stem[:-1], 0), n)
    full = {s for s, n in hits.items() if longer.get(s, 0) < 0.95 * n}
    found = {s: lifts[s] for s in full if not any(s[:k] in full for k in range(STEM, len(s)))}
    return {r["stem"]: max(r["lift"], 0.0) for r in known} | found


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """Stems and pattern weights from the training fold; without labels the grammar's own."""
    sample = stage(labelled_sample(docs, labels, limit), "sample")
    distinct = stage(distinct_texts(sample), "distinct_texts")
    sizes = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    stems = dict.fromkeys(INSULTS, KNOWN) | (learned_stems(distinct, n_toxic, n_clean) if n_toxic and n_clean else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, seen = Grammar(stems), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[bool(toxic), tuple(grammar.patterns(text or ""))] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.bool_()), pa.array([list(k[1]) for k in keys], pa.list_(pa.float64())),
                                          pa.array([seen[k] for k in keys], pa.int64())], names=["toxic", "sums", "n"])

    rows = sample.mapInArrow(run, "toxic boolean, sums array<double>, n long").collect()  # at most 2 * limit
    if not rows:
        return stems, prior()
    x = features(np.array([r["sums"] for r in rows]))
    many = np.array([r["n"] for r in rows])
    return stems, fit(np.repeat(x, many, axis=0), np.repeat(np.array([float(r["toxic"]) for r in rows]), many))


def scored(docs: DataFrame, labels: DataFrame, keep: list[str], limit: int = SAMPLE) -> DataFrame:
    """The columns ``keep`` of every row with score, under a name that none of them has, last.

    A null or empty text matches nothing and has the score of that.
    """
    small_batches(docs.sparkSession)
    stems, weights = learn(docs, labels, limit)
    name = "score" if "score" not in keep else "score_" + "_".join(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        for batch in batches:
            sums = np.array([grammar.patterns(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(PATTERNS))
            score = 1 / (1 + np.exp(-np.clip(features(sums) @ weights, -30, 30)))
            cols = [batch.column(c) for c in keep] + [pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, name])

    schema = docs.select(*keep).schema.add(name, "double")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; empty tables give no rows."""
    out = scored(docs, labels, ["doc_id"], limit)
    return out.select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that score under the cutoff."""
    out = scored(docs, labels, docs.columns, limit)
    return out.filter(F.col(out.columns[-1]) < cutoff).select(*docs.columns)
