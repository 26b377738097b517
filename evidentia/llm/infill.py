"""Fill-in-the-middle texts, cut at tokens found by a wavelet matrix over character classes.

The bytes of a run of texts become classes: the start of a character that begins a
token (a non-letter, or a letter after a non-letter), a letter after a letter, a
byte that continues a character. A wavelet matrix over them answers how many of a
class stand before a place. Boundary counts are the sum of the ranks of the two
classes that begin a token, characters all places but those of the continuing
class. A cut after m tokens is the place of boundary m + 1, found by bisection on
the boundary counts, for all texts of the run at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, small_batches

#: Fixed values of the contract: the marks, the seed, shares in percent of texts that may be cut and of those in suffix-first order.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, CUT, SPM = 1, 90, 20
#: Classes of bytes: a token of one character, a run's first letter, its further letters, bytes that continue a character.
SINGLE, FIRST, LATER, INSIDE = range(4)
CLASS_BITS = 2
#: Bytes of texts for which one matrix is made; a longer text has one of its own.
RUN_BYTES = 4 << 20


class Bits:
    """A bit sequence with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([words, np.zeros(-len(words) % 8 + 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << rest) - np.uint64(1)))


class WaveletMatrix:
    """Ranks over a sequence of small numbers: one bit sequence per bit, highest first, each put in the order of the bits before it."""

    def __init__(self, symbols: np.ndarray, n_bits: int):
        self.levels = []
        for shift in range(n_bits - 1, -1, -1):
            bit = (symbols >> shift) & 1
            zero = bit == 0
            self.levels.append((shift, Bits(bit), int(zero.sum())))
            symbols = np.concatenate([symbols[zero], symbols[~zero]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols equal ``symbol``."""
        low, high = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for shift, bits, zeros in self.levels:
            a, b = bits.ones(low), bits.ones(high)
            low, high = (zeros + a, zeros + b) if symbol >> shift & 1 else (low - a, high - b)
        return high - low


def classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of every byte; a text's first byte never follows a letter."""
    lower = raw | 0x20
    letter = (lower >= ord("a")) & (lower <= ord("z")) & (raw < 0x80)
    after = np.zeros(len(raw), bool)
    after[1:] = letter[:-1]
    after[starts[starts < len(raw)]] = False
    return np.where(letter, np.where(after, LATER, FIRST), np.where((raw & 0xC0) == 0x80, INSIDE, SINGLE)).astype(np.uint8)


class Places:
    """Token and character counts of a run of texts that follow each other."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = self.ends - [len(t) for t in texts]
        self.matrix = WaveletMatrix(classes(raw, self.starts), CLASS_BITS)

    def tokens(self, at: np.ndarray) -> np.ndarray:
        return self.matrix.rank(SINGLE, at) + self.matrix.rank(FIRST, at)

    def characters(self, at: np.ndarray) -> np.ndarray:
        return at - self.matrix.rank(INSIDE, at)

    def after(self, units: np.ndarray) -> np.ndarray:
        """By text, the place at which ``units`` of its tokens are over: the next token's start, or the text's end."""
        wanted = self.tokens(self.starts) + units + 1
        low, high = self.starts.copy(), self.ends + 1
        # the least place with the wanted count before it; ends + 1 stands for none
        while (low < high).any():
            mid = (low + high) // 2
            enough = self.tokens(np.minimum(mid, self.ends)) >= wanted
            high, low = np.where(enough | (mid > self.ends), mid, high), np.where(enough | (mid > self.ends), low, mid + 1)
        return np.minimum(low - 1, self.ends)


def draws(key: bytes, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(b"%d:%s" % (seed, key)).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def filled(texts: list[bytes], keys: list[bytes], seed: int = SEED, cut: int = CUT, spm: int = SPM) -> list[tuple]:
    """By text: tokens, form, characters of prefix and middle (None if plain), output."""
    at = Places(texts)
    n = at.tokens(at.ends) - at.tokens(at.starts)
    h = np.array([draws(k, seed) for k in keys], np.int64).reshape(len(keys), 4)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = np.array([not t or any(m in t for m in marks) for t in texts], bool) | (h[:, 2] % 100 >= cut)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    first, second = at.after(np.minimum(one, two)), at.after(np.maximum(one, two))
    chars = [at.characters(x) for x in (at.starts, first, second)]
    out = []
    for i, text in enumerate(texts):
        if plain[i]:
            out.append((int(n[i]), "plain", None, None, text))
            continue
        a, b = int(first[i] - at.starts[i]), int(second[i] - at.starts[i])
        p, m, s = text[:a], text[a:b], text[b:]
        form = "spm" if h[i, 3] % 100 < spm else "psm"
        parts = [marks[1], s, marks[0], p, marks[2], m] if form == "spm" else [marks[0], p, marks[1], s, marks[2], m]
        out.append((int(n[i]), form, int(chars[1][i] - chars[0][i]), int(chars[2][i] - chars[1][i]), b"".join(parts)))
    return out


def runs(sizes: list[int], most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` bytes, or one longer text."""
    a, held = 0, 0
    for i, size in enumerate(sizes):
        if i > a and held + size > most:
            yield a, i
            a, held = i, 0
        held += size
    if a < len(sizes):
        yield a, len(sizes)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, cut: int = CUT, spm: int = SPM) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row, whole texts.

    A null text is empty, a null key draws like an empty one, so rows of equal key
    and tokens are cut alike. An empty text, and one that holds a mark, stays
    plain. ``n`` counts the tokens ``[A-Za-z]+|[^A-Za-z]``. Rows stay in their
    task; other columns are left behind.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key), F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = raw_texts(batch.column(2)), raw_texts(batch.column(1))
            for a, b in runs([len(t) for t in texts]):
                n, form, prefix, middle, out = zip(*filled(texts[a:b], keys[a:b], seed, cut, spm))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], [key, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = own.schema[key].dataType.simpleString()
    return own.mapInArrow(rows, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part holds a mark, so the marks cut it exactly."""
    parts = F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(parts[0], parts[2], parts[1])).when(form == "spm", F.concat(parts[1], parts[2], parts[0]))
            .otherwise(output))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_in_middle(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


FIM_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {CUT} THEN 'plain'
              WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
              ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""
