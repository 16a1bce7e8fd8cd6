"""Language identification by interpolated Kneser-Ney character models.

Each language has a character model of order ``ORDER``. Its n-grams lie in sorted arrays of
64-bit hashes, with full interpolated log-probabilities beside them and the back-off weight of
each context; a look-up is a binary search. A text goes to the language under which its
length-normalised cross-entropy is least. Confidence is calibrated on learning rows that the
models have not seen, by logistic regression on the lead over the second language; a text that
no model explains as well as it did nearly all of those rows, or whose confidence is under one
half, is marked ``rejected``. The regression sees stretches of at most ``ROWS`` rows a language,
drawn by a hash, from ``PLACES`` places spread over the whole text.

Models are fitted on the driver from a sample bounded by ``SAMPLE_CHARS`` characters a
language (an expectation: rows are chosen by a hash of the id at a rate that counts over all
rows set; of rows over ``LONGEST`` characters a stretch of that length is learned, from a place
set by the hash). Every text is scored whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, mix, read, schema_of, without

#: Characters of an n-gram; characters of sample a language; longest sampled text; characters that have a number of their own in 8 bits, and in 16 where these don't do.
ORDER, SAMPLE_CHARS, LONGEST, ALPHABET, WIDE = 4, 600_000, 50_000, 250, 65_534
#: Share of the sample that calibrates; share of it whose cross-entropy is accepted; rows a language, and places a row and length, whose stretches the confidence is learned from.
CALIBRATE, ACCEPTED, ROWS, PLACES = 0.2, 0.995, 100, 5
_LETTER = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numerals such as ½ or ① are none."""
    return any(any(map(str.isalpha, m[0])) for m in _LETTER.finditer(text))


class Symbols:
    """Character numbers: 0 ends a text, 1 is any unknown character, the others are the known ones.

    Numbers have 8 bits if that is enough for all characters, else 16: four of them fill a 64-bit n-gram.
    """

    def __init__(self, texts: list[str]):
        points = np.concatenate([np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]) if texts else np.zeros(0, dtype=np.uint32)
        found, count = np.unique(points, return_counts=True)
        self.bits = 8 if len(found) <= ALPHABET else 16
        best = found[np.lexsort((found, -count))][:WIDE]
        self.table = np.ones(0x110000, dtype=np.uint16)
        self.table[best] = np.arange(2, 2 + len(best))

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-gram numbers (``bits`` a symbol) of all texts end to end, and where each text begins; a text has one more than its characters."""
        pad = b"\0" * (4 * ORDER)
        joined = pad.join(t.encode("utf-32-le", "surrogatepass") for t in texts)
        points = np.frombuffer(pad + joined + pad, dtype=np.uint32)
        syms = self.table[points].astype(np.uint64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begin = ORDER + np.concatenate(([0], np.cumsum(sizes + ORDER)))[:-1]
        outside = np.zeros(len(syms), dtype=np.int8)
        outside[:ORDER] = 1
        gaps = (begin + sizes)[:, None] + np.arange(ORDER)[None, :]
        outside[gaps.ravel()] = 1
        syms[outside == 1] = 0
        code = syms.copy()
        for k in range(1, ORDER):
            code[k:] |= syms[:-k] << np.uint64(self.bits * k)
        inside = outside == 0
        inside[begin + sizes] = True  # the end of the text is predicted as well
        return code[inside], np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]


class KneserNey:
    """One language's model, fitted on n-gram numbers."""

    def __init__(self, codes: np.ndarray, discount: float = 0.75, bits: int = 8):
        self.bits = bits
        grams, count = np.unique(codes, return_counts=True)
        count = count.astype(np.float64)
        levels = []
        for n in range(ORDER, 0, -1):
            levels.append((grams, count))
            # the next order counts in how many ways a gram is continued to the left
            grams, count = np.unique(grams & np.uint64((1 << (bits * (n - 1))) - 1), return_counts=True)
            count = count.astype(np.float64)
        self.hashes, self.logs, self.contexts, self.weights = [], [], [], []
        below_grams, below = np.zeros(0, dtype=np.uint64), np.zeros(0)
        for n, (grams, count) in zip(range(1, ORDER + 1), reversed(levels), strict=True):
            heads, at = np.unique(grams >> np.uint64(bits), return_inverse=True)
            total, kinds = np.bincount(at, weights=count), np.bincount(at)
            weight = discount * kinds / total
            if n == 1:
                lower = np.full(len(grams), 1 / (1 << bits))
            else:
                lower = below[np.searchsorted(below_grams, grams & np.uint64((1 << (bits * (n - 1))) - 1))]
            prob = np.maximum(count - discount, 0) / total[at] + weight[at] * lower
            below_grams, below = grams, prob
            for keys, values, to_keys, to_values in ((grams, np.log(prob), self.hashes, self.logs), (heads, np.log(weight), self.contexts, self.weights)):
                h = mix(keys, n)
                order = np.argsort(h)
                to_keys.append(h[order])
                to_values.append(values[order])

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of the last character of each n-gram after the others."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for n in range(ORDER, 0, -1):
            own = codes[left] & np.uint64((1 << (self.bits * n)) - 1)
            at, hit = self._find(self.hashes[n - 1], mix(own, n))
            out[left[hit]] += self.logs[n - 1][at[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return out
            at, hit = self._find(self.contexts[n - 1], mix(own >> np.uint64(self.bits), n))
            out[left[hit]] += self.weights[n - 1][at[hit]]
        out[left] += np.log(1 / (1 << self.bits))
        return out

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted


class Identifier:
    """The models of all languages, with the calibration of their decisions."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        self.models: list[KneserNey] = []
        self.slope, self.shift, self.limits = 1.0, 0.0, np.zeros(0)
        if not self.langs:
            return
        aside = np.arange(len(texts)) % round(1 / CALIBRATE) == 0
        for lang in self.langs:  # a language with one row learns from it
            own = np.array([x == lang for x in langs])
            if all(aside[own]):
                aside[own] = False
        texts = [t.lower() for t in texts]
        self.symbols = Symbols([t for t, a in zip(texts, aside, strict=True) if not a])
        for lang in self.langs:
            own = [t for t, x, a in zip(texts, langs, aside, strict=True) if x == lang and not a]
            self.models.append(KneserNey(self.symbols.codes(own)[0], bits=self.symbols.bits))
        self._calibrate([t for t, a in zip(texts, aside, strict=True) if a], [x for x, a in zip(langs, aside, strict=True) if a])

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy a character of lower-cased texts under every model."""
        codes, begin = self.symbols.codes(texts)
        kinds, place = np.unique(codes, return_inverse=True)
        sizes = np.array([len(t) + 1 for t in texts])
        out = np.empty((len(texts), len(self.models)))
        for k, model in enumerate(self.models):
            out[:, k] = -np.add.reduceat(model.log_prob(kinds)[place], begin) / sizes
        return out

    def _lead(self, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if h.shape[1] < 2:
            return np.full(len(h), 10.0)
        two = np.sort(h, axis=1)[:, :2]
        return (two[:, 1] - two[:, 0]) * np.sqrt(np.minimum(sizes, 400))

    @staticmethod
    def _drawn(texts: list[str], langs: list[str]) -> list[tuple[str, str]]:
        """At most ``ROWS`` rows of every language, by a hash of the text."""
        order = sorted(range(len(texts)), key=lambda i: (langs[i], zlib.crc32(texts[i].encode("utf-8", "surrogatepass")), texts[i]))
        first = {}
        for place, i in enumerate(order):
            first.setdefault(langs[i], place)
        return [(texts[i], langs[i]) for place, i in enumerate(order) if place - first[langs[i]] < ROWS]

    def _calibrate(self, texts: list[str], langs: list[str]) -> None:
        self.limits = np.full(len(self.langs), np.inf)
        if not texts:
            return
        h = self.entropies(texts)
        best = h.argmin(axis=1)
        for k in range(len(self.langs)):
            own = h[best == k, k]
            if len(own):
                self.limits[k] = np.quantile(own, ACCEPTED) * 1.05
        # whole texts are told apart too easily to learn from; stretches of 6 to 48 characters are not
        parts = [(t[i : i + n], x) for t, x in self._drawn(texts, langs) for n in (6, 12, 24, 48) for i in range(0, len(t) - n + 1, max(400, (len(t) - n) // PLACES + 1)) if t[i : i + n].strip()]
        parts = [(t, x) for t, x in parts if has_letter(t)]
        if not parts:
            return
        h = self.entropies([t for t, _ in parts])
        lead = self._lead(h, np.array([len(t) for t, _ in parts]))
        target = np.array([self.langs[k] == x for k, (_, x) in zip(h.argmin(axis=1), parts, strict=True)], dtype=np.float64)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * lead + b, -30, 30)))
            g, w = target - p, np.maximum(p * (1 - p), 1e-4)
            haa, hab, hbb = (w * lead**2).sum() + 1, (w * lead).sum(), w.sum() + 1
            ga, gb = (g * lead).sum() - (a - 1), g.sum() - b
            det = haa * hbb - hab * hab
            a, b = a + 0.5 * (hbb * ga - hab * gb) / det, b + 0.5 * (haa * gb - hab * ga) / det
        self.slope, self.shift = max(a, 1e-3), b

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, confidence, cross-entropy and rejection of every text; ``und`` if it has no letter."""
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        entropy, rejected = np.full(len(texts), np.nan), np.ones(len(texts), dtype=bool)
        some = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.langs else []
        if some:
            own = [texts[i].lower() for i in some]
            h = self.entropies(own)
            best = h.argmin(axis=1)
            low = h[np.arange(len(own)), best]
            p = 1 / (1 + np.exp(-np.clip(self.slope * self._lead(h, np.array([len(t) for t in own])) + self.shift, -30, 30)))
            for i, b in zip(some, best.tolist(), strict=True):
                langs[i] = self.langs[b]
            score[some], entropy[some] = p, low
            rejected[some] = (low > self.limits[best]) | (p < 0.5)
        return langs, score, entropy, rejected


def held_out() -> F.Column:
    """Rows that are never learned from: crc32 of the id as text has remainder 2 by four."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, chars: int = SAMPLE_CHARS) -> Identifier:
    """Fit on about ``chars`` characters a language of ``docs`` (``doc_id``, ``text``, ``lang``) outside the held-out fold."""
    usable = docs.where("lang is not null and text is not null").where(~held_out()).where(F.length("text") > 0)
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.length("text") - LONGEST, F.lit(0)) + 1)
    usable = usable.withColumn("text", F.when(F.length("text") > LONGEST, F.substr("text", start.cast("int"), F.lit(LONGEST))).otherwise(F.col("text")))
    totals = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    if not totals:
        return Identifier([], [])
    rate = F.create_map(*[x for lang, n in sorted(totals.items()) for x in (F.lit(lang), F.lit(int(min(1.0, chars / n) * (1 << 30))))])
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) < F.element_at(rate, F.col("lang")))
    held = sorted((r["lang"], r["text"]) for r in chosen.select("lang", "text").toLocalIterator())
    return Identifier([t for _, t in held], [x for x, _ in held])


def identify(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """``docs`` (any columns; ``text``) with ``lang_pred``, ``lang_score``, ``cross_entropy`` and ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0, rejected. If no language was
    learned every text is ``und``. Ties go to the language first in order.
    """
    more = "lang_pred string, lang_score double, cross_entropy double, rejected boolean"
    base = without(docs, "lang_pred", "lang_score", "cross_entropy", "rejected")
    model = docs.sparkSession.sparkContext.broadcast(identifier)

    def make():
        own = model.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, score, entropy, rejected = own.predict(batch.column("text").to_pylist())
            arrays = [pa.array(langs), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)]
            return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "lang_pred", "lang_score", "cross_entropy", "rejected"])

        return f

    return map_texts(base, make, schema_of(base, more))


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "cross_entropy", "rejected")
