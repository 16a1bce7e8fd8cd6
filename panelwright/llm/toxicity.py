"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: folded words and their leading 4, 5 and 6 bytes (stems
that insults of compounding languages share). The score is the logistic of

    bias + sum of w[i] + sum over pairs of <v[i], v[j]>

so a pair such as an insult and a group mention weighs more, or less, than its parts
(Rendle, 2010). The pair sum costs one pass: half of (sum v)^2 - sum v^2.

The model is fitted on the driver, on a sample of labelled rows that is bounded by
``TRAIN_ROWS`` (an expectation: rows are chosen by hash of the id, so the choice is the same
at every scale) and on two kinds of terms: the ``MOST_TERMS`` that tell the classes apart best by
chi-square, and those that do so only together with another. For the latter every pair of the
``PAIR_TERMS`` commonest terms is tested for interaction in what a first fit leaves unexplained: its
mean over the rows with both, either and neither. The terms of pairs that stand out are added,
whatever each is worth alone, and the machine is fitted again.
Terms are counted and chosen in Spark; the driver gets the chosen ones of the sampled rows only.
All else, scoring above all, covers every row and whole texts. What is broadcast is the model,
whose size the terms bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, read, schema_of, utf8, without

#: Hash space; labelled rows to train on, about; least rows with a term; least chi-square of a term; most terms of a model; factors.
SPACE, TRAIN_ROWS, LEAST_ROWS, LEAST_CHI, MOST_TERMS, FACTORS = 1 << 20, 10_000, 4, 12.0, 65_536, 4
#: Commonest terms whose pairs are tested; least rows of each of a pair's four cells; least squared standard score of an interaction; least variance that it is measured against.
PAIR_TERMS, PAIR_ROWS, LEAST_PAIR, LEAST_SPREAD = 2048, 20, 45.0, 0.02
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> np.ndarray:
    """Distinct hashed terms of a text, in order."""
    words = set(text.translate(_FOLD).split())
    all_ = words.union(*({w[:n] + b"*" for w in words} for n in (4, 5, 6)))
    h = np.fromiter(map(zlib.crc32, all_), dtype=np.uint32, count=len(all_))
    return np.unique(h & np.uint32(SPACE - 1)).astype(np.int32)


class Machine:
    """Weights of a fitted factorization machine, laid out over the hash space."""

    def __init__(self, kept: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.kept, self.bias, self.w, self.v = kept, bias, w, v
        self.slot: np.ndarray | None = None

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        """Probability that a text with these terms is toxic, for every text."""
        if self.slot is None:
            self.slot = np.full(SPACE, -1, dtype=np.int32)
            self.slot[self.kept] = np.arange(len(self.kept))
        n = len(found)
        at = self.slot[np.concatenate(found)] if n else np.zeros(0, dtype=np.int32)
        row = np.repeat(np.arange(n), [len(x) for x in found])[at >= 0]
        at = at[at >= 0]
        total = lambda x: np.bincount(row, weights=x, minlength=n)
        v = self.v[at]
        pairs = sum((total(v[:, f]) ** 2 - total(v[:, f] ** 2) for f in range(FACTORS)), np.zeros(n))
        return 1 / (1 + np.exp(-np.clip(self.bias + total(self.w[at]) + 0.5 * pairs, -40, 40)))

    def score(self, found: np.ndarray) -> float:
        """``scores`` of one text."""
        return float(self.scores([found])[0])


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 30, seed: int = 11) -> Machine:
    """Fit by Adam on the log loss; classes weigh alike, and weights are shrunk.

    With one class only, or no rows, the machine answers with the share of toxic rows.
    """
    n, y = len(rows), labels.astype(np.float64)
    none = np.zeros(0, dtype=np.int32)
    if not n or y.min() == y.max():
        share = float(np.clip(y.mean() if n else 0.0, 1e-6, 1 - 1e-6))
        return Machine(none, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    all_ = np.concatenate(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    p = y.mean()
    kept = np.unique(all_).astype(np.int32)
    mine = np.searchsorted(kept, all_)
    starts = np.searchsorted(owner, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS)), float(np.log(p / (1 - p)))
    weight = np.where(y > 0, 0.5 / p, 0.5 / (1 - p))
    flat = np.concatenate((w, v.ravel(), [bias]))
    m, s, step, k = np.zeros_like(flat), np.zeros_like(flat), 0, len(kept)
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 256):
            own = order[a : a + 256]
            cols = np.concatenate([mine[starts[i] : starts[i + 1]] for i in own])
            row = np.repeat(np.arange(len(own)), starts[own + 1] - starts[own])
            w, v, bias = flat[:k], flat[k:-1].reshape(k, FACTORS), flat[-1]
            vs = np.zeros((len(own), FACTORS))
            np.add.at(vs, row, v[cols])
            z = bias + np.bincount(row, weights=w[cols], minlength=len(own)) + 0.5 * ((vs**2).sum(1) - np.bincount(row, weights=(v[cols] ** 2).sum(1), minlength=len(own)))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[own]) * weight[own] / len(own)
            grad = np.zeros_like(flat)
            grad[:k] = np.bincount(cols, weights=g[row], minlength=k)
            gv = g[row, None] * (vs[row] - v[cols])
            for f in range(FACTORS):
                grad[k:-1].reshape(k, FACTORS)[:, f] = np.bincount(cols, weights=gv[:, f], minlength=k)
            grad[-1] = g.sum()
            grad[:-1] += 1e-5 * flat[:-1]
            step += 1
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
            flat = flat - 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(kept, float(flat[-1]), flat[:k].copy(), flat[k:-1].reshape(k, FACTORS).copy())


def interacting(rows: list[np.ndarray], rest: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """The terms of ``pool`` (sorted) that have an interaction with another of them in ``rest``, what a fit has left unexplained.

    Of each pair the contrast of the means of the rows with both, with one, with the other and with neither is measured
    against its standard error; pairs with fewer than ``PAIR_ROWS`` rows in a cell tell nothing.
    """
    n = len(rows)
    if not len(pool) or not n:
        return pool[:0]
    x = np.zeros((n, len(pool)), dtype=np.float32)
    for i, own in enumerate(rows):
        at = np.searchsorted(pool, own)
        at[at == len(pool)] = 0
        x[i, at[pool[at] == own]] = 1
    rest = rest.astype(np.float32)
    spread = max(float((rest**2).mean()), LEAST_SPREAD)
    count, sums, found = x.sum(0), rest @ x, np.zeros(len(pool), dtype=bool)
    for a in range(0, len(pool), 256):
        own = slice(a, a + 256)
        both, sum_ = x[:, own].T @ x, (x[:, own] * rest[:, None]).T @ x
        cells = [(both, sum_), (count[own, None] - both, sums[own, None] - sum_), (count - both, sums - sum_)]
        cells.append((n - sum(c for c, _ in cells), rest.sum() - sum(s for _, s in cells)))
        enough = np.minimum.reduce([c for c, _ in cells]) >= PAIR_ROWS
        contrast, error = 0.0, 0.0
        for sign, (c, s) in zip((1, -1, -1, 1), cells, strict=True):
            c = np.maximum(c, 1)
            contrast, error = contrast + sign * s / c, error + 1 / c
        found[own] |= (enough & (contrast**2 >= LEAST_PAIR * spread * error)).any(axis=1)
    return pool[found]


def held_out() -> F.Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on about ``rows`` labelled documents outside the held-out fold.

    ``labels``: ``doc_id``, ``toxic``; null labels are left out. The labelled rows are counted,
    and those below a quantile of a hash of the id are taken. Runs jobs when called.
    """
    usable = labels.where("toxic is not null and doc_id is not null").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("_toxic"))
    n = usable.count()
    part = min(1.0, rows / max(n, 1))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))
    sample = docs.select("doc_id", "text").where(spread).join(usable.where(spread), "doc_id").select("_toxic", "text")

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array([terms(t) for t in utf8(batch.column("text"))], type=pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column("_toxic"), found], names=["toxic", "terms"])

        return f

    held = cut(map_texts(sample, make, "toxic int, terms array<int>"))
    size, toxic = held.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    counts = held.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    share = (toxic or 0) / max(size, 1)
    expect = F.col("n") * share
    chi = size * (F.col("hits") - expect) ** 2 / (expect * (1 - share) * F.greatest(size - F.col("n"), F.lit(1)))
    best = counts.where(F.col("n") >= LEAST_ROWS).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI) if 0 < share < 1 else counts.where("false").withColumn("chi", F.lit(0.0))
    kept = np.array(sorted(r["term"] for r in best.orderBy(F.desc("chi"), "term").limit(MOST_TERMS).collect()), dtype=np.int32)
    common = counts.where(F.col("n").between(PAIR_ROWS, size - PAIR_ROWS)).orderBy(F.desc("n"), "term").limit(PAIR_TERMS)
    pool = np.array(sorted(r["term"] for r in common.collect()), dtype=np.int32)
    either = np.union1d(kept, pool)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.intersect1d(x.values.to_numpy(), either, assume_unique=True) for x in batch.column("terms")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, type=pa.list_(pa.int32()))], names=["toxic", "terms"])

    # bounded by ``rows``, MOST_TERMS and PAIR_TERMS; sorted, so the fit does not hang on the order of arrival
    table = held.mapInArrow(chosen, "toxic int, terms array<int>").toArrow()
    y, lists = table.column("toxic").to_numpy(), table.column("terms").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    found = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    order = sorted(range(len(found)), key=lambda i: (len(found[i]), zlib.crc32(found[i]), int(y[i])))
    found, y = [found[i] for i in order], y[order] if len(order) else y
    own = [np.intersect1d(x, kept, assume_unique=True) for x in found]
    machine = fit(own, y)
    pairs = np.setdiff1d(interacting(found, y - machine.scores(own), pool), kept)
    return fit([np.intersect1d(x, np.union1d(kept, pairs), assume_unique=True) for x in found], y) if len(pairs) else machine


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` (any columns; ``text``) with ``score``, 0 to 1. Null and empty texts have the score of no terms."""
    base = without(docs, "score")
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        own = model.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = own.scores([terms(t) for t in utf8(batch.column("text"))])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, type=pa.float64())], names=[*batch.schema.names, "score"])

        return f

    return map_texts(base, make, schema_of(base, "score double"))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
