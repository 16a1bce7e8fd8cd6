"""Quality by weak supervision: rules vote or abstain, and EM weighs them.

Every rule looks at a few statistics of a text and votes good (+1), bad (-1) or abstains (0).
Rules overlap, and each is wrong at times. The true class is unknown; expectation-maximisation
(Dawid and Skene, 1979) estimates from all votes how often each rule, when it votes, votes
against good and against bad texts, and what share is good. An abstention says nothing. A text
is kept if its posterior probability of being good is one half or more, so a text that a rule
fails stays if the votes of others, weighed by their accuracy, outweigh it.

What is believed of rules beforehand (``BELIEVED``) is worth ``WORTH`` of all documents, which
keeps the names of the two classes in place and the estimates finite, and settles little else.
Votes travel as counts of vote patterns, of which there are at most 3 ^ rules, whatever the
number of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, mix, read, schema_of, unused, utf8, without
from .substring import name_words, word_line

#: Believed shares of votes against bad and good texts, and of good texts; documents that beliefs are worth: at least, and as a share of all.
BELIEVED, BELIEVED_GOOD, LEAST_WORTH, WORTH = (0.3, 0.02), 0.8, 4, 0.002
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_exclaim long, n_ends long, n_letters long, n_letter_words long"


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The statistics of UTF-8 texts, column by column."""
    n = len(texts)
    out = {name.split()[0]: np.zeros(n, dtype=np.int64) for name in STATS.split(", ")}
    lines = [word_line(t) for t in texts]
    sizes = out["n_words"][:] = np.array([x.count(b" ") + 1 if x else 0 for x in lines], dtype=np.int64)
    upper = bytes(range(65, 91))
    # all beyond ASCII counts as letters
    other = bytes(b for b in range(128) if not chr(b).isalpha() and b not in SPACES)
    inner = bytes(range(128, 192))
    for i, t in enumerate(texts):
        size = len(t)
        points = size if t.isascii() else len(t.decode("utf-8", "replace"))
        out["word_chars"][i] = points - (size - len(t.translate(None, SPACES)))
        out["n_symbols"][i] = size - len(t.translate(None, SYMBOLS))
        out["n_upper"][i] = size - len(t.translate(None, upper))
        out["n_exclaim"][i] = t.count(b"!")
        letters = t.translate(None, other)
        out["n_letter_words"][i] = len(letters.split())
        out["n_letters"][i] = len(letters.translate(None, SPACES + inner))
        out["n_ends"][i] = t.count(b".") + t.count(b"?") + t.count(b"!")
        if b"\n" in t:
            own = [x for x in t.split(b"\n") if x.strip(SPACES)]
            out["n_dup_lines"][i] = len(own) - len(set(own))
    names = name_words(lines)
    doc = np.repeat(np.arange(n), sizes)
    if len(names) > 2:
        whole = np.flatnonzero(doc[2:] == doc[:-2])
        grams = mix(mix(mix(names[:-2], names[1:-1]), names[2:]), doc[2:].astype(np.uint64))[whole]
        _, place, count = np.unique(grams, return_inverse=True, return_counts=True)
        again = whole[count[place] > 1]
        hit = np.zeros(len(names), dtype=bool)
        for k in range(3):
            hit[again + k] = True
        out["n_repeat_words"] = np.bincount(doc[hit], minlength=n).astype(np.int64)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns; ``text``) with its text replaced by the statistics; null counts as empty."""
    base = without(docs, *[x.split()[0] for x in STATS.split(", ")])

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = measure(utf8(batch.column("text")))
            names = [c for c in batch.schema.names if c != "text"]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, found.values())], names=[*names, *found])

        return f

    return map_texts(base, make, schema_of(base.drop("text"), STATS))


def _between(value: F.Column, good_low: float, good_high: float, bad_low: float, bad_high: float) -> F.Column:
    """+1 inside the good range, -1 outside the bad one, else 0; null abstains."""
    vote = F.when(value.between(good_low, good_high), 1).when((value < bad_low) | (value > bad_high), -1).otherwise(0)
    return F.coalesce(vote, F.lit(0))


def rules() -> dict[str, F.Column]:
    """The rules' votes as columns over the statistics. What a short text can't tell, rules abstain from."""
    share = lambda c: F.try_divide(F.col(c), F.col("n_words"))
    of_chars = lambda c: F.try_divide(F.col(c), F.col("word_chars"))
    ends = F.when(F.col("n_words") >= 20, share("n_ends"))
    return {
        "symbols": _between(share("n_symbols"), 0, 0.02, 0, 0.05),
        "letters": _between(of_chars("n_letters"), 0.93, 1, 0.9, 1),
        "letter_words": _between(share("n_letter_words"), 0.97, 1, 0.9, 1),
        "word_length": _between(share("word_chars"), 4.5, 6, 4, 7),
        "lines": _between(share("n_dup_lines"), 0, 0.002, 0, 0.005),
        "repeats": _between(share("n_repeat_words"), 0, 0.05, 0, 0.1),
        "capitals": _between(of_chars("n_upper"), 0.005, 0.04, 0.002, 0.1),
        "shouting": _between(share("n_exclaim"), 0, 0.01, 0, 0.03),
        "sentences": _between(ends, 0.05, 0.15, 0.03, 0.2),
    }


class Voters:
    """What EM has found: each rule's share of votes against bad and good texts, and the posterior of each pattern."""

    def __init__(self, patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 500):
        self.patterns, n_rules = patterns, len(patterns[0]) if patterns else 0
        votes = np.array(patterns, dtype=np.int64).reshape(len(patterns), n_rules)
        against, voted = votes == -1, votes != 0
        # the start is the majority of votes
        good = (1 + (votes == 1).sum(axis=1)) / (2 + voted.sum(axis=1))
        self.prior, self.rates = BELIEVED_GOOD, np.repeat(np.array(BELIEVED)[:, None], n_rules, axis=1)
        worth = LEAST_WORTH + WORTH * counts.sum()
        for _ in range(rounds):
            weight = np.stack((counts * (1 - good), counts * good))
            self.prior = float((weight[1].sum() + worth * BELIEVED_GOOD) / (weight.sum() + worth))
            self.rates = (weight @ against + worth * np.array(BELIEVED)[:, None]) / (weight @ voted + worth)
            bad_log, good_log = (np.stack((np.log(r), np.log(1 - r))) for r in self.rates)
            odds = np.log(self.prior / (1 - self.prior)) + against @ (good_log - bad_log)[0] + (votes == 1) @ (good_log - bad_log)[1]
            new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            still = np.abs(new - good).max(initial=0) < 1e-9
            good = new
            if still:
                break
        self.posterior = good

    def accuracy(self) -> np.ndarray:
        """Each rule's chance of a right vote, given that it votes."""
        bad, good = self.rates
        return (1 - self.prior) * bad + self.prior * (1 - good)


def judge(stats: DataFrame) -> tuple[DataFrame, Voters]:
    """Statistics with ``quality``, the posterior of being good, and the voters.

    ``stats`` is read twice: cut it first. Documents with equal votes have equal posteriors; an
    empty table has no voters. A text without words has no votes and the posterior of none.
    Runs a job when called.
    """
    stats = without(stats, "quality")
    (code,) = unused(stats, "votes")
    votes = list(rules().values())
    voted = stats.withColumn(code, sum(((v.cast("int") + 1) * 3**k for k, v in enumerate(votes)), F.lit(0)))
    found = sorted((r[code], r["count"]) for r in voted.groupBy(code).count().collect())
    patterns = [tuple(c // 3**k % 3 - 1 for k in range(len(votes))) for c, _ in found]
    voters = Voters(patterns, np.array([c for _, c in found], dtype=np.float64))
    # at most 3 ^ rules rows
    known = stats.sparkSession.createDataFrame([(c, float(q)) for (c, _), q in zip(found, voters.posterior, strict=True)], f"{code} int, quality double")
    return voted.join(F.broadcast(known), code, "left").drop(code), voters


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    stats = cut(statistics(read(spark, sf_dir, "documents").select("doc_id", "text")))
    judged, _ = judge(stats)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality",
    )
