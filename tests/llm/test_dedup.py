"""Substring dedup and SimHash near-duplicates against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from panelwright.llm import simhash, substring
from panelwright.llm.components import connected_components

from .cases import SCHEMA, documents, prose


def brute_repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def test_remove_repeats(spark, monkeypatch):
    for name, value in {"BLOCK_BYTES": 4000, "CHUNK_BYTES": 1000, "RANGE_BYTES": (4000, 2000), "PACKED_BYTES": 3000}.items():
        monkeypatch.setattr(substring, name, value)  # many blocks, chunks, ranges and packs
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("kept_text", F.lit("clash")).withColumn("blk", F.lit("kept")).withColumn("state", F.lit(3))
    out = substring.remove_repeats(docs).collect()
    assert {(r.blk, r.state) for r in out} == {("kept", 3)}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("text_blocks")]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out)
    want = Counter((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], 35), strict=True))
    assert got == want


def test_remove_repeats_small_windows(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abc", k=rng.randrange(0, 60))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window in (1, 2, 5, 9):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs, window).collect()}
        assert [got[i] for i in range(40)] == brute_repeats(texts, window)


def test_anchor_is_a_function_of_the_window():
    rng = np.random.default_rng(3)
    for size in (2, 3, 50):
        alphabet = rng.integers(0, 1 << 63, size=size, dtype=np.uint64)
        names = alphabet[rng.integers(0, size, 3000)]
        names[2000:2200] = names[100:300]
        first = np.zeros(3000, dtype=bool)
        first[[0, 700, 1500]] = True
        starts, who, own = substring.anchors(names, first, 12)
        by = defaultdict(set)
        places = defaultdict(list)
        for s, w, o in zip(starts.tolist(), who.tolist(), own.tolist(), strict=True):
            by[names[s : s + 12].tobytes()].add(w)
            places[names[s : s + 12].tobytes()].append(o)
        assert all(len(x) == 1 for x in by.values())
        assert all(len(set(x)) == len(x) for x in places.values())


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring.remove_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = Counter((r[0], fps[i], least[group[i]]) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(group))


def test_keep_one_tells_groups_apart_by_links(spark):
    rng = random.Random(8)
    text = lambda: [rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(400)]
    one, two, three = text(), text(), text()
    near = next(c for c in ([*three[:i], "zz", *three[i + 1 :]] for i in range(400)) if 0 < bin(brute_fingerprint(" ".join(c)) ^ brute_fingerprint(" ".join(three))).count("1") <= 4)
    rows = [(1, one), (1, two), (2, two), (None, three), (None, near)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    kept = Counter((r.doc_id, r.text.split() in (three, near) or r.text) for r in simhash.keep_one(docs).collect())
    assert kept == Counter([(1, " ".join(one)), (1, " ".join(two)), (None, True)])


def test_covering_masks_cover():
    masks = simhash.covering_masks(4)
    rng = random.Random(2)
    for _ in range(5000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


def test_forest_links_what_brute_force_links():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for _ in range(600)], dtype=np.uint64))

    def roots(n, pairs):
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [find(i) for i in range(n)]

    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    assert roots(len(fps), simhash._distance_forest(fps, 4, block=64)) == roots(len(fps), np.argwhere(near).tolist())


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7), (200, 150), (175, 150)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41) if i} | {100: 50, 200: 150, 175: 150} | ({0: 0} if 0 in got else {}) | ({50: 50} if 50 in got else {}) | ({150: 150} if 150 in got else {})


def test_queries(spark, data):
    one = substring.op1_query(spark, data)
    assert one.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    row = one.orderBy("doc_id").first()
    text = spark.read.parquet(f"{data}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    assert row.n_words == len(text.encode().split())
    if not row.n_removed:
        assert row.kept_sha256 == hashlib.sha256(b" ".join(text.encode().split())).hexdigest()


def test_names_of_words():
    rng = random.Random(2)
    words = ["".join(rng.choices("ab\x00é", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 600]))).encode() for _ in range(3000)] + [b"x" * 511, b"x" * 512, b"x" * 513]
    names = substring.name_words([b" ".join(words[:1000]), b"", b" ".join(words[1000:])])
    assert len(names) == len(words)
    assert len(set(zip(words, names.tolist(), strict=True))) == len(set(words)) == len(set(names.tolist()))
    assert len(substring.name_words([])) == len(substring.name_words([b""])) == 0


def test_rows_of_one_id_are_spread_over_blocks(spark, monkeypatch):
    """A third of all rows may share an id, or be one repeated row: blocks stay even."""
    sizes = []
    monkeypatch.setattr(substring, "BLOCK_BYTES", 2_000)
    real = substring.fresh
    monkeypatch.setattr(substring, "fresh", lambda prefix: sizes.append(real(prefix)) or sizes[-1])
    rng = random.Random(2)
    docs = spark.createDataFrame([(7, prose(rng, 40) if i % 2 else "same text") for i in range(600)], "doc_id long, text string")
    assert substring.remove_repeats(docs).count() == 600
    blocks = spark.read.parquet(f"{substring.shared_dir(spark)}/{sizes[0]}").groupBy("blk").count().collect()
    assert len(blocks) > 20 and max(r["count"] for r in blocks) < 40
