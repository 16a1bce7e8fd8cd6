"""Ranked search, packed token files and whitening against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import lexical, tokenfiles, whitening
from panelwright.llm.common import fresh, shared_dir

from .cases import SCHEMA, documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute_search(docs, items, k):
    """(item, rank, doc_id, score) from the definition; docs and items are (id, text) rows."""
    own = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in own), sum(sum(c.values()) for c in own)
    df = Counter(t for c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c in zip(docs, own, strict=True):
            score, n = 0, sum(c.values())
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(found)[:k])]
    return out


def ranked(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit("clash"), "score": F.lit("x"), "rank": F.lit(1)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.ranked_search(d.repartition(5), i, k).collect()), key=str)


def test_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(r[0], r[1]) for r in documents()] + [(100 + i, " ".join(rng.choices(["W1", "w2!", "w3", "é_ß", "x9-y"], k=rng.randrange(1, 9)))) for i in range(200)]
    items = [(1, "w1 w2 w1, W3"), (2, None), (3, "?!"), (4, "é ß x9 nowhere"), (5, "w1"), (5, "w1"), (None, "a b w17 w18")]
    want = sorted(brute_search(docs, items, 20), key=str)
    assert ranked(spark, docs, items, 20) == want
    # stretches of a document or two, blocks of an item, several digits and split texts give the same
    monkeypatch.setattr(lexical, "ITEMS_BYTES", 8)
    assert ranked(spark, docs, items, 20) == want
    assert ranked(spark, docs, [(1, "zzz")], 20) == [] and ranked(spark, [], items, 3) == [] and ranked(spark, docs, [], 3) == []


def test_search_stretches(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(60))).encode() for _ in range(90)]
    items = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(12)).encode()) for i in range(50)]
    own = lexical.Queries(items)
    own.weigh({lexical._DOCUMENTS: 90, lexical._TERMS: 2600} | {t: 30 for t in range(40)})
    whole = sorted((int(i), int(d), int(s)) for a in lexical.scores(own, texts) for i, d, s in zip(*a, strict=True))
    for entries in (1, 40, 1000):
        monkeypatch.setattr(lexical, "ENTRIES", entries)
        assert sorted((int(i), int(d), int(s)) for a in lexical.scores(own, texts) for i, d, s in zip(*a, strict=True)) == whole
    keys = np.array([rng.randrange(1 << 40) for _ in range(500)])
    assert (keys[lexical.radix_order(keys, 1 << 40)] == np.sort(keys)).all()
    text = " ".join(["alpha", "é" * 9, "b" * 50, "c\nd"] * 30).encode()
    monkeypatch.setattr(lexical, "SPLIT_BYTES", 37)
    assert [w for part in lexical.split(text) for w in part] == lexical.words_of(text)


def test_search_splits_are_whole_words():
    text = b"x" * 100 + b" " + b"y z" * 40
    assert [w for part in lexical.split(text) for w in part] == text.split()


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 24, 31, 32])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        data = tokenfiles.pack_bits(ids, bits)
        assert len(data) == -(-n * bits // 8) and (tokenfiles.unpack_bits(data, bits, n) == ids).all()
        whole = sum(int(v) << (bits * i) for i, v in enumerate(ids))  # the lowest bit first, without gaps
        assert int.from_bytes(data, "little") == whole
    with pytest.raises(ValueError):
        tokenfiles.pack_bits(np.array([1 << bits], dtype=np.uint64), bits) if bits < 32 else tokenfiles.pack_bits(np.array([1 << 32], dtype=np.uint64), 32)
    assert tokenfiles.width_of(49408) == 16 and tokenfiles.width_of(65537) == 17 and tokenfiles.width_of(1) == 1


def test_word_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenfiles.default_tokenizer())
    own = tokenfiles.WordEncoder(tokenfiles.default_tokenizer())
    rng = random.Random(8)
    odd = ["", " ", "It's  WE'LL 's\t'S", "a <|endoftext|> b<|startoftext|>c", "é ́e  ̣́ ̣́x", "ΑΣ ΑΣ. σς", "日本語 テキスト　x", "a b c\x1cd\x85e", "½ ²③ 1234", "가 ᅡ", "🙂🙃 x" * 9, "x" * 5000, "İI ı", "ﬁ ﬁ Ǆ"]
    pool = list("aZ '’ßẹ́́ \n\t.1<|>") + ["<|endoftext|>", "'ll", "Σ"]
    odd += ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(400)]
    want = [e.ids for e in whole.encode_batch(odd, add_special_tokens=False)]
    odd += ["Ünïçödé-Straße's ÀÉ×÷ñ'LL", "<|", "a<|b", "x" * 100 + " " + "É" * 70, "don't'd'x 's", "\x01\x1f\x7f a"]
    want = [e.ids for e in whole.encode_batch(odd, add_special_tokens=False)]
    for _ in range(2):  # from the tokenizer, then from memory
        assert [np.frombuffer(b, dtype="<u4").tolist() for b in own([t.encode() for t in odd])] == want


def test_token_files_against_brute_force(spark, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenfiles.default_tokenizer())
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"ids": F.lit("clash"), "start": F.lit("x")}).repartition(3)
    monkeypatch.setattr(tokenfiles, "BATCH_IDS", 500)
    path = tokenfiles.write_token_files(docs, f"{shared_dir(spark)}/{fresh('tokens')}")
    got = tokenfiles.read_token_files(spark, path).collect()
    held = sorted((r.start, r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in got)
    binary = tokenfiles.read_token_files(spark, path, binary=True).select("start", F.crc32("ids")).collect()
    assert sorted(map(tuple, binary)) == [(h[0], h[3]) for h in held]
    ids = {}
    for r in rows:
        own = whole.encode(r[1] or "", add_special_tokens=False).ids + [2]
        ids.setdefault(r[0], []).append((len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
    at = 0
    for start, doc, n, crc in held:
        assert start == at and (n, crc) in ids[doc]
        ids[doc].remove((n, crc))
        at += n
    assert not any(ids.values()) and [h[1] or -1 for h in held] == sorted(h[1] or -1 for h in held)
    # arrays of ids, of any number of bits
    again = f"{shared_dir(spark)}/{fresh('tokens')}"
    tokenfiles.read_token_files(spark, path).withColumn("ids", F.when(F.col("doc_id") != 20, F.col("ids"))).coalesce(1).sortWithinPartitions("start").select("doc_id", "ids").write.format("packed_ids").option("bits", "17").mode("append").save(again)
    back = tokenfiles.read_token_files(spark, again).collect()
    assert tokenfiles.manifest(again)["bits"] == 17 and sorted(str((r.doc_id, r.ids)) for r in back) == sorted(str((r.doc_id, [] if r.doc_id in (20, None) else r.ids)) for r in got)
    # a folder is written once
    with pytest.raises(Exception, match="holds token files"):
        tokenfiles.write_token_files(docs, path)
    empty = tokenfiles.write_token_files(docs.where("false"), f"{shared_dir(spark)}/{fresh('tokens')}")
    assert tokenfiles.read_token_files(spark, empty).count() == 0


def test_packed_file_random_access(tmp_path):
    rng = np.random.default_rng(1)
    sizes = [0, 5, 20_000, 1, 8192, 3]
    docs = [rng.integers(0, 100_000, n).astype(np.uint32) for n in sizes]
    fs, folder = tokenfiles._folder(str(tmp_path))
    out = tokenfiles._File(fs, f"{folder}/x.ids", 17, pa.string())
    out.add(pa.array(["a", "b", None]), np.array(sizes[:3]), np.concatenate(docs[:3]))
    out.add(pa.array(["d", "e", "f"]), np.array(sizes[3:]), np.concatenate(docs[3:]))
    out.close()
    held = tokenfiles.PackedFile(fs, f"{folder}/x.ids")
    all_ids = np.concatenate(docs)
    assert held.docs.column("doc_id").to_pylist() == ["a", "b", None, "d", "e", "f"]
    for k, own in enumerate(docs):
        assert (held.document(k) == own).all()
    for a, b in ((0, 0), (0, 1), (8191, 8193), (16384, 16384), (20_004, 28_201), (7, len(all_ids))):
        assert (held.ids(a, b) == all_ids[a:b]).all()
    with pytest.raises(ValueError):
        (tmp_path / "y.ids").write_bytes(b"x" * 100)
        tokenfiles.PackedFile(fs, f"{folder}/y.ids")


def vectors(spark, rows, more=True):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({"x": F.lit("mine"), "whitened": F.lit("clash")}).repartition(3) if more else df


@pytest.mark.parametrize("tile", [1, 3, 32])
def test_whitening_against_numpy(spark, tile):
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(300, 7)) * np.array([3, 2, 1.5, 1, 0.7, 0.5, 0.1]) + 1).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(1000 + i, data[0].tolist()) for i in range(50)]
    rows += [(2000, None), (2001, [1.0] * 6 + [float("nan")]), (2002, [1.0] * 6 + [None]), (2003, [float("-inf")] + [0.0] * 6), (2004, [1.0]), (2005, []), (None, data[1].tolist())]
    out, fitted = whitening.whiten(vectors(spark, rows), components=4, tile=tile)
    got = out.collect()
    x = np.floor(256 * data.astype(np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert fitted.n == n and fitted.total == total.tolist() and fitted.identity_error < 1e-9
    assert np.allclose(fitted.values, values[:4], rtol=1e-10) and math.isclose(fitted.trace, values.sum(), rel_tol=1e-12)
    assert len(got) == 351 and all(r.x == "mine" for r in got)
    sign = np.sign((fitted.vectors * axes[:, :4]).sum(axis=0))
    for r in got:
        own = x[r.vec_id] if r.vec_id is not None and r.vec_id < 300 else x[1] if r.vec_id is None else x[0]
        assert r.deviation == int(((n * own - total) ** 2).sum())
        assert np.allclose(r.whitened, (own - total / n) @ axes[:, :4] * sign / np.sqrt(values[:4]), atol=1e-8)


def test_whitening_odd_cases(spark):
    empty, fitted = whitening.whiten(vectors(spark, []))
    assert empty.count() == 0 and len(fitted.values) == 0
    same, fitted = whitening.whiten(vectors(spark, [(i, [0.5, 0.25]) for i in range(9)]))
    assert [(r.deviation, r.whitened) for r in same.collect()] == [(0, [])] * 9
    line, fitted = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]))
    assert len(fitted.values) == 1 and {len(r.whitened) for r in line.collect()} == {1}
    huge, fitted = whitening.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 2.0])]))
    assert {r.vec_id: r.deviation for r in huge.collect()}[1] is None
    none, fitted = whitening.whiten(vectors(spark, [(1, []), (2, [])]))
    assert [r.whitened for r in none.collect()] == [[], []]
