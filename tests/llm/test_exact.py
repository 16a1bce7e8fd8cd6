"""Decontamination, packing, sharding, token counts and WARC against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, packing, sharding, tokencount, warc

from .cases import SCHEMA, documents, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def folded(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(texts, items, window=13):
    phrases = defaultdict(set)
    for key, text in items:
        w = folded(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            phrases[tuple(w[i : i + n])].add("" if key is None else str(key))
    out = []
    for text in texts:
        w, found = folded(text), set()
        hit = [False] * len(w)
        for p, keys in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit[i : i + len(p)] = [True] * len(p)
                    found |= keys
        out.append((len(w), sum(hit), tuple(sorted(found))))
    return out


def contamination_case():
    rows = documents()
    rng = random.Random(9)
    some = folded(rows[0][1])
    items = [(1, " ".join(some[5:40])), (2, "W1, w2"), (3, ""), (4, None), (5, prose(rng, 30)), (6, "a"), (7, " ".join(some[5:40])), (10, "É! xyz"), (11, "W1 W2"), (None, " ".join(some[50:80]))]
    rows.append((70, "É! xyz -- w1; W2 w1 w2", "en", "s", 0))
    return rows, items


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "ITEMS_BYTES", limit)  # one pass, and several
    rows, items = contamination_case()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("hit_items", F.lit("clash"))
    got = decontaminate.judged(decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"))).collect()
    want = Counter((r[0], *b) for r, b in zip(rows, brute_hits([r[1] for r in rows], items), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.hit_items)) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {len(r.hit_items) for r in decontaminate.find_contamination(docs, none).collect()} == {0}
    assert decontaminate.find_contamination(docs.where("false"), none).count() == 0


def test_fm_index_against_brute_force():
    rng = np.random.default_rng(2)
    for plain in (1, 2, 5):
        seq = rng.integers(0, plain, 500)
        odd = rng.random(500) < 0.1
        odd[-1] = True  # a document ends with a symbol of its own
        seq[odd] = plain + np.arange(odd.sum())
        order = decontaminate.suffix_order(seq, plain)
        suffixes = [tuple(seq[i:].tolist()) for i in range(500)]
        assert order.tolist() == sorted(range(500), key=suffixes.__getitem__)
        index = decontaminate.FmIndex(seq, plain)
        for size in (1, 3):
            phrases = rng.integers(0, plain, (20, size))
            low, high = index.find(phrases)
            for p, a, b in zip(phrases, low, high, strict=True):
                want = [i for i in range(500 - size + 1) if (seq[i : i + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def contract_ids(texts):
    """The contract's own call."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return [np.array(x.ids, dtype="<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_matches_tokenizers(spark, data):
    encode = packing.Encoder(packing.default_tokenizer())
    texts = [r[1] or "" for r in documents()] + [r.text or "" for r in spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").collect()]
    texts += ["  a\n\n b\t c ", "don't  I'LL 12a٣ ½", "日本語 テキスト 🙂🙂", "<|endoftext|> x", "\x1c\x85 a", "a\r\n\r\nb", "'s's 'S"]
    texts += [" " * 2_000_000 + "x", "ab" * 1_000_000, "a" + "\n \t" * 400_000, "<|endoftext|>" + " " * 30_000]
    for text, want in zip(texts, contract_ids(texts), strict=True):
        assert encode(text) == want


def test_special_token_is_read_as_by_default(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|", "", "plain  text\n", " " * 1_000_000]
    want = {i: (zlib.crc32(x + bytes(4)), len(x) // 4 + 1) for i, x in enumerate(contract_ids(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.token_pieces(docs, capacity=1 << 30, with_ids=True).collect()
    assert {r.doc_id: (zlib.crc32(r.ids), r.length) for r in got} == want


def test_packing(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("offset", F.lit("clash"))
    want = Counter()
    for (key, *_), ids in zip(rows, contract_ids([r[1] or "" for r in rows]), strict=True):
        ids += bytes(4)
        n = len(ids) // 4
        first = n if n <= 64 else n % 64 or 64
        at = piece = 0
        while at < n:
            size = 64 if piece else first
            want[(key, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]))] += 1
            at, piece = at + size, piece + 1
    got = packing.pack_documents(docs, capacity=64).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(held) <= -(-sum(k[3] * n for k, n in want.items()) // 64) + 2
    assert packing.pack_documents(docs.where("false")).count() == 0
    with_ids = packing.token_pieces(docs, capacity=64, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in with_ids)


def test_packer_closes_the_fullest():
    packer = packing.Packer(10, most=2)
    assert packer.put(6) == (0, 0) and packer.put(7) == (1, 0)
    assert packer.put(8) == (2, 0)  # bin 1 was the fullest and closed
    assert packer.put(3) == (0, 6) and packer.put(2) == (2, 8)


def test_packing_closes_bins_and_fills_them(spark, monkeypatch):
    closed, take = [], packing.Packer._take
    rng = random.Random(4)
    sizes = [min(2048, int(rng.lognormvariate(6.5, 0.9)) + 1) for _ in range(30_000)]
    order = packing.Packer(2048)
    monkeypatch.setattr(packing.Packer, "_take", lambda self, space: closed.append(self.open) or take(self, space))
    for a in range(0, len(sizes), packing.BUFFER):
        for size in sorted(sizes[a : a + packing.BUFFER], reverse=True):
            fits = bool(order.free >> size)
            before = len(closed)
            order.put(size)
            closed[before:] = [] if fits else closed[before:]
    assert closed and max(closed) == packing.OPEN_BINS  # as many as a packer has by default are closed while full
    rows = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long").withColumn("group", F.lit("kept")).withColumn("arrival", F.lit(1))
    got = packing.pack(rows, group=12_000).collect()
    assert Counter(r.length for r in got) == Counter(sizes) and {r.group for r in got} == {"kept"}
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= 1.005 * -(-sum(sizes) // 2048)


def check_shards(rows, got, shards):
    total = sum(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    largest = max((r["size"] for r in got), default=0)
    for k in range(shards):
        assert abs(sum(r["size"] for r in by[k]) - total / shards) <= 2 * largest
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)


def test_shards(spark):
    rows = documents() + [(1000 + i, "the same text", "en", "s", 0) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("clash"))
    check_shards(rows, [r.asDict() for r in sharding.balanced_shards(docs, 3).collect()], 3)
    assert sharding.balanced_shards(docs.where("false")).count() == 0
    few = rows[:2]
    assert sharding.balanced_shards(spark.createDataFrame(few, SCHEMA), 24).count() == 2
    null_ids = [(None, f"t{i}", "en", "s", 0) for i in range(50)]
    check_shards(null_ids, [r.asDict() for r in sharding.balanced_shards(spark.createDataFrame(null_ids, SCHEMA), 4).collect()], 4)


def test_shards_in_parts_of_rows_with_any_id(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_ROWS", 20)
    rows = [(f"id{i}", "" if i % 2 else "long text " * (i % 40), "s", 1) for i in range(400)] + [(None, "x", "s", 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id string, text string, hash string, part int").withColumn("_id", F.lit(7)).withColumn("start", F.lit("kept"))
    got = [r.asDict() for r in sharding.balanced_shards(docs, 3).collect()]
    check_shards(rows, got, 3)
    assert {(r["hash"], r["_id"], r["start"]) for r in got} == {("s", 7, "kept")}


def test_shards_are_exact(spark, data, monkeypatch):
    monkeypatch.setattr(sharding, "FETCHED", 4)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + [(5000 + i, "copy") for i in range(300)]
    order = sorted(rows, key=lambda r: (int(hashlib.md5(r[1].encode()).hexdigest()[:15], 16), r[0]))
    total, below, want = sum(len(r[1].encode()) + 8 for r in rows), 0, {}
    for key, text in order:
        want[key] = 24 * below // total
        below += len(text.encode()) + 8
    got = {r.doc_id: r.shard for r in sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()}
    assert got == want


def brute_pieces(word, entries, continuation=b""):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if (continuation if i else b"") + word[i:j] in entries), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


def test_longest_match():
    rng = random.Random(1)
    for _ in range(200):
        entries = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        machine = tokencount.LongestMatch(sorted(entries))
        for _ in range(40):
            word = bytes(rng.choices(b"abc", k=rng.randint(0, 10)))
            assert machine.count(word) == brute_pieces(word, entries)


def test_longest_match_with_continuation_marks():
    rng = random.Random(6)
    for _ in range(200):
        entries = {rng.choice([b"", b"##"]) + bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 16))}
        machine = tokencount.LongestMatch(sorted(entries), b"##")
        for _ in range(40):
            word = bytes(rng.choices(b"abc", k=rng.randint(0, 10)))
            assert machine.count(word) == brute_pieces(word, entries, b"##")


def test_token_counts(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_tokens", F.lit("clash"))
    entries = set(tokencount.load_vocabulary(tokencount.default_vocabulary()))
    short = [r for r in rows if len(r[1] or "") < 20_000]
    got = Counter((r.doc_id, r.n_words, r.n_tokens) for r in tokencount.token_counts(docs).collect() if r.doc_id not in (42, 43))
    want = Counter((k, len((t or "").encode().split()), sum(brute_pieces(b" " + w, entries) for w in (t or "").encode().split())) for k, t, *_ in short if k not in (42, 43))
    assert got == want
    assert tokencount.token_counts(docs.where("false")).count() == 0


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 7)
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 15)
    pages = [(i, f"https://www.a{i % 3}.example.org/p/{i % 5}?q=1#x", f"<p>é {i % 4}</p>\r\n\r\n" if i % 2 else f"page {i}") for i in range(40)]
    pages += [(100, "http://e.org/", None), (101, "no url", ""), (102, None, "\r\n\r\n"), (50, "http://e.org/", "twice"), (50, "http://e.org/", "twice"), (51, "http://x\r\ny/", "twice"), (None, "http://n.org", "null id")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = warc.write_archives(warc.capture_records(df), str(tmp_path))
    captures = warc.read_archives(spark, path)
    index = warc.merged_index(captures).orderBy("capture_no").collect()
    holder = {}
    for k, _, html in pages:
        holder[html or ""] = max(holder.get(html or "", -1), -1 if k is None else k)
    import base64

    def row(k, html):
        html = html or ""
        own = k is None or k == holder[html]
        return (k, len(html.encode()), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode(), "response" if own else "revisit", None if own else holder[html])

    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index) == Counter(row(k, h) for k, _, h in pages)
    assert [r.capture_no for r in index] == list(range(len(pages)))
    keys = [(r.url_key, r.capture_time, -1 if r.page_id is None else r.page_id) for r in index]
    assert keys == sorted(keys)
    empty = warc.write_archives(warc.capture_records(df.where("false")), str(tmp_path))
    assert warc.merged_index(warc.read_archives(spark, empty)).count() == 0


def test_warc_large_ids_keep_the_oracles_order(spark, tmp_path):
    import duckdb

    big = [1 << 62, (1 << 62) + 1, -(1 << 62), -1, 250_000_000_000, 1 << 31, (1 << 31) - 1, 0, 1, 2]
    pages = [(k, f"http://a.org/{i % 2}", f"page {k}" if i % 3 else "common") for i, k in enumerate(big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    duckdb.sql(f"create or replace view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_no"]
    got = sorted(tuple(r[c] for c in names) for r in warc.op6_query(spark, str(tmp_path)).collect())
    assert got == sorted(duckdb.sql(f"select {', '.join(names)} from ({warc.OP6_SQL})").fetchall())


def test_warc_merges_many_runs_in_passes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 3)
    monkeypatch.setattr(warc, "CLASSES", (40, 200))
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 3)
    monkeypatch.setattr(warc, "FAN_IN", 4)
    rng = random.Random(8)
    pages = [(i, f"http://h{rng.randrange(5)}.org/{rng.randrange(9)}", "x" * rng.choice([1, 60, 900]) + str(i % 550)) for i in range(620)]
    path = warc.write_archives(warc.capture_records(spark.createDataFrame(pages, "page_id long, url string, html string")), str(tmp_path))
    archives = [f for f in __import__("pathlib").Path(path).rglob("*.gz")]
    assert len(archives) >= 200
    captures = warc.read_archives(spark, path).repartition(70)
    got = warc.merged_index(captures).collect()
    want = sorted((warc.url_key(u), k) for k, u, _ in pages)
    assert [(r.url_key, r.page_id) for r in sorted(got, key=lambda r: r.capture_no)] == want
    assert [r.capture_no for r in sorted(got, key=lambda r: r.capture_no)] == list(range(620))


def test_loser_tree():
    rng = random.Random(3)
    for k in range(0, 9):
        runs = [sorted(rng.choices(range(30), k=rng.randrange(0, 12))) for _ in range(k)]
        assert [runs[a][i] for a, i in warc.LoserTree(runs)] == sorted(x for r in runs for x in r)


def test_decontamination_of_equal_items():
    """Equal windows are located once, whatever the number of their items and occurrences; sets of items are shared."""
    import time
    import tracemalloc

    heading = " ".join(f"w{i}" for i in range(13)).encode()
    phrases = decontaminate.Phrases([(i, heading) for i in range(100_000)] + [("x", b"other words " + heading)], 13)
    texts = [(heading + b" zz ") * 100] * 100 + [b"other words " + heading, b"w0 w1"]
    tracemalloc.start()
    begun = time.time()
    found = phrases.scan(texts)
    assert time.time() - begun < 30 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert all(n == 1400 and len(spans) == 100 and len(items) == 100_001 for n, spans, items in found[:100])
    assert found[100][1] == [(0, 15)] and len(found[100][2]) == 100_001 and found[101][1] == []
