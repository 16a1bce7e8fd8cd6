"""The pipeline against a brute-force version, on awkward rows and on the smallest tables."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import packing, toxicity

from .cases import SCHEMA, documents
from .test_dedup import brute_fingerprint, brute_repeats
from .test_exact import brute_hits, contamination_case


def brute(rows, machine, items):
    """doc_id and token lengths of pieces that should come out, as a multiset."""
    rows = [r for r in rows if machine.score(toxicity.terms((r[1] or "").encode())) < 0.5]
    fps = [brute_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in range(3):
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    members = defaultdict(list)
    for i, g in enumerate(group):
        members[g].append(i)
    rows = [rows[min(own, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))] for own in members.values()]
    repeats = brute_repeats([r[1] for r in rows], 35)
    texts = [kept if gone else r[1] for r, (_, gone, kept) in zip(rows, repeats, strict=True)]
    hits = brute_hits(texts, items)
    encode = packing.Encoder(packing.default_tokenizer())
    out = Counter()
    for r, text, (n, hit, _) in zip(rows, texts, hits, strict=True):
        if not (hit > 0 and 20 * hit >= n):
            size = len(encode(text or "")) // 4 + 1
            out[(r[0], size)] += 1
    return out


def pieces_of(df):
    sizes = Counter()
    for r in df.collect():
        sizes[r.doc_id] += r.length
    return sizes


def test_awkward_rows(spark, tmp_path):
    rows, items = contamination_case()
    rows += [(80 + i, "you stupid trash go away now " + str(i), "en", "s", 0) for i in range(12)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(80 <= (r[0] or 0) < 92)) for r in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    machine = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    want = brute(rows, machine, items)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert pieces_of(got) == Counter({k: n for k, n in want})
    assert not any(80 <= (r.doc_id or 0) < 92 for r in got.collect())


def test_smallest_tables(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    machine = toxicity.train(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    want = brute(rows, machine, items)
    assert pieces_of(corpus_pipeline.run(spark, data)) == Counter({k: n for k, n in want})


def test_stages_on_nothing(spark, data):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, data)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == none.columns


def test_stages_keep_columns(spark, data, tmp_path):
    """Columns named as an operator's outputs come through every stage with their own values."""
    names = ["score", "n_words", "n_removed", "kept_text", "hit_spans", "hit_items", "n_hit", "contaminated", "own_score"]
    docs = spark.createDataFrame(documents(), SCHEMA).withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for n in names), name
