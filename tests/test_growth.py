"""Plans that must not grow faster than their input."""

from pyspark.sql import functions as F

from panelwright import catalog
from panelwright.functions import labels, nulls
from panelwright.operators import outline, placed, relational, spatial
from panelwright.plans import estimate, ingest, pages


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_yearbooks_join_nothing(spark, data):
    assert "Join" not in plan(catalog.QUERIES["q55_yearbooks"](spark, data))


def test_counts_in_polygons_of_equal_units(spark):
    rings = lambda x: [[(x, 0.0), (x + 4.0, 0.0), (x + 4.0, 4.0), (x, 4.0)], [(x + 1.0, 1.0), (x + 2.0, 1.0), (x + 2.0, 2.0), (x + 1.0, 2.0)]]
    units = spark.createDataFrame([(i, rings(float(i % 2))) for i in range(20)], "unit int, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(0.5, 0.5), (0.5, 0.5), (1.5, 1.5), (2.5, 2.5), (4.5, 0.5), (9.0, 9.0)], "x double, y double")
    met = spatial.points_in_polygons(points, units, "unit", "rings", 1.0).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    got = spatial.counts_in_polygons(points, units, "unit", "rings", 1.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, met.collect())) == [(i, 3) for i in range(20)]


def test_sums_of_many_terms(spark):
    assert spark.range(1).select(estimate._total([F.lit(1.0)] * 5000)).first()[0] == 5000.0


def test_percentiles_gather_no_column(spark, data):
    assert "percentile" not in plan(catalog.QUERIES["q18_describe"](spark, data))
    for values in ([1.0, 2.0, 4.0, 4.0, None], [3.0] * 7, [float(i * i % 997) for i in range(5000)], [5.0], [None]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        want = df.agg(*[F.percentile("x", F.lit(p)) for p in (0.25, 0.5, 0.75)]).first()
        assert estimate.order_statistics(df, "x", (0.25, 0.5, 0.75)) == list(want)


def test_compact_tables_are_dealt_before_pages_are_parsed(spark, data):
    for name in ("q29_html_grid", "q59_named_columns", "q43_religion_tables"):
        assert "hashpartitioning(p_partkey" in plan(catalog.QUERIES[name](spark, data)), name


def test_pages_of_a_book_are_sorted_once(spark, data):
    text = plan(catalog.QUERIES["q57_page_chains"](spark, data))
    # one sort numbers the lines, one serves every window over pages
    assert text.count("Sort [") == 2 and "REPARTITION_BY_NUM" in text


def test_shortcuts_of_religions_agree_with_the_patterns(spark):
    texts = [*labels.RELIGION_NAMES, "HINDU", "Khong Hu Cu", "Kong Fu Tse", "Confucian", "konfusian", "Penghayat", "Aliran", "Muslim", "Catholic", "Budhha", "Lain-lain", "Others", "Total.", "Ísłam", "ｉｓｌａｍ", "Aek 12", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = labels.first_match(labels.norm_label("t"), labels.RELIGION_PATTERNS)
    got = df.select("t", plain.alias("want"), labels.canonical_religion("t").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert all(r["want"] == labels.RELIGION_NAMES[r["t"]] for r in got if r["t"] in labels.RELIGION_NAMES)


def test_ties_are_told_after_the_multiplication(spark):
    values = [2.0005, 1.1115, 1.0025, -2.0005, 1.0625, 0.1, 7.0]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    assert [r[0] for r in df.select(nulls.half_even(F.col("x"), 3)).collect()] == [2.001, 1.112, 1.002, -2.001, 1.062, 0.1, 7.0, None]


def test_words_of_a_page_meet_once(spark, data):
    text = plan(catalog.QUERIES["q56_placed_words"](spark, data))
    # documents are dealt once; neither words nor lines are shuffled, sorted or joined
    assert text.count("Exchange ") == 1 and "Join" not in text and "Sort" not in text and "Window" not in text


def test_pages_of_words_in_an_array(spark):
    words = [("Islam", 50, 60, 1), ("Hindu", 70, 80, 2), ("Budha", 90, 100, 1), ("Aek", 1, 9, 20), ("5", 76, 80, 21), ("4", 70, 74, 22), (None, 1, 2, 20), ("x", None, 2, 20)]
    pages = [(1, words), (2, words[:2]), (3, []), (4, None), (None, words)]
    df = spark.createDataFrame(pages, "p int, words array<struct<text:string,x0:int,x1:int,top:int>>")
    got = placed.rows_of_pages(df, ["p"], labels.canonical_religion).collect()
    assert sorted(map(tuple, got)) == [(1, 0, ["label", "islam", "hindu", "buddha"]), (1, 1, ["Aek", "", "4 5", ""])]


def test_tables_of_lines_are_dealt_once(spark, data):
    for name in ("q42_domain_total", "q60_domain_rows", "q61_outline"):
        text = plan(catalog.QUERIES[name](spark, data))
        assert text.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in text and "Join" not in text, name


def test_subtotals_of_three_levels(spark):
    rows = [(1, 1, 10.0, None), (2, 2, 7.0, 1), (3, 3, 7.0, 2), (4, 2, 3.0, 1), (5, 1, 4.0, None), (6, 2, None, 5)]
    df = spark.createDataFrame([(t, *r, "all") for t in ("a", None) for r in rows], "t string, row_no int, level int, v double, parent int, cat string")
    got = outline.subtotals(df, ["t"], "row_no", "cat", "v").collect()
    assert sorted((r.row_no, r.below, r.adds_up) for r in got if r.t is None) == sorted((r.row_no, r.below, r.adds_up) for r in got if r.t) == [(1, 10.0, True), (2, 7.0, True), (3, None, None), (4, None, None), (5, None, None), (6, None, None)]
    assert sorted(map(tuple, outline.top_sums(outline.subtotals(df, ["t"], "row_no", "cat", "v"), ["t"], "level", "cat", "v").collect()), key=str) == [("a", "all", 14.0), (None, "all", 14.0)]


def test_units_equal_to_the_rest(spark):
    rows = [("a", 2020, "x", "islam", 10.0), ("a", 2020, "y", "islam", 20.0), ("a", 2020, "z", "islam", 30.0), ("a", 2020, "z", "hindu", 5.0), ("a", 2020, "y", "hindu", 4.0), ("a", None, "x", "islam", 1.0), (None, 2020, "x", None, 1.0), ("b", 2020, "Jumlah", "islam", 9.0), ("b", 2020, "Total", "islam", 8.0), ("b", 2020, None, "islam", 1.0)]
    df = spark.createDataFrame(rows, "d string, year int, u string, religion string, count double")
    assert [tuple(r) for r in relational.equal_to_rest(df, ["d", "year"], "u", "religion", "count").orderBy("d").collect()] == [("a", 2020, "z"), ("b", 2020, "Jumlah")]
    got = sorted(map(tuple, ingest.domain_total(df, "d", "u").collect()), key=str)
    assert got == sorted([("a", 2020, "islam", 30.0, "equals rest"), ("a", 2020, "hindu", 5.0, "equals rest"), ("a", None, "islam", 1.0, "sum"), (None, 2020, None, 1.0, "sum"), ("b", 2020, "islam", 9.0, "label")], key=str)


def test_facing_pages_are_dealt_once(spark, data):
    text = plan(catalog.QUERIES["q58_facing_pages"](spark, data))
    # orders are dealt by customer and sorted once; labels are looked up within a page
    assert text.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in text and "Join" not in text and text.count("Sort [") == 1


def test_labels_are_looked_up_in_sorted_arrays(spark):
    head, more = ["Kecamatan", "Islam", "Kristen", "Katolik"], ["Kecamatan", "Hindu", "Budha"]
    names = ["Aek", "Bah", "Dolok", "Esa", "Fajar"]
    rows = lambda names, *cells: [[n, *cells] for n in names]
    tables = [
        ("b", 1, 0, [head, *rows([*names, "Aek", None], "1", "2", "3")]),
        # the better match is the second table; of labels that come again the last row counts
        ("b", 2, 0, [["Kecamatan", "Khonghucu"], *rows(names[:4], "9")]), ("b", 2, 1, [more, *rows(["Aek", *names[::-1]], "4", "5"), ["aek", "6", "7"]]),
        # a page with a header alone parts no figures and matches nothing; another book is no facing page
        ("b", 5, 0, [head, *rows(names, "1", "2", "3")]), ("b", 6, 0, [more]), ("c", 1, 0, [head, *rows(names, "1", "2", "3")]), ("d", 2, 0, [more, *rows(names, "4", "5")]),
        (None, 1, 0, [head, *rows(names, "1", "2", "3")]), (None, 2, 0, [more, *rows(names, "4", "5")]),
    ]
    cells = spark.createDataFrame([(b, p, t, i, r) for b, p, t, grid in tables for i, r in enumerate(grid)], "book string, page int, table_no int, row_no int, cells array<string>")
    got = {(r.book, r.page): r for r in pages.faced(pages.gathered(cells)).collect()}
    assert [(r["cells"][0], *r["cells"][4:]) for r in got["b", 1].lines] == [("Aek", "6", "7"), *[(n, "4", "5") for n in names[1:]], ("Aek", "6", "7"), (None, None, None)]
    assert got["b", 1].header == [*head, "Hindu", "Budha"] and [tuple(p) for p in got["b", 1].pairs] == [(0, 7, 5, True), (1, 7, 6, True)]
    assert [tuple(p) for p in got["b", 5].pairs] == [(0, 5, 0, False)] and all(got[k].header == head and not got[k].pairs for k in (("c", 1), (None, 1)))
    # read from joined tables, it is the same
    wide, pairs = pages.facing_columns(pages.chained(cells), cells)
    assert sorted(((r.book, r.page, r.cells) for r in wide.collect()), key=str) == sorted(((*k, x["cells"]) for k, r in got.items() for x in r.lines), key=str)
    assert sorted(((r.book, r.page, *r[2:]) for r in pairs.collect()), key=str) == sorted(((*k, *p) for k, r in got.items() for p in r.pairs or []), key=str)
