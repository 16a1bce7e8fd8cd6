"""Percentage tables, matching of places, ties, geometry and printed tables."""

import math

import pytest
from pyspark.sql import functions as F

from panelwright.functions import geo, labels, numbers
from panelwright.operators import grids, spatial
from panelwright.operators import relational as rel
from panelwright.plans import estimate, harmonise, matching
from panelwright.streaming import incremental

LONG = "source string, unit_code string, year int, semester int, religion string, count double, ref string"


def cell(source, unit, counts, ref, year=2020):
    return [(source, unit, year, None, k, v, ref) for k, v in counts.items()]


def test_percentage_tables(spark):
    percent = {"islam": 80.0, "kristen": 5.0, "katolik": 3.0, "konghucu": 0.5}
    rows = cell("pdf_da_pct", "1101", percent, "p:1101:1") + cell("pdf_da_pct", "1102", percent, "p:1102:1")
    rows += cell("bps", "1103", {"islam": 900.0, "kristen": 50.0, "katolik": 40.0, "total": 1000.0}, "b:1103:1")
    long = spark.createDataFrame(rows, LONG)
    population = spark.createDataFrame([("1101", 2020, 50_000.0), ("1103", 2020, 1000.0)], "unit_code string, year int, population double")
    got = {r.unit_code: r for r in harmonise.build_panel(long, population).collect()}
    assert set(got) == {"1101", "1103"}  # without a population percentages say nothing
    own = got["1101"]
    assert (own.islam, own.kristen, own.katolik, own.konghucu, own.total_reported) == (40_000, 2500, 1500, 250, None)
    assert own.total == 44_250 and own.total_is_sum and own.quality == ""
    # without a population table the values decide
    exact = spark.createDataFrame(cell("pdf_da_pct", "1104", {"islam": 90.0, "kristen": 6.0, "katolik": 4.0}, "p:1:1"), LONG)
    assert harmonise.build_panel(exact).count() == 0


def test_a_column_that_no_table_has_is_not_missed(spark):
    rows = cell("bps", "1101", {"islam": 900.0, "kristen": 50.0}, "b:1:1") + cell("bps", "1102", {"islam": 900.0}, "b:1:2")
    got = {r.unit_code: (r.quality, r.total) for r in harmonise.build_panel(spark.createDataFrame(rows, LONG)).collect()}
    assert got == {"1101": ("", 950.0), "1102": ("partial", None)}


def test_lost_exact_counts(spark):
    rows = cell("pdf_da", "1101", {"islam": 9.0, "hindu": 1.0}, "a") + cell("bps", "1101", {"islam": 9.0, "konghucu": 1.0}, "b")
    rows += cell("pdf_da", "1102", {"islam": 9.0, "konghucu": 2.0}, "a")
    held = harmonise.panel_rows(spark.createDataFrame(rows, LONG))
    assert [tuple(r) for r in harmonise.lost_exact(held).collect()] == [(2020, 1)]




def test_scale_leaves_persons_alone(spark):
    rows = [("a", 900.0, "Ribu"), ("a", 1100.0, "Ribu"), ("b", 900_000.0, "Ribu Jiwa"), ("c", 900.0, "Jiwa"), ("d", 9.0, "")]
    df = spark.createDataFrame(rows, "ref string, count double, unit string")
    got = harmonise.scale_populations(df, "ref", "count", numbers.unit_scale("unit", F.lit("Penduduk (Ribu Jiwa)"))).collect()
    assert sorted((r.ref, r.population) for r in got) == [("a", 900_000), ("a", 1_100_000), ("b", 900_000), ("c", 900), ("d", 9000)]


def test_percent_cells(spark):
    cells = ["6,4390", "0 ,0021", "_", "-", "", "a12b3", "45,6 x", None, "..."]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(numbers.percent_value("c")).collect()]
    assert got == [6.439, 0.0021, 0, 0, None, 123, 45.6, None, 0]


def test_provinces(spark):
    names = ["Aceh", "Provinsi DKI Jakarta", "PROV. JAWA BARAT", "Daerah Istimewa Yogyakarta", "Nowhere", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(labels.province_code("n")).collect()]
    assert got == ["11", "31", "32", "34", None, None]


def test_investment_column(spark):
    got = matching.investment_column(spark.createDataFrame([("101", "2020", "5.5"), ("1102", "2021", "x")], "unit_code string, year string, value string")).collect()
    assert [tuple(r) for r in got] == [("0101", 2020, 5.5), ("1102", 2021, 0.0)]


def test_rules_that_hit_everything_are_ignored(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "u string, y int")
    rules = spark.createDataFrame([("a", None), (None, 2)], "u string, y int")
    assert [r.y for r in rel.drop_by_rules(df, rules, ["u", "y"]).collect()] == [1]
    assert rel.drop_by_rules(df, rules.where("false"), ["u", "y"]).count() == 2
    assert rel.drop_by_rules(df.where("false"), rules, ["u", "y"]).count() == 0


def test_union_settles_ties(spark):
    older = spark.createDataFrame([("k", 1, "old"), ("m", 1, "old")], "k string, v int, w string")
    newer = spark.createDataFrame([("k", 3, "b"), ("k", 2, "c"), ("k", 3, "a")], "k string, v int, w string")
    assert sorted(tuple(r) for r in rel.union_keep_last(older, newer, ["k"], F.desc("v")).collect()) == [("k", 3, "a"), ("m", 1, "old")]


def test_assert_unique(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert rel.assert_unique(df, ["a", "b"]) is df
    with pytest.raises(ValueError, match="more than once"):
        rel.assert_unique(df, ["a"])


def test_outcome(spark):
    got = incremental.outcome(spark.createDataFrame([("1",), ("x",)], "s string"), F.col("s").try_cast("int"), "n").collect()
    assert [(r.n, r.status) for r in got] == [(1, "ok"), (None, "failed")]


def test_utm(spark):
    # central meridian, equator, and published coordinates of the CN Tower
    rows = [(3.0, 0.0), (-79.387139, 43.642567), (106.8272, -6.1751)]
    got = [r.p for r in spark.createDataFrame(rows, "lon double, lat double").select(geo.utm_forward("lon", "lat").alias("p")).collect()]
    assert abs(got[0].x - 500_000) < 1e-6 and abs(got[0].y) < 1e-6
    assert abs(got[1].x - 630_084) < 1 and abs(got[1].y - 4_833_439) < 1
    assert 6e5 < got[2].x < 8e5 and 9.2e6 < got[2].y < 9.4e6


def test_utm_round_trip(spark):
    rows = [(x / 7 - 170, y / 3 - 75) for x in range(0, 2300, 97) for y in range(0, 440, 37)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("p", geo.utm_forward("lon", "lat"))
    df = df.withColumn("q", geo.utm_inverse("p.x", "p.y", geo.utm_epsg("lon", "lat")))
    assert df.where("abs(q.lon - lon) > 1e-8 or abs(q.lat - lat) > 1e-8").count() == 0


def test_capped_points(spark):
    df = spark.createDataFrame([("u", i) for i in range(20)] + [("v", 1)], "unit string, k int")
    got = spatial.capped_per_unit(df, "unit", "k", 5).collect()
    assert sorted(r.point_id for r in got) == [f"u_{i:05d}" for i in range(5)] + ["v_00000"]


def test_page_scores(spark):
    pages = ["Jumlah Penduduk Menurut Agama\nIslam Kristen Katolik Hindu Buddha Konghucu", "Daftar Isi\nAgama ....... 5", "Tempat Ibadah\nIslam Hindu"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "t string").select(grids.page_score(F.col("t"))).collect()]
    assert got[0] > 4 > max(got[1:])


def test_merged_cubes(spark):
    rows = [("v", 1, ["2019", "2020"], {"a": 1.0, "b": 2.0}), ("v", 2, ["2020", "2021"], {"b": 3.0, "c": 4.0})]
    got = grids.merge_cubes(spark.createDataFrame(rows, "k string, part int, years array<string>, cells map<string,double>"), ["k"], "years", "cells", "part").first()
    assert got.years == ["2019", "2020", "2021"] and got.cells == {"a": 1.0, "b": 3.0, "c": 4.0}


def test_titles(spark):
    rows = [("Penduduk Menurut Agama",), ("Tempat Ibadah Menurut Agama",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(labels.title_is_about("t", "agama", "ibadah")).collect()]
    assert got == [True, False, False]


def test_tails():
    assert abs(estimate.two_sided(1.959964) - 0.05) < 1e-6
    for z, freedom, p in ((2.011741, 47, 0.05), (12.7062, 1, 0.05), (2.262157, 9, 0.05)):
        assert abs(estimate.two_sided(z, freedom) - p) < 1e-5
    assert math.isnan(estimate.two_sided(math.nan))


def line_of(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


POINTS = "array<struct<x:double,y:double>>"


def test_roads_are_cut_at_units(spark):
    units = spark.createDataFrame([("a", line_of((0, 0), (4, 0), (4, 4), (0, 4))), ("b", line_of((4, 0), (8, 0), (8, 4), (4, 4))), ("u", line_of((0, 10), (6, 10), (6, 16), (4, 16), (4, 12), (2, 12), (2, 16), (0, 16)))], f"unit string, ring {POINTS}")
    roads = spark.createDataFrame([("across", line_of((-1, 1), (2, 1), (9, 1))), ("bent", line_of((1, 2), (3, 2), (3, 3))), ("outside", line_of((20, 20), (30, 20))), ("fork", line_of((-1, 14), (7, 14)))], f"road string, line {POINTS}")
    got = spatial.clip_lines(roads, "road", "line", units, "unit", "ring", 1.5).collect()
    flat = sorted((r.unit, r.road, r.part, [(round(p.x, 9), round(p.y, 9)) for p in r.line]) for r in got)
    assert flat == [
        ("a", "across", 0, [(0, 1), (2, 1), (4, 1)]), ("a", "bent", 0, [(1, 2), (3, 2), (3, 3)]), ("b", "across", 0, [(4, 1), (8, 1)]),
        ("u", "fork", 0, [(0, 14), (2, 14)]), ("u", "fork", 1, [(4, 14), (6, 14)]),
    ]


def test_road_points(spark):
    box = lambda x: line_of((x, -6.2), (x + 0.01, -6.2), (x + 0.01, -6.19), (x, -6.19))
    units = spark.createDataFrame([("a", box(106.80)), ("b", box(106.81))], f"unit string, ring {POINTS}")
    roads = spark.createDataFrame([("r", line_of((106.79, -6.195), (106.83, -6.195)))], f"road string, line {POINTS}")
    got = spatial.road_points(units, roads, "unit", "ring", "road", "line").collect()
    assert {r.unit for r in got} == {"a", "b"} and len(got) in range(42, 47)  # 1,106 metres in each
    for r in got:
        assert abs(r.lat + 6.195) < 1e-5 and abs(r.bearing - 90) < 1 and (106.80 if r.unit == "a" else 106.81) <= r.lon <= (106.81 if r.unit == "a" else 106.82)
    lons = sorted(r.lon for r in got if r.unit == "a")
    assert all(abs((b - a) * 110_700 - 50) < 1 for a, b in zip(lons, lons[1:], strict=False))
    assert spatial.road_points(units, roads, "unit", "ring", "road", "line", cap=3).count() == 6
