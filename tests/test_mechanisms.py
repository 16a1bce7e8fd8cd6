"""Stores of raw answers, resumed streams, polygons with holes, census categories."""

import json

import pytest
from pyspark.sql import functions as F

from panelwright.operators import spatial
from panelwright.plans import census
from panelwright.sources import raw


def test_raw_store_keeps_what_was_committed(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    items = spark.createDataFrame([(str(i), f'{{"n":{i}}} é\n') for i in range(20)], "key string, payload string")
    assert raw.held_raw(spark, path).count() == 0 and raw.not_held(items, "key", path).count() == 20
    raw.keep_raw(items.where("key < '2'").repartition(3), path)
    raw.keep_raw(items.where("key = '1'").withColumn("payload", F.lit("poor")), path)
    held = {r.key: (r.payload, r.batch) for r in raw.held_raw(spark, path).collect()}
    assert held["1"] == ("poor", 2) and held["10"] == ('{"n":10} é\n', 1) and len(held) == 12
    assert {r.key for r in raw.not_held(items, "key", path).collect()} == {str(i) for i in range(2, 10)}
    assert {r.key for r in raw.not_held(items, "key", path, F.col("payload") != "poor").collect()} == {str(i) for i in range(1, 10)}
    # a batch of which a task fails leaves nothing that is read
    bad = items.where("key >= '2'").withColumn("payload", F.when(F.col("key") == "9", F.raise_error(F.lit("broken"))).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="broken"):
        raw.keep_raw(bad.repartition(4), path)
    assert raw.held_raw(spark, path).count() == 12
    raw.keep_raw(items.where("false"), path)
    assert raw.held_raw(spark, path).count() == 12


def answers(years):
    """Canned answers of three tables, the last of which has no year."""
    out, tables = {}, []
    for t in ("a", "b", "none"):
        url = f"http://x/{t}"
        tables.append((t, url))
        own = years if t != "none" else []
        out[url] = {"data": [{}, [{"th_id": y} for y in own]]}
        for i in range(0, len(own), 2):
            ids = own[i : i + 2]
            cells = {f"19{y}": float(y) for y in ids}
            axis = [{"val": "1", "label": t}]
            out[f"{url}/th/" + ";".join(map(str, ids))] = {"data-availability": "available", "vervar": axis, "var": [{"val": "9", "label": "p"}], "turvar": [], "tahun": [{"val": str(y), "label": str(1900 + y)} for y in ids], "turtahun": [], "datacontent": cells}
    return tables, out


def test_stream_of_calls_goes_on_behind_its_checkpoint(spark, tmp_path):
    tables, canned = answers([118, 119, 120, 121, 122])
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    assert raw.fetch_tables(spark, tables[:1], out, checkpoint, 1, canned) == 1
    # the list has grown: only what is new is asked for, so the first table's answers may be gone
    later = {u: a for u, a in canned.items() if not u.startswith("http://x/a")}
    assert raw.fetch_tables(spark, tables, out, checkpoint, 1, later) >= 1
    calls = spark.read.parquet(out)
    assert sorted((r.ref, r.part) for r in calls.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2)]
    cubes = {r.ref: json.loads(r.cube) for r in raw.merged_tables(calls).collect()}
    assert sorted(y["val"] for y in cubes["a"]["tahun"]) == ["118", "119", "120", "121", "122"] and len(cubes["b"]["datacontent"]) == 5 and "none" not in cubes


SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
HOLE = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]
FAR = [(20.0, 0.0), (24.0, 0.0), (24.0, 3.0), (20.0, 3.0)]


def shapes(spark, rows):
    return spark.createDataFrame([(u, [[{"x": x, "y": y} for x, y in r] for r in rings]) for u, rings in rows], "unit string, rings array<array<struct<x:double,y:double>>>")


def test_points_in_polygons_with_holes(spark):
    units = shapes(spark, [("a", [SQUARE, HOLE]), ("a", [FAR]), ("b", [HOLE])])
    points = [(i, i % 26 + 0.5, i // 26 + 0.25) for i in range(26 * 12)]
    got = {(r.id, r.unit) for r in spatial.points_in_polygons(spark.createDataFrame(points, "id int, x double, y double"), units, "unit", "rings", 2.5).collect()}
    within = lambda x, y, r: r[0][0] < x < r[2][0] and r[0][1] < y < r[2][1]
    want = {(i, "a") for i, x, y in points if within(x, y, SQUARE) and not within(x, y, HOLE) or within(x, y, FAR)} | {(i, "b") for i, x, y in points if within(x, y, HOLE)}
    assert got == want


def test_lines_are_cut_out_of_holes(spark):
    units = shapes(spark, [("a", [SQUARE, HOLE]), ("a", [FAR])])
    line = spark.createDataFrame([("r", [{"x": -1.0, "y": 5.0}, {"x": 11.0, "y": 5.0}]), ("s", [{"x": 19.0, "y": 1.0}, {"x": 22.0, "y": 1.0}])], "road string, line array<struct<x:double,y:double>>")
    got = sorted((r.road, r.part, [(round(p.x, 6), round(p.y, 6)) for p in r.line]) for r in spatial.clip_lines(line, "road", "line", units, "unit", "rings", 2.0).collect())
    assert got == [("r", 0, [(0.0, 5.0), (4.0, 5.0)]), ("r", 1, [(6.0, 5.0), (10.0, 5.0)]), ("s", 0, [(20.0, 1.0), (22.0, 1.0)])]


BOOK = [("ETHNIC", "1", "Javanese"), ("ETHNIC", "2", "Chinese / Tionghoa"), ("RELIG", "5", "Buddhist"), ("RELIG", "6", "Khong Hu Cu"), ("RELIG", "1", "Muslim"), ("GEO2", "1101", "Aek"), ("GEO1", "11", "Aceh")]


def test_census_shares(spark):
    book = spark.createDataFrame(BOOK, "var string, code string, label string")
    people = [("1101", "11", " 2", "6", "100"), ("1101", "11", "2", "5", "300"), ("1101", "11", "1", "6", "50"), ("1102", "12", "1", "1", "x"), ("1102", "12", "1", "1", "450"), (None, "12", "2", "6", "9")]
    df = spark.createDataFrame(people, "GEO2 string, GEO1 string, ethnic string, relig string, perwt string")
    out, seen = census.unit_shares(df, book, "GEO2", "perwt", "ethnic", "relig", 1000.0, "GEO1")
    got = {r.geo2: r for r in out.collect()}
    a, b = got["1101"], got["1102"]
    assert (a["pop"], a.chinese, a.konghucu, a.konghucu_chinese, a.buddha_chinese, a.n_chinese_sample) == (450.0, 400.0, 150.0, 100.0, 300.0, 2)
    assert (a.geo2_label, a.geo1_label, b.geo2_label, b.geo1_label) == ("Aek", "Aceh", "", "") and (a.konghucu_of_chinese, b.konghucu_of_chinese) == (0.25, None)
    assert seen.get == {"weighted": 900.0, "plausible": True}
    out, seen = census.unit_shares(df, book, "GEO2", "perwt", "ethnic", "relig", 80.0)
    assert {r.geo2: r["pop"] for r in out.collect()} == {"1101": 4.5, "1102": 4.5} and seen.get["plausible"] is False
    with pytest.raises(Exception, match="no category of ethnic"):
        census.unit_shares(df, book.where("code <> '2'"), "GEO2", "perwt", "ethnic", "relig", 1000.0)[0].collect()
