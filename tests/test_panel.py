"""Panel rules on tiny tables with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import labels, numbers
from panelwright.operators import grids, relational as rel
from panelwright.plans import estimate, harmonise, rollup
from panelwright.sources import readers, services
from panelwright.streaming import incremental


def values_of(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_religions(spark):
    cases = {"Khong Hu Chu": "konghucu", "KONGHUCU": "konghucu", "Islam": "islam", "Kristen Protestan": "kristen", "Katholik": "katolik", "Budha": "buddha", "Aliran Kepercayaan": "kepercayaan", "Lain-lain": "lainnya", "Jumlah": "total", "Luas": None}
    assert values_of(spark, list(cases), labels.canonical_religion("x")) == list(cases.values())


def test_nationalities(spark):
    cases = {"China (Taiwan)": "TWN", "Hong Kong": "HKG", "Tiongkok": "CHN", "Korea Utara": "PRK", "Korea": "KOR", "Lainnya": "OTHER", "Jumlah": "TOTAL", "": None}
    assert values_of(spark, list(cases), labels.canonical_nationality("x")) == list(cases.values())


def test_counts(spark):
    cases = {"1.234.567": 1234567.0, "12,5": 12.5, "1,234": 1234.0, "1.234,5": 1234.5, "1.5": 1.5, "-": 0.0, "...": None, "1.2.34": None, "x": None}
    assert values_of(spark, list(cases), numbers.parse_count("x", True)) == list(cases.values())


def test_unit_names(spark):
    cases = {"Kab. Deli Serdang": "deliserdang", "KOTA MEDAN": "medan", "2. Bulungan *)": "bulungan", "Pangkep": "pangkajenedankepulauan"}
    assert values_of(spark, list(cases), labels.unit_key("x")) == list(cases.values())


def long_rows(spark, cells):
    return spark.createDataFrame([(s, u, y, r, float(c), ref) for s, u, y, r, c, ref in cells], "source string, unit_code string, year int, religion string, count double, ref string").withColumn("semester", F.lit(None).cast("int"))


def test_panel_takes_one_reference_a_cell(spark):
    cells = [("bps", "1101", 2020, r, c, "bps:1100:1") for r, c in (("islam", 900), ("kristen", 50), ("katolik", 40), ("konghucu", 5), ("total", 995))]
    cells += [("bps_kabsum", "1101", 2020, "konghucu", 9, "da:1101:2020")]
    cells += [("bps", "1102", 2020, r, 50, "bps:1100:1") for r in ("islam", "hindu")] + [("pdf_da_pct", "1103", 2020, r, c, "da:1103:2020") for r, c in (("islam", 90), ("kristen", 6), ("katolik", 4))]
    pop = spark.createDataFrame([("1101", 2020, 1000.0), ("1103", 2020, 2000.0)], "unit_code string, year int, population double")
    rules = spark.createDataFrame([("1102", None, None), (None, None, None)], "unit_code string, year int, ref string")
    got = {r.unit_code: r for r in harmonise.build_panel(long_rows(spark, cells), pop, rules).collect()}
    assert set(got) == {"1101", "1103"}
    assert got["1101"].konghucu == 5 and got["1101"].sources == "bps" and got["1101"].total == 995 and got["1101"].total_is_sum
    assert got["1103"].islam == 1800 and got["1103"].total == 2000 and got["1103"].quality == ""


def test_cell_quality(spark):
    base = dict.fromkeys(labels.RELIGIONS)
    rows = [base | {"islam": 60.0, "kristen": 30.0, "katolik": 10.0}, base | {"islam": 7.0, "kristen": 7.0, "katolik": 7.0, "hindu": 7.0}, base, base | {"islam": 500.0}, base | {"islam": 500.0, "kristen": 0.0, "katolik": 0.0, "hindu": 0.0, "buddha": 0.0}]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in labels.RELIGIONS))
    assert [r[0] for r in df.select(harmonise.cell_quality()).collect()] == ["percent", "placeholder", "no_religions", "partial", ""]


def test_codes_by_ever_looser_keys(spark):
    codes = spark.createDataFrame([("11", "kota", "a", "1171"), ("11", "kabupaten", "a", "1101"), ("12", "kabupaten", "b", "1201")], "province_code string, level string, unit_key string, unit_code string")
    facts = spark.createDataFrame([(1, "11", "kota", "a", None), (2, "11", "unknown", "a", None), (3, None, "unknown", "b", None), (4, "12", "kota", "zz", None), (5, "12", "kecamatan", "b", None), (6, "12", "kota", "b", "9999")], "id int, province_code string, level string, unit_key string, unit_code string")
    got = {r.id: r.unit_code for r in harmonise.attach_codes(facts, codes).collect()}
    assert got == {1: "1171", 2: "1101", 3: "1201", 4: None, 5: None, 6: "9999"}


def test_reconciliation(spark):
    rows = [("a", 2020, "r1", 1000.0), ("a", 2020, "r2", 1010.0), ("a", 2020, "r3", 100000.0), ("b", 2020, "r1", 5.0), ("b", 2021, "r1", 7000.0)]
    got = harmonise.reconcile_series(spark.createDataFrame(rows, "u string, y int, ref string, v double"), "u", "y", "ref", "v", 100, 1e7).collect()
    assert {(r.u, r.y): r.v for r in got} == {("a", 2020): 1000.0, ("b", 2021): 7000.0}


def test_year_correction(spark):
    rows = spark.createDataFrame([("x", 2019), ("x", 1999), ("z", 2010), ("z", 1950)], "ref string, year int")
    books = spark.createDataFrame([("x", 2020)], "ref string, year int")
    assert sorted((r.ref, r.year) for r in harmonise.correct_years(rows, books).collect()) == [("x", 2019), ("x", 2019), ("z", 2010)]


def test_foreign_panel(spark):
    rows = [("1101", 2020, "CHN", "ITAS", 10.0, "s1"), ("1101", 2020, "CHN", None, 5.0, "s2"), ("1101", 2020, "JPN", "ITAS", 3.0, "s1"), ("1101", 2020, "TOTAL", None, 99.0, "s1")]
    rows.append(("1101", 2020, "WNA", None, 40.0, "s1"))
    frame = spark.createDataFrame(rows, "unit_code string, year int, nationality string, permit_type string, count double, source string")
    got = harmonise.foreign_panel(frame).first()
    assert (got.chn_itas, got.chn_any, got.wna_resident, got.foreign_total, got.sources) == (10, 15, 40, 99, "s1;s2")
    province = spark.createDataFrame([("11", 2020, "CHN", 3.0), ("11", 2020, "CHN", 4.0), ("11", 2020, "JPN", 9.0)], "province_code string, year int, nationality string, count double")
    assert harmonise.foreign_panel(frame, province).first().chn_province_any == 7


def test_jumps(spark):
    rows = [("u", 2015, 11194.0), ("u", 2016, 285.0), ("u", 2017, None), ("u", 2018, 11194.0), ("v", 2000, 2.0), ("v", 2001, 15.0), ("w", 2000, 10.0), ("w", 2015, 1000.0)]
    got = rel.jumps(spark.createDataFrame(rows, "u string, year int, k double"), ["u"], ["year"], "k").collect()
    assert sorted((r.u, r.year) for r in got) == [("u", 2016), ("u", 2018)]


def test_rollup(spark):
    images = spark.createDataFrame([("p1", "OK", 2, 1, 5.0, 10.0, 100.0), ("p1", "OK", 0, 0, 0.0, 0.0, 100.0), ("p2", "OK", 0, 0, 0.0, 0.0, 100.0), ("p3", "NO_IMAGE", 9, 9, 9.0, 9.0, 9.0)], "place_id string, status string, n_boxes int, n_hits int, hit_area double, text_area double, area double")
    places = spark.createDataFrame([("p1", "u", "a", "2020", "OK"), ("p1", "u", "b", "2021", "OK"), ("p2", "u", "a", "2021", "OK"), ("p3", "u", "a", "2021", "OK")], "place_id string, unit_id string, point_id string, year string, status string")
    level = rollup.place_level(images, places)
    assert {r.place_id: (r.n_images, r.any_hit, r.hit_share) for r in level.collect()} == {"p1": (2, 1, 0.5), "p2": (1, 0, None)}
    units = {r.year: r for r in rollup.unit_year(rollup.point_year(level)).collect()}
    assert units["2020"].n_points == 1 and units["2020"].share_points_hit == 1 and units["2021"].n_points_repeated == 1


def panel_of(seed=0, effect=0.5, units=60):
    rng = random.Random(seed)
    panel, flows = [], []
    for u in range(units):
        code, pop, stock, base = f"{11 + u % 6}{u:02d}", rng.uniform(5e4, 5e5), 0.0, rng.uniform(1, 5)
        for y in range(2019, 2024):
            flow = pop * rng.uniform(0, 0.01) if rng.random() < 0.6 and y > 2019 else 0.0
            stock += flow
            flows.append((code, y, flow))
            share = base + effect * math.log1p(1000 * stock / pop) + rng.gauss(0, 0.01)
            panel.append((code, y, pop, share * pop / 1000, "dukcapil:1"))
    return panel, flows


def test_planted_effect(spark):
    panel, flows = panel_of()
    p = spark.createDataFrame(panel, "unit_code string, year int, population double, k double, ref string")
    inv = spark.createDataFrame(flows, "unit_code string, year int, value double")
    assert abs(estimate.two_way_effects(p, inv, "k", 2019, 2023).row("_x")["beta"] - 0.5) < 0.02
    fit = estimate.long_difference(estimate.two_period(p, "k", 2019, 2023), inv, "change", 2019, 2023)
    assert abs(fit.row("treat")["beta"] - 0.5) < 0.02 and fit.n == 60


def test_ols_against_closed_form(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(200, 2)), rng.integers(0, 30, 200)
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=200) * (1 + np.abs(x[:, 0]))
    df = spark.createDataFrame([(float(a), float(b[0]), float(b[1]), float(2 * b[0]), int(k)) for a, b, k in zip(y, x, g, strict=True)], "y double, a double, b double, c double, g int")
    design = np.column_stack([np.ones(200), x])
    inv = np.linalg.inv(design.T @ design)
    beta = inv @ design.T @ y
    e, h = y - design @ beta, np.einsum("ij,jk,ik->i", design, inv, design)
    scores = np.array([(design[g == k] * e[g == k, None]).sum(0) for k in np.unique(g)])
    n_g = len(scores)
    meats = {"HC1": (design.T * e**2) @ design * 200 / 197, "HC3": (design.T * (e / (1 - h)) ** 2) @ design, "cluster": scores.T @ scores * n_g / (n_g - 1) * 199 / 197}
    for kind, meat in meats.items():
        fit = estimate.ols(df, "y", ["a", "b", "c"], cluster="g", kind=kind)
        assert fit.dropped == ["c"] and np.allclose(fit.beta, beta) and np.allclose(fit.se, np.sqrt(np.diag(inv @ meat @ inv)))
        assert math.isnan(fit.row("c")["beta"])


def test_grids():
    page = "<table><tr><th rowspan=2>a</th><th colspan=2>b</th></tr><tr><th>c</th><th>d</th></tr><tr><td>1</td><td>2</td></tr></table>"
    assert grids.html_grids(page) == [[["a", "b", "b"], ["a", "c", "d"], ["1", "2", ""]]]
    assert grids.html_grids("&lt;table&gt;&lt;tr&gt;&lt;td&gt;x&lt;/td&gt;&lt;/tr&gt;&lt;/table&gt;") == [[["x"]]]
    assert grids.html_grids(None) == [] and grids.html_grids("<table><tr><td><table><tr><td>i</td></tr></table></td></tr></table>") == [[["i"]]]


def test_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# note\nunit_code,year,reason\n1101,2020,typo\n,2019,\n")
    assert [tuple(r) for r in readers.read_drop_rules(spark, str(tmp_path / "r.csv")).collect()] == [("1101", 2020, None, "typo"), (None, 2019, None, None)]
    assert readers.read_drop_rules(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "l.csv").write_bytes("Kab;Jml\nPér;1\n".encode("latin-1"))
    assert [tuple(r) for r in readers.read_tabular(spark, str(tmp_path / "l.csv")).collect()] == [("Pér", "1")]
    (tmp_path / "p.json").write_text('{"features":[{"properties":{"id":"u1"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    assert readers.read_polygons(spark, str(tmp_path / "p.json"), "id").first().unit_id == "u1"
    with pytest.raises(Exception, match="feature without"):
        readers.read_polygons(spark, str(tmp_path / "p.json"), "name").collect()
    (tmp_path / "c.xml").write_text('<c xmlns="u"><var ID="V"><catgry><catValu>1</catValu><labl>One</labl></catgry></var></c>')
    assert [tuple(r) for r in readers.read_codebook(spark, str(tmp_path / "c.xml")).collect()] == [("V", "1", "One")]


def test_paged_source(spark):
    import json

    canned = {f"http://s?domain=11&page={p}": {"data": [{"pages": 2}, [{"id": p}]]} for p in (1, 2)}
    spark.dataSource.register(services.PagedSource)
    df = spark.read.format("paged_list").option("url", "http://s").option("queries", json.dumps([{"domain": "11"}, {"domain": "12"}])).option("canned", json.dumps(canned)).load()
    assert sorted(r.row for r in df.collect()) == ['{"id": 1}', '{"id": 2}']
    waits = []
    answers = iter([(503, b""), (429, b""), (200, b'{"a": 1}')])
    assert services.get_json("u", fetch=lambda _: next(answers), sleep=waits.append) == {"a": 1} and waits == [1, 2]
    assert services.get_json("u", fetch=lambda _: (404, b"")) == {}


def test_incremental(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    run = lambda: incremental.process_new_files(spark, src, "id long", lambda d: d.withColumn("twice", F.col("id") * 2), out, mark, ["id"])
    spark.range(3).write.parquet(src)
    assert run() >= 1 and run() == 0
    spark.range(3, 5).write.mode("append").parquet(src)
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_service_answers():
    search = {"result": {"results": [{"name": "p", "title": "T", "resources": [{"format": "csv", "url": "u1"}, {"format": "pdf", "url": "u2"}, {"format": "CSV", "url": "u1"}]}]}}
    assert [r["url"] for r in services.downloads(search)] == ["u1"]
    assert services.panorama_row({"point_id": "a"}, {"status": "ZERO_RESULTS"})["pano_id"] is None
    answers = {"r/?f=json": {"folders": ["f"], "services": [{"name": "s", "type": "MapServer"}]}, "r/f?f=json": {"error": {"code": 499}}, "r/s/MapServer?f=json": {"layers": [{"name": "L"}]}}
    assert services.walk_services("r", lambda u: answers.get(u, {})) == [{"service": "s", "layer": "L", "status": "ok"}, {"service": "f", "layer": None, "status": "499"}]
    pages = iter([{"features": [{"attributes": {"i": 1}}], "exceededTransferLimit": True}, {"features": [{"attributes": {"i": 2}}]}])
    assert [r["i"] for r in services.feature_pages("u", get=lambda _: next(pages))] == [1, 2]


def reference_fit(y, x):
    """Coefficient and HC3 error of the first regressor, by hand."""
    design = np.column_stack([np.ones(len(y)), *x])
    inv = np.linalg.inv(design.T @ design)
    b = inv @ design.T @ y
    e, h = y - design @ b, np.einsum("ij,jk,ik->i", design, inv, design)
    return b[1], np.sqrt((inv @ (design.T * (e / (1 - h)) ** 2) @ design @ inv)[1, 1])


def test_specification_grid(spark):
    rng = np.random.default_rng(4)
    units = [f"{11 + i % 6}{i:02d}" for i in range(40)]
    pop0, growth, base = rng.uniform(8e4, 9e5, 40).tolist(), rng.uniform(1, 1.02, 40).tolist(), rng.uniform(0.5, 3, 40).tolist()
    flows = {(i, t): (i % 3 > 0) * float(rng.uniform(0, 3000)) for i in range(40) for t in range(2019, 2024)}
    panel, k, pop = [], {}, {}
    for i, u in enumerate(units):
        for t in range(2019, 2024):
            pop[i, t] = pop0[i] * growth[i] ** (t - 2019) * float(rng.uniform(0.99, 1.01))
            k[i, t] = (base[i] + float(rng.normal(0, 0.2)) + 0.1 * math.log(pop[i, t])) * pop[i, t] / 1000
            # unit 3 counts something else in 2021; unit 4's totals are no registrations
            panel.append((u, t, pop[i, t], k[i, t], k[i, t], i == 3 and t == 2021, k[i, t] * 2, 0.7 if i == 4 else 1.02, "da:x"))
    p = spark.createDataFrame(panel, "unit_code string, year int, population double, konghucu double, konghucu_ub double, konghucu_ub_is_lainnya boolean, buddha double, total_to_pop double, ref string")
    inv = spark.createDataFrame([(units[i], t, v) for (i, t), v in flows.items()], "unit_code string, year int, value double")
    got = {r["spec"]: r for r in estimate.specification_grid(estimate.usable(p), inv)}
    for name, own in (("y_exact", [i for i in range(40) if i != 4]), ("y_ub", [i for i in range(40) if i not in (3, 4)])):
        y = np.array([(k[i, 2023] - k[i, 2021]) / pop[i, 2021] * 1000 for i in own])
        x = [np.log1p([sum(flows[i, t] for t in ts) for i in own]) for ts in ((2022, 2023), (2019, 2020, 2021))]
        x += [np.array([1000 * k[i, 2021] / pop[i, 2021] for i in own]), np.log([pop[i, 2021] for i in own])]
        row = got[f"long-diff {name}"]
        assert row["n"] == len(own) and np.allclose((row["coef_d_inv"], row["se"]), reference_fit(y, x), rtol=1e-6)
        within = lambda a: (a - a.mean(1, keepdims=True)).ravel()
        cells = lambda f: within(np.array([[f(i, t) for t in range(2019, 2024)] for i in own]))  # noqa: E731, B023
        z = [cells(lambda i, t: math.log1p(sum(flows[i, s] for s in range(2019, t + 1)))), cells(lambda i, t: math.log(pop[i, t]))] + [cells(lambda i, t, s=s: float(t == s)) for s in range(2020, 2024)]
        row = got[f"TWFE {name} 2019-2023"]
        assert row["n"] == 5 * len(own) and np.isclose(row["coef_d_inv"], reference_fit(cells(lambda i, t: 1000 * k[i, t] / pop[i, t]), z)[0], rtol=1e-6)
    assert len(got) == 19 and "placebo long-diff share_buddha" in got
