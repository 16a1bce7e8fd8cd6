"""The command line over small files, yearbook tables, and what services are asked."""

import json

from panelwright import cli
from panelwright.plans import yearbook
from panelwright.sources import services


def csv_rows(spark, path):
    return [r.asDict() for r in spark.read.option("header", "true").csv(str(path)).collect()]


def test_investment_and_csv(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("provinsi,kabupaten_kota,status_penanaman_modal,negara,year,investasi_us_ribu\nAceh,Kota A,PMA ,Tiongkok,2020,5\nAceh,Kota A,PMDN,,2020,7\nAceh,Nowhere,PMA,Jepang,2020,3\n")
    (tmp_path / "codes.csv").write_text("unit_code,unit_name\n1171,Kota A\n")
    args = ["investment", "--raw", str(tmp_path / "raw.csv"), "--codes", str(tmp_path / "codes.csv"), "--out", str(tmp_path / "o"), "--format", "csv"]
    assert cli.main(args, spark) == 0
    (row,) = csv_rows(spark, tmp_path / "o/investment.csv")
    assert (row["unit_code"], row["year"], row["fdi_china"], row["domestic"]) == ("1171", "2020", "5.0", "7.0")
    assert csv_rows(spark, tmp_path / "o/unmatched.csv") == [{"provinsi": "Aceh", "kabupaten_kota": "Nowhere", "investasi_us_ribu": "3.0"}]


def test_tables_to_panels(spark, tmp_path):
    page = "<table><tr><th>Kabupaten</th><th>Islam</th><th>Hindu</th></tr><tr><td>Kota A</td><td>1.000</td><td>5</td></tr></table>"
    (tmp_path / "p.html").write_text(page)
    assert cli.main(["religion-tables", "--html", str(tmp_path / "p.html"), "--out", str(tmp_path / "r")], spark) == 0
    assert {(r.ref, r.religion, r["count"]) for r in spark.read.parquet(str(tmp_path / "r/religion.parquet")).collect()} == {("p.html", "islam", 1000.0), ("p.html", "hindu", 5.0)}
    (tmp_path / "long.csv").write_text("source,province_code,region_name,region_level,nationality,permit_type,year,count\ns,11,Kota A,kabupaten,CHN,ITAS,2020,4\ns,11,Kanim A,kanim,CHN,,2020,6\ns,11,Aceh,province,CHN,,2020,50\n")
    (tmp_path / "codes.csv").write_text("unit_code,unit_name\n1171,Kota A\n")
    (tmp_path / "cross.csv").write_text("kanim,unit_code,weight\nKanim A,1171,\n")
    args = ["foreign-panel", "--long", str(tmp_path / "long.csv"), "--codes", str(tmp_path / "codes.csv"), "--crosswalk", str(tmp_path / "cross.csv"), "--out", str(tmp_path / "f"), "--format", "csv"]
    assert cli.main(args, spark) == 0
    (row,) = csv_rows(spark, tmp_path / "f/panel.csv")
    assert (row["unit_code"], row["chn_itas"], row["chn_any"], row["chn_province_any"]) == ("1171", "4.0", "10.0", "50.0")


def test_points_and_plans(spark, tmp_path):
    ring = [[106.80, -6.20], [106.81, -6.20], [106.81, -6.19], [106.80, -6.19], [106.80, -6.20]]
    unit = {"type": "Feature", "properties": {"id": "u"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    road = {"type": "Feature", "properties": {"highway": "primary"}, "geometry": {"type": "LineString", "coordinates": [[106.79, -6.195], [106.83, -6.195]]}}
    (tmp_path / "u.geojson").write_text(json.dumps({"features": [unit]}))
    (tmp_path / "r.geojson").write_text(json.dumps({"features": [road]}))
    args = ["sample", "--units", str(tmp_path / "u.geojson"), "--roads", str(tmp_path / "r.geojson"), "--field", "id", "--highways", "primary", "--out", str(tmp_path / "s")]
    assert cli.main(args, spark) == 0
    assert spark.read.parquet(str(tmp_path / "s/points.parquet")).count() in (22, 23)
    (tmp_path / "places.csv").write_text("place_id,bearing,status\np,10,OK\nq,,ZERO_RESULTS\n")
    assert cli.main(["plan-images", "--places", str(tmp_path / "places.csv"), "--out", str(tmp_path / "p")], spark) == 0
    assert sorted(r.heading for r in spark.read.parquet(str(tmp_path / "p/plan.parquet")).collect()) == [100, 280]


def test_yearbook_tables(spark):
    head = ["Kecamatan", "Islam\nMoslem", "d\nHindu\ni", "Jumlah"]
    page = "Jumlah Penduduk Menurut Agama\n"
    tables = {
        ("labelled", 0): [head, ["1. Aek", "5x0", "1", "51"], ["Jumlah/Total", "90", "3", "93"]],
        ("unlabelled", 0): [head, ["A", "40", "2", "42"], ["B", "50", "1", "51"], ["Sambas", "90", "3", "93"]],
        ("summed", 0): [head, ["A", "40", "2", "42"], ["B", "50", "-", "50"]],
        ("nested", 0): [head, ["01. Guguk", "40", "2", "42"], ["1. Tarok", "40", "2", "42"]],
        ("percent", 0): [head, ["1 A", "90,50", "9,50", "100,00"], ["Kota", "80,25", "19,75", "100,00"]],
        ("two", 0): [head, ["A", "1", "2", "3"]], ("two", 1): [head, ["Jumlah", "7", "8", "15"]],
        ("bare", 0): [["Kecamatan", "Luas"], ["A", "5"]], ("empty", 0): [head, ["A", "...", "x", ""]],
    }
    rows = [(book, no, i, cells, page) for (book, no), table in tables.items() for i, cells in enumerate(table)]
    got = yearbook.book_totals(spark.createDataFrame(rows, "book string, table_no int, row_no int, cells array<string>, text string")).collect()
    assert {(r.book, r.outcome, r.religion, r["count"]) for r in got} == {
        ("labelled", "total", "islam", 90.0), ("labelled", "total", "hindu", 3.0), ("unlabelled", "total", "islam", 90.0), ("unlabelled", "total", "hindu", 3.0),
        ("summed", "sum of rows", "islam", 90.0), ("summed", "sum of rows", "hindu", 2.0), ("nested", "nested rows", None, None),
        ("percent", "percent", "islam", 80.25), ("percent", "percent", "hindu", 19.75), ("two", "total", "islam", 7.0), ("two", "total", "hindu", 8.0),
        ("bare", "no religions", None, None), ("empty", "no figures", None, None),
    }


def test_what_services_are_asked():
    assert services.year_calls([120, 121, 122]) == ["120;121", "122"] and services.year_calls([]) == []
    assert services.domain_requests("r", ["11"]) == [{"province_code": "11", "url": "r/domain/type/kabbyprov/prov/1100"}]
    answers = [("11", {"data": [{}, [{"domain_id": 1101, "domain_name": "A"}, {"domain_id": "1100", "domain_name": "Aceh"}, {"domain_id": "1101", "domain_name": "again"}]]}), ("12", {"data": []})]
    assert services.domain_codes(answers) == [{"unit_code": "1101", "unit_name": "A", "province_code": "11"}]
    held, asked = {}, []
    ask = services.cached(lambda url: asked.append(url) or {"ok": len(asked) > 1}, held.get, held.__setitem__, lambda js: js["ok"])
    assert [ask("u")["ok"] for _ in range(3)] == [False, True, True] and asked == ["u", "u"]
