"""Outlines, files of unknown kind, titles, and the commands that report."""

import json

from pyspark.sql import functions as F

from panelwright import cli
from panelwright.operators import outline
from panelwright.plans import ingest, yearbook
from panelwright.sources import readers
from panelwright.streaming import incremental


def test_parents_are_the_last_smaller_level(spark):
    levels = [1, 2, 3, 3, 2, 3, 1, 3, None, 2]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(levels)], "t string, row_no int, level int")
    got = {r.row_no: r.parent for r in outline.outline(df, ["t"], "row_no", "level", 3).collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 1, 4: 0, 5: 4, 6: None, 7: 6, 8: None, 9: 6}


def book(spark, rows):
    head = ["Kecamatan", "Islam", "Hindu", "Budha"]
    return spark.createDataFrame([("b", 0, i, r, "agama") for i, r in enumerate([head, *rows])], "book string, table_no int, row_no int, cells array<string>, text string")


def test_two_levels_are_added_up_once(spark):
    rows = [["01. GUGUK", "30", "3", "4"], ["1. Tarok", "10", "1", "1"], ["2. Bukik", "20", "2", "3"], ["02. AUR", "5", "5", "5"], ["1. Birugo", "5", "5", "5"]]
    got = {(r.outcome, r.religion): r["count"] for r in yearbook.book_totals(book(spark, rows), nested_sums=True).collect()}
    assert got == {("sum of top rows", "islam"): 35.0, ("sum of top rows", "hindu"): 8.0, ("sum of top rows", "buddha"): 9.0}
    wrong = [["01. GUGUK", "30", "3", "9"], *rows[1:]]
    assert [(r.outcome, r.religion) for r in yearbook.book_totals(book(spark, wrong), nested_sums=True).collect()] == [("nested rows", None)]
    assert [(r.outcome, r.religion) for r in yearbook.book_totals(book(spark, rows)).collect()] == [("nested rows", None)]
    total = [*rows, ["Jumlah / Total", "35", "8", "9"]]
    assert {r.outcome for r in yearbook.book_totals(book(spark, total)).collect()} == {"total"}


def test_files_of_unknown_kind(spark, tmp_path):
    # a byte of Latin-1 far behind the head, and several files of several kinds
    (tmp_path / "a.csv").write_bytes(b"name;n\n" + b"x;1\n" * 30_000 + "Pér;2\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("﻿name,n\nÜ,3\n".encode())
    (tmp_path / "c.json").write_text(json.dumps([{"name": "j", "more": {"k": 1}}]))
    got = readers.read_tabular(spark, f"{tmp_path}/*").where("name <> 'x'").collect()
    assert sorted((r.name, r.n, r["more.k"]) for r in got) == [("Pér", "2", None), ("j", None, 1), ("Ü", "3", None)]
    xml = "<codeBook xmlns='x'><var ID='{0}'><catgry><catValu>1</catValu><labl>One</labl></catgry></var></codeBook>"
    (tmp_path / "v.xml").write_text(xml.format("V"))
    (tmp_path / "w.xml").write_text(xml.format("W"))
    assert sorted(tuple(r) for r in readers.read_codebook(spark, f"{tmp_path}/*.xml").collect()) == [("V", "1", "One"), ("W", "1", "One")]


def test_empty_is_not_failed(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "s string")
    got = incremental.outcome(df, F.col("s").try_cast("int"), "n", F.col("s")).collect()
    assert [tuple(r) for r in got] == [("1", 1, "ok"), ("x", None, "failed"), (None, None, "empty")]


def test_names_and_years_of_books(spark):
    names = ["Kota Kupang Kupang Municipality", "Kota Bitung/ Bitung Municipality", "Kabupaten Rote Ndao Rote Ndao", "Sambas", "", None, "Kota Kota"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(ingest.clean_unit_name(F.col("n"))).collect()]
    assert got == ["Kota Kupang", "Kota Bitung", "Kabupaten Rote Ndao", "Sambas", "", None, "Kota Kota"]
    titles = ["Agama yang\nDianut di Kota X, 2022 dan 2023", "by Religion and Sex, 2021", "Penduduk 2020", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(ingest.year_from_title(F.col("t"), F.lit(1999))).collect()]
    assert got == [2022, 2021, 1999, 1999]
    listed = spark.createDataFrame([("1", "a", "Dalam Angka 2023", 1), ("1", "a", "Kota X Dalam Angka 2023", 2), ("1", "b", "Dalam Angka 2019", 1), ("2", "c", "Statistik 2023", 1), ("2", "d", None, 1)], "domain string, pub_id string, title string, batch int")
    assert [r.title for r in ingest.publications(listed, [2023, 2024], "dalam ANGKA").collect()] == ["Kota X Dalam Angka 2023"]


def test_reporting_commands(spark, tmp_path):
    out = lambda name: spark.read.parquet(f"{tmp_path}/o/{name}.parquet")
    (tmp_path / "panel.csv").write_text("unit_code,year,konghucu,total_to_pop\n1101,2021,5,1.0\n1101,2023,6,1.0\n1201,2021,5,1.0\n1301,2021,5,3.0\n1401,2023,7,1\n")
    assert cli.main(["domains", "--panel", f"{tmp_path}/panel.csv", "--base", "2021,2022", "--target", "2023", "--out", f"{tmp_path}/o"], spark) == 0
    assert [r.unit_code for r in out("domains").collect()] == ["1201"]
    absent = {r.province_code for r in out("provinces").collect()}
    assert "15" in absent and not absent & {"11", "12", "13", "14"}
    rows = [["Kecamatan", "Islam", "Hindu", "Budha"], ["Aek", "1", "2", "3"], ["Bah", "10", "20", "30"]], [["Cil", "100", "200", "300"], ["Jumlah", "111", "222", "333"]]
    lines = [{"book": "b", "page": p, "table_no": 0, "row_no": i, "cells": r, "text": "agama"} for p, grid in enumerate(rows, 4) for i, r in enumerate(grid)]
    (tmp_path / "cells.json").write_text("\n".join(map(json.dumps, lines)))
    assert cli.main(["yearbooks", "--cells", f"{tmp_path}/cells.json", "--out", f"{tmp_path}/o"], spark) == 0
    assert {(r.outcome, r.religion, r["count"]) for r in out("yearbooks").collect()} == {("total", "islam", 111.0), ("total", "hindu", 222.0), ("total", "buddha", 333.0)}
    (tmp_path / "x.csv").write_text("GEO2,GEO1,ETH,REL,W\n1,9,2,6,10\n1,9,1,6,30\n")
    cat = lambda var, code, label: f"<var ID='{var}'><catgry><catValu>{code}</catValu><labl>{label}</labl></catgry></var>"
    (tmp_path / "book.xml").write_text("<c>" + cat("ETH", 2, "Chinese") + cat("REL", 6, "Khong Hu Cu") + cat("GEO2", 1, "Kota Sibolga") + cat("GEO1", 9, "Sumatera Utara") + "</c>")
    (tmp_path / "codes.csv").write_text("unit_code,unit_name\n1271,Kota Sibolga\n")
    args = ["census", "--extract", f"{tmp_path}/x.csv", "--codebook", f"{tmp_path}/book.xml", "--unit", "GEO2", "--weight", "W", "--ethnic", "ETH", "--religion", "REL", "--province", "GEO1", "--codes", f"{tmp_path}/codes.csv", "--total", "50"]
    assert cli.main([*args, "--out", f"{tmp_path}/o"], spark) == 0
    row = out("census").first()
    assert (row.unit_code, row["pop"], row.chinese_share, row.konghucu_of_chinese) == ("1271", 40.0, 0.25, 1.0)
