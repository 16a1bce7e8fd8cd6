"""Printed tables: layouts, named columns, placed words, pages, districts' own tables, cubes of several references."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from panelwright.functions import labels
from panelwright.operators import grids, placed
from panelwright.plans import ingest, pages


def html(*rows, tag="td"):
    return "<table>" + "".join("<tr>" + "".join(f"<{tag}>{c}</{tag}>" if not isinstance(c, tuple) else f"<{tag} colspan={c[1]}>{c[0]}</{tag}>" for c in r) + "</tr>" for r in rows) + "</table>"


def religion(spark, page, year=None, province=None):
    df = spark.createDataFrame([("r", year, province, page)], "ref string, year int, province_code string, html string")
    return sorted((r.unit_name, r.level, r.religion, r.year, r["count"]) for r in ingest.religion_tables(df).collect())


def test_sexes_are_added_or_their_total_is_taken(spark):
    two = ["Islam", "Hindu"]
    total = html([("", 1), ("Laki-laki / Male", 2), ("Perempuan / Female", 2), ("Jumlah / Total", 2)], ["Regency", *two * 3], ["Cilacap", 1, 2, 3, 4, 40, 60])
    assert [r[2:] for r in religion(spark, total, 2010)] == [("hindu", 2010, 60.0), ("islam", 2010, 40.0)]
    for male, female in (("Laki-laki", "Perempuan"), ("L", "P"), ("Male", "Female")):
        parts = html(["", (male, 2), (female, 2)], ["Regency", *two * 2], ["Cilacap", 1, 2, 3, "-"], ["Banyumas", "", "x", 5, 7])
        assert [(r[0], *r[2:]) for r in religion(spark, parts)] == [("Banyumas", "hindu", None, 7.0), ("Banyumas", "islam", None, 5.0), ("Cilacap", "hindu", None, 2.0), ("Cilacap", "islam", None, 4.0)]
    none = html(["Regency", *two * 3], ["Cilacap", 1, 2, 3, 4, 40, 60])
    assert [r[2:] for r in religion(spark, none)] == [("hindu", None, 60.0), ("islam", None, 40.0)]
    years = html(["Kabupaten", ("2019", 2), ("2020", 2)], ["", *two * 2], ["Cilacap", 100, 10, 110, 11])
    assert [r[2:] for r in religion(spark, years)] == [("hindu", 2019, 10.0), ("hindu", 2020, 11.0), ("islam", 2019, 100.0), ("islam", 2020, 110.0)]
    below = html(["Kabupaten", ("Islam", 2), ("Konghucu", 2)], ["", 2019, 2020, 2019, 2020], ["Sambas", 1, 2, 30, 40])
    assert [r[2:] for r in religion(spark, below)] == [("islam", 2019, 1.0), ("islam", 2020, 2.0), ("konghucu", 2019, 30.0), ("konghucu", 2020, 40.0)]


def test_tables_on_their_side_and_shifted_rows(spark):
    side = html(["Agama", "Laki-laki", "Perempuan", "Jumlah"], ["Islam", 100, 110, 210], ["Khong Hu Chu", 3, 4, 7], ["Jumlah", 103, 114, 217])
    got = {(r[0], r[2]): r[4] for r in religion(spark, side)}
    assert got["__PROVINCE__", "konghucu"] == 7 and got["Laki-laki", "konghucu"] == 3 and got["Perempuan", "total"] == 114
    shifted = html(["Kode", "Wilayah", "Islam", "Hindu"], ["01", "Nias", 5, 6], ["Jumlah / Total", 5, 6])
    assert [(r[0], r[2], r[4]) for r in religion(spark, shifted)] == [("Nias", "hindu", 6.0), ("Nias", "islam", 5.0), ("__PROVINCE__", "hindu", 6.0), ("__PROVINCE__", "islam", 5.0)]


def test_sub_headings_notes_and_provinces(spark):
    page = html(
        [("Penduduk 2021", 3)], ["Kabupaten/Kota", "Islam", "Khonghucu"], ["Kabupaten", "", ""], ["01 N i a s", "1 672", 0], ["Kota", "", ""], ["75 M e d a n", "1 743 292", 285], ["Sumatera Utara", "10 064 383", 738],
        ["Jumlah 2018", 1, 2], ["Persentase", 99, 1], ["Tahun", 2019, 2020], [("Sumber: Kementerian Agama", 3)],
    )
    got = {(r[0], r[2]): (r[1], r[4]) for r in religion(spark, page, 2021, "12")}
    assert got == {
        ("01 N i a s", "islam"): ("kabupaten", 1672.0), ("01 N i a s", "konghucu"): ("kabupaten", 0.0), ("75 M e d a n", "islam"): ("kota", 1743292.0), ("75 M e d a n", "konghucu"): ("kota", 285.0),
        ("__PROVINCE__", "islam"): ("kota", 10064383.0), ("__PROVINCE__", "konghucu"): ("kota", 738.0),
    }


def test_pages_without_tables(spark):
    for page in (None, "", "x", "<table></table>", html(["a"]), html(["Islam", "Hindu"]), html(["Unit", "Islam"], ["A", 1])):
        assert religion(spark, page) == []


def test_named_columns(spark):
    page = (
        "<table><thead><tr><th rowspan=2></th><th colspan=2>Agama</th></tr><tr><th>Islam</th><th>Islam</th></tr></thead><tr><td>A</td><td>1</td><td>2</td></tr></table>"
        "<table><tr><td>n</td><td></td></tr><tr><td>B</td><td>3</td></tr></table>"
    )
    df = spark.createDataFrame([("p", page), ("q", None)], "ref string, html string")
    got = grids.html_tables(df, "html").collect()
    assert [(r.ref, r.table_idx, r.names, r.rows) for r in got] == [("p", 0, ["col0", "Agama | Islam", "Agama | Islam.1"], [["A", "1", "2"]]), ("p", 1, ["n", "col1"], [["B", "3"]])]
    wide = grids.html_tables(df, "html", ["col0", "col1"]).collect()
    assert [tuple(r) for r in wide] == [("p", 0, 0, "A", None), ("p", 1, 0, None, "3")]
    spark.udtf.register("html_tables", grids.HtmlTables)
    df.createOrReplaceTempView("some_pages")
    assert spark.sql("SELECT ref, n FROM some_pages, LATERAL html_tables(html, 'n')").collect()[0].n == "B"
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT * FROM some_pages, LATERAL html_tables(html, ref)")


def brute_lines(tops, tolerance):
    out, start = {}, None
    for t in sorted(set(tops)):
        if start is None or t - start > tolerance:
            start, n = t, len(set(out.values()))
        out[t] = n
    return out


def test_lines_are_measured_from_their_first_word(spark):
    rng = random.Random(5)
    words = [(p, f"w{i}", float(i), i + 5.0, round(rng.uniform(0, 60), 1)) for p in ("a", "b") for i in range(40)]
    df = spark.createDataFrame([*words, (None, "x", 0.0, 1.0, 1.0), ("a", None, 0.0, 1.0, 1.0)], "page string, text string, x0 double, x1 double, top double")
    got = {(r.page, r.text): r.line for r in placed.lines_of(df, ["page"]).collect()}
    want = {p: brute_lines([w[4] for w in words if w[0] == p], 3.0) for p in ("a", "b")}
    assert got == {(w[0], w[1]): want[w[0]][w[4]] for w in words}


def test_borderless_table(spark):
    lines = [
        (100, [(40, "Kecamatan"), (200, "Islam"), (260, "Protestan"), (330, "Katolik"), (400, "Hindu"), (460, "Budha"), (520, "Lainnya")]), (101, [(200, "(2)"), (260, "(3)")]),
        (120, [(40, "Selakau"), (200, "33"), (215, "657"), (262, "198"), (330, "122"), (402, "-"), (460, "4"), (475, "105"), (522, "278")]), (121, [(150, "b")]), (140, [(520, "7")]),
    ]
    words = [("p", text, float(x), float(x + 6 * len(text)), float(top)) for top, items in lines for x, text in items] + [("q", "Islam", 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(words, "page string, text string, x0 double, x1 double, top double")
    got = [r.cells for r in placed.rows_of_words(df, ["page"], labels.canonical_religion, heading="Kecamatan").orderBy("page", "row_no").collect()]
    assert got == [["Kecamatan", "islam", "kristen", "katolik", "hindu", "buddha", "lainnya"], ["Selakau b", "33 657", "198", "122", "-", "4 105", "278"]]


def cells_of(spark, tables):
    rows = [("bk", page, no, i, row) for page, no, grid in tables for i, row in enumerate(grid)]
    return spark.createDataFrame(rows, "book string, page int, table_no int, row_no int, cells array<string>")


HEAD = ["Kecamatan", "Islam", "Protestan", "Katolik", "Hindu"]


def test_chains_end_at_the_total(spark):
    one = [HEAD, ["(1)", "(2)", "(3)", "(4)", "(5)"], ["01. Semau", "-", "11.175", "374", "-"], ["02. Kupang Barat", "1.212", "26.714", "932", "-"]]
    two = [["03. Takari", "680", "19.199", "1.954", "-"], ["Kabupaten Kupang", "1.892", "57.088", "3.260", "-"]]
    three = [["99. Other", "1", "2", "3", "4"]]
    other = [["Partai", "Islam", "Katolik", "Kristen", "Hindu"], ["PDI", "1", "-", "-", "-"]]
    got = pages.chained(cells_of(spark, [(7, 0, one), (8, 0, two), (9, 0, three), (20, 0, one), (22, 0, two), (30, 0, one), (31, 0, other)])).orderBy("page", "row_no").collect()
    labels_ = {}
    for r in got:
        labels_.setdefault((r.page, r.pages), []).append(r.cells[0])
    # the page with the total ends the first table; a gap of a page parts the second; another order of names the third
    assert labels_ == {(7, 2): ["01. Semau", "02. Kupang Barat", "03. Takari", "Kabupaten Kupang"], (20, 1): ["01. Semau", "02. Kupang Barat"], (30, 1): ["01. Semau", "02. Kupang Barat"], (31, 1): ["PDI"]}


def test_at_most_three_pages_and_the_longest_table(spark):
    page = lambda k: [HEAD, [f"{k} a", "1", "2", "3", "4"], [f"{k} b", "5", "6", "7", "8"]]
    tables = [(k, 0, [HEAD, ["short", "9", "9", "9", "9"]]) for k in range(1, 6)] + [(k, 1, page(k)) for k in range(1, 6)]
    got = pages.chained(cells_of(spark, tables)).collect()
    assert {r.page for r in got} == {1} and max(r.pages for r in got) == 3 and "short" not in {r.cells[0] for r in got} and len(got) == 6


def test_facing_columns(spark):
    left = [[None, None, "Islam", "Kristen", "Katholik"], ["010. Bandar", "52.604", "52.551", "43", "7"], ["060. Mojowarno", "99.451", "96.272", "3.093", "65"], ["130. Jombang", "143.301", "137.663", "3.864", "1.009"], ["Kabupaten Jombang", "295.356", "286.486", "7.000", "1.081"]]
    right = [["Kecamatan", "Hindu", "Budha", "Khonghucu"], ["010. Bandar", "1", "2", "-"], ["060. Mojowarno", "5", "16", "-"], ["Kabupaten Jombang", "26", "718", "45"]]
    cells = cells_of(spark, [(1, 0, left), (2, 0, right), (5, 0, left), (6, 0, right[:3])])
    tables, pairs = pages.facing_columns(pages.chained(cells), cells)
    assert {(r.page, r.n_rows, r.n_matched, r.accepted) for r in pairs.collect()} == {(1, 4, 3, True), (5, 4, 2, False)}
    got = {(r.page, r.cells[0]): r.cells[5:] for r in tables.where("page in (1, 5)").collect()}
    assert got[1, "Kabupaten Jombang"] == ["26", "718", "45"] and got[1, "130. Jombang"] == [None, None, None] and got[5, "010. Bandar"] == []
    assert pages.joined_tables(cells.withColumn("text", F.lit("t"))).where("table_no = 1 and row_no = 0").first().cells == [None, None, "Islam", "Kristen", "Katholik", "Hindu", "Budha", "Khonghucu"]


def domain(spark, rows):
    df = spark.createDataFrame([("d", 2020, u, r, c, "Sambas") for u, r, c in rows], "k string, year int, unit string, religion string, count double, title string")
    return sorted((r.unit, r.religion, r["count"], r.level, r.how) for r in ingest.domain_rows(df, ["k"], "unit", "title").collect())


def test_district_totals(spark):
    parts = [("Aek", "islam", 10.0), ("Bah", "islam", 20.0), ("Aek", "hindu", 1.0)]
    kec = [("Aek", "hindu", 1.0, "kecamatan", None), ("Aek", "islam", 10.0, "kecamatan", None), ("Bah", "islam", 20.0, "kecamatan", None)]
    assert domain(spark, parts) == sorted([*kec, ("Sambas", "hindu", 1.0, "kabupaten", "sum"), ("Sambas", "islam", 30.0, "kabupaten", "sum")], key=lambda r: (r[0], r[1]))
    assert ("Sambas", "islam", 99.0, "kabupaten", "label") in domain(spark, [*parts, ("Jumlah", "islam", 99.0), ("Total", "islam", 98.0)])
    assert ("Sambas", "islam", 30.0, "kabupaten", "equals rest") in domain(spark, [*parts, ("2020", "islam", 30.0)])
    # a name serves only where it dominates: half as much again as the next
    assert ("Sambas", "islam", 31.0, "kabupaten", "name") in domain(spark, [*parts, ("Kab. Sambas", "islam", 31.0)])
    assert ("Kota Sambas", "islam", 29.0, "kecamatan", None) in domain(spark, [*parts, ("Kota Sambas", "islam", 29.0)])


def cube(units, categories, cells, years=(("120", "2020"),)):
    entry = lambda xs: [{"val": v, "label": x} for v, x in xs]
    return json.dumps({"vervar": entry(units), "var": entry([("9", "Penduduk")]), "turvar": entry(categories), "tahun": entry(years), "turtahun": entry([("0", "")]), "datacontent": cells})


def test_population_cube_by_cube(spark):
    unit = [("1", "1271 Sibolga")]
    both = cube(unit, [("1", "Laki-laki"), ("2", "Perempuan")], {"1911200": 44.0, "1921200": 46.0})
    rows = [
        ("a", both), ("b", both), ("c", cube(unit, [("1", "Laki-laki"), ("2", "Perempuan"), ("3", "L+P")], {"1911200": 1.0, "1921200": 2.0, "1931200": 90.0})),
        ("d", cube(unit, [("1", "Perkotaan"), ("2", "Perdesaan")], {"1911200": 1.0, "1921200": 2.0})), ("e", cube(unit, [("1", "Laki-laki"), ("2", "Perempuan")], {"1911200": 44.0})),
        ("f", cube([("1", "Sumatera Selatan"), ("2", "Bengkulu"), ("3", "1671 Palembang"), ("4", "Nias"), ("5", "1600 Sumsel")], [], {"190" + "1200": 1.0, "2901200": 2.0, "3901200": 3.0, "4901200": 4.0, "5901200": 5.0})), ("g", None), ("h", "{}"),
    ]
    df = spark.createDataFrame(rows, "ref string, js string").withColumns({"province_code": F.lit("16"), "unit": F.when(F.col("ref") == "b", "Ribu").otherwise("Jiwa")})
    got = sorted((r.ref, r.unit_code or "", r.unit_name, r.year, r.population) for r in ingest.population_of(df, "js").collect())
    assert got == [("a", "1271", "1271 Sibolga", 2020, 90.0), ("b", "1271", "1271 Sibolga", 2020, 90000.0), ("c", "1271", "1271 Sibolga", 2020, 90.0), ("f", "", "Nias", 2020, 4.0), ("f", "1671", "1671 Palembang", 2020, 3.0)]


def test_compatibility_forms(spark):
    points = [chr(p) for low, high in labels._BLOCKS for p in range(low, high) if unicodedata.category(chr(p)) not in ("Cn", "Co")]
    rows = [(c, "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))) for c in [*points, "ﬁn Ｉｓｌａｍ Ⅻ é́ 𠀀🙂", "plain", ""]]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", labels.strip_accents("a").alias("c")).where("not (b <=> c)").collect()
    assert [(r.a, r.b, r.c) for r in got] == []
