"""Registered queries over labels, numerals, signs, shapes and matching: texts made from a table's rows, answers computed in SQL.

Fixed values, such as lists of patterns and words, are shared with the SQL; how they are applied is written there anew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import CODES, PLACES, query, table
from .functions import geo, labels, numbers, signs
from .operators import spatial
from .plans import detect, ingest, matching


def quoted(text: str | None) -> str:
    """A text as an SQL literal."""
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def sql_list(texts: list) -> str:
    """Texts as an SQL list."""
    return "[" + ", ".join(map(quoted, texts)) + "]"


def pick(texts: list, at: F.Column) -> F.Column:
    """One of some texts, by a number from 0."""
    return F.get(F.array(*[F.lit(t).cast("string") for t in texts]), (at % len(texts)).cast("int"))


def first_pattern(s: str, patterns: list[tuple[str, str]]) -> str:
    """SQL for the name of the first pattern that a label matches. The engine there has no look-ahead: what a pattern must not be followed by is asked apart."""
    cases = []
    for name, pattern in patterns:
        head, _, tail = pattern.partition("(?!")
        more = f" AND (NOT regexp_matches({s}, {quoted(head.rsplit('|', 1)[-1] + tail[:-1])}) OR regexp_matches({s}, {quoted(head.rsplit('|', 1)[0])}))" if tail else ""
        cases.append(f"WHEN regexp_matches({s}, {quoted(head)}){more} THEN {quoted(name)}")
    return "CASE " + " ".join(cases) + " END"


def norm_sql(x: str) -> str:
    """SQL for a normalised label."""
    return f"trim(regexp_replace(lower(strip_accents({x})), '[\\s_.\\-]+', ' ', 'g'))"


LABELS = [
    "Konghucu", "Khonghuchu", "Islam/Moslem", "Kristen Protestan", "Katholik", "Hindu", "Budha", "Buddhist", "Aliran Kepercayaan", "Lainnya", "Jumlah/Total",
    "Kota_Médan", "  KAB.  Deli-Serdang ", "Semester II 2021", "2019 dan 2023", "no year 1899", None,
]


@query(
    "q13_labels",
    f"""
    WITH t AS (SELECT c_custkey AS k, {sql_list(LABELS)}[c_custkey % {len(LABELS)} + 1] || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || (1975 + c_custkey % 80) WHEN 2 THEN '-' || c_mktsegment ELSE '. semester ' || (c_custkey % 3) || ' ' END AS x FROM customer),
    n AS (SELECT k, x, {norm_sql("x")} AS s FROM t)
    SELECT k, x, s AS label, {first_pattern("s", labels.RELIGION_PATTERNS)} AS religion, list_extract(regexp_extract_all(x, '\\b(19[89]\\d|20[0-4]\\d)\\b'), -1)::BIGINT AS year,
      (CASE WHEN regexp_matches(s, 'semester\\s*(ii|2)\\b') AND NOT regexp_matches(s, '^[^s]*semester\\s*(i|1)\\b') THEN 2 WHEN regexp_matches(s, 'semester\\s*(i|1)\\b') THEN 1 END)::BIGINT AS semester
    FROM n
    """,
)
def q13(spark, d):
    """Labels normalised, religions, years and half-years named, a label a customer."""
    k = F.col("c_custkey")
    suffix = F.when(k % 4 == 0, "").when(k % 4 == 1, F.format_string(" %d", 1975 + k % 80)).when(k % 4 == 2, F.concat(F.lit("-"), "c_mktsegment")).otherwise(F.format_string(". semester %d ", k % 3))
    t = table(spark, d, "customer").select(k.alias("k"), F.concat(pick(LABELS, k), suffix).alias("x"))
    return t.select(
        "k", "x", labels.norm_label("x").alias("label"), labels.canonical_religion("x").alias("religion"), labels.year_from_text("x").cast("long").alias("year"), labels.semester_from_text("x").cast("long").alias("semester")
    )


NATIONS = ["Tiongkok", "China (Taiwan)", "Hong Kong SAR", "Rep. Rakyat China", "Korea Utara", "Korea Selatan", "Korea", "Jepang/Japan", "Lainnya", "Jumlah", "ITAS", "KITAP", "Kantor Imigrasi Kelas I TPI Medan", "2021", "Tahun 2019", "xyz", None]


@query(
    "q13c_header_roles",
    f"""
    WITH t AS (SELECT c_custkey, {sql_list(NATIONS)}[c_custkey % {len(NATIONS)} + 1] AS b FROM customer), x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN upper(b) WHEN 2 THEN ' ' || b || '_' WHEN 3 THEN b || ' ' || c_custkey % 9 ELSE b END AS x FROM t),
    n AS (SELECT *, {norm_sql("x")} AS s FROM x),
    p AS (SELECT *, {first_pattern("s", labels.NATIONALITY_PATTERNS)} AS nation, {first_pattern("s", labels.PERMIT_PATTERNS)} AS permit, list_extract(regexp_extract_all(s, '\\b(19[89]\\d|20[0-4]\\d)\\b'), -1) AS y FROM n),
    r AS (SELECT *, CASE WHEN nation = 'TOTAL' THEN 'total' WHEN nation IS NOT NULL AND nation <> 'OTHER' THEN 'nationality' WHEN y IS NOT NULL AND regexp_matches(s, '^(tahun\\s*)?\\d{{4}}(\\s*\\(\\w+\\))?$') THEN 'year'
      WHEN regexp_matches(s, 'kantor imigrasi|kanim\\b|kelas [i]+ ') THEN 'kanim' WHEN permit IS NOT NULL THEN 'permit' WHEN nation = 'OTHER' THEN 'nationality' ELSE 'other' END AS role FROM p)
    SELECT c_custkey, x, role, CASE role WHEN 'total' THEN 'TOTAL' WHEN 'nationality' THEN nation WHEN 'year' THEN y WHEN 'kanim' THEN s WHEN 'permit' THEN permit END AS value,
      trim(regexp_replace(regexp_replace(s, 'kantor imigrasi|kanim|kelas i+\\b|khusus|tpi|non tpi', ' ', 'g'), '\\s+', ' ', 'g')) AS office,
      CASE WHEN s IS NULL THEN NULL WHEN regexp_matches(s, 'hong\\s*kong') THEN 'hong_kong' WHEN regexp_matches(s, 'taiwan|taipei') THEN 'other' WHEN regexp_matches(s, 'tiongkok|\\bchina\\b|\\bcina\\b|\\brrt\\b') THEN 'china' ELSE 'other' END AS country_group
    FROM r
    """,
)
def q13c(spark, d):
    """Roles of header labels, a label a customer: nation, permit, year, office, total."""
    k, b = F.col("c_custkey"), pick(NATIONS, F.col("c_custkey"))
    x = F.when(k % 4 == 1, F.upper(b)).when(k % 4 == 2, F.concat(F.lit(" "), b, F.lit("_"))).when(k % 4 == 3, F.concat(b, F.format_string(" %d", k % 9))).otherwise(b)
    t = table(spark, d, "customer").select(k, x.alias("x"))
    role = labels.header_role("x")
    return t.select("c_custkey", "x", role["role"].alias("role"), role["value"].alias("value"), labels.norm_kanim("x").alias("office"), labels.country_group("x").alias("country_group"))


UNITS = ["Kab. Deli Serdang", "KOTA MEDAN", "2. Bulungan *)", "<b>Kota Administrasi</b> Jakarta Pusat", "Labuan Batu", "Pangkep", "SP 2010", "Sumber: BPS", "3308 Kabupaten Magelang", "Batu Kota", "-"]


@query(
    "q13d_unit_names",
    f"""
    WITH t AS (SELECT c_custkey, {sql_list(UNITS)}[c_custkey % {len(UNITS)} + 1] AS b FROM customer), x AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN (c_custkey % 40) || ' ' || b WHEN 2 THEN b || ' ' || chr((97 + c_custkey % 26)::INT) ELSE b END AS x FROM t),
    n AS (SELECT *, regexp_replace(x, '<[^>]+>', '', 'g') AS y FROM x), s AS (SELECT *, {norm_sql("y")} AS s FROM n),
    a AS (SELECT *, regexp_replace(s, '^\\d+\\s*', '') AS bare FROM s),
    m AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(bare, '^(kabupaten|kab|kota adm|kota administrasi|kota|kotamadya)\\s+', ''), '\\s*[*)(\\]\\[/]+\\s*$', ''), '\\s+(kab|kabupaten|kota|regency|municipality)$', '')) AS name FROM a)
    SELECT c_custkey, x, name, coalesce(map_extract(MAP {{{", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in labels.UNIT_ALIASES.items())}}}, replace(name, ' ', ''))[1], replace(name, ' ', '')) AS key,
      CASE WHEN regexp_matches(bare, '^kota') THEN 'kota' WHEN regexp_matches(bare, '^(kabupaten|kab\\b)') THEN 'kabupaten' ELSE 'unknown' END AS level,
      regexp_matches(s, '[a-z]') AND length(s) <= 45 AND NOT regexp_matches(s, '^(sp|sensus|supas|susenas)\\s?\\d{{4}}$') AND NOT regexp_matches(s, 'sumber|source|catatan|note|keterangan|population by|penduduk .* menurut|jumlah penduduk') AS is_unit
    FROM m
    """,
)
def q13d(spark, d):
    """Unit names, keys, levels, and whether a label is a unit at all, a label a customer."""
    k, b = F.col("c_custkey"), pick(UNITS, F.col("c_custkey"))
    x = F.when(k % 3 == 1, F.concat(F.format_string("%d ", k % 40), b)).when(k % 3 == 2, F.concat(b, F.lit(" "), F.char((97 + k % 26).cast("int")))).otherwise(b)
    t = table(spark, d, "customer").select(k, x.alias("x"))
    return t.select("c_custkey", "x", labels.norm_unit_name("x").alias("name"), labels.unit_key("x").alias("key"), labels.unit_level("x").alias("level"), labels.is_unit_name("x").alias("is_unit"))


NUMERALS = ["-", "–", "", "...", "n.a.", "abc", "1.2.34", "12 345", "-5", None, "(1.000)"]


@query(
    "q14_numerals",
    f"""
    WITH p AS (SELECT p_partkey AS k, p_size AS a, lpad(((p_retailprice * 100)::BIGINT % 1000)::VARCHAR, 3, '0') AS c FROM part),
    t AS (SELECT k, CASE k % 7 WHEN 0 THEN {sql_list(NUMERALS)}[k // 7 % {len(NUMERALS)} + 1] WHEN 1 THEN a || '.' || c WHEN 2 THEN a || ',' || c WHEN 3 THEN a || '.' || c || ',' || k % 10 WHEN 4 THEN a || ',' || k % 100 WHEN 5 THEN a || '.' || k % 100 ELSE ' ' || a || '.' || c || '.' || c || ' jiwa' END AS x FROM p),
    n AS (SELECT k, x, regexp_replace(trim(x), '[^0-9,.\\-]', '', 'g') AS s FROM t)
    SELECT k, x, CASE WHEN trim(x) IN ('-', '–', '—') THEN 0 WHEN trim(x) IN ('', 'nan', 'None', 'n.a.', 'na', 'NA', '...') OR s IN ('', '-') THEN NULL
      WHEN contains(s, ',') AND contains(s, '.') THEN try_cast(replace(replace(s, '.', ''), ',', '.') AS DOUBLE)
      WHEN contains(s, '.') THEN try_cast(CASE WHEN regexp_matches(s, '^[^.]*(\\.[^.]{{3}})+$') THEN replace(s, '.', '') ELSE s END AS DOUBLE)
      WHEN contains(s, ',') THEN try_cast(CASE WHEN regexp_matches(s, '^[^,]*(,[^,]{{3}})+$') THEN replace(s, ',', '') ELSE replace(s, ',', '.') END AS DOUBLE)
      ELSE try_cast(s AS DOUBLE) END AS n FROM n
    """,
)
def q14(spark, d):
    """Numerals with either separator, grouped or decimal, marks and blanks: a numeral a part."""
    k, a, c = F.col("p_partkey"), F.col("p_size"), F.lpad((F.round(F.col("p_retailprice") * 100).cast("long") % 1000).cast("string"), 3, "0")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    x = (
        F.when(k % 7 == 0, pick(NUMERALS, F.floor(k / 7))).when(k % 7 == 1, text(a, ".", c)).when(k % 7 == 2, text(a, ",", c)).when(k % 7 == 3, text(a, ".", c, ",", k % 10))
        .when(k % 7 == 4, text(a, ",", k % 100)).when(k % 7 == 5, text(a, ".", k % 100)).otherwise(text(" ", a, ".", c, ".", c, " jiwa"))
    )
    return table(spark, d, "part").select(k.alias("k"), x.alias("x")).select("k", "x", numbers.parse_count("x", dash_zero=True).alias("n"))


HAN = ["觀音佛堂", "兰州拉面", "你好", "蘭州會館", "中国银行", "abc", "火鍋 2", "孔教", "华人社", ""]
LATIN = ["Toko Jaya", "Bakmi Enak", "Beijing Zhongguo", None, "PT 12", "Shanghai"]


def scored_sql(text: str, script: str, beside: str) -> str:
    """SQL for the points of a sign, given the name of its text, its script and the list of the other texts."""
    simple = lambda x: f"translate({x}, '{signs.TRADITIONAL}', '{signs.SIMPLIFIED}')"
    has = lambda words: f"len(list_filter({sql_list(words)}, lambda w: contains({simple(text)}, {simple('w')}))) > 0"
    tokens = f"list_transform(flatten(list_transform({beside}, lambda t: regexp_extract_all(coalesce(t, ''), '[A-Za-zÀ-ÿ]+'))), lambda w: lower(w))"
    among = lambda words: f"len(list_filter({tokens}, lambda w: list_contains({sql_list(words)}, w))) > 0"
    long_ = f"list_filter({tokens}, lambda w: length(w) >= 4)"
    pinyin = f"(len({long_}) > 0 AND NOT {among(signs.INDONESIAN_WORDS)} AND len(list_filter({long_}, lambda w: NOT regexp_matches(w, {quoted('(?i)' + signs.PINYIN)}))) = 0)"
    point = lambda cond, p: f"CASE WHEN {cond} THEN {p} ELSE 0 END"
    return " + ".join([
        point(among(signs.INDONESIAN_WORDS), 1), point(among(signs.LOANWORDS), 1), point(pinyin, -0.5), point(f"{script} = 'traditional'", 1), point(f"{script} = 'simplified'", -0.5),
        point(has(signs.MAINLAND_CJK), -2), point(has(signs.LOCAL_CJK), 2),
    ])


SIGNS_SQL = f"SELECT p_partkey AS k, {sql_list(HAN)}[p_partkey % {len(HAN)} + 1] AS text, ['traditional', 'simplified', 'unknown', ''][p_partkey // 3 % 4 + 1] AS hint, [p_name, {sql_list(LATIN)}[p_partkey // 7 % {len(LATIN)} + 1]] AS beside FROM part"


def sign_rows(spark, d):
    """A sign a part: its text, the script that a detector hints at, and the texts beside it, its part's name among them."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("k"), pick(HAN, k).alias("text"), pick(["traditional", "simplified", "unknown", ""], F.floor(k / 3)).alias("hint"), F.array("p_name", pick(LATIN, F.floor(k / 7))).alias("beside")
    )


@query(
    "q15_sign_scores",
    f"""
    WITH t AS ({SIGNS_SQL}), s AS (SELECT *, {scored_sql("text", "hint", "beside")} AS score FROM t)
    SELECT k, len(regexp_extract_all(text, '[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}]'))::INT AS n_cjk, CASE WHEN score >= 1 THEN 'local' WHEN score <= -1 THEN 'mainland' ELSE 'ambiguous' END AS sign_type, score::DOUBLE AS sign_score FROM s
    """,
)
def q15(spark, d):
    """Sign texts scored with their script and the Latin texts beside them, a sign a part."""
    s = signs.score_sign(F.col("text"), F.col("hint"), F.col("beside"))
    return sign_rows(spark, d).select("k", signs.count_cjk(F.col("text")).alias("n_cjk"), s["sign_type"].alias("sign_type"), s["sign_score"].alias("sign_score"))


@query(
    "q37_sign_chain",
    f"""
    WITH t AS ({SIGNS_SQL}), b AS (SELECT *, k % 50 AS image, len(regexp_extract_all(text, '[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}]')) AS n FROM t),
    o AS (SELECT image, list(text) FILTER (n = 0) AS other FROM b GROUP BY image),
    s AS (SELECT b.image, n, {scored_sql("text", "coalesce(nullif(hint, ''), 'unknown')", "coalesce(other, [])")} AS score FROM b JOIN o USING (image))
    SELECT image, count(*) FILTER (n > 0 AND score >= 1) AS n_local_boxes, count(*) FILTER (n > 0 AND score <= -1) AS n_mainland_boxes, count(*) FILTER (n > 0 AND abs(score) < 1) AS n_ambiguous_boxes FROM s GROUP BY image
    """,
)
def q37(spark, d):
    """Boxes to characters, scripts and sign types by the texts beside them, counted an image: signs of parts, fifty images."""
    rows = sign_rows(spark, d).select((F.col("k") % 50).alias("path"), "text", F.lit(0.9).alias("conf"), F.lit("0,0;4,0;4,2;0,2").alias("bbox"), F.col("hint").alias("script_hint"))
    out = detect.type_counts(rows.select("path").distinct(), detect.classify_boxes(detect.describe_boxes(rows)))
    return out.withColumnRenamed("path", "image")


@query(
    "q16b_polygons",
    """
    WITH p AS (SELECT p_partkey AS k, (p_size % 9 + 1)::DOUBLE AS w, (p_partkey % 7 + 1)::DOUBLE AS h, (p_partkey % 5)::DOUBLE AS dx, (p_partkey % 3)::DOUBLE AS dy FROM part),
    i AS (SELECT *, greatest(0, w - dx) * greatest(0, h - dy) AS meet FROM p)
    SELECT k, w * h AS area, w * h / 2 AS half, round(meet / (2 * w * h - meet), 4) AS iou FROM i
    """,
)
def q16b(spark, d):
    """Areas of polygons in text form, and the overlap of their hulls with a shifted copy: a rectangle and its half a part."""
    k, w, h = F.col("p_partkey"), F.col("p_size") % 9 + 1, F.col("p_partkey") % 7 + 1
    box = lambda x, y: F.format_string("%d,%d;%d,%d;%d,%d;%d,%d", x, y, x + w, y, x + w, y + h, x, y + h)
    zero = F.lit(0).cast("long")
    t = table(spark, d, "part").select(k.alias("k"), box(zero, zero).alias("a"), box(k % 5, k % 3).alias("b"), F.format_string("0,0;%d,0;0,%d", w, h).alias("c"))
    a, b, c = (geo.parse_polygon(x) for x in "abc")
    return t.select("k", geo.polygon_area(a).alias("area"), geo.polygon_area(c).alias("half"), F.round(geo.hull_iou(a, b), 4).alias("iou"))


@query(
    "q16e_holes",
    """
    WITH p AS (SELECT c_custkey AS id, (c_custkey % 100)::DOUBLE / 10 + 0.05 AS x, ((c_custkey // 7) % 100)::DOUBLE / 10 + 0.05 AS y FROM customer),
    u AS (SELECT s_suppkey AS unit, (s_suppkey % 6)::DOUBLE AS x0, (s_suppkey % 5)::DOUBLE AS y0, (s_suppkey % 3 + 2)::DOUBLE AS w FROM supplier)
    SELECT unit, count(*) AS n FROM p JOIN u ON (x > x0 AND x < x0 + w AND y > y0 AND y < y0 + w AND NOT (x > x0 + 0.5 AND x < x0 + 1.5 AND y > y0 + 0.5 AND y < y0 + 1.5)) OR (x > x0 + 5 AND x < x0 + 6 AND y > y0 + 5 AND y < y0 + 6) GROUP BY unit
    """,
)
def q16e(spark, d):
    """Customers' points in suppliers' polygons, each a square with a hole and a further part."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, d, "customer").select(c.alias("id"), ((c % 100).cast("double") / 10 + 0.05).alias("x"), ((F.floor(c / 7) % 100).cast("double") / 10 + 0.05).alias("y"))
    x0, y0, w = (s % 6).cast("double"), (s % 5).cast("double"), (s % 3 + 2).cast("double")
    square = lambda x, y, size: F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + size, y), (x + size, y + size), (x, y + size))])
    units = table(spark, d, "supplier").select(s.alias("unit"), F.array(square(x0, y0, w), square(x0 + 0.5, y0 + 0.5, F.lit(1.0)), square(x0 + 5, y0 + 5, F.lit(1.0))).alias("rings"))
    return spatial.counts_in_polygons(points, units, "unit", "rings", cell=1.0)


@query(
    "q40_open_data",
    """
    SELECT 'n' || c_nationkey AS region_name, CASE c_custkey % 3 WHEN 0 THEN 'CHN' WHEN 1 THEN 'JPN' ELSE 'TOTAL' END AS nationality, 'TKA' AS permit_type, (1000 + c_custkey % 900)::DOUBLE AS "count", (2015 + c_custkey % 8)::BIGINT AS year FROM customer WHERE c_custkey % 4 <> 3
    UNION ALL SELECT 's' || s_nationkey, v.n, NULL, CASE v.n WHEN 'CHN' THEN s_suppkey * 3 ELSE s_suppkey % 50 END, 2022 FROM supplier, (VALUES ('CHN'), ('PHL')) v(n) WHERE v.n = 'CHN' OR s_suppkey % 2 = 0
    """,
)
def q40(spark, d):
    """Open-data tables, long with a column of nations and wide with nations as columns, by the roles of their headers."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    long = table(spark, d, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("Provinsi"), F.when(k % 4 == 3, "xyz").otherwise(pick(["Tiongkok", "Jepang", "Jumlah"], k)).alias("Negara Asal"), F.format_string("Tahun %d", 2015 + k % 8).alias("Tahun"),
        F.format_string("1.%03d", k % 900).alias("Jumlah TKA"), F.lit("TKA").alias("Jenis Izin"),
    )
    wide = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("Kabupaten/Kota"), (s * 3).cast("string").alias("Tiongkok"), F.when(s % 2 == 0, (s % 50).cast("string")).alias("Filipina"), F.lit("2022").alias("Tahun"))
    both = ingest.open_data_to_long(long, "ckan").unionByName(ingest.open_data_to_long(wide, "ckan"))
    return both.select("region_name", "nationality", "permit_type", "count", F.col("year").cast("long").alias("year"))


def bare_sql(x: str) -> str:
    """SQL for a normalised label without markup and the number before it."""
    return f"regexp_replace({norm_sql(f"regexp_replace({x}, '<[^>]+>', '', 'g')")}, '^\\d+\\s*', '')"


def unit_key_sql(x: str) -> str:
    """SQL for the key that unit names are matched by."""
    name = f"trim(regexp_replace(regexp_replace(regexp_replace({bare_sql(x)}, '^(kabupaten|kab|kota adm|kota administrasi|kota|kotamadya)\\s+', ''), '\\s*[*)(\\]\\[/]+\\s*$', ''), '\\s+(kab|kabupaten|kota|regency|municipality)$', ''))"
    aliases = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in labels.UNIT_ALIASES.items())
    return f"coalesce(map_extract(MAP {{{aliases}}}, replace({name}, ' ', ''))[1], replace({name}, ' ', ''))"


def level_sql(x: str) -> str:
    """SQL for the kind of unit that a name begins with."""
    return f"CASE WHEN regexp_matches({bare_sql(x)}, '^kota') THEN 'kota' WHEN regexp_matches({bare_sql(x)}, '^(kabupaten|kab\\b)') THEN 'kabupaten' ELSE 'unknown' END"


PROVINCE_KEYS = {name.lower().replace(" ", ""): code for code, name in labels.PROVINCES.items()} | labels.PROVINCE_ALIASES
PLACE_SQL = f"""
    t AS (SELECT c_custkey, {sql_list([p[0] for p in PLACES])}[c_custkey % {len(PLACES)} + 1] AS p, {sql_list([p[1] for p in PLACES])}[c_custkey // 3 % {len(PLACES)} + 1] AS n FROM customer),
    f AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN upper(p) WHEN 2 THEN 'Prov. ' || p ELSE p END AS provinsi, CASE c_custkey % 4 WHEN 1 THEN upper(n) WHEN 2 THEN replace(n, 'Kabupaten', 'KAB.') ELSE n END AS kabupaten_kota FROM t),
    k AS (SELECT *, map_extract(MAP {{{", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in PROVINCE_KEYS.items())}}}, replace(regexp_replace({norm_sql("provinsi")}, '^prov(insi)?\\s+', ''), ' ', ''))[1] AS prov, {level_sql("kabupaten_kota")} AS level,
      {unit_key_sql("regexp_replace(kabupaten_kota, '(?i)^kota adm\\.?\\s+', 'Kota ')")} AS key, replace({norm_sql("regexp_replace(kabupaten_kota, '(?i)^(kabupaten|kota adm\\.?|kota)\\s+', '')")}, ' ', '') AS whole FROM f),
    c AS (SELECT code, left(code, 2) AS prov, CASE WHEN {level_sql("name")} <> 'unknown' THEN {level_sql("name")} WHEN substr(code, 3, 1) = '7' THEN 'kota' ELSE 'kabupaten' END AS level, {unit_key_sql("name")} AS key, replace({norm_sql("name")}, ' ', '') AS whole
      FROM (VALUES {", ".join(f"({quoted(c)}, {quoted(n)})" for c, n in CODES)}) v(code, name)),
    d1 AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY prov, level, key) = 1), d2 AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY prov, key) = 1), d3 AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY key) = 1),
    d4 AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY level, key) = 1), d5 AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY whole) = 1),
    m AS (SELECT k.*, coalesce(d1.code, d2.code, d3.code, d4.code, d5.code) AS first, EXISTS (SELECT 1 FROM c WHERE c.level = 'kabupaten' AND c.whole = k.whole) AS district FROM k LEFT JOIN d1 ON d1.prov = k.prov AND d1.level = k.level AND d1.key = k.key
      LEFT JOIN d2 ON d2.prov = k.prov AND d2.key = k.key LEFT JOIN d3 ON d3.key = k.key LEFT JOIN d4 ON d4.level = k.level AND d4.key = k.key LEFT JOIN d5 ON d5.whole = k.whole),
    places AS (SELECT m.c_custkey, m.provinsi, m.kabupaten_kota, coalesce(m.first, CASE WHEN NOT m.level = 'kabupaten' AND NOT m.district THEN d5.code END) AS unit_code FROM m LEFT JOIN d5 ON d5.whole = 'kota' || m.whole)
"""


def place_rows(spark, d):
    """A place a customer, of any province and any name of the list together, spelled in several ways."""
    k = F.col("c_custkey")
    p, n = pick([p[0] for p in PLACES], k), pick([p[1] for p in PLACES], F.floor(k / 3))
    province = F.when(k % 3 == 1, F.upper(p)).when(k % 3 == 2, F.concat(F.lit("Prov. "), p)).otherwise(p)
    name = F.when(k % 4 == 1, F.upper(n)).when(k % 4 == 2, F.replace(n, F.lit("Kabupaten"), F.lit("KAB."))).otherwise(n)
    return table(spark, d, "customer").select(k, province.alias("provinsi"), name.alias("kabupaten_kota"))


@query("q48_investment_places", f"WITH {PLACE_SQL} SELECT c_custkey, provinsi, kabupaten_kota, unit_code FROM places")
def q48(spark, d):
    """Places of investment reports by six keys, ever looser: a customer a place, its province and name any of the list's."""
    codes = spark.createDataFrame(CODES, "unit_code string, unit_name string")
    return matching.match_investment_units(place_rows(spark, d), codes).select("c_custkey", "provinsi", "kabupaten_kota", "unit_code")


@query(
    "q49_load_investment",
    f"""
    WITH {PLACE_SQL},
    r AS (SELECT unit_code, 2020 + o_orderkey % 3 AS year, floor(o_totalprice) AS a, o_orderstatus AS s, o_orderkey % 4 AS o FROM orders JOIN places ON c_custkey = o_custkey WHERE unit_code IS NOT NULL AND o_orderstatus <> 'P'),
    g AS (SELECT unit_code, year::BIGINT AS year, sum(a) FILTER (s = 'F') AS fdi, sum(a) FILTER (s = 'F' AND o = 0) AS china, sum(a) FILTER (s = 'F' AND o = 1) AS hk, sum(a) FILTER (s = 'F' AND o >= 2) AS other, sum(a) FILTER (s = 'O') AS domestic FROM r GROUP BY ALL)
    SELECT unit_code, year, coalesce(fdi, 0) AS fdi, coalesce(china, 0) AS fdi_china, coalesce(hk, 0) AS fdi_hk, coalesce(other, 0) AS fdi_other, coalesce(domestic, 0) AS domestic, coalesce(china, 0) + coalesce(hk, 0) AS fdi_china_hk FROM g
    """,
)
def q49(spark, d):
    """Investment reports by unit and year: places matched, origins told apart, kinds of investment side by side."""
    o = F.col("o_orderkey") % 4
    raw = table(spark, d, "orders").join(place_rows(spark, d), F.col("o_custkey") == F.col("c_custkey")).select(
        "provinsi", "kabupaten_kota", (F.col("o_orderkey") % 3 + 2020).alias("year"), F.when(F.col("o_orderstatus") == "F", "PMA ").when(F.col("o_orderstatus") == "O", "pmdn").otherwise("n.a.").alias("status_penanaman_modal"),
        F.when(o == 0, "R.R. Tiongkok").when(o == 1, "Hongkong (RRT)").when(o == 2, "Taiwan").otherwise("Jepang").alias("negara"), F.floor("o_totalprice").alias("investasi_us_ribu"),
    )
    out = matching.load_investment(raw, spark.createDataFrame(CODES, "unit_code string, unit_name string"))
    return out.withColumn("year", F.col("year").cast("long"))
