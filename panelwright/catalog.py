"""Registered queries of the engine over the driver's tables, with DuckDB SQL beside each.

The tables hold none of the panels' own data, so each query runs an operator on data of the
same shape: orders stand for cells, suppliers for sources, event types for categories, and so
on. Small label and geometry cases come inline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, labels, numbers
from .operators import grids, spatial
from .operators import relational as rel
from .plans import detect, estimate, harmonise, ingest, matching, rollup, yearbook
from .session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def money(column: str) -> F.Column:
    """Cents as an exact decimal, so that sums don't hang on the order of rows."""
    return F.col(column).cast("decimal(18,2)")


def each_customer(spark: SparkSession, d: str, rows: list[tuple], names: str) -> DataFrame:
    """One of the inline rows, in turn, for every customer."""
    turn = values(spark, [(i, *r) for i, r in enumerate(rows)], f"turn long, {names}")
    customers = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % len(rows)).alias("turn"))
    return customers.join(F.broadcast(turn), "turn").drop("turn")


def values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Inline rows."""
    return spark.createDataFrame(rows, names)


# ---------------------------------------------------------------- roll-up


@query(
    "q01_point_unit_panel",
    """
    WITH img AS (
      SELECT l_orderkey AS k, count(*) AS n_images, sum(l_linenumber) AS boxes, count(*) FILTER (l_returnflag = 'R') AS hits, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS ha,
        sum(l_quantity) AS ta, max((l_returnflag = 'R')::INT) AS any_hit FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1
    ), place AS (
      SELECT o_custkey AS point_id, c_nationkey AS unit_id, year(o_orderdate) AS y, img.* FROM orders JOIN img ON k = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'
    ), py AS (
      SELECT unit_id, point_id, y, max(any_hit) AS any_hit, sum(n_images) AS n_images, sum(boxes) AS boxes, sum(hits) AS hits, sum(ha) AS ha, sum(ta) AS ta FROM place GROUP BY ALL
    ), p AS (
      SELECT *, CASE WHEN ta > 0 THEN ha / ta END AS hit_share, CASE WHEN boxes > 0 THEN hits / boxes END AS box_share, count(*) OVER (PARTITION BY point_id) AS n_years FROM py
    )
    SELECT unit_id::BIGINT AS unit_id, y::BIGINT AS year, count(DISTINCT point_id) AS n_points, sum(n_images)::BIGINT AS n_images, sum(hits)::BIGINT AS n_hits, round(avg(any_hit), 6) AS share_points_hit,
      round(avg(hit_share), 6) AS mean_hit_share, round(avg(box_share), 6) AS mean_box_share, count(*) FILTER (n_years > 1) AS n_points_repeated
    FROM p GROUP BY unit_id, y
    """,
)
def q01(spark, d):
    """Images to places, places to point-years, point-years to unit-years: order lines are images, orders places, customers points."""
    hit = F.col("l_returnflag") == "R"
    images = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("place_id"), F.when(F.col("l_linestatus") == "F", "OK").otherwise("NO_IMAGE").alias("status"), F.col("l_linenumber").cast("long").alias("n_boxes"), hit.cast("long").alias("n_hits"),
        F.when(hit, F.col("l_quantity")).otherwise(0.0).alias("hit_area"), F.col("l_quantity").alias("text_area"), (2 * F.col("l_quantity")).alias("area"),
    )
    units = table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_nationkey").alias("unit_id"))
    places = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("place_id"), F.col("o_custkey").alias("point_id"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") != "P", "OK").otherwise("ERROR").alias("status")
    ).join(units, "point_id")
    out = rollup.unit_year(rollup.point_year(rollup.place_level(images, places)))
    return out.select(
        F.col("unit_id").cast("long").alias("unit_id"), F.col("year").cast("long").alias("year"), "n_points", "n_images", "n_hits",
        *[F.round(c, 6).alias(c) for c in ("share_points_hit", "mean_hit_share", "mean_box_share")], "n_points_repeated",
    )


@query(
    "q02_first_per_key",
    """SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
)
def q02(spark, d):
    """First row a key in an explicit order."""
    return rel.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], F.asc("ts"), F.asc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("q02b_only_unique", "SELECT o_custkey, o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) = 1")
def q02b(spark, d):
    """Keys that occur once; all members of repeated keys go."""
    orders = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return rel.only_unique(orders, ["o_custkey", "y"]).select("o_custkey", "o_orderkey")


@query(
    "q03_best_source",
    """
    WITH e AS (SELECT user_id, day(ts)::BIGINT AS d, event_type AS source, (event_id % 7)::BIGINT AS ref, (event_id % 3)::BIGINT AS cat, event_id FROM events),
    t AS (SELECT user_id, d, ref, min(CASE source WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END) AS r, count(DISTINCT cat) AS n FROM e GROUP BY ALL),
    b AS (SELECT user_id, d, ref FROM t QUALIFY row_number() OVER (PARTITION BY user_id, d ORDER BY r, n DESC, ref) = 1)
    SELECT e.user_id, e.d, e.ref, e.cat, min(e.source) AS source FROM e JOIN b USING (user_id, d, ref) GROUP BY ALL
    """,
)
def q03(spark, d):
    """The reference that serves a cell best: trusted sources first, then more categories, then name."""
    e = table(spark, d, "events").select("user_id", F.dayofmonth("ts").cast("long").alias("d"), F.col("event_type").alias("source"), (F.col("event_id") % 7).alias("ref"), (F.col("event_id") % 3).alias("cat"))
    return rel.best_source(e, ["user_id", "d"], "source", "ref", "cat", ["purchase", "click"]).select("user_id", "d", "ref", "cat", "source")


@query(
    "q04_crosstab",
    """
    SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase,
      min(value) FILTER (event_type = 'click') AS first_click FROM events GROUP BY user_id
    """,
)
def q04(spark, d):
    """Counts by fixed categories, absent ones zero, and a pivoted value."""
    e = table(spark, d, "events")
    counts = e.groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).count().na.fill(0)
    first = e.groupBy("user_id").pivot("event_type", ["click"]).agg(F.min("value")).withColumnRenamed("click", "first_click")
    return counts.join(first, "user_id")


@query(
    "q05_reconcile_series",
    """
    WITH l AS (SELECT l_suppkey AS ref, l_partkey AS unit, year(l_shipdate)::BIGINT AS y, l_quantity AS v FROM lineitem WHERE l_quantity BETWEEN 5 AND 45),
    w AS (SELECT *, median(v) OVER (PARTITION BY unit, y) AS mid, count(v) OVER (PARTITION BY unit, y) AS n, count(*) OVER (PARTITION BY ref) AS coverage FROM l),
    ok AS (SELECT * FROM w WHERE n < 2 OR v / mid BETWEEN 1 / 1.5::DOUBLE AND 1.5::DOUBLE),
    s AS (SELECT unit, y, count(DISTINCT v) AS n_values, round_even(max(v) / min(v), 3) AS spread FROM ok GROUP BY ALL),
    b AS (SELECT unit, y, ref, min(v) AS v, coverage FROM ok GROUP BY unit, y, ref, coverage QUALIFY row_number() OVER (PARTITION BY unit, y ORDER BY coverage DESC, ref) = 1)
    SELECT unit, y, ref, coverage, n_values, spread FROM b JOIN s USING (unit, y)
    """,
)
def q05(spark, d):
    """One value a cell out of several series: median filter, then the widest coverage."""
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ref"), F.col("l_partkey").alias("unit"), F.year("l_shipdate").cast("long").alias("y"), F.col("l_quantity").alias("v"))  # noqa: E741
    return harmonise.reconcile_series(l, "unit", "y", "ref", "v", 5, 45).select("unit", "y", "ref", "coverage", "n_values", "spread")


@query(
    "q06_jumps",
    """
    WITH c AS (SELECT user_id, day(ts)::BIGINT AS d, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
    p AS (SELECT *, lag(n) OVER w AS prev_n, lag(d) OVER w AS prev_d FROM c WINDOW w AS (PARTITION BY user_id ORDER BY d))
    SELECT user_id, d, n, prev_n, prev_d FROM p WHERE prev_n IS NOT NULL AND d - prev_d <= 4 AND greatest(n, prev_n) >= 3 AND least(n, prev_n) > 0 AND greatest(n, prev_n) / least(n, prev_n) > 2
    """,
)
def q06(spark, d):
    """Consecutive observations that jump."""
    counts = table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").cast("long").alias("d")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return rel.jumps(counts, ["user_id"], ["d"], "n", ratio=2, least=3).select("user_id", "d", "n", "prev_n", "prev_d")


@query(
    "q07_anchor_outliers",
    """
    WITH p AS (SELECT o_custkey AS unit, year(o_orderdate)::BIGINT AS y, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, CASE WHEN o_custkey % 4 = 0 THEN 150000::DOUBLE END AS pop FROM orders GROUP BY ALL),
    m AS (SELECT *, CASE WHEN pop > 0 THEN pop WHEN count(total) OVER w >= 3 AND median(total) OVER w > 0 THEN median(total) OVER w END AS anchor FROM p WINDOW w AS (PARTITION BY unit))
    SELECT unit, y, total, round(anchor, 4) AS anchor, round_even(total / anchor, 2) AS ratio FROM m WHERE abs(total / anchor - 1) > 0.35
    """,
)
def q07(spark, d):
    """Totals that stray from an outside figure or from the unit's median."""
    p = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").cast("long").alias("y")).agg(F.sum(money("o_totalprice")).cast("double").alias("total"))
    p = p.withColumn("pop", F.when(F.col("unit") % 4 == 0, 150000.0))
    return rel.anchor_outliers(p, "unit", "total", "pop").select("unit", "y", "total", F.round("anchor", 4).alias("anchor"), "ratio")


CASCADE_SQL = """
    WITH dim AS (SELECT (s_suppkey % 5)::BIGINT AS prov, CASE WHEN s_suppkey % 3 = 0 THEN 'kota' ELSE 'kabupaten' END AS level, 'u' || (s_suppkey % 23) AS k, s_suppkey AS code FROM supplier),
    f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 6 END AS prov, CASE c_custkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'kota' ELSE 'kabupaten' END AS level, 'u' || (c_custkey % 29) AS k FROM customer),
    d1 AS (SELECT * FROM dim QUALIFY count(*) OVER (PARTITION BY prov, level, k) = 1),
    d2 AS (SELECT * FROM dim QUALIFY count(*) OVER (PARTITION BY prov, k) = 1),
    d4 AS (SELECT * FROM dim QUALIFY count(*) OVER (PARTITION BY k) = 1),
    d5 AS (SELECT * FROM dim QUALIFY count(*) OVER (PARTITION BY level, k) = 1)
    SELECT f.id, coalesce(d1.code, d2.code, d3.code, d4.code, d5.code) AS code,
      (CASE WHEN d1.code IS NOT NULL THEN 1 WHEN d2.code IS NOT NULL THEN 2 WHEN d3.code IS NOT NULL THEN 3 WHEN d4.code IS NOT NULL THEN 4 WHEN d5.code IS NOT NULL THEN 5 END)::BIGINT AS match_level
    FROM f LEFT JOIN d1 ON d1.prov = f.prov AND d1.level = f.level AND d1.k = f.k
    LEFT JOIN d2 ON d2.prov = f.prov AND d2.k = f.k
    LEFT JOIN d1 AS d3 ON f.level = 'unknown' AND d3.prov = f.prov AND d3.level = 'kabupaten' AND d3.k = f.k
    LEFT JOIN d4 ON d4.k = f.k LEFT JOIN d5 ON f.level = 'unknown' AND d5.level = 'kabupaten' AND d5.k = f.k
"""


@query("q08_cascade_lookup", CASCADE_SQL)
def q08(spark, d):
    """Codes through five keys, ever looser."""
    dim = table(spark, d, "supplier").select(
        (F.col("s_suppkey") % 5).alias("prov"), F.when(F.col("s_suppkey") % 3 == 0, "kota").otherwise("kabupaten").alias("level"),
        F.concat(F.lit("u"), (F.col("s_suppkey") % 23).cast("string")).alias("k"), F.col("s_suppkey").alias("code"),
    )
    c = F.col("c_custkey")
    facts = table(spark, d, "customer").select(
        c.alias("id"), F.when(c % 11 != 0, c % 6).alias("prov"), F.when(c % 4 == 0, "unknown").when(c % 4 == 1, "kota").otherwise("kabupaten").alias("level"),
        F.concat(F.lit("u"), (c % 29).cast("string")).alias("k"),
    )
    unknown = F.col("level") == "unknown"
    levels = [(["prov", "level", "k"], {}, None), (["prov", "k"], {}, None), (["prov", "level", "k"], {"level": "kabupaten"}, unknown), (["k"], {}, None), (["level", "k"], {"level": "kabupaten"}, unknown)]
    return rel.cascade_lookup(facts, dim, levels, "code").select("id", "code", F.col("match_level").cast("long").alias("match_level"))


@query(
    "q09_weighted_allocation",
    """
    WITH x AS (SELECT n_nationkey AS nk, r.t, CASE WHEN r.t % 3 = 0 THEN NULL ELSE (r.t + 1)::DOUBLE END AS w FROM nation, (SELECT unnest(range(4)) AS t) r WHERE n_nationkey % 6 <> 5),
    w AS (SELECT nk, t, coalesce(w, 1) / sum(coalesce(w, 1)) OVER (PARTITION BY nk) AS w FROM x)
    SELECT s_suppkey, t AS target, round(CASE WHEN t IS NULL THEN s_acctbal ELSE s_acctbal * w END, 4) AS amount, t IS NOT NULL AS allocated FROM supplier LEFT JOIN w ON nk = s_nationkey
    """,
)
def q09(spark, d):
    """Amounts spread over targets by normalised weights; what has no target stays."""
    cross = table(spark, d, "nation").where("n_nationkey % 6 <> 5").select(F.col("n_nationkey").alias("s_nationkey"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("target"))
    cross = cross.withColumn("w", F.when(F.col("target") % 3 != 0, (F.col("target") + 1).cast("double")))
    out = rel.allocate(table(spark, d, "supplier"), cross, "s_nationkey", "target", "w", "s_acctbal")
    return out.select("s_suppkey", "target", F.round("s_acctbal", 4).alias("amount"), "allocated")


@query(
    "q10_wildcard_rules",
    """
    WITH r(st, pr, y) AS (VALUES ('F', NULL, 1995), (NULL, '1-URGENT', 1996), ('P', NULL, NULL), (NULL, NULL, NULL))
    SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM r WHERE NOT (st IS NULL AND pr IS NULL AND y IS NULL)
      AND (st IS NULL OR st = o_orderstatus) AND (pr IS NULL OR pr = o_orderpriority) AND (y IS NULL OR y = year(o_orderdate)))
    """,
)
def q10(spark, d):
    """Rows that no curated rule hits; a rule that hits all is ignored."""
    rules = values(spark, [("F", None, 1995), (None, "1-URGENT", 1996), ("P", None, None), (None, None, None)], "o_orderstatus string, o_orderpriority string, y int")
    orders = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return rel.drop_by_rules(orders, rules, ["o_orderstatus", "o_orderpriority", "y"]).select("o_orderkey")


@query(
    "q11_row_quality",
    """
    WITH p AS (
      SELECT l_orderkey AS k, max(l_quantity) FILTER (l_linenumber = 1) AS islam, max(l_quantity) FILTER (l_linenumber = 2) AS kristen, max(l_quantity) FILTER (l_linenumber = 3) AS katolik,
        max(floor(l_quantity / 10)) FILTER (l_linenumber = 4) AS hindu, max(floor(l_quantity / 10)) FILTER (l_linenumber = 5) AS buddha, max(floor(l_quantity / 10)) FILTER (l_linenumber = 6) AS konghucu,
        max(floor(l_quantity / 10)) FILTER (l_linenumber = 7) AS kepercayaan, NULL::DOUBLE AS lainnya FROM lineitem GROUP BY 1
    ), v AS (SELECT *, list_filter([islam, kristen, katolik, hindu, buddha, konghucu, kepercayaan, lainnya], lambda x: x IS NOT NULL) AS v FROM p)
    SELECT k, CASE WHEN len(v) >= 3 AND list_sum(v) BETWEEN 99 AND 101 AND list_max(v) <= 100 THEN 'percent'
      WHEN len(list_filter(v, lambda x: x <> 0 AND len(list_filter(v, lambda y: y = x)) >= 4)) > 0 THEN 'placeholder'
      WHEN len(v) = 0 THEN 'no_religions' WHEN islam IS NULL OR kristen IS NULL OR katolik IS NULL THEN 'partial' ELSE '' END AS quality FROM v
    """,
)
def q11(spark, d):
    """What is wrong with a wide row of counts."""
    names = ["islam", "kristen", "katolik", "hindu", "buddha", "konghucu", "kepercayaan"]
    q = F.when(F.col("l_linenumber") <= 3, F.col("l_quantity")).otherwise(F.floor(F.col("l_quantity") / 10).cast("double"))
    wide = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(*[F.max(F.when(F.col("l_linenumber") == i + 1, q)).alias(n) for i, n in enumerate(names)])
    return wide.withColumn("lainnya", F.lit(None).cast("double")).select("k", harmonise.cell_quality().alias("quality"))


@query(
    "q12_total_repair",
    """
    WITH l AS (SELECT l_orderkey AS k, sum(l_quantity) AS s, max(l_quantity) FILTER (l_returnflag = 'R') AS a, max(l_quantity) FILTER (l_returnflag = 'N') AS b FROM lineitem GROUP BY 1),
    t AS (SELECT *, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN s * 2 ELSE s END AS reported FROM l)
    SELECT k, CASE WHEN reported / s BETWEEN 0.9 AND 1.1 THEN reported ELSE s END AS total, reported, coalesce(a, b) AS upper_bound, a IS NULL AND b IS NOT NULL AS bound_is_other FROM t
    """,
)
def q12(spark, d):
    """Totals checked against sums and filled by them, and an upper bound."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(  # noqa: E741
        F.sum("l_quantity").alias("s"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("a"), F.max(F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))).alias("b")
    )
    l = l.withColumn("total", F.when(F.col("k") % 5 == 0, None).when(F.col("k") % 5 == 1, F.col("s") * 2).otherwise(F.col("s"))).withColumn("quality", F.lit(""))  # noqa: E741
    out = harmonise.repair_totals(l, ["s"])
    return out.select("k", "total", F.col("total_reported").alias("reported"), harmonise.upper_bound("a", "b")["a_ub"].alias("upper_bound"), harmonise.upper_bound("a", "b")["a_ub_is_b"].alias("bound_is_other"))


# ---------------------------------------------------------------- labels and numbers

@query(
    "q13b_part_labels",
    """
    WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(p_type), '[\\s_.\\-]+', ' ', 'g')) AS s FROM part)
    SELECT CASE WHEN regexp_matches(s, 'standard|medium') THEN 'usual' WHEN regexp_matches(s, 'large|economy') THEN 'bulk' END AS kind, count(*) AS n, count(DISTINCT s) AS n_labels FROM n GROUP BY 1
    """,
)
def q13b(spark, d):
    """An ordered list of patterns over a table's labels."""
    s = labels.norm_label("p_type")
    kind = labels.first_match(s, [("usual", "standard|medium"), ("bulk", "large|economy")])
    return table(spark, d, "part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(s).alias("n_labels"))


@query(
    "q14b_formatted_prices",
    """SELECT l_returnflag, sum((l_extendedprice * 100)::DECIMAL(18,0)) / 100::DOUBLE AS total FROM lineitem GROUP BY 1""",
)
def q14b(spark, d):
    """Prices printed with a decimal comma and read again."""
    l = table(spark, d, "lineitem").withColumn("printed", F.replace(money("l_extendedprice").cast("string"), F.lit("."), F.lit(",")))  # noqa: E741
    cents = (numbers.parse_count("printed") * 100).cast("decimal(18,0)")
    return l.groupBy("l_returnflag").agg((F.sum(cents).cast("double") / 100).alias("total"))


@query(
    "q14c_watermarks_percents",
    """
    WITH p AS (SELECT p_partkey AS k, p_size AS z, (p_retailprice * 100)::BIGINT AS cents FROM part)
    SELECT k, z::DOUBLE * 1000 + cents % 1000 AS watermarked, CASE WHEN k % 5 = 0 THEN 0 ELSE (cents % 100 + z / 100::DOUBLE) END AS percent, k % 3 <> 0 AS is_percent,
      CASE k % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 WHEN 2 THEN 1 ELSE 1000 END::DOUBLE AS scale FROM p
    """,
)
def q14c(spark, d):
    """Cells with watermark letters, percent cells and percent tables, units of count: numbers of parts printed as a yearbook would."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    k, z = F.col("p_partkey"), F.col("p_size")
    printed = F.format_string("%dx%03do", z, cents % 1000)
    percent = F.when(k % 5 == 0, "-").otherwise(F.format_string("%d ,w%02d", cents % 100, z))
    cell = F.when(k % 3 != 0, F.format_string("%d,%02d", cents % 100, z)).otherwise(z.cast("string"))
    unit = F.element_at(F.array(F.lit("Ribu Jiwa"), F.lit("juta"), F.lit("orang"), F.lit("Tidak Ada Satuan")), (k % 4 + 1).cast("int"))
    return table(spark, d, "part").select(
        k.alias("k"), numbers.watermarked_count(printed).alias("watermarked"), numbers.percent_value(percent).alias("percent"),
        numbers.is_percent_table(F.array(cell, cell, cell, cell, F.lit("x"))).alias("is_percent"), numbers.unit_scale(unit, F.lit("Penduduk (Ribu Jiwa)")).alias("scale"),
    )


# ---------------------------------------------------------------- geometry


@query(
    "q16_geometry",
    """
    WITH t AS (SELECT c_custkey AS id, (c_custkey % 360)::DOUBLE - 180 + 0.5 AS lon, (c_custkey % 160)::DOUBLE - 80 + 0.25 AS lat FROM customer)
    SELECT id, ((CASE WHEN lat < 0 THEN 32700 ELSE 32600 END) + floor((lon + 180) / 6) + 1)::BIGINT AS epsg, round(((degrees(atan2(lon, lat)) % 360) + 360) % 360, 6) AS bearing,
      round(2 * 6371000 * asin(sqrt(sin((radians(lat) - 0) / 2) ** 2 + cos(0) * cos(radians(lat)) * sin(radians(lon) / 2) ** 2)), 2) AS metres FROM t
    """,
)
def q16(spark, d):
    """Zones, bearings and distances."""
    c = F.col("c_custkey")
    t = table(spark, d, "customer").select(c.alias("id"), ((c % 360).cast("double") - 180 + 0.5).alias("lon"), ((c % 160).cast("double") - 80 + 0.25).alias("lat"))
    return t.select("id", geo.utm_epsg("lon", "lat").cast("long").alias("epsg"), F.round(geo.bearing("lon", "lat"), 6).alias("bearing"), F.round(geo.haversine_m(F.lit(0.0), F.lit(0.0), "lat", "lon"), 2).alias("metres"))


@query("q16c_points_along")
def q16c(spark, d):
    """Points every 50 m along lines, starting at a hash of the line, with bearings."""
    line = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (120, 0), (120, 90))])
    return spatial.sample_lines(table(spark, d, "nation").select("n_nationkey", line.alias("line")), "n_nationkey", "line", 50.0)


@query(
    "q16d_points_in_polygons",
    """
    WITH p AS (SELECT c_custkey AS id, (c_custkey % 100)::DOUBLE / 10 + 0.05 AS x, ((c_custkey // 7) % 100)::DOUBLE / 10 + 0.05 AS y FROM customer)
    SELECT unit, count(*) AS n FROM p JOIN (VALUES ('a', 0, 0, 4, 4), ('b', 4, 0, 9, 5), ('c', 2, 6, 8, 9)) t(unit, x0, y0, x1, y1) ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY 1
    """,
)
def q16d(spark, d):
    """Points by the polygon that holds them."""
    c = F.col("c_custkey")
    points = table(spark, d, "customer").select(c.alias("id"), ((c % 100).cast("double") / 10 + 0.05).alias("x"), ((F.floor(c / 7) % 100).cast("double") / 10 + 0.05).alias("y"))
    box = lambda u, x0, y0, x1, y1: (u, f"{x0},{y0};{x1},{y0};{x1},{y1};{x0},{y1}")
    units = values(spark, [box("a", 0, 0, 4, 4), box("b", 4, 0, 9, 5), box("c", 2, 6, 8, 9)], "unit string, shape string")
    units = units.select("unit", geo.parse_polygon("shape").alias("ring"))
    return spatial.points_in_polygons(points, units, "unit", "ring", cell=2.0).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- scores and summaries


@query(
    "q17_confusion",
    """
    WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic <> 1 AND quality = 1) AS fp, count(*) FILTER (toxic = 1 AND quality <> 1) AS fn, count(*) FILTER (toxic <> 1 AND quality <> 1) AS tn FROM labels WHERE toxic IS NOT NULL)
    SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
      round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / nullif(tp / (tp + fp) + tp / (tp + fn), 0), 6) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM c
    """,
)
def q17(spark, d):
    """Confusion counts and the scores from them."""
    out = rollup.classification_score(table(spark, d, "labels"), "toxic", "quality")
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(
    "q18_describe",
    """SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.25) AS p25,
       quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS p75, max(o_totalprice) AS max FROM orders""",
)
def q18(spark, d):
    """Count, mean, deviation, extremes and percentiles."""
    return estimate.describe(table(spark, d, "orders"), "o_totalprice").withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("q18b_change_summary", """SELECT count(value) AS n, round(avg(value - 50), 6) AS mean, median(value - 50) AS median, round(avg((coalesce(value > 50, false))::INT), 6) AS up, round(avg((coalesce(value < 50, false))::INT), 6) AS down, round(avg((coalesce(value = 50, false))::INT), 6) AS same FROM events""")
def q18b(spark, d):
    """Mean, median and shares of rises, falls and standstills."""
    out = estimate.change_summary(table(spark, d, "events").withColumn("x", F.col("value") - 50), "x")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "up", "down", "same")})


@query("q18c_coverage", """SELECT year(o_orderdate)::BIGINT AS year, count(DISTINCT o_custkey) AS units, count(o_totalprice) AS totals, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finished FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY 1""")
def q18c(spark, d):
    """Distinct units and values present, by year of a range."""
    y = F.year("o_orderdate").cast("long")
    return table(spark, d, "orders").where(y.between(1996, 1999)).groupBy(y.alias("year")).agg(F.count_distinct("o_custkey").alias("units"), F.count("o_totalprice").alias("totals"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query("q19_top_k", "SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1 ORDER BY q DESC, l_suppkey LIMIT 10")
def q19(spark, d):
    """The ten largest, ties by key."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")).orderBy(F.desc("q"), "l_suppkey").limit(10)


@query(
    "q20_dense_running_sum",
    """
    WITH s AS (SELECT o_custkey AS unit, year(o_orderdate)::INT AS y, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY ALL),
    g AS (SELECT DISTINCT unit, t.y FROM s, (SELECT unnest(range(1995, 2002))::INT AS y) t)
    SELECT unit, y::BIGINT AS y, round(sum(coalesce(v, 0)) OVER (PARTITION BY unit ORDER BY y), 2) AS v_stock FROM g LEFT JOIN s USING (unit, y)
    """,
)
def q20(spark, d):
    """Running sums on a grid of every unit and year."""
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("y")).agg(F.sum(money("o_totalprice")).cast("double").alias("v"))
    return rel.dense_running_sum(s, "unit", "y", "v", 1995, 2001).select("unit", F.col("y").cast("long").alias("y"), F.round("v_stock", 2).alias("v_stock"))


@query(
    "q21_within_slope",
    """
    WITH o AS (SELECT o_custkey AS u, year(o_orderdate)::DOUBLE AS x, o_totalprice AS y FROM orders),
    w AS (SELECT x - avg(x) OVER (PARTITION BY u) AS x, y - avg(y) OVER (PARTITION BY u) AS y FROM o)
    SELECT round(sum(x * y) / sum(x * x), 4) AS slope, count(*) AS n FROM w
    """,
)
def q21(spark, d):
    """Slope within units, from deviations."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("u"), F.year("o_orderdate").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    w = rel.demeaned(o, "u", ["x", "y"])
    return w.agg(F.round(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x")), 4).alias("slope"), F.count(F.lit(1)).alias("n"))


@query("q22_ols", """SELECT round(regr_slope(o_totalprice / 1000, year(o_orderdate)), 5) AS beta, regr_count(o_totalprice, year(o_orderdate))::BIGINT AS n FROM orders""")
def q22(spark, d):
    """Least squares from sums of products."""
    o = table(spark, d, "orders").select((F.col("o_totalprice") / 1000).alias("y"), F.year("o_orderdate").cast("double").alias("x"))
    row = estimate.ols(o, "y", ["x"]).row("x")
    return values(spark, [(round(row["beta"], 5), row["n"])], "beta double, n long")


@query(
    "q22b_robust_errors",
    """
    WITH o AS (SELECT o_totalprice / 1000 AS y, year(o_orderdate)::DOUBLE AS x, c_acctbal / 1000 AS z, c_nationkey AS g FROM orders JOIN customer ON c_custkey = o_custkey),
    m AS (SELECT y - avg(y) OVER () AS y, x - avg(x) OVER () AS x, z - avg(z) OVER () AS z, g, count(*) OVER () AS n FROM o),
    s AS (SELECT sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz, sum(x * y) AS xy, sum(z * y) AS zy, xx * zz - xz * xz AS det FROM m),
    a AS (SELECT *, (zz * x - xz * z) / det AS ax, (xx * z - xz * x) / det AS az, (zz * xy - xz * zy) / det AS bx, (xx * zy - xz * xy) / det AS bz FROM m, s),
    e AS (SELECT *, y - bx * x - bz * z AS e, 1 / n + ax * x + az * z AS h FROM a),
    k AS (SELECT sum(ax * e) AS cx, sum(az * e) AS cz FROM e GROUP BY g),
    c AS (SELECT sum(cx * cx) AS cx, sum(cz * cz) AS cz, count(*) AS g FROM k),
    r AS (SELECT any_value(n) AS n, any_value(bx) AS bx, any_value(bz) AS bz, sum(e * e) / (any_value(n) - 3) AS s2, any_value(zz / det) AS ix, any_value(xx / det) AS iz, sum((ax * e) ** 2) AS hx, sum((az * e) ** 2) AS hz, sum((ax * e / (1 - h)) ** 2) AS jx, sum((az * e / (1 - h)) ** 2) AS jz FROM e),
    w AS (SELECT r.*, c.cx * g / (g - 1) * (n - 1) / (n - 3) AS vx, c.cz * g / (g - 1) * (n - 1) / (n - 3) AS vz FROM r, c)
    SELECT kind, term, round(beta, 6) AS beta, round(sqrt(v), 6) AS se, n::BIGINT AS n FROM (
      SELECT 'classical' AS kind, 'x' AS term, bx AS beta, s2 * ix AS v, n FROM w UNION ALL SELECT 'classical', 'z', bz, s2 * iz, n FROM w
      UNION ALL SELECT 'HC1', 'x', bx, hx * n / (n - 3), n FROM w UNION ALL SELECT 'HC1', 'z', bz, hz * n / (n - 3), n FROM w
      UNION ALL SELECT 'HC3', 'x', bx, jx, n FROM w UNION ALL SELECT 'HC3', 'z', bz, jz, n FROM w
      UNION ALL SELECT 'cluster', 'x', bx, vx, n FROM w UNION ALL SELECT 'cluster', 'z', bz, vz, n FROM w)
    """,
)
def q22b(spark, d):
    """Several regressors with HC1, HC3 and clustered errors."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        (F.col("o_totalprice") / 1000).alias("y"), F.year("o_orderdate").cast("double").alias("x"), (F.col("c_acctbal") / 1000).alias("z"), F.col("c_nationkey").alias("g")
    )
    rows = []
    for kind in ("classical", "HC1", "HC3", "cluster"):
        fit = estimate.ols(o, "y", ["x", "z"], cluster="g", kind=kind)
        rows += [(kind, r["term"], round(r["beta"], 6), round(r["se"], 6), r["n"]) for r in (fit.row("x"), fit.row("z"))]
    return values(spark, rows, "kind string, term string, beta double, se double, n long")


@query(
    "q23_two_period",
    """
    WITH o AS (SELECT o_custkey AS unit, year(o_orderdate) AS y, count(*)::DOUBLE AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS p FROM orders GROUP BY ALL),
    w AS (SELECT unit, max(n) FILTER (y = 1996) AS y0, max(n) FILTER (y = 1999) AS y1, max(p) FILTER (y = 1996) AS p0, max(p) FILTER (y = 1999) AS p1 FROM o GROUP BY 1)
    SELECT unit, y0, y1, round(1000 * y1 / p1 - 1000 * y0 / p0, 6) AS change, round(ln(1 + y1) - ln(1 + y0), 6) AS dlog_count FROM w WHERE y0 IS NOT NULL AND y1 IS NOT NULL
    """,
)
def q23(spark, d):
    """Change between two years."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit_code"), F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("population")
    ).withColumn("ref", F.lit("a:1"))
    out = estimate.two_period(o, "n", 1996, 1999)
    return out.select(F.col("unit_code").alias("unit"), "y0", "y1", F.round("change", 6).alias("change"), F.round("dlog_count", 6).alias("dlog_count"))


@query(
    "q24_investment_outer",
    """
    WITH r AS (SELECT 'u' || c_nationkey AS u, c_custkey % 3 AS y, 'f' AS s, c_mktsegment AS o, floor(c_acctbal) AS a FROM customer WHERE c_nationkey % 3 <> 0 UNION ALL SELECT 'u' || s_nationkey, s_suppkey % 3, 'd', NULL, floor(s_acctbal) FROM supplier WHERE s_nationkey % 4 <> 0),
    f AS (SELECT u, y, sum(a) AS fdi, sum(CASE WHEN o = 'BUILDING' THEN a ELSE 0 END) AS china, sum(CASE WHEN o = 'MACHINERY' THEN a ELSE 0 END) AS hk FROM r WHERE s = 'f' GROUP BY ALL), dm AS (SELECT u, y, sum(a) AS domestic FROM r WHERE s = 'd' GROUP BY ALL)
    SELECT unit_code, year, coalesce(fdi, 0) AS fdi, coalesce(china, 0) AS fdi_china, coalesce(hk, 0) AS fdi_hk, coalesce(fdi - china - hk, 0) AS fdi_other, coalesce(domestic, 0) AS domestic, coalesce(china + hk, 0) AS fdi_china_hk
    FROM (SELECT coalesce(f.u, dm.u) AS unit_code, coalesce(f.y, dm.y) AS year, * FROM f FULL OUTER JOIN dm ON f.u = dm.u AND f.y = dm.y)
    """,
)
def q24(spark, d):
    """Foreign investment by origin and domestic investment, outer joined, absent is zero."""
    unit = lambda c: F.concat(F.lit("u"), F.col(c).cast("string")).alias("unit_code")
    origin = F.when(F.col("c_mktsegment") == "BUILDING", "china").when(F.col("c_mktsegment") == "MACHINERY", "hong_kong").otherwise("other")
    f = table(spark, d, "customer").where("c_nationkey % 3 <> 0").select(unit("c_nationkey"), (F.col("c_custkey") % 3).alias("year"), F.lit("PMA").alias("status"), origin.alias("origin"), F.floor("c_acctbal").cast("double").alias("amount"))
    dm = table(spark, d, "supplier").where("s_nationkey % 4 <> 0").select(unit("s_nationkey"), (F.col("s_suppkey") % 3).alias("year"), F.lit("pmdn ").alias("status"), F.lit(None).cast("string").alias("origin"), F.floor("s_acctbal").cast("double").alias("amount"))
    return estimate.convert_investment(f.unionByName(dm))


@query(
    "q25_weighted_tabulation",
    """
    WITH t AS (SELECT sum(c_custkey) AS s FROM customer)
    SELECT c_nationkey::BIGINT AS unit, c_mktsegment AS category, round(sum(c_custkey) * CASE WHEN any_value(t.s) > 10 * 100000 THEN 0.01::DOUBLE ELSE 1 END, 4) AS weighted, count(*) AS sample FROM customer, t GROUP BY ALL
    """,
)
def q25(spark, d):
    """Weighted counts whose weights may have implied decimals."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("unit"), F.col("c_mktsegment").alias("category"), F.col("c_custkey").alias("w"))
    return estimate.tabulate_weighted(c, "unit", "w", "category", 100_000).withColumn("weighted", F.round("weighted", 4))


@query("q25b_mode", "SELECT user_id, min(event_type) AS usual FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type QUALIFY rank() OVER (PARTITION BY user_id ORDER BY count(*) DESC) = 1) GROUP BY 1")
def q25b(spark, d):
    """The commonest value of a group, the least on ties."""
    return table(spark, d, "events").groupBy("user_id").agg(F.mode("event_type", True).alias("usual"))


# ---------------------------------------------------------------- sets and increments


@query(
    "q26_set_difference",
    """
    WITH y AS (SELECT DISTINCT o_custkey AS u, year(o_orderdate) AS y FROM orders), h AS (SELECT u FROM y WHERE y IN (1996, 1997, 1998) GROUP BY u HAVING count(*) = 3)
    SELECT DISTINCT u FROM y WHERE y IN (1995, 1996) AND u NOT IN (SELECT u FROM h)
    """,
)
def q26(spark, d):
    """Units seen in a base year less those that have all target years."""
    y = table(spark, d, "orders").select(F.col("o_custkey").alias("u"), F.year("o_orderdate").alias("y"))
    return y.where("y in (1995, 1996)").select("u").distinct().join(rel.has_all(y, "u", "y", [1996, 1997, 1998]), "u", "left_anti")


@query("q26b_union_keep_last", "SELECT k, v, x FROM (SELECT c_custkey AS k, c_acctbal AS v, NULL::INT AS x, 0 AS b FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_nationkey, 1 FROM supplier) QUALIFY row_number() OVER (PARTITION BY k ORDER BY b DESC) = 1")
def q26b(spark, d):
    """Two tables of different columns by name, the later row of a key."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.col("s_nationkey").alias("x"))
    return rel.union_keep_last(old, new, ["k"]).select("k", "v", "x")


@query("q27_resume", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND day(ts) <= 2 AND user_id IS NOT NULL)")
def q27(spark, d):
    """Items whose key the ledger lacks."""
    from .streaming.incremental import not_done

    e = table(spark, d, "events")
    return not_done(e, e.where("event_type = 'purchase' and day(ts) <= 2"), ["user_id"]).select("event_id")


@query("q28_json_props", "SELECT event_type, sum((json_extract_string(props, '$.k'))::BIGINT)::BIGINT AS k, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1")
def q28(spark, d):
    """Fields of JSON text."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(k).alias("n"))


@query("q29b_strip_tags", "SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g'))::BIGINT AS n_chars FROM pages")
def q29b(spark, d):
    """Text of pages without tags."""
    return table(spark, d, "pages").select("page_id", F.length(labels.strip_tags("html")).cast("long").alias("n_chars"))


@query("q30_stratified_sample")
def q30(spark, d):
    """Up to twenty rows a class, the same wherever it runs."""
    return rel.stratified_sample(table(spark, d, "labels"), "toxic", "doc_id", 20, 3)


@query("q31_unpivot", "SELECT l_orderkey, l_linenumber, name AS category, value AS \"count\" FROM (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_tax AS tax, l_discount AS discount FROM lineitem) UNPIVOT (value FOR name IN (quantity, tax, discount))")
def q31(spark, d):
    """Wide to long."""
    return grids.unpivot_counts(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"l_quantity": "quantity", "l_tax": "tax", "l_discount": "discount"})


@query("q32_string_sets", "SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS types, bool_or(event_type = 'purchase') AS bought, array_to_string(list_sort(list_distinct(list(event_type)))[1:2], ';') AS two FROM events GROUP BY 1")
def q32(spark, d):
    """Sorted sets as text, and whether a group has a value."""
    return table(spark, d, "events").groupBy("user_id").agg(rel.string_set("event_type").alias("types"), F.bool_or(F.col("event_type") == "purchase").alias("bought"), rel.string_set("event_type", 2).alias("two"))


@query(
    "q33_equal_to_rest",
    """
    WITH t AS (SELECT l_returnflag AS g, l_suppkey % 9 AS unit, l_linestatus AS cat, l_quantity AS v FROM lineitem),
    x AS (SELECT * FROM t UNION ALL SELECT g, 100, cat, sum(v) FROM t GROUP BY ALL),
    s AS (SELECT g, cat, sum(v) AS s FROM x GROUP BY g, cat QUALIFY row_number() OVER (PARTITION BY g ORDER BY sum(v) DESC, cat) = 1),
    u AS (SELECT g, unit, sum(v) AS v FROM x JOIN s USING (g, cat) GROUP BY ALL),
    w AS (SELECT *, count(*) OVER w AS n, max(v) OVER w AS m, sum(v) OVER w - v AS rest FROM u WINDOW w AS (PARTITION BY g))
    SELECT g, unit::BIGINT AS unit FROM w WHERE n >= 3 AND m > 0 AND v >= 0.97 * m AND abs(v - rest) <= 0.01 * greatest(v, rest)
    """,
)
def q33(spark, d):
    """Units that equal the sum of the others: totals among the rows."""
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_suppkey") % 9).alias("unit"), F.col("l_linestatus").alias("cat"), F.col("l_quantity").alias("v"))
    total = t.groupBy("g", "cat").agg(F.sum("v").alias("v")).select("g", F.lit(100).cast("long").alias("unit"), "cat", "v")
    return rel.equal_to_rest(t.unionByName(total), ["g"], "unit", "cat", "v")


@query(
    "q34_match_boxes",
    """
    SELECT p_partkey AS id, b.no AS box_no, b.text, b.conf FROM part, LATERAL (
      SELECT 0 AS no, CASE WHEN p_size >= 30 THEN 'a' ELSE 'a2' END AS text, CASE WHEN p_size >= 30 THEN p_size ELSE 30 END / 100::DOUBLE AS conf
      UNION ALL SELECT 1, CASE WHEN p_partkey % 2 = 0 THEN 'b2' ELSE 'b' END, CASE WHEN p_partkey % 2 = 0 THEN 0.8 ELSE 0.4 END::DOUBLE
      UNION ALL SELECT 2, CASE WHEN p_partkey % 2 = 0 THEN 'c' ELSE 'b2' END, CASE WHEN p_partkey % 2 = 0 THEN 0.7 ELSE 0.8 END::DOUBLE
      UNION ALL SELECT 3, 'c', 0.7::DOUBLE WHERE p_partkey % 2 = 1) b
    """,
)
def q34(spark, d):
    """Boxes of two detectors as one list, part by part: sizes are confidences, odd parts' second boxes lie apart."""
    k, z = F.col("p_partkey"), F.col("p_size")
    box = lambda text, conf, *at: F.struct(F.lit(text).alias("text"), conf.cast("double").alias("conf"), *[x.cast("double").alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), at, strict=True)])
    at = lambda *v: [F.lit(float(x)) for x in v]
    apart = F.when(k % 2 == 1, 8.0).otherwise(0.0)
    first = F.array(box("a", z / 100, *at(0, 0, 10, 10)), box("b", F.lit(0.4), *at(20, 0, 30, 10)))
    second = F.array(box("a2", F.lit(0.3), *at(1, 0, 10, 10)), box("b2", F.lit(0.8), 20 + apart, F.lit(0), 30 + apart, F.lit(11)), box("c", F.lit(0.7), *at(50, 50, 60, 60)))
    t = table(spark, d, "part").select(k.alias("id"), first.alias("p"), second.alias("q"))
    return t.select("id", F.posexplode(grids.match_boxes(F.col("p"), F.col("q"))).alias("box_no", "b")).select("id", "box_no", "b.text", "b.conf")


@query("q45_specification_grid")
def q45(spark, d):
    """Every specification of the investment regressions, on customers' orders as counts and suppliers' lines as investment."""
    year, n = (F.year("o_orderdate") + 25).alias("year"), F.count(F.lit(1)).cast("double")
    unit = F.format_string("%d%02d", F.lit(11) + F.col("o_custkey") % 30, F.col("o_custkey") % 90).alias("unit_code")
    count = lambda cond: F.count_if(cond).cast("double")
    panel = table(spark, d, "orders").groupBy(unit, year).agg(
        n.alias("konghucu_ub"), F.when(F.count_if(F.col("o_orderstatus") == "F") > 0, count(F.col("o_orderstatus") == "F")).alias("konghucu"), (50_000 + F.sum(money("o_totalprice")) / 1000).cast("double").alias("population"),
        *[count(F.col("o_orderpriority").startswith(k)).alias(name) for k, name in (("1", "buddha"), ("2", "kristen"), ("3", "katolik"))], F.lit("da:x:y").alias("ref"), F.lit(1.02).alias("total_to_pop"),
    ).withColumn("konghucu_ub_is_lainnya", F.col("konghucu").isNull())
    share = panel.select("unit_code").distinct().withColumns({"n_chinese_sample": F.lit(30), "chinese_share": (1 + F.col("unit_code").cast("int") % 7) / 100})
    investment = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.format_string("%d%02d", F.lit(11) + F.col("l_partkey") % 30, F.col("l_partkey") % 90).alias("unit_code"), (F.year("l_shipdate") + 28).alias("year")).agg(F.sum(money("l_extendedprice")).cast("double").alias("value"))
    rows = estimate.specification_grid(estimate.usable(panel, share), investment)
    return values(spark, [tuple(r.values()) for r in rows], "spec string, n long, coef_d_inv double, se double, p double")


@query("q36_image_summary", """
    WITH g AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS h, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS ha, sum(l_quantity) AS ta FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1)
    SELECT o_orderkey AS path, coalesce(n, 0) AS n_boxes, coalesce(h, 0) AS n_cjk_boxes, coalesce(ha, 0)::DOUBLE AS cjk_area_px, coalesce(ta, 0)::DOUBLE AS text_area_px FROM orders LEFT JOIN g ON k = o_orderkey
    """)
def q36(spark, d):
    """Box counts of every image; images without boxes have zeros."""
    boxes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_discount").alias("conf"), (F.col("l_returnflag") == "R").alias("is_cjk"), F.col("l_quantity").alias("area_px"), F.lit("unknown").alias("script"))
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"))
    return rollup.image_level(images, boxes, 0.05).select("path", "n_boxes", "n_cjk_boxes", "cjk_area_px", "text_area_px")


@query("q38_image_plan", "SELECT count(*) AS n, count(DISTINCT place) AS places FROM (SELECT DISTINCT c_custkey AS place FROM customer WHERE c_custkey % 10 <> 0), (SELECT unnest([90, 270]) AS o) WHERE NOT (place % 7 = 0 AND o = 90)")
def q38(spark, d):
    """Images to fetch: places with heading offsets, less those that are listed."""
    c = F.col("c_custkey")
    places = table(spark, d, "customer").select(c.cast("string").alias("place_id"), F.lit(0.0).alias("bearing"), F.when(c % 10 != 0, "OK").otherwise("ZERO_RESULTS").alias("status"))
    done = table(spark, d, "customer").where(c % 7 == 0).select(F.format_string("img/%s_090.jpg", c.cast("string")).alias("path"))
    plan = detect.plan_images(places, done, [90.0, 270.0], "img")
    return plan.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("place_id").alias("places"))


@query(
    "q42_domain_total",
    """
    WITH u AS (SELECT l_orderkey AS k, l_partkey % 5 AS part, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), s AS (SELECT k, sum(v) AS s, count(*) AS n, max(v) AS m FROM u GROUP BY 1)
    SELECT k::VARCHAR AS domain, 2020 AS year, 'islam' AS religion, CASE WHEN k % 3 = 0 THEN s + 1 ELSE s END AS "count",
      CASE WHEN k % 3 = 0 THEN 'label' WHEN k % 3 = 1 AND n >= 2 THEN 'equals rest' ELSE 'sum' END AS how FROM s WHERE NOT (k % 3 = 1 AND n < 2) AND NOT (k % 3 = 2 AND n >= 3 AND abs(2 * m - s) <= 0.01 * greatest(m, s - m))
    """,
)
def q42(spark, d):
    """A unit's total out of a table of its parts, order by order: printed by label, recognised as equal to the rest, or summed."""
    k = F.col("k")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("domain"), F.col("l_orderkey").alias("k"), F.concat(F.lit("part "), (F.col("l_partkey") % 5).cast("string")).alias("unit"), "l_quantity")
    parts = spread(lines, "domain", most=1 << 20).groupBy("domain", "k", "unit").agg(F.sum("l_quantity").alias("count"))
    sums = parts.groupBy("domain", "k").agg(F.sum("count").alias("all"), F.count(F.lit(1)).alias("n"), F.max("count").alias("m"), F.collect_list(F.struct("unit", "count")).alias("parts"))
    total = lambda name, v: F.array(F.struct(F.lit(name).alias("unit"), v.alias("count")))
    more = F.when(k % 3 == 0, total("Jumlah", F.col("all") + 1)).when((k % 3 == 1) & (F.col("n") >= 2), total("Kab. Induk", F.col("all")))
    # one part alone can't be told from its total, nor a part that happens to equal the rest
    told = sums.where(~((k % 3 == 1) & (F.col("n") < 2)) & ~((k % 3 == 2) & (F.col("n") >= 3) & (F.abs(2 * F.col("m") - F.col("all")) <= 0.01 * F.greatest("m", F.col("all") - F.col("m")))))
    rows = told.select("domain", F.lit(2020).alias("year"), F.lit("islam").alias("religion"), F.inline(F.coalesce(F.concat("parts", more), "parts")))
    return ingest.domain_total(rows, "domain", "unit")


PANEL_ROWS_SQL = """
    l AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'pdf_da_pct' WHEN l_returnflag = 'N' THEN 'bps' ELSE 'pdf_da' END AS source, format('11{:02d}', l_suppkey % 50) AS unit_code, year(l_shipdate) AS year,
      ['islam', 'kristen', 'katolik', 'hindu', 'buddha', 'konghucu', 'total'][l_partkey % 7 + 1] AS religion, sum(l_quantity) AS count, l_returnflag || ':1100:' || (l_orderkey % 3) AS ref FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_partkey % 7 = 5) GROUP BY ALL),
    t AS (SELECT unit_code, year, ref, min(CASE source WHEN 'pdf_da' THEN 3 WHEN 'bps' THEN 5 ELSE 8 END) AS r, count(DISTINCT religion) AS n FROM l GROUP BY ALL),
    b AS (SELECT unit_code, year, ref FROM t QUALIFY row_number() OVER (PARTITION BY unit_code, year ORDER BY r, n DESC, ref) = 1),
    o AS (SELECT l.* FROM l JOIN b USING (unit_code, year, ref))
"""


def panel_rows(spark, d):
    """Order lines as the cells of three kinds of tables; those of one kind have no konghucu column."""
    flag = F.col("l_returnflag")
    kinds = F.array(*[F.lit(x) for x in [*labels.RELIGIONS[:6], "total"]])
    l = table(spark, d, "lineitem").where(~((flag == "N") & (F.col("l_partkey") % 7 == 5))).groupBy(  # noqa: E741
        F.when(flag == "R", "pdf_da_pct").when(flag == "N", "bps").otherwise("pdf_da").alias("source"), F.format_string("11%02d", F.col("l_suppkey") % 50).alias("unit_code"), F.year("l_shipdate").alias("year"),
        F.element_at(kinds, (F.col("l_partkey") % 7 + 1).cast("int")).alias("religion"), F.concat(flag, F.lit(":1100:"), (F.col("l_orderkey") % 3).cast("string")).alias("ref"),
    ).agg(F.sum("l_quantity").alias("count"))
    return l.withColumn("semester", F.lit(None).cast("int"))


@query(
    "q44_panel",
    f"""
    WITH {PANEL_ROWS_SQL},
    w AS (SELECT unit_code, year, max(count) FILTER (religion = 'islam') AS a, max(count) FILTER (religion = 'kristen') AS b, max(count) FILTER (religion = 'katolik') AS c, max(count) FILTER (religion = 'hindu') AS d,
      max(count) FILTER (religion = 'buddha') AS e, max(count) FILTER (religion = 'konghucu') AS f, max(count) FILTER (religion = 'total') AS total, min(source) AS sources, min(ref) AS ref FROM o GROUP BY ALL),
    p AS (SELECT *, CASE WHEN year % 3 <> 0 THEN 100 + 3 * (unit_code::INT % 50) END AS pop FROM w),
    q AS (SELECT unit_code, year, sources, ref, pop, CASE WHEN sources = 'pdf_da_pct' THEN NULL ELSE total END AS total,
      list_transform([a, b, c, d, e, f], lambda x: CASE WHEN sources = 'pdf_da_pct' THEN round_even(x / 100 * pop, 0) ELSE x END) AS v FROM p WHERE NOT (sources = 'pdf_da_pct' AND pop IS NULL)),
    k AS (SELECT *, list_filter(v, lambda x: x IS NOT NULL) AS u FROM q),
    g AS (SELECT *, CASE WHEN len(u) >= 3 AND list_sum(u) BETWEEN 99 AND 101 AND list_max(u) <= 100 THEN 'percent' WHEN len(list_filter(u, lambda x: x <> 0 AND len(list_filter(u, lambda y: y = x)) >= 4)) > 0 THEN 'placeholder'
      WHEN len(u) = 0 THEN 'no_religions' WHEN v[1] IS NULL OR v[2] IS NULL OR v[3] IS NULL THEN 'partial' ELSE '' END AS quality FROM k),
    s AS (SELECT *, CASE WHEN quality <> 'partial' THEN list_sum(u) END AS s FROM g WHERE quality IN ('partial', '')),
    x AS (SELECT unit_code, year, quality, coalesce(CASE WHEN total IS NOT NULL AND s IS NOT NULL AND NOT total / s BETWEEN 0.9 AND 1.1 THEN NULL ELSE total END, s) AS total, v[6] AS konghucu_ub, sources, ref, pop FROM s)
    SELECT unit_code, year::BIGINT AS year, quality, total, konghucu_ub, sources, ref, round(total / pop, 6) AS total_to_pop FROM x WHERE total / pop IS NULL OR total / pop BETWEEN 0.5 AND 1.5
    """,
)
def q44(spark, d):
    """The whole chain from long rows to the checked panel, percentage tables with and without a population included."""
    rows = panel_rows(spark, d)
    population = rows.select("unit_code", "year").distinct().where("year % 3 <> 0").withColumn("population", (100 + 3 * (F.col("unit_code").cast("int") % 50)).cast("double"))
    panel = harmonise.build_panel(rows, population)
    return panel.select("unit_code", F.col("year").cast("long").alias("year"), "quality", "total", "konghucu_ub", "sources", "ref", F.round("total_to_pop", 6).alias("total_to_pop"))


@query(
    "q46_lost_exact",
    f"""
    WITH {PANEL_ROWS_SQL}, c AS (SELECT unit_code, year, bool_or(religion = 'konghucu') AS has FROM o GROUP BY ALL), k AS (SELECT DISTINCT unit_code, year FROM l WHERE religion = 'konghucu')
    SELECT year::BIGINT AS year, count(*) AS n_lost FROM c JOIN k USING (unit_code, year) WHERE NOT has GROUP BY 1
    """,
)
def q46(spark, d):
    """Cells whose serving table lacks the exact count although another table has it."""
    rows = harmonise.panel_rows(panel_rows(spark, d))
    return harmonise.lost_exact(rows).select(F.col("year").cast("long").alias("year"), "n_lost")


@query(
    "q47_population_scale",
    """
    WITH l AS (SELECT l_suppkey % 20 AS ref, l_orderkey AS k, l_linenumber AS n, l_quantity * CASE WHEN l_suppkey % 4 = 1 THEN 1000 ELSE 1 END AS v, CASE l_suppkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1000 WHEN 2 THEN 1 ELSE 1000000 END AS f FROM lineitem),
    m AS (SELECT ref, median(v) AS m FROM l GROUP BY 1)
    SELECT k, n::BIGINT AS n, v * CASE WHEN f > 1 AND m * f > 7e6 AND m <= 7e6 THEN 1 ELSE f END AS population FROM l JOIN m USING (ref)
    """,
)
def q47(spark, d):
    """Populations times their unit of count, unless a series is in persons already."""
    k = F.col("l_suppkey") % 4
    unit = F.when(k <= 1, "Ribu").when(k == 2, "Jiwa").otherwise("Juta Jiwa")
    l = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("ref"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), (F.col("l_quantity") * F.when(k == 1, 1000.0).otherwise(1.0)).alias("v"), unit.alias("unit"))  # noqa: E741
    return harmonise.scale_populations(l, "ref", "v", numbers.unit_scale("unit", F.lit(""))).select("k", "n", "population")


CODES = [
    ("1201", "Kab. Nias"), ("1271", "Kota Sibolga"), ("3204", "Bandung"), ("3273", "Kota Bandung"), ("6302", "Kotabaru"), ("9107", "Sorong"), ("9171", "Kota Sorong"), ("7471", "Kota Kendari"), ("3101", "Kepulauan Seribu"), ("8171", "Kota Ambon"), ("8101", "Maluku Tenggara Barat"),
]
PLACES = [
    ("Sumatera Utara", "Kabupaten Nias", "1201"), ("Sumatera Utara", "Kota Sibolga", "1271"), ("Jawa Barat", "Kabupaten Bandung", "3204"), ("Jawa Barat", "Kota Bandung", "3273"), ("Jawa Barat", "Bandung", "3204"), ("Kalimantan Selatan", "Kota Baru", "6302"),
    ("Papua Barat Daya", "Kabupaten Sorong", "9107"), ("Papua Barat Daya", "Kota Sorong", "9171"), ("PROVINSI SULAWESI TENGGARA", "Kendari", "7471"), ("Daerah Khusus Ibukota Jakarta", "Kep. Seribu", "3101"), ("Maluku", "Kepulauan Tanimbar", "8101"), ("Maluku", "Nowhere", None), (None, "Ambon", "8171"),
]


@query(
    "q50_foreign_allocation",
    """
    WITH c AS (SELECT c_custkey AS k, c_custkey % 5 AS t, (c_custkey % 97)::DOUBLE AS n FROM customer WHERE c_custkey % 5 <> 4),
    x AS (SELECT * FROM (VALUES ('3204', 0.75::DOUBLE), ('3273', 0.25::DOUBLE)) v(u, w))
    SELECT k, '1201' AS unit_code, n AS "count", false AS allocated FROM c WHERE t = 0 UNION ALL SELECT k, NULL, n, false FROM c WHERE t IN (1, 3) UNION ALL SELECT k, u, n * w, true FROM c, x WHERE t = 2
    """,
)
def q50(spark, d):
    """Foreign residents at unit level: districts by name, offices by a crosswalk of weights."""
    rows = each_customer(spark, d, [("12", "Kabupaten Nias", "kabupaten"), ("32", "Bandung Raya", "kecamatan"), ("32", "Kantor Imigrasi Kelas I Bandung", "kanim"), ("32", "Kanim Nowhere", "kanim"), ("32", "Jawa Barat", "province")], "province_code string, region_name string, region_level string")
    rows = rows.withColumn("count", (F.col("c_custkey") % 97).cast("double"))
    cross = values(spark, [("bandung", "3204", 3.0), ("bandung", "3273", None)], "kanim_norm string, unit_code string, weight double")
    out = matching.allocate_foreign(rows, values(spark, CODES, "unit_code string, unit_name string"), cross)
    return out.select(F.col("c_custkey").alias("k"), "unit_code", "count", "allocated")


@query(
    "q51_foreign_panel",
    """
    WITH r AS (SELECT format('{:02d}', l_suppkey % 30 + 11) || '01' AS unit_code, year(l_shipdate) AS year, ['CHN', 'WNA', 'TOTAL', 'JPN'][l_partkey % 4 + 1] AS nat, ['ITAS', 'ITAP', NULL][l_orderkey % 3 + 1] AS permit, l_quantity AS n, l_returnflag AS source FROM lineitem),
    p AS (SELECT format('{:02d}', s_suppkey % 30 + 11) AS province_code, 1995 AS year, sum(s_suppkey)::DOUBLE AS chn_province_any FROM supplier GROUP BY 1)
    SELECT unit_code, r.year::BIGINT AS year, sum(n) FILTER (nat = 'CHN' AND permit = 'ITAP') AS chn_itap, sum(n) FILTER (nat = 'CHN' AND permit = 'ITAS') AS chn_itas, sum(n) FILTER (nat = 'CHN') AS chn_any, sum(n) FILTER (nat = 'WNA') AS wna_resident,
      sum(n) FILTER (nat = 'TOTAL') AS foreign_total, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, any_value(chn_province_any) AS chn_province_any
    FROM r LEFT JOIN p ON p.province_code = left(unit_code, 2) AND p.year = r.year GROUP BY unit_code, r.year
    """,
)
def q51(spark, d):
    """Foreign residents by unit and year, a column a permit, with what the province has."""
    pick = lambda column, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col(column) % len(v) + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(
        F.format_string("%02d01", F.col("l_suppkey") % 30 + 11).alias("unit_code"), F.year("l_shipdate").alias("year"), pick("l_partkey", "CHN", "WNA", "TOTAL", "JPN").alias("nationality"),
        pick("l_orderkey", "ITAS", "ITAP", None).alias("permit_type"), F.col("l_quantity").alias("count"), F.col("l_returnflag").alias("source"),
    )
    province = table(spark, d, "supplier").select(F.format_string("%02d", F.col("s_suppkey") % 30 + 11).alias("province_code"), F.lit(1995).alias("year"), F.lit("CHN").alias("nationality"), F.col("s_suppkey").cast("double").alias("count"))
    out = harmonise.foreign_panel(rows, province).withColumn("year", F.col("year").cast("long"))
    return out.select("unit_code", "year", "chn_itap", "chn_itas", "chn_any", "wna_resident", "foreign_total", "sources", "chn_province_any")


@query(
    "q52_census_shares",
    """
    WITH c AS (SELECT CASE WHEN c_custkey % 7 <> 0 THEN 'u' || c_nationkey END AS unit_code, c_custkey AS pop, c_custkey % 10 AS chinese, c_name AS label FROM customer)
    SELECT unit_code, sum(pop)::BIGINT AS pop, sum(chinese)::BIGINT AS chinese, min(label) AS label, round(sum(chinese) / sum(pop), 9) AS chinese_share FROM c WHERE unit_code IS NOT NULL GROUP BY 1
    """,
)
def q52(spark, d):
    """Census units that share a code as one, shares taken anew."""
    c = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.when(c % 7 != 0, F.concat(F.lit("u"), F.col("c_nationkey").cast("string"))).alias("unit_code"), c.alias("pop"), (c % 10).alias("chinese"), F.col("c_name").alias("label"))
    return matching.summed_shares(rows, ["pop", "chinese"], {"chinese_share": ("chinese", "pop")}, "label").withColumn("chinese_share", F.round("chinese_share", 9))


LONG_SQL = """
    c AS (SELECT o_custkey AS u, year(o_orderdate) AS t, count(*)::DOUBLE AS y, 1000 + sum(floor(o_totalprice / 100)) AS pop FROM orders GROUP BY ALL),
    i AS (SELECT o_custkey AS u, year(l_shipdate) AS t, sum(floor(l_extendedprice)) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY ALL)
"""


def long_tables(spark, d):
    """Customers as units: their orders as counts, their spending as population, returned lines as investment."""
    orders = table(spark, d, "orders")
    panel = orders.groupBy(F.col("o_custkey").alias("unit_code"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).cast("double").alias("n"), (1000 + F.sum(F.floor(F.col("o_totalprice") / 100))).cast("double").alias("population"))
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    investment = lines.groupBy(F.col("o_custkey").alias("unit_code"), F.year("l_shipdate").alias("year")).agg(F.sum(F.floor("l_extendedprice")).cast("double").alias("value"))
    return panel.withColumn("ref", F.lit("a:1")), investment


@query(
    "q53_long_difference",
    f"""
    WITH {LONG_SQL},
    w AS (SELECT a.u, 1000 * (b.y - a.y) / a.pop AS y, 1000 * a.y / a.pop AS s, ln(a.pop) AS p, ln(1 + coalesce((SELECT sum(v) FROM i WHERE i.u = a.u AND i.t BETWEEN 1997 AND 1999), 0)) AS t,
      ln(1 + coalesce((SELECT sum(v) FROM i WHERE i.u = a.u AND i.t <= 1996), 0)) AS b FROM c a JOIN c b ON a.u = b.u AND a.t = 1996 AND b.t = 1999),
    m AS (SELECT y - avg(y) OVER () AS y, s - avg(s) OVER () AS s, p - avg(p) OVER () AS p, t - avg(t) OVER () AS t, b - avg(b) OVER () AS b, count(*) OVER () AS n FROM w),
    m1 AS (SELECT *, s - b * sum(s * b) OVER () / sum(b * b) OVER () AS s1, p - b * sum(p * b) OVER () / sum(b * b) OVER () AS p0, t - b * sum(t * b) OVER () / sum(b * b) OVER () AS t0 FROM m),
    m2 AS (SELECT *, p0 - s1 * sum(p0 * s1) OVER () / sum(s1 * s1) OVER () AS p1, t0 - s1 * sum(t0 * s1) OVER () / sum(s1 * s1) OVER () AS t1 FROM m1),
    m3 AS (SELECT *, t1 - p1 * sum(t1 * p1) OVER () / sum(p1 * p1) OVER () AS t2 FROM m2),
    e AS (SELECT *, y - b * sum(y * b) OVER () / sum(b * b) OVER () - s1 * sum(y * s1) OVER () / sum(s1 * s1) OVER () - p1 * sum(y * p1) OVER () / sum(p1 * p1) OVER () - t2 * sum(y * t2) OVER () / sum(t2 * t2) OVER () AS e,
      1 / n + b * b / sum(b * b) OVER () + s1 * s1 / sum(s1 * s1) OVER () + p1 * p1 / sum(p1 * p1) OVER () + t2 * t2 / sum(t2 * t2) OVER () AS h FROM m3)
    SELECT round(sum(y * t2) / sum(t2 * t2), 7) AS beta, round(sqrt(sum((t2 * e / (1 - h)) ** 2)) / sum(t2 * t2), 7) AS se, count(*)::BIGINT AS n, 'HC3' AS se_kind FROM e
    """,
)
def q53(spark, d):
    """The long difference: change at fixed population on the log flow, given log stock, level and log population."""
    panel, investment = long_tables(spark, d)
    fit = estimate.long_difference(estimate.two_period(panel, "n", 1996, 1999), investment, "change_fixedpop", 1996, 1999, per_head=False).row("treat")
    return values(spark, [(round(fit["beta"], 7), round(fit["se"], 7), fit["n"], fit["se_kind"])], "beta double, se double, n long, se_kind string")


@query(
    "q54_two_way_effects",
    f"""
    WITH {LONG_SQL},
    r AS (SELECT u, t, 1000 * y / pop AS y, ln(pop) AS p, ln(1 + coalesce((SELECT sum(v) FROM i WHERE i.u = c.u AND i.t <= c.t), 0)) AS x, (t = 1996)::INT::DOUBLE AS d FROM c WHERE t IN (1995, 1996)),
    k AS (SELECT * FROM r QUALIFY count(*) OVER (PARTITION BY u) = 2),
    m AS (SELECT u, y - avg(y) OVER w AS y, p - avg(p) OVER w AS p, x - avg(x) OVER w AS x, d - avg(d) OVER w AS d FROM k WINDOW w AS (PARTITION BY u)),
    m1 AS (SELECT *, p - d * sum(p * d) OVER () / sum(d * d) OVER () AS p1, x - d * sum(x * d) OVER () / sum(d * d) OVER () AS x0 FROM m),
    m2 AS (SELECT *, x0 - p1 * sum(x0 * p1) OVER () / sum(p1 * p1) OVER () AS x1 FROM m1),
    e AS (SELECT *, y - d * sum(y * d) OVER () / sum(d * d) OVER () - p1 * sum(y * p1) OVER () / sum(p1 * p1) OVER () - x1 * sum(y * x1) OVER () / sum(x1 * x1) OVER () AS e, count(*) OVER () AS n FROM m2),
    g AS (SELECT u, sum(x1 * e) AS s FROM e GROUP BY u), v AS (SELECT sum(s * s) AS v, count(*) AS g FROM g)
    SELECT round(sum(y * x1) / sum(x1 * x1), 7) AS beta, round(sqrt(any_value(v) * any_value(g) / (any_value(g) - 1) * (any_value(n) - 1) / (any_value(n) - 4)) / sum(x1 * x1), 7) AS se, any_value(n)::BIGINT AS n, 'cluster' AS se_kind FROM e, v
    """,
)
def q54(spark, d):
    """Unit and year effects: the share on the log stock of investment and the log of population, errors by unit."""
    panel, investment = long_tables(spark, d)
    fit = estimate.two_way_effects(panel, investment, "n", 1995, 1996, per_head=False).row("_x")
    return values(spark, [(round(fit["beta"], 7), round(fit["se"], 7), fit["n"], fit["se_kind"])], "beta double, se double, n long, se_kind string")


@query(
    "q55_yearbooks",
    """
    WITH p AS (SELECT p_partkey AS k, p_size + p_partkey % 90 + 1 AS a, (p_retailprice * 100)::BIGINT % 50 + 3 AS b, CASE WHEN p_partkey % 2 = 0 THEN 'total' ELSE 'sum of rows' END AS outcome FROM part)
    SELECT k::VARCHAR AS book, outcome, 'islam' AS religion, a::DOUBLE AS "count" FROM p UNION ALL SELECT k::VARCHAR, outcome, 'hindu', b::DOUBLE FROM p
    """,
)
def q55(spark, d):
    """Religion totals of yearbook tables, a book a part: rows of parts, with and without a printed total."""
    k, cents = F.col("p_partkey"), F.round(F.col("p_retailprice") * 100).cast("long") % 50
    row = lambda name, a, b: F.array(F.lit(name), a.cast("string"), b.cast("string"))
    a, b = F.col("p_size"), k % 90 + 1
    rows = F.array(F.array(F.lit("Kecamatan"), F.lit("Islam\nMoslem"), F.lit("dHindu\ni")), row("1. Aek", a, cents), row("2. Bah", b, F.lit(3)))
    rows = F.when(k % 2 == 0, F.concat(rows, F.array(row("Jumlah/Total", a + b, cents + 3)))).otherwise(rows)
    cells = spread(table(spark, d, "part"), "p_partkey").select(k.cast("string").alias("book"), F.lit(0).alias("table_no"), F.posexplode(rows).alias("row_no", "cells"), F.lit("Penduduk menurut agama").alias("text"))
    return yearbook.book_totals(cells)


from . import catalog_labels, catalog_tables  # noqa: E402, F401  they register their own queries
