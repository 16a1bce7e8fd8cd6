"""Points along lines and in polygons, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.geo import bearing, utm_epsg, utm_forward, utm_inverse
from .relational import bounded, first_n, small


def segments(lines: DataFrame, key: str, line: str) -> DataFrame:
    """Segments of projected lines (array of x, y) with the way travelled before and after each."""
    parts = lines.select(key, F.posexplode(F.arrays_zip(F.slice(line, F.lit(1), F.size(line) - 1).alias("a"), F.slice(line, F.lit(2), F.size(line) - 1).alias("b"))).alias("seg", "s")).where(F.size(line) >= 2)
    parts = parts.select(key, "seg", "s.a", "s.b").withColumn("length", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")))
    w = Window.partitionBy(key).orderBy("seg")
    after = F.sum("length").over(w)
    return parts.withColumns({"upto": after, "since": after - F.col("length"), "total": F.sum("length").over(Window.partitionBy(key))})


def sample_lines(lines: DataFrame, key: str, line: str, spacing: float, seed: int = 0, look: float = 2.0) -> DataFrame:
    """Points every ``spacing`` along each line of a metre or more: key, point_no, x, y, bearing.

    The first lies at a hash of the key in [0, min(spacing, length)). The bearing is that of the
    step ``look`` metres ahead, or from so far behind at the end of the line.
    """
    segs = segments(lines, key, line).where("total >= 1")
    part = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    segs = segs.withColumn("start", part * F.least(F.lit(spacing), F.col("total")))

    numbered = segs.select(key, "total", "start").distinct()
    numbered = numbered.withColumn("point_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - F.col("start")) / spacing).cast("int"))))
    numbered = numbered.withColumn("d", F.col("start") + F.col("point_no") * spacing)

    def at(shift: float, name: str) -> DataFrame:
        # segments and places in one order along the line: a place lies on the last segment that begins at or before it
        way = F.least(F.greatest(F.col("d") + shift, F.lit(0.0)), F.col("total"))
        begins = segs.where("length > 0").select(key, F.col("since").alias("way"), F.lit(0).alias("kind"), F.struct("a", "b", "since", "length").alias("s"), F.lit(None).cast("int").alias("point_no"), (F.lit(look) * 0).alias("ahead"))
        places = numbered.select(key, way.alias("way"), F.lit(1).alias("kind"), F.lit(None).cast(begins.schema["s"].dataType).alias("s"), "point_no", (F.col("total") - way).alias("ahead"))
        held = F.last("s", ignorenulls=True).over(Window.partitionBy(key).orderBy("way", "kind"))
        found = begins.unionByName(places).withColumn("s", held).where("kind = 1")
        share = F.least((F.col("way") - F.col("s.since")) / F.col("s.length"), F.lit(1.0))
        x, y = (F.col(f"s.a.{c}") + share * (F.col(f"s.b.{c}") - F.col(f"s.a.{c}")) for c in ("x", "y"))
        return found.select(key, "point_no", F.struct(x.alias("x"), y.alias("y")).alias(name), (F.col("ahead") >= look).alias(f"{name}_ahead"))

    here, ahead, back = at(0.0, "p"), at(look, "q"), at(-look, "r")
    out = here.join(ahead, [key, "point_no"]).join(back, [key, "point_no"])
    dx = F.when(F.col("p_ahead"), F.col("q.x") - F.col("p.x")).otherwise(F.col("p.x") - F.col("r.x"))
    dy = F.when(F.col("p_ahead"), F.col("q.y") - F.col("p.y")).otherwise(F.col("p.y") - F.col("r.y"))
    return out.select(key, "point_no", F.round("p.x", 1).alias("x"), F.round("p.y", 1).alias("y"), F.round(bearing(dx, dy), 1).alias("bearing"))


def _rings(polygons: DataFrame, ring: str) -> Column:
    """The rings of a polygon column: an array of rings, or one ring alone. Points are struct(x, y)."""
    one = not isinstance(polygons.schema[ring].dataType.elementType, ArrayType)
    return F.array(F.col(ring)) if one else F.col(ring)


def edges_of(rings: Column) -> Column:
    """All edges of all rings as struct(a, b); a ring closes by itself."""
    return F.flatten(F.transform(rings, lambda r: F.transform(r, lambda a, i: F.struct(a.alias("a"), F.get(r, (i + 1) % F.size(r)).alias("b")))))


def edge_rows(polygons: DataFrame, unit: str, ring: str, cell: float) -> DataFrame:
    """Edges by grid row: unit, _gy, _edges, _low and _high, the grid columns that the unit spans.

    A row of the grid has the edges that enter it; they alone tell, by the even-odd rule over all rings, which
    points of the row lie inside: holes and separate parts, also those that come as further rows of their unit,
    need nothing of their own. Parts of one unit don't overlap.
    """
    grid = lambda v: F.floor(v / cell).cast("long")
    edges = polygons.select(unit, F.explode(edges_of(_rings(polygons, ring))).alias("_e"))
    spans = edges.groupBy(unit).agg(grid(F.min("_e.a.x")).alias("_low"), grid(F.max("_e.a.x")).alias("_high"))
    rows = F.sequence(grid(F.least("_e.a.y", "_e.b.y")), grid(F.greatest("_e.a.y", "_e.b.y")))
    return edges.withColumn("_gy", F.explode(rows)).groupBy(unit, "_gy").agg(F.collect_list("_e").alias("_edges")).join(spans, unit)


def _tiles(rows: DataFrame, unit: str) -> DataFrame:
    """Grid cells (_gx, _gy) that the units of ``edge_rows`` span, row by row."""
    return rows.select(unit, "_gy", F.explode(F.sequence("_low", "_high")).alias("_gx"))


def clip_lines(lines: DataFrame, key: str, line: str, polygons: DataFrame, unit: str, ring: str, cell: float) -> DataFrame:
    """The parts of lines that lie in each polygon (a ring, or rings with holes): unit, key, part (from 0), line.

    A segment meets the units whose grid cells it shares; it is cut where it crosses an edge, and the cuts whose
    middle lies inside stay. Cuts that join end to end are one part.
    """
    grid = lambda v: F.floor(v / cell).cast("long")
    segs = segments(lines, key, line).select(key, "seg", "a", "b")
    span = lambda c: F.sequence(grid(F.least(f"a.{c}", f"b.{c}")), grid(F.greatest(f"a.{c}", f"b.{c}")))
    cells = segs.withColumn("_gx", F.explode(span("x"))).withColumn("_gy", F.explode(span("y")))
    met = cells.join(bounded(_tiles(edge_rows(polygons, unit, ring, cell), unit)), ["_gx", "_gy"]).drop("_gx", "_gy").distinct()
    whole = polygons.groupBy(unit).agg(F.flatten(F.collect_list(edges_of(_rings(polygons, ring)))).alias("_edges"))
    met = met.join(bounded(whole), unit)
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")

    def crossing(e):
        p, q = e["a"], e["b"]
        ex, ey = q["x"] - p["x"], q["y"] - p["y"]
        wide = dx * ey - dy * ex
        t = F.try_divide((p["x"] - F.col("a.x")) * ey - (p["y"] - F.col("a.y")) * ex, wide)
        u = F.try_divide((p["x"] - F.col("a.x")) * dy - (p["y"] - F.col("a.y")) * dx, wide)
        return F.when((t > 0) & (t < 1) & u.between(0, 1), t)

    ends = F.array_union(F.array(F.lit(0.0), F.lit(1.0)), F.filter(F.transform("_edges", crossing), lambda t: t.isNotNull()))
    cut = met.withColumn("_t", F.array_sort(ends))
    pairs = F.transform(F.slice("_t", F.lit(1), F.size("_t") - 1), lambda t, i: F.struct(t.alias("t0"), F.get(F.col("_t"), i + 1).alias("t1")))
    pieces = cut.select(unit, key, "seg", "a", "b", "_edges", F.explode(pairs).alias("s"))
    at = lambda t: F.struct((F.col("a.x") + t * dx).alias("x"), (F.col("a.y") + t * dy).alias("y"))
    middle = at((F.col("s.t0") + F.col("s.t1")) / 2)
    own = pieces.withColumns({"x": middle["x"], "y": middle["y"]}).where(inside("_edges"))
    own = own.select(unit, key, "seg", F.col("s.t0").alias("_t0"), at(F.col("s.t0")).alias("_p"), at(F.col("s.t1")).alias("_q"))
    order = Window.partitionBy(unit, key).orderBy("seg", "_t0")
    joined = F.coalesce(F.hypot(F.lag("_q.x").over(order) - F.col("_p.x"), F.lag("_q.y").over(order) - F.col("_p.y")) < 1e-12, F.lit(False))
    own = own.withColumn("_new", (~joined).cast("int")).withColumn("part", F.sum("_new").over(order) - 1)
    steps = F.array_sort(F.collect_list(F.struct("seg", "_t0", "_p", "_q")))
    out = own.groupBy(unit, key, "part").agg(steps.alias("_s"))
    return out.select(unit, key, "part", F.concat(F.array(F.col("_s")[0]["_p"]), F.transform("_s", lambda s: s["_q"])).alias(line))


def road_points(polygons: DataFrame, roads: DataFrame, unit: str, ring: str, key: str, line: str, spacing: float = 50.0, cap: int = 300, cell: float = 0.05, seed: int = 0) -> DataFrame:
    """Points every ``spacing`` metres along the roads of each unit, at most ``cap`` by hash: unit, point_id, lat, lon, bearing.

    Rings and roads are in degrees; every unit is measured in the UTM zone of the middle of its first ring.
    """
    first = F.get(_rings(polygons, ring), F.lit(0))
    mean = lambda c: F.aggregate(F.transform(first, lambda p: p[c]), F.lit(0.0), lambda a, v: a + v) / F.size(first)
    zone = polygons.select(unit, utm_epsg(mean("x"), mean("y")).alias("_epsg"))
    parts = clip_lines(roads, key, line, polygons, unit, ring, cell).join(small(zone), unit)
    name = F.concat_ws("|", unit, key, "part")
    flat = parts.select(unit, "_epsg", name.alias("_line"), F.transform(line, lambda p: utm_forward(p["x"], p["y"], F.col("_epsg"))).alias("_xy"))
    points = sample_lines(flat, "_line", "_xy", spacing, seed).join(flat.select(unit, "_epsg", "_line"), "_line")
    place = utm_inverse("x", "y", F.col("_epsg"))
    points = points.select(unit, F.concat_ws("|", "_line", F.lpad(F.col("point_no").cast("string"), 9, "0")).alias("_key"), place.alias("_p"), "bearing")
    points = points.select(unit, "_key", F.round("_p.lat", 6).alias("lat"), F.round("_p.lon", 6).alias("lon"), F.round("bearing", 1).alias("bearing"))
    return capped_per_unit(points, unit, "_key", cap, seed).select(unit, "point_id", "lat", "lon", "bearing")


def points_in_polygons(points: DataFrame, polygons: DataFrame, unit: str, ring: str, cell: float) -> DataFrame:
    """Points (x, y, ...) with the unit that holds them: ``ring`` is a ring, or rings with holes and separate parts.

    An equi-join on grid cells finds the units near a point, one on the grid row the edges that tell. Both
    are broadcast only after a count.
    """
    grid = lambda v: F.floor(v / cell).cast("long")
    rows = edge_rows(polygons, unit, ring, cell)
    near = points.withColumns({"_gx": grid(F.col("x")), "_gy": grid(F.col("y"))}).join(bounded(_tiles(rows, unit)), ["_gx", "_gy"])
    met = near.join(bounded(rows.select(unit, "_gy", "_edges")), [unit, "_gy"])
    return met.where(inside("_edges")).select(*points.columns, unit)


def counts_in_polygons(points: DataFrame, polygons: DataFrame, unit: str, ring: str, cell: float) -> DataFrame:
    """How many points lie in each unit: unit, n; units without any have no row. ``polygons``: as for ``points_in_polygons``.

    Points at one place are one point with a number, and units with the same rings are one class, so that what is joined
    are different places and different polygons; a class's count goes to its members.
    """
    places = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_n"))
    own = polygons.groupBy(unit).agg(F.array_sort(F.collect_list(_rings(polygons, ring))).alias("_shape"))
    classes = own.groupBy("_shape").agg(F.min(unit).alias("_class"))
    parts = classes.select("_class", F.explode("_shape").alias("_rings"))
    counts = points_in_polygons(places, parts, "_class", "_rings", cell).groupBy("_class").agg(F.sum("_n").alias("n"))
    members = own.join(classes, "_shape").select(unit, "_class")
    return members.join(counts, "_class").select(unit, "n")


def inside(edges: str) -> Column:
    """Even-odd rule: does column x, y lie within the edges?"""

    def crosses(e):
        a, b = e["a"], e["b"]
        level = (a["y"] > F.col("y")) != (b["y"] > F.col("y"))
        return level & (F.col("x") < F.try_divide((b["x"] - a["x"]) * (F.col("y") - a["y"]), b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def capped_per_unit(points: DataFrame, unit: str, key: str, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` points a unit, chosen by hash, numbered in their own order."""
    own = first_n(points, [unit], cap, F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
    return own.withColumn("point_id", F.format_string("%s_%05d", F.col(unit).cast("string"), F.row_number().over(Window.partitionBy(unit).orderBy(key)) - 1))
