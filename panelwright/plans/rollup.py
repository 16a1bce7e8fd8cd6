"""Three-level roll-up: observations to places, places to place-years, place-years to unit-years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import group_sum, safe_ratio
from ..operators.relational import first_per_key


def image_level(images: DataFrame, boxes: DataFrame, min_conf: float = 0.5) -> DataFrame:
    """One row an image with its counts and areas; images without boxes have zeros.

    ``images``: path, ...; ``boxes``: path, conf, is_cjk, area_px, script.
    """
    good = boxes.where(F.col("conf") >= min_conf)
    sums = good.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_boxes"),
        F.count_if("is_cjk").alias("n_cjk_boxes"),
        group_sum(F.when(F.col("is_cjk"), F.col("area_px")).otherwise(0.0)).alias("cjk_area_px"),
        group_sum("area_px").alias("text_area_px"),
        F.count_if(F.col("is_cjk") & (F.col("script") == "simplified")).alias("n_simplified"),
        F.count_if(F.col("is_cjk") & (F.col("script") == "traditional")).alias("n_traditional"),
    )
    out = images.join(sums, "path", "left")
    return out.na.fill(0, [c for c in sums.columns if c != "path"])


def place_level(images: DataFrame, places: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """One row a place from its good images, joined to the first good record of the place.

    ``images``: place_id, status, n_boxes, n_hits, hit_area, text_area, area and n_<kind>_boxes;
    ``places``: place_id, unit_id, point_id, year, status.
    """
    counts = ["n_boxes", "n_hits", "hit_area", "text_area", "area"] + [f"n_{k}_boxes" for k in kinds]
    sums = images.where("status = 'OK' and place_id is not null").groupBy("place_id").agg(
        F.count(F.lit(1)).alias("n_images"),
        *[group_sum(c).alias(c) for c in counts],
        F.max((F.col("n_hits") > 0).cast("int")).alias("any_hit"),
    )
    sums = sums.withColumns({"hit_share": safe_ratio("hit_area", "text_area"), "box_share": safe_ratio("n_hits", "n_boxes")})
    own = first_per_key(places.where("status = 'OK'"), ["place_id"], F.asc("year"), F.asc("point_id"))
    return own.drop("status").join(sums, "place_id")


def point_year(places: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Place rows by unit, point and year; shares from the sums, and the years a point was seen in."""
    counts = ["n_images", "n_boxes", "n_hits", "hit_area", "text_area", "area"] + [f"n_{k}_boxes" for k in kinds]
    keyed = places.where("unit_id is not null and point_id is not null and year is not null")
    out = keyed.groupBy("unit_id", "point_id", "year").agg(
        F.count(F.lit(1)).alias("n_places"), F.max("any_hit").alias("any_hit"), *[group_sum(c).alias(c) for c in counts]
    )
    seen = F.size(F.collect_set("year").over(Window.partitionBy("point_id")))
    return out.withColumns({"hit_share": safe_ratio("hit_area", "text_area"), "box_share": safe_ratio("n_hits", "n_boxes"), "n_years": seen})


def unit_year(points: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Point-years by unit and year: points, sums, and means of the points' shares."""
    extra = [c for k in kinds for c in (F.avg((F.col(f"n_{k}_boxes") > 0).cast("double")).alias(f"share_points_{k}"), F.avg(f"n_{k}_boxes").alias(f"mean_{k}_boxes"))]
    return points.groupBy("unit_id", "year").agg(
        F.count_distinct("point_id").alias("n_points"), group_sum("n_images").alias("n_images"), group_sum("n_hits").alias("n_hits"),
        F.avg("any_hit").alias("share_points_hit"), F.avg("hit_share").alias("mean_hit_share"), F.avg("box_share").alias("mean_box_share"),
        F.count_if(F.col("n_years") > 1).alias("n_points_repeated"), *extra,
    )


def classification_score(labels: DataFrame, truth: str, guess: str) -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy over rows with a label; null where nothing divides."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    cells = labels.where(F.col(truth).isNotNull()).agg(
        F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn")
    )
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return cells.withColumns({
        "precision": precision, "recall": recall, "f1": F.try_divide(2 * precision * recall, precision + recall),
        "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")),
    })
