"""From places to sign panels: what to fetch, what to read, what it says."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import parse_polygon, polygon_area
from ..functions.signs import count_cjk, score_sign, script_of
from ..operators.relational import first_n
from ..sources.readers import image_path

BOXES = "path string, place_id string, heading int, box_idx int, text string, conf double, bbox string, script_hint string, status string"


def plan_images(places: DataFrame, done: DataFrame, offsets: list[float], folder: str, most: int | None = None) -> DataFrame:
    """Images still to fetch: every place with every heading offset, less what is listed already; at most ``most``.

    ``places``: place_id, bearing, status; ``done``: path. Headings are bearing + offset modulo 360.
    """
    rows = places.where("status = 'OK'").dropDuplicates(["place_id"]).select("place_id", "bearing", F.explode(F.array(*[F.lit(float(o)) for o in offsets])).alias("offset"))
    rows = rows.withColumn("heading", F.pmod(F.coalesce("bearing", F.lit(0.0)) + F.col("offset"), F.lit(360.0)))
    rows = rows.withColumn("path", image_path(folder, F.col("place_id"), F.col("heading"))).join(done.select("path"), "path", "left_anti")
    return rows.orderBy("path").limit(most) if most is not None else rows


def read_boxes(images: DataFrame, detector: Callable[[str], list[dict]]) -> DataFrame:
    """Text boxes of every image by a pluggable detector; an image that fails has a row with its error and no box.

    ``images``: path, place_id, heading. A detector takes a path and returns dicts of text,
    conf, bbox ('x,y;...') and script_hint. An image without boxes has one row with null text.
    """
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for path, place, heading in zip(pdf["path"], pdf["place_id"], pdf["heading"], strict=True):
                try:
                    found, status = detector(path), "ok"
                except Exception as e:  # noqa: BLE001  recorded, and the rest goes on
                    found, status = [], f"error: {type(e).__name__}"
                rows = [(path, place, int(heading), i, b["text"], float(b["conf"]), b["bbox"], b.get("script_hint"), status) for i, b in enumerate(found)]
                out += rows or [(path, place, int(heading), -1, None, None, None, None, status)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BOXES.split(", ")])

    return images.select("path", "place_id", "heading").mapInPandas(run, BOXES)


def describe_boxes(boxes: DataFrame) -> DataFrame:
    """Characters, Han characters, script and area of every box."""
    text = F.coalesce("text", F.lit(""))
    return boxes.where("text is not null").withColumns({
        "n_chars": F.length(text), "n_cjk": count_cjk(text), "is_cjk": count_cjk(text) > 0, "script": script_of(text, F.col("script_hint")), "area_px": polygon_area(parse_polygon("bbox")),
    })


def classify_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes with sign_type, sign_score and sign_reasons; only boxes with Han characters get a type.

    The other texts of the same image speak for or against it. One image's texts are collected,
    which its number of boxes bounds.
    """
    beside = boxes.where(~F.col("is_cjk")).groupBy("path").agg(F.array_sort(F.collect_list("text")).alias("_beside"))
    joined = boxes.join(beside, "path", "left")
    empty = F.expr("cast(array() as array<string>)")
    scored = F.when(F.col("is_cjk"), score_sign(F.col("text"), F.col("script"), F.coalesce("_beside", empty)))
    return joined.withColumn("_s", scored).select(*boxes.columns, "_s.sign_type", "_s.sign_score", "_s.sign_reasons")


def type_counts(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images with the number of boxes of each sign type; absent is zero."""
    counts = boxes.where("sign_type is not null").groupBy("path").pivot("sign_type", ["local", "mainland", "ambiguous"]).count()
    named = counts.select("path", *[F.col(k).alias(f"n_{k}_boxes") for k in ("local", "mainland", "ambiguous")])
    return images.join(named, "path", "left").na.fill(0, [f"n_{k}_boxes" for k in ("local", "mainland", "ambiguous")])


def validation_sample(images: DataFrame, n_hits: int, n_blank: int, seed: int = 0) -> DataFrame:
    """Images for hand labels: so many with and without Han boxes, by hash, in shuffled order."""
    rows = images.withColumn("stratum", F.col("n_cjk_boxes") > 0)
    order = (F.xxhash64("path", F.lit(seed)), F.col("path"))
    picked = first_n(rows.where("stratum"), ["stratum"], n_hits, *order).unionByName(first_n(rows.where("not stratum"), ["stratum"], n_blank, *order))
    return picked.orderBy(F.xxhash64("path", F.lit(seed + 1)))
