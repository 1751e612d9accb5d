"""Answer regions found on page images."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def region_candidates(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """P6, filter: regions(page_id, region_id, x, y, w, h) large and low enough on their page(page_id, page_w, page_h) for an answer."""
    w, h, pw, ph = (F.col(c) for c in ("w", "h", "page_w", "page_h"))
    return regions.join(pages, "page_id").where((w * h >= 0.025 * pw * ph) & (w >= 0.35 * pw) & (h >= 0.05 * ph) & (F.col("y") >= 0.10 * ph))


def padded(boxes: DataFrame) -> DataFrame:
    """P6, padding: boxes(page_id, region_id, x, y, w, h, page_w, page_h) widened by 2 % of their own width and 4 % of their own height,
    cut to whole pixels and to the page."""
    x, y, w, h, pw, ph = (F.col(c) for c in ("x", "y", "w", "h", "page_w", "page_h"))
    px, py = (w * 0.02).cast("int"), (h * 0.04).cast("int")
    return boxes.select(
        "page_id", "region_id", F.greatest(F.lit(0), x - px).alias("left"), F.greatest(F.lit(0), y - py).alias("upper"),
        F.least(pw, x + w + px).alias("right"), F.least(ph, y + h + py).alias("lower"),
    )


def overlapping_pairs(boxes: DataFrame, share: float = 0.65, cell: tuple[int, int] = (256, 128)) -> DataFrame:
    """J10, pairs: (page_id, a, b) of boxes(page_id, region_id, x, y, w, h) of one page that overlap by more than `share` (at least a half) of the
    smaller area, a before b in (y, x) order.

    An overlap of more than half of the smaller box, in either direction, holds its middle. So each box waits in the one grid cell of its middle, larger
    ones visit the cells they cover, and each pair meets once, in the cell of the smaller one's middle; boxes far apart on a page never meet.
    """
    if share < 0.5:
        raise ValueError("boxes that overlap by less than a half may not hold each other's middle")
    sized = boxes.where((F.col("w") > 0) & (F.col("h") > 0))
    cols = ("region_id", "x", "y", "w", "h")
    at = lambda c, k: F.floor(c / cell[k]).cast("int")
    small, large = (sized.select("page_id", *[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "ab")
    small = small.withColumns({"_cx": at(F.col("x_a") + F.col("w_a") / 2, 0), "_cy": at(F.col("y_a") + F.col("h_a") / 2, 1)})
    covered = lambda x, w, k: F.sequence(at(F.col(x), k), at(F.col(x) + F.col(w), k))
    large = large.withColumn("_cx", F.explode(covered("x_b", "w_b", 0))).withColumn("_cy", F.explode(covered("y_b", "h_b", 1)))
    area = {s: F.col(f"w_{s}") * F.col(f"h_{s}") for s in "ab"}
    place = {s: F.struct(F.col(f"y_{s}").alias("y"), F.col(f"x_{s}").alias("x"), F.col(f"region_id_{s}").alias("region_id")) for s in "ab"}
    smaller = F.struct(area["a"].alias("k"), place["a"].alias("p")) < F.struct(area["b"].alias("k"), place["b"].alias("p"))
    pairs = small.join(large, ["page_id", "_cx", "_cy"]).where(smaller & (place["a"] != place["b"]))

    def shared(at: str, size: str) -> F.Column:
        ends = [F.col(f"{at}_{s}") + F.col(f"{size}_{s}") for s in "ab"]
        return F.greatest(F.lit(0), F.least(*ends) - F.greatest(f"{at}_a", f"{at}_b"))

    met = pairs.where(shared("x", "w") * shared("y", "h") > share * area["a"])
    return met.select("page_id", F.least(*place.values())["region_id"].alias("a"), F.greatest(*place.values())["region_id"].alias("b"))


def suppress_regions(boxes: DataFrame, share: float = 0.65, most: int = 12) -> DataFrame:
    """Greedy in (y, x) order over all boxes of a page, as found: one that overlaps a kept one drops out, and the first `most`
    kept stay. boxes(page_id, region_id, x, y, w, h, ...); further columns stay. Of boxes that share place and id the smaller comes
    first (width, then height), so that reruns agree; one without a place in x comes last in its row and overlaps nothing.

    Boxes are read as sorted runs, and only the kept ones of the current page are held.
    """
    rows = boxes.repartition("page_id").sortWithinPartitions("page_id", F.asc_nulls_last("y"), F.asc_nulls_last("x"), F.asc_nulls_last("region_id"), "w", "h")

    def run(batches):
        page, out = None, []
        for t in batches:
            keep = []
            for p, x, y, w, h in zip(*(t.column(c).to_pylist() for c in ("page_id", "x", "y", "w", "h")), strict=True):
                if p != page:
                    page, out = p, []
                clear = len(out) < most
                known = None not in (x, y, w, h)
                for ox, oy, ow, oh in (b for b in out if None not in b) if clear and known else ():
                    both = max(0, min(x + w, ox + ow) - max(x, ox)) * max(0, min(y + h, oy + oh) - max(y, oy))
                    smaller = min(w * h, ow * oh)
                    if smaller and both / smaller > share:
                        clear = False
                        break
                if clear:
                    out.append((x, y, w, h))
                keep.append(clear)
            yield t.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def answer_regions(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """P6 and J10 in the order of the work: candidates, suppression on the boxes as found, the first 12, padding."""
    return padded(suppress_regions(region_candidates(regions, pages)))
