"""Two-dimensional range search as joins: which points lie in which boxes, and the lightest of them.

Boxes are closed; weights below the box's own count. Space is cut into cells (strategy "grid"), stripes along x
("stripe") or stripes of equally many points ("quantile"), and points meet boxes by an equality join on those, so no
strategy compares all pairs. In the grid a cell that a box covers whole answers by its lightest point and count alone;
only cells on the border are searched point by point. A stripe's boxes are held against its points by a tree. Stripes of
equally many points leave out points no lighter than any box's weight: none of them lies in a box.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Tree

SIDE = 1 << 14
STRIPE = 128
#: Points that a stripe of equally many points holds at about most.
HELD = 200_000
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _cells(low: Column, high: Column, side: int) -> Column:
    return F.sequence(F.floor(low / side), F.floor(high / side))


def _searched(placed: DataFrame, spread: DataFrame, on: list[str]) -> DataFrame:
    """(query_id, light, n): each stripe's boxes held against its points, whole numbers, by a tree."""

    def run(points: pa.Table, boxes: pa.Table) -> pa.Table:
        columns = lambda t, *names: np.stack([t[c].to_numpy() for c in names], axis=1).astype(np.int64)
        n, light, best = np.zeros(boxes.num_rows, np.int64), np.zeros(boxes.num_rows, np.int64), np.zeros((0, 3), np.int64)
        if points.num_rows and boxes.num_rows:
            tree = Tree(columns(points, "x", "y", "w"))
            limit = columns(boxes, "limit")
            some = limit[:, 0] > np.iinfo(np.int64).min  # nothing is lighter than the least number
            least = np.concatenate((columns(boxes, "x1", "y1"), np.full((len(limit), 1), np.iinfo(np.int64).min)), axis=1)
            n[some], light[some] = tree.answer(least[some], np.concatenate((columns(boxes, "x2", "y2"), limit - some[:, None]), axis=1)[some])
            best = tree.points
        hit = np.flatnonzero(n)
        found = best[light[hit]]
        return pa.table({"query_id": boxes["query_id"].take(pa.array(hit)), "w": found[:, 2], "x": found[:, 0], "y": found[:, 1], "n": n[hit]})

    of = spread.schema["query_id"].dataType.simpleString()
    # by number, as small stripes would else be put together into few tasks, however long their search takes
    many = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, spread = placed.repartition(many, *on), spread.repartition(many, *on)
    found = placed.groupBy(*on).cogroup(spread.groupBy(*on)).applyInArrow(run, f"query_id {of}, w long, x long, y long, n long")
    kind = dict(placed.dtypes)
    return found.select("query_id", F.struct(*[F.col(c).cast(kind[c]).alias(c) for c in ("w", "x", "y")]).alias("light"), "n")


def lighter_points(points: DataFrame, boxes: DataFrame, strategy: str = "grid", side: int | None = None, key: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, found, hits, x, y, weight): for each box (query_id, x1, x2, y1, y2, weight) how many points (x, y, weight)
    with less weight lie in it, and the lightest (of equally light ones the least x, then y; null where there is none).

    key names columns that points and boxes share and must agree on, such as a first byte. Empty boxes hold nothing."""
    if strategy not in ("grid", "stripe", "quantile"):
        raise ValueError(f"unknown strategy {strategy!r}")
    p = points.select(*key, F.col("x"), F.col("y"), F.col("weight").alias("w"))
    q = boxes.where("x1 <= x2 and y1 <= y2").select(*key, "query_id", "x1", "x2", "y1", "y2", F.col("weight").alias("limit"))
    inside = (F.col("x").between(F.col("x1"), F.col("x2"))) & F.col("y").between(F.col("y1"), F.col("y2")) & (F.col("w") < F.col("limit"))
    light = F.min(F.struct("w", "x", "y")).alias("light")
    if strategy == "grid":
        s = side or SIDE
        on = [*key, "cx", "cy"]
        placed = p.withColumn("cx", F.floor(F.col("x") / s)).withColumn("cy", F.floor(F.col("y") / s))
        spread = q.withColumn("cx", F.explode(_cells(F.col("x1"), F.col("x2"), s))).withColumn("cy", F.explode(_cells(F.col("y1"), F.col("y2"), s)))
        whole = (F.col("x1") <= F.col("cx") * s) & (F.col("x2") >= F.col("cx") * s + s - 1) & (F.col("y1") <= F.col("cy") * s) & (F.col("y2") >= F.col("cy") * s + s - 1)
        # a covered cell whose heaviest point is light enough is answered by its summary
        summary = placed.groupBy(*on).agg(light, F.max("w").alias("heaviest"), F.count("*").alias("n"))
        met = spread.withColumn("whole", whole).join(summary, on)
        done = met.where("whole and heaviest < limit").select("query_id", "light", "n")
        rest = met.where("not (whole and heaviest < limit) and light.w < limit").drop("light", "heaviest", "n").join(placed, on).where(inside)
        hits = done.unionByName(rest.groupBy("query_id").agg(light, F.count("*").alias("n")))
    else:
        if strategy == "stripe":
            s = side or STRIPE
            stripe = lambda x: F.floor(x / s)
        else:
            p = p.where(F.col("w") < F.lit(q.agg(F.max("limit")).first()[0]))  # one number
            many = max(side or 64, math.ceil(p.count() / HELD))
            borders = sorted(set(p.approxQuantile("x", [k / many for k in range(1, many)], min(0.001, 0.1 / many))))  # as many numbers as stripes
            array = F.array(*[F.lit(b) for b in borders]).cast("array<double>")
            stripe = lambda x: F.size(F.filter(array, lambda b: b < x))
        placed = p.withColumn("cx", stripe(F.col("x")))
        spread = q.withColumn("cx", F.explode(F.sequence(stripe(F.col("x1")), stripe(F.col("x2")))))
        if all(t in _WHOLE for df in (placed, q) for c, t in df.dtypes if c not in (*key, "query_id", "cx")):
            known = lambda df, *names: df.dropna(subset=[*key, *names])
            hits = _searched(known(placed, "x", "y", "w"), known(spread, "limit"), [*key, "cx"])
        else:
            hits = spread.join(placed, [*key, "cx"]).where(inside).groupBy("query_id").agg(light, F.count("*").alias("n"))
    best = hits.groupBy("query_id").agg(F.min("light").alias("light"), F.sum("n").alias("n"))
    out = boxes.select("query_id").join(best, "query_id", "left")
    return out.select("query_id", F.col("light").isNotNull().alias("found"), F.coalesce("n", F.lit(0)).cast("long").alias("hits"), F.col("light.x").alias("x"), F.col("light.y").alias("y"), F.col("light.w").alias("weight"))


def points_so_far(operations: DataFrame, strategy: str = "grid", side: int | None = None) -> DataFrame:
    """For each query of a log of operations (op_id, is_insert, x1, x2, y1, y2; an insert's point is x1, y1): whether a
    point that an earlier operation inserted lies in its box, how many, and the first inserted."""
    points = operations.where("is_insert").select(F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("op_id").alias("weight"))
    boxes = operations.where("not is_insert").select(F.col("op_id").alias("query_id"), "x1", "x2", "y1", "y2", F.col("op_id").alias("weight"))
    return lighter_points(points, boxes, strategy, side).withColumnsRenamed({"query_id": "op_id", "weight": "first_op"})


def describe(points: DataFrame) -> DataFrame:
    """One row: points, and the extent of x, y and weight."""
    return points.agg(F.count("*").alias("points"), *[f(c).alias(f"{n}_{c}") for c in ("x", "y", "weight") for n, f in (("least", F.min), ("greatest", F.max))])
