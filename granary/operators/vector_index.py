"""An inverted-file index of vectors: cells of a coarse k-means as folders, and searches that widen until they have enough.

The cells' centres come from a bounded sample; every vector lies in the folder of its nearest centre.  A search begins with a query's nearest cells
and doubles their number.  Every cell knows how far its vectors lie from the centre at most, so no vector of an unread cell can have a larger
cosine than that of the angle between query and centre, less the cell's radius: a query is done once its n-th best row reaches that bound
everywhere, or once the bound is under the floor.  Queries that aren't done after some rounds meet all remaining cells, which is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores
from ..sources.shared import folder_for, stored
from .blocks import AT_ONCE, PART_BYTES, best_rows, matrix, unit

SAMPLE, MOST_CELLS, ROUNDS = 65_536, 4096, 4


@dataclass
class VectorIndex:
    """Where an index's vectors lie, and its cells: ``cell, centre, radius, parts``, one row a cell, at most ``MOST_CELLS``."""

    spark: SparkSession
    folder: str
    cells: DataFrame
    count: int


def _angle(a: Column, b: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), scores.cosine(a, b))))


def built(vectors: DataFrame, cells: int | None = None, seed: int = 1) -> VectorIndex:
    """Index ``id, vector`` (ids whole, vectors of one length).  Null and zero vectors have no cosine and are left out.

    Without ``cells`` there are about as many as the square root of the rows.  The centres are fitted on at most about ``SAMPLE`` rows.
    """
    spark = vectors.sparkSession
    held = stored(vectors.select("id", "vector").where(F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0)), "vectors")
    sizes = held.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("width")).first()
    k = max(1, min(MOST_CELLS, cells or round(sizes.n**0.5)))
    if sizes.n < 2 or k < 2:
        placed = held.withColumn("cell", F.lit(0))
        centres = held.limit(1).select(F.lit(0).alias("cell"), F.col("vector").alias("centre"))
    else:
        sample = held.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / sizes.n)))
        model = KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="features", predictionCol="cell").fit(sample.select(array_to_vector("vector").alias("features")))
        placed = model.transform(held.withColumn("features", array_to_vector("vector"))).drop("features")
        centres = spark.createDataFrame([(c, [float(x) for x in v]) for c, v in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    # a part of a cell fits a group; a large cell lies in several
    rows_a_part = max(1, PART_BYTES // (8 * sizes.width))
    sized = placed.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / rows_a_part)).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(sized), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    folder = folder_for(spark, "vector-index")
    placed.select("id", "vector", "part", "cell").repartition("cell", "part").write.partitionBy("cell").parquet(folder)
    radius = placed.join(F.broadcast(centres), "cell").groupBy("cell").agg(F.max(_angle(F.col("vector"), F.col("centre"))).alias("radius"), F.max("parts").alias("parts"))
    return VectorIndex(spark, folder, stored(centres.join(radius, "cell"), "cells"), sizes.n)


def _rows(index: VectorIndex) -> DataFrame:
    return index.spark.read.schema("id long, vector array<double>, part int, cell int").parquet(index.folder)


def _searched(index: VectorIndex, asked: DataFrame, n: int, floor: float) -> DataFrame:
    """``query_id, id, score`` of the best rows in each part of the cells that ``query_id, query, cell, parts`` ask for; only their folders are read."""
    read = {r.cell for r in asked.select("cell").distinct().collect()}  # cells are at most MOST_CELLS
    dealt = asked.select("query_id", "query", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = _rows(index).where(F.col("cell").isin(*read) if read else F.lit(False))
    return dealt.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInArrow(best_rows(n, floor), "query_id long, id long, score double")


def _ordered(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """``query_id, query, cell, parts, bound, place``: all cells of every query, the nearest first, with the largest cosine that each can hold.

    The cells are a few rows that every task gets, and a batch of queries meets them in one product.
    """
    cells = index.cells.orderBy("cell").collect()
    numbers, parts = np.array([c.cell for c in cells], np.int32), np.array([c.parts for c in cells], np.int32)
    centres, radius = unit(np.array([c.centre for c in cells], float)), np.array([c.radius for c in cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = pa.Table.from_batches([batch.slice(first, AT_ONCE)])
                far = np.arccos(np.clip(unit(matrix(part["vector"])) @ centres.T, -1, 1))
                order = np.argsort(far, axis=1, kind="stable")
                bound = np.cos(np.maximum(0, np.take_along_axis(far, order, 1) - radius[order])) + 1e-6  # for the rounding of scores
                each = np.repeat(np.arange(len(far)), len(cells))
                told = part.select(["id", "vector"]).take(pa.array(each)).combine_chunks().to_batches()
                flat, done = order.ravel(), 0
                for out in told:
                    k = slice(done, done + out.num_rows)
                    place = np.tile(np.arange(1, len(cells) + 1, dtype=np.int32), len(far))
                    yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), pa.array(numbers[flat[k]]), pa.array(parts[flat[k]]), pa.array(bound.ravel()[k]), pa.array(place[k])], names)
                    done += out.num_rows

    names = ["query_id", "query", "cell", "parts", "bound", "place"]
    return queries.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, "query_id long, query array<double>, cell int, parts int, bound double, place int")


def _top(found: DataFrame, n: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n)


def approximate(index: VectorIndex, queries: DataFrame, n: int, probes: int, floor: float = -1.0) -> DataFrame:
    """``query_id, id, score, rank``: the best rows in each query's ``probes`` nearest cells."""
    asked = _ordered(index, queries).where(F.col("place") <= probes)
    return _top(_searched(index, asked, n, floor), n).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def adaptive(index: VectorIndex, queries: DataFrame, n: int, floor: float = -1.0, probes: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """``query_id, id, score, rank``: each query's ``n`` nearest other rows at or over a floor, exactly.

    The stated query set ``id, vector`` meets a cell only while the cell can still hold something for it.
    """
    cells = stored(_ordered(index, queries), "probes")
    found, first = None, 0
    for k in range(rounds + 1):
        last = probes << k if k < rounds else MOST_CELLS
        part = cells.where((F.col("place") > first) & (F.col("place") <= last))
        if found is not None:
            nth = found.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
            need = F.when(F.col("_n") >= n, F.greatest("_least", F.lit(floor))).otherwise(F.lit(floor))
            part = part.join(nth, "query_id", "left").where(F.col("bound") >= F.coalesce(need, F.lit(floor))).drop("_n", "_least")
        else:
            part = part.where(F.col("bound") >= floor)
        part = stored(part, "asked")
        if first and part.isEmpty():
            if k == rounds:
                break
            first = last
            continue
        new = _searched(index, part, n, floor)
        found = stored(_top(new if found is None else new.unionByName(found.select("query_id", "id", "score")), n), "found")
        first = last
    return found.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))
