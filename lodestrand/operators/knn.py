"""Nearest rows of many query vectors at once, every row compared."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Queries broadcast at a time, and those of them that a task compares with a batch at a time.
QUERY_BLOCK, CHUNK = 32_768, 128


def nearest_rows(rows: DataFrame, asked: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """(asked, id, distance, rank): the k rows of least Euclidean distance to each asked vector, of ties the smaller id.

    Vectors are compared with those of their length; null and not finite ones are left out. Queries
    are broadcast in blocks of QUERY_BLOCK, and only k a query and batch are shuffled.
    """
    spark = rows.sparkSession
    held = [_known(df, ident, vector) for df in (asked, rows)]
    blocks = 1 + held[0].count() // QUERY_BLOCK
    out = spark.createDataFrame([], "asked bigint, id bigint, distance double")
    for block in range(blocks):
        part = held[0].where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        by = defaultdict(list)
        for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            by[len(v)].append((i, v))
        sent = spark.sparkContext.broadcast({n: (np.array([i for i, _ in g], np.int64), np.array([v for _, v in g], np.float64)) for n, g in by.items()})
        out = out.union(held[1].mapInArrow(_compare(sent, k), "asked bigint, id bigint, distance double"))
    best = Window.partitionBy("asked").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _known(df: DataFrame, ident: str, vector: str) -> DataFrame:
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(ident).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(F.size("vec") > 0).where(fine)


def _compare(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy()
            for n in np.unique(sizes):
                if n in sent.value:
                    part = b.take(pa.array(np.flatnonzero(sizes == n)))
                    x = part.column(1).flatten().to_numpy().reshape(-1, n)
                    yield from one(part.column(0).to_numpy(), x, *sent.value[n])

    def one(ids: np.ndarray, x: np.ndarray, names: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        long = (x * x).sum(1)
        keep = min(k, len(ids))
        for j in range(0, len(q), CHUNK):
            part = q[j : j + CHUNK]
            own = (part * part).sum(1)[:, None]
            rough = own + long - 2 * (part @ x.T)
            limit = np.partition(rough, keep - 1, axis=1)[:, keep - 1 : keep]
            # rounding of the product can't hide one of the k nearest; those left are measured exactly
            a, r = np.nonzero(rough <= limit + 1e-12 * (own + long.max()))
            exact = np.concatenate([np.sqrt(((part[a[i : i + 65_536]] - x[r[i : i + 65_536]]) ** 2).sum(1)) for i in range(0, len(a), 65_536)])
            order = np.lexsort((ids[r], exact, a))
            starts = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1]))
            place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
            won = order[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(names[j + a[won]]), pa.array(ids[r[won]]), pa.array(exact[won])], names=["asked", "id", "distance"])

    return run
