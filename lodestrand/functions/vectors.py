"""Vector arithmetic as column expressions over array<double>, and SimHash with its buckets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Seeds and sizes of the hash family.
PLANES, PLANE_SEED, HASHES, BUCKETS, BUCKET_SEED = 32, 0x9E3779B1, 2, 4096, 0xC0FFEE01


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sequential dot product; an error where lengths differ."""
    total = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    top = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    below = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (below == 0), 0.0).otherwise(top / below)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalised(v: Column) -> Column:
    """Unit length; zero and infinite vectors stay."""
    n = norm(v)
    return F.when((n > 0) & (n < float("inf")), F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def distance_score(d: Column) -> Column:
    return 1 / (1 + d)


def uniform(seed: int) -> Iterator[float]:
    """The 32-bit counter generator behind planes and buckets."""
    mask, state = 0xFFFFFFFF, seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & mask
        t = ((state ^ state >> 15) * (state | 1)) & mask
        t ^= (t + ((t ^ t >> 7) * (t | 61) & mask)) & mask
        yield (t ^ t >> 14) / 4294967296


def hyperplanes(dim: int, count: int = PLANES, seed: int = PLANE_SEED) -> list[list[float]]:
    """Unit normal vectors in single precision, one Box-Muller draw a coordinate."""
    draws = uniform(seed)
    out = []
    for _ in range(count):
        v = np.empty(dim, np.float32)
        for j in range(dim):
            u = max(1e-9, next(draws))
            v[j] = math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * next(draws))
        length = math.sqrt(sum(float(x) * float(x) for x in v)) or 1.0
        out.append([float(np.float32(float(x) / length)) for x in v])
    return out


def simhash(v: Column, planes: list[list[float]]) -> Column:
    """Bit b is set where the dot product with plane b is positive; 0 ... 2^32 - 1 as bigint, null for null and for vectors of another dimension than the planes.

    One matrix product an Arrow batch.
    """
    matrix = np.array(planes, np.float64)
    weights = 1 << np.arange(len(planes), dtype=np.int64)

    @F.pandas_udf("bigint")
    def signature(batch: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(batch), dtype="Int64", index=batch.index)
        fit = batch[batch.notna()]
        fit = fit[fit.map(len) == matrix.shape[1]]
        if len(fit):
            out.loc[fit.index] = ((np.stack(fit.to_list()).astype(np.float64) @ matrix.T > 0) * weights).sum(1)
        return out

    return signature(v)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming_cosine(d: Column, planes: int = PLANES) -> Column:
    return F.cos(F.lit(math.pi) * d / planes)


def bucket_scales(hashes: int = HASHES, seed: int = BUCKET_SEED) -> list[int]:
    draws = uniform(seed)
    scales = []
    for _ in range(hashes):
        scales.append(int(next(draws) * ((1 << 30) - 1)) | 1)
        next(draws)  # the bias, which the buckets don't use
    return scales


def buckets(signature: Column, hashes: int = HASHES, count: int = BUCKETS) -> Column:
    """One bucket per hash, from a band of the signature."""
    bits = max(1, int(math.log2(count)))
    mask = (1 << bits) - 1
    out = []
    for j, scale in enumerate(bucket_scales(hashes)):
        band = F.shiftrightunsigned(signature, (j * bits) % 32).bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(scale & mask))
        out.append((band % (count - 1) + 1).cast("int"))
    return F.array(*out)
