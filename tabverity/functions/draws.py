"""Draws that belong to a row: a function of its number, a stream and a seed, whatever batch or task it is made in."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Points of the normal distribution between which its function is linear, down to the lower tail that is told apart.
_Z = np.linspace(-8.5, 0.0, 17001)
_P = np.array([NormalDist().cdf(z) for z in _Z])


def cdf(z: np.ndarray) -> np.ndarray:
    """Normal distribution function; both tails as exact as the lower one."""
    low = np.interp(-np.abs(z), _Z, _P)
    return np.where(z > 0, 1.0 - low, low)


def quantile(u: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution function."""
    low = np.interp(np.minimum(u, 1.0 - u), _P, _Z)
    return np.where(u > 0.5, -low, low)


def uniform(row: Column, stream: int, seed: int) -> Column:
    """A number in 0..1 for each row number, without the ends."""
    bits = F.shiftrightunsigned(F.xxhash64(row, F.lit(stream), F.lit(seed)), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


@pandas_udf(DoubleType())
def normal_cdf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for z in parts:
        yield pd.Series(cdf(z.to_numpy(dtype=float)))


@pandas_udf(DoubleType())
def normal_quantile(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for u in parts:
        yield pd.Series(quantile(u.to_numpy(dtype=float)))
