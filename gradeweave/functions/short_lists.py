"""Scores of ranked lists of usual length, a whole Arrow batch at a time."""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# Send this module's functions with the job: workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Items up to which counting all pairs takes less time than merging.
FEW = 32
METRICS = ("ndcg", "pairacc", "top1_acc")


def _scores(rates: np.ndarray, ranked: np.ndarray) -> list[np.ndarray]:
    """NDCG, pair and top-1 accuracy of rows of one length: their rates as given, and as ranked."""
    width = rates.shape[1]
    discount = np.log2(np.arange(2.0, width + 2.0))
    got = ((np.power(2.0, ranked) - 1.0) / discount).sum(axis=1)
    ideal = ((np.power(2.0, np.sort(rates, axis=1)[:, ::-1]) - 1.0) / discount).sum(axis=1)
    ndcg = np.where(ideal == 0, 1.0, got / np.where(ideal == 0, 1.0, ideal))
    right, wrong = np.zeros(len(rates)), np.zeros(len(rates))
    for i in range(width - 1):
        right += (ranked[:, i + 1 :] < ranked[:, i : i + 1]).sum(axis=1)
        wrong += (ranked[:, i + 1 :] > ranked[:, i : i + 1]).sum(axis=1)
    unequal = right + wrong
    pairs = np.where(unequal == 0, 1.0, right / np.maximum(unequal, 1.0))
    best = rates.max(axis=1)
    hit = (rates.min(axis=1) == best) | (ranked[:, 0] == best)
    return [ndcg, pairs, hit.astype(float)]


@F.arrow_udf(StructType([StructField(name, DoubleType()) for name in METRICS]))
def short_metrics(ids: pa.Array, rates: pa.Array) -> pa.Array:
    """The metrics of rankings, named by numbers from 1, against the rates.

    Null each where the numbers are not as many as the rates. A null struct where the list is
    longer than FEW or has a rate that is null or no number: those are left to the caller.
    """
    id_from, rate_from = (a.offsets.to_numpy() for a in (ids, rates))
    numbers = ids.values.to_numpy(zero_copy_only=False)
    values = rates.values.to_numpy(zero_copy_only=False).astype(float)
    size = np.diff(rate_from)
    both = ids.is_valid().to_numpy(zero_copy_only=False) & rates.is_valid().to_numpy(zero_copy_only=False)
    read = both & (np.diff(id_from) == size) & (size > 0)
    odd = np.concatenate([[0], np.cumsum(np.isnan(values))])
    short = (size <= FEW) & (odd[rate_from[1:]] == odd[rate_from[:-1]])
    out = np.zeros((len(METRICS), len(size)))
    with np.errstate(all="ignore"):
        for width in np.unique(size[read & short]):
            rows = np.flatnonzero(read & short & (size == width))
            places = np.arange(width)
            given = values[rate_from[rows][:, None] + places]
            order = numbers[id_from[rows][:, None] + places].astype(np.int64) - 1
            out[:, rows] = _scores(given, np.take_along_axis(given, order, axis=1))
    columns = [pa.array(column, mask=~(read & short)) for column in out]
    return pa.StructArray.from_arrays(columns, names=list(METRICS), mask=pa.array(read & ~short))
