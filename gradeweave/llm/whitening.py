"""Whitening of embeddings by spectrum slicing.

Spark makes the exact integer vectors, the distinct ones of these, their sums and their
covariance; what reaches the driver is one number per pair of dimensions. There LDL^T
factors of the covariance minus a shift are counted: by Sylvester's law, as many pivots are
positive as eigenvalues lie above the shift. Halving by these counts isolates an eigenvalue,
Rayleigh quotient iteration converges to it, and two more counts certify its number. Tasks
then project the rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of the contract: entries become floor(64 c) + 1000000; at most 16 components.
SCALE, SHIFT, MOST = 64, 1_000_000, 16
#: Scaled entries are held within this, so that they are whole numbers a double can hold.
LIMIT = float(1 << 52)
#: Pivot rule of symmetric indefinite factors: (1 + sqrt 17) / 8.
PIVOT = (1 + 17**0.5) / 8
EPS = float(np.finfo(np.float64).eps)
SAFE = 1 << 62


def finite(vector: Column) -> Column:
    """Is the vector there, without null, NaN or infinite entries?"""
    usual = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(F.forall(vector, usual), F.lit(False))


def whole_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x): the rows whose vector is finite, with its entries as whole numbers."""
    value = F.col(vector).cast("array<double>")
    held = lambda c: F.greatest(F.least(c * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))
    whole = F.transform(value, lambda c: F.floor(held(c)).cast("bigint") + SHIFT)
    return rows.where(finite(value)).select(F.col(key).alias("key"), whole.alias("x"))


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """A batch's vectors as rows of one int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def exact_sum(matrix: np.ndarray, axis: int) -> np.ndarray:
    """Sums that cannot overflow: in machine words where these suffice, else in Python's integers."""
    most = max(abs(int(matrix.max(initial=0))), abs(int(matrix.min(initial=0))))
    return matrix.sum(axis=axis) if most * matrix.shape[axis] < SAFE else matrix.astype(object).sum(axis=axis)


def from_mean(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """n * x - S, exactly."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most < SAFE and max(map(abs, sums)) < SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x, n, sums) -> np.ndarray:
    """x - S / n, rounded once."""
    return (from_mean(x, n, sums) / n).astype(np.float64)


def sum_batches(width):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column("x"), width)
                total = [str(int(v)) for v in exact_sum(x, 0)]
                yield pa.RecordBatch.from_pydict({"dim": list(range(width)), "total": total, "rows": [len(x)] * width})

    return run


def gram_batches(width, project):
    """Sums over a task's rows of the products of every two columns of `project(x)`."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = project(matrix_of(batch.column("x"), width))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_pydict({"i": i[part], "j": j[part], "value": total[i[part], j[part]]})

    return run


def covariance(fit: DataFrame, width: int, n: int, project, size: int) -> np.ndarray:
    """Covariance, divisor n, of the centred columns that `project` makes of the fit list's vectors."""
    parts = fit.select("x").mapInArrow(gram_batches(width, project), "i bigint, j bigint, value double")
    # One row per pair of dimensions, however many vectors.
    sums = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((size, size))
    for row in sums:
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["value"] / n
    return out


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed the shift: the positive pivots of LDL^T of matrix - shift."""
    a = matrix - shift * np.eye(len(matrix))
    count = 0
    while len(a):
        diagonal = np.abs(a.diagonal())
        off = np.abs(a)
        np.fill_diagonal(off, 0.0)
        p = int(diagonal.argmax())
        if diagonal[p] == 0 and not off.any():
            return count
        if diagonal[p] >= PIVOT * off.max():
            count += bool(a[p, p] > 0)
            pivots = [p]
        else:  # a pivot of two rows has one eigenvalue on either side of zero
            count += 1
            pivots = list(divmod(int(off.argmax()), len(a)))
        rest = np.delete(np.arange(len(a)), pivots)
        side = a[np.ix_(rest, pivots)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivots, pivots)], side.T)
        a = (a + a.T) / 2
    return count


def towards(matrix, shift, vector, found):
    """One step of inverse iteration, kept off the eigenvectors found before."""
    identity = np.eye(len(matrix))
    try:
        vector = np.linalg.solve(matrix - shift * identity, vector)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        vector = np.linalg.solve(matrix - (shift + EPS * np.abs(matrix).max()) * identity, vector)
    vector = vector / np.abs(vector).max()
    for _ in range(2):
        for other in found:
            vector = vector - (other @ vector) * other
    return vector / np.linalg.norm(vector)


def refined(matrix, low, high, found, small):
    """(value, vector) of Rayleigh quotient iteration from the middle of the bracket, or None."""
    vector = np.cos(np.arange(len(matrix)) * 1.7 + len(found))
    for _ in range(2):
        vector = towards(matrix, (low + high) / 2, vector, found)
    for _ in range(16):
        value = float(vector @ matrix @ vector)
        if np.linalg.norm(matrix @ vector - value * vector) <= small:
            return value, towards(matrix, value, vector, found)
        vector = towards(matrix, value, vector, found)
    return None


def leading(matrix: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the largest eigenvalues, at most `most`, that are above rounding.

    Every value is certified: fewer than k eigenvalues lie above it and k or more not below
    it, up to rounding. Equal eigenvalues get any orthonormal vectors.
    """
    d = len(matrix)
    size = float(np.abs(matrix).sum(axis=1).max(initial=0.0))  # no eigenvalue is beyond this
    small = 8 * d * EPS * size
    values, vectors = [], []
    while len(values) < min(most, d) and size > 0:
        k = len(values) + 1
        low, high = 0.0, (values[-1] if values else size) + small
        if count_above(matrix, small) < k:
            break
        alone = False
        while True:
            if alone or high - low <= 4 * small:
                got = refined(matrix, low, high, vectors, small)
                if got and count_above(matrix, got[0] + small) < k <= count_above(matrix, got[0] - small):
                    break
                if high - low <= small:
                    raise ArithmeticError(f"eigenvalue {k} cannot be certified")
            middle = (low + high) / 2
            above = count_above(matrix, middle)
            low, high = (middle, high) if above >= k else (low, middle)
            alone = count_above(matrix, low) == k and count_above(matrix, high) == k - 1
        values.append(got[0])
        vectors.append(got[1])
    return np.array(values), np.array(vectors).reshape(-1, d).T


def whiten_batches(width, n, sums, values, vectors, trace, error):
    scale = vectors / np.sqrt(values)
    most = len(values)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            far = from_mean(matrix_of(batch.column("x"), width), n, sums)
            white = (far / n).astype(np.float64) @ scale
            largest = max(abs(int(far.max())), abs(int(far.min())))
            if largest * largest * width < SAFE:
                deviation = (far * far).sum(axis=1).tolist()
            else:
                exact = (far.astype(object) ** 2).sum(axis=1).tolist()
                deviation = [v if v < 1 << 63 else None for v in exact]
            rows = len(far)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(np.repeat(np.arange(rows), most))),
                    pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * most, n)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), most))),
                    pa.array(white.ravel()),
                    pa.array(np.tile(values / trace, rows)),
                    pa.array(np.full(rows * most, error)),
                ],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whitened(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = MOST) -> DataFrame:
    """A row per usable row and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows with a null vector, or a null or non-finite entry, are dropped; null keys and
    repeated rows are rows like any other, and equal vectors count once in the fit. Other
    columns are not read. Vectors of another length than the most frequent one (the shorter
    of equally frequent ones) are dropped too, as are empty ones. An empty table, one distinct
    vector, or none that varies gives no rows; of fewer varying directions than `most`, as
    many components come out. Entries are held within 2^52 / 64; a deviation that a long
    cannot hold is null.
    """
    kind = dict(rows.dtypes)[key]
    schema = (
        f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    whole = whole_vectors(rows, vector, key).withColumn("_width", F.size("x")).where("_width > 0")
    fit = stored(whole.select("x", "_width").distinct(), "fit-list")
    nothing = rows.sparkSession.createDataFrame([], schema)
    usual = whole.groupBy("_width").count().orderBy(F.desc("count"), "_width").first()
    if usual is None:
        return nothing
    width = usual["_width"]
    whole, fit = whole.where(F.col("_width") == width), fit.where(F.col("_width") == width).drop("_width")

    totals = fit.mapInArrow(sum_batches(width), "dim bigint, total string, rows bigint")
    totals = totals.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows"))
    totals = totals.orderBy("dim").collect()  # a row per dimension
    n, sums = totals[0]["rows"], [int(r["total"]) for r in totals]

    matrix = covariance(fit, width, n, lambda x: centred(x, n, sums), width)
    values, vectors = leading(matrix, most)
    if not len(values):
        return nothing
    scale = vectors / np.sqrt(values)
    white = covariance(fit, width, n, lambda x: centred(x, n, sums) @ scale, len(values))
    error = float(np.abs(white - np.eye(len(values))).max())
    run = whiten_batches(width, n, sums, values, vectors, float(np.trace(matrix)), error)
    return whole.select("key", "x").mapInArrow(run, schema)


def whitening_report(rows: DataFrame) -> DataFrame:
    """`whitened` of a table of embeddings, with its key as vec_id."""
    return whitened(rows).withColumnRenamed("key", "vec_id")
