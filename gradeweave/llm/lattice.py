"""Near-duplicate embeddings by hashing to points of the E8 lattice.

In each table fixed random projections bring a unit vector to two blocks of eight dimensions;
each block is decoded to its nearest lattice point, and the two points are the vector's home
cell. A vector is also entered in the neighbouring cells that it lies nearest to. Two vectors meet where one's home is entered
by the other; every meeting is verified by the cosine in double precision. A pair that meets
several times counts in its first meeting only, which a task can tell from the two vectors
alone, so pairs are never written: tasks give link counts and, for components, stars.
"""

import functools
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, stored
from .simhash import components, roots
from .whitening import finite

COSINE = 0.98
#: Tables, blocks per table, neighbouring cells entered per table, and lattice steps per unit
#: of projection. By simulation, a pair at the least cosine meets in a table with probability
#: 0.72, so in one of five at least with 0.998; two unrelated vectors meet with about 1e-5.
TABLES, BLOCKS, PROBES, STEP = 5, 2, 3, 0.6
SEED = 11
#: Rows of a cell compared at once; larger cells are cut into chunks, and all chunks meet.
TILE = 512
#: Vectors whose cells are worked out at a time, and pairs that are looked at at a time.
CACHED, PAIRS = 128, 1 << 18

CELLS = "class bigint, cell bigint, tab int, home boolean"
FOUND = "class bigint, root bigint, links bigint"


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minuses."""
    out = []
    for (i, j), (a, b) in product(combinations(range(8), 2), product((1.0, -1.0), repeat=2)):
        row = [0.0] * 8
        row[i], row[j] = a, b
        out.append(row)
    out += [s for s in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in s) % 2 == 0]
    return np.array(out)


NEIGHBOURS = shortest()


def squares(points: np.ndarray) -> np.ndarray:
    """Squared lengths along the last axis, summed in a fixed order."""
    total = np.zeros(points.shape[:-1])
    for i in range(8):
        total = total + points[..., i] * points[..., i]
    return total


def nearest_even(points: np.ndarray) -> np.ndarray:
    """The nearest whole-number points with an even sum (the lattice D8)."""
    near = np.rint(points)
    off = points - near
    worst = np.abs(off).argmax(axis=-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0)
    other = near.copy()
    np.put_along_axis(other, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return np.where((near.sum(axis=-1) % 2 != 0)[..., None], other, near)


def decode(points: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is D8 and D8 moved by one half in every entry."""
    whole, half = nearest_even(points), nearest_even(points - 0.5) + 0.5
    nearer = squares(points - whole) <= squares(points - half)
    return np.where(nearer[..., None], whole, half)


@functools.lru_cache(maxsize=8)
def projection(width: int) -> np.ndarray:
    """The tables' fixed directions for vectors of a width: (width, TABLES * BLOCKS * 8)."""
    return np.random.default_rng([SEED, width]).normal(size=(width, TABLES * BLOCKS * 8))


def nearest_moves(off: np.ndarray):
    """For points `off` their lattice point: the PROBES nearest neighbours' moves, after none,
    and what each adds to the squared distance."""
    pull = off[..., 0, None] * NEIGHBOURS[:, 0]
    for i in range(1, 8):
        pull += off[..., i, None] * NEIGHBOURS[:, i]
    best, extra = [], []
    for _ in range(PROBES):  # of equals the first
        top = pull.argmax(axis=-1)[..., None]
        best.append(top)
        extra.append(2 - 2 * np.take_along_axis(pull, top, -1))
        np.put_along_axis(pull, top, -np.inf, -1)
    none = np.zeros((*off.shape[:-1], 1))
    moves = NEIGHBOURS[np.concatenate(best, axis=-1)]
    return np.concatenate([none[..., None] * NEIGHBOURS[0], moves], axis=-2), np.concatenate([none, *extra], axis=-1)


def cells_of(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(rows, TABLES, 1 + PROBES) numbers of the cells each vector enters, its home first.

    A vector's cells depend on it alone, to the last bit: sums run in a fixed order, not in
    one that a matrix product picks by the batch's shape.
    """
    # Few at a time: what is made for them stays in the processor's cache.
    parts = [some_cells(unit[i : i + CACHED], label[i : i + CACHED]) for i in range(0, len(unit), CACHED)]
    return np.concatenate(parts) if parts else np.zeros((0, TABLES, 1 + PROBES), np.int64)


def some_cells(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    rows, width = unit.shape
    directions = projection(width)
    flat = np.zeros((rows, TABLES * BLOCKS * 8))
    for k in range(width):
        flat += unit[:, k, None] * directions[k]
    points = (flat * STEP).reshape(rows, TABLES, BLOCKS, 8)
    home = decode(points)
    moves, extra = nearest_moves(points - home)
    # A neighbouring cell moves some blocks; the nearest by what the moves add in sum, none first.
    options = np.array(list(product(range(1 + PROBES), repeat=BLOCKS)))
    cost = sum(extra[:, :, b, options[:, b]] for b in range(BLOCKS))
    chosen = options[np.argsort(cost, axis=-1, kind="stable")[..., : 1 + PROBES]]
    whole = np.zeros((rows, TABLES, 1 + PROBES, BLOCKS, 8))
    for b in range(BLOCKS):
        step = np.take_along_axis(moves[:, :, b], chosen[..., b, None], axis=2)
        whole[:, :, :, b] = home[:, :, None, b] + step
    whole = (2 * whole).astype(np.int64).view(np.uint64).reshape(rows, TABLES, 1 + PROBES, BLOCKS * 8)
    number = mixed(label.view(np.uint64) + np.uint64(width))[:, None, None]
    number = np.broadcast_to(mixed(number ^ np.arange(TABLES, dtype=np.uint64)[None, :, None]), whole.shape[:-1])
    for i in range(BLOCKS * 8):
        number = mixed(number ^ whole[..., i])
    return number.view(np.int64)


def units_of(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch in double precision, at length one."""
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def by_width(batch):
    """The batch in parts of one vector width each."""
    width = batch.column("width").to_numpy()
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        yield w, batch if len(rows) == len(width) else batch.take(pa.array(rows))


def cell_batches(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, TILE):
            for width, batch in by_width(whole.slice(at, TILE)):
                unit = units_of(batch.column("vector"), width)
                number = cells_of(unit, batch.column("label").to_numpy())
                each = TABLES * (1 + PROBES)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(batch.column("class").to_numpy(), each)),
                        pa.array(number.ravel()),
                        pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), len(unit))),
                        pa.array(np.tile(np.arange(1 + PROBES) == 0, len(unit) * TABLES)),
                    ],
                    ["class", "cell", "tab", "home"],
                )


def first_meeting(mine, other, table: int, cell) -> np.ndarray:
    """Is this table's cell the first place where the pairs meet? `mine` and `other`: their cells, row by row."""
    earlier = np.zeros(len(mine), bool)
    for t in range(table):
        for p in range(1 + PROBES):
            earlier |= (mine[:, t, 0] == other[:, t, p]) | (other[:, t, 0] == mine[:, t, p])
    # Within the table they may meet in both homes; the one of smaller number counts.
    a, b = mine[:, table, 0], other[:, table, 0]
    at_a, at_b = (a[:, None] == other[:, table]).any(axis=1), (b[:, None] == mine[:, table]).any(axis=1)
    first = np.where(at_a & at_b, np.minimum(a, b), np.where(at_a, a, b))
    return ~earlier & (first == cell)


class Rows:
    """A batch of entries, in columns, sorted by (cell, meeting)."""

    def __init__(self, batch):
        names = ("class", "cell", "tab", "side", "meeting", "label", "width", "copies")
        self.batch = batch
        for name in names:
            setattr(self, name if name != "class" else "classes", batch.column(name).to_numpy())
        self.home = batch.column("home").to_numpy(zero_copy_only=False)

    def units(self, rows):
        """Unit vectors of some rows of one width."""
        return units_of(self.batch.column("vector").take(pa.array(rows)), int(self.width[rows[0]]))

    def pairs(self, first: int, until: int):
        """Linked pairs of one run. Two chunks of a cell meet in it, or one chunk, or the whole cell."""
        rows = np.arange(first, until)
        left, right = [], []
        for width in np.unique(self.width[rows]).tolist():  # one width, as good as always
            own = rows[self.width[rows] == width]
            unit, home, label, side = self.units(own), self.home[own], self.label[own], self.side[own]
            close = unit @ unit.T >= COSINE
            close &= home[:, None] | home[None]
            close &= label[:, None] == label[None]
            if self.meeting[first] >= 0:  # two chunks: what links inside one is found where it is alone
                close &= side[:, None] != side[None]
            i, j = np.nonzero(np.triu(close, 1))
            left.append(own[i])
            right.append(own[j])
        return np.concatenate(left), np.concatenate(right)

    def found(self, left, right):
        """(class, root, links) of the linked rows; a pair counts where it meets first."""
        linked, place = np.unique(np.concatenate([left, right]), return_inverse=True)
        i, j = place[: len(left)], place[len(left) :]
        classes, one, of = np.unique(self.classes[linked], return_index=True, return_inverse=True)
        entered = np.zeros((len(classes), TABLES, 1 + PROBES), np.int64)
        sample = linked[one]
        for width in np.unique(self.width[sample]).tolist():
            own = np.flatnonzero(self.width[sample] == width)
            entered[own] = cells_of(self.units(sample[own]), self.label[sample[own]])
        links = np.zeros(len(linked), np.int64)
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            table = self.tab[linked[a]]
            for t in np.unique(table).tolist():
                x, y = a[table == t], b[table == t]
                new = first_meeting(entered[of[x]], entered[of[y]], t, self.cell[linked[x]])
                np.add.at(links, x[new], self.copies[linked[y[new]]])
                np.add.at(links, y[new], self.copies[linked[x[new]]])
        # Rows of different runs are different entries, so stars never join two runs.
        root = classes[of][roots(len(linked), i, j)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (classes[of], root, links)], ["class", "root", "links"])


def meeting_batches(batches):
    """Links of each partition's rows, sorted by (cell, meeting): each such run is compared whole."""
    held = None

    def results(rows, edges):
        left, right, held_pairs = [], [], 0
        for first, until in zip(edges[:-1], edges[1:]):
            if until - first < 2:
                continue
            i, j = rows.pairs(first, until)
            if not len(i):
                continue
            left.append(i)
            right.append(j)
            held_pairs += len(i)
            if held_pairs >= PAIRS:
                yield rows.found(np.concatenate(left), np.concatenate(right))
                left, right, held_pairs = [], [], 0
        if left:
            yield rows.found(np.concatenate(left), np.concatenate(right))

    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        rows = Rows(batch)
        new = (rows.cell[1:] != rows.cell[:-1]) | (rows.meeting[1:] != rows.meeting[:-1])
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        # The last run may go on in the next batch.
        yield from results(rows, edges)
        held = batch.slice(edges[-1])
    if held is not None and held.num_rows:
        yield from results(Rows(held), [0, held.num_rows])


def meetings(cells: DataFrame) -> DataFrame:
    """The entries of cells where two vectors meet, with the runs they are compared in.

    A cell counts if it is home to one vector and another enters it. A cell of more than a
    tile is cut into chunks by a hash. A chunk alone is a run (`meeting` below 0), and so are
    every two chunks (`meeting` from 0; `side` tells them apart).
    """
    sizes = cells.groupBy("cell").agg(F.count("*").alias("_rows"), F.count_if("home").alias("_homes"))
    sizes = sizes.where((F.col("_rows") > 1) & (F.col("_homes") > 0))
    chunks = F.ceil(F.col("_rows") / (TILE // 2)).cast("bigint")
    sizes = sizes.select("cell", F.when(F.col("_rows") > TILE, chunks).otherwise(1).alias("_chunks"))
    rows = cells.join(sizes, "cell")
    chunk = F.pmod(F.xxhash64("class"), F.col("_chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1))
    rows = rows.withColumn("side", chunk).withColumn("_other", other)
    low, high = F.least("side", "_other"), F.greatest("side", "_other")
    alone = F.col("side") == F.col("_other")
    meeting = F.when(alone, -1 - F.col("side")).otherwise(low * F.col("_chunks") + high)
    return rows.select("class", "cell", "tab", "home", "side", meeting.alias("meeting"))


def usable_vector(vector: Column, label: Column) -> Column:
    """A label, and a finite vector that is not zero? Never null."""
    return label.isNotNull() & finite(vector) & F.coalesce(F.exists(vector, lambda c: c != 0), F.lit(False))


def vector_classes(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(class, label, vector, width, first_id, copies): distinct usable vectors of a label, as a stored table.

    Copies end before the shuffle.
    """
    distinct = (
        rows.where(usable_vector(F.col(vector), F.col(label)))
        .select(F.col(label).alias("label"), F.col(vector).alias("vector"), F.col(key).alias("key"))
        .groupBy("label", "vector")
        .agg(F.min("key").alias("first_id"), F.count("*").alias("copies"))
    )
    # Numbers are given as the table is written; what reads the table sees the same ones.
    numbered = distinct.select(F.monotonically_increasing_id().alias("class"), "*", F.size("vector").alias("width"))
    return stored(numbered, "vector-classes")


def class_links(classes: DataFrame) -> DataFrame:
    """(class, root, links) of every meeting in which a class is linked: its star, and the
    rows it is linked to for the first time there."""
    hashed = classes.select("class", F.xxhash64("label").alias("label"), "vector", "width", "copies")
    cells = stored(hashed.drop("copies").mapInArrow(cell_batches, CELLS), "cells")
    rows = meetings(cells).join(hashed, "class")
    dealt = rows.repartition("cell", "meeting").sortWithinPartitions("cell", "meeting")
    return stored(dealt.mapInArrow(meeting_batches, FOUND), "class-links")


def near_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """A row per vector: key, n_links, component_id and kept.

    Vectors of one label whose cosine is at least COSINE are linked; `n_links` counts the
    other rows linked to a row, copies included, component_id is the smallest key reachable,
    `kept` tells whether it is the row's own. Rows without a label, and null, zero or
    non-finite vectors or entries, link with nothing; nor do vectors of different lengths.
    Null keys do not count in component_id, and a row that reaches null keys only has null.
    Repeated rows are copies of each other. An empty table gives no rows; other columns are
    not read.
    """
    usable = usable_vector(F.col(vector), F.col(label))
    classes = vector_classes(rows, vector, key, label)
    found = class_links(classes)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("class").alias("a"), F.col("root").alias("b"))
    rooted = components(edges).select(F.col("a").alias("class"), "root")
    named = classes.join(rooted, "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = named.join(smallest, "root").join(links, "class", "left")
    linked = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint")
    told = told.select("label", "vector", linked.alias("n_links"), "component_id")
    known = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    joined = known.where(usable).join(told, ["label", "vector"])
    # The others have no class; kept apart, their nulls are no join key.
    lone = rows.where(~usable).select(
        F.col(key).alias("key"), F.lit(0).cast("bigint").alias("n_links"), F.col(key).alias("component_id")
    )
    both = joined.select("key", "n_links", "component_id").unionByName(lone)
    return both.withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))


def near_vector_report(rows: DataFrame) -> DataFrame:
    """`near_vectors` of a table of embeddings, with its key as vec_id."""
    return near_vectors(rows).withColumnRenamed("key", "vec_id")
