"""Lattice groups and whitening, against brute force in numpy."""

import math

import numpy as np
import pytest

from gradeweave.llm import lattice, queries, whitening

SF_DIR = "/root/testdata/sf0.001"
EXTRA = "key long, class long, n long, cell long, component int, x array<long>, vector string, links long, copies long, first_id long"
SCHEMA = f"vec_id long, embedding array<float>, label int, {EXTRA}"


def table(spark, rows):
    return spark.createDataFrame([(*r, *([None] * 10)) for r in rows], SCHEMA).repartition(3)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def single(v):
    return None if v is None else [None if c is None else float(np.float32(c)) for c in v]


def odd_vectors():
    """Copies, near copies, a dense ball, nulls, zeros, non-finite entries, other lengths, odd ids."""
    draw = np.random.default_rng(3)
    rows, at = [], 0
    for label in (1, 2, None):
        for _ in range(40):
            base = draw.normal(size=16)
            rows.append((at, base.tolist(), label))
            for noise in (0.0, 0.01, 0.04, 0.05, 0.2):
                at += 1
                rows.append((at, (base * draw.uniform(0.5, 2) + noise * draw.normal(size=16)).tolist(), label))
            at += 1
    centre = draw.normal(size=16)
    rows += [(1000 + i, (centre + 0.11 * draw.normal(size=16)).tolist(), 1) for i in range(150)]
    rows += [(2000 + i, centre.tolist(), 1) for i in range(70)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [-0.0] * 16, 1), (3004, [1.0] * 8, 1)]
    rows += [(3005, [1.0] * 8, 1), (3006, [1.0] * 16, None), (3007, [1.0] * 16, None), (3008, [1e-30] * 16, 2)]
    rows += [(3009, [1e30] * 16, 2), (3010, [3e38] * 16, 2), (None, [2.0] * 16, 2), (None, [5.0] * 15 + [-99.0], 2)]
    rows += [(3011, [1.0] * 15 + [x], 1) for x in (None, math.nan, math.inf, -math.inf)]
    rows += [rows[0], rows[0], rows[-1]]
    return [(i, single(v), label) for i, v, label in rows]


def brute_groups(rows):
    unit, group = [], []
    for i, (_, v, label) in enumerate(rows):
        good = usable(v) and label is not None and any(v)
        a = np.array(v, np.float64) if good else None
        a = a / np.abs(a).max() if good else None
        unit.append(a / np.linalg.norm(a) if good else None)
        group.append((label, len(v)) if good else ("alone", i))
    n = len(rows)
    near = [[j for j in range(n) if j != i and group[i] == group[j] and unit[i] @ unit[j] >= 0.98] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *[label[j] for j in near[i]]]) for i in range(n)]
        if new == label:
            break
        label = new
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        smallest = min(ids, default=None)
        out.append((rows[i][0], len(near[i]), smallest, rows[i][0] == smallest))
    return out


@pytest.mark.parametrize("tile", [1024, 16])
def test_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(lattice, "TILE", tile)
    rows = odd_vectors()
    got = [tuple(r) for r in lattice.near_vectors(table(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_groups(rows)))


def test_groups_empty(spark):
    got = lattice.near_vector_report(table(spark, []))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.collect() == []


def test_recall_at_the_least_cosine(spark):
    """Pairs a hair above the cosine are found nearly always, those below never."""
    draw = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        a, b = (v / np.linalg.norm(v) for v in draw.normal(size=(2, 64)))
        b = b - (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.9801 if i < 1000 else 0.9799
        rows += [(2 * i, a.tolist(), i % 3), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), i % 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["key"]: r["n_links"] for r in lattice.near_vectors(frame).collect()}
    found = [got[2 * i] == 1 == got[2 * i + 1] for i in range(1500)]
    assert np.mean(found[:1000]) >= 0.99 and not any(got[2 * i] for i in range(1000, 1500))


def test_lattice_points():
    points = np.random.default_rng(1).normal(size=(500, 8)) * 3
    near = lattice.decode(points)
    doubled = (2 * near).astype(int)
    assert (doubled == 2 * near).all() and (np.ptp(doubled % 2, axis=1) == 0).all() and (near.sum(axis=1) % 2 == 0).all()
    assert len(np.unique(lattice.NEIGHBOURS, axis=0)) == 240 and (lattice.squares(lattice.NEIGHBOURS) == 2).all()
    # No neighbour is nearer, which for this lattice means no point at all is.
    away = lattice.squares(points[:, None] - near[:, None] - lattice.NEIGHBOURS)
    assert (away >= lattice.squares(points - near)[:, None] - 1e-12).all()


def test_cells_do_not_depend_on_the_batch():
    draw = np.random.default_rng(2)
    unit = lattice.units_of(__import__("pyarrow").array(draw.normal(size=(64, 33)).tolist()), 33)
    label = np.arange(64)
    whole = lattice.cells_of(unit, label)
    assert all((lattice.cells_of(unit[i : i + 1], label[i : i + 1]) == whole[i]).all() for i in range(64))


def check_whitened(rows, got, most=16):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in rows if usable(v)]
    width = max(sorted({len(x) for _, x in kept}), key=lambda w: sum(len(x) == w for _, x in kept))
    kept = [(i, x) for i, x in kept if len(x) == width]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    far = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    cov = far.T @ far / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    sign, seen = {}, []
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == len(kept) * len(values)
    for i, x in kept:
        for k in range(len(values)):
            r = by_id[i][k + 1]
            expected = np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ vectors[:, k] / math.sqrt(values[k])
            if abs(expected) > 1e-3:
                s = sign.setdefault(k, math.copysign(1, expected * r["whitened"]))
                assert math.isclose(expected * s, r["whitened"], rel_tol=1e-6, abs_tol=1e-9)
            assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x, sums))
            assert math.isclose(r["explained"], values[k] / np.trace(cov), rel_tol=1e-9)
            seen.append(r["identity_error"])
    assert len(set(seen)) == 1 and seen[0] <= 1e-9


def test_whitened(spark):
    rows = [r for r in odd_vectors() if r[0] is not None and not (usable(r[1]) and max(map(abs, r[1]), default=0) > 1e20)]
    rows = list({r[0]: r for r in rows}.values())
    got = whitening.whitening_report(table(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitened(rows, got.collect())


def test_whitened_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check_whitened(rows, queries.op12_sliced_whitening(spark, SF_DIR).collect())


def test_whitened_odd(spark):
    """Huge entries, repeated rows and null keys; tables without variance."""
    rows = [(1, [1e30, 0.0], 1), (2, [-1e30, 1.0], 1), (3, [0.5, 2.0], 1), (3, [0.5, 2.0], 1), (None, [0.5, 2.0], 1)]
    got = whitening.whitened(table(spark, rows)).collect()
    # Beside 1e63, the second direction is below rounding.
    assert len(got) == 5 and {r["n"] for r in got} == {3} and all(r["deviation"] is None for r in got if r["key"] != 3 and r["key"])
    assert all(math.isfinite(r["whitened"]) and r["identity_error"] < 1e-4 for r in got)
    for few in ([], [(1, None, 1)], [(1, [2.0, 1.0], 1), (2, [2.0, 1.0], 1)], [(1, [], 1)]):
        assert whitening.whitened(table(spark, few)).collect() == []
    flat = [(i, [float(i), 3.0, 2.0 * i], 1) for i in range(5)]
    got = whitening.whitened(table(spark, flat)).collect()
    assert {r["component"] for r in got} == {1} and all(math.isclose(r["explained"], 1.0) for r in got)


@pytest.mark.parametrize("values", [[5] * 3 + [2] * 4 + [1] * 23, [1e6, 1e6 * (1 - 1e-13), 1] + [0] * 27, [1e8] + [1e-3] * 10 + [0] * 19])
def test_slices_of_clustered_spectra(values):
    draw = np.random.default_rng(4)
    turn = np.linalg.qr(draw.normal(size=(30, 30)))[0]
    matrix = (turn * np.array(values)) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading(matrix)
    assert np.abs(found - values[: len(found)]).max() <= 1e-13 * values[0] * 30
    assert len(found) == min(16, sum(v > 0 for v in values))
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    for shift in (0.5, 1.5, 3, 2e6):
        assert whitening.count_above(matrix, shift) == sum(v > shift for v in values)
