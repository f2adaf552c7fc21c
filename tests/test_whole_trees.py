"""Operators that work on batches of whole trees, against one tree at a time and against plain loops."""

import time

import numpy as np
import pandas as pd
import pyarrow as pa

from boscage.operators import mesh, skeleton
from boscage.operators.folds import fold, whole_trees


def forest(rng, trees, most=40):
    """Random trees with cycles, second roots, unset and absent radii, and axes that may start anywhere."""
    rows = []
    for t in range(trees):
        n = int(rng.integers(1, most))
        for i in range(1, n + 1):
            parent = int(rng.integers(0, i)) if rng.random() < 0.9 else int(rng.integers(-2, n + 1))
            radius = [0.0, np.nan, 0.1 + rng.random()][int(rng.choice(3, p=[0.05, 0.05, 0.9]))]
            rows.append((t, i, parent, int(rng.integers(1, 5)), *rng.normal(size=6), radius))
    return pd.DataFrame(rows, columns=["tree_id", "cyl_ID", "parent_ID", "axis_ID", "startX", "startY", "startZ", "endX", "endY", "endZ", "radius"])


def test_batches_hold_whole_trees_wherever_they_are_cut():
    keys = pa.array([None] * 3 + [1] * 7 + [2] + [3] * 40 + [4] * 2)
    for size in (1, 2, 5, 60):
        batches = pa.Table.from_arrays([keys, pa.array(range(len(keys)))], ["tree_id", "n"]).to_batches(max_chunksize=size)
        got = [t["tree_id"].to_pylist() for t in whole_trees(iter(batches), rows=8)]
        assert sum(got, []) == keys.to_pylist()
        assert sum(len(set(g)) for g in got) == 5
    assert list(whole_trees(iter([]))) == []


def test_folds_of_many_trees_are_those_of_each():
    t = forest(np.random.default_rng(1), 60)
    columns = lambda x: (x["cyl_ID"].to_numpy(), x["parent_ID"].to_numpy(), np.abs(x["startX"].to_numpy()), x["endZ"].to_numpy(), x["radius"].to_numpy())
    for by_volume in (False, True):
        whole = fold(*columns(t), by_volume, t["tree_id"].to_numpy())
        for tree, own in t.groupby("tree_id"):
            at = (t["tree_id"] == tree).to_numpy()
            for name, x in fold(*columns(own), by_volume).items():
                got = whole[name][at]
                assert np.array_equal(np.where(got < 0, -1, got - at.argmax()) if name == "parent" else got, x), name


def plain_walk(axis):
    """Numbers of an axis's cylinders from its base on, one by one."""
    child = {}
    for i, p in zip(axis["cyl_ID"], axis["parent_ID"], strict=True):
        child.setdefault(p, i)
    now, out, seen = min(set(child) - set(axis["cyl_ID"]) or axis["cyl_ID"]), [], set()
    while now in child and now not in seen:
        seen.add(now)
        out.append(child[now])
        now = child[now]
    return out


def plain_rings(t):
    """(axis_ID, place, cyl_ID, ring, next, r, centre) by loops."""
    rows = []
    for axis, own in t.sort_values(["axis_ID", "cyl_ID"]).groupby("axis_ID"):
        walk = own.set_index("cyl_ID").loc[plain_walk(own)]
        if not len(walk):
            continue
        at, r = [walk[["startX", "startY", "startZ"]].iloc[0].tolist(), *walk[["endX", "endY", "endZ"]].to_numpy().tolist()], walk["radius"].tolist()
        r = [r[0], *((a + b) / 2 for a, b in zip(r, r[1:])), r[-1]]
        before = None
        for i, x in enumerate(at):
            if r[i] > mesh.LEAST_RADIUS:
                if before is not None:
                    rows[before][4] = len(rows)
                before = len(rows)
                rows.append([axis, i, int(walk.index[max(i - 1, 0)]), len(rows), None, r[i], *x])
            else:
                before = None
    return rows


def test_rings_of_many_trees_are_those_of_plain_loops():
    t = forest(np.random.default_rng(2), 80)
    got = mesh._rings_of_table(pa.Table.from_pandas(t, preserve_index=False), t["tree_id"].to_numpy()).to_pandas()
    for tree, own in t.groupby("tree_id"):
        want = plain_rings(own)
        mine = got[got["tree_id"] == tree]
        assert [[r.axis_ID, r.place, r.cyl_ID, r.ring, None if np.isnan(r.next) else r.next, r.r, r.x, r.y, r.z] for r in mine.itertuples()] == want
        u, v = (mine[[f"{p}{c}" for c in "xyz"]].to_numpy() for p in "uv")
        assert np.allclose((u * u).sum(1), 1) and np.allclose((v * v).sum(1), 1) and np.allclose((u * v).sum(1), 0, atol=1e-9)


def test_rings_of_thousands_of_trees_take_seconds():
    one = forest(np.random.default_rng(3), 1500)
    t = time.process_time()
    mesh._rings_of_table(pa.Table.from_pandas(one, preserve_index=False), one["tree_id"].to_numpy())
    assert time.process_time() - t < 10  # one tree at a time took some 50 ms each


def test_smoothing_of_many_trees_is_that_of_each():
    rng = np.random.default_rng(5)
    t = forest(rng, 50).assign(branch_order=lambda x: x["axis_ID"])
    t["subtree_length"] = np.round(rng.random(len(t)), 1)  # with ties
    tree = t["tree_id"].to_numpy()
    for run in (lambda x, *tree: skeleton.places_smoothed(x, 15, *tree), lambda x, *tree: skeleton.radii_smoothed(x, *tree)):
        whole = run(t, tree)
        pd.testing.assert_frame_equal(whole, pd.concat([run(own) for _, own in t.groupby("tree_id")], ignore_index=True))
    # against sweeps row by row, on axes whose radii are all set
    r = t["radius"].to_numpy().copy()
    for _, own in t.sort_values(["subtree_length", "cyl_ID"], ascending=[False, True]).groupby(["tree_id", "axis_ID"]):
        v, at = own["radius"].to_numpy().copy(), own.index
        if len(v) > 2 and not np.isnan(v).any():
            low = max(0.5 * v.min(), 1e-4)
            for factor in (skeleton.SHRINK, skeleton.INFLATE_RADII) * skeleton.RADII_STEPS:
                for i in range(1, len(v) - 1):
                    v[i] = max(v[i] + factor * (0.5 * (v[i - 1] + v[i + 1]) - v[i]), low)
            r[at] = v
    assert np.array_equal(skeleton.radii_smoothed(t, tree)["radius"].to_numpy(), r, equal_nan=True)
