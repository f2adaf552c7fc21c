"""Folds over the trees of a forest, all in one shuffle by tree.

A tree is bounded by nature, the forest is not.  A task works on batches of whole trees: their levels one after the other,
each as one vectorised step over all trees of the batch: from the roots up for sums along paths, from the tips down for what
a subtree reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: What a fold tells of each cylinder; `parent` is null at a root, `reached` false on and behind a cycle.
FOLDS = {"parent": "long", "dist_to_root": "double", "subtree_length": "double", "subtree_max_z": "double", "subtree_volume": "double", "subtree_radius": "double", "branch_order": "int", "axis": "long", "reached": "boolean"}


#: Rows of whole trees that are worked on at once; a larger tree is worked on alone.
BATCH_ROWS = 20_000


def starts(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whether a row's key differs from the key before it; nulls are a key of their own, the first row is a start."""
    after, before = keys.slice(1), keys.slice(0, max(len(keys) - 1, 0))
    other = pc.fill_null(pc.not_equal(after, before), False)
    return np.concatenate([np.ones(min(len(keys), 1), bool), np.asarray(pc.or_(other, pc.xor(pc.is_null(after), pc.is_null(before))))])


def whole_trees(batches: Iterator[pa.RecordBatch], key: str = "tree_id", rows: int = BATCH_ROWS) -> Iterator[pa.Table]:
    """Tables of whole trees from batches whose trees follow each other; each has about `rows` rows or one tree."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            ends = pa.concat_arrays([held[-1][key].slice(held[-1].num_rows - 1), batch[key]])
            new = np.flatnonzero(starts(ends)[1:])
        else:
            new = np.flatnonzero(starts(batch[key]))
        if len(new) and sum(b.num_rows for b in held) + int(new[-1]) >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))])
            held, batch = [], batch.slice(int(new[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def by_tree(trees: DataFrame, run: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType | str, key: str = "tree_id", tasks: int = 0) -> DataFrame:
    """run(table, number of each row's tree) over batches of whole trees: one shuffle by tree, few calls of Python.

    `tasks` is for work that bytes don't tell: so many tasks, which are not joined for being small."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_trees(batches, key):
            table = table.combine_chunks()
            yield from run(table, np.cumsum(starts(table[key].combine_chunks())) - 1).to_batches()

    dealt = trees.repartition(tasks, key) if tasks else trees.repartition(key)
    return dealt.sortWithinPartitions(key).mapInArrow(tables, schema)


def parents(ident: np.ndarray, parent: np.ndarray, tree: np.ndarray | None = None, last: bool = False) -> np.ndarray:
    """Row of each cylinder's parent in its tree (all are of one tree, if none are told), -1 where no cylinder has that id.

    Of several with that id it is the first one, or the last."""
    known, own = np.unique(ident, return_inverse=True)
    at = np.minimum(np.searchsorted(known, parent), len(known) - 1)
    there, tree = known[at] == parent, 0 if tree is None else tree * len(known)
    own, at = own + tree, at + tree
    order = np.argsort(own, kind="stable")
    row = np.searchsorted(own[order], at, side="right") - 1 if last else np.minimum(np.searchsorted(own[order], at), len(own) - 1)
    return np.where(there & (own[order][row] == at), order[row], -1)


def depths(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of cylinders above each, whether a root is above it) by pointer doubling; cycles never end and are left out."""
    depth, jump = (up >= 0).astype(np.int64), up.copy()
    for _ in range(len(up).bit_length() + 1):
        live = jump >= 0
        if not live.any():
            break
        depth[live] += depth[jump[live]]
        jump[live] = jump[jump[live]]
    return depth, jump < 0


def fold(ident: np.ndarray, parent: np.ndarray, length: np.ndarray, top: np.ndarray, radius: np.ndarray, by_volume: bool = False, tree: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The FOLDS of the cylinders of one tree, or of several whose numbers are told, as arrays.

    A node's main child is the one whose subtree reaches highest (holds most volume along its way if by_volume), then
    the longest, then the smallest id.
    """
    n = len(ident)
    up = parents(ident, parent, tree)
    depth, reached = depths(up)
    radius = np.nan_to_num(radius)
    volume = np.pi * radius**2 * length
    path, bulk = length.copy(), volume.copy()
    by_depth = np.flatnonzero(reached)
    by_depth = by_depth[np.argsort(depth[by_depth], kind="stable")]
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[1:]
    for rows in levels:
        path[rows] += path[up[rows]]
        bulk[rows] += bulk[up[rows]]
    far, high, most, thick = path.copy(), top.copy(), bulk.copy(), radius.copy()
    for rows in reversed(levels):
        for x in (far, high, most, thick):
            np.maximum.at(x, up[rows], x[rows])
    first = np.round(most - bulk + volume if by_volume else high, 9)
    order = np.lexsort((ident, -np.round(far - path + length, 9), -first, up))
    lateral = np.ones(n, bool)
    lateral[order[np.flatnonzero(np.append(True, np.diff(up[order]) != 0))]] = False
    lateral &= up >= 0
    branch, axis = 1 + lateral.astype(np.int64), np.where(lateral | (up < 0), ident, 0)
    for rows in levels:
        branch[rows] += branch[up[rows]] - 1
        axis[rows] = np.where(lateral[rows], ident[rows], axis[up[rows]])
    return {"parent": up, "dist_to_root": path - length, "subtree_length": far - path, "subtree_max_z": high, "subtree_volume": most - bulk, "subtree_radius": thick, "branch_order": branch, "axis": axis, "reached": reached}


def fold_trees(cylinders: DataFrame, *wanted: str, by_volume: bool = False) -> DataFrame:
    """cylinders with the wanted FOLDS, in place of columns of the same name."""
    names = [c for c in cylinders.columns if c not in wanted]
    schema = T.StructType([cylinders.schema[c] for c in names])
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}

    def run(table: pa.Table, tree: np.ndarray) -> pa.Table:
        number = lambda c: np.asarray(table[c].cast(pa.float64()).fill_null(np.nan))
        ident, above = (np.asarray(table[c].cast(pa.int64()).fill_null(np.iinfo(np.int64).min)) for c in ("cyl_ID", "parent_ID"))
        length = np.sqrt(sum((number(f"end{a}") - number(f"start{a}")) ** 2 for a in "XYZ"))
        found = fold(ident, above, length, number("endZ"), number("radius") if "radius" in table.column_names else np.zeros(len(ident)), by_volume, tree)
        own = {"parent": pa.array(above, pa.int64(), mask=found["parent"] < 0)}
        out = table.select(names)
        for w in wanted:
            out = out.append_column(w, own.get(w, None) if w in own else pa.array(found[w]).cast(kinds[FOLDS[w]]))
        return out

    whole = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"{w} {FOLDS[w]}" for w in wanted)])
    return by_tree(cylinders, run, whole)
