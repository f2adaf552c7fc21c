"""Column contracts of points and cylinders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Column names and types.
POINTS = {"X": "double", "Y": "double", "Z": "double", "hag": "double", "Classification": "int", "pwood": "double", "passage": "int", "foliage": "int", "treeID": "int", "UserData": "int", "R": "int", "G": "int", "B": "int", "range": "double", "gpstime": "double"}
CYLINDERS = {"tree_id": "int", "startX": "double", "startY": "double", "startZ": "double", "endX": "double", "endY": "double", "endZ": "double", "cyl_ID": "int", "parent_ID": "int", "axis_ID": "int", "branch_order": "int", "dist_to_root": "double", "subtree_length": "double", "radius": "double", "quality": "int"}
REQUIRED_CYLINDER = ("cyl_ID", "parent_ID", "startX", "startY", "startZ", "endX", "endY", "endZ")


def check_points(df: DataFrame, *needed: str) -> DataFrame:
    """The frame itself, if X, Y, Z and `needed` are there and known columns have their type; columns have to be numeric."""
    kinds = {f.name: f.dataType for f in df.schema}
    for name in ("X", "Y", "Z", *needed):
        if name not in kinds:
            raise ValueError(f"the point cloud has no {name}")
    for name, kind in kinds.items():
        if not isinstance(kind, (T.NumericType, T.BooleanType)):
            raise TypeError(f"{name} is {kind.simpleString()}; only numbers and truth values are points' attributes")
        if name in POINTS and POINTS[name] == "double" and not isinstance(kind, T.DoubleType):
            raise TypeError(f"{name} is {kind.simpleString()}, not double")
    return df


def check_tls(df: DataFrame, is_tls: bool) -> DataFrame:
    """The frame itself, if it is marked as a terrestrial scan."""
    if not is_tls:
        raise ValueError("not a terrestrial scan")
    return check_points(df)


def check_cylinders(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED_CYLINDER if c not in df.columns]
    if missing:
        raise ValueError(f"the cylinder table has no {', '.join(missing)}")
    return df
