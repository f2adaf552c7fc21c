"""The ground filter by joins: as the plain one over a tile's points, whatever their order, shared or broadcast."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boscage.operators import ground


def cloud() -> pd.DataFrame:
    """Bumpy ground and what stands on it; many points share their height, some their place."""
    r = np.random.default_rng(5)
    x, y = np.round(r.uniform(-4, 9, 4000), 2), np.round(r.uniform(0, 7, 4000), 2)
    z = np.round(0.1 * x + np.where(r.random(4000) < 0.4, r.uniform(0, 5, 4000), 0), 1)
    t = pd.DataFrame({"X": x, "Y": y, "Z": z})
    return pd.concat([t, t[:50]], ignore_index=True).rename_axis("point_id").reset_index()


def plain(t: pd.DataFrame, size: float, halo: float) -> pd.DataFrame:
    """Tile by tile in numpy; points at one place are ground together."""
    out = []
    for tx, ty in {*zip(np.floor(t.X / size), np.floor(t.Y / size), strict=True)}:
        near = t[(np.floor((t.X - halo) / size) <= tx) & (tx <= np.floor((t.X + halo) / size)) & (np.floor((t.Y - halo) / size) <= ty) & (ty <= np.floor((t.Y + halo) / size))]
        x, y, z = near[["X", "Y", "Z"]].to_numpy().T
        g = pd.Series(ground.ground_mask(x, y, z)).groupby([x, y, z]).transform("max").to_numpy()
        hag = z - ground.heights(*ground.surface(x[g], y[g], z[g], 0.2), 0.2, x, y)
        own = (np.floor(near.X / size) == tx) & (np.floor(near.Y / size) == ty)
        out.append(near.assign(Classification=np.where(g, 2, 1), hag=hag)[own])
    return pd.concat(out).sort_values("point_id", ignore_index=True)


@pytest.mark.parametrize("most", [200_000, 0])
def test_as_plain(spark, monkeypatch, most):
    monkeypatch.setattr(ground, "BROADCAST", most)
    t = cloud()
    want = plain(t, 5.0, 2.0)
    for order in ("point_id", "-point_id"):
        df = spark.createDataFrame(t).repartition(3).orderBy(F.expr(order))
        got = ground.segment_ground(df, 5.0, 2.0).toPandas().sort_values("point_id", ignore_index=True)
        assert (got.Classification == want.Classification).all() and np.abs(got.hag - want.hag).max() < 1e-9
