"""A made forest: a sloping ground, tapered trunks with lateral branches, leaves; the truth is known."""

import numpy as np
import pandas as pd


def forest(trees=((2.0, 2.0, 8.0, 0.15), (6.0, 3.0, 7.0, 0.12), (4.0, 6.5, 9.0, 0.16)), side=9.0, seed=3, dense=1.0):
    """A frame of point_id, X, Y, Z, truth (0 ground, else the tree), part (ground, wood, leaf)."""
    rng = np.random.default_rng(seed)
    ground = lambda x, y: 0.02 * x + 0.01 * y
    g = np.arange(0.05, side, 0.1)
    gx, gy = (a.ravel() for a in np.meshgrid(g, g))
    parts = [(gx, gy, ground(gx, gy) + rng.normal(0, 0.005, len(gx)), np.zeros(len(gx), int), np.full(len(gx), "ground"))]

    def tube(a, b, r0, r1, n):
        t, w = rng.random(n), rng.random(n) * 2 * np.pi
        axis = (b - a) / np.linalg.norm(b - a)
        u = np.cross(axis, [0.3, 0.9, 0.1])
        u /= np.linalg.norm(u)
        v = np.cross(axis, u)
        r = r0 + t * (r1 - r0) + rng.normal(0, 0.003, n)
        return a + t[:, None] * (b - a) + r[:, None] * (np.cos(w)[:, None] * u + np.sin(w)[:, None] * v)

    for k, (x, y, h, r) in enumerate(trees, 1):
        foot = np.array([x, y, ground(x, y)])
        wood = [tube(foot, foot + [0, 0, h], r, 0.02, int(900 * h * dense))]
        leaves = []
        for i in range(6):
            z = h * (0.45 + 0.08 * i)
            turn = i * 2.4 + k
            tip = foot + [1.2 * np.cos(turn), 1.2 * np.sin(turn), z + 0.7]
            wood.append(tube(foot + [0, 0, z], tip, 0.035, 0.01, int(350 * dense)))
            leaves.append(tip + rng.normal(0, 0.12, (int(80 * dense), 3)))
        w, leaf = np.concatenate(wood), np.concatenate(leaves)
        for p, name in ((w, "wood"), (leaf, "leaf")):
            parts.append((p[:, 0], p[:, 1], p[:, 2], np.full(len(p), k), np.full(len(p), name)))
    x, y, z, truth, part = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pd.DataFrame({"point_id": np.arange(len(x)), "X": x, "Y": y, "Z": z, "truth": truth, "part": part, "hag_true": z - ground(x, y)})
