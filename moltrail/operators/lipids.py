"""Bilayers: leaflets, thickness, area per lipid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def head_atoms(atoms: DataFrame, lipids: list[str], heads: list[str]) -> DataFrame:
    """F19."""
    return atoms.where(F.col("res_name").isin(*lipids) & F.col("atom_name").isin(*heads))


def leaflets(heads: DataFrame, frame: str, bins: int = 20, means: bool = False) -> DataFrame:
    """For each frame the middle (the histogram edge number bins // 2), numbers above and below, and the thickness; with means
    also the leaflets' mean z, up and low."""
    ends = heads.groupBy(frame).agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    middle = ends.select(frame, (F.col("lo") + (bins // 2) * ((F.col("hi") - F.col("lo")) / bins)).alias("middle"))
    rows = heads.join(middle, frame)
    above, below = F.col("z") > F.col("middle"), F.col("z") < F.col("middle")
    out = rows.groupBy(frame).agg(F.first("middle").alias("middle"), F.count_if(above).alias("n_up"), F.count_if(below).alias("n_low"), F.avg(F.when(above, F.col("z"))).alias("up"), F.avg(F.when(below, F.col("z"))).alias("low"))
    return out.select(frame, "middle", "n_up", "n_low", (F.col("up") - F.col("low")).alias("thickness"), *(["up", "low"] if means else []))


def area_per_lipid(rows: DataFrame) -> DataFrame:
    """A19 from columns area, protein_up, protein_low, n_up, n_low."""
    a, up, low = F.col("area"), F.col("protein_up"), F.col("protein_low")
    return rows.withColumns({"upper": F.try_divide(a - up, F.col("n_up")), "lower": F.try_divide(a - low, F.col("n_low")), "mean": F.try_divide(2 * a - up - low, F.col("n_up") + F.col("n_low"))})


def boundary_points(atoms: DataFrame, radius: float = 1.4) -> DataFrame:
    """Four points around each atom in the plane."""
    around = [F.struct((F.col("x") + dx * radius).alias("x"), (F.col("y") + dy * radius).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    rest = [c for c in atoms.columns if c not in ("x", "y")]
    return atoms.select(*rest, F.explode(F.array(*around)).alias("p")).select(*rest, "p.*")


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise, by the monotone chain."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def chain(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hull_measure(p: np.ndarray, parity: bool = False) -> float:
    h = convex_hull(p)
    if len(h) < 3:
        return 0.0
    n = np.roll(h, -1, axis=0)
    return float(np.hypot(*(n - h).T).sum()) if parity else float(abs((h[:, 0] * n[:, 1] - n[:, 0] * h[:, 1]).sum()) / 2)


def cross_section(points: DataFrame, on: str | list[str], parity: bool = False) -> DataFrame:
    """The area (with parity the perimeter) of the convex hull of x, y in each group. The hull of parts' hulls is
    the hull, so each batch of rows sends its corners only."""
    on = [on] if isinstance(on, str) else on

    def reduce_batch(frames):
        for frame in frames:
            for key, g in frame.groupby(on, sort=False):
                h = convex_hull(g[["x", "y"]].to_numpy())
                yield pd.DataFrame({**dict(zip(on, key)), "x": h[:, 0], "y": h[:, 1]})

    def area(key, frame):
        return pd.DataFrame({**{c: [v] for c, v in zip(on, key)}, "area": [hull_measure(frame[["x", "y"]].to_numpy(), parity)]})

    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in on)
    parts = points.select(*on, F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(reduce_batch, f"{kinds}, x double, y double")
    return parts.groupBy(*on).applyInPandas(area, f"{kinds}, area double")


def bilayer_areas(heads: DataFrame, protein: DataFrame, boxes: DataFrame, frame: str, layer: float = 2.5, radius: float = 1.4, bins: int = 20, parity: bool = False) -> DataFrame:
    """A18, A19 of each frame: area (of its box: lx, ly), leaflet counts and thickness from the heads, the protein's sections in a slab of
    `layer` around each leaflet's mean (F18; its atoms widened by a radius, M16), and the areas per lipid. A frame without protein
    there has a section of 0."""
    found = leaflets(heads, frame, bins, means=True)
    sides = F.explode(F.array(F.struct(F.lit("up").alias("side"), F.col("up").alias("mid")), F.struct(F.lit("low").alias("side"), F.col("low").alias("mid")))).alias("s")
    slabs = protein.join(found.select(frame, sides).select(frame, "s.*"), frame).where((F.col("z") > F.col("mid") - layer) & (F.col("z") < F.col("mid") + layer))
    area = cross_section(boundary_points(slabs.select(frame, "side", "x", "y"), radius), [frame, "side"], parity)
    area = area.groupBy(frame).pivot("side", ["up", "low"]).agg(F.first("area")).withColumnsRenamed({"up": "protein_up", "low": "protein_low"})
    rows = found.join(boxes.select(frame, (F.col("lx") * F.col("ly")).alias("area")), frame).join(area, frame, "left").na.fill(0.0, ["protein_up", "protein_low"])
    return area_per_lipid(rows)
