"""Dissolving equal-level grid cells into regions.

Cells that share an edge and a level belong together; cells that only touch at a
corner do not. A grid is cut into square blocks: each block (at most ``block`` squared
cells, as cells are unique) is labelled in one task, and the labels that meet across
block borders are merged by star contraction on the much smaller label graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import cut_lineage

BLOCK = 512


def cell_runs(cells: DataFrame, by: list[str], level: str = "level") -> DataFrame:
    """Maximal runs of consecutive same-level cells per grid row.

    Gaps and islands within the columns of one row; a long row is no more than its
    grid's column count.
    """
    w = Window.partitionBy(*by, level, "j").orderBy("i")
    island = cells.withColumn("_k", F.col("i") - F.row_number().over(w))
    return island.groupBy(*by, level, "j", "_k").agg(
        F.min("i").alias("lo"), F.max("i").alias("hi"), F.count(F.lit(1)).alias("n")
    ).drop("_k")


def union_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, for nodes 0..n-1 and edges (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            shorter = root[root]
            if (shorter == root).all():
                break
            root = shorter


def _label_block(pdf: pd.DataFrame, keys: list[str], level: str) -> pd.DataFrame:
    """Component ids of one block: the packed (j, i) of the component's first cell."""
    pdf = pdf.sort_values([level, "j", "i"], kind="stable", ignore_index=True)
    lev = pd.factorize(pdf[level])[0].astype(np.int64)
    i, j = pdf["i"].to_numpy(np.int64), pdf["j"].to_numpy(np.int64)
    code = (lev << 42) + ((j - j.min()) << 21) + (i - i.min())
    edges = []
    for step in (1, 1 << 21):
        at = np.minimum(np.searchsorted(code, code + step), len(code) - 1)
        ok = code[at] == code + step
        edges.append((np.flatnonzero(ok), at[ok]))
    root = union_roots(len(code), *(np.concatenate(e) for e in zip(*edges)))
    return pdf.assign(component=((j << 32) + i)[root])[[*keys, level, "i", "j", "component"]]


def block_components(cells: DataFrame, by: list[str], level: str = "level", block: int = BLOCK) -> DataFrame:
    types = dict(cells.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*by, level, "i", "j"]) + ", component bigint"
    slim = cells.select(*by, level, "i", "j")
    blocks = slim.groupBy(*by, F.floor(F.col("i") / block), F.floor(F.col("j") / block))
    return blocks.applyInPandas(lambda pdf: _label_block(pdf, by, level), schema)


def adjacency(cells: DataFrame, by: list[str], level: str = "level", keep=None) -> DataFrame:
    """Pairs of edge-sharing cells of equal level (right and upper neighbours): an equi self-join."""
    a = cells.select(*by, level, "i", "j", *(keep or []))
    steps = F.array(
        F.struct((F.col("i") + 1).alias("i"), F.col("j").alias("j")),
        F.struct(F.col("i").alias("i"), (F.col("j") + 1).alias("j")),
    )
    left = a.select(
        *by, level, F.col("i").alias("from_i"), F.col("j").alias("from_j"),
        *[F.col(k).alias(f"from_{k}") for k in keep or []], F.explode(steps).alias("to"),
    ).select("*", F.col("to.i").alias("i"), F.col("to.j").alias("j")).drop("to")
    return left.join(a, [*by, level, "i", "j"])


def star_contract(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node: columns ``node``, ``root``.

    ``edges`` has struct/number columns ``u``, ``v``. Alternates large-star and
    small-star steps (Kiveris et al., SoCC 2014), which need O(log^2 n) rounds. Each
    step is a min-aggregate and a join on the node.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select("v", "u"))

    def settled(e: DataFrame) -> bool:
        """Every node has one parent, and no parent has a parent."""
        forked = e.groupBy("u").count().filter("count > 1").select("u")
        deep = e.select("u").join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        return forked.union(deep).isEmpty()

    edges = cut_lineage(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    )
    while not settled(edges):
        two = both(edges)
        low = two.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = two.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # every edge now points to its smaller end
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = cut_lineage(small)
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(leaves.select("root", "root").distinct())


def components(cells: DataFrame, by: list[str], level: str = "level", block: int = BLOCK) -> DataFrame:
    """Cells with ``component``: the packed ``(j << 32) + i`` of the component's first cell."""
    local = cut_lineage(block_components(cells, by, level, block))
    last = block - 1
    rim = local.filter(
        (F.col("i") % block).isin(0, last) | (F.col("j") % block).isin(0, last)
    )
    seams = adjacency(rim, by, level, ["component"]).filter(F.col("from_component") != F.col("component"))

    def node(c: str):
        return F.struct(*[F.col(k) for k in by], F.col(level), F.col(c).alias("component"))

    edges = cut_lineage(seams.select(node("from_component").alias("u"), node("component").alias("v")).distinct())
    if edges.isEmpty():
        return local
    roots = star_contract(edges).select(F.col("node"), F.col("root.component").alias("_root"))
    merged = local.withColumn("node", node("component")).join(roots, "node", "left")
    return merged.withColumn("component", F.coalesce("_root", "component")).drop("node", "_root")


def component_sizes(labelled: DataFrame, by: list[str], level: str = "level") -> DataFrame:
    return labelled.groupBy(*by, level, "component").agg(F.count(F.lit(1)).alias("n_cells"))


def dissolve_counts(
    cells: DataFrame, labelled: DataFrame, by: list[str], level: str = "level", exact_counts: bool = False
) -> DataFrame:
    """One row per level with its count, number of parts, object id and target rate.

    ``cells`` carries ``crop_count, obj_id, target_rate``. A level of several parts
    shares its count out in whole numbers, so the total may fall short by less than
    the number of parts; ``exact_counts`` keeps the true total.
    """
    parts = labelled.groupBy(*by, level).agg(F.count_distinct("component").alias("polygon_count"))
    first = F.struct("i", "j")
    totals = cells.groupBy(*by, level).agg(
        F.sum("crop_count").alias("total"), F.min_by("obj_id", first).alias("obj_id"),
        F.min_by("target_rate", first).alias("target_rate"),
    )
    joined = totals.join(parts, [*by, level])
    n, total = F.col("polygon_count"), F.col("total")
    count = total if exact_counts else F.floor(total / n) * n
    return joined.select(*by, level, count.cast("bigint").alias("crop_count"), "obj_id", "target_rate", "polygon_count")


def dissolve_means(cells: DataFrame, by: list[str], level: str = "level", empty: DataFrame | None = None) -> DataFrame:
    """One row per level: points, unweighted mean of the cell means, and that in percent.

    ``empty`` (``by``, level, ``n_cells``, ``obj_id``) counts cells that are not among ``cells``: they have no points and the mean 0.
    """
    g = cells.groupBy(*by, level).agg(
        F.sum("pt_count").alias("pt_count"), F.sum("avg_res").alias("_sum"), F.min_by("obj_id", F.struct("i", "j")).alias("obj_id"),
        F.count(F.lit(1)).alias("n_cells"),
    )
    if empty is not None:
        g = g.unionByName(empty.filter("n_cells > 0").select(
            *by, level, F.lit(0).cast("bigint").alias("pt_count"), F.lit(0.0).alias("_sum"), "obj_id", F.col("n_cells").cast("bigint").alias("n_cells")))
        g = g.groupBy(*by, level).agg(*[F.sum(c).alias(c) for c in ("pt_count", "_sum")], F.min("obj_id").alias("obj_id"), F.sum("n_cells").alias("n_cells"))
    g = g.withColumn("avg_res", F.col("_sum") / F.col("n_cells"))
    return g.select(*by, level, "pt_count", "avg_res", "obj_id", "n_cells", (F.col("avg_res") * 100).alias("res_pct"))


def boundary_edges(labelled: DataFrame, by: list[str], level: str = "level") -> DataFrame:
    """Directed unit edges of the regions' outlines, region on the left.

    A cell edge is on the outline when no same-level cell lies across it, i.e. when
    the unit edge occurs once within its level: one grouped count.
    """
    i, j = F.col("i"), F.col("j")
    side = [
        (i, j, i + 1, j, F.lit(0)), (i + 1, j, i + 1, j + 1, F.lit(1)),
        (i + 1, j + 1, i, j + 1, F.lit(2)), (i, j + 1, i, j, F.lit(3)),
    ]
    names = ("ax", "ay", "bx", "by", "dir")
    structs = F.array(*[F.struct(*[v.cast("int").alias(n) for v, n in zip(s, names)]) for s in side])
    edges = labelled.select(*by, level, "component", F.explode(structs).alias("e"))
    e = F.col("e")
    edges = edges.withColumn("_x", F.least(e["ax"], e["bx"])).withColumn("_y", F.least(e["ay"], e["by"]))
    once = edges.groupBy(*by, level, "_x", "_y", (e["dir"] % 2).alias("_o")).agg(
        F.count(F.lit(1)).alias("n"), F.first("e").alias("e"), F.first("component").alias("component")
    ).filter(F.col("n") == 1)
    return once.select(*by, level, "component", "e.*")
