"""Polygon outlines of dissolved regions as WKT."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import bounded_broadcast, cut_lineage, same_keys
from . import components as cc

#: Largest region (cells) whose outline is traced in one task; larger ones are traced by joins, with the same result.
REGION_CELLS = 1_000_000


def _successor(ax, ay, bx, by, turn) -> np.ndarray:
    """Next outline edge; where a region touches itself at a corner the right turn keeps rings apart."""
    height = int(max(ay.max(), by.max())) + 1
    code = (ax.astype(np.int64) * height + ay) * 4 + turn
    order = np.argsort(code)
    base = (bx.astype(np.int64) * height + by) * 4
    nxt = np.full(len(code), -1)
    for step in (3, 0, 1):
        want = base + (turn + step) % 4
        at = np.minimum(np.searchsorted(code[order], want), len(code) - 1)
        found = (code[order][at] == want) & (nxt < 0)
        nxt[found] = order[at[found]]
    return nxt


def _cycle_order(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ring leader, position from the leader) per edge, by pointer doubling."""
    leader, hop = np.arange(len(nxt)), nxt.copy()
    while True:
        lower = np.minimum(leader, leader[hop])
        hop = hop[hop]
        if (lower == leader).all() and (leader == leader[nxt]).all():
            break
        leader = lower
    hop = np.where(leader == nxt, np.arange(len(nxt)), nxt)
    left = (hop != np.arange(len(nxt))).astype(np.int64)
    while (left[hop] > 0).any():
        left, hop = left + left[hop], hop[hop]
    return leader, -left


def trace(region: np.ndarray, ax: np.ndarray, ay: np.ndarray, turn: np.ndarray):
    """Closed corner rings of many regions at once.

    Takes unit edges (region number, start corner, direction 0-3 = right, up, left,
    down) and yields ``(region, xs, ys)`` per ring, each region's outer ring first.
    """
    dx, dy = np.array([1, 0, -1, 0]), np.array([0, 1, 0, -1])
    # regions side by side on the x axis, so that one lookup serves all of them
    lane = region * (int(ax.max()) + 2)
    nxt = _successor(ax + lane, ay, ax + lane + dx[turn], ay + dy[turn], turn)
    before = np.empty_like(nxt)
    before[nxt] = np.arange(len(nxt))
    leader, pos = _cycle_order(nxt)
    doubled = np.zeros(len(nxt), dtype=np.int64)
    np.add.at(doubled, leader, ax * dy[turn] - ay * dx[turn])
    order = np.lexsort((pos, leader, doubled[leader] < 0, region))
    order = order[turn[before[order]] != turn[order]]
    for ring in np.split(order, np.flatnonzero(np.diff(leader[order])) + 1):
        closed = np.append(ring, ring[0])
        yield region[ring[0]], ax[closed].astype(np.int32), ay[closed].astype(np.int32)


def _trace_udf():
    @F.pandas_udf("struct<xs:array<array<int>>,ys:array<array<int>>>")
    def run(ax: pd.Series, ay: pd.Series, turn: pd.Series) -> pd.DataFrame:
        region = np.repeat(np.arange(len(ax)), [len(v) for v in ax])
        xs: list[list] = [[] for _ in range(len(ax))]
        ys: list[list] = [[] for _ in range(len(ax))]
        for k, x, y in trace(region, *(np.concatenate(list(c)).astype(np.int64) for c in (ax, ay, turn))):
            xs[k].append(x)
            ys[k].append(y)
        return pd.DataFrame({"xs": xs, "ys": ys})

    return run


def _trace_all(edges: DataFrame, keys: list[str]) -> DataFrame:
    # sorted, so that a ring starts at its smallest edge whatever the order of rows
    packed = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ax", "ay", "dir"))).alias("_e"))
    parts = [F.transform("_e", lambda edge: edge["ax"]), F.transform("_e", lambda edge: edge["ay"])]
    traced = packed.select(*keys, _trace_udf()(*parts, F.transform("_e", lambda edge: edge["dir"])).alias("_t"))
    return traced.select(*keys, F.arrays_zip(F.col("_t.xs").alias("xs"), F.col("_t.ys").alias("ys")).alias("rings"))


def _trace_by_joins(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The same as ``_trace_all`` for regions of any size: edges find their successors by joins, rings by pointer doubling.

    Only corners are gathered, into the one value that a polygon's text is anyway.
    """
    number = F.shiftleft(F.col("ax").cast("bigint"), 32) + F.col("ay") * 4 + F.col("dir")
    step_x, step_y = (F.element_at(F.array(*map(F.lit, d)), F.col("dir") + 1) for d in ((1, 0, -1, 0), (0, 1, 0, -1)))
    e = edges.select(*keys, "ax", "ay", "dir", number.alias("id"), (F.col("ax") + step_x).alias("bx"), (F.col("ay") + step_y).alias("by"))
    e = cut_lineage(e)
    after = e.select(*keys, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("id").alias("to"), F.col("dir").alias("to_dir"))
    # right turns first: a region that touches itself at a corner keeps its rings apart
    turn = F.pmod(F.col("to_dir") - F.col("dir"), F.lit(4))
    rank = F.when(turn == 3, 0).when(turn == 0, 1).when(turn == 1, 2)
    nxt = e.join(after, [*keys, "bx", "by"]).filter(rank.isNotNull()).groupBy(*keys, "id").agg(
        F.min_by("to", rank).alias("next"))
    nxt = cut_lineage(nxt)

    def jump(state: DataFrame, value: str) -> DataFrame:
        """Every row with the ``hop`` and ``value`` of the row its hop points to."""
        there = state.select(*keys, F.col("id").alias("hop"), F.col("hop").alias("hop2"), F.col(value).alias("value2"))
        return state.join(there, [*keys, "hop"])

    state = nxt.select(*keys, "id", "next", F.col("next").alias("hop"), F.least("id", "next").alias("leader"))
    while True:
        moved = cut_lineage(jump(state, "leader").select(
            *keys, "id", "next", F.col("hop2").alias("hop"), F.least("leader", "value2").alias("leader"),
            (F.col("value2") < F.col("leader")).alias("changed")))
        state = moved.drop("changed")
        if moved.filter("changed").isEmpty():
            break
    last = F.col("next") == F.col("leader")
    state = state.select(*keys, "id", "next", "leader", F.when(last, F.col("id")).otherwise(F.col("next")).alias("hop"),
                         F.when(last, 0).otherwise(1).cast("bigint").alias("left"))
    while not state.filter("hop <> id").join(
        state.filter("left > 0").select(*keys, F.col("id").alias("hop")), [*keys, "hop"], "left_semi"
    ).isEmpty():
        state = cut_lineage(jump(state, "left").select(
            *keys, "id", "next", "leader", F.col("hop2").alias("hop"), (F.col("left") + F.col("value2")).alias("left")))
    # a corner is an edge that its predecessor meets at an angle
    came = state.select(*keys, F.col("next").alias("id"), F.pmod("id", F.lit(4)).cast("int").alias("from_dir"))
    placed = e.join(state.select(*keys, "id", "leader", "left"), [*keys, "id"]).join(came, [*keys, "id"])
    area = F.sum(F.col("ax") * step_y - F.col("ay") * step_x)
    corner = F.when(F.col("dir") != F.col("from_dir"), F.struct((-F.col("left")).alias("p"), F.col("ax").alias("x"), F.col("ay").alias("y")))
    rings = placed.groupBy(*keys, "leader").agg((area < 0).alias("hole"), F.array_sort(F.collect_list(corner)).alias("c"))
    closed = F.concat("c", F.slice("c", 1, 1))
    drawn = F.struct(F.transform(closed, _axis("x")).alias("xs"), F.transform(closed, _axis("y")).alias("ys"))
    sorted_rings = F.array_sort(F.collect_list(F.struct("hole", "leader", drawn.alias("ring"))))
    return rings.groupBy(*keys).agg(F.transform(sorted_rings, lambda r: r["ring"]).alias("rings"))


def _axis(name: str):
    return lambda corner: corner[name].cast("int")


def _polygon_body(rings: Column) -> Column:
    def point(v: Column) -> Column:
        x, y = F.col("minx") + v["x"] * F.col("dx"), F.col("miny") + v["y"] * F.col("dy")
        return F.format_string("%.9f %.9f", x, y)

    def ring(r: Column) -> Column:
        corners = F.arrays_zip(r["xs"].alias("x"), r["ys"].alias("y"))
        return F.concat(F.lit("("), F.array_join(F.transform(corners, point), ", "), F.lit(")"))

    return F.concat(F.lit("("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))


def region_polygons(
    labelled: DataFrame, spec: DataFrame, by: list[str], level: str = "level",
    region_cells: int = REGION_CELLS,
) -> DataFrame:
    """One polygon per region, whatever its size: ``body`` (WKT polygon text without its keyword), ``n_rings``.

    Regions of more than ``region_cells`` cells are traced by joins instead of in one task each.
    """
    keys = [*by, level, "component"]
    sizes = cc.component_sizes(labelled, by, level).filter(F.col("n_cells") > region_cells).select(*keys)
    sizes = cut_lineage(sizes)
    big = not sizes.isEmpty()
    small = labelled
    if big:
        sizes = bounded_broadcast(sizes)
        cond = same_keys(labelled, sizes, keys)
        small = labelled.join(sizes, cond, "left_anti")
    traced = _trace_all(cc.boundary_edges(small, by, level), keys)
    if big:
        large = labelled.join(sizes, cond, "left_semi")
        traced = traced.unionByName(_trace_by_joins(cc.boundary_edges(large, by, level), keys))
    placed = traced.join(bounded_broadcast(spec.select(*by, "minx", "miny", "dx", "dy")), by)
    return placed.select(*keys, F.size("rings").alias("n_rings"), _polygon_body(F.col("rings")).alias("body"))


def with_wkt(polygons: DataFrame) -> DataFrame:
    """One ``POLYGON`` text per row."""
    return polygons.withColumn("wkt", F.concat(F.lit("POLYGON "), F.col("body"))).drop("body")


def level_geometry(polygons: DataFrame, by: list[str], level: str = "level") -> DataFrame:
    """One (multi-)polygon text per level.

    A level's text is one value and so has to fit into one task; where it may not,
    use the polygons themselves, one per region.
    """
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("component", "body"))), lambda part: part["body"])
    wkt = F.when(F.size("_b") == 1, F.concat(F.lit("POLYGON "), F.get("_b", F.lit(0)))).otherwise(
        F.concat(F.lit("MULTIPOLYGON ("), F.array_join("_b", ", "), F.lit(")"))
    )
    return polygons.groupBy(*by, level).agg(bodies.alias("_b")).select(*by, level, wkt.alias("wkt"))


def box_wkt(
    minx: str = "minx", miny: str = "miny", maxx: str = "maxx", maxy: str = "maxy", digits: int = 9
) -> Column:
    x0, y0, x1, y1 = (F.col(c) for c in (minx, miny, maxx, maxy))
    corners = ((x1, y0), (x1, y1), (x0, y1), (x0, y0), (x1, y0))
    points = [F.format_string(f"%.{digits}f %.{digits}f", x, y) for x, y in corners]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *points), F.lit("))"))
