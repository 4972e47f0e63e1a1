"""Positions, grids and field maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table, view, with_views
from ..functions import boxes as bx
from ..functions import geo
from ..operators import components as cc
from ..operators import grid, rings
from ..plans import maps
from ..scale import cut_lineage
from . import query
from .boxes import r6

# GPS parts of an image as decimal degrees (3 parts: degrees, minutes, seconds; 2: degrees, minutes).
FIX = """
, fix as (select img,
  (lat_d + lat_m / 60 + coalesce(lat_s, 0e0) / 3600) * case when lat_ref in ('S', 'W') then -1 else 1 end as lat,
  (lon_d + lon_m / 60 + coalesce(lon_s, 0e0) / 3600) * case when lon_ref in ('S', 'W') then -1 else 1 end as lon
  from fx_gps)"""


def _parts(axis: str):
    d, m, s = (F.col(f"{axis}_{p}").cast("double") for p in "dms")
    return F.when(F.col("n_parts") == 3, F.array(d, m, s)).otherwise(F.array(d, m))


def gps(spark, sf):
    tags = {"lat": _parts("lat"), "lon": _parts("lon"), "lat_ref": F.col("lat_ref"), "lon_ref": F.col("lon_ref")}
    return maps.positions(view(spark, sf, "fx_gps"), tags)


@query("gps_positions", with_views("fx_gps", body=FIX + " select img, round(lat, 9) as latitude, round(lon, 9) as longitude from fix"))
def gps_positions(spark, sf):
    return gps(spark, sf).select("img", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"))


@query(
    "gps_tag_chain",
    """
with t as (select o_orderkey k, o_orderkey % 60 d, cast(o_orderkey % 59 as double) m, cast(o_orderkey % 57 as double) s, o_orderkey % 8 c,
  case when o_orderkey % 3 = 0 then 'S' else 'N' end la, case when o_orderkey % 5 = 0 then 'W' else 'E' end lo,
  o_orderkey % 7 <> 0 has_ref from orders)
select k as id,
  round(case c when 0 then case when has_ref then (d + m/60 + s/3600) * case when la = 'S' then -1 else 1 end end
    when 1 then case when has_ref then (d + m/60) * case when la = 'S' then -1 else 1 end end
    when 2 then case when has_ref and la = 'S' then -(d + 0e0) else d + 0e0 end
    when 3 then case when has_ref then (d + m/60 + s/3600) * case when la = 'S' then -1 else 1 end end
    when 4 then case when has_ref then (d + m/60) * case when la = 'S' then -1 else 1 end end
    when 5 then case when has_ref then case when la = 'S' then -(d + 0e0) else d + 0e0 end end
    when 6 then null else null end, 9) as latitude,
  round(case c when 0 then case when has_ref then (d + m/60 + s/3600) * case when lo = 'W' then -1 else 1 end end
    when 1 then case when has_ref then (d + m/60) * case when lo = 'W' then -1 else 1 end end
    when 2 then case when has_ref and lo = 'W' then -(d + 0e0) else d + 0e0 end
    when 3 then case when has_ref then (d + m/60) * case when lo = 'W' then -1 else 1 end end
    when 4 then case when has_ref then (d + m/60) * case when lo = 'W' then -1 else 1 end end
    when 5 then case when has_ref then case when lo = 'W' then -(d + 0e0) else d + 0e0 end end
    when 6 then null else null end, 9) as longitude
from t""",
)
def gps_tag_chain(spark, sf):
    """Case 0 DMS, 1 DDM tags, 2 decimal tags, 3 alternative tags, 4-5 plain tags by length, 6 latitude only, 7 none."""
    k = F.col("o_orderkey")
    d, m, s = (k % 60).cast("double"), (k % 59).cast("double"), (k % 57).cast("double")
    case = k % 8

    def when(cases, arr):
        return F.when(case.isin(*cases), arr)

    plain = when([0], F.array(d, m, s)).when(case.isin(4, 6), F.array(d, m)).when(case == 5, F.array(d))
    plain_lon = when([0], F.array(d, m, s)).when(case == 4, F.array(d, m)).when(case == 5, F.array(d))
    known = k % 7 != 0
    tags = {
        "lat": plain, "lon": plain_lon, "lat_ddm": when([1], F.array(d, m)), "lon_ddm": when([1], F.array(d, m)),
        "lat_dec": when([2], F.array(d)), "lon_dec": when([2], F.array(d)),
        "lat_alt": when([3], F.array(d, m, s)), "lon_alt": when([3], F.array(d, m)),
        "lat_ref": F.when(known, F.when(k % 3 == 0, "S").otherwise("N")),
        "lon_ref": F.when(known, F.when(k % 5 == 0, "W").otherwise("E")),
    }
    out = maps.positions(table(spark, sf, "orders").withColumn("id", k), tags, "id")
    return out.select("id", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"))


def located(spark, sf):
    d = view(spark, sf, "fx_detections")
    det = d.select("img", "ord", F.col("term").alias("label"), F.array("x1", "y1", "x2", "y2").alias("bounding_box"))
    images = view(spark, sf, "fx_images").filter(F.col("width") % 50 != 0)
    return maps.locate(det, gps(spark, sf), images)


# Ground coordinates of the default footprint: 29 x 22 ft over 4000 x 3000 px.
GROUND = FIX + """
, seen as (select img from fx_images where width % 50 <> 0),
geod as (select d.ord, d.img, d.term as label, f.lat,
   f.lat + (((d.y1 + d.y2) / 2 - 1500) * (22e0 / 3.28084e0 / 3000)) * (1e0 / 111320e0) clat,
   f.lon + (((d.x1 + d.x2) / 2 - 2000) * (29e0 / 3.28084e0 / 4000)) * (1e0 / (111320e0 * cos(radians(f.lat)))) clon,
   (d.y2 - d.y1) * (22e0 / 3.28084e0 / 3000) / 2 * (1e0 / 111320e0) hh,
   (d.x2 - d.x1) * (29e0 / 3.28084e0 / 4000) / 2 * (1e0 / (111320e0 * cos(radians(f.lat)))) hw
  from fx_detections d join seen using (img) join fix f using (img)),
pts as (select ord, img, label, clat - hh lat1, clon - hw lon1, clat + hh lat2, clon + hw lon2,
   ((clat - hh) + (clat + hh)) / 2 latitude, ((clon - hw) + (clon + hw)) / 2 longitude from geod)"""


@query(
    "ground_boxes",
    with_views("fx_detections", "fx_gps", "fx_images", body=GROUND + """
select ord, label, round(latitude, 9) as latitude, round(longitude, 9) as longitude, round(lat1, 9) as bbox_lat1, round(lon1, 9) as bbox_lon1,
  round(lat2, 9) as bbox_lat2, round(lon2, 9) as bbox_lon2 from pts"""),
)
def ground_boxes(spark, sf):
    cols = ("latitude", "longitude", "bbox_lat1", "bbox_lon1", "bbox_lat2", "bbox_lon2")
    return located(spark, sf)[0].select("ord", "label", *[F.round(c, 9).alias(c) for c in cols])


@query(
    "images_without_position",
    with_views("fx_detections", "fx_gps", "fx_images", body="""
, seen as (select img from fx_images where width % 50 <> 0),
m as (select 'missing' as reason, img from fx_detections where img not in (select img from seen)
  union all select 'no_gps', img from fx_detections where img in (select img from seen) and img not in (select img from fx_gps))
select reason, img, count(*) as n from m group by reason, img"""),
)
def images_without_position(spark, sf):
    _, missing, without = located(spark, sf)
    rows = missing.select(F.lit("missing").alias("reason"), "img").union(without.select(F.lit("no_gps"), "img"))
    return rows.groupBy("reason", "img").agg(F.count(F.lit(1)).alias("n"))


@query(
    "spray_levels",
    """
with c as (select user_id, event_type, count(*) - 1 n from events group by user_id, event_type)
select user_id, event_type, case when n = 0 then 'No' when n <= 1 then 'Yes' else 'Yes' end as binary_level,
  cast(case when n = 0 then 0 else 2 end as int) as binary_id,
  case when n = 0 then 'No' when n <= 5 then 'Low' when n <= 15 then 'Medium' else 'High' end as level,
  cast(case when n = 0 then 0 when n <= 5 then 1 when n <= 15 then 2 else 3 end as int) as level_id,
  cast(case when n > 0 then 15 else 0 end as int) as target_rate from c""",
)
def spray_levels(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg((F.count(F.lit(1)) - 1).alias("n"))
    b, l = geo.spray_level("n"), geo.spray_level("n", geo.spray_levels("levels"))
    c = c.withColumn("b", b).withColumn("l", l)
    return c.select(
        "user_id", "event_type", F.col("b.name").alias("binary_level"), F.col("b.obj_id").alias("binary_id"),
        F.col("l.name").alias("level"), F.col("l.obj_id").alias("level_id"), geo.target_rate("n").alias("target_rate"),
    )


RES_LEVEL = """case when n = 0 then 'No_Data' when m <= 0.2e0 then 'Very_Low' when m <= 0.4e0 then 'Low' when m <= 0.6e0 then 'Medium'
  when m <= 0.8e0 then 'High' else 'Very_High' end"""
RES_ID = "case when n = 0 then 0 when m <= 0.2e0 then 1 when m <= 0.4e0 then 2 when m <= 0.6e0 then 3 when m <= 0.8e0 then 4 else 5 end"


@query(
    "residue_levels",
    with_views("fx_residue", body=f"""
, q as (select id, id % 4 n, round(residue_fraction * 3, 6) m from fx_residue)
select id, {RES_LEVEL} as level, cast({RES_ID} as int) as obj_id from q"""),
)
def residue_levels(spark, sf):
    q = view(spark, sf, "fx_residue").select(
        "id", geo.residue_level(F.round(F.col("residue_fraction") * 3, 6), F.col("id") % 4).alias("l")
    )
    return q.select("id", F.col("l.name").alias("level"), "l.obj_id")


def _geodesic(name: str, source: str, cols: str) -> str:
    """CTE ``name``: ``source`` plus ``dist`` in metres, by 12 iterations of the inverse formula."""
    return f"""
{name}_0 as (select *, row_number() over () rid, radians(lon2 - lon1) dl,
   atan((1 - 1/298.257223563e0) * tan(radians(lat1))) r1, atan((1 - 1/298.257223563e0) * tan(radians(lat2))) r2 from {source}),
{name}_1 as (select rid, dl, r1, r2, dl lam, 0 it from {name}_0
  union all
  select rid, dl, r1, r2, dl + (1 - c) * f * sa * (sg + c * ss * (mid + c * cs * (2 * mid * mid - 1))) lam, it + 1
  from (select *, f/16 * ca2 * (4 + f * (4 - 3 * ca2)) c from (
    select *, cs - coalesce(2 * sin(r1) * sin(r2) / nullif(ca2, 0e0), 0e0) mid from (
    select *, 1 - sa * sa ca2, atan2(ss, cs) sg from (
    select *, coalesce(cos(r1) * cos(r2) * sin(lam) / nullif(ss, 0e0), 0e0) sa from (
    select *, 1/298.257223563e0 f, sqrt(pow(cos(r2) * sin(lam), 2) + pow(cos(r1) * sin(r2) - sin(r1) * cos(r2) * cos(lam), 2)) ss,
      sin(r1) * sin(r2) + cos(r1) * cos(r2) * cos(lam) cs from {name}_1 where it < 12))))) z),
{name}_2 as (select rid, ca2, mid, ss, cs, sg, ca2 * ((6378137e0 * 6378137e0 - b * b) / (b * b)) u2, b from (
    select *, 6378137e0 * (1 - 1/298.257223563e0) b, cs - coalesce(2 * sin(r1) * sin(r2) / nullif(ca2, 0e0), 0e0) mid from (
    select *, 1 - sa * sa ca2, atan2(ss, cs) sg from (
    select *, coalesce(cos(r1) * cos(r2) * sin(lam) / nullif(ss, 0e0), 0e0) sa from (
    select *, sqrt(pow(cos(r2) * sin(lam), 2) + pow(cos(r1) * sin(r2) - sin(r1) * cos(r2) * cos(lam), 2)) ss,
      sin(r1) * sin(r2) + cos(r1) * cos(r2) * cos(lam) cs from {name}_1 where it = 12)))) z),
{name}_3 as (select *, 1 + u2/16384 * (4096 + u2 * (u2 * (320 - 175 * u2) - 768)) aa,
   u2/1024 * (256 + u2 * (u2 * (74 - 47 * u2) - 128)) bb from {name}_2),
{name} as (select {cols}, b * aa * (sg - bb * ss * (mid + bb/4 * (cs * (2*mid*mid - 1) - bb/6 * mid * (4*ss*ss - 3) * (4*mid*mid - 3)))) dist
  from {name}_0 join {name}_3 using (rid))"""


def _spec(points: str, by: str, pad: str, cell: float, lat: str = "latitude", lon: str = "longitude") -> str:
    """CTEs ``ext`` and ``spec`` over ``points`` grouped by ``by``."""
    return f"""
, raw as (select {by}, min({lon}) x0, min({lat}) y0, max({lon}) x1, max({lat}) y1 from {points} where {by} is not null group by {by}),
ext as (select {by}, x0 - {pad} * (x1 - x0) minx, y0 - {pad} * (y1 - y0) miny, x1 + {pad} * (x1 - x0) maxx, y1 + {pad} * (y1 - y0) maxy from raw),
lines as (select {by}, 'w' side, miny lat1, minx lon1, miny lat2, maxx lon2 from ext
  union all select {by}, 'h', miny, minx, maxy, minx from ext),
{_geodesic("measured", "lines", f"{by}, side")},
wide as (select e.*, w.dist width_m, h.dist height_m, {cell}e0 / 3.28084e0 t from ext e
  join measured w on w.{by} = e.{by} and w.side = 'w' join measured h on h.{by} = e.{by} and h.side = 'h'),
counted as (select *, cast(case when t > width_m or t > height_m then 1 else greatest(1, ceil(width_m / t)) end as int) ncol,
  cast(case when t > width_m or t > height_m then 1 else greatest(1, ceil(height_m / t)) end as int) nrow from wide),
spec as (select *, (maxx - minx) / ncol dx, (maxy - miny) / nrow dy from counted)"""


SPEC_OUT = """round(minx, 9) as minx, round(miny, 9) as miny, round(maxx, 9) as maxx, round(maxy, 9) as maxy,
  round(width_m, 4) as width_m, round(height_m, 4) as height_m, ncol, nrow, round(dx, 12) as dx, round(dy, 12) as dy"""


def spec_out(spec, by):
    digits = {"minx": 9, "miny": 9, "maxx": 9, "maxy": 9, "width_m": 4, "height_m": 4, "dx": 12, "dy": 12}
    return spec.select(by, "ncol", "nrow", *[F.round(c, d).alias(c) for c, d in digits.items()])


SAMPLES = ", samples as (select *, 'output' as field from fx_residue)"


@query(
    "weed_grid_spec",
    with_views("fx_detections", "fx_gps", "fx_images", recursive=True,
               body=GROUND + _spec("pts", "label", "0.1e0", 6) + f" select label, {SPEC_OUT} from spec"),
)
def weed_grid_spec(spark, sf):
    points = located(spark, sf)[0]
    return spec_out(grid.grid_spec(grid.extent(points, ["label"]), (6.0, 6.0)), "label")


@query(
    "residue_grid_spec",
    with_views("fx_residue", recursive=True,
               body=SAMPLES + _spec("samples", "field", "0e0", 15) + f" select field, {SPEC_OUT} from spec"),
)
def residue_grid_spec(spark, sf):
    points = residue(spark, sf)
    return spec_out(grid.grid_spec(grid.extent(points, ["field"], pad=0.0), (15.0, 15.0)), "field")


def residue(spark, sf):
    return view(spark, sf, "fx_residue").withColumn("field", F.lit("output"))


def residue_spec(points):
    return cut_lineage(grid.grid_spec(grid.extent(points, ["field"], pad=0.0), (15.0, 15.0)))


CELLS = """
, is_ as (select *, unnest(range(0, ncol)) i from spec), js as (select *, unnest(range(0, nrow)) j from is_)"""


def _in_cells(points: str, by: str) -> str:
    """CTE ``hits``: every point with each cell that covers it, edges included."""
    return f""", near as (select p.*, s.minx, s.miny, s.dx, s.dy, s.ncol, s.nrow,
   floor((p.longitude - s.minx) / s.dx) gi, floor((p.latitude - s.miny) / s.dy) gj from {points} p join spec s using ({by})),
hi as (select *, gi + unnest([-1, 0, 1]) i from near),
hj as (select *, gj + unnest([-1, 0, 1]) j from hi where i >= 0 and i < ncol and longitude >= minx + i * dx and longitude <= minx + (i + 1) * dx),
hits as (select * from hj where j >= 0 and j < nrow and latitude >= miny + j * dy and latitude <= miny + (j + 1) * dy)"""


@query(
    "grid_cell_edges",
    with_views("fx_residue", recursive=True, body=SAMPLES + _spec("samples", "field", "0e0", 15) + CELLS + """
select cast(i as int) i, cast(j as int) j, round(minx + i * dx, 9) as xmin, round(miny + j * dy, 9) as ymin,
  round(minx + (i + 1) * dx, 9) as xmax, round(miny + (j + 1) * dy, 9) as ymax from js"""),
)
def grid_cell_edges(spark, sf):
    spec = residue_spec(residue(spark, sf))
    cells = grid.cell_bounds(grid.grid_cells(spec, ["field"]).join(spec, "field"))
    return cells.select("i", "j", *[F.round(c, 9).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


# The oracle joins on the inequalities themselves, for every point and every cell of its row band.
@query(
    "points_in_cells",
    with_views("fx_residue", recursive=True, body=SAMPLES + _spec("samples", "field", "0e0", 15) + CELLS + """
, cols as (select distinct i, minx + i * dx a, minx + (i + 1) * dx b from js),
rows_ as (select distinct j, miny + j * dy a, miny + (j + 1) * dy b from js)
select id, cast(i as int) i, cast(j as int) j from samples join cols on longitude >= cols.a and longitude <= cols.b
  join rows_ on latitude >= rows_.a and latitude <= rows_.b"""),
)
def points_in_cells(spark, sf):
    points = residue(spark, sf)
    return grid.points_in_cells(points, residue_spec(points), ["field"]).select("id", "i", "j")


WEED_CELLS = GROUND + _spec("pts", "label", "0.1e0", 6) + CELLS + _in_cells("pts", "label") + """
, tally as (select label, i, j, count(*) n from hits group by label, i, j),
cells as (select js.label, cast(js.i as int) i, cast(js.j as int) j, coalesce(n, 0) crop_count,
   case when coalesce(n, 0) = 0 then 'No' else 'Yes' end as level from js left join tally using (label, i, j))"""


@query(
    "weed_cell_counts",
    with_views("fx_detections", "fx_gps", "fx_images", recursive=True, body=WEED_CELLS + """
select label, i, j, crop_count, level, cast(case when crop_count = 0 then 0 else 2 end as int) as obj_id,
  cast(case when crop_count = 0 then 0 else 15 end as int) as target_rate from cells"""),
)
def weed_cell_counts(spark, sf):
    points = located(spark, sf)[0]
    spec = cut_lineage(grid.grid_spec(grid.extent(points, ["label"]), (6.0, 6.0)))
    return maps.spray_cells(points, spec)


RESIDUE_CELLS = SAMPLES + _spec("samples", "field", "0e0", 15) + CELLS + _in_cells("samples", "field") + f"""
, tally as (select field, i, j, count(*) n, avg(residue_fraction) m from hits group by field, i, j),
filled as (select js.field, cast(js.i as int) i, cast(js.j as int) j, coalesce(n, 0) n, coalesce(m, 0e0) m from js left join tally using (field, i, j)),
cells as (select field, i, j, n pt_count, m avg_res, {RES_LEVEL} as level, cast({RES_ID} as int) as obj_id from filled)"""


@query(
    "residue_cell_means",
    with_views("fx_residue", recursive=True, body=RESIDUE_CELLS + """
select i, j, pt_count, round(avg_res, 6) as avg_res, round(avg_res * 100, 4) as res_pct, level, obj_id from cells"""),
)
def residue_cell_means(spark, sf):
    points = residue(spark, sf)
    cells = maps.residue_cells(points, residue_spec(points))
    return cells.select("i", "j", "pt_count", r6("avg_res").alias("avg_res"), F.round("res_pct", 4).alias("res_pct"), "level", "obj_id")


@query(
    "residue_level_means",
    with_views("fx_residue", recursive=True, body=RESIDUE_CELLS + """
select level, cast(sum(pt_count) as bigint) as pt_count, round(avg(avg_res), 6) as avg_res, round(avg(avg_res) * 100, 4) as res_pct,
  min(obj_id) as obj_id, count(*) as n_cells from cells group by level"""),
)
def residue_level_means(spark, sf):
    points = residue(spark, sf)
    out = cc.dissolve_means(maps.residue_cells(points, residue_spec(points)), ["field"])
    return out.select(
        "level", "pt_count", r6("avg_res").alias("avg_res"), F.round("res_pct", 4).alias("res_pct"), "obj_id", "n_cells"
    )


def residue_labelled(spark, sf):
    points = residue(spark, sf)
    spec = residue_spec(points)
    cells = cut_lineage(maps.residue_cells(points, spec))
    return cells, cc.components(cells, ["field"]), spec


@query(
    "cell_runs",
    with_views("fx_residue", recursive=True, body=RESIDUE_CELLS + """
, k as (select *, i - row_number() over (partition by level, j order by i) g from cells)
select level, j, min(i) as lo, max(i) as hi, count(*) as n from k group by level, j, g"""),
)
def cell_runs(spark, sf):
    points = residue(spark, sf)
    return cc.cell_runs(maps.residue_cells(points, residue_spec(points)), ["field"]).select("level", "j", "lo", "hi", "n")


@query(
    "cell_adjacency",
    with_views("fx_residue", recursive=True, body=RESIDUE_CELLS + """
select a.level, a.i as from_i, a.j as from_j, b.i, b.j from cells a join cells b
  on a.level = b.level and ((b.i = a.i + 1 and b.j = a.j) or (b.i = a.i and b.j = a.j + 1))"""),
)
def cell_adjacency(spark, sf):
    points = residue(spark, sf)
    cells = maps.residue_cells(points, residue_spec(points))
    return cc.adjacency(cells, ["field"]).select("level", "from_i", "from_j", "i", "j")


# Components of the rarer levels by reachability; the packed number names the first cell of the component.
_REACH = """
, mine as (select level, i, j, (cast(j as bigint) << 32) + i code from cells),
edge as (select a.level, a.code u, b.code v from mine a join mine b on a.level = b.level and abs(a.i - b.i) + abs(a.j - b.j) = 1
  and b.i between a.i - 1 and a.i + 1 and b.j between a.j - 1 and a.j + 1),
reach as (select level, code u, code v from mine union select r.level, r.u, e.v from reach r join edge e on e.level = r.level and e.u = r.v)"""


def _flood(group: str) -> str:
    """CTE ``flood``: smallest cell code each cell reaches over same-level edges (label propagation)."""
    return f"""
, mine as (select {group}, level, i, j, (cast(j as bigint) << 32) + i code from cells),
edge as (select a.{group} g, a.level l, a.code u, b.code v from mine a join mine b on a.{group} = b.{group} and a.level = b.level and a.j = b.j and a.i + 1 = b.i
  union all select a.{group}, a.level, a.code, b.code from mine a join mine b on a.{group} = b.{group} and a.level = b.level and a.i = b.i and a.j + 1 = b.j),
twoway as (select * from edge union all select g, l, v, u from edge),
flood(g, l, u, c) using key (g, l, u) as (select {group}, level, code, code from mine
  union (select f.g, f.l, f.u, min(n.c) from recurring.flood f join twoway e on e.g = f.g and e.l = f.l and e.u = f.u
    join flood n on n.g = e.g and n.l = e.l and n.u = e.v where n.c < f.c group by f.g, f.l, f.u))"""


@query("residue_components")
def residue_components(spark, sf):
    _, labelled, _ = residue_labelled(spark, sf)
    cell = F.shiftleft(F.col("j").cast("bigint"), 32) + F.col("i")
    return labelled.select("level", cell.alias("cell"), "component")


COARSE = RESIDUE_CELLS.replace("15e0 / 3.28084e0", "60e0 / 3.28084e0")


@query("coarse_components", with_views("fx_residue", recursive=True, body=COARSE + _REACH + """
select level, u as cell, min(v) as component from reach group by level, u"""))
def coarse_components(spark, sf):
    """Blocks of 4 x 4 cells, so that most components cross block borders."""
    points = residue(spark, sf)
    spec = cut_lineage(grid.grid_spec(grid.extent(points, ["field"], pad=0.0), (60.0, 60.0)))
    labelled = cc.components(cut_lineage(maps.residue_cells(points, spec)), ["field"], block=4)
    cell = F.shiftleft(F.col("j").cast("bigint"), 32) + F.col("i")
    return labelled.select("level", cell.alias("cell"), "component")


@query(
    "outline_edges",
    with_views("fx_residue", recursive=True, body=RESIDUE_CELLS + """
, side as (select level, i, j, unnest([0, 1, 2, 3]) dir from cells),
nb as (select *, i + case dir when 1 then 1 when 3 then -1 else 0 end ni, j + case dir when 0 then -1 when 2 then 1 else 0 end nj from side)
select nb.level, cast(dir as int) as dir, count(*) as n from nb left join cells c on c.level = nb.level and c.i = ni and c.j = nj
where c.i is null group by nb.level, dir"""),
)
def outline_edges(spark, sf):
    _, labelled, _ = residue_labelled(spark, sf)
    return cc.boundary_edges(labelled, ["field"]).groupBy("level", "dir").agg(F.count(F.lit(1)).alias("n"))


@query("outline_polygons")
def outline_polygons(spark, sf):
    _, labelled, spec = residue_labelled(spark, sf)
    return rings.with_wkt(rings.region_polygons(labelled, spec, ["field"])).select("level", "component", "n_rings", "wkt")


def wkt_area(wkt):
    """Signed area of a (multi-)polygon text: outer rings count up, holes count down."""
    rings_ = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1)

    def axis(p, k):
        return F.get(F.split(p, " "), F.lit(k)).cast("double")

    def ring(r):
        texts = F.split(r, ", ")
        first = F.get(texts, F.lit(0))
        # relative to the ring's first corner, so that large coordinates do not cancel
        pts = F.transform(texts, lambda p: F.struct(
            (axis(p, 0) - axis(first, 0)).alias("x"), (axis(p, 1) - axis(first, 1)).alias("y")
        ))
        n = F.size(pts) - 1
        pairs = F.zip_with(F.slice(pts, 1, n), F.slice(pts, 2, n), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)

    return F.aggregate(F.transform(rings_, ring), F.lit(0.0), lambda acc, v: acc + v) / 2


@query(
    "outline_areas",
    with_views("fx_residue", recursive=True, body=COARSE + _REACH + """
, comp as (select level, u, min(v) c from reach group by level, u),
parts as (select level, count(distinct c) n_polygons, count(*) n_cells from comp group by level)
select level, n_polygons, n_cells as area_in_cells from parts"""),
)
def outline_areas(spark, sf):
    """Outlines measured from their text: the area of each level in cells, holes taken off."""
    points = residue(spark, sf)
    spec = cut_lineage(grid.grid_spec(grid.extent(points, ["field"], pad=0.0), (60.0, 60.0)))
    cells = cut_lineage(maps.residue_cells(points, spec))
    # in cell units, so that the area is a whole number
    unit = spec.withColumn("minx", F.lit(0.0)).withColumn("miny", F.lit(0.0)).withColumn("dx", F.lit(1.0)).withColumn("dy", F.lit(1.0))
    polys = rings.with_wkt(rings.region_polygons(cc.components(cells, ["field"]), unit, ["field"]))
    return polys.groupBy("level").agg(
        F.count(F.lit(1)).alias("n_polygons"), F.round(F.sum(wkt_area(F.col("wkt")))).cast("bigint").alias("area_in_cells")
    )


@query(
    "weed_outline_shares",
    with_views("fx_detections", "fx_gps", "fx_images", recursive=True, body=WEED_CELLS + """
select label, level, round(count(*) * (select dx * dy from spec s where s.label = c.label) * 1e8, 1) as area from cells c group by label, level"""),
)
def weed_outline_shares(spark, sf):
    """Area of each level's outline text, in 1e-8 square degrees."""
    return weed(spark, sf).features.select(
        "label", "level", F.round(wkt_area(F.col("wkt")) * 1e8, 1).alias("area")
    )


def weed(spark, sf, **options):
    d = view(spark, sf, "fx_detections")
    det = d.select("img", "ord", F.col("term").alias("label"), bx.to_array(bx.make_box()).alias("bounding_box"))
    images = view(spark, sf, "fx_images").filter(F.col("width") % 50 != 0)
    return maps.weed_map(det, gps(spark, sf), images, cell_ft=(6.0, 6.0), **options)


@query(
    "weed_map",
    with_views("fx_detections", "fx_gps", "fx_images", recursive=True, body=WEED_CELLS + _flood("label") + """
, parts as (select g as label, l as level, count(distinct c) n from flood group by g, l),
total as (select label, level, sum(crop_count) t from cells group by label, level)
select label, level, cast(n * floor(t / n) as bigint) as crop_count, cast(case level when 'No' then 0 else 2 end as int) as obj_id,
  cast(case level when 'No' then 0 else 15 end as int) as target_rate, n as polygon_count, label as label_slug
from total join parts using (label, level)"""),
)
def weed_map(spark, sf):
    return weed(spark, sf).levels


@query("weed_map_outlines")
def weed_map_outlines(spark, sf):
    return weed(spark, sf).features.select("label", "level", "wkt")


# The same by flood: components of the occupied level come from edge-sharing reachability of its cells.
@query(
    "spray_level_totals",
    with_views("fx_detections", "fx_gps", "fx_images", recursive=True,
               body=WEED_CELLS.replace("6e0 / 3.28084e0 t", "40e0 / 3.28084e0 t") + """
, mine as (select label, level, i, j, crop_count, i * 100000 + j code from cells),
edge as (select a.label, a.level, a.code u, b.code v from mine a join mine b on a.label = b.label and a.level = b.level
  and b.i between a.i - 1 and a.i + 1 and b.j between a.j - 1 and a.j + 1 and abs(a.i - b.i) + abs(a.j - b.j) = 1),
reach as (select label, level, code u, code v from mine
  union select r.label, r.level, r.u, e.v from reach r join edge e on e.label = r.label and e.level = r.level and e.u = r.v),
comp as (select label, level, u, min(v) c from reach group by label, level, u),
parts as (select label, level, count(distinct c) n from comp group by label, level),
total as (select label, level, sum(crop_count) t from mine group by label, level)
select label, level, cast(n * floor(t / n) as bigint) as crop_count, cast(t as bigint) as exact_count, n as polygon_count,
  cast(case level when 'No' then 0 else 2 end as int) as obj_id, cast(case level when 'No' then 0 else 15 end as int) as target_rate
from total join parts using (label, level)"""),
)
def spray_level_totals(spark, sf):
    points = located(spark, sf)[0]
    spec = cut_lineage(grid.grid_spec(grid.extent(points, ["label"]), (40.0, 40.0)))
    cells = cut_lineage(maps.spray_cells(points, spec))
    labelled = cc.components(cells, ["label"])
    shared = cc.dissolve_counts(cells, labelled, ["label"])
    exact = cc.dissolve_counts(cells, labelled, ["label"], exact_counts=True)
    exact = exact.select("label", "level", F.col("crop_count").alias("exact_count"))
    return shared.join(exact, ["label", "level"])


@query(
    "residue_map",
    with_views("fx_residue", recursive=True, body=RESIDUE_CELLS + """
select level, cast(sum(pt_count) as bigint) as pt_count, round(avg(avg_res), 6) as avg_res, round(avg(avg_res) * 100, 4) as res_pct,
  min(obj_id) as obj_id, count(*) as n_cells, 'output' as label_slug from cells group by level"""),
)
def residue_map(spark, sf):
    out = maps.residue_map(view(spark, sf, "fx_residue"), (15.0, 15.0)).levels
    return out.select(
        "level", "pt_count", r6("avg_res").alias("avg_res"), F.round("res_pct", 4).alias("res_pct"), "obj_id", "n_cells", "label_slug"
    )


@query(
    "farm_boundary",
    with_views("fx_detections", "fx_gps", "fx_images", recursive=True, body=GROUND + _spec("pts", "label", "0.1e0", 6) + """
select label, round(width_m, 4) as field_width_m, round(height_m, 4) as field_height_m,
  printf('POLYGON ((%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f))', maxx, miny, maxx, maxy, minx, maxy, minx, miny, maxx, miny) as wkt
from spec"""),
)
def farm_boundary(spark, sf):
    points = located(spark, sf)[0]
    spec = grid.grid_spec(grid.extent(points, ["label"]), (6.0, 6.0))
    out = maps.farm_boundary(spec, ["label"], digits=6)
    sides = [F.round(c, 4).alias(c) for c in ("field_width_m", "field_height_m")]
    return out.select("label", *sides, "wkt")
