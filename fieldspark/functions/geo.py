"""Ground projection, GPS tag parsing, level tables and geodesic length as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import col, lit

FT_PER_M = 3.28084
M_PER_DEGREE = 111320.0

# Level names and upper thresholds.
RESIDUE_LEVELS = (("Very_Low", 0.2), ("Low", 0.4), ("Medium", 0.6), ("High", 0.8), ("Very_High", 1.0))
BINARY_LEVELS = (("No", 0), ("Yes", 1))
DEFAULT_LEVELS = (("Low", 5), ("Medium", 15), ("High", 30))

# WGS84 semi-major axis (m) and flattening.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563


def to_ground(lat, lon, b, px=(4000, 3000), fov_ft=(29.0, 22.0), off_ft=(0.0, 0.0), flip_y: bool = False) -> Column:
    """Pixel box -> ``lat1, lon1, lat2, lon2, latitude, longitude`` about the image's GPS point.

    The GPS point is taken as the image centre. Image y grows downward but is added
    to the latitude; ``flip_y`` subtracts it instead.
    """
    lat, lon, b = col(lat), col(lon), col(b)
    mx = fov_ft[0] / FT_PER_M / px[0]
    my = fov_ft[1] / FT_PER_M / px[1]
    dx = ((b["x1"] + b["x2"]) / 2 - F.lit(px[0] / 2)) * F.lit(mx) + F.lit(off_ft[0] / FT_PER_M)
    dy = ((b["y1"] + b["y2"]) / 2 - F.lit(px[1] / 2)) * F.lit(my) + F.lit(off_ft[1] / FT_PER_M)
    per_lat = F.lit(1.0 / M_PER_DEGREE)
    per_lon = F.lit(1.0) / (F.lit(M_PER_DEGREE) * F.cos(F.radians(lat)))
    clat = lat - dy * per_lat if flip_y else lat + dy * per_lat
    clon = lon + dx * per_lon
    hw = (b["x2"] - b["x1"]) * F.lit(mx) / 2 * per_lon
    hh = (b["y2"] - b["y1"]) * F.lit(my) / 2 * per_lat
    lat1, lon1, lat2, lon2 = clat - hh, clon - hw, clat + hh, clon + hw
    return F.struct(
        lat1.alias("lat1"), lon1.alias("lon1"), lat2.alias("lat2"), lon2.alias("lon2"),
        ((lat1 + lat2) / 2).alias("latitude"), ((lon1 + lon2) / 2).alias("longitude"),
    )


def _part(arr: Column, i: int) -> Column:
    return F.get(arr, F.lit(i))


def _sign(ref) -> Column:
    return F.when(col(ref).isin("S", "W"), F.lit(-1)).otherwise(F.lit(1))


def dms(arr, ref) -> Column:
    """[degrees, minutes, seconds] -> decimal degrees; any other length -> null."""
    arr = col(arr)
    value = (_part(arr, 0) + _part(arr, 1) / 60 + _part(arr, 2) / 3600) * _sign(ref)
    return F.when(F.size(arr) == 3, value)


def ddm(arr, ref) -> Column:
    """[degrees, decimal minutes] -> decimal degrees; any other length -> null."""
    arr = col(arr)
    return F.when(F.size(arr) == 2, (_part(arr, 0) + _part(arr, 1) / 60) * _sign(ref))


#: Tag arrays and reference letters that ``gps_from_tags`` looks at.
GPS_FIELDS = (
    "lat", "lon", "lat_ddm", "lon_ddm", "lat_dec", "lon_dec", "lat_alt", "lon_alt", "lat_ref", "lon_ref",
)


def gps_from_tags(tags: dict[str, Column]) -> Column:
    """Decimal ``latitude, longitude`` from tag columns, or null.

    ``tags`` maps names of ``GPS_FIELDS`` to array<double> / string columns; absent
    ones count as null. The branches are tried in order: both plain tags as DMS;
    DDM tags; decimal tags; alternative tags (DMS latitude, DDM longitude); plain
    tags by their length. Branches one, two and four need both reference letters:
    without them the whole parse is null and no later branch is tried.
    """
    def arr(n: str) -> Column:
        return tags[n] if n in tags else F.lit(None).cast("array<double>")

    def ref(n: str) -> Column:
        return tags[n] if n in tags else F.lit(None).cast("string")

    lat_ref, lon_ref = ref("lat_ref"), ref("lon_ref")
    no_ref = lat_ref.isNull() | lon_ref.isNull()
    null_pair = F.lit(None).cast("struct<latitude:double,longitude:double>")

    def pair(la: Column, lo: Column) -> Column:
        return F.struct(la.cast("double").alias("latitude"), lo.cast("double").alias("longitude"))

    def both(a: str, b: str) -> Column:
        return arr(a).isNotNull() & arr(b).isNotNull()

    def decimal(values: Column, letter: Column, negative: str, default: str) -> Column:
        v = _part(values, 0)
        return F.when(F.coalesce(letter, F.lit(default)) == negative, -v).otherwise(v)

    def by_length(values: Column, letter: Column, negative: str, default: str) -> Column:
        safe = F.coalesce(letter, F.lit(default))
        return (
            F.when(F.size(values) == 3, dms(values, safe))
            .when(F.size(values) == 2, ddm(values, safe))
            .when(F.size(values) == 1, decimal(values, letter, negative, default))
        )

    b1 = (dms(arr("lat"), lat_ref), dms(arr("lon"), lon_ref))
    b2 = (ddm(arr("lat_ddm"), lat_ref), ddm(arr("lon_ddm"), lon_ref))
    b3 = (decimal(arr("lat_dec"), lat_ref, "S", "N"), decimal(arr("lon_dec"), lon_ref, "W", "E"))
    b4 = (dms(arr("lat_alt"), lat_ref), ddm(arr("lon_alt"), lon_ref))
    b5 = (by_length(arr("lat"), lat_ref, "S", "N"), by_length(arr("lon"), lon_ref, "W", "E"))

    def found(p) -> Column:
        return p[0].isNotNull() & p[1].isNotNull()

    return (
        F.when(both("lat", "lon") & no_ref, null_pair)
        .when(both("lat", "lon") & found(b1), pair(*b1))
        .when(both("lat_ddm", "lon_ddm") & no_ref, null_pair)
        .when(both("lat_ddm", "lon_ddm") & found(b2), pair(*b2))
        .when(both("lat_dec", "lon_dec"), F.when(found(b3), pair(*b3)))
        .when(both("lat_alt", "lon_alt") & no_ref, null_pair)
        .when(both("lat_alt", "lon_alt") & found(b4), pair(*b4))
        .when(both("lat", "lon") & found(b5), pair(*b5))
    )


def spray_levels(mode: str = "binary", names=None, thresholds=None):
    """Level table for a mode: binary, or named thresholds (Low/Medium/High by default)."""
    if mode == "binary":
        return BINARY_LEVELS
    if names and thresholds:
        if len(names) != len(thresholds):
            raise ValueError("every level needs a name and a threshold")
        return tuple(zip(names, thresholds))
    return DEFAULT_LEVELS


def _level(value: Column, empty: Column, none_name: str, levels) -> Column:
    def entry(name: str, obj: int) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(obj).alias("obj_id"))

    out = F.when(empty, entry(none_name, 0))
    for i, (name, top) in enumerate(levels):
        out = out.when(value <= lit(top), entry(name, i + 1))
    return out.otherwise(entry(levels[-1][0], len(levels)))


def spray_level(count, levels=BINARY_LEVELS) -> Column:
    """First level whose threshold is not exceeded; zero counts are ``No`` / 0."""
    count = col(count)
    return _level(count, count == 0, "No", levels)


def target_rate(count) -> Column:
    return F.when(col(count) > 0, F.lit(15)).otherwise(F.lit(0))


def residue_level(avg, count, levels=RESIDUE_LEVELS) -> Column:
    """First level whose threshold is not exceeded; cells without points are ``No_Data`` / 0."""
    return _level(col(avg), col(count) == 0, "No_Data", levels)


def _bind(name: str, value: str, body: str) -> str:
    """SQL text that evaluates ``value`` once, as ``name``, for ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _fields(**parts: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + ")"


#: Change of the last iteration, in radians, up to which it counts as settled (under 0.01 mm).
SETTLED = 1e-12


def geodesic_sql(lat1: str, lon1: str, lat2: str, lon2: str, steps: int = 12) -> str:
    """``geodesic_m`` as Spark SQL text; the arguments are SQL expressions in degrees."""
    f = WGS84_F
    minor = WGS84_A * (1 - f)

    def num(v: float) -> str:
        return f"{v!r}D"

    def angles(lam: str, body: str) -> str:
        """Spherical quantities for one longitude difference on the auxiliary sphere, bound as ``gq``."""
        full = _fields(
            ss="ga.ss", cs="ga.cs", sigma="ga.sigma", sa="ga.sa", ca2="1 - ga.sa * ga.sa",
            mid="ga.cs - coalesce(try_divide(2 * gu.s1 * gu.s2, 1 - ga.sa * ga.sa), 0D)",
        )
        azimuth = _fields(
            ss="gr.ss", cs="gr.cs", sigma="atan2(gr.ss, gr.cs)", sa="coalesce(try_divide(gr.num, gr.ss), 0D)"
        )
        arc = _fields(ss="sqrt(gp.cross * gp.cross + gp.along * gp.along)", cs="gp.cs", num="gu.c1 * gp.cross")
        pair = _fields(
            cross="gu.c2 * gl.sl", along="gu.c1 * gu.s2 - gu.s1 * gu.c2 * gl.cl",
            cs="gu.s1 * gu.s2 + gu.c1 * gu.c2 * gl.cl",
        )
        value = _bind("gl", _fields(sl=f"sin({lam})", cl=f"cos({lam})"), pair)
        for name, step in (("gp", arc), ("gr", azimuth), ("ga", full)):
            value = _bind(name, value, step)
        return _bind("gq", value, body)

    c = f"{num(f / 16)} * gq.ca2 * (4 + {num(f)} * (4 - 3 * gq.ca2))"
    moved = _bind(
        "gc", c,
        f"gu.dl + (1 - gc) * {num(f)} * gq.sa * "
        "(gq.sigma + gc * gq.ss * (gq.mid + gc * gq.cs * (2 * gq.mid * gq.mid - 1)))",
    )
    series = _fields(
        a="1 + gw / 16384 * (4096 + gw * (gw * (320 - 175 * gw) - 768))",
        b="gw / 1024 * (256 + gw * (gw * (74 - 47 * gw) - 128))",
    )
    twist = (
        "(gq.cs * (2 * gq.mid * gq.mid - 1)"
        " - gs.b / 6 * gq.mid * (4 * gq.ss * gq.ss - 3) * (4 * gq.mid * gq.mid - 3))"
    )
    metres = _bind(
        "gw", f"gq.ca2 * {num((WGS84_A**2 - minor**2) / minor**2)}",
        _bind("gs", series, f"gs.a * {num(minor)} * (gq.sigma - gs.b * gq.ss * (gq.mid + gs.b / 4 * {twist}))"),
    )
    settled = f"if(abs({angles('ge', moved)} - ge) < {num(SETTLED)}, {angles('ge', metres)}, cast(null as double))"
    solved = f"aggregate(sequence(1, {steps}), gu.dl, (gm, gn) -> {angles('gm', moved)}, ge -> {settled})"
    reduced = _fields(
        dl=f"radians({lon2}) - radians({lon1})",
        r1=f"atan(tan(radians({lat1})) * {num(1 - f)})", r2=f"atan(tan(radians({lat2})) * {num(1 - f)})",
    )
    trig = _fields(dl="gv.dl", s1="sin(gv.r1)", c1="cos(gv.r1)", s2="sin(gv.r2)", c2="cos(gv.r2)")
    return _bind("gu", _bind("gv", reduced, trig), solved)


def geodesic_m(lat1: str, lon1: str, lat2: str, lon2: str, steps: int = 12) -> Column:
    """Length in metres on the WGS84 ellipsoid (inverse problem).

    Null where ``steps`` iterations do not settle, which happens only between nearly opposite points.

    Arguments are column names or SQL expressions in degrees.
    """
    return F.expr(geodesic_sql(lat1, lon1, lat2, lon2, steps))
