"""Input views derived from the given tables, as SQL text that Spark and DuckDB both accept.

``view`` builds one as a Spark DataFrame; ``with_views`` prefixes an oracle text
with the same definitions as CTEs, so both engines read identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Fixed definitions, in dependency order: name -> (inputs, SQL).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # image table
    "fx_images": (
        ("orders",),
        """
select concat('img_', lpad(cast(k as string), 4, '0'), '.jpg') as img,
       cast(1200 + (k * 137) % 2800 as int) as width, cast(900 + (k * 211) % 2100 as int) as height
from (select distinct o_orderkey % 200 as k from orders) t
""",
    ),
    # raw detector output, pre-suppression
    "fx_detections": (
        ("orders",),
        """
select concat('img_', lpad(cast(o_orderkey % 200 as string), 4, '0'), '.jpg') as img,
       o_orderkey as ord,
       case when p % 7 < 3 then 'pigweed' when p % 7 < 5 then 'ragweed' when p % 7 < 6 then 'corn' else 'soil' end as term,
       cast(p % 1000 as double) / 1000 as score,
       cast(p % 997 as double) as x1, cast(p % 701 as double) as y1,
       cast(p % 997 + 30 + p % 211 + case when p % 97 = 0 then 720 else 0 end as double) as x2, cast(p % 701 + 30 + p % 193 as double) as y2
from (select o_orderkey, cast(round(o_totalprice * 100, 0) as bigint) as p from orders) t
""",
    ),
    # class config exploded; `ragweed` is in two classes to exercise first-match
    "fx_terms": (
        (),
        """
select * from (values ('pigweed', 'weed', 1, 0, 0), ('ragweed', 'weed', 1, 0, 1),
       ('corn', 'crop', 2, 1, 0), ('ragweed', 'other', 3, 2, 0)) as t(term, class_name, prediction_value, cfg_ord, term_ord)
""",
    ),
    # ground truth, jittered copies of 2/3 of the raw boxes
    "fx_gt": (
        ("fx_detections",),
        """
select img, ord, case when term = 'corn' then 'crop' else 'weed' end as class,
       x1 + (ord % 7) - 3 as x1, y1 + (ord % 5) - 2 as y1, x2 + (ord % 7) - 3 as x2, y2 + (ord % 3) - 1 as y2
from fx_detections where ord % 3 <> 0
""",
    ),
    # GPS parts, 3 parts = DMS, 2 = DDM; 10 images have none
    "fx_gps": (
        ("orders",),
        """
select img, cast(2 + k % 2 as int) as n_parts, 40 as lat_d,
       case when k % 2 = 1 then 3e0 else 3e0 + cast(k % 10 as double) / 100 end as lat_m,
       case when k % 2 = 1 then cast(k % 10 as double) / 2 else null end as lat_s, 'N' as lat_ref,
       83 as lon_d, case when k % 2 = 1 then 1e0 else 1e0 + cast(k % 13 as double) / 100 end as lon_m,
       case when k % 2 = 1 then cast(k % 13 as double) / 2 else null end as lon_s, 'W' as lon_ref
from (select distinct concat('img_', lpad(cast(o_orderkey % 200 as string), 4, '0'), '.jpg') as img, o_orderkey % 200 as k
      from orders where o_orderkey % 200 >= 10) t
""",
    ),
    # geo samples
    "fx_residue": (
        ("events",),
        """
select event_id as id, 4e1 + cast((event_id * 7919) % 100003 as double) / 100003 * 4e-3 as latitude,
       -83e0 + cast((event_id * 104729) % 99991 as double) / 99991 * 5e-3 as longitude,
       value / 500 as residue_fraction
from events
""",
    ),
    # support vectors
    "fx_supports": (
        ("embeddings",),
        """
select 'dinov3' as backend, concat('class_', cast(label as string)) as class, vec_id as ord, embedding
from embeddings where vec_id % 10 = 0
""",
    ),
    # proposal vectors, 270 per image; `label` is the truth for checks only
    "fx_proposals": (
        ("embeddings",),
        """
select 'dinov3' as backend, 'sam3' as proposer, concat('q_', cast(cast(floor(vec_id / 300) as bigint) as string)) as image_key, vec_id as ord,
       cast((vec_id * 37) % 100 as double) / 100 as score,
       cast((vec_id * 53) % 400 as double) as x1, cast((vec_id * 71) % 300 as double) as y1,
       cast((vec_id * 53) % 400 + 60 as double) as x2, cast((vec_id * 71) % 300 + 50 as double) as y2,
       embedding, label
from embeddings where vec_id % 10 <> 0
""",
    ),
    # op timings
    "fx_timings": (
        ("events",),
        """
select event_type as name, value as ms from events
""",
    ),
    # label raster in long form, 255 = ignore
    "fx_pixels": (
        ("events",),
        """
select user_id as image, user_id % 10 as batch, event_id as pix,
       cast(case when event_id % 50 = 0 then 255 else event_id % 5 end as int) as gt,
       cast(case when (event_id * 7) % 11 < 8 then event_id % 5 else event_id % 4 end as int) as pred
from events
""",
    ),
    # segmentation requests
    "fx_requests": (
        ("events",),
        """
select event_id, concat('p', cast(user_id as string)) as pipe_id, concat('i', cast(event_id % 3 as string)) as image_id, ts
from events
""",
    ),
}


def _closure(names: list[str]) -> list[str]:
    need: list[str] = []
    for name in names:
        if name in VIEWS:
            for dep in _closure([d for d in VIEWS[name][0]]) + [name]:
                if dep not in need:
                    need.append(dep)
    return need


def with_views(*names: str, body: str, recursive: bool = False) -> str:
    """``body`` prefixed by the definitions of ``names`` (and their inputs) as CTEs.

    ``body`` may begin with further CTEs: write them as ``name as (...), ... select``
    after a leading comma.
    """
    ctes = ",\n".join(f"{n} as ({VIEWS[n][1].strip()})" for n in _closure(list(names)))
    word = "with recursive" if recursive else "with"
    return f"{word} {ctes}\n{body.strip()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the given tables."""
    inputs, sql = VIEWS[name]
    for dep in inputs:
        (view if dep in VIEWS else table)(spark, sf_dir, dep).createOrReplaceTempView(dep)
    return spark.sql(sql)
