"""Adapters from the given tables to the library's canonical tables.

`tracks` reads the event stream as positions of individuals, `detections` reads line items as
boxes on frames. The same text exists as DuckDB common table expressions for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHADE = (860, 440, 1060, 640)  # rectangle used as ignored area and as nest


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("ts")
    site = (F.col("user_id") % 3 + 1).cast("int")
    k = F.get_json_object("props", "$.k").cast("bigint")
    cx = (F.round(F.col("value") * 100).cast("bigint") % 1920).cast("int")
    cy = ((k * 11 + F.col("event_id") % 11) % 1080).cast("int")
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        site.alias("site_id"),
        F.to_date("ts").alias("day"),
        F.hour("ts").alias("hour"),
        (site * 10 + F.floor((day - 1) / 10)).cast("int").alias("video_id"),
        F.col("user_id").alias("ant_id"),
        (((day - 1) % 10) * 144 + F.hour("ts") * 6 + F.floor(F.minute("ts") / 10))
        .cast("int").alias("frame_number"),
        (cx - 10).alias("x1"), (cy - 10).alias("y1"),
        (cx + 10).alias("x2"), (cy + 10).alias("y2"),
        F.when(kind.isin("click", "signup"), "away")
        .when(kind.isin("view", "purchase"), "toward").otherwise("unknown").alias("direction"),
        ((F.col("event_id") * 37) % 181).cast("double").alias("angle"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
    )


TRACKS = """
tracks as (
  select site_id, day, hour, video_id, ant_id, frame_number, cx - 10 as x1, cy - 10 as y1,
         cx + 10 as x2, cy + 10 as y2, cx::double as center_x, cy::double as center_y,
         direction, angle, seq, ts
  from (
    select (user_id % 3 + 1)::int as site_id, cast(ts as date) as day, hour(ts)::int as hour,
           ((user_id % 3 + 1) * 10 + (day(ts) - 1) // 10)::int as video_id, user_id as ant_id,
           (((day(ts) - 1) % 10) * 144 + hour(ts) * 6 + minute(ts) // 10)::int as frame_number,
           (cast(round(value * 100) as bigint) % 1920)::int as cx,
           ((cast(json_extract_string(props, '$.k') as bigint) * 11 + event_id % 11) % 1080)::int as cy,
           case when event_type in ('click', 'signup') then 'away'
                when event_type in ('view', 'purchase') then 'toward' else 'unknown' end as direction,
           cast((event_id * 37) % 181 as double) as angle, event_id as seq, ts
    from events))
"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.round(F.col("l_extendedprice") * 100).cast("bigint") % 100
    py = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 100
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 20).cast("int").alias("video_id"),
        F.floor(F.col("l_partkey") / 20).cast("int").alias("frame_number"),
        (F.col("l_discount") * 10).alias("confidence"),
        px.cast("int").alias("px"), py.cast("int").alias("py"),
        (F.col("l_returnflag") == "N").alias("is_gt"),
    )


def boxed(df: DataFrame, x: str = "px", y: str = "py", half: int = 10) -> DataFrame:
    return df.select("*", (F.col(x) - half).alias("x1"), (F.col(y) - half).alias("y1"),
                     (F.col(x) + half).alias("x2"), (F.col(y) + half).alias("y2"))


DETECTIONS = """
det as (
  select (l_partkey % 20)::int as video_id, (l_partkey // 20)::int as frame_number,
         l_discount * 10 as confidence,
         (cast(round(l_extendedprice * 100) as bigint) % 100)::int as px,
         ((l_orderkey * 7 + l_linenumber * 13) % 100)::int as py,
         l_returnflag = 'N' as is_gt
  from lineitem)
"""


def clips(tracks_df: DataFrame) -> DataFrame:
    """One row per site, day and hour that has tracks, with its environment readings."""
    d = F.dayofmonth("day")
    return tracks_df.select("site_id", "day", "hour").distinct().select(
        "site_id", "day", "hour",
        (10 + (F.col("hour") * 7 + d * 3) % 23).cast("double").alias("temperature"),
        (30 + (F.col("hour") * 5 + d * 11) % 61).cast("double").alias("humidity"),
        ((F.col("hour") * F.col("hour") * 13 + d) % 997).cast("double").alias("lux"),
    )


CLIPS = """
clips as (
  select distinct site_id, day, hour,
         (10 + (hour * 7 + day(day) * 3) % 23)::double as temperature,
         (30 + (hour * 5 + day(day) * 11) % 61)::double as humidity,
         ((hour * hour * 13 + day(day)) % 997)::double as lux
  from tracks)
"""


def nest_boundary(spark: SparkSession) -> DataFrame:
    """Corner-to-corner perimeter of the shaded rectangle, one point every 20 px, clockwise."""
    x1, y1, x2, y2 = SHADE
    i = F.col("id").cast("int")
    nx, ny = (x2 - x1) // 20, (y2 - y1) // 20
    bx = (F.when(i < nx, x1 + i * 20).when(i < nx + ny, x2)
          .when(i < 2 * nx + ny, x2 - (i - nx - ny) * 20).otherwise(x1))
    by = (F.when(i < nx, y1).when(i < nx + ny, y1 + (i - nx) * 20)
          .when(i < 2 * nx + ny, y2).otherwise(y2 - (i - 2 * nx - ny) * 20))
    return spark.range(2 * (nx + ny)).select(
        i.alias("idx"), bx.cast("int").alias("bx"), by.cast("int").alias("by"))


BOUNDARY = """
boundary as (
  select i::int as idx,
         (case when i < 10 then 860 + i * 20 when i < 20 then 1060
               when i < 30 then 1060 - (i - 20) * 20 else 860 end)::int as bx,
         (case when i < 10 then 440 when i < 20 then 440 + (i - 10) * 20
               when i < 30 then 640 else 640 - (i - 30) * 20 end)::int as byy
  from range(40) t(i))
"""


def ignored_pixels(spark: SparkSession) -> DataFrame:
    """Pixels of the shaded rectangle, borders included."""
    x1, y1, x2, y2 = SHADE
    w, h = x2 - x1 + 1, y2 - y1 + 1
    return spark.range(w * h).select(
        (F.col("id") % w + x1).cast("int").alias("x"),
        (F.floor(F.col("id") / w) + y1).cast("int").alias("y"))


def trail_cells(spark: SparkSession) -> DataFrame:
    """Four straight trails on the 20 px grid."""
    def leg(trail: int, n: int, x: Column, y: Column) -> DataFrame:
        return spark.range(n).select(
            F.lit(trail).alias("trail_id"), F.col("id").cast("int").alias("seq"),
            x.cast("int").alias("x_bin"), y.cast("int").alias("y_bin"))
    k = F.col("id")
    return (leg(0, 44, k, F.lit(27)).unionByName(leg(1, 44, 52 + k, F.lit(27)))
            .unionByName(leg(2, 23, F.lit(48), k)).unionByName(leg(3, 23, 52 + k, 31 + k)))


TRAIL_CELLS = """
trail_cells as (
  select 0 as trail_id, k::int as seq, k::int as x_bin, 27 as y_bin from range(44) t(k)
  union all select 1, k::int, (52 + k)::int, 27 from range(44) t(k)
  union all select 2, k::int, 48, k::int from range(23) t(k)
  union all select 3, k::int, (52 + k)::int, (31 + k)::int from range(23) t(k))
"""

# speeds between consecutive rows of a track, as in operators.kinematics.speeds
SPEEDS = """
speeds as (
  select *, case when frame_diff > 0 then sqrt(dx * dx + dy * dy) / frame_diff * 20 else 0 end as velocity,
         case when frame_diff > 0 then degrees(atan2(dy, dx)) else 0 end as heading_deg
  from (
    select *, count(*) over (partition by video_id, ant_id) as track_rows,
           center_x - lag(center_x) over w as dx, center_y - lag(center_y) over w as dy,
           frame_number - lag(frame_number) over w as frame_diff
    from tracks window w as (partition by video_id, ant_id order by frame_number, seq))
  where track_rows >= 2)
"""

# per slot, direction and cell: flux of moving individuals, as in operators.grids.flux
FLUX = """
moving as (
  select *, case when ceil(center_x / 20) - 1 between 0 and 95 then (ceil(center_x / 20) - 1)::int end as x_bin,
         case when ceil(center_y / 20) - 1 between 0 and 53 then (ceil(center_y / 20) - 1)::int end as y_bin
  from speeds where velocity > 0),
slot_frames as (
  select site_id, day, hour, direction, count(distinct (video_id, frame_number)) as n_frames
  from moving group by all),
flux as (
  select site_id, day, hour, direction, x_bin, y_bin, n_rows, n_rows / n_frames as rows_per_frame,
         n_rows / n_frames * mu as u, n_rows / n_frames * mv as v,
         sqrt((n_rows / n_frames * mu) ** 2 + (n_rows / n_frames * mv) ** 2) as flux_mag
  from (select site_id, day, hour, direction, x_bin, y_bin, count(*) as n_rows,
               avg(cos(radians(heading_deg)) * velocity) as mu,
               avg(sin(radians(heading_deg)) * velocity) as mv
        from moving where x_bin is not null and y_bin is not null group by all)
  join slot_frames using (site_id, day, hour, direction))
"""


def with_ctes(*ctes: str) -> str:
    return "with recursive " + ",\n".join(c.strip() for c in ctes) + "\n"
