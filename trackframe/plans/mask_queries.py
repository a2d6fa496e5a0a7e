"""Masks that differ by site and bout."""

from pyspark.sql import functions as F

from trackframe.operators import kinematics as k, masks as mk
from trackframe.plans import fixtures as fx
from trackframe.plans.activity_queries import DIRECTED, r
from trackframe.plans.registry import query, rounded

# three bouts of nine days at each site, with days between them that belong to none; a diamond for each
BOUTS = """
bouts as (select s as site_id, b as bout, date '2024-01-01' + (10 * b + s)::int as first_day, date '2024-01-01' + (10 * b + s + 8)::int as last_day,
                 400 * s + 100 * b + 60 as cx, 250 + 150 * b + 40 * s as cy, 120 + 30 * b + 10 * s as radius
          from (values (1), (2), (3)) v(s), (values (0), (1), (2)) w(b)),
in_bout as (select t.*, b.bout, cx, cy, radius from tracks t left join bouts b on b.site_id = t.site_id and t.day between first_day and last_day),
edge as (select site_id, bout, (cy + dy) * 100000 + cx + dx as idx, cx + dx as bx, cy + dy as byy
         from bouts, range(-220, 221) a(dx), range(-220, 221) b(dy) where abs(dx) + abs(dy) = radius)
"""
MX = fx.with_ctes(fx.TRACKS, BOUTS)


def bouts(spark):
    first = F.date_add(F.lit("2024-01-01").cast("date"), (10 * F.col("bout") + F.col("site_id")).cast("int"))
    return (spark.range(9).select((F.floor(F.col("id") / 3) + 1).cast("int").alias("site_id"), (F.col("id") % 3).cast("int").alias("bout"))
            .withColumns({"first_day": first, "last_day": F.date_add(first, 8)}))


def runs(spark):
    """A diamond at each site and bout: one run for every row of pixels."""
    s, b = F.col("site_id"), F.col("bout")
    d = bouts(spark).select("site_id", "bout", (400 * s + 100 * b + 60).alias("cx"), (250 + 150 * b + 40 * s).alias("cy"),
                            (120 + 30 * b + 10 * s).alias("radius"))
    d = d.withColumn("dy", F.explode(F.sequence(-F.col("radius"), F.col("radius"))))
    half = F.col("radius") - F.abs("dy")
    return d.select("site_id", "bout", (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") - half).alias("x_from"),
                    (F.col("cx") + half).alias("x_to"))


def rows(spark, sf_dir):
    return mk.with_bout(fx.tracks(spark, sf_dir), bouts(spark))


@query("rows_of_bouts", MX + "select seq, site_id, day, bout from in_bout")
def rows_of_bouts(spark, sf_dir):
    return rows(spark, sf_dir).select("seq", "site_id", "day", "bout")


@query("rows_on_bout_masks", MX + """
select seq, site_id, bout from in_bout where abs(trunc(center_x) - cx) + abs(trunc(center_y) - cy) <= radius""")
def rows_on_bout_masks(spark, sf_dir):
    return mk.keep_on_runs(rows(spark, sf_dir), runs(spark)).select("seq", "site_id", "bout")


@query("rows_off_bout_masks", MX + """
select seq, site_id, bout from in_bout where bout is null or abs(trunc(center_x) - cx) + abs(trunc(center_y) - cy) > radius""")
def rows_off_bout_masks(spark, sf_dir):
    return mk.drop_on_runs(rows(spark, sf_dir), runs(spark)).select("seq", "site_id", "bout")


@query("bout_mask_runs", MX + """
, px as (select site_id, bout, cy + dy as y, cx + dx as x from bouts, range(-220, 221) a(dx), range(-220, 221) b(dy)
         where abs(dx) + abs(dy) <= radius),
pos as (select distinct site_id, bout, trunc(center_x)::bigint as x, trunc(center_y)::bigint as y from in_bout where bout is not null),
seen as (select * from px semi join pos using (site_id, bout, x, y)),
island as (select *, x - row_number() over (partition by site_id, bout, y order by x) as i from seen)
select site_id, bout, y::int as y, min(x)::int as x_from, max(x)::int as x_to from island group by site_id, bout, y, i""")
def bout_mask_runs(spark, sf_dir):
    """The visited part of each mask, as runs."""
    seen = k.centred(mk.keep_on_runs(rows(spark, sf_dir), runs(spark)))
    pixels = seen.select("site_id", "bout", F.col("center_x").cast("int").alias("x"), F.col("center_y").cast("int").alias("y"))
    return mk.runs_of(pixels, ["site_id", "bout"])


@query("bout_boundary_points", MX + """
, near as (select seq, idx, (trunc(center_x) - bx) ** 2 + (trunc(center_y) - byy) ** 2 as d2
           from in_bout t join edge e on e.site_id = t.site_id and e.bout = t.bout)
select t.seq, n.near_idx, n.near_d2 from tracks t left join (
  select seq, min(struct_pack(d := d2, i := idx)).i::int as near_idx, min(d2)::bigint as near_d2 from near group by seq) n using (seq)""")
def bout_boundary_points(spark, sf_dir):
    p = mk.nearest_of_mask(k.centred(rows(spark, sf_dir)), runs(spark))
    return p.select("seq", F.col("near.idx").alias("near_idx"), F.col("near.d2").alias("near_d2"))


@query("bout_directions", fx.with_ctes(fx.TRACKS, BOUTS, DIRECTED.replace(
    "from pairs0 p, boundary b where p.px is not null",
    "from pairs0 p join (select seq, site_id, bout from in_bout) t using (seq) left join edge b on b.site_id = t.site_id and b.bout = t.bout where p.px is not null")) + """
select seq, video_id, ant_id, frame_number, case when bx is not null then round(new_angle + 1e-9, 6) + 0.0 end as angle,
       case when bx is null or new_angle = -1 then 'unknown' when new_angle < 70 then 'away'
            when new_angle > 110 then 'toward' else 'unknown' end as direction from angles""")
def bout_directions(spark, sf_dir):
    d = mk.direction_of_mask(rows(spark, sf_dir), runs(spark))
    return rounded(d.select("seq", "video_id", "ant_id", "frame_number", "angle", "direction"))


@query("bout_nest_proximities", MX + f"""
, s as (select site_id, bout, video_id, ant_id, count(*) as trajectory_length, min_by(trunc(center_x), (frame_number, seq)) as x,
               min_by(trunc(center_y), (frame_number, seq)) as y, any_value(cx) as cx, any_value(cy) as cy, any_value(radius) as radius
        from in_bout group by site_id, bout, video_id, ant_id),
d as (select s.site_id, s.bout, video_id, ant_id, any_value(trajectory_length) as trajectory_length,
             case when max(abs(x - cx) + abs(y - cy) - radius) <= 0 then 0 else sqrt(min((x - bx) ** 2 + (y - byy) ** 2)) end as nest_proximity
      from s join edge e on e.site_id = s.site_id and e.bout = s.bout group by s.site_id, s.bout, video_id, ant_id)
select site_id, bout, video_id, ant_id, trajectory_length, {r('nest_proximity')} from d""")
def bout_nest_proximities(spark, sf_dir):
    p = mk.proximity_of_mask(rows(spark, sf_dir).filter("bout is not null"), runs(spark))
    return rounded(p.select("site_id", "bout", "video_id", "ant_id", "trajectory_length", "nest_proximity"))
