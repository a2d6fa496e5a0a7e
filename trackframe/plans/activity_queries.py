"""Activity reports: counts, speeds, encounters."""

from pyspark.sql import functions as F

from trackframe.functions import geometry as g
from trackframe.operators import activity as a, kinematics as k
from trackframe.plans import fixtures as fx
from trackframe.plans.registry import query, rounded

T = fx.with_ctes(fx.TRACKS)
TS = fx.with_ctes(fx.TRACKS, fx.SPEEDS)

RATES = """
rates as (
  select site_id, day, hour, count(distinct (video_id, frame_number)) as n_frames,
         count(*) filter (direction = 'away') / count(distinct (video_id, frame_number)) as away,
         count(*) filter (direction = 'toward') / count(distinct (video_id, frame_number)) as toward,
         count(*) filter (direction = 'unknown') / count(distinct (video_id, frame_number)) as unknown,
         count(*) / count(distinct (video_id, frame_number)) as total
  from tracks group by all)
"""
TR = fx.with_ctes(fx.TRACKS, RATES)


def r(*cols):
    return ", ".join(f"round({c} + 1e-9, 6) + 0.0 as {c}" for c in cols)


@query("hourly_direction_difference", TR + f"""
select site_id, hour, round(avg(away - toward) + 1e-9, 6) + 0.0 as difference, count(*) as n_slots
from rates group by all""")
def hourly_direction_difference(spark, sf_dir):
    return rounded(a.direction_difference(a.direction_rates(fx.tracks(spark, sf_dir))))


@query("clip_direction_rates", TR + f"""
select site_id, day, hour, n_frames, {r('away', 'toward', 'unknown', 'total')} from rates""")
def clip_direction_rates(spark, sf_dir):
    return rounded(a.direction_rates(fx.tracks(spark, sf_dir)))


@query("site_day_activity", TR + f"""
select site_id, day, hour, {r('total')} from rates
where site_id = 2 and day >= (select min(cast(ts as date)) from events)""")
def site_day_activity(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    first = fx.read(spark, sf_dir, "events").agg(F.min("ts")).first()[0].date().isoformat()
    return rounded(a.direction_rates(a.in_slots(t, site=2, first_day=first))
                   .select("site_id", "day", "hour", "total"))


@query("clip_speed_means", TS + f"""
select site_id, day, hour,
       round(coalesce(avg(velocity) filter (direction = 'away'), 0) + 1e-9, 6) + 0.0 as away,
       round(coalesce(avg(velocity) filter (direction = 'toward'), 0) + 1e-9, 6) + 0.0 as toward,
       round(coalesce(avg(velocity) filter (direction = 'unknown'), 0) + 1e-9, 6) + 0.0 as unknown,
       round(avg(velocity) + 1e-9, 6) + 0.0 as total
from speeds group by all""")
def clip_speed_means(spark, sf_dir):
    return rounded(a.speed_means(k.speeds(fx.tracks(spark, sf_dir))))


@query("track_speeds", TS + f"""
select seq, video_id, ant_id, frame_number, {r('velocity', 'heading_deg')}, angle, direction from speeds""")
def track_speeds(spark, sf_dir):
    s = k.speeds(fx.tracks(spark, sf_dir))
    return rounded(s.select("seq", "video_id", "ant_id", "frame_number", "velocity", "heading_deg",
                            "angle", "direction"))


@query("moving_speed_list", TS + f"""
select seq, video_id, ant_id, {r('velocity')} from speeds where velocity > 0""")
def moving_speed_list(spark, sf_dir):
    s = k.moving_speeds(k.speeds(fx.tracks(spark, sf_dir)))
    return rounded(s.select("seq", "video_id", "ant_id", "velocity"))


@query("corner_displacements", T + f"""
select seq, dx, dy, round(sqrt(dx * dx + dy * dy) + 1e-9, 6) + 0.0 as displacement from (
  select seq, coalesce(x1 - lag(x1) over w, 0)::double as dx, coalesce(y1 - lag(y1) over w, 0)::double as dy
  from tracks window w as (partition by video_id, ant_id order by frame_number, seq))""")
def corner_displacements(spark, sf_dir):
    return rounded(k.displacements(fx.tracks(spark, sf_dir)).select("seq", "dx", "dy", "displacement"))


@query("individuals_per_frame", T + """
select video_id, frame_number, count(distinct ant_id) as n_ants from tracks group by all""")
def individuals_per_frame(spark, sf_dir):
    return a.individuals_per_frame(fx.tracks(spark, sf_dir))


PAIRS = """
pairs as (
  select p.site_id, p.day, p.hour, p.video_id, p.frame_number, p.direction
  from tracks p join tracks q
    on p.video_id = q.video_id and p.frame_number = q.frame_number and p.direction = q.direction
   and p.seq < q.seq
  where sqrt((p.center_x - q.center_x) ** 2 + (p.center_y - q.center_y) ** 2) > 0
    and sqrt((p.center_x - q.center_x) ** 2 + (p.center_y - q.center_y) ** 2) < 200)
"""


@query("frame_encounters", fx.with_ctes(fx.TRACKS, PAIRS) + """
select video_id, frame_number, direction, count(*) as n_encounters from pairs group by all""")
def frame_encounters(spark, sf_dir):
    return a.encounters(fx.tracks(spark, sf_dir), 200.0)


@query("clip_encounter_rates", fx.with_ctes(fx.TRACKS, PAIRS) + """
, frames as (select site_id, day, hour, direction, count(distinct (video_id, frame_number)) as f
             from tracks group by all),
met as (select site_id, day, hour, direction, count(*) as e from pairs group by all),
rate as (select site_id, day, hour, direction, coalesce(e, 0) / f as rate
         from frames left join met using (site_id, day, hour, direction))
select site_id, day, hour, round(coalesce(max(rate) filter (direction = 'away'), 0) + 1e-9, 6) + 0.0 as away,
       round(coalesce(max(rate) filter (direction = 'toward'), 0) + 1e-9, 6) + 0.0 as toward,
       round(coalesce(max(rate) filter (direction = 'unknown'), 0) + 1e-9, 6) + 0.0 as unknown
from rate group by all""")
def clip_encounter_rates(spark, sf_dir):
    return rounded(a.encounter_rates(fx.tracks(spark, sf_dir), 200.0))


@query("aligned_directions", T + """
select site_id, day, hour, count(*) filter (direction = 'away') as away,
       count(*) filter (direction = 'toward') as toward
from tracks group by all""")
def aligned_directions(spark, sf_dir):
    return a.by_direction(fx.tracks(spark, sf_dir), F.count(F.lit(1)), missing=0)


@query("gt_and_predicted_counts", fx.with_ctes(fx.DETECTIONS) + f"""
select video_id, {r('gt_mean', 'gt_std', 'pred_mean', 'pred_std')} from (
  select video_id, avg(gt) as gt_mean, stddev_pop(gt) as gt_std, avg(pred) as pred_mean,
         stddev_pop(pred) as pred_std
  from (select video_id, frame_number, count(*) filter (is_gt) as gt, count(*) filter (not is_gt) as pred
        from det group by all) group by all)""")
def gt_and_predicted_counts(spark, sf_dir):
    return rounded(a.frame_count_summary(fx.detections(spark, sf_dir)))


@query("sampled_clip_counts", fx.with_ctes(fx.DETECTIONS) + f"""
, total as (select video_id, max(frame_number) + 1 as n_frames from det group by all),
frames as (select distinct video_id, trunc(10 + i * ((n_frames - 1 - 10) / 19.0::double))::int as frame_number
           from total, range(20) t(i)),
n as (select video_id, frame_number, count(*) as n from det group by all)
select video_id, round(avg(coalesce(n, 0)) + 1e-9, 6) + 0.0 as mean_count,
       round(stddev_pop(coalesce(n, 0)) + 1e-9, 6) + 0.0 as std_count, count(*) as n_sampled
from frames left join n using (video_id, frame_number) group by all""")
def sampled_clip_counts(spark, sf_dir):
    d = fx.detections(spark, sf_dir)
    clips = d.groupBy("video_id").agg((F.max("frame_number") + 1).alias("n_frames"))
    return rounded(a.sampled_clip_counts(d, a.even_frames(clips, 20)))


@query("predictions_on_gt_frames", fx.with_ctes(fx.DETECTIONS) + """
, gt as (select video_id, frame_number, count(*) as n_gt from det where is_gt group by all),
pred as (select video_id, frame_number, count(*) as n_pred from det
         where not is_gt and confidence >= 0.327 group by all)
select video_id, frame_number, n_gt, coalesce(n_pred, 0) as n_pred
from gt left join pred using (video_id, frame_number)""")
def predictions_on_gt_frames(spark, sf_dir):
    d = fx.detections(spark, sf_dir)
    gt = d.filter("is_gt").groupBy(*a.FRAME).agg(F.count("*").alias("n_gt"))
    pred = (d.filter(~F.col("is_gt") & (F.col("confidence") >= 0.327))
            .groupBy(*a.FRAME).agg(F.count("*").alias("n_pred")))
    return a.counts_on_frames(gt, pred, "n_pred")


@query("temperature_lists_by_hour", fx.with_ctes(fx.TRACKS, fx.CLIPS) + """
select site_id, hour, array_to_string(list(temperature::int order by day), ',') as temperatures
from clips group by all""")
def temperature_lists_by_hour(spark, sf_dir):
    s = a.hour_series(fx.clips(fx.tracks(spark, sf_dir)), "temperature")
    return s.select("site_id", "hour", F.concat_ws(
        ",", F.transform("temperature_list", lambda x: x.cast("int").cast("string"))).alias("temperatures"))


@query("hourly_mean_readings", T + """
select site_id, date_trunc('hour', ts) as hour_start, round(avg(angle) + 1e-9, 6) + 0.0 as angle
from tracks group by all""")
def hourly_mean_readings(spark, sf_dir):
    return rounded(a.hourly_means(fx.tracks(spark, sf_dir), "angle"))


DIRECTED = """
pairs0 as (
  select seq, video_id, ant_id, frame_number, center_x, center_y,
         lag(center_x) over w as px, lag(center_y) over w as py
  from tracks window w as (partition by video_id, ant_id order by frame_number, seq)),
near as (
  select p.*, b.bx, b.byy from pairs0 p, boundary b where p.px is not null
  qualify row_number() over (partition by p.seq order by
     (trunc(center_x) - bx) ** 2 + (trunc(center_y) - byy) ** 2, idx) = 1),
vecs as (
  select *, center_x - bx as ux, center_y - byy as uy, center_x - px as vx, center_y - py as vy from near),
angles as (
  select *, case when sqrt(ux*ux + uy*uy) * sqrt(vx*vx + vy*vy) = 0 then -1.0::double
     else degrees(acos(least(1.0::double, greatest(-1.0::double,
        (ux*vx + uy*vy) / (sqrt(ux*ux + uy*uy) * sqrt(vx*vx + vy*vy)))))) end as new_angle from vecs)
"""


@query("movement_directions", fx.with_ctes(fx.TRACKS, fx.BOUNDARY, DIRECTED) + """
select seq, video_id, ant_id, frame_number, round(new_angle + 1e-9, 6) + 0.0 as angle,
       case when new_angle = -1 then 'unknown' when new_angle < 70 then 'away'
            when new_angle > 110 then 'toward' else 'unknown' end as direction from angles""")
def movement_directions(spark, sf_dir):
    d = k.movement_direction(fx.tracks(spark, sf_dir), fx.nest_boundary(spark))
    return rounded(d.select("seq", "video_id", "ant_id", "frame_number", "angle", "direction"))


@query("nearest_boundary_points", fx.with_ctes(fx.TRACKS, fx.BOUNDARY) + """
select seq, idx as near_idx, d2 as near_d2 from (
  select seq, idx, ((trunc(center_x) - bx) ** 2 + (trunc(center_y) - byy) ** 2)::bigint as d2
  from tracks, boundary
  qualify row_number() over (partition by seq order by d2, idx) = 1)""")
def nearest_boundary_points(spark, sf_dir):
    p = k.nearest_boundary(k.centred(fx.tracks(spark, sf_dir)), fx.nest_boundary(spark))
    return p.select("seq", F.col("near.idx").alias("near_idx"), F.col("near.d2").alias("near_d2"))


@query("entrance_directions", T + """
, d as (select *, sqrt((center_x - 960) ** 2 + (center_y - 400) ** 2) as dist from tracks),
c as (select *, dist - lag(dist) over (partition by video_id, ant_id order by frame_number, seq) as change from d)
select seq, round(change + 1e-9, 6) + 0.0 as change, case when change > 0 then 'away' else 'toward' end as direction
from c where abs(change) >= 2 and abs(change) < 20""")
def entrance_directions(spark, sf_dir):
    d = k.entrance_direction(fx.tracks(spark, sf_dir), (960.0, 400.0))
    return rounded(d.select("seq", "change", "direction"))


@query("recent_paths", T + """
, s as (select *, coalesce(sqrt((center_x - lag(center_x) over w) ** 2 + (center_y - lag(center_y) over w) ** 2), 0) as step
        from tracks window w as (partition by video_id, ant_id order by frame_number, seq))
select seq, round(sum(step) over (partition by video_id, ant_id order by frame_number, seq
                                  rows between 19 preceding and current row) + 1e-9, 6) + 0.0 as recent_path from s""")
def recent_paths(spark, sf_dir):
    return rounded(k.recent_path(fx.tracks(spark, sf_dir)).select("seq", "recent_path"))
