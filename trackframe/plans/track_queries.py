"""Boxes, filters, matching against ground truth, and per-trajectory operators."""

from pyspark.sql import functions as F

from trackframe.functions import geometry as g, names
from trackframe.functions.ordering import tracks_with_at_least
from trackframe.operators import filters as fl, kinematics as k, matching as m, trajectories as tj
from trackframe.plans import fixtures as fx
from trackframe.plans.activity_queries import r
from trackframe.plans.registry import query, r6, rounded

T = fx.with_ctes(fx.TRACKS)
D = fx.with_ctes(fx.DETECTIONS)

# ---- boxes and filters -------------------------------------------------------------------


@query("box_centres", T + "select seq, center_x, center_y from tracks")
def box_centres(spark, sf_dir):
    return k.centred(fx.tracks(spark, sf_dir)).select("seq", "center_x", "center_y")


@query("point_boxes", T + """
select seq, greatest(0, center_x::int - 10) as x1, greatest(0, center_y::int - 10) as y1,
       least(1920, center_x::int + 10) as x2, least(1080, center_y::int + 10) as y2 from tracks""")
def point_boxes(spark, sf_dir):
    t = k.centred(fx.tracks(spark, sf_dir))
    return t.select("seq", g.point_box("center_x", "center_y").alias("b")).select("seq", "b.*")


# boxes whose size depends on the row, so that some are too small
@query("normalised_boxes", T + """
, b as (select seq, x1, y1, x1 + (seq % 40)::int as x2, y1 + (seq % 31)::int as y2 from tracks),
c as (select seq, round_even((x1 + x2) / 2, 0)::int as cx, round_even((y1 + y2) / 2, 0)::int as cy from b
      where x2 - x1 >= 10 and y2 - y1 >= 10)
select seq, least(greatest(cx - 10, 0), 1919) as x1, least(greatest(cy - 10, 0), 1079) as y1,
       least(greatest(cx + 10, 0), 1919) as x2, least(greatest(cy + 10, 0), 1079) as y2 from c""")
def normalised_boxes(spark, sf_dir):
    t = fx.tracks(spark, sf_dir).select(
        "seq", "x1", "y1", (F.col("x1") + (F.col("seq") % 40).cast("int")).alias("x2"),
        (F.col("y1") + (F.col("seq") % 31).cast("int")).alias("y2"))
    return fl.normalised_boxes(t)


@query("box_formats", T + """
select seq, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h, round(center_x / 1920, 9) + 0.0 as xc,
       round(center_y / 1080, 9) + 0.0 as yc, round(20.0::double / 1920, 9) + 0.0 as wn,
       round(20.0::double / 1080, 9) + 0.0 as hn from tracks""")
def box_formats(spark, sf_dir):
    box = ("x1", "y1", "x2", "y2")
    t = fx.tracks(spark, sf_dir).select("seq", g.corner_size(*box).alias("c"), g.unit_centre_box(*box).alias("u"))
    unit = {"xc": "xc", "yc": "yc", "w": "wn", "h": "hn"}
    return t.select("seq", "c.*", *[F.round(f"u.{f}", 9).alias(n) for f, n in unit.items()])


@query("confident_detections", D + """
select video_id, count(*) as n, round(sum(confidence) + 1e-9, 6) + 0.0 as total from det where confidence >= 0.327 group by all""")
def confident_detections(spark, sf_dir):
    d = fl.confident(fx.detections(spark, sf_dir))
    return rounded(d.groupBy("video_id").agg(F.count("*").alias("n"), F.sum("confidence").alias("total")))


@query("unmasked_rows", T + """
select seq, video_id, frame_number from tracks
where not (trunc(center_x) between 860 and 1060 and trunc(center_y) between 440 and 640)""")
def unmasked_rows(spark, sf_dir):
    return fl.drop_ignored(fx.tracks(spark, sf_dir), fx.ignored_pixels(spark)).select("seq", "video_id", "frame_number")


@query("rows_on_mask", T + """
select seq, video_id, frame_number from tracks
where trunc(center_x) between 860 and 1060 and trunc(center_y) between 440 and 640""")
def rows_on_mask(spark, sf_dir):
    return fl.keep_on_mask(fx.tracks(spark, sf_dir), fx.ignored_pixels(spark)).select("seq", "video_id", "frame_number")


@query("window_of_frames", T + """
select seq, video_id, (frame_number - 300 + 1)::int as frame_number from tracks where frame_number between 300 and 329""")
def window_of_frames(spark, sf_dir):
    return fl.frame_window(fx.tracks(spark, sf_dir), 300, 30).select("seq", "video_id", "frame_number")


@query("long_tracks", T + """
select seq, video_id, ant_id from tracks qualify count(*) over (partition by video_id, ant_id) >= 20""")
def long_tracks(spark, sf_dir):
    return tracks_with_at_least(fx.tracks(spark, sf_dir), k.TRACK, 20).select("seq", "video_id", "ant_id")


@query("one_direction", T + "select seq, angle from tracks where direction = 'toward'")
def one_direction(spark, sf_dir):
    from trackframe.operators.activity import moving
    return moving(fx.tracks(spark, sf_dir), "toward").select("seq", "angle")


SCORES = """
scores as (select video_id, ant_id, round(avg(angle) / 180, 9) as excavating_score,
                  case when (ant_id // 3 + video_id) % 3 = 0 then 1 else 0 end as label,
                  count(*) as n_rows from tracks group by all)
"""
TSC = fx.with_ctes(fx.TRACKS, SCORES)


def scores(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    return t.groupBy("video_id", "ant_id").agg(
        F.round(F.avg("angle") / 180, 9).alias("excavating_score"), F.count("*").alias("n_rows")).withColumn(
        "label", F.when((F.floor(F.col("ant_id") / 3) + F.col("video_id")) % 3 == 0, 1).otherwise(0))


@query("high_score_ids", TSC + "select video_id, ant_id from scores where excavating_score >= 0.52")
def high_score_ids(spark, sf_dir):
    return fl.high_score_ids(scores(spark, sf_dir), 0.52)


@query("rows_of_high_scores", TSC + """
select seq, video_id, ant_id from tracks semi join (select * from scores where excavating_score >= 0.52)
using (video_id, ant_id)""")
def rows_of_high_scores(spark, sf_dir):
    ids = fl.high_score_ids(scores(spark, sf_dir), 0.52)
    return fl.with_ids(fx.tracks(spark, sf_dir), ids).select("seq", "video_id", "ant_id")


@query("site_labels", T + """
select coalesce(case site_id when 1 then 'beer' when 2 then 'shack' when 3 then 'rain' when 4 then 'rocks' end, 'unknown')
       as site_name, count(*) as n from tracks group by all""")
def site_labels(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    return t.groupBy(fl.site_label(F.col("site_id")).alias("site_name")).agg(F.count("*").alias("n"))


@query("patch_addresses", T + """
select seq, (floor(center_x / 640) + floor(center_y / 540) * 3)::int as patch, center_x % 640 as local_x, center_y % 540 as local_y
from tracks""")
def patch_addresses(spark, sf_dir):
    t = k.centred(fx.tracks(spark, sf_dir))
    return t.select("seq", g.patch_address("center_x", "center_y", 640, 540, 3).alias("p")).select("seq", "p.*")


@query("cyclic_time_features", T + """
select seq, round(sin(2 * pi() * hour / 24) + 1e-9, 6) + 0.0 as hour_sin, round(cos(2 * pi() * hour / 24) + 1e-9, 6) + 0.0 as hour_cos,
       round(ln(1 + angle) + 1e-9, 6) + 0.0 as log_angle from tracks""")
def cyclic_time_features(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    return rounded(t.select("seq", *names.cyclic_hour(F.col("hour")), F.ln(1 + F.col("angle")).alias("log_angle")))


@query("clean_behaviour_labels", T + """
select seq, case when seq % 3 = 0 then 1 when seq % 3 = 1 then 0 end as label from tracks where seq % 5 <> 0""")
def clean_behaviour_labels(spark, sf_dir):
    n = F.col("seq") % 3
    raw = F.when(F.col("seq") % 5 == 0, None).when(n == 0, " Yes ").when(n == 1, "NO").otherwise("maybe")
    t = fx.tracks(spark, sf_dir).select("seq", raw.alias("excavating")).filter(F.col("excavating").isNotNull())
    return t.select("seq", names.yes_no_label(F.col("excavating")).alias("label"))


@query("relabelled_clusters", T + """
select video_id, ant_id, case (ant_id + video_id) % 4 when 3 then 0 when 2 then 1 else (ant_id + video_id) % 4 end as cluster_label
from tracks group by all""")
def relabelled_clusters(spark, sf_dir):
    t = fx.tracks(spark, sf_dir).select("video_id", "ant_id").distinct()
    return t.select("video_id", "ant_id", names.relabel(
        (F.col("ant_id") + F.col("video_id")) % 4, {3: 0, 2: 1}).alias("cluster_label"))


@query("parsed_names", T + """
select seq, hour as clip_hour, ts as clip_ts, frame_number, 'img_' || frame_number as base_image from (
  select seq, hour, frame_number, date_trunc('second', ts)::timestamp as ts from tracks)""")
def parsed_names(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    clip = F.concat(F.lit("/data/"), F.date_format("ts", "yyyy-MM-dd_HH_mm_ss"), F.lit("/clip.mp4"))
    image = F.concat(F.lit("a/b/img_"), F.col("frame_number").cast("string"), F.lit(".jpg"))
    patch = F.concat(F.lit("img_"), F.col("frame_number").cast("string"), F.lit("_7.jpg"))
    return t.select("seq", names.clip_hour(clip).alias("clip_hour"), names.clip_time(clip).alias("clip_ts"),
                    names.frame_of_image(image).alias("frame_number"), names.base_image(patch).alias("base_image"))


@query("angles_between_vectors", T + f"""
select seq, round(case when (center_x = 960 and center_y = 540) or angle = 0 then -1.0::double else
  degrees(acos(least(1.0::double, greatest(-1.0::double, ((center_x - 960) * angle + (center_y - 540) * 20) /
    (sqrt((center_x - 960) ** 2 + (center_y - 540) ** 2) * sqrt(angle * angle + 400)))))) end, 5) + 0.0 as between
from tracks where angle <> 0""")
def angles_between_vectors(spark, sf_dir):
    t = k.centred(fx.tracks(spark, sf_dir)).filter(F.col("angle") != 0)
    a = g.angle_between(F.col("center_x") - 960, F.col("center_y") - 540, "angle", F.lit(20.0))
    return t.select("seq", (F.round(a, 5) + F.lit(0.0)).alias("between"))


@query("grid_cells", T + """
select seq, case when ceil(center_x / 20) - 1 between 0 and 95 then (ceil(center_x / 20) - 1)::int end as x_bin,
       case when ceil(center_y / 20) - 1 between 0 and 53 then (ceil(center_y / 20) - 1)::int end as y_bin from tracks""")
def grid_cells(spark, sf_dir):
    from trackframe.operators.grids import binned
    return binned(k.centred(fx.tracks(spark, sf_dir))).select("seq", "x_bin", "y_bin")


@query("entrance_distances", T + """
select seq, round(sqrt((center_x - 960) ** 2 + (center_y - 400) ** 2) + 1e-9, 6) + 0.0 as dist from tracks""")
def entrance_distances(spark, sf_dir):
    t = k.centred(fx.tracks(spark, sf_dir))
    return rounded(t.select("seq", g.distance("center_x", "center_y", F.lit(960), F.lit(400)).alias("dist")))


# ---- matching ----------------------------------------------------------------------------

SEQ = """
boxes as (select *, row_number() over (partition by video_id, frame_number, is_gt
                                       order by confidence desc, px, py) as seq from det),
gt as (select * from boxes where is_gt), pred as (select * from boxes where not is_gt and confidence >= {thr}),
pairs as (
  select video_id, frame_number, g.seq as g, p.seq as p, p.confidence,
         greatest(0, 20 - abs(g.px - p.px)) * greatest(0, 20 - abs(g.py - p.py)) as shared
  from gt g join pred p using (video_id, frame_number)),
edges as (select video_id, frame_number, g, p, confidence from pairs where shared / (800.0::double - shared) > 0.5)
"""
WALK = """
numbered as (select *, row_number() over (partition by video_id, frame_number{k} order by g, p) as rn from {src}),
walk as (
  select distinct video_id, frame_number{k}, 0::bigint as rn, []::bigint[] as gs, []::bigint[] as ps from numbered
  union all
  select w.video_id, w.frame_number{wk}, e.rn,
         case when list_contains(w.gs, e.g) or list_contains(w.ps, e.p) then w.gs else list_append(w.gs, e.g) end,
         case when list_contains(w.gs, e.g) or list_contains(w.ps, e.p) then w.ps else list_append(w.ps, e.p) end
  from walk w join numbered e on e.video_id = w.video_id and e.frame_number = w.frame_number {on} and e.rn = w.rn + 1),
ends as (select video_id, frame_number{k}, max_by(gs, rn) as gs, max_by(ps, rn) as ps from walk group by all)
"""
W1 = WALK.format(k="", wk="", on="", src="edges")
MATCH = fx.with_ctes(fx.DETECTIONS, SEQ.format(thr=0.327), W1)


def boxes(spark, sf_dir, thr):
    d = m.sequenced(fx.boxed(fx.detections(spark, sf_dir)))
    return d.filter("is_gt"), d.filter(~F.col("is_gt") & (F.col("confidence") >= thr))


@query("overlap_pairs", fx.with_ctes(fx.DETECTIONS, SEQ.format(thr=0.327)) + """
select video_id, frame_number, g, p from edges""")
def overlap_pairs(spark, sf_dir):
    return m.overlap_pairs(*boxes(spark, sf_dir, 0.327)).drop("confidence")


@query("greedy_matches", MATCH + """
select video_id, frame_number, unnest(gs) as g, unnest(ps) as p from ends""")
def greedy_matches(spark, sf_dir):
    return m.greedy_matches(m.overlap_pairs(*boxes(spark, sf_dir, 0.327)))


COUNTS = MATCH + """
, tp as (select video_id, sum(len(gs)) as tp from ends group by all),
ng as (select video_id, count(*) as ng from gt group by all), np as (select video_id, count(*) as np from pred group by all),
counts as (select video_id, coalesce(tp, 0)::bigint as tp, (coalesce(np, 0) - coalesce(tp, 0))::bigint as fp,
                  (coalesce(ng, 0) - coalesce(tp, 0))::bigint as fn
           from (select distinct video_id from det) left join tp using (video_id)
           left join ng using (video_id) left join np using (video_id))
"""


def quality_sql(tp="tp", fp="fp", fn="fn"):
    return f"""round(case when {tp} + {fp} > 0 then {tp} / ({tp} + {fp}) end + 1e-9, 6) + 0.0 as "precision",
       round(case when {tp} + {fn} > 0 then {tp} / ({tp} + {fn}) end + 1e-9, 6) + 0.0 as recall,
       round(case when 2 * {tp} + {fp} + {fn} > 0 then 2 * {tp} / (2 * {tp} + {fp} + {fn}) end + 1e-9, 6) + 0.0 as f1"""


@query("detection_quality", COUNTS + f"select video_id, tp, fp, fn, {quality_sql()} from counts")
def detection_quality(spark, sf_dir):
    gt, pred = boxes(spark, sf_dir, 0.327)
    found = m.greedy_matches(m.overlap_pairs(gt, pred))
    return rounded(m.quality(m.detection_counts(gt, pred, found)))


@query("pooled_detection_quality", COUNTS + f"""
, s as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from counts)
select tp, fp, fn, {quality_sql()} from s""")
def pooled_detection_quality(spark, sf_dir):
    gt, pred = boxes(spark, sf_dir, 0.327)
    found = m.greedy_matches(m.overlap_pairs(gt, pred))
    return rounded(m.pooled_quality(m.detection_counts(gt, pred, found)))


@query("precision_recall_curve", fx.with_ctes(fx.DETECTIONS, SEQ.format(thr=0), """
thr as (select i::int as step, case when i = 49 then 0 else top + i * ((0.0::double - top) / 49) end as threshold
        from (select max(confidence) as top from pred), range(50) t(i))""", """
many as (select video_id, frame_number, step, g, p from edges join thr on confidence >= threshold)""",
    WALK.format(k=", step", wk=", w.step", on="and e.step = w.step", src="many")) + f"""
, tp as (select step, sum(len(gs)) as tp from ends group by all),
np as (select step, count(*) as np from pred join thr on confidence >= threshold group by all),
c as (select step, threshold, coalesce(tp, 0)::bigint as tp, (coalesce(np, 0) - coalesce(tp, 0))::bigint as fp,
             ((select count(*) from gt) - coalesce(tp, 0))::bigint as fn
      from thr left join tp using (step) left join np using (step))
select step, round(threshold + 1e-9, 6) + 0.0 as threshold, tp, fp, fn, {quality_sql()} from c""")
def precision_recall_curve(spark, sf_dir):
    pairs = m.overlap_pairs(*boxes(spark, sf_dir, 0.0))
    d = fx.detections(spark, sf_dir)  # counts and thresholds need no order
    gt, pred = d.filter("is_gt"), d.filter(~F.col("is_gt") & (F.col("confidence") >= 0.0))
    curve = m.precision_recall_curve(gt, pred, pairs, m.even_thresholds(pred))
    return rounded(curve)


# ---- trajectories ------------------------------------------------------------------------

STEPS = """
prevs as (
  select *, center_x - lag(center_x) over w as dx, center_y - lag(center_y) over w as dy,
         frame_number - lag(frame_number) over w as df, abs(angle - lag(angle) over w) as turn,
         count(*) over (partition by video_id, ant_id) as n, row_number() over w as pos
  from tracks window w as (partition by video_id, ant_id order by frame_number, seq)),
steps as (select *, sqrt(dx * dx + dy * dy) as step, atan2(dy, dx) as heading,
                 sqrt(dx * dx + dy * dy) / (df + 1e-6::double) * 20 as speed from prevs)
"""
FEATURES = """
ends as (select video_id, ant_id, n, min_by(center_x, pos) as sx, min_by(center_y, pos) as sy,
                max_by(center_x, pos) as ex, max_by(center_y, pos) as ey, sum(step) as total_length,
                avg(least(turn, 360 - turn)) as avg_angle_change from steps group by all),
features as (select video_id, ant_id, n as trajectory_length,
       sqrt((ex - sx) ** 2 + (ey - sy) ** 2) / (total_length + 1e-6::double) as efficiency,
       sqrt((ex - sx) ** 2 + (ey - sy) ** 2) as straight_distance, avg_angle_change, total_length
from ends where n >= 20)
"""
TF = fx.with_ctes(fx.TRACKS, STEPS, FEATURES)


@query("behaviour_features", TF + f"""
select video_id, ant_id, trajectory_length, {r('efficiency', 'straight_distance', 'avg_angle_change', 'total_length')}
from features""")
def behaviour_features(spark, sf_dir):
    return rounded(tj.behaviour_features(fx.tracks(spark, sf_dir)))


EXT = ("avg_curvature", "max_curvature", "avg_speed", "speed_std", "max_speed", "direction_consistency", "bbox_area",
       "pause_ratio", "avg_acceleration", "acceleration_std", "spatial_std_x", "spatial_std_y", "efficiency",
       "start_x_norm", "start_y_norm", "end_x_norm", "end_y_norm", "direction_entropy", "total_length", "is_loop")


@query("extended_features", fx.with_ctes(fx.TRACKS, STEPS) + f"""
, two as (select *, abs(heading - lag(heading) over w) as dh, speed - lag(speed) over w as gain,
            (dx * lag(dx) over w + dy * lag(dy) over w) / ((step + 1e-6::double) * (lag(step) over w + 1e-6::double)) as along,
            floor((heading + pi()) / (pi() / 4)) as sector
          from steps window w as (partition by video_id, ant_id order by pos)),
ent as (select video_id, ant_id, -sum(c / (n - 1) * ln(c / (n - 1))) as direction_entropy
        from (select video_id, ant_id, n, sector, count(*) as c from two where sector is not null group by all) group by all),
f as (
select video_id, ant_id, n as duration, sum(step) as total_length, avg(least(dh, 2 * pi() - dh)) as avg_curvature,
       max(least(dh, 2 * pi() - dh)) as max_curvature, avg(speed) as avg_speed, stddev_pop(speed) as speed_std,
       max(speed) as max_speed, avg(along) as direction_consistency,
       (max(center_x) - min(center_x)) * (max(center_y) - min(center_y)) as bbox_area,
       count(*) filter (dh > pi() / 4) as direction_changes,
       avg((speed < 1)::int) filter (speed is not null) as pause_ratio, avg(abs(gain)) as avg_acceleration,
       stddev_pop(gain) as acceleration_std, stddev_pop(center_x) as spatial_std_x, stddev_pop(center_y) as spatial_std_y,
       min_by(center_x, pos) as sx, min_by(center_y, pos) as sy, max_by(center_x, pos) as ex, max_by(center_y, pos) as ey
from two where n >= 5 group by all),
h as (select *, sqrt((ex - sx) ** 2 + (ey - sy) ** 2) / (total_length + 1e-6::double) as efficiency,
        (sqrt((ex - sx) ** 2 + (ey - sy) ** 2) < 50)::int::double as is_loop, sx / 1920 as start_x_norm, sy / 1080 as start_y_norm,
        ex / 1920 as end_x_norm, ey / 1080 as end_y_norm from f join ent using (video_id, ant_id))
select video_id, ant_id, duration, direction_changes, {", ".join(f"round({c}, 4) + 0.0 as {c}" for c in EXT)} from h""")
def extended_features(spark, sf_dir):
    f = tj.extended_features(fx.tracks(spark, sf_dir))
    return f.select("video_id", "ant_id", "duration", "direction_changes",
                    *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in EXT])


SCALES = ", ".join(f"{s!r}::double" for s in tj.box_scales())


@query("fractal_dimensions", T + f"""
, fr as (select video_id, ant_id, min(center_x) as x0, max(center_x) as x9, min(center_y) as y0, max(center_y) as y9,
                count(*) as n from tracks group by all),
p as (select distinct video_id, ant_id, n, (center_x - x0) / (x9 - x0 + 1e-6::double) as nx,
             (center_y - y0) / (y9 - y0 + 1e-6::double) as ny from tracks join fr using (video_id, ant_id)),
b as (select distinct video_id, ant_id, n, s, floor(nx / (1.0::double / s)) as bx, floor(ny / (1.0::double / s)) as byy
      from p, (select unnest([{SCALES}]) as s)),
c as (select video_id, ant_id, n, s, count(*) as k from b group by all)
select video_id, ant_id, round(case when n < 10 then 1.0::double else
   least(2.0::double, greatest(1.0::double, -regr_slope(ln(k), ln(1.0::double / s)))) end, 5) + 0.0 as fractal_dimension
from c group by video_id, ant_id, n""")
def fractal_dimensions(spark, sf_dir):
    f = tj.fractal_dimensions(fx.tracks(spark, sf_dir))
    return f.select("video_id", "ant_id", (F.round("fractal_dimension", 5) + F.lit(0.0)).alias("fractal_dimension"))


@query("return_frequencies", T + """
, p as (select *, row_number() over (partition by video_id, ant_id order by frame_number, seq) as pos,
               count(*) over (partition by video_id, ant_id) as n from tracks),
back as (select distinct a.seq from p a join p b on a.video_id = b.video_id and a.ant_id = b.ant_id and b.pos < a.pos
         where a.pos > 10 and sqrt((a.center_x - b.center_x) ** 2 + (a.center_y - b.center_y) ** 2) < 200)
select video_id, ant_id, round(case when n > 10 then count(back.seq) / (n - 10) else 0 end + 1e-9, 6) + 0.0 as return_frequency
from p left join back using (seq) group by video_id, ant_id, n""")
def return_frequencies(spark, sf_dir):
    return rounded(tj.return_frequencies(fx.tracks(spark, sf_dir), radius=200.0))


@query("smoothed_moving_average", T + f"""
select seq, round(case when lag(seq) over w is not null and lead(seq) over w is not null
    then (lag(center_x) over w + center_x + lead(center_x) over w) / 3 else center_x end + 1e-9, 6) + 0.0 as center_x,
  round(case when lag(seq) over w is not null and lead(seq) over w is not null
    then (lag(center_y) over w + center_y + lead(center_y) over w) / 3 else center_y end + 1e-9, 6) + 0.0 as center_y
from tracks window w as (partition by video_id, ant_id order by frame_number, seq)""")
def smoothed_moving_average(spark, sf_dir):
    return rounded(tj.smoothed(fx.tracks(spark, sf_dir), "moving_average").select("seq", "center_x", "center_y"))


WEIGHTS = ", ".join(f"{w!r}::double" for w in tj.gaussian_weights())


@query("smoothed_gaussian", T + f"""
, p as (select *, row_number() over (partition by video_id, ant_id order by frame_number, seq) - 1 as pos,
               count(*) over (partition by video_id, ant_id) as n from tracks),
taps as (select seq, video_id, ant_id, [{WEIGHTS}][k + 5] as w, n,
                ((pos + k) % (2 * n) + 2 * n) % (2 * n) as m from p, range(-4, 5) t(k)),
src as (select seq, video_id, ant_id, w, case when m < n then m else 2 * n - 1 - m end as pos from taps where n >= 3)
select seq, round(sum(w * p.center_x) + 1e-9, 6) + 0.0 as center_x, round(sum(w * p.center_y) + 1e-9, 6) + 0.0 as center_y
from src join p using (video_id, ant_id, pos) group by src.seq
union all select seq, center_x, center_y from p where n < 3""".replace("select seq, round(sum", "select src.seq, round(sum"))
def smoothed_gaussian(spark, sf_dir):
    return rounded(tj.smoothed(fx.tracks(spark, sf_dir), "gaussian").select("seq", "center_x", "center_y"))


@query("smoothed_savgol", T + "select seq, center_x, center_y from tracks")
def smoothed_savgol(spark, sf_dir):
    return tj.smoothed(fx.tracks(spark, sf_dir)).select("seq", "center_x", "center_y")


@query("tracks_without_outliers", fx.with_ctes(fx.TRACKS, STEPS) + """
, s as (select video_id, ant_id, avg(step) as m, stddev_pop(step) as sd from steps group by all)
select seq, video_id, ant_id from steps join s using (video_id, ant_id)
where n < 5 or step is null or abs((step - m) / (sd + 1e-6::double)) <= 2""")
def tracks_without_outliers(spark, sf_dir):
    return tj.without_outliers(fx.tracks(spark, sf_dir), threshold=2.0).select("seq", "video_id", "ant_id")


@query("id_swap_repairs", T + """
, lng as (select * from tracks qualify count(*) over (partition by video_id, ant_id) >= 20),
c as (select a.seq, b.ant_id as prev_ant, sqrt((a.center_x - b.center_x) ** 2 + (a.center_y - b.center_y) ** 2) as d
      from lng a join lng b on a.video_id = b.video_id and b.frame_number = a.frame_number - 1),
best as (select seq, prev_ant from c where d < 100 qualify row_number() over (partition by seq order by d, prev_ant) = 1)
select seq, ant_id, coalesce(prev_ant, ant_id) as repaired_id from lng left join best using (seq)""")
def id_swap_repairs(spark, sf_dir):
    return tj.swap_repaired(fx.tracks(spark, sf_dir)).select("seq", "ant_id", "repaired_id")


@query("interpolated_tracks", T + """
, w as (select *, lag(frame_number) over w as f0, lag(x1) over w as a1, lag(y1) over w as b1, lag(x2) over w as a2,
               lag(y2) over w as b2 from tracks window w as (partition by video_id, ant_id order by frame_number, seq)),
made as (select video_id, ant_id, f::int as frame_number, x1, y1, x2, y2, a1, b1, a2, b2, (f - f0) / (frame_number - f0) as part
         from (select *, unnest(range(f0 + 1, frame_number)) as f from w where frame_number - f0 > 1))
select video_id, ant_id, frame_number, round(a1 + (x1 - a1) * part + 1e-9, 6) + 0.0 as x1, round(b1 + (y1 - b1) * part + 1e-9, 6) + 0.0 as y1,
       round(a2 + (x2 - a2) * part + 1e-9, 6) + 0.0 as x2, round(b2 + (y2 - b2) * part + 1e-9, 6) + 0.0 as y2, null::varchar as direction,
       true as filled from made
union all select video_id, ant_id, frame_number, x1::double, y1::double, x2::double, y2::double, direction, false from tracks""")
def interpolated_tracks(spark, sf_dir):
    return rounded(tj.interpolated(fx.tracks(spark, sf_dir)))


@query("frame_triplets", T + """
, f as (select distinct video_id, frame_number from tracks),
w as (select video_id, frame_number, lag(frame_number) over w as before, lead(frame_number) over w as after
      from f window w as (partition by video_id order by frame_number))
select * from w where before is not null and after is not null""")
def frame_triplets(spark, sf_dir):
    return tj.frame_triplets(fx.tracks(spark, sf_dir))


PROXIMITY = """
prox as (select video_id, ant_id, trajectory_length, sqrt(dx * dx + dy * dy) as nest_proximity from (
  select video_id, ant_id, count(*) as trajectory_length,
         greatest(860 - min_by(center_x, (frame_number, seq)), min_by(center_x, (frame_number, seq)) - 1060, 0) as dx,
         greatest(440 - min_by(center_y, (frame_number, seq)), min_by(center_y, (frame_number, seq)) - 640, 0) as dy
  from tracks group by all))
"""


@query("nest_proximities", fx.with_ctes(fx.TRACKS, PROXIMITY) + f"""
select video_id, ant_id, trajectory_length, {r('nest_proximity')} from prox""")
def nest_proximities(spark, sf_dir):
    p = tj.nest_proximity(fx.tracks(spark, sf_dir), fx.ignored_pixels(spark))
    return rounded(p.select("video_id", "ant_id", "trajectory_length", "nest_proximity"))


@query("near_nest_summary", fx.with_ctes(fx.TRACKS, PROXIMITY) + f"""
select video_id, count(*) as n_all, round(min(nest_proximity) + 1e-9, 6) + 0.0 as lowest,
       round(max(nest_proximity) + 1e-9, 6) + 0.0 as highest, count(*) filter (nest_proximity < 200) as n_near,
       round(min(nest_proximity) filter (nest_proximity < 200) + 1e-9, 6) + 0.0 as near_lowest,
       round(max(nest_proximity) filter (nest_proximity < 200) + 1e-9, 6) + 0.0 as near_highest,
       round(avg(nest_proximity) filter (nest_proximity < 200) + 1e-9, 6) + 0.0 as near_mean from prox group by all""")
def near_nest_summary(spark, sf_dir):
    p = tj.nest_proximity(fx.tracks(spark, sf_dir), fx.ignored_pixels(spark))
    return rounded(fl.near_nest_summary(p, 200.0))


@query("baseline_deviations", T + """
, b as (select site_id, floor(center_x / 480) as gx, floor(center_y / 270) as gy, floor(avg(angle::int + 60)) as mean
      from tracks group by all)
select t.seq, ((3 * abs(angle::int + 60 - mean)) % 256)::int as deviation
from tracks t join b on b.site_id = t.site_id and b.gx = floor(t.center_x / 480) and b.gy = floor(t.center_y / 270)""")
def baseline_deviations(spark, sf_dir):
    t = k.centred(fx.tracks(spark, sf_dir))
    s = t.select("seq", F.col("site_id").alias("video_id"), F.floor(F.col("center_x") / 480).alias("x"),
                 F.floor(F.col("center_y") / 270).alias("y"), (F.col("angle").cast("int") + 60).alias("value"))
    return tj.baseline_deviation(s).select("seq", "deviation")
