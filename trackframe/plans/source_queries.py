"""Readers, writers and the catalog: tables derived from the given ones are written to the
shared scratch folder, read back and compared."""

import uuid

from pyspark.sql import functions as F

from trackframe.operators import activity as a, filters as fl, kinematics as k
from trackframe.operators.kinematics import speeds
from trackframe.plans import fixtures as fx
from trackframe.plans.activity_queries import RATES, r
from trackframe.plans.registry import query, rounded
from trackframe.session import checkpoint_dir
from trackframe.sources import catalog as cat, clips, files, sinks

T = fx.with_ctes(fx.TRACKS)
TS = fx.with_ctes(fx.TRACKS, fx.SPEEDS)


def scratch(spark):
    return f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


@query("tracks_from_csv", T + """
select video_id::varchar as video_id, frame_number, ant_id, x1, y1, x2, y2, direction, angle from tracks""")
def tracks_from_csv(spark, sf_dir):
    out = scratch(spark)
    t = fx.tracks(spark, sf_dir)
    (t.select("video_id", "frame_number", F.col("ant_id").cast("double").alias("ant_id"), "x1", "y1", "x2", "y2",
              "direction", "angle").write.partitionBy("video_id").option("header", True).csv(out))
    return files.read_tracks(spark, out, r"video_id=([^/]+)")


@query("detections_from_csv", fx.with_ctes(fx.DETECTIONS) + """
select video_id::varchar as video_id, 'herdnet' as detector, frame_number, (px - 10)::double as x1, (py - 10)::double as y1,
       (px + 10)::double as x2, (py + 10)::double as y2, round(confidence + 1e-9, 6) + 0.0 as confidence from det""")
def detections_from_csv(spark, sf_dir):
    out = scratch(spark)
    d = fx.boxed(fx.detections(spark, sf_dir))
    (d.select(F.concat(F.col("video_id").cast("string"), F.lit("_herdnet_detections")).alias("clip"), "frame_number",
              *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], "confidence")
     .write.partitionBy("clip").option("header", True).csv(out))
    return rounded(files.read_detections(spark, out, r"clip=([0-9]+)_"))


@query("stored_speed_table", TS + """
select site_id, day, video_id, count(*) as n, round(sum(velocity), 4) + 0.0 as total from speeds group by all""")
def stored_speed_table(spark, sf_dir):
    out = scratch(spark)
    tracks = fx.tracks(spark, sf_dir)
    sinks.speed_table(spark, tracks, out)
    s = sinks.speed_table(spark, tracks, out).groupBy("site_id", "day", "video_id").agg(
        F.count("*").alias("n"), F.sum("velocity").alias("total"))
    return s.withColumn("total", F.round("total", 4) + F.lit(0.0))


@query("extended_speed_table", TS + """
select site_id, day, video_id, count(*) as n, round(sum(velocity), 4) + 0.0 as total, (video_id % 2)::bigint as batch
from speeds group by all""")
def extended_speed_table(spark, sf_dir):
    """Half of the clips are stored first, the others when all are asked for."""
    out = scratch(spark)
    tracks = fx.tracks(spark, sf_dir)
    clips.store_clips(tracks.filter("video_id % 2 = 0"), out, speeds)
    s = clips.stored_clips(tracks, out, speeds).groupBy("site_id", "day", "video_id").agg(
        F.count("*").alias("n"), F.round(F.sum("velocity"), 4).alias("total"))
    stored = clips.manifest(spark, out).select("site_id", "day", "video_id", "batch")
    return s.join(stored, ["site_id", "day", "video_id"]).withColumn("total", F.col("total") + F.lit(0.0))


REGISTRY = """
reg as (select site_id, '/clips/' || strftime(day, '%Y-%m-%d') || '_' || lpad(hour::varchar, 2, '0') || '_00_00/clip.mp4' as video_id,
               day::timestamp + to_hours(hour) as time_stamp, temperature, humidity, lux from clips)
"""


def clip_files(spark, sf_dir):
    """Clip paths with their readings, as the folders of a recorder would have them."""
    c = fx.clips(fx.tracks(spark, sf_dir))
    name = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("_"), F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit("_00_00"))
    return c.select("site_id", F.concat(F.lit("/clips/"), name, F.lit("/clip.mp4")).alias("path"), name.alias("clip"),
                    "temperature", "humidity", "lux")


@query("clip_registry", fx.with_ctes(fx.TRACKS, fx.CLIPS, REGISTRY) + """
select video_id, site_id, time_stamp, temperature::float as temperature, humidity::float as humidity, lux::float as LUX
from reg where humidity >= 40""")
def clip_registry(spark, sf_dir):
    def of_site(site):
        c = clip_files(spark, sf_dir).filter(F.col("site_id") == site)
        metadata = c.filter(F.col("humidity") >= 40).select("clip", "temperature", "humidity", "lux")
        return files.clip_registry(c.select("path"), metadata, site)

    first, *rest = [of_site(n) for n in fl.SITE_NAMES]
    for other in rest:
        first = first.unionByName(other)
    return first


@query("clip_metadata_from_json", fx.with_ctes(fx.TRACKS, fx.CLIPS) + """
select site_id, strftime(day, '%Y-%m-%d') || '_' || lpad(hour::varchar, 2, '0') || '_00_00' as clip, temperature, humidity, lux
from clips""")
def clip_metadata_from_json(spark, sf_dir):
    out = scratch(spark)
    (clip_files(spark, sf_dir).select("site_id", "clip", F.to_json(F.struct(
        "temperature", "humidity", F.struct("lux").alias("light"))).alias("value"))
     .repartition(8, "clip").write.partitionBy("site_id", "clip").text(out))
    # one folder per site, as recorders leave them; site 4 has no rows in the given tables
    first, *rest = [files.read_clip_metadata(spark, f"{out}/site_id={n}").withColumn("site_id", F.lit(n)) for n in (1, 2, 3)]
    for other in rest:
        first = first.unionByName(other)
    return first


@query("catalog_of_videos", fx.with_ctes(fx.TRACKS, fx.CLIPS, REGISTRY) + """
, v as (select video_id, min(site_id) as site_id from reg group by all having min(site_id) <= 2)
select site_name, count(*) as n_videos, count(*) filter (video_id like '%_00_00/%') as n_named from v
join (values (1, 'beer'), (2, 'shack')) s(site_id, site_name) using (site_id) group by all""")
def catalog_of_videos(spark, sf_dir):
    base = scratch(spark)
    cat.create_tables(spark, base)
    sites = spark.createDataFrame([(n, s, "") for n, s in fl.SITE_NAMES.items() if n <= 2], "site_id int, site_name string, location string")
    cat.insert(spark, base, "sites", sites)
    v = clip_files(spark, sf_dir).groupBy(F.col("path").alias("video_id")).agg(F.min("site_id").alias("site_id"))
    cat.insert(spark, base, "videos", v)
    cat.insert(spark, base, "videos", v)  # a second insert of the same keys adds nothing
    cat.insert(spark, base, "counts", cat.table(spark, base, "videos").select("video_id"))
    joined = cat.counts_with_videos(cat.table(spark, base, "counts"), cat.table(spark, base, "videos"))
    return joined.join(cat.table(spark, base, "sites"), "site_id").groupBy("site_name").agg(
        F.count("*").alias("n_videos"), F.count_if(F.col("video_id").like("%_00_00/%")).alias("n_named"))


@query("clips_with_tracks", fx.with_ctes(fx.TRACKS, fx.CLIPS) + """
select site_id, day, hour, count(*) as n_rows, any_value(temperature) as temperature
from tracks join clips using (site_id, day, hour) group by all""")
def clips_with_tracks(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    return t.join(fx.clips(t), list(a.SLOT)).groupBy(*a.SLOT).agg(
        F.count("*").alias("n_rows"), F.first("temperature").alias("temperature"))


@query("artifact_paths", fx.with_ctes(fx.TRACKS, fx.CLIPS, REGISTRY) + """
, p as (select distinct video_id, replace(video_id, '.mp4', '') as stem from reg),
h as (select video_id, min(hour(time_stamp)) as h from reg group by all)
select video_id, case when h % 3 = 0 and h % 2 = 0 then stem || '_d.csv' end as herdnet_detection_only_csv,
       case when h % 3 = 0 and h % 2 = 0 then stem || '_t.csv' end as herdnet_tracking_with_direction_closest_boundary_method_csv
from p join h using (video_id)""")
def artifact_paths(spark, sf_dir):
    from trackframe.functions.names import clip_hour
    v = clip_files(spark, sf_dir).select(F.col("path").alias("video_id")).distinct()
    stem, h = F.regexp_replace("video_id", r"\.mp4$", ""), clip_hour(F.col("video_id"))
    listing = (v.filter(h % 3 == 0).select(F.concat(stem, F.lit("_d.csv")).alias("path"))
               .unionByName(v.filter(h % 2 == 0).select(F.concat(stem, F.lit("_t.csv")).alias("path"))))
    out = cat.with_artifacts(cat.with_all_columns(v, "counts"), listing, "_d.csv", "_t.csv")
    return out.select("video_id", "herdnet_detection_only_csv", "herdnet_tracking_with_direction_closest_boundary_method_csv")


@query("point_annotations_from_xml", T + """
select 'f/' || frame_number || '.jpg' as image, center_x::int as x, center_y::int as y from tracks""")
def point_annotations_from_xml(spark, sf_dir):
    out = scratch(spark)
    t = k.centred(fx.tracks(spark, sf_dir))
    sinks.write_image_points(t.select(F.concat(F.col("frame_number").cast("string"), F.lit(".jpg")).alias("image"),
                                      F.col("center_x").alias("x"), F.col("center_y").alias("y")), out)
    return files.read_point_images(spark, out, "f/").drop("seq")


@query("seed_tracks_from_xml", T + """
select 0 as frame_number, ant_id::int as ant_id, center_x::int as x, center_y::int as y from tracks""")
def seed_tracks_from_xml(spark, sf_dir):
    out = scratch(spark)
    t = k.centred(fx.tracks(spark, sf_dir))
    sinks.write_seed_tracks(t.select("ant_id", F.col("center_x").alias("x"), F.col("center_y").alias("y")), out)
    return files.read_point_tracks(spark, out)


@query("label_lines", T + """
select 'img_' || (frame_number % 50) as image, count(*) as n, count(distinct seq) as n_boxes from tracks group by all""")
def label_lines(spark, sf_dir):
    out = scratch(spark)
    t = fx.tracks(spark, sf_dir)
    image = F.concat(F.lit("/f/img_"), (F.col("frame_number") % 50).cast("string"), F.lit(".jpg"))
    sinks.write_label_files(t.repartition(8, image).withColumn("image", image), out)
    back = spark.read.text(out)
    five = F.size(F.split("value", " ")) == 5
    return back.groupBy("image").agg(F.count("*").alias("n"), F.count_if(five & F.col("value").startswith("0 ")).alias("n_boxes"))


@query("centre_files", T + """
select case when site_id = 1 then 'train' else 'val' end as split, 'img_' || frame_number || '.jpg' as images, center_x as x, center_y as y,
       1 as labels from tracks""")
def centre_files(spark, sf_dir):
    out = scratch(spark)
    t = fx.tracks(spark, sf_dir).select(
        F.when(F.col("site_id") == 1, "train").otherwise("val").alias("split"), "x1", "y1", "x2", "y2",
        F.concat(F.lit("/f/img_"), F.col("frame_number").cast("string"), F.lit(".jpg")).alias("image"))
    sinks.write_centre_files(t, out)
    return spark.read.schema("images string, x double, y double, labels int, split string").option("header", True).csv(out)


MOT = ("frame", "id", "x", "y", "w", "h", "c1", "c2", "c3", "c4")
MOT_DDL = "frame int, id bigint, " + ", ".join(f"{c} int" for c in MOT[2:]) + ", video_id int"


@query("mot_ground_truth", T + """
select video_id, frame_number + 1 as frame, ant_id as id, x1 as x, y1 as y, 20 as w, 20 as h, -1 as c1, -1 as c2, -1 as c3, -1 as c4
from tracks""")
def mot_ground_truth(spark, sf_dir):
    out = scratch(spark)
    sinks.write_mot(sinks.mot_ground_truth(fx.tracks(spark, sf_dir)), out)
    return spark.read.schema(MOT_DDL).csv(out)


@query("mot_predictions", T + """
select video_id, frame_number - 299 as frame, ant_id as id, x1 as x, y1 as y, 20 as w, 20 as h, -1 as c1, -1 as c2, -1 as c3, -1 as c4
from tracks where frame_number >= 300 and frame_number < 330""")
def mot_predictions(spark, sf_dir):
    out = scratch(spark)
    sinks.write_mot(sinks.mot_predictions(fx.tracks(spark, sf_dir), 300), out)
    return spark.read.schema(MOT_DDL).csv(out)


TRAJ = """
tr as (select video_id, ant_id, min(day) as date, count(*) as trajectory_length, ((ant_id + video_id) % 4)::int as cluster_label
       from tracks group by video_id, ant_id)
"""


@query("stored_trajectories", fx.with_ctes(fx.TRACKS, TRAJ) + "select * from tr")
def stored_trajectories(spark, sf_dir):
    out = scratch(spark)
    sinks.write_trajectories(track_rows(spark, sf_dir), out)
    return spark.read.schema("video_id int, ant_id bigint, date date, trajectory_length bigint, cluster_label int").option(
        "header", True).csv(f"{out}/trajectories")


def track_rows(spark, sf_dir):
    return fx.tracks(spark, sf_dir).groupBy("video_id", "ant_id").agg(
        F.min("day").alias("date"), F.count("*").alias("trajectory_length")).withColumn(
        "cluster_label", ((F.col("ant_id") + F.col("video_id")) % 4).cast("int"))


@query("trajectory_summary", fx.with_ctes(fx.TRACKS, TRAJ) + """
select count(*) as total_trajectories, count(distinct ant_id) as unique_ants, count(distinct video_id) as unique_videos,
       min(date) || ' to ' || max(date) as date_range, round(avg(trajectory_length) + 1e-9, 6) + 0.0 as avg_trajectory_length,
       (select string_agg(cluster_label || ':' || n, ',' order by cluster_label) from
          (select cluster_label, count(*) as n from tr group by all)) as cluster_distribution from tr""")
def trajectory_summary(spark, sf_dir):
    s = sinks.trajectory_summary(track_rows(spark, sf_dir))
    text = F.concat_ws(",", F.transform("cluster_distribution", lambda c: F.concat_ws(
        ":", c["cluster_label"].cast("string"), c["n"].cast("string"))))
    return rounded(s.withColumn("cluster_distribution", text))


@query("stored_bout_series", fx.with_ctes(fx.TRACKS, RATES) + """
select site_id, day, hour, round(away + 1e-9, 6) + 0.0 as value, 'away' as metric, ((day(day) - 1) // 10)::int as bout_id from rates
where (day(day) - 1) // 10 = 1""")
def stored_bout_series(spark, sf_dir):
    out = scratch(spark)
    rates = a.direction_rates(fx.tracks(spark, sf_dir)).withColumn("bout_id", F.floor((F.dayofmonth("day") - 1) / 10).cast("int"))
    long = rates.select(*a.SLOT, "bout_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("away", "toward", "total")])).alias("m")).select(
        *a.SLOT, "bout_id", "m.*")
    sinks.write_series(long, out)
    return rounded(sinks.read_series(spark, out, "away", 1))


@query("bout_series_list", fx.with_ctes(fx.TRACKS, RATES) + """
select metric, ((day(day) - 1) // 10)::int as bout_id, count(*) as n from rates, (values ('away'), ('toward')) m(metric) group by all""")
def bout_series_list(spark, sf_dir):
    out = scratch(spark)
    rates = a.direction_rates(fx.tracks(spark, sf_dir)).withColumn("bout_id", F.floor((F.dayofmonth("day") - 1) / 10).cast("int"))
    long = rates.select(*a.SLOT, "bout_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("away", "toward")])).alias("m")).select(
        *a.SLOT, "bout_id", "m.*")
    sinks.write_series(long, out)
    return sinks.read_series(spark, out).groupBy("metric", "bout_id").agg(F.count("*").alias("n"))


@query("behaviour_labels_from_csv", T + """
select video_id::varchar as video_id, ant_id::int as ant_id, case when ant_id % 2 = 0 then 'yes' else 'no' end as excavating
from (select distinct video_id, ant_id from tracks) where ant_id % 5 <> 0""")
def behaviour_labels_from_csv(spark, sf_dir):
    out = scratch(spark)
    t = fx.tracks(spark, sf_dir).select("video_id", "ant_id").distinct()
    good = F.concat_ws(",", F.col("video_id").cast("string"), F.col("ant_id").cast("string"),
                       F.when(F.col("ant_id") % 2 == 0, "yes").otherwise("no"))
    line = F.when(F.col("ant_id") % 5 == 0, F.concat(good, F.lit(",extra,field"))).otherwise(good)
    t.select(line.alias("value")).write.text(out)
    labels = files.read_behaviour_labels(spark, out, header=False)
    return labels.filter(F.col("bad_line").isNull()).drop("bad_line")


@query("id_list_from_text", T + """
select distinct ant_id, round(ant_id / 2 + 1e-9, 6) + 0.0 as nest_proximity from tracks where ant_id % 4 <> 0""")
def id_list_from_text(spark, sf_dir):
    out = scratch(spark)
    t = fx.tracks(spark, sf_dir).select("ant_id").distinct()
    good = F.concat(F.col("ant_id").cast("string"), F.lit(".0,"), (F.col("ant_id") / 2).cast("string"))
    t.select(F.when(F.col("ant_id") % 4 == 0, "not a line, x").otherwise(good).alias("value")).write.text(out)
    return rounded(files.read_id_list(spark, out))


@query("stored_scores", T + """
select video_id, ant_id, round(avg(angle) / 180 + 1e-9, 6) + 0.0 as excavating_score from tracks group by all""")
def stored_scores(spark, sf_dir):
    from trackframe.plans.track_queries import scores
    out = scratch(spark)
    sinks.write_scores(scores(spark, sf_dir).select("video_id", "ant_id", "excavating_score"), out)
    return rounded(spark.read.schema("video_id int, ant_id bigint, excavating_score double").option("header", True).csv(out))


@query("clips_without_readings", fx.with_ctes(fx.TRACKS, fx.CLIPS) + """
select site_id, day, hour from clips where humidity < 40""")
def clips_without_readings(spark, sf_dir):
    c = fx.clips(fx.tracks(spark, sf_dir))
    return c.join(c.filter(F.col("humidity") >= 40), list(a.SLOT), "left_anti").select(*a.SLOT)


@query("key_differences", T + """
select 'only_away' as side, count(*) as n from (select distinct site_id, day, hour from tracks where direction = 'away'
  except select distinct site_id, day, hour from tracks where direction = 'toward')
union all select 'only_toward', count(*) from (select distinct site_id, day, hour from tracks where direction = 'toward'
  except select distinct site_id, day, hour from tracks where direction = 'away')""")
def key_differences(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    away, toward = [a.moving(t, d).select(*a.SLOT).distinct() for d in ("away", "toward")]
    only = [x.join(y, list(a.SLOT), "left_anti").agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "n")
            for n, x, y in (("only_away", away, toward), ("only_toward", toward, away))]
    return only[0].unionByName(only[1])


@query("joined_bouts", T + """
select site_id, (day(day) - 1) // 10 as bout, count(*) as n from tracks group by all""")
def joined_bouts(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    bout = F.floor((F.dayofmonth("day") - 1) / 10)
    parts = [t.filter(bout == i) for i in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("site_id", bout.alias("bout")).agg(F.count("*").alias("n"))
