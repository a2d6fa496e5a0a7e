"""Label distributions, samples, density clusters, models and scores."""

from pyspark.sql import functions as F

from trackframe.functions import names
from trackframe.operators import activity as a, clusters as cl, density as dn, grids as gr, kinematics as k, scoring as sc
from trackframe.operators import statistics as st, trajectories as tj
from trackframe.plans import fixtures as fx
from trackframe.plans.activity_queries import RATES, r
from trackframe.session import cut_lineage
from trackframe.plans.registry import ORACLES, query, r6, rounded
from trackframe.plans.space_queries import speeds
from trackframe.plans.track_queries import FEATURES, PROXIMITY, SCORES, STEPS, scores

# ---- labels over time --------------------------------------------------------------------

TRAJ = """
traj as (select site_id, video_id, ant_id, (ant_id + video_id) % 4 as cluster_label, hour, day(day)::int as day,
                count(*) as trajectory_length, avg(angle) as avg_angle, sum(abs(center_x - 960)) as reach
         from tracks group by site_id, video_id, ant_id, hour, day),
combined as (select *, case cluster_label when 3 then 0 when 2 then 1 else cluster_label end as label from traj),
shares as (select site_id, day, hour, label as cluster_label, count(*) as n,
                  count(*) / sum(count(*)) over (partition by site_id, day, hour) as fraction
           from combined group by site_id, day, hour, label)
"""
TJ = fx.with_ctes(fx.TRACKS, TRAJ)


def trajectories(spark, sf_dir):
    t = k.centred(fx.tracks(spark, sf_dir))
    return t.groupBy("site_id", "video_id", "ant_id", "hour", F.dayofmonth("day").alias("day")).agg(
        F.count("*").alias("trajectory_length"), F.avg("angle").alias("avg_angle"),
        F.sum(F.abs(F.col("center_x") - 960)).alias("reach")).withColumn(
        "cluster_label", (F.col("ant_id") + F.col("video_id")) % 4)


def combined(spark, sf_dir):
    return trajectories(spark, sf_dir).withColumn("cluster_label", names.relabel(F.col("cluster_label"), cl.COMBINED))


def shares(spark, sf_dir):
    return cl.cluster_shares(combined(spark, sf_dir), ("site_id", "day", "hour"))


FEAT = ("trajectory_length", "avg_angle", "reach")


@query("cluster_shares", TJ + """
select site_id, day, hour, (hour + day * 24)::int as hour_day, cluster_label, n, round(fraction + 1e-9, 6) + 0.0 as fraction from shares""")
def cluster_shares(spark, sf_dir):
    return rounded(shares(spark, sf_dir).withColumn("hour_day", F.col("hour") + F.col("day") * 24))


@query("hourly_cluster_shares", TJ + """
select hour, cluster_label, round(avg(fraction) + 1e-9, 6) + 0.0 as fraction from shares group by all""")
def hourly_cluster_shares(spark, sf_dir):
    return rounded(cl.share_statistics(shares(spark, sf_dir), ["hour"]))


@query("overall_cluster_shares", TJ + """
select cluster_label, round(avg(fraction) + 1e-9, 6) + 0.0 as fraction from shares group by all""")
def overall_cluster_shares(spark, sf_dir):
    return rounded(cl.share_statistics(shares(spark, sf_dir), []))


@query("hour_by_cluster", TJ + """
select hour, round(coalesce(avg(fraction) filter (cluster_label = 0), 0) + 1e-9, 6) + 0.0 as cluster_0,
       round(coalesce(avg(fraction) filter (cluster_label = 1), 0) + 1e-9, 6) + 0.0 as cluster_1 from shares group by all""")
def hour_by_cluster(spark, sf_dir):
    return rounded(cl.hour_by_cluster(shares(spark, sf_dir), [0, 1]))


PEAKS = """
, hm as (select hour, cluster_label, avg(fraction) as f from shares group by all),
peaks as (select cluster_label, hour as peak_hour, f as peak_fraction from hm
          qualify row_number() over (partition by cluster_label order by round(f, 12) desc, hour) = 1)
"""


@query("peak_hours", TJ + PEAKS + "select cluster_label, peak_hour, round(peak_fraction + 1e-9, 6) + 0.0 as peak_fraction from peaks")
def peak_hours(spark, sf_dir):
    return rounded(cl.peak_hours(shares(spark, sf_dir)))


def moments(alias=""):
    return ", ".join(f"round(avg({c}) + 1e-9, 6) + 0.0 as {c}_mean, round(stddev_samp({c}) + 1e-9, 6) + 0.0 as {c}_std" for c in FEAT)


@query("features_at_peak_hours", TJ + PEAKS + f"""
select label as cluster_label, hour, count(*) as n, {moments()} from combined join peaks
  on peaks.cluster_label = label and peak_hour = hour group by label, hour""")
def features_at_peak_hours(spark, sf_dir):
    c = combined(spark, sf_dir)
    peaks = cl.peak_hours(cl.cluster_shares(c, ("site_id", "day", "hour")))
    return rounded(cl.features_at_peak(c, peaks, features=FEAT))


@query("features_per_cluster_and_hour", TJ + f"""
select label as cluster_label, hour, count(*) as n, {moments()} from combined group by grouping sets ((label), (label, hour))""")
def features_per_cluster_and_hour(spark, sf_dir):
    return rounded(cl.features_per_hour(combined(spark, sf_dir), features=FEAT))


AUDIT = """
, au as (select case when ant_id % 7 = 0 then null when ant_id % 11 = 0 then -2 else cluster_label + 1 end as cluster_label,
                ant_id * 2 as trajectory_index from traj)
"""


@query("label_audit", TJ + AUDIT + """
select count(distinct cluster_label) filter (cluster_label <> floor(cluster_label)) as non_integer_labels,
       count(distinct cluster_label) filter (cluster_label < 0 and cluster_label <> -1) as negative_labels,
       max(cluster_label) filter (cluster_label >= 0) + 1 - count(distinct cluster_label) filter (cluster_label >= 0) as gaps,
       case when count(*) filter (cluster_label = 0) = 0 then 1 else 0 end as zero_missing,
       count(*) filter (cluster_label is null) as null_labels,
       count(*) - count(distinct trajectory_index) as duplicate_indices,
       case when min(trajectory_index) = 0 and max(trajectory_index) = count(*) - 1 then 0 else 1 end as index_incomplete
from au""")
def label_audit(spark, sf_dir):
    ant = F.col("ant_id")
    t = trajectories(spark, sf_dir).select(
        F.when(ant % 7 == 0, None).when(ant % 11 == 0, -2).otherwise(F.col("cluster_label") + 1).alias("cluster_label"),
        (ant * 2).alias("trajectory_index"))
    return cl.label_audit(t)


@query("label_sizes", TJ + """
select cluster_label, count(*) as n, round(100 * count(*) / sum(count(*)) over () + 1e-9, 6) + 0.0 as percent from traj group by all""")
def label_sizes(spark, sf_dir):
    return rounded(cl.label_sizes(trajectories(spark, sf_dir)))


# ---- features, samples -------------------------------------------------------------------

BF = fx.with_ctes(fx.TRACKS, STEPS, FEATURES)
COLS = ("efficiency", "straight_distance", "avg_angle_change", "total_length")


def features(spark, sf_dir):
    return tj.behaviour_features(fx.tracks(spark, sf_dir))


LONG = " union all ".join(f"select '{c}' as feature, {c} as value from features" for c in COLS)


@query("feature_quality", BF + f"""
, l as ({LONG}), s as (select feature, avg(value) as mean, stddev_pop(value) as std, min(value) as lowest,
                              max(value) as highest from l group by all)
select feature, {r('mean', 'std', 'lowest', 'highest')}, std < 1e-6 as is_constant, highest - lowest < 0.1 as small_range,
       std < 0.1 as low_variance, std > 0.1 and highest - lowest > 0.1 as is_good from s""")
def feature_quality(spark, sf_dir):
    return rounded(cl.feature_quality(features(spark, sf_dir)))


PAIRS = " union all ".join(
    f"select '{x}' as feature_a, '{y}' as feature_b, corr({x}, {y}) as r from features"
    for i, x in enumerate(COLS) for y in COLS[i + 1:])


@query("strongest_correlations", BF + f"""
, p as ({PAIRS}) select feature_a, feature_b, round(r + 1e-9, 6) + 0.0 as r, round(abs(r) + 1e-9, 6) + 0.0 as strength from p
order by abs(p.r) desc limit 5""")
def strongest_correlations(spark, sf_dir):
    return rounded(cl.feature_correlations(features(spark, sf_dir)))


@query("most_variable_features", BF + f"""
, l as ({LONG}) select feature, round(var_pop(value), 4) + 0.0 as variance from l group by all order by variance desc limit 3""")
def most_variable_features(spark, sf_dir):
    v = cl.most_variable(features(spark, sf_dir), COLS, 3)
    return v.withColumn("variance", F.round("variance", 4) + F.lit(0.0))


TRACK_LABELS = """
tl as (select video_id, ant_id, (ant_id + video_id) % 4 as cluster_label, count(*) as trajectory_length from tracks group by all)
"""


def track_labels(spark, sf_dir):
    return fx.tracks(spark, sf_dir).groupBy("video_id", "ant_id").agg(
        F.count("*").alias("trajectory_length")).withColumn("cluster_label", (F.col("ant_id") + F.col("video_id")) % 4)


@query("sample_per_cluster", fx.with_ctes(fx.TRACKS, TRACK_LABELS) + """
select video_id, ant_id, cluster_label, trajectory_length from tl qualify row_number() over (partition by cluster_label
  order by md5('42|' || video_id || '|' || ant_id), video_id, ant_id) <= 5""")
def sample_per_cluster(spark, sf_dir):
    return cl.sample_per_cluster(track_labels(spark, sf_dir), 5)


@query("representative_sample", fx.with_ctes(fx.TRACKS, TRACK_LABELS) + """
, q as (select quantile_cont(trajectory_length, [0.25, 0.5, 0.75]) as q, count(*) as n from tl),
w as (select video_id, ant_id, cluster_label, trajectory_length, n,
             case when trajectory_length <= q[1] then 0 when trajectory_length <= q[2] then 1
                  when trajectory_length <= q[3] then 2 else 3 end as quartile from tl, q)
select video_id, ant_id, cluster_label, trajectory_length, quartile from w
qualify row_number() over (partition by quartile order by video_id, ant_id) <= 5 or n <= 20""")
def representative_sample(spark, sf_dir):
    return cl.representative_sample(track_labels(spark, sf_dir), 20)


@query("diverse_sample")
def diverse_sample(spark, sf_dir):
    return cl.diverse_sample(features(spark, sf_dir), 8)


# ---- behaviour and flux clusters ----------------------------------------------------------

@query("behaviour_clusters")
def behaviour_clusters(spark, sf_dir):
    labelled, _ = cl.behaviour_clusters(features(spark, sf_dir))
    return labelled.select("video_id", "ant_id", "cluster_label")


@query("behaviour_cluster_quality")
def behaviour_cluster_quality(spark, sf_dir):
    labelled, _ = cl.behaviour_clusters(features(spark, sf_dir), 4)
    return rounded(cl.cluster_quality(labelled))


Z = ("efficiency", "straight_distance", "avg_angle_change", "total_length")
GAP = "sqrt(" + " + ".join(f"(p.{c} - q.{c}) ** 2" for c in Z) + ")"


@query("behaviour_density_clusters", BF + f"""
, whole as (select * from features where {" and ".join(f"{c} is not null" for c in Z)}),
mo as (select {", ".join(f"avg({c}) as m_{c}, case when stddev_pop({c}) > 0 then stddev_pop({c}) else 1 end as s_{c}" for c in Z)} from whole),
z as (select row_number() over (order by {", ".join(f"({c} - m_{c}) / s_{c}" for c in Z)}, video_id, ant_id) as id, video_id, ant_id,
             {", ".join(f"({c} - m_{c}) / s_{c} as {c}" for c in Z)} from whole, mo),
near as materialized (select p.id as a, q.id as b from z p join z q on {GAP} <= 0.4),
core as materialized (select a from near group by a having count(*) >= 4),
link as materialized (select n.a, n.b from near n semi join core c on c.a = n.a semi join core d on d.a = n.b),
reach as (select a, a as root from core union select l.b, r.root from reach r join link l on l.a = r.a where l.b > r.root),
root as (select a, min(root) as root from reach group by a),
lab as (select a, dense_rank() over (order by root) - 1 as cluster from root),
border as (select n.a, min(cluster) as cluster from near n join lab on lab.a = n.b anti join core c on c.a = n.a group by n.a),
named as (select * from lab union all select * from border)
select f.video_id, f.ant_id, case when z.id is not null then coalesce(cluster, -1) end::int as cluster_label
from features f left join z using (video_id, ant_id) left join named on named.a = z.id""")
def behaviour_density_clusters(spark, sf_dir):
    return dn.behaviour_density_clusters(features(spark, sf_dir), eps=0.4, min_samples=4).select("video_id", "ant_id", "cluster_label")


@query("flux_map_clusters")
def flux_map_clusters(spark, sf_dir):
    cells = gr.flux_field(speeds(spark, sf_dir), by=("site_id", "day", "hour"), size=20)
    v = cl.flux_map_vectors(gr.flux_shares(cells, by=("site_id", "day", "hour")), nx=96, ny=54)
    rows, _ = cl.flux_map_clusters(v, 20, 6)
    return rows.groupBy("cluster_label", "hour").agg(F.count("*").alias("n"))


def feature_components(spark, sf_dir):
    f = tj.extended_features(fx.tracks(spark, sf_dir))
    cols = [c for c, t in f.dtypes if t in ("double", "bigint") and c not in ("video_id", "ant_id")]
    rows, _ = cl.principal_components(cl.assembled(f, cols), 2)
    return rows


@query("extended_feature_components")
def extended_feature_components(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    v = vector_to_array("pca")
    return rounded(feature_components(spark, sf_dir).select(
        "video_id", "ant_id", F.get(v, F.lit(0)).alias("pc1"), F.get(v, F.lit(1)).alias("pc2")))


@query("extended_component_checks", f"""
with f as ({ORACLES['extended_features']}), whole as (select * from f where columns(*) is not null)
select component, (select count(*) from whole) as n, 1.0::double as length, 0.0::double as largest_product
from (values (1), (2)) c(component)""")
def extended_component_checks(spark, sf_dir):
    """Directions of the components are eigenvectors of the covariance and at right angles."""
    c = cl.component_checks(cut_lineage(feature_components(spark, sf_dir).select("features", "pca")), 2)
    return rounded(c.select("component", "n", "length", "largest_product"))


# ---- density clusters ----------------------------------------------------------------------

ENDS = """
ends as (select site_id, video_id, ant_id, n_rows, sx as start_x, sy as start_y, ex as end_x, ey as end_y from (
  select site_id, video_id, ant_id, count(*) as n_rows, min_by(center_x, (frame_number, seq)) as sx,
         min_by(center_y, (frame_number, seq)) as sy, max_by(center_x, (frame_number, seq)) as ex,
         max_by(center_y, (frame_number, seq)) as ey from tracks group by all) where n_rows >= 5)
"""


def dbscan_sql(p, x, y, eps, k_min):
    """Core points, components by smallest reachable point, borders to the lowest label."""
    return f"""
{p}p as (select site_id, {x} as x, {y} as y, count(*) as n from ends group by all),
{p}core as (select a.site_id, a.x, a.y, a.x * 10000 + a.y as id from {p}p a join {p}p b
   on a.site_id = b.site_id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {eps} group by all having sum(b.n) >= {k_min}),
{p}link as (select a.site_id, a.id as a, b.id as b from {p}core a join {p}core b
   on a.site_id = b.site_id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {eps}),
{p}reach as (select site_id, a, b from {p}link union
   select r.site_id, r.a, l.b from {p}reach r join {p}link l on l.site_id = r.site_id and l.a = r.b),
{p}root as (select site_id, a as id, min(b) as root from {p}reach group by all),
{p}lab as (select *, dense_rank() over (partition by site_id order by root) - 1 as cluster from {p}root),
{p}corelab as (select c.site_id, c.x, c.y, cluster from {p}core c join {p}lab using (site_id, id)),
{p}all as (select site_id, x, y, cluster from {p}corelab union all
   select p.site_id, p.x, p.y, min(c.cluster) from {p}p p join {p}corelab c
     on p.site_id = c.site_id and sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2) <= {eps}
   where not exists (select 1 from {p}corelab q where q.site_id = p.site_id and q.x = p.x and q.y = p.y) group by all)
"""


DB = fx.with_ctes(fx.TRACKS, ENDS, dbscan_sql("s", "start_x", "start_y", 100, 3), dbscan_sql("e", "end_x", "end_y", 100, 3))


def ends(spark, sf_dir):
    return cl.trajectory_ends(fx.tracks(spark, sf_dir), ("site_id", "video_id", "ant_id"))


@query("start_point_clusters", DB + """
select site_id, video_id, ant_id, coalesce(cluster, -1)::int as cluster from ends
left join sall on sall.site_id = ends.site_id and sall.x = start_x and sall.y = start_y""".replace(
    "select site_id, video_id", "select ends.site_id, video_id"))
def start_point_clusters(spark, sf_dir):
    return cl.density_clusters(ends(spark, sf_dir), ["site_id"], "start_x", "start_y", 100.0, 3).select(
        "site_id", "video_id", "ant_id", "cluster")


@query("end_to_end_trails", DB + f"""
, t as (select ends.*, s.cluster as start_cluster, e.cluster as end_cluster from ends
  join sall s on s.site_id = ends.site_id and s.x = start_x and s.y = start_y
  join eall e on e.site_id = ends.site_id and e.x = end_x and e.y = end_y),
g as (select site_id, start_cluster, end_cluster, count(*) as n_trajectories, avg(n_rows) as mean_length, avg(start_x) as start_x,
        avg(start_y) as start_y, avg(end_x) as end_x, avg(end_y) as end_y from t group by all having count(*) >= 3 and avg(n_rows) >= 10)
select site_id, start_cluster::int as start_cluster, end_cluster::int as end_cluster, n_trajectories,
  {r('mean_length', 'start_x', 'start_y', 'end_x', 'end_y')}, round(end_x - start_x + 1e-9, 6) + 0.0 as direction_x,
  round(end_y - start_y + 1e-9, 6) + 0.0 as direction_y from g""".replace(
    "round(end_x - start_x", "round(g.end_x - g.start_x").replace("round(end_y - start_y", "round(g.end_y - g.start_y"))
def end_to_end_trails(spark, sf_dir):
    return rounded(cl.end_to_end_trails(ends(spark, sf_dir), ["site_id"], 100.0, 3, 3, 10.0))


# ---- classifier ----------------------------------------------------------------------------

TSC = fx.with_ctes(fx.TRACKS, SCORES)


@query("labelled_features", fx.with_ctes(fx.TRACKS, STEPS, FEATURES) + f"""
select video_id, ant_id, {r('efficiency', 'total_length')}, case when (ant_id // 3 + video_id) % 3 = 0 then 1 else 0 end as label
from features""")
def labelled_features(spark, sf_dir):
    return rounded(labelled(spark, sf_dir).select("video_id", "ant_id", "efficiency", "total_length", "label"))


def labelled(spark, sf_dir, found=None):
    found = features(spark, sf_dir) if found is None else found
    t = fx.tracks(spark, sf_dir).select("video_id", "ant_id").distinct()
    is_digging = (F.floor(F.col("ant_id") / 3) + F.col("video_id")) % 3 == 0
    notes = t.select("video_id", "ant_id", F.when(is_digging, " Yes").otherwise("no").alias("excavating"))
    prox = tj.nest_proximity(fx.tracks(spark, sf_dir), fx.ignored_pixels(spark)).select("video_id", "ant_id", "nest_proximity")
    return sc.training_table(found.join(prox, ["video_id", "ant_id"]), notes, [*COLS, "nest_proximity"])


METRIC_SQL = """
, ranks as (select *, rank() over (partition by video_id order by excavating_score)
                    + (count(*) over (partition by video_id, excavating_score) - 1) / 2 as rk,
                   excavating_score >= 0.5 as hit, label = 1 as pos from scores),
c as (select video_id, count(*) filter (hit and pos) as tp, count(*) filter (hit and not pos) as fp,
             count(*) filter (not hit and pos) as fn, count(*) filter (not hit and not pos) as tn,
             sum(rk) filter (pos) as rs from ranks group by all),
fm as (select video_id, tp + fp + fn + tn as n_samples, (tp + tn) / (tp + fp + fn + tn) as accuracy,
        coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0),
                 tn / nullif(tn + fp, 0)) as balanced_accuracy,
        case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
        case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1,
        (rs - (tp + fn) * (tp + fn + 1) / 2) / nullif((tp + fn) * (tn + fp), 0) as roc_auc from c)
"""


@query("classification_metrics", TSC + METRIC_SQL + f"select video_id, n_samples, {r(*sc.METRICS)} from fm".replace(
    "round(precision", 'round("precision"').replace("as precision", 'as "precision"'))
def classification_metrics(spark, sf_dir):
    return rounded(sc.fold_metrics(scores(spark, sf_dir)))


@query("mean_classification_metrics", TSC + METRIC_SQL + "select " + ", ".join(
    f'round(avg("{m}") + 1e-9, 6) + 0.0 as "{m}"' for m in sc.METRICS) + " from fm")
def mean_classification_metrics(spark, sf_dir):
    return rounded(sc.mean_metrics(sc.fold_metrics(scores(spark, sf_dir))))


SWEEP = """
, th as (select i, round(0.10 + 0.05 * i, 2)::double as threshold from range(18) t(i)),
ct as (select threshold, count(*) filter (excavating_score >= threshold and label = 1) as tp,
              count(*) filter (excavating_score >= threshold and label = 0) as fp,
              count(*) filter (excavating_score < threshold and label = 1) as fn, count(*) as n from scores, th group by all),
sw as (select threshold, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as rc,
              case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1, (n - fp - fn) / n as accuracy from ct)
"""


@query("threshold_sweep", TSC + SWEEP + """
select threshold, round(p + 1e-9, 6) + 0.0 as "precision", round(rc + 1e-9, 6) + 0.0 as recall, round(f1 + 1e-9, 6) + 0.0 as f1,
       round(accuracy + 1e-9, 6) + 0.0 as accuracy from sw""")
def threshold_sweep(spark, sf_dir):
    return rounded(sc.threshold_sweep(scores(spark, sf_dir)), "threshold")


@query("best_threshold", TSC + SWEEP + """
select threshold, round(p + 1e-9, 6) + 0.0 as "precision", round(rc + 1e-9, 6) + 0.0 as recall, round(sw.f1 + 1e-9, 6) + 0.0 as f1 from sw
order by sw.f1 desc, threshold limit 1""")
def best_threshold(spark, sf_dir):
    return rounded(sc.best_threshold(sc.threshold_sweep(scores(spark, sf_dir))), "threshold")


@query("score_histogram", TSC + """
select least(floor(excavating_score * 10), 9)::int as bin, count(*) as n from scores where excavating_score between 0 and 1 group by all""")
def score_histogram(spark, sf_dir):
    return sc.score_histogram(scores(spark, sf_dir))


@query("leave_one_out_gain")
def leave_one_out_gain(spark, sf_dir):
    table = labelled(spark, sf_dir)
    with_nest = sc.fold_metrics(sc.leave_one_out_scores(table, [*COLS, "nest_proximity"]))
    without = sc.fold_metrics(sc.leave_one_out_scores(table, list(COLS)))
    return rounded(sc.metric_gain(with_nest, without))


@query("leave_one_out_gradients", fx.with_ctes(fx.TRACKS, STEPS, FEATURES) + """
, l as (select video_id, case when (ant_id // 3 + video_id) % 3 = 0 then 1 else 0 end as label from features),
t as (select count(*) as n, sum(label) as ones from l), c as (select video_id, count(*) as n, sum(label) as ones from l group by all)
select video_id, 0.0::double as gradient from c, t where t.ones - c.ones > 0 and t.ones - c.ones < t.n - c.n""")
def leave_one_out_gradients(spark, sf_dir):
    """At the fitted weights the gradient of every fold's loss is 0."""
    table = cut_lineage(labelled(spark, sf_dir))
    columns = [*COLS, "nest_proximity"]
    return rounded(sc.leave_one_out_gradients(table, cut_lineage(sc.leave_one_out_models(table, columns)), columns))


@query("scored_trajectories")
def scored_trajectories(spark, sf_dir):
    found = cut_lineage(features(spark, sf_dir))
    table = cut_lineage(labelled(spark, sf_dir, found))  # a fit reads it several times
    model = sc.fit_classifier(table, COLS)
    f = found.withColumn(
        "efficiency", F.when(F.col("ant_id") % 10 == 0, None).otherwise(F.col("efficiency")))
    return rounded(sc.scored(model, f, COLS))


# ---- regression ----------------------------------------------------------------------------

REG = """
reg as (select site_id, day, hour, ln(total) as y, sin(2 * pi() * hour / 24) as hour_sin, cos(2 * pi() * hour / 24) as hour_cos,
               temperature, humidity, lux from rates join clips using (site_id, day, hour) where total > 0)
"""


def regression_rows(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    clips = a.direction_rates(t).join(fx.clips(t), list(a.SLOT))
    return st.regression_table(clips, "total")


@query("regression_table", fx.with_ctes(fx.TRACKS, fx.CLIPS, RATES, REG) + f"""
select site_id, day, hour, {r('y', 'hour_sin', 'hour_cos')}, temperature, humidity, lux from reg""")
def regression_table(spark, sf_dir):
    return rounded(regression_rows(spark, sf_dir))


@query("standardised_predictors", fx.with_ctes(fx.TRACKS, fx.CLIPS, RATES, REG) + """
select site_id, day, hour, round((temperature - avg(temperature) over ()) / stddev_pop(temperature) over () + 1e-9, 6) + 0.0 as temperature,
       round((lux - avg(lux) over ()) / stddev_pop(lux) over () + 1e-9, 6) + 0.0 as lux from reg""")
def standardised_predictors(spark, sf_dir):
    s = st.standardised(regression_rows(spark, sf_dir), st.PREDICTORS, ddof_sample=False)
    return rounded(s.select("site_id", "day", "hour", "temperature", "lux"))


@query("predictor_correlations", fx.with_ctes(fx.TRACKS, fx.CLIPS, RATES, REG) + " union all ".join(
    f"select '{x}' as a, '{y}' as b, round(corr({x}, {y}) + 1e-9, 6) + 0.0 as r from reg" for x in st.PREDICTORS for y in st.PREDICTORS))
def predictor_correlations(spark, sf_dir):
    return rounded(st.predictor_correlations(regression_rows(spark, sf_dir)))


def sweeps(start: str, names, last: str) -> str:
    """Common table expressions that sweep every name but `last` out of the correlations c_i_j of table `start`;
    what stays of `last` is the part that the others do not explain."""
    steps, before = [], start
    for k in [n for n in names if n != last]:
        terms = ", ".join(f"c_{i}_{j} - c_{i}_{k} * c_{k}_{j} / c_{k}_{k} as c_{i}_{j}" for i in names for j in names)
        steps.append(f"{last}_without_{k} as (select {terms} from {before})")
        before = f"{last}_without_{k}"
    return ",\n".join([*steps, f"{last}_vif as (select '{last}' as predictor, 1 / c_{last}_{last} as v from {before})"])


@query("variance_inflation", fx.with_ctes(fx.TRACKS, fx.CLIPS, RATES, REG) + ", c as (select " + ", ".join(
    f"corr({x}, {y}) as c_{x}_{y}" for x in st.PREDICTORS for y in st.PREDICTORS) + " from reg),\n" + ",\n".join(
    sweeps("c", st.PREDICTORS, p) for p in st.PREDICTORS) + " union all ".join(
    f"\nselect predictor, round(v + 1e-9, 6) + 0.0 as vif from {p}_vif" for p in st.PREDICTORS))
def variance_inflation(spark, sf_dir):
    return rounded(st.variance_inflation(regression_rows(spark, sf_dir)))


@query("random_intercept_fit")
def random_intercept_fit(spark, sf_dir):
    table = st.standardised(regression_rows(spark, sf_dir), st.PREDICTORS, ddof_sample=False)
    model = st.random_intercept_model(table)
    f = st.fitted_values(table, model)
    return rounded(f.select("site_id", "day", "hour", "y", "fitted", "residual"))


@query("random_intercept_gradients", fx.with_ctes(fx.TRACKS, fx.CLIPS, RATES, REG) + f"""
select predictor, (select count(*) from reg) as n, 0.0::double as gradient
from (values {", ".join(f"('{p}')" for p in ("intercept", *st.PREDICTORS))}) p(predictor)""")
def random_intercept_gradients(spark, sf_dir):
    """At the fitted coefficients the gradient of the likelihood is 0."""
    table = cut_lineage(st.standardised(regression_rows(spark, sf_dir), st.PREDICTORS, ddof_sample=False))
    fitted = st.fitted_values(table, st.random_intercept_model(table))
    return rounded(st.intercept_model_gradients(fitted))
