"""Trails and linked tracks."""

from pyspark.sql import Window, functions as F

from trackframe.operators import branches as br, grids as gr, kinematics as k, linking as ln, resampling as rs
from trackframe.operators import statistics as st, tracking as tg, trails as tr
from trackframe.plans import fixtures as fx
from trackframe.plans.activity_queries import r
from trackframe.plans.registry import query, rounded
from trackframe.plans.space_queries import B, boot_sql, ci, flux, speeds
from trackframe.plans.track_queries import SEQ, boxes
from trackframe.session import cut_lineage

FX = fx.with_ctes(fx.TRACKS, fx.SPEEDS, fx.FLUX)

TRAILS = """
trails as (select s as site_id, t.* from trail_cells t, (values (1), (2), (3)) v(s)),
trail_sizes as (select site_id, trail_id, count(*) as n_cells from trails group by all),
spine as (select site_id, day, h::int as hour, direction, trail_id, n_cells
          from (select distinct site_id, day from speeds) join trail_sizes using (site_id), range(24) t(h),
               (values ('away'), ('toward')) d(direction)),
on_trail as (
  select site_id, day, hour, direction, trail_id, count(*) as n
  from (select *, (ceil(center_x / 20) - 1)::int as x_bin, (ceil(center_y / 20) - 1)::int as y_bin from speeds)
  join trails using (site_id, x_bin, y_bin) group by all),
sf as (select site_id, day, hour, direction, count(distinct (video_id, frame_number)) as n_frames from speeds group by all),
activity as (
  select site_id, trail_id, day, hour, direction, coalesce(n / n_frames, 0) as raw, coalesce(n / n_frames, 0) / n_cells as density
  from spine left join on_trail using (site_id, day, hour, direction, trail_id) left join sf using (site_id, day, hour, direction)),
paired as (
  select site_id, trail_id, day, hour, sum(density) filter (direction = 'away') as away,
         sum(density) filter (direction = 'toward') as toward,
         sum(density) filter (direction = 'away') - sum(density) filter (direction = 'toward') as diff
  from activity group by all)
"""
TT = fx.with_ctes(fx.TRACKS, fx.SPEEDS, fx.TRAIL_CELLS, TRAILS)


def trails(spark):
    """The fixed trails at each of the three sites."""
    return fx.trail_cells(spark).withColumn("site_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))


def activity(spark, sf_dir):
    return tr.trail_activity(speeds(spark, sf_dir), trails(spark))


@query("trail_activity", TT + f"select site_id, trail_id, day, hour, direction, {r('raw', 'density')} from activity")
def trail_activity(spark, sf_dir):
    return rounded(activity(spark, sf_dir))


@query("trail_direction_bias", TT + f"""
select site_id, trail_id, day, hour, {r('away', 'toward', 'diff')},
       round(case when away + toward > 0 then diff / (away + toward) else 0 end + 1e-9, 6) + 0.0 as bias from paired""")
def trail_direction_bias(spark, sf_dir):
    return rounded(tr.paired_activity(activity(spark, sf_dir)))


@query("trail_bidirectionality", TT + boot_sql("paired", ["site_id", "trail_id", "hour"], ["diff"]) + f"""
, c as (select site_id, trail_id, hour, {ci('diff')} from means group by all)
select *, diff_low > 0 or diff_high < 0 as significant,
       case when (diff_low > 0 or diff_high < 0) and diff_mean > 0 then 'away'
            when diff_low > 0 or diff_high < 0 then 'toward' else 'balanced' end as label from c""")
def trail_bidirectionality(spark, sf_dir):
    p = tr.paired_activity(activity(spark, sf_dir))
    c = rs.bootstrap_intervals(p, ["site_id", "trail_id", "hour"], ["diff"], ["day"], B)
    return rs.difference_verdicts(rounded(c), "diff")


@query("trail_hour_axis", TT + f"""
select site_id, trail_id, direction, ((day - (select min(day) from tracks)) * 24 + hour)::int as t, {r('density')} from activity""")
def trail_hour_axis(spark, sf_dir):
    first = fx.tracks(spark, sf_dir).agg(F.min("day")).first()[0]
    return rounded(tr.hour_axis(activity(spark, sf_dir), first).select("site_id", "trail_id", "direction", "t", "density"))


@query("trail_daily_means", TT + """
select site_id, trail_id, direction, day, round(avg(density) + 1e-9, 6) + 0.0 as density from activity group by all""")
def trail_daily_means(spark, sf_dir):
    return rounded(tr.daily_means(activity(spark, sf_dir)))


# daily totals of both directions at each site make series long enough for lags
LAGS = """
, series as (select site_id, trail_id, ((day - (select min(day) from tracks)) * 24 + hour)::int as t, away, toward from paired),
lagged as (select l.site_id, l.trail_id, g.lag::int as lag, l.toward as x, f.away as y
           from series l, range(13) g(lag), series f
           where f.site_id = l.site_id and f.trail_id = l.trail_id and f.t = l.t + g.lag),
rs as (select site_id, trail_id, lag, count(*) as n,
              case when count(*) >= 5 and max(x) > min(x) and max(y) > min(y) then corr(x, y) end as r from lagged group by all),
ts as (select *, r * sqrt((n - 2) / (1 - r * r)) as t_stat from rs),
best as (select * from ts where r is not null
         qualify row_number() over (partition by site_id, trail_id order by round(abs(r), 12) desc, lag) = 1)
"""


def lagged(spark, sf_dir):
    first = fx.tracks(spark, sf_dir).agg(F.min("day")).first()[0]
    s = cut_lineage(tr.hour_axis(tr.paired_activity(activity(spark, sf_dir)), first))
    return st.lagged_correlations(s, ["site_id", "trail_id"])


@query("trail_lagged_correlations", TT + LAGS + f"select site_id, trail_id, lag, n, {r('r', 't_stat')} from ts")
def trail_lagged_correlations(spark, sf_dir):
    return rounded(lagged(spark, sf_dir))


@query("trail_best_lags", TT + LAGS + f"""
select site_id, trail_id, coalesce(best.lag, 0) as best_lag, round(best.r + 1e-9, 6) + 0.0 as best_r, n, {r('t_stat')}
from (select distinct site_id, trail_id from rs) left join best using (site_id, trail_id)""")
def trail_best_lags(spark, sf_dir):
    return rounded(st.best_lags(lagged(spark, sf_dir), ["site_id", "trail_id"]))


# Student's t for whole degrees of freedom is a finite sum, as in statistics.student_p_value
@query("trail_lag_summary", TT + LAGS + """
, s as (select trail_id, coalesce(best.lag, 0) as lag, best.r, n - 2 as dof, abs(t_stat) / sqrt(n - 2 + t_stat * t_stat) as sine,
               (n - 2) / (n - 2 + t_stat * t_stat) as c2, atan(abs(t_stat) / sqrt(n - 2)) as angle
        from (select distinct site_id, trail_id from rs) left join best using (site_id, trail_id)),
p as (select *, 1 - case when dof % 2 = 0 then sine * list_sum(list_transform(range(0, dof // 2),
                         lambda k: c2 ** k * exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1))))
                    else 2 / pi() * (angle + sine * coalesce(list_sum(list_transform(range(0, dof // 2),
                         lambda k: c2 ** (k + 0.5) * exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)))), 0)) end as p_value from s)
select round(avg(r) + 1e-9, 6) + 0.0 as mean_best_r, round(avg(lag) + 1e-9, 6) + 0.0 as mean_best_lag,
       count(*) filter (p_value < 0.05) as n_significant, count(*) as n_trails from p""")
def trail_lag_summary(spark, sf_dir):
    return rounded(st.lag_summary(st.best_lags(lagged(spark, sf_dir), ["site_id", "trail_id"])))


# ---- cells and graphs of the busiest flux -----------------------------------------------

BUSY = """
site_flux as (select site_id, x_bin, y_bin, sum(flux_mag) as f from flux where direction in ('away', 'toward') group by all),
level as (select site_id, quantile_cont(f, 0.7) as lv from site_flux where f > 0 group by all),
cells as (select site_id, x_bin, y_bin, (y_bin * 96 + x_bin)::int as node from site_flux join level using (site_id) where f >= lv),
edges as (select a.site_id, a.node, b.node as other from cells a join cells b
          on a.site_id = b.site_id and abs(a.x_bin - b.x_bin) <= 1 and abs(a.y_bin - b.y_bin) <= 1 and a.node <> b.node),
degrees as (select c.site_id, c.x_bin, c.y_bin, c.node, count(e.other) as degree, count(e.other) = 1 as is_endpoint
            from cells c left join edges e on e.site_id = c.site_id and e.node = c.node group by all)
"""
BX = fx.with_ctes(fx.TRACKS, fx.SPEEDS, fx.FLUX, BUSY)


def busy_cells(spark, sf_dir, widen=0):
    f = gr.cumulative_flux(flux(spark, sf_dir), by=("site_id",)).withColumn("flux_mag", F.round("flux_mag", 9))
    return cut_lineage(tr.trail_cells(cut_lineage(f), widen=widen))


BX = BX.replace("sum(flux_mag) as f from flux", "round(sum(flux_mag), 9) as f from flux")


@query("busy_trail_cells", BX + "select site_id, x_bin, y_bin from cells")
def busy_trail_cells(spark, sf_dir):
    return busy_cells(spark, sf_dir)


@query("widened_busy_cells", BX + """
select distinct site_id, (x_bin + i)::int as x_bin, (y_bin + j)::int as y_bin from cells, range(-1, 2) a(i), range(-1, 2) b(j)
where abs(i) + abs(j) <= 1 and x_bin + i between 0 and 95 and y_bin + j between 0 and 53""")
def widened_busy_cells(spark, sf_dir):
    return busy_cells(spark, sf_dir, widen=1)


@query("cell_graph_degrees", BX + "select * from degrees")
def cell_graph_degrees(spark, sf_dir):
    return tr.node_degrees(busy_cells(spark, sf_dir))


def nest_cells(spark):
    """Grid cells of the shaded rectangle."""
    x1, y1, x2, y2 = [v // 20 for v in fx.SHADE]
    w, h = x2 - x1 + 1, y2 - y1 + 1
    return spark.range(w * h).select((F.col("id") % w + x1).cast("int").alias("x_bin"),
                                     (F.floor(F.col("id") / w) + y1).cast("int").alias("y_bin"))


JUNCTIONS = """
cand as (select *, row_number() over (partition by site_id order by d, y_bin, x_bin) as rn from (
  select site_id, x_bin, y_bin, sqrt(greatest(43 - x_bin, x_bin - 53, 0) ** 2 + greatest(22 - y_bin, y_bin - 32, 0) ** 2) as d
  from cells) where d <= 30),
pick as (
  select distinct site_id, 0::bigint as rn, []::struct(x int, y int, d double)[] as sel from cand
  union all
  select p.site_id, c.rn, case when len(p.sel) < 3 and len(list_filter(p.sel, lambda s:
      (s.x - c.x_bin) ** 2 + (s.y - c.y_bin) ** 2 < 100)) = 0
    then list_append(p.sel, {'x': c.x_bin, 'y': c.y_bin, 'd': c.d}) else p.sel end
  from pick p join cand c on c.site_id = p.site_id and c.rn = p.rn + 1),
junctions as (select site_id, (unnest(range(len(sel))))::int as "rank", unnest(sel) as s
              from (select site_id, max_by(sel, rn) as sel from pick group by all))
"""
JX = BX.rstrip() + "," + JUNCTIONS


def junctions(spark, cells):
    return tr.nest_junctions(cells, nest_cells(spark))


@query("nest_junctions", JX + """
select site_id, "rank", s.x as x_bin, s.y as y_bin, round(s.d + 1e-9, 6) + 0.0 as distance from junctions""")
def nest_junctions(spark, sf_dir):
    return rounded(junctions(spark, busy_cells(spark, sf_dir)))


@query("shortest_trail_lengths", JX.rstrip() + """,
walk as (select site_id, (s.y * 96 + s.x)::int as node, 1 as length from junctions
         union
         select w.site_id, e.other, w.length + 1 from walk w join edges e on e.site_id = w.site_id and e.node = w.node
         where w.length < 150),
near as (select site_id, node, min(length) as length from walk group by all)
select site_id, node, length from near join (select site_id, node from degrees where is_endpoint) using (site_id, node)
where length > 2""")
def shortest_trail_lengths(spark, sf_dir):
    c = busy_cells(spark, sf_dir)
    return tr.shortest_trails(c, junctions(spark, c), min_length=2).select("site_id", "node", "length")


@query("unique_branches", JX.rstrip() + """,
walk as (select site_id, "rank", (s.y * 96 + s.x)::int as node, 0 as length from junctions
         union
         select w.site_id, w."rank", e.other, w.length + 1 from walk w join edges e on e.site_id = w.site_id and e.node = w.node
         where w.length < 150),
dist as materialized (select site_id, "rank", node, min(length) as length from walk group by all),
prev as materialized (select d.site_id, d."rank", d.node, min(e.other) as other from dist d join edges e on e.site_id = d.site_id and e.node = d.node
         join dist p on p.site_id = d.site_id and p."rank" = d."rank" and p.node = e.other and p.length = d.length - 1 group by all),
branch as (select site_id, "rank", node, node as here, length as seq from dist join (select site_id, node from degrees where is_endpoint) using (site_id, node)
           union all
           select b.site_id, b."rank", b.node, p.other, b.seq - 1 from branch b
           join prev p on p.site_id = b.site_id and p."rank" = b."rank" and p.node = b.here)
select site_id, "rank", node, seq, (here % 96)::int as x_bin, (here // 96)::int as y_bin from branch""")
def unique_branches(spark, sf_dir):
    c = busy_cells(spark, sf_dir)
    return br.unique_branches(c, junctions(spark, c))


# of the shortest ways to an endpoint the one from the first junction, then the one with the least cells
FOUND = """,
walk as (select site_id, (s.y * 96 + s.x)::int as node, 1 as length from junctions
         union
         select w.site_id, e.other, w.length + 1 from walk w join edges e on e.site_id = w.site_id and e.node = w.node
         where w.length < 150),
near as materialized (select site_id, node, min(length) as length from walk group by all),
way as (select site_id, (s.y * 96 + s.x)::int as node, 1 as length, min({'r': "rank", 'p': [(s.y * 96 + s.x)::int]}) as m
        from junctions group by all
        union all
        select w.site_id, e.other, w.length + 1, min({'r': w.m.r, 'p': list_append(w.m.p, e.other)})
        from way w join edges e on e.site_id = w.site_id and e.node = w.node
        join near n on n.site_id = w.site_id and n.node = e.other and n.length = w.length + 1
        group by w.site_id, e.other, w.length + 1),
found as (select site_id, (row_number() over (partition by site_id order by node) - 1)::int as trail_id, m.p as path
          from way join (select site_id, node from degrees where is_endpoint) using (site_id, node) where length > 2),
points as (select site_id, trail_id, unnest(range(len(path))) as seq, unnest(path) as n from found),
cut as (select site_id, trail_id, seq, (n % 96)::int as x_bin, (n // 96)::int as y_bin, n from points)
"""


def found_trails(spark, sf_dir):
    c = busy_cells(spark, sf_dir)
    return cut_lineage(tr.trail_points(tr.shortest_trails(c, junctions(spark, c), min_length=2)))


@query("trails_without_contained", JX.rstrip() + FOUND.rstrip() + """,
sizes as (select site_id, trail_id, count(*) as n_points from cut group by all),
over as (select a.site_id, a.trail_id as a, b.trail_id as b from cut a join cut b
         on a.site_id = b.site_id and a.trail_id <> b.trail_id and (a.x_bin - b.x_bin) ** 2 + (a.y_bin - b.y_bin) ** 2 < 4
         join sizes z on z.site_id = a.site_id and z.trail_id = a.trail_id
         group by all having count(distinct a.seq) / max(z.n_points) >= 0.8),
covers as (select s.site_id, s.trail_id, n_points, coalesce(list(b) filter (b is not null), []) as covers
           from sizes s left join over o on o.site_id = s.site_id and o.a = s.trail_id group by all),
turns as (select *, row_number() over (partition by site_id order by n_points desc, trail_id) as turn from covers),
fold as (select distinct site_id, 0::bigint as turn, []::int[] as kept from turns
         union all
         select f.site_id, t.turn, case when list_has_any(f.kept, t.covers) then f.kept else list_append(f.kept, t.trail_id) end
         from fold f join turns t on t.site_id = f.site_id and t.turn = f.turn + 1)
select site_id, unnest(kept) as trail_id from (select site_id, max_by(kept, turn) as kept from fold group by all)""")
def trails_without_contained(spark, sf_dir):
    return tr.without_contained(found_trails(spark, sf_dir), tolerance=2.0)


@query("widened_trail_labels", JX.rstrip() + FOUND + """
select site_id, (x_bin + i)::int as x_bin, (y_bin + j)::int as y_bin, max(trail_id) as trail_id
from cut, range(-1, 2) a(i), range(-1, 2) b(j)
where abs(i) + abs(j) <= 1 and x_bin + i between 0 and 95 and y_bin + j between 0 and 53 group by all""")
def widened_trail_labels(spark, sf_dir):
    return tr.cell_labels(tr.widened(found_trails(spark, sf_dir)))


@query("merged_trail_edges", JX.rstrip() + FOUND + """
select distinct site_id, least(n, o)::int as a, greatest(n, o)::int as b
from (select site_id, n, lead(n) over (partition by site_id, trail_id order by seq) as o from cut) where o is not null""")
def merged_trail_edges(spark, sf_dir):
    return tr.merged_edges(found_trails(spark, sf_dir))


# paths of individuals read as trails: their cells in order, at every site
PATHS = """
paths as (select site_id, ant_id::int as trail_id, (row_number() over (partition by site_id, ant_id order by frame_number, video_id, seq) - 1)::int as seq,
                 (ceil(center_x / 20) - 1)::int as x_bin, (ceil(center_y / 20) - 1)::int as y_bin
          from tracks where center_x > 0 and center_y > 0)
"""


def individual_paths(spark, sf_dir):
    from trackframe.functions.ordering import with_position
    t = gr.in_grid(gr.binned(k.centred(fx.tracks(spark, sf_dir))))
    p = with_position(t, ["site_id", "ant_id"], ["frame_number", "video_id", "seq"])
    return p.select("site_id", F.col("ant_id").cast("int").alias("trail_id"),
                    (F.col("position") - 1).cast("int").alias("seq"), "x_bin", "y_bin")


# the cells visited in each hour of the day read as 24 trails per site
@query("path_overlaps", fx.with_ctes(fx.TRACKS) + """
, v as (select distinct site_id, hour as trail_id, (ceil(center_x / 20) - 1)::int as x_bin, (ceil(center_y / 20) - 1)::int as y_bin
        from tracks where center_x > 0 and center_y > 0),
near as (select a.site_id, a.trail_id as a, b.trail_id as b, count(distinct (a.x_bin, a.y_bin)) as k
           from v a join v b on a.site_id = b.site_id and a.trail_id <> b.trail_id
            and sqrt((a.x_bin - b.x_bin) ** 2 + (a.y_bin - b.y_bin) ** 2) < 2 group by all),
n as (select site_id, trail_id as a, count(*) as n from v group by all)
select site_id, a, b, round(k / n + 1e-9, 6) + 0.0 as overlap from near join n using (site_id, a)""")
def path_overlaps(spark, sf_dir):
    t = gr.in_grid(gr.binned(k.centred(fx.tracks(spark, sf_dir))))
    v = t.select("site_id", F.col("hour").alias("trail_id"), *gr.CELL).distinct().withColumn(
        "seq", F.col("y_bin") * tr.NX + F.col("x_bin"))
    return rounded(tr.trail_overlaps(cut_lineage(v), tolerance=2.0))


@query("path_edges", fx.with_ctes(fx.TRACKS, PATHS) + """
, e as (select site_id, y_bin * 96 + x_bin as n, lead(y_bin * 96 + x_bin) over (partition by site_id, trail_id order by seq) as o from paths)
select distinct site_id, least(n, o)::int as a, greatest(n, o)::int as b from e where o is not null""")
def path_edges(spark, sf_dir):
    return tr.merged_edges(individual_paths(spark, sf_dir))


@query("path_masks", fx.with_ctes(fx.TRACKS, PATHS) + """
, m as (select distinct site_id, trail_id, x_bin + i as x_bin, y_bin + j as y_bin from paths, range(-1, 2) a(i), range(-1, 2) b(j)
        where abs(i) + abs(j) <= 1 and x_bin + i between 0 and 95 and y_bin + j between 0 and 53)
select site_id, x_bin::int as x_bin, y_bin::int as y_bin, max(trail_id) as trail_id from m group by all""")
def path_masks(spark, sf_dir):
    return tr.cell_labels(tr.widened(individual_paths(spark, sf_dir)))


# ---- linking -----------------------------------------------------------------------------

LINKS = """
b as (select p.*, f.f from pred p join (
        select video_id, frame_number, row_number() over (partition by video_id order by frame_number) as f
        from (select distinct video_id, frame_number from pred)) f using (video_id, frame_number)),
near as (
  select * from (
    select a.video_id, a.f, a.seq, c.f as f2, c.seq as seq2, c.f - a.f as gap,
           greatest(0, 20 - abs(a.px - c.px)) * greatest(0, 20 - abs(a.py - c.py)) as shared
    from b a join b c on a.video_id = c.video_id and c.f between a.f + 1 and a.f + 7)
  where shared > 0 and shared / (800.0::double - shared) >= 0.1),
ahead as (select * from near qualify row_number() over (partition by video_id, f, seq order by gap, shared desc, seq2) = 1),
back as (select * from near qualify row_number() over (partition by video_id, f2, seq2 order by gap, shared desc, seq) = 1),
links as (select a.* from ahead a join back using (video_id, f, seq, f2, seq2)),
chain as (
  select video_id, f, seq, f as rf, seq as rseq from b
  where not exists (select 1 from links l where l.video_id = b.video_id and l.f2 = b.f and l.seq2 = b.seq)
  union all
  select l.video_id, l.f2, l.seq2, c.rf, c.rseq from chain c join links l
    on l.video_id = c.video_id and l.f = c.f and l.seq = c.seq)
"""


@query("linked_tracks", fx.with_ctes(fx.DETECTIONS, SEQ.format(thr=0.327), LINKS) + """
select c.video_id, b.frame_number, c.seq, r.frame_number as first_frame, c.rseq as first_seq
from chain c join b on b.video_id = c.video_id and b.f = c.f and b.seq = c.seq
join b r on r.video_id = c.video_id and r.f = c.rf and r.seq = c.rseq""")
def linked_tracks(spark, sf_dir):
    return ln.linked_tracks(boxes(spark, sf_dir, 0.327)[1])


@query("assigned_tracks")
def assigned_tracks(spark, sf_dir):
    t = tg.tracked(boxes(spark, sf_dir, 0.327)[1])
    return t.select("video_id", "frame_number", "seq", "first_frame", "first_seq", "reported")


@query("assigned_track_checks", fx.with_ctes(fx.DETECTIONS, SEQ.format(thr=0.327)) + """
, frames as (select video_id, frame_number, count(*) as n from pred group by all)
select video_id, sum(n)::bigint as n_boxes, count(*) as n_frames, max(n) as most_tracks_in_a_frame, 0::bigint as n_doubles,
       0::bigint as n_long_gaps, 0::bigint as n_unopened from frames group by all""")
def assigned_track_checks(spark, sf_dir):
    """What holds for every assignment: a track has one box in a frame, misses at most seven frames with boxes,
    and is named by a box of its own."""
    t = tg.tracked(boxes(spark, sf_dir, 0.327)[1])  # read from written rounds
    track = ["video_id", "first_frame", "first_seq"]
    frames = t.groupBy("video_id", "frame_number").agg(
        F.count("*").alias("n"), F.countDistinct("first_frame", "first_seq").alias("tracks"))
    f = frames.withColumn("f", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_number")))
    gap = F.col("f") - F.lag("f").over(Window.partitionBy(*track).orderBy("f"))
    steps = t.join(f.select("video_id", "frame_number", "f"), ["video_id", "frame_number"]).withColumn("gap", gap)
    own = ((F.col("frame_number") == F.col("first_frame")) & (F.col("seq") == F.col("first_seq"))).cast("int")
    tracks = steps.groupBy(*track).agg(F.max((F.col("gap") > 8).cast("int")).alias("long"), F.sum(own).alias("own"))
    per = tracks.groupBy("video_id").agg(F.coalesce(F.sum("long"), F.lit(0)).cast("long").alias("n_long_gaps"),
                                         F.sum((F.col("own") != 1).cast("long")).alias("n_unopened"))
    return f.groupBy("video_id").agg(
        F.sum("n").alias("n_boxes"), F.count("*").alias("n_frames"), F.max("tracks").alias("most_tracks_in_a_frame"),
        F.sum(F.col("n") - F.col("tracks")).alias("n_doubles")).join(per, "video_id")
