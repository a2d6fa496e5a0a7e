"""Flow, flux, density, angle histograms and resampling."""

from pyspark.sql import functions as F

from trackframe.operators import activity as a, angles as an, grids as gr, kinematics as k
from trackframe.operators import resampling as rs, statistics as st
from trackframe.plans import fixtures as fx
from trackframe.plans.activity_queries import RATES, r
from trackframe.plans.registry import query, rounded
from trackframe.session import cut_lineage

FX = fx.with_ctes(fx.TRACKS, fx.SPEEDS, fx.FLUX)
B = 10_000


def speeds(spark, sf_dir):
    """Speeds computed once and read again by every branch of a query."""
    return cut_lineage(k.speeds(fx.tracks(spark, sf_dir)).select(
        "site_id", "day", "hour", "video_id", "frame_number", "direction", "center_x", "center_y", "velocity", "heading_deg"))


def flux(spark, sf_dir):
    return gr.flux_field(speeds(spark, sf_dir))


@query("flow_field", FX + """
select site_id, hour, direction, x_bin, y_bin, round(avg(velocity) + 1e-9, 6) + 0.0 as velocity,
       round(atan2(avg(sin(radians(heading_deg))), avg(cos(radians(heading_deg)))), 5) + 0.0 as mean_angle,
       count(*) as n_rows
from moving where x_bin is not null and y_bin is not null group by all""")
def flow_field(spark, sf_dir):
    f = gr.flow_field(speeds(spark, sf_dir), by=("site_id", "hour", "direction"))
    return rounded(f.withColumn("mean_angle", F.round("mean_angle", 5) + F.lit(0.0)), "mean_angle")


@query("flux_field", FX + f"""
select site_id, day, hour, direction, x_bin, y_bin, n_rows, {r('rows_per_frame', 'u', 'v', 'flux_mag')},
       (x_bin * 20 + 10)::double as x_center, (y_bin * 20 + 10)::double as y_center from flux""")
def flux_field(spark, sf_dir):
    f = flux(spark, sf_dir)
    return rounded(f.select("site_id", "day", "hour", "direction", "x_bin", "y_bin", "n_rows",
                            "rows_per_frame", "u", "v", "flux_mag", "x_center", "y_center"))


@query("flux_caps", FX + """
select site_id, hour, round(coalesce(quantile_cont(flux_mag, 0.95) filter (flux_mag > 0),
       case when max(flux_mag) > 0 then max(flux_mag) end, 1) + 1e-9, 6) + 0.0 as cap
from flux group by all""")
def flux_caps(spark, sf_dir):
    return rounded(gr.upper_cap(flux(spark, sf_dir), "flux_mag", ["site_id", "hour"]))


@query("shared_speed_cap", FX + """
, cells as (select site_id, hour, direction, x_bin, y_bin, avg(velocity) as velocity from moving
            where x_bin is not null and y_bin is not null group by all)
select round(coalesce(quantile_cont(velocity, 0.95) filter (velocity > 0), 1) + 1e-9, 6) + 0.0 as cap from cells""")
def shared_speed_cap(spark, sf_dir):
    f = gr.flow_field(speeds(spark, sf_dir), by=("site_id", "hour", "direction"))
    return rounded(gr.upper_cap(f, "velocity", []))


DAY_FLUX = """
, day_flux as (select site_id, day, x_bin, y_bin, sum(flux_mag) as flux_mag from flux
               where direction in ('away', 'toward') group by all)
"""


@query("daily_cumulative_flux", FX + DAY_FLUX + f"""
select site_id, day, x_bin, y_bin, {r('flux_mag')} from day_flux""")
def daily_cumulative_flux(spark, sf_dir):
    return rounded(gr.cumulative_flux(flux(spark, sf_dir)))


@query("cumulative_flux_by_direction", FX + """
select site_id, direction, x_bin, y_bin, round(sum(flux_mag) + 1e-9, 6) + 0.0 as flux_mag from flux
where direction in ('away', 'toward') group by all""")
def cumulative_flux_by_direction(spark, sf_dir):
    return rounded(gr.cumulative_flux(flux(spark, sf_dir), by=("site_id", "direction")))


SHARES = """
, shares as (select *, flux_mag / sum(flux_mag) over (partition by site_id, day, hour, direction) as share from flux)
"""


@query("flux_vectors", FX + SHARES + """
select site_id, day, hour, direction, x_bin * 54 + y_bin as x_major, y_bin * 96 + x_bin as y_major,
       round(share + 1e-9, 6) + 0.0 as share from shares""")
def flux_vectors(spark, sf_dir):
    return rounded(gr.flux_shares(flux(spark, sf_dir)).drop("x_bin", "y_bin"))


# hour vectors pooled over the days of a site, so that cells are shared between hours
HOUR_VECTORS = """
, hv as (select site_id, direction, hour, x_bin, y_bin, sum(flux_mag) as f from flux
         where direction in ('away', 'toward') group by all),
norms as (select site_id, direction, hour, sum(f) as s, sum(f * f) as q from hv group by all)
"""


def hour_vectors(spark, sf_dir):
    f = flux(spark, sf_dir)
    return gr.cumulative_flux(f, by=("site_id", "direction", "hour"))


def similarity_sql(expr, left, right):
    return FX + HOUR_VECTORS + f"""
, dots as (select l.site_id, l.hour as i, r.hour as j, sum(l.f * r.f) as dot
           from hv l join hv r using (site_id, x_bin, y_bin)
           where l.direction = '{left}' and r.direction = '{right}' group by all),
sim as (
select l.site_id, l.hour as i, r.hour as j, {expr} as similarity
from norms l join norms r using (site_id)
left join dots d on d.site_id = l.site_id and d.i = l.hour and d.j = r.hour
where l.direction = '{left}' and r.direction = '{right}')
"""


COSINE = "coalesce(dot, 0) / sqrt(l.q * r.q)"
PEARSON = """(coalesce(dot, 0) - l.s * r.s / 5184) /
   sqrt((l.q - l.s * l.s / 5184) * (r.q - r.s * r.s / 5184))"""
EUCLID = "-sqrt(greatest(l.q + r.q - 2 * coalesce(dot, 0), 0))"
def _similar(spark, sf_dir, metric, left, right):
    v = hour_vectors(spark, sf_dir)
    a_side = v.filter(F.col("direction") == left)
    b_side = a_side if left == right else v.filter(F.col("direction") == right)
    return gr.similarity(a_side, b_side, ["site_id"], "hour", "flux_mag", metric)


def _full(sim_sql):
    return sim_sql + """
, grid as (select site_id, a.i::int as i, b.j::int as j
           from (select distinct site_id from sim), range(24) a(i), range(24) b(j))
select site_id, i, j, round(similarity + 1e-9, 6) + 0.0 as similarity from grid left join sim using (site_id, i, j)"""


@query("hour_similarity_cosine", _full(similarity_sql(COSINE, "away", "away")))
def hour_similarity_cosine(spark, sf_dir):
    s = _similar(spark, sf_dir, "cosine", "away", "away")
    return rounded(gr.full_matrix(s, ["site_id"], 24, "similarity"))


@query("hour_similarity_correlation", _full(similarity_sql(PEARSON, "toward", "toward")))
def hour_similarity_correlation(spark, sf_dir):
    s = _similar(spark, sf_dir, "correlation", "toward", "toward")
    return rounded(gr.full_matrix(s, ["site_id"], 24, "similarity"))


@query("away_toward_similarity_euclidean", _full(similarity_sql(EUCLID, "away", "toward")).replace(
    "round(similarity + 1e-9, 6)", "round(similarity, 4)"))
def away_toward_similarity_euclidean(spark, sf_dir):
    s = _similar(spark, sf_dir, "euclidean", "away", "toward")
    full = gr.full_matrix(s, ["site_id"], 24, "similarity")
    return full.withColumn("similarity", F.round("similarity", 4) + F.lit(0.0))


DAY_SIM = """
, dn as (select site_id, day, sum(flux_mag) as s, sum(flux_mag * flux_mag) as q from {src} group by all),
dd as (select l.site_id, l.day as i, r.day as j, sum(l.flux_mag * r.flux_mag) as dot
       from {src} l join {src} r using (site_id, x_bin, y_bin) group by all),
sim as (select l.site_id, l.day as i, r.day as j, coalesce(dot, 0) / sqrt(l.q * r.q) as similarity
        from dn l join dn r using (site_id) left join dd d on d.site_id = l.site_id and d.i = l.day and d.j = r.day)
"""


def day_similarity_frame(spark, sf_dir):
    return gr.day_similarity(gr.cumulative_flux(flux(spark, sf_dir)), ["site_id"], "flux_mag")


@query("day_similarity", FX + DAY_FLUX + DAY_SIM.format(src="day_flux") + """
select site_id, i, j, round(similarity + 1e-9, 6) + 0.0 as similarity from sim""")
def day_similarity(spark, sf_dir):
    return rounded(day_similarity_frame(spark, sf_dir))


@query("day_similarity_summary", FX + DAY_FLUX + DAY_SIM.format(src="day_flux") + f"""
, s as (select site_id, min(similarity) as lowest, quantile_cont(similarity, 0.5) as median, max(similarity) as highest,
               avg(similarity) as average from sim where i <> j group by all)
select site_id, {r('lowest', 'median', 'highest', 'average')} from s""")
def day_similarity_summary(spark, sf_dir):
    return rounded(gr.off_diagonal_summary(day_similarity_frame(spark, sf_dir), ["site_id"]))


@query("day_similarity_shuffled", FX + DAY_FLUX + """
, grid as (select site_id, day, x::int as x_bin, y::int as y_bin from (select distinct site_id, day from day_flux),
           range(96) a(x), range(54) b(y)),
cells as (select *, row_number() over (partition by site_id, day order by
            md5(site_id || '|' || day || '|' || x_bin || '|' || y_bin), x_bin, y_bin) as k from grid),
filled as (select site_id, day, flux_mag, row_number() over (partition by site_id, day order by x_bin, y_bin) as k
           from day_flux),
sh as (select site_id, day, x_bin, y_bin, flux_mag from cells join filled using (site_id, day, k))
""" + DAY_SIM.format(src="sh") + """
select site_id, i, j, round(similarity + 1e-9, 6) + 0.0 as similarity from sim""")
def day_similarity_shuffled(spark, sf_dir):
    days = cut_lineage(gr.cumulative_flux(flux(spark, sf_dir)))
    return rounded(gr.day_similarity(rs.shuffled_cells(days, ["site_id", "day"], "flux_mag"), ["site_id"], "flux_mag"))


DENSITY = """
, dens as (
  select video_id, least(floor(center_x / 5), 382)::int as x_bin, least(floor((1080 - center_y) / 5), 214)::int as y_bin,
         count(*) as n_rows
  from tracks where direction = 'toward' and center_x between 0 and 1915 and center_y between 5 and 1080 group by all),
thr as (select video_id, avg(n_rows) + 3 * stddev_pop(n_rows) as threshold from dens where n_rows > 1 group by all)
"""


@query("density_map", fx.with_ctes(fx.TRACKS) + DENSITY + "select * from dens")
def density_map(spark, sf_dir):
    return gr.density_cells(fx.tracks(spark, sf_dir))


@query("density_thresholds", fx.with_ctes(fx.TRACKS) + DENSITY + """
select video_id, round(threshold + 1e-9, 6) + 0.0 as threshold from thr""")
def density_thresholds(spark, sf_dir):
    return rounded(gr.density_thresholds(gr.density_cells(fx.tracks(spark, sf_dir))))


@query("shared_density_limit", fx.with_ctes(fx.TRACKS) + DENSITY + """
select ceil(avg(threshold))::bigint as "limit" from thr""")
def shared_density_limit(spark, sf_dir):
    return gr.shared_density_limit(gr.density_thresholds(gr.density_cells(fx.tracks(spark, sf_dir))))


HIST = """
corrected as (
  select *, case direction when 'away' then angle when 'toward' then (angle + 180) % 360 end as a from tracks),
bins as (
  select site_id, day, hour, direction, least(floor(a / 30), 11)::int as bin, count(*) as n
  from corrected where a between 0 and 360 group by all),
one as (select site_id, day, hour, direction, bin, n / sum(n) over (partition by site_id, day, hour, direction) as share
        from bins),
both_bins as (select site_id, day, hour, bin, sum(n) as n from bins group by all),
both_shares as (select site_id, day, hour, bin, n / sum(n) over (partition by site_id, day, hour) as share from both_bins)
"""


@query("angle_histograms", fx.with_ctes(fx.TRACKS, HIST) + """
, slots as (select distinct site_id, day, hour from both_shares)
select s.site_id, s.day, s.hour, b::int as bin, round(coalesce(share, 0) + 1e-9, 6) + 0.0 as share
from slots s cross join range(12) t(b)
left join both_shares o on o.site_id = s.site_id and o.day = s.day and o.hour = s.hour and o.bin = b""")
def angle_histograms(spark, sf_dir):
    h = an.angle_histograms(fx.tracks(spark, sf_dir))
    return rounded(an.histogram_rows(h, "both"))


PAIR_DIST = """
, away as (select * from one where direction = 'away'), toward as (select * from one where direction = 'toward'),
slots as (select distinct site_id, day, hour from away semi join toward using (site_id, day, hour)),
dist as (
  select s.site_id, s.day, s.hour, sum(abs(coalesce(a.share, 0) - coalesce(t.share, 0))) as l1,
         sqrt(sum((coalesce(a.share, 0) - coalesce(t.share, 0)) ** 2)) as l2
  from slots s cross join range(12) b(b)
  left join away a on a.site_id = s.site_id and a.day = s.day and a.hour = s.hour and a.bin = b
  left join toward t on t.site_id = s.site_id and t.day = s.day and t.hour = s.hour and t.bin = b group by all)
"""


@query("direction_histogram_distances", fx.with_ctes(fx.TRACKS, HIST) + PAIR_DIST + f"""
select site_id, day, hour, {r('l1', 'l2')} from (select distinct site_id, day, hour from tracks)
left join dist using (site_id, day, hour)""")
def direction_histogram_distances(spark, sf_dir):
    return rounded(an.direction_distances(an.angle_histograms(fx.tracks(spark, sf_dir))))


@query("histogram_distance_by_hour", fx.with_ctes(fx.TRACKS, HIST) + PAIR_DIST + """
select t.site_id, t.hour, round(avg(l1) + 1e-9, 6) + 0.0 as l1, count(l1) as n_clips
from (select distinct site_id, day, hour from tracks) t left join dist using (site_id, day, hour) group by all""")
def histogram_distance_by_hour(spark, sf_dir):
    return rounded(an.mean_distance_by_hour(an.direction_distances(an.angle_histograms(fx.tracks(spark, sf_dir)))))


@query("hour_pair_distances", fx.with_ctes(fx.TRACKS, HIST) + """
, slots as (select distinct site_id, day, hour from both_shares),
full_h as (select s.site_id, s.day, s.hour, b as bin, coalesce(share, 0) as share from slots s cross join range(12) t(b)
           left join both_shares o on o.site_id = s.site_id and o.day = s.day and o.hour = s.hour and o.bin = b),
d as (select p.site_id, p.day, p.hour as i, q.hour as j, sum(abs(p.share - q.share)) as distance
      from full_h p join full_h q using (site_id, day, bin) group by all),
grid as (select site_id, day, i::int as i, j::int as j from (select distinct site_id, day from slots), range(24) a(i), range(24) b(j))
select site_id, day, i, j, round(coalesce(distance, 0) + 1e-9, 6) + 0.0 as distance from grid left join d using (site_id, day, i, j)""")
def hour_pair_distances(spark, sf_dir):
    d = an.hour_distances(an.angle_histograms(fx.tracks(spark, sf_dir)))
    return rounded(gr.full_matrix(d, ["site_id", "day"], 24, "distance", 0.0))


@query("angle_bins_over_time", fx.with_ctes(fx.TRACKS, HIST) + """
, slots as (select distinct site_id, day, hour from both_shares)
select s.site_id, b::int as bin, ((s.day - (select min(day) from tracks)) * 24 + s.hour)::int as column_index,
       round(coalesce(share, 0) + 1e-9, 6) + 0.0 as share
from slots s cross join range(12) t(b)
left join both_shares o on o.site_id = s.site_id and o.day = s.day and o.hour = s.hour and o.bin = b""")
def angle_bins_over_time(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    first = t.agg(F.min("day")).first()[0]
    h = an.histogram_rows(an.angle_histograms(t), "both")
    return rounded(h.select("site_id", "bin", (F.datediff("day", F.lit(first)) * 24 + F.col("hour"))
                            .alias("column_index"), "share"))


def boot_sql(source, group, columns, order="day"):
    """Resampled means of columns with the same md5 draws as operators.resampling."""
    keys = " || '|' || ".join(group)
    g = ", ".join(group)
    means = ", ".join(f"avg({c}) as {c}" for c in columns)
    return f"""
, vals as (select *, row_number() over (partition by {g} order by {order}) - 1 as pos from {source}),
sizes as (select {g}, count(*) as n from {source} group by all),
draws as (select {g}, b, ('0x' || substr(md5({keys} || '|' || b || '|' || i), 1, 8))::bigint % n as pos
          from (select {g}, n, b, unnest(range(n)) as i from sizes, range({B}) t(b))),
means as (select {g}, b, {means} from draws join vals using ({g}, pos) group by all)
"""


def ci(c):
    return (f"round(avg({c}) + 1e-9, 6) + 0.0 as {c}_mean, round(quantile_cont({c}, 0.025) + 1e-9, 6) + 0.0 as {c}_low, "
            f"round(quantile_cont({c}, 0.975) + 1e-9, 6) + 0.0 as {c}_high")


@query("hourly_rate_intervals", fx.with_ctes(fx.TRACKS, RATES)
       + boot_sql("rates", ["site_id", "hour"], ["away", "toward", "unknown", "total"]) + f"""
select site_id, hour, {ci('away')}, {ci('toward')}, {ci('unknown')}, {ci('total')} from means group by all""")
def hourly_rate_intervals(spark, sf_dir):
    v = a.direction_rates(fx.tracks(spark, sf_dir))
    return rounded(rs.bootstrap_intervals(v, ["site_id", "hour"], ["away", "toward", "unknown", "total"], ["day"], B))


DIFFS = ", diffs as (select *, away - toward as diff from rates)"
MEANS = """
means0 as (
  select site_id, day, hour, coalesce(avg(velocity) filter (direction = 'away'), 0) as away,
         coalesce(avg(velocity) filter (direction = 'toward'), 0) as toward
  from speeds group by all)
"""


def _diff(df):
    return df.withColumn("diff", F.col("away") - F.col("toward"))


@query("hourly_difference_intervals", fx.with_ctes(fx.TRACKS, RATES) + DIFFS
       + boot_sql("diffs", ["site_id", "hour"], ["diff"]) + f"""
select site_id, hour, {ci('diff')} from means group by all""")
def hourly_difference_intervals(spark, sf_dir):
    v = _diff(a.direction_rates(fx.tracks(spark, sf_dir)))
    return rounded(rs.bootstrap_intervals(v, ["site_id", "hour"], ["diff"], ["day"], B))


@query("bout_difference_intervals", fx.with_ctes(fx.TRACKS, RATES) + """
, diffs as (select *, (day(day) - 1) // 10 as bout, away - toward as diff from rates)"""
       + boot_sql("diffs", ["site_id", "bout"], ["diff"], "day, hour") + f"""
select site_id, bout::int as bout, {ci('diff')} from means group by all""")
def bout_difference_intervals(spark, sf_dir):
    v = _diff(a.direction_rates(fx.tracks(spark, sf_dir))).withColumn(
        "bout", F.floor((F.dayofmonth("day") - 1) / 10).cast("int"))
    return rounded(rs.bootstrap_intervals(v, ["site_id", "bout"], ["diff"], ["day", "hour"], B))


@query("speed_difference_intervals", fx.with_ctes(fx.TRACKS, fx.SPEEDS, MEANS) + """
, diffs as (select *, away - toward as diff from means0)""" + boot_sql("diffs", ["hour"], ["diff"], "day, site_id") + f"""
select hour, {ci('diff')} from means group by all""")
def speed_difference_intervals(spark, sf_dir):
    v = _diff(a.speed_means(speeds(spark, sf_dir)))
    return rounded(rs.bootstrap_intervals(v, ["hour"], ["diff"], ["day", "site_id"], B))


@query("hourly_tests", fx.with_ctes(fx.TRACKS, RATES) + """
, s as (select site_id, hour, count(*) as n, avg(away) - avg(toward) as d, var_samp(away) as va, var_samp(toward) as vb
        from rates group by all),
tt as (select site_id, hour, 2 * n - 2 as dof,
              case when va + vb > 0 then d / sqrt((va + vb) / 2 * (2.0::double / n)) end as t from s),
long as (select site_id, hour, 1 as is_a, away as x from rates union all select site_id, hour, 0, toward from rates),
ranks as (select *, rank() over (partition by site_id, hour order by x)
                 + (count(*) over (partition by site_id, hour, x) - 1) / 2 as rk from long),
tied as (select site_id, hour, sum(c * c * c - c) as ties from (
           select site_id, hour, x, count(*)::double as c from long group by all) group by all),
u as (select site_id, hour, sum(rk) filter (is_a = 1) - count(*) filter (is_a = 1) * (count(*) filter (is_a = 1) + 1) / 2 as u,
             count(*)::double as m from ranks group by all),
z as (select site_id, hour, u, (abs(u - m * m / 8) - 0.5) / nullif(sqrt(m * m / 48 * (m + 1 - ties / (m * (m - 1)))), 0) as z
      from u join tied using (site_id, hour)),
-- finite sum of Student's distribution for even degrees; error function by positive terms
p as (select *, abs(t) / sqrt(dof + t * t) as sine, dof / (dof + t * t) as c2, z / sqrt(2::double) as x
      from tt join z using (site_id, hour))
select site_id, hour, dof, round(t + 1e-9, 6) + 0.0 as t, round(u + 1e-9, 6) + 0.0 as u,
       round(case when dof >= 1 then greatest(0, 1 - sine * list_sum(list_transform(range(0, (dof // 2)::int),
         lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * c2 ** k))) end + 1e-9, 6) + 0.0 as t_p_value,
       round(case when z <= 0 then 1.0::double when z > 9 then 0 else greatest(0, 1 - list_sum(list_transform(range(0, 160),
         lambda k: exp((2 * k + 1) * ln(x) - lgamma(k + 1.5) - x * x)))) end + 1e-9, 6) + 0.0 as u_p_value from p""")
def hourly_tests(spark, sf_dir):
    v = a.direction_rates(fx.tracks(spark, sf_dir))
    t = st.two_sample_t(v, ["site_id", "hour"])
    u = st.mann_whitney_u(v, ["site_id", "hour"], block=F.floor(F.col("x") * 64))
    both = t.withColumn("t_p_value", st.student_p_value(F.col("t"), F.col("dof"))).join(
        u.withColumn("u_p_value", st.normal_p_value(F.col("z"))).drop("z"), ["site_id", "hour"])
    return rounded(both)


SERIES = """
, days as (select distinct site_id, day from tracks),
spine as (select site_id, day, h::int as hour from days, range(24) t(h)),
pairs as (select site_id, day, hour, coalesce(r.away - r.toward, 0) as count_diff,
                 coalesce(v.away - v.toward, 0) as speed_diff
          from spine left join rates r using (site_id, day, hour) left join means0 v using (site_id, day, hour)),
ranks as (select *, rank() over (partition by site_id, day order by round(count_diff, 9))
                 + (count(*) over (partition by site_id, day, round(count_diff, 9)) - 1) / 2 as rc,
                 rank() over (partition by site_id, day order by round(speed_diff, 9))
                 + (count(*) over (partition by site_id, day, round(speed_diff, 9)) - 1) / 2 as rv from pairs),
rho as (select site_id, day, case when min(rc) < max(rc) and min(rv) < max(rv) then corr(rv, rc) end as rho,
               avg(case when sign(count_diff) = sign(speed_diff) then 1.0::double else 0.0::double end) as agreement
        from ranks group by all)
"""


def day_pairs(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    counts = a.direction_rates(t).select(*a.SLOT, (F.col("away") - F.col("toward")).alias("count_diff"))
    sp = a.speed_means(k.speeds(t)).select(*a.SLOT, (F.col("away") - F.col("toward")).alias("speed_diff"))
    both = counts.join(sp, list(a.SLOT), "left")
    both = cut_lineage(both)
    return st.on_hours(both, both, columns=["count_diff", "speed_diff"])


def _spearman(pairs):
    exact = pairs.withColumns({"c": F.round("count_diff", 9), "v": F.round("speed_diff", 9)})
    return st.spearman(exact, ["site_id", "day"], "v", "c")


@query("speed_count_correlation", fx.with_ctes(fx.TRACKS, RATES, fx.SPEEDS, MEANS) + SERIES + f"""
select site_id, day, {r('rho')} from rho""")
def speed_count_correlation(spark, sf_dir):
    return rounded(_spearman(day_pairs(spark, sf_dir)))


@query("speed_count_correlation_interval", fx.with_ctes(fx.TRACKS, RATES, fx.SPEEDS, MEANS) + SERIES + """
, known as (select * from rho where rho is not null)""" + boot_sql("known", ["site_id"], ["rho"]) + f"""
select site_id, {ci('rho')}, round(avg((rho > 0)::int) + 1e-9, 6) + 0.0 as p_above,
       round(avg((rho < 0)::int) + 1e-9, 6) + 0.0 as p_below from means group by all""")
def speed_count_correlation_interval(spark, sf_dir):
    rho = _spearman(day_pairs(spark, sf_dir)).filter(F.col("rho").isNotNull())
    m = rs.bootstrap_means(rho, ["site_id"], ["rho"], ["day"], B)
    return rounded(rs.intervals(m, ["site_id"], ["rho"]).join(
        rs.shares_above_below(m, ["site_id"], "rho"), "site_id"))


@query("sign_agreement_interval", fx.with_ctes(fx.TRACKS, RATES, fx.SPEEDS, MEANS) + SERIES
       + boot_sql("rho", ["site_id"], ["agreement"]) + f"""
select site_id, {ci('agreement')}, round(avg((agreement > 0.5)::int) + 1e-9, 6) + 0.0 as p_above from means group by all""")
def sign_agreement_interval(spark, sf_dir):
    s = st.sign_agreement(day_pairs(spark, sf_dir), ["site_id", "day"], "count_diff", "speed_diff")
    m = rs.bootstrap_means(s, ["site_id"], ["agreement"], ["day"], B)
    return rounded(rs.intervals(m, ["site_id"], ["agreement"]).join(
        rs.shares_above_below(m, ["site_id"], "agreement", 0.5).drop("p_below"), "site_id"))


P = 1_000


def band_sql(permuted):
    def contrast(src, key):
        return f"""(select {key}, avg(similarity) filter (i = j) as diagonal,
          (avg(similarity) filter (abs(i - j) = 1) + avg(similarity) filter (abs(i - j) = 2)) / 2 as neighbours
          from {src} group by all)"""
    return similarity_sql(COSINE, "away", "away") + permuted + f"""
, obs as {contrast('sim', 'site_id')}, nul as {contrast('perm', 'site_id, p')}
select o.site_id, round(o.diagonal + 1e-9, 6) + 0.0 as diagonal, round(o.neighbours + 1e-9, 6) + 0.0 as neighbours,
       round(o.diagonal - o.neighbours + 1e-9, 6) + 0.0 as contrast,
       round(avg((n.diagonal - n.neighbours >= o.diagonal - o.neighbours)::int) + 1e-9, 6) + 0.0 as p_value, count(*) as n_null
from obs o join nul n using (site_id) group by all"""


def entries_sql(block):
    return f"""
, many as (select site_id, p, {block} as blk, i, j, similarity,
                  md5(site_id || '|' || p || '|' || i || '|' || j) as h from sim, range({P}) t(p)),
ranked as (select *, row_number() over (partition by site_id, p, blk order by i, j) as place,
                  row_number() over (partition by site_id, p, blk order by h, i, j) as draw from many),
perm as (select a.site_id, a.p, a.i, a.j, b.similarity from ranked a join ranked b
         on a.site_id = b.site_id and a.p = b.p and a.blk = b.blk and a.place = b.draw)
"""


NIGHT = "(case when i between 6 and 17 then 1 else 0 end) + (case when j between 6 and 17 then 1 else 0 end)"


@query("band_strength_columns", band_sql(f"""
, ord as (select site_id, p, j, row_number() over (partition by site_id, p order by
            md5(site_id || '|' || p || '|' || j), j) - 1 as nj
          from (select distinct site_id from sim), range({P}) t(p), range(24) c(j)),
perm as (select s.site_id, p, i, nj as j, similarity from sim s join ord using (site_id, j))"""))
def band_strength_columns(spark, sf_dir):
    s = cut_lineage(_similar(spark, sf_dir, "cosine", "away", "away"))
    return rounded(rs.band_strength(s, rs.permuted_columns(s, ["site_id"], 24, P), ["site_id"]))


@query("band_strength_entries", band_sql(entries_sql("0")))
def band_strength_entries(spark, sf_dir):
    s = cut_lineage(_similar(spark, sf_dir, "cosine", "away", "away"))
    return rounded(rs.band_strength(s, rs.permuted_entries(s, ["site_id"], F.lit(0), P), ["site_id"]))


@query("band_strength_day_night", band_sql(entries_sql(NIGHT)))
def band_strength_day_night(spark, sf_dir):
    s = cut_lineage(_similar(spark, sf_dir, "cosine", "away", "away"))
    day = [F.when(F.col(c).between(6, 17), 1).otherwise(0) for c in ("i", "j")]
    return rounded(rs.band_strength(s, rs.permuted_entries(s, ["site_id"], day[0] + day[1], P), ["site_id"]))
