"""Every query on the tables of the driver, with the SQL that states the same.

The events table is the stream: segment = user, signal = type. Its gaps are hours, so windows and lags are days here,
and levels are divided where an operator expects mmol/L.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelstream.functions.units import convert
from levelstream.operators import asof, averaged, calculated, dosing, fitting, matching, metrics, models, populations, routing, rumours, scores, segment_fits, windows
from levelstream.operators import events as E
from levelstream.plans import chain
from levelstream.sources import device_files, log_source, logs, signals
from levelstream.streaming import stateful

FLAGSHIP = "signal_error"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}

DAY_US = 86_400_000_000
EVENTS = "(select user_id as segment_id, event_type as signal_id, ts as device_time, value as level, event_id as seq from events)"


def signal_sql(name: str) -> str:
    return f"(select user_id as segment_id, ts as device_time, max_by(value, event_id) as level, max(event_id) as seq from events where event_type = '{name}' group by 1, 2)"


def asked_sql(name: str, value: str = "expected", shift: float = 0.0) -> str:
    moved = f"ts + to_microseconds({round(shift * DAY_US)})" if shift else "ts"
    return f"(select user_id as segment_id, {moved} as device_time, event_id as seq, value as {value} from events where event_type = '{name}')"


def line_sql(asked: str, knots: str, name: str, shift: float = 0.0) -> str:
    """``asked`` with the line interpolation of ``knots`` and its slope, at times ``shift`` days later."""
    at = f"q.device_time + to_microseconds({round(shift * DAY_US)})" if shift else "q.device_time"
    gap = "(epoch_us(y.device_time) - epoch_us(x.device_time))"
    return f"""(select q.*, case when x.device_time = y.device_time then x.level when x.device_time is not null and y.device_time is not null
      then x.level + (epoch_us({at}) - epoch_us(x.device_time)) * ((y.level - x.level) / {gap}) end as {name},
      case when x.device_time < y.device_time then (y.level - x.level) / {gap} * 86400e6 end as {name}_slope
      from {asked} q asof left join {knots} x on q.segment_id = x.segment_id and {at} >= x.device_time
      asof left join {knots} y on q.segment_id = y.segment_id and {at} <= y.device_time)"""


PAIRS = f"(select segment_id, device_time, seq, expected, calculated from {line_sql(asked_sql('view'), signal_sql('click'), 'calculated')} where calculated is not null)"


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _pairs(spark, d) -> DataFrame:
    return scores.pairs(E.read_events(spark, d), "view", "click")


def _click(spark, d) -> DataFrame:
    return E.last_written(E.signal(E.read_events(spark, d), "click"))


def _asked(spark, d, name: str = "view", value: str = "expected") -> DataFrame:
    return E.signal(E.read_events(spark, d), name).withColumnRenamed("level", value)


# --- scored signals


@query(f"""select segment_id, count(*) as n, avg(abs(expected - calculated)) as avg_abs, max(abs(expected - calculated)) as max_abs, sqrt(avg((expected - calculated) ^ 2)) as rmse
  from {PAIRS} group by rollup(segment_id)""")
def signal_error(spark, d):
    gap = F.col("expected") - F.col("calculated")
    return _pairs(spark, d).rollup("segment_id").agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("avg_abs"), F.max(F.abs(gap)).alias("max_abs"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


@query(f"""select segment_id, count(*) as n, avg(d) as avg_abs, max(d) as max_abs, count(*) filter (where d > 0.95)::double as over_threshold, sqrt(avg(d)) as root_mean,
  case when avg(d * d) > 0 then count(*) * ln(avg(d * d)) end as aic, avg(case when calculated + 95 < expected then d * (1 + d) else d end) as exp_weighted
  from (select *, abs(expected - calculated) as d from {PAIRS}) group by segment_id""")
def metrics_simple(spark, d):
    return metrics.simple(_pairs(spark, d), ["segment_id"], metrics.Options())


@query(f"""select segment_id, count(*) as n, avg(d) as avg_abs, max(d) as max_abs, count(*) filter (where d > 0.5)::double as over_threshold, sqrt(avg(d)) as root_mean,
  case when avg(d * d) > 0 then count(*) * ln(avg(d * d)) end as aic, avg(case when calculated + 50 < expected then d * (1 + d) else d end) as exp_weighted
  from (select *, case when expected <> 0 then abs(expected - calculated) / abs(expected) else 1000 end ^ 2 as d from {PAIRS}) group by segment_id""")
def metrics_relative_squared(spark, d):
    return metrics.simple(_pairs(spark, d), ["segment_id"], metrics.Options(relative=True, squared=True, threshold=50.0))


@query(f"""select segment_id, case when var_pop(expected) > 0 then sum(abs(expected - calculated) ^ 4) / (var_pop(expected) * count(*)) end as leal from {PAIRS} group by segment_id""")
def metric_leal(spark, d):
    return metrics.leal(_pairs(spark, d), ["segment_id"], metrics.Options())


@query(f"""with a as (select segment_id, abs(expected - calculated) as d from {PAIRS}),
  b as (select *, row_number() over (partition by segment_id order by d) - 1 as i, count(*) over (partition by segment_id) as n, lag(d) over (partition by segment_id order by d) as p from a),
  c as (select segment_id, any_value(n) as n, sum(d) filter (where i >= floor(n * 0.1) and i < ceil(n - n * 0.1)) as s, sum(d * d) filter (where i >= floor(n * 0.1) and i < ceil(n - n * 0.1)) as ss,
    count(*) filter (where i >= floor(n * 0.1) and i < ceil(n - n * 0.1)) as m, sum((p + d) / 2) filter (where i > floor(n * 0.1) and i < ceil(n - n * 0.1)) as area,
    max(d) filter (where i = case when floor(n * 0.1 + 0.5) > 0 then least(floor(n * 0.1 + 0.5), n - 1) - (case when least(floor(n * 0.1 + 0.5), n - 1) > 0 then 1 else 0 end) else 0 end) as percentile from b group by segment_id),
  e as (select *, case when n > 1.5 then n - 1.5 + 1 / (8.0 * (n - 1)) else n end as div from c),
  f as (select *, coalesce(s, 0) / div as mean, greatest(0.0, (coalesce(ss, 0) - 2 * coalesce(s, 0) / div * coalesce(s, 0) + m * (coalesce(s, 0) / div) ^ 2) / div) as variance from e)
  select segment_id, percentile, variance, sqrt(variance) as std_dev, mean + sqrt(variance) as avg_plus_sd, case when mean > 0 and variance > 0 then ln(mean) + ln(sqrt(variance)) end as avg_pow_sd,
    case when m > 0 then coalesce(area, 0) / (n * n) end as integral_cdf from f""")
def metrics_ordered(spark, d):
    return metrics.ordered(_pairs(spark, d), ["segment_id"], metrics.Options(threshold=10.0))


@query(f"""with a as (select segment_id, expected, calculated, lag(expected) over w as e0, lag(calculated) over w as c0, (epoch_us(device_time) - lag(epoch_us(device_time)) over w) / 86400e6 as dt from {PAIRS} window w as (partition by segment_id order by device_time, seq))
  select segment_id, abs(coalesce(sum(sqrt(dt * dt + (calculated - e0) ^ 2) + sqrt(dt * dt + (expected - c0) ^ 2) - sqrt(dt * dt + (expected - e0) ^ 2)), 0)) / count(*) as crosswalk from a group by segment_id""")
def metric_crosswalk(spark, d):
    return metrics.crosswalk(_pairs(spark, d), ["segment_id"], metrics.Options())


@query(f"""select segment_id, device_time, seq, avg(abs(expected - calculated)) over (partition by segment_id order by device_time, seq rows unbounded preceding) as metric from {PAIRS}""")
def metric_running(spark, d):
    return metrics.running_average(_pairs(spark, d), ["segment_id"])


@query(f"""with a as (select *, epoch_us(device_time) as t from {EVENTS} where signal_id in ('view', 'click')),
  b as (select *, coalesce((level - lag(level) over w) / ((t - lag(t) over w)), 0) as slope from a window w as (partition by segment_id, signal_id order by device_time, seq)),
  c as (select segment_id, device_time, seq, t, last_value(case when signal_id = 'view' then {{'t': t, 'level': level, 'slope': slope}} end ignore nulls) over w as r,
    last_value(case when signal_id = 'click' then {{'t': t, 'level': level, 'slope': slope}} end ignore nulls) over w as e from b window w as (partition by segment_id order by device_time, seq rows unbounded preceding))
  select segment_id, device_time, seq, avg(abs(r.level + r.slope * (t - r.t) - e.level - e.slope * (t - e.t))) over (partition by segment_id order by device_time, seq rows unbounded preceding) as metric
  from c where r is not null and e is not null""")
def online_error(spark, d):
    return scores.online_error(E.read_events(spark, d), "view", "click")


# --- interpolation


@query(f"select segment_id, device_time, seq, expected, value from {line_sql(asked_sql('view'), signal_sql('click'), 'value')}")
def line_value(spark, d):
    return asof.interpolate(_asked(spark, d), _click(spark, d))


@query(f"select segment_id, device_time, seq, expected, value_slope as slope from {line_sql(asked_sql('view'), signal_sql('click'), 'value')}")
def line_slope(spark, d):
    return models.at(_asked(spark, d), _click(spark, d), 0.0, "slope", slope=True)


@query(f"""with k as (select segment_id, epoch_us(device_time)::double as t, level as y, device_time from {signal_sql('click')}),
  n as (select *, row_number() over w as i, count(*) over (partition by segment_id) as n, {', '.join(f"lag({c}, {o}) over w as {c}m{o}, lead({c}, {o}) over w as {c}p{o}" for c in 'ty' for o in (1, 2, 3))} from k window w as (partition by segment_id order by device_time)),
  p as (select *, (ym1 - ym2) / (tm1 - tm2) as d1, (y - ym1) / (t - tm1) as d2, (yp1 - y) / (tp1 - t) as d3, (yp2 - yp1) / (tp2 - tp1) as d4 from n),
  s as (select segment_id, device_time, t, y, case when n < 5 then null
    when i = 1 then y * (2 * t - tp1 - tp2) / ((t - tp1) * (t - tp2)) + yp1 * (2 * t - t - tp2) / ((tp1 - t) * (tp1 - tp2)) + yp2 * (2 * t - t - tp1) / ((tp2 - t) * (tp2 - tp1))
    when i = n then ym2 * (2 * t - tm1 - t) / ((tm2 - tm1) * (tm2 - t)) + ym1 * (2 * t - tm2 - t) / ((tm1 - tm2) * (tm1 - t)) + y * (2 * t - tm2 - tm1) / ((t - tm2) * (t - tm1))
    when i = 2 or i = n - 1 then ym1 * (2 * t - t - tp1) / ((tm1 - t) * (tm1 - tp1)) + y * (2 * t - tm1 - tp1) / ((t - tm1) * (t - tp1)) + yp1 * (2 * t - tm1 - t) / ((tp1 - tm1) * (tp1 - t))
    when abs(d1 - d2) + abs(d3 - d4) > 0 then (abs(d3 - d4) * d2 + abs(d1 - d2) * d3) / (abs(d1 - d2) + abs(d3 - d4))
    else ((tp1 - t) * d2 + (t - tm1) * d3) / (tp1 - tm1) end as f from p),
  q as (select a.*, x.t as t0, x.y as y0, x.f as f0, z.t as t1, z.y as y1, z.f as f1, epoch_us(a.device_time) - x.t as u, z.t - x.t as w from {asked_sql('view')} a
    asof left join s x on a.segment_id = x.segment_id and a.device_time >= x.device_time asof left join s z on a.segment_id = z.segment_id and a.device_time <= z.device_time)
  select segment_id, device_time, seq, expected, case when f0 is null or f1 is null then null when w = 0 then y0
    else y0 + u * (f0 + u * ((3 * (y1 - y0) / w - 2 * f0 - f1) / w + u * (f0 + f1 - 2 * (y1 - y0) / w) / (w * w))) end as value from q""")
def akima_value(spark, d):
    return asof.akima(_asked(spark, d), _click(spark, d))


# --- routing


_MASK = "11011110"


@query(f"select seq, case when signal_id = 'click' then 'tap' else signal_id end as signal_id, level from {EVENTS} where signal_id <> 'error'")
def map_and_drop(spark, d):
    return routing.map_signal(routing.map_signal(E.read_events(spark, d), "click", "tap"), "error", None).select("seq", "signal_id", "level")


@query(f"select seq, case when signal_id = 'click' and ((level * 2 + 1 > 200) <> (level < 300)) then 'odd' else signal_id end as signal_id from {EVENTS}")
def decouple_move(spark, d):
    return routing.decouple(E.read_events(spark, d), "click", "odd", "(is_level_event && level * 2 + 1 > 200) ^ (level < 300)").select("seq", "signal_id")


@query(f"select seq, signal_id, level from {EVENTS} union all select seq, 'large', level from {EVENTS} where level >= 250")
def decouple_copy(spark, d):
    return routing.decouple(E.read_events(spark, d), None, "large", "is_level_event && !(level < 250)", copy=True).select("seq", "signal_id", "level")


@query(f"select seq, signal_id, level from {EVENTS} where not (signal_id = 'view' and (level <= 10 or level != level or level >= 400))")
def decouple_drop(spark, d):
    return routing.decouple(E.read_events(spark, d), "view", None, "level <= 10 || level >= 400 || is_info_event").select("seq", "signal_id", "level")


@query(f"""select seq, signal_id, case when signal_id = 'click' and substr('{_MASK}', ((row_number() over (partition by segment_id, signal_id order by device_time, seq) - 1) % 8)::int + 1, 1) = '0' then 'Masked_Level' else 'Level' end as event_code from {EVENTS}""")
def mask_levels(spark, d):
    return routing.mask(E.read_events(spark, d), "click", _MASK).select("seq", "signal_id", "event_code")


@query(f"select seq, signal_id, 'Level' as event_code from {EVENTS}")
def unmask_levels(spark, d):
    return routing.unmask(routing.mask(E.read_events(spark, d), "click", _MASK), "click").select("seq", "signal_id", "event_code")


@query(f"""select seq, signal_id, case when signal_id = 'click' then level + (('0x' || substr(md5('1/' || segment_id || '/' || seq), 1, 12))::bigint / 281474976710656.0 * 2 - 1) * 2.0 else level end as level from {EVENTS}""")
def noise(spark, d):
    return routing.add_noise(E.read_events(spark, d), "click", 2.0).select("seq", "signal_id", "level")


@query(f"select seq, level from (select *, lag(level) over (partition by segment_id, signal_id order by device_time, seq) as b from (select segment_id, signal_id, device_time, seq, floor(level / 100) as level from {EVENTS})) where b is null or b <> level")
def drop_repeats(spark, d):
    return routing.drop_repeats(E.read_events(spark, d).withColumn("level", F.floor(F.col("level") / 100).cast("double"))).select("seq", "level")


@query(f"select seq, signal_id, level from {EVENTS} union all select seq, 'bolus', level * 0.0667 from {EVENTS} where signal_id = 'purchase'")
def boluses_of_carbs(spark, d):
    return routing.boluses_of_carbs(E.read_events(spark, d), "purchase", "bolus", 0.0667).select("seq", "signal_id", "level")


_CHAIN = """
[01 map]
source = signup
to = basal

[02 decouple]
source = basal
to = fast
when = level > $(LIMIT)

[03 mean_response]
signal = fast
seconds = 432000.0
"""


@query(f"select seq, avg(level) over (partition by segment_id order by epoch_us(device_time) range between {5 * DAY_US} preceding and current row) as level from {EVENTS} where signal_id = 'signup' and level > 100")
def configured_chain(spark, d):
    return chain.apply(E.read_events(spark, d), _CHAIN, {"LIMIT": "100"}).select("seq", "level")


# --- windows


@query(f"select seq, avg(level) over (partition by segment_id order by device_time range between interval 3 day preceding and current row) as level from {EVENTS} where signal_id = 'click'")
def mean_response(spark, d):
    return windows.mean_response(E.read_events(spark, d), "click", 3 * E.DAY).select("seq", "level")


@query(f"select seq, avg(level) over (partition by segment_id order by device_time, seq rows unbounded preceding) as level from {EVENTS} where signal_id = 'click'")
def mean_response_of_all(spark, d):
    return windows.mean_response(E.read_events(spark, d), "click", None).select("seq", "level")


@query(f"select seq, median(level) over (partition by segment_id order by device_time range between interval 3 day preceding and current row) as level from {EVENTS} where signal_id = 'click'")
def median_response(spark, d):
    return windows.median_response(E.read_events(spark, d), "click", 3 * E.DAY).select("seq", "level")


_PERIODS = f"(select segment_id, signal_id, seq, (epoch_us(device_time) - lag(epoch_us(device_time)) over (partition by segment_id, signal_id order by device_time, seq)) / 86400e6 as period from {EVENTS})"


@query(f"select seq, period from {_PERIODS} where period is not null")
def periods(spark, d):
    return windows.periods(E.read_events(spark, d)).select("seq", "period")


_RUNS = f"""(with a as (select *, epoch_us(device_time) as t, level > 100 as hit from {EVENTS} where signal_id = 'click'),
  b as (select *, lag(t) over w as p, lead(t) over w as f, case when hit <> coalesce(lag(hit) over w, false) then 1 else 0 end as new from a window w as (partition by segment_id order by device_time, seq)),
  c as (select *, sum(new) over (partition by segment_id order by device_time, seq rows unbounded preceding) as run from b)
  select segment_id, min(device_time) as first_time, max(device_time) as last_time, count(*) as n_levels, (max(t + f) / 2 - min(coalesce((p + t) / 2, t))) / 86400e6 as duration
  from c where hit group by segment_id, run having count(f) = count(*))"""


@query(f"select * from {_RUNS}")
def episodes(spark, d):
    return windows.episodes(E.read_events(spark, d), "click", "level > 100")


@query(f"""select a.segment_id, evaluated, matched, coalesce(episodes, 0) as episodes, avg_levels, avg_duration, max_duration
  from (select segment_id, count(*) as evaluated, count(*) filter (where level > 100) as matched from {EVENTS} where signal_id = 'click' group by 1) a
  left join (select segment_id, count(*) as episodes, avg(n_levels) as avg_levels, avg(duration) as avg_duration, max(duration) as max_duration from {_RUNS} group by 1) b on a.segment_id = b.segment_id""")
def decoupling_stats(spark, d):
    return scores.decoupling_stats(E.read_events(spark, d), "click", "level > 100")


@query(f"""with a as (select *, epoch_us(device_time) as t, last_value(case when signal_id = 'click' then epoch_us(device_time) end ignore nulls) over (partition by segment_id order by device_time, seq rows between unbounded preceding and 1 preceding) as l from {EVENTS}),
  b as (select *, case when t > l + {2 * DAY_US} then 1 else 0 end as late from a),
  c as (select *, case when late = 1 and lag(late) over w = 1 and lag(signal_id) over w <> 'click' then 0 else late end as broken from b window w as (partition by segment_id order by device_time, seq)),
  e as (select *, sum(broken) over (partition by segment_id order by device_time, seq rows unbounded preceding)::bigint as part from c),
  f as (select *, count(*) filter (where signal_id = 'click') over (partition by segment_id, part) as n, count(*) filter (where signal_id = 'purchase') over (partition by segment_id, part) as m from e)
  select segment_id, seq, part from f where n >= 3 and m > 0""")
def cut_segments(spark, d):
    return windows.cut_segments(E.read_events(spark, d), "click", 2 * E.DAY, 3, "purchase").select("segment_id", "seq", "part")


@query(f"""with a as (select 'Level' as event_code, segment_id, device_time, seq from {EVENTS} union all select 'Time_Segment_Start', segment_id, min(device_time), null from {EVENTS} group by 2
  union all select 'Time_Segment_Stop', segment_id, max(device_time), null from {EVENTS} group by 2)
  select event_code, segment_id, device_time, seq, row_number() over (partition by segment_id order by device_time, case event_code when 'Time_Segment_Start' then 0 when 'Level' then 1 else 2 end, seq) as place from a""")
def replayed(spark, d):
    return windows.replay(E.read_events(spark, d)).select("event_code", "segment_id", "device_time", "seq", F.col("place").cast("long").alias("place"))


@query(f"""with i as (select segment_id, device_time as start, device_time + interval 6 hour as stop, level, lead(device_time) over (partition by segment_id order by device_time) as nx from {EVENTS} where signal_id = 'purchase')
  select segment_id, start as device_time, level, 'temporary' as origin from i
  union all select i.segment_id, stop, b.level, 'base' from i asof join {signal_sql('view')} b on i.segment_id = b.segment_id and i.stop >= b.device_time where nx is null or nx > stop""")
def interval_levels(spark, d):
    e = E.read_events(spark, d)
    spans = E.signal(e, "purchase").select("segment_id", F.col("device_time").alias("start"), E.moved(F.col("device_time"), 6 * 3600.0).alias("stop"), "level")
    return windows.intervals_to_levels(spans, E.last_written(E.signal(e, "view")))


def _fast_sql(relative: bool) -> str:
    """Distances of click and view levels, each from the other's last level carried on."""
    d = "abs((level - there) / nullif(case when is_ref then level else there end, 0))" if relative else "abs(level - there)"
    return f"""(with a as (select *, epoch_us(device_time) as t from {EVENTS} where signal_id in ('view', 'click')),
      b as (select *, case when t > lag(t) over w then (level - lag(level) over w) / (t - lag(t) over w) end as s from a window w as (partition by segment_id, signal_id order by device_time, seq)),
      c as (select *, last_value(s ignore nulls) over (partition by segment_id, signal_id order by device_time, seq rows unbounded preceding) as slope from b),
      e as (select *, signal_id = 'view' as is_ref, {', '.join(f"last_value(case when signal_id = '{n}' then {{'t': t, 'level': level, 'slope': slope}} end ignore nulls) over (partition by segment_id order by device_time, seq rows unbounded preceding) as {n}_" for n in ('view', 'click'))} from c),
      f as (select *, case when is_ref then click_ else view_ end as o from e),
      g as (select *, o.level + o.slope * (t - o.t) as there from f where o.slope is not null and t > o.t)
      select segment_id, device_time, seq, {d} as d from g where {d} is not null)"""


@query(f"select * from {_fast_sql(True)}")
def fast_errors(spark, d):
    return scores.fast_errors(E.read_events(spark, d), "view", "click", relative=True)


@query(f"""with a as (select d, row_number() over (order by device_time, seq) as n, sum(d) over (order by device_time, seq rows unbounded preceding) as total from {_fast_sql(False)}),
  b as (select *, case when n > 1.5 then n - 1.5 + 1 / (8.0 * (n - 1)) else 1 end as divisor from a), c as (select *, d - total / divisor as delta from b)
  select count(*) as n, sum(d) / count(*) as avg, max_by(total / divisor, n) + sqrt(sum(delta * delta * (n - 1) / n) / max(divisor)) as avg_plus_sd from c""")
def fast_error_total(spark, d):
    return scores.fast_error_total(scores.fast_errors(E.read_events(spark, d), "view", "click"))


# --- statistics

_STATS = "count({c}) as n, avg({c}) as avg, stddev_pop({c}) as sd, (avg({c} ^ 3) - 3 * avg({c}) * avg({c} ^ 2) + 2 * avg({c}) ^ 3) / stddev_pop({c}) ^ 3 as skewness, kurtosis_pop({c}) as kurtosis, min({c}) as least, quantile_cont({c}, 0.25) as p25, median({c}) as median, quantile_cont({c}, 0.75) as p75, quantile_cont({c}, 0.95) as p95, quantile_cont({c}, 0.99) as p99, max({c}) as most"


@query(f"select segment_id, {_STATS.format(c='level')} from {EVENTS} where signal_id = 'click' group by rollup(segment_id)")
def signal_stats(spark, d):
    return scores.signal_stats(E.read_events(spark, d), "click")


@query(f"select segment_id, {_STATS.format(c='period')} from {_PERIODS} where signal_id = 'click' and period is not null group by rollup(segment_id)")
def period_stats(spark, d):
    return scores.period_stats(E.read_events(spark, d), "click")


@query(f"""with a as (select segment_id, abs(expected - calculated) as error, 'absolute' as kind from {PAIRS}
    union all select segment_id, case when expected <> 0 then abs(expected - calculated) / expected when expected = calculated then 0 end, 'relative' from {PAIRS})
  select segment_id, kind, {_STATS.format(c='error')} from a group by grouping sets ((segment_id, kind), (kind))""")
def signal_error_stats(spark, d):
    return scores.signal_error_stats(_pairs(spark, d))


@query(f"""with a as (select segment_id, abs(expected - calculated) as error, 0 as g from {PAIRS}), b as (select * from a union all select null, error, 1 from a),
  c as (select g, segment_id, error, count(*) as c from b group by all)
  select segment_id, error, (sum(c) over (partition by g, segment_id order by error))::bigint as at_most, sum(c) over (partition by g, segment_id order by error) / sum(c) over (partition by g, segment_id) as p from c""")
def error_distribution(spark, d):
    return scores.error_distribution(_pairs(spark, d))


@query(f"select segment_id, max(device_time) as device_time, count(*) as n, sqrt(avg((expected - calculated) ^ 2)) as metric from {PAIRS} group by rollup(segment_id)")
def chosen_metric(spark, d):
    gap = F.col("expected") - F.col("calculated")
    return scores.chosen_metric(_pairs(spark, d), F.sqrt(F.avg(gap * gap)))


def _inside_sql(corners, x: str, y: str) -> str:
    edges = [f"(case when ({y1}.0 > {y}) <> ({y2}.0 > {y}) and {x} < ({y} - {y1}) * {(x2 - x1) / (y2 - y1)!r} + {x1} then 1 else 0 end)" for (x1, y1), (x2, y2) in zip(corners, (*corners[1:], corners[0]), strict=True) if y1 != y2]
    return f"(({' + '.join(edges)}) % 2 = 1)"


def _grid_sql(grid: str) -> str:
    cases = " ".join(f"when {_inside_sql(c, 'x', 'y')} then '{z}'" for z, c in scores.GRIDS[grid])
    return f"""with a as (select segment_id, expected / 18.0 * {scores.MGDL} as x, calculated / 18.0 * {scores.MGDL} as y from {PAIRS}), z as (select segment_id, case {cases} end as zone from a),
      s as (select segment_id, count(*) as n, {', '.join(f"count(*) filter (where zone = '{k.upper()}') / count(*) as {k}" for k in 'bcde')} from z group by rollup(segment_id))
      select segment_id, n, 1 - (b + c + d + e) as a, b, c, d, e, 1 - (b + c + d + e) + b as a_and_b from s"""


def _grid(spark, d, grid: str) -> DataFrame:
    rows = _pairs(spark, d).withColumns({"expected": F.col("expected") / 18.0, "calculated": F.col("calculated") / 18.0})
    return scores.grid_shares(rows, grid)


@query(_grid_sql("clarke"))
def clarke_grid(spark, d):
    return _grid(spark, d, "clarke")


@query(_grid_sql("parkes_1"))
def parkes_grid_1(spark, d):
    return _grid(spark, d, "parkes_1")


@query(_grid_sql("parkes_2"))
def parkes_grid_2(spark, d):
    return _grid(spark, d, "parkes_2")


@query(f"""with a as (select *, abs(expected - calculated) / expected as error from {PAIRS} where expected <> 0)
  select segment_id, device_time, error, case when error > 0 then ln(error) / ln(1000.0) + 1 end as x, (row_number() over (partition by segment_id order by error) - 1) / count(*) over (partition by segment_id) as p from a where error < 1""")
def error_ecdf(spark, d):
    return scores.error_ecdf(_pairs(spark, d))


def _quartile_sql(p: float) -> str:
    return f"(max(level) filter (where i = least(floor(n * {p}), n - 1)) + max(level) filter (where i = least(ceil(n * {p}), n - 1))) / 2"


@query(f"""with a as (select level, seq, ((hour(device_time) * 60 + minute(device_time)) // 5)::int as bin from {EVENTS} where signal_id = 'click'),
  b as (select *, row_number() over (partition by bin order by level, seq) - 1 as i, count(*) over (partition by bin) as n from a)
  select bin, any_value(n) as n, min(level) as least, {_quartile_sql(0.25)} as q1, {_quartile_sql(0.5)} as median, {_quartile_sql(0.75)} as q3, max(level) as most from b group by bin""")
def day_profile(spark, d):
    return scores.day_profile(E.read_events(spark, d), "click")


@query(f"""select segment_id, case when level * 0.05 < 3.8 then 'below' when level * 0.05 > 10.8 then 'high' when level * 0.05 > 7.0 then 'elevated' else 'in_range' end as range_class, count(*) as n from {EVENTS} where signal_id = 'click' group by 1, 2""")
def range_classes(spark, d):
    return scores.range_classes(E.read_events(spark, d), "click", 0.05)


@query(f"""with a as (select segment_id, greatest(2.8, least(6.1, min(level) * 0.05)) as low, greatest(6.1, least(22.2, max(level) * 0.05)) as high from {EVENTS} where signal_id = 'click' group by 1)
  select *, ['A', 'lower B', 'lower C', 'upper B', 'B', 'lower D', 'upper C', 'upper D', 'E'][(case when high < 10 then 0 when high < 16.7 then 1 else 2 end) * 3 + (case when low > 5 then 0 when low > 3.9 then 1 else 2 end) + 1] as cell from a""")
def variability_grid(spark, d):
    return scores.variability_grid(E.read_events(spark, d), "click", 0.05)


# --- models

_P = models.Diffusion()


def _small(spark, d, name: str = "click") -> DataFrame:
    return E.last_written(E.signal(E.read_events(spark, d), name)).withColumn("level", F.col("level") / 18.0)


def _small_sql(name: str = "click") -> str:
    return f"(select segment_id, device_time, level / 18.0 as level, seq from {signal_sql(name)})"


def _blood_sql(p, present: str, future: str, clamp: bool) -> str:
    disc = f"(({p.p} - ({p.cg}) * {present}) ^ 2 - 4 * ({p.cg}) * ({p.c} - {future}))"
    root = f"sqrt(greatest({disc}, 0))" if clamp else f"case when {disc} >= 0 then sqrt(greatest({disc}, 0)) end"
    return f"(({root}) - ({p.p} - ({p.cg}) * {present})) / (2 * ({p.cg}))"


_FIXED = models.Diffusion(k=0.0, h=0.0)
_NOW = line_sql(asked_sql("view"), _small_sql(), "present")


def _later_sql(asked: str, knots: str, name: str, days: str) -> str:
    """``asked`` with the level of ``knots`` a number of days later that is an expression over its columns."""
    moved = f"(select *, device_time as shown_at from {asked})"
    moved = f"(select * exclude (device_time), shown_at + to_microseconds(round(({days}) * 86400e6)::bigint) as device_time from {moved})"
    return f"(select * exclude (device_time, shown_at, {name}_slope), shown_at as device_time from {line_sql(moved, knots, name)})"


@query(f"select segment_id, device_time, seq, {_blood_sql(_P, 'present', 'future', False)} as value from {line_sql(_NOW, _small_sql(), 'future', _P.dt)}")
def diffusion_blood_fixed(spark, d):
    return models.diffusion_blood(_asked(spark, d), _small(spark, d), _FIXED).select("segment_id", "device_time", "seq", "value")


@query(f"""select segment_id, device_time, seq, {_P.p} * b + ({_P.cg}) * b * (b - present) + ({_P.c}) as value from {line_sql(line_sql(asked_sql('view'), _small_sql(), 'present', -_P.dt), _small_sql('purchase'), 'b', -_P.dt)}""")
def diffusion_interstitial_fixed(spark, d):
    return models.diffusion_interstitial(_asked(spark, d), _small(spark, d), _small(spark, d, "purchase"), _FIXED).select("segment_id", "device_time", "seq", "value")


@query(f"""select segment_id, device_time, seq, {_blood_sql(_P, 'present', 'future', False)} as value
  from {_later_sql(line_sql(_NOW, _small_sql(), 'back', -_P.h), _small_sql(), 'future', f'{_P.dt} + ({_P.k}) * present * (present - back) / {_P.h}')}""")
def diffusion_blood(spark, d):
    return models.diffusion_blood(_asked(spark, d), _small(spark, d)).select("segment_id", "device_time", "seq", "value")


def _lag_sql(asked: str, offsets: str, columns: str = "q.*") -> str:
    """(segment_id, device_time, seq, off): of the offsets the one at which the lag ends nearest to the time asked."""
    tried = f"(select {columns}, unnest({offsets}) as tried from {asked} q)"
    known = _later_sql(_later_sql(tried, _small_sql(), "here", f"tried / 86400.0::double - {_P.dt}"), _small_sql(), "back", f"tried / 86400.0::double - {_P.dt} - {_P.h}")
    return f"""(select segment_id, device_time, seq, tried as off from (select *, abs(tried + ({_P.k / _P.h * 86400.0!r}) * here * (here - back)) as miss from {known})
      where miss is not null qualify row_number() over (partition by segment_id, device_time, seq order by miss, tried) = 1)"""


_COARSE = _lag_sql(asked_sql("view"), f"range({-models.SEARCH}, {models.SEARCH + 1}, {models.COARSE})")
_FINE = _lag_sql(_COARSE, f"range(greatest(off - {models.COARSE}, {-models.SEARCH}), least(off + {models.COARSE}, {models.SEARCH}) + 1)", "q.segment_id, q.device_time, q.seq")


@query(f"""with a as (select q.*, off from {asked_sql('view')} q left join {_FINE} f on q.seq = f.seq)
  select segment_id, device_time, seq, {_P.p} * b + ({_P.cg}) * b * (b - present) + ({_P.c}) as value
  from {_later_sql(_later_sql('a', _small_sql(), 'present', f'off / 86400.0::double - {_P.dt}'), _small_sql('purchase'), 'b', f'off / 86400.0::double - {_P.dt}')}""")
def diffusion_interstitial(spark, d):
    return models.diffusion_interstitial(_asked(spark, d), _small(spark, d), _small(spark, d, "purchase")).select("segment_id", "device_time", "seq", "value")


_Q = models.PREDICTIVE


@query(f"""select segment_id, device_time, seq, {_Q.p} * blood + ({_Q.cg}) * blood * (blood - present) + {_Q.c} as value from (select *, {_blood_sql(_P, 'present', 'future', True)} as blood
  from {line_sql(line_sql(asked_sql('view'), _small_sql(), 'future', -_Q.dt), _small_sql(), 'present', -_Q.dt - _P.dt)})""")
def diffusion_prediction(spark, d):
    return models.diffusion_prediction(_asked(spark, d), _small(spark, d)).select("segment_id", "device_time", "seq", "value")


@query(f"""select a.segment_id, a.device_time, a.seq, (0.00576459 * present_slope + present - 0.00576459 * 0.02 - 0.02 * (epoch_us(a.device_time) - epoch_us(coalesce(c.device_time, f.first))) / 86400e6) / (1 / 1.02164072) as value
  from {line_sql(asked_sql('view'), _small_sql(), 'present')} a asof left join {signal_sql('purchase')} c on a.segment_id = c.segment_id and a.device_time >= c.device_time
  left join (select segment_id, min(device_time) as first from {signal_sql('click')} group by 1) f on a.segment_id = f.segment_id""")
def steil_rebrin(spark, d):
    calibration = E.last_written(E.signal(E.read_events(spark, d), "purchase"))
    return models.steil_rebrin(_asked(spark, d), _small(spark, d), calibration, gamma=0.02).select("segment_id", "device_time", "seq", "value")


@query(f"""select segment_id, device_time, seq, 0.00116362 * blood - 7.20151e-11 * blood * (blood - present) + 0.0794574 as value from (select *, 850.437 * 0.00630974 * present_slope + 850.437 * present as blood from {line_sql(asked_sql('view'), _small_sql(), 'present', -0.010417)})""")
def steil_rebrin_prediction(spark, d):
    return models.steil_rebrin_prediction(_asked(spark, d), _small(spark, d)).select("segment_id", "device_time", "seq", "value")


def _lags_sql(asked: str, knots: str, step: float, count: int, name: str = "lags") -> str:
    grid = f"(select q.*, k, q.device_time - to_microseconds(k * {round(step * DAY_US)}) as then_at from {asked} q, (select unnest(range({count})) as k))"
    moved = f"(select * exclude (device_time, then_at), then_at as device_time, device_time as asked_at from {grid})"
    return f"(select segment_id, asked_at as device_time, seq, list(v order by k) as {name} from {line_sql(moved, knots, 'v')} group by all)"


_WEIGHTS = [0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.02, 0.02, 0.02, 0.02, 0.02]


@query(f"""select segment_id, device_time + interval 1 hour as device_time, seq, {' + '.join(f'{w} * lags[{i + 1}]' for i, w in enumerate(_WEIGHTS))} as value from {_lags_sql(asked_sql('view', shift=-1 / 24), _small_sql(), 0.25, 12)}""")
def weighted_average(spark, d):
    return models.weighted_average(_asked(spark, d), _small(spark, d), _WEIGHTS, 1 / 24, 0.25).select("segment_id", "device_time", "seq", "value")


@query(f"select segment_id, device_time, seq, case when len(list_filter(lags, lambda x: x < 4.0)) > 0 then 0.0 else 1.3 end as value from {_lags_sql(asked_sql('view'), _small_sql(), 0.5, 6)}")
def low_glucose_suspend(spark, d):
    return models.low_glucose_suspend(_asked(spark, d), _small(spark, d), duration=3.0, step=0.5).select("segment_id", "device_time", "seq", "value")


@query(f"""with a as (select h.segment_id, h.device_time, h.seq, list_max(h.h) as hr, list_max(s.s) as eda from {_lags_sql(asked_sql('view'), signal_sql('click'), 0.5, 6, 'h')} h join {_lags_sql(asked_sql('view'), _small_sql('purchase'), 0.5, 6, 's')} s on h.seq = s.seq)
  select segment_id, device_time, seq, case when hr > 65 then (least(hr, 200) - 65) / 135.0 else 0 end * case when eda > 10 then 1 + (least(eda, 20) - 10) / 11.0 * 0.25 when eda is not null then 0.75 else 1 end as value from a""")
def physical_activity(spark, d):
    return models.physical_activity(_asked(spark, d), _click(spark, d), _small(spark, d, "purchase"), step=0.5).select("segment_id", "device_time", "seq", "value")


_T = "((epoch_us(a.device_time) - epoch_us(b.device_time)) / 86400e6 * 1440)"
_SCALED = f"({_T} * 180 / 4320.0)"
_TAU = 1800 * (1 - 1800 / 4320) / (1 - 2 * 1800 / 4320)
_A = 2 * _TAU / 4320
_S = 1 / (1 - _A + (1 + _A) * 2.718281828459045 ** (-4320 / _TAU))
_KERNEL_SQL = {
    "bilinear": f"case when {_SCALED} < 75 then 1 + 0.001852 * ({_SCALED} / 5 + 1) * (1 - ({_SCALED} / 5 + 1)) when {_SCALED} < 180 then 0.55556 + ({_SCALED} - 75) / 5 * (0.001323 * ({_SCALED} - 75) / 5 - 0.054233) else 0 end",
    "bilinear_activity": f"case when {_SCALED} < 75 then {_SCALED} * (2 / 4320.0) / 75 when {_SCALED} < 180 then 2 / 4320.0 * (1 - ({_SCALED} - 75) / 105) else 0 end",
    "exponential": f"1 - {_S * (1 - _A)!r} * (({_T} * {_T} / {_TAU * 4320 * (1 - _A)!r} - {_T} / {_TAU!r} - 1) * exp(-{_T} / {_TAU!r}) + 1)",
    "exponential_activity": f"{_S / (_TAU * _TAU)!r} * {_T} * (1 - {_T} / 4320.0) * exp(-{_T} / {_TAU!r})",
}


def _on_board_sql(kernel: str) -> str:
    return f"""select a.segment_id, a.device_time, a.seq, coalesce(sum(b.level * ({_KERNEL_SQL[kernel]})), 0)::double as value from {asked_sql('view')} a
      left join {EVENTS} b on a.segment_id = b.segment_id and b.signal_id = 'purchase' and b.device_time <= a.device_time and b.device_time > a.device_time - interval 3 day group by 1, 2, 3"""


def _on_board(spark, d, kernel: str) -> DataFrame:
    return models.on_board(_asked(spark, d), E.signal(E.read_events(spark, d), "purchase"), kernel, peak=1.25, dia=3.0)


@query(_on_board_sql("bilinear"))
def insulin_on_board(spark, d):
    return _on_board(spark, d, "bilinear")


@query(_on_board_sql("bilinear_activity"))
def insulin_activity(spark, d):
    return _on_board(spark, d, "bilinear_activity")


@query(_on_board_sql("exponential"))
def insulin_on_board_exponential(spark, d):
    return _on_board(spark, d, "exponential")


@query(_on_board_sql("exponential_activity"))
def insulin_activity_exponential(spark, d):
    return _on_board(spark, d, "exponential_activity")


@query(f"""select a.segment_id, a.device_time, a.seq, coalesce(sum(b.level * ({_KERNEL_SQL['bilinear']})), 0)::double as value from {asked_sql('view')} a
  left join {EVENTS} b on a.segment_id = b.segment_id and b.signal_id in ('purchase', 'signup') and b.device_time <= a.device_time and b.device_time > a.device_time - interval 3 day group by 1, 2, 3""")
def carbs_on_board(spark, d):
    e = E.read_events(spark, d)
    return models.on_board(_asked(spark, d), E.signal(e, "purchase").union(E.signal(e, "signup")), "bilinear", peak=1.25, dia=3.0)


@query(f"""with l as {_lags_sql(asked_sql('view'), _small_sql(), 0.1, 30)}, s as (select seq, present_slope as slope from {line_sql(asked_sql('view'), _small_sql(), 'present')}), o as (select seq, value / 1000 as iob from ({_on_board_sql('bilinear')})),
  a as (select l.segment_id, l.device_time, l.seq, lags[1] as bg, list_sum([coalesce(5.0 - x, 0) for x in lags]) as past, slope, greatest(lags[1] - iob / 0.36, 0) / 5.0 as future, iob from l join s on l.seq = s.seq join o on l.seq = o.seq)
  select segment_id, device_time, seq, case when bg is not null then greatest(0, least(3.5, -0.36 * (2.0 * future * (5.0 - bg) + 0.028 * future * past - 0.24 * bg / 5.0 * slope) + 1.3)) end as value from a""")
def beta_pid(spark, d):
    iob = _on_board(spark, d, "bilinear").select("segment_id", "device_time", "seq", (F.col("value") / 1000).alias("iob"))
    return models.beta_pid(_asked(spark, d), _small(spark, d), iob, step=0.1).select("segment_id", "device_time", "seq", "value")


def _smooth_sql(target: float, basal: float, decay: float | None) -> str:
    e = [f"({target} - lags[{i}])" for i in range(1, 6)]
    past = "list_sum([coalesce(%s - x, 0) for x in lags])" % target if decay is None else " + ".join(f"coalesce({target} - lags[{i + 1}], 0) * {decay ** i!r}" for i in range(12))
    five = f"case when lags[1] is not null and lags[2] is not null and lags[3] is not null and lags[4] is not null and lags[5] is not null then (-{e[0]} + 8 * {e[1]} - 8 * {e[3]} + {e[4]}) / (12 * 0.1) else 0 end"
    turn = f"0.24 * bg / {target} * slope"
    law = f"2.0 * future * ({target} - bg) + 0.028 * future * past + {turn}" if decay is None else f"2.0 * (future * ({target} - bg + 0.028 * past) + {turn})"
    return f"""with l as {_lags_sql(asked_sql('view'), _small_sql(), 0.1, 12)}, o as (select seq, value / 1000 as iob from ({_on_board_sql('bilinear')})),
      a as (select l.segment_id, l.device_time, l.seq, lags[1] as bg, {past} as past, {five} as slope, greatest(lags[1] - (iob - 1.5 * 0.0667) / 0.36, 0) / {target} as future from l join o on l.seq = o.seq)
      select segment_id, device_time, seq, case when bg is not null then greatest(0, least(3.5, -0.36 * ({law}) + {basal})) end as value from a"""


def _smooth(spark, d, target: float, decay: float | None) -> DataFrame:
    known = _on_board(spark, d, "bilinear").select("segment_id", "device_time", "seq", (F.col("value") / 1000).alias("iob"), F.lit(1.5).alias("cob"), F.lit(0.36).alias("isf"), F.lit(0.0667).alias("cr"))
    return models.beta_pid_smooth(_asked(spark, d), _small(spark, d), known, target, decay=decay, step=0.1).select("segment_id", "device_time", "seq", "value")


@query(_smooth_sql(6.66, 1.3, None))
def beta_pid_2(spark, d):
    return _smooth(spark, d, 6.66, None)


@query(_smooth_sql(5.5, 1.3, 0.95))
def beta_pid_3(spark, d):
    return _smooth(spark, d, 5.5, 0.95)


@query(f"""with a as (select *, (level - lag(level) over w) / (epoch_us(device_time) - lag(epoch_us(device_time)) over w) * 86400e6 as slope from {EVENTS} window w as (partition by segment_id, signal_id order by device_time, seq)),
  b as (select seq, {', '.join(f"last_value(case when signal_id = '{n}' then {{'l': level, 't': device_time, 's': slope}} end ignore nulls) over (partition by segment_id order by device_time, seq rows unbounded preceding) as {n}" for n in ('click', 'view'))} from a)
  select seq, click.l as click_level, click.t as click_time, click.s as click_slope, view.l as view_level, view.t as view_time, view.s as view_slope from b""")
def last_of_signals(spark, d):
    return routing.with_last(E.read_events(spark, d), ["click", "view"]).select("seq", *[f"{s}_{k}" for s in ("click", "view") for k in ("level", "time", "slope")])


def _pattern_sql(p: str) -> str:
    o, m, n = f"{p}one", f"{p}two", f"{p}three"
    return f"""case when {m} - {o} > 0.1 then case when not ({n} - {m} > 0.1) then 'concave' when abs({n} - {m}) > abs({m} - {o}) then 'accel' else 'up' end
      when {m} - {o} < -0.1 then case when not ({n} - {m} < -0.1) then 'convex' when abs({n} - {m}) > abs({m} - {o}) then 'deccel' else 'down' end
      when {n} - {m} > 0.1 then 'steady_up' when {n} - {m} < -0.1 then 'steady_down' else 'steady' end as shape,
      case when {n} >= 13 then 31 when {n} < 3 then 0 else floor(({n} - 3) / (10 / 30.0) + 0.5)::int end as band"""


_AGO = {"one": 1.5, "two": 1.25, "three": 1.0, "now_one": 0.5, "now_two": 0.25, "now_three": 0.0}
_AGO_SQL = f"(select * from {EVENTS.replace('value as level', 'value / 18.0 as level')} where signal_id = 'click')"
for _name, _days in _AGO.items():
    _AGO_SQL = f"(select * exclude ({_name}_slope) from {line_sql(_AGO_SQL, _small_sql(), _name, -_days)})"


@query(f"""with a as (select * from {_AGO_SQL}),
  b as (select segment_id, device_time, seq, level, {_pattern_sql('')}, level as taught, 0 as kind from a where one is not null and two is not null and three is not null
    union all select segment_id, device_time, seq, level, {_pattern_sql('now_')}, null, 1 from a where now_one is not null and now_two is not null and now_three is not null),
  c as (select *, last_value(taught ignore nulls) over (partition by shape, band order by device_time, seq, kind rows unbounded preceding) as told from b)
  select segment_id, device_time, seq, level, shape, band, nullif(told, 0) as predicted from c where kind = 1""")
def pattern_prediction(spark, d):
    levels = E.signal(E.read_events(spark, d), "click").withColumn("level", F.col("level") / 18.0)
    return models.pattern_prediction(levels, 1.0, 0.25)


@query(f"""select a.segment_id, a.device_time, a.seq, coalesce(sum(b.level * (epoch_us(least(a.device_time + interval 12 hour, b.device_time + interval 18 hour)) - epoch_us(greatest(a.device_time, b.device_time))) / (18 * 3600e6)), 0) as value
  from {asked_sql('view')} a left join {EVENTS} b on a.segment_id = b.segment_id and b.signal_id = 'purchase' and b.device_time < a.device_time + interval 12 hour and b.device_time + interval 18 hour > a.device_time group by 1, 2, 3""")
def overlap_uptake(spark, d):
    e = E.read_events(spark, d)
    asked = _asked(spark, d).withColumn("until", E.moved(F.col("device_time"), 12 * 3600.0))
    intakes = E.signal(e, "purchase").select("segment_id", F.col("device_time").alias("start"), E.moved(F.col("device_time"), 18 * 3600.0).alias("stop"), F.col("level").alias("amount"))
    return models.overlap_uptake(asked, intakes)


@query(f"""with a as (select level, device_time, segment_id from {EVENTS} where signal_id = 'click'),
  b as (select k, level, avg(level) over (partition by segment_id, k order by epoch_us(device_time) range between (k * 86400000000)::bigint preceding and current row) as mean from a, (select unnest([1, 2, 4]) as k))
  select case k when 1 then 0 when 2 then 1 else 2 end::bigint as candidate, sqrt(avg((mean - 100) ^ 2)) as fitness from b group by k""")
def optimized_chain(spark, d):
    text = "[01 map]\nsource = click\nto = level\n[02 mean_response]\nsignal = level\nseconds = $(SECONDS)\n"
    rows = E.read_events(spark, d)
    return chain.optimize(rows, text, [{"SECONDS": f"{k * E.DAY}"} for k in (1, 2, 4)], lambda made: F.sqrt(F.avg(F.pow(F.col("level") - 100, F.lit(2.0)))))


_SCORED = f"(select segment_id, candidate, gain, sqrt(avg((expected - gain * calculated) ^ 2)) as rmse, abs(avg(expected - gain * calculated)) as bias from {PAIRS}, (select i as candidate, (0.25 + i * 0.25)::double as gain from range(8) t(i)) group by all)"


@query(f"""select a.segment_id, a.candidate::bigint as candidate, a.gain, a.rmse, a.bias from {_SCORED} a where not exists (select 1 from {_SCORED} b where a.segment_id = b.segment_id and b.rmse <= a.rmse and b.bias <= a.bias and (b.rmse < a.rmse or b.bias < a.bias))""")
def pareto_front(spark, d):
    candidates = F.array(*[F.struct(F.lit(i).cast("long").alias("candidate"), F.lit(0.25 + 0.25 * i).alias("gain")) for i in range(8)])
    rows = _pairs(spark, d).select("segment_id", "expected", "calculated", F.explode(candidates).alias("c"))
    gap = F.col("expected") - F.col("c.gain") * F.col("calculated")
    scored = rows.groupBy("segment_id", F.col("c.candidate").alias("candidate"), F.col("c.gain").alias("gain")).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.abs(F.avg(gap)).alias("bias"))
    return fitting.front(scored, ["segment_id"], ["rmse", "bias"])


_FIT = f"(select segment_id, count(*) as n, regr_slope(calculated - expected, calculated) as slope, regr_intercept(calculated - expected, calculated) as off, avg(calculated - expected) as mean_gap from (select * from {line_sql(asked_sql('purchase'), signal_sql('click'), 'calculated')} where calculated is not null) group by 1 having count(*) >= 3)"


@query(f'select segment_id, n, slope, off as "offset", mean_gap from {_FIT}')
def sensor_calibration(spark, d):
    return models.sensor_calibration(E.read_events(spark, d), "click", "purchase", 3)


@query(f"""with a as (select *, level + 0.5 * (epoch_us(device_time) - min(epoch_us(device_time)) over (partition by segment_id)) / 86400e6 as drifted from {EVENTS} where signal_id = 'click')
  select a.segment_id, device_time, seq, greatest(0, drifted - coalesce(slope * drifted + off, 0)) as level from a left join {_FIT} f on a.segment_id = f.segment_id""")
def emulated_sensor(spark, d):
    return models.emulated_sensor(E.read_events(spark, d), "click", "purchase", 0.5, 3)


@query(f"""with c as (select * from (values {', '.join(f'({k}, {a}, {b}::double)' for k, (a, b) in enumerate([(0.25 + 1.75 * i / 7, -60 + 120 * j / 6) for i in range(8) for j in range(7)]))}) t(candidate, gain, bias)),
  s as (select segment_id, candidate, gain, bias, count(*) as n, sqrt(avg((expected - (gain * calculated + bias)) ^ 2)) as fitness from {PAIRS}, c group by all)
  select segment_id, candidate::bigint as candidate, gain, bias, n, fitness from s qualify row_number() over (partition by segment_id order by fitness, candidate) = 1""")
def fit_per_segment(spark, d):
    candidates = fitting.grid(spark, {"gain": (0.25, 2.0)}, 8)
    candidates = candidates.select("gain", F.explode(F.array(*[F.lit(-60 + 120 * j / 6) for j in range(7)])).alias("bias"), (F.col("candidate") * 7).alias("c"))
    candidates = candidates.select((F.col("c") + F.round((F.col("bias") + 60) / 20)).cast("long").alias("candidate"), "gain", "bias")
    return fitting.best(fitting.scores(_pairs(spark, d), candidates, F.col("gain") * F.col("calculated") + F.col("bias"), ["segment_id"]), ["segment_id"])


def _refined_sql(rounds: int = 4, steps: int = 5) -> str:
    """Rounds of a grid of steps x steps over gain and bias, each around the best so far."""
    bounds, parts = {"gain": (0.0, 2.0), "bias": (-200.0, 400.0)}, [f"p as (select expected, calculated from {PAIRS})", "r0 as (select 0.0::double as gain_low, 2.0::double as gain_high, -200.0::double as bias_low, 400.0::double as bias_high, null::double as gain, null::double as bias, null::double as fitness)"]
    for k in range(rounds):
        grid = ", ".join(f"{n}_low + ({n}_high - {n}_low) * {c} / {steps - 1} as {n}" for n, c in (("gain", "i"), ("bias", "j")))
        near = ", ".join(f"greatest({low}, {n} - ({n}_high - {n}_low) / {steps - 1}) as {n}_low, least({high}, {n} + ({n}_high - {n}_low) / {steps - 1}) as {n}_high" for n, (low, high) in bounds.items())
        parts += [
            f"g{k} as (select i * {steps} + j as candidate, {grid} from r{k}, range({steps}) a(i), range({steps}) b(j))",
            f"s{k} as (select candidate, gain, bias, sqrt(avg((expected - (gain * calculated + bias)) ^ 2)) as fitness from p, g{k} group by all order by fitness, candidate limit 1)",
            f"b{k} as (select r.gain_low, r.gain_high, r.bias_low, r.bias_high, x.gain, x.bias, x.fitness from r{k} r, (select gain, bias, fitness, 0 as o from r{k} where fitness is not null union all select gain, bias, fitness, 1 from s{k} order by fitness, o limit 1) x)",
            f"r{k + 1} as (select {near}, gain, bias, fitness from b{k})",
        ]
    return f"with {', '.join(parts)} select gain, bias, fitness from r{rounds}"


@query(_refined_sql())
def fit_refined(spark, d):
    found, fitness = fitting.refine(_pairs(spark, d), {"gain": (0.0, 2.0), "bias": (-200.0, 400.0)}, F.col("gain") * F.col("calculated") + F.col("bias"))
    return spark.createDataFrame([(found["gain"], found["bias"], fitness)], "gain double, bias double, fitness double")


@query()
def fit_evolved(spark, d):
    found, fitness = fitting.evolve(_pairs(spark, d), {"gain": (0.0, 2.0), "bias": (-200.0, 400.0)}, F.col("gain") * F.col("calculated") + F.col("bias"), rounds=6)
    return spark.createDataFrame([(found["gain"], found["bias"], fitness)], "gain double, bias double, fitness double")


@query(f"""with k as (select *, epoch_us(device_time) as t, row_number() over w - 1 as i, count(*) over (partition by segment_id) as n, lag({{'t': epoch_us(device_time), 'y': level}}) over w as k0, {{'t': epoch_us(device_time), 'y': level}} as k1,
    lead({{'t': epoch_us(device_time), 'y': level}}) over w as k2, lead({{'t': epoch_us(device_time), 'y': level}}, 2) over w as k3 from {signal_sql('click')} window w as (partition by segment_id order by device_time)),
  c as (select segment_id, device_time, t, level, i, n, case when i % 2 = 0 then k1 else k0 end as p, case when i % 2 = 0 then k2 else k1 end as q, case when i % 2 = 0 then k3 else k2 end as r from k),
  j as (select v.segment_id, v.device_time, v.seq, epoch_us(v.device_time) as x, a, b from {asked_sql('view')} v asof left join c a on v.segment_id = a.segment_id and v.device_time >= a.device_time asof left join c b on v.segment_id = b.segment_id and v.device_time <= b.device_time),
  s as (select *, (x - a.p.t) / (a.r.t - a.p.t) as s, x - a.t <= b.t - x as near_a from j)
  select segment_id, device_time, seq, case when a.t = x then a.level when b.t is not null and not ((near_a and a.i = 0) or (not near_a and b.i = b.n - 1)) then a.p.y * (1 - s) * (1 - s) + 2 * s * (1 - s) * a.q.y + s * s * a.r.y end as value from s""")
def plot_curve(spark, d):
    return asof.plot_curve(_asked(spark, d), _click(spark, d)).select("segment_id", "device_time", "seq", "value")


# --- doses and matched levels


@query(f"""with s as (select segment_id, min(device_time) as start from {EVENTS} group by 1), k as (select * from (values (0, 3600, 2.0), (1, 3700, 3.0), (2, 20000, 4.0)) t(k, o, dose)),
  n as (select k, dose, max(greatest(1, ceil(o / 600.0)) - k) over (order by k) + k as step from k)
  select segment_id, k, start + to_seconds((step * 600)::int) as device_time, dose as level from s, n""")
def scheduled_boluses(spark, d):
    starts = E.read_events(spark, d).groupBy("segment_id").agg(F.min("device_time").alias("start"))
    schedule = spark.createDataFrame([(0, 3600.0, 2.0), (1, 3700.0, 3.0), (2, 20000.0, 4.0)], "k int, offset_seconds double, dose double")
    return dosing.scheduled_boluses(starts, schedule, 600.0)


_STOPS = f"""(with a as (select *, level <= 20 as low, epoch_us(device_time) as t from {EVENTS} where signal_id = 'click'),
  b as (select *, coalesce(lag(low) over w, false) as was, t - lag(t) over w as since, lead(device_time) over w as nx from a window w as (partition by segment_id order by device_time, seq)),
  c as (select *, sum(case when not was or since >= {2 * DAY_US} then 1 else 0 end) over (partition by segment_id order by device_time, seq rows unbounded preceding) as run from b where low)
  select segment_id, min(device_time) as start, max(least(device_time + interval 2 day, coalesce(nx, device_time + interval 2 day))) as stop from c group by segment_id, run)"""


@query(f"select * from {_STOPS}")
def suspensions(spark, d):
    return dosing.suspensions(E.signal(E.read_events(spark, d), "click"), 20.0, 2 * E.DAY)


@query(f"select a.seq, greatest(a.device_time, coalesce(b.stop, a.device_time)) as device_time from {EVENTS} a asof left join {_STOPS} b on a.segment_id = b.segment_id and a.device_time >= b.start where a.signal_id = 'purchase'")
def postponed_doses(spark, d):
    e = E.read_events(spark, d)
    doses = E.signal(e, "purchase").select("segment_id", "device_time", F.col("seq").cast("double").alias("level"))
    return dosing.postponed(doses, dosing.suspensions(E.signal(e, "click"), 20.0, 2 * E.DAY)).select(F.col("level").cast("long").alias("seq"), "device_time")


def _pack_sql(schedule: list[tuple[int, float, float]], signal: str) -> str:
    """The doses of a schedule in steps of 600 seconds, put off by suspensions."""
    values = ", ".join(f"({k}, {o}, {x})" for k, o, x in schedule)
    return f"""select s.segment_id, '{signal}' as signal_id, greatest(s.device_time, coalesce(b.stop, s.device_time)) as device_time, s.level from (select segment_id, start + to_seconds((step * 600)::int) as device_time, dose::double as level
      from (select segment_id, min(device_time) as start from {EVENTS} group by 1), (select dose, max(greatest(1, ceil(o / 600.0)) - k) over (order by k) + k as step from (values {values}) t(k, o, dose))) s
      asof left join {_STOPS} b on s.segment_id = b.segment_id and s.device_time >= b.start"""


_BOLUSES, _RATES = [(0, 3600.0, 2.0), (1, 3700.0, 3.0), (2, 200000.0, 4.0)], [(0, 7200.0, 0.5), (1, 400000.0, 1.5)]


@query(f"""select segment_id, 'Requested_Insulin_Basal_Rate' as signal_id, min(device_time) + interval 10 minute as device_time, 1.0::double as level from {EVENTS} group by 1
  union all {_pack_sql(_RATES, 'Requested_Insulin_Basal_Rate')} union all select segment_id, 'Requested_Insulin_Basal_Rate', start, 0.0 from {_STOPS} union all {_pack_sql(_BOLUSES, 'Requested_Insulin_Bolus')}""")
def rates_pack(spark, d):
    e = E.read_events(spark, d)
    starts = e.groupBy("segment_id").agg(F.min("device_time").alias("start"))
    schedule = lambda rows: spark.createDataFrame(rows, "k int, offset_seconds double, dose double")
    return dosing.rates_pack(starts, schedule(_BOLUSES), schedule(_RATES), 1.0, E.signal(e, "click"), 20.0, 2 * E.DAY, 600.0)


@query(f"""select segment_id, 'Requested_Insulin_Basal_Rate' as signal_id, min(device_time) as device_time, 1.2::double as level from {EVENTS} group by 1
  union all select segment_id, 'Requested_Insulin_Bolus', device_time, level * 0.1 from {EVENTS} where signal_id = 'purchase'""")
def basal_and_bolus(spark, d):
    return dosing.basal_and_bolus(E.read_events(spark, d), "purchase", 1.2, 0.1)


@query()
def basal_to_boluses(spark, d):
    return dosing.basal_to_boluses(E.read_events(spark, d), "click", 0.05, 1.0)


@query()
def nearest_pairs(spark, d):
    return matching.nearest_pairs(E.read_events(spark, d), "view", "click")


@query()
def temporal_error(spark, d):
    return matching.temporal_error(matching.nearest_pairs(E.read_events(spark, d), "view", "click"))


@query(f"""with a as (select segment_id, abs(epoch_us(error_time) - epoch_us(device_time)) / 86400e6 as lag, expected, calculated from (select v.segment_id, v.device_time, v.expected, c.device_time as error_time, c.level as calculated
    from {asked_sql('view')} v asof join {signal_sql('click')} c on v.segment_id = c.segment_id and v.device_time >= c.device_time)),
  b as (select *, min(lag) over w as l0, max(lag) over w as l1, min(expected) over w as e0, max(expected) over w as e1 from a window w as (partition by segment_id)),
  c as (select segment_id, count(*) as n, avg(abs(expected - calculated)) as level_error, avg(abs(case when l1 > l0 then e0 + (e1 - e0) * (lag - l0) / (l1 - l0) end)) as time_error from b group by 1)
  select *, level_error + time_error as error from c""")
def temporal_error_of_last(spark, d):
    found = asof.bracket(_asked(spark, d), _click(spark, d)).where("before is not null")
    time = E.micros() / (E.DAY * 1e6)
    pairs = found.select("segment_id", time.alias("t"), "expected", (F.col("before.t") / (E.DAY * 1e6)).alias("error_t"), F.col("before.level").alias("calculated"))
    return matching.temporal_error(pairs)


# --- sources and sinks


@query("""select unnest([{'s': 'IG', 'l': sin(i * 5.0 * 2 * pi() / 240.0) * 2 + 6, 'k': 0}, {'s': 'BG', 'l': cos(i * 5.0 * 2 * pi() / 240.0) * 2 + 6, 'k': 1}, {'s': 'Calibration', 'l': cos(i * 5.0 * 2 * pi() / 240.0) * 2 + 6, 'k': 2}]).s as signal_id,
  unnest([sin(i * 5.0 * 2 * pi() / 240.0) * 2 + 6, cos(i * 5.0 * 2 * pi() / 240.0) * 2 + 6, cos(i * 5.0 * 2 * pi() / 240.0) * 2 + 6]) as level, i * 3 + unnest([0, 1, 2]) as seq from range(576) t(i)""")
def sine_and_cosine(spark, d):
    return device_files.sine_and_cosine(spark, 2.0).select("signal_id", "level", "seq")


@query(f"""select seq::varchar || '; ' || strftime(device_time, '%Y-%m-%d %H:%M:%S.') || lpad(((epoch_us(device_time) // 1000) % 1000)::varchar, 3, '0') || '; Level; ' || signal_id || '; ' || level::varchar || '; ' || segment_id::varchar || '; Level; ; ' || signal_id as value from {EVENTS}""")
def log_lines(spark, d):
    return logs.lines(E.read_events(spark, d)).select("value")


@query(f"select seq, signal_id, segment_id, level, 'Level' as event_code from {EVENTS}")
def log_round_trip(spark, d):
    return logs.parse(logs.lines(E.read_events(spark, d))).select("seq", "signal_id", "segment_id", "level", "event_code")


@query(f"select segment_id, device_time, {', '.join(f'''max_by(level, seq) filter (where signal_id = '{s}') as {s}''' for s in ('click', 'view', 'purchase'))} from {EVENTS} group by 1, 2")
def pivot_wide(spark, d):
    return logs.pivot_wide(E.read_events(spark, d), ["click", "view", "purchase"])


@query(f"select segment_id, signal_id, device_time, level from {EVENTS} where signal_id in ('click', 'view')")
def unpivot_wide(spark, d):
    wide = logs.pivot_wide(E.read_events(spark, d), ["click", "view"])
    return device_files.unpivot_wide(wide, "segment_id", "device_time", ["click", "view"]).select("segment_id", "signal_id", "device_time", "level")


@query(f"select device_time as measured_at, signal_id, level as value, segment_id as time_segment_id from {EVENTS} where signal_id not in ('error', 'signup') or signal_id = 'signup'")
def database_rows(spark, d):
    virtual = spark.createDataFrame([("error",), ("signup",)], "signal_id string")
    return logs.database_rows(E.read_events(spark, d), virtual, ("signup",))


@query("select event_type as signal_id, ts as device_time, user_id as segment_id, value - 0.01 as level from events where value - 0.01 <> 0")
def database_levels(spark, d):
    rows = E.read_events(spark, d).select(F.col("device_time").alias("measured_at"), "signal_id", (F.col("level") - 0.01).alias("value"), F.col("segment_id").alias("time_segment_id"))
    return device_files.database_levels(rows).select("signal_id", "device_time", "segment_id", "level")


@query(f"select seq, level / 18.0182 as mmol, (level - 32) * 5 / 9 as celsius, level * 0.01 as hundredth, level / 1440 as days, level * level + 1 as own from {EVENTS}")
def unit_conversions(spark, d):
    names = {"mmol": "mgdl_to_mmoll", "celsius": "fahrenheit_to_celsius", "hundredth": "hundredth", "days": "minutes_to_days", "own": "x * x + 1"}
    return E.read_events(spark, d).select("seq", *[convert("level", c).alias(n) for n, c in names.items()])


@query(f"""with s as (select * from (values {', '.join(f"('{n}', '{u}')" for n, u in signals.SIGNALS)}) t(signal_id, unit)),
  e as (select case signal_id when 'click' then 'IG' when 'view' then 'BG' else signal_id end as signal_id, count(*) as n from {EVENTS} group by 1)
  select e.signal_id, n, unit, replace(s.signal_id, '_', ' ') as description from e left join s on e.signal_id = s.signal_id""")
def signal_names(spark, d):
    e = routing.map_signal(routing.map_signal(E.read_events(spark, d), "click", "IG"), "view", "BG")
    return signals.with_names(e, signals.known_signals(spark)).groupBy("signal_id", "unit", "description").agg(F.count("*").alias("n"))


@query(f"select segment_id, device_time, seq, 6.66::double as level, 0.36::double as sensitivity, 0.0666::double as ratio from {asked_sql('view')}")
def constant_models(spark, d):
    asked = _asked(spark, d)
    for name, value in (("level", 6.66), ("sensitivity", 0.36), ("ratio", 0.0666)):
        asked = models.constant(asked, value, name)
    return asked.select("segment_id", "device_time", "seq", "level", "sensitivity", "ratio")


@query("""select o_custkey as segment_id, count(*) as n, avg(o_totalprice / 1000) as avg_level, max(o_totalprice / 1000) as most from orders group by rollup(o_custkey)""")
def order_levels(spark, d):
    levels = E.read_orders(spark, d)
    return levels.rollup("segment_id").agg(F.count("*").alias("n"), F.avg("level").alias("avg_level"), F.max("level").alias("most"))


# --- parameters that travel in the stream


def _with_parameters(spark, d) -> DataFrame:
    """The events with each purchase as a parameter vector (gain, bias) of the signal ``estimate``."""
    events = E.read_events(spark, d)
    level = F.col("level")
    vectors = events.where("signal_id = 'purchase' and level is not null").withColumns({
        "event_code": F.lit(E.PARAMETERS), "signal_id": F.lit("estimate"), "parameters": F.array(0.5 + level / 1000, level / 100), "level": F.lit(None).cast("double"),
    })
    return events.unionByName(vectors)


def _gain_and_bias(p: Column, x: dict[str, Column]) -> Column:
    return p[0] * x["past"] + p[1]


_VECTORS = "(select user_id as segment_id, ts as device_time, max(event_id) as seq, max_by(value, event_id) as v from events where event_type = 'purchase' and value is not null group by 1, 2)"
_ASKED_TIMES = """(select segment_id, due, min(asked_at) as asked_at from (
  select user_id as segment_id, ts + interval 1 day as due, ts as asked_at from events where event_type in ('click', 'view') and value is not null
  union all select user_id, ts, ts from events where event_type = 'view' and value is not null) group by 1, 2)"""


@query(f"""with q as (select *, due - interval 1 day as device_time from {_ASKED_TIMES}), k as {signal_sql('click')},
  x as (select q.segment_id, due, greatest(asked_at, b.device_time) as known_at, case when a.device_time = b.device_time then a.level else
      a.level + (epoch_us(q.device_time) - epoch_us(a.device_time)) * ((b.level - a.level) / (epoch_us(b.device_time) - epoch_us(a.device_time))) end as past
    from q asof join k a on q.segment_id = a.segment_id and q.device_time >= a.device_time asof join k b on q.segment_id = b.segment_id and q.device_time <= b.device_time)
  select x.segment_id, due as device_time, coalesce(0.5 + v / 1000, 1.0) as gain, coalesce(v / 100, 0.0) as bias, coalesce(0.5 + v / 1000, 1.0) * past + coalesce(v / 100, 0.0) as level
  from x asof left join {_VECTORS} p on x.segment_id = p.segment_id and x.known_at >= p.device_time""")
def calculated_levels(spark, d):
    found = calculated.calculate(_with_parameters(spark, d), "estimate", {"past": ("click", 1.0)}, _gain_and_bias, [1.0, 0.0], "view", 1.0)
    return found.select("segment_id", "device_time", F.col("parameters")[0].alias("gain"), F.col("parameters")[1].alias("bias"), "level")


def _hints(spark, d) -> DataFrame:
    events = _with_parameters(spark, d)
    rows = _pairs(spark, d).withColumnRenamed("calculated", "past")
    return calculated.hint_fitness(rows, calculated.parameters_of(events, "estimate"), _gain_and_bias, ["past"], [1.0, 0.0])


_HINTS_SQL = f"""(select p.segment_id, h.seq, h.device_time, gain, bias, count(*) as n, avg(abs(expected - (gain * calculated + bias))) as fitness from {PAIRS} p join (
    select user_id as segment_id, event_id as seq, ts as device_time, 0.5 + value / 1000 as gain, value / 100 as bias from events where event_type = 'purchase' and value is not null
    union all select distinct user_id, null, null, 1.0, 0.0 from events) h on p.segment_id = h.segment_id group by all)"""


@query(f"select segment_id, coalesce(seq, -1) as seq, gain, bias, n, fitness from {_HINTS_SQL} qualify row_number() over (partition by segment_id order by fitness, device_time nulls last, seq) = 1")
def best_hints(spark, d):
    return calculated.best_hints(_hints(spark, d)).select("segment_id", F.coalesce("seq", F.lit(-1).cast("long")).alias("seq"), F.col("parameters")[0].alias("gain"), F.col("parameters")[1].alias("bias"), "n", "fitness")


@query(f"""select segment_id, seq, device_time, gain, bias, fitness from (select *, min(fitness) over (partition by segment_id order by device_time nulls first, seq rows between unbounded preceding and 1 preceding) as least from {_HINTS_SQL})
  where seq is not null and fitness < least""")
def improving_parameters(spark, d):
    return calculated.improving(_hints(spark, d)).select("segment_id", "seq", "device_time", F.col("parameters")[0].alias("gain"), F.col("parameters")[1].alias("bias"), "fitness")


# --- fits of every segment at once

_LINE = {"gain": (0.0, 2.0), "bias": (-100.0, 200.0)}


def _line_model(p: dict[str, Column]) -> Column:
    return p["gain"] * F.col("calculated") + p["bias"]


def _error_sql(gain: str, bias: str) -> str:
    return f"avg((expected - (({gain}) * calculated + ({bias}))) ^ 2)"


_FITTED_SQL = "select segment_id, gain, bias, count(*) as n, sqrt(avg((expected - (gain * calculated + bias)) ^ 2)) as fitness from p join {} using (segment_id) group by all"


def _scan_sql(steps: int, generations: int) -> str:
    parts, last = [f"p as materialized (select * from {PAIRS})", "s0 as (select distinct segment_id, 0.0::double as gain, -100.0::double as bias from p)"], "s0"
    for k in range(generations):
        for name, (low, high) in _LINE.items():
            values = [low + (high - low) * i / steps for i in range(steps + 1)]
            errors = ", ".join(_error_sql(*(f"{v!r}::double" if n == name else n for n in _LINE)) for v in values)
            parts += [
                f"t{k}{name} as materialized (select segment_id, gain, bias, {_error_sql('gain', 'bias')} as held, [{errors}] as e from p join {last} using (segment_id) group by all)",
                f"s{k}{name} as materialized (select segment_id, {', '.join(f'case when list_min(e) < held then {values!r}[list_position(e, list_min(e))] else {n} end as {n}' if n == name else n for n in _LINE)} from t{k}{name})",
            ]
            last = f"s{k}{name}"
    return f"with {', '.join(parts)} {_FITTED_SQL.format(last)}"


@query(_scan_sql(8, 2))
def fit_scanned(spark, d):
    return segment_fits.scan(_pairs(spark, d), _LINE, _line_model, ["segment_id"], 8, 2)


def _ternary_sql(rounds: int, generations: int) -> str:
    parts, last = [f"p as materialized (select * from {PAIRS})", "s0 as (select distinct segment_id, 1.0::double as gain, 50.0::double as bias from p)"], "s0"
    for k in range(generations):
        for name, (low, high) in reversed(_LINE.items()):
            own = f"r{k}{name}"
            parts.append(f"{own}0 as materialized (select *, {low}::double as low, {high}::double as high from {last})")
            for r in range(rounds):
                points = ["low + (high - low) / 3", "low + 2 * ((high - low) / 3)", name]
                errors = ", ".join(_error_sql(*(x if n == name else n for n in _LINE)) + f" as {e}" for e, x in zip(("e1", "e2", "e3"), points, strict=True))
                parts.append(f"{own}{r}e as materialized (select segment_id, gain, bias, low, high, {errors} from p join {own}{r} using (segment_id) group by all)")
                parts.append(f"""{own}{r + 1} as materialized (select segment_id, gain, bias, case when e1 < e2 then low else {points[0]} end as low, case when e2 < e1 then high else {points[1]} end as high from {own}{r}e)""")
            at, error = f"case when e1 < e2 then {points[0]} else {points[1]} end", "case when e1 < e2 then e1 else e2 end"
            parts.append(f"s{k}{name} as materialized (select segment_id, {', '.join(f'case when {error} < e3 then {at} else {n} end as {n}' if n == name else n for n in _LINE)} from {own}{rounds - 1}e)")
            last = f"s{k}{name}"
    return f"with {', '.join(parts)} {_FITTED_SQL.format(last)}"


@query(_ternary_sql(8, 1))
def fit_contracted(spark, d):
    return segment_fits.ternary(_pairs(spark, d), _LINE, _line_model, ["segment_id"], 8, 1)


def _solved_sql(steps: int, rounds: int) -> str:
    """A gain for each segment and one bias for all, each from grids that shrink, in turn."""
    parts = [f"p as materialized (select * from {PAIRS})", "g0 as (select distinct segment_id, 0.0::double as low, 2.0::double as high from p)", "b0 as (select -100.0::double as low, 200.0::double as high, 50.0::double as bias)"]
    for k in range(rounds):
        at = lambda i: f"(low + (high - low) * {i / (steps - 1)!r})"
        gains = ", ".join(_error_sql(at(i), "bias") for i in range(steps))
        biases = ", ".join(_error_sql("gain", at(i)) for i in range(steps))
        parts += [
            f"e{k} as materialized (select segment_id, low, high, [{gains}] as e from p join g{k} using (segment_id), (select bias from b{k}) group by all)",
            f"c{k} as materialized (select segment_id, low, high, low + (high - low) * ((list_position(e, list_min(e)) - 1) / {steps - 1}::double) as gain from e{k})",
            f"g{k + 1} as materialized (select segment_id, gain, greatest(0.0, gain - (high - low) / {steps - 1}) as low, least(2.0, gain + (high - low) / {steps - 1}) as high from c{k})",
            f"f{k} as materialized (select low, high, [{biases}] as e from p join (select segment_id, gain from c{k}) using (segment_id), (select low, high from b{k}) group by low, high)",
            f"d{k} as materialized (select low, high, low + (high - low) * ((list_position(e, list_min(e)) - 1) / {steps - 1}::double) as bias from f{k})",
            f"b{k + 1} as materialized (select greatest(-100.0, bias - (high - low) / {steps - 1}) as low, least(200.0, bias + (high - low) / {steps - 1}) as high, bias from d{k})",
        ]
    return f"with {', '.join(parts)} select segment_id, gain, bias, count(*) as n, sqrt(avg((expected - (gain * calculated + bias)) ^ 2)) as fitness from p join (select segment_id, gain from g{rounds}) using (segment_id), (select bias from b{rounds}) group by all"


@query(_solved_sql(5, 4))
def fit_own_and_shared(spark, d):
    found, shared, _ = segment_fits.solve_segments(_pairs(spark, d), {"gain": _LINE["gain"]}, {"bias": _LINE["bias"]}, _line_model, ["segment_id"])
    return found.select("segment_id", "gain", F.lit(shared["bias"]).alias("bias"), "n", "fitness")


# --- functions with a memory


def _every_third(memory: dict, levels: list[stateful.Level]):
    """Drops every third level, doubles the others, and sends the slope at every fifth."""
    for x in levels:
        memory["n"] = memory.get("n", 0) + 1
        if memory["n"] % 3:
            yield x._replace(level=2 * x.level)
        if memory["n"] % 5 == 0 and x.slope is not None:
            yield x._replace(signal="slope", level=x.slope)


@query("""with e as (select user_id as segment_id, event_id as seq, ts as device_time, value as level, event_type, count(*) filter (where event_type = 'purchase') over (partition by user_id order by ts, event_id) as part
    from events where event_type in ('click', 'purchase')),
  c as (select *, row_number() over w as n, lag(level) over w as back, lag(device_time) over w as back_at from e where event_type = 'click' and level is not null window w as (partition by segment_id, part order by device_time, seq))
  select segment_id, 'click' as signal_id, device_time, seq, 2 * level as level from c where n % 3 <> 0
  union all select segment_id, 'slope', device_time, seq, (level - back) / (epoch_us(device_time) - epoch_us(back_at)) * 86400e6 from c where n % 5 = 0 and device_time > back_at""")
def scripted_levels(spark, d):
    events = E.read_events(spark, d)
    resets = events.where("signal_id = 'purchase'").withColumns({"event_code": F.lit("Warm_Reset"), "signal_id": F.lit(None).cast("string"), "level": F.lit(None).cast("double")})
    found = stateful.replay(events.unionByName(resets), _every_third, ["click"])
    return found.select("segment_id", "signal_id", "device_time", "seq", "level")


@query(f"""select segment_id, device_time, seq, expected, calculated, avg(abs(expected - calculated)) over (partition by segment_id order by device_time, seq rows unbounded preceding) as metric from {PAIRS}""")
def pairs_in_order(spark, d):
    found = stateful.replay(E.read_events(spark, d), stateful.pairing("view", "click"), ["view", "click"])
    return found.select("segment_id", "device_time", "seq", F.col("parameters")[0].alias("expected"), F.col("parameters")[1].alias("calculated"), F.col("level").alias("metric"))


# --- first populations


def _inverse_sql(index: str, base: int) -> str:
    return f"(select sum(((({index}) // pow({base}, k)::bigint) % {base}) / pow({base}, k + 1)) from range(8) r(k))"


@query(f"""with c as (select i as candidate, 2.0 * {_inverse_sql('i + 1', 2)} as gain, -100.0 + 300.0 * {_inverse_sql('i + 1', 3)} as bias from range(64) r(i))
  select candidate, round(gain, 9) as gain, round(bias, 9) as bias, count(*) as n, sqrt(avg((expected - (gain * calculated + bias)) ^ 2)) as fitness from {PAIRS}, c group by all""")
def halton_candidates(spark, d):
    scored = fitting.scores(_pairs(spark, d), populations.halton(spark, _LINE, 64), F.col("gain") * F.col("calculated") + F.col("bias"), [])
    return scored.select("candidate", F.round("gain", 9).alias("gain"), F.round("bias", 9).alias("bias"), "n", "fitness")


@query()
def fit_swarm(spark, d):
    found, fitness = fitting.swarm(_pairs(spark, d), _LINE, F.col("gain") * F.col("calculated") + F.col("bias"), rounds=6, start="diagonal")
    return spark.createDataFrame([(found["gain"], found["bias"], fitness)], "gain double, bias double, fitness double")


def _line_fit(spark, found: dict[str, float], fitness: float) -> DataFrame:
    return spark.createDataFrame([(found.get("gain"), found.get("bias"), fitness)], "gain double, bias double, fitness double")


@query()
def fit_mutated(spark, d):
    return _line_fit(spark, *rumours.mutate(_pairs(spark, d), _LINE, F.col("gain") * F.col("calculated") + F.col("bias"), rounds=6))


@query()
def fit_by_rumours(spark, d):
    return _line_fit(spark, *rumours.rumours(_pairs(spark, d), _LINE, F.col("gain") * F.col("calculated") + F.col("bias"), rounds=4))


# --- averaged exponentials


def _averaged_sql(passes: int, kind: str) -> str:
    """Every pass on the whole signal, and the value from the points around the time asked."""
    lift = averaged.OFFSET if kind == "exp" else 0.0
    rate = (lambda a, b: f"case when {b}.t = {a}.t then 0 else ln({b}.y / {a}.y) / ({b}.t - {a}.t) end") if kind == "exp" else (lambda a, b: f"case when {b}.t = {a}.t then 0 else ({b}.y - {a}.y) / ({b}.t - {a}.t) end")
    curve = (lambda p, at: f"{p}.y * exp({p}.k * ({at} - {p}.t))") if kind == "exp" else (lambda p, at: f"({p}.y + {p}.k * ({at} - {p}.t))")
    parts = [f"p0 as (select segment_id, epoch_us(device_time) / 86400e6 as t, level + {lift}::double as y from {signal_sql('click')} where level is not null)"]
    for k in range(passes + 1):
        parts.append(f"""a{k} as (select segment_id, t, y, struct_pack(t := t, y := y) as o, lead(struct_pack(t := t, y := y)) over w as n1, lead(struct_pack(t := t, y := y), 2) over w as n2,
          row_number() over w - 1 as i, count(*) over (partition by segment_id) - 1 as m from p{k} window w as (partition by segment_id order by t))""")
        parts.append(f"q{k} as materialized (select *, case when n2 is null then {rate('o', 'n1')} else {rate('o', 'n2')} end as k from a{k} where m > 0)")
        if k < passes:
            middle = "((c.t + c.n1.t) * 0.5)"
            parts.append(f"""h{k} as (select c.*, b.t as bt, b.y as by_, b.k as bk from q{k} c left join q{k} b on b.segment_id = c.segment_id and b.i = c.i - 1)""")
            before = lambda at: f"by_ * exp(bk * ({at} - bt))" if kind == "exp" else f"(by_ + bk * ({at} - bt))"
            parts.append(f"""p{k + 1} as (select segment_id, t, case when i = 0 or i >= m - 1 then y else ({before('t')} + y) * 0.5 end as y from h{k}
              union all select segment_id, {middle}, case when i = 0 or i = m - 1 then {curve('c', middle)} else ({before(middle)} + {curve('c', middle)}) * 0.5 end from h{k} c where i < m)""")
    return f"""with {', '.join(parts)}, v as (select *, epoch_us(device_time) / 86400e6 as x from {asked_sql('view')}),
      j as (select v.segment_id, v.device_time, v.seq, x, r.i, r.m, r.t, r.y, r.k from v asof left join q{passes} r on v.segment_id = r.segment_id and v.x <= r.t),
      l as (select j.*, b.t as bt, b.y as by_, b.k as bk from j left join q{passes} b on b.segment_id = j.segment_id and b.i = j.i - 1)
      select segment_id, device_time, seq, case when i = 0 and t = x then y when i = 0 then null when i = m then {before('x')} else ({before('x')} + {curve('l', 'x')}) * 0.5 end - {lift} as value from l"""


@query(_averaged_sql(3, "exp"))
def averaged_exponentials(spark, d):
    return averaged.averaged(_asked(spark, d), _click(spark, d), 3).select("segment_id", "device_time", "seq", "value")


@query(_averaged_sql(2, "line"))
def averaged_lines(spark, d):
    return averaged.averaged(_asked(spark, d), _click(spark, d), 2, "line").select("segment_id", "device_time", "seq", "value")


@query(f"""select 'Level' as event_code, signal_id, segment_id, seq, date_trunc('milliseconds', device_time) as device_time, level from {EVENTS}""")
def replayed_log_source(spark, d):
    folder = log_source.written(E.read_events(spark, d))
    return log_source.replay(spark, folder).select("event_code", "signal_id", "segment_id", "seq", "device_time", "level")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
