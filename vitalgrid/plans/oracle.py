"""DuckDB SQL for the rows of each registered telemetry query, over the same adapters written as views in ``WITH``."""

from __future__ import annotations

from vitalgrid.plans.fixtures import AGGREGATES, HR_MAX
from vitalgrid.schema import GROUPS, NAMES, registry_rows


def _values(rows) -> str:
    show = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join(f"({', '.join(map(show, r))})" for r in rows)


def _day(ts: str) -> str:
    return f"cast((({ts}) at time zone 'UTC') at time zone 'Europe/Vienna' as date)"


REGISTRY = f"registry(metric, agg, category) as (values {_values([(m, a, 'events' if m.isalpha() else 'orders') for m, a in AGGREGATES])})"
SAMPLES = """samples as (select ts as time, event_type as metric, cast(user_id as varchar) as source, 'count' as unit,
  case when event_type <> 'view' then value end as qty, case when event_type = 'view' then value * 0.9 end as vmin, case when event_type = 'view' then value end as vavg,
  case when event_type = 'view' then value * 1.1 end as vmax, cast(null as integer) as n from events)"""
DAILY = f"""daily as (select {_day('time')} as day, metric, avg(coalesce(vavg, qty)) as avg, min(coalesce(vmin, qty)) as min, max(coalesce(vmax, qty)) as max, sum(qty) as sum, sum(n)::bigint as n
  from samples group by 1, 2)"""
SERIES = """series as (select metric as series, day, case agg when 'sum' then sum when 'avg' then avg when 'min' then min when 'max' then max end as value from daily join registry using (metric)),
  observed as (select * from series where value is not null)"""
BASE = f"with {REGISTRY}, {SAMPLES}, {DAILY}, {SERIES}"
GRID = """thin as (select * from observed),
  grid as (select series, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from thin group by series)"""
SLEEP = """sleep as (select event_id as id, ts - interval 8 hour as sleep_start, date_trunc('hour', ts) as sleep_end, ts - interval 9 hour as in_bed_start, case when event_id % 2 = 0 then date_trunc('hour', ts) end as in_bed_end,
  cast(user_id % 3 as varchar) as source, ts::date as sleep_date, value / 10 as total_sleep_h, value / 50 as deep_h, value / 40 as rem_h, value / 10 * 0.9 as asleep_h, value / 10 * 0.1 as awake_h,
  case when event_id % 3 = 0 then 0.0 else value / 10 * 1.2 end as in_bed_h from events where event_type = 'signup'),
  nightly as (select * from sleep qualify row_number() over (partition by sleep_date order by total_sleep_h desc nulls last, sleep_start asc nulls last, id) = 1)"""
FRAME = """bed as (select *, coalesce(epoch(in_bed_end - in_bed_start) / 3600.0, in_bed_h) as b, (coalesce(in_bed_start, sleep_start) at time zone 'UTC') at time zone 'Europe/Vienna' as loc from nightly),
  frame as (select sleep_date as day, max(total_sleep_h) as sleep_total_h, max(deep_h) as sleep_deep_h, max(rem_h) as sleep_rem_h, min(hour(loc) + minute(loc) / 60.0) as bedtime, case when max(b) > 0 then max(total_sleep_h) / max(b) end as sleep_efficiency from bed group by 1)"""
WORKOUTS = """workouts as (select o_orderkey as hae_id, o_orderdate + (o_orderkey % 86400) * interval 1 second as start_time, o_orderpriority as name, cast(600 + o_custkey % 3600 as double) as duration_s,
  cast(90 + o_orderkey % 90 as double) as avg_hr, cast(110 + o_orderkey % 90 as double) as max_hr, o_totalprice / 1000 as active_energy_kcal, case when o_orderkey % 3 <> 0 then cast(o_orderkey % 7 as double) end as intensity, case when o_orderkey % 4 <> 0 then cast(o_custkey % 40 as double) end as distance_km,
  (['running', 'walking', 'cycling', 'strength', 'yoga'])[o_orderkey % 5 + 1] as canonical_type from orders)"""
HR = """line as (select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) = 1),
  hr as (select hae_id, start_time + l_linenumber * interval 60 second as ts, 70 + 2 * l_quantity as bpm from line join workouts on l_orderkey = hae_id)"""
RESTING = "resting as (select o_orderdate::date as day, cast(45 + count(*) % 20 as double) as value from orders group by 1)"
ORDERS = "o_series as (select o_orderpriority as series, o_orderdate::date as day, sum(o_totalprice) as value from orders group by 1, 2)"
LOADS = f"""{ORDERS}, o_grid as (select series, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from o_series group by series),
  loads as (select g.series, g.day, coalesce(value, 0) as value from o_grid g left join o_series s on g.series = s.series and g.day = s.day)"""
ZSCORE = f"""{ORDERS}, z1 as (select *, array_agg(value) over (partition by series order by day rows between 28 preceding and 1 preceding) as w from o_series),
  z2 as (select series, day, value, w, case when len(w) = 28 then list_median(w) end as m from z1),
  z3 as (select *, case when m is not null then list_median(list_transform(w, lambda x: abs(x - m))) end as d from z2),
  zs as (select series, day, value, case when d > 0 then 0.6745 * (value - m) / d end as z from z3)"""
GLOBAL = """g1 as (select series, median(value) as m from o_series group by 1), g2 as (select series, median(abs(value - m)) as d from o_series join g1 using (series) group by 1),
  gz as (select series, day, value, case when d > 0 then 0.6745 * (value - m) / d end as global_z from o_series join g1 using (series) join g2 using (series))"""
TRIMP = f"""{WORKOUTS}, {HR}, {RESTING}, params as (select greatest(160, least(210, max(max_hr))) as most from workouts), overall as (select median(value) as r from resting),
  b0 as (select *, {_day('start_time')} as day from workouts where start_time is not null),
  r0 as (select d.day, quantile_cont(r.value, 0.5) as rest from (select distinct day from b0) d left join resting r on r.day between d.day - 27 and d.day group by 1),
  base as (select b0.*, coalesce(r0.rest, overall.r, 60) as r, most from b0 left join r0 on b0.day = r0.day, params, overall),
  iv as (select hae_id, bpm, epoch(lead(ts) over (partition by hae_id order by ts) - ts) as sec from hr),
  st as (select iv.hae_id, sec, greatest(0, least(1, (bpm - r) / nullif(most - r, 0))) as x from iv join base on iv.hae_id = base.hae_id where sec > 0),
  su as (select hae_id, sum(sec / 60.0 * x * 0.64 * exp(1.92 * x)) as raw, sum(sec) as total from st group by 1),
  av as (select *, greatest(0, least(1, (avg_hr - r) / nullif(most - r, 0))) as x from base),
  trimp as (select av.hae_id, day, coalesce(raw * case when duration_s > 0 then duration_s / total else 1 end, duration_s / 60.0 * x * 0.64 * exp(1.92 * x), 0) as trimp from av left join su on av.hae_id = su.hae_id)"""
EDWARDS = f"""e1 as (select hae_id, bpm, greatest(0, coalesce(epoch(lead(ts) over (partition by hae_id order by ts) - ts), 0)) as sec from hr),
  e2 as (select hae_id, count(*) as n, sum(sec) as total, sum(sec / 60.0 * ((bpm / {HR_MAX} >= 0.5)::int + (bpm / {HR_MAX} >= 0.6)::int + (bpm / {HR_MAX} >= 0.7)::int + (bpm / {HR_MAX} >= 0.8)::int + (bpm / {HR_MAX} >= 0.9)::int)) as raw from e1 group by 1),
  ed as (select w.hae_id, case when n >= 2 and total > 0 then raw * case when duration_s > 0 then duration_s / total else 1 end else 0.0 end as edwards from workouts w left join e2 on w.hae_id = e2.hae_id)"""
REST = f"""rg as (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from resting),
  rd as (select rg.day, value from rg left join resting on rg.day = resting.day),
  rr as (select day, case when count(value) over w >= 7 then quantile_cont(value, 0.5) over w end as rest from rd window w as (order by day rows between 27 preceding and current row))"""
WDAILY = f"""wd as (select {_day('start_time')} as day, w.*, e.edwards from workouts w left join ed e on w.hae_id = e.hae_id where start_time is not null),
  wr as (select wd.*, coalesce(rest, 60) as r from wd left join rr on wd.day = rr.day),
  wx as (select *, greatest(0, least(1, (avg_hr - r) / ({HR_MAX} - r))) as x from wr)"""
WSUM = """sum(case when duration_s > 0 then duration_s / 60.0 * x * 0.64 * exp(1.92 * x) else 0 end) as trimp, sum(active_energy_kcal) as load, sum(edwards) as edwards, sum(duration_s / 3600.0) as duration_h, count(*) as count, avg(intensity) as intensity"""
LAGS = f"""{ORDERS}, names as (select distinct series from o_series),
  cand as (select a.series as a, b.series as b, l.lag::int as lag from names a, names b, (select unnest(range(0, 4)) as lag) l where a.series <> b.series and (l.lag > 0 or a.series < b.series)),
  met as (select a, b, lag, x.day, x.value as x, y.value as y from cand join o_series x on x.series = a join o_series y on y.series = b and y.day = x.day + lag),
  ok as (select a, b, lag, count(*) as n, min(day) as window_start, max(day) as window_end from met group by 1, 2, 3
    having count(*) >= 42 and min(x) < max(x) and min(y) < max(y) and count(*) filter (x <> 0) >= 10 and count(*) filter (y <> 0) >= 10),
  rk as (select a, b, lag, rank() over (partition by a, b, lag order by x) + (count(*) over (partition by a, b, lag, x) - 1) / 2.0 as rx, rank() over (partition by a, b, lag order by y) + (count(*) over (partition by a, b, lag, y) - 1) / 2.0 as ry from met),
  sp as (select a, b, lag, coef, n, window_start, window_end from (select a, b, lag, corr(rx, ry) as coef from rk group by 1, 2, 3) join ok using (a, b, lag))"""
HREV = "hr_ev as (select ts, avg(50 + least(value, 140.0)) as bpm from events group by 1), step_ev as (select ts, max(value) as steps from events where event_type = 'click' group by 1), iv as (select ts as s, ts + interval 600 second as e from events where event_type = 'purchase')"
TIMELINE = f"""{HREV}, per_day as (select ts::date as day, 55 + count(*) % 11 as rest, (count(*) % 5) / 2.0 - 1.0 as hrv_z from events group by 1),
  t1 as (select h.ts, h.bpm, {_day('h.ts')} as day, steps, exists (select 1 from iv where h.ts >= iv.s and h.ts < iv.e) as wo from hr_ev h left join step_ev s on h.ts = s.ts),
  t2 as (select t1.*, coalesce(rest, 60.0) as r, greatest(0.7, least(1.3, 1 - 0.3 * coalesce(hrv_z, 0.0))) as mod from t1 left join per_day p on t1.day = p.day),
  t3 as (select *, wo or coalesce(steps >= 60, false) as act, case when {HR_MAX} > r then greatest(0, least(100, 100 * greatest(0, least(1, (bpm - r) / (0.5 * ({HR_MAX} - r)))) * mod)) end as raw from t2),
  tl as (select ts, day, case when not act then round_even(raw, 0)::int end as stress, bpm as hr, case when act then 'active' when raw is null then 'unmeasurable' when raw < 25 then 'rest' when raw < 50 then 'low' when raw < 75 then 'medium' else 'high' end as state from t3)"""
NAPS = "naps as (select ts as s, ts + interval 40 minute as e, (user_id % 4 + 1) / 4.0 as eff from events where event_type = 'signup')"
RATES = f"""{TIMELINE}, {NAPS}, d1 as (select *, epoch(lead(ts) over (order by ts) - ts) / 60.0 as gap from tl),
  d2 as (select *, case when gap is null then 1.0 else least(gap, 10.0) end as dwell, (select arg_min(eff, (s, e)) from naps where d1.ts >= s and d1.ts < e) as eff from d1),
  d3 as (select ts, dwell, case when eff is not null then 0.15 * case when eff > 0 then least(eff, 1.0) else 1.0 end when state = 'active' then -0.3 when state = 'unmeasurable' or stress is null then 0.0
    when stress > 25 then -0.2 * (stress - 25) / 75.0 else 0.03 * (25 - stress) / 25.0 end as rate from d2),
  d4 as (select ts, dwell, rate, rate * dwell as delta from d3)"""
_FIRSTS = [n for x in NAMES.values() for n in x] + ["  Outdoor   Run ", "Unknown Sport", "LAUFEN"]
_LIST = "[" + ", ".join(f"'{n}'" for n in _FIRSTS) + "]"
ONAMES = f"""onames as (select o_orderkey, ({_LIST})[o_orderkey % {len(_FIRSTS)} + 1] as name from orders), dim(key, canonical_type) as (values {_values([(n, t) for t, x in NAMES.items() for n in x])}),
  typed as (select o_orderkey, name, canonical_type from onames left join dim on lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) = key)"""
UNITS = f"""reg(metric, canon, lo, hi) as (values {_values([(r[0], r[1], r[5], r[6]) for r in registry_rows()])}),
  u0 as (select event_id, (['active_energy', 'step_count', 'heart_rate', 'mystery'])[event_id % 4 + 1] as metric, (['kJ', 'kcal', 'count', 'count/min', null])[event_id % 5 + 1] as unit, value as qty from events),
  u1 as (select u0.*, canon, lo, hi, canon is not null and unit is not null and unit <> canon as differs, case when unit = 'kJ' and canon = 'kcal' then 0.2390057361 when unit = 'kcal' and canon = 'kJ' then 1 / 0.2390057361 end as f from u0 left join reg using (metric)),
  u2 as (select event_id, metric, case when differs and f is null then unit else coalesce(canon, unit, '') end as unit, differs and f is null as flagged, qty * coalesce(f, 1) as qty, lo, hi from u1)"""
HALVES = """h0 as (select date_trunc('hour', ts) as time, event_type as metric, value, epoch_us(ts) as seq from events),
  stored as (select * from h0 where seq % 3 <> 0), fresh as (select * from h0 where seq % 3 = 0)"""


def _trailing(days: int, how: str) -> str:
    return f"{BASE}, l as (select series, max(day) as m from observed group by 1) select observed.series, round({how}(value), 2) as value from observed join l on observed.series = l.series where day > m - {days} group by 1"


def _wdaily(extra: str = "") -> str:
    q = f"with {WORKOUTS}, {HR}, {RESTING}, {EDWARDS}, {REST}, {WDAILY}, s as (select day{extra}, {WSUM} from wx group by day{extra})"
    return f"{q} select day{extra}, round(trimp, 6) as trimp, round(load, 6) as load, round(edwards, 6) as edwards, round(duration_h, 6) as duration_h, count, round(intensity, 6) as intensity from s"


ACWR = f"""{LOADS}, aw as (select series, day, avg(value) over (partition by series order by day rows between 6 preceding and current row) as acute, avg(value) over (partition by series order by day rows between 27 preceding and current row) as chronic,
  row_number() over (partition by series order by day) as n from loads), ac as (select series, day, acute, chronic, acute / chronic as ratio from aw where n >= 28 and chronic > 0)"""
EWMA = f"""{LOADS}, num as (select *, row_number() over (partition by series order by day) as i from loads),
  ew(series, i, day, ctl, atl) as (select series, i, day, value / 42.0, value / 7.0 from num where i = 1
    union all select n.series, n.i, n.day, e.ctl + (n.value - e.ctl) / 42.0, e.atl + (n.value - e.atl) / 7.0 from ew e join num n on n.series = e.series and n.i = e.i + 1)"""
FOUND = f"""{ZSCORE}, {GLOBAL}, {LAGS[len(ORDERS) + 2:]}, {ACWR[len(ORDERS) + 2:]},
  fnd as (select 'anomaly' as kind, series as metric_a, null::varchar as metric_b, null::int as lag_days, day, round(z, 4) as z, round(value, 4) as v, null::double as ratio, null::double as coef from zs where abs(z) > 2.5
    union all select 'training_load', series, null, null, day, null, null, round(ratio, 4), null from ac where ratio > 1.5
    union all select 'correlation', a, b, lag, window_end, null, null, null, round(coef, 4) from sp)"""


def _text(x: str, n: int) -> str:
    return f"cast(cast(round(cast({x} as decimal(20,8)), {n}) as decimal(20,{n})) as varchar)"


DOMAIN = lambda c: f"case {c} when '1-URGENT' then 'sleep' when '2-HIGH' then 'autonomic' when '3-MEDIUM' then 'activity' when '4-NOT SPECIFIED' then 'env' else 'hr_rate' end"



def _wseries(loads: list[str]) -> str:
    """Series of all sessions (loads, duration, count, intensity) and the loads of each type, over the days they span."""
    totals = [(x, x) for x in loads] + [("duration", "duration_h"), ("count", "count"), ("intensity", "intensity")]
    rows = [f"select 'workout_{n}' as series, day, {c}::double as value from al" for n, c in totals] + [f"select 'workout_{n}_' || canonical_type, day, {n} from ty" for n in loads]
    return f"""with {WORKOUTS}, {HR}, {RESTING}, {EDWARDS}, {REST}, {WDAILY}, al as (select day, {WSUM} from wx group by day), ty as (select day, canonical_type, {WSUM} from wx group by day, canonical_type),
      lo as (select * from ({' union all '.join(rows)}) where value is not null), us as (select series from lo group by series having series not like 'workout_edwards%' or max(value) > 0),
      gr as (select series, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from lo where series in (select series from us) group by series)
      select gr.series, gr.day, round(case when gr.series = 'workout_intensity' then value else coalesce(value, 0) end, 6) as value from gr left join lo on gr.series = lo.series and gr.day = lo.day"""


def _stress_pass(key: str = "") -> str:
    """Buckets (sp_b) and days (sp_d) of the whole history, of each ``key`` if there is one."""
    k, on = (f"{key}, ", f"{key}, ") if key else ("", "")
    by, part = (f" group by {key}", f"partition by {key} ") if key else ("", "")
    same = lambda a, b: f"{a}.{key} = {b}.{key} and " if key else ""
    who = "user_id % 3 as subject, " if key else ""
    return f"""sp_v as (select {who}ts as time, case event_type when 'view' then 'hr' when 'purchase' then 'rest' when 'signup' then 'hrv' when 'click' then 'step' end as metric,
      case event_type when 'view' then 50 + least(value, 140) when 'purchase' then 45 + value % 20 else value end as qty from events),
    sp_hr as (select {k}time as ts, avg(qty) as bpm from sp_v where metric = 'hr' group by {on}time),
    sp_st as (select {k}time as ts, max(qty) as steps from sp_v where metric = 'step' group by {on}time),
    sp_w as (select {who}ts as s, ts + interval 600 second as e from events where event_type = 'purchase'),
    sp_rv as (select {k}{_day('time')} as day, avg(qty) as value from sp_v where metric = 'rest' group by {on}{_day('time')}),
    sp_hv as (select {k}{_day('time')} as day, avg(qty) as value from sp_v where metric = 'hrv' group by {on}{_day('time')}),
    sp_mx as (select {k}greatest(160, least(210, max(qty))) as mx from sp_v where metric = 'hr'{by}),
    sp_us as (select {k}median(value) as us from sp_rv{by}),
    sp_ga as (select {k}epoch(ts - lag(ts) over ({part}order by ts)) as gap from sp_st where ts between (select min(ts) from sp_hr) and (select max(ts) from sp_hr) + interval 1 second),
    sp_fi as (select {k}coalesce(median(gap) <= 120, false) as fine from sp_ga{by}),
    sp_z1 as (select {k}day, value, array_agg(value) over ({part}order by day rows between 28 preceding and 1 preceding) as w from sp_hv),
    sp_z2 as (select {k}day, value, w, case when len(w) = 28 then list_median(w) end as m from sp_z1),
    sp_z3 as (select *, case when m is not null then list_median(list_transform(w, lambda x: abs(x - m))) end as d from sp_z2),
    sp_z as (select {k}day, case when d > 0 then 0.6745 * (value - m) / d end as hrv_z from sp_z3),
    sp_rg as (select {k}unnest(generate_series(min(day), max(day), interval 1 day))::date as day from sp_rv{by}),
    sp_rd as (select g.*, value from sp_rg g left join sp_rv v on {same('g', 'v')}g.day = v.day),
    sp_rr as (select {k}day, case when count(value) over w >= 7 then quantile_cont(value, 0.5) over w end as rest from sp_rd window w as ({part}order by day rows between 27 preceding and current row)),
    sp_j as (select h.*, {_day('h.ts')} as day, coalesce(rest, us, 60) as r, mx, coalesce(hrv_z, 0) as z, exists (select 1 from sp_w w where {same('w', 'h')}h.ts >= w.s and h.ts < w.e) as workout,
        coalesce(fine and steps >= 60, false) as walking from sp_hr h join sp_mx m on {same('h', 'm')}true left join sp_us u on {same('h', 'u')}true left join sp_fi f on {same('h', 'f')}true
        left join sp_st s on {same('h', 's')}h.ts = s.ts left join sp_rr q on {same('h', 'q')}q.day = {_day('h.ts')} left join sp_z z on {same('h', 'z')}z.day = {_day('h.ts')}),
    sp_x as (select *, case when mx > r and bpm is not null then greatest(0, least(100, 100 * greatest(0, least(1, (bpm - r) / (0.5 * (mx - r)))) * greatest(0.7, least(1.3, 1 - 0.3 * z)))) end as raw from sp_j),
    sp_b as (select {k}ts, day, case when workout or walking then null else round_even(raw, 0)::int end as stress, bpm as hr,
        case when workout or walking then 'active' when raw is null then 'unmeasurable' when raw < 25 then 'rest' when raw < 50 then 'low' when raw < 75 then 'medium' else 'high' end as state from sp_x),
    sp_g as (select *, epoch(lead(ts) over (partition by {on}day order by ts) - ts) / 60.0 as gap from sp_b),
    sp_w2 as (select *, case when gap is null then 1.0 else least(gap, 10.0) end as dwell, case when gap is null then 0.0 else greatest(gap - 10.0, 0) end as excess from sp_g),
    sp_d0 as (select {k}day, {', '.join(f"sum(case when state = '{x}' then dwell else 0 end) as {x}_min" for x in ('rest', 'low', 'medium', 'high', 'active'))},
        sum(case when state = 'unmeasurable' then dwell else 0 end) + sum(excess) as unmeasurable_min, sum(case when stress is not null then dwell else 0 end) as measured_min, sum(stress * dwell) as total from sp_w2 group by {on}day),
    sp_d as (select d.*, total / measured_min as score, hrv_z from sp_d0 d left join sp_z z on {same('d', 'z')}d.day = z.day where measured_min >= 60)"""


_SPD = ", ".join(f"round_even({x}_min, 0)::int as {x}_min" for x in ("rest", "low", "medium", "high", "active", "unmeasurable"))
_ENERGY_PASS = f"""{_stress_pass()}, naps as (select ts as s, ts + interval 40 minute as e, (user_id % 4 + 1) / 4.0 as eff from events where event_type = 'signup'),
  ep_a as (select stress from sp_b where stress is not null and ts >= (select max(ts) from sp_b) - interval 60 day and not exists (select 1 from naps where sp_b.ts >= s and sp_b.ts < e)),
  ep_n as (select case when count(*) >= 1440 then greatest(5, least(50, round_even(quantile_cont(stress, 0.4), 1))) else 25.0 end::double as neutral from ep_a),
  ep_g as (select *, epoch(lead(ts) over (order by ts) - ts) / 60.0 as gap, (select arg_min(eff, (s, e)) from naps where sp_b.ts >= s and sp_b.ts < e) as eff from sp_b),
  ep_r as (select ts, day, state, case when gap is null then 1.0 else least(gap, 10.0) end * case when eff is not null then 0.15 * case when eff > 0 then least(eff, 1) else 1 end when state = 'active' then -0.3
      when state = 'unmeasurable' or stress is null then 0 when stress > neutral then -0.2 * (stress - neutral) / (100 - neutral) else 0.03 * (neutral - stress) / neutral end as delta from ep_g, ep_n),
  ep_i as materialized (select ts, delta, row_number() over (order by ts) as i from ep_r),
  ep_f(i, ts, level) as (select i, ts, greatest(0, least(100, 50 + delta))::double from ep_i where i = 1 union all select n.i, n.ts, greatest(0, least(100, level + n.delta))::double from ep_f f join ep_i n on n.i = f.i + 1),
  ep_w as (select {_day('e')} as day, arg_max(e, (epoch(e - s), -epoch_us(s))) as wake from naps group by 1),
  ep_l as (select ts, level, {_day('ts')} as day from ep_f), ep_x as (select l.*, level - lag(level) over (partition by l.day order by ts) as diff, wake from ep_l l left join ep_w w on l.day = w.day),
  ep_k as (select {_day('ts')} as day from sp_b where state <> 'unmeasurable' group by 1 having count(*) >= 60)"""

# Two-sided Student tail of whole degrees of freedom: a finite sum of powers of the cosine (Abramowitz and Stegun, 26.7.3 and 26.7.4).
P_VALUES = f"""{LAGS}, pv0 as (select *, n - 2 as nu, atan(abs(coef) / sqrt((1 - coef) * (1 + coef))) as th from sp),
  pv1 as (select *, list_reduce(range(1, case when nu % 2 = 0 then nu // 2 else (nu - 1) // 2 end), lambda s, j: {{'t': s.t * case when nu % 2 = 0 then (2 * j - 1) / (2.0 * j) else 2 * j / (2.0 * j + 1) end * cos(th) * cos(th),
    's': s.s + s.t * case when nu % 2 = 0 then (2 * j - 1) / (2.0 * j) else 2 * j / (2.0 * j + 1) end * cos(th) * cos(th)}}, {{'t': 1.0::double, 's': 1.0::double}}).s as su from pv0),
  pv as (select * exclude (nu, th, su), greatest(0, 1 - case when nu % 2 = 0 then sin(th) * su else 2 / pi() * (th + sin(th) * cos(th) * su) end) as p from pv1)"""

ORACLE_SQL = {
    "corr_p_values": f"with {P_VALUES} select a, b, lag, round(p, 6) as p_value from pv",
    "findings_correlation": f"""with {P_VALUES}, pr as (select *, row_number() over (order by p, a, b, lag) as rn, count(*) over () as m from pv),
      pa as (select *, least(1, min(p * m / rn) over (order by rn desc rows unbounded preceding)) as padj from pr),
      pb as (select * from pa qualify row_number() over (partition by least(a, b), greatest(a, b) order by abs(coef) desc, lag, a) = 1)
      select 'correlation' as kind, a as metric_a, b as metric_b, lag as lag_days, round(coef, 4) as coefficient, round(p, 4) as p_value, round(padj, 4) as p_value_adj, window_start, window_end, round(abs(coef), 4) as severity from pb where coef <> 0""",
    # What was planted is known, so every part of every series of two years or more must come out.
    "stl_planted": f"with {ORDERS} select series, count(*) as days, true as week_ok, true as year_ok, true as noise_ok, true as strength_ok, true as slope_ok from o_series group by series having count(*) >= 730",
    "workout_series": _wseries(["trimp", "load", "edwards"]),
    "workout_series_energy": _wseries(["load"]),
    "stress_pass_buckets": f"with {_stress_pass()} select ts, day, stress, round(hr, 4) as hr, state from sp_b",
    "stress_pass": f"with {_stress_pass()} select day, round_even(score, 1) as score, {_SPD}, round(hrv_z, 4) as hrv_z from sp_d",
    "stress_pass_by_subject": f"with {_stress_pass('subject')} select subject, day, round_even(score, 1) as score, {_SPD}, round(hrv_z, 4) as hrv_z from sp_d",
    "energy_pass": f"""with recursive {_ENERGY_PASS} select x.day, round_even(arg_max(level, ts) filter (ts <= wake), 0)::int as wake_level, round_even(max(level), 0)::int as high_level, round_even(min(level), 0)::int as low_level,
      round_even(sum(greatest(coalesce(diff, 0), 0)), 0)::int as charged, round_even(sum(greatest(-coalesce(diff, 0), 0)), 0)::int as drained from ep_x x join ep_k k on x.day = k.day group by x.day""",
    "daily_metrics": f"with {SAMPLES}, {DAILY} select day, metric, round(avg, 4) as avg, round(min, 4) as min, round(max, 4) as max, round(sum, 4) as sum, n from daily",
    "daily_by_registry": f"{BASE} select series, day, round(value, 4) as value from observed",
    "dense_grid": f"{BASE}, {GRID} select grid.series, grid.day, round(value, 4) as value from grid left join thin on grid.series = thin.series and grid.day = thin.day",
    "zero_fill": f"{BASE}, {GRID} select grid.series, grid.day, round(coalesce(value, 0), 4) as value from grid left join thin on grid.series = thin.series and grid.day = thin.day",
    "sleep_nightly": f"with {SLEEP} select id, sleep_date, source, round(total_sleep_h, 4) as total_sleep_h from nightly",
    "sleep_metrics": f"""with {SLEEP}, c as (select *, coalesce(nullif(in_bed_h, 0), epoch(in_bed_end - in_bed_start) / 3600.0, nullif(coalesce(asleep_h, 0) + coalesce(awake_h, 0), 0)) as calc from nightly)
      select id, sleep_date, round(calc, 4) as in_bed_h_calc, case when total_sleep_h is not null and calc > 0 then cast(round(cast(total_sleep_h / calc * 100 as decimal(18,6)), 1) as double) end as efficiency_pct from c""",
    "sleep_frame": f"with {SLEEP}, {FRAME} select day, round(sleep_total_h, 6) as sleep_total_h, round(sleep_deep_h, 6) as sleep_deep_h, round(sleep_rem_h, 6) as sleep_rem_h, round(bedtime, 6)::double as bedtime, round(sleep_efficiency, 6) as sleep_efficiency from frame",
    "consistency": f"""with {SLEEP}, {FRAME}, long as (select 'sleep_total_h' as series, day, sleep_total_h as value from frame union all select 'bedtime', day, (bedtime::double - 18 + 24) % 24 from frame),
      k as (select * from long where value is not null qualify row_number() over (partition by series order by day desc) <= 14)
      select series, round(stddev_samp(value), 4) as std_hours, min(day) as window_start, max(day) as window_end from k group by series having count(*) = 14""",
    "explorer_categories": f"{BASE} select distinct coalesce(category, 'other') as category from (select distinct metric from samples) left join registry using (metric)",
    "explorer_metrics": f"{BASE} select distinct metric, 'count' as unit, agg from samples join registry using (metric) where category = 'events'",
    "explorer_latest": f"{BASE} select series, max(day) as day, round(arg_max(value, day), 2) as value from observed group by series",
    "explorer_7d_avg": _trailing(7, "avg"),
    "explorer_30d_min": _trailing(30, "min"),
    "explorer_30d_max": _trailing(30, "max"),
    "moving_avg_7": f"{BASE} select series, day, round(value, 4) as value, round(avg(value) over (partition by series order by day rows between 6 preceding and current row), 4) as moving_avg from observed",
    "daily_band": f"with {SAMPLES}, {DAILY} select day, metric, round(min, 4) as min, round(avg, 4) as avg, round(max, 4) as max from daily",
    "sample_counts": f"with {SAMPLES} select {_day('time')} as day, metric, count(*) as n from samples group by 1, 2",
    "raw_top500": f"with {SAMPLES} select time, metric, source, round(coalesce(vavg, qty), 4) as value from samples order by time desc, metric, source limit 500",
    "json_points": """select event_type as metric, count(*) as n, count(case when event_type <> 'view' then 1 end) as n_qty, count(case when event_type = 'view' then 1 end) as n_avg, 0::bigint as n_min,
      round(sum(value), 2) as total, date_trunc('second', min(ts)) - interval 2 hour as first_time from events group by 1""",
    "unit_normalise": f"with {UNITS} select event_id, metric, unit, flagged, round(qty, 4) as qty from u2",
    "bounds_guard": f"with {UNITS} select metric, flagged, (coalesce(qty < lo, false) or coalesce(qty > hi, false)) and not flagged as implausible, count(*) as n, round(sum(qty), 2) as total from u2 group by all",
    "name_canonical": f"with {ONAMES} select o_orderkey, name, canonical_type from typed",
    "slugify": "select p_partkey, trim(regexp_replace(lower(' ' || p_name || '--' || p_brand || '# '), '[^a-z0-9]+', '_', 'g'), '_') as slug from part",
    "last_wins": f"with {WORKOUTS}, {HR} select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from line",
    "best_wins_sleep": f"with {SLEEP} select id, sleep_end, source, round(total_sleep_h, 4) as total_sleep_h from sleep qualify row_number() over (partition by sleep_end, source order by coalesce(total_sleep_h, -1) desc, id) = 1",
    "collapse_sleep": f"with {SLEEP} select id, sleep_end, source from sleep qualify row_number() over (partition by sleep_end, source order by total_sleep_h desc nulls last, sleep_start asc nulls last, id) = 1",
    "hash_dedup": "select distinct sha256(text) as content_hash from documents",
    "anti_register": f"with {REGISTRY} select distinct event_type as metric, 'count' as unit, 'sum' as agg, null::varchar as category, 'secondary' as tier from events where event_type not in (select metric from registry where agg = 'sum')",
    "upsert_samples": f"""with {HALVES}, u as (select *, 0 as age from stored union all select *, 1 from fresh)
      select time, metric, round(value, 4) as value, seq from u qualify row_number() over (partition by metric, time order by age desc, seq desc) = 1""",
    "upsert_new_count": f"with {HALVES} select metric, count(*) as n_new from (select distinct metric, time from fresh except select metric, time from stored) group by 1",
    "trimp_session": f"with {TRIMP} select hae_id, day, round(trimp, 4) as trimp from trimp",
    "trimp_daily": f"with {TRIMP} select day, round(sum(trimp), 4) as trimp from trimp group by 1",
    "trimp_rest_baseline": f"with {WORKOUTS}, {RESTING}, d as (select distinct start_time::date as day from workouts) select d.day, round(quantile_cont(value, 0.5), 4) as rest from d left join resting r on r.day between d.day - 27 and d.day group by 1",
    "rolling_rest": f"with {RESTING}, {REST} select day, round(rest, 4) as rest from rr",
    "edwards": f"with {WORKOUTS}, {HR}, {EDWARDS} select hae_id, round(edwards, 4) as edwards from ed",
    "workout_daily": _wdaily(),
    "workout_daily_by_type": _wdaily(", canonical_type"),
    "load_by_group": f"""with {WORKOUTS}, grp(canonical_type, display_group, sort) as (values {_values(GROUPS)})
      select date_trunc('week', {_day('start_time')})::date as week, coalesce(display_group, 'Other') as display_group, round(sum(duration_s / 3600.0), 4) as hours, round(sum(distance_km), 4) as distance_km, count(*) as sessions from workouts left join grp using (canonical_type) group by 1, 2""",
    "load_focus": f"""with {WORKOUTS}, {HR}, s as (select hae_id, bpm, epoch(lead(ts) over (partition by hae_id order by ts) - ts) as sec from hr), k as (select * from s where sec > 0),
      p as (select {_day('start_time')} as day, bpm, sec from workouts join k using (hae_id) union all select {_day('start_time')}, avg_hr, duration_s from workouts where hae_id not in (select hae_id from k))
      select day, round(sum(case when bpm / {HR_MAX} >= 0.5 and bpm / {HR_MAX} < 0.8 then sec / 60.0 else 0 end), 4) as low_min, round(sum(case when bpm / {HR_MAX} >= 0.8 and bpm / {HR_MAX} < 0.9 then sec / 60.0 else 0 end), 4) as high_min,
        round(sum(case when bpm / {HR_MAX} >= 0.9 then sec / 60.0 else 0 end), 4) as peak_min from p group by 1""",
    "acwr_history": f"with {ACWR} select series, day, round(acute, 4) as acute, round(chronic, 4) as chronic, round(ratio, 4) as ratio from ac",
    "ewma_status": f"""with recursive {EWMA}, r as (select *, row_number() over (partition by series order by day desc) as rn, count(*) over (partition by series) as n, lead(ctl, 28) over (partition by series order by day desc) as ctl_ago from ew),
      s as (select *, (ctl - atl) / ctl as p from r where rn = 1 and n >= 42 and ctl > 0)
      select series, day, round(ctl, 3) as ctl, round(atl, 3) as atl, round(ctl - atl, 3) as tsb, round(p, 3) as tsb_pct,
        case when p >= 0.15 then 'detraining' when p >= 0.05 then 'fresh' when p > -0.05 then 'neutral' when p > -0.30 then 'productive' else 'overreaching_risk' end as zone, round(ctl_ago, 3) as ctl_ago,
        case when ctl_ago is null then null when ctl_ago <= 0 then 'rising' when ctl / ctl_ago - 1 >= 0.05 then 'rising' when ctl / ctl_ago - 1 <= -0.05 then 'falling' else 'flat' end as ctl_trend from s""",
    "active_days": f"with {LOADS}, k as (select * from loads qualify row_number() over (partition by series order by day desc) <= 28) select series, count(*) filter (value > 0) as active_days from k group by 1",
    "robust_z": f"with {ZSCORE} select series, day, round(value, 4) as value, round(z, 4) as z from zs",
    "anomalies": f"with {ZSCORE}, {GLOBAL} select zs.series, zs.day, round(zs.value, 4) as value, round(z, 4) as z, round(global_z, 4) as global_z from zs join gz on zs.series = gz.series and zs.day = gz.day where abs(z) > 2.5",
    "global_z": f"with {ORDERS}, {GLOBAL} select series, day, round(value, 4) as value, round(global_z, 4) as global_z from gz",
    "recovery_pairs": f"""with {ZSCORE} select a.day, round(a.z, 4) as rest_z, round(b.z, 4) as variability_z, round((a.z - b.z) / 2, 4) as severity from zs a join zs b on a.day = b.day
      where a.series = '1-URGENT' and b.series = '2-HIGH' and a.z >= 0.8 and b.z <= -0.8""",
    "spearman_lags": f"with {LAGS} select a, b, lag, round(coef, 6) as coef, n, window_start, window_end from sp",
    "corr_best_lag": f"""with {LAGS} select a, b, lag, round(coef, 6) as coef, n, window_start, window_end from sp qualify row_number() over (partition by least(a, b), greatest(a, b) order by abs(round(coef, 6)) desc, lag, a) = 1""",
    "bh_fdr": """with c as (select distinct o_orderkey as a, (o_orderkey * 7919 % 100003 + 1) / 100004.0 as p from orders),
      r as (select *, row_number() over (order by p, a) as rn, count(*) over () as m from c)
      select a, round(p, 6)::double as p_value, round(least(1, min(p * m / rn) over (order by rn desc rows unbounded preceding)), 6)::double as p_adj from r""",
    "trend_slope": f"with {ORDERS} select series, round(regr_slope(value, epoch(day) / 86400), 4) as slope_per_day from o_series group by 1",
    "monotonicity": f"""with {ORDERS}, r as (select series, value, rank() over (partition by series order by day) as rt, rank() over (partition by series order by value) + (count(*) over (partition by series, value) - 1) / 2.0 as rv from o_series)
      select series, case when min(value) < max(value) then round(abs(corr(rt, rv)), 6) end as monotonicity from r group by 1""",
    "month_profile_repro": f"""with {ORDERS}, mp as (select series, year(day) as y, month(day) as m, avg(value) as v from o_series group by 1, 2, 3),
      pr as (select a.series, a.y, b.y as y2, a.v, b.v as v2 from mp a join mp b on a.series = b.series and a.m = b.m and a.y < b.y),
      rk as (select *, rank() over (partition by series, y, y2 order by v) + (count(*) over (partition by series, y, y2, v) - 1) / 2.0 as ra, rank() over (partition by series, y, y2 order by v2) + (count(*) over (partition by series, y, y2, v2) - 1) / 2.0 as rb from pr),
      c as (select series, y, y2, corr(ra, rb) as c from rk group by 1, 2, 3 having count(*) >= 6 and min(v) < max(v) and min(v2) < max(v2)) select series, round(avg(c), 4) as reproducibility from c group by 1""",
    "interpolate_gaps": f"""with {LOADS}, g as (select o_grid.series, o_grid.day, s.value from o_grid left join o_series s on o_grid.series = s.series and o_grid.day = s.day),
      b as (select *, last_value(case when value is not null then day end ignore nulls) over p as pd, last_value(value ignore nulls) over p as pv, first_value(case when value is not null then day end ignore nulls) over n as nd, first_value(value ignore nulls) over n as nv from g
        window p as (partition by series order by day rows between unbounded preceding and current row), n as (partition by series order by day rows between current row and unbounded following))
      select series, day, round(coalesce(value, pv + (nv - pv) * (day - pd) / (nd - pd)), 4) as value, value is not null as observed from b""",
    "stress_intraday": f"with {TIMELINE} select ts, day, stress, round(hr, 4) as hr, state from tl",
    "stress_daily": f"""with {TIMELINE}, g as (select *, epoch(lead(ts) over (partition by day order by ts) - ts) / 60.0 as gap from tl), d as (select *, case when gap is null then 1.0 else least(gap, 10.0) end as dwell, case when gap is null then 0.0 else greatest(gap - 10.0, 0) end as excess from g)
      select day, round(sum(case when state = 'rest' then dwell else 0 end), 3) as rest_min, round(sum(case when state = 'low' then dwell else 0 end), 3) as low_min, round(sum(case when state = 'medium' then dwell else 0 end), 3) as medium_min,
        round(sum(case when state = 'high' then dwell else 0 end), 3) as high_min, round(sum(case when state = 'active' then dwell else 0 end), 3) as active_min, round(sum(case when state = 'unmeasurable' then dwell else 0 end) + sum(excess), 3) as unmeasurable_min,
        round(sum(case when stress is not null then dwell else 0 end), 3) as measured_min, round(sum(stress * dwell) / nullif(sum(case when stress is not null then dwell else 0 end), 0), 3) as score from d group by day""",
    "interval_semi": f"with {HREV}, x as (select ts, exists (select 1 from iv where hr_ev.ts >= iv.s and hr_ev.ts < iv.e) as inside from hr_ev) select ts::date as day, inside, count(*) as n from x group by 1, 2",
    "interval_value": f"with {HREV}, {NAPS} select ts, arg_min(eff, (s, e))::double as eff from hr_ev join naps on ts >= s and ts < e group by ts",
    "steps_gate": f"with {HREV}, g as (select epoch(ts - lag(ts) over (order by ts)) as gap from step_ev) select median(gap) as median_gap, coalesce(median(gap) <= 120, false) as fine from g",
    "merged_intervals": f"""with {HREV}, o as (select s, e, max(e) over (order by s, e rows between unbounded preceding and 1 preceding) as m from iv), i as (select *, sum(case when m is null or s > m then 1 else 0 end) over (order by s, e) as k from o)
      select min(s) as start, max(e) as end from i group by k""",
    "auto_neutral": f"""with {TIMELINE}, {NAPS}, a as (select stress, ts from tl where stress is not null and not exists (select 1 from naps where tl.ts >= s and tl.ts < e)),
      q as (select count(*) as n, quantile_cont(stress, 0.4) as p from a where ts >= (select max(ts) from tl) - interval 60 day) select case when n >= 1440 then greatest(5, least(50, round_even(p, 1))) else 25.0 end::double as neutral from q""",
    "battery_rates": f"with {RATES} select ts, round(rate, 4)::double as rate, round(dwell, 4) as dwell, round(delta, 4) as delta from d4",
    "battery_levels": f"""with recursive {RATES}, n as (select ts, delta, row_number() over (order by ts) as i from d4),
      f(i, ts, level) as (select i, ts, greatest(0, least(100, 50 + delta)) from n where i = 1 union all select n.i, n.ts, greatest(0, least(100, level + n.delta)) from f join n on n.i = f.i + 1)
      select ts, round(level, 3)::double as level from f""",
    "battery_daily": f"""with recursive {RATES}, n as (select ts, delta, row_number() over (order by ts) as i from d4),
      f(i, ts, level) as (select i, ts, greatest(0, least(100, 50 + delta))::double from n where i = 1 union all select n.i, n.ts, greatest(0, least(100, level + n.delta))::double from f join n on n.i = f.i + 1),
      wk as (select {_day('e')} as day, arg_max(e, (epoch(e - s), -epoch_us(s))) as wake from naps group by 1),
      l as (select *, {_day('ts')} as day from f), x as (select l.*, level - lag(level) over (partition by l.day order by ts) as diff, wake from l left join wk on l.day = wk.day)
      select day, round(max(level), 2) as high_level, round(min(level), 2) as low_level, round(sum(greatest(coalesce(diff, 0), 0)), 2) as charged, round(sum(greatest(-coalesce(diff, 0), 0)), 2) as drained, round(arg_max(level, ts) filter (ts <= wake), 2) as wake_level from x group by day""",
    "coverage_audit": f"""{BASE}, h as (select metric, count(*) as days, min(day) as a, max(day) as b from daily group by 1)
      select coalesce(h.metric, r.metric) as metric, case when r.metric is null then 'secondary' else 'core' end as tier, coalesce(days, 0) as days, a as first_day, b as last_day, (b - a + 1)::int as span_days, round(days / (b - a + 1), 4) as density,
        case when coalesce(days, 0) = 0 then 'none' when days < 42 then 'below' else 'ready' end as readiness from h full join registry r on h.metric = r.metric""",
    "unit_audit": "select event_type as metric, 'count' as canonical, list_sort(list_distinct(list(case when user_id % 10 = 3 then 'other' else 'count' end))) as units from events group by 1 having bool_or(user_id % 10 = 3)",
    "unmapped": f"with {ONAMES} select name, count(*) as n from typed where canonical_type is null group by 1",
    "payload_census": "with g as (select count(*) as n from lineitem group by l_orderkey) select 'heartRateData' as field, count(*) as sessions, min(n)::int as least, max(n)::int as most, floor(quantile_cont(n, 0.5))::int as median from g",
    "findings_feed": f"""with {FOUND} select kind, metric_a, metric_b, lag_days, day, case kind when 'anomaly' then {_text('z', 1)} || 'σ (val: ' || {_text('v', 2)} || ')' when 'training_load' then 'ACWR ' || {_text('ratio', 2)}
      else 'r=' || {_text('coef', 2)} || ' lag=' || lag_days || 'd' end as detail from fnd""",
    "findings_labelled": f"""with {FOUND}, nm as (select p, case p when '1-URGENT' then 'Urgent' when '2-HIGH' then 'High' when '3-MEDIUM' then 'Medium' when '4-NOT SPECIFIED' then 'Not Specified' else p end as label from (select distinct o_orderpriority as p from orders))
      select kind, metric_a, x.label as metric_a_label, metric_b, y.label as metric_b_label, lag_days, day from fnd left join nm x on x.p = metric_a left join nm y on y.p = metric_b where kind = 'correlation' or day >= date '1998-01-01'""",
    "findings_by_kind": f"with {FOUND} select kind, count(*) as count from fnd group by 1",
    "alert_markers": f"with {FOUND} select kind, count(distinct day) as n from fnd where kind <> 'correlation' group by 1",
    "priority_rank": f"""with {LAGS}, d as (select *, {DOMAIN('a')} as da, {DOMAIN('b')} as db from sp),
      t as (select *, case when (da = db and da in ('sleep', 'hr_rate', 'activity')) or (da = 'hr_rate' and db = 'activity') or (db = 'hr_rate' and da = 'activity') or (da = 'env' and db = 'activity') or (db = 'env' and da = 'activity') then 0
        when da in ('sleep', 'autonomic', 'hr_rate', 'vital', 'activity') and db in ('sleep', 'autonomic', 'hr_rate', 'vital', 'activity') then 2 else 1 end as tier from d)
      select a, b, lag, da, db, tier, round(10 * tier + abs(coef) + 0.05 * least(lag, 3), 5)::double as priority from t""",
    "projected_decay": f"""with recursive {EWMA}, l as (select * from ew qualify row_number() over (partition by series order by day desc) = 1)
      select series, k::int as k, round(ctl * pow(1 - 1 / 42.0, k), 3) as ctl, round(atl * pow(1 - 1 / 7.0, k), 3) as atl from l, (select unnest(range(1, 31)) as k)""",
    "metric_domains": """with d(series, domain, volume) as (values
        ('sleep_total_h', 'sleep', false), ('respiratory_rate', 'autonomic', false), ('heart_rate_variability', 'autonomic', false), ('cardio_recovery', 'autonomic', false),
        ('heart_rate', 'hr_rate', false), ('resting_heart_rate', 'hr_rate', false), ('walking_heart_rate_average', 'hr_rate', false),
        ('vo2_max', 'vital', false), ('apple_sleeping_wrist_temperature', 'vital', false), ('weight_body_mass', 'vital', false), ('blood_oxygen_saturation', 'vital', false), ('body_temperature', 'vital', false), ('breathing_disturbances', 'vital', false),
        ('physical_effort', 'activity', false), ('time_in_daylight', 'env', false), ('step_count', 'activity', true), ('active_energy', 'activity', true),
        ('workout_trimp', 'activity', true), ('workout_intensity', 'activity', true), ('workout_duration', 'activity', true), ('workouts', 'other', false), ('environmental_audio_exposure', 'other', false)) 
      , n as (select row_number() over () as i, * from d), p as (select p_partkey % (select count(*) from d) + 1 as i, count(*) as n from part group by 1) select series, domain, volume, p.n::bigint as n from n join p using (i)""",
}
