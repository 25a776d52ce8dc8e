"""The catalogue's queries once more, as plain SQL over the same tables.

Written from the rules, with whole-group windows and joins: no blocks, no
salting. Agreement with it is what shows that the distributed forms are exact.
"""

from __future__ import annotations

from tallyspark.fixed_values import USAGE_LIMIT_ID
from tallyspark.plans.parameters import (
    AS_OF_SQL,
    DAY_START_SQL,
    NEWER_PRICE_ROWS,
    PRICE_ROWS,
    REFRESH_SECONDS,
    STALE_NANOS,
)
from tallyspark.sources.derived_logs import CHANGE_RULE, HOME_NAME
from tallyspark.sources.event_feed import (
    FILE_RULE,
    OVERLAP_FROM,
    OVERLAP_TO,
    PROVIDER_RULE,
    RESUME_DAY,
    SPLIT_DAY,
    feed_sql,
    nanos_literal,
)

SIG_FIELDS = ("input", "cached_input", "cache_write_input", "output", "reasoning_output", "total")


def _ts(text: str) -> str:
    return nanos_literal(text, "duckdb")


def _sig() -> str:
    return " || '|' || ".join(
        f"coalesce(cast({side}_{name} as varchar), '-')" for side in ("total", "last") for name in SIG_FIELDS
    )


TIER_KIND = (
    "case tier_raw when 'default' then 'standard' when 'standard' then 'standard' when 'priority' then 'fast' "
    "when 'fast' then 'fast' when 'ultrafast' then 'ultrafast' else case when tier_raw is not null then 'unknown' end end"
)

LINES_PLAIN = f"lines as (select *, 'u' || user_id as path from ({feed_sql('duckdb')}) feed)"

LINES_VARIANT = f"""ruled as (select *, {FILE_RULE} as rule from ({feed_sql('duckdb')}) feed),
placed as (
  select *, 'u' || user_id as path, 0 as shift from ruled where not (rule = 'resume' and ts_nanos >= {_ts(RESUME_DAY)})
  union all select *, 'u' || user_id || '/copy', 0 from ruled where rule = 'copy' and ts_nanos < {_ts(SPLIT_DAY)}
  union all select *, 'u' || user_id || '/next', 0 from ruled where rule = 'resume' and ts_nanos >= {_ts(RESUME_DAY)}
  union all select *, 'u' || user_id || '/over', 1 from ruled
    where rule = 'overlap' and ts_nanos >= {_ts(OVERLAP_FROM)} and ts_nanos < {_ts(OVERLAP_TO)}
  union all select *, 'c' || user_id, case when ts_nanos <= {_ts(SPLIT_DAY)} then 0 else 1 end from ruled
    where rule = 'fork' and (ts_nanos > {_ts(SPLIT_DAY)} or k % 31 <> 0)),
lines as (select * replace (total_input + shift as total_input, total_total + shift as total_total) from placed)"""

EVENTS = f"""settled as (
  select *, last_value(model_set ignore nulls) over f as model,
    last_value(case when sets_tier then {{'kind': {TIER_KIND}, 'text': tier_raw}} end ignore nulls) over f as tier
  from lines window f as (partition by home, path order by line_no rows between unbounded preceding and current row)),
ev as (
  select *, tier.kind as tier_kind, tier.text as tier_text, {_sig()} as sig,
    coalesce(total_total, coalesce(total_input, 0) + coalesce(total_output, 0)) as teff,
    coalesce(last_total, coalesce(last_input, 0) + coalesce(last_output, 0)) as leff,
    coalesce(primary_percent >= 99.99, false) or coalesce(secondary_percent >= 99.99, false) as capped
  from settled where is_token),
tot as (
  select home, path, source, line_no, model, sig, teff,
    case when lag(line_no) over w is null or model is distinct from lag(model) over w then 1 else 0 end as brk
  from ev where has_total window w as (partition by home, path, source order by line_no)),
runs as (select *, sum(brk) over (partition by home, path, source order by line_no) as run from tot),
peaks as (
  select home, path, line_no, max({{'teff': teff, 'neg': -line_no, 'sig': sig}}) over (
    partition by home, path, source, run order by line_no rows between unbounded preceding and 1 preceding) as pk
  from runs),
past as (
  select e.*, p.pk, lag(e.line_no) over w is not null as has_prev, lag(e.sig) over w as prev_sig,
    lag(e.model) over w as prev_model, lag(e.capped) over w as prev_capped,
    max(case when has_total then total_input end) over b as hw_input,
    max(case when has_total then total_cached_input end) over b as hw_cached,
    max(case when has_total then total_output end) over b as hw_output,
    max(case when has_total then total_total end) over b as hw_total,
    count(case when has_total then 1 end) over b as hw_seen
  from ev e left join peaks p using (home, path, line_no)
  window w as (partition by e.home, e.path order by e.line_no),
    b as (partition by e.home, e.path order by e.line_no rows between unbounded preceding and 1 preceding)),
judged as (
  select *, has_total and (coalesce(pk.sig = sig, false)
      or (has_prev and prev_model is not distinct from model and prev_sig = sig)) as is_duplicate,
    has_total and has_last and coalesce(teff <= pk.teff, false) as not_advanced
  from past),
timeline as (
  select home, path, user_id, line_no, ts_nanos, source, model, tier_kind, tier_text, sig, capped, balance,
    has_total, has_last, is_duplicate, not_advanced and not is_duplicate as is_stale,
    case when has_prev then prev_capped and capped else capped end as overflow,
    case when last_input is null then 'unknown' when last_input <= 272000 then 'short' else 'long' end as band,
    case when has_last then last_input is null or last_output is null
      else total_input is null or total_output is null end as details_missing,
    cast(case when is_duplicate or not_advanced then 0 when has_last then leff
      when hw_seen = 0 then teff
      when total_input is not null or total_output is not null then
        greatest(coalesce(total_input, 0) - coalesce(hw_input, 0), 0) + greatest(coalesce(total_output, 0) - coalesce(hw_output, 0), 0)
      else greatest(teff - coalesce(hw_total, coalesce(hw_input, 0) + coalesce(hw_output, 0)), 0) end as bigint) as delta_total,
    cast(case when is_duplicate or not_advanced then 0
      when has_last then greatest(coalesce(last_input, 0) - coalesce(last_cached_input, 0), 0)
      else greatest(greatest(coalesce(total_input, 0) - coalesce(hw_input, 0), 0)
        - greatest(coalesce(total_cached_input, 0) - coalesce(hw_cached, 0), 0), 0) end as bigint) as delta_uncached,
    cast(case when is_duplicate or not_advanced then 0 when has_last then coalesce(last_cached_input, 0)
      else greatest(coalesce(total_cached_input, 0) - coalesce(hw_cached, 0), 0) end as bigint) as delta_cached,
    cast(case when is_duplicate or not_advanced then 0 when has_last then coalesce(last_output, 0)
      else greatest(coalesce(total_output, 0) - coalesce(hw_output, 0), 0) end as bigint) as delta_output
  from judged)"""


def _price_values(price_rows=PRICE_ROWS, name: str = "prices") -> str:
    def rate(x):
        return "cast(null as double)" if x is None else f"cast({x!r} as double)"

    rows = []
    for model, tier, split, short, long in price_rows:
        has_long = long is not None
        cells = [rate(x) for x in [*short, *(long or (None, None, None))]]
        rows.append(f"('{model}', '{tier}', {str(split).lower()}, {str(has_long).lower()}, {', '.join(cells)})")
    return (
        f"{name}(p_model, p_tier, is_split, has_long, s_in, s_cached, s_out, l_in, l_cached, l_out) as (values "
        + ", ".join(rows)
        + ")"
    )


def priced_ctes(volumes: str = "volumes", price_rows=PRICE_ROWS) -> str:
    """CTEs that price ``volumes`` into ``priced``."""
    return f"""{_price_values(price_rows)},
resolved as (
  select v.*, coalesce(tier_kind, 'standard') as eff_tier,
    case when model in (select p_model from prices) then model
      when regexp_matches(model, '^.+-\\d{{4}}-\\d{{2}}-\\d{{2}}$')
        and try_strptime(right(model, 10), '%Y-%m-%d') is not null
        and left(model, length(model) - 11) in (select p_model from prices) then left(model, length(model) - 11) end as found
  from {volumes} v),
matched as (
  select r.*, p.p_model, p.is_split, p.has_long,
    case when p.is_split and band = 'long' then l_in else s_in end as r_in,
    case when p.is_split and band = 'long' then l_cached else s_cached end as r_cached,
    case when p.is_split and band = 'long' then l_out else s_out end as r_out
  from resolved r left join prices p on p.p_model = r.found and p.p_tier = r.eff_tier),
judged_price as (
  select *, details_missing or uncached <> 0 or cached <> 0 or output <> 0 as used,
    case when details_missing then 'details_missing' when eff_tier = 'unknown' then 'unknown_tier'
      when model is null then 'model_missing'
      when p_model is not null and is_split and band = 'unknown' then 'context_unknown' end as diagnostic,
    case when found is null then 'model' when p_model is null then 'tier'
      when is_split and band = 'long' and not has_long then 'context'
      when uncached <> 0 and r_in is null then 'input'
      when cached <> 0 and r_cached is null then 'cached_input'
      when output <> 0 and r_out is null then 'output' end as gap
  from matched),
priced as (
  select *, case when used then coalesce(diagnostic, gap) end as issue,
    case when used and diagnostic is not null then 'diagnostic' when used and gap is not null then 'gap' end as issue_kind,
    case when used and coalesce(diagnostic, gap) is not null then null else
      case when uncached <> 0 then uncached * r_in / 1e6 else 0 end
      + case when cached <> 0 then cached * r_cached / 1e6 else 0 end
      + case when output <> 0 then output * r_out / 1e6 else 0 end end as cost
  from judged_price)"""


def volumes_cte(keys: str, source: str = "timeline", where: str = "true") -> str:
    return f"""volumes as (
  select {keys}, model, tier_kind, tier_text, band, cast(sum(delta_uncached) as bigint) as uncached,
    cast(sum(delta_cached) as bigint) as cached, cast(sum(delta_output) as bigint) as output,
    bool_or(details_missing) as details_missing
  from {source} where not overflow and delta_total <> 0 and ({where}) group by {keys}, model, tier_kind, tier_text, band)"""


QUOTA = f"""newest as (
  select * from (select *, row_number() over (partition by home order by ts_nanos desc, path desc, line_no desc) as rn
    from lines where primary_percent is not null) where rn = 1),
quota as (
  select home, ts_nanos, plan_type, primary_percent as short_used, 18000 as short_seconds, primary_resets_at as short_resets,
    secondary_percent as long_used, 604800 as long_seconds, secondary_resets_at as long_resets,
    {AS_OF_SQL} - ts_nanos > {STALE_NANOS} as stale,
    primary_resets_at > ({AS_OF_SQL}) // 1000000000 as short_active,
    secondary_resets_at > ({AS_OF_SQL}) // 1000000000 as long_active,
    greatest(0.0, least(100.0, 100.0 - primary_percent)) as short_left,
    greatest(0.0, least(100.0, 100.0 - secondary_percent)) as long_left
  from newest),
boundary as (
  select *, case when not stale and long_active then (long_resets - long_seconds) * 1000000000 end as period_start
  from quota)"""

PLAIN = f"{LINES_PLAIN}, {EVENTS}"
VARIANT = f"{LINES_VARIANT}, {EVENTS}"
TODAY = f"ts_nanos >= {DAY_START_SQL} and ts_nanos < {DAY_START_SQL} + 86400000000000"

SQL: dict[str, str] = {}

SQL["model_carry_forward"] = f"""with {PLAIN}
select home, path, line_no, model from settled"""

SQL["tier_carry_forward"] = f"""with {PLAIN}
select home, path, line_no, tier.kind as tier_kind, tier.text as tier_text from settled"""

SQL["token_deltas"] = f"""with {PLAIN}
select home, path, line_no, is_duplicate, is_stale, delta_total, delta_uncached, delta_cached, delta_output from timeline"""

SQL["dedupe_audit"] = f"""with {PLAIN}
select home, path, cast(count(*) as bigint) as events, cast(count(*) filter (is_duplicate) as bigint) as duplicates,
  cast(count(*) filter (is_stale) as bigint) as stale from timeline group by home, path"""

SQL["usage_volumes"] = f"""with {PLAIN}, {volumes_cte('home')} select * from volumes"""

SQL["overflow_split"] = f"""with {PLAIN}
select home, cast(coalesce(sum(delta_total) filter (not overflow), 0) as bigint) as tokens,
  cast(coalesce(sum(delta_total) filter (overflow), 0) as bigint) as overflow_tokens,
  cast(count(*) filter (capped) as bigint) as capped_events from timeline group by home"""

SQL["credits_debits"] = f"""with {LINES_PLAIN}, steps as (
  select home, balance, lag(balance) over w as prev from lines where balance is not null
  window w as (partition by home order by ts_nanos, path, line_no))
select home, round(coalesce(sum(case when prev - balance > 1e-6 then prev - balance end), 0), 4) as credits_spent
from steps group by home"""

SQL["latest_quota"] = f"""with {LINES_PLAIN}, {QUOTA}
select home, ts_nanos, plan_type, short_used, short_resets, long_used, long_resets from quota"""

SQL["quota_status"] = f"""with {LINES_PLAIN}, {QUOTA}
select home, stale, case when short_active then short_left end as short_remaining,
  case when long_active then long_left end as long_remaining,
  case when stale then 'unknown' when short_active then 'ready' else 'updating' end as short_state,
  case when stale then 'unknown' when long_active then 'ready' else 'updating' end as long_state,
  (short_active and short_left <= 0) or (long_active and long_left <= 0) as blocked,
  case when stale or not (short_active or long_active) then null
    when (short_active and short_left <= 0) or (long_active and long_left <= 0) then 0.0
    when short_active then short_left else long_left end as headline,
  case when not short_active then null when short_left >= 50 then 'healthy' when short_left >= 20 then 'warning' else 'critical' end as short_colour
from quota"""

SQL["today_usage"] = f"""with {PLAIN}
select home, cast(coalesce(sum(delta_total) filter (not overflow), 0) as bigint) as tokens,
  cast(coalesce(sum(delta_total) filter (overflow), 0) as bigint) as overflow_tokens
from timeline where {TODAY} group by home"""

SQL["period_usage"] = f"""with {PLAIN}, {QUOTA}
select t.home, any_value(period_start) as period_start_nanos,
  cast(coalesce(sum(delta_total) filter (not overflow), 0) as bigint) as tokens,
  cast(coalesce(sum(delta_total) filter (overflow), 0) as bigint) as overflow_tokens
from timeline t join boundary b using (home) where t.ts_nanos >= period_start group by t.home"""

SQL["cache_hit_rate"] = f"""with {PLAIN}, {volumes_cte('home')}
select home, case when sum(cached) + sum(uncached) > 0 then
  cast(least(1000, (sum(cached) * 1000 + (sum(cached) + sum(uncached)) // 2) // (sum(cached) + sum(uncached))) as bigint) end as hit_tenths
from volumes group by home"""

SQL["priced_volumes"] = f"""with {PLAIN}, {volumes_cte('home')}, {priced_ctes()}
select home, model, tier_kind, tier_text, band, issue_kind, issue, round(cost, 6) as cost from priced"""

SQL["priced_cost"] = f"""with {PLAIN}, {volumes_cte('home, model')}, {priced_ctes()}
select home, model, case when count(issue) > 0 then null else round(sum(cost), 4) end as cost from priced group by home, model"""

SQL["price_issues"] = f"""with {PLAIN}, {volumes_cte('home')}, {priced_ctes()}
select distinct home, issue_kind, model,
  case when issue_kind = 'gap' or issue = 'context_unknown' then eff_tier when issue = 'unknown_tier' then tier_text end as tier,
  case when issue_kind = 'gap' then band end as band, issue from priced where issue is not null"""


# --- threads, forks and the report ----------------------------------------
def thread_ctes(name: str, members: str, keys: str) -> str:
    """Copies and sequence of the threads in ``members`` (keys, home, path)."""
    k = [c.strip() for c in keys.split(",")]
    same = " and ".join(f"a.{c} = b.{c}" for c in k)
    return f"""{name}_pairs as (
  select {', '.join('a.' + c for c in k)}, a.path as path, b.path as other, a.n_events as n
  from {members} a join {members} b on {same} and a.home = b.home and a.path <> b.path
    and (a.n_events < b.n_events or (a.n_events = b.n_events and b.path < a.path))),
{name}_hits as (
  select p.path, p.other, p.n, {', '.join('p.' + c for c in k)}, count(y.idx) as hits from {name}_pairs p
  left join numbered x on x.path = p.path
  left join numbered y on y.path = p.other and y.idx = x.idx and y.ts_nanos is not distinct from x.ts_nanos and y.sig = x.sig
  group by all),
{name}_copies as (select distinct {keys}, path from {name}_hits where hits = n),
{name}_kept as (select m.* from {members} m anti join {name}_copies c using ({keys}, path)),
{name}_order as (
  select {keys}, path, first_ts, max_ts, lag(max_ts) over w as before, lag(path) over w is not null as follows
  from {name}_kept window w as (partition by {keys} order by first_ts nulls first, path)),
{name}_seq as (
  select {keys}, bool_and(not follows or coalesce(first_ts > before, false)) as is_sequential, count(*) as timelines
  from {name}_order group by {keys})"""


NUMBERED = f"""numbered as (
  select home, path, line_no, ts_nanos, sig, row_number() over (partition by home, path order by line_no) - 1 as idx from timeline),
fstat as (
  select home, path, count(*) as n_events, arg_min(ts_nanos, line_no) as first_ts, max(ts_nanos) as max_ts from numbered group by home, path),
files as (
  select l.home, l.path, l.user_id, regexp_extract(l.path, '^([a-z][0-9]+)', 1) as thread_id, {PROVIDER_RULE.replace('user_id', 'l.user_id')} as provider,
    case when l.path like 'c%' then {_ts(SPLIT_DAY)} else min(l.ts_nanos) end as root_ts,
    case when l.path like 'c%' then 'u' || l.user_id end as parent_id, l.user_id % 23 = 0 as uncertain,
    min(l.ts_nanos) as from_ts, max(l.ts_nanos) as last_line_ts,
    coalesce(any_value(f.n_events), 0) as n_events, any_value(f.first_ts) as first_ts, any_value(f.max_ts) as max_ts
  from lines l left join fstat f using (home, path) group by l.home, l.path, l.user_id)"""

FORKS = f"""{thread_ctes('par', 'files', 'home, thread_id')},
forks as (
  select c.home, c.path, c.parent_id, c.root_ts,
    coalesce((select bool_and(not p.uncertain) and max(p.last_line_ts) >= c.root_ts from files p
      where p.home = c.home and p.thread_id = c.parent_id), false)
    and coalesce((select s.is_sequential from par_seq s where s.home = c.home and s.thread_id = c.parent_id), false) as usable
  from files c where c.parent_id is not null),
parent_sigs as (
  select f.path as fork, n.sig, row_number() over (partition by f.path order by k.first_ts, k.path, n.idx) as pos
  from forks f join par_kept k on k.home = f.home and k.thread_id = f.parent_id
  join numbered n on n.home = k.home and n.path = k.path where f.usable and n.ts_nanos <= f.root_ts),
walk(fork, i, pos) as (
  select path, cast(0 as bigint), cast(0 as bigint) from forks where usable
  union all
  select w.fork, w.i + 1, (select min(p.pos) from parent_sigs p where p.fork = w.fork and p.pos > w.pos and p.sig = n.sig)
  from walk w join numbered n on n.path = w.fork and n.idx = w.i
  where exists (select 1 from parent_sigs p where p.fork = w.fork and p.pos > w.pos and p.sig = n.sig)),
replay as (select f.home, f.path, f.usable, coalesce((select max(i) from walk w where w.fork = f.path), 0) as replayed_events from forks f)"""

WINDOWED = f"""scope as (
  select f.*, b.period_start, cast(make_timestamp(b.period_start // 1000) as date) as start_date,
    cast(make_timestamp(({AS_OF_SQL}) // 1000) as date) as today, cast(make_timestamp(from_ts // 1000) as date) as part_date,
    cast(make_timestamp(last_line_ts // 1000) as date) as mod_date,
    case when f.parent_id is null then true else coalesce(r.usable, false) end as replay_ok, coalesce(r.replayed_events, 0) as skip
  from files f left join boundary b using (home) left join replay r using (home, path)),
tagged as (
  select t.*, n.idx, s.skip, cast(make_timestamp(t.ts_nanos // 1000) as date) = s.today as in_today,
    coalesce(t.ts_nanos >= s.period_start, false) as in_period,
    coalesce(cast(make_timestamp(t.ts_nanos // 1000) as date) = s.start_date, false) as on_start
  from timeline t join numbered n using (home, path, line_no) join scope s using (home, path)),
uses as (
  select home, path, bool_or(in_today and delta_total <> 0) as use_today, bool_or(in_period and delta_total <> 0) as use_period,
    bool_or(on_start) as on_start from tagged group by home, path),
picked as (
  select s.*, w.window_kind, coalesce(u.on_start, false) as on_start,
    coalesce(case when w.window_kind = 'today' then u.use_today else u.use_period end, false) as has_use
  from scope s left join uses u using (home, path) cross join (values ('today'), ('period')) w(window_kind)
  where case when w.window_kind = 'today' then coalesce(u.use_today, false) or part_date = today or mod_date >= today - 1
    else period_start is not null and (coalesce(u.use_period, false) or part_date between start_date and today or mod_date >= start_date) end),
verdicts as (
  select *, case when provider is null and has_use then 'no_provider' when provider is null or provider <> 'openai' then 'ignored'
    when uncertain then 'unsound' else 'counted' end as verdict from picked),
members as (select * from verdicts where verdict = 'counted'),
{thread_ctes('win', 'members', 'home, window_kind, thread_id')},
tallied as (
  select k.* from win_kept k join win_seq s using (home, window_kind, thread_id) where s.is_sequential and k.replay_ok),
deferrals as (
  select home, window_kind, sum(d) as deferred from (
    select home, window_kind, count(distinct thread_id) as d from members join win_seq using (home, window_kind, thread_id)
      where not is_sequential and has_use group by home, window_kind
    union all
    select home, window_kind, count(*) as d from win_kept join win_seq using (home, window_kind, thread_id)
      where is_sequential and not replay_ok and has_use group by home, window_kind) group by home, window_kind),
grid as (
  select h.home, w.window_kind, b.period_start, b.long_used, b.stale, b.long_active, b.plan_type
  from (select distinct home from files) h cross join (values ('today'), ('period')) w(window_kind) left join boundary b on b.home = h.home),
trust as (
  select g.home, g.window_kind, cast(coalesce(v.bad, 0) + coalesce(d.deferred, 0) as bigint) as deferred_files,
    coalesce(v.bad, 0) + coalesce(d.deferred, 0) = 0 and (g.window_kind = 'today' or (g.period_start is not null
      and (coalesce(v.n, 0) = 0 or coalesce(v.anchor, false)))) as reliable
  from grid g left join (
    select home, window_kind, count(*) as n, count(*) filter (verdict not in ('counted', 'ignored')) as bad,
      bool_or(provider = 'openai' and (cast(make_timestamp(root_ts // 1000) as date) = start_date or on_start)) as anchor
    from verdicts group by home, window_kind) v using (home, window_kind)
  left join deferrals d using (home, window_kind)),
owned as (
  select t.*, k.window_kind from tagged t join tallied k using (home, path)
  where delta_total <> 0 and idx >= t.skip and case when k.window_kind = 'today' then in_today else in_period end),
sums as (
  select home, window_kind, sum(delta_total) filter (not overflow) as tokens, sum(delta_total) filter (overflow) as overflow_tokens
  from owned group by home, window_kind),
{volumes_cte('home, window_kind', 'owned')},
{priced_ctes()},
costs as (
  select home, window_kind, case when count(issue) > 0 then null else sum(cost) end as cost, true as has_volume,
    case when sum(cached) + sum(uncached) > 0 then
      least(1000, (sum(cached) * 1000 + (sum(cached) + sum(uncached)) // 2) // (sum(cached) + sum(uncached))) end as hit_tenths
  from priced group by home, window_kind),
readings as (
  select k.home, k.window_kind, l.balance,
    lag(l.balance) over (partition by k.home, k.window_kind order by l.ts_nanos, l.path, l.line_no) as prev
  from lines l join tallied k using (home, path)
  where l.balance is not null and case when k.window_kind = 'today' then cast(make_timestamp(l.ts_nanos // 1000) as date) = k.today
    else l.ts_nanos >= k.period_start end),
spent as (select home, window_kind, sum(case when prev - balance > 1e-6 then prev - balance else 0 end) as credits from readings group by home, window_kind),
windows as (
  select g.*, t.reliable, t.deferred_files, case when t.reliable then cast(coalesce(s.tokens, 0) as bigint) end as tokens,
    case when t.reliable then cast(coalesce(s.overflow_tokens, 0) as bigint) end as overflow_tokens,
    case when t.reliable then coalesce(p.credits, 0) end as credits_spent,
    case when t.reliable then case when c.has_volume then c.cost else 0 end end as cost,
    case when t.reliable then cast(c.hit_tenths as bigint) end as hit_tenths
  from grid g join trust t using (home, window_kind) left join sums s using (home, window_kind)
  left join costs c using (home, window_kind) left join spent p using (home, window_kind))"""

THREADS = f"{VARIANT}, {NUMBERED}"
REPORT = f"{VARIANT}, {NUMBERED}, {FORKS}, {QUOTA}, {WINDOWED}"

SQL["copy_collapse"] = f"""with {THREADS}, {thread_ctes('thr', 'files', 'home, thread_id')}
select f.home, f.thread_id, f.path, cast(f.n_events as bigint) as n_events, c.path is not null as is_copy
from files f left join thr_copies c using (home, thread_id, path)"""

SQL["resume_chains"] = f"""with {THREADS}, {thread_ctes('thr', 'files', 'home, thread_id')}
select home, thread_id, cast(timelines as bigint) as timelines, is_sequential from thr_seq"""

SQL["fork_replay"] = f"""with recursive {THREADS}, {FORKS}
select home, path, usable, cast(replayed_events as bigint) as replayed_events from replay"""

SQL["window_usage"] = f"""with recursive {REPORT}
select home, window_kind, reliable, deferred_files, tokens, overflow_tokens, round(credits_spent, 4) as credits_spent,
  round(cost, 4) as cost, hit_tenths from windows"""


def _tokens_text(n: str, hit: str) -> str:
    def unit(size: int, name: str) -> str:
        tenths = f"(({n} * 10 + {size // 2}) // {size})"
        return (
            f"case when {tenths} % 10 = 0 then cast({tenths} // 10 as varchar) "
            f"else cast({tenths} // 10 as varchar) || '.' || cast({tenths} % 10 as varchar) end || '{name}'"
        )

    usage = (
        f"case when {n} is null then '--' when {n} < 10000 then cast({n} as varchar) "
        f"when {n} < 100000000 then {unit(10_000, '万')} else {unit(100_000_000, '亿')} end"
    )
    return f"{usage} || case when {n} is not null and {hit} is not null then ' · ' || cast({hit} // 10 as varchar) || '.' || cast({hit} % 10 as varchar) || '%' else '' end"


SQL["usage_report"] = f"""with recursive {REPORT},
t as (select * from windows where window_kind = 'today'), p as (select * from windows where window_kind = 'period')
select t.home, t.reliable as today_reliable, p.reliable as period_reliable, t.tokens as today_tokens, p.tokens as period_tokens,
  case when not p.stale and p.long_active and p.long_used >= 1 and p.tokens > 0
    then cast(round(p.tokens * 100.0e0 / p.long_used) as bigint) end as period_token_estimate,
  case when not p.stale and p.long_active and p.long_used >= 1 and p.cost > 0 then round(p.cost * 100.0e0 / p.long_used, 4) end as period_value_estimate,
  {_tokens_text('t.tokens', 't.hit_tenths')} as today_text, {_tokens_text('p.tokens', 'p.hit_tenths')} as period_text,
  '本周' as period_label, case p.plan_type when 'plus' then 'Plus' when 'pro' then 'Pro' when 'team' then 'Team' end as plan_label,
  case when q.stale or not (q.short_active or q.long_active) then null
    when (q.short_active and q.short_left <= 0) or (q.long_active and q.long_left <= 0) then 0.0
    when q.short_active then q.short_left else q.long_left end as headline,
  strftime(make_timestamp(q.long_resets * 1000000), '%m/%d %H:%M') as long_reset_text
from t join p using (home) left join quota q using (home)"""


SQL["ancestor_closure"] = f"""with recursive {LINES_PLAIN}, edges as (
  select distinct user_id as thread, user_id // 2 as parent from lines where user_id > 0),
reach(thread, ancestor) as (
  select thread, parent from edges union select r.thread, e.parent from reach r join edges e on e.thread = r.ancestor)
select thread, ancestor from reach"""

SQL["history_compaction"] = f"""with {VARIANT}, {NUMBERED},
crowd as (select home, thread_id from files group by home, thread_id having count(*) > 1
  union select home, parent_id from files where parent_id is not null),
target as (
  select home, path from files f where provider = 'openai' and not uncertain and parent_id is null
    and not exists (select 1 from crowd c where c.home = f.home and c.thread_id = f.thread_id)),
cut as (
  select n.home, n.path, min(case when n.ts_nanos >= {_ts(SPLIT_DAY)} then n.idx end) as cut_idx, max(idx) + 1 as n
  from numbered n join target using (home, path) group by n.home, n.path),
head as (
  select e.*, n.idx from ev e join numbered n using (home, path, line_no) join cut c using (home, path) where n.idx < coalesce(c.cut_idx, c.n)),
head_runs as (
  select *, sum(brk) over (partition by home, path, source order by line_no) as run from (
    select *, case when lag(line_no) over w is null or model is distinct from lag(model) over w then 1 else 0 end as brk
    from head where has_total window w as (partition by home, path, source order by line_no))),
peak as (
  select home, path, line_no from (
    select *, row_number() over (partition by home, path, source order by run desc, teff desc, line_no) as rn from head_runs) where rn = 1),
keep as (select * from peak union select home, path, max(line_no) from head group by home, path),
stay as (
  select n.home, n.path, n.line_no from numbered n
  where not exists (select 1 from head h where h.home = n.home and h.path = n.path and h.line_no = n.line_no)
    or exists (select 1 from keep k where k.home = n.home and k.path = n.path and k.line_no = n.line_no))
select home, path, cast(count(*) as bigint) as kept, cast(sum(line_no) as bigint) as line_sum, min(line_no) as first_line from stay group by home, path"""

BLIND = 2 * REFRESH_SECONDS * 1_000_000_000
READINGS = f"""obs as (
  select home, ts_nanos, path, line_no, primary_percent as short_used, primary_resets_at as short_resets,
    secondary_percent as long_used, secondary_resets_at as long_resets,
    case when line_no % 3 <> 0 then 'account-' || home end as account_id,
    (primary_resets_at > ts_nanos // 1000000000 and primary_percent >= 100) or (secondary_resets_at > ts_nanos // 1000000000 and secondary_percent >= 100) as blocked
  from lines where primary_percent is not null)"""

SQL["reset_events"] = f"""with {LINES_PLAIN}, {READINGS}, seq as (
  select *, lag(ts_nanos) over w as prev_ts, max(short_resets) over b as short_base, max(long_resets) over b as long_base from obs
  window w as (partition by home order by ts_nanos, path, line_no),
    b as (partition by home order by ts_nanos, path, line_no rows between unbounded preceding and 1 preceding)),
live as (select * from seq where ts_nanos > prev_ts and ts_nanos - prev_ts <= {BLIND} and not blocked)
select home, ts_nanos, line_no, 'short' as "window", short_resets as resets_at, greatest(0.0, least(100.0, 100.0 - short_used)) as remaining
from live where abs(short_resets - (short_base + 18000)) <= 1800
union all
select home, ts_nanos, line_no, 'long', long_resets, greatest(0.0, least(100.0, 100.0 - long_used))
from live where abs(long_resets - (long_base + 604800)) <= 60480"""

SQL["early_restores"] = f"""with {LINES_PLAIN}, {READINGS}, seq as (
  select *, lag(ts_nanos) over (partition by home order by ts_nanos, path, line_no) as seen from obs),
known as (
  select *, lag(ts_nanos) over w as prev_ts, lag(account_id) over w as prev_account, lag(short_used) over w as prev_short,
    lag(short_resets) over w as prev_short_resets, lag(long_used) over w as prev_long, lag(long_resets) over w as prev_long_resets
  from seq where account_id is not null window w as (partition by home order by ts_nanos, path, line_no)),
live as (
  select * from known where account_id = prev_account and ts_nanos > prev_ts and ts_nanos - prev_ts <= {BLIND}
    and ts_nanos - seen <= {BLIND} and not blocked)
select home, ts_nanos, line_no, 'short' as "window", short_resets as resets_at, greatest(0.0, least(100.0, 100.0 - short_used)) as remaining
from live where abs(short_resets - (prev_short_resets + 18000)) > 1800 and short_resets > ts_nanos // 1000000000
  and prev_short between 0 and 100 and short_used between 0 and 1 and prev_short - short_used >= 5 and short_resets >= prev_short_resets
union all
select home, ts_nanos, line_no, 'long', long_resets, greatest(0.0, least(100.0, 100.0 - long_used))
from live where abs(long_resets - (prev_long_resets + 604800)) > 60480 and long_resets > ts_nanos // 1000000000
  and prev_long between 0 and 100 and long_used between 0 and 1 and prev_long - long_used >= 5 and long_resets >= prev_long_resets"""

# The full rules: jittered looks, late records, account and limit switches.
LOOKS = f"""looks as (
  select home, ts_nanos as received, ts_nanos + (line_no % 4) * 60000000000 + line_no as observed, blocked,
    case when line_no % 3 <> 0 then 'account-' || (line_no // 40 % 2) end as account, case when line_no % 60 < 55 then 'usage' else 'other' end as lim,
    short_used, short_resets, long_used, long_resets, case when line_no % 5 <> 4 then (line_no % 4) * 0.125 end as credits from obs)"""
_EARLIER = "partition by home order by observed, received rows between unbounded preceding and 1 preceding"


def _reset_rows(role: str, seconds: int) -> str:
    drift = seconds // 10
    return f"""select home, observed as observed_nanos, 'reset' as kind, cast({seconds} as bigint) as seconds, greatest(0.0, least(100.0, 100.0 - {role}_used)) as value
  from runs where not coalesce(blind, false) and not full_up and (
    (lim = led.lim and received - led.received between 1 and {BLIND} and observed - received between 0 and {BLIND} and not other
      and abs({role}_resets - last_{role} - {seconds}) <= {drift})
    or (lim = sig.lim and account = sig.account and received - sig.received between 1 and {BLIND} and observed - received between 0 and {BLIND}
      and abs({role}_resets - sig.{role}_resets - {seconds}) > {drift} and {role}_resets > observed / 1e9 and sig.{role}_used between 0 and 100
      and {role}_used between 0 and 1 and sig.{role}_used - {role}_used >= 5 and {role}_resets >= sig.{role}_resets))"""


SQL["watch_alerts"] = f"""with {LINES_PLAIN}, {READINGS}, {LOOKS}, tops as (
  select *, lag(observed) over w as seen, lag(long_resets) over w as period_before, max(received) over b as top,
    max(case when account is not null then received end) over b as signed_top
  from looks window w as (partition by home order by observed, received), b as ({_EARLIER})),
led_by as (
  select *, coalesce(received >= top, true) as leads, account is not null and coalesce(received > signed_top, true) as signs,
    (short_resets > observed / 1e9 and short_used >= 100) or (long_resets > observed / 1e9 and long_used >= 100) as full_up,
    {{'received': received, 'lim': lim, 'account': account, 'short_used': short_used, 'short_resets': short_resets,
      'long_used': long_used, 'long_resets': long_resets}} as reading from tops),
known as (
  select *, last_value(case when leads then reading end ignore nulls) over b as led, last_value(case when signs then reading end ignore nulls) over b as sig,
    last_value(case when leads then account end ignore nulls) over b as owner
  from led_by window b as ({_EARLIER})),
flags as (
  select *, coalesce(account <> owner, false) as other, coalesce(observed - seen > {BLIND}, false) as blind, observed - received > {BLIND} as stale from known),
numbered as (
  select *, sum(case when leads and (other or coalesce(lim <> led.lim, false)) then 1 else 0 end) over u as run,
    sum(case when blind or stale or long_resets is distinct from period_before then 1 else 0 end) over u as stretch
  from flags window u as (partition by home order by observed, received rows between unbounded preceding and current row)),
runs as (
  select *, max(case when leads then short_resets end) over r as last_short, max(case when leads then long_resets end) over r as last_long,
    max(case when not stale and credits < 0.25 then 1 else 0 end) over (
      partition by home, stretch order by observed, received rows between unbounded preceding and 1 preceding) as armed
  from numbered window r as (partition by home, run order by observed, received rows between unbounded preceding and 1 preceding)),
fired as (
  select *, row_number() over (partition by home, long_resets order by observed, received) as rn from runs where not stale and credits >= 0.25 and armed = 1)
{_reset_rows("short", 18000)}
union all {_reset_rows("long", 604800)}
union all select home, observed, 'overflow', cast(604800 as bigint), cast(credits as double) from fired where rn = 1"""

SQL["overflow_alerts"] = f"""with {LINES_PLAIN}, seq as (
  select home, ts_nanos, path, line_no, secondary_resets_at as period, balance, lag(balance) over w as prev,
    lag(secondary_resets_at) over w as prev_period, lag(ts_nanos) over w as prev_ts
  from lines where balance is not null and primary_percent is not null window w as (partition by home order by ts_nanos, path, line_no)),
sums as (
  select *, sum(case when prev_period = period and prev - balance > 1e-6 then prev - balance else 0 end) over p as credits,
    sum(case when coalesce(ts_nanos - prev_ts > {BLIND}, true) then 1 else 0 end) over p as stretch
  from seq window p as (partition by home, period order by ts_nanos, path, line_no rows between unbounded preceding and current row)),
armed as (
  select *, max(case when credits < 0.25 then 1 else 0 end) over (partition by home, period, stretch order by ts_nanos, path, line_no
    rows between unbounded preceding and 1 preceding) as ready from sums),
fired as (select *, row_number() over (partition by home, period order by ts_nanos, path, line_no) as rn from armed where credits >= 0.25 and ready = 1)
select home, period, ts_nanos, round(credits, 4) as credits from fired where rn = 1"""

SQL["manifest_diff"] = f"""with {LINES_PLAIN},
old as (
  select home, path, path as identity, count(*) as length, max(ts_nanos) as modified_at from lines
  where ts_nanos < {_ts(SPLIT_DAY)} and user_id % 6 <> 0 group by home, path),
new as (
  select home, case when any_value(user_id) % 4 = 1 and any_value(user_id) % 10 = 1 then 'archive/' || path else path end as path, path as identity,
    count(*) as length, max(ts_nanos) as modified_at from lines
  where (user_id % 4 <> 1 or ts_nanos < {_ts(SPLIT_DAY)}) and (user_id % 8 <> 3 or line_no % 2 = 0) and user_id % 9 <> 0 group by home, lines.path),
both_sides as (
  select home, path, n.identity as ni, o.identity as oi, n.length as nl, o.length as ol,
    case when o.identity is null then 'new' when n.identity is null then 'deleted'
      when n.identity = o.identity and n.length = o.length and n.modified_at = o.modified_at then 'unchanged'
      when n.identity = o.identity and n.length > o.length then 'appended' else 'rewritten' end as change
  from new n full join old o using (home, path)),
moves as (
  select c.home, min(c.path) as path, min(g.path) as moved_from, min(g.ol) as resume from both_sides c join both_sides g
    on g.home = c.home and g.oi = c.ni and g.ol = c.nl where c.change = 'new' and g.change = 'deleted' group by c.home, c.ni, c.nl)
select b.home, b.path, case when m.path is not null then 'renamed' when g.moved_from is not null then 'moved away' else change end as change,
  m.moved_from, cast(case when change = 'appended' then ol when m.path is not null then m.resume when change in ('new', 'rewritten') then 0 end as bigint) as resume_at
from both_sides b left join moves m on m.home = b.home and m.path = b.path left join moves g on g.home = b.home and g.moved_from = b.path"""


def _gap_part(name: str, where: str, rows) -> str:
    """The gaps of one half of the events, as a subquery of its own."""
    return f"""{name} as (
  with {volumes_cte('home', 'timeline', where)}, {priced_ctes('volumes', rows)}
  select distinct home, model, eff_tier as tier, band, issue from priced where issue_kind = 'gap')"""


SQL["price_gap_lifecycle"] = f"""with {PLAIN},
{_gap_part('before_gaps', f'ts_nanos < {_ts(SPLIT_DAY)}', PRICE_ROWS)},
{_gap_part('after_gaps', f'ts_nanos >= {_ts(SPLIT_DAY)}', NEWER_PRICE_ROWS)},
{_price_values(NEWER_PRICE_ROWS, 'newer')},
joined as (
  select home, model, tier, band, issue, b.home is not null as known, a.home is not null as present
  from (select *, 1 as one from before_gaps) b full join (select *, 1 as one from after_gaps) a using (home, model, tier, band, issue)),
found as (
  select j.*, case when model in (select p_model from newer) then model
    when regexp_matches(model, '^.+-\\d{{4}}-\\d{{2}}-\\d{{2}}$') and try_strptime(right(model, 10), '%Y-%m-%d') is not null
      and left(model, length(model) - 11) in (select p_model from newer) then left(model, length(model) - 11) end as base from joined j),
state as (
  select f.*, coalesce(p.p_model is not null and case when is_split and band = 'unknown' or is_split and band = 'long' and not has_long then false
    when issue in ('model', 'tier', 'context') then true
    when issue = 'input' then case when is_split and band = 'long' then l_in else s_in end is not null
    when issue = 'cached_input' then case when is_split and band = 'long' then l_cached else s_cached end is not null
    else case when is_split and band = 'long' then l_out else s_out end is not null end, false) as resolved
  from found f left join newer p on p.p_model = f.base and p.p_tier = f.tier)
select home, model, tier, band, issue,
  case when known and resolved and not present then 'resolved' when known and band = 'short' then 'gave_up' when present and not known then 'missing' end as event,
  known and band = 'short' and not (resolved and not present) as gave_up, not (known and resolved and not present) as open
from state"""

_MINUTES = "(latest // 1000000000 % 2000000 // 60)"
SQL["display_texts"] = f"""with {LINES_PLAIN}, days as (
  select home, ts_nanos // 86400000000000 as day, cast(sum(coalesce(last_total, 0)) as bigint) as tokens,
    cast(sum(coalesce(last_cached_input, 0)) as bigint) as cached, cast(sum(coalesce(last_input, 0) - coalesce(last_cached_input, 0)) as bigint) as uncached,
    max(ts_nanos) as latest from lines where is_token group by 1, 2),
parts as (
  select *, {_MINUTES} // 1440 as d, {_MINUTES} % 1440 // 60 as h, {_MINUTES} % 60 as m, (latest // 1000000000 % 700) * 60 as wm,
    ({AS_OF_SQL}) // 1000000000 - latest // 1000000000 as gone,
    case when tokens < 1000 then null when tokens < 1000000 then (tokens * 10 + 500) // 1000 when tokens < 1000000000 then (tokens * 10 + 500000) // 1000000
      else (tokens * 10 + 500000000) // 1000000000 end as en10,
    case when tokens * 1000 < 10000 then null when tokens * 1000 < 100000000 then (tokens * 10000 + 5000) // 10000 else (tokens * 10000 + 50000000) // 100000000 end as zh10
  from days)
select home, day,
  case when en10 is null then cast(tokens as varchar) else cast(en10 // 10 as varchar) || case when en10 % 10 = 0 then '' else '.' || cast(en10 % 10 as varchar) end
    || case when tokens < 1000000 then 'K' when tokens < 1000000000 then 'M' else 'B' end end as en,
  case when zh10 is null then cast(tokens * 1000 as varchar) else cast(zh10 // 10 as varchar) || case when zh10 % 10 = 0 then '' else '.' || cast(zh10 % 10 as varchar) end
    || case when tokens * 1000 < 100000000 then '万' else '亿' end end as zh,
  case when cached + uncached > 0 then cast(least(1000, (cached * 1000 + (cached + uncached) // 2) // (cached + uncached)) as bigint) end as hit,
  case when d >= 10 or (d > 0 and h = 0) then d || 'd' when d > 0 then d || 'd' || h || 'h' when h > 0 and m = 0 then h || 'h'
    when h > 0 then h || 'h' || m || 'm' when m > 0 then m || 'm' else '<1m' end as countdown,
  case when wm = 300 then '5h' when wm between 40320 and 44640 then '月' when wm = 10080 then '周' when wm <> 0 and wm % 10080 = 0 then wm // 10080 || '周'
    when wm <> 0 and wm % 1440 = 0 then wm // 1440 || '天' when wm <> 0 and wm % 60 = 0 then wm // 60 || '小时' else wm || '分钟' end as window_name,
  case when gone < 60 then '刚刚更新' when gone < 3600 then gone // 60 || '分钟前更新' when gone < 86400 then gone // 3600 || '小时前更新'
    else gone // 86400 || '天前更新' end as elapsed
from parts"""

SQL["streamed_deltas"] = SQL["token_deltas"]

SQL["log_line_fields"] = f"""with {LINES_PLAIN}, cut as (select *, line_no % 97 = 96 as broken, is_token and line_no % 97 <> 96 as tok from lines)
select home, line_no, broken as is_broken, case when not broken then ts_nanos end as ts_nanos, case when not broken then kind end as kind,
  case when not broken then model_set end as model_set, sets_tier and not broken as sets_tier,
  case when not broken then {TIER_KIND} end as tier_set_kind, case when not broken then tier_raw end as tier_set_text, case when tok then source end as source,
  case when tok then total_input end as total_input, case when tok then total_cached_input end as total_cached_input,
  case when tok then total_output end as total_output, case when tok then total_total end as total_total,
  case when tok then last_input end as last_input, case when tok then last_cached_input end as last_cached_input,
  case when tok then last_output end as last_output, case when tok then last_total end as last_total,
  case when tok then primary_percent end as primary_percent, case when tok then round(balance, 6) end as balance,
  case when tok then primary_resets_at end as resets_at
from cut"""

SQL["rate_limit_responses"] = f"""with {LINES_PLAIN}
select home, 'account-' || home as account_id, case when k % 10 = 8 or source is distinct from '{USAGE_LIMIT_ID}' then 'general' else '{USAGE_LIMIT_ID}' end as limit_id, ts_nanos,
  coalesce(primary_percent, cast(k % 101 as double)) as used_percent, coalesce(primary_resets_at, 1700000000 + k) as resets_at,
  cast(case when k % 10 <> 5 then 10080 end as bigint) as long_minutes
from lines where k % 10 not in (3, 4, 6, 9)"""

SQL["rate_limit_rejects"] = f"""with {LINES_PLAIN}
select home, case k % 10 when 3 then 'no primary window' when 4 then 'negative reset' when 6 then 'no bucket' else 'malformed' end as reason,
  cast(count(*) as bigint) as n from lines where k % 10 in (3, 4, 6, 9) group by all"""

SQL["account_responses"] = f"""with {LINES_PLAIN}
select home, ts_nanos, case when k % 7 not in (2, 3) then 'plan-' || k % 5 end as plan_type from lines where k % 7 <> 4"""

SQL["merged_snapshots"] = f"""with {LINES_PLAIN},
looks as (select *, k % 4 >= 2 as newer, case when k % 2 = 0 then 'plan-' || k % 5 end as plan from lines
  where case when k % 4 < 2 then user_id % 5 <> 1 else user_id % 5 <> 2 end),
latest as (select * from looks qualify row_number() over (partition by home, newer order by ts_nanos desc, k desc) = 1)
select home, max(ts_nanos) as ts_nanos, cast(1700000000 + arg_max(k, (ts_nanos, newer)) as bigint) as resets_at,
  cast(case when arg_max(k, (ts_nanos, newer)) % 3 <> 0 then 1800000000 + arg_max(k, (ts_nanos, newer)) end as bigint) as long_resets_at,
  case when arg_max(newer, (ts_nanos, newer)) then coalesce(max(plan) filter (newer), max(plan) filter (not newer))
    else max(plan) filter (not newer) end as plan_type
from latest group by home"""

SQL["merged_messages"] = f"""with {LINES_PLAIN},
parts as (select distinct home, ts_nanos // 86400000000000 * 86400000000000 as ts_nanos, case when line_no % 2 = 0 then 'reset' else 'restored' end as kind,
  line_no % 3 as rank from lines where is_token)
select home, ts_nanos, kind, string_agg(kind || ' ' || rank, '；' order by rank) as body from parts group by home, ts_nanos, kind"""

SQL["money_texts"] = """with p as (select cast(o_orderkey as bigint) as k, cast(o_orderkey % 30011 as bigint) as c, cast(o_orderkey % 30011 as bigint) - 100 as u from orders)
select k, case when u <= 0 then '$0.00'
    when u >= 10000 then '$' || (u // 100 + case when u % 100 > 50 or (u % 100 = 50 and u // 100 % 2 = 1) then 1 else 0 end)
    else printf('$%d.%02d', u // 100, u % 100) end as usd,
  case when c % 100 = 0 then cast(c // 100 as varchar) else printf('%d.%02d', c // 100, c % 100) end as credits
from p"""

SQL["price_sheet_rows"] = """with p as (select cast(p_partkey as bigint) as k, cast(floor(p_retailprice) as bigint) as price from part where p_partkey % 5 = 0),
t(tier, f) as (values ('standard', 1), ('fast', 2), ('ultrafast', 4))
select cast(k as varchar) as sheet_id, 'part-' || k as model, tier, false as is_split, cast(price * f as double) as short_input,
  cast(null as double) as short_cached, price * 10 * f + 0.5e0 as short_output, cast(null as double) as long_input, cast(null as double) as long_output
from p, t
union all
select cast(k as varchar), 'wide-' || k, tier, true, 1.0e0, 0.5e0, 2.0e0, cast(price as double), 3.0e0 from p, t"""

SQL["price_sheet_faults"] = """select cast(p_partkey as varchar) as sheet_id,
  case p_partkey % 5 when 1 then 'no unit line' when 2 then 'context threshold' when 3 then 'missing main table' else 'price cell' end as fault
from part where p_partkey % 5 <> 0"""

SQL["run_diagnostics"] = f"""with recursive {REPORT}
select f.home, cast(count(*) as bigint) as files_scanned, cast(count(*) filter (uncertain) as bigint) as files_uncertain,
  cast(sum(n_events) as bigint) as token_events,
  cast((select count(distinct path) from verdicts v where v.home = f.home) as bigint) as files_selected,
  cast((select count(*) from verdicts v where v.home = f.home and verdict not in ('counted', 'ignored')) as bigint) as files_refused,
  cast((select count(distinct path) from win_copies c where c.home = f.home) as bigint) as copies,
  cast((select sum(deferred_files) from trust t where t.home = f.home) as bigint) as deferred_files
from files f group by f.home"""

# Streams give what the same rules give in batch.
SQL["streamed_alerts"] = SQL["watch_alerts"]
SQL["streamed_period_usage"] = SQL["period_usage"]
SQL["streamed_today_usage"] = SQL["today_usage"]

# Log files of ten days, in the order of the lines' times.
LINES_LOGGED = f"""logged as (select *, (day(make_timestamp(ts_nanos // 1000)) - 1) // 10 as period, (day(make_timestamp(ts_nanos // 1000)) - 1) % 10 < 5 as early,
    {CHANGE_RULE} as rule, {HOME_NAME} as home_name from ({feed_sql('duckdb')}) feed),
lines as (select * replace (row_number() over (partition by user_id, period order by ts_nanos, line_no) as line_no),
    'u' || user_id || '/' || period as path from logged where rule <> 'deleted')"""

SQL["discovered_files"] = f"""with {LINES_LOGGED}
select distinct home_name, user_id, period, printf('%08x-0000-4000-8000-%012x', user_id, period) as filename_thread_id,
  printf('2024-01-%02d', period * 10 + 1) as partition_date
from logged where rule in ('deleted', 'moved', 'same') or (rule in ('rewritten', 'appended') and early)"""

SQL["resumed_lines"] = f"""with {LINES_LOGGED}
select user_id, period, line_no as n, ts_nanos, kind, model_set, is_token, total_total, last_output from lines"""

SQL["refreshed_usage"] = f"""with {LINES_LOGGED}, {EVENTS}
select user_id, cast(split_part(path, '/', 2) as bigint) as period, cast(count(*) as bigint) as events,
  cast(sum(delta_total) as bigint) as delta_total, cast(sum(delta_uncached) as bigint) as delta_uncached,
  cast(sum(delta_cached) as bigint) as delta_cached, cast(sum(delta_output) as bigint) as delta_output,
  cast(coalesce(sum(case when overflow then delta_total end), 0) as bigint) as overflow_tokens
from timeline group by all"""

SQL["refresh_counts"] = f"""with {LINES_LOGGED}, marked as (
  select *, early and line_no = max(case when early then line_no end) over (partition by path) and user_id % 2 = 0 as was_open from lines),
judged as (select *, rule in ('rewritten', 'new') or (rule = 'appended' and (not early or was_open)) as is_read from marked),
files as (select home_name, path, rule, bool_or(is_read) as is_read, count(*) filter (is_read) as lines_read,
  count(*) filter (is_read and is_token) as events_added from judged group by all)
select home_name, count(*) as files_listed, count(*) filter (is_read) as files_read,
  count(*) filter (not is_read and rule <> 'moved') as files_unchanged, cast(0 as bigint) as files_failed,
  cast(sum(lines_read) as bigint) as lines_read, cast(sum(events_added) as bigint) as events_added, cast(0 as bigint) as parse_errors, cast(0 as bigint) as folders_failed
from files group by home_name"""

# The first half of everybody, the second half of some.
LINES_DIRTY = LINES_VARIANT.replace(" from placed)", f" from placed where ts_nanos < {_ts(SPLIT_DAY)} or user_id % 3 = 0)")

SQL["dirty_threads"] = f"""with recursive {LINES_DIRTY}, {EVENTS}, {NUMBERED}, {FORKS}, {thread_ctes('thr', 'files', 'home, thread_id')}
select f.home, f.path, f.thread_id, c.path is not null as is_copy, s.is_sequential,
  case when f.parent_id is null then true else coalesce(r.usable, false) end as replay_ok, cast(coalesce(r.replayed_events, 0) as bigint) as replayed_events
from files f left join thr_copies c using (home, thread_id, path) left join thr_seq s using (home, thread_id)
left join replay r on r.home = f.home and r.path = f.path"""

SQL["restored_history"] = SQL["history_compaction"].replace("where not exists (select 1 from head h", "where n.home % 2 = 0 or not exists (select 1 from head h")
SQL["followed_deltas"] = SQL["token_deltas"]
