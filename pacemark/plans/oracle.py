"""The queries of the catalog as SQL for DuckDB, written independently of the operators."""

from __future__ import annotations

from pacemark.plans.oracle_stateful import STATEFUL_SQL

EV = """ev as (select event_id, epoch_us(ts) us, epoch_us(ts) // 1000000 t, user_id % 8 "cluster",
  user_id client, event_type, value from events)"""

AGENT = f"""{EV}, m as (select *, case event_type when 'signup' then 'IN' when 'error' then 'OUT'
  else 'UPDATE' end verb, cast(floor(value) as bigint) v from ev)"""

LIVE = f"""{AGENT},
 p as (select *, row_number() over (partition by client order by us, event_id) k from m),
 q as (select *, max(case when verb in ('IN','OUT') then k end) over (partition by client
   order by us, event_id rows between unbounded preceding and current row) lk,
   max(case when verb in ('IN','OUT') then k end) over (partition by client
   order by us, event_id rows between unbounded preceding and 1 preceding) pk from p),
 r as (select q.*, coalesce(a.verb = 'IN', false) live, coalesce(z.verb = 'IN', false) was
   from q left join p a on a.client = q.client and a.k = q.lk
   left join p z on z.client = q.client and z.k = q.pk)"""

TOTAL = f"""{LIVE},
 g as (select *, case when verb = 'UPDATE' and live then v else 0 end contrib,
   case verb when 'IN' then true when 'OUT' then was else live end accepted from r),
 d as (select *, contrib - coalesce(lag(contrib) over (partition by client order by us, event_id), 0)
   delta from g),
 tot as (select *, cast(sum(delta) over (partition by "cluster" order by us, event_id
   rows between unbounded preceding and current row) as bigint) total from d)"""

STEP = """case when total < 0 then 500 when total <= 60 then 10 when total <= 80 then 36
  when total <= 100 then 60 when total <= 150 then 120 when total <= 250 then 360
  when total <= 300 then 400 else 500 end"""

IO = f"""{TOTAL},
 io as (select event_id, us, "cluster", total, {STEP} period from tot
   where verb = 'UPDATE' and accepted)"""

COUNTER = f"""{EV}, c as (select *, cast(sum(cast(floor(value * 100000) as bigint)) over
   (partition by client order by us, event_id rows between unbounded preceding and current row)
   as bigint) counter from ev),
 cr as (select event_id, client, counter, cast(floor((counter - lag(counter) over w) //
   nullif(t - lag(t) over w, 0)) as bigint) rate from c
   window w as (partition by client order by us, event_id))"""

OBS = f"""{EV}, obs as (
 select event_id, us, "cluster", 'checkpoint' series, cast(trunc(value * 1000) as bigint) "value"
   from ev where event_type = 'click'
 union all
 select event_id, us, "cluster", 'mtbf', gap from (select *, t - lag(t) over (partition by "cluster"
   order by us, event_id) gap from ev where event_type = 'error') x where gap is not null),
 oseq as (select *, row_number() over (partition by "cluster", series order by us, event_id) - 1 seq
   from obs)"""

MEANS = f"""{OBS},
 mv as (select *, avg(value) over (partition by "cluster", series order by us, event_id
   rows between 49 preceding and current row) av from oseq),
 means as (select event_id, us, "cluster",
   last_value(case when series = 'checkpoint' then av end ignore nulls) over w avg_cost,
   last_value(case when series = 'mtbf' then av end ignore nulls) over w avg_mtbf from mv
   window w as (partition by "cluster" order by us, event_id
     rows between unbounded preceding and current row)),
 known as (select * from means where avg_cost is not null and avg_mtbf is not null)"""

CAND = f"""{MEANS},
 cand as (select *, greatest(10, cast(floor(sqrt(2 * (avg_cost / 1000.0) * avg_mtbf)) as bigint))
   period from known)"""

LIFE = f"""{EV},
 lf as (select *, row_number() over (partition by "cluster" order by us, event_id) k from (
   select event_id, us, t, "cluster", case event_type when 'signup' then 'START'
   when 'purchase' then 'STOP' else 'FAIL' end verb from ev
   where event_type in ('signup', 'purchase', 'error')) x),
 lb as (select *, max(case when verb <> 'FAIL' then k end) over (partition by "cluster" order by k
   rows between unbounded preceding and current row) lk from lf),
 lu as (select lb.*, coalesce(b.verb = 'START', false) up from lb left join lf b
   on b."cluster" = lb."cluster" and b.k = lb.lk),
 le as (select * from lu where verb <> 'FAIL' or up),
 lg as (select *,
   coalesce(sum(case when verb = 'FAIL' then 1 else 0 end) over w, 0) g,
   max(case when verb <> 'STOP' then t end) over w tslf,
   lag(t) over (partition by "cluster" order by k) pt,
   lag(verb) over (partition by "cluster" order by k) pv from le
   window w as (partition by "cluster" order by k
     rows between unbounded preceding and 1 preceding))"""

CARRY = f"""{LIFE}, cz as (select *, case when verb = 'STOP' and t - tslf > 0 then t - tslf end el from lg),
 cy as (select *, coalesce(last_value(el ignore nulls) over (partition by "cluster", g order by k
   rows between unbounded preceding and current row), 0) tebi from cz),
 obs as (select event_id, us, "cluster", 'checkpoint' series, cast(trunc(value * 1000) as bigint) "value"
   from ev where event_type = 'click'
   union all select event_id, us, "cluster", 'mtbf', t - tslf + tebi from cy where verb = 'FAIL'),
 oseq as (select *, row_number() over (partition by "cluster", series order by us, event_id) - 1 seq
   from obs)"""

CARRY_CAND = CARRY + CAND.removeprefix(OBS)

RUNS = """r as (select l_orderkey, l_linenumber, l_returnflag benchmark,
  case l_linestatus when 'O' then 'AF' else 'DF' end phase, l_linenumber rep,
  cast(trunc(l_quantity) as int) as seconds, l_extendedprice mb from lineitem)"""

LINES = """ln as (select doc_id, generate_subscripts(l, 1) - 1 pos, unnest(l) "text" from (
  select doc_id, string_split("text", chr(10)) l from documents) x)"""

COUNTS = """pc as (select doc_id, len(list_filter(string_split("text", chr(10)),
  lambda x: contains(x, 'the '))) cnt from documents)"""

PATHS = """sp as (select s_suppkey // 50 "snapshot", s_acctbal, r_name r, n_name n, trim(s_name) s,
  '/' || r_name || '/' || n_name || '/' || trim(s_name) || '/' path, cast(s_suppkey as varchar) "value"
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
 later as (select "snapshot", path, case when s_acctbal >= 5000 then "value" || 'x' else "value" end
   "value" from sp where s_acctbal >= 0),
 earlier as (select "snapshot", path, "value" from sp where s_acctbal < 8000)"""


def _formula(expression: str) -> str:
    return f"""with {MEANS} select event_id, "cluster", round({expression}, 6) period
      from (select event_id, "cluster", avg_cost / 1000.0 c, avg_mtbf m from known) x"""


def _rollup(starts: str) -> str:
    return f"""with {AGENT}, w as (select "cluster", v, {starts} window_start from m where verb = 'UPDATE')
      select "cluster", window_start, count(*) n, cast(sum(v) as bigint) sum_rate,
      round(avg(v), 6) avg_rate, max(v) max_rate from w group by 1, 2"""


def _deadband(cand: str, rule: str) -> str:
    """Announcements of ``cand`` (cluster, n, kind, period, event_id), one row after the other."""
    return f"""with recursive {cand}, f as (
      select "cluster", cast(0 as bigint) n, cast(3600 as bigint) lst, false emit
      from (select distinct "cluster" from cd) x
      union all
      select f."cluster", cd.n, case when {rule} then cd.period else f.lst end, {rule}
      from f join cd on cd."cluster" = f."cluster" and cd.n = f.n + 1)"""


def _rank_iterations(n: int) -> str:
    parts = ["s0 as (select node, 1.0 / (select count(*) from nd) rank from nd)"]
    for i in range(1, n + 1):
        parts.append(
            f"""s{i} as (select nd.node, (1 - 0.85) / (select count(*) from nd) + 0.85 *
            coalesce(g.got, 0) rank from nd left join (select e.dst, sum(s.rank / dg.deg) got
            from e join s{i - 1} s on s.node = e.src join dg on dg.src = e.src group by 1) g
            on g.dst = nd.node)"""
        )
    return ",\n".join(parts)


def _unit(start: int) -> str:
    return f"cast(('0x' || substr(md5(k), {start}, 8)) as bigint) / 4294967296.0"


ORACLE: dict[str, str] = {
    **STATEFUL_SQL,
    "parse_messages": f"""with {EV}, x as (select event_id, t, cast(cast(floor(value) as bigint) as varchar) v,
        case when event_id % 97 = 0 then 1 when event_id % 101 = 0 then 2 when event_id % 103 = 0 then 3
        when event_id % 107 = 0 then 4 when event_id % 109 = 0 then 5 when event_id % 113 = 0 then 6
        when event_id % 127 = 0 then 9 when event_type = 'signup' then 7 when event_type = 'error' then 8 else 4 end c from ev)
      select event_id, case c when 2 then null when 3 then 'UPDATE-RAM' when 6 then 'UPDATE-CC'
        when 7 then 'IN' when 8 then 'OUT' when 9 then 'UPDATE-MTBF' else 'UPDATE' end verb,
        case c when 3 then 'x' when 4 then v when 5 then '1a' when 6 then v when 9 then cast(t as varchar) end payload,
        case when c in (1, 5) then 'message_error' when c = 2 then 'unknown' else 'ok' end status from x""",
    "roster_live": f"""with {LIVE} select event_id, client, cast(live as int) live,
      cast(case verb when 'IN' then true when 'OUT' then was else live end as int) accepted from r""",
    "client_latest": f"""with {LIVE}, z as (select *, row_number() over (partition by client
      order by us desc, event_id desc) b from r)
      select "cluster", client, case when verb = 'UPDATE' then v else 0 end latest
      from z where b = 1 and live""",
    "io_total": f"""with {TOTAL} select event_id, "cluster", cast(live as int) live, total from tot""",
    "io_step_period": f"""with {IO} select event_id, "cluster", total, period from io""",
    "io_period_changes": f"""with {IO}, z as (select *, lag(period, 1, 3600) over (partition by "cluster"
      order by us, event_id) prior from io)
      select event_id, "cluster", total, period from z where period <> prior""",
    "counter_rate": f"""with {COUNTER} select event_id, client, counter, rate from cr
      where rate is not null""",
    "rate_min_filter": f"with {COUNTER} select event_id, client, rate from cr where rate >= 25",
    "ram_alerts": f"""with {EV} select event_id, "cluster", least(value, 100) percent from ev
      where event_type = 'view' and least(value, 100) >= 40""",
    "ram_alert_latest": f"""with {EV}, z as (select "cluster", event_id, least(value, 100) pct,
      row_number() over (partition by "cluster" order by us desc, event_id desc) b from ev
      where event_type = 'view' and value >= 40)
      select "cluster", case when event_id % 7 = 0 then 0.0 else pct end percent from z where b = 1""",
    "notify_skip_first": f"""with {EV}, z as (select *, row_number() over (partition by "cluster",
      event_type order by us, event_id) b from ev where event_type in ('click', 'error'))
      select event_id, "cluster", event_type from z where b > 1""",
    "telemetry_tumbling": _rollup("t // 21600 * 21600"),
    "telemetry_sliding": _rollup("unnest([t // 7200 * 7200, t // 7200 * 7200 - 7200, t // 7200 * 7200 - 14400])"),
    "value_truncation": "select event_id, cast(trunc(value - 50) as bigint) stored from events",
    "ring_slots": f"""with {OBS} select event_id, "cluster", series, "value", seq,
      cast(seq % 50 as int) slot from oseq""",
    "ring_current": f"""with {OBS}, z as (select *, max(seq) over (partition by "cluster", series) last
      from oseq) select event_id, "cluster", series, "value", cast(seq % 50 as int) slot from z
      where seq > last - 50""",
    "history_avg": f"""with {MEANS} select event_id, "cluster", series, round(av, 6) avg_value from mv""",
    "tbf_simple": f"""with {OBS} select event_id, "cluster", "value" from obs where series = 'mtbf'""",
    "tbf_carry_last": f"""with {LIFE}, z as (select *, case when verb = 'STOP' and t - tslf > 0
        then t - tslf end el from lg),
      y as (select *, coalesce(last_value(el ignore nulls) over (partition by "cluster", g order by k
        rows between unbounded preceding and current row), 0) tebi from z)
      select event_id, "cluster", t - tslf + tebi "value" from y where verb = 'FAIL'""",
    "tbf_carry_accumulate": f"""with {LIFE}, z as (select *, case when verb <> 'START' and pv <> 'STOP'
        then t - pt else 0 end ran from lg),
      y as (select *, cast(sum(ran) over (partition by "cluster", g) as bigint) s from z)
      select event_id, "cluster", s "value" from y where verb = 'FAIL'""",
    "tbf_carry_offline": f"""with {LIFE}, z as (select *, case when verb = 'STOP' then t - tslf end el
        from lg),
      y as (select *, coalesce(last_value(el ignore nulls) over (partition by "cluster", g order by k
        rows between unbounded preceding and current row), 0) tebi from z)
      select event_id, "cluster", t - tslf + tebi "value" from y where verb = 'FAIL'""",
    "restore_snapshot": f"""with {EV}, z as (select event_id, us, "cluster", avg(trunc(value * 1000)) over
        (partition by "cluster" order by us, event_id rows between 19 preceding and current row) a
        from ev where event_type = 'click')
      select event_id, "cluster", cast(3600 as bigint) period, round(a, 6) avg_value from z
      where us >= 1705276800000000""",
    "restore_seed": f"""with {EV}, z as (select event_id, us, "cluster", avg(trunc(value * 1000)) over
        (partition by "cluster" order by us, event_id rows between 49 preceding and current row) a
        from ev where event_type = 'click')
      select event_id, "cluster", round(a, 6) avg_value from z where us >= 1705276800000000""",
    "run_cost_snapshot": f"""with {MEANS}, z as (
        select event_id, us, "cluster", av, 0 ask from mv where series = 'checkpoint'
        union all select event_id, us, "cluster", null, 1 from ev where event_type = 'purchase'),
      y as (select *, last_value(av ignore nulls) over (partition by "cluster" order by us, event_id, ask
        rows between unbounded preceding and current row) a from z)
      select event_id, "cluster", round(a, 6) avg_cost from y where ask = 1""",
    "young": _formula("sqrt(2 * c * m)"),
    "daly_first": _formula("sqrt(2 * c * (m + 10))"),
    "daly_high": _formula(
        "case when c >= 2 * m then m else sqrt(2 * m * c) * (1 + sqrt(c / (2 * m)) / 3 + c / (2 * m) / 9) - c end"
    ),
    "daly_high_compat": _formula("case when c >= 2 * m then m else sqrt(2 * m * c) - c end"),
    "period_candidates": f"""with {CAND} select event_id, "cluster", period from cand""",
    "period_dedup": f"""with {CAND}, z as (select *, lag(period, 1, 3600) over (partition by "cluster"
      order by us, event_id) prior from cand) select event_id, "cluster", period from z
      where period <> prior""",
    "period_deadband": _deadband(
        f"""{CAND}, cd as (select event_id, "cluster", period, row_number() over (partition by "cluster"
          order by us, event_id) n from cand)""",
        "abs(cd.period - f.lst) >= 5",
    )
    + """ select cd.event_id, cd."cluster", cd.period from f join cd
      on cd."cluster" = f."cluster" and cd.n = f.n where f.emit""",
    "controller_combined": _deadband(
        f"""{CAND}, {IO.removeprefix(EV + ",")}, cd as (select *, row_number() over (partition by "cluster"
          order by us, event_id, kind) n from (
          select event_id, us, "cluster", 0 kind, cast(period as bigint) period from io union all
          select event_id, us, "cluster", 1, period from cand) x)""",
        "abs(cd.period - f.lst) >= case cd.kind when 0 then 1 else 5 end",
    )
    + """ select cd.event_id, cd."cluster", cd.kind, cd.period from f join cd
      on cd."cluster" = f."cluster" and cd.n = f.n where f.emit""",
    "policy_gate": f"""with {CAND} select event_id, "cluster", round(avg_mtbf, 6) avg_mtbf,
      case when "cluster" % 2 = 0 then period end period from cand""",
    "policy_compare": _deadband(
        f"""{MEANS}, pol as (select known.*, avg_cost / 1000.0 c, avg_mtbf m, unnest([1, 2]) policy from known),
        cw as (select *, greatest(10, cast(trunc(case when policy = 1 then sqrt(2 * c * m)
          when c >= 2 * m then m
          else sqrt(2 * m * c) * (1 + sqrt(c / (2 * m)) / 3 + c / (2 * m) / 9) - c end) as bigint)) period
          from pol),
        cd as (select "cluster" * 10 + policy "cluster", period, c, m, row_number() over (
          partition by "cluster", policy order by us, event_id) n from cw)""",
        "abs(cd.period - f.lst) >= 5",
    )
    + """, em as (select "cluster", count(*) emits, round(avg(lst), 4) mean_period from f where emit group by 1),
      wa as (select "cluster", count(*) n_candidates, round(avg(c / period + period / (2 * m)), 4) mean_waste
        from cd group by 1)
      select wa."cluster" // 10 "cluster", cast(wa."cluster" % 10 as int) policy, n_candidates, emits, mean_period,
        mean_waste from wa left join em on em."cluster" = wa."cluster" """,
    "run_summary": f"""with {RUNS} select benchmark, phase, rep, count(*) n, round(avg(seconds), 4) mean,
      round(stddev_pop(seconds), 4) pstdev from r group by 1, 2, 3""",
    "run_grouped_median": f"""with {RUNS}, h as (select benchmark, phase, rep, seconds, count(*) f
        from r group by 1, 2, 3, 4),
      c as (select *, sum(f) over (partition by benchmark, phase, rep order by seconds) - f cf,
        sum(f) over (partition by benchmark, phase, rep) n from h)
      select benchmark, phase, rep, cast(n as bigint) n, round(seconds - 0.5 + (n / 2 - cf) / f, 4) grouped_median
      from c where cf <= n // 2 and n // 2 < cf + f""",
    "run_overhead": f"""with {RUNS}, s as (select benchmark, phase, avg(seconds) mean from r group by 1, 2),
      a as (select benchmark, mean base from s where phase = 'AF')
      select s.benchmark, phase, round(100 - 26.0 * 100.0 / mean, 4) over_fixed,
        round(100 - base * 100.0 / mean, 4) + 0.0 over_af from s left join a on a.benchmark = s.benchmark""",
    "run_margin": f"""with {RUNS}, s as (select benchmark, phase, rep, avg(seconds) mean,
        1.96 * stddev_pop(seconds) p, count(*) n from r group by 1, 2, 3)
      select benchmark, phase, rep, round(p / sqrt(20), 4) margin20, round(p / sqrt(n), 4) margin,
        round(mean - p / sqrt(n), 4) low, round(mean + p / sqrt(n), 4) high from s""",
    "run_lines_parse": f"""with {RUNS} select l_orderkey, l_linenumber,
      case when rep % 3 <> 0 then 'TestDFSIO' end benchmark, case when rep % 3 <> 0 then phase end phase,
      rep, cast(seconds as double) as seconds, case when rep % 3 <> 0 then seconds end after_equals from r""",
    "last_token": f"""with {RUNS} select l_orderkey, l_linenumber, round(mb, 4) "value" from r
      where rep % 2 <> 0""",
    "run_duration": """with e as (select l_orderkey run, max(epoch_us(l_shipdate) // 1000000) end_s
        from lineitem group by 1),
      s as (select o_orderkey run, min(epoch_us(o_orderdate) // 1000000) start_s from orders group by 1)
      select s.run, start_s, end_s, end_s - start_s as seconds from s join e on e.run = s.run""",
    "phase_compare": f"""with {RUNS}, s as (select benchmark, rep,
        avg(case when phase = 'AF' then seconds end) a, avg(case when phase = 'DF' then seconds end) d
        from r group by 1, 2)
      select benchmark, rep, round(a, 4) mean_af, round(d, 4) mean_df, round(d / a, 4) ratio from s""",
    "checkpoint_compare": f"""with {RUNS}, s as (select benchmark,
        avg(case when l_orderkey % 2 = 0 then seconds end) a,
        avg(case when l_orderkey % 2 <> 0 then seconds end) d from r group by 1)
      select benchmark, round(a, 4) mean_3600, round(d, 4) mean_10, round(d / a, 4) ratio from s""",
    "io_consistency": f"""with {RUNS}, s as (select l_orderkey, sum(mb) / sum(seconds) t, avg(mb / seconds) a,
        stddev_pop(mb / seconds) s, 512.0 / max(seconds) x, 512.0 / min(seconds) y,
        1024.0 / (max(seconds) + min(seconds)) * case when l_orderkey % 5 = 0 then 1.01 else 1 end u
        from r group by 1),
      d as (select *, (x + y) / 2 ea, abs(x - y) / 2 es from s)
      select l_orderkey, round(u, 4) throughput, cast(abs((ea * ea - es * es) / ea - u) / u <= 1e-6 as int) consistent,
        cast(abs((a * a - s * s) / a - t) / t <= 1e-6 as int) uneven from d""",
    "io_summary": f"""with {RUNS} select benchmark, phase, count(*) n_tasks, round(sum(mb), 2) total_mb,
      round(sum(mb) / sum(seconds), 2) throughput, round(avg(mb / seconds), 2) avg_io,
      round(stddev_pop(mb / seconds), 2) io_std from r group by 1, 2""",
    "pattern_count_file": f"with {COUNTS} select doc_id, cnt from pc",
    "pattern_mean": f"with {COUNTS} select count(*) n_files, round(avg(cnt), 4) mean_cnt from pc",
    "pattern_cumulative_mean": f"""with {COUNTS} select count(*) n_files,
      round(arg_max(cnt, doc_id) / count(*), 6) mean_cnt from pc""",
    "token_mean": f"""with {EV} select count(*) n_lines,
      round(avg(cast(floor(value) as bigint)), 4) mean_token from ev where event_type <> 'view'""",
    "clean_lines": f"""with {LINES} select doc_id, cast(pos as int) pos, "text" from ln where not contains("text", 'the ')
      and not contains("text", 'License') and not contains("text", '@')""",
    "log_records": f"""with {EV} select "cluster", row_number() over (partition by "cluster"
        order by us, event_id) record_no, us // 1000 ms, cast("cluster" as varchar) myid,
      case when event_type = 'error' then 'WARN' else 'INFO' end "level", 'main' thread,
      upper(substr(event_type, 1, 1)) || substr(event_type, 2) "class", cast(client as int) src_line,
      'event ' || event_id message, cast(case when event_type = 'error' then 2 else 0 end as bigint) n_more from ev""",
    "severity_rollup": f"""with {EV} select "cluster", event_type, t // 86400 * 86400 bucket, count(*) n
      from ev group by 1, 2, 3""",
    "session_lifetimes": f"""with {EV}, s as (select client,
        min(case when event_type = 'signup' then t end) opened_at,
        max(case when event_type = 'error' then t end) closed_at from ev group by 1)
      select client, opened_at, closed_at, closed_at - opened_at lifetime from s""",
    "kv_nest": f"""with {PATHS},
      a as (select "snapshot", r, n, string_agg('"' || s || '": ["' || "value" || '", "' || path || '", {{}}]',
        ', ' order by s) x from sp group by 1, 2, 3),
      b as (select "snapshot", r, string_agg('"' || n || '": ["", "/' || r || '/' || n || '/", {{' || x || '}}]',
        ', ' order by n) x from a group by 1, 2),
      c as (select "snapshot", string_agg('"' || r || '": ["", "/' || r || '/", {{' || x || '}}]',
        ', ' order by r) x from b group by 1)
      select "snapshot", '{{"/": ["", "/", {{' || x || '}}]}}' doc from c""",
    "kv_flatten": f"""with {PATHS}
      select "snapshot", 3 depth, path, s name, '/' || r || '/' || n || '/' parent, "value" from sp
      union all select distinct "snapshot", 2, '/' || r || '/' || n || '/', n, '/' || r || '/', '' from sp
      union all select distinct "snapshot", 1, '/' || r || '/', r, '/', '' from sp
      union all select distinct "snapshot", 0, '/', '/', null, '' from sp""",
    "kv_upsert": f"""with {PATHS}
      select coalesce(b."snapshot", a."snapshot") "snapshot", coalesce(b.path, a.path) path,
        coalesce(b."value", a."value") "value", case when b.path is null then 'Unchanged'
        when a.path is null then 'Created' else 'Modified' end action
      from earlier a full join later b on a."snapshot" = b."snapshot" and a.path = b.path""",
    "kv_diff": f"""with {PATHS} select coalesce(b."snapshot", a."snapshot") "snapshot",
        coalesce(b.path, a.path) path, a."value" old_value, b."value" new_value,
        case when a.path is null then 'Created' when b.path is null then 'Removed'
          when a."value" = b."value" then 'Unchanged' else 'Modified' end change
      from earlier a full join later b on a."snapshot" = b."snapshot" and a.path = b.path""",
    "wordcount": """select word, count(*) cnt from (select unnest(regexp_split_to_array("text",
      '[ \\t\\r\\n]+')) word from documents) x where word <> '' group by 1""",
    "pagerank": f"""with w as (select distinct o_custkey src, -l_suppkey - 1 dst from orders
        join lineitem on l_orderkey = o_orderkey),
      e as (select src, dst from w union all select dst, src from w),
      dg as (select src, count(*) deg from e group by 1),
      nd as (select src node from e union select dst from e),
      {_rank_iterations(3)}
      select node, round(rank, 6) rank from s3""",
    "terasort_check": """select row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_partkey,
      l_suppkey) pos, l_orderkey, l_linenumber from lineitem""",
    "pi_hash": f"""with k as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) k
        from lineitem),
      p as (select {_unit(1)} x, {_unit(9)} y, 0 w from k union all
        select {_unit(17)}, {_unit(25)}, 7 from k),
      h as (select w, case when (2 * x - 1) * (2 * x - 1) + (2 * y - 1) * (2 * y - 1) <= 1 then 1 else 0 end i
        from p)
      select count(*) n, cast(sum(i) as bigint) hits, cast(sum(i * w) as bigint) sevens,
        round(4.0 * sum(i) / count(*), 6) pi from h""",
    "total_sort": 'select count(*) n_rows, cast(0 as bigint) "overlaps" from lineitem',
    "late_rows": f"""with {EV}, a as (select *, us + (event_id * 7919 % 7200) * 1000000 arrived from ev),
      z as (select *, max(us) over (partition by "cluster" order by arrived, event_id
        rows between unbounded preceding and 1 preceding) seen from a)
      select event_id, "cluster", cast(coalesce(us < seen, false) as int) late from z""",
    "scan_null_keys": f"""with {EV}, n as (select * replace (nullif("cluster", 3) as "cluster") from ev)
      select event_id, "cluster", cast(sum(cast(floor(value) as bigint)) over w as bigint) total,
        last_value(case when event_type = 'error' then event_id end ignore nulls) over w known,
        lag(event_id) over (partition by "cluster" order by us, event_id) prior from n
      window w as (partition by "cluster" order by us, event_id rows between unbounded preceding and current row)""",
    "period_from_carry": _deadband(
        f"""{CARRY_CAND}, cd as (select event_id, "cluster", period, row_number() over (partition by "cluster"
          order by us, event_id) n from cand)""",
        "abs(cd.period - f.lst) >= 5",
    )
    + """ select cd.event_id, cd."cluster", cd.period from f join cd
      on cd."cluster" = f."cluster" and cd.n = f.n where f.emit""",
    "controller_with_carry": _deadband(
        f"""{CARRY_CAND}, {IO.removeprefix(EV + ",")}, cd as (select *, row_number() over (partition by "cluster"
          order by us, event_id, kind) n from (
          select event_id, us, "cluster", 0 kind, cast(period as bigint) period from io union all
          select event_id, us, "cluster", 1, period from cand where "cluster" % 2 = 0) x)""",
        "abs(cd.period - f.lst) >= case cd.kind when 0 then 1 else 5 end",
    )
    + """ select cd.event_id, cd."cluster", cd.kind, cd.period from f join cd
      on cd."cluster" = f."cluster" and cd.n = f.n where f.emit""",
    "period_deadband_steady": _deadband(
        f"""{EV}, cd as (select event_id, "cluster" % 2 "cluster", 800 + 7 * (event_id // 2000)
          + cast(floor(value) as bigint) % 3 period,
          row_number() over (partition by "cluster" % 2 order by us, event_id) n from ev)""",
        "abs(cd.period - f.lst) >= 5",
    )
    + """ select cd.event_id, cd."cluster", cd.period from f join cd
      on cd."cluster" = f."cluster" and cd.n = f.n where f.emit""",
    "step_period_table": f"""with {TOTAL} select event_id, "cluster", total, {STEP} period from tot""",
    "run_labels": f"""with {RUNS}, k as (select *, (l_orderkey + rep) % 7 c, l_orderkey % 3 <> 0 titled from r)
      select l_orderkey file, cast(rep as bigint) line_id, case c when 0 then 'TeraGen' when 1 then 'TestDFSIO'
          when 2 then 'TestDFSIO' when 3 then 'TestDFSIOe' when 4 then 'Spark HiBench'
          else case when titled then 'PageRank' end end benchmark,
        case when c in (1, 3, 4) then phase end phase, case when c = 2 then 3600 end checkpoint_s,
        rep, cast(seconds as double) as seconds, case when titled then 'large' end profile from k""",
    "report_fields": """select l_orderkey, case when l_linenumber % 2 = 0 then 'read' else 'write' end op,
        case l_linenumber % 3 when 2 then null when 0 then epoch_us(l_shipdate) // 1000000 + 10800
          else epoch_us(l_shipdate) // 1000000 end run_s, l_linenumber n_files, l_extendedprice total_mb,
        cast(l_quantity as double) throughput, l_discount avg_io, case when l_linenumber <> 4 then l_tax end io_std,
        cast(l_partkey as double) exec_s from lineitem""",
    "step_table": """select cast(o_orderkey as int) threshold, cast(year(o_orderdate) as int) period from orders
      union all select -1, 500 from (select distinct o_custkey from orders) x""",
    "file_lines": f"""with {LINES}, k as (select doc_id, pos, len("text") n from ln where contains("text", '|'))
      select doc_id file, row_number() over (partition by doc_id order by pos) line_no, cast(n as int) n_chars from k
      union all select doc_id, null, null from documents where doc_id not in (select doc_id from k)""",
    "kv_nest_region": """with sp as (select r_name r, n_name n, trim(s_name) s, '/' || r_name || '/' || n_name || '/'
          || trim(s_name) || '/' path, cast(s_suppkey as varchar) "value"
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
      a as (select r, n, string_agg('"' || s || '": ["' || "value" || '", "' || path || '", {}]',
        ', ' order by s) x from sp group by 1, 2),
      b as (select r, string_agg('"' || n || '": ["", "/' || r || '/' || n || '/", {' || x || '}]',
        ', ' order by n) x from a group by 1)
      select r "snapshot", '{"/": ["", "/", {"' || r || '": ["", "/' || r || '/", {' || x || '}]}]}' doc from b""",
    "kv_flatten_texts": """select doc_id "snapshot", 2 depth, '/' || lang || '/' || doc_id || '/' path,
        md5("text") "value" from documents
      union all select doc_id, 1, '/' || lang || '/', md5('') from documents
      union all select doc_id, 0, '/', md5('') from documents""",
    "uniq_consecutive": f"""with {EV}, z as (select *, lag(event_type) over (partition by "cluster"
      order by us, event_id) prior from ev)
      select event_id, "cluster", event_type from z where prior is distinct from event_type""",
    "fixed_batches": f"""with {EV}, z as (select event_id, row_number() over (order by us, event_id) - 1 i
        from ev)
      select event_id, case when i < 6400 then i // 64 end batch, case when i < 6400 then i % 64 end place
      from z""",
    "batch_capacity": f"""with {EV} select "cluster", count(*) available, cast(1280 as bigint) requested,
      count(*) >= 1280 enough from ev group by 1""",
    "seq_ids": "select row_number() over (order by o_orderkey) myid, o_orderkey from orders",
    "nth_per_group": """with z as (select *, row_number() over (partition by o_custkey
        order by o_orderdate, o_orderkey) b from orders)
      select o_custkey, max(case when b = 1 then o_orderkey end) main,
        max(case when b = 2 then o_orderkey end) secondary from z group by 1""",
}
