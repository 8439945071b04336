"""SQL for DuckDB of the queries in `stateful`, written independently of the operators."""

from __future__ import annotations

SESSIONS = """ev as (select user_id client, epoch_us(ts) us, event_id from events),
 isl as (select *, coalesce(us - lag(us) over (partition by client order by us, event_id) > 21600000000, true) fresh
   from ev),
 num as (select *, sum(fresh::int) over (partition by client order by us, event_id
   rows between unbounded preceding and current row) island from isl),
 ses as (select client, min(us) start_us, max(us) end_us, count(*) n from num group by client, island)"""

REGION_TEXTS = """sp as (select r_name r, n_name n, trim(s_name) s, '/' || r_name || '/' || n_name || '/'
    || trim(s_name) || '/' path, cast(s_suppkey as varchar) "value"
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
 a as (select r, n, string_agg('"' || s || '": ["' || "value" || '", "' || path || '", {}]', ', ' order by s) x
   from sp group by 1, 2),
 b as (select r, string_agg('"' || n || '": ["", "/' || r || '/' || n || '/", {' || x || '}]', ', ' order by n) x
   from a group by 1),
 texts as (select r "snapshot", '{"/": ["", "/", {"' || r || '": ["", "/' || r || '/", {' || x || '}]}]}' doc from b)"""

STATEFUL_SQL = {
    "live_notices": """
with ev as (select event_id, epoch_us(ts) us, user_id % 8 "cluster", user_id client,
    case event_type when 'signup' then 'IN' when 'error' then 'OUT' else 'UPDATE' end verb,
    cast(floor(value) as bigint) v from events),
 m as (select * from ev union all
   select -1, min(us) - 3600000000, "cluster", client, 'RESTORE', client from ev where client % 3 = 0
   group by "cluster", client),
 f as (select *, coalesce(us - lag(us) over w > 43200000000, false) fresh from m
   window w as (partition by client order by us, event_id)),
 i as (select *, sum(fresh::int) over (partition by client order by us, event_id
   rows between unbounded preceding and current row) island from f),
 s as (select *,
   coalesce(last_value(case when verb <> 'UPDATE' then verb end ignore nulls) over before, 'OUT') <> 'OUT' was_live,
   coalesce(last_value(case when verb <> 'UPDATE' then verb end ignore nulls) over upto, 'OUT') <> 'OUT' live
   from i window before as (partition by client, island order by us, event_id
     rows between unbounded preceding and 1 preceding), upto as (partition by client, island order by us, event_id
     rows between unbounded preceding and current row)),
 r as (select *, case when verb = 'IN' then 0 when verb = 'RESTORE' or verb = 'UPDATE' and was_live then v end rate
   from s),
 t as (select *, last_value(rate ignore nulls) over before rate_before, last_value(rate ignore nulls) over upto rate_now,
   lead(us) over (partition by client, island order by us, event_id) is null ends,
   lead(us) over (partition by client order by us, event_id) is null over_
   from r window before as (partition by client, island order by us, event_id
     rows between unbounded preceding and 1 preceding), upto as (partition by client, island order by us, event_id
     rows between unbounded preceding and current row)),
 told as (
   select "cluster", client, us, case when was_live then 'reset' else 'registered' end kind,
     case when was_live then rate_before else 0 end "value" from t where verb = 'IN'
   union all select "cluster", client, us, 'left', rate_before from t where verb = 'OUT' and was_live
   union all select "cluster", client, us + 43200000000, 'expired', rate_now from t where live and ends
     and (not over_ or (us + 43200000000) // 1000 < (select max(us) // 1000 from ev) - 600500))
select * exclude (k) from (select *, row_number() over (partition by client order by us) k from told) where k > 1""",
    "run_spans_stream": """
with o as (select o_orderkey run, cast(o_orderdate as timestamp) s from orders),
 l as (select l_orderkey run, l_linenumber, cast(l_shipdate as timestamp) e from lineitem),
 w as (select least((select max(s) from o), (select max(e) from l)) - interval 12 hours wm),
 p as (select run, l_linenumber, s, e from o join l using (run) where e >= s and e <= s + interval 60 days)
select run, l_linenumber, cast(epoch(e) - epoch(s) as bigint) as "seconds", 'paired' status from p
union all select run, null, null, 'no_end' from o, w
  where not exists (select 1 from p where p.run = o.run) and s + interval 60 days < wm
union all select run, l_linenumber, null, 'no_start' from l, w
  where e < wm and not exists (select 1 from o where o.run = l.run and l.e >= o.s and l.e <= o.s + interval 60 days)""",
    "client_sessions": f"with {SESSIONS} select * from ses",
    "client_sessions_stream": f"""with {SESSIONS} select * from ses
where (end_us + 21600000000) // 1000 <= (select max(us) // 1000 from ev) - 600500""",
    "kv_nest_pieces": f"""with {REGION_TEXTS}
select "snapshot", k piece, substr(doc, k * 512 + 1, 512) "text"
from texts, lateral (select unnest(range(0, (length(doc) + 511) // 512)) k)""",
    "kv_nest_all_documents": """
with d as (select lang, source, lpad(doc_id::varchar, 12, '0') doc, md5("text") v from documents),
 a as (select lang, source, string_agg('"' || doc || '": ["' || v || '", "/' || lang || '/' || source || '/' || doc ||
   '/", {}]', ', ' order by doc) x from d group by 1, 2),
 s as (select lang, string_agg('"' || source || '": ["", "/' || lang || '/' || source || '/", {' || x || '}]',
   ', ' order by source) x from a group by 1),
 t as (select '{"/": ["", "/", {' || string_agg('"' || lang || '": ["", "/' || lang || '/", {' || x || '}]', ', '
   order by lang) || '}]}' doc from s)
select k piece, substr(doc, k * 16384 + 1, 16384) "text"
from t, lateral (select unnest(range(0, (length(doc) + 16383) // 16384)) k)""",
    "kv_upsert_log": """
with c as (select greatest(0, least(9, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1) // 8)) batch,
   '/customer/' || o_custkey || '/' path, o_orderkey::varchar "value", o_orderdate, o_orderkey from orders)
select path, "value", batch from c
qualify row_number() over (partition by path order by batch desc, o_orderdate desc, o_orderkey desc) = 1""",
    "kv_flatten_recursive": """
with leaf as (select doc_id // 500 "snapshot", '/' || array_to_string(string_split(doc_id::varchar, ''), '/') || '/' path,
   length(doc_id::varchar) depth, md5("text") v from documents),
 inner_ as (select distinct "snapshot", substr(path, 1, 2 * k + 1) path, k depth
   from leaf, lateral (select unnest(range(0, depth)) k)),
 every as (select "snapshot", path, depth, max(v) v from (select * from leaf union all
   select "snapshot", path, depth, null from inner_) group by 1, 2, 3)
select "snapshot", depth::int depth, path, case when depth = 0 then '/' else substr(path, 2 * depth, 1) end "name",
  case when depth > 0 then substr(path, 1, 2 * depth - 1) end parent, coalesce(v, '') "value" from every""",
    "log_source_lines": """
with d as (select doc_id, doc_id // 200 file_no, string_split("text", chr(10)) x from documents where "text" is not null),
 l as (select file_no, doc_id, unnest(range(len(x))) pos, unnest(x) t from d),
 n as (select file_no, t, row_number() over (partition by file_no order by doc_id, pos) line_no from l)
select file_no, count(*) n_lines, max(line_no) last_line, count(*) filter (where contains(t, 'the ')) hits,
  min(line_no) filter (where contains(t, 'the ')) first_hit, sum(length(t))::bigint n_chars from n group by file_no""",
    "grouped_median_sketch": """
with r as (select l_returnflag benchmark, strftime(l_shipdate, '%Y-%m') "month", l_quantity::int x from lineitem),
 h as (select benchmark, "month", x, count(*) f from r group by 1, 2, 3),
 c as (select *, sum(f) over (partition by benchmark, "month" order by x) - f cf,
   sum(f) over (partition by benchmark, "month") n from h)
select benchmark, "month", n::bigint n, round(x - 0.5 + (n / 2 - cf) / f, 6) grouped_median, true "within" from c
where cf <= n // 2 and n // 2 < cf + f""",
    "phase_subtotals": """
with r as (select l_returnflag benchmark, l_linenumber rep, l_quantity::int s, l_linestatus = 'O' af from lineitem),
 g as (select benchmark, rep, grouping_id(benchmark, rep)::int "grouping", count(s) n, avg(case when af then s end) a,
   avg(case when not af then s end) d from r group by cube (benchmark, rep))
select benchmark, rep::int rep, "grouping", n, round(a, 6) mean_af, round(d, 6) mean_df, round(d / a, 6) ratio from g""",
    "transfer_write": """
with r as (select l_orderkey % 16 part, concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag,
   l_linestatus) line from lineitem)
select part, count(*) part_rows, 1::bigint n_files, sum(strlen(line) + 1)::bigint part_bytes,
  (select count(*) from r) n_rows, (select sum(strlen(line) + 1)::bigint from r) n_bytes from r group by part""",
    "stream_without_repeats": """
select user_id % 8 "cluster", event_id, case event_type when 'signup' then 'IN' when 'error' then 'OUT' else 'UPDATE' end
  verb, cast(floor(value) as bigint) v from events""",
}
