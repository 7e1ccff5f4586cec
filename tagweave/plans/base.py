"""Registry of queries with their SQL, and the model's tables as SQL over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

#: The adapters (tagweave.sources.adapters) in SQL; a query names those it needs.
VIEWS = r"""with
ev as (select o_orderkey + 1 as event_id, o_orderpriority as title, o_orderstatus as description, case when o_orderkey % 101 <> 0 then o_orderdate end as starts_at, o_orderdate - interval 30 day as created_at, n_name as campus, cast(o_orderstatus <> 'F' as int) as is_active, o_orderkey % 50 = 0 as is_demo from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
gr as (select p_partkey + 1 as group_id, p_name as name, p_type as description, p_brand as meeting_details, 'NATION_' || (p_partkey % 25) as campus, 1 as is_active, p_partkey % 50 = 0 as is_demo from part),
etn as (select l_orderkey + 1 as owner_id, l_returnflag as tag_name from lineitem union select l_orderkey + 1, l_linestatus from lineitem),
gtn as (select distinct owner_id, tag_name from (select p_partkey + 1 as owner_id, unnest(string_split(p_name, ' ')) as tag_name from part union all select p_partkey + 1, p_type from part)),
tg as (select row_number() over (order by tag_name) as tag_id, tag_name from (select tag_name from etn union select tag_name from gtn)),
elist as (select owner_id, string_agg(tag_name, ', ' order by tag_name) as tags from etn group by owner_id),
glist as (select owner_id, string_agg(tag_name, ', ' order by tag_name) as tags from gtn group by owner_id),
cat as (
  select 'event:' || event_id as item_id, 'event' as item_type, title, description, coalesce(tags, '') as tags, campus, starts_at, is_active, '' as location, '' as meeting_details, is_demo, created_at, title || ' | ' || description || ' | ' || coalesce(tags, '') as search_text from ev left join elist on owner_id = event_id
  union all select 'group:' || group_id, 'group', name, description, coalesce(tags, ''), campus, cast(null as timestamp), is_active, '', meeting_details, is_demo, cast(null as timestamp), name || ' | ' || description || ' | ' || coalesce(tags, '') from gr left join glist on owner_id = group_id),
clock as (select timestamp '1998-01-01 00:00:00' as t),
open_items as (select cat.* from cat, clock where is_active = 1 and (item_type = 'group' or starts_at >= t)),
prof as (select c_custkey as user_id, c_name as name, c_mktsegment as major, p_type as bio, n_name as campus, string_split(p_name, ' ') as interests from customer join nation on c_nationkey = n_nationkey join part on p_partkey = c_custkey),
log as (select user_id, 'event:' || (cast(json_extract(props, '$.k') as bigint) + 1) as item_id, ts, event_id as seq, case when event_type in ('purchase', 'click') then 'interested' when event_type = 'signup' then 'clear' else 'pass' end as action from events),
latest as (select user_id, item_id, action, ts, seq from log qualify row_number() over (partition by user_id, item_id order by ts desc, seq desc) = 1),
sw as (select * from latest where action <> 'clear'),
lst as (select doc_id as i, case when doc_id % 97 = 0 then 'bad' else md5(cast(doc_id as varchar)) end as event_id, case when doc_id % 97 = 3 then ' ' else substr(text, 1, 60) end as title,
  case when doc_id % 97 = 1 then 'tomorrow' else strftime(t + to_hours(doc_id), '%Y-%m-%dT%H:%M:%SZ') end as start_time, case when doc_id % 97 = 2 then 'javascript:alert(1)' else 'https://example.org/e/' || doc_id end as source_url,
  case when doc_id % 5 = 0 then '' else text end as description, case when doc_id % 10 = 0 then '' else 'About ' || source end as short_description, case when doc_id % 20 <> 0 then source end as organizer_name, doc_id % 7 = 0 as all_day,
  case when doc_id % 3 = 0 then '' else source end as venue_name, doc_id % 2 = 0 as is_online, lang = 'en' as is_umd, t + to_hours(doc_id) as starts, lang, source from documents, clock),
norm as (select i, 'umd-import:' || event_id as key, regexp_replace(title, '^\s+|\s+$', '', 'g') as title,
  'Official listing: ' || source_url || chr(10) || chr(10) || coalesce(nullif(description, ''), nullif(short_description, ''), 'Hosted by ' || coalesce(nullif(organizer_name, ''), 'the event organizer') || '. See the official listing for details.') || case when all_day then chr(10) || chr(10) || 'All-day event; check the official listing for attendance hours.' else '' end as description,
  coalesce(nullif(venue_name, ''), case when is_online then 'Online' end, 'Location listed on official event page') as location, case when i % 97 <> 1 then starts end as starts_at, case when is_umd then 'UMD' else 'NEAR_UMD' end as campus, timestamp '1997-12-01' as created_at,
  array[lang, source] as tags, concat_ws(' ', case when i % 97 in (0, 3) then 'Invalid event identity/title.' end, case when i % 97 = 1 then 'Invalid event timestamp.' end, case when i % 97 = 2 then 'Event source must use HTTPS.' end) as errors from lst),
good as (select * from norm where errors = ''),
toks as (select item_id, campus, unnest(regexp_extract_all(lower(search_text), '[a-z0-9]+')) as term from cat),
lens as (select item_id, campus, count(*) as length from toks group by 1, 2),
tot as (select count(*) as n_items, avg(length) as avg_length from lens),
tf as (select item_id, campus, term, count(*) as tf from toks group by 1, 2, 3),
dfs as (select term, count(*) as df from tf group by 1),
post as (select tf.item_id, tf.campus, tf.term, tf, length, n_items, avg_length, df, ln(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length)) as w from tf join lens using (item_id) join dfs using (term), tot),
asked as (select user_id, campus, 'Major: ' || major || '. Interests: ' || array_to_string(interests, ', ') || '. About me: ' || bio as query from prof),
qterms as (select distinct campus, query, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) as term from (select distinct campus, query from asked)),
scored as (select q.campus, q.query, p.item_id, round(sum(p.w), 6) as score from qterms q join post p using (campus, term) where p.item_id in (select item_id from open_items) group by 1, 2, 3),
top as (select * from (select *, row_number() over (partition by campus, query order by score desc, item_id) as rank from scored) where rank <= 50),
rec as (select user_id, item_id, score, rank from asked join top using (campus, query))
"""

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its name, with the body of its SQL after VIEWS."""

    def add(f: Callable) -> Callable:
        from tagweave.sources.adapters import Tables

        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = VIEWS + sql
        return f

    return add
