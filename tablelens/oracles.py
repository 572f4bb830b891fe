"""For each registered query, the same question in the SQL of DuckDB."""

from __future__ import annotations

LINES = """
  select doc_id, source, unnest(string_split(text, chr(10))) as line_text,
         generate_subscripts(string_split(text, chr(10)), 1) as line
  from documents"""

EDGES = """
  select src, dst, bool_or(f) as flag
  from (
    select 'O' || o_orderkey as src, 'C' || o_custkey as dst, o_orderstatus = 'F' as f from orders
    union select 'C' || c_custkey, 'N' || c_nationkey, false from customer
    union select 'S' || s_suppkey, 'N' || s_nationkey, true from supplier
    union select 'N' || n_nationkey, 'R' || n_regionkey, false from nation
    union select 'L' || l_orderkey, 'P' || l_partkey, l_returnflag = 'R' from lineitem
  )
  where src <> dst
  group by src, dst"""

YEAR_BOUNDS = """
  (values (1, timestamp '1996-01-01'), (2, timestamp '1997-01-01'),
          (3, timestamp '1999-01-01'), (4, timestamp '2001-01-01')) b(n, v)"""

RUNS = """
  with s as (
    select user_id, event_type, row_number() over w as n,
           count(*) over (partition by user_id) as key_len,
           coalesce(lag(event_type) over w, '') <> event_type as chg
    from events window w as (partition by user_id order by ts, event_id)
  ), g as (
    select *, sum(chg::int) over (
      partition by user_id order by n rows unbounded preceding) as grp
    from s
  )
  select user_id, grp::bigint as run_no, event_type, min(n) as first_n, max(n) as last_n,
         count(*) as len, key_len
  from g group by all"""

SIZES = """
  select p_brand, p_size, row_number() over (partition by p_brand order by p_size) as n
  from (select distinct p_brand, p_size from part)"""

DISCRETE = """
  select p_brand, p_size, n,
         coalesce(a + 1 = p_size and p_size + 1 = coalesce(c, p_size + 1), false) as is_discrete
  from (
    select *, lag(p_size) over w as a, lead(p_size) over w as c
    from ({sizes}) window w as (partition by p_brand order by p_size)
  )""".format(sizes=SIZES)


def sequence_sql(table: str, col: str) -> str:
    return f"""
  select '{col}' as col, min({col}) as start_value, max({col}) as current_value,
         count(distinct {col}) as n_distinct,
         case when (max({col}) - min({col})) % (count(distinct {col}) - 1) = 0
              then (max({col}) - min({col})) // (count(distinct {col}) - 1) end as step,
         max({col}) - min({col}) + 1 - count(distinct {col}) as n_missing,
         9223372036854775807 - max({col}) as headroom
  from {table}"""


def summary_sql(name: str, table: str, part: str, fixed: str, texts: str) -> str:
    return f"""
  select '{name}' as tbl, count(*) as n_rows, count(distinct {part}) as n_parts,
         sum({fixed} + {texts})::bigint as bytes
  from {table}"""


def column_sql(ordinal: int, col: str, type_name: str, max_bytes: str) -> str:
    return f"""
  select {ordinal} as ordinal, '{col}' as col, '{type_name}' as type, count(*) as n_rows,
         count(*) - count({col}) as n_null, count({col}) < count(*) as is_nullable,
         {max_bytes} as max_bytes
  from (select * replace (nullif(o_orderpriority, '5-LOW') as o_orderpriority) from orders)"""


def unique_sql(table: str, cols: str) -> str:
    return f"""
  select '{cols}' as cols, sum(c)::bigint as n_rows, count(*) as n_distinct,
         max(c) = 1 as is_unique
  from (select count(*) as c from {table} group by {cols.replace(";", ",")})"""


# The layout from degrees: a first hop takes as many lines as it has hops behind it, or
# one, and its lines follow those of the hops before it. Only edges are ever sorted;
# both sides are the same query over edges seen from either end.
LAID = """
  leg as (
    select side, hub, spoke, rel, row_number() over w as place, count(*) over (partition by side, hub) as places
    from (select 'in' as side, dst as hub, src as spoke, rel from e
          union all select 'out', src, dst, rel from e)
    window w as (partition by side, hub order by spoke)
  ), width as (
    select side, hub as spoke, any_value(places) as n from leg group by side, hub
  ), near as (
    select leg.*, sum(coalesce(n, 1)) over (
             partition by side, hub order by spoke rows unbounded preceding) - coalesce(n, 1) as skipped,
           sum(coalesce(n, 1)) over (partition by side, hub) as total
    from leg left join width using (side, spoke)
  ), line as (
    select near.side, near.hub as focus, near.spoke as hop, near.rel as hop_rel, near.total,
           far.spoke as next, far.rel as next_rel, far.place, far.places,
           (near.skipped + coalesce(far.place, 1))::bigint as line_no
    from near left join leg far on far.side = near.side and far.hub = near.spoke
  ), signed as (
    select line.*, (line_no - total // 2)::bigint as ordinal, coalesce(place = places // 2 + 1, true) as shown,
           case when total = 1 then chr(8722) when line_no = 1 then opening when line_no = total then closing
                else chr(8739) end as hop_mark,
           case when place is null then '' when places = 1 then chr(8722) when place = 1 then opening
                when place = places then closing else chr(8739) end as next_mark
    from line join (values ('in', '\\', '/'), ('out', '/', '\\')) t(side, opening, closing) using (side)
  ), laid as (
    select focus, ordinal, case when ordinal = 1 then focus else '' end as node,
           {columns}
    from signed group by focus, ordinal
  )""".format(
    columns=", ".join(
        f"{f'coalesce({value}, {default})' if default else value} as {name.format(side=side)}"
        for side in ("in", "out")
        for name, value, default in (
            (name, f"any_value({column}) filter (side = '{side}')", default)
            for name, column, default in (
                ("{side}1", "hop", None),
                ("{side}2", "next", None),
                ("{side}1_rel", "hop_rel", None),
                ("{side}2_rel", "next_rel", None),
                ("show_{side}1", "shown", None),
                ("{side}_mark", "hop_mark", "''"),
                ("{side}2_mark", "next_mark", "''"),
            )
        )
    )
)



def two_hop_sql(way: str, focus: str, also: str = "") -> str:
    """Hops from the nodes that meet a condition; the second ones come as a list per first."""
    hub, spoke = ("dst", "src") if way == "in" else ("src", "dst")
    return f"""
  select node as focus, hop1, unnest(coalesce(spokes, [null])) as hop2{also}
  from (select {hub} as node, {spoke} as hop1 from ({EDGES}))
  left join (select {hub} as hop1, list({spoke}) as spokes from ({EDGES}) group by {hub}) using (hop1)
  where {focus}"""


def key_sets_sql(columns: str) -> str:
    """The ten column sets of a table, each counted by itself."""
    sets = [
        "l_orderkey", "l_orderkey;l_linenumber", "l_orderkey;l_partkey", "l_orderkey;l_partkey;l_suppkey;l_linenumber",
        "l_partkey;l_suppkey", "l_suppkey;l_shipdate", "l_returnflag;l_linestatus", "l_partkey;l_quantity;l_discount",
        "l_orderkey;l_suppkey;l_extendedprice", "l_shipdate",
    ]
    counted = " union all ".join(unique_sql("lineitem", s) for s in sets)
    return f"select {columns} from ({counted})"


BRAND_RANGES = """
  select p.*, coalesce(b.n, 0) + 1 as part_no
  from part p asof left join ({sizes}) b on b.p_brand = p.p_brand and b.p_size <= p.p_size""".format(sizes=SIZES)

BRAND_LABELS = """
  with b as (select p_brand, p_size, n, is_discrete from ({discrete})),
  r as (
    select p_brand, n as part_no, lag(p_size) over w as lo, p_size as hi, is_discrete
    from b window w as (partition by p_brand order by n)
    union all select p_brand, max(n) + 1, max(p_size), null, false from b group by p_brand
  )
  select p_brand, part_no, case when is_discrete then 'p_size=' || lo
    else coalesce(lo || ' <= ', '') || 'p_size' || coalesce(' < ' || hi, '') end as label
  from r""".format(discrete=DISCRETE)

SQL = {
    "like_any": """
  select page_id from pages
  where regexp_matches(url, '/1[0-4].page|licen[sc]e', 'is')
     or regexp_matches(html, '/1[0-4].page|licen[sc]e', 'is')""",
    "like_any_literal": """
  select page_id, url from pages where contains(url, 'example.com/')""",
    "grep_lines": f"""
  select doc_id, line, line_text from ({LINES})
  where regexp_matches(line_text, 'licen[sc]e', 'i')""",
    "line_counts": """
  select doc_id, length(text) - length(replace(text, chr(10), '')) as line_breaks
  from documents""",
    "search_union": f"""
  select 'documents' as src, doc_id as parent_id, line as item_no, line_text as snippet
  from ({LINES}) where regexp_matches(line_text, 'licen[sc]e|version', 'i')
  union all
  select 'pages', page_id, null, url from pages
  where regexp_matches(url, 'licen[sc]e|version|/1', 'i')
  union all
  select 'benchmark', item_id, null, text from benchmark where regexp_matches(text, 'tion', 'i')
  union all
  select 'conversations', conv_id, turn, text from conversations
  where regexp_matches(text, 'the', 'i')""",
    "add_containers": """
  with h as (select conv_id, turn from conversations where regexp_matches(text, 'tion', 'i'))
  select 'turn' as kind, conv_id, turn from h
  union all
  select distinct 'conversation', conv_id, null from h""",
    "search_outline": f"""
  with h as (
    select source, doc_id, line, line_text from ({LINES})
    where regexp_matches(line_text, 'licen[sc]e', 'i')
  ), o as (
    select source, doc_id, row_number() over (partition by source order by doc_id) as item_no
    from (select distinct source, doc_id from h)
  ), r as (
    select source, 0 as item_no, 0 as detail_no, 0 as n_details, null as doc_id, null as line,
           null as line_text
    from (select distinct source from h)
    union all
    select source, item_no, 0, 0, doc_id, null, null from o
    union all
    select h.source, o.item_no, row_number() over (partition by h.doc_id order by line),
           count(*) over (partition by h.doc_id), h.doc_id, line, line_text
    from h join o using (source, doc_id)
  )
  select r.source, item_no, detail_no,
         case when detail_no = 0 then coalesce(r.source || '.' || doc_id, '')
              when detail_no = 1 and n_details > 1 then '/'
              when detail_no = n_details then '\\' else '|' end as mark,
         case when item_no > 0 and detail_no = 0
              then format('{{:,}}', length(d.text) - length(replace(d.text, chr(10), '')))
                   || ' lines'
              else '' end as size_label,
         line, line_text
  from r left join documents d using (doc_id)""",
    "search_report": f"""
  with h as (
    select 'documents' as src, 'texts by line' as about, doc_id as parent_id, line as item_no, line_text as snippet,
           source as origin, length(text) - length(replace(text, chr(10), '')) as lines, null as turns
    from ({LINES.replace("select doc_id,", "select doc_id, text,")}) where regexp_matches(line_text, 'licen[sc]e', 'i')
    union all
    select 'pages', 'web pages', page_id, null, url, null, null, null from pages
    where regexp_matches(url, '/1[0-4].page|licen[sc]e', 'is') or regexp_matches(html, '/1[0-4].page|licen[sc]e', 'is')
    union all
    select 'conversations', 'dialogues', conv_id, turn, text, null, null, n
    from (select *, count(*) over (partition by conv_id) as n from conversations)
    where regexp_matches(text, 'tion', 'i')
  ), r as (
    select 1 as level, src, null as parent_id, null as item_no, count(*) as n_hits, false as is_hit,
           null as text, '' as size_label, any_value(about) as about, null as origin from h group by src
    union all
    select 2, src, parent_id, null, count(*), bool_or(item_no is null), min(snippet) filter (item_no is null),
           coalesce(format('{{:,}}', any_value(lines)) || ' lines', format('{{:,}}', any_value(turns)) || ' rows', ''),
           null, any_value(origin) from h group by src, parent_id
    union all
    select 3, src, parent_id, item_no, count(*), true, min(snippet), '', null, null
    from h where item_no is not null group by src, parent_id, item_no
  ), o as (
    select *, row_number() over (partition by level, case when level > 1 then src end, case when level > 2 then parent_id end
                                 order by src, parent_id, item_no) as ordinal,
           count(*) over (partition by level, case when level > 1 then src end, case when level > 2 then parent_id end) as siblings
    from r
  )
  select level, src, parent_id, item_no, n_hits, is_hit, ordinal, siblings, size_label, text, about, origin,
         case when level = 1 then '' when level = 2 then src || '.' || parent_id
              when ordinal = siblings then '\\' when ordinal = 1 then '/' else '|' end as mark
  from o""",
    "text_preview": f"""
  with l as ({LINES}),
  f as (
    select doc_id, min(line) filter (trim(line_text) <> '') as first_line,
           max(line) filter (trim(line_text) <> '') as last_text, max(line) as n
    from l group by doc_id
  )
  select l.doc_id, l.line, l.line_text, f.last_text > 5 as truncated
  from l join f using (doc_id)
  where l.line between f.first_line and 5 and not (l.line = f.n and l.line_text = '')""",
    "header_sections": r"""
  with t as (
    select p_partkey, 'NAME:   ' || p_name || chr(10) || '        ' || p_brand || chr(10)
           || chr(10) || 'TYPE:   ' || p_type || chr(10) || chr(10) as txt
    from part
  )
  select p_partkey,
         regexp_replace(trim(regexp_extract(txt, 'NAME:((?s).*?)\n\n', 1)), '\s+', ' ', 'g')
           as name_text,
         regexp_replace(trim(regexp_extract(txt, 'TYPE:((?s).*?)\n\n', 1)), '\s+', ' ', 'g')
           as type_text
  from t""",
    "resolve_aliases": """
  select doc_id, min(doc_id) over (partition by text) as root_id,
         row_number() over (partition by text order by doc_id) - 1 as hops, false as cyclic
  from documents""",
    "alias_hops": """
  with o as (
    select o_custkey, o_orderkey, row_number() over w - 1 as hop,
           first_value(o_orderkey) over w as newest
    from orders window w as (partition by o_custkey order by o_orderdate desc, o_orderkey desc)
  )
  select newest as o_orderkey, hop, o_orderkey as via, false as cyclic from o where hop > 0""",
    "column_profile": " union all ".join(
        [
            column_sql(1, "o_orderkey", "bigint", "8"),
            column_sql(2, "o_custkey", "bigint", "8"),
            column_sql(3, "o_orderstatus", "string", "max(strlen(o_orderstatus))"),
            column_sql(4, "o_totalprice", "double", "8"),
            column_sql(5, "o_orderdate", "timestamp_ntz", "8"),
            column_sql(6, "o_orderpriority", "string", "max(strlen(o_orderpriority))"),
        ]
    ),
    "table_summary": "with s as ("
    + " union all ".join(
        [
            summary_sql(
                "orders",
                "orders",
                "year(o_orderdate)",
                "32",
                "strlen(o_orderstatus) + strlen(o_orderpriority)",
            ),
            summary_sql(
                "events", "events", "cast(ts as date)", "32", "strlen(event_type) + strlen(props)"
            ),
            summary_sql(
                "lineitem", "lineitem", "1", "68", "strlen(l_returnflag) + strlen(l_linestatus)"
            ),
        ]
    )
    + """)
  select *, case when n_rows = 0 then '(empty)'
                 else format('{:,}', n_rows) || ' rows'
                      || case when n_parts > 1 then ' in ' || n_parts || ' partitions' else '' end
            end as label
  from s""",
    "sequence_profile": sequence_sql("lineitem", "l_orderkey")
    + " union all "
    + sequence_sql("orders", "o_orderkey"),
    "filtered_counts": """
  select count(*) filter (l_returnflag = 'R') as f_returned,
         count(*) filter (l_discount > 0.05 and l_quantity < 24) as f_disc, count(*) as n_rows
  from lineitem""",
    "presence_flags": """
  select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as has_orders,
         exists (select 1 from events where user_id = c_custkey) as has_events
  from customer""",
    "first_match": """
  select o_orderkey, l_linenumber, l_partkey, l_suppkey
  from orders left join (
    select * from lineitem
    qualify row_number() over (
      partition by l_orderkey
      order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1
  ) l on l_orderkey = o_orderkey""",
    "latest_match": """
  with t as (select user_id, ts, max(event_id) filter (event_type = 'error') as last_error from events group by 1, 2),
  s as (
    select user_id, ts, last_value(last_error ignore nulls) over (
      partition by user_id order by ts rows between unbounded preceding and 1 preceding) as error_id
    from t
  )
  select a.event_id, b.event_id as error_event_id, b.ts as error_ts, b.value as error_value
  from events a join s using (user_id, ts) left join events b on b.event_id = s.error_id""",
    "latest_match_after": """
  with t as (
    select o_custkey, o_orderdate, min(o_orderkey) filter (o_orderstatus = 'F') as first_key from orders group by 1, 2
  ), s as (
    select o_custkey, o_orderdate, first_value(first_key ignore nulls) over (
      partition by o_custkey order by o_orderdate rows between current row and unbounded following) as next_key
    from t
  )
  select a.o_orderkey, b.o_orderkey as next_o_orderkey, b.o_totalprice as next_o_totalprice
  from orders a join s using (o_custkey, o_orderdate) left join orders b on b.o_orderkey = s.next_key""",
    "unique_sets_many": key_sets_sql("*"),
    "unique_sets_sketched": key_sets_sql("cols, n_rows, is_unique"),
    "unique_sets": " union all ".join(
        [
            unique_sql("lineitem", "l_orderkey;l_linenumber"),
            unique_sql("lineitem", "l_partkey;l_suppkey"),
            unique_sql("conversations", "conv_id;turn"),
            unique_sql("conversations", "conv_id"),
        ]
    ),
    "fk_check": """
  select *, n_orphan = 0 as is_trusted from (
    select 'documents.doc_id->labels.doc_id' as fk,
           count(*) filter (d.doc_id is null) as n_null,
           count(*) filter (d.doc_id is not null and l.doc_id is null) as n_orphan,
           count(l.doc_id) as n_matched
    from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id
    union all
    select 'lineitem.l_partkey->part.p_partkey', count(*) filter (l_partkey is null),
           count(*) filter (l_partkey is not null and p_partkey is null), count(p_partkey)
    from lineitem left join (select distinct p_partkey from part)
      on l_partkey = p_partkey
  )""",
    "fk_check_composite": """
  select *, n_orphan = 0 as is_trusted from (
    select 'turn->turn' as fk, count(*) filter (c.turn = 0) as n_null,
           count(*) filter (c.turn > 0 and p.turn is null) as n_orphan,
           count(p.turn) as n_matched
    from conversations c left join (select distinct conv_id, turn from conversations) p
      on p.conv_id = c.conv_id and p.turn = c.turn - 1
  )""",
    "relationship_cardinality": """
  with e(child, parent, k) as (
    select 'orders', 'customer', o_custkey from orders
    union all select 'labels', 'documents', doc_id from labels
    union all
    select 'lineitem', 'part', case when l_discount < 0.01 then null else l_partkey end
    from lineitem
  ), g as (select child, parent, k, count(*) c from e group by all),
  s as (
    select child, parent, max(c) = 1 as is_unique, bool_or(k is null) as is_nullable
    from g group by all
  )
  select child, parent, is_unique, is_nullable,
         (case when is_nullable then chr(176) else chr(185) end)
         || (case when is_unique then '' else chr(8734) end) || chr(8722) || chr(185) as label
  from s""",
    "build_edges": EDGES,
    "edge_ordinals": f"""
  with e as (select src, dst from ({EDGES}))
  select src, dst, row_number() over (partition by dst order by src) as parent_row,
         count(*) over (partition by dst) as parent_count,
         row_number() over (partition by src order by dst) as child_row,
         count(*) over (partition by src) as child_count
  from e""",
    "two_hop_in": two_hop_sql("in", "node[1] in ('R', 'N', 'C', 'P')"),
    "two_hop_out": two_hop_sql("out", "node[1] in ('O', 'C', 'S', 'N', 'L')"),
    "two_hop_focus": two_hop_sql("in", "node[1] = 'N'"),
    "two_hop_stored": two_hop_sql("in", "node[1] = 'C'", ", 'in' as way")
    + " union all "
    + two_hop_sql("out", "node[1] = 'C'", ", 'out' as way"),
    "graph_layout_cardinality": f"""
  with k(child, parent, key) as (
    select 'O', 'C', o_custkey from orders union all select 'C', 'N', c_nationkey from customer
    union all select 'S', 'N', s_nationkey from supplier union all select 'N', 'R', n_regionkey from nation
    union all select 'L', 'P', l_partkey from lineitem
  ), g as (select child, parent, key, count(*) as c from k group by all),
  signs as (
    select child, parent, (case when bool_or(key is null) then chr(176) else chr(185) end)
           || (case when max(c) = 1 then '' else chr(8734) end) || chr(8722) || chr(185) as sign
    from g group by all
  ), e as materialized (
    select src, dst, sign as rel from ({EDGES}) join signs on child = src[1] and parent = dst[1]
  ), {LAID}
  select * from laid where focus[1] in ('C', 'R')""",
    "graph_layout_stored": f"""
  with e as materialized (select src, dst, null as rel from ({EDGES})), {LAID}
  select * exclude (in2_rel, in1_rel, out1_rel, out2_rel) from laid where focus[1] in ('C', 'N')""",
    "graph_layout": f"""
  with e as materialized (select src, dst, null as rel from ({EDGES})), {LAID}
  select * exclude (in2_rel, in1_rel, out1_rel, out2_rel) from laid""",
    "graph_layout_labels": f"""
  with e as materialized (select src, dst, case when flag then '*' else '' end as rel from ({EDGES})), {LAID},
  l as (
    select 'P' || l_partkey as node, ' (' || count(*) || ')' as t from lineitem group by l_partkey
    union all
    select 'C' || o_custkey, ' (' || count(*) || ')' from orders group by o_custkey
  )
  select laid.* replace (
    in2 || coalesce(a.t, '') as in2, in1 || coalesce(b.t, '') as in1,
    laid.node || coalesce(c.t, '') as node,
    out1 || coalesce(d.t, '') as out1, out2 || coalesce(f.t, '') as out2)
  from laid left join l a on a.node = in2 left join l b on b.node = in1
  left join l c on c.node = laid.node left join l d on d.node = out1 left join l f on f.node = out2""",
    "range_partition": f"""
  select o_orderkey, 1 + (select count(*) from {YEAR_BOUNDS} where v <= o_orderdate) as part_no
  from orders""",
    "range_partition_many": """
  select o_orderkey,
         1 + greatest(0, least(499, ceil(o_totalprice / 1000)::bigint - 1)) as part_no
  from orders""",
    "range_partition_table": f"""
  select p_partkey, p.p_brand, p.part_no, label
  from ({BRAND_RANGES}) p left join ({BRAND_LABELS}) l on l.p_brand = p.p_brand and l.part_no = p.part_no""",
    "range_partition_prices": """
  select o_orderkey, 1 + count(*) filter (o_orderstatus = 'P') over (
    partition by o_orderpriority order by o_totalprice range between unbounded preceding and current row exclude group) as part_no
  from orders""",
    "storage_by_key": f"""
  select l.p_brand, l.part_no, label, count(p_partkey) as n_rows,
         coalesce(sum(case when p_partkey is not null
           then 20 + strlen(p_name) + strlen(p.p_brand) + strlen(p_type) end), 0)::bigint as bytes
  from ({BRAND_LABELS}) l left join ({BRAND_RANGES}) p on l.p_brand = p.p_brand and l.part_no = p.part_no
  group by 1, 2, 3""",
    "block_storage": f"""
  select part_no, count(*) as n_rows, 1::bigint as n_files,
         round(100.0 * count(*) / (select count(*) from orders), 6) as stored_pct
  from (select 1 + (select count(*) from {YEAR_BOUNDS} where v <= o_orderdate) as part_no from orders)
  group by rollup (part_no)""",
    "discrete_boundaries": DISCRETE,
    "partition_labels": f"""
  with b as (
    select p_brand as key, n, p_size::varchar as v, is_discrete from ({DISCRETE})
  ), p as (
    select key, n as part_no, v as hi, lag(v) over w as lo, is_discrete
    from b window w as (partition by key order by n)
    union all
    select key, max(n) + 1, null, max_by(v, n), false from b group by key
  ), f as (
    select key, y, strftime(d, '%Y-%m-%d') as v,
           row_number() over (partition by key order by d) as n
    from (
      select o_orderpriority as key, year(o_orderdate) as y,
             date_trunc('day', min(o_orderdate)) as d
      from orders group by all)
  ), q as (
    select key, n as part_no, v as hi, lag(v) over (partition by key order by n) as lo from f
    union all
    select key, max(n) + 1, null, max_by(v, n) from f group by key
  )
  select key, part_no,
         case when is_discrete then 'size=' || lo
              else coalesce(lo || ' <= ', '') || 'size' || coalesce(' < ' || hi, '') end as label
  from p
  union all
  select key, part_no, coalesce(lo || ' < ', '') || 'd' || coalesce(' <= ' || hi, '') from q""",
    "partition_storage": f"""
  with p as (
    select 1 + (select count(*) from {YEAR_BOUNDS} where v <= o_orderdate) as part_no,
           8 + 8 + 8 + 8 + strlen(o_orderstatus) + strlen(o_orderpriority) as b
    from orders
  )
  select part_no, count(*) as n_rows, sum(b)::bigint as bytes,
         round(sum(b) / count(*), 6) as avg_bytes,
         round(100.0 * sum(b) / sum(sum(b)) over (), 6) as pct
  from p group by part_no""",
    "storage_report": """
  with b(n, v) as (
    values (1, timestamp '1980-01-01'), (2, timestamp '1996-01-01'), (3, timestamp '1997-01-01'),
           (4, timestamp '1999-01-01'), (5, timestamp '2001-01-01'), (6, timestamp '2090-01-01')
  ), r as (
    select k as part_no, lo.v as lo, hi.v as hi
    from range(1, 8) t(k) left join b lo on lo.n = k - 1 left join b hi on hi.n = k
  ), s as (
    select part_no, lo, hi, count(o_orderkey) as n_rows,
           coalesce(sum(32 + strlen(o_orderstatus) + strlen(o_orderpriority)), 0)::bigint as bytes
    from r left join orders
      on (lo is null or o_orderdate >= lo) and (hi is null or o_orderdate < hi)
    group by all
  )
  select part_no,
         coalesce(strftime(lo, '%Y-%m-%d') || ' <= ', '') || 'o_orderdate'
           || coalesce(' < ' || strftime(hi, '%Y-%m-%d'), '') as label,
         n_rows, bytes, round(bytes / nullif(n_rows, 0), 6) as avg_bytes,
         round(100.0 * bytes / sum(bytes) over (), 6) as pct
  from s""",
    "state_pivot": """
  select year(o_orderdate) as y,
         count(*) filter (o_orderstatus = 'O') as n_open,
         count(*) filter (o_orderstatus = 'F') as n_closed,
         count(*) filter (o_orderstatus = 'P') as n_pending,
         sum(o_totalprice::decimal(18,2)) filter (o_orderstatus = 'O')::double as amt_open,
         sum(o_totalprice::decimal(18,2)) filter (o_orderstatus = 'F')::double as amt_closed,
         sum(o_totalprice::decimal(18,2)) filter (o_orderstatus = 'P')::double as amt_pending
  from orders group by 1""",
    "runs": RUNS,
    "run_lists": f"""
  select user_id, event_type, piece,
         string_agg(case when len = key_len then 'ALL'
                         when first_n = last_n then first_n::varchar
                         else first_n || ' TO ' || last_n end, ', ' order by run_no) as runs
  from (
    select *, (row_number() over (
      partition by user_id, event_type order by run_no) - 1) // 10000 as piece
    from ({RUNS}) where event_type <> 'view'
  )
  group by 1, 2, 3""",
    "ordered_list": """
  select l_orderkey, piece,
         string_agg(l_partkey || case when l_returnflag = 'R' then ' DESC' else '' end, ', '
                    order by n) as parts
  from (select *, (n - 1) // 10000 as piece from (
    select *, row_number() over (
      partition by l_orderkey
      order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n
    from lineitem))
  group by 1, 2""",
    "collapse_list": """
  select user_id, cast(ts as date) as d, 0::bigint as piece,
         case when count(distinct event_type) = (select count(distinct event_type) from events)
              then 'ALL' else string_agg(distinct event_type, ', ' order by event_type) end
           as types
  from events group by 1, 2""",
    "scoped_rules": """
  with r(scope, key, rule) as (
    values ('db', null, 'base'), ('region', 1, 'r1'), ('region', 2, 'r2'), ('nation', 3, 'n3'),
           ('nation', 8, 'n8'), ('customer', 42, 'c42')
  ), m as (
    select c_custkey, scope, rule from customer, r where scope = 'db'
    union all
    select c_custkey, scope, rule from customer
    join nation on c_nationkey = n_nationkey join r on scope = 'region' and key = n_regionkey
    union all
    select c_custkey, scope, rule from customer
    join r on scope = 'nation' and key = c_nationkey
    union all
    select c_custkey, scope, rule from customer
    join r on scope = 'customer' and key = c_custkey
  )
  select c_custkey, scope, 0::bigint as piece, string_agg(rule, ', ' order by rule) as rules
  from m group by 1, 2""",
    "scoped_rules_by_state": """
  with words(state, word, option) as (
    values ('D', 'DENY', ''), ('G', 'GRANT', ''), ('W', 'GRANT', 'WITH GRANT OPTION')
  ), r as (
    select distinct * from (
      select 'customer' as scope, o_custkey as key, o_orderpriority as rule, translate(o_orderstatus, 'FOP', 'DGW') as state
      from orders
      union all
      select case when s_suppkey % 2 = 0 then 'nation' else 'region' end,
             case when s_suppkey % 2 = 0 then n_nationkey else n_regionkey end, 'S' || s_suppkey % 7,
             case when s_acctbal < 0 then 'D' when s_acctbal < 5000 then 'G' else 'W' end
      from supplier join nation on s_nationkey = n_nationkey
      union all select 'db', null, r_name, 'G' from region
    )
  ), places as (
    select c_custkey, 'db' as scope, null as key from customer
    union all select c_custkey, 'customer', c_custkey from customer
    union all select c_custkey, 'nation', c_nationkey from customer
    union all select c_custkey, 'region', n_regionkey from customer join nation on c_nationkey = n_nationkey
  )
  select c_custkey, p.scope, word, option, 0::bigint as piece, string_agg(rule, ', ' order by rule) as rules
  from places p join r on r.scope = p.scope and r.key is not distinct from p.key join words using (state)
  group by 1, 2, 3, 4""",
    "name_audit": """
  with n as (
    select distinct p_name as name from part
    union select distinct c_mktsegment from customer
    union select o_orderpriority from orders
    union select r_name from region
    union select event_type from events
  ), a as (
    select name, regexp_matches(name, '^[0-9]') or regexp_matches(name, '[^0-9A-Za-z_@]')
           or upper(name) in ('VIEW', 'ERROR', 'ORDER', 'MACHINERY', 'ASIA') as needs_quotes
    from n
  )
  select name, case when needs_quotes then '[' || replace(name, ']', ']]') || ']' else name end
           as quoted, needs_quotes
  from a""",
}

# The divided plans answer the same questions.
SQL |= {
    "runs_divided": SQL["runs"],
    "ordered_list_divided": SQL["ordered_list"],
    "two_hop_divided": SQL["two_hop_in"],
    "latest_match_divided": SQL["latest_match"],
    "range_partition_divided": SQL["range_partition_prices"],
}
