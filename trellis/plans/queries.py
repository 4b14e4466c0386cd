"""Registered graph queries over the star-schema tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphError
from ..graph import Graph
from ..limits import Limits
from ..operators import Changes, Snapshot, Transaction, Walk, apply_changes, expanded_edges, find_equal, find_nodes, get_edge, get_node, inspect, inspect_edges, inspect_nodes, maybe, objects, one, paths, reach, run_program, verify, walk
from ..scratch import new_path
from ..sources import drop_old, generations, load, save, star_graph, summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str, f: Callable[[Graph], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(star_graph(spark, sf_dir))
    ORACLE_SQL[name] = sql


#: All edges in SQL, as star_graph makes them.
EDGES = """
edges as (
  select 'nation:' || n_nationkey as a, 'IN_REGION' as t, 'region:' || n_regionkey as b from nation
  union all select 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey from customer
  union all select 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey from supplier
  union all select 'customer:' || o_custkey, 'PLACED', 'order:' || o_orderkey from orders
  union all select distinct 'order:' || l_orderkey, 'CONTAINS', 'part:' || l_partkey from lineitem
  union all select distinct 'part:' || l_partkey, 'SUPPLIED_BY', 'supplier:' || l_suppkey from lineitem
  union all select 'customer:' || user_id, 'DID', 'event:' || event_id from events
  union all select 'turn:' || x.conv_id || ':' || x.turn, 'NEXT', 'turn:' || y.conv_id || ':' || y.turn
    from conversations x join conversations y on x.conv_id = y.conv_id and y.turn = x.turn + 1),
keyed as (select *, strlen(a) || ':' || a || strlen(t) || ':' || t || strlen(b) || ':' || b as key from edges)"""
#: All nodes in SQL.
NODES = """
nodes as (
  select 'region:' || r_regionkey as id, 'Region' as label from region
  union all select 'nation:' || n_nationkey, 'Nation' from nation
  union all select 'customer:' || c_custkey, 'Customer' from customer
  union all select 'supplier:' || s_suppkey, 'Supplier' from supplier
  union all select 'part:' || p_partkey, 'Part' from part
  union all select 'order:' || o_orderkey, 'Order' from orders
  union all select 'event:' || event_id, 'Event' from events
  union all select 'doc:' || doc_id, 'Document' from documents
  union all select 'turn:' || conv_id || ':' || turn, 'Turn' from conversations)"""


def _walk_sql(start: str, depth: int, over: str | None = None, direction: str = "out", limit: int = 100, edges: str = EDGES, nodes: str = NODES) -> str:
    """Common table expressions that end in found (id, depth, keys, rank)."""
    src, dst = ("a", "b") if direction == "out" else ("b", "a")
    kind = f"and e.t = '{over}'" if over else ""
    return f"""with recursive {edges}, {nodes},
steps(id, depth, keys) as (
  select '{start}', 0, cast([] as varchar[])
  union all
  select e.{dst}, s.depth + 1, list_append(s.keys, e.key) from steps s join keyed e on e.{src} = s.id {kind} where s.depth < {depth}),
first as (select id, arg_min(keys, (depth, keys)) as keys, min(depth) as depth from steps group by id),
ranked as (
  select id, depth, keys, row_number() over (order by depth, keys) as rank from first
  where id <> '{start}' and id in (select id from nodes)),
found as (select * from ranked where rank <= {limit})"""


_WALKED = "select cast(rank as bigint) as rank, f.id as id, n.label as label, cast(depth as bigint) as depth from found f join nodes n on n.id = f.id"

_query("get_node", "select 'customer:1' as id, 'Customer' as label, cast(1 as bigint) as version from customer where c_custkey = 1", lambda g: get_node(g, "customer:1", "Customer"))
_query(
    "get_edge",
    "select 'IN_REGION' as type, 'nation:' || n_nationkey as \"from\", 'region:' || n_regionkey as \"to\", cast(1 as bigint) as version from nation where n_nationkey = 3",
    lambda g: get_edge(g, "IN_REGION", "nation:3", g.edges["IN_REGION"].where("`from` = 'nation:3'").first()["to"]),
)
_query("find_label", "select 'nation:' || n_nationkey as id, n_name as name from nation order by id limit 100", lambda g: find_nodes(g, "Nation", fields=["id", "name"]))
_query("find_label_limit", "select 'part:' || p_partkey as id, p_brand as brand from part order by id limit 17", lambda g: find_nodes(g, "Part", limit=17, fields=["id", "brand"]))
for _name, _op, _sql in (("eq", "=", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">=")):
    _query(
        f"find_{_name}",
        f"select 'part:' || p_partkey as id, cast(p_size as bigint) as size, p_retailprice as retailprice from part where p_size {_sql} 25",
        lambda g, op=_op: find_nodes(g, "Part", ("size", op, 25), None, ["id", "size", "retailprice"]),
    )
_query(
    "find_double_gt_int",
    "select 'customer:' || c_custkey as id, c_acctbal as acctbal from customer where c_acctbal > 5000.0",
    lambda g: find_nodes(g, "Customer", ("acctbal", ">", 5000), None, ["id", "acctbal"]),
)
_query(
    "find_int_le_double",
    "select 'part:' || p_partkey as id from part where p_size <= 10",
    lambda g: find_nodes(g, "Part", ("size", "<=", 10.5), None, ["id"]),
)
_query(
    "find_string",
    "select 'customer:' || c_custkey as id, c_mktsegment as mktsegment from customer where c_mktsegment = 'BUILDING' order by id limit 10",
    lambda g: find_nodes(g, "Customer", ("mktsegment", "=", "BUILDING"), 10, ["id", "mktsegment"]),
)
_query("find_string_ge", "select 'part:' || p_partkey as id from part where p_brand >= 'Brand#3'", lambda g: find_nodes(g, "Part", ("brand", ">=", "Brand#3"), None, ["id"]))
_query(
    "find_missing_ne",
    "select 'doc:' || d.doc_id as id, cast(quality as bigint) as quality from documents d left join labels l on d.doc_id = l.doc_id where quality is null or quality <> 1",
    lambda g: find_nodes(g, "Document", ("quality", "!=", 1), None, ["id", "quality"]),
)
_query(
    "find_missing_eq",
    "select 'doc:' || d.doc_id as id, cast(quality as bigint) as quality from documents d join labels l on d.doc_id = l.doc_id where quality = 1",
    lambda g: find_nodes(g, "Document", ("quality", "=", 1), None, ["id", "quality"]),
)
_query("find_null", "select 'doc:' || doc_id as id from documents where false", lambda g: find_nodes(g, "Document", ("quality", "=", None), None, ["id"]))
_query("find_mixed_type", "select 'part:' || p_partkey as id from part", lambda g: find_nodes(g, "Part", ("size", "!=", "25"), None, ["id"]))
_query(
    "find_indexed",
    "select 'order:' || o_orderkey as id, o_totalprice as totalprice from orders where o_orderstatus = 'F' order by id limit 50",
    lambda g: find_nodes(g.with_index("Order", "status"), "Order", ("status", "=", "F"), 50, ["id", "totalprice"]),
)
_query(
    "project_reserved",
    "select 'nation:' || n_nationkey as id, 'Nation' as label, 'Nation' as type, 'node' as kind, '' as \"from\", '' as \"to\", cast(1 as bigint) as version, n_name as name, cast(null as varchar) as nothing from nation",
    lambda g: find_nodes(g, "Nation", limit=None, fields=["id", "label", "type", "kind", "from", "to", "version", "name", "nothing"]),
)
for _name, _start, _depth, _over, _way, _limit in (
    ("walk_out_d1", "customer:1", 1, None, "out", 100), ("walk_out_d2", "customer:1", 2, None, "out", 100), ("walk_out_d3", "customer:1", 3, None, "out", 1000), ("walk_in_d2", "region:1", 2, None, "in", 1000),
    ("walk_one_type", "customer:1", 2, "PLACED", "out", 100), ("walk_next", "turn:1:0", 5, "NEXT", "out", 100), ("walk_limit_prefix", "nation:3", 2, None, "in", 40), ("walk_unknown", "nobody", 2, None, "out", 10),
):
    _query(_name, f"{_walk_sql(_start, _depth, _over, _way, _limit)} {_WALKED}", lambda g, a=(_start, _over, _way, _depth, _limit): walk(g, *a))
for _name, _start, _depth, _way, _limit in (("paths_out_d2", "customer:1", 2, "out", 100), ("paths_in_d2", "region:1", 2, "in", 200)):
    _query(
        _name,
        f"""{_walk_sql(_start, _depth, None, _way, _limit)},
hops as (select rank, id, unnest(keys) as key, generate_subscripts(keys, 1) as hop from found)
select cast(rank as bigint) as rank, id, cast(hop as bigint) as hop, t as type, a as "from", b as "to", {"b" if _way == "out" else "a"} as node, cast(1 as bigint) as version from hops join keyed using (key)""",
        lambda g, a=(_start, None, _way, _depth, _limit): paths(g, *a),
    )
_query(
    "reach_all_customers",
    """select 'customer:' || o_custkey as start, count(distinct o_orderkey) as orders, cast(count(distinct l_partkey) as bigint) as parts
from orders left join lineitem on l_orderkey = o_orderkey group by o_custkey having count(l_partkey) > 0""",
    lambda g: reach(g.only(("Customer", "Order", "Part"), ("PLACED", "CONTAINS")), g.nodes["Customer"], depth=2, ordered=False, label="Customer").groupBy("start").agg(
        F.sum((F.col("depth") == 1).cast("long")).alias("orders"), F.sum((F.col("depth") == 2).cast("long")).alias("parts")
    ).where("parts > 0"),
)
_query(
    "inspect_nodes_page",
    f"""with {NODES.strip()}, page as (select id, label from nodes where id > 'customer:99' order by id limit 100)
select id, label, cast(1 as bigint) as version, 'node' as kind, '"' || c_name || '"' as name, '"' || lang || '"' as lang
from page left join customer on id = 'customer:' || c_custkey left join documents on id = 'doc:' || doc_id""",
    lambda g: inspect_nodes(g, "customer:99").select("id", "label", "version", "kind", F.col("properties")["name"].alias("name"), F.col("properties")["lang"].alias("lang")),
)
_query(
    "inspect_edges_page",
    f"with {EDGES.strip()} select key as id, t as type, a as \"from\", b as \"to\", cast(1 as bigint) as version from keyed where key > '8:' order by key limit 50",
    lambda g: inspect_edges(g, "8:", 50).select("id", "type", "from", "to", "version"),
)


def _all_pages(g: Graph) -> DataFrame:
    """Every page of a small graph, one after another by cursors."""
    g, cursor, items = g.only(("Region", "Nation"), ("IN_REGION",)), None, []
    while True:
        page = inspect(g, "node", cursor, 7)
        items += [(len(items) // 7, r["id"]) for r in page.items.orderBy("id").collect()]
        cursor = page.cursor
        if cursor is None:
            return g.spark.createDataFrame(items, "page int, id string")


_query(
    "inspect_cursors",
    "with n as (select 'region:' || r_regionkey as id from region union all select 'nation:' || n_nationkey from nation) select cast((row_number() over (order by id) - 1) // 7 as integer) as page, id from n",
    _all_pages,
)
_query(
    "inspect_indexes",
    "select * from (values ('Order', 'status'), ('Part', 'size'), ('Part', 'brand')) t(label, property)",
    lambda g: inspect(g.with_index("Part", "size").with_index("Order", "status").with_index("Part", "brand").with_index("Part", "size"), "index").items.select("label", "property"),
)
_query(
    "node_in_full",
    """select 'node' as kind, 'part:7' as id, 'Part' as label, cast(0 as bigint) as last_modified_ms, cast(1 as bigint) as version,
  cast(6 as integer) - 1 as n, '"' || p_brand || '"' as brand, cast(p_size as varchar) as size from part where p_partkey = 7""",
    lambda g: get_node(g, "part:7", fields=None).select("kind", "id", "label", "last_modified_ms", "version", F.size("properties").alias("n"), F.col("properties")["brand"].alias("brand"), F.col("properties")["size"].alias("size")),
)
_query(
    "edges_in_full",
    """select 'edge' as kind, 'order:' || l_orderkey as "from", 'part:' || l_partkey as "to", 'CONTAINS' as type, cast(count(*) as varchar) as lines
from lineitem where l_orderkey < 200 group by l_orderkey, l_partkey""",
    lambda g: objects(g, "edge", "CONTAINS", g.edge_rows(g.links["CONTAINS"][0], g.links["CONTAINS"][0].table.where("src < 200"))).select("kind", "from", "to", "type", F.col("properties")["lines"].alias("lines")),
)
_query(
    "optional_reads",
    "select * from (values ('customer:1', true), ('customer:-1', false), ('customer:01', false), ('nobody', false)) t(id, found)",
    lambda g: g.spark.createDataFrame([(i, maybe(get_node(g, i)) is not None) for i in ("customer:1", "customer:-1", "customer:01", "nobody")], "id string, found boolean"),
)
_query(
    "find_equal",
    "select 'part:' || p_partkey as id, p_brand as brand from part where p_size = 25 order by id limit 20",
    lambda g: find_equal(g, "Part", "size", 25, 20, ["id", "brand"]).unionByName(find_equal(g, "Part", "size", 25, -3, ["id", "brand"])),
)
_query(
    "walk_fields",
    f"""{_walk_sql("customer:1", 2)}
select cast(rank as bigint) as rank, cast(depth as bigint) as depth, id, coalesce(n_name, r_name, p_name) as name, o_orderstatus as status, n.label as label, cast(null as varchar) as nothing
from found f join nodes n using (id) left join nation on id = 'nation:' || n_nationkey left join region on id = 'region:' || r_regionkey
left join part on id = 'part:' || p_partkey left join orders on id = 'order:' || o_orderkey""",
    lambda g: walk(g, "customer:1", depth=2, fields=["id", "name", "status", "label", "nothing"]),
)
_PATH = f"""{_walk_sql("customer:2", 2, None, "out", 60)},
hops as (select rank, id, unnest(keys) as key, generate_subscripts(keys, 1) as hop from found union all select rank, id, null, 0 from found),
sums as (select 'order:' || l_orderkey as a, 'part:' || l_partkey as b, count(*) as lines from lineitem group by all),
steps_ as (select h.rank, h.id, h.hop, k.t, k.a, k.b, coalesce(k.b, 'customer:2') as node from hops h left join keyed k using (key))
select cast(rank as bigint) as rank, id, cast(hop as bigint) as hop, s.t as type, node, """
_query(
    "paths_fields",
    f"""{_PATH} n.label as node_label, o_orderpriority as node_priority, lines as edge_lines, case when hop > 0 then s.t end as edge_label
from steps_ s join nodes n on n.id = s.node left join orders on node = 'order:' || o_orderkey left join sums on sums.a = s.a and sums.b = s.b and s.t = 'CONTAINS'""".replace("select cast(rank as bigint) as rank, id,", "select cast(rank as bigint) as rank, s.id,"),
    lambda g: paths(g, "customer:2", depth=2, limit=60, fields=["label", "priority", "lines"]).select(
        "rank", "id", "hop", "type", "node", F.col("at.label").alias("node_label"), F.col("at.priority").alias("node_priority"), F.col("edge.lines").alias("edge_lines"), F.col("edge.label").alias("edge_label")
    ),
)
_query(
    "paths_whole",
    f"""{_PATH} n.label as node_label, '"' || o_orderpriority || '"' as node_priority, cast(lines as varchar) as edge_lines, key as edge_id
from steps_ s join nodes n on n.id = s.node left join orders on node = 'order:' || o_orderkey left join sums on sums.a = s.a and sums.b = s.b and s.t = 'CONTAINS'
left join keyed k on k.a = s.a and k.b = s.b and k.t = s.t""".replace("select cast(rank as bigint) as rank, id,", "select cast(rank as bigint) as rank, s.id,"),
    lambda g: paths(g, "customer:2", depth=2, limit=60, whole=True).select(
        "rank", "id", "hop", "type", "node", F.col("at.label").alias("node_label"), F.col("at.properties")["priority"].alias("node_priority"), F.col("edge.properties")["lines"].alias("edge_lines"), F.col("edge.id").alias("edge_id")
    ),
)

#: A graph with a loop, cycles, parallel edges and an edge to nothing, from the nations' numbers.
RING_EDGES = """
edges as (
  select 'n' || n_nationkey as a, 'A' as t, 'n' || (n_nationkey * 7 + 3) % 25 as b from nation
  union all select 'n' || n_nationkey, 'B', 'n' || (n_nationkey * 3) % 25 from nation
  union all select 'n' || n_nationkey, 'C', 'n' || (n_nationkey * 7 + 3) % 25 from nation
  union all select 'n' || n_nationkey, 'B', 'gone' || n_nationkey from nation
  union all select 'gone' || n_nationkey, 'B', 'far' || n_nationkey from nation),
keyed as (select *, strlen(a) || ':' || a || strlen(t) || ':' || t || strlen(b) || ':' || b as key from edges)"""
RING_NODES = "nodes as (select 'n' || n_nationkey as id, 'Ring' as label from nation union all select 'far' || n_nationkey, 'Far' from nation)"


def _ring(g: Graph) -> Graph:
    k = g.keyed["Nation"].table.select("key")
    to = lambda c: F.concat(F.lit("n"), c.cast("string"))
    named = lambda p: F.concat(F.lit(p), F.col("key").cast("string"))
    a, gone = k.select(to(F.col("key")).alias("from"), to((F.col("key") * 7 + 3) % 25).alias("to")), k.select(to(F.col("key")).alias("from"), named("gone").alias("to"))
    b = k.select(to(F.col("key")).alias("from"), to(F.col("key") * 3 % 25).alias("to")).unionByName(gone).unionByName(k.select(named("gone").alias("from"), named("far").alias("to")))
    ring = Graph(g.spark).with_nodes("Ring", k.select(to(F.col("key")).alias("id"))).with_nodes("Far", k.select(named("far").alias("id")))
    return ring.with_edges("A", a).with_edges("B", b).with_edges("C", a)


for _name, _start, _depth, _way, _limit in (("ring_out", "n1", 4, "out", 1000), ("ring_in", "n0", 3, "in", 12), ("ring_beyond_missing", "gone3", 2, "out", 10)):
    _sql_of = _walk_sql(_start, _depth, None, _way, _limit, RING_EDGES, RING_NODES)
    # A missing node is no bridge: in SQL, edges at it are left out.
    _sql_of = _sql_of.replace("from steps s join keyed e", "from steps s join (select * from keyed where a in (select id from nodes) and b in (select id from nodes)) e")
    _query(_name, f"{_sql_of} {_WALKED}", lambda g, a=(_start, None, _way, _depth, _limit): walk(_ring(g), *a))
_query(
    "ring_paths",
    f"""{_walk_sql("n2", 3, None, "out", 15, RING_EDGES, RING_NODES).replace("from steps s join keyed e", "from steps s join (select * from keyed where a in (select id from nodes) and b in (select id from nodes)) e")},
hops as (select rank, id, unnest(keys) as key, generate_subscripts(keys, 1) as hop from found)
select cast(rank as bigint) as rank, id, cast(hop as bigint) as hop, t as type, a as "from", b as "to", b as node, cast(1 as bigint) as version from hops join keyed using (key)""",
    lambda g: Walk(_ring(g), "n2").into("B").out().depth(3).limit(15).paths(),
)
_query(
    "expanded_edges",
    f"""with {EDGES.strip()}, one as (select b, key from keyed where a = 'customer:1'), two as (select e.key from one join keyed e on e.a = one.b)
select 'all' as walk, (select count(*) from one) + (select count(*) from two) as n union all select 'first ten', 10 union all select 'nobody', 0""",
    lambda g: g.spark.createDataFrame(
        [("all", expanded_edges(g, "customer:1", depth=2, limit=10_000)), ("first ten", expanded_edges(g, "customer:1", depth=1, limit=10)), ("nobody", expanded_edges(g, "nobody", depth=2))], "walk string, n long"
    ),
)


def _only(g: Graph, *labels: str, kinds: tuple[str, ...]) -> Graph:
    return g.only(labels, kinds)


def _upserted(g: Graph) -> DataFrame:
    rows = g.nodes["Nation"].select("id", F.upper("name").alias("name"), F.lit("x").alias("mark")).where("id < 'nation:2'")
    rows = rows.unionByName(g.spark.createDataFrame([("nation:new", "NEW", "x")], "id string, name string, mark string"))
    return find_nodes(apply_changes(g, Changes().upsert_nodes("Nation", rows), now=7), "Nation", None, None, ["id", "version", "name", "mark"])


_query(
    "upsert_then_find",
    """select 'nation:' || n_nationkey as id, cast(case when 'nation:' || n_nationkey < 'nation:2' then 2 else 1 end as bigint) as version,
  case when 'nation:' || n_nationkey < 'nation:2' then upper(n_name) else n_name end as name, case when 'nation:' || n_nationkey < 'nation:2' then 'x' end as mark from nation
union all select 'nation:new', 1, 'NEW', 'x'""",
    _upserted,
)


def _relabelled(g: Graph) -> DataFrame:
    rows = g.nodes["Supplier"].where("acctbal > 5000").select("id", F.lit("gold").alias("tier"))
    g = apply_changes(g, Changes().upsert_nodes("Partner", rows), now=7)
    return find_nodes(g, "Partner", None, None, ["id", "version", "tier"]).unionByName(find_nodes(g, "Supplier", None, None, ["id", "version", "tier"]))


_query(
    "upsert_other_label",
    "select 'supplier:' || s_suppkey as id, cast(case when s_acctbal > 5000 then 2 else 1 end as bigint) as version, case when s_acctbal > 5000 then 'gold' end as tier from supplier",
    _relabelled,
)


def _cascaded(g: Graph) -> DataFrame:
    g = _only(g, "Region", "Nation", "Customer", "Supplier", kinds=("IN_REGION", "IN_NATION"))
    g = apply_changes(g, Changes().delete_nodes(g.nodes["Nation"].where("id >= 'nation:2'").select("id")), now=7)
    return verify(g).where("check in ('nodes', 'edges', 'dangling edges')").select("check", "name", "n")


_query(
    "delete_cascade",
    """select 'nodes' as check, 'Region' as name, count(*) as n from region
union all select 'nodes', 'Nation', count(*) from nation where 'nation:' || n_nationkey < 'nation:2'
union all select 'nodes', 'Customer', count(*) from customer
union all select 'nodes', 'Supplier', count(*) from supplier
union all select 'edges', 'IN_REGION', count(*) from nation where 'nation:' || n_nationkey < 'nation:2'
union all select 'edges', 'IN_NATION', (select count(*) from customer where 'nation:' || c_nationkey < 'nation:2') + (select count(*) from supplier where 'nation:' || s_nationkey < 'nation:2')
union all select 'dangling edges', 'IN_REGION', 0
union all select 'dangling edges', 'IN_NATION', 0""",
    _cascaded,
)
_query(
    "edges_changed",
    """select 'nation:' || n_nationkey as "from", 'region:' || n_regionkey as "to", cast(2 as bigint) as version, 5 as weight from nation where n_regionkey <> 1""",
    lambda g: (lambda e: apply_changes(g, Changes().upsert_edges("IN_REGION", e.select("from", "to", F.lit(5).alias("weight"))).delete_edges("IN_REGION", e.where("to = 'region:1'")), now=7).edges["IN_REGION"])(
        g.edges["IN_REGION"]
    ).select("from", "to", "version", "weight"),
)
_query(
    "verify_integrity",
    f"""with {EDGES.strip()}, {NODES.strip()}
select 'nodes' as check, label as name, count(*) as n from nodes group by label
union all select 'edges', t, count(*) from edges group by t
union all select 'repeated ids', '', count(*) from (select id from nodes group by id having count(*) > 1)
union all select 'repeated edges', t, cast(sum(case when n > 1 then 1 else 0 end) as bigint) from (select a, t, b, count(*) as n from edges group by all) group by t
union all select 'dangling edges', t, cast(sum(case when x.id is null or y.id is null then 1 else 0 end) as bigint) from edges left join nodes x on x.id = a left join nodes y on y.id = b group by t""",
    verify,
)


def _many_changes(g: Graph) -> DataFrame:
    """A hundred changes and more in one plan: nodes made, changed and deleted, edges made between them and lost with them."""
    g, changes = Graph(g.spark).with_nodes("Old", g.keyed["Nation"].table.select("id", "name")), Changes()
    row = lambda **r: g.spark.createDataFrame(pa.table({k: pa.array([v], pa.int32() if isinstance(v, int) else pa.string()) for k, v in r.items()}))
    for i in range(30):
        changes.upsert_nodes("New", row(id=f"x{i}", n=i))
        changes.upsert_nodes("Newer" if i % 2 else "New", row(id=f"x{i}", n=i + 1))
        changes.upsert_edges("NEXT", row(**{"from": f"x{i}", "to": f"x{max(0, i - 1)}", "w": i}))
        changes.upsert_edges("NEXT", row(**{"from": f"x{i}", "to": f"x{max(0, i - 1)}", "w": -i}))
        if i % 5 == 4:
            changes.delete_nodes(row(id=f"x{i}"))
            changes.upsert_nodes("New", row(id=f"x{i}", n=0))
    g = apply_changes(g, changes, now=9)
    nodes = [find_nodes(g, k, None, None, ["id", "label", "version", "n"]).withColumn("to", F.lit("")) for k in ("New", "Newer")]
    edges = g.edges["NEXT"].select(F.col("from").alias("id"), F.lit("NEXT").alias("label"), "version", F.col("w").alias("n"), "to")
    return nodes[0].unionByName(nodes[1]).unionByName(edges)


_query(
    "many_changes",
    """with i as (select unnest(range(30)) as i)
select 'x' || i as id, case when i % 5 = 4 or i % 2 = 0 then 'New' else 'Newer' end as label, cast(case when i % 5 = 4 then 1 else 2 end as bigint) as version,
  cast(case when i % 5 = 4 then 0 else i + 1 end as integer) as n, '' as "to" from i
union all select 'x' || i, 'NEXT', 2, cast(-i as integer), 'x' || greatest(0, i - 1) from i where i % 5 <> 4""",
    _many_changes,
)


def _staged(g: Graph) -> DataFrame:
    """A program whose reads see the changes before them, and one that fails and changes nothing."""
    g = g.only(("Region",), ())
    row = lambda i, n: g.spark.createDataFrame([(i, n)], "id string, name string")
    count = lambda what: lambda x: find_nodes(x, "Region", None, None).agg(F.count("*").alias("n")).select(F.lit(what).alias("at"), "n")
    done, reads = run_program(g, count("before"), Changes().upsert_nodes("Region", row("region:9", "NEW")), count("after one"), Changes().delete_nodes(row("region:0", "").select("id")), count("after both"), now=1)
    try:
        run_program(done, Changes().delete_nodes(row("region:9", "").select("id")), lambda x: g.spark.createDataFrame([(one(get_node(x, "region:9"))["id"],)], "id string"))
    except GraphError as e:
        reads.append(count(e.code)(done))
    with Transaction(done) as t:
        t.upsert_nodes("Region", row("region:10", "TEN"))
    with Transaction(t.graph) as empty:
        pass
    reads.append(count("transaction")(empty.graph))
    out = reads[0]
    for r in reads[1:]:
        out = out.unionByName(r)
    return out


_query("program", "with r as (select count(*) as n from region) select at_ as at, n + d as n from r, (values ('before', 0), ('after one', 1), ('after both', 0), ('notFound', 0), ('transaction', 1)) t(at_, d)".replace(" as at,", ' as "at",'), _staged)


def _errors(g: Graph) -> DataFrame:
    """The error code of each thing that isn't allowed."""
    g = g.only(("Region", "Nation"), ("IN_REGION",))
    df = lambda rows, schema: g.spark.createDataFrame(rows, schema)
    ids, ends = "id string", "from string, to string"
    closed = Snapshot(g)
    with closed:
        pass

    def conflict():
        with Snapshot(g) as s:
            s.apply_changes(Changes())

    def stale():
        inspect(apply_changes(g, Changes().create_index("Nation", "name")), "node", inspect(g, "node", None, 5).cursor)

    def budget():
        with Snapshot(g, Limits(edges=30)) as s:
            s.walk("region:1", direction="in")
            for _ in range(10):
                s.walk("region:1", direction="in")

    cases: dict[str, Callable[[], object]] = {
        "delete a node that isn't there": lambda: apply_changes(g, Changes().delete_nodes(df([("nation:99",)], ids))),
        "delete a node twice": lambda: apply_changes(g, Changes().delete_nodes(df([("nation:1",)], ids)).delete_nodes(df([("nation:1",)], ids))),
        "delete an edge that isn't there": lambda: apply_changes(g, Changes().delete_edges("IN_REGION", df([("nation:1", "region:99")], ends))),
        "an edge to nothing": lambda: apply_changes(g, Changes().upsert_edges("IN_REGION", df([("nation:1", "region:99")], ends))),
        "an edge to a deleted node": lambda: apply_changes(g, Changes().delete_nodes(df([("region:1",)], ids)).upsert_edges("IN_REGION", df([("nation:1", "region:1")], ends))),
        "a null id": lambda: apply_changes(g, Changes().upsert_nodes("Nation", df([(None,)], ids))),
        "one id twice": lambda: apply_changes(g, Changes().upsert_nodes("Nation", df([("a",), ("a",)], ids))),
        "a nested property": lambda: Changes().upsert_nodes("Nation", df([("a", [1])], "id string, x array<int>")),
        "an index on no identifier": lambda: Changes().create_index("Nation", "a b"),
        "no changes": lambda: apply_changes(g, Changes()),
        "a missing node": lambda: one(get_node(g, "nation:99")),
        "too deep": lambda: Walk(g, "nation:1").depth(17).collect(),
        "too many results": lambda: find_nodes(g, "Nation", limit=10_001, limits=Limits()),
        "too many edges": lambda: walk(g, "region:1", direction="in", limits=Limits(edges=1)),
        "a cumulative budget": budget,
        "a garbled cursor": lambda: inspect(g, "node", "x"),
        "a cursor of another kind": lambda: inspect(g, "edge", inspect(g, "node", None, 5).cursor),
        "a cursor after a change": stale,
        "a change in a snapshot": conflict,
        "a closed snapshot": lambda: closed.walk("nation:1"),
        "an unknown generation": lambda: load(g.spark, new_path(g.spark, "nothing")),
    }
    rows = []
    for name, do in cases.items():
        try:
            do()
            rows.append((name, "ok"))
        except GraphError as e:
            rows.append((name, e.code))
    return df(rows, "case string, code string")


_query(
    "errors",
    """select * from (values ('delete a node that isn''t there', 'notFound'), ('delete a node twice', 'notFound'), ('delete an edge that isn''t there', 'notFound'), ('an edge to nothing', 'notFound'),
  ('an edge to a deleted node', 'notFound'), ('a null id', 'invalidArgument'), ('one id twice', 'invalidArgument'), ('a nested property', 'invalidArgument'), ('an index on no identifier', 'invalidArgument'),
  ('no changes', 'invalidArgument'), ('a missing node', 'notFound'), ('too deep', 'limitExceeded'), ('too many results', 'limitExceeded'), ('too many edges', 'limitExceeded'),
  ('a cumulative budget', 'limitExceeded'), ('a garbled cursor', 'invalidArgument'), ('a cursor of another kind', 'invalidArgument'), ('a cursor after a change', 'conflict'),
  ('a change in a snapshot', 'conflict'), ('a closed snapshot', 'closed'), ('an unknown generation', 'corruptData')) t("case", code)""",
    _errors,
)


def _generations(g: Graph) -> DataFrame:
    """Saves, changes and saves again, copies elsewhere, loads the old and the new, and drops the old."""
    g = g.only(("Region", "Nation", "Customer"), ("IN_REGION",)).with_index("Customer", "mktsegment")
    spark, path = g.spark, new_path(g.spark, "graph")
    copy = f"{path}/copy"
    save(g, f"{path}/main")
    back = load(spark, f"{path}/main")
    save(apply_changes(back, Changes().delete_nodes(spark.createDataFrame([("region:0",)], "id string")), now=3), f"{path}/main")
    save(load(spark, f"{path}/main"), copy)
    known = [("generations", len(generations(spark, f"{path}/main")))]
    first = load(spark, f"{path}/main", 1)
    known += [("regions before", first.nodes["Region"].count()), ("edges before", first.edges["IN_REGION"].count()), ("indexes", len(first.indexes))]
    known.append(("building", find_nodes(first, "Customer", ("mktsegment", "=", "BUILDING"), None).count()))
    drop_old(spark, f"{path}/main", 1)
    known.append(("generations left", len(generations(spark, f"{path}/main"))))
    rows = spark.createDataFrame(known, "what string, n long")
    return rows.unionByName(summary(spark, copy).select(F.concat("check", F.lit(" "), "name").alias("what"), "n"))


_query(
    "generations",
    """with r as (select count(*) as n from region), e as (select count(*) as n, sum(case when n_regionkey <> 0 then 1 else 0 end) as m from nation)
select 'generations' as what, cast(2 as bigint) as n union all select 'regions before', n from r union all select 'edges before', n from e union all select 'indexes', 1
union all select 'building', count(*) from customer where c_mktsegment = 'BUILDING' union all select 'generations left', 1
union all select 'nodes Region', n - 1 from r union all select 'nodes Nation', n from e union all select 'nodes Customer', count(*) from customer union all select 'edges IN_REGION', cast(m as bigint) from e""",
    _generations,
)


def _from_snapshot(g: Graph) -> DataFrame:
    """Reads of one state, whatever happens to the graph meanwhile."""
    g = g.only(("Region", "Nation"), ("IN_REGION",))
    with Snapshot(g) as s:
        changed = apply_changes(g, Changes().delete_nodes(g.nodes["Nation"].select("id")), now=1)
        return s.find_nodes("Nation", fields=["id"]).select("id", F.lit("snapshot").alias("seen")).unionByName(find_nodes(changed, "Region", fields=["id"]).select("id", F.lit("after").alias("seen")))


_query("snapshot", "select 'nation:' || n_nationkey as id, 'snapshot' as seen from nation union all select 'region:' || r_regionkey, 'after' from region", _from_snapshot)
_query(
    "permissive_edges",
    "select 'nation:' || n_nationkey as \"from\", 'planet:' || n_regionkey as \"to\", cast(1 as bigint) as version from nation",
    lambda g: (lambda e: apply_changes(g.only(("Region", "Nation"), ("IN_REGION",)), Changes().upsert_edges("ON", e), now=1, permissive=True).edges["ON"].select("from", "to", "version"))(
        g.edges["IN_REGION"].select("from", F.regexp_replace("to", "region", "planet").alias("to"))
    ),
)
