import random
import re
from collections import deque
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from trellis.errors import Conflict, CorruptData, InvalidArgument, LimitExceeded, NotFound
from trellis.functions import SCALAR, scalar
from trellis.graph import Graph, Link
from trellis.limits import STRICT, Limits
from trellis.operators import Changes, Walk, apply_changes, expanded_edges, find_nodes, get_edge, get_node, inspect, inspect_edges, inspect_indexes, inspect_nodes, one, paths, reach, verify, walk
from trellis.sources import load, save, star_graph
from trellis.sources.store import drop_old, generations


def make(spark, nodes, edges):
    """nodes: ids; edges: (type, from, to)."""
    g = Graph(spark).with_nodes("N", spark.createDataFrame([(n,) for n in nodes], "id string"))
    for k in sorted({e[0] for e in edges}):
        g = g.with_edges(k, spark.createDataFrame([(a, b, i) for i, (t, a, b) in enumerate(edges) if t == k], "from string, to string, weight long"))
    return g


def key(t, a, b):
    return "".join(f"{len(x.encode())}:{x}" for x in (a, t, b)).encode()


def queue_walk(nodes, edges, start, over=None, direction="out", depth=1, limit=100):
    """A walk with a queue, edge by edge: (ids with depths and paths, edges looked at)."""
    out, looked = [], 0
    if start not in nodes or depth == 0 or limit == 0:
        return out, looked
    seen, queue = {start}, deque([(start, 0, [])])
    while queue:
        at, d, path = queue.popleft()
        if d == depth:
            continue
        for k, (t, a, b) in sorted((key(*e), e) for e in edges if (over is None or e[0] == over) and e[1 if direction == "out" else 2] == at):
            looked += 1
            to = b if direction == "out" else a
            if to in seen or to not in nodes:
                continue
            seen.add(to)
            out.append((to, d + 1, [*path, k.decode()]))
            if len(out) == limit:
                return out, looked
            queue.append((to, d + 1, [*path, k.decode()]))
    return out, looked


DIAMOND = ("abcd", [("E", "a", "c"), ("E", "c", "d"), ("E", "a", "b"), ("E", "b", "d"), ("E", "a", "a"), ("E", "d", "a"), ("F", "a", "b")])


@pytest.fixture(scope="module")
def diamond(spark):
    return make(spark, *DIAMOND)


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_diamond(diamond):
    assert ids(walk(diamond, "a", "E", depth=3)) == ["b", "c", "d"]
    assert ids(walk(diamond, "d", "E", "in", 3)) == ["b", "c", "a"]
    hops = [(r.id, r.hop, r["from"], r.to, r.node) for r in paths(diamond, "a", "E", depth=3).orderBy("rank", "hop").collect()]
    assert hops == [("b", 1, "a", "b", "b"), ("c", 1, "a", "c", "c"), ("d", 1, "a", "b", "b"), ("d", 2, "b", "d", "d")]
    back = [(r.id, r.hop, r["from"], r.to, r.node) for r in paths(diamond, "d", "E", "in", 3).orderBy("rank", "hop").collect()]
    assert back == [("b", 1, "b", "d", "b"), ("c", 1, "c", "d", "c"), ("a", 1, "b", "d", "b"), ("a", 2, "a", "b", "a")]
    assert ids(walk(diamond, "a", "E", depth=3, limit=2)) == ["b", "c"]
    for none in (walk(diamond, "a", depth=0), walk(diamond, "a", limit=0), walk(diamond, "nobody"), walk(diamond, "a", "G")):
        assert none.collect() == []


def test_length_prefix_goes_first(spark):
    g = make(spark, ["start", "z", "aa", "end"], [("E", "start", "aa"), ("E", "start", "z"), ("E", "z", "end"), ("Z", "start", "end")])
    assert ids(walk(g, "start", depth=2)) == ["z", "aa", "end"]
    assert [r.type for r in paths(g, "start", depth=2).where("id = 'end'").collect()] == ["Z"]


def test_missing_nodes_are_no_bridge(spark):
    g = make(spark, ["a", "c", "d"], [("E", "a", "missing"), ("E", "missing", "c"), ("E", "a", "d")])
    assert ids(walk(g, "a", depth=3)) == ["d"]


def test_random_walks_equal_a_queue(spark):
    r = random.Random(11)
    for case in range(8):
        nodes = [f"n{i}" if i % 3 else f"nodé{i:08}" for i in range(10)]
        edges = sorted({(r.choice("EF"), r.choice([*nodes, "gone"]), r.choice([*nodes, "gone"])) for _ in range(28)})
        g = make(spark, nodes, edges)
        args = r.choice(nodes), r.choice([None, "E"]), r.choice(["out", "in"]), r.randrange(1, 5), r.choice([2, 5, 100])
        want, looked = queue_walk(nodes, edges, *args)
        got = walk(g, *args).orderBy("rank").collect()
        assert [(x.id, x.depth) for x in got] == [(i, d) for i, d, _ in want], (case, args)
        assert expanded_edges(g, *args) == looked, (case, args)


def test_deep_walk_is_cut(spark):
    nodes = [f"v{i}" for i in range(9)]
    g = make(spark, nodes, [("E", f"v{i}", f"v{i + 1}") for i in range(8)])
    assert ids(walk(g, "v0", depth=8)) == nodes[1:]
    assert ids(walk(g, "v0", depth=16)) == nodes[1:]


def test_many_starts(spark, diamond):
    got = {(r.start, r.id): r.depth for r in reach(diamond, spark.createDataFrame([("a",), ("b",), ("x",)], "id string"), "E", depth=2, ordered=False).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("b", "d"): 1, ("b", "a"): 2}


def test_limits(diamond):
    for how in ({"depth": 17}, {"limit": 10_001}, {"depth": 3, "limits": Limits(edges=3)}):
        with pytest.raises(LimitExceeded):
            walk(diamond, "a", **{"limits": STRICT, **how})
    with pytest.raises(LimitExceeded):
        apply_changes(diamond, Changes().create_index("N", "a").create_index("N", "b"), limits=Limits(changes=1))
    assert walk(diamond, "a", "E", depth=3, limits=Limits(edges=6)).count() == 3
    with pytest.raises(LimitExceeded):
        expanded_edges(diamond, "a", depth=3, most=3)
    assert walk(diamond, "a", depth=-1).collect() == [] == walk(diamond, "a", limit=-1).collect() == find_nodes(diamond, "N", limit=-1).collect()
    free = walk(diamond, "a", "E", depth=20, limit=None)
    assert {(r.id, r.depth, r["rank"]) for r in free.collect()} == {("b", 1, None), ("c", 1, None), ("d", 2, None)}


def test_builder(diamond):
    w = Walk(diamond, "a")
    assert ids(w.out("E").depth(3).limit(2).collect()) == ["b", "c"] and w.levels == 1
    assert ids(w.out("E").into("E").collect()) == ["d"] and w.depth(-4).levels == 0
    assert w.out("E").depth(2).paths().count() == 4


def test_find_mixed_types_and_order(spark):
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("id"), v.alias("v")) for i, v in (("10", scalar(1)), ("2", scalar(1.0)), ("a", scalar("1")), ("b", scalar(None)), ("c", F.lit(None).cast(SCALAR)))])).alias("x")).select("x.*")
    g = Graph(spark).with_nodes("P", rows)
    found = lambda *where: [r.id for r in find_nodes(g, "P", where).collect()]
    assert found("v", "=", 1) == ["10", "2"] == found("v", "==", 1.0)
    assert found("v", "!=", 1) == ["a", "b", "c"] and found("v", "=", None) == ["b"] and found("v", "<", "2") == ["a"]
    assert found("nothing", "!=", 1) == ["10", "2", "a", "b", "c"] and found("nothing", "=", None) == [] and found("id", "=", "10") == []
    assert find_nodes(g, "P", limit=0).collect() == [] and find_nodes(g, "Q").collect() == []
    assert [r.id for r in find_nodes(g.with_index("P", "v"), "P", ("v", "=", 1)).collect()] == ["10", "2"]


def test_point_reads_and_pages(spark, diamond):
    assert one(get_node(diamond, "a")).label == "N" and one(get_edge(diamond, "E", "a", "b")).version == 1
    for none in (get_node(diamond, "zz"), get_edge(diamond, "E", "b", "a"), get_edge(diamond, "X", "a", "b")):
        with pytest.raises(NotFound):
            one(none)
    assert [r.id for r in inspect_nodes(diamond, "a", 2).collect()] == ["b", "c"]
    keys, after = [], None
    while page := [r.id for r in inspect_edges(diamond, after, 3).collect()]:
        keys, after = keys + page, page[-1]
    assert keys == sorted(key(*e).decode() for e in DIAMOND[1])
    with pytest.raises(InvalidArgument):
        inspect(diamond, "node", limit=101)
    assert [tuple(r) for r in inspect_indexes(diamond.with_index("N", "p").with_index("N", "p")).collect()] == [("N", "p")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_changes(spark, diamond):
    g = apply_changes(diamond, Changes().upsert_nodes("N", frame(spark, [("a", 1), ("e", 2)], "id string, v long")).upsert_edges("E", frame(spark, [("e", "a")], "from string, to string")), now=5)
    assert {r.id: (r.version, r.v, r.last_modified_ms) for r in g.nodes["N"].collect()} == {"a": (2, 1, 5), "b": (1, None, 0), "c": (1, None, 0), "d": (1, None, 0), "e": (1, 2, 5)}
    assert ids(walk(g, "e", depth=2)) == ["a", "b", "c"]
    moved = apply_changes(g, Changes().upsert_nodes("M", frame(spark, [("a",)], "id string")))
    assert [(r.id, r.version) for r in moved.nodes["M"].collect()] == [("a", 3)] and moved.nodes["N"].where("id = 'a'").isEmpty()
    gone = apply_changes(g, Changes().delete_nodes(frame(spark, [("a",)], "id string")))
    assert {(r["from"], r.to) for r in gone.edges["E"].collect()} == {("c", "d"), ("b", "d")} and gone.edges["F"].isEmpty()
    back = apply_changes(gone, Changes().upsert_nodes("N", frame(spark, [("a",)], "id string")))
    assert one(get_node(back, "a")).version == 1
    assert one(get_edge(apply_changes(g, Changes().upsert_edges("E", frame(spark, [("a", "b")], "from string, to string"))), "E", "a", "b")).version == 2
    assert {(r.check, r.name): r.n for r in verify(gone).collect()}[("dangling edges", "E")] == 0


def test_failed_changes_leave_all_as_it_was(spark, diamond):
    before = diamond.nodes["N"].count(), diamond.edges["E"].count()
    new = frame(spark, [("q",)], "id string")
    for bad in (
        Changes().upsert_nodes("N", new).upsert_edges("E", frame(spark, [("q", "missing")], "from string, to string")),
        Changes().upsert_nodes("N", new).delete_nodes(frame(spark, [("missing",)], "id string")),
        Changes().upsert_nodes("N", new).delete_edges("E", frame(spark, [("b", "a")], "from string, to string")),
    ):
        with pytest.raises(NotFound):
            apply_changes(diamond, bad)
    with pytest.raises(InvalidArgument):
        apply_changes(diamond, Changes())
    assert (diamond.nodes["N"].count(), diamond.edges["E"].count()) == before
    assert apply_changes(diamond, Changes().upsert_edges("E", frame(spark, [("a", "missing")], "from string, to string")), permissive=True).edges["E"].count() == before[1] + 1


def test_verify_finds_faults(spark):
    g = Graph(spark).with_nodes("A", frame(spark, [("x",), ("y",)], "id string")).with_nodes("B", frame(spark, [("x",)], "id string")).with_edges("E", frame(spark, [("x", "y"), ("x", "y"), ("x", "z")], "from string, to string"))
    found = {(r.check, r.name): r.n for r in verify(g).collect()}
    assert found[("repeated ids", "")] == 1 and found[("repeated edges", "E")] == 1 and found[("nodes", "A")] == 2


def test_store(spark, diamond, tmp_path):
    path = str(tmp_path / "g")
    with pytest.raises(CorruptData):
        load(spark, path)
    assert save(diamond.with_index("N", "p"), path) == 1
    g = load(spark, path)
    assert g.indexes == {("N", "p")} and ids(walk(g, "a", "E", depth=3)) == ["b", "c", "d"]
    assert save(apply_changes(g, Changes().delete_nodes(frame(spark, [("d",)], "id string"))), path) == 2
    assert load(spark, path).nodes["N"].count() == 3 and load(spark, path, 1).nodes["N"].count() == 4
    (tmp_path / "g" / "gen-3").mkdir()
    assert generations(spark, path) == [1, 2] and load(spark, path).nodes["N"].count() == 3
    with pytest.raises(Conflict):
        save(g, path)
    assert drop_old(spark, path, 1) == [1] and generations(spark, path) == [2]


@dataclass
class Turned:
    id: str
    label: str
    missing: str | None


def test_typed_walk(diamond):
    assert Walk(diamond, "a").out("E").depth(3).limit(2).collect_as(Turned) == [Turned("b", "N", None), Turned("c", "N", None)]


def test_mixed_properties(spark):
    a = frame(spark, [("x", 1, "s")], "id string, p long, q string")
    g = Graph(spark).with_nodes("A", a).with_nodes("B", frame(spark, [("y", 1.0, "t")], "id string, p double, q string")).with_edges("E", frame(spark, [("x", "y", True)], "from string, to string, w boolean"))
    got = {r.id: (r.p, r.q, r.nothing) for r in walk(g, "x", fields=["id", "p", "q", "nothing"]).unionByName(walk(g, "y", direction="in", fields=["id", "p", "q", "nothing"]), True).collect()}
    assert got["y"][1:] == ("t", None) and got["x"][1:] == ("s", None)
    hops = paths(g, "x", whole=True).orderBy("hop").collect()
    assert [h["at"].properties for h in hops] == [{"p": "1", "q": '"s"'}, {"p": "1.0", "q": '"t"'}] and hops[0].edge is None and hops[1].edge.properties == {"w": "true"}
    assert [r["at"].p for r in paths(g, "x", fields=["p"]).orderBy("hop").collect()] == ["1", "1.0"]


def test_saved_finds_skip_by_the_index(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("id"), (F.col("id") % 10).alias("p"))
    save(Graph(spark).with_nodes("N", rows).with_index("N", "p"), str(tmp_path / "g"))
    g = load(spark, str(tmp_path / "g"))
    files = g.nodes["N"].select(F.input_file_name().alias("f"), "p").groupBy("p").agg(F.countDistinct("f").alias("n")).collect()
    assert max(r.n for r in files) <= 2 and find_nodes(g, "N", ("p", "=", 3), None).count() == 200


def test_changes_after_changes_and_on_star_tables(spark, sf):
    g = star_graph(spark, sf)
    ids = frame(spark, [("customer:1",)], "id string")
    orders = g.edges["PLACED"].where("`from` = 'customer:1'").count()
    after = apply_changes(g, Changes().delete_nodes(ids).upsert_nodes("Customer", ids).delete_nodes(frame(spark, [("order:1",)], "id string")))
    assert g.edges["PLACED"].count() - after.edges["PLACED"].count() in (orders, orders + 1)
    assert "Part" in after.keyed and "SUPPLIED_BY" in after.links and "Customer" not in after.keyed and "PLACED" not in after.links
    assert one(get_node(after, "customer:1")).version == 1 and get_node(after, "order:1").isEmpty()
    assert walk(after, "customer:1", depth=2).isEmpty()


def test_first_level_and_point_reads_push_their_keys(spark, sf):
    g = star_graph(spark, sf)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(walk(g, "customer:1", depth=2))
    assert text.count("FileScan") < 30 and "EqualTo(o_custkey,1)" in text and "EqualTo(user_id,1)" in text
    assert "EqualTo(p_partkey,7)" in plan(get_node(g, "part:7")) and plan(get_node(g, "part:7")).count("FileScan") == 1
    assert "EqualTo(l_orderkey,1)" in plan(get_edge(g, "CONTAINS", "order:1", "part:2"))


def faulty(spark, keyed):
    """A graph with repeated and null keys, repeated edges and edges to nowhere, by native keys and links or by ids."""
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    nodes = {"A": rows("key long", (1,), (1,), (2,), (None,)), "B": rows("key long", (1,), (5,), (None,)), "T": rows("key string", ("t:x",), ("t:y",), ("t:y",))}
    pairs = {"AB": rows("src long, dst long", (1, 1), (1, 1), (2, 9), (8, 5), (7, 7), (7, 7), (None, 1), (None, 1), (2, None)), "AT": rows("src long, dst string", (1, "t:x"), (1, "t:z"), (3, "t:y")), "NONE": rows("src long, dst long")}
    folded = lambda df: df.groupBy("src", "dst").agg(F.count("*").alias("lines"))
    g = Graph(spark)
    for k, df in nodes.items():
        g = g.with_keyed(k, {"A": "a:", "B": "b:", "T": "t:"}[k], lambda df=df: df, text=k == "T")
    g = g.with_links("AB", Link("A", "B", lambda: pairs["AB"]), Link("A", "B", lambda: pairs["AB"].where("src = 1").distinct())).with_links("AT", Link("A", "T", lambda: pairs["AT"])).with_links("NONE", Link("A", "B", lambda: pairs["NONE"]))
    g = g.with_links("SUM", Link("A", "B", lambda: pairs["AB"], folded), Link("B", "B", lambda: pairs["AB"], lambda df: df.withColumn("lines", F.lit(1).cast("long"))))
    if keyed:
        return g
    plain = Graph(spark)
    for k in g.nodes:
        plain = plain.with_nodes(k, g.nodes[k])
    for k in g.edges:
        plain = plain.with_edges(k, g.edges[k])
    return plain


def test_verify_is_the_same_by_keys_and_by_ids(spark):
    got = [{(r["check"], r["name"]): r["n"] for r in verify(faulty(spark, keyed)).collect()} for keyed in (True, False)]
    assert got[0] == got[1]
    want = {"edges": (10, 3, 0, 15), "repeated edges": (3, 0, 0, 3), "dangling edges": (7, 2, 0, 12)}
    for check, counts in want.items():
        assert tuple(got[0][check, k] for k in ("AB", "AT", "NONE", "SUM")) == counts, check
    assert got[0]["nodes", "A"] == 4 and got[0]["repeated ids", ""] == 3  # a:1, t:y and the null ids of A and B


def shuffles(df):
    """(keys, partitions, why) of a plan's shuffles by hash."""
    found = re.findall(r"Exchange hashpartitioning\((.*), (\d+)\), (\w+)", df._jdf.queryExecution().executedPlan().toString())
    return [(re.sub(r"#\d+L?", "", keys), int(n), why) for keys, n, why in found]


@pytest.mark.parametrize("keyed", (True, False))
def test_verify_deals_edges_by_their_rows(spark, sf, monkeypatch, keyed):
    """Tasks follow the number of rows, not the session's setting, wherever edges or ids are gathered."""
    monkeypatch.setattr("trellis.graph.ROWS_A_TASK", 500)
    g = star_graph(spark, sf)
    if not keyed:
        g = Graph(spark).with_nodes("Order", g.nodes["Order"]).with_edges("CONTAINS", g.edges["CONTAINS"])
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    found = [(set(keys.split(", ")), n, why) for keys, n, why in shuffles(verify(g))]
    half = [{"src", "dst"}, {"type", "from", "to"}] if keyed else []  # edges that have a null end
    assert all(why == "REPARTITION_BY_NUM" for keys, _, why in found if keys & {"src", "dst", "from", "to", "key"} and keys not in half)
    assert max(n for keys, n, _ in found if {"src", "dst"} <= keys or {"from", "to"} <= keys) >= lines // 500


def test_walks_from_many_starts_deal_their_rows(spark, sf, monkeypatch):
    """Edges, frontiers and ids of a level are dealt by counts; what is found is what ids find without native keys."""
    monkeypatch.setattr("trellis.graph.ROWS_A_TASK", 100)
    g = star_graph(spark, sf).only(("Customer", "Order", "Part"), ("PLACED", "CONTAINS"))
    df = reach(g, g.nodes["Customer"], depth=2, ordered=False, label="Customer")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    found = [(set(keys.split(", ")), n, why) for keys, n, why in shuffles(df)]
    assert all(why == "REPARTITION_BY_NUM" for keys, _, why in found if keys & {"src", "start"})
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert max(n for keys, n, _ in found if keys == {"src"}) >= lines // 100 and max(n for keys, n, _ in found if keys == {"start", "key"}) >= lines // 200
    plain = Graph(spark).with_edges("PLACED", g.edges["PLACED"]).with_edges("CONTAINS", g.edges["CONTAINS"])
    for k in g.nodes:
        plain = plain.with_nodes(k, g.nodes[k])
    some = g.nodes["Customer"].where("id like 'customer:1%'")
    for direction, starts, label in (("out", some, "Customer"), ("in", g.nodes["Part"].where("id like 'part:1_'"), "Part")):
        got = [sorted((r.start, r.id, r.depth, r["keys"]) for r in reach(x, starts, direction=direction, depth=2, label=label).collect()) for x in (g, plain)]
        assert got[0] and got[0] == got[1]
