import inspect
import random

import pytest
from pyspark.sql import functions as F

from sextant.operators import graph as G


@pytest.fixture()
def edges(spark):
    return lambda pairs: spark.createDataFrame([(i, a, b, "call") for i, (a, b) in enumerate(pairs)], "seq long, src long, dst long, kind string")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_walk_of_a_chain(spark, edges):
    chain = edges([(1, 2), (2, 3), (3, 4)])
    assert [(r["id"], r["depth"], r["path"]) for r in G.walk(chain, ids(spark, 1), depth=10).orderBy("depth").collect()] == [(2, 1, "1 -> 2"), (3, 2, "1 -> 2 -> 3"), (4, 3, "1 -> 2 -> 3 -> 4")]
    assert G.walk(chain, ids(spark, 1), depth=2).count() == 2
    assert G.walk(chain, ids(spark, 1), depth=0).count() == 3


def test_tree_walk_stops_at_ancestors_only(spark, edges):
    diamond = edges([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 1)])
    got = G.tree_walk(diamond, ids(spark, 1)).collect()
    assert sum(r["is_cycle"] for r in got) == 2 and sum(r["id"] == 4 for r in got) == 2
    assert G.tree_walk(diamond, ids(spark, 1), 0).count() == 1


def test_trace_enters_a_node_once(spark, edges):
    diamond = edges([(1, 3), (1, 2), (2, 4), (3, 4)])
    got = G.trace_from(diamond, ids(spark, 1)).orderBy("order").collect()
    assert [(r["node"], r["depth"], r["is_cycle"]) for r in got] == [(1, 0, False), (2, 1, False), (4, 2, False), (3, 1, False), (4, 2, True)]
    assert G.trace_from(diamond, ids(spark, 1), depth=1).count() == 3


def test_unknown_nodes_are_not_entered(spark, edges):
    g = edges([(1, 2), (2, 3), (1, 4), (4, 2)])
    got = G.trace_from(g, ids(spark, 1), known=ids(spark, 1, 3, 4)).orderBy("order").collect()
    assert [r["node"] for r in got] == [1, 4] and {round(r["confidence"], 9) for r in got} == {0.81}
    assert [(r["node"], r["confidence"]) for r in G.trace_from(g, ids(spark, 2), known=ids(spark, 1, 3, 4)).collect()] == [(None, 0.0)]
    assert G.trace_callers(g, ids(spark, 2), known=ids(spark, 1, 3, 4)).count() == 0


def trace_brute(pairs, root, depth, known):
    """The trace of a root and its confidence, by recursion."""
    if root not in known:
        return [(None, None, False)], 0.0
    out, entered, confidence = [], set(), [1.0]

    def enter(node, level):
        out.append((node, level, node in entered))
        if node in entered:
            return
        entered.add(node)
        if depth > 0 and level >= depth:
            return
        for child in sorted(b for a, b in pairs if a == node):
            if child in known:
                enter(child, level + 1)
            else:
                confidence[0] *= 0.9

    enter(root, 0)
    return out, confidence[0]


def callers_brute(pairs, root, depth, known):
    """The chains of callers of a root, furthest first, by recursion."""
    entered = {root}

    def chains(node, level):
        out = []
        if depth > 0 and level >= depth:
            return out
        for caller in sorted(a for a, b in pairs if b == node):
            if caller in entered or caller not in known:
                continue
            entered.add(caller)
            out += [[*above, (caller, level)] for above in chains(caller, level + 1)] or [[(caller, level)]]
        return out

    return chains(root, 0) if root in known else []


def path_brute(pairs, names, target, hint, depth):
    """The chain to a target, by a search with a queue."""
    if target not in names:
        return None
    queue, entered, found = [[target]], {target}, []
    while queue:
        path = queue.pop(0)
        if len(path) > depth:
            continue
        callers = [a for a, b in pairs if b == path[0]]
        if not callers:
            found.append(path)
        for c in callers:
            if c not in entered:
                entered.add(c)
                queue.append([c, *path])
    name = lambda p: names.get(p[0], str(p[0]))
    for p in found if hint else ():
        if hint in name(p):
            return p
    for p in found:
        if name(p).startswith("route:"):
            return p
    return max(found, key=len, default=None)


def random_graph(seed, n=26, m=48):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + i, rng.randrange(n)) for i in range(5)]


@pytest.mark.parametrize("depth", [0, 3])
def test_traces_like_recursion(spark, edges, depth):
    pairs = random_graph(depth)
    known = {x for p in pairs for x in p if x % 7 != 3}
    roots = sorted({x for p in pairs for x in p})
    g, r, k = edges(pairs), ids(spark, *roots), ids(spark, *known)
    got, conf = {x: [] for x in roots}, {}
    for row in G.trace_from(g, r, depth, k).orderBy("root", "order").collect():
        got[row["root"]].append((row["node"], row["depth"], row["is_cycle"]))
        conf[row["root"]] = row["confidence"]
    for x in roots:
        want, c = trace_brute(pairs, x, depth, known)
        assert got[x] == want and conf[x] == pytest.approx(c)
    chains = {x: {} for x in roots}
    for row in G.trace_callers(g, r, depth, k).orderBy("root", "chain", "place").collect():
        chains[row["root"]].setdefault(row["chain"], []).append((row["node"], row["depth"]))
    for x in roots:
        assert list(chains[x].values()) == callers_brute(pairs, x, depth, known)


@pytest.mark.parametrize(("hint", "depth"), [("", 20), ("page", 4), ("PAGE", 5), ("svc", 3)])
def test_chain_to_a_target_like_a_queue(spark, edges, hint, depth):
    pairs = random_graph(9, 22, 26)
    names = {x: f"{'page' if x % 3 == 0 else 'route:r' if x % 4 == 1 else 'svc'}{x}" for p in pairs for x in p if x % 11 != 10}
    table, g = spark.createDataFrame(list(names.items()), "id long, name string"), edges(pairs)
    for target in (3, 8, 10, 14, 21):
        row = G.paths_to(g, table, target, hint, depth).first()
        assert (row and row["path"]) == path_brute(pairs, names, target, hint, depth)


def test_insertion_cycles_like_searches(edges):
    pairs = random_graph(4, 30, 60)
    near, want = {}, {}
    for i, (a, b) in enumerate(pairs):
        seen, stack = {b}, [b]
        while stack:
            for y in near.get(stack.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        want[i] = a in seen
        near.setdefault(a, set()).add(b)
    assert dict(G.insertion_cycles(edges(pairs)).collect()) == want and any(want.values())


def test_cycle_walks_like_steps(edges):
    pairs = random_graph(5, 40, 60)
    g = edges(pairs)
    comp = dict(G.strong_components(g).collect())
    for r in G.cycle_walks(g, G.strong_components(g)).collect():
        walk = [r["component"]]
        while nxt := sorted(b for a, b in pairs if a == walk[-1] and comp.get(b) == r["component"] and b not in walk):
            walk.append(nxt[0])
        assert r["walk"] == " -> ".join(map(str, walk))


def test_sequential_prune_like_a_sweep(spark, edges):
    pairs = random_graph(6, 40, 50)
    kept, front = {1, 2}, [1, 2]
    while front:
        x = front.pop()
        for a, b in pairs:
            if a == x and b not in kept:
                kept.add(b)
                front.append(b)
    for a, b in pairs:
        if b in kept:
            kept.add(a)
    assert {r["id"] for r in G.prune(edges(pairs), ids(spark, 1, 2), sequential=True).collect()} == kept


CASES = {
    "none": ([], []), "chain": ([(1, 2), (2, 3)], []), "pair": ([(1, 2), (2, 1)], [{1, 2}]), "triangle": ([(1, 2), (2, 3), (3, 1)], [{1, 2, 3}]),
    "self": ([(1, 1), (1, 2)], []), "parallel": ([(1, 2), (1, 2), (2, 1)], [{1, 2}]), "several": ([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3)], [{1, 2}, {3, 4, 5}]),
}


@pytest.mark.parametrize("small", [0, 1000])
@pytest.mark.parametrize("case", CASES)
def test_strong_components(edges, case, small):
    pairs, want = CASES[case]
    got = {}
    for r in G.strong_components(edges(pairs), small).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(got.values(), key=min) == want and all(k == min(v) for k, v in got.items())


def test_both_component_paths_agree(edges):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]
    loop, once = (sorted(map(tuple, G.strong_components(edges(pairs), n).collect())) for n in (0, 1000))
    assert loop == once and loop
    flipped = sorted(map(tuple, G.strong_components(edges([(b, a) for a, b in pairs])).collect()))
    assert flipped == once


def test_cycles_keep_parallel_edges(edges):
    row = G.cycles(edges([(1, 2), (1, 2), (2, 1), (2, 2), (5, 1)])).first()
    assert (row["n_nodes"], row["n_edges"], row["nodes"]) == (2, 3, "1,2")
    g = edges([(1, 2), (2, 3), (3, 1), (1, 3)])
    assert G.cycle_walks(g, G.strong_components(g)).first()["walk"] == "1 -> 2 -> 3"


def test_insertion_order_makes_the_cycle_flag(edges):
    got = {r["seq"]: r["is_cycle"] for r in G.insertion_cycles(edges([(1, 2), (2, 3), (3, 1), (4, 4), (1, 3)])).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: True}


def test_prune_keeps_direct_callers(spark, edges):
    g = edges([(9, 8), (8, 1), (1, 2), (7, 9)])
    assert {r["id"] for r in G.prune(g, ids(spark, 1)).collect()} == {1, 2, 8}
    assert {r["id"] for r in G.prune(g, ids(spark, 1), sequential=True).collect()} == {1, 2, 8}
    later = edges([(8, 1), (9, 8), (1, 2)])
    assert {r["id"] for r in G.prune(later, ids(spark, 1), sequential=True).collect()} == {1, 2, 8, 9}


def test_chain_to_a_target(spark, edges):
    names = spark.createDataFrame([(1, "route:a"), (2, "svc"), (3, "target"), (4, "page")], "id long, name string")
    g = edges([(1, 2), (2, 3), (4, 3)])
    assert G.paths_to(g, names, 3).first()["path"] == [1, 2, 3]
    assert G.paths_to(g, names, 3, hint="page").first()["path"] == [4, 3]
    assert G.paths_to(g, names, 3, hint="PAGE").first()["path"] == [1, 2, 3]
    assert G.paths_to(edges([(1, 2), (2, 1)]), names, 1).count() == 0


def test_reach_and_merge(spark, edges):
    g = edges([(1, 2), (2, 3), (3, 1), (5, 6)])
    for small in (0, 100):
        assert dict(G.reachable(g, ids(spark, 1), small=small).collect()) == {1: 0, 2: 1, 3: 2}
        assert dict(G.reachable(g, ids(spark, 1, 5), rounds=1, small=small).collect()) == {1: 0, 2: 1, 5: 0, 6: 1}
        assert G.reachable(g, ids(spark, 1).limit(0), small=small).count() == 0
    merged = G.merge_nodes(g, spark.createDataFrame([(5, 1)], "old long, new long"))
    assert {(r["src"], r["dst"]) for r in merged.collect()} == {(1, 2), (2, 3), (3, 1), (1, 6)}


def test_entry_points(spark):
    df = spark.createDataFrame([("GET", "/x"), ("GRAPHQL", "Mutation.logSet"), ("GRAPHQL", "Query"), ("JOB", "nightly")], "m string, p string")
    assert [r[0] for r in df.select(G.entry_point(F.col("m"), F.col("p"))).collect()] == ["GET /x", "mutationResolver.LogSet", None, "nightly"]


def test_reach_has_no_limit_of_its_own(spark):
    chain = spark.range(10_050).selectExpr("id AS src", "id + 1 AS dst")
    far = G.reachable(chain, ids(spark, 0)).agg(F.count(F.lit(1)), F.max("distance")).first()
    assert tuple(far) == (10_051, 10_050)
    assert G.reachable(chain, ids(spark, 0), rounds=10_000).count() == 10_001
    assert inspect.signature(G.tree_walk).parameters["limit"].default is None
