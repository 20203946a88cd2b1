"""Graph operators over edges (src, dst). Depths are bounded or found by loops that write each round's small state."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.sources.storage import cut

#: Rounds of a loop between two written states: plans stay short, and little is written.
CUT_EVERY = 4


def calls(edges: DataFrame, kind: str | None = "call") -> DataFrame:
    """Distinct (src, dst) of a kind, or of all."""
    return (edges.filter(F.col("kind") == kind) if kind else edges).select("src", "dst").distinct()


def walk(edges: DataFrame, roots: DataFrame, names: DataFrame | None = None, depth: int = 50) -> DataFrame:
    """All paths of 1 to ``depth`` edges from ``roots`` (id), revisits allowed: root, id, depth, path. 0 or less: 50.

    Every edge counts, so parallel edges give parallel paths. ``names`` (id, name) labels the path.
    """
    depth = depth if depth > 0 else 50
    hop = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    if names is not None:
        label = names.select(F.col("id").alias("_to"), F.col("name").alias("_name"))
        hop = hop.join(label, "_to")
        now = roots.join(names, "id").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.col("name").alias("path"))
    else:
        hop = hop.withColumn("_name", F.col("_to").cast("string"))
        now = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.col("id").cast("string").alias("path"))
    out = None
    for k in range(1, depth + 1):
        now = now.join(hop, F.col("id") == F.col("_from")).select("root", F.col("_to").alias("id"), F.lit(k).alias("depth"), F.concat_ws(" -> ", "path", "_name").alias("path"))
        if k % CUT_EVERY == 0:
            now = cut(now, "walk")
            if not now.take(1):
                break
        out = now if out is None else out.unionByName(now)
    return out


def tree_walk(edges: DataFrame, roots: DataFrame, depth: int = -1, limit: int | None = None) -> DataFrame:
    """Paths that stop at a node already on them: root, id, depth, path, is_cycle. 0 gives the roots only, below 0 no limit."""
    hop = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to")).distinct()
    now = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.array("id").alias("path"), F.lit(False).alias("is_cycle"))
    out = now
    last = depth if depth >= 0 else limit
    for k in count(1) if last is None else range(1, last + 1):
        step = now.filter(~F.col("is_cycle")).join(hop, F.col("id") == F.col("_from"))
        now = step.select("root", F.col("_to").alias("id"), F.lit(k).alias("depth"), F.concat("path", F.array("_to")).alias("path"), F.array_contains("path", F.col("_to")).alias("is_cycle"))
        if k % CUT_EVERY == 0:
            now = cut(now, "tree-walk")
            if not now.take(1):
                break
        out = out.unionByName(now)
    return out


def feature_trace(edges: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """Symbols that a feature's linked symbols reach, each once per depth; the linked ones at depth 0."""
    roots = links.select(F.col("symbol_id").alias("id")).distinct()
    near = walk(edges, roots, depth=depth).select("id", "depth")
    return roots.select("id", F.lit(0).alias("depth")).unionByName(near).distinct()


#: Up to so many edges a graph is counted as small, and one task does in one pass what a loop does in many rounds.
SMALL = 500_000


def _breadth_first(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distances of one task's graph; rows without a ``dst`` are the roots."""
    near: dict[int, list[int]] = defaultdict(list)
    is_root = pdf["dst"].isna()
    for s, d in zip(pdf.loc[~is_root, "src"].tolist(), pdf.loc[~is_root, "dst"].astype("int64").tolist()):
        near[s].append(d)
    distance = dict.fromkeys(pdf.loc[is_root, "src"].tolist(), 0)
    front, k = list(distance), 0
    while front:
        k += 1
        front = [d for d in dict.fromkeys(d for s in front for d in near.get(s, ())) if d not in distance]
        distance |= dict.fromkeys(front, k)
    return pd.DataFrame({"id": list(distance), "distance": list(distance.values())}).astype({"distance": "int32"})


def reachable(edges: DataFrame, roots: DataFrame, rounds: int | None = None, tag: str = "reach", small: int = SMALL) -> DataFrame:
    """Nodes that ``roots`` (id) reach, with their least distance: breadth first, each node visited once.

    A graph of up to ``small`` distinct edges and roots, counted first, is done in one task, others round by round.
    Only ``rounds``, if given, limits the distance.
    """
    hop = cut(edges.select("src", "dst").distinct(), tag)
    begin = cut(roots.select("id").distinct(), tag)
    if small and hop.count() + begin.count() <= small:
        both = hop.unionByName(begin.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"))).withColumn("_all", F.lit(0))
        found = both.groupBy("_all").applyInPandas(_breadth_first, "id long, distance int")
        return found if rounds is None else found.filter(F.col("distance") <= rounds)
    seen = begin.withColumn("distance", F.lit(0))
    front = seen
    for k in count(1) if rounds is None else range(1, rounds + 1):
        step = front.select(F.col("id").alias("src")).join(hop, "src").select(F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(k)), tag)
        if not front.take(1):
            break
        seen = seen.unionByName(front)
        if k % CUT_EVERY == 0:
            seen = cut(seen, tag)
    return seen


def neighbours(edges: DataFrame, node: int, incoming: bool = False) -> DataFrame:
    """One hop out of, or into, a node."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    return edges.filter(F.col(a) == node).select(F.col(b).alias("id"), "kind").distinct()


def _within(edges: DataFrame, roots: DataFrame, depth: int = 0) -> DataFrame:
    """The edges (root, src, dst) that ``roots`` (root, id) reach within ``depth`` steps (0: all), parallel ones kept, for steps
    that depend on an order."""
    hop = cut(edges.select("src", "dst"), "trace-edges")
    seen = cut(roots.select("root", "id").distinct(), "trace")
    front = seen
    for k in count(1) if depth <= 0 else range(1, depth + 1):
        step = front.join(hop, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, ["root", "id"], "left_anti"), "trace")
        if not front.take(1):
            break
        seen = seen.unionByName(front)
        if k % CUT_EVERY == 0:
            seen = cut(seen, "trace")
    return seen.join(hop, F.col("id") == F.col("src")).select("root", "src", "dst")


def _marked(edges: DataFrame, roots: DataFrame, known: DataFrame | None, depth: int) -> DataFrame:
    """Rows (root, src, dst, known) of each root's edges, and one without ``dst`` that tells whether the root is known."""
    rows = _within(edges, roots.select(F.col("id").alias("root"), "id"), depth).unionByName(roots.select(F.col("id").alias("root"), F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")))
    if known is None:
        return rows.withColumn("known", F.lit(True))
    end = F.coalesce("dst", "root")
    there = known.select(F.col("id").alias("_end")).distinct().withColumn("_known", F.lit(True))
    return rows.withColumn("_end", end).join(there, "_end", "left").select("root", "src", "dst", F.coalesce("_known", F.lit(False)).alias("known"))


def _adjacent(pdf: pd.DataFrame) -> tuple[dict[int, list[int]], set[int], bool]:
    """Sorted children per node, the unknown ones, and whether the root is known."""
    near: dict[int, list[int]] = defaultdict(list)
    is_edge = pdf["dst"].notna()
    mine = pdf[is_edge]
    for s, d in zip(mine["src"].tolist(), mine["dst"].astype("int64").tolist()):
        near[s].append(d)
    for to in near.values():
        to.sort()
    return near, set(mine.loc[~mine["known"], "dst"].astype("int64")), bool(pdf.loc[~is_edge, "known"].all())


def trace_from(edges: DataFrame, roots: DataFrame, depth: int = 0, known: DataFrame | None = None) -> DataFrame:
    """Depth-first trace of each root (id): root, node, depth, order, is_cycle, confidence. Children come by id.

    Every node is entered once; an edge to one entered before, parallel edges too, is told as a cycle, also when it only
    meets another branch. Nodes ``depth`` steps away are not left again; 0 is no limit. With ``known`` (id), an edge to a node
    that is not in it is not followed or told and takes the confidence of the trace to 0.9 times it; an unknown root gives one row
    without a node and confidence 0. The order decides the result, so a root's reachable edges meet in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root, (near, unknown, there) = int(pdf["root"].iloc[0]), _adjacent(pdf)
        names = ["root", "node", "depth", "order", "is_cycle"]
        types = {"node": "Int64", "depth": "Int32", "order": "Int32"}
        if not there:
            return pd.DataFrame([(root, None, None, None, False)], columns=names).astype(types).assign(confidence=0.0)
        out, entered, skipped = [(root, root, 0, 0, False)], {root}, 0
        stack = [(0, iter(near.get(root, ())))]
        while stack:
            level, rest = stack[-1]
            child = None if depth > 0 and level >= depth else next(rest, None)
            if child is None:
                stack.pop()
            elif child in unknown:
                skipped += 1
            else:
                out.append((root, child, level + 1, len(out), child in entered))
                if child not in entered:
                    entered.add(child)
                    stack.append((level + 1, iter(near.get(child, ()))))
        confidence = 1.0
        for _ in range(skipped):
            confidence *= 0.9
        return pd.DataFrame(out, columns=names).astype(types).assign(confidence=confidence)

    rows = _marked(edges, roots, known, depth)
    return rows.groupBy("root").applyInPandas(run, "root long, node long, depth int, order int, is_cycle boolean, confidence double")


def trace_callers(edges: DataFrame, roots: DataFrame, depth: int = 0, known: DataFrame | None = None) -> DataFrame:
    """Caller chains of each root (id): root, chain, place, node, depth. A chain starts at its furthest caller and ends at a direct one.

    Callers are searched depth first by id and entered once; those entered before, and unknown ones, are passed over without
    a row. A direct caller has depth 0, its callers 1; ``depth`` limits that (0: no limit). Every entered node without further
    callers starts a chain. Unknown roots and roots without callers have none. A root's callers meet in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root, (near, unknown, there) = int(pdf["root"].iloc[0]), _adjacent(pdf)
        towards: dict[int, int] = {}
        level_of: dict[int, int] = {}
        stack = [(root, 0, iter(near.get(root, ())))] if there else []
        while stack:
            node, level, rest = stack[-1]
            caller = None if depth > 0 and level >= depth else next(rest, None)
            if caller is None:
                stack.pop()
            elif caller != root and caller not in towards and caller not in unknown:
                towards[caller], level_of[caller] = node, level
                stack.append((caller, level + 1, iter(near.get(caller, ()))))
        out, inner = [], set(towards.values())
        for chain, node in enumerate(x for x in towards if x not in inner):
            place = 0
            while node != root:
                out.append((root, chain, place, node, level_of[node]))
                node, place = towards[node], place + 1
        return pd.DataFrame(out, columns=["root", "chain", "place", "node", "depth"])

    rows = _marked(reversed_edges(edges), roots, known, depth)
    return rows.groupBy("root").applyInPandas(run, "root long, chain int, place int, node long, depth int")


def reversed_edges(edges: DataFrame) -> DataFrame:
    """Edges the other way round, for traces of callers."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def paths_to(edges: DataFrame, names: DataFrame, target: int, hint: str = "", depth: int = 20) -> DataFrame:
    """The chain (id, name, path) from an entry node, one that nobody calls, to ``target``, at most one row.

    Callers are searched breadth first over edges (seq, src, dst) in the order of ``seq``; the first to find a node keeps it. Chains of
    over ``depth`` nodes are dropped. The first chain whose root's name has the hint, as it is written, wins, else the first
    whose root's name starts with ``route:``, else the first of the longest ones. An unknown target has none, nor has one in a
    closed cycle. Nodes without a name are named by their id.

    The order of the search is that of the edge numbers on the way to a node, so each round is a join and an aggregation.
    """
    hop = cut(edges.select("seq", "src", "dst"), "path-edges")
    now = names.filter(F.col("id") == target).select("id").distinct().select("id", F.array("id").alias("path"), F.array().cast("array<long>").alias("key"))
    now = seen = cut(now, "path")
    for _ in range(1, depth):
        step = now.join(hop, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), F.concat(F.array("src"), "path").alias("path"), F.concat("key", F.array("seq")).alias("key"))
        first = step.groupBy("id").agg(F.min(F.struct("key", "path")).alias("x")).select("id", "x.path", "x.key")
        now = cut(first.join(seen.select("id"), "id", "left_anti"), "path")
        if not now.take(1):
            break
        seen = seen.unionByName(now)
    called = hop.select(F.col("dst").alias("id")).distinct()
    ends = seen.filter(F.size("path") <= depth).join(called, "id", "left_anti").join(names.select("id", "name"), "id", "left").withColumn("name", F.coalesce("name", F.col("id").cast("string")))
    rank = F.when(F.lit(bool(hint)) & F.contains("name", F.lit(hint)), 0).when(F.col("name").startswith("route:"), 1).otherwise(2)
    length = F.size("path")
    return ends.orderBy(rank, F.when(rank == 2, -length).otherwise(length), "key").limit(1).select("id", "name", "path")


def _tarjan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of one task's edges by depth-first search with low links, without recursion."""
    near: dict[int, list[int]] = defaultdict(list)
    for s, d in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
        near[s].append(d)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    open_nodes: list[int] = []
    is_open: set[int] = set()
    out: list[tuple[int, int]] = []
    for start in list(near):
        if start in order:
            continue
        work = [(start, iter(near[start]))]
        order[start] = low[start] = len(order)
        open_nodes.append(start)
        is_open.add(start)
        while work:
            node, rest = work[-1]
            child = next(rest, None)
            if child is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    members = [open_nodes.pop()]
                    while members[-1] != node:
                        members.append(open_nodes.pop())
                    is_open.difference_update(members)
                    if len(members) > 1:
                        least = min(members)
                        out += [(m, least) for m in members]
            elif child not in order:
                order[child] = low[child] = len(order)
                open_nodes.append(child)
                is_open.add(child)
                work.append((child, iter(near.get(child, ()))))
            elif child in is_open:
                low[node] = min(low[node], order[child])
    return pd.DataFrame(out, columns=["node", "component"])


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """Strongly connected components of two nodes or more: (node, component), the component named by its smallest node.

    A graph of up to ``small`` distinct edges, counted first, is done in one task. Otherwise nodes without edges in and out are trimmed. Then the smallest id that reaches a node spreads forward as its colour,
    and those that reach their colour's root backward inside the colour are its component. Found ones are taken out, until
    no edge is left. Only edges inside a colour can matter, so each round also drops all others.
    """
    left = cut(edges.filter("src <> dst").select("src", "dst").distinct(), "scc")
    if left.count() <= small:
        return left.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_tarjan, "node long, component long")
    out = None
    while True:
        left = _trim(left)
        if not left.take(1):
            break
        nodes = left.select(F.col("src").alias("node")).distinct()
        colour = _spread(nodes.select("node", F.col("node").alias("c")), left)
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst").filter("a = b")
        inside = cut(inside.select("src", "dst", F.col("a").alias("c")), "scc")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = inside.select(F.col("c").alias("id")).distinct()
        found = reachable(back, roots, tag="scc", small=0).select(F.col("id").alias("node"))
        found = cut(found.join(colour, "node").withColumnRenamed("c", "component"), "scc")
        out = found if out is None else out.unionByName(found)
        gone = found.select("node")
        left = cut(inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "scc")
    if out is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    several = out.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    return out.join(several, "component", "left_semi").select("node", "component")


def _trim(edges: DataFrame) -> DataFrame:
    """Without nodes that have no edge in or none out, again and again."""
    now, n = edges, edges.count()
    while n:
        ins, outs = now.select(F.col("dst").alias("src")).distinct(), now.select(F.col("src").alias("dst")).distinct()
        new = cut(now.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"), "scc-trim")
        m = new.count()
        if m == n:
            return new
        now, n = new, m
    return now


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest colour that reaches each node along the edges."""
    now = cut(colour, "scc-colour")
    while True:
        come = edges.join(now.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "c")
        new = cut(now.unionByName(come).groupBy("node").agg(F.min("c").alias("c")), "scc-colour")
        if not new.join(now.withColumnRenamed("c", "old"), "node").filter("c <> old").take(1):
            return new
        now = new


def cycles(edges: DataFrame) -> DataFrame:
    """Components with their size, nodes and edges, parallel ones kept and self-loops dropped."""
    comp = cut(strong_components(edges), "cycles")
    inside = edges.filter("src <> dst").join(comp.select(F.col("node").alias("src"), "component"), "src").join(comp.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").filter("component = other")
    n_edges = inside.groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("nodes"))
    return sizes.join(n_edges, "component").select("component", "n_nodes", "n_edges", "nodes")


def cycle_walks(edges: DataFrame, components: DataFrame) -> DataFrame:
    """A walk through each component: from its smallest node always to the smallest node not yet on it, until stuck."""
    inside = edges.join(components.select(F.col("node").alias("src"), "component"), "src").join(components.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst")
    inside = inside.filter("component = other AND src <> dst").select("component", "src", "dst").distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near = pdf.sort_values("dst").groupby("src")["dst"].apply(list).to_dict()
        path = [pdf["src"].min()]
        on = set(path)
        while step := [x for x in near.get(path[-1], []) if x not in on][:1]:
            path += step
            on.update(step)
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "walk": [" -> ".join(map(str, path))]})

    return inside.groupBy("component").applyInPandas(run, "component long, walk string")


def _strong(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Component of each node on a cycle of ``edges``; other nodes are left out."""
    found = _tarjan(pd.DataFrame(edges, columns=["src", "dst"]))
    return dict(zip(found["node"].tolist(), found["component"].tolist()))


def _closing(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one component's edges those that close a cycle when they are put in.

    An edge does if its ends are strongly connected by the edges up to it. Times are halved: edges whose ends the earlier half
    connects are settled there, all others go on with the later half, in which those components are single nodes.
    """
    rows = sorted(zip(pdf["seq"].tolist(), pdf["src"].tolist(), pdf["dst"].tolist()))
    closes = [False] * len(rows)
    work = [(0, len(rows) - 1, [(i, a, b) for i, (_, a, b) in enumerate(rows)])]
    while work:
        low, high, mine = work.pop()
        if not mine:
            continue
        if low == high:  # with this one edge more
            comp = _strong([(a, b) for i, a, b in mine if i <= low])
            for i, a, b in mine:
                if i == low:
                    closes[i] = a == b or comp.get(a, -1) == comp.get(b, -2)
            continue
        mid = (low + high) // 2
        comp = _strong([(a, b) for i, a, b in mine if i <= mid])
        joined = lambda a, b: a == b or (a in comp and comp[a] == comp.get(b))
        work.append((low, mid, [(i, a, b) for i, a, b in mine if i <= mid and joined(a, b)]))
        later = []
        for i, a, b in mine:
            if i <= mid and joined(a, b):
                continue
            x, y = comp.get(a, a), comp.get(b, b)
            if i > mid or x != y:
                later.append((i, x, y))
        work.append((mid + 1, high, later))
    return pd.DataFrame({"seq": [x[0] for x in rows], "is_cycle": closes})


def insertion_cycles(edges: DataFrame) -> DataFrame:
    """Edges (seq, src, dst) in the order of ``seq`` with whether an edge closes a path of earlier ones; self-loops do.

    Only edges inside a strongly connected component can, so each component's edges meet in a task of their own.
    """
    mine = edges.select("seq", "src", "dst")
    comp = cut(strong_components(mine), "insertion")
    ends = mine.filter("src <> dst").join(comp.select(F.col("node").alias("src"), "component"), "src").join(comp.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst")
    flagged = ends.filter("component = other").select("component", "seq", "src", "dst").groupBy("component").applyInPandas(_closing, "seq long, is_cycle boolean")
    return mine.join(flagged, "seq", "left").select("seq", F.coalesce("is_cycle", F.col("src") == F.col("dst")).alias("is_cycle"))


def prune(edges: DataFrame, entries: DataFrame, sequential: bool = False) -> DataFrame:
    """Nodes kept from ``entries`` (id): all they reach and direct callers of these.

    ``sequential`` sweeps the edges (by ``seq``) once in order, so that later edges see callers added before.
    """
    reach = cut(reachable(edges, entries).select("id"), "prune")
    if not sequential:
        callers = edges.join(reach.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        return reach.unionByName(callers).distinct()
    marked = edges.select("seq", "src", "dst").join(reach.select(F.col("id").alias("dst"), F.lit(True).alias("_in")), "dst", "left")

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = set(pdf.loc[pdf["_in"].notna(), "dst"])
        for s, d in pdf.sort_values("seq")[["src", "dst"]].itertuples(index=False):
            if d in kept:
                kept.add(s)
        return pd.DataFrame({"id": sorted(kept)})

    return marked.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(sweep, "id long").unionByName(reach).distinct()


def merge_nodes(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """Edges with ends renamed by (old, new), equal ones folded."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(renames.select(F.col("old").alias(end), F.col("new").alias("_new")), end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return out.select("src", "dst", "kind").distinct()


def stitch(front: DataFrame, back: DataFrame) -> DataFrame:
    """A caller chain (id, depth) followed by a tree (id, depth), the tree's depths moved below the chain."""
    # one row
    base = front.agg(F.coalesce(F.max("depth") + 1, F.lit(0)).alias("_base"))
    lower = back.crossJoin(F.broadcast(base)).select("id", (F.col("depth") + F.col("_base")).cast("int").alias("depth"), F.lit("back").alias("part"))
    return front.select("id", F.col("depth").cast("int").alias("depth"), F.lit("front").alias("part")).unionByName(lower)


def trace_problems(trace: DataFrame) -> DataFrame:
    """Nodes that a trace (root, id, is_cycle) has more than once, and whether as a cycle."""
    n = trace.groupBy("root", "id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("is_cycle").cast("int")).alias("in_cycle"))
    return n.filter("n > 1 OR in_cycle = 1")


def first_chain(edges: DataFrame, roots: DataFrame, depth: int = 10) -> DataFrame:
    """From each root the chain of smallest children: root, depth, id; it ends at a node already on it."""
    child = cut(edges.filter("src <> dst").groupBy("src").agg(F.min("dst").alias("dst")), "chain")
    now = roots.select(F.col("id").alias("root"), "id", F.array("id").alias("on"), F.lit(0).alias("depth"))
    out = now
    for k in range(1, depth + 1):
        now = now.join(child, F.col("id") == F.col("src")).filter(~F.array_contains("on", F.col("dst")))
        now = now.select("root", F.col("dst").alias("id"), F.concat("on", F.array("dst")).alias("on"), F.lit(k).alias("depth"))
        if k % CUT_EVERY == 0:
            now = cut(now, "chain")
        out = out.unionByName(now)
    return out.select("root", "depth", "id")


def entry_point(method: Column, path: Column) -> Column:
    """Entry node of an API surface: ``VERB path``, a GraphQL resolver's method, or the path itself; null for a GraphQL path without a field."""
    op, field = F.substring_index(path, ".", 1), F.regexp_extract(path, r"^[^.]*\.(.+)$", 1)
    resolver = F.concat(F.lower(F.substring(op, 1, 1)), F.regexp_replace(op, "^.", ""), F.lit("Resolver."), F.upper(F.substring(field, 1, 1)), F.regexp_replace(field, "^.", ""))
    verbs = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
    return F.when(method.isin(*verbs), F.concat_ws(" ", method, path)).when(method == "GRAPHQL", F.when(field != "", resolver)).otherwise(path)


def check_order(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """Nodes whose layer is in ``kinds``, by its place there and then by id."""
    at = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("layer"))
    w = Window.partitionBy("feature_id").orderBy(at, "id")
    return nodes.filter(F.col("layer").isin(*kinds)).withColumn("check_no", F.row_number().over(w))
