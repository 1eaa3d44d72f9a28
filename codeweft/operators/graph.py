"""Dependency graphs: build, density, modularity, communities, traversal."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.session import cut_lineage


def dependency_graph(edges: DataFrame) -> DataFrame:
    """``(src, dst, n)`` with counts; self edges and null ends are dropped."""
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def undirected(edges: DataFrame) -> DataFrame:
    """``(a, b)`` with a < b, each pair once, loops dropped."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def density(edges: DataFrame) -> DataFrame:
    """One row: nodes, undirected edges and 2m / (n (n - 1))."""
    u = undirected(edges)
    n = edges.select("src").unionAll(edges.select("dst")).agg(F.count_distinct("src").alias("n"))
    m = u.agg(F.count(F.lit(1)).alias("m"))
    return n.crossJoin(F.broadcast(m)).select("n", "m", F.when(F.col("n") > 1, F.lit(2.0) * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row ``(modularity, m)`` of ``members(node, community)``: (1 / 2m) times the sum of 1 - ki kj / 2m over edges inside."""
    u = undirected(edges)
    degree = u.select(F.col("a").alias("node")).unionAll(u.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    known = members.join(degree, "node")
    both = u.join(known.select(F.col("node").alias("a"), F.col("community").alias("ca"), F.col("k").alias("ka")), "a").join(known.select(F.col("node").alias("b"), F.col("community").alias("cb"), F.col("k").alias("kb")), "b")
    m = u.agg(F.count(F.lit(1)).cast("double").alias("m"))
    inside = both.where("ca = cb").agg(F.count(F.lit(1)).alias("e"), F.coalesce(F.sum(F.col("ka") * F.col("kb")), F.lit(0)).alias("kk"))
    return m.crossJoin(F.broadcast(inside)).select(F.when(F.col("m") > 0, (F.col("e") - F.col("kk") / (2 * F.col("m"))) / (2 * F.col("m"))).otherwise(0.0).alias("modularity"), F.col("m").cast("bigint").alias("m"))


def community_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(from_community, to_community, n_edges, weight)`` of a graph with ``n`` as weights."""
    a = members.select(F.col("node").alias("src"), F.col("community").alias("from_community"))
    b = members.select(F.col("node").alias("dst"), F.col("community").alias("to_community"))
    return edges.join(a, "src").join(b, "dst").groupBy("from_community", "to_community").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("n").alias("weight"))


def community_coupling(links: DataFrame) -> DataFrame:
    """Edges inside, out and in, and out / (inside + in + out), of each community."""
    inside = links.where("from_community = to_community").select(F.col("from_community").alias("community"), F.col("n_edges").alias("inside"), F.lit(0).alias("outgoing"), F.lit(0).alias("incoming"))
    out = links.where("from_community <> to_community").select(F.col("from_community").alias("community"), F.lit(0), F.col("n_edges"), F.lit(0))
    inn = links.where("from_community <> to_community").select(F.col("to_community").alias("community"), F.lit(0), F.lit(0), F.col("n_edges"))
    s = inside.unionAll(out).unionAll(inn).groupBy("community").agg(F.sum("inside").alias("inside"), F.sum("outgoing").alias("outgoing"), F.sum("incoming").alias("incoming"))
    whole = F.col("inside") + F.col("outgoing") + F.col("incoming")
    return s.withColumn("coupling", F.when(whole > 0, F.round(F.col("outgoing") / whole, 6)).otherwise(0.0))


def purity(members: DataFrame) -> DataFrame:
    """``(community, size, top_namespace, purity)``: the most frequent first part of the members' names and its share."""
    m = members.withColumn("ns", F.split(F.regexp_replace("node", "^.*:", ""), r"\.")[0])
    counts = m.groupBy("community", "ns").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("community").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("minus"), "ns")).alias("b"))
    return best.select("community", "size", F.col("b.ns").alias("top_namespace"), F.round(-F.col("b.minus") / F.col("size"), 6).alias("purity"))


def boundary_nodes(edges: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """Nodes whose targets lie in at least ``least`` foreign communities."""
    a = members.select(F.col("node").alias("src"), F.col("community").alias("own"))
    b = members.select(F.col("node").alias("dst"), F.col("community").alias("other"))
    foreign = edges.join(a, "src").join(b, "dst").where("own <> other")
    return foreign.groupBy(F.col("src").alias("node")).agg(F.count_distinct("other").alias("n_foreign")).where(F.col("n_foreign") >= least)


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``(start, node, depth)``: first depth at which each node is reached, up to ``depth`` steps.

    One anti join a step; the frontier is checkpointed, so plans don't grow.
    """
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    pairs = edges.select("src", "dst").distinct()
    for d in range(1, depth + 1):
        step = frontier.join(pairs, frontier["node"] == pairs["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen, ["start", "node"], "left_anti").select("start", "node", F.lit(d).alias("depth")))
        seen = seen.unionByName(frontier)
    return seen


def top_paths(links: DataFrame, nodes: DataFrame, depth: int = 8, least: float = 1e-3, keep: int = 5) -> DataFrame:
    """``(start, path, p, place)``: the ``keep`` most probable simple paths from each of ``nodes(node)`` without an edge to it.

    A path of ``links(src, dst, weight)`` takes an edge with its share of the weight that leaves ``src``.  It ends where no
    edge leaves, after ``depth`` nodes, or with the edge that takes it below ``least``; one that could only return to
    itself is none.  At most 1 / ``least`` paths of a start are longer at a step; the frontier is checkpointed, and each
    step leaves its best ``keep`` ended paths a start.
    """
    whole = links.groupBy("src").agg(F.sum("weight").alias("whole"))
    share = cut_lineage(links.join(whole, "src").select("src", "dst", (F.col("weight") / F.col("whole")).alias("share")))
    best = Window.partitionBy("start").orderBy(F.round("p", 9).desc(), "path")
    first = lambda df: df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)
    starts = nodes.select("node").distinct().join(links.select(F.col("dst").alias("node")), "node", "left_anti")
    frontier = cut_lineage(starts.select(F.col("node").alias("start"), "node", F.array("node").alias("nodes"), F.lit(1.0).alias("p")))
    text = F.array_join("nodes", ">").alias("path")
    ended = []
    for _ in range(1, depth):
        leaf = frontier.join(share.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
        low = frontier.where(F.col("p") < least).join(share.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
        ended.append(first(leaf.unionByName(low).select("start", text, "p")).drop("place"))
        step = frontier.where(F.col("p") >= least).join(share, F.col("node") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
        frontier = cut_lineage(step.select("start", F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), (F.col("p") * F.col("share")).alias("p")))
        if frontier.isEmpty():
            break
    ended.append(first(frontier.select("start", text, "p")).drop("place"))
    found = ended[0]
    for e in ended[1:]:
        found = found.unionByName(e)
    return first(found).select("start", "path", F.round("p", 9).alias("p"), "place")


def _propagate(pdf: pd.DataFrame, most: int = 15) -> dict[str, str]:
    """Asynchronous label propagation in sorted order, a neighbour's vote being 1 / sqrt(its degree)."""
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in zip(pdf["src"], pdf["dst"]):
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label = {n: n for n in near}
    for _ in range(most):
        moved = False
        for n in sorted(near):
            votes: dict[str, float] = defaultdict(float)
            for m in sorted(near[n]):
                votes[label[m]] += 1 / len(near[m]) ** 0.5
            best = min(votes, key=lambda x: (-round(votes[x], 12), x))
            if best != label[n]:
                label[n], moved = best, True
        if not moved:
            break
    return label


def label_communities(edges: DataFrame, scope: str = "scope") -> DataFrame:
    """``(scope, node, community)`` by label propagation, one scope (repo) at a time in its own task.

    The algorithm is sequential by definition; namespace graphs of a repo are small, as names are
    reduced to a fixed depth first.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label = _propagate(pdf)
        return pd.DataFrame({"scope": pdf["scope"].iloc[0], "node": list(label), "community": list(label.values())})

    scoped = edges.where("src is not null and dst is not null").select(F.col(scope).alias("scope"), "src", "dst")
    return scoped.groupBy("scope").applyInPandas(run, "scope string, node string, community string")


def _neighbours(pairs) -> dict[str, set[str]]:
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def _dependence(near: dict[str, set[str]], s: str) -> dict[str, float]:
    """Brandes' share of every node in the shortest paths from ``s``."""
    order, parents, count, dist = [], defaultdict(list), {s: 1.0}, {s: 0}
    queue = deque([s])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                queue.append(w)
            if dist[w] == dist[v] + 1:
                count[w] = count.get(w, 0.0) + count[v]
                parents[w].append(v)
    share: dict[str, float] = defaultdict(float)
    for w in reversed(order):
        for v in parents[w]:
            share[v] += count[v] / count[w] * (1 + share[w])
    share.pop(s, None)
    return share


#: Edges that are sent to every task at most; a graph of more is worked on in one task.
SHARED_EDGES = 2_000_000


def betweenness_of(edges: DataFrame) -> DataFrame:
    """``(node, betweenness)`` of an undirected graph, scaled by 1 / ((n - 1)(n - 2)) for n > 2.

    Brandes' algorithm, dealt out by source node: every task holds the edges, of which up to ``SHARED_EDGES`` are sent, and
    adds up the shares of its sources, which are combined by node.
    """
    u = cut_lineage(undirected(edges))
    nodes = u.select(F.col("a").alias("node")).unionAll(u.select("b")).distinct()
    n = nodes.count()
    scale = float((n - 1) * (n - 2)) if n > 2 else 1.0
    if u.limit(SHARED_EDGES + 1).count() > SHARED_EDGES:
        return u.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: pd.DataFrame([(v, x) for v, x in betweenness(pdf.rename(columns={"a": "src", "b": "dst"})).items()], columns=["node", "betweenness"]), "node string, betweenness double")
    shared = edges.sparkSession.sparkContext.broadcast([(r["a"], r["b"]) for r in u.collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = _neighbours(shared.value)
        total: dict[str, float] = defaultdict(float)
        for b in batches:
            for s in b["node"]:
                total[s] += 0.0
                for v, x in _dependence(near, s).items():
                    total[v] += x
        yield pd.DataFrame(sorted(total.items()), columns=["node", "share"])

    dealt = nodes.repartition(edges.sparkSession.sparkContext.defaultParallelism, "node").mapInPandas(run, "node string, share double")
    return dealt.groupBy("node").agg(F.round(F.sum("share") / scale, 12).alias("betweenness"))


def betweenness(pdf: pd.DataFrame) -> dict[str, float]:
    """Brandes on a small undirected graph in one place, scaled by 1 / ((n - 1)(n - 2)) for n > 2."""
    near = _neighbours(zip(pdf["src"], pdf["dst"]))
    score = dict.fromkeys(near, 0.0)
    for s in list(near):
        for v, x in _dependence(near, s).items():
            score[v] += x
    n = len(near)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else x for v, x in score.items()}


def merge_small(members: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """``members(node, community)`` with communities of fewer than ``least`` nodes merged into the neighbour of most edges in both
    directions (the smallest name on a tie); chains of merges end at the first community that stays, rings at their smallest name."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    links = community_edges(edges, members).where("from_community <> to_community")
    both = links.select(F.col("from_community").alias("community"), F.col("to_community").alias("other"), "n_edges").unionByName(links.select(F.col("to_community").alias("community"), F.col("from_community").alias("other"), "n_edges"))
    weight = both.groupBy("community", "other").agg(F.sum("n_edges").alias("w"))
    best = weight.groupBy("community").agg(F.min(F.struct((-F.col("w")).alias("minus"), "other")).getField("other").alias("best"))
    tree = cut_lineage(sizes.join(best, "community", "left").select("community", F.when((F.col("size") < least) & F.col("best").isNotNull(), F.col("best")).otherwise(F.col("community")).alias("to")))
    tree = tree.withColumn("least", F.least("community", "to"))
    for _ in range(20):
        step = tree.join(tree.select(F.col("community").alias("to"), F.col("to").alias("next"), F.col("least").alias("further")), "to")
        moved = cut_lineage(step.select("community", F.col("next").alias("to"), F.least("least", "further").alias("least"), (F.col("next") != F.col("to")).alias("moved")))
        tree = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    ends = tree.select(F.col("community").alias("to"), F.col("to").alias("end"), F.col("least").alias("ring"))
    final = tree.join(ends, "to").select("community", F.when(F.col("end") == F.col("to"), F.col("to")).otherwise(F.col("ring")).alias("merged"))
    return members.join(final, "community").select("node", F.col("merged").alias("community"))


def components_and_levels(pdf: pd.DataFrame) -> dict[str, tuple[str, int]]:
    """Strongly connected component (by its smallest node) and longest-path level of its condensation."""
    out: dict[str, list[str]] = defaultdict(list)
    back: dict[str, list[str]] = defaultdict(list)
    nodes: set[str] = set()
    for a, b in zip(pdf["src"], pdf["dst"]):
        out[a].append(b)
        back[b].append(a)
        nodes |= {a, b}
    order, seen = [], set()
    for root in sorted(nodes):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(out[root]))]
        while stack:
            v, it = stack[-1]
            nxt = next((w for w in it if w not in seen), None)
            if nxt is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(out[nxt])))
    comp: dict[str, str] = {}
    groups: list[list[str]] = []
    for root in reversed(order):
        if root in comp:
            continue
        group, todo = [], [root]
        comp[root] = root
        while todo:
            v = todo.pop()
            group.append(v)
            for w in back[v]:
                if w not in comp:
                    comp[w] = root
                    todo.append(w)
        name = min(group)
        for v in group:
            comp[v] = name
        groups.append(group)
    level: dict[str, int] = {}
    for group in groups:  # components come in topological order
        name = comp[group[0]]
        level[name] = max((level[comp[w]] + 1 for v in group for w in back[v] if comp[w] != name), default=0)
    return {v: (comp[v], level[comp[v]]) for v in nodes}


def bandwidth_order(pdf: pd.DataFrame) -> list[str]:
    """Nodes in reverse Cuthill-McKee order, so that connected ones lie close together in a matrix."""
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in zip(pdf["src"], pdf["dst"]):
        near[a].add(b)
        near[b].add(a)
    out, seen = [], set()
    for start in sorted(near, key=lambda v: (len(near[v]), v)):
        queue = deque([start] if start not in seen else [])
        seen.add(start)
        while queue:
            v = queue.popleft()
            out.append(v)
            for w in sorted(near[v] - seen, key=lambda x: (len(near[x]), x)):
                seen.add(w)
                queue.append(w)
    return out[::-1]


def lcom4(touches: DataFrame) -> DataFrame:
    """``(class_id, lcom4)``: connected groups of methods that share an attribute, from ``touches(class_id, method, attribute)``.

    The touches of a class come as one row (a class has as many as its text names), so a batch works on many classes.
    """
    def groups(methods, attributes) -> int:
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for m, a in zip(methods, attributes):
            if a is None or pd.isna(a):
                find(("m", m))
            else:
                parent[find(("m", m))] = find(("a", a))
        return len({find(x) for x in list(parent) if x[0] == "m"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"class_id": b["class_id"], "lcom4": [groups(m, a) for m, a in zip(b["methods"], b["attributes"])]})

    kind = dict(touches.dtypes)["class_id"]
    pairs = touches.groupBy("class_id").agg(F.collect_list(F.struct("method", "attribute")).alias("t"))
    return pairs.select("class_id", F.col("t.method").alias("methods"), F.col("t.attribute").alias("attributes")).mapInPandas(run, f"class_id {kind}, lcom4 bigint")
