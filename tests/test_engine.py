"""The engine against plain Python on small graphs, and on hand-made cases."""

import heapq
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from hopweave import catalog
from hopweave.fixtures import trade_graph
from hopweave.operators import bounds, cluster, consistency, cover, distance, index, match, relation, topology
from hopweave.operators.distance import all_distances, closure
from hopweave.plans.graph import LabeledGraph
from hopweave.plans import metrics, storage
from hopweave.plans.pattern import BACKWARD, FORWARD, Pattern


def dijkstra(edges, s):
    out, heap = {}, [(0, s)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in out:
            out[v] = d
            for a, b, w in edges:
                if a == v and b not in out:
                    heapq.heappush(heap, (d + w, b))
    return out


def graph(spark, edges, labels=None, directed=True):
    e = spark.createDataFrame(edges, "src long, dst long, w int")
    return LabeledGraph.of(e, spark.createDataFrame(labels, "vid long, label int") if labels else None, directed)


def random_graph(seed, n=24, m=60):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n), r.randint(1, 3)) for _ in range(m)]
    return edges, [(v, r.randrange(4)) for v in range(n)]


def backtrack(edges, labels, pattern, delta):
    ends = {v for a, b, _ in edges if a != b for v in (a, b)}
    far = {v: dijkstra(edges, v) for v in ends}
    by = {k: [v for v, l in labels if l == k and v in ends] for k in {x for e in pattern for x in e}}
    names = sorted(by)
    return sorted(t for t in product(*(by[k] for k in names)) if all(far[t[names.index(i)]].get(t[names.index(j)], 99) <= delta for i, j in pattern))


@pytest.mark.parametrize("seed,pattern", [(1, [(0, 1), (1, 2)]), (2, [(0, 1), (1, 2), (0, 2)]), (3, [(0, 1), (0, 2), (2, 3), (1, 3)]), (4, [(0, 1), (1, 0)]), (5, [(1, 0), (2, 0), (2, 3)])])
def test_matches_against_backtracking(spark, seed, pattern):
    edges, labels = random_graph(seed)
    g, p = graph(spark, edges, labels), Pattern.of(pattern, 3)
    rel = relation.distance_relation(g, p)
    want = backtrack(edges, labels, pattern, 3)
    got = sorted(map(tuple, match.matches(rel, p).collect()))
    assert got == want
    hub = relation.hub_relation(index.hub_labels(g, 3), g.vertices, p)
    assert sorted(map(tuple, hub.collect())) == sorted(map(tuple, rel.collect()))
    domains, reduced = consistency.path_consistent(rel, p)
    assert sorted(map(tuple, match.matches(reduced, p).collect())) == want
    names = sorted({v for e in pattern for v in e})
    assert {(k, t[names.index(k)]) for t in want for k in names} <= {tuple(x) for x in domains.collect()}


def test_distances(spark):
    edges, _ = random_graph(9)
    real = [e for e in edges if e[0] != e[1]]
    g = graph(spark, edges)
    ends = sorted({v for a, b, _ in real for v in (a, b)})
    want = {(s, v): d for s in ends for v, d in dijkstra(real, s).items()}
    far = {(x.key, x.vid): x.d for x in all_distances(g.vertices.selectExpr("vid AS key", "vid"), g.edges).collect()}
    assert far == want
    near = {(x.src, x.dst): x.d for x in closure(g.vertices, g.edges, 4).collect()}
    assert near == {k: d for k, d in want.items() if d <= 4}
    pruned = {(x.src, x.dst): x.d for x in index.hub_distances(index.pruned_hub_labels(g, 4, 3)).where("d <= 4").collect()}
    assert pruned == near


def test_bounds_hold(spark):
    edges, labels = random_graph(12, 30, 55)
    for directed in (True, False):
        g = graph(spark, edges, labels, directed)
        v = index.vectors(g, index.embedding(g, index.reference_sets(g, 2), 3), 4, 3)
        vec = {x.vid: x.v for x in v.collect()}
        real = [tuple(x) for x in g.edges.collect()]
        for s in list(vec)[:8]:
            for t, d in dijkstra(real, s).items():
                assert max(a - b for a, b in zip(vec[s], vec[t])) <= d
                assert directed or max(abs(a - b) for a, b in zip(vec[s], vec[t])) <= d
        p = Pattern.of([(0, 1), (1, 2)], 2)
        near = bounds.verified(bounds.band_pairs(v, p, directed), closure(g.vertices, g.edges, 2), 2)
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, relation.distance_relation(g, p).collect()))
        if not directed:
            m = cluster.k_medoids(v, 3, 2)
            joined = cluster.cluster_join(m, v, p)
            assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, bounds.band_pairs(v, p).collect()))
            inside = {tuple(x) for x in bounds.area_pruned(v, p).collect()}
            assert {(0, x.x) for x in relation.distance_relation(g, Pattern.of([(0, 1)], 2)).collect() if (1, x.y) in inside} <= inside


def test_two_roots_star_and_branch(spark):
    rows = [(0, 1, 1, 10), (0, 1, 2, 20), (1, 2, 10, 100), (1, 2, 20, 200), (1, 3, 10, 7)]
    rel = spark.createDataFrame(rows, "i int, j int, x long, y long")
    count = lambda edges: match.match_count(rel, Pattern.of(edges, 1)).first()[0]
    assert count([(0, 1), (1, 2)]) == 2 and count([(0, 1), (1, 2), (1, 3)]) == 1 and count([(0, 1)]) == 2


def test_asymmetric_distances(spark):
    g = graph(spark, [(1, 2, 1), (2, 1, 3), (2, 3, 1)], [(1, 0), (2, 1), (3, 1)])
    assert {(x.x, x.y) for x in relation.distance_relation(g, Pattern.of([(0, 1)], 1)).collect()} == {(1, 2)}
    assert relation.distance_relation(g, Pattern.of([(1, 0)], 2)).collect() == []


def test_graph_rules(spark):
    e = spark.createDataFrame([(1, 2, None), (2, 2, 5), (3, 4, 2)], "src long, dst long, w int")
    g = LabeledGraph.of(e, spark.createDataFrame([(1, 7), (9, 3)], "vid long, label int"), directed=False)
    assert {tuple(x) for x in g.edges.collect()} == {(1, 2, 1), (2, 1, 1), (3, 4, 2), (4, 3, 2)}
    assert {tuple(x) for x in g.vertices.select("vid", "label").collect()} == {(1, 7), (2, 0), (3, 0), (4, 0)}


def test_pattern_files():
    assert Pattern.from_label_pairs(["# x", "42,35,1", "", "35,1,2"], 2).types == (FORWARD, BACKWARD)
    one = Pattern.from_label_pairs(["0,1", "1,2", "0,2", "* end", "5,6"], 2)
    assert one.edges == ((0, 1), (1, 2), (0, 2)) and one.types == (FORWARD, FORWARD, BACKWARD)
    assert Pattern.from_indexed_edges(["0,3,1,4", "7,8"], 1).edges == ((3, 4),)
    assert Pattern.of([(0, 1)], 1).types == (FORWARD,) and one.shared((0, 1), (1, 2)) == (1, 0)
    with pytest.raises(ValueError):
        Pattern.of([(0, 1)], -1)


def test_path_consistency_is_stronger(spark):
    # 1-10-100 and 2-20-200 close a triangle only if ends agree: (1, 200) and (2, 100) do not
    rows = [(0, 1, 1, 10), (0, 1, 2, 20), (1, 2, 10, 100), (1, 2, 20, 200), (0, 2, 1, 200), (0, 2, 2, 100)]
    rel, p = spark.createDataFrame(rows, "i int, j int, x long, y long"), Pattern.of([(0, 1), (1, 2), (0, 2)], 1)
    assert consistency.arc_consistent(rel, p)[0].count() == 6 and consistency.path_consistent(rel, p)[0].count() == 0


def test_path_consistency_by_either_way_drops_less(spark):
    # 0 and 1 are joined both ways; 100 fits 1 by one edge and 10 by one of two
    rows = [(0, 1, 1, 10), (0, 1, 2, 20), (1, 0, 10, 1), (1, 0, 20, 2), (0, 2, 1, 100), (0, 2, 2, 100), (2, 0, 100, 2), (1, 2, 10, 100), (1, 2, 20, 100), (2, 0, 101, 1), (0, 2, 2, 101), (1, 2, 20, 101), (1, 2, 10, 101)]
    rel, p = spark.createDataFrame(rows, "i int, j int, x long, y long"), Pattern.of([(0, 1), (1, 0), (0, 2), (2, 0), (1, 2)], 1)
    strict, loose = ({tuple(x) for x in consistency.path_consistent(rel, p, way)[1].collect()} for way in (False, True))
    assert strict == {(0, 1, 2, 20), (1, 0, 20, 2), (0, 2, 2, 100), (2, 0, 100, 2), (1, 2, 20, 100)} and strict < loose


def test_components_and_levels(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (6, 6), (5, 7), (8, 9), (9, 8)], "src long, dst long")
    got = {x.vid: x.comp for x in topology.strong_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 8: 8, 9: 8}
    dag = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    assert {x.vid: x.level for x in topology.topological_levels(dag).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    with pytest.raises(ValueError):
        topology.topological_levels(e)
    assert topology.reachability(dag).count() == 6


def longest(edges):
    into, out = {}, {}
    for a, b, _ in edges:
        into.setdefault(b, set()).add(a)
    for v in sorted({v for a, b, _ in edges for v in (a, b)}):  # ids go up along edges
        out[v] = max((out[u] + 1 for u in into.get(v, ())), default=0)
    return out


def test_deep_graphs_take_few_rounds(spark, monkeypatch):
    r = random.Random(3)
    # chains of 70, with some trees and joints between them
    edges = [(c * 70 + k, c * 70 + k + 1, r.randint(1, 3)) for c in range(3) for k in range(69)]
    edges += [(20, 75, 2), (30, 150, 1), (100, 180, 5), (10, 300, 1), (10, 301, 1), (300, 302, 2)]
    g = graph(spark, edges).stored()
    written = []
    for module in (distance, topology):
        monkeypatch.setattr(module, "kept", lambda df, name, *by: written.append(name) or storage.kept(df, name, *by))
    seeds = [(0, 0), (70, 70), (70, 40), (5, 160)]
    got = {(x.key, x.vid): x.d for x in all_distances(spark.createDataFrame(seeds, "key long, vid long"), g.edges).collect()}
    want = {}
    for key, s in seeds:
        for v, d in dijkstra(edges, s).items():
            want[key, v] = min(d, want.get((key, v), d))
    assert got == want
    assert {x.vid: x.level for x in topology.topological_levels(g.edges).collect()} == longest(edges)
    assert len(written) < 60
    for loop in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 4), (4, 1)], [(1, 1)], [(0, 1), (1, 2), (2, 1)]):
        with pytest.raises(ValueError):
            topology.topological_levels(spark.createDataFrame(loop, "src long, dst long"))
    cycle = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 4, 1), (4, 5, 1), (5, 3, 1)], "src long, dst long, w int")
    assert sorted(map(tuple, all_distances(spark.createDataFrame([(9, 1), (9, 7)], "key long, vid long"), cycle).collect())) == [(9, 1, 0), (9, 2, 1), (9, 7, 0)]


def reached(edges, start):
    out, todo = {start}, [start]
    while todo:
        for v in edges.get(todo.pop(), ()):
            if v not in out:
                out.add(v)
                todo.append(v)
    return out


def test_reachability_of_chains_cycles_and_joints(spark):
    r = random.Random(31)
    chain = [(k, k + 1) for k in range(40)]
    cases = [
        chain,
        chain + [(20, 50), (50, 51), (51, 52), (52, 30), (60, 0), (61, 0)],  # joints in the middle, two ways in
        [(1, 2), (2, 3), (3, 1)] + [(k, k + 1) for k in range(10, 30)] + [(30, 10)] + [(7, 7)],  # closed chains only
        chain + [(40, 0), (70, 5), (8, 71), (71, 72), (72, 72), (73, 73), (73, 74)],  # a cycle with joints, loops
        [(r.randrange(30), r.randrange(30)) for _ in range(28)],
        [(r.randrange(60), r.randrange(60)) for _ in range(50)] + [(r.randrange(60), 100 + r.randrange(3)) for _ in range(9)],
    ]
    for case in cases:
        to = {}
        for a, b in case:
            to.setdefault(a, []).append(b)
        want = sorted({(a, v) for a in to for b in to[a] for v in reached(to, b)})
        assert sorted(map(tuple, topology.reachability(spark.createDataFrame(case, "src long, dst long"), 7).collect())) == want
    assert topology.reachability(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_reachability_writes_no_pairs_of_a_chain(spark, monkeypatch):
    rows = []
    for name in ("kept", "kept_in_buckets"):
        real = getattr(storage, name)
        monkeypatch.setattr(topology, name, lambda df, name, *by, real=real: (out := real(df, name, *by), rows.append(out[0].count()))[0], raising=False)
    edges = spark.createDataFrame([(c * 100 + k, c * 100 + k + 1) for c in range(4) for k in range(60)], "src long, dst long")
    assert topology.reachability(edges).count() == 4 * 61 * 60 // 2 and max(rows) <= 4 * 61


def plain_medoids(vec, k):
    """As cluster.k_medoids without rounds: vec is {label: {vid: vector}}."""
    scatter = lambda v, salt: ((v + 1) * 2654435761 + salt * 40503) % 1000003
    far = lambda a, b: max(abs(x - y) for x, y in zip(a, b))

    def members(own, med):
        return {v: min((far(x, own[c]), c) for c in med) for v, x in own.items()}

    med = {m: sorted(own, key=lambda v: (scatter(v, 0), v))[:k] for m, own in vec.items()}
    got = {m: members(own, med[m]) for m, own in vec.items()}
    r = idle = 0
    while idle < k:
        r, idle, swaps = r + 1, idle + 1, {}
        for m, own in vec.items():
            out, rest = sorted(med[m])[(r - 1) % len(med[m])], [v for v in own if v not in med[m]]
            if rest:
                swaps[m] = [min(rest, key=lambda v: (scatter(v, r), v)) if c == out else c for c in med[m]]
        for m, trial in swaps.items():
            new = members(vec[m], trial)
            if sum(d for d, _ in new.values()) < sum(d for d, _ in got[m].values()):
                med[m], got[m], idle = trial, new, 0
    return {(m, c, v, d) for m in vec for v, (d, c) in got[m].items()}


def test_medoids_are_swapped_until_none_gains(spark):
    edges, labels = random_graph(21, 40, 90)
    g = graph(spark, edges, labels, False)
    v = index.vectors(g, index.embedding(g, index.reference_sets(g, 2), 3), 4, 3)
    vec = {}
    for x in v.collect():
        vec.setdefault(x.label, {})[x.vid] = x.v
    assert {tuple(x) for x in cluster.k_medoids(v, 3).collect()} == plain_medoids(vec, 3)


def test_reference_sets_follow_the_size(spark):
    edges, labels = random_graph(22, 40, 90)
    g = graph(spark, edges, labels)
    vids = sorted(x.vid for x in g.vertices.collect())
    scales = index.scales_of(len(vids))
    want = {(k, v) for k in range(scales * scales) for v in sorted(vids, key=lambda v: (((v + 1) * 2654435761 + k * 40503) % 1000003, v))[: 2 << (k // scales)]}
    assert scales == 4 and {tuple(x) for x in index.reference_sets(g).collect()} == want
    big = spark.range(5000).selectExpr("id AS src", "id + 1 AS dst")
    sizes = {x.dim: x["count"] for x in index.reference_sets(LabeledGraph.of(big)).groupBy("dim").count().collect()}
    assert sizes == {k: 2 << (k // 11) for k in range(121)}


def test_guided_search_finds_the_same(spark):
    edges, labels = random_graph(23, 30, 80)
    for directed in (True, False):
        g = graph(spark, edges, labels, directed)
        v = index.vectors(g, index.embedding(g, index.reference_sets(g, 2), 4), 4, 4)
        pairs = g.vertices.selectExpr("vid AS src").crossJoin(g.vertices.selectExpr("vid AS dst"))
        got = {tuple(x) for x in distance.guided_distances(pairs, g.edges, v, 5, directed).collect()}
        assert got == {tuple(x) for x in closure(g.vertices, g.edges, 5).collect()}


def test_guided_search_is_shared_by_the_targets_of_a_source(spark, monkeypatch):
    # sources 0 to 9 - hub 100 - targets 200 to 239, each with an edge to a vertex of its own that no pair asks for
    edges = [(s, 100, 1) for s in range(10)] + [(100, t, 2) for t in range(200, 240)] + [(t, t + 100, 1) for t in range(200, 240)]
    g = graph(spark, edges)
    v = g.vertices.select("vid", F.array(F.lit(0), F.lit(0)).alias("v"))
    sources, targets = g.vertices.where("vid < 100").select("vid"), g.vertices.where("vid BETWEEN 200 AND 239").select("vid")
    pairs = sources.selectExpr("vid AS src").crossJoin(targets.selectExpr("vid AS dst"))
    rows = []
    for name in ("kept", "kept_in_buckets"):
        real = getattr(storage, name)
        monkeypatch.setattr(distance, name, lambda df, name, *by, real=real: (out := real(df, name, *by), name == "guided" and rows.append(out[0].count()))[0])
    want = {(s, t, 3) for s in range(10) for t in range(200, 240)}
    assert {tuple(x) for x in distance.guided_distances(pairs, g.edges, v, 4).collect()} == want
    assert {tuple(x) for x in distance.guided_to_group(sources, targets, g.edges, v, 4).collect()} == want
    assert {tuple(x) for x in distance.guided_to_group(sources, g.vertices.where("vid >= 200"), g.edges, v, 3).collect()} == want
    assert max(rows) == 10 + 10 + 400


@pytest.mark.parametrize("seed,m,directed", [(26, 34, True), (27, 26, False)])
def test_guided_search_by_roots_against_dijkstra(spark, seed, m, directed):
    # sparse, so that many vertices hang from roots, and behind cycles; 100 and others are no ends of an edge
    edges, labels = random_graph(seed, 30, m)
    edges += [(v, v + 1, 1) for v in range(40, 46)] + [(46, 40, 1), (50, 51, 2), (51, 52, 1), (52, 50, 1)]
    g = graph(spark, edges, labels, directed)
    v = index.vectors(g, index.embedding(g, index.reference_sets(g, 2), 5), 4, 5)
    pick = lambda vids: spark.createDataFrame([(x,) for x in vids], "vid long")
    sources, targets = [*range(0, 30, 2), 42, 44, 100], [*range(0, 30, 3), 41, 42, 46, 51, 100]
    v = v.select("vid", "v").unionByName(spark.range(101).select(F.col("id").alias("vid"), F.array(*[F.lit(6)] * 4).alias("v")).join(v, "vid", "left_anti"))
    both = edges if directed else edges + [(b, a, w) for a, b, w in edges]
    far = {s: dijkstra(both, s) for s in sources}
    for limit in (0, 5):
        got = sorted(map(tuple, distance.guided_by_roots(pick(sources), pick(targets), g.edges, v, limit, directed).collect()))
        assert got == sorted((s, t, far[s][t]) for s in sources for t in targets if far[s].get(t, 99) <= limit)


def test_useful_part_keeps_distances_between_its_labels(spark):
    edges, labels = random_graph(28, 30, 80)
    g = graph(spark, edges, labels)
    label = dict(labels)
    part = relation.LabelWays(g).part([(3, 0), (3, 1), (2, 2)], 4)
    assert {tuple(x) for x in part.vertices.collect()} <= {tuple(x) for x in g.vertices.collect()}
    near, whole = ({tuple(x) for x in closure(h.vertices, h.edges, 4).collect()} for h in (part, g))
    wanted = lambda pairs: {(a, b, d) for a, b, d in pairs if a != b and (label[a], label[b]) in {(3, 0), (3, 1), (2, 2)}}
    assert wanted(near) == wanted(whole)


def test_guided_distances_writes_no_pairs(spark, monkeypatch):
    rows = []
    for module, name in ((catalog, "kept"), (index, "kept"), (relation, "kept"), (distance, "kept"), (distance, "kept_in_buckets")):
        real = getattr(storage, name)
        monkeypatch.setattr(module, name, lambda df, name, *by, real=real: (out := real(df, name, *by), rows.append(out[0].count()))[0])
    got = catalog.QUERIES["guided_distances"](spark, "/root/testdata/sf0.01")
    # 100 suppliers and 1,500 customers, each with an edge, and the embedding of the graph of those, in 4 dimensions at most
    assert got.count() == got.select("src", "dst").distinct().count() == 6049 and max(rows) < 1.1 * 1600


@pytest.mark.parametrize("seed,pattern,delta", [(2, [(0, 1), (1, 2), (0, 2)], 3), (6, [(3, 1), (1, 0), (3, 0)], 5), (7, [(0, 1), (1, 2), (2, 3), (0, 2), (0, 3)], 4), (8, [(0, 1), (1, 0), (1, 2)], 3)])
def test_searched_matches_against_backtracking(spark, seed, pattern, delta, monkeypatch):
    edges, labels = random_graph(seed)
    real = match._dealt
    monkeypatch.setattr(match, "_dealt", lambda left, right, key: real(left, right, key, 3))
    for g in (graph(spark, edges, labels), graph(spark, edges, labels).stored()):
        assert sorted(map(tuple, match.searched_matches(g, Pattern.of(pattern, delta)).collect())) == backtrack(edges, labels, pattern, delta)


def test_searched_matches_list_no_pairs_that_two_legs_prove(spark, monkeypatch):
    edges = [(s, 100, 1) for s in range(40)] + [(100, t, 2) for t in range(200, 240)] + [(t, t + 100, 1) for t in range(200, 240)]
    labels = [(v, 3) for v in range(40)] + [(100, 4)] + [(v, 0) for v in range(200, 240)] + [(v, 1) for v in range(300, 340)]
    rows = []
    for module, name in ((match, "kept"), (relation, "kept"), (distance, "kept"), (distance, "kept_in_buckets")):
        real = getattr(storage, name)
        monkeypatch.setattr(module, name, lambda df, name, *by, real=real: (out := real(df, name, *by), rows.append(out[0].count()))[0])
    got = sorted(map(tuple, match.searched_matches(graph(spark, edges, labels), Pattern.of([(3, 4), (4, 0), (3, 0)], 3)).collect()))
    assert got == [(t, s, 100) for t in range(200, 240) for s in range(40)] and max(rows) <= 2 * 41


def test_covers_and_their_labels(spark):
    edges, labels = random_graph(24, 14, 26)
    g = graph(spark, edges, labels).stored()
    hubs = {x.vid for x in cover.cover_hubs(g.edges).collect()}
    left = [(a, b) for a, b, _ in edges if a != b and a not in hubs and b not in hubs]
    to = {}
    for a, b in left:
        to.setdefault(a, []).append(b)
    assert hubs and not any(a in reached(to, b) for a, b in left)
    order = cover.cover_order(g)
    assert order.count() == g.vertices.count() == order.select("vid").distinct().count()
    pruned = index.pruned_hub_labels(g, 4, 3, order)
    near = {tuple(x) for x in closure(g.vertices, g.edges, 4).collect()}
    assert {tuple(x) for x in index.hub_distances(pruned).where("d <= 4").collect()} == near
    assert pruned.count() < 2 * len(near)
    triangle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1)], "src long, dst long")
    assert sorted(x.cycle for x in cover.short_cycles(triangle, 3).collect()) == [[1, 2], [1, 2, 3]]
    chain = spark.createDataFrame([(k, k + 1) for k in range(8)], "src long, dst long")
    assert {x.vid: x.bit for x in cover.bisection_places(chain).collect()} == {0: 0, 1: 1, 2: 0, 3: 2, 4: 0, 5: 1, 6: 0, 7: 3}


def test_distances_with_heavy_edges_take_few_rounds(spark, monkeypatch):
    r = random.Random(25)
    edges = [(r.randrange(40), r.randrange(40), r.randint(40, 90)) for _ in range(160)]
    written = []
    monkeypatch.setattr(distance, "kept_in_buckets", lambda df, name, *by: written.append(name) or storage.kept_in_buckets(df, name, *by))
    g = graph(spark, edges).stored()
    got = {(x.src, x.dst): x.d for x in closure(g.vertices, g.edges, 300, True).collect()}
    real = [e for e in edges if e[0] != e[1]]
    ends = sorted({v for a, b, _ in real for v in (a, b)})
    assert got == {(s, v): d for s in ends for v, d in dijkstra(real, s).items() if d <= 300} and len(written) <= 9


def test_run_metrics(spark):
    run = metrics.Run(spark)
    with run.stage("index"):
        pass
    assert run.counted("rows", spark.range(7)).count() == 7
    assert [(x.stage, x.rows) for x in run.table().collect()] == [("index", None), ("rows", 7)] and all(x.seconds >= 0 for x in run.table().collect())


def test_storage_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": lambda *_: None})()

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


def test_components_of_the_whole_trade_graph(spark):
    sf = "/root/testdata/sf0.001"
    to, back = {}, {}
    for x in trade_graph(spark, sf).edges.collect():
        to.setdefault(x.src, []).append(x.dst)
        back.setdefault(x.dst, []).append(x.src)
    want, seen = {}, set()
    for v in sorted(to):
        if v not in seen:
            both = reached(to, v) & reached(back, v)
            seen |= both
            want |= {u: min(both) for u in both if len(both) > 1}
    got = {x.vid: x.comp for x in catalog.QUERIES["scc_components"](spark, sf).collect()}
    assert got == want and {v % 8 for v in got} == {0, 1, 2, 3, 4}
