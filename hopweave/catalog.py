"""Queries over the two graphs, one or more for each family of operators, and the same in plain SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import EV, EV_LABELS, TR, events_graph, trade_graph
from .functions.scalars import linf, one_sided
from .operators import bounds, cluster, consistency, index, match, relation, topology
from .operators.cover import cover_order
from .operators.distance import all_distances, bounded_distances, closure, guided_by_roots, parents
from .plans.graph import group_sizes_of
from .plans.pattern import Pattern
from .plans.storage import kept, shared_dir
from .sources import sinks, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


PATH3, PATH4 = [(0, 1), (1, 3)], [(0, 1), (1, 2), (2, 3)]
EV_TRIANGLE, TR_TRIANGLE, CYCLE = [(0, 1), (1, 3), (0, 3)], [(0, 1), (1, 2), (0, 2)], [(3, 4), (4, 0), (3, 0)]
STAR, BRANCH, NEAR = [(0, 1), (0, 3)], [(0, 1), (1, 3), (1, 4)], [(3, 4), (4, 0)]
CUT, SCALES, SETS = 4, 2, 4


# --- SQL by parts ---
def near_sql(name: str, seeds: str, edges: str, limit: int) -> str:
    """name(key, vid, d) by a recursive query from seeds(key, vid)."""
    return f"""r_{name}(key, vid, d) AS (
  SELECT key, vid, 0 FROM ({seeds}) UNION SELECT r.key, e.dst, r.d + e.w FROM r_{name} r JOIN {edges} e ON r.vid = e.src WHERE r.d + e.w <= {limit}),
{name} AS MATERIALIZED (SELECT key, vid, CAST(min(d) AS INTEGER) AS d FROM r_{name} GROUP BY 1, 2)"""


def relation_sql(graph: str, edges: list[tuple[int, int]], delta: int, name: str = "rel") -> str:
    starts = ", ".join(str(i) for i in sorted({i for i, _ in edges}))
    pairs = ", ".join(f"({i}, {j})" for i, j in edges)
    seeds = f"SELECT vid AS key, vid FROM {graph}_v WHERE label IN ({starts})"
    return near_sql(f"{name}_c", seeds, f"{graph}_e", delta) + f""",
{name} AS MATERIALIZED (
  SELECT a.label AS i, b.label AS j, c.key AS x, c.vid AS y FROM {name}_c c JOIN {graph}_v a ON a.vid = c.key JOIN {graph}_v b ON b.vid = c.vid
  WHERE (a.label, b.label) IN ({pairs}))"""


def match_sql(edges: list[tuple[int, int]], rel: str = "rel") -> str:
    """A SELECT of all matches, as columns a<label>: one join after another, each with the pairs of its edge only."""
    text, columns = "", {}
    for k, (i, j) in enumerate(edges):
        on = [f"{columns[v]} = r{k}.{c}" for v, c in ((i, "x"), (j, "y")) if v in columns]
        pairs = f"(SELECT x, y FROM {rel} WHERE i = {i} AND j = {j}) r{k}"
        text += f" JOIN {pairs} ON " + " AND ".join(on) if text else pairs
        columns = {i: f"r{k}.x", j: f"r{k}.y"} | columns
    return "SELECT " + ", ".join(f"{c} AS a{v}" for v, c in sorted(columns.items())) + f" FROM {text}"


def arc_sql(edges: list[tuple[int, int]], rounds: int, rel: str = "rel", name: str = "ac") -> str:
    """name(i, j, x, y) and name_d(label, vid): so many rounds of dropping what has no partner."""
    labels = sorted({v for e in edges for v in e})
    need = " ".join(f"WHEN {v} THEN {sum((i == v) + (j == v) for i, j in edges)}" for v in labels)
    parts, last = [], rel
    for n in range(rounds + 1):
        dom = f"{name}_d" if n == rounds else f"{name}_d{n}"
        parts.append(f"""{dom} AS MATERIALIZED (
  SELECT label, vid FROM (SELECT DISTINCT i AS label, x AS vid, 0 AS way, j AS other FROM {last} UNION SELECT DISTINCT j, y, 1, i FROM {last})
  GROUP BY label, vid HAVING count(*) = CASE label {need} END)""")
        new = name if n == rounds else f"{name}_r{n}"
        parts.append(f"{new} AS MATERIALIZED (SELECT r.* FROM {last} r JOIN {dom} a ON a.label = r.i AND a.vid = r.x JOIN {dom} b ON b.label = r.j AND b.vid = r.y)")
        last = new
    return ",\n".join(parts)


def with_sql(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


# --- graphs ---
for _g, _of, _ctes in (("ev", events_graph, EV), ("tr", trade_graph, TR)):
    query(f"graph_vertices_{_g}", with_sql(_ctes, select=f"SELECT vid, label FROM {_g}_v"))(lambda s, d, of=_of: of(s, d).vertices.select("vid", "label"))
    query(f"graph_edges_{_g}", with_sql(_ctes, select=f"SELECT src, dst, w FROM {_g}_e WHERE src <> dst"))(lambda s, d, of=_of: of(s, d).edges)
    query(f"label_group_sizes_{_g}", with_sql(_ctes, select=f"SELECT label, count(*) AS vertices FROM {_g}_v GROUP BY label"))(lambda s, d, of=_of: of(s, d).group_sizes())


    query(f"label_count_{_g}", with_sql(_ctes, select=f"SELECT count(DISTINCT label) AS labels FROM {_g}_v"))(lambda s, d, of=_of: of(s, d).label_count())


@query("label_group_sizes_all", f"SELECT label, count(DISTINCT vid) AS vertices FROM ({EV_LABELS.format(events='events')}) GROUP BY label")
def _(spark, sf):
    return group_sizes_of(spark.sql(EV_LABELS, events=spark.read.parquet(f"{sf}/events.parquet")))


@query("graph_undirected", with_sql(TR, select="SELECT src, dst, w FROM tr_u"))
def _(spark, sf):
    return trade_graph(spark, sf).undirected().edges


@query("graph_without_vertices", with_sql(TR, select="SELECT src, dst, w FROM tr_e WHERE src % 8 <> 4 AND dst % 8 <> 4"))
def _(spark, sf):
    g = trade_graph(spark, sf)
    return g.without(g.labeled(4, 4).select("vid")).edges


@query("graph_restricted", with_sql(EV, select="SELECT src, dst, w FROM ev_e WHERE src IN (SELECT vid FROM ev_v WHERE label <= 2) AND dst IN (SELECT vid FROM ev_v WHERE label <= 2)"))
def _(spark, sf):
    g = events_graph(spark, sf)
    return g.restrict(g.labeled(0, 2).select("vid")).edges


# --- distances and hub labels ---
_ALL_EV = "SELECT vid AS key, vid FROM ev_v"


@query("hub_labels_out", with_sql(EV, near_sql("c", _ALL_EV, "ev_e", CUT), select="SELECT key AS vid, 0 AS dir, vid AS hub, d FROM c"))
def _(spark, sf):
    return index.hub_labels(events_graph(spark, sf), CUT).where(F.col("dir") == index.OUT)


@query("hub_labels_in", with_sql(EV, near_sql("c", _ALL_EV, "ev_e", CUT), select="SELECT vid, 1 AS dir, key AS hub, d FROM c"))
def _(spark, sf):
    return index.hub_labels(events_graph(spark, sf), CUT).where(F.col("dir") == index.IN)


@query("hub_labels_by_label", with_sql(EV, near_sql("c", _ALL_EV, "ev_e", 3), select="SELECT key AS vid, 0 AS dir, vid AS hub, d FROM c WHERE key IN (SELECT vid FROM ev_v WHERE label BETWEEN 1 AND 2) UNION ALL SELECT vid, 1, key, d FROM c WHERE vid IN (SELECT vid FROM ev_v WHERE label BETWEEN 1 AND 2)"))
def _(spark, sf):
    return index.hub_labels(events_graph(spark, sf), 3, (1, 2))


@query("hub_pair_distance", with_sql(EV, near_sql("c", _ALL_EV, "ev_e", 2), select="SELECT a.key AS src, b.vid AS dst, CAST(min(a.d + b.d) AS INTEGER) AS d FROM c a JOIN c b ON a.vid = b.key GROUP BY 1, 2"))
def _(spark, sf):
    return index.hub_distances(index.hub_labels(events_graph(spark, sf), 2))


@query("pruned_hub_distances", with_sql(EV, near_sql("c", _ALL_EV, "ev_e", 3), select="SELECT key AS src, vid AS dst, d FROM c"))
def _(spark, sf):
    return index.hub_distances(index.pruned_hub_labels(events_graph(spark, sf), 3)).where("d <= 3")


@query("cover_hub_distances", with_sql(EV, near_sql("c", _ALL_EV, "ev_e", 3), select="SELECT key AS src, vid AS dst, d FROM c"))
def _(spark, sf):
    g = events_graph(spark, sf).stored()
    return index.hub_distances(index.pruned_hub_labels(g, 3, order=cover_order(g))).where("d <= 3")


@query("hub_list_length", with_sql(EV, near_sql("c", _ALL_EV, "ev_e", CUT), select="SELECT dir, count(*) AS vertices, CAST(sum(n) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS average FROM (SELECT 0 AS dir, key AS vid, count(*) AS n FROM c GROUP BY key UNION ALL SELECT 1, vid, count(*) FROM c GROUP BY vid) GROUP BY dir"))
def _(spark, sf):
    return index.average_list_length(index.hub_labels(events_graph(spark, sf), CUT))


@query("shortest_path_parents", with_sql(TR, near_sql("c", "SELECT vid AS key, vid FROM tr_v WHERE label = 4", "tr_e", 5), select="SELECT a.key, a.vid, min(e.src) AS parent, a.d FROM c a LEFT JOIN (c b JOIN tr_e e ON e.src = b.vid) ON b.key = a.key AND e.dst = a.vid AND b.d + e.w = a.d GROUP BY a.key, a.vid, a.d"))
def _(spark, sf):
    g = trade_graph(spark, sf)
    near, _ = kept(bounded_distances(g.labeled(4, 4).select(F.col("vid").alias("key"), "vid"), g.edges, 5), "near")
    return parents(near, g.edges)


#: From a nation everything is within 12: 2 to a customer, 1 to an order, at most 7 and 3 to a part and a supplier, less by other ways.
@query("unbounded_distances", with_sql(TR, near_sql("c", "SELECT vid AS key, vid FROM tr_v WHERE label = 4", "tr_e", 12), select="SELECT key, vid, d FROM c"))
def _(spark, sf):
    g = trade_graph(spark, sf)
    return all_distances(g.labeled(4, 4).select(F.col("vid").alias("key"), "vid"), g.edges)


#: Each user's events are a chain, so the distance from its first event is a running sum.
_EV_CHAIN = "ch AS (SELECT event_id AS vid, first_value(event_id) OVER u AS key, row_number() OVER u - 1 AS level, coalesce(sum(1 + event_id % 2) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query("unbounded_distances_events", with_sql(_EV_CHAIN, select="SELECT key, vid, CAST(d AS INTEGER) AS d FROM ch WHERE n > 1"))
def _(spark, sf):
    g = events_graph(spark, sf).stored()
    first = g.vertices.join(g.edges.selectExpr("dst AS vid"), "vid", "left_anti")
    return all_distances(first.select(F.col("vid").alias("key"), "vid"), g.edges)


# --- relations ---
@query("distance_relation", with_sql(TR, relation_sql("tr", TR_TRIANGLE, 3), select="SELECT i, j, x, y FROM rel"))
def _(spark, sf):
    return relation.distance_relation(trade_graph(spark, sf), Pattern.of(TR_TRIANGLE, 3))


@query("hub_relation", with_sql(EV, relation_sql("ev", EV_TRIANGLE, 3), select="SELECT i, j, x, y FROM rel"))
def _(spark, sf):
    g = events_graph(spark, sf)
    return relation.hub_relation(index.hub_labels(g, 3), g.vertices, Pattern.of(EV_TRIANGLE, 3))


@query("relation_sizes", with_sql(TR, relation_sql("tr", TR_TRIANGLE, 3), select="SELECT i, j, count(*) AS pairs FROM rel GROUP BY GROUPING SETS ((i, j), ())"))
def _(spark, sf):
    return relation.relation_sizes(relation.distance_relation(trade_graph(spark, sf), Pattern.of(TR_TRIANGLE, 3)))


@query("relation_composition", with_sql(EV, relation_sql("ev", PATH3, 3), select="SELECT i, j, x, y FROM rel UNION ALL SELECT DISTINCT 0, 3, a.x, b.y FROM rel a JOIN rel b ON a.i = 0 AND b.i = 1 AND a.y = b.x"))
def _(spark, sf):
    p = Pattern.of(PATH3, 3)
    return relation.completed(relation.distance_relation(events_graph(spark, sf), p), Pattern.of(PATH3, 3))


# --- matches ---
def _matches(name: str, graph: str, edges: list[tuple[int, int]], delta: int, searched: bool = False) -> None:
    of, ctes = (events_graph, EV) if graph == "ev" else (trade_graph, TR)

    def run(spark, sf):
        p = Pattern.of(edges, delta)
        return match.searched_matches(of(spark, sf), p) if searched else match.matches(relation.distance_relation(of(spark, sf), p), p)

    query(name, with_sql(ctes, relation_sql(graph, edges, delta), select=match_sql(edges)))(run)


_matches("match_path3", "ev", PATH3, 2)
_matches("match_path3_trade", "tr", [(0, 1), (1, 2)], 3)
_matches("match_path4", "tr", PATH4, 1)
_matches("match_triangle", "ev", EV_TRIANGLE, 3)
_matches("match_triangle_trade", "tr", TR_TRIANGLE, 3)
_matches("match_cycle_trade", "tr", CYCLE, 3, searched=True)
_matches("match_star", "ev", STAR, 3)
_matches("match_branch", "ev", BRANCH, 3)


@query("match_by_size", with_sql(TR, relation_sql("tr", TR_TRIANGLE, 3), select=match_sql(TR_TRIANGLE)))
def _(spark, sf):
    p = Pattern.of(TR_TRIANGLE, 3)
    rel = relation.distance_relation(trade_graph(spark, sf), p)
    sizes = {(r["i"], r["j"]): r["pairs"] for r in relation.relation_sizes(rel).where("i IS NOT NULL").collect()}  # one row for each edge
    return match.matches(rel, p, sizes)


@query("match_count", with_sql(TR, relation_sql("tr", TR_TRIANGLE, 3), select=f"SELECT count(*) AS matches FROM ({match_sql(TR_TRIANGLE)})"))
def _(spark, sf):
    p = Pattern.of(TR_TRIANGLE, 3)
    return match.match_count(relation.distance_relation(trade_graph(spark, sf), p), p)


@query("match_after_pruning", with_sql(TR, relation_sql("tr", TR_TRIANGLE, 3), select=match_sql(TR_TRIANGLE)))
def _(spark, sf):
    p = Pattern.of(TR_TRIANGLE, 3)
    _, rel = consistency.path_consistent(relation.distance_relation(trade_graph(spark, sf), p), p)
    return match.matches(rel, p)


@query("support_reach_count", with_sql(EV, relation_sql("ev", PATH3, 3), "reach(s, v) AS (SELECT DISTINCT x, x FROM rel WHERE i = 0 UNION SELECT r.s, p.y FROM reach r JOIN rel p ON p.x = r.v)", select="SELECT vid, count(e.y) AS reached FROM (SELECT DISTINCT x AS vid FROM rel WHERE i = 0) JOIN reach r ON r.s = vid LEFT JOIN (SELECT DISTINCT x, y FROM rel WHERE j = 3) e ON e.x = r.v GROUP BY vid"))
def _(spark, sf):
    p = Pattern.of(PATH3, 3)
    return match.support_reach(relation.distance_relation(events_graph(spark, sf), p), p)


# --- consistency ---
@query("ac_domains_path", with_sql(TR, relation_sql("tr", PATH4, 1), f"m AS MATERIALIZED ({match_sql(PATH4)})", select=" UNION ".join(f"SELECT {v} AS label, a{v} AS vid FROM m" for v in range(4))))
def _(spark, sf):
    p = Pattern.of(PATH4, 1)
    return consistency.arc_consistent(relation.distance_relation(trade_graph(spark, sf), p), p)[0]


@query("ac_domains_triangle", with_sql(TR, relation_sql("tr", TR_TRIANGLE, 3), arc_sql(TR_TRIANGLE, 8), select="SELECT label, vid FROM ac_d"))
def _(spark, sf):
    p = Pattern.of(TR_TRIANGLE, 3)
    return consistency.arc_consistent(relation.distance_relation(trade_graph(spark, sf), p), p)[0]


@query("ac_domains_one_pass", with_sql(TR, relation_sql("tr", TR_TRIANGLE, 3), arc_sql(TR_TRIANGLE, 1), select="SELECT label, vid FROM ac_d"))
def _(spark, sf):
    p = Pattern.of(TR_TRIANGLE, 3)
    return consistency.arc_consistent(relation.distance_relation(trade_graph(spark, sf), p), p, 1)[0]


@query("semi_join_reduced_relations", with_sql(TR, relation_sql("tr", TR_TRIANGLE, 3), arc_sql(TR_TRIANGLE, 8), select="SELECT i, j, x, y FROM ac"))
def _(spark, sf):
    p = Pattern.of(TR_TRIANGLE, 3)
    return consistency.arc_consistent(relation.distance_relation(trade_graph(spark, sf), p), p)[1]


@query("support_counts", with_sql(TR, relation_sql("tr", TR_TRIANGLE, 3), select="SELECT i AS label, x AS vid, 'out' AS way, j AS partner, count(*) AS supports FROM rel GROUP BY i, x, j UNION ALL SELECT j, y, 'in', i, count(*) FROM rel GROUP BY j, y, i"))
def _(spark, sf):
    return consistency.supports(relation.distance_relation(trade_graph(spark, sf), Pattern.of(TR_TRIANGLE, 3)))


@query("pc_relations_triangle", with_sql(TR, relation_sql("tr", TR_TRIANGLE, 3), f"m AS MATERIALIZED ({match_sql(TR_TRIANGLE)})", select=" UNION ".join(f"SELECT {i} AS i, {j} AS j, a{i} AS x, a{j} AS y FROM m" for i, j in TR_TRIANGLE)))
def _(spark, sf):
    p = Pattern.of(TR_TRIANGLE, 3)
    return consistency.path_consistent(relation.distance_relation(trade_graph(spark, sf), p), p)[1]


_VIRTUAL = [*PATH4, (0, 2), (1, 3)]


@query("pc_completed_path", with_sql(TR, relation_sql("tr", PATH4, 1), f"m AS MATERIALIZED ({match_sql(PATH4)})", select=" UNION ".join(f"SELECT {i} AS i, {j} AS j, a{i} AS x, a{j} AS y FROM m" for i, j in _VIRTUAL)))
def _(spark, sf):
    p = Pattern.of(PATH4, 1)
    return consistency.path_consistent_completed(relation.distance_relation(trade_graph(spark, sf), p), p)[1]


@query("result_totals", with_sql(TR, relation_sql("tr", TR_TRIANGLE, 3), arc_sql(TR_TRIANGLE, 8), select="SELECT label, count(*) AS vertices, (SELECT count(*) FROM ac WHERE i = label) AS out_supports, (SELECT count(*) FROM ac WHERE j = label) AS in_supports FROM ac_d GROUP BY label"))
def _(spark, sf):
    p = Pattern.of(TR_TRIANGLE, 3)
    return consistency.result_totals(*consistency.arc_consistent(relation.distance_relation(trade_graph(spark, sf), p), p))


# --- landmarks, embeddings and bounds ---
_SCATTER = "((vid + 1) * 2654435761 + {salt} * 40503) % 1000003"
_LANDMARKS = f"lm AS (SELECT vid FROM tr_v ORDER BY {_SCATTER.format(salt=5)}, vid LIMIT 4)"
_LM_NEAR = near_sql("lc", "SELECT vid AS key, vid FROM lm", "tr_e", CUT)


def _landmarks(spark, sf):
    g = trade_graph(spark, sf).stored()
    return g, kept(index.landmark_distances(g, index.random_landmarks(g, 4, 5), CUT), "landmark-distances")[0]


@query("landmark_distances", with_sql(TR, _LANDMARKS, _LM_NEAR, select="SELECT key AS landmark, vid, d FROM lc"))
def _(spark, sf):
    return _landmarks(spark, sf)[1]


@query("landmark_group_range", with_sql(TR, _LANDMARKS, _LM_NEAR, select="SELECT label, key AS landmark, min(d) AS nearest, max(d) AS farthest FROM lc JOIN tr_v USING (vid) GROUP BY label, key"))
def _(spark, sf):
    return index.landmark_ranges(*_landmarks(spark, sf))


#: Three landmarks: a pseudo-random one, then twice the farthest from those before it, if there is one.
_FARTHEST = ["f0 AS (SELECT vid FROM ev_v ORDER BY ((vid + 1) * 2654435761) % 1000003, vid LIMIT 1)"]
for _k in (0, 1):
    _FARTHEST += [near_sql(f"n{_k}", f"SELECT 0 AS key, vid FROM f{_k}", "ev_e", 12), f"f{_k + 1} AS MATERIALIZED (SELECT vid FROM f{_k} UNION ALL SELECT * FROM (SELECT vid FROM n{_k} WHERE d > 0 ORDER BY d DESC, vid LIMIT 1))"]


@query("farthest_landmarks", with_sql(EV, *_FARTHEST, select="SELECT vid AS landmark FROM f2"))
def _(spark, sf):
    return index.farthest_landmarks(events_graph(spark, sf), 3, 12)


_SETS = "sets(key, vid) AS MATERIALIZED (" + " UNION ALL ".join(f"(SELECT {k}, vid FROM tr_v ORDER BY {_SCATTER.format(salt=k)}, vid LIMIT {2 << (k // SCALES)})" for k in range(SETS)) + ")"


_VEC_JOIN = f"vec AS MATERIALIZED (SELECT t.vid, t.label, list(coalesce(em.d, {CUT + 1}) ORDER BY g.dim) AS v FROM tr_v t CROSS JOIN range({SETS}) g(dim) LEFT JOIN em ON em.vid = t.vid AND em.key = g.dim GROUP BY t.vid, t.label)"
#: Distances to sets: along the reversed edges for a directed graph, along both ways for an undirected one.
_DIRECTED = [TR, "tr_b AS (SELECT dst AS src, src AS dst, w FROM tr_e)", _SETS, near_sql("em", "SELECT key, vid FROM sets", "tr_b", CUT), _VEC_JOIN]
_BOTH = [TR, _SETS, near_sql("em", "SELECT key, vid FROM sets", "tr_u", CUT), _VEC_JOIN]
_LINF = "list_max(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))"
_ONE = "greatest(list_max(list_transform(list_zip({a}, {b}), lambda p: p[1] - p[2])), 0)"
_NEAR_ENDS = "(VALUES " + ", ".join(f"({i}, {j})" for i, j in NEAR) + ") n(i, j)"


def _band_sql(bound: str, delta: int) -> str:
    return f"band AS MATERIALIZED (SELECT n.i, n.j, a.vid AS x, b.vid AS y FROM {_NEAR_ENDS} JOIN vec a ON a.label = n.i JOIN vec b ON b.label = n.j WHERE {bound.format(a='a.v', b='b.v')} <= {delta})"


def _vectors(spark, sf, directed: bool):
    g = trade_graph(spark, sf)
    g = (g if directed else g.undirected()).stored()
    return g, _graph_vectors(g)


def _graph_vectors(g):
    return kept(index.vectors(g, index.embedding(g, index.reference_sets(g, SCALES), CUT), SETS, CUT), "vectors")[0]


@query("reference_sets", with_sql(TR, _SETS, select="SELECT CAST(key AS INTEGER) AS dim, vid FROM sets"))
def _(spark, sf):
    return index.reference_sets(trade_graph(spark, sf), SCALES)


@query("embedding_vectors", with_sql(*_DIRECTED, select="SELECT vid, label, array_to_string(v, ',') AS v FROM vec"))
def _(spark, sf):
    return _vectors(spark, sf, True)[1].select("vid", "label", F.array_join(F.col("v").cast("array<string>"), ",").alias("v"))


_SCALED = "sc AS (SELECT greatest(CAST(floor(log2(count(*))) AS INTEGER) - 1, 1) AS s FROM ev_v), dims AS (SELECT unnest(range(s * s)) AS dim, s FROM sc), sets(key, vid) AS MATERIALIZED (SELECT dim, vid FROM (SELECT dim, s, vid, row_number() OVER (PARTITION BY dim ORDER BY ((vid + 1) * 2654435761 + dim * 40503) % 1000003, vid) AS n FROM ev_v CROSS JOIN dims) WHERE n <= 2 << CAST(dim // s AS INTEGER)), ev_b AS (SELECT dst AS src, src AS dst, w FROM ev_e)"


@query("embedding_of_all_scales", with_sql(EV, _SCALED, near_sql("em", "SELECT key, vid FROM sets", "ev_b", CUT), select="SELECT vid, CAST(key AS INTEGER) AS dim, d FROM em"))
def _(spark, sf):
    g = events_graph(spark, sf).stored()
    return index.embedding(g, index.reference_sets(g), CUT)


@query("embedding_linf", with_sql(*_BOTH, select=f"SELECT a.vid AS x, b.vid AS y, CAST({_LINF.format(a='a.v', b='b.v')} AS INTEGER) AS bound FROM vec a JOIN tr_e e ON e.src = a.vid JOIN vec b ON b.vid = e.dst"))
def _(spark, sf):
    g, v = _vectors(spark, sf, False)
    ends = trade_graph(spark, sf).edges.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    both = ends.join(v.selectExpr("vid AS x", "v AS a"), "x").join(v.selectExpr("vid AS y", "v AS b"), "y")
    return both.select("x", "y", linf(F.col("a"), F.col("b")).alias("bound"))


@query("landmark_lower_bound", with_sql(TR, _LANDMARKS, _LM_NEAR, select=f"""SELECT e.src AS x, e.dst AS y, CAST(greatest(max(coalesce(b.d, {CUT + 1}) - coalesce(a.d, {CUT + 1})), 0) AS INTEGER) AS bound
FROM tr_e e CROSS JOIN lm LEFT JOIN lc a ON a.key = lm.vid AND a.vid = e.src LEFT JOIN lc b ON b.key = lm.vid AND b.vid = e.dst GROUP BY e.src, e.dst"""))
def _(spark, sf):
    g, near = _landmarks(spark, sf)
    names = sorted(r["landmark"] for r in near.select("landmark").distinct().collect())  # four landmarks
    dim = F.element_at(F.create_map(*(F.lit(x) for k, v in enumerate(names) for x in (v, k))), F.col("landmark"))
    v = index.vectors(g, near.select("vid", dim.alias("dim"), "d"), len(names), CUT)
    v, _ = kept(v, "landmark-vectors")
    both = g.edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).join(v.selectExpr("vid AS x", "v AS a"), "x").join(v.selectExpr("vid AS y", "v AS b"), "y")
    return both.select("x", "y", one_sided(F.col("b"), F.col("a")).alias("bound"))


@query("landmark_prune", with_sql(*_DIRECTED, _band_sql(_ONE, 1), arc_sql(NEAR, 6, "band"), select="SELECT label, vid FROM ac_d"))
def _(spark, sf):
    return bounds.landmark_pruned(_vectors(spark, sf, True)[1], Pattern.of(NEAR, 1), True)


@query("landmark_prune_undirected", with_sql(*_BOTH, _band_sql(_LINF, 1), arc_sql(NEAR, 6, "band"), select="SELECT label, vid FROM ac_d"))
def _(spark, sf):
    return bounds.landmark_pruned(_vectors(spark, sf, False)[1], Pattern.of(NEAR, 1), False)


def _areas_sql(vec: str, delta: int, name: str = "area") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT label, dim, CAST(min(lo) AS INTEGER) AS lo, CAST(max(hi) AS INTEGER) AS hi FROM (
    SELECT *, sum(new) OVER (PARTITION BY label, dim ORDER BY lo, hi) AS run FROM (
      SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY label, dim ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM (
        SELECT DISTINCT label, dim, v[dim + 1] - {delta} AS lo, v[dim + 1] + {delta} AS hi FROM {vec} CROSS JOIN range({SETS}) g(dim)))) GROUP BY label, dim, run)"""


@query("neighbor_areas", with_sql(*_BOTH, _areas_sql("vec", 1), select="SELECT label, CAST(dim AS INTEGER) AS dim, lo, hi FROM area"))
def _(spark, sf):
    return bounds.areas(_vectors(spark, sf, False)[1], 1)


def _area_rounds(rounds: int, near: dict[int, list[int]] | None = None) -> list[str]:
    near = near or {0: [4], 3: [4], 4: [0, 3]}
    parts, last = ["av AS MATERIALIZED (SELECT * FROM vec WHERE label IN (0, 3, 4))"], "av"
    for n in range(rounds):
        inside = " AND ".join("(t.label <> {a} OR {c})".format(a=a, c=" AND ".join(f"NOT EXISTS (SELECT 1 FROM range({SETS}) g(dim) WHERE NOT EXISTS (SELECT 1 FROM area{n} s WHERE s.label = {b} AND s.dim = g.dim AND t.v[g.dim + 1] BETWEEN s.lo AND s.hi))" for b in bs)) for a, bs in near.items())
        # distinct vectors first: few of them
        parts += [_areas_sql(last, 1, f"area{n}"), f"keep{n} AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT label, v FROM {last}) t WHERE {inside})", f"av{n} AS MATERIALIZED (SELECT a.* FROM {last} a JOIN keep{n} k ON k.label = a.label AND k.v = a.v)"]
        last = f"av{n}"
    return [*parts, f"fin AS (SELECT * FROM {last})"]


@query("neighbor_area_prune", with_sql(*_BOTH, *_area_rounds(4), select="SELECT label, vid FROM fin"))
def _(spark, sf):
    return bounds.area_pruned(_vectors(spark, sf, False)[1], Pattern.of(NEAR, 1))


@query("neighbor_area_prune_one_pass", with_sql(*_BOTH, *_area_rounds(1), select="SELECT label, vid FROM fin"))
def _(spark, sf):
    return bounds.area_pruned(_vectors(spark, sf, False)[1], Pattern.of(NEAR, 1), 1)


@query("neighbor_area_prune_left", with_sql(*_BOTH, *_area_rounds(1, {3: [4], 4: [0]}), select="SELECT label, vid FROM fin"))
def _(spark, sf):
    return bounds.area_pruned(_vectors(spark, sf, False)[1], Pattern.of(NEAR, 1), 1, left_only=True)


@query("distance_to_group", with_sql(*_BOTH, f"gv AS MATERIALIZED (SELECT DISTINCT dim, v[dim + 1] AS d FROM vec CROSS JOIN range({SETS}) g(dim) WHERE label = 4)", f"tv AS (SELECT vid, dim, v[dim + 1] AS d FROM vec CROSS JOIN range({SETS}) g(dim))", select="SELECT vid, CAST(max(gap) AS INTEGER) AS bound FROM (SELECT t.vid, t.dim, min(abs(t.d - g.d)) AS gap FROM tv t JOIN gv g USING (dim) GROUP BY t.vid, t.dim) GROUP BY vid"))
def _(spark, sf):
    return bounds.distance_to_group(_vectors(spark, sf, False)[1], 4)


@query("landmark_prune_one_pass", with_sql(*_DIRECTED, _band_sql(_ONE, 1), arc_sql(NEAR, 1, "band"), select="SELECT label, vid FROM ac_d"))
def _(spark, sf):
    return bounds.landmark_pruned(_vectors(spark, sf, True)[1], Pattern.of(NEAR, 1), True, to_fixpoint=False)


@query("guided_distances", with_sql(TR, near_sql("c", "SELECT vid AS key, vid FROM tr_v WHERE label = 3", "tr_e", 4), select="SELECT key AS src, vid AS dst, d FROM c WHERE vid % 8 IN (0, 4)"))
def _(spark, sf):
    g = relation.LabelWays(trade_graph(spark, sf)).part([(3, 0), (3, 4)], CUT)
    return guided_by_roots(g.labeled(3, 3), g.vertices.where("label IN (0, 4)"), g.edges, _graph_vectors(g), CUT)


@query("band_join_candidates", with_sql(*_BOTH, _band_sql(_LINF, 1), select="SELECT i, j, x, y FROM band"))
def _(spark, sf):
    return bounds.band_pairs(_vectors(spark, sf, False)[1], Pattern.of(NEAR, 1))


@query("band_join_directed", with_sql(*_DIRECTED, _band_sql(_ONE, 1), select="SELECT i, j, x, y FROM band"))
def _(spark, sf):
    return bounds.band_pairs(_vectors(spark, sf, True)[1], Pattern.of(NEAR, 1), True)


_U_NEAR = near_sql("uc", "SELECT vid AS key, vid FROM tr_v WHERE label IN (3, 4)", "tr_u", 2)
_WITHIN = f"SELECT n.i, n.j, c.key AS x, c.vid AS y FROM uc c JOIN tr_v a ON a.vid = c.key JOIN tr_v b ON b.vid = c.vid JOIN {_NEAR_ENDS} ON a.label = n.i AND b.label = n.j"


@query("verified_candidates", with_sql(TR, _U_NEAR, select=_WITHIN))
def _(spark, sf):
    g, v = _vectors(spark, sf, False)
    near = closure(g.labeled(3, 4), g.edges, 2)
    return bounds.verified(bounds.band_pairs(v, Pattern.of(NEAR, 2)), near, 2)


# --- clusters ---
_MEDOIDS = """med AS (SELECT label, vid AS c, v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ((vid + 1) * 2654435761) % 1000003, vid) AS n FROM vec) WHERE n <= 5),
mem AS MATERIALIZED (SELECT label, c, member, dist FROM (
  SELECT t.label, m.c, t.vid AS member, CAST(""" + _LINF.format(a="t.v", b="m.v") + """ AS INTEGER) AS dist, row_number() OVER (PARTITION BY t.vid ORDER BY """ + _LINF.format(a="t.v", b="m.v") + """, m.c) AS n
  FROM vec t JOIN med m USING (label)) WHERE n = 1)"""


def _members(spark, sf):
    _, v = _vectors(spark, sf, False)
    return v, kept(cluster.assigned(v, cluster.seeds(v, 5)), "members")[0]


@query("cluster_assignment", with_sql(*_BOTH, _MEDOIDS, select="SELECT label, c, member, dist FROM mem"))
def _(spark, sf):
    return _members(spark, sf)[1].select("label", "c", "member", "dist")


@query("cluster_radius", with_sql(*_BOTH, _MEDOIDS, select="SELECT label, c, max(dist) AS r, count(*) AS members FROM mem GROUP BY label, c"))
def _(spark, sf):
    return cluster.clusters(_members(spark, sf)[1])


_CLUSTER_PAIRS = f"""cl AS (SELECT label, c, max(dist) AS r, any_value(m.v) AS v FROM mem JOIN (SELECT vid, v FROM vec) m ON m.vid = mem.c GROUP BY label, c),
cp AS (SELECT a.label AS i, b.label AS j, a.c AS c1, b.c AS c2 FROM {_NEAR_ENDS} JOIN cl a ON a.label = n.i JOIN cl b ON b.label = n.j WHERE {_LINF.format(a='a.v', b='b.v')} <= a.r + b.r + 1)"""


@query("cluster_pair_candidates", with_sql(*_BOTH, _MEDOIDS, _CLUSTER_PAIRS, select="SELECT i, j, c1, c2 FROM cp"))
def _(spark, sf):
    v, m = _members(spark, sf)
    return cluster.cluster_pairs(m, v, Pattern.of(NEAR, 1))


@query("cluster_join", with_sql(*_BOTH, _band_sql(_LINF, 1), select="SELECT i, j, x, y FROM band"))
def _(spark, sf):
    v, m = _members(spark, sf)
    return cluster.cluster_join(m, v, Pattern.of(NEAR, 1))


#: The number of rounds depends on the data: no SQL; a test holds it against plain Python.
@query("k_medoids")
def _(spark, sf):
    return cluster.clusters(cluster.k_medoids(_vectors(spark, sf, False)[1], 5))


def _swaps_sql(rounds: int) -> list[str]:
    """med<rounds> and mem<rounds> after so many trial swaps."""
    parts = ["k0 AS MATERIALIZED (SELECT label, vid AS c FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ((vid + 1) * 2654435761) % 1000003, vid) AS n FROM vec) WHERE n <= 5)"]

    def members(med: str, name: str) -> str:
        bound = _LINF.format(a="t.v", b="m.v")
        return f"""{name} AS MATERIALIZED (SELECT label, c, member, dist FROM (
  SELECT t.label, m.vid AS c, t.vid AS member, CAST({bound} AS INTEGER) AS dist, row_number() OVER (PARTITION BY t.vid ORDER BY {bound}, m.vid) AS n
  FROM vec t JOIN (SELECT v.* FROM vec v JOIN {med} k ON k.c = v.vid) m USING (label)) WHERE n = 1)"""

    parts.append(members("k0", "m0"))
    for r in range(rounds):
        parts.append(f"""t{r} AS MATERIALIZED (
  WITH p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c) - 1 AS a, count(*) OVER (PARTITION BY label) AS n FROM k{r}),
  o AS (SELECT label, vid AS new FROM (SELECT label, vid, row_number() OVER (PARTITION BY label ORDER BY ((vid + 1) * 2654435761 + {r + 1} * 40503) % 1000003, vid) AS n FROM vec WHERE vid NOT IN (SELECT c FROM k{r})) WHERE n = 1)
  SELECT p.label, CASE WHEN {r} % n = a AND new IS NOT NULL THEN new ELSE c END AS c FROM p LEFT JOIN o USING (label))""")
        parts.append(members(f"t{r}", f"u{r}"))
        better = f"SELECT a.label FROM (SELECT label, sum(dist) AS e FROM u{r} GROUP BY label) a JOIN (SELECT label, sum(dist) AS e FROM m{r} GROUP BY label) b USING (label) WHERE a.e < b.e"
        for new, old, name in ((f"t{r}", f"k{r}", "k"), (f"u{r}", f"m{r}", "m")):
            parts.append(f"{name}{r + 1} AS MATERIALIZED (SELECT * FROM {new} WHERE label IN ({better}) UNION ALL SELECT * FROM {old} WHERE label NOT IN ({better}))")
    return parts


@query("k_medoids_three_swaps", with_sql(*_BOTH, *_swaps_sql(3), select="SELECT label, c, max(dist) AS r, count(*) AS members FROM m3 GROUP BY label, c"))
def _(spark, sf):
    return cluster.clusters(cluster.k_medoids(_vectors(spark, sf, False)[1], 5, 3))


@query("multiway_distance_join", with_sql(TR, _U_NEAR, f"rel AS MATERIALIZED ({_WITHIN})", arc_sql(NEAR, 8), select="SELECT i, j, x, y FROM ac"))
def _(spark, sf):
    v, m = _members(spark, sf)
    g = trade_graph(spark, sf).undirected().stored()
    return cluster.multiway_distance_join(m, v, closure(g.labeled(3, 4), g.edges, 2, True), Pattern.of(NEAR, 2))


# --- topology ---
#: Without the edges from nations the trade graph has no cycle, so each component has a nation, and is what it reaches and is reached from.
_SCC = [near_sql("fw", "SELECT vid AS key, vid FROM tr_v WHERE label = 4", "tr_0", 0), "tr_1 AS (SELECT dst AS src, src AS dst, 0 AS w FROM tr_e)", near_sql("bw", "SELECT vid AS key, vid FROM tr_v WHERE label = 4", "tr_1", 0), "tr_c AS (SELECT key, fw.vid FROM fw JOIN bw USING (key, vid))", "tr_m AS (SELECT key, min(vid) AS comp, count(*) AS n FROM tr_c GROUP BY key)"]


@query("scc_components", with_sql(TR, "tr_0 AS (SELECT src, dst, 0 AS w FROM tr_e)", *_SCC, select="SELECT DISTINCT vid, comp FROM tr_c JOIN tr_m USING (key) WHERE n > 1"))
def _(spark, sf):
    return topology.strong_components(trade_graph(spark, sf).edges)


@query("topological_level", with_sql(_EV_CHAIN, select="SELECT vid, CAST(level AS INTEGER) AS level FROM ch WHERE n > 1"))
def _(spark, sf):
    return topology.topological_levels(events_graph(spark, sf).edges)


@query("transitive_closure", with_sql(EV, "tc(src, dst) AS (SELECT src, dst FROM ev_e UNION SELECT t.src, e.dst FROM tc t JOIN ev_e e ON e.src = t.dst)", select="SELECT src, dst FROM tc"))
def _(spark, sf):
    return topology.reachability(events_graph(spark, sf).edges)


@query("dense_vertex_ids", with_sql(TR, "f AS (SELECT raw, min(pos) AS pos FROM (SELECT src AS raw, src * 10 AS pos FROM tr_e UNION ALL SELECT dst, src * 10 + 1 FROM tr_e) GROUP BY raw)", select="SELECT raw, row_number() OVER (ORDER BY pos, raw) - 1 AS id FROM f"))
def _(spark, sf):
    e = trade_graph(spark, sf).edges
    met = e.select(F.col("src").alias("raw"), (F.col("src") * 10).alias("pos")).unionByName(e.select(F.col("dst").alias("raw"), (F.col("src") * 10 + 1).alias("pos")))
    return topology.dense_ids(met, "raw", "pos")


# --- text formats ---
@query("hub_label_text", with_sql(EV, near_sql("c", _ALL_EV, "ev_e", 2), select="SELECT concat_ws(',', key, 0, vid, d) AS line FROM c UNION ALL SELECT concat_ws(',', vid, 1, key, d) FROM c"))
def _(spark, sf):
    return sinks.joined(index.hub_labels(events_graph(spark, sf), 2), "vid", "dir", "hub", "d")


@query("vector_text", with_sql(*_DIRECTED, select=f"SELECT concat_ws(',', vid, array_to_string(list_transform(v, lambda x: CASE WHEN x = {CUT + 1} THEN -1 ELSE x END), ',')) AS line FROM vec"))
def _(spark, sf):
    return sinks.vector_lines(_vectors(spark, sf, True)[1], CUT + 1)


@query("cluster_text", with_sql(*_BOTH, _MEDOIDS, select="SELECT concat_ws(',', label, c, max(dist), string_agg(member::VARCHAR, ',' ORDER BY member)) AS line FROM mem GROUP BY label, c"))
def _(spark, sf):
    return sinks.cluster_lines(_members(spark, sf)[1])


@query("relation_text", with_sql(EV, relation_sql("ev", PATH3, 2), select="SELECT concat_ws(',', i, j, x, y) AS line FROM rel"))
def _(spark, sf):
    return sinks.joined(relation.distance_relation(events_graph(spark, sf), Pattern.of(PATH3, 2)), "i", "j", "x", "y")


@query("edge_join_text", with_sql(EV, relation_sql("ev", PATH3, 2), select="SELECT format('[{}-{}],', i, j) || string_agg(format('[{}-{}]', x, y), ',' ORDER BY x, y) AS line FROM rel GROUP BY i, j"))
def _(spark, sf):
    return sinks.edge_lines(relation.distance_relation(events_graph(spark, sf), Pattern.of(PATH3, 2)))


@query("support_text", with_sql(EV, relation_sql("ev", PATH3, 2), arc_sql(PATH3, 6), """o AS (SELECT i AS label, x AS vid, count(*) AS n, string_agg(format(',[{}-{}]', j, y), '' ORDER BY j, y) AS s FROM ac GROUP BY 1, 2),
n AS (SELECT j AS label, y AS vid, count(*) AS n, string_agg(format(',({}-{})', i, x), '' ORDER BY i, x) AS s FROM ac GROUP BY 1, 2)""", select="SELECT concat_ws(',', label, vid, coalesce(o.n, 0)) || coalesce(o.s, '') || ',' || coalesce(n.n, 0) || coalesce(n.s, '') AS line FROM ac_d LEFT JOIN o USING (label, vid) LEFT JOIN n USING (label, vid)"))
def _(spark, sf):
    p = Pattern.of(PATH3, 2)
    return sinks.support_lines(*consistency.arc_consistent(relation.distance_relation(events_graph(spark, sf), p), p))


@query("match_text", with_sql(EV, relation_sql("ev", PATH3, 2), select=f"SELECT concat_ws(',', a0, a1, a3) AS line FROM ({match_sql(PATH3)})"))
def _(spark, sf):
    p = Pattern.of(PATH3, 2)
    return sinks.joined(match.matches(relation.distance_relation(events_graph(spark, sf), p), p))


# --- text files, written and read back ---
def _written(lines: DataFrame, name: str) -> str:
    path = f"{shared_dir(lines.sparkSession)}/hopweave/{uuid.uuid4().hex}-{name}"
    sinks.write_lines(lines, path)
    return path


@query("read_edges", with_sql(TR, select="SELECT src, dst, w FROM tr_e"))
def _(spark, sf):
    return text.read_edges(spark, _written(sinks.joined(trade_graph(spark, sf).edges, "src", "dst", "w"), "edges"))


@query("read_edges_without_weights", with_sql(EV, select="SELECT src, dst, 1 AS w FROM ev_e"))
def _(spark, sf):
    return text.read_edges(spark, _written(sinks.joined(events_graph(spark, sf).edges, "src", "dst"), "edges"))


@query("read_labels", with_sql(TR, select="SELECT vid, label FROM tr_v"))
def _(spark, sf):
    return text.read_labels(spark, _written(sinks.joined(trade_graph(spark, sf).vertices, "vid", "label"), "labels"))


@query("read_hub_labels", with_sql(EV, near_sql("c", _ALL_EV, "ev_e", CUT), select="SELECT key AS vid, 0 AS dir, vid AS hub, d FROM c WHERE d <= 2 UNION ALL SELECT vid, 1, key, d FROM c WHERE d <= 2"))
def _(spark, sf):
    lines = sinks.joined(index.hub_labels(events_graph(spark, sf), CUT), "vid", "dir", "hub", "d")
    return text.read_hub_labels(spark, _written(lines, "hub-labels"), delta=2)


def _vectors_back(spark, sf, dims: int | None):
    lines = sinks.vector_lines(_vectors(spark, sf, True)[1], CUT + 1)
    return text.read_vectors(spark, _written(lines, "vectors"), dims=dims).select("vid", F.array_join(F.transform("v", lambda x: F.coalesce(x.cast("string"), F.lit("far"))), ",").alias("v"))


_BACK = f"array_to_string(list_transform({{v}}, lambda x: CASE WHEN x = {CUT + 1} THEN 'far' ELSE CAST(x AS VARCHAR) END), ',')"


@query("read_vectors", with_sql(*_DIRECTED, select=f"SELECT vid, {_BACK.format(v='v')} AS v FROM vec"))
def _(spark, sf):
    return _vectors_back(spark, sf, None)


@query("read_pivots", with_sql(*_DIRECTED, select=f"SELECT vid, {_BACK.format(v='v[1:2]')} AS v FROM vec"))
def _(spark, sf):
    return _vectors_back(spark, sf, 2)


@query("read_clusters", with_sql(*_BOTH, _MEDOIDS, select="SELECT label, c, CAST(max(dist) OVER (PARTITION BY label, c) AS INTEGER) AS r, member FROM mem"))
def _(spark, sf):
    return text.read_clusters(spark, _written(sinks.cluster_lines(_members(spark, sf)[1]), "clusters"))


@query("read_relation", with_sql(EV, relation_sql("ev", PATH3, 2), select="SELECT i, j, x, y FROM rel"))
def _(spark, sf):
    lines = sinks.joined(relation.distance_relation(events_graph(spark, sf), Pattern.of(PATH3, 2)), "i", "j", "x", "y")
    return text.read_relation(spark, _written(lines, "relation"))


@query("read_relation_graph", "SELECT * FROM (VALUES (0, 1, 1, 3), (0, 1, 0, 3), (1, 3, 0, 3)) t(l0, l1, l2, l3)")
def _(spark, sf):
    p = Pattern.of(EV_TRIANGLE, 3)
    both = [(*a, *b) for k, a in enumerate(p.edges) for b in p.edges[k + 1 :] if p.shared(a, b)]
    order = {e: k for k, e in enumerate(EV_TRIANGLE)}
    both = [r if order[r[:2]] < order[r[2:]] else (*r[2:], *r[:2]) for r in both]
    return text.read_relation_graph(spark, _written(sinks.joined(spark.createDataFrame(both, "l0 int, l1 int, l2 int, l3 int")), "relation-graph"))


@query("read_mapped", with_sql(TR, select="SELECT src + dst AS ends, w FROM tr_e"))
def _(spark, sf):
    path = _written(sinks.joined(trade_graph(spark, sf).edges, "src", "dst", "w"), "edges")
    return text.read_mapped(spark, path, lambda c: [(c[0] + c[1], c[2])], "ends long, w int")


@query("live_support_text", with_sql(EV, relation_sql("ev", PATH3, 2), arc_sql(PATH3, 6), select="SELECT concat_ws(',', x, y) AS line FROM ac"))
def _(spark, sf):
    p = Pattern.of(PATH3, 2)
    return sinks.joined(consistency.arc_consistent(relation.distance_relation(events_graph(spark, sf), p), p)[1], "x", "y")


@query("support_text_without_counts", with_sql(EV, relation_sql("ev", PATH3, 2), arc_sql(PATH3, 6), """o AS (SELECT i AS label, x AS vid, string_agg(format(',[{}-{}]', j, y), '' ORDER BY j, y) AS s FROM ac GROUP BY 1, 2),
n AS (SELECT j AS label, y AS vid, string_agg(format(',({}-{})', i, x), '' ORDER BY i, x) AS s FROM ac GROUP BY 1, 2)""", select="SELECT concat_ws(',', label, vid) || coalesce(o.s, '') || coalesce(n.s, '') AS line FROM ac_d LEFT JOIN o USING (label, vid) LEFT JOIN n USING (label, vid)"))
def _(spark, sf):
    p = Pattern.of(PATH3, 2)
    return sinks.support_lines(*consistency.arc_consistent(relation.distance_relation(events_graph(spark, sf), p), p), counts=False)
