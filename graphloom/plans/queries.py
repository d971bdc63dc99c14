"""The library's queries over the test tables, each with DuckDB SQL that gives the same rows.

Graphs come from lineitem: eight order keys make one, parts and suppliers are its nodes (25 of them). Point sets come
from embeddings, sequences from events. All rows of the tables take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import BfsArgs, KhopsArgs, PathArgs, PosArgs, TokenArgs
from graphloom.functions import names, partitions
from graphloom.functions.draws import draw_sql
from graphloom.functions.vocab import POSITIONS, default_vocab
from graphloom.functions.written import cut
from graphloom.operators import distances as D
from graphloom.operators import khops, layout, measures, order, paths, search, splits, verify
from graphloom.sources import khops as khop_sources
from graphloom.sources import random_graphs, shaped_graphs, tables
from graphloom.streaming import dataset as streams

SEED = 42
NODES = 25
VOCAB = default_vocab(NODES, 25)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------------------------------------------ table graphs
def lineitem_edges(spark: SparkSession, sf: str, directed: bool = False) -> DataFrame:
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    inst = F.floor(F.col("l_orderkey") / 8)
    return tables.edges_from(table(spark, sf, "lineitem"), inst, F.col("l_partkey") % NODES, (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % NODES, key, directed)


def _edges_sql(directed: bool = False) -> str:
    a, b = ("u", "v") if directed else ("least(u, v)", "greatest(u, v)")
    return f"""
    raw AS (SELECT l_orderkey // 8 AS inst, (l_partkey % {NODES})::INT AS u, ((l_suppkey * 7 + l_linenumber) % {NODES})::INT AS v, l_orderkey * 100 + l_linenumber AS o FROM lineitem),
    kept AS (SELECT inst, min((o, u, v)) AS e FROM raw WHERE u <> v GROUP BY inst, {a}, {b}),
    edges AS (SELECT inst, (row_number() OVER (PARTITION BY inst ORDER BY e) - 1)::INT AS edge_idx, e[2]::INT AS u, e[3]::INT AS v FROM kept),
    arcs AS (SELECT inst, u, v, edge_idx FROM edges {"" if directed else "UNION ALL SELECT inst, v, u, edge_idx FROM edges"}),
    nodes AS (SELECT inst, u AS node FROM arcs UNION SELECT inst, v FROM arcs)"""


def _dist_sql(directed: bool = False) -> str:
    """Breadth-first search from every node, level by level, over each graph's reached pairs."""
    return f"""WITH RECURSIVE {_edges_sql(directed).strip()},
    dist(inst, src, dst, d) USING KEY (inst, src, dst) AS (
      SELECT inst, node, node, 0 FROM nodes
      UNION
      SELECT r.inst, r.src, a.v, min(r.d) + 1 FROM dist r JOIN arcs a ON a.inst = r.inst AND a.u = r.dst
      LEFT JOIN recurring.dist k ON k.inst = r.inst AND k.src = r.src AND k.dst = a.v WHERE k.inst IS NULL GROUP BY r.inst, r.src, a.v
    )"""


_EDGES, _DIST, _DIRECTED = _edges_sql(), _dist_sql(), _dist_sql(True)


@query(f"WITH {_EDGES} SELECT inst, edge_idx, u, v FROM edges")
def table_graph_edges(spark, sf):
    return lineitem_edges(spark, sf)


@query(f"WITH {_edges_sql(True)} SELECT inst, edge_idx, u, v FROM edges")
def directed_table_edges(spark, sf):
    return lineitem_edges(spark, sf, True)


@query(f"""WITH {_EDGES}, seen AS (SELECT inst, u AS node, 2 * edge_idx AS told FROM edges UNION ALL SELECT inst, v, 2 * edge_idx + 1 FROM edges)
SELECT inst, node, (row_number() OVER (PARTITION BY inst ORDER BY min(told)) - 1)::INT AS place FROM seen GROUP BY inst, node""")
def node_order(spark, sf):
    return order.node_order(lineitem_edges(spark, sf))


@query(f"""WITH {_EDGES}, of AS (SELECT inst, count(*) AS n FROM edges GROUP BY inst)
SELECT inst, edge_idx, u, v FROM edges UNION ALL SELECT inst, (edge_idx + n)::INT, v, u FROM edges JOIN of USING (inst)""")
def duplicate_edges(spark, sf):
    return order.duplicated(lineitem_edges(spark, sf))


def _insts(edges: DataFrame) -> DataFrame:
    return edges.select("inst").distinct().withColumn("n", F.lit(NODES))


_MAP = f"""tok AS (SELECT inst, t, row_number() OVER (PARTITION BY inst ORDER BY {draw_sql(SEED, "'node'", "inst", "t")}, t) - 1 AS node
  FROM (SELECT DISTINCT inst FROM edges), (SELECT unnest(range({VOCAB.min_vocab}, {VOCAB.max_vocab})) AS t))"""


@query(f"WITH {_EDGES}, {_MAP} SELECT inst, node::INT AS node, t::INT AS token FROM tok WHERE node < {NODES}")
def node_map(spark, sf):
    return _node_map(lineitem_edges(spark, sf))


def _node_map(edges: DataFrame) -> DataFrame:
    return order.node_map(_insts(edges), VOCAB.min_vocab, VOCAB.max_vocab, SEED)


@query(f"""WITH {_EDGES} SELECT inst, (row_number() OVER (PARTITION BY inst ORDER BY {draw_sql(SEED, "'edge'", "inst", "edge_idx")}, edge_idx) - 1)::INT AS edge_idx, u, v FROM edges""")
def edge_shuffle(spark, sf):
    return random_graphs.shuffled_edges(lineitem_edges(spark, sf), SEED)


def _names(told: DataFrame) -> DataFrame:
    """The node map of told graphs as (inst, tokens)."""
    return order.node_names(told.select("inst", F.lit(NODES).alias("n")), VOCAB.min_vocab, VOCAB.max_vocab, SEED)


def _in_ids(told: DataFrame, tokens: DataFrame) -> DataFrame:
    """Told graphs whose nodes go by their ids."""
    of = lambda c: F.transform(c, lambda x: F.get("tokens", x)).alias(c)
    return told.join(tokens, "inst").select("inst", of("us"), of("vs"))


# ---------------------------------------------------------------------------------------------------------- analytics
@query(f"{_DIST} SELECT inst, src, dst, d FROM dist")
def distances(spark, sf):
    return D.distances(lineitem_edges(spark, sf))


@query(f"{_DIST} SELECT inst, src, dst, d FROM dist")
def distances_array(spark, sf):
    return D.distances(lineitem_edges(spark, sf), plan="array")


@query(f"{_DIST} SELECT inst, src, dst, d FROM dist")
def distances_frontier(spark, sf):
    return D.distances(lineitem_edges(spark, sf), plan="frontier")


@query(f"{_DIRECTED} SELECT inst, src, dst, d FROM dist")
def directed_distances(spark, sf):
    return D.distances(lineitem_edges(spark, sf, True), True)


@query(f"""{_DIST} SELECT a.inst, a.node AS src, b.node AS dst, coalesce(d, -1) AS d FROM nodes a JOIN nodes b USING (inst) LEFT JOIN dist ON dist.inst = a.inst AND src = a.node AND dst = b.node""")
def dense_distances(spark, sf):
    edges = lineitem_edges(spark, sf)
    return D.densified(D.distances(edges), tables.nodes(edges))


@query(f"""WITH RECURSIVE {_EDGES}, late AS (SELECT inst, u, v, min(edge_idx) AS t FROM arcs GROUP BY ALL),
walk(inst, src, node, d, t) AS (
  SELECT inst, node, node, 0, -1 FROM nodes
  UNION ALL
  SELECT * FROM (SELECT w.inst, w.src, l.v, w.d + 1 AS d, min(greatest(w.t, l.t)) AS t FROM walk w JOIN late l ON l.inst = w.inst AND l.u = w.node WHERE w.d < {NODES - 1} GROUP BY w.inst, w.src, l.v, w.d))
SELECT e.inst, e.edge_idx AS row_idx, w.node, min(w.d)::INT AS d FROM edges e JOIN walk w ON w.inst = e.inst AND w.src = e.u AND w.t <= e.edge_idx GROUP BY ALL""")
def causal_ground_truth(spark, sf):
    return D.causal_ground_truth(lineitem_edges(spark, sf))


@query(f"{_DIST} SELECT e.inst, e.edge_idx AS row_idx, t.dst AS node, t.d FROM edges e JOIN dist t ON t.inst = e.inst AND t.src = e.u")
def edge_ground_truth(spark, sf):
    edges = lineitem_edges(spark, sf)
    return D.edge_ground_truth(edges, D.distances(edges))


_PLACES = "seen AS (SELECT inst, u AS node, 2 * edge_idx AS told FROM edges UNION ALL SELECT inst, v, 2 * edge_idx + 1 FROM edges), places AS (SELECT inst, node, (row_number() OVER (PARTITION BY inst ORDER BY min(told)) - 1)::INT AS place FROM seen GROUP BY inst, node)"


@query(f"{_DIST}, {_PLACES} SELECT t.inst, a.place AS row_idx, b.place AS col_idx, t.d FROM dist t JOIN places a ON a.inst = t.inst AND a.node = t.src JOIN places b ON b.inst = t.inst AND b.node = t.dst")
def node_ground_truth(spark, sf):
    edges = lineitem_edges(spark, sf)
    return D.node_ground_truth(order.node_order(edges), D.distances(edges), direct=True)


@query(f"""{_DIST} SELECT e.inst, e.edge_idx AS row_idx, string_agg(t.dst::VARCHAR, ',' ORDER BY t.dst) AS indices, string_agg(t.d::VARCHAR, ',' ORDER BY t.dst) AS distances
FROM edges e JOIN dist t ON t.inst = e.inst AND t.src = e.u GROUP BY ALL""")
def gathered_truth(spark, sf):
    edges = lineitem_edges(spark, sf)
    own = D.gathered_truth(D.edge_ground_truth(edges, D.distances(edges)))
    return own.select("inst", "row_idx", _joined("indices").alias("indices"), _joined("distances").alias("distances"))


def _joined(column: str | Column, by: str = ",") -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), by)


@query(f"{_DIST} SELECT inst, src AS node, min(dst) AS component FROM dist GROUP BY ALL")
def components(spark, sf):
    return measures.components(D.distances(lineitem_edges(spark, sf)))


@query(f"{_DIST} SELECT inst, src AS node, d AS rank, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS ties FROM dist GROUP BY ALL")
def node_ranks(spark, sf):
    return measures.node_ranks(D.distances(lineitem_edges(spark, sf))).withColumn("ties", _joined("ties"))


@query(f"{_DIRECTED} SELECT DISTINCT a.inst, a.u AS node, t.dst AS descendant FROM arcs a JOIN dist t ON t.inst = a.inst AND t.src = a.v")
def descendants(spark, sf):
    edges = lineitem_edges(spark, sf, True)
    return measures.descendants(edges, D.distances(edges, True))


@query(f"WITH {_edges_sql(True)} SELECT inst, u AS node, count(DISTINCT v) AS n_children, 0::BIGINT AS n_parents FROM edges GROUP BY ALL UNION ALL SELECT inst, v, 0, count(DISTINCT u) FROM edges GROUP BY ALL")
def children_and_parents(spark, sf):
    edges = lineitem_edges(spark, sf, True)
    below = measures.children(edges).groupBy("inst", "node").agg(F.count("*").alias("n_children")).withColumn("n_parents", F.lit(0).cast("long"))
    above = measures.parents(edges).groupBy("inst", "node").agg(F.lit(0).cast("long").alias("n_children"), F.count("*").alias("n_parents"))
    return below.unionByName(above)


@query(f"WITH {_EDGES} SELECT inst, u AS node, count(DISTINCT v) AS degree FROM arcs GROUP BY ALL")
def degrees(spark, sf):
    return measures.degrees(lineitem_edges(spark, sf))


@query(f"{_DIST} SELECT inst, d, count(*) AS n FROM dist WHERE d > 0 GROUP BY ALL")
def path_length_histogram(spark, sf):
    return measures.path_length_histogram(D.distances(lineitem_edges(spark, sf)))


@query(f"{_DIST} SELECT d, count(*) AS graphs, round(avg(n), 6) AS mean FROM (SELECT inst, d, count(*) AS n FROM dist WHERE d > 0 GROUP BY ALL) GROUP BY d")
def mean_path_lengths(spark, sf):
    return measures.mean_histogram(measures.path_length_histogram(D.distances(lineitem_edges(spark, sf)))).withColumn("mean", F.round("mean", 6))


_CENTER = """{dist}, need AS (SELECT inst, count(*) AS need FROM nodes GROUP BY inst),
own AS (SELECT t.inst, t.src AS node, {score}::BIGINT AS score FROM dist t JOIN need USING (inst) GROUP BY t.inst, t.src, need HAVING count(*) = need)
SELECT inst, node, score FROM own QUALIFY rank() OVER (PARTITION BY inst ORDER BY score) = 1"""


@query(_CENTER.format(dist=_DIST, score="max(d)"))
def center(spark, sf):
    edges = lineitem_edges(spark, sf)
    return measures.center(D.distances(edges), tables.nodes(edges))


@query(_CENTER.format(dist=_DIST, score="sum(d)"))
def centroid(spark, sf):
    edges = lineitem_edges(spark, sf)
    return measures.center(D.distances(edges), tables.nodes(edges), centroid=True)


_FIRST = "ask AS (SELECT inst, unnest([u, v]) AS node FROM edges WHERE edge_idx < 3), need AS (SELECT inst, count(DISTINCT node) AS need FROM ask GROUP BY inst)"


@query(f"""{_DIST}, {_FIRST}, own AS (SELECT t.inst, t.src AS node, max(t.d)::BIGINT AS score FROM dist t JOIN (SELECT DISTINCT inst, node FROM ask) q ON q.inst = t.inst AND q.node = t.dst JOIN need n ON n.inst = t.inst
  GROUP BY t.inst, t.src, need HAVING count(*) = need) SELECT inst, node, score FROM own QUALIFY rank() OVER (PARTITION BY inst ORDER BY score) = 1""")
def center_of_few(spark, sf):
    """The centre for a given query: the ends of each graph's first three edges. Graphs whose query no node reaches whole have none."""
    edges = lineitem_edges(spark, sf)
    ask = edges.filter("edge_idx < 3").select("inst", F.explode(F.array("u", "v")).alias("node")).distinct()
    return measures.center(D.distances(edges), ask)


@query(f"""{_DIST} SELECT x.inst, x.src AS a, y.src AS b, any_value(t.d) AS d, round(sqrt(sum((x.d - y.d) ** 2)), 6) AS euclidean, sum(abs(x.d - y.d))::BIGINT AS manhattan, sum(x.d * y.d)::BIGINT AS dot,
  round(sum(x.d * y.d) / sqrt(sum(x.d * x.d)::DOUBLE * sum(y.d * y.d)), 6) AS cosine
FROM dist x JOIN dist y ON x.inst = y.inst AND x.dst = y.dst AND x.src < y.src JOIN dist t ON t.inst = x.inst AND t.src = x.src AND t.dst = y.src GROUP BY x.inst, x.src, y.src""")
def distance_scores(spark, sf):
    out = measures.told_scores(lineitem_edges(spark, sf))
    rounded = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)  # noqa: E731  # what round() gives, without its decimals
    return out.select("inst", "a", "b", "d", rounded("euclidean"), "manhattan", "dot", rounded("cosine"))


@query(f"{_DIST}, {_MAP} SELECT t.inst, a.t::INT AS src_tok, b.t::INT AS dst_tok, t.d FROM dist t JOIN tok a ON a.inst = t.inst AND a.node = t.src JOIN tok b ON b.inst = t.inst AND b.node = t.dst")
def packaged_distances(spark, sf):
    edges = lineitem_edges(spark, sf)
    return D.packaged_distances(D.distances(edges), _node_map(edges))


# ---------------------------------------------------------------------------------------------------------- path tasks
_PATH = PathArgs(max_path_length=6, min_path_length=3, sample_choice_node=0.9)
_LENGTHS = "[" + ", ".join(f"({3} + floor({draw_sql(SEED, chr(39) + 'length' + chr(39), 'inst', str(a))} / 4294967296.0 * 4))::INT" for a in range(11)) + "]"
_ENDS = f"""own AS (SELECT *, sum((d = 1)::INT) OVER (PARTITION BY inst, src) AS degree, count(*) OVER (PARTITION BY inst, dst, d) AS same FROM dist),
turned AS (SELECT *, CASE WHEN list_position({_LENGTHS}, d + 1) > 0 THEN list_position({_LENGTHS}, d + 1) ELSE 12 END AS turn FROM own WHERE d > 0),
firsts AS (SELECT *, min(turn) OVER (PARTITION BY inst) AS first FROM turned QUALIFY turn = first),
ranked AS (SELECT *, {draw_sql(SEED, "'choice'", "inst")} / 4294967296.0 < 0.9 AND first <= 11 AND degree >= 2 AS best FROM firsts),
ends AS (SELECT inst, src AS start, dst AS "end", d FROM ranked
  QUALIFY row_number() OVER (PARTITION BY inst ORDER BY (NOT best)::INT, CASE WHEN best THEN -same ELSE 0 END, CASE WHEN best THEN -degree ELSE 0 END, {draw_sql(SEED, "'pair'", "inst", "src", "dst")}, src, dst) = 1)"""


@query(f'{_DIST}, {_ENDS} SELECT inst, start, "end", d FROM ends')
def start_end_sample(spark, sf):
    return paths.start_end(D.distances(lineitem_edges(spark, sf)), _PATH, SEED)


_WAY = f"""towards AS (SELECT t.inst, t.src AS node, t.d AS rest FROM dist t JOIN ends e ON e.inst = t.inst AND e."end" = t.dst),
nexts AS (SELECT a.inst, a.u, a.v FROM arcs a JOIN towards x ON x.inst = a.inst AND x.node = a.u JOIN towards y ON y.inst = a.inst AND y.node = a.v AND y.rest = x.rest - 1
  QUALIFY row_number() OVER (PARTITION BY a.inst, a.u ORDER BY {draw_sql(SEED, "'step'", "a.inst", "a.u", "a.v")}, a.v) = 1),
way(inst, step, node) AS (SELECT inst, 0, start FROM ends UNION ALL SELECT w.inst, w.step + 1, n.v FROM way w JOIN nexts n ON n.inst = w.inst AND n.u = w.node)"""


def _paths(spark, sf):
    edges = lineitem_edges(spark, sf)
    # dealt by instance once: all that reads the distances reads that one exchange
    dist = D.distances(edges).repartition("inst")
    return edges, dist, paths.shortest_paths(edges, dist, paths.start_end(dist, _PATH, SEED), SEED)


@query(f"{_DIST}, {_ENDS}, {_WAY} SELECT inst, string_agg(node::VARCHAR, ' ' ORDER BY step) AS path FROM way GROUP BY inst")
def shortest_path(spark, sf):
    return _paths(spark, sf)[2].select("inst", _joined("path", " ").alias("path"))


_LABELS = """labels AS (SELECT w.inst, w.step, w.node, w.node::VARCHAR || coalesce(string_agg(CASE WHEN o.node <> w.node THEN ' ' || o.node::VARCHAR END, '' ORDER BY o.node), '') AS labels
FROM way w LEFT JOIN way b ON b.inst = w.inst AND b.step = w.step - 1
LEFT JOIN towards y ON y.inst = w.inst AND y.node = w.node
LEFT JOIN (SELECT DISTINCT a.inst, a.u, a.v AS node, x.rest FROM arcs a JOIN towards x ON x.inst = a.inst AND x.node = a.v) o ON o.inst = w.inst AND o.u = b.node AND o.rest = y.rest GROUP BY w.inst, w.step, w.node)"""


def _told(spark, sf):
    """The same paths with their labels, in one pass over told graphs: the plan for many small graphs."""
    edges = lineitem_edges(spark, sf)
    dist = D.distances(edges)
    return edges, dist, paths.told_paths(edges, paths.start_end(dist, _PATH, SEED), SEED)


@query(f"{_DIST}, {_ENDS}, {_WAY} SELECT inst, string_agg(node::VARCHAR, ' ' ORDER BY step) AS path FROM way GROUP BY inst")
def told_paths(spark, sf):
    return _told(spark, sf)[2].select("inst", _joined("path", " ").alias("path"))


@query(f"{_DIST}, {_ENDS}, {_WAY}, {_LABELS} SELECT inst, step, node, labels FROM labels")
def label_smoothing(spark, sf):
    edges, dist, way = _paths(spark, sf)
    return paths.label_smoothing(way, edges, dist).withColumn("labels", _joined("labels", " "))


@query(f"""{_DIST}, {_ENDS}, {_WAY}, {_MAP}
SELECT w.inst, '13 ' || any_value(s.t) || ' ' || any_value(f.t) || ' 14' AS query, '6 ' || string_agg(k.t::VARCHAR, ' ' ORDER BY w.step) || ' 7' AS task, count(*)::INT AS difficulty
FROM way w JOIN tok k ON k.inst = w.inst AND k.node = w.node JOIN ends e ON e.inst = w.inst JOIN tok s ON s.inst = w.inst AND s.node = e.start JOIN tok f ON f.inst = w.inst AND f.node = e."end" GROUP BY w.inst""")
def path_tokens(spark, sf):
    edges, _, way = _told(spark, sf)
    out = paths.path_tokens(way, None, paths.node_tokens(_node_map(edges)), VOCAB)
    return out.select("inst", _joined("query", " ").alias("query"), _joined("task", " ").alias("task"), "difficulty")


# ------------------------------------------------------------------------------------------------------------ searches
@query(f"{_DIST}, {_ENDS} SELECT t.inst, t.d AS level, t.dst AS node FROM dist t JOIN ends e ON e.inst = t.inst AND e.start = t.src")
def bfs_levels(spark, sf):
    dist = D.distances(lineitem_edges(spark, sf))
    return search.bfs_levels(dist, paths.start_end(dist, _PATH, SEED))


def _traces(spark, sf, args: BfsArgs):
    edges = lineitem_edges(spark, sf)
    dist = D.distances(edges)
    return edges, dist, search.bfs_traces(edges, paths.start_end(dist, _PATH, SEED), args)


_SEARCH = f"""{_dist_sql()}, {_ENDS}, {_PLACES},
met AS (SELECT t.inst, t.d AS level, t.dst AS node, p.place, e."end" FROM dist t JOIN ends e ON e.inst = t.inst AND e.start = t.src JOIN places p ON p.inst = t.inst AND p.node = t.dst WHERE t.d <= e.d),
queue(inst, level, node, pos, parent) AS (
  SELECT inst, level, node, 0::BIGINT, NULL::INT FROM met WHERE level = 0
  UNION ALL
  SELECT inst, level, node, row_number() OVER (PARTITION BY inst ORDER BY ppos, place) - 1, parent FROM (
    SELECT m.inst, m.level, m.node, m.place, q.pos AS ppos, q.node AS parent FROM queue q JOIN arcs a ON a.inst = q.inst AND a.u = q.node JOIN met m ON m.inst = q.inst AND m.node = a.v AND m.level = q.level + 1
    QUALIFY row_number() OVER (PARTITION BY m.inst, m.node ORDER BY q.pos) = 1))"""


@query(f"{_SEARCH} SELECT inst, level::INT AS level, node, pos::INT AS pos, parent FROM queue WHERE level > 0")
def bfs_queue(spark, sf):
    """Every node that the search meets, in its level's order, and who met it; levels searched whole."""
    _, _, traces = _traces(spark, sf, BfsArgs(stop_once_found=False))
    each = traces.filter("found").select("inst", F.explode("steps").alias("s"))
    order_ = F.array_sort(F.collect_list(F.struct("s.place", "s.node", "s.nbrs")))
    told = each.groupBy("inst", (F.col("s.level") + 1).alias("level")).agg(F.flatten(F.transform(order_, lambda x: F.transform(x["nbrs"], lambda n: F.struct(n.alias("node"), x["node"].alias("parent"))))).alias("m"))
    return told.select("inst", "level", F.posexplode("m").alias("pos", "x")).select("inst", "level", "x.node", "pos", "x.parent")


@query()
def bfs_tokens(spark, sf):
    args = BfsArgs(include_queue=True)
    edges, _, traces = _traces(spark, sf, args)
    return search.bfs_tokens(traces, paths.node_tokens(_node_map(edges)), VOCAB, args).select("inst", _joined("scratchpad", " ").alias("scratchpad"))


@query()
def dfs_tokens(spark, sf):
    edges = lineitem_edges(spark, sf)
    dist = D.distances(edges)
    tokens = paths.node_tokens(_node_map(edges))
    traces = search.dfs_traces(edges, paths.start_end(dist, _PATH, SEED), tokens, sort_adjacency=True)
    return search.dfs_tokens(traces, tokens, VOCAB).select("inst", _joined("scratchpad", " ").alias("scratchpad"))


# -------------------------------------------------------------------------------------------------------------- layout
def _instances(spark, sf, tok: TokenArgs, pos: PosArgs):
    edges, _, way = _told(spark, sf)
    tokens = paths.node_tokens(_node_map(edges))
    parts = paths.path_tokens(way, None, tokens, VOCAB)
    graph = layout.graph_tokens(edges, order.node_order(edges), tokens, VOCAB, POSITIONS, tok, pos)
    return layout.instance_tokens(parts.join(graph, "inst").withColumn("scratchpad", F.lit(None).cast("array<int>")), VOCAB, POSITIONS, tok, pos)


def _graph_long(spark, sf, tok: TokenArgs, pos: PosArgs) -> DataFrame:
    edges = lineitem_edges(spark, sf)
    tokens = paths.node_tokens(_node_map(edges))
    return layout.graph_tokens(edges, order.node_order(edges), tokens, VOCAB, POSITIONS, tok, pos)


@query(f"""WITH {_EDGES}, {_MAP}, {_PLACES}, n AS (SELECT inst, count(*) AS n FROM edges GROUP BY inst)
SELECT e.inst, e.edge_idx::INT AS i, a.t::INT AS first, b.t::INT AS second, (200 + e.edge_idx)::INT AS position FROM edges e JOIN tok a ON a.inst = e.inst AND a.node = e.u JOIN tok b ON b.inst = e.inst AND b.node = e.v
UNION ALL SELECT p.inst, (n + place)::INT, k.t::INT, k.t::INT, (200 + n + place)::INT FROM places p JOIN n USING (inst) JOIN tok k ON k.inst = p.inst AND k.node = p.node""")
def graph_tokens(spark, sf):
    """Edges as rows of two, then the nodes."""
    rows = _graph_long(spark, sf, TokenArgs(include_nodes=True), PosArgs())
    each = rows.select("inst", F.posexplode(F.arrays_zip("graph", "graph_pos")).alias("i", "r"))
    return each.select("inst", "i", F.get("r.graph", F.lit(0)).alias("first"), F.get("r.graph", F.lit(1)).alias("second"), F.get("r.graph_pos", F.lit(0)).alias("position"))


@query(f"""WITH {_EDGES}, {_MAP}
SELECT e.inst, (3 * e.edge_idx + j)::INT AS i, CASE j WHEN 0 THEN a.t WHEN 1 THEN b.t ELSE 4 END::INT AS token, (200 + e.edge_idx)::INT AS edge, (940 + j)::INT AS part, 2 AS kind
FROM edges e JOIN tok a ON a.inst = e.inst AND a.node = e.u JOIN tok b ON b.inst = e.inst AND b.node = e.v, (SELECT unnest([0, 1, 2]) AS j)""")
def positions(spark, sf):
    """Edges as three rows each, with structure in their positions."""
    rows = _graph_long(spark, sf, TokenArgs(concat_edges=False), PosArgs(use_graph_structure=True, use_full_structure=True))
    each = rows.select("inst", F.posexplode(F.arrays_zip("graph", "graph_pos")).alias("i", "r"))
    at = lambda j: F.get("r.graph_pos", F.lit(j))
    return each.select("inst", "i", F.get("r.graph", F.lit(0)).alias("token"), at(0).alias("edge"), at(1).alias("part"), at(2).alias("kind"))


_SIZES = f"""{_DIST}, {_ENDS}, e AS (SELECT inst, count(*) AS e FROM edges GROUP BY inst), sized AS (SELECT x.inst, e.e, x.d + 1 AS n FROM ends x JOIN e USING (inst))"""
_TOK = TokenArgs(num_thinking_tokens=2, align_prefix_front_pad=True)


@query(f"""{_SIZES} SELECT inst, (1 + e)::INT AS query_start_indices, 4 AS query_lengths, 1 AS graph_start_indices, e::INT AS graph_edge_lengths, (5 + e)::INT AS thinking_tokens_start_idx, (7 + e)::INT AS task_start_indices, (n + 3)::INT AS task_lengths, (10 + e + n)::INT AS src_lengths FROM sized""")
def layout_offsets(spark, sf):
    return _instances(spark, sf, _TOK, PosArgs()).select("inst", "query_start_indices", "query_lengths", "graph_start_indices", "graph_edge_lengths", "thinking_tokens_start_idx", "task_start_indices", "task_lengths", "src_lengths")


@query(f"""{_SIZES}, b AS (SELECT inst // 64 AS batch_id, max(e) AS e, max(n) AS n FROM sized GROUP BY ALL)
SELECT s.inst, b.batch_id, (7 + b.e)::INT AS task_start_indices, (10 + b.e + s.n)::BIGINT AS src_lengths, (7 + b.e + b.n + 3)::INT AS padded FROM sized s JOIN b ON b.batch_id = s.inst // 64""")
def front_pad_align(spark, sf):
    own = layout.packaged(_instances(spark, sf, _TOK, PosArgs()), VOCAB, _TOK, 64)
    return own.select("inst", "batch_id", F.col("task_start_indices").cast("int").alias("task_start_indices"), F.col("src_lengths").cast("long").alias("src_lengths"), F.size("src_tokens").alias("padded"))


@query(f"""{_SIZES}, b AS (SELECT inst // 64 AS batch_id, max(n) AS n FROM sized GROUP BY ALL)
SELECT s.inst, i::INT AS i, CASE WHEN i < s.n + 3 THEN 7 + s.e + i ELSE 0 END::INT AS id FROM sized s JOIN b ON b.batch_id = s.inst // 64, LATERAL (SELECT unnest(range(b.n + 3)) AS i)""")
def gather_ids(spark, sf):
    tok = TokenArgs(num_thinking_tokens=2)
    own = layout.packaged(_instances(spark, sf, tok, PosArgs()), VOCAB, tok, 64)
    return layout.task_ids(own, true_task=True).select("inst", F.posexplode("ids").alias("i", "id"))


@query(f"""WITH {_EDGES}, {_MAP}, e AS (SELECT e.inst, least(a.t, b.t) - {VOCAB.min_vocab} AS x, greatest(a.t, b.t) - {VOCAB.min_vocab} AS y FROM edges e JOIN tok a ON a.inst = e.inst AND a.node = e.u JOIN tok b ON b.inst = e.inst AND b.node = e.v)
SELECT inst, string_agg(x || '-' || y, ' ' ORDER BY x, y) AS edges FROM e GROUP BY inst""")
def reconstruct(spark, sf):
    """Tokens read back give the edges again; of the instances that have a task, which all have."""
    tok = TokenArgs(concat_edges=False, include_nodes=True)
    own = layout.reconstructed(_instances(spark, sf, tok, PosArgs()), VOCAB, False, False)
    return own.select("inst", F.array_join(F.transform("edges", lambda e: F.concat_ws("-", (e["u"]).cast("string"), (e["v"]).cast("string"))), " ").alias("edges"))


@query(f"""{_DIST}, {_MAP}, cells AS (SELECT t.inst, a.t AS s, b.t AS o, t.d FROM dist t JOIN tok a ON a.inst = t.inst AND a.node = t.src JOIN tok b ON b.inst = t.inst AND b.node = t.dst)
SELECT inst, md5(string_agg(s || ',' || o || ',' || d, ';' ORDER BY s, o)) AS hash FROM cells GROUP BY inst""")
def instance_hash(spark, sf):
    edges = lineitem_edges(spark, sf)
    return splits.distance_hashes(D.packaged_distances(D.distances(edges), _node_map(edges)))


@query("""WITH held AS (SELECT DISTINCT md5(text) AS hash, CASE WHEN item_id % 2 = 0 THEN 'valid' ELSE 'test' END AS split FROM benchmark UNION
  SELECT DISTINCT md5(text), 'test' FROM documents WHERE lang = 'es'), flags AS (SELECT hash, bool_or(split = 'valid') AS in_validation, bool_or(split = 'test') AS in_test FROM held GROUP BY hash)
SELECT doc_id AS inst, coalesce(in_validation, false) AS in_validation, coalesce(in_test, false) AS in_test, coalesce(in_validation OR in_test, false) AS is_invalid FROM documents LEFT JOIN flags ON flags.hash = md5(coalesce(text, ''))""")
def split_mask(spark, sf):
    """Documents marked by hash against two held-out sets: benchmark items, and all Spanish texts."""
    bench = splits.text_hashes(table(spark, sf, "benchmark"), "item_id", "text").select("hash", F.when(F.col("inst") % 2 == 0, "valid").otherwise("test").alias("split"))
    docs = table(spark, sf, "documents")
    spanish = splits.text_hashes(docs.filter("lang = 'es'"), "doc_id", "text").select("hash", F.lit("test").alias("split"))
    return splits.marked(splits.text_hashes(docs, "doc_id", "text"), bench.unionByName(spanish)).select("inst", "in_validation", "in_test", "is_invalid")


# ------------------------------------------------------------------------------------------------------------ verifiers
@query(f"""{_DIST}, {_ENDS}, {_WAY}, told AS (SELECT inst, list(node ORDER BY step) AS p FROM way GROUP BY inst),
said AS (SELECT inst, p, CASE inst % 4 WHEN 0 THEN p WHEN 1 THEN p[1:len(p) - 1] WHEN 2 THEN p[1:1] || p ELSE p[1:2] || p END AS w FROM told),
hop AS (SELECT inst, w[i] AS u, w[i + 1] AS v FROM said, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
judged AS (SELECT h.inst, count(*) AS hops, count(a.u) AS real FROM hop h LEFT JOIN (SELECT DISTINCT inst, u, v FROM arcs) a ON a.inst = h.inst AND a.u = h.u AND a.v = h.v GROUP BY h.inst)
SELECT s.inst, CASE WHEN len(w) = 0 OR w[1] <> p[1] OR w[-1] <> p[-1] THEN -1 WHEN t.d IS NULL THEN -3 WHEN real < hops THEN -5 WHEN hops > t.d THEN 0 ELSE 1 END::INT AS code
FROM said s LEFT JOIN judged j ON j.inst = s.inst LEFT JOIN dist t ON t.inst = s.inst AND t.src = p[1] AND t.dst = p[-1]""")
def verify_paths(spark, sf):
    """Right paths, paths cut short, paths with a hop to the same node, and paths that go one step back and forth."""
    told = cut(D.told_graphs(lineitem_edges(spark, sf)), "told")
    tokens = _names(told)
    way = paths.told_paths(told, paths.told_ends(told, _PATH, SEED), SEED)
    own = way.join(tokens, "inst").withColumn("t", F.transform("path", lambda x: F.get("tokens", x)))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    wrong = F.when(F.col("inst") % 4 == 0, F.col("t")).when(F.col("inst") % 4 == 1, F.slice("t", F.lit(1), F.size("t") - 1)).when(F.col("inst") % 4 == 2, F.concat(F.array(first), "t")).otherwise(F.concat(F.array(first, second), "t"))
    said = cut(own.select("inst", first.alias("start"), F.element_at("t", -1).alias("end"), wrong.alias("tokens")), "said")
    # of the distances, in the same ids, only those that the verdict looks at
    dist = cut(D.asked_distances(_in_ids(told, tokens), verify.hops_and_ends(said)), "asked")
    return verify.verify_paths(said, dist, len(VOCAB.ids))


@query(f"{_DIST}, {_ENDS} SELECT inst, CASE WHEN inst % 2 = 0 THEN 1 ELSE -4 END AS code FROM ends")
def verify_bfs(spark, sf):
    """Written searches are right, and wrong once their first ``[`` is gone."""
    args = BfsArgs(include_queue=True, duplicate_adjacency=True)
    plain = cut(D.told_graphs(lineitem_edges(spark, sf)), "told")
    names = _names(plain)
    of = lambda c: F.get("tokens", F.col(c)).alias(c)
    ends = cut(paths.told_ends(plain, _PATH, SEED).join(names, "inst").select("inst", of("start"), of("end")), "ends")
    # the same graphs by ids, so that searches need no names any more
    graphs = cut(_in_ids(plain, names), "graphs")
    told = search.bfs_tokens(search.bfs_traces(graphs, ends, args), None, VOCAB, args)
    own = told.select("inst", F.slice("scratchpad", F.lit(2), F.size("scratchpad")).alias("tokens"))
    at = F.array_position("tokens", VOCAB["["]).cast("int")
    less = F.concat(F.slice("tokens", F.lit(1), at - 1), F.slice("tokens", at + 1, F.size("tokens")))
    own = own.withColumn("tokens", F.when(F.col("inst") % 2 == 0, F.col("tokens")).otherwise(less))
    dist = D.asked_distances(graphs, ends.select("inst", F.col("start").alias("src"), F.col("end").alias("dst")))
    return verify.verify_bfs(own.join(ends, "inst"), dist, VOCAB, len(VOCAB.ids), True, True, D.told_neighbours(graphs))


# --------------------------------------------------------------------------------------------------------------- k-hops
_TYPES = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


def event_sequences(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return tables.sequences_from(events, F.col("user_id"), F.struct("ts", "event_id"), F.expr(_TYPES) + VOCAB.min_vocab)


_SEQ = f"""WITH RECURSIVE raw AS (SELECT user_id AS inst, (ts, event_id) AS o, ({_TYPES} + {VOCAB.min_vocab})::INT AS token FROM events),
kept AS (SELECT * FROM raw QUALIFY lag(token) OVER (PARTITION BY inst ORDER BY o, token) IS DISTINCT FROM token),
seq AS (SELECT inst, (row_number() OVER (PARTITION BY inst ORDER BY o, token) - 1)::INT AS i, token FROM kept),
back AS (SELECT inst, i, token, (lag(i) OVER (PARTITION BY inst, token ORDER BY i) + 1)::INT AS ptr FROM seq),
hop(inst, hop, i, ptr) AS (SELECT inst, 1, i, ptr FROM back WHERE ptr IS NOT NULL UNION ALL SELECT h.inst, h.hop + 1, h.i, b.ptr FROM hop h JOIN back b ON b.inst = h.inst AND b.i = h.ptr WHERE h.hop < 3 AND b.ptr IS NOT NULL)"""


@query(f"{_SEQ} SELECT inst, i, token FROM seq")
def event_tokens(spark, sf):
    return event_sequences(spark, sf)


@query(f"{_SEQ} SELECT inst, i, token, coalesce(ptr, -1) AS ptr FROM back")
def back_pointers(spark, sf):
    return khops.back_pointers(event_sequences(spark, sf)).fillna(-1, ["ptr"])


@query(f"{_SEQ} SELECT h.inst, h.hop::INT AS hop, h.i, s.token AS value FROM hop h JOIN seq s ON s.inst = h.inst AND s.i = h.ptr")
def khops_hops(spark, sf):
    return khops.hop_table(khops.hops(event_sequences(spark, sf), 3))


@query(f"{_SEQ} SELECT h.inst, h.i, s.token AS label FROM hop h JOIN seq s ON s.inst = h.inst AND s.i = h.ptr WHERE h.hop = 3 AND h.i > 20")
def khops_targets(spark, sf):
    return khops.hop_targets(khops.hops(event_sequences(spark, sf), 3), KhopsArgs(mask_to_size=20), 5).select("inst", "i", F.get("labels", F.lit(0)).alias("label"))


_GEN = KhopsArgs(max_khops=6, min_khops=2, max_prefix_length=30, min_prefix_length=18)


def _segments(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("inst")).distinct()
    drawn = users.select("inst", F.lit(2).cast("int").alias("low")).select("inst", (F.col("low") + F.col("inst") % 5).cast("int").alias("k"), (F.lit(18) + F.col("inst") % 12).cast("int").alias("length"))
    return khop_sources.generated_segments(drawn, VOCAB.min_vocab, VOCAB.max_vocab - 1, _GEN, SEED)


@query("SELECT inst, (2 + inst % 5)::BIGINT AS segments, (18 + inst % 12 + 2 + inst % 5)::BIGINT AS tokens FROM (SELECT DISTINCT user_id AS inst FROM events)")
def khops_gen_segments(spark, sf):
    return _segments(spark, sf).groupBy("inst").agg(F.countDistinct("seg").alias("segments"), F.count("*").alias("tokens"))


@query("SELECT DISTINCT user_id AS inst, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS code FROM events")
def verify_khops(spark, sf):
    """Generated chains are right, and wrong once their first truth is changed."""
    told = khops.generated_tokens(_segments(spark, sf), VOCAB)
    truths = F.slice("task", F.lit(2), F.size("task") - 2)
    changed = F.concat(F.array(F.get(truths, F.lit(0)) + 1), F.slice(truths, F.lit(2), F.size(truths)))
    # nothing stands before the segments here, so the first place counts
    own = told.select("inst", F.col("query").alias("prefix"), F.when(F.col("inst") % 3 == 0, changed).otherwise(truths).alias("truths"))
    return verify.verify_khops(own, first=0)


_COUNT = 60


@query(f"""WITH RECURSIVE p(total, parts, most, n) AS (SELECT 1, 1, 1, 1) SELECT total::INT AS total, parts::INT AS parts, n::VARCHAR AS n FROM (
WITH RECURSIVE part(q, s, last, k) AS (SELECT f, f, f, 1 FROM (SELECT unnest(range(1, 31)) AS f) UNION ALL SELECT q, s + f, f, k + 1 FROM part, LATERAL (SELECT unnest(range(1, least(last, 30 - s) + 1)) AS f) WHERE s < 30)
SELECT s AS total, k AS parts, count(*) AS n FROM part GROUP BY ALL)""")
def int_partition_counts(spark, sf):
    """Counts of partitions by number of parts; the SQL lists every partition of every number up to 30."""
    return partitions.counts_table(spark, 30).filter("total > 0")


@query(f"""WITH RECURSIVE part(q, s, last, k) AS (SELECT f, f, f, 1 FROM (SELECT unnest(range(1, 31)) AS f) UNION ALL SELECT q, s + f, f, k + 1 FROM part, LATERAL (SELECT unnest(range(1, least(last, 30 - s) + 1)) AS f) WHERE s < 30),
n AS (SELECT s, k, count(*)::VARCHAR AS n FROM part GROUP BY ALL), e AS (SELECT event_type, (count(*) % 30 + 1)::INT AS total FROM events GROUP BY ALL)
SELECT event_type, total, k AS parts, n, {draw_sql(SEED, "event_type", "k")} AS drawn FROM e JOIN n ON n.s = e.total""")
def partitions_lateral(spark, sf):
    """SQL names: a table function behind a lateral join, and draws."""
    names.register(spark)
    asked = table(spark, sf, "events").groupBy("event_type").agg((F.count("*") % 30 + 1).cast("int").alias("total"))
    drawn = f"graph_draw({SEED}, concat_ws(':', e.event_type, p.parts))"
    return spark.sql(f"SELECT e.event_type, e.total, p.parts, p.n, {drawn} AS drawn FROM {{asked}} e, LATERAL partition_counts(e.total) p", asked=asked)


# -------------------------------------------------------------------------------------------------------------- sources
_BATCH = 64


@query(f"""WITH inst AS (SELECT i AS inst, 15 + {draw_sql(SEED, "'n'", "i")} % 11 AS n FROM range({_BATCH}) t(i)),
pairs AS (SELECT inst, n, u, v FROM inst, LATERAL (SELECT unnest(range(n)) AS u), LATERAL (SELECT unnest(range(u + 1, n)) AS v))
SELECT inst, (row_number() OVER (PARTITION BY inst ORDER BY u, v) - 1)::INT AS edge_idx, u::INT AS u, v::INT AS v FROM pairs WHERE {draw_sql(SEED, "'er'", "inst", "u", "v")} / 4294967296.0 < 1.0 / n""")
def er_edges(spark, sf):
    return random_graphs.erdos_renyi(random_graphs.instances(spark, _BATCH, 15, 25, SEED), seed=SEED)


@query("""WITH p AS (SELECT label::BIGINT AS inst, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS node, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT a.inst, (row_number() OVER (PARTITION BY a.inst ORDER BY a.node, b.node) - 1)::INT AS edge_idx, a.node AS u, b.node AS v FROM p a JOIN p b ON a.inst = b.inst AND a.node < b.node AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 0.05""")
def euclid_edges(spark, sf):
    """Vectors of one label are a point set, by their first two components."""
    points = tables.points_from(table(spark, sf, "embeddings"), F.col("label"), F.col("vec_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 2))
    return random_graphs.euclidean(points, 0.05)


@query(f"""SELECT i AS inst, (v - 1)::INT AS edge_idx, ((v - 1) // 3)::INT AS u, v::INT AS v FROM range({_BATCH}) t(i), LATERAL (SELECT unnest(range(1, 15 + {draw_sql(SEED, "'n'", "i")} % 11)) AS v)""")
def full_tree_edges(spark, sf):
    return shaped_graphs.full_tree_edges(random_graphs.instances(spark, _BATCH, 15, 25, SEED), 3)


@query(f"""WITH s AS (SELECT i AS inst, 2 + {draw_sql(SEED, "'arms'", "i")} % 4 AS arms, 5 + {draw_sql(SEED, "'length'", "i")} % 6 AS len FROM range({_BATCH}) t(i))
SELECT inst, e::INT AS edge_idx, CASE WHEN e % (len - 1) = 0 THEN 0 ELSE e END::INT AS u, (e + 1)::INT AS v FROM s, LATERAL (SELECT unnest(range(arms * (len - 1))) AS e)""")
def path_star_edges(spark, sf):
    return shaped_graphs.path_stars(spark, _BATCH, (2, 5), (5, 10), SEED)[0]


def _ahead(spark):
    return random_graphs.instances(spark, _BATCH, 30, 40, SEED).withColumn("lookahead", (F.col("inst") % 3 + 3).cast("int"))


@query(f"""SELECT i AS inst, (i % 3 + 3)::INT AS edges, 1::BIGINT AS begin_ FROM range({_BATCH}) t(i)""")
def balanced_arms(spark, sf):
    """The true path of each balanced graph; the other arms' rules are tested by invariants."""
    arms = shaped_graphs.balanced_arms(_ahead(spark), seed=SEED).filter("arm = 0")
    return arms.select("inst", F.col("length").alias("edges"), F.col("begin").cast("long").alias("begin_"))


@query()
def balanced_edges(spark, sf):
    return shaped_graphs.balanced(_ahead(spark), seed=SEED)[0]


@query()
def random_tree_edges(spark, sf):
    return shaped_graphs.random_trees(random_graphs.instances(spark, _BATCH, 15, 25, SEED), seed=SEED)[0]


@query(f"""SELECT i AS inst, (14 + {draw_sql(SEED, "'n'", "i")} % 11 >= 14) AS connected FROM range({_BATCH}) t(i)""")
def connected_graphs(spark, sf):
    """Independent edges, tied together: every graph is one component."""
    nodes = random_graphs.instances(spark, _BATCH, 15, 25, SEED)
    edges = random_graphs.connect_random(nodes, random_graphs.erdos_renyi(nodes, seed=SEED), seed=SEED)
    reach = measures.components(D.distances(edges, every_node=nodes)).groupBy("inst").agg((F.count_distinct("component") == 1).alias("connected"))
    return reach


# -------------------------------------------------------------------------------------------------- reports and streams
@query(f"""WITH {_EDGES}, g AS (SELECT inst, CASE WHEN inst % 2 = 0 THEN 'even' ELSE 'odd' END AS graph_type, CASE WHEN count(*) >= 20 THEN 'dense' ELSE 'sparse' END AS task_type, count(*) AS e FROM edges GROUP BY inst)
SELECT coalesce(graph_type, 'all') AS graph_type, coalesce(task_type, 'all') AS task_type, count(*) AS instances, round(avg(e), 6) AS edges FROM g GROUP BY ROLLUP (graph_type, task_type)""")
def profile_rollup(spark, sf):
    size = lineitem_edges(spark, sf).groupBy("inst").agg(F.count("*").alias("e"))
    kind = size.select(F.when(F.col("inst") % 2 == 0, "even").otherwise("odd").alias("graph_type"), F.when(F.col("e") >= 20, "dense").otherwise("sparse").alias("task_type"), F.lit(NODES).alias("n"), "e")
    return measures.profile(kind).fillna("all", ["graph_type", "task_type"]).select("graph_type", "task_type", "instances", F.round("edges", 6).alias("edges"))


@query(f"""WITH {_EDGES}, g AS (SELECT inst, CASE WHEN inst % 2 = 0 THEN 'even' ELSE 'odd' END AS graph_type, CASE WHEN count(*) >= 20 THEN 'dense' ELSE 'sparse' END AS task_type, count(*) AS e FROM edges GROUP BY inst)
SELECT coalesce(graph_type, 'all') AS graph_type, coalesce(task_type, 'all') AS task_type, count(*) AS instances, 1::BIGINT AS sizes, round(avg(e), 6) AS edges FROM g GROUP BY CUBE (graph_type, task_type)""")
def profile_cube(spark, sf):
    size = lineitem_edges(spark, sf).groupBy("inst").agg(F.count("*").alias("e"))
    kind = size.select(F.when(F.col("inst") % 2 == 0, "even").otherwise("odd").alias("graph_type"), F.when(F.col("e") >= 20, "dense").otherwise("sparse").alias("task_type"), F.lit(NODES).alias("n"), "e")
    return measures.profile_cube(kind).fillna("all", ["graph_type", "task_type"]).select("graph_type", "task_type", "instances", "sizes", F.round("edges", 6).alias("edges"))


@query(f"""WITH {_EDGES}, both_ways AS (SELECT inst, u, v FROM edges UNION ALL SELECT inst, v, u FROM edges) SELECT * FROM both_ways EXCEPT ALL SELECT inst, least(u, v), greatest(u, v) FROM edges""")
def edges_left_over(spark, sf):
    """What edges told both ways hold beyond each edge from its smaller node."""
    edges = lineitem_edges(spark, sf)
    return measures.left_over(order.duplicated(edges).select("inst", "u", "v"), edges.select("inst", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_metrics(spark, sf):
    out = streams.windowed_metrics(table(spark, sf, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT *, sum((before IS NULL OR ts - before >= INTERVAL 1 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, count(*) AS n, count(DISTINCT g) AS sessions FROM s GROUP BY user_id""")
def user_sessions(spark, sf):
    return streams.sessions(table(spark, sf, "events")).groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("sessions"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs from a table, distances, a shortest path each with all its labels, as tokens."""
    edges, _, way = _told(spark, sf)
    out = paths.path_tokens(way, None, paths.node_tokens(_node_map(edges)), VOCAB)
    return out.select("inst", _joined("query", " ").alias("query"), _joined("task", " ").alias("task"), F.array_join(F.transform("targets", lambda r: _joined(r)), " ").alias("targets"), "difficulty")
