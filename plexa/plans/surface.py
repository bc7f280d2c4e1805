"""More queries: readers that read back what was written, views, levels, refinement, the tools by name.

A query of invariants gives one row an invariant; its SQL says what must hold, with the numbers
that SQL can work out itself."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colors, signal, stats
from ..model import Graph
from ..operators import coarsen, layout, metrics, ordering, partition, spectral
from ..sources import generators, readers, tables
from .catalog import Catalog
from .iterate import cut, folder
from .queries import COPURCHASE, QUERIES, SQL, SUCCESSION, TRADE, _betweenness_sql, _CLUSTERING, _kcore_sql, _long, _places, _PLACES, _rgb, _six, _stops_sql, query

__all__ = ["QUERIES", "SQL"]

_HOLDS = "invariant string, holds boolean"


def _all_hold(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS invariant, true AS holds" for n in names)


# ---- readers


def _written(lines: DataFrame, extension: str) -> str:
    """One text file of ``lines`` (at, value) in their order, in the shared folder."""
    spark = lines.sparkSession
    path = f"{folder(spark)}/plexa-{uuid.uuid4().hex}"
    lines.coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in files.listStatus(hadoop(path)) if s.getPath().getName().startswith("part-"))
    files.rename(part, hadoop(f"{path}/graph{extension}"))
    return f"{path}/graph{extension}"


def _lines(spark: SparkSession, edges: DataFrame, line, before: list[str], after: list[str]) -> DataFrame:
    """at, value: ``before``, a line an edge, ``after``."""
    own = lambda texts, start: spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "at long, value string")
    body = edges.select((F.lit(1 << 20) + F.xxhash64("src", "dst").bitwiseAND(F.lit((1 << 40) - 1))).alias("at"), line.alias("value"))
    return own(before, 0).unionAll(body).unionAll(own(after, 1 << 50))


def _labelled(graph: Graph) -> DataFrame:
    one, two = (graph.vertices.select(F.col("id").alias(i), F.col("label").alias(n)) for i, n in (("src", "a"), ("dst", "b")))
    return graph.edges.join(one, "src").join(two, "dst").select("a", "b", F.bround("weight", 2).alias("weight"))


_TRADE_IDS = f"WITH {TRADE} SELECT CAST(src AS VARCHAR) AS a, CAST(dst AS VARCHAR) AS b, round_even(weight, 2) AS weight FROM e"


def _weight():
    return F.format_string("%.2f", "weight")


@query(f"{_TRADE_IDS} UNION ALL SELECT 'x', 'y', 0.0")
def read_edge_list(spark, sf_dir):
    """Comments, blank lines, separators, a self-loop, a weight that is no number, a repeat whose first weight counts."""
    e = tables.trade(spark, sf_dir).edges
    line = F.when(F.col("src") % 2 == 0, F.concat_ws(", ", "src", "dst", _weight())).otherwise(F.concat_ws("\t", "src", "dst", _weight()))
    path = _written(_lines(spark, e, line, ["# Directed graph", "", "% more", "x y none"], ["x y 7", "z z 1", "lonely", "// end"]), ".txt")
    return _labelled(readers.read_graph(spark, path))


@query(f"WITH {TRADE} SELECT CAST(src + 1 AS VARCHAR) AS a, CAST(dst + 1 AS VARCHAR) AS b, round_even(weight, 2) AS weight FROM e UNION ALL SELECT 'nodes', CAST(30 AS VARCHAR), 30.0")
def read_matrix_market(spark, sf_dir):
    """Entries from 1, nodes without edges, lines beyond the announced number."""
    e = tables.trade(spark, sf_dir).edges
    line = F.concat_ws(" ", F.col("src") + 2, F.col("dst") + 2, _weight())
    before = ["%%MatrixMarket matrix coordinate real general", "% nations", f"30 30 {e.count()}"]
    g = readers.read_graph(spark, _written(_lines(spark, e, line, before, ["1 1 3.0", "1 2 3.0"]), ".mtx"))
    return _labelled(g).unionAll(g.vertices.agg(F.lit("nodes"), F.count("*").cast("string"), F.count("*").cast("double")))


_TRADE_NAMES = f"WITH {TRADE} SELECT s.n_name AS a, d.n_name AS b, round_even(weight, 2) AS weight FROM e JOIN nation s ON s.n_nationkey = src JOIN nation d ON d.n_nationkey = dst"


@query(_TRADE_NAMES)
def read_gml(spark, sf_dir):
    """Labels, comments, nested blocks, an edge to an unknown node, a second graph."""
    g = tables.trade(spark, sf_dir)
    nodes = [f'  node [ id {r["id"]} label "{r["label"]}" graphics [ x 1 y 2 ] ]' for r in g.vertices.orderBy("id").collect()]  # nations, a fixed table
    line = F.format_string("  edge [ source %d target %d weight %.2f ]", "src", "dst", "weight")
    before, after = ["# nations", "graph [", "  directed 1", *nodes], ["  edge [ source 0 target 999 ]", "]", "graph [ node [ id 7 ] node [ id 8 ] edge [ source 7 target 8 ] ]"]
    return _labelled(readers.read_graph(spark, _written(_lines(spark, g.edges, line, before, after), ".gml")))


@query(_TRADE_NAMES)
def read_graphml(spark, sf_dir):
    """Keys for labels and weights, an edge to an unknown node, a second graph."""
    g = tables.trade(spark, sf_dir)
    nodes = [f'<node id="n{r["id"]}"><data key="k0">{r["label"]}</data></node>' for r in g.vertices.orderBy("id").collect()]  # nations, a fixed table
    line = F.format_string('<edge source="n%d" target="n%d"><data key="k1">%.2f</data></edge>', "src", "dst", "weight")
    keys = ['<key id="k0" for="node" attr.name="label" attr.type="string"/>', '<key id="k1" for="edge" attr.name="weight" attr.type="double"/>']
    before = ['<?xml version="1.0"?>', "<graphml>", *keys, '<graph edgedefault="directed">', *nodes]
    after = ['<edge source="n0" target="n999"/>', "</graph>", '<graph edgedefault="undirected"><node id="n0"/><node id="m"/><edge source="n0" target="m"/></graph>', "</graphml>"]
    return _labelled(readers.read_graph(spark, _written(_lines(spark, g.edges, line, before, after), ".graphml")))


@query(f"WITH {TRADE} SELECT '.' || x AS extension, count(*) AS files FROM (SELECT unnest(['csv', 'gml', 'mtx']) AS x) GROUP BY 1 ORDER BY 1")
def find_graph_files(spark, sf_dir):
    e = tables.trade(spark, sf_dir).edges
    paths = [_written(_lines(spark, e, F.concat_ws(",", "src", "dst"), [], []), x) for x in (".csv", ".gml", ".mtx", ".dat")]
    found = [readers.find_graph_files(spark, p.rpartition("/")[0]) for p in paths]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionAll(more)
    return whole.groupBy("extension").agg(F.count("*").alias("files"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey < 10 THEN upper(chr(97 + n_nationkey)) ELSE n_name END AS label FROM nation")
def sidecar_labels(spark, sf_dir):
    """Labels from a text file beside the graph; vertices beyond its lines keep theirs."""
    g = tables.trade(spark, sf_dir)
    names = spark.range(10).select(F.col("id").alias("at"), F.upper(F.char(F.col("id") + 97)).alias("value"))
    return readers.with_labels(g, _written(names, ".txt")).vertices.select("id", "label")


# ---- generators


def _generated(name: str, edges: str):
    return f"SELECT '{name}' AS invariant, {edges} AS edges, true AS simple"


@query(" UNION ALL ".join((_generated("sparse", "0"), _generated("certain", "(SELECT count(*) FROM range(60) a(i) JOIN range(60) b(j) ON i < j)"), _generated("growing", "6 + (200 - 4) * 3"), _generated("rewired", "200 * 4 // 2"))))
def generated_graphs(spark, sf_dir):
    """Edges of random graphs whose number is known; simple: least end first, and nothing twice."""
    made = {
        "sparse": generators.erdos_renyi(spark, 60, 0.0), "certain": generators.erdos_renyi(spark, 60, 1.0),
        "growing": generators.barabasi_albert(spark, 200, 3), "rewired": generators.watts_strogatz(spark, 200, 4, 0.3),
    }
    rows = [(k, g.n_edges, g.edges.where("src >= dst").isEmpty() and g.edges.select("src", "dst").distinct().count() == g.n_edges) for k, g in made.items()]
    return spark.createDataFrame(rows, "invariant string, edges long, simple boolean")


@query("SELECT 'same again' AS invariant, true AS holds UNION ALL SELECT 'other seed, other graph', true UNION ALL SELECT 'near the expected number', true")
def random_by_hash(spark, sf_dir):
    """The same seed gives the same graph, another seed another; 190 of 1,900 pairs or so (six deviations: 80)."""
    pairs = lambda seed: {(r["src"], r["dst"]) for r in generators.erdos_renyi(spark, 62, 0.1, seed).edges.collect()}
    a, b, c = pairs(42), pairs(42), pairs(43)
    return spark.createDataFrame([("same again", a == b), ("other seed, other graph", a != c), ("near the expected number", abs(len(a) - 189) < 80)], _HOLDS)


# ---- views

_SCREEN = f"WITH {SUCCESSION}, {_PLACES}, s AS (SELECT id, x, y, x * 3 - 60 AS sx, y * 3 - 90 AS sy FROM pl)"


def _screen(spark, sf_dir) -> tuple[Graph, DataFrame]:
    g = tables.succession(spark, sf_dir)
    return g, ordering.on_screen(_places(g), 3.0, -60.0, -90.0)


@query(f"{_SCREEN} SELECT id FROM s WHERE sx BETWEEN -50 AND 150 AND sy BETWEEN -50 AND 110")
def viewport_nodes(spark, sf_dir):
    _, at = _screen(spark, sf_dir)
    return at.where(ordering.visible(at, 100, 60)).select("id")


@query(
    f"{_SCREEN}, g AS (SELECT e.src, e.dst, a.sx AS ax, a.sy AS ay, b.sx AS bx, b.sy AS bey FROM e JOIN s a ON a.id = src JOIN s b ON b.id = dst), "
    f"o AS (SELECT src, dst, ax BETWEEN 0 AND 100 AND ay BETWEEN 0 AND 60 OR bx BETWEEN 0 AND 100 AND bey BETWEEN 0 AND 60 AS inside, "
    "sign((bx - ax) * (0 - ay) - (bey - ay) * (0 - ax)) AS c1, sign((bx - ax) * (0 - ay) - (bey - ay) * (100 - ax)) AS c2, sign((bx - ax) * (60 - ay) - (bey - ay) * (0 - ax)) AS c3, sign((bx - ax) * (60 - ay) - (bey - ay) * (100 - ax)) AS c4, "
    "greatest(ax, bx) >= 0 AND least(ax, bx) <= 100 AND greatest(ay, bey) >= 0 AND least(ay, bey) <= 60 AS boxes FROM g) "
    "SELECT src, dst FROM o WHERE inside OR (boxes AND least(c1, c2, c3, c4) <= 0 AND greatest(c1, c2, c3, c4) >= 0)"
)
def viewport_edges(spark, sf_dir):
    """The edges that meet the view; the SQL asks on which sides of the edge the view's corners lie."""
    g, at = _screen(spark, sf_dir)
    one, two = (at.select(F.col("id").alias(i), F.col("sx").alias(f"{i}x"), F.col("sy").alias(f"{i}y")) for i in ("src", "dst"))
    both = g.edges.join(one, "src").join(two, "dst")
    return both.where(ordering.crosses(F.col("srcx"), F.col("srcy"), F.col("dstx"), F.col("dsty"), 100.0, 60.0)).select("src", "dst")


@query(f"{_SCREEN} SELECT id, greatest(0, least(100, sx)) AS cx, greatest(0, least(60, sy)) AS cy, round_even((sx + 60) / 3, 9) AS x, round_even((sy + 90) / 3, 9) AS y FROM s")
def off_screen(spark, sf_dir):
    """Places moved to the view's border, and back in the world."""
    _, at = _screen(spark, sf_dir)
    cx, cy = ordering.clamped(100.0, 60.0)
    back = ordering.in_world(at.drop("x", "y"), 3.0, -60.0, -90.0)
    return back.select("id", cx.alias("cx"), cy.alias("cy"), F.bround("x", 9).alias("x"), F.bround("y", 9).alias("y"))


@query(
    f"{_SCREEN}, b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), 1) AS w, greatest(max(y) - min(y), 1) AS h, least(132 / greatest(max(x) - min(x), 1), 132 / greatest(max(y) - min(y), 1)) AS f FROM pl) "
    "SELECT id, round_even((x - x0) * f + 500 + 4 + (132 - w * f) / 2, 6) AS mx, round_even((y - y0) * f + 300 + 4 + (132 - h * f) / 2, 6) AS my FROM pl, b"
)
def minimap(spark, sf_dir):
    return ordering.minimap(_places(tables.succession(spark, sf_dir)), 500, 300).select("id", _six("mx", "mx"), _six("my", "my"))


@query(f"WITH {SUCCESSION} SELECT id, 4 + least(0.3 * degree, 6) AS radius FROM deg")
def node_radius(spark, sf_dir):
    return metrics.degree(tables.succession(spark, sf_dir)).select("id", F.col("value").alias("degree")).select("id", ordering.radius(4.0).alias("radius"))


@query("WITH t AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN 'x' || l_partkey ELSE CAST(l_partkey - 20 AS VARCHAR) END AS value FROM lineitem) SELECT DISTINCT try_cast(value AS BIGINT) AS id FROM t WHERE try_cast(value AS BIGINT) BETWEEN 0 AND 49")
def selection_bounds(spark, sf_dir):
    """Of texts as ids those that are numbers from 0 to 49."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("x"), F.col("l_partkey").cast("string"))).otherwise((F.col("l_partkey") - 20).cast("string"))
    return ordering.parse_selection(item.select(text.alias("value")), 50)


_BY_DEGREE = f"WITH {SUCCESSION}, o AS (SELECT id, row_number() OVER (ORDER BY degree DESC, id) - 1 AS p, count(*) OVER () AS n FROM deg)"


@query(f"{_BY_DEGREE} SELECT r AS role, id FROM o, (VALUES ('column', 3.0 / 64), ('row', 40.0 / 48)) v(r, f) WHERE p = CAST(trunc(f * n) AS BIGINT) UNION ALL SELECT 'view ' || r, id FROM o, (VALUES ('column', 5 + 3.0 / 64 * 20), ('row', 7 + 40.0 / 48 * 20)) v(r, c) WHERE p = CAST(trunc(c) AS BIGINT)")
def pixel_vertices(spark, sf_dir):
    """The vertices under a pixel, of the whole matrix and of a part of it."""
    g = tables.succession(spark, sf_dir)
    order = ordering.order_by(g, "degree")
    part = ordering.at_pixel(order, 3, 40, 64, 48, g.size, (5.0, 7.0, 20.0, 20.0))
    return ordering.at_pixel(order, 3, 40, 64, 48, g.size).unionAll(part.select(F.concat(F.lit("view "), "role"), "id"))


@query(
    "WITH RECURSIVE v AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(n AS DOUBLE) AS size, n FROM (SELECT count(*) AS n FROM part) UNION ALL "
    "SELECT step + 1, least(greatest(CASE WHEN step % 3 = 2 THEN x + size * 0.25 ELSE n * 0.7 - (n * 0.7 - x) * z / size END, 0), n - z), least(greatest(CASE WHEN step % 3 = 2 THEN y - size * 0.5 ELSE n * 0.2 - (n * 0.2 - y) * z / size END, 0), n - z), z, n "
    "FROM (SELECT *, CASE WHEN step % 3 = 2 THEN size ELSE least(greatest(size * CASE WHEN step % 3 = 0 THEN 0.8 ELSE 1.25 END, least(20, n)), n) END AS z FROM v) WHERE step < 12) "
    "SELECT CAST(step AS BIGINT) AS step, round_even(x, 6) AS x, round_even(y, 6) AS y, round_even(size, 6) AS size FROM v"
)
def zoom_and_pan(spark, sf_dir):
    """A view of a matrix of all parts: zoomed in, zoomed out, and moved, four times."""
    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    view, rows = (0.0, 0.0, float(n)), []
    for step in range(13):
        rows.append((step, *map(float, view)))
        view = ordering.panned(view, n, 0.25, -0.5) if step % 3 == 2 else ordering.zoomed(view, n, n * 0.7, n * 0.2, step % 3 == 0)
    return spark.createDataFrame(rows, "step long, x double, y double, size double").select("step", *(_six(c, c) for c in ("x", "y", "size")))


# ---- levels and matchings


def _thirds(g: Graph) -> list:
    """Two levels whose mappings SQL can write down: id // 3, and that // 4."""
    one = g.vertices.select(F.col("id").alias("fine_id"), F.floor(F.col("id") / 3).alias("coarse_id"))
    two = one.select(F.col("coarse_id").alias("fine_id"), F.floor(F.col("coarse_id") / 4).alias("coarse_id")).distinct()
    return [(None, one), (None, two)]


@query(f"WITH {COPURCHASE} SELECT id, id // 3 // 4 AS coarse FROM v")
def map_up(spark, sf_dir):
    g = tables.copurchase(spark, sf_dir)
    return coarsen.map_up(_thirds(g), g.vertices.select("id"), 0, 2)


@query(f"WITH {COPURCHASE}, c AS (SELECT DISTINCT id // 3 // 4 AS id FROM v) SELECT c.id, v.id AS fine FROM c JOIN v ON v.id // 3 // 4 = c.id")
def map_down(spark, sf_dir):
    g = tables.copurchase(spark, sf_dir)
    levels = _thirds(g)
    return coarsen.map_down(levels, levels[1][1].select(F.col("coarse_id").alias("id")).distinct(), 2, 0)


@query(" UNION ALL ".join(f"SELECT '{s.value}' AS strategy, '{i}' AS invariant, true AS holds" for s in coarsen.Strategy for i in ("symmetric", "pairs near", "maximal")))
def matchings(spark, sf_dir):
    """Every strategy: pairs are mutual, neighbours or (HEMSR, HEMSRDEG) neighbours of one vertex, and no edge is left between two free vertices."""
    g = tables.copurchase(spark, sf_dir)
    near = g.adj.select("id", F.col("nbr").alias("partner")).distinct()
    rows = []
    for s in coarsen.Strategy:
        m = coarsen.match(g, s).cache()
        pairs = m.where("id <> partner")
        apart = pairs.join(near, ["id", "partner"], "left_anti")
        if s in (coarsen.Strategy.HEMSR, coarsen.Strategy.HEMSRDEG):
            hubs = near.select("id", F.col("partner").alias("hub"))
            apart = apart.join(hubs, "id").join(hubs.select(F.col("id").alias("partner"), F.col("hub").alias("other")), "partner").groupBy("id", "partner").agg(F.max(F.col("hub") == F.col("other")).alias("brothers")).where("not brothers")
        free = m.where("id = partner").select("id")
        loose = g.edges.join(free.withColumnRenamed("id", "src"), "src", "left_semi").join(free.withColumnRenamed("id", "dst"), "dst", "left_semi")
        back = m.select(F.col("id").alias("partner"), F.col("partner").alias("id"))
        rows += [(s.value, "symmetric", m.join(back, ["id", "partner"], "left_anti").isEmpty()), (s.value, "pairs near", apart.isEmpty()), (s.value, "maximal", loose.isEmpty())]
        m.unpersist()
    return spark.createDataFrame(rows, "strategy string, invariant string, holds boolean")


@query(f"WITH {COPURCHASE} SELECT 'vertices of every level' AS invariant, (SELECT count(*) FROM v) AS value UNION ALL SELECT 'weight of every level and inside', (SELECT CAST(sum(weight) AS BIGINT) FROM e) UNION ALL SELECT 'levels that grow', 0")
def hierarchy_invariants(spark, sf_dir):
    """Levels lose no vertex and, with the edges inside coarse vertices, no weight."""
    g = tables.copurchase(spark, sf_dir)
    levels = coarsen.hierarchy(g)
    total = g.edges.agg(F.sum("weight")).first()[0]
    sizes = [g.size, *(c.size for c, _ in levels)]
    vertices = {int(c.vertices.agg(F.sum("vweight")).first()[0]) for c, _ in levels}
    whole, fine = set(), g
    for coarse, mapping in levels:
        inside = partition.edge_cut(fine, mapping.select(F.col("fine_id").alias("id"), F.col("coarse_id").alias("side"))).first()[0]
        left = coarse.edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        whole.add(int(total - (inside - left)))
        fine = coarse
    rows = [("vertices of every level", max(vertices) if len(vertices) == 1 else -1), ("weight of every level and inside", max(whole) if len(whole) == 1 else -1), ("levels that grow", sum(b >= a for a, b in zip(sizes, sizes[1:], strict=False)))]
    return spark.createDataFrame(rows, "invariant string, value long")


# ---- partitions


@query(" UNION ALL ".join(f"SELECT '{m}' AS refinement, '{i}' AS invariant, true AS holds" for m in ("QP", "FM") for i in ("all placed", "cut no larger", "balance kept")))
def refinements(spark, sf_dir):
    """The distributed rounds on the split by parity."""
    g = tables.copurchase(spark, sf_dir)
    side = g.vertices.select("id", (F.col("id") % 2 == 1).alias("side"))
    before, options, rows = partition.edge_cut(g, side).first()[0], partition.Options(qp_rounds=3, fm_passes=1), []
    for name, refine in (("QP", partition.qp_refine), ("FM", partition.fm_refine)):
        new = refine(g, side, options)
        f = partition.imbalance(new).first()
        rows += [(name, "all placed", f["size_a"] + f["size_b"] == g.size), (name, "cut no larger", partition.edge_cut(g, new).first()[0] <= before), (name, "balance kept", f["imbalance"] <= 1.26)]
    return spark.createDataFrame(rows, "refinement string, invariant string, holds boolean")


@query(" UNION ALL ".join(f"SELECT '{o}' AS options, true AS both_sides, true AS balanced" for o in ("random matching", "coarse limit 10", "a third", "threshold 1")))
def bisect_options(spark, sf_dir):
    """The options decide how a split is made; it stays within the tolerance around its target."""
    g = tables.copurchase(spark, sf_dir)
    rows = []
    for name, o in (("random matching", partition.Options(strategy=coarsen.Strategy.RANDOM)), ("coarse limit 10", partition.Options(coarse_limit=10)), ("a third", partition.Options(split=1 / 3)), ("threshold 1", partition.Options(threshold=1.0))):
        f = partition.imbalance(partition.bisect(g, o)).first()
        low, high = (o.split * g.size * (1 + s * o.tolerance) for s in (-1, 1))
        rows.append((name, min(f["size_a"], f["size_b"]) > 0, low - 1 <= f["size_a"] <= high + 1))
    return spark.createDataFrame(rows, "options string, both_sides boolean, balanced boolean")


# ---- layout and spectra

_SUPPLIERS = "pl AS (SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS x, CAST(s_suppkey * 53 % 97 AS DOUBLE) AS y FROM supplier)"


@query(
    f"WITH {_SUPPLIERS} SELECT a.id, round_even(sum((a.x - b.x) * 100 / greatest((a.x - b.x)**2 + (a.y - b.y)**2, 1e-4)), 5) AS fx, round_even(sum((a.y - b.y) * 100 / greatest((a.x - b.x)**2 + (a.y - b.y)**2, 1e-4)), 5) AS fy FROM pl a JOIN pl b ON a.id <> b.id GROUP BY a.id"
)
def cells_opened(spark, sf_dir):
    """Repulsion by quadtree cells that are always opened: that of all pairs."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("id"))
    at = s.select("id", (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 97).cast("double").alias("y"))
    return layout.repulsion(at, layout.EXACT + 1, 10.0, theta=0.0).select("id", F.bround("fx", 5).alias("fx"), F.bround("fy", 5).alias("fy"))


@query(f"WITH {SUCCESSION}, {_PLACES} SELECT id, round_even(x + (id // 4 - x) * 0.84375, 6) AS x, round_even(y + (id // 5 - y) * 0.84375, 6) AS y FROM (SELECT pl.id, p.id * 2.0 AS x, p.id * 3.0 AS y FROM pl JOIN (SELECT DISTINCT id // 6 AS id FROM v) p ON p.id = pl.id // 6)")
def layout_between(spark, sf_dir):
    """Three quarters of the way from the parents' places to the children's."""
    g = tables.succession(spark, sf_dir)
    mapping = g.vertices.select(F.col("id").alias("fine_id"), F.floor(F.col("id") / 6).alias("coarse_id"))
    parents = mapping.select(F.col("coarse_id").alias("id")).distinct().select("id", (F.col("id") * 2.0).alias("x"), (F.col("id") * 3.0).alias("y"))
    children = g.vertices.select("id", F.floor(F.col("id") / 4).cast("double").alias("x"), F.floor(F.col("id") / 5).cast("double").alias("y"))
    return layout.between(parents, children, mapping, 0.75).select("id", _six("x", "x"), _six("y", "y"))


@query(f"WITH {SUCCESSION} SELECT mode, (SELECT count(*) FROM v) AS placed, true AS finite, true AS apart FROM (VALUES ('flat'), ('multilevel'), ('start')) m(mode)")
def layouts(spark, sf_dir):
    """All vertices get a place of their own, by every mode; the random start lies in its disc."""
    g = tables.succession(spark, sf_dir)
    start = layout.scatter(g)
    rows = []
    for mode, at in (("flat", layout.flat(g, rounds=2)), ("multilevel", layout.multilevel(g, coarse_rounds=100, refine_rounds=1)), ("start", start)):
        at = at.cache()
        finite = at.where("isnan(x) or isnan(y) or x is null or y is null or abs(x) = double('Infinity')").isEmpty()
        if mode == "start":
            finite &= at.where(F.col("x") ** 2 + F.col("y") ** 2 > 100.0 * g.size).isEmpty()
        rows.append((mode, at.count(), finite, at.select("x", "y").distinct().count() > 0.9 * g.size))
        at.unpersist()
    return spark.createDataFrame(rows, "mode string, placed long, finite boolean, apart boolean")


@query(f"WITH {COPURCHASE}, p AS (SELECT id, nbr, count(*) AS c FROM adj GROUP BY 1, 2) SELECT count(*) AS eigenvalues, round_even((SELECT sum(degree) FROM deg), 3) AS trace, round_even((SELECT sum(degree * degree) FROM deg) + (SELECT sum(c * c) FROM p), 3) AS squares, true AS ascending FROM v")
def eigenvalues(spark, sf_dir):
    """Their number, sum and sum of squares, which the Laplacian's entries give as well."""
    found = spectral.eigenvalues(tables.copurchase(spark, sf_dir))
    row = (len(found), round(sum(found), 3), round(sum(x * x for x in found), 3), found == sorted(found) and found[0] > -1e-6)
    return spark.createDataFrame([row], "eigenvalues long, trace double, squares double, ascending boolean")


@query(_all_hold("mean 0", "length 1", "eigenvector", "first entry positive", "ordered by it"))
def fiedler_invariants(spark, sf_dir):
    g = tables.succession(spark, sf_dir)
    f = spectral.fiedler(g).cache()
    mean, norm, lead = f.agg(F.avg("value"), F.sum(F.col("value") * F.col("value")), F.min_by("value", F.when(F.abs("value") > 1e-9, F.col("id")))).first()
    least = spectral.rayleigh(g, f).first()[0]
    rest = spectral.product(g, f).withColumnRenamed("value", "l").join(f, "id").agg(F.sum((F.col("l") - least * F.col("value")) ** 2)).first()[0]
    order = spectral.order(g, f).join(f, "id").cache()
    after = order.select((F.col("position") - 1).alias("position"), F.col("value").alias("next"))
    sorted_ = order.join(after, "position").where("value > next").isEmpty() and order.agg(F.max("position")).first()[0] == g.size - 1
    rows = [("mean 0", abs(mean) < 1e-9), ("length 1", abs(norm - 1) < 1e-6), ("eigenvector", rest < 1e-10), ("first entry positive", lead > 0), ("ordered by it", sorted_)]
    return spark.createDataFrame(rows, _HOLDS)


# ---- statistics, communities, colours


@query("SELECT o_orderpriority AS k, o_orderkey AS o, round_even(CAST(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE), 2) AS total FROM orders")
def running_sum(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.col("o_orderpriority").alias("k"), F.col("o_orderkey").alias("o"), F.col("o_totalprice").cast("double").alias("q"))
    return signal.running(rows, "k", "o", "q").select("k", "o", F.bround("total", 2).alias("total"))


@query(f"WITH {SUCCESSION} SELECT count(*) AS count, CAST(3 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS variance, true AS no_skewness, true AS no_kurtosis, CAST(3 AS DOUBLE) AS median FROM v")
def describe_constant(spark, sf_dir):
    """Moments of a constant: no variance, and skewness and kurtosis undefined."""
    found = stats.describe(tables.succession(spark, sf_dir).vertices.select(F.lit(3.0).alias("value")))
    return found.select("count", "mean", "variance", F.col("skewness").isNull().alias("no_skewness"), F.col("kurtosis").isNull().alias("no_kurtosis"), "median")


#: Leaves out one edge after the other and sees whether its ends still hang together.
SQL["bridges"] = (
    f"WITH RECURSIVE {COPURCHASE}, reach AS (SELECT src AS s, dst AS d, src AS id FROM e UNION SELECT r.s, r.d, adj.nbr FROM reach r JOIN adj ON adj.id = r.id WHERE NOT (adj.id = r.s AND adj.nbr = r.d) AND NOT (adj.id = r.d AND adj.nbr = r.s)) "
    "SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE s = src AND d = dst AND id = dst)"
)


@query(f"WITH {COPURCHASE} SELECT count(DISTINCT id % 5) AS communities FROM v")
def community_count(spark, sf_dir):
    c = Catalog(spark)
    g = tables.copurchase(spark, sf_dir)
    id_ = c.put(g)
    c.communities[id_] = g.vertices.select("id", (F.col("id") % 5).alias("community"))
    return spark.createDataFrame([(c.graph_info(id_)["communities"],)], "communities long")


def _colored(sql: str, t: str, stops) -> str:
    return f"WITH x AS ({sql}), m AS (SELECT CASE WHEN max(value) > 0 THEN max(value) ELSE 1 END AS m FROM x) SELECT id, {_stops_sql(t, stops)} FROM x, m"


@query(_colored(f"WITH {COPURCHASE}, {_CLUSTERING}".replace("round_even(CASE", "(CASE").replace("END, 6)", "END)"), "value", colors.SEQUENTIAL))
def color_clustering(spark, sf_dir):
    return _rgb(colors.node_colors(tables.copurchase(spark, sf_dir), "clustering"), "id")


@query(_colored(_kcore_sql().replace("AS core", "AS value"), "CAST(value AS DOUBLE) / m", colors.SEQUENTIAL))
def color_kcore(spark, sf_dir):
    return _rgb(colors.node_colors(tables.copurchase(spark, sf_dir), "kcore"), "id")


@query(_colored(_betweenness_sql().replace("round_even(coalesce(sum(f), 0), 4)", "coalesce(sum(f), 0)"), "round_even(sqrt(value / m), 9)", colors.HEAT))
def color_betweenness(spark, sf_dir):
    graph = tables.succession(spark, sf_dir)
    found = cut(metrics.betweenness(graph))
    most = found.agg(F.max("value")).first()[0] or 1.0
    heat = found.select("id", colors.sampled(F.bround(F.sqrt(F.col("value") / (most if most > 0 else 1.0)), 9), colors.HEAT).alias("color"))
    shown = colors.node_colors(graph, "betweenness", values=found).select("id", F.col("color").alias("own"))
    near = lambda c: F.abs(F.col(f"own.{c}") - F.col(f"color.{c}")) <= 1  # noqa: E731  a rounding at most
    return _rgb(heat.join(shown, "id").where(near("r") & near("g") & near("b")), "id")


@query(f"WITH {COPURCHASE} SELECT src, dst, CAST(120 AS BIGINT) AS r, CAST(130 AS BIGINT) AS g, CAST(150 AS BIGINT) AS b, CAST(60 AS BIGINT) AS a FROM e")
def color_edge_uniform(spark, sf_dir):
    return _rgb(colors.edge_colors(tables.copurchase(spark, sf_dir), "uniform"), "src", "dst", alpha=True)


@query(
    "SELECT * FROM (VALUES ('community', 'categorical', 'Community', NULL, NULL), ('degree', 'sequential', 'Degree', 'Low', 'High'), ('in_out_ratio', 'diverging', 'In/Out Ratio', 'Out', 'In'), ('betweenness', 'heat', 'Betweenness', 'Low', 'High'), "
    "('pagerank', 'heat', 'PageRank', 'Low', 'High'), ('clustering', 'sequential', 'Clustering', '0', '1'), ('kcore', 'sequential', 'K-Core', 'Low', 'High')) t(mode, type, label, low, high)"
)
def legends(spark, sf_dir):
    rows = [(m, *(colors.legend(m)[k] for k in ("type", "label", "low", "high"))) for m in colors.NODE_MODES]
    return spark.createDataFrame(rows, "mode string, type string, label string, low string, high string")


# ---- the tools by name


def _catalog(spark, sf_dir) -> tuple[Catalog, str]:
    c = Catalog(spark)
    return c, c.put(tables.succession(spark, sf_dir), "events")


def _rows(spark, text: str, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in json.loads(text)], schema)


@query(SQL["top_indegree"])
def tool_graph_metrics(spark, sf_dir):
    c, id_ = _catalog(spark, sf_dir)
    return _rows(spark, c.call("graph_metrics", id=id_, metric="indegree", top="20"), "id long, label string, value double")


@query(f"WITH {SUCCESSION} SELECT count(*) AS count, round_even(avg(degree), 6) AS mean, round_even(stddev_samp(degree), 6) AS sd, CAST(min(degree) AS DOUBLE) AS min, CAST(max(degree) AS DOUBLE) AS max FROM deg")
def tool_graph_stats(spark, sf_dir):
    c, id_ = _catalog(spark, sf_dir)
    return _rows(spark, c.call("graph_stats", id=id_, metric="degree"), "count long, mean double, sd double, min double, max double")


@query(SQL["histogram_degree"].replace(COPURCHASE, SUCCESSION))
def tool_graph_histogram(spark, sf_dir):
    c, id_ = _catalog(spark, sf_dir)
    return _rows(spark, c.call("graph_histogram", id=id_, metric="degree", bins=10), "bin long, low double, count long")


@query(SQL["degree_distribution"])
def tool_degree_distribution(spark, sf_dir):
    c, id_ = _catalog(spark, sf_dir)
    text = json.dumps(json.loads(c.call("graph_degree_distribution", id=id_))[0])
    return _rows(spark, text, "degree long, count long").withColumnRenamed("count", "vertices")


@query(SQL["correlate"])
def tool_graph_correlate(spark, sf_dir):
    c, id_ = _catalog(spark, sf_dir)
    return _rows(spark, c.call("graph_correlate", id=id_, metric_a="indegree", metric_b="outdegree"), "pearson double, spearman double, strength string")


@query(SQL["power_brokers"].replace("a <= 50 AND b <= 50", "a <= 40 AND b <= 40"))
def tool_find_bridges(spark, sf_dir):
    c, id_ = _catalog(spark, sf_dir)
    found = json.loads(c.call("graph_find_bridges", id=id_, metrics=["indegree", "outdegree"], top=40))
    return spark.createDataFrame([(r["id"], int(r["indegree"]), int(r["outdegree"])) for r in found], "id long, indegree long, outdegree long")


@query(SQL["neighbors"])
def tool_graph_neighbors(spark, sf_dir):
    c, id_ = _catalog(spark, sf_dir)
    first = c.graph(id_).vertices.agg(F.min("id")).first()[0]
    return _rows(spark, c.call("graph_neighbors", id=f"window:{id_}", index=first), "id long, label string, degree long")


@query(SQL["fft_peaks"])
def tool_graph_fft(spark, sf_dir):
    c, id_ = _catalog(spark, sf_dir)
    return _rows(spark, c.call("graph_fft", id=id_, metric="degree"), "index long, magnitude double")


@query(f"WITH {SUCCESSION}, c AS (SELECT id, row_number() OVER (ORDER BY degree DESC, id) AS n FROM deg) SELECT id FROM c WHERE n <= 15 AND id % 2 = 0 UNION ALL SELECT id FROM v WHERE id % 2 = 1 AND id IN (SELECT id FROM v ORDER BY id LIMIT 7) AND id NOT IN (SELECT id FROM c WHERE n <= 15)")
def tool_selection(spark, sf_dir):
    """The 15 of largest degree, then toggled by texts of odd ids, then the odd ones of the first removed."""
    c, id_ = _catalog(spark, sf_dir)
    top = [r["id"] for r in json.loads(c.call("select_top_nodes", id=id_, metric="degree", top=15))]
    least = [r["id"] for r in c.graph(id_).vertices.orderBy("id").limit(7).collect()]
    odd = [str(i) for i in least if i % 2] + ["none"]
    c.call("set_selection", id=id_, nodes=odd, mode="toggle")
    c.call("set_selection", id=id_, nodes=[i for i in top if i % 2], mode="remove")
    return _rows(spark, c.call("get_selection", id=id_), "id long")


@query("SELECT * FROM (VALUES (0, 'selection_changed'), (1, 'level_changed'), (2, 'selection_changed')) t(place, type)")
def tool_interactions(spark, sf_dir):
    """Events come in order, and once."""
    c, id_ = _catalog(spark, sf_dir)
    c.call("select_all", id=id_)
    c.levels[id_] = []
    c.call("set_coarse_level", id=id_, level=0)
    c.call("clear_selection", id=id_)
    found = json.loads(c.call("get_interactions", id=id_)) + json.loads(c.call("get_interactions", id=id_))
    return spark.createDataFrame([(i, e["type"]) for i, e in enumerate(found)], "place int, type string")


@query("SELECT * FROM (VALUES ('node_mode', 'degree'), ('edge_mode', 'community'), ('mode', 'degree'), ('ramp', 'viridis'), ('log_scale', 'False'), ('gamma', '5.0'), ('floor', '0.0')) t(setting, value)")
def tool_settings(spark, sf_dir):
    """Settings come back as set, brought into their range."""
    c, id_ = _catalog(spark, sf_dir)
    now = json.loads(c.call("set_color_mode", id=id_, node_mode="degree"))
    for tool, arguments in (("set_matrix_ordering", {"ordering": "degree"}), ("set_color_ramp", {"ramp": "viridis"}), ("set_log_scale", {"enabled": "no"}), ("set_gamma", {"gamma": "9"}), ("set_density_floor", {"floor": -1})):
        last = json.loads(c.call(tool, id=id_, **arguments))
    return spark.createDataFrame([(k, str(v)) for k, v in (now | last).items()], "setting string, value string")


@query(SQL["density_grid"].replace(COPURCHASE, SUCCESSION))
def tool_matrix(spark, sf_dir):
    c, id_ = _catalog(spark, sf_dir)
    g = c.graph(id_)
    c.put(Graph(g.vertices, g.edges, False), "both")
    c.call("set_matrix_ordering", id="both", ordering="degree")
    return _rows(spark, c.call("matrix", id="both", width=64, height=64), "px long, py long, density long")


@query(f"WITH {SUCCESSION} SELECT 'graph' AS tool, (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, true AS directed")
def tool_graph_info(spark, sf_dir):
    c, id_ = _catalog(spark, sf_dir)
    c.communities[id_] = c.graph(id_).vertices.select("id", F.lit(0).alias("community"))
    found = json.loads(c.call("get_graph_info", id=id_))
    return spark.createDataFrame([("graph", found["nodes"], found["edges"], found["directed"])], "tool string, nodes long, edges long, directed boolean")


@query("SELECT 'complete' AS kind, 20 AS nodes, 190 AS edges, 1 AS communities UNION ALL SELECT 'star', 30, 29, 1 UNION ALL SELECT 'ring_lattice', 3, 3, 1")
def tool_generate(spark, sf_dir):
    """Generated graphs come with their communities."""
    c, rows = Catalog(spark), []
    for kind, arguments in (("complete", {"n": 20}), ("star", {"n": 30}), ("ring_lattice", {"n": 3, "k": 2})):
        found = json.loads(c.call("generate", kind=kind, **arguments))
        rows.append((kind, found["nodes"], found["edges"], found["communities"]))
    return spark.createDataFrame(rows, "kind string, nodes long, edges long, communities long")


@query(" UNION ALL ".join(f"SELECT '{t}' AS tool, true AS all_placed, true AS within, true AS cut_as_told" for t in ("graph_bisect", "graph_partition")))
def tool_partitions(spark, sf_dir):
    """Tools of partitions on the copurchase graph, with arguments as text."""
    c = Catalog(spark)
    id_ = c.put(tables.copurchase(spark, sf_dir))
    g, rows = c.graph(id_), []
    for tool, more, name in (("graph_bisect", {}, "side"), ("graph_partition", {"k": "3"}, "part")):
        parts, facts = json.loads(c.call(tool, id=id_, target_split="0.5", tolerance="0.2", matching="HEM", **more))
        held = {r["id"]: r[name] for r in parts}
        cut = sum(r["weight"] for r in g.edges.collect() if held[r["src"]] != held[r["dst"]]) if g.n_edges <= 50_000 else facts["edge_cut"]
        sizes = facts.get("sizes") or [facts["size_a"], facts["size_b"]]
        rows.append((tool, len(held) == g.size == sum(sizes), min(sizes) > 0 and max(sizes) <= 0.6 * g.size + 1, abs(cut - facts["edge_cut"]) < 1e-6))
    return spark.createDataFrame(rows, "tool string, all_placed boolean, within boolean, cut_as_told boolean")
