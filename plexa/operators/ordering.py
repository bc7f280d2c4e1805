"""Orders of the vertices, the adjacency matrix as a density grid, selections and views."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.iterate import cut, ranked
from .communities import components
from .metrics import degree, metric


def top(graph: Graph, values: DataFrame, n: int = 20, ascending: bool = False, community: int | None = None) -> DataFrame:
    """The n vertices of largest (or least) value, ties by id: id, label, community, value."""
    found = graph.vertices.join(values, "id")
    if "community" not in found.columns:
        found = found.withColumn("community", F.lit(0))
    if community is not None:
        found = found.where(F.col("community") == community)
    order = F.asc("value") if ascending else F.desc("value")
    return found.orderBy(order, "id").limit(n).select("id", "label", "community", F.bround("value", 6).alias("value"))


def cross_rank(table: DataFrame, names, n: int = 20) -> DataFrame:
    """The vertices among the n largest by every one of the columns ``names``, by id."""
    names = list(names)
    if not names:
        raise ValueError("needs a metric")
    out = None
    for name in names:  # each a top-k, not a sort of all
        best = table.orderBy(F.desc(name), "id").limit(n).select("id")
        out = best if out is None else out.join(best, "id", "left_semi")
    return table.join(out, "id", "left_semi").select("id", *names).orderBy("id")


def neighbours(graph: Graph, vertex: int) -> DataFrame:
    """The vertices next to ``vertex``, once for each edge: id, label, degree, and community where the vertices have one."""
    near = graph.adj.where(F.col("id") == vertex).select(F.col("nbr").alias("id"), "eid").join(graph.vertices, "id").join(degree(graph), "id")
    return near.select("id", "label", F.col("value").cast("long").alias("degree"), *(c for c in ("community",) if c in graph.vertices.columns))


def order_by(graph: Graph, mode: str, community: DataFrame | None = None) -> DataFrame:
    """id, position: original (also for unknown modes), community (then degree), degree, bfs, spectral, or a metric's name."""
    if mode == "bfs":
        return bfs_order(graph)
    if mode == "spectral":
        from .spectral import fiedler

        return ranked(fiedler(graph), "value", "id", name="position").select("id", "position")
    if mode == "community" and community is not None:
        return ranked(degree(graph).join(community, "id"), F.col("community").asc(), F.desc("value"), F.col("id").asc(), name="position").select("id", "position")
    try:
        values = metric(graph, mode)
    except ValueError:
        return ranked(graph.vertices.select("id"), "id", name="position")
    return ranked(values, F.desc("value"), F.col("id").asc(), name="position").select("id", "position")


def bfs_order(graph: Graph) -> DataFrame:
    """id, position: breadth-first from the vertex of largest degree, then the other components
    by least id. A level is ordered by the parents' places, then the edges' ids."""
    comp = cut(components(graph).join(degree(graph), "id"))
    start = comp.orderBy(F.desc("value"), "id").limit(1).select(F.col("id").alias("root"), "component", F.lit(0).alias("first"))
    first = comp.groupBy("component").agg(F.min("id").alias("least")).join(start, "component", "left")
    front = first.select(F.coalesce("root", "least").alias("id"), F.coalesce("first", F.lit(1)).alias("turn"), F.col("least").alias("tree"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("place"))
    front = seen = cut(front)
    near = graph.adj.groupBy("id", "nbr").agg(F.min("eid").alias("eid")).cache()
    while True:
        step = front.join(near, "id").join(seen.select(F.col("id").alias("nbr")), "nbr", "left_anti")
        new = step.groupBy("nbr").agg(F.min(F.struct("turn", "tree", "place", "eid")).alias("p"), F.first("level").alias("level"))
        new = new.select(F.col("nbr").alias("id"), "p.turn", "p.tree", (F.col("level") + 1).alias("level"), F.col("p.place").alias("parent"), "p.eid")
        new = cut(new)
        if new.isEmpty():
            break
        front = cut(ranked(new, "turn", "tree", "parent", "eid", "id", name="place").select("id", "turn", "tree", "level", "place"))
        seen = cut(seen.unionAll(front))
    near.unpersist()
    return ranked(seen, "turn", "tree", "level", "place", name="position").select("id", "position")


def density(graph: Graph, order: DataFrame, width: int, height: int, view=(0.0, 0.0, None, None)) -> DataFrame:
    """px, py, density: entries of the adjacency matrix (both triangles if undirected) by pixel
    of a view (x, y, width, height in cells; whole matrix without). Places are cut towards 0."""
    n = graph.size
    x0, y0, w, h = view[0], view[1], view[2] or n, view[3] or n
    col, row = (order.select(F.col("id").alias(a), F.col("position").alias(b)) for a, b in (("dst", "col"), ("src", "row")))
    cells = graph.edges.join(row, "src").join(col, "dst").select("row", "col")
    if not graph.directed:
        cells = cells.unionAll(cells.select(F.col("col").alias("row"), F.col("row").alias("col")))
    px, py = ((F.col("col") - x0) * width / w).cast("int"), ((F.col("row") - y0) * height / h).cast("int")
    inside = f"px >= 0 and px < {width} and py >= 0 and py < {height}"
    return cells.select(px.alias("px"), py.alias("py")).where(inside).groupBy("px", "py").agg(F.count("*").alias("density"))


def community_borders(order: DataFrame, community: DataFrame) -> DataFrame:
    """Positions at which the community changes along the order."""
    at = order.join(community, "id").select("position", "community")
    before = at.select((F.col("position") + 1).alias("position"), F.col("community").alias("before"))
    return at.join(before, "position").where("community <> before").select("position")


def select(current: DataFrame, chosen: DataFrame, mode: str = "replace") -> DataFrame:
    """A selection (id) after add, remove, toggle or replace by ``chosen``."""
    if mode == "add":
        return current.unionAll(chosen).distinct()
    if mode == "remove":
        return current.join(chosen, "id", "left_anti")
    if mode == "toggle":
        return current.join(chosen, "id", "left_anti").unionAll(chosen.join(current, "id", "left_anti"))
    return chosen.distinct()


def parse_selection(text: DataFrame, n: int) -> DataFrame:
    """``text`` (value) as ids from 0 to n - 1; others are dropped."""
    return text.select(F.expr("try_cast(value as long)").alias("id")).where((F.col("id") >= 0) & (F.col("id") < n)).distinct()


def select_all(graph: Graph) -> DataFrame:
    return graph.vertices.select("id")


def box(points: DataFrame) -> DataFrame:
    """One row: the extent of x and y."""
    return points.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def group_boxes(points: DataFrame, mapping: DataFrame) -> DataFrame:
    """Extent and size of each coarse vertex's fine vertices, where there are two or more."""
    return points.join(mapping, F.col("id") == F.col("fine_id")).groupBy("coarse_id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.count("*").alias("n")).where("n > 1")


def on_screen(points: DataFrame, zoom: float, pan_x: float, pan_y: float) -> DataFrame:
    """``points`` with sx, sy: x * zoom + pan."""
    return points.withColumns({"sx": F.col("x") * zoom + pan_x, "sy": F.col("y") * zoom + pan_y})


def in_world(points: DataFrame, zoom: float, pan_x: float, pan_y: float) -> DataFrame:
    """``points`` (sx, sy) with x, y: the inverse of ``on_screen``."""
    return points.withColumns({"x": (F.col("sx") - pan_x) / zoom, "y": (F.col("sy") - pan_y) / zoom})


def minimap(points: DataFrame, left: float, top: float, size: float = 140.0) -> DataFrame:
    """id, mx, my: all points in a box of ``size`` at (left, top), with a rim of 4, to one scale and centred."""
    extent = box(points).select("min_x", "min_y", F.greatest(F.col("max_x") - F.col("min_x"), F.lit(1.0)).alias("w"), F.greatest(F.col("max_y") - F.col("min_y"), F.lit(1.0)).alias("h"))
    inner = size - 8
    scale = F.least(inner / F.col("w"), inner / F.col("h"))
    at = lambda c, low, span, start: (F.col(c) - F.col(low)) * scale + start + 4 + (inner - F.col(span) * scale) / 2
    return points.crossJoin(F.broadcast(extent)).select("id", at("x", "min_x", "w", left).alias("mx"), at("y", "min_y", "h", top).alias("my"))  # extent: one row


def visible(points: DataFrame, width: float, height: float, margin: float = 50) -> Column:
    """Whether a screen point is in view, with a margin."""
    return F.col("sx").between(-margin, width + margin) & F.col("sy").between(-margin, height + margin)


def crosses(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> Column:
    """Whether the segment meets the rectangle from (0, 0): its parameter ranges inside the four
    sides have a value in common."""

    def bounds(a: Column, b: Column, size: float):
        d = b - a
        t0, t1 = F.try_divide(-a, d), F.try_divide(size - a, d)
        flat = (a >= 0) & (a <= size)
        return F.when(d == 0, F.when(flat, 0.0)).otherwise(F.least(t0, t1)), F.when(d == 0, F.when(flat, 1.0)).otherwise(F.greatest(t0, t1))

    (a, b), (c, d) = bounds(x1, x2, width), bounds(y1, y2, height)
    some = a.isNotNull() & c.isNotNull()
    return F.coalesce(some & (F.greatest(F.lit(0.0), a, c) <= F.least(F.lit(1.0), b, d)), F.lit(False))


def in_rectangle(points: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Ids of the screen points in a rectangle, given by two corners."""
    return points.where(F.col("sx").between(min(x1, x2), max(x1, x2)) & F.col("sy").between(min(y1, y2), max(y1, y2))).select("id")


def cell(px: float, py: float, width: int, height: int, view: tuple) -> tuple[float, float]:
    """(column, row), not whole, under a pixel of a view (x, y, width, height in cells); -1 of an empty picture."""
    if width <= 0 or height <= 0:
        return -1.0, -1.0
    return view[0] + px / width * view[2], view[1] + py / height * view[3]


def at_pixel(order: DataFrame, px: float, py: float, width: int, height: int, n: int, view: tuple | None = None) -> DataFrame:
    """role, id: the vertices of the row and the column under a pixel of a view (without: of the whole matrix)."""
    col, row = (int(x) for x in cell(px, py, width, height, view or (0, 0, n, n)))
    return order.where(F.col("position").isin(row, col)).select(F.explode(F.filter(F.array(F.when(F.col("position") == row, "row"), F.when(F.col("position") == col, "column")), lambda r: r.isNotNull())).alias("role"), "id")


def zoomed(view: tuple[float, float, float], n: int, x: float, y: float, closer: bool) -> tuple[float, float, float]:
    """(x, y, size) of a square view of an n x n matrix after a zoom about a cell."""
    size = min(max(view[2] * (0.8 if closer else 1.25), min(20, n)), n)
    shift = lambda o, c: min(max(c - (c - o) * size / view[2], 0), n - size)
    return shift(view[0], x), shift(view[1], y), size


def panned(view: tuple[float, float, float], n: int, dx: float, dy: float) -> tuple[float, float, float]:
    """A square view moved by shares of its size, kept inside the n x n matrix."""
    x, y, size = view
    keep = lambda o: min(max(o, 0), n - size)
    return keep(x + size * dx), keep(y + size * dy), size


def radius(base: float) -> Column:
    return base + F.least(F.lit(0.3) * F.col("degree"), F.lit(6.0))


def clamped(width: float, height: float) -> tuple[Column, Column]:
    """Screen places moved to the border where they are outside."""
    return F.greatest(F.lit(0.0), F.least(F.lit(width), "sx")), F.greatest(F.lit(0.0), F.least(F.lit(height), "sy"))


