"""The tool surface: named graphs and the analyses over them, by name and with JSON results."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colors, signal, stats
from ..model import Graph, induced
from ..operators import coarsen, communities, layout, metrics, ordering, partition, spectral
from ..sources import generators, readers
from ..streaming.events import Queue
from .iterate import cut



def as_json(df: DataFrame) -> str:
    """All rows as a JSON list, numbers rounded to 6 digits, half to even. Rows come partition by
    partition; results too long for one text are better written from their DataFrame."""
    rounded = [F.bround(f.name, 6).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema]
    return "[" + ",".join(r[0] for r in df.select(*rounded).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()) + "]"


def number(value, kind, other):
    """``value`` as a number, also from text; ``other`` where it isn't one."""
    try:
        return kind(value)
    except (TypeError, ValueError):
        return other


def flag(value, other: bool) -> bool:
    """``value`` as a truth value, also from text or a number; ``other`` where it isn't one."""
    text = str(value).strip().lower()
    return True if text in ("true", "1", "yes", "1.0") else False if text in ("false", "0", "no", "0.0") else other


class Catalog:
    """Graphs by id. Results are DataFrames (or small values) unless ``call`` is used."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.graphs: dict[str, Graph] = {}
        self.communities: dict[str, DataFrame] = {}
        self.levels: dict[str, list] = {}
        self.level: dict[str, int] = {}
        self.selections: dict[str, DataFrame] = {}
        self.metrics: dict[tuple[str, str], DataFrame] = {}
        self.modes: dict[str, dict] = {}
        self.matrices: dict[str, dict] = {}
        self.events = Queue()
        self.took: dict[str, float] = {}

    # ---- graphs

    def put(self, graph: Graph, id_: str | None = None) -> str:
        id_ = id_ or f"g{len(self.graphs) + 1}"
        self.graphs[id_] = graph
        for kept in (self.communities, self.levels, self.level, self.selections):
            kept.pop(id_, None)
        self.metrics = {k: v for k, v in self.metrics.items() if k[0] != id_}
        return id_

    def graph_load(self, path: str, id: str | None = None) -> dict:
        return self.graph_info(self.put(readers.read_graph(self.spark, path), id))

    def list_data_files(self, folder: str) -> DataFrame:
        return readers.find_graph_files(self.spark, folder)

    load_graph = graph_load

    def generate(self, kind: str, id: str | None = None, **arguments) -> dict:
        """A generated graph (complete, erdos_renyi, star, ring_lattice, barabasi_albert, watts_strogatz), with its communities."""
        if kind not in ("complete", "erdos_renyi", "star", "ring_lattice", "barabasi_albert", "watts_strogatz"):
            raise ValueError(f"unknown generator {kind!r}")
        return self.graph_info(self.put(getattr(generators, kind)(self.spark, **arguments), id))

    def graph_list(self) -> list[dict]:
        return [self.graph_info(id_) for id_ in self.graphs]

    def graph(self, id_: str) -> Graph:
        """By its id, or by ``window:`` and its id."""
        name = id_[len("window:") :] if id_.lower().startswith("window:") else id_
        if name not in self.graphs:
            raise KeyError(f"no graph {id_!r}")
        return self.graphs[name]

    def community(self, id_: str) -> DataFrame:
        if id_ not in self.communities:
            self.communities[id_] = communities.label_propagation(self.graph(id_)).cache()
        return self.communities[id_]

    def graph_info(self, id: str) -> dict:
        g = self.graph(id)
        return {"id": id, "title": g.title, "nodes": g.size, "edges": g.n_edges, "directed": g.directed, "communities": self.community(id).select("community").distinct().count(), "bytes": g.memory_bytes()}

    get_graph_info = graph_info

    def values(self, id_: str, metric: str) -> DataFrame:
        if (id_, metric) not in self.metrics:
            self.metrics[id_, metric] = metrics.metric(self.graph(id_), metric).cache()
        return self.metrics[id_, metric]

    def _named(self, id_: str) -> Graph:
        g = self.graph(id_)
        return Graph(g.vertices.join(self.community(id_), "id"), g.edges, g.directed, g.title)

    # ---- analyses

    def graph_metrics(self, id: str, metric: str, top: int = 20, order: str = "desc", community: int | None = None) -> DataFrame:
        return ordering.top(self._named(id), self.values(id, metric), number(top, int, 20), order == "asc", number(community, int, None))

    def graph_stats(self, id: str, metric: str) -> DataFrame:
        return stats.describe(self.values(id, metric))

    def graph_histogram(self, id: str, metric: str, bins: int = 20) -> DataFrame:
        return stats.histogram(self.values(id, metric), number(bins, int, 20))

    def graph_degree_distribution(self, id: str) -> tuple[DataFrame, DataFrame]:
        degrees = self.values(id, "degree")
        return stats.distribution(degrees), stats.power_law(degrees)

    def graph_correlate(self, id: str, metric_a: str, metric_b: str) -> DataFrame:
        both = self.values(id, metric_a).withColumnRenamed("value", "a").join(self.values(id, metric_b).withColumnRenamed("value", "b"), "id")
        return stats.correlate(both, "a", "b")

    def _wide(self, id_: str, names) -> DataFrame:
        out = self.graph(id_).vertices.select("id")
        for name in names:
            out = out.join(self.values(id_, name).withColumnRenamed("value", name), "id")
        return out

    def graph_correlation_matrix(self, id: str) -> DataFrame:
        return stats.correlation_matrix(self._wide(id, metrics.NAMES), metrics.NAMES)

    def graph_find_bridges(self, id: str, metrics: tuple = ("pagerank", "betweenness"), top: int = 20) -> DataFrame:
        """Vertices among the top by every metric."""
        return ordering.cross_rank(self._wide(id, metrics), metrics, number(top, int, 20))

    def graph_neighbors(self, id: str, index: int) -> DataFrame:
        return ordering.neighbours(self._named(id), index)

    def graph_node_profile(self, id: str, index: int) -> DataFrame:
        size = self.graph(id).size
        if not 0 <= number(index, int, -1) < size:
            raise ValueError(f"vertex {index} is not in 0 to {size - 1}")
        profile = self._wide(id, metrics.NAMES).where(F.col("id") == index)
        rounded = [F.bround(n, 6).alias(n) for n in metrics.NAMES]
        return self._named(id).vertices.select("id", "label", "community").join(profile, "id").select("id", "label", "community", *rounded, F.col("degree").cast("long").alias("neighbor_count"))

    def graph_fft(self, id: str, metric: str, threshold: float = 0.1, peaks: int = 10) -> DataFrame:
        return signal.peaks(signal.spectrum(self.values(id, metric)), threshold, peaks)

    def set_color_mode(self, id: str, node_mode: str | None = None, edge_mode: str | None = None) -> dict:
        for mode, known in ((node_mode, colors.NODE_MODES), (edge_mode, colors.EDGE_MODES)):
            if mode is not None and mode not in known:
                raise ValueError(f"unknown colour mode {mode!r}; known: {', '.join(known)}")
        self.graph(id)
        self.modes[id] = self.get_color_mode(id) | {k: v for k, v in (("node_mode", node_mode), ("edge_mode", edge_mode)) if v is not None}
        return self.modes[id]

    def get_color_mode(self, id: str) -> dict:
        return self.modes.get(id, {"node_mode": "community", "edge_mode": "community"})

    def graph_show(self, id: str, node_color: str | None = None, edge_color: str | None = None, **more) -> tuple[DataFrame, DataFrame]:
        """Vertices with places and colours, and edges with colours: what a view would draw, in the
        colour modes given or set."""
        g, c, modes = self.graph(id), self.community(id), self.get_color_mode(id)
        node_color, edge_color = node_color or modes["node_mode"], edge_color or modes["edge_mode"]
        return layout.run(g, **more).join(colors.node_colors(g, node_color, c), "id"), colors.edge_colors(g, edge_color, c)

    load_graph_with_layout = graph_show

    def rerun_layout(self, id: str, mode: str = "auto", iterations: int = 100) -> DataFrame:
        return layout.run(self.graph(id), mode, iterations)

    def auto_fit(self, places: DataFrame) -> DataFrame:
        return ordering.box(places)

    @staticmethod
    def options(target_split=0.5, tolerance=0.25, matching: str = "hemsrdeg", **more) -> partition.Options:
        """Partition options from a tool's arguments; numbers also as text."""
        try:
            strategy = coarsen.Strategy(str(matching).lower())
        except ValueError:
            raise ValueError(f"unknown matching {matching!r}; known: {', '.join(s.value for s in coarsen.Strategy)}") from None
        return partition.Options(split=number(target_split, float, 0.5), tolerance=number(tolerance, float, 0.25), strategy=strategy, **more)

    def graph_bisect(self, id: str, options: partition.Options | None = None, **more) -> tuple[DataFrame, dict]:
        g, options = self.graph(id), options or self.options(**more)
        side = partition.bisect(g, options)
        return side, partition.imbalance(side).first().asDict() | partition.edge_cut(g, side).first().asDict()

    def graph_partition(self, id: str, k: int, options: partition.Options | None = None, **more) -> tuple[DataFrame, dict]:
        g, options, k = self.graph(id), options or self.options(**more), number(k, int, 2)
        parts = partition.k_way(g, k, options)
        sizes = [r["size"] for r in partition.part_sizes(parts, k).orderBy("part").collect()]
        return parts, {"sizes": sizes} | partition.edge_cut(g, parts, "part").first().asDict()

    def _matrix(self, id_: str, **more) -> dict:
        self.graph(id_)
        now = self.matrices.get(id_, {"mode": "original", "ramp": "thermal", "log_scale": True, "gamma": 0.5, "floor": 0.15})
        self.matrices[id_] = now | {k: v for k, v in more.items() if v is not None}
        return self.matrices[id_]

    def set_matrix_ordering(self, id: str, ordering: str) -> dict:
        return self._matrix(id, mode=ordering)

    def set_color_ramp(self, id: str, ramp: str) -> dict:
        return self._matrix(id, ramp=ramp)

    def set_log_scale(self, id: str, enabled=True) -> dict:
        return self._matrix(id, log_scale=flag(enabled, True))

    def set_gamma(self, id: str, gamma) -> dict:
        if (value := number(gamma, float, None)) is None:
            raise ValueError("gamma is a number from 0.1 to 5")
        return self._matrix(id, gamma=min(max(value, 0.1), 5.0))

    def set_density_floor(self, id: str, floor) -> dict:
        if (value := number(floor, float, None)) is None:
            raise ValueError("the floor is a number from 0 to 0.9")
        return self._matrix(id, floor=min(max(value, 0.0), 0.9))

    def matrix(self, id: str, width: int = 256, height: int = 256, view=(0.0, 0.0, None, None), **more) -> DataFrame:
        """The density grid of a view in the settings given (mode, ramp, log_scale, gamma, floor) or set."""
        g, now = self.graph(id), {**self._matrix(id), **more}
        order = ordering.order_by(g, now["mode"], self.community(id) if now["mode"] == "community" else None)
        return colors.density_colors(ordering.density(g, order, width, height, view), now["ramp"], now["log_scale"], now["gamma"], now["floor"])

    # ---- levels

    def get_coarse_levels(self, id: str) -> list[dict]:
        if id not in self.levels:
            self.levels[id] = coarsen.hierarchy(self.graph(id))
        return coarsen.level_table(self.graph(id), self.levels[id], self.level.get(id, 0))

    def set_coarse_level(self, id: str, level: int) -> bool:
        if not 0 <= level < len(self.get_coarse_levels(id)):
            return False
        self.level[id] = level
        self.selections.pop(id, None)
        self._post(id, "level_changed", level=level)
        return True

    # ---- selections

    def get_selection(self, id: str) -> DataFrame:
        return self.selections.get(id, self.spark.createDataFrame([], "id long"))

    def set_selection(self, id: str, nodes: list, mode: str = "replace") -> DataFrame:
        chosen = self.spark.createDataFrame([(str(n),) for n in nodes], "value string")
        g = self.graph(id)
        chosen = chosen.select(F.expr("try_cast(value as long)").alias("id")).where("id is not null").distinct().join(g.vertices.select("id"), "id", "left_semi")
        self.selections[id] = cut(ordering.select(self.get_selection(id), chosen, mode))
        self._post(id, "selection_changed")
        return self.selections[id]

    def select_all(self, id: str) -> DataFrame:
        self.selections[id] = ordering.select_all(self.graph(id))
        self._post(id, "selection_changed")
        return self.selections[id]

    def clear_selection(self, id: str) -> None:
        self.selections.pop(id, None)
        self._post(id, "selection_changed")

    def select_top_nodes(self, id: str, metric: str, top: int = 20, order: str = "desc", community: int | None = None) -> DataFrame:
        self.selections[id] = cut(self.graph_metrics(id, metric, top, order, community).select("id"))
        self._post(id, "selection_changed")
        return self.selections[id]

    def get_selection_summary(self, id: str) -> DataFrame:
        return self.get_selection(id).join(self.community(id), "id").groupBy("community").agg(F.count("*").alias("nodes"))

    def subgraph(self, id: str) -> Graph:
        return induced(self.graph(id), self.get_selection(id))

    def algebraic_connectivity(self, id: str) -> float:
        return spectral.algebraic_connectivity(self.graph(id))

    # ---- events and times

    def _post(self, id_: str, type_: str, **more) -> None:
        self.events.post(id_, type_, int(time.time() * 1000), **more)

    def get_interactions(self, id: str) -> list[dict]:
        """The newest events of a graph since they were last asked for; they are gone then."""
        return self.events.drain(id)

    def get_render_stats(self) -> dict:
        """Moving averages of the tools' times by name, in milliseconds."""
        return {k: round(v, 3) for k, v in self.took.items()}

    def reset_render_stats(self) -> None:
        self.took.clear()

    # ---- by name

    def call(self, tool: str, **arguments) -> str:
        """The tool's result as JSON text."""
        if tool.startswith("_") or not callable(getattr(self, tool, None)):
            raise ValueError(f"unknown tool {tool!r}")
        began = time.time()
        out = getattr(self, tool)(**arguments)
        shown = lambda x: json.loads(as_json(x)) if isinstance(x, DataFrame) else [shown(y) for y in x] if isinstance(x, tuple) else x
        text = json.dumps(shown(out))
        new = 1000 * (time.time() - began)
        self.took[tool] = new if tool not in self.took else 0.9 * self.took[tool] + 0.1 * new
        return text
