"""Graphs of a bounded size, whole, as arrays."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ..model import Graph

# tasks get this module's class with their function, also where they can't import it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges, and vertices, up to which a graph is held whole: then about 150 MB, and 500 MB while it is made.
EDGES = 8_000_000
VERTICES = 2_000_000
#: Neighbour entries that are looked at a time.
SLICE = 1 << 20
#: The same in a search, and how many it keeps for the way back.
STEP, KEPT = 1 << 17, 1 << 22


class Whole:
    """Vertex i has the id ``ids[i]`` and the neighbour entries ``near[start[i]:start[i + 1]]``; parallel
    edges are entries of their own."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, near: np.ndarray):
        self.ids, self.start, self.near = ids, start, near
        self.degree = np.diff(start)

    def entries(self, vertices: np.ndarray):
        """Slices of the entries of ``vertices``: the place of the entry's vertex in ``vertices``, its neighbour."""
        ends = np.cumsum(self.degree[vertices])
        at = 0
        while at < len(vertices):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + SLICE, "right")))
            size = self.degree[vertices[at:to]]
            where = np.repeat(self.start[vertices[at:to]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            yield np.repeat(np.arange(at, to), size), self.near[where]
            at = to

    def pulled(self, vertices: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of each of ``vertices`` the sum of x over its entries."""
        out = np.zeros(len(vertices))
        for place, near in self.entries(vertices):
            low = place[0] if len(place) else 0
            sums = np.bincount(place - low, x[near])
            out[low : low + len(sums)] += sums
        return out

    def steps(self, vertices: np.ndarray):
        """As ``entries``, in short slices: the places of the first vertex and behind the last, each
        vertex' first entry in the slice, how many it has, their neighbours."""
        ends = np.cumsum(self.degree[vertices])
        at = 0
        while at < len(vertices):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + STEP, "right")))
            size = self.degree[vertices[at:to]]
            first = ends[at:to] - size - done
            where = np.repeat(self.start[vertices[at:to]] - first, size)
            where += np.arange(len(where))
            yield at, to, first, size, self.near[where].astype(np.intp)
            at = to

    def between(self, sources) -> np.ndarray:
        """Of every vertex the shortest paths from ``sources`` to others through it, as shares.

        A search takes as long as the entries that it looks at: its arrays are cleared where it
        was, and a level that few entries lead to is found without a look at all vertices."""
        n = len(self.ids)
        total, paths, flow, x = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        seen, last = np.zeros(n, bool), np.empty(n, np.intp)
        for source in sources:
            seen[source], paths[source] = True, 1.0
            fronts, kept, held = [np.array([source])], [], 0
            left = len(self.near) - self.degree[source]  # entries of vertices not seen
            while left:
                front = fronts[-1]
                size = int(self.degree[front].sum())
                if left + n < size:  # they look for the front
                    rest = np.flatnonzero(~seen & (self.degree > 0))
                    x[front] = paths[front]
                    got = np.concatenate([np.add.reduceat(x[near], first) for _, _, first, _, near in self.steps(rest)])
                    x[front] = 0
                    found = rest[got > 0]
                    paths[found] = got[got > 0]
                    kept.append(None)
                else:
                    slices = self.steps(front)
                    if held + size <= KEPT:
                        slices, held = list(slices), held + size
                    kept.append(slices if isinstance(slices, list) else ())
                    if 4 * size < n:
                        found = []
                        for at, to, _, m, near in slices:
                            new = np.flatnonzero(~seen[near])
                            found.append(near[new])
                            np.add.at(paths, found[-1], np.repeat(paths[front[at:to]], m)[new])
                        found = np.concatenate(found)
                        place = np.arange(len(found))
                        last[found] = place
                        found = found[last[found] == place]
                    else:
                        for at, to, _, m, near in slices:
                            np.add.at(x, near, np.repeat(paths[front[at:to]], m))
                        found = np.flatnonzero((x > 0) & ~seen)
                        paths[found] = x[found]
                        x[:] = 0
                if not len(found):
                    break
                seen[found] = True
                left -= int(self.degree[found].sum())
                fronts.append(found)
            for k in range(len(fronts) - 2, 0, -1):
                front, below = fronts[k], fronts[k + 1]
                share = (1 + flow[below]) / paths[below]
                if kept[k] is None:
                    for at, to, _, m, near in self.steps(below):
                        np.add.at(x, near, np.repeat(share[at:to], m))
                    got = x[front]
                    x[:] = 0
                else:
                    x[below] = share
                    got = np.concatenate([np.add.reduceat(x[near], first) for _, _, first, _, near in kept[k] or self.steps(front)])
                    x[below] = 0
                flow[front] = paths[front] * got
                total[front] += flow[front]
            for front in fronts:
                seen[front], paths[front], flow[front] = False, 0, 0
        return total

    def laplacian(self, x: np.ndarray) -> np.ndarray:
        return self.degree * x - self.pulled(np.arange(len(x)), x)


def fits(graph: Graph) -> bool:
    return graph.size <= VERTICES and graph.n_edges <= EDGES


def _numbers(table: DataFrame) -> list[np.ndarray]:
    """The columns of ``table`` (longs), each as one array."""
    names = table.columns

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({c: pa.array([batch.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in names})

    rows = table.mapInArrow(run, ", ".join(f"{c} binary" for c in names)).collect()
    return [np.frombuffer(b"".join(r[c] for r in rows), "<i8") for c in names]


def whole(graph: Graph) -> Whole:
    """``graph``, which ``fits``, on the driver."""
    ids = np.unique(_numbers(graph.vertices.select("id"))[0])
    src, dst = _numbers(graph.edges.select(graph.edges["src"].cast("long").alias("src"), graph.edges["dst"].cast("long").alias("dst")))
    one, two = (np.searchsorted(ids, v).astype(np.int32) for v in (src, dst))
    del src, dst
    rows = np.concatenate([one, two])
    near = np.concatenate([two, one])
    near = near[np.argsort(rows, kind="stable")]
    return Whole(ids, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(ids)))]), near)
