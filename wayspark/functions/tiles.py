"""Bounded shortest-path searches on a network, tile by tile.

A route of length d leads no further than d times the largest ratio of straight to travelled length of an edge. So the searches
that start in a tile, each up to its own limit, need the edges of the tile and of a halo as wide as the limit, and one task does
them all with a heap: one exchange of edges and searches, no rounds. Limits are grouped by powers of two, each with tiles
of its own size, so that a short search does not pay for a long one. Tiles with many searches are split by a hash of the source, a crowded source by its searches; each part
gets the tile's edges, and a tile has no more parts than there are tasks, one for each of them. The rows of a part are streamed, edges first, then searches by source: a task holds the
network within reach of its tile, a batch of searches and their distances.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, partitions

PER_TASK = 1024             # searches that a part of a tile is worth, and of one source that are done at once
ROWS_OUT = 65_536           # nodes found that are held before they are passed on
SLACK = 1 + 1e-9            # rounding of coordinates


class Network:
    """Edges of a task by their tail; what leaves a node is listed when the node is first reached."""

    def __init__(self, tails: np.ndarray, heads: np.ndarray, weights: np.ndarray, nodes: int):
        self.order = np.argsort(tails, kind="stable")
        self.first = np.searchsorted(tails[self.order], np.arange(nodes + 1))
        self.heads, self.weights, self.known = heads[self.order], weights[self.order], {}

    def leaving(self, node: int) -> list[tuple[int, float, int]]:
        found = self.known.get(node)
        if found is None:
            if node >= len(self.first) - 1:              # a node without edges
                return []
            lo, hi = self.first[node], self.first[node + 1]
            found = self.known[node] = list(zip(self.heads[lo:hi].tolist(), self.weights[lo:hi].tolist(), self.order[lo:hi].tolist()))
        return found

    def search(self, source: int, limit: float, targets: set[int] | None = None, allowed: bytes | None = None, via: dict | None = None) -> dict[int, float]:
        """Distances of the nodes within ``limit``, ending when all ``targets`` are settled, if there are any. ``allowed`` marks the edges that may be
        used; ``via`` gets the last node and edge of every way."""
        best, heap, left = {source: 0.0}, [(0.0, source)], None if targets is None else set(targets)
        while heap:
            far, node = heapq.heappop(heap)
            if far > best[node]:
                continue
            if left is not None:
                left.discard(node)
                if not left:
                    break
            for head, weight, edge in self.leaving(node):
                to = far + weight
                if to <= limit and to < best.get(head, math.inf) and (allowed is None or allowed[edge]):
                    best[head] = to
                    heapq.heappush(heap, (to, head))
                    if via is not None:
                        via[head] = node, edge
        return best


class Pieces:
    """Boxes of the parts of every edge."""

    def __init__(self, column: pa.ChunkedArray, n: int):
        sizes = pc.list_value_length(column).to_numpy() if n else np.zeros(0, int)
        self.n, self.owner, self.first = n, np.repeat(np.arange(n), sizes), np.append(0, np.cumsum(sizes)).tolist()
        self.parts = [x.to_numpy() for x in pc.list_flatten(column).combine_chunks().flatten()] if n else [np.zeros(0)] * 4
        self.rows = list(zip(*(x.tolist() for x in self.parts)))

    def touching(self, box: tuple) -> bytes:
        x0, y0, x1, y1 = box
        touched = np.zeros(self.n, bool)
        touched[self.owner[(self.parts[0] <= x1) & (self.parts[2] >= x0) & (self.parts[1] <= y1) & (self.parts[3] >= y0)]] = True
        return touched.tobytes()

    def touches(self, edge: int, box: tuple) -> bool:
        x0, y0, x1, y1 = box
        return any(a <= x1 and c >= x0 and b <= y1 and d >= y0 for a, b, c, d in self.rows[self.first[edge]:self.first[edge + 1]])


def boxed_searches(network: Network, pieces: Pieces, source: int, jobs: list[tuple[float, tuple, set[int]]]) -> list[dict[int, float]]:
    """Distances of the targets of every (limit, box, targets) of one source. One search without a box serves them all: where its ways keep to the edges
    that touch a job's box, they are the job's shortest ways too; only the other jobs are searched again."""
    via: dict[int, tuple[int, int]] = {}
    free = network.search(source, max(limit for limit, _, _ in jobs), set().union(*(targets for _, _, targets in jobs)), via=via)
    out, inside = [], {}
    for limit, box, targets in jobs:
        near = {t: free[t] for t in targets if free.get(t, math.inf) <= limit}
        for t in near:
            while t != source:
                t, edge = via[t]
                if (edge, box) not in inside:
                    inside[edge, box] = pieces.touches(edge, box)
                if not inside[edge, box]:
                    break
            else:
                continue
            again = network.search(source, limit, targets, pieces.touching(box))
            near = {t: again[t] for t in targets if t in again}
            break
        out.append(near)
    return out


def _runs(batch: pa.RecordBatch, columns: list[str]) -> list[tuple[int, int]]:
    """First row and number of rows of every run of equal ``columns``."""
    change = np.zeros(max(batch.num_rows - 1, 0), bool)
    for c in columns:
        values = batch.column(c).to_numpy(zero_copy_only=False)
        change |= values[1:] != values[:-1]
    ends = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    return [(a, b - a) for a, b in zip(ends, ends[1:]) if b > a]


class _Part:
    """The network of a tile; searches come batch by batch."""

    def __init__(self, roads: pa.Table, kind: pa.DataType, box: bool):
        roads, n = roads.combine_chunks(), roads.num_rows
        ends = pa.chunked_array([chunk for c in "ab" for chunk in roads.column(c).cast(kind).chunks], kind)
        self.names = pc.unique(ends)
        codes = pc.index_in(ends, self.names).to_numpy()
        self.network = Network(codes[:n], codes[n:], roads.column("w").to_numpy(), len(self.names))
        self.pieces = Pieces(roads.column("pieces"), n) if box else None

    def search(self, jobs: pa.RecordBatch, keep: list[str]) -> Iterator[pa.RecordBatch]:
        """Rows of the searches ``jobs``, which are sorted by source."""
        m, flat = jobs.num_rows, [jobs.column("source")]
        if self.pieces:
            flat.append(pc.list_flatten(jobs.column("targets")))
            ends = np.append(0, np.cumsum(pc.list_value_length(jobs.column("targets")).to_numpy())).tolist()
            boxes = list(zip(*(jobs.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1"))))
        names, codes = self._codes(pa.concat_arrays(flat))
        sources, aims, limits = codes[:m], codes[m:], jobs.column("limit_m").to_pylist()

        def rows() -> pa.RecordBatch:
            found = [names.take(pa.array(nodes, pa.int64())), pa.array(far, pa.float64())]
            if self.pieces:
                at = pa.array(done, pa.int64())
                found = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), x) for x in found]
            else:
                at = pa.array(np.repeat(np.array(done, int), size), pa.int64())
            return pa.RecordBatch.from_arrays([jobs.column(c).take(at) for c in keep] + found, names=[*keep, *(["nodes", "ds"] if self.pieces else ["node", "d"])])

        done, size, nodes, far = [], [], [], []             # searches in order, how many nodes each found, and these
        for first, n in _runs(jobs, ["source"]):
            for lo in range(first, first + n, PER_TASK):
                own = range(lo, min(lo + PER_TASK, first + n))
                if self.pieces:
                    out = boxed_searches(self.network, self.pieces, sources[lo], [(limits[j], boxes[j], set(aims[ends[j]:ends[j + 1]])) for j in own])
                else:
                    out = (self.network.search(sources[j], limits[j]) for j in own)
                for j, found in zip(own, out):
                    done.append(j)
                    size.append(len(found))
                    nodes.extend(found)
                    far.extend(found.values())
                    if len(nodes) >= ROWS_OUT:
                        yield rows()
                        done, size, nodes, far = [], [], [], []
        if done:
            yield rows()

    def _codes(self, values: pa.Array) -> tuple[pa.Array, list[int]]:
        """All names and the number of every value; names without an edge here follow those of the network."""
        codes = pc.index_in(values, self.names)
        if not codes.null_count:
            return self.names, codes.to_pylist()
        other = pc.unique(values.filter(pc.is_null(codes)))
        codes = pc.coalesce(codes, pc.add(pc.index_in(values, other), pa.scalar(len(self.names), pa.int32())))
        return pa.concat_arrays([self.names, other]), codes.to_pylist()


def _level(limit: str) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(limit), F.lit(1.0))))).cast("int")


def tile_routes(edges: DataFrame, searches: DataFrame, dims: list[str], box: bool = False) -> DataFrame:
    """Distances (source, limit_m, node, d) of the routes up to ``limit_m``; with ``box`` one row a search, (source, limit_m, x0, y0, x1, y1, nodes, ds).

    ``edges``: (a, b, w, a_<dim>, b_<dim>) and, with ``box``, ``pieces``: the boxes (x0, y0, x1, y1) of the edge's parts. ``searches``: (source, limit_m,
    s_<dim>) and, with ``box``, x0, y0, x1, y1 and ``targets``: only edges with a part that touches the box are used, and only distances of the targets
    are returned. A search whose coordinates are null starts at a node without edges. Both tables are read twice: pass written ones.
    """
    straight = F.sqrt(sum((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in dims))
    ratio = edges.agg(F.max(straight / F.col("w")).alias("r")).first()["r"] or 0.0
    reach = lambda level: F.pow(F.lit(2.0), level) * F.lit(max(ratio, 1e-9) * SLACK)
    halo = reach(F.col("_level"))
    tile = [f"_{c}" for c in dims]
    cell = lambda c: F.floor(c / (2 * halo)).cast("bigint")
    placed = searches.withColumn("_level", _level("limit_m"))
    levels = [r["_level"] for r in placed.select("_level").distinct().collect()]           # a power of two each: few
    placed = placed.withColumns({f"_{c}": F.coalesce(cell(F.col(f"s_{c}")), F.lit(0)) for c in dims})
    crowds = cut_lineage(placed.groupBy("_level", *tile, "source").agg(F.count(F.lit(1)).alias("_n")))
    tiles = cut_lineage(crowds.groupBy("_level", *tile).agg(F.least(F.ceil(F.sum("_n") / PER_TASK), F.lit(partitions(searches.sparkSession))).cast("int").alias("_parts")))
    spread = edges.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))) if levels else edges.withColumn("_level", F.lit(0)).limit(0)
    for c in dims:
        spread = spread.withColumn(f"_{c}", F.explode(F.sequence(cell(F.col(f"a_{c}") - halo), cell(F.col(f"a_{c}") + halo))))
    for c in dims:
        spread = spread.filter((F.col(f"b_{c}") >= F.col(f"_{c}") * 2 * halo - halo) & (F.col(f"b_{c}") <= (F.col(f"_{c}") + 1) * 2 * halo + halo))
    key = ["_level", *tile]
    spread = spread.join(tiles.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))), key)
    keep = ["source", "limit_m"] + (["x0", "y0", "x1", "y1"] if box else [])
    # searches of one source stay together, unless they are more than a part's
    salt = F.pmod(F.xxhash64(*keep), F.ceil(F.col("_n") / PER_TASK))
    placed = placed.join(crowds, [*key, "source"]).join(tiles, key).withColumn("_part", F.pmod(F.xxhash64("source") + salt, F.col("_parts")).cast("int"))
    road, job = ["a", "b", "w"] + (["pieces"] if box else []), keep + (["targets"] if box else [])
    rows = spread.select(*key, "_part", F.lit(False).alias("_job"), *road).unionByName(placed.select(*key, "_part", F.lit(True).alias("_job"), *job), allowMissingColumns=True)
    kinds = {f.name: f.dataType.simpleString() for f in searches.schema.fields}
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + ([f"nodes array<{kinds['source']}>", "ds array<double>"] if box else [f"node {kinds['source']}", "d double"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, edges, part = None, [], None
        for batch in batches:
            for first, n in _runs(batch, [*key, "_part", "_job"]):
                group, rows = tuple(batch.column(c)[first].as_py() for c in (*key, "_part")), batch.slice(first, n)
                if group != now:
                    now, edges, part = group, [], None
                if not batch.column("_job")[first].as_py():
                    edges.append(rows.select(road))
                    continue
                if part is None:
                    roads = pa.Table.from_batches(edges, pa.schema([batch.schema.field(c) for c in road]))
                    part, edges = _Part(roads, batch.schema.field("source").type, box), []
                yield from part.search(rows, keep)

    # the number of tasks follows the searches, not the bytes; the parts of a tile go to tasks in turn
    tasks = partitions(searches.sparkSession)
    dealt = rows.repartitionById(tasks, F.pmod(F.xxhash64(*key) + F.col("_part"), F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions(*key, "_part", "_job", "source").mapInArrow(run, schema)
