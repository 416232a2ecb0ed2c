"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are reduced to distinct ones, dealt by hash into shards of a fixed size, and each shard gets its own
graph, built from the top level down. Nodes are inserted in batches: each searches the graph built so far with a
beam, and links to nodes chosen for closeness and diversity from what it found and from its own batch; links are
mutual and pruned to a fixed number, and are stored as flat neighbour arrays, one row of a table per shard.
All queries stream past every shard, walk all levels down to the lowest with a beam, are scored again in double
precision on the original vectors, and the shards' results are merged. A shard is copied only to keep
the cores busy while there are fewer shards than cores.

The measure is the inner product. In the graph each vector has one more component that brings all of a
shard to equal length, which turns largest inner product into nearest neighbour.

Equal vectors are one node with its smallest ids, one more than the results asked for; as ties go to smaller ids, no
other copy can be among a query's results. Equal (id, vector) rows count once.

Defined results: vectors that are null, zero, of another dimension than most, or that hold null or
non-finite components take no part, as queries or as candidates; a null id takes no part; fewer candidates than
asked for are all returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.shared import materialize

#: Vectors of a shard, about.
SHARD = 1 << 14
#: Links of a node above the lowest level; twice as many on it.
LINKS = 16
#: Candidates from which links are chosen.
CANDIDATES = 96
#: Width of the beam on the lowest level, and above.
BEAM, BEAM_ABOVE = 256, 16
#: Queries that walk together, and the largest batch of nodes that are inserted together.
_LOCKSTEP, BATCH = 256, 512


def _diverse(vectors: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Choose links from candidates sorted by similarity (rows, C); -1 fills up.

    A candidate is taken if it is closer to the node than to every link taken before it; free places
    go to the closest of the rest.
    """
    rows, c = near.shape
    valid = near >= 0
    between = vectors[np.maximum(near, 0)]
    between = between @ between.transpose(0, 2, 1)
    best = np.full((rows, c), -np.inf, dtype=np.float32)
    taken = np.zeros((rows, c), dtype=bool)
    count = np.zeros(rows, dtype=np.int64)
    for k in range(c):
        take = valid[:, k] & (sims[:, k] > best[:, k]) & (count < most)
        taken[:, k] = take
        count += take
        best = np.maximum(best, np.where(take[:, None], between[:, k, :], -np.inf))
    # taken first, then other valid ones, both in order of closeness
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(near, order, axis=1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def _best(near: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most similar candidates of each row, in order; -1 fills up."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
    return np.where(np.isfinite(sims), near, -1), sims


def _insert(points: np.ndarray, links: np.ndarray, first: int, last: int, entry: np.ndarray | None) -> None:
    """Link nodes ``first`` to ``last`` of one level to those before them, and these back; changes ``links``."""
    new = np.arange(first, last)
    inside = points[first:last] @ points[first:last].T
    inside[np.arange(len(new))[None, :] >= np.arange(len(new))[:, None]] = -np.inf  # only earlier ones
    near, sims = np.broadcast_to(new, inside.shape), inside
    if first:
        start = np.zeros((len(new), 1), dtype=np.int64) if entry is None else entry
        found, how = _beam(points[:first], links[:first], points[first:last], start, min(CANDIDATES, first))
        near, sims = np.hstack([found, near]), np.hstack([how, sims])
    near, sims = _best(near, sims, CANDIDATES)
    chosen = _diverse(points, near, sims, LINKS)
    links[first:last, : chosen.shape[1]] = chosen
    # back: what a node has, and what now points to it
    row, col = np.nonzero(chosen >= 0)
    to, source = chosen[row, col], new[row]
    if not len(to):
        return
    weight = np.einsum("ij,ij->i", points[to], points[source])
    order = np.lexsort((source, -weight, to))
    to, source, weight = to[order], source[order], weight[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    ok = place < 2 * links.shape[1]
    touched, at = np.unique(to, return_inverse=True)
    more = np.full((len(touched), 2 * links.shape[1]), -1, dtype=np.int64)
    more[at[ok], place[ok]] = source[ok]
    around = np.hstack([links[touched].astype(np.int64), more])
    for i in range(0, len(touched), 256):
        rows, cells = touched[i : i + 256], around[i : i + 256]
        how = np.where(cells >= 0, np.einsum("ij,ikj->ik", points[rows], points[np.maximum(cells, 0)]), -np.inf)
        links[rows] = _diverse(points, *_best(cells, how, cells.shape[1]), links.shape[1])


def _level(points: np.ndarray, most: int, above: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Neighbour array (n, most) of one level, whose nodes stand in order of insertion, those of the levels ``above`` first."""
    n = len(points)
    links = np.full((n, most), -1, dtype=np.int32)
    first = 0
    while first < n:
        last = min(n, first + max(32, min(BATCH, first)))
        entry = None
        if above and first >= len(above[0][1]):  # the levels above stand in whole
            entry = np.zeros((last - first, 1), dtype=np.int64)
            for higher, lower in reversed(above):
                entry, _ = _beam(points[: len(lower)], lower, points[first:last], entry, min(BEAM_ABOVE, higher))
        _insert(points, links, first, last, entry)
        first = last
    return links


def _lengthened(vectors: np.ndarray) -> np.ndarray:
    """One more component, so that all have the length of the longest."""
    v = vectors.astype(np.float64)
    square = (v * v).sum(axis=1)
    scale = math.sqrt(square.max()) or 1.0
    more = np.sqrt(np.maximum(square.max() - square, 0.0))
    return (np.hstack([v, more[:, None]]) / scale).astype(np.float32)


def build_graph(vectors: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the lowest up: (nodes, neighbour array); neighbours are node numbers of the shard."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(np.maximum(rng.random(n), 1e-12)) / math.log(LINKS)).astype(int)
    order = rng.permutation(n)
    order = order[np.argsort(-level[order], kind="stable")]  # nodes of higher levels come first
    points = _lengthened(vectors)[order]
    above: list[tuple[int, np.ndarray]] = []
    for height in range(int(level.max()), -1, -1):
        size = int((level >= height).sum())
        above.insert(0, (size, _level(points[:size], 2 * LINKS if height == 0 else LINKS, above)))
    return [(order[:size].astype(np.int32), np.where(links >= 0, order[np.maximum(links, 0)], -1).astype(np.int32)) for size, links in above]


def _beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best nodes found (queries, width) and their similarity, all queries in step."""
    n_queries, n = len(queries), len(points)
    every = np.arange(n_queries)
    seen = np.zeros((n_queries, n + 1), dtype=bool)  # the last column stands for no node
    tag = np.zeros((n_queries, n + 1), dtype=np.int16)
    ids = np.full((n_queries, width), -1, dtype=np.int64)
    sims = np.full((n_queries, width), -np.inf, dtype=np.float32)
    open_ = np.zeros((n_queries, width), dtype=bool)

    def add(rows: np.ndarray, found: np.ndarray) -> None:
        """Put unseen nodes (rows, any number; -1 for none) into the rows' beams."""
        at = np.where(found >= 0, found, n)
        columns = np.broadcast_to(np.arange(found.shape[1], dtype=np.int16), found.shape)
        tag[rows[:, None], at] = columns
        new = (found >= 0) & ~seen[rows[:, None], at] & (tag[rows[:, None], at] == columns)
        r, c = np.nonzero(new)
        node = found[r, c]
        seen[rows[r], node] = True
        value = np.full(found.shape, -np.inf, dtype=np.float32)
        value[r, c] = np.einsum("ij,ij->i", points[node], queries[rows[r]])
        all_sims = np.hstack([sims[rows], value])
        all_ids = np.hstack([ids[rows], np.where(new, found, -1)])
        all_open = np.hstack([open_[rows], new])
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[rows] = np.take_along_axis(all_sims, keep, axis=1)
        ids[rows] = np.take_along_axis(all_ids, keep, axis=1)
        open_[rows] = np.take_along_axis(all_open, keep, axis=1)

    add(every, entry)
    while True:
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            break
        ready = np.where(open_[rows], sims[rows], -np.inf)
        k = min(expand, width)
        pick = np.argpartition(-ready, k - 1, axis=1)[:, :k]
        usable = np.take_along_axis(open_[rows], pick, axis=1)
        nodes = np.where(usable, np.take_along_axis(ids[rows], pick, axis=1), -1)
        open_[rows[:, None], pick] = False
        around = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1)
        add(rows, around.reshape(len(rows), -1).astype(np.int64))
    return ids, sims


def search_graph(vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Nodes found for each query (queries, beam), in no order; -1 for none."""
    points = _lengthened(vectors)
    q = np.hstack([queries, np.zeros((len(queries), 1))])
    q = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)).astype(np.float32)
    flat = []
    for nodes, links in levels:
        all_links = np.full((len(points), links.shape[1]), -1, dtype=np.int32)
        all_links[nodes] = links
        flat.append(all_links)
    out = np.full((len(queries), beam), -1, dtype=np.int64)
    for a in range(0, len(queries), _LOCKSTEP):
        part = q[a : a + _LOCKSTEP]
        entry = np.tile(levels[-1][0][:1].astype(np.int64), (len(part), 1))
        for height in range(len(levels) - 1, 0, -1):
            entry, _ = _beam(points, flat[height], part, entry, BEAM_ABOVE)
        out[a : a + _LOCKSTEP], _ = _beam(points, flat[0], part, entry, beam)
    return out


def _usable(vector: Column) -> Column:
    number = vector.cast("array<double>")
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(number, lambda x: x != 0), F.lit(False))


def _pack_levels(levels: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, bytes]:
    return {
        "level_sizes": np.array([len(nodes) for nodes, _ in levels], dtype="<i4").tobytes(),
        "nodes": b"".join(nodes.astype("<i4").tobytes() for nodes, _ in levels),
        "links": b"".join(links.astype("<i4").tobytes() for _, links in levels),
    }


def _unpack_levels(sizes: bytes, nodes: bytes, links: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    out, a, b = [], 0, 0
    flat_nodes, flat_links = np.frombuffer(nodes, "<i4"), np.frombuffer(links, "<i4")
    for height, size in enumerate(np.frombuffer(sizes, "<i4").tolist()):
        most = 2 * LINKS if height == 0 else LINKS
        out.append((flat_nodes[a : a + size], flat_links[b : b + size * most].reshape(size, most)))
        a, b = a + size, b + size * most
    return out


def usable_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, vector) that take part, each pair once."""
    rows = (
        table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        .filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
        .distinct()
    )
    rows = materialize(rows, "vectors")
    top = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("vector") == (top[0].d if top else 0))


def build_index(vectors: DataFrame, k: int = 20, shard_size: int = SHARD) -> DataFrame:
    """A table with one row per shard: its vectors, members and flat neighbour arrays."""
    first = Window.partitionBy("vector").orderBy("vec_id")
    nodes = (
        vectors.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= k + 1)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("members"))  # k + 1 ids at most
    )
    nodes = materialize(nodes, "distinct-vectors")
    shards = max(1, math.ceil(nodes.count() / shard_size))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector", F.lit("shard")), F.lit(shards)).cast("int"))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        members = rows.column("members").to_pylist()
        n = rows.num_rows
        data = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        order = np.argsort([m[0] for m in members], kind="stable")  # the same graph in every run
        data, members = data[order], [members[i] for i in order]
        packed = _pack_levels(build_graph(data, 1000 + shard))
        row = {
            "shard": shard,
            "n": n,
            "vectors": data.astype("<f8").tobytes(),
            "member_counts": np.array([len(m) for m in members], dtype="<i4").tobytes(),
            "members": np.array([i for m in members for i in m], dtype="<i8").tobytes(),
            **packed,
        }
        return pa.table({c: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int32()) for c, v in row.items()})

    schema = "shard int, n int, vectors binary, member_counts binary, members binary, level_sizes binary, nodes binary, links binary"
    return materialize(dealt.groupBy("shard").applyInArrow(build, schema), "hnsw-index")


def search(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """The k nearest found for each query row (vec_id, vector): query_id, rank, vec_id, score."""
    shards = index.count()
    cores = index.sparkSession.sparkContext.defaultParallelism
    copies = max(1, math.ceil(cores / max(1, shards)))  # so that few shards still keep all cores busy
    columns = [c for c in index.columns if c != "shard"]
    graphs = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumns({"query_id": F.lit(None).cast("long"), "query": F.lit(None).cast("array<double>")})
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.pmod(F.xxhash64("vec_id", F.lit("copy")), F.lit(copies)).cast("int").alias("copy"))
    # every query visits every shard
    visits = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))))
    visits = visits.withColumns({c: F.lit(None).cast(index.schema[c].dataType) for c in columns})
    order = ["shard", "copy", "query_id", "query", *columns]
    together = graphs.select(order).unionByName(visits.select(order)).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("query_id").asc_nulls_first())

    class Shard:
        def __init__(self, row: dict):
            self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(row["n"], -1)
            self.counts = np.frombuffer(row["member_counts"], "<i4")
            self.ends = np.cumsum(self.counts)
            self.members = np.frombuffer(row["members"], "<i8")
            self.levels = _unpack_levels(row["level_sizes"], row["nodes"], row["links"])

        def visit(self, ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            found = search_graph(self.vectors, self.levels, q, max(beam, k + 1))
            out_ids, out_scores = [], []
            for i in range(len(ids)):
                nodes = np.sort(found[i][found[i] >= 0])
                score = (self.vectors[nodes] * q[i]).sum(axis=1)  # the same sum for equal vectors, so ties are ties
                size = self.counts[nodes]
                flat = np.repeat(self.ends[nodes] - size, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                who, how = self.members[flat], np.repeat(score, size)
                other = who != ids[i]
                who, how = who[other], how[other]
                best = np.lexsort((who, -how))[:k]
                out_ids.append(who[best])
                out_scores.append(how[best])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.float64()))], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard stands before the queries that visit it."""
        held, at = None, None
        for batch in batches:
            where = list(zip(batch.column("shard").to_pylist(), batch.column("copy").to_pylist(), strict=True))
            first = 0
            while first < len(where):
                last = first
                while last < len(where) and where[last] == where[first]:
                    last += 1
                part = batch.slice(first, last - first)
                if where[first] != at:
                    at, held = where[first], Shard({c: part.column(c)[0].as_py() for c in columns})
                    part = part.slice(1)
                if part.num_rows:
                    flat = part.column("query").flatten().to_numpy(zero_copy_only=False)
                    yield held.visit(part.column("query_id").to_numpy(), flat.reshape(part.num_rows, -1))
                first = last

    found = together.mapInArrow(run, "query_id long, vec_id array<bigint>, score array<double>")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.select("query_id", F.explode(F.arrays_zip("vec_id", "score")).alias("hit"))
        .select("query_id", "hit.vec_id", "hit.score")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest(table: DataFrame, is_query: Column, k: int = 20, shard_size: int = SHARD) -> DataFrame:
    """Index every usable vector and search for the rows that ``is_query`` (on vec_id) chooses."""
    vectors = usable_vectors(table)
    index = build_index(vectors, k, shard_size)
    return search(index, vectors.filter(is_query), k)
