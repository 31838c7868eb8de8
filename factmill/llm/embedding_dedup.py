"""Near-duplicate vectors by a subspace pigeonhole join.

Cosine t or more between unit vectors is a squared distance of 2 - 2t or less. Vectors are
rotated by a fixed random rotation and split into blocks of few dimensions. If a pair is
within the budget, then in some block its squared distance is within that block's share of
it. Each block is range-joined by itself, on its coordinates alone:

Space is cut at zero along the block's first axes, as many as it takes for a cell of a
label to hold about LEAF vectors. A vector is posted in its own cell and in those of higher
number that a ball of the block's radius around it reaches, by the squared distance to the
cell, so each pair within the radius meets in exactly one cell. Small labels aren't cut,
and their vectors are posted once for each block. Crowded cells are dealt out over pairs
of chunks. What leaves the join are the vectors that met a candidate there, not the pairs.

Only those vectors are then fetched, once for each cell in which they met one, and every
candidate pair is verified there on the stored vectors in double precision, in the first
block that passes it. A task returns link counts by vector and a spanning forest of the
links it found, so its output is as long as its input. Equal vectors count as one with a
weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

COSINE = 0.98
BLOCK_DIMS = 16
#: Vectors of a cell that one task compares with as many others, about.
LEAF = 4096
_TILE, _SLICE = 256, 1 << 15
#: Blocks are compared in single precision, which this allows for; verification isn't.
_SLACK, _COARSE = 1e-9, 1e-5
_CELL = ["label", "dims", "block", "cell"]
_TASK = [*_CELL, "low", "high"]


@lru_cache(8)
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation, from a seed."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dims)).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _blocks(dims: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def _budgets(dims: int, cosine: float) -> list[float]:
    return [(2 - 2 * cosine) * (b.stop - b.start) / dims + _SLACK for b in _blocks(dims)]


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(z: np.ndarray, depth: int, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cells, whether it is their own): where vectors are posted, the cells being sign patterns of `depth` axes."""
    below = z[:, :depth] < 0
    own = (below << np.arange(depth)).sum(axis=1).astype(np.int64)
    rows, at, spent = np.arange(len(z)), own.copy(), np.zeros(len(z))
    yield rows, own, np.ones(len(z), bool)
    for axis in range(depth):
        # the cells beyond this axis that are still within reach, from all those found before
        further = spent + z[rows, axis] ** 2
        reached = np.flatnonzero(further <= budget + _COARSE)
        rows, at = np.concatenate((rows, rows[reached])), np.concatenate((at, at[reached] ^ (1 << axis)))
        spent = np.concatenate((spent, further[reached]))
    higher = np.flatnonzero(at > own[rows])
    yield rows[higher], at[higher], np.zeros(len(higher), bool)


def _postings(nodes: DataFrame, cosine: float) -> DataFrame:
    """label, dims, block, cell, id, own, z: the cells of each vector in each block, z holding its coordinates there."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, depths = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            sizes = np.array([len(v) for v in batch.column(2)])
            for dims, depth in {(int(s), int(d)) for s, d in zip(sizes, depths, strict=True)}:
                chosen = np.flatnonzero((sizes == dims) & (depths == depth))
                y = _unit(batch.column(2).take(pa.array(chosen)).to_pylist()) @ rotation(dims).T
                for k, (block, budget) in enumerate(zip(_blocks(dims), _budgets(dims, cosine), strict=True)):
                    z = y[:, block]
                    for rows, cell, own in cells(z, min(depth, z.shape[1]), budget):
                        if n := len(rows):
                            coordinates = z[rows].astype(np.float32)
                            columns = [
                                pa.array(labels[chosen[rows]], pa.int32()), pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, k, np.int32)),
                                pa.array(cell), pa.array(ids[chosen[rows]], pa.int64()), pa.array(own), pa.array([c.tobytes() for c in coordinates], pa.binary()),
                            ]
                            yield pa.RecordBatch.from_arrays(columns, names=[*_CELL, "id", "own", "z"])

    return nodes.select("id", "label", "embedding", "depth").mapInArrow(each, "label int, dims int, block int, cell long, id long, own boolean, z binary")


def _dealt(posted: DataFrame, leaf: int) -> DataFrame:
    """The postings of cells with two members or more, each with the chunk pairs that it is compared in."""
    sizes = posted.groupBy(*_CELL).agg(F.count("*").alias("n"), F.count(F.when(F.col("own"), 1)).alias("n_own")).where("n > 1 and n_own > 0")
    met = posted.join(sizes.select(*_CELL, F.ceil(F.col("n") / (2 * leaf)).cast("int").alias("chunks")), _CELL)
    met = met.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return met.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other")).drop("chunks", "other")


class _Task:
    """The members of one cell (or of two of its chunks) in order of their ids."""

    def __init__(self, table: pa.Table, cosine: float):
        self.dims, self.block, low, high = (table[c][0].as_py() for c in ("dims", "block", "low", "high"))
        self.budget = _budgets(self.dims, cosine)[self.block]
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        self.table, self.ids = table.take(pa.array(order)), ids[order]
        self.own, chunk = self.table["own"].to_numpy(zero_copy_only=False), self.table["chunk"].to_numpy()
        width = _blocks(self.dims)[self.block]
        self.z = np.frombuffer(b"".join(self.table["z"].to_pylist()), np.float32).reshape(len(ids), width.stop - width.start)
        self.left, self.right, self.alone = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high), low == high

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places within the block's radius, one of them at least in its own cell; each pair once."""
        square = (self.z * self.z).sum(axis=1)
        for at in range(0, len(self.left), _TILE):
            a = self.left[at : at + _TILE]
            b = self.right[self.right > a[0]] if self.alone else self.right
            near = square[a][:, None] + square[b][None, :] - 2 * self.z[a] @ self.z[b].T <= self.budget + _COARSE
            p, q = np.nonzero(near)
            p, q = a[p], b[q]
            fits = self.own[p] | self.own[q]
            if self.alone:
                fits &= p < q
            yield p[fits], q[fits]


def _candidates(table: pa.Table, cosine: float) -> pa.Table:
    """The task's postings that meet a candidate."""
    task = _Task(table, cosine)
    meets = np.zeros(len(task.ids), bool)
    for p, q in task.candidates():
        meets[p] = meets[q] = True
    return task.table.select([*_TASK, "id", "own", "chunk", "z"]).filter(pa.array(meets))


def _verify(table: pa.Table, cosine: float) -> pa.Table:
    """Link counts of a task's vectors and a spanning forest of its links: (id, linked, root)."""
    task = _Task(table, cosine)
    x = _unit(task.table["embedding"].to_pylist())
    y = x @ rotation(task.dims).T
    weight = task.table["weight"].to_numpy()
    blocks, budgets, k = _blocks(task.dims), _budgets(task.dims, cosine), task.block
    linked, root = np.zeros(len(task.ids), np.int64), np.arange(len(task.ids))
    for p, q in task.candidates():
        for s in range(0, len(p), _SLICE):
            u, v = p[s : s + _SLICE], q[s : s + _SLICE]
            gaps = (y[u] - y[v]) ** 2
            first = gaps[:, blocks[k]].sum(axis=1) <= budgets[k]
            for b in range(k):
                first &= gaps[:, blocks[b]].sum(axis=1) > budgets[b]
            u, v = u[first], v[first]
            same = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
            u, v = u[same], v[same]
            np.add.at(linked, u, weight[v])
            np.add.at(linked, v, weight[u])
            while len(u):
                least, before = np.minimum(root[u], root[v]), root.copy()
                np.minimum.at(root, u, least)
                np.minimum.at(root, v, least)
                np.minimum.at(root, before[u], least)
                np.minimum.at(root, before[v], least)
                root = root[root]
                if (root == before).all():
                    break
    some = np.flatnonzero((linked > 0) | (root != np.arange(len(root))))
    return pa.table({"id": task.ids[some], "linked": linked[some], "root": task.ids[root[some]]})


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, leaf: int = LEAF
) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are equal, and
    their cosine is `cosine` or more. A vector that is null, empty, zero, or holds a null
    or non-finite component links with nothing. Rows that share an identifier are vectors
    of their own. A row without an identifier links like others, but gives its component
    no name: the component of such rows alone is null, and they are kept. Further columns
    are ignored; an empty table gives no rows. Equal vectors are told by 128 bits of hash.
    """
    own = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col(label_col).isNotNull() & (F.size(own) > 0) & F.forall(own, finite) & F.exists(own, lambda x: x != 0)
    source = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"),
        own.alias("embedding"), F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64(own).alias("h1"), F.xxhash64(F.lit(1), own).alias("h2"),
    )
    base = cut(source)
    named = ["label", "h1", "h2"]
    nodes = base.where("usable").groupBy(*named).agg(F.min("row").alias("id"), F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    nodes = cut(nodes)
    # one row to a label and length
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / leaf))).cast("int").alias("depth")
    depths = nodes.groupBy("label", F.size("embedding").alias("dims")).agg(depth)
    placed = nodes.select("id", "label", "embedding", F.size("embedding").alias("dims")).join(depths, ["label", "dims"])

    dealt = _dealt(_postings(placed, cosine), leaf)
    schema = "label int, dims int, block int, cell long, low int, high int, id long, own boolean, chunk int, z binary"
    met = cut(dealt.groupBy(*_TASK).applyInArrow(lambda t: _candidates(t, cosine), schema))
    fetched = met.join(nodes.select("id", "weight", "embedding"), "id")
    found = fetched.groupBy(*_TASK).applyInArrow(lambda t: _verify(t, cosine), "id long, linked long, root long")
    found = cut(found.groupBy("id", "root").agg(F.sum("linked").alias("linked")))

    counts = found.groupBy("id").agg(F.sum("linked").alias("linked"))
    component = connected_components(found.where("id <> root"), "id", "root").withColumnsRenamed({"node": "id", "component": "top"})
    of_node = nodes.select("id", *named, "least", "weight").join(counts, "id", "left").join(component, "id", "left")
    of_node = cut(of_node.select(*named, "least", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("top", "id").alias("top")))
    names = of_node.groupBy("top").agg(F.min("least").alias("component_id"))
    linked = base.where("usable").select("vec_id", *named).join(of_node.join(names, "top").select(*named, "n_links", "component_id"), named)
    alone = base.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked.select("vec_id", "n_links", "component_id").union(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def oracle_sql() -> str:
    """DuckDB SQL for the query's rows: all pairs of a label."""
    usable = "label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return f"""
WITH RECURSIVE base AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v, coalesce({usable}, false) AS usable FROM embeddings),
links AS (
  SELECT a.r AS a, b.r AS b FROM base a JOIN base b ON a.label = b.label AND a.r <> b.r AND a.usable AND b.usable AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
reach(r, top) AS (SELECT r, r FROM base UNION SELECT links.b, reach.top FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT reach.r, min(base.vec_id) AS component_id FROM reach JOIN base ON base.r = reach.top GROUP BY reach.r),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM base JOIN least USING (r) LEFT JOIN counts USING (r)
"""
