"""Embedding near-dedup: vectors of one label whose cosine reaches a threshold, and one representative of each group.

Spherical k-means deals the vectors into cells; blocks of a cell are compared by products of matrices of unit
vectors, and of each group of linked vectors the smallest id is kept.

No link is lost between cells. Let d be the largest distance of two linked unit vectors. If x is nearest to centroid a
and y to b, then (x - y)(a - b) is at most d |a - b|, so for one of them the margin between both cells is at most half of that:
a vector stands in every cell whose margin from its own is at most d / 2, and each linked pair meets. A pair may meet in
several cells; it counts in the smallest one that both stand in. Centroids closer than 2 d are one, as such cells
would share most of their vectors. So the cells change the work and never the result, and they may be
fitted on a bounded sample: SAMPLE vectors a cell, at most MOST_CELLS cells. Labels of up to CELL vectors are one cell.

Equal vectors of a label are one node with a number of copies. A cell of more than BLOCK vectors is dealt into parts,
and each pair of parts is a block of its own: no task holds more than two parts, and no pairs are written, only
each vector's number of links in the block and one edge of a spanning forest. Components come from these edges by
alternating large and small stars.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows without a label and rows
without an id link with nothing, and are kept. Vectors of different lengths do not link. Rows that repeat an id are vectors
each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, met, written
from .jaccard_join import components

LEAST_COSINE = 0.98
#: Vectors of a label above which it is dealt into cells, and vectors of a part.
CELL, BLOCK = 4096, 2048
#: At most so many cells, and vectors of the sample for each of them.
MOST_CELLS, SAMPLE, ROUNDS = 4096, 32, 6


def units(raw: list) -> np.ndarray:
    """Vectors (as bytes of doubles) of length 1; the largest component goes first, so that no square overflows."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def packed(values) -> list[bytes]:
    return [np.asarray(v, np.float64).tobytes() for v in values]


def _apart(centroids: np.ndarray, least: float) -> np.ndarray:
    """Centroids without those nearer than least to an earlier one."""
    kept: list[int] = []
    near = centroids @ centroids.T > 1 - least * least / 2
    for i in range(len(centroids)):
        if not near[i, kept].any():
            kept.append(i)
    return centroids[kept]


def fitted(x: np.ndarray, k: int, least: float, seed: int = 5) -> np.ndarray:
    """Up to k centroids of unit vectors, none nearer to another than least (spherical k-means)."""
    at = np.random.default_rng(seed).permutation(len(x))
    centroids = _apart(x[at[:k]], least)
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centroids)
    return _apart(centroids, least)


def standing(x: np.ndarray, centroids: np.ndarray, margin: float) -> list[np.ndarray]:
    """For each unit vector the cells in which it stands: its own, and those within the margin."""
    score = x @ centroids.T
    own = score.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    gap = score[np.arange(len(x)), own][:, None] - score
    row, cell = np.nonzero(gap <= margin * apart[own] + 1e-9)
    return np.split(cell.astype(np.int64), np.flatnonzero(np.diff(row)) + 1) if len(x) else []


def _forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row of its component."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] >= 0:
            continue
        mine = np.zeros(len(near), bool)
        mine[i] = True
        front = mine
        while front.any():
            front = near[front].any(0) & ~mine
            mine = mine | front
        root[mine] = i
    return root


def _compared(pdf, least: float):
    """The rows (node, copies, vec, cell, cells, side) of a block to (node, n, other): links here, and an edge of a forest."""
    import pandas as pd

    pdf = pdf.sort_values(["side", "node"])
    x, node, side, copies = units(pdf["vec"].to_list()), pdf["node"].to_numpy(), pdf["side"].to_numpy(), pdf["copies"].to_numpy()
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    if side[0] != side[-1]:  # two parts: pairs within one are compared in its own block
        near &= side[:, None] != side[None]
    some = np.flatnonzero(near.any(1))
    near = near[np.ix_(some, some)]
    counted = near
    here = pdf["cell"].iloc[0]
    earlier = [c[c < here] for c in pdf["cells"].iloc[some]]
    if any(len(c) for c in earlier):
        # a pair that both stand in an earlier cell is counted there
        ids, at = np.unique(np.concatenate(earlier), return_inverse=True)
        held = np.zeros((len(some), len(ids)), np.float32)
        held[np.repeat(np.arange(len(some)), [len(c) for c in earlier]), at] = 1
        counted = near & (held @ held.T == 0)
    n = counted @ copies[some].astype(np.float64)
    return pd.DataFrame({"node": node[some], "n": n.astype(np.int64), "other": node[some][_forest(near)]})


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, key, v, low, copies): distinct vectors of a label, from rows (vec_id, key, v)."""
    held = [F.first("v").alias("v"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies")]
    found = rows.where(F.col("key").isNotNull()).groupBy("key").agg(*held)
    return written(found.withColumn("node", F.monotonically_increasing_id()), "nodes")


def centroids_of(nodes: DataFrame, least: float) -> tuple[np.ndarray | None, int, DataFrame]:
    """Centroids (None where no label needs cells), their number of components, and the labels (group) to be dealt."""
    sizes = nodes.groupBy("key.label", "key.size").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > CELL), "large")
    most = large.orderBy(F.col("n").desc(), "size").first()
    group = large.select(F.struct("label", "size").alias("group"), F.lit(True).alias("dealt"))
    if most is None:
        return None, 0, group
    dims = most["size"]
    k = min(MOST_CELLS, -(-most["n"] // CELL) + 1)
    mine = nodes.where(F.col("key.size") == dims)
    total, want = mine.count(), SAMPLE * k
    some = mine.where(F.pmod(F.xxhash64("node"), F.lit(total)) < 2 * want).select("v").limit(want)
    return fitted(units(packed(r.v for r in some.collect())), k, least), dims, group


def placed(nodes: DataFrame, least: float) -> DataFrame:
    """(node, copies, group, cell, cells, vec): every node in each cell in which it stands."""
    reach = float(np.sqrt(2 - 2 * least))
    centroids, dims, large = centroids_of(nodes, 2 * reach)
    held = nodes.sparkSession.sparkContext.broadcast(centroids)
    rows = nodes.select("node", "copies", F.struct(F.col("key.label"), F.col("key.size")).alias("group"), "v")
    rows = met(rows, large, "group", "left").withColumn("dealt", F.coalesce(F.col("dealt") & (F.col("group.size") == dims), F.lit(False)))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            raw = packed(batch.column("v").to_pylist())
            dealt = np.flatnonzero(batch.column("dealt").to_numpy(zero_copy_only=False))
            cells = [np.zeros(1, np.int64)] * len(raw)
            if len(dealt):
                for i, own in zip(dealt, standing(units([raw[i] for i in dealt]), held.value, reach / 2), strict=True):
                    cells[i] = own
            times = np.array([len(c) for c in cells])
            row = np.repeat(np.arange(len(raw)), times)
            flat = np.concatenate(cells) if len(cells) else np.zeros(0, np.int64)
            whole = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *times]).astype(np.int32)), pa.array(flat))
            at = pa.array(row)
            columns = [batch.column(c).take(at) for c in ("node", "copies", "group")]
            columns += [pa.array(flat), whole.take(at), pa.array(raw, pa.binary()).take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "copies", "group", "cell", "cells", "vec"])

    group = rows.schema["group"].dataType.simpleString()
    return rows.mapInArrow(place, f"node long, copies long, group {group}, cell long, cells array<long>, vec binary")


def links(nodes: DataFrame, least: float) -> DataFrame:
    """(node, n, other) of every block: the node's links counted there, and a node of its component."""
    rows = written(placed(nodes, least), "placed").withColumn("at", F.struct("group", "cell"))
    parts = rows.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).where("parts > 1")
    rows = met(rows, written(parts, "parts"), "at", "left").na.fill(1, ["parts"])
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rows = rows.withColumn("with", other).withColumn("low", F.least("side", "with")).withColumn("high", F.greatest("side", "with"))
    found = rows.groupBy("group", "cell", "low", "high").applyInPandas(lambda pdf: _compared(pdf, least), "node long, n long, other long")
    return written(found, "links")


def valid(v: Column) -> Column:
    """Whether v (array of doubles) is a vector with a direction."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce((F.size(v) > 0) & fine, F.lit(False))


def near_duplicates(table: DataFrame, least: float = LEAST_COSINE, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of table."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + 0.0)
    rows = table.select(F.col(id_).alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    part = valid(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    size, first, second = F.size("v").alias("size"), F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(1)).alias("g")
    rows = rows.withColumn("key", F.when(part, F.struct("label", size, first, second)))
    nodes = nodes_of(rows)
    found = links(nodes, least)
    comp = written(components(found.select(F.col("node").alias("u"), F.col("other").alias("v")).where("u <> v")), "components")
    counts = written(found.groupBy("node").agg(F.sum("n").alias("n")), "counts")
    mine = nodes.select("node", "key", "low", "copies")
    mine = met(met(mine, counts, "node", "left"), comp.withColumnRenamed("sid", "node"), "node", "left")
    mine = written(mine.where("n > 0 or copies > 1").withColumn("root", F.coalesce("root", "node")), "linked")
    least_id = written(mine.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    n = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    answers = written(met(mine, least_id, "root").select("key", n, "component_id"), "answers")
    out = met(rows.select("vec_id", "key"), answers, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"))
    delete(found, comp, counts, least_id)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12(table: DataFrame) -> DataFrame:
    return near_duplicates(table)


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {LEAST_COSINE}),
reach AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT reach.vec_id, b FROM reach JOIN pairs ON c = a),
low AS (SELECT vec_id, min(c) AS c FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN low ON v.vec_id = low.vec_id LEFT JOIN n ON v.vec_id = a
"""
