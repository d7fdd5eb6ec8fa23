"""Approximate nearest neighbours by largest inner product: NN-descent graph, greedy search.

Equal vectors are one node. Random hyperplane trees give each node first neighbours; then, round by
round, the neighbours of a node (its own and those that have it) are compared with each other, and each keeps
the best: joins of neighbours of neighbours. A query is a node too: its search starts there and
expands the best nodes not yet expanded, many at a step, within a beam. Graph and search compare vectors of two
bytes a component. Every node of the beam that may be among the best by the error of these codes is then scored in double
precision on the original vectors.

Rounds end when fewer than CHANGED of the graph's entries are new, steps when fewer than CHANGED of the queries have
other best nodes than before; MOST_ROUNDS and MOST_STEPS bound both.

All rows are indexed. Reverse neighbours are the REVERSE best of a node, as NN-descent has it; leaves over
LEAF are dealt by hash into parts, and the rounds after find what that separates. Measured recall is in the README.

Defined results: vectors that are null, zero, empty, of another length than most, or hold null or non-finite components
take no part, nor do rows without an id. Of equal vectors the smallest ids come first. Rows that repeat an id are vectors
each: every one that is a query has a list of its own, in which the others stand as candidates. A table with fewer rows
gives all of them; an empty one gives nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, met, width, written

K, REVERSE, TREES, LEAF = 32, 24, 6, 500
#: The stopping rule: a share of entries or queries, and the most rounds and steps.
CHANGED, MOST_ROUNDS, MOST_STEPS = 0.01, 6, 6
#: Best nodes of a beam whose change makes another step worth while.
WATCHED = 21
#: Groups of nodes that a search deals with, at least; a query asks EXPANDED nodes, so few groups of a small graph would all be asked.
SEARCH_GROUPS = 256
#: Best pairs that a bag of neighbours proposes for each of its nodes.
PROPOSED = 4
BEAM, EXPANDED = 600, 220
#: So many nodes of a beam are scored exactly at least.
RESCORED = 60
#: A code's numbers lie between -LEVELS and LEVELS.
LEVELS = 32767
GRAPH = "node long, nbrs array<long>, scores array<float>"


def _buckets(df: DataFrame, rows: int, each: int = 400) -> int:
    """Groups of about `each` nodes for the Python workers, at least one a shuffle partition."""
    return max(width(df.sparkSession), rows // each + 1)


def _bucket(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias("bucket")


def vectors(table: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, node, v): rows that take part; equal vectors have equal nodes."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + 0.0)
    rows = table.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0)).select("vec_id", F.xxhash64("v").alias("node"), "v")


def coded(rows: DataFrame) -> DataFrame:
    """(node, code, scale): distinct vectors with two bytes a component."""

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("v").to_pylist(), np.float64)
            top = np.abs(x).max(1, keepdims=True)
            q = np.round(x / top * LEVELS).astype(np.int16)
            columns = [batch.column("node"), pa.array([r.tobytes() for r in q], pa.binary()), pa.array((top[:, 0] / LEVELS).astype(np.float32))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "code", "scale"])

    return rows.groupBy("node").agg(F.first("v").alias("v")).mapInArrow(code, "node long, code binary, scale float")


def _matrix(codes, scales) -> np.ndarray:
    raw = b"".join(codes)
    x = np.frombuffer(raw, np.int16).reshape(len(scales), -1).astype(np.float32)
    return x * np.asarray(scales, np.float32)[:, None]


def _best(node, nbr, score, k: int, known=None):
    """The k best distinct neighbours of each node: positions in the input, sorted by node, then score."""
    order = np.lexsort((nbr, -score, node)) if known is None else np.lexsort((~known, nbr, -score, node))
    n, b = node[order], nbr[order]
    new = np.ones(len(order), bool)
    new[1:] = (n[1:] != n[:-1]) | (b[1:] != b[:-1])
    order, n = order[new], n[new]
    first = np.searchsorted(n, n)
    return order[np.arange(len(n)) - first < k]


def _lists(node, nbr, score, k: int):
    """Rows of GRAPH from flat arrays."""
    import pandas as pd

    at = _best(node, nbr, score, k)
    n, b, s = node[at], nbr[at], score[at]
    cuts = np.flatnonzero(np.diff(n)) + 1
    heads = np.concatenate(([0], cuts)).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    split = lambda a: pd.Series(np.split(a, cuts) if len(n) else [], dtype=object)
    return pd.DataFrame({"node": n[heads], "nbrs": split(b), "scores": split(s)})


def _flat(pdf):
    sizes = pdf["nbrs"].map(len).to_numpy(np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.repeat(
        pdf["node"].to_numpy(),
        sizes,
    ), np.concatenate(pdf["nbrs"].to_list()).astype(np.int64), np.concatenate(pdf["scores"].to_list()).astype(np.float32)


def merged(lists: DataFrame, buckets: int, k: int) -> DataFrame:
    """One row of GRAPH a node from several."""
    return lists.select("node", "nbrs", "scores", _bucket("node", buckets)).groupBy("bucket").applyInPandas(lambda pdf: _lists(*_flat(pdf), k), GRAPH)


def forest(nodes: DataFrame, count: int, dims: int, buckets: int, seed: int, leaf_size: int = LEAF) -> DataFrame:
    """First neighbours: within the leaves of TREES trees of random hyperplanes."""
    depth = max(0, int(np.ceil(np.log2(max(1, count / leaf_size)))))
    planes = np.random.default_rng(seed).normal(size=(TREES, dims, depth)).astype(np.float32)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("code").to_pylist(), batch.column("scale").to_numpy())
            for t in range(TREES):
                leaf = ((x @ planes[t]) > 0) @ (1 << np.arange(depth, dtype=np.int64)) + (np.int64(t) << 48)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), *batch.columns], names=["leaf", *batch.schema.names])

    rows = nodes.select("node", "code", "scale").mapInArrow(place, "leaf long, node long, code binary, scale float")
    sizes = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("m"))
    parts = F.ceil(F.col("m") / (3 * leaf_size))
    rows = rows.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("node", "leaf"), parts).alias("part"), "node", "code", "scale")

    def near(pdf):
        x, ids = _matrix(pdf["code"], pdf["scale"]), pdf["node"].to_numpy()
        k = min(K // 2, len(ids) - 1)
        if k < 1:
            return _lists(ids[:0], ids[:0], np.zeros(0, np.float32), K)
        m = x @ x.T
        np.fill_diagonal(m, -np.inf)
        top = np.argpartition(-m, k - 1, 1)[:, :k]
        return _lists(np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(m, top, 1).ravel(), K)

    return written(merged(rows.groupBy("leaf", "part").applyInPandas(near, GRAPH), buckets, K), "graph")


def _bags(pdf):
    """Bags of (center, member, code, scale, least) to what they propose for their members."""
    center = pdf["center"].to_numpy()
    order = np.lexsort((pdf["member"].to_numpy(), center))
    pdf = pdf.iloc[order]
    center, member, least = center[order], pdf["member"].to_numpy(), pdf["least"].to_numpy(np.float32)
    x = _matrix(pdf["code"], pdf["scale"])
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(center)) + 1, [len(center)]))
    out = [[], [], []]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        ids, at = np.unique(member[a:b], return_index=True)
        if len(ids) < 2:
            continue
        at = at + a
        m = x[at] @ x[at].T
        np.fill_diagonal(m, -np.inf)
        k = min(PROPOSED, len(ids) - 1)
        top = np.argpartition(-m, k - 1, 1)[:, :k]
        score = np.take_along_axis(m, top, 1)
        r, c = np.nonzero(score > least[at][:, None])
        out[0].append(ids[r])
        out[1].append(ids[top[r, c]])
        out[2].append(score[r, c])
    if not out[0]:
        return _lists(member[:0], member[:0], least[:0], K)
    return _lists(*map(np.concatenate, out), K)


def improved(graph: DataFrame, nodes: DataFrame, buckets: int) -> DataFrame:
    """One round: neighbours of the same node are compared with each other."""
    pairs = graph.select("node", F.explode(F.arrays_zip("nbrs", "scores")).alias("x")).select(
        "node",
        F.col("x.nbrs").alias("nbr"),
        F.col("x.scores").alias("score"),
    )
    best = Window.partitionBy("nbr").orderBy(F.col("score").desc(), "node")
    back = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= REVERSE).select(
        F.col("nbr").alias("center"),
        F.col("node").alias("member"),
    )
    own = graph.select(F.col("node").alias("center"), F.explode(F.concat("nbrs", F.array("node"))).alias("member"))
    least = F.when(F.size("scores") >= K, F.element_at("scores", K)).otherwise(F.lit(float("-inf"))).cast("float")
    known = nodes.join(graph.select("node", least.alias("least")), "node", "left").select(
        F.col("node").alias("member"),
        "code",
        "scale",
        F.coalesce("least", F.lit(float("-inf")).cast("float")).alias("least"),
    )
    bags = own.union(back).join(known, "member").select("center", "member", "code", "scale", "least", _bucket("center", buckets))
    proposed = bags.groupBy("bucket").applyInPandas(_bags, GRAPH)
    return written(merged(graph.union(proposed), buckets, K), "graph")


def _new_share(before: DataFrame, after: DataFrame) -> float:
    """The share of after's entries that stand in no list of before."""
    both = after.select("node", "nbrs").join(before.select("node", F.col("nbrs").alias("old")), "node", "left")
    none = F.array().cast("array<long>")
    new = F.size(F.array_except("nbrs", F.coalesce("old", none)))
    found = both.agg(F.sum(new).alias("new"), F.sum(F.size("nbrs")).alias("all")).first()
    return (found["new"] or 0) / max(found["all"] or 0, 1)


def build(nodes: DataFrame, count: int, dims: int, seed: int = 11, rounds: int = MOST_ROUNDS) -> DataFrame:
    """The neighbour graph (node, nbrs, scores), best first."""
    buckets = _buckets(nodes, count)
    graph = forest(nodes, count, dims, buckets, seed)
    for _ in range(rounds):
        before, graph = graph, improved(graph, nodes, buckets)
        share = _new_share(before, graph)
        delete(before)
        if share < CHANGED:
            break
    return graph


def _adjacency(graph: DataFrame, nodes: DataFrame, buckets: int) -> DataFrame:
    """(bucket, node, nbrs, codes, scales): each node with its neighbours' vectors, kept by bucket."""
    pairs = graph.select("node", F.explode("nbrs").alias("nbr")).join(nodes.withColumnRenamed("node", "nbr"), "nbr").select(
        "node",
        "nbr",
        "code",
        "scale",
        _bucket("node", buckets),
    )

    def gather(pdf):
        import pandas as pd

        pdf = pdf.sort_values("node", kind="stable")
        rows = [(b, n, g["nbr"].to_numpy(), b"".join(g["code"]), g["scale"].to_numpy()) for (b, n), g in pdf.groupby(["bucket", "node"], sort=False)]
        return pd.DataFrame(rows, columns=["bucket", "node", "nbrs", "codes", "scales"])

    return written(
        pairs.groupBy("bucket").applyInPandas(gather, "bucket int, node long, nbrs array<long>, codes binary, scales array<float>"),
        "adjacency",
    )


#: ask: the nodes to expand next; done: whether a node of the beam has been, or is among those.
#: moved: whether its best nodes are others than a step before; keep: how many of its first nodes are to be scored exactly.
BEAMS = """query long, code binary, scale float, ids array<long>, scores array<float>, done array<boolean>, ask array<long>, least float,
moved boolean, keep int"""


def _expanded(asked, near):
    """Of one bucket, queries (query, code, scale, least, node) with the neighbours of their nodes that beat their beam."""
    place = {n: i for i, n in enumerate(near["node"])}
    nbrs, scales = near["nbrs"].to_list(), near["scales"].to_list()
    if len(asked) and len(near):
        dims = len(asked["code"].iloc[0]) // 2
        x = _matrix(asked["code"], asked["scale"])
        least = asked["least"].to_numpy(np.float32)
        at = np.array([place.get(n, -1) for n in asked["node"]])
        query = asked["query"].to_numpy()
        out = [[], [], []]
        for i in np.unique(at[at >= 0]):
            mine = np.flatnonzero(at == i)
            y = np.frombuffer(near["codes"].iloc[i], np.int16).reshape(-1, dims).astype(np.float32) * np.asarray(scales[i], np.float32)[:, None]
            s = x[mine] @ y.T
            r, c = np.nonzero(s > least[mine][:, None])
            out[0].append(query[mine[r]])
            out[1].append(np.asarray(nbrs[i])[c])
            out[2].append(s[r, c])
        if out[0]:
            return _lists(*map(np.concatenate, out), BEAM)
    none = np.zeros(0, np.int64)
    return _lists(none, none, np.zeros(0, np.float32), BEAM)


def _beam(pdf):
    """Rows of BEAMS and, with a null code, of what was found for them, to one row a query."""
    import pandas as pd

    rows = []
    for q, g in pdf.groupby("query", sort=False):
        head = g[g["code"].notna()].iloc[0]
        ids = np.concatenate([np.asarray(i, np.int64) for i in g["ids"]])
        scores = np.concatenate([np.asarray(s, np.float32) for s in g["scores"]])
        done = np.concatenate([np.asarray(d, bool) if d is not None else np.zeros(len(i), bool) for d, i in zip(g["done"], g["ids"], strict=True)])
        at = _best(np.zeros(len(ids), np.int64), ids, scores, BEAM, known=done)
        before = np.asarray(head["ids"], np.int64)[:WATCHED]
        ids, scores, done = ids[at], scores[at], done[at]
        moved = not np.array_equal(before, ids[:WATCHED])
        next_ = np.flatnonzero(~done)[:EXPANDED]
        done[next_] = True
        rows.append(
            (q, head["code"], head["scale"], ids, scores, done, ids[next_], scores[-1] if len(ids) >= BEAM else -np.inf, moved, _kept(head, scores)),
        )
    return pd.DataFrame(rows, columns=["query", "code", "scale", "ids", "scores", "done", "ask", "least", "moved", "keep"])


def _kept(head, scores: np.ndarray) -> int:
    """How many of a beam's nodes (best first) may be among the best RESCORED by their exact scores.

    A code is off by half a level a component at most, so a score by the norms of both vectors times that; the largest
    component, LEVELS times the scale, bounds the norm. For nodes the query's own figures serve: those of its best are alike.
    """
    if len(scores) <= RESCORED:
        return len(scores)
    x = np.frombuffer(head["code"], np.int16).astype(np.float64) * float(head["scale"])
    slack = 2 * float(np.linalg.norm(x)) * float(head["scale"]) / 2 * np.sqrt(len(x))
    return max(RESCORED, int(np.searchsorted(-scores, -(scores[RESCORED - 1] - 2 * slack), "right")))


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, count: int) -> DataFrame:
    """(query, node): the best nodes found for each query (query: nodes of the graph)."""
    buckets = max(SEARCH_GROUPS, _buckets(nodes, count))
    near = _adjacency(graph, nodes, buckets)
    start = queries.join(nodes, queries["query"] == nodes["node"])
    own = F.array("query")
    beams = written(
        start.select(
            "query",
            "code",
            "scale",
            own.alias("ids"),
            F.array(F.lit(float("inf")).cast("float")).alias("scores"),
            F.array(F.lit(True)).alias("done"),
            own.alias("ask"),
            F.lit(float("-inf")).cast("float").alias("least"),
            F.lit(True).alias("moved"),
            F.lit(1).alias("keep"),
        ),
        "beams",
    )
    asking = beams.count()
    none = [F.lit(None).cast(t).alias(n) for n, t in (("code", "binary"), ("scale", "float"))]
    for _ in range(MOST_STEPS):
        asked = beams.select("query", "code", "scale", "least", F.explode("ask").alias("node")).select("*", _bucket("node", buckets))
        found = asked.groupBy("bucket").cogroup(near.groupBy("bucket")).applyInPandas(_expanded, GRAPH)
        found = found.select(
            F.col("node").alias("query"),
            *none,
            F.col("nbrs").alias("ids"),
            "scores",
            F.lit(None).cast("array<boolean>").alias("done"),
        )
        old = beams.select("query", "code", "scale", "ids", "scores", "done")
        before = beams
        beams = written(old.union(found).select("*", _bucket("query", buckets)).groupBy("bucket").applyInPandas(_beam, BEAMS), "beams")
        delete(before)
        if beams.where("moved").count() < CHANGED * asking:
            break
    # a query's own node may stand in its beam twice: as the start, and as somebody's neighbour
    return beams.select("query", F.explode(F.array_distinct(F.slice("ids", F.lit(1), F.col("keep")))).alias("node"))


def nearest(table: DataFrame, is_query, k: int = 20, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for whose id is_query holds."""
    rows = written(vectors(table, id_, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    nodes = written(coded(rows), "nodes")
    count = nodes.count()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not count:
        return empty
    dims = len(nodes.first()["code"]) // 2
    graph = build(nodes, count, dims)
    asking = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), F.col("node").alias("query"))
    queries = written(asking.select("query").distinct(), "queries")
    pairs = written(search(graph, nodes, queries, count), "found")
    order = Window.partitionBy("node").orderBy("vec_id", "row")
    members = rows.select("node", "vec_id", "row", F.row_number().over(order).alias("nth")).where(F.col("nth") <= k + 1).drop("nth")
    whole = written(rows.groupBy("node").agg(F.first("v").alias("v")), "whole")
    asked = whole.join(queries, whole["node"] == queries["query"], "left_semi").select(F.col("node").alias("query"), F.col("v").alias("qv"))
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.join(whole, "node").join(asked, "query").select("query", "node", dot.alias("score"))
    # of a query's nodes, those beyond the k + 1 best cannot give one of its k rows
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "node")
    scored = scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 8).drop("nth")
    # one bounded list a node that is asked for, so that a vector which many rows ask with is no hot key
    entry = F.struct((-F.col("score")).alias("s"), "vec_id", "row")
    lists = scored.join(members, "node").groupBy("query").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("list"))
    answers = met(asking, written(lists, "lists"), "query")
    mine = F.slice(F.filter("list", lambda x: x["row"] != F.col("own")), 1, k)
    found = answers.select("query_id", F.posexplode(mine).alias("at", "x"))
    delete(nodes, graph, pairs, queries)
    return found.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op9(table: DataFrame) -> DataFrame:
    return nearest(table, lambda i: i % 20 == 0)
