"""N-gram Jaccard join: documents whose sets of word shingles have a similarity of 0.75 or more.

Sets are ordered alike everywhere: shingles found in few documents first. Of two sets that link, the first shingle
that both have is one of the first n / 4 + 1 of the larger and, as what follows it must still hold 6 / 7 of the smaller,
one of the first n / 7 + 1 of the smaller: it is early there. Sets that lead with a shingle which is early in one of
them meet in a block: that of the smallest set in which it is early. A block holds whole ordered sets in a prefix
tree. Each set walks the tree: what a path shares is counted once for all sets below it, and a
subtree goes as soon as the shingles left on either side cannot reach the overlap a link needs, or when
all of it is in the same component already. A block gives a spanning forest of its links, not the pairs.

Whole sets are shipped only where two of them may link by their parity maps, which never overstate a difference: first maps
of about a bit for each shingle, then, of what these leave, maps of FINE times as many. Both are made anew from the texts: candidates'
ids go to them by broadcast or, where they are too many, texts that a bitmap of those ids lets through are shuffled.

Blocks of more than BLOCK sets are dealt into chunks. What lies outside a block's largest component
after that meets the rest of the block in groups of a chunk and a bounded part of the asking sets, so no link between different
sets is lost. Equal sets are one set throughout. Components come from the forests by alternating large and small stars.

Which shingles count as frequent changes the order alone, not the result: a bounded list of the heaviest goes to
every task. Defined results: a text without words has an empty set and links with nothing, its own
id is its component; rows that repeat an id count as one document each, in the component of its set; a row without an id links
with nothing but equal sets, and has no component of its own. An empty table gives an empty one. A very long text is hashed in parts, and
a group's sets have at most about SHINGLES shingles together beyond one chunk's share. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, delete, fresh, met, width, written

SIZE = 5
#: Sets of a chunk, sets that may ask a chunk at once, and shingles of a chunk (8 bytes each).
BLOCK, ASKING, SHINGLES = 256, 1024, 4_000_000
#: Bits of a fine parity map for each of a coarse one.
FINE = 4
#: The most frequent shingles that every task orders last (16 bytes each): at most so many, of so many documents.
HEAVY, HEAVY_FROM, SEEN = 150_000, 8, 3
HIGH = np.int64(1 << 62)
#: Bits that mark candidates' ids where these are too many to be broadcast: a table of at most MARKS / 64 rows.
MARKS = 1 << 25


def needed(n: int) -> int:
    """Shingles of a set of n that a linked set has at least: ceil(0.75 n)."""
    return (3 * n + 3) // 4


def _ordered(keys: list[np.ndarray], heavy: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """The sets of several texts as ascending keys, frequent shingles last."""
    cuts = np.cumsum([0] + [len(k) for k in keys])
    flat = np.concatenate(keys)
    if len(heavy) and len(flat):
        at = np.minimum(np.searchsorted(heavy, flat), len(heavy) - 1)
        flat = np.where(heavy[at] == flat, HIGH + rank[at], flat)
    return [np.unique(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _set_ids(sets: list[np.ndarray]) -> list[int | None]:
    """A 64-bit id of each set, None for an empty one."""
    from .shingles import mixed

    full = [s for s in sets if len(s)]
    if not full:
        return [None] * len(sets)
    h = mixed(np.concatenate(full).astype(np.uint64))
    starts = np.cumsum([0] + [len(s) for s in full])[:-1]
    ids = iter(mixed(np.add.reduceat(h, starts) ^ mixed(np.bitwise_xor.reduceat(h, starts))).astype(np.int64).tolist())
    return [next(ids) if len(s) else None for s in sets]


def early(n: int) -> int:
    """How many first shingles of a set of n can be the first that it shares with a linked set of its size or more."""
    return n // 7 + 1


def parity_bits(n: int, fine: int = 1) -> int:
    """Bits of the parity map of a set of n: the power of two from n on, 64 at least, times fine."""
    return fine * max(64, 1 << (n - 1).bit_length())


def parity(keys: np.ndarray, fine: int = 1) -> bytes:
    """For each bit whether an odd number of keys falls on it (by their low bits).

    Maps of different lengths compare after folding the longer by xor; the bits in which two maps differ are
    never more than the keys that only one of the sets has.
    """
    size = parity_bits(len(keys), fine)
    bits = np.bincount((keys & (size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(bool), bitorder="little").tobytes()


def _raw(batch):
    import pyarrow as pa

    return [x.as_py() for x in batch.column("text").cast(pa.binary())]


def heavy_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (ascending) and ranks of the most frequent shingles, from counts over all texts."""

    def count(batches):
        import pyarrow as pa

        from .shingles import keys_of

        for batch in batches:
            parts = [k for ks in keys_of(_raw(batch), SIZE) for k in ks]
            keys, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
            often = n >= SEEN
            yield pa.RecordBatch.from_arrays([pa.array(keys[often]), pa.array(n[often].astype(np.int64))], names=["key", "n"])

    rows = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_FROM)
    top = rows.orderBy(F.col("n").desc(), "key").limit(HEAVY).toPandas()
    top = top.sort_values(["n", "key"])
    keys = top["key"].to_numpy(np.int64)
    by_key = np.argsort(keys, kind="stable")
    return keys[by_key], np.arange(len(keys), dtype=np.int64)[by_key]


def described(docs: DataFrame, heavy) -> DataFrame:
    """(doc_id, sid, n, parity, n_early, lead): the id, size, parity map and leading shingles of each document's set.

    Map and shingles stand once a task for each set, however many copies it has; a row without an id has none.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def describe(batches):
        import pyarrow as pa

        from .shingles import keys_of

        seen: set[int] = set()
        for batch in batches:
            at = 0
            for keys in keys_of(_raw(batch), SIZE):
                sets = _ordered(keys, *heavy.value)
                ids = _set_ids(sets)
                owners = batch.column("doc_id").slice(at, len(sets))
                at += len(sets)
                leads, maps = [], []
                for s, sid, known in zip(sets, ids, owners.is_valid().to_pylist(), strict=True):
                    new = sid is not None and sid not in seen and known
                    if new and len(seen) < 1_000_000:
                        seen.add(sid)
                    leads.append(s[: len(s) - needed(len(s)) + 1] if new else s[:0])
                    maps.append(parity(s) if new else None)
                offsets = pa.array(np.cumsum([0] + [len(x) for x in leads]).astype(np.int32))
                lead = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(leads)))
                columns = [
                    owners,
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(maps, pa.binary()),
                    pa.array([early(len(s)) for s in sets], pa.int64()),
                    lead,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sid", "n", "parity", "n_early", "lead"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(describe, f"doc_id {kind}, sid long, n long, parity binary, n_early long, lead array<long>")


def with_sets(docs: DataFrame, rows: DataFrame, heavy, fine: int | None = None) -> DataFrame:
    """rows (doc_id, block, sid, query, comp) with the size of their sets and a fine parity map or, without fine, all keys."""
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    names = ["bucket", "block", "sid", "query", "comp"]

    def emit(batches):
        import pyarrow as pa

        from .shingles import keys_of

        for batch in batches:
            at = 0
            for keys in keys_of(_raw(batch), SIZE):
                sets = _ordered(keys, *heavy.value)
                part = batch.slice(at, len(sets))
                at += len(sets)
                # an id that stands on several rows may name another set
                same = pa.array([a == b for a, b in zip(_set_ids(sets), part.column("sid").to_pylist(), strict=True)], pa.bool_())
                held = pa.array([parity(s, fine) if fine else s.tobytes() for s in sets], pa.binary())
                columns = [part.column(c) for c in names] + [pa.array([len(s) for s in sets], pa.int64()), held]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n", "held"]).filter(same)

    texts = docs.select("doc_id", "text")
    mine = (texts.join(F.broadcast(rows), "doc_id") if few else _marked(texts, rows).join(rows, "doc_id")).select(
        "text",
        "block",
        "sid",
        "query",
        "comp",
        _bucket(rows),
    )
    return mine.mapInArrow(emit, "bucket long, block long, sid long, query boolean, comp long, n long, held binary")


def _marked(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """texts without most of those whose doc_id is not in rows, so that few others are shuffled; none that is goes.

    The bitmap of hashed ids has a fixed size: up to some three million ids it lets a tenth of the others through, and of far more nearly all.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {MARKS}) & 63 as int))")
    marks = written(rows.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "marks")
    return texts.join(F.broadcast(marks), (word == marks["word"]) & (marks["bits"].bitwiseAND(bit) != 0), "left_semi")


def _repeats(docs: DataFrame) -> bool:
    """Whether an id stands on several rows."""
    return bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())


class Tree:
    """Prefix tree of ascending integer arrays, paths without branches as one node.

    Node i holds part of one array; below[i]: its sets and the least and largest size among them.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.part: list[np.ndarray] = []
        self.depth: list[int] = []
        self.children: list[list[int]] = []
        self.ends: list[int] = []  # the set that ends here, or -1
        self.members: list[list[int]] = []
        self.sizes: list[tuple[int, int]] = []
        lcp = [0] * (len(order) + 1)
        for j in range(1, len(order)):
            a, b = sets[order[j - 1]], sets[order[j]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            lcp[j] = int(differ[0]) if len(differ) else m
        self.roots: list[int] = []
        todo = [(0, len(order), 0, self.roots)] if order else []
        while todo:
            lo, hi, depth, siblings = todo.pop()
            cuts = [lo] + [j for j in range(lo + 1, hi) if lcp[j] <= depth] + [hi]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                s = sets[order[a]]
                end = min(lcp[a + 1 : b]) if b - a > 1 else len(s)
                node = len(self.part)
                siblings.append(node)
                self.part.append(s[depth:end])
                self.depth.append(end)
                self.children.append([])
                mine = [order[j] for j in range(a, b)]
                lengths = [len(sets[i]) for i in mine]
                self.members.append(mine)
                self.sizes.append((min(lengths), max(lengths)))
                ended = len(s) == end
                self.ends.append(order[a] if ended else -1)
                if b - a > 1:
                    todo.append((a + ended, b, end, self.children[node]))


def joined(sets: list[np.ndarray], queries: list[int], group: list[int]) -> list[int]:
    """Components (as an index for each set) after linking the queries with all sets they link to.

    group: components that are known before. Sets are arrays of ascending keys.
    """
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict[int, int] = {}
    for i, g in enumerate(group):
        root[find(i)] = find(first.setdefault(g, i))
    left = len({find(i) for i in range(len(sets))})
    values, local = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.cumsum([0] + [len(s) for s in sets])
    mine = [local[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    tree = Tree(mine)
    mark = np.zeros(len(values), np.int64)
    for q in queries:
        if left == 1:
            break
        own, n = mine[q], len(mine[q])
        mark[own] = 1
        todo = [(node, 0) for node in tree.roots]
        while todo:
            node, shared = todo.pop()
            small, large = tree.sizes[node]
            if 4 * large < 3 * n or 3 * small > 4 * n:
                continue
            me = find(q)
            if all(find(i) == me for i in tree.members[node]):
                continue
            part = tree.part[node]
            shared += int(mark[part].sum())
            after = n - int(np.searchsorted(own, part[-1], "right")) if len(part) else n
            if 7 * (shared + min(after, large - tree.depth[node])) < 3 * (n + small):
                continue
            i = tree.ends[node]
            if i >= 0 and 7 * shared >= 3 * (n + len(mine[i])) and find(i) != me:
                root[find(i)] = me
                left -= 1
            todo += [(c, shared) for c in tree.children[node]]
        mark[own] = 0
    return [find(i) for i in range(len(sets))]


def _forests(pdf):
    """Blocks of (block, sid, held, query, comp), held being all keys, to edges (u, v): every set with one of its component."""
    import pandas as pd

    us, vs = [], []
    for _, g in pdf.groupby("block", sort=False):
        g = g.drop_duplicates("sid").sort_values("sid")
        sids = g["sid"].to_numpy()
        sets = [np.frombuffer(k, np.int64) for k in g["held"]]
        comp = joined(sets, list(np.flatnonzero(g["query"].to_numpy())), g["comp"].tolist())
        low: dict[int, int] = {}
        for sid, c in zip(sids, comp, strict=True):
            if low.setdefault(c, sid) != sid:
                us.append(sid)
                vs.append(low[c])
    return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})


def _near(fine: int):
    """A function of rows (block, sid, query, comp, n, held), held being parity maps, that keeps those which may link in their block."""

    def near(pdf):
        keep = np.zeros(len(pdf), bool)
        at = pdf.reset_index(drop=True)
        for _, g in at.groupby("block", sort=False):
            where, sizes, query, comp = g.index.to_numpy(), g["n"].to_numpy(), g["query"].to_numpy(), g["comp"].to_numpy()
            if len(g) < 2 or not query.any():
                continue
            bits = np.array([parity_bits(int(n), fine) for n in sizes])
            maps = [np.frombuffer(p, np.uint64) for p in g["held"]]
            for low in np.unique(bits):
                # linked sets differ by a third in size at most, so their maps by a factor of two
                some = np.flatnonzero((bits == low) | (bits == 2 * low))
                if len(some) < 2:
                    continue
                words = int(low) // 64
                folded = np.array([m if len(m) == words else m[:words] ^ m[words:] for m in (maps[i] for i in some)])
                n = sizes[some]
                for j, i in enumerate(some):
                    if not query[i]:
                        continue
                    ok = (4 * n >= 3 * n[j]) & (3 * n <= 4 * n[j]) & (comp[some] != comp[i])
                    those = np.flatnonzero(ok)
                    those = those[7 * np.bitwise_count(folded[those] ^ folded[j]).sum(1).astype(np.int64) <= n[those] + n[j]]
                    if len(those):
                        keep[where[i]] = True
                        keep[where[some[those]]] = True
        return at.loc[keep, ["block", "sid", "query", "comp"]]

    return near


def _bucket(rows: DataFrame) -> Column:
    """Blocks reach the Python workers in groups, dealt by hash."""
    return F.pmod(F.xxhash64("block"), F.lit(width(rows.sparkSession) * BUCKETS_A_TASK)).alias("bucket")


def _candidates(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """The rows (block, sid, query, comp) that may have a link in their block, going by the coarse maps."""
    whole = rows.join(maps, "sid").select("block", "sid", "query", "comp", "n", F.col("parity").alias("held"), _bucket(rows))
    return written(whole.groupBy("bucket").applyInPandas(_near(1), "block long, sid long, query boolean, comp long"), "candidates")


#: Blocks reach the Python workers in groups, so many to a shuffle partition.
BUCKETS_A_TASK = 16


def components(edges: DataFrame) -> DataFrame:
    """(sid, root) of every set in edges (u, v), u != v: root is the smallest of its component.

    Alternating large and small stars; minima are pre-aggregated before each shuffle, and the hub of a large
    component meets its minimum in a join that has no hot key.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = lambda: tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first(),
    )
    before, now = None, state()
    while now != before:
        few = 2 * now[0] <= BROADCAST_ROWS  # no table of minima has more rows
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(
            met(both.where(F.col("v") > F.col("u")), low, "u", few=few).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "stars",
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = met(large, low, "u", few=few).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        after = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        delete(edges, large)
        edges, before = after, now
        now = state()
    return edges.select(F.col("u").alias("sid"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("sid"), F.col("v").alias("root")).distinct(),
    )


def blocks(rows: DataFrame) -> DataFrame:
    """(leader, sid, early): for every shingle that is early in a set and that several lead with, all of them with the smallest such set.

    A frequent shingle may be that of a third of all sets: its minima are pre-aggregated, and as the list of those
    is bounded by HEAVY they are broadcast. Any other has at most 1 / HEAVY of all places, and goes through one shuffle.
    """
    tokens = rows.select("sid", F.posexplode("lead").alias("at", "token"), "n_early").select(
        "sid",
        "token",
        (F.col("at") < F.col("n_early")).alias("early"),
    )
    first = F.min(F.when(F.col("early"), F.col("sid"))).alias("leader")
    often = tokens.where(F.col("token") >= int(HIGH))
    low = often.groupBy("token").agg(first, F.min("sid").alias("low"), F.max("sid").alias("high")).where("leader is not null and low < high")
    often = often.join(F.broadcast(low.select("token", "leader")), "token").select("leader", "sid", "early")
    same = Window.partitionBy("token")
    spread = [
        F.min(F.when(F.col("early"), F.col("sid"))).over(same).alias("leader"),
        F.min("sid").over(same).alias("low"),
        F.max("sid").over(same).alias("high"),
    ]
    rare = tokens.where(F.col("token") < int(HIGH)).select("sid", "early", *spread).where("leader is not null and low < high")
    return often.union(rare.select("leader", "sid", "early")).groupBy("leader", "sid").agg(F.max("early").alias("early"))


def _parts(rows: DataFrame, of: str, each: int, name: str) -> DataFrame:
    """rows (leader, sid, n, ...) with columns `of` (how many parts its leader has) and `name` (the row's own)."""
    size = rows.groupBy("leader").agg(F.greatest(F.ceil(F.count(F.lit(1)) / each), F.ceil(F.sum("n") / SHINGLES)).alias(of))
    return met(rows, size, "leader").withColumn(name, F.pmod(F.xxhash64("sid"), F.col(of)))


def _everywhere(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _dealt(pairs: DataFrame) -> DataFrame:
    """(block, leader, sid, n, early, chunks): blocks in chunks of about BLOCK sets, the leader in each."""
    dealt = _parts(pairs, "chunks", BLOCK, "own")
    chunk = F.when(F.col("sid") == F.col("leader"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("own"))
    return dealt.withColumn("chunk", F.explode(chunk)).select(F.xxhash64("leader", "chunk").alias("block"), "leader", "sid", "n", "early", "chunks")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text)."""
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"))
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(texts))
    described_ = written(described(docs, heavy), "sets")
    found = written(blocks(described_), "blocks")
    # one row a set: all its rows have equal maps, and any document of it will do
    known = described_.where(F.col("parity").isNotNull()).groupBy("sid").agg(
        F.min("doc_id").alias("doc_id"),
        F.max("n").alias("n"),
        F.max("parity").alias("parity"),
    )
    known = written(known.join(found.select("sid").distinct(), "sid", "left_semi"), "known")
    pairs = written(met(found, known.select("sid", "n"), "sid"), "blocks")
    rows = written(described_.select("doc_id", "sid", "n"), "rows")
    delete(described_, found)
    maps, owners = known.select("sid", "n", "parity"), known.select("sid", "doc_id")

    def links(asked: DataFrame) -> DataFrame:
        coarse = _candidates(asked, maps)
        near = written(met(coarse, owners, "sid"), "near")
        fine = with_sets(docs, near, heavy, FINE).groupBy("bucket").applyInPandas(_near(FINE), "block long, sid long, query boolean, comp long")
        fine = written(fine, "candidates")
        nearer = written(met(fine, owners, "sid"), "near")
        out = written(with_sets(docs, nearer, heavy).groupBy("bucket").applyInPandas(_forests, "u long, v long"), "links")
        delete(coarse, near, fine, nearer)
        return out

    # first each set in one block, that of its smallest leader: this joins most of what belongs together, so
    # that then, over all blocks, few sets are left that may link to another component
    one = pairs.groupBy("sid", "n").agg(F.min("leader").alias("leader")).select("leader", "sid", "n")
    one = one.union(
        met(one.select(F.col("leader").alias("sid")).distinct(), known.select("sid", "n"), "sid").select(F.col("sid").alias("leader"), "sid", "n"),
    ).distinct()
    found = links(_dealt(one.withColumn("early", F.lit(True))).select("block", "sid", F.lit(True).alias("query"), F.col("sid").alias("comp")))
    comp = written(components(found), "components")
    dealt = _with_components(_dealt(pairs), comp)
    found = written(found.union(links(dealt.select("block", "sid", F.col("early").alias("query"), "comp"))), "links")
    comp = written(components(found), "components")
    asked = _remainder(_dealt(pairs).where("chunks > 1"), comp)
    if asked is not None:
        comp = written(components(found.union(links(asked))), "components")
    return _with_ids(rows, comp)


def _with_components(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows (sid, ...) with column comp: the root of its component, a set that no forest holds being its own."""
    return met(rows, comp, "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")


def _with_ids(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows (doc_id, sid, n) with the smallest id of their component; no join has a hot key, however many copies a set has."""
    own = rows.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    own = own.join(comp, "sid", "left").where("root is not null or copies > 1")
    own = written(own.select("sid", "low", F.coalesce("root", "sid").alias("root")), "copied")
    low = own.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = written(met(own.select("sid", "root"), written(low, "least"), "root").select("sid", "component_id"), "ids")
    return met(rows, ids, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _crossed(asking: DataFrame, held: DataFrame) -> DataFrame:
    """(block, sid, query, comp): every asking set with every held one of its leader (both leader, sid, n, comp), in groups of bounded size."""
    held, asking = _parts(held, "chunks", BLOCK, "chunk"), _parts(asking, "parts", ASKING, "part")
    chunks, parts = held.select("leader", "chunks").distinct(), asking.select("leader", "parts").distinct()
    block = F.xxhash64("leader", "chunk", "part", F.lit("crossed")).alias("block")
    left = met(asking, written(chunks, "chunks"), "leader").withColumn("chunk", _everywhere("chunks")).select(
        block,
        "sid",
        F.lit(True).alias("query"),
        "comp",
    )
    right = met(held, written(parts, "parts"), "leader").withColumn("part", _everywhere("parts")).select(
        block,
        "sid",
        F.lit(False).alias("query"),
        "comp",
    )
    return left.union(right)


def _remainder(large: DataFrame, comp: DataFrame) -> DataFrame | None:
    """What is still to be asked of blocks in several chunks.

    Of two sets that link here, one is early. What is outside a block's largest component and early asks all of the block; what
    is outside and late asks the early sets of that component (the others ask it).
    """
    if not large.limit(1).count():
        return None
    members = large.groupBy("leader", "sid", "n").agg(F.max("early").alias("early"))
    members = written(_with_components(members, comp), "large")
    own = members.groupBy("leader", "comp").agg(F.count(F.lit(1)).alias("m"))
    most = own.groupBy("leader").agg(F.max(F.struct("m", "comp")).alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1")
    members = written(met(members, written(most.select("leader", F.col("most.comp").alias("main")), "most"), "leader"), "large")
    outside = F.col("comp") != F.col("main")
    if not members.where(outside).limit(1).count():
        return None
    columns = ["leader", "sid", "n", "comp"]
    first = _crossed(members.where(outside & F.col("early")).select(columns), members.select(columns))
    second = _crossed(
        members.where(outside & ~F.col("early")).select(columns),
        members.where(~outside & F.col("early")).select("leader", "sid", "n", "comp"),
    )
    second = second.withColumn("block", F.xxhash64("block", F.lit("late")))
    return written(
        first.union(second).groupBy("block", "sid", "comp").agg(F.max("query").alias("query")).select("block", "sid", "query", "comp"),
        "asked",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the smallest id. Rows without an id or without words stay.

    Rows with a repeated id are documents of their own; of those in one class any may stay.
    """
    slim = docs.select("doc_id", "text")
    if not _repeats(slim):
        found = classes(slim)
        out = docs.join(found.where(F.col("doc_id") == F.col("component_id")).select("doc_id"), "doc_id", "left_semi")
    else:
        (row,) = fresh(docs, "row_of_docs")
        rows = written(docs.where(F.col("doc_id").isNotNull()).withColumn(row, F.monotonically_increasing_id()), "rows")
        found = classes(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
        first = F.min(F.struct(F.col("doc_id"), F.col(row)))[row].alias(row)
        out = rows.join(found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(first), row, "left_semi").drop(row)
    return out.select(*docs.columns).union(docs.where(F.col("doc_id").isNull()).select(*docs.columns))


def op7(docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text"))
