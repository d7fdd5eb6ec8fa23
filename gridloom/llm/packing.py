"""Best-fit packing of documents into sequences of a fixed number of tokens, by bulk-synchronous supersteps.

Documents are cut into pieces of at most `CAPACITY` tokens. Lengths and gaps are therefore whole numbers with that bound, so the
range-sorted documents and gaps are tables of runs: equal pieces of consecutive ranks, and consecutive sequences with equal gaps.
A superstep is one Spark plan over both, in order of size:

- successor sweep: every piece asks for the smallest gap that is not smaller than it. Where more ask than there are
  gaps, the longer rank first and the others wait for the next superstep;
- rank sweep, once successors give less than `POOR` of the gaps a piece: running sums find the most pieces and gaps that can be
  matched (the longest pieces, the smallest gaps), and they meet in order of size.

Then gaps are updated, and so on until nothing is left. Where no piece fits a gap, as many sequences are opened as the pieces left need at least:
what they hold by volume, or one for each piece of over half the capacity. Where the gaps are a multiple of the longest piece left, so many equal pieces go as a bundle.

The runs depend on `CAPACITY`, not on the number of documents, and so does the plan; pieces, their ranks and their places stay on the
executors. Which of the equal pieces gets which of the equal gaps is decided by rank.

Defined results: null text is empty and holds the separator alone. Repeated rows are documents of their own. An empty table
has no pieces. Equal pieces may change places between runs if their rows are equal. A very long text is encoded whole. Columns but doc_id and
text are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, width, written

CAPACITY, SEPARATOR = 2048, 0
#: A successor sweep that gives less than this share of the gaps a piece is followed by a rank sweep.
POOR = 0.05
#: Texts of these characters alone, without an added token of the tokenizer, are encoded from the same vocabulary as ranks, which is
#: faster; tests hold both against each other. All others go through the tokenizer file itself.
PLAIN = re.compile("[^\x00-ɏ‐-‧€]")


@lru_cache(1)
def _encoder(path: str, ranks: str | None):
    """A function of a text to its ids; loaded once a worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    slow = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
    if ranks is None:
        return slow
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return lambda t: np.asarray(
        fast.encode_to_numpy(t, disallowed_special=()),
        np.uint32,
    ) if PLAIN.search(t) is None and not any(a in t for a in added) else slow(t)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    if tokenizer is None:
        tokenizer, ranks = vocabulary()

    def cut(batches):
        import zlib

        import pyarrow as pa

        encode = _encoder(tokenizer, ranks)
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(SEPARATOR)).astype("<u4")
                count = -(-len(ids) // capacity)
                first = len(ids) - capacity * (count - 1)
                for k in range(count):
                    a = 0 if k == 0 else first + capacity * (k - 1)
                    b = first + capacity * k
                    owner.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


#: Rows of a superstep's table: a run of pieces (length, how many are left, next rank), a run of gaps (gap, sequences, first
#: sequence), or pieces that have a place (length, first rank, first sequence, offset; up to the next rank given for the length; gaps
#: that this took, once a bundle).
PIECE, GAP, PLACED = 0, 1, 2
STEP = "struct<row:int,size:bigint,a:bigint,b:bigint,c:bigint,gaps:bigint>"


def superstep(state: DataFrame, by_rank: bool, bundle: int, capacity: int) -> DataFrame:
    """The rows after one sweep: runs of pieces and gaps, and what it has placed. bundle: most equal pieces that go at once."""
    gap = F.col("row") == GAP
    w = F.when(gap, F.lit(1)).otherwise(
        F.greatest(F.least(F.lit(bundle), F.col("a"), F.floor(F.lit(capacity) / F.col("size"))), F.lit(1)),
    ).cast("long")
    u = state.where(F.col("row") != PLACED).select("row", "size", "a", "b", gap.alias("gap"), w.alias("w"))
    u = u.withColumn("v", F.col("size") * F.col("w")).withColumn("n", F.floor(F.col("a") / F.col("w")))
    gap, n = F.col("gap"), F.col("n")
    to_here, to_last = (Window.unboundedPreceding, Window.currentRow), (Window.unboundedPreceding, -1)
    up = Window.orderBy("v", "gap", "size", "b")  # pieces before gaps of their size
    down = Window.orderBy(F.desc("v"), F.desc("gap"), F.desc("size"), "b")
    if by_rank:
        for name, order, sign in (("used", up, 1), ("matched", down, -1)):
            u = u.withColumn("sum", F.sum(F.when(gap, -n).otherwise(n) * sign).over(order.rowsBetween(*to_here)))
            u = u.withColumn("low", F.min(F.least(F.col("sum"), F.lit(0))).over(order.rowsBetween(*to_here)))
            u = u.withColumn(name, n - (F.lag("low", 1, 0).over(order) - F.col("low")))
        u = u.withColumn("group", F.lit(0).cast("long")).withColumn("take", F.when(gap, F.col("used")).otherwise(F.col("matched")))
    else:
        successor = F.last(F.when(gap, F.col("v")), ignorenulls=True).over(down.rowsBetween(*to_here))
        u = u.withColumn("group", F.when(gap, F.col("v")).otherwise(successor))
        whole = Window.partitionBy("group")
        count = lambda which: F.sum(F.when(which, n).otherwise(0)).over(whole)
        both = F.least(count(gap), count(~gap))
        side = Window.partitionBy("group", "gap").orderBy(F.desc("v"), F.desc("size"), "b").rowsBetween(*to_last)
        free = F.when(F.col("group").isNull(), F.lit(0)).otherwise(both - F.coalesce(F.sum(n).over(side), F.lit(0)))
        u = u.withColumn("take", F.greatest(F.lit(0), F.least(n, free)))
    side = Window.partitionBy("group", "gap").orderBy(F.desc("v"), F.desc("size"), "b").rowsBetween(*to_last)
    u = u.withColumn("at", F.coalesce(F.sum("take").over(side), F.lit(0)))
    met = Window.partitionBy("group").orderBy("at", "gap", F.desc("v"), F.desc("size"), "b")
    run = F.struct("size", "b", "w", "at", "take")
    latest = lambda which: F.last(F.when(which & (F.col("take") > 0), run), ignorenulls=True).over(met.rowsBetween(*to_here))
    total = F.sum(F.when(gap, F.col("take"))).over(Window.partitionBy("group"))
    u = u.withColumns({"p": latest(~gap), "g": latest(gap), "m": F.coalesce(F.lead("at").over(met), total) - F.col("at")})
    row = lambda kind, size, a, b, c=F.lit(None), gaps=F.lit(None): F.struct(
        F.lit(kind).alias("row"),
        *[x.cast("long").alias(n) for x, n in ((size, "size"), (a, "a"), (b, "b"), (c, "c"), (gaps, "gaps"))],
    )
    own = F.when(gap, row(GAP, F.col("size"), n - F.col("take"), F.col("b") + F.col("take"))).otherwise(
        row(PIECE, F.col("size"), F.col("a") - F.col("take") * F.col("w"), F.col("b") + F.col("take") * F.col("w")),
    )
    first = F.col("g.b") + F.col("at") - F.col("g.at")
    left = row(GAP, F.col("g.size") - F.col("p.size") * F.col("p.w"), F.col("m"), first)
    each = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("p.w") - 1),
        lambda k: row(
            PLACED,
            F.col("p.size"),
            F.col("p.b") + k * F.col("p.take") + F.col("at") - F.col("p.at"),
            first,
            F.lit(capacity) - F.col("g.size") + k * F.col("p.size"),
            F.when(k == 0, F.col("m")),
        ),
    )
    made = F.when(
        (F.col("m") > 0) & F.col("p").isNotNull() & F.col("g").isNotNull(),
        F.concat(F.array(left), each),
    ).otherwise(F.expr(f"cast(array() as array<{STEP}>)"))
    out = u.select(F.explode(F.concat(F.array(own), made)).alias("x")).select("x.*")
    return out.where((F.col("row") == PLACED) | ((F.col("size") > 0) & (F.col("a") > 0)))


def best_fit(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(length, rank, first, offset) from (length, n): pieces of a length, from that rank on up to the next given, go to consecutive sequences from first on.

    What comes to the driver is one row of totals a superstep.
    """
    spark = counts.sparkSession
    none = F.lit(None).cast("long")
    state = counts.select(
        F.lit(PIECE).alias("row"),
        F.col("length").cast("long").alias("size"),
        F.col("n").cast("long").alias("a"),
        F.lit(0).cast("long").alias("b"),
        none.alias("c"),
        none.alias("gaps"),
    )
    tables: list[DataFrame] = []
    sequences, by_rank, dry = 0, False, False
    while True:
        piece, gap = F.col("row") == PIECE, F.col("row") == GAP
        longest = F.max(F.when(piece, F.col("size"))).over(Window.partitionBy())
        t = state.withColumn("longest", longest).agg(
            F.coalesce(F.sum(F.when(F.col("row") == PLACED, F.col("gaps"))), F.lit(0)).alias("placed"),
            F.coalesce(F.sum(F.when(piece, F.col("a"))), F.lit(0)).alias("left"),
            F.sum(F.when(piece, F.col("a") * F.col("size"))).alias("volume"),
            F.coalesce(F.sum(F.when(piece & (2 * F.col("size") > capacity), F.col("a"))), F.lit(0)).alias("large"),
            F.max("longest").alias("longest"),
            F.min(F.when(piece, F.col("size"))).alias("shortest"),
            F.coalesce(F.sum(F.when(gap, F.col("a"))), F.lit(0)).alias("gaps"),
            F.coalesce(F.max(F.when(gap, F.col("size"))), F.lit(0)).alias("widest"),
            F.percentile(F.when(gap & (F.col("size") >= F.col("longest")), F.col("size")), 0.25, F.when(gap, F.col("a")).otherwise(1)).alias("usual"),
        ).first()
        if not t["left"]:
            break
        usual, placed = t["usual"], t["placed"]
        dry = placed == 0 and (dry or by_rank)  # a rank sweep that places nothing is the last that these gaps need
        if not tables or dry or t["widest"] < t["shortest"]:
            new = max(t["large"], -(-t["volume"] // capacity))
            opened = spark.range(1).select(
                F.lit(GAP).alias("row"),
                F.lit(capacity).cast("long").alias("size"),
                F.lit(new).cast("long").alias("a"),
                F.lit(sequences).cast("long").alias("b"),
                none.alias("c"),
                none.alias("gaps"),
            )
            state, sequences, by_rank = state.union(opened), sequences + new, False
            usual = usual or capacity
        else:
            by_rank = not by_rank and placed < POOR * t["gaps"]
        bundle = max(1, int((usual or 0) // t["longest"]))
        state = written(superstep(state, by_rank, bundle, capacity), "packing")
        tables.append(state)
    out = tables[0] if tables else state
    for table in tables[1:]:
        out = out.union(table)
    plan = written(
        out.where(F.col("row") == PLACED).select(
            F.col("size").alias("length"),
            F.col("a").alias("rank"),
            F.col("b").alias("first"),
            F.col("c").alias("offset"),
        ),
        "plan",
    )
    delete(*tables)
    return plan


def _placed(plan: np.ndarray):
    """A function over Arrow batches of (..., length, rank) that replaces rank by sequence_id and offset."""
    rows = plan[np.lexsort((plan[:, 1], plan[:, 0]))]

    def place(batches):
        import pyarrow as pa

        lengths, ranks = rows[:, 0], rows[:, 1]
        first = np.searchsorted(lengths, np.arange(lengths.max() + 2 if len(lengths) else 1))
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.zeros(len(n), np.int64)
            for length in np.unique(n):
                mine, a, b = n == length, first[length], first[length + 1]
                at[mine] = a + np.searchsorted(ranks[a:b], r[mine], "right") - 1
            names = [x for x in batch.schema.names if x != "rank"]
            made = [pa.array(rows[at, 2] + r - rows[at, 1]), pa.array(rows[at, 3])]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + made, names=[*names, "sequence_id", "offset"])

    return place


def packed(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of docs (doc_id, text) with sequence_id and offset."""
    spark = docs.sparkSession
    rows = written(pieces(docs.select("doc_id", "text"), tokenizer, ranks, capacity), "pieces")
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(width(spark))).cast("int")
    rows = rows.withColumn("part", part)
    counts = written(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    plan = best_fit(written(counts.groupBy("length").agg(F.sum("n").alias("n")), "counts"), capacity)
    plan = plan.select("length", "rank", "first", "offset").toPandas().to_numpy(np.int64).reshape(-1, 4)  # its size is bounded by the capacity
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = rows.withColumn("own", rank).join(starts, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).cast("long").alias("rank"))
    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(_placed(plan), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10(docs: DataFrame) -> DataFrame:
    return packed(docs)
