"""Target-distribution importance resampling: documents are drawn by how much likelier their n-grams are in a target.

Features are all runs of one and of two words. Two passes:

1. A dictionary of distinct features. Every task counts the n-gram strings of its texts in chunks of bounded size and
   writes each chunk's dictionary as sorted, compressed blocks; the blocks of a group of strings meet in one task, which
   counts the strings of the whole corpus and hashes each distinct one once. What leaves it are totals by bucket (as
   many rows as there are buckets, for the documents and for the target), and of these the gains.
2. Each document's feature counts, again by the dictionary of its chunk, meet the gains of their buckets.

A join of the documents' strings with the dictionary of the corpus would shuffle every posting, several times the input;
a feature's bucket depends on its string alone, so the join is on the bucket, and the gains are as few as the buckets.

Scores are weight plus Gumbel noise of the document's id, and the highest are drawn. Ranks come from a range sort:
a row's place in its partition and the rows of the partitions before it.

Defined results: a null text is empty, and a text without words has no features and weight 0. Rows that repeat an id
are scored each for itself; a row without an id has no noise, so neither score nor rank, and is not among the
documents that may be drawn. Ties go to the smaller id, then to any. Empty tables give an empty result; an empty
target has no features (every t is 0). Only doc_id and text are read.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, width, written

BUCKETS = 10_000
SEED = 7
#: Documents of fewer words are not drawn; of the others, so many in a hundred.
LEAST_WORDS, PERCENT = 20, 25
#: Bytes of text of a chunk (a longer text is one by itself), and characters of text for each group of strings.
CHUNK_BYTES, GROUP_CHARS = 4_000_000, 25_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes with A-Z lower-cased, and which of them stand in words: digits, letters and all beyond ASCII.
_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


class Features:
    """The features of some texts (bytes end to end, text i from offsets[i] to offsets[i + 1]) by a dictionary.

    strings: the distinct features, words before pairs, each in order. codes and docs: for every occurrence its string and
    its text. n_words: words of each text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        import pyarrow as pa
        import pyarrow.compute as pc

        low = _LOW[data]
        inside = _IN_WORD[low]
        before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(low))]
        before[edges] = False
        after[edges - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        docs = np.searchsorted(offsets, starts, "right") - 1
        words = _strings(low[inside], ends - starts).dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids, known = rank[words.indices.to_numpy()], words.dictionary.take(pa.array(order))
        first = np.flatnonzero(docs[1:] == docs[:-1])
        pairs, at = np.unique(ids[first] * len(known) + ids[first + 1], return_inverse=True)
        left, right = (known.take(pa.array(x)) for x in np.divmod(pairs, max(len(known), 1)))
        joined = pc.binary_join_element_wise(left, right, pa.scalar(b" ", pa.large_binary()))
        self.strings = pa.concat_arrays([known, joined])
        self.codes = np.concatenate((ids, len(known) + at))
        self.docs = np.concatenate((docs, docs[first]))
        self.n_words = np.bincount(docs, minlength=len(offsets) - 1)

    def hashes(self) -> np.ndarray:
        """The CRC-32 of each distinct string."""
        return hashed(self.strings)


def hashed(strings, each: int = 50_000) -> np.ndarray:
    """The CRC-32 of each string, which becomes an object only for a moment."""
    parts = [np.fromiter(map(crc32, strings.slice(i, each).to_pylist()), np.int64) for i in range(0, len(strings), each)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _strings(data: np.ndarray, lengths: np.ndarray):
    """Arrow strings from their bytes end to end."""
    import pyarrow as pa

    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), buffers)


def chunks(batch):
    """(first row, Features) of the texts of a batch (text binary, no nulls), CHUNK_BYTES at a time."""
    import pyarrow as pa

    text = batch.column("text").cast(pa.large_binary())
    _, ends, held = text.buffers()
    offsets = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        last = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, row + 1), len(text))
        yield row, Features(data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


def group_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    """The group of a string by its hash. A bucket's strings share a group unless there are more groups than buckets."""
    if groups <= BUCKETS:
        return hashes % BUCKETS % groups
    return hashes % BUCKETS + BUCKETS * (hashes // BUCKETS % -(-groups // BUCKETS))


def _blocks(features: Features, groups: int):
    """Arrow rows (grp, word_bytes, words, n_bytes, n) of a chunk: each group's strings in order, and how often each stands there."""
    import pyarrow as pa
    import pyarrow.compute as pc

    counts = np.bincount(features.codes, minlength=len(features.strings)).astype(np.int64)
    grp = group_of(features.hashes(), groups)
    order = np.argsort(grp, kind="stable")
    grp, counts = grp[order], counts[order]
    lines = features.strings.take(pa.array(order))
    lines = pc.binary_join_element_wise(lines, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    _, ends, held = lines.buffers()
    offsets = np.frombuffer(ends, np.int64)[lines.offset : lines.offset + len(lines) + 1]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(grp)) + 1, [len(grp)])) if len(grp) else np.zeros(1, np.int64)
    pack = lambda raw: pa.compress(raw, codec="zstd", asbytes=True)
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    sizes = [int(offsets[b] - offsets[a]) for a, b in spans]
    columns = [
        pa.array([int(grp[a]) for a, _ in spans], pa.int64()),
        pa.array(sizes, pa.int64()),
        pa.array([pack(held.slice(int(offsets[a]), n)) for (a, _), n in zip(spans, sizes, strict=True)], pa.binary()),
        pa.array([8 * int(b - a) for a, b in spans], pa.int64()),
        pa.array([pack(counts[a:b].tobytes()) for a, b in spans], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["grp", "word_bytes", "words", "n_bytes", "n"])


def dictionary_blocks(texts: DataFrame, groups: int) -> DataFrame:
    """The distinct n-gram strings of each chunk of texts, with their counts, in blocks by group."""

    def count(batches):
        for batch in batches:
            for _, features in chunks(batch):
                yield _blocks(features, groups)

    rows = texts.select(text_of().cast("binary").alias("text"))
    return rows.mapInArrow(count, "grp long, word_bytes long, words binary, n_bytes long, n binary")


def _bucket_sums(pdf):
    """The blocks of one group to (bucket, n): every distinct string is counted, then hashed once."""
    import pandas as pd
    import pyarrow as pa

    strings, numbers = [], []
    for row in pdf.itertuples(index=False):
        data = np.frombuffer(pa.decompress(row.words, row.word_bytes, codec="zstd", asbytes=True), np.uint8)
        line = data == ord("\n")
        strings.append(_strings(data[~line], np.diff(np.flatnonzero(line), prepend=-1) - 1))
        numbers.append(np.frombuffer(pa.decompress(row.n, row.n_bytes, codec="zstd", asbytes=True), np.int64))
    whole = pa.concat_arrays(strings).dictionary_encode()
    counts = np.bincount(whole.indices.to_numpy(), np.concatenate(numbers), len(whole.dictionary))
    sums = np.bincount(hashed(whole.dictionary) % BUCKETS, counts, BUCKETS).astype(np.int64)
    at = np.flatnonzero(sums)
    return pd.DataFrame({"bucket": at.astype(np.int32), "n": sums[at]})


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) of the features of texts (text), at most BUCKETS rows."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(width(texts.sparkSession), chars // GROUP_CHARS + 1)
    blocks = dictionary_blocks(texts, groups)
    return blocks.groupBy("grp").applyInPandas(_bucket_sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) for every bucket, from bucket counts of the documents and of the target."""
    every = documents.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(F.broadcast(documents.withColumnRenamed("n", "s")), "bucket", "left")
    both = both.join(F.broadcast(target.withColumnRenamed("n", "t")), "bucket", "left").na.fill(0, ["s", "t"])
    # one row: the totals
    totals = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(totals["S"] + BUCKETS))
    down = (F.col("s") + 1).cast("double") * F.lit(float(totals["T"] + BUCKETS))
    return both.select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain"))


def weighted(docs: DataFrame, gain: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of docs (doc_id, text): the floored mean gain of a document's features.

    gain has BUCKETS rows, which go to every task.
    """
    table = np.zeros(BUCKETS, np.int64)
    for row in gain.collect():
        table[row["bucket"]] = row["gain"]
    held = docs.sparkSession.sparkContext.broadcast(table)

    def weigh(batches):
        import pyarrow as pa

        for batch in batches:
            for row, f in chunks(batch):
                n = np.bincount(f.docs, minlength=len(f.n_words))
                of_string = held.value[f.hashes() % BUCKETS]
                total = np.bincount(f.docs, of_string[f.codes], len(n)).astype(np.int64)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                ids = batch.column("doc_id").slice(row, len(n))
                numbers = [pa.array(x.astype(np.int64)) for x in (f.n_words, n, weight)]
                yield pa.RecordBatch.from_arrays([ids, *numbers], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().cast("binary").alias("text"))
    return rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths: null without an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with column rank, from 1 in this order: no task holds more than a range of them."""
    ties = F.monotonically_increasing_id()
    keyed = written(rows.withColumn("tie", ties), "scored")
    sort = [*order, F.col("tie").asc()]
    dealt = keyed.repartitionByRange(width(rows.sparkSession), *sort).sortWithinPartitions(*sort)
    place = F.monotonically_increasing_id()
    dealt = written(dealt.withColumn("place", place).withColumn("part", F.shiftright("place", 33)), "ranges")
    sizes = dealt.groupBy("part").count().collect()  # one row a partition
    before, starts = 0, []
    for part, n in sorted(sizes):
        starts.append((part, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "part long, start long")
    rank = (F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).alias("rank")
    return dealt.join(F.broadcast(starts), "part").select(*rows.columns, rank)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is null for those not drawn."""
    docs = docs.select("doc_id", "text")
    counts = [written(bucket_counts(texts.select("text")), "dictionary") for texts in (docs, target)]
    gain = written(gains(*counts), "gains")
    scored = weighted(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    scored = written(scored, "weights")
    may = F.coalesce((F.col("n_words") >= LEAST_WORDS) & F.col("score").isNotNull(), F.lit(False))
    drawn = percent * scored.where(may).count() // 100
    order = ranked(scored.where(may), F.col("score").desc(), F.col("doc_id").asc())
    order = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~may).withColumn("rank", F.lit(None).cast("long"))
    return order.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op11(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resampled(documents, benchmark)


#: CRC-32 by the reflected polynomial, a byte at a time, as DuckDB has no function for it.
_STEPS = "list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
_BYTES = "list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)"
_ENTRY = "t[(xor(c, b) & 255) + 1]"

SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: {_STEPS}) AS t),
texts AS (
  SELECT 0 AS side, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, NULL, coalesce(text, '') FROM benchmark),
w AS (
  SELECT side, doc_id, regexp_extract_all(
    translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
f AS (
  SELECT side, doc_id, unnest(w) AS f FROM w
  UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
n AS (SELECT side, doc_id, f, count(*) AS n FROM f GROUP BY ALL),
dictionary AS (
  SELECT f, xor(list_reduce([4294967295] || {_BYTES}, lambda c, b: xor(c // 256, {_ENTRY})), 4294967295) % {BUCKETS} AS b
  FROM (SELECT DISTINCT f FROM n) JOIN crc ON true),
sums AS (
  SELECT b, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t
  FROM n JOIN dictionary USING (f) GROUP BY b),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM sums),
gains AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE
    / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM sums, totals),
weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM n JOIN dictionary USING (f) JOIN gains USING (b) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('{SEED}:' || w.doc_id), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN weights ON w.doc_id = weights.doc_id WHERE side = 0),
r AS (
  SELECT doc_id, n_words, n_features, weight,
    weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_words >= {LEAST_WORDS}
  QUALIFY rank <= {PERCENT} * count(*) OVER () // 100)
SELECT r.doc_id, n_features, weight, score, rank::BIGINT AS rank FROM r LEFT JOIN drawn ON r.doc_id = drawn.doc_id
"""
