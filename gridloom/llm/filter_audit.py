"""Filter interaction audit: what each of five filters removes at each place of every order in which they may stand.

One pass gives every document a mask of the filters that it fails; documents are then counted by part and mask, at
most 32 cells a part, and nothing else leaves the scan. The orders of a part are visited by adjacent transpositions
(Steinhaus, Johnson and Trotter): from one order to the next two neighbours change places, the steps before and
after them remove what they did, and only these two are counted again from the cells. A filter's Shapley value (here
as a sum over all orders) accumulates along this walk.

Copies: the smallest id of every text is found by a pre-aggregated minimum over a digest of the text, and only texts
that occur several times meet it again, so that a text which a third of all rows hold goes to no single task.

Defined results: a null text is empty and a null source the part ''. Rows that repeat an id are documents each; a row
without an id is never a copy nor an original, and has no labels. An id with several labels has the larger of each. Ties:
rows of a text's smallest id are originals all. Empty tables give no rows. Columns but doc_id, text, source (of labels:
doc_id, quality, toxic) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, met, split_words, text_of, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5
SYMBOLS = r"[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROWS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,"
    " good_lost long, toxic_lost long, shapley long"
)


def own_mask() -> Column:
    """Bits 0 to 3 for the filters A to D that columns t (text) and w (its words) fail."""
    fails = [
        F.size("w") < LEAST_WORDS,
        100 * F.size(F.array_distinct("w")) < LEAST_DISTINCT * F.size("w"),
        100 * (F.length("t") - F.length(F.translate("t", UPPER, ""))) > MOST_UPPER * F.length("t"),
        F.col("t").rlike(SYMBOLS),
    ]
    return reduce(lambda a, b: a + b, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)])


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of docs (doc_id, source, text): all five bits."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_of().alias("t"))
    rows = rows.withColumn("w", split_words(F.col("t")))
    digest = F.unhex(F.sha2("t", 256)).alias("digest")
    rows = written(rows.select("doc_id", "part", digest, own_mask().alias("mask")), "masks")
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    copied = written(texts.where("low < high").select("digest", "low"), "copied")
    copy = F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False))
    return met(rows, copied, "digest", "left").select("doc_id", "part", F.when(copy, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and those labelled good and toxic among them."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    marks = labels.groupBy("doc_id").agg(is_one("quality"), is_one("toxic")).where("doc_id is not null and quality + toxic > 0")
    rows = met(masked(docs), written(marks, "marks"), "doc_id", "left")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic")]
    return rows.groupBy("part", "mask").agg(*sums).na.fill(0, ["good", "toxic"])


def swaps(n: int) -> Iterator[int]:
    """Places i whose element changes with the next one, so that all orders of n are visited once each."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down
        down = not down


def walked(table: np.ndarray) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from cells (32, 3)."""
    masks = np.arange(len(table))
    n = len(FILTERS)
    failing = [int(table[(masks >> f) & 1 == 1, 0].sum()) for f in range(n)]
    unique = [int(table[1 << f, 0]) for f in range(n)]
    order, lost, kept = list(range(n)), [np.zeros(3, np.int64)] * n, [0] * n
    shapley, out = np.zeros(n, np.int64), []

    def count(step: int) -> None:
        before = sum(1 << f for f in order[:step])
        here = (masks & before == 0) & ((masks >> order[step]) & 1 == 1)
        lost[step] = table[here].sum(0)
        kept[step] = int(table[masks & (before | 1 << order[step]) == 0, 0].sum())

    def note() -> None:
        for step, f in enumerate(order):
            removed, good, toxic = (int(x) for x in lost[step])
            shapley[f] += removed
            out.append((order_name(order), step + 1, kept[step], removed, failing[f] - removed, unique[f], good, toxic, f))

    for step in range(n):
        count(step)
    note()
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        count(i)
        count(i + 1)
        note()
    return [(*row[:-1], int(shapley[row[-1]])) for row in out]


def order_name(order: list[int]) -> str:
    return "".join(FILTERS[f] for f in order)


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step."""
    found = cells(docs, labels)
    whole = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def walk(batches):
        import pandas as pd

        for pdf in batches:
            for part, held in zip(pdf["part"], pdf["cells"], strict=True):
                table = np.zeros((1 << len(FILTERS), 3), np.int64)
                for cell in held:
                    table[cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                rows = walked(table)
                yield pd.DataFrame([(part, *r) for r in rows], columns=[c.split()[0] for c in ROWS.split(",")])

    return whole.mapInPandas(walk, ROWS)


def op13(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return audited(documents.select("doc_id", "source", "text"), labels.select("doc_id", "quality", "toxic"))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents),
m AS (
  SELECT doc_id, part, (len(w) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_UPPER} * length(t))::INT
    + 8 * regexp_matches(t, '{SYMBOLS}')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask),
x AS (SELECT unnest(range(5)) AS f),
o AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM x a JOIN x b ON b.f <> a.f JOIN x c ON c.f NOT IN (a.f, b.f)
  JOIN x d ON d.f NOT IN (a.f, b.f, c.f) JOIN x e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (
  SELECT array_to_string(list_transform(o, lambda f: chr((65 + f)::INT)), '') AS filter_order, k::INT AS step,
    (1 << o[k])::INT AS bit, coalesce(list_sum(list_transform(o[1:k - 1], lambda f: 1 << f)), 0)::INT AS earlier
  FROM o JOIN range(1, 6) r(k) ON true),
g AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & earlier > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM c JOIN s ON true GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM g
"""
