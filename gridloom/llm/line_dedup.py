"""Line dedup by site-relative frequency: lines that stand on too large a share of a host's pages go.

Lines are counted once a page, by host and hash, with partial sums before the shuffle. A line goes if its pages are more than
RATIO of the host's, by more than chance explains: three standard deviations of such a count, and two pages. That is one rule for hosts of
every size; on a host of two pages no line can go. Of the lines that go a host has at most (lines of a mean page / RATIO). Documents
are not shuffled while that table is small; beyond it, they are joined by host, and the engine may split a large one.

Defined results: lines without a word are never dropped; a null text stays null; a null host is a host of its
own; repeated rows are pages of their own. A page may lose all its lines; its row stays, with the rest of the text. An empty table gives
an empty one; a very long text is split whole; lines at the limit stay. Columns with the names of this operator's own are kept, and its own get underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, written

#: The share of a host's pages that a line may have; a count has to exceed it by MARGIN standard deviations and SPARE pages.
RATIO, MARGIN, SPARE = 0.03, 3.0, 2.0
#: Up to this many boilerplate lines (8 bytes each) may be broadcast.
BROADCAST_LINES = 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, host: Column, text: str = "text", ratio: float = RATIO) -> DataFrame:
    """(host, lines): hashes of the lines to drop, for each host that has any."""
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x)))
    pages = docs.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    lines = docs.select(host.alias("host"), F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    lines = lines.where(F.col("n") > SPARE)
    usual = ratio * F.col("pages")
    over = lines.join(
        pages.withColumnRenamed("host", "h"),
        F.col("host").eqNullSafe(F.col("h")),
    ).where(F.col("n") > usual + MARGIN * F.sqrt(usual) + SPARE)
    return over.groupBy("host").agg(F.collect_list("line").alias("lines"))


def cleaned(docs: DataFrame, host: Column | None = None, text: str = "text", ratio: float = RATIO) -> DataFrame:
    """docs without the boilerplate lines in text, with `n_lines` and `n_dropped` (underscores appended if taken)."""
    host = F.col("source") if host is None else host
    h, lines, n_lines, n_dropped = fresh(docs, "host_of_page", "lines_of_host", "n_lines", "n_dropped")
    drop = written(boilerplate(docs, host, text, ratio), "boilerplate").select(F.col("host").alias(h), F.col("lines").alias(lines))
    few = (drop.agg(F.sum(F.size(lines))).first()[0] or 0) <= BROADCAST_LINES
    out = docs.join(F.broadcast(drop) if few else drop, host.eqNullSafe(F.col(h)), "left")
    all_lines = _lines(F.col(text))
    kept = F.filter(all_lines, lambda x: ~F.array_contains(F.col(lines), F.xxhash64(x)) | ~x.rlike(WORD))
    new = F.when(F.col(lines).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col(lines).isNull() | F.col(text).isNull(), F.lit(0)).otherwise(F.size(all_lines) - F.size(kept))
    columns = [new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return out.select(
        *columns,
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(all_lines)).cast("long").alias(n_lines),
        dropped.cast("long").alias(n_dropped),
    )


def op3(docs: DataFrame) -> DataFrame:
    return cleaned(docs.select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_dropped", "text")


SQL = f"""
WITH pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
split AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
places AS (SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split),
seen AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM places WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line),
bad AS (SELECT seen.source, line FROM seen JOIN pages ON seen.source IS NOT DISTINCT FROM pages.source WHERE n > {RATIO}::DOUBLE * pages + {MARGIN}::DOUBLE * sqrt({RATIO}::DOUBLE * pages) + {SPARE}::DOUBLE),
marked AS (SELECT p.doc_id, p.i, p.line, bad.line IS NOT NULL AS gone FROM places p LEFT JOIN bad ON p.source IS NOT DISTINCT FROM bad.source AND p.line = bad.line),
joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(j.n_lines, 0)::BIGINT AS n_lines, coalesce(j.n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""
