"""Arrays as a table of chunks, laid out by time: a read at one instant takes the files of one chunk.

A chunk holds the values of STEPS consecutive steps of an array. The table is partitioned by the chunk's number along the
array's first axis and sorted by hash, an ordinary Parquet table: a filter on the number prunes files, one on hashes prunes
row groups, and arrays of any length are read without loading what stands outside the chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import long, up_to

#: Steps of a chunk.
STEPS = 24


def chunked(arrays: DataFrame, steps: int = STEPS) -> DataFrame:
    """(data_hash, chunk, width, values) of arrays (data_hash, shape, values), cut along the first axis."""
    length = F.element_at("shape", 1).cast("long")
    width = F.when(length > 0, F.size("values") / length).otherwise(1).cast("long")
    rows = arrays.where(F.size("shape") > 0).select("data_hash", "values", length.alias("__n"), width.alias("width"))
    chunk = F.explode(up_to(F.ceil(F.col("__n") / steps)))
    rows = rows.select("data_hash", "values", "width", chunk.alias("chunk"))
    values = F.slice("values", (F.col("chunk") * steps * F.col("width") + 1).cast("int"), (steps * F.col("width")).cast("int"))
    return rows.select("data_hash", "chunk", "width", values.alias("values"))


def write(arrays: DataFrame, path: str, steps: int = STEPS) -> None:
    """The chunks of arrays at a path; each chunk number's files are written by several tasks where it is large."""
    rows = chunked(arrays, steps)
    rows = rows.repartitionByRange("chunk", "data_hash").sortWithinPartitions("chunk", "data_hash")
    rows.write.partitionBy("chunk").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("data_hash string, width long, values array<double>, chunk long").parquet(path)


def at_step(chunks: DataFrame, step: int, steps: int = STEPS) -> DataFrame:
    """(data_hash, values): the values of one step of every array that has it."""
    width = F.col("width")
    place = (long(step % steps) * width + 1).cast("int")
    rows = chunks.where(F.col("chunk") == step // steps).where(F.size("values") >= (step % steps + 1) * width)
    return rows.select("data_hash", F.slice("values", place, width.cast("int")).alias("values"))


def between(chunks: DataFrame, first: int, end: int, steps: int = STEPS) -> DataFrame:
    """(data_hash, values): the steps [first, end) of every array, as far as it has them."""
    rows = chunks.where(F.col("chunk").between(first // steps, (end - 1) // steps))
    begin = F.greatest(long(first) - F.col("chunk") * steps, long(0))
    last = F.least(long(end) - F.col("chunk") * steps, long(steps))
    cut = F.slice("values", (begin * F.col("width") + 1).cast("int"), ((last - begin) * F.col("width")).cast("int"))
    parts = rows.groupBy("data_hash").agg(F.array_sort(F.collect_list(F.struct("chunk", cut.alias("v")))).alias("p"))
    return parts.select("data_hash", F.flatten("p.v").alias("values"))
