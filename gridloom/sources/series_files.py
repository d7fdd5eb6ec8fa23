"""One file for each series, and the files read back.

Spark makes the text of each file beside its series, so no step is shuffled; tasks write and read whole files, and neither
lists nor moves any on the driver. A file lies in a folder named by its stem, in one of FOLDERS numbered ones; packed, it
is compressed by gzip and lies in the numbered one itself, as small files take a block of disk each, and folders as well.
Paths are those that pyarrow.fs can open (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.period import Period, wire_instant
from .csv_io import file_stems
from .files import exists, uri

STEM = "stem"
FOLDERS = 1024
PACKED = ".csv.gz"


def _putter(where: str, packed: bool) -> Callable:
    """Writes (folder, stem, text) rows; a file is there whole or not at all, and a second attempt replaces it."""

    def put(rows) -> None:
        at, root = fs.FileSystem.from_uri(where)
        for row in rows:
            folder, text = f"{root}/{row['folder']}", row["text"].encode()
            name = f"{folder}/{row[STEM]}{PACKED}" if packed else f"{folder}/{STEM}={row[STEM]}/part-0.csv"
            at.create_dir(name.rsplit("/", 1)[0])
            new = f"{folder}/.{uuid.uuid4().hex}"
            with at.open_output_stream(new) as out:
                out.write(gzip.compress(text, 6, mtime=0) if packed else text)
            at.move(new, name)

    return put


def _getter(where: str) -> Callable:
    """(stem, file, text) of all files in numbered folders, one file a batch."""

    def get(batches):
        at, root = fs.FileSystem.from_uri(where)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = at.get_file_info(fs.FileSelector(f"{root}/{folder}", recursive=True, allow_not_found=True))
                for name in (f.path for f in found if f.is_file):
                    above, last = name.split("/")[-2:]
                    if last.endswith(PACKED):
                        stem = last.removesuffix(PACKED)
                    elif above.startswith(f"{STEM}="):
                        stem = above.removeprefix(f"{STEM}=")
                    else:
                        continue  # a file that an attempt did not end
                    with at.open_input_stream(name, compression=None) as held:
                        data = held.read()
                    text = (gzip.decompress(data) if last.endswith(PACKED) else data).decode()
                    yield pa.RecordBatch.from_pydict({STEM: [stem], "file": [name], "text": [text]})

    return get


def write(series: DataFrame, resolution: Period, path: str, packed: bool = False) -> DataFrame:
    """Writes timestamp and value of each series (catalog columns and values) as CSV with a header; gives (assoc_id, stem).

    packed: compressed by gzip, stem.csv.gz without a folder of its own. Folders that exist at the path are left alone, and are an error.
    """
    spark = series.sparkSession
    if exists(spark, path):
        raise InvalidParameter(f"{path} exists")
    names = file_stems(series)
    rows = series.join(names, "assoc_id").where(F.size("values") > 0).select(STEM, "initial_timestamp", "values")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), STEM)
    t = lambda i: wire_instant(resolution.add(F.col("initial_timestamp"), i.cast("long")))
    lines = F.transform("values", lambda v, i: F.concat(t(i), F.lit(","), F.coalesce(v.cast("string"), F.lit("")), F.lit("\n")))
    text = F.concat(F.lit("timestamp,value\n"), F.array_join(lines, ""))
    rows.select(F.pmod(F.xxhash64(STEM), F.lit(FOLDERS)).alias("folder"), STEM, text.alias("text")).foreachPartition(_putter(uri(spark, path), packed))
    return names


def read(spark: SparkSession, path: str) -> DataFrame:
    """(stem, t, v, file) of all files under a path that write() made, rows in each file's order."""
    folders = spark.range(0, FOLDERS, 1, min(FOLDERS, 4 * spark.sparkContext.defaultParallelism))
    raw = folders.mapInArrow(_getter(uri(spark, path)), f"{STEM} string, file string, text string")
    lines = raw.select(STEM, "file", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("i > 0 and line <> ''")
    t = F.to_timestamp(F.split_part("line", F.lit(","), F.lit(1))).cast("timestamp_ntz")
    return lines.select(STEM, t.alias("t"), F.split_part("line", F.lit(","), F.lit(2)).try_cast("double").alias("v"), "file")
