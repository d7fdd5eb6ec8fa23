"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: the space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = {
    "en": "the of and to in a is that for it was on are as with be by this at from or an have not you he they which".split(),
    "fr": "le la les de des du et en un une que qui est pour dans au aux sur par pas avec il elle ce se ne plus".split(),
    "de": "der die das und in zu den von mit ist des für auf im dem nicht ein eine als auch es an werden aus er hat".split(),
    "es": "el la los las de que y en un una por con para del se no su al es lo como más o pero sus le mi ya".split(),
}


def all_stop_words() -> list[str]:
    """Every stop word once, in lower case and with a capital."""
    low = sorted({w for ws in STOP_WORDS.values() for w in ws})
    return low + sorted({w.capitalize() for w in low} - set(low))


def let(value: Column, fn) -> Column:
    """fn(value), where value is evaluated once for each row however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def text_of(name: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, made of names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and the executors share: spark.checkpoint.dir, or a folder in the warehouse where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if warehouse.startswith(("file:", "/")) and not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"{warehouse}/gridloom-tables"
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(*tables: DataFrame) -> None:
    """Deletes tables that written() made; nothing may still read them."""
    for table in tables:
        files = table.inputFiles()
        if not files:
            continue
        sc = table.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


#: Up to this many rows of about 40 bytes may be broadcast.
BROADCAST_ROWS = 500_000
#: Keys that hold 1 / HOT of a table's rows or more: there are at most so many.
HOT = 2000


def met(big: DataFrame, small: DataFrame, on: str, how: str = "inner", few: bool | None = None) -> DataFrame:
    """big joined (inner or left) with small, which has one row a key.

    small is broadcast if it has few rows (counted here, unless few says so). Otherwise the keys that hold 1 / HOT of big's rows or more, so at most HOT,
    are broadcast with their rows of small, and only the others are shuffled: no task gets a hot key.
    """
    if few is None:
        few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        return big.join(F.broadcast(small), on, how)
    total = big.count()
    hot = written(big.groupBy(on).count().where(F.col("count") * HOT >= total).where(F.col(on).isNotNull()).select(on), "hot")
    rest = big.join(F.broadcast(hot), on, "left_anti").join(small, on, how)
    return rest.union(big.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(small.join(F.broadcast(hot), on, "left_semi")), on, how))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
