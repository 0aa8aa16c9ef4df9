"""Shared plumbing of the training-data operators: scratch tables in the cluster's shared folder and text atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import shared_path

#: One word: a run without space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Words, and the like, that a worker remembers in each of two generations; longer ones are not remembered.
CACHE_WORDS, CACHE_CHARS = 500_000, 100


class Memory(dict):
    """A mapping that learns missing keys and forgets those of the generation before last."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.old = learn, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.learn(key)
        if len(key) <= CACHE_CHARS:
            self[key] = value
        return value

    def age(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the cluster names in spark.checkpoint.dir."""
    return shared_path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends in files that outlive executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop_path(spark: SparkSession, name: str) -> None:
    """Remove a folder of the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Remove the scratch files behind what stored() returned, when no later step reads them."""
    drop_path(df.sparkSession, df.stored_path)


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row, but for columns that hold maps; tells rows of equal ids apart."""
    return F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"))


def small_batches(spark: SparkSession, rows: int = 1024, size: str = "16m") -> None:
    """Bound what one Arrow batch holds, so that very long texts cannot fill a Python worker."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        try:
            spark.conf.set(key, value)
        except Exception:  # noqa: BLE001  an older or locked setting keeps its value
            pass


def fresh(name: str, df: DataFrame) -> str:
    """name, lengthened until no column of df has it: what an operator adds cannot clash with what a table brings."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spaced(text: Column) -> Column:
    """Null as empty, and every white-space byte of the word rule as one space (JVM byte replacement, no regex)."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words_of(text: Column) -> Column:
    """All words of a text as an array; none for null."""
    return F.array_remove(F.split(spaced(text), " "), "")


def n_words(text: Column) -> Column:
    """Number of words, as long."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
