"""Helpers that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(), "longs": T.ArrayType(T.LongType()), "ints": T.ArrayType(T.IntegerType()),
}


def record(**fields: str) -> T.StructType:
    """Schema by names; unlike a DDL text it needs no session when a module is imported."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields.items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """Rows kept out of training: crc32 of the id's text leaves 0 by 5. A null id counts as held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, bound: int, values: tuple[int, ...] = (0, 1)
) -> DataFrame:
    """At most ``bound`` labelled texts per value of ``label``, none of them held out: (text, label, doc_id).

    Ids are taken in the order of a hash of the id, so the choice depends on the labels table alone.
    Rows with a null id or label are not training rows; of several labels of one id the largest counts;
    of several texts of one id the smallest. The ids are at most ``bound`` rows per value, which bounds the broadcast.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(*values) & ~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max(label).alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [usable.where(F.col("label") == v).orderBy(*order).limit(bound) for v in values]
    ids = reduce(DataFrame.unionByName, picked)
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        .select("text", "label", "doc_id")
    )


def kept_for_reuse(df: DataFrame) -> DataFrame:
    """Keep a table that several passes read on the executors' disks; a lost block is computed again."""
    return df.persist(StorageLevel.DISK_ONLY)


def packed(docs: DataFrame) -> DataFrame:
    """All columns as fields of the one column ``_doc``: no name of the table can clash with those an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``; tests get their own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        import tempfile

        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the table to the shared checkpoint folder and drop its lineage."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
