"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.session import ensure_checkpoint_dir

#: White space of the word definition: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table, read by Spark alone (the path may be a remote store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder that
    ``spark.checkpoint.dir`` names. Used for narrow digests that several
    branches read, never for texts."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which an aggregated table is broadcast (a few MB); larger ones are
#: joined by a shuffle.
SMALL_ROWS = 50_000


def small_side(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """Mark a materialized aggregate for broadcast if it has at most ``most`` rows.
    Beyond that it stays an ordinary side of a shuffled, skew-split join."""
    return F.broadcast(df) if df.count() <= most else df


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined, in array order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str,
                n_buckets: int = 256) -> DataFrame:
    """Add ``out`` = 0, 1, 2, ... without gaps within ``group``.

    Rows are spread by a hash of ``order`` into ``n_buckets`` buckets; a bounded
    histogram gives each bucket its offset and the row window runs per (group,
    bucket), so a group with a third of all rows is still split. ``df`` is read
    twice: pass something cheap or checkpointed. Repeated rows get the numbers of
    their run in any order."""
    b = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(n_buckets)))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (b.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    rn = F.row_number().over(Window.partitionBy(*group, "__b").orderBy(*order))
    return (b.withColumn("__rn", rn).join(offsets, [*group, "__b"])
            .withColumn(out, (F.col("__off") + F.col("__rn") - 1).cast("long"))
            .drop("__b", "__off", "__rn"))
