"""Plan-shaping helpers shared by operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, *cols: str) -> DataFrame:
    """Compute the given (costly, array-valued) columns exactly once per row.

    Catalyst collapses projections and may inline an expression into every
    place that uses it (each ``slice``/``size``/``zip_with`` argument, each
    generator input), so a tokenizer feeding an n-gram builder runs many
    times per row. A one-element generator (``inline`` of a one-struct array)
    is not collapsed through, so downstream operators read attributes.
    Row count and order are unchanged."""
    others = [c for c in df.columns if c not in cols]
    packed = F.array(F.struct(*[F.col(c).alias(c) for c in cols]))
    return df.select(*others, F.inline(packed)).select(*df.columns)


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row, in the plan: no driver round trip."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one"))


#: Rows up to which a materialized table is broadcast.
SMALL_ROWS = 200_000


def small_side(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """Mark a materialized table for broadcast if it has at most ``most`` rows; beyond that
    it stays an ordinary side of a join."""
    return F.broadcast(df) if df.count() <= most else df


def drop_stopwords(df: DataFrame, tokens: str, out_col: str, stop_words, punctuation: str | None = None,
                   ) -> DataFrame:
    """Lower-case tokens, drop stop words (Spark ML ``StopWordsRemover``: a
    JVM hash-set lookup per token) and drop tokens that are a substring of the
    punctuation string. Same result as ``text.remove_stopwords``, faster on
    long token arrays."""
    from pyspark.ml.feature import StopWordsRemover

    from textloom.functions.text import PUNCTUATION
    punct = PUNCTUATION if punctuation is None else punctuation
    low = evaluate_once(df.withColumn("_low", F.transform(tokens, lambda t: F.lower(t))), "_low")
    sw = StopWordsRemover(inputCol="_low", outputCol="_kept", stopWords=list(stop_words), caseSensitive=True)
    out = sw.transform(low).withColumn(out_col, F.filter("_kept", lambda t: F.instr(F.lit(punct), t) == 0))
    return out.drop("_low", "_kept") if out_col not in ("_low", "_kept") else out


def materialize(df: DataFrame) -> DataFrame:
    """Compute an aggregated table once and cut its lineage with a reliable
    ``checkpoint()`` into the shared folder named by ``spark.checkpoint.dir``
    (it survives executor loss; ``localCheckpoint`` would not). Used where
    several branches of one operator read the same aggregate and Catalyst
    cannot reuse the exchange (the branches differ after pushdown/pruning),
    so the corpus is tokenised once instead of once per branch."""
    from textloom.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Shuffle files go when the query that wrote them ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """What is materialized here leaves no shuffle files: only its checkpoint is read again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def discard(df: DataFrame) -> None:
    """Delete the checkpoint of a materialized table that is not read any more."""
    rdd = df._jdf.queryExecution().analyzed().rdd()
    if rdd.getCheckpointFile().isDefined():
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def unpacked(x: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``packed``."""
    return np.frombuffer(x, dtype=f"u{len(x) // n}").astype(np.int64) if n else np.zeros(0, dtype=np.int64)
