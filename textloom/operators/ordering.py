"""Distributed global ranks and prefix sums.

``Window.orderBy`` without a partition moves every row to one task. These
helpers instead split the order into buckets that are monotone in the sort
key, take per-bucket totals (a table bounded by the bucket count), turn them
into offsets, and finish with windows *partitioned by bucket*. Results are
exact and independent of partitioning; one hot group is spread over all its
buckets, so skewed labels do not land in a single task.

* Hash order (sampling): the bucket is a hex prefix of ``md5(seed|id)``,
  uniform by construction.
* Value order (scores, ids): boundaries are a bounded, hash-chosen sample of
  the order keys in their own types, joined as one broadcast row.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def hash_key(seed, *cols) -> Column:
    """``md5(concat_ws('|', seed, cols...))``: same hex in Spark and DuckDB."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_bucket(h: Column, prefix_hex: int = 4) -> Column:
    """Integer of the first ``prefix_hex`` hex digits; monotone in ``h``."""
    return F.conv(F.substring(h, 1, prefix_hex), 16, 10).cast("int")


def _groups(group_cols: Sequence[str]) -> list[str]:
    return list(group_cols or [])


def hash_rank(df: DataFrame, id_col: str = "id", seed=DEFAULT_SEED,
              group_cols: Sequence[str] = (), rank_col: str = "hrank",
              prefix_hex: int = 4) -> DataFrame:
    """Add ``rank_col`` = ``row_number() over (partition by groups order by
    md5(seed|id), id)`` without a single-partition window."""
    g = _groups(group_cols)
    b = (df.withColumn("_h", hash_key(seed, id_col))
         .withColumn("_b", hash_bucket(F.col("_h"), prefix_hex)))
    hist = b.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = hist.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    wr = Window.partitionBy(*g, "_b").orderBy("_h", id_col)
    return (b.join(offs, [*g, "_b"])
            .withColumn(rank_col, (F.col("_off") + F.row_number().over(wr)).cast("bigint"))
            .drop("_h", "_b", "_off"))


def hash_top_n(df: DataFrame, n, id_col: str = "id", seed=DEFAULT_SEED,
               group_cols: Sequence[str] = (), offset=0, rank_col: str | None = None,
               prefix_hex: int = 4) -> DataFrame:
    """Rows whose hash rank r (per group) satisfies ``offset < r <= offset + n``.

    ``n`` / ``offset`` may be ints or Columns over the group columns (e.g. the
    smallest class size). Buckets wholly outside the window are pruned before
    the row-level window, so only about ``n`` rows per group are sorted."""
    g = _groups(group_cols)
    n_c = n if isinstance(n, Column) else F.lit(n)
    o_c = offset if isinstance(offset, Column) else F.lit(offset)
    b = (df.withColumn("_h", hash_key(seed, id_col))
         .withColumn("_b", hash_bucket(F.col("_h"), prefix_hex)))
    hist = b.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = (hist.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
            .withColumn("_lo", o_c).withColumn("_hi", o_c + n_c)
            .where((F.col("_off") < F.col("_hi")) & (F.col("_off") + F.col("_n") > F.col("_lo")))
            .select(*g, "_b", "_off", "_lo", "_hi"))
    wr = Window.partitionBy(*g, "_b").orderBy("_h", id_col)
    out = (b.join(offs, [*g, "_b"])
           .withColumn("_r", F.col("_off") + F.row_number().over(wr))
           .where((F.col("_r") > F.col("_lo")) & (F.col("_r") <= F.col("_hi"))))
    if rank_col:
        out = out.withColumn(rank_col, (F.col("_r") - F.col("_lo")).cast("bigint"))
    return out.drop("_h", "_b", "_off", "_lo", "_hi", "_r")


#: Sampled order keys for each bucket boundary.
OVERSAMPLE = 32


def n_buckets_of(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_bucket(df: DataFrame, key: Column, n_buckets: int, out_col: str = "_b") -> DataFrame:
    """Add the order-preserving bucket of a struct-valued order ``key``.

    Boundaries are about every ``OVERSAMPLE``-th of a bounded sample: of the keys whose hash
    leaves one remainder, the one with the smallest hash. So a key counts once however many
    rows have it, and the buckets are the same in every branch and retry. Whole tuples are compared in their own types, so ties of
    the first column are split by the next. The boundaries come as one broadcast row;
    a row finds its bucket among the coarse ones first, then among the fine."""
    step = max(2, round(n_buckets ** 0.5))
    keyed = df.withColumn("__k", key)
    hashed = keyed.select("__k", F.xxhash64("__k").alias("__h"))
    sample = (hashed.groupBy(F.pmod("__h", F.lit(OVERSAMPLE * n_buckets))).agg(F.min_by("__k", "__h").alias("__k"))
              .agg(F.sort_array(F.collect_list("__k")).alias("__s")))
    # sample size / n_buckets apart, so that small inputs get boundaries as well
    apart = F.greatest(F.lit(1), F.ceil(F.size("__s") / n_buckets)).cast("int")
    fine = sample.select(F.filter("__s", lambda x, i: F.pmod(i + 1, apart) == 0).alias("__fine"))
    both = fine.select("__fine", F.filter("__fine", lambda x, i: F.pmod(i + 1, F.lit(step)) == 0).alias("__coarse"))
    j = keyed.withColumn("__one", F.lit(1)).join(F.broadcast(both.withColumn("__one", F.lit(1))), "__one", "left")
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.col("__k")))
    j = j.withColumn("__c", below(F.col("__coarse")) * step)
    return j.withColumn(out_col, F.col("__c") + below(F.slice("__fine", F.col("__c") + 1, F.lit(step)))).drop(
        "__one", "__fine", "__coarse", "__c", "__k")


def ordered_prefix(df: DataFrame, order_cols: Sequence[str], sums: dict[str, Column] | None = None,
                   group_cols: Sequence[str] = (), n_buckets: int | None = None,
                   rank_col: str | None = "rank", descending: bool = False) -> DataFrame:
    """Exclusive prefix sums in ``order_cols`` order (per group), distributed.

    Adds ``<name>_before`` for each entry of ``sums`` (sum over rows strictly
    before this one) and ``rank_col`` (1-based row number). Order columns keep
    their types; buckets follow (groups, order), so one large group or one
    common first key is spread over many buckets. ``descending`` reverses the
    first order column, which must then be numeric."""
    g = _groups(group_cols)
    sums = dict(sums or {})
    first = F.col(order_cols[0])
    order = [-first if descending else first, *[F.col(c) for c in order_cols[1:]]]
    key = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(g)],
                   *[c.alias(f"o{i}") for i, c in enumerate(order)])
    work = range_bucket(df, key, n_buckets or n_buckets_of(df))
    sum_names = list(sums)
    for name, expr in sums.items():
        work = work.withColumn(f"_v_{name}", expr)
    aggs = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sum_names] + [F.count(F.lit(1)).alias("_t__n")]
    hist = work.groupBy(*g, "_b").agg(*aggs)
    wb = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    for n in sum_names + ["_n"]:
        hist = hist.withColumn(f"_o_{n}", F.coalesce(F.sum(f"_t_{n}").over(wb), F.lit(0)))
    hist = hist.drop(*[f"_t_{n}" for n in sum_names + ["_n"]])
    wr = Window.partitionBy(*g, "_b").orderBy(*order)
    wrx = wr.rowsBetween(Window.unboundedPreceding, -1)
    out = work.join(hist, [*g, "_b"])
    for n in sum_names:
        out = out.withColumn(f"{n}_before",
                             F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(wrx), F.lit(0)))
    if rank_col:
        out = out.withColumn(rank_col, (F.col("_o__n") + F.row_number().over(wr)).cast("bigint"))
    return out.drop("_b", "_o__n", *[f"_v_{n}" for n in sum_names], *[f"_o_{n}" for n in sum_names])
