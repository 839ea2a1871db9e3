"""Sampling, splitting and balancing by the hash-rank contract.

Rows are ordered by ``md5(seed|id)`` (ties by id) and cut by exact counts, so
samples are reproducible, independent of partitioning, and identical to the
DuckDB oracle. Sizes follow the reference's rules (sklearn ``ceil`` for a
test fraction, pandas ``round`` for ``sample(frac)``)."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.ordering import DEFAULT_SEED, hash_rank, hash_top_n


def _check_sizes(total, per_label):
    if (total is None) == (per_label is None):
        raise ValueError("give exactly one of num_examples_total / num_examples_per_label")


def holdout_split(df: DataFrame, id_col: str = "id", hold_out: float = 0.10,
                  seed=DEFAULT_SEED) -> DataFrame:
    """90/10 held-out split, then 90/10 of the rest into LM train / LM test.
    Adds ``split`` in {heldout, lm_train, lm_test}; sizes use ceil like
    sklearn's ``train_test_split(test_size=p)``."""
    if not 0 < hold_out < 1:
        raise ValueError("hold_out must be in (0, 1)")
    n = df.count()
    n_hold = math.ceil(n * hold_out)
    n_lm_test = math.ceil((n - n_hold) * hold_out)
    r = hash_rank(df, id_col, seed, rank_col="_r")
    return r.withColumn("split", F.when(F.col("_r") <= n_hold, "heldout")
                        .when(F.col("_r") <= n_hold + n_lm_test, "lm_test")
                        .otherwise("lm_train")).drop("_r")


def three_way_split(df: DataFrame, id_col: str = "id", group_cols: Sequence[str] = (),
                    sample_frac: float = 0.8, valid_frac: float = 0.25,
                    seed=41) -> DataFrame:
    """train/valid/test = 60/20/20: a ``sample_frac`` sample (rest is test), of
    which ``valid_frac`` is valid. Per group (e.g. task); sizes use
    round-half-even like pandas ``sample(frac)``."""
    g = list(group_cols)
    r = hash_rank(df, id_col, seed, group_cols=g, rank_col="_r")
    # per-group sizes from a group count joined back (no single-partition window)
    sizes = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")) if g else None
    if g:
        r = r.join(sizes, g)
    else:
        r = r.withColumn("_n", F.lit(df.count()))
    n_s = F.bround(F.col("_n") * sample_frac, 0)
    n_v = F.bround(n_s * valid_frac, 0)
    return (r.withColumn("split", F.when(F.col("_r") <= n_v, "valid")
                         .when(F.col("_r") <= n_s, "train").otherwise("test"))
            .drop("_r", "_n"))


def fewshot(df: DataFrame, id_col: str = "id", label_col: str = "label",
            num_examples_total: int | None = None, num_examples_per_label: int | None = None,
            seed=DEFAULT_SEED, dev_total: int | None = None, dev_per_label: int | None = None,
            also_sample_dev: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Few-shot sampler: N in total or N per label (fewer when a class is
    smaller). With ``also_sample_dev`` a second, disjoint sample of the rows
    left is returned as well (dev sizes default to the train sizes)."""
    _check_sizes(num_examples_total, num_examples_per_label)
    groups = [] if num_examples_total is not None else [label_col]
    n = num_examples_total if num_examples_total is not None else num_examples_per_label
    train = hash_top_n(df, n, id_col, seed, group_cols=groups)
    if not also_sample_dev:
        return train
    m = (dev_total if num_examples_total is not None else dev_per_label) or n
    dev = hash_top_n(df, m, id_col, seed, group_cols=groups, offset=n)
    return train, dev


def balance_min(df: DataFrame, label_col: str = "label", id_col: str = "id",
                seed=DEFAULT_SEED) -> DataFrame:
    """Undersample every class to the size of the smallest class."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_c"))
    n_min = counts.agg(F.min("_c")).first()[0] or 0
    return hash_top_n(df, int(n_min), id_col, seed, group_cols=[label_col])


def shuffle_rows(df: DataFrame, id_col: str = "id", seed=DEFAULT_SEED,
                 rank_col: str = "shuffle_rank") -> DataFrame:
    """Seeded shuffle: a global 1-based position in hash order (distributed rank)."""
    return hash_rank(df, id_col, seed, rank_col=rank_col)


def vocab_examples(df: DataFrame, token_col: str = "word", modulus: int = 101) -> DataFrame:
    """About 1 % of tokens as examples, picked by a hash (deterministic)."""
    h = F.conv(F.substring(F.md5(token_col), 1, 8), 16, 10).cast("long")
    return df.where(F.pmod(h, F.lit(modulus)) == 1)
