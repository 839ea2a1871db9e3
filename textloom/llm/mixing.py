"""Hierarchical budgeting: mix sources to target weights.

The levels (say domain, language, source) form a tree. A token budget flows from
the root down: the children of a node share its budget by their weights, each
limited to what its subtree can give (its tokens times ``max_epochs``). What a short
child leaves goes to its siblings first, in proportion to their weights; only when
all of them are full does the parent itself fall short, and the rest goes to the
parent's siblings. This is water-filling at each node, done with windows over the
table of nodes.

Each leaf then repeats its documents for whole epochs, and takes from one more
epoch the longest run of documents, in the order of a seeded hash of that epoch,
that stays within the tokens left. The running totals are exact: a histogram over
hash prefixes gives each document bucket its offset, so a leaf with a third of all
rows is split.

Tokens are white-space separated words. Defined cases: null or empty texts have no
tokens and are never selected; null level values form a node of their own; nodes
without a given weight have weight 1, a weight of 0 takes nothing; repeated rows
count each on its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import BLANKS, materialize, small_side

SEED = 17
#: Hash prefix of the order key: 3 hex digits, 4096 buckets in each leaf.
PREFIX = 3


def n_tokens(text: Column) -> Column:
    """White-space separated words, without splitting the text into an array."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(marks, BLANKS, "")).cast("long")


def _weight(levels: Sequence[str], weights: Mapping[str, float]) -> Column:
    """Weight of a node by its own path, ``a/b/c``."""
    path = F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("")) for c in levels])
    w = F.lit(1.0)
    for key, value in sorted(weights.items()):
        w = F.when(path == key, F.lit(float(value))).otherwise(w)
    return w


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, float],
                 budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with ``budget`` tokens for each leaf, floored."""
    tree = leaves.withColumn("__cap", F.col("tokens") * F.lit(max_epochs))
    parents: list[str] = []
    whole = tree.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("__cap"), F.lit(0)).alias("__cap"))
    out = whole.select(F.least(budget, F.col("__cap")).cast("double").alias("__b"))
    for depth in range(1, len(levels) + 1):
        own = list(levels[:depth])
        nodes = (tree.groupBy(*own).agg(F.sum("__cap").cast("double").alias("__c"))
                 .withColumn("__w", _weight(own, weights)).where("__w > 0 and __c > 0"))
        if parents:
            up = out.select(*[F.col(c).alias(f"__{c}") for c in parents], F.col("__b"))
            same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in parents]
            nodes = nodes.join(up, same).drop(*[f"__{c}" for c in parents])
        else:
            nodes = nodes.withColumn("__one", F.lit(1)).join(
                F.broadcast(out.withColumn("__one", F.lit(1))), "__one").drop("__one")
        # least room for its weight first; the first unfilled child sets the level for the rest
        order = [F.col("__c") / F.col("__w"), *[F.col(c) for c in own]]
        w = Window.partitionBy(*parents).orderBy(*order) if parents else Window.partitionBy(F.lit(1)).orderBy(*order)
        before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("__lv", (F.col("__b") - F.coalesce(F.sum("__c").over(before), F.lit(0.0)))
                                 / F.sum("__w").over(after))
        nodes = nodes.withColumn("__level", F.when(F.col("__c") > F.col("__lv") * F.col("__w"), F.col("__lv")))
        whole_w = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        level = F.first("__level", ignorenulls=True).over(whole_w)
        share = F.when(level.isNull(), F.col("__c")).otherwise(F.least(F.col("__c"), level * F.col("__w")))
        out = nodes.withColumn("__b2", share).select(*own, F.col("__b2").alias("__b"))
        parents = own
    b = out.select(*[F.col(c).alias(f"__{c}") for c in parents], F.floor(F.col("__b") + 1e-6).cast("long").alias("budget"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in parents]
    return leaves.join(b, same).drop(*[f"__{c}" for c in parents])


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, float],
        fraction: float = 0.5, max_epochs: int = 4, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` selected for the mixture, with ``__epoch`` (0, 1, ...) and
    ``__tokens``; a document taken in several epochs comes out once for each.

    ``levels`` maps level names to columns of ``docs``, top level first; ``fraction``
    is the token budget as a share of all tokens."""
    names = [f"__l_{k}" for k in levels]
    key = lambda epoch: F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"),
                                          F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select(*docs.columns, *[c.alias(n) for n, c in zip(names, levels.values())],
                        n_tokens(F.col("text")).alias("__tokens")).where("__tokens > 0")
    thin = materialize(sized.select("doc_id", *names, "__tokens"))
    leaves = thin.groupBy(*names).agg(F.sum("__tokens").alias("tokens"))
    total = thin.agg(F.coalesce(F.sum("__tokens"), F.lit(0))).first()[0]
    plan = leaf_budgets(leaves, names, weights, F.lit(fraction * total), max_epochs)
    plan = small_side(materialize(plan.where("budget > 0").select(
        *names, F.expr("budget div tokens").alias("__full"), F.expr("budget % tokens").alias("__rest"))))
    leaf = lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]

    # where the last, partial epoch ends in each leaf: the bucket, then the row in it
    part = (thin.alias("t").join(plan.alias("p"), leaf("t", "p"))
            .select("t.*", "p.__full", "p.__rest").withColumn("__k", key(F.col("__full")))
            .withColumn("__h", F.substring("__k", 1, PREFIX)))
    hist = part.groupBy(*names, "__h").agg(F.sum("__tokens").alias("__s"), F.max("__rest").alias("__rest"))
    upto = Window.partitionBy(*names).orderBy("__h")
    hist = hist.withColumn("__before", F.sum("__s").over(upto) - F.col("__s"))
    edge = (hist.where("__before <= __rest and __before + __s > __rest")
            .select(*names, F.col("__h").alias("__eh"), "__before"))
    run = Window.partitionBy(*names, "__h").orderBy("__k", "doc_id", "__tokens")
    cut = (part.alias("t").join(edge.alias("p"), [*leaf("t", "p"), F.col("t.__h") == F.col("p.__eh")])
           .select("t.*", "p.__before")
           .withColumn("__cum", F.col("__before") + F.sum("__tokens").over(run.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("__over", F.col("__cum") > F.col("__rest"))
           .where("__over").groupBy(*names)
           .agg(F.min(F.struct("__k", "doc_id", "__tokens")).alias("__cut")))
    ends = small_side(materialize(plan.alias("t").join(cut.alias("p"), leaf("t", "p"), "left")
                                  .select("t.*", "p.__cut")))

    rows = (sized.alias("t").join(ends.alias("p"), leaf("t", "p")).select("t.*", "p.__full", "p.__cut"))
    in_rest = F.struct(key(F.col("__full")).alias("__k"), "doc_id", "__tokens") < F.col("__cut")
    times = F.col("__full") + F.when(in_rest, F.lit(1)).otherwise(F.lit(0))
    return (rows.withColumn("__times", times.cast("int")).where("__times > 0")
            .withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
            .drop("__times", "__full", "__cut"))
