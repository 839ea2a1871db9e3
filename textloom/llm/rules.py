"""Quality rules: row-local text statistics and a learned decision list.

All statistics are array and string expressions on one row; nothing is shuffled
and no text leaves the scan. The decision list is learned by sequential covering:
each rule grows one threshold condition at a time by information gain on the
growing split, is pruned on the pruning split by dropping its last conditions, and
is kept only if it is precise there; the rows it covers are then taken out. What a
step needs is a histogram (statistic x bin x split x label) of the rows that are
still uncovered, one Spark aggregate of bounded size over all labelled rows. The
rules become one ordered Spark conditional expression.

Words are runs of other characters than space and \\t \\n \\v \\f \\r. Defined cases:
null text has no words; a text of one long line or without line ends is one line;
labels that are null or other than 0 and 1 are ignored, as are labels without a
document; a doc_id labelled twice counts twice; without labels of both kinds the
list is empty and only the base rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import BLANKS, materialize, small_side

SYMBOLS = "#*$%&|<>"
#: Words in a repeat window.
RUN = 5
#: Up to so many labelled ids (8 bytes each) are broadcast to find their texts.
LABELLED = 200_000


# --- statistics --------------------------------------------------------------

def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__n_words``, ``__word_chars``, ``__n_symbols``,
    ``__n_dup_lines``, ``__n_repeat_words`` and the ratios the rules use."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = F.lit(BLANKS)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, blank)) > 0)
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    cols = docs.columns
    # one-element generators keep the costly arrays from being computed at each use
    a = docs.select("*", F.inline(F.array(F.struct(lines.alias("__l"), words.alias("__w"), F.length(t).alias("__len")))))
    n = F.size("__w")
    grams = F.when(n >= RUN, F.transform(F.sequence(F.lit(1), n - (RUN - 1)), lambda i: F.concat_ws(
        " ", *[F.element_at("__w", (i + k).cast("int")) for k in range(RUN)])))
    counted = a.select(
        *cols, n.cast("long").alias("__n_words"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("__word_chars"),
        (F.col("__len") - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("__n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("__n_dup_lines"),
        F.size("__l").alias("__n_lines"), F.col("__len"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).alias("__n_upper"),
        F.length(F.regexp_replace(t, r"[^0-9]+", "")).alias("__n_digits"),
        F.length(F.regexp_replace(t, r"[^.,;:!?]+", "")).alias("__n_points"),
        F.inline(F.array(F.struct(grams.alias("__g")))))
    # windows that occur twice or more, by sorting them with their places
    again = F.col("__g").isNotNull() & (F.size(F.array_distinct("__g")) < F.size("__g"))
    placed = F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    some = counted.select("*", F.inline(F.array(F.struct(F.when(again, placed).alias("__s")))))
    m = F.size("__s")
    twice = F.zip_with(F.slice("__s", 1, m - 1), F.slice("__s", 2, m - 1), lambda x, y: F.when(
        x["g"] == y["g"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")))
    at = F.sort_array(F.array_distinct(F.flatten(twice)))
    some = some.select("*", F.inline(F.array(F.struct(F.when(F.col("__s").isNotNull(), at).alias("__at")))))
    k = F.size("__at")
    covered = F.aggregate(
        F.zip_with(F.slice("__at", 1, k - 1), F.slice("__at", 2, k - 1), lambda x, y: F.least(y - x, F.lit(RUN))),
        F.lit(RUN).cast("long"), lambda s, x: s + x)
    out = some.select("*", F.when(F.col("__at").isNotNull(), covered).otherwise(F.lit(0).cast("long")).alias("__n_repeat_words"))
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return out.select(
        *cols, "__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words",
        per("__n_symbols", "__n_words").alias("__symbols"), per("__n_dup_lines", "__n_lines").alias("__dup_lines"),
        per("__n_repeat_words", "__n_words").alias("__repeats"), per("__n_upper", "__word_chars").alias("__upper"),
        per("__n_digits", "__word_chars").alias("__digits"), per("__n_points", "__n_words").alias("__points"),
        per("__word_chars", "__n_words").alias("__word_length"), per("__n_words", "__n_lines").alias("__line_words"))


#: Statistics that conditions may test. Lengths tell language and genre apart rather
#: than quality, so they are reported but not tested.
FEATURES = ("__symbols", "__dup_lines", "__repeats", "__upper", "__digits", "__points")


def base_failed(n_words: str = "__n_words", n_repeat: str = "__n_repeat_words") -> Column:
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat) > 20 * F.col(n_words))


# --- decision list -----------------------------------------------------------

@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` if ``above``, else ``feature <= threshold``."""
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """A conjunction; the texts it covers are of low quality."""
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def rejects(rules: list[Rule]) -> Column:
    """The ordered list as one conditional: the first rule that covers decides."""
    if not rules:
        return F.lit(False)
    out = F.when(rules[0].column(), F.lit(True))
    for r in rules[1:]:
        out = out.when(r.column(), F.lit(True))
    return out.otherwise(F.lit(False))


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, dict]:
    """feature -> (grow, bad) -> running row counts: entry j has the rows of bins
    below j, where the bin of a row is the number of cuts below its value."""
    binned = F.array(*[F.struct(F.lit(f).alias("f"), sum(
        [(F.col(f) > F.lit(c)).cast("int") for c in cuts[f]], F.lit(0)).alias("b")) for f in cuts])
    got = (rows.select("grow", "bad", F.explode(binned).alias("x"))
           .groupBy("x.f", "x.b", "grow", "bad").agg(F.count(F.lit(1)).alias("n")).collect())
    out = {f: {(g, b): [0] * (len(cuts[f]) + 2) for g in (True, False) for b in (True, False)} for f in cuts}
    for r in got:
        out[r["f"]][r["grow"], r["bad"]][r["b"] + 1] = r["n"]
    for kinds in out.values():
        for counts in kinds.values():
            for j in range(1, len(counts)):
                counts[j] += counts[j - 1]
    return out


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """Information that a condition adds about the bad rows it still covers."""
    if bad == 0:
        return 0.0
    return bad * (log2(bad / (bad + good)) - log2(bad0 / (bad0 + good0)))


def learn_rules(stats: DataFrame, labels: DataFrame, features=FEATURES, n_bins: int = 24,
                max_rules: int = 6, max_conditions: int = 3, min_precision: float = 0.97,
                min_covered: int = 5, seed: int = 11) -> list[Rule]:
    """Ordered rules that cover rows of quality 0.

    ``stats``: doc_id and ``features``; ``labels``: doc_id and quality. All labelled
    rows count. Two thirds of them, by a seeded hash of doc_id, grow the rules and
    one third prunes them; a rule needs ``min_precision`` on both and
    ``min_covered`` rows of the growing split."""
    rows = materialize(
        stats.select("doc_id", *features).join(
            labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality"), "doc_id")
        .select(*features, (F.col("quality") == 0).alias("bad"),
                (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(3)) > 0).alias("grow")))
    probs = [i / n_bins for i in range(1, n_bins)]
    # cuts at quantiles of each class, so a rare class has thresholds of its own
    per_class = rows.groupBy("bad").agg(*[F.percentile_approx(f, probs, 10_000).alias(f) for f in features]).collect()
    if len(per_class) < 2:
        return []
    cuts = {f: sorted({float(x) for r in per_class for x in r[f]}) for f in features}
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        at = left
        trail: list[tuple[int, int, int, int]] = []      # bad, good of grow; bad, good of prune
        while len(conditions) < max_conditions:
            hist = _histogram(at, cuts)
            kinds = ((True, True), (True, False), (False, True), (False, False))
            bad0, good0 = (hist[features[0]][k][-1] for k in kinds[:2])
            if bad0 == 0 or good0 == 0:
                break
            best = None
            for f in features:
                for j, cut in enumerate(cuts[f]):
                    low = [hist[f][k][j + 1] for k in kinds]
                    high = [hist[f][k][-1] - n for k, n in zip(kinds, low)]
                    for above, split in ((True, high), (False, low)):
                        g = _gain(split[0], split[1], bad0, good0)
                        if split[0] >= min_covered and g > 0 and (best is None or g > best[0] + 1e-9):
                            best = (g, Condition(f, above, cut), tuple(split))
            if best is None:
                break
            conditions.append(best[1])
            trail.append(best[2])
            at = at.where(best[1].column())
        # prune: the shortest prefix of the conjunction that does best on the other split
        value = lambda t: (t[2] - t[3]) / (t[2] + t[3]) if t[2] + t[3] else -1.0
        if not trail:
            break
        keep = max(range(len(trail)), key=lambda i: (value(trail[i]), -i)) + 1
        b, g, pb, pg = trail[keep - 1]
        if b < min_precision * (b + g) or pb < min_precision * (pb + pg) or b < min_covered:
            break
        rule = Rule(tuple(conditions[:keep]), (b + pb) / (b + g + pb + pg), b + g + pb + pg)
        rules.append(rule)
        left = left.where(~rule.column())
    return rules


def judge(docs: DataFrame, labels: DataFrame, **settings) -> tuple[DataFrame, list[Rule]]:
    """doc_id, the statistics, ``base_failed`` and ``kept`` of every row, and the rules.

    The statistics are computed once, in one scan of the texts, and kept as a narrow
    checkpoint from which the rules are learned and to which they are applied."""
    stats = materialize(with_statistics(docs.select("doc_id", "text")).drop("text"))
    rules = learn_rules(stats, labels, **settings)
    return stats.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~(F.col("base_failed") | rejects(rules))), rules


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Rows of ``docs`` that the base rule and the learned list keep, all columns as they are.

    The rules are learned from the statistics of labelled rows alone; the verdict is then an
    expression on each row, in one scan of the texts."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("__known")).distinct()
    few = docs.select("doc_id", "text").join(small_side(materialize(known), LABELLED), F.col("doc_id") == F.col("__known"), "left_semi")
    rules = learn_rules(materialize(with_statistics(few).drop("text")), labels, **settings)
    # statistics by names that the table's own columns don't have
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text"))
    kept = with_statistics(row).where(~(base_failed() | rejects(rules)))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
