"""Information-theoretic sanitisation of personal data.

Base findings (e-mail, ip, card, phone) are the protected entities. The words of
the documents that mention them are terms, and the corpus tells how strongly a term
reveals an entity. With N documents, n(c) with the entity, n(t) with the term and
n(t, c) with both, wherever they stand in the document, the term discloses

    PMI(t; c) / IC(c) = 1 - log(n(t) / n(t, c)) / log(N / n(c))

of the entity's information: 1 if the term occurs only with the entity, about 0 if
it is independent of it. Terms at ``generalise_at`` or more are generalised to a
class, terms at ``remove_at`` or more are removed, at every place in the documents that
mention that entity. The estimate needs ``support`` documents in which the contexts of
the entity differ, so copies of one text are no evidence and a word seen once is not
taken for a disclosure. Texts without a mention are left as they are.

Everything is DataFrame and SQL functions. Places come from the lengths of matches
and of the stretches between them; patterns use possessive quantifiers, so a long run
of digits or letters costs linear time and no stack. A context is up to ``REACH``
code points on each side of a mention, ended by the next match of its kind; it only
tells copies apart and limits no term.

Defined cases: null text counts as empty; repeated rows give repeated results; rows
with one doc_id and different texts are told apart by their texts; an entity in all
documents discloses nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalise", "remove")
_LOCAL = "A-Za-z0-9._%+-"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Java patterns. A start inside a run of the same characters is only possible right
#: after the match before it (\G), which keeps the search for starts linear.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Code points of context on each side of a mention.
REACH = 160
_CHUNK = 128
#: Words of a text; addresses and numbers are matched first and are no terms.
_TOKEN = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9.-]+|\+?[0-9][0-9.()-]*|\p{{L}}[\p{{L}}\p{{M}}]*"


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a one-element generator: each is computed once per row."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def _chunk_totals(w: Column) -> Column:
    """The running total before each chunk of ``_CHUNK`` elements."""
    chunks = F.when(F.size(w) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(w) - 1) / _CHUNK).cast("int")),
        lambda c: _total(F.slice(w, c * _CHUNK + 1, F.lit(_CHUNK)))))
    return F.aggregate(F.coalesce(chunks, F.array().cast("array<bigint>")), F.array(F.lit(0).cast("long")),
                       lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _is_word(m: Column) -> Column:
    return m.rlike(r"^\p{L}") & ~m.contains("@")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return total + F.when(i % 2 == 0, twice).otherwise(v)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return text.rlike(PATTERNS[kind])


def base_findings(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, ``h`` (hash of the text), ``n_<kind>``, ``base`` (kind, start, end by kind,
    then start) and ``mentions`` (entity, start, end, left, right) of every row."""
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", t.alias("t"), F.xxhash64(F.col("text")).alias("h"))
    none = F.array().cast("array<string>")
    found = {}
    for k in KINDS:
        has = _may_hold(k, F.col("t"))
        found[f"m_{k}"] = F.when(has, F.regexp_extract_all("t", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none)
        found[f"g_{k}"] = F.when(has, F.split("t", PATTERNS[k], -1)).otherwise(none)
    df = _once(df, **found)
    # running totals in two steps: over chunks, then within a chunk
    df = _once(df, **{f"w_{k}": F.zip_with(f"m_{k}", F.slice(f"g_{k}", 1, F.size(f"m_{k}")),
                                           lambda m, g: (F.length(m) + F.length(g)).cast("long")) for k in KINDS})
    df = _once(df, **{f"p_{k}": _chunk_totals(F.col(f"w_{k}")) for k in KINDS})

    def spans(k: str) -> Column:
        def span(m: Column, i: Column) -> Column:
            w, g, at = F.col(f"w_{k}"), F.col(f"g_{k}"), F.floor(i / _CHUNK).cast("int")
            start = (F.element_at(F.col(f"p_{k}"), at + 1) + _total(F.slice(w, at * _CHUNK + 1, i - at * _CHUNK))
                     + F.length(F.element_at(g, i + 1)))
            left, right = F.element_at(g, i + 1), F.element_at(g, i + 2)
            return F.struct(
                F.lit(k).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"),
                F.concat_ws(":", F.lit(k), F.lower(m) if k == "email" else F.regexp_replace(
                    m, "[^0-9.]" if k == "ip" else "[^0-9]", "")).alias("entity"),
                F.when(F.length(left) > reach, F.regexp_replace(F.substring(left, -reach, reach), r"^\S+", ""))
                .otherwise(left).alias("left"),
                F.when(F.length(right) > reach, F.regexp_replace(F.substring(right, 1, reach), r"\S+$", ""))
                .otherwise(right).alias("right"), _valid(k, m).alias("ok"))
        return F.filter(F.transform(f"m_{k}", span), lambda s: s["ok"])
    df = _once(df, **{f"s_{k}": spans(k) for k in KINDS})
    every = F.concat(*[F.col(f"s_{k}") for k in KINDS])
    return df.select(
        "doc_id", "h", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.transform(every, lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("base"),
        F.transform(every, lambda s: F.struct(s["entity"], s["start"], s["end"], s["left"], s["right"])).alias("mentions"))


def _entities(base: DataFrame) -> DataFrame:
    """(entity, n_c) of every entity: the documents that mention it."""
    return (base.select("doc_id", "h", F.explode("mentions").alias("x"))
            .groupBy(F.col("x.entity").alias("entity")).agg(F.count_distinct("doc_id", "h").alias("n_c")))


def _words() -> Column:
    """The distinct words of ``text``, lower-cased."""
    found = F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, _is_word), F.lower))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(term, n_t) of every word: the rows that hold it outside addresses, where
    ``_document_terms`` looks as well."""
    return (docs.select(F.explode(_words()).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))


def _document_terms(docs: DataFrame, base: DataFrame, counts: DataFrame, support: int = 3,
                    generalise_at: float = 0.6, remove_at: float = 0.85) -> DataFrame:
    """doc_id, h, entity, ctx, term: each word of a whole document with each entity that
    the document mentions; ``ctx`` is a hash of all contexts of that entity there.

    Left out are only pairs that cannot reach the threshold: n(t, c) is at most n(c),
    so n(t) is at most n(c) (N / n(c)) ^ (1 - generalise_at) in those that do."""
    n = F.broadcast(base.agg(F.count(F.lit(1)).alias("n")))          # one row
    most = F.col("n_c") * F.pow(F.col("n") / F.col("n_c"), F.lit(1.0 - generalise_at)) * (1 + 1e-9)
    able = (_entities(base).where(F.col("n_c") >= support).withColumn("one", F.lit(1))
            .join(n.withColumn("one", F.lit(1)), "one").where("n > n_c").select("entity", most.alias("most")))
    x = F.explode("mentions").alias("x")
    held = (base.select("doc_id", "h", x).select("doc_id", "h", "x.entity", F.xxhash64("x.left", "x.right").alias("c"))
            .groupBy("doc_id", "h", "entity").agg(F.xxhash64(F.sort_array(F.collect_set("c"))).alias("ctx"))
            .join(able, "entity").groupBy(F.col("doc_id").alias("d2"), F.col("h").alias("h2"))
            .agg(F.collect_list(F.struct("entity", "ctx", "most")).alias("held")))
    texts = _with_hash(docs).join(held, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")))
    texts = _once(texts.select("doc_id", "h", "text", "held"), words=_words())
    able_words = (texts.select("doc_id", "h", "held", F.explode("words").alias("term")).join(counts, "term")
                  .where(F.col("n_t") <= F.array_max(F.col("held.most"))))
    return (able_words.select("doc_id", "h", "term", "n_t", F.inline("held")).where(F.col("n_t") <= F.col("most"))
            .select("doc_id", "h", "entity", "ctx", "term"))


def _with_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h"))


def disclosures(docs: DataFrame, base: DataFrame, terms: DataFrame, support: int = 3,
                generalise_at: float = 0.6, remove_at: float = 0.85, counts: DataFrame | None = None) -> DataFrame:
    """(entity, term, action, disclosure) of every term at or above the lower threshold."""
    pairs = (terms.groupBy("entity", "term")
             .agg(F.count_distinct("doc_id", "h").alias("n_tc"), F.count_distinct("ctx").alias("s"))
             .where((F.col("s") >= support) & (F.col("n_tc") >= support)))
    df = _word_counts(docs) if counts is None else counts
    n = F.broadcast(base.agg(F.count(F.lit(1)).alias("n")))          # one row
    got = (pairs.join(df, "term").join(_entities(base), "entity").withColumn("one", F.lit(1))
           .join(n.withColumn("one", F.lit(1)), "one"))
    # a repeated row counts in n(t) and not in n(t, c), so the ratio is at most 1
    part = 1 - F.log(F.greatest(F.col("n_t") / F.col("n_tc"), F.lit(1.0))) / F.log(F.col("n") / F.col("n_c"))
    return (got.where("n > n_c").withColumn("disclosure", part).where(F.col("disclosure") >= generalise_at)
            .select("entity", "term", "disclosure", F.when(F.col("disclosure") >= remove_at, "remove")
                    .otherwise("generalise").alias("action")))


def _occurrences(docs: DataFrame, told: DataFrame) -> DataFrame:
    """d2, h2 and ``more``: the spans of every occurrence of the terms that are told for a
    document, from rows (doc_id, h, term, action), in the whole text."""
    per = (told.groupBy("doc_id", "h", "term").agg(F.max("action").alias("kind"))   # remove > generalise
           .groupBy(F.col("doc_id").alias("d2"), F.col("h").alias("h2"))
           .agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds")))
    df = _with_hash(docs).join(per, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")))
    df = _once(df.select("d2", "h2", "text", "kinds"), m=F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)),
               g=F.split("text", _TOKEN, -1))
    df = _once(df, w=F.zip_with("m", F.slice("g", 1, F.size("m")), lambda m, g: (F.length(m) + F.length(g)).cast("long")))
    df = _once(df, p=_chunk_totals(F.col("w")))
    df = _once(df, hits=F.filter(F.transform("m", lambda m, i: F.struct(
        i.alias("i"), F.when(_is_word(m), F.element_at("kinds", F.lower(m))).alias("kind"))),
        lambda x: x["kind"].isNotNull()))

    def span(x: Column) -> Column:
        i = x["i"]
        at = F.floor(i / _CHUNK).cast("int")
        start = (F.element_at("p", at + 1) + _total(F.slice("w", at * _CHUNK + 1, i - at * _CHUNK))
                 + F.length(F.element_at("g", i + 1)))
        return F.struct(x["kind"].alias("kind"), start.alias("start"),
                        (start + F.length(F.element_at("m", i + 1))).alias("end"))
    return df.select("d2", "h2", F.sort_array(F.transform("hits", span)).alias("more")).dropDuplicates(["d2", "h2"])


def sanitise_spans(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, ``h``, ``n_<kind>``, ``base`` and ``spans`` (base, then terms by action and
    start) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    base = materialize(base_findings(docs))
    counts = materialize(_word_counts(docs))
    terms = materialize(_document_terms(docs, base, counts, **settings))
    told = disclosures(docs, base, terms, counts=counts, **settings)
    hits = _occurrences(docs, terms.join(told, ["entity", "term"]))
    out = base.join(hits, F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("h").eqNullSafe(F.col("h2")), "left")
    clear = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", clear))
    return out.select("doc_id", "h", *[f"n_{k}" for k in KINDS], "base", spans.alias("spans"))


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with sanitised ``text``: entities become ``[KIND]``, generalised terms
    ``[word]`` or ``[Name]`` by their first letter, removed terms ``[...]``."""
    found = sanitise_spans(docs, **settings).select(
        F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.col("spans").alias("__s")).distinct()
    # the table's own columns stay in one struct, so none can clash
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text",
                      F.xxhash64("text").alias("__x"))
    df = row.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__x") == F.col("__h")), "left")
    order = F.array_sort(F.transform("__s", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("kind")))
    clear = F.aggregate(order, start, lambda acc, s: F.when(
        s["start"] >= F.element_at(acc, -1)["end"], F.concat(acc, F.array(s))).otherwise(acc))
    df = _once(df, __c=clear)

    def piece(s: Column, i: Column) -> Column:
        before = F.element_at("__c", i + 1)["end"]
        word = F.col("text").substr((s["start"] + 1).cast("int"), F.lit(1))
        mark = (F.when(s["kind"] == "remove", F.lit("[...]"))
                .when(s["kind"] == "generalise", F.when(word.rlike(r"\p{Lu}"), "[Name]").otherwise("[word]"))
                .otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.concat(F.col("text").substr((before + 1).cast("int"), (s["start"] - before).cast("int")), mark)
    last = (F.element_at("__c", -1)["end"] + 1).cast("int")
    text = F.concat(F.array_join(F.transform(F.slice("__c", 2, F.size("__c") - 1), piece), ""),
                    F.col("text").substr(last, F.length("text")))
    text = F.when(F.size("__c") > 1, text).otherwise(F.col("text"))
    return df.select(*[(text if c == "text" else F.col("__row").getField(c)).alias(c) for c in docs.columns])
