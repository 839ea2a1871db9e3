"""Vocabulary, encoding, padding, term weighting and phrase detection.

All set-level steps are joins and group-bys; the vocabulary is a DataFrame
``(word, id, cnt)``, never a driver dict. Ranks over the vocabulary use the
distributed ``ordered_prefix`` (no single-partition window)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from textloom.functions import text as T
from textloom.operators.common import SMALL_ROWS, evaluate_once, materialize, with_one_row
from textloom.operators.ordering import n_buckets_of, ordered_prefix

PAD, UNK = "<pad>", "<unk>"
#: Phrases up to which their hashes (8 bytes each) are broadcast.
HASHED_ROWS = 2_000_000


def positions(df: DataFrame, doc_col: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """``(doc, pos, word)`` long form of a token array (0-based pos)."""
    return df.select(doc_col, F.posexplode(tokens).alias("pos", "word"))


def vocabulary(df: DataFrame, doc_col: str = "doc_id", tokens: str = "tokens",
               min_word_count: int = 5) -> DataFrame:
    """``<pad>``=0, kept words (count >= min) from 1 in first-appearance order
    (document order, then position), ``<unk>`` last. Returns (word, id, cnt)."""
    p = positions(df, doc_col, tokens)
    agg = p.groupBy("word").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min(F.struct(F.col(doc_col).alias("d"), F.col("pos").alias("p"))).alias("first"))
    kept = materialize(agg.where(F.col("cnt") >= min_word_count)
                       .select("word", "cnt", F.col("first.d").alias("_fd"), F.col("first.p").alias("_fp")))
    ranked = ordered_prefix(kept, ["_fd", "_fp"], rank_col="id").select(
        "word", F.col("id").cast("int").alias("id"), "cnt")
    # specials from a one-row aggregate (lazy: no extra pass over the corpus)
    n_kept = kept.agg(F.count(F.lit(1)).alias("_n"))
    specials = n_kept.select(F.explode(F.array(
        F.struct(F.lit(PAD).alias("word"), F.lit(0).alias("id"), F.lit(0).cast("bigint").alias("cnt")),
        F.struct(F.lit(UNK).alias("word"), (F.col("_n") + 1).cast("int").alias("id"),
                 F.lit(0).cast("bigint").alias("cnt")))).alias("s")).select("s.*")
    return ranked.unionByName(specials)


def _place(docs: pa.Table, words: pa.Array, values: pa.Array, every: bool) -> pa.RecordBatch:
    """The values of the tokens of ``docs`` (rows of a document side by side). Rows of one
    document are merged by position; ``every`` repeats the result for each of them."""
    code = np.asarray(docs.column("_doc").combine_chunks().dictionary_encode(null_encoding="encode").indices)
    tokens = docs.column("_tokens").combine_chunks()
    size = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), dtype=np.int64)
    found = values.take(pc.index_in(tokens.flatten(), value_set=words))
    start = np.append(True, code[1:] != code[:-1])
    group = np.cumsum(start) - 1
    if not start.all():                          # repeated documents
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        found = found.take(pa.array(np.lexsort((pos, np.repeat(group, size)))))
    total = np.bincount(group, weights=size).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(total)), pa.int32()), found)
    rows = np.arange(len(code)) if every else np.flatnonzero(start)
    rows = rows if every else rows[total > 0]
    return pa.RecordBatch.from_arrays([docs.column("_doc").combine_chunks().take(pa.array(rows)),
                                       lists.take(pa.array(group[rows]))], ["doc", "values"])


def _mean(docs: pa.Table, words: pa.Array, values: pa.Array) -> pa.RecordBatch:
    """The mean value (a vector) of the known tokens of ``docs`` (rows of a document side by side)."""
    code = np.asarray(docs.column("_doc").combine_chunks().dictionary_encode(null_encoding="encode").indices)
    tokens = docs.column("_tokens").combine_chunks()
    size = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), dtype=np.int64)
    vec = np.asarray(values.flatten()).reshape(len(words), -1 if len(words) else 0)
    at = pc.index_in(tokens.flatten(), value_set=words)
    known = np.flatnonzero(np.asarray(at.is_valid()))
    at = np.asarray(at.take(pa.array(known)), dtype=np.int64)
    start = np.append(True, code[1:] != code[:-1])
    group = np.repeat(np.cumsum(start) - 1, size)[known]
    found, n = np.unique(group * max(1, len(words)) + at, return_counts=True)
    group, at = np.divmod(found, max(1, len(words)))
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:len(group)])
    means = [n[i:j] @ vec[at[i:j]].astype(np.float64) / n[i:j].sum() for i, j in zip(first, np.append(first[1:], len(group)))]
    rows = pa.array(np.flatnonzero(start)[group[first]])
    ends = pa.array(np.arange(len(means) + 1) * vec.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([docs.column("_doc").combine_chunks().take(rows),
                                       pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0), *means]))], ["doc", "values"])


def mean_of_known(df: DataFrame, table: DataFrame, value: str, doc_col: str = "doc_id", tokens: str = "tokens",
                  out_col: str = "values") -> DataFrame:
    """``(doc, out_col)``: the mean of the values (vectors of one length) that the tokens of a
    document have in ``table`` (word, value), as ``lookup`` finds them. No row without any."""
    return _by_part(df, table, value, doc_col, tokens, out_col, _mean, ArrayType(DoubleType()))


def lookup(df: DataFrame, table: DataFrame, value: str, doc_col: str = "doc_id", tokens: str = "tokens",
           out_col: str = "values", every: bool = False) -> DataFrame:
    """``(doc, out_col)``: the value of each token in ``table`` (word, value), null where it
    has none. The rows of one document are taken together, by position; ``every`` gives a
    row for each row of ``df`` instead of one for each document with tokens."""
    return _by_part(df, table, value, doc_col, tokens, out_col, partial(_place, every=every), ArrayType(table.schema[value].dataType))


def _by_part(df: DataFrame, table: DataFrame, value: str, doc_col: str, tokens: str, out_col: str, place, out_type) -> DataFrame:
    """What ``place`` makes of documents and of the words in ``table`` with their values.

    Documents are dealt into parts. Only the distinct words of a part meet the table in a
    join, and their values travel to the part, ahead of its documents, which pass one Arrow
    batch at a time. So tokens move once, inside their document, and a task holds the
    distinct words of a part."""
    parts = n_buckets_of(df)
    docs = df.select(F.pmod(F.xxhash64(doc_col), F.lit(parts)).cast("int").alias("_part"), F.col(doc_col).alias("_doc"),
                     F.col(tokens).alias("_tokens"))
    words = docs.select("_part", F.explode(F.array_distinct("_tokens")).alias("_word")).distinct()
    known = words.join(table.select(F.col("word").alias("_word"), F.col(value).alias("_value")), "_word")
    both = known.withColumn("_kind", F.lit(0)).unionByName(docs.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    rows = both.repartition(parts, "_part").sortWithinPartitions("_part", "_kind", "_doc").select(
        "_part", "_kind", "_word", "_value", "_doc", "_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words_, values_, held = None, [], [], None

        def placed(t: pa.Table) -> pa.RecordBatch:
            if len(words_) > 1:
                words_[:], values_[:] = [pa.concat_arrays(words_)], [pa.concat_arrays(values_)]
            return place(t, words_[0], values_[0])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            p, kind = np.asarray(b.column(0)), np.asarray(b.column(1))
            cuts = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (kind[1:] != kind[:-1])))
            for at, to in zip(cuts, np.append(cuts[1:], len(p))):
                if part != p[at]:
                    if held is not None:
                        yield placed(held)
                    part, held = p[at], None
                    words_, values_ = ([b.column(i).slice(0, 0)] for i in (2, 3))
                if kind[at] == 0:
                    words_.append(b.column(2).slice(at, to - at))
                    values_.append(b.column(3).slice(at, to - at))
                    continue
                docs_ = t.slice(at, to - at).select(["_doc", "_tokens"])
                docs_ = docs_ if held is None else pa.concat_tables([held, docs_])
                # the last document may go on in the next batch
                code = np.asarray(docs_.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices)
                done = int(np.flatnonzero(code != code[-1]).max(initial=-1)) + 1
                if done:
                    yield placed(docs_.slice(0, done))
                held = docs_.slice(done)
        if held is not None:
            yield placed(held)

    kinds = {f.name: f.dataType for f in rows.schema}
    schema = StructType([StructField("doc", kinds["_doc"]), StructField("values", out_type)])
    return rows.mapInArrow(run, schema).select(F.col("doc").alias(doc_col), F.col("values").alias(out_col))


def encode(df: DataFrame, vocab: DataFrame, doc_col: str = "doc_id", tokens: str = "tokens",
           out_col: str = "ids") -> DataFrame:
    """Token to id lookup; a missing word gives ``<unk>``. Documents without tokens keep
    an empty array, as do rows without a document id."""
    unk = vocab.where(F.col("word") == UNK).select(F.col("id").alias("_unk"))
    v = vocab.where(~F.col("word").isin(PAD, UNK)).select("word", "id")
    found = with_one_row(lookup(df, v, "id", doc_col, tokens, "_v", every=True), unk)
    ids = F.transform("_v", lambda i: F.coalesce(i, F.col("_unk")))
    none = F.array().cast("array<int>")
    return evaluate_once(found.select(doc_col, F.when(F.col(doc_col).isNull(), none).otherwise(ids).alias(out_col)), out_col)


def pad_encoded(df: DataFrame, ids: str = "ids", limit: int = 50, out_col: str = "padded",
                len_col: str = "length") -> DataFrame:
    """Truncate to ``limit``, right-pad with 0, and keep the true length."""
    return df.withColumn(len_col, F.least(F.size(ids), F.lit(limit))).withColumn(
        out_col, T.pad_truncate(ids, limit))


def term_frequencies(df: DataFrame, doc_col: str = "doc_id", terms: str = "terms",
                     reuse: bool = False) -> DataFrame:
    """``(doc, term, tf)``; ``reuse`` checkpoints it for operators that read it
    more than once. Where ``df`` is partitioned by ``doc_col``, terms are counted where their
    document is, and no row of a term moves."""
    tf = (df.select(doc_col, F.explode(terms).alias("term"))
          .groupBy(doc_col, "term").agg(F.count(F.lit(1)).alias("tf")))
    return materialize(tf) if reuse else tf


def top_terms(tf: DataFrame, max_features: int = 50000) -> DataFrame:
    """Vocabulary of the ``max_features`` most frequent terms over the corpus
    (ties by term), with document frequency. Top-k is TakeOrderedAndProject."""
    stats = tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    return stats.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)


def count_vectors(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """Count vectors restricted to the fitted vocabulary (long form); one joined row for each
    distinct term of a document."""
    return tf.join(vocab.select("term"), "term")


def tfidf(tf: DataFrame, vocab: DataFrame, n_docs: int | Column, doc_col: str = "doc_id") -> DataFrame:
    """sklearn-default TF-IDF: idf = ln((1+n)/(1+df)) + 1, w = tf*idf, then L2
    normalised per document. ``n_docs`` is the number of fitted documents."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    v = vocab.select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(v, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc_col)))
    return w.select(doc_col, "term", "tf", (F.col("w") / norm).alias("tfidf"))


def adjacent_pairs(tokens: str = "tokens") -> Column:
    """Array of (a, b) structs of neighbouring tokens; shifted slices zipped,
    so no lambda captures the token expression."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    width = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, width), F.slice(t, 2, width),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def phrase_scores(sentences: DataFrame, tokens: str = "tokens", min_count: int = 30,
                  threshold: float = 10.0) -> DataFrame:
    """Bigram phrase detection with the original scorer:
    score = (n_ab - min_count) / (n_a * n_b) * V, V = distinct unigrams +
    distinct bigrams; keep score > threshold. Returns (a, b, n_ab, score)."""
    # one pass over the corpus: every position as (token, next token or null);
    # unigram and bigram counts both derive from this one aggregate, so the
    # branches below reuse its exchange instead of re-tokenising the text
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    nxt = F.concat(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    pos = F.zip_with(t, nxt, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    # a score above a threshold of 0 or more needs n_ab > min_count: only those rows are kept,
    # with their first word, so a row a word is stored instead of one for every pair
    ab = (sentences.select(F.explode(pos).alias("p"))
          .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n_ab")))
    likely = F.col("b").isNotNull() & (F.col("n_ab") > min_count if threshold >= 0 else F.lit(True))
    first = materialize(ab.groupBy("a").agg(
        F.sum("n_ab").alias("n"), F.count("b").alias("_nb"),
        F.collect_list(F.when(likely, F.struct("b", "n_ab"))).alias("next")))
    uni = first.select(F.col("a").alias("w"), "n")
    bi = first.select("a", F.inline("next"))
    # V as a one-row aggregate attached by a constant key (no driver round trip)
    v = first.agg(F.count(F.lit(1)).alias("_nu"), F.sum("_nb").alias("_nb")).select(
        F.lit(1).alias("_one"), (F.col("_nu") + F.col("_nb")).alias("_V"))
    ua = uni.select(F.col("w").alias("a"), F.col("n").alias("n_a"))
    ub = uni.select(F.col("w").alias("b"), F.col("n").alias("n_b"))
    scored = (bi.join(ua, "a").join(ub, "b").withColumn("_one", F.lit(1)).join(F.broadcast(v), "_one")
              .withColumn("score", (F.col("n_ab") - min_count).cast("double")
                          / (F.col("n_a") * F.col("n_b")) * F.col("_V")))
    return scored.where(F.col("score") > threshold).select("a", "b", "n_ab", "score")


def merge_phrases(df: DataFrame, phrases: DataFrame, doc_col: str = "doc_id",
                  tokens: str = "tokens", out_col: str = "merged") -> DataFrame:
    """Greedy left-to-right merge of accepted bigrams to ``a_b``. Phrase hits are found by
    a join on (a, b); where the phrases are few they go to the pairs (where there are more, their hashes), so only hits move. In a run of neighbouring hits every second one is taken, from the
    first on, which row numbers tell; the merged row is put together from the stretches
    between the places taken, so the work is linear in tokens and hits."""
    pairs = df.select(doc_col, F.posexplode(adjacent_pairs(tokens)).alias("i", "p")).select(
        doc_col, "i", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    accepted = materialize(phrases.select("a", "b").distinct())
    few = accepted.count()
    if SMALL_ROWS < few <= HASHED_ROWS:
        # hashes of the phrases go to the pairs, so hardly more than the hits move to the phrases
        hashed = F.xxhash64("a", "b").alias("_h")
        pairs = pairs.withColumn("_h", hashed).join(F.broadcast(accepted.select(hashed).distinct()), "_h", "left_semi").drop("_h")
    accepted = F.broadcast(accepted) if few <= SMALL_ROWS else accepted
    hits = pairs.join(accepted, ["a", "b"], "left_semi").select(doc_col, "i")
    run = hits.withColumn("_run", F.col("i") - F.row_number().over(Window.partitionBy(doc_col).orderBy("i")))
    nth = F.row_number().over(Window.partitionBy(doc_col, "_run").orderBy("i"))
    taken = (run.withColumn("_nth", nth).where(F.col("_nth") % 2 == 1)
             .groupBy(doc_col).agg(F.array_sort(F.collect_list("i")).alias("_taken")))
    j = df.join(taken, doc_col, "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))
    t, n = F.col(tokens), F.size("_taken")
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    j = evaluate_once(j.withColumn("_places", places), "_places")
    at = lambda k: F.element_at("_taken", k)

    def stretch(k: Column) -> Column:
        start = F.when(k == 1, 0).otherwise(F.get("_taken", k - 2) + 2)
        both = F.concat_ws("_", F.element_at(t, at(k) + 1), F.element_at(t, at(k) + 2))
        return F.concat(F.slice(t, start + 1, at(k) - start), F.array(both))
    done = F.when(n > 0, at(-1) + 2).otherwise(0)
    rest = F.slice(t, done + 1, F.greatest(F.size(t) - done, F.lit(0)))
    return j.withColumn(out_col, F.concat(F.flatten(F.transform("_places", stretch)), rest)).drop("_taken", "_places")
