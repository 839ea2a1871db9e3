"""Named queries of the training-data operators and their DuckDB oracles.

Each query is thin: it calls its operator over the whole table and derives the
digest columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import (ann, chat, langid, lexical, mixing, ngram_join, packing, pii, rules, secrets, sharding, warc,
                          whitening)
from textloom.llm.common import span_text, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


# --- production parameters ---------------------------------------------------

def tokenizer_ranks() -> str:
    """Rank file of the byte-level vocabulary (the same ids as ``byte_bpe_50k.json``)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Added tokens of ``byte_bpe_50k.json``, matched inside texts.
SPECIAL_TOKENS = {"<|endoftext|>": 50256}

#: Sources of the tree's top level; all others are "web".
CURATED = ("src1", "src2", "src3", "src4")
REFERENCE = ("src5", "src6", "src7")
MIX_WEIGHTS = {"web": 5.0, "curated": 3.0, "reference": 2.0,
               "web/en": 4.0, "curated/en": 2.0, "reference/en": 2.0, "web/en/src0": 2.0}


def mix_levels() -> dict:
    source = F.col("source")
    domain = (F.when(source.isin(*CURATED), "curated").when(source.isin(*REFERENCE), "reference")
              .otherwise("web"))
    return {"domain": domain, "lang": F.col("lang"), "source": source}


# --- queries -----------------------------------------------------------------

@_query("op1_disclosure_sanitising")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.sanitise_spans(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *[f"n_{k}" for k in pii.KINDS],
                      F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


_RECORD_SQL = """
  SELECT page_id, 'part-' || CAST(page_id // 500 AS VARCHAR) AS file, url, html,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS payload,
         md5('replica|' || CAST(page_id AS VARCHAR)) AS h
  FROM pages"""


@_query("op2_merkle_fixity", f"""
WITH r AS ({_RECORD_SQL}),
n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page_id) AS no,
             sum(strlen(payload)) OVER (PARTITION BY file ORDER BY page_id) - strlen(payload) AS byte_at FROM r)
SELECT file, CAST(no AS BIGINT) AS record_no, CAST(byte_at AS BIGINT) AS byte_offset,
       CASE WHEN h < '08' THEN 'corrupt' ELSE 'missing' END AS status, sha256(payload) AS expected,
       CASE WHEN h < '08' THEN sha256(replace(payload, 'e', 'E')) END AS found
FROM n WHERE h < '0c' AND (h >= '08' OR payload <> replace(payload, 'e', 'E'))""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 500 page ids as record files, against a replica in which records picked by
    a hash of the id are altered in place or lost."""
    line = "\r\n"
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("part-"), F.expr("cast(page_id div 500 as string)")).alias("file"),
        F.concat(F.lit(f"WARC/1.0{line}WARC-Target-URI: "), url, F.lit(f"{line}Content-Length: "),
                 F.octet_length(html).cast("string"), F.lit(line * 2), html, F.lit(line * 2)).alias("payload"))
    by_id = Window.partitionBy("file").orderBy("page_id", "payload")
    size = F.octet_length("payload").cast("long")
    upto = by_id.rowsBetween(Window.unboundedPreceding, 0)
    records = pages.select("page_id", "file", F.row_number().over(by_id).cast("long").alias("no"),
                           (F.sum(size).over(upto) - size).alias("offset"), "payload")
    h = F.md5(F.concat(F.lit("replica|"), F.col("page_id").cast("string")))
    copy = records.where(h.isNull() | (h < "08") | (h >= "0c")).withColumn(
        "payload", F.when(h < "08", F.replace("payload", F.lit("e"), F.lit("E"))).otherwise(F.col("payload")))
    return warc.audit(records, copy).select("file", F.col("no").alias("record_no"), F.col("offset").alias("byte_offset"),
                                            "status", "expected", "found")


_CHAT_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT *, CASE WHEN md5('pair|' || CAST(conv_id AS VARCHAR)) < '8'
                     THEN max(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id)
                     ELSE min(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) END AS cut FROM t),
b AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' AND turn >= cut
             THEN substr(text, 1, length(text) // 2) ELSE text END AS other,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM d),
c AS (SELECT *, min(CASE WHEN text = other THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS common,
             '<|' || role || '|>' || chr(10) AS head FROM b),
l AS (SELECT *, head || text || '<|end|>' || chr(10) AS al, head || other || '<|end|>' || chr(10) AS bl FROM c),
s AS (SELECT *, sum(CASE WHEN common = 0 THEN length(al) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos)
                - length(al) + length(head) AS sa,
             sum(CASE WHEN common = 0 THEN length(bl) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos)
                - length(bl) + length(head) AS sb FROM l)
SELECT conv_id AS pair_id, CAST(sum(common) AS BIGINT) AS n_common,
       coalesce(string_agg(al, '' ORDER BY pos) FILTER (WHERE common = 1), '') AS prompt,
       coalesce(string_agg(al, '' ORDER BY pos) FILTER (WHERE common = 0), '') AS chosen,
       coalesce(string_agg(CAST(CAST(sa AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(sa AS BIGINT) + length(text) AS VARCHAR), ','
                ORDER BY pos) FILTER (WHERE common = 0 AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(bl, '' ORDER BY pos) FILTER (WHERE common = 0), '') AS rejected,
       coalesce(string_agg(CAST(CAST(sb AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(sb AS BIGINT) + length(other) AS VARCHAR), ','
                ORDER BY pos) FILTER (WHERE common = 0 AND role = 'assistant'), '') AS rejected_spans
FROM s GROUP BY conv_id"""


@_query("op3_preference_pairs", _CHAT_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is the chosen side; in the rejected one the assistant answers are
    cut to half from the first or the last of them on, as a hash of the id decides."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    spoken = F.when(F.col("role") == "assistant", F.col("turn"))
    whole = Window.partitionBy("pair_id")
    cut = F.when(F.md5(F.concat(F.lit("pair|"), F.col("pair_id").cast("string"))) < "8",
                 F.max(spoken).over(whole)).otherwise(F.min(spoken).over(whole))
    half = F.col("text").substr(F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    rejected = turns.withColumn("cut", cut).withColumn("text", F.when(
        (F.col("role") == "assistant") & (F.col("turn") >= F.col("cut")), half).otherwise(F.col("text"))).drop("cut")
    return chat.format_pairs(turns, rejected)


@_query("op4_learned_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[F.col(f"__{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


@_query("op5_ngram_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.linked(table(spark, sf_dir, "documents"))
    return ngram_join.component_ids(found).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                                  F.col("links").alias("n_links"))


@_query("op6_inverted_multi_index")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0)


@_query("op7_power_of_two_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_ranks(), special=SPECIAL_TOKENS)


@_query("op8_hierarchical_mixture")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS)
    return got.select("doc_id", F.col("__l_domain").alias("domain"), "lang", "source",
                      F.col("__epoch").cast("int").alias("epoch"), F.col("__tokens").alias("tokens"))


@_query("op9_linked_secrets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, out="s").select("doc_id", "s")
    base = F.filter("s", lambda x: x["base"])
    return found.select(
        "doc_id", *[secrets.of_kind(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("s")).alias("spans"),
        F.size(F.filter("s", lambda x: ~x["base"])).cast("long").alias("n_linked"))


@_query("op10_best_fit_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@_query("op11_spectrum_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@_query("op12_kneser_ney_language")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose hash of the id leaves 2 are held out, the others teach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    got = langid.identify(docs, fold != 2)
    return got.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted")


_SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d1 AS (SELECT * FROM d WHERE len(ts) > 0),
s AS (SELECT count(*) AS n, sum(len(ts)) AS l FROM d1),
i AS (SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS k FROM i GROUP BY ALL),
p AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d1),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(s.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM f, s GROUP BY term),
c AS (SELECT r, doc_id, f.term, w * ((1000000000 * tf) // (1000 * tf + 12 * CAST(75 + (25 * f.n * s.n) // s.l AS BIGINT))) AS c
      FROM f JOIN w USING (term), s),
t AS (SELECT item_id, r, doc_id, CAST(sum(k * c) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM t WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20"""


@_query("op13_geometric_block_search", _SEARCH_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
