"""Power-of-two decomposition of documents into training sequences.

Each document is tokenized, gets the end id, and its length is written in binary:
as many pieces of the full window as fit, then one piece for each set bit of the
rest, longest first. Every piece is a sequence of its own, so no sequence crosses
documents; sequences of equal length form a bucket, and none needs padding.

Tokenizing runs in Arrow batches on whole texts, with the rank file of the vocabulary.
``special`` names the added tokens of the vocabulary (text -> id): each is one id
wherever it stands in a text, as ``tokenizers`` has it by default. Without it such
strings are ordinary text (``encode_special_tokens``).

Defined cases: null text counts as empty; an empty text is the end id alone;
repeated rows are packed each on its own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 1024
_ENCODERS: dict[tuple, Callable[[str], bytes]] = {}
PIECES = "array<struct<start:long,length:long,ids_crc32:long>>"


def encoder(ranks_path: str, special: dict[str, int] | None = None) -> Callable[[str], bytes]:
    """Text -> little-endian unsigned 32-bit ids; one encoder in each worker."""
    special = special or {}
    key = (ranks_path, *sorted(special.items()))
    if key not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens=special)
        names = set(special)

        def encode(text: str) -> bytes:
            if any(name in text for name in names):
                return array("I", bpe.encode(text, allowed_special=names, disallowed_special=())).tobytes()
            return array("I", bpe.encode_ordinary(text)).tobytes()
        _ENCODERS[key] = encode
    return _ENCODERS[key]


def piece_lengths(n: int, window: int = WINDOW) -> list[int]:
    """Full windows, then the powers of two of the rest, longest first."""
    lengths = [window] * (n // window)
    rest = n % window
    return lengths + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces_column(ranks_path: str, window: int = WINDOW, end_id: int = 0, special: dict[str, int] | None = None):
    """Column function: text -> its pieces (start, length, crc of the ids)."""
    end = int(end_id).to_bytes(4, "little")

    @F.pandas_udf(PIECES)
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(ranks_path, special)
        for batch in texts:
            out = []
            for text in batch:
                ids = encode(text or "") + end
                row, at = [], 0
                for k in piece_lengths(len(ids) // 4, window):
                    row.append({"start": at, "length": k, "ids_crc32": zlib.crc32(ids[4 * at:4 * (at + k)])})
                    at += k
                out.append(row)
            yield pd.Series(out, dtype=object)

    return pieces


def pack_documents(docs: DataFrame, ranks_path: str, window: int = WINDOW, end_id: int = 0,
                   n_buckets: int = 256, special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``window`` must be a power of two. Sequences of one length form a bucket:
    ``sequence_id % levels`` is the bucket's power of two. Within a bucket the
    sequences are numbered by hash partition, so ids are unique and one hot
    document or source doesn't gather in one task."""
    levels = window.bit_length()
    got = docs.select("doc_id", pieces_column(ranks_path, window, end_id, special)("text").alias("__p"))
    # the outer form: Spark adds a filter on the pieces below a plain explode, and with it
    # a second evaluation of the tokenizer (a document has at least its end id)
    flat = got.select("doc_id", F.explode_outer("__p").alias("__p"),
                      F.aggregate("__p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("doc_tokens"))
    flat = flat.select("doc_id", "__p.start", "__p.length", "__p.ids_crc32", "doc_tokens",
                       F.pmod(F.xxhash64("doc_id", "__p.start", "__p.ids_crc32"), F.lit(n_buckets)).alias("__b"))
    level = F.round(F.log2(F.col("length"))).cast("long")
    rn = F.row_number().over(Window.partitionBy("length", "__b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    seq = ((rn.cast("long") - 1) * n_buckets + F.col("__b")) * levels + level
    return flat.withColumn("sequence_id", seq).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.lit(0).cast("long").alias("offset"))
