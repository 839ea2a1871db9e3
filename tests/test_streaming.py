"""The cleaning stream produces the same rows as the batch cleaner."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.streaming.clean_stream import run_clean_stream

SF = "/root/testdata/sf0.001"


def test_clean_stream_equals_batch(spark):
    out = tempfile.mkdtemp(prefix="textloom-stream-")
    os.makedirs(f"{out}/in")
    shutil.copy(f"{SF}/documents.parquet", f"{out}/in/part-0.parquet")
    q = run_clean_stream(spark, f"{out}/in", f"{out}/sink", checkpoint=f"{out}/ckpt")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{out}/sink")
    want = (spark.read.parquet(f"{SF}/documents.parquet")
            .select("doc_id", "lang", T.clean_note("text").alias("text")).where(F.col("text").isNotNull()))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
