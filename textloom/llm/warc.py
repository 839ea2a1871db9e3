"""Merkle fixity audit of replicated record files.

Every record of a file is hashed; records whose first byte lies in one range of
offsets form a leaf range; ranges are hashed in order, ``fanout`` neighbours make a
node, and so on up to the root of the file. File roots hang in a tree over the hash
of the file name, up to one root for the replica. An audit compares roots and goes
down only from nodes that differ, level by level, to the records that are corrupt,
missing or extra. Both replicas' trees are built side by side, so each level is one
aggregate. Only the record hashes touch the payloads.

Group sizes are bounded: a range by its bytes, a node by the fan-out, a bucket of
names by the hash. Defined cases: null payloads are hashed as empty; a null file name
is a file of its own; records of a file without an offset form a range of their own,
below nodes of their own up to the file; rows repeated whole count once, and several rows with one record
number are hashed together in order; empty replicas have no root, so everything in the
other one is missing or extra.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

RANGE_BYTES = 64 * 1024
FANOUT = 16
#: Hex digits of md5(file) that name the nodes above the file roots.
NAME_LEVELS = (4, 2, 0)


def record_hashes(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """file, no, offset and the hash of each record in both copies (null where it lacks),
    from rows (file, no, offset, payload)."""
    def hashed(records: DataFrame, side: int) -> DataFrame:
        h = F.sha2(F.coalesce(F.col("payload").cast("binary"), F.lit(b"")), 256)
        return records.select(F.coalesce("file", F.lit("")).alias("file"), "no", "offset",
                              F.lit(side).alias("side"), h.alias("h")).distinct()

    def of(side: int) -> Column:
        own = F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("h"))))
        return F.when(F.size(own) > 0, F.array_join(own, ""))
    rows = hashed(primary, 0).unionByName(hashed(replica, 1))
    return materialize(rows.groupBy("file", "no").agg(
        F.min("offset").alias("offset"), of(0).alias("expected"), of(1).alias("found")))


def _up(level: DataFrame, parent: list[str], order: str) -> DataFrame:
    """The parents of a level: in each copy, the hash of its children in ``order``."""
    def of(side: str) -> Column:
        own = F.sort_array(F.collect_list(F.when(F.col(side).isNotNull(), F.struct(
            F.col(order).alias("o"), F.col(side).alias("h")))))
        return F.when(F.size(own) > 0, F.sha2(F.array_join(F.transform(
            own, lambda x: F.concat_ws(":", x["o"].cast("string"), x["h"])), ","), 256))
    up = level.groupBy(*parent).agg(of("expected").alias("expected"), of("found").alias("found"))
    return materialize(up.withColumnsRenamed({p: p.removeprefix("p_") for p in parent}))


def merkle_levels(hashes: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[tuple[DataFrame, list[str]]]:
    """Levels from the records up to the root, each with the columns that name the parent
    of a node. Both copies stand side by side: ``expected`` and ``found``."""
    last = hashes.agg(F.max("offset")).first()[0] or 0
    level = hashes.withColumn("p_node", F.floor(F.col("offset") / range_bytes).cast("long"))
    parent, order, nodes, levels = ["file", "p_node"], "no", last // range_bytes, []
    while True:
        levels.append((level, parent))
        level = _up(level, parent, order)
        if not nodes:
            break
        nodes, order = nodes // fanout, "node"
        level = level.withColumn("p_node", F.floor(F.col("node") / fanout).cast("long"))
    # one node is left of each file, its root
    level, order = level.withColumn("p_name", F.substring(F.md5(F.col("file").cast("binary")), 1, NAME_LEVELS[0])), "file"
    for shorter in NAME_LEVELS[1:]:
        levels.append((level, ["p_name"]))
        level, order = _up(level, ["p_name"], order), "name"
        level = level.withColumn("p_name", F.substring("name", 1, shorter))
    levels.append((level, ["p_name"]))
    return [*levels, (_up(level, ["p_name"], order), [])]


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """file, no, offset, status (corrupt, missing, extra), expected and found hash of
    every record of ``primary`` and ``replica`` (file, no, offset, payload) that differs."""
    levels = merkle_levels(record_hashes(primary, replica), range_bytes, fanout)
    bad = None
    for level, parent in reversed(levels):
        if bad is not None:                      # only the children of nodes that differ
            above = bad.select(*[F.col(p.removeprefix("p_")).alias(f"__{p}") for p in parent])
            level = level.join(above, reduce(and_, [F.col(p).eqNullSafe(F.col(f"__{p}")) for p in parent]), "left_semi")
        bad = level.where(~F.col("expected").eqNullSafe(F.col("found")))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    return bad.select("file", "no", "offset", status.alias("status"), "expected", "found")
