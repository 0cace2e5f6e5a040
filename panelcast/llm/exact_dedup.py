"""Exact duplicates by deterministic block naming.

A text, with every run of white space made one space, is cut into blocks of a fixed size. Equal blocks get the same
integer name and different blocks different ones, by rank in sorted order. Names of adjacent blocks are then
paired and the pairs ranked in turn, level by level, until one name is left for every text. Texts are equal exactly
when they have equally many blocks and the same last name: blocks are compared as such, not by a hash that could collide.

How the work is dealt out: a task keeps one copy of every block it has seen (a bounded dictionary), so a group of
copies is shuffled once per task, not once per row. The rank is taken within `buckets` of blocks, each sorted by
itself; a bucket is chosen by hash, which spreads the work but never decides equality.
"""

from __future__ import annotations

from collections.abc import Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.tables import SPACES, absent, slices, small, tidied, with_group, without
from panelcast.session import cut_lineage, discard

BLOCK = 16_384  # characters
BUCKETS = 4_096  # at least; four a shuffle partition on larger clusters
DICTIONARY = 8 << 20  # bytes of blocks a task remembers before it starts anew
OUT = 4 << 20  # bytes of blocks in a batch of results, about
BLOCKS = "row long, id long, sha string, blocks int, pos int, like_row long, like_pos int, block string"


def _blocks(block: int, dictionary: int):
    """Rows of blocks; a block a task has seen before points at that one and brings no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        seen: dict[str, tuple[int, int]] = {}
        held = 0
        schema = pa.schema(
            [("row", pa.int64()), ("id", pa.int64()), ("sha", pa.string()), ("blocks", pa.int32()), ("pos", pa.int32()),
             ("like_row", pa.int64()), ("like_pos", pa.int32()), ("block", pa.string())]
        )
        def table(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        out, size = [[] for _ in schema], 0
        for batch in (part for whole in batches for part in slices(whole, "text", OUT)):
            ids, texts, shas = (batch.column(i) for i in range(3))
            for i in range(len(batch)):
                text = texts[i].as_py()
                count = max(1, -(-len(text) // block))
                for pos in range(count):
                    part = text if count == 1 else text[pos * block : (pos + 1) * block]
                    like = seen.get(part)
                    fresh = None
                    if like is None:
                        if held > dictionary:
                            seen, held = {}, 0
                        seen[part] = like = (row, pos)
                        held += getsizeof(part) + 120
                        size += getsizeof(part)
                        fresh = part
                    size += 100
                    values = (row, ids[i].as_py(), shas[i].as_py() if pos == 0 else None, count, pos, *like, fresh)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    if size > OUT:
                        yield table(out)
                        out, size = [[] for _ in schema], 0
                row += 1
        yield table(out)

    return run


def ranked(rows: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """`rows` with `name`, from 1: equal for equal `columns`, different for different ones."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*columns))
    return rows.withColumn("name", F.col("_bucket") * F.lit(1 << 40) + rank).drop("_bucket")


def _normal(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, buckets: int | None = None
) -> DataFrame:
    """One row per row of `docs`: id, keep_id (id of the row of its group that stays), group_size, kept,
    text_sha256 of the normalised text.

    Of equal texts the row with the smallest id stays; of repeated rows with that id, one. A null text counts as empty, empty
    texts are one group. A row with a null id stays only if its group has no other id. An empty table gives an empty
    result. Other columns are not read."""
    buckets = buckets or max(BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), _normal(text_col).alias("text")).withColumn("sha", F.sha2("text", 256))
    blocks = cut_lineage(texts.mapInArrow(tidied(_blocks(block, DICTIONARY)), BLOCKS))
    named = ranked(
        blocks.where("block is not null").select(F.col("row").alias("like_row"), F.col("pos").alias("like_pos"), "block"),
        ["block"],
        buckets,
    ).drop("block")
    level = cut_lineage(blocks.join(named, ["like_row", "like_pos"]).select("row", "id", "sha", "blocks", "pos", "name"))
    discard(blocks)  # all texts; their names are written
    done = level.where("blocks = 1").select("row", "id", "sha", "blocks", "name")
    level = level.where("blocks > 1")
    left = level.agg(F.max("blocks")).first()[0] or 1
    while left > 1:
        pairs = level.groupBy("row", "blocks", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max("id").alias("id"),
            F.max("sha").alias("sha"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("head"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("tail"),
        )
        names = ranked(pairs.select("head", "tail").distinct(), ["head", "tail"], buckets)
        level = cut_lineage(pairs.join(names, ["head", "tail"]).select("row", "id", "sha", "blocks", "pos", "name"))
        left = -(-left // 2)
    one = done.unionByName(level.select("row", "id", "sha", "blocks", "name"))
    one = one.withColumn("first", F.struct(F.col("id").isNull().alias("none"), "id", "row")).withColumn("each", F.lit(1).cast("long"))
    grouped = with_group(one, ["blocks", "name"], "row", {"stays": ("min", "first"), "size": ("sum", "each")})
    return grouped.select(
        F.col("id").alias(id_col),
        F.col("stays.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("stays.row") == F.col("row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that stay (see `exact_groups`). Where ids are unique, as they
    should be, only the ids that go are joined; where some repeat, id and text decide together, and of rows that agree in both one
    stays. A null text counts as empty, a null id is an id. Extra columns of any name stay as they are; an empty table gives an empty result."""
    found = cut_lineage(exact_groups(docs, id_col, text_col))
    if found.groupBy(id_col).count().where("count > 1").isEmpty():
        return without(docs, cut_lineage(found.where("not kept").select(id_col)), id_col)
    id_, sha, own = absent(docs, "id", "sha", "own_sha")
    stays = cut_lineage(found.where("kept").select(F.col(id_col).alias(id_), F.col("text_sha256").alias(sha)))
    both = docs.withColumn(own, F.sha2(_normal(text_col), 256))
    both = both.join(small(stays), both[id_col].eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha)), "left_semi")
    return both.dropDuplicates([id_col, own]).drop(own)
