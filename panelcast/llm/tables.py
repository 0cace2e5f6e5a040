"""What several operators of this subpackage need from tables: rows of a group, sized broadcasts, batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
SALTS = 32  # parts that the rows of one group are dealt over
BROADCAST_ROWS = 1_000_000  # narrow rows (a few numbers) that may be sent to every task


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `limit` bytes of one text column, so that memory follows neither the batch
    size of the session nor the length of its other texts. One text is never cut."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    piece = (np.cumsum(size + 1) - 1) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(size)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Give memory that this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run`, after which the worker gives memory that it has freed back to the system. Workers are used again by later stages, whose
    needs would otherwise come on top of what earlier ones once held."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def with_group(rows: DataFrame, key: list[str], id_col: str, aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """`rows` with totals of their group: {name: (function, column)} with functions that may be applied to
    their own results (min, max, sum). A group may hold any share of the rows: it is added up within tasks, then by
    (key, salt), then by key, and the total goes back to the salts that occur, so no task gets the whole group."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
    part = salted.groupBy(*key, "_salt").agg(*[getattr(F, f)(c).alias(n) for n, (f, c) in aggregates.items()])
    whole = part.groupBy(*key).agg(
        *[getattr(F, f)(n).alias(n) for n, (f, _) in aggregates.items()], F.collect_set("_salt").alias("_salts")
    )
    back = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    left, right = salted.alias("l"), back.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*key, "_salt"]]
    joined = left.join(right, on)
    return joined.select(*[f"l.{c}" for c in rows.columns], *[f"r.{n}" for n in aggregates])


def small(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` (a written table of a few numbers a row) marked for broadcast if a count shows that they are few;
    otherwise as they are, for a join by shuffle."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def absent(docs: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes for `docs` to have no such column."""
    taken, lead = {c.lower() for c in docs.columns}, "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of `docs`, with all their columns, whose id is not among `dropped` (its only column). Ids may be null."""
    (name,) = absent(docs, "gone")
    return docs.join(small(dropped.toDF(name)), docs[id_col].eqNullSafe(F.col(name)), "left_anti")
