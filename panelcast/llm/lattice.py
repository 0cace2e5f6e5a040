"""Near-duplicate embeddings by lattice hashing.

In every table a random projection takes a unit vector to eight dimensions, where it is decoded to the nearest point of the E8
lattice; that point is its cell. A vector lives in its own cell and also probes the neighbouring cells whose centres are
nearest to it, of the 240 around its own. Two vectors meet where one lives and the other lives or probes; pairs that meet
are compared by cosine in double precision.

A pair that meets several times counts once: every vector carries its cells, so whoever compares a pair sees whether it
has met in an earlier table. Equal vectors are one class with a number of copies. A cell gives out, for each member, its
number of links and one edge to a member of its component, never its pairs; a crowded cell is cut into blocks, which are
compared two by two in separate tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.components import components
from panelcast.llm.tables import with_group
from panelcast.llm.words import GOLD, mixed
from panelcast.session import cut_lineage

LEAST = 0.93
TABLES = 6
PROBES = 8
WIDTH = 1.0  # edge of a cell against the length of a projected unit vector in one dimension
BLOCK = 1024


def _minimal() -> np.ndarray:
    """The 240 shortest lattice vectors: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    pairs = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            pairs.append(v)
    halves = [np.array(s) / 2 for s in itertools.product((-1.0, 1.0), repeat=8) if s.count(-1.0) % 2 == 0]
    return np.array(pairs + halves)


MINIMAL = _minimal()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where the sum is odd, the entry rounded the farthest goes the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    at = np.abs(off[odd]).argmax(axis=1)
    near[odd, at] += np.where(off[odd, at] >= 0, 1.0, -1.0)
    return near


def decoded(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: even integer points, or those shifted by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def _cell(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit name of each lattice point; a chance collision only makes a pair be compared."""
    name = salt.astype(np.uint64)
    for k in range(8):
        name = mixed((name ^ np.rint(points[..., k] * 2).astype(np.int64).view(np.uint64)) + GOLD)
    return name.view(np.int64)


def signature(unit: np.ndarray, label: np.ndarray, tables: int, probes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (vector, table) and probed cells (vector, table, probe) of unit vectors of one length."""
    size = unit.shape[1]
    rng = np.random.default_rng([seed, size])
    own, near = [], []
    for t in range(tables):
        x = unit @ rng.standard_normal((size, 8)) / width + rng.uniform(0, 2, 8)
        point = decoded(x)
        salt = mixed(label.astype(np.int64).view(np.uint64) * GOLD + np.uint64(t * 1_000_003 + size))
        own.append(_cell(point, salt))
        best = np.argsort(-((x - point) @ MINIMAL.T), axis=1, kind="stable")[:, :probes]
        near.append(_cell(point[:, None, :] + MINIMAL[best], salt[:, None]))
    return np.stack(own, axis=1), np.stack(near, axis=1)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(batch))), *batch.columns], ["row", *batch.schema.names])
        row += len(batch)


def _signed(tables: int, probes: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            length = np.asarray(pa.compute.list_value_length(vectors))
            for size in np.unique(length):
                part = pa.RecordBatch.from_arrays([c.filter(pa.array(length == size)) for c in batch.columns], batch.schema.names)
                flat = np.asarray(part.column("vector").flatten(), dtype=np.float64).reshape(-1, size)
                unit = flat / np.linalg.norm(flat, axis=1, keepdims=True)
                own, near = signature(unit, np.asarray(part.column("label")), tables, probes, width, seed)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a[0].size).cast(pa.list_(pa.int64())) for a in (own, near)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*batch.schema.names, "own", "near"])

    return run


def met(own: np.ndarray, near: np.ndarray, u: np.ndarray, v: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By pair, in one table: whether both live in one cell, v lives where u probes, u lives where v probes."""
    a, b = own[u, table], own[v, table]
    return a == b, (near[u, table] == b[:, None]).any(axis=1), (near[v, table] == a[:, None]).any(axis=1)


def cell_links(
    row: np.ndarray, unit: np.ndarray, copies: np.ndarray, own: np.ndarray, near: np.ndarray,
    lives: np.ndarray, block: np.ndarray, across: bool, table: int, least: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Of the members of one cell: the links each has that no other cell counts, copies included, and a member of its component
    each. `across`: two blocks are compared with one another only."""
    home = np.flatnonzero(lives)
    u, v = np.nonzero(unit[home] @ unit.T >= least)
    u = home[u]
    good = np.where(lives[v], u < v, u != v)
    if across:
        good &= block[u] != block[v]
    u, v = u[good], v[good]
    for earlier in range(table):
        same, forth, back = met(own, near, u, v, earlier)
        u, v = u[~(same | forth | back)], v[~(same | forth | back)]
    # in this table, of two cells where the pair meets, the home of the smaller row counts
    same, forth, back = met(own, near, u, v, table)
    good = np.where(same, lives[u] & lives[v], ~(forth & back) | (lives[u] == (row[u] < row[v])))
    u, v = u[good], v[good]
    links = np.bincount(u, weights=copies[v], minlength=len(row)) + np.bincount(v, weights=copies[u], minlength=len(row))
    label = np.arange(len(row))
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if (low == label).all():
            return links.astype(np.int64), row[label]
        label = low


def _compare(least: float, tables: int, probes: int):
    fields = ("cell", "first", "second", "t", "row", "lives", "block", "copies")

    def group(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(held).combine_chunks()
        if len(rows) < 2:
            return None
        column = {f: rows[f].to_numpy() for f in fields}
        flat = np.asarray(rows["vector"].combine_chunks().flatten(), dtype=np.float64)
        size = len(flat) // len(rows)
        if size * len(rows) != len(flat) or (np.asarray(pa.compute.list_value_length(rows["vector"])) != size).any():
            return None  # a chance collision of cells of vectors of different lengths
        unit = flat.reshape(-1, size)
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        own = np.asarray(rows["own"].combine_chunks().flatten()).reshape(-1, tables)
        near = np.asarray(rows["near"].combine_chunks().flatten()).reshape(-1, tables, probes)
        links, root = cell_links(column["row"], unit, column["copies"], own, near, column["lives"].astype(bool), column["block"], column["first"][0] != column["second"][0], int(column["t"][0]), least)
        some = links > 0
        if not some.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(column["row"][some]), pa.array(links[some]), pa.array(root[some])], ["row", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_ = [], None
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([np.asarray(batch.column(f)) for f in ("cell", "first", "second", "t")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(key[:, a]) != open_:
                    out = group(held)
                    held = []
                    if out is not None:
                        yield out
                open_ = tuple(key[:, a])
                held.append(batch.slice(a, b - a))
        if held and (out := group(held)) is not None:
            yield out

    return run


def near_copies(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST,
    tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, seed: int = 7, block: int = BLOCK,
) -> DataFrame:
    """One row per row of `vectors`: id, n_links (other rows of equal label found with cosine >= `least`), component_id
    (smallest id that links reach) and kept (the row stands for its component).

    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite values, link with nothing; so do vectors
    of different lengths. Equal vectors of a label link with one another. Of repeated rows with the smallest id one is kept. Null
    ids are passed over by the minimum. Every pair reported is verified; pairs are found with the recall that `tables`, `probes` and
    `width` give. Other columns are not read."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = cut_lineage(rows.mapInArrow(_numbered, "row long, id long, label long, vector array<double>"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    each = F.lit(1).cast("long")
    good = with_group(rows.where(usable).withColumn("each", each), ["label", "vector"], "row", {"rep": ("min", "row"), "copies": ("sum", "each")})
    good = cut_lineage(good)
    kind = "row long, label long, vector array<double>, copies long, own array<long>, near array<long>"
    signed = cut_lineage(good.where("row = rep").select("row", "label", "vector", "copies").mapInArrow(_signed(tables, probes, width, seed), kind))
    lives = signed.select("row", F.lit(1).alias("lives"), F.posexplode("own").alias("t", "cell"))
    probing = signed.select("row", F.lit(0).alias("lives"), F.posexplode("near").alias("t", "cell"))
    cells = cut_lineage(lives.unionByName(probing.withColumn("t", F.expr(f"t div {probes}").cast("int"))))
    busy = cells.groupBy("cell", "t").agg(F.count("*").alias("n"), F.max("lives").alias("home")).where("n > 1 AND home = 1")
    members = cells.join(busy.select("cell", "t", "n"), ["cell", "t"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    members = members.select("cell", "t", "first", "second", "row", "lives", "block").join(signed.drop("label"), "row")
    members = members.repartition("cell", "t", "first", "second").sortWithinPartitions("cell", "t", "first", "second")
    found = cut_lineage(members.mapInArrow(_compare(least, tables, probes), "row long, links long, root long"))
    links = found.groupBy("row").agg(F.sum("links").alias("links")).withColumnRenamed("row", "rep")
    joined = components(found.select(F.col("row").alias("a"), F.col("root").alias("b"))).toDF("rep", "label")
    good = good.select("row", "id", "rep", "copies").join(links, "rep", "left").join(joined, "rep", "left")
    good = good.select(
        "row", "id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "rep").alias("node")
    )
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    good = with_group(good.withColumn("order", order), ["node"], "row", {"stays": ("min", "order")})
    good = good.select("id", "n_links", F.col("stays.id").alias("component_id"), (F.col("stays.row") == F.col("row")).alias("kept"))
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return good.unionByName(alone).withColumnRenamed("id", id_col)
