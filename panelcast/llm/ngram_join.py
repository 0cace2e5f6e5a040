"""Jaccard join of documents by their word n-grams, with adaptive multi-match prefixes.

Two sets x and y that link share at least ceil(t (|x| + |y|) / (1 + t)) n-grams, t being the similarity. So, in any order of
n-grams that both keep, the first |x| - ceil(t |x|) + 1 of x hold one that y shares within its own first ones; and prefixes
that are longer by l - 1 share at least l. Nothing that fails such a test can link, whatever l is.

1. Equal sets are one class, and one member of it goes on.
2. In the order of their hash values, every class writes its prefix for l of about an eighth of its size. N-grams that no other
   class has written are gone after one shuffle; classes left with fewer than l shared ones cannot link. This drops
   nearly all documents, without a look at the rest of their n-grams.
3. The rest write whole sets. N-grams that only one of them has cannot match; the others are ordered from rare to common.
   A class with fewer than ceil(t n) of them is gone. The others are listed under their shortest prefix. Each also takes a
   longer one: it chooses l by estimated cost, the entries to read against the candidates left to verify.
4. Classes listed under one n-gram are compared with one of them, its pivot: a candidate pair must share l n-grams of the longer
   prefixes (l: the smaller of the two) before its whole sets are compared. Links form components. Pairs that are in one
   component already add nothing, so most of a large group of near copies costs one comparison a member, not one a pair.
5. Classes that met one pivot and are still in different components are compared with one another, in blocks, the small components
   with all others: matches of one class with a whole block are counted at once, in the longer prefixes and then in
   the sets, and one link to each component is written.

So all links between different components are tested; a pair is left out only where it can't link or is connected already.
N-grams are named by 64-bit hashes, sets by 128-bit ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.components import components
from panelcast.llm.tables import slices, small, tidied, with_group, without
from panelcast.llm.words import shingles, words
from panelcast.session import cut_lineage, discard

WIDTH = 5
SIMILARITY = (3, 4)  # as a fraction
LONGEST_RUN = 1 << 20  # entries of one n-gram that are counted; more frequent ones rank alike
SEEN = 200_000  # set names that a task remembers
BLOCK = 2048  # rows that are compared with as many others in one go


def floor_of(n, similarity: tuple[int, int]):
    """ceil(t n): what a set of n shares at least with any set it links to."""
    up, down = similarity
    return -(-n * up // down)


def extension(n):
    """l - 1 in the first filter."""
    return n // 8


def low_prefix(n: int, similarity: tuple[int, int]) -> int:
    return min(n, n - floor_of(n, similarity) + 1 + extension(n))


def low_needed(n):
    """Shared n-grams that any link of a set of n has in both first prefixes, one less for rounding and never below 1."""
    return np.maximum(1, extension(n) - 1)


def sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    name, first = words(column)
    return shingles(name, first, width)


def _name(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _prefixes(width: int, similarity: tuple[int, int]):
    """Every row with its set's size and name, and the first prefix where the task meets the set anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = sets_of(part.column("text"), width)
                names = [_name(s) if len(s) else None for s in sets]
                low = []
                for s, name in zip(sets, names, strict=True):
                    if name is None or name in seen:
                        low.append(None)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    low.append(s[: low_prefix(len(s), similarity)].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(sets))),
                        part.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(names, pa.binary()),
                        pa.array(low, pa.list_(pa.int64())),
                    ],
                    ["row", "id", "n", "name", "low"],
                )
                row += len(sets)

    return run


def _whole(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = sets_of(part.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["name", "items"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by (item, owner), those of items with at least two owners, with the number of owners. Only the entries of
    the item at hand are held, and of those at most LONGEST_RUN."""
    held_item, held, emitted = None, [], 0

    def out(items, owners, owned):
        return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(owners, pa.int64()), pa.array(owned, pa.int64())], ["item", "owner", "owners"])

    for batch in batches:
        item, owner = np.asarray(batch.column("item")), np.asarray(batch.column("owner"))
        if not len(item):
            continue
        fresh = np.ones(len(item), dtype=bool)
        fresh[1:] = (item[1:] != item[:-1]) | (owner[1:] != owner[:-1])
        if held and held_item == item[0] and held[-1][-1] == owner[0]:
            fresh[0] = False
        item, owner = item[fresh], owner[fresh]
        if not len(item):
            continue
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        size = np.diff(np.append(first, len(item)))
        if held:  # the open item goes on or ends
            if held_item == item[0]:
                held.append(owner[: size[0]])
                item, owner, first, size = item[size[0] :], owner[size[0] :], first[1:] - size[0], size[1:]
            total = sum(map(len, held))
            if len(size) or total >= LONGEST_RUN:
                if emitted or total > 1:
                    own = np.concatenate(held)[1 if emitted else 0 :]
                    yield out(np.full(len(own), held_item), own, np.full(len(own), LONGEST_RUN if emitted or total >= LONGEST_RUN else total))
                if len(size):
                    held, emitted = [], 0
                else:
                    held, emitted = [held[-1][-1:]], 1  # its last owner stays, to see a repeated one
        if not len(size):
            continue
        last = first[-1]
        keep = np.repeat(size > 1, size)
        keep[last:] = False
        owned = np.repeat(size, size)
        if keep.any():
            yield out(item[keep], owner[keep], np.minimum(owned[keep], LONGEST_RUN))
        held_item, held, emitted = item[last], [owner[last:]], 0
    if held:
        own = np.concatenate(held)[1 if emitted else 0 :]
        if emitted or len(own) > 1:
            yield out(np.full(len(own), held_item), own, np.full(len(own), LONGEST_RUN if emitted else min(len(own), LONGEST_RUN)))


def shared_items(entries: DataFrame) -> DataFrame:
    """(item, owner, owners) of the entries (item, owner) whose item has several owners."""
    return entries.repartition("item").sortWithinPartitions("item", "owner").mapInArrow(tidied(_shared), "item long, owner long, owners long")


def match_length(owners: np.ndarray, base: int, n: int) -> int:
    """l of a set whose shared n-grams, in order, have these numbers of owners: least of the entries in the prefix, plus n
    for the verification of each of the candidates, at most entries / l, that share l of them."""
    entries = np.cumsum(owners)[base - 1 :].astype(float)
    length = np.arange(1, len(entries) + 1)
    return int(np.argmin(entries + n * entries / length)) + 1


def _ordered(similarity: tuple[int, int]):
    """From the shared n-grams of each set: their order, the shortest prefix and l."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, base, length = [], [], []
            for n, items in zip(batch.column("n").to_pylist(), batch.column("items"), strict=True):
                flat = items.values
                owners, item = np.asarray(flat.field("owners")), np.asarray(flat.field("item"))
                by = np.lexsort((item, owners))
                b = len(by) - floor_of(n, similarity) + 1
                orders.append(item[by])
                base.append(b)
                length.append(match_length(owners[by], b, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("owner"), batch.column("n"), pa.array(orders, pa.list_(pa.int64())), pa.array(base, pa.int64()), pa.array(length, pa.int64())],
                ["row", "n", "items", "base", "length"],
            )

    return run


def links(nx: int, ny: int, x: np.ndarray, y: np.ndarray, base: tuple[int, int], length: int, similarity: tuple[int, int]) -> bool:
    """Whether two sets of nx and ny n-grams, of which x and y are shared with others, link: first by `length` matches in their
    longer prefixes, then by all of them."""
    if length > 1:
        few = np.intersect1d(x[: base[0] + length - 1], y[: base[1] + length - 1], assume_unique=True)
        if len(few) < length:
            return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return similarity[1] * both >= similarity[0] * (nx + ny - both)


def _verify(similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {f: batch.column(f).to_pylist() for f in ("a", "b", "n_a", "n_b", "base_a", "base_b", "length_a", "length_b")}
            x, y = batch.column("items_a"), batch.column("items_b")
            good = [
                links(
                    column["n_a"][i], column["n_b"][i], np.asarray(x[i].values), np.asarray(y[i].values),
                    (column["base_a"][i], column["base_b"][i]), min(column["length_a"][i], column["length_b"][i]), similarity,
                )
                for i in range(len(batch))
            ]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that link."""
    fields = ("n", "items", "base", "length")
    a = sets.select(F.col("row").alias("a"), *[F.col(f).alias(f"{f}_a") for f in fields])
    b = sets.select(F.col("row").alias("b"), *[F.col(f).alias(f"{f}_b") for f in fields])
    return pairs.join(a, "a").join(b, "b").mapInArrow(tidied(_verify(similarity)), "a long, b long")


def _possible(similarity: tuple[int, int]):
    """Whether sizes and numbers of shared n-grams leave room for a link."""
    up, down = similarity
    return (F.least("m_a", "m_b") * (up + down) >= (F.col("n_a") + F.col("n_b")) * up) & (
        F.least("n_a", "n_b") * down >= F.greatest("n_a", "n_b") * up
    )


def _across(rows: dict[str, np.ndarray], similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between the rows that probe and the rows of other labels, one for each label a row links to.

    `rows` has the fields of FIELDS, with `items` flat and `first` where those of each row begin. Matches with all rows are counted at once,
    n-gram by n-gram: in the longer prefixes first, and over whole sets only for rows with candidates left."""
    up, down = similarity
    n, m, label = rows["n"], rows["m"], rows["label"]
    first, reach = rows["first"], rows["base"] + rows["length"] - 1
    owner = np.repeat(np.arange(len(n)), np.diff(first))
    place = np.arange(len(owner)) - first[owner]
    _, item = np.unique(rows["items"], return_inverse=True)
    item = item.ravel()

    def index(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.flatnonzero(keep)[np.argsort(item[keep], kind="stable")]
        return owner[order], np.searchsorted(item[order], np.arange(item.max(initial=-1) + 2))

    def matches(lists: tuple[np.ndarray, np.ndarray], items: np.ndarray) -> np.ndarray:
        owners, begin = lists
        size = begin[items + 1] - begin[items]
        at = np.repeat(begin[items] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(owners[at], minlength=len(n))

    low, whole = index(place < reach[owner]), index(np.ones(len(owner), dtype=bool))
    a, b = [], []
    for u in np.flatnonzero(rows["probes"]):
        mine = item[first[u] : first[u + 1]]
        fits = (label != label[u]) & (np.minimum(m, m[u]) * (up + down) >= (n + n[u]) * up)
        fits &= matches(low, mine[: reach[u]]) >= np.minimum(rows["length"], rows["length"][u])
        if not fits.any():
            continue
        both = matches(whole, mine)
        good = np.flatnonzero(fits & (down * both >= up * (n + n[u] - both)))
        good = good[np.unique(label[good], return_index=True)[1]]
        a += [rows["row"][u]] * len(good)
        b += rows["row"][good].tolist()
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


FIELDS = ("row", "n", "m", "base", "length", "label", "probes")


def _compare(similarity: tuple[int, int]):
    def group(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        rows = {f: table[f].to_numpy() for f in FIELDS}
        items = table["items"].combine_chunks()
        rows["items"] = np.asarray(items.flatten())
        rows["first"] = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(items)))]).astype(np.int64)
        a, b = _across(rows, similarity)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_ = [], None
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([np.asarray(batch.column(f)) for f in ("pivot", "some", "other")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(key[:, a]) != open_:
                    yield group(held)
                    held = []
                open_ = tuple(key[:, a])
                held.append(batch.slice(a, b - a))
        if held:
            yield group(held)

    return run


def _connected(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame | None:
    """(node, label) of the sets that link to others; None if there are none."""
    size = F.size("items").cast("long").alias("m")
    lists = sets.select("row", "n", size, F.explode(F.expr("slice(items, 1, cast(base AS int))")).alias("item"))
    best = F.struct((F.col("m") / F.col("n")).alias("share"), (-F.col("row")).alias("first"), "n", "m")
    pivots = lists.groupBy("item").agg(F.count("*").alias("many"), F.max(best).alias("best")).where("many > 1")
    pivots = pivots.select("item", (-F.col("best.first")).alias("b"), F.col("best.n").alias("n_b"), F.col("best.m").alias("m_b"))
    met = lists.select("item", F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("m").alias("m_a")).join(pivots, "item")
    met = cut_lineage(met.drop("item").distinct())  # which sets are listed with which pivot
    pairs = met.where("a <> b").where(_possible(similarity)).select("a", "b")
    edges = cut_lineage(_verified(pairs, sets, similarity))
    labels = components(edges)
    # sets of one pivot that are in different components, against all others of that pivot
    group = met.select(F.col("b").alias("pivot"), F.col("a").alias("row")).join(small(labels.withColumnRenamed("node", "row")), "row", "left")
    group = group.withColumn("label", F.coalesce("label", "row"))
    by_label = group.groupBy("pivot", "label").agg(F.count("*").alias("many"))
    main = by_label.groupBy("pivot").agg(F.max(F.struct("many", "label")).alias("main"), F.sum("many").alias("many"), F.count("*").alias("labels"))
    main = small(cut_lineage(main.where("labels > 1").select("pivot", F.col("main.label").alias("main"), "many")))
    group = group.join(main, "pivot").withColumn("probes", F.col("label") != F.col("main"))
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    group = group.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    # a probing row meets every block, any row meets the probing rows of every block
    asks = group.where("probes").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumnRenamed("block", "some")
    there = group.withColumn("some", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumnRenamed("block", "other")
    there = there.withColumn("probes", F.lit(False))
    keys = ["pivot", "some", "other"]
    group = asks.select(*keys, "row", "label", "probes").unionByName(there.select(*keys, "row", "label", "probes"))
    group = group.join(sets.withColumn("m", size), "row").repartition(*keys).sortWithinPartitions(*keys, "row")
    more = cut_lineage(group.mapInArrow(tidied(_compare(similarity)), "a long, b long"))
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    return None if labels.isEmpty() else labels


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """One row per row of `docs`: id, n_shingles (distinct n-grams; a text of fewer than `width` words has its whole
    sequence as one, a text without words none) and component_id, the smallest id that links reach.

    Rows without words link with nothing, not even one another. Repeated rows are members of one class. Null ids are
    passed over by the minimum; a component of null ids only has a null one. Other columns are not read."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = cut_lineage(texts.mapInArrow(tidied(_prefixes(width, similarity)), "row long, id long, n long, name binary, low array<long>"))
    brief = F.xxhash64("name")
    entries = rows.where("low is not null").select(F.explode("low").alias("item"), brief.alias("owner"))
    met = shared_items(entries).groupBy("owner").agg(F.count("*").alias("met"))
    member = with_group(rows.where("n > 0").select("row", "id", "n", "name"), ["name"], "row", {"rep": ("min", "row"), "least": ("min", "id")})
    member = cut_lineage(member)
    reps = member.where("row = rep").withColumn("owner", F.xxhash64("name"))
    needed = F.greatest(F.lit(1), F.expr("n div 8") - 1)  # low_needed
    left = cut_lineage(reps.join(met, "owner").where(F.col("met") >= needed).select("row", "least", "n", "name"))
    wanted = small(cut_lineage(left.select(F.col("least").alias("_id")).distinct()))
    again = texts.join(wanted, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    whole = again.mapInArrow(tidied(_whole(width)), "name binary, items array<long>").join(left, "name").select("row", "n", "items")
    whole = cut_lineage(whole.dropDuplicates(["row"]))
    common = shared_items(whole.select(F.explode("items").alias("item"), F.col("row").alias("owner")))
    gathered = common.groupBy("owner").agg(F.collect_list(F.struct("item", "owners")).alias("items"))  # one text's own
    floor = F.expr(f"(n * {similarity[0]} + {similarity[1] - 1}) div {similarity[1]}")
    gathered = gathered.join(whole.select(F.col("row").alias("owner"), "n"), "owner").where(F.size("items") >= floor)
    sets = cut_lineage(gathered.mapInArrow(tidied(_ordered(similarity)), "row long, n long, items array<long>, base long, length long"))
    discard(whole)  # sets have the n-grams that matter
    labels = _connected(sets, similarity)
    if labels is None:
        member = member.withColumn("component_id", F.col("least"))
    else:
        linked = labels.join(reps.select(F.col("row").alias("node"), "least"), "node")
        linked = with_group(linked, ["label"], "node", {"lowest": ("min", "least")}).select(F.col("node").alias("rep"), "lowest")
        member = member.join(small(cut_lineage(linked)), "rep", "left").withColumn("component_id", F.coalesce("lowest", "least"))
    out = member.select("id", "n", "component_id").unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose id is the smallest of its component. Rows of one id share their fate:
    they stay if one of them does."""
    found = similar_groups(docs, id_col, text_col)
    stays = F.max(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("stays")
    return without(docs, cut_lineage(found.groupBy(id_col).agg(stays).where("not stays").select(id_col)), id_col)
