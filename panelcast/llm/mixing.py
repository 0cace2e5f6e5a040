"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources; documents of the same set of sources form a pattern. Patterns are added up by
Spark, and only their sums reach the driver. There a flow carries words from the patterns to the quotas of their sources:
a pattern gives its words once for nothing, a second time at a cost, a third time at a higher one, and so on (convex), so
repetition is used only where a quota cannot be met otherwise, and is spread over the patterns that can help.

A pattern that must give x words of its c gives every document x div c times, and documents with x mod c words once more.
Those come in a seeded order of hashes: the words before a document are the sums of the hash ranges before its own and a
running sum within its own range, so no task sees a whole source. The order stops at the first document that would be too
much; what is missing then is filled the same way, a few times, from documents small enough to fit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.tables import absent, slices, small, tidied
from panelcast.llm.words import spans, text_bytes
from panelcast.session import cut_lineage

REPEATS = 2  # times a document is taken at most
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
FILLS = 4
RANGES = 4096
MOST = 1_000_000  # sources, and sets of sources, that the driver plans for; more are an error


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, bounds = text_bytes(part.column("text"))
            start, _ = spans(data)
            size = np.diff(np.searchsorted(start, bounds))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("sources"), pa.array(size, pa.int64())], ["id", "sources", "size"])


def targets(sizes: list[int], weights: list[float], total: float, repeats: int = REPEATS) -> list[float]:
    """`total` shared by weight; a target stops at `repeats` times its size, and what is above is shared anew by weight
    among the rest until none is above."""
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        share = {i: total * weights[i] / weight if weight else 0.0 for i in free}
        above = [i for i in free if share[i] > repeats * sizes[i]]
        if not above:
            for i in free:
                out[i] = share[i]
            break
        for i in above:
            out[i] = float(repeats * sizes[i])
        total = max(0.0, total - sum(out[i] for i in above))
        free = [i for i in free if i not in set(above)]
    return out


def flow(words: list[int], members: list[list[int]], quotas: list[int], repeats: int = REPEATS) -> list[int]:
    """Words to take of each pattern: a cheapest flow among the largest. words[p] may be given `repeats` times, the k-th time at
    k (k - 1) / 2 a word; members[p] are the quotas that a pattern may serve. Shortest augmenting paths with potentials."""
    patterns, sink = len(words), 1 + len(words) + len(quotas)
    graph: list[list[list[int]]] = [[] for _ in range(sink + 1)]  # [to, room, cost, place of the reverse edge]

    def edge(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, n in enumerate(words):
        for k in range(repeats):
            edge(0, 1 + p, n, k * (k + 1) // 2)
        for s in members[p]:
            edge(1 + p, 1 + patterns + s, n * repeats, 0)
    for s, quota in enumerate(quotas):
        edge(1 + patterns + s, sink, quota, 0)
    potential = [0] * (sink + 1)
    while True:
        far = [float("inf")] * (sink + 1)
        far[0], back, queue = 0, [None] * (sink + 1), [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for i, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and d + cost + potential[a] - potential[b] < far[b]:
                    far[b] = d + cost + potential[a] - potential[b]
                    back[b] = (a, i)
                    heapq.heappush(queue, (far[b], b))
        if back[sink] is None:
            break
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
        room, b = float("inf"), sink
        while b:
            a, i = back[b]
            room, b = min(room, graph[a][i][1]), a
        b = sink
        while b:
            a, i = back[b]
            graph[a][i][1] -= room
            graph[b][graph[a][i][3]][1] += room
            b = a
    return [sum(room for b, room, _, _ in graph[1 + p] if b == 0) for p in range(patterns)]


def _one_fill(rows: DataFrame, turn: int, seed: int) -> DataFrame:
    """Take once more, in seeded order, documents that fit what their pattern misses, up to the first that does not."""
    can = (~F.col("again")) & (F.col("size") > 0) & (F.col("size") <= F.col("missing"))
    order = F.xxhash64("id", "size", F.lit(seed), F.lit(turn))
    rows = rows.withColumn("_can", can).withColumn("_order", order).withColumn("_range", F.shiftrightunsigned("_order", 64 - RANGES.bit_length() + 1))
    sums = rows.where("_can").groupBy("pattern", "_range").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("pattern").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = small(cut_lineage(sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))))
    rows = rows.join(sums, ["pattern", "_range"], "left")
    inside = rows.where(F.col("_can") & (F.col("_before") + F.col("_words") > F.col("missing")) & (F.col("_before") < F.col("missing")))
    whole = F.col("_can") & (F.col("_before") + F.col("_words") <= F.col("missing"))
    cut = F.col("_can") & ~whole & (F.col("_before") < F.col("missing"))
    running = Window.partitionBy("pattern", "_range").orderBy("_order", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_take", F.col("_before") + F.sum("size").over(running) <= F.col("missing"))
    outside = rows.where(~F.coalesce(cut, F.lit(False))).withColumn("_take", F.coalesce(whole, F.lit(False)))
    both = cut_lineage(inside.unionByName(outside))
    got = both.where("_take").groupBy("pattern").agg(F.sum("size").alias("_got"))
    both = both.join(F.broadcast(got), "pattern", "left")  # a row a pattern
    return both.select(
        "id", "sources", "pattern", "size", "taken", (F.col("again") | F.col("_take")).alias("again"),
        (F.col("missing") - F.coalesce("_got", F.lit(0))).alias("missing"),
    )


def mixed(
    docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text",
    weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: int = 0,
) -> DataFrame:
    """id, `sources`, size (words), source_size and target (of the first of its sources) and taken (words, repeats counted)
    of every row. `sources` is an array of names; a null name is a source like any other, and an empty or null array is one
    of no quota, of which nothing is taken.

    Sources, by code point with null last, have the given weights in turn and share `budget` times all words. A null text
    has no words; an empty table gives an empty result. Repeated rows count each and share their fate up to one. Reruns agree."""
    names = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), names.alias("sources"), F.col(text_col).alias("text"))
    rows = cut_lineage(texts.mapInArrow(tidied(_sizes), "id long, sources array<string>, size long"))
    rows = rows.withColumn("pattern", F.to_json("sources"))
    patterns = rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("words"), F.count("*").alias("rows"))
    found = sorted(patterns.limit(MOST + 1).collect(), key=lambda r: r.pattern)
    every = sorted({s for r in found for s in r.sources}, key=lambda s: (s is None, s or ""))
    if len(found) > MOST or len(every) > MOST:
        raise ValueError(f"more than {MOST} sources or sets of sources: name fewer, larger ones")
    place = {s: i for i, s in enumerate(every)}
    sizes = [0] * len(every)
    for r in found:
        for s in r.sources:
            sizes[place[s]] += r.words
    total = budget * sum(r.words for r in found if r.sources)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(every))], total, repeats)
    taken = flow([r.words for r in found], [[place[s] for s in r.sources] for r in found], [round(g) for g in goal], repeats)
    plan = [
        (r.pattern, sizes[place[r.sources[0]]] if r.sources else 0, goal[place[r.sources[0]]] if r.sources else 0.0, x // max(r.words, 1), x % max(r.words, 1))
        for r, x in zip(found, taken, strict=True)
    ]
    spark = docs.sparkSession
    table = spark.createDataFrame(plan, "pattern string, source_size long, target double, times long, missing long")
    table = F.broadcast(table)  # as many rows as the driver planned for
    rows = rows.join(table.select("pattern", "times", "missing"), "pattern")
    rows = rows.select("id", "sources", "pattern", "size", (F.col("size") * F.col("times")).alias("taken"), F.lit(False).alias("again"), "missing")
    for turn in range(FILLS):
        rows = _one_fill(rows, turn, seed)
    rows = rows.join(table.select("pattern", "source_size", "target"), "pattern")
    return rows.select(
        F.col("id").alias(id_col), "sources", "size", "source_size", "target",
        (F.col("taken") + F.when(F.col("again"), F.col("size")).otherwise(0)).alias("taken"),
    )


def mixture(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, with all their columns, as often as the mix takes them. Rows of one id are taken as often as
    the one taken most; rows without words are not taken. A null text has no words, a null id is an id, a null source a source. Extra columns
    of any name stay as they are; an empty table gives an empty result."""
    id_, times, time = absent(docs, "id", "times", "time")
    found = mixed(docs, sources, id_col, text_col, **options).where("taken > 0")
    often = found.groupBy(F.col(id_col).alias(id_)).agg(F.max(F.expr("cast(taken div size AS int)")).alias(times))
    joined = docs.join(small(cut_lineage(often)), docs[id_col].eqNullSafe(F.col(id_)))
    return joined.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(id_, times, time)
