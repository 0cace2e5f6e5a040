"""Boosted trees of series that are too long for one task.

The features of a series are binned at values that a sketch of its training rows gives, and its rows are written as chunks of bin codes. A tree
grows level by level: one pass over the chunks adds up, for every open leaf and feature, a histogram of what its rows still miss of
their target; the histograms of a feature meet in one task, whatever the number of rows, and only the best split comes back to the driver. All
series of a group grow in the same passes, and so do no more than GROUP models at a time.

Trees that grow leaf by leaf, the best first, are the part of the tree grown level by level that has the best splits: levels are added as long as
a leaf that may still be chosen has no split yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.boosting import BINS, SAME, Preset
from panelcast.operators.features import SLOTS
from panelcast.session import cut_lineage

GROUP = 64  # series whose models the driver holds at a time
CHUNK = 4096  # rows of a chunk
ACCURACY = 1_000_000  # of the sketch that gives the bins: exact for series of fewer rows
KEPT = 10  # trees after which predictions are written
WIDTH = BINS + 2  # codes of a feature, and one place for missing values
FORECAST = "series_id string, model_name string, step int, predicted double"


@dataclass
class Tree:
    """Node k sends codes up to code[k] of feature[k] to left[k]; a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    code: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    # of a node as a leaf: rows, sum of what is missing, gain of its best split (None: not looked at), depth
    rows: list[int] = field(default_factory=lambda: [0])
    sums: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float | None] = field(default_factory=lambda: [None])
    depth: list[int] = field(default_factory=lambda: [0])

    def child(self, depth: int, rows: int, sums: float) -> int:
        for name, x in zip(("feature", "code", "missing_left", "left", "right", "value", "rows", "sums", "gain", "depth"),
                           (-1, 0, False, -1, -1, 0.0, rows, sums, None, depth), strict=True):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def leaves(self, code: np.ndarray) -> np.ndarray:
        """The leaf of every row of codes, missing ones in the last place."""
        at = np.zeros(len(code), dtype=np.int64)
        feature, limit = np.array(self.feature), np.array(self.code)
        left, right, lost = np.array(self.left), np.array(self.right), np.array(self.missing_left)
        while True:
            rows = np.flatnonzero(feature[at] >= 0)
            if not len(rows):
                return at
            node = at[rows]
            own = code[rows, feature[node]]
            goes = np.where(own == WIDTH - 1, lost[node], own <= limit[node])
            at[rows] = np.where(goes, left[node], right[node])


def _coded(ends: dict[int, list[np.ndarray]]):
    """Chunks of rows as codes: (series, chunk, codes, label, train, step)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, chunk, rows in zip(*(batch.column(c) for c in ("number", "chunk", "rows")), strict=True):
                held = rows.values
                x = held.field("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(held), -1)
                code = np.full(x.shape, WIDTH - 1, dtype=np.uint16)
                for f, e in enumerate(ends[number.as_py()]):
                    known = ~np.isnan(x[:, f])
                    code[known, f] = np.searchsorted(e, x[known, f], side="left") if len(e) else WIDTH - 1
                label = np.nan_to_num(held.field("label").to_numpy(zero_copy_only=False).astype(float))
                test = np.asarray(held.field("is_test"))
                step = np.where(test, held.field("step").to_numpy(zero_copy_only=False).astype(float), 0).astype(np.int32)
                out.append((number.as_py(), chunk.as_py(), code.tobytes(), label.tobytes(), step.tobytes(), b""))
            columns = zip(*out, strict=True) if out else [[]] * 6
            kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["number", "chunk", "codes", "label", "step", "guess"])

    return run


def _read(batch: pa.RecordBatch, base: dict[int, float], trees: dict[int, list[Tree]], rate: float) -> Iterator[tuple]:
    """(series, codes, label, step, guess) of every chunk, the guess with the trees not yet written into it."""
    for number, codes, label, step, guess in zip(*(batch.column(c) for c in ("number", "codes", "label", "step", "guess")), strict=True):
        k = number.as_py()
        label = np.frombuffer(label.as_py())
        code = np.frombuffer(codes.as_py(), dtype=np.uint16).reshape(len(label), -1)
        raw = guess.as_py()
        known = np.frombuffer(raw).copy() if raw else np.full(len(label), base[k])
        for tree in trees[k]:
            known += np.array(tree.value)[tree.leaves(code)]
        yield k, code, label, np.frombuffer(step.as_py(), dtype=np.int32), known


def _histograms(base: dict, done: dict, rate: float, growing: dict[int, Tree], due: dict[int, list[int]]):
    """(series, leaf, feature, sums, rows) by code over a task's chunks, for the leaves that are due."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, code, label, step, guess in _read(batch, base, done, rate):
                if not due[k]:
                    continue
                train = step == 0
                code, rest = code[train], (label - guess)[train]
                leaf = growing[k].leaves(code)
                for at in due[k]:
                    rows = np.flatnonzero(leaf == at)
                    if not len(rows):
                        continue
                    place = code[rows].astype(np.int64) + np.arange(code.shape[1]) * WIDTH
                    size = WIDTH * code.shape[1]
                    sums = np.bincount(place.ravel(), weights=np.repeat(rest[rows], code.shape[1]), minlength=size)
                    found = np.stack([sums, np.bincount(place.ravel(), minlength=size)]).reshape(2, code.shape[1], WIDTH)
                    total[k, at] = total[k, at] + found if (k, at) in total else found
        keys = [(k, at, f) for (k, at), t in total.items() for f in range(t.shape[1])]
        flat = pa.list_(pa.float64())
        columns = [pa.array([key[i] for key in keys], pa.int32()) for i in range(3)]
        columns += [pa.array([total[k, at][part, f] for k, at, f in keys], flat) for part in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["number", "leaf", "feature", "sums", "rows"])

    return run


def split_of(sums: np.ndarray, rows: np.ndarray, squares: float, preset: Preset) -> tuple[float, int, bool, float, float]:
    """The best split of one feature from its histogram (missing values last): gain in units of SAME, code, whether missing
    values go left, rows and sum of the left side."""
    unit, best = max(squares, 1e-300) * SAME, (0.0, 0, False, 0.0, 0.0)
    whole, count, lost, absent = sums.sum(), rows.sum(), sums[-1], rows[-1]
    used = np.flatnonzero(rows[:-1])[:-1]  # not the last bin: nothing known would go right
    more = np.cumsum(sums[:-1])[used], np.cumsum(rows[:-1])[used]
    for missing_left in (True, False) if absent else (None,):
        s, n = (more[0] + lost, more[1] + absent) if missing_left else more
        good = (n >= preset.rows) & (count - n >= preset.rows)
        if not good.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s**2 / (n + preset.shrink) + (whole - s) ** 2 / (count - n + preset.shrink) - whole**2 / (count + preset.shrink)
        gain = np.where(good, np.rint(gain / unit), 0.0)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), int(used[at]), bool(2 * n[at] >= count) if missing_left is None else missing_left, float(n[at]), float(s[at]))
    return best


def _split(squares: dict[int, float], preset: Preset):
    """The histograms of one feature of a leaf, added up, and its best split."""

    def run(table: pa.Table) -> pa.Table:
        sums = np.sum([np.asarray(s.values) for s in table["sums"]], axis=0)
        rows = np.sum([np.asarray(r.values) for r in table["rows"]], axis=0)
        found = split_of(sums, rows, squares[table["number"][0].as_py()], preset)
        values = {c: [table[c][0].as_py()] for c in ("number", "leaf", "feature")} | {"all_rows": [float(rows.sum())], "all_sums": [float(sums.sum())]}
        values |= {c: [v] for c, v in zip(("gain", "code", "missing_left", "left_rows", "left_sums"), found, strict=True)}
        return pa.table(values, schema=pa.schema([(n, k) for n, k in zip(SPLIT_NAMES, SPLIT_KINDS, strict=True)]))

    return run


SPLIT_NAMES = ["number", "leaf", "feature", "all_rows", "all_sums", "gain", "code", "missing_left", "left_rows", "left_sums"]
SPLIT_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.float64(), pa.float64()]
SPLIT = "number int, leaf int, feature int, all_rows double, all_sums double, gain double, code int, missing_left boolean, left_rows double, left_sums double"


def chosen(tree: Tree, preset: Preset) -> tuple[list[int], bool]:
    """The inner nodes of a tree that grows by the preset, in the order they are split, and whether all that they depend on is known."""
    if preset.leaves is None:
        return [k for k, f in enumerate(tree.feature) if f >= 0], all(g is not None for g in tree.gain)
    open_, inner = [0], []
    while len(inner) + 1 < preset.leaves:
        if any(tree.gain[k] is None for k in open_):
            return inner, False
        node = max(open_, key=lambda k: (tree.gain[k], -k))
        if not tree.gain[node]:
            break
        inner.append(node)
        open_.remove(node)
        open_ += [tree.left[node], tree.right[node]]
    return inner, True


def _grown(chunks: DataFrame, base: dict, squares: dict, done: dict[int, list[Tree]], preset: Preset) -> dict[int, Tree]:
    """The next tree of every series."""
    growing = {k: Tree() for k in base}
    while True:
        due = {}
        for k, tree in growing.items():
            inner, known = chosen(tree, preset)
            due[k] = [] if known else [n for n, g in enumerate(tree.gain) if g is None]
        if not any(due.values()):
            break
        sums = chunks.mapInArrow(_histograms(base, done, preset.rate, growing, due), "number int, leaf int, feature int, sums array<double>, rows array<double>")
        best: dict[tuple[int, int], tuple] = {}
        for r in sums.groupBy("number", "leaf", "feature").applyInArrow(_split(squares, preset), SPLIT).collect():  # a row an open leaf and feature
            key = (r.number, r.leaf)
            if key not in best or (r.gain, -r.feature) > (best[key].gain, -best[key].feature):
                best[key] = r
        for k, leaves in due.items():
            tree = growing[k]
            for leaf in leaves:
                r = best.get((k, leaf))
                if r is None:
                    tree.gain[leaf] = 0.0
                    continue
                if not leaf:
                    tree.rows[0], tree.sums[0] = int(r.all_rows), r.all_sums
                last = preset.depth is not None and tree.depth[leaf] == preset.depth
                tree.gain[leaf] = 0.0 if last else r.gain
                if tree.gain[leaf]:
                    tree.feature[leaf], tree.code[leaf], tree.missing_left[leaf] = r.feature, r.code, r.missing_left
                    tree.left[leaf] = tree.child(tree.depth[leaf] + 1, int(r.left_rows), r.left_sums)
                    tree.right[leaf] = tree.child(tree.depth[leaf] + 1, int(r.all_rows - r.left_rows), r.all_sums - r.left_sums)
    for tree in growing.values():
        inner = set(chosen(tree, preset)[0])
        for k in range(len(tree.feature)):
            if k not in inner:
                tree.feature[k] = -1
            tree.value[k] = preset.rate * tree.sums[k] / (tree.rows[k] + preset.shrink) if tree.rows[k] else 0.0
    return growing


def _written(base: dict, done: dict, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guess = [known.tobytes() for *_, known in _read(batch, base, done, rate)]
            yield batch.set_column(batch.schema.get_field_index("guess"), "guess", pa.array(guess, pa.binary()))

    return run


def _predicted(names: dict[int, str], model: str, base: dict, done: dict, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(names[k], model, int(s), float(g)) for k, _, _, step, guess in _read(batch, base, done, rate) for s, g in zip(step, guess, strict=True) if s]
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = [pa.string(), pa.string(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["series_id", "model_name", "step", "predicted"])

    return run


def long_forecasts(table: DataFrame, presets: dict[str, Preset], trees: int) -> DataFrame:
    """Forecasts of the test rows of long series (a table as of `trees.training_table`), as `boosted` gives them."""
    train, parts = ~F.col("is_test"), []
    x = [f"x_{s}" for s in SLOTS]
    share = [k / BINS for k in range(1, BINS + 1)]
    stats = cut_lineage(
        table.groupBy("series_id").agg(
            F.avg(F.when(train, F.col("label"))).alias("mean"), F.count_if(train).alias("n"), F.var_pop(F.when(train, F.col("label"))).alias("spread"),
            F.array(*[F.coalesce(F.percentile_approx(F.when(train, F.col(c)), share, ACCURACY), F.array().cast("array<double>")) for c in x]).alias("ends"),
        )
    )
    kind = "number int, chunk long, codes binary, label binary, step binary, guess binary"
    after = ""
    while True:  # groups by name: what the driver holds of a group is bounded
        group = stats.filter(F.col("series_id") > after).orderBy("series_id").limit(GROUP).collect()
        if not group:
            break
        after = group[-1].series_id
        names = {k: r.series_id for k, r in enumerate(group)}
        base, squares = {k: r.mean for k, r in enumerate(group)}, {k: r.spread * r.n for k, r in enumerate(group)}
        ends = {k: [np.unique(np.array(e, dtype=float)) for e in r.ends] for k, r in enumerate(group)}
        number = F.create_map(*[F.lit(v) for k, name in names.items() for v in (name, k)])[F.col("series_id")]
        rows = table.filter(F.col("series_id").isin(*names.values())).withColumn("number", number)
        # rows of a day stay together; that a chunk has about CHUNK rows is all that matters
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("timestamp"), F.lit(int(max(r.n for r in group) // CHUNK) + 1)))
        point = F.struct("is_test", "step", "label", F.array(*x).alias("x"))
        held = rows.groupBy("number", "chunk").agg(F.collect_list(point).alias("rows"))
        coded = cut_lineage(held.mapInArrow(_coded(ends), kind))
        for model, preset in presets.items():
            chunks, done = coded, {k: [] for k in names}
            for turn in range(trees):
                for k, tree in _grown(chunks, base, squares, done, preset).items():
                    done[k].append(tree)
                if turn % KEPT == KEPT - 1:
                    chunks, done = cut_lineage(chunks.mapInArrow(_written(base, done, preset.rate), kind)), {k: [] for k in names}
            parts.append(chunks.mapInArrow(_predicted(names, model, base, done, preset.rate), FORECAST))
    empty = table.sparkSession.createDataFrame([], FORECAST)
    return reduce(DataFrame.unionByName, parts, empty)
