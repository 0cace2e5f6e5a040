"""Conversation structure repair by a run-length dynamic program.

A repaired conversation has the role initials (s?(ua)+)?. Rows are kept, given another role, deleted, or led by inserted empty ones,
at the least cost. A row matters to that only by its symbol, role initial and fault, so a conversation is a string of symbols, and each
symbol is a small matrix over the states of the pattern whose products take sums for products and minima for sums. Equal neighbours
are collapsed into runs; a run of n is passed by the binary powers of its matrix, which are computed once a task. The choices are
then unrolled from the costs to go: of the cheapest edits always the first in ASCII order.

How the work is dealt out: faults are found by Spark, symbols are put in order by ranges of (conversation, turn), so that a long
conversation is cut over tasks, and come together as one byte a row, which is no more than the audit they become. The repaired texts
are not gathered: they follow their audit in a sorted stream, hashed or handed on row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.tables import with_group
from panelcast.session import cut_lineage

# What edits cost.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
INITIALS = "sua"
SOUND, CUT, BLANK, AGAIN = range(4)  # faults
START, AFTER_S, AFTER_U, AFTER_A = range(4)  # states
GIVEN = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # the state after a user or assistant row, whichever may follow
NEVER = 1 << 40
STRETCH = 1 << 16  # symbols whose choices are unrolled at a time
KNOWN = 1 << 15  # short conversations a task remembers
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def _closure() -> np.ndarray:
    """Cost from state to state by inserted rows alone."""
    step = np.full((4, 4), NEVER, dtype=np.int64)
    step[range(4), range(4)] = 0
    for state, to in enumerate(GIVEN):
        step[state, to] = min(step[state, to], INSERT)
    return product(product(step, step), step)


class Costs:
    """Matrices of symbols (4 * initial + fault) and their binary powers."""

    def __init__(self):
        self.inserts = _closure()
        self.end = np.minimum(self.inserts[:, START], self.inserts[:, AFTER_A])  # where a conversation may end
        self.powers: dict[int, list[np.ndarray]] = {}

    def edits(self, symbol: int) -> tuple[int | None, list[int | None], int | None]:
        """Cost of keeping or None, the state after it by state, and cost of another role or None."""
        initial, fault = divmod(symbol, 4)
        if fault in (BLANK, AGAIN):
            return None, [None] * 4, None
        extra = TRUNCATED if fault == CUT else 0
        after = [[AFTER_S, None, None, None], [AFTER_U, AFTER_U, None, AFTER_U], [None, None, AFTER_A, None], [None] * 4][initial]
        return KEEP + extra, after, REROLE + extra

    def power(self, symbol: int, k: int) -> np.ndarray:
        """The matrix of 2^k rows of a symbol."""
        if symbol not in self.powers:
            keep, after, rerole = self.edits(symbol)
            row = np.full((4, 4), NEVER, dtype=np.int64)
            row[range(4), range(4)] = DELETE
            for state in range(4):
                if after[state] is not None:
                    row[state, after[state]] = min(row[state, after[state]], keep)
                if rerole is not None:
                    row[state, GIVEN[state]] = min(row[state, GIVEN[state]], rerole)
            self.powers[symbol] = [product(self.inserts, row)]
        known = self.powers[symbol]
        while len(known) <= k:
            known.append(product(known[-1], known[-1]))
        return known[k]

    def before(self, symbol: int, count: int, after: np.ndarray) -> np.ndarray:
        """Costs to go before `count` rows of a symbol, from those after them."""
        for k in range(count.bit_length()):
            if count >> k & 1:
                after = np.minimum((self.power(symbol, k) + after).min(axis=1), NEVER)
        return after

    def within(self, symbol: int, count: int, after: np.ndarray) -> np.ndarray:
        """Costs to go with 0, 1, .. `count` rows of the run left, doubled power by power."""
        out = np.empty((count + 1, 4), dtype=np.int64)
        out[0], done, k = after, 1, 0
        while done <= count:
            some = min(done, count + 1 - done)
            out[done : done + some] = np.minimum((self.power(symbol, k)[None] + out[:some, None, :]).min(axis=2), NEVER)
            done, k = done + some, k + 1
        return out


def runs(symbols: np.ndarray) -> list[tuple[int, int]]:
    first = np.concatenate([[0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1])
    return list(zip(symbols[first].tolist(), np.diff(np.append(first, len(symbols))).tolist(), strict=True)) if len(symbols) else []


def cheapest(costs: Costs, symbols: np.ndarray) -> tuple[int, str]:
    """Cost and audit of a conversation: the initials of its edits in order."""
    symbols = np.where(symbols % 4 >= BLANK, BLANK, symbols)  # rows that must go are all alike
    stretches = [runs(symbols[a : a + STRETCH]) for a in range(0, len(symbols), STRETCH)]
    ends, c = [], costs.end
    for stretch in reversed(stretches):
        ends.append(c)
        for symbol, count in reversed(stretch):
            c = costs.before(symbol, count, c)
    total, state, audit = int(c[START]), START, []
    for stretch, end in zip(stretches, reversed(ends), strict=True):
        after = [end]
        for symbol, count in reversed(stretch):
            after.append(costs.before(symbol, count, after[-1]))
        edits: list[str] = []
        for (symbol, count), then, now in zip(stretch, after[-2::-1], after[:0:-1], strict=True):
            go = [then.tolist(), now.tolist()] if count == 1 else costs.within(symbol, count, then).tolist()
            keep, to, rerole = costs.edits(symbol)
            left = count
            while left:
                least, here, rest = go[left][state], go[left], go[left - 1]
                if DELETE + rest[state] == least:
                    edits.append("D")
                elif INSERT + here[GIVEN[state]] == least:
                    edits.append("I")
                    state = GIVEN[state]
                    continue
                elif to[state] is not None and keep + rest[to[state]] == least:
                    edits.append("K")
                    state = to[state]
                else:
                    edits.append("R")
                    state = GIVEN[state]
                left -= 1
        audit.append("".join(edits))
    while costs.end[state]:
        audit.append("I")
        state = GIVEN[state]
    return total, "".join(audit)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows as the crc32 of `conv:turn` modulo 20 damages them. 0 drops the row (no copies), 1 empties its text,
    2 takes its sentence ends away, 3 doubles it, 4 gives it the role user. A null counts as one space; conv and turn stay null."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    text, role, kind = F.coalesce(F.col(text_col), space), F.coalesce(F.col(role_col), space), F.crc32(key) % 20
    return rows.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _fault(text: Column) -> Column:
    sound = text.rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    return F.when(~text.rlike("[^\\x20\\x09-\\x0D]"), BLANK).when(~sound, CUT).otherwise(SOUND)


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols of each conversation that a task has rows of, with what its turns need: rows come in order."""
    at = TaskContext.get().partitionId()
    names = ["conv", "at", "symbols", "turns", "first_turn", "last_turn"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    out: list[tuple] = []
    held, size = None, 0  # the conversation in hand: [conv, parts, turns, first, last]

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv", "turn", "symbol", "copies"))
        for conv, turn, symbol, copies in zip(*columns, strict=True):
            if held is None or held[0] != conv:
                if held is not None:
                    out.append((held[0], at, bytes(held[1]), *held[2:]))
                    size += len(held[1]) + 64
                held = [conv, bytearray(), 0, None, None]
            if turn is not None and turn != held[4]:
                held[2] += 1
                held[4] = turn
                held[3] = turn if held[3] is None else held[3]
            again = symbol if symbol % 4 == BLANK else symbol - symbol % 4 + AGAIN
            held[1].append(symbol)
            if copies > 1:
                held[1].extend(bytes([again]) * (copies - 1))
        if size > 8 << 20:
            yield table()
            out, size = [], 0
    if held is not None:
        out.append((held[0], at, bytes(held[1]), *held[2:]))
    yield table()


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    costs, known = Costs(), {}
    legal = np.zeros((4, 4), dtype=bool)
    for a, b in ("su", "ua", "au"):
        legal[INITIALS.index(a), INITIALS.index(b)] = True
    for batch in batches:
        out = []
        for pieces in batch.column("pieces").to_pylist():
            raw = b"".join([p["symbols"] for p in pieces])
            turns = [p for p in pieces if p["turns"]]
            distinct = sum(p["turns"] for p in turns) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turns[:-1], turns[1:], strict=True))
            gaps = turns[-1]["last_turn"] - turns[0]["first_turn"] + 1 - distinct if turns else 0
            found = known.get(raw)
            if found is None:
                symbols = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
                fault, initial = np.bincount(symbols % 4, minlength=4).tolist(), symbols // 4
                found = (fault[BLANK], fault[AGAIN], fault[CUT], int((~legal[initial[:-1], initial[1:]]).sum()), *cheapest(costs, symbols))
                if len(raw) <= 64:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[raw] = found
            out.append((gaps, *found))
        columns = [pa.array([o[k] for o in out], pa.int64()) for k in range(6)]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), *columns, pa.array([o[6] for o in out], pa.string())], ["conv", *REPORT, "audit"])


def reported(rows: DataFrame) -> DataFrame:
    """One row per conversation of `rows` (conv, turn, role, text, copies; no nulls in role, text and copies): gaps in the turns, blank, duplicate
    and truncated rows (the first fault of a row counts), illegal pairs of neighbours, cost and audit of the cheapest repair. Rows are in
    order of turn, nulls first, then role, then a digest of the text. Conversations whose rows have no copies are there, with zeros."""
    place = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    live = rows.where("copies > 0").select("conv", "turn", "role", _digest().alias("digest"), (place * 4 + _fault(F.col("text"))).alias("symbol"), "copies")
    live = cut_lineage(live.groupBy("conv", "turn", "role", "digest", "symbol").agg(F.sum("copies").cast("int").alias("copies")))
    live = live.withColumn("here", F.struct("turn"))
    live = with_group(live, ["conv", "role", "digest"], "turn", {"earliest": ("min", "here")})
    late = (F.col("symbol") % 4 != BLANK) & ~F.col("earliest.turn").eqNullSafe(F.col("turn"))
    symbol = F.when(late, F.col("symbol") - F.col("symbol") % 4 + AGAIN).otherwise(F.col("symbol"))
    order = ["conv", "turn", "role", "digest"]
    live = cut_lineage(live.select(*order, symbol.cast("int").alias("symbol"), "copies"))
    ranges = live.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "symbol", "copies")
    schema = "conv long, at int, symbols binary, turns long, first_turn long, last_turn long"
    pieces = ranges.mapInArrow(_pieces, schema)
    every = rows.select("conv").distinct().withColumn("piece", F.lit(None).cast(f"struct<{schema.partition(', ')[2].replace(' ', ':').replace(',:', ',')}>"))
    both = pieces.select("conv", F.struct(*[c for c in pieces.columns if c != "conv"]).alias("piece")).unionByName(every)
    whole = both.groupBy("conv").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))  # a task of the ranges has one piece at most
    return whole.mapInArrow(_report, "conv long, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string")


def _replay(digest: bool):
    """Follows each conversation's audit over its rows, which come in order behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, told, place, spoken, hashed = "", 0, None, 0, 0, None
        out: list[tuple] = []
        names = ["conv", *REPORT, "audit", "repaired_sha256"] if digest else ["conv", "place", "edit", "role", "text"]
        kinds = [pa.int64()] * (1 + len(REPORT)) + [pa.string()] * 2 if digest else [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def say(edit: str, role: str | None, text: str) -> None:
            nonlocal place, spoken
            if edit == "K" and place == 0 and role.startswith("s"):
                pass  # the one row before the turns of user and assistant
            else:
                role = role if edit == "K" else ("user", "assistant")[spoken % 2]
                spoken += 1
            if digest:
                hashed.update((("\n" if place else "") + role + ":" + text).encode())
            else:
                out.append((told[0], place, edit, role, text))
            place += 1

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                say("I", None, "")
                at += 1

        def close() -> None:
            inserts()
            if digest and told is not None:
                out.append((*told, hashed.hexdigest()))

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "copies", "report")), strict=True)
            for conv, kind, role, text, copies, report in rows:
                if kind == 0:
                    close()
                    audit, at, place, spoken, hashed = report["audit"], 0, 0, 0, hashlib.sha256()
                    told = (conv, *(report[c] for c in REPORT), audit)
                    continue
                for _ in range(copies):
                    inserts()
                    if audit[at] != "D":
                        say(audit[at], role, text)
                    at += 1
            yield table()
            out = []
        close()
        yield table()

    return run


def _stream(rows: DataFrame, reports: DataFrame, digest: bool, schema: str) -> DataFrame:
    told = F.struct(*REPORT, "audit").alias("report")
    none = F.lit(None)
    heads = reports.select(
        "conv", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("digest"),
        none.cast("string").alias("text"), F.lit(0).alias("copies"), told,
    )
    texts = rows.where("copies > 0").select("conv", F.lit(1).alias("kind"), "turn", "role", _digest().alias("digest"), "text", "copies")
    both = heads.unionByName(texts, allowMissingColumns=True).repartition("conv")
    ordered = both.sortWithinPartitions("conv", "kind", "turn", "role", "digest").select("conv", "kind", "role", "text", "copies", "report")
    return ordered.mapInArrow(_replay(digest), schema)


def repaired(rows: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """(conv, place, edit, role, text): the rows of the repaired conversations in order of place, from 0; deleted rows are not among them."""
    reports = cut_lineage(reported(rows)) if reports is None else reports
    return _stream(rows, reports, False, "conv long, place long, edit string, role string, text string")


def digested(rows: DataFrame) -> DataFrame:
    """The columns of `reported` and repaired_sha256, the digest of the repaired `role:text` joined by newlines (of the empty string if
    nothing is left). A digest is taken over one stream, so all texts of a conversation pass one task, sorted by Spark and held batch by batch."""
    schema = "conv long, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string, repaired_sha256 string"
    return _stream(rows, cut_lineage(reported(rows)), True, schema)


def structure_repair(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conv_col of the table, a null one included: damaged as in `damaged`, reported and repaired as in `digested`. A null turn comes
    first, a null role or text is one space. Equal rows are duplicates but for one. Rows of one turn are in order of role, then of a digest of
    their text. An empty table gives an empty result; other columns are not read."""
    rows = damaged(conversations, conv_col, turn_col, role_col, text_col)
    return digested(rows).withColumnRenamed("conv", conv_col)
