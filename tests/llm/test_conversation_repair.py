import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from panelcast.llm import conversation_repair as R
from panelcast.llm.queries import ORACLES, op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, conv string"
AFTER = {0: 2, 1: 2, 2: 3, 3: 2}  # a user or assistant row, whichever may follow


def plain_cheapest(rows):
    """(cost, audit) of rows (initial, fault) by trying all edits, the least pair of each state kept."""
    best = {0: (0, "")}

    def with_inserts(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                new = (cost + 5, audit + "I")
                best[AFTER[state]] = min(best.get(AFTER[state], new), new)
        return best

    for initial, fault in rows:
        after = {}
        for state, (cost, audit) in with_inserts(best).items():
            options = [(state, cost + 2, "D")]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, initial))
                options += [(keep, cost + extra, "K")] if keep else []
                options.append((AFTER[state], cost + extra + 1, "R"))
            for to, c, e in options:
                after[to] = min(after.get(to, (c, audit + e)), (c, audit + e))
        best = after
    best = with_inserts(best)
    return min(best[s] for s in (0, 3) if s in best)


def plain(table):
    """The whole contract, row by row: {conv: the values of the result}."""
    found = {}
    for conv, turn, role, text in table:
        rows = found.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0], r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in rows:
            body = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = plain_cheapest(list(zip(initials, faults, strict=True)))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
        lines, spoken, at = [], 0, 0
        for edit in audit:
            _, role, text = rows[at] if edit != "I" else (None, "", "")
            at += edit != "I"
            if edit == "D":
                continue
            if not (edit == "K" and not lines and role[:1] == "s"):
                role = role if edit == "K" else ("user", "assistant")[spoken % 2]
                spoken += 1
            lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha)
    return out


def values(got):
    rows = got.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(4)
    texts = ["Yes.", "No!", "cut", "cut \n", "", " \t", None, "Why?\v", "Yes.", "a.b", "É. ", "x\x1c"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "aide"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([0, 1, 2, 5, 9, 30])):
            place = None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 3, 90])
            rows.append((conv, place, rng.choice(roles[: rng.choice([4, 10])]), rng.choice(texts)))
    rows += [(7, None, "user", "Yes.")] * 3 + [(7, 2**40, "user", "Yes.")] * 2 + [(500, t, "system", "Hm.") for t in range(70)]
    rows += [(conv, 0, "user", "x") for conv in range(600, 640)]
    return rows


def test_all_conversations(spark):
    sf = "/root/testdata/sf0.01"
    table = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert values(op11_conversation_repair(spark, sf)) == plain(table)


def test_odd_rows(spark, odd_rows):
    docs = spark.createDataFrame([(*r, "x", "y") for r in odd_rows], SCHEMA).repartition(5)
    want = plain(odd_rows)
    assert None in want and (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want.values()
    got = R.structure_repair(docs)
    assert values(got) == want
    assert R.structure_repair(docs.limit(0)).collect() == [] and got.columns == R.structure_repair(docs.limit(0)).columns


def test_sql_on_odd_rows(spark, odd_rows, tmp_path):
    spark.createDataFrame([(*r, "x", "y") for r in odd_rows], SCHEMA).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(ORACLES["op11_conversation_repair"]).fetchall()} == plain(odd_rows)


def test_repaired_rows(spark, odd_rows):
    rows = R.damaged(spark.createDataFrame([(*r, "x", "y") for r in odd_rows], SCHEMA))
    found = {}
    for r in sorted(R.repaired(rows).collect(), key=lambda r: r.place):
        assert r.place == len(found.setdefault(r.conv, [])) and r.edit in "KRI"
        found[r.conv].append(f"{r.role}:{r.text}")
    for conv, want in plain(odd_rows).items():
        assert hashlib.sha256("\n".join(found.get(conv, [])).encode()).hexdigest() == want[-1]


def test_a_long_conversation_is_cut_over_tasks(spark):
    rng = random.Random(8)
    table = [(1, t // 2, rng.choice(["user", "assistant"]), f"t{rng.randint(0, 900)}" + rng.choice([".", ""])) for t in range(4000)] + [(2, 1, "user", "a.")]
    rows = spark.createDataFrame([(*r, "x", "y") for r in table], SCHEMA)
    order = rows.repartitionByRange(4, "conv_id", "turn").rdd.getNumPartitions()
    assert order > 1 and values(R.structure_repair(rows)) == plain(table)


def test_runs_by_binary_powers(monkeypatch):
    names = ["", "truncated", "blank", "duplicate"]
    rng, costs = random.Random(5), R.Costs()
    for stretch in (1 << 16, 7):
        monkeypatch.setattr(R, "STRETCH", stretch)
        for _ in range(300):
            kinds, symbols = rng.sample(range(16), rng.randint(1, 5)), []
            while len(symbols) < rng.randint(0, 120):
                symbols += [rng.choice(kinds)] * rng.choice([1, 1, 2, 3, 40])
            want = plain_cheapest([("sua-"[s // 4], names[s % 4]) for s in symbols])
            assert R.cheapest(costs, np.array(symbols, dtype=np.int64)) == want
