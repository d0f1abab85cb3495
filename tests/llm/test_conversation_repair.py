import hashlib
import itertools
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from ledgerloom.llm import conversation_repair as cr
from ledgerloom.llm.queries import op12_conversations

BLANK = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?")


def faults(turns):
    """The first fault of each turn, or None."""
    seen, out = set(), []
    for role, text in turns:
        left = BLANK.findall(text)
        out.append("blank" if not left else "duplicate" if (role, text) in seen else None if left[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_way(turns):
    """(cost, audit, repaired) of the cheapest edits by trying all, at most two insertions in each place."""
    gaps = [p for n in range(3) for p in itertools.product("ua", repeat=n)]
    found = faults(turns)
    options = []
    for (role, text), fault in zip(turns, found):
        more = 3 if fault == "truncated" else 0
        kept = [] if fault in ("blank", "duplicate") else [("K", more, role, text), ("R", 3 + more, "user", text), ("R", 3 + more, "assistant", text)]
        options.append([("D", 4, None, None), *kept])
    best = None
    for way in itertools.product(*options):
        for places in itertools.product(gaps, repeat=len(turns) + 1):
            cost = sum(w[1] for w in way) + 3 * sum(map(len, places))
            if best and cost > best[0]:
                continue
            edits = []
            for k, place in enumerate(places):
                edits += [("I", {"u": "user", "a": "assistant"}[x], "") for x in place]
                if k < len(way):
                    edits.append((way[k][0], way[k][2], way[k][3]))
            out = [(r, t) for e, r, t in edits if e != "D"]
            if GOOD.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                best = min(best or (1 << 30,), (cost, "".join(e for e, _, _ in edits), "\n".join(f"{r}:{t}" for r, t in out)))
    return best


def by_states(turns):
    """(cost, audit, repaired) by a search over (turn, state) that keeps the least (cost, audit)."""
    found, n = faults(turns), len(turns)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    need = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {}
    for t in range(n, -1, -1):
        for s in ("", "s", "u", "a"):
            ways = [(0, "", ())] if t == n and s in ("", "a") else []
            if t < n:
                role, text = turns[t]
                c, a, out = best[t + 1, s]
                ways.append((c + 4, "D" + a, out))
                if found[t] not in ("blank", "duplicate"):
                    more = 3 if found[t] == "truncated" else 0
                    if (to := step.get((s, role[:1]))) is not None:
                        c, a, out = best[t + 1, to]
                        ways.append((c + more, "K" + a, (f"{role}:{text}", *out)))
                    c, a, out = best[t + 1, need[s]]
                    ways.append((c + more + 3, "R" + a, (f"{ {'u': 'user', 'a': 'assistant'}[need[s]]}:{text}", *out)))
            best[t, s] = min(ways, default=(1 << 30, "", ()))
        for _ in range(2):
            was = {s: best[t, s] for s in need}
            for s in need:
                c, a, out = was[need[s]]
                best[t, s] = min(best[t, s], (c + 3, "I" + a, (f"{ {'u': 'user', 'a': 'assistant'}[need[s]]}:", *out)))
    c, a, out = best[0, ""]
    return c, a, "\n".join(out)


def report(rows, repaired):
    """What the query says of one conversation, from its rows (conv_id, turn, role, text) before damage."""
    turns = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        turns += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    turns = [x[1:] for x in turns]
    found = faults(turns)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit, text = repaired(turns)
    return (rows[0][0], gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def made(n, longest, seed):
    r, out = random.Random(seed), []
    for conv in range(n):
        for _ in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
            text = r.choice(["Yes.", "No!", "So?  \n", "open", "", " \t", None, "Same.", "é.", "  ? x"])
            out.append((conv if conv % 17 else None, r.choice([None, *range(12)]), role, text))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*x, "c", 1) for x in rows], "conv_id long, turn long, role string, text string, code string, gone int")


def key(row):
    return (row[0] is not None, row[0] or 0)


def grouped(rows):
    out = {}
    for x in rows:
        out.setdefault(x[0], []).append(x)
    return list(out.values())


def test_equals_every_way(spark):
    rows = made(120, 3, 1)
    got = sorted(map(tuple, cr.query(frame(spark, rows)).collect()), key=key)
    small = [g for g in grouped(rows) if len(g) <= 3]
    assert len(small) > 100
    mine = {x[0]: x for x in got}
    for g in small:
        assert mine[g[0][0]] == report(g, lambda t: every_way(t) if len(t) <= 3 else by_states(t))


@pytest.mark.parametrize("held", [(1 << 16, 1 << 25), (1, 1)])
def test_equals_a_search_over_states(spark, monkeypatch, held):
    monkeypatch.setattr(cr, "ROWS", held[0])
    monkeypatch.setattr(cr, "BYTES", held[1])
    rows = made(150, 40, 2) * 1 + [(1000, t, "user", "Again.") for t in range(60)] + [(1001, 3, "user", "Tie.")] * 5 + [(2000 + k, 0, "system", "Only.") for k in range(40)]
    want = sorted((report(g, by_states) for g in grouped(rows)), key=key)
    df = frame(spark, rows)
    assert sorted(map(tuple, cr.query(df).collect()), key=key) == want
    con = duckdb.connect()
    conversations = df.select("conv_id", "turn", "role", "text").toArrow()  # noqa: F841  (DuckDB finds it by its name)
    assert sorted(con.sql(cr.ORACLE_SQL).fetchall(), key=key) == want
    for n in (4, 25):  # the long ones as streams
        assert sorted(map(tuple, cr.repair(cr.damage(df), long_rows=n).collect()), key=key) == want
    assert sorted(map(tuple, cr.repair(cr.damage(df), long_bytes=30).collect()), key=key) == want
    assert cr.query(df.where("false")).count() == 0


def test_long_conversations(spark):
    r = random.Random(3)
    rows = [(5, t, r.choice(["user", "assistant", "tool"]), r.choice(["Word %d." % r.randrange(10_000), "cut"])) for t in range(30_000)] + [(6, 0, "user", "x" * 3_000_000)]
    want = sorted((report(g, lambda t: (0, "", "")) for g in grouped(rows)), key=key)
    one, two = (sorted(map(tuple, cr.repair(cr.damage(frame(spark, rows)), long_rows=n).collect()), key=key) for n in (1 << 16, 10_000))
    assert one == two and [x[:6] for x in one] == [x[:6] for x in want]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = sorted((report(g, by_states) for g in grouped(rows)), key=key)
    assert sorted(map(tuple, op12_conversations(spark, sf).collect()), key=key) == want


ALONE = """
import sys
import pyarrow as pa
from ledgerloom.llm import conversation_repair as cr
out = [x.num_rows for x in cr._short(pa.ipc.open_stream(sys.stdin.buffer))]
print(len(out), sum(out))
"""


def test_more_rows_than_are_repaired_together():
    # in a process that loads nothing else, as a new worker does
    n = 3 * cr.ROWS
    columns = {"conv_id": [k // 2 for k in range(n)], "gone": [False] * n, "turn": [k % 2 for k in range(n)], "role": ["user", "assistant"] * (n // 2), "text": ["Yes."] * n}
    columns |= {"code": pa.array([2, 3] * (n // 2), pa.int32()), "blank": [False] * n, "h1": [k % 2 for k in range(n)], "h2": [0] * n}
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, (rows := pa.table(columns)).schema) as out:
        out.write_table(rows, max_chunksize=10_000)
    done = subprocess.run([sys.executable, "-c", ALONE], input=sink.getvalue().to_pybytes(), stdout=subprocess.PIPE, check=True, cwd=Path(__file__).resolve().parents[2], timeout=120)
    tables, conversations = map(int, done.stdout.split())
    assert tables > 1 and conversations == n // 2


@pytest.mark.parametrize("rows", [1, 3, 40])
def test_whole_conversations_however_the_rows_are_cut(rows):
    r = random.Random(rows)
    for _ in range(200):
        ids = [None] * r.choice([0, 1, 5]) + sorted(r.choice(range(6)) for _ in range(r.randint(1, 40)))
        edges = sorted({0, len(ids), *r.choices(range(len(ids)), k=r.randint(0, 12))})
        batches = [pa.record_batch({"conv_id": pa.array(ids[a:b], pa.int64())}) for a, b in zip(edges, edges[1:])]
        got = [t["conv_id"].to_pylist() for t in cr._whole(iter(batches), rows, 1 << 30)]
        assert [x for t in got for x in t] == ids
        assert all(a[-1] != b[0] for a, b in zip(got, got[1:]))


def test_steps_of_a_long_conversation_are_held_as_few_arrays():
    n = 10_000
    rows = pa.table({"conv_id": [7] * n, "gone": [False] * n, "turn": range(n), "code": pa.array([2, 3] * (n // 2), pa.int32()), "blank": [False] * n, "h1": range(n), "h2": [0] * n})
    ((_, cost, steps),) = cr._Rows(rows).edits()
    assert len(steps) < 10 and cost.tolist() == [0] and b"".join(x[1].tobytes() for x in steps) == b"K" * n
