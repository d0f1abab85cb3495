"""Conversation repair by a time-major dynamic program over turns (operator 12)."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .crc_sql import CRC

#: Conversations of more rows, or more bytes of text, are read twice as a stream instead of being held whole.
LONG_ROWS, LONG_BYTES = 1 << 16, 1 << 26
#: Rows, and bytes of text, of short conversations that are repaired together; numbers that one tensor holds.
ROWS, BYTES, TENSOR = 1 << 16, 1 << 25, 1 << 21

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 28
#: Kinds of initials: any other, system, user, assistant.  States: nothing yet, after system, after user, after assistant.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: By state: the role that must come next if it is not kept; by state and kind: the next state, or -1.
NEEDED = np.array([USER, USER, ASSISTANT, USER])
NEXT = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
#: Bits of a row's code, above the two of its kind.
FORCED, CUT_OFF, PAD = 4, 8, 16
LEGAL = {SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER}
SPACE = " \t\n\x0b\x0c\r"
SORTED = "conv_id", "gone", "turn", "role", "text", "again"


def damage(rows: DataFrame) -> DataFrame:
    """rows as faults leave them, by crc32(conv_id:turn) % 20, with the column ``gone`` for rows that are dropped; nulls of role and text are one space."""
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault, role, text = F.crc32(place.cast("binary")) % 20, F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    narrow = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = narrow.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), "fault")
    return out.withColumn("again", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault")


def _coded(rows: DataFrame) -> DataFrame:
    """rows with what the repair needs of each: its code, whether it is blank, and 128 bits that stand for role and text."""
    left = F.rtrim(F.col("text"), F.lit(SPACE))
    first = F.substring("role", 1, 1)
    kind: Column = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    blank = left == ""
    code = kind + F.when(~blank & ~F.substring(left, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(0)
    return rows.select("*", code.cast("int").alias("code"), blank.alias("blank"), F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", "role", F.lit(1)).alias("h2"))


def _closed(b: np.ndarray) -> np.ndarray:
    """Costs by state (first axis) if turns may be inserted first; two are enough to get anywhere."""
    for _ in range(2):
        b = np.minimum(b, INSERT + b[NEEDED])
    return b


def costs(code: np.ndarray) -> np.ndarray:
    """[time, state, conversation] costs of repairing what is left, from codes [time, conversation]."""
    t, n = code.shape
    out = np.empty((t + 1, 4, n), np.int32)
    end = np.full((4, n), NEVER, np.int32)
    end[[0, ASSISTANT]] = 0
    out[t] = _closed(end)
    for at in range(t - 1, -1, -1):
        out[at] = _closed(np.minimum.reduce(_choices(code[at], out[at + 1])))
        if (pad := code[at] & PAD > 0).any():
            out[at][:, pad] = out[at + 1][:, pad]
    return out


def _choices(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs [state, conversation] of deleting, keeping and giving a new role to the turn at hand."""
    forced, more = np.where(code & FORCED, NEVER, 0), np.where(code & CUT_OFF, TRUNCATED, 0)
    to = NEXT[:, code & 3]
    kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 0), NEVER)
    return DELETE + after, np.minimum(KEEP + forced + more + kept, NEVER), np.minimum(REROLE + forced + more + after[NEEDED], NEVER)


def trace(code: np.ndarray, cost: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The cheapest edits, ASCII-least, one a conversation at a time: (conversation, letter, row, state after it)."""
    t, n = code.shape
    who, at, state = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    code = np.vstack([code, np.full((1, n), FORCED | PAD, code.dtype)])
    while True:
        stay = (at < t) | (cost[np.minimum(at, t), state, who] > 0)
        who, at, state = who[stay], at[stay], state[stay]
        if not len(who):
            return
        now, c, last = cost[at, state, who], code[at, who], np.minimum(at + 1, t)
        pad = (c & PAD > 0) & (at < t)
        row, open_ = c & FORCED == 0, c & PAD == 0
        more, needed, to = np.where(c & CUT_OFF, TRUNCATED, 0), NEEDED[state], NEXT[state, c & 3]
        delete = open_ & (now == DELETE + cost[last, state, who])
        insert = ~pad & ~delete & (now == INSERT + cost[at, needed, who])
        keep = ~delete & ~insert & row & open_ & (to >= 0) & (now == KEEP + more + cost[last, np.maximum(to, 0), who])
        rerole = ~(pad | delete | insert | keep)
        letter = np.select([delete, insert, keep], [ord("D"), ord("I"), ord("K")], ord("R")).astype(np.uint8)
        new = np.select([insert | rerole, keep], [needed, to], state)
        told = ~pad
        yield who[told], letter[told], at[told], new[told]
        at, state = np.where(insert, at, at + 1), new


def _packed(steps: Iterator[tuple[np.ndarray, ...]], size: int = 4096) -> Iterator[tuple[np.ndarray, ...]]:
    """The steps, so many put together, as a long conversation has steps of one number each."""
    while held := list(itertools.islice(steps, size)):
        yield tuple(np.concatenate(x) for x in zip(*held))


def _firsts(group: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether a row's role and text are seen for the first time in its conversation."""
    order = np.lexsort((np.arange(len(group)), h2, h1, group))
    g, a, b = group[order], h1[order], h2[order]
    out = np.empty(len(group), bool)
    out[order] = np.r_[True, (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(group)]
    return out


class _Rows:
    """Rows of whole conversations in order, as arrays; ``starts`` are the conversations' first rows, those that are gone come last in each."""

    def __init__(self, rows: pa.Table | pa.RecordBatch):
        # null conversations sort first, so a row of one only ever meets others at their border
        ids, none = rows["conv_id"].fill_null(0).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows["conv_id"].combine_chunks().fill_null(0).to_numpy(), np.asarray(rows["conv_id"].is_null())
        self.first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])])
        self.ids = rows["conv_id"].take(pa.array(self.first))
        self.group = np.repeat(np.arange(len(self.first)), np.diff(np.r_[self.first, len(ids)]))
        here = ~np.asarray(rows["gone"])
        self.rows, self.group = np.flatnonzero(here), self.group[here]
        take = lambda c: np.asarray(rows[c].fill_null(0) if c == "turn" else rows[c])[here]
        self.turn, self.dated = take("turn"), ~np.asarray(rows["turn"].is_null())[here]
        self.code, self.blank = take("code").astype(np.uint8), take("blank")
        self.again = ~_firsts(self.group, take("h1"), take("h2")) & ~self.blank
        self.code[self.blank | self.again] |= FORCED
        self.count = np.bincount(self.group, minlength=len(self.first))
        self.start = np.r_[0, np.cumsum(self.count)[:-1]]

    def per(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.group[flags], minlength=len(self.first)).astype(np.int64)

    def report(self) -> dict[str, np.ndarray]:
        n = len(self.first)
        gaps = np.zeros(n, np.int64)
        g, turn = self.group[self.dated], self.turn[self.dated]
        if len(g):
            new = np.r_[True, g[1:] != g[:-1]]
            edge = np.flatnonzero(new)
            distinct = np.add.reduceat((new | np.r_[True, turn[1:] != turn[:-1]]).astype(np.int64), edge)
            gaps[g[edge]] = turn[np.r_[edge[1:], len(g)] - 1] - turn[edge] + 1 - distinct
        kind = self.code & 3
        met = np.r_[False, (self.group[1:] == self.group[:-1]) & ~np.isin(kind[:-1] * 4 + kind[1:], list(LEGAL))][: len(kind)]
        cut_off = (self.code & CUT_OFF > 0) & ~self.again
        return {"gaps": gaps, "blank": self.per(self.blank), "duplicate": self.per(self.again), "truncated": self.per(cut_off), "illegal": self.per(met)}

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(conversations, codes [time, conversation]) by length: exact for short ones, up to a quarter more for long ones."""
        size = self.count
        step = np.maximum(1, 1 << np.maximum(0, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) - 2))
        room = -(-size // step) * step
        for t in np.unique(room[size > 0]).tolist():
            mine = np.flatnonzero((room == t) & (size > 0))
            for lo in range(0, len(mine), max(1, TENSOR // (4 * t))):
                some = mine[lo : lo + max(1, TENSOR // (4 * t))]
                code = np.full((t, len(some)), FORCED | PAD, np.uint8)
                at = np.arange(t)[:, None]
                inside = at < size[some]
                code[inside] = self.code[(self.start[some] + at)[inside]]
                yield some, code

    def edits(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]]:
        """(conversations, costs, steps) of each bucket; the rows of the steps are numbers of rows of the table."""
        for some, code in self.buckets():
            cost = costs(code)
            steps = [(some[who], letter, self.start[some[who]] + np.minimum(at, self.count[some[who]] - 1), state.astype(np.int8)) for who, letter, at, state in _packed(trace(code, cost))]
            yield some, cost[0, 0], steps


OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _batch(rows: _Rows, cost: np.ndarray, audit: list[str], last: list | None, name: str) -> pa.RecordBatch:
    columns = [rows.ids if isinstance(rows.ids, pa.Array) else rows.ids.combine_chunks(), *(pa.array(x) for x in rows.report().values()), pa.array(cost), pa.array(audit, pa.string())]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return pa.RecordBatch.from_arrays(columns + ([] if last is None else [pa.array(last)]), names + ([] if last is None else [name]))


def _solved(rows: _Rows) -> tuple[np.ndarray, list[bytes], list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """(cost, audit) of each conversation and all edits (conversation, letter, row, state), in order within each."""
    cost, audit, edits = np.zeros(len(rows.first), np.int64), [b""] * len(rows.first), []
    for some, total, steps in rows.edits():
        cost[some] = total
        who, letter, row, state = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(who, kind="stable")
        edits.append(tuple(x[order] for x in (who, letter, row, state)))
        who, letter = who[order], letter[order]
        edge = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        for a, b in zip(edge, np.r_[edge[1:], len(who)]):
            audit[who[a]] = letter[a:b].tobytes()
    return cost, audit, edits


def _said(letter: int, role: str, text: str, state: int) -> str:
    if letter == ord("K"):
        return f"{role}:{text}"
    return f"{NAMES[state]}:{text if letter == ord('R') else ''}"


def _whole(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.Table]:
    """Tables of whole conversations of about so many rows or bytes at least, from rows in their order; each batch is looked at once."""
    held, n, n_bytes, at, last = [], 0, 0, (0, 0), None  # the last conversation starts at this batch and row of what is held
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["conv_id"]
        other = np.flatnonzero(~np.asarray(pc.fill_null(pc.equal(ids, ids[-1]), False) if ids[-1].is_valid else ids.is_null()))
        if len(other) or not held or ids[0].as_py() != last:
            at = len(held), int(other[-1]) + 1 if len(other) else 0
        held.append(batch)
        n, n_bytes, last = n + batch.num_rows, n_bytes + batch.nbytes, ids[-1].as_py()
        if (n < rows and n_bytes < size) or at == (0, 0):
            continue
        k, row = at
        yield pa.Table.from_batches([*held[:k], held[k].slice(0, row)])
        held, at = [held[k].slice(row), *held[k + 1 :]], (0, 0)
        n, n_bytes = sum(x.num_rows for x in held), sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation."""
    for table in _whole(batches, ROWS, BYTES):
        rows = _Rows(table)
        cost, audit, edits = _solved(rows)
        role, text = (table[c].combine_chunks().take(pa.array(rows.rows)).to_pylist() for c in ("role", "text"))
        told: list[list[str]] = [[] for _ in rows.first]
        for who, letter, row, state in edits:
            for w, e, r, s in zip(*(x[letter != ord("D")].tolist() for x in (who, letter, row, state))):
                told[w].append(_said(e, role[r], text[r], s))
        sha = [hashlib.sha256("\n".join(x).encode("utf-8", "surrogatepass")).hexdigest() for x in told]
        yield _batch(rows, cost, [a.decode() for a in audit], sha, "repaired_sha256")


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _short, of conversations of any length, without their texts: some 150 bytes a row are held, for the audit is one string."""
    for table in _whole(batches, 1, 1):
        rows = _Rows(table)
        cost, audit, _ = _solved(rows)
        yield _batch(rows, cost, [a.decode() for a in audit], None, "")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) from rows in order, each conversation's led by one that has its audit; texts are digested as they come."""
    now, open_ = None, False
    for batch in batches:
        for conv, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit is not None:
                if open_:
                    yield now.end()
                now, open_ = _Digest(conv, audit), True
            else:
                now.row(role, text)
    if open_:
        yield now.end()


class _Digest:
    def __init__(self, conv: int | None, audit: str):
        self.conv, self.audit, self.at, self.state, self.sha, self.any = conv, audit, 0, 0, hashlib.sha256(), False

    def _tell(self, letter: str, role: str, text: str) -> None:
        first = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)
        self.state = int(NEXT[self.state, first] if letter == "K" else NEEDED[self.state])
        said = _said(ord(letter), role, text, self.state)
        self.sha.update((f"\n{said}" if self.any else said).encode("utf-8", "surrogatepass"))
        self.any = True

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._tell("I", "", "")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self._tell(letter, role, text)

    def end(self) -> pa.RecordBatch:
        self._inserts()
        return pa.RecordBatch.from_arrays([pa.array([self.conv], pa.int64()), pa.array([self.sha.hexdigest()])], ["conv_id", "repaired_sha256"])


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of damage()'s rows.

    Rows are in order of turn (nulls first), then of role and text, so that
    rows that share a turn have an order.  Conversations are dealt out by
    conv_id and repaired many at a time, by length.  Longer ones are told by a
    count and read twice as a stream, once without texts; what one task must
    hold of such a conversation grows with its audit, which is one string, and
    its digest is of one text, so one task reads it.

    A null conv_id is a conversation, a null turn has no part in gaps, a role
    with another initial can only be given a new role or be deleted, repeated
    rows are duplicates; an empty table gives no rows and other columns are not
    looked at.
    """
    coded = _coded(rows)
    size = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b"))
    long = cut(size.where((F.col("n") > long_rows) | (F.col("b") > long_bytes)).select(F.col("conv_id").alias("id")), "long")
    is_long = coded["conv_id"].eqNullSafe(long["id"])
    many = long.limit(1).count() > 0
    short = coded.join(long, is_long, "left_anti") if many else coded
    out = short.repartition("conv_id").sortWithinPartitions(*SORTED).mapInArrow(_short, OUT)
    if not many:
        return out
    held = coded.join(long, is_long, "left_semi")
    thin = held.repartition("conv_id").sortWithinPartitions(*SORTED).select("conv_id", "gone", "turn", "code", "blank", "h1", "h2")
    told = cut(thin.mapInArrow(_audits, OUT.rsplit(",", 1)[0]), "audits")
    lead = told.select("conv_id", F.lit(False).alias("gone"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("again"), "audit", F.lit(0).alias("part"))
    turns = held.where("not gone").select("conv_id", "gone", "turn", "role", "text", "again", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("part"))
    ordered = lead.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "part", *SORTED[1:]).select("conv_id", "audit", "role", "text")
    digests = ordered.mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "id")
    return out.unionByName(told.join(digests, told["conv_id"].eqNullSafe(digests["id"])).drop("id"))


def query(conversations: DataFrame) -> DataFrame:
    return repair(damage(conversations))


#: The same program, state by state: costs from the last row back, then the edits from the first row on.
ORACLE_SQL = f"""
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as place from conversations),
f as (select distinct place as f from raw), {CRC},
h as (select raw.*, v % 20 as d from raw join crc on place = f),
dam as (select conv_id, turn, case d when 4 then 'user' else role end as role, case d when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case d when 3 then [0, 1] else [0] end) as again from h where d <> 0),
o as (select *, row_number() over (partition by conv_id, role, text order by t) > 1 as seen from (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, again) as t, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as rest from dam)),
e as (select conv_id, t, turn, role, text, case role[1] when 's' then 1 when 'u' then 2 when 'a' then 3 else 0 end as kind, rest = '' as blank, seen and rest <> '' as dup, rest = '' or seen as forced,
  case when rest <> '' and right(rest, 1) not in ('.', '!', '?') then 3 else 0 end as more from o),
size as (select conv_id, count(*) as n from e group by conv_id),
back as (select conv_id, n + 1 as t, [0, 6, 3, 0] as b from size union all
  select conv_id, t, [least(c[1], 3 + u), least(c[2], 3 + u), u, least(c[4], 3 + c[3])] from (select *, least(c[3], 3 + c[4]) as u from (
    select e.conv_id, e.t, [least(4 + b[1], r + b[3], case kind when 1 then k + b[2] when 2 then k + b[3] else 99999999 end), least(4 + b[2], r + b[3], case kind when 2 then k + b[3] else 99999999 end),
      least(4 + b[3], r + b[4], case kind when 3 then k + b[4] else 99999999 end), least(4 + b[4], r + b[3], case kind when 2 then k + b[3] else 99999999 end)] as c
    from (select *, case when forced then 99999999 else more end as k, case when forced then 99999999 else 3 + more end as r from e) e join back on back.conv_id is not distinct from e.conv_id and e.t = back.t - 1))),
walk as (select conv_id, 1::bigint as t, 0 as s, '' as audit, []::varchar[] as said from size union all
  select conv_id, case x when 'I' then t else t + 1 end, case x when 'D' then s when 'K' then nxt else need end, audit || x,
    case x when 'D' then said else list_append(said, case x when 'K' then role || ':' || text else case need when 2 then 'user:' else 'assistant:' end || case x when 'R' then text else '' end end) end
  from (select *, case when here and cur = 4 + after[s + 1] then 'D' when cur = 3 + now[need + 1] then 'I' when here and not forced and nxt >= 0 and cur = more + after[nxt + 1] then 'K' else 'R' end as x from (
    select w.conv_id, w.t, w.s, w.audit, w.said, now.b as now, now.b[w.s + 1] as cur, after.b as after, e.t is not null as here, e.role, e.text, e.forced, e.more,
      case w.s when 2 then 3 else 2 end as need, case when e.kind = 1 and w.s = 0 then 1 when e.kind = 2 and w.s <> 2 then 2 when e.kind = 3 and w.s = 2 then 3 else -1 end as nxt
    from walk w join back now on now.conv_id is not distinct from w.conv_id and now.t = w.t left join back after on after.conv_id is not distinct from w.conv_id and after.t = w.t + 1
      left join e on e.conv_id is not distinct from w.conv_id and e.t = w.t) where here or cur > 0)),
done as (select conv_id, arg_max(audit, length(audit)) as audit, arg_max(said, length(audit)) as said from walk group by conv_id),
pair as (select *, lag(role[1]) over (partition by conv_id order by t) || role[1] as p from e),
per as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (more > 0 and not forced) as truncated,
  count(*) filter (p is not null and p not in ('su', 'ua', 'au')) as illegal from pair group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(back.b[1], 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(said, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join per on per.conv_id is not distinct from c.conv_id left join done on done.conv_id is not distinct from c.conv_id
  left join back on back.conv_id is not distinct from c.conv_id and back.t = 1
"""
