"""Merges, skipped changesets, absence proofs and decisions against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import canon, shared
from ledgerloom.operators import dag, decisions, merkle, skipping, timeline


def ancestors(parents):
    out = {}
    for h in parents:  # parents come first
        out[h] = {h}.union(*(out[p] for p in parents[h] if p in out))
    return out


def made_dag(n, seed):
    r, parents, ops = random.Random(seed), {}, []
    for i in range(n):
        known = list(parents)
        near = known[-5:]
        parents[f"h{i}"] = [] if i == 0 or r.random() < 0.02 else r.sample(near, min(len(near), r.choice([1, 1, 1, 1, 2, 3])))
        for k in range(r.randint(0, 2)):
            ops.append(("g", f"h{i}", k, r.choice(["update", "update", "delete", "resolve"]), "node", r.choice("abcd"), f"r{r.randint(0, 2)}"))
    return parents, ops


@pytest.mark.parametrize("seed", [1, 2])
def test_merges(spark, seed):
    parents, ops = made_dag(60, seed)
    up = ancestors(parents)
    sets = spark.createDataFrame([("g", h, ps) for h, ps in parents.items()] + [("other", "h1", ["h0"])], "graph string, hash string, parents array<string>")
    rows = spark.createDataFrame([*ops, ("other", "h1", 0, "update", "node", "a", "r9")], "graph string, hash string, op_idx int, verb string, kind string, id string, rev string")
    heads = ["h59", "h58", "h40", "h7"]
    top = dag.maximal_writes(sets, rows, spark.createDataFrame([("g", h) for h in heads] + [("other", "h1")], "graph string, head string")).cache()
    want, states = set(), {("other", "h1", "a", "r9", False, False, 1)}
    for head in heads:
        for id_ in "abcd":
            last = {}
            for _, h, k, verb, _, i, rev in ops:
                if i == id_ and h in up[head]:
                    last[h] = (k, verb, rev)  # the last of its changeset
            best = {h: w for h, w in last.items() if not any(h in up[g] and h != g for g in last)}
            want |= {("g", head, id_, h, *w) for h, w in best.items()}
            if best:
                kinds = {"" if w[1] == "delete" else w[2] for w in best.values()}
                clash = len(kinds) > 1
                states.add(("g", head, id_, None if clash else min(w[2] for w in best.values()), None if clash else kinds == {""}, clash, len(best)))
    got = {(r.graph, r.head, r.id, r.hash, r.op_idx, r.verb, r.rev) for r in top.collect()}
    assert got - {("other", "h1", "a", "h1", 0, "update", "r9")} == want
    assert {(r.graph, r.head, r.id, r.rev, r.deleted, r.conflict, r.writers) for r in dag.resolved(top).collect()} == states
    assert seed != 1 or any(s[5] for s in states) and not all(s[5] for s in states)


def test_merges_move_numbers_not_names(spark, monkeypatch):
    made = {}

    def saved(df, name, plain=dag.saved):
        made.setdefault(name, []).append({t for _, t in df.dtypes})
        return plain(df, name)

    monkeypatch.setattr(dag, "saved", saved)
    sets = spark.createDataFrame([("g", "a", []), ("g", "b", ["a"]), ("g", "c", ["a"]), ("g", "d", ["b", "c"])], "graph string, hash string, parents array<string>")
    ops = spark.createDataFrame([("g", h, 0, "update", "node", "x", f"r{h}") for h in "abc"], "graph string, hash string, op_idx int, verb string, kind string, id string, rev string")
    top = dag.maximal_writes(sets, ops, spark.createDataFrame([("g", "d"), ("g", "b")], "graph string, head string"))
    assert {(r.head, r.hash) for r in top.collect()} == {("d", "b"), ("d", "c"), ("b", "b")}
    assert all(t == {"bigint"} for name in ("jumps", "ancestry") for t in made[name]) and made["last"][-1] == {"bigint"}


def test_a_long_line_is_one_segment(spark):
    n = 3000
    sets = spark.createDataFrame([("g", f"h{i}", [f"h{i - 1}"] if i else []) for i in range(n)], "graph string, hash string, parents array<string>")
    segs = dag.segments(sets).cache()
    assert segs.select("seg").distinct().count() == 1 and segs.agg(F.max("pos")).first()[0] == n - 1
    assert dag.ancestry(sets, segs).count() == 0


def made_log(n, seed):
    """Changesets of a few operations that mostly fit, some of them on top of what others broke."""
    r, out, live, known = random.Random(seed), [], {}, []
    for seq in range(1, n + 1):
        for i in range(r.randint(1, 3)):
            rev = f"v{seq}-{i}" if r.random() < 0.9 else "again"
            ref = (f"node:{r.choice(known)}", f"node:{r.choice(known)}") if known and r.random() < 0.4 else (None, None)
            if len(live) < 4 or r.random() < 0.25:
                id_ = f"k{seq}-{i}" if r.random() < 0.9 or not known else r.choice(known)
                out.append((seq, i, "create", "node", id_, *ref, None, rev))
                live[id_] = [rev]
                known.append(id_)
            else:
                id_ = r.choice(list(live))
                prior = r.choice(live[id_][-2:]) if r.random() < 0.9 else "nothing"
                verb = "delete" if r.random() < 0.1 else "update"
                out.append((seq, i, verb, "node", id_, *(ref if verb == "update" else (None, None)), prior, rev))
                live[id_].append(rev)
                if verb == "delete":
                    del live[id_]
    return out


def one_by_one(rows, barred):
    state, dead, out = {}, set(), {}
    for seq in sorted({x[0] for x in rows}):
        mine, gone, ok = dict(state), set(dead), seq not in barred
        for _, _, verb, kind, id_, a, b, prior, rev in [x for x in rows if x[0] == seq]:
            fits = id_ not in mine and id_ not in gone if verb == "create" else id_ in mine and mine[id_] == prior
            fits = fits and all(x is None or x.split(":")[1] in mine for x in (a, b))
            ok = ok and fits
            if verb == "delete":
                mine.pop(id_, None)
                gone.add(id_)
            else:
                mine[id_] = rev
                gone.discard(id_)
        out[seq] = "barred" if seq in barred else "folded" if ok else "dependent"
        if ok:
            state, dead = mine, gone
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_skipping(spark, seed):
    rows = made_log(50, seed)
    barred = {7, 13, 30}
    ops = spark.createDataFrame(rows, "seq long, op_idx int, verb string, kind string, id string, from_ref string, to_ref string, prior string, rev string")
    got = {r.seq: r.status for r in skipping.flagged(ops, spark.createDataFrame([(x,) for x in barred], "seq long")).collect()}
    assert got == one_by_one(rows, barred)
    assert len(set(got.values())) == 3


def test_a_long_chain_falls_in_few_rounds(spark, monkeypatch):
    rows = [(i, 0, "update" if i > 1 else "create", "node", "k", None, None, f"v{i - 1}" if i > 1 else None, f"v{i}") for i in range(1, 400)]
    ops = spark.createDataFrame(rows, "seq long, op_idx int, verb string, kind string, id string, from_ref string, to_ref string, prior string, rev string")
    got = {r.seq: r.status for r in skipping.flagged(ops, spark.createDataFrame([(3,)], "seq long"), max_rounds=3).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 399)] == ["folded", "folded", "barred", "dependent", "dependent"]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 21])
def test_absence(spark, n):
    keys = [("k", f"{2 * i:03}") for i in range(n)]
    leaves = [canon.state_leaf(k, i, "sha256:00", False) if hasattr(canon, "state_leaf") else f"sha256:{i:0>64}" for k, i in keys]
    level = spark.createDataFrame([(j, *k, leaf) for j, (k, leaf) in enumerate(zip(keys, leaves))], "idx long, kind string, id string, leaf string")
    top = canon.merkle_root(leaves, "state-node")
    asked = spark.createDataFrame([("k", f"{i:03}") for i in range(-1, 2 * n + 1)], "kind string, id string")
    got = {r.id: r for r in merkle.absence(level, asked, top, ["kind", "id"]).collect()}
    held = {k[1] for k in keys}
    for id_, r in got.items():
        below = sum(x <= id_ for x in held)
        assert (r.present, r.before, r.after) == (id_ in held, below - 1 if below else None, below if below < n else None)
        assert r.absent == (id_ not in held)
    assert len(got) == 2 * n + 2
    if n > 2:  # with a leaf hidden, the proof of its key fails
        holes = level.where("idx <> 1").select(F.when(F.col("idx") > 1, F.col("idx") - 1).otherwise(F.col("idx")).alias("idx"), "kind", "id", "leaf")
        assert not merkle.absence(holes, spark.createDataFrame([keys[1]], "kind string, id string"), top, ["kind", "id"]).first().absent


@pytest.mark.parametrize("span", [1 << 16, 2])
def test_outcomes(spark, monkeypatch, span):
    monkeypatch.setattr(timeline.running, "__defaults__", ("ref", span))
    r, rows = random.Random(5), []
    asked = [(f"p{i}", r.choice([None, 0, 1, 2, 3])) for i in range(40)]
    for p, _ in asked[:36]:
        rows += [(p, r.randint(1, 6), r.choice("abcd"), r.choice(["approve"] * 5 + ["reject"])) for _ in range(r.randint(0, 6))]
    got = decisions.outcomes(spark.createDataFrame(asked, "subject string, quorum int"), spark.createDataFrame(rows, "subject string, seq int, principal string, verdict string"))
    for x in got.collect():
        quorum, mine = dict(asked)[x.subject] or 0, [y for y in rows if y[0] == x.subject]
        at, status, have = None, "admitted" if quorum == 0 else "pending", set()
        for seq in range(1, 7) if quorum else ():
            have |= {y[2] for y in mine if y[1] == seq and y[3] == "approve"}
            if any(y[1] == seq and y[3] == "reject" for y in mine):
                at, status = seq, "rejected"
            elif len(have) >= quorum:
                at, status = seq, "admitted"
            if at:
                break
        assert (x.status, x.at) == (status, at), (x, mine)
        assert x.late == (0 if status == "pending" else sum(y[1] > (at or -1) for y in mine))


def test_outcomes_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(shared, "SHARE", 40)
    r = random.Random(6)
    asked = [(f"p{i}", r.choice([None, 0, 1, 2, 3])) for i in range(60)] + [(None, 0), (None, 1)]
    rows = [(r.choice([None, *(p for p, _ in asked[:50])]), r.choice([None, -2, -1, *range(6)]), r.choice(["a", "b", "c", None]), r.choice(["approve"] * 3 + ["reject", None])) for _ in range(300)]
    n = len(asked) + len(rows)
    got = decisions.outcomes(spark.createDataFrame(asked, "subject string, quorum int"), spark.createDataFrame(rows, "subject string, seq int, principal string, verdict string"), rows=n)
    assert got.schema.simpleString() == "struct<subject:string,status:string,at:int,approvals:bigint,late:bigint>"
    assert got.rdd.getNumPartitions() == -(-n // 40) > 8  # not the four of spark.sql.shuffle.partitions, nor joined to fewer
    want = []
    for p, q in asked:
        mine, quorum, inf = [y for y in rows if y[0] == p and p is not None], q or 0, 99
        first = {y[2]: min((z[1] for z in mine if z[2] == y[2] and z[3] == "approve" and z[1] is not None), default=None) for y in mine if y[3] == "approve" and y[2]}
        timed = sorted(x for x in first.values() if x is not None)
        met = timed[quorum - 1] if 0 < quorum <= len(timed) else inf
        no = min((y[1] for y in mine if y[3] == "reject" and y[1] is not None), default=inf)
        status = "admitted" if not quorum or met < no else "rejected" if no < inf else "pending"
        at = None if status == "pending" or not quorum else min(met, no)
        approvals = len(first) if status == "pending" else sum(at is not None and x <= at for x in timed)
        late = 0 if status == "pending" else sum(y[1] is not None and y[1] > (-1 if at is None else at) for y in mine)
        want.append((p, status, at, approvals, late))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {x[1] for x in want} == {"admitted", "rejected", "pending"}


@pytest.mark.parametrize("span", [1 << 16, 3])
def test_keys_in_force(spark, monkeypatch, span):
    monkeypatch.setattr(timeline.running, "__defaults__", ("ref", span))
    r = random.Random(8)
    windows = [(r.choice("abc"), r.choice([None, *range(20)]), r.choice([None, *range(25)])) for _ in range(40)] + [(None, 0, None)]
    signed = [(r.choice(["a", "b", "c", "d", None]), r.randint(-1, 30), n) for n in range(120)]
    got = decisions.in_force(spark.createDataFrame(signed, "key string, seq int, n int"), spark.createDataFrame(windows, "key string, since int, until int"))
    for x in got.collect():
        assert x.valid == any(k == x.key and a is not None and a <= x.seq and (b is None or x.seq < b) for k, a, b in windows if k is not None), x
    assert got.count() == 120


def test_cardinality(spark):
    r, rows, live = random.Random(4), [], {}
    for seq in range(1, 60):
        for i in range(r.randint(0, 2)):
            if live and r.random() < 0.4:
                id_ = r.choice(list(live))
                live.pop(id_)
                rows.append((seq, i, "delete", "edge", id_, None, None, None))
            else:
                live[f"e{seq}-{i}"] = 1
                rows.append((seq, i, "create", "edge", f"e{seq}-{i}", r.choice(["p/one@1", "p/many", "p/free"]), f"node:{r.choice('ab')}", f"node:{r.choice('xyz')}"))
    ops = spark.createDataFrame(rows, "seq long, op_idx int, verb string, kind string, id string, type string, from_ref string, to_ref string")
    limits = {"p/one": ("from_ref", "to_ref"), "p/many": ("from_ref",), "p/free": ()}
    want, state = {}, {}
    for seq in range(1, 60):
        for x in rows:
            if x[0] == seq:
                state.pop(x[4], None) if x[2] == "delete" else state.update({x[4]: x})
        count = {}
        for x in state.values():
            edge = x[5].split("@")[0]
            for side in limits[edge]:
                k = (edge, side, x[6] if side == "from_ref" else x[7])
                count[k] = count.get(k, 0) + 1
        for k, n in count.items():
            if n > 1:
                want.setdefault(k, (seq, n))
    table = spark.createDataFrame([("p/one", "one-to-one"), ("p/many", "many-to-one"), ("p/free", "many-to-many")], "edge string, cardinality string")
    got = {tuple(x)[:3]: tuple(x)[3:] for x in timeline.cardinality(ops, timeline.versions(ops), table).collect()}
    assert got == want and len(want) > 3


def test_stale(spark):
    from ledgerloom.operators import graph

    r = random.Random(6)
    derived = [(f"d{i}", f"d{r.randrange(60)}" if r.random() < 0.8 else None, r.randint(0, 50)) for i in range(60) for _ in range(r.randint(0, 2))] + [("a", "b", 1), ("b", "a", 1), ("b", "d0", 1)]
    changed = [(f"d{r.randrange(60)}", r.randint(0, 40)) for _ in range(4)] + [("d0", 9), (None, 9)]
    late = {}
    for ref, at in changed:
        late[ref] = max(at, late.get(ref, -1))
    want = {d: 1 for d, s, at in derived if s is not None and late.get(s, -1) > at}
    depth = 1
    while new := {d for d, s, _ in derived if s is not None and want.get(s) == depth} - set(want):
        depth += 1
        want |= dict.fromkeys(new, depth)
    got = graph.stale(spark.createDataFrame(derived, "ref string, source string, at int"), spark.createDataFrame(changed, "ref string, at int"))
    assert {x.ref: x.depth for x in got.collect()} == want and max(want.values()) > 2 and {"a", "b"} <= set(want)
    assert graph.stale(got.select("ref", "ref", F.lit(1)).toDF("ref", "source", "at").where("false"), spark.createDataFrame(changed, "ref string, at int")).count() == 0


def test_elided_logs(spark):
    from ledgerloom.operators import elision, fold

    r, rows, live = random.Random(12), [], {}
    for seq in range(1, 40):
        for i in range(r.randint(1, 5)):
            id_ = r.choice(list(live)) if live and r.random() < 0.6 else f"k{seq}-{i}"
            verb = "create" if id_ not in live else "delete" if r.random() < 0.2 else "update"
            rev = f"sha256:{seq:032}{i:032}"
            rows.append((f"h{seq}", seq, i, rev, verb, "node", id_, live.get(id_), rev if verb != "delete" else None))
            live[id_] = rev
            if verb == "delete":
                live.pop(id_)
    schema = "hash string, seq long, op_idx int, leaf string, verb string, kind string, id string, prior string, rev string"
    ops = spark.createDataFrame(rows, schema)
    shown = {x[:3] for x in rows if r.random() < 0.8 and x[1] < 30 or x[1] >= 34 or x[1] == 5}
    key = F.concat_ws("/", "hash", "op_idx")
    held = elision.elide(ops, key.isin([f"{h}/{i}" for h, _, i in shown])).cache()
    assert held.where("hidden and (id is not null or verb is not null or rev is not null)").count() == 0
    want = {}
    for x in rows:
        want.setdefault(x[0], []).append(x[3])
    assert {x.hash: x.root for x in elision.roots(held).collect()} == {h: canon.merkle_root(v, "op-node") for h, v in want.items()}

    whole = {x.id: (x.rev, x.deleted) for x in fold.latest_state(ops).collect()}
    last_hidden = max((x[1], x[2]) for x in rows if x[:3] not in shown)
    told = elision.known_state(held).collect()
    assert {x.id for x in told} == {x[6] for x in rows if x[:3] in shown} and {x.status for x in told} == {"known", "unknown", "gone"}
    for x in told:
        mine = [y for y in rows if y[:3] in shown and y[6] == x.id]
        if x.status == "known":  # and so it is in the whole log
            assert whole[x.id] == (x.rev, False) and (mine[-1][1], mine[-1][2]) > last_hidden
        elif x.status == "gone":
            assert whole[x.id][1] and any(y[4] == "delete" for y in mine)
        else:
            assert (mine[-1][1], mine[-1][2]) < last_hidden and x.rev == mine[-1][8]

    assert elision.impossible(held).count() == 0  # what is withheld explains every gap
    lied = ops.withColumn("prior", F.when(F.col("seq") == 37, "sha256:0").otherwise(F.col("prior")))
    bad = elision.impossible(elision.elide(lied, F.lit(True)))
    assert {(x.seq, x.op_idx) for x in bad.collect()} == {(x[1], x[2]) for x in rows if x[1] == 37 and x[4] != "create"} != set()
    assert elision.impossible(elision.elide(lied, F.col("seq") != 36)).count() <= bad.count()


def test_absence_builds_only_the_paths_of_gaps(spark, monkeypatch):
    from ledgerloom.functions.shared import saved

    n, written = 40, {}
    rows = [(i, "k", f"{2 * i:03}", canon.domain_hash("leaf", b"%d" % i)) for i in range(n)]
    level = spark.createDataFrame(rows, "idx long, kind string, id string, leaf string")
    asked = [("k", "011"), ("k", "0111"), ("k", "012"), ("j", "x"), ("z", "x")]

    def counted(df, name):
        out = saved(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(merkle, "saved", counted)
    top = merkle.root(level.select("idx", "leaf"), block=8).first()["root"]
    assert top == canon.merkle_root([r[3] for r in rows], "state-node")
    got = {r.kind + r.id: (r.present, r.before, r.after, r.absent) for r in merkle.absence(level, spark.createDataFrame(asked, "kind string, id string"), top, ["kind", "id"]).collect()}
    assert got == {"k011": (False, 5, 6, True), "k0111": (False, 5, 6, True), "k012": (True, 6, 7, False), "jx": (False, None, 0, True), "zx": (False, n - 1, None, True)}
    assert written["proofs"] == [4]  # of 40 leaves: 0, 5, 6 and 39
    some = merkle.paths(level.select("idx", "leaf"), block=8, only=spark.createDataFrame([(3,), (39,)], "idx long")).collect()
    assert {r.idx: (r.leaf, [tuple(x) for x in r.proof]) for r in some} == {i: (rows[i][3], canon.merkle_path([r[3] for r in rows], i, "state-node")) for i in (3, 39)}


def test_lone_objects_need_no_rounds(spark):
    """Objects that nothing else touches are folded in one go, whatever their histories; two that share a changeset still get rounds."""
    r, rows, live = random.Random(9), [], {}
    for seq in range(1, 200):
        id_ = r.choice("abc")
        for i in range(r.choice([1, 1, 2])):
            verb = r.choice(["create", "update", "update", "update", "delete", "redact-document"] if r.random() < 0.3 else ["update"])
            prior = r.choice([live.get(id_), live.get(id_), f"v{seq - 3}-0", None])
            rows.append((seq, i, verb if seq > 6 else "create", "node", id_, None, None, prior, f"v{seq}-{i}"))
            live[id_] = f"v{seq}-{i}"
    schema = "seq long, op_idx int, verb string, kind string, id string, from_ref string, to_ref string, prior string, rev string"
    barred = {x for x in range(1, 200) if x % 11 == 3}

    def told(rows):
        out = skipping.flagged(spark.createDataFrame(rows, schema), spark.createDataFrame([(x,) for x in barred], "seq long"), max_rounds=0 if rows[-1][0] < 300 else 100)
        return {x.seq: x.status for x in out.collect()}

    plain = [(*x[:2], x[2] if x[2] != "redact-document" else "nothing", *x[3:]) for x in rows]

    def walked(rows):
        last, out = {}, {}
        for seq in sorted({x[0] for x in rows}):
            mine, ok = dict(last), seq not in barred
            for _, _, verb, _, id_, _, _, prior, rev in [x for x in rows if x[0] == seq]:
                was = mine.get(id_)
                fits = was is None if verb == "create" else verb in ("update", "delete") and was is not None and not was[0] and prior is not None and prior == was[1]
                ok = ok and fits
                if verb in ("create", "update", "delete"):
                    mine[id_] = (verb == "delete", rev)
            out[seq] = "barred" if seq in barred else "folded" if ok else "dependent"
            last = mine if ok else last
        return out

    assert told(plain) == walked(plain) and set(walked(plain).values()) == {"folded", "barred", "dependent"}
    more = [*plain, (300, 0, "create", "node", "d", None, None, None, "w1"), (300, 1, "create", "node", "e", None, None, None, "w2"), (301, 0, "update", "node", "e", None, None, "w2", "w3")]
    assert told(more) == walked(more) and told(more)[301] == "folded"
