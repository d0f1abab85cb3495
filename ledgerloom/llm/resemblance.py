"""Near-duplicates by exact Jaccard likeness of word shingles (the deduplication stage's rule)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lowered_words, sliced, spread
from .components import roots
from .simhash_index import links

#: A shingle that so many sets have is common; shingles that a task counts at a time.
COMMON, COUNTED = 8, 1 << 18
#: Common shingles that a task is told, the commonest; the rest only cost time.
MOST_COMMON = 200_000
#: Sets that a task remembers, so as not to give the keys of a copy again.
REMEMBERED = 100_000
#: Rows of a block; the rows of a longer run are compared block by block, in as many tasks as it has pairs of blocks.
BLOCK = 4096
#: Members of the sets of a block, where sets are compared exactly.
MEMBERS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(32)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words has one, of all of them, and one without words none."""
    words = lowered_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    one = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    n = max(1, len(one) - width + 1)
    h = np.full(n, min(width, len(one)), np.uint64)
    for j in range(min(width, len(one))):
        h = (h ^ one[j : j + n]) * _MIX[0]
        h = (h ^ (h >> _MIX[2])) * _MIX[1]
        h ^= h >> _MIX[2]
    return np.unique(h)


def set_id(found: np.ndarray) -> int:
    """A set of shingles as a signed long; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64)) if len(found) else 0


def least_shared(n, likeness: float):
    """How many members of a set of n another must share to be as like."""
    return np.ceil(n * likeness - 1e-9).astype(np.int64)


def _prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray, likeness: float) -> np.ndarray:
    """The shingles of which two sets that are as like share one: the first by hash, the common ones last."""
    size = len(found) - int(least_shared(len(found), likeness)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        hit = common[at] == found
        if hit.any():
            found = np.concatenate([found[~hit], found[hit][np.argsort(rank[at[hit]], kind="stable")]])
    return found[:size]


def _merged(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with the sums of their counts; of more than COUNTED the commonest stay, less the count of the first that goes (so a count is short by at most a COUNTED-th of all)."""
    h, at = np.unique(np.concatenate(held), return_inverse=True)
    n = np.bincount(at, np.concatenate(counts), len(h)).astype(np.int64)
    if len(h) > COUNTED:
        n = n - np.partition(n, len(n) - COUNTED - 1)[len(n) - COUNTED - 1]
        h, n = h[n > 0], n[n > 0]
    return h, n


def _common(docs: DataFrame, width: int, likeness: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts have, sorted, and their order by frequency.

    Counted over all texts; a task keeps the commonest of what it has met, in
    bounded memory, and sends those that it has met twice.  The order only
    tells how fast the search is, never what it finds.
    """
    none = np.zeros(0, np.uint64)

    def run(batches):
        seen, held, counts, size = set(), [none], [np.zeros(0, np.int64)], 0
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                found = shingles(text, width)
                if not len(found) or (name := set_id(found)) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(name)
                held.append(found)
                counts.append(np.ones(len(found), np.int64))
                size += len(found)
                if size > 4 * COUNTED:
                    h, n = _merged(held, counts)
                    held, counts, size = [h], [n], len(h)
        h, n = _merged(held, counts)
        h, n = h[n > 1], n[n > 1]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    rows = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    rows = rows.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    h = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - np.arange(len(h)))[order]


def parity(found: np.ndarray) -> bytes:
    """A bit for each of 2^k buckets, 2^k at least twice the members: whether the bucket holds an odd number of them.

    Two sets differ in no fewer members than their parities in bits; halves of
    a parity, added without carry, are that of half as many buckets.
    """
    k = max(6, int(2 * len(found)).bit_length())
    odd = np.bincount((found & np.uint64((1 << k) - 1)).astype(np.int64), minlength=1 << k) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def simhash_of(found: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles as a signed long: a bit is 1 if over half of the members have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big", signed=True)


def _measured(docs: DataFrame, width: int, likeness: float) -> DataFrame:
    """(doc_id, tid, fp, n, keys, sim, odd) for each row of docs; a task gives what belongs to a set once, with its keys."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, width, likeness))
    names = ["doc_id", "tid", "fp", "n", "keys", "sim", "odd"]

    def run(batches):
        seen: set[int] = set()
        for batch in sliced(batches):
            fps, ns, keys, sims, odds = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, width)
                fps.append(set_id(found))
                ns.append(len(found))
                new = len(found) > 0 and fps[-1] not in seen
                if new and len(seen) < REMEMBERED:
                    seen.add(fps[-1])
                keys.append(_prefix(found, *shared.value, likeness).view(np.int64) if new else None)
                sims.append(simhash_of(found) if new else None)
                odds.append(parity(found) if new else None)
            columns = [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(ns, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sims, pa.int64()), pa.array(odds, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "tid", "text").mapInArrow(run, "doc_id long, tid long, fp long, n long, keys array<long>, sim long, odd binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of whole runs of equal keys (first column) of rows that are sorted by it, many runs at a time."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        keys = held[-1][0]
        if keys[0] == keys[-1] and held[0][0][-1] == keys[-1]:
            continue
        whole = [np.concatenate(c) for c in zip(*held)]
        end = int(np.searchsorted(whole[0], whole[0][-1]))
        held = [[c[end:] for c in whole]]
        if end:
            yield [c[:end] for c in whole]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _may_be(n_a, p_a, n_b, p_b, likeness: float):
    """Whether two sets of these sizes can be as like if the first member that they share has these places in their orders."""
    return (1 + likeness) * np.minimum(n_a - p_a, n_b - p_b) >= likeness * (n_a + n_b) - 1e-6


def _stars(likeness: float):
    """From rows (key, fp, n, place) in order: each member b of a run with its first member a, and whether they can be as like."""
    names = ["key", "a", "b", "n_a", "n_b", "p_a", "p_b", "close"]

    def run(batches):
        for keys, fps, ns, ps in _runs(batches):
            new = np.r_[True, (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])]
            keys, fps, ns, ps = keys[new], fps[new], ns[new], ps[new]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            first = np.repeat(starts, np.diff(np.r_[starts, len(keys)]))
            b = np.flatnonzero(first != np.arange(len(keys)))
            a = first[b]
            close = _may_be(ns[a], ps[a], ns[b], ps[b], likeness)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[b], fps[a], fps[b], ns[a], ns[b], ps[a], ps[b], close)], names)

    return run


STARS = "key long, a long, b long, n_a long, n_b long, p_a int, p_b int, close boolean"


class _Parities:
    """Parities of a run's sets, which come in order of size, by width; those of twice a width are also kept folded to it."""

    def __init__(self, odds: list[bytes]):
        self.width = np.array([len(x) for x in odds])
        self.at, self.whole, self.half = np.zeros(len(odds), np.int64), {}, {}
        for w in np.unique(self.width).tolist():
            mine = np.flatnonzero(self.width == w)
            self.at[mine] = np.arange(len(mine))
            self.whole[w] = np.frombuffer(b"".join([odds[i] for i in mine]), np.uint8).reshape(len(mine), w)
            self.half[w] = self.whole[w][:, : w // 2] ^ self.whole[w][:, w // 2 :]

    def apart(self, i: int, j: np.ndarray) -> np.ndarray:
        """The least number of members in which set i and each of the sets j, none smaller, can differ."""
        w, out = int(self.width[i]), np.zeros(len(j), np.int64)
        row = self.whole[w][self.at[i]]
        for width, table in ((w, self.whole), (2 * w, self.half)):
            mine = np.flatnonzero(self.width[j] == width)
            if len(mine):
                out[mine] = np.bitwise_count(table[width][self.at[j[mine]]] ^ row).sum(1, dtype=np.int64)
        return out


def _reach(n, place, likeness: float):
    """The size of the largest set that can be as like one of n members if the first that they share is at this place of its order."""
    return (1 + likeness) * (n - place) / likeness - n + 1e-6


def _apart_yet(rows: DataFrame, likeness: float) -> DataFrame:
    """The rows of the runs in which links may be missing.

    A run needs rows of two roots, and a row that reaches sets no smaller than
    its own, as the smaller of two alike sets does: in it the shared member
    stands in the first ninth or so (at 0.8).  So sets that bring more than
    that of their own are never compared, however many share the rest.
    """
    leads = _reach(F.col("n"), F.col("place"), likeness) >= F.col("n")
    runs = rows.groupBy("key").agg(F.max(leads).alias("any"), F.min("root").alias("x"), F.max("root").alias("y"))
    return rows.join(cut(runs.where("any and x <> y").select("key"), "runs"), "key", "left_semi")


def _dealt(rows: DataFrame, size, most: int) -> DataFrame:
    """rows with unit, block and alone: runs whose size (an aggregate) is more than ``most`` are cut into units of two blocks."""
    runs = cut(rows.groupBy("key").agg(F.ceil(size / most).alias("blocks")), "runs")
    dealt = rows.join(runs, "key").withColumn("block", F.expr("pmod(xxhash64(fp), blocks)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    unit = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.select(unit.alias("unit"), F.when(F.col("blocks") > 1, F.col("block")).otherwise(-1).alias("block"), *rows.columns, (F.col("block") == F.col("other")).alias("alone"))


def _units(rows: DataFrame, kinds: DataFrame, likeness: float) -> DataFrame:
    """(unit, block, key, fp, n, place, root, odd, alone): the runs in which links may be missing, long ones cut into units of two blocks of BLOCK rows."""
    units = _dealt(_apart_yet(rows, likeness), F.count("*"), BLOCK).join(kinds.select("fp", "odd"), "fp")
    return units.select("unit", "block", "key", "fp", "n", "place", "root", "odd", "alone")


def _unit(likeness: float, ns, ps, blocks, alone, tops, odds: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Of rows in order of size: a row and the rows after it with another top that sizes, places and parities don't rule out; tops may change meanwhile."""
    reach = _reach(ns, ps, likeness)
    ends = np.searchsorted(ns, reach, "right")  # larger sets that may be as like
    parities = _Parities(odds)
    for i in np.flatnonzero(ends > np.arange(len(ns)) + 1).tolist():
        j = np.arange(i + 1, ends[i])
        j = j[(tops[j] != tops[i]) & (reach[j] >= ns[i]) & (alone[i] | (blocks[j] != blocks[i]))]
        j = j[(ns[i] + ns[j] - parities.apart(i, j)) * (1 + likeness) >= 2 * likeness * (ns[i] + ns[j]) - 1e-6]
        if len(j):
            yield i, j


def _open(units, tops) -> Iterator[slice]:
    """The units that have rows of two tops."""
    starts = np.flatnonzero(np.r_[True, units[1:] != units[:-1]])
    for s, e in zip(starts, np.r_[starts[1:], len(units)]):
        if e - s > 1 and not (tops[s:e] == tops[s]).all():
            yield slice(s, e)


def _doubtful(likeness: float):
    """From rows (unit, block, key, fp, n, place, root, odd, alone) in order: the rows (key, fp) that may be linked to another of their unit and are not yet, each once."""

    def run(batches):
        for units, blocks, keys, fps, ns, ps, tops, odds, alone in _runs(batches):
            said = np.zeros(len(units), bool)
            for at in _open(units, tops):
                order = at.start + np.argsort(ns[at], kind="stable")
                for i, j in _unit(likeness, ns[order], ps[order], blocks[order], alone[order], tops[order], odds[order].tolist()):
                    said[order[i]] = True
                    said[order[j]] = True
            yield pa.RecordBatch.from_arrays([pa.array(keys[said]), pa.array(fps[said])], ["key", "fp"])

    return run


def _forest(likeness: float):
    """From rows (unit, block, key, fp, n, place, root, alone, members) in order: links (a, b) of sets as like, fewer than rows, that connect all that are linked in a unit."""

    def run(batches):
        for units, blocks, _, fps, ns, ps, roots_, alone, sets in _runs(batches):
            got = []
            for at in _open(units, roots_):
                order = at.start + np.argsort(ns[at], kind="stable")
                f, n, found = fps[order], ns[order], sets[order]
                tops = np.unique(roots_[order], return_inverse=True)[1]
                names, members = np.unique(np.concatenate(found), return_inverse=True)
                members, has = np.split(members, np.cumsum(n)[:-1]), np.zeros(len(names), bool)
                for i, js in _unit(likeness, n, ps[order], blocks[order], alone[order], tops, [parity(x.view(np.uint64)) for x in found]):
                    has[members[i]] = True
                    for j in js.tolist():
                        if tops[j] != tops[i] and (both := np.count_nonzero(has[members[j]])) >= likeness * (n[i] + n[j] - both) - 1e-9:
                            got.append((f[i], f[j]))
                            tops[tops == tops[j]] = tops[i]
                    has[members[i]] = False
            pairs = np.sort(np.array(got, np.int64).reshape(-1, 2), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy()) for i in (0, 1)], ["a", "b"])

    return run


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _possible(pairs: DataFrame, kinds: DataFrame, likeness: float) -> DataFrame:
    """The pairs (a, b) that their sizes and parities don't rule out; what is ruled out is certainly less like."""

    def run(batches):
        for batch in sliced(batches):
            keep = []
            for na, nb, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
                keep.append((na + nb - apart) * (1 + likeness) >= 2 * likeness * (na + nb) - 1e-6)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = pairs.join(kinds.withColumnsRenamed({"fp": "a", "n": "na", "odd": "x"}), "a").join(kinds.withColumnsRenamed({"fp": "b", "n": "nb", "odd": "y"}), "b")
    return sides.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, kinds: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """(fp, members) of the sets that are named; other texts are not moved."""
    tids = cut(kinds.join(named, "fp", "left_semi").select("tid").distinct(), "texts")

    def sets(batches):
        for batch in sliced(batches, 64):
            found = [shingles(text, width) for text in batch.column(0).to_pylist()]
            marks = pa.array(np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32))
            members = pa.ListArray.from_arrays(marks, pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(map(set_id, found), pa.int64()), members], ["fp", "members"])

    texts = docs.select("text", "tid").join(tids, "tid", "left_semi").dropDuplicates(["tid"]).select("text")
    return cut(texts.mapInArrow(sets, "fp long, members array<long>"), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, kinds: DataFrame, width: int, likeness: float) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard likeness reaches the limit; texts of sets that are in no possible pair are not moved."""
    pairs = cut(_possible(pairs, kinds, likeness), "pairs")
    named = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    found = _sets(docs, kinds, named, width)
    sides = pairs.join(found.withColumnsRenamed({"fp": "a", "members": "x"}), "a").join(found.withColumnsRenamed({"fp": "b", "members": "y"}), "b")
    both = F.size(F.array_intersect("x", "y"))
    return sides.where(both >= likeness * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def _near_simhash(measured: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b) of sets that SimHash links (equal, or within ``bits`` bits by deletion variants): candidates like any other."""
    named = cut(measured.where("sim is not null").select("sim", "fp").distinct(), "sims")
    sims = cut(named.groupBy("sim").agg(F.min("fp").alias("a")), "sims")
    same = named.join(sims, "sim").where("a <> fp").select("a", F.col("fp").alias("b"))
    found = links(sims.select(F.col("sim").alias("fp")), bits)
    one, two = sims.select(F.col("sim").alias("s"), F.col("a").alias("x")), sims.select(F.col("sim").alias("t"), F.col("a").alias("y"))
    near = found.join(one, found["a"] == one["s"]).join(two, found["b"] == two["t"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(near)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, likeness: float = 0.8, bits: int = 4) -> DataFrame:
    """One row (doc_id, fp, component_id, root_fp) for each row of docs; fp names the text's set of shingles.

    Linked are exactly the sets whose Jaccard likeness reaches the limit.
    Candidates are what the SimHash index links, and, as most pairs at the
    limit are some ten bits apart, the sets that share one of their first n -
    ceil(likeness * n) + 1 members, in an order that is the same for all: two
    sets that are as like must.  The common shingles come last in it, so a
    passage of many texts brings them together only where little else is in
    them.  Each run of a shared key is first compared with one of its members,
    and then pair by pair only where that left it apart, so copies of one text
    cost no pairs; long runs are compared in blocks, over many tasks.  Pairs are ruled out by sizes, by the key's places in both
    orders and by parities before any text is moved; what is left of a run is compared exactly where it lies, and only links
    that connect something are passed on, fewer than the run has rows.  Shingles and sets go by 64-bit hashes.  Nulls and repeated rows
    as in simhash.
    """
    text = F.col(text_col).cast("string")
    docs = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text")))
    measured = cut(_measured(docs, width, likeness), "measured")
    kinds = cut(measured.where("odd is not null").groupBy("fp").agg(F.min_by(F.struct("tid", "n", "odd"), "tid").alias("x")).select("fp", "x.tid", "x.n", "x.odd"), "kinds")
    keyed = measured.where("keys is not null").select(F.posexplode("keys").alias("place", "key"), "fp", "n").select("key", "fp", "n", "place")
    stars = cut(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_stars(likeness), STARS), "stars")
    first = cut(stars.where("close").select("a", "b").unionByName(_near_simhash(measured, bits)).distinct(), "pairs")
    linked = cut(_confirmed(first, docs, kinds, width, likeness), "linked")
    long = stars.groupBy("key").count().where("count > 1").select("key")
    members = stars.join(long, "key", "left_semi")
    members = members.select("key", F.col("b").alias("fp"), F.col("n_b").alias("n"), F.col("p_b").alias("place")).unionByName(members.select("key", F.col("a").alias("fp"), F.col("n_a").alias("n"), F.col("p_a").alias("place")).distinct())
    tree = cut(roots(linked).withColumnRenamed("node", "fp"), "tree")
    rooted = cut(members.join(tree, "fp", "left").select("key", "fp", "n", "place", F.coalesce("root", "fp").alias("root")), "rooted")
    units = _units(rooted, kinds, likeness)
    doubtful = cut(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_doubtful(likeness), "key long, fp long").distinct(), "doubtful")
    if doubtful.limit(1).count():
        units = _dealt(rooted.join(doubtful, ["key", "fp"], "left_semi"), F.sum("n"), MEMBERS).join(_sets(docs, kinds, doubtful.select("fp").distinct(), width), "fp")
        units = units.select("unit", "block", "key", "fp", "n", "place", "root", "alone", "members").repartition("unit").sortWithinPartitions("unit")
        more = cut(units.mapInArrow(_forest(likeness), "a long, b long").distinct(), "linked")
        tree = cut(roots(linked.unionByName(more)).withColumnRenamed("node", "fp"), "tree")
    nodes = measured.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(tree, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root_fp"))
    named = nodes.groupBy("root_fp").agg(F.min("least").alias("component_id"))
    classes = cut(nodes.join(named, "root_fp").select("fp", "component_id", "root_fp"), "classes")
    return measured.select("doc_id", "fp").join(classes, "fp").select("doc_id", "fp", "component_id", "root_fp")
