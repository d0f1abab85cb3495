"""The SimHash index: links of fingerprints by segments with one bit deleted (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of up to so many fingerprints are compared by shifting; longer ones by expanding fronts.
SHIFTS = 32


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the fewest segments of 64 bits of which, at ``bits`` differing bits, one differs by one bit at most."""
    n = bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _variants(bits: int) -> list:
    """One key for each bit of the fingerprint: that bit's segment with the bit taken out, and the bit's place."""
    keys = []
    for shift, width in segments(bits):
        part = F.shiftrightunsigned(F.col("fp"), shift)
        for i in range(width):
            left = part.bitwiseAND(F.lit(signed(((1 << width) - 1) & ~(1 << i))))
            # a hash may join two keys, which costs a comparison and changes nothing
            keys.append(F.xxhash64(left, F.lit(shift + i)) if width > 57 else F.shiftleft(left, 6).bitwiseOR(F.lit(shift + i)))
    return keys


class _Forest:
    """Union-find over what one task has linked; tells which links are new to it."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _run_links(run: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within one long run of equal keys.

    A front of linked fingerprints is compared with those not reached yet only,
    so a dense group is done in a few passes, and it gets as many links as it
    has members rather than all pairs.
    """
    rest = np.unique(run)
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            one, front = front[:64], front[64:]
            near = np.bitwise_count(one[:, None] ^ rest[None, :]) <= bits
            hit = near.any(0)
            if hit.any():
                yield one[near[:, hit].argmax(0)], rest[hit]
                front = np.concatenate([front, rest[hit]])
                rest = rest[~hit]


def _links(bits: int):
    """From rows (key, fp) that are sorted by key: a spanning forest of the links at ``bits`` differing bits or fewer."""

    def complete(keys: np.ndarray, fps: np.ndarray, forest: _Forest) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        found = []
        for s, n in zip(starts[sizes > SHIFTS], sizes[sizes > SHIFTS]):
            found += _run_links(fps[s : s + n], bits)
        short = np.repeat((sizes > 1) & (sizes <= SHIFTS), sizes)
        k, f = keys[short], fps[short]
        for d in range(1, SHIFTS):
            at = np.flatnonzero(k[d:] == k[:-d])
            if not len(at):
                break
            at = at[np.bitwise_count(f[at] ^ f[at + d]) <= bits]
            found.append((f[at], f[at + d]))
        a, b = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.uint64)]) for i in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        kept = np.array([p for p in pairs.tolist() if forest.join(*p)], dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(kept[:, 0].copy()), pa.array(kept[:, 1].copy())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = _Forest(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            keys = held[-1][0]
            if keys[0] == keys[-1] and held[0][0][-1] == keys[-1]:
                continue  # one key so far: its run goes on
            ks, fs = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            end = int(np.searchsorted(ks, ks[-1]))
            held = [(ks[end:], fs[end:])]
            if (out := complete(ks[:end], fs[:end], forest)).num_rows:
                yield out
        if held and (out := complete(*(np.concatenate([h[i] for h in held]) for i in (0, 1)), forest)).num_rows:
            yield out

    return run


def links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fps(fp)`` that connect exactly what Hamming distances up to ``bits`` connect.

    The 64 bits are cut into ``bits // 2 + 1`` segments, so that of two linked
    fingerprints one segment differs by a bit at most.  Each fingerprint is
    indexed below 64 keys, a segment with one bit taken out; equal keys meet in
    one sorted run, where the whole fingerprints are compared.  No pairs leave a
    run, only a forest over its members.
    """
    keyed = fps.select(F.explode(F.array(*_variants(bits))).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(bits), "a long, b long").distinct()
