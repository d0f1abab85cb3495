"""SentencePiece encoding and decoding as shortest paths of weighted transducers (operator 1).

A model is compiled to transducers.  N, the normaliser, is a trie of the
character map's rules, taken by longest match, followed by the white space
machine.  P, the pieces, is a trie whose states that end a piece have an arc
back to the start that reads nothing, writes the piece's id and weighs minus
its score.  B, the byte fallback, has an arc from the start for every character
that is no piece; it writes the ids of its bytes.  F, a filter over pieces,
says which piece may follow which: for a unigram model any (one state); for a
BPE model, whose pieces weigh nothing, only one such that merging the joint
text gives back just the two, so the state is the last piece.  What F lets
through is exactly the encoding that merging gives.

Encoding composes N(text) with (P + B)* o F, arc by arc as the search reaches
them, and takes the shortest path of the tropical semiring.  All arcs lead
forward in the text.  Without a filter the only states are positions, settled
in their order.  With the BPE filter all paths weigh the same, so the first
complete one is a shortest; arcs are tried longest first, and as the path to a
position is that prefix's only one, a position from which none leads on is
dead whatever came before.  Either way time grows with the text's length.

No piece crosses certain cuts (before a space mark that follows other text,
between characters that no pieces join, such as letters and full stops), so
paths are searched between cuts and kept by their text; the sum over a text is
the same path.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, spread

MARK = "▁"
# The kinds of pieces and models in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNK_PENALTY = 10.0
#: Texts between cuts whose paths a task keeps (some 200 bytes each), and two thirds more pairs of pieces whose verdict it keeps; beyond it the memory is emptied.
KEPT = 150_000


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0]
            at += n


def _charsmap(blob: bytes) -> dict[bytes, bytes]:
    """The rules of a precompiled character map: walks its double-array trie."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    rules, todo = {}, [(0, b"")]

    def offset(u):
        return (u >> 10) << ((u & 512) >> 6)

    while todo:
        node, key = todo.pop()
        base = node ^ offset(units[node])
        for c in range(256):
            at = base ^ c
            if at < len(units) and units[at] & 0x800000FF == c and (c or units[node] & 256):
                if c:
                    todo.append((at, key + bytes([c])))
                else:
                    start = units[at] & 0x7FFFFFFF
                    rules[key] = texts[start : texts.index(b"\0", start)]
    return rules


@dataclass
class Model:
    """What a model file holds."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    type: int = UNIGRAM
    byte_fallback: bool = False
    rules: dict[bytes, bytes] = field(default_factory=dict)
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                m.pieces.append(f.get(1, b"").decode("utf-8", "surrogateescape"))
                m.scores.append(f.get(2, 0.0))
                m.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                m.type, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                m.rules = _charsmap(f.get(2, b""))
                m.dummy_prefix, m.squeeze, m.escape = (bool(f.get(i, 1)) for i in (3, 4, 5))
        return m


class Trie:
    """A transducer over symbols: ``arcs[state]`` has the state that each symbol leads to, ``leave[state]`` what the arc back to the start writes."""

    def __init__(self):
        self.arcs: list[dict] = [{}]
        self.leave: list = [None]

    def add(self, symbols, output) -> None:
        at = 0
        for x in symbols:
            to = self.arcs[at].get(x)
            if to is None:
                to = self.arcs[at][x] = len(self.arcs)
                self.arcs.append({})
                self.leave.append(None)
            at = to
        self.leave[at] = output


class _Paths(dict):
    """What the shortest path writes for each text between cuts, as bytes; found when it is first asked for, and kept while there is room."""

    def __init__(self, owner: Transducer):
        self.owner = owner

    def __missing__(self, text: str) -> bytes:
        found = array("i", self.owner.path(text)).tobytes()
        if len(text) <= 64:
            if len(self) >= self.owner.kept:
                self.clear()
            self[text] = found
        return found


class Transducer:
    """A compiled model: normalise, encode (to 32-bit ids) and decode."""

    START, FALLBACK = -2, -1

    def __init__(self, model: Model, kept: int = KEPT):
        self.model, self.kept, self.kept_pairs = model, kept, 5 * kept // 3
        if model.type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are transducers of this kind")
        self.bpe = model.type == BPE
        named = {p: i for i, p in enumerate(model.pieces)}
        self.unk = model.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL and p}
        self.named = named
        self.bytes = [named.get(f"<0x{b:02X}>") for b in range(256)] if model.byte_fallback else None
        self.rules, self.pieces = Trie(), Trie()
        for source, target in model.rules.items():
            self.rules.add(source, target)
        for p, i in self.ids.items():
            self.pieces.add(p, (i, 0.0 if self.bpe else -model.scores[i]))
        self.tree = self._tree()
        self.score = {p: model.scores[i] for p, i in self.ids.items()}
        lowest = min((model.scores[i] for i in self.ids.values()), default=0.0)
        self.fallback = 1.0 if self.bpe else UNK_PENALTY - lowest
        self.out = [self._surface(i) for i in range(len(model.pieces))]
        self.is_byte = np.array([k == BYTE for k in model.kinds])
        self.pairs: dict[int, bool] = {}
        self.paths = _Paths(self)
        #: What lies between cuts; None where pieces may cross a space mark.
        self.between = None if any(MARK in p.lstrip(MARK) for p in self.ids) else self._between()
        #: Pieces that a user has fixed stand for themselves wherever they occur.
        user = sorted((p for p, k in zip(model.pieces, model.kinds) if k == USER and p), key=len, reverse=True)
        self.fixed = re.compile("(" + "|".join(map(re.escape, user)) + ")") if user else None

    def _between(self) -> re.Pattern:
        """Runs of characters that pieces join, directly or by way of others, and all other characters one by one; marks belong to what follows.

        Where neighbours are of different runs no piece has both, so nothing is merged across.
        """
        up: dict[str, str] = {}
        doubled = set()

        def top(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        for p in self.ids:
            body = p.lstrip(MARK)
            for c in body:
                up.setdefault(c, c)
            for a, b in zip(body, body[1:]):
                if a == b:
                    doubled.add(a)
                up[top(b)] = top(a)
        runs: dict[str, list[str]] = {}
        for c in up:
            runs.setdefault(top(c), []).append(c)
        joined = ["".join(re.escape(c) for c in sorted(r)) for r in sorted(runs.values(), key=len, reverse=True) if len(r) > 1 or r[0] in doubled]
        some = "|".join([*(f"[{r}]+" for r in joined), f"[^{MARK}{''.join(joined)}]"])
        return re.compile(f"{MARK}+(?:{some})?|{some}")

    def _tree(self) -> dict:
        """The pieces' trie as nested dictionaries; 0 has (length, piece) of all that end on the way to a state, shortest first, with the fallback where its first character is no piece."""
        tree: dict = {0: ((1, self.FALLBACK),)}
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            at = tree
            for c in p[:-1]:
                at = at.setdefault(c, {0: at[0]})
            before = at[0] if len(p) > 1 else ()
            at.setdefault(p[-1], {})[0] = (*before, (len(p), i))
        return tree

    def _surface(self, i: int) -> bytes:
        m = self.model
        if m.kinds[i] == BYTE:
            return bytes([int(m.pieces[i][3:5], 16)])
        if m.kinds[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if m.kinds[i] == UNKNOWN else m.pieces[i].replace(MARK, " ").encode("utf-8", "surrogateescape")

    # N

    def _map(self, text: str) -> str:
        """The rules' trie: the longest rule that starts at a byte is written, else the character."""
        data, out, at, arcs, leave = text.encode("utf-8", "surrogatepass"), [], 0, self.rules.arcs, self.rules.leave
        while at < len(data):
            state, to, found, end = 0, at, None, at
            while to < len(data) and (state := arcs[state].get(data[to])) is not None:
                to += 1
                if leave[state] is not None:
                    found, end = leave[state], to
            if found is None:
                end = at + (1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4)
                found = data[at:end]
            out.append(found)
            at = end
        return b"".join(out).decode("utf-8", "replace")

    def normalise(self, text: str) -> str:
        """The text that N writes.

        The white space machine has three states: before any text, in text, and
        after spaces that follow text.  It writes the dummy prefix when it
        leaves the first, one mark for a run of spaces when it leaves the
        third, and nothing for spaces at either end; without squeezing every
        space writes a mark and only the first state differs.  Runs of text
        write themselves, so they are copied whole.
        """
        m = self.model
        if m.rules:
            text = self._map(text)
        mark = MARK if m.escape else " "
        out = mark.join(x for x in text.split(" ") if x) if m.squeeze else text.replace(" ", mark)
        return mark + out if out and m.dummy_prefix else out

    # F

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives, by the definition: the best pair first, the leftmost of equals."""
        scores, ids, n = self.model.scores, self.ids, len(text)
        size, left, heap = [1] * n, list(range(-1, n - 1)), []  # sizes by start, 0 where a part has been taken
        for a in range(n - 1):
            if (i := ids.get(text[a : a + 2])) is not None:
                heap.append((-scores[i], a, a + 1, a + 2))
        heapq.heapify(heap)
        while heap:
            _, a, b, end = heapq.heappop(heap)
            if not size[a] or not size[b] or a + size[a] != b or b + size[b] != end:
                continue  # one of the two has been merged since
            size[a], size[b] = end - a, 0
            if end < n:
                left[end] = a
                to = end + size[end]
                if (i := ids.get(text[a:to])) is not None:
                    heapq.heappush(heap, (-scores[i], a, end, to))
            if (c := left[a]) >= 0 and (i := ids.get(text[c:end])) is not None:
                heapq.heappush(heap, (-scores[i], c, a, end))
        return [text[a : a + size[a]] for a in range(n) if size[a]]

    def apart(self, left: str, right: str) -> bool:
        """Whether merging the joint text of two texts gives back just these, as merged() tells; ends at the first merge across."""
        parts, border, score, none = [*left, *right], len(left) - 1, self.score.get, float("-inf")
        near = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while near and (best := max(near)) > none:
            at = near.index(best)
            if at == border:
                return False
            border -= at < border
            del near[at]
            parts[at] += parts.pop(at + 1)
            if at:
                near[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(near):
                near[at] = score(parts[at] + parts[at + 1], none)
        return len(parts) == 2

    def follows(self, state: int, piece: int) -> bool:
        """Whether F has an arc for the piece in a state, which for BPE is the last piece."""
        if not self.bpe or state == self.FALLBACK or piece == self.FALLBACK:
            return True
        key = state << 32 | piece if state >= 0 else -piece
        ok = self.pairs.get(key)
        if ok is None:
            text = self.model.pieces
            if len(self.pairs) >= self.kept_pairs:
                self.pairs.clear()
            ok = self.apart(text[state], text[piece]) if state >= 0 else self.merged(text[piece]) == [text[piece]]
            self.pairs[key] = ok
        return ok

    # composition and search

    def arcs_from(self, text: str, at: int) -> list[tuple[int, int, float]]:
        """(end, piece, weight) of the arcs that (P + B)*, at its start, has for what the text reads from ``at``, shortest first."""
        arcs, leave = self.pieces.arcs, self.pieces.leave
        out, state, to, n = [], 0, at, len(text)
        while to < n and (state := arcs[state].get(text[to])) is not None:
            to += 1
            if leave[state] is not None:
                out.append((to, *leave[state]))
        if not out or out[0][0] > at + 1:
            out.insert(0, (at + 1, self.FALLBACK, self.fallback))
        return out

    def path(self, text: str) -> list[int]:
        """What the shortest path writes for a text without cuts.

        Where equal scores leave a BPE text without a path, merging itself tells.
        """
        if self.bpe:
            if (ids := self._first(text)) is not None:
                return ids
            found = [(p, self.ids.get(p, self.FALLBACK)) for p in self.merged(text)]
        else:
            found = self._shortest(text)
        return [x for p, i in found for x in self._ids(p, i)]

    def _shortest(self, text: str) -> list[tuple[str, int]]:
        n = len(text)
        best, back = [0.0] + [float("inf")] * n, [(0, 0)] * (n + 1)
        for at in range(n):
            cost = best[at]
            for end, piece, weight in self.arcs_from(text, at):
                if cost + weight < best[end]:
                    best[end], back[end] = cost + weight, (at, piece)
        out, at = [], n
        while at:
            start, piece = back[at]
            out.append((text[start:at], piece))
            at = start
        return out[::-1]

    def _first(self, text: str) -> list[int] | None:
        tree, n, follows, pairs, dead, chars = self.tree, len(text), self.follows, self.pairs, set(), [*text, None]
        at, last, stack, arcs = 0, self.START, [], None
        while at < n:
            if arcs is None:  # arcs_from(), without weights, as they don't matter here
                state, to = tree, at
                while (far := state.get(chars[to])) is not None:
                    state = far
                    to += 1
                arcs = state[0]
                k = len(arcs)
            while k:
                k -= 1
                size, piece = arcs[k]
                if dead and at + size in dead:
                    continue
                ok = pairs.get(last << 32 | piece) if last >= 0 and piece >= 0 else None
                if ok or (ok is None and follows(last, piece)):
                    stack.append((at, last, arcs, k))
                    at, last, arcs = at + size, piece, None
                    break
            else:
                dead.add(at)
                if not stack:
                    return None
                at, last, arcs, k = stack.pop()
        ids = [x[1] for x in stack[1:]]
        ids.append(last)
        if self.FALLBACK in ids:
            return [x for (a, *_), i in zip(stack, ids) for x in self._ids(text[a], i)]
        return ids

    def _ids(self, piece: str, i: int):
        if i >= 0:
            return (i,)
        if self.bytes:
            return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return (self.unk,)

    def encode(self, text: str | None) -> np.ndarray:
        if not text or not (norm := self.normalise(text)):
            return np.zeros(0, np.int32)
        if self.fixed:
            parts = [np.array([self.named[p]], np.int32) if k % 2 else self._search(p) for k, p in enumerate(self.fixed.split(norm)) if p]
            ids = np.concatenate(parts)
        else:
            ids = self._search(norm)
        if not self.bytes and len(ids) > 1:  # unknown pieces in a row are one
            ids = ids[np.r_[True, (ids[1:] != self.unk) | (ids[:-1] != self.unk)]]
        return ids

    def _search(self, norm: str) -> np.ndarray:
        if self.between is None:
            return np.array(self.path(norm), np.int32)
        paths = self.paths
        return np.frombuffer(b"".join([paths[s] for s in self.between.findall(norm)]), np.int32)

    def decode(self, ids) -> str:
        out = self.out
        try:
            data = b"".join([out[i] for i in ids])
        except IndexError:
            data = b"".join([out[i] if 0 <= i < len(out) else out[self.unk] for i in ids])
        if self.model.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")

    def canonical(self, text: str | None) -> str:
        """What decoding an encoded text gives, if every character has a path: the normalised text."""
        norm = self.normalise(text or "").replace(MARK, " ")
        return norm[1:] if self.model.dummy_prefix and norm[:1] == " " else norm


_BUILT: dict[int, Transducer] = {}


def _built(data: bytes, kept: int = KEPT) -> Transducer:
    """One compiled model for each worker process."""
    key = hash(data)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Transducer(Model.parse(data))
    t = _BUILT[key]
    t.kept, t.kept_pairs = kept, 5 * kept // 3
    return t


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """(doc_id, ids, n_tokens, n_byte_tokens, round_trip) for each row of docs; ``kept`` trades a task's memory for time.

    round_trip tells whether decoding ids gives the normalised text.  A null or
    empty text has no ids; ids, nulls and repeated rows stay as they are, an
    empty table gives no rows, other columns are not looked at, and a very long
    text takes time in proportion to its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        t = _built(shared.value, kept)
        for part in sliced(batches, 256):
            found, same = [], []
            for text in part.column(1).to_pylist():
                ids = t.encode(text)
                found.append(ids)
                same.append(t.decode(ids.tolist()) == t.canonical(text))
            sizes = np.array([len(x) for x in found], np.int64)
            flat = np.concatenate(found)
            marks = np.r_[0, np.cumsum(sizes)]
            n_bytes = np.diff(np.r_[0, np.cumsum(t.is_byte[flat])][marks])
            lists = pa.ListArray.from_arrays(pa.array(marks.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes), pa.array(n_bytes.astype(np.int64)), pa.array(same)], ["doc_id", "ids", "n_tokens", "n_byte_tokens", "round_trip"])
        t.paths.clear()  # a task's own; what stays with the worker is the compiled model

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(narrow).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean")


def decode(tokens: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """tokens with the text of its ids added; null ids give null, ids out of range are unknown pieces.

    Empty ids give an empty text, repeated rows stay repeated, an empty table
    gives no rows, and a column that is called like ``out_col`` gives way to it.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(ids):
        t = _built(shared.value)
        return ids.map(lambda x: None if x is None else t.decode(x))

    return tokens.withColumn(out_col, text(F.col(ids_col)))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
