"""BPE encoding by per-prefix dynamic programming, and decoding (operator 13)."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, spread

#: Words and pairs of tokens that a task remembers; what is beyond is only computed again.
KEPT_WORDS, KEPT_PAIRS = 300_000, 500_000
#: Characters from which a word is not remembered, and from which a text's words are not listed at once.
LONG_WORD, LONG_TEXT = 64, 1 << 20
NEVER = 1 << 62

# White space, and the letters and numbers that Unicode 16.0 has and 15.1 has not (first-last).
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEW_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"


def _ranges(kind: str, new: str) -> list[tuple[int, int]]:
    """The code points of a general category and of the ranges ``new``, as (first, last)."""
    more = [tuple(int(x, 16) for x in r.split("-")) for r in new.split()]
    known = {c for a, b in more for c in range(a, b + 1)}
    out: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == kind or c in known:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return [(a, b) for a, b in out]


def _patterns() -> list[tuple[str, re.Pattern]]:
    """(greatest character, pattern) of the words of byte-level BPE; narrow alphabets have faster patterns."""
    letters, numbers, out = _ranges("L", NEW_LETTERS), _ranges("N", NEW_NUMBERS), []
    for top in (0x7F, 0xFFFF, sys.maxunicode):

        def chars(ranges, top=top):
            return "".join(f"{re.escape(chr(a))}-{re.escape(chr(min(b, top)))}" for a, b in ranges if a <= top)

        n, w = chars(numbers), WHITE if top > 0x7F else r"\t-\r\x20"
        a = chars(letters)
        out.append((chr(top), re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{a}]+| ?[{n}]+| ?[^{w}{a}{n}]+|[{w}]+(?![^{w}])|[{w}]+")))
    return out


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself where it can be seen, else the next from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


class Codec:
    """A byte-level BPE vocabulary (the JSON file of the tokenizers library), compiled.

    A token is reached if merging its bytes gives it.  Of the reached tokens
    that end at a place of a word exactly one stays next to the last token of
    what is before it, and that one is the last token of the prefix.
    """

    def __init__(self, data: bytes):
        said = json.loads(data)
        model, before = said["model"], said["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or said["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE model: {odd}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]):
            raise ValueError("added tokens that strip or want whole words")
        self.prefix_space = before.get("add_prefix_space", False)
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.added = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.text: dict[int, bytes] = {i: bytes(byte[c] for c in t) for t, i in model["vocab"].items() if t not in self.added}
        self.text.update({i: t.encode() for t, i in self.added.items()})
        self._merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self._automaton()
        self.patterns, self.pairs, self.words = _patterns(), {}, {}

    def _merges(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        """Ranks of pairs, and each token's history at its two ends: the parts there, smallest first, with the rank at which each goes into the next."""
        self.rank, left, right, born = {}, {}, {}, {}
        for i, t in self.text.items():
            if len(t) == 1:
                left[i] = right[i] = ((i, NEVER),)
                born[i] = -1
        self.left, self.right = left, right
        for r, (a, b) in enumerate(merges):
            self.rank[vocab[a] << 32 | vocab[b]] = r
        for r, (a, b) in enumerate(merges):
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            if not (born.get(a, NEVER) < r and born.get(b, NEVER) < r):
                raise ValueError(f"merge {r} stands before its parts")
            if c not in born and self.apart(a, b, r):
                left[c] = (*left[a][:-1], (a, r), (c, NEVER))
                right[c] = (*right[b][:-1], (b, r), (c, NEVER))
                born[c] = r

    def apart(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether no merge below rank ``until`` crosses the border of tokens a and b.

        Both sides grow as they do alone; parts that touch are merged if their
        rank comes before either goes into its next part.  Of equal ranks the
        left place is first.
        """
        xs, ys, i, j, rank = self.right[a], self.left[b], 0, 0, self.rank
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            r = rank.get(x << 32 | y)
            if r is not None and r < until and r < x_ends and r <= y_ends:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _automaton(self) -> None:
        """Suffix automaton of the reached tokens: arcs by state and byte, the state of the longest proper suffix, and the tokens that end in a state."""
        self.arcs: dict[int, int] = {}
        token, shorter, children = [-1], [0], deque()
        for i in self.left:
            state = 0
            for b in self.text[i]:
                to = self.arcs.get(state << 8 | b)
                if to is None:
                    to = self.arcs[state << 8 | b] = len(token)
                    token.append(-1)
                    shorter.append(0)
                    children.append((state, b, to))
                state = to
            token[state] = i
        if sum(k < 256 for k in self.arcs) < 256:
            raise ValueError("the vocabulary lacks single bytes")
        depth = [0] * len(token)
        for state, _, to in children:
            depth[to] = depth[state] + 1
        ends: list[tuple] = [()] * len(token)
        for state, b, to in sorted(children, key=lambda x: depth[x[2]]):
            back = shorter[state]
            while state and (found := self.arcs.get(back << 8 | b)) is None:
                back = shorter[back]
            shorter[to] = found if state else 0
            own = ((token[to], depth[to]),) if token[to] >= 0 else ()
            ends[to] = own + ends[shorter[to]]
        self.shorter, self.ends = shorter, ends

    def word(self, data: bytes) -> array:
        """The ids of a word, by its prefixes' last tokens; time in proportion to its length."""
        arcs, shorter, ends, pairs, state = self.arcs, self.shorter, self.ends, self.pairs, 0
        last = array("i", bytes(4 * (len(data) + 1)))
        for at, b in enumerate(data, 1):
            while (to := arcs.get(state << 8 | b)) is None:
                state = shorter[state]
            state = to
            for token, size in ends[state]:
                if size == at:
                    break
                key = last[at - size] << 32 | token
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= KEPT_PAIRS:
                        pairs.clear()
                    ok = pairs[key] = self.apart(last[at - size], token)
                if ok:
                    break
            last[at] = token
        out, at = array("i"), len(data)
        while at:
            out.append(last[at])
            at -= len(self.text[last[at]])
        out.reverse()
        return out

    def _found(self, text: str) -> Iterator[list[str]]:
        top = max(text)
        pattern = next(p for most, p in self.patterns if top <= most)
        if len(text) < LONG_TEXT:
            yield pattern.findall(text)
            return
        each = pattern.finditer(text)
        while part := [m[0] for m in islice(each, 1 << 16)]:
            yield part

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; a null text is empty.  Strings of added tokens are those tokens."""
        out: list[bytes] = []
        for part in self.marks.split(text or "") if self.marks else [text or ""]:
            if not part:
                continue
            if part in self.added:
                out.append(array("i", [self.added[part]]).tobytes())
                continue
            if self.prefix_space and not part[0].isspace():
                part = " " + part
            for words in self._found(part):
                out.append(self._words(words))
        return np.frombuffer(b"".join(out), np.int32)

    def _words(self, found: list[str]) -> bytes:
        known = self.words
        try:
            return b"".join([known[w] for w in found])
        except KeyError:
            out = []
        for w in found:
            ids = known.get(w)
            if ids is None:
                ids = self.word(w.encode("utf-8", "surrogatepass")).tobytes()
                if len(w) < LONG_WORD:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids) -> str:
        """The text of ids; ids that are no tokens are left out, bytes that are no UTF-8 become U+FFFD."""
        text = self.text
        try:
            data = b"".join([text[i] for i in ids])
        except KeyError:
            data = b"".join([text.get(i, b"") for i in ids])
        return data.decode("utf-8", "replace")


_BUILT: dict[int, Codec] = {}


def _built(data: bytes) -> Codec:
    """One compiled vocabulary for each worker process."""
    key = hash(data)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Codec(data)
    return _BUILT[key]


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens) for each row of docs.

    A null or empty text has no ids; doc_id, nulls and repeated rows stay as
    they are, an empty table gives no rows, other columns are not looked at,
    and a very long text, or word, takes time in proportion to its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        c = _built(shared.value)
        for part in sliced(batches, 256):
            found = [c.encode(t) for t in part.column(1).to_pylist()]
            sizes = np.array([len(x) for x in found], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes)], ["doc_id", "ids", "n_tokens"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>, n_tokens long")


def decode(tokens: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """tokens with the text of its ids added; null ids give null."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        c = _built(shared.value)
        return pa.array([None if x is None else c.decode(x) for x in ids.to_pylist()], pa.string())

    return tokens.withColumn(out_col, text(F.col(ids_col)))


def query(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, decoded again and digested in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        c = _built(shared.value)
        for part in sliced(batches, 256):
            sizes, ids_sha, text_sha = [], [], []
            for text in part.column(1).to_pylist():
                ids = c.encode(text)
                sizes.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4")).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _narrow(docs, "doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
