import itertools
import math
import re
import zlib
from collections import Counter

import pytest

from ledgerloom.llm import lattice_lm
from ledgerloom.llm.queries import TOKENIZERS
from ledgerloom.llm.sentencepiece_wfst import read_model

MODEL = read_model(f"{TOKENIZERS}/piece_bpe_32k.model")


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def plain(rows):
    train = [tokens(t) + [None] for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        ws = tokens(t) + [None]
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        out.append((i, held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)))
    return out


def all_ways(text, pieces, bytes_):
    if not text:
        return 1.0
    total = 0.0
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            total += math.exp(pieces[text[:n]]) * all_ways(text[n:], pieces, bytes_)
    if text[0] not in pieces:
        total += math.exp(sum(bytes_[b] for b in text[0].encode())) * all_ways(text[1:], pieces, bytes_)
    return total


def test_forward_recursion_sums_all_segmentations():
    pieces = {p: -0.3 * i - 1 for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "bab", "aba", "▁ab"])}
    lattice = lattice_lm.Lattice(pieces, [-5.0 - b / 100 for b in range(256)])
    for word in ["a", "abab", "é", "aébab", "abababab"]:
        assert lattice.word(word) == pytest.approx(math.log(all_ways("▁" + word, pieces, lattice.bytes)))
    assert math.isfinite(lattice.word("ab" * 20_000))


@pytest.mark.parametrize("head", [2_000_000, 3])
def test_rows(spark, monkeypatch, head):
    monkeypatch.setattr(lattice_lm, "HEAD", head)
    monkeypatch.setattr(lattice_lm, "COUNTED", 5)
    texts = [None, "", "The cat sat", "the CAT É É", "unseen words here", "a b c d e f g h " * 50, "the cat sat", "zz\x85y ▁x"]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(2, "The cat sat"), (9, "x" * 50_000), (10, "the dog"), (11, "dog ran")]
    df = spark.createDataFrame([(i, t, "w", 1.0) for i, t in rows], "doc_id long, text string, word string, score double")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lattice_lm.score(df, MODEL).collect())
    assert got == sorted((i is not None, i or 0, h, n, k, t, round(b, 6)) for i, h, n, k, t, b in plain(rows))
    assert all(r.score < 0 and math.isfinite(r.score) for r in lattice_lm.score(df, MODEL).collect())
    assert lattice_lm.score(df.where("false"), MODEL).count() == 0


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in lattice_lm.score(docs, MODEL).collect()}
    for i, h, n, k, t, b in plain(rows):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, k, t)
        assert r.base_score == pytest.approx(b, rel=1e-9)
    texts = dict(rows)
    flat = lattice_lm.Lattice.from_counts(MODEL, {}, 0)  # untrained: all pieces alike
    for r in got.values():
        if r.held_out and r.n_tokens > 50:
            assert r.score > sum(flat.word(w) for w in tokens(texts[r.doc_id])) / math.log(10)


def test_texts_have_at_most_one_together():
    """All texts of up to three words over two letters, beside all else that the pieces spell."""
    names = ["▁", "a", "▁a", "b", "ab"]
    p = math.log(1 / (len(names) + 257))
    lattice = lattice_lm.Lattice(dict.fromkeys(names, p), [p] * 256, p)
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("ab", repeat=n)]
    one = sum(math.exp(lattice.word(w)) for w in words)
    assert math.exp(lattice.end) * sum(one**k for k in range(4)) < 1
    # with no bytes and every piece a word's start, the words of all lengths and the end make up the whole
    lattice = lattice_lm.Lattice({"▁a": math.log(0.5), "▁b": math.log(0.25)}, [-math.inf] * 256, math.log(0.25))
    assert math.exp(lattice.end) / (1 - sum(math.exp(lattice.word(w)) for w in "ab")) == pytest.approx(1)


def test_a_mark_inside_a_word_is_spelled_by_bytes():
    lattice = lattice_lm.Lattice({"▁": -1.0, "a": -1.0, "▁a": -1.0}, [-2.0] * 256, -1.0)
    assert lattice.word("a▁a") == pytest.approx(lattice.word("a") - 6 - 1)


def test_trained_pieces_and_the_end_share_one_distribution():
    lattice = lattice_lm.Lattice.from_counts(MODEL, {300: 50, 400: 7}, 12)
    assert sum(map(math.exp, [*lattice.pieces.values(), *lattice.bytes, lattice.end])) < 1
