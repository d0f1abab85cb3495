import itertools
import math
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import sentencepiece_wfst as W
from ledgerloom.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/piece_bpe_32k.model"
spm = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no model file")


@pytest.fixture(scope="module")
def pair():
    return W.Transducer(W.Model.parse(W.read_model(PATH))), spm.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library_on_documents(pair, spark):
    t, sp = pair
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect():
        assert t.encode(r.text).tolist() == sp.encode(r.text), r.doc_id
        assert t.decode(t.encode(r.text).tolist()) == sp.decode(sp.encode(r.text)) == r.text


@given(st.text(max_size=40) | st.text(alphabet="ab  \n\r;)}▁é", max_size=40))
@settings(max_examples=1500, deadline=None)
def test_equals_the_library_on_any_text(text):
    t, sp = _PAIR
    if "\0" in text:
        return
    assert t.encode(text).tolist() == sp.encode(text)
    assert t.decode(t.encode(text).tolist()) == t.canonical(text)


_PAIR = (W.Transducer(W.Model.parse(W.read_model(PATH))), spm.SentencePieceProcessor(model_file=PATH)) if os.path.exists(PATH) else None


def test_unigram_path_is_the_best_of_all():
    rng = random.Random(1)
    names = ["<unk>", *"abc▁", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab"]
    m = W.Model(names, [0.0, *(-rng.uniform(1, 9) for _ in names[1:])], [W.UNKNOWN, *[W.NORMAL] * (len(names) - 1)])
    t = W.Transducer(m)
    for n in range(1, 7):
        for chars in itertools.product("abc ", repeat=n):
            text = "".join(chars)
            norm = t.normalise(text)
            best = math.inf
            for cuts in range(1 << max(0, len(norm) - 1)):
                parts, at = [], 0
                for i in range(1, len(norm) + 1):
                    if i == len(norm) or cuts >> (i - 1) & 1:
                        parts.append(norm[at:i])
                        at = i
                if all(p in t.ids for p in parts):
                    best = min(best, -sum(m.scores[t.ids[p]] for p in parts))
            if norm:
                assert -sum(m.scores[i] for i in t.encode(text).tolist()) == pytest.approx(best)
                assert t.decode(t.encode(text).tolist()) == t.canonical(text)


def test_unknown_characters_and_bytes():
    names = ["<unk>", "▁", "a"]
    plain = W.Transducer(W.Model(names, [0.0, -1.0, -2.0], [W.UNKNOWN, W.NORMAL, W.NORMAL]))
    assert plain.encode("azza").tolist() == [1, 2, 0, 2]
    names += [f"<0x{b:02X}>" for b in range(256)]
    m = W.Model(names, [0.0] * len(names), [W.UNKNOWN, W.NORMAL, W.NORMAL, *[W.BYTE] * 256], byte_fallback=True)
    t = W.Transducer(m)
    assert t.decode(t.encode("aé\n").tolist()) == "aé\n"


def test_fixed_pieces():
    m = W.Model(["<unk>", "▁", "a", "b", "<x>"], [0.0, -1.0, -2.0, -2.0, 0.0], [W.UNKNOWN, W.NORMAL, W.NORMAL, W.NORMAL, W.USER])
    t = W.Transducer(m)
    assert t.encode("a<x>b a").tolist() == [1, 2, 4, 3, 1, 2]
    assert t.decode(t.encode("a<x>b a").tolist()) == "a<x>b a"


def test_rows(spark):
    model = W.read_model(PATH)
    df = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (3, "word " * 50000, "y"), (3, "word " * 50000, "y"), (4, "ß中", "z")], "doc_id long, text string, ids string")
    out = W.encode(df, model)
    rows = out.collect()
    assert len(rows) == 5 and all(r.round_trip for r in rows)
    assert sorted(r.n_tokens for r in rows)[:2] == [0, 0]
    back = {r.doc_id: r.decoded for r in W.decode(out, model).collect()}
    assert back[4] == "ß中" and back[3] == "word " * 50000 and back[1] == ""
    assert W.encode(df.where("false"), model).count() == 0


def test_long_texts_without_cuts_and_ids_out_of_range(pair):
    t, sp = pair
    for text in ("ab" * 100_000, "9" * 100_000, "中" * 50_000):
        assert t.encode(text).tolist() == sp.encode(text)
    assert t.decode([10**6, -5]) == t.decode([t.unk, t.unk])
    assert t.merged("▁hello") == sp.encode("hello", out_type=str) and "".join(t.merged("zq" * 5000)) == "zq" * 5000


def test_character_map_takes_the_longest_rule():
    m = W.Model(["<unk>", "▁", "x"], [0.0, -1.0, -1.0], [W.UNKNOWN, W.NORMAL, W.NORMAL], rules={b"a": b"x", b"ab": b"xx", "é".encode(): b""})
    t = W.Transducer(m)
    assert t.normalise(" ab  aé c ") == "▁xx▁x▁c"


def test_words_end_where_no_piece_goes_on(pair):
    t, sp = pair
    assert t.between.findall("▁den,***▁Haus.\n\nñño") == ["▁den", ",***", "▁Haus", ".", "\n", "\n", "ñño"]
    t.paths.clear()
    words = [f"den{a}{b}" for a in ",.;!?" for b in "*#%&"]
    assert t.encode(" ".join(words)).tolist() == sp.encode(" ".join(words))
    assert len(t.paths) == 21  # the word once, and each pair of signs


def test_pairs_are_told_apart_as_merging_does(pair):
    t, _ = pair
    rng, names = random.Random(7), [p for p in t.ids if not p.isspace()]
    told = set()
    for _ in range(20_000):
        a, b = rng.choice(names), rng.choice(names).lstrip("▁") or "a"
        told.add(found := t.apart(a, b))
        assert found == (t.merged(a + b) == [a, b]), (a, b)
    assert told == {True, False}
    same = W.Transducer(W.Model(["<unk>", "a", "aa", "aaa"], [0.0, -3.0, -1.0, -1.0], [W.UNKNOWN, *[W.NORMAL] * 3], W.BPE))
    for n in range(1, 6):
        for m in range(1, 6):
            a, b = "a" * n, "a" * m
            assert same.apart(a, b) == (same.merged(a + b) == [a, b])
