import hashlib
import json
import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import bpe_prefix
from ledgerloom.llm.queries import TOKENIZERS, op13_bpe

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def data():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def codec(data):
    return bpe_prefix.Codec(data)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_random_texts_equal_the_library(codec, library):
    r = random.Random(7)
    parts = ["a", "b", "the ", "ing", " ", "  ", "\n", "'s", "'ll", "'", "é", "中", "文", "١", "½", "Ᲊ", "\U00013460", "<|endoftext|>", "<|endof", "!", "--", "\x1c", "　", "\x85", "ſ", "\U0001f600", "0", "12", "Th", "er", "́", "\x00"]
    for k in range(8000):
        text = "".join(r.choice(parts) if k % 2 else chr(r.choice([r.randrange(128), r.randrange(0x3000), r.randrange(0xE000, 0x20000)])) for _ in range(r.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids, ascii(text)
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_character_is_of_the_library_s_kind(codec, library):
    letters = bpe_prefix.byte_letters()
    for c in range(0x20000):
        if 0xD800 <= c < 0xE000 or (0x3400 < c < 0xA000 or 0xAC00 < c < 0xD700 or 0x17000 < c < 0x18C00) and c % 97:
            continue  # long runs of one kind
        text = f"a{chr(c)}1{chr(c)}."
        assert [x[0] for x in library.pre_tokenizer.pre_tokenize_str(text)] == ["".join(letters[b] for b in w.encode()) for part in codec._found(text) for w in part], hex(c)


def test_words_equal_plain_merging():
    """A vocabulary of its own, with runs of equal letters; each word by the definition: the first rank, the leftmost of equals."""
    letters = bpe_prefix.byte_letters()
    merges = [("a", "a"), ("a", "b"), ("aa", "aa"), ("b", "a"), ("ab", "ab"), ("aa", "ab"), ("aaaa", "b"), ("c", "ab"), ("abab", "aa")]
    names = [*letters, *(a + b for a, b in merges)]
    said = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel"}, "added_tokens": [], "model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(names)}, "merges": merges}}
    codec, rank = bpe_prefix.Codec(json.dumps(said).encode()), {m: k for k, m in enumerate(merges)}
    r = random.Random(3)
    for _ in range(3000):
        word = "".join(r.choice("aaabbc") for _ in range(r.randint(1, 14)))
        parts = list(word)
        while found := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]:
            i = min(found)[1]
            parts[i : i + 2] = ["".join(parts[i : i + 2])]
        assert [names[i] for i in codec.word(word.encode())] == parts


def test_decode(codec, library):
    r = random.Random(5)
    for _ in range(2000):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert codec.decode([1 << 30, 50256]) == "<|endoftext|>"


def test_long_words_take_linear_time(codec, library):
    r = random.Random(1)
    for text in ("a" * 400_000, " " * 400_000, "".join(r.choice("etaoin") for _ in range(400_000)), "ab cd" * 300_000):
        start = time.time()
        ids = codec.encode(text)
        assert time.time() - start < 20
        assert codec.decode(ids.tolist()) == text
        assert codec.encode(text[:50_000]).tolist() == library.encode(text[:50_000], add_special_tokens=False).ids


def test_query(spark, library):
    sf = "/root/testdata/sf0.01"
    rows = op13_bpe(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_frames(spark, data, codec):
    texts = [None, "", "same text", "same text", "x" * 300_000]
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe_prefix.decode(bpe_prefix.encode(df, data), data).collect()
    assert sorted((r.doc_id is not None, r.decoded) for r in rows) == sorted((i > 0, t or "") for i, t in enumerate(texts))
    assert all(r.n_tokens == len(r.ids) and r.ids == codec.encode(r.decoded).tolist() for r in rows)
    assert bpe_prefix.query(df, data).count() == 5
    for f in (bpe_prefix.encode, bpe_prefix.query):
        assert f(df.where("false"), data).count() == 0
