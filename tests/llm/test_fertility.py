import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import fertility
from ledgerloom.llm.queries import TOKENIZERS

FILES = fertility.read_vocabularies(TOKENIZERS)


def plain(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def got(text):
    ws, *rest = fertility.base(text)
    return (len(ws), *rest)


@given(st.text(alphabet="ab \n\t\x1c\x85é#|", max_size=120))
@settings(max_examples=500, deadline=None)
def test_base(text):
    assert got(text) == plain(text)


def test_measures_equal_the_libraries():
    m = fertility.Measure(*FILES)
    for text in ["The theory of everything, and more.", "a", "日本語 ééé ▁x \x85y", "word " * 50]:
        ws = text.encode().split()
        n, n_level, n_bytes, entropy = m(ws)
        pieces = [p for w in ws for p in m.pieces.encode(w.decode())]
        assert n == len(pieces) and n_bytes == sum(m.pieces.is_byte(p) for p in pieces)
        assert n_level == sum(len(m.bytes.encode_ordinary(" " + w.decode())) for w in ws)
        assert 0 <= entropy <= 1 + 1e-9
        assert m(ws) == (n, n_level, n_bytes, entropy)


def test_scripts():
    assert [fertility.script(x) for x in ("abc", "", "12", "привет", "日本", "日本の", "αβγ", "été")] == ["latin", "other", "other", "cyrillic", "han", "kana", "greek", "latin"]


def test_rows(spark):
    good = "the quick brown fox jumps over a lazy dog while seven wise men watch from their quiet garden near old stone walls today "
    texts = [None, "", " \n ", good, good + "again", "### $$$ " * 40, good * 20, "x" * 100_000, "short"]
    df = spark.createDataFrame([(i or None, t, "zz", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    rows = {r.doc_id: r for r in fertility.query(df, TOKENIZERS).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i or None]
        want = plain(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert rows[3].kept and rows[4].kept and not rows[5].kept
    assert fertility.query(df.where("false"), TOKENIZERS).count() == 0
    assert fertility.query(df.drop("lang"), TOKENIZERS).count() == len(texts)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = {r.doc_id: r for r in fertility.query(docs, TOKENIZERS).collect()}
    for d in docs.collect():
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(d.text)
    good = [rows[i].kept for i, q in labels.items() if q == 1 and not rows[i].base_failed]
    bad = [rows[i].kept for i, q in labels.items() if q == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.4


def test_verdicts_do_not_hang_on_other_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = {r.doc_id: r.kept for r in fertility.query(docs, TOKENIZERS).collect()}
    few = fertility.query(docs.where("lang = 'es'").limit(30), TOKENIZERS).collect()
    assert len(few) == 30 and all(r.kept == whole[r.doc_id] for r in few)
    junk = " ".join(f"xq{a}zv{b}k{a}w" for a in "bcdfghj" for b in "klmnpqr")
    greek = " ".join(f"{a}\u0384\u1f4d{b}\u1fb7\u1f77" for a in "\u03be\u03c8\u03b6\u03c7\u03c6" for b in "\u1f96\u1fa5\u1f87\u1fe2\u1f6f")
    rows = [(1, junk, "zz"), (2, junk, None), (3, greek, "el")]
    assert not any(r.kept for r in fertility.query(spark.createDataFrame(rows, "doc_id long, text string, lang string"), TOKENIZERS).collect())
