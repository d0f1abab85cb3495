import corpus_pipeline
from ledgerloom.llm import mixing, pii, resemblance, toxicity

from test_resemblance import classes


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    raw, clean, single, redacted, mixed, tokens = seen
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in clean.collect()}
    assert sum(i in left for i, t in labels.items() if not t) >= 0.99 * sum(not t for t in labels.values())
    assert sum(i in left for i, t in labels.items() if t) <= 0.2 * sum(t for t in labels.values())
    found = resemblance.near_duplicates(clean).collect()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in found}
    assert all(not any(pii.base_spans(r.text).values()) for r in redacted.collect())
    assert all(r.n_chars == len(r.text) for r in redacted.collect())
    assert redacted.count() == single.count()
    assert tokens.count() == mixed.count() and all(r.round_trip for r in tokens.collect())
    for df in seen:
        df.unpersist()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0


def test_rejection_is_the_model_s(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = toxicity.query(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r.doc_id for r in scored.where("not rejected").collect()} == {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()}


CLASHES = "fp string, fp_there string, id_there string, doc_id_ string, source_ string, tie string, n string, copies string, text_ string, times string, i string, here string, number string, before string, __fp string, __n string, __text string, __times string, ids string"


def test_odd_rows_pass_all_stages(spark):
    """Nulls, repeats, shared ids, a very long text and columns named like the operators' own, against plain versions of each stage."""
    sf = "/root/testdata/sf0.001"
    names = [c.split()[0] for c in CLASHES.split(", ")]
    base = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in base.collect()]
    top = max(r[0] for r in rows)
    odd = [(top + 1, None, None, None, None), (None, None, "en", "odd", 0), (None, "write to jane@example.com now please", "en", "odd", 36), (top + 2, "", "en", "odd", 0)]
    odd += [(top + 3, "one two three four five six seven eight", "en", "odd", 39)] * 3 + [(top + 3, "another text under the same id as before", "en", None, 40)]
    odd += [(top + 4, "long words go on " * 180_000, "en", "odd", 3_060_000), (None, "no id and no near copy of anything at all", "en", None, 41)]
    every = [(*r, *(f"{c}-{k}" for c in names)) for k, r in enumerate([*rows, *odd])]
    docs = spark.createDataFrame(every, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(4)
    kept, was = dict(corpus_pipeline.STAGES), docs
    clean = kept["toxicity"](spark, docs, sf).cache()
    assert clean.columns == docs.columns
    verdicts = toxicity.query(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("rejected").count()
    assert clean.count() == docs.count() - verdicts and {r.fp for r in clean.collect()} <= {x[5] for x in every}

    single = kept["simhash_dedup"](spark, clean, sf).cache()
    assert single.columns == docs.columns
    before, after = clean.collect(), single.collect()
    groups = {}
    for r, c in zip(before, classes([r.text for r in before], list(range(len(before))))):
        groups.setdefault(c, []).append(r)
    assert len(after) == len(groups)
    want = {(min((r.doc_id for r in g if r.doc_id is not None), default=None)) for g in groups.values()}
    assert {r.doc_id for r in after} == want
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}

    redacted = kept["pii"](spark, single, sf).cache()
    assert redacted.columns == docs.columns and redacted.count() == len(after)
    texts = {r.fp: r.text for r in after}
    for r in redacted.collect():
        assert (r.text is None) == (texts[r.fp] is None) and r.n_chars == (None if r.text is None else len(r.text)) or r.n_chars == 0
        assert not any(pii.base_spans(r.text or "").values())
        assert r.text == texts[r.fp] or any(pii.spans(texts[r.fp])[1].values())

    copies = {}
    mixed = kept["mixing"](spark, redacted, sf).cache()
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        copies[r.fp] = copies.get(r.fp, 0) + 1
    taken = mixing.mix(redacted).groupBy("doc_id", "source", "tie").agg({"copies": "sum"}).collect()
    assert sum(copies.values()) == sum(r[3] for r in taken) and max(copies.values()) <= 3

    tokens = kept["sentencepiece"](spark, mixed, sf)
    assert tokens.count() == sum(copies.values()) and all(r.round_trip for r in tokens.select("round_trip").collect())
    empty = was.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
    for df in (clean, single, redacted, mixed):
        df.unpersist()


def test_copies_of_one_row_are_shared_out_without_a_hot_task(spark):
    """Rows that agree in id, source and text but not elsewhere: all get as many copies, the first ones one more, over many partitions."""
    rows = [(7, "same words here " * 3, "s", str(k)) for k in range(2000)] + [(k, f"text number {k} of the other source", "t", "x") for k in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string").repartition(6)
    mixed = mixing.repeated(docs).groupBy("doc_id", "source", "extra").count().where("doc_id = 7").collect()
    total = mixing.mix(docs).where("doc_id = 7").agg({"copies": "sum"}).first()[0]
    assert sum(r["count"] for r in mixed) == total
    assert {r["count"] for r in mixed} <= {total // 2000, total // 2000 + 1}
