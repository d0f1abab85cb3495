"""Importance resampling towards a target distribution, on hashed n-grams (operator 11)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread
from .crc_sql import CRC
from .ranges import running

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 3, 42, 20, 5
#: Bytes of texts, and words, that are looked at together.
BYTES, WORDS = 1 << 22, 1 << 18
#: Bytes of a word up to which all words advance together; what longer ones have beyond is left to zlib.
TOGETHER = 64


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: its lower case (A-Z only), whether it is part of a word, and the CRC-32 of a step."""
    byte = np.arange(256)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
    word = ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    step = byte.astype(np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    return lower, word, step


LOWER, IS_WORD, STEP = _tables()


def _views(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row borders) of runs of rows, with no copy of the Arrow buffers; a run has about BYTES bytes or is one row."""
    texts = pc.fill_null(texts, b"")
    wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, marks, data = texts.buffers()
    marks = np.frombuffer(marks, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(marks, marks[at] + BYTES, "right")) - 1)
        yield at, data[marks[at] : marks[to]], marks[at : to + 1] - marks[at]
        at = to


def _borders(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end: differences of the bytes' classes, and the borders of rows inside a run of word bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = IS_WORD[data]
    change = np.diff(inside)
    rows = marks[(marks > 0) & (marks < len(data))]
    rows = np.unique(rows[(inside[rows] == 1) & (inside[rows + 1] == 1)])
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    return (np.sort(np.r_[starts, rows]), np.sort(np.r_[ends, rows])) if len(rows) else (starts, ends)


def _advance(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC registers advanced over a word each, all words a byte at a time; words come in order of falling size."""
    crc, at = crc.copy(), starts.copy()
    for k in range(min(int(sizes[0]), TOGETHER) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, "left"))  # those that have a byte k
        now = crc[:n]
        crc[:n] = STEP[(now ^ LOWER[data[at[:n]]]) & 255] ^ (now >> np.uint32(8))
        at[:n] += 1
    for i in range(int(np.searchsorted(-sizes, -TOGETHER, "left"))):
        rest = LOWER[data[starts[i] + TOGETHER : starts[i] + sizes[i]]].tobytes()
        crc[i] = zlib.crc32(rest, int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return crc


def features(data: np.ndarray, marks: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, bucket, words) for runs of words: the rows and hash buckets of the features that start at one, and how many words it has.

    A feature is up to ``longest`` words of a row with spaces between; its hash
    is the CRC-32 of its bytes.  The register of a feature goes on from that of
    the same feature without its last word.  Rows come first for the words
    themselves, so the first ``words`` of a run are the words' rows.
    """
    starts, ends = _borders(data, marks)
    space = np.uint32(32)
    for lo in range(0, len(starts), WORDS):
        n = min(WORDS, len(starts) - lo)
        s, e = starts[lo : lo + n + longest - 1], ends[lo : lo + n + longest - 1]
        row = np.searchsorted(marks, s, "right") - 1
        size = e - s
        order = np.argsort(-size, kind="stable")
        crc, rows, out = np.full(len(s), 0xFFFFFFFF, np.uint32), [], []
        for k in range(longest):  # features that start k words before the word that they end with
            ending = order[order >= k] if k else order
            first = ending - k
            keep = (first < n) & (row[first] == row[ending])
            ending, first = ending[keep], first[keep]
            now = crc[first]
            if k:
                now = STEP[(now ^ space) & 255] ^ (now >> np.uint32(8))
            now = _advance(now, data, s[ending], size[ending])
            crc[first] = now
            rows.append(row[first])
            out.append((now ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        yield np.concatenate(rows), np.concatenate(out), n


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket.  A task sends one row for each bucket that it has met."""

    def run(batches):
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, marks in _views(batch.column(0)):
                for _, found, _ in features(data, marks, buckets, longest):
                    count += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met])], ["bucket", "n"])

    texts = spread(docs.select(F.col(text_col).cast("string").cast("binary").alias("text")))
    rows = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the logarithm of its smoothed target share over its source share, in whole thousandths, rounded down."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row: weight is the sum of its features' gains."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = shared.value
        for batch in batches:
            n_words, n, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for at, data, marks in _views(batch.column(1)):
                size = len(marks) - 1
                for row, found, here in features(data, marks, len(gain), longest):
                    n_words[at : at + size] += np.bincount(row[:here], minlength=size)
                    n[at : at + size] += np.bincount(row, minlength=size)
                    weight[at : at + size] += np.bincount(row, gain[found], size).astype(np.int64)  # whole numbers below 2^53
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return spread(narrow).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of docs; rank is null where the row is not drawn.

    Drawn without replacement, with chances that grow with exp(weight / 1000):
    the highest sums of weight and Gumbel noise, which hangs on doc_id and seed
    alone.  Two passes over the texts: bucket counts, of which the driver sees
    ``buckets`` numbers, then weights; only (doc_id, score) of rows above a
    lower bound of the last score drawn are put in order, by ranges.

    A null or empty text has no features and weight 0.  A null doc_id has the
    noise of an empty id and comes last among ties; repeated rows are rows of
    their own, with ranks of their own.  An empty table gives no rows, an empty
    target smoothed shares, other columns are not looked at, and a very long
    text is read in runs of words.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weighted(docs, gain, id_col, text_col, longest).withColumn("score", F.col("weight") + noise)
    scored = cut(scored.withColumn("tie", F.monotonically_increasing_id()), "scored")
    may = F.col("n_words") >= least_words
    # the quantile is off by a ten-thousandth of the rows at most, so what is below it is not drawn
    n, bound = scored.where(may).agg(F.count("*"), F.percentile_approx("score", max(0.0, 0.99 - percent / 100), 10_000)).first()
    n = n * percent // 100
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not n:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    near = may & (F.col("score") >= bound)
    order = scored.where(near).select("*", (-F.col("score")).alias("falling"), F.col("doc_id").isNull().alias("last"), F.lit(1).alias("one"))
    ranked = running(order, ["falling", "last", "doc_id", "tie"], {"one": "before"})
    ranked = ranked.select(*out, F.when(F.col("before") < n, F.col("before") + 1).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~near).select(*out, F.lit(None).cast("long").alias("rank")))


def query(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_TEXTS = """
select {id} as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {table}"""

_GRAMS = """
select id, unnest(w) as f from {0} union all
select id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from {0} union all
select id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from {0}"""

ORACLE_SQL = f"""
with recursive d as ({_TEXTS.format(id="doc_id", table="documents")}), b as ({_TEXTS.format(id="item_id", table="benchmark")}),
dg as ({_GRAMS.format("d")}), bg as ({_GRAMS.format("b")}),
f as (select f from dg union select f from bg), {CRC},
hashed as (select f, v % 10000 as bucket from crc),
dh as (select id, bucket from dg join hashed using (f)), bh as (select bucket from bg join hashed using (f)),
s as (select bucket, count(*) as s from dh group by bucket), t as (select bucket, count(*) as t from bh group by bucket),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from dh) + 10000)::double / ((s + 1)::double * ((select count(*) from bh) + 10000)::double)))::bigint as g from s left join t using (bucket)),
w as (select id, count(*) as n, sum(g)::bigint as weight from dh join gain using (bucket) group by id),
scored as (select id as doc_id, coalesce(len(d.w), 0) as n_words, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from d left join w using (id)),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when r <= 5 * (select count(*) from ranked) // 100 then r end as rank from scored left join ranked using (doc_id)
"""
