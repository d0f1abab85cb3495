"""Document probability over all subword segmentations (operator 6).

A public vocabulary's pieces and the end of a text share one unigram
distribution, from the training documents.  A word's probability is the sum
over all its segmentations, by a forward recursion in log space, and a text's
the product over its words and its end, so all texts together have at most 1.
Every distinct word is scored once.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lowered_words, sliced, spread

MARK = "▁"
#: Stands for a mark inside a word, which is spelled by its bytes, so that no two words are spelled alike; no text has it.
INNER = "\ud800"
#: Distinct words that a task counts before it passes them on.
COUNTED = 300_000
#: Words with a share of the training tokens of at least one in HEAD are broadcast: there are at most HEAD.
HEAD = 2_000_000
#: Added to each piece's count.
SMOOTH = 0.5
FOLDS, HELD_OUT = 5, 1


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c): every distinct word of all texts and its count in the training texts; tasks count before the shuffle."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in sliced(batches):
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held:
                    for w in set(lowered_words(text)):
                        counts.setdefault(w, 0)
                else:
                    counts.update(lowered_words(text))
                if len(counts) >= COUNTED:
                    yield flush()
        if counts:
            yield flush()

    return spread(rows.select("text", "held_out")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(words: DataFrame, model: bytes) -> DataFrame:
    """(piece, n): how often the training words' best segmentations have each piece; one row for each piece and task is shuffled."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            c = batch.column(1).to_numpy(zero_copy_only=False)
            ids = sp.encode(batch.column(0).to_pylist(), num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = array("i", [x for w in ids for x in w])
            total += np.bincount(np.frombuffer(flat, np.int32), np.repeat(c, sizes), len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["piece", "n"])

    return words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """Log probabilities of words over all segmentations into pieces; characters that no piece spells are their bytes."""

    def __init__(self, pieces: dict[str, float], bytes_: list[float], end: float = 0.0):
        self.pieces, self.bytes, self.end = pieces, bytes_, end
        self.longest = max(map(len, pieces), default=1)

    def word(self, word: str) -> float:
        text, pieces, longest = MARK + word.replace(MARK, INNER), self.pieces, self.longest
        n, exp, log = len(text), math.exp, math.log
        a = [-math.inf] * (n + 1)
        a[0] = 0.0
        for end in range(1, n + 1):
            terms = []
            for start in range(max(0, end - longest), end):
                p = pieces.get(text[start:end])
                if p is not None:
                    terms.append(a[start] + p)
            if text[end - 1] not in pieces:
                c = MARK if text[end - 1] == INNER else text[end - 1]
                terms.append(a[end - 1] + sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass")))
            top = max(terms)
            a[end] = top if len(terms) == 1 else top + log(sum([exp(t - top) for t in terms]))
        return a[n]

    @classmethod
    def from_counts(cls, model: bytes, counts: dict[int, int], ends: int) -> Lattice:
        """Unigram probabilities of the model's pieces and of the end of a text, from their counts in training."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        total = math.log(sum(counts.values()) + ends + SMOOTH * (sp.get_piece_size() + 1))
        log_p = [math.log(counts.get(i, 0) + SMOOTH) - total for i in range(sp.get_piece_size())]
        pieces = {sp.id_to_piece(i): log_p[i] for i in range(len(log_p)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        return cls(pieces, [log_p[sp.piece_to_id(f"<0x{b:02X}>")] for b in range(256)], math.log(ends + SMOOTH) - total)


def word_scores(words: DataFrame, lattice: Lattice) -> DataFrame:
    """words with lp, the log10 of the word's probability over all segmentations."""
    shared = words.sparkSession.sparkContext.broadcast(lattice)

    def run(batches):
        score = shared.value.word
        for batch in batches:
            lp = np.array([score(w) for w in batch.column(0).to_pylist()]) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp)], ["word", "c", "lp"])

    return words.select("word", "c").mapInArrow(run, "word string, c long, lp double")


def _split(rows: DataFrame, id_type: str, head: dict[bytes, int], c: np.ndarray, lp: np.ndarray) -> DataFrame:
    """A row for each text with its head words' sums, and a row for each other word of it; uid ties them together."""
    shared = rows.sparkSession.sparkContext.broadcast((head, np.log10(c + 0.5), c > 0, lp))

    def run(batches):
        index, log_c, known, lp = shared.value
        uid = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            uids, tokens, base, n_known, score, tails = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ws = lowered_words(text)
                at = np.fromiter(map(index.get, ws, repeat(-1)), np.int64, len(ws))
                hit = at[at >= 0]
                uids.append(uid)
                tokens.append(len(ws) + 1)
                base.append(float(log_c[hit].sum()))
                n_known.append(int(known[hit].sum()))
                score.append(float(lp[hit].sum()))
                tails += [(uid, w, n) for w, n in Counter([ws[i] for i in np.flatnonzero(at < 0).tolist()]).items()]
                uid += 1
            n = len(uids)
            columns = [pa.array(uids, pa.int64()), batch.column(0), batch.column(2), pa.nulls(n, pa.string()), pa.array(tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names)
            for k in range(0, len(tails), 100_000):
                part = tails[k : k + 100_000]
                m = len(part)
                columns = [pa.array([t[0] for t in part], pa.int64()), pa.nulls(m, batch.column(0).type), pa.nulls(m, pa.bool_()), pa.array([t[1] for t in part], pa.binary()).cast(pa.string()), pa.array([t[2] for t in part], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["uid", "doc_id", "held_out", "word", "n", "n_known", "base", "score"]
    return spread(rows).mapInArrow(run, f"uid long, doc_id {id_type}, held_out boolean, word string, n long, n_known long, base double, score double")


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    A null text is empty: its only token is its end.  Nulls and repeated rows
    stay as they are, an empty table gives none, other columns are not looked
    at, and a very long text costs what its words cost.  Frequent words, a number with a proven bound, are looked
    up; all others are joined, so no word gathers many rows.
    """
    rows = _narrow(docs, id_col, text_col)
    words = cut(word_counts(rows), "words")
    n_docs = rows.where("not held_out").count()
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    counts = {r.piece: r.n for r in piece_counts(words, model).collect()}  # one row for each piece at most
    lattice = Lattice.from_counts(model, counts, n_docs)
    scored = cut(word_scores(words, lattice), "word-scores")
    train_tokens, vocabulary = n_words + n_docs, distinct + bool(n_docs)

    least = max(1, -(-n_words // HEAD))
    top = scored.where(F.col("c") >= least).toArrow()  # HEAD rows at most: their counts sum up to n_words
    head = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(top["word"].to_pylist())}
    mixed = cut(_split(rows, dict(docs.dtypes)[id_col], head, top["c"].to_numpy(), top["lp"].to_numpy()), "split")

    tails = mixed.where("word is not null").select("uid", "word", "n").join(scored.where(F.col("c") < least), "word")
    n, c = F.col("n"), F.col("c")
    tails = tails.groupBy("uid").agg(F.sum(n * F.log10(c + 0.5)).alias("t_base"), F.sum(F.when(c > 0, n).otherwise(0)).alias("t_known"), F.sum(n * F.col("lp")).alias("t_score"))
    total = math.log10(train_tokens + 0.5 * (vocabulary + 1))
    end_base, end_score = math.log10(n_docs + 0.5), lattice.end / math.log(10)
    out = mixed.where("word is null").join(tails, "uid", "left")

    def both(a, b):
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    return out.select(
        "doc_id",
        "held_out",
        n.alias("n_tokens"),
        (both("n_known", "t_known") + int(n_docs > 0)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (both("base", "t_base") + end_base - n * total).alias("base_score"),
        (both("score", "t_score") + end_score).alias("score"),
    )
