"""Quality rules by tokeniser fertility (operator 4)."""

from __future__ import annotations

import base64
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, sliced, spread

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Words whose pieces a task keeps.
KEPT = 400_000


@dataclass(frozen=True)
class Band:
    """What a text may measure; limits count as inside.

    low and high are letters per token, of the pieces and of the byte-level
    vocabulary.
    """

    low: tuple[float, float]
    high: tuple[float, float] = (6.3, 6.3)
    byte_share: float = 0.10
    entropy: float = 0.40


# Letters per token of both vocabularies.  en, de, fr, es: medians of every third sf0.1 text that passes the base rules.
PROSE = {"en": (2.151, 2.173), "de": (2.185, 1.980), "fr": (1.918, 1.791), "es": (1.879, 1.712)}
# The same of article 1 of the Universal Declaration of Human Rights (English: 4.088 and 4.212, 1.5 times which is the upper limit of Latin script).
ARTICLE = {
    "cyrillic": (2.180, 0.773),
    "greek": (0.846, 0.757),
    "hebrew": (0.806, 0.671),
    "arabic": (0.876, 0.814),
    "indic": (0.783, 0.527),
    "thai": (0.963, 0.494),
    "hangul": (0.733, 0.335),
    "kana": (0.923, 0.718),
    "han": (0.977, 0.494),
}
_SHARES = {"cyrillic": 0.15, "greek": 0.15, "hebrew": 0.25, "arabic": 0.25, "indic": 0.95, "thai": 0.95, "hangul": 0.9, "kana": 0.6, "han": 0.9}


def _times(k: float, of: tuple[float, float]) -> tuple[float, float]:
    return k * of[0], k * of[1]


#: By language, else by script, else "other".  Latin script has the least limits of its languages; one short text is a rough measure, so other scripts have wide ones.
BANDS = {
    **{k: Band(_times(0.82, v)) for k, v in PROSE.items()},
    "latin": Band(_times(0.82, PROSE["es"])),
    **{k: Band(_times(0.6, v), _times(2.5, v), _SHARES[k]) for k, v in ARTICLE.items()},
    "other": Band((0.0, 0.0), (10.0, 10.0), 1.0, 0.0),
}
NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
# Ranges of code points by script; kana comes before han, as Japanese has both.
SCRIPTS = {
    "latin": "A-Za-zÀ-ɏḀ-ỿ",
    "greek": "Ͱ-Ͽἀ-῿",
    "cyrillic": "Ѐ-ԯ",
    "hebrew": "֐-׿",
    "arabic": "؀-ۿݐ-ݿ",
    "indic": "ऀ-෿",
    "thai": "฀-๿",
    "hangul": "ᄀ-ᇿ가-힯",
    "kana": "぀-ヿ",
    "han": "㐀-䶿一-鿿",
}
_OF_SCRIPT = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
_OTHER_THAN_LATIN = re.compile(f"[^\x00-\x7f{SCRIPTS['latin']}]")


def script(text: str) -> str:
    """The script of most of the letters, or "other" without any."""
    if text.isascii() or not _OTHER_THAN_LATIN.search(text):
        return "latin" if _OF_SCRIPT["latin"].search(text) else "other"
    n = {k: len(p.findall(text)) for k, p in _OF_SCRIPT.items()}
    if n["kana"]:
        n["kana"] += n.pop("han")
    best = max(n, key=lambda k: n[k])
    return best if n[best] else "other"


def repeated_words(ws: list[bytes]) -> int:
    """Words in windows of 8 words that the text has twice or more."""
    n = len(ws) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, ws), np.int64, len(ws)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    both = np.zeros(n, bool)
    both[1:] |= same
    both[:-1] |= same
    seen: dict[tuple, list[int]] = {}
    for i in order[both].tolist():  # equal hashes are confirmed word by word
        seen.setdefault(tuple(ws[i : i + WINDOW]), []).append(i)
    edge = np.zeros(len(ws) + 1, np.int64)
    for at in seen.values():
        if len(at) > 1:
            np.add.at(edge, at, 1)
            np.add.at(edge, np.array(at) + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def base(text: str) -> tuple[list[bytes], int, int, int, int]:
    """The words, and word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    ws = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return ws, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ws)


class Measure:
    """Tokens of words by two public vocabularies: pieces with byte fallback, and byte-level pieces."""

    def __init__(self, piece_model: bytes, byte_ranks: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, byte_ranks.splitlines())}
        self.bytes = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.starts = np.zeros(max(ranks.values()) + 1, bool)
        self.starts[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.size = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.size)])
        self.kept: dict[bytes, bytes] = {}

    def _learn(self, ws: list[bytes]) -> dict[bytes, bytes]:
        """For each word the ids of its pieces, and minus the number of its byte-level tokens."""
        texts = [w.decode("utf-8", "replace") for w in ws]
        pieces = self.pieces.encode(texts, num_threads=1)
        level = np.array(self.bytes.encode_ordinary(" " + " ".join(texts)))
        starts = np.flatnonzero(self.starts[level])
        if len(starts) == len(ws):  # each word is one space and what follows it
            n = np.diff(np.r_[starts, len(level)]).tolist()
        else:
            n = [len(self.bytes.encode_ordinary(" " + t)) for t in texts]
        return {w: array("i", [*p, -k]).tobytes() for w, p, k in zip(ws, pieces, n)}

    def __call__(self, ws: list[bytes]) -> tuple[int, int, int, float]:
        """Tokens of both vocabularies, byte-fallback tokens, and the entropy of the pieces as a share of its most."""
        kept = self.kept
        try:
            data = b"".join([kept[w] for w in ws])
        except KeyError:
            new = self._learn(list({w for w in ws if w not in kept}))
            data = b"".join([kept[w] if w in kept else new[w] for w in ws])
            if len(kept) + len(new) > KEPT:
                kept.clear()
            kept.update((w, v) for w, v in new.items() if len(w) <= 64)
        both = np.frombuffer(data, np.int32)
        ids = both[both >= 0]
        n = len(ids)
        counts = np.bincount(ids, minlength=1)
        counts = counts[counts > 0] / n
        entropy = float(-(counts * np.log2(counts)).sum() / np.log2(min(n, self.size))) if n > 1 else 0.0
        return n, int(-both[both < 0].sum()), int(self.is_byte[ids].sum()), entropy


_BUILT: dict[int, Measure] = {}


def _built(files: tuple) -> Measure:
    """One for each worker process, which keeps its words task after task."""
    key = hash(files)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Measure(*files)
    return _BUILT[key]


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, n_letters long, n_tokens long, n_level_tokens long, byte_share double, entropy double"


def measure(docs: DataFrame, piece_model: bytes, byte_ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(doc_id, lang, base counts, measures) for each row of docs; a null text has no words, and measures of 0."""
    shared = docs.sparkSession.sparkContext.broadcast((piece_model, byte_ranks, pattern))
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def run(batches):
        tokens = _built(shared.value)
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                ws, chars, symbols, dup_lines, repeats = base(text)
                failed = len(ws) < 20 or 100 * repeats > 30 * len(ws)
                data = text.encode("utf-8", "surrogatepass")
                letters = len(text) - len(data) + len(data.translate(None, NOT_LETTERS))
                n, n_level, n_fallback, entropy = tokens(ws) if ws else (0, 0, 0, 0.0)
                rows.append((len(ws), chars, symbols, dup_lines, repeats, failed, script(text), letters, n, n_level, n_fallback / n if n else 0.0, entropy))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c) for c in zip(*rows))], ["doc_id", "lang", *names])

    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    return spread(narrow).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, lang string, {COUNTS}")


def rate(docs: DataFrame, piece_model: bytes, byte_ranks: bytes, pattern: str, bands: dict[str, Band] = BANDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """measure() with chars_per_token (letters) and kept, for each row of docs.

    Bands are those of the row's language, of its script where the language is
    null or has none, or of "other"; they are fixed, so no text's verdict hangs
    on other rows.  Nulls and repeated rows stay as they are; a text without
    words or tokens is not kept, an empty table gives no rows, other columns
    are not looked at, and a very long text is measured whole.
    """
    out = measure(docs, piece_model, byte_ranks, pattern, id_col, text_col, lang_col)
    ok = F.lit(False)
    for name, band in bands.items():
        inside = (F.col("byte_share") <= band.byte_share) & (F.col("entropy") >= band.entropy)
        for n, low, high in zip(("n_tokens", "n_level_tokens"), band.low, band.high):
            inside = inside & F.col("n_letters").between(low * F.col(n), high * F.col(n))
        ok = ok | ((F.col("band") == name) & inside)
    known = list(bands)
    out = out.withColumn("band", F.when(F.col("lang").isin(known), F.col("lang")).when(F.col("script").isin(known), F.col("script")).otherwise("other"))
    out = out.withColumn("kept", F.coalesce(~F.col("base_failed") & (F.col("n_tokens") > 0) & ok, F.lit(False)))
    names = [x.split()[0] for x in COUNTS.split(", ")]
    return out.select("doc_id", *names[:6], "kept", *names[6:], F.when(F.col("n_tokens") > 0, F.col("n_letters") / F.col("n_tokens")).otherwise(0.0).alias("chars_per_token"))


def read_vocabularies(folder: str) -> tuple[bytes, bytes, str]:
    """The two vocabularies' files below a folder, and the byte-level one's word pattern."""
    with open(f"{folder}/piece_bpe_32k.model", "rb") as f:
        pieces = f.read()
    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = f.read()
    # Fixed value: the pattern that the byte-level vocabulary goes with.
    return pieces, ranks, r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def query(docs: DataFrame, folder: str) -> DataFrame:
    return rate(docs, *read_vocabularies(folder))
