"""Operator 6: quality rules from tokeniser fertility.

A public subword vocabulary measures, for each document, characters per token, the share of byte
fallback tokens and the entropy of its tokens (divided by its possible maximum).  Bands per
language and size (powers of two of the number of tokens, as small texts scatter more), from
quartiles over all their documents, reject outliers: a document stays only if its values lie within
``width`` interquartile ranges of the quartiles (by default 2, where the three one-sided fences
together reject about one of a thousand normal values).  Quartiles of a language and size are
averaged with those of its script, which weigh as much as ``prior_docs`` documents, so small bands
lean on the script without a switch.  Quartiles are exact for values rounded to a thousandth.

Base figures (words, symbols, repeated lines and windows) come along; documents under
``min_words`` words or with mostly repeated windows fail in any case.

Plan: one map over the texts writes a narrow table; bands are one partial aggregation of rounded
values over it, joined back.  Defined cases: a null or empty text has no words and fails; a null
language counts as its script; very long texts are measured whole; ties and repeated rows are judged
row by row; further columns of the input, whatever their names, aren't read; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, input_rows, materialize

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: First code points of scripts.
SCRIPTS = [("latin", 0x0, 0x370), ("greek", 0x370, 0x400), ("cyrillic", 0x400, 0x530), ("hebrew", 0x590, 0x600), ("arabic", 0x600, 0x780), ("indic", 0x900, 0xE00), ("cjk", 0x2E80, 0xFB00)]
STATS = "doc_id long, mark long, band string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
METRICS = ("chars_per_token", "byte_share", "token_entropy")


class Pieces(dict):
    """word -> row of a growing table of its subword ids; forgotten when it holds ``limit`` words."""

    def __init__(self, path: str, limit: int):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def __missing__(self, word: bytes) -> int:
        ids = self.model.encode(word.decode("utf-8", "replace"), num_threads=1)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        row = len(self)
        if row == len(self.start):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        self[word] = row
        self.start[row], self.size[row] = self.used, len(ids)
        self.used += len(ids)
        return row

    def measure(self, rows: np.ndarray) -> tuple[int, float, float]:
        """Tokens, byte fallback share and normalised entropy of the words in ``rows``."""
        k = self.size[rows]
        total = int(k.sum())
        if not total:
            return 0, 0.0, 0.0
        tokens = self.flat[np.repeat(self.start[rows] - np.cumsum(k) + k, k) + np.arange(total)]
        seen, n = np.unique(tokens, return_counts=True)
        p = n / total
        return total, float(n[self.is_byte[seen]].sum() / total), float(-(p * np.log2(p)).sum() / np.log2(total + 1))


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words in windows of ``width`` words that the text has twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    code = ids[:n].astype(np.int64)
    for j in range(1, width):
        code = np.unique(code, return_inverse=True)[1].astype(np.int64) * (int(ids.max()) + 1) + ids[j : n + j]
    _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(len(ids), bool)
    for j in range(width):
        covered[j : n + j] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n += line in seen
            seen.add(line)
    return n


def script_of(text: str) -> str:
    """The script of most letters beyond ASCII, latin where they are few."""
    wide = [ord(c) for c in text if c > "ͯ"]
    if len(wide) * 3 < len(text) - sum(map(text.count, SPACES)):
        return "latin"
    votes = [sum(a <= c < b for c in wide) for _, a, b in SCRIPTS]
    return SCRIPTS[int(np.argmax(votes))][0] if max(votes) else "other"


def mark_of(docs: DataFrame, text_col: str, lang_col: str):
    """A hash by which a row's judgement finds it again."""
    return F.xxhash64(docs[text_col].cast("string"), docs[lang_col].cast("string"))


def fertility(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", cache_words: int = 100_000) -> DataFrame:
    """One row per document: base figures and subword measures."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path, cache_words)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for doc, mark, lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    text = text or ""
                    words = text.encode("utf-8", "replace").split()
                    if len(pieces) > pieces.limit:
                        pieces.reset()
                    ids = np.array([pieces[w] for w in words], np.int64)
                    total, fallback, entropy = pieces.measure(ids) if words else (0, 0.0, 0.0)
                    chars = len(text) - sum(map(text.count, SPACES))
                    script = "latin" if text.isascii() else script_of(text)
                    rows.append((doc, mark, f"{script if lang is None else lang}:{total.bit_length()}", script, len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(ids), total, chars / total if total else 0.0, fallback, entropy))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, *[pa.float64()] * 3], strict=True)], names=[x.split()[0] for x in STATS.split(", ")])

    bound_batches(docs.sparkSession)
    source = input_rows(docs, id_col, lang_col, text_col).select(F.col(id_col).cast("long"), mark_of(docs, text_col, lang_col), F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    return source.mapInArrow(measure, STATS)


def quartiles(stats: DataFrame, *keys: str, min_words: int) -> DataFrame:
    """n and the quartiles of each measure by ``keys``, over documents with enough words."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 3).alias("v")) for m in METRICS])).alias("x")
    counts = stats.where(F.col("n_words") >= min_words).select(*keys, each).groupBy(*keys, "x.metric", "x.v").agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy(*keys, "metric")
    ranked = counts.withColumn("upto", F.sum("c").over(own.orderBy("v"))).withColumn("n", F.sum("c").over(own))
    at = lambda m, q: F.min(F.when((F.col("metric") == m) & (F.col("upto") >= q * F.col("n")), F.col("v")))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[F.array(at(m, 0.25), at(m, 0.75)).alias(m) for m in METRICS])


def fences(own: dict, width: float) -> list:
    """Bounds of each measure from its pair of quartiles."""
    floor = {"chars_per_token": 0.05, "byte_share": 0.02, "token_entropy": 0.02}
    out = []
    for m, (q1, q3) in own.items():
        reach = width * F.greatest(q3 - q1, F.lit(floor[m]))
        out += [(q1 - reach).alias(f"{m}_low"), (q3 + reach).alias(f"{m}_high")]
    return out


def judge(docs: DataFrame, model_path: str, width: float = 2.0, min_words: int = 50, prior_docs: int = 100, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``fertility`` with base_failed and kept."""
    stats = materialize(fertility(docs, model_path, id_col, text_col, lang_col), "fertility")
    own = quartiles(stats, "band", "script", min_words=min_words)
    shared = quartiles(stats, "script", min_words=min_words).select("script", *[F.col(m).alias(f"script_{m}") for m in METRICS])
    mean = {m: [(F.col("n") * F.col(m)[i] + prior_docs * F.col(f"script_{m}")[i]) / (F.col("n") + prior_docs) for i in (0, 1)] for m in METRICS}
    own = own.join(shared, "script").select("band", "script", *fences(mean, width))
    names = [f"{m}_{side}" for m in METRICS for side in ("low", "high")]
    shared = shared.select("script", *fences({m: [F.col(f"script_{m}")[i] for i in (0, 1)] for m in METRICS}, width))
    shared = shared.select("script", *[F.col(c).alias(f"script_{c}") for c in names])
    joined = stats.join(own, ["band", "script"], "left").join(shared, "script", "left")
    inside = F.lit(True)
    for m in METRICS:
        low, high = (F.coalesce(F.col(f"{m}_{side}"), F.col(f"script_{m}_{side}")) for side in ("low", "high"))
        # a band judges where it exists; few fallbacks and a high entropy are never faults
        inside &= F.coalesce((F.col(m) >= low) if m != "byte_share" else F.lit(True), F.lit(True))
        inside &= F.coalesce((F.col(m) <= high) if m != "token_entropy" else F.lit(True), F.lit(True))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(*[x.split()[0] for x in STATS.split(", ")], failed.alias("base_failed"), (~failed & inside).alias("kept"))


def keep_good(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    good = judge(docs, model_path, id_col=id_col, text_col=text_col, lang_col=lang_col, **options).where("kept").select(F.col("doc_id").alias("good_id"), F.col("mark").alias("good_mark"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].cast("long").alias("i"), mark_of(docs, text_col, lang_col).alias("h"))
    kept = rows.join(good, rows.i.eqNullSafe(good.good_id) & (rows.h == good.good_mark), "left_semi")
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
