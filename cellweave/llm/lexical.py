"""Operator 11: ranked lexical search over document-sharded postings.

Documents are cut into shards where they lie, without a shuffle; a shard ends after
``shard_terms`` terms.  Each shard is one row of a written table: its terms, and per term the numbers
of its documents with an integer impact each (compressed sparse rows, as bytes of numpy arrays).  An
impact holds everything of the score but the term's weight, which depends on the searched
collection and is known when a search begins:

    score(item, doc) = sum of w(term) * impact(term, doc) over the item's terms, repeats included
    impact = (10^9 tf) div (1000 tf + 12 m),  m = 100 - 25 + (25 n N) div L
    w = floor(1000 ln((2 N + 2) / (2 df + 1)))

A search goes term by term: each shard adds an item's posting lists into one dense array over its
documents, finds the k-th best by ``argpartition``, keeps all that reach it, and only then cuts ties
by document id.  Tasks merge their shards, a window merges the tasks (k rows a task and item).

Items come to the driver in blocks of about ``block_bytes`` of text, each of which goes to the tasks;
document frequencies of a block's terms come back, one row a term.  Nothing else passes the driver.

Defined cases: a null or empty text, or one without a term, is no document of the collection and
an item without results; very long texts are whole (one shard at least holds them); rows with equal
ids are documents (items) of their own; a null id sorts last among ties; further columns of the
input, whatever their names, aren't read; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, digest, input_rows, materialize

#: Bytes of UTF-8 as terms have them: A-Z in lower case, and spaces for what is in none (control
#: characters and punctuation of ASCII).
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
SHARD = "docs array<long>, terms binary, ends binary, places binary, impacts binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Numbers(dict):
    """Terms in the order in which they came."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Shard:
    """Documents gathered until they are written as one row."""

    def __init__(self):
        self.docs, self.terms, self.rows, self.size = [], Numbers(), [], 0

    def add(self, doc: int | None, words: list[bytes]) -> None:
        self.docs.append(doc)
        self.rows.append(np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def row(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        """Postings by term, then by document, with their impacts."""
        n = [len(r) for r in self.rows]
        codes = np.concatenate(self.rows) * len(n) + np.repeat(np.arange(len(n)), n)
        codes, tf = np.unique(codes, return_counts=True)
        term, place = np.divmod(codes, len(n))
        m = np.array([75 + 25 * x * n_docs // n_terms for x in n], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[place])
        ends = np.cumsum(np.bincount(term, minlength=len(self.terms)))
        cells = [self.docs, b" ".join(self.terms), ends.astype("<i4").tobytes(), place.astype("<i4").tobytes(), impact.astype("<i4").tobytes()]
        kinds = [pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=[x.split()[0] for x in SHARD.split(", ")])


class Best:
    """The k best documents seen so far: highest score, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        if len(score) > self.k:
            at = len(score) - self.k
            tied = score >= score[np.argpartition(score, at)[at]]  # all that equal the k-th best stay
            score, doc, null = score[tied], doc[tied], null[tied]
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


class LexicalIndex:
    """Postings of a collection; ``shards`` is the written table."""

    def __init__(self, docs: DataFrame, shard_terms: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text"):
        bound_batches(docs.sparkSession)
        own = input_rows(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
        own = own.select("doc", F.col("text").cast("binary"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = [len(terms_of(text.as_py() or b"")) for text in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))]), pa.array([sum(n)])], names=["docs", "terms"])

        counts = own.select("text").mapInArrow(count, "docs long, terms long")
        total = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        self.n_docs, self.n_terms = n_docs, n_terms = total[0], total[1]

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard = Shard()
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = terms_of(text.as_py() or b"")
                    if words:
                        shard.add(doc, words)
                    if shard.size >= shard_terms:
                        yield shard.row(n_docs, n_terms)
                        shard = Shard()
            if shard.docs:
                yield shard.row(n_docs, n_terms)

        self.shards = materialize(own.mapInArrow(gather, SHARD), "postings")

    def frequencies(self, terms: list[bytes]) -> dict[bytes, int]:
        """In how many documents of the collection each of ``terms`` is."""
        number = {t: i for i, t in enumerate(terms)}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(number), np.int64)
            for batch in batches:
                for names, ends in zip(*batch.columns, strict=True):
                    size = np.diff(np.frombuffer(ends.as_py(), "<i4"), prepend=0)
                    for i, t in enumerate(names.as_py().split(b" ")):
                        if t in number:
                            total[number[t]] += size[i]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

        found = self.shards.select("terms", "ends").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        return {terms[r["term"]]: r["df"] for r in found.collect()}

    def search(self, items: DataFrame, k: int = 20, block_bytes: int = 8 << 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0."""
        own = input_rows(items, id_col, text_col).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
        own = materialize(own.withColumn("item", F.monotonically_increasing_id()), "items")
        size = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        blocks = size // block_bytes + 1
        block = F.pmod(digest("item"), F.lit(blocks))
        parts = [self._search(own.where(block == b).collect(), k) for b in range(blocks)]
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

    def _search(self, items: list, k: int) -> DataFrame:
        """The best of each task for a block of items."""
        asked = [(r["item"], r["item_id"], Counter(terms_of(bytes(r["text"] or b"")))) for r in items]
        df = self.frequencies(sorted({t for _, _, words in asked for t in words}))
        weight = {t: math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        asked = [(item, item_id, [(t, c * weight[t]) for t, c in words.items() if weight.get(t)]) for item, item_id, words in asked]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [Best(k) for _ in asked]
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    ids, names, *arrays = (x.as_py() for x in row)
                    null = np.array([d is None for d in ids])
                    ids = np.array([0 if d is None else d for d in ids], np.int64)
                    ends, places, impacts = (np.frombuffer(x, "<i4") for x in arrays)
                    starts = np.concatenate([[0], ends])
                    at = {t: i for i, t in enumerate(names.split(b" ")) if t in weight}
                    for own, (_, _, words) in zip(best, asked, strict=True):
                        total = np.zeros(len(ids), np.int64)
                        for t, w in words:
                            i = at.get(t)
                            if i is not None:
                                span = slice(starts[i], starts[i + 1])
                                total[places[span]] += w * impacts[span].astype(np.int64)
                        some = np.flatnonzero(total > 0)
                        own.add(total[some], ids[some], null[some])
            for own, (item, item_id, _) in zip(best, asked, strict=True):
                if len(own.score):
                    n = len(own.score)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * n), pa.array([item_id] * n, pa.int64()), pa.array(own.doc, mask=own.null), pa.array(own.score)], names=["item", "item_id", "doc_id", "score"])

        return self.shards.mapInArrow(score, "item long, item_id long, doc_id long, score long")


def search_ranked(docs: DataFrame, items: DataFrame, k: int = 20, **options) -> DataFrame:
    """Index ``docs`` and rank them for each of ``items``."""
    return LexicalIndex(docs, **options).search(items, k)
