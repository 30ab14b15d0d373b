"""Operator 13: language identification by compression.

Each language has a raw-content zstandard dictionary of pieces of its training texts.  A text, in
lower case, is compressed once with each dictionary, in blocks of ``block`` bytes that each start from the
dictionary afresh (a long text would else be coded by its own beginning), and the language of the
smallest sum wins.  ``margin`` is what the winner saves, as a share of the runner-up (of the size
without a dictionary, where there is but one language); a prediction with a margin under ``least``
is rejected.

The fit takes a bounded sample: of each language up to ``pieces`` training texts with the smallest
hashes, equal texts once, and of each a piece of ``piece`` characters from a place drawn by its hash.
Hash thresholds come from the counts of all training rows, so at most about four times as many
pieces come to the driver.  A dictionary holds at most ``dict_bytes``, all of them ``total_bytes``.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as all are when no
language was learned; ties go to the language with most training rows (then in code point order); very long texts are
compressed whole, block by block; repeated rows are judged one by one; rows without a text or a
language teach nothing; further columns of the input, whatever their names, aren't read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, digest, input_rows

UNKNOWN = "und"
PREDICTED = "doc_id long, lang_pred string, certain boolean, score double"


def sample(train: DataFrame, pieces: int, piece: int) -> dict[str, list[str]]:
    """Pieces of training texts (lang, text) by language, in order of their hashes."""
    rows = train.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").withColumn("h", digest("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    known = train.sparkSession.createDataFrame(sorted(counts.items()), "lang string, n long")
    drawn = rows.join(F.broadcast(known), "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 < 4.0 * pieces / F.col("n"))  # one row a language
    cut = drawn.select("lang", "h", F.expr(f"substring(text, cast(pmod(xxhash64(h), greatest(length(text) - {piece}, 0) + 1) + 1 as int), {piece})").alias("piece"))
    found: dict[str, list] = {}
    for r in cut.groupBy("lang", "h").agg(F.min("piece").alias("piece")).collect():
        found.setdefault(r["lang"], []).append((r["h"], r["piece"]))
    return {lang: [p for _, p in sorted(found[lang])[:pieces]] for lang in sorted(found, key=lambda x: (-counts[x], x))}


def fit(train: DataFrame, pieces: int = 400, piece: int = 100, dict_bytes: int = 32 << 10, total_bytes: int = 64 << 20, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary's content for each language of ``train``, the most frequent language first."""
    rows = input_rows(train, text_col, lang_col).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = sample(rows, pieces, piece)
    room = min(dict_bytes, total_bytes // max(1, len(found)))
    return {lang: "\n".join(some).lower().encode("utf-8", "replace")[:room] for lang, some in found.items()}


class Judge:
    """Compressors of all languages, made once in a task."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, block: int):
        import zstandard

        set_up = zstandard.ZstdCompressionParameters.from_level(level, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(content: bytes):
            if len(content) < 8:  # zstandard takes no shorter dictionary
                return zstandard.ZstdCompressor(compression_params=set_up).compress
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=set_up)
            return zstandard.ZstdCompressor(dict_data=own, compression_params=set_up).compress

        self.block = block
        self.langs = list(dictionaries)
        self.coders = [compressor(dictionaries[x]) for x in self.langs]
        self.plain = compressor(b"")

    def size(self, coder, data: bytes) -> int:
        return sum(len(coder(data[i : i + self.block])) for i in range(0, len(data), self.block))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and margin."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = text.lower().encode("utf-8", "replace")
        sizes = [self.size(c, data) for c in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sizes[:best] + sizes[best + 1 :] or [self.size(self.plain, data)]
        return self.langs[best], max(0.0, 1 - sizes[best] / min(others))


def predict(docs: DataFrame, dictionaries: dict[str, bytes], least: float = 0.02, level: int = 6, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, certain (the margin reaches ``least``), score (the margin)."""
    bound_batches(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Judge(dictionaries, level, block)
        for batch in batches:
            found = [of(text.as_py()) for text in batch.column(1)]
            langs, scores = [x for x, _ in found], [s for _, s in found]
            certain = [x != UNKNOWN and s >= least for x, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(certain, pa.bool_()), pa.array(scores, pa.float64())], names=[x.split()[0] for x in PREDICTED.split(", ")])

    own = input_rows(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(judge, PREDICTED)


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.02, **options) -> DataFrame:
    """Fit on the rows whose crc32 of the id modulo ``folds`` isn't ``fold``, predict all.

    doc_id, held_out, lang_pred, certain, score.  A null id counts as training.
    """
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % folds == fold, F.lit(False))
    own = input_rows(docs, id_col, text_col, lang_col)
    found = predict(own, fit(own.where(~held(id_col)), text_col=text_col, lang_col=lang_col, **options), least, id_col=id_col, text_col=text_col)
    return found.select("doc_id", held("doc_id").alias("held_out"), "lang_pred", "certain", "score")
