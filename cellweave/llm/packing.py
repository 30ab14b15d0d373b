"""Operator 1: packing by power-of-two decomposition.

Each document's token ids (its text's ids, then an end id) are cut into pieces whose lengths are
powers of two: as many pieces of ``max_tokens`` as fit, then the binary decomposition of the rest,
longest first.  A piece is a sequence of its own, so none crosses documents and none is padded;
pieces of one length form a bucket.  Within a bucket, sequences are dealt into batches of
``batch_tokens`` tokens, so a batch holds sequences of one length.

The work is one map over the rows: no shuffle, and memory bounded by one document plus one
output batch.  Each task numbers its sequences in each bucket; at most one batch of a bucket and task
is short.  Defined cases: a null text counts as empty; an empty text gives the single end id, one piece
of length 1; very long texts are encoded whole; repeated rows and repeated or null ids are packed row
by row; further columns of the input, whatever their names, aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, input_rows

PIECES = "doc_id long, start long, length long, doc_tokens long, token_ids binary, place long"


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """A byte-level BPE vocabulary (tokenizers' JSON) as a fast encoder that yields the same ids.

    In such a vocabulary a token's id is also its merge rank, which is all that tiktoken needs.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


def encode(path: str, text: str) -> list[int]:
    """Token ids of ``text``, as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``."""
    encoder, special = byte_bpe(path)
    if any(s in text for s in special):
        return encoder.encode(text, allowed_special="all")
    return encoder.encode_ordinary(text)


def binary_lengths(n: int, max_tokens: int) -> Iterator[int]:
    """Powers of two that sum to ``n``, none above ``max_tokens``, longest first."""
    while n:
        k = min(max_tokens, 1 << (n.bit_length() - 1))
        yield k
        n -= k


def pack_power_of_two(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = 1 << 16, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, token_ids (little-endian unsigned
    32-bit ids), place (number of the sequence in its bucket, by task), bucket (binary logarithm of the
    length), sequence_id, offset (always 0) and batch_id."""
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "token_ids", "place"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        rows: list[list] = [[] for _ in names]
        held, places = 0, Counter()
        for batch in batches:
            ids = batch.column(0)
            for i in range(batch.num_rows):
                tokens = np.array([*encode(tokenizer_path, batch.column(1)[i].as_py() or ""), end_id], dtype="<u4")
                start, doc = 0, ids[i].as_py()
                for k in binary_lengths(len(tokens), max_tokens):
                    for column, value in zip(rows, (doc, start, k, len(tokens), tokens[start : start + k].tobytes(), places[k]), strict=True):
                        column.append(value)
                    places[k] += 1
                    start += k
                    held += 4 * k
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)
                        rows, held = [[] for _ in names], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    bound_batches(docs.sparkSession)
    source = input_rows(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    bucket, task = F.round(F.log2("length")).cast("int"), F.spark_partition_id()
    batch = F.concat_ws("-", bucket, task, F.floor(F.col("place") * F.col("length") / batch_tokens))
    return source.mapInArrow(pieces, PIECES).select("*", bucket.alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), batch.alias("batch_id"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per piece length, the layout from which a trainer draws equal-length batches."""
    packed.write.partitionBy("bucket").parquet(path)
