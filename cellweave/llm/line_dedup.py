"""Operator 9: line dedup by a deletion-neighbourhood join.

A line goes if an equal line, or a line within one edit (insertion, deletion or substitution of a
character), stands earlier in the corpus, by doc_id (null last), then text, then line number.
Blank lines stay.  A near copy is alike in at least seven eighths: lines of under ``min_chars`` (8)
characters are copies only if equal, as one edit makes another word of them; there is no upper bound.

Equal lines are first brought together by a 128-bit hash, so copies cost one row.  Two different
lines within one edit agree in the front or the back half (measured on the shorter one), so only
lines that share a half with another line are looked at further: they are cut into ``parts`` parts
(more where lines are long: the cube root of their length, so the shares of all parts and the
variants of one part both stay within length ** (4 / 3) characters), and of lines that share all but one part, that part emits variants: each variant, the part as it is
or with one character deleted, is a hashed key together with the hash of what is shared.  Equal keys
meet: variants that lack the same position are substitutions of each other, a whole one and a
reduced one are an insertion apart.  A group of equal variants holds different lines only, at most
one per position and character, so it is bounded, and its earliest line is found without pairing
its members.  The distance to that line is then verified on the texts.

All of it is DataFrame functions.  Texts are read three times and shuffled once, to drop the lines;
the lines that emit variants are picked on the second reading by a bitmap of fixed size, which can
let further lines pass but misses none.

Defined cases: a null text stays null and an empty one empty; rows that repeat id and text are one
document and are treated alike; null ids are last; very long texts and lines are treated like
others; an empty table gives no rows; ties cannot occur as positions differ; columns of the input
named like those that ``dedup_lines`` adds are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import input_rows, materialize

NAMES = ["x1", "x2"]


def two(c: Column) -> list[Column]:
    """A 128-bit hash as two numbers."""
    return [F.xxhash64(c), F.xxhash64(F.lit("second"), c)]


def all_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k1, k2 (the text's hash), line_no, line, x1, x2 (the line's hash), of lines not blank."""
    rows = input_rows(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    k1, k2 = two(F.col("text"))
    rows = rows.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    x1, x2 = two(F.col("line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumns({"x1": x1, "x2": x2})


def parts_of(shorter: Column, parts: int) -> Column:
    """Number of parts for a pair whose shorter line has that length."""
    return F.greatest(F.lit(parts), F.ceil(F.cbrt(shorter)).cast("int"))


def bounds(shorter: Column, part: Column | int, parts: Column | int) -> tuple[Column, Column]:
    """Where a part of the shorter line begins and ends."""
    n = shorter.cast("long")
    return F.floor(n * part / parts).cast("int"), F.floor(n * (F.lit(part) + 1) / parts).cast("int")


def share(line: Column, shorter: Column, part: Column | int, parts: Column | int) -> Column:
    """Hash of what lines of a pair have in common if they differ in that part only."""
    a, b = bounds(shorter, part, parts)
    return F.xxhash64(F.lit(part), shorter, F.substring(line, F.lit(1), a), F.right(line, shorter - b))


def inside(line: Column, chars: Column, shorter: Column, part: Column, parts: Column | int) -> Column:
    """What the line has in that part."""
    a, b = bounds(shorter, part, parts)
    return F.substring(line, a + 1, chars - (shorter - b) - a)


def bitmap(rows: DataFrame, of: str, bits: int) -> DataFrame:
    """One row with an array of bits / 64 numbers, a bit set for each value of ``of``."""
    words = rows.select(F.pmod(F.col(of), F.lit(bits)).alias("at")).selectExpr("shiftright(at, 6) AS w", "shiftleft(1L, CAST(at % 64 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    dense = rows.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda s: s["b"]).alias("bits"))


def shared(rows: DataFrame) -> DataFrame:
    """Rows whose share occurs in more than one line."""
    many = rows.groupBy("share").agg(F.min("x1").alias("a"), F.max("x1").alias("b")).where("a <> b").select("share")
    return rows.join(many, "share", "left_semi")


def find_duplicates(docs: DataFrame, min_chars: int = 8, parts: int = 16, bits: int = 1 << 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2, line_no, near: the lines to drop."""
    lines = all_lines(docs, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2", "line_no")
    able = F.col("chars") >= min_chars
    lines = lines.withColumn("chars", F.length("line"))
    # each line as the shorter and as the longer one of a pair, with the difference in either half
    halves = {f"h{less}{part}": F.when(able, share(F.col("line"), F.col("chars") - less, part, 2)) for less in (0, 1) for part in (0, 1)}
    whole = lines.select("x1", "x2", place.alias("place"), *[v.alias(k) for k, v in halves.items()]).groupBy("x1", "x2")
    whole = materialize(whole.agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), *[F.max(k).alias(k) for k in halves]), "lines")

    # lines that share a half with another line
    halved = whole.where("h00 is not null").select("x1", "x2", F.explode(F.array(*halves)).alias("share"))
    emit = materialize(shared(halved).select("x1", "x2").distinct(), "emitting")

    # their texts, one each
    marks = materialize(bitmap(emit, "x1", bits), "bitmap")
    at = F.pmod("x1", F.lit(bits))
    marked = F.getbit(F.get(marks.scalar(), F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1
    texts = lines.where(able).where(marked).select("x1", "x2", "line", "chars").distinct()
    texts = materialize(texts.join(emit, NAMES).join(whole.select("x1", "x2", "first"), NAMES), "line_texts")

    # of those, lines that share all but a small part; variants of that part
    def cuts(shorter: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), parts_of(shorter, parts) - 1), lambda j: F.struct(shorter.alias("shorter"), j.alias("part")))

    cases = F.concat(cuts(F.col("chars")), cuts(F.col("chars") - 1))
    cut = parts_of(F.col("c.shorter"), parts)
    fine = texts.select("x1", "x2", "first", "line", "chars", F.explode(cases).alias("c")).select("x1", "x2", "first", "chars", share(F.col("line"), F.col("c.shorter"), F.col("c.part"), cut).alias("share"), inside(F.col("line"), F.col("chars"), F.col("c.shorter"), F.col("c.part"), cut).alias("rest"))
    n = F.length("rest")
    less = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("gone"), F.xxhash64(F.concat(F.substring("rest", F.lit(1), i), F.substring(F.col("rest"), i + 2, n))).alias("variant")))
    variants = F.concat(F.array(F.struct(F.lit(-1).alias("gone"), F.xxhash64("rest").alias("variant"))), F.when(n > 0, less).otherwise(F.array().cast("array<struct<gone:int,variant:bigint>>")))
    keys = shared(fine).select("x1", "x2", "first", "chars", "share", F.explode(variants).alias("v")).select("x1", "x2", "first", "chars", "share", "v.gone", "v.variant")
    me = F.struct("first", "x1", "x2")
    reduced = F.when(F.col("gone") >= 0, me)
    entire = F.when(F.col("gone") < 0, me)
    group = Window.partitionBy("share", "variant")
    same = Window.partitionBy("share", "variant", "chars", "gone")
    earliest = F.least(F.when(F.col("gone") >= 0, F.min(me).over(same)), F.when(F.col("gone") >= 0, F.min(entire).over(group)).otherwise(F.min(reduced).over(group)))
    near = keys.select("x1", "x2", "first", earliest.alias("found")).where(F.col("found.first") < F.col("first"))
    near = near.groupBy("x1", "x2").agg(F.min("found").alias("found")).select("x1", "x2", F.col("found.x1").alias("y1"), F.col("found.x2").alias("y2"))
    left, right = texts.select("x1", "x2", F.col("line").alias("a")), texts.select(F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("line").alias("b"))
    near = near.join(left, NAMES).join(right, ["y1", "y2"]).where(F.levenshtein("a", "b", 1) >= 0).select("x1", "x2", F.lit(True).alias("near"))

    # all places of such lines but the first of lines without an earlier neighbour
    bad = whole.join(near, NAMES, "left").where("n > 1 OR near").select("x1", "x2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    bad = materialize(bad, "dropped_lines")
    return lines.drop("line", "chars").join(bad, NAMES).where(F.col("near") | (place != F.col("first"))).select("doc_id", "k1", "k2", "line_no", "near")


def dedup_lines(docs: DataFrame, drop_emptied: bool = False, counts: bool = True, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the text of the remaining lines, and n_lines, n_equal, n_near (lines not blank,
    and those gone) unless ``counts`` is False.  n_chars, where it is a column, follows.
    ``drop_emptied`` drops documents that lose all their lines."""
    gone = find_duplicates(docs, id_col=id_col, text_col=text_col, **options).distinct()
    gone = gone.groupBy("doc_id", "k1", "k2").agg(F.collect_set("line_no").alias("gone"), F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_equal"))
    k1, k2 = two(docs[text_col].cast("string"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].cast("long").alias("i"), k1.alias("h1"), k2.alias("h2"))
    rows = rows.join(gone, rows.i.eqNullSafe(gone.doc_id) & (rows.h1 == gone.k1) & (rows.h2 == gone.k2), "left")
    text = F.col("doc")[text_col].cast("string")
    split = F.split(text, "\n")
    keep = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone")))
    rows = rows.select("doc", "gone", "n_near", "n_equal", F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(keep, lambda i: F.get(split, i)), "\n")).alias("new_text"), F.size(F.filter(split, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).alias("n_lines"))
    if drop_emptied:
        rows = rows.where(F.col("gone").isNull() | F.col("new_text").rlike(r"[^\x20\x09-\x0D]"))
    added = ["n_lines", "n_equal", "n_near"] if counts else []
    columns = [F.col("new_text").alias(c) if c == text_col else F.length("new_text").cast("long").alias(c) if c == "n_chars" else F.col("doc")[c].alias(c) for c in docs.columns if c not in added]
    return rows.select(*columns, *[F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in added])


__all__ = ["dedup_lines", "find_duplicates"]
