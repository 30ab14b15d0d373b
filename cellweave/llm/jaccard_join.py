"""Operator 10: n-gram Jaccard join in metric space.

A document's set holds its distinct shingles of ``width`` words (64-bit hashes).  Documents with
100 x intersection >= ``percent`` x union link, that is, lie within r = 1 - percent / 100 of each
other by Jaccard distance, which is a metric.  Equal sets are one point from the start, so copies
cost one row.

Points and pivots.  Nearly all points of a corpus are alone: their distance to every other is close
to 1, so no pivot document tells them apart, and a triangle window of 2 r around the nearest of any
drawn pivots holds all of them.  So each point finds the pivots that can be near it by keys: in hash
order, each two neighbours of a set make one key.  A partner within r that lacks a of n shingles and
has b others keeps all but 2 a + b of these keys, at most k = 2 s + floor(100 (n - s) / percent) - n
with s = n - ceil(percent n / 100); hence the k + j least keys of two points that link have j in
common.  Unlike a shingle, a key is rarely shared by sets that aren't near each other.  A point that
shares fewer than j of its k + j least keys with any other, for j = k / 4 + 1, is alone.  Of the
open points that share a key, the least is a pivot, and the others belong to its Voronoi region, as
often as they have such keys.  Each point leaves the regions to which it belongs least, as far as
they have (j - 1) / 2 of its keys together: what two points that both leave can have in common there is less than j,
so points that link stay together in a region.  What remains is a point's own region and those across
whose boundary a partner can stand.

Regions join exactly.  A region of at most ``block`` points and ``mass`` shingles is one group: each
point's exact distance to the pivot is taken, pairs whose distances to it differ by more than r
can't link (triangle inequality), pairs already connected need no comparison, and all others are
compared.  A larger region splits recursively: it draws ``drawn`` pivots, each point gets its exact
distances to them, in groups of bounded size, and goes to the region of the nearest and to those of
all pivots at most 2 r farther (the window that replicates boundary points).  A region that such
windows can't shrink by three tenths (many points within 2 r of each other) is joined in pairs of
blocks: points within r of the pivot with most such points are connected already, so only the others
meet all blocks, and distances to all pivots prune the pairs.  The links that are left out are those
inside a component that is connected without them.

Plan: shingles are hashed in tasks, and only keys are shuffled, (key, point) pairs that Spark
aggregates by key.  Texts of open points, one each, are picked on a second reading by a bitmap over
hashes of texts, which may let others pass (a join takes them out) but misses none.  Pivots and regions
are DataFrame operations; only regions run in Python.  Work tables are written to the shared folder.

Defined cases: null or empty text has an empty set, size 0, and links with nothing; fewer words
than ``width`` make one shingle; very long texts are whole sets like others; repeated rows are equal
points; ties in hashes are ordered by fingerprint; a null id never becomes a component's name unless
all its ids are null; further columns of the input, whatever their names, aren't read; an empty table
gives no rows.  Points are told apart by 64-bit fingerprints of their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, digest, discard, input_rows, materialize

#: Odd multipliers of the 64-bit mix.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingles:
    """Text -> sorted distinct shingle hashes."""

    def __init__(self, width: int, cache: int = 100_000):
        self.width, self.cache, self.words = width, cache, WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode("utf-8", "replace").lower().split()
        if not tokens:
            return np.empty(0, np.int64)
        known = self.words
        if len(known) > self.cache:
            known.clear()
        h = np.array([known[w] for w in tokens], np.uint64)
        k = min(self.width, len(h))
        with np.errstate(over="ignore"):
            code = np.full(len(h) - k + 1, k, np.uint64)
            for j in range(k):
                code = (code ^ h[j : len(h) - k + 1 + j]) * MIX[0]
                code = (code ^ (code >> np.uint64(29))) * MIX[1]
            code = (code ^ (code >> np.uint64(32))) * MIX[2]
        return np.unique(code.view(np.int64))


def point_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    bound_batches(docs.sparkSession)
    return input_rows(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def lost_keys(n: int, percent: int) -> int:
    """How many keys of a set of n shingles a partner may lack."""
    lacks = n + (-percent * n // 100)
    return 2 * lacks + 100 * (n - lacks) // percent - n


def keys_of(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The k + j least keys of a set, in order, of which each partner has j, and k; none if the set is
    too small for a partner."""
    n = len(shingles)
    if 100 * n < percent * (n + 1):
        return np.empty(0, np.int64), 0
    s, k = shingles.view(np.uint64), lost_keys(n, percent)
    with np.errstate(over="ignore"):
        code = (s[:-1] * MIX[0]) ^ (s[1:] >> np.uint64(7))
        code = (code ^ (code >> np.uint64(32))) * MIX[1] + s[1:]
        code = (code ^ (code >> np.uint64(29))) * MIX[2]
    code = (code ^ (code >> np.uint64(32))).view(np.int64)
    wanted = min(len(code), k + k // 4 + 1)
    return np.sort(np.partition(code, wanted - 1)[:wanted]), k


def points_of(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, mark, point, n (set size), keys and k (those that a partner may lack)."""
    names = "doc_id long, mark long, point long, n long, keys array<long>, k int"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingles(width)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, rows = b.slice(at, 500), []
                for doc, mark, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    s = sets.of(text.as_py())
                    rows.append((doc, mark, point_of(s), len(s), *keys_of(s, percent)))
                if rows:
                    yield batch(rows, names)

    return texts.mapInArrow(make, names)


def not_alone(rows: DataFrame) -> DataFrame:
    """point, mark (of one of its texts) of those that share as many keys with different points as a
    partner must have."""
    points = rows.where(F.size("keys") > 0).groupBy("point").agg(F.max("k").alias("k"), F.min("mark").alias("mark"))
    once = rows.select("point", F.explode("keys").alias("key")).groupBy("key").agg(F.min("point").alias("a"), F.max("point").alias("b")).where("a = b")
    own = once.groupBy(F.col("a").alias("point")).agg(F.count(F.lit(1)).alias("own"))
    return points.join(own, "point", "left").where(F.coalesce("own", F.lit(0)) <= F.col("k")).select("point", "mark")


def bit_of(value: Column, bits: int) -> tuple[Column, Column]:
    """Word and place in it of a value's bit."""
    at = F.pmod(value, F.lit(bits))
    return F.shiftright(at, 6).cast("int"), F.pmod(at, F.lit(64)).cast("int")


def bitmap(points: DataFrame, most_bits: int = 1 << 27) -> tuple[DataFrame, int]:
    """One row, an array of bits with one set for each mark, and how many bits."""
    bits = min(most_bits, 1 << max(16, (64 * points.count()).bit_length()))
    word, place = bit_of(F.col("mark"), bits)
    words = points.select(word.alias("w"), place.alias("p")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, p)")).alias("b"))
    dense = points.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return materialize(dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda s: s["b"]).alias("bits")), "bitmap"), bits


def marked(rows: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """Rows whose mark has its bit set."""
    word, place = bit_of(F.col("mark"), bits)
    return rows.where(F.getbit(F.get(marks.scalar(), word), place) == 1)


def members_of(texts: DataFrame, width: int, cells: DataFrame) -> DataFrame:
    """cell, point, n, shingles.  ``texts``: at least one of each point."""
    names = "point long, shingles array<long>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = Shingles(width), set()
        rows, size = [], 0
        for b in batches:
            for mark, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if mark in seen:
                    continue
                if len(seen) < 100_000:
                    seen.add(mark)
                s = sets.of(text.as_py())
                rows.append((point_of(s), s))
                size += 8 * len(s)
                if size >= 4 << 20:
                    yield batch(rows, names)
                    rows, size = [], 0
        if rows:
            yield batch(rows, names)

    made = texts.select("mark", "text").mapInArrow(make, names)
    sets = made.groupBy("point").agg(F.first("shingles").alias("shingles"))
    return cells.join(sets, "point").select("cell", "point", "n", "shingles")


def regions_of(rows: DataFrame) -> DataFrame:
    """cell (its pivot), point, n.  ``rows``: one of each open point."""
    keyed = rows.select("point", "n", (F.size("keys") - F.col("k")).alias("j"), F.explode("keys").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("point").alias("cell"), F.max("point").alias("last")).where("cell <> last").select("key", "cell")
    held = keyed.join(pivots, "key").groupBy("cell", "point").agg(F.max("n").alias("n"), F.max("j").alias("j"), F.count(F.lit(1)).alias("held"))
    upto = F.sum("held").over(Window.partitionBy("point").orderBy("held", "cell").rowsBetween(Window.unboundedPreceding, 0))
    stay = held.withColumn("upto", upto).where(2 * F.col("upto") > F.col("j") - 1)
    own = stay.select("cell").distinct().withColumn("point", F.col("cell"))
    stay = stay.select("cell", "point", "n").unionByName(own.join(rows.select("point", "n"), "point")).distinct()
    return materialize(stay, "cells")


class Sets:
    """The points of one group, their sets as one array of numbers local to the group."""

    def __init__(self, table: pa.Table):
        self.point = table.column("point").to_numpy()
        self.n = table.column("n").to_numpy()
        lists = table.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.offset = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy()[self.offset[0] : self.offset[-1]]
        self.offset -= self.offset[0]
        self.kinds, self.flat = np.unique(flat, return_inverse=True)
        self.held = np.zeros(len(self.kinds) + 1, np.int8)

    def set_of(self, x: int) -> np.ndarray:
        return self.flat[self.offset[x] : self.offset[x + 1]]

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of x with others."""
        own = self.set_of(x)
        self.held[own] = 1
        if 4 * int(self.n[others].sum()) > len(self.flat) and len(others) > 8:
            out = np.add.reduceat(self.held[self.flat], self.offset[:-1], dtype=np.int64)[others]
        else:
            out = np.array([int(self.held[self.set_of(y)].sum(dtype=np.int64)) for y in others], np.int64)
        self.held[own] = 0
        return out

    def distances(self, x: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intersections and Jaccard distances."""
        both = self.shared(x, others)
        return both, 1 - both / (self.n[x] + self.n[others] - both)


def joined(sets: Sets, far: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """Labels (a point's number each) that connect what links, over pairs whose distances ``far``
    (points x pivots) differ by r at most; of two sides, if given, only pairs across."""
    n, radius, label = sets.n, 1 - percent / 100 + 1e-9, np.arange(len(sets.n))
    for x in range(len(n) - 1):
        able = (label[x + 1 :] != label[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= percent * np.maximum(n[x + 1 :], n[x]))
        if side is not None:
            able &= side[x + 1 :] != side[x]
        able &= (np.abs(far[x + 1 :] - far[x]) <= radius).all(axis=1)
        others = np.flatnonzero(able) + x + 1
        if len(others):
            both = sets.shared(x, others)
            for y in others[100 * both >= percent * (n[x] + n[others] - both)]:
                if label[y] != label[x]:
                    label[label == label[y]] = label[x]
    return label


LINKS = "a long, b long"


def stars(point: np.ndarray, label: np.ndarray) -> pa.Table:
    """Links of each point to the first of its label."""
    other = label != np.arange(len(label))
    return pa.table({"a": pa.array(point[other], pa.int64()), "b": pa.array(point[label[other]], pa.int64())})


def join_regions(members: DataFrame, percent: int) -> DataFrame:
    """Links within regions of bounded size, each one group."""

    def join(table: pa.Table) -> pa.Table:
        s = Sets(table)
        pivot = int(np.argmax(s.point == table.column("cell")[0].as_py()))
        _, far = s.distances(pivot, np.arange(len(s.n)))
        return stars(s.point, joined(s, far[:, None], percent))

    return members.groupBy("cell").applyInArrow(join, LINKS)


def measured(large: DataFrame, sets: DataFrame, mass: int, drawn: int, level: int) -> DataFrame:
    """cell, point, n, pivots, far: the distances of a large region's points to ``drawn`` of them."""
    place = lambda j: F.struct(digest("point", F.lit(1000 * (level + 1) + j)), "point")
    picked = large.groupBy("cell").agg(F.array_sort(F.array_distinct(F.array(*[F.min(place(j))["point"] for j in range(drawn)]))).alias("pivots"), F.ceil(F.sum("n") / mass).cast("int").alias("parts"))
    picked = materialize(picked, "pivots")
    some = large.select("cell", "point", "n").join(picked, "cell").withColumn("part", F.pmod(digest("point", F.lit(level)), F.col("parts")).cast("int"))
    each = picked.select("cell", "pivots", "parts", F.explode("pivots").alias("point")).select("cell", "pivots", "point", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = some.select("cell", "part", "point", "n", "pivots", F.lit(False).alias("pivot")).unionByName(each.join(sets.select("point", "n"), "point").select("cell", "part", "point", "n", "pivots", F.lit(True).alias("pivot")))

    def measure(table: pa.Table) -> pa.Table:
        s = Sets(table)
        is_pivot = np.array(table.column("pivot").to_pylist())
        pivots, rest = table.column("pivots")[0].as_py(), np.flatnonzero(~is_pivot)
        at = {int(s.point[i]): i for i in np.flatnonzero(is_pivot)}
        far = np.stack([s.distances(at[p], rest)[1] for p in pivots], axis=1) if len(rest) else np.empty((0, len(pivots)))
        kept = table.select(["cell", "point", "n", "pivots"]).take(pa.array(rest))
        return kept.append_column("far", pa.array(list(far), pa.list_(pa.float64())))

    done = both.join(sets.select("point", "shingles"), "point").groupBy("cell", "part").applyInArrow(measure, "cell long, point long, n long, pivots array<long>, far array<double>")
    return materialize(done, "measured")


def join_blocks(stuck: DataFrame, sets: DataFrame, percent: int, block: int, mass: int) -> DataFrame:
    """Links within large regions that pivots can't split, by pairs of blocks.

    The pivot with most points within r has them connected; pairs of two such points are left out.
    """
    radius = 1 - percent / 100 + 1e-9
    near = stuck.select("cell", F.posexplode("far").alias("j", "d")).groupBy("cell", "j").agg(F.count_if(F.col("d") <= radius).alias("n_near"))
    main = near.groupBy("cell").agg(F.max(F.struct("n_near", "j"))["j"].alias("j"))
    sized = stuck.join(main, "cell").withColumn("inner", F.get("far", "j") <= radius)
    sizes = sized.groupBy("cell", "inner").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / mass)).cast("int").alias("blocks"))
    outer = sizes.where("not inner").select("cell", F.col("blocks").alias("outer"))
    inner = sizes.where("inner").select("cell", F.col("blocks").alias("inners"))
    sizes = materialize(outer.join(inner, "cell", "left").select("cell", "outer", F.coalesce("inners", F.lit(0)).alias("inners")), "blocks")
    # outer blocks are numbered first, so a pair (i, j) with i <= j always has an outer block in front
    own = F.when(F.col("inner"), F.col("outer") + F.pmod(digest("point"), F.greatest(F.col("inners"), F.lit(1)))).otherwise(F.pmod(digest("point"), F.col("outer"))).cast("int")
    dealt = sized.join(sizes, "cell").withColumn("own", own)
    others = F.when(F.col("inner"), F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") + F.col("inners") - 1))
    dealt = dealt.select("cell", "point", "n", "far", "own", F.explode(others).alias("other"))
    dealt = dealt.select("cell", "point", "n", "far", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        s = Sets(table)
        far = np.stack([np.asarray(x) for x in table.column("far").to_pylist()])
        side = table.column("own").to_numpy()
        alike = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        return stars(s.point, joined(s, far, percent, None if alike else side))

    return dealt.join(sets.select("point", "shingles"), "point").groupBy("cell", "i", "j").applyInArrow(compare, LINKS)


def links_of(members: DataFrame, percent: int, block: int, mass: int, drawn: int, depth: int = 8) -> DataFrame:
    """Links (a, b) that connect all points of each region that links connect.

    What is large after ``depth`` levels is joined by blocks.
    """
    radius, found, level, sets = 1 - percent / 100 + 1e-9, [], 0, None
    while True:
        cells = members.select("cell", "point", "n")
        sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).where((F.col("size") > block) | (F.col("total") > mass))
        sizes = materialize(sizes, "large")
        found.append(materialize(join_regions(members.join(sizes, "cell", "left_anti"), percent), "links"))
        if sizes.isEmpty():
            break
        large = members.join(sizes, "cell", "left_semi")
        sets = sets or materialize(large.groupBy("point").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "sets")
        far = measured(large.select("cell", "point", "n"), sets, mass, drawn, level)
        each = far.select("cell", "point", "n", F.array_min("far").alias("least"), F.explode(F.arrays_zip("pivots", "far")).alias("x"))
        each = each.select("cell", "point", "n", "least", F.col("x.pivots").alias("pivot"), F.col("x.far").alias("d"))
        found.append(materialize(each.where((F.col("d") <= radius) & (F.col("point") != F.col("pivot"))).select(F.col("point").alias("a"), F.col("pivot").alias("b")), "links"))
        window = each.where(F.col("d") <= F.col("least") + 2 * radius)
        child = window.groupBy("cell", "pivot").agg(F.count(F.lit(1)).alias("held")).groupBy("cell").agg(F.max("held").alias("held"))
        split = materialize(child.join(sizes, "cell").where((F.col("held") <= 0.7 * F.col("size")) & F.lit(level < depth)).select("cell"), "split")
        found.append(materialize(join_blocks(far.join(split, "cell", "left_anti"), sets, percent, block, mass), "links"))
        if split.isEmpty():
            break
        # regions are named by their pivots, so those of one pivot join once
        cells = window.join(split, "cell").select(F.col("pivot").alias("cell"), "point", "n").distinct()
        members = materialize(cells.join(sets.select("point", "shingles"), "point").select("cell", "point", "n", "shingles"), "members")
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = materialize(out.distinct(), "links")
    discard(*found, *([sets] if sets else []))
    return out


def connected(links: DataFrame) -> DataFrame:
    """point, label: the smallest point that links lead to, of the points that have links.

    Each round takes the smallest label next door, then that label's own label, so distances halve.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialize(both.groupBy(F.col("a").alias("point")).agg(F.min("b").alias("near")).select("point", F.least("point", "near").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("point").alias("b"), "label"), "b").groupBy(F.col("a").alias("point")).agg(F.min("label").alias("near"))
        step = labels.join(near, "point").select("point", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("point").alias("label"), F.col("label").alias("far"))
        new = materialize(step.join(jump, "label").select("point", "old", F.least("label", "far").alias("label")), "labels")
        settled = new.where("old <> label").isEmpty()
        discard(labels)
        labels = new.select("point", "label")
        if settled:
            discard(both)
            return labels


def components(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 1024, mass: int = 1 << 21, drawn: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, point, component_id (the smallest doc_id of
    the component)."""
    if percent <= 75:
        raise ValueError("percent must be above 75")
    texts = texts_of(docs, id_col, text_col)
    rows = materialize(points_of(texts, width, percent), "points")
    points = materialize(not_alone(rows), "open")
    marks, bits = bitmap(points)
    open_rows = marked(rows, marks, bits).groupBy("point").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.first("keys").alias("keys"))
    open_rows = materialize(open_rows.join(points.select("point"), "point", "left_semi"), "open")
    cells = regions_of(open_rows)
    members = materialize(members_of(marked(texts, marks, bits), width, cells), "members")
    links = links_of(members, percent, block, mass, drawn)
    labels = connected(links)

    least = rows.where("n > 0").groupBy("point").agg(F.min("doc_id").alias("least"))
    named = least.join(labels, "point", "left").select("point", "least", F.coalesce("label", "point").alias("label"))
    smallest_id = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(smallest_id, "label").select("point", "component_id")
    found = rows.drop("keys", "k").join(named, "point", "left")
    found = found.select("doc_id", "mark", F.col("n").alias("n_shingles"), "point", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    found = materialize(found, "components")
    discard(rows, points, marks, open_rows, cells, members, links, labels)
    return found


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (then text hash).

    Documents without words are components of their own; repeated rows count once.
    """
    found = components(docs, id_col=id_col, text_col=text_col, **options)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    name = F.when(F.col("n_shingles") > 0, F.struct(F.lit(0).alias("kind"), F.coalesce("component_id", "point").alias("id"))).otherwise(F.struct(F.lit(1).alias("kind"), F.xxhash64("doc_id", "mark").alias("id")))
    keep = found.select(name.alias("name"), place.alias("place")).groupBy("name").agg(F.min("place").alias("place")).select(F.col("place.doc_id").alias("keep_id"), F.col("place.mark").alias("keep_mark"), F.lit(1).alias("keep"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].cast("long").alias("i"), F.xxhash64(docs[text_col].cast("string")).alias("h"))
    kept = rows.join(keep.distinct(), rows.i.eqNullSafe(keep.keep_id) & (rows.h == keep.keep_mark), "left_semi").dropDuplicates(["i", "h"])
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
