"""Tests against drawn sets, shuffled weights and shuffled scores, with reproducible draws."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import by_length, hashed, hashed_items, hashed_rows
from . import network as N
from .graph import cut, stored
from .hubs import BLOCKS, exceed, null_strengths, numbered, rewired

NET = N.NET


def degree_pools(net: DataFrame, spread: float = 0.2) -> DataFrame:
    """NET, gene, degree, pos, low, pool: genes in order of degree, and where those of a like degree
    (``spread`` more or less, rounded outwards) begin and how many they are.

    Ranges are looked up by degree, of which a network has few, and not by gene.
    """
    nodes = N.degree(net).withColumn("pos", (F.row_number().over(Window.partitionBy(*NET).orderBy("degree", "gene")) - 1).cast("long"))
    of = nodes.groupBy(*NET, "degree").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    reach = F.sequence(F.floor(F.col("degree") * (1 - spread)).cast("long"), F.ceil(F.col("degree") * (1 + spread)).cast("long"))
    near = of.select(*NET, F.col("degree").alias("of"), F.explode(reach).alias("degree")).join(of, [*NET, "degree"])
    near = near.groupBy(*NET, F.col("of").alias("degree")).agg(F.min("first").alias("low"), F.sum("n").alias("pool"))
    return nodes.join(near, [*NET, "degree"]).select(*NET, "gene", "degree", "pos", "low", "pool")


def drawn_positions(low: np.ndarray, pool: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """draws x slots: for each draw (a row of ``hashes``) a position for each slot from the ``pool`` places that begin at
    ``low``, none twice; an exhausted pool ends the draw, which is -1 from there.

    A slot takes the free place whose number among its pool's free ones is its hash's share of them.  All draws take a
    slot together.  A draw's taken places are bits of words, and counts over ``FAN`` words, ``FAN`` times as many and so
    on lead down to the word, so that a slot does not look at all that were taken before it.
    """
    draws, slots = hashes.shape
    base, n = int(low.min()), int((low + pool).max() - low.min())
    own, one, upto = np.arange(draws), np.uint64(1), np.triu(np.ones((FAN, FAN)))
    bits = np.zeros((draws, -(-n // 64)), np.uint64)
    counts = []  # by word, by FAN words, ...
    while not counts or counts[-1].shape[1] > FAN:
        under = bits.shape[1] if not counts else counts[-1].shape[1] // FAN
        counts.append(np.zeros((draws, -(-under // FAN) * FAN), np.int32))
    edges, at = np.unique(np.concatenate([low, low + pool]), return_inverse=True)
    taken = np.zeros((len(edges), draws), np.int32)  # places taken before each edge of a pool
    alive, out = np.ones(draws, bool), np.full((slots, draws), -1, np.int64)
    for s in range(slots):
        first, last = taken[at[s]], taken[at[slots + s]]
        free = pool[s] - (last - first)
        alive &= free > 0
        if not alive.any():
            break
        r = np.where(alive, np.floor(hashes[:, s] / 4294967296.0 * free).astype(np.int64) + (low[s] - base - first), 0)
        node = np.zeros(draws, np.intp)
        for i in range(len(counts) - 1, -1, -1):
            size = 64 * FAN**i
            under = counts[i].reshape(-1, FAN)
            ends = np.subtract(size, under.take(own * (len(under) // draws) + node, 0), dtype=float) @ upto
            child = (ends > r[:, None]).argmax(1)
            r -= np.where(child > 0, ends[own, child - 1], 0).astype(np.int64)
            node = node * FAN + child
        word, bit = ~bits[own, node], np.zeros(draws, np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            under = np.bitwise_count((word >> bit) & np.uint64(2**width - 1))
            up = under <= r
            r -= under * up
            bit += up * np.uint64(width)
        pos = base + node * 64 + bit.astype(np.int64)
        bits[own, node] |= alive * (one << bit)
        for i in range(len(counts)):
            counts[i][own, node // FAN**i] += alive
        taken += alive & (pos < edges[:, None])
        out[s] = np.where(alive, pos, -1)
    return out.T


#: Words, and counts of words, that a count covers.
FAN = 16
#: So many edges or values go to a task at a time, and so many sets are drawn together.
PART, TOGETHER = 2**20, 500


def in_parts(rows: DataFrame, keys: list[str], n: DataFrame, *values: Column) -> DataFrame:
    """keys, items: structs of ``values``, dealt by a hash into arrays of about ``PART``; ``n`` has the number of rows by key."""
    part = F.pmod(F.xxhash64(*values), F.ceil(F.col("_n") / PART))
    dealt = rows.join(n.select(*keys, F.col("n").alias("_n")), keys).select(*keys, part.alias("_part"), F.struct(*values).alias("item"))
    return dealt.groupBy(*keys, "_part").agg(F.collect_list("item").alias("items")).drop("_part")


def null_connectivity(edges: DataFrame, slots: DataFrame, sims: int, seed: int) -> DataFrame:
    """NET, sim, k: the edges (NET, p1, p2) between the positions of each drawn set.

    A task has a network's slots and draws a block of sets; the network's edges then pass it in parts.
    """
    n_tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = in_parts(edges, NET, edges.groupBy(*NET).agg(F.count(F.lit(1)).alias("n")), F.col("p1").cast("int").alias("p1"), F.col("p2").cast("int").alias("p2"))
    prefix = F.concat_ws("|", F.lit(seed).cast("string"), *NET)
    both = slots.select(*NET, prefix.alias("prefix"), "slots", F.lit(None).cast("array<struct<p1:int,p2:int>>").alias("items"))
    both = both.unionByName(parts.join(slots.select(*NET), NET, "left_semi").select(*NET, prefix.alias("prefix"), F.lit(None).cast(dict(slots.dtypes)["slots"]).alias("slots"), "items"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((sims - 1) // TOGETHER)))
    dealt = both.select("*", blocks.alias("block")).repartition(n_tasks, *NET, "block").sortWithinPartitions(*NET, "block", F.col("slots").isNull())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = drawn = k = None

        def result():
            celltype, condition, block = key
            return pa.RecordBatch.from_arrays([pa.array([celltype] * len(k), pa.string()), pa.array([condition] * len(k), pa.string()), pa.array(np.arange(len(k)) + block * TOGETHER + 1), pa.array(k)], names=[*NET, "sim", "k"])

        for batch in batches:
            for i in range(batch.num_rows):
                celltype, condition, prefix, block = (batch.column(c)[i].as_py() for c in (0, 1, 2, 5))
                if batch.column(3)[i].is_valid:
                    if key is not None:
                        yield result()
                    key, slots = (celltype, condition, block), batch.column(3)[i].values
                    low, pool = (slots.field(f).to_numpy(zero_copy_only=False) for f in (1, 2))
                    named = [f"{prefix}|{sim}".encode() for sim in range(block * TOGETHER + 1, min(sims, (block + 1) * TOGETHER) + 1)]
                    drawn = drawn_positions(low, pool, hashed_rows(named, len(low))).astype(np.int32)
                    k = np.zeros(len(named), np.int64)
                    continue
                p1, p2 = (batch.column(4)[i].values.field(f).to_numpy(zero_copy_only=False) for f in (0, 1))
                inside = np.zeros(max(drawn.max(), p1.max(), p2.max()) + 2, bool)
                for sim, pos in enumerate(drawn):
                    inside[pos] = True
                    inside[-1] = False  # no position, of draws that ended
                    k[sim] += np.count_nonzero(inside[p1] & inside[p2])
                    inside[pos] = False
        if key is not None:
            yield result()

    return dealt.select(*NET, "prefix", "slots", "items", "block").mapInArrow(counted, "celltype string, condition string, sim long, k long").where("k > 0")


def connectivity_test(net: DataFrame, genes: DataFrame, sims: int = 10_000, seed: int = 1) -> DataFrame:
    """NET, detected, connectivity, p: edges within a gene set against sets of genes of like degree.

    Each of ``sims`` sets has, for every gene that the network has, one of a degree within a fifth;
    p is (1 + number of sets with more edges) / sims.  Sets are drawn in blocks, each in one task.
    """
    net = cut(net)
    pools = cut(degree_pools(net))
    found = pools.join(genes.select("gene").distinct(), "gene", "left_semi")
    slots = cut(found.withColumn("slot", F.row_number().over(Window.partitionBy(*NET).orderBy("gene"))).groupBy(*NET).agg(F.array_sort(F.collect_list(F.struct("slot", "low", "pool"))).alias("slots")))
    end = lambda k: pools.select(*NET, F.col("gene").alias(f"gene{k}"), F.col("pos").alias(f"p{k}"))
    edges = cut(net.join(end(1), [*NET, "gene1"]).join(end(2), [*NET, "gene2"]).select(*NET, "p1", "p2"))
    null = null_connectivity(edges, slots, sims, seed).groupBy(*NET, "k").agg(F.count(F.lit(1)).alias("n"))
    own = genes.select("gene").distinct()
    seen = net.join(own.withColumnRenamed("gene", "gene1"), "gene1", "left_semi").join(own.withColumnRenamed("gene", "gene2"), "gene2", "left_semi")
    seen = seen.groupBy(*NET).agg(F.count(F.lit(1)).alias("connectivity"))
    rows = slots.select(*NET, F.size("slots").cast("long").alias("detected")).join(seen, NET, "left").fillna(0, ["connectivity"])
    above = F.coalesce(F.sum(F.when(F.col("k") > F.col("connectivity"), F.col("n"))), F.lit(0))
    return rows.join(null, NET, "left").groupBy(*NET, "detected", "connectivity").agg(((1 + above) / F.lit(sims)).alias("p"))


#: A network of up to so many edges, or nodes, is shuffled in a task with arrays; where one has more all go by tables.
WHOLE = 2**24


def blocks_for(net: DataFrame, reps: int) -> int | None:
    """Into how many blocks ``reps`` shuffles are dealt by network, so that there is enough for all cores; none if tables are to be used:
    a network is too large for arrays, or a weight null or no double."""
    each = net.groupBy(*NET).agg(F.count(F.lit(1)).alias("n"), F.count("lls").alias("known"))
    most, nets, nulls = each.agg(F.max("n"), F.count(F.lit(1)), F.sum(F.col("n") - F.col("known"))).first()
    if most is None or most > WHOLE or nulls or dict(net.dtypes)["lls"] != "double":
        return None
    return min(reps, BLOCKS, -(-3 * net.sparkSession.sparkContext.defaultParallelism // nets))


def in_blocks(tables: list[DataFrame], seed: int, reps: int, blocks: int, of, schema: str) -> DataFrame:
    """NET and what ``of`` makes in a task of a network's tables (NET, values), for each block of shuffles.

    ``of`` gets the columns of all tables, the prefix of the network's hashes and the block's shuffles, and gives columns.
    """
    n_tasks = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, names, rows = "celltype IS NOT NULL AND condition IS NOT NULL", [], None
    for i, table in enumerate(tables):
        values = [c for c in table.columns if c not in NET]
        parts = in_parts(table.where(own), NET, table.groupBy(*NET).agg(F.count(F.lit(1)).alias("n")), *[F.col(c) for c in values])
        parts = parts.select(*NET, F.lit(i).alias("table"), *[F.col(f"items.{c}").alias(c) for c in values])
        rows, names = (parts if rows is None else rows.unionByName(parts, allowMissingColumns=True)), names + values
    rows = rows.select(*NET, F.concat_ws("|", F.lit(seed).cast("string"), *NET).alias("prefix"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *names)
    per = -(-reps // blocks)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def result():
            celltype, condition, prefix, block = key
            columns = [pa.concat_arrays([r[c].values for r in held if r[c].is_valid] or [pa.array([], held[0][c].type.value_type)]) for c in range(len(names))]
            for out in of(*columns, prefix, range(block * per + 1, min(reps, block * per + per) + 1)):
                own = [pa.repeat(pa.scalar(v, pa.string()), len(out[0])) for v in (celltype, condition)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, out)], names=[*NET, *map(str, range(len(out)))])

        for batch in batches:
            for i in range(batch.num_rows):
                here = tuple(batch.column(c)[i].as_py() for c in range(4))
                if held and here != key:
                    yield from result()
                    held = []
                key = here
                held.append([batch.column(4 + c)[i] for c in range(len(names))])
        if held:
            yield from result()

    dealt = rows.repartition(n_tasks, *NET, "block").sortWithinPartitions(*NET, "block")
    return dealt.mapInArrow(made, f"celltype string, condition string, {schema}")


def dealt_order(key: bytes, items: list, suffix: bytes, n: int) -> np.ndarray:
    """The numbers 0 to n - 1 in the order of their items' hashes."""
    keys = hashed_items(key, items, suffix, n).astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    keys.sort()
    return (keys & np.uint64(2**32 - 1)).astype(np.int64)


def shuffled_strengths(net: DataFrame, reps: int, seed: int, blocks: int, of, schema: str) -> DataFrame:
    """NET and what ``of`` makes of strengths (shuffles x nodes) in networks whose weights are shuffled, a block of shuffles of a
    network at a time; they are those of ``null_strengths`` of ``rewired`` with probability 0."""
    nodes, by_net = numbered(net), Window.partitionBy(*NET)
    edges = net.withColumn("edge", F.row_number().over(by_net.orderBy("gene1", "gene2")))
    for c in ("1", "2"):
        edges = edges.join(nodes.select(*NET, F.col("gene").alias(f"gene{c}"), F.col("i").cast("int").alias(f"i{c}")), [*NET, f"gene{c}"])
    edges = edges.select(*NET, "edge", "i1", "i2", F.col("lls").cast("double").alias("lls"))

    def strengths(edge, i1, i2, lls, prefix, own):
        order = np.argsort(edge.to_numpy())
        a, b, w = (c.to_numpy()[order] for c in (i1, i2, lls))
        n, m = int(max(a.max(), b.max())) + 1, len(a)
        b = np.where(a == b, (b + 1) % n, b)
        items, value = by_length(pa.array(np.arange(1, m + 1)).cast(pa.string())), np.empty((len(own), n))
        for r, rep in enumerate(own):
            got = np.empty(m)
            got[dealt_order(f"{prefix}|{rep}|".encode(), items, b"|weight", m)] = w
            value[r] = np.bincount(a, got, n) + np.bincount(b, got, n)
        yield of(value)

    return in_blocks([edges], seed, reps, blocks, strengths, schema)


def weight_hubs(net: DataFrame, reps: int = 100, seed: int = 1, method: str = "bh") -> DataFrame:
    """Strength of each gene against the same edges with weights shuffled ``reps`` times."""
    net = cut(net)
    blocks = blocks_for(net, reps)
    if blocks is None:
        null = null_strengths(rewired(net, reps, 0.0, seed)).select(*NET, "value")
    else:
        null = shuffled_strengths(net, reps, seed, blocks, lambda value: np.unique(value, return_counts=True), "value double, times long")
    return N.p_adjust(exceed(N.strength(net), null, NET, "value"), "p", NET, ["gene"], [method]).withColumnRenamed(f"p_{method}", "q")


def shuffled(x: DataFrame, reps: int, seed: int) -> DataFrame:
    """NET, gene, xs: values (NET, gene, x) dealt anew over the nodes ``reps`` times, as an array whose first is x as it is.

    A task gets a network's nodes once for a block of shuffles and repeats them there; node and value meet by
    number where all rows of a shuffle are, and the blocks' arrays are put together by node.
    """
    n_tasks, per = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-reps // BLOCKS)
    slots = x.withColumn("slot", F.row_number().over(Window.partitionBy(*NET).orderBy("gene")))
    blocks = F.sequence(F.lit(0), F.lit((reps - 1) // per))
    dealt = slots.select(*NET, "gene", "x", "slot", F.explode(blocks).alias("block")).repartition(n_tasks, *NET, "block")
    rows = dealt.select(*NET, "block", "gene", "x", "slot", F.explode(F.sequence(F.col("block") * per + 1, F.least(F.lit(reps), F.col("block") * per + per))).alias("rep"))
    key = hashed(F.lit(seed), F.col("celltype"), F.col("condition"), F.col("rep"), F.col("gene"))
    own = [*NET, "block", "rep"]
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*own).orderBy(key, "gene")))
    kind = dict(x.dtypes)
    two = F.array(F.struct("at", "gene", F.lit(None).cast(kind["x"]).alias("x")), F.struct(F.col("slot").alias("at"), F.lit(None).cast(kind["gene"]).alias("gene"), "x"))
    met = rows.select(*own, F.explode(two).alias("t")).groupBy(*own, "t.at").agg(F.max("t.gene").alias("gene"), F.max("t.x").alias("x"))
    parts = met.groupBy(*NET, "block", "gene").agg(F.array_sort(F.collect_list(F.struct("rep", "x"))).alias("xs")).select(*NET, "gene", "block", F.col("xs.x").alias("xs"))
    parts = parts.unionByName(x.select(*NET, "gene", F.lit(-1).alias("block"), F.array("x").alias("xs")))
    return parts.groupBy(*NET, "gene").agg(F.array_sort(F.collect_list(F.struct("block", "xs"))).alias("b")).select(*NET, "gene", F.flatten("b.xs").alias("xs"))


def over_edges(net: DataFrame, sides: DataFrame, term, *values: str) -> DataFrame:
    """NET, rep and the sum over edges of ``term`` (of the values a and b of both ends, by shuffle)."""
    side = lambda i: sides.select(*NET, F.col("gene").alias(f"gene{i}"), F.col("xs").alias(f"xs{i}"))
    ends = net.select(*NET, "gene1", "gene2", *values).join(side(1), [*NET, "gene1"]).join(side(2), [*NET, "gene2"])
    each = ends.select(*NET, *values, F.posexplode(F.arrays_zip(F.col("xs1").alias("a"), F.col("xs2").alias("b"))).alias("rep", "e"))
    return each.groupBy(*NET, "rep").agg(*[t.alias(name) for name, t in term(F.col("e.a"), F.col("e.b")).items()])


def over_shuffles(net: DataFrame, x: DataFrame, reps: int, seed: int, blocks: int, term, schema: str) -> DataFrame:
    """NET, rep and the columns that ``term`` gives of a network's weights and of the values x (NET, gene, x) at both ends of its edges,
    whose last says whether there are any; for x as it is (0) and for its shuffles, which are those of ``shuffled``."""
    slots = x.withColumn("slot", F.row_number().over(Window.partitionBy(*NET).orderBy("gene")))
    side = lambda i: slots.select(*NET, F.col("gene").alias(f"gene{i}"), F.col("slot").alias(f"s{i}"))
    edges = net.join(side(1), [*NET, "gene1"]).join(side(2), [*NET, "gene2"]).select(*NET, "s1", "s2", "lls")
    nodes = slots.select(*NET, "slot", F.col("gene").cast("string").alias("name"), "x")

    def sums(s1, s2, lls, slot, name, values, prefix, own):
        if not len(s1):
            return
        order = np.argsort(slot.to_numpy())
        known = values.is_valid().to_numpy(zero_copy_only=False)[order]
        values, items = values.fill_null(0).to_numpy()[order], by_length(name.take(pa.array(order)))
        a, b, w = s1.to_numpy() - 1, s2.to_numpy() - 1, lls.to_numpy()
        rows = []
        for rep in [0, *own] if own[0] == 1 else own:
            at = np.arange(len(values))
            if rep:
                at[dealt_order(f"{prefix}|{rep}|".encode(), items, b"", len(at))] = np.arange(len(at))
            i, j = at[a], at[b]
            there = known[i] & known[j]
            rows.append((rep, *term(w, values, i[there], j[there], w[there])))
        yield [np.array(c) for c in zip(*rows, strict=True)]

    return in_blocks([edges, nodes], seed, reps, blocks, sums, f"rep long, {schema}")


def autocorrelation_z(net: DataFrame, scores: DataFrame, reps: int = 100, seed: int = 1) -> DataFrame:
    """NET, autocorrelation, z: 1 - C / 2 with Geary's C of the scores (NET, gene, x), against
    ``reps`` shuffles of the scores over the nodes."""
    net, x = stored(net), stored(scores.select(*NET, "gene", F.col("x").cast("double").alias("x")))
    blocks = blocks_for(net, reps)
    if blocks is None:
        sides = stored(shuffled(x, reps, seed))
        d = over_edges(net, sides, lambda a, b: {"w": F.sum(2 * F.col("lls")), "d": F.sum(F.col("lls") * (a - b) * (a - b))}, "lls")
    else:
        d = over_shuffles(net, x, reps, seed, blocks, lambda w, x, i, j, own: (2 * w.sum(), (own * (x[i] - x[j]) ** 2).sum(), len(own)), "w double, d double, n long")
        d = d.select(*NET, "rep", "w", F.when(F.col("n") > 0, F.col("d")).alias("d"))
    mean = x.groupBy(*NET).agg(F.count("x").alias("n"), (F.var_pop("x") * F.count("x")).alias("ss"))
    c = d.join(mean, NET).where("ss > 0").select(*NET, "rep", (1 - (F.col("n") - 1) * F.col("d") / (2 * F.col("w") * F.col("ss")) / 2).alias("c"))
    rand = F.when(F.col("rep") > 0, F.col("c"))
    own = F.max(F.when(F.col("rep") == 0, F.col("c")))
    return c.groupBy(*NET).agg(own.alias("autocorrelation"), F.try_divide(own - F.avg(rand), F.stddev_samp(rand)).alias("z"))
