"""Communities of networks: local moves in parallel, refinement and contraction, all networks at once.

The quality is that of the configuration model with a resolution (modularity at 1), or of the constant
Potts model, which takes negative weights too.  In both, with a size k of each node (strength, or 1)
and a scale M (twice the network's weight, or 1), node i gains by moving from A to B

    w(i, B) - w(i, A) - r k_i (K_B - K_A + k_i) / M

A round moves many nodes and still never lowers the quality: of two adjacent nodes whose moves would
lose their edge's weight together (one enters what the other leaves) only one may move, by a hash that
changes each round; and a node moves only if its gain also pays
r k_i k_j / M for each other candidate j that enters B or leaves A and has at least its own hash level
(trailing zero bits, so that half the candidates are at level 0, a quarter at 1 and so on).  Of two
moves at least one pays for both, so the gains add up.  The sums by level are partial aggregations: no
window and no list over a community, however large it is.

Parts of a network that no edge joins share nothing but the scale, so parts of up to ``MANY`` nodes are solved by the same
rounds in a task, many together, with arrays for tables; a part's result does not depend on those that it meets there.
The rounds over tables then begin with what was found, and take the larger parts.  With more than ``MANY`` nodes, after a round only the nodes that wished to move and the neighbours of those that did are looked at, until none of
them gains; then all are, and the rounds end where none of all gains.  Edges lie in buckets by their source
and nodes by their name, so that a round shuffles what it looks at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways, components, laid, stored
from .network import NET

#: Gains from here on count as such, in units of edge weights.
LEAST_GAIN = 1e-9
#: Up to so many nodes a part is solved in a task, and a round over all costs less than finding those that need it.
MANY = 200_000
#: So many edges go to a task, if no part has more; up to so many of a network are looked through in a task for its parts.
PART, WHOLE = 2**20, 2**24


def candidates(edges: DataFrame, nodes: DataFrame, resolution: float, only_single: bool, active: DataFrame | None = None) -> DataFrame:
    """NET, node, k, m, own, to, gain of each node (NET, node, k, m, own) that would gain by a move; of those in ``active``, if given."""
    mine, around = nodes, edges
    if active is not None:
        mine = nodes.join(active, [*NET, "node"], "left_semi")
        around = edges.join(active.withColumnRenamed("node", "src"), [*NET, "src"], "left_semi")
    near = around.join(nodes.select(*NET, F.col("node").alias("dst"), F.col("own").alias("to")), [*NET, "dst"]).groupBy(*NET, F.col("src").alias("node"), "to").agg(F.sum("w").alias("w"))
    held = nodes
    if active is not None:  # only the communities that these see
        near = stored(near)
        asked = stored(near.select(*NET, F.col("to").alias("own")).unionByName(mine.select(*NET, "own")).distinct())
        held = nodes.join(asked, [*NET, "own"], "left_semi")
    sums = held.groupBy(*NET, "own").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size"))
    mine = mine.join(sums, [*NET, "own"])
    if only_single:
        mine = mine.where("size = 1")
    rows = near.join(mine, [*NET, "node"])
    held = F.col("to") == F.col("own")
    ties = F.max(F.when(held, F.col("w"))).over(Window.partitionBy(*NET, "node"))  # a node's rows: one a neighbouring community
    rows = rows.withColumn("tie", F.coalesce(ties, F.lit(0.0))).where(~held)
    rows = rows.join(sums.select(*NET, F.col("own").alias("to"), F.col("total").alias("there")), [*NET, "to"])
    gain = F.col("w") - F.col("tie") - resolution * F.col("k") * (F.col("there") - F.col("total") + F.col("k")) / F.col("m")
    rows = rows.withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN)
    best = rows.groupBy(*NET, "node").agg(F.max_by(F.struct("k", "m", "own", "to", "gain"), F.struct("gain", "to")).alias("b"))
    return best.select(*NET, "node", "b.*")


def accepted(edges: DataFrame, wishes: DataFrame, resolution: float, turn: int) -> DataFrame:
    """NET, node, to: wishes that together gain at least what each pays for the others."""
    h = F.xxhash64("node", F.lit(turn))
    wishes = wishes.withColumn("h", h)
    side = lambda end, name: wishes.select(*NET, F.col("node").alias(end), F.struct("h", "node").alias(name), F.struct("own", "to").alias(f"{name}_way"))
    pairs = edges.join(side("src", "a"), [*NET, "src"]).join(side("dst", "b"), [*NET, "dst"]).where("b > a")
    # what both moves gain more than each by itself, in shares of the edge's weight
    same = lambda x, y: (F.col(f"a_way.{x}") == F.col(f"b_way.{y}")).cast("int")
    beaten = pairs.where(F.col("w") * (same("to", "to") + same("own", "own") - same("to", "own") - same("own", "to")) < 0).select(*NET, F.col("src").alias("node"))
    free = wishes.join(beaten, [*NET, "node"], "left_anti").withColumn("level", F.expr("bit_count((h & -h) - 1)"))
    # what enters or leaves a community, at a level and above: at most 65 rows a community
    flows = free.select(*NET, "level", "k", F.explode(F.array(F.struct(F.lit("in").alias("way"), F.col("to").alias("c")), F.struct(F.lit("out").alias("way"), F.col("own").alias("c")))).alias("f"))
    flows = flows.groupBy(*NET, "f.way", "f.c", "level").agg(F.sum("k").alias("k"))
    flows = flows.withColumn("above", F.sum("k").over(Window.partitionBy(*NET, "way", "c").orderBy(F.desc("level"))))
    way = lambda name, c: flows.where(F.col("way") == name).select(*NET, F.col("c").alias(c), "level", F.col("above").alias(name))
    priced = free.join(way("in", "to"), [*NET, "to", "level"]).join(way("out", "own"), [*NET, "own", "level"])
    price = resolution * F.col("k") * (F.col("in") + F.col("out") - 2 * F.col("k")) / F.col("m")
    return priced.where(F.col("gain") - price > LEAST_GAIN / 2).select(*NET, "node", "to")


def kept(rows: DataFrame, key: str, many: bool) -> DataFrame:
    """Stored, in buckets by ``key`` where there are many."""
    if not many:
        return stored(rows)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return laid(rows.repartition(n, *NET, key), *NET, key)


def local_moves(edges: DataFrame, nodes: DataFrame, resolution: float, seed: int, only_single: bool = False) -> tuple[DataFrame, bool]:
    """``nodes`` with their communities after rounds of moves, until no node gains; whether any moved."""
    turn, moved, active, many = seed, False, None, nodes.count() > MANY
    while True:
        wishes = stored(candidates(edges, nodes, resolution, only_single, active))
        if wishes.isEmpty():
            if active is None:
                return nodes, moved
            active = None  # the sums that others see have changed too
            continue
        moves = accepted(edges, wishes, resolution, turn)
        moves = stored(moves) if many else moves
        after = nodes.join(moves, [*NET, "node"], "left").select(*NET, "node", "k", "m", F.coalesce("to", "own").alias("own"))
        nodes = laid(after, *NET, "node") if many else stored(after)
        if many:
            beside = edges.join(moves.select(*NET, F.col("node").alias("src")), [*NET, "src"]).select(*NET, F.col("dst").alias("node"))
            active = stored(wishes.select(*NET, "node").unionByName(beside).distinct())
        turn, moved = turn + 1, True


def leiden(net: DataFrame, resolution: float = 1.0, quality: str = "modularity", start: DataFrame | None = None, seed: int = 0, weight: str = "lls") -> DataFrame:
    """NET, gene, community (its smallest gene).

    ``quality`` "modularity" takes positive weights, "cpm" any.  ``start`` (NET, gene, community) is a
    first partition, else each gene begins alone; genes that it lacks begin alone.  Each level moves
    nodes, splits every community into parts by moving single nodes within it (so that parts hang
    together), and contracts the parts; the contracted nodes begin in the community of their parts, and a
    level that moves nothing ends the pass.  Passes begin again with the genes in the communities found,
    until one moves no gene.  Edges given twice add up, loops are left out.
    """
    edges = both_ways(net.where("gene1 <> gene2"), weight).groupBy(*NET, "src", "dst").agg(F.sum(weight).cast("double").alias("w"))
    edges = stored(edges)
    many = edges.select(*NET, "src").distinct().count() > MANY
    genes = edges.groupBy(*NET, F.col("src").alias("node")).agg(F.sum("w").alias("k") if quality == "modularity" else F.lit(1.0).alias("k"))
    scale = genes.groupBy(*NET).agg(F.sum("k").alias("m") if quality == "modularity" else F.lit(1.0).alias("m"))
    nodes = genes.join(scale, NET).withColumn("own", F.col("node"))
    if start is not None:
        first = start.groupBy(*NET, "community").agg(F.min("gene").alias("own")).join(start, [*NET, "community"]).select(*NET, F.col("gene").alias("node"), F.col("own").alias("given"))
    else:
        first, large = solved(edges, scale, resolution, quality, seed)
        many = many and large
    nodes = nodes.join(first, [*NET, "node"], "left").select(*NET, "node", "k", "m", F.coalesce("given", "own").alias("own"))
    edges, nodes = kept(edges, "src", True) if many else edges, kept(nodes, "node", many)
    while True:
        members, moved = one_pass(edges, nodes, resolution, seed)
        if not moved:
            return smallest(members)
        nodes = kept(nodes.drop("own").join(members.select(*NET, F.col("gene").alias("node"), "own"), [*NET, "node"]).select(*NET, "node", "k", "m", "own"), "node", many)
        seed += 1000


def one_pass(edges: DataFrame, nodes: DataFrame, resolution: float, seed: int) -> tuple[DataFrame, bool]:
    """NET, gene, own after levels of moves and contractions; whether a gene moved by itself."""
    members, level = nodes.select(*NET, F.col("node").alias("gene"), "node"), 0
    while True:
        nodes, moved = local_moves(edges, nodes, resolution, seed)
        label = lambda end, name: nodes.select(*NET, F.col("node").alias(end), F.col("own").alias(name))
        if not moved:
            return members.join(label("node", "own"), [*NET, "node"]).select(*NET, "gene", "own"), level > 0
        level, many = level + 1, nodes.count() > MANY
        inside = kept(edges.join(label("src", "a"), [*NET, "src"]).join(label("dst", "b"), [*NET, "dst"]).where("a = b").select(*NET, "src", "dst", "w"), "src", many)
        parts, split = local_moves(inside, nodes.withColumn("own", F.col("node")), resolution, seed, only_single=True)
        if not split:  # nothing hangs together by itself: the communities are the parts
            parts = nodes
        part = lambda end, name: parts.select(*NET, F.col("node").alias(end), F.col("own").alias(name))
        members = stored(members.join(part("node", "part"), [*NET, "node"]).select(*NET, "gene", F.col("part").alias("node")))
        edges = kept(edges.join(part("src", "a"), [*NET, "src"]).join(part("dst", "b"), [*NET, "dst"]).where("a <> b").groupBy(*NET, F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "src", many)
        nodes = kept(nodes.join(part("node", "part"), [*NET, "node"]).groupBy(*NET, F.col("part").alias("node"), "own").agg(F.sum("k").alias("k"), F.first("m").alias("m")).select(*NET, "node", "k", "m", "own"), "node", many)


def solved(edges: DataFrame, scale: DataFrame, resolution: float, quality: str, seed: int) -> tuple[DataFrame, bool]:
    """NET, node, given (its community) of the parts of up to ``MANY`` nodes, whole parts in a task; whether there are larger ones."""
    parts = hanging(edges.where("src < dst").select(*NET, F.col("src").alias("gene1"), F.col("dst").alias("gene2")))
    sizes = parts.groupBy(*NET, "component").agg(F.count(F.lit(1)).alias("n"))
    large = not sizes.where(F.col("n") > MANY).isEmpty()
    if large:
        parts = parts.join(sizes.where(F.col("n") <= MANY).drop("n"), [*NET, "component"])
    small = parts.select(*NET, F.col("gene").alias("src"), "component")
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // PART))
    rows = edges.join(small, [*NET, "src"]).join(scale, NET).repartition(tasks, *NET, "component")
    rows = rows.select(*NET, "src", "dst", "component", F.col("w").cast("double").alias("w"), F.col("m").cast("double").alias("m"), F.xxhash64("src").alias("h"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        del rows
        src, dst, part = node_numbers(table, "src", "dst", "component")
        order = np.lexsort((dst, src))
        at = order[np.searchsorted(src[order], np.arange(src.max() + 1))]  # a row that a node begins
        w, m, h = (table.column(c).to_numpy() for c in ("w", "m", "h"))
        k = np.bincount(src[order], w[order]) if quality == "modularity" else np.ones(len(at))
        own = communities_of(src[order], dst[order], w[order], k, m[at], h[at].astype(np.uint64), part[at], resolution, seed)
        here = table.select([*NET, "src"]).take(pa.array(at))
        yield from here.rename_columns([*NET, "node"]).append_column("given", here.column("src").take(pa.array(own))).to_batches(max_chunksize=2**16)

    kinds = dict(edges.dtypes)
    return rows.mapInArrow(found, ", ".join([*[f"{c} {kinds[c]}" for c in NET], f"node {kinds['src']}", f"given {kinds['src']}"])), large


def hanging(net: DataFrame) -> DataFrame:
    """``components``; by network in a task, which holds two numbers an edge, while none has more than ``WHOLE`` edges."""
    net = stored(net)
    if not net.groupBy(*NET).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE).isEmpty():
        return components(net)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        del rows
        a, b = node_numbers(table, "gene1", "gene2")
        least = least_of(a, b)
        ends = pa.concat_tables([table.select([*NET, c]).rename_columns([*NET, "gene"]) for c in ("gene1", "gene2")])
        number, at = np.unique(np.concatenate([a, b]), return_index=True)
        here = ends.take(pa.array(at))
        yield from here.append_column("component", here.column("gene").take(pa.array(least[number]))).to_batches(max_chunksize=2**16)

    kinds, tasks = dict(net.dtypes), int(net.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in NET], f"gene {kinds['gene1']}", f"component {kinds['gene1']}"])
    return stored(net.where("celltype IS NOT NULL AND condition IS NOT NULL").repartition(tasks, *NET).mapInArrow(found, schema))


def least_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component; edges go from a to b and every node has one."""
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    first, least = np.nonzero(np.diff(src, prepend=-1))[0], np.arange(src[-1] + 1)
    while True:
        beyond = least[least]
        near = np.minimum(np.minimum.reduceat(beyond[dst], first), beyond)
        new = near.copy()
        np.minimum.at(new, least, near)
        if (new == least).all():
            return least
        least = new


def node_numbers(table: pa.Table, *ends: str) -> np.ndarray:
    """A row for each of ``ends`` with the numbers of its nodes, which are 0, 1, ... by network and name."""
    column = lambda c: table.column(c).combine_chunks()
    net = ordered(column("celltype")) * (len(table) + 1) + ordered(column("condition"))
    gene = ordered(pa.concat_arrays([column(c) for c in ends])).reshape(len(ends), -1)
    number = np.unique(np.unique(net, return_inverse=True)[1] * (gene.max() + 1) + gene, return_inverse=True)[1]
    return number.reshape(len(ends), -1)


def ordered(values: pa.Array) -> np.ndarray:
    """The number of each value among the distinct ones in order."""
    coded = values.dictionary_encode()
    number = np.empty(len(coded.dictionary), np.int64)
    number[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(number))
    return number[coded.indices.to_numpy()]


def communities_of(src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: np.ndarray, m: np.ndarray, h: np.ndarray, part: np.ndarray, resolution: float, seed: int) -> np.ndarray:
    """The smallest node of each node's community, by the passes of ``leiden`` in arrays; ``part`` names what hangs together.

    Nodes are 0, 1, ... and edges come both ways, in order.  Parts that no longer move wait, so that each sees the rounds that it would see alone.
    """
    own = np.arange(len(k))
    while True:
        label, moved = array_pass(src, dst, w, k, m, own, h, part, resolution, seed)
        least = np.full(len(k), len(k))
        np.minimum.at(least, label, np.arange(len(k)))
        own, seed, keep = least[label], seed + 1000, moved[part[src]]
        if not keep.any():
            return own
        src, dst, w = src[keep], dst[keep], w[keep]


def array_pass(src, dst, w, k, m, own, h, part, resolution: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``one_pass`` in arrays: a label by node, and by part whether it moved."""
    member, any_moved = np.arange(len(k)), None
    while True:
        own, moved = array_moves(src, dst, w, k, m, own, h, part, resolution, seed)
        any_moved = moved if any_moved is None else any_moved
        if not moved.any():
            return own[member], any_moved
        keep = moved[part[src]]
        src, dst, w = src[keep], dst[keep], w[keep]
        inside = own[src] == own[dst]
        split, apart = array_moves(src[inside], dst[inside], w[inside], k, m, np.arange(len(k)), h, part, resolution, seed, True)
        # where nothing hangs together by itself the communities are the parts
        _, at, new = np.unique(np.where(apart[part], split, own), return_index=True, return_inverse=True)
        _, first, of = np.unique(own[at], return_index=True, return_inverse=True)
        member, own, k, m, part, h = new[member], first[of], np.bincount(new, k), m[at], part[at], h[at]
        a, b = new[src], new[dst]
        key, w = summed((a * len(k) + b)[a != b], w[a != b])
        src, dst = np.divmod(key, len(k))


def summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and their sums."""
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    return key, np.add.reduceat(w[order], first) if len(key) else w


def array_moves(src, dst, w, k, m, own, h, part, resolution: float, seed: int, only_single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``local_moves`` in arrays: communities by node, and by part whether it moved.  A part whose nodes gain nothing is done."""
    n, own, moved, turn = len(k), own.copy(), np.zeros(part.max() + 1, bool), seed
    while len(src):
        # candidates
        key, s = summed(src * n + own[dst], w)
        i, c = np.divmod(key, n)
        mine = own[i]
        held, tie = c == mine, np.zeros(n)
        tie[i[held]] = s[held]
        total = np.bincount(own, k, n)
        gain = s - tie[i] - resolution * k[i] * (total[c] - total[mine] + k[i]) / m[i]
        good = ~held & (gain > LEAST_GAIN)
        if only_single:
            good &= np.bincount(own, minlength=n)[mine] == 1
        i, c, gain = i[good], c[good], gain[good]
        if not len(i):
            break
        order = np.lexsort((c, gain, i))
        best = order[np.append(np.diff(i[order]) > 0, True)]
        node, to, gain = i[best], c[best], gain[best]
        live = np.zeros(len(moved), bool)
        live[part[node]] = True
        moved |= live
        keep = live[part[src]]
        src, dst, w = src[keep], dst[keep], w[keep]
        # of two moves that would lose an edge's weight together the one with the higher hash
        draw = mixed(h, turn)
        goal = np.full(n, -1)
        goal[node] = to
        both = (goal[src] >= 0) & (goal[dst] >= 0)
        a, b = src[both], dst[both]
        shares = (goal[a] == goal[b]).astype(int) + (own[a] == own[b]) - (goal[a] == own[b]) - (own[a] == goal[b])
        beaten = np.zeros(n, bool)
        beaten[a[((draw[b] > draw[a]) | ((draw[b] == draw[a]) & (b > a))) & (w[both] * shares < 0)]] = True
        free = ~beaten[node]
        node, to, gain = node[free], to[free], gain[free]
        level = np.bitwise_count((draw[node] & (~draw[node] + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        others = above(to, level, k[node]) + above(own[node], level, k[node]) - 2 * k[node]
        pays = gain - resolution * k[node] * others / m[node] > LEAST_GAIN / 2
        own[node[pays]] = to[pays]
        turn += 1
    return own, moved


def above(c: np.ndarray, level: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each row the sum of k over the rows of its community c at its level and higher."""
    key, at = np.unique(c * 65 + (64 - level), return_inverse=True)
    sums, of = np.bincount(at, k, len(key)), key // 65
    place = np.arange(len(key)) - np.searchsorted(of, of)
    for j in range(1, place.max(initial=0) + 1):  # at most 65 levels
        here = np.nonzero(place == j)[0]
        sums[here] += sums[here - 1]
    return sums[at]


def mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Hashes of a turn (the finishing steps of splitmix64)."""
    x = h + np.uint64((turn * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def smallest(members: DataFrame) -> DataFrame:
    """NET, gene, community from NET, gene, own."""
    name = members.groupBy(*NET, "own").agg(F.min("gene").alias("community"))
    return members.join(name, [*NET, "own"]).select(*NET, "gene", "community")


def modularity(net: DataFrame, labels: DataFrame, resolution: float = 1.0, weight: str = "lls") -> DataFrame:
    """NET, communities, modularity of a partition (NET, gene, community); genes without a label are alone."""
    edges = both_ways(net.where("gene1 <> gene2"), weight)
    end = lambda name, c: labels.select(*NET, F.col("gene").alias(name), F.col("community").alias(c))
    rows = edges.join(end("src", "a"), [*NET, "src"], "left").join(end("dst", "b"), [*NET, "dst"], "left")
    sums = rows.groupBy(*NET, "a", F.when(F.col("a").isNull(), F.col("src")).alias("alone")).agg(F.sum(weight).alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col(weight)).otherwise(0.0)).alias("inner"))
    m = F.sum("k")
    return sums.groupBy(*NET).agg(F.count(F.lit(1)).alias("communities"), (F.sum("inner") / m - resolution * F.sum(F.col("k") * F.col("k")) / (m * m)).alias("modularity"))
