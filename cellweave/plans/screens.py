"""Queries of screening, null tests and annotation, and SQL for those whose draws are hashed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expression, graph, nulls, screening, statistics
from ..operators import network as N
from .catalog import DIFF, ORACLE_SQL, SPEC, query, ranked
from .fixtures import SQL


def uniform(*keys: str) -> str:
    return f"{hashed(*keys)} / CAST(4294967296.0 AS DOUBLE)"


def hashed(*keys: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8) AS BIGINT)"


# --- core numbers

def core_sql(ends: str, rounds: int) -> str:
    """c0, c1, ... by h-indices of the neighbours' values."""
    steps = [f"c0 AS MATERIALIZED (SELECT celltype, condition, gene, count(*) AS core FROM {ends} GROUP BY ALL)"]
    for i in range(rounds):
        steps.append(f"""r{i} AS (SELECT e.celltype, e.condition, e.gene, c.core, row_number() OVER (PARTITION BY e.celltype, e.condition, e.gene ORDER BY c.core DESC) AS r
          FROM {ends} e JOIN c{i} c ON c.celltype = e.celltype AND c.condition = e.condition AND c.gene = e.other),
        c{i + 1} AS MATERIALIZED (SELECT celltype, condition, gene, count(*) FILTER (core >= r) AS core FROM r{i} GROUP BY ALL)""")
    return ", ".join(steps)


ROUNDS = 16
ORACLE_SQL["core_numbers"] = f"{SQL}, {core_sql('ends', ROUNDS)} SELECT * FROM c{ROUNDS}"


@query("core_centrality", f"""CTE lb AS (SELECT st.*, p_size % 3 AS label FROM st JOIN part ON gene = p_partkey),
    ie AS MATERIALIZED (SELECT e.celltype, e.condition, e.gene, e.other FROM ends e JOIN lb a ON a.celltype = e.celltype AND a.condition = e.condition AND a.gene = e.gene
      JOIN lb b ON b.celltype = e.celltype AND b.condition = e.condition AND b.gene = e.other AND a.label = b.label), {core_sql('ie', ROUNDS)},
    al AS (SELECT lb.celltype, lb.condition, lb.gene, label, coalesce(core, 0) AS core FROM lb LEFT JOIN c{ROUNDS} c ON c.celltype = lb.celltype AND c.condition = lb.condition AND c.gene = lb.gene),
    sd AS (SELECT *, stddev_samp(core) OVER (PARTITION BY celltype, condition, label) AS sd FROM al)
    SELECT celltype, condition, gene, label, core, round(core / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z FROM sd""")
def core_centrality(t):
    net = t.aligned()
    sizes = t.read("part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") % 3).alias("label"))
    return graph.core_centrality(net, N.endpoints(net).distinct().join(sizes, "gene")).withColumn("z", F.round("z", 6))


# --- hub tests

def rewired_sql(name: str, where: str, reps: str, p: float, seed: int, each: bool = True) -> str:
    """Null strengths of rewired networks as ``name``."""
    key = [str(seed), "celltype", "condition", "rep", "edge"]
    end = lambda c: f"CASE WHEN {uniform(*key, f"'move{c}'")} < {p} THEN CAST(floor({uniform(*key, f"'to{c}'")} * n) AS BIGINT) ELSE i{c} END"
    order = hashed(*(key if each else [k for k in key if k != "rep"]), "'weight'")
    return f"""{name}_nodes AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY celltype, condition ORDER BY gene) - 1 AS i, count(*) OVER (PARTITION BY celltype, condition) AS n
      FROM (SELECT DISTINCT celltype, condition, gene FROM ends WHERE {where})),
    {name}_edges AS (SELECT e.celltype, e.condition, e.lls, row_number() OVER (PARTITION BY e.celltype, e.condition ORDER BY gene1, gene2) AS edge, a.i AS i1, b.i AS i2, a.n
      FROM fx_net e JOIN {name}_nodes a ON a.celltype = e.celltype AND a.condition = e.condition AND a.gene = gene1 JOIN {name}_nodes b ON b.celltype = e.celltype AND b.condition = e.condition AND b.gene = gene2),
    {name}_reps AS MATERIALIZED (SELECT *, unnest(range(1, CAST({reps} AS BIGINT) + 1)) AS rep FROM {name}_edges),
    {name}_moved AS (SELECT *, {end(1)} AS a, {end(2)} AS b, row_number() OVER (PARTITION BY celltype, condition, rep ORDER BY {order}, edge) AS slot FROM {name}_reps),
    {name}_drawn AS (SELECT m.celltype, m.condition, m.rep, a, CASE WHEN a = b THEN (b + 1) % m.n ELSE b END AS b, w.lls FROM {name}_moved m
      JOIN {name}_reps w ON w.celltype = m.celltype AND w.condition = m.condition AND w.rep = m.rep AND w.edge = m.slot),
    {name} AS MATERIALIZED (SELECT celltype, condition, rep, i, sum(lls) AS value FROM (SELECT celltype, condition, rep, a AS i, lls FROM {name}_drawn UNION ALL SELECT celltype, condition, rep, b, lls FROM {name}_drawn) GROUP BY ALL)"""


def tested_sql(by: str, value: str, observed: str, null: str) -> str:
    """te: the rows of ``observed`` with p, then bq with q."""
    on = " AND ".join(f"o.{c} = a.{c}" for c in [*by.split(", "), value])
    return f"""ag AS (SELECT {by}, {value}, coalesce(sum(sum(k)) OVER (PARTITION BY {by} ORDER BY {value} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(sum(k)) OVER (PARTITION BY {by}) AS every
      FROM (SELECT {by}, {value}, 0 AS k FROM {observed} UNION ALL SELECT {by}, {value}, 1 FROM {null}) GROUP BY {by}, {value}),
    te AS (SELECT o.*, CAST(1 + above AS DOUBLE) / (every + 1) AS p FROM {observed} o JOIN ag a ON {on}),
    rk AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS n_, row_number() OVER (PARTITION BY {by} ORDER BY p, gene) AS r_ FROM te),
    bq AS (SELECT * EXCLUDE (n_, r_), least(1, min(p * n_ / r_) OVER (PARTITION BY {by} ORDER BY r_ DESC)) AS q FROM rk)"""


ORACLE_SQL["find_all_hub"] = f"""{SQL}, {rewired_sql('nl', 'true', 'ceil(10000 / n)', 0.5, 1)},
    nz AS (SELECT v.celltype, v.condition, coalesce(value, 0) AS value FROM (SELECT celltype, condition, i, unnest(range(1, CAST(ceil(10000 / n) AS BIGINT) + 1)) AS rep FROM nl_nodes) v LEFT JOIN nl ON nl.celltype = v.celltype AND nl.condition = v.condition AND nl.rep = v.rep AND nl.i = v.i),
    {tested_sql('celltype, condition', 'value', 'pr', 'nz')} SELECT * FROM bq"""

RANKED_NULL = """s{0} AS MATERIALIZED (SELECT celltype, rep, i, percent_rank() OVER (PARTITION BY celltype, rep ORDER BY value) AS pr{0} FROM nl{0} JOIN kept USING (celltype, i))"""
ORACLE_SQL["find_diff_hub"] = f"""{SQL}, able AS (SELECT celltype FROM (SELECT celltype, condition, count(*) AS n FROM fx_cells WHERE condition IN ('F', 'O') GROUP BY ALL) GROUP BY celltype HAVING count(*) = 2 AND min(n) >= 500),
    {rewired_sql('nl0', "condition = 'F' AND celltype IN (SELECT celltype FROM able)", 'ceil(1000000 / n)', 0.9, 1, False)},
    {rewired_sql('nl1', "condition = 'F' AND celltype IN (SELECT celltype FROM able)", 'ceil(1000000 / n)', 0.9, 2, False)},
    kept AS (SELECT celltype, i FROM nl0_nodes SEMI JOIN pr USING (celltype, condition, gene)), {RANKED_NULL.format(0)}, {RANKED_NULL.format(1)},
    nd AS (SELECT celltype, coalesce(pr0, 0) AS a, coalesce(pr1, 0) AS b FROM s0 FULL JOIN s1 USING (celltype, rep, i)), ns AS (SELECT celltype, abs(b - a) AS size FROM nd),
    ob AS (SELECT *, abs(diff) AS size FROM (SELECT *, row_number() OVER (PARTITION BY celltype ORDER BY abs(diff) DESC, gene) AS rank FROM d) WHERE celltype IN (SELECT celltype FROM able)),
    {tested_sql('celltype', 'size', 'ob', 'ns')} SELECT * FROM bq""".replace(", able AS", ", " + DIFF.strip().removeprefix("CTE").strip() + ", able AS", 1)


@query("weight_hubs", f"CTE {rewired_sql('nl', 'true', '100', 0.0, 1)}, {tested_sql('celltype, condition', 'value', 'st', 'nl')} SELECT * FROM bq")
def weight_hubs(t):
    return nulls.weight_hubs(t.aligned(), reps=100)


# --- connectivity of a gene set

POOLS = """nd AS MATERIALIZED (SELECT celltype, condition, gene, count(*) AS degree, row_number() OVER (PARTITION BY celltype, condition ORDER BY count(*), gene) - 1 AS pos FROM ends GROUP BY celltype, condition, gene),
    pl AS MATERIALIZED (SELECT a.celltype, a.condition, a.gene, a.degree, a.pos, min(b.pos) AS low, count(*) AS pool FROM nd a JOIN nd b ON a.celltype = b.celltype AND a.condition = b.condition
      AND b.degree BETWEEN floor(a.degree * CAST(0.8 AS DOUBLE)) AND ceil(a.degree * CAST(1.2 AS DOUBLE)) GROUP BY ALL)"""


@query("degree_pools", f"CTE {POOLS} SELECT * FROM pl")
def degree_pools(t):
    return nulls.degree_pools(t.aligned())


@query("connectivity_test", f"""CTE {POOLS},
    gs AS (SELECT p_partkey AS gene FROM part WHERE p_brand = 'Brand#11'),
    sl AS MATERIALIZED (SELECT celltype, condition, low, pool, row_number() OVER (PARTITION BY celltype, condition ORDER BY gene) AS slot FROM pl WHERE gene IN (SELECT gene FROM gs)),
    dr AS (SELECT celltype, condition, sim, CAST([] AS BIGINT[]) AS taken, CAST(0 AS BIGINT) AS done FROM (SELECT DISTINCT celltype, condition FROM sl), range(1, 10001) x(sim)
      UNION ALL SELECT celltype, condition, sim, list_append(taken, list_reduce(list_sort(ins), lambda p, x: CASE WHEN x <= p THEN p + 1 ELSE p END, low + CAST(floor({uniform('1', 'celltype', 'condition', 'sim', 'slot')} * free) AS BIGINT))), slot
      FROM (SELECT *, pool - len(ins) AS free FROM (SELECT dr.*, low, pool, slot, list_filter(taken, lambda x: x >= low AND x < low + pool) AS ins FROM dr JOIN sl ON sl.celltype = dr.celltype AND sl.condition = dr.condition AND sl.slot = done + 1)) WHERE free > 0),
    pk AS MATERIALIZED (SELECT celltype, condition, sim, unnest(taken) AS pos FROM (SELECT celltype, condition, sim, arg_max(taken, done) AS taken FROM dr GROUP BY ALL)),
    ed AS (SELECT e.celltype, e.condition, a.pos AS p1, b.pos AS p2 FROM fx_net e JOIN nd a ON a.celltype = e.celltype AND a.condition = e.condition AND a.gene = gene1 JOIN nd b ON b.celltype = e.celltype AND b.condition = e.condition AND b.gene = gene2),
    nu AS (SELECT x.celltype, x.condition, x.sim, count(*) AS k FROM ed JOIN pk x ON x.celltype = ed.celltype AND x.condition = ed.condition AND x.pos = p1 JOIN pk y ON y.celltype = ed.celltype AND y.condition = ed.condition AND y.sim = x.sim AND y.pos = p2 GROUP BY ALL),
    ow AS (SELECT celltype, condition, count(*) AS connectivity FROM fx_net WHERE gene1 IN (SELECT gene FROM gs) AND gene2 IN (SELECT gene FROM gs) GROUP BY ALL),
    de AS (SELECT celltype, condition, detected, coalesce(connectivity, 0) AS connectivity FROM (SELECT celltype, condition, count(*) AS detected FROM sl GROUP BY ALL) LEFT JOIN ow USING (celltype, condition))
    SELECT celltype, condition, detected, connectivity, (1 + count(*) FILTER (k > connectivity)) / 10000 AS p FROM de LEFT JOIN nu USING (celltype, condition) GROUP BY ALL""")
def connectivity_test(t):
    genes = t.read("part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("gene"))
    return nulls.connectivity_test(t.aligned(), genes, sims=10_000)


@query("autocorrelation_z", f"""CTE sl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY celltype, condition ORDER BY gene) AS slot FROM st),
    dn AS (SELECT celltype, condition, gene, rep, row_number() OVER (PARTITION BY celltype, condition, rep ORDER BY {hashed('1', 'celltype', 'condition', 'rep', 'gene')}, gene) AS slot FROM st, range(1, 101) x(rep)),
    sd AS MATERIALIZED (SELECT d.celltype, d.condition, d.rep, d.gene, s.value AS x FROM dn d JOIN sl s ON s.celltype = d.celltype AND s.condition = d.condition AND s.slot = d.slot UNION ALL SELECT celltype, condition, 0, gene, value FROM st),
    ds AS (SELECT e.celltype, e.condition, a.rep, sum(2 * lls) AS w, sum(lls * (a.x - b.x) * (a.x - b.x)) AS d FROM fx_net e JOIN sd a ON a.celltype = e.celltype AND a.condition = e.condition AND a.gene = gene1
      JOIN sd b ON b.celltype = e.celltype AND b.condition = e.condition AND b.gene = gene2 AND b.rep = a.rep GROUP BY ALL),
    m AS (SELECT celltype, condition, count(*) AS n, var_pop(value) * count(*) AS ss FROM st GROUP BY ALL),
    c AS (SELECT celltype, condition, rep, 1 - (n - 1) * d / (2 * w * ss) / 2 AS c FROM ds JOIN m USING (celltype, condition) WHERE ss > 0)
    SELECT celltype, condition, round(max(c) FILTER (rep = 0), 6) AS autocorrelation, round((max(c) FILTER (rep = 0) - avg(c) FILTER (rep > 0)) / nullif(stddev_samp(c) FILTER (rep > 0), 0), 6) AS z FROM c GROUP BY ALL""")
def autocorrelation_z(t):
    net = t.aligned()
    z = nulls.autocorrelation_z(net, N.strength(net).withColumnRenamed("value", "x"))
    return z.withColumns({"autocorrelation": F.round("autocorrelation", 6), "z": F.round("z", 6)})


# --- cells and features

def qc_by_group_sql(rounds: int) -> str:
    steps = ["c0 AS MATERIALIZED (SELECT c.*, celltype FROM fx_counts c JOIN fx_cust USING (cell_id))"]
    for i in range(rounds):
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT * FROM c{i} WHERE cell_id IN (SELECT cell_id FROM c{i} GROUP BY cell_id HAVING count(*) FILTER (value > 0) >= 12 AND sum(value) >= 200)
          AND (celltype, feature) IN (SELECT (celltype, feature) FROM c{i} GROUP BY celltype, feature HAVING count(*) FILTER (value > 0) >= 20))""")
    return ", ".join(steps) + f""" SELECT cell_id, feature, value FROM c0 WHERE cell_id IN (SELECT cell_id FROM c{rounds})
      AND feature IN (SELECT feature FROM c{rounds} GROUP BY feature HAVING count(DISTINCT celltype) = (SELECT count(DISTINCT celltype) FROM fx_cust))"""


@query("qc_by_group", "CTE " + qc_by_group_sql(8))
def qc_by_group(t):
    return screening.qc_by_group(t.counts(), t.customers().select("cell_id", "celltype"), "celltype", min_cells=20, min_features=12, min_umis=200)


@query("subset_network", "SELECT * FROM fx_net WHERE gene1 IN (SELECT p_partkey FROM part WHERE p_size > 25) AND gene2 IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def subset_network(t):
    return screening.subset(t.aligned(), t.read("part").where("p_size > 25").select("p_partkey"), "gene1", "gene2").select(*N.NET, "gene1", "gene2", "lls", "scinet_weight")


@query("cells_of_groups", "SELECT * FROM fx_cells WHERE celltype IN ('BUILDING', 'MACHINERY')")
def cells_of_groups(t):
    return screening.groups(t.cells(), "celltype", ["BUILDING", "MACHINERY"])


@query("top_features", """CTE x AS (SELECT celltype, condition, gene AS feature, pr FROM pr WHERE condition = 'O'),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY celltype ORDER BY pr DESC, feature) AS INTEGER) AS rank FROM x WHERE feature % 37 <> 0 AND feature % 11 <> 0) SELECT * FROM r WHERE rank <= 10""")
def top_features(t):
    name = F.concat(F.when(F.col("feature") % 11 == 0, "MT-").when(F.col("feature") % 37 == 0, "RPS").otherwise("G"), F.col("feature").cast("string"))
    return screening.top_features(ranked(t).where("condition = 'O'").select(*N.NET, F.col("gene").alias("feature"), "pr"), "celltype", "pr", 10, name)


@query("top_union", "SELECT DISTINCT gene FROM (SELECT gene, row_number() OVER (PARTITION BY celltype, condition ORDER BY pr DESC, gene) AS r FROM pr) WHERE r <= 15")
def top_union(t):
    return screening.top_union(ranked(t), 15)


@query("by_magnitude", "SELECT celltype, condition, gene, value, round(value - avg(value) OVER (PARTITION BY celltype, condition), 6) AS score FROM st ORDER BY abs(score) DESC, celltype, condition, gene")
def by_magnitude(t):
    s = N.strength(t.aligned())
    mean = s.groupBy(*N.NET).agg(F.avg("value").alias("mean"))
    return screening.by_magnitude(s.join(mean, N.NET).select(*N.NET, "gene", "value", F.round(F.col("value") - F.col("mean"), 6).alias("score")), "score", *N.NET, "gene")


@query("translate", """CTE nm AS (SELECT p_partkey AS id, p_type AS name, 2 AS position FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, p_brand, 1 FROM part WHERE p_size > 40)
    SELECT celltype, condition, coalesce(name, '') AS gene, value FROM st LEFT JOIN (SELECT id, arg_min(name, position) AS name FROM nm WHERE name IS NOT NULL GROUP BY id) ON id = gene""")
def translate(t):
    names = lambda c, least, at: t.read("part").where(F.col("p_size") > least).select(F.col("p_partkey").alias("id"), F.col(c).alias("name"), F.lit(at).alias("position"))
    return screening.translate(N.strength(t.aligned()), "gene", names("p_type", 10, 2).union(names("p_brand", 40, 1))).select(*N.NET, "gene", "value")


@query("categorise", "SELECT cell_id, CAST(dense_rank() OVER (ORDER BY celltype) AS INTEGER) AS celltype, CAST(dense_rank() OVER (ORDER BY batch) AS INTEGER) AS batch FROM fx_cust")
def categorise(t):
    return screening.categorise(t.customers())[0]


@query("drop_constant", "SELECT cell_id, celltype, batch FROM fx_cust")
def drop_constant(t):
    return screening.drop_constant(t.customers().withColumns({"species": F.lit("human"), "lost": F.lit(None).cast("string")}))


@query("shared_features", "SELECT DISTINCT feature FROM fx_counts WHERE feature IN (SELECT p_brand FROM part WHERE p_size < 20)")
def shared_features(t):
    return screening.shared_features(t.counts(), t.read("part").where("p_size < 20").select(F.col("p_brand").alias("feature")))


@query("matched_features", "SELECT 'counts' AS side, cell_id AS id, feature FROM fx_counts WHERE feature IN (SELECT p_brand FROM part WHERE p_size = 7) UNION ALL SELECT 'parts', p_partkey, p_brand FROM part WHERE p_size = 7 AND p_brand IN (SELECT feature FROM fx_counts)")
def matched_features(t):
    a, b = screening.matched(t.counts(), t.read("part").where("p_size = 7").select(F.col("p_brand").alias("feature"), F.col("p_partkey").alias("id")))
    side = lambda rows, name, c: rows.select(F.lit(name).alias("side"), F.col(c).cast("long").alias("id"), "feature")
    return side(a, "counts", "cell_id").unionByName(side(b, "parts", "id"))


@query("join_ranks", "SELECT a.celltype, a.gene, a.pr, coalesce(b.pr, 0) AS other_pr FROM pr a LEFT JOIN pr b ON b.celltype = a.celltype AND b.gene = a.gene AND b.condition = 'O' WHERE a.condition = 'F'")
def join_ranks(t):
    r = ranked(t)
    return screening.join_ranks(r.where("condition = 'F'").select("celltype", "gene", "pr"), r.where("condition = 'O'").select("celltype", "gene", F.col("pr").alias("other_pr")), ["celltype", "gene"], "other_pr")


def polynomial(coefficients: tuple, x: str) -> str:
    text = "CAST(0 AS DOUBLE)"
    for c in reversed(coefficients):
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text


def ratio_sql(part: int, x: str) -> str:
    return f"{polynomial(screening.AS241[part][0], x)} / {polynomial(screening.AS241[part][1], x)}"


@query("normal_ranks", f"""CTE p AS (SELECT celltype, condition, gene, value, CAST(row_number() OVER (PARTITION BY celltype, condition ORDER BY value, gene) AS DOUBLE) / (count(*) OVER (PARTITION BY celltype, condition) + 1) AS p FROM st),
    q AS (SELECT *, p - CAST(0.5 AS DOUBLE) AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM p)
    SELECT celltype, condition, gene, value, round(CASE WHEN abs(q) <= 0.425 THEN q * {ratio_sql(0, '(CAST(0.180625 AS DOUBLE) - q * q)')} WHEN r <= 5 THEN sign(q) * {ratio_sql(1, '(r - 1.6)')} ELSE sign(q) * {ratio_sql(2, '(r - 5)')} END, 6) AS normal FROM q""")
def normal_ranks(t):
    return screening.normal_ranks(N.strength(t.aligned()), N.NET, "value", "gene").withColumn("normal", F.round("normal", 6))


@query("running_variance", "SELECT celltype, condition, gene, value, round(var_samp(value) OVER (PARTITION BY celltype, condition ORDER BY value, gene ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS variance FROM st")
def running_variance(t):
    return screening.running_variance(N.strength(t.aligned()), N.NET, ["value", "gene"], "value").withColumn("variance", F.round("variance", 6))


@query("renormalize", """CTE v AS (SELECT c.cell_id, celltype, feature, CAST(value AS DOUBLE) AS value FROM fx_counts c JOIN fx_cust USING (cell_id)), n AS (SELECT celltype, count(*) AS n FROM fx_cust GROUP BY ALL),
    b AS (SELECT celltype, feature, sum(value) / any_value(n) AS y FROM v JOIN n USING (celltype) GROUP BY ALL), m AS (SELECT feature, sum(y) / (SELECT count(*) FROM n) AS m FROM b GROUP BY ALL),
    f AS (SELECT celltype, sum(m * y) / sum(y * y) AS f FROM b JOIN m USING (feature) GROUP BY ALL), g AS (SELECT celltype, feature, y * f AS y FROM b JOIN f USING (celltype)),
    s AS (SELECT cell_id, sum(y * value) / sum(value * value) AS s FROM v JOIN g USING (celltype, feature) GROUP BY ALL) SELECT cell_id, feature, round(value * s, 6) AS value FROM v JOIN s USING (cell_id)""")
def renormalize(t):
    counts = t.counts().withColumn("value", F.col("value").cast("double"))
    return expression.renormalize(counts, t.customers(), "celltype").withColumn("value", F.round("value", 6))


@query("binary_specificity", "CTE fx_ones AS (SELECT cell_id, feature, CAST(1 AS DOUBLE) AS value FROM fx_counts WHERE value > 0), " + SPEC.removeprefix("CTE ").replace("fx_counts", "fx_ones") + "SELECT * FROM sp")
def binary_specificity(t):
    return expression.specificity_of_presence(t.counts(), t.customers(), "celltype")


@query("annotate_clusters", """CTE o AS (SELECT batch, celltype, count(*) AS shared FROM fx_cust GROUP BY ALL),
    z AS (SELECT *, sum(shared) OVER (PARTITION BY batch) AS m, shared / sum(shared) OVER (PARTITION BY batch) AS q, sum(shared) OVER (PARTITION BY celltype) / sum(shared) OVER () AS p FROM o),
    l AS (SELECT batch, celltype, shared, round(CASE WHEN q >= p THEN m * (q * ln(q / p) + CASE WHEN q = 1 THEN 0 ELSE (1 - q) * ln((1 - q) / (1 - p)) END) ELSE 0 END, 9) AS log_p FROM z)
    SELECT batch, celltype, shared, log_p FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY log_p DESC, celltype) AS r FROM l) WHERE r = 1""")
def annotate_clusters(t):
    return statistics.annotate_clusters(t.customers(), "batch", "celltype")


@query("impute_by_archetypes", """CTE n AS (SELECT celltype, count(*) AS n FROM fx_cust GROUP BY ALL), b AS (SELECT celltype, feature, CAST(sum(value) AS DOUBLE) / any_value(n) AS y FROM fx_counts JOIN fx_cust USING (cell_id) JOIN n USING (celltype) GROUP BY ALL),
    w AS (SELECT cell_id, celltype, 0.75 AS h FROM fx_cust UNION ALL SELECT cell_id, 'BUILDING', 0.25 FROM fx_cust)
    SELECT cell_id, feature, round(sum(h * y), 6) AS value FROM w JOIN b USING (celltype) GROUP BY ALL""")
def impute_by_archetypes(t):
    cells = t.customers()
    profiles = expression.pseudobulk(t.counts(), cells, ["celltype"]).select("feature", F.col("celltype").alias("archetype"), F.col("mean").cast("double").alias("value"))
    own = cells.select("cell_id", F.col("celltype").alias("archetype"), F.lit(0.75).alias("weight"))
    weights = own.unionByName(cells.select("cell_id", F.lit("BUILDING").alias("archetype"), F.lit(0.25).alias("weight")))
    return expression.impute_by_archetypes(profiles, weights).withColumn("value", F.round("value", 6))


@query("bind_cells", "SELECT 'a_' || cell_id AS cell_id, feature, value FROM fx_counts WHERE value > 20 UNION ALL SELECT 'b_' || cell_id, feature, value FROM fx_counts")
def bind_cells(t):
    return expression.bind_cells({"a": t.counts().where("value > 20"), "b": t.counts()})
