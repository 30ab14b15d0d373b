"""Queries of profiles: diffusion, annotation, similarity and adaptive cuts, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network as N
from ..operators import expression, profiles
from ..operators.graph import cut
from .catalog import query
from .screens import hashed, rewired_sql, uniform

#: The ends of an edge with the share of the source's weight that it carries.
MOVES = "pm AS MATERIALIZED (SELECT celltype, condition, gene, other, CAST(0.85 AS DOUBLE) * lls / sum(lls) OVER (PARTITION BY celltype, condition, gene) AS p FROM ends)"
#: Features of nodes: a gene's size, by its type.
SIZES = "fs AS MATERIALIZED (SELECT celltype, condition, gene, p_type AS feature, CAST(p_size AS DOUBLE) AS x FROM st JOIN part ON gene = p_partkey WHERE p_size > 0)"
EVEN = "ev AS MATERIALIZED (SELECT celltype, condition, gene, '' AS feature, CAST(1 AS DOUBLE) AS x FROM st)"


def spread_sql(name: str, rows: str, rounds: int = 5) -> str:
    """``name``: the rows diffused; needs ``pm``."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT celltype, condition, gene, feature, x / sum(x) OVER (PARTITION BY celltype, condition, feature) AS x FROM {rows})"]
    for i in range(rounds):
        steps.append(f"""{name}{i + 1} AS MATERIALIZED (SELECT celltype, condition, gene, feature, sum(x) AS x FROM (SELECT pm.celltype, pm.condition, other AS gene, feature, p * x AS x FROM pm JOIN {name}{i} y ON y.celltype = pm.celltype AND y.condition = pm.condition AND y.gene = pm.gene
          UNION ALL SELECT celltype, condition, gene, feature, (1 - CAST(0.85 AS DOUBLE)) * x FROM {name}0) GROUP BY ALL)""")
    return ", ".join(steps)


def sizes(t):
    part = t.read("part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("feature"), F.col("p_size").cast("double").alias("x"))
    net = cut(t.aligned())  # made once for both
    return net, N.endpoints(net).distinct().join(part, "gene").select(*N.NET, "gene", "feature", "x")


def rounded(df, *columns):
    # off the ties, where sums in another order would round apart
    return df.withColumns({c: F.round(F.col(c) + 3e-10, 6) for c in columns})


def r6(x: str) -> str:
    return f"round({x} + CAST(3e-10 AS DOUBLE), 6)"


@query("impute_by_diffusion", f"""CTE {MOVES}, {SIZES}, {spread_sql('d', 'fs')}
    SELECT celltype, condition, gene, feature, {r6('x * was / top')} AS x FROM d5 JOIN (SELECT celltype, condition, feature, max(x) AS top FROM d5 GROUP BY ALL) USING (celltype, condition, feature)
    JOIN (SELECT celltype, condition, feature, max(x) AS was FROM fs GROUP BY ALL) USING (celltype, condition, feature)""")
def impute_by_diffusion(t):
    return rounded(profiles.impute_by_diffusion(*sizes(t)), "x")


#: Labels of features, with weights.
MARKED = [("common", "ECONOMY", 1.0), ("common", "STANDARD", 0.5), ("fine", "PROMO", 1.0), ("fine", "ECONOMY", -0.25)]


@query("annotate_by_diffusion", f"""CTE {MOVES}, {SIZES}, {EVEN}, {spread_sql('d', 'fs')}, {spread_sql('e', 'ev')},
    mk AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', CAST({w} AS DOUBLE))" for a, b, w in MARKED)}) v(label, feature, weight)),
    rw AS (SELECT celltype, condition, label, feature, weight * total AS w FROM mk JOIN (SELECT celltype, condition, feature, sum(x) AS total FROM fs GROUP BY ALL) USING (feature)),
    wt AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY celltype, condition, label)) AS u FROM rw)
    SELECT d.celltype, d.condition, d.gene, label, {r6('sum(u * d.x * log2(d.x / e.x))')} AS score FROM d5 d JOIN e5 e ON e.celltype = d.celltype AND e.condition = d.condition AND e.gene = d.gene
    JOIN wt ON wt.celltype = d.celltype AND wt.condition = d.condition AND wt.feature = d.feature GROUP BY ALL""")
def annotate_by_diffusion(t):
    net, rows = sizes(t)
    return rounded(profiles.annotate_by_diffusion(net, rows, net.sparkSession.createDataFrame(MARKED, "label string, feature string, weight double")), "score")


A, PUSH = "(1 - CAST(0.85 AS DOUBLE))", "((1 - sqrt(1 - CAST(0.85 AS DOUBLE))) / (1 + sqrt(1 - CAST(0.85 AS DOUBLE))))"


def pagerank_sql(rounds: int) -> str:
    steps = [f"""rt AS MATERIALIZED (SELECT celltype, condition, gene, sqrt(value) AS root FROM st),
    wk AS MATERIALIZED (SELECT e.celltype, e.condition, e.gene AS src, e.other AS gene, lls / (a.root * b.root) AS p FROM ends e JOIN rt a ON a.celltype = e.celltype AND a.condition = e.condition AND a.gene = e.gene JOIN rt b ON b.celltype = e.celltype AND b.condition = e.condition AND b.gene = e.other),
    y0 AS MATERIALIZED (SELECT celltype, condition, gene, root, {A} * CASE WHEN gene % 5 = 0 THEN CAST(1 AS DOUBLE) / nullif(count(*) FILTER (gene % 5 = 0) OVER (PARTITION BY celltype, condition), 0) ELSE 0 END / root AS u, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y FROM rt)"""]
    for i in range(rounds):
        steps.append(f"""n{i} AS (SELECT o.*, (1 - {A}) / 2 * (y + coalesce(m, 0)) + u AS a FROM y{i} o LEFT JOIN (SELECT wk.celltype, wk.condition, wk.gene, sum(p * y) AS m FROM wk JOIN y{i} s ON s.celltype = wk.celltype AND s.condition = wk.condition AND s.gene = wk.src GROUP BY ALL) USING (celltype, condition, gene)),
        m{i} AS (SELECT *, sign(a) * greatest(abs(a) - {A} * CAST(1e-4 AS DOUBLE) * root, 0) AS z FROM n{i}),
        y{i + 1} AS MATERIALIZED (SELECT celltype, condition, gene, root, u, z AS x, z + {PUSH} * (z - x) AS y FROM m{i})""")
    return ", ".join(steps)


@query("sparse_pagerank", f"CTE {pagerank_sql(20)} SELECT celltype, condition, gene, {r6('x * root')} AS x FROM y20")
def sparse_pagerank(t):
    net = t.aligned()
    seeds = N.endpoints(net).distinct().where("gene % 5 = 0")
    n = seeds.groupBy(*N.NET).agg(F.count(F.lit(1)).alias("n"))
    return rounded(profiles.sparse_pagerank(net, seeds.join(n, N.NET).select(*N.NET, "gene", (1 / F.col("n")).alias("x0")), epsilon=0.0), "x")


@query("adaptive_neighbours", """CTE b AS (SELECT celltype, condition, gene, other, CAST(52 - lls AS DOUBLE) AS distance, CAST(52 - lls AS DOUBLE) / 8 AS d FROM ends),
    r AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, sum(d) OVER w AS s, sum(d * d) OVER w AS q FROM b WINDOW w AS (PARTITION BY celltype, condition, gene ORDER BY distance, other ROWS UNBOUNDED PRECEDING)),
    o AS (SELECT *, CASE WHEN rank + s * s - rank * q >= 0 THEN (s + sqrt(rank + s * s - rank * q)) / rank ELSE 0 END < d AS far FROM r)
    SELECT celltype, condition, gene, other, distance, rank FROM (SELECT *, bool_or(far) OVER (PARTITION BY celltype, condition, gene ORDER BY rank ROWS UNBOUNDED PRECEDING) AS over FROM o) WHERE NOT over""")
def adaptive_neighbours(t):
    net = t.aligned()
    way = lambda a, b: net.select(*N.NET, F.col(a).alias("gene"), F.col(b).alias("other"), (52 - F.col("lls")).alias("distance"))
    return profiles.adaptive_neighbours(way("gene1", "gene2").unionByName(way("gene2", "gene1")), [*N.NET, "gene"], density=8.0)


#: Weights of cells over archetypes: three quarters for the own segment, a quarter for BUILDING.
WEIGHTS = "wg AS (SELECT cell_id, archetype, sum(weight) AS weight FROM (SELECT cell_id, celltype AS archetype, CAST(0.75 AS DOUBLE) AS weight FROM fx_cust UNION ALL SELECT cell_id, 'BUILDING', 0.25 FROM fx_cust) GROUP BY ALL)"


def cell_weights(t):
    cells = t.customers()
    own = cells.select("cell_id", F.col("celltype").alias("archetype"), F.lit(0.75).alias("weight"))
    return own.unionByName(cells.select("cell_id", F.lit("BUILDING").alias("archetype"), F.lit(0.25).alias("weight"))).groupBy("cell_id", "archetype").agg(F.sum("weight").alias("weight"))


DOUBLE = """e0 AS (SELECT celltype AS archetype, 'N' || batch AS label, CAST(count(*) AS DOUBLE) AS x FROM fx_cust GROUP BY ALL),
    e1 AS (SELECT archetype, label, CASE WHEN max(x) OVER () > 100 THEN ln(1 + x) ELSE x END AS x FROM e0),
    e2 AS (SELECT archetype, label, x / (sqrt(sum(x) OVER (PARTITION BY archetype)) * sqrt(sum(x) OVER (PARTITION BY label))) AS x FROM e1),
    dn AS (SELECT archetype, label, x / max(x) OVER () AS x FROM e2)"""


def label_scores(t):
    return t.customers().groupBy(F.col("celltype").alias("archetype"), F.concat(F.lit("N"), F.col("batch").cast("string")).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("x"))


@query("double_norm", f"CTE {DOUBLE} SELECT archetype, label, {r6('x')} AS x FROM dn")
def double_norm(t):
    return rounded(profiles.double_norm(label_scores(t), "archetype", "label", "x"), "x")


@query("cells_from_archetypes", f"CTE {WEIGHTS}, {DOUBLE} SELECT cell_id, label, {r6('sum(weight * x)')} AS score FROM wg JOIN dn USING (archetype) GROUP BY ALL")
def cells_from_archetypes(t):
    return rounded(profiles.cells_from_archetypes(cell_weights(t), label_scores(t)), "score")


@query("pseudobulk_by_archetypes", f"""CTE {WEIGHTS}, h AS (SELECT cell_id, archetype, weight / (sum(weight) OVER (PARTITION BY cell_id) / (SELECT count(DISTINCT archetype) FROM wg)) AS h FROM wg)
    SELECT feature, archetype, {r6('sum(value * h)')} AS value FROM fx_counts JOIN h USING (cell_id) GROUP BY ALL""")
def pseudobulk_by_archetypes(t):
    counts = t.counts().withColumn("value", F.col("value").cast("double"))
    return rounded(profiles.pseudobulk_by_archetypes(counts, cell_weights(t)), "value")


@query("doublet_score", """CTE x AS (SELECT cell_id, CAST(value AS DOUBLE) / sum(CAST(value AS DOUBLE)) OVER (PARTITION BY cell_id) AS p FROM fx_counts WHERE value > 0), en AS (SELECT cell_id, sum(-p * ln(p)) AS h FROM x GROUP BY ALL),
    c AS (SELECT o_custkey AS cell_id, count(*) AS c, coalesce(any_value(h), 0) AS h FROM orders LEFT JOIN en ON cell_id = o_custkey GROUP BY ALL),
    m AS (SELECT *, quantile_cont(c, 0.5) OVER () AS mc, quantile_cont(h, 0.5) OVER () AS mh FROM c), k AS (SELECT *, quantile_cont(abs(c - mc), 0.5) OVER () AS kc, quantile_cont(abs(h - mh), 0.5) OVER () AS kh FROM m),
    z AS (SELECT cell_id, round(CASE WHEN kh > 0 THEN -(h - mh) / (1.4826 * kh) ELSE 0 END, 9) AS a, round(CASE WHEN kc > 0 THEN -(c - mc) / (1.4826 * kc) ELSE 0 END, 9) AS b FROM k)
    SELECT cell_id, round(a, 6) AS by_scores, round(b, 6) AS by_centrality, round((a + b) / 2, 6) AS combined, (a + b) / 2 > 1 AS doublet FROM z""")
def doublet_score(t):
    orders = t.read("orders").groupBy(F.col("o_custkey").alias("cell_id")).agg(F.count(F.lit(1)).alias("c"))
    found = profiles.doublet_score(t.counts().select("cell_id", F.col("feature").alias("label"), F.col("value").alias("x")), orders)
    return found.withColumns({c: F.round(c, 6) for c in ("by_scores", "by_centrality", "combined")})


@query("annotate_by_markers", f"""CTE pn AS MATERIALIZED (SELECT celltype, condition, gene, value AS x, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY celltype, condition) AS n FROM st WINDOW w AS (PARTITION BY celltype, condition ORDER BY gene)),
    sl AS MATERIALIZED (SELECT pn.*, p_type AS label, CASE WHEN gene % 2 = 0 THEN 1 ELSE -1 END AS sign, row_number() OVER (PARTITION BY celltype, condition, p_type ORDER BY gene) AS slot FROM pn JOIN part ON gene = p_partkey AND p_size > 40),
    dr AS (SELECT celltype, condition, label, rep, CAST([] AS BIGINT[]) AS taken, CAST(0 AS BIGINT) AS done FROM (SELECT DISTINCT celltype, condition, label FROM sl), range(1, 1001) x(rep)
      UNION ALL SELECT celltype, condition, label, rep, list_append(taken, list_reduce(list_sort(taken), lambda p, x: CASE WHEN x <= p THEN p + 1 ELSE p END, CAST(floor({uniform('1', 'label', 'rep', 'slot')} * (n - len(taken))) AS BIGINT))), slot
      FROM (SELECT dr.*, n, slot FROM dr JOIN sl ON sl.celltype = dr.celltype AND sl.condition = dr.condition AND sl.label = dr.label AND sl.slot = done + 1)),
    pk AS MATERIALIZED (SELECT celltype, condition, label, rep, done AS slot, taken[-1] AS pos FROM dr WHERE done > 0),
    nu AS (SELECT pk.celltype, pk.condition, pk.label, rep, sum(sign * pn.x) AS s FROM pk JOIN sl ON sl.celltype = pk.celltype AND sl.condition = pk.condition AND sl.label = pk.label AND sl.slot = pk.slot
      JOIN pn ON pn.celltype = pk.celltype AND pn.condition = pk.condition AND pn.pos = pk.pos GROUP BY ALL),
    ms AS (SELECT celltype, condition, label, avg(s) AS mean, stddev_samp(s) AS sd FROM nu GROUP BY ALL), ow AS (SELECT celltype, condition, label, sum(sign * x) AS score FROM sl GROUP BY ALL)
    SELECT celltype, condition, label, score, round(CASE WHEN sd > 0 THEN (score - mean) / sd ELSE 0 END, 6) AS z FROM ow JOIN ms USING (celltype, condition, label)""")
def annotate_by_markers(t):
    markers = t.read("part").where("p_size > 40").select(F.col("p_type").alias("label"), F.col("p_partkey").alias("gene"), F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1).alias("sign"))
    return profiles.annotate_by_markers(N.strength(t.aligned()).withColumnRenamed("value", "x"), markers, N.NET).withColumn("z", F.round("z", 6))


@query("label_autocorrelation", f"""CTE lb AS (SELECT celltype, condition, gene, p_type AS x FROM st JOIN part ON gene = p_partkey), sl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY celltype, condition ORDER BY gene) AS slot FROM lb),
    dn AS (SELECT celltype, condition, gene, rep, row_number() OVER (PARTITION BY celltype, condition, rep ORDER BY {hashed('1', 'celltype', 'condition', 'rep', 'gene')}, gene) AS slot FROM st, range(1, 101) x(rep)),
    sh AS (SELECT celltype, condition, x, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY celltype, condition) AS p FROM lb GROUP BY celltype, condition, x),
    sd AS MATERIALIZED (SELECT d.*, p FROM (SELECT d.celltype, d.condition, d.rep, d.gene, s.x FROM dn d JOIN sl s ON s.celltype = d.celltype AND s.condition = d.condition AND s.slot = d.slot UNION ALL SELECT celltype, condition, 0, gene, x FROM lb) d JOIN sh USING (celltype, condition, x)),
    ph AS (SELECT e.celltype, e.condition, a.rep, sum(CASE WHEN a.x = b.x THEN 2 ELSE -2 END * lls / (a.p * b.p)) AS phi FROM fx_net e JOIN sd a ON a.celltype = e.celltype AND a.condition = e.condition AND a.gene = gene1
      JOIN sd b ON b.celltype = e.celltype AND b.condition = e.condition AND b.gene = gene2 AND b.rep = a.rep GROUP BY ALL)
    SELECT celltype, condition, round(max(phi) FILTER (rep = 0), 3) AS phi, round((max(phi) FILTER (rep = 0) - avg(phi) FILTER (rep > 0)) / nullif(stddev_samp(phi) FILTER (rep > 0), 0), 6) AS z FROM ph GROUP BY ALL""")
def label_autocorrelation(t):
    net = t.aligned()
    types = t.read("part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("label"))
    return profiles.label_autocorrelation(net, N.endpoints(net).distinct().join(types, "gene")).withColumns({"phi": F.round("phi", 3), "z": F.round("z", 6)})


@query("topological_specificity", f"""CTE {rewired_sql('nl', 'true', '100', 0.0, 1)}, ms AS (SELECT celltype, condition, i, avg(value) AS mean, stddev_samp(value) AS sd FROM nl GROUP BY ALL),
    z AS (SELECT st.celltype, st.condition, st.gene, CASE WHEN sd > 0 THEN (value - mean) / sd ELSE 0 END AS z FROM st JOIN nl_nodes n ON n.celltype = st.celltype AND n.condition = st.condition AND n.gene = st.gene JOIN ms ON ms.celltype = st.celltype AND ms.condition = st.condition AND ms.i = n.i)
    SELECT celltype, condition, gene, {r6('z')} AS z, {r6('1 / (1 + exp(-z))')} AS specificity FROM z""")
def topological_specificity(t):
    return rounded(profiles.topological_specificity(t.aligned()), "z", "specificity")


@query("footprint_similarity", f"""CTE f AS (SELECT celltype AS archetype, feature AS item, CAST(sum(value) AS DOUBLE) AS x FROM fx_counts JOIN fx_cust USING (cell_id) GROUP BY ALL), p AS (SELECT archetype, item, x / sum(x) OVER (PARTITION BY archetype) AS p FROM f),
    k AS (SELECT a.archetype AS a, b.archetype AS b, sum(a.p * log2(2 * a.p / (a.p + b.p)) + b.p * log2(2 * b.p / (a.p + b.p))) / 2 AS js FROM p a JOIN p b ON a.item = b.item AND a.archetype < b.archetype GROUP BY ALL)
    SELECT a, b, {r6('1 - sqrt(greatest(js, 0))')} AS similarity FROM k""")
def footprint_similarity(t):
    rows = t.counts().join(t.customers(), "cell_id").groupBy(F.col("celltype").alias("archetype"), F.col("feature").alias("item")).agg(F.sum("value").cast("double").alias("x"))
    return rounded(profiles.footprint_similarity(rows), "similarity")


@query("regulator_activity", """CTE sets AS (SELECT p_brand AS regulator, 'type' AS library, p_partkey AS gene FROM part WHERE p_size > 10 UNION ALL SELECT p_brand, 'size', p_partkey FROM part WHERE p_size < 40),
    r AS (SELECT celltype, condition, gene, value AS x, row_number() OVER w - 1 AS rank, sum(value) OVER w AS s, sum(value * value) OVER w AS q, max(value) OVER (PARTITION BY celltype, condition) AS top, count(*) OVER (PARTITION BY celltype, condition) AS n
      FROM st WINDOW w AS (PARTITION BY celltype, condition ORDER BY value DESC, gene ROWS UNBOUNDED PRECEDING)),
    h AS (SELECT *, count(*) OVER (PARTITION BY celltype, condition, library, regulator) AS k, sum(x) OVER (PARTITION BY celltype, condition, library, regulator ORDER BY rank ROWS UNBOUNDED PRECEDING) AS o FROM r JOIN sets USING (gene)),
    v AS (SELECT celltype, condition, library, regulator, max(CASE WHEN o > s * k / n THEN round((o - s * k / n) * (o - s * k / n) / (2 * (q * k / n + top * (o - s * k / n) / 3)), 9) ELSE 0 END) AS lp FROM h WHERE k > 1 GROUP BY ALL)
    SELECT celltype, condition, regulator, round(ln(sum(exp(lp * ln(10)))) - ln(count(*)), 6) AS log_p FROM v GROUP BY ALL""")
def regulator_activity(t):
    part = t.read("part")
    of = lambda where, library: part.where(where).select(F.lit(library).alias("library"), F.col("p_brand").alias("regulator"), F.col("p_partkey").alias("gene"))
    sets = of("p_size > 10", "type").unionByName(of("p_size < 40", "size"))
    return profiles.regulator_activity(N.strength(t.aligned()).withColumnRenamed("value", "x"), sets, N.NET).withColumn("log_p", F.round("log_p", 6))


@query("archetype_specificity", f"""CTE {WEIGHTS}, n AS (SELECT count(*) AS n FROM fx_cust), g AS (SELECT feature, count(*) FILTER (value > 0) / any_value(n) AS row_p, sum(value) / count(*) FILTER (value > 0) AS row_factor, max(value) AS row_max FROM fx_counts, n GROUP BY feature),
    k AS (SELECT cell_id, count(*) FILTER (value > 0) AS k FROM fx_counts GROUP BY ALL), rho AS (SELECT sum(k) / any_value(n) AS rho FROM k, n),
    h AS (SELECT cell_id, archetype, weight / sum(weight) OVER (PARTITION BY archetype) AS h FROM wg), b AS (SELECT archetype, h * k / rho AS b FROM h JOIN k USING (cell_id), rho),
    ga AS (SELECT archetype, sum(b) AS b1, sum(b * b) AS b2, max(b) AS bmax FROM b GROUP BY ALL), o AS (SELECT archetype, feature, sum(h * value) AS obs FROM fx_counts JOIN h USING (cell_id) GROUP BY ALL),
    v AS (SELECT archetype, feature, obs, obs - row_p * row_factor * b1 AS d, row_p * row_factor * row_factor * b2 AS nu, row_max * bmax AS a FROM (SELECT ga.*, g.*, coalesce(o.obs, 0) AS obs FROM ga CROSS JOIN g LEFT JOIN o ON o.archetype = ga.archetype AND o.feature = g.feature))
    SELECT archetype, feature, {r6('obs')} AS obs, {r6('CASE WHEN d > 0 THEN d * d / (2 * (nu + d * a / 3)) / ln(10) ELSE 0 END')} AS upper, {r6('CASE WHEN d < 0 THEN d * d / (2 * nu) / ln(10) ELSE 0 END')} AS lower FROM v""")
def archetype_specificity(t):
    counts = t.counts().withColumn("value", F.col("value").cast("double"))
    return rounded(expression.archetype_specificity(counts, cell_weights(t), t.customers().count()), "obs", "upper", "lower")


@query("qc_filter_share", "CTE " + ", ".join(f"""c{i + 1} AS MATERIALIZED (SELECT * FROM {f'c{i}' if i else 'fx_counts'} WHERE cell_id IN (SELECT cell_id FROM {f'c{i}' if i else 'fx_counts'} GROUP BY cell_id HAVING count(*) FILTER (value > 0) >= 12 AND sum(value) BETWEEN 200 AND 1400)
    AND feature IN (SELECT feature FROM {f'c{i}' if i else 'fx_counts'} GROUP BY feature HAVING count(*) FILTER (value > 0) >= 0.45 * (SELECT count(DISTINCT cell_id) FROM fx_counts)))""" for i in range(8)) + " SELECT * FROM c8")
def qc_filter_share(t):
    return expression.qc_filter(t.counts(), min_cells=0.45, min_features=12, min_umis=200, max_umis=1400)
