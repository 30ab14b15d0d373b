"""Queries of communities, assignment, neighbour graphs and decompositions, with SQL where it can state them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import assignment, bins, communities, decomposition, graph, neighbours, triangles
from ..operators import network as N
from .catalog import ASSOC, query


@query("leiden", None)
def leiden(t):
    return communities.leiden(t.aligned())


@query("leiden_modularity", None)
def leiden_modularity(t):
    net = graph.stored(t.aligned())
    return communities.modularity(net, communities.leiden(net)).withColumn("modularity", F.round("modularity", 6))


#: All ways to give each condition another cell type.
@query("map_labels", f"""CTE {ASSOC}, c AS (SELECT f.celltype AS f, o.celltype AS o, q.celltype AS q FROM p f JOIN p o ON o.condition = 'O' AND o.celltype <> f.celltype
      JOIN p q ON q.condition = 'P' AND q.celltype NOT IN (f.celltype, o.celltype) WHERE f.condition = 'F' ORDER BY f.log10_p + o.log10_p + q.log10_p DESC LIMIT 1)
    SELECT celltype, condition, log10_p FROM p JOIN c ON celltype = CASE condition WHEN 'F' THEN f WHEN 'O' THEN o ELSE q END""")
def map_labels(t):
    return assignment.map_labels(t.cells(), "celltype", "condition").withColumn("log10_p", F.round("log10_p", 6))


def brand_vectors(t):
    """Customers as vectors of what they bought of each brand."""
    counts = t.counts().withColumn("value", F.col("value").cast("double"))
    brands = t.read("part").select(F.col("p_brand").alias("feature")).distinct()
    wide = brands.groupBy().agg(F.sort_array(F.collect_list("feature")).alias("brands"))  # one row, a name a brand
    own = counts.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    return own.crossJoin(F.broadcast(wide)).select(F.col("cell_id").alias("id"), F.expr("transform(brands, b -> coalesce(m[b], 0D))").alias("x"))


@query("nn_descent", None)
def nn_descent(t):
    return neighbours.nn_descent(brand_vectors(t), k=15).withColumn("distance", F.round("distance", 6))


@query("neighbour_network", None)
def neighbour_network(t):
    return neighbours.neighbour_network(brand_vectors(t), k=30).withColumn("weight", F.round("weight", 6))


def purchases(t):
    """The sparse table of brands by customers."""
    return t.counts().select(F.col("feature").alias("row"), F.col("cell_id").alias("col"), F.col("value").cast("double").alias("x"))


def powers(i: int) -> str:
    return f"g{i} AS MATERIALIZED (SELECT p.a, q.b, sum(p.x * q.x) AS x FROM g{i - 1} p JOIN g0 q ON p.b = q.a GROUP BY ALL)"


#: The sum of all singular values to the power 2 i is the trace of the i-th power of the Gram matrix.
@query("singular_moments", f"""CTE g0 AS MATERIALIZED (SELECT p.feature AS a, q.feature AS b, CAST(sum(p.value * q.value) AS DOUBLE) AS x FROM fx_counts p JOIN fx_counts q USING (cell_id) GROUP BY ALL), {', '.join(map(powers, range(1, 6)))}
    SELECT i, round(log10(x), 6) AS moment FROM ({' UNION ALL '.join(f'SELECT {i + 1} AS i, sum(x) AS x FROM g{i} WHERE a = b' for i in range(6))})""")
def singular_moments(t):
    rows = purchases(t)
    _, s, _ = decomposition.truncated_svd(rows, dim=rows.select("row").distinct().count())
    return rows.sparkSession.createDataFrame([(i, float(np.round(np.log10((s ** (2 * i)).sum()), 6))) for i in range(1, 7)], "i int, moment double")


@query("reduced_kernel", None)
def reduced_kernel(t):
    return decomposition.reduced_kernel(purchases(t), dim=5, oversample=20)[2].select("id", F.posexplode("v").alias("k", "v"))


@query("simplex_regression", None)
def simplex_regression(t):
    """Customers as mixtures of the four that lie farthest apart."""
    points = brand_vectors(t)
    corners = [i for i, _ in decomposition.successive_projection(points, 4)]
    at = {r["id"]: r["x"] for r in points.where(F.col("id").isin(corners)).collect()}
    return decomposition.simplex_regression(points, np.array([at[i] for i in corners]).T).select("id", F.posexplode("h").alias("corner", "h"))


VECTORS = """x0 AS MATERIALIZED (SELECT id, list(coalesce(v, 0) ORDER BY b) AS x FROM (SELECT DISTINCT cell_id AS id FROM fx_counts), (SELECT DISTINCT p_brand AS b FROM part) LEFT JOIN (SELECT cell_id, feature, CAST(value AS DOUBLE) AS v FROM fx_counts) c ON c.cell_id = id AND c.feature = b GROUP BY id)"""
PICKS = ", ".join(f"""p{i} AS MATERIALIZED (SELECT id, x, list_inner_product(x, x) AS size FROM x{i} ORDER BY size DESC, id LIMIT 1),
    x{i + 1} AS MATERIALIZED (SELECT x.id, list_transform(list_zip(x.x, p.x), lambda z: z[1] - list_inner_product(x.x, p.x) / p.size * z[2]) AS x FROM x{i} x, p{i} p)""" for i in range(6))


@query("successive_projection", f"CTE {VECTORS}, {PICKS} " + " UNION ALL ".join(f"SELECT {i} AS step, id, round(size, 4) AS residual FROM p{i}" for i in range(6)))
def successive_projection(t):
    rows = [(k, i, round(float(size), 4)) for k, (i, size) in enumerate(decomposition.successive_projection(brand_vectors(t), 6))]
    return t.counts().sparkSession.createDataFrame(rows, "step int, id long, residual double")


#: Rounds of the diffusion until nothing is left to move (0.85 to the 150th is 3e-11).
LIMIT = """CTE wt AS (SELECT celltype, condition, gene, sum(lls) AS w FROM ends GROUP BY ALL), mv AS MATERIALIZED (SELECT e.celltype, e.condition, e.gene, other, lls / w AS p FROM ends e JOIN wt ON wt.celltype = e.celltype AND wt.condition = e.condition AND wt.gene = e.gene),
    d0 AS MATERIALIZED (SELECT celltype, condition, gene, CASE WHEN gene % 10 = 0 THEN 1.0 / greatest(1, count(*) FILTER (gene % 10 = 0) OVER (PARTITION BY celltype, condition)) ELSE 0 END::DOUBLE AS x FROM st), """ + ", ".join(f"d{i} AS MATERIALIZED (SELECT s.celltype, s.condition, s.gene, 0.85::DOUBLE * coalesce(m, 0) + 0.15::DOUBLE * s.x AS x FROM d0 s LEFT JOIN (SELECT mv.celltype, mv.condition, other AS gene, sum(p * x) AS m FROM mv JOIN d{i - 1} d ON d.celltype = mv.celltype AND d.condition = mv.condition AND d.gene = mv.gene GROUP BY ALL) n ON n.celltype = s.celltype AND n.condition = s.condition AND n.gene = s.gene)" for i in range(1, 151))


@query("diffusion_limit", LIMIT + " SELECT celltype, condition, gene, round(x + 3e-10, 6) AS x FROM d150")
def diffusion_limit(t):
    net = t.aligned()
    seeds = N.endpoints(net).distinct().where("gene % 10 = 0")
    n = seeds.groupBy(*N.NET).agg(F.count(F.lit(1)).alias("n"))
    seeds = seeds.join(n, N.NET).select(*N.NET, "gene", (1 / F.col("n")).alias("x0"))
    return graph.diffusion_limit(net, seeds).withColumn("x", F.round(F.col("x") + 3e-10, 6))


@query("ensemble_bins", """CTE z AS (SELECT celltype, count(*) AS n FROM fx_cust GROUP BY ALL), dn AS (SELECT c.celltype, b.feature, coalesce(CAST(value AS DOUBLE), 0) AS x FROM fx_cust c CROSS JOIN (SELECT DISTINCT feature FROM fx_counts) b LEFT JOIN fx_counts k ON k.cell_id = c.cell_id AND k.feature = b.feature),
    r AS (SELECT *, row_number() OVER (PARTITION BY celltype, feature ORDER BY x) AS r FROM dn), bn AS (SELECT celltype, n, bin, greatest(1, round_even(1 + (bin - 1) * (CAST(0.9 AS DOUBLE) * n - 1) / 9, 0)) AS cut FROM z, range(1, 11) y(bin))
    SELECT r.celltype, feature, CAST(bin AS INTEGER) AS bin, round(coalesce(sum(x) FILTER (r > cut), 0), 4) AS above, round(avg(x) FILTER (r >= cut), 6) AS mean, round(coalesce(var_samp(x) FILTER (r >= cut), 0) + 3e-7, 4) AS variance FROM r JOIN bn ON bn.celltype = r.celltype GROUP BY ALL""")
def ensemble_bins(t):
    cells = t.customers()
    rows = t.counts().join(cells, "cell_id").select("celltype", "feature", F.col("value").cast("double").alias("value"))
    found = bins.ensemble_bins(rows, ["celltype", "feature"], cells.groupBy("celltype").agg(F.count(F.lit(1)).alias("size")), 10)
    return found.withColumns({"above": F.round("above", 4), "mean": F.round("mean", 6), "variance": F.round(F.col("variance") + 3e-7, 4)})


@query("network_enhancement", """CTE p AS (SELECT e.celltype, e.condition, e.gene, other, lls / w AS p FROM ends e JOIN (SELECT celltype, condition, gene, sum(lls) AS w FROM ends GROUP BY ALL) s ON s.celltype = e.celltype AND s.condition = e.condition AND s.gene = e.gene),
    w AS (SELECT p.celltype, p.condition, p.gene, p.other, p / sqrt(c + 1e-16) AS w FROM p JOIN (SELECT celltype, condition, other, sum(p) AS c FROM p GROUP BY ALL) s ON s.celltype = p.celltype AND s.condition = p.condition AND s.other = p.other)
    SELECT a.celltype, a.condition, a.gene AS gene1, b.gene AS gene2, round(sum(a.w * b.w) + 3e-10, 6) AS weight FROM w a JOIN w b ON a.celltype = b.celltype AND a.condition = b.condition AND a.other = b.other AND a.gene < b.gene GROUP BY ALL""")
def network_enhancement(t):
    return graph.enhanced(t.aligned()).withColumn("weight", F.round(F.col("weight") + 3e-10, 6))


@query("transitivity", """CTE tr AS (SELECT a.celltype, a.condition, a.gene, sum(a.lls + b.lls) AS s, count(*) AS n FROM ends a JOIN ends b ON a.celltype = b.celltype AND a.condition = b.condition AND a.gene = b.gene AND a.other < b.other
      JOIN fx_net c ON c.celltype = a.celltype AND c.condition = a.condition AND c.gene1 = a.other AND c.gene2 = b.other GROUP BY ALL),
    o AS (SELECT celltype, condition, gene, sum(lls) AS total, count(*) AS d FROM ends GROUP BY ALL)
    SELECT celltype, condition, gene, coalesce(n, 0) AS triangles, CASE WHEN d > 1 THEN round(coalesce(s, 0) / (total * (d - 1)), 9) END AS transitivity FROM o LEFT JOIN tr USING (celltype, condition, gene)""")
def transitivity(t):
    return triangles.transitivity(t.aligned()).withColumn("transitivity", F.round("transitivity", 9))


@query("density_clusters", """CTE sg AS MATERIALIZED (SELECT * FROM ends WHERE lls > 40), co AS MATERIALIZED (SELECT celltype, condition, gene FROM sg GROUP BY ALL HAVING count(*) >= 3),
    ce AS MATERIALIZED (SELECT s.* FROM sg s JOIN co a ON a.celltype = s.celltype AND a.condition = s.condition AND a.gene = s.gene JOIN co b ON b.celltype = s.celltype AND b.condition = s.condition AND b.gene = s.other),
    r AS (SELECT celltype, condition, gene, gene AS seen FROM co UNION SELECT r.celltype, r.condition, r.gene, e.other FROM r JOIN ce e ON e.celltype = r.celltype AND e.condition = r.condition AND e.gene = r.seen),
    cl AS (SELECT celltype, condition, gene, min(seen) AS own FROM r GROUP BY ALL),
    bo AS (SELECT s.celltype, s.condition, s.gene, first(own ORDER BY lls DESC, s.other) AS border FROM sg s JOIN cl ON cl.celltype = s.celltype AND cl.condition = s.condition AND cl.gene = s.other GROUP BY ALL)
    SELECT celltype, condition, gene, own IS NOT NULL AS core, coalesce(own, border) AS cluster FROM st LEFT JOIN cl USING (celltype, condition, gene) LEFT JOIN bo USING (celltype, condition, gene)""")
def density_clusters(t):
    return triangles.density_clusters(t.aligned(), 3, 40)


@query("spanner", None)
def spanner(t):
    return triangles.spanner(t.aligned().withColumn("d", 52 - F.col("lls")), 2, "d")


@query("minimum_forest", None)
def minimum_forest(t):
    return triangles.minimum_forest(t.aligned().withColumn("d", 52 - F.col("lls")), "d")
