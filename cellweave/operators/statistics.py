"""Correlation networks, score thresholds, set overlaps, autocorrelation and survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways
from .network import NET


def correlation_network(counts: DataFrame, n_cells: int) -> DataFrame:
    """gene1 < gene2 with the Pearson correlation of their values over ``n_cells`` cells.

    Absent counts are zeros, so the sums of sparse rows suffice; features that don't vary, and
    pairs that share no cell, have no row.
    """
    own = counts.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    own = own.where(n_cells * F.col("q") > F.col("s") * F.col("s"))
    side = lambda k: own.select(F.col("feature").alias(f"gene{k}"), F.col("s").alias(f"s{k}"), F.col("q").alias(f"q{k}"))
    x, y = counts.select("cell_id", F.col("feature").alias("gene1"), F.col("value").alias("x")), counts.select("cell_id", F.col("feature").alias("gene2"), F.col("value").alias("y"))
    both = x.join(y, "cell_id").where("gene1 < gene2").groupBy("gene1", "gene2").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    spread = lambda k: F.sqrt((n_cells * F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}")).cast("double"))
    r = (n_cells * F.col("xy") - F.col("s1") * F.col("s2")).cast("double") / (spread(1) * spread(2))
    return both.join(side(1), "gene1").join(side(2), "gene2").select("gene1", "gene2", r.alias("pcc"))


def lls_threshold(bins: DataFrame, jump: float = 2.0, low: float = -0.5) -> DataFrame:
    """bin and mean_score at which a ranked network is cut, from ``lls_benchmark`` bins.

    The first bin whose score jumps by ``jump``, falls to ``low`` or is, with its two
    predecessors, negative more than once ends the network; the last bin before it that isn't
    negative is the cut (null if there is none).  Without such a bin there is no row.  At most
    max_pairs / bin_size rows come in, so the windows are small.
    """
    w = Window.orderBy("bin")
    negative = F.count_if(F.col("bin_lls") < 0).over(w.rowsBetween(-2, 0))
    seen = bins.select("bin", "mean_score", "bin_lls", F.row_number().over(w).alias("row"), F.lag("bin_lls").over(w).alias("before"), negative.alias("negative"))
    falls = F.col("before").isNotNull() & ((F.abs(F.col("bin_lls") - F.col("before")) >= jump) | (F.col("bin_lls") <= low))
    ends = seen.select("row", falls.alias("falls"), (falls | ((F.col("row") > 2) & (F.col("negative") > 1))).alias("ends")).where("ends")
    end = ends.agg(F.min_by("falls", "row").alias("falls"), F.min("row").alias("end")).where("end IS NOT NULL")
    upto = seen.join(F.broadcast(end), seen.row < F.when(F.col("falls"), F.col("end")).otherwise(F.col("end") - 1))
    cut = upto.agg(F.max(F.when(F.col("bin_lls") >= 0, F.col("bin"))).alias("bin"), F.max_by(F.when(F.col("bin_lls") >= 0, F.col("mean_score")), F.when(F.col("bin_lls") >= 0, F.col("row"))).alias("own"), F.max_by("mean_score", "row").alias("last"), F.any_value("falls").alias("falls"))
    return cut.where("falls IS NOT NULL").select("bin", F.when(F.col("falls"), F.col("last")).otherwise(F.col("own")).alias("mean_score"))


def hypergeometric_tail(population: Column | int, success: Column, sample: Column, observed: Column) -> Column:
    """Upper tail bound n KL(x / n || p) in nats, with p = success / population; 0 below the mean."""
    p = success / population
    q = observed / sample
    term = lambda a, b: F.when(a == 0, F.lit(0.0)).otherwise(a * F.log(a / b))
    return F.when(q >= p, F.coalesce(sample * (term(q, p) + term(1 - q, 1 - p)), F.lit(0.0))).otherwise(F.lit(0.0))


def overlap_enrichment(sets: DataFrame, terms: DataFrame, population: int) -> DataFrame:
    """set_name, term_name, shared and log_p of every set and term with a common gene."""
    sets, terms = sets.select("set_name", "gene").distinct(), terms.select("term_name", "gene").distinct()
    shared = sets.join(terms, "gene").groupBy("set_name", "term_name").agg(F.count(F.lit(1)).alias("shared"))
    sized = shared.join(sets.groupBy("set_name").agg(F.count(F.lit(1)).alias("n_set")), "set_name").join(terms.groupBy("term_name").agg(F.count(F.lit(1)).alias("n_term")), "term_name")
    return sized.select("set_name", "term_name", "shared", hypergeometric_tail(population, F.col("n_term"), F.col("n_set"), F.col("shared")).alias("log_p"))


def autocorrelation(net: DataFrame, scores: DataFrame) -> DataFrame:
    """1 - C / 2 of each network, C being Geary's for the scores (NET, gene, x) of its nodes."""
    x = scores.select(*NET, "gene", F.col("x").cast("double").alias("x"))
    mean = x.groupBy(*NET).agg(F.count("x").alias("n"), (F.var_pop("x") * F.count("x")).alias("ss"))
    ends = both_ways(net, "lls").join(x.select(*NET, F.col("gene").alias("src"), F.col("x").alias("a")), [*NET, "src"]).join(x.select(*NET, F.col("gene").alias("dst"), F.col("x").alias("b")), [*NET, "dst"])
    sums = ends.groupBy(*NET).agg(F.sum("lls").alias("w"), (F.sum(F.col("lls") * (F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))) / 2).alias("d"))
    c = (F.col("n") - 1) * F.col("d") / (2 * F.col("w") * F.col("ss"))
    return sums.join(mean, NET).where("ss > 0").select(*NET, (1 - c / 2).alias("autocorrelation"))


def marker_ratio(counts: DataFrame, markers: list[str]) -> DataFrame:
    """Values divided by the mean of the marker features in their cell; cells without any go."""
    mean = counts.where(F.col("feature").isin(markers)).groupBy("cell_id").agg((F.sum("value") / len(markers)).alias("mean"))
    return counts.join(mean.where("mean <> 0"), "cell_id").select("cell_id", "feature", (F.col("value") / F.col("mean")).alias("ratio"))


def survival_groups(samples: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Samples (time, event, score) with group low or high by quantiles of the score."""
    cuts = samples.agg(F.percentile("score", low).alias("lo"), F.percentile("score", high).alias("hi"))
    group = F.when(F.col("score") >= F.col("hi"), "high").when(F.col("score") <= F.col("lo"), "low")
    return samples.crossJoin(F.broadcast(cuts)).withColumn("group", group).where("group IS NOT NULL").drop("lo", "hi")


def kaplan_meier(samples: DataFrame) -> DataFrame:
    """group, time, at_risk, events and survival at each time; windows run over distinct times."""
    at = samples.groupBy("group", "time").agg(F.count(F.lit(1)).alias("n"), F.count_if("event").alias("events"))
    later = Window.partitionBy("group").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy("group").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("at_risk", F.sum("n").over(later))
    left = 1 - F.col("events") / F.col("at_risk")
    zero = F.max(F.col("events") == F.col("at_risk")).over(upto)
    sum_of_logs = F.sum(F.when(left > 0, F.log(left)).otherwise(F.lit(0.0))).over(upto)
    return at.select("group", "time", "at_risk", "events", F.when(zero, F.lit(0.0)).otherwise(F.exp(sum_of_logs)).alias("survival"))


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series for the gamma function nine places up."""
    z = n.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    steps = F.lit(1.0)
    for j in range(1, 9):
        steps = steps * (n.cast("double") + j)
    return series - F.log(steps)


def log_hypergeometric(n: Column, success: Column, drawn: Column, k: Column) -> Column:
    """ln P(k of ``drawn`` are among the ``success`` of n)."""
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    return choose(success, k) + choose(n - success, drawn - k) - choose(n, drawn)


def hypergeometric_log10(n: Column, success: Column, drawn: Column, k: Column) -> Column:
    """-log10 P(at least k), summed from the mode outwards so that no term overflows."""
    low, high = F.greatest(k, success + drawn - n, F.lit(0)), F.least(success, drawn)
    mode = F.greatest(low, F.least(high, F.floor((success + 1) * (drawn + 1) / (n + 2)))).cast("long")
    start = lambda: F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    up = lambda i: (success - i) * (drawn - i) / ((i + 1) * (n - success - drawn + i + 1))

    def walk(steps: Column, ratio) -> Column:
        def add(s: Column, i: Column) -> Column:
            term = s["term"] * ratio(i)
            return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

        return F.aggregate(steps, start(), add, lambda s: s["sum"])

    none = F.array().cast("array<bigint>")
    over = walk(F.when(mode < high, F.sequence(mode, (high - 1).cast("long"))).otherwise(none), up)
    under = walk(F.when(mode > low, F.sequence((mode - 1).cast("long"), low.cast("long"), F.lit(-1).cast("long"))).otherwise(none), lambda i: 1 / up(i))
    tail = F.least(F.lit(0.0), log_hypergeometric(n, success, drawn, mode) + F.log(1 + over + under)) / F.log(F.lit(10.0))
    return F.when(k > high, F.lit(float("inf"))).when(k <= F.greatest(success + drawn - n, F.lit(0)), F.lit(0.0)).otherwise(-tail)


def fisher_exact(tables: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Adds odds_ratio (of the sample) and p_value (two-sided) to rows with 2 x 2 counts."""
    x, y, z, w = (F.col(i).cast("long") for i in (a, b, c, d))
    n, rows, cols = x + y + z + w, x + y, x + z
    # farther than this from the mean a term is below exp(-750) by Hoeffding's bound, which a double holds as 0
    mean, far = F.coalesce(F.try_divide(rows.cast("double") * cols, n), F.lit(0.0)), F.sqrt(375.0 * F.least(rows, cols)) + 2
    low = F.greatest(F.lit(0).cast("long"), rows + cols - n, F.floor(mean - far).cast("long"))
    support = F.sequence(low, F.least(rows, cols, F.ceil(mean + far).cast("long")))
    logs = F.transform(support, lambda k: log_hypergeometric(n, rows, cols, k))
    # the own term is a column, so that it is not found again for each other
    found = tables.withColumns({"_own": log_hypergeometric(n, rows, cols, x), "_logs": logs})
    p = F.aggregate(F.col("_logs"), F.lit(0.0), lambda s, v: s + F.when(v <= F.col("_own") + 1e-7, F.exp(v)).otherwise(F.lit(0.0)))
    tables = found.withColumn("p_value", F.least(F.lit(1.0), p)).drop("_own", "_logs")
    columns = [c for c in tables.columns if c not in ("odds_ratio", "p_value")]
    return tables.withColumn("odds_ratio", F.try_divide((x * w).cast("double"), (y * z).cast("double"))).select(*columns, "odds_ratio", "p_value")


def score_enrichment(scores: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """by, set_name, log_p, threshold: the largest Bernstein bound over all cuts of a ranking.

    ``scores``: by, gene, x.  A cut after each member of the set compares the members' sum with the
    set's share p of the prefix sum: L^2 / (2 (p x prefix of squares + top x L / 3)) for L > 0.
    ``threshold`` is the rank (from 0) of the best cut.  Sets with one gene or none are left out.
    Windows hold one score per gene.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("x"), "gene").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    x = F.col("x")
    ranked = scores.select(*by, "gene", x, (F.row_number().over(order) - 1).alias("rank"), F.sum(x).over(order).alias("sum"), F.sum(x * x).over(order).alias("squares"), F.max(x).over(every).alias("top"), F.count(F.lit(1)).over(every).alias("n"))
    hits = ranked.join(sets.select("set_name", "gene").distinct(), "gene")
    own = Window.partitionBy(*by, "set_name")
    hits = hits.withColumn("k", F.count(F.lit(1)).over(own)).withColumn("o", F.sum("x").over(own.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))).where("k > 1")
    p = F.col("k") / F.col("n")
    over = F.col("o") - F.col("sum") * p
    bound = F.when(over > 0, F.coalesce(F.try_divide(over * over, 2 * (F.col("squares") * p + F.col("top") * over / 3)), F.lit(0.0))).otherwise(F.lit(0.0))
    best = hits.groupBy(*by, "set_name").agg(F.max(F.struct(F.round(bound, 9).alias("log_p"), (-F.col("rank")).alias("at"))).alias("best"))
    return best.select(*by, "set_name", F.col("best.log_p").alias("log_p"), (-F.col("best.at")).cast("long").alias("threshold"))


def log_fold_change(bulk: DataFrame, group: str, control: str, case: str) -> DataFrame:
    """feature, log2 (mean + 1) of the case minus that of the control, from ``pseudobulk`` means;
    a feature that one group lacks has mean 0 there."""
    mean = lambda g: F.coalesce(F.max(F.when(F.col(group) == g, F.col("mean").cast("double"))), F.lit(0.0))
    both = bulk.where(F.col(group).isin(control, case)).groupBy("feature").agg(mean(control).alias("a"), mean(case).alias("b"))
    return both.select("feature", (F.log2(F.col("b") + 1) - F.log2(F.col("a") + 1)).alias("log_fc"))


def annotate_clusters(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """The label most enriched in each cluster by the tail bound; ties go to the smaller label."""
    shared = rows.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("shared"))
    size = lambda c, name: shared.groupBy(c).agg(F.sum("shared").alias(name))
    sized = shared.join(size(cluster, "n_cluster"), cluster).join(size(label, "n_label"), label).join(F.broadcast(shared.agg(F.sum("shared").alias("n"))), F.lit(True))  # one row
    log_p = F.round(hypergeometric_tail(F.col("n"), F.col("n_label"), F.col("n_cluster"), F.col("shared")), 9)
    w = Window.partitionBy(cluster).orderBy(F.desc("log_p"), label)
    return sized.withColumn("log_p", log_p).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(cluster, label, "shared", "log_p")
