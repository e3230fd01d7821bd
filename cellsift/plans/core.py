"""Queries for every operator on count experiments, and DuckDB SQL for those that SQL can express.

Orders are droplets and brands genes (quantities are counts); for some, suppliers and parts. Labels are
rules on the droplet's number, so that both engines start from the same clusters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.adjust import p_adjust
from ..functions.columns import lgamma, log_sum_exp, shares, softmax, softmax_marking_infinite
from ..model import Experiment
from ..operators import clustering, expression, mixture, normalize, plots, qc, scoring, variable
from ..sources import tables, tenx
from ..storage import new_path, written

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}
K = 3

#: The counts as SQL sees them; brands are numbered in their order.
ORDERS = """
g AS (SELECT gene, CAST(row_number() OVER (ORDER BY gene) - 1 AS INT) AS gene_idx FROM (SELECT DISTINCT p_brand AS gene FROM part)),
c AS (SELECT g.gene_idx, l_orderkey AS droplet_idx, sum(l_quantity) AS count FROM lineitem JOIN part ON l_partkey = p_partkey JOIN g ON g.gene = p_brand GROUP BY 1, 2),
d AS (SELECT droplet_idx, sum(count) AS total_counts, count(*) AS n_genes FROM c WHERE count > 0 GROUP BY 1),
gd AS (SELECT g.gene_idx, g.gene, coalesce(s.n, 0) AS total_counts, coalesce(s.n, 0) / (SELECT count(*) FROM d) AS mean, coalesce(s.k, 0) AS n_cells
  FROM g LEFT JOIN (SELECT gene_idx, sum(count) AS n, count_if(count > 0) AS k FROM c GROUP BY 1) s ON g.gene_idx = s.gene_idx)"""
SUPPLIERS = """
c AS (SELECT CAST(l_partkey AS INT) AS gene_idx, l_suppkey AS droplet_idx, sum(l_quantity) AS count FROM lineitem GROUP BY 1, 2),
d AS (SELECT droplet_idx, sum(count) AS total_counts, count(*) AS n_genes FROM c WHERE count > 0 GROUP BY 1)"""
#: Test droplets at 100 counts, with a label from 1 to K by rule; fixed ones (debris) have 1.
TEST = ", t AS (SELECT * FROM d WHERE total_counts >= 100)"
LABELLED = f", lab AS (SELECT droplet_idx, CASE WHEN total_counts >= 100 THEN CAST(droplet_idx % {K} AS INT) + 1 ELSE 1 END AS label, total_counts, n_genes, total_counts >= 100 AS free FROM d)"


def query(sql: str | None = None, head: str = ORDERS):
    def put(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {head.strip()}{sql}" if head else sql
        return f

    return put


def once(spark: SparkSession, sf: str) -> Experiment:
    """For queries that read the counts once."""
    return tables.experiment(spark, sf, "orders")


def orders(spark: SparkSession, sf: str) -> Experiment:
    """With the counts written, for queries that go over them again."""
    counts, genes, droplets = tables.orders_by_brand(spark, sf)
    counts, genes = written(counts, "counts"), written(genes, "names")
    return qc.create_experiment(counts, genes, counts.select("droplet_idx").distinct().withColumn("droplet", F.concat(F.lit("O"), "droplet_idx")), "orders")


def split(spark: SparkSession, sf: str) -> Experiment:
    return qc.filter_genes(qc.set_debris_test_set(orders(spark, sf)))


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, so that sums in another order are the same; -0 as 0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def by_rule(x: Experiment) -> DataFrame:
    free = F.col("total_counts") >= 100
    return x.droplets.select("droplet_idx", F.when(free, F.col("droplet_idx") % K + 1).otherwise(1).cast("int").alias("label"), "total_counts", "n_genes", free.alias("free"))


def labelled(spark: SparkSession, sf: str) -> Experiment:
    """The split experiment with clusters by rule, as if the mixture had assigned them, and the debris score by brand 0 to 4."""
    x = split(spark, sf)
    calls = by_rule(x).where("free").select("droplet_idx", F.col("label").cast("string").alias("Cluster"), F.lit(1.0).alias("ClusterProb"))
    return x.with_(calls=calls)


# ---------------------------------------------------------------- quality control


@query(" SELECT gene, round(mean, 6) AS mean, total_counts, CAST(n_cells AS BIGINT) AS n_cells FROM gd")
def fill_counts_gene(spark, sf):
    return once(spark, sf).genes.select("gene", r("mean").alias("mean"), "total_counts", "n_cells")


@query(" SELECT 'O' || droplet_idx AS droplet, total_counts, CAST(n_genes AS BIGINT) AS n_genes FROM d")
def fill_counts_droplet(spark, sf):
    return once(spark, sf).droplets.select("droplet", "total_counts", "n_genes")


@query(
    """WITH c AS (SELECT o_custkey AS droplet_idx, count(*) AS n FROM orders GROUP BY 1)
SELECT 'C' || c_custkey AS droplet, CAST(n AS DOUBLE) AS total_counts FROM customer JOIN c ON c_custkey = droplet_idx""",
    head="",
)
def create_drop_zero(spark, sf):
    """Customers are droplets and order priorities genes; customers without orders go."""
    made = tables.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("droplet_idx"), "o_orderpriority").agg(F.count("*").alias("count"))
    genes = tables.indexed(tables.read(spark, sf, "orders"), "o_orderpriority", "gene_idx").withColumnRenamed("o_orderpriority", "gene")
    counts = made.join(F.broadcast(genes), F.col("o_orderpriority") == F.col("gene"))
    droplets = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("droplet_idx"), F.concat(F.lit("C"), "c_custkey").alias("droplet"))
    return qc.create_experiment(counts, genes, droplets).droplets.select("droplet", "total_counts")


@query("SELECT p_partkey AS idx, CASE WHEN n = 1 THEN p_type ELSE p_type || '.' || (n - 1) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part)", head="")
def make_unique(spark, sf):
    return tenx.make_unique(tables.read(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_type").alias("name")), "name", "idx")


@query(" SELECT droplet_idx, CASE WHEN total_counts >= 100 AND n_genes >= 3 THEN 'test' ELSE 'debris' END AS \"set\" FROM d")
def split_test_debris(spark, sf):
    return qc.set_debris_test_set(orders(spark, sf), 100, 3).droplets.select("droplet_idx", "set")


@query(
    """, k AS (SELECT *, row_number() OVER (ORDER BY total_counts DESC, droplet_idx) AS n FROM d WHERE total_counts >= 100)
SELECT droplet_idx, CASE WHEN total_counts >= (SELECT min(total_counts) FROM k WHERE n <= 500) THEN 'test' ELSE 'debris' END AS \"set\" FROM d"""
)
def split_top_n(spark, sf):
    return qc.set_debris_test_set(orders(spark, sf), 100, top_n=500).droplets.select("droplet_idx", "set")


@query(" SELECT droplet_idx, CASE WHEN total_counts >= 100 AND droplet_idx NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'test' ELSE 'debris' END AS \"set\" FROM d")
def split_debris_ids(spark, sf):
    ids = tables.read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("O"), "o_orderkey").alias("droplet"))
    return qc.set_debris_test_set(orders(spark, sf), 100, debris_ids=ids).droplets.select("droplet_idx", "set")


@query(" SELECT gene, 1e6 * total_counts / (SELECT sum(total_counts) FROM gd) > 40000 AS exprsd FROM gd")
def filter_genes_cpm(spark, sf):
    return qc.filter_genes(qc.set_debris_test_set(orders(spark, sf)), 40000).genes.select("gene", "exprsd")


@query(" SELECT droplet_idx, round(100 * sum(CASE WHEN gene LIKE 'Brand#1%' THEN count ELSE 0 END) / sum(count), 6) AS pct FROM c JOIN g ON c.gene_idx = g.gene_idx GROUP BY 1")
def gene_pct(spark, sf):
    x = once(spark, sf)
    return qc.gene_percent(x, qc.genes_like(x, "^brand#1"), "pct").droplets.select("droplet_idx", r("pct").alias("pct"))


@query(TEST + " SELECT droplet_idx, total_counts, CAST(n_genes AS BIGINT) AS n_genes FROM t WHERE total_counts >= 120")
def droplet_data_test(spark, sf):
    return qc.droplet_data(split(spark, sf), 120).select("droplet_idx", "total_counts", "n_genes")


CALLED = TEST + ", k AS (SELECT *, CASE WHEN droplet_idx % 3 + 1 <> 1 AND n_genes >= 4 THEN 'Clean' ELSE 'Debris' END AS call FROM t)"


def with_calls(spark, sf) -> Experiment:
    return scoring.call_targets(labelled(spark, sf), thresh_score=None, clusters=[1], min_genes=4)


@query(CALLED + " SELECT droplet_idx, total_counts FROM k WHERE call = 'Clean'")
def droplet_data_clean(spark, sf):
    return qc.droplet_data(with_calls(spark, sf), 1, "clean").select("droplet_idx", "total_counts")


@query(CALLED + " SELECT droplet_idx, total_counts FROM k WHERE call = 'Debris'")
def droplet_data_debris(spark, sf):
    return qc.droplet_data(with_calls(spark, sf), 1, "debris").select("droplet_idx", "total_counts")


@query(CALLED + " SELECT c.gene_idx, c.droplet_idx, count FROM c JOIN k ON c.droplet_idx = k.droplet_idx WHERE call = 'Clean'")
def raw_counts_clean(spark, sf):
    return qc.raw_counts(with_calls(spark, sf), "clean")


@query(" SELECT gene, CAST(n_cells AS BIGINT) AS n_cells FROM gd WHERE n_cells >= 2200")
def gene_data_min(spark, sf):
    return qc.gene_data(once(spark, sf), 2200).select("gene", "n_cells")


@query(" SELECT total_counts, CAST(min(n) AS BIGINT) AS rank FROM (SELECT total_counts, row_number() OVER (ORDER BY total_counts DESC, droplet_idx) AS n FROM d) GROUP BY 1")
def barcode_rank(spark, sf):
    return plots.barcode_rank_plot(once(spark, sf))


@query(TEST + " SELECT droplet_idx, 'O' || droplet_idx AS droplet, CAST(droplet_idx % 3 + 1 AS VARCHAR) AS \"Cluster\" FROM t")
def cluster_labels(spark, sf):
    return qc.clusters(labelled(spark, sf))


# ---------------------------------------------------------------- normalisation and moments


@query(" SELECT gene_idx, c.droplet_idx, round(count / total_counts, 9) AS value FROM c JOIN d ON c.droplet_idx = d.droplet_idx")
def proportions(spark, sf):
    return normalize.proportions(once(spark, sf).counts).withColumn("value", r("value", 9))


@query(" SELECT gene_idx, c.droplet_idx, round(ln(1 + 10000.0 * count / total_counts), 6) AS value FROM c JOIN d ON c.droplet_idx = d.droplet_idx")
def log_norm_sf(spark, sf):
    return normalize.norm_counts(once(spark, sf).counts, 1e4).withColumn("value", r("value"))


@query(TEST + " SELECT gene_idx, c.droplet_idx, round(ln(1 + (SELECT median(total_counts) FROM t) * count / total_counts), 6) AS value FROM c JOIN t ON c.droplet_idx = t.droplet_idx")
def log_norm_median(spark, sf):
    return normalize.normalize_data(split(spark, sf)).norm.withColumn("value", r("value"))


MOMENTS = ", m AS (SELECT gene_idx, sum(count) / (SELECT count(*) FROM d) AS mean, (sum(count * count) - sum(count) * sum(count) / (SELECT count(*) FROM d)) / ((SELECT count(*) FROM d) - 1) AS var FROM c GROUP BY 1)"


@query(MOMENTS + " SELECT gene_idx, round(mean, 6) AS mean, round(var, 6) AS var FROM m")
def gene_moments(spark, sf):
    x = orders(spark, sf)
    return variable.gene_moments(x.counts, x.droplets.count()).select("gene_idx", r("mean").alias("mean"), r("var").alias("var"))


@query(MOMENTS + " SELECT gene_idx, round(mean, 6) AS mean, round(var, 6) AS var FROM m", head=SUPPLIERS)
def gene_moments_suppliers(spark, sf):
    x = tables.experiment(spark, sf, "suppliers")
    return variable.gene_moments(x.counts, x.droplets.count()).select("gene_idx", r("mean").alias("mean"), r("var").alias("var"))


@query(
    """, w AS (SELECT droplet_idx, CAST(droplet_idx % 7 AS DOUBLE) AS weight FROM d), s AS (SELECT sum(weight) AS s FROM w),
m AS (SELECT gene_idx, sum(weight * count) / (SELECT s FROM s) AS mean, sum(weight) AS sw, sum(weight * count) AS s1, sum(weight * count * count) AS s2 FROM c JOIN w ON c.droplet_idx = w.droplet_idx GROUP BY 1)
SELECT gene_idx, round(mean, 6) AS mean, round(s2 / (SELECT s FROM s) - mean * mean, 6) AS var FROM m"""
)
def weighted_moments(spark, sf):
    x = orders(spark, sf)
    weights = x.droplets.select("droplet_idx", (F.col("droplet_idx") % 7).cast("double").alias("weight"))
    return variable.weighted_moments(x.counts, weights).select("gene_idx", r("mean").alias("mean"), r("var").alias("var"))


#: Local quadratic fits over the q = floor(0.8 n) nearest genes, by their normal equations.
LOESS = (
    MOMENTS
    + """, l AS (SELECT gene_idx, log10(mean + 1) AS x, log10(var + 1) AS y FROM m),
q AS (SELECT CAST(floor(count(*) * 0.8 + 1e-5) AS INT) AS q FROM l),
p AS (SELECT a.gene_idx, b.x - a.x AS u, b.y AS y, row_number() OVER (PARTITION BY a.gene_idx ORDER BY abs(b.x - a.x)) AS n FROM l a CROSS JOIN l b),
h AS (SELECT gene_idx, max(abs(u)) AS h FROM p WHERE n <= (SELECT q FROM q) GROUP BY 1),
w AS (SELECT p.gene_idx, u / h AS u, y, pow(1 - pow(abs(u) / h, 3), 3) AS w FROM p JOIN h ON p.gene_idx = h.gene_idx WHERE abs(u) < h),
s AS (SELECT gene_idx, sum(w) AS s0, sum(w*u) AS s1, sum(w*u*u) AS s2, sum(w*u*u*u) AS s3, sum(w*u*u*u*u) AS s4, sum(w*y) AS t0, sum(w*u*y) AS t1, sum(w*u*u*y) AS t2 FROM w GROUP BY 1),
f AS (SELECT gene_idx, (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / (s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2)) AS fit FROM s)
SELECT l.gene_idx, round(x, 6) AS mean, round(y, 6) AS var, round(fit, 5) AS fit, CAST(row_number() OVER (ORDER BY y - fit DESC, l.gene_idx) AS BIGINT) AS rank FROM l JOIN f ON l.gene_idx = f.gene_idx"""
)


@query(LOESS)
def var_gene_loess(spark, sf):
    x = orders(spark, sf)
    got = variable.variable_genes(variable.gene_moments(x.counts, x.droplets.count()), 100, 0.8)
    return got.select("gene_idx", r("mean").alias("mean"), r("var").alias("var"), r("fit", 5).alias("fit"), "rank")


# ---------------------------------------------------------------- array functions

ARRAYS = "a AS (SELECT l_orderkey AS k, list(l_extendedprice / 10000 ORDER BY l_linenumber, l_extendedprice) AS v FROM lineitem GROUP BY 1)"


def prices(spark, sf) -> DataFrame:
    lines = tables.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_extendedprice") / 10000).alias("x")))).alias("v"))
    return lines.select("k", F.col("v.x").alias("v"))


@query(" SELECT k, round(list_max(list_transform(v, lambda x: exp(x - list_max(v)))) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS top, round(list_sum(list_transform(v, lambda x: exp(x))), 4) AS whole FROM a", head=ARRAYS)
def softmax_prices(spark, sf):
    v = F.col("v")
    return prices(spark, sf).select("k", r(F.array_max(softmax(v))).alias("top"), r(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x)), 4).alias("whole"))


@query(" SELECT k, round(exp(v[1] - list_max(v)) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS first FROM a", head=ARRAYS)
def fraction_log(spark, sf):
    return prices(spark, sf).select("k", r(softmax_marking_infinite(F.col("v"))[0]).alias("first"))


@query(" SELECT k, round(ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) + list_max(v), 6) AS s FROM a", head=ARRAYS)
def sum_log(spark, sf):
    return prices(spark, sf).select("k", r(log_sum_exp(F.col("v"))).alias("s"))


@query(" SELECT k, round(v[1] / list_sum(v), 6) AS first FROM a", head=ARRAYS)
def fraction_vec(spark, sf):
    return prices(spark, sf).select("k", r(shares(F.col("v"))[0]).alias("first"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, round(lgamma(l_quantity / 7), 8) AS lg FROM lineitem", head="")
def lgamma_column(spark, sf):
    return tables.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), r(lgamma(F.col("l_quantity") / 7), 8).alias("lg"))


# ---------------------------------------------------------------- the mixture, step by step

#: One round from the labels by rule: sums, parameters, likelihoods, posteriors.
PARAMS = (
    LABELLED
    + f""", ks AS (SELECT CAST(unnest(range(1, {K} + 1)) AS INT) AS k),
zx AS (SELECT g.gene_idx, ks.k, coalesce(sum(count) FILTER (label = ks.k), 0) + 1e-10 AS s FROM g CROSS JOIN ks LEFT JOIN (SELECT c.*, label FROM c JOIN lab ON c.droplet_idx = lab.droplet_idx) x ON x.gene_idx = g.gene_idx GROUP BY 1, 2),
al AS (SELECT gene_idx, k, s / sum(s) OVER (PARTITION BY k) AS a FROM zx),
pi AS (SELECT label AS k, count(*) * 1.0 / (SELECT count(*) FROM lab) AS pi FROM lab GROUP BY 1)"""
)
LLK = PARAMS + """, ll AS (SELECT c.droplet_idx, al.k, sum(count * ln(a)) AS l, sum(lgamma(count + 1)) AS lc, sum(count) AS n FROM c JOIN al ON c.gene_idx = al.gene_idx JOIN lab ON lab.droplet_idx = c.droplet_idx AND free GROUP BY 1, 2),
lp AS (SELECT ll.droplet_idx, ll.k, l + ln(pi) AS v, lgamma(n + 1) - lc + l AS llk FROM ll JOIN pi ON ll.k = pi.k),
zz AS (SELECT droplet_idx, k, llk, exp(v - max(v) OVER (PARTITION BY droplet_idx)) AS e FROM lp),
z AS (SELECT droplet_idx, k, llk, e / sum(e) OVER (PARTITION BY droplet_idx) AS z FROM zz)"""


def first_params(x: Experiment) -> tuple[DataFrame, DataFrame, DataFrame, list[float]]:
    """z by rule, alpha and pi from it."""
    z = mixture.one_hot_labels(by_rule(x).select("droplet_idx", "label"), K)
    a = mixture.multinomial_alpha(x.counts, z, x.genes, K)
    pi = [q.pi for q in mixture.mixing_weights(z, K).orderBy("cluster").collect()]
    return z, a, mixture.mixing_weights(z, K), pi


def exploded(df: DataFrame, array: str, key: str, out: str, digits: int = 6) -> DataFrame:
    return df.select(key, F.posexplode(array).alias("k", "v")).select(key, (F.col("k") + 1).alias("k"), r("v", digits).alias(out))


@query(PARAMS + " SELECT gene_idx, k, round(a, 9) AS a FROM al")
def em_alpha(spark, sf):
    return exploded(first_params(orders(spark, sf))[1], "a", "gene_idx", "a", 9)


@query(PARAMS + " SELECT k AS cluster, round(pi, 9) AS pi FROM pi")
def em_pi(spark, sf):
    return first_params(orders(spark, sf))[2].select("cluster", r("pi", 9).alias("pi"))


def free_counts(x: Experiment) -> DataFrame:
    return x.counts.join(by_rule(x).where("free"), "droplet_idx", "left_semi")


@query(LLK + " SELECT droplet_idx, k, round(llk, 4) AS llk FROM z")
def em_llk(spark, sf):
    x = orders(spark, sf)
    return exploded(mixture.multinomial_llk(free_counts(x), first_params(x)[1]), "llk", "droplet_idx", "llk", 4)


@query(LLK + " SELECT droplet_idx, k, round(z, 6) AS z FROM z")
def em_z(spark, sf):
    x = orders(spark, sf)
    _, a, _, pi = first_params(x)
    return exploded(mixture.responsibilities(mixture.multinomial_llk(free_counts(x), a, False), pi), "z", "droplet_idx", "z")


@query(LLK + " SELECT round(avg(change), 6) AS delta FROM (SELECT z.droplet_idx, sum(abs(z - CASE WHEN label = k THEN 1 ELSE 0 END)) AS change FROM z JOIN lab ON z.droplet_idx = lab.droplet_idx GROUP BY 1)")
def em_delta(spark, sf):
    x = orders(spark, sf)
    z, a, _, pi = first_params(x)
    return mixture.mean_change(mixture.responsibilities(mixture.multinomial_llk(free_counts(x), a, False), pi), z).select(r("delta").alias("delta"))


def round_sql(i: int) -> str:
    """The i-th M- and E-step after those of LLK."""
    p = "" if i == 1 else str(i - 1)
    return f""", fz{i} AS MATERIALIZED (SELECT droplet_idx, k, z FROM z{p} UNION ALL SELECT droplet_idx, 1 AS k, 1.0 AS z FROM lab WHERE NOT free),
zx{i} AS (SELECT g.gene_idx, ks.k, coalesce(x.s, 0) + 1e-10 AS s FROM g CROSS JOIN ks LEFT JOIN (SELECT gene_idx, k, sum(count * z) AS s FROM c JOIN fz{i} ON c.droplet_idx = fz{i}.droplet_idx GROUP BY 1, 2) x ON x.gene_idx = g.gene_idx AND x.k = ks.k),
al{i} AS (SELECT gene_idx, k, s / sum(s) OVER (PARTITION BY k) AS a FROM zx{i}),
pi{i} AS (SELECT k, sum(z) / (SELECT count(*) FROM lab) AS pi FROM fz{i} GROUP BY 1),
ll{i} AS (SELECT c.droplet_idx, a.k, sum(count * ln(a)) AS l FROM c JOIN al{i} a ON c.gene_idx = a.gene_idx JOIN lab ON lab.droplet_idx = c.droplet_idx AND free GROUP BY 1, 2),
lp{i} AS (SELECT l.droplet_idx, l.k, l + ln(pi) AS v FROM ll{i} l JOIN pi{i} p ON l.k = p.k),
zz{i} AS (SELECT droplet_idx, k, exp(v - max(v) OVER (PARTITION BY droplet_idx)) AS e FROM lp{i}),
z{i} AS MATERIALIZED (SELECT droplet_idx, k, e / sum(e) OVER (PARTITION BY droplet_idx) AS z FROM zz{i})"""


ROUNDS = LLK + round_sql(1) + round_sql(2) + round_sql(3)


def fitted(spark, sf, rounds: int = 3, kind: str = "mltn") -> Experiment:
    x = split(spark, sf)
    labels = by_rule(x).select("droplet_idx", "label")
    genes = np.array(sorted(q.gene_idx for q in x.genes.collect()))
    start = mixture.params_from_labels(x.counts, labels, genes, K, kind)
    return mixture.run_em(x.with_(params=start), max_iter=rounds, eps=0)


@query(ROUNDS + " SELECT droplet_idx, k, round(z, 4) AS z FROM z3")
def em_3_iterations(spark, sf):
    return exploded(fitted(spark, sf).z, "z", "droplet_idx", "z", 4)


@query(ROUNDS + " SELECT droplet_idx, CAST(arg_max(k, (z, -k)) AS VARCHAR) AS \"Cluster\", round(max(z), 4) AS p FROM z3 GROUP BY 1")
def assign_clusters(spark, sf):
    return mixture.assign_clusters(fitted(spark, sf)).calls.select("droplet_idx", "Cluster", r("ClusterProb", 4).alias("p"))


@query(ROUNDS + " SELECT gene_idx, k, round(a, 6) AS a FROM al3")
def fitted_alpha(spark, sf):
    x = fitted(spark, sf)
    return exploded(qc.alpha(x), "a", "gene_idx", "a")


DM_START = PARAMS + """, da AS (SELECT gene_idx, k, a * 50 AS a FROM al)"""


def dm_start(x: Experiment) -> DataFrame:
    return first_params(x)[1].select("gene_idx", F.transform("a", lambda v: v * 50).alias("a"))


@query(
    DM_START
    + """, w AS (SELECT k, sum(a) AS w FROM da GROUP BY 1),
s AS (SELECT c.droplet_idx, da.k, sum(count) AS n, sum(lgamma(count + a) - lgamma(count + 1) - lgamma(a)) AS l FROM c JOIN da ON c.gene_idx = da.gene_idx JOIN lab ON lab.droplet_idx = c.droplet_idx AND free GROUP BY 1, 2)
SELECT droplet_idx, s.k, round(lgamma(n + 1) + lgamma(w) - lgamma(n + w) + l, 4) AS llk FROM s JOIN w ON s.k = w.k"""
)
def dm_llk(spark, sf):
    x = orders(spark, sf)
    return exploded(mixture.dirichlet_llk(free_counts(x), dm_start(x)), "llk", "droplet_idx", "llk", 4)


DM_MOM = PARAMS + """, pr AS (SELECT c.gene_idx, label AS k, count / total_counts AS p FROM c JOIN lab ON c.droplet_idx = lab.droplet_idx),
wk AS (SELECT label AS k, count(*) AS w FROM lab GROUP BY 1),
mo AS (SELECT g.gene_idx, wk.k, coalesce(sum(p), 0) / w AS m, coalesce(sum(p * p), 0) / w - pow(coalesce(sum(p), 0) / w, 2) AS v FROM g CROSS JOIN wk LEFT JOIN pr ON pr.gene_idx = g.gene_idx AND pr.k = wk.k GROUP BY g.gene_idx, wk.k, w),
mom AS (SELECT gene_idx, k, m * max(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 0 END) OVER (PARTITION BY k) + 1e-10 AS a FROM mo)"""


@query(DM_MOM + " SELECT gene_idx, k, round(a, 6) AS a FROM mom")
def dm_mom(spark, sf):
    x = orders(spark, sf)
    z, *_ = first_params(x)
    return exploded(mixture.dirichlet_moments(x.counts, z, x.genes, K), "a", "gene_idx", "a")


@query(
    DM_MOM
    + """, st AS (SELECT gene_idx, k, a + 1e-10 AS a FROM mom), wa AS (SELECT k, sum(a) AS w FROM st GROUP BY 1),
up AS (SELECT c.gene_idx, label AS k, sum(count / (count - 1 + a)) AS u FROM c JOIN lab ON c.droplet_idx = lab.droplet_idx JOIN st ON st.gene_idx = c.gene_idx AND st.k = label GROUP BY 1, 2),
dn AS (SELECT label AS k, sum(total_counts / (total_counts - 1 + w)) AS n FROM lab JOIN wa ON wa.k = label GROUP BY 1)
SELECT st.gene_idx, st.k, round(a * coalesce(u, 0) / n + 1e-10, 6) AS a FROM st LEFT JOIN up ON up.gene_idx = st.gene_idx AND up.k = st.k JOIN dn ON dn.k = st.k"""
)
def dm_loo_step(spark, sf):
    """One step of the leave-one-out fixed point from the moments, as the M-step takes it."""
    x = orders(spark, sf)
    labels = by_rule(x).select("droplet_idx", "label")
    genes = np.array(sorted(q.gene_idx for q in x.genes.collect()))
    sums = mixture.fixed_sums(mixture.droplet_rows(x.counts, labels, genes), labels, len(genes), K, "DM")
    start = {q.gene_idx: q.a for q in mixture.dirichlet_moments(x.counts, first_params(x)[0], x.genes, K).collect()}
    out = []
    for k in range(K):
        cells: dict[int, list] = {}
        for (g, v), w in sums.cells.items():
            if w[k] > 0:
                cells.setdefault(g, []).append((v, w[k]))
        arrays = {g: tuple(np.array(c) for c in zip(*p, strict=True)) for g, p in cells.items()}
        sizes = arrays.pop(-1)
        step = mixture.loo_fixed_point(np.array([start[int(g)][k] for g in genes]), arrays, sizes, 0, 1e-10, max_iter=1)
        out += [(int(g), k + 1, round(float(a), 6)) for g, a in zip(genes, step, strict=True)]
    return spark.createDataFrame(out, "gene_idx int, k int, a double")


@query()
def dm_fit(spark, sf):
    """A Dirichlet-multinomial mixture after two rounds."""
    return exploded(fitted(spark, sf, 2, "DM").z, "z", "droplet_idx", "z", 3)


# ---------------------------------------------------------------- differential expression

WELCH = """, gm AS (SELECT e.gene_idx, s.label, s.n, coalesce(sum(v.value), 0) / s.n AS m,
    (coalesce(sum(v.value * v.value), 0) - coalesce(sum(v.value), 0) * coalesce(sum(v.value), 0) / s.n) / (s.n - 1) AS v, coalesce(sum(v.value), 0) AS s1, coalesce(sum(v.value * v.value), 0) AS s2
  FROM (SELECT DISTINCT gene_idx FROM v) e CROSS JOIN (SELECT label, count(*) * 1.0 AS n FROM lb GROUP BY 1) s
  LEFT JOIN (SELECT v.*, label FROM v JOIN lb ON v.droplet_idx = lb.droplet_idx) v ON v.gene_idx = e.gene_idx AND v.label = s.label GROUP BY 1, 2, 3)"""
#: Two-sided p of t by Simpson's rule: the density of t is that of cos(a) ** (dof - 1) with a = atan(t / sqrt(dof)).
P = """greatest(0, 1 - 2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) * least(atan(abs(t) / sqrt(dof)), 40 / sqrt(dof)) / 6000
  * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END
    * pow(cos(least(atan(abs(t) / sqrt(dof)), 40 / sqrt(dof)) * i / 2000), dof - 1))))"""
T_DOF = "(m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dof"


#: The tests' rows of each label against the rest.
REST = """, ov AS (SELECT gene_idx, label AS cluster, n AS n1, m AS m1, v AS v1, sum(n) OVER w - n AS n2, (sum(s1) OVER w - s1) AS r1, (sum(s2) OVER w - s2) AS r2 FROM gm WINDOW w AS (PARTITION BY gene_idx)),
rs AS (SELECT gene_idx, cluster, n1, m1, v1, n2, r1 / n2 AS m2, (r2 - r1 * r1 / n2) / (n2 - 1) AS v2 FROM ov) """


def with_p(rows: str, keys: str) -> str:
    """SQL of the tests' columns, p among them, of rows with m1, v1, n1, m2, v2, n2."""
    return f"SELECT {keys}, round(m1 - m2, 6) + 0.0 AS diff, round(log2(m1) - log2(m2), 6) + 0.0 AS \"logFC\", round(t, 5) + 0.0 AS t, round(dof, 2) AS dof, round({P}, 6) + 0.0 AS p FROM (SELECT *, {T_DOF} FROM ({rows}) WHERE m1 > 0 AND m2 > 0)"


def tested(df: DataFrame) -> DataFrame:
    keys = [c for c in ("gene_idx", "cluster") if c in df.columns]
    return df.select(*keys, r("diff").alias("diff"), r("logFC").alias("logFC"), r("t", 5).alias("t"), r("dof", 2).alias("dof"), r("p").alias("p"))


@query(
    TEST + ", v AS (SELECT gene_idx, c.droplet_idx, ln(1 + 1.0 * count / total_counts) AS value FROM c JOIN t ON c.droplet_idx = t.droplet_idx), lb AS (SELECT droplet_idx, CASE WHEN droplet_idx % 2 = 0 THEN 1 ELSE 2 END AS label FROM t)"
    + WELCH + " " + with_p("SELECT a.gene_idx, a.m AS m1, a.v AS v1, a.n AS n1, b.m AS m2, b.v AS v2, b.n AS n2 FROM gm a JOIN gm b ON a.gene_idx = b.gene_idx AND a.label = 1 AND b.label = 2", "gene_idx")
)
def de_welch(spark, sf):
    x = split(spark, sf)
    even = F.col("droplet_idx") % 2 == 0
    test = x.droplets.where("set = 'test'")
    return tested(expression.de_ttest(x.test_counts(), test.where(even), test.where(~even), normalize=True))


@query(
    TEST + ", v AS (SELECT gene_idx, c.droplet_idx, ln(1 + 1.0 * count / total_counts) AS value FROM c JOIN t ON c.droplet_idx = t.droplet_idx), lb AS (SELECT droplet_idx, droplet_idx % 4 AS label FROM t)"
    + WELCH + REST + with_p("SELECT * FROM rs", "gene_idx, CAST(cluster AS INT) AS cluster")
)
def de_one_vs_rest(spark, sf):
    x = split(spark, sf)
    labels = x.droplets.where("set = 'test'").select("droplet_idx", (F.col("droplet_idx") % 4).cast("int").alias("label"))
    return tested(expression.one_vs_rest(normalize.norm_counts(x.test_counts(), 1), labels))


#: Clusters that have more of some brands: droplets with over two fifths of the first eight, with as much of the next eight, and others.
SIGNAL = """, sg AS (SELECT t.droplet_idx, CASE WHEN 5 * sum(CASE WHEN gene_idx < 8 THEN count ELSE 0 END) > 2 * sum(count) THEN 1 WHEN 5 * sum(CASE WHEN gene_idx BETWEEN 8 AND 15 THEN count ELSE 0 END) > 2 * sum(count) THEN 2 ELSE 3 END AS label
  FROM t JOIN c ON c.droplet_idx = t.droplet_idx GROUP BY 1)"""


def signalled(spark: SparkSession, sf: str) -> Experiment:
    x = split(spark, sf)
    much = lambda low, high: 5 * F.sum(F.when(F.col("gene_idx").between(low, high), F.col("count")).otherwise(0)) > 2 * F.sum("count")
    label = F.when(much(0, 7), "1").when(much(8, 15), "2").otherwise("3")
    return x.with_(calls=written(x.test_counts().groupBy("droplet_idx").agg(label.alias("Cluster"), F.lit(1.0).alias("ClusterProb")), "calls"))


VALUES = TEST + ", v AS (SELECT gene_idx, c.droplet_idx, ln(1 + 1.0 * count / total_counts) AS value FROM c JOIN t ON c.droplet_idx = t.droplet_idx)"


@query(
    VALUES + SIGNAL + ", lb AS (SELECT * FROM sg)" + WELCH + REST + f""", ps AS (SELECT *, {P} AS p FROM (SELECT *, {T_DOF} FROM rs WHERE m1 > 0 AND m2 > 0)),
ad AS (SELECT *, least(1, p * count(p) OVER (PARTITION BY cluster)) AS p_adj, row_number() OVER (PARTITION BY cluster ORDER BY t DESC, gene_idx) AS rank FROM ps)
SELECT CAST(cluster AS VARCHAR) AS cluster, gene_idx, round(t, 5) + 0.0 AS t, round(p_adj, 6) + 0.0 AS p_adj, CAST(rank AS INT) AS rank FROM ad WHERE p_adj < 0.05 AND log2(m1) - log2(m2) > 0"""
)
def de_ttest_all(spark, sf):
    """Significant brands of each of the clusters that have more of some."""
    x = signalled(spark, sf)
    got = expression.de_ttest_all(x.test_counts(), x.calls.select("droplet_idx", F.col("Cluster").alias("label")))
    return got.select("cluster", "gene_idx", r("t", 5).alias("t"), r("p_adj", 6).alias("p_adj"), "rank")


#: A p-value for each part, from its price.
P_VALUES = "p AS (SELECT p_partkey AS gene_idx, CASE WHEN p_size = 1 THEN NULL ELSE pow((p_retailprice - floor(p_retailprice)) + 0.0001, 2) END AS p FROM part), n AS (SELECT count(p) AS n FROM p), q AS (SELECT gene_idx, p, row_number() OVER (ORDER BY p, gene_idx) AS k FROM p WHERE p IS NOT NULL)"


def p_values(spark, sf) -> DataFrame:
    price = F.col("p_retailprice")
    return tables.read(spark, sf, "part").select(F.col("p_partkey").alias("gene_idx"), F.when(F.col("p_size") != 1, F.pow(price - F.floor(price) + 0.0001, F.lit(2.0))).alias("p"))


def adjusted(method: str) -> Query:
    def run(spark, sf):
        return p_adjust(p_values(spark, sf), method).select("gene_idx", r("p_adj", 9).alias("p_adj"))

    run.__name__ = f"p_adjust_{method.lower()}"
    return run


def adjusted_sql(value: str) -> str:
    return f", x AS (SELECT gene_idx, {value} AS v FROM q, n) SELECT p.gene_idx, CASE WHEN v IS NOT NULL THEN round(least(1, v), 9) END AS p_adj FROM p LEFT JOIN x ON p.gene_idx = x.gene_idx"


for _method, _value in {
    "BH": "min(p * n / k) OVER (ORDER BY k DESC)",
    "BY": "min((SELECT list_sum(list_transform(range(1, n + 1), lambda i: 1.0 / i)) FROM n) * p * n / k) OVER (ORDER BY k DESC)",
    "bonferroni": "p * n",
    "holm": "max(p * (n - k + 1)) OVER (ORDER BY k)",
    "hochberg": "min(p * (n - k + 1)) OVER (ORDER BY k DESC)",
}.items():
    query(adjusted_sql(_value), head=P_VALUES)(adjusted(_method))
#: The largest Simes p-value of the sets with a p-value: of each size, of it and the largest others.
HOMMEL = """, st AS (SELECT m.m, q.k, m.m * q.p / (q.k - (n - m.m)) AS v, q.k - (n - m.m) AS j FROM (SELECT unnest(range(1, 100000)) AS m) m, n, q WHERE m.m <= n AND q.k > n - m.m),
sm AS (SELECT m, min(v) AS whole, min(v) FILTER (WHERE j > 1) AS others FROM st GROUP BY 1),
x AS (SELECT gene_idx, max(CASE WHEN k > n - m THEN whole ELSE least(m * p, coalesce(others, m * p)) END) AS v FROM q, n, sm GROUP BY 1)
SELECT p.gene_idx, CASE WHEN v IS NOT NULL THEN round(least(1, v), 9) END AS p_adj FROM p LEFT JOIN x ON p.gene_idx = x.gene_idx"""
query(HOMMEL, head=P_VALUES)(adjusted("hommel"))
query(adjusted_sql("p"), head=P_VALUES)(adjusted("none"))


# ---------------------------------------------------------------- markers and summaries

MARKERS = PARAMS + """, wt AS (SELECT label AS k, sum(total_counts) AS w FROM lab GROUP BY 1),
mk AS (SELECT al.gene_idx, al.k, a AS p1, (sum(a * w) OVER (PARTITION BY gene_idx) - a * w) / ((SELECT sum(w) FROM wt) - w) AS p2 FROM al JOIN wt ON al.k = wt.k),
mr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p1 - p2 DESC, gene_idx) AS rank FROM mk)"""


@query(MARKERS + " SELECT gene_idx, k AS cluster, round(p1, 7) AS p1, round(p2, 7) AS p2, round(p1 - p2, 7) + 0.0 AS diff, round(log2(p1) - log2(p2), 5) + 0.0 AS \"logFC\" FROM mr WHERE rank <= 5")
def marker_genes(spark, sf):
    x = orders(spark, sf)
    weights = {q.label: q.w for q in by_rule(x).groupBy("label").agg(F.sum("total_counts").alias("w")).collect()}
    got = expression.de_basic(first_params(x)[1], [weights[i] for i in range(1, K + 1)], 5)
    return got.select("gene_idx", "cluster", *[r(c, 7).alias(c) for c in ("p1", "p2", "diff")], r("logFC", 5).alias("logFC"))


@query(
    ROUNDS
    + """, cl AS (SELECT droplet_idx, CAST(arg_max(k, (z, -k)) AS INT) AS k FROM z3 GROUP BY 1),
ac AS (SELECT d.droplet_idx, coalesce(cl.k, 1) AS k, total_counts FROM d LEFT JOIN cl ON d.droplet_idx = cl.droplet_idx),
wt AS (SELECT ks.k, coalesce(sum(total_counts), 0) AS w FROM ks LEFT JOIN ac ON ac.k = ks.k GROUP BY 1),
mk AS (SELECT a.gene_idx, a.k, a AS p1, (sum(a * w) OVER (PARTITION BY gene_idx) - a * w) / ((SELECT sum(w) FROM wt) - w) AS p2 FROM al3 a JOIN wt ON a.k = wt.k),
mr AS (SELECT gene_idx, k, row_number() OVER (PARTITION BY k ORDER BY p1 - p2 DESC, gene_idx) AS rank FROM mk),
tp AS (SELECT k, string_agg(gene, ';' ORDER BY rank) AS genes FROM mr JOIN g ON g.gene_idx = mr.gene_idx WHERE rank <= 4 GROUP BY 1),
nu AS (SELECT k, count(*) AS n, avg(n_genes) AS ng, avg(total_counts) AS nc FROM cl JOIN d ON cl.droplet_idx = d.droplet_idx GROUP BY 1)
SELECT CASE WHEN a.k = 1 THEN 'Debris' ELSE 'Clean' END AS "Type", CAST(a.k AS VARCHAR) AS "Cluster", CAST(coalesce(n, 0) AS BIGINT) AS n_droplets, round(ng, 6) AS avg_n_genes, round(nc, 6) AS avg_n_counts, genes
FROM (SELECT DISTINCT k FROM ac) a LEFT JOIN nu ON a.k = nu.k LEFT JOIN tp ON a.k = tp.k"""
)
def cluster_summary(spark, sf):
    got = expression.summarize_clusters(mixture.assign_clusters(fitted(spark, sf)), 4)
    return got.select("Type", "Cluster", "n_droplets", r("avg_n_genes").alias("avg_n_genes"), r("avg_n_counts").alias("avg_n_counts"), "genes")


# ---------------------------------------------------------------- scores and calls

#: Brands that cluster 1 has significantly more of (Benjamini and Hochberg, 0.05); the raw score is their summed log-proportion.
SCORE = (
    VALUES + SIGNAL + ", lb AS (SELECT droplet_idx, least(label, 2) AS label FROM sg)"
    + WELCH + f""", ps AS (SELECT *, {P} AS p FROM (SELECT *, {T_DOF} FROM (SELECT a.gene_idx, a.m AS m1, a.v AS v1, a.n AS n1, b.m AS m2, b.v AS v2, b.n AS n2 FROM gm a JOIN gm b ON a.gene_idx = b.gene_idx AND a.label = 1 AND b.label = 2) WHERE m1 > 0 AND m2 > 0)),
bh AS (SELECT *, least(1, min(p * n / k) OVER (ORDER BY k DESC)) AS p_adj FROM (SELECT *, row_number() OVER (ORDER BY p, gene_idx) AS k, count(*) OVER () AS n FROM ps)),
dg AS (SELECT gene_idx, p_adj FROM bh WHERE p_adj < 0.05 AND log2(m1) - log2(m2) > 0),
rw AS (SELECT t.droplet_idx, t.n_genes, t.total_counts, CAST(sg.label AS VARCHAR) AS cluster, coalesce(s.raw, 0) AS raw FROM t JOIN sg ON sg.droplet_idx = t.droplet_idx LEFT JOIN (SELECT droplet_idx, sum(value) AS raw FROM v WHERE gene_idx IN (SELECT gene_idx FROM dg) GROUP BY 1) s ON s.droplet_idx = t.droplet_idx),
lo AS (SELECT min(m) AS low FROM (SELECT avg(raw) AS m FROM rw GROUP BY cluster)), hi AS (SELECT avg(raw) AS top FROM rw WHERE cluster = '1'),
sc AS (SELECT rw.*, (raw - low) / (top - low) AS score FROM rw, lo, hi), ca AS (SELECT *, CASE WHEN cluster <> '2' AND score < 1 AND n_genes >= 4 THEN 'Clean' ELSE 'Debris' END AS call FROM sc)"""
)


def scored(spark, sf) -> Experiment:
    return scoring.estimate_dbr_score(signalled(spark, sf), thresh_genes=0)


def fully_called(spark, sf) -> Experiment:
    return scoring.call_targets(scored(spark, sf), thresh_score=1, clusters=[2], min_genes=4)


@query(SCORE + " SELECT droplet_idx, cluster AS \"Cluster\", round(score, 6) + 0.0 AS score FROM sc")
def debris_score(spark, sf):
    return scored(spark, sf).calls.select("droplet_idx", "Cluster", r("score_debris").alias("score"))


@query(SCORE + " SELECT gene_idx, round(p_adj, 6) + 0.0 AS p_adj FROM dg")
def debris_genes(spark, sf):
    return qc.debris_genes(scored(spark, sf)).select("gene_idx", r("p_adj").alias("p_adj"))


@query(SCORE + " SELECT droplet_idx, call AS \"Call\" FROM ca")
def call_targets(spark, sf):
    return fully_called(spark, sf).calls.select("droplet_idx", "Call")


@query(SCORE + " SELECT droplet_idx, 'O' || droplet_idx AS droplet FROM ca WHERE call = 'Clean'")
def clean_ids(spark, sf):
    return scoring.get_clean_ids(fully_called(spark, sf))


@query(SCORE + " SELECT droplet_idx, 'O' || droplet_idx AS droplet FROM ca WHERE call = 'Debris' AND n_genes >= 3")
def removed_ids(spark, sf):
    return scoring.get_removed_ids(fully_called(spark, sf), 3)


@query(CALLED + " SELECT gene, 'O' || c.droplet_idx AS droplet, count FROM c JOIN k ON c.droplet_idx = k.droplet_idx JOIN g ON g.gene_idx = c.gene_idx WHERE call = 'Clean'")
def export_bundle(spark, sf):
    path = new_path(spark, "bundle")
    tenx.write_bundle(with_calls(spark, sf), path)
    return spark.read.parquet(f"{path}/counts")


@query(SCORE + " SELECT cluster AS \"Cluster\", CASE WHEN avg(score) > 1e-9 THEN round(log10(avg(score)), 4) + 0.0 END AS x, round(avg(n_genes), 6) AS y FROM sc GROUP BY 1")
def cluster_means_plot(spark, sf):
    """The cluster at score 0 has no logarithm but what is left of rounding, so it is null."""
    return plots.plot_clust(scored(spark, sf)).select("Cluster", F.when(F.col("x") > -9, r("x", 4)).alias("x"), r("y").alias("y"))


@query(TEST + " SELECT t.droplet_idx, round(log10(total_counts), 6) AS x, round(log10(n_genes), 6) AS y, round(coalesce(ln(1 + (SELECT median(total_counts) FROM t) * v.count / total_counts), 0), 6) AS color FROM t LEFT JOIN (SELECT droplet_idx, count FROM c JOIN g ON c.gene_idx = g.gene_idx WHERE gene = 'Brand#11') v ON v.droplet_idx = t.droplet_idx")
def plot_feature_xy(spark, sf):
    x = normalize.normalize_data(split(spark, sf))
    return plots.plot_umi_gene(x, "Brand#11").select("droplet_idx", r("x").alias("x"), r("y").alias("y"), r("color").alias("color"))


@query(SCORE + " SELECT droplet_idx, round(score, 6) + 0.0 AS x, round(log10(n_genes), 6) AS y FROM sc")
def plot_dbr_score(spark, sf):
    return plots.plot_dbr_score(scored(spark, sf)).select("droplet_idx", r("x").alias("x"), r("y").alias("y"))


# ---------------------------------------------------------------- starts that no SQL can give


def components(spark, sf) -> Experiment:
    return clustering.get_pcs(split(spark, sf), min_genes=4, n_var_genes=15, lss=0.8, n_pcs=4)


@query()
def pca_scores(spark, sf):
    """Scores of the droplets on the first components, without their arbitrary signs."""
    return exploded(components(spark, sf).pcs.withColumn("pcs", F.transform("pcs", F.abs)), "pcs", "droplet_idx", "score")


@query(
    TEST + """, u AS (SELECT droplet_idx FROM t WHERE n_genes >= 4), s AS (SELECT median(x) AS s FROM (SELECT sum(count) AS x FROM c WHERE droplet_idx IN (SELECT droplet_idx FROM u) GROUP BY droplet_idx)),
v AS (SELECT u.droplet_idx, g.gene_idx, ln(1 + s.s * coalesce(c.count, 0) / d.total_counts) AS x FROM u JOIN d ON d.droplet_idx = u.droplet_idx CROSS JOIN g CROSS JOIN s LEFT JOIN c ON c.droplet_idx = u.droplet_idx AND c.gene_idx = g.gene_idx),
m AS (SELECT gene_idx, avg(x) AS m, stddev_samp(x) AS d FROM v GROUP BY 1)
SELECT droplet_idx, round(sqrt(sum(pow((x - m.m) / m.d, 2))), 5) AS norm FROM v JOIN m ON m.gene_idx = v.gene_idx GROUP BY 1"""
)
def pca_norms(spark, sf):
    """With as many components as brands, a droplet's distance from the centre is that of its standardised values."""
    pcs = clustering.get_pcs(split(spark, sf), min_genes=4, n_var_genes=25, lss=0.8, n_pcs=25).pcs
    return pcs.select("droplet_idx", r(F.sqrt(F.aggregate("pcs", F.lit(0.0), lambda a, x: a + x * x)), 5).alias("norm"))


@query(" SELECT g.gene, 'O' || c.droplet_idx AS droplet, count FROM c JOIN g ON g.gene_idx = c.gene_idx WHERE count > 0")
def read_10x(spark, sf):
    """The counts written as a directory of MatrixMarket and name files, and read back."""
    x, path = orders(spark, sf), new_path(spark, "10x")
    tenx.write_10x(x.counts, x.genes.select("gene_idx", "gene"), x.droplets.select("droplet_idx", "droplet"), path)
    counts, genes, droplets = tenx.read_10x(spark, path)
    return counts.join(genes, "gene_idx").join(droplets, "droplet_idx").select("gene", "droplet", "count")


@query()
def kmeans_init(spark, sf):
    return clustering.init(components(spark, sf), k_init=4).labels


@query()
def hclust_init(spark, sf):
    return clustering.init(components(spark, sf), k_init=4, use="hclust", n_sample=500).labels


@query()
def full_chain(spark, sf):
    """From counts to calls: variable genes, components, clusters, mixture, score, call."""
    x = clustering.init(components(spark, sf), k_init=4)
    x = mixture.assign_clusters(mixture.run_em(x, max_iter=20))
    x = scoring.call_targets(scoring.estimate_dbr_score(x, thresh_genes=0), min_genes=3)
    return x.test_data().select("droplet", "Cluster", "score_debris", "Call")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Quality control end to end: aggregates, split, gene filter, percentage, the test droplets."""
    x = split(spark, sf)
    return qc.droplet_data(qc.gene_percent(x, qc.genes_like(x, "^brand#1"), "pct"))


