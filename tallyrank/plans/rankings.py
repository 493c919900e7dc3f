"""Queries on ranks, metrics, aggregations and voting schemes, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.order import quantiles
from ..functions.ranks import avg_rank, pct_rank, row_order
from ..operators import aggregate, schemes
from .tables import FACT, MEANS, SCORED, TRUTH, fact, r, rounded, scored, table, truth

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = (lambda spark, d: rounded(f(spark, d)), sql)
        return f

    return keep


# ranks -----------------------------------------------------------------------------------------


@query("avg_rank_ties", f"WITH {SCORED} SELECT id, g, (rank() OVER (PARTITION BY g ORDER BY score DESC) + (count(*) OVER (PARTITION BY g, score) - 1) / 2)::DOUBLE AS rank FROM scored")
def _(spark, d):
    return scored(spark, d).select("id", "g", avg_rank("score", "g").alias("rank"))


@query("pct_rank", f"WITH {SCORED} SELECT id, {r('(rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2) / count(*) OVER (PARTITION BY g)', 'pct')} FROM scored")
def _(spark, d):
    return scored(spark, d).select("id", pct_rank("score", "g").alias("pct"))


@query("topk_per_group", f"WITH {SCORED} SELECT g, id, score FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS k FROM scored) WHERE k <= 5")
def _(spark, d):
    return scored(spark, d).withColumn("k", row_order(F.col("score").desc(), F.col("id"), groups=("g",))).where("k <= 5").select("g", "id", "score")


@query(
    "normalised_pick_rank",
    f"""WITH {FACT}, {TRUTH}, m AS (SELECT dataset, detector, avg(pseudo_auc) AS s FROM fact GROUP BY ALL),
j AS (SELECT dataset, detector, row_number() OVER (PARTITION BY dataset ORDER BY s DESC, detector) AS p,
             row_number() OVER (PARTITION BY dataset ORDER BY true_auc DESC, detector) AS t, count(*) OVER (PARTITION BY dataset) AS n FROM m JOIN truth USING (dataset, detector))
SELECT dataset, detector, {r("CASE WHEN n > 1 THEN (t - 1) / (n - 1) END", "pos")} FROM j WHERE p = 1""",
)
def _(spark, d):
    both = aggregate.with_truth(aggregate.mean_scores(fact(spark, d)), truth(spark, d))
    n = F.count("*").over(Window.partitionBy("dataset"))
    both = both.select("dataset", "detector", aggregate.best_first("score").alias("p"), aggregate.best_first("true_auc").alias("t"), n.alias("n"))
    return both.where("p = 1").select("dataset", "detector", metrics.ratio(F.col("t") - 1, F.col("n") - 1).alias("pos"))


# metrics ---------------------------------------------------------------------------------------


@query(
    "roc_auc_by_group",
    f"""WITH {SCORED}, k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2 AS rk FROM scored),
s AS (SELECT g, sum(rk * y) AS w, sum(y) AS p, count(*) - sum(y) AS n FROM k GROUP BY g)
SELECT g, {r("(w - p * (p + 1) / 2) / (p * n)", "auc")} FROM s""",
)
def _(spark, d):
    return metrics.roc_auc(scored(spark, d), ["g"], "score", "y")


CURVE = f"""{SCORED}, h AS (SELECT g, score, count(*) AS n, sum(y) AS p FROM scored GROUP BY ALL),
c AS (SELECT g, score, n, p, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp, sum(p) OVER (PARTITION BY g) AS pos, sum(n - p) OVER (PARTITION BY g) AS neg
      FROM h WINDOW w AS (PARTITION BY g ORDER BY score DESC)),
e AS (SELECT g, (fp - (n - p)) / neg AS f0, fp / neg AS f1, (tp - p) / pos AS t0, tp / pos AS t1 FROM c)"""


@query("pr_ap_by_group", f"WITH {CURVE}, a AS (SELECT g, sum(p / pos * tp / (tp + fp)) AS ap, any_value(pos / (pos + neg)) AS b FROM c GROUP BY g) SELECT g, {r('ap')}, {r('b', 'base_rate')}, {r('(ap - b) / (1 - b)', 'ap_norm')} FROM a")
def _(spark, d):
    return metrics.average_precision(scored(spark, d), ["g"], "score", "y")


@query(
    "pauc10",
    f"""WITH {CURVE}, x AS (SELECT g, f0, t0, least(f1, 0.1) AS fe, CASE WHEN f1 > f0 THEN t0 + (t1 - t0) * (least(f1, 0.1) - f0) / (f1 - f0) ELSE t0 END AS te FROM e WHERE f0 < 0.1)
SELECT g, {r("0.5 * (1 + (sum((fe - f0) * (t0 + te) / 2) - 0.005) / (0.1 - 0.005))", "pauc")} FROM x GROUP BY g""",
)
def _(spark, d):
    return metrics.partial_auc(scored(spark, d), ["g"], "score", "y")


@query("recall_at_fpr10", f"WITH {CURVE} SELECT g, {r('max(t0 + (t1 - t0) * (0.1 - f0) / (f1 - f0))', 'recall')} FROM e WHERE f0 <= 0.1 AND f1 > 0.1 GROUP BY g")
def _(spark, d):
    return metrics.recall_at_fpr(scored(spark, d), ["g"], "score", "y")


MEAN = "m AS (SELECT dataset, detector, avg(pseudo_auc) AS score FROM fact GROUP BY ALL)"
BOTH = f"{FACT}, {TRUTH}, {MEAN}, j AS (SELECT * FROM m JOIN truth USING (dataset, detector))"


@query(
    "spearman_by_group",
    f"""WITH {BOTH}, k AS (SELECT dataset, rank() OVER (PARTITION BY dataset ORDER BY true_auc DESC) + (count(*) OVER (PARTITION BY dataset, true_auc) - 1) / 2 AS a,
  rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2 AS b FROM j),
s AS (SELECT dataset, count(*) AS n, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab FROM k GROUP BY dataset),
t AS (SELECT *, CASE WHEN n < 3 THEN 'n<3' WHEN va = 0 THEN 'true_all_tied' WHEN vb = 0 THEN 'pred_all_tied' ELSE '' END AS note FROM s)
SELECT dataset, n, note, {r("CASE WHEN note = '' THEN ab / sqrt(va * vb) END", "rho")} FROM t""",
)
def _(spark, d):
    both = aggregate.with_truth(aggregate.mean_scores(fact(spark, d)), truth(spark, d))
    return metrics.spearman(both, ["dataset"], "true_auc", "score")


@query(
    "kendall_by_group",
    f"""WITH {BOTH}, p AS (SELECT a.dataset, sign(a.true_auc - b.true_auc) AS s, sign(a.score - b.score) AS t FROM j a JOIN j b ON a.dataset = b.dataset AND a.detector < b.detector),
q AS (SELECT dataset, sum(s * t) AS c, sum(abs(s)) AS x, sum(abs(t)) AS y FROM p GROUP BY dataset)
SELECT dataset, {r("CASE WHEN x * y > 0 THEN c / sqrt(x * y) END", "tau")} FROM q""",
)
def _(spark, d):
    both = aggregate.with_truth(aggregate.mean_scores(fact(spark, d)), truth(spark, d))
    return metrics.kendall(both, ["dataset"], "detector", "true_auc", "score")


PLACED = f"""{BOTH}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, detector) AS p, row_number() OVER (PARTITION BY dataset ORDER BY true_auc DESC, detector) AS t FROM j)"""


@query("hit_rates", f"WITH {PLACED} SELECT dataset, max((p = 1 AND t = 1)::INT) AS top1_hit, {r('count(*) FILTER (WHERE p <= 3 AND t <= 3) / 3', 'top3_hit_ratio')} FROM o GROUP BY dataset")
def _(spark, d):
    return aggregate.hits(aggregate.mean_scores(fact(spark, d)), truth(spark, d))


@query(
    "regret_top1_top3",
    f"""WITH {PLACED} SELECT dataset, {r("max(true_auc) - max(true_auc) FILTER (WHERE p = 1)", "regret1")}, {r("max(true_auc) - max(true_auc) FILTER (WHERE p <= 3)", "regret3")},
{r("max(true_auc) - avg(true_auc)", "random_regret")} FROM o GROUP BY dataset""",
)
def _(spark, d):
    return aggregate.regret(aggregate.mean_scores(fact(spark, d)), truth(spark, d))


# aggregations ----------------------------------------------------------------------------------


def _ranked_sql(name: str, score: str, source: str) -> str:
    return f"""WITH {FACT}, {source}
SELECT dataset, detector, '{name}' AS aggregation, {r(score, "score")}, (rank() OVER (PARTITION BY dataset ORDER BY {score} DESC) + (count(*) OVER (PARTITION BY dataset, {score}) - 1) / 2)::DOUBLE AS rank FROM z"""


query("mean_agg", _ranked_sql("mean", "v", "z AS (SELECT dataset, detector, avg(pseudo_auc) AS v FROM fact GROUP BY ALL)"))(lambda spark, d: aggregate.mean_scores(fact(spark, d)))
query(
    "borda_agg",
    _ranked_sql(
        "borda",
        "v",
        """k AS (SELECT *, rank() OVER (PARTITION BY dataset, regime, subset ORDER BY pseudo_auc DESC) + (count(*) OVER (PARTITION BY dataset, regime, subset, pseudo_auc) - 1) / 2 AS rk FROM fact),
z AS (SELECT dataset, detector, -avg(rk) AS v FROM k GROUP BY ALL)""",
    ),
)(lambda spark, d: aggregate.borda(fact(spark, d)))
query(
    "varweight_agg",
    _ranked_sql(
        "varweight",
        "v",
        """k AS (SELECT *, coalesce(var_samp(pseudo_auc) OVER (PARTITION BY dataset, regime, subset), 0) AS w FROM fact),
z AS (SELECT dataset, detector, CASE WHEN sum(w) < 1e-12 THEN avg(pseudo_auc) ELSE sum(w * pseudo_auc) / sum(w) END AS v FROM k GROUP BY ALL)""",
    ),
)(lambda spark, d: aggregate.variance_weighted(fact(spark, d)))


@query(
    "seed_mean_std",
    f"""WITH {FACT}, s AS (SELECT detector, subset, avg(pseudo_auc) AS m FROM fact GROUP BY ALL)
SELECT detector, {r("avg(m)", "mean")}, {r("stddev_samp(m)", "std_ddof1")}, {r("stddev_pop(m)", "std_ddof0")}, count(*) AS n_seeds FROM s GROUP BY detector""",
)
def _(spark, d):
    return aggregate.mean_and_spread(fact(spark, d), "pseudo_auc", ["detector"], "subset")


@query(
    "named_multi_agg",
    f"""WITH {FACT} SELECT regime, count(DISTINCT dataset) AS n_datasets, count(pseudo_auc) AS n_valid, {r("avg(pseudo_auc)", "mean_auc")}, {r("median(pseudo_auc)", "median_auc")},
{r("max(pseudo_auc) - min(pseudo_auc)", "spread")}, {r("max(pseudo_auc) - avg(pseudo_auc)", "best_minus_mean")} FROM fact GROUP BY regime""",
)
def _(spark, d):
    v = F.col("pseudo_auc")
    return fact(spark, d).groupBy("regime").agg(
        F.countDistinct("dataset").alias("n_datasets"), F.count(v).alias("n_valid"), F.avg(v).alias("mean_auc"), F.percentile(v, F.lit(0.5)).alias("median_auc"),
        (F.max(v) - F.min(v)).alias("spread"), (F.max(v) - F.avg(v)).alias("best_minus_mean"),
    )


@query("mode_smallest", "SELECT g, v AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, v) AS k FROM (SELECT p_brand AS g, p_size AS v, count(*) AS n FROM part GROUP BY ALL)) WHERE k = 1")
def _(spark, d):
    per = table(spark, d, "part").groupBy(F.col("p_brand").alias("g"), F.col("p_size").alias("v")).agg(F.count("*").alias("n"))
    return per.withColumn("k", row_order(F.col("n").desc(), F.col("v"), groups=("g",))).where("k = 1").select("g", F.col("v").alias("mode"), "n")


@query("value_share", f"SELECT l_returnflag AS value, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM lineitem GROUP BY ALL")
def _(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("value")).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row per distinct value


@query("quantile_vector", "SELECT g, unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS q, round(unnest(v), 9) AS v FROM (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS v FROM lineitem GROUP BY ALL)")
def _(spark, d):
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    at = F.array(*map(F.lit, qs))
    per = quantiles(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_extendedprice"), ["g"], "l_extendedprice", qs, "v")
    return per.select("g", F.explode(F.arrays_zip(at.alias("q"), F.col("v").alias("v"))).alias("z")).select("g", F.col("z.q").alias("q"), F.col("z.v").alias("v"))


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'rho')} FROM lineitem" for i, a in enumerate(CORR) for b in CORR[i + 1 :]))
def _(spark, d):
    li = table(spark, d, "lineitem")
    pairs = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1 :]]
    once = li.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return once.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("rho")) for i, (a, b) in enumerate(pairs)))).alias("z")).select("z.*")


@query(
    "argmax_top3",
    f"""WITH {TRUTH}, k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY true_auc DESC, detector) AS k FROM truth)
SELECT dataset, max(detector) FILTER (WHERE k = 1) AS best, max(detector) FILTER (WHERE k = 2) AS second, string_agg(detector, '|' ORDER BY k) FILTER (WHERE k <= 3) AS top3 FROM k GROUP BY dataset""",
)
def _(spark, d):
    order = F.sort_array(F.collect_list(F.struct((-F.col("true_auc")).alias("m"), "detector")))["detector"]
    per = truth(spark, d).groupBy("dataset").agg(order.alias("o"))
    return per.select("dataset", F.get("o", F.lit(0)).alias("best"), F.get("o", F.lit(1)).alias("second"), F.array_join(F.slice("o", 1, 3), "|").alias("top3"))


@query("pivot_regime", f"WITH {FACT} SELECT dataset, " + ", ".join(r(f"avg(pseudo_auc) FILTER (WHERE regime = '{g}')", g) for g in ("r0", "r1", "r2")) + " FROM fact GROUP BY dataset")
def _(spark, d):
    return fact(spark, d).groupBy("dataset").pivot("regime", ["r0", "r1", "r2"]).agg(F.avg("pseudo_auc"))


CATEGORY = "CASE WHEN o_totalprice < 50000 THEN 'ill_posed' WHEN o_orderstatus = 'F' THEN 'weighting_failure' WHEN o_totalprice > 400000 THEN 'flip' ELSE 'ok' END"


@query("crosstab_category", f"SELECT o_orderpriority AS g, " + ", ".join(f"count(*) FILTER (WHERE {CATEGORY} = '{c}') AS {c}" for c in ("ok", "ill_posed", "weighting_failure", "flip")) + " FROM orders GROUP BY ALL")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("category", F.expr(CATEGORY))
    return o.groupBy(F.col("o_orderpriority").alias("g")).pivot("category", ["ok", "ill_posed", "weighting_failure", "flip"]).count().na.fill(0)


@query(
    "quantile_threshold",
    f"""WITH {SCORED}, t AS (SELECT g, quantile_cont(score, 0.99) FILTER (WHERE y = 0) AS cut FROM scored GROUP BY g)
SELECT g, {r("cut")}, count(*) FILTER (WHERE y = 1 AND score > cut) AS caught, count(*) FILTER (WHERE y = 1) AS n FROM scored JOIN t USING (g) GROUP BY g, cut""",
)
def _(spark, d):
    s = scored(spark, d)
    cut = quantiles(s.where("y = 0"), ["g"], "score", [0.99]).select("g", F.get("q", F.lit(0)).alias("cut"))
    return s.join(cut, "g").groupBy("g", "cut").agg(F.count_if((F.col("y") == 1) & (F.col("score") > F.col("cut"))).alias("caught"), F.count_if(F.col("y") == 1).alias("n"))


@query("median_by_group", f"WITH {SCORED} SELECT id, {r('score - median(score) OVER (PARTITION BY g)', 'above')} FROM scored")
def _(spark, d):
    s = scored(spark, d)
    return s.join(quantiles(s, ["g"], "score", [0.5]), "g").select("id", (F.col("score") - F.get("q", F.lit(0))).alias("above"))


FUNNEL = {"entered": "true", "drop_small": "p_size < 5", "drop_cheap": "p_size >= 5 AND p_retailprice < 920", "scored": "p_size >= 5 AND p_retailprice >= 920", "included": "p_size >= 5 AND p_retailprice >= 920 AND p_size <= 45"}


@query("funnel", "SELECT p_brand AS corpus, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in FUNNEL.items()) + " FROM part GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("corpus")).agg(*(F.count_if(F.expr(c)).alias(n) for n, c in FUNNEL.items()))


@query(
    "figure_data",
    f"WITH {BOTH}, s AS (SELECT dataset, max(true_auc) - min(true_auc) AS spread FROM truth GROUP BY ALL) SELECT dataset, detector, {r('score', 'predicted')}, {r('true_auc')}, {r('spread')} FROM j JOIN s USING (dataset)",
)
def _(spark, d):
    t = truth(spark, d)
    spread = t.groupBy("dataset").agg((F.max("true_auc") - F.min("true_auc")).alias("spread"))
    both = aggregate.with_truth(aggregate.mean_scores(fact(spark, d)), t)
    return both.join(spread, "dataset").select("dataset", "detector", F.col("score").alias("predicted"), "true_auc", "spread")


FAMILY = "CASE WHEN detector IN ('BUILDING', 'HOUSEHOLD') THEN 'local' WHEN detector IN ('MACHINERY', 'AUTOMOBILE') THEN 'global' ELSE 'other' END"


@query("family_macro", f"WITH {FACT}, f AS (SELECT {FAMILY} AS family, avg(pseudo_auc) AS m FROM fact GROUP BY ALL) SELECT count(*) AS families, {r('avg(m)', 'macro')} FROM f")
def _(spark, d):
    per = fact(spark, d).groupBy(F.expr(FAMILY).alias("family")).agg(F.avg("pseudo_auc").alias("m"))
    return per.agg(F.count("*").alias("families"), F.avg("m").alias("macro"))


@query(
    "win_tie_loss",
    f"""WITH {FACT}, p AS (SELECT dataset, avg(pseudo_auc) FILTER (WHERE regime = 'r0') AS a, avg(pseudo_auc) FILTER (WHERE regime = 'r1') AS b FROM fact GROUP BY dataset)
SELECT count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a = b) AS ties, count(*) FILTER (WHERE a < b) AS losses FROM p""",
)
def _(spark, d):
    p = fact(spark, d).groupBy("dataset").pivot("regime", ["r0", "r1"]).agg(F.avg("pseudo_auc"))
    a, b = F.col("r0"), F.col("r1")
    return p.agg(F.count_if(a > b).alias("wins"), F.count_if(a == b).alias("ties"), F.count_if(a < b).alias("losses"))


@query("grouping_sets_overall", f"WITH {FACT} SELECT coalesce(regime, 'all') AS regime, detector, {r('avg(pseudo_auc)', 'mean_auc')}, count(*) AS n FROM fact GROUP BY GROUPING SETS ((regime, detector), (detector))")
def _(spark, d):
    fact(spark, d).createOrReplaceTempView("tallyrank_fact")
    return spark.sql("SELECT coalesce(regime, 'all') AS regime, detector, avg(pseudo_auc) AS mean_auc, count(*) AS n FROM tallyrank_fact GROUP BY GROUPING SETS ((regime, detector), (detector))")


@query(
    "drop_one_panel",
    f"""WITH {BOTH}, dr AS (SELECT DISTINCT detector AS dropped FROM j UNION ALL SELECT ''), x AS (SELECT * FROM j JOIN dr ON detector <> dropped)
SELECT dropped, {r("avg(reg)", "regret1")} FROM (SELECT dropped, dataset, max(true_auc) - arg_max(true_auc, score) AS reg FROM x GROUP BY ALL) GROUP BY dropped""",
)
def _(spark, d):
    both = aggregate.with_truth(aggregate.mean_scores(fact(spark, d)), truth(spark, d)).select("dataset", "detector", "score", "true_auc")
    panels = aggregate.drop_one(both)
    per = panels.groupBy("dropped", "dataset").agg((F.max("true_auc") - F.max_by("true_auc", "score")).alias("reg"))
    return per.groupBy("dropped").agg(F.avg("reg").alias("regret1"))


@query(
    "scrambled_control",
    f"""WITH {FACT}, a AS (SELECT dataset, detector, regime, subset, row_number() OVER (ORDER BY md5(concat_ws(':', dataset, detector, regime, subset))) AS n FROM fact),
b AS (SELECT pseudo_auc, row_number() OVER (ORDER BY md5(concat_ws(':', 7, dataset, detector, regime, subset))) AS n FROM fact)
SELECT dataset, detector, regime, subset, {r("pseudo_auc")} FROM a JOIN b USING (n)""",
)
def _(spark, d):
    return aggregate.scrambled(fact(spark, d), "pseudo_auc", ["dataset", "detector", "regime", "subset"], 7)


# voting schemes --------------------------------------------------------------------------------

RHO = """rk AS (SELECT a.dataset, a.regime AS r1, b.regime AS r2,
  rank() OVER (PARTITION BY a.dataset, a.regime, b.regime ORDER BY a.auc DESC) + (count(*) OVER (PARTITION BY a.dataset, a.regime, b.regime, a.auc) - 1) / 2 AS x,
  rank() OVER (PARTITION BY a.dataset, a.regime, b.regime ORDER BY b.auc DESC) + (count(*) OVER (PARTITION BY a.dataset, a.regime, b.regime, b.auc) - 1) / 2 AS y
  FROM means a JOIN means b ON a.dataset = b.dataset AND a.detector = b.detector AND a.regime <> b.regime),
rho AS (SELECT dataset, r1, r2, covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) AS rho FROM rk GROUP BY ALL HAVING count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0)"""
REG = "(SELECT DISTINCT dataset, regime FROM means)"
WEIGHTS = {
    "uniform": f"SELECT dataset, regime, 1.0::DOUBLE AS w FROM {REG}",
    "discriminative": "SELECT dataset, regime, coalesce(var_samp(auc), 0) AS w FROM means GROUP BY ALL",
    "stability": """SELECT dataset, regime, coalesce(1 / (avg(s) + 1e-6), 0) AS w FROM (SELECT dataset, regime, detector, stddev_samp(rk) AS s FROM (
      SELECT *, rank() OVER (PARTITION BY dataset, regime, subset ORDER BY pseudo_auc DESC) + (count(*) OVER (PARTITION BY dataset, regime, subset, pseudo_auc) - 1) / 2 AS rk FROM fact) GROUP BY ALL) GROUP BY ALL""",
    "margin": """SELECT dataset, regime, coalesce(max(auc) FILTER (WHERE k = 1) - max(auc) FILTER (WHERE k = 2), 0) AS w FROM (
      SELECT *, row_number() OVER (PARTITION BY dataset, regime ORDER BY auc DESC, detector) AS k FROM means) GROUP BY ALL""",
    "agreement": f"SELECT q.dataset, q.regime, greatest(coalesce(a.m, 0), 0) AS w FROM {REG} q LEFT JOIN (SELECT dataset, r1, round(avg(rho), 12) AS m FROM rho GROUP BY ALL) a ON a.dataset = q.dataset AND a.r1 = q.regime",
}
WEIGHTS["softmax_var"] = f"SELECT dataset, regime, exp((w - max(w) OVER (PARTITION BY dataset)) / 0.01) AS w FROM ({WEIGHTS['discriminative']})"
for _name, _a, _b in (("disc_x_stab", "discriminative", "stability"), ("disc_agree", "discriminative", "agreement")):
    WEIGHTS[_name] = f"SELECT dataset, regime, a.w * b.w AS w FROM ({WEIGHTS[_a]}) a JOIN ({WEIGHTS[_b]}) b USING (dataset, regime)"
for _name, _a in (("best_regime_var", "discriminative"), ("best_regime_agr", "agreement")):
    WEIGHTS[_name] = f"SELECT dataset, regime, (row_number() OVER (PARTITION BY dataset ORDER BY w DESC, regime) = 1)::INT::DOUBLE AS w FROM ({WEIGHTS[_a]})"


def _vote_sql(name: str, value: str = "vote") -> str:
    return f"""WITH {FACT}, {MEANS}, {RHO}, w0 AS ({WEIGHTS[name]}),
w1 AS (SELECT dataset, regime, CASE WHEN sum(w) OVER (PARTITION BY dataset) > 0 THEN w / sum(w) OVER (PARTITION BY dataset) ELSE 1 / count(*) OVER (PARTITION BY dataset) END AS w FROM w0),
zs AS (SELECT *, (auc - avg(auc) OVER p) / CASE WHEN stddev_samp(auc) OVER p > 0 THEN stddev_samp(auc) OVER p ELSE 1 END AS z FROM means WINDOW p AS (PARTITION BY dataset, regime))
SELECT dataset, detector, {r(f"sum(w * {value})", "score")} FROM zs JOIN w1 USING (dataset, regime) GROUP BY ALL"""


for _name, _scheme in schemes.SCHEMES.items():
    query(f"w_{_name}", _vote_sql(_name))(lambda spark, d, s=_scheme: schemes.voted(fact(spark, d), s))
for _name in ("discriminative", "uniform"):
    query(f"zscore_{_name}", _vote_sql(_name, "z"))(lambda spark, d, s=schemes.SCHEMES[_name]: schemes.zscore(fact(spark, d), s))


@query("single_regime", f"WITH {FACT}, {MEANS} SELECT dataset, detector, {r('sum(CASE WHEN regime = $$r1$$ THEN vote ELSE 0 END)', 'score')} FROM means WHERE dataset IN (SELECT dataset FROM means WHERE regime = 'r1') GROUP BY ALL".replace("$$", "'"))
def _(spark, d):
    f = fact(spark, d)
    has = f.where("regime = 'r1'").select("dataset").distinct()
    return schemes.voted(f.join(has, "dataset", "left_semi"), schemes.one_regime("r1"))


@query(
    "top1_vote",
    f"""WITH {FACT}, {MEANS}, k AS (SELECT *, row_number() OVER (PARTITION BY dataset, regime ORDER BY auc DESC, detector) = 1 AS won FROM means)
SELECT dataset, detector, {r("count(*) FILTER (WHERE won) * 1000 + sum(vote)", "score")} FROM k GROUP BY ALL""",
)
def _(spark, d):
    return schemes.top1_vote(fact(spark, d))


@query(
    "oracle_best_regime",
    f"""WITH {FACT}, {TRUTH}, {MEANS}, j AS (SELECT * FROM means JOIN truth USING (dataset, detector)),
g AS (SELECT dataset, regime, max(true_auc) - arg_max(true_auc, (auc, -ord)) AS reg FROM (SELECT *, rank() OVER (ORDER BY detector) AS ord FROM j) GROUP BY ALL)
SELECT dataset, {r("min(reg)", "oracle_regret")} FROM g GROUP BY dataset""",
)
def _(spark, d):
    per = schemes.regime_means(fact(spark, d)).select("dataset", "regime", "detector", F.col("auc").alias("score"))
    return aggregate.regret(per, truth(spark, d), ("regime",)).groupBy("dataset").agg(F.min("regret1").alias("oracle_regret"))


@query(
    "debias_mix",
    f"""WITH {FACT}, m AS (SELECT dataset, detector, avg(pseudo_auc) AS auc FROM fact GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY auc) + (count(*) OVER (PARTITION BY dataset, auc) - 1) / 2 AS v,
  (auc - avg(auc) OVER p) / CASE WHEN stddev_samp(auc) OVER p > 0 THEN stddev_samp(auc) OVER p ELSE 1 END AS z FROM m WINDOW p AS (PARTITION BY detector)),
e AS (SELECT *, min(v) OVER q AS v0, max(v) OVER q AS v1, min(z) OVER q AS z0, max(z) OVER q AS z1 FROM k WINDOW q AS (PARTITION BY dataset))
SELECT dataset, detector, {r("0.5 * CASE WHEN v1 > v0 THEN (v - v0) / (v1 - v0) ELSE 0 END + 0.5 * CASE WHEN z1 > z0 THEN (z - z0) / (z1 - z0) ELSE 0 END", "score")} FROM e""",
)
def _(spark, d):
    return schemes.debias_mix(fact(spark, d))


@query(
    "confidence_signals",
    f"""WITH {FACT}, {MEANS}, {RHO}, wn AS (SELECT dataset, detector, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY dataset, regime ORDER BY auc DESC, detector) AS k FROM means) WHERE k = 1 GROUP BY ALL),
ag AS (SELECT dataset, max(c) / sum(c) AS a FROM wn GROUP BY ALL),
nr AS (SELECT dataset, count(DISTINCT regime) AS n FROM means GROUP BY ALL),
vt AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY s DESC, detector) AS k FROM (SELECT dataset, detector, sum(vote) / any_value(n) AS s FROM means JOIN nr USING (dataset) GROUP BY ALL)),
gp AS (SELECT dataset, (max(s) FILTER (WHERE k = 1) - max(s) FILTER (WHERE k = 2)) / nullif(count(*) - 1, 0) AS g FROM vt GROUP BY ALL),
rh AS (SELECT dataset, avg(rho) AS m FROM rho WHERE r1 < r2 GROUP BY ALL)
SELECT dataset, {r("a", "top1_agree")}, {r("g", "rank_margin")}, {r("m", "mean_rho")} FROM ag JOIN gp USING (dataset) LEFT JOIN rh USING (dataset)""",
)
def _(spark, d):
    return schemes.confidence(fact(spark, d))


@query("left_out", f"WITH {TRUTH} SELECT dataset, detector, {r('true_auc')} FROM truth WHERE detector NOT IN ('BUILDING', 'MACHINERY')")
def _(spark, d):
    return truth(spark, d).where(~F.col("detector").isin("BUILDING", "MACHINERY"))
