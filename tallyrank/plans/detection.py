"""Queries on detectors and label-free criteria over the embeddings: class 0 is the anomaly, four fifths of the rest train."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import anomaly_percentile, roc_auc, spearman
from ..functions.ranks import hash_unit
from ..functions.scratch import stored
from ..operators import aggregate, schemes
from ..operators import benchmark as bench
from ..operators import detectors as det
from ..operators import geometry as geo
from ..operators import protocol as pro
from .tables import r, rounded, table

QUERIES: dict = {}
DIMS = 64  # of each embedding


def vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("id"), ((F.col("label") != 0) & (F.col("vec_id") % 5 != 0)).alias("train"), v.alias("v"), F.col("label"))


def points(spark, d) -> DataFrame:
    return det.long_form(vectors(spark, d))


VEC = "vec AS (SELECT vec_id AS id, label, label <> 0 AND vec_id % 5 <> 0 AS train, embedding AS v FROM embeddings)"
PTS = f"{VEC}, pts AS (SELECT id, label, train, unnest(range(0, {DIMS})) AS dim, unnest(v)::DOUBLE AS x FROM vec)"
STATS = f"st AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi, count(*) AS m, quantile_cont(x, [0.01, 0.99, {0.005 / DIMS}, {1 - 0.005 / DIMS}]) AS q FROM pts WHERE train GROUP BY dim)"


def _hist(bins: int) -> str:
    return f"""bn AS (SELECT p.*, m, greatest(0, least({bins - 1}, floor((x - lo) / (hi - lo) * {bins})::INT)) AS bin, lo, hi FROM pts p JOIN st USING (dim) WHERE hi > lo),
dn AS (SELECT dim, bin, count(*) / (any_value(m) * any_value(hi - lo) / {bins}) AS density, count(*) / any_value(m) AS share FROM bn WHERE train GROUP BY dim, bin),
hd AS (SELECT bn.*, coalesce(density, 0) AS density, coalesce(share, 0) AS share FROM bn LEFT JOIN dn USING (dim, bin))"""


TAILS = """tr AS (SELECT dim, x FROM pts WHERE train), sk AS (SELECT dim, sign(sum(power(x - mu, 3))) AS skew FROM tr JOIN st USING (dim) GROUP BY dim),
tl AS (SELECT p.id, p.dim, p.x, skew, (SELECT count(*) FROM tr WHERE tr.dim = p.dim AND tr.x <= p.x) / m AS le, 0.5 / m AS half, greatest((SELECT count(*) FROM tr WHERE tr.dim = p.dim AND tr.x <= p.x) / m, 0.5 / m) AS l,
  greatest((SELECT count(*) FROM tr WHERE tr.dim = p.dim AND tr.x >= p.x) / m, 0.5 / m) AS r FROM pts p JOIN st USING (dim) JOIN sk USING (dim))"""
SURPRISE = f"{PTS}, {STATS}, {TAILS}, {_hist(30)}, su AS (SELECT hd.id, hd.dim, -ln(greatest(2 * least(le, 1 - le), half)) AS tail, -ln(share + 1e-9) AS own, hd.x < lo OR hd.x > hi OR share = 0 AS outside FROM hd JOIN tl ON tl.id = hd.id AND tl.dim = hd.dim)"
NEAR = f"""nd AS (SELECT a.id, b.id AS other, sqrt(list_sum(list_transform(range(1, {DIMS + 1}), lambda i: power(a.v[i]::DOUBLE - b.v[i]::DOUBLE, 2)))) AS distance FROM vec a JOIN vec b ON b.train AND a.id <> b.id),
nk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS k FROM nd)"""
S = {
    "maxz": f"WITH {PTS}, {STATS} SELECT id, max(abs((x - mu) / (sd + 1e-9))) AS score FROM pts JOIN st USING (dim) GROUP BY id",
    "centroid": f"WITH {PTS}, {STATS} SELECT id, sqrt(sum(power(x - mu, 2))) AS score FROM pts JOIN st USING (dim) GROUP BY id",
    "hbos": f"WITH {PTS}, {STATS}, {_hist(20)} SELECT id, sum(-log2(density + 1e-9)) AS score FROM hd GROUP BY id",
    "ecod": f"WITH {PTS}, {STATS}, {TAILS} SELECT id, greatest(sum(-ln(l)), sum(-ln(r)), sum(CASE WHEN skew < 0 THEN -ln(l) ELSE -ln(r) END)) AS score FROM tl GROUP BY id",
    "copod": f"WITH {PTS}, {STATS}, {TAILS} SELECT id, sum(greatest(CASE WHEN skew < 0 THEN -ln(l) WHEN skew > 0 THEN -ln(r) ELSE -ln(l) - ln(r) END, (-ln(l) - ln(r)) / 2)) AS score FROM tl GROUP BY id",
    "severity": f"WITH {SURPRISE} SELECT id, greatest(max(greatest(tail, own)), 0) AS score FROM su GROUP BY id",
    "edge_severity": f"WITH {SURPRISE} SELECT id, greatest(max(tail), 0) AS score FROM su GROUP BY id",
    "histogram_severity": f"WITH {SURPRISE} SELECT id, greatest(max(own), 0) AS score FROM su GROUP BY id",
    "knn": f"WITH {VEC}, {NEAR} SELECT id, distance AS score FROM nk WHERE k = 5",
    "knn_mean": f"WITH {VEC}, {NEAR} SELECT id, avg(distance) AS score FROM nk WHERE k <= 10 GROUP BY id",
    "lof": f"""WITH {VEC}, {NEAR}, kd AS (SELECT id AS other, distance AS kd FROM nk WHERE k = 10),
      ld AS (SELECT id, 1 / (avg(greatest(distance, kd)) + 1e-10) AS lrd FROM nk JOIN kd USING (other) WHERE k <= 10 GROUP BY id)
      SELECT nk.id, avg(o.lrd / s.lrd) AS score FROM nk JOIN ld o ON o.id = nk.other JOIN ld s ON s.id = nk.id WHERE k <= 10 GROUP BY nk.id""",
}
LONG = pro.LONG | {"edge_severity": det.edge_severity, "histogram_severity": det.histogram_severity}
WIDE = {"knn": det.knn, "knn_mean": det.knn_mean, "lof": det.lof}
PANEL = list(pro.PANEL)


def scores(spark, d, names=PANEL) -> DataFrame:
    """(detector, id, score) of several detectors."""
    p = points(spark, d)
    return reduce(DataFrame.union, [LONG[n](p).select(F.lit(n).alias("detector"), "id", F.round("score", 9).alias("score")) for n in names])


SCORES = "sc AS (" + " UNION ALL ".join(f"SELECT '{n}' AS detector, id, round(score, 9) AS score FROM ({S[n]})" for n in PANEL) + ")"


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = (lambda spark, d: rounded(f(spark, d), 6), sql.replace(", 9) + 0.0", ", 6) + 0.0") if sql else None)
        return f

    return keep


for _n in LONG:
    query(f"detect_{_n}", f"SELECT id, {r('score')} FROM ({S[_n]})")(lambda spark, d, n=_n: LONG[n](points(spark, d)))
for _n in WIDE:
    query(f"detect_{_n}", f"SELECT id, {r('score')} FROM ({S[_n]})")(lambda spark, d, n=_n: WIDE[n](vectors(spark, d)))

query("standardise", f"WITH {PTS}, {STATS} SELECT id, dim, {r('(x - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END', 'x')} FROM pts JOIN st USING (dim)")(lambda spark, d: det.standardised(points(spark, d)).select("id", F.col("dim").cast("long").alias("dim"), "x"))
query(
    "or_rules",
    f"""WITH {PTS}, {STATS} SELECT id, max((x < lo OR x > hi)::INT) AS beyond_range, max((x < q[1] OR x > q[2])::INT) AS beyond_quantiles, max((x < q[3] OR x > q[4])::INT) AS beyond_bonferroni
FROM pts JOIN st USING (dim) GROUP BY id""",
)(lambda spark, d: det.outside_rules(points(spark, d)))
query("nearest_neighbours", f"WITH {VEC}, {NEAR} SELECT id, other, {r('distance')}, k AS rank FROM nk WHERE k <= 3")(lambda spark, d: det.nearest(vectors(spark, d), 3))
query(
    "detector_leaderboard",
    f"""WITH {SCORES}, k AS (SELECT sc.*, label = 0 AS y, rank() OVER (PARTITION BY detector ORDER BY score) + (count(*) OVER (PARTITION BY detector, score) - 1) / 2 AS rk
  FROM sc JOIN embeddings ON vec_id = id WHERE label = 0 OR vec_id % 5 = 0)
SELECT detector, {r("(sum(rk) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y))", "auc")} FROM k GROUP BY detector""",
)(lambda spark, d: roc_auc(scores(spark, d).join(vectors(spark, d).where("not train").select("id", (F.col("label") == 0).cast("int").alias("y")), "id"), ["detector"], "score", "y"))

RK = f"{SCORES}, rk AS (SELECT detector, id, rank() OVER (PARTITION BY detector ORDER BY score DESC) + (count(*) OVER (PARTITION BY detector, score) - 1) / 2 AS r FROM sc)"
query("model_centrality", f"WITH {RK}, pr AS (SELECT a.detector AS a, b.detector AS b, corr(a.r, b.r) AS rho FROM rk a JOIN rk b ON a.id = b.id AND a.detector <> b.detector GROUP BY ALL) SELECT a AS detector, {r('avg(rho)', 'centrality')} FROM pr GROUP BY a")(lambda spark, d: det.centrality(scores(spark, d)))
query("rank_agreement", f"WITH {RK} SELECT a.detector AS a, b.detector AS b, {r('corr(a.r, b.r)', 'rho')} FROM rk a JOIN rk b ON a.id = b.id AND a.detector <> b.detector GROUP BY ALL")(lambda spark, d: det.rank_agreement(scores(spark, d)))
query("consensus_udr", f"WITH {RK}, m AS (SELECT id, round(avg(r), 9) AS a FROM rk GROUP BY id), mr AS (SELECT id, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS m FROM m) SELECT detector, {r('corr(r, m)', 'consensus')} FROM rk JOIN mr USING (id) GROUP BY detector")(lambda spark, d: det.consensus(scores(spark, d)))
query(
    "consensus_z",
    f"""WITH {SCORES}, z AS (SELECT *, (score - avg(score) OVER p) / (stddev_pop(score) OVER p + 1e-12) AS z FROM sc WINDOW p AS (PARTITION BY detector)),
m AS (SELECT id, avg(z) AS m FROM z GROUP BY id), k AS (SELECT detector, rank() OVER (PARTITION BY detector ORDER BY score DESC) + (count(*) OVER (PARTITION BY detector, score) - 1) / 2 AS a,
  rank() OVER (PARTITION BY detector ORDER BY m DESC) + (count(*) OVER (PARTITION BY detector, m) - 1) / 2 AS b FROM sc JOIN m USING (id))
SELECT detector, {r("corr(a, b)", "consensus")} FROM k GROUP BY detector""",
)(lambda spark, d: det.z_consensus(scores(spark, d)))
query("hits_authority", None)(lambda spark, d: det.hits_authority(scores(spark, d)))

UNIFORM = 8000


def curves(spark, d) -> tuple[DataFrame, DataFrame]:
    """(detector, score) of rows and of points spread over their box by hash: the distance to the centroid of the training rows."""
    p = points(spark, d)
    box = p.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg(F.when(F.col("train"), F.col("x"))).alias("mu"))
    u = spark.range(UNIFORM).join(F.broadcast(box))  # one row a dimension
    x = F.col("lo") + hash_unit(F.lit(3), "id", "dim") * (F.col("hi") - F.col("lo"))
    u = u.select("id", (x - F.col("mu")).alias("e"))
    own = p.join(box, "dim").select("id", (F.col("x") - F.col("mu")).alias("e"))
    return tuple(t.groupBy("id").agg(F.round(F.sqrt(F.sum(F.col("e") * F.col("e"))), 9).alias("score")).select(F.lit("centroid").alias("detector"), "score") for t in (own, u))


CURVES = f"""{PTS}, bx AS (SELECT dim, min(x) AS lo, max(x) AS hi, avg(x) FILTER (WHERE train) AS mu FROM pts GROUP BY dim),
own AS (SELECT id, round(sqrt(sum(power(x - mu, 2))), 9) AS score FROM pts JOIN bx USING (dim) GROUP BY id),
un AS (SELECT id, round(sqrt(sum(power(lo + ('0x' || md5(concat_ws(':', 3, id, dim))[1:8])::BIGINT / 4294967296.0::DOUBLE * (hi - lo) - mu, 2))), 9) AS score FROM (SELECT unnest(range(0, {UNIFORM})) AS id), bx GROUP BY id)"""
STEPS = f"""{CURVES}, b AS (SELECT min(score) AS lo, max(score) AS hi FROM (SELECT score FROM own UNION ALL SELECT score FROM un)),
ow AS (SELECT ceil(round((score - lo) / (hi - lo) * 99, 9)) AS i, count(*) AS c FROM own, b GROUP BY ALL), uw AS (SELECT ceil(round((score - lo) / (hi - lo) * 99, 9)) AS i, count(*) AS c FROM un, b GROUP BY ALL),
c AS (SELECT i, (SELECT coalesce(sum(c), 0) FROM ow WHERE ow.i <= t.i) / (SELECT sum(c) FROM ow) AS mass, (SELECT coalesce(sum(c), 0) FROM uw WHERE uw.i <= t.i) / (SELECT sum(c) FROM uw) AS vol FROM (SELECT unnest(range(0, 100)) AS i) t),
e AS (SELECT lam, max(mass - lam * vol) AS em FROM c, (SELECT unnest(range(0, 100)) / 99 AS lam) GROUP BY lam)"""
query("em_curve", f"WITH {STEPS} SELECT 'centroid' AS detector, {r('lam')}, {r('em')} FROM e")(lambda spark, d: det.em_curve(*curves(spark, d)))
query(
    "em_mv",
    f"""WITH {STEPS}, el AS (SELECT lam, em, lead(lam) OVER (ORDER BY lam) AS lam1, lead(em) OVER (ORDER BY lam) AS em1 FROM e), g AS (SELECT j, 0.9 + j * (0.999 - 0.9) / 49 AS a FROM (SELECT unnest(range(0, 50)) AS j)),
k AS (SELECT row_number() OVER (ORDER BY mass, i) AS k, mass, vol FROM c), h AS (SELECT g.a, (SELECT count(*) FROM k WHERE mass <= g.a) AS n FROM g),
v AS (SELECT a, CASE WHEN n = 0 OR n = 100 OR z.mass = y.mass THEN y.vol ELSE y.vol + (z.vol - y.vol) / (z.mass - y.mass) * (a - y.mass) END AS v FROM h JOIN k y ON y.k = greatest(n, 1) JOIN k z ON z.k = least(n + 1, 100)),
vl AS (SELECT a, v, lead(a) OVER (ORDER BY a) AS a1, lead(v) OVER (ORDER BY a) AS v1 FROM v)
SELECT 'centroid' AS detector, {r("(SELECT sum((lam1 - lam) * (em + em1) / 2) FROM el)", "em")}, {r("(SELECT sum((a1 - a) * (v + v1) / 2) FROM vl)", "mv")}""",
)(lambda spark, d: det.em_mv(*curves(spark, d)))
query("goix_em_mv", None)(lambda spark, d: det.goix(*curves(spark, d)))
query(
    "mv_curve",
    f"""WITH {CURVES}, q AS (SELECT a AS alpha, (SELECT quantile_cont(-score, 0.1) FROM own) AS q1, (SELECT quantile_cont(-score, 0.05) FROM own) AS q2, (SELECT quantile_cont(-score, 0.01) FROM own) AS q3 FROM (SELECT unnest([0.9, 0.95, 0.99])::DOUBLE AS a)),
w AS (SELECT alpha, CASE alpha WHEN 0.9 THEN q1 WHEN 0.95 THEN q2 ELSE q3 END AS threshold FROM q)
SELECT alpha, {r("threshold")}, {r("avg((-score >= threshold)::INT)", "volume")} FROM w, un GROUP BY alpha, threshold""",
)(lambda spark, d: det.mv_curve(*(t.select((-F.col("score")).alias("score")) for t in curves(spark, d)), [0.9, 0.95, 0.99]))
query("support_rule", f"WITH {SURPRISE} SELECT id, count(*) FILTER (WHERE outside) AS n_outside, {r('greatest(max(CASE WHEN outside THEN 20.0 ELSE own END), 0)', 'score')} FROM su GROUP BY id")(lambda spark, d: det.support_rule(points(spark, d)))
query(
    "score_ensembles",
    f"""WITH {SCORES}, k AS (SELECT detector, id, (rank() OVER (PARTITION BY detector ORDER BY score) + (count(*) OVER (PARTITION BY detector, score) - 1) / 2) / count(*) OVER p AS s, (score - avg(score) OVER p) / (stddev_pop(score) OVER p + 1e-12) AS z FROM sc WINDOW p AS (PARTITION BY detector))
SELECT id, {r("avg(s)", "mean_rank")}, {r("max(s)", "max_rank")}, {r("avg(z)", "mean_z")}, {r("max(z)", "max_z")} FROM k GROUP BY id""",
)(lambda spark, d: pro.ensemble(scores(spark, d)))
query(
    "anomaly_percentile",
    f"""WITH {SCORES}, vi AS (SELECT vec_id AS id FROM embeddings WHERE label = 0 OR vec_id % 5 = 0), jt AS (SELECT detector, id, score FROM sc JOIN vi USING (id)), k AS (SELECT *, (rank() OVER (PARTITION BY detector ORDER BY score) - 1) * 100 / count(*) OVER (PARTITION BY detector) AS pct FROM jt)
SELECT detector, {r("quantile_cont(pct, 0.5)", "anom_pct")} FROM k JOIN embeddings ON vec_id = id WHERE label = 0 GROUP BY detector""",
)(lambda spark, d: anomaly_percentile(scores(spark, d).join(vectors(spark, d).where("not train").select("id", (F.col("label") == 0).cast("int").alias("y")), "id"), ["detector"], "score", "y"))


def roles(spark, d) -> DataFrame:
    """(id, role, y, v): normals in three parts by their key, the anomalies in the test."""
    part = F.col("id") % 5
    role = F.when(F.col("label") == 0, "test").when(part < 3, "train").when(part == 3, "val").otherwise("test")
    return vectors(spark, d).select("id", role.alias("role"), (F.col("label") == 0).cast("int").alias("y"), "v")


def _of(spark, d, role) -> DataFrame:
    return roles(spark, d).where(F.col("role") == role).select("id", "v")


query("evaluate_panel", None)(lambda spark, d: pro.evaluate(roles(spark, d)))
query("synthetic_auc", None)(lambda spark, d: pro.synthetic_auc(_of(spark, d, "train"), _of(spark, d, "val"), pro.shuffled(_of(spark, d, "val"))))
query("synthetic_auc_within", None)(lambda spark, d: pro.synthetic_auc_within(_of(spark, d, "val"), pro.shuffled(_of(spark, d, "val"))))


def _single(spark, d, role) -> DataFrame:
    return _of(spark, d, role).select(F.lit(0).alias("dataset"), "id", "v")


def _voted(spark, d) -> DataFrame:
    """The whole way: pseudo-tasks of the training rows, votes of the regimes, true AUC on the test rows, rank correlation and regret."""
    fact = stored(pro.pseudo_fact(_single(spark, d, "train")), "fact")
    scores_ = stored(pro.fit_scores(_of(spark, d, "train"), _of(spark, d, "test")), "panel-scores").withColumn("score", F.round("score", 9))
    truth = roc_auc(scores_.join(roles(spark, d).where("role = 'test'").select("id", "y"), "id"), ["detector"], "score", "y").select(F.lit(0).alias("dataset"), "detector", F.col("auc").alias("true_auc"))
    truth = stored(truth, "truth")
    ways = {"borda": aggregate.borda(fact), "variance_weighted": aggregate.variance_weighted(fact), "discriminative": schemes.voted(fact, schemes.discriminative)}
    out = None
    for name, pred in ways.items():
        pred = pred.select("dataset", "detector", "score")
        own = aggregate.regret(pred, truth).join(spearman(aggregate.with_truth(pred, truth), ["dataset"], "true_auc", "score"), "dataset").withColumn("way", F.lit(name))
        out = own if out is None else out.union(own)
    return out


query("pseudo_fact", None)(lambda spark, d: pro.pseudo_fact(_single(spark, d, "train")))
query("whole_selection", None)(_voted)
query("manifold_separability", None)(lambda spark, d: pro.manifold_separability(_single(spark, d, "train")).select("detector", "auc"))


def priorities(spark, d) -> DataFrame:
    """(dataset, id, role, y, v): orders by priority, five data sets; the dearest are the anomalies.

    v: price, and number, quantity, mean discount and greatest price of the lines. Normal rows are training, validation
    and test rows by hash, 60, 20 and 20 %; anomalies are test rows.
    """
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("s"), F.avg("l_discount").alias("a"), F.max("l_extendedprice").alias("m"))
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("b")).join(li, "id", "left").na.fill(0.0)
    y = (F.col("b") > 450000).cast("int")
    u = hash_unit(F.lit(0), F.lit("role"), "id")
    role = F.when((y == 1) | (u >= 0.8), "test").when(u < 0.6, "train").otherwise("val")
    return stored(o.select("dataset", "id", role.alias("role"), y.alias("y"), F.array(*(F.col(c).cast("double") for c in "bnsam")).alias("v")), "priorities")


def _part(rows: DataFrame, role: str, *more: str) -> DataFrame:
    return rows.where(F.col("role") == role).select("dataset", "id", "v", *more)


query("many_pseudo_fact", None)(lambda spark, d: pro.pseudo_fact(_part(priorities(spark, d), "train"), ("maxz", "centroid", "hbos", "pca")))
query("many_evaluate", None)(lambda spark, d: pro.evaluate_all(priorities(spark, d)))


def _selected(spark, d) -> DataFrame:
    """The selector table of real criteria: excess mass, mass volume, consensus, centrality, authority and separability of each data set."""
    facts = pro.evaluate_all(priorities(spark, d))
    kind = F.when(F.col("dataset").isin("1-URGENT", "2-HIGH"), "heavy").otherwise("light")
    return bench.selectors(stored(facts.select("dataset", F.col("detector").alias("variant"), F.col("ap_norm").alias("truth"), "em", "mv", "consensus", "centrality", "hits", "separability", kind.alias("modality")), "facts"))


query("many_selectors", None)(_selected)
query("rule_auc", None)(lambda spark, d: pro.rule_auc(priorities(spark, d)))
query("seed_stability", None)(lambda spark, d: pro.most_stable(*(lambda s: (_part(s, "train"), _part(s, "test"), _part(s, "test", "y")))(priorities(spark, d))))
query("random_forest_choice", None)(lambda spark, d: pro.random_forest_choice(*(lambda s: (_part(s, "train"), _part(s, "test"), _part(s, "test", "y")))(priorities(spark, d))))
query("knn_separability", None)(lambda spark, d: pro.separability(_of(spark, d, "train"), roles(spark, d).where("role = 'test' and y = 0").select("id", "v"), roles(spark, d).where("y = 1").select("id", "v")))


def _normal(spark, d) -> DataFrame:
    return vectors(spark, d).select("id", "train", "v")


query("gen_between", None)(
    lambda spark, d: geo.between_centres(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(True).alias("train"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("v")), band=(5, 99))
)
query("gen_displaced", None)(lambda spark, d: geo.displaced(_normal(spark, d)))
query("gen_off_clusters", None)(lambda spark, d: geo.off_clusters(_normal(spark, d), geo.displaced(_normal(spark, d))))
query("detect_reconstruction", None)(lambda spark, d: geo.reconstruction_error(_normal(spark, d)))
query("anomaly_geometry", None)(lambda spark, d: geo.anomaly_geometry(_normal(spark, d)))
query(
    "silhouette",
    f"""WITH {VEC}, p AS (SELECT a.id, a.label AS own, b.label AS other, sqrt(list_sum(list_transform(range(1, {DIMS + 1}), lambda i: power(a.v[i]::DOUBLE - b.v[i]::DOUBLE, 2)))) AS e FROM sm a JOIN sm b ON a.id <> b.id),
m AS (SELECT id, own, other, avg(e) AS e FROM p GROUP BY ALL), k AS (SELECT id, max(e) FILTER (WHERE own = other) AS a, min(e) FILTER (WHERE own <> other) AS b FROM m GROUP BY id)
SELECT {r("avg(coalesce((b - a) / greatest(a, b), 0))", "silhouette")} FROM k""".replace(", p AS (", ", sm AS (SELECT * FROM vec ORDER BY md5(concat_ws(':', 0, id)) LIMIT 1000), p AS (", 1),
)(lambda spark, d: geo.silhouette(vectors(spark, d).select("id", F.col("label").alias("cluster"), "v")))
query(
    "adjusted_rand",
    f"""WITH {VEC}, t AS (SELECT label AS a, id % 7 AS b, count(*) AS n FROM vec GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS m FROM t),
u AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM t GROUP BY a)), v AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM t GROUP BY b))
SELECT {r("(s.x - u.x * v.x / (m * (m - 1) / 2)) / ((u.x + v.x) / 2 - u.x * v.x / (m * (m - 1) / 2))", "ari")} FROM s, u, v""",
)(lambda spark, d: geo.adjusted_rand(vectors(spark, d).select(F.col("label").alias("a"), (F.col("id") % 7).alias("b"))))
query("mixture_bic", None)(lambda spark, d: geo.mixture_modes(det.pca_embed(_normal(spark, d), 8).select("id", F.col("z").alias("v")), 5))
query(
    "guarded_scores",
    f"""WITH {SCORES}, g AS (SELECT *, CASE WHEN detector = 'hbos' THEN 1.0::DOUBLE WHEN detector = 'ecod' AND id = 3 THEN 'NaN'::DOUBLE ELSE score END AS s FROM sc)
SELECT detector, id, {r("CASE WHEN max((NOT isfinite(s))::INT) OVER p = 0 AND stddev_pop(CASE WHEN isfinite(s) THEN s END) OVER p >= 1e-12 THEN s END", "score")} FROM g WINDOW p AS (PARTITION BY detector)""",
)(
    lambda spark, d: det.guarded(
        scores(spark, d).withColumn("score", F.when(F.col("detector") == "hbos", 1.0).when((F.col("detector") == "ecod") & (F.col("id") == 3), float("nan")).otherwise(F.col("score"))), ["detector"]
    )
)
query(
    "cluster_composite",
    f"""WITH {PTS}, ce AS (SELECT label AS c, dim, avg(x) AS m FROM pts GROUP BY ALL), gp AS (SELECT a.c AS a, b.c AS b, sqrt(sum(power(a.m - b.m, 2))) AS g FROM ce a JOIN ce b ON a.dim = b.dim AND a.c <> b.c GROUP BY ALL),
fr AS (SELECT a AS c, avg(g) AS far FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY g, b) AS k FROM gp) WHERE k <= 3 GROUP BY a),
sp AS (SELECT label AS c, id, sqrt(sum(power(x - m, 2))) AS e FROM pts JOIN ce ON c = label AND ce.dim = pts.dim GROUP BY ALL),
pc AS (SELECT c, count(*) AS size, avg(e) AS den, any_value(far) AS far FROM sp JOIN fr USING (c) GROUP BY c), sm AS (SELECT *, 1 - size / sum(size) OVER () AS sma FROM pc),
nm AS (SELECT c, size, (sma - min(sma) OVER ()) / (max(sma) OVER () - min(sma) OVER ()) AS s, (far - min(far) OVER ()) / (max(far) OVER () - min(far) OVER ()) AS f, (den - min(den) OVER ()) / (max(den) OVER () - min(den) OVER ()) AS e FROM sm)
SELECT c AS cluster, size, {r("s", "size_component")}, {r("f", "far_component")}, {r("e", "density_component")}, {r("(s + f + e) / 3", "composite")} FROM nm""",
)(lambda spark, d: det.cluster_composite(points(spark, d).join(vectors(spark, d).select("id", F.col("label").alias("cluster")), "id")))
for _n, _f in {
    "pca_score": det.pca_score, "linear_residual": det.linear_residual, "iforest": det.isolation_forest, "loda": det.loda, "cblof": det.cblof, "pca_embed": lambda v: det.pca_embed(v, 4),
    "pca_whitened": lambda v: det.pca_embed(v, 8, 0.95, True), "kmeans": lambda v: det.clusters(v, 8)[0],
}.items():
    query(f"detect_{_n}" if _n in ("pca_score", "linear_residual", "iforest", "loda", "cblof") else _n, None)(lambda spark, d, f=_f: f(vectors(spark, d)))
