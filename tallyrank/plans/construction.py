"""Queries on splits, pseudo-tasks, benchmark construction, selectors and the small relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.metrics import ratio, spearman
from ..operators import benchmark as b
from ..operators import modality
from ..operators import protocol as pro
from ..operators import splits as s
from .detection import DIMS, PTS, VEC, points, vectors
from .tables import FACT, TRUTH, fact, r, rounded, table, truth

QUERIES: dict = {}
#: Two-sided p of a standard normal by the power series of its density, as far as the tests here go.
NORMAL_P = "1 - 2 * exp(-{0} * {0} / 2) / sqrt(2 * pi()) * list_reduce(list_prepend([abs({0}), abs({0})], list_transform(range(1, 61), lambda i: [i::DOUBLE, 0])), lambda a, b: [a[1] * {0} * {0} / (2 * b[1] + 1), a[2] + a[1] * {0} * {0} / (2 * b[1] + 1)])[2]"


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = (lambda spark, d: rounded(f(spark, d)), sql)
        return f

    return keep


def rows(spark, d):
    """Customers: nation as dataset, negative balance as anomaly."""
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).cast("int").alias("y"), F.col("c_acctbal").alias("x"))


ROWS = "rw AS (SELECT c_nationkey AS g, c_custkey AS id, (c_acctbal < 0)::INT AS y, c_acctbal AS x FROM customer)"
HASHED = f"{ROWS}, hk AS (SELECT *, row_number() OVER (PARTITION BY g, y ORDER BY md5(concat_ws(':', 0, id))) AS k, count(*) OVER (PARTITION BY g, y) AS n FROM rw)"
THREE = f"{HASHED}, th AS (SELECT g, id, y, CASE WHEN y = 1 THEN 'test' WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS role FROM hk)"

query("split_80_20", f"WITH {HASHED} SELECT g, id, y, CASE WHEN y = 0 AND k <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS role FROM hk")(lambda sp, d: s.two_way(rows(sp, d).drop("x"), ["g"], "id", "y"))
query("split_60_20_20", f"WITH {THREE} SELECT * FROM th")(lambda sp, d: s.three_way(rows(sp, d).drop("x"), ["g"], "id", "y"))
query(
    "cap_test_rate",
    f"""WITH {THREE}, q AS (SELECT *, row_number() OVER (PARTITION BY g, y ORDER BY md5(concat_ws(':', 1000, id))) AS k, sum((y = 0)::INT) OVER (PARTITION BY g) AS m FROM th WHERE role = 'test')
SELECT g, id, y, role FROM q WHERE y = 0 OR k <= floor(0.25 * m / 0.75)""",
)(lambda sp, d: s.capped(s.three_way(rows(sp, d).drop("x"), ["g"], "id", "y"), ["g"], "id", "y"))
query(
    "min_size_gates",
    f"""WITH {THREE}, q AS (SELECT g, {", ".join(f"count(*) FILTER (WHERE role = '{x}' AND y = 0) AS n_{x}" for x in ("train", "val", "test"))} FROM th GROUP BY g)
SELECT * FROM q WHERE n_train >= 30 AND n_val >= 10 AND n_test >= 10""",
)(lambda sp, d: s.large_enough(s.three_way(rows(sp, d).drop("x"), ["g"], "id", "y"), ["g"], "y", 30, 10, 10))
query("hash_sample", f"WITH {ROWS} SELECT g, id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(concat_ws(':', 5, id))) AS k FROM rw) WHERE k <= 7")(lambda sp, d: s.sample(rows(sp, d), ["g"], "id", 7, 5).select("g", "id"))
query("even_sample", "WITH q AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation) SELECT DISTINCT n_name FROM q, (SELECT unnest(range(0, 7)) AS j) WHERE i = floor(j * (n - 1) / 6)")(
    lambda sp, d: s.evenly_spaced(table(sp, d, "nation"), "n_nationkey", 7).select("n_name")
)


def clusters(spark, d):
    """Segments of a nation as clusters."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("dataset"), F.col("c_mktsegment").alias("cluster"))
    return c.agg(F.count("*").alias("size"), F.max("c_custkey").alias("far_component"), F.min("c_custkey").alias("composite"))


CLUSTERS = "cl AS (SELECT c_nationkey AS dataset, c_mktsegment AS cluster, count(*) AS size, max(c_custkey) AS far_component, min(c_custkey) AS composite FROM customer GROUP BY ALL)"
for _how, _by in (("smallest", "size"), ("hard", "far_component")):
    query(
        f"candidates_{_how}",
        f"WITH {CLUSTERS} SELECT dataset, cluster FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {_by}, cluster) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM cl) WHERE k <= greatest(2, floor(n / 2))",
    )(lambda sp, d, how=_how: s.candidates(clusters(sp, d), how).select("dataset", "cluster"))
query("candidates_top", f"WITH {CLUSTERS} SELECT dataset, cluster FROM (SELECT *, quantile_cont(composite, 0.75) OVER (PARTITION BY dataset) AS c FROM cl) WHERE composite >= c")(lambda sp, d: s.candidates(clusters(sp, d), "top").select("dataset", "cluster"))
query(
    "subset_draws",
    f"""WITH {CLUSTERS}, z AS (SELECT dataset, sum(size) AS n FROM cl GROUP BY ALL), o AS (SELECT cl.*, n, draw, coalesce(sum(size) OVER (PARTITION BY cl.dataset, draw ORDER BY md5(concat_ws(':', 0, draw, cluster)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM cl JOIN z USING (dataset), (SELECT unnest(range(0, 6)) AS draw))
SELECT dataset, draw, cluster FROM o WHERE before < greatest(20, floor(n * 0.05))""",
)(lambda sp, d: s.draws(clusters(sp, d), clusters(sp, d).groupBy("dataset").agg(F.sum("size").alias("n")), 6).withColumn("draw", F.col("draw").cast("long")))
query(
    "normal_holdout",
    f"""WITH {ROWS}, q AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY md5(concat_ws(':', 2, id))) AS k, count(*) OVER (PARTITION BY g) AS n FROM rw WHERE y = 0)
SELECT g, id, CASE WHEN k <= least(greatest(50, floor(n * 0.2)), floor(n / 3)) THEN 'pnorm' ELSE 'train' END AS role FROM q""",
)(lambda sp, d: s.holdout(rows(sp, d).where("y = 0").select("g", "id"), ["g"], "id", 2))
query("regime_bank", "SELECT how, k, how || '_K' || k AS regime, n_nationkey AS dataset FROM nation, (SELECT unnest(['smallest', 'random', 'hard']) AS how), (SELECT unnest([30, 50]) AS k)")(
    lambda sp, d: sp.createDataFrame([(h, k, f"{h}_K{k}") for h in ("smallest", "random", "hard") for k in (30, 50)], "how string, k int, regime string").join(table(sp, d, "nation").select(F.col("n_nationkey").alias("dataset")))
)
query(
    "global_tail",
    f"""WITH {ROWS}, p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x DESC, id) AS k, count(*) OVER (PARTITION BY g) AS n FROM rw),
q AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(concat_ws(':', 4, id))) AS h FROM p WHERE k <= greatest(floor(n * 0.25), 2 * floor(n * 0.05) + 10)) SELECT g, id FROM q WHERE h <= floor(n * 0.05)""",
)(lambda sp, d: s.global_tail(rows(sp, d), ["g"], "id", "x", 4).select("g", "id"))
query(
    "marginal_tail",
    f"""WITH {PTS}, pk AS (SELECT dim FROM (SELECT DISTINCT dim FROM pts) ORDER BY md5(concat_ws(':', 6, dim)) LIMIT 1), o AS (SELECT id, x FROM pts JOIN pk USING (dim)),
c AS (SELECT quantile_cont(x, 0.05) AS a, quantile_cont(x, 0.95) AS z, count(*) AS n FROM o), t AS (SELECT id, n, count(*) OVER () AS m FROM o, c
  WHERE CASE WHEN ('0x' || md5('6:side')[1:8])::BIGINT / 4294967296.0::DOUBLE < 0.5 THEN x <= a ELSE x >= z END) SELECT id FROM t WHERE m >= 5 AND 2 * m <= n""",
)(lambda sp, d: s.marginal_tail(points(sp, d), 6))
query("edge_pseudo", f"WITH {ROWS} SELECT g, id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x DESC, id) AS k, count(*) OVER (PARTITION BY g) AS n FROM rw) WHERE k <= greatest(10, floor(n * 0.05))")(
    lambda sp, d: s.edge(rows(sp, d), ["g"], "id", "x").select("g", "id")
)
query(
    "contaminated_train",
    f"""WITH {ROWS}, q AS (SELECT *, row_number() OVER (PARTITION BY g, y ORDER BY md5(concat_ws(':', 0, id))) AS k, sum((y = 0)::INT) OVER (PARTITION BY g) AS m FROM rw) SELECT g, id, y FROM q WHERE y = 0 OR k <= round(0.05 * m)""",
)(lambda sp, d: s.contaminated(rows(sp, d), ["g"], "id", "y", 0.05).select("g", "id", "y"))
_U = "('0x' || md5(concat_ws(':', 0, '{}', id))[1:8])::BIGINT / 4294967296.0::DOUBLE"
_NUMBERED = "ids AS (SELECT id, row_number() OVER (ORDER BY md5(id::VARCHAR)[1:2], id) - 1 AS n, count(*) OVER () AS m FROM vec)"
query(
    "gen_shuffle",
    f"""WITH {PTS}, {_NUMBERED}, dn AS (SELECT a.id, z.id AS donor, 1 + floor({_U.format("k").replace("id)", "a.id)")} * {int(0.6 * DIMS)}) AS k FROM ids a JOIN ids z ON z.n = floor({_U.format("donor").replace("id)", "a.id)")} * a.m)),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws(':', 0, id, dim))) AS h FROM pts)
SELECT q.id, q.dim, {r("CASE WHEN h <= k THEN o.x ELSE q.x END", "x")} FROM q JOIN dn ON dn.id = q.id JOIN pts o ON o.id = donor AND o.dim = q.dim""",
)(lambda sp, d: s.shuffled_features(points(sp, d)).withColumn("dim", F.col("dim").cast("long")))
_EACH = "('0x' || md5(concat_ws(':', 0, '{}', q.id, q.dim))[1:8])::BIGINT / 4294967296.0::DOUBLE"
query(
    "gen_shuffle_blend",
    f"""WITH {PTS}, {_NUMBERED}, q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws(':', 0, id, dim))) AS h FROM pts),
w AS (SELECT q.*, z.id AS donor, 0.3 + 0.7 * {_U.format("alpha").replace("id)", "q.id)")} AS a FROM q JOIN ids z ON z.n = floor({_EACH.format("donor")} * z.m))
SELECT w.id, w.dim, {r(f"CASE WHEN h <= {int(0.15 * DIMS)} THEN (1 - a) * w.x + a * o.x ELSE w.x END", "x")} FROM w JOIN pts o ON o.id = donor AND o.dim = w.dim""",
)(lambda sp, d: s.shuffled_features(points(sp, d), count="few", source="each", alpha=None).withColumn("dim", F.col("dim").cast("long")))
query(
    "gen_resample",
    f"""WITH {PTS}, ed AS (SELECT dim, min(x) AS lo, (max(x) - min(x)) / 30 AS width, count(*) AS m, quantile_cont(x, [0.02, 0.98]) AS q FROM pts GROUP BY dim),
c AS (SELECT dim, greatest(0, least(29, floor((x - lo) / width))) AS bin, any_value(lo) AS lo, any_value(width) AS width, any_value(q) AS q, count(*) / any_value(m) AS s FROM pts JOIN ed USING (dim) GROUP BY ALL),
w AS (SELECT dim, lo + bin * width AS f, width, sum(greatest(s, 1e-6)) OVER (PARTITION BY dim ORDER BY bin) / sum(greatest(s, 1e-6)) OVER (PARTITION BY dim) AS p, bin FROM c WHERE lo + (bin + 0.5) * width BETWEEN q[1] AND q[2]),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws(':', 0, id, dim))) AS h FROM pts),
k AS (SELECT q.id, q.dim, min_by(f, bin) AS f, min_by(width, bin) AS width FROM q JOIN w ON w.dim = q.dim AND p > {_EACH.format("bin")} GROUP BY q.id, q.dim)
SELECT q.id, q.dim, {r(f"CASE WHEN h <= {int(0.4 * DIMS)} THEN f + {_EACH.format('within')} * width ELSE x END", "x")} FROM q JOIN k ON k.id = q.id AND k.dim = q.dim""",
)(lambda sp, d: s.resampled_features(points(sp, d), 1.0).withColumn("dim", F.col("dim").cast("long")))
query(
    "near_centre_clusters",
    f"WITH {CLUSTERS} SELECT dataset, cluster FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY composite, cluster) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM cl) WHERE k <= greatest(2, floor(n / 2))",
)(lambda sp, d: s.near_centre(clusters(sp, d).withColumn("to_centre", F.col("composite")), "hard").select("dataset", "cluster"))
for _channel in ("small", "embedded", "edge"):
    _own = {"small": "true", "embedded": "far <= f", "edge": "far > f"}[_channel]
    query(
        f"over_clustered_{_channel}",
        f"""WITH {CLUSTERS}, q AS (SELECT dataset, cluster, size, far_component AS far, quantile_cont(size, 0.33) OVER (PARTITION BY dataset) AS s, quantile_cont(far_component, 0.5) OVER (PARTITION BY dataset) AS f FROM cl),
k AS (SELECT *, max(({_own})::INT) OVER (PARTITION BY dataset) AS any_own FROM q WHERE size <= greatest(3, s)) SELECT dataset, cluster FROM k WHERE {_own}{" OR any_own = 0" if _channel == "embedded" else ""}""",
    )(lambda sp, d, c=_channel: s.over_clustered(clusters(sp, d).withColumn("far", F.col("far_component")), c).select("dataset", "cluster"))

# construction ----------------------------------------------------------------------------------

KEYS = ["l_quantity", "l_discount", "l_tax"]
query("dedup_label_conflict", "SELECT l_quantity, l_discount, l_tax, min(l_orderkey) AS l_orderkey, min(l_linenumber) AS l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_quantity, l_discount, l_tax HAVING min(l_linenumber) = max(l_linenumber)")(
    lambda sp, d: b.drop_conflicts(table(sp, d, "lineitem"), KEYS, "l_orderkey", "l_linenumber")
)
query("distinct_best", "SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) WHERE k = 1")(
    lambda sp, d: b.best_per(table(sp, d, "part"), "p_brand", F.col("p_size").desc(), F.col("p_partkey")).select("p_brand", "p_partkey", "p_size")
)
query("plain_names", r"SELECT s_suppkey, lower(regexp_replace(regexp_replace(regexp_replace(s_suppkey || '_' || s_name || '.csv', '\.[A-Za-z0-9]+$', ''), '^[0-9]+_', ''), '[_-]', '', 'g')) AS name FROM supplier")(
    lambda sp, d: table(sp, d, "supplier").select("s_suppkey", b.plain_name(F.concat(F.col("s_suppkey").cast("string"), F.lit("_"), F.col("s_name"), F.lit(".csv"))).alias("name"))
)
query(
    "fingerprints",
    f"""WITH {PTS}, p AS (SELECT label, dim, avg(x) AS mu, stddev_pop(x) AS sd FROM pts GROUP BY ALL)
SELECT label, concat_ws('|', count(*), sha1(array_to_string(list_sort(list(round(mu * 1000)::BIGINT)), ',')), sha1(array_to_string(list_sort(list(round(sd * 1000)::BIGINT)), ','))) AS fp FROM p GROUP BY label""",
)(lambda sp, d: b.fingerprint(points(sp, d).join(vectors(sp, d).select("id", "label"), "id"), "label"))
query(
    "cross_corpus_dedup",
    """WITH q AS (SELECT p_name AS name, p_brand || '/' || p_partkey AS corpus, CASE WHEN p_size > 1 THEN p_size // 8 END AS fp FROM part)
SELECT name, corpus, fp, CASE WHEN count(fp) OVER w = count(*) OVER w AND min(fp) OVER w = max(fp) OVER w THEN name ELSE name || ':' || corpus END AS dedup_group FROM q WINDOW w AS (PARTITION BY name)""",
)(
    lambda sp, d: b.same_across(
        table(sp, d, "part").select(F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("corpus"), F.when(F.col("p_size") > 1, F.floor(F.col("p_size") / 8).cast("int")).alias("fp")), "name", "fp"
    )
)
query(
    "double_hard",
    f"""WITH {ROWS}, t AS (SELECT g, unnest([95.0, 99.0, 99.5])::DOUBLE AS percentile, unnest(quantile_cont(a, [0.95, 0.99, 0.995])) AS cut FROM (SELECT g, abs(x - 4500) AS a FROM rw WHERE y = 0) GROUP BY g)
SELECT rw.g, percentile, count(*) FILTER (WHERE abs(x - 4500) <= cut) AS n_hard FROM rw JOIN t ON t.g = rw.g WHERE y = 1 GROUP BY ALL""".replace(
        "SELECT g, unnest([95.0, 99.0, 99.5])::DOUBLE AS percentile, unnest(quantile_cont(a, [0.95, 0.99, 0.995])) AS cut FROM (SELECT g, abs(x - 4500) AS a FROM rw WHERE y = 0) GROUP BY g",
        "SELECT g, unnest([95.0, 99.0, 99.5])::DOUBLE AS percentile, unnest(q) AS cut FROM (SELECT g, quantile_cont(abs(x - 4500), [0.95, 0.99, 0.995]) AS q FROM rw WHERE y = 0 GROUP BY g)",
    ),
)(lambda sp, d: b.double_hard(rows(sp, d).withColumn("a", F.abs(F.col("x") - 4500)), ["g"], "a", "y", [95.0, 99.0, 99.5]))


def panel(spark, d):
    """(dataset, variant, truth, em, mv, consensus): criteria are the means of the three regimes."""
    p = fact(spark, d).groupBy("dataset", "detector").pivot("regime", ["r0", "r1", "r2"]).agg(F.avg("pseudo_auc")).na.fill(0.0)
    return p.join(truth(spark, d), ["dataset", "detector"]).select("dataset", F.col("detector").alias("variant"), F.col("true_auc").alias("truth"), F.col("r0").alias("em"), F.col("r1").alias("mv"), F.col("r2").alias("consensus"))


PANEL = f"{FACT}, {TRUTH}, pn AS (SELECT dataset, detector AS variant, any_value(true_auc) AS truth, " + ", ".join(f"coalesce(avg(pseudo_auc) FILTER (WHERE regime = 'r{i}'), 0) AS {n}" for i, n in enumerate(("em", "mv", "consensus"))) + " FROM fact JOIN truth USING (dataset, detector) GROUP BY ALL)"
query(
    "zone_include",
    f"""WITH {PANEL}, m AS (SELECT dataset, count(*) AS n_variants, max(mv) AS base_rate, max(em) AS best, avg(em) AS mean, min(em) AS worst, max(consensus) AS rule_auc,
  arg_max(variant, em) AS gt_best, string_agg(variant, '|' ORDER BY em DESC, variant) AS gt_ranking FROM pn GROUP BY dataset),
z AS (SELECT *, best - mean AS spread, CASE WHEN best < 0.1 THEN 'floor' WHEN best - mean < 0.1 THEN 'low_spread' ELSE 'live' END AS zone FROM m)
SELECT dataset, n_variants, {", ".join(r(c) for c in ("base_rate", "best", "mean", "worst", "rule_auc", "spread"))}, split_part(gt_ranking, '|', 1) AS gt_best, gt_ranking, zone,
  zone = 'live' AND base_rate <= 0.25 AND NOT coalesce(rule_auc > 0.85, false) AS include FROM z""",
)(lambda sp, d: b.manifest(panel(sp, d).select("dataset", "variant", F.col("em").alias("ap_norm"), F.col("mv").alias("base_rate"), F.col("consensus").alias("rule_auc"))))
SELECTORS = {"oracle": "truth", "anti_oracle": "-truth", "global_fixed": "g", "em": "em", "mv": "-mv", "consensus": "consensus"}
PICKS = f"""{PANEL}, gl AS (SELECT variant, avg(truth) AS g FROM pn GROUP BY variant), pg AS (SELECT pn.*, g, max(truth) OVER (PARTITION BY dataset) AS best, count(*) OVER (PARTITION BY dataset) AS n,
  row_number() OVER (PARTITION BY dataset ORDER BY truth DESC, variant) - 1 AS pos FROM pn JOIN gl USING (variant)),
pk AS ({" UNION ALL ".join(f"SELECT '{k}' AS selector, dataset, best - truth AS regret, CASE WHEN n > 1 THEN pos / (n - 1) END AS rank_pos FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {v} DESC, variant) AS k FROM pg) WHERE k = 1" for k, v in SELECTORS.items())}
  UNION ALL SELECT 'random', dataset, max(truth) - avg(truth), 0.5 FROM pn GROUP BY dataset)"""
query("selector_table", f"WITH {PICKS} SELECT selector, dataset, {r('regret')}, {r('rank_pos')} FROM pk")(lambda sp, d: b.selectors(panel(sp, d)))
query(
    "selector_invariants",
    f"""WITH {PICKS}, m AS (SELECT selector, avg(regret) AS m FROM pk GROUP BY selector), o AS (SELECT max(m) FILTER (WHERE selector = 'oracle') AS o, max(m) FILTER (WHERE selector = 'anti_oracle') AS a, max(m) AS w,
  max(m) FILTER (WHERE selector = 'global_fixed') AS g, max(m) FILTER (WHERE selector = 'random') AS r FROM m)
SELECT 'oracle_zero' AS "check", (o = 0)::INT AS holds FROM o UNION ALL SELECT 'anti_worst', (a >= w)::INT FROM o UNION ALL SELECT 'global_not_above_random', (g <= r)::INT FROM o""",
)(lambda sp, d: b.invariants(b.selectors(panel(sp, d))))
query(
    "leaderboard",
    f"""WITH {PICKS}, f AS (SELECT selector, n_regionkey AS family, avg(regret) AS m, sum(regret) AS s, count(*) AS n FROM pk JOIN nation ON n_nationkey = dataset GROUP BY ALL)
SELECT selector, {r("sum(s) / sum(n)", "micro")}, {r("avg(m)", "macro")} FROM f GROUP BY selector""",
)(lambda sp, d: b.leaderboard(b.selectors(panel(sp, d)), table(sp, d, "nation").select(F.col("n_nationkey").alias("dataset"), F.col("n_regionkey").alias("family"))))
query(
    "matched_router",
    f"""WITH {PANEL}, q AS (SELECT dataset, variant, row_number() OVER (PARTITION BY dataset ORDER BY em DESC, variant) AS k1, row_number() OVER (PARTITION BY dataset ORDER BY consensus DESC, variant) AS k4,
  max(em) OVER (PARTITION BY dataset) - max(consensus) OVER (PARTITION BY dataset) > -0.14 AS f FROM pn) SELECT dataset, variant FROM q WHERE CASE WHEN f THEN k1 = 1 ELSE k4 = 1 END""",
)(lambda sp, d: b.routed(panel(sp, d).select("dataset", "variant", F.col("em").alias("a1"), F.col("consensus").alias("a4"))))
_FAM = "CASE WHEN variant IN ('BUILDING', 'HOUSEHOLD') THEN 'local' ELSE 'global' END"
query(
    "family_hybrid",
    f"""WITH {PANEL}, f AS (SELECT *, {_FAM} AS family FROM pn), t AS (SELECT dataset, family FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY em DESC, variant) AS k FROM f) WHERE k = 1)
SELECT dataset, variant FROM (SELECT f.*, row_number() OVER (PARTITION BY dataset ORDER BY consensus DESC, variant) AS k FROM f JOIN t USING (dataset, family)) WHERE k = 1""",
)(lambda sp, d: b.family_hybrid(panel(sp, d).withColumnRenamed("consensus", "synth"), F.expr(_FAM)))
query(
    "wilcoxon_stat",
    f"""WITH {PANEL}, q AS (SELECT variant, em - mv AS x FROM pn WHERE em <> mv), k AS (SELECT *, rank() OVER (PARTITION BY variant ORDER BY abs(x)) + (count(*) OVER (PARTITION BY variant, abs(x)) - 1) / 2 AS rk, count(*) OVER (PARTITION BY variant, abs(x)) AS t FROM q),
a AS (SELECT variant, count(*) AS n, sum(CASE WHEN x > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN x < 0 THEN rk ELSE 0 END) AS wm, sum(t * t - 1) AS ties FROM k GROUP BY variant)
SELECT variant, n, {r("wp", "w_plus")}, {r("wm", "w_minus")}, {r("(wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)", "z")} FROM a""",
)(lambda sp, d: stats.wilcoxon(panel(sp, d).select("variant", (F.col("em") - F.col("mv")).alias("x")), ["variant"], "x"))
for _mono in (True, False):
    query(
        "holm" if _mono else "holm_stepwise",
        "WITH q AS (SELECT p_brand AS test, count(*) / 100000 AS p FROM part GROUP BY ALL), k AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1)) AS h, row_number() OVER (ORDER BY p, test) AS k FROM q)"
        + f" SELECT test, {r('p')}, {r('max(h) OVER (ORDER BY k)' if _mono else 'h', 'p_holm')} FROM k",
    )(lambda sp, d, m=_mono: stats.holm(table(sp, d, "part").groupBy(F.col("p_brand").alias("test")).agg((F.count("*") / 100000.0).alias("p")), "p", m, "test"))
query("greedy_cover", None)(lambda sp, d: b.effective_count(vectors(sp, d).where("train").select("id", "v"), vectors(sp, d).where("not train").select(F.col("label").alias("dataset"), "id", "v")))
query("two_stage_hardening", None)(lambda sp, d: b.two_stage_hardening(vectors(sp, d).select("id", "train", (F.col("label") != 0).alias("normal"), "v")))


query(
    "double_hard_both",
    None,
)(lambda sp, d: b.both_hard(vectors(sp, d).select("id", (F.col("label") != 0).alias("train"), "v", (F.col("label") == 0).cast("int").alias("y")), [95.0, 99.0, 99.5]))


def candidates(sp, d):
    """Brands as candidate datasets."""
    p = table(sp, d, "part").groupBy(F.col("p_brand").alias("dataset"))
    return p.agg((F.avg((F.col("p_size") > 45).cast("int")) * 8).alias("frac_triv"), (F.count("*") * 10).alias("n_norm"), F.sum("p_size").alias("n_eff"), F.max("p_size").cast("string").alias("fp"))


STAGED = """cd AS (SELECT p_brand AS dataset, avg((p_size > 45)::INT) * 8 AS frac_triv, count(*) * 10 AS n_norm, sum(p_size) AS n_eff, max(p_size)::VARCHAR AS fp FROM part GROUP BY p_brand),
s1 AS (SELECT * FROM cd WHERE frac_triv < 0.9), s2 AS (SELECT * FROM s1 WHERE n_norm >= 500), s3 AS (SELECT * FROM s2 WHERE n_eff >= 100), s4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY n_eff DESC, dataset) AS k FROM s3) WHERE k = 1)"""
query("staged_set", f"WITH {STAGED} SELECT dataset, n_eff::BIGINT AS n_eff, fp FROM s4")(lambda sp, d: b.staged(candidates(sp, d), normals=500)[0].select("dataset", F.col("n_eff").cast("long").alias("n_eff"), "fp"))
query(
    "staged_counts",
    f"WITH {STAGED} SELECT '0 candidates' AS stage, count(*) AS n FROM cd UNION ALL SELECT '1 not trivial', count(*) FROM s1 UNION ALL SELECT '2 normals', count(*) FROM s2 UNION ALL SELECT '3 hard anomalies', count(*) FROM s3 UNION ALL SELECT '4 fingerprints', count(*) FROM s4",
)(lambda sp, d: b.staged(candidates(sp, d), normals=500)[1])


def included(sp, d):
    m = b.manifest(panel(sp, d).select("dataset", "variant", F.col("em").alias("ap_norm"), (F.col("mv") / 4).alias("base_rate"), F.col("consensus").alias("rule_auc")))
    return m.select("dataset", "base_rate", "spread", "zone", "best", "gt_best")


_LOCAL = "CASE WHEN {} IN ('BUILDING', 'HOUSEHOLD') THEN 'local' ELSE 'global' END"
query(
    "benchmark_audit",
    f"""WITH {PANEL}, m AS (SELECT dataset, max(mv) / 4 AS rate, max(em) AS best, max(em) - avg(em) AS spread, split_part(string_agg(variant, '|' ORDER BY em DESC, variant), '|', 1) AS w FROM pn GROUP BY dataset),
i AS (SELECT *, {_LOCAL.format("w")} AS family FROM m), o AS (SELECT max(rate) AS rate, min(spread) AS spread, min((best >= 0.1 AND spread >= 0.1)::INT) AS live, min(best) AS best, count(DISTINCT w) AS winners FROM i),
t AS (SELECT max(n) / sum(n) AS top FROM (SELECT w, count(*) AS n FROM i GROUP BY w)), g AS (SELECT max(n) / sum(n) AS largest, count(*) FILTER (WHERE n > 0.05 * tot) AS active FROM (SELECT family, count(*) AS n, sum(count(*)) OVER () AS tot FROM i GROUP BY family))
{" UNION ALL ".join(f'SELECT {chr(39)}{n}{chr(39)} AS "check", ({c})::INT AS holds FROM o, t, g' for n, c in {"base_rate_within_cap": "rate <= 0.2501", "spread_everywhere": "spread >= 0.1", "all_live": "live = 1", "best_above_base_rate": "best > 0", "no_winner_over_40_percent": "top <= 0.4", "twelve_winners": "winners >= 12", "no_family_over_75_percent": "largest <= 0.75", "two_families_win": "active >= 2"}.items())}""",
)(lambda sp, d: b.audit(included(sp, d), F.expr(_LOCAL.format("gt_best"))))
query(
    "refilter_effect",
    f"""WITH {PICKS}, ru AS (SELECT dataset, max(consensus) AS rule FROM pn GROUP BY dataset), k AS (SELECT pk.*, NOT coalesce(rule > 0.55, false) AS keep FROM pk JOIN ru USING (dataset))
SELECT selector, {r("avg(regret)", "before")}, {r("avg(regret) FILTER (WHERE keep)", "after")}, count(*) AS n_before, count(*) FILTER (WHERE keep) AS n_after FROM k GROUP BY selector""",
)(lambda sp, d: b.refiltered(panel(sp, d).select("dataset").distinct(), panel(sp, d).groupBy("dataset").agg(F.max("consensus").alias("rule_auc")), b.selectors(panel(sp, d)), 0.55))
query(
    "leaderboard_tests",
    f"""WITH {PICKS}, x AS (SELECT a.selector, b.selector AS against, round(b.regret - a.regret, 12) AS x FROM pk a JOIN pk b ON a.dataset = b.dataset AND b.selector IN ('em', 'mv') AND a.selector <> b.selector),
k AS (SELECT *, rank() OVER (PARTITION BY selector, against ORDER BY abs(x)) + (count(*) OVER (PARTITION BY selector, against, abs(x)) - 1) / 2 AS rk, count(*) OVER (PARTITION BY selector, against, abs(x)) AS t FROM x WHERE x <> 0),
a AS (SELECT selector, against, count(*) AS n, sum(CASE WHEN x > 0 THEN rk ELSE 0 END) AS wp, sum(t * t - 1) AS ties FROM k GROUP BY ALL),
z AS (SELECT p.selector, p.against, coalesce(n, 0) AS n, (wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM (SELECT DISTINCT selector, against FROM x) p LEFT JOIN a USING (selector, against)),
e AS (SELECT selector, against, count(*) AS m, list((2 * rk)::INT) AS l, sum(CASE WHEN x > 0 THEN (2 * rk)::INT ELSE 0 END) AS w FROM k GROUP BY ALL HAVING count(*) <= {stats.EXACT}),
f AS (SELECT *, list_sum(l) AS s, list_reduce(list_prepend(list_transform(range(0, list_sum(l)::BIGINT + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0 END), list_transform(l, lambda q: [q::DOUBLE])),
  lambda a, q: list_transform(range(0, len(a)), lambda i: a[i + 1] + CASE WHEN i >= q[1] THEN a[(i - q[1])::BIGINT + 1] ELSE 0 END)) AS ways FROM e)
SELECT z.selector, z.against, n, {r("z")}, {r(NORMAL_P.format("z"), "p")}, {r("least(1, 2 * list_sum(ways[1:(least(w, s - w) + 1)::BIGINT]) / power(2, m))", "p_exact")} FROM z LEFT JOIN f ON f.selector = z.selector AND f.against = z.against""",
)(lambda sp, d: b.leaderboard_tests(b.selectors(panel(sp, d))))
query(
    "selector_forest",
    f"""WITH {PANEL}, v AS (SELECT dataset, truth, replace(replace(variant, 'BUILDING', 'IForest'), 'MACHINERY', 'IF_2') AS variant FROM pn), g AS (SELECT *, max(truth) OVER p AS best, count(*) OVER p AS n, row_number() OVER (PARTITION BY dataset ORDER BY truth DESC, variant) - 1 AS pos FROM v WINDOW p AS (PARTITION BY dataset))
SELECT 'iforest_random' AS selector, dataset, {r("max(best) - avg(truth)", "regret")}, {r("avg(pos / (n - 1))", "rank_pos")} FROM g WHERE variant IN ('IForest', 'IF_2') GROUP BY dataset""",
)(lambda sp, d: b.selectors(panel(sp, d).withColumn("variant", F.replace(F.replace("variant", F.lit("BUILDING"), F.lit("IForest")), F.lit("MACHINERY"), F.lit("IF_2")))).where("selector = 'iforest_random'"))
query("panel_names", "SELECT unnest(['centroid', 'hbos', 'ecod', 'copod', 'severity', 'pca', 'iforest', 'loda', 'cblof', 'linear_residual']) AS detector")(
    lambda sp, d: sp.createDataFrame([(n,) for n in pro.panel(leave_out=["maxz", "knn", "knn_mean", "lof"])], "detector string")
)
query(
    "cluster_geometry_baseline",
    f"""WITH {TRUTH}, k AS (SELECT dataset, count(*) AS n, max(true_auc) > min(true_auc) AS spread FROM truth GROUP BY dataset) SELECT dataset, n, CASE WHEN n < 3 THEN 'n<3' WHEN NOT spread THEN 'true_all_tied' ELSE 'pred_all_tied' END AS note, NULL::DOUBLE AS rho FROM k""",
)(lambda sp, d: _baseline(sp, d))


def _baseline(sp, d):
    """The same score for every detector: its rank correlation is noted as all tied."""
    labelled = points(sp, d).join(vectors(sp, d).select("id", F.col("label").alias("cluster")), "id")
    names = [row["detector"] for row in truth(sp, d).select("detector").distinct().collect()]  # the panel
    return spearman(truth(sp, d).join(pro.cluster_geometry_baseline(labelled, tuple(sorted(names))), "detector"), ["dataset"], "true_auc", "score")


query("deep_cluster_gate", f"WITH {VEC} SELECT id, id % 7 AS cluster FROM vec")(lambda sp, d: pro.fallback_labels(vectors(sp, d).select("id", (F.col("id") % 2).alias("cluster")), vectors(sp, d).select("id", (F.col("id") % 7).alias("cluster"))))
query(
    "two_channels",
    f"WITH {FACT}, p AS (SELECT detector, avg(pseudo_auc) FILTER (WHERE regime = 'r0') AS a, avg(pseudo_auc) FILTER (WHERE regime = 'r1' AND detector <> 'BUILDING') AS b FROM fact GROUP BY detector) SELECT detector, {r('coalesce(0.6 * a + 0.4 * b, a, b)', 'auc')} FROM p",
)(lambda sp, d: s.two_channels(*(fact(sp, d).where(c).groupBy("detector").agg(F.avg("pseudo_auc").alias("auc")) for c in ("regime = 'r0'", "regime = 'r1' and detector <> 'BUILDING'")), 0.6))

# small relational operators --------------------------------------------------------------------

query("eligible_datasets", "SELECT c_nationkey AS dataset, count(*) AS n, round(avg((c_acctbal < 0)::INT), 9) AS rate FROM customer GROUP BY ALL HAVING count(*) BETWEEN 55 AND 50000 AND avg((c_acctbal < 0)::INT) BETWEEN 0.005 AND 0.35")(
    lambda sp, d: rows(sp, d).groupBy(F.col("g").alias("dataset")).agg(F.count("*").alias("n"), F.avg("y").alias("rate")).where("n BETWEEN 55 AND 50000 AND rate BETWEEN 0.005 AND 0.35")
)
query("drop_reasons", "SELECT CASE WHEN p_name LIKE 'small%' THEN 'too_small' WHEN regexp_matches(p_name, 'ring|widget') THEN 'trivial' WHEN p_size < 5 THEN 'few_rows' ELSE 'scored' END AS reason, count(*) AS n FROM part GROUP BY ALL")(
    lambda sp, d: table(sp, d, "part")
    .groupBy(F.when(F.col("p_name").startswith("small"), "too_small").when(F.col("p_name").rlike("ring|widget"), "trivial").when(F.col("p_size") < 5, "few_rows").otherwise("scored").alias("reason"))
    .agg(F.count("*").alias("n"))
)
query("round_half_even", "SELECT p_partkey, round_even(p_size / 4, 0)::DOUBLE AS v FROM part")(lambda sp, d: table(sp, d, "part").select("p_partkey", F.bround(F.col("p_size") / F.lit(4.0), 0).alias("v")))
query("semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")(
    lambda sp, d: table(sp, d, "orders").join(table(sp, d, "customer").where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
)
query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")(
    lambda sp, d: table(sp, d, "customer").join(table(sp, d, "orders").where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")
)
query("ragged_union", "SELECT s_suppkey AS id, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")(
    lambda sp, d: table(sp, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")).unionByName(table(sp, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)
)
query("set_difference", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")(
    lambda sp, d: table(sp, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).subtract(table(sp, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))
)
query(
    "aligned_sum",
    f"WITH {FACT} SELECT dataset, {r('sum(a) + sum(b)', 'total')} FROM (SELECT dataset, pseudo_auc AS a, 0 AS b FROM fact WHERE regime = 'r0' UNION ALL SELECT dataset, 0, pseudo_auc FROM fact WHERE regime = 'r1') GROUP BY dataset",
)(lambda sp, d: fact(sp, d).where("regime in ('r0', 'r1')").groupBy("dataset").agg(F.sum("pseudo_auc").alias("total")))
query("paired_join", f"WITH {FACT}, p AS (SELECT dataset, detector, regime, avg(pseudo_auc) AS m FROM fact GROUP BY ALL) SELECT a.dataset, a.detector, {r('a.m - b.m', 'diff')} FROM p a JOIN p b ON a.dataset = b.dataset AND a.detector = b.detector AND a.regime = 'r0' AND b.regime = 'r2'")(
    lambda sp, d: _paired(fact(sp, d))
)


def _paired(f):
    m = f.groupBy("dataset", "detector", "regime").agg(F.avg("pseudo_auc").alias("m"))
    one, two = m.where("regime = 'r0'"), m.where("regime = 'r2'").select("dataset", "detector", F.col("m").alias("m2"))
    return one.join(two, ["dataset", "detector"]).select("dataset", "detector", (F.col("m") - F.col("m2")).alias("diff"))


query("resume_cells", "SELECT DISTINCT c_nationkey AS dataset, c_mktsegment AS detector FROM customer EXCEPT SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 97 = 0")(
    lambda sp, d: b.unfinished(*(t.select(F.col("c_nationkey").alias("dataset"), F.col("c_mktsegment").alias("detector")).distinct() for t in (table(sp, d, "customer"), table(sp, d, "customer").where("c_custkey % 97 = 0"))), ["dataset", "detector"])
)
query("json_payload", """SELECT event_id, (props ->> '$.k')::BIGINT AS k, '{"k":' || (props ->> '$.k') || '}' AS again FROM events""")(
    lambda sp, d: table(sp, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("again"))
)
query(
    "bimodality",
    f"""WITH {PTS}, m AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM pts GROUP BY dim), z AS (SELECT dim, avg(power((x - mu) / sd, 3)) AS g, avg(power((x - mu) / sd, 4)) AS k, count(*)::DOUBLE AS n FROM pts JOIN m USING (dim) WHERE sd >= 1e-9 GROUP BY dim),
b AS (SELECT dim, (g * g + 1) / (k - 3 + 3 * (n - 1) * (n - 1) / greatest((n - 2) * (n - 3), 1)) AS c FROM z) SELECT dim, {r("c", "coefficient")}, {r("avg((c > 0.555)::INT) OVER ()", "share_over")} FROM b""",
)(lambda sp, d: _bimodal(points(sp, d)))


def _bimodal(p):
    """Sarle's coefficient per dimension, and the share of the dims over that of a uniform."""
    own = modality.sarle(p).select(F.col("dim").cast("long").alias("dim"), "coefficient")
    return own.join(F.broadcast(own.agg(F.avg((F.col("coefficient") > modality.UNIFORM).cast("double")).alias("share_over"))))  # one row


query("modality_panel", None)(lambda sp, d: modality.panel(vectors(sp, d).select("id", "v")))
