"""Deterministic splits, samples and pseudo-tasks. Random order is hash order, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import quantiles
from ..functions.ranks import hash_order, hash_unit
from ..functions.scratch import stored


def place(groups: list[str], seed: int, *keys: str) -> Column:
    """Row number in hash order within the groups."""
    return F.row_number().over(Window.partitionBy(*groups).orderBy(hash_order(F.lit(seed), *keys)))


def two_way(df: DataFrame, groups: list[str], key: str, label: str, seed: int = 0) -> DataFrame:
    """Adds ``role``: four fifths of the normal rows train, the rest and all anomalies test."""
    w = Window.partitionBy(*groups, label)
    k, n = place([*groups, label], seed, key), F.count("*").over(w)
    return df.withColumn("role", F.when((F.col(label) == 0) & (k <= F.floor(n * 0.8)), "train").otherwise("test"))


def three_way(df: DataFrame, groups: list[str], key: str, label: str, seed: int = 0) -> DataFrame:
    """Adds ``role``: normal rows 60 % train, 20 % val, 20 % test; anomalies test."""
    w = Window.partitionBy(*groups, label)
    k, n = place([*groups, label], seed, key), F.count("*").over(w)
    role = F.when(F.col(label) == 1, "test").when(k <= F.floor(n * 0.6), "train").when(k <= F.floor(n * 0.8), "val").otherwise("test")
    return df.withColumn("role", role)


def capped(df: DataFrame, groups: list[str], key: str, label: str, seed: int = 0, rate: float = 0.25) -> DataFrame:
    """Test rows with anomalies limited, in hash order, so that they are at most ``rate`` of the test."""
    test = df.where("role = 'test'")
    normals = F.sum((F.col(label) == 0).cast("long")).over(Window.partitionBy(*groups))
    k = place([*groups, label], 1000 + seed, key)
    most = F.floor(rate * normals / (1 - rate))
    return test.withColumn("__k", k).withColumn("__m", most).where((F.col(label) == 0) | (F.col("__k") <= F.col("__m"))).drop("__k", "__m")


def large_enough(df: DataFrame, groups: list[str], label: str, train: int = 50, val: int = 20, test: int = 20) -> DataFrame:
    """Groups whose roles hold enough normal rows."""
    n = lambda role: F.count_if((F.col("role") == role) & (F.col(label) == 0))
    sizes = df.groupBy(*groups).agg(n("train").alias("n_train"), n("val").alias("n_val"), n("test").alias("n_test"))
    return sizes.where((F.col("n_train") >= train) & (F.col("n_val") >= val) & (F.col("n_test") >= test))


def sample(df: DataFrame, groups: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows a group, without replacement."""
    return df.withColumn("__k", place(groups, seed, key)).where(F.col("__k") <= n).drop("__k")


def evenly_spaced(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows at even steps of the sorted table, first and last among them."""
    w = Window.orderBy(order)  # over a list of datasets, not of rows
    numbered = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy()))
    at = numbered.sparkSession.range(k).select(F.col("id").alias("__j"))
    step = F.floor(F.col("__j") * (F.col("__n") - 1) / F.lit(float(max(1, k - 1))))
    return numbered.join(F.broadcast(at), F.col("__i") == step).drop("__i", "__n", "__j").distinct()


def candidates(clusters: DataFrame, how: str) -> DataFrame:
    """Clusters that may be held out: ``random`` all, ``smallest`` half, ``hard`` the half nearest to others, ``top`` quartile of composites.

    ``clusters``: (dataset, cluster, size, far_component, composite).
    """
    if how == "random":
        return clusters
    w = Window.partitionBy("dataset")
    if how == "top":
        cut = clusters.groupBy("dataset").agg(F.percentile("composite", F.lit(0.75)).alias("__c"))
        return clusters.join(cut, "dataset").where(F.col("composite") >= F.col("__c")).drop("__c")
    by = {"smallest": F.col("size"), "hard": F.col("far_component")}[how]
    k, n = F.row_number().over(w.orderBy(by, "cluster")), F.count("*").over(w)
    return clusters.withColumn("__k", k).withColumn("__m", F.greatest(F.lit(2), F.floor(n / 2))).where(F.col("__k") <= F.col("__m")).drop("__k", "__m")


def near_centre(clusters: DataFrame, how: str) -> DataFrame:
    """``candidates`` by another distance: ``hard`` is the half of the clusters whose centres lie nearest the centre of all rows.

    ``clusters``: (dataset, cluster, size, to_centre).
    """
    return candidates(clusters.withColumn("far_component", F.col("to_centre")), how).drop("far_component")


def over_clustered(clusters: DataFrame, channel: str, share: float = 0.33) -> DataFrame:
    """Small clusters (size up to that quantile, 3 at least) as pseudo-anomalies: ``small`` all, ``embedded`` those no farther from
    other centres than the median cluster (all where none is), ``edge`` those farther.

    ``clusters``: (dataset, cluster, size, far).
    """
    cut = clusters.groupBy("dataset").agg(F.percentile("size", F.lit(share)).alias("__q"), F.percentile("far", F.lit(0.5)).alias("__f"))
    small = clusters.join(cut, "dataset").where(F.col("size") <= F.greatest(F.lit(3.0), F.col("__q")))
    if channel != "small":
        own = (F.col("far") <= F.col("__f")) if channel == "embedded" else (F.col("far") > F.col("__f"))
        any_ = F.max(own.cast("int")).over(Window.partitionBy("dataset"))
        small = small.withColumn("__any", any_).where(own | ((F.col("__any") == 0) & F.lit(channel == "embedded"))).drop("__any")
    return small.drop("__q", "__f")


def two_channels(embedded: DataFrame, edge: DataFrame, weight: float = 0.5) -> DataFrame:
    """(detector, auc): weight * embedded + (1 - weight) * edge; of one channel alone if the other has none."""
    both = embedded.select("detector", F.col("auc").alias("a")).join(edge.select("detector", F.col("auc").alias("b")), "detector", "full")
    return both.select("detector", F.coalesce(weight * F.col("a") + (1 - weight) * F.col("b"), "a", "b").alias("auc"))


def draws(clusters: DataFrame, sizes: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """(dataset, draw, cluster): clusters in hash order until their rows reach max(20, 5 % of n), the crossing one included."""
    d = clusters.join(sizes, "dataset").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    order = Window.partitionBy("dataset", "draw").orderBy(hash_order(F.lit(seed), "draw", "cluster"))
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("__b", before).where(F.col("__b") < F.greatest(F.lit(20), F.floor(F.col("n") * 0.05))).select("dataset", "draw", "cluster")


def holdout(df: DataFrame, groups: list[str], key: str, seed: int = 0) -> DataFrame:
    """Adds ``role`` to normal rows: min(max(50, a fifth), a third) in hash order are ``pnorm``, the rest ``train``."""
    n = F.count("*").over(Window.partitionBy(*groups))
    most = F.least(F.greatest(F.lit(50), F.floor(n * 0.2)), F.floor(n / 3))
    return df.withColumn("role", F.when(place(groups, seed, key) <= most, "pnorm").otherwise("train"))


def global_tail(df: DataFrame, groups: list[str], key: str, far: str, seed: int = 0) -> DataFrame:
    """Pseudo-anomalies drawn in hash order from the rows farthest out: 5 % from the top max(quarter, twice 5 % plus 10)."""
    w = Window.partitionBy(*groups)
    n = F.count("*").over(w)
    five = F.floor(n * 0.05)
    pool = df.withColumn("__k", F.row_number().over(w.orderBy(F.col(far).desc(), key))).withColumn("__five", five).withColumn("__pool", F.greatest(F.floor(n * 0.25), 2 * five + 10))
    pool = pool.where(F.col("__k") <= F.col("__pool")).withColumn("__h", place(groups, seed, key))
    return pool.where(F.col("__h") <= F.col("__five")).drop("__k", "__five", "__pool", "__h")


def marginal_tail(points: DataFrame, seed: int, share: float = 0.05, least: int = 5) -> DataFrame:
    """(id): rows in one tail of one dimension, both chosen by hash; none if the tail is too small or over half.

    ``points``: long (id, dim, x).
    """
    dims = points.select("dim").distinct()
    pick = dims.orderBy(hash_order(F.lit(seed), "dim")).limit(1)
    side = hash_unit(F.lit(seed), F.lit("side")) < 0.5
    one = points.join(F.broadcast(pick), "dim")  # one row
    cut = quantiles(one, [], "x", [share, 1 - share]).join(F.broadcast(one.agg(F.count("*").alias("n"))))  # one row each
    tail = one.join(F.broadcast(cut)).where(F.when(side, F.col("x") <= F.get("q", F.lit(0))).otherwise(F.col("x") >= F.get("q", F.lit(1))))
    size = F.count("*").over(Window.partitionBy("dim"))
    return tail.withColumn("__s", size).where((F.col("__s") >= least) & (F.col("__s") * 2 <= F.col("n"))).select("id")


def edge(df: DataFrame, groups: list[str], key: str, far: str, share: float = 0.05) -> DataFrame:
    """The max(10, share) rows farthest from their own centre."""
    w = Window.partitionBy(*groups)
    k, n = F.row_number().over(w.orderBy(F.col(far).desc(), key)), F.count("*").over(w)
    return df.withColumn("__k", k).withColumn("__n", n).where(F.col("__k") <= F.greatest(F.lit(10), F.floor(F.col("__n") * share))).drop("__k", "__n")


def numbered(ids: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``n`` from 0: by the first two digits of the key's md5, then key. Counts of those parts come first, so no task holds all keys."""
    at = ids.withColumn("__p", F.substring(F.md5(F.col(key).cast("string")), 1, 2))
    sizes = at.groupBy("__p").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # 256 rows at most
    sizes = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__b"))
    k = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    return at.withColumn("__k", k).join(F.broadcast(sizes), "__p").withColumn("n", F.col("__k") + F.col("__b")).drop("__p", "__k", "__b")


def donors(ids: DataFrame, seed: int, *parts: str) -> DataFrame:
    """(the columns of ``ids``, donor): for each row another row's id by hash, ``parts`` naming what it is drawn for."""
    keyed = stored(numbered(ids.select("id").distinct()), "numbered")
    total = keyed.count()
    pick = F.floor(hash_unit(F.lit(seed), F.lit("donor"), "id", *parts) * total).cast("long")
    return ids.withColumn("n", pick).join(keyed.withColumnRenamed("id", "donor"), "n").drop("n")


def shuffled_features(points: DataFrame, seed: int = 0, most: float = 0.6, count: str = "sample", source: str = "single", alpha: float | None = 1.0) -> DataFrame:
    """Synthetic anomalies (id, dim, x): of each row some dims, chosen by hash, are taken from other rows.

    ``count``: sample (1 to ``most`` of the dims), few (15 %) or many (half). ``source``: single (one
    donor a row) or each (a donor a dim). ``alpha``: share of the donor's value, drawn from 0.3 to 1 if None.
    """
    d = points.select("dim").distinct().count()
    by_hash = 1 + F.floor(hash_unit(F.lit(seed), F.lit("k"), "id") * max(1, int(most * d)))
    k = {"sample": by_hash, "few": F.lit(max(1, int(0.15 * d))), "many": F.lit(max(1, int(0.5 * d)))}[count]
    rank = F.row_number().over(Window.partitionBy("id").orderBy(hash_order(F.lit(seed), "id", "dim")))
    own = points.select("id", "dim", "x").withColumn("rank", rank).withColumn("k", k)
    if source == "single":
        own = own.join(donors(points.select("id").distinct(), seed), "id")
    else:
        own = donors(own, seed, "dim")
    other = points.select(F.col("id").alias("donor"), "dim", F.col("x").alias("y"))
    a = F.lit(float(alpha)) if alpha is not None else 0.3 + 0.7 * hash_unit(F.lit(seed), F.lit("alpha"), "id")
    blend = F.col("y") if alpha == 1.0 else (1 - a) * F.col("x") + a * F.col("y")
    return own.join(other, ["donor", "dim"]).select("id", "dim", F.when(F.col("rank") <= F.col("k"), blend).otherwise(F.col("x")).alias("x"))


def resampled_features(points: DataFrame, beta: float, seed: int = 0, share: float = 0.4, bins: int = 30, inner: float = 0.98) -> DataFrame:
    """Synthetic anomalies (id, dim, x): a share of the dims of each row drawn anew from the dim's histogram.

    A bin with rows, and with its middle between the outer percentiles, is drawn in proportion to
    density ** beta, and the value evenly within it; a dim without such a bin takes a donor's.
    """
    d = points.select("dim").distinct().count()
    edges = points.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("m")).join(quantiles(points, ["dim"], "x", [1 - inner, inner]), "dim")
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / width)))).otherwise(0).cast("int")
    counts = points.join(edges, "dim").groupBy("dim", "lo", "hi", "m", "q", place.alias("bin")).agg(F.count("*").alias("c"))
    middle = F.col("lo") + (F.col("bin") + 0.5) * width
    counts = counts.where((middle >= F.get("q", F.lit(0))) & (middle <= F.get("q", F.lit(1))))
    weight = F.pow(F.greatest(F.col("c") / F.col("m"), F.lit(1e-6)), F.lit(beta))
    w = Window.partitionBy("dim").orderBy("bin")  # ``bins`` rows
    upto = counts.withColumn("w", weight).select("dim", (F.col("lo") + F.col("bin") * width).alias("from"), width.alias("width"), F.sum("w").over(w).alias("upto"), F.sum("w").over(Window.partitionBy("dim")).alias("all"))
    table = upto.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct((F.col("upto") / F.col("all")).alias("p"), "from", "width"))).alias("bins"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(hash_order(F.lit(seed), "id", "dim")))
    own = points.select("id", "dim", "x").withColumn("rank", rank).join(table, "dim", "left")
    own = donors(own, seed, "dim").join(points.select(F.col("id").alias("donor"), "dim", F.col("x").alias("y")), ["donor", "dim"])
    u, v = hash_unit(F.lit(seed), F.lit("bin"), "id", "dim"), hash_unit(F.lit(seed), F.lit("within"), "id", "dim")
    hit = F.coalesce(F.get(F.filter("bins", lambda b: b["p"] > u), F.lit(0)), F.get("bins", F.size("bins") - 1))
    drawn = F.when(F.col("bins").isNull(), F.col("y")).otherwise(hit["from"] + v * hit["width"])
    return own.select("id", "dim", F.when(F.col("rank") <= max(1, int(share * d)), drawn).otherwise(F.col("x")).alias("x"))


def contaminated(df: DataFrame, groups: list[str], key: str, label: str, rate: float, seed: int = 0) -> DataFrame:
    """Training rows with round(rate * normals) anomalies, in hash order, mixed in."""
    normals = F.sum((F.col(label) == 0).cast("long")).over(Window.partitionBy(*groups))
    k = place([*groups, label], seed, key)
    return df.withColumn("__m", F.round(rate * normals)).withColumn("__k", k).where((F.col(label) == 0) | (F.col("__k") <= F.col("__m"))).drop("__k", "__m")
