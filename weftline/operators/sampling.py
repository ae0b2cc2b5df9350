"""Topics, strata and samplers. Random choices are orders by md5 of a seed and the row's key, so they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as X

#: Topic keywords, in the order that breaks ties.
TOPIC_KEYWORDS = {
    "coding": ["code", "program", "function", "algorithm", "debug", "python", "java"],
    "math": ["calculate", "math", "equation", "solve", "number", "formula"],
    "writing": ["write", "essay", "story", "article", "blog", "creative"],
    "science": ["science", "experiment", "research", "hypothesis", "physics", "chemistry"],
    "business": ["business", "market", "strategy", "company", "profit", "sales"],
}


def seeded(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def topic(c: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """The topic with most keywords in the text (as substrings); ties go to the one declared first; none: general."""
    low = F.lower(X.text(c))
    scores = {t: sum((low.contains(k).cast("int") for k in ks), F.lit(0)) for t, ks in (keywords or TOPIC_KEYWORDS).items() if t != "general"}
    if not scores:
        return F.lit("general")
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.when(best == 0, "general")
    for t, s in scores.items():
        out = out.when(s == best, t)
    return out


def length_bucket(c: Column) -> Column:
    n = F.length(X.text(c))
    return F.when(n < 100, "short").when(n < 500, "medium").otherwise("long")


def strata_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("unknown")) for p in parts])


def first_n(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def pending_limit(df: DataFrame, n: int | None, order: str) -> DataFrame:
    """The first n rows; None or 0 means no limit."""
    return df.orderBy(order).limit(n) if n else df


#: Hash prefixes, or parts of a range, by which a sample's last rows are found.
BUCKETS = 1 << 16
#: Samples up to so many rows are taken by one ordered limit.
SMALL = 10_000


def _first(df: DataFrame, takes: DataFrame, group: str, bucket: Column, *order: Column | str) -> DataFrame:
    """The first rows of each group, ``takes`` (group, _n) of them; ``bucket`` (0 .. BUCKETS - 1) is monotonic in ``order``.

    Counts by bucket tell in which one a group's last rows are: earlier buckets are taken whole without being sorted, and
    only the last one's rows, a share of 1 / BUCKETS or so, are ranked.  Groups that ``takes`` doesn't name give nothing."""
    marked = df.withColumn("_b", bucket)
    counts = marked.groupBy(group, "_b").agg(F.count("*").alias("_c")).join(takes.select(group, "_n"), group)
    upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(group).orderBy("_b")))
    last = F.struct(F.col("_b").alias("b"), (F.col("_n") - F.col("_upto") + F.col("_c")).alias("rest"))
    edges = upto.groupBy(group).agg(F.min(F.when(F.col("_upto") >= F.col("_n"), last)).alias("_last"))  # null: the whole group
    joined = marked.join(edges, group)
    whole = joined.where("_last is null or _b < _last.b")
    ranked = joined.where("_b = _last.b").withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_i <= _last.rest")
    return whole.union(ranked.drop("_i")).drop("_b", "_last")


def _hash_bucket(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 4), 16, 10).cast("int")


def _least_hashes(df: DataFrame, n: int, seed: int | str, key: str) -> DataFrame:
    """The n rows with the least hashes, or all."""
    order = [seeded(seed, key), F.col(key)]
    if n <= SMALL:
        return df.orderBy(*order).limit(n)
    takes = df.sparkSession.createDataFrame([(0, n)], "_all int, _n bigint")
    return _first(df.withColumn("_all", F.lit(0)), takes, "_all", _hash_bucket(order[0]), *order).drop("_all")


def random_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows at random, or all if there are no more."""
    return _least_hashes(df, n, seed, key)


def topic_balanced(df: DataFrame, n: int, key: str, topic_col: str, order: str, seed: int = 42) -> DataFrame:
    """n // k rows of each topic, one more for the first n % k topics by first appearance."""
    per = df.groupBy(topic_col).agg(F.min(order).alias("_first"))
    # topics are few: they are ranked on their own, not over the rows
    per = per.withColumn("_rank", F.row_number().over(Window.orderBy("_first")) - 1).withColumn("_k", F.count("*").over(Window.partitionBy()))
    share = F.floor(F.lit(n) / F.col("_k")) + F.when(F.col("_rank") < F.lit(n) % F.col("_k"), 1).otherwise(0)
    h = seeded(seed, key)
    return _first(df, per.withColumn("_n", share), topic_col, _hash_bucket(h), h, key)


def stratified(df: DataFrame, n: int, key: str, strata: str, seed: int = 42, least: int = 1) -> DataFrame:
    """From each stratum min(size, max(least, floor(n * size / total))) rows; a union beyond n is cut at random."""
    sizes = df.groupBy(strata).agg(F.count("*").alias("_size"))
    total = df.agg(F.count("*").alias("_total"))
    # the product first, as doubles, is floor-safe for exact shares
    take = F.least(F.col("_size"), F.greatest(F.lit(least), F.floor(F.lit(n) * (F.col("_size") / F.col("_total")))))
    h = seeded(seed, key)
    return _least_hashes(_first(df, sizes.crossJoin(F.broadcast(total)).withColumn("_n", take), strata, _hash_bucket(h), h, key), n, f"{seed}-trim", key)


#: Seeds that may be drawn from.
SEEDS = 100_000


def seed_batches(seeds: DataFrame, n: int, ord_col: str, seed_col: str, size: int = 5, seed: int = 42) -> DataFrame:
    """(batch, place, seed) of ceil(n / size) batches, each of ``size`` seeds at random, or of all if there are fewer.

    The seeds travel as one array to all tasks; over ``SEEDS`` of them are refused."""
    spark = seeds.sparkSession
    if (many := seeds.count()) > SEEDS:
        raise ValueError(f"{many} seeds are too many to be drawn from in every batch")
    whole = seeds.agg(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col(seed_col).alias("s"))).alias("l"))
    drawn = lambda b, x: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), b.cast("string"), x["o"].cast("string"))).alias("h"), x["o"].alias("o"), x["s"].alias("s"))
    batches = spark.range(-(-n // size)).withColumnRenamed("id", "batch").crossJoin(F.broadcast(whole))
    picked = batches.select("batch", F.slice(F.array_sort(F.transform("l", lambda x: drawn(F.col("batch"), x))), 1, size).alias("l"))
    return picked.select("batch", F.posexplode("l").alias("place", "x")).select("batch", "place", F.col("x.s").alias("seed"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): mean vector of each cluster."""
    parts = df.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def cluster_balanced(df: DataFrame, n: int, key: str, label: str, vector: str, clusters: int | None = None) -> DataFrame:
    """n // k rows of each cluster, one more where cluster id < n % k, at most its size: half of them nearest to the centroid, the rest farthest from it."""
    c = centroids(df, label, vector)
    k = F.lit(clusters) if clusters else F.col("_k")
    counts = df.groupBy(label).agg(F.count("*").alias("_size")).withColumn("_k", F.count("*").over(Window.partitionBy()))
    share = F.least(F.col("_size"), F.floor(F.lit(n) / k) + F.when(F.col(label) < F.lit(n) % k, 1).otherwise(0))
    distance = F.sqrt(F.aggregate(F.zip_with(vector, "centroid", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    rows = df.join(c, label).withColumn("_d", F.round(distance, 9)).drop("centroid")
    ends = rows.groupBy(label).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    rows = rows.join(ends, label)
    part = F.coalesce((F.col("_d") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    nearest = F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    half = F.floor(F.col("_n") / 2)
    shares = counts.withColumn("_n", share)
    # one order is the other's reverse and a share is at most the cluster, so no row is in both
    near = _first(rows, shares.withColumn("_n", half), label, nearest, "_d", key)
    far = _first(rows, shares.withColumn("_n", F.col("_n") - half), label, BUCKETS - 1 - nearest, F.desc("_d"), F.desc(key))
    return near.union(far).drop("_d", "_lo", "_hi")


def diversity_sample(df: DataFrame, n: int, strategy: str, key: str, order: str, **columns) -> DataFrame:
    """n rows or fewer by strategy cluster, topic, stratified or random (also any other); an input of at most n comes back whole."""
    if df.limit(n + 1).count() <= n:
        return df
    if strategy == "cluster":
        return cluster_balanced(df, n, key, columns["label"], columns["vector"])
    if strategy == "topic":
        return topic_balanced(df, n, key, columns["topic"], order)
    if strategy == "stratified":
        return stratified(df, n, key, columns["strata"])
    return random_n(df, n, key)


def kmeans_labels(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` by K-means with min(k, rows) clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    k = min(k, df.limit(k).count())
    if k < 2:
        return df.withColumn("cluster", F.lit(0))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows).transform(rows).drop("_v")


def hashed_split(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split``: train for about ``share`` of the rows, else test, by a hash of the key."""
    bucket = F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(bucket < share, "train").otherwise("test"))
