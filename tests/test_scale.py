"""The skew-safe routes must give exactly what the plain routes give."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from rigsense.operators import scale


@pytest.fixture(scope="module")
def skewed(spark, sf_dir):
    """Events where one device owns about half of all rows."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("event_id") % 2 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("m-"), F.col("user_id").cast("string"))).alias("miner_id"),
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"),
        F.when(F.col("event_id") % 17 == 1, F.col("value")).alias("sparse"),
        F.col("event_type").alias("g"),
    )


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("bucket", [60, 3600, 7200])
@pytest.mark.parametrize("size", [7, 40])
def test_split_windows_match_plain(skewed, bucket, size):
    def build(df, w):
        return df.withColumns({
            "mean": F.round(F.avg("v").over(w.rowsBetween(-5, 0)), 9),
            "far": F.round(F.sum("v").over(w.rowsBetween(-71, 0)), 6),
            "prev": F.lag("v").over(w),
            "next": F.max("v").over(w.rowsBetween(1, 12)),
        })

    plain = scale.over_device_rows(skewed, build, 71, 12, split=False)
    cut = scale.over_device_rows(
        skewed, build, 71, 12, split=True, rows=size, bucket_seconds=bucket
    )
    assert rows(plain) == rows(cut)


@pytest.mark.parametrize("size", [5, 50])
def test_split_fill_matches_plain(skewed, size):
    plain = scale.fill_gaps(skewed, ["v", "sparse"], split=False)
    cut = scale.fill_gaps(skewed, ["v", "sparse"], split=True, rows=size, bucket_seconds=600)
    assert rows(plain) == rows(cut)
    assert plain.filter("sparse is null and miner_id = 'hot'").isEmpty()


def test_hot_keys(skewed):
    assert scale.hot_keys(skewed, "miner_id", rows=100) == ["hot"]
    assert scale.hot_keys(skewed, "miner_id") == []


def rounded(df):
    return sorted((tuple(float(f"{x:.12g}") if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("by", [[], ["g"], ["miner_id"]])
def test_quantiles_match_percentile(skewed, by):
    v = F.col("v")
    wanted = {"a": (v, 0.5), "b": (v, 0.1), "zero": (v, 0.0), "one": (v, 1.0), "c": (F.col("sparse"), 0.8), "t": (F.unix_micros("timestamp"), 0.8)}
    plain = skewed.groupBy(*by).agg(*[F.percentile(c, p).alias(n) for n, (c, p) in wanted.items()])
    assert rounded(plain) == rounded(scale.exact_quantiles(skewed, wanted, by))


EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 1.0, 2.0, 0.9999999999999999]


def test_prefix_keeps_the_order_of_doubles(spark):
    rng = random.Random(3)
    drawn = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    near = [2.0 ** e * f for e in range(-1070, 1024, 7) for f in (1 - 2 ** -53, 1.0, 1 + 2 ** -52)]
    xs = sorted(x for x in EDGES + drawn + near + [-x for x in near] if not math.isnan(x))
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(scale.ordered_prefix(F.col("x"))).collect()]
    assert got == sorted(got) and None not in got and len(set(got)) > len(set(xs)) * 0.75


def test_quantiles_of_values_that_share_their_first_bits(spark):
    """Thousands of neighbours in one fine prefix, and in one coarse one."""
    rng = random.Random(4)
    xs = [1 + rng.randrange(5000) * 2.0 ** -52 for _ in range(4000)] + [1 + rng.randrange(1 << 20) * 2.0 ** -30 for _ in range(3000)] + [float("nan"), None, -3.0]
    d = spark.createDataFrame([(x,) for x in xs], "v double")
    known = sorted(x for x in xs if x is not None and not math.isnan(x))
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        pos = p * (len(known) - 1)
        a, b = known[math.floor(pos)], known[math.ceil(pos)]
        want = a if a == b else (math.ceil(pos) - pos) * a + (pos - math.floor(pos)) * b
        assert scale.exact_quantiles(d, {"m": (F.col("v"), p)}).first()[0] == want


def test_quantiles_of_nothing(spark):
    d = spark.createDataFrame([], "g string, v double")
    assert scale.exact_quantiles(d, {"m": (F.col("v"), 0.5)}).collect() == [(None,)]
    assert scale.exact_quantiles(d, {"m": (F.col("v"), 0.5)}, ["g"]).isEmpty()
    d = spark.createDataFrame([("a", float("nan")), ("a", None)], "g string, v double")
    assert scale.exact_quantiles(d, {"m": (F.col("v"), 0.5)}, ["g"]).collect() == [("a", None)]


@pytest.mark.parametrize("desc", [False, True])
def test_split_running_totals(skewed, desc):
    d = skewed.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("v is not null")
    plain = scale.running_totals(d, "v", {"cum": "n"}, desc, split=False)
    cut = scale.running_totals(d, "v", {"cum": "n"}, desc, parts=16, split=True)
    assert rows(plain) == rows(cut)


def test_quantiles_keep_null_and_empty_groups(spark):
    nan = float("nan")
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", nan), (None, 5.0), (None, 6.0), ("e", None), ("n", nan)], "g string, v double")
    found = scale.exact_quantiles(d, {"m": (F.col("v"), 0.5)}, ["g"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("a", 1.5), (None, 5.5), ("e", None), ("n", None)], key=repr)


def test_rows_without_a_device_are_split(spark, skewed):
    d = skewed.withColumn("miner_id", F.lit(None).cast("string"))
    assert scale.hot_keys(d, "miner_id", 10) == [None]

    def sums(part, w):
        return part.withColumn("s", F.count("*").over(w.rowsBetween(-3, 0)))

    plain = scale.over_device_rows(d, sums, back=3, split=False)
    cut = scale.over_device_rows(d, sums, back=3, rows=50, split=True)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, cut.collect()))


def test_size_check(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert scale.fits_one_task(e.groupBy("user_id").count())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert not scale.fits_one_task(e)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_latest_per_key_limits_before_the_shuffle(skewed):
    top = scale.latest_per_key(skewed, ["miner_id"], [F.col("timestamp").desc(), F.col("id").desc()])
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.count() == skewed.select("miner_id").distinct().count()
