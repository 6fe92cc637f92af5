"""Building blocks that keep operators safe on skewed and very large inputs.

Quantiles have one route. Device windows and running totals have a plain route for inputs that
one scan task can hold, and a route whose largest task does not depend on how rows are spread over
keys. That choice looks only at Catalyst's own size of the files behind a DataFrame, so it costs no job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from tempfile import mkdtemp

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from rigsense.functions.exprs import count_where, lit_d

BLOCK_ROWS = 5_000_000  # rows of one device that a single window task should sort
MAX_HOT_KEYS = 10_000  # upper bound on the number of keys treated one by one
BROADCAST_ROWS = 1_000_000  # largest lookup that is sent to every executor


def input_bytes(df: DataFrame) -> int | None:
    """Bytes behind all scans of ``df`` as Catalyst knows them, or None if unknown.

    It sums the leaves of the analyzed plan: no job and no optimizer run.
    """
    jvm_frame = getattr(df, "_jdf", None)
    if jvm_frame is None:  # a remote client has no plan to ask
        return None
    leaves = jvm_frame.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _bytes_conf(spark: SparkSession) -> int:
    text = spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728").strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = text.rstrip("bkmg")
    return int(digits) * units.get(text[len(digits):][:1], 1)


def fits_one_task(df: DataFrame) -> bool:
    """True when everything ``df`` reads is no more than a single scan split."""
    size = input_bytes(df)
    return size is not None and size <= _bytes_conf(df.sparkSession)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, in the shared folder that spark.checkpoint.dir names.

    Only a local master may go without that setting; on a cluster a local folder would be each
    executor's own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = mkdtemp(prefix="rigsense-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back, which cuts its lineage."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null; the key columns come from ``left``."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on]
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in on])


def attach_row(df: DataFrame, row: DataFrame) -> tuple[DataFrame, Column]:
    """Make a one-row DataFrame available on every row of ``df``.

    The row travels as a scalar subquery: it becomes a literal in the generated code,
    needs no join, and leaves the size estimate of ``df`` alone.
    """
    packed = row.select(F.struct(*[F.col(c) for c in row.columns]).alias("v"))
    name = f"_row_{uuid.uuid4().hex[:8]}"
    return df.withColumn(name, packed.scalar()), F.col(name)


# --------------------------------------------------------------------------- quantiles
def ordered_prefix(x: Column) -> Column:
    """A long that never falls while a double grows: sign, exponent and the first 31 bits of the fraction."""
    def image(size: Column) -> Column:
        return F.transform(F.transform(F.array(F.floor(F.log2(size))), lambda guess: (  # one off at most, next to a power of two
            guess + F.when(size >= F.pow(lit_d(2.0), guess + 1), 1).when(size < F.pow(lit_d(2.0), guess), -1).otherwise(0)
        )), lambda e: (e + 1075) * F.lit(1 << 31) + F.floor((size / F.pow(lit_d(2.0), e) - 1) * lit_d(float(1 << 31))))[0]

    size = F.when(F.abs(x) < lit_d("inf"), F.abs(x))
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("long") * F.coalesce(image(size), F.lit(2100 << 31)))


def _within(rank: str, start: Column, end: Column) -> Column:
    """A rank counted from ``start``, or null if it lies outside."""
    return F.when((F.col(rank) >= start) & (F.col(rank) < end), F.col(rank) - start)


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], by: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles: ``wanted`` maps a name to (column, p).

    Radix selection: equal values are counted once, and the counts are added up over the first 42 and the
    first 21 bits of the values' order. The ranks wanted are then followed from the coarse counts to the fine
    ones to the values. At each step a group and prefix has at most a few million rows of counts, however many
    rows the group has and whatever they hold, so no task depends on the size of a group. The rows themselves
    are read once.

    Null and NaN are missing values. A group without values has null quantiles; a null key is a group. Without
    ``by`` there is always one row.
    """
    by, names = list(by), list(wanted)
    kinds = dict(df.select(*[c.alias(n) for n, (c, _) in wanted.items()]).dtypes)
    sources: list[Column] = []  # quantiles of the same column share its counts
    source_of = {}
    for n, (c, _) in wanted.items():
        same = [i for i, known in enumerate(sources) if known is c]
        source_of[n] = same[0] if same else len(sources)
        sources += [] if same else [c]
    first = {source_of[n]: n for n in reversed(names)}
    value = {i: F.when(~F.isnan(c), c) if kinds[first[i]] in ("float", "double") else c for i, c in enumerate(sources)}
    entries = [F.struct(F.lit(i).alias("_c"), (v.cast("double") + lit_d(0.0)).alias("_v")) for i, v in value.items()]  # -0.0 is 0.0

    keys = [*by, "_c"]
    values = df.select(*by, F.inline(F.array(*entries))).groupBy(*keys, "_v").agg(F.count("_v").alias("_n"))
    values = values.withColumn("_fine", ordered_prefix(F.col("_v")))
    fine = values.groupBy(*keys, "_fine").agg(F.sum("_n").alias("_n")).withColumn("_coarse", F.shiftright("_fine", 21))
    coarse = fine.groupBy(*keys, "_coarse").agg(F.sum("_n").alias("_n"))

    def step(counts: DataFrame, within: list[str], digit: str) -> tuple[DataFrame, Column, Column]:
        upto = Window.partitionBy(*within).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_end", F.sum("_n").over(upto))
        return counts, F.col("_end") - F.col("_n"), F.col("_end")

    top, start, end = step(coarse, keys, "_coarse")
    top = top.withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    asked = F.array(*[  # by source, so that a row looks its quantiles up
        F.array(*[F.struct(F.lit(q).alias("_q"), lit_d(wanted[n][1]).alias("_p")) for q, n in enumerate(names) if source_of[n] == i]) for i in value])
    top = top.select("*", F.inline(F.get(asked, F.col("_c"))))
    top = top.withColumn("_pos", F.col("_p") * (F.col("_all") - 1)).withColumns({"_l": F.floor("_pos"), "_r": F.ceil("_pos")})
    at = top.withColumns({"_l": _within("_l", start, end), "_r": _within("_r", start, end)})
    at = at.filter("_l IS NOT NULL OR _r IS NOT NULL OR _all = 0").select(*keys, "_q", "_pos", "_coarse", "_l", "_r")

    mid, start, end = step(null_safe_join(fine, at, [*keys, "_coarse"]), [*keys, "_q", "_coarse"], "_fine")
    none = F.col("_l").isNull() & F.col("_r").isNull()
    at = mid.withColumn("_none", none).withColumns({"_l": _within("_l", start, end), "_r": _within("_r", start, end)})
    at = at.filter("_l IS NOT NULL OR _r IS NOT NULL OR _none").select(*keys, "_q", "_pos", "_fine", "_l", "_r")

    low, start, end = step(null_safe_join(values, at, [*keys, "_fine"]), [*keys, "_q", "_fine"], "_v")
    left, right = (F.when(_within(rank, start, end).isNotNull(), F.col("_v")) for rank in ("_l", "_r"))
    found = low.withColumns({"_left": left, "_right": right}).groupBy(*by).agg(*[
        F.max(F.when(F.col("_q") == q, F.col(c))).alias(f"{c}{q}") for q in range(len(names)) for c in ("_left", "_right", "_pos")])

    def between(q: int) -> Column:
        a, b, pos = F.col(f"_left{q}"), F.col(f"_right{q}"), F.col(f"_pos{q}")
        return F.when(a == b, a).otherwise((F.ceil(pos) - pos) * a + (pos - F.floor(pos)) * b)

    return found.select(*by, *[between(q).alias(n) for q, n in enumerate(names)])


# --------------------------------------------------------------------------- device windows
def hot_keys(df: DataFrame, key: str, rows: int | None = None) -> list:
    """Keys with more than ``rows`` rows; runs one counting job over the key column.

    The cut rises with the table, so at most MAX_HOT_KEYS keys can pass it.
    """
    rows = rows or BLOCK_ROWS
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("t"))
    cut = F.greatest(F.lit(rows), F.ceil(total.scalar() / F.lit(MAX_HOT_KEYS)))
    return [r[0] for r in counts.filter(F.col("_n") > cut).select(key).collect()]


def _in_keys(key: str, keys: list) -> Column:
    found = F.coalesce(F.col(key).isin([k for k in keys if k is not None]), F.lit(False))
    return found | F.col(key).isNull() if None in keys else found


def _device_blocks(
    df: DataFrame, key: str, time: str, rows: int | None, back: int, ahead: int, bucket_seconds: int
) -> DataFrame:
    """Tag rows with ``_home``, the block they belong to, and copy them into ``_blk``, every
    block that needs them as context.

    Blocks are runs of whole time buckets holding about ``rows`` rows. A bucket covering
    positions [s, e) of its device is needed by all blocks that start before e + back and
    by those that can end after s - ahead, so bounded row frames stay exact.
    """
    rows = rows or BLOCK_ROWS
    bucket = F.floor(F.unix_seconds(F.col(time)) / F.lit(bucket_seconds)).cast("long")
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    per_key = Window.partitionBy(key)
    end = F.sum("_cnt").over(per_key.orderBy("_bucket"))
    spans = (
        sizes.withColumn("_e", end)
        .withColumn("_s", F.col("_e") - F.col("_cnt"))
        .withColumn("_home", F.floor(F.col("_s") / F.lit(rows)).cast("long"))
    )
    last = F.floor((F.col("_e") + F.lit(back - 1)) / F.lit(rows)) if back else F.col("_home")
    first = F.col("_home")
    if ahead:
        spans = spans.withColumn("_max", F.max("_cnt").over(per_key))
        first = F.greatest(
            F.lit(0), F.floor((F.col("_s") - F.lit(ahead) - F.col("_max")) / F.lit(rows))
        )
    first, last = first.cast("long"), F.greatest(last.cast("long"), F.col("_home"))
    spans = spans.select(key, "_bucket", "_home", F.sequence(first, last).alias("_blks"))
    return null_safe_join(tagged, spans, [key, "_bucket"]).withColumn("_blk", F.explode("_blks")).drop(
        "_bucket", "_blks"
    )


def over_device_rows(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
    key: str = "miner_id",
    time: str = "timestamp",
    tiebreak: Sequence[str] = ("id",),
    rows: int | None = None,
    split: bool | None = None,
    bucket_seconds: int = 300,
) -> DataFrame:
    """Run ``build(df, window)`` where the window is one device in time order.

    ``build`` may use row frames reaching at most ``back`` rows back and ``ahead`` rows
    ahead. Normal devices share one shuffle on the key. A device with more than ``rows``
    rows is cut into blocks of consecutive rows with the context copied over the cut, so
    that even a device owning a third of the table is spread over many tasks.
    """
    order = [time, *[t for t in tiebreak if t in df.columns]]
    plain = Window.partitionBy(key).orderBy(*order)
    if split is None:
        split = not fits_one_task(df)
    hot = hot_keys(df, key, rows) if split else []
    if not hot:
        return build(df, plain)
    blocks = _device_blocks(
        df.filter(_in_keys(key, hot)), key, time, rows, back, ahead, bucket_seconds
    )
    cut = build(blocks, Window.partitionBy(key, "_blk").orderBy(*order))
    cut = cut.filter(F.col("_blk") == F.col("_home")).drop("_blk", "_home")
    return build(df.filter(~_in_keys(key, hot)), plain).unionByName(cut)


def fill_gaps(
    df: DataFrame,
    columns: Sequence[str],
    key: str = "miner_id",
    time: str = "timestamp",
    tiebreak: Sequence[str] = ("id",),
    rows: int | None = None,
    split: bool | None = None,
    bucket_seconds: int = 300,
) -> DataFrame:
    """Forward fill, then back fill, per device in time order.

    Back fill only concerns rows before a device's first value, so it is that first value.
    """
    columns = list(columns)
    order = [time, *[t for t in tiebreak if t in df.columns]]

    def plain(part: DataFrame) -> DataFrame:
        run = Window.partitionBy(key).orderBy(*order)
        upto = run.rowsBetween(Window.unboundedPreceding, 0)
        whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return part.withColumns({
            c: F.coalesce(F.last(c, True).over(upto), F.first(c, True).over(whole))
            for c in columns
        })

    if split is None:
        split = not fits_one_task(df)
    hot = hot_keys(df, key, rows) if split else []
    if not hot:
        return plain(df)

    blocks = _device_blocks(
        df.filter(_in_keys(key, hot)), key, time, rows, 0, 0, bucket_seconds
    ).drop("_blk")
    at = {
        c: F.when(F.col(c).isNotNull(), F.struct(*[F.col(o) for o in order])) for c in columns
    }
    edges = blocks.groupBy(key, "_home").agg(
        *[F.min_by(c, at[c]).alias(f"_first_{c}") for c in columns],
        *[F.max_by(c, at[c]).alias(f"_last_{c}") for c in columns],
    )
    over = Window.partitionBy(key).orderBy("_home")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = edges.select(
        key, "_home",
        *[
            F.coalesce(
                F.last(f"_last_{c}", True).over(before), F.first(f"_first_{c}", True).over(whole)
            ).alias(f"_carry_{c}")
            for c in columns
        ],
    )
    upto = (
        Window.partitionBy(key, "_home").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = (
        null_safe_join(blocks, carried, [key, "_home"])
        .withColumns({
            c: F.coalesce(F.last(c, True).over(upto), F.col(f"_carry_{c}")) for c in columns
        })
        .select(*df.columns)
    )
    return plain(df.filter(~_in_keys(key, hot))).unionByName(filled)


# --------------------------------------------------------------------------- top-1 and sums
def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.

    The rank filter lets Spark keep one row per key inside each task before the shuffle,
    so a key with very many rows sends only a handful of them.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def running_totals(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    descending: bool = False,
    parts: int = 1024,
    split: bool | None = None,
) -> DataFrame:
    """Running sums over the whole table in the order of one column with distinct values.

    ``sums`` maps the new column to the summed one. Large tables are cut at sketched
    quantiles into ``parts`` ranges; each range is summed on its own and shifted by the
    totals of the ranges before it, so there is no single sorted partition.
    """
    direction = F.col(order).desc() if descending else F.col(order).asc()
    if split is None:
        split = not fits_one_task(df)
    if not split:
        w = Window.orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({new: F.sum(old).over(w) for new, old in sums.items()})

    shares = ", ".join(f"{i / parts!r}D" for i in range(1, parts))
    cuts = df.agg(F.expr(f"percentile_approx(`{order}`, array({shares}), {10 * parts})").alias("cuts"))
    with_cuts, row = attach_row(df, cuts)
    ranged = with_cuts.withColumn(
        "_part", F.size(F.filter(row["cuts"], lambda c: c < F.col(order)))
    ).drop(*[c for c in with_cuts.columns if c not in df.columns])
    totals = ranged.groupBy("_part").agg(*[F.sum(o).alias(f"_t_{n}") for n, o in sums.items()])
    part_dir = F.col("_part").desc() if descending else F.col("_part").asc()
    before = Window.orderBy(part_dir).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    w = (
        Window.partitionBy("_part").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ranged.join(F.broadcast(offsets), "_part")  # at most `parts` rows
        .withColumns({n: F.sum(o).over(w) + F.col(f"_o_{n}") for n, o in sums.items()})
        .select(*df.columns, *sums)
    )
