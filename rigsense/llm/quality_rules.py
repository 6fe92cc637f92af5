"""Quality rules and hashed n-gram log-likelihood ratios, all as column expressions.

Words are runs without white space. Grams are words and pairs of neighbouring words, known by 64-bit
hashes. Both multinomials, of trusted documents and of the raw corpus, have the same outcomes: grams fall
into classes by hash, and a class whose count is ``LEADER`` times the mean or more is split into its most
frequent gram, if that alone has such a count, and the rest. The number of classes grows with the square
root of the corpus, as the number of grams of a given share does, so a gram that is frequent always has a
probability of its own and the others share theirs with few frequent ones. All counts are exact and over all
documents: one pass counts classes, one the grams of the large classes only, one the trusted documents.

A weight is the log of trusted over raw probability, the trusted counts smoothed by ``PRIOR`` raw
probabilities per class. A text's ratio is the mean weight of its grams; a text is kept if it passes the
base rules and its ratio is at least ``MIN_RATIO``. Weights are looked up in arrays over ``BLOCK`` classes; a
larger model takes one pass over the texts per block, so what a task holds is bounded.

Defined results: a null text has no words, fails the base rules and has ratio 0. Without trusted
documents all ratios are 0. Repeated rows count each; an empty table gives an empty result. Columns
named like an output are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigsense.llm.base import new_name, stage

CLASSES = 8  # classes per square root of a byte of text, rounded up to a power of two
LEADER = 8  # times the mean count of a class that a gram needs for a probability of its own
BLOCK = 1 << 19  # classes whose weights a task, and the driver, hold at once
MIN_RATIO = -0.1  # nats per word or pair: about 0.9 times as likely among trusted texts as in the corpus
PRIOR = 1.0  # trusted grams per class, dealt like the raw ones, that are added to the trusted counts
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_WHITE = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "[#*$%&|<>]"


@dataclass
class Weights:
    classes: int
    blocks: list[DataFrame]  # one row each: leader (a gram or null), own and rest (weights), arrays over BLOCK classes


def with_words(documents: DataFrame, text: str, words: str, hashes: str, pairs: str) -> DataFrame:
    """``documents`` with the words of each text, their hashes, and the hashes of pairs of neighbours.

    Each is a column of its own, so that it is computed once however often it is used.
    """
    split = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _WHITE), "")
    rows = documents.withColumn(words, split).withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    return rows.withColumn(pairs, F.zip_with(_skip(hashes, 0, 1), _skip(hashes, 1, 1), lambda a, b: F.xxhash64(a, b)))


def _skip(array: str, first: int, fewer: int) -> Column:
    """Elements from ``first`` on, ``fewer`` less than all."""
    return F.slice(array, first + 1, F.greatest(F.size(array) - fewer, F.lit(0)))


def measure(documents: DataFrame, text: str = "text", extra=None) -> DataFrame:
    """``documents`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    ``extra`` maps the names of further columns to functions of the hashes of words and of pairs.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    words, hashes, pairs, grams, lines, order = (new_name(c) for c in ("words", "hashes", "pairs", "grams", "lines", "order"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = with_words(documents.drop(*[c for c in names if c in documents.columns]), text, words, hashes, pairs)
    rows = rows.withColumns({
        grams: F.zip_with(_skip(pairs, 0, 1), _skip(hashes, 2, 2), lambda a, b: F.xxhash64(a, b)),
        lines: F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
    })
    # Windows of three words are known by 64-bit hashes, and sorted only where some are equal.
    windows = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    rows = rows.withColumn(order, F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(windows)))
    at = lambda i: F.get(F.col(order), i)["g"]
    twice = F.filter(order, lambda x, i: (x["g"] == at(i + 1)) | (x["g"] == at(i - 1)))
    places = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    rows = rows.withColumns({
        "n_words": F.size(words).cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(_SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(F.size(places), F.lit(0)).cast("long"),
    } | {name: fn(F.col(hashes), F.col(pairs)) for name, fn in (extra or {}).items()})
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return rows.withColumn("base_failed", failed).drop(words, hashes, pairs, grams, lines, order)


def _class(gram: Column, classes: int) -> Column:
    return F.pmod(gram, F.lit(classes)).cast("int")


def _grams(documents: DataFrame, text: str) -> DataFrame:
    rows = with_words(documents.select(F.col(text).alias("_text")), "_text", "_words", "_hashes", "_pairs")
    return rows.select(F.explode(F.concat("_hashes", "_pairs")).alias("gram"))


def _arrays(rows: DataFrame, classes: int, columns: dict[str, Column], name: str) -> list[DataFrame]:
    """``columns`` of ``rows`` (one per class at most) as arrays by class, one written row per block."""
    spark, made = rows.sparkSession, []
    for lo in range(0, classes, BLOCK):
        ids = spark.range(lo, min(lo + BLOCK, classes)).withColumn("class", F.col("id").cast("int"))
        listed = ids.join(rows, "class", "left").agg(F.array_sort(F.collect_list(F.struct("id", *[c.alias(n) for n, c in columns.items()]))).alias("v"))
        made.append(stage(listed.select(*[F.col("v").getField(n).alias(n) for n in columns]), name))
    return made


def log_ratios(documents: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> Weights:
    """The weights of all grams of the documents; ``trusted`` lists the keys of trusted documents.

    Texts are moved once, to meet the trusted keys.
    """
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    classes = 1 << max(10, math.ceil(math.log2(CLASSES * math.sqrt(size) + 1)))
    of = _class(F.col("gram"), classes)
    raw = stage(_grams(documents, text).groupBy(of.alias("class")).agg(F.count("*").alias("raw")), "quality-classes")
    all_raw = raw.agg(F.sum("raw")).first()[0] or 0
    cut = LEADER * all_raw / classes
    # Classes that may have a leader: at most one in LEADER.
    large = _arrays(raw.filter(F.col("raw") >= cut), classes, {"large": F.col("raw").isNotNull()}, "quality-large")
    leaders = None
    for lo, block in zip(range(0, classes, BLOCK), large):
        grams = _grams(documents, text).filter(F.get(block.select("large").scalar(), of - lo))
        found = grams.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= cut)
        leaders = found if leaders is None else leaders.unionByName(found)
    best = leaders.groupBy(of.alias("class")).agg(F.max(F.struct("n", "gram")).alias("best")).select("class", "best.n", "best.gram")
    led = stage(raw.join(best, "class", "left"), "quality-leaders")
    keys = _arrays(led, classes, {"leader": F.col("gram")}, "quality-keys")
    known = trusted.select(F.col(key)).distinct()
    good = stage(documents.join(known.hint("merge"), key, "left_semi").select(text), "quality-trusted")
    counts = None
    for lo, block in zip(range(0, classes, BLOCK), keys):
        grams = _grams(good, text).filter((of >= lo) & (of < lo + BLOCK))
        own = F.coalesce(F.get(block.select("leader").scalar(), of - lo) == F.col("gram"), F.lit(False))
        found = grams.groupBy(of.alias("class")).agg(F.sum(F.when(own, 1).otherwise(0)).alias("good_own"), F.sum(F.when(own, 0).otherwise(1)).alias("good_rest"))
        counts = found if counts is None else counts.unionByName(found)
    table = stage(led.join(counts, "class", "left"), "quality-counts")
    all_good = table.agg(F.sum(F.col("good_own") + F.col("good_rest"))).first()[0] or 0
    prior = PRIOR * classes

    def weight(raw_count: Column, good_count: Column) -> Column:
        share = (F.coalesce(raw_count, F.lit(0)) + 1.0) / float(all_raw + 2 * classes)
        return F.log((F.coalesce(good_count, F.lit(0)) + share * prior) / (share * (all_good + prior)))

    return Weights(classes, _arrays(table, classes, {
        "leader": F.col("gram"), "own": weight(F.col("n"), F.col("good_own")),
        "rest": weight(F.col("raw") - F.coalesce("n", F.lit(0)), F.col("good_rest")),
    }, "quality-weights"))


def _constant(values: list, kind: str, form: str) -> Column:
    """An array that is folded into one constant: functions over arrays accept no scalar subquery."""
    return F.split(F.lit(",".join([format(v, form) for v in values])), ",").cast(f"array<{kind}>")


def judge(documents: DataFrame, weights: Weights, text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """``documents`` with the base measures, log_ratio and kept."""
    before = new_name("before")
    rows = documents.drop("log_ratio", "kept").withColumn(before, F.lit(0.0))

    def sum_of(lo: int, block: DataFrame):
        row = block.first()
        # No gram of a class is the number of the next class: it stands for no leader.
        leader = _constant([lo + i + 1 if g is None else g for i, g in enumerate(row["leader"])], "bigint", "d")
        own, rest = (_constant(row[c], "double", ".9g") for c in ("own", "rest"))

        def add(total: Column, gram: Column) -> Column:
            at = _class(gram, weights.classes) - lo
            value = F.when(F.get(leader, at) == gram, F.get(own, at)).otherwise(F.get(rest, at))
            return total + F.coalesce(value, F.lit(0.0))  # null: a class of another block

        return lambda hashes, pairs: F.aggregate(pairs, F.aggregate(hashes, F.col(before), add), add)

    places = list(zip(range(0, weights.classes, BLOCK), weights.blocks))
    for lo, block in places[:-1]:
        names = [new_name(c) for c in ("words", "hashes", "pairs")]
        summed = sum_of(lo, block)(*(F.col(c) for c in names[1:]))
        rows = stage(with_words(rows, text, *names).withColumn(before, summed).drop(*names), "quality-sums")
    rows = measure(rows, text, {"log_ratio": sum_of(*places[-1])}).drop(before)
    rows = rows.withColumn("log_ratio", F.when(F.col("n_words") > 0, F.col("log_ratio") / (2 * F.col("n_words") - 1)).otherwise(0.0))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= min_ratio))
