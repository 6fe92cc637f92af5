"""What each of a set of filters removes, in every order of applying them.

A document has one bit per filter that it fails. Documents are counted by part and bits (at most two to the
number of filters cells a part), so texts are read once and never moved. A recursive query then extends
filter prefixes with the letters not used yet: it starts from the different bit masks, carries the bits
applied so far, and each level says of every mask what the new filter does to it: keep, remove, or find it
removed already. Its size depends on the number of filters only. Joined with the cells by mask, it gives the
counts of every prefix; an order's step is the prefix of that length.

Defined results: a null text is an empty text. A null part is the empty string. A document has a mark if
any of its label rows has it; documents without labels have none. Texts are equal if their SHA-256 is.
Rows of the same doc_id do not make each other a copy; a null doc_id neither is a copy nor makes one.
Repeated rows count each. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOT_SHARE = 1000  # a text with more than one in so many rows is hot, so at most that many are


def text_failures(text: str = "text") -> dict[str, Column]:
    """The failure conditions that a document's own text decides."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, WHITE), "")
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": (F.length(body) - F.length(F.translate(body, UPPER, ""))) * 100 > F.length(body) * 3,
        "D": body.rlike("[#$%&*|]"),
    }


def copies(rows: DataFrame, digest: str, key: str, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: some row with a smaller key has the same digest.

    The smallest keys of hot digests are few and broadcast; the others are joined by digest.
    """
    first = rows.groupBy(digest).agg(F.min(key).alias("_least"), F.count("*").alias("_n")).filter("_n > 1")
    cut = rows.agg((F.count("*") / HOT_SHARE).alias("n")).first()["n"]
    hot, cold = first.filter(F.col("_n") > cut).drop("_n"), first.filter(F.col("_n") <= cut).drop("_n")
    rows = rows.join(F.broadcast(hot.withColumnRenamed("_least", "_hot")), digest, "left")
    # A hot row needs no partner any more: its key is null, and spread over tasks.
    rows = rows.withColumn("_cold", F.when(F.col("_hot").isNull(), F.col(digest)).otherwise(F.unhex(F.md5(F.col(key).cast("string")))))
    rows = rows.join(cold.withColumnRenamed(digest, "_cold").hint("merge"), "_cold", "left")
    least = F.coalesce("_hot", "_least")
    return rows.withColumn(name, F.coalesce(F.col(key) > least, F.lit(False))).drop("_hot", "_least", "_cold")


def cells(flagged: DataFrame, part: Column, failures: Sequence[Column], marks: dict[str, Column]) -> DataFrame:
    """Rows per part and mask: n, and how many have each mark. Bit i of the mask: failure i."""
    mask = F.lit(0)
    for i, failed in enumerate(failures):
        mask = mask.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)))
    counted = [F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in marks.items()]
    return flagged.groupBy(F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask")).agg(F.count("*").alias("n"), *counted)


def prefixes(counted: DataFrame, letters: str) -> DataFrame:
    """Every filter prefix and mask with what the prefix's last filter does to documents of that mask."""
    bits = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters))
    return counted.sparkSession.sql(f"""
WITH RECURSIVE letters(letter, bit) AS (VALUES {bits}),
prefixes(prefix, step, filter, bit, before, applied, mask) AS (
  SELECT '', 0, '', 0, 0, 0, mask FROM (SELECT DISTINCT mask FROM {{cells}})
  UNION ALL
  SELECT concat(p.prefix, l.letter), p.step + 1, l.letter, l.bit, p.applied, p.applied | l.bit, p.mask
  FROM prefixes p JOIN letters l ON (p.applied & l.bit) = 0
)
SELECT prefix, step, filter, mask,
  (mask & applied) = 0 AS kept, (mask & before) = 0 AND (mask & bit) != 0 AS removed,
  (mask & before) != 0 AND (mask & bit) != 0 AS redundant, mask = bit AS only
FROM prefixes WHERE step > 0""", cells=counted)


def audit(counted: DataFrame, letters: str, lost: Sequence[str] = ()) -> DataFrame:
    """part, filter_order, step and the counts of each step, from cells of n and the columns ``lost``.

    kept, removed, redundant, unique_fails, ``<x>_lost`` for each x in ``lost``, and shapley: what the step's
    filter removes, summed over all orders.
    """
    size = len(letters)
    steps = prefixes(counted, letters)
    total = lambda what, of="n": F.sum(F.when(F.col(what), F.col(of)).otherwise(0)).cast("long")
    # At most 2 ** size masks times the number of prefixes, whatever the data: broadcast.
    found = counted.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "step", "filter").agg(
        total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"),
        total("only").alias("unique_fails"), *[total("removed", x).alias(f"{x}_lost") for x in lost])
    orders = F.create_map(*[F.lit(x) for i in range(1, size + 1) for x in (i, math.factorial(size - i))])
    shares = found.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders[F.col("step")]).cast("long").alias("shapley"))
    found = found.join(shares, ["part", "filter"])
    whole = steps.filter(F.col("step") == size).select(F.col("prefix").alias("filter_order")).distinct()
    places = whole.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size)))).withColumn(
        "prefix", F.substring("filter_order", F.lit(1), F.col("step")))
    return found.drop("step", "filter").join(F.broadcast(places), "prefix").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{x}_lost" for x in lost], "shapley")
