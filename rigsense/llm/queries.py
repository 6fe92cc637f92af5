"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigsense.llm import (
    decontamination, filter_audit, language_id, merkle, packing, pii, quality_mil, quality_rules, sharding, simhash,
    suffix_dedup, token_files, toxicity,
)
from rigsense.llm.base import crc_remainder, stage, table

END_ID = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARDS = 8


def _held_out(divisor: int, remainder: int, key: str = "doc_id") -> Column:
    """Rows that no fit may see; a null key is not held out."""
    return F.coalesce(crc_remainder(F.col(key), divisor) == remainder, F.lit(False))


def _learned(divisor: int, remainder: int, key: str = "doc_id") -> Column:
    return F.coalesce(crc_remainder(F.col(key), divisor) != remainder, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = language_id.learn(documents, _learned(4, 2))
    return language_id.predict(documents.select("doc_id", "text"), net).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_files.read(spark, path)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.report(decontamination.find(documents, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    judged = quality_rules.judge(documents, quality_rules.log_ratios(documents, trusted))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_mil.learn(documents, table(spark, sf_dir, "labels"), _learned(5, 0))
    return quality_mil.predict(documents, weights).select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), carry_text=False)
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.text_of(F.col("base_spans")), 256).alias("base_sha256"),
        pii.text_of(F.col("all_spans")).alias("spans"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"), _learned(4, 2))
    return toxicity.predict(documents, model).select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted", "toxic_spans")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    own = filter_audit.text_failures()
    body = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.col("lang").alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), *[c.alias(n) for n, c in own.items()])
    rows = stage(rows, "audit-rows")  # some bytes a document
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = filter_audit.copies(rows, "digest", "doc_id", "E").join(marks, "doc_id", "left")
    letters = "ABCDE"
    counted = filter_audit.cells(rows, F.col("part"), [F.col(x) for x in letters], {"good": F.col("good"), "toxic": F.col("toxic")})
    return filter_audit.audit(stage(counted, "audit-cells"), letters, ["good", "toxic"])


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    whole = lambda text: merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    altered = F.coalesce(crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    rows = documents.select(
        "doc_id", "source", whole(F.col("text")).alias("leaf"),
        F.when(altered, whole(F.translate("text", _UPPER, _LOWER))).alias("tampered"))
    proved = merkle.prove(merkle.build(rows, "leaf", "source", "doc_id"))
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    proved = proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language_id, op2_sharding, op3_token_ids, op4_packing, op5_decontamination, op6_quality_rules,
        op7_quality_classifier, op8_pii, op9_toxicity, op10_simhash, op11_filter_audit, op12_suffix_dedup,
        op13_merkle_manifest,
    )
}

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _merkle_sql(low: int, high: int) -> str:
    """SQL for trees of at most ``low`` levels under the subroots (16 ** low rows a source) and ``high`` above."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda t: "sha256(" + " || ".join([*(value(c) for c in ("doc_id", "source", "lang", "n_chars")), value(t)]) + ")"
    crc = (
        "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
        "lambda r, b: list_reduce(list_concat([xor(r, b)], range(8)), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))))")
    parts = [f"""d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
a0 AS (SELECT g, i, n, leaf AS h FROM l)"""]
    parts += [
        f"a{k + 1} AS (SELECT g, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h "
        f"FROM a{k} GROUP BY g, i // 16, n)" for k in range(low)]
    parts.append(f"b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h, g AS name FROM a{low})")
    parts += [
        f"b{k + 1} AS (SELECT g, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h "
        f"FROM b{k} GROUP BY g, i // 16, n)" for k in range(high)]
    parts.append("f0 AS (SELECT l.*, b0.i AS j, b0.h AS subroot, coalesce(tampered, leaf) AS f, '' AS proof FROM l JOIN b0 ON b0.name = l.g)")
    steps = [(f"a{k}", "l.g", "l.i", 16 ** k) for k in range(low)] + [(f"b{k}", "''", "l.j", 16 ** k) for k in range(high)]
    for k, (nodes, g, i, scale) in enumerate(steps):
        around = [f"coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i {sign} {i} // {scale}), '')" for sign in "<>"]
        parts.append(
            f"f{k + 1} AS (SELECT doc_id, leaf, l.g, l.i, l.j, subroot, CASE WHEN max(t.n) > 1 THEN sha256({around[0]} || f || {around[1]}) ELSE f END AS f, "
            f"proof || {around[0]} || {around[1]} AS proof FROM f{k} AS l JOIN {nodes} AS t ON t.g = {g} AND t.i // 16 = {i} // {16 * scale} "
            f"GROUP BY doc_id, leaf, l.g, l.i, l.j, subroot, f, proof)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM f{len(steps)}, b{high}"""


ORACLE: dict[str, str] = {
    "op5_decontamination": f"""
WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
long_item AS (SELECT item_id, w, least(10, len(w)) AS n FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM long_item, unnest(range(1, len(w) - n + 2)) AS t(i)),
doc AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT DISTINCT r, i, place.n, item_id FROM place JOIN win USING (n, gram)),
word AS (SELECT r, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(k) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN items USING (r)""",
    "op11_filter_audit": r"""
WITH RECURSIVE letter AS (SELECT chr(CAST(65 + i AS INTEGER)) AS l, 1 << i AS b FROM range(5) AS t(i)),
perm(filter_order, used) AS (
  SELECT '', 0 UNION ALL SELECT filter_order || l, CAST(used | b AS INTEGER) FROM perm JOIN letter ON used & b = 0),
step AS (SELECT filter_order, CAST(i AS INTEGER) AS step, 1 << (ascii(substr(filter_order, i, 1)) - 65) AS bit,
    list_sum(list_transform(range(1, i), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))) AS before
  FROM perm, range(1, 6) AS t(i) WHERE length(filter_order) = 5),
doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
mark AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, good, toxic, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask
  FROM doc LEFT JOIN mark USING (doc_id)),
cell AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM failed GROUP BY part, mask),
found AS (SELECT part, filter_order, step, bit,
    sum(n) FILTER (WHERE mask & (coalesce(before, 0) | bit) = 0) AS kept,
    sum(n) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit != 0) AS removed,
    sum(n) FILTER (WHERE mask & coalesce(before, 0) != 0 AND mask & bit != 0) AS redundant,
    sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(g) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit != 0) AS good_lost,
    sum(x) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit != 0) AS toxic_lost
  FROM cell, step GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found""",
    "op13_merkle_manifest": _merkle_sql(4, 3),
}
