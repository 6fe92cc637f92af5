"""Filter audit, byte dedup and Merkle manifest against plain Python and SQL."""

import hashlib
import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from rigsense.llm import filter_audit, merkle, queries, suffix_dedup


def answer(df, columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


@pytest.mark.parametrize("name", ["op5_decontamination", "op11_filter_audit", "op13_merkle_manifest"])
def test_queries_against_their_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    found = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, small)
    assert sorted(columns) == sorted(df.columns)
    assert answer(df, columns) == sorted(map(repr, found.fetchall()))


# -------------------------------------------------------------------------- filter audit
def brute_audit(rows, marks, letters="ABCDE"):
    """rows: (part, failed letters, key); marks: key -> (good, toxic)."""
    out = {}
    orders = ["".join(p) for p in itertools.permutations(letters)]
    for part in {p for p, _, _ in rows}:
        own, total = [(f, *marks.get(k, (False, False))) for p, f, k in rows if p == part], dict.fromkeys(letters, 0)
        for order in orders:
            left = own
            for i, x in enumerate(order):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                failing = sum(x in r[0] for r in own)
                only = sum(r[0] == {x} for r in own)
                out[part, order, i + 1] = [len(left), len(gone), failing - len(gone), only, sum(r[1] for r in gone), sum(r[2] for r in gone)]
                total[x] += len(gone)
        for order in orders:
            for i, x in enumerate(order):
                out[part, order, i + 1].append(total[x])
    return sorted(repr((*k, *v)) for k, v in out.items())


def test_audit_of_odd_documents(spark, odd_documents):
    rows = odd_documents.collect()
    labels = {3: (True, False), 9: (False, True), 10: (True, True), None: (True, True)}
    spark_labels = spark.createDataFrame([(k, int(g), int(t)) for k, (g, t) in labels.items()] + [(3, 0, None)], "doc_id long, quality int, toxic int")

    def failed(r):
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        keys = [x["doc_id"] for x in rows if (x["text"] or "") == text and x["doc_id"] is not None]
        tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": r["doc_id"] is not None and r["doc_id"] > min(keys)}
        return {x for x, y in tests.items() if y}

    own = filter_audit.text_failures()
    flagged = odd_documents.select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), *[c.alias(n) for n, c in own.items()])
    flagged = filter_audit.copies(flagged, "digest", "doc_id", "E").join(
        spark_labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")), "doc_id", "left")
    counted = filter_audit.cells(flagged, F.col("lang"), [F.col(x) for x in "ABCDE"], {"good": F.col("good"), "toxic": F.col("toxic")})
    found = filter_audit.audit(counted, "ABCDE", ["good", "toxic"])
    marks = {k: v for k, v in labels.items() if k is not None}  # a null key meets no label
    assert answer(found, found.columns) == brute_audit([(r["lang"] or "", failed(r), r["doc_id"]) for r in rows], marks)


def test_audit_of_nothing(spark, empty_documents):
    flagged = empty_documents.select("lang", *[c.alias(n) for n, c in filter_audit.text_failures().items()])
    counted = filter_audit.cells(flagged, F.col("lang"), [F.col(x) for x in "ABCD"], {})
    assert filter_audit.audit(counted, "ABCD").isEmpty()


@pytest.mark.parametrize("share", [1, 1000])
def test_hot_and_cold_copies(spark, monkeypatch, share):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", share)
    df = spark.createDataFrame([(i, "same" if i < 50 else f"t{i // 2}") for i in range(100)] + [(0, "same"), (None, "same")], "doc_id long, digest string")
    got = {(r["doc_id"], r["digest"]): r["copy"] for r in filter_audit.copies(df, "digest", "doc_id", "copy").collect()}
    assert len(got) == 101 and all(v == (k is not None and (0 < k < 50 or k >= 50 and k % 2 == 1)) for (k, _), v in got.items())


# ---------------------------------------------------------------------------- byte dedup
def brute_bytes(rows, length):
    """(key, text) -> kept bytes and removed runs; rows of one key and text are one document."""
    seen, out = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p:p + length] in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(data[p:p + length])
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[key, text] = bytes(b for b, g in zip(data, gone) if not g), runs
    return out


def check_bytes(df, found, length):
    keys = lambda r: (-(1 << 63) if r["doc_id"] is None else r["doc_id"])
    tied = df.withColumn("tie", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 20))).select("doc_id", "text", "tie").distinct().collect()
    want = brute_bytes([(r["doc_id"], r["text"]) for r in sorted(tied, key=lambda r: (keys(r), r["tie"]))], length)
    rows = found.collect()
    assert len(rows) == df.count()
    for r in rows:
        kept, runs = want[r["doc_id"], r["text"]]
        assert bytes(r["kept"]) == kept and [tuple(x) for x in r["removed"]] == runs and r["n_bytes"] == len((r["text"] or "").encode())


@pytest.mark.parametrize("length,seed,many", [(100, 50, 32), (20, 7, 2), (9, 8, 1)])
def test_bytes(documents, monkeypatch, length, seed, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    df = documents.withColumns({"kept": F.lit("mine"), "doc": F.lit(1), "start": F.lit(2)})
    found = suffix_dedup.deduplicate(df, length=length, seed=seed)
    assert set(documents.columns) | {"doc", "start", "n_bytes", "removed", "kept"} == set(found.columns)
    check_bytes(documents, found, length)


def test_bytes_of_a_shared_line_and_a_long_text(spark):
    """A line in every document with neighbours of its own, one period over a long text, cuts within characters."""
    line = "the same licence line stands in every document of this table, whatever else it says, and is longer than a window. "
    rows = [(i, f"{i} begins {i * 7}. {line}{i * i} ends {i} é" * (1 + i % 3)) for i in range(200)]
    rows += [(500, "ab" * 5000 + "x" * 3000), (501, "é" * 400), (502, "xé" + "é" * 300), (503, None), (504, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check_bytes(df, suffix_dedup.deduplicate(df), 100)


@pytest.fixture(params=["odd", "small", "empty"])
def documents(request, odd_documents, small_documents, empty_documents):
    return {"odd": odd_documents, "small": small_documents.filter("doc_id < 60"), "empty": empty_documents}[request.param]


# ------------------------------------------------------------------------------- Merkle
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves, fanout):
    """The top, and for each leaf the siblings left and right per level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i - i % fanout:i - i % fanout + fanout]
            paths[k].append(("".join(run[:i % fanout]), "".join(run[i % fanout + 1:])))
        level = [sha("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], paths


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_merkle(spark, documents, fanout):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    groups = {}
    for r in documents.collect():
        groups.setdefault(r["source"], []).append((-1 if r["doc_id"] is None else r["doc_id"], sha("".join(value(r[c]) for c in names))))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([h for _, h in sorted(groups[s])], fanout) for s in sources}
    root, ways = brute_tree([trees[s][0] for s in sources], fanout) if sources else (None, [])
    want = [(h, trees[s][0], root, tuple(p + w)) for s, w in zip(sources, ways) for (_, h), p in zip(sorted(groups[s]), trees[s][1])]
    rows = documents.withColumns({"leaf": merkle.leaf([F.col(c) for c in names]), "place": F.lit("mine"), "path": F.lit("mine"), "tree": F.lit(1)})
    manifest = merkle.build(rows, "leaf", "source", "doc_id", fanout)
    proved = merkle.prove(manifest)
    found = [(r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["path"]))) for r in proved.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr) and manifest.root == root
    folded = proved.select(merkle.fold(F.col("leaf"), F.col("path")).alias("up"), merkle.fold(F.lit("00"), F.col("path")).alias("bad"), "root", "place").collect()
    assert all(r["up"] == r["root"] != r["bad"] and r["place"] == "mine" for r in folded)


def test_merkle_of_long_groups_over_many_partitions(spark):
    rows = spark.range(700).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("g"), "id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        proved = merkle.prove(merkle.build(rows.repartition(11), "h", "g", "id", 4)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = {}
    for i in range(700):
        groups.setdefault("hot" if i % 3 else f"s{i % 40}", []).append(sha(str(i)))
    trees = {g: brute_tree(h, 4) for g, h in groups.items()}
    root, _ = brute_tree([trees[g][0] for g in sorted(groups)], 4)
    assert len(proved) == 700 and all(r["subroot"] == trees[r["g"]][0] and r["root"] == root for r in proved)
    own = {h: p for g, hs in groups.items() for h, p in zip(hs, trees[g][1])}
    assert all([tuple(x) for x in r["path"]][:len(own[r["h"]])] == own[r["h"]] for r in proved)
