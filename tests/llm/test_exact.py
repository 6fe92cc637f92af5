"""Operators with one right answer, against plain Python."""

import hashlib
import itertools
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rigsense.llm import decontamination, graph, packing, pii, quality_rules, queries, rans, sharding, simhash, token_files, tokens
from rigsense.llm.base import text_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE_BPE, WORD_BPE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(params=["odd", "small", "empty"])
def documents(request, odd_documents, small_documents, empty_documents):
    return {"odd": odd_documents, "small": small_documents, "empty": empty_documents}[request.param]


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


# ---------------------------------------------------------------------------- sharding
def test_sharding(documents):
    given, found = rows_of(documents), sharding.shard(documents, 8).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((k, size(t), zlib.crc32((t or "").encode())) for k, t in given) == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found)
    groups = defaultdict(list)
    for k, t in given:
        groups[t].append(k)
    first = lambda ks: min((k for k in ks if k is not None), default=None)
    digest = lambda t: "null" if t is None else hashlib.sha256(t.encode()).hexdigest()
    order = sorted(groups, key=lambda t: ((first(groups[t]) is not None, first(groups[t]) or 0), digest(t)))
    sizes = [size(t) * len(groups[t]) for t in order]

    def needed(capacity):
        used, full = 1, 0
        for s in sizes:
            if s > capacity:
                return 99
            used, full = (used + 1, s) if full + s > capacity else (used, full + s)
        return used

    best = next((c for c in range(max(sizes, default=0), sum(sizes) + 1) if needed(c) <= 8), 0)
    totals, slots = Counter(), defaultdict(list)
    for r in found:
        totals[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(totals.values(), default=0) == best
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shards = defaultdict(set)
    texts = {(k, size(t), zlib.crc32((t or "").encode())): t for k, t in given}
    for r in found:
        shards[texts[r["doc_id"], r["size"], r["text_crc32"]]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


@pytest.mark.parametrize("seed", range(4))
def test_minimax_reads_few_ends(spark, monkeypatch, seed):
    """With few bins and few ends read one by one, the search still finds the exact cuts."""
    monkeypatch.setattr(sharding, "BINS", 16)
    monkeypatch.setattr(sharding, "EXACT", 20)
    rng = np.random.default_rng(seed)
    sizes = np.where(rng.random(3000) < 0.01, rng.integers(1, 20000, 3000), rng.integers(1, 60, 3000))
    ends = np.cumsum(sizes)
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame([(int(e),) for e in ends], "end long"), "end", 7)

    def greedy(c):
        at, out = 0, []
        for _ in range(7):
            i = np.searchsorted(ends, at + c, side="right")
            at = int(ends[i - 1]) if i else 0
            out.append(at)
        return out

    lo, hi = int(sizes.max()), int(ends[-1])
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if greedy(mid)[-1] == ends[-1] else (mid + 1, hi)
    assert capacity == lo and cuts == sorted(set(greedy(lo)))


# ------------------------------------------------------------------------------ tokens
@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_tokens_are_the_librarys(documents, path):
    texts = [t for _, t in rows_of(documents)]
    ids, counts = tokens.encode(pa.array(texts, pa.string()), path)
    whole = Tokenizer.from_file(path)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at:at + n].tolist() == whole.encode(text or "", add_special_tokens=False).ids, text
        at += n


@pytest.mark.parametrize("n,values", [(0, 5), (1, 5), (63, 1), (1000, 3), (70_000, 50_000), (600_000, 300)])
def test_rans_round_trip(n, values):
    ids = np.minimum(np.random.default_rng(n).geometric(0.01, n), values).astype(np.uint32)
    table = rans.Frequencies(np.bincount(ids, minlength=values + 1))
    body = rans.encode_block(ids, [None, 7], [n // 2, n - n // 2], table)
    block = rans.Block(body)
    assert (block.ids(table) == ids).all() and block.keys == [None, 7]
    if n > 1000:
        last = block.segments - 1
        assert (block.segment(last, table) == ids[last * rans.CHECK_ROWS * block.lanes:]).all()
        bad = bytearray(body)
        bad[-3] ^= 1
        with pytest.raises(ValueError):
            rans.Block(bytes(bad)).ids(table)


@pytest.mark.parametrize("size", [0, 5, 70_000])
def test_frequency_table_is_stored_with_a_checksum(size):
    table = rans.Frequencies(np.random.default_rng(size).poisson(2, size))
    raw = table.to_bytes()
    again = rans.Frequencies.from_bytes(raw)
    assert all((getattr(again, c) == getattr(table, c)).all() for c in ("each", "below", "owner"))
    for bad in (raw[:-1] + bytes([raw[-1] ^ 1]), raw[:3]):
        with pytest.raises(ValueError):
            rans.Frequencies.from_bytes(bad)


def test_token_files(spark, documents, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "PART_IDS", 5000)
    path = token_files.write(documents, BYTE_BPE, 2, path=str(tmp_path / "files"))
    light = {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read(spark, path).collect()}
    found = token_files.read(spark, path, with_ids=True).orderBy("start").collect()
    assert light == {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found}
    whole = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for k, t in rows_of(documents):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want[k, len(ids), crc(ids)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert keys == sorted(keys)
    at = 0
    for r in found:
        assert r["start"] == at and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        at += r["n_tokens"]


def test_token_files_with_documents_over_checkpoints(spark, tmp_path):
    """Documents of up to 1.3 million ids: over checkpoints, several of them, and over the size of a block."""
    sizes = [1, 30_000, 262_000, 5, 1_300_000, 0, 90_000, 200_000, 700_000]
    texts = [(k, " ".join(f"{(k + 7) * i % 977}" for i in range(n // 2))) for k, n in enumerate(sizes)]
    path = token_files.write(spark.createDataFrame(texts, "doc_id long, text string"), BYTE_BPE, 2, path=str(tmp_path / "files"))
    blocks = spark.read.parquet(f"{path}/blocks")
    assert max(rans.Block(bytes(r["body"])).segments for r in blocks.select("body").collect()) > 3
    light = {r["doc_id"]: r for r in token_files.read(spark, path).collect()}
    full = {r["doc_id"]: r for r in token_files.read(spark, path, with_ids=True).collect()}
    whole, at = Tokenizer.from_file(BYTE_BPE), 0
    for k, text in texts:
        ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
        assert (light[k]["start"], light[k]["n_tokens"], light[k]["ids_crc32"]) == (at, len(ids), crc(ids))
        assert bytes(full[k]["ids"]) == np.array(ids, "<u4").tobytes() and full[k]["ids_crc32"] == crc(ids)
        at += len(ids)


def test_token_files_of_nothing(spark, documents, tmp_path):
    path = token_files.write(documents.limit(0), BYTE_BPE, 2, path=str(tmp_path / "files"))
    assert token_files.read(spark, path).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert token_files.read(spark, path, with_ids=True).count() == 0


# ----------------------------------------------------------------------------- packing
@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    room = [10, 64, 512, 2048, 2048, 300][seed]
    counts = np.zeros(room + 1, np.int64)
    counts[1:] = rng.poisson([0.5, 3, 2, 0.3, 20, 400][seed], room)
    slots, sequences = packing.plan(counts, room)
    used, ranks = defaultdict(list), defaultdict(list)
    for length, rank, times, first, offset in slots:
        ranks[length] += range(rank, rank + times)
        for k in range(times):
            used[first + k].append((offset, length))
    assert all(sorted(ranks[n]) == list(range(counts[n])) for n in range(room + 1))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    least = max(-(-int((counts * np.arange(room + 1)).sum()) // room), int(counts[room // 2 + 1:].sum()))
    assert len(used) == sequences <= least + max(2, least // 12)


@pytest.mark.parametrize("most", [1 << 24, 3])
def test_sum_index_finds_every_complement(monkeypatch, most):
    """What the index says is left to fill a gap, against all combinations of up to three lengths."""
    monkeypatch.setattr(packing, "MAX_PAIRS", most)
    rng = np.random.default_rng(3)
    for _ in range(60):
        room = int(rng.integers(4, 40))
        left = rng.integers(0, 4, room + 1) * (rng.random(room + 1) < 0.5)
        left[0] = 0
        index = packing.SumIndex(np.flatnonzero(left))
        for length in np.flatnonzero(left).tolist():
            spare = left.copy()
            spare[length] -= 1
            lengths = np.flatnonzero(spare).tolist()
            want = {c for n in range(4) for c in itertools.combinations_with_replacement(lengths, n)
                    if sum(c) == room - length and all(spare[m] >= c.count(m) for m in c)}
            found = [tuple(sorted(m[1:])) for m in index.complements(length, room - length, left)]
            assert len(found) == len(set(found)) and set(found) == want
        counts = left.copy()
        for length in np.flatnonzero(counts).tolist()[::-1]:
            for members in index.complements(length, room - length, counts):
                times = min(int(counts[m]) // members.count(m) for m in set(members))
                assert times > 0 and sum(members) == room
                for m in members:
                    counts[m] -= times


def test_packing(documents):
    found = packing.with_crc(packing.pack(documents, WORD_BPE)).collect()
    whole = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for k, t in rows_of(documents):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for p, lo in enumerate(range(0, len(ids), 2048)):
            want[k, p, lo, len(ids[lo:lo + 2048]), crc(ids[lo:lo + 2048])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048


# --------------------------------------------------------------------- decontamination
def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, who = set(), set()
    for name, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").translate(LOWER))
        n = min(10, len(own))
        grams = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                who.add("" if name is None else str(name))
    return len(words), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()


@pytest.mark.parametrize("most", [500_000, 40])
def test_decontamination(spark, documents, small, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MAX_WINDOWS", most)
    extra = [(100, "one two three four five six seven eight nine ten eleven"), (101, "Two Words"), (102, None), (103, "..."), (None, "hello"), (101, "two words")]
    bench = spark.read.parquet(f"{small}/benchmark.parquet").unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    found = decontamination.report(decontamination.find(documents.withColumn("n_words", F.lit("old")), bench)).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in found)
    assert got == Counter((k, *brute_hits(t, items)) for k, t in rows_of(documents))


def test_decontamination_spans(spark, documents, small):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (2, "words")], "item_id long, text string")
    left = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(documents.filter("doc_id in (6, 9, 11)"), bench).collect()}
    if 9 in left and left[9] and left[9].startswith("one"):
        assert left[9] == "one  twelve" and left[6] == "two " and left[11] == "one  twelve more  follow here"
    clean = decontamination.clean_documents(documents, bench)
    assert clean.columns == documents.columns
    assert all(brute_hits(r["text"], [(1, "two three four five six seven eight nine ten eleven"), (2, "words")])[1] == 0 for r in clean.collect())
    assert decontamination.find(documents, bench.limit(0)).filter("size(hit_items) > 0").isEmpty()


# ----------------------------------------------------------------------- quality rules
def test_quality_rules(documents):
    found = quality_rules.measure(documents.withColumn("n_words", F.lit(1))).collect()

    def brute(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        often = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = len(words)
        failed = n < 50 or 100 * len(inside) > 50 * n
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r["doc_id"], *[r[c] for c in names]) for r in found) == Counter((k, *brute(t)) for k, t in rows_of(documents))


def brute_ratios(rows, trusted):
    """The log ratio of each text, from plain counts."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of_long = lambda v, seed: xxhash.xxh64_intdigest(struct.pack("<q", v), seed)

    def grams(text):
        words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return words + [signed(of_long(b, of_long(a, 42))) for a, b in zip(words, words[1:])]

    size = sum(len((t or "").encode()) for _, t in rows)
    classes = 1 << max(10, math.ceil(math.log2(quality_rules.CLASSES * math.sqrt(size) + 1)))
    raw, good = Counter(), Counter()
    for key, text in rows:
        raw.update(grams(text))
        if key in trusted:
            good.update(grams(text))
    n, cut = sum(raw.values()), quality_rules.LEADER * sum(raw.values()) / classes
    leader = {}
    for gram, count in raw.items():
        if count >= cut:
            leader[gram % classes] = max(leader.get(gram % classes, (0, 0)), (count, gram))
    leaders = {c: g for c, (_, g) in leader.items()}
    outcome = lambda g: (g % classes, leaders.get(g % classes) == g)
    raws, goods = Counter(), Counter()
    for g, c in raw.items():
        raws[outcome(g)] += c
        goods[outcome(g)] += good[g]
    prior = quality_rules.PRIOR * classes

    def weight(o):
        share = (raws[o] + 1) / (n + 2 * classes)
        return math.log((goods[o] + share * prior) / (share * (sum(goods.values()) + prior)))

    weights = {o: weight(o) for o in raws}
    return leaders, [(k, t, sum(weights[outcome(g)] for g in grams(t)) / len(grams(t)) if grams(t) else 0.0) for k, t in rows]


@pytest.mark.parametrize("block", [None, 512])
def test_log_ratio(documents, monkeypatch, block):
    """Every verdict against plain counts, with one block of classes and with several passes."""
    if block:
        monkeypatch.setattr(quality_rules, "BLOCK", block)
    trusted = documents.filter("doc_id % 3 = 0").select("doc_id")
    judged = quality_rules.judge(documents.select("doc_id", "text"), quality_rules.log_ratios(documents, trusted)).collect()
    leaders, want = brute_ratios(rows_of(documents), {r[0] for r in trusted.collect()})
    assert leaders or not want
    key = lambda x: repr(x[:2])
    for (k, t, ratio), r in zip(sorted(want, key=key), sorted(judged, key=lambda r: key((r["doc_id"], r["text"])))):
        assert (k, t) == (r["doc_id"], r["text"]) and r["log_ratio"] == pytest.approx(ratio, abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["log_ratio"] >= quality_rules.MIN_RATIO)
    assert len(judged) == len(want)


def test_without_trusted_documents(small_documents):
    weights = quality_rules.log_ratios(small_documents, small_documents.limit(0).select("doc_id"))
    assert all(abs(r["log_ratio"]) < 1e-9 for r in quality_rules.judge(small_documents, weights).collect())


# --------------------------------------------------------------------------------- PII
@pytest.mark.parametrize("seed", range(4))
def test_spans_apart(spark, seed):
    rng = np.random.default_rng(seed)
    spans = lambda n: sorted((int(a), int(a + 1 + rng.integers(6))) for a in rng.choice(400, n, replace=False))
    base, other = spans(40), spans(120)
    row = lambda xs: [("k", a, b, "v") for a, b in xs]
    df = spark.createDataFrame([(row(base), row(other)), ([], row(other)), (row(base), [])], f"base {pii._SPAN}, other {pii._SPAN}")
    got = [[(s["start"], s["end"]) for s in r[0]] for r in df.select(pii._apart(F.col("other"), F.col("base"))).collect()]
    assert got == [[(a, b) for a, b in other if all(d <= a or b <= c for c, d in base)], other, []]


def test_a_long_text_dense_in_spans(spark):
    """A long text of nothing but spans ends, and base spans are those of the patterns."""
    text = "a@b.cc x@y 10.0.0.1 " * 5_000
    found = pii.find(spark.createDataFrame([(1, text), (2, "short a@b.cc")], "doc_id long, text string")).collect()
    long = next(r for r in found if r["doc_id"] == 1)
    assert [tuple(s) for s in long["base_spans"]] == brute_pii(text) and len(long["all_spans"]) >= 10_000


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m)]


def test_base_spans(spark, documents):
    odd = ["a" * 20_000 + "@x.y", "a@b" + ".c" * 9000 + " 1" * 9000, "1." * 5000, "+1 2" * 500, "😀é a@b.co 1.1.1.1 😀 0255.1.1.1 256.1.1.1 00.00.00.00",
           "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112", "mail a@b.c, " * 700]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = documents.select("doc_id", "text").union(more)
    found = pii.find(both).collect()
    got = Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["base_spans"])) for r in found)
    assert got == Counter((k, tuple(brute_pii(t))) for k, t in rows_of(both))
    for r in found:
        assert {tuple(s) for s in r["base_spans"]} <= {tuple(s) for s in r["all_spans"]}


def test_bootstrapping(spark):
    seeds = [(i, f"please call me at +1 (555) 010-{1000 + i} today") for i in range(12)]
    hidden = [(100, "please call me at (555) 010-7777 today"), (101, "size (100) 200-3000 boxes"), (102, "please call nobody today")]
    rows = spark.createDataFrame(seeds + hidden, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(rows).collect()}
    assert [tuple(s) for s in found[100]["all_spans"]] == [("phone", 18, 32)]
    assert not found[101]["all_spans"] and not found[102]["all_spans"]
    masked = {r["doc_id"]: r["text"] for r in pii.mask(rows).collect()}
    assert masked[100] == "please call me at <PHONE> today" and masked[3] == "please call me at <PHONE> today" and masked[101] == hidden[1][1]


def test_numbers_in_supported_contexts(spark):
    """Plain digits, local numbers, long numbers and unforeseen separators are found where the context is, and nowhere else."""
    seeds = [(i, f"please call me at +1 (555) 010-{1000 + i} today") for i in range(12)]
    values = ["5550107777", "5550177", "555-0177", "55501777", "555010777712345", "555/010/7777"]
    hidden = [(100 + i, f"please call me at {v} today") for i, v in enumerate(values)]
    other = [(200 + i, f"order number {v} was shipped") for i, v in enumerate(values)] + [(300, "please call me at 9 today"), (301, "please call me at noon today")]
    rows = spark.createDataFrame(seeds + hidden + other, "doc_id long, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["all_spans"]] for r in pii.find(rows).collect()}
    for i, v in enumerate(values):
        assert found[100 + i] == [("phone", 18, 18 + len(v))], v
    assert not any(found[k] for k, _ in other)


def test_mask(documents):
    masked = pii.mask(documents)
    assert masked.columns == documents.columns and masked.count() == documents.count()
    assert not [1 for _, t in rows_of(masked) if [s for s in brute_pii(t) if s[0] == "email"]]


# ----------------------------------------------------------------------------- SimHash
def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin(a ^ b).count("1") <= 3 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_near_duplicates(documents):
    given = [(k, brute_print(t)) for k, t in rows_of(documents)]
    roots = brute_roots({p for _, p in given})
    least = {}
    for k, p in given:
        if k is not None:
            least[roots[p]] = min(k, least.get(roots[p], k))
    found = simhash.near_duplicates(documents).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == Counter((k, f"{p:016x}", least.get(roots[p])) for k, p in given)
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least.get(c) for c in set(roots.values()))


@pytest.mark.parametrize("crowd", [2, 10_000])
def test_links_in_crowds(spark, crowd):
    """Dense clusters, chains and lone values: the same components with and without flipping bits."""
    rng = np.random.default_rng(5)
    values = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    for center in list(values)[:4]:
        for _ in range(40):
            flips = rng.choice(64, rng.integers(1, 4), replace=False)
            values.add(center ^ sum(1 << int(b) for b in flips))
    chain = 12345
    for b in range(0, 60, 3):
        chain ^= 7 << b
        values.add(chain)
    signed = {v - (1 << 64) if v >= 1 << 63 else v: v for v in values}
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(prints, crowd)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for s, v in signed.items():
        got[roots.get(s, s)].add(v)
    for v, r in brute_roots(values).items():
        want[r].add(v)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {n: r for n, r in root.items() if n != r}


def test_text_bytes_of_slices():
    data, offsets = text_bytes(pa.array(["a", None, "é", ""]).slice(1))
    assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 2, 2]


def test_query_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pieces_take_one_worker_a_task(small_documents):
    """Chained workers change places from task to task, so that each comes to hold a tokenizer."""
    plan = packing.pieces(small_documents, WORD_BPE, 0, 2048)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
