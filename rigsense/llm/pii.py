"""Personal data: fixed patterns, and bootstrapped extraction from contexts. Column expressions only.

Seeds are what the fixed patterns find: email, ip, card and phone. Candidates look like one of these
but fail its pattern or its check (a card number with a wrong check digit, 7 to 15 digits without a
plus, with or without separators, an address without a domain, four number groups that are no
address). One run may be a candidate of several kinds; the first accepted kind as listed gets it.

Lexical patterns are the words around an instance: the word before, the word after, both, and the two
words before. Patterns and instances form a graph. In each round a pattern's score is the summed score
of its different instances over their number plus one, if enough seeds support it, and a candidate's
score is the noisy-or of its patterns. A candidate occurrence becomes a span if one of its patterns
ends with at least ``ACCEPT``. Base spans stay, and no candidate overlaps one.

Accepted patterns also read what no candidate's shape has foreseen: a slot is all from the first to
the last digit between two words that have no letter between them. If the two words are an accepted
both-sided pattern and the slot has as many digits as the kind can have (``SLOT_DIGITS``), it is a
span. Slots do not take part in the scoring. An address has letters, so it has no slot.

Regular expressions are written so that no text makes them slow or deep: runs start where the run
starts (or where the match before ended) and are possessive, which changes no match. Spans are compared by
merging ordered lists, so a text's cost grows with its length and not with the square of its spans.

Defined results: a null text is an empty one and has no spans. Repeated rows and rows with a null key
each get their row. An empty table gives an empty result; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigsense.llm.base import new_name, stage

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
SUPPORT = 5  # different seeds that a pattern needs
ACCEPT = 0.8  # score from which a pattern finds new identifiers
CONTEXT = 48  # characters on either side that are read for words
CHUNK = 4096  # characters of a piece of text from which contexts are read
SLOT_DIGITS = {"ip": (4, 12), "card": (12, 19), "phone": (7, 15)}
BLOCK = 256  # running sums and the like are made block by block
# Fixed patterns of the four kinds.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Candidates: the same kinds, looser.
LOOSE = {
    "email": r"(?:\G|(?<![^\s@]))[^\s@]++@[^\s@]++",
    "ip": r"(?:\G|(?<![0-9.]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"(?<![0-9+(])[0-9(](?:[\x20().-]*+[0-9])++",
}
_SLOT = r"(?:\G|(?<![0-9]))[0-9]++(?:[^\p{L}0-9]++[0-9]++)*+"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")
    each = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    size = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(size.between(13, 19), _luhn(value)).otherwise(F.lit(False))
    return size.between(9, 15) if kind == "phone" else F.lit(True)


def _likely(kind: str, value: Column) -> Column:
    size = F.length(_digits(value))
    if kind == "card":
        return size.between(13, 19)
    if kind == "phone":
        return size.between(7, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda would compute an outer expression on every call."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def running(values: Column, first: int, op=lambda a, b: a + b) -> Column:
    """``op`` over all integers before each element, block by block so that long arrays stay cheap."""
    def steps(parts: Column, begin: Column) -> Column:
        step = lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
        return F.aggregate(parts, F.struct(begin.cast("int").alias("at"), F.array().cast("array<int>").alias("all")), step, lambda s: s["all"])

    def blocks(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.slice(v, at, BLOCK))

    def joined(cut: Column) -> Column:
        heads = steps(F.transform(cut, lambda b: F.aggregate(b, F.lit(first), lambda s, x: op(s, x))), F.lit(first))
        return F.flatten(F.zip_with(cut, heads, steps))

    return _let(values, lambda v: _let(blocks(v), joined))


def _matches(text: Column, pattern: str, kind: str, ok) -> Column:
    """All matches that pass ``ok``, in order: kind, start and end in code points, and value."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(p: Column) -> Column:
        steps = F.zip_with(F.slice(p["gaps"], 1, F.size(p["found"])), p["found"], lambda g, m: F.length(g) + F.length(m))
        return F.transform(F.arrays_zip(running(steps, 0).alias("before"), p["gaps"].alias("gap"), p["found"].alias("value")), lambda x: F.struct(
            F.lit(kind).alias("kind"), (x["before"] + F.length(x["gap"])).cast("int").alias("start"),
            (x["before"] + F.length(x["gap"]) + F.length(x["value"])).cast("int").alias("end"), x["value"].alias("value"),
        ))

    rows = _let(parts, placed)
    return F.filter(rows, lambda x: x["value"].isNotNull() & ok(x["value"]))


_FAR = (1 << 31) - 1
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that overlap no span of ``base``: one merge of both by start, no pairs."""
    side = lambda xs, mine: F.transform(xs, lambda s: F.struct(s["start"].alias("at"), F.lit(mine).alias("mine"), s["end"].alias("end"), s.alias("s")))

    def free(merged: Column) -> Column:
        ends = running(F.transform(merged, lambda x: F.when(x["mine"] == 0, x["end"]).otherwise(-1)), -1, F.greatest)
        starts = F.reverse(running(F.transform(F.reverse(merged), lambda x: F.when(x["mine"] == 0, x["at"]).otherwise(_FAR)), _FAR, F.least))
        rows = F.arrays_zip(merged.alias("x"), ends.alias("ends"), starts.alias("starts"))
        return F.filter(rows, lambda r: (r["x"]["mine"] == 1) & (r["ends"] <= r["x"]["at"]) & (r["starts"] >= r["x"]["end"]))

    def alone(xs: Column) -> Column:
        merged = F.array_sort(F.concat(side(base, 0), side(xs, 1)))  # of equal starts, base first
        return F.when((F.size(base) > 0) & (F.size(xs) > 0), F.transform(_let(merged, free), lambda r: r["x"]["s"])).otherwise(xs)

    return _let(spans, alone)


def base_spans(documents: DataFrame, text: str, out: str) -> DataFrame:
    """``documents`` with ``out``: the spans of the fixed patterns, by kind as listed, then start."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(_SPAN)
    digit = body.rlike("[0-9]")
    may = {
        "email": body.contains("@"), "ip": digit & body.rlike(r"[0-9]\.[0-9]"),
        "card": digit & body.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": digit & body.contains("+"),
    }
    parts = {f"_{k}": F.when(may[k], _matches(body, BASE[k], k, lambda v, k=k: _valid(k, v))).otherwise(none) for k in KINDS}
    return documents.withColumns(parts).withColumn(out, F.concat(*parts)).drop(*parts)


def candidate_spans(documents: DataFrame, text: str, base: str, out: str) -> DataFrame:
    """``documents`` with ``out``: look-alikes that overlap no base span."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(_SPAN)
    digit = body.rlike("[0-9]")
    may = {
        "email": body.contains("@"), "ip": digit & body.rlike(r"[0-9]\.[0-9]"),
        "card": digit & body.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": digit & body.rlike(r"[0-9](?:[\x20().-]*+[0-9]){6}"),
    }
    rows = documents.withColumn(out, none)
    for k in KINDS:
        found = _apart(_matches(body, LOOSE[k], k, lambda v, k=k: _likely(k, v)), F.col(base))
        rows = rows.withColumn(out, F.when(may[k], F.concat(F.col(out), found)).otherwise(F.col(out)))
    return rows


def slot_spans(documents: DataFrame, text: str, base: str, out: str) -> DataFrame:
    """``documents`` with ``out``: runs without letters from digit to digit that overlap no base span."""
    body = F.coalesce(F.col(text), F.lit(""))
    least, most = min(lo for lo, _ in SLOT_DIGITS.values()), max(hi for _, hi in SLOT_DIGITS.values())
    found = _matches(body, _SLOT, "slot", lambda v: F.length(_digits(v)).between(least, most))
    return documents.withColumn(out, F.when(body.rlike("[0-9]"), _apart(found, F.col(base))).otherwise(F.array().cast(_SPAN)))


def _chunks(text: Column) -> Column:
    """Overlapping pieces of a text: CHUNK characters each with CONTEXT characters before and after.

    A place in a long text is counted from its start, so contexts are read from the piece they lie in.
    """
    padded = F.concat(F.lit(" " * CONTEXT), text)
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda i: F.substring(padded, i * CHUNK + 1, F.lit(CHUNK + 2 * CONTEXT)))


def _patterns(chunks: Column, span: Column) -> Column:
    """The lexical patterns around a span."""
    piece = lambda at: F.get(chunks, F.floor(at / CHUNK).cast("int"))
    before = F.lower(F.substring(piece(span["start"]), span["start"] % CHUNK + 1, F.lit(CONTEXT)))
    after = F.lower(F.substring(piece(span["end"]), span["end"] % CHUNK + CONTEXT + 1, F.lit(CONTEXT)))
    left = F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*$", 1)
    left2 = F.regexp_extract(before, r"(\p{L}+)[^\p{L}]+\p{L}+[^\p{L}]*$", 1)
    right = F.regexp_extract(after, r"^[^\p{L}]*(\p{L}+)", 1)
    return F.array(F.concat(F.lit("L "), left), F.concat(F.lit("R "), right), F.concat_ws(" ", F.lit("B"), left, right), F.concat_ws(" ", F.lit("LL"), left2, left))


def learn_patterns(occurrences: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """Accepted patterns (kind, pattern, score). ``occurrences``: kind, value, seed, patterns."""
    edges = occurrences.select("kind", F.lower("value").alias("value"), "seed", F.explode("patterns").alias("pattern"))
    edges = stage(edges.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    weight = F.col("seed").cast("double")
    scored = edges.withColumn("score", weight)
    for _ in range(rounds):
        sums = scored.groupBy("kind", "pattern").agg(F.sum("score").alias("s"), F.count("*").alias("n"), F.sum("seed").alias("seeds"))
        patterns = stage(sums.filter(F.col("seeds") >= support).select("kind", "pattern", (F.col("s") / (F.col("n") + 1)).alias("p")), "pii-patterns")
        miss = F.sum(F.log(1 - F.least("p", F.lit(0.999))))
        found = edges.filter("seed = 0").join(patterns, ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(miss)).alias("found"))
        scored = edges.join(found, ["kind", "value"], "left").withColumn("score", F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("found", F.lit(0.0))))
    return patterns.filter(F.col("p") >= accept).select("kind", "pattern", F.col("p").alias("score"))


def find(documents: DataFrame, text: str = "text", carry_text: bool = True) -> DataFrame:
    """``documents`` with base_spans and all_spans, arrays of (kind, start, end) by kind as listed, then start.

    Without ``carry_text`` the text is left out of the result and of what is written in between.
    """
    names = ["base_spans", "all_spans"]
    kept = [c for c in documents.columns if c not in names and (carry_text or c != text)]
    carried, own = new_name("carried"), new_name("text")
    rows = documents.select(F.struct(*kept, F.lit(0).alias(carried)).alias(carried), F.col(text).alias(own)).withColumn("_row", F.monotonically_increasing_id())
    text = own
    rows = candidate_spans(base_spans(rows, text, "base_spans"), text, "base_spans", "_near")
    rows = slot_spans(rows, text, "base_spans", "_slots")
    rows = rows.withColumn("_chunks", F.when((F.size("base_spans") > 0) | (F.size("_near") > 0) | (F.size("_slots") > 0), _chunks(F.coalesce(F.col(text), F.lit("")))))
    body = F.col("_chunks")
    mark = lambda spans, seed: F.transform(spans, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(seed).alias("seed"), _patterns(body, s).alias("patterns")))
    rows = rows.withColumn("_seen", F.concat(mark(F.col("base_spans"), 1), mark(F.col("_near"), 0)))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    rows = rows.withColumn("_slots", F.transform("_slots", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.length(_digits(s["value"])).alias("digits"),
        F.size(F.split(s["value"], "[^0-9]+")).alias("groups"), F.get(_patterns(body, s), F.lit(2)).alias("pattern"))))
    rows = rows.withColumn("base_spans", F.transform("base_spans", plain)).drop("_near", "_chunks", text)
    rows = stage(rows, "pii-rows")
    seen = rows.select("_row", F.explode("_seen").alias("s")).select("_row", "s.*")
    accepted = learn_patterns(seen)
    near = seen.filter("seed = 0").select("_row", "kind", "start", "end", F.explode("patterns").alias("pattern"))
    new = near.join(accepted, ["kind", "pattern"], "left_semi").select("_row", "kind", "start", "end")
    slots = rows.select("_row", F.explode("_slots").alias("s")).select("_row", "s.*")
    fits = [(F.col("kind") == k) & F.col("digits").between(*SLOT_DIGITS[k]) & ((F.col("groups") == 4) if k == "ip" else F.lit(True)) for k in SLOT_DIGITS]
    both = accepted.filter(F.col("pattern").rlike(r"^B \p{L}+ \p{L}+$")).select("kind", "pattern")
    read = slots.join(both, "pattern").filter(fits[0] | fits[1] | fits[2]).select("_row", "kind", "start", "end")
    new = new.union(read).distinct()
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    # Of accepted spans that overlap, the first kind as listed stays, and of one kind the longest, then the
    # first. Only spans of one run of overlapping spans meet; a run is short however many a text has.
    order = Window.partitionBy("_row").orderBy("start", "end", "kind")  # spans of one text
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = new.withColumn("_new_run", F.when(F.col("start") >= F.coalesce(reach, F.lit(0)), 1).otherwise(0))
    new = new.withColumn("_run", F.sum("_new_run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = new.groupBy("_row", "_run").agg(F.array_sort(F.collect_list(F.struct(
        F.element_at(rank, F.col("kind")).alias("rank"), (F.col("start") - F.col("end")).alias("size"), "start", "end", "kind"))).alias("given"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    clear = lambda s, done: ~F.exists(done, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
    runs = runs.withColumn("chosen", F.aggregate("given", none, lambda done, s: F.when(clear(s, done), F.concat(done, F.array(plain(s)))).otherwise(done)))
    new = runs.groupBy("_row").agg(F.flatten(F.collect_list("chosen")).alias("_new"))
    keyed = F.transform(F.concat("base_spans", F.coalesce("_new", none)), lambda s: F.struct(
        F.element_at(rank, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    out = rows.drop("_seen", "_slots").join(new, "_row", "left")
    return out.select(*[F.col(carried)[c].alias(c) for c in kept], "base_spans", F.transform(F.array_sort(keyed), plain).alias("all_spans"))


def text_of(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with every span replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""
    carried, cuts = new_name("carried"), new_name("cut")
    slim = documents.select(F.struct(*[F.col(c) for c in documents.columns if c != text], F.lit(0).alias(carried)).alias(carried), text)
    found = find(slim, text)
    flat = F.array_sort(F.transform("all_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # A span that begins before the furthest end so far belongs to the span before it.
    reach = running(F.transform(flat, lambda s: s["end"]), 0, F.greatest)
    heads = F.filter(F.arrays_zip(flat.alias("s"), reach.alias("reach")), lambda r: r["s"]["start"] >= r["reach"])
    furthest = F.array_max(F.transform(flat, lambda s: s["end"]))
    found = found.withColumn(cuts, heads)
    last = F.transform(cuts, lambda r, i: F.struct(
        r["s"]["start"].alias("start"), F.coalesce(F.get(F.col(cuts), i + 1)["reach"], furthest).alias("end"), r["s"]["kind"].alias("kind")))
    found = found.withColumn(cuts, last)
    cut, body = F.col(cuts), F.col(text)
    pieces = F.transform(cut, lambda s, i: F.concat(
        F.substring(body, F.coalesce(F.get(cut, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(cut, i - 1)["end"], F.lit(0))),
        F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")),
    ))
    tail = F.substring(body, F.get(cut, F.size(cut) - 1)["end"] + 1, F.length(body))
    masked = F.when(F.size(cut) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(body)
    return found.select(*[masked.alias(c) if c == text else F.col(carried)[c].alias(c) for c in documents.columns])
