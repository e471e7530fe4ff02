"""Secret scans: fixed patterns, and random strings found by character Markov models.

Main path: DataFrame functions only.  First-order character models, one of ordinary
identifiers and one of random strings for each alphabet (hexadecimal, base 64, ...), are trained from
labelled samples by counting character pairs.  A long token is reported when the log-likelihood ratio of
a random model to the ordinary one, summed over its characters, exceeds the model's margin; of one that
is not, each stretch of ``LEAST`` characters or more whose own sum does, as of a secret behind a path.
A margin is the least of some that few ordinary samples, held out of the counting, exceed.
The models are kept as tables of integer weights (thousandths of a nat) for 68 x 68 character pairs,
literals of fixed size in the plan.

Places are code points, ends exclusive.  They are taken from the lengths of the parts
between matches, so a whole text costs a few passes of its patterns and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumscan.llm.common import drop_written, pick, written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in their order: pattern, group whose length counts, least length, pattern that texts with such a match have.
BASE = {
    "assign": (ASSIGN, 2, 8, ASSIGN),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    "hex": (r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
}
#: Tokens that the models judge: this long, with a letter.
TOKEN, TOKEN_HINT = r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9+/_=-]{20}"
#: Characters of the shortest stretch of a token that is judged by itself.
LEAST = 20
#: Characters of the chunks out of which a masked text is put together; beyond the end of any text.
CHUNK, FAR = 512, (1 << 31) - 1
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Characters of a token; their codes are their places from 1, and 0 is the start of a token and any other character.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODES = len(ALPHABET) + 1
#: Words of which the sample's ordinary identifiers are made.
IDENTIFIER_WORDS = (
    "account address admin amount array async base batch block buffer build button cache call chart check child class "
    "client color column command comment config content context control count create current customer data date debug "
    "default delete detail device display document domain download draft edit element email enable entry error event "
    "export field file filter final first flag folder format frame function global group handler header height history "
    "image import index input insert item label language last layer layout length level library line list load local "
    "location log login main manager mapping max member message meta method min model module name network new next node "
    "number object offset option order output owner page panel param parent parser path pattern payment phone position "
    "price process product profile project query queue random reader record region release remove report request reset "
    "result return root route row sample save scale schema screen search section select server service session shape "
    "size sort source stack stage start state status step storage string style summary system table target task team "
    "template test text thread time title total track type update upload user value vector version view width window worker"
).split()


def labelled_samples(spark: SparkSession, n: int = 12000) -> DataFrame:
    """``n`` labelled strings (text, is_secret, alphabet, held_out): half random in the usual alphabets, half identifiers of words.

    A quarter is held out; its identifiers are made of words that the others have not.  All are made by hashing the row number, so every session gets the same.
    """
    held = F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(4)) == 0
    some, others = (F.array(*map(F.lit, w)) for w in (IDENTIFIER_WORDS[::4], [w for k, w in enumerate(IDENTIFIER_WORDS) if k % 4]))
    rows = spark.range(n).select("id", held.alias("held_out"), F.when(held, some).otherwise(others).alias("words"), F.sha2(F.col("id").cast("string"), 512).alias("hex"))

    def word(k: int) -> Column:
        return F.get("words", F.pmod(F.xxhash64("id", F.lit(k)), F.size("words")).cast("int"))

    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 9000).cast("int")), "yyyy-MM-dd")
    # Columns of their own, so that the plan holds each once however often the forms name it.
    rows = rows.select("id", "held_out", "hex", F.base64(F.unhex("hex")).alias("base64"), F.array(*map(word, range(9))).alias("w"), day.alias("day"), F.pmod(F.xxhash64("id"), F.lit(2030)).cast("string").alias("number"))
    size = (F.lit(20) + F.col("id") % 29).cast("int")
    letters = F.regexp_replace("base64", "[+/=]", "")
    made = {"letters": letters, "hex": F.col("hex"), "capitals": F.upper(letters), "base64": F.col("base64")}
    kind = (F.col("id") / 2 % len(made)).cast("int")
    secret = F.substring(F.get(F.array(*made.values()), kind), F.lit(1), size)
    four = [F.get("w", F.lit(k)) for k in range(4)]
    many = F.slice("w", F.lit(1), (F.pmod(F.xxhash64("id", F.lit("words")), F.lit(7)) + 3).cast("int"))
    camel = F.concat(four[0], *(F.initcap(w) for w in four[1:]), F.col("number"))
    forms = [F.concat_ws("_", many, "number"), camel, F.concat_ws("-", many, "number"), F.upper(F.concat_ws("_", *four[:3], "number")), F.concat_ws("/", many), F.concat(F.concat_ws("_", many), F.lit("/"), four[0], F.col("number")), F.concat_ws("-", "day", *four[:2]), F.concat(*four), F.concat_ws("/", four[0], F.translate("day", "-", "/"), *four[1:3])]
    named = F.get(F.array(*forms), (F.col("id") % len(forms)).cast("int"))
    is_secret = F.pmod(F.xxhash64("id", F.lit("kind")), F.lit(2)) == 0
    alphabet = F.get(F.array(*map(F.lit, made)), kind)
    return rows.select(F.when(is_secret, secret).otherwise(named).alias("text"), is_secret.alias("is_secret"), F.when(is_secret, alphabet).alias("alphabet"), "held_out")


@dataclass(frozen=True)
class Models:
    """A table of weights and a margin, in thousandths of a nat, for each alphabet of random strings."""

    tables: tuple[tuple[int, ...], ...]
    margins: tuple[int, ...]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, start: Column, step: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """The fold's value behind each element, ``step`` being associative with ``start`` as its neutral value.

    An array grows by copies, so it is cut into about as many chunks as a chunk has elements: what each chunk comes to is folded over the
    chunks, and goes on within each of them.  An array of n costs n ** 1.5 copies of a number, not n ** 2.
    """
    none = F.array().cast(f"array<{kind}>")

    def folded(xs: Column, first: Column) -> Column:
        zero = F.struct(first.alias("last"), none.alias("out"))

        def one(s: Column, x: Column) -> Column:
            return bound(step(s["last"], x), lambda v: F.struct(v.alias("last"), F.concat(s["out"], F.array(v)).alias("out")))

        return F.aggregate(xs, zero, one, lambda s: s["out"])

    def chunked(xs: Column) -> Column:
        n = F.ceil(F.sqrt(F.size(xs))).cast("int")
        at = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / n).cast("int"))
        return F.transform(at, lambda k: F.slice(xs, k * n + 1, n))

    def of_chunks(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, start, step))
        before = F.concat(F.array(start), folded(totals, start))
        return bound(before, lambda b: F.flatten(F.transform(chunks, lambda c, k: folded(c, F.get(b, k)))))

    return F.when(F.size(values) > 0, bound(values, lambda xs: bound(chunked(xs), of_chunks))).otherwise(none)


def _before(totals: Column, start: Column) -> Column:
    """What ``running`` gives in front of each element."""
    return F.slice(F.concat(F.array(start), totals), F.lit(1), F.size(totals))


def _codes(text: Column) -> Column:
    """The character codes of a string."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(samples: DataFrame, smoothing: float = 30.0, characters: int = 66, margins: tuple[float, ...] = (6, 8, 10, 12, 15, 20, 25, 30, 40), rate: float = 0.001) -> Models:
    """Weights for each pair (code before, code), in row order, of each alphabet; code 0 is the start.

    Counts of pairs are smoothed by ``smoothing`` pairs that have the characters' own shares, of ``characters`` kinds.
    ``samples`` has text (null and non-ASCII texts are ignored), is_secret and, if random strings
    are of several alphabets, alphabet.  A quarter of the samples, by a hash, is held out: an alphabet's
    margin is the least of ``margins`` that at most ``rate`` of the ordinary ones held out exceed, or the largest.
    The driver gets counts of pairs, at most 68 * 68 for each alphabet, however many samples there are.
    """
    alphabet = F.coalesce("alphabet", F.lit("any")) if "alphabet" in samples.columns else F.lit("any")
    held = F.coalesce("held_out", F.lit(False)) if "held_out" in samples.columns else F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    known = samples.filter(F.col("text").rlike(r"\A[\x01-\x7f]+\z") & F.col("is_secret").isNotNull())
    known = written(known.select("text", F.when(F.col("is_secret"), alphabet).alias("kind"), held.alias("held")), "secret-samples")
    codes = known.filter("not held").select("kind", F.concat(F.array(F.lit(0)), _codes(F.col("text"))).alias("c"))
    pairs = codes.select("kind", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p"))
    counts: dict = {}
    for r in pairs.groupBy("kind", "p.a", "p.b").count().collect():
        counts.setdefault(r.kind, {})[r.a, r.b] = r["count"]

    def log_p(kind: str | None) -> list[float]:
        pair = counts.get(kind, {})
        before = [sum(pair.get((a, b), 0) for b in range(CODES)) for a in range(CODES)]
        alone = [sum(pair.get((a, b), 0) for a in range(CODES)) for b in range(CODES)]
        share = [(n + 0.5) / (sum(alone) + 0.5 * characters) for n in alone]
        return [math.log((pair.get((a, b), 0) + smoothing * share[b]) / (before[a] + smoothing)) for a in range(CODES) for b in range(CODES)]

    ordinary = log_p(None)
    tables = [tuple(round(1000 * (p - q)) for p, q in zip(log_p(kind), ordinary, strict=True)) for kind in sorted(filter(None, counts))]
    bounds = sorted(round(1000 * m) for m in margins)
    best = [F.percentile_approx(best_sum(log_ratios(F.col("text"), table)), 1 - rate, 10_000) for table in tables]
    found = known.filter("held and kind is null").agg(F.count(F.lit(1)), *best).first()[1:]
    drop_written(known)
    return Models(tuple(tables), tuple(next((m for m in bounds if x is not None and x <= m), bounds[-1]) for x in found))


def log_ratios(token: Column, weights: tuple[int, ...]) -> Column:
    """Log-likelihood ratio of each character of a token, in thousandths of a nat: above 0 it is likelier to be random."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    codes = F.concat(F.array(F.lit(0)), _codes(token))
    steps = F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: F.coalesce(F.get(table, a * CODES + b), F.lit(0)))
    return F.slice(steps, F.lit(1), F.length(token))


def best_sum(ratios: Column) -> Column:
    """The largest sum of a stretch of ``LEAST`` ratios or more, or of all of them; in one pass, as below."""
    lagged = F.slice(F.concat(F.array_repeat(F.lit(0), LEAST), ratios), F.lit(1), F.size(ratios))
    zero = F.struct(*(F.lit(0).cast("long").alias(k) for k in ("at", "sum", "lag")), *(F.lit(None).cast("long").alias(k) for k in ("low", "best")))

    def step(s: Column, x: Column) -> Column:
        lag, total = s["lag"] + x["old"], s["sum"] + x["new"]
        low = F.when(s["at"] + 1 >= LEAST, F.least(s["low"], lag)).otherwise(s["low"])
        return F.struct((s["at"] + 1).alias("at"), total.alias("sum"), lag.alias("lag"), low.alias("low"), F.greatest(s["best"], total - low).alias("best"))

    pairs = F.zip_with(ratios, lagged, lambda a, b: F.struct(a.alias("new"), b.alias("old")))
    return F.aggregate(pairs, zero, step, lambda s: F.greatest(s["best"], s["sum"]))


def random_stretches(ratios: Column, least_sum: int) -> Column:
    """Start and end of what is random in a token: all of it if its sum is above ``least_sum``, else its best stretches.

    One pass that holds the sum of all ratios and of those but the last ``LEAST``: the least of the
    latter is where the best stretch that ends here begins.  A stretch is closed where the best one
    that ends here is less by ``least_sum`` than the best so far; the next begins behind it.
    """
    spans = "array<struct<start:int,end:int>>"
    zero = F.struct(
        *(F.lit(0).alias(k) for k in ("at", "floor", "low_at", "start", "end")),
        *(F.lit(0).cast("long").alias(k) for k in ("sum", "lag", "best")),
        F.lit(None).cast("long").alias("low"),
        F.array().cast(spans).alias("found"),
    )

    def both(s: Column) -> Column:
        return F.concat(s["found"], F.when(s["best"] > least_sum, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(F.array().cast(spans)))

    def step(s: Column, x: Column) -> Column:
        begin, lag = s["at"] + 1 - LEAST, s["lag"] + x["old"]
        lower = (begin >= s["floor"]) & (s["low"].isNull() | (lag < s["low"]))
        moved = F.struct((s["at"] + 1).alias("at"), (s["sum"] + x["new"]).alias("sum"), lag.alias("lag"), F.when(lower, lag).otherwise(s["low"]).alias("low"), F.when(lower, begin).otherwise(s["low_at"]).alias("low_at"))
        return bound(moved, lambda m: judged(s, m))

    def judged(s: Column, m: Column) -> Column:
        gain = F.coalesce(m["sum"] - m["low"], F.lit(0).cast("long"))
        better = gain > s["best"]
        close = (s["best"] > least_sum) & (gain < s["best"] - least_sum)
        return F.struct(
            m["at"].alias("at"),
            F.when(close, s["end"]).otherwise(s["floor"]).alias("floor"),
            m["low_at"].alias("low_at"),
            F.when(better, m["low_at"]).otherwise(s["start"]).alias("start"),
            F.when(better, m["at"]).otherwise(s["end"]).alias("end"),
            m["sum"].alias("sum"),
            m["lag"].alias("lag"),
            F.when(close, F.lit(0).cast("long")).when(better, gain).otherwise(s["best"]).alias("best"),
            F.when(~close, m["low"]).alias("low"),
            F.when(close, both(s)).otherwise(s["found"]).alias("found"),
        )

    def finish(s: Column) -> Column:
        return F.when(s["sum"] > least_sum, F.array(F.struct(F.lit(0).alias("start"), s["at"].alias("end")))).otherwise(both(s))

    def stretches(r: Column) -> Column:
        old = F.slice(F.concat(F.array_repeat(F.lit(0), LEAST), r), F.lit(1), F.size(r))
        return F.aggregate(F.zip_with(r, old, lambda a, b: F.struct(a.alias("new"), b.alias("old"))), zero, step, finish)

    return bound(ratios, stretches)


def united(spans: Column) -> Column:
    """Spans (start, end) by start, those that overlap as one."""
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.array().cast(kind).alias("found"))

    def closed(s: Column) -> Column:
        return F.when(s["start"].isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    def step(s: Column, x: Column) -> Column:
        more = x["start"] < s["end"]
        return F.struct(F.when(more, s["start"]).otherwise(x["start"]).alias("start"), F.when(more, F.greatest(s["end"], x["end"])).otherwise(x["end"]).alias("end"), F.when(more, s["found"]).otherwise(closed(s)).alias("found"))

    return F.aggregate(F.array_sort(spans), zero, step, closed)


def _spans(text: str, kind: str, rank: int, pattern: str, group: int, hint: str, accept: Callable[[Column, Column], Column], inside: Callable[[Column], Column] | None = None) -> Column:
    """The matches of a pattern that ``accept`` (whole match, group) lets through, as sorted structs.

    Of a match, ``inside`` gives starts and ends of the parts that count, if not all of it.  Ends are a running sum of the lengths of gaps and matches.
    """
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda p: F.length(p)).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("group"),
    )

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.alias("start"), F.lit(rank).alias("rank"), b.alias("end"), F.lit(kind).alias("kind"))

    def size(part: Column) -> Column:
        return F.coalesce(F.length(part["match"]), F.lit(0))  # the last gap has no match behind it

    def found(all_parts: Column) -> Column:
        ends = running(F.transform(all_parts, lambda x: x["gap"] + size(x)), F.lit(0), lambda x, y: x + y)
        placed = F.zip_with(all_parts, ends, lambda x, e: F.struct(x.alias("part"), e.alias("end")))
        good = F.filter(placed, lambda x: F.coalesce(accept(x["part"]["match"], x["part"]["group"]), F.lit(False)))
        if not inside:
            return F.transform(good, lambda x: span(x["end"] - size(x["part"]), x["end"]))
        return F.flatten(F.transform(good, lambda x: F.transform(inside(x["part"]["match"]), lambda y: span(x["end"] - size(x["part"]) + y["start"], x["end"] - size(x["part"]) + y["end"]))))

    return F.when(F.col(text).rlike(hint), bound(parts, found)).otherwise(F.array().cast(SPANS))


def _apart(tokens: str, base: str) -> Column:
    """The tokens that overlap no base span: in order of starts, none before reaches into it and the next base span begins behind it."""
    both = F.array_sort(F.concat(F.col(tokens), F.col(base)))

    def chosen(rows: Column) -> Column:
        reach = running(F.transform(rows, lambda x: F.when(x["kind"] != "random", x["end"]).otherwise(F.lit(0))), F.lit(0), lambda x, y: F.greatest(x, y))
        begins = running(F.reverse(F.transform(rows, lambda x: F.when(x["kind"] != "random", x["start"]).otherwise(F.lit(FAR)))), F.lit(FAR), lambda x, y: F.least(x, y))
        judged = F.arrays_zip(rows.alias("span"), reach.alias("reach"), F.reverse(begins).alias("next"))
        return F.transform(F.filter(judged, lambda x: (x["span"]["kind"] == "random") & (x["reach"] <= x["span"]["start"]) & (x["next"] >= x["span"]["end"])), lambda x: x["span"])

    return F.when(F.size(tokens) == 0, F.col(tokens)).when(F.size(base) == 0, F.col(tokens)).otherwise(bound(both, chosen))


def _kinds(text: str, models: Models) -> dict[str, Column]:
    """The spans of every kind."""

    def has_letter(token: Column, _: Column) -> Column:
        return token.rlike("[A-Za-z]")

    def random_parts(token: Column) -> Column:
        found = [random_stretches(log_ratios(token, table), margin) for table, margin in zip(models.tables, models.margins, strict=True)]
        return united(F.concat(*found)) if found else F.array().cast("array<struct<start:int,end:int>>")

    out = {kind: _spans(text, kind, rank, pattern, group, hint, lambda _, g, least=least: F.length(g) >= least) for rank, (kind, (pattern, group, least, hint)) in enumerate(BASE.items())}
    return out | {"random": _spans(text, "random", len(BASE), TOKEN, 0, TOKEN_HINT, has_letter, random_parts)}


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    ``spans`` lists kind:start:end by start, then kind in order; ``random`` are the tokens,
    or stretches of them, that the models report, those apart that overlap a fixed pattern's match.
    ``base_sha256`` is over the fixed patterns' spans alone.  Null and empty texts have no spans; texts of
    any length are searched whole.  Null or repeated identifiers
    pass through; an empty table gives no rows; other columns are ignored.
    """
    found = pick(docs, id_col, text_col)
    for kind, spans in _kinds("text", models).items():
        found = found.withColumn("tokens" if kind == "random" else kind, spans)
    found = found.drop("text")
    found = found.withColumn("base", F.array_sort(F.concat(*BASE)))
    found = found.withColumn("random", _apart("tokens", "base"))
    found = found.withColumn("all", F.array_sort(F.concat("base", "random")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*BASE, "random")]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"))


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """Characters from start to end, or to the last, of a text in chunks: only the chunks in question are put together."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.coalesce(F.floor(end / CHUNK).cast("int"), F.size(chunks) - 1)
    part = F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.substring(part, start - first * CHUNK + 1, F.coalesce(end - start, F.length(part)))


def mask_secrets(docs: DataFrame, models: Models, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span of a secret in the text column replaced by ``mark``.

    Null texts stay null, texts of any length are masked whole, repeated rows alike; all columns are kept.
    An empty table gives no rows.
    """
    names = docs.columns
    work = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    work = work.withColumn("spans", F.array_sort(F.concat(*_kinds("text", models).values())))

    def masked(spans: Column, chunks: Column) -> Column:
        reach = running(F.transform(spans, lambda x: x["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
        # Spans that overlap what is already replaced only lengthen it.
        placed = F.zip_with(spans, _before(reach, F.lit(0)), lambda x, r: F.struct(r.alias("from"), x["start"].alias("to")))
        gaps = F.transform(F.filter(placed, lambda x: x["to"] >= x["from"]), lambda x: _between(chunks, x["from"], x["to"]))
        return F.array_join(F.concat(gaps, F.array(_between(chunks, F.array_max(reach), F.lit(None)))), mark)

    clean = bound(F.col("spans"), lambda spans: bound(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda chunks: masked(spans, chunks)))
    text = F.when((F.size("spans") == 0) | F.col("row")[text_col].isNull(), F.col("row")[text_col]).otherwise(clean)
    return work.withColumn("clean", text).select(*(F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names))
