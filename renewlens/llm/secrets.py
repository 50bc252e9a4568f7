"""Secret scans: fixed patterns, and strings that look random to a character Markov model.

Built-in expressions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.llm.text import lower_ascii

#: Base patterns in the order they are listed (fixed by the contract): (kind, pattern, least length).
#: The first one is judged by its value (group 2), the others by the whole match. For hex and access
#: a minimum in the pattern finds the same spans as dropping short maximal runs.
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Symbols of the Markov chains, and the strings that are judged: whole runs of 20 or more of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Ordinary identifiers are shorter runs, so that no string to be judged trains its own judge.
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,19}(?![A-Za-z0-9+/_=-])"
#: A candidate is a secret from this log-likelihood ratio on, in nats.
THRESHOLD = 10.0
#: At most so many documents with base spans and so many documents at large are training samples.
SAMPLE_DOCS = 1000
#: Pseudo-count of every symbol, and how many pseudo-transitions follow the symbols' own shares.
SMOOTH, BACK_OFF = 0.5, 8.0

_MARK, _OTHER = "\u0001", "\u0002"
#: Beyond any position.
_FAR = 2**31 - 1


def _keyword(text: Column) -> Column:
    """Whether a text has what every assignment needs; cheaper than the pattern."""
    low = lower_ascii(text)
    words = ("password", "passwd", "secret", "token", "apikey", "api_key")
    named = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    return (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & named


def _has(text: Column, pattern: str) -> Column:
    if pattern == ASSIGN:
        return _keyword(text) & text.rlike(ASSIGN)
    if pattern == ACCESS:
        return F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS)
    return text.rlike(pattern)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running totals of an array of integers under ``merge``, as long as the array.

    Blocks of about the square root of its size are summed up each and then among each other, so that
    no array grows step by step over its whole length.
    """
    none = F.array().cast("array<int>")

    def totals(xs: Column) -> Column:
        last = lambda acc: F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.lit(zero))
        return F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(merge(last(acc), x).cast("int"))))

    def of_blocks(blocks: Column) -> Column:
        return _let(totals(F.transform(blocks, lambda b: F.element_at(b, -1))), lambda ends: F.flatten(F.transform(
            blocks, lambda b, k: _let(F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(zero)), lambda before: F.transform(
                b, lambda x: merge(before, x).cast("int"))))))

    def scanned(xs: Column) -> Column:
        return _let(F.ceil(F.sqrt(F.size(xs))).cast("int"), lambda width: _let(F.transform(
            F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")),
            lambda k: totals(F.slice(xs, k * width + 1, width))), of_blocks))

    return _let(values, lambda xs: F.when(F.size(xs) > 0, scanned(xs)).otherwise(none))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s>>: leftmost non-overlapping matches, in code points, end exclusive.

    Matches are set in marks and the text is cut at them; running lengths of the pieces give positions.
    A mark that stands in the text is replaced before by another control character.
    """
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}")

    def placed(pieces: Column) -> Column:
        return _let(running(F.transform(pieces, F.length), lambda a, b: a + b, 0), lambda ends: F.transform(
            F.sequence(F.lit(1), F.floor(F.size(pieces) / 2).cast("int")),
            lambda k: F.struct(
                F.get(ends, 2 * k - 2).alias("start"), F.get(ends, 2 * k - 1).alias("end"),
                F.get(pieces, 2 * k - 1).alias("s"))))

    found = _let(F.split(marked, _MARK), lambda pieces: F.when(F.size(pieces) > 2, placed(pieces)).otherwise(none))
    return F.when(_has(text, pattern), found).otherwise(none)


def _apart(candidates: Column, base: Column) -> Column:
    """The candidates that no base span overlaps.

    All spans are put in order once. Of the base spans that start before a candidate the largest end
    decides, of the others the smallest start.
    """
    order = lambda xs, none: F.transform(xs, lambda x: F.struct(
        x["start"].alias("start"), F.lit(none).alias("model"), x["end"].alias("end"), x["s"].alias("s")))

    def judged(both: Column) -> Column:
        ends = F.transform(both, lambda x: F.when(x["model"], F.lit(0)).otherwise(x["end"]))
        starts = F.reverse(F.transform(both, lambda x: F.when(x["model"], F.lit(_FAR)).otherwise(x["start"])))
        least = F.reverse(running(starts, lambda a, b: F.least(a, b), _FAR))
        marked = F.zip_with(
            F.zip_with(both, running(ends, lambda a, b: F.greatest(a, b), 0), lambda x, e: F.struct(x.alias("x"), e.alias("e"))),
            least, lambda y, n: F.struct(y["x"].alias("x"), (y["x"]["model"] & (y["e"] <= y["x"]["start"]) & (n >= y["x"]["end"])).alias("free")))
        return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: F.struct(
            m["x"]["start"].alias("start"), m["x"]["end"].alias("end"), m["x"]["s"].alias("s")))

    mixed = _let(F.array_sort(F.concat(order(base, False), order(candidates, True))), judged)
    return F.when((F.size(base) > 0) & (F.size(candidates) > 0), mixed).otherwise(candidates)


def base_spans(docs: DataFrame) -> DataFrame:
    """Add the span arrays assign, access and hex; a null text has none."""
    text = F.coalesce("text", F.lit(""))
    value = lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= ASSIGN_VALUE
    return docs.withColumns({
        "assign": F.filter(spans(text, ASSIGN), value),
        "access": spans(text, ACCESS),
        "hex": spans(text, HEX),
    })


def samples(docs: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """(random, s): labelled strings of a bounded sample of documents.

    Random strings are the values of base spans, ordinary identifiers the shorter runs of any
    documents. Each sort comes from the ``limit`` documents of smallest hash, equal rows once. The hashes
    alone are put in order; texts are read again where they are needed.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(text.alias("text"), F.xxhash64("text", "doc_id").alias("h"))
    found = reduce(lambda a, b: a | b, (_has(F.col("text"), p) for p in (ASSIGN, ACCESS, HEX)))

    def smallest(some: DataFrame) -> DataFrame:
        last = some.select("h").orderBy("h").limit(limit).agg(F.max("h")).first()[0]
        return some.where(F.col("h") <= F.lit(last).cast("long")).dropDuplicates(["h"])

    secret = base_spans(smallest(rows.where(found)).select("text"))
    plain = smallest(rows)
    assigned = F.transform("assign", lambda x: F.regexp_extract(x["s"], ASSIGN, 2))
    values = F.concat(assigned, F.transform("access", lambda x: x["s"]), F.transform("hex", lambda x: x["s"]))
    return secret.select(F.lit(True).alias("random"), F.explode(values).alias("s")).unionByName(
        plain.select(F.lit(False).alias("random"), F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("s"))
    )


def _pairs(s: Column) -> Column:
    """Numbers of the transitions of a string; -1 for one outside the alphabet."""
    k = len(ALPHABET)
    codes = F.transform(F.split(s, ""), lambda c: F.when(c != "", F.position(c, F.lit(ALPHABET)) - 1).otherwise(F.lit(-1)))
    size = F.greatest(F.length(s) - 1, F.lit(0))
    pair = lambda a, b: F.when((a >= 0) & (b >= 0), a * k + b).otherwise(F.lit(-1))
    return F.zip_with(F.slice(codes, F.lit(1), size), F.slice(codes, F.lit(2), size), pair)


def train(labelled: DataFrame, smooth: float = SMOOTH, back_off: float = BACK_OFF) -> list[float]:
    """Log-likelihood ratio of every transition, random against ordinary, from (random, s).

    Each chain backs off to the shares of its symbols, so that a symbol rare in identifiers counts
    even after a symbol they never have. The counts are one row per transition and label, so their
    number is bounded by the alphabet.
    """
    k = len(ALPHABET)
    counts = (
        labelled.select("random", F.explode(_pairs(F.col("s"))).alias("pair"))
        .where("pair >= 0").groupBy("random", "pair").count().collect()
    )
    logs = []
    for label in (True, False):
        n = [0] * (k * k)
        for r in counts:
            if r["random"] == label:
                n[r["pair"]] = r["count"]
        share = [sum(n[b::k]) + smooth for b in range(k)]
        total = sum(share)
        rows = [sum(n[a * k:(a + 1) * k]) for a in range(k)]
        logs.append([
            math.log((n[p] + back_off * share[p % k] / total) / (rows[p // k] + back_off)) for p in range(k * k)
        ])
    return [a - b for a, b in zip(*logs)]


def ratio(s: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string under a trained model (thousandths of a nat per step)."""
    table = F.split(F.lit(",".join(str(round(x * 1000)) for x in model)), ",").cast("array<int>")
    step = lambda acc, p: acc + F.when(p >= 0, F.element_at(table, p + 1)).otherwise(F.lit(0))
    return F.aggregate(_pairs(s), F.lit(0).cast("long"), step) / 1000


def scan(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with the span arrays assign, access, hex and model.

    model holds the candidates whose ratio reaches ``threshold`` and that touch no base span. Without
    a given model one is trained on :func:`samples` of ``docs``. Columns under these names are
    replaced.
    """
    docs = docs.drop("assign", "access", "hex", "model")
    if model is None:
        model = train(samples(docs))
    text = F.coalesce("text", F.lit(""))
    found = base_spans(docs).withColumn("model", spans(text, CANDIDATE))
    free = _apart(F.col("model"), F.concat("assign", "access", "hex"))
    return found.withColumn("model", F.filter(free, lambda x: ratio(x["s"], model) >= threshold))


KINDS = ("assign", "access", "hex", "model")


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by start, then kind as listed, comma-joined."""
    def of_kind(i: int) -> Column:
        return F.transform(
            kinds[i], lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"))
        )

    rows = F.concat(*map(of_kind, range(len(kinds))))
    names = F.array(*map(F.lit, kinds))
    words = F.transform(
        F.array_sort(rows),
        lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")),
    )
    return F.array_join(words, ",")


def redact(docs: DataFrame, mask: str = "[secret]", **options) -> DataFrame:
    """Documents with every span replaced by ``mask``, columns as in ``docs``; overlapping spans as one."""
    found = scan(docs, **options)
    rows = F.array_sort(F.concat(*(F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        before = F.substr("text", acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        word = F.when((x["start"] >= acc["at"]), F.lit(mask)).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], before, word).alias("out"))

    done = F.aggregate(rows, start, step, lambda a: F.concat(a["out"], F.substr("text", a["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), done)).select(*(f"`{c}`" for c in docs.columns))
