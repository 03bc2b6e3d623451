"""Secret scans by rules and by character Markov models, in DataFrame operations only.

Rules find assignments, access keys and long hexadecimal strings. Beside them, first-order character Markov models of
random strings and of ordinary identifiers are compared over every token of LEAST characters or more. A string is random if its
log-likelihood ratio, summed over its pairs of neighbouring characters, exceeds ODDS nats, the weight of how rare secrets are, and
MEAN nats a pair; so short tokens have to be clearer than long ones, and nothing else decides. Of random strings there are two models, of which
the better one counts: one learned from the values that the rules caught, and one that draws evenly from the kinds of characters
(lower case, upper case, digits, signs) that the token has. Identifiers are learned from the words of documents in which the rules caught nothing.

Scanning is a projection of each row: no row moves. The models are a table of 67 by 67 numbers, counted from bounded
samples (SAMPLE documents, and as many caught values, chosen by hashes).

Positions are code points, the end exclusive. Markov spans are added only where no rule's span overlaps them. Defined cases: a
null or empty text has no spans; very long texts are scanned whole, their positions summed in blocks; spans that begin
together are listed by kind; repeated rows are scanned each for itself; where ordinary words have fewer than ENOUGH pairs to learn from, no Markov
span is added; an empty table gives an empty result; extra columns are not read by scan(), and kept as they are by redact().
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, free_name

#: The rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Kind, pattern, group of the value, least length of the value.
RULES = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 0), ("hex", HEX, 0, 0))
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "markov")
#: Characters of tokens, and a token's least length.
ALPHABET, LEAST = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 12
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Nats from which a token counts as random: in all, and for each pair.
ODDS, MEAN = 10.0, 0.35
#: Training: documents and values at most, about; pairs of ordinary words needed; the weight of an even draw in the learned model.
SAMPLE, ENOUGH, PRIOR = 4000, 2000, 200.0
#: Items that are summed up one after another.
BLOCK = 512

#: Logarithms of both models' probabilities, by the first character and then the second: random, ordinary.
Models = tuple[np.ndarray, np.ndarray]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def running(values: Column, join: Callable[[Column, Column], Column], first: int) -> Column:
    """For each of an array of longs what join makes of first and all values before it, in blocks, so that long arrays are cheap."""
    parts = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
    grown = lambda v, start: F.aggregate(v, F.array(start), lambda acc, x: F.array_append(acc, join(F.element_at(acc, -1), x)))
    zero = F.lit(first).cast("long")

    def whole(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, join))
        return let(grown(sums, zero), lambda starts: F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda b, s: F.slice(grown(b, s), F.lit(1), F.size(b)))))

    return F.when(F.size(values) > 0, let(values, lambda v: let(parts(v), whole))).otherwise(F.array().cast("array<bigint>"))


_SPANS = "array<struct<start: bigint, rank: int, end: bigint, value: string>>"


def _matches(kind: str, pattern: str, group: int, keep: Callable[[Column], Column]) -> Column:
    """The matches of pattern in text whose values keep holds for: an array of start, rank, end, value."""
    text = F.col("text")
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hit.alias("hit"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hit).alias("value"))
    real = F.filter(zipped, lambda m: m["hit"].isNotNull())
    rank = F.lit(KINDS.index(kind))

    def placed(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda m: (F.length(m["gap"]) + F.length(m["hit"])).cast("long")), lambda a, b: a + b, 0)

        def one(m: Column, before: Column) -> Column:
            start = before + F.length(m["gap"])
            return F.struct(start.alias("start"), rank.alias("rank"), (start + F.length(m["hit"])).alias("end"), m["value"].alias("value"))

        return F.filter(F.zip_with(rows, ends, one), lambda m: keep(m["value"]))

    return F.coalesce(F.when(text.rlike(pattern), let(real, placed)), F.array()).cast(_SPANS)


def caught() -> Column:
    """The rules' spans in text."""
    return F.concat(*(_matches(kind, pattern, group, lambda v, least=least: F.length(v) >= least) for kind, pattern, group, least in RULES))


def _pairs(token: Column, body: Callable[[Column, Column], Column]) -> Column:
    """An array with body of each two neighbouring characters of token."""
    return let(F.split(token, ""), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), body))


def train(samples: DataFrame) -> Models | None:
    """Both models from samples (tok, secret 0/1); None if there is too little of ordinary words."""
    pairs = samples.where(F.length("tok") >= 2).select("secret", F.explode(_pairs(F.col("tok"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = np.zeros((2, len(ALPHABET), len(ALPHABET)))
    # at most 2 * 67 * 67 rows
    for row in pairs.where(F.instr(F.lit(ALPHABET), F.col("p.a")) * F.instr(F.lit(ALPHABET), F.col("p.b")) > 0).groupBy("secret", "p.a", "p.b").count().collect():
        if row["a"] in place and row["b"] in place:
            counts[row["secret"], place[row["a"]], place[row["b"]]] = row["count"]
    ordinary, random = counts
    if ordinary.sum() < ENOUGH:
        return None
    n = len(ALPHABET)
    return np.log((random + PRIOR / n) / (random.sum(axis=1, keepdims=True) + PRIOR)), np.log((ordinary + 0.5) / (ordinary.sum(axis=1, keepdims=True) + 0.5 * n))


def fit(docs: DataFrame) -> Models | None:
    """The models that docs (text) teach: what the rules caught, and words of documents in which they caught nothing."""

    def some(df: DataFrame, column: str, total: int) -> DataFrame:
        return df.where(F.pmod(F.xxhash64(column), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 20)))

    ruled = F.lit(False)
    for _, pattern, _, _ in RULES:
        ruled = ruled | F.col("text").rlike(pattern)
    texts = docs.select("text").where("text IS NOT NULL")
    values = cut(texts.where(ruled).select(F.explode(F.transform(caught(), lambda m: m["value"])).alias("value")))
    words = F.explode(F.split(F.regexp_replace("text", r"[^A-Za-z0-9+/_=-]+", " "), " "))
    ordinary = some(texts, "text", texts.count()).where(~ruled).select(words.alias("tok"), F.lit(0).alias("secret")).where(F.length("tok") >= 4)
    return train(ordinary.unionByName(some(values, "value", values.count()).select(F.col("value").alias("tok"), F.lit(1).alias("secret"))))


def _table(values: np.ndarray) -> Column:
    """Numbers as one literal array."""
    return F.split(F.lit(",".join(f"{v:.4f}" for v in values.ravel())), ",").cast("array<double>")


def is_random(token: Column, models: Models) -> Column:
    """Whether the models call a token random."""
    random, ordinary = models
    n = len(ALPHABET)
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    pair = lambda a, b: (place(a) - 1) * n + place(b)
    total = lambda at, table: F.aggregate(at, F.lit(0.0), lambda acc, k: acc + F.element_at(_table(table), k))
    kinds = sum((F.when(token.rlike(p), size).otherwise(0) for p, size in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[+/_=-]", 5))), F.lit(0))

    def judged(at: Column) -> Column:
        drawn = -F.log(kinds.cast("double")) * F.size(at)
        ratio = F.greatest(drawn, total(at, random)) - total(at, ordinary)
        return (ratio > ODDS) & (ratio > MEAN * F.size(at))

    return let(_pairs(token, pair), judged)


def spans(models: Models | None) -> Column:
    """All spans in text, by start and then kind."""
    if models is None:
        return F.array_sort(caught())
    found = F.concat(caught(), _matches("markov", TOKEN, 0, lambda v: is_random(v, models)))
    far = 1 << 62
    base = lambda x: x["rank"] < KINDS.index("markov")

    def apart(sorted_: Column) -> Column:
        until = running(F.transform(sorted_, lambda x: F.when(base(x), x["end"]).otherwise(F.lit(0).cast("long"))), _larger, 0)
        onward = F.reverse(running(F.reverse(F.transform(sorted_, lambda x: F.when(base(x), x["start"]).otherwise(F.lit(far)))), _smaller, far))
        both = F.zip_with(until, onward, lambda a, b: F.struct(a.alias("until"), b.alias("onward")))
        marked = F.zip_with(sorted_, both, lambda x, y: F.struct(x.alias("x"), (base(x) | (y["until"] <= x["start"]) & (y["onward"] >= x["end"])).alias("keep")))
        return F.transform(F.filter(marked, lambda m: m["keep"]), lambda m: m["x"])

    return let(found, lambda f: F.when(F.exists(f, lambda x: ~base(x)) & F.exists(f, base), let(F.array_sort(f), apart)).otherwise(F.array_sort(f)))


def _listed(rows: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_spans, spans of every row of docs (doc_id, text)."""
    models = fit(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", spans(models).alias("found"))
    count = lambda k: F.size(F.filter("found", lambda x: x["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *map(count, range(len(KINDS))), _listed(F.filter("found", lambda x: x["rank"] < 3)).alias("base_spans"), _listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by mask and n_chars set anew; all other columns, and clean rows, as they were."""
    models = fit(docs)
    found = free_name(docs, "found")
    rows = docs.withColumn(found, spans(models))

    def masked(some: Column) -> Column:
        until = running(F.transform(some, lambda x: x["end"]), _larger, 0)

        def piece(x: Column, at: Column) -> Column:
            between = F.substring(F.col("text"), (at + 1).cast("int"), F.greatest(x["start"] - at, F.lit(0)).cast("int"))
            return F.concat(between, F.when(x["end"] > at, F.lit(mask)).otherwise(""))

        rest = F.substring(F.col("text"), (F.array_max(F.transform(some, lambda x: x["end"])) + 1).cast("int"), F.length("text"))
        return F.concat(F.array_join(F.zip_with(some, until, piece), ""), rest)

    held = F.coalesce(F.size(found), F.lit(0)) > 0
    text = F.when(held, let(F.col(found), masked)).otherwise(F.col("text"))
    rows = rows.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns), held.alias(found))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(found), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*(f"`{c}`" for c in docs.columns))
