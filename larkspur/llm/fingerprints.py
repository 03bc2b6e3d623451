"""SimHash fingerprints and their neighbours, in DataFrame operations only.

A text's terms are its pairs of neighbouring lower-cased words (a single word is a term of its own), weighted by how
often they occur. Each term's 64-bit hash votes on every bit, for or against by its weight; a fingerprint's bit is set
where the votes for it outweigh those against. Votes of bits b and b + 32 share one 64-bit sum, so that a text
takes 32 sums and a count; they hold up to 4 billion terms.

Permuted block tables find neighbours: 64 bits are cut into radius + 2 blocks, and two fingerprints within the radius
agree in two blocks at least, so that they meet in one of the tables keyed by two blocks. Equal fingerprints are one entry
with a count, and each table's entries are dealt over PARTS parts, to which the few asked ones are copied, so that many
fingerprints with equal blocks don't meet in one task.

Defined cases: a null or empty text has no terms and the fingerprint 0; very long texts are fingerprinted whole; a bit with equally
many votes for and against is 0; equal texts have equal fingerprints; repeated
rows are fingerprinted each for itself; of several rows with one doc_id the one with the least text hash is what other
documents take as their neighbour; a table of one document has itself as next; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut

BITS = 64
#: Bits in which neighbours differ at most; parts of a block table; documents whose id this divides are asked for their neighbours.
RADIUS, PARTS, EVERY = 3, 8, 50


def term_hashes(text: Column) -> Column:
    """The 64-bit hashes of a text's terms, one for each occurrence; null if there are none."""
    words = F.split(F.trim(F.lower(text), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")

    def terms(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
        return F.when(F.size(w) > 1, pairs).when(F.element_at(w, 1) != "", F.transform(w, lambda a: F.xxhash64(a)))

    # the words are computed once, though they are read several times
    return F.element_at(F.transform(F.array(words), terms), 1)


def votes() -> list[Column]:
    """The aggregates over a column h of term hashes that fingerprint() reads."""
    two = F.lit((1 << 32) + 1)
    return [F.count("h").alias("__n"), *(F.sum(F.shiftrightunsigned("h", b).bitwiseAND(two)).alias(f"__v{b}") for b in range(32))]


def fingerprint() -> Column:
    """The fingerprint as a long, from the columns of votes()."""

    def bit(count: Column, at: int) -> Column:
        return F.when(2 * count > F.col("__n"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))

    low = [bit(F.coalesce(F.col(f"__v{b}").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0)), b) for b in range(32)]
    high = [bit(F.coalesce(F.shiftrightunsigned(f"__v{b}", 32), F.lit(0)), b + 32) for b in range(32)]
    return reduce(lambda a, b: a.bitwiseOR(b), low + high)


def simhash(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fp, the fingerprint of the texts; rows with equal keys must have equal texts."""
    terms = texts.select(*keys, F.explode_outer(term_hashes(F.col(text))).alias("h"))
    return terms.groupBy(*keys).agg(*votes()).select(*keys, fingerprint().alias("fp"))


def said(fp: str) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The share of bits in which two fingerprints agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def near(asked: DataFrame, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """qfp, fp, distance of all pairs of distinct fingerprints, one of asked (fp) and one of fingerprints (fp), within radius bits."""
    blocks = radius + 2
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    keys = F.array(*(F.struct(F.lit(t).alias("t"), part[i].alias("x"), part[j].alias("y")) for t, (i, j) in enumerate(combinations(range(blocks), 2))))
    parts = F.sequence(F.lit(0), F.lit(PARTS - 1))
    left = asked.select("fp").distinct().select(F.col("fp").alias("qfp"), F.explode(keys).alias("k")).select("qfp", "k.*", F.explode(parts).alias("part"))
    right = fingerprints.select("fp").distinct().select("fp", F.explode(keys).alias("k")).select("fp", "k.*", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int").alias("part"))
    met = left.join(right, ["t", "x", "y", "part"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("qfp"))))
    return met.where(F.col("distance") <= radius).select("qfp", "fp", "distance").distinct()


def neighbours(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """query_id, doc_id, distance of all fingerprints (doc_id, fp) within radius bits of queries (query_id, fp).

    Equal fingerprints are looked up once, as classes, and only the found classes are expanded into documents.
    """
    asked = queries.select("query_id", F.col("fp").alias("qfp"))
    return near(queries, fingerprints, radius).join(asked, "qfp").join(fingerprints.select("doc_id", "fp"), "fp").select("query_id", "doc_id", "distance")


def count_neighbours(asked: DataFrame, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """qfp, n_near: for each distinct fingerprint of asked (fp) how many rows of fingerprints (fp) lie within radius bits, equal ones too."""
    classes = fingerprints.groupBy("fp").agg(F.count("*").alias("rows"))
    return near(asked, classes, radius).join(classes, "fp").groupBy("qfp").agg(F.sum("rows").alias("n_near"))


def next_ids(docs: DataFrame, partitions: int) -> DataFrame:
    """doc_id, n_most, next_id: for each distinct doc_id its largest n_chars and the next in descending order.

    The ids are sorted by range in so many partitions; only each partition's first id is looked at together.
    """
    ids = docs.groupBy("doc_id").agg(F.max("n_chars").alias("n_most"))
    placed = cut(ids.repartitionByRange(partitions, F.desc_nulls_last("doc_id")).withColumn("pid", F.spark_partition_id()))
    inside = Window.partitionBy("pid").orderBy(F.desc_nulls_last("doc_id"))
    ranked = placed.withColumn("after", F.lead(F.struct("doc_id")).over(inside))
    heads = placed.groupBy("pid").agg(F.max("doc_id").alias("doc_id")).select("pid", F.struct("doc_id").alias("head"))
    over = Window.orderBy("pid")
    bounds = heads.select("pid", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("onward"))
    return ranked.join(F.broadcast(bounds), "pid").select("doc_id", "n_most", F.coalesce("after", "onward")["doc_id"].alias("next_id"))


def compare_with_edits(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp, n_near for docs (doc_id, text).

    A document's edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next
    document in descending doc_id, after the last that of the first. n_near counts the other rows whose fingerprints lie within
    RADIUS bits, for the documents whose id every divides, and is null for all others.

    Texts are dealt by doc_id once; only the halves that go to other documents move again.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.length("text").cast("long").alias("n_chars"))
    light = cut(keyed.groupBy("doc_id", "hash").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("times")))
    found = light.agg(F.count("*").alias("n"), F.count_distinct(F.struct("doc_id")).alias("ids"), F.max("times").alias("times")).first()
    if (found["times"] or 0) > 1:
        rows = keyed.dropDuplicates(["doc_id", "hash"]).select("doc_id", "text")
    own = cut(simhash(rows.withColumn("hash", F.xxhash64("text")), ["doc_id", "hash"]))
    order = cut(next_ids(light.select("doc_id", "n_chars"), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    after = order.select(F.col("doc_id").alias("d"), "next_id")
    front = F.expr("substring(text, 1, cast(length(text) - floor(length(text) / 2) as int))")
    fronts = rows.join(after, same("doc_id", "d")).select("doc_id", "next_id", F.xxhash64("text").alias("hash"), F.length("text").cast("long").alias("n_chars"), front.alias("front"))
    before = order.select(F.col("next_id").alias("d"), F.col("doc_id").alias("owner"), "n_most")
    heads = rows.join(before, same("doc_id", "d")).select("owner", F.expr("substring(text, 1, cast(floor(n_most / 2) as int))").alias("head"), F.xxhash64("text").alias("h"))
    chosen = own
    if found["n"] != found["ids"]:
        heads = heads.groupBy("owner").agg(F.min_by("head", "h").alias("head"))
        chosen = own.groupBy("doc_id").agg(F.min_by("fp", "hash").alias("fp"))
    edited = fronts.join(heads.select("owner", "head"), same("doc_id", "owner")).select(
        "doc_id", "hash", "n_chars", "next_id", F.concat("front", F.substring(F.col("head"), F.lit(1), (F.col("n_chars") / 2).cast("long").cast("int"))).alias("text")
    )
    # the digest goes along as four numbers, which cost less than a string as parts of a key
    digest = [F.conv(F.substring(F.sha2("text", 256), 16 * k + 1, 16), 16, -10).cast("long").alias(f"s{k}") for k in range(4)]
    prints = simhash(edited.select("*", *digest), ["doc_id", "hash", "n_chars", "next_id", "s0", "s1", "s2", "s3"])
    prints = prints.withColumnRenamed("fp", "edited_fp").withColumn("edited_sha256", F.concat(*(said(f"s{k}") for k in range(4))))
    mine = own.join(light.select(F.col("doc_id").alias("ld"), F.col("hash").alias("lh"), "times"), same("doc_id", "ld") & same("hash", "lh"))
    all_rows = mine.select("fp", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("fp") if (found["times"] or 0) > 1 else own.select("fp")
    asked = F.col("doc_id") % every == 0
    counts = count_neighbours(own.where(asked), all_rows)
    mine = mine.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "fp", "times", F.when(asked, F.col("fp")).alias("asked"))
    mine = mine.join(counts, F.col("asked") == F.col("qfp"), "left").select("d", "h", "fp", "times", (F.col("n_near") - 1).alias("n_near"))
    following = chosen.select(F.col("doc_id").alias("f"), F.col("fp").alias("next_fp"))
    joined = prints.join(mine, same("doc_id", "d") & same("hash", "h")).join(following, same("next_id", "f"))
    columns = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp", "n_near"]
    if (found["times"] or 0) > 1:
        joined = joined.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return joined.select(*columns)
