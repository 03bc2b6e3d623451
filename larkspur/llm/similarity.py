"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with equal shingle sets are one class; all work is on classes. A pair at Jaccard similarity t or more shares at
least one of the first n - ceil(t * n) + 1 shingles of each, in any order common to all, and at least k of the first
n - ceil(t * n) + k. The join uses this twice:

* Across the corpus, blocking: a share of all shingles (by their hashes; a sixth at 90 percent, a third at 80) is counted
  exactly and put first, the rarest of it at the front, so that a prefix of shingles that occur nowhere else ends a document's part. What shares a prefix shingle
  is gathered, by connected components, into families, which hold everything that can link. Large families are made
  anew with all of their shingles counted.
* Within a family, the adaptive join: with the family's own shingle frequencies, every document lengthens its prefix to
  the k that has the least estimated cost of generating and verifying candidates, and a pair is verified only if it
  shares as many prefix shingles as the smaller k of the two asks for. Verification counts the exact intersection.

A family larger than BLOCK_SHINGLES is split into blocks, and every pair of blocks is a task of its own, so that no task
gathers more than two blocks; the pairs grow with the square of a family's blocks, as the links within it do. Shingles that a sample
shows to be very frequent are counted by several tasks each, and come last in prefixes. Links are exact; 64-bit hashes stand
for shingles, and for classes, of which two in some 10 ** 10 may collide.

Defined cases: very long texts are one set like others, and a block of their own if need be; sets at exactly the limit link; null and empty texts have no shingles and link with nothing; a text with fewer words than a shingle is one
shingle; repeated rows are linked like any equal texts; a repeated doc_id with different texts is one document in each of
their components; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import HOT_SHARE, arrow_rows, cut, forget, free_name, hot_keys, sent, stash
from larkspur.llm.components import components
from larkspur.llm.text import column_bytes, ngram_hashes, slices, splitmix, word_hashes

#: Shingles in a block; shingles that are joined at once, about, when families are small.
BLOCK_SHINGLES, BATCH_SHINGLES = 400_000, 200_000
#: The longest extension of a prefix that is considered.
LONGEST = 12
#: Tasks' parts of a hot shingle.
HOT_PARTS = 256


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and len + 1 offsets."""
    hashes, first = word_hashes(*column_bytes(column))
    grams, begin = ngram_hashes(hashes, first, words)
    owner = np.repeat(np.arange(len(column)), np.diff(begin))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(column)))]).astype(np.int64)


def digests(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, as signed integers."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(splitmix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    turned = np.concatenate([[np.uint64(0)], np.cumsum(splitmix(grams * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))])
    total = (sums[begin[1:]] - sums[begin[:-1]]) ^ splitmix(turned[begin[1:]] - turned[begin[:-1]])
    return splitmix(total + np.diff(begin).astype(np.uint64)).view(np.int64)


def counted_share(percent: int) -> int:
    """One in so many shingles is counted across the corpus: enough to fill prefixes although some are shared."""
    return max(1, 60 // max(1, 100 - percent))


def _lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values))


def prepare(docs: DataFrame, words: int, percent: int, one_in: int, known: bool = False) -> DataFrame:
    """doc_id, n, node, room, sampled, rest for every row: the set's size and hash, and its shingles for blocking.

    If known, docs has a column node, and only rows whose set has that hash are returned. room is the length of the one-match prefix; sampled are the set's shingles of the counted share, one in so many; rest are
    the first others by hash, as many as the prefix can need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams, begin = shingle_sets(batch.column("text"), words)
            if known:
                same = digests(grams, begin) == batch.column("node").to_numpy()
                batch = batch.filter(pa.array(same))
                sizes = np.diff(begin)
                grams, begin = grams[np.repeat(same, sizes)], np.concatenate([[0], np.cumsum(sizes[same])])
            n = np.diff(begin)
            room = n - (percent * n + 99) // 100 + 1
            sampled = splitmix(grams) % share == 0
            counts = np.concatenate([[0], np.cumsum(sampled)])
            ends = counts[begin]
            left = ~sampled
            others = grams[left]
            starts = np.concatenate([[0], np.cumsum(left)])[begin]
            need = np.minimum(np.maximum(room - np.diff(ends), 0), np.diff(starts))
            offsets = np.concatenate([[0], np.cumsum(need)])
            at = np.repeat(starts[:-1] - offsets[:-1], need) + np.arange(offsets[-1])
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n), pa.array(digests(grams, begin)), pa.array(room), _lists(grams[sampled].view(np.int64), ends), _lists(others[at].view(np.int64), offsets)],
                names=["doc_id", "n", "node", "room", "sampled", "rest"],
            )

    share = np.uint64(one_in)
    arrow_rows(docs.sparkSession)
    return docs.select("doc_id", "text", *(["node"] if known else [])).mapInArrow(run, "doc_id long, n long, node long, room long, sampled array<long>, rest array<long>")


def _tokens(rows: DataFrame) -> Column:
    """The sampled and the other shingles of a row of prepare()."""
    mark = lambda counted: lambda t: F.struct(t.alias("token"), F.lit(counted).alias("counted"))
    return F.concat(F.transform(rows["sampled"], mark(True)), F.transform(rows["rest"], mark(False)))


def hot_tokens(docs: DataFrame, words: int, percent: int, one_in: int, known: bool = False) -> DataFrame | None:
    """The shingles that are very frequent in docs, by a sample of its rows."""
    some = prepare(docs.sample(HOT_SHARE, seed=7), words, percent, one_in, known).where("n > 0")
    return hot_keys(some.select(F.explode(_tokens(some)).alias("t")).select("t.token"), "token")


def families(rows: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """node and family of the classes that share a prefix shingle with another class, from rows (node, room, sampled, rest).

    Rows of one class count once: a shingle's frequency is the number of classes that have it. The shingles of hot (token, hot) are
    split over many tasks; their frequency isn't taken, but counts as larger than any other.
    """
    spread = rows.select("node", (F.col("room") - F.size("sampled")).cast("int").alias("spare"), F.explode(_tokens(rows)).alias("t"))
    postings = spread.select("node", "spare", "t.token", "t.counted")
    if hot is None:
        postings = postings.withColumn("hot", F.lit(False)).withColumn("part", F.lit(0))
    else:
        postings = postings.join(hot, "token", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        postings = postings.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(HOT_PARTS))).otherwise(0).cast("int"))
    by_node = Window.partitionBy("token", "part").orderBy("node")
    numbered = postings.withColumn("nth", F.dense_rank().over(by_node)).withColumn("before", F.lag("node").over(by_node))
    counted = numbered.withColumn("df", F.when(F.col("hot"), F.lit(1 << 40)).otherwise(F.max("nth").over(Window.partitionBy("token", "part"))))
    shared = counted.where("df > 1 AND (before IS NULL OR before <> node)")
    # a class's prefix: its unique counted shingles, then the shared counted ones by frequency, then the rest by hash
    entry = F.struct((~F.col("counted")).alias("late"), F.when(F.col("counted"), F.col("df")).otherwise(0).alias("df"), "token")
    ranked = shared.groupBy("node").agg(F.first("spare").alias("spare"), F.sum(F.col("counted").cast("int")).alias("counted"), F.array_sort(F.collect_list(entry)).alias("e"))
    # what isn't in e is unique: size(sampled) - counted shingles come before all of e
    taken = F.greatest(F.col("spare") + F.col("counted"), F.lit(0)).cast("int")
    short = F.filter("e", lambda x: x["late"])
    kept = F.concat(F.slice(F.filter("e", lambda x: ~x["late"]), F.lit(1), taken), F.when(F.col("spare") > 0, short).otherwise(F.slice(short, 1, 0)))
    prefixes = cut(ranked.select("node", F.explode(kept).alias("x")).select("node", "x.token"))
    stars = prefixes.groupBy("token").agg(F.min("node").alias("b"), F.count("*").alias("c")).where("c > 1").select("token", "b")
    return components(prefixes.join(stars, "token").select(F.col("node").alias("a"), "b")).select("node", F.col("label").alias("family"))


def refined(texts: DataFrame, words: int, percent: int, family: DataFrame, classes: DataFrame) -> DataFrame:
    """The families with those of more than a block made anew from the frequencies of all their shingles; texts are (doc_id, text, node).

    Among the members of large families every shingle is counted, so that a member's own shingles fill its prefix
    and it leaves the family, unless few of them are its own.
    """
    sizes = family.join(classes.select("node", "n"), "node")
    large = sent(cut(sizes.groupBy("family").agg(F.sum("n").alias("total")).where(F.col("total") > BLOCK_SHINGLES).select("family")))
    members = cut(family.join(large, "family").select("node"))
    if members.isEmpty():
        return family
    theirs = stash(texts.join(sent(members), "node", "left_semi"))
    rows = prepare(theirs, words, percent, 1, True)
    again = families(rows.select("node", "room", "sampled", "rest"), hot_tokens(theirs, words, percent, 1, True))
    made = cut(family.join(large, "family", "left_anti").select("node", "family").unionByName(again))
    forget(theirs)
    return made


def adaptive_links(grams: np.ndarray, begin: np.ndarray, percent: int, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Each set's index with the later ones (in an order by size) that it links to; sets of one side are not compared."""
    n = np.diff(begin)
    m = len(n)
    _, ids = np.unique(grams, return_inverse=True)
    df = np.bincount(ids)
    owner = np.repeat(np.arange(m), n)
    order = np.lexsort((ids, df[ids], owner))
    ids = ids[order]
    place = np.arange(len(ids)) - np.repeat(begin[:-1], n)
    need = (percent * n + 99) // 100
    # the cheapest k of each set: candidates from the prefix's lists, and their verification if they share k
    load = np.concatenate([[0], np.cumsum(df[ids] - 1)])
    best, k = np.full(m, np.inf), np.ones(m, dtype=np.int64)
    for length in range(1, LONGEST + 1):
        end = np.minimum(n - need + length, n)
        found = load[begin[:-1] + end] - load[begin[:-1]]
        cost = found + n * found / length
        better = (cost < best * 0.95) & (length <= np.maximum(need, 1))
        best, k = np.where(better, cost, best), np.where(better, length, k)
    level = np.maximum(place - np.repeat(n - need, n) + 1, 1)
    prefix = (level <= np.repeat(k, n)) & (df[ids] > 1)
    # lists of the sets that hold a shingle in their prefix
    p_ids, p_owner, p_level = ids[prefix], owner[prefix], level[prefix]
    by = np.argsort(p_ids, kind="stable")
    l_owner, l_level = p_owner[by], p_level[by]
    heads = np.searchsorted(p_ids[by], np.arange(len(df) + 1))
    p_begin = np.searchsorted(p_owner, np.arange(m + 1))
    mark = np.zeros(len(df), dtype=bool)
    for r in range(m):
        mine = slice(p_begin[r], p_begin[r + 1])
        tokens = p_ids[mine]
        sizes = heads[tokens + 1] - heads[tokens]
        if not len(tokens) or sizes.sum() <= len(tokens):
            continue
        at = np.repeat(heads[tokens] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        who = l_owner[at]
        least = np.minimum(k[r], k[who])
        ok = (np.maximum(l_level[at], np.repeat(p_level[mine], sizes)) <= least) & ((n[who] > n[r]) | ((n[who] == n[r]) & (who > r))) & (need[who] <= n[r])
        if side is not None:
            ok &= side[who] != side[r]
        who, times = np.unique(who[ok], return_counts=True)
        who = who[times >= np.minimum(k[r], k[who])]
        if not len(who):
            continue
        own = ids[begin[r] : begin[r + 1]]
        mark[own] = True
        sizes = n[who]
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.repeat(begin[who] - offsets, sizes) + np.arange(sizes.sum())
        common = np.add.reduceat(mark[ids[at]].astype(np.int64), offsets)
        mark[own] = False
        linked = who[100 * common >= percent * (n[r] + n[who] - common)]
        if len(linked):
            yield r, linked


def join_blocks(members: DataFrame, words: int, percent: int) -> DataFrame:
    """node, root, links: partial links of the members (key, kind, block, node, size, text, n).

    node and root are connected by links (node = root where there is none in this task); links counts the documents of the
    linked classes. Rows of a key are together; whole families (kind 0) share a call, blocks (1) and pairs of blocks (2) don't.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        grams, begin = shingle_sets(pa.array([r[5] for r in rows], pa.large_string()), words)
        node = digests(grams, begin)
        known = np.array([r[3] for r in rows], dtype=np.int64)
        blocks = np.array([r[2] for r in rows], dtype=np.int64)
        split = rows[0][1] == 2
        real = np.flatnonzero(node == known)
        chosen = real[np.unique(node[real], return_index=True)[1]]
        sizes = np.diff(begin)[chosen]
        at = np.repeat(begin[chosen] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(chosen) else np.zeros(0, np.int64)
        grams, begin = grams[at], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        node, weight, blocks = node[chosen], np.array([r[4] for r in rows], dtype=np.int64)[chosen], blocks[chosen]
        links, root = np.zeros(len(node), dtype=np.int64), np.arange(len(node))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for r, others in adaptive_links(grams, begin, percent, blocks if split else None):
            links[r] += weight[others].sum()
            links[others] += weight[r]
            here = top(r)
            for o in others.tolist():
                there = top(o)
                if there != here:
                    here, there = min(here, there), max(here, there)
                    root[there] = here
        tops = np.array([top(i) for i in range(len(node))], dtype=np.int64)
        some = links > 0
        if some.any():
            return pa.record_batch([pa.array(node[some]), pa.array(node[tops[some]]), pa.array(links[some])], names=["node", "root", "links"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "block", "node", "size", "text", "n")), strict=True):
                if rows and row[0] != last and (size >= BATCH_SHINGLES or row[1] > 0 or rows[0][1] > 0):
                    if (out := flush(rows)) is not None:
                        yield out
                    rows, size = [], 0
                rows.append(row)
                size, last = size + row[6], row[0]
        if rows and (out := flush(rows)) is not None:
            yield out

    return members.repartition("key").sortWithinPartitions("key").select("key", "kind", "block", "node", "size", "text", "n").mapInArrow(run, "node long, root long, links long")


def similarity_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, class_size of every row of docs (doc_id, text).

    Documents link at 100 * intersection >= percent * union of their sets of words-word shingles.
    """
    rows = prepare(docs, words, percent, counted_share(percent))
    light = cut(rows.select("doc_id", "n", "node"))
    classes = cut(light.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"), F.first("n").alias("n")))
    family = cut(families(rows.where("n > 0").select("node", "room", "sampled", "rest"), hot_tokens(docs, words, percent, counted_share(percent))))
    # the texts of families' members, one of each class, are put aside once; all others stay where they are
    named = cut(family.join(classes.select("node", "least"), "node").select("node", F.col("least").alias("doc")))
    texts = stash(docs.select("doc_id", "text").join(sent(named), F.col("doc_id").eqNullSafe(F.col("doc"))).select("doc_id", "text", "node"))
    family = refined(texts, words, percent, family, classes)
    weights = family.join(classes.select("node", "least", "size", "n"), "node")
    # at most one family for every BLOCK_SHINGLES of the corpus is in this table
    split = weights.groupBy("family").agg(F.sum("n").alias("total")).where(F.col("total") > BLOCK_SHINGLES).select("family", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("p"))
    member = weights.join(sent(cut(split)), "family", "left").withColumn("parts", F.coalesce("p", F.lit(1)))
    # a family of one block is one task; of more, a task joins each block with itself and each pair of blocks
    block = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(0).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    placed = member.withColumn("block", block).withColumn("task", F.explode(tasks)).select(
        "node", "size", "n", "block", F.xxhash64("family", "task.low", "task.high").alias("key"),
        F.when(F.col("parts") == 1, 0).when(F.col("task.low") == F.col("task.high"), 1).otherwise(2).alias("kind"),
    )
    members = texts.select("text", "node").join(sent(cut(placed)), "node")
    found = cut(join_blocks(members, words, percent))
    forget(texts)
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed_in = classes.select("node", "least", "size").join(linked, "node", "left").join(labels, "node", "left")
    named = placed_in.select("node", "size", F.coalesce("links", F.lit(0)).alias("links"), "least", F.coalesce("label", "node").alias("label"))
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    result = named.join(lowest, "label").select("node", "size", "links", "component_id")
    return light.join(result, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("links") + F.col("size") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("n") > 0, F.col("size")).otherwise(1).cast("long").alias("class_size"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that are linked, directly or not, with one of a smaller doc_id.

    Rows that are equal in doc_id and text become one. Rows without doc_id can't be told apart by what links them, and stay.
    """
    found = cut(similarity_join(docs, words, percent))
    gone, text = free_name(docs, "gone"), free_name(docs, "text_hash")
    drop = found.where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    kept = docs.join(sent(cut(drop)), F.col("doc_id") == F.col(gone), "left_anti")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)
