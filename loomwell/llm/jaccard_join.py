"""N-gram Jaccard join with set-relation skipping, and the groups its links make.

Each text becomes the set of its hashed five-word shingles (63 bits). Equal sets form one class.
Similar sets share a shingle among the first n - ceil(0.8 n) + 1 in a common order, so each class
is entered into the index lists of these shingles with its size and its position there. The order
puts shingles of buckets with many documents last, so that passages which many texts share hardly
occur in the index; the buckets are counted over all texts in a sketch of fixed size.

Set relations save comparisons, in all lists:

* Answers of similar sets: a class is first compared only with the one before it in short lists (by
  size), and with the one whose bitmap is nearest in long ones; then, in these, with the nearest of
  another group. Classes that link are one group, and a class has its answers through those of the similar
  class: entries of one group aren't compared again, and a list of a single group is done.
* Block skipping: the entries of the other lists are cut into blocks by size and position. A block's
  greatest and least size and position bound the overlap of its entries, so pairs of blocks that
  can't reach it, or that hold one group alone, are passed over as a whole.
* Derived answers: of the pairs that are left, those are decided without being compared whose distance
  follows from computed ones, as Jaccard distances keep the triangle inequality: with y near a,
  d(a, b) lies between d(y, b) - d(a, y) and d(y, b) + d(a, y). A class within CLOSE of an earlier one has that
  one as its hub. What its pairs ask is asked of the hubs, once for all pairs of the same hubs; bitmaps bound
  the distance of hubs from below, whole sets give it, and a pair whose answer doesn't follow is compared itself.

Before whole sets are fetched, candidates are held against bitmaps: bit h(shingle) modulo the
bitmap's length is flipped for each shingle, so two bitmaps differ in no more bits than the sets in
shingles, and a pair whose bitmaps differ in more than a ninth of both sizes can't link.

Every link is verified on the whole sets or follows from distances that were; skipped pairs are in
one group already or proven not to link, so the groups are those of the exact join (up to
collisions of 63-bit hashes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.llm.text import shingle_hashes
from loomwell.runtime import free_name, materialize

_BUCKETS = 1 << 20
_CHUNK = 1 << 12
#: Bits of the filter of wanted texts, at most: 16 MB. It lets more through beyond that, and nothing is lost.
_BITS = 1 << 27
_HOT = np.uint64(1 << 63)
#: Entries of lists above LONG are compared by bitmaps in tasks of their own, in lots of LOT entries; of others as rows.
LONG, LOT = 64, 4096
#: Position blocks to a set's size.
_POSITIONS = 40
_FAR = 1 << 30
#: Distance up to which a class's answers are derived from another's.
CLOSE = 0.1


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            values, offs = shingle_hashes(part.column(part.num_columns - 1))
            yield part, values >> np.uint64(1), offs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_BUCKETS, np.int64)
    for _, values, offs in _texts(batches):
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        order = np.lexsort((values, row))
        values, row = values[order], row[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        counts += np.bincount((values[new] & np.uint64(_BUCKETS - 1)).astype(np.int64), minlength=_BUCKETS)
    yield _chunks(range(_BUCKETS // _CHUNK), counts)


def _chunks(keys, counts: np.ndarray) -> pa.RecordBatch:
    small = counts.astype(np.uint16) if counts.max(initial=0) < 1 << 16 else counts
    parts = [p.tobytes() for p in small.reshape(-1, _CHUNK)]
    return pa.RecordBatch.from_arrays([pa.array(list(keys), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * _CHUNK else np.int64).astype(np.int64)


def _sum(table: pa.Table) -> pa.Table:
    total = sum((_numbers(x.as_py()) for x in table.column("counts")), np.zeros(_CHUNK, np.int64))
    return pa.Table.from_batches([_chunks([table.column("chunk")[0].as_py()], total)])


def hot_buckets(docs: DataFrame) -> np.ndarray:
    """For each of the sketch's buckets, whether many documents hold shingles of it.

    All shingles of all texts are counted, each once a document. The sketch has 2**20 counters,
    whatever the input's size; tasks' counters are summed in two steps.
    """
    schema = "chunk int, counts binary"
    counted = docs.select("text").mapInArrow(_count, schema)
    partial = counted.groupBy("chunk", (F.spark_partition_id() % 64).alias("lot")).applyInArrow(_sum, schema)
    counts = np.zeros(_BUCKETS, np.int64)
    for row in partial.groupBy("chunk").applyInArrow(_sum, schema).collect():  # 256 rows, 8 MB at most
        counts[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = _numbers(row["counts"])
    mean = counts.mean()
    return np.packbits(counts > mean + 6 * np.sqrt(mean) + 20, bitorder="little")


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def _ordered(values: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A text's distinct shingles in the common order: those of hot buckets last, else by hash."""
    values = np.unique(values)
    flags = _bit(hot, (values & np.uint64(_BUCKETS - 1)).astype(np.int64)).astype(bool)
    return np.concatenate([values[~flags], values[flags] | _HOT])


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _parity(tokens: np.ndarray) -> np.ndarray:
    """The set's bitmap: at least as many bits as shingles, a power of two, 64 or more."""
    length = 1 << max(6, (len(tokens) - 1).bit_length() if len(tokens) else 6)
    at = ((tokens >> np.uint64(21)) & np.uint64(length - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=length) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _sets(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Size, digest and index prefix of each document's set, and a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offs in _texts(batches):
            n, digest, prefix, bits = [], [], [], []
            for i in range(part.num_rows):
                tokens = _ordered(values[offs[i] : offs[i + 1]], hot)
                n.append(len(tokens))
                digest.append(_digest(tokens) if len(tokens) else None)
                bits.append(_parity(tokens))
                prefix.append(tokens[: len(tokens) + (-4 * len(tokens) // 5) + 1].view(np.int64) if len(tokens) else tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n", "digest", "prefix", "bits"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, digest binary, prefix array<long>, bits array<long>")


def _whole_sets(docs: DataFrame, hot: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """(text_hash, tokens): whole sets of the texts that ``wanted``, a bitmap, lets through; others aren't cut."""
    mask = np.int64(len(wanted) * 8 - 1)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of one text are cut once a task, or now and then
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            keep = []
            for i in np.flatnonzero(_bit(wanted, hashes & mask)).tolist():
                if int(hashes[i]) not in seen:
                    seen.add(int(hashes[i]))
                    keep.append(i)
            if len(seen) > 200_000:
                seen = set()
            if keep:
                yield batch.take(pa.array(keep, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offs in _texts(chosen(batches)):
            sets = [_ordered(values[offs[i] : offs[i + 1]], hot).view(np.int64) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["text_hash", "tokens"])

    return docs.select(F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "text_hash long, tokens array<long>")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits at the lowest places of the hashes: 16 bits a hash, 2**16 at least and _BITS at most."""
    size = min(_BITS, 1 << max(16, (16 * hashes.count() - 1).bit_length()))
    at = F.col("text_hash").bitwiseAND(F.lit(size - 1)) + 1
    rows = hashes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for row in rows:  # rows of 4 KB, as many as the bitmap has room for
        bits[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return bits


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node that links reach.

    Large-star and small-star steps by turns; each is written to the shared folder, and all is
    joins and aggregates with partial aggregation. Nodes without edges aren't returned.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    while True:
        # Of a node's neighbours only those before it can be its least, so edges needn't be turned round.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        large = edges.join(least.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = materialize(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.*").where("u > v").distinct(), "components")
        # A round may leave a child with two roots, so both are asked: no root has a parent, and each child has one.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def _regrouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) with more links: only the roots of groups that these join are contracted, and nothing is done if there are none."""
    for x in "ab":
        links = links.join(groups.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    across = links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b").distinct()
    across = materialize(across, "jaccard-across")
    if across.isEmpty():
        return groups
    moved = materialize(components(across), "jaccard-moved")
    kept = groups.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(kept.union(moved.join(groups, "node", "left_anti").select("node", "root")), "jaccard-groups")


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) with ``least``, a lower bound of their distance from sizes and bitmaps, and ``may``: whether these leave room for a link.

    The longer bitmap is folded first. Bitmaps that differ in x bits mean sets that differ in x shingles at least, so
    the distance is no less than 2 x / (sum of sizes + x).
    """
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")), x)
    short = F.least(F.size("bitsa"), F.size("bitsb"))

    def folded(c: str) -> Column:
        halves = F.zip_with(F.slice(c, F.lit(1), short), F.slice(c, short + 1, short), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(c) == short, F.col(c)).otherwise(halves)

    near = (F.size("bitsa") <= 2 * short) & (F.size("bitsb") <= 2 * short)  # sizes that link differ by less
    apart = F.aggregate(F.zip_with(folded("bitsa"), folded("bitsb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    told = pairs.select("a", "b", "na", "nb", F.when(near, apart).alias("apart"))
    sizes = 1 - F.least("na", "nb") / F.greatest("na", "nb")
    least = F.greatest(sizes, 2 * F.col("apart") / (F.col("na") + F.col("nb") + F.col("apart")))
    return told.select("a", "b", least.alias("least"), F.coalesce(9 * F.col("apart") <= F.col("na") + F.col("nb"), F.lit(False)).alias("may"))


def _verified(pairs: DataFrame, docs: DataFrame, hot: np.ndarray, classes: DataFrame) -> DataFrame:
    """(a, b, d, linked): those of the pairs that bitmaps don't rule out, with their Jaccard distance, from the whole sets."""
    return _from_sets(materialize(_bounded(pairs, classes).where("may").select("a", "b"), "jaccard-plausible"), docs, hot, classes)


def _from_sets(pairs: DataFrame, docs: DataFrame, hot: np.ndarray, classes: DataFrame) -> DataFrame:
    """(a, b, d, linked) of written pairs. Whole sets are made anew from the texts, one of each of these pairs' classes only."""
    if pairs.isEmpty():
        return pairs.select("a", "b", F.lit(0.0).alias("d"), F.lit(False).alias("linked"))
    named = materialize(classes.select("rep", "text_hash").join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi"), "jaccard-named")
    sets = _whole_sets(docs, hot, _bitmap(named)).join(named, "text_hash").groupBy("rep").agg(F.first("tokens").alias("tokens"))
    sets = materialize(sets, "jaccard-whole")
    one = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    two = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
    both = F.size(F.array_intersect("ta", "tb"))
    found = pairs.join(one, "b").join(two, "a").select("a", "b", both.alias("i"), (F.size("ta") + F.size("tb") - both).alias("u"))
    return materialize(found.select("a", "b", (1 - F.col("i") / F.col("u")).alias("d"), (5 * F.col("i") >= 4 * F.col("u")).alias("linked")), "jaccard-verified")


def _chunks_that_may_link(n: np.ndarray, pos: np.ndarray, roots: np.ndarray, one: np.ndarray, two: np.ndarray) -> bool:
    """Whether entries of two blocks (places ``one`` and ``two``) may link, by the blocks' extremes alone."""
    (na, nb), (pa_, pb), (ra, rb) = (n[one], n[two]), (pos[one], pos[two]), (roots[one], roots[two])
    if ra.min() == ra.max() == rb.min() == rb.max():
        return False
    reach = min((na - pa_).max(), (nb - pb).max()) + min(pa_.max(), pb.max())
    return 9 * reach >= 4 * (na.min() + nb.min()) and 5 * na.max() >= 4 * nb.min() and 5 * nb.max() >= 4 * na.min()


def _compare(nearest: bool):
    """Candidates among the entries of one list's two lots (or one lot with itself), by blocks and bitmaps.

    All that may link, or with ``nearest`` for each entry the one whose bitmap is nearest.
    """

    def run(table: pa.Table) -> pa.Table:
        lots, first = table.column("lot").to_numpy(), table.column("one")[0].as_py()
        reps, roots, n, pos = (table.column(c).to_numpy() for c in ("rep", "root", "n", "pos"))
        bits = table.column("bits").to_pylist()
        both_same = first == table.column("two")[0].as_py()
        words = np.array([len(x) for x in bits])
        out_a, out_b = [], []
        least, mate = np.full(len(reps), _FAR), np.zeros(len(reps), np.int64)
        for w in np.unique(words):  # bitmaps of one length, and those half as long against them folded
            own = np.flatnonzero(words == w)
            own = own[np.lexsort((pos[own], n[own]))]
            half = np.flatnonzero(words == w // 2) if w > 1 else own[:0]
            half = half[np.lexsort((pos[half], n[half]))]
            maps = np.array([bits[k] for k in own], np.int64).view(np.uint64)
            for other, mine, theirs in ((own, maps, maps), (half, maps[:, : w // 2] ^ maps[:, w // 2 :], np.array([bits[k] for k in half], np.int64).view(np.uint64))):
                for at in range(0, len(own), 256) if len(other) else ():
                    part = own[at : at + 256]
                    for to in range(at if other is own else 0, len(other), 256):
                        rest = other[to : to + 256]
                        if not _chunks_that_may_link(n, pos, roots, part, rest):
                            continue
                        apart = np.zeros((len(part), len(rest)), np.int64)
                        for c in range(mine.shape[1]):
                            apart += np.bitwise_count(mine[at : at + 256, c][:, None] ^ theirs[to : to + 256, c][None, :])
                        sizes = n[part][:, None] + n[rest][None, :]
                        reach = np.minimum((n - pos)[part][:, None], (n - pos)[rest][None, :]) + np.minimum(pos[part][:, None], pos[rest][None, :])
                        ok = (9 * apart <= sizes) & (9 * reach >= 4 * sizes) & (roots[part][:, None] != roots[rest][None, :])
                        if other is own and to == at:
                            ok &= np.arange(len(part))[:, None] < np.arange(len(rest))[None, :]
                        if not both_same:
                            ok &= (lots[part][:, None] == first) != (lots[rest][None, :] == first)
                        if nearest:
                            apart[~ok] = _FAR
                            for here, there, d in ((part, rest, apart), (rest, part, apart.T)):
                                best = d.argmin(axis=1)
                                gap = d[np.arange(len(here)), best]
                                closer = gap < least[here]
                                least[here[closer]], mate[here[closer]] = gap[closer], there[best[closer]]
                        else:
                            x, y = np.nonzero(ok)
                            out_a.append(reps[part[x]])
                            out_b.append(reps[rest[y]])
        if nearest:
            some = np.flatnonzero(least < _FAR)
            out_a, out_b = [reps[some]], [reps[mate[some]]]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def _in_lots(lists: DataFrame, nearest: bool) -> DataFrame:
    """Candidate pairs (a, b) of long lists: entries of different groups that bitmaps don't tell apart.

    A list is dealt to lots of about LOT entries, and each pair of lots is a task's work, so no list
    is gathered in one task, and only pairs that may link come out, with ``nearest`` one for an entry.
    """
    lots = F.greatest(F.lit(1), F.ceil(F.col("m") / LOT)).cast("int")
    dealt = lists.withColumn("lot", F.pmod(F.xxhash64("rep"), lots).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), lots - 1)))
    dealt = dealt.withColumn("one", F.least("lot", "with")).withColumn("two", F.greatest("lot", "with")).select("token", "one", "two", "lot", "rep", "root", "n", "pos", "bits")
    return dealt.groupBy("token", "one", "two").applyInArrow(_compare(nearest), "a long, b long")


def _can_reach(na, nb, pa_, pb):
    """Whether sizes and positions of a shared shingle leave room for the overlap that a link needs."""
    shared = 1 + F.least(na - pa_, nb - pb) - 1 + F.least(pa_, pb)
    return (9 * shared >= 4 * (na + nb)) & (5 * F.least(na, nb) >= 4 * F.greatest(na, nb))


def _blocks(lists: DataFrame) -> DataFrame:
    """Index lists as blocks by size and position, each with its entries and their extremes."""
    size = F.floor(F.log(1.25, F.col("n"))).cast("int")
    width = F.greatest(F.lit(1), F.floor(F.pow(F.lit(1.25), size) / _POSITIONS))
    blocked = lists.withColumn("sizes", size).withColumn("place", F.floor(F.col("pos") / width).cast("int"))
    extremes = [f(F.col(c)).alias(f"{name}_{c}") for c in ("n", "pos", "root") for name, f in (("lo", F.min), ("hi", F.max))]
    return blocked.groupBy("token", "sizes", "place").agg(F.collect_list(F.struct("rep", "root", "n", "pos")).alias("entries"), F.max(F.col("n") - F.col("pos")).alias("left"), *extremes)


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of a list's blocks, with ``skip``: whether none of their entries can link, or all are one group."""
    a, b = (blocks.select("token", *(F.col(c).alias(f"{c}_{x}") for c in blocks.columns if c != "token")) for x in "ab")
    both = a.join(b, "token").where((F.col("sizes_b") > F.col("sizes_a")) | ((F.col("sizes_b") == F.col("sizes_a")) & (F.col("place_b") >= F.col("place_a"))))
    reach = F.least("left_a", "left_b") + F.least("hi_pos_a", "hi_pos_b")
    may = (9 * reach >= 4 * (F.col("lo_n_a") + F.col("lo_n_b"))) & (5 * F.col("hi_n_a") >= 4 * F.col("lo_n_b")) & (5 * F.col("hi_n_b") >= 4 * F.col("lo_n_a"))
    one_group = F.least("lo_root_a", "lo_root_b") == F.greatest("hi_root_a", "hi_root_b")
    return both.withColumn("skip", ~may | one_group)


def _in_blocks(lists: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of lists of up to LONG entries: entries of different groups in blocks that aren't skipped."""
    pairs = _block_pairs(_blocks(lists)).where(~F.col("skip"))
    same = (F.col("sizes_a") == F.col("sizes_b")) & (F.col("place_a") == F.col("place_b"))
    rows = pairs.select(same.alias("same"), F.explode("entries_a").alias("x"), "entries_b").select("same", "x", F.explode("entries_b").alias("y"))
    rows = rows.where((F.col("x.root") != F.col("y.root")) & (~F.col("same") | (F.col("x.rep") < F.col("y.rep"))))
    rows = rows.where(_can_reach(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")))
    return rows.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))


def _derived(pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``linked`` where it follows from computed distances by the triangle inequality, else null."""
    known = compared.select(F.col("a").alias("x"), F.col("b").alias("y"), "d").union(compared.select("b", "a", "d"))
    near = known.groupBy("x").agg(F.min(F.struct("d", "y")).alias("near"))
    for one, two in (("a", "b"), ("b", "a")):
        to = near.select(F.col("x").alias(one), F.col("near.d").alias(f"d_{one}"), F.col("near.y").alias(f"y_{one}"))
        across = known.select(F.col("x").alias(f"y_{one}"), F.col("y").alias(two), F.col("d").alias(f"across_{one}"))
        pairs = pairs.join(to, one, "left").join(across, [f"y_{one}", two], "left")
    least = F.greatest(F.col("across_a") - F.col("d_a"), F.col("across_b") - F.col("d_b"))
    most = F.least(F.col("across_a") + F.col("d_a"), F.col("across_b") + F.col("d_b"))
    return pairs.select("a", "b", F.when(most <= 0.2 - 1e-9, True).when(least > 0.2 + 1e-9, False).alias("linked"))


def _open(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The entries, each with the root of its group, of those lists that hold several groups."""
    rooted = lists.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = materialize(rooted, "jaccard-rooted")
    several = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    return materialize(rooted.join(several, "token", "left_semi"), "jaccard-open")


def _hubs(compared: DataFrame) -> DataFrame:
    """(x, hub, d): for a class with computed distances of up to CLOSE to classes before it, the first of these."""
    near = compared.where(F.col("d") <= CLOSE).select(F.greatest("a", "b").alias("x"), F.struct(F.least("a", "b").alias("hub"), "d").alias("near"))
    return near.groupBy("x").agg(F.min("near").alias("near")).select("x", "near.*")


def _through_hubs(pairs: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the question ``one``, ``two`` between their hubs and ``slack``, how far these are from them together."""
    for x in "ab":
        pairs = pairs.join(hubs.select(F.col("x").alias(x), F.col("hub").alias(f"hub_{x}"), F.col("d").alias(f"d_{x}")), x, "left")
    hub = {x: F.coalesce(f"hub_{x}", x) for x in "ab"}
    slack = F.coalesce("d_a", F.lit(0.0)) + F.coalesce("d_b", F.lit(0.0))
    return pairs.select("a", "b", F.least(hub["a"], hub["b"]).alias("one"), F.greatest(hub["a"], hub["b"]).alias("two"), slack.alias("slack"))


def _decided(pairs: DataFrame, compared: DataFrame, docs: DataFrame, hot: np.ndarray, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All compared pairs with those of ``pairs``, the links among ``pairs``, and the pairs with what was derived for them.

    First by distances known already; then the hubs' questions are answered, each once, by bitmaps or whole sets, and pairs
    of classes near the hubs have their answers from these. Only pairs whose answer doesn't follow are compared themselves.
    """
    rest = materialize(pairs.distinct().join(compared, ["a", "b"], "left_anti"), "jaccard-left")
    if rest.isEmpty():
        return compared, rest, rest.select("a", "b", F.lit(None).cast("boolean").alias("linked"), F.lit(False).alias("own"))
    told = materialize(_derived(rest, compared), "jaccard-derived")
    hubs = _through_hubs(told.where("linked IS NULL").select("a", "b"), _hubs(compared)).withColumn("linked", F.lit(None).cast("boolean"))
    told = materialize(hubs.unionByName(told.where("linked IS NOT NULL"), allowMissingColumns=True), "jaccard-rest")
    asked = _bounded(told.where("one < two").select(F.col("one").alias("a"), F.col("two").alias("b")).distinct(), classes)
    known = materialize(asked.join(compared.select("a", "b", "d"), ["a", "b"], "left"), "jaccard-asked")
    answers = _from_sets(materialize(known.where("may AND d IS NULL").select("a", "b"), "jaccard-plausible"), docs, hot, classes)
    exact = answers.select("a", "b", F.col("d").alias("found"))
    known = known.join(exact, ["a", "b"], "left").withColumn("d", F.coalesce("found", "d"))
    known = known.select(F.col("a").alias("one"), F.col("b").alias("two"), F.coalesce("d", "least").alias("lo"), "d", "may")

    told = told.join(known, ["one", "two"], "left")
    own = (F.col("a") == F.col("one")) & (F.col("b") == F.col("two"))
    follows = F.when(F.col("d") + F.col("slack") <= 0.2 - 1e-9, True).when(F.col("lo") - F.col("slack") > 0.2 + 1e-9, False)
    told = told.select("a", "b", F.when(~F.coalesce(own, F.lit(False)), F.coalesce("linked", follows)).alias("linked"), F.coalesce(own, F.lit(False)).alias("own"))
    told = materialize(told, "jaccard-told")
    open_pairs = told.where("linked IS NULL AND NOT own").select("a", "b")
    computed = answers.union(_verified(open_pairs, docs, hot, classes)) if not open_pairs.isEmpty() else answers
    return compared.union(computed), told.where("linked").select("a", "b").union(computed.where("linked").select("a", "b")), told


def join(docs: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    component_id is the least doc_id that links reach, the document's own included. Texts without
    words (null, empty) have empty sets and link with nothing. Rows with equal doc_id are rows of
    their own and have equal ids in the result; a null doc_id never names a group that has another. An
    empty table gives an empty result; other columns are ignored. ``counts``, if given, gets how many
    pairs of blocks there were and were skipped, how many pairs of entries had their answers through
    a similar class, how many other pairs were left, how many of these ask their hubs and got their answer from
    these or from other known distances, and how many were compared; this costs extra passes.
    """
    hot = hot_buckets(docs)
    sets = materialize(_sets(docs, hot).withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
    found = sets.where("n > 0").groupBy("digest").agg(
        F.min("row").alias("rep"), F.min("doc_id").alias("least_id"), F.min_by("text_hash", "row").alias("text_hash"), F.first("n").cast("int").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")
    )
    classes = materialize(found, "jaccard-classes")
    # Index lists; a list of one entry makes no pair.
    entries = classes.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    sizes = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    lists = materialize(entries.join(sizes, "token"), "jaccard-lists")

    # Each class with the one before it in short lists, and with the nearest in long ones.
    before = F.lag(F.struct("rep", "n", "pos")).over(Window.partitionBy("token").orderBy("n", "rep"))
    chained = lists.where(F.col("m") <= LONG).withColumn("p", before).where(_can_reach(F.col("n"), F.col("p.n"), F.col("pos"), F.col("p.pos")))
    similar = chained.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b"))
    alone = lists.where(F.col("m") > LONG).withColumn("root", F.col("rep")).join(classes.select("rep", "bits"), "rep")
    compared = _verified(similar.union(_in_lots(alone, nearest=True)).distinct(), docs, hot, classes)
    groups = materialize(components(compared.where("linked").select("a", "b")), "jaccard-groups")

    # What is left: lists that hold several groups. First short ones block by block, and each entry of
    # long ones with the nearest of another group; then all pairs of groups that are still apart.
    short, long_lists = (_open(lists.where(x), groups) for x in (F.col("m") <= LONG, F.col("m") > LONG))
    pairs = _in_blocks(short).union(_in_lots(long_lists.join(classes.select("rep", "bits"), "rep"), nearest=True))
    compared, links, told = _decided(pairs, compared, docs, hot, classes)
    if counts is not None:
        blocks = _block_pairs(_blocks(short)).agg(F.count(F.lit(1)).alias("n"), F.count_if("skip").alias("skipped")).first()
        rooted = lists.join(groups.withColumnRenamed("node", "rep"), "rep").groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
        similar_ones = rooted.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("n")).first()["n"]
        counts |= {"block_pairs": blocks["n"], "skipped": blocks["skipped"], "through_similar": int(similar_ones or 0), "derived": told.where("linked IS NOT NULL").count(), "apart": told.count(), "of_hubs": told.where("NOT own").count(), "compared": compared.count()}
    groups = _regrouped(groups, links)
    long_lists = _open(lists.where(F.col("m") > LONG), groups)
    if not long_lists.isEmpty():
        pairs = _in_lots(long_lists.join(classes.select("rep", "bits"), "rep"), nearest=False)
        groups = _regrouped(groups, _decided(pairs, compared, docs, hot, classes)[1])

    named = classes.select("digest", "rep", "least_id").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(ids, "root").select("digest", "component_id")
    out = sets.select("doc_id", "n", "digest").join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that have a smaller doc_id in their group; columns stay.

    Of repeated rows of one doc_id, one stays. Rows with a null doc_id stay.
    """
    away = join(docs.where("doc_id IS NOT NULL")).where("component_id < doc_id").select("doc_id").distinct()
    names, first = docs.columns, free_name(docs, "_first")
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).orderBy("text")
    return docs.join(away, "doc_id", "left_anti").withColumn(first, F.row_number().over(same)).where(F.col(first) == 1).select(*names)
