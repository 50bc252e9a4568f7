"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures, confirmed on whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.llm.frames import shield, text_key
from renewlens.llm.text import LOWERED, binary_rows, gram_hashes, mix, slices, words
from renewlens.session import stage

SHINGLE = 5
#: Linked from 75 % of the union on.
SIMILAR = 75
#: A signature starts with CHUNKS words of 64 bits for the index, each four minimum hashes of 16 bits.
CHUNKS, SYMBOLS, BITS = 8, 4, 16
#: CHECKS more words follow, on which pairs are compared: the set is dealt into bins by the leading bits
#: of its hashes, and each bin keeps 8 bits of its minimum; 0 stands for an empty bin.
CHECKS, BINS_PER_WORD = 32, 8
#: Symbols of a chunk that may differ. Two signatures that differ in fewer than CHUNKS * (ERRORS + 1)
#: symbols have at most ERRORS different ones in some chunk, so they meet under one of its keys.
ERRORS = 1
_LANES = 0x0001_0001_0001_0001
#: Links that one task contracts at once.
LINKS_PER_TASK = 1_000_000


def _seeds() -> list[tuple[np.uint64, np.uint64]]:
    n = np.arange(1, 2 * CHUNKS * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = mix(n)
    return list(zip(drawn[::2] | np.uint64(1), drawn[1::2]))


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sorted distinct shingle hashes of each text."""
    found = words(texts, LOWERED)
    hashes, count, n = found.hashes(), found.count, len(texts)
    doc, first = found.doc, found.bounds[:-1]
    grams = gram_hashes(hashes, SHINGLE)
    inside = np.flatnonzero(doc[: len(grams)] == doc[SHINGLE - 1:]) if len(grams) else np.zeros(0, np.int64)
    owner, value = [doc[inside]], [grams[inside]]
    for k in range(1, SHINGLE):  # a text of fewer words is one shingle
        short = np.flatnonzero(count == k)
        if len(short):
            owner.append(short)
            value.append(gram_hashes(hashes, k)[first[short]] ^ np.uint64(k))
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[fresh], value[fresh]
    return np.searchsorted(owner, np.arange(n + 1)), value


def _bins(offsets: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The check words of sorted sets: the first hash of every bin is its minimum."""
    n, bins = len(offsets) - 1, CHECKS * BINS_PER_WORD
    owner = np.repeat(np.arange(n), np.diff(offsets))
    place = owner * bins + (value >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    first = np.ones(len(place), dtype=bool)
    first[1:] = place[1:] != place[:-1]
    table = np.zeros(n * bins, np.uint8)
    table[place[first]] = (mix(value[first]) % np.uint64(255)).astype(np.uint8) + 1
    return table.view("<u8").reshape(n, CHECKS)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, n_shingles, set_a, set_b, signature) from doc_id, tk and text.

    set_a and set_b are two sums over the set, 128 bits that tell sets apart.
    """
    schema = "doc_id long, tk long, n_shingles long, set_a long, set_b long, signature array<bigint>"
    seeds = _seeds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, value = _sets(batch.column("text"))
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            at = offsets[:-1][full]
            sums = [np.zeros(batch.num_rows, np.uint64) for _ in range(2)]
            packed = np.zeros((batch.num_rows, CHUNKS + CHECKS), np.uint64)
            if len(full):
                for k, out in enumerate(sums):
                    out[full] = np.add.reduceat(mix(value + np.uint64(2 * k + 1)), at)
                for k, (a, b) in enumerate(seeds):
                    low = mix(np.minimum.reduceat(value * a + b, at)) & np.uint64((1 << BITS) - 1)
                    packed[full, k // SYMBOLS] |= low << np.uint64(BITS * (k % SYMBOLS))
                packed[:, CHUNKS:] = _bins(offsets, value)
            rows = pa.ListArray.from_arrays(
                np.arange(0, packed.size + 1, CHUNKS + CHECKS, dtype=np.int32), pa.array(packed.ravel().view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tk"), pa.array(sizes, pa.int64()),
                 *(pa.array(x.view(np.int64)) for x in sums), rows],
                names=["doc_id", "tk", "n_shingles", "set_a", "set_b", "signature"],
            )

    return docs.select("doc_id", "tk", "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) with the whole set of each document as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, value = _sets(batch.column("text"))
            rows = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<bigint>")


def keys(signature: Column) -> Column:
    """The lookup keys of a signature: every chunk with each choice of ERRORS symbols left out."""
    out = []
    for c in range(CHUNKS):
        for gone in range(SYMBOLS):
            mask = ~(((1 << BITS) - 1) << (BITS * gone)) & ((1 << 64) - 1)
            signed = mask - (1 << 64) if mask >> 63 else mask
            out.append(F.xxhash64(F.lit(c * SYMBOLS + gone), F.element_at(signature, c + 1).bitwiseAND(F.lit(signed))))
    return F.array(*out)


#: Deviations from the expected distance up to which pairs are compared on their sets.
DEVIATIONS = 4.0
#: Rows of a key that one task compares with as many others; larger groups are split into blocks.
BLOCK = 2_000
#: Pairs compared at once.
_PAIRS = 1 << 15


def _wrong(low: np.ndarray) -> np.ndarray:
    """Number of index symbols that differ, per chunk, from the XOR of the index words."""
    for shift in (8, 4, 2, 1):
        low = low | (low >> np.uint64(shift))
    return np.bitwise_count(low & np.uint64(_LANES))


def _first_meeting(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether key number ``at`` is the first that the index words of a pair share."""
    good = _wrong(a[:, :CHUNKS] ^ b[:, :CHUNKS]) <= ERRORS
    chunk = good.argmax(axis=1)
    # a chunk without errors shares all its keys, one with an error only the key that leaves it out
    each = np.arange(len(a))
    same = a[each, chunk] == b[each, chunk]
    return (at // SYMBOLS == chunk) & (~same | (at % SYMBOLS == 0))


def _close(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether check words are as near as sets at the limit of similarity can be.

    At three quarters a quarter of the bins in use differ. Bins draw from the union without
    repetition, so the deviation shrinks as they cover more of it.
    """
    a, b = (np.ascontiguousarray(x[:, CHUNKS:]).view(np.uint8) for x in (a, b))
    distance, used = (a != b).sum(axis=1), ((a | b) != 0).sum(axis=1)
    left = np.maximum(1 - used * 1.75 / (n_a + n_b), 0.02)
    return distance <= used * 0.25 + DEVIATIONS * np.sqrt(used * left * 0.1875) + 1


def _compare(side, at, rep, group, size, signature) -> list[np.ndarray]:
    """Near pairs of different groups among the rows of one key."""
    found, n = [], len(rep)
    step = max(1, _PAIRS // n)
    for lo in range(0, n, step):
        i = np.arange(lo, min(n, lo + step))
        ok = group[i, None] != group[None, :]
        if side.any():  # two blocks: pairs across them only
            ok &= (side[i, None] == 0) & (side[None, :] == 1)
        else:
            ok &= i[:, None] < np.arange(n)[None, :]
        ok &= (100 * size[i, None] >= SIMILAR * size[None, :]) & (100 * size[None, :] >= SIMILAR * size[i, None])
        x, y = np.nonzero(ok)
        x = i[x]
        for keep in (
            lambda: _first_meeting(signature[x], signature[y], at[x]),
            lambda: _close(signature[x], signature[y], size[x], size[y]),
        ):
            if len(x):
                k = keep()
                x, y = x[k], y[k]
        if len(x):
            found.append(np.stack([np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])]))
    return found


_ROW = ("key", "p", "q", "side", "at", "rep", "group", "n_shingles")


def _signatures_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(np.uint64).reshape(-1, CHUNKS + CHECKS)


def near_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): pairs under one key in different groups whose signatures are near.

    ``rows`` has key, at, rep, group, n_shingles, signature and n, the rows of the key. A key of over
    BLOCK rows is split into blocks, every two of which meet in a task group of their own. A pair comes
    out under the first key it shares only.
    """
    spread = (
        rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({
            "p": F.least("mine", "other"), "q": F.greatest("mine", "other"),
            "side": F.when(F.col("mine") > F.col("other"), 1).otherwise(0),
        })
        .select(*_ROW, "signature")
    )
    # the rows of two blocks follow one another in a task
    ordered = spread.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def pairs(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        """Near pairs of the groups that have ended, and the rows of the one that may go on."""
        table = table.combine_chunks()
        c = {name: table.column(name).to_numpy() for name in _ROW}
        signature = _signatures_of(table.column("signature").combine_chunks())
        new = np.ones(len(c["key"]), dtype=bool)
        new[1:] = np.any([c[x][1:] != c[x][:-1] for x in ("key", "p", "q")], axis=0)
        cuts = [*np.flatnonzero(new).tolist(), *([len(new)] if last else [])]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            across = c["p"][a] != c["q"][a]
            if b - a > 1 and (not across or c["side"][a:b].any()):
                out += _compare(*(c[x][a:b] for x in ("side", "at", "rep", "group", "n_shingles")), signature[a:b])
        found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        done = pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])
        return done, table.slice(cuts[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None and rest.num_rows:
                table = pa.concat_tables([rest, table])
            if table.num_rows:
                done, rest = pairs(table, False)
                yield done
        if rest is not None and rest.num_rows:
            yield pairs(rest, True)[0]

    return ordered.mapInArrow(run, "a long, b long")


def _near_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            near = pa.array(_close(*(_signatures_of(batch.column(c)) for c in ("s_a", "s_b")), n_a, n_b))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], names=["a", "b"])


def _similar_size(a: str, b: str) -> Column:
    return (100 * F.col(a) >= SIMILAR * F.col(b)) & (100 * F.col(b) >= SIMILAR * F.col(a))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - F.col("common")
    return (
        pairs.join(left, "a").join(right, "b")
        .withColumn("common", common)
        .where(100 * F.col("common") >= SIMILAR * union)
        .select("a", "b")
    )


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (u, v), v smallest, of the components that the links of one task make."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    stars = [(u, find(u)) for u in list(root)]
    stars = [x for x in stars if x[0] != x[1]]
    for at in range(0, len(stars), 10_000):
        u, v = zip(*stars[at:at + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, for every node with a link.

    Tasks first contract about LINKS_PER_TASK links each. Rounds of large-star and small-star steps then
    turn each component into a star around its smallest node, until a round changes nothing; every
    round is staged in the shared folder.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"))
    edges = edges.coalesce(max(1, edges.count() // LINKS_PER_TASK)).mapInArrow(_contract, "u long, v long")
    edges, last = stage(edges.distinct()), None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == last:
            break
        last = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        moved = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links that join the classes of every group, found by the index and confirmed on sets.

    First each class is compared with the smallest one under each of its keys. Under keys that still
    hold several groups, all pairs of different groups within the signature distance follow. A pair
    left out lies in one group already, so no group misses a link.
    """
    sized = classes.select("rep", "n_shingles", "signature")
    index = classes.select("rep", F.posexplode(keys(F.col("signature"))).alias("at", "key"))
    leaders = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader")).where("n > 1")
    members = stage(index.join(leaders.hint("merge"), "key"))
    wanted = members.select("rep").distinct()
    sets = stage(shingle_sets(docs.join(wanted.hint("merge"), docs["doc_id"] == wanted["rep"], "left_semi")))

    first = members.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    a = sized.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("s_a"))
    b = sized.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("s_b"))
    stars = first.join(a, "a").join(b, "b").where(_similar_size("n_a", "n_b")).mapInArrow(_near_only, "a long, b long")
    groups = components(_confirm(stage(stars), sets))
    placed = stage(
        members.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "at", "rep", "n", F.coalesce("component", "rep").alias("group"))
    )
    mixed = placed.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
    more = stage(near_pairs(placed.join(mixed, "key", "left_semi").join(sized, "rep")))
    known = groups.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return known.unionByName(_confirm(more, sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, n_shingles, component_id, kept) per row of ``docs``.

    Documents with equal sets are one class, and classes are linked at a similarity of 75 %.
    component_id is the smallest doc_id of the group. A document without words is a group of its own,
    and so is one without doc_id, whose component_id is null and which is kept. Rows that share a
    doc_id are one document: linked with what any of them is linked with.
    """
    keyed = docs.select("doc_id", "text", text_key().alias("tk"))
    base = stage(signatures(keyed))
    classes = stage(
        base.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    )
    groups = components(_links(keyed, classes))
    of_set = classes.join(groups, classes["rep"] == groups["node"], "left").select(
        "set_a", "set_b", F.coalesce("component", "rep").alias("group")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id"))
    return base.join(of_set, ["set_a", "set_b"], "left").select(
        "doc_id", "tk", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with the columns of ``docs``."""
    inner, restore = shield(docs, "doc_id", "text")
    gone = near_duplicates(inner).where("not kept").select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).distinct()
    left = inner.withColumn("_k", text_key())
    return restore(left.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_k") == F.col("_tk")), "left_anti"))
