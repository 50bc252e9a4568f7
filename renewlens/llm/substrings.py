"""Substring dedup: words inside long sequences that a document with a smaller id holds too.

Texts are cut into fragments at minimizers: all windows of one fragment share the smallest hash of
their inner word n-grams. Equal windows have equal minimizers, so they meet in the shard of that
hash. Each shard builds a compressed index of its distinct fragments, and the fragments of all
documents stream past it by backward search. Windows under a hash that is too common for one shard are
sent one by one, each to the shard of the hash of all its words, so equal ones still meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewlens.llm.fm_index import FMIndex, range_minimum
from renewlens.llm.frames import shield, text_key
from renewlens.llm.text import Words, gram_hashes, inside_text, mix, slices, words

WINDOW = 13
#: Words of the n-grams whose smallest hash decides the shard of a window.
ANCHOR = 4
#: Fragment bytes a task gathers before it sends them on, one packet per shard.
BUFFER_BYTES = 24 << 20
#: Shards per shuffle partition at least, and bytes of text for a shard on average at most. Fragments hold about
#: three times the text.
SHARDS_PER_PARTITION, SHARD_BYTES = 2, 64 << 20
#: Anchors are counted by buckets of their hash; the windows of a bucket with more fragment bytes are sent one by one.
BUCKETS, HOT_BYTES = 1 << 22, 256 << 20
#: Bytes of text whose fragments a task counts at once.
COUNT_BYTES = 32 << 20

_CODEC = "zstd"
_LEVEL = 3
_PACKET = "shard int, kind int, size long, body binary, sizes array<int>"
_RANGES = "doc_id long, tag int, first int, n int"


def _compress(raw: bytes) -> bytes:
    return pa.Codec(_CODEC, compression_level=_LEVEL).compress(raw, asbytes=True)


def _pack(*arrays: np.ndarray) -> tuple[bytes, list[int], int]:
    raw = [np.ascontiguousarray(a).view(np.uint8).tobytes() for a in arrays]
    whole = b"".join(raw)
    return _compress(whole), [len(x) for x in raw], len(whole)


def _unpack(body: bytes, sizes: list[int], size: int, kinds: tuple) -> list[np.ndarray]:
    whole = np.frombuffer(pa.decompress(body, size, _CODEC, asbytes=True), np.uint8)
    ends = np.cumsum([0, *sizes])
    return [whole[a:b].view(k) for a, b, k in zip(ends[:-1], ends[1:], kinds)]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start:start + size] of every range, joined."""
    ends = np.cumsum(size)
    if not len(size) or not ends[-1]:
        return data[:0]
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]


def _anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Smallest n-gram hash of every window."""
    low, width, need = gram_hashes(hashes, anchor), 1, window - anchor + 1
    while width * 2 <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = need - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _fragments(
    found: Words, window: int, anchor: int, hot: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, key, identity) of each run of windows with one key in one text.

    The key of a window is its anchor, or the hash of all its words if its anchor's bucket is in ``hot``.
    """
    hashes = found.hashes()
    if len(hashes) < window:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    low, doc = _anchors(hashes, window, anchor), found.doc[: len(hashes) - window + 1]
    if hot is not None and len(hot):
        low = np.where(np.isin(low % np.uint64(BUCKETS), hot), gram_hashes(hashes, window), low)
    inside = inside_text(found, window)
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    bounds = np.flatnonzero(new | ~inside)
    after = np.append(bounds, len(low))[np.searchsorted(bounds, first) + 1]
    count = after - first
    # identity: a hash of the words of the fragment, its length and its key
    sums = np.zeros(len(hashes) + 1, np.uint64)
    weights = mix(np.arange(1, 2, dtype=np.uint64))[0] | np.uint64(1)
    np.cumsum(hashes * _geometric(int(weights), len(hashes)), out=sums[1:])
    down = _geometric(pow(int(weights), -1, 1 << 64), len(hashes))
    value = (sums[first + count + window - 1] - sums[first]) * down[first]
    return first, count, low[first], mix(value + count.astype(np.uint64)) ^ low[first]


_POWERS: dict[int, np.ndarray] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    found = _POWERS.get(base, np.ones(1, np.uint64))
    while len(found) < n:
        found = np.concatenate([found, found * np.uint64(pow(base, len(found), 1 << 64))])
    _POWERS[base] = found
    return found[:n]


def hot_buckets(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, limit: int | None = None) -> np.ndarray:
    """Sorted buckets of anchors whose fragments hold over ``limit`` bytes, or over half of it.

    A task that counts b of all B bytes of text leaves out its buckets under limit * b / 2B bytes. All
    that is left out of a bucket sums to less than half the limit, so none over the limit is missed.
    The result has at most :data:`BUCKETS` numbers at any size of the corpus.
    """
    limit = limit or HOT_BYTES
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if got:
                bucket, size = (np.concatenate(x) for x in zip(*got))
                sums = np.bincount(bucket, size, BUCKETS)
                often = np.flatnonzero((sums > 0) & (sums >= limit * held / (2 * total)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(often, pa.int64()), pa.array(sums[often].astype(np.int64))], names=["bucket", "size"]
                )
            got.clear()

        for batch in slices(batches, "text", 1 << 20):
            found = words(batch.column("text"))
            held += int(found.first[-1])
            first, count, low, _ = _fragments(found, window, anchor)
            begin = np.concatenate([[0], np.cumsum(found.end - found.start + 1)])
            size = begin[first + count + window - 1] - begin[first]
            got.append(((low % np.uint64(BUCKETS)).astype(np.int64), size))
            if held > COUNT_BYTES:
                yield from flush()
                held = 0
        yield from flush()

    sums = docs.select("text").mapInArrow(run, "bucket long, size long").groupBy("bucket").agg(F.sum("size").alias("size"))
    rows = sums.where(F.col("size") >= limit / 2).select("bucket").toArrow()
    return np.sort(rows.column("bucket").to_numpy()).astype(np.uint64)


def _packets(docs: DataFrame, shards: int, window: int, anchor: int, hot: np.ndarray) -> DataFrame:
    """Fragments of all documents, packed per shard, and ranges that a packet decides by itself.

    Within a slice of documents equal fragments are sent once, for the smallest doc_id. Its other
    documents hold a copy of a smaller document, which decides their windows without the index. So a
    passage that many documents share reaches its shard once per slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        decided: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for shard, got in parts.items():
                rows.append((shard, 0, *_pack(*(np.concatenate(x) for x in zip(*got)))))
            if decided:
                doc, tag, first, n = (np.concatenate(x) for x in zip(*decided))
                to = (mix(doc.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
                for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                    at = order[a:b]
                    rows.append((int(to[at[0]]), 1, *_pack(doc[at], tag[at], first[at], n[at])))
            parts.clear()
            decided.clear()
            for at in range(0, len(rows), 64):
                shard, kind, body, sizes, size = zip(*rows[at:at + 64])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(size, pa.int64()),
                     pa.array(body, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))],
                    names=["shard", "kind", "size", "body", "sizes"],
                )

        for batch in slices(batches, "text", 1 << 20):
            found = words(batch.column("text"))
            first, count, low, identity = _fragments(found, window, anchor, hot)
            if not len(first):
                continue
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            tags = batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int32)
            text = np.repeat(np.arange(batch.num_rows), found.count)[first]
            doc, at = ids[text], first - found.bounds[:-1][text]
            order = np.lexsort((doc, identity))
            lead = np.ones(len(order), dtype=bool)
            lead[1:] = identity[order[1:]] != identity[order[:-1]]
            smallest = doc[order[np.flatnonzero(lead)]][np.cumsum(lead) - 1]
            later = order[doc[order] > smallest]
            decided.append((doc[later], tags[text[later]], at[later].astype(np.int32), count[later].astype(np.int32)))
            sent = order[doc[order] == smallest]
            # the words of the slice with one blank after each, so that a fragment is one range of bytes
            plain = found.arrow()
            sizes = found.end - found.start
            begin = np.concatenate([[0], np.cumsum(sizes + 1)])
            blanked = np.full(int(begin[-1]), 32, np.uint8)
            keep = np.ones(len(blanked), dtype=bool)
            keep[begin[1:] - 1] = False
            blanked[keep] = np.frombuffer(plain.buffers()[2], np.uint8, int(sizes.sum()))
            to = (low[sent] % np.uint64(shards)).astype(np.int64)
            sent = sent[np.argsort(to, kind="stable")]
            to = np.sort(to)
            cuts = np.flatnonzero(np.diff(to, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(sent))):
                k = sent[a:b][np.argsort(text[sent[a:b]], kind="stable")]
                last = first[k] + count[k] + window - 1
                size = begin[last] - begin[first[k]]
                parts.setdefault(int(to[a]), []).append((
                    (low[k] >> np.uint64(32)).astype(np.uint32), doc[k], tags[text[k]], at[k].astype(np.int32),
                    (count[k] + window - 1).astype(np.int32), size.astype(np.int32), _gather(blanked, begin[first[k]], size),
                ))
                held += int(size.sum())
            if held > BUFFER_BYTES:
                yield from flush()
                held = 0
        yield from flush()

    return docs.mapInArrow(run, _PACKET)


_KINDS = (np.uint32, np.int64, np.int32, np.int32, np.int32, np.int32, np.uint8)


def _shard_ranges(table: pa.Table, window: int) -> pa.Table:
    """Ranges of windows of one shard's documents that stand in a smaller document."""
    out: list[tuple] = []
    kinds, sizes, lengths = (table.column(c).to_pylist() for c in ("kind", "sizes", "size"))
    bodies = table.column("body")
    anchors, kept = [], []
    for i, kind in enumerate(kinds):
        if kind == 1:
            out.append(tuple(_unpack(bodies[i].as_py(), sizes[i], lengths[i], (np.int64, np.int32, np.int32, np.int32))))
        else:
            anchors.append(i)
    lows = [_unpack(bodies[i].as_py(), sizes[i], lengths[i], _KINDS)[0] for i in anchors]
    if lows:
        values, times = np.unique(np.concatenate(lows), return_counts=True)
        often = values[times > 1]
    for i, low in zip(anchors, lows):
        take = np.flatnonzero(np.isin(low, often))
        if len(take):  # a key that came once has no equal window elsewhere
            _, doc, tag, first, n_words, size, data = _unpack(bodies[i].as_py(), sizes[i], lengths[i], _KINDS)
            start = np.cumsum(size.astype(np.int64)) - size
            kept.append((doc[take], tag[take], first[take], n_words[take], size[take], _gather(data, start[take], size[take].astype(np.int64))))
    if kept:
        out.append(_search(*(np.concatenate(x) for x in zip(*kept)), window))
    columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), *[np.zeros(0, np.int32)] * 3]
    return pa.table(dict(zip(("doc_id", "tag", "first", "n"), map(pa.array, columns))))


def _search(doc, tag, first, n_words, size, data, window: int) -> tuple:
    """Index the distinct fragments, stream all of them past it, keep windows of smaller documents."""
    offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    whole = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = whole.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary
    owner = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(owner, which, doc)
    lengths = np.zeros(len(distinct), np.int64)
    lengths[which] = n_words
    # words as numbers from 1, a 0 after each fragment
    found = words(distinct.cast(pa.large_string()))
    ids, symbols = found.ids()
    ends = np.cumsum(lengths + 1)
    text = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(text), dtype=bool)
    inside[ends - 1] = False
    text[inside] = ids + 1
    index = FMIndex(text, symbols + 1)
    of_place = np.repeat(owner, lengths + 1)[index.places]
    windows = lengths - window + 1
    begin = np.concatenate([[0], np.cumsum(windows)])
    asked = np.repeat(ends - 1 - lengths - begin[:-1], windows) + np.arange(begin[-1]) + window
    size_of, lo, hi = index.matches(text, asked, window)
    smallest = np.where(size_of >= window, range_minimum(of_place, lo, hi), np.iinfo(np.int64).max)
    # back to the fragments as they came: runs of windows held by a smaller document
    count = windows[which]
    stop = np.cumsum(count)
    at = np.repeat(begin[:-1][which] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)
    fragment = np.repeat(np.arange(len(which)), count)
    hit = smallest[at] < doc[fragment]
    head = hit.copy()
    head[1:] &= ~hit[:-1] | (fragment[1:] != fragment[:-1])
    heads = np.flatnonzero(head)
    run = np.add.reduceat(hit.astype(np.int32), heads) if len(heads) else np.zeros(0, np.int32)
    f = fragment[heads]
    inner = heads - (stop - count)[f]
    return doc[f], tag[f], (first[f] + inner).astype(np.int32), run.astype(np.int32)


def shard_count(docs: DataFrame) -> int:
    """Shards for the texts of ``docs``: as many as their bytes need, whatever the number of partitions."""
    least = SHARDS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-total // SHARD_BYTES))


def copied_ranges(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shards: int | None = None, hot_bytes: int | None = None
) -> DataFrame:
    """(doc_id, tag, first, n): windows of each document that start in a document with a smaller id.

    ``tag`` is a part of the text's fingerprint and keeps rows with one id and several texts apart.
    Rows without doc_id or text take no part. ``shards`` bounds the memory of a task and by default follows
    the bytes of text; ``hot_bytes`` is the limit of :func:`hot_buckets`, whose anchors no shard holds alone.
    The result is the same for all values of both.
    """
    shards = shards or shard_count(docs)
    tag = text_key().bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    known = docs.where("doc_id is not null and text is not null").select("doc_id", tag.alias("tag"), "text")
    packets = _packets(known, shards, window, anchor, hot_buckets(known, window, anchor, hot_bytes))
    return packets.groupBy("shard").applyInArrow(lambda table: _shard_ranges(table, window), _RANGES)


def _packed_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with each text as its size and compressed bytes, in the columns _size and _body."""
    names = [c for c in docs.columns if c != "text"]
    schema = T.StructType([
        *(docs.schema[c] for c in names), T.StructField("_size", T.IntegerType()), T.StructField("_body", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw = [None if x is None else x.encode() for x in batch.column("text").to_pylist()]
            sizes = pa.array([None if x is None else len(x) for x in raw], pa.int32())
            body = pa.array([None if x is None else _compress(x) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), sizes, body], names=[*names, "_size", "_body"]
            )

    return docs.mapInArrow(run, schema)


def _unpacked_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("_size").to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.nan_to_num(sizes.astype(float)))
        at = 0
        while at < batch.num_rows:  # about 8 MB of text at once
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (8 << 20), side="right")))
            part = batch.slice(at, stop - at)
            texts = [
                None if n is None else pa.decompress(b, n, _CODEC, asbytes=True).decode()
                for n, b in zip(part.column("_size").to_pylist(), part.column("_body").to_pylist())
            ]
            rest = [c for c in part.schema.names if c not in ("_size", "_body")]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, "text"]
            )
            at = stop


def dedup_substrings(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """All columns of ``docs`` with n_words, n_removed and kept, the words left joined by one blank.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller
    doc_id. A row without doc_id keeps all its words; a null text has none. Rows with one doc_id never
    take words from each other. Columns under the new names have to be shielded by the caller.
    """
    ranges = (
        copied_ranges(docs, window, **options)
        .groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "n")).alias("_cut"))
        .select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "_cut")
    )
    names = docs.columns
    tag = text_key().bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    # texts go through the shuffle of the join compressed
    packed = _packed_texts(docs.withColumn("_t", tag))
    joined = packed.join(
        ranges.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.col("_t") == F.col("_tag")), "left"
    ).drop("_t", "_id", "_tag").withColumns({"_first": F.col("_cut.first"), "_n": F.col("_cut.n")}).drop("_cut")
    schema = T.StructType([
        *docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(_unpacked_texts(batches), "text"):
            found = words(batch.column("text"))
            first, n = (batch.column(c).to_pylist() for c in ("_first", "_n"))
            removed, kept = [], []
            for d in range(batch.num_rows):
                a, total = int(found.bounds[d]), int(found.count[d])
                gone = np.zeros(total + 1, np.int64)
                if first[d]:
                    at, many = np.array(first[d]), np.array(n[d])
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + many + window - 1, -1)
                stays = np.cumsum(gone)[:-1] == 0
                edge = np.flatnonzero(stays)
                removed.append(total - len(edge))
                spans = zip(found.start[a + edge].tolist(), found.end[a + edge].tolist())
                kept.append(b" ".join([found.raw[x:y].tobytes() for x, y in spans]).decode())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(found.count, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())],
                names=[*names, "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(run, schema)


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """Documents with the words left as their text, columns as in ``docs``; null texts stay null."""
    inner, restore = shield(docs, "doc_id", "text")
    done = dedup_substrings(inner, **options)
    return restore(done.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept"))))


