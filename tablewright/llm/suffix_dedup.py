"""Byte dedup: removes every byte of a string of ``LENGTH`` bytes that also starts earlier.

Cover samples tell which strings can be repeated, and only these are grouped, by hash; no
order of suffixes is formed and no ranks are assigned. Positions whose number modulo
``PERIOD`` is in ``COVER`` are the sample; any two positions have a sample at a common
distance below ``PERIOD``. Samples are grouped by the ``PREFIX`` = LENGTH - PERIOD + 1 bytes
that lie in every string reaching them, a bucket of hashes at a time. Two equal strings
have at a common distance samples of equal prefix, so a string none of whose samples shares
its prefix occurs once. The others are grouped by their ``LENGTH`` bytes, again a bucket at
a time; each after the first of its class starts earlier elsewhere. Tasks over slices of texts
(4 MB, or one longer text) send a prefix to its bucket once, however often the slice holds it,
so a bucket has ``BUCKET_ENTRIES`` on average, as the number of buckets follows the input, and
a frequent prefix adds to its own at most one entry per slice. Texts are dealt into lots by
their keys; a bucket answers a lot, not each text, and a lot meets its answers in one task.
The stretches found are put in the order of the texts and cut into chunks. A chunk sends a string once,
and as chunks are in order, their numbers alone tell which of equal strings starts first.

Only the equality of strings matters here, so strings are compared by hashes: of 32
bits and the bucket for samples (a chance agreement costs some work only), of 96
bits for the strings themselves. Equal texts, told by their SHA-256, count once, as the smallest number's;
a later one is removed whole if it has ``LENGTH`` bytes. Texts go by 64-bit keys made from
the digest; that no two digests share a key is checked, and other keys are taken if they do.

Defined results: a null text is empty; texts shorter than ``LENGTH`` lose nothing;
of rows with the same number and text one is the first, and both keep what it keeps;
rows without a number come before all others. Columns with the names of the new ones
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.shared import discard, keep, packed, unpacked
from tablewright.llm.words import mix, slices, text_bytes
from tablewright.names import quote_ident

LENGTH = 100
PERIOD = 57
# Fixed value: a perfect difference set modulo 57.
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
PREFIX = LENGTH - PERIOD + 1
#: Entries of a bucket, on average.
BUCKET_ENTRIES = 1_000_000
#: Bytes of a lot of texts, and of the stretches of a chunk, on average.
LOT_BYTES, CHUNK_BYTES = 16_000_000, 1_000_000
#: Tables up to these sizes are broadcast, else joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
# Odd multipliers of two independent polynomial hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_codes = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in _BASES]
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _tables or len(_tables[which][0]) < n:
        both = (_BASES[which], pow(_BASES[which], -1, 1 << 64))
        _tables[which] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16) - 1, b, np.uint64)])) for b in both)
    return _tables[which]


def hashes(data: np.ndarray, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each position, in blocks of bounded size."""
    out = np.empty(len(at), np.uint64)
    block = 1 << 20
    edges = np.searchsorted(at, np.arange(0, len(data) + block, block))
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            part = data[i * block : (i + 1) * block + length]
            up, down = _powers(which, len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_codes[which][part] * up[: len(part)], out=sums[1:])
            own = at[a:b] - i * block
            out[a:b] = mix((sums[own + length] - sums[own]) * down[own])
    return out


def samples(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the data, row) of the samples that have a whole prefix, texts one after the other."""
    sizes = np.diff(offsets)
    longest = int(sizes.max(initial=0))
    base = np.flatnonzero(np.isin(np.arange(longest) % PERIOD, COVER))
    counts = np.where(sizes >= LENGTH, np.searchsorted(base, sizes - PREFIX, side="right"), 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[row] + base[nth], row


def _bucketed(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _classes(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket and 32 bits of each hash, as one number."""
    return (_bucketed(h, n_buckets).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _distinct_texts(docs: DataFrame, copies: DataFrame, few: bool) -> DataFrame:
    """``doc_id, key, text``: the texts of which this row is the first."""
    joined = docs.join(F.broadcast(copies) if few else copies, "key", "left")
    return joined.filter(F.col("first").isNull() | F.col("first")["doc_id"].eqNullSafe(F.col("doc_id"))).select("doc_id", "key", "text")


def _repeated_samples(texts: DataFrame, n_buckets: int, n_lots: int) -> DataFrame:
    """``lot, classes``: a row for each bucket and lot of texts, with the packed classes of the lot's
    samples that other samples share.

    A slice of texts sends each of its classes to the class's bucket once. A class that the
    slice holds repeatedly is known to be shared: its lots are told so from there, through
    buckets from ``n_buckets`` on, which only pass this on."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                data, offsets = text_bytes(part.column(2))
                at, row = samples(offsets)
                every = _classes(hashes(data, at, PREFIX), n_buckets)
                lot = (part.column(1).to_numpy() % n_lots)[row]
                _, first, inverse, count = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
                sent = first[np.argsort(lot[first], kind="stable")]
                bucket = (every[sent] >> np.uint64(32)).astype(np.int64)
                out = []
                for b, (prefix, lots) in packed(bucket, n_buckets, every[sent].astype(np.uint32), lot[sent]):
                    which, n = np.unique(np.frombuffer(lots, np.int64), return_counts=True)
                    out.append((b, prefix, which.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()))
                known = np.flatnonzero(count[inverse] > 1)
                if len(known):
                    which, n, shared = _by_lot(lot[known], every[known])
                    out.append((n_buckets + int(which[0]) % n_buckets, shared.tobytes(), which.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3))], names=["bucket", "prefix", "lot", "n"])

    def rank(table: pa.Table) -> pa.Table:
        lot = np.repeat(*(unpacked(table[c], np.int32) for c in ("lot", "n")))
        bucket = table["bucket"][0].as_py()
        if bucket >= n_buckets:
            shared = unpacked(table["prefix"], np.uint64)
        else:
            prefix = unpacked(table["prefix"], np.uint32)
            order = np.argsort(prefix, kind="stable")
            ordered = prefix[order]
            same = ordered[1:] == ordered[:-1]
            tied = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            shared, lot = prefix[tied].astype(np.uint64) | np.uint64(bucket << 32), lot[tied]
        which, n, shared = _by_lot(lot, shared)
        ends = np.cumsum(n)
        blobs = [shared[a:b].tobytes() for a, b in zip(ends - n, ends)]
        return pa.table({"lot": pa.array(which.astype(np.int64)), "classes": pa.array(blobs, pa.binary())})

    return texts.mapInArrow(write, "bucket int, prefix binary, lot binary, n binary").groupBy("bucket").applyInArrow(rank, "lot long, classes binary")


def _by_lot(lot: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lots, how many classes each has, and the classes, by lot, each once."""
    order = np.lexsort((shared, lot))
    lot, shared = lot[order], shared[order]
    new = np.ones(len(lot), bool)
    new[1:] = (shared[1:] != shared[:-1]) | (lot[1:] != lot[:-1])
    which, n = np.unique(lot[new], return_counts=True)
    return which, n, shared[new]


def _regions(texts: DataFrame, told: DataFrame, n_buckets: int, n_lots: int) -> DataFrame:
    """The stretches of text whose strings may be repeated: ``doc, key`` of the text, and packed
    starts, sizes and bytes of its stretches."""
    names = ["doc", "key", "start", "size", "body"]
    schema = "doc long, key long, start binary, size binary, body binary"

    def run(_: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        known = np.unique(unpacked(answers["classes"], np.uint64)) if own.num_rows and answers.num_rows else []
        for batch in own.combine_chunks().to_batches() if len(known) else ():
            for part in slices(batch, 2):
                data, offsets = text_bytes(part.column(2))
                at, row = samples(offsets)
                shared = np.isin(_classes(hashes(data, at, PREFIX), n_buckets), known)
                hit, owner = at[shared], row[shared]
                # a string from PERIOD - 1 bytes before a sample up to it holds the sample's prefix
                low = np.maximum(hit - (PERIOD - 1), offsets[owner])
                high = np.minimum(hit, offsets[owner + 1] - LENGTH)
                open_ = low <= high
                low, high, owner = low[open_], high[open_], owner[open_]
                if not len(low):
                    continue
                new = np.concatenate([[True], (low[1:] > high[:-1] + 1) | (owner[1:] != owner[:-1])])
                begin = low[new]
                group = np.cumsum(new) - 1
                last = np.zeros(len(begin), np.int64)
                np.maximum.at(last, group, high)
                owner = owner[new]
                size = last - begin + LENGTH
                ids, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
                edges = np.append(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), len(owner))
                for a, b in zip(edges, edges[1:]):
                    i = owner[a]
                    body = np.concatenate([data[x : x + n] for x, n in zip(begin[a:b], size[a:b])])
                    out.append((-(1 << 63) if ids[i] is None else ids[i], keys[i], (begin[a:b] - offsets[i]).tobytes(), size[a:b].tobytes(), body.tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array([r[k] for r in out], kind) for k, (c, kind) in enumerate(zip(names, kinds))})

    dealt = texts.select("doc_id", "key", "text", F.pmod("key", F.lit(n_lots).cast("long")).alias("lot")).groupBy("lot")
    return dealt.cogroup(told.groupBy("lot")).applyInArrow(run, schema)


def _chunks(regions: DataFrame, n_parts: int) -> DataFrame:
    """The stretches in the order of the texts, a row for about ``CHUNK_BYTES`` of them: packed keys,
    starts, sizes and bytes, and ``chunk``, whose order is that of the texts. No text is in two chunks."""
    most = CHUNK_BYTES

    def row(texts: list[tuple]) -> pa.RecordBatch:
        key = np.concatenate([np.full(len(start) // 8, k, np.int64) for k, start, _, _ in texts])
        values = (key.tobytes(), *(b"".join(x[i] for x in texts) for i in (1, 2, 3)))
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["key", "start", "size", "body"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = [], 0
        for batch in batches:
            for text in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                texts.append(text)
                held += len(text[3])
                if held >= most:
                    yield row(texts)
                    texts, held = [], 0
        if texts:
            yield row(texts)

    ordered = regions.repartitionByRange(n_parts, "doc", "key").sortWithinPartitions("doc", "key")
    return ordered.mapInArrow(gather, "key binary, start binary, size binary, body binary").withColumn("chunk", F.monotonically_increasing_id())


def _strings(size: np.ndarray) -> np.ndarray:
    """Places of the strings in the chunk's bytes: all but the last LENGTH - 1 of each stretch."""
    counts = size - LENGTH + 1
    stretch = np.repeat(np.arange(len(size)), counts)
    return np.arange(len(stretch)) - np.repeat(np.cumsum(counts) - counts, counts) + (np.cumsum(size) - size)[stretch], stretch


def _firsts(size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places, stretches and both hashes of the chunk's strings, and whether each is the chunk's first of its kind."""
    at, stretch = _strings(size)
    one = hashes(data, at, LENGTH)
    two = (hashes(data, at, LENGTH, 1) >> np.uint64(32)).astype(np.uint32)
    # the strings are in order, and stable sorts keep them so
    kinds = np.argsort(one, kind="stable")
    a, b = one[kinds], two[kinds]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        kinds = np.lexsort((two, one))
        a, b = one[kinds], two[kinds]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    first = np.ones(len(at), bool)
    first[kinds[1:][same]] = False
    return at, stretch, one, two, first


def _later(chunks: DataFrame, n_buckets: int) -> DataFrame:
    """``chunk, bucket, later``: a bit for each first string of the chunk in the bucket, set if it starts earlier elsewhere.

    The chunk's other strings start earlier in it and are not sent, so that a string, however
    frequent, has one entry per chunk at most."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, data = np.frombuffer(batch.column(0)[i].as_py(), np.int64), np.frombuffer(batch.column(1)[i].as_py(), np.uint8)
                _, _, h, more, first = _firsts(size, data)
                h, more = h[first], more[first]
                out = [(b, one, two) for b, (one, two) in packed(_bucketed(h, n_buckets), n_buckets, h, more)]
                chunk = pa.array([batch.column(2)[i].as_py()] * len(out), pa.int64())
                yield pa.RecordBatch.from_arrays([chunk, pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2))], names=["chunk", "bucket", "one", "two"])

    def sort(table: pa.Table) -> pa.Table:
        one, two = (unpacked(table[c], t) for c, t in (("one", np.uint64), ("two", np.uint32)))
        sizes = np.array([len(x) // 8 for x in table["one"].to_pylist()], np.int64)
        # a string has one entry in a chunk, and chunks are in the order of the texts
        order = np.lexsort((np.repeat(table["chunk"].to_numpy(), sizes), two, one))
        a, b = one[order], two[order]
        same = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])]) if len(a) else np.zeros(0, bool)
        later = np.zeros(len(one), bool)
        later[order] = same
        ends = np.cumsum(sizes)
        bits = [np.packbits(later[e - s : e]).tobytes() for s, e in zip(sizes, ends)]
        return pa.table({"chunk": table["chunk"].combine_chunks(), "bucket": table["bucket"].combine_chunks(), "later": pa.array(bits, pa.binary())})

    sent = chunks.select("size", "body", "chunk").mapInArrow(write, "chunk long, bucket int, one binary, two binary")
    return sent.groupBy("bucket").applyInArrow(sort, "chunk long, bucket int, later binary")


def _removed(chunks: DataFrame, later: DataFrame, n_buckets: int) -> DataFrame:
    """``key, first, last``: the merged removed byte runs of each text, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, start, size = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in range(3))
                data = np.frombuffer(batch.column(3)[i].as_py(), np.uint8)
                at, stretch, h, _, first = _firsts(size, data)
                sent = np.flatnonzero(first)
                bucket = _bucketed(h[sent], n_buckets)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                order = sent[order]
                hit = ~first
                for b, bits in zip(batch.column(4)[i].as_py(), batch.column(5)[i].as_py()):
                    mine = order[edges[b] : edges[b + 1]]
                    hit[mine] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine)).astype(bool)
                place = (start - (np.cumsum(size) - size))[stretch[hit]] + at[hit]
                of = key[stretch[hit]]
                if not len(of):
                    continue
                new = np.concatenate([[True], (of[1:] != of[:-1]) | (place[1:] > place[:-1] + LENGTH)])
                last = np.append(np.flatnonzero(new)[1:] - 1, len(of) - 1)
                first, stop, of = place[new], place[last] + LENGTH, of[new]
                edge = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(of))
                spans = [(int(of[a]), first[a:b].tobytes(), stop[a:b].tobytes()) for a, b in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in spans], pa.int64()), *(pa.array([s[k] for s in spans], pa.binary()) for k in (1, 2))], names=["key", "first", "last"])

    told = later.groupBy("chunk").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("later").alias("later"))
    joined = chunks.select("chunk", "key", "start", "size", "body").join(told, "chunk").select("key", "start", "size", "body", "buckets", "later")
    return joined.mapInArrow(run, "key long, first binary, last binary")


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def text_key(body: Column, salt: int) -> Column:
    return F.xxhash64(_digest(body), F.lit(salt))


def deduplicate_bytes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``n_bytes, n_removed, spans`` (removed byte runs as (first, stop)) and ``kept``, the bytes left."""
    added = ("n_bytes", "n_removed", "spans", "kept")
    df = df.drop(*added)
    body = F.coalesce(F.col(quote_ident(text)), F.lit(""))
    own = F.col(quote_ident(doc_id)).cast("long")
    for salt in range(8):
        key = text_key(body, salt)
        by_row = df.select(own.alias("doc_id"), key.alias("key"), F.octet_length(body).cast("long").alias("size"), _digest(body).alias("digest"))
        by_row = by_row.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.min("digest").alias("low"), F.max("digest").alias("high"))
        first = F.min(F.struct("doc_id", F.col("n").alias("rows")))
        one = (F.min("low") == F.max("high")).alias("one")
        by_text = keep(by_row.groupBy("key").agg(first.alias("first"), F.sum("n").alias("n"), F.first("size").alias("size"), one), "suffixes")
        if not by_text.filter("not one").head(1):
            break
    else:
        raise RuntimeError("no keys found under which different texts differ")
    docs = df.select(own.alias("doc_id"), key.alias("key"), body.alias("text"))
    copies = by_text.filter("n > 1").select("key", "first")
    few_copies = copies.count() <= BROADCAST_ROWS
    total = by_text.agg(F.sum("size")).first()[0] or 0
    texts = _distinct_texts(docs, copies, few_copies)
    twice = copies.filter("first.rows > 1").select("key")
    if twice.head(1):  # rows with the same number and text count once
        texts = texts.join(twice, "key", "left_anti").select(*texts.columns).unionByName(texts.join(twice, "key", "left_semi").dropDuplicates(["key"]))
    n_buckets, n_lots = max(16, total * len(COVER) // PERIOD // BUCKET_ENTRIES), max(16, total // LOT_BYTES)
    regions = keep(_regions(texts, _repeated_samples(texts, n_buckets, n_lots), n_buckets, n_lots), "suffixes")
    unresolved = regions.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    chunks = keep(_chunks(regions, max(2, unresolved // (4 * CHUNK_BYTES))), "suffixes")
    discard(regions)
    n_buckets = max(16, unresolved // BUCKET_ENTRIES)
    later = keep(_later(chunks, n_buckets), "suffixes")
    removed = keep(_removed(chunks, later, n_buckets), "suffixes")
    discard(later)
    span_bytes = removed.agg(F.sum(F.octet_length("first") * 2 + 24)).first()[0] or 0

    rest = df.columns
    rows = df.withColumns({"__key": key, "__body": body, "__id": F.col(quote_ident(doc_id)).cast("long")})
    firsts = copies.select(F.col("key").alias("__key"), F.col("first")["doc_id"].alias("__own"), F.lit(True).alias("__copied"))
    rows = rows.join(F.broadcast(firsts) if few_copies else firsts, "__key", "left")
    spans = removed.withColumnsRenamed({"key": "__key", "first": "__first", "last": "__last"})
    rows = rows.join(F.broadcast(spans) if span_bytes <= BROADCAST_BYTES else spans, "__key", "left")
    later_copy = F.coalesce(F.col("__copied"), F.lit(False)) & ~F.col("__own").eqNullSafe(F.col("__id"))
    rows = rows.select(*[F.col(quote_ident(c)) for c in rest], "__body", later_copy.alias("__later"), "__first", "__last")
    n = len(rest)
    names = [*rest, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, n):
                data, offsets = text_bytes(part.column(n))
                sizes, gone, spans, kept = np.diff(offsets), [], [], []
                for i, (later, first, last) in enumerate(zip(*(part.column(n + k).to_pylist() for k in (1, 2, 3)))):
                    own = data[offsets[i] : offsets[i + 1]]
                    if later:
                        cut = [(0, len(own))] if len(own) >= LENGTH else []
                    else:
                        cut = list(zip(np.frombuffer(first, np.int64).tolist(), np.frombuffer(last, np.int64).tolist())) if first else []
                    gone.append(sum(b - a for a, b in cut))
                    spans.append([{"first": a, "stop": b} for a, b in cut])
                    edges = [0, *(x for pair in cut for x in pair), len(own)]
                    kept.append(b"".join(own[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
                span = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(sizes), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=names)

    new = T.StructType.fromDDL("n_bytes long, n_removed long, spans array<struct<first: long, stop: long>>, kept binary")
    return rows.mapInArrow(run, T.StructType([*df.schema.fields, *new.fields]))
