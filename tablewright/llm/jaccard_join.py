"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A text is the set of its word n-grams. Sets are put in bands by size. For a
pair whose larger set lies in a band, a similarity of ``PERCENT`` bounds the
number of n-grams that only one of the two has, H. The universe of n-grams is
hashed into m segments; d of them also index every one-deletion of the
set's part (they tolerate one difference) and the others index the part itself,
with m + d = H + 1, so one segment of a similar pair must agree. More segments
than that, and parts that are empty may go without an index. How many segments
get deletions or are spare is decided per band by cost: rows written against
collisions expected from the number of sets in the band.

Sets that share a signature are a group, and candidates are its pairs. A sketch of a set, a bit
for each of some hundred finer segments that says whether its part is odd in number, bounds the difference of two
sets from below: bits that differ cannot outnumber the n-grams that do. Candidates whose sketches differ in more than H
bits go; the others are verified exactly, on the words of their texts.

Equal sets are one node from the start, named by 128 bits. Components need links, not all
pairs: each node is first checked against one reference, the node of its groups that shares most
signatures, as the original of a family of near copies does. In the groups that still have several
components, members are dealt into blocks by size, and each two blocks are compared by sketch in a task of their own, so that
only pairs that may join two components become rows. No link is lost; what is left quadratic is the
comparison of sketches within a group of sets that are near each other, but not linked.

Words are hashed by BLAKE2b, so that no text can be made to collide with another; a chance
agreement of two n-grams in 64 bits costs a candidate more, never a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.components import components
from tablewright.llm.shared import discard, keep, packed, released, unpacked
from tablewright.llm.words import digest_hashes, mix, slices, words
from tablewright.names import quote_ident

PERCENT = 90
NGRAM = 3
#: Ratio of a band's sizes.
WIDTH = 1.3
#: Signatures per bucket, on average.
BUCKET_ENTRIES = 500_000
#: Members of a block of a group, on average; two blocks are compared in one step.
BLOCK = 512
#: Pairs with one reference that one task verifies, on average.
CHUNK = 64
#: Rows of a table that is broadcast, else it is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of text read into sets at once; some twenty times as many bytes are held for them.
SLICE = 250_000
#: Bytes of text whose signatures go to their buckets together.
LOT = 2_000_000
#: Bits of a sketch, at least; beyond, half as many as n-grams and more, a power of two.
SKETCH = 256
#: Sketches of unrelated sets differ in half their bits; so many standard deviations must lie between that and a link's.
APART = 4
#: A candidate pair is looked at by a sketch of so many times the bits before texts move.
SHARPER = 4

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def split_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased; bytes.split cuts at space and tab to carriage return."""
    return (text or "").encode().translate(_LOWER).split()


def ngram_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; fewer words make one gram, none make none."""
    found = words(column, hasher=digest_hashes)
    h, out = found.hashes, []
    grams = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n if len(grams) else 0):
        grams = mix(grams * np.uint64(3) + h[k : len(h) - n + 1 + k])
    for a, b in zip(found.bounds.tolist(), found.bounds[1:].tolist()):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            value = np.array([b - a], np.uint64)
            for x in h[a:b]:
                value = mix(value * np.uint64(5) + x)
            out.append(value)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def names(grams: np.ndarray) -> tuple[int, int]:
    """The 128-bit name of a set, as two longs."""
    return tuple(np.frombuffer(blake2b(grams.tobytes(), digest_size=16).digest(), np.int64).tolist())


def sketch_bits(size: int, percent: int) -> int:
    """Bits of the sketch of a set: enough to tell it from unrelated sets, up to the largest it can be linked with."""
    m, most = SKETCH, size * (100 - percent) / percent
    while 2 * m < size or (m - APART * m**0.5) / 2 < most:
        m *= 2
    return m


def sketch(grams: np.ndarray, times: int = 1, percent: int = PERCENT) -> bytes:
    """A bit for each segment of the set: whether its n-grams are odd in number."""
    m = sketch_bits(len(grams), percent) * times
    counts = np.bincount((mix(grams) & np.uint64(m - 1)).astype(np.int64), minlength=m)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(rows: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of ``size`` bytes; the bits of segments that become one are added modulo 2."""
    out = np.empty((len(rows), size), np.uint8)
    for i, x in enumerate(rows):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0)
    return out


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits of folded sketches differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def may_link(a: int, b: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b can be linked whose sketches differ in so many bits: with a
    difference of D, 200 x shared = 100 (a + b - D), and the union holds half of a + b + D."""
    return (100 + percent) * bits <= (100 - percent) * (a + b)


@lru_cache(maxsize=4)
def bands(percent: int, most: int = 1 << 31) -> np.ndarray:
    """The smallest sizes of the bands. Similar sets lie in one band or two neighbouring ones."""
    lows = [1]
    while lows[-1] < most:
        lows.append(max(lows[-1] + 1, -(-lows[-1] * 100 // percent), int(lows[-1] * WIDTH)))
    return np.array(lows)


def differences(band: int, percent: int) -> int:
    """The most n-grams that only one of two similar sets has, the larger in the band."""
    largest = int(bands(percent)[band + 1]) - 1
    return 2 * largest * (100 - percent) // (100 + percent)


def _more_than(spare: int, mean: float) -> float:
    """The chance that a Poisson count exceeds ``spare``."""
    term, total = exp(-mean), 0.0
    for k in range(spare + 1):
        total += term
        term *= mean / (k + 1)
    return max(0.0, 1.0 - total)


def allocate(band: int, sets: int, percent: int) -> tuple[int, int, int]:
    """(m, d, s) of least cost: rows written plus collisions of parts that are empty by chance.

    m segments, of which the first d also index one-deletions; or, with d = 0, s
    spare segments: then s + 1 segments of a similar pair agree, and a set
    with at most s empty parts need not index these."""
    need, size = differences(band, percent) + 1, float(bands(percent)[band]) * (1 + WIDTH) / 2
    best = None
    for d, s in [*((0, s) for s in (0, 1, 2, 4, 8, 16, 32)), (need // 4, 0), (need // 2, 0)]:
        m = need - d + s
        if s > need or m < max(d, 1):
            continue
        load = size / m
        empty = exp(-load) * _more_than(s - 1, m * exp(-load)) if s else exp(-load)
        cost = sets * (m + d * load) + 0.5 * m * (sets * empty) ** 2
        if best is None or cost < best[0]:
            best = cost, m, d, s
    return best[1:]


def signatures(grams: np.ndarray, band: int, m: int, d: int, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the parts, and of the one-deletions of the first d parts."""
    salt = np.uint64(band * 0x51ED27 + 1)
    values = mix(grams + salt)
    segment = (mix(values + salt) % np.uint64(m)).astype(np.int64)
    sums = np.zeros(m, np.uint64)
    np.add.at(sums, segment, values)
    names = mix(np.arange(m, dtype=np.uint64) * np.uint64(0x2545F491) + (salt << np.uint64(32)))
    whole = mix(sums + names)
    if d:
        few = segment < d
        return whole, mix(sums[segment[few]] - values[few] + names[segment[few]])
    filled = np.bincount(segment, minlength=m) > 0
    if m - filled.sum() <= spare:
        whole = whole[filled]
    return whole, np.zeros(0, np.uint64)


def linked_words(x: list[bytes], y: list[bytes], n: int, percent: int) -> bool:
    """Whether two texts' sets, of n words each or the whole of fewer, are linked."""
    a, b = ngrams(x, n), ngrams(y, n)
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def ngrams(words: list[bytes], n: int) -> set:
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else {tuple(words)}


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, mark, size, d1, d2`` of each row of ``doc_id, text, mark``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                sets = ngram_sets(part.column(1), n)
                named = np.array([names(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(named[:, 0]), pa.array(named[:, 1])], names=["doc_id", "mark", "size", "d1", "d2"])

    return docs.mapInArrow(released(run), T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("mark", "size", "d1", "d2"))]))


def _candidates(docs: DataFrame, n: int, percent: int, plan: dict[int, tuple[int, int, int]], n_buckets: int) -> DataFrame:
    """``group, d1`` of the signatures that several sets share, by the first half of their names; equal groups once."""
    lows = bands(percent)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in slices(batch, 0, LOT):
                sigs, nodes, kinds, seen = [], [], [], set()
                for grams in (x for part in slices(lot, 0, SLICE) for x in ngram_sets(part.column(0), n)):
                    if not len(grams) or (name := names(grams)[0]) in seen:
                        continue
                    seen.add(name)
                    own = int(np.searchsorted(lows, len(grams), side="right")) - 1
                    for band in (own, own + 1):
                        if band not in plan or band > own and 100 * len(grams) < percent * lows[band]:
                            continue
                        whole, fewer = signatures(grams, band, *plan[band])
                        for found, kind in ((whole, 0), (fewer, 1)):
                            sigs.append(found)
                            nodes.append(np.full(len(found), name, np.int64))
                            kinds.append(np.full(len(found), kind, np.uint8))
                if not sigs:
                    continue
                sig, who, kind = map(np.concatenate, (sigs, nodes, kinds))
                del sigs, nodes, kinds
                # the bucket and 32 bits: a chance agreement only joins two groups
                rows = packed(((sig >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64), n_buckets, sig.astype(np.uint32), who, kind)
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), *(pa.array([r[i] for _, r in rows], pa.binary()) for i in range(3))], names=["bucket", "sig", "who", "kind"])

    def read(table: pa.Table) -> pa.Table:
        sig, who, kind = (unpacked(table[c], t) for c, t in (("sig", np.uint32), ("who", np.int64), ("kind", np.uint8)))
        order = np.argsort(sig, kind="stable")
        sig, who, kind = sig[order], who[order], kind[order]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        # a pair needs the whole part on one side at least
        useful = (size > 1) & (np.minimum.reduceat(kind, first) == 0)
        member = np.repeat(useful, size)
        group = np.repeat(np.arange(len(first)), size)[member]
        who = who[member]
        order = np.lexsort((who, group))
        group, who = group[order], who[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (who[1:] != who[:-1])]) if len(who) else np.zeros(0, bool)
        group, who = group[new], who[new]
        if not len(who):
            return pa.table({"group": pa.array([], pa.int64()), "d1": pa.array([], pa.int64())})
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(start, len(who)))
        # equal groups get equal names
        named = mix(np.add.reduceat(mix(who.view(np.uint64)), start) + size.astype(np.uint64))
        _, kept = np.unique(named, return_index=True)
        keeps = np.zeros(len(start), bool)
        keeps[kept] = True
        keeps &= size > 1
        take = np.repeat(keeps, size)
        return pa.table({"group": pa.array(np.repeat(named, size)[take].view(np.int64)), "d1": pa.array(who[take])})

    found = docs.select("text").mapInArrow(released(write), "bucket int, sig binary, who binary, kind binary").groupBy("bucket").applyInArrow(read, "group long, d1 long")
    return found.distinct()


def _texts(docs: DataFrame, n: int, percent: int, wanted: DataFrame) -> DataFrame:
    """``node, size, sketch, sharp, text`` of the wanted ``node, d1, d2, mark``, once each; only texts
    with the mark of one that is wanted are read into sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                sets = ngram_sets(part.column(0), n)
                named = np.array([names(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(named[:, 0]), pa.array(named[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s, 1, percent) for s in sets], pa.binary()), pa.array([sketch(s, SHARPER, percent) for s in sets], pa.binary()), part.column(0)], names=["d1", "d2", "size", "sketch", "sharp", "text"])

    marked = docs.select("text", "mark").join(_few(wanted.select("mark").distinct()), "mark", "left_semi").select("text")
    own = marked.mapInArrow(released(run), "d1 long, d2 long, size long, sketch binary, sharp binary, text string")
    own = own.join(_few(wanted), ["d1", "d2"]).select("node", "size", "sketch", "sharp", "text")
    return own.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("sharp").alias("sharp"), F.min("text").alias("text"))


def _sketched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sharper sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y, p, q in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                m = min(len(p), len(q))
                one, two = folded([p, q], m)
                ok.append(bool(may_link(x, y, int(differing(one, two)), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("sharp").alias(f"{c}_sketch")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch")
    return joined.mapInArrow(released(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are linked, checked on the words. The text of a is sent once for
    ``CHUNK`` pairs with it."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK).select("a", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(_few(many), "a", "left").withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("b"), F.col("chunks"))).otherwise(0).cast("int")).select("a", "b", "chunk")
    dealt = keep(dealt, "jaccard")
    text = sets.select(F.col("node").alias("b"), "text")
    right = dealt.join(text, "b").select("a", "chunk", "b", "text")
    own = sets.select(F.col("node").alias("key"), F.col("text").alias("body"))
    left = dealt.select(F.col("a").alias("key"), F.col("chunk").alias("part")).distinct().join(own, "key").select("key", "part", "body")

    def run(key: tuple, one: pa.Table, others: pa.Table) -> pa.Table:
        found: list[int] = []
        if one.num_rows and others.num_rows:
            x = split_words(one["body"][0].as_py())
            found = [b for b, t in zip(others["b"].to_pylist(), others["text"]) if linked_words(x, split_words(t.as_py()), n, percent)]
        return pa.table({"a": pa.array([key[0].as_py()] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return left.groupBy("key", "part").cogroup(right.groupBy("a", "chunk")).applyInArrow(run, "a long, b long")


def _size_class(size: Column, percent: int) -> Column:
    """Sizes of linked sets are in one class or neighbouring ones."""
    if percent == 100:
        return size.cast("int")
    return F.floor(F.log(size.cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")


def _compared(met: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` across two lists of members, ``own`` and ``others``, with different
    labels whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for own, others in zip(batch.column(0), batch.column(1)):
                own, others = own.as_py(), others.as_py()
                m = min(len(x["sketch"]) for x in (*own, *others))
                table = folded([x["sketch"] for x in others], m)
                node, label, size = (np.array([x[c] for x in others], np.int64) for c in ("node", "label", "size"))
                for x, row in zip(own, folded([x["sketch"] for x in own], m)):
                    maybe = np.flatnonzero(label != x["label"])
                    ok = maybe[may_link(x["size"], size[maybe], differing(table[maybe], row), percent)]
                    a += [x["node"]] * len(ok)
                    b += node[ok].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return met.mapInArrow(released(run), "a long, b long").distinct()


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of ``group, node, label`` with different labels in a group whose sketches allow a link."""
    large = keep(members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("group"), "jaccard")
    sized = members.join(sets.select("node", "size", "sketch"), "node")
    column = F.struct("node", "label", "size", "sketch")
    small = sized.join(_few(large), "group", "left_anti").groupBy("group").agg(F.collect_list(column).alias("own"))
    pairs = _compared(small.select("own", F.col("own").alias("others")), percent)
    if not large.head(1):
        return pairs
    # large groups by classes of size and blocks of a class
    sized = sized.join(_few(large), "group", "left_semi").withColumn("class", _size_class(F.col("size"), percent))
    counts = sized.groupBy("group", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = sized.join(_few(keep(counts, "jaccard")), ["group", "class"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = keep(dealt.groupBy("group", "class", "block").agg(F.collect_list(column).alias("members")), "jaccard")
    left = blocks.select("group", F.col("class").alias("c"), F.col("block").alias("x"), F.col("members").alias("own"))
    right = blocks.select("group", F.col("class").alias("d"), F.col("block").alias("y"), F.col("members").alias("others"))
    # blocks of one class once, those of neighbouring classes always
    met = left.withColumn("d", F.explode(F.array(F.col("c"), F.col("c") + 1))).join(right, ["group", "d"]).filter("d > c or y >= x")
    return pairs.unionByName(_compared(met.select("own", "others"), percent)).distinct()


def link_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    A text without words (or null) has the empty set and is linked with
    nothing. Equal sets are linked. ``component_id`` is the smallest
    ``doc_id`` reachable, the row's own included; rows without an id have
    part in a component but give it no number. Repeated rows stay repeated.
    """
    body = F.col(quote_ident(text))
    docs = docs.select(F.col(quote_ident(doc_id)).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("mark"))
    rows = keep(_sets(docs, n), "jaccard")
    own = rows.filter("size > 0").groupBy("d1", "d2").agg(F.first("size").alias("size"), F.min("doc_id").alias("first"), F.min("mark").alias("mark"))
    nodes = keep(own.withColumn("node", F.monotonically_increasing_id()), "jaccard")
    lows = [int(x) for x in bands(percent)]
    band = F.lit(0)
    for i, low in enumerate(lows[1:], 1):
        band = F.when(F.col("size") >= low, i).otherwise(band)
    counts = {r.band: r.n for r in nodes.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per band
    plan = {b: allocate(b, counts.get(b, 0) + counts.get(b - 1, 0), percent) for b in range(len(lows) - 1) if counts.get(b)}
    entries = sum((m + d * lows[b] / m) * (counts[b] + counts.get(b - 1, 0)) for b, (m, d, _) in plan.items())
    found = keep(_candidates(docs, n, percent, plan, max(48, int(entries / BUCKET_ENTRIES))), "jaccard")
    wanted = keep(nodes.select("node", "d1", "d2", "mark").join(_few(found.select("d1").distinct()), "d1"), "jaccard")
    groups = keep(found.join(_few(wanted.select("d1", "node")), "d1").select("group", "node"), "jaccard")
    discard(found)
    sets = keep(_texts(docs, n, percent, wanted), "jaccard")

    # each node against the one of its groups that shares most: the original of a family has
    # most parts that are equal to others'
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    weight = groups.join(sizes, "group").groupBy("node").agg(F.sum("n").alias("weight"))
    weighted = keep(groups.join(weight, "node").select("group", "node", "weight"), "jaccard")
    best = F.struct("weight", "node")
    centre = weighted.groupBy("group").agg(F.max(best).alias("best"))
    refs = weighted.join(centre, "group").groupBy("node").agg(F.max("best").alias("best")).select("node", F.col("best.node").alias("ref"))
    stars = keep(_sketched(refs.filter("ref <> node").select(F.col("ref").alias("a"), F.col("node").alias("b")), sets, percent), "jaccard")
    links = keep(_verified(stars, sets, n, percent), "jaccard")
    label = components(links)

    named = groups.join(label, "node", "left").select("group", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("group").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("group")
    pairs = keep(_across(keep(named.join(_few(mixed), "group"), "jaccard"), sets, percent), "jaccard")
    turned = stars.select(F.col("b").alias("a"), F.col("a").alias("b"))
    fresh = keep(_sketched(pairs.join(stars, ["a", "b"], "left_anti").join(turned, ["a", "b"], "left_anti"), sets, percent), "jaccard")
    more = keep(_verified(fresh, sets, n, percent), "jaccard")
    if more.head(1):
        label = components(links.unionByName(more))
    discard(sets, weighted)

    of_node = nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = of_node.groupBy("label").agg(F.min("first").alias("component_id"))
    numbers = of_node.join(smallest, "label").select("d1", "d2", "component_id")
    numbered = rows.filter("size > 0").join(numbers, ["d1", "d2"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return numbered.unionByName(rows.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))
