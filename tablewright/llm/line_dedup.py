"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

Texts are sequences of lines. Only lines that occur twice can lie in a repeated run,
so what is sorted are the stretches of neighbouring repeated lines that reach the least
size; of equal texts the first stands for all. Each place in a stretch is a suffix. Suffixes are ranked by
their first line, then step by step by their first 2, 4, 8 ... lines: the pair of the ranks, one step
before, of the suffix itself and of the one half as far on. Ranks keep the order
(distinct pairs are sorted, then numbered), so suffixes of one rank are an interval of the suffix
array with that longest common prefix or more; suffixes alone in theirs leave.

A maximal repeated run of the least size is deleted at every place but the first. Seen from
each of its lines, forward and backward, such a run is made of parts that just reach the size: a
part of l lines is the interval of the suffix array whose common prefix is l lines, named by the two overlapping
ranks of the last step below l. In each interval the first place stays and the others are deleted: every
part repeats where its run does, and every repeated part lies in a maximal run.

The size of a run counts a word for each word, or for each ``CHARS`` code points of a line if
that is more, so that scripts without spaces count as well. ``MIN_WORDS`` is above two set phrases in a
row (25 words in the test tables), which documents share without being copied.

Lines and texts are identified by 128-bit BLAKE2b digests. Order is that of the
document numbers, rows without one first. Defined results: a null or empty text has no
lines and stays as it is; blank lines count as lines without words; repeated rows are copies,
of which the first stays. Repeats are judged on the input, not on what is left. Columns with the names
of the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.shared import discard, keep, released
from tablewright.llm.words import slices
from tablewright.names import quote_ident

#: Runs of a smaller size stay: short lines repeat by chance and in set phrases.
MIN_WORDS = 30
#: So many code points of a line count as a word.
CHARS = 12
#: Ranks of lines and removed parts up to this count are broadcast, else joined by shuffle.
BROADCAST_ROWS = 200_000


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def _size(line: str, data: bytes) -> int:
    return max(len(data.split()), len(line) // CHARS)  # bytes.split cuts at space and tab to carriage return


def _texts(rows: DataFrame) -> DataFrame:
    """``doc, row, d1, d2, lines, sizes, n_lines, size``: a text's digest as two longs, its
    lines' digests and sizes as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                own, lines, sizes = [], [], []
                for text in part.column(2).to_pylist():
                    split = text.split("\n") if text else []
                    data = [x.encode() for x in split]
                    own.append(_digest((text or "").encode()))
                    lines.append(b"".join(map(_digest, data)))
                    sizes.append(np.array(list(map(_size, split, data)), np.int32))
                digest = np.frombuffer(b"".join(own), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(2)),
                        *(pa.array(digest[:, i]) for i in range(2)),
                        pa.array(lines, pa.binary()),
                        pa.array([x.tobytes() for x in sizes], pa.binary()),
                        *(pa.array([f(x) for x in sizes], pa.int64()) for f in (len, np.sum)),
                    ],
                    names=["doc", "row", "d1", "d2", "lines", "sizes", "n_lines", "size"],
                )

    kinds = [T.StructField(c, T.BinaryType() if c in ("lines", "sizes") else T.LongType()) for c in ("d1", "d2", "lines", "sizes", "n_lines", "size")]
    return rows.mapInArrow(released(run), T.StructType([*rows.schema.fields[:2], *kinds]))


def _lines(texts: DataFrame) -> DataFrame:
    """``doc, row, n, size, h1, h2`` of every line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, sizes = (batch.column(i).to_pylist() for i in (2, 3))
            counts = np.array([len(x) // 4 for x in sizes], np.int64)
            take = pa.array(np.repeat(np.arange(len(counts)), counts))
            digest = np.frombuffer(b"".join(lines), np.int64).reshape(-1, 2)
            n = np.arange(len(digest)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(n.astype(np.int32)), pa.array(np.frombuffer(b"".join(sizes), np.int32)), *(pa.array(digest[:, i]) for i in range(2))],
                names=["doc", "row", "n", "size", "h1", "h2"],
            )

    kinds = [T.StructField(c, T.IntegerType() if c in ("n", "size") else T.LongType()) for c in ("n", "size", "h1", "h2")]
    return texts.select("doc", "row", "lines", "sizes").mapInArrow(run, T.StructType([*texts.select("doc", "row").schema.fields, *kinds]))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _ranked(df: DataFrame, *key: str) -> DataFrame:
    """``df`` with the ``rank`` of its key among the keys that occur twice; rows alone with theirs leave."""
    shared = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(*key)
    # numbers of a sorted table's rows keep its order
    ranks = keep(shared.orderBy(*key).withColumn("rank", F.monotonically_increasing_id()), "lines")
    return df.join(_few(ranks), list(key))


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """``doc, row, n, rank, forward, backward`` of the lines in stretches of repeated lines that
    reach the size: the lines of the smallest part with that size from the line on, and up to it (0: none)."""
    per_text = lines.groupBy("doc", "row").agg(F.collect_list(F.struct("n", "size", "rank")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            listed = batch.column(2)
            text = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
            n, size, rank = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in listed.flatten().flatten())
            order = np.lexsort((n, text))
            text, n, size, rank = text[order], n[order], size[order], rank[order]
            new = np.ones(len(n), bool)
            new[1:] = (text[1:] != text[:-1]) | (n[1:] != n[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(n))
            sums = np.concatenate([[0], np.cumsum(size)])
            stretch = np.cumsum(new) - 1
            at = np.arange(len(n))
            # the first end, and the last start, with the size between
            end = np.searchsorted(sums, sums[:-1] + min_words)
            forward = np.where(end <= last[stretch], end - at, 0)
            start = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1
            backward = np.where((sums[1:] >= min_words) & (start >= first[stretch]), at + 1 - start, 0)
            ok = (sums[last] - sums[first] >= min_words)[stretch]
            take = pa.array(text[ok])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x[ok].astype(np.int32)) for x in (n, forward, backward)), pa.array(rank[ok])],
                names=["doc", "row", "n", "forward", "backward", "rank"],
            )

    kinds = [T.StructField(c, T.LongType() if c == "rank" else T.IntegerType()) for c in ("n", "forward", "backward", "rank")]
    return per_text.mapInArrow(run, T.StructType([*per_text.schema.fields[:2], *kinds]))


def repeated_parts(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row, n, length`` of every smallest part that occurs earlier; ``texts`` are different."""
    # half a digest tells most lines that occur once, so only the others move whole
    every = _lines(texts)
    half = keep(every.groupBy("h1").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("h1"), "lines")
    maybe = keep(every.join(_few(half), "h1"), "lines")
    lines = keep(_stretches(_ranked(maybe, "h1", "h2"), min_words), "lines")
    discard(half, maybe)
    forward = lines.filter("forward > 0").select("doc", "row", "n", F.col("forward").alias("length"))
    backward = lines.filter("backward > 0").select("doc", "row", (F.col("n") - F.col("backward") + 1).alias("n"), F.col("backward").alias("length"))
    parts = keep(forward.unionByName(backward).distinct(), "lines")
    longest = parts.agg(F.max("length")).first()[0] or 0
    ranks, size, found = keep(lines.select("row", "n", "rank"), "lines"), 1, []
    discard(lines)
    while size <= longest:
        mine = parts.filter(F.col("length").between(size, 2 * size - 1))
        heads = ranks.withColumnRenamed("rank", "head")
        tails = ranks.select("row", F.col("n").alias("tail_n"), F.col("rank").alias("tail"))
        # a part whose head or tail is alone with its rank is alone itself
        mine = mine.join(heads, ["row", "n"]).withColumn("tail_n", F.col("n") + F.col("length") - size).join(tails, ["row", "tail_n"])
        place = F.struct("doc", "row", "n")
        firsts = keep(mine.groupBy("length", "head", "tail").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"), "lines")
        again = mine.join(_few(firsts), ["length", "head", "tail"]).filter(place != F.col("first"))
        found.append(keep(again.select("row", "n", "length"), "lines"))
        discard(firsts)
        if 2 * size <= longest:
            ahead = ranks.select("row", (F.col("n") - size).alias("n"), F.col("rank").alias("next"))
            pairs = ranks.withColumnRenamed("rank", "own").join(ahead, ["row", "n"])
            doubled = keep(_ranked(pairs, "own", "next").select("row", "n", "rank"), "lines")
            discard(ranks)
            ranks = doubled
        size *= 2
    discard(parts, ranks)
    if not found:
        return texts.sparkSession.createDataFrame([], "row long, n int, length int")
    return reduce(DataFrame.unionByName, found)


def _first_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first row of each text, and ``row, n_lines, size`` of the later ones."""
    own = F.struct("doc", "row")
    firsts = texts.groupBy("d1", "d2").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("lines").alias("lines"), F.first("sizes").alias("sizes"))
    firsts = keep(firsts, "lines")
    several = firsts.filter("copies > 1").select("d1", "d2", F.col("first.row").alias("first"))
    later = texts.select("row", "d1", "d2", "n_lines", "size").join(_few(several), ["d1", "d2"]).filter("row <> first")
    return firsts.select("first.doc", "first.row", "lines", "sizes"), later.select("row", "n_lines", "size")


def deduplicate_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the later copies of repeated line runs deleted from ``text``, and
    ``n_lines`` (before) and ``n_removed``."""
    df = df.drop("n_lines", "n_removed")
    # inside, columns have neutral names, so that none can clash
    names = df.columns
    numbered = keep(df.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()), "lines")
    at = names.index(text)
    texts = keep(_texts(numbered.select(F.col(f"c{names.index(doc_id)}").alias("doc"), "row", F.col(f"c{at}").alias("text"))), "lines")
    firsts, later = _first_texts(texts)
    # a later copy is one repeated run, if it reaches the size; if not, no run can hold it
    whole = later.filter(F.col("size") >= min_words).select("row", F.lit(0).alias("n"), F.col("n_lines").cast("int").alias("length"))
    runs = repeated_parts(firsts, min_words).unionByName(whole).groupBy("row").agg(F.collect_set(F.struct("n", "length")).alias("runs"))
    runs = keep(runs.select("row", _merged(F.sort_array("runs")).alias("runs")), "lines")
    discard(texts)
    entries = runs.agg(F.sum(F.size("runs"))).first()[0] or 0
    joined = numbered.join(F.broadcast(runs) if entries <= BROADCAST_ROWS else runs, "row", "left").select(*[f"c{i}" for i in range(len(names))], F.col("runs.n").alias("n"), F.col("runs.length").alias("length"))
    last = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts, counts, removed = [], [], []
                for body, starts, lengths in zip(part.column(at).to_pylist(), part.column(last).to_pylist(), part.column(last + 1).to_pylist()):
                    lines = body.split("\n") if body else []
                    kept, end = [], 0
                    for start, length in zip(starts or [], lengths or []):
                        kept += lines[end:start]
                        end = start + length
                    texts.append("\n".join(kept + lines[end:]) if starts else body)
                    removed.append(sum(lengths or []))
                    counts.append(len(lines))
                columns = [pa.array(texts, part.column(at).type) if i == at else c for i, c in enumerate(part.columns[:last])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    return joined.mapInArrow(released(run), T.StructType([*df.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))


def _merged(runs: Column) -> Column:
    """Sorted runs, those that meet as one."""

    def add(done: Column, run: Column) -> Column:
        before = F.get(done, F.size(done) - 1)
        end = F.greatest(before["n"] + before["length"], run["n"] + run["length"])
        longer = F.struct(before["n"].alias("n"), (end - before["n"]).alias("length"))
        meets = F.coalesce(run["n"] <= before["n"] + before["length"], F.lit(False))
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, F.array().cast("array<struct<n:int,length:int>>"), add)
