"""Fill-in-middle: two cuts a text at unit boundaries, found in a roaring boundary set.

A unit is a run of ASCII letters or one other code point. The code point offsets at
which units start, and the text's end, are a set of integers: blocks of 65,536
offsets are containers, each an array, a bitmap or a list of runs, whichever is
smallest, with the running count of their members. The offset after k
units is the set's member number k: a binary search over the running counts finds
the container, and a select inside it the offset. So a text's boundaries take
at most a fifth of a byte a code point, and its code points are read block by block.

Both unit counts are drawn from SHA-256 of the seed and the row's id, so a row
gets the same cuts on any partitioning and in any run. The set gives the cut
offsets in one pass over Arrow batches; the forms are put together by column functions.

Defined results: a null text is empty, an empty text has no units and the form
``plain``, as has one that contains a marker; a null id draws as an empty string;
repeated rows get equal results. Columns with the names of the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.words import slices
from tablewright.names import quote_ident

#: Code points of a container.
BLOCK = 1 << 16
#: Shares in percent: texts that stay plain, and suffix-first texts among the others.
PLAIN, SUFFIX_FIRST = 10, 20
# The markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


class Array:
    """Sorted 16-bit members."""

    def __init__(self, members: np.ndarray):
        self.members = members.astype(np.uint16)

    @staticmethod
    def bytes(members: np.ndarray) -> int:
        return 2 * len(members)

    def select(self, k: int) -> int:
        return int(self.members[k])


class Bitmap:
    """A bit a number, in 64-bit words, and the running counts of set bits."""

    def __init__(self, members: np.ndarray):
        bits = np.zeros(BLOCK, bool)
        bits[members] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.counts = np.cumsum(np.bitwise_count(self.words), dtype=np.int32)

    @staticmethod
    def bytes(members: np.ndarray) -> int:
        return BLOCK // 8 + BLOCK // 16

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.counts, k, side="right"))
        left, value = k - (int(self.counts[word - 1]) if word else 0), int(self.words[word])
        for _ in range(left):
            value &= value - 1  # drops the lowest set bit
        return 64 * word + (value & -value).bit_length() - 1


class Runs:
    """First members of the runs of consecutive numbers, and the running counts of members."""

    def __init__(self, members: np.ndarray):
        first = np.concatenate([[0], np.flatnonzero(np.diff(members) != 1) + 1])
        self.starts = members[first].astype(np.uint16)
        self.counts = np.append(first[1:], len(members)).astype(np.int32)

    @staticmethod
    def bytes(members: np.ndarray) -> int:
        return 6 * (1 + int((np.diff(members) != 1).sum()))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.counts, k, side="right"))
        return int(self.starts[run]) + k - (int(self.counts[run - 1]) if run else 0)


KINDS = (Array, Runs, Bitmap)


class BoundarySet:
    """Sorted numbers, added block by block, with select."""

    def __init__(self):
        self.keys: list[int] = []
        self.containers: list = []
        self.counts: list[int] = []

    def add_block(self, key: int, members: np.ndarray) -> None:
        """The sorted, distinct members of block ``key``, as offsets in it; blocks come in order."""
        if len(members):
            self.keys.append(key)
            self.containers.append(min(KINDS, key=lambda kind: kind.bytes(members))(members))
            self.counts.append(len(self) + len(members))

    def __len__(self) -> int:
        return self.counts[-1] if self.counts else 0

    def select(self, k: int) -> int:
        """Member number ``k``, from 0."""
        at = int(np.searchsorted(self.counts, k, side="right"))
        return self.keys[at] * BLOCK + self.containers[at].select(k - (self.counts[at - 1] if at else 0))


def boundaries(text: str) -> BoundarySet:
    """The offsets at which units start, and the end of the text."""
    found, letter_before = BoundarySet(), False
    for key in range(len(text) // BLOCK + 1):
        codes = np.frombuffer(text[key * BLOCK : (key + 1) * BLOCK].encode("utf-32-le"), np.uint32)
        folded = codes | 32  # lower case of an ASCII letter
        inside = np.zeros(len(codes) + 1, bool)  # a letter right after a letter: no boundary
        letter = (folded >= 97) & (folded <= 122)
        inside[1:-1] = letter[1:] & letter[:-1]
        if len(codes):
            inside[0] = letter_before and letter[0]
            letter_before = bool(letter[-1])
        # the number after the block is the next block's, or the end of the text
        found.add_block(key, np.flatnonzero(~inside[:BLOCK]))
    return found


def draws(row_id: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers, from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``df`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars``
    (null if plain) and ``output``."""
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    df = df.drop(*added)
    # inside, columns have neutral names, so that none can clash
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    body = F.coalesce(F.col(f"c{df.columns.index(text)}"), F.lit(""))
    first, second, is_plain, order = draws(F.col(f"c{df.columns.index(doc_id)}"), seed)
    inner = inner.select("*", body.alias("body"), first.alias("h1"), second.alias("h2"))
    at = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                units, low, high = [], [], []
                for body, a, b in zip(part.column(at), part.column(at + 1).to_pylist(), part.column(at + 2).to_pylist()):
                    found = boundaries(body.as_py())
                    a, b = sorted((a % len(found), b % len(found)))
                    units.append(len(found) - 1)
                    low.append(found.select(a))
                    high.append(found.select(b))
                yield pa.RecordBatch.from_arrays([*part.columns[: at + 1], *(pa.array(x, pa.int64()) for x in (units, low, high))], names=[*part.schema.names[: at + 1], "units", "low", "high"])

    kinds = T.StructType([*inner.schema.fields[: at + 1], *(T.StructField(c, T.LongType()) for c in ("units", "low", "high"))])
    cut = inner.mapInArrow(run, kinds)
    body, low, high = F.col("body"), F.col("low"), F.col("high")
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains(body, F.lit(m))
    form = F.when((body == "") | marked | (is_plain % 100 >= 100 - plain), "plain").when(order % 100 < suffix_first, "spm").otherwise("psm")
    cut = cut.withColumn("form", form)
    prefix, middle, suffix = F.substr(body, F.lit(1), low.cast("int")), F.substr(body, (low + 1).cast("int"), (high - low).cast("int")), F.substr(body, (high + 1).cast("int"))
    p, s, m = (F.lit(x) for x in MARKERS)
    output = F.when(F.col("form") == "plain", body).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    formed = F.col("form") != "plain"
    return cut.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)],
        F.col("units").alias("n"),
        "form",
        F.when(formed, low).alias("prefix_chars"),
        F.when(formed, high - low).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. It held no marker, so each marker's first place is the one put there."""
    first, second, middle = MARKERS[0], MARKERS[1], MARKERS[2]

    def parts(a: str, b: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(a) + 1))
        one = F.substring_index(rest, b, 1)
        rest = F.substr(rest, F.length(one) + len(b) + 1)
        two = F.substring_index(rest, middle, 1)
        return one, two, F.substr(rest, F.length(two) + len(middle) + 1)

    prefix, suffix, mid = parts(first, second)
    psm = F.concat(prefix, mid, suffix)
    suffix, prefix, mid = parts(second, first)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, mid, suffix))
