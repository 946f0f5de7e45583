"""Periodic runs in word sequences, found on a grammar of each text.

Re-Pair turns the words of a text into a grammar: the most frequent pair of neighbours
becomes a new symbol, again and again, until no pair occurs twice (the older pair first among
equally frequent ones, so that equal stretches are halved evenly). The symbols that are left are
joined by a balanced tree. A run that lies in a symbol's text, but in neither
half, crosses the boundary between the halves. So each symbol is searched once, for runs
over its boundary, at one of its places: a run of four periods and more has two of them on
one side, which leaves few periods to try, and a common extension to both sides by
prefix hashes gives its ends within the symbol's text. What is found is carried
to all places the symbol derives, and stretches cut off by a symbol's end are merged into
the whole run, which the symbol around it yields.

Extensions are found by hashes, but results do not rest on them: equal words never have unequal
hashes, so a stretch can only come out too long, and every run is compared word by
word at the end; at a mismatch the slice is searched again with other hashes.

A row needs no other row, so nothing is shuffled. A task holds a slice of texts (4 MB, or one
longer text) and some 200 bytes for each of its words.

Defined results: a null or empty text has no words and no runs; repeated rows get equal
results. Columns with the names of the new ones are replaced.
"""

from __future__ import annotations

import random
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.llm.words import slices

#: A run has this many periods at least, and this many words.
PERIODS, WORDS = 4, 6
#: (symbol, period) pairs tried at once; bounds the temporary arrays.
TRIED = 1 << 20
#: Primes of the prefix hashes, below 2^31, so that products fit 64 bits.
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)

RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


class Grammar:
    """Re-Pair of one text. Symbols below ``n_words`` are words; the others, in order, are
    rules with ``left``, ``right`` and the ``place`` (a word number) of one occurrence."""

    def __init__(self, ids: list[int], n_words: int, repeated: list[tuple[int, int, np.ndarray]]):
        """``repeated``: the pairs of neighbours that occur twice, with their places."""
        n = len(ids)
        self.n_words, self.left, self.right, self.place = n_words, [], [], []
        self.length = [1] * n_words
        symbol, before = array("l", ids), array("l", range(-1, n))  # before[e]: where the symbol that ends at e starts
        self.symbol, self.inner = symbol, []
        queue = [(-len(at), k, a, b, at) for k, (a, b, at) in enumerate(repeated)]
        heapify(queue)
        order, length = len(queue), self.length
        while queue:
            count, k, a, b, at = heappop(queue)
            la, second, places = length[a], -1, []
            for i in at if isinstance(at, list) else at.tolist():
                # a place is gone if one of its symbols is, or if it overlaps the one before (aaa)
                if symbol[i] == a and i != second and i + la < n and symbol[i + la] == b:
                    second = i + la
                    places.append(i)
            if len(places) < 2:
                continue
            if len(places) < -count:
                heappush(queue, (-len(places), k, a, b, places))
                continue
            new, size = len(length), la + length[b]
            self.left.append(a)
            self.right.append(b)
            self.place.append(places[0])
            length.append(size)
            for i in places:
                symbol[i] = new
                symbol[i + la] = -1
                before[i + size] = i
            self.inner.extend(i + la for i in places)
            fresh: dict[tuple[int, int], list[int]] = {}
            for i in places:
                if i:
                    j = before[i]
                    fresh.setdefault((symbol[j], new), []).append(j)
                if i + size < n and symbol[i + size] != new:
                    fresh.setdefault((new, symbol[i + size]), []).append(i)
            for (x, y), at in fresh.items():
                if len(at) > 1:
                    heappush(queue, (-len(at), order, x, y, at))
                    order += 1

    def occurrences(self) -> list[list[int]]:
        """The places of each rule in the derivation of the whole text."""
        found: list[list[int]] = [[] for _ in self.left]
        for i, s in enumerate(self.symbol):
            if s >= self.n_words:
                found[s - self.n_words].append(i)
        for r in range(len(found) - 1, -1, -1):
            a, b = self.left[r], self.right[r]
            if a >= self.n_words:
                found[a - self.n_words].extend(found[r])
            if b >= self.n_words:
                shift = self.length[a]
                found[b - self.n_words].extend(i + shift for i in found[r])
        return found


class Hashes:
    """Prefix hashes of a word sequence, for comparing stretches."""

    def __init__(self, words: np.ndarray, seed: int, primes: tuple[int, ...]):
        rng = random.Random(seed)
        self.tables = []
        for p in primes:
            base = rng.randrange(p // 2, p - 1)
            powers = np.ones(len(words) + 1, np.uint64)
            have = 1
            while have < len(powers):  # doubling: the powers so far times the next one
                more = min(have, len(powers) - have)
                powers[have : have + more] = powers[:more] * np.uint64(pow(base, have, p)) % np.uint64(p)
                have += more
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum((words.astype(np.uint64) + np.uint64(1)) % np.uint64(p) * powers[:-1] % np.uint64(p), out=sums[1:])
            self.tables.append((np.uint64(p), powers, sums % np.uint64(p)))

    def equal(self, a: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a on have the hash of those from a + q on."""
        same = np.ones(len(a), bool)
        for p, powers, sums in self.tables:
            near, far = (sums[a + n] + p - sums[a]) % p, (sums[a + q + n] + p - sums[a + q]) % p
            same &= near * powers[q] % p == far
        return same

    def extend(self, at: np.ndarray, q: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """How far the stretches at ``at`` and ``at + q`` agree, up to ``most``: words from there on, or before."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            mid[~open_] = low[~open_]
            same = self.equal(at if forward else at - mid, q, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and number within the row, for rows of so many members."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def crossing_runs(words: np.ndarray, hashes: Hashes, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """``node, first, last, period`` of the runs over the middle of each node [start, end),
    as far as they lie in it; the smallest period of each stretch."""
    found = []
    for right in (True, False):
        # two whole periods on this side, and room for the fewest periods in the node
        most = np.minimum((end - middle if right else middle - start) // 2, (end - start) // PERIODS)
        most[end - start < WORDS] = 0
        edges = np.searchsorted(np.cumsum(most), np.arange(0, most.sum() + TRIED, TRIED))
        for x, y in zip(edges, np.append(edges[1:], len(most))):
            if x == y:
                continue
            node, q = _ranges(most[x:y])
            node, q = node + x, q + 1
            # the places i at which word i is word i + q fill a whole period on this side: try
            # three of them, the one at the middle first, then extend
            first = middle[node] if right else middle[node] - 2 * q
            for probe in (lambda q: 0 if right else q - 1, lambda q: q - 1 if right else 0, lambda q: q // 2):
                at = first + probe(q)
                ok = words[at] == words[at + q]
                node, q, first = node[ok], q[ok], first[ok]
            found.append((node, q, first))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    node, q, first = map(np.concatenate, zip(*found))
    after = hashes.extend(first, q, end[node] - q - first, True)
    ok = after >= q
    node, q, first, after = node[ok], q[ok], first[ok], after[ok]
    before = hashes.extend(first, q, first - start[node], False)
    x, y = first - before, first + after + q
    ok = (y - x >= np.maximum(WORDS, PERIODS * q)) & (x < middle[node]) & (y > middle[node])
    node, x, y, q = node[ok], x[ok], y[ok], q[ok]
    order = np.lexsort((q, y, x, node))
    node, x, y, q = node[order], x[order], y[order], q[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return node[new], x[new], y[new], q[new]


def _are_runs(words: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray, y: np.ndarray, q: np.ndarray) -> bool:
    """Whether each [x, y) has period q, word by word, and cannot be extended within [low, high)."""
    row, k = _ranges(y - x - q)
    at = x[row] + k
    if not (words[at] == words[at + q[row]]).all():
        return False
    left, right = x > low, y < high
    return bool((words[x[left] - 1] != words[(x + q)[left] - 1]).all() and (words[y[right]] != words[(y - q)[right]]).all())


def _tree(heads: np.ndarray, first: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """``start, middle, end`` of the inner nodes of a balanced tree over each text's symbols;
    ``heads`` are their places, those of text i from number first[i] on."""
    counts = np.diff(first)
    row, number = _ranges(counts)
    nodes, step = [], 1
    while step < counts.max(initial=0):
        left = np.flatnonzero((number % (2 * step) == 0) & (number + step < counts[row]))
        over = number[left] + 2 * step >= counts[row[left]]
        end = np.where(over, bounds[row[left] + 1], heads[np.where(over, 0, left + 2 * step)])
        nodes.append((heads[left], heads[left + step], end))
        step *= 2
    return tuple(np.concatenate(x) for x in zip(*nodes)) if nodes else tuple(np.zeros(0, np.int64) for _ in range(3))


def runs_of(texts: list[list[bytes]], seed: int = 0, primes: tuple[int, ...] = PRIMES) -> tuple[np.ndarray, ...]:
    """``row, start, length, period`` of all runs in these word lists, in the order of row, start and period."""
    ids, sizes = [], []
    for words in texts:
        number: dict[bytes, int] = {}
        ids.append([number.setdefault(w, len(number)) for w in words])
        sizes.append(len(number))
    bounds = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter((i for own in ids for i in own), np.int64, bounds[-1])
    row = np.repeat(np.arange(len(ids)), np.diff(bounds))
    offset = np.cumsum([0, *sizes])
    words = flat + offset[row]  # words of different texts differ
    # pairs of neighbours that occur twice in a text, with their places, in the order of the first
    inside = np.flatnonzero(row[1:] == row[:-1])
    key = words[inside] * (offset[-1] + 1) + words[inside + 1]
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1))
    keep = np.flatnonzero(np.diff(edge) > 1)
    group = keep[np.argsort(inside[order[edge[keep]]], kind="stable")]
    places = inside[order]
    repeated: dict[int, list] = {}
    for x, y in zip(edge[group].tolist(), edge[group + 1].tolist()):
        at = places[x:y]
        r = int(row[at[0]])
        repeated.setdefault(r, []).append((int(flat[at[0]]), int(flat[at[0] + 1]), at - bounds[r]))

    is_head = np.ones(bounds[-1], bool)
    grammars, rules = {}, []
    for r, pairs in repeated.items():
        g = grammars[r] = Grammar(ids[r], sizes[r], pairs)
        low = int(bounds[r])
        is_head[np.asarray(g.inner, np.int64) + low] = False
        place, left = np.array(g.place, np.int64) + low, np.array(g.left, np.int64)
        length = np.array(g.length, np.int64)
        rules.append((np.full(len(place), r), np.arange(len(place)), place, place + length[left], place + length[g.n_words :]))
    heads = np.flatnonzero(is_head)
    start, middle, end = _tree(heads, np.searchsorted(heads, bounds), bounds)
    n_tree = len(start)
    if rules:
        rule_row, rule, place, rule_middle, rule_end = map(np.concatenate, zip(*rules))
        start, middle, end = np.concatenate([start, place]), np.concatenate([middle, rule_middle]), np.concatenate([end, rule_end])
    while True:
        hashes = Hashes(words, seed, primes)
        node, x, y, q = crossing_runs(words, hashes, start, middle, end)
        whole = [(x[node < n_tree], y[node < n_tree], q[node < n_tree])]
        in_rule: dict[int, list] = {}
        for k, a, b, period in zip(*(c[node >= n_tree].tolist() for c in (node - n_tree, x, y, q))):
            in_rule.setdefault(int(rule_row[k]), []).append((int(rule[k]), a - int(place[k]), b - a, period))
        for r, found in in_rule.items():
            derived = grammars[r].occurrences()
            for k, shift, length, period in found:
                at = np.array(derived[k], np.int64) + int(bounds[r]) + shift
                whole.append((at, at + length, np.full(len(at), period)))
        x, y, q = map(np.concatenate, zip(*whole))
        # of stretches with the same period, those inside a longer one go
        order = np.lexsort((-y, x, q))
        x, y, q = x[order], y[order], q[order]
        reach = q * (bounds[-1] + 1) + y
        new = np.ones(len(x), bool)
        new[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
        x, y, q = x[new], y[new], q[new]
        r = np.searchsorted(bounds, x, side="right") - 1
        if _are_runs(words, bounds[r], bounds[r + 1], x, y, q):
            break
        seed += 1
        primes = PRIMES
    order = np.lexsort((q, x))
    x, y, q, r = x[order], y[order], q[order], r[order]
    return r, x - bounds[r], y - x, q


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words without those after a run's first period, joined by a space."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return b" ".join([w for w, covered in zip(words, np.cumsum(change).tolist()) if not covered])


def periodic_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``runs`` (start and length in words, and the smallest period,
    by start and period) and ``collapsed``, the text without the words after a run's first period.

    A word is what white space (space and tab to carriage return) separates. A run is a longest
    stretch of words with a period, of ``PERIODS`` periods and ``WORDS`` words at least."""
    added = ("n_words", "runs", "collapsed")
    df = df.drop(*added)
    at, names = df.columns.index(text), [*df.columns, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = [(t or "").encode().split() for t in part.column(at).to_pylist()]
                row, start, length, period = runs_of(texts)
                edges = np.searchsorted(row, np.arange(len(texts) + 1))
                left = [collapsed(w, start[a:b], length[a:b], period[a:b]) if b > a else b" ".join(w) for w, a, b in zip(texts, edges, edges[1:])]
                runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(map(len, texts)), pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), runs), pa.array(left, pa.binary()).cast(pa.string())],
                    names=names,
                )

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())]))
