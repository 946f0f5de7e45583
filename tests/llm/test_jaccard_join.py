import random
import re
import tracemalloc
import weakref

import pyarrow as pa
import pytest
from llm.corpus import TEXT_SCHEMA, as_rows, awkward, sentence
from pyspark.sql import types as T

from tablewright.llm import jaccard_join, shared
from tablewright.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = low
    first = {}
    for at, (doc, _) in enumerate(rows):
        if doc is not None:
            first[label[at]] = min(doc, first.get(label[at], doc))
    return sorted(((doc, len(sets[at]), first.get(label[at]) if sets[at] else doc) for at, (doc, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, n, percent):
    rng = random.Random(5)
    rows = awkward()
    for family in range(8):  # chains of edits around the threshold
        words = sentence(rng, rng.choice([4, 12, 40, 150])).split()
        for copy in range(6):
            rows.append((100 + family * 10 + copy, " ".join(words)))
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(["new", "other", "words"])
            if rng.random() < 0.4:
                words.insert(rng.randrange(len(words)), "more")
    df = spark.createDataFrame(rows, TEXT_SCHEMA).repartition(3)
    got = as_rows(jaccard_join.link_components(df, n=n, percent=percent), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows, n, percent)


def test_links_without_the_smallest_node_are_found(spark):
    """Members that are far from a group's first node, but near each other, still join."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(12):
        rows.append((step, " ".join(words)))
        words[step * 9 : step * 9 + 4] = [f"x{step}{k}" for k in range(4)]
    got = as_rows(jaccard_join.link_components(spark.createDataFrame(rows, TEXT_SCHEMA)), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows, 3, 90)


def test_deletions_and_spare_segments_keep_every_pair():
    import numpy as np

    rng = np.random.default_rng(2)
    lows = jaccard_join.bands(90)
    for size in (12, 60, 400):
        band = int(np.searchsorted(lows, size, side="right")) - 1
        need = jaccard_join.differences(band, 90) + 1
        for m, d, s in ((need, 0, 0), (need - need // 2, need // 2, 0), (need + 2, 0, 2)):
            for _ in range(50):
                a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
                drop = rng.integers(0, max(1, len(a) // 10) + 1)
                b = np.sort(a[drop:]) if len(a) - drop >= lows[band] else a
                both = len(np.intersect1d(a, b))
                if 100 * both < 90 * (len(a) + len(b) - both):
                    continue
                wa, fa = jaccard_join.signatures(a, band, m, d, s)
                wb, fb = jaccard_join.signatures(b, band, m, d, s)
                assert set(wa) & (set(wb) | set(fb)) or set(wb) & set(fa)


def test_sketches_never_hide_a_link():
    import numpy as np

    rng = np.random.default_rng(4)
    refused = 0
    for size in (3, 20, 130, 260, 511, 512, 513, 3000):
        for share in (0.0, 0.03, 0.05, 0.1, 0.3):
            a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) >= share], rng.integers(0, 1 << 62, int(size * share)).astype(np.uint64)]))
            p, q = jaccard_join.sketch(a), jaccard_join.sketch(b)
            one, two = jaccard_join.folded([p, q], min(len(p), len(q)))
            both = len(np.intersect1d(a, b))
            for percent in (80, 90):
                maybe = bool(jaccard_join.may_link(len(a), len(b), int(jaccard_join.differing(one, two)), percent))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    assert maybe
                refused += not maybe
    assert refused > 20


@pytest.mark.parametrize("percent", [80, 90])
def test_sketches_tell_unrelated_sets_apart(percent):
    """Sets just below twice the bits of a sketch passed for linked by chance in several of a hundred pairs."""
    import numpy as np

    rng = np.random.default_rng(8)
    sizes = rng.integers(480, 513, 150).tolist() + rng.integers(960, 1025, 50).tolist()
    sets = [np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64)) for size in sizes]
    sketches = [jaccard_join.sketch(s, percent=percent) for s in sets]
    passed = pairs = 0
    for i, a in enumerate(sets):
        for j in range(i):
            one, two = jaccard_join.folded([sketches[i], sketches[j]], min(len(sketches[i]), len(sketches[j])))
            passed += bool(jaccard_join.may_link(len(a), len(sets[j]), int(jaccard_join.differing(one, two)), percent))
            pairs += 1
    assert passed < pairs / 1000


def test_blocks_and_chunks_change_no_result(spark, monkeypatch):
    """A family of near copies around one text, and a chain of edits, dealt into many small blocks."""
    rng = random.Random(11)
    words = sentence(rng, 90).split()
    rows = [(0, " ".join(words))]
    for i in range(1, 60):
        own = list(words)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own)))
    for i in range(60, 90):
        words[rng.randrange(len(words))] = f"y{i}"
        rows.append((i, " ".join(words)))
    for name, value in (("BLOCK", 3), ("CHUNK", 2), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(jaccard_join, name, value)
    df = spark.createDataFrame(rows, TEXT_SCHEMA).repartition(3)
    for n, percent in ((3, 90), (5, 80)):
        assert as_rows(jaccard_join.link_components(df, n=n, percent=percent), "doc_id", "n_shingles", "component_id") == brute(rows, n, percent)


def test_words_with_equal_weak_hashes_are_different(spark):
    """Two different words of 1,024 letters whose polynomial hashes modulo 2^64 are equal."""
    a, b = "x", "y"
    for _ in range(10):
        a, b = a + b, b + a
    got = as_rows(jaccard_join.link_components(spark.createDataFrame([(1, a), (2, b)], TEXT_SCHEMA)), "doc_id", "component_id")
    assert got == [(1, 1), (2, 2)]


def test_word_digests_are_of_the_words():
    import hashlib

    import numpy as np
    import pyarrow as pa

    from tablewright.llm.words import digest_hashes, words

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("ab\u00e9\x00") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(rng.randrange(60))) for _ in range(80)]
    found = words(pa.array([*texts, None, ""]), hasher=digest_hashes)
    want = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for t in texts for w in t.encode().split()]
    assert found.hashes.tolist() == want
    assert len(words(pa.array([None, ""]), hasher=digest_hashes).hashes) == 0 and np.all(np.diff(found.bounds) >= 0)


class Tasks:
    """Stands for a table and keeps the functions that its tasks run over batches."""

    schema = T.StructType([T.StructField("doc_id", T.LongType())])

    def __init__(self):
        self.runs = []

    def mapInArrow(self, run, schema):  # noqa: N802
        self.runs.append(run)
        return self

    def __getattr__(self, name):
        return lambda *a, **k: self


def test_texts_are_read_in_small_slices_and_packed_in_large_ones(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(str(rng.randrange(5_000)) for _ in range(250)) for _ in range(1_600)]  # 1.9 MB
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)))], names=["doc_id", "text", "mark"])
    tasks, plan = Tasks(), {b: (40, 0, 0) for b in range(40)}
    jaccard_join._sets(tasks, 5)
    jaccard_join._candidates(tasks, 5, 80, plan, 4)
    most = []
    for run, given in zip(tasks.runs, (batch, batch.select(["text"]))):
        tracemalloc.start()
        list(run(iter([given])))
        most.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert most[0] < 12 and most[1] < 20, most  # MB; 53 with slices of 2 MB
    small = [list(run(iter([given]))) for run, given in zip(tasks.runs, (batch, batch.select(["text"])))]
    monkeypatch.setattr(jaccard_join, "SLICE", 2_000_000)
    large = [list(run(iter([given]))) for run, given in zip(tasks.runs, (batch, batch.select(["text"])))]
    assert pa.Table.from_batches(small[0]).to_pylist() == pa.Table.from_batches(large[0]).to_pylist()
    assert [b.to_pylist() for b in small[1]] == [b.to_pylist() for b in large[1]]


def test_a_task_gives_memory_back_when_its_last_batch_is_gone(monkeypatch):
    alive, calls = [], []

    def run(batches):
        for batch in batches:
            alive.append(weakref.ref(batch))
            yield batch.num_rows

    monkeypatch.setattr(shared, "release", lambda: calls.append([r() is not None for r in alive]))
    assert list(shared.released(run)(pa.record_batch([pa.array([i])], names=["x"]) for i in range(3))) == [1, 1, 1]
    assert calls == [[], [False] * 3]


def test_empty_table(spark):
    assert jaccard_join.link_components(spark.createDataFrame([], TEXT_SCHEMA)).count() == 0


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_a_path_a_star_and_noise(spark, one_task):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (100, 101), (None, 3)]
    got = as_rows(components(spark.createDataFrame(links, "a long, b long"), one_task), "node", "label")
    assert got == sorted([(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 130)], key=repr)
    assert components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0
