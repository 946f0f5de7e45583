import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm.corpus import TEXT_SCHEMA, as_rows, awkward, paragraph, sentence

from tablewright.llm import line_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_order(rows):
    return sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0]))


def brute_lines(rows, least):
    first, out = {}, []
    for at, (_, text) in in_order(rows):
        lines = text.split("\n") if text else []
        words = [max(len(WORD.findall(x)), len(x) // line_dedup.CHARS) for x in lines]
        runs = set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += words[b]
                if total >= least:
                    runs.add((a, b + 1))
                    break
            total = 0
            for b in range(a, -1, -1):
                total += words[b]
                if total >= least:
                    runs.add((b, a + 1))
                    break
        gone = set()
        for a, b in sorted(runs):
            if first.setdefault(tuple(lines[a:b]), (at, a)) != (at, a):
                gone.update(range(a, b))
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
        out.append((rows[at][0], kept, len(lines), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [50, 30, 14, 1])
def test_line_runs_equal_brute_force(spark, least):
    rng = random.Random(9)
    pool = [sentence(rng, rng.randrange(1, 9)) for _ in range(6)]
    rows = awkward() + [(60 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(25)))) for i in range(40)]
    rows += [(61, rows[-1][1]), (62, "日本語" * 70), (63, "日本語" * 70 + "\nx"), (None, "\n".join(pool)), (None, "\n".join(pool))]
    df = spark.createDataFrame(rows, TEXT_SCHEMA).coalesce(1)
    got = as_rows(line_dedup.deduplicate_lines(df, min_words=least), "doc_id", "text", "n_lines", "n_removed")
    assert got == brute_lines(rows, least)


def test_every_line_of_a_maximal_run_goes(spark):
    # 30 + 30 + 10 words: the last line alone lies in no forward part of 50 words
    run = "\n".join(" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 30), ("b", 30), ("c", 10)))
    df = spark.createDataFrame([(1, run + "\nx"), (2, "y\n" + run)], TEXT_SCHEMA)
    assert as_rows(line_dedup.deduplicate_lines(df), "doc_id", "text") == [(1, run + "\nx"), (2, "y")]


def test_lines_with_equal_weak_hashes_are_different(spark):
    """Two different lines of 1,024 words whose polynomial hashes modulo 2^64 are equal."""
    a, b = "x", "y"
    for _ in range(10):
        a, b = a + b, b + a
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], TEXT_SCHEMA)
    assert {r.n_removed for r in line_dedup.deduplicate_lines(df).collect()} == {0}


def test_broadcast_bound_changes_no_result(spark, monkeypatch):
    rows = awkward()
    df = spark.createDataFrame(rows, TEXT_SCHEMA).coalesce(1)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert as_rows(line_dedup.deduplicate_lines(df, min_words=14), "doc_id", "text", "n_lines", "n_removed") == brute_lines(rows, 14)


def test_short_common_lines_stay(spark):
    df = spark.createDataFrame([(i, f"A common line.\nown {i}") for i in range(50)], TEXT_SCHEMA)
    assert {r.n_removed for r in line_dedup.deduplicate_lines(df).collect()} == {0}


def test_line_dedup_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x", 7, 8)], "doc_id long, text string, n_lines int, row int")
    out = line_dedup.deduplicate_lines(df)
    assert out.columns == ["doc_id", "text", "row", "n_lines", "n_removed"]
    assert [tuple(r) for r in out.collect()] == [(1, "x", 8, 1, 0)]
    assert line_dedup.deduplicate_lines(df.limit(0)).count() == 0


def brute_bytes(rows):
    seen, out, done = set(), [], {}
    for at, (doc, text) in in_order(rows):
        body = (text or "").encode()
        covered = np.zeros(len(body), bool)
        if (doc, text) in done:  # a repeated row keeps what the first one keeps
            covered = done[doc, text]
        else:
            for p in range(len(body) - 99):
                if body[p : p + 100] in seen:
                    covered[p : p + 100] = True
                seen.add(body[p : p + 100])
            done[doc, text] = covered
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        kept = bytes(np.frombuffer(body, np.uint8)[~covered])
        out.append((doc, len(body), int(covered.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digests(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=repr)


def test_bytes_equal_brute_force(spark):
    rows = awkward()
    rows += [(50, "é" * 49 + "a" * 3 + "é" * 60), (51, "x" + "é" * 49 + "a" * 3), (52, "q" * 99), (53, "q" * 99), (54, "w" * 100), (55, "w" * 100)]
    df = spark.createDataFrame(rows, TEXT_SCHEMA).repartition(5)
    assert digests(suffix_dedup.deduplicate_bytes(df)) == brute_bytes(rows)


def test_a_frequent_string_is_sent_to_its_bucket_once_per_slice(spark, monkeypatch):
    rng = random.Random(3)
    passage = paragraph(rng, 3)
    rows = [(i, f"{sentence(rng, 9)}{' ' * (500 + i)}{passage}{sentence(rng, 9)}{'-' * (300 + i)}{i}") for i in range(60, 0, -1)]
    df = spark.createDataFrame(rows, TEXT_SCHEMA).coalesce(2)
    seen, group_by = [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: (seen.append(self) if c == ("bucket",) else None, group_by(self, *c))[1])
    got = digests(suffix_dedup.deduplicate_bytes(df))
    assert got == brute_bytes(rows)
    sent = {"prefix": np.uint32, "one": np.uint64}
    for frame, (name, kind) in zip(seen, sent.items(), strict=True):
        # the few buckets of a small table come first; those after them pass on what a slice knows
        counts = Counter()
        for r in frame.filter("bucket < 16").collect():
            counts.update((r.bucket, h) for h in np.frombuffer(r[name], kind).tolist())
        assert 1 < max(counts.values()) <= 2, name


def test_buckets_answer_lots_and_send_no_text_numbers(spark, monkeypatch):
    """Answers were a row for each bucket and text, and each string went with its text's number and key."""
    rng = random.Random(7)
    passages = [paragraph(rng, 4) for _ in range(5)]
    rows = [(rng.randrange(40) if i % 9 else None, f"{sentence(rng, 9)}{rng.choice(passages)}{sentence(rng, 30)}{rng.choice(passages)}{i}") for i in range(200)]
    df = spark.createDataFrame(rows, TEXT_SCHEMA).repartition(4)
    answers, sent, repeated, later = [], [], suffix_dedup._repeated_samples, suffix_dedup._later
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "LOT_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "_repeated_samples", lambda texts, *n: (answers.append((out := repeated(texts, *n), n)), out)[1])
    monkeypatch.setattr(suffix_dedup, "_later", lambda chunks, n: (sent.append(chunks.count()), later(chunks, n))[1])
    got = digests(suffix_dedup.deduplicate_bytes(df))
    assert got == brute_bytes_by_text(rows)
    (told, (n_buckets, n_lots)) = answers[0]
    assert n_lots > 16 and sent[0] > 20
    assert not told.groupBy("lot").count().filter(f"count > {2 * n_buckets}").head(1) and told.filter(f"lot < 0 or lot >= {n_lots}").count() == 0
    few, lots = repeated(df.selectExpr("doc_id", "xxhash64(text) as key", "text"), 16, 3), 3
    assert few.count() <= 2 * 16 * lots < len(rows)


def brute_bytes_by_text(rows):
    """Rows of one number are in the order of their texts' keys."""
    key = {t: suffix_key(t) for _, t in rows}
    return brute_bytes(sorted(rows, key=lambda r: key[r[1]]))


def suffix_key(text):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    return SparkSession.active().range(1).select(suffix_dedup.text_key(F.lit(text), 0)).first()[0]


def test_bytes_other_columns_empty_table_and_no_repeats(spark):
    df = spark.createDataFrame([(1, "a", "x", 5)], "doc_id long, text string, kept string, key int")
    out = suffix_dedup.deduplicate_bytes(df)
    assert out.columns == ["doc_id", "text", "key", "n_bytes", "n_removed", "spans", "kept"]
    assert [(r.key, r.n_bytes, bytes(r.kept)) for r in out.collect()] == [(5, 1, b"a")]
    assert suffix_dedup.deduplicate_bytes(df.limit(0)).count() == 0


def test_texts_that_share_a_key_get_other_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    own = suffix_dedup.text_key
    monkeypatch.setattr(suffix_dedup, "text_key", lambda body, salt: own(body, salt) if salt else F.lit(7).cast("long"))
    rows = awkward()
    assert digests(suffix_dedup.deduplicate_bytes(spark.createDataFrame(rows, TEXT_SCHEMA))) == brute_bytes(rows)


def test_the_cover_is_a_difference_cover():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
