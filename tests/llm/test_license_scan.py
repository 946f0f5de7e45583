"""License scan against word-by-word search."""

import random
import re

import pytest

from tablewright.llm import license_scan as ls

from .corpus import awkward, sentence

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORDS.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def brute(doc_id, text):
    words = words_of(text)
    base = sorted((i, label) for label, p in ls.BASE for i in places(words, p))
    labels = {label for _, label in base} | {label for label, p in ls.VARIANTS if places(words, p)}
    return doc_id, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, sorted({x for _, x in base}), sorted(labels)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").collect()), key=repr)


def test_phrases_match_brute_force(spark):
    rng = random.Random(8)
    pool = "gnu general public license apache mit cc by nc sa version 2 0 3 under the Ünder".split()
    texts = [" ".join(rng.choice([str.upper, str.title, str])(rng.choice(pool)) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["CC BY-NC 4.0", "cc_by", "cc-by", "accby", "cc by" * 3, "cc by " * 500, "MIT  \n\t License", "mitlicense", "mit license" + "x", "apache license"]
    rows = awkward() + [(100 + i, t) for i, t in enumerate(texts)] + [(900 + i, texts[0] + " mit license") for i in range(50)]
    found = rows_of(ls.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ls.templates(spark)))
    assert found == sorted((brute(*r) for r in rows), key=repr)


def notice(label):
    return dict(ls.NOTICES)[label].split()


@pytest.mark.parametrize("label", [label for label, _ in ls.NOTICES])
def test_notices_with_changed_words(spark, label):
    rng = random.Random(3)
    words = notice(label)
    put_in = words[: len(words) // 2] + ["new", "words"] + words[len(words) // 2 :]
    left_out = words[:6] + words[8:]
    other = words[:5] + ["changed"] + words[6:]
    half = words[: len(words) // 3]
    apart = [x for w in words for x in (w, "and", "so")]
    texts = {1: words, 2: put_in, 3: left_out, 4: other, 5: half, 6: apart, 7: sentence(rng, 80).split()}
    rows = [(i, sentence(rng, 30) + " " + " ".join(t).title() + ". " + sentence(rng, 30)) for i, t in texts.items()]
    out = {r.doc_id: r for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string"), ls.templates(spark).filter("not whole")).collect()}
    for i in (1, 2, 3, 4):
        assert out[i].labels == [label], i
        assert ls.SHARE <= out[i].score <= 1
        first, last = out[i].spans[0].first, out[i].spans[0].last
        assert first == 30 and last - first + 1 == len(texts[i])
    assert out[1].score == 1.0
    for i in (5, 6, 7):
        assert out[i].labels == [] and out[i].score == 0.0 and out[i].spans == [] and out[i].first_word is None


def test_own_templates_clashes_and_empty_tables(spark):
    own = spark.createDataFrame([("x", "one", True, True), ("y", "", True, True), (None, "two words", False, True), ("x", "one", True, True)], "label string, text string, base boolean, whole boolean")
    df = spark.createDataFrame([(1, "One two words one", 5, "s", "d"), (2, None, 5, "s", "d")], "doc_id long, text string, score int, digest string, k string")
    out = ls.scan(df, own)
    assert out.columns == ["doc_id", "text", "digest", "k", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    first, second = out.orderBy("doc_id").collect()
    assert (first.n_base, first.first_word, first.last_word, first.base_labels, first.labels, first.score) == (2, 0, 3, ["x"], ["x"], 1.0)
    assert (second.n_words, second.n_base, second.labels, second.digest) == (0, 0, [], "s")
    assert ls.scan(df.limit(0), own).collect() == []
    assert {r.score for r in ls.scan(df, own.limit(0)).collect()} == {0.0}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(awkward(), "doc_id long, text string")
    plan = ls.scan(docs, ls.templates(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_large_tables_are_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"doc {i} mit license") for i in range(40)], "doc_id long, text string")
    want = rows_of(ls.scan(docs, ls.templates(spark)))
    monkeypatch.setattr(ls, "BROADCAST_GRAMS", 0)
    monkeypatch.setattr(ls, "BROADCAST_TEXTS", 0)
    assert rows_of(ls.scan(docs, ls.templates(spark))) == want
    assert want[0][2:] == (1, 2, 2, ["mit"], ["mit"])
