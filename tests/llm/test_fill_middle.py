"""Fill-in-middle against its definition, and the roaring set against a plain list."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import fill_middle as fim

from .corpus import awkward


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    n = len(units)
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def rows_of(df):
    cols = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return sorted((tuple(r) for r in df.select(*cols, fim.restored(F.col("output"), F.col("form"))).collect()), key=repr)


def test_forms_match_the_definition(spark):
    odd = ["a<P>b", "x <M", "<<S", "é日本 text line\r\n", "😀a😀bc", "<S", "S><", "P>", "kKſ", "\x00a\x00"]
    rows = awkward() + [(100 + i, t) for i, t in enumerate(odd * 20)] + [(1000 + i, "One two, <P three.\n" * (i % 9)) for i in range(300)]
    found = rows_of(fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert found == sorted((brute(*r) for r in rows), key=repr)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_very_long_texts(spark):
    rng = random.Random(3)
    texts = ["ab, " * 60_000, "-" * 200_000, "z" * 200_000, "é1" * 65_536, "a" * 65_535 + "b" * 2 + "-", "a" * 65_536, "-" * 65_536, "".join(rng.choice("ab-é ") for _ in range(150_000))]
    rows = [(i * 7 + k, t) for i, t in enumerate(texts) for k in range(7)]
    found = rows_of(fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == sorted((brute(*r) for r in rows), key=repr)


@pytest.mark.parametrize("kind", ["sparse", "half", "runs", "full", "gaps"])
def test_roaring_select(kind):
    rng = np.random.default_rng(5)
    n = 5 * fim.BLOCK // 2
    share = {"sparse": 0.01, "half": 0.5, "runs": 0.5, "full": 1.1, "gaps": 0.3}[kind]
    member = rng.random(n) < share
    if kind == "runs":
        member = np.repeat(rng.random(n // 500 + 1) < 0.5, 500)[:n]
    if kind == "gaps":
        member[fim.BLOCK : 2 * fim.BLOCK] = False
    found = fim.BoundarySet()
    for key in range(3):
        found.add_block(key, np.flatnonzero(member[key * fim.BLOCK : (key + 1) * fim.BLOCK]))
    want = np.flatnonzero(member)
    assert len(found) == len(want)
    for k in [0, len(want) - 1, *rng.integers(0, len(want), 500).tolist()]:
        assert found.select(k) == want[k]
    expected = {"sparse": fim.Array, "half": fim.Bitmap, "runs": fim.Runs, "full": fim.Runs, "gaps": fim.Bitmap}[kind]
    assert {type(c) for c in found.containers[:1]} == {expected}


def test_clashing_and_empty(spark):
    df = spark.sql("select 1L doc_id, 'a b c' text, 9 n, 'x' form, 'y' body, 'z' h1, 's' source, 3 units")
    out = fim.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "body", "h1", "source", "units", "n", "form", "prefix_chars", "middle_chars", "output"]
    row = out.first()
    assert (row.body, row.h1, row.units, row.n) == ("y", "z", 3, 5)
    assert fim.fill_in_middle(df.limit(0)).collect() == []
