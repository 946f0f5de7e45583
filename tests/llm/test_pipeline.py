import re

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from llm.corpus import paragraph
from tablewright.llm import line_dedup, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, on documents."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.keep(stage(spark, docs, SF), "test-pipeline")
        out.append((docs, path))
        docs = path
    return out


def test_stages_and_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]


def test_all_but_the_last_return_the_columns_of_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert all(after.dtypes == columns for _, after in stages[:-1])


def test_quality_rejects_junk_only(spark, stages):
    before, after = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    told = [r.doc_id for r in before.collect() if r.doc_id in labels]
    assert sum((d in kept) == (labels[d] == 1) for d in told) >= 0.97 * len(told)


def test_line_dedup_works_on_all_that_quality_kept(stages):
    before, after = stages[1]
    lines = {r.doc_id: (r.n_removed, r.n_lines, r.text) for r in line_dedup.deduplicate_lines(before).collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    assert got == {d: (t, len(t)) for d, (gone, n, t) in lines.items() if gone == 0 or gone < n}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = stages[2]
    kept = {r.doc_id for r in after.collect()}
    sets = {r.doc_id: shingles(r.text) for r in before.collect()}

    def alike(a, b):
        return 10 * len(a & b) >= 8 * len(a | b)

    for d, own in sets.items():
        copies = [e for e, other in sets.items() if e != d and own and other and alike(own, other)]
        if d in kept:
            assert not [e for e in copies if e in kept]
        else:
            assert copies


def test_tokens_equal_the_library(stages):
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    before, after = stages[4]
    texts = {r.doc_id: r.text for r in before.collect()}
    got = {r.doc_id: r.ids for r in after.collect()}
    assert got == {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


def test_awkward_documents_pass_every_stage(spark, tmp_path):
    import random

    rng = random.Random(1)
    text = paragraph(rng)
    rows = [(1, text, "a", 7), (2, text, "b", 7), (2, text, "b", 7), (3, None, None, None), (4, "", None, 0), (None, paragraph(rng), "c", 1), (5, paragraph(rng, 900), "d", 2)]
    schema = "doc_id long, text string, score string, n_chars long"
    docs = spark.createDataFrame([(*r, "x") for r in rows], f"{schema}, row string")
    for docs_now in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs_now, SF)
            assert out.columns == docs.columns
            docs_now = corpus_pipeline.keep(out, "test-pipeline")
        corpus_pipeline.STAGES[-1][1](spark, docs_now, SF).collect()


def test_registered_queries():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert quality.TRAIN_ROWS == 8_000
