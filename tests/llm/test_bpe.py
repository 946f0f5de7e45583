import hashlib
import random

import pyarrow as pa
import public_tokenizers
import pytest
from llm.corpus import TEXT_SCHEMA, awkward
from tokenizers import Tokenizer

from tablewright.llm import bpe
from tablewright.llm.bpe import Bpe, decode, encode

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
LETTERS = "abcdeABC  '.,!?0123éüßñÑÉ²³½ªºİΣσς中文日本語\u0301\x1c\x85\xa0\u200b\n\t\u2019\u201c\u20ac\U0001f600\U0001d4b3ǅŉ"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed=4):
    rng = random.Random(seed)
    parts = ["don't", "we'll", "x'", "'re'", "<|endoftext|>", "Hello", "WORLD!!", "a1b2", "'S", "Straße"]
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    out += [" ".join(rng.choice(parts) for _ in range(20)) for _ in range(100)]
    out += ["".join(rng.choice(["th", "e", "ing", "é", "'", "!"]) for _ in range(rng.randint(500, 4000))) for _ in range(20)]
    return [*out, "", "a" * 3000, "é" * 2500, "!" * 2000 + "'s", "word " * 900]


def test_texts_in_one_pass_equal_the_library(library):
    own = Bpe(PATH)
    for text in texts():
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_each_plain_character_equals_the_library(library):
    # some capitals up to U+024F have their small letter beyond it; three signs beyond it have theirs below
    own = Bpe(PATH)
    for c in [*map(chr, range(0x250)), *map(chr, range(0x2010, 0x2028)), "\u20ac", "\u1e9e", "\u212a", "\u212b"]:
        for text in (f"a{c}b", f"1{c}2", f"'{c}", f"{c}'s", f"!{c} {c}"):
            assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, (hex(ord(c)), text)
    text = "BAKI ŞƏHƏRİ"
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [7, 50, 1500])
def test_joined_pieces_equal_the_library(library, size):
    own = Bpe(PATH)
    for text in texts(size):
        if "<|" in text:
            continue
        body, plain = own.normalise(text)
        level = [(body[c : c + size], *own.encode_piece(body[c : c + size], plain)) for c in range(0, max(len(body), 1), size)]
        while len(level) > 1:
            level = [own.join_pieces(*level[i : i + 2], plain) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert level[0][4].tolist() == library.encode(text, add_special_tokens=False).ids


def test_tree_path_and_round_trip_equal_the_library(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([*texts(9)[::6], "one <|endoftext|> two" * 60])] + [(d, t, "y") for d, t in awkward()]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    coded = encode(df, PATH, piece_chars=200)
    assert coded.columns == ["doc_id", "ids"]
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in decode(coded, PATH).collect()), key=repr)
    expected = []
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected, key=repr)


def test_empty_table(spark):
    assert decode(encode(spark.createDataFrame([], TEXT_SCHEMA), PATH), PATH).count() == 0


def test_digest_of_an_empty_text(spark):
    row = decode(encode(spark.createDataFrame([(1, None)], TEXT_SCHEMA), PATH), PATH).selectExpr("sha2(array_join(ids, ' '), 256) a", "sha2(decoded, 256) b").first()
    assert row.a == row.b == hashlib.sha256(b"").hexdigest()


def test_decoding_holds_little_at_once(library, monkeypatch):
    # neither the encoder's vocabulary nor more than a slice of texts
    monkeypatch.setattr(bpe, "Bpe", None)
    lists = [library.encode(f"word {i} " * 500, add_special_tokens=False).ids for i in range(300)] + [[], None]
    batch = pa.record_batch([pa.array(range(302)), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])
    out = list(bpe.decoded(iter([batch]), PATH, 1, ["doc_id", "ids", "decoded"]))
    assert len(out) > 1 and all(len(b.column(1).flatten()) <= bpe.DECODED_IDS for b in out)
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["doc_id"], r["ids"]) for r in rows] == list(enumerate(lists))
    assert [r["decoded"] for r in rows] == [library.decode(x or [], skip_special_tokens=False) for x in lists]


def test_short_words_do_without_the_merges():
    own = Bpe(PATH)
    assert len(own.encode("Some words of a text, don't they?")) and not {"ranks", "tokens"} & set(vars(own))
