"""BPE encoding and decoding with tree concatenation for long unsplit text.

Most texts are split into words, and a word is looked up in a bounded
per-worker cache that the tokenizers library fills. Texts above
``piece_chars`` are normalised, cut into pieces, encoded piece by piece in
parallel tasks, and joined pairwise as a tree: around each join a growing
window is encoded again until its first and last tokens agree with what both
sides already have. A BPE token sequence is the encoding of its text exactly
when every adjacent pair is the encoding of the pair's own text, so this
agreement makes the joined sequence exact. The same join serves single words
above ``LONG_WORD`` characters.

Defined results: a null or empty text has no ids and decodes to the empty
text; repeated rows are encoded each by itself; other columns pass through, but a
column with the name of a new one is replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.shared import release, released
from tablewright.names import quote_ident

#: Characters of a piece of a long text, and of a word that is joined as a tree.
PIECE_CHARS = 65_536
LONG_WORD = 1_024
#: Bytes of texts encoded at once, and ids decoded at once; bound the Python objects of a worker.
ENCODED_BYTES = 2_000_000
DECODED_IDS = 250_000
#: Words that a worker remembers before it starts anew (memory bound, no effect on results).
CACHED_WORDS = 100_000

# The pre-tokenizer pattern of the vocabulary file (contractions,
# letter runs, single numbers, runs of other signs), for characters up to U+024F
# and the general punctuation below; other texts go through the library's own.
_SPACE = r"\t-\r \x85\xa0"
_LETTER = "a-zªµºß-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_UNUSUAL = re.compile("[^\x00-ɏ‐-‧€]")
#: The longest look-ahead that the pattern needs: a contraction.
_AHEAD = 3


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Bpe:
    """One vocabulary in one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = _spec(path)
        self.path = path
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"].get("end_of_word_suffix") or ""
        self.bytes = _byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.reset()

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        """The merges, which long words alone need."""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in _spec(self.path)["model"]["merges"])
        return {(a, b): i for i, (a, b) in enumerate(pairs)}

    @cached_property
    def tokens(self) -> dict[int, str]:
        return {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}

    # words ------------------------------------------------------------
    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lens, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        found = [self.word(w) for w in words]
        self._keep(words, np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.int32))

    def _keep(self, words: list[str], lens: np.ndarray, ids: np.ndarray) -> None:
        k, n = len(self.known), len(ids)
        while k + len(words) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[k : k + len(words)], self.lens[k : k + len(words)] = self.used + np.cumsum(lens) - lens, lens
        self.flat[self.used : self.used + n] = ids
        self.used += n
        self.known.update(zip(words, range(k, k + len(words))))

    def spell(self, word: str) -> str:
        return "".join(map(self.bytes.__getitem__, word.encode("utf-8")))

    def word(self, word: str) -> list[int]:
        """Ids of one whole pre-token."""
        spelled = self.spell(word)
        if len(spelled) > LONG_WORD:
            return [self.vocab[t] for t in self.tree(spelled)]
        return [t.id for t in self.library.model.tokenize(spelled)]

    def merge(self, spelled: str, ends: bool) -> list[str]:
        """Tokens of part of a word; ``ends`` if it reaches the word's end."""
        parts: list[str | None] = list(spelled)
        if ends:
            parts[-1] += self.suffix
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapify(queue)
        while queue:
            _, i, a, b = heappop(queue)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := self.ranks.get((parts[i], parts[k]))) is not None:
                    heappush(queue, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := self.ranks.get((parts[h], parts[i]))) is not None:
                heappush(queue, (r, h, parts[h], parts[i]))
        return [p for p in parts if p is not None]

    def size(self, token: str, last: bool) -> int:
        return len(token) - (len(self.suffix) if last and token.endswith(self.suffix) else 0)

    def join(self, left: list[str], right: list[str], ends: bool) -> list[str]:
        """Tokens of a word part from those of its two halves. The left half was
        encoded as the inside of a word, the right one too unless ``ends``."""
        reach = 2
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            to_end = ends and b == len(right)
            texts = [*left[a:], *right[:b]]
            if to_end and self.suffix:
                texts[-1] = texts[-1][: len(texts[-1]) - len(self.suffix)]
            window = self.merge("".join(texts), to_end)
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return [*left[:a], *window, *right[b:]]
            reach *= 2

    def tree(self, spelled: str, ends: bool = True) -> list[str]:
        if len(spelled) <= LONG_WORD:
            return self.merge(spelled, ends)
        m = len(spelled) // 2
        return self.join(self.tree(spelled[:m], False), self.tree(spelled[m:], ends), ends)

    # texts ------------------------------------------------------------
    def normalise(self, text: str) -> tuple[str, bool]:
        """The normalised text, and whether the plain pattern splits it as the library does."""
        lower = text.lower()
        # some capitals up to U+024F have their small letter beyond it
        if _UNUSUAL.search(lower):
            return self.library.normalizer.normalize_str(text), False
        return lower, True

    def words(self, text: str, plain: bool) -> list[str]:
        if plain:
            return _WORD.findall(text)
        return [text[a:b] for a, b in self.spans(text, plain)]

    def spans(self, text: str, plain: bool) -> list[tuple[int, int]]:
        if plain:
            return [m.span() for m in _WORD.finditer(text)]
        return [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def looked_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place in the cache, and the ids of all of them."""
        if len(self.known) > CACHED_WORDS:
            self.reset()
        known = self.known
        at = list(map(known.get, words))
        if None in at:
            self._learn(list({w for w, i in zip(words, at) if i is None}))
            at = list(map(known.get, words))
        at = np.array(at, np.int64)
        lens = self.lens[at]
        ends = np.cumsum(lens)
        if not len(ends):
            return at, np.zeros(0, np.int32)
        return at, self.flat[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(ends[-1])]

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Texts between special tokens, and the special tokens."""
        at = 0
        for m in self.cut.finditer(text) if any(s in text for s in self.special) else ():
            yield text[at : m.start()], None
            yield "", self.special[m.group()]
            at = m.end()
        yield text[at:], None

    def encode(self, text: str | None) -> np.ndarray:
        out = []
        for part, special in self.parts(text or ""):
            if special is not None:
                out.append(np.array([special], np.int32))
            else:
                out.append(self.looked_up(self.words(*self.normalise(part)))[1])
        return out[0] if len(out) == 1 else np.concatenate(out)

    # pieces of long texts -------------------------------------------------
    def encode_piece(self, text: str, plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the piece's words, number of ids of each, all ids."""
        spans = np.array(self.spans(text, plain), np.int32).reshape(-1, 2)
        at, ids = self.looked_up([text[a:b] for a, b in spans.tolist()])
        return spans[:, 0], spans[:, 1], self.lens[at].astype(np.int32), ids

    def join_pieces(self, left: tuple, right: tuple, plain: bool) -> tuple:
        """(text, starts, ends, counts, ids) of the two pieces' text.

        The words that the join may have cut are split and encoded again, from
        the last word of the left piece that no later text can change, in a
        window that grows until a word start of the right piece is reached
        by both splits."""
        cut, (text, starts, ends, counts, ids) = len(left[0]), left
        k = int(np.searchsorted(ends, cut - _AHEAD))
        begin = int(starts[k]) if k < len(starts) else int(ends[-1]) if k else 0
        whole = text + right[0]
        grow = 64
        while True:
            stop = min(len(whole), cut + grow)
            kept, meet = [], len(right[1]) if stop == len(whole) else None
            for a, b in self.spans(whole[begin:stop], plain):
                a, b = begin + a, begin + b
                if b >= stop - _AHEAD and stop < len(whole):
                    break
                j = int(np.searchsorted(right[1], a - cut))
                if a >= cut and j < len(right[1]) and right[1][j] == a - cut:
                    meet = j
                    break
                kept.append((a, b))
            if meet is not None:
                break
            grow *= 2
        found = [np.array(self._across(whole, a, b, left, right, cut), np.int32) for a, b in kept]
        spans = np.array(kept, np.int32).reshape(-1, 2)
        return (
            whole,
            np.concatenate([starts[:k], spans[:, 0], right[1][meet:] + np.int32(cut)]),
            np.concatenate([ends[:k], spans[:, 1], right[2][meet:] + np.int32(cut)]),
            np.concatenate([counts[:k], np.array([len(x) for x in found], np.int32), right[3][meet:]]),
            np.concatenate([ids[: counts[:k].sum()], *found, right[4][right[3][:meet].sum() :]]),
        )

    def _across(self, text: str, a: int, b: int, left: tuple, right: tuple, cut: int) -> list[int]:
        """Ids of the word text[a:b]; a long one across the cut is joined from its halves' tokens."""
        if not a < cut < b or b - a <= LONG_WORD:
            return self.looked_up([text[a:b]])[1].tolist()
        i, j = int(np.searchsorted(left[1], a)), int(np.searchsorted(right[2], b - cut))
        same_left = i < len(left[1]) and (left[1][i], left[2][i]) == (a, cut)
        same_right = j < len(right[2]) and (right[1][j], right[2][j]) == (0, b - cut)
        if not (same_left and same_right):
            return [self.vocab[t] for t in self.tree(self.spell(text[a:b]))]
        n = int(left[3][:i].sum())
        before = [self.tokens[x] for x in left[4][n : n + left[3][i]].tolist()]
        after = [self.tokens[x] for x in right[4][: right[3][j]].tolist()]
        # the left half was encoded as a whole word: encode its last tokens again, as the inside of one
        before[-1] = before[-1].removesuffix(self.suffix)
        tail = 2
        while True:
            at = max(0, len(before) - tail)
            window = self.merge("".join(before[at:]), False)
            if at == 0 or window[0] == before[at]:
                return [self.vocab[t] for t in self.join([*before[:at], *window], after, True)]
            tail *= 2


@lru_cache(maxsize=2)
def _bpe(path: str) -> Bpe:
    bpe = Bpe(path)
    release()  # what reading the file took
    return bpe


def _as_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes or values of one column."""
    sizes = np.diff(np.asarray(batch.column(column).offsets if pa.types.is_list(batch.column(column).type) else _offsets(batch.column(column))))
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    yield batch.slice(at)


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``df`` with the token ids of ``text`` as ``ids array<int>``; ``text`` itself is dropped.

    ``vocabulary`` is the path of a tokenizers file on every worker. Texts above
    ``piece_chars`` characters take the tree path, the others one pass.
    """
    df = df.drop(ids) if ids != text else df
    rest = [c for c in df.columns if c != text]
    column = F.col(quote_ident(text))
    schema = _with(df.drop(text), ids, T.ArrayType(T.IntegerType()))
    others = [F.col(quote_ident(c)) for c in rest]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        for batch in batches:
            for part in _slices(batch, 0, ENCODED_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], _as_lists([bpe.encode(t) for t in part.column(0).to_pylist()])], names=[*rest, ids]
                )
        # the worker goes on to other stages, without the vocabulary
        _bpe.cache_clear()

    is_long = F.coalesce(F.length(column), F.lit(0)) > piece_chars
    whole = df.filter(~is_long).select(F.coalesce(column, F.lit("")).alias("__text"), *others).mapInArrow(released(short), schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        for batch in batches:
            for one in (batch.slice(i, 1) for i in range(batch.num_rows)):
                rows = []
                for at, (part, special) in enumerate(bpe.parts(one.column(1)[0].as_py())):
                    body, plain = bpe.normalise(part)
                    rows += [(at, i, body[c : c + piece_chars], plain, special) for i, c in enumerate(range(0, max(len(body), 1), piece_chars))]
                yield pa.RecordBatch.from_pylist(
                    [{"__doc": one.column(0)[0].as_py(), "__part": p, "__piece": i, "__text": t, "__plain": plain, "__special": s}
                     for p, i, t, plain, s in rows], schema=cut_schema)

    cut_schema = pa.schema([("__doc", pa.binary()), ("__part", pa.int64()), ("__piece", pa.int64()), ("__text", pa.string()), ("__plain", pa.bool_()), ("__special", pa.int32())])
    coded = "__doc binary, __part long, __piece long, __text string, __plain boolean, __starts binary, __ends binary, __counts binary, __ids binary"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                special = row.pop("__special")
                found = bpe.encode_piece(row["__text"], row["__plain"]) if special is None else ([0], [0], [1], [special])
                row |= zip(("__starts", "__ends", "__counts", "__ids"), (np.asarray(x, np.int32).tobytes() for x in found))
                yield pa.RecordBatch.from_pylist([row], schema=coded_arrow)

    coded_arrow = pa.schema([*list(cut_schema)[:5], *((c, pa.binary()) for c in ("__starts", "__ends", "__counts", "__ids"))])

    def joined(table: pa.Table) -> pa.Table:
        bpe = _bpe(vocabulary)
        rows = sorted(table.to_pylist(), key=lambda r: (r["__part"], r["__piece"]))
        out, at = [], 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end]["__part"] == rows[at]["__part"]:
                end += 1
            level = [(r["__text"], *(np.frombuffer(r[c], np.int32) for c in ("__starts", "__ends", "__counts", "__ids"))) for r in rows[at:end]]
            while len(level) > 1:
                level = [bpe.join_pieces(*level[i : i + 2], rows[at]["__plain"]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            out.append(level[0][4])
            at = end
        return pa.table({"__doc": pa.array([rows[0]["__doc"]], pa.binary()), ids: _as_lists([np.concatenate(out)])})

    # equal long texts are encoded once; the digest brings the ids back to their rows
    digest = F.unhex(F.sha2(column, 256))
    long = df.filter(is_long)
    texts = long.groupBy(digest.alias("__doc")).agg(F.first(column).alias("__text"))
    cut = texts.mapInArrow(pieces, "__doc binary, __part long, __piece long, __text string, __plain boolean, __special int")
    found = cut.repartition("__doc", "__part", "__piece").mapInArrow(code, coded).groupBy("__doc").applyInArrow(joined, f"__doc binary, {quote_ident(ids)} array<int>")
    back = long.select(digest.alias("__doc"), *others).join(found, "__doc").select(*others, quote_ident(ids))
    return whole.unionByName(back)


def token_texts(path: str) -> np.ndarray:
    """The text of each id of a vocabulary, empty where there is none; decoding needs nothing else of it."""
    spec = _spec(path)
    tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return np.array([tokens.get(i, "") for i in range(max(tokens) + 1)], object)


def decoded(batches: Iterator[pa.RecordBatch], vocabulary: str, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches, in slices, with the text of the ids in column ``at`` behind the other columns."""
    texts_of = token_texts(vocabulary)
    release()  # what reading the file took
    for batch in batches:
        for part in _slices(batch, at, DECODED_IDS):
            lists = part.column(at)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            texts = [" ".join(texts_of[flat[a:b]]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``text``: the tokens of ``ids`` joined by a space, as the
    vocabulary without a decoder is decoded, special tokens kept."""
    df = df.drop(text)
    rest = df.columns
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from decoded(batches, vocabulary, at, [*rest, text])

    return df.mapInArrow(released(run), _with(df, text, T.StringType()))
