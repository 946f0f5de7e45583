"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks: the runs of text between block-level tags, each
with the open elements above it (tags, classes and ids) and text features.
The field scores a block's features and neighbouring labels; Viterbi decoding
gives the most likely labelling of the whole page, and the blocks labelled as
content are joined. The field is trained by gradient steps on the exact
likelihood over a fixed set of labelled pages (``examples``, a few dozen short
pages at any input size), on the driver. Extraction is one pass, a page at a time.

White space in a block becomes one space, ``<br>`` included. Unclosed elements
end with their parents; script, style, template and comments have no text.

Defined results: a null or empty page, or one without content, has an empty
text; repeated pages give repeated rows; other columns pass through, but one with the
name of the new text is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# HTML's block-level elements, elements without an end tag, elements whose content is not text,
# and the elements that end when one of the same group begins.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template noscript iframe svg textarea title".split())
ENDS = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")

#: Features and labels.
BUCKETS = 1 << 14
OTHER, CONTENT = 0, 1


class Block:
    """A run of text, the feature buckets of the elements around it, and its share of linked text."""

    __slots__ = ("text", "above", "linked")

    def __init__(self, text: str, above: tuple[int, ...], linked: float):
        self.text, self.above, self.linked = text, above, linked


class _Open:
    """The open elements, with counts in place of searches: each step costs the same at any depth."""

    def __init__(self):
        self.tags: list[str] = []
        self.count: Counter[str] = Counter()
        self.blocks: list[int] = []  # depths of the block-level elements
        self.shown: list[tuple[int, str]] = []  # depth and tag of the elements that give features
        self.given: list[list[str]] = []  # the features that each element gives
        self.active: Counter[str] = Counter()
        self.above: tuple[int, ...] | None = None

    def push(self, tag: str, names: str) -> None:
        depth, given = len(self.tags), []
        self.tags.append(tag)
        self.count[tag] += 1
        if tag in BLOCK:
            self.blocks.append(depth)
        if tag in BLOCK or names:
            self.shown.append((depth, tag))
            given = [f"tag {tag}", *(f"name {w}" for w in set(_WORD.findall(names)))]
            self.active.update(given)
            self.above = None
        self.given.append(given)

    def pop_to(self, depth: int) -> None:
        """Close the elements from this depth on."""
        while len(self.tags) > depth:
            self.count[self.tags.pop()] -= 1
            for f in self.given.pop():
                self.active[f] -= 1
                if not self.active[f]:
                    del self.active[f]
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        while self.shown and self.shown[-1][0] >= depth:
            self.shown.pop()
            self.above = None

    def features(self) -> tuple[int, ...]:
        """Ancestor tags, and the words of their classes and ids; the innermost ones by place too."""
        if self.above is None:
            found = list(self.active)
            if self.shown:
                found.append(f"own {self.shown[-1][1]}")
            found.append(f"pair {' '.join(t for _, t in self.shown[-2:])}")
            self.above = tuple(sorted(map(_bucket, found)))
        return self.above


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks with text, in order. As in HTML, a slash at a tag's end closes nothing."""
    out: list[Block] = []
    open_ = _Open()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, open_.features(), min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    page, at = page or "", 0
    while at < len(page):
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            if open_.count["a"]:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
            if open_.count[tag]:
                depth = len(open_.tags) - 1
                while open_.tags[depth] != tag:
                    depth -= 1
                if open_.blocks and open_.blocks[-1] >= depth:
                    flush()
                open_.pop_to(depth)
            continue
        if tag in BLOCK:
            flush()
            if open_.blocks and open_.tags[open_.blocks[-1]] in ENDS.get(tag, ()):
                open_.pop_to(open_.blocks[-1])
        elif tag == "br":
            parts.append(" ")
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        names = " ".join(x for found in _NAMES.findall(m[3]) for x in found if x).lower()
        if _HIDDEN.search(m[3]):
            names += " hidden"
        open_.push(tag, names)
    flush()
    return out


@lru_cache(maxsize=32)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I)


@lru_cache(maxsize=100_000)
def _bucket(feature: str) -> int:
    return crc32(feature.encode()) % BUCKETS


def features(block: Block) -> tuple[int, ...]:
    text, n = block.text, len(block.text)
    own = (
        f"length {min(n.bit_length(), 9)}",
        f"links {int(block.linked * 4)}",
        f"stops {min(sum(text.count(c) for c in '.!?'), 3)}",
        f"end {text[-1] if text[-1] in '.!?:;,»”' else 'other'}",
        f"sign {next((c for c in '©|·→»' if c in text), 'none')}",
        "all",
    )
    return (*block.above, *(_bucket(f) for f in own))


# The labelled pages. Each frame is a page's layout, with content (+) and other (-) blocks; the
# texts are neutral fillers, so that the field learns from the structure.
_LONG = (
    "The council met on Tuesday to discuss the new plan for the river banks. Several members spoke about the costs, and a vote will follow in spring.",
    "A short remark followed.",
    "Nobody had expected the results, which were published after the winter, and which surprised even the authors of the study in the north.",
    "Et la ville est devenue plus calme, comme les habitants le voulaient depuis des années. Les rues sont vides.",
    "Die Stadt hat den Plan im Herbst beschlossen, und der Rat will im Winter beginnen.",
    "Yes",
)
_SHORT = ("Home", "About us", "Contact", "More stories", "Sign up for our newsletter", "Accept all cookies", "Copyright the authors. All rights reserved.", "I do not agree with this at all, the plan is a mistake. We will see.")
_OTHER_FRAMES = (
    ("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), ("menu", ""), ("dialog", ""),
    *(("div", c) for c in "ad ads advert banner sidebar menu nav navbar navigation breadcrumb header footer cookie cookies consent notice popup modal promo sponsored newsletter subscribe "
      "share social related recommended comments comment replies reply widget login toolbar copyright hidden".split()),
    ("section", "comments"), ("section", "related"), ("ul", "menu"), ("ul", "comments"), ("ol", "comment-list"), ("p", "copyright"), ("div", "reader-comments"), ("div", "cookie-notice"), ("div", "ad-banner"), ("li", "comment"),
)
_CONTENT_FRAMES = (("article", ""), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post"), ("div", "entry"), ("section", ""), ("div", "story"))


def examples() -> list[tuple[str, list[int]]]:
    """(page, label of each block): an article between two other parts, and one inside it."""
    pages = []
    for i, (tag, name) in enumerate(_OTHER_FRAMES):
        outer, outer_name = _CONTENT_FRAMES[i % len(_CONTENT_FRAMES)]
        inner, inner_name = _OTHER_FRAMES[(i * 7 + 3) % len(_OTHER_FRAMES)]

        def other(t: str, c: str, k: int) -> tuple[str, int]:
            texts = [_SHORT[(i + k + j) % len(_SHORT)] for j in range(3)]
            shown = _LONG[(i + k) % len(_LONG)]
            kind = f' class="{c}"' if c else ""
            if k % 3 == 0:
                items = "".join(f'<li><a href="/{j}">{x}</a></li>' for j, x in enumerate(texts))
                return (f"<{t}{kind}>{items}</{t}>", 3) if t in ("ul", "ol") else (f"<{t}{kind}><ul>{items}</ul></{t}>", 3)
            return (f"<{t}{kind}><p>{shown}</p><p>{texts[0]}</p></{t}>", 2) if k % 3 == 1 and t not in ("p", "li") else (f"<{t}{kind}>{shown}</{t}>", 1)

        first, a = other(tag, name, i)
        second, b = other(inner, inner_name, i + 1)
        third, c = other(*_OTHER_FRAMES[(i * 5 + 1) % len(_OTHER_FRAMES)], i + 2)
        paragraphs = [_LONG[(i + j) % len(_LONG)] for j in range(2 + i % 4)]
        extra = ("<h2>Background</h2>", "<blockquote>We had to begin somewhere.</blockquote>", "<ul><li>First point of three</li></ul>", "<pre>x = 1</pre>", "<table><tr><td>1990</td></tr></table>")[i % 5]
        kind = f' class="{outer_name}"' if outer_name else ""
        inside = i % 2 == 0
        body = f"<h1>{_LONG[i % 5][:50]}</h1>" + "".join(f"<p>{'<b>' if j == 0 and i % 3 == 0 else ''}{p}{'</b>' if j == 0 and i % 3 == 0 else ''}</p>" for j, p in enumerate(paragraphs)) + extra
        article = f"<{outer}{kind}>{body}{second if inside else ''}</{outer}>"
        rest = "" if inside else second
        pages.append((f"<html><head><title>{_LONG[i % 5][:50]}</title></head><body>{first}{article}{rest}{third}</body></html>", [OTHER] * a + [CONTENT] * (2 + len(paragraphs)) + [OTHER] * (b + c)))
        # articles may be a line or two
        brief = f"<{outer}{kind}>" + (f"<h1>{_SHORT[i % 4]}</h1>" if i % 3 else "") + f"<p>{_LONG[(1, 5)[i % 2]]}</p></{outer}>"
        pages.append((f"<body>{first}{brief}{third}</body>", [OTHER] * a + [CONTENT] * (2 if i % 3 else 1) + [OTHER] * c))
        # other parts may lie between an article's paragraphs, and be short
        between = f"<{tag}" + (f' class="{name}"' if name else "") + f">{('Buy', 'Read more', _LONG[0])[i % 3]}</{tag}>"
        pages.append((f"<body>{first}<{outer}{kind}><p>{_LONG[1]}</p><p>{_LONG[2]}</p>{between}<p>{_LONG[5]}</p></{outer}></body>", [OTHER] * a + [CONTENT] * 2 + [OTHER, CONTENT]))
    return pages


def _forward_backward(unary: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels and of neighbouring pairs."""
    n = len(unary)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = unary[0]
    for i in range(1, n):
        ahead[i] = unary[i] + np.logaddexp(ahead[i - 1][0] + move[0], ahead[i - 1][1] + move[1])
    for i in range(n - 2, -1, -1):
        nxt = unary[i + 1] + back[i + 1]
        back[i] = np.logaddexp(move[:, 0] + nxt[0], move[:, 1] + nxt[1])
    total = np.logaddexp(*ahead[-1])
    pairs = np.zeros((2, 2))
    for i in range(1, n):
        pairs += np.exp(ahead[i - 1][:, None] + move + (unary[i] + back[i])[None, :] - total)
    return np.exp(ahead + back - total), pairs


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """Weights of features by label, and of neighbouring labels."""
    data = []
    for page, labels in examples():
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"a labelled page has {len(found)} blocks and {len(labels)} labels: {page}")
        data.append(([np.array(features(b)) for b in found], np.array(labels)))
    weights, move = np.zeros((BUCKETS, 2)), np.zeros((2, 2))
    seen, seen_move = np.full((BUCKETS, 2), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(40):
        for feats, labels in data:
            marginal, pairs = _forward_backward(np.array([weights[f].sum(0) for f in feats]), move)
            marginal[np.arange(len(labels)), labels] -= 1
            np.subtract.at(pairs, (labels[:-1], labels[1:]), 1)
            grad = np.zeros_like(weights)
            for f, g in zip(feats, marginal):
                np.add.at(grad, f, g)
            used = np.unique(np.concatenate(feats))
            g = grad[used] + 0.002 * weights[used]
            seen[used] += g * g
            weights[used] -= 0.25 * g / np.sqrt(seen[used])
            seen_move += pairs * pairs
            move -= 0.1 * pairs / np.sqrt(seen_move)
    return weights, move


def decode(unary: np.ndarray, move: np.ndarray) -> list[int]:
    """The most likely labels, by Viterbi; ties go to content."""
    score, came = unary[0], []
    for row in unary[1:]:
        choice = score[:, None] + move
        best = np.where(choice[1] >= choice[0], 1, 0)
        came.append(best)
        score = row + choice[best, [0, 1]]
    label = int(score[1] >= score[0])
    out = [label]
    for best in reversed(came):
        label = int(best[label])
        out.append(label)
    return out[::-1]


def main_text(page: str | None, weights: np.ndarray, move: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    labels = decode(np.array([weights[list(features(b))].sum(0) for b in found]), move)
    return "\n".join(b.text for b, label in zip(found, labels) if label == CONTENT)


def extract(df: DataFrame, column: str = "html", text: str = "text") -> DataFrame:
    """``df`` with the main text of ``column`` as ``text``; ``column`` itself is dropped."""
    df = df.drop(text) if text != column else df
    rest = [f for f in df.schema.fields if f.name != column]
    at = df.columns.index(column)
    weights, move = model()
    used = np.flatnonzero(weights.any(1))
    small = used, weights[used], move
    out = [*(f.name for f in rest), text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros((BUCKETS, 2))
        full[small[0]] = small[1]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(x, full, small[2]) for x in part.column(at).to_pylist()]
                columns = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=out)

    return df.mapInArrow(run, T.StructType([*rest, T.StructField(text, T.StringType())]))
