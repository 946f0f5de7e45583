"""URL filter: rules by host and path, and for the rest a logistic regression
on hashed character n-grams of host and path, trained from a small labelled
URL table.

The training table is a fixed set of example hosts and paths (below); it is
fitted on the driver because it has a few hundred short rows at any input size.
Scoring is one pass over the URLs without a shuffle.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule and gets the model's verdict on empty text, which is to
allow. Rules fit a host and all its subdomains; of the rules that fit, the
longest wins, and of equally long ones a block. Columns with the names of the
new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.words import mix, text_bytes
from tablewright.names import quote_ident

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
#: A URL is blocked from this probability on.
BLOCK = 0.75

# The labelled URL table. Names of unwanted sites (gambling, pills,
# adult, scams, advertising, tracking, piracy, malware) and of ordinary ones, and the paths
# that either are seen with.
UNWANTED = (
    "casino win bets poker slots jackpot lottery pills viagra pharma porn xxx sex adult escort loans payday "
    "free cheap farm spam scam phish ads adserver banner popup track tracker click affiliate warez torrent crack malware virus replica"
).split()
ORDINARY = (
    "news wiki blog docs library museum school university research history garden travel recipes weather science music "
    "books film theatre sport football health hospital city council forum code support law maps art photo "
    "story press radio family village river mountain thread then this that other nation station tion the"
).split()
HOSTS = ("{}", "www.{}", "blog.{}", "m.{}", "{}-{}", "www.{}-{}")
ENDS = ("example.com", "example.net", "example.org")
ORDINARY_PATHS = ("/en/{}", "/de/{}.html", "/es/{}/", "/fr/{}", "/")
UNWANTED_PATHS = ("/ads/{}", "/{}/bonus.html", "/track/{}")


def _hosts(names: Sequence[str]) -> list[str]:
    """Each name in each form, ends in turn, so that form and end tell nothing."""
    return [f"{form.format(w, names[(i * 3 + 1) % len(names)])}.{ENDS[(i + j) % 3]}" for i, w in enumerate(names) for j, form in enumerate(HOSTS)]


def examples() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block): unwanted hosts with ordinary paths, ordinary
    hosts with ordinary paths, and some ordinary hosts with unwanted ones."""
    def path(i: int) -> str:
        return ORDINARY_PATHS[(i * 7 + i // 6) % len(ORDINARY_PATHS)].format(i * 7919 % 60_000)

    good = [(h, path(i), 0) for i, h in enumerate(_hosts(ORDINARY))]
    bad = [(h, path(i), 1) for i, h in enumerate(_hosts(UNWANTED))]
    bad += [(good[(i * 5) % len(good)][0], UNWANTED_PATHS[i % 3].format(w), 1) for i, w in enumerate(UNWANTED)]
    return [*bad, *good]


def _features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram of ^host$ and ^path$."""
    rows, buckets = [], []
    for kind, column in enumerate((hosts, paths)):
        data, offsets = text_bytes(pa.array([f"^{t or ''}$" for t in column.to_pylist()], pa.string()))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        digit = (data >= 48) & (data <= 57)
        codes = np.where(digit, 48, data).astype(np.uint64) + np.uint64(1)  # numbers differ, but mean the same
        for n in SIZES:
            if len(codes) < n:
                continue
            key = np.full(len(codes) - n + 1, kind * 8 + n, np.uint64)
            for k in range(n):
                key = key * np.uint64(257) + codes[k : len(codes) - n + 1 + k]
            inside = row[: len(key)] == row[n - 1 :]
            rows.append(row[: len(key)][inside])
            buckets.append((mix(key[inside]) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(buckets or [np.zeros(0, int)])


def _margins(weights: np.ndarray, bias: float, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    row, bucket = _features(hosts, paths)
    total = np.bincount(row, weights[bucket], minlength=len(hosts))
    return bias + total / np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, float]:
    """Weights and intercept (0), by gradient steps with a fixed rate and a small penalty."""
    table = examples()
    hosts, paths = (pa.array([e[i] for e in table], pa.string()) for i in (0, 1))
    y = np.array([e[2] for e in table], float)
    row, bucket = _features(hosts, paths)
    scale = 1 / np.sqrt(np.bincount(row, minlength=len(y)))
    importance = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0)
    weights, bias = np.zeros(BUCKETS), 0.0  # no intercept: a URL without n-grams is undecided, so allowed
    for _ in range(800):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, weights[bucket], minlength=len(y)) * scale)))
        g = (p - y) * importance / len(y)
        weights -= 30.0 * (np.bincount(bucket, (g * scale)[row], minlength=BUCKETS) + 1e-5 * weights)
    return weights, bias


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The winning rule's text and verdict, null without one. ``rules``: (verdict, ``host/path``)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        own, _, rest = rule.partition("/")
        # names end at a dot, so the dotted host ends in the dotted rule
        fits = F.endswith(F.concat(F.lit("."), host), F.lit(f".{own}")) & F.startswith(path, F.lit(f"/{rest}"))
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def judge(df: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``verdict`` and the model's ``block_score``."""
    added = ("host", "path", "rule", "verdict", "block_score")
    df = df.drop(*added)
    weights, bias = model()
    packed = weights.astype(np.float32)
    host, path = parts(F.col(quote_ident(url)))
    split = df.withColumns({"host": host, "path": path})
    n = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-_margins(packed.astype(float), bias, batch.column(n), batch.column(n + 1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "block_score"])

    scored = split.mapInArrow(run, T.StructType([*split.schema.fields, T.StructField("block_score", T.DoubleType())]))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("block_score") >= BLOCK, "block").otherwise("allow")
    return scored.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_model)}).select(*[F.col(quote_ident(c)) for c in [*df.columns, *added]])
