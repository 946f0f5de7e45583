"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every text is a sequence of words. A k-gram hash is computed at each word
position, and of each run of ``WINDOW - k + 1`` positions the smallest hash is
kept as a fingerprint, in documents and benchmark items alike. Two texts that
share ``WINDOW`` consecutive words share such a run, so they share
its fingerprint: no shared span of that length is missed. Fingerprints
are joined, and each hit is extended and checked on the words themselves.
Items shorter than a window are found by the k-grams of their own length.

The item side is broadcast when a count shows it within
``BROADCAST_FINGERPRINTS`` rows, else joined by shuffle. Only documents with
a joined fingerprint go on to the exact step, and there only positions at the
item's shared fingerprints.

Defined results: null and empty texts have no words, are never contaminated
and match nothing; repeated rows are judged each by itself; repeated items count
as often as their ids differ. Columns with the names of the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import keep
from tablewright.names import quote_ident

WINDOW = 13
GRAM = 8
#: Contaminated from one word in so many on.
SHARE = 20
BROADCAST_FINGERPRINTS = 200_000
#: Texts with a shared fingerprint up to this count are broadcast by digest, else joined by shuffle.
BROADCAST_TEXTS = 100_000
# Fixed value: a word is a run of characters that are neither ASCII signs nor white space nor control characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words, as an array; empty for null."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), NOT_WORD), "")


def _over_runs(df: DataFrame, name: str, n: int, of_two: Callable[[Column, Column], Column]) -> DataFrame:
    """Array ``name`` with one value for each ``n`` neighbours, made of the values of two shorter runs that
    cover them, so that the steps grow with the logarithm of ``n``; empty if there are fewer.
    Each step is a column of its own, as an expression used twice would be computed twice."""
    have = 1
    while have < n:
        step = min(have, n - have)
        count = F.greatest(F.size(name) - step, F.lit(0))
        df = df.withColumn(name, F.zip_with(F.slice(name, F.lit(1), count), F.slice(name, F.lit(1 + step), count), of_two))
        have += step
    return df


def _size(n: int) -> tuple[int, int]:
    """Gram size and run of positions for spans of n words."""
    k = min(GRAM, n)
    return k, n - k + 1


def _with_grams(df: DataFrame, n: int) -> DataFrame:
    """``df`` with the gram hashes of ``w`` as ``grams``. Each step is a column of
    its own, as an expression used inside a lambda would be computed at each position;
    the rows are spread by explode_outer, as explode would push a filter on its array
    down through these columns and so into the lambdas."""
    k, _ = _size(n)
    hashed = df.withColumn("grams", F.transform("w", lambda w: F.xxhash64(w)))
    return _over_runs(hashed, "grams", k, lambda a, b: F.xxhash64(a, b))


def _with_fingerprints(df: DataFrame, n: int) -> DataFrame:
    """``df`` with the smallest of each run of neighbouring gram hashes as ``prints``, once each."""
    smallest = _over_runs(_with_grams(df, n), "grams", _size(n)[1], lambda a, b: F.least(a, b))
    return smallest.withColumn("prints", F.array_distinct("grams")).drop("grams")


def _places(df: DataFrame, n: int) -> DataFrame:
    """A row per position of ``w`` whose gram is among ``prints``: ``at, print, near``,
    the words from n - k before the gram to n - k after it; ``w`` and ``prints`` go."""
    k, run = _size(n)
    numbered = F.transform("grams", lambda g, at: F.struct(at.alias("at"), g.alias("print")))
    found = _with_grams(df, n).withColumn("p", F.filter(numbered, lambda g: F.array_contains(F.col("prints"), g["print"])))
    around = F.sequence(F.lit(1 - run), F.lit(k + run - 2))
    near = F.transform("p", lambda g: F.struct(g["at"].alias("at"), g["print"].alias("print"), F.transform(around, lambda o: F.get(F.col("w"), g["at"] + o)).alias("near")))
    rest = [c for c in df.columns if c not in ("w", "prints")]
    return found.withColumn("p", near).select(*rest, F.explode_outer("p").alias("p")).filter("p is not null").select(*rest, "p.at", "p.print", "p.near")


def _spans(hits: DataFrame, n: int) -> DataFrame:
    """Extend each joined gram over the equal words around it; keep the runs of n words and more."""
    k, run = _size(n)
    same = [F.get("near", F.lit(i)) == F.get("item_near", F.lit(i)) for i in range(k + 2 * (run - 1))]
    left = right = F.lit(0)
    for i in range(run - 1):
        left = F.when(same[i], left + 1).otherwise(0)
        right = F.when(same[-1 - i], right + 1).otherwise(0)
    equal = same[run - 1]
    for c in same[run : run - 1 + k]:
        equal = equal & c
    found = hits.filter(equal).withColumns({"left": left, "right": right}).filter(F.col("left") + F.col("right") + k >= n)
    return found.select("digest", "item_id", F.struct((F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.col("right") + (k - 1)).alias("last")).alias("span"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``n_words, n_hit, item_ids, spans, contaminated``.

    ``spans`` are the merged hit runs of words as (first, last) positions;
    ``item_ids`` the items with an occurring window, as sorted strings.
    """
    added = ("n_words", "n_hit", "item_ids", "spans", "contaminated")
    docs = docs.drop(*added)
    column = F.col(quote_ident(text))
    item_words = items.select(F.col(quote_ident(item_id)).cast("string").alias("item_id"), words_of(column).alias("w")).filter(F.size("w") > 0)
    item_words = keep(item_words.withColumn("n", F.least(F.size("w"), F.lit(WINDOW))), "decontaminate")
    lengths = sorted(r.n for r in item_words.select("n").distinct().collect())  # at most WINDOW values
    digest = F.unhex(F.sha2(F.coalesce(column, F.lit("")), 256))
    found = _found(docs.select(digest.alias("digest"), column.alias("text")), item_words, lengths) if lengths else None

    # regexp_count gives the same number, but took more than ten times as long
    rows = docs.withColumns({"n_words": F.size(words_of(column)).cast("long"), "__digest": digest})
    if found is None:
        empty = {"n_hit": F.lit(0).cast("long"), "item_ids": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<first:int,last:int>>")}
        joined = rows.withColumns(empty)
    else:
        # the few texts with a hit meet their rows by digest; the others never move
        hit_count = found.count()
        own = found.withColumnRenamed("digest", "__digest")
        joined = rows.join(F.broadcast(own) if hit_count <= BROADCAST_TEXTS else own, "__digest", "left")
        joined = joined.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>")), "spans": F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>"))})
    judged = joined.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))
    return judged.select(*[F.col(quote_ident(c)) for c in [*docs.columns, *added]])


def _found(docs: DataFrame, item_words: DataFrame, lengths: list[int]) -> DataFrame:
    """``digest, n_hit, item_ids, spans`` of each text with an occurring window."""
    item_prints = None
    for n in lengths:
        own = _with_fingerprints(item_words.filter(F.col("n") == n).select("item_id", "w"), n)
        places = _places(own, n).select(F.lit(n).alias("n"), "item_id", "print", F.col("near").alias("item_near"))
        item_prints = places if item_prints is None else item_prints.unionByName(places)
    item_prints = keep(item_prints.distinct(), "decontaminate")
    wanted = item_prints.select("n", "print").distinct()
    small = item_prints.count() <= BROADCAST_FINGERPRINTS

    def of_items(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    # 1: join fingerprints, to find the texts that share one
    with_words = docs.select("digest", words_of(F.col("text")).alias("w"))
    each = None
    for n in lengths:
        own = _with_fingerprints(with_words, n).select("digest", F.lit(n).alias("n"), F.explode_outer("prints").alias("print"))
        each = own if each is None else each.unionByName(own)
    shared = each.join(of_items(wanted), ["n", "print"]).groupBy("digest", "n").agg(F.collect_set("print").alias("prints"))
    shared = keep(shared, "decontaminate")

    # 2: their words around the shared fingerprints, one text per digest
    n_texts = shared.count()
    texts = docs.join(F.broadcast(shared) if n_texts <= BROADCAST_TEXTS else shared, "digest")
    texts = texts.groupBy("digest", "n").agg(F.first("text").alias("text"), F.first("prints").alias("prints"))
    texts = texts.select("digest", "n", "prints", words_of(F.col("text")).alias("w"))

    # 3: extend and check each hit on the words
    spans = None
    for n in lengths:
        places = _places(texts.filter(F.col("n") == n).select("digest", "prints", "w"), n)
        own = _spans(places.join(of_items(item_prints.filter(F.col("n") == n)), "print"), n)
        spans = own if spans is None else spans.unionByName(own)
    per_text = spans.groupBy("digest").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sort_array(F.collect_set("span")).alias("raw"))
    start = F.array().cast("array<struct<first:int,last:int>>")

    def add(merged: Column, span: Column) -> Column:
        before = F.get(merged, F.size(merged) - 1)
        meets = F.coalesce(span["first"] <= before["last"] + 1, F.lit(False))
        longer = F.struct(before["first"].alias("first"), F.greatest(before["last"], span["last"]).alias("last"))
        return F.when(meets, F.concat(F.slice(merged, 1, F.size(merged) - 1), F.array(longer))).otherwise(F.concat(merged, F.array(span)))

    merged = per_text.select("digest", "item_ids", F.aggregate("raw", start, add).alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"] + 1)
    return keep(merged.select("digest", n_hit.alias("n_hit"), "item_ids", "spans"), "decontaminate")
