"""The registered queries: each operator over its whole table, by the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontaminate, fill_middle, html_text, jaccard_join, license_scan, line_dedup, nearest, periodic_runs, quality, suffix_dedup, url_filter, warc
from tablewright.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


#: A document is kept if label 1 has at least this probability.
KEEP_SCORE = 0.3


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = suffix_dedup.deduplicate_bytes(docs)
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    records = warc.read(spark, path)

    def page(name: str) -> Column:
        return F.regexp_extract(name, "^<urn:page:(.*)>$", 1).try_cast("long")

    return records.select(
        page("record_id").alias("page_id"),
        F.coalesce("stated_length", "length").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicate_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"), n=3, percent=90)


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    ids = bpe.encode(docs.select("doc_id", "text"), vocabulary)
    return bpe.decode(ids, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    formed = fill_middle.fill_in_middle(docs)
    return formed.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; in a tenth of the documents, by id, the words from some place on become
    repetitions of the first of them."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    split = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    # each step is a column of its own, so that it is computed once
    df = docs.select("doc_id", "text", g.alias("g"), split.alias("w"))
    df = df.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    df = df.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    copies = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), copies)), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return df.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(with_planted_runs(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.select("doc_id", "runs", "collapsed", longest.alias("longest"), F.array_join(lines, "").alias("lines"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.expr("(1000 * longest.length) div (-longest.p)").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs, license_scan.templates(spark))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_html_text": op4_html_text,
    "op5_warc": op5_warc,
    "op6_line_dedup": op6_line_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_url_filter": op8_url_filter,
    "op9_nearest": op9_nearest,
    "op10_bpe": op10_bpe,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_license_scan": op13_license_scan,
}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words_sql(table_name: str, key: str, pattern: str) -> str:
    return f"SELECT {key}, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{pattern}') AS w FROM {table_name}"


_DECONTAMINATE_SQL = f"""
WITH items AS ({_words_sql("benchmark", "item_id", decontaminate.WORD)}),
docs AS ({_words_sql("documents", "doc_id", decontaminate.WORD)}),
spans AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM spans),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM
    (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) AS lengths)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, n >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY d) AS again, max(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
    CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN m END AS refers_to FROM q
"""

_JACCARD_SQL = f"""
WITH RECURSIVE docs AS ({_words_sql("documents", "doc_id", "[^ " + chr(92) + "x09-" + chr(92) + "x0D]+")}),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 90 * (x.n + y.n - s.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lows AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN lows USING (doc_id)
"""

_FILL_IN_MIDDLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p
"""

# Runs by equal stretches of five words at a distance q, which every run holds.
_PERIODIC_SQL = """
WITH split AS (SELECT doc_id, row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), '') AS k, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents),
steps AS (SELECT *, flatten(list_transform(range(1, length(k) + 1), lambda i: list_concat([CAST(unicode(k[i:i]) AS BIGINT)], list_transform(range(8), lambda j: -1)))) AS o FROM split),
crc AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], o),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS h, len(w) AS n FROM steps),
tails AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM crc),
planted AS (SELECT doc_id, r, n, a, w, 1 + (n - a) // (3 + g % 8) AS p FROM tails),
words AS (SELECT doc_id, r, n, list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[1 + a + (i - a) % p] END) AS w FROM planted),
grams AS (SELECT r, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT r, w, unnest(range(n - 4)) AS i FROM words WHERE n >= 6)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, q, min(i) AS x, count(*) + 4 + q AS l FROM islands GROUP BY r, q, island),
runs AS (SELECT r, x, l, min(q) AS q FROM stretches WHERE l >= 4 * q AND l >= 6 GROUP BY r, x, l),
dropped AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(x + q, x + l)) AS i FROM runs) GROUP BY r),
best AS (SELECT r, count(*) AS n_runs, max(struct_pack(l := l, x := -x, q := -q)) AS m,
    string_agg(x || ',' || l || ',' || q || chr(10), '' ORDER BY x, q) AS lines FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(-m.x AS BIGINT) AS start, CAST(m.l AS BIGINT) AS length, CAST(-m.q AS BIGINT) AS period,
    CAST(1000 * m.l // -m.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM words LEFT JOIN best USING (r) LEFT JOIN dropped USING (r)
"""

_TEMPLATES_SQL = ", ".join(
    f"('{label}', '{words}', {base}, {whole})"
    for group, base, whole in ((license_scan.BASE, True, True), (license_scan.VARIANTS, False, True), (license_scan.NOTICES, False, False))
    for label, words in group
)

_LICENSE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, * FROM ({_words_sql("documents", "doc_id", license_scan.WORD)})),
templates AS (SELECT row_number() OVER () AS t, *, string_split(words, ' ') AS v, len(string_split(words, ' ')) AS n FROM (VALUES {_TEMPLATES_SQL}) AS x(label, words, base, whole)),
phrases AS (SELECT r, label, base, i AS first, 1.0 AS share FROM
    (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS words FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM templates WHERE whole))) JOIN templates USING (n, words) WHERE whole),
own AS (SELECT t, label, n, j, array_to_string(v[j + 1:j + 4], ' ') AS g FROM (SELECT t, label, n, v, unnest(range(n - 3)) AS j FROM templates WHERE NOT whole)),
grams AS (SELECT r, i, array_to_string(w[i + 1:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(len(w) - 3)) AS i FROM docs)),
hits AS (SELECT r, t, label, n, i, j, i - j AS d, lag(i - j) OVER (PARTITION BY r, t ORDER BY i - j, j) AS d0 FROM grams JOIN own USING (g)),
copies AS (SELECT *, sum(CASE WHEN d - d0 > {license_scan.SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY r, t ORDER BY d, j) AS copy FROM hits),
covered AS (SELECT r, t, copy, label, n, count(DISTINCT j + k) / n AS of_notice, count(DISTINCT i + k) / (max(i + k) - min(i) + 1) AS of_span, min(i) AS first
    FROM copies, range(4) AS x(k) GROUP BY r, t, copy, label, n),
spans AS (SELECT * FROM phrases UNION ALL SELECT r, label, false, first, least(of_notice, of_span) FROM covered WHERE least(of_notice, of_span) >= {license_scan.SHARE}),
found AS (SELECT r, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
    list_sort(list(DISTINCT label) FILTER (base)) AS base_labels, list_sort(list(DISTINCT label)) AS labels, max(share) AS score FROM spans GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
    coalesce(array_to_string(labels, ','), '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM docs LEFT JOIN found USING (r)
"""


def oracles() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL expresses; tests hold the others against brute force,
    the library or held-out labels."""
    return {"op1_decontaminate": _DECONTAMINATE_SQL, "op5_warc": _WARC_SQL, "op7_jaccard_join": _JACCARD_SQL, "op11_fill_in_middle": _FILL_IN_MIDDLE_SQL, "op12_periodic_runs": _PERIODIC_SQL, "op13_license_scan": _LICENSE_SQL}
