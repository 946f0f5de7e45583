"""Scaling check: do the keyed operators grow linearly with the data?

Usage: python tools/scaling.py [sf_dir] [factors]   (default /root/testdata/sf0.1 "1,4,16")

For each factor k, Spark derives k copies of ``documents`` and ``events``
(rows replicated with ``explode(sequence(...))``, ids made unique, texts and
user ids kept, so every text and user gets k times the rows) and writes them
once, as many files, to a fresh scratch folder. Then it times dedup, latest
per key, the manifest and per-row hashing on each copy through the ``noop``
sink, and prints one JSON line per factor. The ``*_hot`` timings repeat dedup
and latest per key with a third of all rows moved onto one key.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from tablewright.functions import sha256_hex  # noqa: E402
from tablewright.operators import deduplicate, latest_per_key, manifest  # noqa: E402
from tablewright.session import local_session  # noqa: E402


def replicate(df, k: int, id_col: str):
    copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return copies.withColumn(id_col, F.col(id_col) * k + F.col("_copy")).drop("_copy")


def timed(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    factors = [int(x) for x in (sys.argv[2] if len(sys.argv) > 2 else "1,4,16").split(",")]
    spark = local_session(8, 64)
    scratch = tempfile.mkdtemp(prefix="tw-scaling-")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in factors:
        files = 8 * k
        replicate(docs, k, "doc_id").repartition(files).write.parquet(f"{scratch}/documents_x{k}")
        replicate(events, k, "event_id").repartition(files).write.parquet(f"{scratch}/events_x{k}")
        d = spark.read.parquet(f"{scratch}/documents_x{k}")
        e = spark.read.parquet(f"{scratch}/events_x{k}")
        hot_text = F.when(F.col("doc_id") % 3 == 0, F.lit("one hot text " * 100)).otherwise(F.col("text"))
        d_hot = d.withColumn("text", hot_text)
        e_hot = e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
        best = {}
        for name, make in (
            ("dedup_documents", lambda: deduplicate(d, ["text"], ["doc_id"])),
            ("latest_per_key", lambda: latest_per_key(e, ["user_id"], ["ts", "event_id"])),
            ("manifest_documents", lambda: manifest(d, ["source"], "text")),
            ("row_sha256", lambda: d.select("doc_id", sha256_hex("text").alias("sha256"))),
            ("dedup_documents_hot", lambda: deduplicate(d_hot, ["text"], ["doc_id"])),
            ("latest_per_key_hot", lambda: latest_per_key(e_hot, ["user_id"], ["ts", "event_id"])),
        ):
            best[name] = min(timed(make()) for _ in range(2))
        print(json.dumps({"factor": k, "documents": d.count(), "events": e.count(), "seconds": best}))
    spark.stop()


if __name__ == "__main__":
    main()
