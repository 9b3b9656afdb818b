"""Times headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Index builds and single queries are timed apart: ``index_build`` includes reading and analysis,
searches run over the index so built, as they do in a service. Each figure is the
second of two runs, the first of which compiles the code; latencies are taken over many queries.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from lexspark import queries as library
from lexspark.operators.index import build_index
from lexspark.operators.search import batch_search, search
from lexspark.sources.documents import synthetic
from lexspark.schema import IndexSchema

HEADLINE = (
    "term_single bool_and bool_or bool_and_not phrase_two phrase_three range_int64 term_and_range boost_query topk_ties batch_search_topk batch_search_benchmark "
    "analyze_tokens postings_build latest_version_resolution segment_merge_equivalence shard_topk_merge eval_ndcg"
).split()


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warehouse = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", warehouse)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    more: dict[str, float] = {}

    profile = library.PROFILES["documents"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    build = lambda: noop(build_index(profile.mutations(docs), profile.schema).postings)
    build()
    took["index_build"] = timed(build)
    more["index_docs_per_s"] = docs.count() / took["index_build"]
    noop(library.index_for(spark, sf_dir, "documents").postings)
    for name in HEADLINE:
        run = lambda name=name: noop(library.QUERIES[name](spark, sf_dir))
        if name != "batch_search_benchmark":  # long enough for its first run to count
            run()
        took[name] = timed(run)

    # The synthetic workload: 5,000 documents of 20 words, 200 single-term queries, k = 10.
    corpus = synthetic(spark, 5000).cache()
    corpus.count()
    index = None

    def build_synthetic() -> None:
        nonlocal index
        index = build_index(corpus, IndexSchema.default()).persist()
        noop(index.postings)
        noop(index.docs)

    took["synthetic_index"] = timed(build_synthetic)
    more["synthetic_docs_per_s"] = 5000 / took["synthetic_index"]
    terms = [f"term{(k * 7919) % 1000}" for k in range(200)]
    spent = sorted(timed(lambda t=t: search(index, t, 10).hits.collect()) for t in terms[:40])
    for p in (50, 95, 99):
        more[f"single_query_p{p}_s"] = spent[int(p / 100 * (len(spent) - 1))]
    batch = {f"q{k}": t for k, t in enumerate(terms)}
    took["synthetic_batch_200"] = timed(lambda: noop(batch_search(index, batch, 10)))
    more["batch_queries_per_s"] = 200 / took["synthetic_batch_200"]

    try:
        from lexspark.llm import queries as llm
    except ImportError:  # the library works without this subpackage
        llm = None
    for name in sorted(llm.QUERIES) if llm else ():
        took[name] = timed(lambda name=name: noop(llm.QUERIES[name](spark, sf_dir)))
    spark.stop()
    shutil.rmtree(warehouse, ignore_errors=True)
    print(
        json.dumps(
            {"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in took.items()}, "sf": os.path.basename(sf_dir), "cpus": int(cpus), "figures": {k: round(v, 4) for k, v in more.items()}}
        )
    )


if __name__ == "__main__":
    main()
