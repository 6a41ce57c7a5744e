"""Seconds of the headline queries, as one line of JSON.

BENCH_SF_DIR: the tables; BENCH_CPUS: threads. Each query is planned, run to its end and thrown away once; vault_N
generates N pages with 12 links each, parses them, resolves names, builds the graph and counts; the largest one
finds the components, too.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = (
    "graph_stats dead_links orphans most_linked degrees by_predicate index_edges_typed backlink_groups components neighbourhood links_depth shortest_path induced_subgraph graph_diff resolve_names markdown_round_trip "
    "rdf_triples predicate_lints bm25 line_matches headings_as_of vector_top rank_fusion similar_texts predicate_language selector vault_history page_history recent_changes snapshots_as_of object_changes sections groundings "
    "hash_prefixes feed_items retention_by_count seen_items access_decisions conclusions theory_conflicts rate_limit html_audit"
).split()


def vault(pages: int, components: bool = False):
    def run(spark: SparkSession, d: str):
        from quillgraph.operators import graph
        from quillgraph.sources.vault import Vault, generate

        v = Vault(generate(spark, pages).repartition(int(os.environ.get("BENCH_CPUS", "8"))))
        return graph.stats(v.edges, v.pages, with_components=components)

    return run


def main() -> None:
    cpus, d = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillgraph import plans

    todo = {n: plans.QUERIES[n] for n in HEADLINE} | {f"vault_{n}": vault(n) for n in (1000, 3000, 10000)} | {"vault_100000": vault(100_000, True)}
    spark.read.parquet(f"{d}/lineitem.parquet").agg(F.sum("l_quantity")).collect()
    took = {}
    for name, query in todo.items():
        began = time.time()
        query(spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
