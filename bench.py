"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from galley import checks
from galley.session import build_session

HEADLINE = [
    "keywords_top5", "tokenize_docs", "stopword_ratio", "ngrams_1_6_top", "tf_l2_norm_check", "tfidf_topk",
    "required_boost", "bm25_excerpt", "keyphrases_mmr", "segment_cjk", "blocklist_content", "outbound_links",
    "new_links", "pagination_reach", "select_one_title", "article_text", "article_html", "article_markdown",
    "image_manifest", "date_parse", "slug_titles", "front_matter_toml", "article_job",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false",
           "spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    checks.load_all()
    names = sys.argv[1:] or HEADLINE
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start-up is not measured
    seconds = {}
    for name in names:
        start = time.perf_counter()
        checks.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
