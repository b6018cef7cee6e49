"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

The read model is built and stored once, as it would be by the scheduled refresh; its build time is
reported beside the queries that read it. Each query's figure is the median of its runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from newsfacts.catalog import extraction  # noqa: E402
from newsfacts.catalog.base import context  # noqa: E402
from newsfacts.operators import extract as ex  # noqa: E402
from newsfacts.operators import facets, listing  # noqa: E402
from newsfacts.operators.filters import FactFilter  # noqa: E402
from newsfacts.session import get_spark  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
LONG = 10.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark("newsfacts-bench", master=f"local[{cpus}]", cores=cpus)
    c = context(spark, sf_dir)
    times: dict[str, float] = {}

    start = time.perf_counter()
    marts = c.marts
    times["refresh_marts"] = time.perf_counter() - start
    start = time.perf_counter()
    contents = c.stored_contents
    times["write_content"] = time.perf_counter() - start
    api, sets = marts.fact_api, marts.fact_api_locations

    places = list(range(1, 201))
    year = {"fromdate": "1997-01-01", "todate": "1998-01-01"}

    def months(end: str) -> FactFilter:
        return FactFilter(fromdate="1997-01-01", todate=end, location_ids=places)

    def page(flt: FactFilter):
        return listing.url_list(
            flt.apply(api, contents), sets, c.analyses.select("gkg_id"), contents, c.validation,
            c.validation_values,
        )

    queries = {
        "timeline_all": lambda: facets.timeline_counts(FactFilter().apply(api)),
        "timeline_year": lambda: facets.timeline_counts(FactFilter(**year).apply(api)),
        "timeline_year_places": lambda: facets.timeline_counts(months("1998-01-01").apply(api)),
        "histogram_all": lambda: facets.histogram_counts(FactFilter().apply(api)),
        "histogram_year": lambda: facets.histogram_counts(FactFilter(**year).apply(api)),
        "histogram_year_places": lambda: facets.histogram_counts(months("1998-01-01").apply(api)),
        "categories_year_places": lambda: facets.counts_by(months("1998-01-01").apply(api), "category"),
        "facets_1_month": lambda: facets.facet_counts(months("1997-02-01").apply(api)),
        "facets_3_months": lambda: facets.facet_counts(months("1997-04-01").apply(api)),
        "facets_6_months": lambda: facets.facet_counts(months("1997-07-01").apply(api)),
        "facets_year": lambda: facets.facet_counts(months("1998-01-01").apply(api)),
        "wordcloud_all": lambda: facets.wordcloud(FactFilter().apply(api), contents),
        "wordcloud_year": lambda: facets.wordcloud(FactFilter(**year).apply(api), contents),
        "wordcloud_year_places": lambda: facets.wordcloud(months("1998-01-01").apply(api), contents),
        "text_count": lambda: facets.fact_count(
            FactFilter(ts="ing", location_ids=places, **year).apply(api, contents)),
        "group_count": lambda: facets.group_count(FactFilter(**year).apply(api)),
        "url_list": lambda: page(months("1998-01-01")),
        "grouped_facts": lambda: listing.grouped_facts(months("1998-01-01").apply(api), sets),
        "map_week": lambda: marts.map_week,
        # Every templated sentence reports something; ordinary text hardly ever does.
        "reports_dense": lambda: ex.reports(
            ex.with_lemmas(ex.tokenise(extraction.sentences(c)), extraction.LEXICON), extraction.LEXICON,
        ).agg(F.count(F.lit(1))),
        "sentences_scanned": lambda: ex.split_sentences(contents).filter(
            ex.may_report(F.col("sentence"), extraction.LEXICON)).agg(F.count(F.lit(1))),
    }
    for name, build in queries.items():
        def once() -> float:
            start = time.perf_counter()
            build().collect()
            return time.perf_counter() - start

        first = once()  # warms up class loading and file listings; a long run is not repeated
        times[name] = first if first > LONG else statistics.median(once() for _ in range(RUNS))
    print(json.dumps({
        "metric": "total seconds of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
