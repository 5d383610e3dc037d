"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

Each query runs once to warm up and then three times into a sink that keeps nothing; the median counts. The two
made tables have the shapes of the baseline's: a million rows of four mixed columns, and a million points.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from scrivane import feature_json, plans, row_json, to_geojson, to_json_array
from scrivane.sources import geometry as G

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["row_json_orders", "row_json_lineitem", "string_escape_documents", "json_array_orders", "json_array_by_customer", "vector_double", "nested_table", "unbox_vectors", "geo_mixed", "feature_collection"]
ROWS = 1_000_000


def made(spark: SparkSession) -> dict:
    n = int(CPUS)
    mixed = spark.range(0, ROWS, 1, n).select(F.col("id").cast("int").alias("id"), F.expr("chr(65 + cast(id % 26 as int))").alias("value"), F.randn(1).alias("val2"), (F.rand(2) > 0.5).alias("log")).cache()
    points = spark.range(0, ROWS, 1, n).select("id", F.rand(3).alias("value"), F.expr("chr(65 + cast(id % 5 as int))").alias("category"), G.point(F.rand(4) * 59 - 125, F.rand(5) * 9 + 40).alias("geometry")).cache()
    mixed.count(), points.count()
    shown = points.select("value", "category", "geometry")
    return {
        "json_1m_rows": lambda: row_json(mixed),
        "json_1m_document": lambda: to_json_array(mixed, "id", ranges=n),
        "geojson_1m_features": lambda: feature_json(shown, "geometry", kinds=["Point"]),
        "geojson_1m_document": lambda: to_geojson(points, "geometry", "id", kinds=["Point"], ranges=n),
    }


def timed(build) -> float:
    runs = []
    for _ in range(4):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - start)
    return round(statistics.median(runs[1:]), 4)


def main() -> None:
    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: timed(lambda q=plans.QUERIES[name]: q(spark, SF_DIR)) for name in HEADLINE}
    times |= {name: timed(build) for name, build in made(spark).items()}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(SF_DIR).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
