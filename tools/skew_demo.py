"""How many rows does the busiest task hold when one group is hot?

Derives a skewed entity table from the orders binding (every second row moved
into one country) and compares, for ROW_NUMBER() OVER (PARTITION BY Country
ORDER BY Rating DESC, id):

* native window: rows per window task = rows per Country hash partition;
* distributed positions: rows per range partition of the global sort.

Usage: python tools/skew_demo.py [sf_dir] [partitions]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from scorekit.operators import group_positions  # noqa: E402
from scorekit.session import get_spark  # noqa: E402
from scorekit.sources.bindings import stored  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    parts = int(sys.argv[2]) if len(sys.argv) > 2 else 16
    spark = get_spark("skew-demo", master="local[8]", shuffle_partitions=parts,
                      extra={"spark.sql.adaptive.coalescePartitions.enabled": "false"})
    df = stored(spark, sf_dir, "entities_orders").withColumn(
        "Country", F.when(F.col("id") % 2 == 0, F.lit("HOT")).otherwise(F.col("Country")))
    total = df.count()
    hot = df.filter("Country = 'HOT'").count()
    # native: the window's exchange hash-partitions by Country
    native = (df.repartition(parts, "Country").groupBy(F.spark_partition_id().alias("p"))
                .count().agg(F.max("count")).first()[0])
    out = group_positions(df, ["Country"], [("Rating", "desc"), ("id", "asc")],
                          keep_partition=True)
    per = out.groupBy("_pid").count()
    dist_max = per.agg(F.max("count")).first()[0]
    hot_parts = out.filter("Country = 'HOT'").select("_pid").distinct().count()
    print(f"rows={total} hot_group={hot} partitions={parts}")
    print(f"native window: busiest task holds {native} rows")
    print(f"distributed positions: busiest task holds {dist_max} rows; "
          f"the hot group spans {hot_parts} partitions")


if __name__ == "__main__":
    main()
