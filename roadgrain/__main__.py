"""Read the four tables and write the report.

    python -m roadgrain CRASHES PEOPLE VEHICLES FATALITIES OUT_DIR [csv|parquet]
    PYTHONPATH=. spark-submit roadgrain/__main__.py CRASHES ... (on a cluster)
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from roadgrain.plans.report import write_report
from roadgrain.sources.tables import Tables, load_tables


def main(args: list[str]) -> None:
    *paths, out_dir, fmt = args if len(args) == 6 else [*args, "csv"]
    spark = (
        SparkSession.builder.appName("roadgrain")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    tables = load_tables(spark, dict(zip(Tables._fields, paths, strict=True)), fmt)
    for name, path in write_report(tables, out_dir).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main(sys.argv[1:])
