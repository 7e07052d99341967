"""python -m factloom QUERY TABLES [--out FOLDER]: runs a query of the catalogue over a folder of tables."""

import argparse

from pyspark.sql import SparkSession

from factloom.plans.queries import QUERIES


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="factloom", description=main.__doc__)
    parser.add_argument("query", choices=sorted(QUERIES))
    parser.add_argument("tables", help="the folder of the tables")
    parser.add_argument("--out", help="a folder for the result, as Parquet; else its first rows are shown")
    given = parser.parse_args(arguments)
    result = QUERIES[given.query](SparkSession.builder.getOrCreate(), given.tables)
    if given.out:
        result.write.mode("overwrite").parquet(given.out)
    else:
        result.show(truncate=False)


if __name__ == "__main__":
    main()
