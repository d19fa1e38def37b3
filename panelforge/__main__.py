"""Command line: python -m panelforge [--sync | --landed FOLDER | --status] [options].

Without a flag the sample data is loaded. A folder of landed responses holds constituents.json (at,
code, name, exchange), bars/<ts_code>_<part>.json and, if any, pages/ (ts_code, html as JSON)."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession

from .plans import sync
from .sources import landed
from .sources.tables import Warehouse


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="panelforge", description="Load and synchronise the warehouse.")
    p.add_argument("--sync", action="store_true", help="bring the warehouse up to the day")
    p.add_argument("--years", type=int, default=5, help="years of history that a sync keeps (5)")
    p.add_argument("--sample", action="store_true", help="load the sample data (the default)")
    p.add_argument("--landed", "--real", "--online", dest="landed", nargs="?", const="landed", metavar="FOLDER", help="load landed responses")
    p.add_argument("--stocks", type=int, default=300, help="number of stocks (300)")
    p.add_argument("--status", action="store_true", help="row counts only")
    p.add_argument("--db", default="warehouse", help="folder of the warehouse")
    p.add_argument("--as-of", help="yyyyMMdd that stands for today")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parse(argv)
    spark = spark or SparkSession.builder.appName("panelforge").getOrCreate()
    w, out = Warehouse(spark, args.db), {}
    w.restore(f"{args.db}.gz")
    if args.status:
        pass
    elif args.sync:
        out = sync.sync(spark, w, args.years, args.stocks, datetime.strptime(args.as_of, "%Y%m%d").date() if args.as_of else None)
    elif args.landed:
        pages = f"{args.landed}/pages"
        fs, p = w._fs(pages)
        found = spark.read.schema("ts_code string, html string").json(pages) if fs.exists(p) else None
        listed = spark.read.schema("at int, code string, name string, exchange string").json(f"{args.landed}/constituents.json")
        sync.landed_load(spark, w, listed, landed.read_answers(spark, f"{args.landed}/bars"), args.stocks, found)
    else:
        sync.sample_load(spark, w, args.stocks)
    out["rows"] = {r["table_name"]: r["n_rows"] for r in w.counts().collect()}  # four rows
    print(out)
    return out


if __name__ == "__main__":
    main()
