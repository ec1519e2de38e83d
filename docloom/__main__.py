"""python -m docloom ROOT [--stage S] [--crate C]... [--limit N] [--store DIR] [--confirm]: ingest pages and, with a store, persist them."""

import argparse

from pyspark.sql import SparkSession

from docloom.plans.pipeline import STAGES, check_options, ingest, rebuild
from docloom.sources.store import KnowledgeBase


def main() -> None:
    parser = argparse.ArgumentParser(prog="docloom")
    parser.add_argument("root")
    parser.add_argument("--stage", choices=STAGES, default="all")
    parser.add_argument("--crate", action="append")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--store")
    parser.add_argument("--confirm", action="store_true", help="replace the store by a limited ingest")
    args = parser.parse_args()
    check_options(args.stage, args.store is not None, args.limit, args.confirm)
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    artifacts = ingest(spark, args.root, args.stage, args.crate, args.limit)
    if args.store:
        print(rebuild(KnowledgeBase(spark, args.store), artifacts))
    else:
        print(artifacts.counts())


if __name__ == "__main__":
    main()
