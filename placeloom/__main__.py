"""python -m placeloom COMMAND: extract, subset, parse, align, denoise, report, check, serve."""

from __future__ import annotations

import argparse
import json
import sys

from .plans import place_pipeline as P
from .sources import archives, settings


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="placeloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("parse", "align", "denoise", "report", "check"):
        sub.add_parser(name).add_argument("--config")
    one = sub.add_parser("extract")
    one.add_argument("zip")
    one.add_argument("folder")
    one.add_argument("--photos-zip")
    one.add_argument("--photos", action="store_true")
    one.add_argument("--tasks", action="store_true", help="read the archives in ranges by Spark tasks; the folder must be one that all workers see")
    one = sub.add_parser("subset")
    one.add_argument("raw")
    one.add_argument("out")
    one.add_argument("--max-businesses", type=int)
    one.add_argument("--reviews", type=int, default=5)
    one.add_argument("--include-closed", action="store_true")
    one = sub.add_parser("serve")
    one.add_argument("--catalog")
    one.add_argument("--port", type=int, default=8000)
    args = parser.parse_args(argv)
    if args.command == "extract" and not args.tasks:
        print(json.dumps(archives.extract_all(args.zip, args.folder, args.photos_zip, args.photos), indent=2))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("placeloom").getOrCreate()
    if args.command == "extract":
        from .sources import archive_tables

        result = archive_tables.extract_all(spark, args.zip, args.folder, args.photos_zip, args.photos)
    elif args.command == "subset":
        result = P.prepare_subset(spark, args.raw, args.out, args.max_businesses, args.reviews, args.include_closed)
    elif args.command == "serve":
        from .service import Service, serve

        serve(Service(spark, args.catalog), port=args.port).serve_forever()
        return 0
    else:
        from .operators.contract import check_outputs

        config = settings.load(args.config)
        result = {"parse": lambda: P.run_parse(spark, config), "align": lambda: P.run_alignment(spark, config), "denoise": lambda: P.run_denoising(spark, config), "report": lambda: {"report_path": P.run_report(config)}, "check": lambda: check_outputs(spark, config)}[args.command]()
    print(json.dumps(result, indent=2, default=str, ensure_ascii=False))
    return int(args.command == "check" and result["status"] != "ok")


if __name__ == "__main__":
    sys.exit(main())
