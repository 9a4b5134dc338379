"""Command line: ``python -m eddyforge run CONFIG.ini`` and ``check CONFIG.ini``."""

from __future__ import annotations

import argparse
import sys

from .config import describe, load
from .errors import ConfigError, ReadError

#: Generated methods above 8000 bytes are never compiled by the JVM; Spark then runs them expression by expression.
HUGE = "spark.sql.codegen.hugeMethodLimit"
#: Exit codes: done, a configuration that is refused, input that can't be read, anything else.
OK, BAD_CONFIG, BAD_INPUT, FAILED = 0, 2, 3, 1


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def parse(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="eddyforge", description="Flux-tower time series on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="read, compute and write the table")
    r.add_argument("config")
    r.add_argument("--limit", type=positive, help="only the first N periods")
    r.add_argument("--strategy", choices=("arrow", "native"), default="arrow")
    r.add_argument("--on-error", choices=("raise", "quarantine"), default="raise")
    c = sub.add_parser("check", help="print the resolved configuration and read nothing")
    c.add_argument("config")
    return p.parse_args(argv)


def execute(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from .plans import publish, run
    from .sinks import write_csv
    from .sources import read_samples

    cfg = load(args.config)
    for w in cfg.warnings:
        print(f"warning: {w}", file=sys.stderr)
    spark = SparkSession.builder.appName("eddyforge").config("spark.sql.session.timeZone", "UTC").config(HUGE, "8000").getOrCreate()
    periods = run(read_samples(spark, cfg, args.on_error), cfg, args.strategy, args.limit)
    print(f"{write_csv(publish(periods, cfg), cfg)} periods written to {cfg.files.output_csv}")
    return OK


def main(argv: list[str] | None = None) -> int:
    args = parse(argv)
    try:
        if args.command == "check":
            print(describe(load(args.config)))
            return OK
        return execute(args)
    except ConfigError as e:
        print(f"configuration: {e}", file=sys.stderr)
        return BAD_CONFIG
    except ReadError as e:
        print(f"input: {e}", file=sys.stderr)
        return BAD_INPUT
    except Exception as e:  # noqa: BLE001
        print(f"failed: {e}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
