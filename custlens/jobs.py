"""Batch entry points for ``spark-submit``.

    spark-submit --py-files custlens.zip custlens/jobs.py build-fact \\
        --sources s3://…/wholesale --fact s3://…/fact --fetch-start 2020-01-01 --fetch-end 2026-12-01
    spark-submit --py-files custlens.zip custlens/jobs.py report --fact s3://…/fact \\
        --out s3://…/reports --start 2023-01-01 --end 2026-12-01 --as-of 2026-12-02 rfm_scores pareto

``--sources`` is a folder of Parquet datasets in source schema (one per table);
``--jdbc-url`` reads the operational database instead: ``--jdbc-option key=value`` for
all tables, ``--jdbc-partition table:column:lower:upper:parts`` for each of orders,
order_lines and packs, and the password from the environment variable named by
``--jdbc-password-env``.  ``--fixture-dir`` maps the supplied test tables.
``refresh-fact`` extends a stored fact to a later (or earlier) fetch range, writing only
the months that new rows fall into.  ``report`` without a source needs a stored fact that
holds all rows of the request and fails otherwise.
Reports are written one folder per report, as Parquet or CSV; ``--drilldown NAME`` adds
the profile, monthly history and category mix of the customer that a name resolves to.
"""

from __future__ import annotations

import argparse
import datetime as dt
import logging
import os

from pyspark.sql import SparkSession

from custlens.catalog import REPORTS
from custlens.config import Params
from custlens.plans.context import Analysis
from custlens.sources.fixture import fixture_sources
from custlens.plans.drilldown import customer_drilldown
from custlens.sources.scans import PARTITION_OPTIONS, jdbc_sources, parquet_sources
from custlens.sources.store import (
    ensure_fact, expire_snapshots, fact_info, refresh_fact, require_covered, write_fact, write_table,
)


log = logging.getLogger(__name__)


def _params(args: argparse.Namespace) -> Params:
    today = dt.date.today().isoformat()
    return Params(
        fetch_start=args.fetch_start, fetch_end=args.fetch_end or today,
        start=args.start, end=args.end or today, as_of=args.as_of or today,
        packed_status=args.packed_status,
        regions=tuple(args.region or ["All"]), shipping_methods=tuple(args.shipping_method or ["All"]),
        customers=tuple(args.customer or ["All"]), top_n=args.top_n,
        min_lineitem_revenue=args.min_lineitem_revenue, churn_threshold=args.churn_threshold,
    )


def jdbc_options(args: argparse.Namespace) -> dict[str, str]:
    """Connection options for all tables; secrets come from the environment."""
    options = dict(kv.split("=", 1) for kv in args.jdbc_option or [])
    if any(k.lower() == "password" for k in options):
        raise SystemExit("give the password in an environment variable (--jdbc-password-env)")
    if any(k in PARTITION_OPTIONS for k in options):
        raise SystemExit("give partitioning per table (--jdbc-partition)")
    if args.jdbc_password_env:
        options["password"] = os.environ[args.jdbc_password_env]
    return options


def jdbc_partitioning(args: argparse.Namespace) -> dict[str, dict[str, str]]:
    """Parallel-read options per table, from ``table:column:lower:upper:parts``.

    Bounds may be times, which hold colons themselves: both have equally many.
    """
    out = {}
    for text in args.jdbc_partition or []:
        table, column, rest = text.split(":", 2)
        bounds, parts = rest.rsplit(":", 1)
        pieces = bounds.split(":")
        half = len(pieces) // 2
        lower, upper = ":".join(pieces[:half]), ":".join(pieces[half:])
        out[table] = dict(zip(PARTITION_OPTIONS, (column, lower, upper, str(int(parts)))))
    return out


def _raw(spark: SparkSession, args: argparse.Namespace):
    if args.fixture_dir:
        return fixture_sources(spark, args.fixture_dir)
    if args.jdbc_url:
        return jdbc_sources(spark, args.jdbc_url, jdbc_options(args), jdbc_partitioning(args))
    if args.sources:
        return parquet_sources(spark, args.sources)
    raise SystemExit("give --sources, --jdbc-url or --fixture-dir")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="custlens.jobs")
    p.add_argument("command", choices=["build-fact", "refresh-fact", "report"])
    p.add_argument("reports", nargs="*", help="report names (default: all)")
    p.add_argument("--sources")
    p.add_argument("--jdbc-url")
    p.add_argument("--jdbc-option", action="append")
    p.add_argument("--jdbc-partition", action="append", metavar="TABLE:COLUMN:LOWER:UPPER:PARTS")
    p.add_argument("--jdbc-password-env", metavar="VARIABLE")
    p.add_argument("--fixture-dir")
    p.add_argument("--fact", required=True)
    p.add_argument("--out")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    p.add_argument("--check", action="store_true", help="read every export back and compare its rows")
    p.add_argument("--fetch-start", default="2020-01-01")
    p.add_argument("--fetch-end")
    p.add_argument("--start", default="2023-01-01")
    p.add_argument("--end")
    p.add_argument("--as-of")
    p.add_argument("--packed-status", default="packed")
    p.add_argument("--region", action="append")
    p.add_argument("--shipping-method", action="append")
    p.add_argument("--customer", action="append")
    p.add_argument("--top-n", type=int, default=50)
    p.add_argument("--min-lineitem-revenue", type=float, default=500.0)
    p.add_argument("--churn-threshold", type=int, default=90)
    p.add_argument("--checkpoint-dir", help="shared folder; default: spark.checkpoint.dir of the session")
    p.add_argument("--drilldown", action="append", metavar="NAME")
    p.add_argument("--since", metavar="DATE", help="refresh-fact: rewrite all months from this date on")
    p.add_argument("--keep-snapshots", type=int, default=2, help="older snapshots of the fact are removed after a write")
    p.add_argument("--rebuild", action="store_true", help="rebuild the fact even if it is stored")
    return p


def _tidy(spark: SparkSession, args: argparse.Namespace) -> None:
    """Shows what the fact holds and removes old snapshots."""
    held = {k: str(v) for k, v in (fact_info(spark, args.fact) or {}).items() if k != "folders"}
    log.info("the fact at %s: %s", args.fact, held)
    expire_snapshots(spark, args.fact, args.keep_snapshots)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"custlens {args.command}").getOrCreate()
    if args.checkpoint_dir:
        spark.sparkContext.setCheckpointDir(args.checkpoint_dir)
    params = _params(args)
    if args.command == "build-fact":
        write_fact(Analysis(spark, params, raw=_raw(spark, args)), args.fact, params)
        _tidy(spark, args)
        return [args.fact]
    if args.command == "refresh-fact":
        since = dt.date.fromisoformat(args.since) if args.since else None
        months = refresh_fact(spark, args.fact, _raw(spark, args), params,
                              lambda raw: Analysis(spark, params, raw=raw), since)
        _tidy(spark, args)
        return [m.isoformat() for m in months]
    if not args.out:
        raise SystemExit("report needs --out")
    if args.sources or args.jdbc_url or args.fixture_dir:
        ensure_fact(
            spark, args.fact, lambda: Analysis(spark, params, raw=_raw(spark, args)), params, rebuild=args.rebuild
        )
    else:
        require_covered(spark, args.fact, params)
    analysis = Analysis.from_store(spark, args.fact, params)
    names = args.reports or sorted(REPORTS)
    unknown = sorted(set(names) - set(REPORTS))
    if unknown:
        raise SystemExit(f"unknown reports: {unknown}")
    if len(names) > 1:
        analysis.store_customers()
    written = []
    for name in names:
        path = f"{args.out.rstrip('/')}/{name}"
        write_table(REPORTS[name](analysis), path, args.format, check=args.check)
        written.append(path)
    if args.drilldown:
        for part, df in customer_drilldown(analysis.filtered, analysis.customers, args.drilldown).items():
            path = f"{args.out.rstrip('/')}/drilldown_{part}"
            write_table(df, path, args.format, check=args.check)
            written.append(path)
    return written


if __name__ == "__main__":
    main()
