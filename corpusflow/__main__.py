"""Command line: ``python -m corpusflow list`` and ``python -m corpusflow run QUERY TABLES OUT [--format parquet]``."""

from __future__ import annotations

import argparse

from corpusflow.plans import catalog
from corpusflow.session import build_session


def main(argv: list[str] | None = None) -> None:
    """List the core queries, or write one's result."""
    parser = argparse.ArgumentParser(prog="corpusflow", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(catalog.queries()))
    run.add_argument("tables")
    run.add_argument("out")
    run.add_argument("--format", default="parquet", choices=("parquet", "json", "csv", "orc"))
    args = parser.parse_args(argv)
    if args.command == "list":
        for name, f in sorted(catalog.queries().items()):
            print(f"{name}: {(f.__doc__ or '').splitlines()[0]}")
        return
    spark = build_session()
    catalog.queries()[args.query](spark, args.tables).write.mode("overwrite").format(args.format).option("header", True).save(args.out)


if __name__ == "__main__":
    main()
