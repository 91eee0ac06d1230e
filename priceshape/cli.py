"""``python -m priceshape.cli <job> ...``: the jobs as commands."""

from __future__ import annotations

import argparse

from priceshape.operators.filters import parse_locks
from priceshape.plans import jobs, reports
from priceshape.session import get_session
from priceshape.sources import exports
from priceshape.streaming.refresh import refresh_from_landing


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="priceshape")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for argument in arguments:
            sub.add_argument(argument, required=True)
        return sub

    fetch = command("fetch-dataset", "--folder")
    fetch.add_argument("--output")
    fetch.add_argument("--data-file", action="append", dest="files")
    fetch.add_argument("--current-only", action="store_true")
    load = command("load-full", "--folder", "--store")
    load.add_argument("--data-file", action="append", dest="files")
    load.add_argument("--no-truncate", action="store_false", dest="truncate")
    command("update-current", "--folder", "--store")
    command("sync-metadata", "--folder", "--store")
    command("ensure-schema", "--store")
    command("refresh", "--landing", "--store", "--checkpoint")

    analysing = {
        "compute": command("compute", "--location"),
        "analyze": command("analyze", "--location", "--output-dir"),
        "panel": command("panel", "--location", "--start", "--end", "--export"),
        "metrics-timeseries": command(
            "metrics-timeseries", "--location", "--start", "--end", "--export"
        ),
    }
    for name, sub in analysing.items():
        sub.add_argument("--source", choices=["database", "flatfiles", "snapshot", "document"], default="database")
        sub.add_argument("--data-file", action="append", dest="files")
        sub.add_argument("--current-only", action="store_true")
        sub.add_argument("--include-unselectable", action="store_false", dest="selectable_only")
        sub.add_argument("--series-lock", action="append", default=[])
        sub.add_argument("--min-sample-size", type=int, default=0)
        sub.add_argument("--skip-small-samples", action="store_true")
        if name != "metrics-timeseries":
            sub.add_argument(
                "--group-by",
                choices=["display-level", "item-code-length", "series-name-length"],
                default="display-level",
            )
    analysing["compute"].add_argument("--date")
    analysing["compute"].add_argument("--output")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_session()
    if args.command == "fetch-dataset":
        tables = jobs.fetch_dataset(
            spark, args.folder, args.output, files=args.files, current_only=args.current_only
        )
        reports.volume_summary(tables).show()
    elif args.command == "load-full":
        store = jobs.load_full(
            spark, args.folder, args.store, truncate=args.truncate, files=args.files
        )
        reports.volume_summary(store.read()).show()
    elif args.command == "update-current":
        jobs.update_current(spark, args.folder, args.store)
    elif args.command == "sync-metadata":
        jobs.sync_metadata(spark, args.folder, args.store)
    elif args.command == "ensure-schema":
        jobs.ensure_schema(spark, args.store)
    elif args.command == "refresh":
        refresh_from_landing(spark, args.landing, args.store, args.checkpoint)
    else:
        analyse(spark, args)


def analyse(spark, args: argparse.Namespace) -> None:
    tables = jobs.load_tables(
        spark, args.source, args.location, files=args.files, current_only=args.current_only
    )
    options = {
        "selectable_only": args.selectable_only,
        "min_sample_size": args.min_sample_size,
        "skip_small_samples": args.skip_small_samples,
    }
    if args.command == "metrics-timeseries":
        jobs.export_timeseries(
            tables, args.start, args.end, args.export, args.series_lock, source=args.source,
            **options,
        )
        return
    options["group_by"] = args.group_by
    if args.command == "panel":
        jobs.export_panel(
            tables, args.start, args.end, args.export, args.series_lock, source=args.source,
            **options,
        )
        if args.min_sample_size > 0:
            del options["min_sample_size"]
            reports.panel_warnings(
                tables, args.start, args.end, args.min_sample_size,
                locks=parse_locks(args.series_lock), **options,
            ).show(truncate=False)
    elif args.command == "analyze":
        jobs.export_analysis(tables, args.output_dir, args.series_lock, **options)
    else:
        report = jobs.compute_report(
            tables, args.output, args.series_lock, date=args.date, source=args.source, **options
        )
        report.warnings.show(truncate=False)
        if not args.output:
            locks = parse_locks(args.series_lock)
            for line in exports.summary_text(report.groups, report.header, locks):
                print(line)


if __name__ == "__main__":
    main()
