"""Command line: ``python -m tidewire report`` and ``python -m tidewire ingest``."""

from __future__ import annotations

import argparse

from tidewire.plans.report import Selection, ingest_logs, ingest_run_folders, report, save_report
from tidewire.session import get_session
from tidewire.streaming.ingest import ingest_new_logs


def _names(text: str) -> list[str]:
    return [t for t in text.split(",") if t]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewire")
    commands = parser.add_subparsers(dest="command", required=True)
    r = commands.add_parser("report", help="analyse the runs of a scenario")
    r.add_argument("base", help="folder that holds the log roots")
    r.add_argument("scenario")
    r.add_argument("out", help="folder for the result tables")
    r.add_argument("--logs-root", default="logs")
    r.add_argument("--techs", type=_names, default=[])
    r.add_argument("--runs", type=_names, default=[])
    r.add_argument("--window", type=int, default=10)
    r.add_argument("--start-offset", type=int, default=5)
    r.add_argument("--end-offset", type=int, default=5)
    r.add_argument("--individual", action="store_true")
    r.add_argument("--store", default=None, help="metric store folder; stored runs are not opened")
    i = commands.add_parser("ingest", help="parse raw container logs of a run")
    i.add_argument("logs", help="log files, one per container, as a path pattern")
    i.add_argument("out", help="event log folder")
    for name in ("scenario", "tech", "run"):
        i.add_argument(name)
    a = commands.add_parser("ingest-runs", help="parse raw container logs of many runs")
    a.add_argument("base", help="folder that holds the log roots")
    a.add_argument("out", help="event log folder")
    n = commands.add_parser("ingest-new", help="parse the raw container logs that have arrived since the last call")
    n.add_argument("base", help="folder that holds the log roots")
    n.add_argument("out", help="event log folder, written by this command only")
    n.add_argument("checkpoint", help="folder that remembers which logs are in")
    args = parser.parse_args(argv)
    spark = get_session("tidewire")
    if args.command == "ingest":
        ingest_logs(spark, args.logs, args.out, args.scenario, args.tech, args.run)
        return
    if args.command == "ingest-runs":
        ingest_run_folders(spark, args.base, args.out)
        return
    if args.command == "ingest-new":
        ingest_new_logs(spark, args.base, args.out, args.checkpoint)
        return
    selection = Selection(
        args.scenario,
        args.logs_root,
        args.techs,
        args.runs,
        args.window,
        args.start_offset,
        args.end_offset,
        args.individual,
    )
    save_report(report(spark, args.base, selection, args.store), args.out)


if __name__ == "__main__":
    main()
