"""Command line: ``python -m docketlake COMMAND ...``; tables live under one folder as written by ``extract``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import capacity, runs
from .operators.asking import Asking
from .operators.client import ModelClient
from .sources import ingest, staging


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="docketlake")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (
        ("extract", "read records and write the four tables of each source"), ("analysis", "write the combined tables"), ("timeline", "dates by patterns, per project"),
        ("candidates", "date candidates with their sentences"), ("capacity", "generation capacity, per project"),
        ("model-timeline", "timelines by a language model"), ("model-capacity", "capacities by a language model"),
    ):
        one = commands.add_parser(name, help=about)
        one.add_argument("--root", required=True, help="folder of the tables")
        if name == "extract":
            one.add_argument("--records", required=True, help="folder with SOURCE/*/*.jsonl")
            one.add_argument("--sources", nargs="*", default=["EA", "EIS", "CE"])
        elif name == "analysis":
            one.add_argument("--military-ids", help="CSV with project_id")
        else:
            one.add_argument("--sample", type=int)
            one.add_argument("--seed", type=int, default=42)
            one.add_argument("--all", action="store_true", help="not only clean energy")
            if name.startswith("model"):
                one.add_argument("--url", required=True, help="model server")
                one.add_argument("--model", required=True)
                one.add_argument("--workers", type=int, default=4, help="requests at a time in a task")
                one.add_argument("--timeout", type=float, default=120.0)
                one.add_argument("--project-id", help="this project only")
                one.add_argument("--output", help="name of the table")
            if name == "model-timeline":
                one.add_argument("--hybrid", action="store_true", help="classify date candidates instead of reading whole texts")
                one.add_argument("--use-candidates", action="store_true", help="the table of the command candidates")
            if name == "candidates":
                one.add_argument("--maintain", action="store_true", help="read only projects that changed since the last run")
            if name.endswith("capacity"):
                one.add_argument("--source")
            if name == "model-capacity":
                one.add_argument("--settled-too", action="store_true", help="also projects that patterns have settled")
            if not name.endswith("capacity"):
                one.add_argument("--ce-only", action="store_true")
                one.add_argument("--all-docs", action="store_true", help="not only main documents")
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("docketlake").getOrCreate()
    read = lambda name: spark.read.parquet(f"{args.root}/{name}")

    def save(df: DataFrame, name: str) -> None:
        ingest.write_table(df, f"{args.root}/analysis/{name}")

    try:
        _run(args, spark, read, save)
    finally:
        staging.drop(spark)


def _run(args, spark: SparkSession, read, save) -> None:
    if args.command == "extract":
        for source in args.sources:
            ingest.write_tables(ingest.read_corpus(spark, args.records, [source]), args.root, source)
    elif args.command == "analysis":
        military = ingest.read_ids(spark, args.military_ids) if args.military_ids else None
        for name, df in ingest.combined(spark, args.root, military).items():
            save(df, name)
    else:
        _project_runs(args, spark, read, save)


def _project_runs(args, spark: SparkSession, read, save) -> None:
    """The commands that work on projects."""
    projects = read("analysis/projects_combined")
    if args.command == "capacity":
        save(capacity.run_capacity(projects, read("documents"), read("pages"), not args.all, args.sample, args.source), "projects_gencap")
        return
    documents = read("analysis/documents_combined").withColumnRenamed("document_type_category", "category")
    options = runs.Options(args.sample, args.seed, not args.all, getattr(args, "ce_only", False), args.command == "timeline", not getattr(args, "all_docs", True))
    if args.command == "timeline":
        save(runs.run_timelines(projects, documents, read("pages"), options), "projects_timeline")
        return
    if args.command == "candidates":
        if args.maintain:
            runs.maintained_candidates(projects, documents, read("pages"), f"{args.root}/analysis/date_candidates", options)
        else:
            save(runs.date_candidates(projects, documents, read("pages"), options), "date_candidates")
        return
    client = ModelClient(args.url, args.model, args.timeout)
    how = Asking(client, f"{args.model} {client.temperature} {client.most_tokens}", f"{args.root}/replies", args.workers)
    if args.command == "model-capacity":
        found = f"{args.root}/analysis/projects_gencap"
        projects = spark.read.parquet(found) if ingest.exists(spark, found) else projects
        projects = projects.where(projects.dataset_source == args.source.upper()) if args.source else projects
    projects = projects.where(projects.project_id == args.project_id) if args.project_id else projects
    if args.command == "model-capacity":
        made = runs.model_capacities(projects, documents, read("pages"), how, only_unsettled=not args.settled_too, options=options)
        save(made, args.output or "projects_gencap_llm")
    else:
        candidates = read("analysis/date_candidates").where("date is not null") if args.use_candidates else None
        made = runs.model_timelines(projects, documents, read("pages"), how, options, candidates, args.hybrid or args.use_candidates)
        save(made, args.output or "projects_timeline_llm")


if __name__ == "__main__":
    main()
