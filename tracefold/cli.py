"""``python -m tracefold.cli COMMAND ...``: the commands of a store from a shell."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracefold import config, queries
from tracefold.operators import analysis, filters, masking, matching, openapi, report, search, store, timestamps, tracing, views
from tracefold.plans.sql import render, run_query
from tracefold.sources import sinks


def find_store(path: str | None) -> str:
    """The store directory: as given, or the only one below the current folder."""
    if path:
        return path
    here = [d for d in sorted(os.listdir(".")) if os.path.exists(os.path.join(d, "entries.parquet"))]
    if len(here) != 1:
        raise SystemExit("name a store: " + (", ".join(here) or "none found here"))
    return here[0]


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


class Job:
    """The tables of a store and the flags of a command."""

    def __init__(self, flags: argparse.Namespace):
        self.flags, self.settings = flags, config.settings()
        self.spark = session()
        self.path = find_store(flags.store)
        self.at = store.Store(self.spark, self.path)

    def __getattr__(self, name: str) -> DataFrame:
        if name in store.SCHEMAS:
            return self.at.table(name)
        raise AttributeError(name)

    def zones(self) -> DataFrame:
        return self.imports.select("id", timestamps.zone_of("log_extensions").alias("zone")).withColumnRenamed("id", "import_id")

    def chosen(self) -> DataFrame:
        """Entries that the filter flags leave."""
        f = self.flags
        e = filters.EntryFilter(hosts=f.host, methods=f.method, statuses=f.status, url_contains=f.url_contains, url_regex=f.url_regex, since=f.since, until=f.until).apply(self.entries)
        return filters.from_sources(e, self.imports, f.source) if f.source else e

    def show(self, df: DataFrame) -> None:
        f = self.flags
        if f.offset:
            df = df.offset(f.offset)
        if f.limit is not None:
            df = df.limit(f.limit)
        print(render(df.columns, df.toLocalIterator(), f.format), end="")

    def write(self, text: str) -> None:
        if self.flags.out:
            with open(self.flags.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)


def _import(job: Job) -> None:
    from tracefold.sources.har import load

    s, f = job.settings["import"], job.flags
    job.show(load(job.spark, f.args, job.path, f.incremental or s["incremental"], f.resume or s["resume"], max_body=filters.parse_size(s["max_body"]), text_only=s["text_only"], decompress=True, keep=[p.split() for p in f.filter_plugin], change=[p.split() for p in f.transform_plugin]))


def _watch(job: Job) -> None:
    from tracefold.sources.har import load
    from tracefold.streaming import watch

    s = job.settings["watch"]
    watch(job.spark, job.flags.args[0], f"{job.path}/.watched", lambda paths, _: load(job.spark, paths, job.path, True), False, s["debounce_ms"], s["stable_ms"], s["recursive"], lambda paths: job.show(analysis.store_stats(job.entries, job.imports, job.blobs))).awaitTermination()


def _export(job: Job) -> None:
    kind = job.flags.args[0] if job.flags.args else job.settings["export"]["format"]
    if kind == "har":
        sinks.write_capture(job.chosen(), job.pages, job.flags.out, job.blobs, job.flags.pretty)
        return
    {"csv": sinks.write_csv, "jsonl": sinks.write_jsonl, "parquet": sinks.write_parquet}[kind](sinks.tabular(job.chosen()), job.flags.out)


def _redact(job: Job) -> None:
    s, f = job.settings["redact"], job.flags
    what = masking.chosen(f.header, f.cookie, f.param, f.body, s["match"], s["defaults"])
    if f.dry_run:
        job.show(masking.redaction_report(job.entries, what, s["token"], s["match"]))
        return
    if not (f.out or f.force):
        raise SystemExit("give --out for a redacted copy, or --force to change the store itself")
    e, b = masking.redact_entries(job.entries, what, s["token"], s["match"]), job.blobs
    if what["bodies"]:
        e, b = masking.redact_bodies(e, b, what["bodies"], s["token"])
    to = store.Store(job.spark, f.out) if f.out else job.at
    for name, df in {"entries": e, "blobs": b, **({n: job.at.table(n) for n in ("imports", "pages", "graphql_fields")} if f.out else {})}.items():
        to.replace(name, df)
    _refresh(job)


def _refresh(job: Job) -> None:
    """The search index made anew after bodies have changed, if there is one."""
    from tracefold.plans.shared import exists

    if exists(job.spark, f"{job.path}/fts/postings"):
        _rebuild(job)


def _prune(job: Job) -> None:
    print(len(job.at.prune([int(a) for a in job.flags.args], job.path)))
    _refresh(job)


def _pii(job: Job) -> None:
    masking.check_options(job.flags.redact, job.flags.out, job.flags.force, job.flags.dry_run)
    job.show(masking.findings(job.chosen(), job.blobs).orderBy("id", "location_no", "kind_no").drop("location_no", "kind_no"))


def _merge(job: Job) -> None:
    stores = [store.Store(job.spark, p).tables() for p in job.flags.args]
    merged = store.merge(stores)
    if job.flags.dry_run:
        job.show(store.merge_stats(stores, merged))
        return
    for name, df in merged.items():
        store.Store(job.spark, job.flags.out).replace(name, df)


def _report(job: Job) -> None:
    s = job.settings["report"]
    job.write(report.render_html(report.model(job.chosen(), job.zones(), job.pages, s["top"], s["waterfall_limit"])))


def _waterfall(job: Job) -> None:
    s = job.settings["waterfall"]
    if job.flags.trace:
        rows = sinks.trace_events(job.chosen(), job.zones(), job.pages, s["group"]).orderBy("group_no", "turn")
        job.write('{"traceEvents":[' + ",".join(r.event for r in rows.toLocalIterator()) + "]}")
        return
    lines = report.waterfall_text(report.waterfall(job.chosen(), job.zones(), job.pages, s["group"], job.flags.page), s["width"])
    job.write("\n".join(r.line for r in lines.orderBy("group_no", "row_no").toLocalIterator()))


def _otel(job: Job) -> None:
    s, about = job.settings["otel"], tracing.resource(job.flags.attribute)
    docs = tracing.documents(job.chosen(), job.zones(), s["sample"], s["phases"])
    if job.flags.endpoint:
        print(tracing.send(docs, job.flags.endpoint, about))
    else:
        job.write(tracing.request_body([r.span for r in docs.orderBy("start_us", "id", "turn").toLocalIterator()], about))


def _search(job: Job) -> None:
    q = " ".join(job.flags.args)
    i = search.Index(job.spark, f"{job.path}/fts", job.settings["fts"]["tokenizer"])
    job.show(search.entries_of_hits(i.snippets(i.search(q), q), job.entries))


def _rebuild(job: Job) -> None:
    s = job.settings["fts"]
    search.Index(job.spark, f"{job.path}/fts", s["tokenizer"]).build_bodies(job.blobs, job.entries, filters.parse_size(s["max_body"]))


def _diff(job: Job) -> None:
    other = store.Store(job.spark, job.flags.args[0]).table("entries")
    how = {"hosts": job.flags.host, "methods": job.flags.method, "statuses": job.flags.status, "url_regex": job.flags.url_regex}
    job.show(views.ordinal_diff(filters.for_diff(job.entries, **how), filters.for_diff(other, **how)))


def _replay(job: Job) -> None:
    from tracefold.replay import replay

    s, f = job.settings["replay"], job.flags
    job.show(replay(job.entries, job.blobs, s["workers"], None, f.override_host, f.override_header, s["unsafe"]))


def _serve(job: Job) -> None:
    from tracefold.replay import server

    s = job.settings["serve"]
    server(job.entries, job.blobs, (s["host"], s["port"]), s["mode"]).serve_forever()


def _cdp(job: Job) -> None:
    from pyspark.sql import functions as F

    from tracefold.streaming import devtools_events, fold_events

    lines = job.spark.read.text(job.flags.args[0]).select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("message"))
    job.show(fold_events(devtools_events(lines)))


def _repl(job: Job) -> None:
    """Statements line by line; ``.help .mode .slow .status .tables .exit``."""
    tables = job.at.tables()
    for line in sys.stdin:
        word = line.split()
        try:
            if not word:
                continue
            if word[0] == ".exit":
                return
            if word[0] == ".help":
                print(_repl.__doc__)
            elif word[0] == ".mode":
                job.flags.format = word[1]
            elif word[0] == ".slow":
                job.show(analysis.slowest(tables["entries"], "time_ms", 0, int(word[1]) if len(word) > 1 else 10))
            elif word[0] == ".status":
                job.show(tables["entries"].groupBy("status").count().orderBy("status"))
            elif word[0] == ".tables":
                print("\n".join(tables))
            else:
                job.show(run_query(job.spark, line, tables))
        except Exception as e:  # noqa: BLE001
            print(f"error: {e}", file=sys.stderr)


COMMANDS: dict[str, Callable[[Job], None]] = {
    "import": _import, "watch": _watch, "cdp": _cdp, "imports": lambda j: j.show(analysis.import_listing(j.imports, j.entries).orderBy("id")), "prune": _prune,
    "stats": lambda j: j.show(analysis.store_stats(j.entries, j.imports, j.blobs)), "info": lambda j: j.show(analysis.store_info(j.entries, j.imports, j.blobs)), "schema": lambda j: print("\n\n".join(store.ddl(t) for t in store.SCHEMAS)), "config": lambda j: print(json.dumps(j.settings, indent=2)),
    "analyze": lambda j: j.show(analysis.timing_stats(j.chosen())), "slow": lambda j: j.show(analysis.slowest(j.chosen(), "time_ms", j.settings["analyze"]["slow_ms"], j.settings["analyze"]["top"])), "certificates": lambda j: j.show(matching.certificate_list(j.chosen(), "", 20)),
    "export": _export, "redact": _redact, "pii": _pii, "merge": _merge, "report": _report, "waterfall": _waterfall, "otel": _otel, "openapi": lambda j: j.write(json.dumps(openapi.build(j.chosen(), j.blobs, **j.settings["openapi"]), indent=2)),
    "search": _search, "fts-rebuild": _rebuild, "diff": _diff, "replay": _replay, "serve": _serve, "repl": _repl, "query": lambda j: j.show(run_query(j.spark, " ".join(j.flags.args), j.at.tables())),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracefold", description="A command, or the name of a query; 'list' shows all of both, 'completions' prints a script for the shell.")
    p.add_argument("command")
    p.add_argument("args", nargs="*")
    for name in ("store", "out", "page", "endpoint", "since", "until"):
        p.add_argument(f"--{name}")
    for name in ("host", "method", "url-contains", "url-regex", "source", "header", "cookie", "param", "body", "attribute", "override-host", "override-header", "filter-plugin", "transform-plugin"):
        p.add_argument(f"--{name}", action="append", default=[])
    p.add_argument("--status", action="append", type=int, default=[])
    for name in ("pretty", "trace", "dry-run", "force", "redact", "incremental", "resume", "async-read"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--format", choices=["table", "csv", "json"], default=config.settings()["query"]["format"])
    p.add_argument("--limit", type=int, help="rows to show; all without it")
    p.add_argument("--offset", type=int)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "list":
        print("\n".join([*COMMANDS, *queries.queries()]))
    elif a.command == "completions":
        print('complete -W "' + " ".join([*COMMANDS, *queries.queries()]) + '" tracefold')
    elif a.command in COMMANDS:
        COMMANDS[a.command](Job(a))
    elif a.command in queries.queries():
        job = Job(a)
        job.show(queries.queries()[a.command](job.spark, job.path))
    else:
        raise SystemExit(f"unknown command {a.command!r}; see 'list'")


if __name__ == "__main__":
    main()
