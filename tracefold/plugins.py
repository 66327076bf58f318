"""Filters, transforms and exporters of one's own: Python callables, or programs that read and write JSON."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

Step = Callable[[dict], object]
KINDS = ("filter", "transform", "exporter")


@dataclass
class Plugin:
    """A plugin by name: its kind, what runs it, when ('import', 'export' or 'both') and whether it does by default."""

    name: str
    kind: str
    run: Step | list[str]
    phase: str | None = None
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of plugin {self.kind!r}")
        self.phase = self.phase or ("export" if self.kind == "exporter" else "import")
        if self.phase not in ("import", "export", "both"):
            raise ValueError(f"unknown phase {self.phase!r}")


def resolve(plugins: list[Plugin], phase: str, enable: list[str] | None = None, disable: list[str] | None = None) -> list[Plugin]:
    """Plugins that run in a phase: those on by default or named in ``enable``, without those in ``disable``. Unknown names are an error."""
    known = {p.name for p in plugins}
    for n in [*(enable or []), *(disable or [])]:
        if n not in known:
            raise ValueError(f"unknown plugin {n!r}")
    on = [p for p in plugins if (p.enabled or p.name in (enable or [])) and p.name not in (disable or [])]
    return [p for p in on if p.phase in (phase, "both")]


class Program:
    """A program that gets one JSON line per entry and answers with one; it is started once per task, not per entry."""

    def __init__(self, command: list[str]):
        self.command = command

    def start(self) -> Callable[[dict], object]:
        p = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)

        def ask(row: dict) -> object:
            try:
                p.stdin.write(json.dumps(row, default=str) + "\n")
                p.stdin.flush()
                line = p.stdout.readline()
            except BrokenPipeError:
                line = ""
            if not line.strip():
                p.kill()
                raise RuntimeError(f"plugin {self.command[0]} gave no answer (exit {p.wait()})")
            try:
                return json.loads(line)
            except ValueError as e:
                raise RuntimeError(f"plugin {self.command[0]} gave no JSON: {line[:80]!r}") from e

        def stop() -> None:
            p.stdin.close()
            if p.wait(timeout=30):
                raise RuntimeError(f"plugin {self.command[0]} failed with exit {p.returncode}")

        ask.stop = stop
        return ask


def _started(step: Step | list[str]) -> Callable[[dict], object]:
    return Program(step).start() if isinstance(step, list) else step


def _allowed(answer: object) -> bool:
    """What a filter says: true or false, or an object with ``allow``."""
    if isinstance(answer, bool):
        return answer
    if isinstance(answer, dict) and isinstance(answer.get("allow"), bool):
        return answer["allow"]
    raise RuntimeError(f"a filter must answer whether it allows the entry, not {answer!r}")


def run(entries: DataFrame, filters: list[Step | list[str]] | None = None, transforms: list[Step | list[str]] | None = None) -> DataFrame:
    """Entries that all filters allow, changed by the transforms in turn; filters come first.

    A transform answers with the entry, or None to leave it as it is. A failure,
    no answer or an unreadable one ends the job. Columns and their types stay.
    """
    import pyarrow as pa

    if not filters and not transforms:
        return entries
    arrow = to_arrow_schema(entries.schema)

    def each(batches: Iterator) -> Iterator:
        keep, change = [_started(f) for f in filters or []], [_started(t) for t in transforms or []]
        for b in batches:
            rows = []
            for row in b.to_pylist():
                if not all(_allowed(f(row)) for f in keep):
                    continue
                for t in change:
                    new = t(row)
                    if isinstance(new, dict) and set(new) == {"entry"}:
                        new = new["entry"]
                    if new is not None:
                        if not isinstance(new, dict):
                            raise RuntimeError(f"a transform must answer with the entry or null, not {new!r}")
                        row = row | {k: v for k, v in new.items() if k in row}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        for s in [*keep, *change]:
            if hasattr(s, "stop"):
                s.stop()

    return entries.mapInArrow(each, entries.schema)


def export(path: str, exporters: list[Step | list[str]]) -> bool:
    """Hands a written document to exporters; whether any of them asks that the document itself not be kept."""
    drop = False
    for x in exporters:
        if isinstance(x, list):
            with open(path, "rb") as f:
                done = subprocess.run(x, stdin=f, capture_output=True)
            if done.returncode:
                raise RuntimeError(f"exporter {x[0]} failed with exit {done.returncode}")
            answer = json.loads(done.stdout) if done.stdout.strip() else {}
        else:
            answer = x({"path": path}) or {}
        drop = drop or bool(answer.get("suppress"))
    return drop

