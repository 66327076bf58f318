"""Settings in layers: what is built in, the user's file, files from the root down to the current folder, flags."""

from __future__ import annotations

import copy
import os
import tomllib

NAME = "tracefold.toml"
# Settings that hold unless a layer says otherwise.
BUILT_IN = {
    "import": {"max_body": "100KB", "text_only": False, "incremental": False, "resume": False, "graphql": True}, "fts": {"tokenizer": "unicode61", "max_body": "1MB"}, "analyze": {"slow_ms": 1000, "ttfb_ms": 500, "top": 10},
    "report": {"top": 20, "waterfall_limit": 500, "group": "page"}, "waterfall": {"group": "page", "width": 60}, "redact": {"token": "REDACTED", "match": "wildcard", "defaults": True}, "query": {"format": "table"},
    "export": {"format": "jsonl"}, "otel": {"sample": 1.0, "phases": True}, "serve": {"host": "127.0.0.1", "port": 8080, "mode": "strict"}, "replay": {"workers": 4, "unsafe": False}, "watch": {"debounce_ms": 750, "stable_ms": 1000, "recursive": True},
    "openapi": {"title": "Captured API", "version": "1.0.0"},
}


def layered(base: dict, over: dict) -> dict:
    """``base`` with what ``over`` says, section by section; a value that is None says nothing."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        if isinstance(v, dict):
            out[k] = layered(out.get(k) or {}, v)
        elif v is not None:
            out[k] = v
    return out


def files(cwd: str | None = None, home: str | None = None) -> list[str]:
    """The files there are, the weakest first: the user's, then one for each folder from the root down."""
    here = os.path.abspath(cwd or os.getcwd())
    base = home or os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    way = [here]
    while os.path.dirname(way[-1]) != way[-1]:
        way.append(os.path.dirname(way[-1]))
    return [p for p in [os.path.join(base, "tracefold", NAME), *(os.path.join(d, NAME) for d in reversed(way))] if os.path.isfile(p)]


def settings(flags: dict | None = None, cwd: str | None = None, home: str | None = None) -> dict:
    """All settings. An unreadable file, or a section that isn't known, is an error that names it."""
    out = copy.deepcopy(BUILT_IN)
    for p in files(cwd, home):
        with open(p, "rb") as f:
            try:
                new = tomllib.load(f)
            except tomllib.TOMLDecodeError as e:
                raise ValueError(f"unreadable settings in {p}: {e}") from e
        for k in new:
            if k not in BUILT_IN:
                raise ValueError(f"unknown section {k!r} in {p}")
        out = layered(out, new)
    return layered(out, flags or {})
