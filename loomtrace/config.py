"""Settings: defaults, and a TOML file over them. Tables are merged, lists are replaced whole."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from typing import Any

from loomtrace.functions.paths import DIRECTORY_RULES, EXCLUDE_CALLEES, EXCLUDE_PATHS, EXTENSIONS, RAW_LANE, UNKNOWN_LANE, ModuleRules
from loomtrace.operators.extract import ASYNC_APIS, ASYNC_KINDS, AsyncApi
from loomtrace.operators.graph import ASYNC_MS, CALLBACK_MS, MAX_HOPS, SYNC_MS


def defaults() -> dict[str, Any]:
    return {
        "source": {"encoding": "auto", "path_prefix_strip": ["Input/"], "extensions": list(EXTENSIONS), "exclude_patterns": list(EXCLUDE_PATHS)},
        "analyzer": {"exclude_callees": list(EXCLUDE_CALLEES)},
        "async_apis": [{"name": a.name, "kind": a.kind, "arg": a.arg, "handle_arg": a.handle_arg} for a in ASYNC_APIS],
        "modules": {"prefix_separators": [":"], "aliases": [], "file_rules": [], "directory_rules": list(DIRECTORY_RULES), "raw_lane": RAW_LANE, "unknown_lane": UNKNOWN_LANE},
        "sequence": {"max_caller_hops": MAX_HOPS, "sync_window_ms": SYNC_MS, "async_window_ms": ASYNC_MS, "callback_window_ms": CALLBACK_MS},
        "render": {"max_message_length": 4000},
    }


@dataclass(frozen=True)
class Settings:
    encoding: str
    prefixes: tuple[str, ...]
    extensions: tuple[str, ...]
    exclude_paths: tuple[str, ...]
    exclude_callees: tuple[str, ...]
    apis: tuple[AsyncApi, ...]
    rules: ModuleRules
    max_hops: int
    windows: tuple[int, int, int]
    max_message: int


def over(base: dict[str, Any], more: dict[str, Any]) -> dict[str, Any]:
    """A table over another: nested tables merge, everything else replaces."""
    return {**base, **{k: over(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in more.items()}}


def settings(more: dict[str, Any] | None = None) -> Settings:
    """Settings from a nested table over the defaults; an unknown kind of asynchronous interface is an error."""
    d = over(defaults(), more or {})
    apis = []
    for a in d["async_apis"]:
        if a["kind"] not in ASYNC_KINDS:
            raise ValueError(f"unknown kind of asynchronous interface: {a['kind']}")
        apis.append(AsyncApi(str(a["name"]), str(a["kind"]), int(a.get("arg", 0)), None if a.get("handle_arg") is None else int(a["handle_arg"])))
    m, q, s = d["modules"], d["sequence"], d["source"]
    many = lambda v: tuple(v) if isinstance(v, (list, tuple)) else () if v is None else (v,)
    rules = ModuleRules(
        many(m["prefix_separators"]), tuple((x["pattern"], x["module"]) for x in m["aliases"]), tuple((x["pattern"], x["module"]) for x in m["file_rules"]), many(m["directory_rules"]), m["raw_lane"], m["unknown_lane"]
    )
    return Settings(
        s["encoding"], many(s["path_prefix_strip"]), many(s["extensions"]), many(s["exclude_patterns"]), many(d["analyzer"]["exclude_callees"]), tuple(apis), rules,
        int(q["max_caller_hops"]), (int(q["sync_window_ms"]), int(q["async_window_ms"]), int(q["callback_window_ms"])), int(d["render"]["max_message_length"]),
    )


def load(path: str | None = None) -> Settings:
    if path is None:
        return settings()
    with open(path, "rb") as f:
        return settings(tomllib.load(f))
