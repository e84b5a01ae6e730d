"""Settings: defaults, presets, files, environment, and checks of single values."""

from __future__ import annotations

import json
import re
from pathlib import Path
from urllib.parse import urlparse

#: Defaults by section.
DEFAULTS = {
    "analysis": {"languages": [], "ignore": [], "max_files": None, "max_file_bytes": 10 * 1024 * 1024},
    "graph": {"max_nodes": 1_000_000, "max_edges": 10_000_000},
    "watch": {"quiet": "500 milliseconds", "late": "1 minute"},
    "logging": {"level": "info"},
}
PRESETS = {
    "fast": {"analysis": {"max_files": 1_000, "max_file_bytes": 1024 * 1024}},
    "balanced": {},
    "thorough": {"analysis": {"max_file_bytes": 50 * 1024 * 1024}},
}
ENVIRONMENT = "CODELOOM_"


def deep_merge(*parts: dict) -> dict:
    """Later parts win; sections are merged key by key."""
    out: dict = {}
    for part in parts:
        for k, v in part.items():
            out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def from_environment(environ: dict[str, str]) -> dict:
    """PREFIX_SECTION__KEY=value, values as JSON where they are."""
    out: dict = {}
    for name, value in environ.items():
        if name.startswith(ENVIRONMENT) and "__" in name:
            section, _, key = name.removeprefix(ENVIRONMENT).lower().partition("__")
            try:
                out.setdefault(section, {})[key] = json.loads(value)
            except ValueError:
                out.setdefault(section, {})[key] = value
    return out


def load(path: str | None = None, preset: str = "balanced", environ: dict[str, str] | None = None, **over) -> dict:
    """Defaults, preset, file (JSON or TOML), environment and keyword sections, in this order."""
    part: dict = {}
    if path:
        raw = Path(path).read_text(encoding="utf-8")
        if path.endswith(".toml"):
            import tomllib

            part = tomllib.loads(raw)
        else:
            part = json.loads(raw)
    out = deep_merge(DEFAULTS, PRESETS[preset], part, from_environment(environ or {}), over)
    if problems := check(out):
        raise ValueError("; ".join(problems))
    return out


def check(settings: dict) -> list[str]:
    """What is wrong with settings, as text rows."""
    out = [f"unknown section {s}" for s in settings if s not in DEFAULTS]
    for s, keys in DEFAULTS.items():
        out += [f"unknown setting {s}.{k}" for k in settings.get(s, {}) if k not in keys]
    a = settings.get("analysis", {})
    for k in ("max_files", "max_file_bytes"):
        if a.get(k) is not None and (not isinstance(a[k], int) or a[k] <= 0):
            out.append(f"analysis.{k} must be a positive number")
    return out


#: Units of durations in milliseconds, and words for yes and no.
UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000}
TRUE, FALSE = ("true", "1", "yes", "on", "enabled"), ("false", "0", "no", "off", "disabled")


def duration_ms(text: str, most: int | None = None) -> int:
    m = re.fullmatch(r"(\d+)(ms|s|m|h)", text.strip())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    out = int(m[1]) * UNITS[m[2]]
    if most is not None and out > most:
        raise ValueError(f"longer than {most} ms: {text!r}")
    return out


def boolean(text: str) -> bool:
    low = text.strip().lower()
    if low not in TRUE + FALSE:
        raise ValueError(f"not a yes or no: {text!r}")
    return low in TRUE


def url(text: str, allow_local: bool = False) -> str:
    if len(text) > 2048 or re.search(r"[<>\"{}|\\^`\s]", text):
        raise ValueError("not a URL")
    parts = urlparse(text)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError("not an http(s) URL")
    if not allow_local and (parts.hostname == "localhost" or parts.hostname.startswith(("127.", "10.", "192.168.", "169.254."))):
        raise ValueError("local addresses aren't allowed")
    return text


def email(text: str) -> str:
    if len(text) > 254 or not re.fullmatch(r"[\w.+%-]+@[\w-]+(\.[\w-]+)+", text):
        raise ValueError("not an address")
    return text


def json_value(text: str, most: int = 1_000_000):
    """A parsed JSON text within limits: size, strings of 10,000 characters, lists of 1,000."""
    if len(text) > most:
        raise ValueError("JSON text too large")
    todo = [root := json.loads(text)]
    while todo:
        v = todo.pop()
        if isinstance(v, str) and len(v) > 10_000 or isinstance(v, list) and len(v) > 1_000:
            raise ValueError("JSON value too large")
        todo += v.values() if isinstance(v, dict) else v if isinstance(v, list) else []
    return root
