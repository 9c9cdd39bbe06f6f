"""The configuration of a tree of notes: shape, validation, migration, precedence, signature."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field
from pathlib import Path

from inkwell.errors import InkwellError
from inkwell.functions.tokens import Tokenizer

CONFIG_FILENAME, STATE_DIR, VERSION, DEFAULT_K = "inkwell.json", ".inkwell", 4, 10
FEATURES = ("links", "sections", "rank")


def _globs(v) -> bool:
    return isinstance(v, list) and bool(v) and all(isinstance(g, str) and g for g in v)


def _whole(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v > 0


def _text(v) -> bool:
    return isinstance(v, str)


def _filled(v) -> bool:
    return isinstance(v, str) and bool(v.strip())


def _flag(v) -> bool:
    return isinstance(v, bool)


#: Per block: what each key must be, and how a message says so.
RULES = {
    "preset": {"include": (_globs, "a non-empty array of glob strings"), "exclude": (_globs, "a non-empty array of glob strings"), "k": (_whole, "a positive integer"), "semantic": (_flag, "a boolean"), "where": (_text, "a SQL condition string")},
    "features": {name: (_flag, "a boolean") for name in FEATURES},
    "embed": {"model": (_filled, "a non-empty string"), "type": (lambda v: v in ("static", "api"), '"static" or "api"'), "url": (_text, "a string"), "key": (_text, "a string")},
    "content": {"tokenize": (_filled, "a non-empty string")},
    "sql": {"sql": (_filled, "a non-empty string")},
    "search": {"search": (_filled, "non-empty text"), "preset": (_filled, "a preset name"), "include": (_globs, "a non-empty array of glob strings"), "exclude": (_globs, "a non-empty array of glob strings"), "where": (_text, "a SQL condition string"), "k": (_whole, "a positive integer")},
}
TOP = ("$schema", "version", "presets", "features", "embed", "content", "queries")


@dataclass
class Config:
    raw: dict
    base: Path
    path: Path | None = None
    migrated_from: int | None = None
    unknown: list[str] = field(default_factory=list)

    @property
    def presets(self) -> dict[str, dict]:
        return self.raw["presets"]

    @property
    def queries(self) -> dict[str, dict]:
        return self.raw.get("queries", {})

    @property
    def embed(self) -> dict | None:
        return self.raw.get("embed")

    def on(self, feature: str) -> bool:
        return self.raw.get("features", {}).get(feature, True)

    @property
    def tokenize(self) -> str | None:
        return self.raw.get("content", {}).get("tokenize")

    def tokenizer(self) -> Tokenizer:
        return Tokenizer(self.tokenize or "porter unicode61")

    def resolve(self, **own) -> dict:
        """Scope and size of a search: built-in, then preset, then what is given. A where replaces the preset's."""
        name = own.get("preset") or "default"
        if name not in self.presets:
            raise InkwellError("PRESET_UNKNOWN", f'no preset "{name}"; there are {", ".join(self.presets)}')
        preset = self.presets[name]
        exclude = own.get("exclude") or ([] if own.get("no_exclude") else preset.get("exclude", []))
        given = bool(own.get("include") or own.get("exclude") or own.get("no_exclude"))
        where = own["where"] if own.get("where") is not None else preset.get("where")
        return {"preset": name, "k": own.get("k") or preset.get("k", DEFAULT_K), "include": own.get("include") or preset["include"], "exclude": exclude, "where": where, "semantic": preset.get("semantic", True), "globbed": given}

    def signature(self) -> str:
        """What an index depends on. Where vectors come from is part of it."""
        scopes = {n: [p["include"], p.get("exclude", []), p.get("semantic", True)] for n, p in sorted(self.presets.items())}
        embed = {k: v for k, v in (self.embed or {}).items() if k != "key"}
        return json.dumps({"features": [self.on(f) for f in FEATURES], "embed": embed, "presets": scopes}, sort_keys=True)


def _block(kind: str, where: str, value, required: tuple[str, ...] = ()) -> None:
    rules = RULES[kind]
    if not isinstance(value, dict):
        raise InkwellError("CONFIG_INVALID", f"{where} must be an object of {', '.join(rules)}")
    if bad := [k for k in value if k not in rules]:
        raise InkwellError("CONFIG_INVALID", f"{where} has unknown key(s) {', '.join(bad)}; it takes {', '.join(rules)}")
    for key, (fits, wanted) in rules.items():
        if (key in value or key in required) and not fits(value.get(key)):
            raise InkwellError("CONFIG_INVALID", f"{where}.{key} must be {wanted}")


def validate(raw: dict, where: str = "config") -> list[str]:
    """Raises on a bad shape; returns unknown top-level keys, which only warn."""
    presets = raw.get("presets")
    if not isinstance(presets, dict) or "default" not in presets:
        raise InkwellError("CONFIG_INVALID", f'{where}: presets must be an object with a "default" preset')
    for name, value in presets.items():
        _block("preset", f"{where}: presets.{name}", value, ("include",))
    for kind, required in (("features", ()), ("embed", ("model",)), ("content", ())):
        if kind in raw:
            _block(kind, f"{where}: {kind}", raw[kind], required)
    features = raw.get("features", {})
    if features.get("rank") and features.get("links") is False:
        raise InkwellError("CONFIG_INVALID", f"{where}: features.rank needs features.links")
    queries = raw.get("queries", {})
    if not isinstance(queries, dict):
        raise InkwellError("CONFIG_INVALID", f"{where}: queries must be an object")
    for name, value in queries.items():
        verb = next((v for v in ("sql", "search") if isinstance(value, dict) and v in value), None)
        if verb is None:
            raise InkwellError("CONFIG_INVALID", f'{where}: queries.{name} must name its verb: {{"sql": ...}} or {{"search": ...}}')
        _block(verb, f"{where}: queries.{name}", value, (verb,))
        if value.get("preset") is not None and value["preset"] not in presets:
            raise InkwellError("PRESET_UNKNOWN", f"{where}: queries.{name} names no preset: {value['preset']}")
    return [k for k in raw if k not in TOP]


def _to2(c: dict) -> dict:
    return c | {"version": 2, "features": dict.fromkeys(FEATURES, True)}


def _to3(c: dict) -> dict:
    out = {k: v for k, v in c.items() if k not in ("scan", "defaults", "features", "checks", "queries")}
    features = dict(c.get("features") or {})
    embed = features.pop("embed", None)
    preset = {"include": c["scan"]["include"]}
    if where := (c.get("defaults") or {}).get("find", {}).get("where"):
        preset["where"] = where
    if embed is False:
        preset["semantic"] = False
    queries = {}
    for name, q in (c.get("queries") or {}).items():
        queries[name] = q if isinstance(q, str) else {"search": q["find"]} | {k: q[k] for k in ("k", "where") if k in q} | ({"semantic": False} if q.get("semantic") is False else {})
    out |= {"version": 3, "presets": {"default": preset}, "queries": queries}
    if isinstance(embed, dict):
        out["embed"] = embed
    return out | ({"features": features} if features else {})


def _to4(c: dict) -> dict:
    queries = {n: {"sql": q} if isinstance(q, str) else {k: v for k, v in q.items() if k != "semantic"} for n, q in (c.get("queries") or {}).items()}
    out = {k: v for k, v in c.items() if k != "embed"} | {"version": 4, "queries": queries}
    old = c.get("embed") or {}
    if any(p.get("semantic", True) for p in c["presets"].values()) and old.get("model"):
        out["embed"] = {"type": "static"} | old
    return out


MIGRATIONS = {1: _to2, 2: _to3, 3: _to4}


def migrate(raw: dict) -> tuple[dict, int]:
    """The newest version of a configuration, and the version it had."""
    start = raw.get("version", 1)
    if not isinstance(start, int) or start > VERSION:
        raise InkwellError("CONFIG_VERSION_UNSUPPORTED", f"config version {start} is newer than {VERSION}, the newest known here")
    if start < 3 and not _globs((raw.get("scan") or {}).get("include")):
        raise InkwellError("CONFIG_INVALID", "scan.include must be a non-empty array of glob strings")
    for v in range(start, VERSION):
        raw = MIGRATIONS[v](raw)
    return raw, start


def load(path: str | Path | None = None, start: str | Path = ".") -> Config:
    """The configuration at ``path``, or the nearest one upwards of ``start``. An old version is rewritten in place."""
    if path is None:
        here = Path(start).resolve()
        path = next((d / CONFIG_FILENAME for d in (here, *here.parents) if (d / CONFIG_FILENAME).is_file()), None)
        if path is None:
            raise InkwellError("CONFIG_NOT_FOUND", f"no {CONFIG_FILENAME} in {here} or above")
    path = Path(path).resolve()
    if not path.is_file():
        raise InkwellError("CONFIG_NOT_FOUND", f"no config at {path}")
    try:
        raw = json.loads(path.read_text())
    except ValueError as e:
        raise InkwellError("CONFIG_INVALID", f"{path}: {e}") from None
    if not isinstance(raw, dict):
        raise InkwellError("CONFIG_INVALID", f"{path} must hold an object")
    raw, old = migrate(raw)
    unknown = validate(raw, str(path))
    if old < VERSION:
        path.write_text(json.dumps(raw, indent=2, ensure_ascii=False) + "\n")
    for k in unknown:
        print(f"inkwell: unknown config key ignored: {k}", file=sys.stderr)
    return Config(raw, path.parent, path, old if old < VERSION else None, unknown)


def init(directory: str | Path) -> Path:
    """Write a starter configuration; refuses to overwrite one."""
    path = Path(directory) / CONFIG_FILENAME
    if path.exists():
        raise InkwellError("CONFIG_EXISTS", f"{CONFIG_FILENAME} already exists in {directory}")
    raw = {"version": VERSION, "presets": {"default": {"include": ["**/*.md"], "k": 10}, "large": {"include": ["**/*.md"], "k": 20}}, "queries": {}}
    path.write_text(json.dumps(raw, indent=2) + "\n")
    return path
