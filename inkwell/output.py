"""Rendering of rows as table, JSON or CSV, and of overviews as text."""

from __future__ import annotations

import csv
import io
import json
import sys
from collections.abc import Iterable, Iterator

OVERSIZE, NARROWEST, SAFE = 50_000, 12, 2**53 - 1


def _cell(v) -> str:
    if v is None:
        return ""
    if isinstance(v, (dict, list)):
        return json.dumps(v, ensure_ascii=False, default=str)
    return str(v).replace("\n", " ")


def _widths(natural: list[int], limit: int | None) -> list[int]:
    """Natural widths; the widest gives way first, down to NARROWEST."""
    out = list(natural)
    while limit and limit > NARROWEST and (over := sum(out) + 2 * (len(out) - 1) - limit) > 0:
        k = out.index(max(out))
        if out[k] <= NARROWEST:
            break
        out[k] = max(NARROWEST, out[k] - over)
    return out


def table(rows: list[dict], width: int | None = None) -> str:
    if not rows:
        return "(0 rows)"
    names = list(rows[0])
    cells = [names] + [[_cell(r.get(n)) for n in names] for r in rows]
    widths = _widths([max(len(r[i]) for r in cells) for i in range(len(names))], width)
    clip = lambda s, w: s.ljust(w) if len(s) <= w else s[: w - 1] + "…"
    lines = ["  ".join(clip(c, w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def _safe(v):
    """Whole numbers beyond what a JSON reader holds exactly become decimal strings."""
    return str(v) if isinstance(v, int) and not isinstance(v, bool) and abs(v) > SAFE else v


def json_rows(rows: Iterable[dict]) -> Iterator[str]:
    """A JSON array, row by row; the same text as the whole at once."""
    first = True
    for row in rows:
        text = json.dumps({k: _safe(v) for k, v in row.items()}, indent=2, ensure_ascii=False, default=str)
        yield ("[\n" if first else ",\n") + "\n".join("  " + line for line in text.split("\n"))
        first = False
    yield "[]\n" if first else "\n]\n"


def csv_rows(rows: Iterable[dict], names: list[str] | None = None) -> Iterator[str]:
    """RFC 4180; null is empty; the header stands even without rows if ``names`` are known; equal names once."""
    out, header = io.StringIO(), False
    writer = csv.writer(out, lineterminator="\n")
    for row in rows:
        if not header:
            names = list(row)
            writer.writerow(names)
            header = True
        writer.writerow(["" if row.get(n) is None else row[n] for n in names])
        yield out.getvalue()
        out.seek(0)
        out.truncate()
    if not header and names:
        writer.writerow(dict.fromkeys(names))
        yield out.getvalue()


def print_rows(rows: Iterable[dict], form: str = "table", names: list[str] | None = None, width: int | None = None, out=None) -> None:
    """Write rows; JSON and CSV stream. A very large output is noted on stderr, never cut."""
    out, size = out or sys.stdout, 0
    parts = json_rows(rows) if form == "json" else csv_rows(rows, names) if form == "csv" else [table(list(rows), width) + "\n"]
    for part in parts:
        size += len(part.encode())
        out.write(part)
    if size > OVERSIZE:
        print(f"inkwell: {size} bytes of output; add a LIMIT or fewer columns", file=sys.stderr)


def _features(f: dict) -> str:
    off = f" · off: {', '.join(f'{n} (features.{n})' for n in f['off'])}" if f["off"] else ""
    return f"features: {', '.join(f['on'])}{off}"


def _presets(presets: list[dict]) -> list[str]:
    return ["presets:"] + [f"  {p['name']}: {p['files']} file(s), {p['embedded']} embedded" + ("" if p["semantic"] else " (semantic: false)") for p in presets]


def render_map(m: dict) -> str:
    out = [f"docs: {m['docs']['count']} ({round(m['docs']['bytes'] / 1024)} KB)", _features(m["features"]), "", *_presets(m["presets"]), "", table(m["fields"])]
    if m["fieldsTotal"] > len(m["fields"]):
        out.append(f"(+{m['fieldsTotal'] - len(m['fields'])} more fields)")
    out += ["\nhubs (by link rank):", table(m["hubs"])] if m["hubs"] else ["\nhubs: off (features.rank)"] if "rank" in m["features"]["off"] else []
    return "\n".join([*out, "\nrecent:", table(m["recent"])])


def render_status(s: dict) -> str:
    out = [f"config: {s['config']}", f"tree: {s['tree']}", f"cache: {s['cache']}", f"docs: {s['docs']}" + (f" ({s['unparseableFrontmatter']} with front matter that did not parse)" if s["unparseableFrontmatter"] else ""), _features(s["features"])]
    if e := s["embed"]:
        v = e["vectors"]
        out.append(f"embed: {e['type']} {e['model']}" + (f" at {e['url']}" if e["url"] else "") + ("" if e["present"] else " (not present)") + (f", {v['embedded']} embedded, {v['pending']} pending" if v else ""))
    else:
        out.append("embed: off")
    out += [*_presets(s["presets"]), f"queries: {s['queries']}"]
    return "\n".join([*out, f"watcher: pid {s['watcherPid']}, last heard {s['watcherHeartbeatSecondsAgo']} s ago" if s["watcherPid"] else "watcher: none"])


def render_peek(p: dict) -> str:
    out = [f"{p['path']}  (~{p['tokens']} tokens)"]
    if p["parseError"]:
        out.append(f"  front matter did not parse, so none of it is indexed ({p['parseError']})")
    out += [f"  {k}: {v}" for k, v in p["frontmatter"].items()]
    if p["sections"]:
        out += ["", "sections:"] + [f"  {'#' * s['level']} {s['heading']}  [L{s['start_line']}-{s['end_line']}, ~{s['tokens']}t]" for s in p["sections"]]
        if p["sectionsTotal"] > len(p["sections"]):
            out.append(f"  (+{p['sectionsTotal'] - len(p['sections'])} more sections)")
    elif "sections" in p["off"]:
        out += ["", "sections: off (features.sections)"]
    if "links" in p["off"]:
        return "\n".join([*out, "", "links: off (features.links)"])
    shown = [(label, p[key], p[key + "Total"]) for label, key in (("links out", "outbound"), ("unresolved", "unresolved"), ("backlinks", "backlinks"))]
    if any(n for _, _, n in shown):
        out.append("")
    return "\n".join(out + [f"{label} ({n}): {', '.join(some)}" + (f", +{n - len(some)} more" if n > len(some) else "") for label, some, n in shown if n])
