"""Command line: ``python -m inkwell.cli <command>``. Exit codes: 0, 1 for an error, 2 for wrong usage."""

from __future__ import annotations

import argparse
import json
import shutil
import sys

from inkwell import __version__, config, output
from inkwell.errors import InkwellError

COMMANDS = ("init", "watch", "status", "download", "sql", "search", "map", "peek", "path", "related")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="inkwell", description="Query a tree of markdown notes.")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--list", action="store_true", help="list the saved queries")
    subs = top.add_subparsers(dest="command")

    def add(name: str, *positional: str, scope: bool = False, forms: tuple[str, ...] = (), k: bool = False):
        p = subs.add_parser(name)
        for x in positional:
            p.add_argument(x.rstrip("*"), **({"nargs": "*"} if x.endswith("*") else {}))
        p.add_argument("--config")
        if scope:
            p.add_argument("--preset")
            p.add_argument("--include", action="append")
            p.add_argument("--exclude", action="append")
            p.add_argument("--no-exclude", action="store_true")
            p.add_argument("--where")
        if forms:
            p.add_argument("--format", choices=forms, default="table")
        if k:
            p.add_argument("--k", type=_positive)
        return p

    rows, both = ("table", "json", "csv"), ("table", "json")
    add("init")
    add("watch").add_argument("--force", action="store_true")
    add("status", forms=both)
    add("download")
    add("sql", "statement", "params*", forms=rows).add_argument("--preset")
    add("search", "terms", scope=True, forms=rows, k=True)
    add("map", scope=True, forms=both)
    add("peek", "note", scope=True, forms=both)
    add("path", "a", "b", scope=True, forms=both).add_argument("--max-depth", type=_positive)
    add("related", "note", scope=True, forms=rows, k=True)
    named = add("named", "name", "params*", scope=True, forms=rows, k=True)
    named.description = "a saved query"
    return top


def _positive(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError(f'expects a positive integer, got "{text}"')
    return int(text)


def main(argv: list[str] | None = None, spark=None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv.insert(0, "named")
    args = _parser().parse_args(argv)
    try:
        return _run(args, spark)
    except InkwellError as e:
        print(f"inkwell: {e}", file=sys.stderr)
        return 1
    except BrokenPipeError:
        return 0


def _run(args, spark) -> int:
    if args.command == "init":
        print(config.init("."))
        return 0
    if args.command is None and not args.list:
        _parser().print_usage(sys.stderr)
        return 2
    cfg = config.load(getattr(args, "config", None))
    if args.list:
        for name, q in sorted(cfg.queries.items()):
            print(f"{name}: {q.get('sql') or q.get('search')}")
        return 0
    if args.command == "named" and args.name not in cfg.queries:
        print(f"inkwell: no command or saved query {args.name}", file=sys.stderr)
        return 2
    if args.command == "download":
        from inkwell.sources.models import provider

        provider(cfg.embed)
        print("the model is present")
        return 0
    if spark is None:
        from inkwell.session import session

        spark = session(**{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
        spark.sparkContext.setLogLevel("ERROR")
    if args.command == "watch":
        from inkwell.streaming.watch import watch

        watch(cfg, spark, lambda e: print(json.dumps(e), flush=True), force=args.force)
        return 0
    from inkwell.tree import open_tree

    tree = open_tree(cfg, spark)
    for w in tree.warnings:
        print(w, file=sys.stderr)
    scope = {k: getattr(args, k) for k in ("preset", "include", "exclude", "where", "no_exclude") if getattr(args, k, None)}
    width = shutil.get_terminal_size((0, 0)).columns or None
    show = lambda value, text: print(json.dumps(value, indent=2, ensure_ascii=False, default=str) if args.format == "json" else text(value))

    def rows(got) -> None:
        if isinstance(got, list):
            output.print_rows(got, args.format, width=width)
        else:
            output.print_rows((r.asDict() for r in got.toLocalIterator()), args.format, got.columns, width)

    if args.command == "sql":
        if (asked := tree.placeholders(args.statement)) != len(args.params):
            print(f"inkwell: {asked} parameter(s) in the statement, {len(args.params)} given", file=sys.stderr)
            return 2
        try:
            rows(tree.sql(args.statement, args.params, args.preset))
        except InkwellError:
            raise
        except Exception as e:  # noqa: BLE001  the engine's message is the answer
            print(f"inkwell: {str(e).splitlines()[0]}", file=sys.stderr)
            return 1
    elif args.command == "named":
        rows(tree.saved(args.name, args.params or None, k=args.k, **scope))
    elif args.command == "search":
        rows(tree.search(args.terms, k=args.k, **scope))
    elif args.command == "related":
        rows(tree.related(args.note, args.k, **scope))
    elif args.command == "map":
        show(tree.map(**scope), output.render_map)
    elif args.command == "peek":
        show(tree.peek(args.note, **scope), output.render_peek)
    elif args.command == "path":
        show(tree.path(args.a, args.b, args.max_depth, **scope), lambda p: "(no path)" if p is None else output.table([{"step": i, "path": x} for i, x in enumerate(p)]))
    elif args.command == "status":
        show(tree.status(), output.render_status)
    return 0


if __name__ == "__main__":
    sys.exit(main())
