"""inkwell: a Spark-first analytics engine for collections of markdown-style notes."""

__version__ = "0.1.0"

__all__ = ["Config", "InkwellError", "Tree", "clear_cache", "init_config", "load_config", "migrate_config", "open_tree", "print_rows", "watch"]

_PLACES = {
    "Config": "config:Config", "init_config": "config:init", "load_config": "config:load", "migrate_config": "config:migrate", "InkwellError": "errors:InkwellError",
    "Tree": "tree:Tree", "open_tree": "tree:open_tree", "clear_cache": "tree:clear_cache", "print_rows": "output:print_rows", "watch": "streaming.watch:watch",
}


def __getattr__(name: str):
    """Parts are imported when first asked for."""
    import importlib

    if name not in _PLACES:
        raise AttributeError(name)
    module, _, attribute = _PLACES[name].partition(":")
    return getattr(importlib.import_module(f"inkwell.{module}"), attribute)
