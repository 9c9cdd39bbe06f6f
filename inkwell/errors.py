"""The one exception that the library raises, with a stable code."""

from __future__ import annotations

#: Callers match on these codes.
CODES = (
    "CONFIG_NOT_FOUND", "CONFIG_EXISTS", "CONFIG_INVALID", "CONFIG_VERSION_UNSUPPORTED", "WATCH_ACTIVE",
    "NOTE_NOT_FOUND", "NOTE_AMBIGUOUS", "EMBED_DISABLED", "EMBED_MODEL", "EMBED_MODEL_MISSING",
    "SEARCH_SYNTAX", "COLUMN_LIMIT", "PRESET_UNKNOWN", "PRESET_NOT_SEMANTIC", "NOTE_NOT_EMBEDDED",
)


class InkwellError(Exception):
    def __init__(self, code: str, message: str):
        if code not in CODES:
            raise ValueError(f"no such error code: {code}")
        super().__init__(message)
        self.code = code
