"""Embedding providers: a static model from a local directory, or an HTTP endpoint."""

from __future__ import annotations

import json
import os
import struct
import urllib.request
from pathlib import Path
from urllib.parse import urlsplit, urlunsplit

import numpy as np

from inkwell.errors import InkwellError

MODEL_FILES = ("model.safetensors", "tokenizer.json")
BATCH = 64


def model_dir(name: str) -> Path:
    """A path as it is; a published model's id below the cache folder."""
    path = Path(name).expanduser()
    return path if path.is_dir() else Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "inkwell" / name.replace("/", "--")


def read_safetensors(path: Path) -> np.ndarray:
    """The one F32 matrix of a file: eight bytes of header length, a JSON header, data."""
    raw = path.read_bytes()
    (size,) = struct.unpack("<Q", raw[:8])
    header = {k: v for k, v in json.loads(raw[8 : 8 + size]).items() if k != "__metadata__"}
    for info in header.values():
        if info["dtype"] == "F32" and len(info["shape"]) == 2:
            a, b = info["data_offsets"]
            return np.frombuffer(raw[8 + size + a : 8 + size + b], "<f4").reshape(info["shape"])
    raise InkwellError("EMBED_MODEL", f"{path} holds no F32 matrix")


class StaticModel:
    """Mean of the tokens' rows, made unit length; texts without known tokens are zero."""

    def __init__(self, name: str):
        self.id, where = name, model_dir(name)
        if missing := [f for f in MODEL_FILES if not (where / f).is_file()]:
            raise InkwellError("EMBED_MODEL_MISSING", f"the model {name} is not at {where} ({', '.join(missing)} missing); put it there first")
        self.matrix = read_safetensors(where / "model.safetensors")
        spec = json.loads((where / "tokenizer.json").read_text())
        model = spec.get("model", {})
        self.unknown = model.get("unk_token")
        self.spec, self.dims = json.dumps(spec), self.matrix.shape[1]
        self._tokenizer = None

    def __getstate__(self):
        return self.__dict__ | {"_tokenizer": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        from tokenizers import Tokenizer

        if self._tokenizer is None:
            self._tokenizer = Tokenizer.from_str(self.spec)
        skip = self._tokenizer.token_to_id(self.unknown) if self.unknown else None
        out = np.zeros((len(texts), self.dims))
        for i, e in enumerate(self._tokenizer.encode_batch(texts, add_special_tokens=False)):
            ids = [k for k in e.ids if k != skip and k < len(self.matrix)]
            if ids:
                v = self.matrix[ids].astype(float).mean(0)
                out[i] = v / (np.linalg.norm(v) + 1e-32)
        return out


class ApiModel:
    """POST {url}/embeddings with a bearer key from an environment variable."""

    def __init__(self, name: str, url: str, key: str | None = None):
        self.id, self.url, self.key = name, url.rstrip("/"), key
        self.dims = None

    def embed(self, texts: list[str]) -> np.ndarray:
        headers = {"content-type": "application/json"}
        if self.key:
            if self.key not in os.environ:
                raise InkwellError("EMBED_MODEL", f"the environment variable {self.key} is not set")
            headers["authorization"] = f"Bearer {os.environ[self.key]}"
        out = []
        for at in range(0, len(texts), BATCH):
            body = json.dumps({"model": self.id, "input": texts[at : at + BATCH]}).encode()
            with urllib.request.urlopen(urllib.request.Request(f"{self.url}/embeddings", body, headers), timeout=60) as got:
                rows = sorted(json.load(got)["data"], key=lambda d: d.get("index", 0))
            out += [r["embedding"] for r in rows]
        self.dims = len(out[0]) if out else self.dims
        return np.array(out, float)


def redact_url(url: str | None) -> str | None:
    """The address without user name and password; what can't be read as an address is not shown."""
    if url is None:
        return None
    try:
        parts = urlsplit(url)
    except ValueError:
        return "(unreadable)"
    return urlunsplit(parts._replace(netloc=parts.netloc.rpartition("@")[2])) if parts.netloc else "(unreadable)" if "@" in url else url


def provider(embed: dict | None):
    if not embed:
        raise InkwellError("EMBED_DISABLED", "no model is named: the config has no embed block")
    if embed.get("type", "static") == "static":
        return StaticModel(embed["model"])
    if not embed.get("url"):
        raise InkwellError("EMBED_MODEL", "embed.type api needs embed.url")
    return ApiModel(embed["model"], embed["url"], embed.get("key"))
