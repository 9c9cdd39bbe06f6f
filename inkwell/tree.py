"""A tree of notes, indexed: open (reconcile) and the verbs search, map, peek, path, related, status, sql."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.config import FEATURES, STATE_DIR, Config
from inkwell.errors import InkwellError
from inkwell.functions import text as tx
from inkwell.functions.tokens import segment_column, segment_match
from inkwell.operators import fulltext, fusion, graph, links, overview, sections, vector
from inkwell.sources import notes as source
from inkwell.sources.models import model_dir, provider, redact_url
from inkwell.sources.store import SCHEMA_VERSION, Store, clear, gate

SEG = ("title", "summary", "text")
#: Share of the notes beyond which a reconcile resolves all links anew; the answer is the same.
CHURN = 0.2
#: A literal, a quoted name or a comment of a statement.
_QUOTED = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/"
#: The table of full-text matches in a statement.
_MATCHING = re.compile(rf"\bmatching\s*\(\s*('(?:[^'\\]|\\.|'')*'|\?)\s*\)|{_QUOTED}|\?", re.S | re.I)


class Tree:
    """One indexed tree. ``open`` reconciles; the tables are DataFrames in ``self.tables``."""

    def __init__(self, cfg: Config, spark: SparkSession):
        self.cfg, self.spark = cfg, spark
        self.store = Store(spark, cfg.base / STATE_DIR)
        self.warnings: list[str] = []
        self.tokenizer = cfg.tokenizer()

    # -- index ---------------------------------------------------------------------------------------------------

    @property
    def segmented(self) -> bool:
        """Sidecars for unspaced scripts, unless a tokenizer is named."""
        return self.cfg.tokenize is None

    def open(self) -> Tree:
        """Bring the stored tables up to the files; one reconcile of a tree at a time."""
        with self.store.writing:
            return self._reconcile()

    def _reconcile(self) -> Tree:
        began, self.warnings = time.time(), []
        listing = source.list_files(self.cfg)
        spark, meta = self.spark, self.store.meta()
        listed = spark.createDataFrame([(r["path"], float(r["_mtime"]), int(r["_size"])) for r in listing], "path string, _mtime double, _size long")
        fresh = not meta or meta.get("schema") != SCHEMA_VERSION or meta.get("signature") != self.cfg.signature()
        old = None if fresh else self.store.table("frontmatter")
        if old is not None:
            diff = overview.change_detect(listed, old.select("path", "_mtime", "_size")).collect()
            if not diff and meta.get("tokenize") == self.cfg.tokenize:
                return self._bind()
            changed = [r.path for r in diff if r.state != "vanished"]
            moved = [r.path for r in diff if r.state in ("added", "vanished")]
            gone = {r.path for r in diff}
        else:
            changed, gone, moved = [r["path"] for r in listing], set(), []
        paths = spark.createDataFrame([(p,) for p in changed], "path string")
        parsed = source.read_notes(spark, str(self.cfg.base), paths).cache()
        for r in parsed.where(F.size("warnings") > 0).select("warnings").toLocalIterator():
            self.warnings += r.warnings
        front = parsed.join(listed, "path").select("path", "_mtime", "_size", "_parse_error", "fields")
        content = parsed.select("path", "title", "summary", "text", "raw", "body")
        gone_df = spark.createDataFrame([(p,) for p in gone], "path string")
        keep = lambda name: self.store.table(name).join(gone_df, "path", "left_anti")
        if old is not None:
            front = keep("frontmatter").drop("_rank").unionByName(front)
            content = keep("content").unionByName(content)
        keys = front.select(F.explode(F.map_keys("fields"))).distinct().count()
        if keys + 5 > source.COLUMN_LIMIT:
            raise InkwellError("COLUMN_LIMIT", f"{keys} front matter keys; at most {source.COLUMN_LIMIT} columns")
        tables = {"content": content}
        # Postings of changed notes only, unless the tokenizer is another; laid out by term, so that files and row groups can be passed over.
        same = old is not None and self.store.has("postings") and meta.get("tokenize") == self.cfg.tokenize
        made = self._indexed(parsed.select("path", "title", "summary", "text") if same else content)
        tables["postings"], tables["sizes"] = made.postings, made.sizes
        if same:
            tables["postings"], tables["sizes"] = keep("postings").unionByName(made.postings), keep("sizes").unionByName(made.sizes)
        tables["postings"] = tables["postings"].repartitionByRange("term").sortWithinPartitions("term", "path")
        if self.cfg.on("links"):
            found, still = links.extract(parsed), False
            if old is not None and self.store.has("links"):
                have, own = self.store.table("links"), gone_df.withColumnRenamed("path", "src")
                rest = have.join(own, "src", "left_anti")
                # Neither notes nor links came or went: edges and ranks stand.
                still = not moved and all(d.isEmpty() for d in links.changed(have.join(own, "src", "left_semi"), found))
                if still:
                    tables["links"] = have
                elif len(gone) > CHURN * len(listing):
                    tables["links"] = links.resolve(rest.select("src", "target").unionByName(found), front.select("path"))
                else:
                    tables["links"] = links.refresh(rest, found, front.select("path"), spark.createDataFrame([(p,) for p in moved], "path string"))
            else:
                tables["links"] = links.resolve(found, front.select("path"))
        ranks = front.select("path", F.lit(None).cast("double").alias("rank"))
        if self.cfg.on("links") and self.cfg.on("rank"):
            ranks = old.select("path", F.col("_rank").alias("rank")) if still else graph.pagerank(tables["links"], front.select("path"))
        tables["frontmatter"] = front.join(ranks.withColumnRenamed("rank", "_rank"), "path", "left")
        if self.cfg.on("sections"):
            own = sections.outline(parsed)
            tables["sections"] = own if old is None or not self.store.has("sections") else keep("sections").unionByName(own)
        cover = [(p, r["path"]) for r in listing for p in r["presets"]]
        tables["preset_files"] = spark.createDataFrame(cover, "preset string, path string")
        if self.cfg.embed:
            lines = F.size(F.split("raw", "\n")) - F.size(F.split("body", "\n"))
            semantic = [n for n, p in self.cfg.presets.items() if p.get("semantic", True)]
            asked = tables["preset_files"].where(F.col("preset").isin(semantic)).select("path").distinct()
            parts = sections.chunks(parsed.join(asked, "path", "left_semi").withColumn("shift", lines), offset="shift").join(parsed.select("path", "title", "summary"), "path")
            parts = parts.withColumn("text", F.concat_ws("\n", "title", "summary", "text")).drop("title", "summary")
            parts = parts.withColumn("scale", F.lit(None).cast("double")).withColumn("q", F.lit(None).cast("array<tinyint>"))
            tables["embeddings"] = parts if old is None or not self.store.has("embeddings") else keep("embeddings").unionByName(parts)
        meta_out = {"signature": self.cfg.signature(), "tokenize": self.cfg.tokenize, "parsed": len(changed), "total": len(listing), "segmented": self.segmented}
        self.store.save(tables, **meta_out)
        self.store.note(reconcile_max_ms=max(meta.get("reconcile_max_ms", 0), round((time.time() - began) * 1000)))
        parsed.unpersist()
        return self._bind()

    def _bind(self) -> Tree:
        """Views of all tables, and the two SQL functions."""
        self.tables = {name: self.store.table(name) for name in self.store.meta()["tables"]}
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        self.wide().createOrReplaceTempView("frontmatter")
        self.fields().createOrReplaceTempView("fields")
        from pyspark.sql import types as T

        items = "from_json(field, 'array<string>')"
        self.spark.sql(
            "CREATE OR REPLACE TEMPORARY FUNCTION has(field STRING, value STRING) RETURNS INT RETURN CASE WHEN field IS NULL THEN 0 "
            f"WHEN startswith(field, '[') AND try_parse_json(field) IS NOT NULL AND {items} IS NOT NULL THEN CAST(coalesce(array_contains({items}, value), false) AS INT) ELSE CAST(contains(field, value) AS INT) END"
        )
        on = self.segmented
        self.spark.udf.register("segment", lambda q: (segment_match(q) if on else q) or "", T.StringType())
        return self

    def fields(self) -> DataFrame:
        """(path, key, value, kind) of every front matter value."""
        each = self.tables["frontmatter"].select("path", F.explode("fields").alias("key", "value"))
        kind = F.when(F.col("value").startswith('"'), "text").otherwise(overview.storage_class(F.col("value")))
        return each.withColumn("kind", kind)

    def wide(self) -> DataFrame:
        kinds = {r.field: r.types for r in overview.field_coverage(self.fields(), None).toLocalIterator()}
        return source.wide_view(self.tables["frontmatter"], sorted(kinds), kinds)

    def index(self) -> fulltext.Index:
        """The stored index: a search reads the postings of its own terms."""
        return fulltext.Index.stored(self.tables["postings"], self.tables["sizes"], self._columns(), self.tokenizer)

    def _columns(self) -> tuple[str, ...]:
        return (*SEG, *[f"{c}_seg" for c in SEG]) if self.segmented else SEG

    def _indexed(self, content: DataFrame) -> fulltext.Index:
        """The index of some notes, made anew."""
        if self.segmented:
            content = content.select("*", *[segment_column(F.col(c)).alias(f"{c}_seg") for c in SEG])
        return fulltext.Index.build(content, self._columns(), self.tokenizer)

    # -- scope ---------------------------------------------------------------------------------------------------

    def scope(self, own: dict, where: bool = True) -> DataFrame:
        """Paths in scope: the preset's coverage or the globs given, and the condition."""
        if own["globbed"]:
            out = self.tables["frontmatter"].select("path").where(source.in_scope(own["include"], own["exclude"]))
        else:
            out = self.tables["preset_files"].where(F.col("preset") == own["preset"]).select("path").distinct()
        return out.join(self._where(own["where"]), "path", "left_semi") if where and own["where"] else out

    def _where(self, condition: str) -> DataFrame:
        try:
            return self.wide().alias("f").where(F.expr(condition)).select("path")
        except Exception as e:
            raise InkwellError("SEARCH_SYNTAX", f"the where condition ({condition}) failed: {str(e).splitlines()[0]}") from None

    def note(self, name: str) -> str:
        """A note by its path, or by its name if that is unique."""
        paths = self.tables["frontmatter"].select("path")
        if not paths.where(F.col("path") == name).isEmpty():
            return name
        key = re.sub(r"(?i)\.md$", "", name.replace("\\", "/").rsplit("/", 1)[-1]).lower()
        found = [r.path for r in paths.where(tx.base_key(F.col("path")) == key).orderBy("path").limit(6).collect()]
        if len(found) == 1:
            return found[0]
        if found:
            raise InkwellError("NOTE_AMBIGUOUS", f"{name} names several notes: {', '.join(found)}")
        raise InkwellError("NOTE_NOT_FOUND", f"no note {name}")

    def _edges(self) -> DataFrame | None:
        return self.tables["links"].where("dst is not null").select("src", "dst") if "links" in self.tables else None

    # -- vectors -------------------------------------------------------------------------------------------------

    def embed_pending(self) -> None:
        """Vectors for the chunks that have none yet."""
        with self.store.writing:
            self._embed_pending()

    def _embed_pending(self) -> None:
        self.tables = {name: self.store.table(name) for name in self.store.meta()["tables"]}
        chunks = self.tables["embeddings"]
        model = provider(self.cfg.embed)
        if chunks.where("q is null").isEmpty():
            return

        def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                yield pdf.assign(v=list(model.embed(pdf.text.tolist())))[["path", "chunk", "v"]]

        todo = chunks.where("q is null").select("path", "chunk", "text").mapInPandas(vectors, "path string, chunk int, v array<double>")
        made = vector.quantize(todo, "v").select("path", "chunk", F.col("scale").alias("s"), F.col("q").alias("w"))
        full = chunks.join(made, ["path", "chunk"], "left").select("path", "chunk", "start_line", "end_line", "text", F.coalesce("scale", "s").alias("scale"), F.coalesce("q", "w").alias("q"))
        meta = {k: v for k, v in self.store.meta().items() if k not in ("version", "previous", "tables", "schema")}
        self.store.save(self.tables | {"embeddings": full}, **meta)
        self.tables = {name: self.store.table(name) for name in self.store.meta()["tables"]}
        self.tables["embeddings"].createOrReplaceTempView("embeddings")

    # -- verbs ---------------------------------------------------------------------------------------------------

    def search(self, terms: str, **own) -> list[dict]:
        """Ranked notes: path, title, summary, hit, via, score, lines, and similarity where vectors ran."""
        asked = self.cfg.resolve(**own)
        k, files = asked["k"], self.tables["frontmatter"].select("path")
        scope = self.scope(asked, where=False)
        narrow = scope.count() < files.count()
        fetch = fusion.fetch_size(k, narrow)
        query = segment_match(terms) if self.segmented else terms
        index = self.index()
        node = index.parse(query)
        words = [w for p in fulltext.phrases_of(index.parse(terms)) for w in p.words]
        scored = index.score(node)
        condition = self._where(asked["where"]) if asked["where"] else None
        if condition is not None:
            scored = scored.join(condition, "path", "left_semi")
        matches = scored.orderBy("score", "path").limit(fetch).join(scope, "path", "left_semi")
        matches = fusion.numbered(matches, ["score", "path"]).cache()
        edges, around, touching = self._edges(), None, None
        if edges is not None and not matches.isEmpty() and not edges.isEmpty():
            ranks = graph.personalized(edges, matches.select("path", (1.0 / (F.col("i") + 1)).alias("weight")), files)
            ranks = ranks.where(F.col("rank") > fusion.LINK_FLOOR).join(scope, "path", "left_semi").orderBy(F.desc("rank"), "path").limit(fetch)
            around = fusion.numbered(ranks, [F.desc("rank"), "path"])
            touching = graph.both_ways(edges).select(F.col("src").alias("path"))
        near = None
        if asked["semantic"] and self.cfg.embed:
            self.embed_pending()
            words = [w for w in re.findall(r"[^\W_]+", terms) if w not in ("AND", "OR", "NOT", "NEAR")]
            v = provider(self.cfg.embed).embed([" ".join(words)])[0][: vector.DIMS]
            v = v / (np.linalg.norm(v) + 1e-32)
            one = self.spark.createDataFrame([([float(x) for x in v],)], "vector array<double>")
            chunks = self.tables["embeddings"].where("q is not null")
            if not chunks.join(scope, "path", "left_semi").isEmpty():
                best = vector.best_chunks(chunks, one).orderBy(F.desc("score"), "path").limit(fetch).join(scope, "path", "left_semi")
                near = fusion.numbered(best, [F.desc("score"), "path"])
        fused = fusion.fuse(matches, around, near, touching)
        if condition is not None:
            fused = fused.join(condition, "path", "left_semi")
        top = fused.orderBy(F.desc("score"), "path").limit(k).join(self.tables["content"].select("path", "title", "summary", "text", "raw"), "path")
        if near is not None:
            places = near.join(self.tables["embeddings"], ["path", "chunk"]).select("path", F.concat("start_line", F.lit("-"), "end_line").alias("lines"), vector.similarity(F.col("score")).alias("similarity"))
            top = top.join(places, "path", "left")
        rows = top.orderBy(F.desc("score"), "path").collect()
        matches.unpersist()
        return [self._row(r, words, near is not None) for r in rows]

    def _row(self, r, terms: list[str], vectors: bool) -> dict:
        matched, lines = r.via.startswith("match"), r.lines if vectors else None
        long = len(r.text) > tx.SNIPPET_LIMIT
        stems = [s for t in terms for s in {t, *self.tokenizer.tokens(t)} if s]
        hit, at = fulltext.excerpt(r.raw if long else r.text, stems) if matched else (None, 0)
        if matched and long and lines is None and "sections" in self.tables:
            line = r.raw[:at].count("\n") + 1
            own = [s for s in self.tables["sections"].where((F.col("path") == r.path) & F.lit(line).between(F.col("start_line"), F.col("end_line"))).collect()]
            lines = max(((s.start_line, f"{s.start_line}-{s.end_line}") for s in own), default=(0, None))[1]
        out = {"path": r.path, "title": r.title, "summary": r.summary, "hit": hit, "via": r.via, "score": float(np.floor(r.score * 1e4 + 0.5) / 1e4), "lines": lines}
        return out | ({"similarity": r.similarity} if vectors else {})

    def features(self) -> dict:
        return {"on": [f for f in FEATURES if self.cfg.on(f)], "off": [f for f in FEATURES if not self.cfg.on(f)]}

    def preset_coverage(self) -> list[dict]:
        embedded = self.tables["embeddings"].where("q is not null") if "embeddings" in self.tables else None
        got = {r.preset: r for r in overview.preset_coverage(list(self.cfg.presets), self.tables["preset_files"], embedded).collect()}
        return [{"name": n, "files": got[n].files, "embedded": got[n].embedded, "semantic": p.get("semantic", True)} for n, p in self.cfg.presets.items()]

    def map(self, **own) -> dict:
        """Totals, fields, features, presets, hubs and recent notes of a scope."""
        scope = self.scope(self.cfg.resolve(**own))
        front = self.tables["frontmatter"].join(scope, "path", "left_semi")
        total = overview.totals(front).first()
        each = overview.field_coverage(self.fields().join(scope, "path", "left_semi"), None)
        fields = each.orderBy(F.desc("count"), "field").limit(overview.FIELDS_SHOWN).collect()
        titles = self.tables["content"].select("path", "title")
        hubs: list = []
        if self.cfg.on("links") and self.cfg.on("rank"):
            best = front.where("_rank is not null").orderBy(F.desc("_rank"), "path").limit(overview.HUBS_SHOWN).join(titles, "path").orderBy(F.desc("_rank"), "path")
            hubs = [{"path": r.path, "title": r.title, "rank": float(np.floor(r._rank * 1e4 + 0.5) / 100)} for r in best.collect()]
        late = overview.recent(front).select("path", tx.epoch_text(F.col("_mtime")).alias("modified")).collect()
        return {
            "docs": {"count": total.docs, "bytes": total.bytes}, "fields": [r.asDict() for r in fields], "fieldsTotal": each.count(), "features": self.features(),
            "presets": self.preset_coverage(), "hubs": hubs, "recent": [r.asDict() for r in late],
        }

    def peek(self, name: str, **own) -> dict:
        """One note: fields, tokens, outline, links both ways, each list bounded with its total. Scope is only checked."""
        self.cfg.resolve(**own)
        path, most = self.note(name), overview.PEEK_SHOWN
        is_it = F.col("path") == path
        row = self.tables["frontmatter"].where(is_it).first()
        wide = self.wide().where(is_it).first().asDict()
        out = {"path": path, "tokens": -(-row._size // 4), "frontmatter": {k: v for k, v in wide.items() if v is not None and not k.startswith("_") and k != "path"}, "parseError": row._parse_error}

        def bounded(df: DataFrame | None, order: str, key: str, one: bool = True) -> None:
            rows = df.orderBy(order).limit(most).collect() if df is not None else []
            out[key] = [r[0] for r in rows] if one else [r.asDict() for r in rows]
            out[key + "Total"] = df.count() if df is not None else 0

        have = self.tables.get("links")
        bounded(self.tables["sections"].where(is_it).select("idx", "level", "heading", "start_line", "end_line", "tokens") if "sections" in self.tables else None, "idx", "sections", False)
        mine = have.where(F.col("src") == path) if have is not None else None
        bounded(mine.where("dst is not null").select("dst").distinct() if mine is not None else None, "dst", "outbound")
        bounded(have.where(F.col("dst") == path).select("src").distinct() if have is not None else None, "src", "backlinks")
        bounded(mine.where("dst is null").select("target") if mine is not None else None, "target", "unresolved")
        return out | {"off": self.features()["off"]}

    def path(self, a: str, b: str, max_depth: int | None = None, **own) -> list[str] | None:
        """Notes of a shortest path of links, taken either way, inside the scope."""
        start, target = self.note(a), self.note(b)
        edges = self._edges()
        if edges is None:
            return [start] if start == target else None
        asked = self.cfg.resolve(**own)
        allowed = self.scope(asked) if own.get("preset") or asked["globbed"] or asked["where"] else None
        return graph.shortest_path(edges, start, target, max_depth=max_depth, allowed=allowed)

    def related(self, name: str, k: int | None = None, **own) -> list[dict]:
        """Notes alike by their vectors that no link joins to this one."""
        asked, path = self.cfg.resolve(**own), self.note(name)
        if not self.cfg.embed:
            raise InkwellError("EMBED_DISABLED", "related needs vectors: the config names no model")
        if not asked["semantic"]:
            raise InkwellError("PRESET_NOT_SEMANTIC", f"the preset {asked['preset']} has semantic off")
        self.embed_pending()
        chunks = self.tables["embeddings"].where("q is not null")
        if chunks.where(F.col("path") == path).isEmpty():
            raise InkwellError("NOTE_NOT_EMBEDDED", f"{path} has no text to compare")
        edges = self._edges()
        known = None
        if edges is not None:
            known = edges.where(F.col("src") == path).select(F.col("dst").alias("path")).union(edges.where(F.col("dst") == path).select("src")).distinct()
        found = vector.similar(chunks, path, known, self.scope(asked)).orderBy(F.desc("score"), "path").limit(k or 5)
        return [r.asDict() for r in found.select("path", vector.similarity(F.col("score")).alias("similarity")).collect()]

    def sql(self, statement: str, parameters: list | None = None, preset: str | None = None) -> DataFrame:
        """A query over all tables; with ``preset``, its paths are the view ``scope``.

        ``matching('terms')`` or ``matching(?)`` is a table (path, score) of the notes that match a full-text query.
        """
        if preset is not None:
            if not re.search(r"\bscope\b", statement):
                raise InkwellError("PRESET_UNKNOWN", "a preset was named, but the statement never mentions scope")
            self.scope(self.cfg.resolve(preset=preset)).createOrReplaceTempView("scope")
        if not re.match(r"\s*(--[^\n]*\n\s*|\()*\s*(select|with|values|describe|desc|show|explain|from|table)\b", statement, re.I):
            raise InkwellError("SEARCH_SYNTAX", "only queries are allowed here")
        statement, parameters = self._with_matches(statement, list(parameters or []))
        return self.spark.sql(statement, args=parameters or None)

    def _with_matches(self, statement: str, parameters: list) -> tuple[str, list]:
        """The statement with a view in place of each ``matching(…)``, and the parameters that are left."""
        left = iter(parameters)
        kept: list = []

        def view(m: re.Match) -> str:
            if m[1] is None:
                if m[0] == "?":
                    kept.extend(x for _, x in zip(range(1), left))  # noqa: B905
                return m[0]
            terms = next(left, "") if m[1] == "?" else m[1][1:-1].replace("''", "'")
            name = f"matched_{uuid.uuid4().hex}"
            self._matches(str(terms)).createOrReplaceTempView(name)
            return name

        out = _MATCHING.sub(view, statement)
        return out, [*kept, *left]

    @staticmethod
    def placeholders(statement: str) -> int:
        """Positional parameters of a statement, outside of its literals, quoted names and comments."""
        return re.sub(_QUOTED, " ", statement, flags=re.S).count("?")

    def matching(self, terms: str) -> DataFrame:
        """Full-text matches (path, score) as a table for SQL: also the view ``matched``."""
        found = self._matches(terms)
        found.createOrReplaceTempView("matched")
        return found

    def _matches(self, terms: str) -> DataFrame:
        return self.index().search(segment_match(terms) if self.segmented else terms)

    def saved(self, name: str, parameters: list | None = None, **own):
        """A saved query by name: rows of a search, or the DataFrame of a statement."""
        entry = self.cfg.queries[name]
        if "sql" in entry:
            return self.sql(entry["sql"], parameters, own.get("preset"))
        given = {k: v for k, v in own.items() if v is not None}
        return self.search(entry["search"], **({k: entry[k] for k in ("preset", "include", "exclude", "where", "k") if k in entry} | given))

    def status(self) -> dict:
        watcher, e = self.store.watcher(), self.cfg.embed
        vectors = None
        if "embeddings" in self.tables:
            n = self.tables["embeddings"].agg(F.count("q").alias("embedded"), (F.count("*") - F.count("q")).alias("pending")).first()
            vectors = n.asDict()
        front = self.tables["frontmatter"].agg(F.count("*").alias("docs"), F.count("_parse_error").alias("bad")).first()
        present = bool(e) and (e.get("type") == "api" or all((model_dir(e["model"]) / f).is_file() for f in ("model.safetensors", "tokenizer.json")))
        return {
            "config": str(self.cfg.path), "tree": str(self.cfg.base), "cache": str(self.store.directory), "docs": front.docs, "unparseableFrontmatter": front.bad, "features": self.features(),
            "embed": e and {"type": e.get("type", "static"), "model": e["model"], "url": redact_url(e.get("url")), "present": present, "vectors": vectors}, "presets": self.preset_coverage(), "queries": len(self.cfg.queries),
            "watcherPid": watcher.get("pid"), "watcherHeartbeatSecondsAgo": round(time.time() - watcher["beat"]) if watcher else None,
        }


def open_tree(cfg: Config, spark: SparkSession) -> Tree:
    """Reconcile the index with the files, and bind the views."""
    return Tree(cfg, spark).open()


def clear_cache(cfg: Config) -> None:
    directory = Path(cfg.base) / STATE_DIR
    if directory.is_dir():
        with gate(directory.resolve() / "writer.lock"):
            clear(directory)
