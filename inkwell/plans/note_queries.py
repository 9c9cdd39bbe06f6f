"""Registered queries over notes, each by the library's operator, with its DuckDB form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.functions.tokens import Tokenizer
from inkwell.operators import fulltext, fusion, graph, links, overview, sections, vector
from inkwell.plans.corpus import corpus
from inkwell.plans.synthetic import LINKS_SQL, NOTES_SQL, PRESETS, TOKENS_SQL, notes
from inkwell.session import cut

PLAIN = "unicode61 remove_diacritics 0"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _index(spark: SparkSession, sf_dir: str) -> fulltext.Index:
    return fulltext.Index.build(notes(spark, sf_dir), tokenizer=Tokenizer(PLAIN))


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = notes(spark, sf_dir).select("path", "body")
    return links.resolve(links.extract(n), n), n


def _bm25_sql(words: list[str]) -> str:
    """Scores of notes with any of the words."""
    return f"""
f AS (SELECT path, term, sum(CASE col WHEN 'title' THEN 10.0 WHEN 'summary' THEN 5.0 ELSE 1.0 END) AS f FROM tokens WHERE term IN ({", ".join(f"'{w}'" for w in words)}) GROUP BY path, term),
df AS (SELECT term, count(*) AS have FROM f GROUP BY term), st AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes),
scored AS (SELECT f.path, -sum(greatest(ln((n - have + 0.5) / (have + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))) AS score
  FROM f JOIN df ON f.term = df.term JOIN sizes ON f.path = sizes.path, st GROUP BY f.path)"""


WORDS = ["erthand", "thing", "pour", "para", "ist"]


@query("WITH " + TOKENS_SQL + "," + _bm25_sql(WORDS) + " SELECT path, round(score, 6) AS score FROM scored ORDER BY round(score, 9), path LIMIT 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _index(spark, sf_dir).search(" OR ".join(WORDS))
    return found.orderBy(F.round("score", 9), "path").limit(10).select("path", F.round("score", 6).alias("score"))


_HAS = "SELECT path FROM tokens WHERE term = '{}'"


def _match(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = _index(spark, sf_dir)
        return index.match(index.parse(text)).select("path")

    run.__name__ = name
    run.__doc__ = f"Notes that match {text!r}."
    query("WITH " + TOKENS_SQL + sql)(run)


_match("match_and", "thing AND that", f" {_HAS.format('thing')} INTERSECT {_HAS.format('that')}")
_match("match_or", "thing OR para", f" {_HAS.format('thing')} UNION {_HAS.format('para')}")
_match("match_implicit_and", "thing that the", f" {_HAS.format('thing')} INTERSECT {_HAS.format('that')} INTERSECT {_HAS.format('the')}")
_match("match_not", "the NOT thing", f" {_HAS.format('the')} EXCEPT {_HAS.format('thing')}")
_match("match_nested", "(the OR des) NOT (thing OR pour)", f" ({_HAS.format('the')} UNION {_HAS.format('des')}) EXCEPT ({_HAS.format('thing')} UNION {_HAS.format('pour')})")
_match("match_phrase", '"of the"', " SELECT DISTINCT a.path FROM tokens a JOIN tokens b ON a.path = b.path AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
_match("match_phrase3", '"en note of"', " SELECT DISTINCT a.path FROM tokens a JOIN tokens b ON a.path = b.path AND a.col = b.col AND b.pos = a.pos + 1 JOIN tokens c ON a.path = c.path AND a.col = c.col AND c.pos = a.pos + 2 WHERE a.term = 'en' AND b.term = 'note' AND c.term = 'of'")
_match("match_prefix", "thin*", " SELECT DISTINCT path FROM tokens WHERE starts_with(term, 'thin')")
_match("match_near", "NEAR(thing that, 5)", " SELECT DISTINCT a.path FROM tokens a JOIN tokens b ON a.path = b.path AND a.col = b.col WHERE a.term = 'thing' AND b.term = 'that' AND abs(a.pos - b.pos) - 1 <= 5")
_match("match_column", "title: the", " SELECT DISTINCT path FROM tokens WHERE term = 'the' AND col = 'title'")
_match("match_not_column", "-text: src3", " SELECT DISTINCT path FROM tokens WHERE term = 'src3' AND col <> 'text'")
_match("match_first", "^the", " SELECT DISTINCT path FROM tokens WHERE term = 'the' AND pos = 0")


@query("WITH " + NOTES_SQL + " SELECT path FROM notes WHERE contains(lower(text), 'thing')")
def trigram_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fulltext.Index.build(notes(spark, sf_dir), ("text",), Tokenizer("trigram"))
    return index.match(index.parse('"thing"')).select("path")


_LINES = r""",
ln AS (SELECT path, unnest(string_split({0}, chr(10))) AS text, generate_subscripts(string_split({0}, chr(10)), 1) AS line FROM notes),
fl AS (SELECT *, regexp_matches(text, '^(#{{1,6}}) +(.*)') AND sum(CASE WHEN regexp_matches(text, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) % 2 = 0 AS heading FROM ln)"""


@query(
    "WITH " + NOTES_SQL + _LINES.format("raw") + r""",
cs AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY path ORDER BY line) AS chars, max(line) OVER (PARTITION BY path) AS lines FROM fl),
ac AS (SELECT *, max(chars) OVER (PARTITION BY path) AS all_chars, chars - length(text) - 1 AS bef FROM cs)
SELECT path, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, CAST(length(regexp_extract(text, '^(#{1,6}) +(.*)', 1)) AS INTEGER) AS level, trim(regexp_extract(text, '^(#{1,6}) +(.*)', 2)) AS heading,
  CAST(line AS INTEGER) AS start_line, CAST(coalesce(lead(line) OVER w - 1, lines) AS INTEGER) AS end_line,
  CAST(ceil((coalesce(lead(bef) OVER w, all_chars) - bef - 1) / 4) AS BIGINT) AS tokens
FROM ac WHERE heading WINDOW w AS (PARTITION BY path ORDER BY line)"""
)
def sections_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.outline(notes(spark, sf_dir))


@query(
    "WITH " + NOTES_SQL + _LINES.format("body") + r""",
pt AS (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS part FROM fl),
ch AS (SELECT path, part, min(line) AS start_line, max(line) AS end_line, string_agg(text, chr(10) ORDER BY line) AS text FROM pt GROUP BY path, part)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY part) - 1 AS INTEGER) AS chunk, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(length(text) AS INTEGER) AS chars FROM ch WHERE regexp_matches(text, '\S')"""
)
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.chunks(notes(spark, sf_dir)).select("path", "chunk", "start_line", "end_line", F.length("text").alias("chars"))


@query("WITH " + LINKS_SQL + " SELECT src, target, target_base, dst FROM links")
def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)[0]


@query("WITH " + LINKS_SQL + " SELECT src, target, target_base, dst FROM links")
def links_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved links after a third of the notes came, a tenth went and a seventh was read anew: as if all were resolved now."""
    n = notes(spark, sf_dir).select("path", "body", "doc_id")
    gone = n.where("doc_id % 10 = 3").select(F.concat("path", F.lit("-gone.md")).alias("path"), "body")
    came, anew = F.col("doc_id") % 3 == 0, F.col("doc_id") % 7 == 1
    before = n.where(~came).select("path", "body").unionByName(gone)
    stored = links.resolve(links.extract(before), before)
    moved = n.where(came).select("path").unionByName(gone.select("path"))
    rest = stored.join(n.where(~came & ~anew).select(F.col("path").alias("src")), "src", "left_semi")
    return links.refresh(rest, links.extract(n.where(came | anew)), n, moved)


@query("WITH " + LINKS_SQL + " SELECT src, target FROM links WHERE dst IS NULL AND NOT regexp_matches(lower(target), '\\.[a-z0-9]')")
def dead_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.dead(_links(spark, sf_dir)[0], attachments=False).select("src", "target")


@query("WITH " + LINKS_SQL + " SELECT dst, count(DISTINCT src) AS backlinks FROM links WHERE dst IS NOT NULL GROUP BY dst ORDER BY backlinks DESC, dst LIMIT 20")
def backlinks_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.backlinks(_links(spark, sf_dir)[0]).orderBy(F.desc("backlinks"), "dst").limit(20)


@query("WITH " + LINKS_SQL + " SELECT path FROM notes WHERE path NOT IN (SELECT dst FROM links WHERE dst IS NOT NULL)")
def uncited_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _links(spark, sf_dir)
    return n.select("path").join(found.where("dst is not null").select(F.col("dst").alias("path")), "path", "left_anti")


@query("WITH " + LINKS_SQL + " SELECT path FROM notes WHERE path NOT IN (SELECT dst FROM links WHERE dst IS NOT NULL UNION SELECT src FROM links WHERE dst IS NOT NULL)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _links(spark, sf_dir)
    return links.orphans(found, n)


@query("WITH " + LINKS_SQL + ", live AS (SELECT DISTINCT src, dst FROM links WHERE dst IS NOT NULL) SELECT a.dst AS a, b.dst AS b, count(*) AS together FROM live a JOIN live b ON a.src = b.src AND a.dst < b.dst GROUP BY a.dst, b.dst")
def co_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.co_citation(_links(spark, sf_dir)[0])


@query("WITH " + LINKS_SQL + " SELECT src, target, CASE WHEN src < 'src5' THEN 'insert' ELSE 'delete' END AS op FROM links WHERE target NOT LIKE 'doc-%'")
def edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _links(spark, sf_dir)
    low, doc = F.col("src") < "src5", F.col("target").like("doc-%")
    old, new = found.where(~low | doc), found.where(low | doc)
    gone, added = links.changed(old, new)
    return gone.select("src", "target", F.lit("delete").alias("op")).unionByName(added.select("src", "target", F.lit("insert").alias("op")))


def _power_sql(nodes: str, edges: str, base: str, damping: float, iterations: int) -> str:
    """PageRank unrolled, a CTE an iteration."""
    out = [f"nodes AS MATERIALIZED ({nodes})", f"edges AS MATERIALIZED ({edges})", f"base AS MATERIALIZED ({base})", "deg AS MATERIALIZED (SELECT src, count(*) AS out FROM edges GROUP BY src)", "r0 AS MATERIALIZED (SELECT path, w AS rank FROM base)"]
    for k in range(iterations):
        out.append(
            f"r{k + 1} AS MATERIALIZED (SELECT base.path, {1 - damping} * w + {damping} * (coalesce(got, 0) + lost * w) AS rank FROM base "
            f"LEFT JOIN (SELECT dst, sum(rank / out) AS got FROM edges JOIN deg ON edges.src = deg.src JOIN r{k} ON r{k}.path = edges.src GROUP BY dst) g ON g.dst = base.path, "
            f"(SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE path NOT IN (SELECT src FROM deg)) l)"
        )
    return ",\n".join(out)


_RANKS = "WITH " + LINKS_SQL + "," + _power_sql("SELECT path FROM notes", "SELECT src, dst FROM links WHERE dst IS NOT NULL", "SELECT path, 1.0 / (SELECT count(*) FROM nodes) AS w FROM nodes", 0.85, 30)


@query(_RANKS + " SELECT path, round(rank, 8) AS rank FROM r30")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _links(spark, sf_dir)
    return graph.pagerank(found, n).select("path", F.round("rank", 8).alias("rank"))


@query(_RANKS + " SELECT path, round(rank * 100, 6) AS rank FROM r30 ORDER BY round(rank, 10) DESC, path LIMIT 8")
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _links(spark, sf_dir)
    ranks = graph.pagerank(found, n).withColumn("rank", F.round("rank", 10))
    return overview.hubs(ranks).select("path", F.round(F.col("rank") * 100, 6).alias("rank"))


_SEEDS = "SELECT path, 1.0 / (1 + doc_id) AS weight FROM notes WHERE doc_id < 10"


@query(
    "WITH " + LINKS_SQL + "," + _power_sql("SELECT path FROM notes", "SELECT src, dst FROM links WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM links WHERE dst IS NOT NULL", f"SELECT nodes.path, coalesce(weight, 0) / (SELECT sum(weight) FROM ({_SEEDS})) AS w FROM nodes LEFT JOIN ({_SEEDS}) s ON s.path = nodes.path", 0.7, 15) + " SELECT path, round(rank, 8) AS rank FROM r15 WHERE rank > 1e-9"
)
def personalized_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _links(spark, sf_dir)
    seeds = notes(spark, sf_dir).where("doc_id < 10").select("path", (1.0 / (1 + F.col("doc_id"))).alias("weight"))
    return graph.personalized(found, seeds, n).where("rank > 1e-9").select("path", F.round("rank", 8).alias("rank"))


@query(
    "WITH RECURSIVE " + LINKS_SQL + """,
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM links WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM links WHERE dst IS NOT NULL)),
hop(path, depth) AS (SELECT min(path), 0 FROM notes UNION SELECT e.dst, depth + 1 FROM hop JOIN e ON hop.path = e.src WHERE depth < 4)
SELECT path, min(depth) AS depth FROM hop GROUP BY path"""
)
def shortest_path_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _links(spark, sf_dir)
    start = n.agg(F.min("path")).first()[0]
    return graph.rings(found, start, max_depth=4).select("path", "depth")


@query(
    "WITH RECURSIVE " + LINKS_SQL + """,
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM links WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM links WHERE dst IS NOT NULL)),
hop(path, depth) AS (SELECT min(path), 0 FROM notes UNION SELECT e.dst, depth + 1 FROM hop JOIN e ON hop.path = e.src WHERE depth < 4),
near AS MATERIALIZED (SELECT path, min(depth) AS depth FROM hop GROUP BY path)
SELECT n.path, n.depth, min(e.src) FILTER (WHERE p.depth = n.depth - 1) AS pred FROM near n LEFT JOIN e ON e.dst = n.path LEFT JOIN near p ON p.path = e.src GROUP BY n.path, n.depth"""
)
def shortest_path_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least note before each on a shortest path."""
    found, n = _links(spark, sf_dir)
    return graph.rings(found, n.agg(F.min("path")).first()[0], max_depth=4)


@query(
    "WITH RECURSIVE " + LINKS_SQL + """,
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM links WHERE dst IS NOT NULL),
hop(path, depth) AS (SELECT min(path), 0 FROM notes UNION SELECT e.dst, depth + 1 FROM hop JOIN e ON hop.path = e.src WHERE depth < 2)
SELECT path, min(depth) AS depth FROM hop GROUP BY path HAVING min(depth) > 0"""
)
def khop2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _links(spark, sf_dir)
    return graph.neighbourhood(found, n.agg(F.min("path")).first()[0], 2, directed=True)


_UNITS = """u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-32 AS len FROM u),
s AS (SELECT vec_id, list_transform(v, lambda x: x / len) AS v FROM n),
z AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS top FROM s),
q AS (SELECT vec_id, v, CASE WHEN top > 0 THEN top / 127 ELSE 1.0 END AS scale FROM z),
c AS (SELECT 'note-' || (vec_id // 3) AS path, CAST(vec_id % 3 AS INTEGER) AS chunk, vec_id, scale, list_transform(v, lambda x: CAST(floor(x / scale + 0.5) AS DOUBLE)) AS q FROM q)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.select(F.concat(F.lit("note-"), F.floor(F.col("vec_id") / 3)).alias("path"), (F.col("vec_id") % 3).cast("int").alias("chunk"), "vec_id", "embedding")
    return vector.quantize(rows, "embedding").drop("embedding")


@query(f"WITH {_UNITS} SELECT vec_id, round(scale, 9) AS scale, CAST(list_sum(q) AS BIGINT) AS total, CAST(list_sum(list_transform(q, lambda x: abs(x))) AS BIGINT) AS size FROM c")
def int8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    add = lambda f: F.reduce("q", F.lit(0).cast("long"), lambda n, x: n + f(x.cast("long")))
    return _chunks(spark, sf_dir).select("vec_id", F.round("scale", 9).alias("scale"), add(lambda x: x).alias("total"), add(F.abs).alias("size"))


@query(
    f"WITH {_UNITS}, one AS (SELECT v FROM s WHERE vec_id = (SELECT min(vec_id) FROM s)), "
    "g AS (SELECT path, chunk, list_inner_product(q, v) * scale AS score FROM c, one), "
    "b AS (SELECT path, chunk, score FROM g QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk) = 1) "
    "SELECT path, chunk, round(score, 6) AS score FROM b ORDER BY round(score, 9) DESC, path LIMIT 20"
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = rows.orderBy("vec_id").limit(1).select(vector.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("vector"))
    best = vector.best_chunks(_chunks(spark, sf_dir), one)
    return best.orderBy(F.desc(F.round("score", 9)), "path").limit(20).select("path", "chunk", F.round("score", 6).alias("score"))


@query(
    f"WITH {_UNITS}, g AS (SELECT o.path, max(list_inner_product(o.q, k.q) * o.scale * k.scale) AS score FROM c o, c k WHERE k.path = 'note-0' AND o.path <> 'note-0' GROUP BY o.path) "
    "SELECT path, floor(greatest(-1.0, least(1.0, score)) * 1000 + 0.5) / 1000 AS similarity FROM g ORDER BY round(score, 9) DESC, path LIMIT 10"
)
def similar_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.similar(_chunks(spark, sf_dir), "note-0").orderBy(F.desc(F.round("score", 9)), "path").limit(10)
    return found.select("path", vector.similarity(F.col("score")).alias("similarity"))


@query(
    "WITH " + TOKENS_SQL + LINKS_SQL[len(NOTES_SQL):] + "," + _bm25_sql(WORDS) + """,
m AS MATERIALIZED (SELECT path, row_number() OVER (ORDER BY round(score, 9), path) - 1 AS i FROM scored ORDER BY round(score, 9), path LIMIT 30),""" + _power_sql("SELECT path FROM notes", "SELECT src, dst FROM links WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM links WHERE dst IS NOT NULL", "SELECT nodes.path, coalesce(1.0 / (i + 1), 0) / (SELECT sum(1.0 / (i + 1)) FROM m) AS w FROM nodes LEFT JOIN m ON m.path = nodes.path", 0.7, 15) + """,
l AS (SELECT path, row_number() OVER (ORDER BY round(rank, 12) DESC, path) - 1 AS i FROM r15 WHERE rank > 1e-9 ORDER BY round(rank, 12) DESC, path LIMIT 30),
a AS (SELECT path, i, 'match' AS k FROM m UNION ALL SELECT path, i, 'link' FROM l),
z AS (SELECT path, sum(1.0 / (60 + i)) AS score, bool_or(k = 'match') AS ism, bool_or(k = 'link') AS isl FROM a GROUP BY path)
SELECT path, round(score, 4) AS score, CASE WHEN ism AND isl AND path IN (SELECT src FROM edges) THEN 'match+link' WHEN ism THEN 'match' ELSE 'link' END AS via FROM z ORDER BY round(score, 9) DESC, path LIMIT 10"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole lexical search: match list, link list from its ranks, fusion."""
    found, n = _links(spark, sf_dir)
    # Read several times below: written once, as the tree stores them.
    live = cut(found.where("dst is not null").select("src", "dst"))
    scored = _index(spark, sf_dir).search(" OR ".join(WORDS)).withColumn("o", F.round("score", 9))
    fetch = fusion.fetch_size(10, False)
    matches = cut(fusion.numbered(scored.orderBy("o", "path").limit(fetch), ["o", "path"]))
    ranks = graph.personalized(live, matches.select("path", (1.0 / (F.col("i") + 1)).alias("weight")), n).where(F.col("rank") > fusion.LINK_FLOOR).withColumn("o", F.round("rank", 12))
    around = fusion.numbered(ranks.orderBy(F.desc("o"), "path").limit(fetch), [F.desc("o"), "path"])
    touching = graph.both_ways(live).select(F.col("src").alias("path"))
    out = fusion.fuse(matches, around, None, touching)
    return out.orderBy(F.desc(F.round("score", 9)), "path").limit(10).select("path", F.round("score", 4).alias("score"), "via")


@query("WITH " + NOTES_SQL + " SELECT path, CAST(contains(tags, '\"en\"') AS INTEGER) AS tagged, CAST(contains(title, 'th') AS INTEGER) AS titled, CASE WHEN status IS NULL THEN 0 ELSE CAST(contains(status, 'act') AS INTEGER) END AS active FROM notes")
def has_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    return n.select("path", tx.has(F.col("tags"), F.lit("en")).alias("tagged"), tx.has(F.col("title"), F.lit("th")).alias("titled"), tx.has(F.col("status"), F.lit("act")).alias("active"))


@query("WITH " + NOTES_SQL + " SELECT tag, count(*) AS notes FROM (SELECT unnest(from_json(tags, '[\"VARCHAR\"]')) AS tag FROM notes) GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select(F.explode(F.from_json("tags", "array<string>")).alias("tag")).groupBy("tag").agg(F.count("*").alias("notes"))


def _fields(n: DataFrame) -> DataFrame:
    value = F.create_map(F.lit("title"), F.col("title"), F.lit("tags"), F.col("tags"), F.lit("status"), F.col("status"), F.lit("doc_id"), F.col("doc_id").cast("string"))
    each = n.select("path", F.explode(value).alias("key", "value")).where("value is not null")
    return each.select("path", "key", overview.storage_class(F.col("value")).alias("kind"))


@query("WITH " + NOTES_SQL + """, f AS (SELECT 'title' AS field, title AS v FROM notes UNION ALL SELECT 'tags', tags FROM notes UNION ALL SELECT 'status', status FROM notes UNION ALL SELECT 'doc_id', CAST(doc_id AS VARCHAR) FROM notes),
k AS (SELECT field, CASE WHEN regexp_matches(v, '^-?\\d+$') THEN 'integer' WHEN regexp_matches(v, '^-?\\d+(\\.\\d+)?([eE][+-]?\\d+)?$') THEN 'real' ELSE 'text' END AS kind FROM f WHERE v IS NOT NULL)
SELECT field, count(*) AS count, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types FROM k GROUP BY field""".replace("\\\\", "\\"))
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.field_coverage(_fields(notes(spark, sf_dir)))


_PRESET_SQL = " UNION ALL ".join(f"SELECT '{k}' AS preset, path FROM notes WHERE {v}" for k, v in PRESETS.items())


def _preset_files(n: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [n.where(v).select(F.lit(k).alias("preset"), "path") for k, v in PRESETS.items()])


@query("WITH " + NOTES_SQL + f", p AS ({_PRESET_SQL}) SELECT preset, count(*) AS files, count(*) FILTER (WHERE p.path IN (SELECT path FROM notes WHERE status = 'active')) AS embedded FROM p GROUP BY preset UNION ALL SELECT 'nothing', 0, 0")
def preset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    return overview.preset_coverage([*PRESETS, "nothing"], _preset_files(n), n.where("status = 'active'"))


@query("WITH " + NOTES_SQL + " SELECT count(*) AS docs, CAST(sum(_size) AS BIGINT) AS bytes FROM notes")
def tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.totals(notes(spark, sf_dir))


@query("WITH " + NOTES_SQL + " SELECT path, strftime(epoch_ms(CAST(_mtime AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS modified FROM notes ORDER BY _mtime DESC, path LIMIT 5")
def recent_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.recent(notes(spark, sf_dir).select("path", "_mtime")).select("path", tx.epoch_text(F.col("_mtime")).alias("modified"))


@query("WITH " + NOTES_SQL + r" SELECT path, replace(substr(created, 1, 19), ' ', 'T') || regexp_replace(substr(created, 20), '^([+-]\d\d)(\d\d)$', '\1:\2') AS created FROM notes")
def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("path", tx.normalize_date(F.col("created")).alias("created"))


@query("WITH " + NOTES_SQL + r""", i AS (SELECT path, strftime(CAST(substr(created, 1, 19) AS TIMESTAMP) - CASE substr(created, 20) WHEN '-0800' THEN INTERVAL (-480) MINUTE WHEN '+0530' THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%d %H:%M:%S') AS utc FROM notes)
SELECT path, utc FROM i WHERE utc >= '2024-01-10 00:00:00' AND utc < '2024-01-12 00:00:00'""")
def datetime_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = notes(spark, sf_dir).select("path", tx.datetime_utc(tx.normalize_date(F.col("created"))).alias("utc"))
    return at.where("utc >= '2024-01-10 00:00:00' and utc < '2024-01-12 00:00:00'")


@query("WITH " + NOTES_SQL + " SELECT path, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 10 = 1 THEN 'vanished' ELSE 'changed' END AS state FROM notes WHERE doc_id % 10 < 4")
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).select("path", "doc_id", "_mtime", "_size")
    k = F.col("doc_id") % 10
    stored = n.where(k != 0).withColumn("_mtime", F.when(k == 2, F.col("_mtime") - 1).otherwise(F.col("_mtime"))).withColumn("_size", F.when(k == 3, F.col("_size") + 1).otherwise(F.col("_size")))
    return overview.change_detect(n.where(k != 1), stored)


@query("WITH " + NOTES_SQL + r""",
o AS (SELECT path, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) - 1 AS pos FROM notes),
h AS (SELECT * FROM o WHERE term IN ('the', 'of', 'and')),
w AS (SELECT a.path, a.pos, count(DISTINCT b.term) AS terms, count(*) AS hits FROM h a JOIN h b ON a.path = b.path AND b.pos BETWEEN a.pos AND a.pos + 19 GROUP BY a.path, a.pos)
SELECT path, CAST(pos AS INTEGER) AS start, terms, hits FROM w QUALIFY row_number() OVER (PARTITION BY path ORDER BY terms DESC, hits DESC, pos) = 1""")
def excerpt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of twenty words with most distinct query words in each text."""
    index = fulltext.Index.build(notes(spark, sf_dir), ("text",), Tokenizer(PLAIN))
    return fulltext.best_window(index.tokens.where(F.col("term").isin("the", "of", "and")), 20)


@query("WITH " + NOTES_SQL + " SELECT path, CAST(len(string_split(substr(raw, 1, CAST(_size AS INTEGER) // 3), chr(10))) AS INTEGER) AS line FROM notes")
def line_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("path", tx.line_number_at(F.col("raw"), F.floor(F.col("_size") / 3).cast("int")).alias("line"))


@query(
    "WITH " + NOTES_SQL + _LINES.format("raw") + """, sec AS (SELECT path, line AS start_line, text FROM fl WHERE heading),
found AS (SELECT path, CAST(len(string_split(substr(raw, 1, CAST(_size AS INTEGER) // 3), chr(10))) AS INTEGER) AS line FROM notes)
SELECT found.path, found.line, CAST(coalesce(max(start_line), 0) AS INTEGER) AS start_line FROM found LEFT JOIN sec ON sec.path = found.path AND start_line <= line GROUP BY found.path, found.line"""
)
def section_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    at = n.select("path", tx.line_number_at(F.col("raw"), F.floor(F.col("_size") / 3).cast("int")).alias("line"))
    return sections.section_of(at, sections.outline(n)).select("path", "line", F.coalesce("start_line", F.lit(0)).alias("start_line"))


_EVAL = """l AS (SELECT lang AS query, path AS doc, doc_id % 3 AS relevance FROM notes), r AS (SELECT lang AS query, path AS doc, row_number() OVER (PARTITION BY lang ORDER BY {}) - 1 AS rank FROM notes),
i AS (SELECT query, sum((pow(2.0, relevance) - 1) / log2(k + 2)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, doc) - 1 AS k FROM l WHERE relevance > 0) WHERE k < 10 GROUP BY query),
g AS (SELECT r.query, sum((pow(2.0, relevance) - 1) / log2(rank + 2)) AS dcg, min(rank) AS first FROM r JOIN l ON r.query = l.query AND r.doc = l.doc WHERE rank < 10 AND relevance > 0 GROUP BY r.query),
m AS (SELECT i.query, coalesce(dcg / ideal, 0.0) AS ndcg, coalesce(1 / (first + 1), 0.0) AS mrr, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END AS hit FROM i LEFT JOIN g ON i.query = g.query)"""


def _evaluated(n: DataFrame, *order) -> DataFrame:
    from pyspark.sql import Window

    labels = n.select(F.col("lang").alias("query"), F.col("path").alias("doc"), (F.col("doc_id") % 3).alias("relevance"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1
    return fusion.evaluate(n.select(F.col("lang").alias("query"), F.col("path").alias("doc"), rank.alias("rank")), labels)


@query("WITH " + NOTES_SQL + "," + _EVAL.format("md5(path)") + " SELECT query, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr, CAST(hit AS DOUBLE) AS hit FROM m")
def ndcg_mrr_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(notes(spark, sf_dir), F.md5("path")).select("query", F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"), "hit")


@query(
    "WITH " + NOTES_SQL + f", a AS (WITH {_EVAL.format('md5(path)')} SELECT * FROM m), b AS (WITH {_EVAL.format('path')} SELECT * FROM m), "
    "t AS (SELECT count(*) FILTER (WHERE b.ndcg - a.ndcg > 1e-12) AS wins, count(*) FILTER (WHERE a.ndcg - b.ndcg > 1e-12) AS losses FROM a JOIN b ON a.query = b.query) "
    "SELECT wins, losses, round(CASE WHEN wins + losses > 0 THEN (wins - losses) / sqrt(wins + losses) ELSE 0.0 END, 6) AS z FROM t"
)
def paired_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    return fusion.sign_test(_evaluated(n, F.md5("path")), _evaluated(n, "path"), "ndcg").withColumn("z", F.round("z", 6))


@query("WITH " + NOTES_SQL + r" SELECT path, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, CAST(ceil(length(raw) / 4) AS BIGINT) AS tokens FROM notes")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("path", tx.normalize_text(F.col("text")).alias("text"), tx.tokens_estimate(F.length("raw")).alias("tokens"))


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@query("WITH " + NOTES_SQL + r" SELECT path, array_to_string(list_filter(regexp_extract_all(title, '[\p{L}\p{N}]+'), lambda w: w NOT IN ('AND', 'OR', 'NOT', 'NEAR')), ' OR ') AS bag FROM notes")
def or_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("path", tx.or_bag(F.col("title")).alias("bag"))


@query("WITH " + NOTES_SQL + r""", c AS (SELECT path, created AS v FROM notes UNION ALL SELECT path, title FROM notes UNION ALL SELECT path, replace(created, ' ', 'x') FROM notes)
SELECT path, v, regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]') AS like_datetime FROM c""")
def datetime_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    values = F.array("created", "title", F.translate("created", " ", "x"))
    return n.select("path", F.explode(values).alias("v")).select("path", "v", tx.looks_like_datetime(F.col("v")).alias("like_datetime"))


_MARKED = "'## ' || title || chr(10) || '> **' || source || '** and _' || lang || '_ see [[' || source || '|the source]], [' || lang || '](' || path || ') or ~~' || source || '~~' || chr(10) || '- [x] `' || lang || '`' || chr(10)"


@query("WITH " + NOTES_SQL + r" SELECT path, trim(regexp_replace(t || ' ' || source || ' and ' || lang || ' see the source, ' || lang || ' or ' || source || ' ' || lang, '\s+', ' ', 'g')) AS text FROM (SELECT *, regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g') AS t FROM notes)")
def stripped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading, a quote with emphasis, links and a struck word, and a task with code: the words are left."""
    n = notes(spark, sf_dir).withColumn("title", F.regexp_replace("title", "[^A-Za-z0-9]+", " "))
    return n.select("path", tx.strip_markdown(F.expr(_MARKED.replace("chr(10)", "char(10)"))).alias("text"))


@query()
def synthetic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many synthetic notes as there are documents."""
    return corpus(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").count())


@query("WITH " + NOTES_SQL + r" SELECT path, 'ꞏ 数 据 库 ꞏ ' || trim(regexp_replace(title, '\s+', ' ', 'g')) AS segmented FROM (SELECT path, regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g') AS title FROM notes) WHERE title <> ' '")
def segmented_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of an unspaced script becomes its letters between marks, other words stay; white space is one blank.

    An empty title leaves the blank before it, as the SQL does; the operator trims it.
    """
    from inkwell.functions.tokens import segment_column

    title = F.regexp_replace("title", "[^A-Za-z0-9]+", " ")
    segmented = F.concat(segment_column(F.concat(F.lit("数据库 "), "title")), F.when(F.col("title") == "", " ").otherwise(""))
    return notes(spark, sf_dir).select("path", title.alias("title")).where("title <> ' '").select("path", segmented.alias("segmented"))


@query()
def grapheme_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.functions.tokens import segment_column

    return notes(spark, sf_dir).select("path", segment_column(F.concat(F.lit("数据库 "), F.col("title"))).alias("segmented"))


@query()
def porter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.Index.build(notes(spark, sf_dir)).search("things OR therein", 10)


@query()
def search_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    top = fulltext.Index.build(n, tokenizer=Tokenizer(PLAIN)).search("thing OR para", 10)
    return fulltext.excerpts(top.join(n.select("path", "text"), "path"), "text", ["thing", "para"]).select("path", "hit", "offset")
