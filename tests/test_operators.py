"""Operators of the core on small fixtures."""

import datetime as dt
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell import output
from inkwell.functions import text as tx
from inkwell.functions import tokens
from inkwell.functions.tokens import Tokenizer, porter, segment_field, segment_match
from inkwell.errors import InkwellError
from inkwell.operators import fulltext, fusion, graph, links, overview, sections, vector
from inkwell.plans.corpus import corpus
from inkwell.session import own_dir
from inkwell.sources import labels as sources_labels
from inkwell.sources.models import redact_url
from inkwell.sources.notes import covers, parse_note, parse_yaml, split_front
from inkwell.tree import Tree

#: Each of twelve nodes links to two others by a rule, one to nothing.
EDGES = [(f"n{i}", f"n{j}") for i in range(12) for j in ((5 * i + 2) % 12, (i * i + 1) % 12)] + [("n7", None)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string").cache()


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def breadth_first(a, b, directed=False, max_depth=None, allowed=None):
    """The shortest path whose every node was reached from the least of those that reach it."""
    near = {}
    for s, d in EDGES:
        if d:
            near.setdefault(s, set()).add(d)
            if not directed:
                near.setdefault(d, set()).add(s)
    pred, ring, depth = {a: None}, [a], 0
    while ring and b not in pred and depth != max_depth:
        found = {}
        for node in sorted(ring):
            for other in near.get(node, ()):
                if other not in pred and (allowed is None or other in allowed):
                    found.setdefault(other, node)
        pred, ring, depth = pred | found, list(found), depth + 1
    if b not in pred:
        return None
    out = [b]
    while pred[out[-1]] is not None:
        out.append(pred[out[-1]])
    return out[::-1]


@pytest.mark.parametrize(
    ("a", "b", "options"),
    [("n0", "n9", {}), ("n9", "n0", {}), ("n4", "n4", {}), ("n3", "n8", {"directed": True}), ("n8", "n3", {"directed": True}), ("n0", "n9", {"max_depth": 1}), ("n6", "n11", {"max_depth": 3}), ("n0", "alone", {}), ("n0", "n9", {"allowed": [f"n{i}" for i in range(12) if i not in (1, 2)]})],
)
def test_shortest_path(spark, edges, a, b, options):
    want = breadth_first(a, b, **options)
    if "allowed" in options:
        options = options | {"allowed": paths(spark, *options["allowed"])}
    assert graph.shortest_path(edges, a, b, **options) == want


def test_pagerank_forms_agree(spark, edges):
    nodes = paths(spark, "alone", *[f"n{i}" for i in range(12)])
    one = {r.path: r["rank"] for r in graph.pagerank(edges, nodes).collect()}
    many = {r.path: r["rank"] for r in graph.pagerank(edges, nodes, small=0, iterations=4).collect()}
    few = {r.path: r["rank"] for r in graph.pagerank(edges, nodes, iterations=4).collect()}
    assert sum(one.values()) == pytest.approx(1) and one["alone"] == min(one.values())
    assert many == pytest.approx(few)


def test_links(spark):
    body = "Today [[tide table|tables]], ![[map]] and [[map#North]]; [crew](crew.md), [rules](../rules.md), [[unwritten]], [web](https://example.org/rules.md)"
    notes = spark.createDataFrame([("log/may.md", body), ("log/crew.md", ""), ("rules.md", ""), ("tide table.md", ""), ("charts/map.md", "")], "path string, body string")
    got = {r.target: r.dst for r in links.resolve(links.extract(notes), notes).collect()}
    assert got == {"tide table": "tide table.md", "map": "charts/map.md", "crew.md": "log/crew.md", "../rules.md": "rules.md", "unwritten": None}


def test_sections(spark):
    raw = "---\nkind: log\n---\n# Morning\nfog\n\n### Noon\nclear\n# Night\n"
    fenced = "```sh\n# a remark\n```\n## After it\ntail"
    got = sections.outline(spark.createDataFrame([("log", raw), ("run", fenced), ("void", "no heading")], "path string, raw string")).orderBy("path", "idx").collect()
    assert [(r.path, r.level, r.heading, r.start_line, r.end_line) for r in got] == [("log", 1, "Morning", 4, 6), ("log", 3, "Noon", 7, 8), ("log", 1, "Night", 9, 10), ("run", 2, "After it", 4, 5)]
    parts = sections.chunks(spark.createDataFrame([("log", "dawn\n## Noon\nclear\n\n### Night"), ("void", "\n \n")], "path string, body string")).orderBy("chunk").collect()
    assert [(r.chunk, r.start_line, r.end_line, r.text) for r in parts] == [(0, 1, 1, "dawn"), (1, 2, 4, "## Noon\nclear\n"), (2, 5, 5, "### Night")]


def test_dates(spark):
    """Every spelling of an offset names the instant that the clock less the offset is."""
    cases = {}
    for day, clock in (("1999-12-31", "23:58:07"), ("2020-02-29", "06:05:04.25")):
        at = dt.datetime.fromisoformat(f"{day}T{clock}")
        for minutes in (None, 0, 345, -210, 540, -60):
            sign, (h, m) = "-" if (minutes or 0) < 0 else "+", divmod(abs(minutes or 0), 60)
            zones = [""] if minutes is None else [f"{sign}{h:02}{m:02}", f"{sign}{h:02}:{m:02}", *([f"{sign}{h:02}"] if not m else [])]
            for between in "T ":
                for zone in zones:
                    cases[f"{day}{between}{clock}{zone}"] = (at - dt.timedelta(minutes=minutes or 0)).strftime("%Y-%m-%d %H:%M:%S")
    rows = spark.createDataFrame([(d,) for d in cases], "d string").select("d", tx.datetime_utc(tx.normalize_date(F.col("d"))).alias("u")).collect()
    assert {r.d: r.u for r in rows} == cases


def test_dates_left_alone(spark):
    same = ["1999-12-31T23:58:07+05:45", "1999-12-31T23:58:07.5Z", "1999-12-31", "next spring", "release 3-0330", "2021-02-29T06:05:04-0330", "1999-12-31T24:30:00+0100"]
    df = spark.createDataFrame([(s,) for s in same], "d string").select("d", tx.normalize_date(F.col("d")).alias("n"))
    assert [r.n for r in df.collect()] == same


def test_has_and_strip(spark):
    df = spark.createDataFrame([('["alpha","beta"]', "x **Bold** [[t#a|alias]] [l](u) `c`\n|a|b|\n|-|-|\n# H"), ("[not json", "plain"), (None, None)], "f string, m string")
    got = df.select(tx.has(F.col("f"), F.lit("alpha")).alias("a"), tx.has(F.col("f"), F.lit("not")).alias("b"), tx.strip_markdown(F.col("m")).alias("s")).collect()
    assert [(r.a, r.b) for r in got] == [(1, 0), (0, 1), (0, 0)]
    assert got[0].s.startswith("x Bold alias l c") and "|" not in got[0].s and got[0].s.endswith("H")


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("pricing", "price"), ("prices", "price"), ("generalizations", "gener"), ("happy", "happi"), ("filing", "file"), ("adjustable", "adjust")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_segments():
    assert segment_match("title: 港口") == 'title_seg:"港 口"' and segment_match("-title:港口") == '-title_seg:"港 口"'
    assert segment_match("summary:灯塔 OR text:渡船") == 'summary_seg:"灯 塔" OR text_seg:"渡 船"'
    assert segment_match('"灯塔 light"') == '"灯塔 light"' and segment_match("灯塔 NOT 渡船") == '"灯 塔" NOT "渡 船"' and segment_match("港") == "港"
    runs = {"夜の港に霧": "ꞏ 夜 の 港 に 霧 ꞏ", "เรือ": "ꞏ เ รื อ ꞏ", "Ferry 渡船 at six": "Ferry ꞏ 渡 船 ꞏ at six", "Zürich 부산 7": "", None: ""}
    assert {t: segment_field(t) for t in runs} == runs


def test_tokenizers():
    assert Tokenizer("trigram").tokens("abcd") == ["abc", "bcd"] and Tokenizer("trigram").tokens("ab") == []
    assert Tokenizer("unicode61 tokenchars '-_'").tokens("end-to-end x_y") == ["end-to-end", "x_y"]
    assert Tokenizer().tokens("Prices CAFÉ") == ["price", "cafe"]
    for bad in ("nonsense", "unicode61 nope 1", "porter unicode61 tokenchars"):
        with pytest.raises(InkwellError):
            Tokenizer(bad)


@pytest.mark.parametrize("query", ["ebb OR AND", "ebb-flow", "(ebb", '"ebb', "depth: ebb", "NEAR(ebb flow, some)", "ebb OR", "-"])
def test_query_errors(query):
    with pytest.raises(InkwellError) as e:
        fulltext.Parser(query, Tokenizer()).parse()
    assert e.value.code == "SEARCH_SYNTAX"


def test_excerpt():
    text = "Lead words. " * 30 + "The price of a price floor is here. " + "Tail words. " * 30
    hit, at = fulltext.excerpt(text, ["price", "floor"])
    assert hit.startswith("…«price» of a «price» «floor»") and text[at:].startswith("price")
    assert fulltext.excerpt("short text", ["none"]) == ("short text", 0)


@pytest.mark.parametrize(
    ("block", "good"),
    [("crew: [@ana, ben]", True), ("by: @ana", True), ("run: `make`", True), ("note: Tide: high", False), ("see: [Chart](https://example.org/c)", False), ("kind: log\nkind: list", False), ("mood: **calm**", False), ("by: @ana\ndepth: 2: 3", False), ("- ebb", False)],
)
def test_yaml_policy(block, good):
    data, error, _ = parse_yaml(block)
    assert (error is None) == good and bool(data) == good


def test_yaml_core_types():
    data, _, odd = parse_yaml("dry: no\ndepth: 007\nday: 1999-12-31\nlit: False\n{{buoy}}: x")
    assert (data["dry"], data["depth"], data["day"], data["lit"], odd) == ("no", 7, "1999-12-31", False, True)
    assert split_front("---\nkind: log\n---\nbody") == ("kind: log\n", "body") and split_front("none here\n---\n") == (None, "none here\n---\n")


def test_globs():
    assert covers("a/b/c.md", ["**/*.md"], []) and covers("c.md", ["**/*.md"], []) and not covers("a/b.md", ["*.md"], [])
    assert covers("b/c.md", ["{a,b}/*.md"], []) and covers("a/c.md", ["@(a|b)/*.md"], []) and not covers("x/y.md", ["**"], ["x/*"])


def test_vectors(spark):
    rows = [("n1", 0, [3.0, 4.0]), ("n1", 1, [1.0, 0.0]), ("n2", 0, [3.0, 4.0]), ("n3", 0, [0.0, 0.0])]
    q = vector.quantize(spark.createDataFrame(rows, "path string, chunk int, v array<double>"), "v").drop("v").cache()
    assert q.where("path = 'n2'").first().q == [95, 127] and q.where("path = 'n3'").first().scale == 1.0
    best = {r.path: r.chunk for r in vector.best_chunks(q, spark.createDataFrame([([1.0, 0.0],)], "vector array<double>")).collect()}
    assert best["n1"] == 1
    near = {r.path: r.s for r in vector.similar(q, "n1").select("path", vector.similarity(F.col("score")).alias("s")).collect()}
    assert near == {"n2": pytest.approx(1, abs=3e-3), "n3": 0.0}


def test_fusion(spark):
    make = lambda *names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "path string, i int")
    got = {r.path: (round(r.score, 4), r.via) for r in fusion.fuse(make("a", "b"), make("a", "c", "b"), make("d", "a"), paths(spark, "a", "c")).collect()}
    assert got["a"] == (round(2 / 60 + 1 / 61, 4), "match+link+vector") and got["b"][1] == "match" and got["c"][1] == "link" and got["d"][1] == "vector"
    assert fusion.fetch_size(10, False) == 30 and fusion.fetch_size(20, True) == 100


def test_change_detect(spark):
    new = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("c", 1.0, 2)], "path string, _mtime double, _size long")
    old = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1), ("d", 1.0, 1)], "path string, _mtime double, _size long")
    assert {r.path: r.state for r in overview.change_detect(new, old).collect()} == {"b": "changed", "c": "added", "d": "vanished"}


def test_output():
    rows = [{"a": 1, "b": 'x,"y"\nz'}, {"a": 2**60, "b": None}]
    assert "".join(output.csv_rows(rows)) == 'a,b\n1,"x,""y""\nz"\n1152921504606846976,\n'
    assert '"1152921504606846976"' in "".join(output.json_rows(rows)) and "".join(output.json_rows([])) == "[]\n"
    assert output.table([]) == "(0 rows)" and output.table([{"k": "v" * 50}], 20).splitlines()[2].endswith("…")


def test_no_folder_of_its_own_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        own_dir("spark://somewhere:7077")
    assert os.path.isdir(own_dir("local[2]"))


def test_links_with_blanks_and_odd_names(spark):
    notes = spark.createDataFrame([("in/one.md", "[a](two words.md) [b](<no link>) [c](../top level.md#part) [[Name with | bar]] [[x#y|z]] [d](http://h/p.md)"), ("in/two words.md", ""), ("top level.md", "")], "path string, body string")
    got = {r.target: r.dst for r in links.resolve(links.extract(notes), notes).collect()}
    assert got == {"two words.md": "in/two words.md", "../top level.md": "top level.md", "Name with": None, "x": None}


def test_stored_index_answers_as_one_made_anew(spark):
    words = ["amber", "basin", "cedar", "delta", "ember"]
    rows = [(f"n{i}", words[i % 5], f"{words[i % 3]} {words[(i + 1) % 4]}", " ".join(words[(i * k) % 5] for k in range(1, 4 + i % 7))) for i in range(40)]
    notes = spark.createDataFrame(rows, "path string, title string, summary string, text string")
    made = fulltext.Index.build(notes, tokenizer=Tokenizer("unicode61"))
    stored = fulltext.Index.stored(made.postings.cache(), made.sizes.cache(), made.columns, made.tokenizer)
    for query in ("amber", "amber OR delta", '"cedar amber"', "(amber NOT basin) OR title: ember", "ce* AND -title: delta", "NEAR(amber cedar, 1)", "^basin"):
        one, two = ({r.path: round(r.score, 9) for r in x.search(query).collect()} for x in (made, stored))
        assert one == two and one, query
        assert set(one) == {r.path for r in stored.match(stored.parse(query)).collect()}


def test_search_tokenizes_once_and_stems_a_word_once(spark, tmp_path):
    notes = spark.createDataFrame([(f"n{i}", "Things", "", "things thing therein " * (i + 1)) for i in range(5)], "path string, title string, summary string, text string")
    index = fulltext.Index.build(notes)
    made = spark.sparkContext.accumulator(0)

    def places(*asked, own=index.tokenizer):
        made.add(1)
        return Tokenizer.places(own, *asked)

    index.tokenizer.places = places
    found = index.search("things OR therein", 10)
    assert [r.path for r in found.collect()] == [r.path for r in fulltext.Index.stored(index.postings, index.sizes, index.columns, index.tokenizer).search("things OR therein", 10).collect()]
    assert made.value == 15
    stems = Counter()
    memory = tokens._Memory(lambda w: stems.update([w]) or porter(w))
    assert [memory[w] for w in ["things", "thing", "things", "x" * 65, "x" * 65]][:3] == ["thing"] * 3
    assert stems == {"things": 1, "thing": 1, "x" * 65: 2} and len(memory) == 2


def test_a_stem_begins_as_its_word():
    ends = ["", "s", "es", "ies", "sses", "ed", "eed", "ing", "y", "e", "ll", "ion", *tokens._STEP2, *tokens._STEP3, *tokens._STEP4, "bility", "ably", "ity", "ality", "ivity", "ency", "ancy", "logy", "icity", "ational", "ations", "izing", "ating", "bling", "nesses", "fulnesses", "tion", "sion"]
    for head in ("", "a", "at", "cre", "rela", "ti", "hop", "ab", "possi", "y", "ay", "conf", "tt", "iz"):
        for one in ends:
            for two in ends:
                w = head + one + two
                assert w.startswith(porter(w)[:-2]), w


def refused(text):
    raise AssertionError("all tokens were made")


def test_trigrams_are_looked_up_in_the_text(spark):
    rows = [("a", "Something THING"), ("b", "thin gs"), ("c", None), ("d", "th"), ("e", "xthingthing"), ("f", "İthing" + "ab" * 50_000)]
    index = fulltext.Index.build(spark.createDataFrame(rows, "path string, text string"), ("text",), Tokenizer("trigram"))
    nodes = [index.parse(q) for q in ('"thing"', '"thi" OR "hin"*', '^"thi"', '"thing" NOT "ome"')]
    index.tokenizer.tokens = refused
    assert ["".join(sorted(r.path for r in index.match(n).collect())) for n in nodes] == ["aef", "abef", "b", "ef"]


@pytest.mark.parametrize("spec", ["trigram", "porter unicode61", "unicode61", "ascii", "porter unicode61 separators 'n'"])
def test_places_are_those_of_the_tokens(spec):
    tokenizer = Tokenizer(spec)
    for text in ("Things thing; the thirty-first ÉTÉ été, aaaa İda ida ponies ability able", "", None, "th", "aaaaaa things"):
        tokens = tokenizer.tokens(text)
        exact, heads = frozenset(tokenizer.tokens("things aaaa ete ida pony abilities")), ("thi",)
        want = [(t, i) for i, t in enumerate(tokens) if t in exact or t.startswith(heads)]
        assert tokenizer.places(text, exact, heads) == (len(tokens), want)
        assert tokenizer.places(text, exact) == (len(tokens), [(t, i) for t, i in want if t in exact])


def test_excerpt_terms_leave_out_what_must_not_match():
    node = fulltext.Parser('title: "Big Words" other* NOT hidden', Tokenizer()).parse()
    assert [w for p in fulltext.phrases_of(node) for w in p.words] == ["big", "words", "other"]
    hit, at = fulltext.excerpt("word " * 20_000, ["word"])
    assert at == 0 and hit.startswith("«word»")


def test_numbers_beyond_64_bits_are_reals():
    fields = parse_note("a.md", "---\nphone: 99999999999999999999\nsmall: 7\n---\n")["fields"]
    assert float(fields["phone"]) == 1e20 and fields["small"] == "7"


def test_placeholders_outside_of_literals():
    assert Tree.placeholders("SELECT '?', \"?\", `a?`, ? -- ?\n/* ? */ WHERE x = ?") == 2


def counted(spark, df, read):
    """``df``, of which ``read`` counts the rows as they are made."""
    return spark.createDataFrame(df.rdd.map(lambda r: (read.add(1), tuple(r))[1]), df.schema)


def test_personal_ranks_make_the_edges_once(spark, edges):
    nodes = paths(spark, *[f"n{i}" for i in range(14)], "n3")
    seeds = spark.createDataFrame([("n1", 2.0), ("n13", 1.0), ("n1", 1.0)], "path string, weight double")
    got = []
    for options in ({}, {"small": 0}):
        read = spark.sparkContext.accumulator(0)
        got.append({r.path: round(r["rank"], 12) for r in graph.personalized(counted(spark, edges, read), seeds, nodes, **options).collect()})
        assert read.value == len(EDGES)
    assert got[0] == got[1] and len(got[0]) == 14 and abs(sum(got[0].values()) - 1) < 1e-9 and got[0]["n13"] > 0


def test_links_are_extracted_once_to_be_resolved(spark):
    read = spark.sparkContext.accumulator(0)
    found = spark.createDataFrame([("a.md", "b"), ("a.md", "b"), ("b.md", "none")], "src string, target string")
    got = links.resolve(counted(spark, found, read), paths(spark, "a.md", "b.md")).collect()
    assert sorted((r.src, r.dst or "") for r in got) == [("a.md", "b.md"), ("a.md", "b.md"), ("b.md", "")] and read.value == 3


def test_a_plain_search_and_its_fusion_read_the_notes_once(spark, edges):
    read = spark.sparkContext.accumulator(0)
    notes = spark.createDataFrame([(f"n{i}", "t", "s", "amber " * (i % 3)) for i in range(12)], "path string, title string, summary string, text string")
    found = fulltext.Index.build(counted(spark, notes, read), tokenizer=Tokenizer("unicode61 remove_diacritics 0")).search("amber", 5)
    matches = fusion.numbered(found, ["score", "path"])
    touching = edges.where("dst is not null").select(F.col("src").alias("path"))
    got = fusion.fuse(matches, paths(spark, "n7", "n2").withColumn("i", F.lit(0)), None, touching.where("path != 'n2'"))
    assert {r.path: r.via for r in got.collect()} == {"n2": "match", "n5": "match", "n8": "match", "n11": "match", "n1": "match", "n7": "link"} | ({"n7": "match+link"} if "n7" in {r.path for r in matches.collect()} else {})
    assert read.value == 12


def test_refreshed_links_equal_a_full_resolution(spark):
    old = {"a/x.md": "[[y]] [[b/y]] [[n.md]] [[gone]] [[q/]]", "a/y.md": "[[x]]", "gone.md": "[[x]]", "z.md": "[[new]] [q](b/../b/y.md)"}
    new = {k: v for k, v in old.items() if k != "gone.md"} | {"z.md": "[[x]] [q](b/../b/y.md)", "b/y.md": "[[y]]", "new.md": "[[gone]]", "n.md.md": "", "a/q.md": ""}
    table = lambda d: spark.createDataFrame(list(d.items()), "path string, body string")
    before, after = table(old), table(new)
    moved = spark.createDataFrame([(p,) for p in set(old) ^ set(new)], "path string")
    anew = [p for p in new if new[p] != old.get(p)]
    stored = links.resolve(links.extract(before), before).where(~F.col("src").isin(*anew, "gone.md"))
    got = links.refresh(stored, links.extract(after.where(F.col("path").isin(anew))), after, moved)
    want = links.resolve(links.extract(after), after)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_labels(spark, tmp_path):
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "tides"}\n{"text": "no id"}\nbroken\n{"_id": "q2"}\n')
    (tmp_path / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td1\t2\nq2\td9\t0\n")
    asked, labels = sources_labels.queries(spark, str(tmp_path / "queries.jsonl")), sources_labels.judgements(spark, str(tmp_path / "test.tsv"))
    assert sorted(map(tuple, asked.collect())) == [("q1", "tides"), ("q2", "")]
    assert sorted(map(tuple, labels.collect())) == [("q1", "d1", 2.0), ("q2", "d9", 0.0)]
    assert [r.query for r in sources_labels.judged(asked, labels).collect()] == ["q1"]


def test_corpus_is_the_same_each_time_and_skewed(spark):
    got = corpus(spark, 200, words=120, vocabulary=500).collect()
    assert sorted(got) == sorted(corpus(spark, 200, words=120, vocabulary=500).repartition(3).collect())
    assert len({r.path for r in got}) == 200 and all(r.raw.count("\n## ") == 4 for r in got)
    words = Counter(w for r in got for w in r.raw.split() if w.startswith("w"))
    ranks = [n for _, n in words.most_common()]
    assert ranks[0] > 5 * ranks[9] and len(ranks) > 300
    linked = Counter(x for r in got for x in re.findall(r"\[\[(note-\d+)\]\]", r.raw))
    assert linked.total() == 600 and linked.most_common(1)[0][0] == "note-0"


@pytest.mark.parametrize(("url", "shown"), [("https://me:secret@host:8080/v1?x=1", "https://host:8080/v1?x=1"), ("http://host/v1", "http://host/v1"), ("me:secret@host", "(unreadable)"), ("http://[::1", "(unreadable)"), (None, None)])
def test_addresses_without_credentials(url, shown):
    assert redact_url(url) == shown
