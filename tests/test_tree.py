"""A real tree on disk: ingest, verbs, scope, life cycle, command line."""

import json
import os
import threading

import pytest

from inkwell import cli, config
from inkwell.errors import InkwellError
from inkwell.functions.tokens import segment_match
from inkwell.streaming.watch import beat, lease, release, watch
from inkwell.tree import Tree, open_tree

#: A harbour's papers: six notes in three folders, one whose head does not parse.
NOTES = {
    "quay.md": ("title: Mooring fees\nstate: open\nberths: 42\nheated: true\ntags: [north, tidal]\n", "A mooring costs 12 a night, by the [[harbour rules]].\n\n## Discounts\n\nMembers pay half.\n"),
    "harbour rules.md": ("title: Rules\nstate: open\nberths: 1.5\n", "Quiet hours, and how fast a boat may go.\n"),
    "1987/ledger.md": ("title: Ledger of 1987\nstate: closed\n", "Each mooring was paid in coin to the [[harbour master]].\n"),
    "crew/tides.md": ("title: Tide tables\npath: ignored\n", "Springs and neaps. [fees](../quay.md)\n"),
    "crew/rota.md": ("", "Who sweeps the [[quay]], and when.\n"),
    "draft.md": ("title: Fees: a draft\nstate: open\n", "Not finished.\n"),
}


def write(base, notes, **cfg):
    for path, (front, body) in notes.items():
        f = base / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"---\n{front}---\n\n{body}" if front else body)
    raw = {"version": 4, "presets": {"default": {"include": ["**/*.md"]}, "top": {"include": ["*.md"], "k": 3}}, "queries": {"in_state": {"sql": "SELECT path FROM frontmatter WHERE state = ? ORDER BY path"}, "fees": {"search": "mooring"}}} | cfg
    (base / config.CONFIG_FILENAME).write_text(json.dumps(raw))
    return config.load(base / config.CONFIG_FILENAME)


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    return open_tree(write(tmp_path_factory.mktemp("tree"), NOTES), spark)


def test_search_matches_links_and_excerpts(tree):
    rows = tree.search("mooring")
    by = {r["path"]: r for r in rows}
    assert "match" in by["quay.md"]["via"] and "«mooring»" in by["quay.md"]["hit"].lower()
    assert by["harbour rules.md"]["via"] == by["crew/rota.md"]["via"] == "link"
    assert rows[0]["path"] == "quay.md" and rows[0]["score"] == pytest.approx(2 / 60, abs=2e-3)


def test_search_where_and_syntax(tree):
    paths = [r["path"] for r in tree.search("mooring", where="f.state = 'open'")]
    assert "quay.md" in paths and "1987/ledger.md" not in paths
    with pytest.raises(InkwellError) as e:
        tree.search("mooring OR OR")
    assert e.value.code == "SEARCH_SYNTAX"
    assert tree.search("mooring zeppelin") == []
    assert "quay.md" in [r["path"] for r in tree.search("mooring OR zeppelin")]
    with pytest.raises(InkwellError, match="where condition"):
        tree.search("mooring", where="f.colour = 1")


def test_scope(tree):
    found = {r["path"] for r in tree.search("springs OR mooring", preset="top")}
    assert "quay.md" in found and found <= {"quay.md", "harbour rules.md", "draft.md"}
    assert [r["path"] for r in tree.search("springs", include=["crew/t*.md"])] == ["crew/tides.md"]
    with pytest.raises(InkwellError) as e:
        tree.search("springs", preset="bottom")
    assert e.value.code == "PRESET_UNKNOWN"


def test_typed_fields_and_quarantine(tree):
    row = tree.sql("SELECT heated, berths, tags, has(tags, 'tidal') a, has(tags, 'tid') b FROM frontmatter WHERE path = 'quay.md'").first()
    assert (row.heated, row.berths, row.tags, row.a, row.b) == (1, 42.0, '["north","tidal"]', 1, 0)
    bad = tree.sql("SELECT state, _parse_error FROM frontmatter WHERE path = 'draft.md'").first()
    assert bad.state is None and bad._parse_error
    assert any("reserved" in w for w in tree.warnings)


def test_sql_parameters_scope_and_read_only(tree):
    assert [r.path for r in tree.saved("in_state", ["open"]).collect()] == ["harbour rules.md", "quay.md"]
    assert tree.sql("SELECT count(*) n FROM scope", preset="top").first().n == 3
    with pytest.raises(InkwellError):
        tree.sql("SELECT 1", preset="top")
    with pytest.raises(InkwellError):
        tree.sql("DROP TABLE frontmatter")
    assert tree.saved("fees")[0]["path"] == "quay.md"


def test_full_text_within_sql(tree):
    """matching(…) is a table anywhere in a statement but in its literals, and takes its terms from a parameter too."""
    one = "SELECT f.path, 'matching(''x'') ?' AS said FROM frontmatter f JOIN matching('mooring OR \"quiet hours\"') m ON f.path = m.path WHERE f.state = ? ORDER BY m.score, f.path"
    assert tree.placeholders(one) == 1
    assert [tuple(r) for r in tree.sql(one, ["open"]).collect()] == [(p, "matching('x') ?") for p in sorted(["quay.md", "harbour rules.md"], key=lambda p: [r.path for r in tree.matching('mooring OR "quiet hours"').orderBy("score", "path").collect()].index(p))]
    two = "SELECT path FROM frontmatter WHERE state = ? AND path IN (SELECT path FROM matching(?)) AND path NOT IN (SELECT path FROM matching('members'))"
    assert tree.placeholders(two) == 2
    assert [r.path for r in tree.sql(two, ["closed", "mooring"]).collect()] == ["1987/ledger.md"]
    assert tree.sql(two, ["open", "mooring"]).collect() == []
    with pytest.raises(InkwellError) as e:
        tree.sql("SELECT * FROM matching('mooring OR OR')")
    assert e.value.code == "SEARCH_SYNTAX"


def test_peek_path_map_status(tree):
    p = tree.peek("quay")
    assert p["outbound"] == ["harbour rules.md"] and p["backlinks"] == ["crew/rota.md", "crew/tides.md"] and p["sections"][0]["heading"] == "Discounts"
    assert tree.peek("ledger")["unresolved"] == ["harbour master"]
    assert tree.path("harbour rules", "tides") == ["harbour rules.md", "quay.md", "crew/tides.md"]
    assert tree.path("harbour rules", "ledger") is None and tree.path("quay", "quay") == ["quay.md"]
    m = tree.map()
    assert m["docs"]["count"] == 6 and {f["field"]: f["types"] for f in m["fields"]}["berths"] == "integer,real"
    assert m["hubs"][0]["path"] in ("harbour rules.md", "quay.md")
    assert tree.status()["unparseableFrontmatter"] == 1
    with pytest.raises(InkwellError) as e:
        tree.peek("lighthouse")
    assert e.value.code == "NOTE_NOT_FOUND"
    with pytest.raises(InkwellError) as e:
        tree.related("quay")
    assert e.value.code == "EMBED_DISABLED"


def test_life_cycle(spark, tmp_path):
    cfg = write(tmp_path, {"a.md": ("", "See [[b]].\n"), "c.md": ("x: 1\n", "plain\n")})
    tree = open_tree(cfg, spark)
    assert tree.tables["links"].first().dst is None
    first = tree.store.meta()["version"]
    assert open_tree(cfg, spark).store.meta()["version"] == first
    (tmp_path / "b.md").write_text("---\ny: two\n---\nnew\n")
    (tmp_path / "c.md").unlink()
    tree = open_tree(cfg, spark)
    assert tree.tables["links"].first().dst == "b.md"
    assert {r.path for r in tree.tables["frontmatter"].collect()} == {"a.md", "b.md"}
    assert tree.store.meta()["parsed"] == 1
    # As if built at once.
    tree.store.clear()
    assert sorted(map(tuple, open_tree(cfg, spark).tables["links"].collect())) == sorted(map(tuple, tree.spark.read.parquet(*[str(p) for p in tmp_path.glob(".inkwell/*/links")]).collect()))


def test_small_changes_touch_few_links(spark, tmp_path, monkeypatch):
    """Text alone leaves edges and ranks as they are; a link or a name that comes or goes gives what a new build gives."""
    notes = {f"n{i:02}.md": ("", f"See [[n{(i * 7 + 3) % 20:02}]] and [[late]].\n") for i in range(20)}
    cfg = write(tmp_path, notes)
    open_tree(cfg, spark)
    ran = []
    from inkwell.operators import graph, links

    for module, name in ((graph, "pagerank"), (links, "refresh"), (links, "resolve")):
        own = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, own=own, name=name, **k: ran.append(name) or own(*a, **k))
    state = lambda t: (sorted(map(tuple, t.tables["links"].collect()), key=str), sorted((r.path, round(r._rank, 12)) for r in t.tables["frontmatter"].collect()))

    def after(path, text, ran_now):
        (tmp_path / path).write_text(text) if text is not None else (tmp_path / path).unlink()
        ran.clear()
        got = state(open_tree(cfg, spark))
        assert ran == ran_now
        Tree(cfg, spark).store.clear()
        assert state(open_tree(cfg, spark)) == got
        return got

    before = after("n05.md", notes["n05.md"][1] + "More words.\n", [])
    assert after("n05.md", "See [[n00]].\n", ["refresh", "resolve", "pagerank"]) != before
    links_now, _ = after("late.md", "Here.\n", ["refresh", "resolve", "pagerank"])
    assert sum(r[3] == "late.md" for r in links_now) == 19
    links_now, _ = after("late.md", None, ["refresh", "resolve", "pagerank"])
    assert not any(r[3] == "late.md" for r in links_now)


def test_features_off(spark, tmp_path):
    tree = open_tree(write(tmp_path, NOTES, features={"links": False, "rank": False, "sections": False}), spark)
    assert {r["via"] for r in tree.search("mooring")} == {"match"}
    assert set(tree.peek("quay")["off"]) == {"links", "sections", "rank"} and tree.map()["hubs"] == []


def test_unspaced_scripts_match_their_substrings(spark, tmp_path):
    texts = {"north.md": "渡船星期一不开", "south.md": "灯塔下的长桥", "east.md": "夜の港に霧が出た"}
    tree = open_tree(write(tmp_path, {path: ("", t + "\n") for path, t in texts.items()}), spark)
    index = tree.index()
    # Of each text its first two letters, a stretch of three, one letter, and two letters the other way round.
    for text in texts.values():
        for term in (text[:2], text[2:5], text[-1], text[3] + text[2]):
            got = {r.path for r in index.match(index.parse(segment_match(term))).collect()}
            assert got == {path for path, t in texts.items() if term in t}, term


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    write(tmp_path, NOTES)
    monkeypatch.chdir(tmp_path)
    assert cli.main(["search", "mooring", "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["path"] == "quay.md"
    assert cli.main(["sql", "SELECT path, title FROM content WHERE path = 'none'", "--format", "csv"], spark) == 0
    assert capsys.readouterr().out == "path,title\n"
    assert cli.main(["sql", "SELECT ? + 1"], spark) == 2
    assert cli.main(["sql", "SELECT nope FROM content"], spark) == 1
    assert cli.main(["in_state", "closed"], spark) == 0
    assert cli.main(["lighthouse"], spark) == 2
    capsys.readouterr()
    assert cli.main(["sql", "SELECT path FROM matching(?) ORDER BY path", "mooring", "--format", "csv"], spark) == 0
    assert capsys.readouterr().out == "path\n1987/ledger.md\nquay.md\n"
    assert cli.main(["status"], spark) == 0
    assert "docs: 6 (1 with front matter that did not parse)" in capsys.readouterr().out
    assert cli.main(["path", "rota", "ledger", "--format", "json"], spark) == 0
    assert capsys.readouterr().out.strip().endswith("null")
    with pytest.raises(SystemExit) as e:
        cli.main(["search", "x", "--k", "0"], spark)
    assert e.value.code == 2


def test_watch(spark, tmp_path):
    cfg = write(tmp_path, {"a.md": ("", "one\n")})
    seen = []
    threading.Timer(4, lambda: (tmp_path / "b.md").write_text("two\n")).start()
    watch(cfg, spark, seen.append, seconds=14)
    assert seen[0]["event"] == "started" and [e["total"] for e in seen if e["event"] == "reconciled"] == [2]
    assert Tree(cfg, spark).store.watcher() == {}


def test_lease(spark, tmp_path):
    tree = Tree(write(tmp_path, {"a.md": ("", "one\n")}), spark)
    first = lease(tree)
    assert beat(tree, first)
    with pytest.raises(InkwellError) as e:
        lease(tree)
    assert e.value.code == "WATCH_ACTIVE"
    second = lease(tree, force=True)
    assert not beat(tree, first) and beat(tree, second)
    release(tree, first)  # no longer its own
    assert tree.store.watcher()["token"] == second
    # A heartbeat waits for no reconcile, and a lease that nobody renews can be taken.
    with tree.store.writing:
        beating = threading.Thread(target=beat, args=(tree, second))
        beating.start()
        beating.join(5)
        assert not beating.is_alive()
    tree.store.set_watcher(tree.store.watcher() | {"beat": 0})
    release(tree, lease(tree))
    assert tree.store.watcher() == {}


def test_reconciles_at_once_lose_nothing(spark, tmp_path):
    cfg = write(tmp_path, {f"{i}.md": ("", f"note {i}\n") for i in range(3)})
    failed = []

    def reconcile(i: int) -> None:
        try:
            (tmp_path / f"new{i}.md").write_text("more\n")
            open_tree(cfg, spark)
        except Exception as e:  # noqa: BLE001  told to the main thread
            failed.append(e)

    threads = [threading.Thread(target=reconcile, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = Tree(cfg, spark).store
    assert not failed and store.meta()["total"] == 6
    assert {name: store.table(name).select("path").distinct().count() for name in ("content", "frontmatter", "sizes")} == {"content": 6, "frontmatter": 6, "sizes": 6}
    store.clear()
    assert store.meta() == {}


def test_vectors(spark, tmp_path, monkeypatch):
    import struct

    import numpy as np

    model = tmp_path / "model"
    model.mkdir()
    m = np.zeros((4, 8), "<f4")
    m[1, 0] = m[2, 0] = m[3, 1] = 1
    head = json.dumps({"e": {"dtype": "F32", "shape": [4, 8], "data_offsets": [0, m.nbytes]}}).encode()
    (model / "model.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + m.tobytes())
    vocab = {"[UNK]": 0, "boat": 1, "ferry": 2, "cliff": 3}
    (model / "tokenizer.json").write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": vocab, "unk_token": "[UNK]"}}))
    # Boat and ferry have one vector; the pier is linked from the boat's note, and the log links to it.
    notes = {"boat.md": ("", "boat [[pier]]\n"), "pier.md": ("", "boat\n"), "log.md": ("", "boat [[boat]]\n"), "crossing.md": ("", "ferry\n"), "coast.md": ("", "cliff\n")}
    tree = open_tree(write(tmp_path / "t", notes, embed={"model": str(model), "type": "static"}), spark)
    rows = {r["path"]: r for r in tree.search("ferry")}
    assert "vector" in rows["pier.md"]["via"] and rows["pier.md"]["lines"] and rows["crossing.md"]["similarity"] == 1.0
    near = tree.related("boat")
    assert near[0] == {"path": "crossing.md", "similarity": 1.0} and {r["path"] for r in near} == {"crossing.md", "coast.md"}
    missing = config.load(write(tmp_path / "u", notes, embed={"model": "no/model"}).path)
    with pytest.raises(InkwellError) as e:
        open_tree(missing, spark).search("ferry")
    assert e.value.code == "EMBED_MODEL_MISSING"


def test_config(tmp_path):
    assert config.init(tmp_path).exists()
    with pytest.raises(InkwellError) as e:
        config.init(tmp_path)
    assert e.value.code == "CONFIG_EXISTS"
    old = {"version": 1, "scan": {"include": ["**/*.md"]}, "queries": {"a": "SELECT 1", "b": {"find": "x", "k": 2, "semantic": True}}}
    new, was = config.migrate(old)
    assert was == 1 and new["version"] == 4 and new["queries"] == {"a": {"sql": "SELECT 1"}, "b": {"search": "x", "k": 2}}
    assert config.validate(new) == []
    good = {"version": 4, "presets": {"default": {"include": ["*.md"], "k": 7, "where": "f.a = 1"}}}
    for bad in ({"presets": {}}, {"presets": {"default": {"include": []}}}, {"presets": {"default": {"include": ["a"], "size": 1}}}, {"features": {"embed": True}}, {"embed": {"type": "static"}}, {"content": {"tokenize": ""}}, {"queries": {"q": "SELECT 1"}}, {"queries": {"q": {"search": " "}}}):
        with pytest.raises(InkwellError):
            config.validate(good | bad)
    assert config.validate(good | {"future": 1}) == ["future"]
    with pytest.raises(InkwellError) as e:
        config.migrate({"version": 9})
    assert e.value.code == "CONFIG_VERSION_UNSUPPORTED"
    c = config.Config(good, tmp_path)
    assert c.resolve()["k"] == 7 and c.resolve(k=2)["k"] == 2 and c.resolve(where="")["where"] == ""
    with pytest.raises(InkwellError) as e:
        config.load(start=os.sep)
    assert e.value.code == "CONFIG_NOT_FOUND"
