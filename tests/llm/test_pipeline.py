"""The pipeline against a brute-force version, and its stages' edge cases."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken

import corpus_pipeline
from inkwell.llm import bpe, queries, toxicity
from inkwell.llm.common import text_bytes

from .test_operators import SF, brute_classes, empty, odd


def windows(text):
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.orderBy("doc_id").collect()
    model = toxicity.train(docs, labels.where(toxicity.fold() != 2))
    weights = np.zeros(1 << model.bits)
    weights[model.places] = model.weights
    scores = toxicity.score(*text_bytes(pa.array([r.text.lower() for r in rows])), weights, model.bias, model.bits)
    left = [(r.doc_id, r.source, r.text) for r, s in zip(rows, scores, strict=True) if s < 0.3]
    pages, seen = collections.Counter(s for _, s, _ in left), collections.Counter()
    for _, s, t in left:
        seen.update((s, x) for x in {x.strip(" ") for x in t.split("\n")} if x)
    drop = {k for k, n in seen.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    left = [(i, "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in drop)) for i, s, t in left]
    first = dict(brute_classes(left))
    left = [(i, t) for i, t in left if first[i] == i]
    bad = set().union(*[windows(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    left = [(i, t) for i, t in left if not windows(t) & bad]
    coder = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=bpe.read_ranks(queries.VOCABULARY), special_tokens={})
    want = []
    for i, t in left:
        ids = coder.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)
    assert drop and len(want) < len(rows)


def test_stages_take_odd_and_empty_tables(spark):
    for make in (odd, empty):
        df = make(spark)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= df.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()


def test_a_large_group_of_copies_keeps_one_text(spark):
    """A group of exact copies with over a tenth of a source leaves one document, with its text."""
    copy = "\n".join(f"line {k} of the copied text has these words" for k in range(8))
    rows = [(i, copy if i < 10 else "Menu\n" + " ".join(f"w{i}x{j}" for j in range(30)), "src") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lined = corpus_pipeline.drop_lines(spark, df, SF)
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_copies(spark, lined, SF).collect()}
    assert got == {0: copy} | {i: " ".join(f"w{i}x{j}" for j in range(30)) for i in range(10, 30)}
