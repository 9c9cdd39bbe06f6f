"""Token counts by a separator scan over flat token files.

A flat file is a stream of little-endian token ids with an end-of-document id after each document and no index. It is
read in blocks whose borders ignore documents. Each block is searched for the separator at once; that gives the tokens
before its first separator, those between separators, and those after its last. Blocks are stitched with an exclusive
prefix scan of (separators so far, tokens since the last separator), an associative operation, in two levels: over the
blocks of a chunk, then over the chunks of a file, so no task holds more than a chunk's or a file's chunk summaries.

Defined cases: a document without tokens counts 0; null text is the empty text; tokens after a file's last separator
are an open document, reported by ``open_tails`` only; an empty table has no files; repeated rows are documents of
their own; an odd trailing byte of a file raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.bpe import read_ranks

BLOCK_TOKENS, CHUNK = 1 << 17, 1024
BLOCKS = "file long, block long, tokens binary, ids array<long>"


def write_stream(docs: DataFrame, path: str, pattern: str, separator: int, *, doc: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenise ``docs`` into flat streams, a file for each partition, cut into blocks.

    ``ids`` lists the documents whose separator is in the block: the writer's order, not their lengths.
    """
    width = "<u2" if separator < 1 << 16 else "<u4"
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def written(batches):
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        file, block = TaskContext.get().partitionId(), 0
        parts, held, ends = [], 0, []

        def cut(n):
            nonlocal parts, held, ends, block
            flat = np.concatenate(parts)
            own = [k for at, k in ends if at <= n]
            row = pa.RecordBatch.from_pydict({"file": [file], "block": [block], "tokens": [flat[:n].astype(width).tobytes()], "ids": [own]}, schema=schema)
            parts, held, block = [flat[n:]], held - n, block + 1
            ends = [(at - n, k) for at, k in ends if at > n]
            return row

        for batch in batches:
            for key, value in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                ids = coder.encode_ordinary(value or "")
                parts.append(np.array([*ids, separator], np.int64))
                held += len(ids) + 1
                ends.append((held, key))
                while held >= block_tokens:
                    yield cut(block_tokens)
        if held:
            yield cut(held)

    return docs.select(F.col(doc).cast("long"), F.col(text)).mapInArrow(written, BLOCKS)


def read_files(spark: SparkSession, path: str, *, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat binary token files (shards of up to 1 GB) in any store that Spark reads."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("tokens", pa.binary())])
    size = width * block_tokens

    def cut(batches):
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                whole = data.as_buffer()
                if whole.size % width:
                    raise ValueError(f"{name} is not a whole number of tokens")
                for k, at in enumerate(range(0, whole.size, size)):
                    yield pa.RecordBatch.from_pydict({"file": [name], "block": [k], "tokens": [whole.slice(at, min(size, whole.size - at)).to_pybytes()]}, schema=schema)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, block long, tokens binary")


SUMMARY = "struct<size:long, n_sep:long, head:long, tail:long, inner:array<long>>"
_SUMMARY = pa.struct([("size", pa.int64()), ("n_sep", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("inner", pa.list_(pa.int64()))])


def summaries(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """The blocks without their tokens, with the summary of each."""

    @F.arrow_udf(SUMMARY)
    def summary(column: pa.Array) -> pa.Array:
        out = []
        for value in column:
            flat = np.frombuffer(value.as_buffer(), f"<u{width}")
            at = np.flatnonzero(flat == separator)
            if len(at):
                out.append({"size": len(flat), "n_sep": len(at), "head": int(at[0]), "tail": int(len(flat) - 1 - at[-1]), "inner": np.diff(at) - 1})
            else:
                out.append({"size": len(flat), "n_sep": 0, "head": len(flat), "tail": len(flat), "inner": []})
        return pa.array(out, _SUMMARY)

    return blocks.withColumn("s", summary(F.col("tokens"))).drop("tokens").select("*", "s.*").drop("s")


def _scan(df: DataFrame, keys: list[str], order: str, prefix: str) -> DataFrame:
    """Exclusive scan: separators before, whether any, and tokens since the last."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("tail").over(before), F.lit(0))
    df = df.withColumn("__t", total)
    last = F.max(F.when(F.col("n_sep") > 0, F.col("__t"))).over(before)
    seps = F.coalesce(F.sum("n_sep").over(before), F.lit(0))
    return df.withColumn(f"{prefix}_seps", seps).withColumn(f"{prefix}_carry", F.col("__t") - F.coalesce(last, F.lit(0))).drop("__t")


def stitched(summary: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Summaries with ``seps`` (separators of the file before the block) and ``carry`` (tokens of its open document)."""
    df = _scan(summary.withColumn("chunk", F.floor(F.col("block") / chunk)), ["file", "chunk"], "block", "in")
    whole = df.groupBy("file", "chunk").agg(F.sum("n_sep").alias("n_sep"), F.max_by(F.when(F.col("n_sep") > 0, F.col("tail")).otherwise(F.col("in_carry") + F.col("tail")), "block").alias("tail"))
    whole = _scan(whole, ["file"], "chunk", "at").select("file", "chunk", "at_seps", "at_carry")
    df = df.join(whole, ["file", "chunk"])
    carry = F.col("in_carry") + F.when(F.col("in_seps") > 0, 0).otherwise(F.col("at_carry"))
    return df.withColumn("seps", F.col("at_seps") + F.col("in_seps")).withColumn("carry", carry).drop("in_seps", "in_carry", "at_seps", "at_carry", "chunk")


def count(blocks: DataFrame, separator: int, *, width: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Per block: file, block, seps, and ``counts`` of the documents that end in it, the first with its earlier blocks' part."""
    df = stitched(summaries(blocks, separator, width), chunk)
    counts = F.when(F.col("n_sep") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("counts", counts)


def open_tails(blocks: DataFrame, separator: int, *, width: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Per file: tokens after its last separator."""
    df = stitched(summaries(blocks, separator, width), chunk)
    tail = F.when(F.col("n_sep") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    return df.groupBy("file").agg(F.max_by(tail, "block").alias("open_tokens"))


def documents_of(counted: DataFrame) -> DataFrame:
    """Per document: its id, and its tokens."""
    return counted.select(F.explode(F.arrays_zip("ids", "counts")).alias("d")).select(F.col("d.ids").alias("doc_id"), F.col("d.counts").alias("n_tokens"))
