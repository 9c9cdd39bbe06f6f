"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical rendering.

A transcript is plain text. Each line gives categorical features (the kind of speaker marker it begins with, whether it
is blank, follows a blank line, asks, and its length class). The states are (role, begin) and (role, inside); emission
is a product over features. Counts with add-one smoothing train the model, from the ``sample`` labelled transcripts of
least hash and of these at most ``sample_bytes`` of text in the same order (longer transcripts alone are not learnt from);
Viterbi finds the likeliest path of the states; begin states start turns, markers are taken off, and turns are rendered
as <|im_start|>role, text, <|im_end|>.

``transcripts`` makes transcripts of a table of turns in mixed styles. Rows equal in all of conversation, turn, role and
text count once; rows that share a turn are branches, told apart by a hash of their content into as many branches as
the turn has rows; conversations are cut every ``SEGMENT`` turns. So no group grows with a hot conversation.

Defined cases: null text is empty; an empty transcript has no turns; a null role is rendered without a marker and is
nobody's; a null turn is turn 0 and a null conversation a conversation; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: Transcripts and bytes of their texts that training looks at, at most.
SAMPLE, SAMPLE_BYTES = 2_000, 32 << 20
SEGMENT = 32

#: Names by which transcripts call the roles. Fixed values.
NAMES = {
    "system": ("system", "system prompt", "instructions", "context", "sys"),
    "user": ("user", "human", "customer", "question", "instruction", "input", "q", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "gpt", "answer", "response", "output", "a", "model", "agent"),
}
_ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
_NAME = "|".join(sorted(map(re.escape, _ROLE_OF), key=len, reverse=True))
_MARKERS = (
    ("tag", re.compile(rf"<\|?\s*(?:im_start\|>)?({_NAME})\s*\|?>?[ \t]*(?:\n|$)?", re.I)),
    ("head", re.compile(rf"#{{1,6}}\s*({_NAME})\s*:?[ \t]*$", re.I)),
    ("bold", re.compile(rf"\*\*\s*({_NAME})\s*:?\s*\*\*\s*:?[ \t]*", re.I)),
    ("square", re.compile(rf"\[({_NAME})\]\s*:?[ \t]*", re.I)),
    ("colon", re.compile(rf"({_NAME})\s*:[ \t]*", re.I)),
)


def marker(line: str) -> tuple[str, str | None, int]:
    """Kind of marker, its role, and where the text begins."""
    for kind, pattern in _MARKERS:
        if m := pattern.match(line):
            return kind, _ROLE_OF[m[1].lower()], m.end()
    return "none", None, 0


MARKS = ["none"] + [f"{kind}-{role}" for kind, _ in _MARKERS for role in ROLES]
_MARK = {m: i for i, m in enumerate(MARKS)}
SIZES = (len(MARKS), 2, 2, 2, 4)


def line_features(lines: list[str]) -> np.ndarray:
    out = np.zeros((len(lines), len(SIZES)), np.int64)
    for i, line in enumerate(lines):
        kind, role, _ = marker(line)
        blank = not line.strip()
        out[i] = (_MARK["none" if role is None else f"{kind}-{role}"], blank, i > 0 and not lines[i - 1].strip(), line.rstrip().endswith("?"), 0 if blank else 1 + (len(line) > 60) + (len(line) > 240))
    return out


class Hmm:
    """State 2r begins a turn of role r, state 2r + 1 is inside it."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def train(cls, examples: Iterable[tuple[list[str], list[int]]]) -> Hmm:
        n = 2 * len(ROLES)
        start, step = np.ones(n), np.zeros((n, n))
        emit = [np.ones((n, k)) for k in SIZES]
        for a in range(n):
            step[a, ::2] = 1  # any role may begin
            step[a, a | 1] = 1  # or the turn goes on
        start[1::2] = 0
        for lines, states in examples:
            if not states:
                continue
            seen = line_features(lines)
            start[states[0]] += 1
            np.add.at(step, (states[:-1], states[1:]), 1)
            for f, table in enumerate(emit):
                np.add.at(table, (states, seen[:, f]), 1)
        with np.errstate(divide="ignore"):
            return cls(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), [np.log(t / t.sum(1, keepdims=True)) for t in emit])

    def viterbi(self, lines: list[str]) -> list[int]:
        if not lines:
            return []
        seen = line_features(lines)
        each = sum(table[:, seen[:, f]] for f, table in enumerate(self.emit)).T
        best, back = self.start + each[0], np.zeros(each.shape, np.int64)
        for i in range(1, len(lines)):
            reach = best[:, None] + self.step
            back[i] = reach.argmax(0)
            best = reach.max(0) + each[i]
        path = [int(best.argmax())]
        for i in range(len(lines) - 1, 0, -1):
            path.append(int(back[i, path[-1]]))
        return path[::-1]


def turns_of(lines: list[str], states: list[int]) -> list[tuple[str, str]]:
    """(role, text) of each turn, without its marker and the blank lines around."""
    out: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, states, strict=True):
        if state % 2 == 0 or not out:
            out.append((ROLES[state // 2], []))
            # A marker of another role than the decoded one is text.
            _, role, end = marker(line)
            line = line[end:] if role == ROLES[state // 2] else line
        out[-1][1].append(line)
    return [(role, "\n".join(own).strip("\n")) for role, own in out]


#: The delimiters of rendered turns, where a text has them: a blank goes in, so no text can begin or end a turn.
_FORGED = re.compile(r"<\|(?=im_(?:start|end)\|>)")


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|im_start|>{role}\n{_FORGED.sub('<| ', text)}<|im_end|>\n" for role, text in turns)


def parse(text: str, model: Hmm) -> list[tuple[str, str]]:
    lines = text.split("\n") if text else []
    return turns_of(lines, model.viterbi(lines))


#: How each style opens a turn of a role; None: a blank line alone. Fixed values.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "Context: ", "user": "Human: ", "assistant": "AI: "},
    {"system": "### System:\n", "user": "### Instruction:\n", "assistant": "### Response:\n"},
    {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"},
    {"system": "**System**: ", "user": "**User**: ", "assistant": "**Assistant**: "},
    {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] "},
    {"system": "Instructions: ", "user": "Q: ", "assistant": "A: "},
    {"system": "", "user": "", "assistant": ""},
)


def write(turns: list[tuple[str | None, str]], style: int) -> tuple[str, list[int]]:
    """A transcript and the true state of each of its lines (-1: a role that isn't known)."""
    lines: list[str] = []
    states: list[int] = []
    for role, text in turns:
        if lines:
            lines.append("")
            states.append(states[-1] | 1 if states[-1] >= 0 else -1)
        own = (STYLES[style].get(role or "", "") + text).split("\n")
        k = 2 * ROLES.index(role) if role in ROLES else -1
        states += [k] + [k + 1 if k >= 0 else -1] * (len(own) - 1)
        lines += own
    return "\n".join(lines), states


def transcripts(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Per conversation, segment and branch: its turns in order."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.coalesce(F.col(turn), F.lit(0)).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    shared = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "n")
    rows = rows.join(shared, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left")
    branch = F.pmod(F.xxhash64("role", "text"), F.coalesce("n", F.lit(1)))
    rows = rows.select("conv_id", F.floor(F.col("turn") / segment).alias("segment"), branch.alias("branch"), "turn", "role", "text")
    own = rows.groupBy("conv_id", "segment", "branch").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    return own.withColumn("style", style)


def train(written: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Hmm:
    """Fit on the ``sample`` transcripts of least hash, all of whose roles are known, up to ``sample_bytes`` of text."""
    key = ["h", "conv_id", "segment", "branch"]
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t["text"]))
    known = written.where(F.forall("turns", lambda t: F.coalesce(t["role"].isin(*ROLES), F.lit(False))))
    known = known.withColumn("h", F.xxhash64("conv_id", "segment", "branch")).withColumn("size", size).where(F.col("size") <= sample_bytes)
    # The bounds act on keys and sizes alone; then only the rows up to the last that fits are fetched.
    sizes = known.select(*key, "size").orderBy(*key).limit(sample).collect()
    n = int(np.searchsorted(np.cumsum([r["size"] for r in sizes]), sample_bytes, side="right"))
    if not n:
        return Hmm.train([])
    rows = known.where(F.col("h") <= sizes[n - 1].h).orderBy(*key).limit(n)
    written_out = (write([(t.role, t.text) for t in r.turns], r.style) for r in rows.toLocalIterator())
    return Hmm.train((text.split("\n"), states) for text, states in written_out)


FORMATTED = "struct<n_lines:long, n_turns:long, roles:string, n_right:long, n_known:long, chat:string>"
_FORMATTED = pa.struct([("n_lines", pa.int64()), ("n_turns", pa.int64()), ("roles", pa.string()), ("n_right", pa.int64()), ("n_known", pa.int64()), ("chat", pa.string())])


def format_transcripts(written: DataFrame, model: Hmm) -> DataFrame:
    """Transcripts written in their styles, parsed without their labels, rendered; and lines whose role is right."""

    @F.arrow_udf(FORMATTED)
    def formatted(turns: pa.Array, style: pa.Array) -> pa.Array:
        out = []
        for own, k in zip(turns.to_pylist(), style.to_pylist(), strict=True):
            text, truth = write([(t["role"], t["text"]) for t in own], k)
            lines = text.split("\n")
            states = model.viterbi(lines)
            got = turns_of(lines, states)
            known = [(a // 2, b // 2) for a, b in zip(truth, states, strict=True) if a >= 0]
            out.append({"n_lines": len(lines), "n_turns": len(got), "roles": ",".join(r for r, _ in got), "n_right": sum(a == b for a, b in known), "n_known": len(known), "chat": render(got)})
        return pa.array(out, _FORMATTED)

    return written.select("conv_id", "segment", "branch", formatted("turns", "style").alias("r")).select("conv_id", "segment", "branch", "r.*")


def parse_column(text: Column, model: Hmm) -> Column:
    """Canonical renderings of a column of transcripts."""

    @F.arrow_udf("string")
    def parsed(column: pa.Array) -> pa.Array:
        return pa.array([render(parse(t or "", model)) for t in column.to_pylist()], pa.string())

    return parsed(text)
