"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

A transcript is a conversation's text, given as rows in order; where a row ends means nothing, its lines simply follow the
row before. Speaker markers (``User:``, ``### Response``, ``<|assistant|>``, ``Q.``) may stand at a line's beginning, or be
missing throughout. The hidden states are whether the transcript has markers, the role, and the place, the first or a
later line of a turn. A line's features are its marker's role, whether it begins the transcript or follows a blank line,
its length and how it ends. Transitions and emissions are smoothed counts of a bounded sample of labelled conversations
(``SAMPLE`` of them, of each the first ``SAMPLE_TURNS`` turns, of each the first ``SAMPLE_CHARS`` characters); Viterbi
recovers the states. A turn's canonical form is ``<|role|>``, a line break, its lines without markers.

A conversation may hold a third of all rows, so rows are dealt by range of (conversation, turn, text), and Viterbi runs in
each part. Only the first and the last conversation of a part can go on in another: for these each part gives the best
score from each state before it to each state at its end (a max-plus matrix), a pass over a conversation's matrices, one
for each part, picks the states at the parts' edges, and each part is decoded between them. The result is that of one long
pass.

Defined results: a null text is empty and has one empty line; a null turn is ordered first; rows of a null conversation are
one conversation; rows that agree in conversation, turn and text count once, and rows of one turn are ordered by a hash of
their text; without labelled rows all lines are the user's. Further columns don't matter; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, written

ROLES = ("system", "user", "assistant")
#: Of transcripts with markers, then of those without.
STATES = [(marked, role, first) for marked in (True, False) for role in ROLES for first in (True, False)]
_HALF = len(STATES) // 2
#: Bytes of text in a part.
PART_BYTES = 16 << 20
SAMPLE, SAMPLE_TURNS, SAMPLE_CHARS = 2000, 64, 1 << 14
FOLDS = 5
HELD_OUT = 0
#: Names that speakers go by (fixed values).
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "q", "question", "instruction", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "response", "model", "agent"),
}
#: Ways of writing a conversation, for making transcripts out of labelled turns: what stands before a turn of each role, and
#: behind it. The last has no markers, only blank lines between turns.
STYLES = (
    (("System: ", "User: ", "Assistant: "), ""),
    (("[system] ", "[human] ", "[ai] "), ""),
    (("### Context\n", "### Instruction\n", "### Response\n"), ""),
    (("<|system|>\n", "<|user|>\n", "<|assistant|>\n"), ""),
    (("", "", ""), "\n"),
)
_WHO = {name: role for role, names in NAMES.items() for name in names}
_MARKER = re.compile(r"^\s*(?:###\s*(\w+)\s*:?\s*$|<\|(\w+)\|>\s*|\[(\w+)\]\s*:?\s+|\*{0,2}(\w+)\*{0,2}\s*[:.]\s+)")
_LOW = -1e9


def marker(line: str) -> tuple[str, int]:
    """Role that a line's marker names, and the marker's length; ("", 0) without one."""
    m = _MARKER.match(line)
    name = next((g for g in m.groups() if g), "").lower() if m else ""
    return (_WHO[name], m.end()) if m and name in _WHO else ("", 0)


def features(lines: list[str], after: str | None = None) -> np.ndarray:
    """Marker, place, length and ending of each line; ``after`` is the line before the first one (None: there is none)."""
    out = []
    for line in lines:
        role, _ = marker(line)
        body = line.strip()
        place = 0 if after is None else 2 if after.strip() else 1
        size = 0 if not body else min(6, 1 + len(body).bit_length() // 2)
        end = 0 if not body else 1 if body[-1] == "?" else 2 if body[-1] in ".!" else 3 if body[-1] == ":" else 4
        out.append((1 + ROLES.index(role) if role else 0, place, size, end))
        after = line
    return np.array(out)


_SIZES = (len(ROLES) + 1, 3, 7, 5)


class Model:
    """Log probabilities: start, transitions, and emissions of each feature."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]) -> None:
        self.start, self.move, self.emit = start, move, emit
        self.blocks = np.stack([move[:_HALF, :_HALF], move[_HALF:, _HALF:]])

    def scores(self, found: np.ndarray) -> np.ndarray:
        return sum(e[:, found[:, i]].T for i, e in enumerate(self.emit))

    def matrix(self, scores: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines to each at their end; markers are there throughout or nowhere."""
        best = np.stack([np.where(np.eye(_HALF, dtype=bool), 0.0, _LOW)] * 2)
        for row in scores.reshape(-1, 2, 1, _HALF):
            best = (best[:, :, :, None] + self.blocks[:, None]).max(axis=2) + row
        out = np.full((len(STATES), len(STATES)), _LOW)
        out[:_HALF, :_HALF], out[_HALF:, _HALF:] = best
        return out

    def forward(self, scores: np.ndarray) -> np.ndarray:
        """Best score of each state at the end of lines that begin a transcript."""
        now = self.start + scores[0]
        for row in scores[1:]:
            now = (now[:, None] + self.move).max(axis=0) + row
        return now

    def decode(self, scores: np.ndarray, before: int = -1, last: int = -1) -> list[int]:
        """Best states of the lines, given the state before them (-1: none) and the last one (-1: any)."""
        now, back = (self.start if before < 0 else self.move[before]) + scores[0], np.zeros((len(scores), len(STATES)), np.uint8)
        for k, row in enumerate(scores[1:], 1):
            step = now[:, None] + self.move
            back[k] = step.argmax(axis=0)
            now = step.max(axis=0) + row
        path = [last if last >= 0 else int(now.argmax())]
        for b in back[:0:-1]:
            path.append(int(b[path[-1]]))
        return path[::-1]


def fit(conversations: list[list[tuple[str, str]]]) -> Model:
    """Smoothed counts over conversations of (role, transcript text) turns."""
    n = len(STATES)
    start, move, emit = np.full(n, 0.1), np.full((n, n), 0.05), [np.full((n, s), 0.01 if k == 0 else 1.0) for k, s in enumerate(_SIZES)]
    move[:_HALF, _HALF:] = move[_HALF:, :_HALF] = 0
    for k, (_, role, first) in enumerate(STATES):  # without any count, all lines are one user's
        start[k] += role == "user" and first
        move[k, [STATES.index((STATES[k][0], role, False))]] += 0.5
    for turns in conversations:
        marked = any(marker(text.split("\n")[0])[0] for _, text in turns)
        truth = [(marked, role, k == 0) for role, text in turns for k in range(text.count("\n") + 1)]
        states = [STATES.index(t) for t in truth]
        start[states[0]] += 1
        np.add.at(move, (states[:-1], states[1:]), 1)
        for f, e in zip(features("\n".join(text for _, text in turns).split("\n")).T, emit, strict=True):
            np.add.at(e, (states, f), 1)
    for k, (marked, role, first) in enumerate(STATES):  # what a marker names is known without counting
        emit[0][k] += [0.5, *(2000.0 if r == role else 0.0 for r in ROLES)] if marked and first else [2000.0, *(0.0 for _ in ROLES)]
    with np.errstate(divide="ignore"):
        return Model(np.log(start / start.sum()), np.maximum(np.log(move / move.sum(axis=1, keepdims=True)), _LOW), [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit])


def as_transcripts(turns: DataFrame) -> DataFrame:
    """Labelled turns as transcript rows ``conv_id, turn, role, text``: a conversation's style is fixed by its id."""
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(len(STYLES))).cast("int")
    role = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 2).otherwise(1)
    marks = F.array(*[F.array(*[F.lit(m) for m in s]) for s, _ in STYLES])
    ends = F.array(*[F.lit(e) for _, e in STYLES])
    return turns.select("conv_id", "turn", F.col("role"), F.concat(F.get(F.get(marks, style), role), F.coalesce("text", F.lit("")), F.get(ends, style)).alias("text"))


def train(labelled: DataFrame) -> Model:
    """Learns from conversations outside fold ``HELD_OUT``: those of the smallest hashed ids."""
    known = labelled.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & (F.crc32(F.col("conv_id").cast("string")) % FOLDS != HELD_OUT))
    ids = known.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE)
    rows = known.join(F.broadcast(ids), "conv_id").select("conv_id", "turn", "role", F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS).alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.xxhash64("text"), "text", "role")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_TURNS).orderBy("conv_id", "place").toArrow().to_pylist()
    return fit([[(r["role"], r["text"]) for r in group] for _, group in groupby(few, key=lambda r: r["conv_id"])])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[dict]]]:
    """The conversations of each part in order, and whether each is its part's first or last."""
    before: list[dict] | None = None
    edge = True
    rows = (r for b in batches for r in b.to_pylist())
    for (part, _), group in groupby(rows, key=lambda r: (r["part"], r["conv_id"])):
        now = list(group)
        if before is not None:
            new = before[0]["part"] != part
            yield edge or new, before
            edge = new
        before = now
    if before is not None:
        yield True, before


def _lines(rows: list[dict]) -> list[str]:
    return [line for r in rows for line in r["text"].split("\n")]


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """One row per distinct row of ``transcripts(conv_id, turn, text)``: ``conv_id, turn, text, roles, begins, rendered``.

    ``roles`` and ``begins`` hold the role of each of the row's lines and whether a turn begins with it. The rows'
    ``rendered`` texts joined by line breaks, in order, are the canonical transcript.
    """
    shared = transcripts.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))
    rows = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = transcripts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(1, -(-total // PART_BYTES), min(transcripts.sparkSession.sparkContext.defaultParallelism, total >> 20)))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(parts, *order[:3]).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("part", F.shiftright("at", 33)), "chat-rows")
    n = len(STATES)
    edges = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("blank", pa.bool_()), ("start", pa.list_(pa.float64())), ("text", pa.list_(pa.float64())), ("gap", pa.list_(pa.float64()))])

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's first and last conversations: end scores if it begins there, and matrices after a text and a blank line."""
        own = Model(*shared.value)
        for outer, group in _segments(batches):
            if outer:
                lines = _lines(group)
                found = features(lines)
                one = {"conv_id": group[0]["conv_id"], "part": group[0]["part"], "at": group[0]["at"], "blank": not lines[-1].strip(), "start": own.forward(own.scores(found)).tolist()}
                for name, place in (("text", 2), ("gap", 1)):
                    found[0, 1] = place
                    one[name] = own.matrix(own.scores(found)).ravel().tolist()
                yield pa.RecordBatch.from_pylist([one], schema=edges)

    ends = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("last", pa.int32()), ("blank", pa.bool_())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for _, group in groupby(rows, key=lambda r: r["conv_id"]):
            now, froms, known = None, [], []
            for r in group:
                if now is None:
                    now, came, gap = np.array(r["start"]), np.full(n, -1), None
                else:
                    step = now[:, None] + np.array(r["gap" if blank else "text"]).reshape(n, n)
                    now, came, gap = step.max(axis=0), step.argmax(axis=0), blank
                froms.append(came)
                known.append({"conv_id": r["conv_id"], "part": r["part"], "at": r["at"], "blank": gap})
                blank = r["blank"]
            last = int(now.argmax())
            for k, f in zip(reversed(known), reversed(froms), strict=True):
                k |= {"before": int(f[last]), "last": last}
                last = int(f[last])
            yield pa.RecordBatch.from_pylist(known, schema=ends)

    dealt_again = dealt.repartition(parts, "part").sortWithinPartitions("part", "at")
    found = written(dealt_again.mapInArrow(edge, "conv_id long, part long, at long, blank boolean, start array<double>, text array<double>, gap array<double>"), "chat-edges")
    joints = written(found.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(chain, "conv_id long, part long, at long, before int, last int, blank boolean"), "chat-joints")
    free(found)

    made = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("text", pa.string()), ("roles", pa.list_(pa.string())), ("begins", pa.list_(pa.bool_())), ("rendered", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for _, group in _segments(batches):
            joint = group.pop(0) if group[0]["text"] is None else None  # an edge's states stand before its rows
            found = features(_lines(group))
            if joint and joint["blank"] is not None:
                found[0, 1] = 1 if joint["blank"] else 2
            states = iter(own.decode(own.scores(found), *((joint["before"], joint["last"]) if joint else ())))
            out = []
            for r in group:
                lines, shown = r["text"].split("\n"), []
                got = [STATES[next(states)] for _ in lines]
                for (_, role, first), line in zip(got, lines, strict=True):
                    if first:
                        shown.append(f"<|{role}|>")
                    body = line[marker(line)[1] :] if first else line
                    if body or not first:
                        shown.append(body)
                out.append({"conv_id": r["conv_id"], "turn": r["turn"], "text": r["text"], "roles": [role for _, role, _ in got], "begins": [first for _, _, first in got], "rendered": "\n".join(shown)})
            yield pa.RecordBatch.from_pylist(out, schema=made)

    none = lambda kind: F.lit(None).cast(kind)
    texts = dealt.select("conv_id", "part", "at", F.lit(1).alias("row"), "turn", "text", none("int").alias("before"), none("int").alias("last"), none("boolean").alias("blank"))
    states = joints.select("conv_id", "part", "at", F.lit(0).alias("row"), none("long").alias("turn"), none("string").alias("text"), "before", "last", "blank")
    both = texts.unionByName(states).repartition(parts, "part").sortWithinPartitions("part", "at", "row")
    return both.mapInArrow(decode, "conv_id long, turn long, text string, roles array<string>, begins array<boolean>, rendered string")


def report(conversations: DataFrame) -> DataFrame:
    """Transcripts made of ``conversations``, parsed: ``conv_id, turn, role, turns, rendered_md5, held_out``.

    ``role`` is that of the row's first line, ``turns`` the number of turns that begin in the row.
    """
    transcripts = as_transcripts(conversations)
    made = parse(transcripts.select("conv_id", "turn", "text"), train(transcripts))
    held_out = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT
    turns = F.size(F.filter("begins", lambda x: x)).cast("long")
    return made.select("conv_id", "turn", F.get("roles", 0).alias("role"), turns.alias("turns"), F.md5("rendered").alias("rendered_md5"), held_out.alias("held_out"))
