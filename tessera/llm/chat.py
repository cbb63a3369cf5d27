"""Roles of transcript turns by a hidden Markov model, and canonical rendering.

A transcript is a row of lines.  Each line has a hidden state, a role and whether
the line starts a turn of that role or goes on with it.  What is seen of a line:
a speaker marker in front of it (``User:``, ``### Assistant``, ``<|system|>`` ...),
whether a blank line or the transcript's start comes before it, its length, how
it ends, and the length of the message so far.  Viterbi's algorithm gives the
most probable states; turns are then written in one canonical form.

The probabilities are counted from labelled turns: a bounded sample of about
``SAMPLE`` conversations, chosen by a hash of ``conv_id``.  Start states follow
the blank line between messages, so roles need not be marked in the text; roles
of the rows that are parsed are never read.

A conversation of any length is parsed in chunks of at most ``CHUNK`` rows, counted
in their order and not by their turn numbers.  A chunk
alone gives, for each state before it (or none), the best score of each state at its end;
the chunks of a long conversation are joined over these small tables, and each
chunk is then decoded between its fixed ends.  So no task holds more than one
chunk, and the result is that of Viterbi over the whole conversation.

Null text counts as an empty message (no line, no turn); rows with a null
``conv_id`` form one conversation, a null ``turn`` comes first, and equal turns
are ordered by text.  Repeated rows are messages of their own.  Extra columns
are ignored.  Labels other than those of ``ROLES`` are not learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_arrow, saved

ROLES = ("system", "user", "assistant")
SAMPLE = 4_000
CHUNK = 256
SMOOTHING = 0.5
MARKERS = {
    "system": r"system|instructions?|context",
    "user": r"user|human|customer|question|q|prompter|you",
    "assistant": r"assistant|ai|bot|agent|model|answer|a|chatgpt|gpt",
}
#: Share of lines that a marker of the right role is taken to stand for, whatever the sample holds.
MARKED = {True: 0.08, False: 0.0005}
_NAMES = "|".join(f"(?P<{role}>{names})" for role, names in MARKERS.items())
MARKER = re.compile(rf"\s*(?:<\|(?:im_start\|>)?\s*|\#{{1,4}}\s*|\*\*|\[)?\s*(?:{_NAMES})\s*(?:\|>|\]|\*\*)?\s*(?::|>|\|>|\]|\*\*:?|$)\s*", re.I)
#: States: a role's first line, and its further lines.
STATES = [(role, start) for role in ROLES for start in (True, False)]


def split_marker(line: str) -> tuple[str | None, str]:
    """The role that a speaker marker names, and the line without the marker."""
    m = MARKER.match(line)
    if not m:
        return None, line
    return next(r for r in ROLES if m[r]), line[m.end():]


def _bucket(n: int) -> int:
    return min(10, int(math.log2(n + 1)))


def seen(text: str | None, first: bool) -> list[tuple]:
    """What is seen of each line of a message; ``first``: the transcript starts here."""
    out, so_far = [], 0
    lines = [x for x in (text or "").split("\n") if x.strip()]
    whole = sum(map(len, lines))
    for i, line in enumerate(lines):
        marker, rest = split_marker(line)
        gap = "first" if first and i == 0 else "blank" if i == 0 else "none"
        out.append((marker, gap, _bucket(len(rest)), rest[-1:] if rest[-1:] in "?!.:" else "", _bucket(whole if i == 0 else so_far)))
        so_far += len(line)
    return out


class Model:
    """Log probabilities from counts."""

    def __init__(self, counts: dict[str, int]):
        get = counts.get
        n = len(STATES)
        self.step = np.zeros((n, n))
        self.start = np.full(n, -1e9)
        for i, (role, _) in enumerate(STATES):
            row = np.array([get(f"t={i}>{j}", 0) + (SMOOTHING if STATES[j][1] or STATES[j][0] == role else 0) for j in range(n)], dtype=float)
            self.step[i] = np.log(np.maximum(row / row.sum(), 1e-12))
            if STATES[i][1]:
                self.start[i] = math.log(get(f"t=>{i}", 0) + SMOOTHING)
        self.counts, self.memo = counts, {}
        self.total = [sum(v for k, v in counts.items() if k.startswith(f"gap={i}=")) + 1.0 for i in range(n)]

    def emit(self, what: tuple) -> np.ndarray:
        """Log probability of what is seen under each state (its parts independent given the state)."""
        if what not in self.memo:
            marker, gap, size, end, so_far = what
            row = np.zeros(len(STATES))
            for i, (role, start) in enumerate(STATES):
                for name, value in (("gap", gap), ("size", size), ("end", end), ("far", so_far)):
                    row[i] += math.log((self.counts.get(f"{name}={i}={value}", 0) + SMOOTHING) / (self.total[i] + 12 * SMOOTHING))
                if marker is not None:
                    row[i] += math.log(MARKED[start and marker == role])
            self.memo[what] = row
        return self.memo[what]

    def table(self, lines: list[tuple]) -> np.ndarray:
        """Best score from each state before the lines to each state at their end (max-plus product)."""
        best = np.where(np.eye(len(STATES), dtype=bool), 0.0, -np.inf)
        for what in lines:
            best = (best[:, :, None] + self.step[None]).max(axis=1) + self.emit(what)[None, :]
        return best

    def viterbi(self, lines: list[tuple], before: int | None = None, end: int | None = None) -> list[int]:
        """Most probable states; ``before``: the state of the line before, ``end``: that of the last line, if known."""
        if not lines:
            return []
        score = (self.start if before is None else self.step[before]) + self.emit(lines[0])
        back = []
        for what in lines[1:]:
            options = score[:, None] + self.step
            back.append(options.argmax(axis=0))
            score = options.max(axis=0) + self.emit(what)
        state = int(score.argmax()) if end is None else end
        states = [state]
        for b in reversed(back):
            state = int(b[state])
            states.append(state)
        return states[::-1]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


def _numbered(conversations: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Rows with ``_chunk``, written once: the ordered rows are cut into ranges and, within
    one, each conversation's rows into chunks of ``CHUNK``, whatever their turns are."""
    conv, size = conversations.schema["conv_id"].dataType.simpleString(), CHUNK
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 40)))
    # the last column deals out repeated rows
    order = ["conv_id", "_turn", "text", "_row"]
    d = conversations.select("conv_id", turn.alias("_turn"), F.col("turn").cast("long").alias("turn"), "text", *columns).withColumn("_row", F.monotonically_increasing_id())
    names = ["conv_id", "_turn", "turn", "text", *columns]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select(*names)

    def number(batches):
        base, last, n = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            chunks = []
            for key in batch.column(0).to_pylist():
                n = n + 1 if last == (key,) else 0
                last = (key,)
                chunks.append(base + n // size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, pa.int64())], names=[*names, "_chunk"])

    return saved(map_arrow(d, number, f"conv_id {conv}, _turn bigint, turn bigint, text string, {''.join(f'{c} string, ' for c in columns)}_chunk bigint"), name)


def _ends(rows: DataFrame) -> DataFrame:
    """First and last chunk of each conversation."""
    return rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_chunk").alias("_a"), F.max("_chunk").alias("_b"))


def _chunks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Numbered rows, a chunk's rows side by side and in order."""
    return rows.repartition("conv_id", "_chunk").sortWithinPartitions("conv_id", "_chunk", "_turn", "text").select("conv_id", "_chunk", *columns)


def _groups(batches, n_key: int):
    """Lists of consecutive rows with the same first ``n_key`` values."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[:n_key] != key:
                yield key, rows
                rows = []
            key = row[:n_key]
            rows.append(row)
    if rows:
        yield key, rows


def _sampled(conversations: DataFrame, sample: int) -> Column:
    n = conversations.select(F.approx_count_distinct("conv_id")).first()[0]
    return F.pmod(F.xxhash64(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), F.lit(1_000_000)) * F.lit(max(n, 1)) < sample * 1_000_000


def fit(conversations: DataFrame, sample: int = SAMPLE, held_out: Column | None = None) -> dict[str, int]:
    """Counts of the model from labelled conversations (but for those ``held_out``)."""
    chosen = conversations.where(_sampled(conversations, sample) & F.col("role").isin(*ROLES))
    if held_out is not None:
        chosen = chosen.where(~held_out)
    rows = _numbered(chosen, ["role"], "chat-sample")
    ends = _ends(rows)
    d = rows.join(ends, rows["conv_id"].eqNullSafe(ends["_conv"])).withColumn("_head", F.col("_chunk") == F.col("_a"))
    d = _chunks(d, ["_head", "text", "role"])

    def count(batches):
        found: Counter = Counter()
        for _, rows in _groups(batches, 2):
            state = None
            for _, _, head, text, role in rows:
                for j, what in enumerate(seen(text, state is None and head)):
                    new = STATES.index((role, j == 0))
                    if state is not None or head:
                        found[f"t={'' if state is None else state}>{new}"] += 1
                    for name, value in zip(("gap", "size", "end", "far"), what[1:]):
                        found[f"{name}={new}={value}"] += 1
                    state = new
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["name", "n"])

    rows = map_arrow(d, count, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n")).collect()  # states and buckets
    return {r["name"]: r["n"] for r in rows}


def parse(conversations: DataFrame, counts: dict[str, int] | None = None, sample: int = SAMPLE) -> DataFrame:
    """A row per recovered turn: ``conv_id, first_turn`` and ``first_line`` (where
    it begins; blank lines do not count), ``n_lines, role, text`` (whole, with its blank lines, but without the
    marker that starts the turn) and ``rendered``."""
    counts = fit(conversations, sample) if counts is None else counts
    model_of = conversations.sparkSession.sparkContext.broadcast(counts)  # states and buckets
    conv = conversations.schema["conv_id"].dataType.simpleString()
    kind = to_arrow_type(conversations.schema["conv_id"].dataType)
    d = _numbered(conversations, [], "chat")
    several = _ends(d).where("_a < _b").select("_conv")  # conversations of more than one chunk
    long_rows = d.join(several, d["conv_id"].eqNullSafe(several["_conv"]), "left_semi")

    def tables(batches):
        model = Model(model_of.value)
        convs, chunks, flat = [], [], []
        for (conv_id, chunk), rows in _groups(batches, 2):
            lines, first = [], []
            for r in rows:
                first += seen(r[2], not first)
                lines += seen(r[2], False)
            if lines:
                head = model.start + model.emit(first[0])
                if len(lines) > 1:
                    head = (head[:, None] + model.table(lines[1:])).max(axis=0)
                convs.append(conv_id)
                chunks.append(chunk)
                flat.append([*head.tolist(), *model.table(lines).ravel().tolist()])
        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(chunks, pa.int64()), pa.array(flat, pa.list_(pa.float64()))], names=["conv_id", "_chunk", "best"])

    def join(batches):
        """States before and at the end of each chunk of a conversation, from the chunks' tables."""
        out, n = [], len(STATES)
        for (conv_id,), rows in _groups(batches, 1):
            score, back = None, []
            for _, _, flat in rows:
                if score is None:  # nothing before it
                    score, option = np.array(flat[:n]), [None] * n
                else:
                    options = score[:, None] + np.array(flat[n:]).reshape(n, n)
                    score, option = options.max(axis=0), options.argmax(axis=0).tolist()
                back.append(option)
            state = int(score.argmax())
            for (_, chunk, _), b in zip(reversed(rows), reversed(back)):
                out.append((conv_id, chunk, b[state], state))
                state = b[state]
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, pa.int64(), pa.int32(), pa.int32()])], names=["_conv", "_c", "_before", "_end"])

    small = map_arrow(_chunks(long_rows, ["text"]), tables, f"conv_id {conv}, _chunk bigint, best array<double>")
    ends = saved(map_arrow(small.repartition("conv_id").sortWithinPartitions("conv_id", "_chunk"), join, f"_conv {conv}, _c bigint, _before int, _end int"), "chat-ends")
    chunked = d.join(ends, d["conv_id"].eqNullSafe(ends["_conv"]) & (d["_chunk"] == ends["_c"]), "left")
    ready = _chunks(chunked, ["_turn", "text", "turn", "_before", "_end"])

    def decode(batches):
        model = Model(model_of.value)
        out = []
        for (conv_id, _), rows in _groups(batches, 2):
            before, end = rows[0][5], rows[0][6]
            lines, where = [], []
            for row in rows:
                lines += seen(row[3], not lines and before is None)
                blank, j = [], 0
                for x in (row[3] or "").split("\n"):
                    if x.strip():
                        where.append((row[4], j, x, blank))
                        blank, j = [], j + 1
                    else:
                        blank.append(x)
                if j:  # blank lines at a message's end
                    where[-1] += (blank,)
            current: list = []
            for state, (turn, j, line, above, *below) in zip(model.viterbi(lines, before, end), where):
                role, start = STATES[state]
                if start or not current:
                    if current and j:  # blank lines between two turns of a message belong to the first
                        current[5] += above
                        above = []
                    current = [conv_id, turn, j, 0, role, []]
                    out.append(current)
                own = [line]
                if start and split_marker(line)[0] == role:  # a marker elsewhere is a part of the text
                    own = [x for x in (split_marker(line)[1],) if x]
                current[3] += 1
                current[5] += [*above, *own, *(below[0] if below else [])]
            if len(out) >= 4096:
                yield _turns(out, kind)
                out = []
        yield _turns(out, kind)

    return map_arrow(ready, decode, f"conv_id {conv}, first_turn bigint, first_line int, n_lines int, role string, text string, rendered string")


def _turns(out: list[list], kind: pa.DataType) -> pa.RecordBatch:
    texts = ["\n".join(r[5]) for r in out]
    columns = [[r[i] for r in out] for i in range(5)] + [texts, [render(r[4], t) for r, t in zip(out, texts)]]
    kinds = [kind, pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "first_turn", "first_line", "n_lines", "role", "text", "rendered"])
