"""Chat formatting: a hidden Markov model recovers the roles of transcript lines, then turns are rendered canonically.

States are (role, first line or later line of a turn) for system, user and assistant.  A line is observed through its
speaker marker ("User:", "### Assistant", "<|system|>", "Q:", ...), whether the line before is blank, and its length,
question mark and list or code marks.  Start, transition and emission tables are smoothed counts over labelled turns;
Viterbi finds the likeliest states, and each first-line state opens a turn.

Texts are kept as they are, but that a marker inside a turn's text that the canonical form uses ("<|") is written with a
backslash in between ("<\\|"; one more where there are some), so no text can forge a turn; ``turns`` reads it back.

Long conversations are held in segments of at most ``SEGMENT`` turns, so a task never holds more than one segment and a
conversation with a share of all rows spreads over many tasks.  The path is the best of the whole conversation all the
same: a segment is summed up as a matrix (best path from each state of its first line to each of its last line),
matrices are multiplied in groups of ``FAN`` segments, level by level, and the states at the segments' ends are found
from the top down.  A conversation's chat is its pieces by segment (null first) and part, one after another; most have
one.  Training counts inside segments and at their seams, so its tables are those of whole conversations.

Nulls and edge cases: a null or empty text is a turn with one empty line; null turns sort first; unknown or null roles
are written without a marker and count for no training; rows that share a turn follow each other by role and text; a
null conversation id is a conversation of its own; empty tables give no rows; texts are never cut; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import staged
from weftline.operators.scans import numbered

ROLES = ("system", "user", "assistant")
SEGMENT = 64
FAN = 1024
#: Speaker names by role and the shapes in which transcripts write them.
NAMES = {"system": ("System", "Instruction", "SYS"), "user": ("User", "Human", "Q"), "assistant": ("Assistant", "AI", "A")}
STYLES = ("{}: ", "### {}\n", "<|{}|> ", "[{}] ", "**{}:** ", "{} > ")
_BY_NAME = {n.lower(): r for r, names in NAMES.items() for n in (*names, r)} | {"bot": "assistant", "model": "assistant", "gpt": "assistant", "prompter": "user", "question": "user", "answer": "assistant", "customer": "user", "agent": "assistant", "context": "system"}
_NAME = "|".join(sorted(_BY_NAME, key=len, reverse=True))
_MARKER = re.compile(rf"\s*(?:###\s*(?P<a>{_NAME})\s*:?\s*$|<\|(?P<b>{_NAME})\|>\s?|\[(?P<c>{_NAME})\]:?\s?|\*\*(?P<d>{_NAME}):?\*\*:?\s?|(?P<e>{_NAME})\s?[:>]\s?)", re.I)
_LISTED = re.compile(r"\s*(?:[-*+] |\d+[.)] |```|    )")
N_MARK, N_SHAPE = 4, 16
N_FEATURES = N_MARK * N_SHAPE
N_STATES = 2 * len(ROLES)


def marker(line: str) -> tuple[int, int]:
    """(0 for none or 1 + role, length of the marker)."""
    m = _MARKER.match(line)
    if not m:
        return 0, 0
    return 1 + ROLES.index(_BY_NAME[m[m.lastgroup].lower()]), m.end()


def feature(line: str, before: str | None) -> int:
    mark, _ = marker(line)
    size = min(len(line) // 80, 1) + (len(line) > 400)
    shape = (before is None or not before.strip()) + 2 * line.rstrip().endswith("?") + 4 * size
    shape = min(shape, 11) if not _LISTED.match(line) else 12 + (before is None or not before.strip())
    return mark * N_SHAPE + shape


def transcript(said_turns: list[tuple[str | None, str]], key: str, place: str = "") -> tuple[str, list[int]]:
    """A plain transcript of (role, text) turns, with the true state of each line.

    The style depends on ``key`` alone; each ninth turn or so, by ``place`` too, goes without a marker."""
    h = zlib.crc32(key.encode())
    style, which = STYLES[h % len(STYLES)], (h >> 8) % 3
    lines, states = [], []
    for k, (role, text) in enumerate(said_turns):
        known = role in ROLES
        bare = not known or zlib.crc32(f"{key}/{place}/{k}".encode()) % 9 == 0
        said = (text if bare else style.format(NAMES[role][which]) + text).split("\n")
        lines += said
        states += [2 * ROLES.index(role) if known else -1] + [2 * ROLES.index(role) + 1 if known else -1] * (len(said) - 1)
    return "\n".join(lines), states


def features(lines: list[str]) -> list[int]:
    return [feature(line, lines[k - 1] if k else None) for k, line in enumerate(lines)]


def counts(seen: list[int], states: list[int], emit: np.ndarray, move: np.ndarray) -> None:
    before = -1
    for f, state in zip(seen, states, strict=True):
        if state >= 0:
            emit[state, f] += 1
            if before >= 0:
                move[before, state] += 1
        before = state


class Model:
    """Log probabilities from counts with add-a-half smoothing, but for moves that can't be (into a turn's middle from another turn)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, first: np.ndarray):
        can = np.ones((N_STATES, N_STATES), bool)
        for r in range(len(ROLES)):
            can[:, 2 * r + 1] = False
            can[2 * r : 2 * r + 2, 2 * r + 1] = True
        self.emit = np.log(emit + 0.5) - np.log((emit + 0.5).sum(1, keepdims=True))
        soft = np.where(can, move + 0.5, 0)
        with np.errstate(divide="ignore"):
            self.move = np.log(soft) - np.log(soft.sum(1, keepdims=True))
        start = np.where(np.arange(N_STATES) % 2 == 0, first + 0.5, 0)
        with np.errstate(divide="ignore"):
            self.first = np.log(start / start.sum())

    def opening(self, entry: int) -> np.ndarray:
        """Log probability of a line's states after state ``entry`` (-1: at the start)."""
        return self.first if entry < 0 else self.move[entry]

    def viterbi(self, seen: list[int], entry: int = -1, end: int = -1) -> list[int]:
        """The likeliest states of lines with the features ``seen``, after state ``entry`` and up to state ``end`` (-1: any)."""
        score = self.opening(entry) + self.emit[:, seen[0]]
        back = np.empty((len(seen), N_STATES), np.int8)
        for k in range(1, len(seen)):
            paths = score[:, None] + self.move
            back[k] = paths.argmax(0)
            score = paths.max(0) + self.emit[:, seen[k]]
        out = [int(score.argmax()) if end < 0 else end]
        for k in range(len(seen) - 1, 0, -1):
            out.append(int(back[k, out[-1]]))
        return out[::-1]

    def matrix(self, seen: list[int]) -> np.ndarray:
        """The best score from each state of the first line to each of the last, without the first line's own."""
        best = np.where(np.eye(N_STATES, dtype=bool), 0.0, -np.inf)
        for f in seen[1:]:
            best = product(best, self.move) + self.emit[:, f]
        return best


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product with max for plus and plus for times."""
    return (a[:, :, None] + b[None]).max(1)


def spoken(lines: list[str], states: list[int], entry: int = -1, bare: bool = False) -> list[tuple[str | None, str]]:
    """(role, text) turns of a transcript's lines in given states; a line with only a marker isn't part of the text.

    After state ``entry``, lines that go on with the turn before come first, without a role; ``bare``: that turn has
    nothing but its marker so far."""
    out: list[tuple[str | None, list[str]]] = []
    for line, state in zip(lines, states, strict=True):
        if state % 2 == 0:
            cut = marker(line)[1]
            out.append((ROLES[state // 2], [line[cut:]]))
            bare = 0 < cut == len(line)
        elif not out:
            out.append((None if entry >= 0 else ROLES[state // 2], [line]))
            bare = False
        elif bare:
            out[-1][1][0], bare = line, False
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(said)) for role, said in out]


def parse(text: str, model: Model) -> list[tuple[str | None, str]]:
    """(role, text) turns of a transcript."""
    lines = text.split("\n")
    return spoken(lines, model.viterbi(features(lines)))


_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([a-z]+)\n(.*?)<\|im_end\|>\n", re.S)


def render(turns: list[tuple[str | None, str]], entry: int = -1, bare: bool = False, last: bool = True) -> str:
    """The canonical chat of turns, or a piece of one: after state ``entry`` it first closes the turn before or goes on with it."""
    shut = "<|im_end|>\n"
    before = "" if entry < 0 else shut if turns[0][0] else "" if bare else "\n"
    said = shut.join((f"<|im_start|>{role}\n" if role else "") + _OPEN.sub(r"<\\\1|", text) for role, text in turns)
    return before + said + (shut if last and turns else "")


def turns(chat: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a canonical chat."""
    return [(role, _SHUT.sub(r"<\1|", text)) for role, text in _TURN.findall(chat)]


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int | None, int | None, int, list[tuple[str | None, str]]]]:
    """(conv_id, segment, part, turns) from rows sorted by conv_id, segment, turn; a segment over ``most`` rows goes in parts."""
    key, part, held = None, 0, []
    for batch in batches:
        for conv, segment, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "segment", "role", "text")], strict=True):
            if held and ((conv, segment) != key or len(held) == most):
                yield (*key, part, held)
                part, held = (part + 1 if (conv, segment) == key else 0), []
            elif (conv, segment) != key:
                part = 0
            key = (conv, segment)
            held.append((role, text or ""))
    if held:
        yield (*key, part, held)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``most`` characters of their texts."""
    held, size = [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
        if size > most:
            yield pack()
            held, size = [], 0
    if held:
        yield pack()


def segments(conversations: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Each conversation as transcripts of at most ``size`` turns: conv_id, segment, part, n_turns, text, truth (a byte per line: its
    state), seen (a byte per line: its features), plain (features of the first line if the line before isn't blank), blank, bare
    (whether the last line is blank, or nothing but a marker).  A written table."""
    source = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    arranged = source.withColumn("segment", F.expr(f"(turn - pmod(turn, {size})) div {size}")).repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "role", "text")
    names = ["conv_id", "segment", "part", "n_turns", "text", "truth", "seen", "plain", "blank", "bare"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.bool_()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv, segment, part, said in _segments(batches, size):
                text, states = transcript(said, str(conv), f"{segment}/{part}")
                lines = text.split("\n")
                cut = marker(lines[-1])[1]
                yield conv, segment, part, len(said), text, np.array(states, np.int8).tobytes(), bytes(features(lines)), feature(lines[0], "-"), not lines[-1].strip(), 0 < cut == len(lines[-1])

        yield from _batches(rows(), names, kinds)

    schema = "conv_id bigint, segment bigint, part int, n_turns bigint, text string, truth binary, seen binary, plain int, blank boolean, bare boolean"
    return staged(arranged.mapInArrow(write, schema), "segments")


def _learner(fold: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, move = np.zeros((N_STATES, N_FEATURES), np.int64), np.zeros((N_STATES, N_STATES), np.int64)
        for batch in batches:
            for conv, truth, seen in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if zlib.crc32(str(conv).encode()) % 5 != fold:
                    counts(list(seen), np.frombuffer(truth, np.int8).tolist(), emit, move)
        flat = np.concatenate([emit.ravel(), move.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.int64())], ["at", "n"])

    return learn


def _seams(parts: DataFrame, fold: int) -> DataFrame:
    """(at, n): what counting pieces one by one misses: starts of conversations, moves from piece to piece, and first lines whose line before isn't blank."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [zlib.crc32(str(c).encode()) % 5 != fold for c in batch.column("conv_id").to_pylist()]
            part = batch.filter(pa.array(keep))
            truth, seen = part.column("truth").to_pylist(), part.column("seen").to_pylist()
            states = [np.frombuffer(t, np.int8) for t in truth]
            own = [pa.array([int(x[k]) for x in states], pa.int32()) for k in (0, -1)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv_id", "segment", "part")), *own, pa.array([x[0] for x in seen], pa.int32()), part.column("plain"), part.column("blank")], ["conv_id", "segment", "part", "opens", "closes", "after", "plain", "blank"])

    schema = "conv_id bigint, segment bigint, part int, opens int, closes int, after int, plain int, blank boolean"
    pieces = parts.select("conv_id", "segment", "part", "truth", "seen", "plain", "blank").mapInArrow(ends, schema)
    placed = numbered(pieces, ["conv_id"], ["segment", "part"], "place")
    before = placed.select(F.col("conv_id").alias("c"), (F.col("place") + 1).alias("next"), F.col("closes").alias("from"), F.col("blank").alias("parted"))
    both = placed.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("next")), "left").where("opens >= 0")
    emit = lambda f: F.col("opens") * N_FEATURES + F.col(f)
    move, first = N_STATES * N_FEATURES, N_STATES * (N_FEATURES + N_STATES)
    cell = lambda at, n: F.struct(at.cast("int").alias("at"), n.cast("bigint").alias("n"))
    joined = (F.col("place") > 1) & ~F.col("parted")
    cells = [
        cell(first + F.col("opens"), (F.col("place") == 1).cast("int")), cell(move + F.col("from") * N_STATES + F.col("opens"), ((F.col("place") > 1) & (F.col("from") >= 0)).cast("int")),
        cell(emit("plain"), joined.cast("int")), cell(emit("after"), -joined.cast("int")),
    ]
    return both.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").where("n != 0")


def trained(parts: DataFrame, fold: int = 0) -> Model:
    """The model of the ``segments`` of conversations whose crc32(conv_id as text) mod 5 is not ``fold``, as if each were one transcript; what reaches the driver is one small count table."""
    flat = np.zeros(N_STATES * (N_FEATURES + N_STATES + 1))
    inside = parts.select("conv_id", "truth", "seen").mapInArrow(_learner(fold), "at int, n bigint")
    for r in inside.union(_seams(parts, fold)).groupBy("at").agg(F.sum("n").alias("n")).collect():
        flat[r["at"]] = r["n"]
    a, b = N_STATES * N_FEATURES, N_STATES * (N_FEATURES + N_STATES)
    return Model(flat[:a].reshape(N_STATES, N_FEATURES), flat[a:b].reshape(N_STATES, N_STATES), flat[b:])


_SUMMED = "conv_id bigint, segment bigint, part int, best array<double>, plain int, after int, blank boolean, bare boolean"
_ENDS = "conv_id bigint, segment bigint, part int, entry int, was_blank boolean, was_bare boolean, end int, last boolean"


def _in_order(kids: pa.Table) -> list[dict]:
    return sorted(kids.to_pylist(), key=lambda k: (k["segment"] is not None, k["segment"] or 0, k["part"]))


def _summed(model: Broadcast):
    """Segments summed up: their matrix, and the features of their first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for conv, segment, part, seen, plain, blank, bare in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    yield conv, segment, part, model.value.matrix(list(seen)).ravel().tolist(), plain, seen[0], blank, bare

        yield from _batches(rows(), ["conv_id", "segment", "part", "best", "plain", "after", "blank", "bare"], [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()])

    return run


def _united(model: Broadcast):
    """A group of summed-up pieces as one."""

    def run(kids: pa.Table) -> pa.Table:
        m, rows = model.value, _in_order(kids)
        best = np.reshape(rows[0]["best"], (N_STATES, N_STATES))
        for a, b in itertools.pairwise(rows):
            step = m.move + m.emit[:, b["after"] if a["blank"] else b["plain"]]
            best = product(product(best, step), np.reshape(b["best"], (N_STATES, N_STATES)))
        out = {"conv_id": rows[0]["conv_id"], "segment": rows[0]["up"], "part": 0, "best": best.ravel().tolist(), "plain": rows[0]["plain"], "after": rows[0]["after"], "blank": rows[-1]["blank"], "bare": rows[-1]["bare"]}
        return pa.Table.from_pylist([out], pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("part", pa.int32()), ("best", pa.list_(pa.float64())), ("plain", pa.int32()), ("after", pa.int32()), ("blank", pa.bool_()), ("bare", pa.bool_())]))

    return run


def _solved(model: Broadcast):
    """The states at the ends of a group's pieces, from those at the group's ends."""

    def run(kids: pa.Table) -> pa.Table:
        m, rows = model.value, _in_order(kids)
        blank, bare, entry, end, last = rows[0]["was_blank"], rows[0]["was_bare"], rows[0]["entry"], rows[0]["end"], rows[0]["last"]
        begun, ended, came = [], [], m.opening(entry)
        for k, row in enumerate(rows):
            blank = rows[k - 1]["blank"] if k else blank
            begun.append(came + m.emit[:, row["after"] if blank else row["plain"]])
            ended.append((begun[-1][:, None] + np.reshape(row["best"], (N_STATES, N_STATES))).max(0))
            came = (ended[-1][:, None] + m.move).max(0)
        at, ends = int(ended[-1].argmax()) if end < 0 else end, []
        for k in range(len(rows) - 1, -1, -1):
            ends.append(at)
            if k:
                begin = int((begun[k] + np.reshape(rows[k]["best"], (N_STATES, N_STATES))[:, at]).argmax())
                at = int((ended[k - 1] + m.move[:, begin]).argmax())
        ends.reverse()
        out = []
        for k, row in enumerate(rows):
            a = rows[k - 1] if k else None
            out.append({"conv_id": row["conv_id"], "segment": row["segment"], "part": row["part"], "entry": ends[k - 1] if k else entry, "was_blank": a["blank"] if k else row["was_blank"], "was_bare": a["bare"] and ends[k - 1] % 2 == 0 if k else bare, "end": ends[k], "last": last and k == len(rows) - 1})
        return pa.Table.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("was_blank", pa.bool_()), ("was_bare", pa.bool_()), ("end", pa.int32()), ("last", pa.bool_())]))

    return run


def _ends(kids: DataFrame, model: Broadcast, fan: int) -> DataFrame:
    """What stands before and at the end of each summed-up piece on the best path of its conversation.

    While a conversation has more than ``fan`` pieces, groups of ``fan`` segments are united and solved first, so no task
    holds more than a group's matrices."""
    if kids.groupBy("conv_id").count().where(F.col("count") > fan).isEmpty():
        whole = kids.select("*", F.lit(-1).alias("entry"), F.lit(True).alias("was_blank"), F.lit(False).alias("was_bare"), F.lit(-1).alias("end"), F.lit(True).alias("last"))
        return staged(whole.groupBy("conv_id").applyInArrow(_solved(model), _ENDS), "ends")
    grouped = kids.withColumn("up", F.expr(f"(segment - pmod(segment, {fan})) div {fan}"))
    above = staged(grouped.groupBy("conv_id", "up").applyInArrow(_united(model), _SUMMED), "united")
    known = _ends(above, model, fan).select(F.col("conv_id").alias("c"), F.col("segment").alias("u"), "entry", "was_blank", "was_bare", "end", "last")
    both = grouped.join(known, grouped["conv_id"].eqNullSafe(known["c"]) & grouped["up"].eqNullSafe(known["u"])).drop("c", "u")
    return staged(both.groupBy("conv_id", "up").applyInArrow(_solved(model), _ENDS), "ends")


def formatted(conversations: DataFrame, model: Model | None = None, fold: int = 0, size: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """Writes each conversation as a transcript, parses it, and returns per segment conv_id, segment, part, held_out, n_turns,
    n_lines, n_right (lines whose role is recovered), n_parsed (turns that open in it), chat (its piece of the canonical chat)."""
    if fan < 3:  # null, negative and other segments never share a group
        raise ValueError("fan must be 3 or more")
    parts = segments(conversations, size)
    sent = conversations.sparkSession.sparkContext.broadcast(model or trained(parts, fold))
    # only conversations of several segments have ends to settle; those tables hold no texts
    several = parts.groupBy("conv_id").count().where(F.col("count") > 1).select(F.col("conv_id").alias("c"))
    thin = parts.select("conv_id", "segment", "part", "seen", "plain", "blank", "bare").join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    ends = _ends(staged(thin.mapInArrow(_summed(sent), _SUMMED), "summed"), sent, fan).select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), F.col("part").alias("p"), "entry", "was_blank", "was_bare", "end", "last")
    # broadcast by Spark only where the written table is below its size limit
    both = parts.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("segment").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")), "left")
    names = ["conv_id", "segment", "part", "held_out", "n_turns", "n_lines", "n_right", "n_parsed", "chat"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for conv, segment, part, n_turns, text, truth, seen, plain, entry, blank, bare, end, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    lines, seen = text.split("\n"), list(seen)
                    seen[0] = seen[0] if blank else plain
                    found = sent.value.viterbi(seen, entry, end)
                    said = spoken(lines, found, entry, bare)
                    right = sum(a // 2 == b // 2 for a, b in zip(found, np.frombuffer(truth, np.int8).tolist(), strict=True) if b >= 0)
                    yield conv, segment, part, zlib.crc32(str(conv).encode()) % 5 == fold, n_turns, len(lines), right, sum(role is not None for role, _ in said), render(said, entry, bare, last)

        yield from _batches(rows(), names, kinds)

    placed = both.select("conv_id", "segment", "part", "n_turns", "text", "truth", "seen", "plain", *[F.coalesce(F.col(c), F.lit(x)).alias(c) for c, x in (("entry", -1), ("was_blank", True), ("was_bare", False), ("end", -1), ("last", True))])
    return placed.mapInArrow(run, "conv_id bigint, segment bigint, part int, held_out boolean, n_turns bigint, n_lines bigint, n_right bigint, n_parsed bigint, chat string")
