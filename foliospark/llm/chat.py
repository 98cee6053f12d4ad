"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned spans: a turn belongs to
window floor(tokens before it / span budget). A window repeats the leading system turn and the
last turns before it, as far as a history budget goes; the loss mask covers the assistant
texts that are new in it, so every target counts once.

Texts are moved once. A conversation of at most SEGMENT_WINDOWS windows goes to a task whole. Of longer
ones, prefix sums over (conversation, turn, tokens) alone, in two levels (sums of slices of turn numbers, then
turns within a slice), cut segments at turn numbers; a segment goes to a task of its own, with copies of
the turns that its first window repeats. A task streams over sorted turns and holds one window.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from foliospark.llm.common import written

#: Tokens of new turns that start in a window, and of repeated history. A last turn may go over the span.
SPAN_TOKENS, HISTORY_TOKENS = 1024, 256
#: Windows of a segment, which one task formats; a conversation of more tokens is cut.
SEGMENT_WINDOWS = 64
#: Turn numbers to a slice of the two-level prefix sums, as a power of two.
SLICE_BITS = 9
#: Rows up to which the places of long conversations are broadcast (60 bytes each).
BROADCAST_PLACES = 200_000
#: Characters of a conversation that the reader holds before it hands its pieces on.
HELD_CHARS = 4 << 20
#: Bytes of a batch, in and out of Python.
BATCH_BYTES = 4 << 20
LEAST_TURN = -(1 << 63)

# The template's control strings.
BEGIN, END = "<s>", "</s>"
TAGS = {"user": ("[INST]", "[/INST]"), "assistant": ("[ASST]", "[/ASST]"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "[ROLE:", "[:]", "[/ROLE]"
CONTROLS = [BEGIN, END, *(x for pair in TAGS.values() for x in pair), OTHER_OPEN, OTHER_MID, OTHER_CLOSE]

_control = re.compile("|".join(map(re.escape, CONTROLS)))
_escaped = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """A backslash within every control string, and own backslashes doubled; unescape() undoes it for any text.

    A trailing bracket is parted from the closing tag by a backslash too, as the two might form a control string.
    """
    out = _control.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))
    return out + "\\" if out[-1:] in ("[", "]", "<") else out


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[1], text)


def tags(role: str) -> tuple[str, str]:
    return TAGS.get(role) or (f"{OTHER_OPEN}{escape(role)}{OTHER_MID}", OTHER_CLOSE)


def format_window(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """(role, text, new) to the formatted text and the spans, in code points, under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text, new in turns:
        a, b = tags(role)
        body = escape(text)
        if role == "assistant" and new and body:
            begin = at + len(BEGIN) + len(a)
            spans.append((begin, begin + len(body)))
        piece = f"{BEGIN}{a}{body}{b}{END}"
        parts.append(piece)
        at += len(piece)
    return "".join(parts), spans


_turn = re.compile(
    re.escape(BEGIN)
    + "(?:"
    + "|".join(f"(?P<{r}>{re.escape(a)}(?P<t_{r}>.*?){re.escape(b)})" for r, (a, b) in TAGS.items())
    + f"|{re.escape(OTHER_OPEN)}(?P<name>.*?){re.escape(OTHER_MID)}(?P<t_other>.*?){re.escape(OTHER_CLOSE)}"
    + ")"
    + re.escape(END),
    re.S,
)


def parse_window(text: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted text."""
    out, at = [], 0
    for m in _turn.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        role = next((r for r in TAGS if m[r] is not None), None)
        out.append((role, unescape(m[f"t_{role}"])) if role else (unescape(m["name"]), unescape(m["t_other"])))
    if at != len(text):
        raise ValueError("text between turns")
    return out


def estimated_tokens(text: Column) -> Column:
    """Tokens of a turn: a quarter of its characters and four for its tags. Any other count may be passed instead."""
    return (F.ceil(F.length(text) / 4) + 4).cast("long")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        step = max(1, int(b.num_rows * BATCH_BYTES / max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield from zip(*(c.to_pylist() for c in b.slice(at, step).columns))


def _batches(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row if isinstance(v, str))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), arrow)], schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), arrow)], schema=arrow)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _places(turns: DataFrame, segment_tokens: int, history_tokens: int) -> tuple[DataFrame, DataFrame]:
    """From (conv_id, at, tok) of long conversations, one row a turn number: where the turns of a slice go, and the segments.

    Places: conv_id, slice, low, high (turn numbers), segment, kind (1: repeated there, 2: new), base (tokens before the first turn
    sent there), final (no segment follows). Segments: conv_id, segment.
    """
    sliced = turns.withColumn("slice", F.shiftright("at", SLICE_BITS))
    sums = sliced.groupBy("conv_id", "slice").agg(F.sum("tok").alias("sum"))
    offsets = sums.select(F.col("conv_id").alias("c"), F.col("slice").alias("s"), (F.sum("sum").over(Window.partitionBy("conv_id").orderBy("slice")) - F.col("sum")).alias("offset"))
    cum = F.sum("tok").over(Window.partitionBy("conv_id", "slice").orderBy("at"))
    summed = written(
        sliced.withColumn("cum", cum)
        .join(offsets, _same("conv_id", "c") & (F.col("slice") == F.col("s")))
        .select("conv_id", "at", "slice", (F.col("offset") + F.col("cum") - F.col("tok")).alias("before"), (F.col("offset") + F.col("cum")).alias("after"))
        .withColumn("segment", F.floor(F.col("before") / segment_tokens)),
        "turns",
    )
    following = Window.partitionBy("conv_id").orderBy("segment")
    segments = written(
        summed.groupBy("conv_id", "segment").agg(F.min("before").alias("begin"), F.max("after").alias("end")).select("conv_id", "segment", "begin", "end", F.lead("segment").over(following).alias("next")),
        "segments",
    )
    known = segments.select(F.col("conv_id").alias("c"), F.col("segment").alias("g"), "end", "next")
    tail = summed.join(known, _same("conv_id", "c") & (F.col("segment") == F.col("g"))).where(F.col("next").isNotNull() & (F.col("after") > F.col("end") - history_tokens))
    tail = tail.select("conv_id", "at", "slice", "before", F.col("next").alias("segment"), F.lit(1).alias("kind"))
    sent = summed.select("conv_id", "at", "slice", "before", "segment", F.lit(2).alias("kind")).unionByName(tail)
    begins = tail.groupBy("conv_id", "segment").agg(F.min("before").alias("repeated")).select(F.col("conv_id").alias("c2"), F.col("segment").alias("g2"), "repeated")
    about = (
        segments.join(begins, _same("conv_id", "c2") & (F.col("segment") == F.col("g2")), "left")
        .select(F.col("conv_id").alias("c"), F.col("segment").alias("g"), F.coalesce("repeated", "begin").alias("base"), F.col("next").isNull().alias("final"))
    )
    ranges = sent.groupBy("conv_id", "slice", "segment", "kind").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    return ranges.join(about, _same("conv_id", "c") & (F.col("segment") == F.col("g"))).drop("c", "g"), segments.select("conv_id", "segment")


def _dealt(rows: DataFrame, segment_tokens: int, history_tokens: int) -> DataFrame:
    """rows (conv_id, turn, role, text, tok) with segment, kind, base and final, a row for each place that a turn goes to."""
    whole = {"segment": F.lit(0).cast("long"), "kind": F.lit(2), "base": F.lit(0).cast("long"), "final": F.lit(True)}
    long = written(rows.groupBy("conv_id").agg(F.sum("tok").alias("total")).where(F.col("total") > segment_tokens).select(F.col("conv_id").alias("c")), "long")
    n_long = long.count()
    if not n_long:
        return rows.withColumns(whole)
    if n_long <= BROADCAST_PLACES:
        long = F.broadcast(long)
    rows = rows.withColumn("at", F.coalesce("turn", F.lit(LEAST_TURN)))
    of_long = rows.join(long, _same("conv_id", "c"), "left_semi")
    places, segments = _places(of_long.groupBy("conv_id", "at").agg(F.sum("tok").alias("tok")), segment_tokens, history_tokens)
    places = written(places.withColumnRenamed("conv_id", "c").withColumnRenamed("slice", "s"), "places")
    here = _same("conv_id", "c") & (F.shiftright("at", SLICE_BITS) == F.col("s")) & F.col("at").between(F.col("low"), F.col("high"))
    placed = rows.join(F.broadcast(places) if places.count() <= BROADCAST_PLACES else places.hint("shuffle_merge"), here, "left")
    placed = placed.select("conv_id", "turn", "role", "text", "tok", *(F.coalesce(F.col(c), v).alias(c) for c, v in whole.items()))
    # The leading system turn goes to every later segment too.
    first = of_long.groupBy("conv_id").agg(F.min(F.struct("at", "role", "text", "tok", "turn")).alias("first")).where("first.role = 'system'").select(F.col("conv_id").alias("c"), "first")
    repeated = segments.where("segment > 0").join(first, _same("conv_id", "c")).select("conv_id", "first.turn", "first.role", "first.text", "first.tok", "segment", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("base"), F.lit(False).alias("final"))
    return placed.unionByName(repeated)


def windows(
    df: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    span_tokens: int = SPAN_TOKENS,
    history_tokens: int = HISTORY_TOKENS,
    tokens=estimated_tokens,
    segment_windows: int = SEGMENT_WINDOWS,
) -> DataFrame:
    """A row per window: conv_id, window, follows (the window before it; null for the first, -1 where another task made it), last (of its conversation), n_context (turns that it repeats), text, loss_spans (start, end in code points), n_tokens.

    Null texts and roles count as empty. Turns come by number (null first), ties by role and text; repeated
    rows are turns of their own, and turns of one number stay in one segment. Rows with a null conv_id form one
    conversation; no rows give no windows. Other columns are ignored, whatever their names. History is shorter than a span.
    """
    if history_tokens > span_tokens:
        raise ValueError("history must not be longer than a span")
    rows = df.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("tok", tokens(F.col("text")).cast("long"))
    dealt = _dealt(rows, span_tokens * segment_windows, history_tokens)
    schema = T.StructType(
        [
            T.StructField("conv_id", df.schema[conv_id].dataType),
            T.StructField("window", T.LongType()),
            T.StructField("follows", T.LongType()),
            T.StructField("last", T.BooleanType()),
            T.StructField("n_context", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def formatted(turns: Iterator[tuple]) -> Iterator[tuple]:
        """Turns of one segment after another, in order; a turn is (tokens before it, role, text, tokens, whether it leads the conversation)."""
        place = lead = window = follows = None
        context: list[tuple] = []
        recent: list[tuple] = []
        end, at_end = 0, False

        def closed(last: bool) -> tuple:
            made, spans = format_window([(r, t, False) for _, r, t, _, _ in context] + [(r, t, True) for _, r, t, _, _ in recent])
            return place[0], window, follows, last, len(context), made, [{"start": a, "end": b} for a, b in spans], sum(x[3] for x in context) + sum(x[3] for x in recent)

        for conv, segment, kind, base, final, said, body, tok in turns:
            if place != (conv, segment):
                if window is not None:
                    yield closed(at_end)
                place, lead, window, follows, context, recent = (conv, segment), None, None, -1 if segment else None, [], []
                end, seen, at_end = base if kind else None, 0, False
            if kind == 0:
                lead = (0, said, body, tok, True)
                continue
            end = base if end is None else end
            at_end = final
            x = (end, said, body, tok, kind == 2 and segment == 0 and seen == 0 and said == "system")
            seen += 1
            end += tok
            if kind == 2:
                w = min(x[0] // span_tokens, (segment + 1) * segment_windows - 1)
                if w != window:
                    if window is not None:
                        yield closed(False)
                        follows = window
                    if window is not None or segment:
                        context = [lead] if lead else []
                        context += [r for r in recent if not r[4] and x[0] - r[0] <= history_tokens]
                    recent, window = [], w
                if x[4]:
                    lead = x
            recent.append(x)
        if window is not None:
            yield closed(at_end)

    ordered = dealt.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "turn", "role", "text")
    return ordered.select("conv_id", "segment", "kind", "base", "final", "role", "text", "tok").mapInArrow(lambda batches: _batches(formatted(_rows(batches)), schema), schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation, parsed from its windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation whose windows follow each other in one partition, as windows() leaves all but long ones, is
    digested there. Pieces of others are dealt by conversation: a digest runs through a conversation in order, so one
    task streams over the pieces of a conversation and holds one batch.
    """
    kind = formatted.schema["conv_id"].dataType
    digests = [T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
    schema = T.StructType([T.StructField("conv_id", kind), *digests])
    parts = T.StructType([T.StructField("conv_id", kind), T.StructField("window", T.LongType()), T.StructField("turns", T.StringType()), T.StructField("loss", T.StringType()), *digests])

    def digested(pieces: Iterator[tuple]) -> tuple:
        n, t, c, s, chars = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        for n_turns, turns, loss, size in pieces:
            n, c, chars = n + n_turns, c + len(loss), chars + size
            t.update(turns.encode("utf-8", "surrogatepass"))
            s.update(loss.encode("utf-8", "surrogatepass"))
        return n, t.hexdigest(), c, s.hexdigest(), chars

    def parsed(rows: Iterator[tuple]) -> Iterator[tuple]:
        whole, conv, before, size = False, None, None, 0
        held: list[tuple] = []

        def handed_on() -> Iterator[tuple]:
            for window, (n, turns, loss, chars) in held:
                yield conv, window, turns, loss, n, None, None, None, chars
            held.clear()

        for now, window, follows, last, n_context, text, spans in rows:
            turns = parse_window(text)[n_context:]
            piece = len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), "".join(unescape(text[s["start"] : s["end"]]) for s in spans), len(text)
            if follows is None or not (whole and conv == now and follows == before):
                yield from handed_on()
                whole, size = follows is None, 0
            conv, before = now, window
            held.append((window, piece))
            size += piece[3]
            if whole and last:
                yield now, None, None, None, *digested(p for _, p in held)
                held.clear()
                whole = False
            elif not whole or size > HELD_CHARS:
                yield from handed_on()
                whole = False
        yield from handed_on()

    def joined(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
            first = next(group)
            if first[5] is not None:
                yield conv, *first[4:]
                continue
            yield conv, *digested((n, turns, loss, chars) for _, _, turns, loss, n, _, _, _, chars in itertools.chain([first], group))

    pieces = formatted.select("conv_id", "window", "follows", "last", "n_context", "text", "loss_spans").mapInArrow(lambda batches: _batches(parsed(_rows(batches)), parts), parts)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(lambda batches: _batches(joined(_rows(batches)), schema), schema)
