"""Chat formatting from event logs: fold each conversation's events into final messages, then render them.

Events (conv_id, seq, turn, kind, role, text):
  start       a message begins at turn, with role and text
  delta       text is appended to the turn's last message (starting it if there is none)
  edit        text replaces that of the turn's last message (starting it if there is none)
  regenerate  all messages of this and later turns are discarded, and one begins as with start
Other kinds are ignored. Messages stand by turn, then in the order in which they began.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.names import col
from larkspur.llm.wordhash import small_batches, tidy

#: Rows that a worker holds as Python objects at once.
BATCH = 64
#: The strings that mark turns: <s>[INST]role[/INST]text</s>
OPEN, HEAD, BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
# Runs are taken whole and never given back, so a long text costs one pass.
_TURN = re.compile(re.escape(OPEN + HEAD) + r"((?:[^\\\[]++|\\.|\[(?!/INST\]))*+)" + re.escape(BODY) + r"((?:[^\\<]++|\\.|<(?!/s>))*+)" + re.escape(CLOSE), re.DOTALL)


def escape(text: str) -> str:
    """A backslash before each backslash, and after the first character of each control string, so that none is left."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold(events: list[tuple[int, str, str, str]]) -> list[tuple[str, str]]:
    """(turn, kind, role, text) in the order of the log, to (role, text) of the final messages."""
    turns: dict[int, list[list]] = {}
    for turn, kind, role, text in events:
        here = turns.get(turn)
        if kind == "regenerate":
            for t in [t for t in turns if t >= turn]:
                del turns[t]
            turns[turn] = [[role, [text]]]
        elif kind == "start" or kind in ("delta", "edit") and not here:
            turns.setdefault(turn, []).append([role, [text]])
        elif kind == "delta":
            here[-1][1].append(text)
        elif kind == "edit":
            here[-1][1] = [text]
    return [(role, "".join(parts)) for t in sorted(turns) for role, parts in turns[t]]


def render(messages: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The formatted conversation, and where the texts to learn from begin and end in it (code points)."""
    out, at, starts, ends = [], 0, [], []
    for role, text in messages:
        head, body = f"{OPEN}{HEAD}{escape(role)}{BODY}", escape(text)
        if role == learn:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_chats(events: DataFrame, *, learn: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_starts and loss_ends (array<int>, code points of the texts of role `learn`).

    Null role and text: ''. Null turn: -1, null kind: start. A null conv_id is a conversation of its own. Events with equal seq stand by turn,
    kind, role and text, so the result doesn't depend on the input's order; a repeated event counts again.
    Other columns are left out, whatever they are called; a text may have any length, and a task takes few rows at a time. No events: no rows.
    One shuffle by conversation, sorted; a task folds one conversation at a time, so it holds the messages of one: by the method a conversation isn't split.
    """
    blank = lambda c: F.coalesce(col(c).cast("string"), F.lit("")).alias(c)
    rows = events.select(col("conv_id"), col("seq").cast("long").alias("seq"), F.coalesce(col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce(col("kind"), F.lit("start")).alias("kind"), blank("role"), blank("text"))
    kind = rows.schema["conv_id"].dataType
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "turn", "kind", "role", "text")
    schema = f"conv_id {kind.simpleString()}, formatted string, loss_starts array<int>, loss_ends array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []
        held: list[tuple[int, str, str, str]] = []
        arrow = None

        def done(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], arrow), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.list_(pa.int32())), pa.array([x[3] for x in found], pa.list_(pa.int32()))], names=["conv_id", "formatted", "loss_starts", "loss_ends"])

        for b in small_batches(batches, BATCH):
            arrow = b.column(0).type
            found = []
            for conv, *event in zip(b.column(0).to_pylist(), *[b.column(i).to_pylist() for i in (2, 3, 4, 5)], strict=True):
                if now and now[0] != conv:
                    found.append((now[0], *render(fold(held), learn)))
                    held = []
                now = [conv]
                held.append(tuple(event))
            yield done(found)
        if now:
            yield done([(now[0], *render(fold(held), learn))])

    return ordered.mapInArrow(tidy(run), schema)


def message_events(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as events: each a whole message."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("seq"), F.col("turn").cast("long").alias("turn"), F.lit("start").alias("kind"), "role", "text")


def streamed_events(rows: DataFrame, pieces: int = 4) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as the log that a server which streams its messages would leave: folded, it tells the rows again.

    A message comes in `pieces` deltas. By a hash of conversation and turn, a third begin as they are; a third begin as a draft that an edit replaces by the first piece; a third
    begin as a draft that goes on and is then generated anew, but a message that isn't the first of its turn is edited instead, as a regeneration would discard those before it.
    Rows of equal turn stand by role and text; a null turn is -1, null role and text are ''. Events lie in no order: seq tells it. Repeated rows are messages of their own.
    """
    blank = lambda c: F.coalesce(col(c).cast("string"), F.lit("")).alias(c)
    turn = F.coalesce(col("turn").cast("long"), F.lit(-1))
    by = Window.partitionBy("conv_id").orderBy("turn", F.col("given").asc_nulls_first(), "role", "text")
    placed = rows.select(col("conv_id"), turn.alias("turn"), col("turn").alias("given"), blank("role"), blank("text"))
    placed = placed.withColumn("place", F.row_number().over(by).cast("long")).withColumn("first", F.coalesce(F.lag("turn").over(by) != F.col("turn"), F.lit(True)))
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    way = F.when((way == 2) & ~F.col("first"), 1).otherwise(way)
    size = F.greatest(F.ceil(F.length("text") / F.lit(pieces)), F.lit(1)).cast("int")
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    piece = lambda i: F.substring("text", i * size + 1, size)
    deltas = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: event("delta", piece(i)))
    none, draft, more = F.lit(""), F.lit("[INST] draft"), F.lit(" of it</s>")
    edited = F.concat(F.array(event("start", draft), event("edit", piece(F.lit(0)))), F.slice(deltas, 2, pieces))
    anew = F.concat(F.array(event("start", draft), event("delta", more), event("regenerate", none)), deltas)
    log = F.when(way == 0, F.concat(F.array(event("start", none)), deltas)).when(way == 1, edited).otherwise(anew)
    told = placed.select("conv_id", "turn", "role", "place", F.posexplode_outer(log).alias("nth", "event"))
    return told.select("conv_id", (F.col("place") * (pieces + 3) + F.col("nth")).alias("seq"), "turn", "event.kind", "role", "event.text")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all read from the formatted text and its spans.

    formatted is what format_chats returns: a row for each of its rows, repeated ones too, of texts of any length. It has no nulls but conv_id. An empty text has no turns.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in small_batches(batches, BATCH):
            rows = []
            for text, starts, ends in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                turns = parse(text)
                loss = "".join([unescape(text[s:e]) for s, e in zip(starts, ends, strict=True)])
                rows.append((len(turns), hashlib.sha256("".join([f"{r}\n{t}\n" for r, t in turns]).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(tidy(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
