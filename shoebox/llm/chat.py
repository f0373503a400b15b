"""Chat formatting: conversations as windows of whole turns under a token budget.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Texts keep
no control string: each ``<`` that backslashes and a ``|`` follow gets one
more backslash, and ``unescaped`` takes it off again.  In roles ``%``,
``<`` and line feeds are written as ``%25``, ``%3C`` and ``%0A``.

Prefix sums of turn tokens choose the windows.  A window holds the
conversation's system turn (a leading turn of that role), recent turns of
at most ``HISTORY`` tokens that an earlier window brought, and new turns
for as long as the sum stays under ``BUDGET``; history gives way to the
first new turn, oldest turn first.  A turn that doesn't fit under the
budget by itself gets a window that says ``over_budget``.  The loss mask
covers the texts of new assistant turns only: repeated targets are masked.

Prefix sums come in two steps, so that a conversation may hold any share
of all rows: turns are range-partitioned by conversation and turn and
summed within their partition, and only what the conversation at a
partition's end has summed up is carried into the next (one number a
partition, added up by the driver).  Windows are then cut in segments of
``SEGMENT`` tokens of a conversation, each by itself: a segment gets the
turns at the end of the one before as history, and its first window begins
with it.

Edge cases: a null role or text counts as empty; rows with a null
conversation form one conversation, a null turn comes first; rows of the
same turn go by a hash of role and text; repeated rows are repeated turns;
other columns are ignored; an empty table gives no windows.  A long turn is
never cut.  Control strings of the tokenizer in a text count as ordinary
text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import deque
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, given_back, slices

BUDGET, HISTORY = 2048, 512
#: Tokens of a conversation whose windows are cut by one task; at least the history.
SEGMENT = 64 * BUDGET
#: Tokens of a turn beside its role and text: its two marks and the line feed at its end.
MARKS = 3

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescaped_role(role: str) -> str:
    return role.replace("%0A", "\n").replace("%3C", "<").replace("%25", "%")


def read(text: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns of a formatted text."""
    return [(unescaped_role(role), unescaped(said)) for role, said in TURN.findall(text)]


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = True
    return found


# --- prefix sums ---

RANGED = "conv_id long, turn long, tie long, role string, text string, pid int, nth long, pos long, start long, tokens int"


def summed(turns: DataFrame, path: str) -> DataFrame:
    """The turns in ranges, with tokens, and sums within range and conversation: ``pos`` (turns before) and ``start`` (tokens before)."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        escaped_role(F.coalesce("role", F.lit(""))).alias("role"),
        escaped(F.coalesce("text", F.lit(""))).alias("text"),
    ).withColumn("tie", F.xxhash64("role", "text"))
    rows = rows.withColumn("copy", F.monotonically_increasing_id())  # so that a range may end among equal rows
    order = ["conv_id", "turn", "tie", "copy"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        conv, nth, pos, start = object(), 0, 0, 0
        for batch in slices(batches, 4):
            said = [f"{r}\n{t}" for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            tokens = [len(e.ids) + MARKS for e in model.encode_batch(said, add_special_tokens=False)]
            at = []
            for c, n in zip(batch.column(0).to_pylist(), tokens):
                if c != conv:
                    conv, pos, start = c, 0, 0
                at.append((nth, pos, start))
                nth, pos, start = nth + 1, pos + 1, start + n
            sums = [pa.array(x, pa.int64()) for x in zip(*at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums, pa.array(tokens, pa.int32())], names=[c.split()[0] for c in RANGED.split(", ")])

    return rows.select("conv_id", "turn", "tie", "role", "text", F.spark_partition_id().alias("pid")).mapInArrow(given_back(run), RANGED)


def carries(ranged: DataFrame) -> list[tuple[int, int | None, int, int]]:
    """(range, conversation, turns, tokens) for each range whose first conversation began in an earlier one: at most one a range."""
    ends = ranged.groupBy("pid").agg(
        F.min_by(F.struct("conv_id"), "nth").alias("first"),
        F.max_by(F.struct("conv_id", (F.col("pos") + 1).alias("pos"), (F.col("start") + F.col("tokens")).alias("start")), "nth").alias("last"),
    )
    out, before = [], None
    for r in sorted(ends.collect(), key=lambda r: r["pid"]):  # a row a range
        first, (conv, pos, start) = r["first"][0], r["last"]
        if before is not None and before[0] == first:
            out.append((r["pid"], first, before[1], before[2]))
            if conv == first:
                pos, start = pos + before[1], start + before[2]
        before = (conv, pos, start)
    return out


def placed(ranged: DataFrame, segment: int) -> DataFrame:
    """The turns with ``pos`` and ``start`` of their whole conversation, and its ``segment``."""
    spark = ranged.sparkSession
    carried = spark.createDataFrame(carries(ranged), "pid int, of long, more_pos long, more_start long")
    rows = ranged.join(F.broadcast(carried), "pid", "left")  # a row a range at most
    same = F.col("more_pos").isNotNull() & F.col("of").eqNullSafe(F.col("conv_id"))
    start = F.col("start") + F.when(same, F.col("more_start")).otherwise(F.lit(0))
    return rows.select("conv_id", "role", "text", "tokens", (F.col("pos") + F.when(same, F.col("more_pos")).otherwise(F.lit(0))).alias("pos"), start.alias("start")).withColumn(
        "segment", F.floor(F.col("start") / F.lit(segment)).cast("long")
    )


# --- windows ---

WINDOW = "conv_id long, first_turn long, n_turns int, n_repeated int, n_tokens long, over_budget boolean, text string, fresh_from int, loss array<struct<start:int,end:int>>"


def cut(rows: Iterator[tuple], budget: int, history: int) -> Iterator[dict]:
    """Windows of one segment after another, from sorted rows of conversation, segment, whether carried, pos, start, tokens, role and text."""
    group, system, recent, fresh, opening = object(), None, deque(), [], 0

    def spelled(turn: tuple) -> str:
        return f"{BEGIN}{turn[3]}\n{turn[4]}{END}"

    def window() -> dict:
        repeated = [*([system] if system and fresh[0] is not system else []), *recent]
        parts = [spelled(t) for t in repeated]
        at = fresh_from = sum(map(len, parts))
        loss = []
        for t in fresh:
            parts.append(spelled(t))
            if t[3] == "assistant" and t[4]:
                begin = at + len(BEGIN) + len(t[3]) + 1
                loss.append({"start": begin, "end": begin + len(t[4])})
            at += len(parts[-1])
        n = sum(t[2] for t in (*repeated, *fresh))
        return {"conv_id": group[0], "first_turn": fresh[0][0], "n_turns": len(fresh), "n_repeated": len(repeated), "n_tokens": n, "over_budget": n > budget, "text": "".join(parts), "fresh_from": fresh_from, "loss": loss}

    for conv, segment, carried, *turn in rows:
        turn = tuple(turn)  # pos, start, tokens, role, text
        if (conv, segment) != group:
            if fresh:
                yield window()
            group, system, recent, fresh = (conv, segment), None, deque(), []
        is_system = turn[0] == 0 and turn[3] == "system"
        if carried:
            if is_system:
                system = turn
            else:
                recent.append(turn)
            continue
        held, end = system[2] if system else 0, turn[1] + turn[2]
        # Tokens from the first turn beside the system turn on, as a difference of prefix sums.
        if fresh and held + end - min(opening, turn[1]) > budget:
            yield window()
            recent.extend(t for t in fresh if t is not system)
            fresh = []
        if not fresh:
            # Of what was before, the turns that directly come before, as far as history and budget go.
            while recent and (turn[1] - recent[0][1] > history or held + end - recent[0][1] > budget):
                recent.popleft()
            if recent and recent[-1][0] != turn[0] - 1:
                recent.clear()
            opening = recent[0][1] if recent else end if is_system else turn[1]
        if is_system:
            system = turn
        fresh.append(turn)
    if fresh:
        yield window()


def windows(turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT) -> DataFrame:
    """conv_id, first_turn (of the new ones, counted from 0), n_turns (new), n_repeated, n_tokens, over_budget, text, fresh_from (code points before the new turns) and loss (spans of code points).

    ``path``: a file of the tokenizers library, on every executor.  Turns
    with their tokens are written to the shared folder, and are read from
    there; so the result needs that table, which stays.
    """
    if history > min(budget, segment):
        raise ValueError("the history must fit into a window and a segment")
    scratch = Scratch(turns.sparkSession, "chat")
    rows = placed(scratch.put(summed(turns, path), "turns"), segment)
    near_end = F.col("start") >= (F.col("segment") + 1) * segment - history
    here = F.struct(F.col("segment").alias("segment"), F.lit(False).alias("carried"))
    next_ = F.struct((F.col("segment") + 1).alias("segment"), F.lit(True).alias("carried"))
    leading = (F.col("pos") == 0) & (F.col("role") == "system")
    columns = ["conv_id", "segment", "carried", "pos", "start", "tokens", "role", "text"]
    own = rows.withColumn("at", F.explode(F.when(near_end & ~leading, F.array(here, next_)).otherwise(F.array(here)))).withColumns({"segment": F.col("at.segment"), "carried": F.col("at.carried")}).select(*columns)
    # The system turn of each later segment.
    later = rows.where("segment > 0").select(F.col("conv_id").alias("of"), F.col("segment").alias("later")).distinct()
    heads = rows.where(leading).join(later, F.col("conv_id").eqNullSafe(F.col("of"))).withColumns({"segment": F.col("later"), "carried": F.lit(True)}).select(*columns)
    order = [F.col("conv_id"), F.col("segment"), F.desc("carried"), F.col("pos")]
    whole = own.unionByName(heads).repartition("conv_id", "segment").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in slices(batches, 7):
                yield from zip(*(c.to_pylist() for c in batch.columns))

        kinds = {"conv_id": pa.int64(), "first_turn": pa.int64(), "n_turns": pa.int32(), "n_repeated": pa.int32(), "n_tokens": pa.int64(), "over_budget": pa.bool_(), "text": pa.string(), "fresh_from": pa.int32(), "loss": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}
        held, size = [], 0
        for w in cut(each(), budget, history):
            held.append(w)
            size += len(w["text"])
            if len(held) == 256 or size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, pa.schema(list(kinds.items())))
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, pa.schema(list(kinds.items())))

    return whole.mapInArrow(given_back(run), WINDOW)


# --- reading back ---

DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def digests(found: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (of all windows) and n_windows, read back from windows.

    Turns that a window repeats are passed over.  A SHA-256 of a whole
    conversation can't be put together from parts, so each conversation's
    windows stream through one task, in order, which holds one window.
    """
    rows = found.select("conv_id", "first_turn", "text", "fresh_from", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        kinds = {c: pa.string() if c.endswith("sha256") else pa.int64() for c in names}
        conv, state, done = None, None, []

        def settled() -> dict:
            turns, loss, n, chars, formatted, count = state
            return dict(zip(names, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count)))

        for batch in slices(batches, 2):
            for c, _, text, fresh_from, loss in zip(*(x.to_pylist() for x in batch.columns)):
                if state is None or c != conv:
                    if state is not None:
                        done.append(settled())
                    conv, state = c, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0]
                for role, said in read(text[fresh_from:]):
                    state[0].update(f"{role}\n{said}\n".encode())
                    state[2] += 1
                for span in loss:
                    said = unescaped(text[span["start"] : span["end"]])
                    state[1].update(said.encode())
                    state[3] += len(said)
                state[4] += len(text)
                state[5] += 1
            yield pa.RecordBatch.from_pylist(done, pa.schema(list(kinds.items())))
            done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([settled()], pa.schema(list(kinds.items())))

    return rows.mapInArrow(given_back(run), DIGEST)
