"""Chat formatting in budgeted windows.

A turn is written ``<turn ROLE>``, newline, text, ``</turn>``, newline. Inside texts and roles a
backslash is doubled and one is put into the marks' own strings, so that they can't appear there;
dropping one backslash before any character undoes it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from signalmill.llm.vocab import byte_encoder, default_path
from signalmill.plans.runtime import written

OPEN, CLOSE = "<turn ", "</turn>"
BUDGET = 1024
HISTORY = 192
REGION = 32
SLOT = 1024


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(CLOSE, "<\\/turn>").replace(OPEN, "<\\turn ")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def header(role: str) -> str:
    return OPEN + re.sub(r"([\\>\n<])", r"\\\1", role) + ">\n"


def render(role: str, text: str) -> str:
    return header(role) + escape(text) + CLOSE + "\n"


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; the span is that of the escaped text."""
    out, at = [], 0
    for part in text.split(CLOSE + "\n")[:-1]:
        head = re.match(r"<turn ((?:[^\\>]|\\.)*)>\n", part, re.S)
        out.append((unescape(head[1]), unescape(part[head.end() :]), at + head.end(), at + len(part)))
        at += len(part) + len(CLOSE) + 1
    return out


def _turns(rows: DataFrame, path: str | None) -> DataFrame:
    """Rendered turns with their token counts."""

    def kernel(batches):
        encode = byte_encoder(path or default_path())
        for batch in batches:
            roles, texts = (batch.column(i).to_pylist() for i in (2, 3))
            shown = [render(r or "", t or "") for r, t in zip(roles, texts)]
            tokens = [len(encode(x)) for x in shown]
            own = [r == "assistant" for r in roles]
            cols = [batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in ((roles, pa.string()), (own, pa.bool_()), (shown, pa.string()), (tokens, pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "turn", "role", "target", "shown", "tokens"])

    fields = "conv_id bigint, turn bigint, role string, target boolean, shown string, tokens bigint"
    return rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").mapInArrow(kernel, fields)


def _placed(turns: DataFrame) -> DataFrame:
    """Each turn's place ``idx`` and the tokens ``before`` it in its conversation.

    Prefix sums run within slots of the turn number and start from the sums of earlier slots, so a
    conversation of any length is spread over tasks. Turns tie by role and rendered text; a null
    turn number comes first, null conversations are one.
    """
    key = ["none", "conv"]
    slotted = turns.withColumn("none", F.col("conv_id").isNull()).withColumn("conv", F.coalesce("conv_id", F.lit(0).cast("bigint"))).withColumn("slot", F.coalesce(F.floor(F.col("turn") / F.lit(SLOT)), F.lit(-(1 << 62))))
    earlier = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = slotted.groupBy(*key, "slot").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    sums = sums.select(*key, "slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"))
    within = Window.partitionBy(*key, "slot").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "shown")
    up = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slotted.withColumn("idx", F.row_number().over(within) - 1).withColumn("before", F.sum("tokens").over(up) - F.col("tokens"))
    placed = placed.join(sums, [*key, "slot"])
    return placed.select(*key, "conv_id", (F.col("idx") + F.col("n0")).alias("idx"), (F.col("before") + F.col("t0")).alias("before"), "role", "target", "shown", "tokens")


class Turn(NamedTuple):
    conv_id: int | None
    kind: int  # 0: system turn of an earlier region, 1: last turns of the region before, 2: own
    idx: int
    role: str | None
    target: bool
    shown: str
    tokens: int


def _windows(turns: list[Turn], budget: int, history: int):
    """Greedy windows of one region: system turn, masked history, then new turns while they fit."""
    head, run = [t for t in turns if t.kind == 0], [t for t in turns if t.kind > 0]
    sums = [0, *accumulate(t.tokens for t in run)]  # turn i holds sums[i] .. sums[i + 1]
    first = sum(t.kind == 1 for t in run)
    system, low = (head[0] if head else None), 0
    if first < len(run) and run[first].idx == 0:
        system, low = (run[first], first + 1) if run[first].role == "system" else (None, first)
    elif first and run[0].idx == 0 and system:
        low = 1  # the system turn is no history, it comes first anyway
    at = first
    while at < len(run):
        keep = [system] if system and run[at].idx > 0 else []
        spent = sum(t.tokens for t in keep)
        room = min(history, max(0, budget - spent - run[at].tokens))
        back = min(at, max(low, bisect_left(sums, sums[at] - room)))
        spent += sums[at] - sums[back]
        stop = max(at + 1, bisect_right(sums, sums[at] + budget - spent) - 1)
        parts = [*keep, *run[back:stop]]
        repeats = len(parts) - (stop - at)
        place, spans = sum(len(t.shown) for t in parts[:repeats]), []
        for turn in run[at:stop]:
            if turn.target:
                spans.append({"start": place + len(header(turn.role)), "end": place + len(turn.shown) - len(CLOSE) - 1})
            place += len(turn.shown)
        used = spent + sums[stop] - sums[at]
        yield run[at].conv_id, run[at].idx, "".join(t.shown for t in parts), spans, repeats, used, used > budget
        at = stop


def _formatted(budget: int, history: int):
    """Kernel over rows sorted by region: one region is held at a time."""
    names = ["conv_id", "first_turn", "text", "loss", "repeats", "tokens", "over_budget"]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.string(), spans, pa.int32(), pa.int64(), pa.bool_()]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def kernel(batches):
        now, held, out = None, [], []
        for batch in batches:
            regions = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for region, turn in zip(regions, zip(*(batch.column(i).to_pylist() for i in range(3, 10)))):
                if region != now:
                    out += _windows(held, budget, history)
                    now, held = region, []
                held.append(Turn(*turn))
            if out:
                yield table(out)
                out = []
        out += _windows(held, budget, history)
        if out:
            yield table(out)

    return kernel


def format_windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None) -> DataFrame:
    """Training windows (conv_id, first_turn, text, loss, repeats, tokens, over_budget) of ``rows`` (conv_id, turn, role, text).

    A window is a span of whole turns. It repeats the conversation's system turn (a first turn of
    that role) and as many earlier turns as fit ``history`` tokens, ``repeats`` turns in all, then
    takes new turns while the sum stays within ``budget``. ``loss`` holds the spans, in code points,
    of the new assistant turns' texts, so a target counts in one window only. Tokens are those of
    the rendered turns. A turn that alone exceeds the budget gets a window of its own, marked
    ``over_budget``, and is not cut. Prefix sums cut conversations into regions of ``REGION``
    budgets, which are formatted on their own with the last turns of the region before as history.
    Null texts and roles are empty. Other columns are not read.
    """
    key = ["none", "conv"]
    region = budget * REGION
    placed, _ = written(_placed(_turns(rows, path)).withColumn("region", F.floor(F.col("before") / F.lit(region))))
    fields = [*key, "region", "conv_id", "kind", "idx", "role", "target", "shown", "tokens"]
    own = placed.withColumn("kind", F.lit(2)).select(fields)
    near = F.col("before") >= (F.col("region") + 1) * region - history
    tail = placed.filter(near).withColumn("region", F.col("region") + 1).withColumn("kind", F.lit(1)).select(fields)
    regions = placed.filter("region > 0").select(*key, "region").distinct()
    system = placed.filter("idx = 0 and role = 'system'").drop("region")
    heads = regions.join(system, key).withColumn("kind", F.lit(0)).select(fields)
    tail = tail.join(regions, [*key, "region"], "left_semi").select(fields)
    spans = "array<struct<start:bigint,end:bigint>>"
    schema = f"conv_id bigint, first_turn bigint, text string, loss {spans}, repeats int, tokens bigint, over_budget boolean"
    rows = own.unionByName(tail).unionByName(heads).repartition(*key, "region").sortWithinPartitions(*key, "region", "kind", "idx")
    return rows.mapInArrow(_formatted(budget, history), schema)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation from its windows' texts and loss spans.

    A digest runs over a conversation's turns in order, so its windows stream through one task in
    that order; only the running digests are held.
    """

    def kernel(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state = None, None
        done: list = []

        def close():
            done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, text, loss, repeats in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now != (conv,):
                    if now:
                        close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(text)[repeats:]
                state[0] += len(turns)
                state[1].update("".join(f"{role}\n{body}\n" for role, body, _, _ in turns).encode())
                learned = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
                done.clear()
        if now:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn").select("conv_id", "text", "loss", "repeats")
    return ordered.mapInArrow(kernel, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


SAMPLE = "\\### Assistant: </turn> ok"


def op8(rows: DataFrame) -> DataFrame:
    """The query: all conversations and conversation -7, read back from their windows."""
    turns = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    extra = rows.sparkSession.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAMPLE).alias("text"))
    return read_back(format_windows(turns.unionByName(extra)))
