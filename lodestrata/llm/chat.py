"""Chat formatting in budgeted windows.

A turn is written as ``<|im_start|>role``, a line break, its text, ``<|im_end|>``, a line break. Inside texts and roles a
backslash is put before the bar of every ``<|`` (and of every ``<\\|``, ``<\\\\|``, ..), so no control string can occur in
them, and taking one backslash away gives back what was there; roles have their line breaks escaped too.

1. Turns are range-partitioned by conversation and turn, so a conversation of any size is spread over tasks, and each task
   counts tokens and sums them up as it goes. What stands before a task in its first conversation is added from the
   tasks' sums (at most one row a task is sent to all), which gives prefix sums of tokens over whole conversations.
2. Prefix sums deal a conversation's turns to cells of ``cell`` tokens; turns that end in the last ``history`` tokens of a
   cell are repeated in the next, and the system turn in each. A cell is the largest group that a task takes at a time.
3. In a cell, prefix sums choose spans of whole turns: a window is the system turn, the last turns before the span with at
   most ``history`` tokens together, and as many new turns as the budget leaves room for. If one turn alone leaves no
   room, the history goes; if it is still too long, its window exceeds the budget: texts are never cut.
4. The loss mask holds the texts of new assistant turns. Repeated turns are not under the mask.

Windows are written as Parquet in the shared folder and read back from there. ``digests`` streams each conversation's
windows in order, keeping hashes only: a hash over a conversation can't be made in parts.

Defined results: rows of a conversation are in order of turn, role and text, null turns first; a null text or role is
empty; a null conversation is one of its own; identical rows are turns of their own; a conversation's system turn is its
first, if its role is ``system``; an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialize, new_path, tune
from .records import PieceEncoder

START, END = "<|im_start|>", "<|im_end|>"
#: Of each turn: its two marks.
MARK_TOKENS = 2
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
_ENCODERS: dict[str, PieceEncoder] = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def _count(path: str):
    """Rows (conv_id, turn, role, text, part) in order of conversation, with tokens and the sum of those before in the task."""

    def run(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = PieceEncoder(path)
        enc = _ENCODERS[path]
        width = 2 if enc.code == "H" else 4
        last, total = object(), 0
        for b in batches:
            tokens, before = [], []
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
                if conv != last:
                    last, total = conv, 0
                n = len(enc.encode(f"{escape_role(role)}\n{escape(text)}")) // width + MARK_TOKENS
                tokens.append(n)
                before.append(total)
                total += n
            yield pa.record_batch([*b.columns, pa.array(tokens, pa.int64()), pa.array(before, pa.int64())], names=[*b.schema.names, "tokens", "before"])

    return run


def turn_prefixes(turns: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Turns with their tokens and the tokens of their conversation before them, and where they are written."""
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    # equal rows are told apart by where they stand, so that not even they are bound to one task
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("conv_id", "turn", "role", F.xxhash64("text"), "at").drop("at")
    counted = dealt.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).mapInArrow(_count(path), "conv_id long, turn long, role string, text string, part int, tokens long, before long")
    out, at = materialize(counted, "turns")
    sums = out.groupBy("conv_id", "part").agg(F.sum("tokens").alias("n"))
    base = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = sums.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), base.alias("base")).where("base is not null")  # a part has at most one conversation that began before it
    out = out.join(F.broadcast(ahead), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    return out.select("conv_id", "role", "text", "tokens", (F.col("before") + F.coalesce("base", F.lit(0))).alias("before")), at


WINDOWS = "conv_id long, cell long, window long, text string, repeats int, n_tokens long, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def windows_of(own: list, budget: int, history: int, system=None, tail=()):
    """Windows (repeated turns, new turns) of one cell's turns (role, text, tokens, before): the system turn (if it is not
    among them) and the last turns of the cell before are repeated."""
    seen = list(tail)
    fixed = system

    def recent():
        out, n = [], 0
        for t in reversed(seen):
            if n + t[2] > history:
                break
            out.insert(0, t)
            n += t[2]
        return out

    k = 0
    while k < len(own):
        lead = [fixed] if fixed else []
        back = recent()
        room = budget - sum(t[2] for t in lead) - sum(t[2] for t in back)
        if own[k][2] > room:  # the history gives way to the turn
            room += sum(t[2] for t in back)
            back = []
        end = k + 1
        while end < len(own) and own[end][3] + own[end][2] - own[k][3] <= room:
            end += 1
        new = own[k:end]
        yield lead + back, new
        if fixed is None and new[0][3] == 0 and new[0][0] == "system":
            fixed, new = new[0], new[1:]
        seen = (seen + new)[-max(1, history) :]
        k = end


def written(turns):
    """The text of some turns and where the texts of each stand in it."""
    parts, at, places = [], 0, []
    for role, text, *_ in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        places.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), places


def _cells(budget: int, history: int):
    """Windows of rows (conv_id, cell, kind, role, text, tokens, before) sorted by these; kind 0: the system turn, 1: turns of
    the cell before, 2: own."""

    def finish(key, system, tail, own):
        for k, (old, new) in enumerate(windows_of(own, budget, history, system, tail)):
            turns = old + new
            text, places = written(turns)
            spans = [{"start": s, "end": e} for (role, *_), (s, e) in zip(turns[len(old) :], places[len(old) :]) if role == "assistant"]
            yield (*key, k, text, len(old), sum(t[2] for t in turns), spans)

    def batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), _SPANS]
        return pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["conv_id", "cell", "window", "text", "repeats", "n_tokens", "spans"])

    def run(batches):
        key, system, tail, own, out, size = None, None, [], [], [], 0
        for b in batches:
            for conv, cell, kind, *t in zip(*(b.column(k).to_pylist() for k in range(7))):
                if (conv, cell) != key:
                    for w in finish(key, system, tail, own) if own else ():
                        out.append(w)
                        size += len(w[3])
                        if size > 4 << 20:
                            yield batch(out)
                            out, size = [], 0
                    key, system, tail, own = (conv, cell), None, [], []
                if kind == 0:
                    system = tuple(t)
                else:
                    (tail if kind == 1 else own).append(tuple(t))
        out += finish(key, system, tail, own) if own else []
        if out:
            yield batch(out)

    return run


def format_conversations(turns: DataFrame, vocabulary: str, budget: int = 2048, history: int = 256, cell: int = 1 << 17) -> str:
    """Write the windows of all conversations (conv_id, turn, role, text); the path of the Parquet table (WINDOWS)."""
    spark = turns.sparkSession
    tune(spark)
    rows, at = turn_prefixes(turns, vocabulary)
    rows = rows.withColumns({"cell": F.expr(f"before div {cell}"), "kind": F.lit(2)})
    late = (F.col("tokens") <= history) & (F.col("before") + F.col("tokens") > (F.col("cell") + 1) * cell - history) & ~((F.col("before") == 0) & (F.col("role") == "system"))
    tail = rows.where(late).withColumns({"cell": F.col("cell") + 1, "kind": F.lit(1)})
    further = rows.where("cell > 0").select(F.col("conv_id").alias("_conv"), "cell").distinct()
    first = rows.where("before = 0 and role = 'system'").drop("cell")
    system = first.join(further, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("kind", F.lit(0))
    columns = ["conv_id", "cell", "kind", "role", "text", "tokens", "before"]
    every = rows.select(columns).unionByName(tail.select(columns)).unionByName(system.select(columns))
    dealt = every.repartition("conv_id", "cell").sortWithinPartitions("conv_id", "cell", "kind", "before")
    out = new_path(spark, "chat")
    dealt.mapInArrow(_cells(budget, history), WINDOWS).write.parquet(out)
    forget(spark, at)
    return out


def read_turns(text: str):
    """(role, text) of a window's turns, as they were."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Of each conversation, from the windows written: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""

    def run(batches):
        from itertools import chain

        last, state, out = None, None, []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def rows():
            return pa.record_batch([pa.array([r[c] for r in out], pa.string() if c in (2, 4) else pa.int64()) for c in range(6)], names=names)

        def done():
            n, turns, chars, loss, formatted = state
            out.append((last, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        for conv, text, repeats, spans in chain.from_iterable(zip(*(b.column(k).to_pylist() for k in range(4))) for b in batches):
            if state is None or conv != last:
                if state is not None:
                    done()
                    if len(out) == 1000:
                        yield rows()
                        out = []
                last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in read_turns(text)[repeats:]:
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
            for s in spans:
                under = unescape(text[s["start"] : s["end"]])
                state[2] += len(under)
                state[3].update(under.encode())
            state[4] += len(text)
        if state is not None:
            done()
        if out:
            yield rows()

    tune(spark)
    windows = spark.read.schema(WINDOWS).parquet(path)
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "cell", "window").select("conv_id", "text", "repeats", "spans")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
