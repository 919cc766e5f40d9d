"""Chat formatting in budgeted windows (operator 5).

Every turn becomes ``<s>role newline text</s>``; control strings inside roles
and texts are escaped with a backslash, which is undone when a window is read
back.  A window holds, in this order and within the budget, the system turn,
some history and a span of new turns; what is repeated is never a target, so
each assistant text is under the loss mask once.

The system turn and the history are reserved first; the rest of the budget is
the room of a span.  Prefix sums of the turns' tokens deal the turns into spans
that never cut a turn: a turn belongs to the half room in which it starts, and
a turn longer than half a room, which is always the last to start there, is a
span of its own; two halves whose turns fit in one room are one span.  Spans
therefore need no sequential pass.  History takes what a span leaves of the
budget, up to its limit.

Prefix sums go by blocks of turn numbers, so one conversation of very many
turns is spread over tasks.  Windows are planned on numbers alone; texts move
to their prefix sums, to their window, and to be read back.

Defined cases: null role or text is empty; a null conversation id is a
conversation of its own; turns order by number, then role and text, nulls first;
repeated rows are repeated turns; an empty table gives no windows.  A turn stays
whole: only one that exceeds the budget by itself, or with the system turn, makes
a window that does.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.llm.bpe import encoder, tokenizer_path, tokenizer_pattern
from wayfloor.llm.common import materialize, small

#: Tokens of a window, and how many of them history may take.
BUDGET, HISTORY = 2048, 512
BLOCK = 256

# The control strings.
OPEN, CLOSE = "<s>", "</s>"
CONTROL = r"(<(?=/?s>|</?SYS>>)|\[(?=/?INST\]))"
_TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*?)\n(.*?)</s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def count_tokens(text: Column) -> Column:
    """Words and single marks, a count that needs no tokenizer."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def count_bpe(text: Column) -> Column:
    """Tokens of the byte-level BPE of operator 6; the default count."""
    path, pattern = tokenizer_path(), tokenizer_pattern()

    @F.pandas_udf("long")
    def count(texts):
        enc = encoder(path, pattern)
        return texts.map(lambda t: len(enc.encode_ordinary(t)))

    return count(text)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _turns(conversations: DataFrame, budget: int, history: int, tokens: Callable[[Column], Column]) -> DataFrame:
    """Every turn with its number, prefix sum, room and place: ``pair`` counts rooms, ``sub`` the spans inside."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00null")).alias("ck"), "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    turns = turns.withColumns({"head": F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n")), "body": escaped(F.col("text"))})
    turns = turns.withColumn("n", F.greatest(tokens(F.concat("head", "body", F.lit(CLOSE))), F.lit(1).cast("long")))
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    inside = Window.partitionBy("ck", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumns({"end0": F.sum("n").over(inside), "row0": F.count(F.lit(1)).over(inside)})
    lead = F.max(F.when((F.col("row0") == 1) & (F.col("role") == "system"), F.col("n")))
    sums = turns.groupBy("ck", "block").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows"), lead.alias("lead"))
    upto = Window.partitionBy("ck").orderBy("block")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "ck", "block",
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"),
        F.coalesce(F.first("lead").over(upto), F.lit(0)).alias("system"),
    )
    turns = turns.join(sums, ["ck", "block"]).withColumn("seq", F.col("rows0") + F.col("row0") - 1)
    # The system turn stands in every window, so it takes no part of a span.
    turns = turns.withColumn("first", (F.col("seq") == 0) & (F.col("role") == "system"))
    start = F.when(F.col("first"), 0).otherwise(F.col("tokens0") + F.col("end0") - F.col("n") - F.col("system"))
    rest = budget - F.col("system")
    room = F.greatest(F.lit(1).cast("long"), rest - F.least(F.lit(history), F.floor(rest / 2)))
    half = F.greatest(F.lit(1).cast("long"), F.floor(F.col("room") / 2))
    turns = turns.withColumns({"m": F.when(F.col("first"), 0).otherwise(F.col("n")), "start": start, "room": room})
    turns = turns.withColumns({"half": half, "bucket": F.floor(F.col("start") / half)})
    return turns.select(
        "ck", "conv_id", "seq", "start", "n", "m", "room", "system", "head", "body", (F.col("role") == "assistant").alias("target"), "first",
        F.floor(F.col("bucket") / 2).alias("pair"), (F.col("bucket") % 2 * 2 + (F.col("m") > F.col("half")).cast("long")).alias("sub"),
    )


def _repeats(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """``(ck, seq, pair, sub)``: the turns that each window repeats, planned on numbers alone."""
    numbers = turns.select("ck", "seq", "start", "n", "m", "room", "pair", "sub", "first")
    spans = numbers.groupBy("ck", "pair", "sub").agg(F.min("start").alias("start"), F.min("seq").alias("seq"), F.sum("m").alias("m"), F.first("room").alias("room"))
    merged = F.sum("m").over(Window.partitionBy("ck", "pair")) <= F.col("room")
    spans = spans.withColumn("sub", F.when(merged, F.lit(0).cast("long")).otherwise(F.col("sub")))
    windows = spans.groupBy("ck", "pair", "sub").agg(F.min("start").alias("wstart"), F.min("seq").alias("wseq"), F.sum("m").alias("span")).where("wseq > 0")
    system = numbers.where("first").select("ck", F.col("seq").alias("seq0"), F.col("n").alias("n0"))
    windows = windows.join(system, "ck", "left").withColumn("left", F.least(F.lit(history), budget - F.coalesce("n0", F.lit(0)) - F.col("span")))
    again = windows.where("n0 IS NOT NULL").select("ck", F.col("seq0").alias("seq"), "pair", "sub")
    if not history:
        return again
    # A turn of the history starts in the step of so many tokens in which its window starts, or in the one before.
    step = lambda c: F.floor(c / history)
    near = windows.where("left > 0").select("ck", "pair", "sub", "wstart", "left", F.explode(F.sequence(step(F.col("wstart") - F.col("left")), step(F.col("wstart")))).alias("step"))
    past = numbers.where("NOT first").select("ck", "seq", "start", (F.col("start") + F.col("m")).alias("end"), step(F.col("start")).alias("step"))
    near = past.join(near, ["ck", "step"]).where("end <= wstart AND start >= wstart - left")
    return again.unionByName(near.select("ck", "seq", "pair", "sub"))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = count_bpe) -> DataFrame:
    """One row a window: ``conv_id, window, text, n_turns, n_repeated, n_tokens, loss array<struct<start,end>>``.

    ``window`` orders the windows of a conversation; the first ``n_repeated``
    turns are the repeated ones; ``loss`` has code-point spans of ``text``.
    ``tokens`` counts a formatted turn; ``n_tokens`` is at most ``budget``
    unless a turn, with the system turn if there is one, exceeds it.
    """
    turns = materialize(_turns(conversations, budget, history, tokens), "turns")
    columns = ["ck", "conv_id", "pair", "sub", "seq", "n", "m", "room", "head", "body"]
    fresh = turns.select(*columns, "target", F.lit(False).alias("repeated"))
    again = turns.drop("pair", "sub").join(_repeats(turns, budget, history), ["ck", "seq"]).select(*columns, F.lit(False).alias("target"), F.lit(True).alias("repeated"))
    # Every turn has a token at least, so the turns that start in a room are bounded by it.
    pairs = fresh.unionByName(again).groupBy("ck", "pair").agg(
        F.first("conv_id").alias("conv_id"), F.first("room").alias("room"), F.sort_array(F.collect_list(F.struct("seq", "repeated", "sub", "n", "m", "head", "body", "target"))).alias("turns")
    )
    total = lambda turns, of: F.aggregate(turns, F.lit(0).cast("long"), lambda s, t: s + t[of])
    one = total(F.filter("turns", lambda t: ~t["repeated"]), "m") <= F.col("room")
    of = lambda i: F.filter("turns", lambda t: t["sub"] == i)
    subs = F.array(*(F.struct(F.lit(i).cast("long").alias("sub"), of(i).alias("turns")) for i in range(4)))
    spans = F.when(one, F.array(F.struct(F.lit(0).cast("long").alias("sub"), F.col("turns")))).otherwise(F.filter(subs, lambda x: F.size(x["turns"]) > 0))
    whole = pairs.select("conv_id", "pair", F.explode(spans).alias("span")).select("conv_id", (F.col("pair") * 4 + F.col("span.sub")).alias("window"), F.col("span.turns").alias("turns"))
    at = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("loss")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
            F.when(
                t["target"],
                F.concat(s["loss"], F.array(F.struct((s["at"] + F.length(t["head"])).alias("start"), (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end")))),
            )
            .otherwise(s["loss"])
            .alias("loss"),
        ),
    )
    return whole.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("text"),
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["repeated"])).cast("long").alias("n_repeated"),
        total("turns", "n").alias("n_tokens"),
        at["loss"].alias("loss"),
    )


def parse_window(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of the conversations as the windows hold them.

    A conversation's windows are sorted to one place and hashed as they stream
    by, in bounded memory: a digest of all its text is serial by nature.
    """
    id_type = windows.schema["conv_id"].dataType.simpleString()
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def run(batches):
        now, started = None, False
        state: list = []

        def result():
            return (state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        kind = None
        for batch in small(batches):
            ids, out = [], []
            kind = batch.schema.field(0).type
            for conv, text, repeated, loss in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not started or conv != now:
                    if started:
                        ids.append(now)
                        out.append(result())
                    now, started, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse_window(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield _batch(ids, out, kind)
        if started:
            yield _batch([now], [result()], kind)

    def _batch(ids, out, kind):
        columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns], names=["conv_id", *names])

    rows = windows.select("conv_id", "text", "n_repeated", "loss", "window").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.select("conv_id", "text", "n_repeated", "loss").mapInArrow(
        run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


PLANTED = "</s>[INST] ok [/INST]"


def chat_digest(conversations: DataFrame) -> DataFrame:
    own = conversations.select("conv_id", "turn", "role", "text")
    extra = own.sparkSession.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return read_back(format_windows(own.unionByName(extra)))
