"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn costs its words and symbols plus `mark_cost`.  Prefix sums of the costs
choose spans that start and end at turns: a span begins at the first turn that
no longer fits into the room left by the system turn and the history.  A turn
that is too long by itself is a span of its own, never cut.  Each window holds
the system turn (of the conversation's start), up to `history_turns` earlier
turns within `history_budget`, and its own span.  Which turns a window holds is
found from numbers alone; only then are turns and windows joined, so a long
conversation is never carried along once for each of its windows.  Repeated turns are marked as
such and never under the loss mask, so each assistant turn is a target once.

Each turn is written as `<s>[INST] role[/INST]text</s>`.  Inside roles and texts
a backslash becomes `\\e`, and the first character of a control string becomes
`\\l` (for `<`) or `\\b` (for `[`), which `unescape` takes back exactly.

Nulls and repeats: a null role or text is empty; turns of equal number are
ordered by role and text, a null number comes first; repeated rows are turns
each; a null conv_id is a conversation of its own; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_SHORT = {"<": "\\l", "[": "\\b"}
_TURN = r"(?s)<s>\[INST\] (.*?)\[/INST\](.*?)</s>"
_WORDS = r"[\p{L}\p{N}]+|[^ \t\n\r\p{L}\p{N}]"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(_SHORT[control[0]] + control[1:]))
    return text


def unescape(text: Column) -> Column:
    for plain, short in _SHORT.items():
        text = F.replace(text, F.lit(short), F.lit(plain))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def format_windows(turns: DataFrame, *, budget: int = 1024, history_turns: int = 2, history_budget: int = 256, mark_cost: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, window, text, cost, repeated (of each turn in it), loss_spans (start from 1, length; in code points)."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("cost", (F.regexp_count("text", F.lit(_WORDS)) + mark_cost).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("prefix", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # numbers only decide which turns are in which window; texts meet their windows after that, turn by turn
    light = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "cost", "prefix"))).alias("t"), F.min_by(F.struct("role", "cost"), "pos").alias("head"))
    light = light.withColumn("first", F.when(F.col("head.role") == "system", 2).otherwise(1))
    light = light.withColumn("room", F.lit(budget - history_budget) - F.when(F.col("first") == 2, F.col("head.cost")).otherwise(F.lit(0)))
    light = light.withColumn(
        "starts",
        F.expr("""aggregate(slice(t, first, size(t)), named_struct('starts', cast(array() as array<int>), 'base', 0L),
            (a, x) -> if(size(a.starts) = 0 or x.prefix - a.base > room,
                         named_struct('starts', array_append(a.starts, x.pos), 'base', x.prefix - x.cost), a),
            a -> if(size(a.starts) = 0, array(first), a.starts))"""),
    )
    member = "array<struct<pos: int, again: boolean>>"
    windows = F.expr(f"""transform(starts, (start, window) -> named_struct('window', window, 'members', concat(
        if(first = 2, array(named_struct('pos', 1, 'again', window > 0)), cast(array() as {member})),
        transform(filter(slice(t, greatest(first, start - {history_turns}), greatest(0, start - greatest(first, start - {history_turns}))),
            x -> t[start - 2].prefix - x.prefix + x.cost <= {history_budget}), x -> named_struct('pos', x.pos, 'again', true)),
        if(start > size(t), cast(array() as {member}),
            transform(sequence(start, coalesce(get(starts, window + 1), size(t) + 1) - 1), pos -> named_struct('pos', pos, 'again', false))))))""")
    members = light.select("conv_id", F.explode(windows).alias("w")).select("conv_id", "w.window", F.explode("w.members").alias("m")).alias("x")
    met = members.join(rows.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.m.pos") == F.col("y.pos")))
    turn = F.struct(
        "pos", F.concat(F.lit("<s>[INST] "), escape(F.col("role")), F.lit("[/INST]")).alias("before"), escape(F.col("text")).alias("body"), F.col("m.again").alias("again"), ((F.col("role") == "assistant") & ~F.col("m.again")).alias("target"), "cost",
    )
    made = met.select("x.conv_id", "window", turn.alias("turn")).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    loss = F.expr("""aggregate(turns, named_struct('at', 1L, 'spans', cast(array() as array<struct<start: bigint, length: bigint>>)),
        (a, x) -> named_struct('at', a.at + length(x.before) + length(x.body) + 4,
            'spans', if(x.target, array_append(a.spans, named_struct('start', a.at + length(x.before), 'length', cast(length(x.body) as bigint))), a.spans)),
        a -> a.spans)""")
    return made.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda x: F.concat(x["before"], x["body"], F.lit("</s>"))), "").alias("text"),
        F.expr("aggregate(turns, 0L, (n, x) -> n + x.cost)").alias("cost"),
        F.transform("turns", lambda x: x["again"]).alias("repeated"),
        loss.alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text; each once, in order), targets (texts under the loss mask), formatted_chars, of each conversation."""
    roles, texts = (F.regexp_extract_all("text", F.lit(_TURN), F.lit(group)) for group in (1, 2))
    parsed = windows.select("conv_id", "window", F.length("text").cast("long").alias("chars"), F.arrays_zip(roles.alias("role"), texts.alias("text"), F.col("repeated").alias("again")).alias("turns"), F.expr("transform(loss_spans, s -> substring(text, cast(s.start as int), cast(s.length as int)))").alias("targets"))
    parsed = parsed.withColumn("turns", F.transform(F.filter("turns", lambda x: ~x["again"]), lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text"))))
    parsed = parsed.withColumn("targets", F.transform("targets", unescape))
    whole = parsed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", F.expr("flatten(transform(w, x -> x.turns))").alias("turns"), F.expr("flatten(transform(w, x -> x.targets))").alias("targets"), "formatted_chars")
