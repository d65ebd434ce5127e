"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its text is trainable.
Control strings inside texts get one backslash after their first character (`</s>` -> `<\\/s>`, `<\\/s>` -> `<\\\\/s>`),
so a formatted text holds bare control strings only where the template put them, and unescaping is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"/?(?:s>|INST\]|SYS\]|ROLE\])"
ESCAPE = rf"([<\[])(\\*)({CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)({CONTROL})"
OPEN, CLOSE = "<s>", "</s>"
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[/ROLE]")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _rendered(turn: Column) -> Column:
    """(head, body, tail) of one turn; roles without marks of their own are written out."""
    role, body = turn["role"], escape(turn["text"])
    other = F.concat(F.lit(OPEN + OTHER[0]), escape(role), F.lit(OTHER[1]))
    head, tail = F.when(role == "assistant", OPEN), F.when(role == "assistant", CLOSE)
    for name, (before, after) in MARKS.items():
        head, tail = head.when(role == name, OPEN + before), tail.when(role == name, after + CLOSE)
    return F.struct(head.otherwise(other).alias("head"), body.alias("body"), tail.otherwise(CLOSE).alias("tail"))


def expand(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, is_last, formatted, loss_start, loss_end): one row per assistant turn.

    `turns` has conv_id, turn, role, text; other columns are ignored. Turns are ordered by (turn, role, text) with nulls
    first; repeated rows are turns of their own. A null role or text counts as empty; a null conv_id is a conversation of
    its own. Offsets are code points, end exclusive. Turns after the last assistant turn, or a conversation without one,
    give one last row with null offsets, which trains nothing; `example` then is one more than the assistant turns.
    An example holds its whole context, so a conversation must fit one row.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    ends = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (F.col("t")[i - 1]["role"] == "assistant") | (i == F.size("t")))
    cut = whole.select("conv_id", F.transform("t", _rendered).alias("r"), F.transform("t", lambda x: x["role"]).alias("roles"), ends.alias("ends"))
    each = cut.select("conv_id", "r", "roles", F.posexplode("ends").alias("example", "upto"))
    last = F.col("r")[F.col("upto") - 1]
    text = F.array_join(F.transform(F.slice("r", F.lit(1), F.col("upto")), lambda x: F.concat(x["head"], x["body"], x["tail"])), "")
    trained = F.col("roles")[F.col("upto") - 1] == "assistant"
    out = each.select(
        "conv_id",
        (F.col("example") + 1).alias("example"),
        F.col("upto").alias("n_turns"),
        (F.col("upto") == F.size("r")).alias("is_last"),
        text.alias("formatted"),
        F.when(trained, F.length(last["tail"])).alias("_after"),
        F.when(trained, F.length(last["body"])).alias("_body"),
    )
    end = F.length("formatted") - F.col("_after")
    return out.select(
        "conv_id", "example", "n_turns", "is_last", "formatted", (end - F.col("_body")).alias("loss_start"), end.alias("loss_end")
    )


def parsed(formatted: Column) -> Column:
    """ARRAY<STRUCT<role, text>> read back from a formatted text."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(OPEN) + 1))
        role, text = F.lit("assistant"), inner
        for name, (before, after) in MARKS.items():
            own = F.startswith(inner, F.lit(before))
            role = F.when(own, name).otherwise(role)
            text = F.when(
                own, F.substr(inner, F.lit(len(before) + 1), F.length(inner) - len(before) - len(after))
            ).otherwise(text)
        stated = F.startswith(inner, F.lit(OTHER[0]))
        at = F.instr(inner, OTHER[1])
        role = F.when(stated, unescape(F.substr(inner, F.lit(len(OTHER[0]) + 1), at - len(OTHER[0]) - 1))).otherwise(role)
        text = F.when(stated, F.substr(inner, at + len(OTHER[1]))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted texts alone: turn count and digest, trained text and its digest, characters."""
    turns = F.when(F.col("is_last"), parsed(F.col("formatted")))
    target = F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    each = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("bigint").alias("chars"),
        F.size(turns).cast("bigint").alias("n"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("digest"),
        F.coalesce(unescape(target), F.lit("")).alias("target"),
    )
    trained = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "target"))), lambda x: x["target"]), "")
    return each.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max("digest").alias("turns_sha256"),
        trained.alias("_trained"),
        F.sum("chars").alias("formatted_chars"),
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("_trained").cast("bigint").alias("loss_chars"),
        F.sha2("_trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )
