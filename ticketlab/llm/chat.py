"""Chat formatting that is read back by its own grammar before it is let out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"

CONTROL = r"</?s>|\[/?INST\]"
_ESCAPABLE = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
LEARNT = "assistant"
ATTEMPTS = 2


def escape(text: Column) -> Column:
    """One more backslash after the first character of all that looks like a control string."""
    return F.regexp_replace(text, _ESCAPABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    """turn = BEGIN role OPEN " " text " " CLOSE END; role and text hold no control string."""
    return F.concat(F.lit(BEGIN), role, F.lit(OPEN + " "), text, F.lit(f" {CLOSE}{END}"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text as structs of role and text, escapes undone.

    Null if the control strings do not come in the order of the grammar.
    """
    marks = F.regexp_extract_all(formatted, F.lit(CONTROL), F.lit(0))
    turns = F.split(formatted, r" \[/INST\]</s>")
    count = F.size(turns) - 1
    wanted = F.array_repeat(F.array(F.lit(BEGIN), F.lit(OPEN), F.lit(CLOSE), F.lit(END)), count)

    def turn(x: Column) -> Column:
        at = F.instr(x, OPEN)
        role = F.substring(x, F.lit(len(BEGIN) + 1), at - F.lit(len(BEGIN) + 1))
        text = F.substring(x, at + len(OPEN) + 1, F.length(x))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.when(marks == F.flatten(wanted), F.transform(F.slice(turns, F.lit(1), count), turn))


def _checked(role: Column, text: Column) -> Column:
    """The turn as it is if it parses to its source, else escaped."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    out, r, t = render(role, text), role, text
    for _ in range(ATTEMPTS - 1):
        same = F.coalesce(parse(out) == source, F.lit(False))
        r, t = escape(r), escape(t)
        out = F.when(same, out).otherwise(render(r, t))
    return out


def format_chats(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Per conversation: its id, ``formatted``, the parsed ``turns`` and ``identical``.

    Turns are rendered row by row. A turn whose rendering does not parse to its role and
    text, because they hold control strings or what an escaped one looks like, is
    rendered escaped; an escaped control string has one more backslash than before, so
    that escaping is reversible whatever the text. The turns of a conversation are then
    joined by ``turn``, equal ones by role and text, and the whole is parsed again.
    ``identical`` says that the parse gives the source turns.

    A conversation is one value, so it has to fit in a row of its task; rows are
    shuffled once, by conversation, and nothing else is gathered. Null roles and texts
    are empty; null turns come first; rows without a conversation id are one conversation
    with a null id; repeated rows are turns of their own. Other columns are ignored, an
    empty table gives an empty result.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    made = rows.select(
        F.col(conv_col).alias("conv"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), _checked(role, text).alias("out")).alias("t"),
    )
    whole = made.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("source"))
    joined = whole.select(
        "conv",
        F.transform("source", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
        F.array_join(F.transform("source", lambda x: x["out"]), "").alias("formatted"),
    )
    parsed = joined.withColumn("turns", parse(F.col("formatted")))
    return parsed.select(
        F.col("conv").alias(conv_col),
        "formatted",
        "turns",
        F.coalesce(F.col("turns") == F.col("source"), F.lit(False)).alias("identical"),
    )


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What was read back, as counts and SHA-256 sums; the loss mask is on assistant texts."""
    turn = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    learnt = F.array_join(
        F.transform(F.filter("turns", lambda x: x["role"] == LEARNT), lambda x: x["text"]), ""
    )
    return chats.select(
        conv_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "identical",
    )
