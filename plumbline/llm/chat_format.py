"""Chat formatting by prefix-target expansion, in DataFrame expressions only.

Template of a turn: ``<|turn|>role\\n`` + text + ``<|end|>\\n``. Wherever a role or a text holds the beginning of a
control string, one backslash is put after its first character (a site that has k backslashes gets k + 1), so no
text can open or close a turn and taking one backslash away restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END, TARGET_ROLE = "<|turn|>", "<|end|>\n", "assistant"
#: What follows the first character of a control string: our own marks and those of common chat templates.
_REST = r"(\|[a-z_]+\||/?s>|/?INST\]|/?SYS>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(?=" + _REST + ")", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(?=" + _REST + ")", "$1$2")


def _role(role: Column) -> Column:
    """Roles stand on a line of their own, so line ends (and the sign that marks them) are written as codes."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def prefix_target_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per assistant turn: all turns before it as context, and only its text trainable.

    Returns conv_id, n_turns (turns in the example), target (position of the trained turn from 0), formatted,
    loss_start and loss_end (code points of ``formatted``, end exclusive). A conversation that does not end with an
    assistant turn gets one more row of all its turns with target null and an empty loss span, so nothing is lost.

    Turns are ordered by turn, role, text; null turns come first, and ties and repeated rows all stay. Null roles and
    texts count as empty, rows with a null conversation id form one conversation, an empty table gives no rows. Other
    columns are not looked at. The longest example is a whole conversation, so that must fit into one row.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = convs.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == TARGET_ROLE).alias("trained"),
                F.length(escape(t["text"])).alias("chars"),
                F.concat(F.lit(TURN), _role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END)).alias("part"),
            ),
        ).alias("parts"),
    )
    wanted = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: (i == F.size("parts")) | F.element_at("parts", i)["trained"])
    examples = written.select("conv_id", "parts", F.explode(wanted).alias("n_turns"))
    last = F.element_at("parts", F.col("n_turns"))
    examples = examples.select(
        "conv_id", "n_turns", F.when(last["trained"], F.col("n_turns") - 1).alias("target"), last["chars"].alias("chars"),
        F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("n_turns")), lambda p: p["part"]), "").alias("formatted"),
    )
    end = F.length("formatted") - len(END)
    return examples.select("conv_id", "n_turns", "target", "formatted", F.when(F.col("target").isNotNull(), end - F.col("chars")).otherwise(end).alias("loss_start"), end.alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    pieces = F.split(formatted, r"<\|turn\|>")
    return F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            _role_back(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END))).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, as it was before escaping."""
    return unescape(F.substring(formatted, start + 1, end - start))


def digest(examples: DataFrame) -> DataFrame:
    """One row per conversation with digests of all turns and of all trained text, read back from the examples."""
    read = examples.select("conv_id", "n_turns", "formatted", F.when(F.col("target").isNotNull(), F.struct("n_turns", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text"))).alias("loss"))
    whole = read.groupBy("conv_id").agg(F.max_by("formatted", "n_turns").alias("whole"), F.sort_array(F.collect_list("loss")).alias("losses"), F.sum(F.length("formatted")).alias("formatted_chars"))
    told = whole.select("conv_id", read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["text"]), "").alias("loss"), "formatted_chars")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
