"""Chat formatting of typed content parts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The strings that structure a formatted conversation.
BEGIN, ROLE_END, END = "<|turn|>", "<|says|>", "<|done|>"
#: The placeholder of each kind of attached part.
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens that a placeholder stands for once its part is expanded.
EXPANDED = {"image": 256, "audio": 128, "document": 512}

PART_TYPE = "array<struct<kind:string,text:string,ref:string>>"


def escape(text: Column) -> Column:
    """A text without any control string: & and < and [ become entities, which unescape() turns back."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("&#91;"), F.lit("["))
    out = F.replace(out, F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """Plain text as the one part of a turn."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref")))


def _kind(part: Column, name: str) -> Column:
    return F.coalesce(part["kind"] == name, F.lit(False))


def visit(parts: Column) -> dict[str, Column]:
    """What a visit of a turn's parts, in order, leaves.

    body: escaped text with a placeholder for each attached part; refs: kind and reference of the attachments in
    order; expanded_tokens: tokens that the placeholders stand for. A part of another kind, or a null one, counts as
    text; null parts of a turn are an empty text.
    """
    parts = F.coalesce(parts, F.array().cast(PART_TYPE))

    def shown(part: Column) -> Column:
        out = escape(part["text"])
        for kind, mark in PLACEHOLDER.items():
            out = F.when(_kind(part, kind), F.lit(mark)).otherwise(out)
        return out

    def tokens(part: Column) -> Column:
        out = F.lit(0)
        for kind, n in EXPANDED.items():
            out = F.when(_kind(part, kind), F.lit(n)).otherwise(out)
        return out

    attached = F.filter(parts, lambda p: F.coalesce(p["kind"].isin(*PLACEHOLDER), F.lit(False)))
    return {
        "body": F.array_join(F.transform(parts, shown), ""),
        "refs": F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"))),
        "expanded_tokens": F.aggregate(parts, F.lit(0), lambda s, p: s + tokens(p)),
    }


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, refs, expanded_tokens.

    parts_col holds typed parts (PART_TYPE). A turn is BEGIN role ROLE_END body END; what models learn is the body of
    assistant turns. Turns are in order of turn, then role, then body; a null turn comes first, a null role is empty,
    null conversations form one conversation of their own; repeated rows are turns of their own; an empty table gives
    an empty result; other columns are not read. One conversation is one output row, so it is gathered in one place.
    """
    seen = visit(F.col(parts_col))
    each = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), escape(F.col(role_col)).alias("role"), seen["body"].alias("body"), seen["refs"].alias("refs"), seen["expanded_tokens"].alias("n")).alias("t"),
    )
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    one = lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit(ROLE_END), t["body"], F.lit(END))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("ts", one), "").alias("formatted"),
        F.size("ts").cast("long").alias("n_turns"),
        F.flatten(F.transform("ts", lambda t: t["refs"])).alias("refs"),
        F.aggregate("ts", F.lit(0), lambda s, t: s + t["n"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns, array of (role, body): parsed from the text and still with its placeholders, unescaped.

    No text holds a control string, so the split is exact.
    """
    blocks = F.filter(F.split("formatted", r"<\|done\|>"), lambda x: x != "")
    inner = F.transform(blocks, lambda x: F.split(F.substr(x, F.lit(len(BEGIN) + 1)), r"<\|says\|>"))
    return formatted.withColumn("turns", F.transform(inner, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("body"))))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id and what read_back() shows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parsed = read_back(formatted)
    said = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["body"]), "")
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(said).cast("long").alias("loss_chars"),
        F.sha2(said.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
