"""Chat formatting with typed content parts, in column expressions only.

A turn is a role and an ordered array of parts: (type, text, ref, units). A visitor turns text parts into escaped
text and image, audio and document parts into a placeholder `<|type|>`, recording for each its place, reference
and the tokens it expands to (units times the rate of its type). A conversation is its turns in order, each
`<|im_start|>role`, a newline, the content and `<|im_end|>` with a newline.

Escaping is reversible and leaves no control string inside a text: every backslash is doubled and `<|` becomes
`<\\|`; in a role a newline becomes `<\\n`. Doubling makes runs of backslashes even, so the single one marks an escape.

The loss mask holds, turn by turn, the span of the turn's segment that is trained on (code points from the start of
the segment), or null. `read_back` works from the formatted text and the mask alone, in time linear in the text.

Rules: null roles, texts and parts are empty; an unknown part type is read as text; null units are 0. Turns are
ordered by turn (null first), then role, then content; repeated rows are turns of their own. Rows without conv_id
form one conversation with a null id. An empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PART = "array<struct<type:string,text:string,ref:string,units:bigint>>"
#: Tokens that one unit of an attachment expands to: image patches, tenths of a second, document pages.
RATES = {"image": 1, "audio": 1, "document": 512}
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("units")))


def _visit(part: Column, rates: dict[str, int]) -> Column:
    """A part as it stands in the formatted text."""
    return F.when(part["type"].isin(*rates), F.concat(F.lit("<|"), part["type"], F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _expanded(part: Column, rates: dict[str, int]) -> Column:
    rate = F.lit(0)
    for kind, n in rates.items():
        rate = F.when(part["type"] == kind, n).otherwise(rate)
    return (F.coalesce(part["units"], F.lit(0)) * rate).cast("bigint")


def format_chats(turns: DataFrame, rates: dict[str, int] = RATES, trained: str = TRAINED) -> DataFrame:
    """One row per conversation from rows of (conv_id, turn, role, parts).

    Returns conv_id, formatted, loss_mask (array of start and length per turn), attachments (turn number, place among
    the turn's parts, type, ref, tokens) and expanded_tokens.
    """
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("<\\n")), F.lit("\n"))
    parts = F.coalesce(F.filter("parts", lambda p: p.isNotNull()), F.array().cast(PART))
    body = F.array_join(F.transform(parts, lambda p: _visit(p, rates)), "")
    placed = F.transform(
        parts, lambda p, i: F.struct(i.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p, rates).alias("tokens"))
    )
    span = F.when(role == trained, F.struct(F.char_length("head").alias("start"), F.char_length("body").alias("length")))
    rows = turns.select("conv_id", "turn", role.alias("role"), head.alias("head"), body.alias("body"), F.filter(placed, lambda p: p["type"].isin(*rates)).alias("attached"))
    rows = rows.select("conv_id", F.struct("turn", "role", "body", "head", span.alias("span"), "attached").alias("t"))
    every = F.array_sort(F.collect_list("t"))  # one conversation is one text, so its turns meet
    attached = F.flatten(
        F.transform(
            "turns",
            lambda t, n: F.transform(
                t["attached"], lambda p: F.struct(n.alias("turn"), p["place"].alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))
            ),
        )
    )
    done = rows.groupBy("conv_id").agg(every.alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform("turns", lambda t: t["span"]).alias("loss_mask"),
        attached.alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, p: n + p["tokens"])
    return done.withColumn("expanded_tokens", tokens)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_texts and formatted, parsed from `formatted` and `loss_mask`."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    segments = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    head = lambda s: F.substring_index(s, "\n", 1)
    turn = lambda s: F.struct(
        unescape(F.replace(F.substr(head(s), F.lit(len(START) + 1)), F.lit("<\\n"), F.lit("\n"))).alias("role"),
        unescape(F.substr(s, F.char_length(head(s)) + 2)).alias("text"),
    )
    under = F.zip_with("segments", "loss_mask", lambda s, m: unescape(F.substr(s, m["start"] + 1, m["length"])))
    return formatted.withColumn("segments", segments).select(
        "conv_id", F.transform("segments", turn).alias("turns"), F.filter(under, lambda t: t.isNotNull()).alias("loss_texts"), "formatted"
    )


def digests(back: DataFrame) -> DataFrame:
    """Counts and digests of what `read_back` returns."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
