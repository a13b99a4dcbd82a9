"""Chat formatting with typed content parts.

A conversation is a list of turns, a turn a list of typed parts. A visitor (one case per
part type) flattens the parts of a turn into text with ordered placeholders, and records
for every placeholder the attachment it stands for and the number of tokens it expands to.

Template, one piece per turn::

    <turn ROLE>
    BODY
    </turn>

Control strings all start with ``<``, and roles and texts are escaped so that they hold none
(and no ``>`` in a role): backslash becomes ``\\s``, ``<`` becomes ``\\l``, ``>`` in a role ``\\g``.
After escaping every backslash is followed by one of these letters, so the way back is exact.
The n-th placeholder (``<image>``, ``<audio>``, ``<document>``) belongs to the n-th attachment.

Only DataFrame functions are used. The turns of one conversation meet in one row, which is the
output record itself; conversations are spread by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import table

PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"
#: Tokens a placeholder expands to: per unit (image tiles, seconds of audio, document pages) and fixed.
TOKENS = {"image": (256, 1), "audio": (50, 2), "document": (800, 2)}
OPEN, HEAD_END, CLOSE = "<turn ", ">\n", "\n</turn>\n"
PLACEHOLDER = "<(image|audio|document)>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    back = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(back, F.lit("\\s"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """The parts of a turn that has only text; null is empty."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("long").alias("units"),
        )
    ).cast(PARTS)


def visit(part: Column, tokens: dict[str, tuple[int, int]]) -> Column:
    """One part: what stands in the body, whether it is text, and the attachment it refers to.

    An unknown or null type is text. Null text is empty, null units count as one.
    """
    body, cost = escape(F.coalesce(part["text"], F.lit(""))), F.lit(0).cast("long")
    units = F.coalesce(part["units"], F.lit(1)).cast("long")
    attached = part["type"].isin(*tokens)
    for kind, (each, fixed) in tokens.items():
        mine = part["type"] == kind
        body = F.when(mine, F.lit(f"<{kind}>")).otherwise(body)
        cost = F.when(mine, units * each + fixed).otherwise(cost)
    return F.struct(
        body.alias("body"),
        F.coalesce(~attached, F.lit(True)).alias("is_text"),
        part["type"].alias("type"),
        part["ref"].alias("ref"),
        cost.alias("tokens"),
    )


def format_chat(turns: DataFrame, tokens: dict[str, tuple[int, int]] | None = None, learn: str = "assistant") -> DataFrame:
    """Format conversations.

    ``turns`` has conv_id, turn, role and parts (see ``PARTS``). Returns one row per conv_id (null is
    a conversation too): formatted, loss (spans of code points, one per text part of a ``learn`` turn, start
    inclusive, end exclusive), attachments (ordered: turn, type, ref, tokens) and expanded_tokens (their
    sum). Turns are ordered by turn (null first); ties by role, then body; repeated rows stay repeated;
    null roles and null parts are empty; other columns are ignored.
    """
    tokens = tokens or TOKENS
    role = F.coalesce(F.col("role"), F.lit(""))
    seen = turns.select(
        "conv_id",
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.transform(F.coalesce(F.col("parts"), F.array().cast(PARTS)), lambda p: visit(p, tokens)).alias("seen"),
    )
    seen = seen.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(HEAD_END)).alias("head"),
            "seen",
        ).alias("t"),
    )
    grouped = seen.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    at = F.lit(0).cast("long")
    spans = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add_part(a: Column, p: Column, learned: Column) -> Column:
        end = (a["at"] + F.length(p["body"])).cast("long")
        span = F.array(F.struct(a["at"].alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"), F.when(learned & p["is_text"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans")
        )

    def add_turn(a: Column, t: Column) -> Column:
        inner = F.aggregate(
            t["seen"],
            F.struct((a["at"] + F.length(t["head"])).cast("long").alias("at"), a["spans"].alias("spans")),
            lambda b, p: add_part(b, p, t["role"] == learn),
        )
        return F.struct((inner["at"] + len(CLOSE)).cast("long").alias("at"), inner["spans"].alias("spans"))

    def piece(t: Column) -> Column:
        return F.concat(t["head"], F.array_join(F.transform(t["seen"], lambda p: p["body"]), ""), F.lit(CLOSE))

    def refs(t: Column) -> Column:
        return F.transform(
            F.filter(t["seen"], lambda p: ~p["is_text"]),
            lambda p: F.struct(t["turn"].alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")),
        )

    attachments = F.flatten(F.transform("ts", refs))
    out = grouped.select(
        "conv_id",
        F.array_join(F.transform("ts", piece), "").alias("formatted"),
        F.aggregate("ts", F.struct(at.alias("at"), spans.alias("spans")), add_turn)["spans"].alias("loss"),
        attachments.alias("attachments"),
    )
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return out.withColumn("expanded_tokens", total)


def parse_chat(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: adds turns (role, text, kinds of placeholders) and loss_text (text under the mask)."""

    def turn(piece: Column) -> Column:
        body = F.regexp_extract(piece, r"(?s)^<turn [^>]*>\n(.*)$", 1)
        return F.struct(
            unescape(F.regexp_extract(piece, r"^<turn ([^>]*)>\n", 1)).alias("role"),
            unescape(F.regexp_replace(body, PLACEHOLDER, "")).alias("text"),
            F.regexp_extract_all(body, F.lit(PLACEHOLDER), F.lit(1)).alias("placeholders"),
        )

    pieces = F.filter(F.split("formatted", F.lit(CLOSE), -1), lambda p: F.startswith(p, F.lit(OPEN)))
    cut = F.transform(
        "loss",
        lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(cut, ""))


def op3_chat_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    chat = format_chat(rows.unionByName(probe).withColumn("parts", text_part(F.col("text"))))
    back = parse_chat(chat)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


ORACLE = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(replace(text, '\', ''), '<', '')) AS body,
         length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) AS head
  FROM said)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(17 + head + body)::BIGINT AS formatted_chars,
       0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM sized GROUP BY conv_id
"""
