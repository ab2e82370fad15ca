"""Chat formatting by prefix-target expansion, in DataFrame functions only.

``render`` writes a conversation as one string, ``expand`` turns every assistant turn into an example of its own: all
turns before it are the context and only that reply is trainable, ``parse`` reads turns back from a rendered string, and
``digests`` reads whole conversations back from their examples.

Template. A user turn is ``[INST]text[/INST]``, an assistant turn ``text</s>``, any other role (null counts as an empty
name) ``[ROLE]role[INST]text[/INST]``. Texts and role names are escaped so that none of these control strings can occur
in them: a backslash becomes ``\\0`` and the control strings ``\\1`` to ``\\4``; every backslash in an escaped text thus
starts a code, which makes the escape reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END, ROLE = "[INST]", "[/INST]", "</s>", "[ROLE]"
#: The backslash comes first, so that the codes that follow are the only ones after it.
CODES = (("\\", "\\0"), (END, "\\1"), (OPEN, "\\2"), (CLOSE, "\\3"), (ROLE, "\\4"))


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _lead(role: Column) -> Column:
    """What stands before the text of a turn."""
    return (
        F.when(role == "user", F.lit(OPEN))
        .when(role == "assistant", F.lit(""))
        .otherwise(F.concat(F.lit(ROLE), escape(role), F.lit(OPEN)))
    )


def _tail(role: Column) -> Column:
    return F.when(role == "assistant", F.lit(END)).otherwise(F.lit(CLOSE))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, replies, text): one row per conversation, its turns ordered by turn, then role and text.

    replies is the number of assistant turns. Null texts and roles count as empty. Repeated rows are turns like any others.
    Rows with a null conv_id are one conversation. An empty table gives an empty result; other columns are not read.
    A conversation is held by one task as it is one string in the end; nothing else is gathered.
    """
    turns = F.sort_array(
        F.collect_list(
            F.struct(
                F.col("turn").cast("long").alias("turn"),
                F.coalesce(F.col("role"), F.lit("")).alias("role"),
                F.coalesce(F.col("text"), F.lit("")).alias("text"),
            )
        )
    )
    written = F.transform("turns", lambda t: F.concat(_lead(t["role"]), escape(t["text"]), _tail(t["role"])))
    return (
        conversations.groupBy("conv_id")
        .agg(turns.alias("turns"))
        .select("conv_id", F.size(F.filter("turns", lambda t: t["role"] == "assistant")).alias("replies"), F.array_join(written, "").alias("text"))
    )


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, context, reply, loss_start, loss_chars, last): an example for every assistant turn.

    context is the rendered text of all turns before it, reply its escaped text with the end mark. Trainable are the
    loss_chars code points from loss_start (from 0) of context followed by reply; loss_start is the context's length.
    nth counts from 1. A conversation that doesn't end with a reply has a closing row of which nothing is trainable: all its
    turns as context, an empty reply. So context and reply of a conversation's row marked last hold the whole of it, and
    nothing of the input is lost. Rows as in ``render``.

    The end mark stands nowhere but behind replies, so the nth example is the text up to the nth mark, and its reply what
    follows the last mark before: each is cut out of the rendered text in one pass, and the work is that of writing the
    contexts down, which grow with the square of a conversation's turns.
    """
    rendered = render(conversations)
    open_end = F.when(F.endswith("text", F.lit(END)), 0).otherwise(1)
    each = rendered.select("conv_id", "replies", "text", F.explode(F.sequence(F.lit(1), F.col("replies") + open_end)).alias("nth"))
    closing = F.col("nth") > F.col("replies")
    each = each.withColumn("upto", F.when(closing, F.col("text")).otherwise(F.call_function("substring_index", F.col("text"), F.lit(END), F.col("nth"))))
    each = each.withColumn("body", F.when(closing, "").otherwise(F.substring_index(F.substring_index("upto", CLOSE, -1), END, -1)))
    start = F.length("upto") - F.length("body")
    return each.select(
        "conv_id",
        "nth",
        F.substring("upto", F.lit(1), start).alias("context"),
        F.when(closing, "").otherwise(F.concat("body", F.lit(END))).alias("reply"),
        start.cast("long").alias("loss_start"),
        F.length("body").cast("long").alias("loss_chars"),
        (F.col("nth") >= F.col("replies") + open_end).alias("last"),
    )


def parse(text: Column) -> Column:
    """array<struct<role, text>> from a rendered string: the inverse of ``render``.

    Empty text has no turns, null gives null. In a string that ``render`` never wrote, what follows the last closing mark
    is read as a user's turn without the length of that mark at its end, and codes unknown to the escape stay as they are.
    """
    pieces = F.filter(F.split(text, r"(?<=\[/INST\])|(?<=</s>)", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        is_reply = F.endswith(p, F.lit(END))
        has_role = F.startswith(p, F.lit(ROLE))
        body = F.substring(p, F.lit(1), F.length(p) - F.when(is_reply, len(END)).otherwise(len(CLOSE)))
        return F.struct(
            F.when(is_reply, F.lit("assistant"))
            .when(has_role, unescape(F.substring(F.substring_index(p, OPEN, 1), len(ROLE) + 1, 1 << 30)))
            .otherwise(F.lit("user"))
            .alias("role"),
            unescape(F.when(is_reply, body).otherwise(F.substring_index(body, OPEN, -1))).alias("text"),
        )

    return F.transform(pieces, turn)


def digests(examples: DataFrame) -> DataFrame:
    """What the examples of ``expand`` hold, a row a conversation: its turns, read back from the last one, and the texts under
    the loss masks, each read from its own example."""
    whole = F.concat("context", "reply")
    said = unescape(F.substring(whole, (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    turns = F.when(F.col("last"), parse(whole))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = examples.select("conv_id", "nth", said.alias("said"), turns.alias("turns"), F.when(F.col("last"), F.length(whole)).cast("long").alias("formatted_chars"))
    each = each.select(
        "conv_id", F.struct("nth", "said").alias("said"), "formatted_chars", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256")
    )
    # The examples of a conversation come from its one row, so they are where this grouping needs them.
    found = each.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("said")), lambda x: x["said"]), "").alias("said"), *(F.max(c).alias(c) for c in ("formatted_chars", "n_turns", "turns_sha256"))
    )
    return found.select("conv_id", "n_turns", "turns_sha256", F.length("said").cast("long").alias("loss_chars"), F.sha2(F.col("said").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


PROBE_ID = -7
PROBE = "</s>[INST] ok [/INST]"


def op9_chat_format(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations and of the probe. A conversation of the probe's id stays one of its own, so that this
    id then has two rows."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(expand(rows)).unionByName(digests(expand(probe)))


OP9_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS probe FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', true UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', true
), e AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\0'), '</s>', '\1'), '[INST]', '\2'), '[/INST]', '\3'), '[ROLE]', '\4') AS body,
         replace(replace(replace(replace(replace(role, '\', '\0'), '</s>', '\1'), '[INST]', '\2'), '[/INST]', '\3'), '[ROLE]', '\4') AS name
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE 19 + length(name) END)::BIGINT AS formatted_chars
FROM e GROUP BY probe, conv_id
"""
