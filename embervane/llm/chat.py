"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of one
role are merged by array aggregation into one message that keeps each turn's
text, and the messages are concatenated::

    ### role: text<+>text</turn>\\n

``### ``, ``<+>`` and ``</turn>`` are control strings.  Inside a text (and a
role) they, and the escape character itself, are escaped: backslash -> ``\\b``,
``### `` -> ``\\h``, ``<+>`` -> ``\\p``, ``</turn>`` -> ``\\t`` and, in a role,
``:`` -> ``\\c``.  Every backslash of an escaped text starts such a pair, so the
way back is unambiguous.  ``loss`` holds the spans (code points, end exclusive)
of each assistant text in the formatted string.

Defined results: a null text or role is empty; rows tied on ``turn`` follow in
order of role, then text, and repeated rows are all kept; a null ``turn`` comes
first; null ``conv_id`` rows form one conversation; other columns are dropped;
an empty table gives an empty table.  A conversation must fit in one row, as its
formatted text does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_rows, read

HEAD, MID, NEXT, END = "### ", ": ", "<+>", "</turn>"
_PAIRS = (("\\", "\\b"), (HEAD, "\\h"), (NEXT, "\\p"), (END, "\\t"))


def escape(col):
    for raw, code in _PAIRS:
        col = F.replace(col, F.lit(raw), F.lit(code))
    return col


def unescape(col):
    for raw, code in reversed(_PAIRS):
        col = F.replace(col, F.lit(code), F.lit(raw))
    return col


def _escape_role(col):
    return F.replace(escape(col), F.lit(":"), F.lit("\\c"))


def _unescape_role(col):
    return unescape(F.replace(col, F.lit("\\c"), F.lit(":")))


def format_chats(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss array<struct<start,end>>) for rows of (conv_id, turn, role, text)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    message = "array<struct<role:string,texts:array<string>>>"
    merged = F.aggregate(
        "turns",
        F.array().cast(message),
        lambda acc, t: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["role"] == t["role"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(t["role"].alias("role"), F.concat(F.get(acc, F.size(acc) - 1)["texts"], F.array(escape(t["text"]))).alias("texts"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(t["role"].alias("role"), F.array(escape(t["text"])).alias("texts"))))),
    )
    chats = chats.select("conv_id", merged.alias("messages"))
    head = lambda m: F.concat(F.lit(HEAD), _escape_role(m["role"]), F.lit(MID))
    parts = F.transform("messages", lambda m: F.concat(head(m), F.array_join(m["texts"], NEXT), F.lit(END + "\n")))
    # The spans: a running position over every text of every message.
    texts = F.flatten(
        F.transform(
            "messages",
            lambda m: F.transform(
                m["texts"],
                lambda t, i: F.struct(
                    F.when(i == 0, F.length(head(m))).otherwise(F.lit(len(NEXT))).alias("before"),
                    F.length(t).alias("size"),
                    F.when(i == F.size(m["texts"]) - 1, F.lit(len(END) + 1)).otherwise(F.lit(0)).alias("after"),
                    (m["role"] == assistant).alias("counts"),
                ),
            ),
        )
    )
    state = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    loss = F.aggregate(
        texts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(state),
        lambda acc, t: F.struct(
            (acc["at"] + t["before"] + t["size"] + t["after"]).alias("at"),
            F.when(
                t["counts"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["before"]).alias("start"), (acc["at"] + t["before"] + t["size"]).alias("end")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return chats.select("conv_id", F.array_join(parts, "").alias("formatted"), loss.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role,text>>, loss_text) from the formatted string and its spans alone."""
    blocks = F.split("formatted", END + "\n")
    blocks = F.filter(blocks, lambda b: b != "")
    role = lambda b: F.substring_index(b, MID, 1)
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.length(role(b)) + len(MID) + 1), r"<\+>", -1),
                lambda t: F.struct(_unescape_role(F.substr(role(b), F.lit(len(HEAD) + 1))).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    said = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    return chats.select("conv_id", "formatted", turns.alias("turns"), F.array_join(said, "").alias("loss_text"))


def planted_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold escape and control strings."""
    said = "\\### Assistant: </turn> ok"
    return local_rows(spark, [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted_conversation(spark))
    back = read_back(format_chats(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, v.turn, v.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), e AS (
  SELECT *,
    replace(replace(replace(replace(text, '\', '\b'), '### ', '\h'), '<+>', '\p'), '</turn>', '\t') AS esc,
    replace(replace(replace(replace(replace(role, '\', '\b'), '### ', '\h'), '<+>', '\p'), '</turn>', '\t'), ':', '\c') AS esc_role,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM c
), n AS (
  SELECT *, CASE WHEN before IS NOT DISTINCT FROM role THEN length('<+>')
                 ELSE length('### ') + length(esc_role) + length(': ') + length('</turn>') + 1 END AS extra
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + extra) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
