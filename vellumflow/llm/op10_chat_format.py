"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes one example: all turns before it are context and only its reply is trainable.

Template, per turn: ``<|turn|>`` role ``<|text|>`` text ``<|end|>`` newline. Inside roles and texts a backslash is doubled
and ``<|`` becomes ``<\\|``, so no control string can occur there and the change can be undone exactly.

Defined cases
- null text or role: empty. Null conversation id: one conversation of its own. Null turn: before all numbers.
- turns with the same number: ordered by role, then text; repeated rows are repeated turns.
- turns after the last assistant turn, or a conversation without one: one closing example without trainable text.
- extra columns: ignored, whatever their names. Empty table: no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    # Doubled backslashes come in even runs; a single one between < and | is always the inserted one.
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(conversations: DataFrame, *, trainable_role: str = "assistant") -> DataFrame:
    """conv_id, example (0, 1, ...), formatted, loss_start, loss_length (0-based span in code points of ``formatted``).

    A conversation is one row of its turns, because an example holds all earlier turns anyway; rows of different
    conversations never meet. The one shuffle is on conv_id.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # collect_list keeps structs whose fields are null; array_sort puts null turns first within a struct comparison.
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END)).alias("piece"),
            (t["role"] == trainable_role).alias("target"),
            F.length(escape(t["text"])).alias("chars"),
        ),
    )
    chats = chats.select("conv_id", pieces.alias("pieces"))
    ends = F.filter(
        F.sequence(F.lit(1), F.size("pieces")),
        lambda i: F.element_at("pieces", i)["target"] | (i == F.size("pieces")),
    )
    examples = chats.select("conv_id", "pieces", F.posexplode(ends).alias("example", "upto"))
    last = F.element_at("pieces", F.col("upto"))
    formatted = F.array_join(F.transform(F.slice("pieces", 1, F.col("upto")), lambda p: p["piece"]), "")
    return examples.select(
        "conv_id",
        "example",
        formatted.alias("formatted"),
        last["target"].alias("has_target"),
        last["chars"].alias("chars"),
    ).select(
        "conv_id",
        "example",
        "formatted",
        (F.length("formatted") - len(END) - F.col("chars")).cast("long").alias("loss_start"),
        F.when(F.col("has_target"), F.col("chars")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted example."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, TEXT, 1)) + F.lit(len(TEXT) + 1))).alias("text"),
        ),
    )


def summarise(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say when read back."""
    reply = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))
    read = examples.select("conv_id", "example", "formatted", unescape(reply).alias("reply"))
    per = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_sort(F.collect_list(F.struct("example", "reply"))).alias("replies"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    per = per.select(
        "conv_id",
        read_turns(F.col("longest")).alias("turns"),
        F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("loss"),
        "formatted_chars",
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(c).cast("long").alias("conv_id"),
                        F.lit(n).cast("long").alias("turn"),
                        F.lit(role).alias("role"),
                        F.lit(text).alias("text"),
                    )
                    for c, n, role, text in PROBE
                )
            )
        ).alias("r")
    ).select("r.*")
    return summarise(format_chats(chats.unionByName(probe)))


# The digests follow from the turns alone; formatted_chars follows from the template above.
SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) p(conv_id, turn, role, text)
), sized AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS chars,
    row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS of_
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM sized
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY n), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR n = of_ THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
