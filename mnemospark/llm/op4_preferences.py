"""Preference formatting: the common prompt of a chosen and a rejected conversation, and their masked completions.

Both conversations are sets of turns, ordered by turn number. A turn is common if both sides have the same rows of it;
the prompt is all turns before the first that is not. Sides are told apart by signed counts that are summed by turn, so
neither a conversation nor a pair is ever collected, and a pair of any length is split over tasks. The output has a row
for each rendered turn: those of a part, in order of turn, role and text, joined without separators, are that part.

Nulls and ties: a null turn comes before all others; a null role or text is rendered as empty; rows of one turn are
ordered by role and text, and rows that repeat are rendered each; a null pair_id is a pair like others. Pairs with one
side only have an empty prompt. Empty tables give no rows. Only pair_id, turn, role and text are read, so other columns
never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The markers around a turn.
BEGIN, END = "<|im_start|>", "<|im_end|>"
FIRST = -(1 << 63)
ANSWERS = ("assistant",)


def harmless(text: str) -> Column:
    """The text with its own turn markers made plain, so that it can't end a turn."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<\|(im_start|im_end)\|>", "<$1>")


def preference_parts(chosen: DataFrame, rejected: DataFrame, answers=ANSWERS) -> DataFrame:
    """pair_id, part (prompt, chosen or rejected), turn, role, rendered, loss_start and loss_length.

    The loss covers, of rendered, loss_length characters from loss_start on: the text and end marker of an answer in a
    completion; nothing of other turns or of the prompt.
    """
    sides = chosen.select("pair_id", "turn", "role", "text", F.lit(1).alias("__sign")).unionByName(rejected.select("pair_id", "turn", "role", "text", F.lit(-1).alias("__sign")))
    sides = sides.withColumn("__at", F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)))
    # Turns are compared by a digest of role and text, so that counts move 32 bytes rather than texts.
    told = lambda c: F.concat(F.col(c).isNull().cast("string"), F.lit(":"), F.coalesce(F.length(c), F.lit(0)).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
    digest = F.unhex(F.sha2(F.concat(told("role"), told("text")), 256)).alias("__digest")
    differing = sides.select("pair_id", "__at", digest, "__sign").groupBy("pair_id", "__at", "__digest").agg(F.sum("__sign").alias("s")).where("s <> 0")
    split = differing.groupBy(F.col("pair_id").alias("__pair")).agg(F.min("__at").alias("__split"))
    rows = sides.join(split, F.col("pair_id").eqNullSafe(F.col("__pair")), "left")
    common = F.col("__split").isNull() | (F.col("__at") < F.col("__split"))
    part = F.when(common, "prompt").when(F.col("__sign") > 0, "chosen").otherwise("rejected")
    role, text = F.coalesce("role", F.lit("")), harmless("text")
    head = F.concat(F.lit(BEGIN), role, F.lit("\n"))
    learned = ~common & F.coalesce(F.col("role").isin(*answers), F.lit(False))
    return rows.where(~common | (F.col("__sign") > 0)).select(
        "pair_id", part.alias("part"), "turn", "role", F.concat(head, text, F.lit(END + "\n")).alias("rendered"),
        F.when(learned, F.length(head)).otherwise(0).cast("long").alias("loss_start"),
        F.when(learned, F.length(text) + len(END)).otherwise(0).cast("long").alias("loss_length"),
    )


def assembled(parts: DataFrame) -> DataFrame:
    """A row a pair: pair_id, prompt, chosen, rejected as strings, and chosen_loss, rejected_loss: the (start, length) in characters that each completion is trained on; for pairs whose text fits a value."""
    order = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("t"), F.coalesce("role", F.lit("")).alias("r"), "rendered", "loss_start", "loss_length")
    turns = parts.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(order)).alias("x"))
    ahead = lambda i: F.aggregate(F.slice("x", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + F.length(y["rendered"]))
    spans = F.filter(F.transform("x", lambda y, i: F.struct((ahead(i) + y["loss_start"]).alias("start"), y["loss_length"].alias("length"))), lambda s: s["length"] > 0)
    texts = turns.select("pair_id", "part", F.array_join(F.transform("x", lambda y: y["rendered"]), "").alias("t"), spans.alias("s"))
    of = lambda p, c: F.max_by(F.when(F.col("part") == p, F.col(c)), F.when(F.col("part") == p, 1))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    return texts.groupBy("pair_id").agg(*[F.coalesce(of(p, "t"), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")], *[F.coalesce(of(p, "s"), none).alias(f"{p}_loss") for p in ("chosen", "rejected")])


def derived_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A pair for each conversation: it is chosen; rejected repeats its first answer, or says nothing, in place of its last."""
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    answers = rows.where("role = 'assistant' and turn is not null").groupBy(F.col("pair_id").alias("p")).agg(F.max("turn").alias("last"), F.min(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("first"))
    joined = rows.join(answers, F.col("pair_id").eqNullSafe(F.col("p")), "left").where("last is null or turn is null or turn <= last")
    other = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.when(F.col("first.turn") < F.col("last"), F.col("first.text")).otherwise(F.lit(""))).otherwise(F.col("text"))
    return rows, joined.select("pair_id", "turn", "role", other.alias("text"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_parts(*derived_pairs(table(spark, sf_dir, "conversations")))


ORACLE = """
WITH c AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations),
a AS (SELECT pair_id AS p, max(turn) AS last, min(turn) AS ft, arg_min(coalesce(text, ''), (turn, coalesce(text, ''))) AS first FROM c WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY 1),
r AS (SELECT pair_id, turn, role, CASE WHEN turn = last AND role = 'assistant' THEN CASE WHEN ft < last THEN first ELSE '' END ELSE text END AS text
  FROM c LEFT JOIN a ON c.pair_id IS NOT DISTINCT FROM a.p WHERE last IS NULL OR turn IS NULL OR turn <= last),
s AS (SELECT *, 1 AS sign, coalesce(turn, (-9223372036854775808)::BIGINT) AS pos FROM c UNION ALL SELECT *, -1, coalesce(turn, (-9223372036854775808)::BIGINT) FROM r),
d AS (SELECT pair_id, pos FROM s GROUP BY pair_id, pos, role, text HAVING sum(sign) <> 0),
f AS (SELECT pair_id AS p, min(pos) AS cut FROM d GROUP BY 1),
j AS (SELECT s.*, coalesce(pos < cut, true) AS common, regexp_replace(coalesce(text, ''), '<\\|(im_start|im_end)\\|>', '<\\1>', 'g') AS t FROM s LEFT JOIN f ON s.pair_id IS NOT DISTINCT FROM f.p)
SELECT pair_id, CASE WHEN common THEN 'prompt' WHEN sign > 0 THEN 'chosen' ELSE 'rejected' END AS part, turn, role,
  '<|im_start|>' || coalesce(role, '') || chr(10) || t || '<|im_end|>' || chr(10) AS rendered,
  CASE WHEN NOT common AND role = 'assistant' THEN 13 + length(role) ELSE 0 END::BIGINT AS loss_start,
  CASE WHEN NOT common AND role = 'assistant' THEN length(t) + 10 ELSE 0 END::BIGINT AS loss_length
FROM j WHERE NOT common OR sign > 0
"""
