"""Chat formatting: preference pairs as one prompt and two masked completions.

The prompt of a pair is the longest common prefix of its two conversations: all turns before
the first at which they differ. It is rendered once; the turns from there on are the chosen
and the rejected completion. Each rendered turn is a row of two strings: `masked`, which
takes no part in the loss, and `target`, which does. Only what an assistant says in a
completion is a target; headers, other roles and the prompt are masked. A part's rendering is
the concatenation of masked and target in the order of turns, and prompt and completion
together are the rendering of the whole conversation.

Turns stay rows from end to end, and what both sides have is one row. No conversation is
gathered into one value, so one with a third of all turns is only many rows. The first
differences are found on digests of the turns, without their texts, as a minimum of one number
for each turn; they are written, as (pair, turn, common) rows. The texts are then shuffled once, to the
aggregate over (pair, turn, role, text) in which equal rows meet, and the rows of first differences are
broadcast to it; beyond `broadcast_rows` of them they are joined on (pair, turn), which spreads
a long conversation too.

Defined results: rows without a conversation or turn number are left out; repeated rows
count once; rows of one turn are compared as a set and rendered in the order of role and
text; null roles and texts are empty; a conversation that is a prefix of the other has no
completion; two equal conversations are a prompt alone; a pair of which one conversation is
missing gives nothing; an empty table gives an empty one. Very long texts stay whole. `<|` in
a text becomes `< |`, so that no text can end its turn. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.scratch import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
REPLY = "assistant"


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL AND turn IS NOT NULL")


def paired_turns(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, turn, role, text, in_chosen, in_rejected, swapped) of pairs (pair_id, chosen_id, rejected_id) of conversations; one may be in many pairs."""
    side = F.array(F.struct(F.lit(True).alias("chosen"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(False).alias("chosen"), F.col("rejected_id").alias("conv_id")))
    sides = pairs.select("pair_id", F.explode(side).alias("s")).select("pair_id", "s.chosen", "s.conv_id")
    rows = _turns(conversations).join(sides, "conv_id")
    return rows.select("pair_id", "turn", "role", "text", F.col("chosen").alias("in_chosen"), (~F.col("chosen")).alias("in_rejected"), F.lit(False).alias("swapped"))


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """paired_turns where no preference is stated: each conversation is preferred to itself with another's last reply.

    The pair has the conversation's id. The rejected side has all of its turns, but in the place
    of its last reply (the assistant's last turn) that of its neighbour: 2k and 2k + 1 are
    neighbours. Without a reply of both there is nothing to swap, and the two sides are equal.
    A row with `swapped` stands for all that the assistant says in that turn on the rejected side.
    """
    turns = _turns(conversations)
    replies = turns.where(F.col("role") == REPLY)
    own = replies.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(F.col("conv_id").alias("pair_id"), "turn", F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"))
    last = replies.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("reply"))
    swapped = own.join(last, "conv_id").select("pair_id", "turn", F.lit(REPLY).alias("role"), F.col("reply.text").alias("text"))
    swapped = Scratch(conversations.sparkSession, "chat").keep(swapped, "swapped")
    yes, no = F.lit(True), F.lit(False)
    rows = turns.withColumnRenamed("conv_id", "pair_id").select("pair_id", "turn", "role", "text", yes.alias("in_chosen"), yes.alias("in_rejected"), no.alias("swapped"))
    return rows.unionByName(swapped.withColumns({"in_chosen": no, "in_rejected": no, "swapped": yes}))


FLAGS = ("in_chosen", "in_rejected", "swapped")


def preference_segments(paired: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """(pair_id, part, turn, role, masked, target) of paired_turns, a row for each rendered turn."""

    def merged(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy("pair_id", "turn", *keys).agg(*[F.bool_or(f).alias(f) for f in FLAGS])

    digest = F.unhex(F.sha2(F.encode(F.concat("role", F.lit("\0"), "text"), "UTF-8"), 256))
    said = merged(paired.select("pair_id", "turn", digest.alias("digest"), (F.col("role") == REPLY).alias("reply"), *FLAGS), "digest", "reply")
    plain, swapped = F.col("in_chosen") & F.col("in_rejected"), F.col("in_chosen") & F.when(F.col("reply"), F.col("swapped")).otherwise(F.col("in_rejected"))
    flags = [F.bool_or(f).alias(f) for f in FLAGS]
    turns = said.groupBy("pair_id", "turn").agg(*flags, F.bool_and(plain).alias("plain"), F.bool_and(swapped).alias("same"))
    turns = turns.withColumn("same", F.when(F.col("swapped"), F.col("same")).otherwise(F.col("plain")))
    differ = turns.groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("turn"))).alias("first"), F.bool_or("in_chosen").alias("has_chosen"), F.bool_or(F.col("in_rejected") | F.col("swapped")).alias("has_rejected"))
    common = F.coalesce(F.col("turn") < F.col("first"), F.lit(True)).alias("common")
    placed = turns.join(differ.where("has_chosen AND has_rejected"), "pair_id").select("pair_id", "turn", F.col("swapped").alias("has_swap"), common)
    placed = Scratch(paired.sparkSession, "chat").keep(placed, "placed")
    few = placed.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = merged(paired, "role", "text").join(F.broadcast(placed) if few else placed, ["pair_id", "turn"])
    rejected = F.when(F.col("has_swap") & (F.col("role") == REPLY), F.col("swapped")).otherwise(F.col("in_rejected"))
    sides = F.filter(F.array(F.when(F.col("in_chosen"), "chosen"), F.when(rejected, "rejected")), lambda p: p.isNotNull())
    rows = rows.select("pair_id", F.explode(F.when(F.col("common"), F.array(F.lit("prompt"))).otherwise(sides)).alias("part"), "turn", "role", "text")
    safe_role, safe_text = (F.replace(F.col(c), F.lit("<|"), F.lit("< |")) for c in ("role", "text"))
    header, body = F.concat(F.lit(OPEN), safe_role, F.lit("\n")), F.concat(safe_text, F.lit(CLOSE))
    learned = (F.col("part") != "prompt") & (F.col("role") == REPLY)
    return rows.select("pair_id", "part", "turn", "role", F.when(learned, header).otherwise(F.concat(header, body)).alias("masked"), F.when(learned, body).otherwise("").alias("target"))
