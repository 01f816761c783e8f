"""Chat formatting by event-sourced reconstruction (operator 6).

A log row is (conv_id, seq, kind, turn, role, payload), in any order. Kinds:

- open: message `turn` begins, by `role`, empty (again, if it had begun before);
- delta: payload is added to the message;
- regenerate: the message is emptied, and later messages that had begun are dropped;
- edit: the message becomes payload, and later messages that had begun are dropped.

Folding is by the last of everything: a message's text is what follows its last open, regenerate or edit; it is dropped if
its last open comes before an edit or regeneration of an earlier message. These are maxima, so one shuffle by conversation is
all it takes: messages, conversations and their order are aggregated in that partitioning, on the JVM.

Rendering: <|role|>, a line feed, the text, <|end|>, messages separated by line feeds; a marker's beginning within a text is
parted by a blank, so that no text can feign a marker.

The table `conversations` holds final messages; to_log() writes the log that would have led to them: texts in deltas of
DELTA characters, drafts that are regenerated, and user messages edited after a reply had begun.

Defined results: rows without conv_id, seq, turn or kind, and of other kinds, are left out; a row delivered twice counts once;
of different rows with one seq that of the lesser kind, then payload, comes first; a null payload is empty; a null role is
"unknown"; deltas of a message that was never opened are dropped with it; an empty log gives no rows; columns beside the six
are not looked at; texts are put together whole, however long (one message's deltas are one row's array, as its text is one
value). In to_log(), of rows with the same conversation and turn the first by role and text counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import pick, read_table

DELTA = 40
#: Numbers kept for one message's events.
BLOCK = 10_000_000


def to_log(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    c = pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    c = c.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.role", F.coalesce("m.text", F.lit("")).alias("text"))
    n = F.ceil(F.length("text") / delta).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("delta").alias("kind"), F.col("turn").alias("turn"), F.col("role").alias("role"), F.substring(F.col("text"), (i - 1) * delta + 1, F.lit(delta)).alias("payload")))).otherwise(F.array())

    def one(kind: str, turn=None, role=None, payload=None):
        return F.array(F.struct(F.lit(kind).alias("kind"), (F.col("turn") if turn is None else turn).alias("turn"), (F.col("role") if role is None else F.lit(role)).alias("role"), (F.lit("") if payload is None else payload).alias("payload")))

    draft = F.concat(one("open"), one("delta", payload=F.reverse(F.substring("text", 1, 80))), one("regenerate"), parts)
    reply = F.col("turn") + 1
    edited = F.concat(one("open"), one("delta", payload=F.upper("text")), one("open", reply, "assistant"), one("delta", reply, "assistant", F.lit("...")), one("edit", payload=F.col("text")))
    events = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), draft).when((F.col("role") == "user") & (F.col("turn") % 4 == 2), edited).otherwise(F.concat(one("open"), parts))
    e = c.select("conv_id", F.col("turn").alias("t"), F.posexplode(events).alias("i", "e"))
    return e.select("conv_id", (F.col("t") * BLOCK + F.col("i")).alias("seq"), "e.kind", "e.turn", "e.role", "e.payload")


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the messages that stand at the log's end."""
    e = pick(log, "conv_id", "seq", "kind", "turn", "role", "payload").filter("conv_id IS NOT NULL AND seq IS NOT NULL AND turn IS NOT NULL AND kind IN ('open', 'delta', 'regenerate', 'edit')")
    e = e.withColumn("payload", F.when(F.col("kind").isin("delta", "edit"), F.coalesce("payload", F.lit(""))).otherwise("")).repartition("conv_id")
    at = F.struct("seq", "kind", "payload")
    m = e.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("kind") != "delta", at)).alias("reset"),
        F.max(F.when(F.col("kind") == "open", F.struct("seq", "role"))).alias("open"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("cut"),
        F.collect_set(at).alias("events"),
    )
    earlier = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    m = m.withColumn("cut_before", F.max("cut").over(earlier)).filter("open IS NOT NULL AND (cut_before IS NULL OR open.seq > cut_before)")
    kept = F.array_sort(F.filter("events", lambda x: x >= F.col("reset")))
    return m.select("conv_id", "turn", F.coalesce("open.role", F.lit("unknown")).alias("role"), F.array_join(F.transform(kept, lambda x: x["payload"]), "").alias("text"))


def chats(log: DataFrame) -> DataFrame:
    """(conv_id, n_messages, chat), a row a conversation that has messages left."""
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("<|end|>"))
    c = messages(log).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return c.select("conv_id", "n_messages", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("chat"))


def op6_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(to_log(read_table(spark, sf_dir, "conversations")))


ORACLE = """
SELECT conv_id, count(*) AS n_messages, string_agg('<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || replace(coalesce(m.text, ''), '<|', '< |') || '<|end|>', chr(10) ORDER BY turn) AS chat
FROM (SELECT conv_id, turn, min({'role': role, 'text': text}) AS m FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn)
GROUP BY conv_id
"""
