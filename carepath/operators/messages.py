"""Conversation messages as batch jobs.

Messages come in long form: (conv_id, turn, role, content, tool_calls).  Where a
list per conversation is wanted it is built in parts of bounded length, so a
conversation with very many messages never has to fit into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carepath.functions.prefix import running_totals
from carepath.functions.text import record_id

PART_SIZE = 1000
BUCKET_TURNS = 16384


def append_messages(messages: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Messages gathered in turn order: (conv_id, part_no, n_messages, messages).

    Parts are cut by the number of messages before them, so each but a conversation's last has ``part_size``,
    whatever the turns are: null turns come first, messages of the same turn go in order of their digest.  Messages
    equal in everything are counted before they are numbered; numbering reads (turn, digest, count) only, in
    slices (``running_totals``), and no list holds more than one part.
    """
    fields = [c for c in ("role", "content", "tool_calls") if c in messages.columns]
    keyed = messages.select(
        "conv_id", "turn", F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).alias("tie"), F.struct(*fields).alias("m")
    )
    key = ["conv_id", "turn", "tie"]
    counts = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    numbered = running_totals(counts, ["conv_id"], ["turn", "tie"], {"first": F.col("n")}).select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("tie").alias("_tie"), "first", "n"
    )
    # one of each kind of equal messages, in the partitions that the join needs anyway
    kinds = keyed.groupBy(*key).agg(F.first("m").alias("m"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("tie") == F.col("_tie"))
    until = F.col("first") + F.col("n")
    part = lambda place: F.floor(place / part_size)
    from_here = F.greatest(F.col("first"), F.col("part_no") * part_size)
    here = (F.least(until, (F.col("part_no") + 1) * part_size) - from_here).cast("int")
    dealt = (
        kinds.join(numbered, same)
        .select("conv_id", "m", "first", "n", F.explode(F.sequence(part(F.col("first")), part(until - 1))).alias("part_no"))
        .select("conv_id", "part_no", F.struct(from_here.alias("place"), F.array_repeat("m", here).alias("ms")).alias("t"))
    )

    def by_place(a, b):
        return F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)

    return (
        dealt.groupBy("conv_id", "part_no")
        .agg(F.flatten(F.array_sort(F.collect_list("t"), by_place)["ms"]).alias("messages"))
        .select("conv_id", "part_no", F.size("messages").alias("n_messages"), "messages")
    )


def prepend_system(conversations: DataFrame, prompt: str | None) -> DataFrame:
    """The system message before the first part of each conversation; unchanged without a prompt.

    The first part's number is found from the numbers alone and joined back on conversation and part.
    """
    if not prompt:
        return conversations
    element = conversations.schema["messages"].dataType.elementType
    values = {"role": F.lit("system"), "content": F.lit(prompt)}
    system = F.struct(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in element.fields]
    )
    first, out = F.lit(True), conversations
    if "part_no" in conversations.columns:  # one row per part: the smallest number is the first
        firsts = conversations.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("part_no").alias("_part"))
        out = out.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part_no") == F.col("_part")), "left")
        first = F.col("_part").isNotNull()
    with_system = F.when(first, F.concat(F.array(system), F.col("messages"))).otherwise(F.col("messages"))
    out = out.withColumn("messages", with_system).select(*conversations.columns)
    if "n_messages" in out.columns:
        out = out.withColumn("n_messages", F.size("messages"))
    return out


def message_chunks(conversations: DataFrame) -> DataFrame:
    """One delta per message, numbered from 0 in order; conversations without messages give none.

    A part starts where the parts before it end: the parts' sizes are added up in slices (``running_totals``) and
    the starts joined back on conversation and part.  Tool calls go along where the messages have them.
    """
    full = conversations.where(F.size("messages") > 0)
    sizes = full.select("conv_id", "part_no", F.size("messages").alias("size"))
    starts = running_totals(sizes, ["conv_id"], ["part_no"], {"start": F.col("size")}).select(
        F.col("conv_id").alias("_conv"), F.col("part_no").alias("_part"), "start"
    )
    fields = conversations.schema["messages"].dataType.elementType.fieldNames()
    calls = [F.col("m.tool_calls").alias("tool_calls")] if "tool_calls" in fields else []
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part_no") == F.col("_part"))
    return (
        full.join(starts, same)
        .select("conv_id", "start", F.posexplode("messages").alias("pos", "m"))
        .select(
            "conv_id",
            (F.col("start") + F.col("pos")).cast("bigint").alias("chunk_no"),
            F.col("m.role").alias("role"),
            F.col("m.content").alias("delta"),
            *calls,
        )
    )


def conversation_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, dataset_record_id): one id per conversation, from its text.

    A conversation of one part has the md5 of its text, a longer one the md5 of its
    parts' md5s in order.
    """
    parts = conversations.select("conv_id", F.struct("part_no", record_id(F.col("messages")).alias("id")).alias("p"))
    gathered = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    whole = F.md5(F.array_join(F.col("ps.id"), ""))
    return gathered.select(
        "conv_id", F.when(F.size("ps") == 1, F.col("ps.id")[0]).otherwise(whole).alias("dataset_record_id")
    )


def tool_call_split(messages: DataFrame) -> DataFrame:
    """Per conversation: "continue" when its last message has tool calls, else "end".

    max_by over (flag, turn) combines in the map tasks; the texts are never moved.
    """
    has_calls = F.coalesce(F.size("tool_calls") > 0, F.lit(False))
    return (
        messages.select("conv_id", "turn", has_calls.alias("has_calls"))
        .groupBy("conv_id")
        .agg(F.max("turn").alias("last_turn"), F.max_by("has_calls", "turn").alias("has_calls"))
        .select("conv_id", "last_turn", F.when(F.col("has_calls"), "continue").otherwise("end").alias("next_step"))
    )


def request_response_pairs(messages: DataFrame, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """Each assistant message with the last user message before it (NULL where there is none).

    Conversations are cut in buckets of turns, so a huge one is spread over many
    tasks.  An answer with no user message earlier in its own bucket takes the last
    one of the nearest bucket before: found from one turn number per bucket, whose
    text is then fetched for those few.
    """
    m = messages.select("conv_id", "turn", "role", "content").withColumn(
        "bucket", F.floor(F.col("turn") / bucket_turns)
    )
    is_user = F.col("role") == "user"
    in_bucket = Window.partitionBy("conv_id", "bucket").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(is_user, F.struct("turn", "content")), ignorenulls=True).over(in_bucket)
    answers = m.withColumn("near", asked).where(F.col("role") == "assistant")

    per_bucket = m.groupBy("conv_id", "bucket").agg(F.max(F.when(is_user, F.col("turn"))).alias("last_turn"))
    earlier = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_bucket.withColumn("turn", F.max("last_turn").over(earlier))
        .where(F.col("turn").isNotNull())
        .select("conv_id", "bucket", "turn")
        .join(m.where(is_user).select("conv_id", "turn", "content"), ["conv_id", "turn"])
        .select("conv_id", "bucket", F.struct("turn", "content").alias("far"))
    )
    request = F.coalesce("near", "far")
    return answers.join(carried, ["conv_id", "bucket"], "left").select(
        "conv_id",
        "turn",
        request["turn"].alias("request_turn"),
        request["content"].alias("request"),
        F.col("content").alias("response"),
    )
