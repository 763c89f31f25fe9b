"""Conversation memory: stored rows, windows and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.questions import wants_debugging
from siltstone.operators.ordering import with_position
from siltstone.operators.vectors import nearest
from siltstone.session import durable

# Size of the window, hits from memory and from code, and the
# confidence below which code is searched.
WINDOW = 5
MEMORY_HITS = 5
CODE_HITS = 3
CONFIDENCE = 0.5
NO_HISTORY = "No relevant chat history found."
NO_CONTEXT = "No external context found."


def memory_rows(conversations: DataFrame) -> DataFrame:
    """One row per turn, its text prefixed by the role."""
    return conversations.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat("role", F.lit(": "), "text").alias("document"),
        "role",
    )


def context_rows(contexts: DataFrame) -> DataFrame:
    """One row per retrieved document (``conv_id, turn, pos, text``), without prefix."""
    return contexts.select(
        F.concat_ws(":", *[F.col(c).cast("string") for c in ("conv_id", "turn", "pos")]).alias("id"),
        F.col("text").alias("document"),
        F.lit("context").alias("role"),
    )


def exchanges(conversations: DataFrame) -> DataFrame:
    """User turns together with the assistant turn that follows.

    Turns of other roles are passed over; a user turn without a reply is no
    exchange.  Turns meet by their position in the whole table, so a very long
    conversation is split like any other rows.
    """
    spoken = conversations.where(F.col("role").isin("user", "assistant"))
    turns = with_position(spoken.select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user"), "position")
    replies = turns.where("role = 'assistant'").select(
        "conv_id", F.col("text").alias("bot"), (F.col("position") - 1).alias("position")
    )
    return users.join(replies, ["conv_id", "position"]).select("conv_id", "turn", "user", "bot")


def last_exchanges(conversations: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per exchange the text of up to ``size`` exchanges before it.

    Exchanges routed to debugging have no window and enter none; a null text
    is an empty one.  Each exchange is sent to the next ``size`` positions, so every group holds at
    most ``size + 1`` rows however long the conversation is.
    """
    pairs = exchanges(conversations)
    pairs = pairs.fillna("", ["user", "bot"])
    rendered = F.concat(F.lit("user:"), "user", F.lit("\nbot:"), "bot")
    kept = with_position(
        pairs.select(
            "conv_id", "turn", wants_debugging(F.col("user")).alias("debug"), rendered.alias("text")
        ),
        "debug",
        "conv_id",
        "turn",
        name="n",
    )
    plain = kept.where("NOT debug")
    own = plain.select("conv_id", "n", "turn", F.lit(None).cast("struct<n:bigint,text:string>").alias("past"))
    past = plain.select(
        "conv_id",
        F.explode(F.sequence(F.col("n") + 1, F.col("n") + size)).alias("n"),
        F.lit(None).cast("bigint").alias("turn"),
        F.struct("n", "text").alias("past"),
    )
    window = F.sort_array(F.collect_list("past"))
    return (
        own.unionByName(past)
        .groupBy("conv_id", "n")
        .agg(F.max("turn").alias("turn"), window.alias("window"))
        .where("turn IS NOT NULL")
        .select(
            "conv_id",
            "turn",
            F.size("window").cast("bigint").alias("exchanges"),
            F.array_join(F.transform("window", lambda w: w["text"]), "\n").alias("window_text"),
        )
    )


def memory_confidence(
    queries: DataFrame, memory: DataFrame, k: int = MEMORY_HITS, *, vectors: DataFrame | None = None
) -> DataFrame:
    """Hits in memory per query and 1 - best distance; 0 when memory is empty.

    ``vectors`` holds the vectors of sides that have their ids, as in ``nearest``.
    """
    hits = nearest(queries, memory, k, vectors=vectors)
    best = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("distance").alias("best"))
    return (
        queries.select("query_id")
        .join(best, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("hits", F.lit(0)).alias("hits"),
            F.coalesce(1 - F.col("best"), F.lit(0.0)).alias("confidence"),
        )
    )


def gated_code_hits(
    queries: DataFrame,
    confidences: DataFrame,
    code: DataFrame,
    k: int = CODE_HITS,
    threshold: float = CONFIDENCE,
    *,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Code hits for the queries that memory answers too poorly, none for others."""
    # Written, as a search reads its queries more than once and they stand behind another search.
    unsure = durable(queries.join(confidences.where(F.col("confidence") < threshold), "query_id", "left_semi"))
    return nearest(unsure, code, k, vectors=vectors)


def context_text(queries: DataFrame, hits: DataFrame, default: str = NO_CONTEXT) -> DataFrame:
    """Documents of each query's hits as one text, in rank order.

    ``hits`` has at most k rows per query, with ``rank`` and ``document``.
    """
    joined = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "document"))).alias("h"))
    text = F.array_join(F.transform("h", lambda x: x["document"]), "\n")
    return (
        queries.select("query_id")
        .join(joined, "query_id", "left")
        .select("query_id", F.coalesce(text, F.lit(default)).alias("text"))
    )
