"""Request tables for the text and image services; calling them is not part of this library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import dealt_anew
from ..functions.text import strip_space

# Token limits of a request and the largest body a server takes.
DEFAULT_TOKENS, MOST_TOKENS = 4000, 8000
MAX_BODY = 25 * 1024 * 1024


def token_limit(asked: Column) -> Column:
    """The asked number, 4000 if there is none, and never more than 8000; negatives stay."""
    number = strip_space(asked.cast("string")).try_cast("double")
    number = F.when((number == 0) | F.isnan(number), None).otherwise(number)
    return F.least(F.coalesce(number, F.lit(DEFAULT_TOKENS)), F.lit(MOST_TOKENS))


def build_chat_requests(
    turns: DataFrame,
    limits: DataFrame,
    key: str = "conv_id",
    order: Sequence[str] = ("turn",),
    max_body: int = MAX_BODY,
) -> dict[str, DataFrame]:
    """``requests``: one row per conversation with its messages in order and ``max_tokens``.

    A request is sent as one body, so a conversation whose messages exceed ``max_body`` bytes can
    never be one; its turns are returned whole, still as rows, in ``oversize``. The size is summed
    before anything is gathered, so no task holds more than one permitted body per row.
    ``limits`` (key, max_tokens) lists all asked conversations; those without messages are
    ``empty``.
    """
    size = F.octet_length("role") + F.octet_length("text")
    sizes = turns.groupBy(key).agg(F.sum(size.cast("long")).alias("_bytes"))
    large = sizes.where(F.col("_bytes") > max_body).select(key)
    fitting = turns.join(dealt_anew(large, key), key, "left_anti")
    message = F.struct(*order, "role", F.col("text").alias("content"))
    gathered = fitting.groupBy(key).agg(F.array_sort(F.collect_list(message)).alias("_m"))
    messages = F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    asked = limits.select(key, token_limit(F.col("max_tokens")).alias("max_tokens"))
    return {
        "requests": gathered.join(asked, key, "left").select(
            key,
            F.coalesce("max_tokens", F.lit(float(DEFAULT_TOKENS))).alias("max_tokens"),
            messages.alias("messages"),
        ),
        "oversize": turns.join(dealt_anew(large, key), key, "left_semi"),
        "empty": limits.join(turns.select(key).distinct(), key, "left_anti"),
    }


def summarise_conversations(
    turns: DataFrame, limits: DataFrame, key: str = "conv_id", order: Sequence[str] = ("turn",), max_body: int = MAX_BODY
) -> DataFrame:
    """Messages, roles, digest of the texts and ``max_tokens`` of every conversation, oversize ones included.

    MD5 needs the texts in order, so an oversize conversation is gathered as one row for it; the
    JVM holds 2 GB in one value, and the query fails beyond that instead of leaving a row out.
    """
    built = build_chat_requests(turns, limits, key, order, max_body)
    message = F.struct(*order, "role", F.col("text").alias("content"))
    oversize = built["oversize"].groupBy(key).agg(F.array_sort(F.collect_list(message)).alias("messages"))
    asked = limits.select(key, token_limit(F.col("max_tokens")).alias("max_tokens"))
    tokens = F.coalesce("max_tokens", F.lit(float(DEFAULT_TOKENS))).alias("max_tokens")

    def summary(rows: DataFrame) -> DataFrame:
        return rows.select(
            key,
            F.size("messages").alias("messages"),
            F.array_join("messages.role", ",").alias("roles"),
            F.md5(F.array_join("messages.content", "\n")).alias("digest"),
            tokens,
        )

    return summary(built["requests"]).unionByName(summary(oversize.join(asked, key, "left")))


def build_image_requests(df: DataFrame) -> DataFrame:
    """Rows with prompt, mediaType and imageData as one user message of two content blocks.

    Rows that lack one of the three are dropped as invalid, as the handler refuses them.
    """
    valid = F.lit(True)
    for field in ("prompt", "mediaType", "imageData"):
        valid = valid & F.coalesce(F.col(field) != "", F.lit(False))
    text = F.lit(None).cast("string")
    image_source = F.struct(
        F.lit("base64").alias("type"),
        F.col("mediaType").alias("media_type"),
        F.col("imageData").alias("data"),
    )
    image = F.struct(F.lit("image").alias("type"), image_source.alias("source"), text.alias("text"))
    no_source = F.lit(None).cast("struct<type:string,media_type:string,data:string>")
    words = F.struct(F.lit("text").alias("type"), no_source.alias("source"), F.col("prompt").alias("text"))
    message = F.struct(F.lit("user").alias("role"), F.array(image, words).alias("content"))
    others = [c for c in df.columns if c not in ("prompt", "mediaType", "imageData", "max_tokens")]
    return df.where(valid).select(
        *others, token_limit(F.col("max_tokens")).alias("max_tokens"), F.array(message).alias("messages")
    )
