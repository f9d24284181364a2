"""Which messages open a new topic: keywords compared with those before, in one batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import compact, jaccard, keywords
from tracewell.functions.vocabulary import STOP_WORDS
from tracewell.operators.topk import carried

# Shares of common keywords, seconds that a topic lasts, words that tell what a message is.
SAME, NEW, LASTS = 0.4, 0.25, 20 * 60
ACKNOWLEDGED = r"(?i)^(ok|okay|kk|yes|yep|nope|好的|收到|明白|知道了|行|好|嗯|哦|谢谢|thanks|thank you)[!,. ]*$"
CONTINUED = r"(?i)(continue|resume|pick up|follow up|handoff|what was i doing|current status|继续|接着|续上|上次|之前|刚才|交接|当前状态|我们做到哪了)"
STRUCTURAL = r"(?i)(architecture|flow|dependency|blast radius|impact|call graph|caller|callee|refactor|where is|which file|module|function|class|graph|架构|流程|依赖|影响|调用链|重构|模块|函数|类|在哪个文件|哪个文件|哪个模块)"
IDENTIFIER = r"([A-Za-z_][A-Za-z0-9_]{2,}|[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+)"


def trivial(message: Column, words: Column) -> Column:
    clean = F.lower(compact(F.coalesce(message, F.lit(""))))
    return (clean == "") | ((F.length(clean) <= 24) & clean.rlike(ACKNOWLEDGED)) | ((F.size(words) < 2) & (F.length(clean) < 12) & ~clean.rlike(CONTINUED))


def classify(messages: DataFrame, key: str, time: str, message: str, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """What each message is for its key (a workspace): adds keywords, overlap with the message before, and reason.

    time is in epoch seconds; the state of a workspace is its last message that is not trivial.
    """
    rows = messages.withColumn("keywords", keywords(F.coalesce(F.col(message), F.lit("")), stop))
    rows = rows.withColumn("_trivial", trivial(F.col(message), F.col("keywords")))
    said = F.when(~F.col("_trivial"), F.struct(F.col(time).alias("t"), F.col("keywords").alias("k")))
    rows = carried(rows, key, [time, message], said, "_state")
    overlap = F.when(F.col("_state").isNotNull(), jaccard(F.col("keywords"), F.col("_state.k"))).otherwise(0.0)
    recent = F.coalesce((F.col(time) - F.col("_state.t")) < LASTS, F.lit(False))
    text = F.lower(compact(F.coalesce(F.col(message), F.lit(""))))
    same = recent & (F.col("overlap") >= SAME)
    reason = (
        F.when(F.col("_trivial"), "trivial")
        .when(text.rlike(CONTINUED), "continuation")
        .when(text.rlike(STRUCTURAL), F.when(same, "same-topic").otherwise("structural"))
        .when(F.col("_state").isNull(), "cold-start")
        .when(same, "same-topic")
        .when(F.col(message).rlike(IDENTIFIER) | (F.col("overlap") <= NEW), "new-topic")
        .when(~recent, "stale-context")
        .otherwise("same-topic")
    )
    return rows.withColumn("overlap", F.round(overlap, 9)).withColumn("reason", reason).drop("_trivial", "_state")
