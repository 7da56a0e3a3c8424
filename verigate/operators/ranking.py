"""Candidates, attempts, judges, preference pairs and chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigate.functions.rates import clamped


def best_candidate(df: DataFrame, group: str, score: str, attempt: str, position: str) -> DataFrame:
    """The row with the best score of each group; ties go to the lowest attempt, then position; no score is -1."""
    order = F.struct((-F.coalesce(F.col(score), F.lit(-1.0))).alias("s"), F.col(attempt).alias("a"), F.col(position).alias("p"))
    return df.groupBy(group).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c != group]), order).alias("_r")).select(group, "_r.*")


def decisive_attempt(df: DataFrame, group: str, attempt: str, flag: str = "cleared") -> DataFrame:
    """The first attempt that cleared, else the last."""
    order = F.when(F.col(flag), F.struct(F.lit(0).alias("r"), F.col(attempt).alias("a"))).otherwise(F.struct(F.lit(1).alias("r"), (-F.col(attempt)).alias("a")))
    return df.groupBy(group).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c != group]), order).alias("_r")).select(group, "_r.*")


def preference_pairs(df: DataFrame, group: str, prompt: str, text: str, flag: str = "cleared") -> DataFrame:
    """Every cleared candidate of a group against every failed one. The product within a group is the result itself."""
    good = df.where(F.col(flag)).select(group, F.col(prompt).alias("prompt"), F.col(text).alias("chosen"))
    bad = df.where(~F.col(flag)).select(group, F.col(text).alias("rejected"))
    return good.join(bad, group)


def judged(text: Column | str) -> Column:
    """struct(accept, score, reason) from a judge's reply, with noise around its JSON; a reject where nothing parses."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    body = F.when(F.trim(t).rlike(r"(?s)^\{.*\}$"), F.trim(t)).otherwise(F.regexp_extract(t, r"(?s)\{.*\}", 0))
    ok = F.try_parse_json(body).isNotNull() & (body != "")
    accept = F.coalesce(F.lower(F.get_json_object(body, "$.accept")) == "true", F.lit(False))
    score = clamped(F.get_json_object(body, "$.score"), F.when(accept, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.struct((ok & accept).alias("accept"), F.when(ok, score).otherwise(F.lit(0.0)).alias("score"), F.when(ok, F.coalesce(F.get_json_object(body, "$.reason"), F.lit(""))).otherwise(F.concat(F.lit("unparseable: "), F.left(t, F.lit(200)))).alias("reason"))


def chat_messages(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """One array of (role, content) for each conversation, in the order of its turns."""
    own = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return df.groupBy(conversation).agg(F.transform(own, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))

