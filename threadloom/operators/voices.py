"""How lines speak: summaries of the user, persons of a profile and its drift, sentences that carry feeling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import WHITE, safe_text

#: How summaries of the user begin, pronouns of the three persons, what is no pronoun, and what gives a sentence points.
SUMMARY = "用户是|用户希望|用户喜欢|用户偏好|用户曾|用户最近|用户不会|用户更|用户对|用户与AI|用户沟通风格|用户曾在"
PERSONS, NO_PRONOUN = {"first": "我", "second": "[你您]", "third": "[她他它]"}, "其他|其它"
PERSON_POINTS, MARK_POINTS, FEELING_POINTS, TONE_POINTS, ADVICE_POINTS = 2.0, 2.0, 4.0, 1.5, -4.0
PERSON, MARK = "[我你他她们]", "[！!？?…]"
FEELING = "喜欢|想|怕|爱|抱|靠近|记得|不想|真的|不是|可是|如果|怎么|为什么|委屈|难过|开心|温柔|难受|想你|舍不得"
TONE, ADVICE = "哈哈|嘿|呀|啦|嘛|咯|呢", "(?i)请参考|作为AI|保持理智|以下是|建议你"
SHORTEST, LONGEST, MOST, PER_POINT, LENGTH_POINTS = 16, 180, 8, 32, 6


def user_summary(role: Column, text: Column) -> Column:
    """Lines of an assistant that sum the user up: they begin with the user, are no questions and have 180 letters at most."""
    t = safe_text(text)
    return (role == "assistant") & t.startswith("用户") & (F.length(t) <= LONGEST) & ~t.rlike("[？?]$") & t.rlike(SUMMARY)


def perspective(text: Column, own_name: Column, selves: str = "") -> Column:
    """(first, second, third, own_name, risk, flags): how often each person is named in a profile; two persons are a middle risk, three a high one. ``selves``: further words of the first person, joined by ``|``."""
    t = F.regexp_replace(safe_text(text), NO_PRONOUN, "")
    name = safe_text(own_name)
    n = {k: F.regexp_count(t, F.lit(f"{p}|{selves}" if k == "first" and selves else p)) for k, p in PERSONS.items()}
    own = F.when(name == "", 0).otherwise(F.size(F.split(t, F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1"))) - 1)
    active = sum(((c > 0).cast("int") for c in n.values()), F.lit(0))
    risk = F.when(active >= 3, "high").when(active == 2, "medium").otherwise("low")
    flags = F.array_compact(F.array(F.when(active >= 2, "mixed_pronouns"), F.when(n["third"] > 0, "third_person_present"), F.when(n["second"] > 0, "dialogue_perspective_present"), F.when((own == 0) & (name != ""), "self_name_missing")))
    return F.struct(*(c.cast("long").alias(k) for k, c in n.items()), own.cast("long").alias("own_name"), risk.alias("risk"), flags.alias("flags"))


def feeling_points(c: Column) -> Column:
    t = safe_text(c)
    by = lambda pattern, points: F.when(t.rlike(pattern), points).otherwise(0.0)
    return F.least(F.length(t) / PER_POINT, F.lit(float(LENGTH_POINTS))) + by(PERSON, PERSON_POINTS) + by(MARK, MARK_POINTS) + by(FEELING, FEELING_POINTS) + by(TONE, TONE_POINTS) + by(ADVICE, ADVICE_POINTS)


def feeling_sentences(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, rank, sentence, points): the eight sentences of each text (16 to 180 letters, once whatever its blanks) that carry most feeling, equal ones in order."""
    blocks = F.split(F.coalesce(text, F.lit("")), r"\n{2,}")
    units = F.transform(F.flatten(F.transform(blocks, lambda b: F.split(b, "(?<=[。！？!?…])"))), safe_text)
    each = rows.select(id_, F.posexplode(units).alias("at", "sentence")).where(F.length("sentence").between(SHORTEST, LONGEST))
    once = each.groupBy(id_, F.regexp_replace("sentence", f"[{WHITE}]+", "").alias("key")).agg(F.min_by("sentence", "at").alias("sentence"), F.min("at").alias("at"))
    points = once.withColumn("points", F.round(feeling_points(F.col("sentence")), 6))
    rank = F.row_number().over(Window.partitionBy(id_).orderBy(F.desc("points"), "at"))
    return points.withColumn("rank", rank).where(F.col("rank") <= MOST).select(id_, "rank", "sentence", "points")
