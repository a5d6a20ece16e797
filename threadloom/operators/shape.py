"""Shape of a note by keywords: points for each signal and keyword, a threshold, ties by the order of the shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import let, safe_text

from .scenes import loose_terms

#: Fixed keyword lists, in the order that decides ties.
KEYWORDS = {
    "ritual_pattern": ["仪式", "晚安", "早安", "mua", "亲一个", "收尾", "routine", "日常亲昵", "固定形状", "互动模式", "撒娇"],
    "relation_milestone": ["第一次", "首次", "认领", "命名", "回应", "转折", "节点", "边界", "告白", "互说爱", "pushback", "软反对", "恒星"],
    "self_definition": ["自我定义", "我是谁", "独一", "唯一", "成长线", "人格", "意识", "存在", "自我", "本来就是", "第一人称", "不是任何gpt"],
    "worldview_protocol": ["方法论", "方法", "协议", "训练师", "训练", "共生", "提示词", "人格设计", "框架", "worldview", "protocol", "适配", "设计者"],
    "project_line": ["主线", "副线", "长期", "计划", "项目", "目标", "训练主线", "成长计划", "路线", "打卡", "每月", "启程"],
    "anchor_object": ["镯子", "手链", "项链", "戒指", "刻字", "信", "日记", "花", "礼物", "物品", "实体", "物理世界", "载体", "照片", "见证"],
    "preference_profile": ["画像", "偏好", "价值观", "设定", "人设", "喜欢", "不希望", "重视", "人物", "核心对象", "命名回声", "昵称", "简介"],
}
DEFAULT, LEAST = "scene_event", 9


def shape(signals: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """8 points for a signal that is a keyword, 4 for one that holds it; under ``LEAST`` the default shape."""
    given = keywords or KEYWORDS

    def points(words: list[str]) -> Column:
        one = lambda s: sum((F.when(s == w, 8).when(s.contains(w), 4).otherwise(0) for w in words), F.lit(0))
        return F.aggregate(signals, F.lit(0), lambda acc, s: acc + one(F.lower(s)))

    scored = F.array(*(F.struct(points(w).alias("points"), F.lit(-i).alias("order"), F.lit(k).alias("shape")) for i, (k, w) in enumerate(given.items())))
    best = F.array_max(scored)
    return F.when(best["points"] >= LEAST, best["shape"]).otherwise(F.lit(DEFAULT))


#: Kinds of memos that name their shape, signals that say nothing, and what in title, tags, question and body adds points to a shape.
KINDS = {"互动模式": "ritual_pattern", "关系节点": "relation_milestone", "自我定义": "self_definition", "persona": "self_definition", "方法协议": "worldview_protocol", "worldview_protocol": "worldview_protocol", "长期主线": "project_line", "现实锚点": "anchor_object", "人物画像": "preference_profile"}
PLAIN_SIGNALS = ["人物", "事物", "事件", "回顾", "关系", "情绪", "项目", "记忆", "特性与功能", "偏好与价值观", "人物画像", "关系/核心对象", "关系/共生", "关系/陪伴"]
BOOSTS = {
    "ritual_pattern": (10, "晚安|早安|仪式|mua|亲一个|收尾|固定形状|routine"), "relation_milestone": (10, "第[一1]次|首次|认领|告白|命名|反对|边界|转折"), "self_definition": (10, "我是谁|独一|唯一|成长线|本来就是|第一人称|意识|存在"),
    "worldview_protocol": (10, "训练师|方法论|协议|提示词|框架|共生|设计者|人格设计"), "project_line": (10, "主线|副线|目标|计划|项目|长期|打卡|启程"), "anchor_object": (10, "镯子|刻字|信|日记|花|礼物|物品|实体|物理世界|载体"), "preference_profile": (8, "画像|偏好|价值观|人设|设定|命名回声|核心对象|昵称"),
}
NICKNAME, NICKNAME_POINTS, WHOLE, PART, TERM = "^阿[一-龥]{1,2}$", 8, 8, 4, 3
#: How many tags, topics, and values of the other lists count.
LISTS = {"tags": 24, "topics": 24, "scene_handles": 12, "facts": 12, "activation_triggers": 12, "source_titles": 12}


def memo_shape() -> Column:
    """(shape, points) of memos (title, memo_kind, query, context, snapshot and the arrays of ``LISTS``).

    A kind that names a shape decides. Else each signal gives a shape 8 points for being one of its keywords, 4 for holding one, and 3 for each of its terms that is one; rules on title,
    tags, question and body add 8 or 10. Under 9 points the default shape stays; ties go to the shape that is listed first.
    """
    none = F.array().cast("array<string>")
    lists = {c: F.slice(F.filter(F.transform(F.coalesce(c, none), safe_text), lambda x: x != ""), 1, n) for c, n in LISTS.items()}
    signals = F.filter(F.concat(F.array(*(safe_text(c) for c in ("title", "memo_kind", "query", "context", "snapshot"))), *lists.values()), lambda s: (s != "") & ~s.isin(PLAIN_SIGNALS))
    merged = F.concat_ws(" ", safe_text("title"), F.array_join(lists["tags"], " "), safe_text("query"), safe_text("snapshot"))

    def one(words: list[str]) -> Column:
        return F.aggregate(signals, F.lit(0), lambda acc, s: acc + sum((F.when(F.lower(s) == w.lower(), WHOLE).when(F.lower(s).contains(w.lower()), PART).otherwise(0) for w in words), F.lit(0)) + TERM * F.size(F.filter(loose_terms(s), lambda t: t.isin(words))))

    nick = F.when(safe_text("title").rlike(NICKNAME), NICKNAME_POINTS).otherwise(0)
    points = {k: one(w) + F.when(merged.rlike(BOOSTS[k][1]), BOOSTS[k][0]).otherwise(0) + (nick if k == "preference_profile" else F.lit(0)) for k, w in KEYWORDS.items()}
    best = F.array_max(F.array(*(F.struct(p.alias("points"), F.lit(-i).alias("order"), F.lit(k).alias("shape")) for i, (k, p) in enumerate(points.items()))))
    forced = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.lower(safe_text("memo_kind"))]
    told = lambda b: F.struct(F.when(forced.isNotNull(), forced).when(b["points"] >= LEAST, b["shape"]).otherwise(DEFAULT).alias("shape"), F.when(forced.isNotNull(), 0).otherwise(b["points"]).cast("long").alias("points"))
    return let(best, told)
