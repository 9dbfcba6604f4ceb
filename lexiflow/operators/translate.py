"""Cache, glossary and service look-ups over entries, and the table of translations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.text import skipped

#: Terms up to which a glossary is a literal of the plan.
FOLD_TERMS = 500
LATIN = r"^[A-Za-z0-9][A-Za-z0-9 _'\-]*$"


@dataclass(frozen=True)
class Term:
    source: str
    target: str
    regex: bool = False
    note: str = ""


# The seed glossary.
SEED = (
    Term("Potion", "药水"),
    Term("Hi-Potion", "高级药水"),
    Term("Ether", "以太"),
    Term("Phoenix Down", "不死鸟之尾"),
    Term("Sword", "剑"),
    Term("Shield", "盾"),
    Term("Armor", "护甲"),
    Term("Weapon", "武器"),
    Term("Item", "物品"),
    Term("Skill", "技能"),
    Term("Magic", "魔法"),
    Term("Attack", "攻击"),
    Term("Defense", "防御"),
    Term("HP", "生命值"),
    Term("MP", "魔法值"),
    Term("EXP", "经验值"),
    Term("Level", "等级"),
    Term("Gold", "金币"),
    Term("Save", "保存"),
    Term("Load", "读取"),
    Term("New Game", "新游戏"),
    Term("Continue", "继续游戏"),
    Term("Options", "设置"),
    Term("Quit", "退出"),
    Term("Yes", "是"),
    Term("No", "否"),
    Term("Chapter", "章节"),
    Term("Quest", "任务"),
    Term("Monster", "怪物"),
    Term("Boss", "首领"),
    Term("Victory", "胜利"),
    Term("Defeat", "战败"),
    Term("Experience", "经验"),
    Term("Inventory", "背包"),
    Term("Equipment", "装备"),
    Term("Shop", "商店"),
    Term("Buy", "购买"),
    Term("Sell", "出售"),
    Term("Menu", "菜单"),
    Term("Status", "状态"),
    Term("Party", "队伍"),
    Term("Dungeon", "地牢"),
    Term("Village", "村庄"),
    Term("Town", "城镇"),
    Term("Castle", "城堡"),
    Term("Forest", "森林"),
    Term("Mountain", "山脉"),
    Term("River", "河流"),
    Term("Cave", "洞穴"),
    Term("Tower", "高塔"),
    Term("Ruins", "遗迹"),
    Term("Treasure", "宝箱"),
    Term("Key", "钥匙"),
    Term("Door", "门"),
    Term("Chest", "宝箱"),
    Term("Game Over", "游戏结束"),
    Term("Battle", "战斗"),
    Term("Run", "逃跑"),
    Term("Fire", "火焰"),
    Term("Ice", "冰霜"),
    Term("Thunder", "雷电"),
    Term("Heal", "治疗"),
    Term("Poison", "中毒"),
    Term("Cure", "解毒"),
)


def plain_targets(terms: list[Term]) -> dict[str, str]:
    """Targets of the plain terms; the first of equal sources counts."""
    return {t.source: t.target for t in reversed(terms) if not t.regex}


def exact(text: Column, terms: list[Term]) -> Column:
    """Target of the first plain term that is the whole text; null if none is."""
    plain = plain_targets(terms)
    if not plain:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in plain.items() for x in kv)), text)


def steps(terms: list[Term]) -> list[tuple[str, str, str, bool]]:
    """(pattern, replacement, what a text must hold in lower case for the pattern to match, whether it may give what was there) in the order of folding.

    Plain terms come first, the longest ones ahead and in list order among equals; those of Latin letters
    match whole words in any case, others exactly. Regular expressions follow in list order.
    """
    out = []
    for t in sorted((t for t in terms if not t.regex), key=lambda t: -len(t.source)):
        word = re.match(LATIN, t.source)
        # What stands before a word is looked at behind it, so that most places are left after one letter.
        around = rf"(?i)\Q{t.source}\E(?<![A-Za-z0-9_](?s:.{{{len(t.source)}}}))(?![A-Za-z0-9_])"
        pattern = around if word else rf"\Q{t.source}\E"
        # What is not Latin is looked for as it is: letters may have no single form in lower case.
        same = t.source.lower() == t.target.lower()
        out.append((pattern, t.target.replace("\\", "\\\\").replace("$", "\\$"), t.source.lower() if word else "", same))
    return out + [(t.source, t.target, "", True) for t in terms if t.regex]


def folded(text: Column, terms: list[Term], listed: Column | None = None) -> Column:
    """struct(t, hit): text after all steps(), each seeing what the earlier ones made.

    A pattern is tried only where the text holds its words, so that most terms cost one search. listed: the
    steps as one array, if they are too many for a literal.
    """
    made = steps(terms)
    if not made:
        return F.struct(text.alias("t"), F.lit(False).alias("hit"))
    if listed is None:
        listed = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(r).alias("r"), F.lit(n).alias("n"), F.lit(q).alias("q")) for p, r, n, q in made))

    def state(t: Column, low: Column, hit: Column) -> Column:
        return F.struct(t.alias("t"), low.alias("low"), hit.alias("hit"))

    def step(s: Column, x: Column) -> Column:
        # An array of one value, so that the value has a name and is made once.
        new = F.transform(
            F.array(F.regexp_replace(s.t, x.p, x.r)),
            lambda v: F.when(v != s.t, state(v, F.lower(v), F.lit(True))).otherwise(state(s.t, s.low, s.hit | (x.q & F.regexp_like(s.t, x.p)))),
        )
        return F.when(s.low.contains(x.n), F.get(new, F.lit(0))).otherwise(s)

    start = state(text, F.lower(text), F.lit(False))
    return F.aggregate(listed, start, step, lambda s: F.struct(s.t.alias("t"), s.hit.alias("hit")))


def listed_steps(terms: list[Term]) -> Column:
    """The steps as one literal text that is read once, for glossaries of any length."""
    rows = json.dumps([dict(zip("prnq", x, strict=True)) for x in steps(terms)])
    return F.from_json(F.lit(rows), "array<struct<p:string,r:string,n:string,q:boolean>>")


def looked_up(entries: DataFrame, terms: list[Term], cache: DataFrame | None = None) -> DataFrame:
    """entries (…, source) with target and method: cache, glossary or passthrough.

    cache: (source, target), one row a source; empty and null targets are misses. It is joined by source, so
    that it may be of any size. A glossary of up to FOLD_TERMS terms is part of the plan; a longer one is a
    table, joined for whole texts and read once for the fold.
    """
    base = entries
    if cache is not None:
        hits = cache.where(F.coalesce(F.col("target"), F.lit("")) != "").select(F.col("source").alias("_s"), F.col("target").alias("_cached"))
        base = base.join(hits, F.col("source") == F.col("_s"), "left").drop("_s")
    else:
        base = base.withColumn("_cached", F.lit(None).cast("string"))
    listed = None
    if len(terms) <= FOLD_TERMS:
        base = base.withColumn("_exact", exact(F.col("source"), terms))
    else:
        listed = listed_steps(terms)
        whole = entries.sparkSession.createDataFrame(list(plain_targets(terms).items()) or [("", None)], "_s string, _exact string")
        base = base.join(whole, F.col("source") == F.col("_s"), "left").drop("_s")
    fold = base.withColumn("_fold", F.when(F.col("_cached").isNull() & F.col("_exact").isNull(), folded(F.col("source"), terms, listed)))
    return (
        fold.withColumn("target", F.coalesce("_cached", "_exact", "_fold.t"))
        .withColumn("method", F.when(F.col("_cached").isNotNull(), "cache").when(F.col("_exact").isNotNull() | F.col("_fold.hit"), "glossary").otherwise("passthrough"))
        .drop("_cached", "_exact", "_fold")
    )


def with_skips(results: DataFrame) -> DataFrame:
    """Untouched texts that need no translation are `skip`."""
    return results.withColumn("method", F.when((F.col("method") == "passthrough") & skipped(F.col("source")), "skip").otherwise(F.col("method")))


def firsts(pending: DataFrame, *keys: str, answer: Column | None = None) -> DataFrame:
    """pending with first: whether a row is the first of its keys in the order of ord; with answer, a column made once for equal keys.

    The smallest ord is aggregated before the join back, so that a frequent text makes no long window. The rows
    are moved once by their keys, and the keys once.
    """
    least = pending.groupBy(*keys).agg(F.min("ord").alias("_least"))
    if answer is not None:
        least = least.withColumn("answer", answer)
    named = least.select(*(F.col(k).alias(f"_{k}") for k in keys), "_least", *(["answer"] if answer is not None else []))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return pending.join(named, on).withColumn("first", F.col("ord") == F.col("_least")).drop("_least", *(f"_{k}" for k in keys))


def served(pending: DataFrame, translate: Callable[[list[tuple[str, str]]], list[str]], chunk: int = 40) -> DataFrame:
    """pending (ord, context, source) with target and method from a service, chunk by chunk.

    A chunk that fails, or comes back with another number of texts, is passed through; an empty answer
    leaves the source as it is.
    """

    def run(batches):
        for pdf in batches:
            for k in range(0, len(pdf), chunk):
                part = pdf.iloc[k : k + chunk].copy()
                try:
                    got = translate(list(zip(part["context"], part["source"], strict=True)))
                    if len(got) != len(part):
                        raise ValueError("another number of texts")
                    part["target"] = [g or s for g, s in zip(got, part["source"], strict=True)]
                    part["method"] = "api"
                except Exception:  # noqa: BLE001 - any failure of a service leaves its chunk as it was
                    part["target"], part["method"] = part["source"], "passthrough"
                yield part

    return pending.select("ord", "context", "source").mapInPandas(run, "ord long, context string, source string, target string, method string")


def translated(
    entries: DataFrame, terms: list[Term], cache: DataFrame | None = None, translate=None, done: DataFrame | None = None, limit: int | None = 500, offset: int = 0, force: bool = False
) -> DataFrame:
    """One run over the pending entries (ord, id, context, source): ord, id, context, source, target, method.

    done (id) is left out unless force. Offset, then limit, in the order of ord; without a limit all that is
    pending. force goes round cache and glossary but not round the skip rule. Of texts with equal source and
    context the service sees the first.
    """
    pool = entries if force or done is None else entries.join(done.select("id").distinct(), "id", "left_anti")
    batch = pool if limit is None and not offset else pool.orderBy("ord").offset(offset)
    batch = (batch if limit is None else batch.limit(max(limit, 1))).select("ord", "id", "context", "source")
    found = with_skips(looked_up(batch, [] if force else terms, None if force else cache))
    if translate is None:
        return found
    open_ = firsts(found.where(F.col("method") == "passthrough"), "source", "context")
    answers = served(open_.where("first"), translate).select(F.col("source").alias("_s"), F.col("context").alias("_c"), F.col("target").alias("_t"), F.col("method").alias("_m"))
    joined = found.join(answers, (F.col("method") == "passthrough") & (F.col("source") == F.col("_s")) & F.col("context").eqNullSafe(F.col("_c")), "left")
    return joined.select("ord", "id", "context", "source", F.coalesce("_t", "target").alias("target"), F.coalesce("_m", "method").alias("method"))


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def cached(cache: DataFrame, results: DataFrame) -> DataFrame:
    """cache with what a service has answered; of several answers for a source that of the last ord."""
    new = results.where(F.col("method") == "api").groupBy("source").agg(F.max_by("target", "ord").alias("target"))
    return upserted(cache, new, "source")


def method_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def summary(results: DataFrame) -> DataFrame:
    """method, n and warned: results of each method, and those of them with a finding."""
    from lexiflow.operators.quality import checked

    return checked(results).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("warnings") > 0).alias("warned"))


def glossary_added(terms: list[Term], new: Term) -> list[Term]:
    """terms with new in the place of the one of the same source and sort, or at the end."""
    same = [i for i, t in enumerate(terms) if (t.source, t.regex) == (new.source, new.regex)]
    return [new if i in same else t for i, t in enumerate(terms)] if same else [*terms, new]


def glossary_removed(terms: list[Term], source: str, regex: bool = False) -> list[Term]:
    return [t for t in terms if (t.source, t.regex) != (source, regex)]


def progress(entries: DataFrame, results: DataFrame) -> DataFrame:
    """One row: total, done and remaining entries."""
    done = results.select("id").distinct().withColumn("_d", F.lit(1))
    return entries.join(done, "id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("_d").alias("done"), (F.count(F.lit(1)) - F.count("_d")).alias("remaining"))


def ranked(df: DataFrame, n: int, partition: list[str], *order: Column) -> DataFrame:
    """The first n rows of each partition in a given order: a budget."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("rank") <= n)
