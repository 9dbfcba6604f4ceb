"""Text recognition over image regions: what is known, what is read once, who reads it, and what it costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.text import normalise_ocr, unreliable

VISION_BATCH, BUDGET, MOST_KEPT = 4, 8, 40_000


def page_key(digest: Column, layout: Column, lang: Column) -> Column:
    return F.concat_ws("|", F.lit("v3"), digest, layout, lang)


def group_key(members: Column) -> Column:
    return F.concat(F.lit("g3|"), F.array_join(F.array_sort(members), "+"))


def crop_scale(w: Column, h: Column) -> Column:
    side = F.least(w, h)
    return F.when(side < 48, 3).when(side < 120, 2).otherwise(1)


def crop_pad(w: Column, h: Column, grouped: Column) -> Column:
    return F.when(grouped, F.lit(1.0)).otherwise(F.greatest(F.lit(2.0), F.least(w, h) * 0.06))


def distinct_crops(regions: DataFrame) -> DataFrame:
    """One region of each (hash, box): crop and the number of regions that share it."""
    crop = F.concat_ws(":", "hash", F.array_join(F.transform("box", lambda v: v.cast("string")), ","))
    return regions.withColumn("crop", crop).groupBy("crop").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("shared"))


def worth_vision(kind: Column, engine: Column, text: Column, ink: Column, fallback: Column) -> Column:
    return F.coalesce(fallback | (kind == "art") | (engine == "vision") | (F.trim(F.coalesce(text, F.lit(""))) == "") | (ink >= 0.03), F.lit(True))


def arbitrated(read: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Regions and groups (id, kind, text, ink, grouped, engine, fallback) with text cleaned and source.

    source is `local` where the local reading is reliable, `vision` for the first `budget` of the others that
    are worth it (groups ahead, then most ink, then id), and `open` beyond the budget.
    """
    clean = read.withColumn("text", normalise_ocr(F.col("text"))).withColumn("reliable", ~unreliable(F.col("text"), F.col("ink")) & (F.col("engine") != "vision"))
    asks = ~F.col("reliable") & (F.col("grouped") | worth_vision(F.col("kind"), F.col("engine"), F.col("text"), F.col("ink"), F.col("fallback")))
    # The budget is one for the whole run: the queue is cut by a top-n before it is numbered.
    queue = clean.where(asks).orderBy(F.col("grouped").desc(), F.col("ink").desc(), "id").limit(max(0, budget)).select(F.col("id").alias("_id"))
    return clean.join(F.broadcast(queue), F.col("id") == F.col("_id"), "left").withColumn(
        "source", F.when(F.col("reliable"), "local").when(F.col("_id").isNotNull(), "vision").otherwise("open")
    ).drop("_id", "reliable")


def read_by_vision(queue: DataFrame, read: Callable[[list[tuple[str, bytes]]], list[str]], batch: int = VISION_BATCH) -> DataFrame:
    """(id, crop) with text from a vision service, in batches; a batch that fails has null texts."""

    def run(batches):
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch].copy()
                try:
                    got = read([(i, bytes(c)) for i, c in zip(part["id"], part["crop"], strict=True)])
                    part["text"] = got if len(got) == len(part) else None
                except Exception:  # noqa: BLE001 - any failure of a service leaves its batch unread
                    part["text"] = None
                yield part[["id", "text"]]

    return queue.select("id", "crop").mapInPandas(run, "id string, text string")


def planned(pages: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """pages (key, …) with known: whether the cache (key, at, done) has them finished."""
    have = cache.where(F.col("done")).select("key").distinct().withColumn("_have", F.lit(True))
    return pages.join(have, "key", "left").withColumn("known", F.coalesce("_have", F.lit(False)) & F.lit(not force)).drop("_have")


def kept_cache(cache: DataFrame, most: int = MOST_KEPT) -> DataFrame:
    """The newest rows of a cache, all in all."""
    return cache.orderBy(F.col("at").desc(), "key").limit(most)


def page_report(regions: DataFrame) -> DataFrame:
    done = F.col("source") != "open"
    return regions.groupBy("page").agg(F.count(F.lit(1)).alias("regions"), F.count_if(done).alias("read"), F.count_if(F.col("source") == "vision").alias("vision"), F.avg("ink").alias("ink"))


def run_summary(regions: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row over a whole run of arbitrated() regions: pages, regions, how each was read, mean ink; and groups, if given."""
    by = {name: F.count_if(F.col("source") == name).alias(name) for name in ("local", "vision", "open")}
    one = regions.agg(F.countDistinct("page").alias("pages"), F.count(F.lit(1)).alias("regions"), *by.values(), F.avg("ink").alias("ink"))
    return one if groups is None else one.withColumn("groups", groups.agg(F.count(F.lit(1))).scalar())


def erase_tasks(units: DataFrame) -> DataFrame:
    """(id, part, file): parts of a unit on other files than its own, to be wiped there."""
    return units.select("id", F.col("file").alias("own"), F.posexplode("parts").alias("part", "p")).where(F.col("p.file") != F.col("own")).select("id", "part", F.col("p.file").alias("file"), F.col("p.box").alias("box"))


def first_regions(regions: DataFrame, most: int = 60) -> DataFrame:
    """The largest regions of each page, numbered in reading order: rows from the top, right to left."""
    box = F.col("box")
    big = F.row_number().over(Window.partitionBy("page").orderBy((box[2] * box[3]).desc(), "id"))
    kept = regions.withColumn("_big", big).where(F.col("_big") <= most).drop("_big")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy(F.floor(box[1] / F.lit(40.0)), box[0].desc(), "id")) - 1)
