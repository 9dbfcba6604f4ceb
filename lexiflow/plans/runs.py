"""Queries over whole runs: translation with service and write-back, findings, recognition and its cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.extract.markup import is_content
from lexiflow.operators import quality, recognise, translate
from lexiflow.operators.groups import file_parts, numbered_name
from lexiflow.operators.translate import Term
from lexiflow.plans.registry import query

#: Terms of the runs: a plain one, one of another script, and regular expressions in list order.
TERMS = [Term("widget", "部件"), Term(r"(\w+) box$", "盒子 $1", regex=True), Term("红", "RED"), Term("盒子 (small|tiny)", "小盒", regex=True)]


def _entries(read) -> DataFrame:
    """Entries of part names: texts repeat, every seventh has nothing to translate."""
    source = F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("p_name"))
    return read("part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("context"), source.alias("source"))


_ENTRIES = "(SELECT p_partkey AS ord, 'p' || p_partkey AS id, p_brand AS context, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS source FROM part)"
_WIDGET = "regexp_replace(source, '(?i)\\bwidget\\b', '部件', 'g')"
_LOOKED = f"""(SELECT ord, id, context, source, {_WIDGET} AS target, CASE WHEN regexp_matches(source, '(?i)\\bwidget\\b') THEN 'glossary' WHEN NOT regexp_matches(source, '[A-Za-z]{{2}}') THEN 'skip' ELSE 'passthrough' END AS method FROM {_ENTRIES})"""


@query(
    """
SELECT p_partkey, CASE WHEN n LIKE '% box' THEN CASE WHEN n LIKE '%small box' THEN '小盒' ELSE regexp_replace(n, '(\\w+) box$', '盒子 \\1') END ELSE replace(n, 'widget', '部件') END AS target,
  CASE WHEN n LIKE '% box' OR n LIKE '%widget%' THEN 'glossary' ELSE 'passthrough' END AS method
FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'small box' WHEN p_partkey % 4 = 1 THEN 'big box' ELSE p_name END AS n FROM part)
WHERE n NOT LIKE '%红%'
"""
)
def q73_regular_terms(spark, read):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.lit("small box")).when(k == 1, F.lit("big box")).otherwise(F.col("p_name"))
    return translate.looked_up(read("part").select("p_partkey", name.alias("source")), TERMS).select("p_partkey", "target", "method")


@query(
    f"""
SELECT ord, id, context, source, CASE WHEN c.t IS NOT NULL THEN c.t ELSE target END AS target, CASE WHEN c.t IS NOT NULL THEN 'cache' ELSE method END AS method
FROM (SELECT * FROM {_LOOKED} l WHERE l.ord NOT IN (SELECT doc_id FROM labels) ORDER BY ord LIMIT 1500 OFFSET 20) LEFT JOIN (SELECT n_name AS s, 'N' AS t FROM nation) c ON c.s = source
"""
)
def q74_pending_run(spark, read):
    """A run over pending entries without a service: what is done is left out, then offset and limit in the order of ord."""
    done = read("labels").select(F.concat(F.lit("p"), "doc_id").alias("id"))
    cache = read("nation").select(F.col("n_name").alias("source"), F.lit("N").alias("target"))
    return translate.translated(_entries(read), [Term("widget", "部件")], cache, done=done, limit=1500, offset=20)


def _service(pairs: list[tuple[str, str]]) -> list[str]:
    """A service that answers in capitals with the context, and has no answer for names that begin with b."""
    return ["" if s.startswith("b") else f"{c}:{s.upper()}" for c, s in pairs]


_SERVED = f"""(SELECT ord, id, context, source, CASE WHEN method <> 'passthrough' THEN target WHEN starts_with(source, 'b') THEN source ELSE context || ':' || upper(source) END AS target,
  CASE WHEN method = 'passthrough' THEN 'api' ELSE method END AS method FROM {_LOOKED})"""


@query(_SERVED.removeprefix("(").removesuffix(")"))
def q75_service_run(spark, read):
    """With a service: it sees the first of equal texts, the others take its answer."""
    return translate.translated(_entries(read), [Term("widget", "部件")], translate=_service, limit=None)


@query(
    f"""
SELECT source, target FROM (SELECT source, arg_max(target, ord) AS target FROM {_SERVED} WHERE method = 'api' GROUP BY source)
UNION ALL SELECT n_name AS source, 'N' AS target FROM nation
"""
)
def q76_cache_written_back(spark, read):
    results = translate.translated(_entries(read), [Term("widget", "部件")], translate=_service, limit=None)
    return translate.cached(read("nation").select(F.col("n_name").alias("source"), F.lit("N").alias("target")), results)


@query(f"SELECT ord, id, context, source, source AS target, 'passthrough' AS method FROM {_ENTRIES} WHERE false")
def q77_nothing_pending(spark, read):
    """Where all is done a run does nothing."""
    entries = _entries(read)
    return translate.translated(entries, [Term("widget", "部件")], done=entries.select("id"))


@query(
    f"""
SELECT ord, id, context, source, CASE WHEN NOT regexp_matches(source, '[A-Za-z]{{2}}') THEN source ELSE CASE WHEN starts_with(source, 'b') THEN source ELSE context || ':' || upper(source) END END AS target,
  CASE WHEN regexp_matches(source, '[A-Za-z]{{2}}') THEN 'api' ELSE 'skip' END AS method
FROM (SELECT * FROM {_ENTRIES} ORDER BY ord LIMIT 700)
"""
)
def q78_forced_run(spark, read):
    """force goes round what is done, cache and glossary, but not round the skip rule."""
    entries = _entries(read)
    return translate.translated(entries, [Term("widget", "部件")], done=entries.select("id"), translate=_service, limit=700, force=True)


_WARNED = """(SELECT *, list_filter([CASE WHEN starts_with(source, ' ') <> starts_with(target, ' ') THEN 'leading blank' END,
  CASE WHEN length(source) >= 8 AND method = 'glossary' AND length(target) / length(source) > 3.5 THEN 'too long' END,
  CASE WHEN method NOT IN ('passthrough', 'skip', 'api') AND regexp_matches(target, '[A-Za-z]{3,}') THEN 'left over' END], lambda x: x IS NOT NULL) AS w
  FROM (SELECT ord, id, source, CASE WHEN ord % 9 = 0 THEN ' ' || target WHEN ord % 10 = 0 THEN repeat('长', 100) ELSE target END AS target, method FROM {0}))""".replace("{0}", _LOOKED)


def _marked(read) -> DataFrame:
    found = translate.with_skips(translate.looked_up(_entries(read), [Term("widget", "部件")]))
    changed = F.when(F.col("ord") % 9 == 0, F.concat(F.lit(" "), "target")).when(F.col("ord") % 10 == 0, F.repeat(F.lit("长"), 100)).otherwise(F.col("target"))
    return found.withColumn("target", changed)


@query(f"SELECT ord, id, array_to_string(w, ',') AS warnings FROM {_WARNED} WHERE len(w) > 0 ORDER BY ord LIMIT 300")
def q79_first_issues(spark, read):
    return quality.issues(_marked(read)).select("ord", "id", F.array_join("warnings", ",").alias("warnings"))


@query(f"SELECT method, count(*) AS n, count(*) FILTER (len(w) > 0) AS warned FROM {_WARNED} GROUP BY method")
def q80_run_summary(spark, read):
    return translate.summary(_marked(read))


_REGIONS = """(SELECT *, row_number() OVER (ORDER BY CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END, value DESC, CAST(event_id AS VARCHAR)) AS r FROM events WHERE value > 50)"""


@query(
    f"""
SELECT count(DISTINCT event_type) AS pages, count(*) AS regions, count(*) FILTER (value <= 50) AS local, (SELECT count(*) FROM {_REGIONS} WHERE r <= 8) AS vision, (SELECT count(*) FROM {_REGIONS} WHERE r > 8) AS open,
  round(avg(value), 6) AS ink, (SELECT count(*) FROM region) AS groups FROM events
"""
)
def q81_recognition_summary(spark, read):
    e = read("events")
    regions = e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("page"), F.when(F.col("value") > 50, F.lit("?")).otherwise(F.lit("text here")).alias("text"), F.lit("text").alias("kind"),
        F.col("value").alias("ink"), (F.col("event_id") % 10 == 0).alias("grouped"), F.lit("local").alias("engine"), F.lit(False).alias("fallback"),
    )
    got = recognise.run_summary(recognise.arbitrated(regions), read("region"))
    return got.withColumn("ink", F.round("ink", 6))


@query("SELECT event_id AS key, value AS at FROM events ORDER BY value DESC, event_id LIMIT 40000")
def q82_newest_of_cache(spark, read):
    return recognise.kept_cache(read("events").select(F.col("event_id").alias("key"), F.col("value").alias("at")))


@query("SELECT p.page_id, p.page_id IN (SELECT page_id FROM pages WHERE page_id % 3 = 0 AND page_id % 2 = 0) AS known, false AS forced FROM pages p")
def q83_known_pages(spark, read):
    """What the cache has finished is known; what it has begun only, or under force, is not."""
    pages = read("pages").select("page_id", F.concat(F.lit("k"), "page_id").alias("key"))
    cache = pages.where("page_id % 3 = 0").select("key", F.lit(1).alias("at"), (F.col("page_id") % 2 == 0).alias("done"))
    forced = recognise.planned(pages, cache, force=True).select("page_id", F.col("known").alias("forced"))
    return recognise.planned(pages, cache).select("page_id", "known").join(forced, "page_id")


@query(
    """
SELECT page_id, 'read ' || page_id AS text FROM pages WHERE page_id % 5 <> 0
UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 5 = 0
"""
)
def q84_vision_batches(spark, read):
    """Readings of a vision service; a batch that fails has none."""

    def seen(batch: list[tuple[str, bytes]]) -> list[str]:
        if any(int(i) % 5 == 0 for i, _ in batch):
            raise TimeoutError
        return [c.decode() for _, c in batch]

    queue = read("pages").select(F.col("page_id").cast("string").alias("id"), F.encode(F.concat(F.lit("read "), "page_id"), "UTF-8").alias("crop"))
    return recognise.read_by_vision(queue, seen, batch=1).select(F.col("id").cast("long").alias("page_id"), "text")


_NAMES = ["btn(3)", "btn_04", "btn-1", "btn 2", "level2", "bg"]


@query(
    f"""
SELECT page_id, 'ui/x' AS folder, CASE WHEN page_id % 6 < 4 THEN 'btn' END AS stem, [3, 4, 1, 2, NULL, NULL][page_id % 6 + 1] AS number, ({_NAMES})[page_id % 6 + 1] AS name FROM pages
"""
)
def q85_numbered_names(spark, read):
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % 6).cast("int"))
    folder, base = file_parts(F.concat(F.lit("ui\\x/"), name, F.lit(".png")))
    stem, number = numbered_name(base)
    return read("pages").select("page_id", folder.alias("folder"), stem.alias("stem"), number.alias("number"), base.alias("name"))


@query("SELECT n_nationkey, ['text/html', 'application/xhtml+xml', 'application/x-dtbncx+xml', 'image/png', 'text/xml'][n_nationkey % 5 + 1] AS kind, n_nationkey % 5 IN (0, 1, 4) AS content FROM nation")
def q86_content_types(spark, read):
    kinds = ("text/html", "application/xhtml+xml", "application/x-dtbncx+xml", "image/png", "text/xml")
    rows = [(i, k, is_content(k)) for i, k in enumerate(kinds)]
    known = spark.createDataFrame(rows, "k int, kind string, content boolean")
    return read("nation").join(F.broadcast(known), F.col("n_nationkey") % 5 == F.col("k")).select("n_nationkey", "kind", "content")
