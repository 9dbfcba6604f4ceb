"""The query catalogue: the relational operators over the driver tables, each with the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.extract import plain, rows
from lexiflow.extract.parse import html_entries, pruned, replaced_by_file
from lexiflow.extract.structured import json_entries
from lexiflow.functions import geometry, text, timecode
from lexiflow.operators import export, groups, ledger, quality, recognise
from lexiflow.operators.translate import SEED, Term, exact, firsts, looked_up, method_counts, progress, ranked, upserted, with_skips
from lexiflow.plans.registry import query
from lexiflow.session import dealt, spread
from lexiflow.sources import files

#: Terms of the catalogue: words of part names and of documents, one of which holds another.
TERMS = [
    Term("red", "红"), Term("blue", "蓝"), Term("green", "绿"), Term("steel", "钢铁"), Term("small box", "小盒"), Term("box", "盒子"),
    Term("the", "这"), Term("and", "和"), Term("that is", "即是"), Term("de la", "的"), Term("Part", "部件"),
]


def _sql_fold(column: str, terms: list[Term]) -> str:
    """Nested whole-word replacements, longest terms innermost; \\b is ASCII in RE2."""
    out = column
    for t in sorted(terms, key=lambda t: -len(t.source)):
        out = f"regexp_replace({out}, '(?i)\\b{t.source}\\b', '{t.target}', 'g')"
    return out


def _sql_hit(column: str, terms: list[Term]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '(?i)\\b{t.source}\\b')" for t in terms) + ")"


_EXACT = "CASE " + " ".join(f"WHEN {{0}} = '{t.source}' THEN '{t.target}'" for t in TERMS) + " END"
_LINES = "(SELECT doc_id, source AS src, lang, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS raw FROM (SELECT doc_id, source, lang, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents))"
_STRIP = "regexp_replace(regexp_replace({0}, '^[ \\t\\n\\x0B\\f\\r]+', ''), '[ \\t\\n\\x0B\\f\\r]+$', '')"
_CJK = "[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def document_lines(read) -> DataFrame:
    return plain.lines(read("documents"), "doc_id", "source", "lang").withColumnRenamed("source", "src")


@query(
    f"""
SELECT doc_id, 'line' || (line + 1) AS suffix, v AS source, substr(raw, 1, strpos(raw, v) - 1) AS prefix, substr(raw, strpos(raw, v) + length(v)) AS tail
FROM (SELECT *, {_strip("raw")} AS v FROM {_LINES}) WHERE v <> '' AND NOT regexp_matches(v, '^[#;/]')
"""
)
def q01_txt_entries(spark, read):
    return plain.txt_entries(read("documents"), "doc_id").drop("line")


@query(
    r"""
WITH p AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS piece, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
q AS (SELECT *, length(piece) + CASE WHEN line + 1 < n THEN 1 ELSE 0 END AS size FROM p),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM q)
SELECT doc_id, line, CAST(start AS BIGINT) AS start, CAST(start + length(piece) AS BIGINT) AS stop, CAST(start + size AS BIGINT) AS eol_stop FROM o
"""
)
def q02_line_offsets(spark, read):
    return plain.with_offsets(read("documents"), "doc_id")


_SUFFIX = "{0} || ' ' || CASE doc_id % 7 WHEN 0 THEN '%s' WHEN 1 THEN '{{0}} {{1}}' WHEN 2 THEN '${{x}}' WHEN 3 THEN '\\N[1] \\V[22]' WHEN 4 THEN '$.ab' WHEN 5 THEN '<b>x</b>' ELSE '⟦0⟧ %5d' END".replace("{{", "{").replace("}}", "}")


def _with_placeholders(read, t: Column) -> DataFrame:
    tail = F.lit("⟦0⟧ %5d")
    for k, s in enumerate(("%s", "{0} {1}", "${x}", "\\N[1] \\V[22]", "$.ab", "<b>x</b>")):
        tail = F.when(F.col("doc_id") % 7 == k, F.lit(s)).otherwise(tail)
    return read("documents").select("doc_id", F.concat(t, F.lit(" "), tail).alias("t"))


_PLACEHOLDER_SQL = "(?:%[-+0-9.#]*[a-zA-Z%]|\\{[0-9]+\\}|\\$\\{[^{}]*\\}|\\\\[A-Za-z]{1,2}\\[[0-9]+\\]|\\$\\.[A-Za-z]*|</?[A-Za-z][^>]*>|⟦[0-9]+⟧)"


@query(
    f"""
SELECT doc_id, array_to_string(list_sort(regexp_extract_all(text || ' ' || CASE doc_id % 7 WHEN 0 THEN '%s' WHEN 1 THEN '{{0}} {{1}}' WHEN 2 THEN '${{x}}'
  WHEN 3 THEN '\\N[1] \\V[22]' WHEN 4 THEN '$.ab' WHEN 5 THEN '<b>x</b>' ELSE '⟦0⟧ %5d' END, '{_PLACEHOLDER_SQL}')), '|') AS found
FROM documents
"""
)
def q03_placeholders(spark, read):
    return _with_placeholders(read, F.col("text")).select("doc_id", F.array_join(text.placeholders(F.col("t")), "|").alias("found"))



@query(
    f"""
SELECT doc_id, round(ratio, 9) AS ratio, NOT regexp_matches(t, '[A-Za-z]{{2}}') OR ratio >= 0.5 AS skipped
FROM (SELECT doc_id, t, CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, '{_CJK}')) / length(t) ELSE 0.0 END AS ratio
  FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || repeat('漢字カナ한글', length(text)) WHEN 1 THEN '12 34 ' || doc_id WHEN 2 THEN '' ELSE text END AS t FROM documents))
"""
)
def q04_cjk_ratio_skip(spark, read):
    n, t = F.col("doc_id") % 4, F.col("text")
    value = F.when(n == 0, F.concat(t, F.repeat(F.lit("漢字カナ한글"), F.length(t)))).when(n == 1, F.concat(F.lit("12 34 "), "doc_id")).when(n == 2, F.lit("")).otherwise(t)
    d = read("documents").select("doc_id", value.alias("t"))
    return d.select("doc_id", F.round(text.cjk_ratio(F.col("t")), 9).alias("ratio"), text.skipped(F.col("t")).alias("skipped"))


@query(
    """
SELECT conv_id, turn, regexp_matches(t, '[A-Za-z\\x{C0}-\\x{24F}\\x{400}-\\x{4FF}\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]') AS translatable
FROM (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN '12:30 !' WHEN 1 THEN 'Да ' || turn ELSE text END AS t FROM conversations)
"""
)
def q05_looks_translatable(spark, read):
    n = F.col("conv_id") % 3
    t = F.when(n == 0, F.lit("12:30 !")).when(n == 1, F.concat(F.lit("Да "), "turn")).otherwise(F.col("text"))
    return read("conversations").select("conv_id", "turn", text.looks_translatable(t).alias("translatable"))


_FORMATS = ["krkr-ks", "csv", "txt", "json", "ini", "po", "yaml", "subtitle-srt", "epub", "html", "pdftext", "image", "other"]
_KINDS = ["imagefont", "art", "bubble", "text"]
_LOCS = ["Event#1.name", "ev1.p0.l1.w", "ev1.p0.l1.c0", "ev1.p0.l1.x", "ev1.p0.l1#0"]
_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.FORMAT_LABELS.items())


def _pick(names: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), at.cast("int"))


@query(
    f"""
WITH e AS (
  SELECT doc_id, ({_FORMATS})[doc_id % 13 + 1] AS fmt, CASE WHEN doc_id % 5 = 0 THEN 'rgss-map' WHEN doc_id % 5 = 1 AND doc_id % 2 = 0 THEN 'rgss-system' ELSE '' END AS engine,
    ({_LOCS})[doc_id % 7 + 1] AS loc, ({_KINDS})[doc_id % 4 + 1] AS kind FROM documents)
SELECT doc_id, CASE WHEN engine = 'rgss-system' THEN '系统术语' WHEN engine = 'rgss-map' THEN
    CASE WHEN loc IS NULL THEN '游戏文本' WHEN loc LIKE '%.name' THEN '名称' WHEN contains(loc, '.w') THEN '选项分支' WHEN contains(loc, '.c') THEN '选项' WHEN contains(loc, '.x') THEN '注释' ELSE '地图对话' END
  WHEN starts_with(fmt, 'subtitle-') THEN '字幕'
  WHEN fmt = 'image' THEN CASE kind WHEN 'imagefont' THEN '图片字体标签' WHEN 'art' THEN '图片艺术字' WHEN 'bubble' THEN '漫画气泡' ELSE '图片文字' END
  ELSE CASE fmt {_LABELS} ELSE '文本' END END AS label
FROM e
"""
)
def q06_context_tag(spark, read):
    k = F.col("doc_id")
    engine = F.when(k % 5 == 0, F.lit("rgss-map")).when((k % 5 == 1) & (k % 2 == 0), F.lit("rgss-system")).otherwise(F.lit(""))
    return read("documents").select("doc_id", text.context_label(_pick(_FORMATS, k % 13), engine, _pick(_LOCS, k % 7), _pick(_KINDS, k % 4)).alias("label"))


@query(
    f"""
WITH d AS (SELECT doc_id, replace(text, ' ', '  ') || chr(13) || chr(10) || '  漢 字 と  x ' || chr(9) || chr(10) || ' ' || chr(10) || doc_id AS t FROM documents),
n AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '[ \\t\\x{{3000}}]+', ' ', 'g') AS t FROM d),
c AS (SELECT doc_id, replace(replace(t, '漢 字', '漢字'), '字 と', '字と') AS t FROM n)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: {_strip("x")}), lambda x: x <> ''), chr(10)) AS t FROM c
"""
)
def q07_normalise_ocr(spark, read):
    return _normalised(read, F.col("text"))



def _normalised(read, t: Column) -> DataFrame:
    spaced = F.concat(F.replace(t, F.lit(" "), F.lit("  ")), F.lit("\r\n  漢 字 と  x \t\n \n"), F.col("doc_id").cast("string"))
    return read("documents").select("doc_id", text.normalise_ocr(spaced).alias("t"))


_SIGNAL = "[A-Za-z0-9\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]"


@query(
    f"""
SELECT doc_id, line, v = '' OR s = 0 OR (s <= 2 AND ink > 0.05) OR j >= 0.6 * s AS doubtful
FROM (SELECT doc_id, line, ink, v, len(regexp_extract_all(v, '{_SIGNAL}')) AS s, length(regexp_replace(v, '{_SIGNAL}|\\s', '', 'g')) AS j
  FROM (SELECT doc_id, line, (line % 10) / 100.0 AS ink, {_strip("raw")} AS v FROM {_LINES}))
"""
)
def q08_unreliable_text(spark, read):
    return document_lines(read).select("doc_id", "line", text.unreliable(F.col("raw"), F.col("line") % 10 / 100.0).alias("doubtful"))



@query(
    f"""
SELECT doc_id, line, coalesce(b.target, raw) AS target, CASE WHEN b.target IS NULL THEN 'passthrough' ELSE 'cache' END AS method
FROM {_LINES} l LEFT JOIN (SELECT unnest(string_split(text, chr(10))) AS source, max('B' || item_id) AS target FROM benchmark GROUP BY 1) b ON b.source = l.raw
"""
)
def q09_cache_hit(spark, read):
    cache = read("benchmark").select(F.explode(F.split("text", "\n")).alias("source"), F.concat(F.lit("B"), "item_id").alias("t")).groupBy("source").agg(F.max("t").alias("target"))
    lines = document_lines(read).withColumnRenamed("raw", "source")
    return looked_up(lines, [], cache).select("doc_id", "line", "target", "method")


#: A glossary too long for a literal: whole names, one of them twice, of which the first counts.
MANY = [Term(f"item {i}", f"T{i}") for i in range(700)] + [Term("cold widget", "冷件"), Term("cold widget", "no"), Term("red box", "红盒")]


@query(
    """
SELECT p_partkey, n, CASE n WHEN 'cold widget' THEN '冷件' WHEN 'red box' THEN '红盒' ELSE CASE WHEN starts_with(n, 'item ') THEN 'T' || substr(n, 6) END END AS target
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'item ' || (p_partkey % 700) ELSE p_name END AS n FROM part)
"""
)
def q10_glossary_exact(spark, read):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("item "), F.col("p_partkey") % 700)).otherwise(F.col("p_name"))
    return read("part").select("p_partkey", name.alias("n")).withColumn("target", exact(F.col("n"), MANY))


@query(
    """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a T' || (p_partkey % 700) WHEN n = 'cold widget' THEN '冷件' WHEN n = 'red box' THEN '红盒' ELSE n END AS target,
  CASE WHEN n IN ('cold widget', 'red box') OR p_partkey % 3 = 0 THEN 'glossary' ELSE 'passthrough' END AS method
FROM (SELECT p_partkey, p_name AS n FROM part)
"""
)
def q10b_long_glossary(spark, read):
    """More terms than a plan holds: joined for whole texts, read once for the fold."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a Item "), F.col("p_partkey") % 700)).otherwise(F.col("p_name"))
    return looked_up(read("part").select("p_partkey", name.alias("source")), MANY).select("p_partkey", "target", "method")


@query(
    f"""
SELECT p_partkey, coalesce({_EXACT.format("p_name")}, {_sql_fold("p_name", TERMS)}) AS target FROM part
"""
)
def q11_glossary_fold(spark, read):
    return looked_up(read("part").select("p_partkey", F.col("p_name").alias("source")), TERMS).select("p_partkey", "target")


_TRANSLATED = f"""
SELECT id, source, coalesce({_EXACT.format("source")}, {_sql_fold("source", TERMS)}) AS target,
  CASE WHEN {_EXACT.format("source")} IS NOT NULL OR {_sql_hit("source", TERMS)} THEN 'glossary' WHEN NOT regexp_matches(source, '[A-Za-z]{{2}}') THEN 'skip' ELSE 'passthrough' END AS method
FROM (SELECT 'p' || p_partkey AS id, p_name AS source FROM part
  UNION ALL SELECT 'd' || doc_id || ':' || line AS id, v AS source FROM (SELECT doc_id, line, {_strip("raw")} AS v FROM {_LINES}) WHERE v <> '' AND NOT regexp_matches(v, '^[#;/]'))
"""


def _translated(read) -> DataFrame:
    parts = read("part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("source"))
    lines = plain.txt_entries(read("documents"), "doc_id").select(F.concat(F.lit("d"), "doc_id", F.lit(":"), "line").alias("id"), "source")
    return with_skips(looked_up(parts.union(lines), TERMS))


@query(f"SELECT method, count(*) AS n FROM ({_TRANSLATED}) GROUP BY method")
def q12_translate_methods(spark, read):
    return method_counts(_translated(read))


@query(
    f"""
SELECT doc_id, line, source, target, m = doc_id * 100000 + line AS first FROM (
  SELECT doc_id, line, raw AS source, min(doc_id * 100000 + line) OVER (PARTITION BY raw, lang) AS m, 'T:' || raw AS target FROM {_LINES} WHERE raw <> '')
"""
)
def q13_dedupe_first(spark, read):
    lines = document_lines(read).where("raw <> ''").select("doc_id", "line", F.col("raw").alias("source"), "lang", (F.col("doc_id") * 100000 + F.col("line")).alias("ord"))
    return firsts(lines, "source", "lang", answer=F.concat(F.lit("T:"), "source")).select("doc_id", "line", "source", F.col("answer").alias("target"), "first")


@query(
    """
SELECT doc_id, quality, 'kept' AS state FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)
UNION ALL SELECT doc_id, n_chars AS quality, 'new' AS state FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, -1 AS quality, 'pending' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
"""
)
def q14_pending_antijoin(spark, read):
    old = read("labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.lit("kept").alias("state"))
    new = read("documents").where("doc_id % 2 = 0").select("doc_id", F.col("n_chars").alias("quality"), F.lit("new").alias("state"))
    pending = read("documents").join(read("labels"), "doc_id", "left_anti").select("doc_id", F.lit(-1).cast("long").alias("quality"), F.lit("pending").alias("state"))
    return upserted(old, new, "doc_id").unionByName(pending)


@query(
    """
SELECT source AS file, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (
  SELECT source, n_chars FROM documents WHERE source NOT IN ('src1', 'src3') UNION ALL SELECT source, length(text) * 2 FROM documents WHERE source IN ('src1', 'src3') AND doc_id % 2 = 0) GROUP BY source
"""
)
def q15_incremental_replace(spark, read):
    old = read("documents").select(F.col("source").alias("file"), "n_chars")
    touched = read("documents").where(F.col("source").isin("src1", "src3"))
    new = touched.where("doc_id % 2 = 0").select(F.col("source").alias("file"), (F.length("text") * 2).cast("long").alias("n_chars"))
    got = replaced_by_file(old, new, touched.select(F.col("source").alias("file")))
    return got.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id AS id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def q16_stale_prune(spark, read):
    return pruned(read("labels").withColumnRenamed("doc_id", "id"), read("documents").where("lang <> 'en'").select(F.col("doc_id").alias("id")))


@query(
    f"""
SELECT id, array_to_string(list_filter([
  CASE WHEN regexp_extract_all(source, '{_PLACEHOLDER_SQL}').list_sort() <> regexp_extract_all(target, '{_PLACEHOLDER_SQL}').list_sort() THEN 'placeholders' END,
  CASE WHEN length(replace(source, chr(10), '')) - length(source) <> length(replace(target, chr(10), '')) - length(target) THEN 'line breaks' END,
  CASE WHEN starts_with(source, ' ') <> starts_with(target, ' ') THEN 'leading blank' END,
  CASE WHEN suffix(source, ' ') <> suffix(target, ' ') THEN 'trailing blank' END,
  CASE WHEN method NOT IN ('passthrough', 'skip') AND length(source) >= 8 AND length(target) > 0 AND length(target) / length(source) > 3.5 THEN 'too long' END,
  CASE WHEN method NOT IN ('passthrough', 'skip') AND length(source) >= 8 AND length(target) > 0 AND length(target) / length(source) < 0.2 THEN 'too short' END,
  CASE WHEN method NOT IN ('passthrough', 'skip', 'api') AND regexp_matches(target, '[A-Za-z]{{3,}}') THEN 'left over' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM (SELECT id, source || CASE WHEN length(id) % 5 = 0 THEN ' %s ' ELSE '' END AS source, CASE WHEN length(id) % 6 = 0 THEN target || repeat('长', 200) || chr(10) ELSE target END AS target, method FROM ({_TRANSLATED}))
"""
)
def q17_qa_rules(spark, read):
    n = F.length("id")
    marked = _translated(read).select(
        "id",
        F.concat("source", F.when(n % 5 == 0, F.lit(" %s ")).otherwise(F.lit(""))).alias("source"),
        F.when(n % 6 == 0, F.concat("target", F.repeat(F.lit("长"), 200), F.lit("\n"))).otherwise(F.col("target")).alias("target"),
        "method",
    )
    return quality.checked(marked).select("id", F.array_join("warnings", ",").alias("warnings"))


_EXTS = ["json", "srt", "png", "epub", "mp4", "zip", "xyz", "txt"]


@query(
    f"""
WITH f AS (SELECT ({_EXTS})[page_id % 8 + 1] AS ext FROM pages),
k AS (SELECT CASE ext WHEN 'json' THEN 'game' WHEN 'txt' THEN 'game' WHEN 'srt' THEN 'subtitle' WHEN 'png' THEN 'image' WHEN 'epub' THEN 'ebook' WHEN 'mp4' THEN 'video' WHEN 'zip' THEN 'comic' ELSE '' END AS kind FROM f),
d AS (SELECT unnest(['subtitle', 'ebook', 'image', 'comic', 'video', 'game']) AS kind)
SELECT d.kind, count(k.kind) AS n FROM d LEFT JOIN k ON k.kind = d.kind GROUP BY d.kind
"""
)
def q18_kind_counts(spark, read):
    paths = read("pages").select(F.concat(F.lit("/root/"), "page_id", F.lit("."), _pick(_EXTS, F.col("page_id") % 8)).alias("path"))
    return files.kind_counts(files.described(paths))


@query(f"SELECT doc_id AS file, count(*) AS n FROM (SELECT doc_id, {_strip('raw')} AS v FROM {_LINES}) WHERE v <> '' AND NOT regexp_matches(v, '^[#;/]') GROUP BY doc_id")
def q19_per_file_counts(spark, read):
    return rows.per_file(plain.txt_entries(read("documents"), "doc_id").withColumnRenamed("doc_id", "file"))


@query("SELECT doc_id, left(text, 80) AS preview FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def q20_batch_window(spark, read):
    return read("documents").select("doc_id", text.preview(F.col("text")).alias("preview")).orderBy("doc_id").offset(50).limit(100)


@query(
    """
SELECT event_type, event_id, value, CAST(r AS INT) AS rank FROM (
  SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 8
"""
)
def q21_budget_topn(spark, read):
    return ranked(read("events").select("event_type", "event_id", "value"), 8, ["event_type"], F.col("value").desc(), F.col("event_id"))


@query("SELECT event_type AS counter, CAST(sum(event_id % 17) AS BIGINT) AS total FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id % 2500 = 0 AND event_id < 5000) GROUP BY event_type")
def q22_usage_ledger(spark, read):
    e = read("events")
    entries = e.select("ts", F.col("event_type").alias("counter"), (F.col("event_id") % 17).alias("delta"))
    return ledger.usage(entries, e.where("event_id % 2500 = 0 and event_id < 5000").select("ts"))


@query(
    """
SELECT event_id, substr(path, 3) AS path, trim(atom::VARCHAR, '"') AS source
FROM (SELECT event_id, t.fullkey AS path, t.atom, t.type FROM events, json_tree('{"name":"n' || event_id || '","note":"x","tags":{"a":"' || event_type || '","code":"y"},"k":' || props || '}') t)
WHERE type = 'VARCHAR' AND path NOT LIKE '%.note' AND path NOT LIKE '%.code'
"""
)
def q23_json_walk(spark, read):
    nested = F.concat(F.lit('{"name":"n'), "event_id", F.lit('","note":"x","tags":{"a":"'), "event_type", F.lit('","code":"y"},"k":'), "props", F.lit("}"))
    files_ = read("events").select(F.concat("event_id", F.lit(".json")).alias("rel"), F.lit("").alias("engine"), nested.alias("text"))
    return rows.extracted(files_, json_entries).select(F.regexp_extract("file", "[0-9]+", 0).cast("long").alias("event_id"), F.col("suffix").alias("path"), "source")


@query(
    """
SELECT p_brand AS stem, min(p_size) AS low, max(p_size) AS high, count(*) AS n FROM (
  SELECT p_brand, p_size, kind, sum(new) OVER (PARTITION BY p_brand ORDER BY p_size) AS run FROM (
    SELECT *, CASE WHEN p_size = lag(p_size) OVER w + 1 AND kind = lag(kind) OVER w THEN 0 ELSE 1 END AS new FROM (
      SELECT p_brand, p_size, min_by(p_type, p_partkey)[1:1] AS kind FROM part GROUP BY p_brand, p_size)
    WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)))
GROUP BY p_brand, run HAVING count(*) >= 2
"""
)
def q24_sequence_runs(spark, read):
    named = read("part").select(F.col("p_brand").alias("stem"), "p_size", F.substring("p_type", 1, 1).alias("kind"), "p_partkey")
    runs = groups.sequence_runs(named, ["stem"], "p_size", "kind", [F.col("p_partkey")])
    return runs.groupBy("stem", "run").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("run")


_BOXES = "SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 60 + (l_partkey % 3) * 90 AS DOUBLE) AS x, CAST(10 + l_suppkey % 5 AS DOUBLE) AS y, CAST(20 + l_partkey % 40 AS DOUBLE) AS w, CAST(20 + l_suppkey % 7 AS DOUBLE) AS h FROM lineitem"


def _boxes(read) -> DataFrame:
    return read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.array((F.col("l_linenumber") * 60 + F.col("l_partkey") % 3 * 90).cast("double"), (10 + F.col("l_suppkey") % 5).cast("double"), (20 + F.col("l_partkey") % 40).cast("double"), (20 + F.col("l_suppkey") % 7).cast("double")).alias("box"),
    )


@query(
    f"""
WITH b AS ({_BOXES}), d AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM b ORDER BY l_orderkey, l_linenumber, x, y, w, h),
m AS (SELECT *, median(h) OVER (PARTITION BY l_orderkey) AS mh, lag(x + w) OVER (PARTITION BY l_orderkey ORDER BY x, l_linenumber) AS r FROM d),
p AS (SELECT *, sum(CASE WHEN x - r > 2.5 * mh THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x, l_linenumber) AS phrase FROM m)
SELECT l_orderkey, CAST(phrase AS BIGINT) AS phrase, count(*) AS n, min(x) AS bx, min(y) AS by, max(x + w) - min(x) AS bw, max(y + h) - min(y) AS bh FROM p GROUP BY l_orderkey, phrase
"""
)
def q25_phrase_split(spark, read):
    w = Window.partitionBy("l_orderkey")
    b = F.col("box")
    one = dealt(_boxes(read), "l_orderkey").withColumn("_n", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("box"))).where("_n = 1")
    order = w.orderBy(b[0], "l_linenumber")
    cut = F.coalesce((b[0] - F.lag(b[0] + b[2]).over(order) > groups.GAP * F.median(b[3]).over(w)).cast("int"), F.lit(0))
    got = one.withColumn("cut", cut).withColumn("phrase", F.sum("cut").over(order)).groupBy("l_orderkey", "phrase").agg(F.count(F.lit(1)).alias("n"), geometry.union_box(b).alias("u"))
    return got.select("l_orderkey", "phrase", "n", *(F.col("u")[i].alias(c) for i, c in enumerate(("bx", "by", "bw", "bh"))))


# The boxes of an order are all of one line: they differ by less in place and height than a line allows.
@query(
    """
WITH b AS (SELECT l_orderkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id, 'w' || l_linenumber AS t,
    CAST(l_linenumber * 60 + (l_partkey % 3) * 90 AS DOUBLE) AS x, CAST(10 + l_suppkey % 5 AS DOUBLE) AS y, CAST(20 + l_partkey % 40 AS DOUBLE) AS w, CAST(20 + l_suppkey % 7 AS DOUBLE) AS h FROM lineitem),
m AS (SELECT *, median(h) OVER (PARTITION BY l_orderkey) AS mh, lag(x + w) OVER (PARTITION BY l_orderkey ORDER BY x, y, id) AS r FROM b),
p AS (SELECT *, sum(CASE WHEN x - r > 2.5 * mh THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x, y, id ROWS UNBOUNDED PRECEDING) AS phrase FROM m)
SELECT 'g:' || arg_min(id, (x, y, id)) || '+' || count(*) AS id, 'sheet' || l_orderkey || '.png' AS file, string_agg(id, ',' ORDER BY x, y, id) AS members, string_agg(t, ' ' ORDER BY x, y, id) AS text,
  min(x) AS bx, min(y) AS by, max(x + w) - min(x) AS bw, max(y + h) - min(y) AS bh
FROM p GROUP BY l_orderkey, phrase HAVING count(*) >= 2
"""
)
def q26_atlas_groups(spark, read):
    fragments = _boxes(read).select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey").alias("id"), F.concat(F.lit("sheet"), "l_orderkey", F.lit(".png")).alias("file"),
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("page_entry"), "box", F.concat(F.lit("w"), "l_linenumber").alias("text"), F.lit("text").alias("kind"),
    )
    around = (F.col("union_box")[i].alias(c) for i, c in enumerate(("bx", "by", "bw", "bh")))
    return groups.atlas_groups(fragments).select("id", "file", F.array_join("members", ",").alias("members"), "text", *around)


@query(
    f"""
WITH e AS (SELECT conv_id, turn, {_strip("text")} AS label FROM conversations),
f AS (SELECT conv_id, label, min(turn) AS pos FROM e WHERE label <> '' GROUP BY conv_id, label)
SELECT e.conv_id, e.turn, coalesce((SELECT string_agg(label, '|' ORDER BY pos) FROM (SELECT label, pos FROM f WHERE f.conv_id = e.conv_id AND f.label <> e.label ORDER BY pos LIMIT 12)), '') AS labels FROM e
"""
)
def q27_sibling_labels(spark, read):
    e = read("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "conv_id", F.col("conv_id").alias("folder"), F.col("turn").alias("ord"), "turn", F.col("text").alias("source"))
    return rows.siblings(e).join(e, "id").select("conv_id", "turn", F.array_join("labels", "|").alias("labels"))


@query(
    r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>|[^<]+') AS l FROM pages),
t AS (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS piece FROM p),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM t),
n AS (SELECT page_id, CAST(pos AS INT) AS start, CAST(pos + length(piece) AS INT) AS stop, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS k,
  replace(replace(replace(replace(replace(replace(replace(replace(piece, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&') AS source
  FROM o WHERE NOT starts_with(piece, '<') AND regexp_matches(piece, '[^ \t\r\n]'))
SELECT 'page' || page_id || '.html#t' || k AS id, source, start, stop FROM n
"""
)
def q28_html_text_nodes(spark, read):
    pages = read("pages").select(F.concat(F.lit("page"), "page_id", F.lit(".html")).alias("rel"), F.lit("").alias("engine"), F.col("html").alias("text"))
    return rows.extracted(pages, html_entries).select("id", "source", "start", "stop")


@query(
    """
SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS decoded,
  replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(160), '&nbsp;') AS escaped
FROM (SELECT page_id, html || ' &lt;a&gt; &quot;b&quot; &apos;c&apos;&nbsp;&amp;lt; ' || chr(160) AS t FROM pages)
"""
)
def q29_entity_decode(spark, read):
    return _entities(read, F.col("html"))



def _entities(read, html: Column) -> DataFrame:
    t = F.concat(html, F.lit(" &lt;a&gt; &quot;b&quot; &apos;c&apos;&nbsp;&amp;lt; \u00a0"))
    return read("pages").select("page_id", text.decode_entities(t).alias("decoded"), text.escape_html(t).alias("escaped"))


@query(
    r"""
WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cue, regexp_replace(text, '\s+', ' ', 'g') AS t, turn * 2500 AS b, turn * 2500 + 1800 AS e FROM conversations)
SELECT conv_id, cue, CAST(b AS BIGINT) AS begin_ms, CAST(e AS BIGINT) AS end_ms, t || chr(10) || 'x' || turn AS source FROM c
"""
)
def q30_srt_cues(spark, read):
    ms = F.col("turn") * 2500
    cue = F.concat_ws("\n", F.col("turn").cast("string"), F.concat(timecode.srt_stamp(ms), F.lit(" --> "), timecode.srt_stamp(ms + 1800)), F.regexp_replace("text", r"\s+", " "), F.concat(F.lit("x"), "turn"))
    listed = F.array_sort(F.collect_list(F.struct("turn", cue.alias("s"))))
    files_ = read("conversations").groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x.s), "\n\n").alias("text"))
    return plain.cue_blocks(files_, "conv_id").select("conv_id", F.col("cue").cast("long").alias("cue"), "begin_ms", "end_ms", "source")


@query(
    """
SELECT event_id, lpad(CAST(ms // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(ms // 3600000 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS stamp, ms AS back
FROM (SELECT event_id, (event_id * 7919) % 359999000 AS ms FROM events)
"""
)
def q31_timecodes(spark, read):
    stamp = timecode.srt_stamp(F.col("event_id") * 7919 % 359999000)
    return read("events").select("event_id", stamp.alias("stamp")).withColumn("back", timecode.clock_ms(F.col("stamp")))


@query(
    """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE ',' END AS delimiter FROM part
"""
)
def q32_csv_detect(spark, read):
    k = F.col("p_partkey") % 4
    head = F.when(k == 0, F.lit("key,source,note;x")).when(k == 1, F.lit("key;source;a,b;c")).when(k == 2, F.lit("key\tsource\tx,y")).otherwise(F.lit("key"))
    return read("part").select("p_partkey", plain.csv_delimiter(F.concat(head, F.lit("\n;;;;;"), F.col("p_name"))).alias("delimiter"))


@query(
    """
SELECT p_partkey, 'ini' AS format, p_name AS source, 'name = ' AS prefix, '  ' AS tail FROM part
UNION ALL SELECT p_partkey, 'yaml', p_name, 'name: "', '" # x' FROM part
UNION ALL SELECT p_partkey, 'yaml', p_type, 'type: ', ' # y' FROM part
"""
)
def q33_ini_yaml_kv(spark, read):
    p = spread(read("part").select("p_partkey", "p_name", "p_type"), "p_partkey")
    ini = p.select("p_partkey", F.concat(F.lit("[s]\n; r = x\nname = "), "p_name", F.lit("  \nempty =\n")).alias("text"))
    yaml = p.select("p_partkey", F.concat(F.lit('# r: x\nname: "'), "p_name", F.lit('" # x\ntype: '), "p_type", F.lit(" # y\nlist: [a]\nempty:\n")).alias("text"))
    got = plain.ini_entries(ini, "p_partkey").withColumn("format", F.lit("ini")).unionByName(plain.yaml_entries(yaml, "p_partkey").withColumn("format", F.lit("yaml")))
    return got.select("p_partkey", "format", "source", "prefix", "tail")


@query(
    f"""
SELECT file, line, raw, CASE WHEN line % 3 = 0 AND v <> '' AND file % 5 <> 0 THEN replace(raw, v, '>> ' || v) ELSE raw END AS out
FROM (SELECT doc_id AS file, line, raw, {_strip("raw")} AS v FROM {_LINES})
"""
)
def q34_patch_lines(spark, read):
    lines = document_lines(read).select(F.col("doc_id").alias("file"), "line", "raw")
    value = text.stripped(F.col("raw"))
    at = F.instr(F.col("raw"), value)
    # Where the recorded source no longer stands, the patch does not hold.
    seen = F.when(F.col("file") % 5 == 0, F.concat(value, F.lit("?"))).otherwise(value)
    patches = lines.where((F.col("line") % 3 == 0) & (value != "")).select(
        "file", "line", F.substring("raw", F.lit(1), at - 1).alias("prefix"), seen.alias("source"), F.substring("raw", at + F.length(value), F.length("raw")).alias("tail"), F.concat(F.lit(">> "), value).alias("target")
    )
    return export.patched_lines(lines, patches)


@query(
    """
WITH u AS (SELECT l_orderkey, list({'f': 'f' || (l_partkey % 3), 'n': l_linenumber, 'k': l_partkey} ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS id, CAST(i - 1 AS INT) AS part, parts[i].f AS file FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM u) WHERE parts[i].f <> parts[1].f
"""
)
def q35_erase_expand(spark, read):
    part = F.struct("l_linenumber", "l_partkey", F.concat(F.lit("f"), F.col("l_partkey") % 3).alias("file"), F.array(F.lit(0.0)).alias("box"))
    units = read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(part)).alias("parts")).withColumn("file", F.col("parts")[0].file)
    return recognise.erase_tasks(units).drop("box")


@query(
    """
SELECT doc_id, array_to_string(list_filter([CASE WHEN parts < 2 THEN 'few parts' END, CASE WHEN parts >= 3 AND len(regexp_extract_all(s, '[A-Za-z]')) <= 1 THEN 'short reading' END,
  CASE WHEN trim(t) = trim(naive) AND trim(naive) <> trim(s) AND naive <> '' THEN 'joined only' END,
  CASE WHEN t <> '' AND bw > 0 AND (w + (length(t) - w) * 0.55) * 20.0 > bw * 1.35 THEN 'overflow' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM (SELECT *, len(regexp_extract_all(t, '[\\x{2E80}-\\x{9FFF}\\x{FF00}-\\x{FFEF}\\x{AC00}-\\x{D7AF}]')) AS w FROM (
  SELECT doc_id, doc_id % 4 AS parts, CASE WHEN doc_id % 3 = 0 THEN '12' ELSE text END AS s, CASE WHEN doc_id % 5 = 0 THEN 'N ' || doc_id ELSE text || '漢字' END AS t,
    'N ' || doc_id AS naive, (doc_id % 9) * 20.0 AS bw FROM documents))
"""
)
def q36_overflow_estimate(spark, read):
    return _label_warnings(read, F.col("text"), F.col("text"))



def _label_warnings(read, source: Column, target: Column) -> DataFrame:
    k = F.col("doc_id")
    naive = F.concat(F.lit("N "), k)
    d = read("documents").select(
        "doc_id",
        F.when(k % 3 == 0, F.lit("12")).otherwise(source).alias("s"),
        F.when(k % 5 == 0, naive).otherwise(F.concat(target, F.lit("漢字"))).alias("t"),
        naive.alias("naive"),
        F.array(F.lit(0.0), F.lit(0.0), k % 9 * 20.0, F.lit(20.0)).alias("box"),
    )
    found = quality.label_warnings(F.col("s"), F.col("t"), F.lit("glossary"), k % 4, F.col("naive"), F.col("box"))
    return d.select("doc_id", F.array_join(found, ",").alias("warnings"))


@query("SELECT sha256(text) AS crop, min(doc_id) AS id, count(*) AS shared FROM documents GROUP BY text")
def q37_hash_dedupe(spark, read):
    hashed = files.hashes(read("documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")))
    return hashed.groupBy(F.col("sha256").alias("crop")).agg(F.min("path").alias("id"), F.count(F.lit(1)).alias("shared"))


@query(
    """
SELECT page_id, 'ch' || lpad(CAST(k % 100 AS VARCHAR), 20, '0') || '-p' || lpad(CAST(k // 100 AS VARCHAR), 20, '0') || '.png' AS key FROM (SELECT page_id, (page_id * 7919) % 100000 AS k FROM pages)
"""
)
def q38_natural_sort(spark, read):
    k = F.col("page_id") * 7919 % 100000
    name = F.concat(F.lit("Ch"), F.lpad((k % 100).cast("string"), 3, "0"), F.lit("-p"), F.floor(k / 100).cast("string"), F.lit(".png"))
    return read("pages").select("page_id", text.natural_key(name).alias("key"))


@query(
    """
SELECT doc_id, 'v3|' || sha256(text) || '|h|' || lang AS page_key, 'g3|' || array_to_string(list_sort(['e' || doc_id, 'e' || (doc_id + 1), 'e0']), '+') AS group_key, CASE WHEN doc_id % 200 < 48 THEN 3 WHEN doc_id % 200 < 120 THEN 2 ELSE 1 END AS scale,
  CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE greatest(2, (doc_id % 200) * 0.06::DOUBLE) END AS DOUBLE) AS pad FROM documents
"""
)
def q39_cache_keys(spark, read):
    k = F.col("doc_id")
    side = (k % 200).cast("double")
    return read("documents").select(
        "doc_id",
        recognise.page_key(F.sha2("text", 256), F.lit("h"), F.col("lang")).alias("page_key"),
        recognise.group_key(F.array(F.concat(F.lit("e"), k), F.concat(F.lit("e"), k + 1), F.lit("e0"))).alias("group_key"),
        recognise.crop_scale(side, F.lit(500.0)).alias("scale"),
        recognise.crop_pad(side, F.lit(500.0), k % 2 == 0).alias("pad"),
    )


@query(
    """
SELECT event_type AS page, count(*) AS regions, count(*) FILTER (value <= 50 OR r <= 8) AS read, count(*) FILTER (value > 50 AND r <= 8) AS vision FROM (
  SELECT event_type, event_id, value, row_number() OVER (ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END, value DESC, CAST(event_id AS VARCHAR)) AS r FROM events) GROUP BY event_type
"""
)
def q40_vision_budget(spark, read):
    regions = read("events").select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("page"), F.when(F.col("value") > 50, F.lit("?")).otherwise(F.lit("text here")).alias("text"), F.lit("text").alias("kind"),
        F.col("value").alias("ink"), (F.col("event_id") % 10 == 0).alias("grouped"), F.lit("local").alias("engine"), F.lit(False).alias("fallback"),
    )
    return recognise.page_report(recognise.arbitrated(regions)).drop("ink")


@query("SELECT count(*) AS total, count(*) FILTER (d.doc_id IN (SELECT doc_id FROM labels)) AS done, count(*) FILTER (d.doc_id NOT IN (SELECT doc_id FROM labels)) AS remaining FROM documents d")
def q41_progress(spark, read):
    return progress(read("documents").select(F.col("doc_id").alias("id")), read("labels").select(F.col("doc_id").alias("id")))


@query(
    """
SELECT doc_id, replace(replace(replace(replace(replace(t, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(13), ''), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') AS escaped, replace(t, chr(13), '') AS back,
  CASE WHEN contains(t, ',') OR contains(t, '"') OR contains(t, chr(10)) THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS cell
FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' "q" ' || chr(92) || 'n' || chr(9) ELSE '' END AS t FROM documents)
"""
)
def q42_escapes(spark, read):
    return _escapes(read, F.col("text"))



def _escapes(read, value: Column) -> DataFrame:
    t = F.concat(value, F.when(F.col("doc_id") % 2 == 0, F.lit(' "q" \\n\t')).otherwise(F.lit("")))
    return read("documents").select("doc_id", text.po_escape(t).alias("escaped"), text.po_unescape(text.po_escape(t)).alias("back"), text.csv_cell(t).alias("cell"))


@query(
    """
SELECT page_id, 'p' || (page_id % 5) || '/Map' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') || '.' || e AS rel, e AS ext, CASE WHEN e = 'json' THEN 'rpgmaker-map' ELSE 'rgss-map' END AS engine
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'rxdata' ELSE 'rvdata2' END AS e FROM pages) WHERE page_id % 7 <> 0
"""
)
def q43_scan_rules(spark, read):
    k = F.col("page_id")
    ext = F.when(k % 3 == 0, F.lit("json")).when(k % 3 == 1, F.lit("rxdata")).otherwise(F.lit("rvdata2"))
    sub = F.when(k % 7 == 0, F.lit("node_modules/")).otherwise(F.lit(""))
    path = F.concat(F.lit("file:/data/p"), k % 5, F.lit("/"), sub, F.lit("Map"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("."), ext)
    return files.described(read("pages").select("page_id", path.alias("path")), "/data").where(files.wanted(F.col("rel"))).select("page_id", "rel", "ext", "engine")


@query("SELECT method, count(*) AS n FROM (" + _TRANSLATED.split("FROM (SELECT")[0].replace(_EXACT.format("source"), "NULL").replace(_sql_fold("source", TERMS), "source").replace(_sql_hit("source", TERMS), _sql_hit("source", list(SEED))) + " FROM (SELECT 'p' || p_partkey AS id, p_name || ' of Fire and Ice' AS source FROM part)) GROUP BY method")
def q44_seed_glossary(spark, read):
    parts = read("part").select(F.concat("p_name", F.lit(" of Fire and Ice")).alias("source"))
    return method_counts(with_skips(looked_up(parts, list(SEED))))


def _first_regions(boxes: DataFrame) -> DataFrame:
    ids = boxes.groupBy(F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("box").alias("box"))
    return recognise.first_regions(ids, 3).select("page", "id", "n")


_BOX_TEXT = "CAST(CAST(x AS INT) AS VARCHAR) || '.0,' || CAST(CAST(y AS INT) AS VARCHAR) || '.0,' || CAST(CAST(w AS INT) AS VARCHAR) || '.0,' || CAST(CAST(h AS INT) AS VARCHAR) || '.0'"


@query(
    f"""
SELECT 'f' || (l_linenumber % 3) || ':' || {_BOX_TEXT} AS crop, min(l_orderkey * 10 + l_linenumber) AS id, count(*) AS shared FROM ({_BOXES}) GROUP BY 1
"""
)
def q45_crop_dedupe(spark, read):
    regions = _boxes(read).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("f"), F.col("l_linenumber") % 3).alias("hash"), "box")
    return recognise.distinct_crops(regions)


@query(
    f"""
WITH b AS (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM ({_BOXES})),
u AS (SELECT DISTINCT ON (id) * FROM b ORDER BY id, x, y, w, h),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY w * h DESC, id) AS big FROM u) WHERE big <= 3)
SELECT l_orderkey AS page, id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(y / 40), x DESC, id) - 1 AS INT) AS n FROM k
"""
)
def q46_first_regions(spark, read):
    return _first_regions(_boxes(read))



@query(
    f"""
SELECT file, string_agg(out, chr(10) ORDER BY line) AS text FROM (
  SELECT doc_id AS file, line, CASE WHEN line % 3 = 0 AND v <> '' AND doc_id % 5 <> 0 THEN replace(raw, v, '>> ' || v) ELSE raw END AS out FROM (SELECT doc_id, line, raw, {_strip("raw")} AS v FROM {_LINES})) GROUP BY file
"""
)
def q47_rebuilt_files(spark, read):
    return export.rebuilt(q34_patch_lines(spark, read))


@query(
    """
SELECT conv_id AS file, string_agg('[' || (turn % 2) || ':' || turn || '] ' || text || chr(10) || role, chr(10) ORDER BY turn % 2, turn) AS text FROM conversations GROUP BY conv_id
"""
)
def q48_sidecar(spark, read):
    return export.sidecar(read("conversations").select(F.col("conv_id").alias("file"), (F.col("turn") % 2).alias("page"), F.col("turn").alias("line"), F.col("text").alias("source"), F.col("role").alias("target")))


@query("SELECT p_partkey, CASE WHEN length(k) > 8 THEN left(k, 4) || '****' || right(k, 4) WHEN length(k) > 0 THEN '****' ELSE '' END AS shown FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'short' ELSE '' END AS k FROM part)")
def q49_masked_keys(spark, read):
    k = F.col("p_partkey") % 3
    return read("part").select("p_partkey", text.masked(F.when(k == 0, F.col("p_name")).when(k == 1, F.lit("short")).otherwise(F.lit(""))).alias("shown"))


@query(
    f"""
WITH b AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM ({_BOXES}) ORDER BY l_orderkey, l_linenumber, x, y, w, h),
p AS (SELECT *, lag(y) OVER o AS py, lag(h) OVER o AS ph, lag(x) OVER o AS px, lag(w) OVER o AS pw FROM b WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, l_linenumber, round(greatest(0.0::DOUBLE, least(y + h, py + ph) - greatest(y, py)) / least(h, ph), 9) AS overlap, round(greatest(h, ph) / least(h, ph), 9) AS heights,
  px >= x - 2 AND py >= y - 2 AND px + pw <= x + w + 2 AND py + ph <= y + h + 2 AS inside, w > 0 AND h > 0 AND w * h <= 700 AS small
FROM p WHERE py IS NOT NULL
"""
)
def q50_box_geometry(spark, read):
    one = _boxes(read).groupBy("l_orderkey", "l_linenumber").agg(F.min("box").alias("box"))
    pairs = one.withColumn("before", F.lag("box").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))).where(F.col("before").isNotNull())
    a, b = F.col("box"), F.col("before")
    return pairs.select(
        "l_orderkey", "l_linenumber", F.round(geometry.overlap_ratio(a, b), 9).alias("overlap"), F.round(geometry.height_ratio(a, b), 9).alias("heights"),
        geometry.inside(b, a).alias("inside"), geometry.sprite_sized(a[2], a[3], 700).alias("small"),
    )


@query(
    f"""
SELECT file, ord, source FROM (SELECT doc_id AS file, line AS ord, {_strip("raw")} AS source FROM {_LINES}) WHERE source <> '' ORDER BY file, ord LIMIT 500
"""
)
def q51_entry_cap(spark, read):
    entries = document_lines(read).select(F.col("doc_id").alias("file"), F.col("line").alias("ord"), text.stripped(F.col("raw")).alias("source"))
    return rows.capped(entries, 500)


@query(
    """
SELECT doc_id, array_to_string(list_sort(CASE doc_id % 3 WHEN 0 THEN ['%s', '{0}'] WHEN 1 THEN ['{0}'] ELSE [] END), ',') AS differ FROM documents
"""
)
def q52_placeholder_differences(spark, read):
    k = F.col("doc_id") % 3
    source = F.when(k == 0, F.lit("%s to <b>")).otherwise(F.lit("to <b>"))
    target = F.when(k == 2, F.lit("zu <b>")).otherwise(F.lit("{0} zu <b>"))
    return read("documents").select("doc_id", F.array_join(F.array_sort(quality.placeholder_differences(source, target)), ",").alias("differ"))


@query(
    """
WITH m AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), g AS (SELECT user_id, n, user_id % 2 = 0 AS atlas, user_id % 3 <> 0 AS small FROM m)
SELECT count(*) FILTER (atlas) AS atlas, count(*) FILTER (NOT atlas) AS sequence, CAST(coalesce(sum(n), 0) AS BIGINT) AS members FROM g WHERE n <= 8 AND (atlas OR small)
"""
)
def q53_reading_units(spark, read):
    e = read("events").select(F.concat(F.lit("e"), "event_id").alias("m"), "user_id")
    made = e.groupBy(F.col("user_id").cast("string").alias("id"), F.when(F.col("user_id") % 2 == 0, "atlas").otherwise("sequence").alias("kind")).agg(F.collect_list("m").alias("members"))
    pages = e.select(F.col("m").alias("id"), F.lit(1000).alias("width"), F.when(F.col("user_id") % 3 == 0, 1000).otherwise(100).alias("height"))
    return groups.group_counts(groups.reading_units(made, pages))
