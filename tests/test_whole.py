"""Queries work on all rows and on whole texts of their tables."""

import gc
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiflow.extract import plain, subtitles
from lexiflow.extract.rows import CHUNK_ROWS, Found, extracted
from lexiflow.functions import encoding
from lexiflow.operators import groups
from lexiflow.plans import catalogue, formats  # noqa: F401 - they register their queries
from lexiflow.plans.registry import QUERIES
from lexiflow.sources import archives


def boxed(order, line, part, supplier):
    return [float(line * 60 + part % 3 * 90), float(10 + supplier % 5), float(20 + part % 40), float(20 + supplier % 7)]


def brute_atlas(rows):
    """(file, members, union box) of each group of two fragments or more, by the rules one sheet at a time."""
    out = []
    for order in {r[0] for r in rows}:
        sheet = [(boxed(*r), f"{r[0]}-{r[1]}-{r[2]}") for r in rows if r[0] == order]
        lines = []
        for b, id_ in sorted(sheet, key=lambda f: (f[0][1], f[0][0], f[1])):
            for line in lines:
                o = line[0][0]
                common = min(b[1] + b[3], o[1] + o[3]) - max(b[1], o[1])
                if common >= groups.OVERLAP * min(b[3], o[3]) and max(b[3], o[3]) <= groups.HEIGHTS * min(b[3], o[3]):
                    line.append((b, id_))
                    break
            else:
                lines.append([(b, id_)])
        for line in lines:
            heights = sorted(b[3] for b, _ in line)
            median = (heights[(len(line) - 1) // 2] + heights[len(line) // 2]) / 2
            if len(line) < 2 or heights[-1] > groups.HEIGHTS * heights[0]:
                continue
            phrases = []
            for b, id_ in sorted(line, key=lambda f: (f[0][0], f[0][1], f[1])):
                if not phrases or b[0] - (phrases[-1][-1][0][0] + phrases[-1][-1][0][2]) > groups.GAP * median:
                    phrases.append([])
                phrases[-1].append((b, id_))
            for p in (p for p in phrases if len(p) > 1):
                x, y = min(b[0] for b, _ in p), min(b[1] for b, _ in p)
                out.append((f"sheet{order}.png", [i for _, i in p], [x, y, max(b[0] + b[2] for b, _ in p) - x, max(b[1] + b[3] for b, _ in p) - y]))
    return sorted(out)


def lineitem(spark, tmp_path):
    rng = random.Random(6)
    rows = [(order, line, rng.randint(1, 400), rng.randint(1, 90)) for order in range(1, 41) for line in range(1, rng.randint(2, 8))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    return rows


def test_atlas_groups_of_all_sheets(spark, tmp_path):
    rows = lineitem(spark, tmp_path)
    got = QUERIES["q26_atlas_groups"](spark, str(tmp_path)).collect()
    expected = brute_atlas(rows)
    assert sorted((r["file"], r["members"].split(","), [r[c] for c in ("bx", "by", "bw", "bh")]) for r in got) == expected
    assert len({file for file, *_ in expected}) > 20


def test_first_regions_of_all_pages(spark, tmp_path):
    rows = lineitem(spark, tmp_path)
    expected = set()
    for order in {r[0] for r in rows}:
        page = [(boxed(*r), r[0] * 10 + r[1]) for r in rows if r[0] == order]
        kept = sorted(page, key=lambda f: (-f[0][2] * f[0][3], f[1]))[:3]
        expected |= {(order, id_, n) for n, (_, id_) in enumerate(sorted(kept, key=lambda f: (f[0][1] // 40, -f[0][0], f[1])))}
    got = QUERIES["q46_first_regions"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert {page for page, *_ in expected} == {r[0] for r in rows}


#: What stands at the end of a long text or page, the query, its column, and what must be found of it.
ENDS = {
    "placeholders": ("documents", "%9d", "q03_placeholders", "found", lambda v: "%9d" in v),
    "blanks": ("documents", "z  \u3000 z", "q07_normalise_ocr", "t", lambda v: "\nz z\n" in v),
    "signs": ("documents", "ab%%%%%%%%%", "q08_unreliable_text", "doubtful", lambda v: v is True),
    "entities": ("pages", "&lt;end&gt;", "q29_entity_decode", "decoded", lambda v: "<end>" in v),
    "width": ("documents", "漢" * 90, "q36_overflow_estimate", "warnings", lambda v: "overflow" in v),
    "escapes": ("documents", 'end"\t', "q42_escapes", "escaped", lambda v: 'end\\"\\t' in v),
}


@pytest.mark.parametrize("name", ENDS)
def test_ends_of_long_texts(spark, tmp_path, name):
    table, end, query, column, seen = ENDS[name]
    whole = "word " * 100 + "\n" + end
    key, value = ("doc_id", "text") if table == "documents" else ("page_id", "html")
    spark.createDataFrame([(8, whole, "src0", "en")], f"{key} long, {value} string, source string, lang string").write.parquet(str(tmp_path / f"{table}.parquet"))
    assert any(seen(r[column]) for r in QUERIES[query](spark, str(tmp_path)).collect())


@pytest.mark.parametrize("name", ["q61_marshal_texts", "q87_pdf_lines", "q59_game_data", "q33_ini_yaml_kv"])
def test_one_row_group_keeps_all_cores_at_work(spark, sf, name):
    assert QUERIES[name](spark, sf).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_python_gets_small_batches(spark, sf):
    QUERIES["q67_charsets"](spark, sf)
    sizes = spark.range(0, 5_000, 1, 1).selectExpr("repeat('x', 20000) AS t").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    got = [r["n"] for r in sizes.collect()]
    assert len(got) >= 20 and max(got) < 8 << 20


def test_each_line_of_keys_is_matched_once(spark, sf):
    plan = QUERIES["q33_ini_yaml_kv"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") + plan.count("RLIKE") == 2


def test_key_lines_with_odd_characters(spark):
    texts = ["a: 'x' y\rb: z\r", 'a:\u00a0"x"\u00a0# "y"\nb: \x00$1 # r', "a: [x]\na:b\na: b: c\n: d", None, ""]
    files = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = sorted((r["n"], r["line"], r["prefix"], r["source"], r["tail"]) for r in plain.yaml_entries(files, "n").collect())
    assert got == [(1, 0, 'a:\u00a0"', "x", '"\u00a0# "y"'), (1, 1, "b: ", "\x00$1", " # r"), (2, 2, "a: ", "b: c", "")]
    files = spark.createDataFrame([(0, "a = b = c \r\n=d\n[e]=f\ng=\nh=\x00\\$2\r")], "n int, text string")
    got = sorted((r["line"], r["prefix"], r["source"], r["tail"]) for r in plain.ini_entries(files, "n").collect())
    assert got == [(0, "a = ", "b = c", " "), (4, "h=", "\x00\\$2", "")]


def test_charsets_take_one_worker_a_task(spark, sf):
    plan = QUERIES["q67_charsets"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_charsets_of_missing_and_other_texts(spark):
    rows = [(None,), (b"",), ("é".encode(),), ("é".encode("gbk"),), (b"\xff\xfea\x00",)]
    got = [r["d"] for r in spark.createDataFrame(rows, "b binary").select(encoding.decoded(F.col("b")).alias("d")).collect()]
    assert [tuple(d) for d in got] == [(None, None, None), *(encoding.decode(b) for (b,) in rows[1:])]
    empty = spark.createDataFrame([], "b binary").select(encoding.decoded(F.col("b")).alias("d"))
    assert empty.collect() == []


def test_lines_without_a_language_have_a_first(spark, tmp_path):
    rows = [(1, "a\nb", None, "s"), (2, "a\nc", None, "s"), (3, "a", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["line"]): (r["target"], r["first"]) for r in QUERIES["q13_dedupe_first"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): ("T:a", True), (1, 1): ("T:b", True), (2, 0): ("T:a", False), (2, 1): ("T:c", True), (3, 0): ("T:a", True)}


def test_lines_move_once_and_their_keys_apart(spark, sf):
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = QUERIES["q13_dedupe_first"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, old)
    # Rows once; keys counted, then moved to them, so that adaptive execution can split a frequent line.
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("SortMergeJoin") == 1


def test_members_are_read_one_by_one(spark):
    names = [f"{n}.txt" for n in range(2_500)]
    content = archives.pack([(n, n.encode()) for n in names])
    one = archives.members_of("a", content)
    assert next(one)[6] == b"0.txt"
    got = archives.members(spark.createDataFrame([("a", content), ("b", None), ("c", b"no")], "path string, content binary")).collect()
    assert sorted(r["data"].decode() for r in got if r["path"] == "a") == sorted(names) and [r["idx"] for r in got if r["path"] == "c"] == [-1] and len(got) == 2_501


def test_entries_go_back_in_runs(spark):
    held = []

    class Files:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, columns):
            held.append(run)
            return self

        def withColumn(self, *column):
            return self

    extracted(Files(), subtitles.subtitle_entries)
    for ext, line in (("lrc", "[00:01]x"), ("sub", "{1}{2}x"), ("ass", "Dialogue: 0,0,0,x")):
        text = "[Events]\nFormat: Layer, Start, End, Text\n" + "\n".join([line] * 5_000)
        batch = pa.RecordBatch.from_pydict({"rel": [f"a.{ext}", f"b.{ext}"], "engine": ["", ""], "text": [text, text]})
        sizes = [b.num_rows for b in held[0]([batch])]
        assert sum(sizes) == 10_000 and max(sizes) <= CHUNK_ROWS


def test_long_files_are_not_held_as_entries(spark):
    def many(rel, text):
        for n in range(5_000):
            yield Found(f"c{n}", "x", text)
        yield Found("held", "x", str(sum(type(o).__name__ == "Found" for o in gc.get_objects())))
        if rel == "b":
            raise ValueError("late")

    got = extracted(spark.createDataFrame([("a", "", "t"), ("b", "", "t"), ("c", "", None)], "rel string, engine string, text string"), many).collect()
    assert sorted(r["ord"] for r in got if r["file"] == "a") == list(range(5_001))
    assert [int(r["source"]) < 10 for r in got if r["suffix"] == "held"] == [True]
    # A file that breaks off late gives its error only.
    assert [(r["ord"], r["format"], r["source"]) for r in got if r["file"] == "b"] == [(0, "error", "ValueError: late")]


def test_turns_of_three_files_move_once(spark, sf):
    df = QUERIES["q56_lyrics_frames_captions"](spark, sf)
    assert df.count() == 3 * spark.read.parquet(f"{sf}/conversations.parquet").count()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") == 3 and final.count("ReusedExchange") == 2


def test_archives_are_read_when_all_are_packed(spark, sf):
    plan = QUERIES["q64_archive_members"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    reads, packs = plan.index("MapInArrow"), plan.index("FlatMapGroupsInArrow")
    assert "Exchange" in plan[reads:packs]


def test_groups_stay_dealt_to_many_tasks(spark, tmp_path):
    lineitem(spark, tmp_path)
    for name in ("q25_phrase_split", "q26_atlas_groups"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan
