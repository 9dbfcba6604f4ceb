"""Look-ups, findings, groups, recognition, export and streams on small inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiflow.extract import parse, plain, rows
from lexiflow.functions import text, timecode
from lexiflow.operators import export, groups, layout, ledger, quality, recognise, regions, translate
from lexiflow.operators.translate import SEED, Term
from lexiflow.sources import archives, files, pdf
from lexiflow.streaming import keep_up
from tests.test_formats import SRT, marshal_map

GOLDEN = [
    "Old Man", "Hello, adventurer!", "Welcome to the Village.", "I am the Village Elder.", "Yes", "No", "When Yes", "A comment line.",
    "Test Adventure", "Gold", "Level", "HP", "Attack", "Guard", "Victory!", "Defeat...",
    "Prologue", "Good morning! The Quest begins now.", "Nice to meet you.", "Bye bye.", "レガシー", "こんにちは、世界。", "はじめまして。",
]


def entries(spark, texts):
    return spark.createDataFrame([(i, f"e{i}", "t", t) for i, t in enumerate(texts)], "ord long, id string, context string, source string")


def test_golden_project(spark):
    got = translate.translated(entries(spark, GOLDEN), [*SEED, Term("Hello", "你好")])
    assert {r["method"]: r["n"] for r in translate.method_counts(got).collect()} == {"glossary": 13, "skip": 3, "passthrough": 7}
    assert quality.issues(got).count() == 5


def test_glossary_order(spark):
    terms = [Term("Fire", "F"), Term("Fire Ball", "B$1"), Term(r"(\d+) gold", "$1G", True), Term("火", "fire")]
    df = entries(spark, ["fire ball and FIRE", "Firewall", "12 gold", "火火", "Fire"])
    got = {r["source"]: (r["target"], r["method"]) for r in translate.looked_up(df, terms).collect()}
    assert got["fire ball and FIRE"] == ("B$1 and F", "glossary")
    assert got["Firewall"] == ("Firewall", "passthrough")
    assert got["12 gold"] == ("12G", "glossary") and got["火火"] == ("firefire", "glossary") and got["Fire"] == ("F", "glossary")


def test_cache_misses_on_empty(spark):
    cache = spark.createDataFrame([("a", "A"), ("b", ""), ("c", None)], "source string, target string")
    got = {r["source"]: r["method"] for r in translate.looked_up(entries(spark, ["a", "b", "c"]), [], cache).collect()}
    assert got == {"a": "cache", "b": "passthrough", "c": "passthrough"}


def test_service_runs_once_for_each_text(spark, tmp_path):
    log = tmp_path / "calls"
    log.write_text("")

    def service(pairs):
        with open(log, "a") as f:
            f.write("".join(f"{s}\n" for _, s in pairs))
        if any(s == "boom it" for _, s in pairs):
            raise OSError
        return [s.upper() if s != "empty one" else "" for _, s in pairs]

    df = entries(spark, ["some text", "some text", "empty one", "123"]).coalesce(1)
    got = translate.translated(df, [], translate=service)
    got = spark.createDataFrame(got.collect(), got.schema)
    found = {(r["id"], r["target"], r["method"]) for r in got.collect()}
    assert found == {("e0", "SOME TEXT", "api"), ("e1", "SOME TEXT", "api"), ("e2", "empty one", "api"), ("e3", "123", "skip")}
    assert log.read_text().count("some text") == 1
    cache = translate.cached(spark.createDataFrame([], "source string, target string"), got)
    again = translate.translated(df, [], cache, translate=service)
    before = log.read_text()
    assert again.where("method = 'cache'").count() == 3 and log.read_text() == before
    failed = translate.translated(entries(spark, ["boom it"]), [], translate=service)
    assert failed.first()["method"] == "passthrough"
    assert translate.translated(df, [], done=df.select("id")).count() == 0


def test_a_run_without_limit_takes_all_entries(spark):
    df = spark.range(20_500).selectExpr("id AS ord", "'e' || id AS id", "'c' AS context", "'text ' || chr(int(97 + id % 26)) AS source")
    got = translate.translated(df, [], translate=lambda pairs: [s.upper() for _, s in pairs], limit=None)
    assert got.where("method = 'api' AND target = upper(source)").count() == 20_500
    assert translate.translated(df, [], limit=20_400).count() == 20_400
    assert translate.translated(df, [], limit=None, offset=20_490).count() == 10


def test_glossary_table():
    terms = translate.glossary_added(list(SEED), Term("Gold", "金"))
    assert len(terms) == 64 and Term("Gold", "金") in terms
    assert len(translate.glossary_removed(terms, "Gold")) == 63


def box(id_, x, y=200, w=50, h=40, text_="t", file="a.png", page=None, kind="text"):
    return (id_, file, page, None, [float(x), float(y), float(w), float(h)] if x is not None else None, text_, kind, 0.2)


FRAGMENT = "id string, file string, page int, page_entry string, box array<double>, text string, kind string, ink double"


def found(spark, items, **options):
    got, singles = groups.grouped(spark.createDataFrame(items, FRAGMENT), **options)
    return [(r["id"], r["members"], r["text"]) for r in groups.in_order(got).collect()], sorted(r["id"] for r in singles.collect())


CASES = {
    "line": ([box("a", 100, w=60, text_="Con"), box("b", 166, w=70, text_="ti"), box("c", 244, w=60, text_="nue"), box("d", 312, w=80, text_="")], [("g:a+4", ["a", "b", "c", "d"], "Con ti nue")], []),
    "phrases": ([box("b1", 0), box("b2", 56), box("b3", 306), box("b4", 362)], [("g:b1+2", ["b1", "b2"], "t t"), ("g:b3+2", ["b3", "b4"], "t t")], []),
    "two lines": ([box("a", 0, 100), box("b", 60, 100), box("c", 0, 300), box("d", 60, 300)], [("g:a+2", ["a", "b"], "t t"), ("g:c+2", ["c", "d"], "t t")], []),
    "tall title": ([box("t", 0, h=120), box("a", 60), box("b", 120)], [("g:a+2", ["a", "b"], "t t")], ["t"]),
    "sequence": ([box(f"e{i}", 0, text_=t, file=f"ui/btn_{i}.png") for i, t in ((2, "me"), (0, "New"), (1, "Ga"))], [("g:e0+3", ["e0", "e1", "e2"], "New Ga me")], []),
    "gaps": ([box(f"e{i}", 0, file=f"b_{i:02}.png") for i in (1, 2, 4, 5, 9)], [("g:e1+2", ["e1", "e2"], "t t"), ("g:e4+2", ["e4", "e5"], "t t")], ["e9"]),
    "kinds": ([box("a", 0, file="b_1.png"), box("b", 0, file="b_2.png", kind="art"), box("c", 0, file="b_3.png", kind="art")], [("g:b+2", ["b", "c"], "t t")], ["a"]),
    "unspaced": ([box("a", 0, text_="新"), box("b", 60, text_="游"), box("c", 120, text_=" 戏 ")], [("g:a+3", ["a", "b", "c"], "新游戏")], []),
    "dirty": ([box("a", 0), ("b", "", None, None, [0.0, 0.0, 1.0, 1.0], "t", "text", 0.1), box("c", None), box("d", 60, w=0), box("e", 60, text_=None)], [], ["a", "b", "c", "d", "e"]),
}


@pytest.mark.parametrize("name", CASES)
def test_groups(spark, name):
    items, expected, singles = CASES[name]
    assert found(spark, items) == (expected, singles)
    assert found(spark, items[::-1]) == (expected, singles)


def test_group_modes(spark):
    items = [box("a", 0), box("b", 60)]
    assert found(spark, items, mode="none") == ([], ["a", "b"])
    assert found(spark, items, mode="filename") == ([], ["a", "b"])
    assert found(spark, items, least=3) == ([], ["a", "b"])


@pytest.mark.parametrize(("name", "stem", "n"), [("b_0", "b", 0), ("b_04", "b", 4), ("b-1", "b", 1), ("b 2", "b", 2), ("b(3)", "b", 3), ("level2", None, None), ("bg", None, None)])
def test_numbered_names(spark, name, stem, n):
    s, k = groups.numbered_name(F.col("n"))
    assert tuple(spark.createDataFrame([(name,)], "n string").select(s, k).first()) == (stem, n)


def test_protected_tags(spark):
    source = r"{\i1}Hi{\i0}\Nyou \h{x}"
    marked, tokens = text.protect_tags(F.col("t"))
    r = spark.createDataFrame([(source,)], "t string").select(marked.alias("m"), tokens.alias("k")).select("m", "k", text.restore_tokens(F.col("m"), F.col("k")).alias("b")).first()
    assert r["m"] == "⟦0⟧Hi⟦1⟧⟦3⟧you ⟦4⟧⟦2⟧" and r["b"] == source


def test_times(spark):
    df = spark.createDataFrame([("00:01:02,5", "1:02:03.45", "02:03.4", 3723450.4)], "a string, b string, c string, d double")
    got = df.select(timecode.clock_ms(F.col("a")), timecode.ass_ms(F.col("b")), timecode.lrc_ms(F.col("c")), timecode.srt_stamp(F.col("d")), timecode.vtt_stamp(F.lit(-5.0)), timecode.frame_ms(F.lit(24), 24)).first()
    assert tuple(got) == (62500, 3723450, 123400, "01:02:03,450", "00:00:00.000", 1000.0)


def test_recognition_budget(spark):
    cols = "id string, page string, text string, kind string, ink double, grouped boolean, engine string, fallback boolean"
    df = spark.createDataFrame([("a", "p", "good text", "text", 0.1, False, "local", False), ("b", "p", "", "text", 0.2, False, "local", False), ("c", "p", "?!", "text", 0.1, True, "local", False), ("d", "p", "", "text", 0.3, False, "local", False)], cols)
    got = {r["id"]: r["source"] for r in recognise.arbitrated(df, 2).collect()}
    assert got == {"a": "local", "b": "open", "c": "vision", "d": "vision"}
    cache = spark.createDataFrame([("k1", 1, True), ("k2", 2, False)], "key string, at long, done boolean")
    plan = recognise.planned(spark.createDataFrame([("k1",), ("k2",)], "key string"), cache)
    assert {r["key"]: r["known"] for r in plan.collect()} == {"k1": True, "k2": False}
    assert [r["key"] for r in recognise.kept_cache(cache, 1).collect()] == ["k2"]


def test_regions_and_layout():
    import numpy as np

    page = np.full((200, 300), 255, np.uint8)
    page[50:70, 40:60] = page[50:70, 65:85] = page[120:140, 200:240] = 0
    assert [(r.x, r.y, r.w, r.h) for r in regions.detect(page)] == [(40, 50, 45, 20), (200, 120, 40, 20)]
    assert regions.labels(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 0, 0]], bool))[1] == 2
    size, lines, fits = layout.fit("你好 world, hello", 100, 60)
    assert fits and lines == ["你好 world,", "hello"] and layout.width(lines[0], size) <= 100
    assert layout.strip([(10, 20), (5, 10)]) == [(0.0, 0.0), (16.0, 5.0)]


def project(tmp_path):
    made = {
        "a/first.srt": SRT.encode(), "a/t.txt": b"Hello\n# no\n  World  \r\n", "b/c.ini": b"[s]\nk = v\n", "b/d.yaml": b"k: 'v w'\n", "b/e.csv": b"id,text\n1,Hi\n",
        "b/x.json": b'{"a": "b"}', "b/p.po": b'msgid "Hi"\nmsgstr ""\n', "d/Map001.rxdata": marshal_map(["Old Man", "Hello", "Bye", "More", "Yes", "Note"]),
        "k/l.ks": "レガシー\r\n".encode("shift_jis"), "h/i.html": b"<p>Hi <b>you</b></p>", ".git/x.txt": b"no", "node_modules/y.txt": b"no", "z.xyz": b"no",
    }
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return made


def test_project_round_trip(spark, tmp_path):
    made = project(tmp_path / "in")
    scanned = files.scan(spark, str(tmp_path / "in"))
    assert {r["rel"] for r in scanned.select("rel").collect()} == {n for n in made if n[0] not in ".nz"}
    assert {r["kind"]: r["n"] for r in files.kind_counts(scanned).collect()} == {"subtitle": 1, "ebook": 1, "game": 8, "image": 0, "comic": 0, "video": 0}
    got = parse.parse_texts(files.texts(scanned)).unionByName(parse.parse_binaries(scanned), allowMissingColumns=True).cache()
    assert got.where("format = 'error'").count() == 0 and got.count() == 18
    assert rows.per_file(got).where("file = 'a/t.txt'").first()["n"] == 2
    same = export.exported(scanned, got.withColumn("target", F.col("source")))
    for r in same.collect():
        if not r["file"].endswith(("json", "po")):
            assert bytes(r["content"]) == made[r["file"]], r["file"]
        assert r["error"] is None and r["refused"] == 0
    new = {r["file"]: bytes(r["content"]) for r in export.exported(scanned, got.withColumn("target", F.concat(F.lit("新"), "source"))).collect()}
    assert new["a/t.txt"] == "新Hello\n# no\n  新World  \r\n".encode() and new["b/e.csv"] == "id,text\n1,新Hi\n".encode()
    assert new["k/l.ks"] == "新レガシー\r\n".encode("shift_jis") and b"msgstr \"\xe6\x96\xb0Hi\"" in new["b/p.po"]
    stale = export.exported(scanned, got.withColumn("source", F.lit("?")).withColumn("target", F.lit("x")).where("ref_kind in ('affix', 'span', 'cell', 'json')"))
    assert all(bytes(r["content"]) == made[r["file"]] for r in stale.collect() if not r["file"].endswith("json"))


def test_backups_are_written_once(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o/f.txt").write_text("old")
    for text_ in ("new", "newer"):
        df = spark.createDataFrame([("f.txt", bytearray(text_.encode()))], "file string, content binary")
        export.write_files(df, str(tmp_path / "o"), str(tmp_path / "bak")).collect()
    assert (tmp_path / "bak/f.txt").read_text() == "old" and (tmp_path / "o/f.txt").read_text() == "newer"


def book():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<rootfiles><rootfile full-path="O/c.opf"/></rootfiles>')
        z.writestr("O/c.opf", '<package><item id="b" href="2.xhtml" media-type="application/xhtml+xml"/><item id="a" href="1.xhtml" media-type="application/xhtml+xml"/><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/1.xhtml", "<p>One</p>", zipfile.ZIP_DEFLATED)
        z.writestr("O/2.xhtml", "<p>Two</p>", zipfile.ZIP_DEFLATED)
    return out.getvalue()


def test_archives(spark):
    df = spark.createDataFrame([("b.epub", bytearray(book())), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    got = archives.members(df).collect()
    parts = {r["name"]: bytes(r["data"]) for r in got if r["data"] is not None}
    assert archives.reading_order(parts) == ["O/1.xhtml", "O/2.xhtml"] and [r["error"] for r in got if r["path"] == "bad.zip"] != [None]
    assert [r["method"] for r in got if r["name"] == "mimetype"] == ["store"]
    new = export.book_exported(book(), {"O/2.xhtml": [{"start": 3, "stop": 6, "source": "Two", "target": "<2>"}]})
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.read("O/2.xhtml") == b"<p>&lt;2&gt;</p>" and z.namelist() == [i.filename for i in zipfile.ZipFile(io.BytesIO(book())).infolist()]
    assert not archives.safe("../x") and not archives.safe("/x") and not archives.safe("C:/x") and archives.safe("a/b.png")
    assert zipfile.ZipFile(io.BytesIO(archives.pack([("b", b""), ("a", b""), ("mimetype", b"")]))).namelist() == ["mimetype", "a", "b"]


def test_pdf(spark):
    import zlib

    cmap = b"1 beginbfchar <01> <4F60> endbfchar 1 beginbfrange <02> <03> <0041> endbfrange"
    page = zlib.compress(b"BT /F1 12 Tf (\\001) Tj [(\\002) -10 (\\003)] TJ 0 -14 Td <02> Tj ET")
    data = b"%PDF-1.4\n1 0 obj <</Length 1>>\nstream\n" + cmap + b"\nendstream endobj\n2 0 obj <</Filter /FlateDecode>>\nstream\n" + page + b"\nendstream endobj\n"
    df = spark.createDataFrame([("a.pdf", bytearray(data))], "rel string, content binary")
    assert [tuple(r) for r in pdf.pdf_lines(df).orderBy("line").collect()] == [("a.pdf", 0, 0, "你AB"), ("a.pdf", 0, 1, "A")]


def test_pdf_fonts_filters_and_packed_objects():
    """Two fonts with other codes on one page, ranges as lists, wide shifts, resources above, objects in streams, LZW."""
    import base64
    import zlib

    def obj(n, head, data=None):
        return b"%d 0 obj %s" % (n, head) + (b"\nstream\n" + data + b"\nendstream" if data is not None else b"") + b" endobj\n"

    one = b"1 beginbfrange <01> <02> [<0048> <00690021>] endbfrange"
    two = b"1 beginbfchar <0001> <4F60> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange"
    page = b"BT /F1 9 Tf <01> Tj [<02> -400 <01> 20 <02>] TJ T* /F2 9 Tf <000100020003> Tj (a\\\nb) ' ET"
    packed = b"<</Type /Page /Parent 2 0 R /Contents [5 0 R 6 0 R]>> <</ToUnicode 9 0 R>>"
    at = packed.index(b" <</ToU") + 1
    head = b"4 0 8 %d " % at
    lzw_codes = [256, 45, 45, 258]  # "-" * 4 after a clear
    bits = "".join(f"{c:09b}" for c in [*lzw_codes, 257])
    data = (
        b"%PDF-1.5\n" + obj(2, b"<</Type /Pages /Resources <</Font <</F1 7 0 R /F2 8 0 R>>>>>>") + obj(3, b"<</Type /ObjStm /N 2 /First %d /Filter /FlateDecode>>" % len(head), zlib.compress(head + packed))
        + obj(5, b"<</Filter [/ASCII85Decode /FlateDecode]>>", base64.a85encode(zlib.compress(page), adobe=True)) + obj(6, b"<<>>", b"BT <0002> Tj ET")
        + obj(7, b"<</ToUnicode 10 0 R>>") + obj(9, b"<<>>", two) + obj(10, b"<<>>", one)
    )
    assert pdf.pdf_pages(data) == ["Hi! Hi!\n你AB\nab\nA"]
    assert pdf.lzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == b"----"


def test_ledger_and_streams(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows_ = [(t + dt.timedelta(hours=h), "op", c, d) for h, c, d in ((0, "calls", 5), (1, "calls", 2), (2, "tokens", 7))]
    df = spark.createDataFrame(rows_, "ts timestamp, op string, counter string, delta long")
    reset = spark.createDataFrame([(t,)], "ts timestamp")
    assert {r["counter"]: r["total"] for r in ledger.usage(df, reset).collect()} == {"calls": 2, "tokens": 7}
    entries(spark, ["Gold", "Gold", "unknown words"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ord long, id string, context string, source string").parquet(str(tmp_path / "in"))
    keep_up.translating(stream, lambda b: translate.with_skips(translate.looked_up(b, list(SEED))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    done = keep_up.latest(spark.read.parquet(str(tmp_path / "out")))
    assert {r["id"]: r["target"] for r in done.collect()} == {"e0": "金币", "e1": "金币", "e2": "unknown words"}
    df.write.parquet(str(tmp_path / "ledger"))
    windows = keep_up.usage_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "ledger")))
    query = windows.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").count() == 3


def test_siblings_and_offsets(spark):
    df = spark.createDataFrame([("a", "d", 1, "New"), ("b", "d", 2, "Load"), ("c", "d", 3, "New"), ("e", "f", 1, "x")], "id string, folder string, ord long, source string")
    assert {r["id"]: r["labels"] for r in rows.siblings(df).collect()} == {"a": ["Load"], "b": ["New"], "c": ["Load"], "e": []}
    lines = plain.with_offsets(spark.createDataFrame([(1, "a\r\nbc\n"), (2, "")], "k int, text string"), "k").orderBy("k", "line").collect()
    assert [tuple(r) for r in lines] == [(1, 0, 0, 1, 3), (1, 1, 3, 5, 6), (1, 2, 6, 6, 6), (2, 0, 0, 0, 0)]


def test_settings_and_services():
    from lexiflow.config import Config
    from lexiflow.operators import service

    c = Config().updated(chunk="500", recognition_budget=0, service_key="0123456789", group_gap="x", service_url="http://x")
    assert (c.chunk, c.recognition_budget, c.group_gap) == (100, 0, 0.0) and c.shown()["service_key"] == "0123****6789"
    assert Config().updated(chunk="x").chunk == 40
    with pytest.raises(KeyError):
        c.updated(unknown=1)
    asked = []
    answer = {"choices": [{"message": {"content": 'Sure: ["A", 2] ok'}}]}
    assert service.translator(c, lambda url, key, body: asked.append(body) or answer)([("t", "a"), ("t", "b")]) == ["A", "2"]
    assert '[["t", "a"], ["t", "b"]]' in asked[0]["messages"][0]["content"]
    with pytest.raises(ValueError):
        service.reply("none")
    with pytest.raises(ValueError):
        service.translator(Config())([("t", "a")])
    assert service.abilities(c)["translation"] and not service.abilities(c)["vision"]


def test_images(spark):
    import numpy as np

    page = np.full((40, 60), 200, np.uint8)
    page[10:20, 10:30] = 0
    assert regions.crop(page, (10, 10, 20, 10), 2).shape == (14, 24) and regions.crop(page, (-5, -5, 10, 10)).shape == (5, 5)
    assert regions.resized(page, 2).shape == (80, 120) and (regions.erased(page, [(10, 10, 20, 10)]) == 200).all()
    assert regions.stitched([page[:4, :4], page[:2, :2]], layout.strip([(4, 4), (2, 2)])).shape == (4, 12)
    labels = spark.createDataFrame(
        [("g", "a.png", None, [0.0, 0.0, 100.0, 30.0], [("a.png", [1.0, 1.0, 10.0, 10.0]), ("b.png", [0.0, 0.0, 5.0, 5.0]), ("a.png", [500.0, 1.0, 10.0, 10.0])], "新游戏"), ("h", "c.png", 1, [0.0, 0.0, 9.0, 9.0], None, "")],
        "id string, file string, page int, box array<double>, parts array<struct<file string, box array<double>>>, target string",
    )
    got = [(r["file"], r["op"], r["text"], r["fits"]) for r in export.image_operations(labels).orderBy("step").collect()]
    assert got == [("a.png", "erase", None, None), ("b.png", "erase", None, None), ("a.png", "draw", "新游戏", True)]
    named = spark.createDataFrame([(f"ui/btn_{i}.png", "image") for i in range(6)] + [("x.txt", "game")], "rel string, kind string")
    r = groups.suspected(named).first()
    assert (r["images"], r["groups"], r["samples"], r["suspected"]) == (6, 1, ["ui/btn_0.png"], True)
    assert not groups.suspected(named.limit(0)).first()["suspected"]
    pages = archives.pages(spark.createDataFrame([("c.cbz", f"p{i}.jpg") for i in (10, 2)] + [("c.cbz", "x.txt")], "path string, name string"), text.natural_key(F.col("name")), ("jpg",), 10)
    assert [(r["file"], r["page_entry"]) for r in archives.targets(named, pages, 7).collect()][-1] == ("c.cbz", "p2.jpg")


def test_vision_batches_and_tables(spark, tmp_path):
    crops = spark.createDataFrame([(f"r{i}", bytearray(b"x" * i)) for i in range(6)], "id string, crop binary").coalesce(1)

    def read(batch):
        if any(i == "r5" for i, _ in batch):
            raise OSError
        return [f"{i}:{len(c)}" for i, c in batch]

    got = {r["id"]: r["text"] for r in recognise.read_by_vision(crops, read).collect()}
    assert got == {"r0": "r0:0", "r1": "r1:1", "r2": "r2:2", "r3": "r3:3", "r4": None, "r5": None}
    path = str(tmp_path / "cache")
    assert export.load_table(spark, path, "source string, target string").count() == 0
    export.save_table(spark.createDataFrame([("a", "b")], "source string, target string"), path)
    assert export.load_table(spark, path, "source string, target string").collect() == [("a", "b")]


def test_charset_columns(spark):
    from lexiflow.functions import encoding

    df = spark.createDataFrame([("你好", "gbk", False), ("Hi", "utf-16-be", True), ("é", "latin-1", False), (None, "utf-8", False)], "t string, e string, m boolean")
    both = df.withColumn("b", encoding.encoded(F.col("t"), F.col("e"), F.col("m"))).withColumn("d", encoding.decoded(F.col("b"), F.col("e")))
    assert [r["d"]["text"] for r in both.collect()] == ["你好", "Hi", "é", None]
    assert bytes(both.collect()[1]["b"]) == b"\xfe\xff\x00H\x00i"


def test_patch_rows_by_field():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("line", pa.int32()), ("path", pa.list_(pa.string())), ("source", pa.string())]))
    rows = [[{"line": 1, "path": ["a", "b"], "source": "x"}, {"line": None, "path": None, "source": None}], [], None, [{"line": 2, "path": [], "source": "y"}]]
    assert export.structs(pa.array(rows, kind)) == [r or [] for r in rows]
    assert export.structs(pa.array(rows * 2, kind)[3:6]) == [rows[3], rows[0], []]
