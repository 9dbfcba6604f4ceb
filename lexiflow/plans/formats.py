"""Queries over file formats: files made of table rows are read, and written back, by the library; SQL knows what they hold."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.extract.marshal import Node, write
from lexiflow.extract.parse import html_entries, parse_binaries, parse_texts
from lexiflow.extract.rows import extracted
from lexiflow.functions import encoding, text, timecode
from lexiflow.functions.geometry import union_box
from lexiflow.operators import export, groups, regions
from lexiflow.plans.registry import query
from lexiflow.session import spread
from lexiflow.sources import archives, pdf


def _gathered(rows: DataFrame, key: str, order: str, *columns: Column | str) -> DataFrame:
    """key and listed: the columns of its rows in order."""
    return spread(rows, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *columns))).alias("listed"))


def _named(gathered: DataFrame, key: str, ext: str, piece: Callable[[Column], Column], head: str = "", between: str = "\n", tail: str = "", name: str = "f") -> DataFrame:
    """rel, ext, engine, text: one file for each key, of the pieces that its rows make."""
    whole = F.concat(F.lit(head), F.array_join(F.transform("listed", piece), between), F.lit(tail))
    return gathered.select(F.concat(F.lit(name), key, F.lit(f".{ext}")).alias("rel"), F.lit(ext).alias("ext"), F.lit("").alias("engine"), whole.alias("text"))


def _files(rows: DataFrame, key: str, ext: str, order: str, piece: Column, head: str = "", between: str = "\n", tail: str = "", name: str = "f") -> DataFrame:
    """rel, ext, engine, text: one file for each key, of its pieces in order."""
    return _named(_gathered(rows, key, order, piece.alias("s")), key, ext, lambda x: x.s, head, between, tail, name)


def _said(read) -> DataFrame:
    """Turns of conversations as one line each, without what the formats use as marks."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"\s+", " "), r"[{}\[\]\\|<>&⟦⟧\"';]", ""))
    return read("conversations").select("conv_id", "turn", "role", F.concat(F.lit("A "), plain, F.lit("."), "turn").alias("t"), (F.col("turn") * 2500).alias("ms"))


_SAID = r"""(SELECT conv_id, turn, role, 'A ' || trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[{}\[\]\\|<>&⟦⟧"'';]', '', 'g')) || '.' || turn AS t, turn * 2500 AS ms,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cue FROM conversations)"""


def _cue(got: DataFrame) -> DataFrame:
    return got.select("file", F.col("loc").cast("int").alias("cue"), "format", "source", "begin_ms", "end_ms", F.array_join("tokens", " ").alias("tokens"))


@query(f"SELECT 'f' || conv_id || '.vtt' AS file, CAST(cue AS INT) AS cue, 'subtitle-vtt' AS format, t || chr(10) || role AS source, CAST(ms AS DOUBLE) AS begin_ms, CAST(ms + 1800 AS DOUBLE) AS end_ms, '' AS tokens FROM {_SAID}")
def q54_vtt_cues(spark, read):
    times = F.concat(timecode.vtt_stamp(F.col("ms")), F.lit(" --> "), timecode.vtt_stamp(F.col("ms") + 1800))
    files = _files(_said(read), "conv_id", "vtt", "turn", F.concat_ws("\n", F.concat(F.lit("n"), "turn"), times, "t", "role"), "WEBVTT\n\n", "\n\n", "\n")
    return _cue(parse_texts(files))


@query(
    rf"""
SELECT 'f' || conv_id || '.ass' AS file, CAST(cue AS INT) AS cue, 'subtitle-ass' AS format, '⟦0⟧' || t || ', x⟦1⟧⟦2⟧' || role AS source, CAST(turn % 60 * 1000 + 500 AS DOUBLE) AS begin_ms, CAST(turn % 60 * 1000 + 60050 AS DOUBLE) AS end_ms, '{{\i1}} {{\i0}} \N' AS tokens
FROM {_SAID}
"""
)
def q55_ass_events(spark, read):
    second = F.lpad((F.col("turn") % 60).cast("string"), 2, "0")
    row = F.concat(F.lit("Dialogue: 0,0:00:"), second, F.lit(".50,0:01:"), second, F.lit(".05,Main,{\\i1}"), "t", F.lit(", x{\\i0}\\N"), "role")
    head = "[Script Info]\nScriptType: v4.00+\n; Dialogue: 0,no\n\n[Events]\nFormat: Layer, Start, End, Style, Text\nComment: 0,0:00:00.00,0:00:00.00,Main,no\n"
    return _cue(parse_texts(_files(_said(read), "conv_id", "ass", "turn", row, head, "\r\n", "\r\n[Fonts]\nDialogue: 0,0,0,x,no\n")))


@query(
    f"""
SELECT 'f' || conv_id || '.lrc' AS file, CAST(cue AS INT) AS cue, 'subtitle-lrc' AS format, t AS source, CAST(ms // 1000 * 1000 + 250 AS DOUBLE) AS begin_ms, CAST(ms // 1000 * 1000 + 250 AS DOUBLE) AS end_ms, '' AS tokens FROM {_SAID}
UNION ALL SELECT 'f' || conv_id || '.sub', CAST(cue AS INT), 'subtitle-sub', t || chr(10) || role, turn * 24 / 23.976::DOUBLE * 1000, (turn * 24 + 12) / 23.976::DOUBLE * 1000, '' FROM {_SAID}
UNION ALL SELECT 'f' || conv_id || '.smi', CAST(cue AS INT), 'subtitle-smi', t || chr(10) || role || ' & <x>', CAST(ms AS DOUBLE), CAST(ms AS DOUBLE), '' FROM {_SAID}
"""
)
def q56_lyrics_frames_captions(spark, read):
    """Three files of each conversation; its turns are gathered once."""
    said = _gathered(_said(read), "conv_id", "turn", "t", "role", "ms")

    def lrc(x: Column) -> Column:
        s = F.floor(x.ms / 1000)
        return F.concat(F.lit("["), F.lpad(F.floor(s / 60).cast("string"), 3, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit(".25]"), x.t)

    def sub(x: Column) -> Column:
        return F.concat(F.lit("{"), x.o * 24, F.lit("}{"), x.o * 24 + 12, F.lit("}"), x.t, F.lit("|"), x.role)

    def smi(x: Column) -> Column:
        return F.concat(F.lit("<SYNC Start="), x.ms, F.lit("><P Class=EN><b>"), x.t, F.lit("</b><br/>"), x.role, F.lit(" &amp; &lt;x&gt;\n"))

    made = [("lrc", lrc, "[ar:x]\n[00:01]\n", ""), ("sub", sub, "{1}{2} \n", ""), ("smi", smi, "<SAMI><BODY>\n", "</BODY></SAMI>")]
    files = [_named(said, "conv_id", ext, piece, head, "\n", tail) for ext, piece, head, tail in made]
    return _cue(parse_texts(files[0].union(files[1]).union(files[2])))


@query(
    """
SELECT t, CASE t WHEN '0:01:02.5' THEN 62050 WHEN '1:00:00.99' THEN 3600990 ELSE 0 END AS ass, CASE t WHEN '01:02' THEN 62000 WHEN '001:02.5' THEN 62500 END AS lrc, round(length(t) / 23.976::DOUBLE * 1000, 6) AS frame, 'h' || n AS id
FROM (SELECT n_nationkey AS n, CASE n_nationkey % 5 WHEN 0 THEN '0:01:02.5' WHEN 1 THEN '1:00:00.99' WHEN 2 THEN '01:02' WHEN 3 THEN '001:02.5' ELSE 'x' END AS t FROM nation)
"""
)
def q57_other_times(spark, read):
    names = F.array(*map(F.lit, ("0:01:02.5", "1:00:00.99", "01:02", "001:02.5", "x")))
    t = F.get(names, (F.col("n_nationkey") % 5).cast("int"))
    rows = read("nation").select(F.concat(F.lit("h"), "n_nationkey").alias("id"), t.alias("t"))
    return rows.select("id", "t", timecode.ass_ms(F.col("t")).alias("ass"), timecode.lrc_ms(F.col("t")).alias("lrc"), F.round(timecode.frame_ms(F.length("t")), 6).alias("frame"))


_CUSTOMERS = "(SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, 'Mr ' || c_name || ', \"' || c_mktsegment || '\"' AS t FROM customer)"


def _customers(read) -> DataFrame:
    return spread(read("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey").withColumn("t", F.concat(F.lit("Mr "), "c_name", F.lit(', "'), "c_mktsegment", F.lit('"')))


@query(
    f"""
SELECT 'f' || c_nationkey || '.csv#' || c_custkey AS id, t AS source, CAST(n AS INT) AS line, 'row' || n || '.col1' AS loc FROM {_CUSTOMERS}
UNION ALL SELECT 'g' || c_nationkey || '.po#' || c_mktsegment || '|' || left(t || chr(10) || c_custkey, 40), t || chr(10) || c_custkey, CAST(n - 1 AS INT), 'block' || (n - 1) FROM {_CUSTOMERS}
"""
)
def q58_table_cells_and_catalogues(spark, read):
    c = _customers(read)
    row = F.concat_ws(",", F.col("c_custkey").cast("string"), text.csv_cell(F.col("t")), F.lit("x"))
    table = _files(c, "c_nationkey", "csv", "c_custkey", row, "ID,English,note\n", "\n", "\n,,\n")
    message = F.concat(F.lit('#: x\nmsgctxt "'), "c_mktsegment", F.lit('"\nmsgid ""\n"'), text.po_escape(F.concat("t", F.lit("\n"))), F.lit('"\n"'), "c_custkey", F.lit('"\nmsgstr ""'))
    catalogue = _files(c, "c_nationkey", "po", "c_custkey", message, "", "\n\n", name="g")
    return parse_texts(table.union(catalogue)).select("id", "source", "line", "loc")


_GAME = """
SELECT 'm' || c_custkey || '/Map001.json' AS file, unnest(['ev1.p0.l0.m', 'ev1.p0.l1.c0', 'ev1.p0.l1.c1', 'ev1.p0.l3.w', 'ev1.p0.l4.x']) AS loc, unnest([t, 'Yes ' || c_custkey, 'No', 'When ' || c_custkey, 'note ' || c_custkey]) AS source FROM {0}
UNION ALL SELECT 'm' || c_custkey || '/CommonEvents.json', 'ce1.l0.m', t FROM {0}
UNION ALL SELECT 'm' || c_custkey || '/Items.json', unnest(['Items[1].name', 'Items[1].description']), unnest([c_name, t]) FROM {0}
UNION ALL SELECT 'm' || c_custkey || '/System.json', unnest(['gameTitle', 'terms.basic.0', 'terms.messages.won']), unnest([c_name, 'Level', t]) FROM {0}
UNION ALL SELECT 'm' || c_custkey || '/Other.json', unnest(['a.0.b', 'a.1', 'c']), unnest([t, 'deep', c_name]) FROM {0}
"""


def _game(c: DataFrame) -> DataFrame:
    """Five JSON files for each customer."""
    t, k, name = F.to_json(F.struct(F.col("t").alias("x"))), F.col("c_custkey").cast("string"), F.col("c_name")
    quoted = F.regexp_extract(t, '^\\{"x":(.*)\\}$', 1)
    listed = F.concat(F.lit('[{"code":401,"parameters":['), quoted, F.lit(']},{"code":102,"parameters":[["Yes '), k, F.lit('","No"]]},{"code":0,"parameters":["no"]},{"code":402,"parameters":[0,"When '), k, F.lit('"]},{"code":408,"parameters":["note '), k, F.lit('"]}]'))
    texts = {
        "Map001": F.concat(F.lit('{"displayName":"no","events":[null,{"id":1,"name":"no","pages":[{"list":'), listed, F.lit("}]}]}")),
        "CommonEvents": F.concat(F.lit('[null,{"name":"no","list":[{"code":401,"parameters":['), quoted, F.lit("]}]}]")),
        "Items": F.concat(F.lit('[null,{"id":1,"name":"'), name, F.lit('","description":'), quoted, F.lit(',"note":"no"}]')),
        "System": F.concat(F.lit('{"gameTitle":"'), name, F.lit('","locale":"no","terms":{"basic":["Level"],"messages":{"won":'), quoted, F.lit("}}}")),
        "Other": F.concat(F.lit('{"id":"no","a":[{"b":'), quoted, F.lit('},"deep"],"c":"'), name, F.lit('"}')),
    }
    each = F.explode(F.create_map(*(x for n, v in texts.items() for x in (F.lit(n), v)))).alias("n", "text")
    return c.select("c_custkey", each).select(F.concat(F.lit("m"), "c_custkey", F.lit("/"), "n", F.lit(".json")).alias("rel"), F.lit("json").alias("ext"), F.lit("").alias("engine"), "text")


@query(_GAME.format(_CUSTOMERS))
def q59_game_data(spark, read):
    return parse_texts(_game(_customers(read))).select("file", "loc", "source")


@query(
    f"""
SELECT 's' || c_custkey || '.ks' AS file, unnest(['line2', 'line3.name', 'line3.text']) AS suffix, unnest([c_name || ' speaks', c_name, 'Hi ' || c_mktsegment]) AS source, unnest(['', '"', chr(39)]) AS quote FROM {_CUSTOMERS}
UNION ALL SELECT 's' || c_custkey || '.tjs', 'line2', c_name, chr(39) FROM {_CUSTOMERS}
UNION ALL SELECT 's' || c_custkey || '.rpy', unnest(['line2', 'line2.' || (length(c_name) + 12)]), unnest([c_name, c_mktsegment]), unnest(['"', chr(39)]) FROM {_CUSTOMERS}
"""
)
def q60_scripts(spark, read):
    c, name, segment = _customers(read), F.col("c_name"), F.col("c_mktsegment")
    made = {
        "ks": F.concat(F.lit("; no\n  "), name, F.lit(' speaks \n[say name="'), name, F.lit("\" face=\"no\" text='Hi "), segment, F.lit("']\n@no\n*no|no\n")),
        "tjs": F.concat(F.lit("// \"no\"\n  '"), name, F.lit("' + x;\nvar a = \"no\";")),
        "rpy": F.concat(F.lit('show "no"\n    e "'), name, F.lit('"  x \''), segment, F.lit("'\n# \"no\"\n    \"\"")),
    }
    each = F.explode(F.create_map(*(x for n, v in made.items() for x in (F.lit(n), v)))).alias("ext", "text")
    files = c.select("c_custkey", each).select(F.concat(F.lit("s"), "c_custkey", F.lit("."), "ext").alias("rel"), "ext", F.lit("").alias("engine"), "text")
    return parse_texts(files).select("file", "suffix", "source", "quote")


def _marshal(c: DataFrame) -> DataFrame:
    """A Marshal file of item records, of map events, and of system words for each customer."""
    def string(s: str) -> Node:
        return Node('"', s.encode())

    def record(name: str, t: str) -> bytes:
        return write(Node("[", items=[Node("0"), Node("o", name="RPG::Item", items=[("@id", Node("i", 1)), ("@name", string(name)), ("@description", string(t))])]))

    def system(name: str, t: str) -> bytes:
        return write(Node("o", name="RPG::System", items=[("@game_title", string(name)), ("@words", Node("o", name="RPG::System::Words", items=[("@gold", string(t))]))]))

    def map_(name: str, t: str) -> bytes:
        command = Node("o", name="RPG::EventCommand", items=[("@code", Node("i", 401)), ("@parameters", Node("[", items=[string(t)]))])
        page = Node("o", name="RPG::Event::Page", items=[("@list", Node("[", items=[command]))])
        event = Node("o", name="RPG::Event", items=[("@name", string(name)), ("@pages", Node("[", items=[page]))])
        return write(Node("o", name="RPG::Map", items=[("@events", Node("{", items=[(Node("i", 1), event)]))]))

    @F.pandas_udf("array<binary>")
    def made(name: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([[record(a, b), system(a, b), map_(a, b)] for a, b in zip(name, t, strict=True)])

    names = F.array(*map(F.lit, ("Items.rxdata", "System.rxdata", "Map001.rxdata")))
    each = c.select("c_custkey", F.explode(F.arrays_zip(names.alias("n"), made("c_name", "t").alias("b"))).alias("x"))
    return each.select(F.concat(F.lit("r"), "c_custkey", F.lit("/"), "x.n").alias("rel"), F.lit("rxdata").alias("ext"), F.lit("").alias("engine"), F.col("x.b").alias("content"))


_MARSHAL = """
SELECT 'r' || c_custkey || '/Items.rxdata' AS file, unnest(['RPG::Item[1].name', 'RPG::Item[1].description']) AS loc, unnest([c_name{1}, t{1}]) AS source FROM {0}
UNION ALL SELECT 'r' || c_custkey || '/System.rxdata', unnest(['@game_title', 'words.@gold']), unnest([c_name{1}, t{1}]) FROM {0}
UNION ALL SELECT 'r' || c_custkey || '/Map001.rxdata', unnest(['Event#1.name', 'ev1.p0.l0.m']), unnest([c_name{1}, t{1}]) FROM {0}
"""


@query(_MARSHAL.format(_CUSTOMERS, ""))
def q61_marshal_texts(spark, read):
    return parse_binaries(_marshal(_customers(read))).select("file", "loc", "source")


@query(_MARSHAL.format(_CUSTOMERS, " || '!'"))
def q62_marshal_written(spark, read):
    """Texts of Marshal files after each has been replaced in its file and the file read again."""
    files = _marshal(_customers(read))
    done = export.exported(files, _patches(parse_binaries(files)))
    again = done.select(F.col("file").alias("rel"), F.lit("rxdata").alias("ext"), F.lit("").alias("engine"), "content")
    return parse_binaries(again).select("file", "loc", "source")


def _patches(entries: DataFrame) -> DataFrame:
    return entries.withColumn("target", F.concat("source", F.lit("!")))


@query(
    rf"""
SELECT 'f' || c_nationkey || '.csv' AS file, 'ID,English' || chr(10) || string_agg(c_custkey || ',"' || replace(t || '!', '"', '""') || '"', chr(10) ORDER BY c_custkey) AS text, count(*) AS applied FROM {_CUSTOMERS} GROUP BY c_nationkey
UNION ALL SELECT 'f' || c_nationkey || '.po', string_agg('msgid "' || c_name || '"' || chr(10) || 'msgstr "' || c_name || '!"', chr(10) || chr(10) ORDER BY c_custkey), count(*) FROM {_CUSTOMERS} GROUP BY c_nationkey
UNION ALL SELECT 'f' || c_nationkey || '.ks', string_agg('[say name="' || c_name || '!" text="' || c_mktsegment || '!"]', chr(10) ORDER BY c_custkey), 2 * count(*) FROM {_CUSTOMERS} GROUP BY c_nationkey
UNION ALL SELECT 'f' || c_nationkey || '.txt', string_agg('  ' || c_name || '! ', chr(13) || chr(10) ORDER BY c_custkey), count(*) FROM {_CUSTOMERS} GROUP BY c_nationkey
UNION ALL SELECT 'f' || c_nationkey || '.html', '<p>' || string_agg(c_name || ' &amp; &lt;co&gt;!', '<br/>' ORDER BY c_custkey) || '</p>', count(*) FROM {_CUSTOMERS} GROUP BY c_nationkey
UNION ALL SELECT 'f' || c_nationkey || '.srt', string_agg('1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || c_name || chr(10) || c_mktsegment || '!', chr(10) || chr(10) ORDER BY c_custkey), count(*) FROM {_CUSTOMERS} GROUP BY c_nationkey
UNION ALL SELECT 'f' || c_nationkey || '.json', '{{' || chr(10) || string_agg('  "k' || c_custkey || '": "' || c_name || '!"', ',' || chr(10) ORDER BY c_custkey) || chr(10) || '}}', count(*) FROM {_CUSTOMERS} GROUP BY c_nationkey
"""
)
def q63_exported_files(spark, read):
    """Each text replaced where it stands, in seven formats."""
    c, name = _customers(read), F.col("c_name")

    def made(ext: str, piece: Column, head: str = "", between: str = "\n", tail: str = "") -> DataFrame:
        return _files(c, "c_nationkey", ext, "c_custkey", piece, head, between, tail)

    files = [
        made("csv", F.concat_ws(",", F.col("c_custkey").cast("string"), text.csv_cell(F.col("t"))), "ID,English\n"),
        made("po", F.concat(F.lit('msgid "'), name, F.lit('"\nmsgstr "old"\n"er"')), between="\n\n"),
        made("ks", F.concat(F.lit('[say name="'), name, F.lit('" text="'), "c_mktsegment", F.lit('"]'))),
        made("txt", F.concat(F.lit("  "), name, F.lit(" ")), between="\r\n"),
        made("html", F.concat(name, F.lit(" &amp; &lt;co&gt;")), "<p>", "<br/>", "</p>"),
        made("srt", F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,000\n"), name, F.lit("\n"), "c_mktsegment"), between="\n\n"),
        made("json", F.concat(F.lit('"k'), "c_custkey", F.lit('":"'), name, F.lit('"')), "{", ",", "}"),
    ]
    every = files[0]
    for more in files[1:]:
        every = every.union(more)
    done = export.exported(every.select("rel", F.encode("text", "UTF-8").alias("content")), _patches(parse_texts(every)))
    return done.select("file", F.decode("content", "UTF-8").alias("text"), F.col("applied").cast("long").alias("applied"))


def _zipped(read) -> DataFrame:
    """path and content: an archive of the customers of each nation."""
    name = F.concat(F.lit("d/c"), "c_custkey", F.lit(".txt"))
    rows = read("customer").select(F.concat(F.lit("a"), "c_nationkey").alias("archive"), name.alias("name"), F.encode("c_name", "UTF-8").alias("data"))
    return export.packed(rows).withColumnRenamed("archive", "path")


@query(
    """
SELECT 'a' || c_nationkey AS path, 'd/c' || c_custkey || '.txt' AS name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY 'd/c' || c_custkey || '.txt') - 1 AS INT) AS idx, CAST(length(c_name) AS BIGINT) AS size, 'deflate' AS method, c_name AS text,
  CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS page FROM customer
"""
)
def q64_archive_members(spark, read):
    members = archives.members(_zipped(read))
    numbered = archives.pages(members, text.natural_key(F.col("name")), ("txt",), None)
    return numbered.select("path", "name", "idx", "size", "method", F.decode("data", "UTF-8").alias("text"), "page")


_OPF = '<package><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="one.xhtml" media-type="application/xhtml+xml"/><item id="b" href="sub/../two.xhtml" media-type="application/xhtml+xml"/><item id="c" href="no.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="c" linear="no"/><itemref idref="gone"/></spine></package>'


def _books(read) -> DataFrame:
    """path and content: an e-book of two chapters for each nation."""
    parts = {
        "mimetype": F.lit("application/epub+zip"), "META-INF/container.xml": F.lit('<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>'), "OPS/p.opf": F.lit(_OPF),
        "OPS/one.xhtml": F.concat(F.lit("<html><body><p>"), "n_name", F.lit(" one</p></body></html>")), "OPS/two.xhtml": F.concat(F.lit("<html><body><p>"), "n_name", F.lit(" <i>two</i></p></body></html>")), "OPS/no.xhtml": F.lit("<p>no</p>"),
    }
    each = F.explode(F.create_map(*(x for n, v in parts.items() for x in (F.lit(n), v)))).alias("name", "text")
    rows = read("nation").select(F.concat(F.lit("b"), "n_nationkey").alias("archive"), each)
    return export.packed(rows.select("archive", "name", F.encode("text", "UTF-8").alias("data"))).withColumnRenamed("archive", "path")


_BOOK = """
SELECT 'b' || n_nationkey || '!OPS/two.xhtml' AS file, 0 AS chapter, unnest([n_name || ' ', 'two{0}']) AS source FROM nation
UNION ALL SELECT 'b' || n_nationkey || '!OPS/one.xhtml', 1, n_name || ' one{0}' FROM nation
"""


def _chapters(books: DataFrame) -> DataFrame:
    return archives.book_chapters(books).select(F.concat("path", F.lit("!"), "name").alias("rel"), F.lit("").alias("engine"), "chapter", "text")


@query(_BOOK.format(""))
def q65_book_chapters(spark, read):
    chapters = _chapters(_books(read))
    return extracted(chapters, html_entries).join(chapters.select(F.col("rel").alias("file"), "chapter"), "file").select("file", "chapter", "source")


@query(_BOOK.format("!").replace("n_name || ' ',", "n_name || ' !',"))
def q66_books_written(spark, read):
    """Chapters after each text was replaced and the books were packed again."""
    books = _books(read)
    patches = _patches(extracted(_chapters(books), html_entries)).withColumn("path", F.substring_index("file", "!", 1)).withColumn("name", F.substring_index("file", "!", -1))
    chapters = _chapters(export.books_exported(books, patches))
    return extracted(chapters, html_entries).join(chapters.select(F.col("rel").alias("file"), "chapter"), "file").select("file", "chapter", "source")


@query(
    """
SELECT doc_id, doc_id || '-' || n AS id, text, 'utf-8' AS encoding, n = 2 AS bom FROM documents, (SELECT unnest([1, 2]) AS n)
"""
)
def q67_charsets(spark, read):
    """Texts to bytes, with and without a byte-order mark, and back."""
    each = read("documents").select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    back = each.withColumn("b", encoding.encoded(F.col("text"), F.lit("utf-8"), F.col("n") == 2)).withColumn("d", encoding.decoded(F.col("b")))
    return back.select("doc_id", F.concat_ws("-", "doc_id", "n").alias("id"), "d.text", "d.encoding", F.col("d.bom").alias("bom"))


@query("SELECT doc_id, base64(encode(text)) AS coded, text AS back, md5(text) AS digest FROM documents")
def q68_base64(spark, read):
    coded = text.to_base64(F.col("text"))
    return read("documents").select("doc_id", coded.alias("coded"), text.from_base64(coded).alias("back"), F.md5("text").alias("digest"))


@query(rf"SELECT conv_id, turn, '⟦0⟧' || t || '⟦2⟧' || role || '⟦1⟧' AS shown, '{{\i1}} {{x}} \N' AS tokens, '{{\i1}}' || t || '\N' || role || '{{x}}' AS back FROM {_SAID}")
def q69_protected_tags(spark, read):
    raw = F.concat(F.lit("{\\i1}"), "t", F.lit("\\N"), "role", F.lit("{x}"))
    shown, tokens = text.protect_tags(raw)
    made = _said(read).select("conv_id", "turn", shown.alias("shown"), tokens.alias("k"))
    return made.select("conv_id", "turn", "shown", F.array_join("k", " ").alias("tokens"), text.restore_tokens(F.col("shown"), F.col("k")).alias("back"))


@query(
    """
WITH p AS (SELECT page_id, page_id // 6 AS s, page_id % 6 AS k FROM pages)
SELECT 'g:' || min(page_id) || '+' || count(*) AS id, 'sequence' AS kind, string_agg(page_id, ',' ORDER BY k) AS members, string_agg('w' || k, ' ' ORDER BY k) AS text, round(avg(page_id % 10 / 10.0::DOUBLE), 9) AS ink
FROM (SELECT *, CASE WHEN k < 3 THEN 0 ELSE 1 END AS run FROM p WHERE k <> 3) GROUP BY s, run HAVING count(*) >= 2
"""
)
def q70_numbered_groups(spark, read):
    """Pieces of one name that count up, one number missing; with their mean ink."""
    k, box = F.col("page_id") % 6, F.array(*(F.lit(x) for x in (0.0, 0.0, 5.0, 5.0)))
    name = F.concat(F.lit("ui\\btn"), F.floor(F.col("page_id") / 6), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("_0"), k)).otherwise(F.concat(F.lit("("), k, F.lit(")"))), F.lit(".png"))
    fragments = read("pages").where(k != 3).select(
        F.col("page_id").cast("string").alias("id"), name.alias("file"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("page_entry"),
        box.alias("box"), F.concat(F.lit("w"), k).alias("text"), F.lit("text").alias("kind"), (F.col("page_id") % 10 / 10.0).alias("ink"),
    )
    made, _ = groups.grouped(fragments, "filename")
    inks = groups.mean_ink(made, fragments)
    return made.join(inks, "id").select("id", "kind", F.array_join("members", ",").alias("members"), "text", F.round("ink", 9).alias("ink"))


@query(
    """
SELECT 'g:e' || k || '+2' || CASE WHEN r > 1 THEN '#' || r ELSE '' END AS id, 'f' || user_id AS file, 'e' || k || ',e' || (k + 1) AS members
FROM (SELECT user_id, k, row_number() OVER (PARTITION BY k ORDER BY 'f' || user_id) AS r FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL), (SELECT unnest([0, 2]) AS k))
"""
)
def q71_equal_group_names(spark, read):
    """Two lines on each sheet, all sheets with the same names: equal group names are numbered in the order of sheets."""
    users = read("events").where(F.col("user_id").isNotNull()).select("user_id").distinct()
    each = users.select("user_id", F.explode(F.array(*map(F.lit, range(4)))).alias("n"))
    box = F.array(F.col("n") % 2 * 60.0, F.floor(F.col("n") / 2) * 30.0, F.lit(20.0), F.lit(20.0))
    fragments = each.select(
        F.concat(F.lit("e"), "n").alias("id"), F.concat(F.lit("f"), "user_id").alias("file"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("page_entry"),
        box.alias("box"), F.lit("x").alias("text"), F.lit("text").alias("kind"),
    )
    lines = groups.atlas_groups(fragments)
    return groups.numbered_ids(lines).select("id", "file", F.array_join("members", ",").alias("members"))


@query("SELECT l_orderkey, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM (SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS x, CAST(l_suppkey AS DOUBLE) AS y, 7.0::DOUBLE AS w, 9.0::DOUBLE AS h FROM lineitem) GROUP BY l_orderkey")
def q72_union_boxes(spark, read):
    box = F.array(F.col("l_linenumber").cast("double"), F.col("l_suppkey").cast("double"), F.lit(7.0), F.lit(9.0))
    made = read("lineitem").select("l_orderkey", box.alias("box")).groupBy("l_orderkey").agg(union_box(F.col("box")).alias("u"))
    return made.select("l_orderkey", *(F.col("u")[i].alias(c) for i, c in enumerate("xywh")))


@query(
    """
SELECT 'f' || c_custkey || '.pdf' AS file, CAST(0 AS INT) AS page, unnest([0, 1, 2]) AS line, unnest([c_name || ' 你', 'Of ' || c_mktsegment, 'A(b)c']) AS source FROM customer
UNION ALL SELECT 'f' || c_custkey || '.pdf', CAST(1 AS INT), 0, 'Two pages' FROM customer
"""
)
def q87_pdf_lines(spark, read):
    """Two pages; a font with a map and one without; an escaped, nested string; a wide shift; a line without letters."""
    parts = [
        F.lit("%PDF-1.4\n1 0 obj <</Type /Page /Contents 3 0 R /Resources <</Font <</F1 5 0 R /F2 6 0 R>>>>>> endobj\n2 0 obj <</Type/Page /Contents [4 0 R] /Resources <<>>>> endobj\n3 0 obj <<>>\nstream\nBT /F2 9 Tf ("),
        F.col("c_name"), F.lit(" ) Tj /F1 9 Tf <01> Tj 0 -9 Td /F2 9 Tf [(Of) -300 ("), F.col("c_mktsegment"),
        F.lit(") 10] TJ T* (A\\(b\\)c) Tj T* (12) Tj ET\nendstream endobj\n4 0 obj <<>>\nstream\nBT (Two p) Tj (ages) Tj ET\nendstream endobj\n5 0 obj <</ToUnicode 7 0 R>> endobj\n6 0 obj <<>> endobj\n7 0 obj <<>>\nstream\n1 beginbfchar <01> <4F60> endbfchar\nendstream endobj\n"),
    ]
    files = spread(read("customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select(F.concat(F.lit("f"), "c_custkey", F.lit(".pdf")).alias("rel"), F.encode(F.concat(*parts), "UTF-8").alias("content"))
    return pdf.pdf_lines(files)


@query(
    """
WITH u AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey % 3 AS f, l_suppkey % 2 AS out FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS step, count(*) OVER (PARTITION BY id) AS parts FROM u)
SELECT id, CAST(step AS INT) AS step, 'erase' AS op, 'f' || f AS file, NULL AS text FROM r WHERE f <> 0 OR out = 0
UNION ALL SELECT id, CAST(max(parts) AS INT), 'draw', 'f0', 'T' || id FROM r WHERE id % 2 = 1 GROUP BY id
"""
)
def q88_image_operations(spark, read):
    """What is wiped on a label's own sheet and on others, and what is drawn."""
    one = read("lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_partkey") % 3).alias("f"), (F.min("l_suppkey") % 2).alias("out"))
    place = F.array(F.when(F.col("out") == 0, 10.0).otherwise(5000.0), F.lit(10.0), F.lit(20.0), F.lit(20.0))
    part = F.struct("l_linenumber", F.concat(F.lit("f"), "f").alias("file"), place.alias("box"))
    labels = one.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    target = F.when(F.col("l_orderkey") % 2 == 1, F.concat(F.lit("T"), "l_orderkey")).otherwise(F.lit(""))
    box = F.array(*(F.lit(x) for x in (0.0, 0.0, 900.0, 90.0)))
    made = labels.select(F.col("l_orderkey").alias("id"), F.lit("f0").alias("file"), F.lit(None).cast("int").alias("page"), box.alias("box"), "parts", target.alias("target"))
    return export.image_operations(made).select("id", "step", "op", "file", "text")


@query(
    """
SELECT * FROM (SELECT 'i' || n_nationkey || '.png' AS file, CAST(NULL AS INT) AS page, NULL AS page_entry FROM nation ORDER BY 'i' || n_nationkey || '.png')
UNION ALL SELECT * FROM (SELECT 'z' || c_nationkey || '.cbz', CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT), 'p' || c_custkey || '.jpg' FROM customer)
"""
)
def q89_recognition_targets(spark, read):
    """Images first, then archive pages in natural order."""
    files = read("nation").select(F.concat(F.lit("i"), "n_nationkey", F.lit(".png")).alias("rel"), F.lit("image").alias("kind"))
    rows = read("customer").select(F.concat(F.lit("z"), "c_nationkey", F.lit(".cbz")).alias("path"), F.concat(F.lit("p"), "c_custkey", F.lit(".jpg")).alias("name"))
    pages = archives.pages(rows, text.natural_key(F.col("name")), ("jpg",), None)
    return archives.targets(files, pages, None)


@query(
    """
SELECT 'a' || n_nationkey AS path, CASE WHEN n_nationkey % 3 = 0 THEN 'd/../../' || n_name WHEN n_nationkey % 3 = 1 THEN 'C:/' || n_name ELSE 'd/../' || n_name END AS name,
  CASE WHEN n_nationkey % 3 = 2 THEN n_name END AS text, CASE WHEN n_nationkey % 3 <> 2 THEN 'unsafe name' END AS error FROM nation
"""
)
def q90_unsafe_members(spark, read):
    """Names that would leave the folder give an error and no data."""
    k = F.col("n_nationkey") % 3
    name = F.concat(F.when(k == 0, F.lit("d/../../")).when(k == 1, F.lit("C:/")).otherwise(F.lit("d/../")), F.col("n_name"))
    rows = read("nation").select(F.concat(F.lit("a"), "n_nationkey").alias("archive"), name.alias("name"), F.encode("n_name", "UTF-8").alias("data"))
    members = archives.members(export.packed(rows).withColumnRenamed("archive", "path"))
    return members.select("path", "name", F.decode("data", "UTF-8").alias("text"), "error")


@query(
    """
SELECT page_id, w || 'x' || h AS size, 'x' AS crop, (h + 4) * (w + 4) AS area, 4 * h * w AS grown, 200 AS ground FROM (SELECT page_id, 4 + page_id % 9 AS h, 5 + page_id % 7 AS w FROM pages)
"""
)
def q91_crops(spark, read):
    """Crops with a margin, enlarged pieces and wiped boxes of a plain image, counted in pixels."""
    import numpy as np

    @F.pandas_udf("area long, grown long, ground long")
    def run(h: pd.Series, w: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(h, w, strict=True):
            image = np.full((40, 50), 200, np.uint8)
            image[10 : 10 + a, 12 : 12 + b] = 0
            box = (12.0, 10.0, float(b), float(a))
            out.append((regions.crop(image, box, 2).size, regions.resized(regions.crop(image, box), 2).size, int(regions.erased(image, [box]).min())))
        return pd.DataFrame(out, columns=["area", "grown", "ground"])

    sized = read("pages").select("page_id", (4 + F.col("page_id") % 9).alias("h"), (5 + F.col("page_id") % 7).alias("w"))
    return sized.select("page_id", F.concat("w", F.lit("x"), "h").alias("size"), F.lit("x").alias("crop"), run("h", "w").alias("r")).select("page_id", "size", "crop", "r.*")


@query("SELECT page_id, 30 + page_id % 20 AS x, 40 + page_id % 9 AS y, 45 AS w, 20 AS h FROM pages")
def q92_text_regions(spark, read):
    """The one region of an image with a line of marks."""
    import numpy as np

    @F.pandas_udf("array<array<int>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            page = np.full((200, 300), 240, np.uint8)
            for k in range(0, 45, 5):
                page[b : b + 20, a + k : a + k + 5 if k == 40 else a + k + 3] = 20
            page[b : b + 2, a : a + 45] = 20
            out.append([[r.x, r.y, r.w, r.h] for r in regions.detect(page)])
        return pd.Series(out)

    placed = read("pages").select("page_id", (30 + F.col("page_id") % 20).alias("px"), (40 + F.col("page_id") % 9).alias("py"))
    each = placed.select("page_id", F.explode(run("px", "py")).alias("r"))
    return each.select("page_id", *(F.col("r")[i].alias(c) for i, c in enumerate("xywh")))
