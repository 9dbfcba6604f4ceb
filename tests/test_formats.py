"""Extractors of single formats, on texts as they occur in projects."""

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexiflow.extract import markup, marshal, scripts, structured, subtitles, tabular
from lexiflow.functions.encoding import decode, encode

SRT = "1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\n2\r\n00:01:00,5 --> 00:01:01,000\r\n\r\n3\r\n0:02:00.250 --> 0:02:01,000\r\nBye"
ASS = "[Script Info]\nScriptType: v4.00+\n[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:01.50,0:00:02.00,{\\i1}Hi, you{\\i0}\\Nthere\nComment: 0,0:00:01.50,0:00:02.00,no\n[Fonts]\nDialogue: x"


def plain(found):
    return [(f.suffix, f.source) for f in found]


def test_cues():
    got = subtitles.subtitle_entries("a.srt", SRT)
    assert [(f.source, f.begin_ms, f.end_ms) for f in got] == [("Hello\nthere", 1000, 2500), ("Bye", 120250, 121000)]
    assert subtitles.patched(SRT, [(f.start, f.stop, f.source, [], f.quote) for f in got]) == SRT
    longer = subtitles.patched(SRT, [(got[0].start, got[0].stop, "a\nb\nc", [], got[0].quote), (got[1].start, got[1].stop, "d", [], got[1].quote)])
    assert "a\r\nb\r\nc\r\n\r\n2" in longer and longer.endswith("d")


def test_events():
    (one,) = subtitles.subtitle_entries("a.ass", ASS)
    assert (one.source, one.tokens, one.begin_ms) == ("⟦0⟧Hi, you⟦1⟧⟦2⟧there", ["{\\i1}", "{\\i0}", "\\N"], 1500)
    assert subtitles.patched(ASS, [(one.start, one.stop, one.source, one.tokens, None)]) == ASS


def test_lyrics_frames_and_captions():
    assert [(f.source, f.begin_ms, f.end_ms) for f in subtitles.lyrics("[00:01.50][00:03]La\n[ar:x]\n[00:02] ")] == [("La", 1500, 3000)]
    text = "{24}{48}One|two\n{50}{60}\n"
    (one,) = subtitles.frames(text, 24)
    assert (one.source, one.begin_ms, one.end_ms) == ("One\ntwo", 1000, 2000)
    assert subtitles.patched(text, [(one.start, one.stop, one.source, [], one.quote)]) == text
    sami = "<SAMI><BODY><SYNC Start=100><P Class=x>A &amp; b<br>c <SYNC Start=200><P>&nbsp;</BODY></SAMI>"
    (one,) = subtitles.captions(sami)
    assert (one.source, one.begin_ms, sami[one.start : one.stop]) == ("A & b\nc", 100, "A &amp; b<br>c")


@pytest.mark.parametrize(
    ("text", "fmt"), [("WEBVTT\n", "vtt"), ("[Events]", "ssa"), (ASS, "ass"), ("<SAMI>", "smi"), ("{1}{2}x", "sub"), ("[00:01]x", "lrc"), (SRT, "srt"), ("?", "srt")]
)
def test_detect(text, fmt):
    assert subtitles.detect("", text) == fmt


def test_scripts(spark):
    def entries(reader, text):
        rows = reader(spark.createDataFrame([("a", text)], "rel string, text string"), "rel").orderBy("line", "start").collect()
        assert all(text.split("\n")[r["line"]][r["start"] : r["stop"]] == r["source"] for r in rows)
        return [(r["suffix"], r["source"], r["quote"]) for r in rows]

    ks = "; note\n*label\n@cmd\n[ch name=\"Pro\" face='x' text='Nice']\n  Good day. \n// x\n[x title=\"it's\"]"
    assert entries(scripts.ks_entries, ks) == [("line4.name", "Pro", '"'), ("line4.text", "Nice", "'"), ("line5", "Good day.", ""), ("line7.title", "it's", '"')]
    assert entries(scripts.tjs_entries, '"One";\n// "no"\n \'Two\' + x\nvar a = "b"') == [("line1", "One", '"'), ("line3", "Two", "'")]
    rpy = '# x\nlabel start:\n    e "Hi" \'you\'\n    show "no"\n    "" "Line"\n e \'a" b\' "it\'s"\n importance "x" y"'
    assert entries(scripts.renpy_entries, rpy) == [("line3", "Hi", '"'), ("line3.11", "you", "'"), ("line5", "Line", '"'), ("line6", 'a" b', "'"), ("line6.10", "it's", '"'), ("line7", "x", '"')]


def test_tables():
    text = 'id;English;note\nk1;"a; ""b""\nc";x\n;d;y\nk3;;z\n'
    assert plain(tabular.csv_entries("a.csv", text)) == [("k1", 'a; "b"\nc'), ("row2", "d")]
    assert tabular.written(tabular.table(text), ";") + "\n" == text.replace("\r", "")
    assert tabular.delimiter("a,b;c") == "," and tabular.delimiter("a") == "," and tabular.delimiter("a\tb\tc,d") == "\t"


def test_catalogues():
    text = 'msgctxt "menu"\nmsgid "Open\\\\nfile"\nmsgstr ""\n"old "\n"text"\n\nmsgid ""\n"Two "\n"lines"\nmsgstr "x"'
    assert plain(tabular.po_entries("a.po", text)) == [("menu|Open\\nfile", "Open\\nfile"), ("Two lines", "Two lines")]
    new = tabular.po_patched(tabular.blocks(text)[0], 'say "$1"')
    assert new == 'msgctxt "menu"\nmsgid "Open\\\\nfile"\nmsgstr "say \\"$1\\""'


@given(st.text(st.characters(codec="utf-8", exclude_characters="\r")))
def test_catalogue_escapes(text):
    assert tabular.unescaped(tabular.escaped(text)) == text


def test_structured():
    page = {"list": [{"code": 101, "parameters": [["Hi", "Yo"]]}, {"code": 401, "parameters": ["more"]}, {"code": 102, "parameters": [["Yes"]]}, {"code": 402, "parameters": [0, "When Yes"]}, {"code": 408, "parameters": ["c"]}, {"code": 1}]}
    import json

    maps = structured.json_entries("d/Map001.json", json.dumps({"events": [None, {"pages": [page]}]}))
    assert [f.source for f in maps] == ["Hi", "Yo", "more", "Yes", "When Yes", "c"]
    data = {"events": [None, {"pages": [page]}]}
    assert all(structured.read(data, f.path) == f.source for f in maps)
    actors = structured.json_entries("Actors.json", '[null, {"name": "Al", "note": "x", "profile": "P"}]')
    assert [f.source for f in actors] == ["Al", "P"]
    system = structured.json_entries("System.json", '{"gameTitle": "G", "terms": {"basic": ["Level", null], "messages": {"a": "b"}}}')
    assert [f.source for f in system] == ["G", "Level", "b"]
    assert plain(structured.json_entries("x.json", '{"a": [{"b": "c", "id": "no"}], "note": "no"}')) == [("a.0.b", "c")]
    fresh: dict = {}
    structured.write(fresh, ["a", "1", "b"], "x")
    assert fresh == {"a": [None, {"b": "x"}]}


def test_all_strings_of_a_long_file():
    import json

    text = json.dumps({f"k{n}": f"v {n}" for n in range(3_500)})
    found = structured.json_entries("long.json", text)
    assert [f.source for f in found] == [f"v {n}" for n in range(3_500)]


def test_many_places_are_replaced_at_once():
    rng = random.Random(1)
    for _ in range(2_000):
        text = "".join(rng.choices("abcdef", k=rng.randint(0, 12)))
        places = [sorted(rng.choices(range(len(text) + 1), k=2)) for _ in range(rng.randint(0, 4))]
        patches = sorted(((a, b, rng.choice(["", "X", "YZ"])) for a, b in places), reverse=True)
        expected = text
        for a, b, new in patches:
            expected = expected[:a] + new + expected[b:]
        assert markup.spliced(text, patches) == expected


def test_markup():
    page = "<html><head><title>T</title></head><body><p>a &rsquo; <b>b</b><br>c</p><!-- x --><script>no</script><svg><text>no</text></svg> <i>d</i></body></html> tail"
    nodes = markup.text_nodes(page)
    assert [(n.text, n.tag, n.in_head) for n in nodes] == [("T", "title", True), ("a ’ ", "p", False), ("b", "b", False), ("c", "br", False), ("d", "i", False)]
    assert markup.patched(page, []) == page
    assert "<b>&lt;x&gt;</b>" in markup.patched(page, [(nodes[2].start, nodes[2].end, "<x>")])
    opf = "<package version='3.0'><item id='a' href='ch/1.xhtml' media-type='application/xhtml+xml'/><item id=\"n\" href=\"toc.ncx\" media-type=\"application/x-dtbncx+xml\"/><spine><itemref idref='a'/><itemref idref='n' linear='no'/><itemref idref='?'/></spine></package>"
    assert markup.package(opf)[1] == ["a"]
    assert markup.chapters(opf, "OEBPS/c.opf") == ["OEBPS/ch/1.xhtml"]
    assert markup.resolved("a/b/c.opf", "../d/./e.html") == "a/d/e.html"


def test_references_end_with_a_semicolon():
    page = "<p>a&amp</p><p>&ampb; &lt;&amp;lt; &copy &copy;&#65;&#x42;&#67</p>"
    nodes = markup.text_nodes(page)
    assert [n.text for n in nodes] == ["a&amp", "&ampb; <&lt; &copy ©AB&#67"]
    from lexiflow.operators.export import patched_content

    rows = [{"start": n.start, "stop": n.end, "source": n.text, "target": "x"} for n in nodes]
    assert patched_content(page.encode(), "htmlchars", rows) == (b"<p>x</p><p>x</p>", 2)


def marshal_map(texts):
    """A map as a game writes it, with repeated symbols and a shared string."""
    n = marshal.Node
    string = lambda t: n("I", n('"', t.encode()), [("E", n("T"))])
    command = lambda code, *p: n("o", name="RPG::EventCommand", items=[("@code", n("i", code)), ("@parameters", n("[", items=list(p)))])
    rows = [command(101, n("[", items=[string(t) for t in texts[1:3]])), command(401, string(texts[3])), command(402, n("i", 0), string(texts[4])), command(408, string(texts[5]))]
    page = n("o", name="RPG::Event::Page", items=[("@list", n("[", items=rows))])
    event = n("o", name="RPG::Event", items=[("@name", string(texts[0])), ("@pages", n("[", items=[page]))])
    return marshal.write(n("o", name="RPG::Map", items=[("@events", n("{", items=[(n("i", 7), event)]))]))


def test_marshal():
    texts = ["Old Man", "Hello", "Bye", "More", "When Yes", "Note"]
    data = marshal_map(texts)
    assert marshal.write(marshal.read(data)) == data
    found = marshal.marshal_entries("Data/Map001.rxdata", data)
    assert [f.source for f in found] == texts
    new = marshal.patched(data, [(found[1].path, "Hello", "你好"), (found[2].path, "not this", "x")])
    assert [f.source for f in marshal.marshal_entries("Map001.rxdata", new)] == ["Old Man", "你好", "Bye", "More", "When Yes", "Note"]
    with pytest.raises(ValueError):
        marshal.read(data[:-3])


@given(st.integers(-(2**30), 2**30 - 1))
def test_marshal_integers(n):
    assert marshal.read(marshal.write(marshal.Node("i", n))).value == n


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16-le", "utf-16-be", "shift_jis", "gbk"])
def test_encodings(encoding):
    text = "レガシー、こんにちは" if encoding != "gbk" else "你们好，这是简体中文测试"
    data = encode(text, encoding, mark=encoding.startswith("utf-16"))
    assert decode(data, encoding)[:2] == (text, encoding)
    assert encode("你们😀", "shift_jis").endswith(b"??") or encoding


def test_stripped(spark):
    from pyspark.sql import functions as F

    from lexiflow.functions import text

    every = [chr(c) for c in range(0x3001) if re.match(text.BLANK, chr(c))] + ["\ufeff"]
    assert sorted(every) == sorted(text.BLANKS)
    rows = [f"{b} é x{b}y {b}" for b in every] + ["", "   ", None, "a"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", text.stripped(F.col("t")).alias("s")).collect()
    assert all(r["s"] == (None if r["t"] is None else r["t"].strip("".join(every))) for r in got)


def test_events_of_a_map_are_read_in_one_pass(monkeypatch):
    """Steps grow with the file, not with its square; of equal keys the first counts."""
    def event(name):
        return marshal.Node("o", name="RPG::Event", items=[("@name", marshal.Node('"', name.encode()))])

    def steps(n):
        seen = []
        monkeypatch.setattr(marshal, "scalar", lambda node, scalar=scalar: seen.append(1) or scalar(node))
        pairs = [(marshal.Node("i", k), event(f"e{k}")) for k in range(n)] + [(marshal.Node("i", 0), event("again"))]
        found = marshal.marshal_entries("Map001.rvdata2", marshal.write(marshal.Node("o", name="RPG::Map", items=[("@events", marshal.Node("{", items=pairs))])))
        assert [f.source for f in found] == [*(f"e{k}" for k in range(n)), "e0"]
        return len(seen)

    scalar = marshal.scalar
    assert steps(400) <= 2 * steps(200)
