"""Column expressions over strings: placeholders, scripts, trimming, escapes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The placeholder kinds and the script ranges that translations must respect.
PLACEHOLDER = r"%[-+0-9.#]*[a-zA-Z%]|\{[0-9]+\}|\$\{[^{}]*\}|\\[A-Za-z]{1,2}\[[0-9]+\]|\$\.[A-Za-z]*|</?[A-Za-z][^>]*>|⟦[0-9]+⟧"
CJK = r"[一-鿿぀-ヿ가-힯]"
LETTER = r"[A-Za-zÀ-ɏЀ-ӿ぀-ヿ一-鿿가-힯]"
SIGNAL = r"[A-Za-z0-9぀-ヿ一-鿿가-힯]"
WIDE = r"[⺀-鿿＀-￯가-힯]"
#: White space that trimming takes off; Spark's and other engines' trim() differ, this class does not.
BLANK = r"[ \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same characters, one after the other.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def stripped(text: Column) -> Column:
    """text without white space at its ends; only the ends are read."""
    return F.btrim(text, F.lit(BLANKS))


def blank(text: Column) -> Column:
    return F.coalesce(stripped(text) == "", F.lit(True))


def placeholders(text: Column) -> Column:
    """All placeholders of text, sorted, with repeats."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})"), F.lit(1)))


def cjk_ratio(text: Column) -> Column:
    """Share of CJK characters; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(CJK)) / n).otherwise(F.lit(0.0))


def looks_translatable(text: Column) -> Column:
    """Whether text has any letter of the supported scripts."""
    return F.coalesce(text.rlike(LETTER), F.lit(False))


def skipped(text: Column) -> Column:
    """Whether a text needs no translation: no two ASCII letters in a row, or half of it CJK already."""
    return ~text.rlike("[A-Za-z]{2}") | (cjk_ratio(text) >= 0.5)


def normalise_ocr(text: Column) -> Column:
    """Recognised text with one kind of line end, single blanks, none between CJK characters, and no empty line."""
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    single = F.regexp_replace(lines, r"[ \t\u3000]+", " ")
    joined = F.regexp_replace(single, f"({CJK}) +(?={CJK})", "$1")
    rows = F.transform(F.split(joined, "\n"), stripped)
    return F.array_join(F.filter(rows, lambda x: x != ""), "\n")


def unreliable(text: Column, ink: Column) -> Column:
    """Whether recognised text is doubtful: nothing there, hardly a letter for much ink, or too much junk."""
    value = stripped(F.coalesce(text, F.lit("")))
    signal = F.regexp_count(value, F.lit(SIGNAL))
    junk = F.length(F.regexp_replace(value, rf"{SIGNAL}|[\s]", ""))
    return (value == "") | (signal == 0) | ((signal <= 2) & (F.coalesce(ink, F.lit(0.0)) > 0.05)) | (junk >= 0.6 * signal)


def masked(secret: Column) -> Column:
    """A secret with all but its first and last four characters hidden; a short one hidden whole."""
    return F.when(F.length(secret) > 8, F.concat(F.left(secret, F.lit(4)), F.lit("****"), F.right(secret, F.lit(4)))).otherwise(
        F.when(F.length(secret) > 0, F.lit("****")).otherwise(F.lit(""))
    )


def preview(text: Column, chars: int = 80) -> Column:
    return F.substring(text, 1, chars)


# Labels of the kinds of text, shown to translators.
FORMAT_LABELS = {
    "krkr-ks": "剧本对话", "krkr-tjs": "剧本对话", "renpy": "剧本对话", "krkr-csv": "表格", "csv": "表格", "krkr-txt": "文本", "txt": "文本",
    "json": "JSON", "ini": "INI", "po": "翻译条目", "yaml": "YAML", "epub": "电子书正文", "html": "网页正文", "pdftext": "PDF 文本层",
}
IMAGE_LABELS = {"imagefont": "图片字体标签", "art": "图片艺术字", "bubble": "漫画气泡"}


def context_label(fmt: Column, engine: Column, loc: Column, kind: Column) -> Column:
    """What sort of text an entry is; the tests of loc are tried in this order."""
    script = (
        F.when(engine == "rgss-system", F.lit("系统术语"))
        .when(loc.isNull(), F.lit("游戏文本"))
        .when(loc.endswith(".name"), F.lit("名称"))
        .when(loc.contains(".w"), F.lit("选项分支"))
        .when(loc.contains(".c"), F.lit("选项"))
        .when(loc.contains(".x"), F.lit("注释"))
        .otherwise(F.lit("地图对话"))
    )
    image = F.lit("图片文字")
    for name, label in IMAGE_LABELS.items():
        image = F.when(kind == name, F.lit(label)).otherwise(image)
    plain = F.when(F.startswith(fmt, F.lit("subtitle-")), F.lit("字幕")).when(fmt == "image", image)
    for name, label in FORMAT_LABELS.items():
        plain = plain.when(fmt == name, F.lit(label))
    return F.when(engine.isin("rgss-map", "rgss-db", "rgss-system"), script).otherwise(plain.otherwise(F.lit("文本")))


def _each(text: Column, steps) -> Column:
    for old, new in steps:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def decode_entities(text: Column) -> Column:
    """Named entities as characters, ampersands last; numeric ones need decode_numeric()."""
    return _each(text, (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")))


def escape_html(text: Column) -> Column:
    return _each(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\u00a0", "&nbsp;")))


def po_escape(text: Column) -> Column:
    return _each(text, (("\\", "\\\\"), ('"', '\\"'), ("\r", ""), ("\n", "\\n"), ("\t", "\\t")))


def po_unescape(text: Column) -> Column:
    """Escapes undone from left to right, so that an escaped backslash never starts another escape."""
    held = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    return F.replace(_each(held, (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'))), F.lit("\x00"), F.lit("\\"))


def csv_cell(text: Column, delimiter: str = ",") -> Column:
    """A cell as written: quoted only if it holds the delimiter, a quote or a line end."""
    needs = text.contains(delimiter) | text.contains('"') | text.contains("\n")
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def to_base64(text: Column) -> Column:
    """UTF-8 of a text in base 64, on one line."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")


def from_base64(coded: Column) -> Column:
    return F.decode(F.unbase64(coded), "UTF-8")


def natural_key(name: Column) -> Column:
    """A sort key by which runs of digits compare as numbers (of up to 20 digits)."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)), "")


def restore_tokens(text: Column, tokens: Column) -> Column:
    """Numbered marks replaced by the tokens that they stand for, in one fold."""
    pairs = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, F.concat(F.lit("⟦"), p.i.cast("string"), F.lit("⟧")), p.t))


def protect_tags(text: Column) -> tuple[Column, Column]:
    """(text with numbered marks, tokens): brace tags first, then hard line ends and blanks, in the order of two passes."""
    braces = F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1))
    rest = F.regexp_replace(text, r"\{[^{}]*\}", "")
    tokens = F.concat(braces, F.regexp_extract_all(rest, F.lit(r"(\\[Nnh])"), F.lit(1)))

    def marked(acc: Column, pieces: Column, first: Column) -> Column:
        return F.aggregate(
            F.transform(pieces, lambda p, i: F.struct(p.alias("p"), (i + first).alias("i"))),
            F.struct(F.lit("").alias("done"), acc.alias("left")),
            lambda s, x: F.struct(
                F.concat(s.done, F.substring(s.left, F.lit(1), F.instr(s.left, x.p) - 1), F.lit("⟦"), x.i.cast("string"), F.lit("⟧")).alias("done"),
                F.substring(s.left, F.instr(s.left, x.p) + F.length(x.p), F.length(s.left)).alias("left"),
            ),
            lambda s: F.concat(s.done, s.left),
        )

    once = marked(text, braces, F.lit(0))
    return marked(once, F.regexp_extract_all(rest, F.lit(r"(\\[Nnh])"), F.lit(1)), F.size(braces)), tokens
