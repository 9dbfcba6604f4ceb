"""Image fragments that belong together: words of one line, and numbered pieces of one label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.geometry import usable
from lexiflow.functions.text import stripped
from lexiflow.session import dealt

# Scripts written without blanks between words.
UNSPACED = r"[ᄀ-ᇿ⺀-鿿가-힯豈-﫿︰-﹏＀-｠￠-￦]"
OVERLAP, GAP, HEIGHTS, LEAST_PARTS = 0.5, 2.5, 2.5, 2
PAREN, TAIL = r"^(.*?)\(([0-9]+)\)$", r"^(.*?)[_\- ]([0-9]+)$"
GROUP = "id string, kind string, file string, page int, page_entry string, members array<string>, union_box array<double>, text string, separator string"


def file_parts(file: Column) -> tuple[Column, Column]:
    """(folder, name without extension)."""
    path = F.replace(file, F.lit("\\"), F.lit("/"))
    name = F.substring_index(path, "/", -1)
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def numbered_name(name: Column) -> tuple[Column, Column]:
    """(stem, number) of `stem(3)`, `stem_04`, `stem-1` or `stem 2`; nulls for other names."""
    stem, number = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern in (TAIL, PAREN):
        stem = F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1)).otherwise(stem)
        number = F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 2)).otherwise(number)
    return stem, number.try_cast("bigint")


def good(fragments: DataFrame) -> DataFrame:
    """Fragments with a file, a text (maybe empty) and a box that has a size."""
    return fragments.where((F.coalesce("file", F.lit("")) != "") & F.col("text").isNotNull() & usable(F.col("box")))


def joined(ordered: Column) -> tuple[Column, Column]:
    """(text, separator) of an ordered array of texts: no blank where any of them is of an unspaced script."""
    sep = F.when(F.exists(ordered, lambda t: t.rlike(UNSPACED)), F.lit("")).otherwise(F.lit(" "))
    words = F.filter(F.transform(ordered, stripped), lambda t: t != "")
    spaced = F.aggregate(words, F.lit(""), lambda acc, t: F.when(acc == "", t).otherwise(F.concat(acc, sep, t)))
    return spaced, sep


def _line_starts(boxes: Column) -> Column:
    """For an array of boxes in reading order the place of the one that opened the line of each: the first that it overlaps."""

    def step(s: Column, box: Column) -> Column:
        y, h = box[1], box[3]

        def on_line(o: Column) -> Column:
            common = F.least(y + h, o.y + o.h) - F.greatest(y, o.y)
            return (common >= OVERLAP * F.least(h, o.h)) & (F.greatest(h, o.h) <= HEIGHTS * F.least(h, o.h))

        opener = F.get(F.filter(s.opened, on_line), F.lit(0))
        here = F.struct(s.n.alias("k"), y.alias("y"), h.alias("h"))
        return F.struct(
            F.when(opener.isNull(), F.array_append(s.opened, here)).otherwise(s.opened).alias("opened"),
            F.array_append(s.starts, F.coalesce(opener.k, s.n)).alias("starts"),
            (s.n + 1).alias("n"),
        )

    none = F.array().cast("array<struct<k:int,y:double,h:double>>")
    start = F.struct(none.alias("opened"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"))
    return F.aggregate(boxes, start, step, lambda s: s.starts)


def with_lines(fragments: DataFrame) -> DataFrame:
    """good fragments with line: which fragment of the same file and page opened their line.

    Lines are found from top to bottom, each fragment joining the first whose opener it overlaps; what a
    fragment joins depends on all before it, so a page is one array. A page has few fragments.
    """
    box = F.col("box")
    each = F.struct(box[1].alias("y"), box[0].alias("x"), "id", "page_entry", "box", "text", "kind")
    pages = good(fragments).groupBy("file", "page").agg(F.array_sort(F.collect_list(each)).alias("m"))
    lines = pages.withColumn("starts", _line_starts(F.transform("m", lambda f: f.box)))
    out = lines.select("file", "page", F.explode(F.arrays_zip("m", "starts")).alias("z"))
    return out.select("z.m.id", "file", "page", "z.m.page_entry", "z.m.box", "z.m.text", "z.m.kind", F.col("z.starts").alias("line"))


def atlas_groups(fragments: DataFrame, least: int = LEAST_PARTS) -> DataFrame:
    """Groups of neighbours on a line, cut where a gap is wider than GAP times the line's median height."""
    line = Window.partitionBy("file", "page", "line")
    order = line.orderBy(F.col("box")[0], F.col("box")[1], "id")
    h = F.col("box")[3]
    sized = (
        dealt(with_lines(fragments), "file", "line")
        .withColumn("n", F.count(F.lit(1)).over(line))
        .withColumn("spread", F.max(h).over(line) / F.min(h).over(line))
        .withColumn("height", F.median(h).over(line))
        .where((F.col("n") >= least) & (F.col("spread") <= HEIGHTS))
        .withColumn("right", F.lag(F.col("box")[0] + F.col("box")[2]).over(order))
        .withColumn("cut", F.coalesce((F.col("box")[0] - F.col("right") > GAP * F.col("height")).cast("int"), F.lit(0)))
        .withColumn("phrase", F.sum("cut").over(order))
    )
    return _grouped(sized, ["file", "page", "line", "phrase"], F.struct(F.col("box")[0], F.col("box")[1], "id"), "atlas", least)


def _grouped(rows: DataFrame, keys: list[str], order: Column, kind: str, least: int) -> DataFrame:
    box = F.col("box")
    x, y = F.min(box[0]), F.min(box[1])
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), "id", "text", "file", "page", "page_entry", "box")))
    got = (
        rows.groupBy(*keys)
        .agg(listed.alias("m"), F.array(x, y, F.max(box[0] + box[2]) - x, F.max(box[1] + box[3]) - y).alias("around"))
        .where(F.size("m") >= least)
        .withColumn("texts", F.expr("transform(m, x -> x.text)"))
    )
    text, sep = joined(F.col("texts"))
    head = F.col("m")[0]
    return got.select(
        F.concat(F.lit("g:"), head.id, F.lit("+"), F.size("m")).alias("id"),
        F.lit(kind).alias("kind"),
        head.file.alias("file"),
        (head.page if kind == "atlas" else F.lit(None)).cast("int").alias("page"),
        (head.page_entry if kind == "atlas" else F.lit(None)).cast("string").alias("page_entry"),
        F.expr("transform(m, x -> x.id)").alias("members"),
        (F.col("around") if kind == "atlas" else head.box).alias("union_box"),
        text.alias("text"),
        sep.alias("separator"),
    )


def sequence_runs(rows: DataFrame, stem: list[str], number: str, kind: str, tie: list[Column]) -> DataFrame:
    """rows with run: pieces of one stem with consecutive numbers and one kind; the first of equal numbers stays."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*stem, number).orderBy(*tie))).where(F.col("_n") == 1).drop("_n")
    w = Window.partitionBy(*stem).orderBy(number)
    same = (F.col(number) == F.lag(number).over(w) + 1) & F.col(kind).eqNullSafe(F.lag(kind).over(w))
    return first.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("run", F.sum("_new").over(w)).drop("_new")


def sequence_groups(fragments: DataFrame, least: int = LEAST_PARTS) -> DataFrame:
    """Groups of single-image fragments whose file names count up."""
    dir_, name = file_parts(F.col("file"))
    stem, number = numbered_name(name)
    named = good(fragments).where(F.col("page").isNull()).withColumn("dir", dir_).withColumn("stem", stem).withColumn("number", number)
    tie = [F.col("file"), F.col("page_entry"), F.col("box")[1], F.col("box")[0], F.col("id")]
    runs = sequence_runs(named.where(F.col("number").isNotNull()), ["dir", "stem"], "number", "kind", tie)
    return _grouped(runs, ["dir", "stem", "run"], F.struct("number"), "sequence", least)


def grouped(fragments: DataFrame, mode: str = "auto", least: int = LEAST_PARTS) -> tuple[DataFrame, DataFrame]:
    """(groups, singles). auto looks for lines first and for sequences among the rest; filename for sequences only; none groups nothing."""
    least = max(1, least)
    if mode == "none":
        return fragments.sparkSession.createDataFrame([], GROUP), fragments
    found = sequence_groups(fragments, least)
    if mode != "filename":
        lines = atlas_groups(fragments, least)
        taken = lines.select(F.explode("members").alias("id"))
        found = lines.unionByName(sequence_groups(fragments.join(taken, "id", "left_anti"), least))
    found = numbered_ids(found)
    return found, fragments.join(found.select(F.explode("members").alias("id")), "id", "left_anti")


def numbered_ids(groups: DataFrame) -> DataFrame:
    """groups of which equal ids have #2, #3 … at their end, in the order of file, page, kind and place."""
    order = Window.partitionBy("id").orderBy(F.col("file"), F.col("page").asc_nulls_first(), "kind", F.col("union_box")[1], F.col("union_box")[0], F.col("members"))
    numbered = groups.withColumn("_n", F.row_number().over(order))
    return numbered.withColumn("id", F.when(F.col("_n") > 1, F.concat("id", F.lit("#"), "_n")).otherwise(F.col("id"))).drop("_n")


def mean_ink(groups: DataFrame, fragments: DataFrame) -> DataFrame:
    """id and ink: the mean ink of each group's fragments (id, ink)."""
    members = groups.select("id", F.explode("members").alias("member"))
    return members.join(fragments.select(F.col("id").alias("member"), "ink"), "member").groupBy("id").agg(F.avg("ink").alias("ink"))


def in_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy("file", F.col("page").asc_nulls_first(), "page_entry", "kind", F.col("union_box")[1], F.col("union_box")[0], "id")


def group_counts(groups: DataFrame) -> DataFrame:
    """One row: groups of either kind and members of all."""
    return groups.agg(
        F.count_if(F.col("kind") == "atlas").alias("atlas"), F.count_if(F.col("kind") == "sequence").alias("sequence"), F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("members")
    )


def reading_units(groups: DataFrame, pages: DataFrame, most: int = 8, area: int = 420_000) -> DataFrame:
    """Groups of up to `most` members; those of file names only if all their pages (id, width, height) are sprite-sized."""
    sized = groups.select("id", F.explode("members").alias("m")).join(pages.select(F.col("id").alias("m"), (F.col("width") * F.col("height")).alias("a")), "m", "left")
    small = sized.groupBy("id").agg(F.coalesce(F.bool_and((F.col("a") > 0) & (F.col("a") <= area)), F.lit(False)).alias("small"))
    return groups.join(small, "id").where((F.size("members") <= most) & ((F.col("kind") == "atlas") | F.col("small"))).drop("small")


def suspected(files: DataFrame, least_images: int = 6, samples: int = 3) -> DataFrame:
    """One row: whether the images of a project (rel, kind) look like labels in numbered pieces, with the names of some groups."""
    image = files.where("kind = 'image'").select(
        F.col("rel").alias("id"), F.col("rel").alias("file"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("page_entry"),
        F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("box"), F.lit("").alias("text"), F.lit("").alias("kind"),
    )
    # A row for each image, then one for each group: the sums need no join.
    counted = image.select(F.lit(1).alias("i"), F.lit(0).alias("g"), F.lit(None).cast("string").alias("file")).union(sequence_groups(image).select(F.lit(0), F.lit(1), "file"))
    names = F.slice(F.array_sort(F.collect_set("file")), 1, samples)
    one = counted.agg(F.coalesce(F.sum("i"), F.lit(0)).alias("images"), F.coalesce(F.sum("g"), F.lit(0)).alias("groups"), names.alias("samples"))
    return one.withColumn("suspected", (F.col("images") >= least_images) & (F.col("groups") > 0))
