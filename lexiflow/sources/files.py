"""Project folders as a table of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions.encoding import decoded

# Which extensions are which kind, in the order in which kinds are tried.
KINDS = {
    "subtitle": ("srt", "vtt", "ass", "ssa", "lrc", "sub", "smi"),
    "ebook": ("epub", "pdf", "html", "htm", "xhtml", "xht"),
    "image": ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tif", "tiff", "tga", "dds", "avif", "jfif"),
    "comic": ("cbz", "zip"),
    "video": ("mp4", "mkv", "avi", "mov", "webm", "m4v", "wmv", "flv", "ts", "mpg", "mpeg"),
    "game": ("json", "csv", "tsv", "po", "pot", "txt", "ini", "yaml", "yml", "rpy", "rxdata", "rvdata", "rvdata2", "ks", "tjs", "scn"),
}
SKIPPED_FOLDERS = ("node_modules", ".git", ".svn", "tl", "dist", "build", "out", "backup", "target", "bin", "obj", "__pycache__")
DATABASE_NAMES = "Actors|Classes|Skills|Items|Weapons|Armors|Enemies|States|Troops|CommonEvents|System"
MOST_FILES, MOST_IMAGES, MOST_DEPTH = 2_000, 400, 10
MOST_BINARY_BYTES, MOST_TEXT_BYTES = 40 << 20, 16 << 20


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def folder(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"^(.*)/[^/]*$", 1)


def relative(path: Column, root: str) -> Column:
    """path below root, without a scheme or a leading slash."""
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    start = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.when(F.startswith(plain, F.lit(start)), F.substring(plain, F.lit(len(start) + 1), F.length(plain))).otherwise(F.regexp_replace(plain, "^/+", ""))


def kind_of(ext: Column) -> Column:
    """The kind of an extension; empty if it is none of ours."""
    out = F.lit("")
    for name in reversed(KINDS):
        out = F.when(ext.isin(*KINDS[name]), F.lit(name)).otherwise(out)
    return out


def engine_of(name: Column) -> Column:
    """The engine that a file name tells of; empty if none."""
    ruby = r"\.(rxdata|rvdata2?)$"
    return (
        F.when(name.rlike(r"(?i)^Map[0-9]{3}\.json$"), F.lit("rpgmaker-map"))
        .when(name.rlike(rf"(?i)^Map[0-9]{{3}}{ruby}"), F.lit("rgss-map"))
        .when(name.rlike(rf"(?i)^({DATABASE_NAMES})\.json$"), F.lit("rpgmaker-db"))
        .when(name.rlike(rf"(?i)^({DATABASE_NAMES}){ruby}"), F.lit("rgss-db"))
        .when(name.rlike(rf"(?i)^Scripts{ruby}"), F.lit("rgss-scripts"))
        .otherwise(F.lit(""))
    )


def wanted(rel: Column) -> Column:
    """Whether a path has no skipped or dotted part and is not too deep."""
    parts = F.split(F.lower(rel), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return ~F.exists(parts, lambda p: F.startswith(p, F.lit("."))) & ~F.exists(folders, lambda p: p.isin(*SKIPPED_FOLDERS)) & (F.size(parts) <= MOST_DEPTH + 1)


def described(paths: DataFrame, root: str = "") -> DataFrame:
    """path, rel, ext, kind and engine for a frame of paths; other columns stay."""
    return (
        paths.withColumn("rel", relative(F.col("path"), root))
        .withColumn("ext", extension(F.col("rel")))
        .withColumn("kind", kind_of(F.col("ext")))
        .withColumn("engine", engine_of(base_name(F.col("rel"))))
    )


def scan(spark: SparkSession, root: str, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The files below root: path, rel, ext, kind, engine, length and content.

    Skipped folders, dotted names, other extensions and depths are left out, and so is what `limit` (1 to
    MOST_FILES, all by default) cuts off in the order of rel. content is read only if something selects it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = described(files.select("path", "length", "content"), root).where(wanted(F.col("rel")) & (F.col("kind") != ""))
    if kinds:
        found = found.where(F.col("kind").isin(*kinds))
    if limit is not None:
        found = found.orderBy("rel").limit(min(max(limit, 1), MOST_FILES))
    return found


def kind_counts(files: DataFrame) -> DataFrame:
    """kind and n for every kind, also those without a file."""
    kinds = files.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    counted = files.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(F.broadcast(counted), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))  # one row a kind


def texts(files: DataFrame, most: int = MOST_TEXT_BYTES) -> DataFrame:
    """files with text, encoding and bom decoded from content; longer files are left out."""
    return files.where(F.col("length") <= most).withColumn("_t", decoded(F.col("content"))).select("*", "_t.text", "_t.encoding", "_t.bom").drop("_t")


def hashes(files: DataFrame) -> DataFrame:
    """path and sha256 of the content; null where there is none."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))
