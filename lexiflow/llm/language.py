"""Language identification with language-bitmask n-gram filters.

One Bloom filter holds the n-grams of all languages: every slot is a mask of languages, and the AND of the
slots of an n-gram names all languages that contain it. A document counts its n-grams for each language,
corrects the counts for the filter's false positives and takes the largest share.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.arrow import LOWER, record, slices, small_batches, utf8
from lexiflow.llm.common import small_side
from lexiflow.session import checkpoint, table

#: The filter is fitted on about so many documents of each language (a seeded sample; see learn()).
SAMPLE_DOCS = 2_000
#: The most frequent n-grams kept for each language.
GRAMS = 2_000
SLOT_BITS, PROBES = 17, 3
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: A-Z to a-z, all other ASCII but letters to a blank.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in LOWER)
BETWEEN = b"   "


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5; null for null."""
    return F.crc32(doc_id.cast("string")) % 5


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Four-byte grams of all texts, blank-padded, as uint32; where each text starts, and their numbers."""
    data = np.frombuffer((BETWEEN.join([b"", *texts, b""])).translate(LETTERS), np.uint8).astype(np.uint32)
    n = np.array([len(t) + len(BETWEEN) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    return data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24, starts, n


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def slots(grams_: np.ndarray) -> list[np.ndarray]:
    mixed = grams_ ^ (grams_ >> np.uint32(15))
    return [(mixed * np.uint32(m)) >> np.uint32(32 - SLOT_BITS) for m in MULTIPLIERS[:PROBES]]


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, keep: int = GRAMS) -> tuple[list[str], np.ndarray]:
    """The languages, and the filter: for each block of 64 languages the masks of all slots.

    Only documents of the folds 1 to 4 with a language teach. Of each language a share is drawn by a hash
    of doc_id so that about sample_docs documents remain; their whole texts are counted.
    """
    taught = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, 1 << SLOT_BITS), np.uint64)
    share = docs.sparkSession.createDataFrame([(k, min(1.0, sample_docs / n)) for k, n in sizes.items()], "name string, share double")
    drawn = taught.join(small_side(share), F.col("lang") == F.col("name")).where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003
    )
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in slices(batch):
                names, texts = part.column("lang").to_pylist(), utf8(part.column("text"))
                for name in set(names):
                    g, n = np.unique(grams([t for t, x in zip(texts, names, strict=True) if x == name])[0], return_counts=True)
                    if name in found:
                        g0, n0 = found[name]
                        g, inverse = np.unique(np.concatenate((g0, g)), return_inverse=True)
                        n = np.bincount(inverse, weights=np.concatenate((n0, n))).astype(np.int64)
                    found[name] = g, n
        for name, (g, n) in found.items():
            yield record(schema, [name] * len(g), g.astype(np.int64), n)

    counted = drawn.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    masks = np.zeros(((len(langs) + 63) // 64, 1 << SLOT_BITS), np.uint64)
    # The kept n-grams: at most `keep` for each language, whatever the size of the corpus.
    with small_batches(docs.sparkSession):
        best = counted.withColumn("rank", rank).where(F.col("rank") <= keep).select("lang", "gram").toPandas()
    for name, g in best.groupby("lang")["gram"]:
        k = langs.index(name)
        for at in slots(g.to_numpy().astype(np.uint32)):
            masks[k // 64, at] |= np.uint64(1 << k % 64)
    return langs, masks


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score, one row for each row of docs; reads doc_id only to return it.

    Null texts and texts without a letter are `und` with score 0, as is everything if no language was
    learned. Ties go to the language that sorts first. Whole texts count, however long; repeated rows are
    judged each; other columns are ignored.
    """
    langs, masks = model
    n_langs = len(langs)
    bits = [(masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1) for k in range(n_langs)]
    false = np.array([float(b.mean()) ** PROBES for b in bits])
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [t or b"" for t in utf8(part.column("text"))]
                lettered = [has_letter(t) for t in texts]
                share = np.zeros((n_langs, len(texts)))
                if n_langs and texts:
                    g, starts, n = grams(texts)
                    blank = g == 0x20202020
                    total = np.maximum(n - np.add.reduceat(blank, starts, dtype=np.int64), 1)
                    at = slots(g)
                    for block in range(len(masks)):
                        mask = masks[block][at[0]]
                        for other in at[1:]:
                            mask &= masks[block][other]
                        mask[blank] = 0
                        for k in range(block * 64, min(n_langs, block * 64 + 64)):
                            hits = np.add.reduceat((mask >> np.uint64(k % 64)).astype(np.uint8) & 1, starts, dtype=np.int64)
                            share[k] = np.maximum(0.0, (hits / total - false[k]) / max(1e-9, 1 - false[k]))
                best = share.argmax(axis=0) if n_langs else np.zeros(len(texts), int)
                top, sums = (share.max(axis=0), share.sum(axis=0)) if n_langs else (np.zeros(len(texts)),) * 2
                known = np.array(lettered, bool) & (n_langs > 0)
                score = np.where(known & (sums > 0), top / np.maximum(sums, 1e-12), 0.0)
                yield record(schema, part.column("doc_id"), [langs[b] if y else "und" for b, y in zip(best, known, strict=True)], score)

    with small_batches(docs.sparkSession):
        return checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
