"""Near-duplicate documents by b-bit MinHash.

Documents with equal shingle sets are one class first. The classes' minima are cut into bands for candidate
generation; of each minimum only four bits are kept, packed two to a byte. Candidates whose share of
equal lanes, corrected for chance, is far below the threshold are dropped; all others are compared on their
full sets, unless links already join them. Pairs are never written out: members of a bucket meet in blocks,
and what leaves a task are the links that join them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.arrow import LOWER, mixed, record, slices, small_batches, utf8
from lexiflow.llm.common import nested, small_side
from lexiflow.llm.links import components
from lexiflow.session import checkpoint, table

SHINGLE = 2
#: Least similarity in hundredths.
SIMILARITY = 80
#: A pair at the threshold shares no band with a chance of (1 - 0.8**4)**24, about 3 in a million.
BANDS, ROWS = 24, 4
LANES, BITS = BANDS * ROWS, 4
#: Pairs are dropped by signature alone this many standard errors below the threshold.
ERRORS = 5
#: Members of a bucket, about, that one task compares among themselves, or with as many others.
GROUP = 1_024
_random = np.random.default_rng(11)
TURNS = _random.integers(0, 1 << 32, LANES, np.uint64).astype(np.uint32)
FACTORS = _random.integers(0, 1 << 32, LANES, np.uint64).astype(np.uint32) | np.uint32(1)


class Names(dict):
    """Words to 16 bytes of a keyed hash each, as two numbers; made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        digest = hashlib.blake2b(word, digest_size=16, key=b"word").digest()
        self.digests += digest
        k = self[word] = len(self)
        return k

    def __init__(self):
        super().__init__()
        self.digests = bytearray()


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case; bytes.split() takes just the six blanks that part words."""
    return text.translate(LOWER).split() if text else []


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text two 64-bit hashes of its distinct shingles of `size` words, sorted by the first."""
    names = Names()
    numbers = [np.array(list(map(names.__getitem__, words_of(t))), np.int64) for t in texts]
    lanes = np.frombuffer(bytes(names.digests), np.uint64).reshape(-1, 2)[np.concatenate(numbers)]

    def chained(lanes: np.ndarray, width: int) -> np.ndarray:
        """Two hashes of each run of `width` words."""
        key = np.full((max(0, len(lanes) - width + 1), 2), width, np.uint64)
        for k in range(width):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + lanes[k : len(key) + k])
        return key

    # Of all texts at once; runs that reach into the next text are left out below.
    keys, out, at = chained(lanes, size), [], 0
    for n in map(len, numbers):
        # A shorter text is one shingle.
        key = keys[at : at + n - size + 1] if n >= size else chained(lanes[at : at + n], n)[: min(n, 1)]
        first, place = np.unique(key[:, 0], return_index=True)
        out.append((first, key[place, 1]))
        at += n
    return out


def exact_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted numbers of its distinct shingles; among these texts, equal numbers are equal words."""
    known: dict[bytes, int] = {}
    words = [np.array([known.setdefault(w, len(known) + 1) for w in words_of(t)], np.int64) for t in texts]
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    number = np.concatenate(words)
    first = np.arange(len(number))
    owner = np.repeat(np.arange(len(words)), ends - starts)
    name = number
    for k in range(1, size):
        # The k-th next word, 0 beyond the end of the text; pairs of numbers are ranked, so that they stay small.
        following = np.where(first + k < ends[owner], number[np.minimum(first + k, len(number) - 1)], 0)
        name = np.unique(name * (len(known) + 1) + following, return_inverse=True)[1].astype(np.int64) + 1
    whole = (first + size <= ends[owner]) | (first == starts[owner])  # a shorter text is one shingle
    return [np.unique(name[a:b][whole[a:b]]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(LANES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(low, ((x[None, k : k + 4096] ^ TURNS[:, None]) * FACTORS[:, None]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in low.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key.view(np.int64)


def packed(low: np.ndarray) -> bytes:
    """The lowest four bits of the minima, two to a byte."""
    bits = (low & np.uint32(15)).astype(np.uint8)
    return (bits[::2] | bits[1::2] << 4).tobytes()


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from packed signatures (rows of bytes), corrected for chance agreement."""
    differ = a ^ b
    equal = ((differ & 15) == 0).sum(axis=-1) + ((differ >> 4) == 0).sum(axis=-1)
    chance = 1 / (1 << BITS)
    return (equal / LANES - chance) / (1 - chance)


def least_estimate(similarity: int) -> float:
    s = similarity / 100
    return s - ERRORS * (s * (1 - s) / LANES) ** 0.5


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n, set_key (null for an empty set), bands, sig and tags for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary()), ("tags", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                n, keys, bands, sigs, tags = [], [], [], [], []
                for s, other in shingle_sets(utf8(part.column("text")), size):
                    low = minima(s)
                    n.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes() + other.tobytes(), digest_size=16).digest() if len(s) else None)
                    band = band_keys(low)
                    bands.append(band if len(s) else None)
                    tags.append(band.astype(np.uint32).tobytes() if len(s) else None)
                    sigs.append(packed(low) if len(s) else None)
                yield record(schema, part.column("doc_id"), n, keys, bands, sigs, tags)

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return wanted.mapInArrow(run, "doc_id long, n long, set_key binary, bands array<long>, sig binary, tags binary")


class Members:
    """Members of one bucket: set sizes, packed signatures and the low halves of all band keys."""

    def __init__(self, key: int, n: list[int], sig: list[bytes], tags: list[bytes], similarity: int):
        self.n, self.similarity = np.array(n), similarity
        self.sig = np.frombuffer(b"".join(sig), np.uint8).reshape(-1, LANES // 2)
        self.tags = np.frombuffer(b"".join(tags), np.uint32).reshape(-1, BANDS)
        self.band = int((self.tags[0] == np.uint32(key & 0xFFFFFFFF)).argmax())

    def likely(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others neither sizes nor signatures rule out as links of i.

        A pair counts only in the first band that it shares, so that it is judged once.
        """
        low, high = np.minimum(self.n[i], self.n[others]), np.maximum(self.n[i], self.n[others])
        others = others[100 * low >= self.similarity * high]
        others = others[(self.tags[others] == self.tags[i]).argmax(axis=1) == self.band]
        return others[estimates(self.sig[others], self.sig[i]) >= least_estimate(self.similarity)]


def groups(batches, keys: list[str]):
    """Tables of the rows with equal keys, from batches sorted by them."""
    rest = None
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        whole = pa.concat_tables([rest, whole]) if rest is not None else whole
        columns = [np.asarray(whole.column(k).to_numpy()) for k in keys]
        heads = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))) if whole.num_rows else np.zeros(0, np.int64)
        for i, j in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            yield whole.slice(i, j - i)
        rest = whole.slice(int(heads[-1])) if len(heads) else rest
    if rest is not None and rest.num_rows:
        yield rest


def pairs_of(group: pa.Table, similarity: int):
    """(i, later members that may be linked with i) of a meeting; of two blocks only pairs across them."""
    crossed = group.column("p")[0].as_py() != group.column("q")[0].as_py()
    block = np.asarray(group.column("block"))
    m = Members(group.column("key")[0].as_py(), *(group.column(c).to_pylist() for c in ("n", "sig", "tags")), similarity)
    for i in range(group.num_rows - 1):
        later = np.arange(i + 1, group.num_rows)
        later = m.likely(i, later[block[later] != block[i]] if crossed else later)
        if len(later):
            yield i, later


def meetings(classes: DataFrame, similarity: int) -> DataFrame:
    """key, p, q, block, id, n, sig and tags: who has someone to be compared with where.

    A bucket is dealt to blocks of about GROUP members by a hash of their ids before anything is compared; each
    pair of blocks meets in one task.
    """
    buckets = classes.select(F.explode("bands").alias("key"), "id")
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    shared = shared.select(F.col("key").alias("k"), F.ceil(F.col("m") / GROUP).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    members = buckets.join(shared, F.col("key") == F.col("k")).select("key", "id", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id")
    known = classes.select(F.col("id").alias("i"), "n", "sig", "tags")
    rows = members.join(known, F.col("id") == F.col("i")).select("key", "p", "q", "block", "id", "n", "sig", "tags")

    def run(batches):
        done: list[pa.Table] = []
        for group in groups(batches, ["key", "p", "q"]):
            needed = np.zeros(group.num_rows, bool)
            for i, later in pairs_of(group, similarity):
                needed[i] = True
                needed[later] = True
            if needed.any():
                done.append(group.filter(pa.array(needed)))
            if len(done) > 500:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done = []
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    at = ["key", "p", "q"]
    return rows.repartition(*at).sortWithinPartitions(*at).mapInArrow(run, "key long, p int, q int, block int, id long, n long, sig binary, tags binary")


def linked(meets: DataFrame, docs: DataFrame, similarity: int, size: int) -> DataFrame:
    """Links (a, b), confirmed on full shingle sets, that join all members of a meeting which links can join."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where(F.col("doc_id").isNotNull())
    rows = meets.join(texts, F.col("id") == F.col("doc")).select("key", "p", "q", "block", "id", "n", "sig", "tags", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for group in groups((x for batch in batches for x in slices(batch)), ["key", "p", "q"]):
            ids = group.column("id").to_pylist()
            sets = exact_sets(utf8(group.column("text").combine_chunks()), size)
            top, found = list(range(len(ids))), []

            def root(i: int, top: list[int]) -> int:
                while top[i] != i:
                    top[i] = top[top[i]]
                    i = top[i]
                return i

            for i, later in pairs_of(group, similarity):
                for j in later.tolist():
                    x, y = root(i, top), root(j, top)
                    if x != y and similar(sets[i], sets[j], similarity):
                        top[y] = x
                        found.append((ids[i], ids[j]))
            if found:
                yield record(schema, *map(list, zip(*found, strict=True)))

    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= similarity * union."""
    if not len(a) or not len(b):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= similarity * (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of docs.

    Null and wordless texts have an empty set and are components of their own. Rows without a doc_id get no
    component and are kept. Equal rows share their component and are all kept or none. Where rows repeat a
    doc_id with other texts, the sets that no smaller doc_id has are compared by one of them, chosen by its
    key. Extra columns are ignored; an empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        signed = checkpoint(signatures(docs, size))
        known = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
        least = known.groupBy("set_key").agg(F.min("doc_id").alias("least"))
        stand_in = least.groupBy("least").agg(F.min("set_key").alias("k"))
        first = known.join(stand_in, (F.col("set_key") == F.col("k")) & (F.col("doc_id") == F.col("least")))
        classes = first.select(F.col("doc_id").alias("id"), "n", "bands", "sig", "tags").dropDuplicates(["id"])
        links = checkpoint(linked(meetings(classes, similarity), docs, similarity, size))
    joined = components(links).withColumnRenamed("id", "member")
    reps = least.join(joined, F.col("least") == F.col("member"), "left").select(F.col("set_key").alias("k"), F.coalesce("component", "least").alias("component"))
    return (
        signed.select("doc_id", "n", "set_key")
        .join(reps, F.col("set_key") == F.col("k"), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, similarity: int = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns; rows that share a doc_id go together."""
    gone = checkpoint(near_duplicates(docs, similarity, size).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct())
    rows = docs.select(nested(), docs["doc_id"].cast("long").alias("id"))
    return rows.join(small_side(gone), F.col("id") == F.col("gone"), "left_anti").select("row.*")


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
