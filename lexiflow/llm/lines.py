"""Near-duplicate lines by a segment-partition edit join.

How many edits two lines may be apart goes by the length of the shorter one (EDITS). A line that is within t
edits of another keeps one of the other's t + 1 segments unchanged, at a place that the edits before it can
have shifted. Each line is therefore filed under its segments, and under those of its substrings that could be
a segment of a line of up to t characters less. A line filed by a segment is compared with all others in that
file by a bit-parallel automaton of t errors, in a band of t to either side. Equal lines are one line
throughout, and a file holds lines of one length with one segment, so that only distinct lines that are nearly
the same meet. Large files are cut into blocks before lines are compared. Links are never written out: what
leaves a task are the links that join its lines, and the number of links of each line.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.arrow import BASES, Rolling, mixed, record, slices, small_batches
from lexiflow.llm.common import nested, small_side
from lexiflow.llm.links import components
from lexiflow.llm.minhash import groups
from lexiflow.session import checkpoint, table

#: (characters, edits): lines of at least so many characters, the shorter one of two, are linked within so many
#: edits. Shorter lines are only compared for being equal.
EDITS = ((12, 1), (24, 2))
#: White space, of which the blank lines between paragraphs are made.
BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
#: Keys of lines that are packed together for the way.
BLOCK_KEYS = 1_500_000
#: Bytes of text for each bucket of keys.
BUCKET_BYTES = 16 << 20
#: Lines of a file, about, that one task compares among themselves, or with as many others.
GROUP = 2_048
#: Characters of lines that are compared with one at once.
MATRIX = 4_000_000
#: Stands for a null doc_id, which comes after all others.
LAST = (1 << 63) - 1


def within(a: str, b: str, edits: int) -> bool:
    """Whether a can be changed into b by so many insertions, deletions and substitutions of characters."""
    if abs(len(a) - len(b)) > edits:
        return False
    k = common(a, b)
    a, b = a[k:], b[k:]
    k = common(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 2 << i
    # Bit i of state j: the first i characters of a match what was read of b with j errors.
    states = [(2 << j) - 1 for j in range(edits + 1)]
    for n, c in enumerate(b, 1):
        band = ((2 << 2 * edits) - 1) << max(0, n - edits) if n > edits else (2 << n + edits) - 1
        here, old = places.get(c, 0), 0
        for j, state in enumerate(states):
            new = state << 1 & here
            if j:
                new |= old | old << 1 | states[j - 1] << 1
            old, states[j] = state, new & band
        if not states[-1]:
            return False
    return bool(states[-1] >> len(a) & 1)


def within_all(a: np.ndarray, others: list[np.ndarray], edits: int) -> np.ndarray:
    """within() of a and each of the others, as code points, for all others of one length together.

    Bit d of a state after n characters stands for the first n + d - edits characters of a; so few bits are
    needed because states move along the diagonal.
    """
    near, lengths = np.zeros(len(others), bool), np.array([len(x) for x in others])
    padded = np.concatenate((np.full(edits, 0xFFFFFFFF, np.uint32), a, np.full(2 * edits + 1, 0xFFFFFFFF, np.uint32)))
    for length in np.unique(lengths[np.abs(lengths - len(a)) <= edits]).tolist():
        at = np.flatnonzero(lengths == length)
        for part in np.array_split(at, 1 + len(at) * length // MATRIX):
            text = np.stack([others[k] for k in part.tolist()]).T
            states = [np.full(len(part), ((2 << j) - 1) << edits, np.uint32) for j in range(edits + 1)]
            for n in range(1, length + 1):
                match = np.zeros(len(part), np.uint32)
                for d in range(2 * edits + 1):
                    match |= (text[n - 1] == padded[n - 1 + d]).astype(np.uint32) << np.uint32(d)
                mask = np.uint32(((1 << min(2 * edits + 1, max(0, len(a) - n + edits + 1))) - 1))
                old = np.zeros(len(part), np.uint32)
                for j, state in enumerate(states):
                    new = state & match
                    if j:
                        new |= old | old >> np.uint32(1) | states[j - 1] << np.uint32(1)
                    old, states[j] = state, new & mask
            near[part] = states[-1] >> np.uint32(len(a) - length + edits) & np.uint32(1)
    return near


def common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def allowed(length: int, rule) -> int:
    return max((e for least, e in rule if length >= least), default=0)


def segment(length, i: int, parts: int):
    """Start and length of the i-th of so many even segments; the longer ones come last."""
    base, more = length // parts, length % parts
    longer = np.maximum(0, i - (parts - more))
    return base * i + longer, base + (i >= parts - more)


def shifts(i: int, less: int, edits: int) -> range:
    """Where segment i of a line may stand in one that has `less` characters more, as shifts of its place."""
    return range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)


def filed(symbols: Rolling, start: np.ndarray, length: np.ndarray, rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, own, segment): all keys under which lines are filed, own ones being their segments; line is a place in start."""
    lines, keys, own, nth = [], [], [], []
    every = np.arange(len(start))
    bounds = [*rule, (np.iinfo(np.int64).max, 0)]
    for (least, edits), (above, _) in zip(bounds, bounds[1:], strict=False):
        for less in range(edits + 1):
            other = length - less  # of the line whose segment it might be
            for i in range(edits + 1):
                at, size = segment(other, i, edits + 1)
                for shift in shifts(i, less, edits):
                    ok = (other >= least) & (other < above) & (at + shift >= 0) & (at + shift + size <= length)
                    a = start[ok] + (at + shift)[ok]
                    tag = mixed(other[ok].astype(np.uint64) * np.uint64(64) + np.uint64(i))
                    lines.append(every[ok])
                    keys.append(mixed(symbols.ranges(a, a + size[ok]) ^ tag))
                    own.append(np.full(len(a), not less and not shift))
                    nth.append(np.full(len(a), i, np.uint8))
    return np.concatenate(lines), np.concatenate(keys), np.concatenate(own), np.concatenate(nth)


@lru_cache(1 << 16)
def windows(length: int, less: int, edits: int) -> list[tuple[int, int, int, int]]:
    """For each segment of a line its start and end, and those of where it may stand in a line with `less` characters more."""
    out = []
    for i in range(edits + 1):
        at, size = (int(x) for x in segment(length, i, edits + 1))
        moves = shifts(i, less, edits)
        # No move is possible, an empty window that holds no segment, where moves is empty.
        out.append((at, at + size, max(0, at + moves[0]), at + size + moves[-1]) if moves else (at, at + size, 0, 0))
    return out


def first_meeting(a: str, b: str, a_first: bool, edits: int) -> tuple[bool, int]:
    """Of the files in which a and b meet, the one that counts: whether its segment is a's, and which.

    The shorter line's segments come before the other's; of equal lengths those of the one that is first.
    """
    for own, other in ((a, b), (b, a)) if (len(a), not a_first) < (len(b), a_first) else ((b, a), (a, b)):
        if len(own) <= len(other):
            for i, (at, end, low, high) in enumerate(windows(len(own), len(other) - len(own), edits)):
                if own[at:end] in other[low:high]:
                    return own is a, i
    raise AssertionError("lines within the edits share a segment")


def spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts; start, length, text and number in its text of each line."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.append(np.flatnonzero(points == 10), len(points))
    starts = np.concatenate(([0], ends[:-1] + 1))
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    owner = np.searchsorted(edges, starts, side="right") - 1
    first = np.searchsorted(starts, edges)
    return points, starts, ends - starts, owner, np.arange(len(starts)) - first[owner]


def named(lines: list[str]) -> np.ndarray:
    """Two numbers for each line, from a keyed hash of 128 bits."""
    digests = b"".join(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16, key=b"line").digest() for x in lines)
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def versioned(docs: DataFrame) -> list:
    """What names a row: its doc_id and two hashes of its text. Equal rows share their name."""
    return [docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("version"), F.xxhash64(F.lit(7), docs["text"]).alias("check_version")]


ROW = ["doc_id", "version", "check_version"]


def line_table(docs: DataFrame) -> DataFrame:
    """rid, doc_id, version, check_version, line, id, check, n_lines: each line that is not empty; line -1 stands for the row itself.

    id and check are the two halves of the line's hash; n_lines counts the lines of the row.
    """
    schema = pa.schema([("rid", pa.int64()), *((c, pa.int64()) for c in ROW), ("line", pa.int32()), ("id", pa.int64()), ("check", pa.int64()), ("n_lines", pa.int32())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                points, start, length, owner, number = spans(texts)
                n_lines = np.bincount(owner, minlength=len(texts))
                none = pa.nulls(len(texts), pa.int64())
                yield record(schema, *(part.column(c) for c in ("rid", *ROW)), np.full(len(texts), -1), none, none, n_lines)
                ink = np.concatenate(([0], np.cumsum(~np.isin(points, BLANKS))))
                some = ink[start + length] > ink[start]
                ids = named([x for t in texts for x in t.split("\n")])[some] if some.any() else np.zeros((0, 2), np.int64)
                at = pa.array(owner[some])
                yield record(schema, *(part.column(c).take(at) for c in ("rid", *ROW)), number[some], ids[:, 0], ids[:, 1], n_lines[owner[some]])

    known = docs.select(F.monotonically_increasing_id().alias("rid"), *versioned(docs), docs["text"].alias("text"))
    return known.mapInArrow(run, "rid long, doc_id long, version long, check_version long, line int, id long, check long, n_lines int")


def sketches(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 parities for each line: how often characters of 32 classes, and pairs of 32 classes, stand in it.

    An edit changes at most two of the former and four of the latter.
    """
    x = points.astype(np.uint64)
    one = mixed(x) & np.uint64(31)
    two = mixed(x * np.uint64(0x100000001) + np.append(x[1:], np.uint64(10))) & np.uint64(31)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.bitwise_xor.accumulate(np.uint64(1) << one ^ np.uint64(1) << (two + np.uint64(32)), out=sums[1:])
    return sums[end] ^ sums[start]


def alike(sketch: np.ndarray, other: np.uint64, edits: int) -> np.ndarray:
    """Which sketches can be those of lines within so many edits of the other line."""
    differ = sketch ^ other
    return (np.bitwise_count(differ & np.uint64(0xFFFFFFFF)) <= 2 * edits) & (np.bitwise_count(differ >> np.uint64(32)) <= 4 * edits)


def likely(own: np.ndarray, sketch: np.ndarray, block: np.ndarray | None, edits: int):
    """(i, others that may be linked with i) of one file, which is in order of ~own; each pair once, from a line filed by its segment."""
    for i in range(int(own.sum())):
        later = slice(i + 1, None)
        ok = alike(sketch[later], sketch[i], edits)
        if block is not None:
            ok &= block[later] != block[i]
        others = np.flatnonzero(ok) + i + 1
        if len(others):
            yield i, others


def meetings(docs: DataFrame, rule, buckets: int) -> DataFrame:
    """key, segment, p, q, block, own, id: which lines are compared where; each has someone to be compared with, or is in a large file."""
    most = max(e for _, e in rule)
    packed = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def distinct(key, ids, sketch, own, nth):
        """Entries in order of key, own ones first; a line that is filed twice under a key, once."""
        order = np.lexsort((ids, key))
        # Of equal entries the line's own segment stays.
        key, ids, own = key[order], ids[order], own[order]
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])))) if len(key) else np.zeros(0, np.int64)
        own = np.logical_or.reduceat(own, new) if len(new) else own
        key, ids, sketch, nth = key[new], ids[new], sketch[order][new], nth[order][new]
        order = np.lexsort((~own, key))
        return key[order], ids[order], sketch[order], own[order], nth[order]

    def blobs(parts: list[tuple]) -> pa.RecordBatch:
        key, ids, sketch, own, nth = distinct(*map(np.concatenate, zip(*parts, strict=True)))
        bucket = (key % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        key, ids, sketch, bucket = key[order], ids[order], sketch[order], bucket[order]
        flags = own[order].astype(np.uint8) << np.uint8(7) | nth[order]
        heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        made = []
        for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(key)], strict=True):
            raw = np.diff(key[i:j], prepend=np.uint64(0)).tobytes() + ids[i:j].tobytes() + sketch[i:j].tobytes() + flags[i:j].tobytes()
            made.append(len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True))
        return record(packed, bucket[heads], made)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                points, start, length, _, _ = spans(texts)
                long = np.flatnonzero(length >= rule[0][0])
                if not len(long):
                    continue
                split = [x for t in texts for x in t.split("\n")]
                ids, at = np.unique(named([split[k] for k in long.tolist()])[:, 0], return_index=True)
                start, length = start[long][at], length[long][at]
                sketch = sketches(points, start, start + length)
                line, key, own, nth = filed(Rolling(points.astype(np.uint64) + np.uint64(1), BASES[0]), start, length, rule)
                parts.append((key, ids[line], sketch[line], own, nth))
                size += len(key)
                if size >= BLOCK_KEYS:
                    yield blobs(parts)
                    parts, size = [], 0
        if parts:
            yield blobs(parts)

    found = pa.schema([("key", pa.int64()), ("segment", pa.int32()), ("block", pa.int32()), ("blocks", pa.int32()), ("own", pa.bool_()), ("id", pa.int64()), ("sketch", pa.int64())])

    def meet(group: pa.Table) -> pa.Table:
        parts = []
        for blob in group.column("blob").to_pylist():
            raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
            n = len(raw) // 25
            flags = np.frombuffer(raw, np.uint8, n, 24 * n)
            parts.append((np.cumsum(np.frombuffer(raw, np.uint64, n), dtype=np.uint64), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.uint64, n, 16 * n), flags >= 128, flags & np.uint8(127)))
        key, ids, sketch, own, nth = distinct(*map(np.concatenate, zip(*parts, strict=True)))
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        tails = np.append(heads[1:], len(key))
        several = (tails - heads > 1) & own[heads]
        keep, blocks = np.zeros(len(key), bool), np.ones(len(key), np.int32)
        for i, j in zip(heads[several].tolist(), tails[several].tolist(), strict=True):
            if j - i > GROUP:
                keep[i:j], blocks[i:j] = True, -(-(j - i) // GROUP)
                continue
            for k, others in likely(own[i:j], sketch[i:j], None, most):
                keep[i + k] = True
                keep[i + others] = True
        block = (mixed(ids[keep].view(np.uint64)) % blocks[keep].astype(np.uint64)).astype(np.int32)
        columns = key[keep].view(np.int64), nth[keep].astype(np.int32), block, blocks[keep], own[keep], ids[keep], sketch[keep].view(np.int64)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, found, strict=True)], schema=found)

    sent = docs.select("text").mapInArrow(run, "bucket int, blob binary").groupBy("bucket")
    placed = sent.applyInArrow(meet, "key long, segment int, block int, blocks int, own boolean, id long, sketch long")
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return placed.select("key", "segment", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "blocks", "own", "id", "sketch")


def needed(meets: DataFrame, edits: int) -> DataFrame:
    """meets without the lines of large files that have no one to be compared with in their pair of blocks."""

    def run(batches):
        for group in groups(batches, ["key", "p", "q"]):
            if group.column("blocks")[0].as_py() == 1:
                yield from group.combine_chunks().to_batches()
                continue
            order = np.argsort(~np.asarray(group.column("own")), kind="stable")
            group = group.take(pa.array(order))
            keep = np.zeros(len(order), bool)
            for k, others in likely(*sides(group), edits):
                keep[k] = True
                keep[others] = True
            yield from group.filter(pa.array(keep)).combine_chunks().to_batches()

    return together(meets).mapInArrow(run, meets.schema)


def together(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", F.col("own").desc())


def sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """own, sketch and, where two blocks meet, block of the members of a meeting."""
    crossed = group.column("p")[0].as_py() != group.column("q")[0].as_py()
    return np.asarray(group.column("own")), np.asarray(group.column("sketch")).view(np.uint64), np.asarray(group.column("block")) if crossed else None


def texts_of(wanted: DataFrame, first: DataFrame, docs: DataFrame) -> DataFrame:
    """id, check and t: the texts of the lines whose id is wanted. first: id, check and the first place of each line."""
    places = wanted.join(first, F.col("i") == F.col("id")).groupBy(*(F.col(c).alias(f"at_{c}") for c in ROW)).agg(F.collect_list(F.struct("line", "id", "check")).alias("lines"))
    rows = docs.select(*versioned(docs), docs["text"].alias("text"))
    at = [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in ROW]
    schema = pa.schema([("id", pa.int64()), ("check", pa.int64()), ("t", pa.string())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                lists = part.column("lines")
                owner = np.repeat(np.arange(part.num_rows), np.asarray(pa.compute.list_value_length(lists)))
                flat = lists.flatten()
                split = [(t or "").split("\n") for t in part.column("text").to_pylist()]
                lines = [split[o][k] for o, k in zip(owner.tolist(), flat.field("line").to_pylist(), strict=True)]
                yield record(schema, flat.field("id"), flat.field("check"), lines)

    joined = rows.join(small_side(checkpoint(places)), at).select("text", "lines")
    return joined.mapInArrow(run, "id long, check long, t string").dropDuplicates(["id", "check"])  # a first place may be that of equal rows


def linked(meets: DataFrame, texts: DataFrame, rule, count: bool) -> DataFrame:
    """id, check, and either other_id, other_check, a link that joins classes, or n, links of the line (only if they are to be counted)."""
    rows = meets.join(texts.withColumnRenamed("id", "i"), F.col("id") == F.col("i")).drop("i", "blocks")
    schema = pa.schema([(c, pa.int64()) for c in ("id", "check", "other_id", "other_check", "n")])
    most = max(e for _, e in rule)

    def run(batches):
        for group in groups((x for batch in batches for x in slices(batch, "t")), ["key", "p", "q"]):
            ids = list(zip(group.column("id").to_pylist(), group.column("check").to_pylist(), strict=True))
            lines, nth = group.column("t").to_pylist(), group.column("segment")[0].as_py()
            # What all begin and end with makes no difference.
            head = common(min(lines), max(lines))
            backward = [x[head:][::-1] for x in lines]
            tail = common(min(backward), max(backward))
            cores = [x[tail:][::-1] for x in backward]
            points: dict[int, np.ndarray] = {}
            own, sketch, block = sides(group)
            top, found, links = list(range(len(ids))), [], np.zeros(len(ids), np.int64)

            def root(i: int, top: list[int]) -> int:
                while top[i] != i:
                    top[i] = top[top[i]]
                    i = top[i]
                return i

            def near(i: int, others: list[int], edits: int) -> list[int]:
                if len(others) <= len(cores[i]):  # one by one is faster
                    return [j for j in others if within(cores[i], cores[j], edits)]
                for k in (i, *others):
                    if k not in points:
                        points[k] = np.frombuffer(cores[k].encode("utf-32-le", "surrogatepass"), np.uint32)
                return [j for j, ok in zip(others, within_all(points[i], [points[j] for j in others], edits).tolist(), strict=True) if ok]

            for i, others in likely(own, sketch, block, most):
                # A line that is filed by its segment is the shorter one of all it meets.
                a, edits = lines[i], allowed(len(lines[i]), rule)
                wanted = [j for j in others.tolist() if ids[j] != ids[i] and (count or root(i, top) != root(j, top))]
                for j in near(i, wanted, edits):
                    x, y = root(i, top), root(j, top)
                    if x != y:
                        top[y] = x
                        found.append((*ids[i], *ids[j]))
                    if count:
                        # Counted in one file only, by the segment of i or, if j is filed by its own too, of j.
                        whose, k = (True, 0) if not nth and ids[i] < ids[j] else first_meeting(a, lines[j], ids[i] < ids[j], edits)
                        if k == nth and (whose or own[j]):
                            links[i] += 1
                            links[j] += 1
            if found:
                a, b, c, d = map(list, zip(*found, strict=True))
                yield record(schema, a, b, c, d, pa.nulls(len(a), pa.int64()))
            some = np.flatnonzero(links).tolist()
            if some:
                none = pa.nulls(len(some), pa.int64())
                yield record(schema, [ids[i][0] for i in some], [ids[i][1] for i in some], none, none, links[some])

    return together(rows).mapInArrow(run, "id long, check long, other_id long, other_check long, n long")


def classed(docs: DataFrame, rule=EDITS, count: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of docs, their lines with the first place of each one's class, and (id, check, n): links of distinct lines."""
    rule = tuple(sorted(rule))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0  # one row
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    with small_batches(docs.sparkSession):
        lines = checkpoint(line_table(docs))
        place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.col("line"), F.col("version"), F.col("check_version"))
        distinct = checkpoint(lines.where(F.col("line") >= 0).groupBy("id", "check").agg(F.min(place).alias("first")))
        first = distinct.select("id", "check", F.nullif(F.col("first.doc"), F.lit(LAST)).alias("doc_id"), "first.version", "first.check_version", "first.line")
        meets = checkpoint(meetings(docs, rule, buckets))
        if meets.where(F.col("blocks") > 1).limit(1).count():
            meets = checkpoint(needed(meets, max(e for _, e in rule)))
        texts = texts_of(meets.select(F.col("id").alias("i")).distinct(), first, docs)
        found = checkpoint(linked(meets, texts, rule, count))
    ends = [F.struct(F.col(a).alias("id"), F.col(b).alias("check")).alias(c) for a, b, c in (("id", "check", "a"), ("other_id", "other_check", "b"))]
    member = components(found.where(F.col("n").isNull()).select(*ends)).select("id.id", "id.check", "component")
    kinds = distinct.join(member.select(F.col("id").alias("mi"), F.col("check").alias("mc"), "component"), (F.col("id") == F.col("mi")) & (F.col("check") == F.col("mc")), "left")
    kinds = kinds.select(F.col("id").alias("i"), F.col("check").alias("c"), "first", "component")
    # Most lines are in no class: they lead themselves, and stay out of the join by class.
    classes = kinds.where(F.col("component").isNotNull())
    leads = classes.groupBy(F.col("component").alias("k")).agg(F.min("first").alias("lead"))
    led = classes.join(leads, F.col("component") == F.col("k")).select("i", "c", "first", "lead")
    kinds = led.unionByName(kinds.where(F.col("component").isNull()).select("i", "c", "first"), allowMissingColumns=True)
    # Rows for documents have no id and stay out of joins by it, where all of them would meet in one task.
    placed = lines.where(F.col("line") >= 0).join(kinds, (F.col("id") == F.col("i")) & (F.col("check") == F.col("c")))
    degrees = found.where(F.col("n").isNotNull()).groupBy("id", "check").agg(F.sum("n").alias("n"))
    return lines.where(F.col("line") < 0), placed.withColumn("lead", F.coalesce("lead", "first")), degrees


def _later(column: str):
    """Whether the line stands after the place in `column`; rows that share a doc_id follow each other by hashes, equal rows do not."""
    here = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.col("line"), F.col("version"), F.col("check_version"))
    return here > F.col(column)


def line_report(docs: DataFrame, rule=EDITS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_exact, n_links and classes_sha256, one row for each row of docs.

    Lines that are linked, directly or over others, are a class, and so are lines that are equal; all but its
    first line (smallest doc_id, then line) are removed. Two lines are linked if they are no more edits apart
    than `rule` allows for the shorter one; below its least length lines are only in a class with their equals.
    Blank lines take no part. n_exact of the removed lines equal an earlier line. n_links counts links of the
    row's distinct lines with other distinct lines. classes_sha256 is over `line:doc_id:line` of each line that
    takes part and the first of its class. Null and empty texts have one empty line; a null doc_id comes after
    all others. Rows that share a doc_id, or have none, follow each other line by line, by hashes of their
    texts; equal rows do not precede each other. Extra columns are ignored; an empty table gives an empty
    result.
    """
    heads, rows, links = classed(docs, rule)
    degree = links.select(F.col("id").alias("end"), F.col("check").alias("end_check"), F.col("n").alias("degree"))
    rows = rows.join(degree, (F.col("id") == F.col("end")) & (F.col("check") == F.col("end_check")), "left").unionByName(heads, allowMissingColumns=True)
    places = F.struct("line", F.concat_ws(":", "line", F.coalesce(F.nullif(F.col("lead.doc"), F.lit(LAST)).cast("string"), F.lit("")), "lead.line").alias("s"))
    return (
        rows.groupBy("rid")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_lines").cast("long").alias("n_lines"),
            F.count_if(_later("lead")).alias("n_removed"),
            F.count_if(_later("first")).alias("n_exact"),
            F.collect_set(F.when(F.col("degree").isNotNull(), F.struct("id", "check", "degree"))).alias("d"),
            F.array_sort(F.collect_list(F.when(F.col("line") >= 0, places))).alias("s"),
        )
        .select(
            "doc_id",
            "n_lines",
            "n_removed",
            "n_exact",
            F.aggregate("d", F.lit(0).cast("long"), lambda t, x: t + x.degree).alias("n_links"),
            F.sha2(F.array_join(F.transform("s", lambda x: x.s), ","), 256).alias("classes_sha256"),
        )
    )


def dedup_lines(docs: DataFrame, rule=EDITS) -> DataFrame:
    """docs with the removed lines of line_report() taken out of text; rows of which no line is left go.

    A row that loses nothing keeps its text as it is. All columns of docs come back in their order, whatever
    they are called.
    """
    _, rows, _ = classed(docs, rule, count=False)
    gone = rows.where(_later("lead")).groupBy(*(F.col(c).alias(f"at_{c}") for c in ROW)).agg(F.array_sort(F.collect_set("line")).alias("gone"))
    rows = docs.select(nested(), *versioned(docs), F.split(docs["text"], "\n").alias("lines"))
    joined = rows.join(gone, [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in ROW], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.expr("array_join(transform(kept, i -> lines[i]), '\n')"))
    joined = joined.withColumn("kept", kept).where(F.col("gone").isNull() | (F.size("kept") > 0))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))
