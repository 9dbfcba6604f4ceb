"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document: two logistic models (low quality, toxic) over the presence of discriminating words
and of shape features. Evidence of sites: the mean rejection probability of a host's and of a path's other
documents, each shrunk towards the level above with a strength that is fitted by moments. The posterior
log-odds of a document add how far its site departs from the whole corpus.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexiflow.llm.arrow import PLAIN, record, slices, small_batches, utf8
from lexiflow.llm.common import nested, small_side
from lexiflow.llm.shrink import strength
from lexiflow.session import checkpoint, table, written

#: Labelled documents, drawn by a hash of doc_id, that the classifier is fitted on at most.
SAMPLE_DOCS = 12_000
#: Features kept at most: those that tell most of a label by the G statistic, and in at least LEAST_DOCS documents.
FEATURES, LEAST_GAIN, LEAST_DOCS = 4_000, 16.0, 5
#: Words also count by their pieces of so many bytes, so that forms of one word share their evidence.
PIECES = (5, 7)
SYMBOLS = b"#*$%&|<>!"
UPPER = bytes(range(65, 91))


def pieces(word: bytes) -> list[bytes]:
    """A word and its pieces, which are told from words by a dash."""
    return [word, *(b"-" + word[i : i + n] for n in PIECES for i in range(len(word) - n + 1))]


def shapes(text: bytes, words: list[bytes], kinds: int) -> set[bytes]:
    """Binned shares of symbols, capitals and different words."""
    size = max(1, len(text))
    symbols, capitals = (len(text) - len(text.translate(None, c)) for c in (SYMBOLS, UPPER))
    share = b"=kinds%d" % int(10 * kinds / len(words)) if words else b"=wordless"
    return {b"=symbols%d" % min(9, int(40 * symbols / size)), b"=capitals%d" % min(9, int(20 * capitals / size)), share}


def features(text: bytes | None) -> set[bytes]:
    """The features of a text: words (ASCII letters in lower case), their pieces, and shapes."""
    text = text or b""
    words = text.translate(PLAIN).split()
    different = set(words)
    return shapes(text, words, len(different)).union(*map(pieces, different))


class Finder:
    """Which of some features texts have; pieces are looked for in all texts at once, as integers of their bytes."""

    def __init__(self, known: list[bytes]):
        self.at = {f: k for k, f in enumerate(known) if f[:1] != b"-"}
        self.pieces = []
        for n in PIECES:
            found = sorted((int.from_bytes(f[1:], "little"), k) for k, f in enumerate(known) if f[:1] == b"-" and len(f) == n + 1)
            values, places = np.array([v for v, _ in found], np.uint64), np.array([k for _, k in found], np.int64)
            likely = np.zeros(1 << 16, bool)
            likely[self.folded(values)] = True
            self.pieces.append((n, values, places, likely))

    @staticmethod
    def folded(values: np.ndarray) -> np.ndarray:
        return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature): places of all that are found, each once."""
        rows, ids, plain = [], [], []
        for i, text in enumerate(texts):
            text = text or b""
            plain.append(text.translate(PLAIN))
            words = plain[-1].split()
            different = set(words)
            hits = (self.at.keys() & different) | (self.at.keys() & shapes(text, words, len(different)))
            rows += [i] * len(hits)
            ids += [self.at[f] for f in hits]
        x = np.frombuffer(b"\n".join(plain), np.uint8).astype(np.uint64)
        starts = np.cumsum([0, *(len(t) + 1 for t in plain)])[:-1]
        pairs = [np.array([rows, ids], np.int64).T.reshape(-1, 2)]
        for n, values, places, likely in self.pieces:
            if not len(values) or len(x) < n:
                continue
            piece = x[: len(x) - n + 1].copy()
            for k in range(1, n):
                piece |= x[k : len(x) - n + 1 + k] << np.uint64(8 * k)
            at = np.flatnonzero(likely[self.folded(piece)])
            near = np.minimum(np.searchsorted(values, piece[at]), len(values) - 1)
            same = values[near] == piece[at]
            found = np.stack((np.searchsorted(starts, at[same], side="right") - 1, places[near[same]]), axis=1)
            pairs.append(np.unique(found, axis=0))
        both = np.concatenate(pairs)
        return both[:, 0], both[:, 1]


def drawn(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """text, low and toxic of a bounded sample of the labelled documents.

    A document with several label rows has its lowest quality and its highest toxicity; null labels count
    as good.
    """
    some = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.coalesce(F.min("quality") == 0, F.lit(False)).alias("low"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(sample_docs)
    )
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("labelled")).select("text", "low", "toxic")


def vocabulary(sample: DataFrame, keep: int = FEATURES) -> list[bytes]:
    """The features that tell low or toxic documents from others, at most `keep`."""
    schema = pa.schema([("feature", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("toxic", pa.int64())])

    def count(batches):
        n, low, toxic = Counter(), Counter(), Counter()
        for batch in batches:
            for part in slices(batch):
                for t, a, b in zip(utf8(part.column("text")), part.column("low").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    f = features(t)
                    f.add(b"")
                    n.update(f)
                    low.update(f if a else ())
                    toxic.update(f if b else ())
        yield record(schema, list(n), list(n.values()), [low[f] for f in n], [toxic[f] for f in n])

    counts = checkpoint(
        sample.mapInArrow(count, "feature binary, n long, low long, toxic long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic"))
        .where(F.col("n") >= LEAST_DOCS)
    )
    whole = counts.where(F.length("feature") == 0).first()  # the empty feature stands in every document
    if whole is None:
        return []

    def weighed(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))

    def gain(part: str) -> Column:
        """The G statistic of the table feature by label."""
        a, n, labelled, total = F.col(part), F.col("n"), F.lit(whole[part]), F.lit(whole["n"])
        cells = weighed(a) + weighed(n - a) + weighed(labelled - a) + weighed(total - labelled - n + a)
        return 2 * (cells - weighed(n) - weighed(total - n) - weighed(labelled) - weighed(total - labelled) + weighed(total))

    best = counts.where(F.length("feature") > 0).withColumn("g", F.greatest(gain("low"), gain("toxic"))).where(F.col("g") >= LEAST_GAIN)
    return [bytes(r["feature"]) for r in best.orderBy(F.col("g").desc(), "feature").limit(keep).select("feature").collect()]


def logistic(ids: np.ndarray, rows: np.ndarray, y: np.ndarray, size: int, rounds: int = 300) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression on present features."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    n = max(1, len(y))
    for k in range(1, rounds + 1):
        score = np.bincount(rows, weights=w[ids], minlength=len(y)) + w[-1]
        error = 1 / (1 + np.exp(-score)) - y
        slope = np.append(np.bincount(ids, weights=error[rows], minlength=size) / n + 2e-4 * w[:-1], error.sum() / n)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """The two models: features with their weights. Without labels both give even odds of being good."""
    sample = checkpoint(drawn(docs, labels, sample_docs))
    words = vocabulary(sample)
    schema = pa.schema([("low", pa.bool_()), ("toxic", pa.bool_()), ("ids", pa.list_(pa.int32()))])

    def present(batches):
        finder = Finder(words)
        for batch in batches:
            for part in slices(batch):
                rows, ids = finder(utf8(part.column("text")))
                order = np.argsort(rows, kind="stable")
                ends = np.searchsorted(rows[order], np.arange(part.num_rows + 1)).astype(np.int32)
                yield record(schema, part.column("low"), part.column("toxic"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[order].astype(np.int32))))

    # At most sample_docs rows of at most FEATURES small numbers.
    got = sample.mapInArrow(present, "low boolean, toxic boolean, ids array<int>").toArrow().combine_chunks()
    lists = got.column("ids").combine_chunks()
    ids = np.asarray(lists.flatten(), np.int64)
    rows = np.repeat(np.arange(len(lists)), np.asarray(pa.compute.list_value_length(lists), np.int64))
    fitted = [logistic(ids, rows, np.asarray(got.column(c).cast(pa.float64())), len(words)) for c in ("low", "toxic")]
    return {"words": words, "weights": [f[:-1] for f in fitted], "base": [float(f[-1]) for f in fitted]}


def with_evidence(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with p_bad, the probability that a row's text alone gives for being low or toxic; docs has no such column."""
    words, weights, base = model["words"], model["weights"], model["base"]

    def run(batches):
        finder = Finder(words)
        for batch in batches:
            for part in slices(batch, text):
                rows, ids = finder(utf8(part.column(text)))
                odds = np.stack([np.bincount(rows, weights=w[ids], minlength=part.num_rows) + b for w, b in zip(weights, base, strict=True)], axis=1)
                good = np.prod(1 / (1 + np.exp(np.clip(odds, -30, 30))), axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 - good)], names=[*part.schema.names, "p_bad"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("p_bad", DoubleType())]))


def site_rates(known: DataFrame) -> tuple[DataFrame, float, float, float]:
    """The sites of known (host, path, p_bad): h, p, s, n, hs, hn, a row for each path with the sums and numbers of it and of its host.

    With it come the mean of all and the strengths of the hosts' and of the paths' priors.
    """
    paths = known.groupBy("host", "path").agg(F.sum("p_bad").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("p_bad") * F.col("p_bad")).alias("q"))
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    rates = checkpoint(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select("h", F.col("path").alias("p"), "s", "n", "q", "hs", "hn"))
    n, hn = F.col("n").cast("double"), F.col("hn").cast("double")
    a = rates.agg(F.sum("s"), F.sum("n"), F.sum("q"), F.count(F.lit(1)), F.sum(n * n / hn), F.sum(F.col("s") * F.col("s") / n), F.sum(1 / n)).first()  # one row
    b = hosts.agg(F.count(F.lit(1)), F.sum(hn * hn), F.sum(F.col("hs") * F.col("hs") / hn), F.sum(1 / hn)).first()  # one row
    s, d, q, n_paths, squares, between, inverse = (float(x or 0) for x in a)
    n_hosts, host_squares, host_between, host_inverse = (float(x or 0) for x in b)
    if not d:
        return rates, 0.0, 0.0, 0.0
    mean = s / d
    host_k = strength(d, n_hosts - 1, host_squares / d, host_between - s * mean, max(0.0, q / d - mean * mean), host_inverse)
    inside = max(0.0, (q - host_between) / (d - n_hosts)) if d > n_hosts else 0.0  # variance of a document around its host
    path_k = strength(d, n_paths - n_hosts, squares, between - host_between, inside, inverse)
    return rates, mean, host_k, path_k


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(q / (1 - q))


def posterior(known: DataFrame) -> DataFrame:
    """known (host, path, p_bad and others) with site, the rejection rate that a row's site lets expect, and score.

    A document does not count among its own site. score is the probability of being good, given both.
    """
    rates, mean, host_k, path_k = site_rates(known)
    own = F.col("p_bad")
    prior = (F.col("hs") - own + mean * host_k) / (F.col("hn") - 1 + host_k)
    site = (F.col("s") - own + prior * path_k) / (F.col("n") - 1 + path_k)
    odds = logit(own) + logit(F.col("site")) - logit(F.lit(mean))
    at_site = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    joined = known.join(small_side(rates), at_site).withColumn("site", F.greatest(F.lit(0.0), site))
    return joined.withColumn("score", 1 / (1 + F.exp(odds))).select(*known.columns, "site", "score")


def named(docs: DataFrame, host: str, path: str) -> list[Column]:
    return [docs[host].cast("string").alias("host"), docs[path].cast("string").alias("path")]


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = 0.5, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, evidence, site, score and kept, one row for each row of docs.

    evidence: probability of being good by the document alone; site: the rejection rate expected of its
    path from its other documents; score: posterior probability of being good; kept: score >= least.
    Null and empty texts are judged by their shape features. Null hosts and paths are sites of their own.
    Repeated rows are judged, and counted for their sites, each. Extra columns of either table are ignored.
    An empty docs gives an empty result; without labels every text has even odds in both models.
    """
    with small_batches(docs.sparkSession):
        model = train(docs, labels, sample_docs)
        known = checkpoint(with_evidence(docs.select(docs["doc_id"], *named(docs, host, path), docs["text"]), model).drop("text"))
    return posterior(known).select("doc_id", (1 - F.col("p_bad")).alias("evidence"), "site", "score", (F.col("score") >= least).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = 0.5, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns, whatever those are called.

    The rows are written once with their evidence, so that no text is judged twice or shuffled.
    """
    with small_batches(docs.sparkSession):
        model = train(docs, labels, sample_docs)
        known = written(with_evidence(docs.select(nested(), *named(docs, host, path), docs["text"].alias("read")), model, "read").drop("read"))
    return posterior(known).where(F.col("score") >= least).select("row.*")


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
