"""Quality by hierarchical empirical Bayes: the evidence of a text over posteriors of its site and path, which are shrunk to a global prior."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rows, rows_of, saved
from .symbols import SPACED_FOLDED, words
from .toxicity import CALIBRATION, FOLDS, HELD_OUT

SALTS = 16
IN_BROADCAST = 200_000  # groups; more are joined by shuffle
LEAST, MOST = 1.0, 1e9  # bounds of the number of documents that a prior counts as
BINS, UNSEEN = 16, 255
SHARES = np.array([0.001, 0.003, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.35, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99])
LOGS = np.arange(1, 8.5, 0.5)
#: Upper case among ASCII letters, digits, non-ASCII bytes, commas and stops, other signs, distinct words, words like the one before, distinct lines; then sizes.
CUTS = [SHARES] * 8 + [LOGS, LOGS, np.arange(2, 9.5, 0.5)]
UPPER, LOWER, DIGIT, SPACE, HIGH, STOP, SIGN = range(7)
KIND = np.full(256, SIGN, np.uint8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[:33], KIND[128:], KIND[[44, 46]] = UPPER, LOWER, DIGIT, SPACE, HIGH, STOP


def features(text: str | None) -> bytes:
    """The bin of each feature of a whole text; UNSEEN for all without words."""
    data = (text or "").encode()
    ids = words(data, SPACED_FOLDED)[2]
    if not len(ids):
        return bytes([UNSEEN]) * len(CUTS)
    kinds, size, lines = np.bincount(KIND[np.frombuffer(data, np.uint8)], minlength=7), len(data), data.split(b"\n")
    values = [
        kinds[UPPER] / max(1, kinds[UPPER] + kinds[LOWER]), kinds[DIGIT] / size, kinds[HIGH] / size, kinds[STOP] / size, kinds[SIGN] / size,
        len(np.unique(ids)) / len(ids), np.count_nonzero(ids[1:] == ids[:-1]) / len(ids), len(set(lines)) / len(lines),
        np.log1p(len(ids)), np.log1p(size / len(lines)), size / len(ids),
    ]
    return bytes(int(np.searchsorted(c, v, "right")) for c, v in zip(CUTS, values, strict=True))


def strength(within: float, freedom: float, between: float, groups: float, spread: float) -> float:
    """How many documents the parent's rate counts as, by the method of moments: variance within groups over variance between
    them. `within` and `between` are sums of squares, `spread` is the between sum's factor of the variance sought."""
    if freedom <= 0 or groups <= 0 or spread <= 0:
        return MOST
    inner = within / freedom
    outer = (between - groups * inner) / spread
    return float(np.clip(inner / outer, LEAST, MOST)) if outer > 0 else MOST


def log_odds(counts: np.ndarray) -> np.ndarray:
    """counts[feature, bin, label] -> what each bin adds to the log-odds of label 1. A bin's rate is shrunk to the rate of all."""
    n, good = counts.sum(axis=2).astype(float), counts[:, :, 1].astype(float)
    out = np.zeros(n.shape)
    for f in range(len(n)):
        total = n[f].sum()
        rate = (good[f].sum() + 0.5) / (total + 1)
        share = good[f] / np.maximum(n[f], 1)
        within, between = (n[f] * share * (1 - share)).sum(), (n[f] * (share - good[f].sum() / max(total, 1)) ** 2).sum()
        k = np.count_nonzero(n[f])
        prior = strength(within, total - k, between, k - 1, total - (n[f] ** 2).sum() / max(total, 1))
        post = (good[f] + prior * rate) / (n[f] + prior)
        out[f] = np.log(post / (1 - post)) - np.log(rate / (1 - rate))
    return out


def evidence(bins: list[bytes], table: np.ndarray) -> np.ndarray:
    at = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, len(CUTS)).astype(np.int64)
    return np.where(at == UNSEEN, 0.0, table[np.arange(len(CUTS)), np.minimum(at, BINS - 1)])


def _summed(rows: DataFrame, one) -> np.ndarray | float:
    """Sum over all rows(bins, label) of what `one` makes of a batch's lists; each task gives one row."""

    def add(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + one(batch.column("bins").to_pylist(), np.array(batch.column("label").to_pylist(), np.int64)).astype(float)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    got = [np.frombuffer(r["sums"]) for r in rows.select("bins", "label").mapInArrow(add, "sums binary").collect()]
    return np.sum(got, axis=0) if got else 0.0


def _weights(rows: DataFrame, table: np.ndarray) -> np.ndarray:
    """Ridge logistic regression of the label on the features' log-odds by Newton steps, each from sums over all rows; a step that does not help is halved."""
    m = len(CUTS) + 1
    ridge = np.diag([1e-3, *[1.0] * len(CUTS)])

    def sums(b):
        def one(bins, label):
            z = np.column_stack((np.ones(len(bins)), evidence(bins, table)))
            x = z @ b
            p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            return np.concatenate((((z * (p * (1 - p))[:, None]).T @ z).ravel(), z.T @ (label - p), [(np.logaddexp(0, x) - label * x).sum()]))

        s = _summed(rows, one)
        return s[: m * m].reshape(m, m) + ridge, s[m * m : -1] - ridge @ b, s[-1] + b @ ridge @ b / 2

    b = np.zeros(m)
    curve, slope, loss = sums(b)
    for _ in range(50):
        step = np.linalg.solve(curve, slope)
        if np.abs(step).max() < 1e-6:
            break
        now = sums(b + step)
        if now[2] > loss + 1e-9:
            step = step / 2
            while np.abs(step).max() >= 1e-6 and (now := sums(b + step))[2] > loss + 1e-9:
                step = step / 2
            if now[2] > loss + 1e-9:
                break
        b, (curve, slope, loss) = b + step, now
    return b


def fit(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """rows(bins, label, fold) -> table and weights from all labelled rows outside the held-out fold; one fold fits the weights. None where a fold lacks a label."""

    def count(bins, label):
        at = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, len(CUTS)).astype(np.int64)
        known = (at[:, 0] != UNSEEN).repeat(len(CUTS))
        cell = ((np.arange(len(CUTS)) * BINS + at) * 2 + label[:, None]).ravel()
        return np.concatenate((np.bincount(cell[known], minlength=len(CUTS) * BINS * 2), np.bincount(label, minlength=2)))

    learned = rows.filter(F.col("label").isNotNull() & (F.col("fold") != HELD_OUT))
    first, last = learned.filter(F.col("fold") != CALIBRATION), learned.filter(F.col("fold") == CALIBRATION)
    seen, checked = _summed(first, count), _summed(last, count)
    if not (np.size(seen) > 1 and np.size(checked) > 1 and seen[-2:].all() and checked[-2:].all()):
        return None
    table = log_odds(seen[:-2].reshape(len(CUTS), BINS, 2))
    return table, _weights(last, table)


def site_and_path(source: Column, lang: Column) -> tuple[Column, Column]:
    """The host of a URL, or a source's bare name, and its first directory; where it has none, the language stands for it. Null without a source."""
    scheme, bare = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?", F.trim(source)
    host = F.nullif(F.lower(F.regexp_extract(bare, scheme + r"([^/?#]*)", 1)), F.lit(""))
    path = F.nullif(F.regexp_extract(bare, scheme + r"[^/?#]*/([^/?#]+)/", 1), F.lit(""))
    return host, F.when(host.isNotNull(), F.coalesce(path, lang, F.lit("")))


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, lang) -> doc_id, site, path, bins, fold, label: a row per document; of several labels the least counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("site", pa.string()), ("path", pa.string()), ("bins", pa.binary())])

    def scan(batches):
        out = Rows(schema)
        for doc, site, path, text in rows_of(batches, "doc_id", "site", "path", "text"):
            if out.add(doc, site, path, features(text)):
                yield out.take()
        yield out.take()

    site, path = site_and_path(F.col("source"), F.col("lang"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), site.alias("site"), path.alias("path"), "text")
    rows = narrow.mapInArrow(scan, "doc_id long, site string, path string, bins binary")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    rows = saved(rows.withColumn("fold", F.coalesce(fold, F.lit(HELD_OUT))))
    said = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("long").alias("label"))
    known = rows.filter(F.col("doc_id").isNotNull()).join(said.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "left")
    return saved(known.unionByName(rows.filter(F.col("doc_id").isNull()).withColumn("label", F.lit(None).cast("long"))))


def text_scores(rows: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """rows with x, the text's log-odds, and y, what the document counts as in its groups: its label if that was learned from, else
    the text's probability. Without a model x is null, and documents without a label count in no group."""
    label = F.when(F.col("fold") != HELD_OUT, F.col("label").cast("double"))
    head = rows.select("doc_id", "site", "path", (F.col("fold") == HELD_OUT).alias("held_out"), label.alias("label"), "bins")
    if model is None:
        return head.drop("bins").withColumn("x", F.lit(None).cast("double")).withColumnRenamed("label", "y")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        for batch in batches:
            table, weights = shared.value
            x = weights[0] + evidence(batch.column("bins").to_pylist(), table) @ weights[1:] if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "site", "path", "held_out", "label")), pa.array(np.clip(x, -30.0, 30.0))], names=["doc_id", "site", "path", "held_out", "label", "x"])

    scored = head.mapInArrow(rate, "doc_id long, site string, path string, held_out boolean, label double, x double")
    return scored.select("doc_id", "site", "path", "held_out", "x", F.coalesce("label", 1 / (1 + F.exp(-F.col("x")))).alias("y"))


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each path and each site, how many documents count and the sums of y that the posteriors need. Salted: no task gets all rows of a site."""
    n, s, q = F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")
    salt = F.pmod(F.xxhash64("doc_id", "y"), F.lit(SALTS)).alias("salt")
    dealt = rows.filter("site IS NOT NULL AND y IS NOT NULL").select("site", "path", salt, "y").groupBy("site", "path", "salt")
    dealt = dealt.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    paths = saved(dealt.groupBy("site", "path").agg(n, s, q))
    salted = paths.groupBy("site", F.pmod(F.xxhash64("path"), F.lit(SALTS)).alias("salt"))
    squares = (F.col("n") * F.col("n")).cast("double")
    part = salted.agg(n, s, q, F.sum(squares).alias("nn"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("sn"), F.count(F.lit(1)).alias("paths"))
    sites = part.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("s").alias("site_s"), F.sum("q").alias("site_q"), F.sum("nn").alias("nn"), F.sum("sn").alias("sn"), F.sum("paths").alias("paths"))
    return paths.select("site", "path", F.col("n").alias("path_n"), F.col("s").alias("path_s")), saved(sites)


def posteriors(rows: DataFrame) -> DataFrame:
    """rows(site, path, y, ..) with global_rate, site_rate and path_rate, each without the row itself. A site's rate is shrunk to the global one and a
    path's to its site's, as far as documents differ within groups and little between them. Rows without a site have the global rate."""
    paths, sites = _groups(rows)
    total = rows.agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("s")).first()
    names = ["k", "n", "s", "q", "paths", "ss", "nn", "sn", "inner"]
    n, s = F.col("site_n"), F.col("site_s")
    sums = sites.agg(F.count(F.lit(1)), F.sum(n), F.sum(s), F.sum("site_q"), F.sum("paths"), F.sum(s * s / n), F.sum((n * n).cast("double")), F.sum("sn"), F.sum(F.col("nn") / n)).first()
    g = dict(zip(names, (float(v or 0) for v in sums), strict=True))
    many = max(g["n"], 1.0)
    over = strength(g["q"] - g["ss"], g["n"] - g["k"], g["ss"] - g["s"] ** 2 / many, g["k"] - 1, g["n"] - g["nn"] / many)
    under = strength(g["q"] - g["sn"], g["n"] - g["paths"], g["sn"] - g["ss"], g["paths"] - g["k"], g["n"] - g["inner"])
    groups = saved(paths.join(sites.select("site", "site_n", "site_s"), "site"))
    if groups.count() <= IN_BROADCAST:
        joined = rows.join(F.broadcast(groups), ["site", "path"], "left")
    else:  # each group once for every salt, so that a site with very many documents is dealt out
        copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "y"), F.lit(SALTS)).cast("long")).join(copies, ["site", "path", "salt"], "left").drop("salt")
    own, y, none = F.when(F.col("y").isNotNull(), 1).otherwise(0), F.coalesce("y", F.lit(0.0)), F.lit(0)
    at = lambda c: F.coalesce(F.col(c), none) - F.when(F.col("site").isNotNull(), own if c.endswith("_n") else y).otherwise(none)
    joined = joined.withColumn("global_rate", (F.lit(float(total["s"])) - y + 0.5) / (F.lit(float(total["n"])) - own + 1))
    joined = joined.withColumn("site_rate", (at("site_s") + over * F.col("global_rate")) / (at("site_n") + over))
    joined = joined.withColumn("path_rate", (at("path_s") + under * F.col("site_rate")) / (at("path_n") + under))
    return joined.drop("path_n", "path_s", "site_n", "site_s")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, lang) and labels(doc_id, quality) -> doc_id, held_out, score, predicted (1: good), site_rate, path_rate.

    The score is the text's log-odds with the path's posterior in place of the global prior. Every document is measured whole and every label outside the
    held-out fold is learned from; a document's own label and text stay out of its groups' rates. Texts without words
    are scored on no evidence; a null doc_id counts as held out; rows repeat as they come. Where labels fit no model, the score is the path's rate."""
    rows = measured(docs, labels)
    rated = posteriors(saved(text_scores(rows, fit(rows))))
    near = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-9)), F.lit(1 - 1e-9))
    logit = lambda c: F.log(near(c) / (1 - near(c)))
    score = 1 / (1 + F.exp(-(F.coalesce("x", logit("global_rate")) + logit("path_rate") - logit("global_rate"))))
    return rated.withColumn("score", score).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "site_rate", "path_rate")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
