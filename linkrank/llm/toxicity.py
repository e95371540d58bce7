"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

import os
import zlib
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, packed, parts, rows_of, saved, scratch_dir, unpacked
from .symbols import ALNUM_FOLDED, mix, words

SPANS = (1, 4, 16)  # tokens in the stretches whose normalised likelihoods are compared
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
TRIPLES = 3_000_000  # word triples that a task holds to send each once: 72 MB
CODED, OTHER = 65_535, 65_535  # words that two bytes name on the way to the counts, and what stands for any other
LEADING, LEADING_TEXTS = 4_000, 2_000  # characters of so many texts that choose those words; all words are counted alike
BROADCAST_LABELS = 2_000_000  # some 50 MB; beyond, texts are dealt to their labels
FIRST, SECOND = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)


def discount(once: int, twice: int) -> float:
    """The absolute discount of Kneser and Ney, from how many counts are 1 and 2; from 0.1 to below 1, so that something is left of each count and for
    what has none."""
    return max(0.1, once / (once + 2 * twice)) if twice else 0.75


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * FIRST + right * SECOND)


def tokens(text: str | None) -> np.ndarray:
    """Word identities of a whole text: runs of ASCII letters, digits and non-ASCII bytes, with A-Z lowered."""
    return words((text or "").encode(), ALNUM_FOLDED)[2]


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS if doc_id is not None else HELD_OUT


@dataclass
class Table:
    """Rows of numbers by sorted 64-bit keys, in two files of the shared folder that a process maps when it first looks, so that neither the driver nor a
    task holds or sends them. Where the shared folder isn't one that tasks can open, the arrays themselves travel."""

    size: int
    width: int
    kind: str
    path: str | None = None
    held: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | ({"held": None} if self.path else {})

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held is None:
            load = lambda name, kind, shape: np.asarray(np.memmap(f"{self.path}/{name}", kind, "r", shape=shape)) if self.size else np.empty(shape, kind)
            self.held = load("keys", "<u8", (self.size,)), load("values", self.kind, (self.size, self.width))
        return self.held

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A column of numbers for each id, and which ids are there; the others' numbers mean nothing."""
        keys, values = self.arrays()
        if not self.size:
            return np.zeros((self.width, len(ids))), np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(keys, ids), self.size - 1)
        return values[at].T.astype(float), keys[at] == ids


def table(rows: DataFrame, kind: str) -> Table:
    """rows(key long, numbers ...) with no key twice. Tasks sort the ranges of keys that they get and write them at their places."""
    spark, names = rows.sparkSession, rows.columns[1:]
    path, bits = scratch_dir(spark), max(1, (parts(spark) - 1).bit_length())
    if not path.startswith("file:"):
        every = rows.toPandas()
        keys = every["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return Table(len(keys), len(names), kind, held=(keys[order], every[names].to_numpy(kind)[order]))
    path = path.removeprefix("file://").removeprefix("file:")
    dealt = rows.withColumn("part", F.shiftrightunsigned("key", 64 - bits).cast("int"))
    sizes = np.zeros(1 << bits, np.int64)
    for r in dealt.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]
    starts, size = np.cumsum(sizes) - sizes, int(sizes.sum())
    row = np.dtype(kind).itemsize * len(names)
    os.makedirs(path)
    for name, width in (("keys", 8), ("values", row)):
        with open(f"{path}/{name}", "wb") as f:
            f.truncate(width * size)

    def put(batches):
        if whole := [b for b in batches if b.num_rows]:
            column = lambda name: np.concatenate([np.asarray(b.column(name)) for b in whole])
            keys = column("key").view(np.uint64)
            order = np.argsort(keys)
            part, keys, values = column("part")[order], keys[order], np.stack([column(n).astype(kind) for n in names], axis=1)[order]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            with open(f"{path}/keys", "r+b") as k, open(f"{path}/values", "r+b") as v:
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
                    at = int(starts[part[a]])
                    k.seek(8 * at)
                    k.write(keys[a:b].astype("<u8").tobytes())
                    v.seek(row * at)
                    v.write(values[a:b].tobytes())
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(keys)], pa.int64())})

    with released(spark):
        put_there = dealt.repartitionById(1 << bits, "part").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
    if put_there != size:
        raise RuntimeError(f"{put_there} of {size} rows were written")
    return Table(size, len(names), kind, path)


@contextmanager
def released(spark: SparkSession):
    """What is made and run here deletes its shuffle files as it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Model:
    """Of each word, each class's probability without context and, of the word as a context, what is left for the backoff and one over how often it occurs:
    in the classes and pooled. Of each pair, its contexts in both classes.

    p(w | class, v) = share + left * q, q(w | class, v) = pooled + pooled_left * base(w | class): the class after a word, then both classes
    after it, then the class alone, whose own backoff both share. Each sums to 1 over all words and the unknown one."""

    words: Table  # base (2), left (2), pooled left, one over the context's count (2), and pooled
    pairs: Table  # counts (2)
    discounts: np.ndarray  # (3,): of the classes and pooled
    unknown: np.ndarray  # (2,)
    weights: np.ndarray | None = None
    prior: float = 0.0

    @property
    def word(self) -> np.ndarray:
        return self.words.arrays()[0]

    @property
    def pair(self) -> np.ndarray:
        return self.pairs.arrays()[0]

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """(2, tokens): of each token after the one before it, in the ordinary and the toxic model; 1 without any counts."""
        if not len(ids) or not self.words.size:
            return np.ones((2, len(ids)))
        of, known = self.words.find(ids)
        p = np.where(known, of[:2], self.unknown[:, None])
        if len(ids) > 1:
            left = np.where(known[:-1], of[2:5, :-1], 1.0)
            n, met = self.pairs.find(pair_keys(ids[:-1], ids[1:]))
            n = np.vstack((n, (n > 0).sum(axis=0)))
            share = np.where(met & known[:-1], np.maximum(n - self.discounts[:, None], 0.0) * of[5:, :-1], 0.0)
            p[:, 1:] = left[:2] * (left[2] * p[:, 1:] + share[2]) + share[:2]
        return p

    def differences(self, ids: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each token after the one before it."""
        p = np.log(self.probabilities(ids))
        return p[1] - p[0]

    def evidence(self, text: str | None) -> list[float]:
        """Length-normalised difference of the stretch of each span where toxic leads most, and of the whole text; zeros without words."""
        d = self.differences(tokens(text))
        if not len(d):
            return [0.0] * (len(SPANS) + 1)
        sums = np.concatenate(([0.0], np.cumsum(d)))
        return [*(float((sums[n:] - sums[:-n]).max() / n) for n in (min(span, len(d)) for span in SPANS)), float(d.mean())]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.prior
        x = self.weights[0] + self.weights[1:] @ np.array(self.evidence(text))
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


class Codes:
    """Triples of word identities in few bytes: two for each of the given words, eight more for any other."""

    def __init__(self, common: np.ndarray):
        self.common, order = common[:CODED], np.argsort(common[:CODED])
        self.sorted, self.code = self.common[order], order.astype(np.uint16)

    def of(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(ids), OTHER, np.uint16)
        at = np.minimum(np.searchsorted(self.sorted, ids), len(self.sorted) - 1)
        return np.where(self.sorted[at] == ids, self.code[at], np.uint16(OTHER))

    def packed(self, ids: np.ndarray, codes: np.ndarray) -> bytes:
        """(3, n) identities and their codes, the codes' low and high bytes apart."""
        return packed(codes.astype("<u2").reshape(-1).view(np.uint8).reshape(-1, 2).T.tobytes() + ids[codes == OTHER].astype("<u8").tobytes())

    def unpacked(self, data: bytes, n: int) -> np.ndarray:
        data = unpacked(data)
        codes = np.ascontiguousarray(np.frombuffer(data, np.uint8, 6 * n).reshape(2, -1).T).view("<u2").reshape(3, n)
        other, ids = codes == OTHER, np.empty((3, n), np.uint64)
        ids[~other] = self.common[codes[~other]]
        ids[other] = np.frombuffer(data, "<u8", offset=6 * n)
        return ids


def _codes(sample: DataFrame) -> Codes:
    """By the words that are commonest in the beginnings of some texts. That only decides how many bytes a word takes."""
    some = [tokens(r[0]) for r in sample.select(F.substring("text", 1, LEADING)).limit(LEADING_TEXTS).collect()]
    met, n = np.unique(np.concatenate([np.empty(0, np.uint64), *some]), return_counts=True)
    return Codes(met[np.argsort(-n, kind="stable")])


def _counted(sample: DataFrame) -> DataFrame:
    """sample(text, toxic) -> v, w, n0, n1: after how many different words (or at the start) the pair v, w stands in each class. Such continuation counts
    are what Kneser and Ney back off to; a passage that many texts carry is one context, however often it stands.

    Each task sends the different triples of some three million tokens in one piece for each lot of pairs and class; a lot's triples are counted together."""
    spark = sample.sparkSession
    lots, codes = min(parts(spark), 65_536), spark.sparkContext.broadcast(_codes(sample))
    schema = pa.schema([("lot", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64()), ("triples", pa.binary())])

    def send(batches):
        held, size, out = ([], []), 0, Rows(schema)
        for text, toxic in rows_of(batches, "text", "toxic"):
            if len(t := tokens(text)) > 1:
                a = np.concatenate((np.zeros(1, np.uint64), t))
                held[toxic].append(np.stack((a[:-2], a[1:-1], a[2:])))
                size += len(a) - 2
            if size >= TRIPLES:
                yield from given(held, out)
                held, size = ([], []), 0
        yield from given(held, out)
        yield out.take()

    def given(held, out):
        for toxic, triples in enumerate(held):
            if not triples:
                continue
            ids = np.concatenate(triples, axis=1)
            pair = pair_keys(ids[1], ids[2])
            first = np.unique(pair_keys(ids[0], pair), return_index=True)[1]
            ids, lot = ids[:, first], pair[first] % np.uint64(lots)
            code = np.stack([codes.value.of(x) for x in ids])
            u, v, w = code.astype(np.uint64)
            order = np.argsort(lot << np.uint64(48) | v << np.uint64(32) | w << np.uint64(16) | u)
            ids, code, lot = ids[:, order], code[:, order], lot[order]
            ends = np.append(np.flatnonzero(np.diff(lot)) + 1, len(lot)).tolist()
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                data = codes.value.packed(ids[:, a:b], code[:, a:b])
                if out.add(int(lot[a]), toxic, b - a, data, weight=len(data) + 64):
                    yield out.take()

    counts = pa.schema([("v", pa.int64()), ("w", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])

    def count(batches):
        lot_of = {}
        for lot, toxic, n, data in rows_of(batches, "lot", "toxic", "n", "triples"):
            lot_of.setdefault(lot, ([], []))[toxic].append((data, n))
        while lot_of:
            each = []
            for pieces in lot_of.popitem()[1]:
                u, v, w = np.concatenate([np.empty((3, 0), np.uint64), *(codes.value.unpacked(*x) for x in pieces)], axis=1)
                pair = pair_keys(v, w)
                different = np.unique(pair_keys(u, pair), return_index=True)[1]
                key, first, n = np.unique(pair[different], return_index=True, return_counts=True)
                each.append((key, v[different[first]], w[different[first]], n))
            key = np.union1d(each[0][0], each[1][0])
            out = np.zeros((4, len(key)), np.int64)
            for toxic, (mine, v, w, n) in enumerate(each):
                at = np.searchsorted(key, mine)
                out[0, at], out[1, at], out[2 + toxic, at] = v.view(np.int64), w.view(np.int64), n
            out = out[:, np.lexsort((out[1], out[0]))]
            for a in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in out], schema=counts)

    sent = sample.select("text", "toxic").mapInArrow(send, "lot int, toxic int, n long, triples binary")
    return sent.repartitionById(lots, "lot").mapInArrow(count, "v long, w long, n0 long, n1 long")


def _keyed(pairs: DataFrame) -> DataFrame:
    """pairs(v, w, n0, n1) -> key, n0, n1."""
    schema = pa.schema([("key", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])

    def key(batches):
        for b in batches:
            v, w = (np.asarray(b.column(c)).view(np.uint64) for c in ("v", "w"))
            yield pa.RecordBatch.from_arrays([pa.array(pair_keys(v, w).view(np.int64)), b.column("n0"), b.column("n1")], schema=schema)

    return pairs.mapInArrow(key, "key long, n0 long, n1 long")


def kneser_ney(counts: DataFrame, cutoff: int = 1) -> Model:
    """Both classes' interpolated models from continuation counts of pairs. Each level's discount comes from its own counts. The pooled level and the words'
    backoff count in how many classes an expression occurs, 1 or 2: a class is a context like any other, so rare expressions count alike for
    both. Pairs with no more than `cutoff` contexts aren't kept; what they would have goes to the backoff. The driver gets sums alone."""
    spark = counts.sparkSession
    n = [F.col(c) for c in ("n0", "n1")]
    n.append(sum((c > 0).cast("long") for c in n))
    tally = lambda c: [F.count_if(c == k) for k in (1, 2)]
    once = counts.agg(*(x for c in n for x in tally(c))).first()
    d = np.array([discount(a, b) for a, b in zip(once[::2], once[1::2], strict=True)])
    # As a word, t: before how many words it stands. As a context, c: its counts; m, k: those of pairs that are kept, and how many of these are above 0.
    kept, none = n[0] + n[1] > cutoff, F.lit(0).cast("long")
    names = [*(f"t{i}" for i in range(2)), *(f"{x}{i}" for x in "cmk" for i in range(3))]
    as_word = [*((c > 0).cast("long") for c in n[:2]), *[none] * 9]
    as_context = [*[none] * 2, *n, *(F.when(kept, c).otherwise(none) for c in n), *(((c > 0) & kept).cast("long") for c in n)]
    role = lambda word, values: counts.select(F.col(word).alias("key"), *(x.alias(a) for x, a in zip(values, names, strict=True)))
    with released(spark):
        known = saved(role("w", as_word).unionAll(role("v", as_context)).groupBy("key").agg(*(F.sum(x).alias(x) for x in names)))
    types = [F.col("t0"), F.col("t1")]
    types.append(sum((c > 0).cast("long") for c in types))
    size, *met = known.agg(F.count("key"), *(x for c in types for x in (F.sum(c), F.count_if(c > 0), *tally(c)))).first()

    def spread(c: Column, total, above, one, two):
        """Counts less their discount, as shares; what is spared for the level below."""
        e, total = discount(one, two), max(total or 0, 1)
        return F.greatest(c - F.lit(e), F.lit(0.0)) / F.lit(float(total)), 1.0 - ((total - e * above) / total if above else 0.0)

    uniform = 1.0 / (size + 1)
    level = [spread(c, *met[4 * i : 4 * i + 4]) for i, c in enumerate(types)]
    shared, unknown = level[2][0] + F.lit(level[2][1] * uniform), level[2][1] * uniform
    base = [taken + F.lit(spare) * shared for taken, spare in level[:2]]
    occurs = [F.greatest(F.col(f"c{i}"), F.lit(1)) for i in range(3)]
    left = [F.greatest(1.0 - (F.col(f"m{i}") - F.lit(float(d[i])) * F.col(f"k{i}")) / occurs[i], F.lit(1e-6)) for i in range(3)]  # rounding alone could leave less
    values = [x.cast("float").alias(f"x{i}") for i, x in enumerate([*base, *left, *(1.0 / c for c in occurs)])]
    return Model(table(known.select("key", *values), "<f4"), table(_keyed(counts.filter(kept)), "<i4"), d, np.array([spare * unknown for _, spare in level[:2]]))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps, in the given scale."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    ridge, b = np.diag([1e-3, *[0.05] * x.shape[1]]), np.zeros(1 + x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    slope = b[1:] / scale
    return np.array([b[0] - slope @ mean, *slope])


def fit(docs: DataFrame, labels: DataFrame, cutoff: int = 1) -> Model:
    """Learns from the whole texts of all labelled documents outside the held-out fold. One of their folds is kept from the counts and fits the weights and the
    prior that turn evidence into a score. With one class only, or none, the score of every text is the share of label 1."""
    f = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", f).filter(F.col("fold") != HELD_OUT)
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    prior = size.get(1, 0) / max(1, sum(size.values()))
    learned = rows if len(size) > 1 else rows.limit(0)
    sample = docs.select("doc_id", "text").join(F.broadcast(learned) if sum(size.values()) <= BROADCAST_LABELS else learned, "doc_id")
    sample = saved(sample.select("text", "toxic", "fold"))
    with released(docs.sparkSession):
        counts = saved(_counted(sample.filter(F.col("fold") != CALIBRATION)))
    model = kneser_ney(counts, cutoff)
    model.prior = prior
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"x{i}" for i in range(len(SPANS) + 1)]
    schema = pa.schema([("y", pa.int64()), *((x, pa.float64()) for x in names)])

    def measure(batches):
        out = Rows(schema)
        for text, toxic in rows_of(batches, "text", "toxic"):
            if out.add(toxic, *shared.value.evidence(text)):
                yield out.take()
        yield out.take()

    seen = sample.filter(F.col("fold") == CALIBRATION).select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(measure, f"y long, {', '.join(f'{x} double' for x in names)}").toPandas()
    y = seen["y"].to_numpy()
    if len(set(y)) == 2:
        share = np.array([(y == c).mean() for c in (0, 1)])
        true = np.array([1 - prior, prior])
        model.weights = _logistic(seen[names].to_numpy(), y, (true / share)[y])
    return model


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted, from whole texts alone. Null and empty texts are scored on no
    evidence; a null doc_id counts as held out; rows repeat as they come."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        out = Rows(SCORED)
        for doc, text in rows_of(batches, "doc_id", "text"):
            s = shared.value.score(text)
            if out.add(doc, fold(doc) == HELD_OUT, s, int(s >= 0.5)):
                yield out.take()
        yield out.take()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns. Where the labels fit no model, all stay."""
    fitted = fit(docs, labels)
    if fitted.weights is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def clean(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.value.score(t) < 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
