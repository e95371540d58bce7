"""Set-similarity join of documents by word shingles over a token-group matrix, and its connected components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Bucketed
from .common import Rows, packed, parts, rows_of, saved, text_key, unpacked
from .repeats import LAST
from .symbols import SPACED_FOLDED, grams, words

BUCKET_BITS = 17
POSTINGS = 1 << 21
BLOCK = 512  # documents of a group that are compared with each other in one task
TASK_EDGES = 2_000_000  # edges that one task joins to components
SHINGLES = 1 << 19  # and shingles that these have, about
SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("key", pa.binary()), ("lead", pa.bool_()), ("prefix", pa.list_(pa.int64()))])
SETS_DDL = "doc_id long, n long, sig binary, key binary, lead boolean, prefix array<long>"
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; of the whole sequence if it has fewer words; none without words."""
    w = words((text or "").encode(), SPACED_FOLDED)[2]
    return np.unique(grams(w, min(k, len(w)))) if len(w) else w


def least_overlap(n: int, num: int, den: int) -> int:
    """How many of a set's n shingles any set linked with it has at least."""
    return -(-num * n // den)


def least_common(num: int, den: int) -> int:
    """How many shingles of their prefixes two linked but unequal sets are asked to share: their overlap is at least t / (1 - t)."""
    return max(1, min(4, -(-num // max(1, den - num))))


def _frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles fall into each of 2**BUCKET_BITS hash buckets, over all documents: a table of fixed size. It orders
    shingles by rarity; any order gives the same links, and a good one few candidates."""
    chunks = 64
    schema = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
    ddl = "chunk int, part int, counts binary"

    def rows(counts):
        part = TaskContext.get().partitionId() % 1000
        return pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array([part] * chunks, pa.int32()), pa.array([c.tobytes() for c in np.split(counts, chunks)], pa.binary())], schema=schema)

    def count(batches):
        counts, held, size = np.zeros(1 << BUCKET_BITS, np.int64), [], 0
        for (text,) in rows_of(batches, "text"):
            if text:
                held.append((shingle_set(text, k) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
                size += len(held[-1])
            if size >= 1 << 18:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        if counts.any():
            yield rows(counts)

    def total(table: pa.Table) -> pa.Table:
        added = sum(np.frombuffer(c.as_py(), np.int64) for c in table["counts"])
        return pa.table([table["chunk"].slice(0, 1).combine_chunks(), table["part"].slice(0, 1).combine_chunks(), pa.array([added.tobytes()], pa.binary())], schema=schema)

    counted = docs.select("text").mapInArrow(count, ddl)  # up to 1000 of its tasks are added up first, so that no task gets a row of each
    summed = counted.groupBy("chunk", F.expr("part div 32")).applyInArrow(total, ddl).groupBy("chunk").applyInArrow(total, ddl).collect()
    out = np.zeros((chunks, (1 << BUCKET_BITS) // chunks), np.int64)
    for r in summed:
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """A row per document with its set's size, signature and prefix: its rarest shingles, of which any linked set shares least_common() at least."""
    spare = least_common(num, den)
    order = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, k))

    def scan(batches):
        out, seen = Rows(SETS), set()
        for doc, text in rows_of(batches, "doc_id", "text"):
            s = shingle_set(text, k)
            sig = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            lead, prefix = sig not in seen and len(s) > 0, ()
            if lead:
                seen.add(sig)
                rare = np.lexsort((s, order.value[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))
                prefix = s[rare[: len(s) - least_overlap(len(s), num, den) + spare]].view(np.int64)
            if out.add(doc, len(s), sig, text_key((text or "").encode()), lead, prefix, weight=200 + 8 * len(prefix)):
                yield out.take()
        yield out.take()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SETS_DDL)


def _candidates(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(k, n, pos, token, home) of the prefix shingles by which each distinct set, named k, may link with others. Sets with fewer shared prefix shingles than any link needs
    are left out. A set's home is its most common shared one, so that similar sets meet."""
    spread = sets.filter("lead").select(F.xxhash64("sig").alias("k"), "n", F.posexplode("prefix").alias("pos", "token"))
    small, large = F.min("n").alias("small"), F.max("n").alias("large")
    common = spread.groupBy("token").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count(F.lit(1)).alias("df"), small, large)
    common = common.filter("a != b").filter((F.col("df") > 2) | (F.col("small") * den >= F.col("large") * num))
    shared = saved(spread.join(saved(common.select("token", "df")), "token"))
    enough = shared.groupBy("k").agg(F.count_distinct("token").alias("c"), F.max(F.struct("df", "token"))["token"].alias("home")).filter(F.col("c") >= least_common(num, den))
    return saved(shared.drop("df").join(saved(enough.select("k", "home")), "k"))


def _blocks(members: DataFrame, group: list[str]) -> DataFrame:
    """members(.., sid, n) with the number of blocks that its group is dealt to, and its own block."""
    size = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SHINGLES)).cast("int")
    counted = saved(members.groupBy(*group).agg(size.alias("blocks"), F.count(F.lit(1)).alias("members")))
    return members.join(counted, group).withColumn("block", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int"))


def _asks(rooted: DataFrame, num: int, den: int, crowded: DataFrame | None = None) -> DataFrame:
    """(k, home): the homes that a set has to query; with `crowded`(home), (k, home, part) of these homes alone. rooted(k, n, pos, token, home, part, root):
    the candidates, the part of its home that each set lives in, and the component that it belongs to so far.

    The matrix has a row for each shingle and home, or part, that go together, with the sizes of its sets: the token unions. A set queries only where sets of other
    components are, that come before its own, as the other side covers the rest, and only where the union holds enough of its shingles and
    enough rows allow a link: neither size may be below the similarity times the other, and the first shingle must stand early enough in the prefix for the
    overlap to be reached. No text moves for it."""
    need, n = least_common(num, den), F.col("n")
    partner = F.greatest(F.col("small"), F.ceil(n * num / den).cast("long"))  # the least size that could link
    early = (n - F.col("pos")) * (num + den) >= (n + partner) * num
    fits = (partner <= F.col("large")) & (F.col("small") * num <= n * den) & ((F.col("r0") != F.col("root")) | (F.col("r1") != F.col("root")))
    enough = lambda rows, *keys: rows.groupBy(*keys).agg(F.count_distinct("token").alias("c"), F.max(early).alias("early")).filter((F.col("c") >= need) & F.col("early")).select(*keys)
    unions = lambda rows, *keys: saved(rows.groupBy("token", *keys).agg(F.min("n").alias("small"), F.max("n").alias("large"), F.min("root").alias("r0"), F.max("root").alias("r1")))
    held = rooted.withColumnsRenamed({"home": "other", "part": "of"})
    if crowded is None:
        asks = rooted.join(unions(held, "other"), "token").filter((F.col("other") < F.col("home")) & fits)
        return enough(asks, "k", "other").withColumnRenamed("other", "home")
    held = held.join(F.broadcast(crowded.select(F.col("home").alias("other"))), "other")
    asks = saved(enough(rooted.join(unions(held, "other"), "token").filter((F.col("other") <= F.col("home")) & fits), "k", "other"))
    again = rooted.join(asks, "k").join(unions(held, "other", "of"), ["token", "other"]).filter(((F.col("other") < F.col("home")) | (F.col("of") < F.col("part"))) & fits)
    return enough(again, "k", "other", "of").withColumnsRenamed({"other": "home", "of": "part"})


def _overlaps(queries: list[np.ndarray], members: list[np.ndarray], union: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each query with each member, over the group's union."""
    flat = lambda sets: (np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets))
    mo, mt = flat(members)
    qo, qt = flat(queries)
    mc = np.searchsorted(union, mt)
    qc = np.minimum(np.searchsorted(union, qt), len(union) - 1)
    hit = union[qc] == qt
    qo, qc = qo[hit], qc[hit]
    df = np.bincount(mc, minlength=len(union))
    qf = np.bincount(qc, minlength=len(union))
    used = np.flatnonzero((df > 0) & (qf > 0))
    out = np.zeros((len(queries), len(members)), np.float32)
    if len(qc) and (df[used] * qf[used]).sum() < len(queries) * len(members) * len(used) / 30:
        order = np.argsort(mc, kind="stable")
        start, who = np.concatenate(([0], np.cumsum(df))), mo[order]
        n = df[qc]
        steps = np.cumsum(n) // POSTINGS  # a bounded number of postings at a time
        for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.diff(steps, prepend=-1, append=steps[-1:] + 1))), strict=True):
            m, o, c = n[a:b], qo[a:b], qc[a:b]
            place = np.repeat(start[c] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            first, last = int(o[0]), int(o[-1]) + 1
            pairs = np.bincount((np.repeat(o, m) - first) * len(members) + who[place], minlength=(last - first) * len(members))
            out[first:last] += pairs.reshape(last - first, -1)
        return out
    if not len(used):
        return out
    column = np.full(len(union), -1)
    column[used] = np.arange(len(used))
    mc, qc = column[mc], column[qc]
    for a in range(0, len(used), 4096):
        block = []
        for o, c, rows in ((qo, qc, len(queries)), (mo, mc, len(members))):
            m = (c >= a) & (c < a + 4096)
            x = np.zeros((rows, min(4096, len(used) - a)), np.float32)
            x[o[m], c[m] - a] = 1
            block.append(x)
        out += block[0] @ block[1].T
    return out


def _local_components(linked: np.ndarray) -> np.ndarray:
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] < 0:
            reach = np.zeros(len(linked), bool)
            edge = np.array([i])
            reach[i] = True
            while len(edge):
                more = linked[edge].any(axis=0) & ~reach
                reach |= more
                edge = np.flatnonzero(more)
            label[reach] = i
    return label


def group_edges(members: list[tuple[int, np.ndarray]], visitors, num: int, den: int, roots: list[int] | None = None):
    """Edges that connect what links within the members and between visitors and members; not every link is listed. With the roots of the
    members, these have been compared already, and one of each component stands for it."""
    ids, sets = [i for i, _ in members], [s for _, s in members]
    union = np.unique(np.concatenate(sets))
    sizes = np.array([len(s) for s in sets])

    def links(queries):
        """Only queries whose overlap with the union of the group allows a link are compared with its members."""
        bound = np.array([np.count_nonzero(union[np.minimum(np.searchsorted(union, q), len(union) - 1)] == q) for q in queries])
        n = np.array([len(q) for q in queries])
        opened = np.flatnonzero(den * bound >= num * n)
        out = np.zeros((len(queries), len(sets)), bool)
        if len(opened):
            both = _overlaps([queries[i] for i in opened], sets, union)
            out[opened] = den * both >= num * (n[opened, None] + sizes - both)
        return out

    if roots is None:
        label = _local_components(links(sets))
        for i, c in enumerate(label):
            if c != i:
                yield ids[i], ids[c]
    else:
        _, first, number = np.unique(roots, return_index=True, return_inverse=True)
        label = first[number]
    for block in visitors:
        found = links([s for _, s in block])
        for (i, _), row in zip(block, found, strict=True):
            for c in np.unique(label[row]):
                yield i, ids[c]


def _compared(bodies: DataFrame, visits: DataFrame, k: int, num: int, den: int, known: bool) -> DataFrame:
    """(a, b): the edges of the groups of visits(gid, sid, key, role, root); role 0 are the members, 1 those that query them. known: members have been
    compared with each other. bodies(key, blob) are the texts, which lie in buckets by key, so that only those move that a group needs."""
    placed = bodies.join(saved(visits.groupBy("key").agg(F.collect_set(F.struct("gid", "sid", "role", "root")).alias("v"))), "key").select("blob", F.explode("v").alias("v"))
    dealt = placed.select("v.*", "blob").repartition(parts(visits.sparkSession), "gid").sortWithinPartitions("gid", "role", "sid")

    def compare(batches):
        out = Rows(EDGES)
        held = {"row": None}
        rows = rows_of(batches, "gid", "role", "sid", "root", "blob")

        def ahead():
            if held["row"] is None:
                held["row"] = next(rows, None)
            return held["row"]

        def take(gid, role, most):
            got, weight = [], 0
            while (r := ahead()) and r[0] == gid and r[1] == role and len(got) < most and weight < 2 * SHINGLES:
                got.append((r[2], shingle_set(unpacked(r[4]).decode(), k), r[3]))
                weight += len(got[-1][1])
                held["row"] = None
            return got

        while r := ahead():
            gid, members = r[0], []
            while more := take(gid, 0, BLOCK):
                members += more
            blocks = ([x[:2] for x in b] for b in iter(lambda g=gid: take(g, 1, BLOCK), []))
            for a, b in group_edges([x[:2] for x in members], blocks, num, den, [x[2] for x in members] if known else None):
                if a != b and out.add(a, b):
                    yield out.take()
        yield out.take()

    return saved(dealt.mapInArrow(compare, "a long, b long"))


def similar_pairs(docs: DataFrame, sets: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b) of sids: enough of the links to connect all that are linked.

    First the sets of a home are compared in blocks, and one of each connected part goes on to a next round, until a home's last ones fill one block or nothing
    connects any more: very many near copies shrink by a block's size each round, and never meet in pairs. Then each set queries the homes where other components
    may link with it, of a crowded one a single part: most often it connects. What other components are left in crowded homes is queried last, part by
    part, where sets of one component share parts."""

    def blobs(batches):
        out, seen = Rows(pa.schema([("key", pa.binary()), ("blob", pa.binary())])), set()
        for (text,) in rows_of(batches, "text"):
            data = (text or "").encode()
            key = text_key(data)
            if key not in seen:
                seen.add(key)
                blob = packed(data)
                if out.add(key, blob, weight=64 + len(blob)):
                    yield out.take()
        yield out.take()

    shared = _candidates(sets, num, den)
    named = texts.select("sid", "key", "n", F.xxhash64("sig").alias("k"))
    living = saved(shared.select("k", "home").distinct().join(named, "k").select("k", "home", "sid", "key", "n"))
    every = docs.select("text").mapInArrow(blobs, "key binary, blob binary")
    bodies = Bucketed(every.join(living.select("key"), "key", "left_semi").dropDuplicates(["key"]), "key")
    try:
        return _found(bodies.rows, shared, living, k, num, den)
    finally:
        bodies.drop(files=True)


def _found(bodies: DataFrame, shared: DataFrame, living: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The edges that similar_pairs gives; all are written when it returns."""

    def grown(edges):
        return living.join(components(edges), F.col("sid") == F.col("node"), "left").select(*living.columns, F.coalesce("root", "sid").alias("root"))

    def visits(members, queries, group):
        """Sets that query a group in numbers are dealt out, each lot with the group's members."""
        asked = queries.select("k", *group)
        lots = saved(asked.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("int").alias("lots")))
        gid = F.xxhash64(*group, "lot").alias("gid")
        here = members.join(lots, group, "left").withColumn("lot", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1)))
        there = asked.join(lots, group).withColumn("lot", F.pmod(F.xxhash64("k", F.lit(2)), F.col("lots")).cast("int")).select("k", gid).join(living.select("k", "sid", "key"), "k")
        return saved(here.select(gid, "sid", "key", F.lit(0).alias("role"), "root").unionByName(there.select("gid", "sid", "key", F.lit(1).alias("role"), F.lit(0).cast("long").alias("root"))))

    edges, members, size = None, living, None
    while True:
        dealt = saved(_blocks(members, ["home"]).filter("members > 1"))
        now = dealt.count()
        if not now or now == size:
            break
        size = now
        found = _compared(bodies, visits(dealt.withColumn("root", F.lit(0).cast("long")), dealt.limit(0), ["home", "block"]), k, num, den, False)
        edges = found if edges is None else edges.unionByName(found)
        members = dealt.filter("blocks > 1").select(*living.columns).join(found.select(F.col("a").alias("sid")).distinct(), "sid", "left_anti")
    if edges is None:
        return bodies.sparkSession.createDataFrame([], "a long, b long")
    at = _blocks(grown(edges), ["home"]).withColumn("bucket", F.pmod(F.xxhash64("root"), F.col("blocks"))).select(*living.columns, "root", "bucket", (F.col("blocks") > 1).alias("crowded"))
    at = saved(_blocks(at, ["home", "bucket"]).withColumn("part", F.shiftleft("bucket", 20) + F.col("block")).select(*living.columns, "root", "crowded", "part"))
    rooted = saved(shared.join(at.select("k", "part", "root"), "k"))
    asks = saved(_asks(rooted, num, den))
    first = at.groupBy("home").agg(F.min("part").alias("part"))
    near = at.join(asks.select("home").distinct(), "home").join(first, ["home", "part"])
    edges = edges.unionByName(_compared(bodies, visits(near, asks, ["home"]), k, num, den, True))
    crowded = saved(at.filter("crowded").select("home").distinct())
    if crowded.isEmpty():
        return edges
    at = saved(at.drop("root").join(grown(edges).select("k", "root"), "k"))
    rooted = saved(shared.join(at.select("k", "part", "root"), "k"))
    asks = saved(_asks(rooted, num, den, crowded))
    mixed = at.filter("crowded").groupBy("home", "part").agg((F.min("root") != F.max("root")).alias("mixed")).filter("mixed").select("home", "part")
    near = at.join(asks.select("home", "part").unionByName(mixed).distinct(), ["home", "part"])
    return edges.unionByName(_compared(bodies, visits(near, asks, ["home", "part"]), k, num, den, False))


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the least that each can reach: labels fall to the least neighbour's, and to their label's label."""
    nodes, both = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y = both[: len(u)], both[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _joined(batches):
    pairs = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if pairs:
        nodes, roots = least_reached(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
        yield from pa.table({"node": nodes[nodes != roots], "root": roots[nodes != roots]}).to_batches(65_536)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges can reach. A counted number of edges up to TASK_EDGES is joined in one task, more by large and small
    stars in turn: tables grow with the edges alone, and a star with very many leaves is joined from files, so that its rows can be dealt out."""
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    if now.count() <= TASK_EDGES:
        return saved(now.repartition(1).mapInArrow(_joined, "node long, root long"))
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == state or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = saved(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())


def similar_documents(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """docs(doc_id, text) -> doc_id, key (of the text), n_shingles, component_id (the smallest doc_id that links lead to), root.
    Documents link when den * intersection >= num * union of their shingle sets. Equal sets are one node, so copies
    cost nothing; documents without words link with nothing; null doc_ids are larger than others, and alone keep a null component. Where ids
    repeat or are null, only the root tells components apart; it is null without words."""
    sets = saved(_sets(docs, k, num, den))
    low = F.min(F.coalesce("doc_id", F.lit(LAST)))
    texts = saved(sets.filter("n > 0").groupBy("sig").agg(low.alias("low"), F.min("key").alias("key"), F.first("n").alias("n")).withColumn("sid", F.monotonically_increasing_id()))
    roots = components(similar_pairs(docs, sets, texts, k, num, den))
    named = texts.join(roots, F.col("sid") == F.col("node"), "left").select("sig", "low", F.coalesce("root", "sid").alias("root"))
    named = saved(named)
    leasts = saved(named.groupBy("root").agg(F.min("low").alias("component")))
    named = saved(named.join(leasts, "root").select("sig", "component", "root"))
    joined = sets.select("doc_id", "n", "sig", "key").join(named, "sig", "left")
    return joined.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.nullif(F.col("component"), F.lit(LAST))).otherwise(F.col("doc_id")).alias("component_id"), "root")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, with all their columns, but one alone of each component: that with the smallest doc_id and then text digest.
    Documents without words all stay."""
    at, ident = "__linkrank_key", "__linkrank_id"
    found = saved(similar_documents(docs.select("doc_id", "text"), k, num, den).filter("n_shingles > 0"))
    same = found.withColumn("id", F.coalesce("doc_id", F.lit(LAST)))
    best = same.groupBy("root").agg(F.min(F.struct("id", "key")).alias("best"))
    best = saved(best.select(F.col("best.key").alias("__linkrank_k"), F.col("best.id").alias("__linkrank_i")))
    keyed = docs.withColumn(at, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))).withColumn(ident, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    both = (F.col(at) == F.col("__linkrank_k")) & (F.col(ident) == F.col("__linkrank_i"))
    worded = keyed.join(best, both, "left_semi")
    copies = saved(same.groupBy("id", "key").count().filter("count > 1").select(F.col("key").alias("__linkrank_k"), F.col("id").alias("__linkrank_i")))
    if copies.limit(1).count():  # rows that agree in doc_id and text: the others need no pass over whole texts
        again = worded.join(copies, both, "left_semi").dropDuplicates([at, ident])
        worded = worded.join(copies, both, "left_anti").unionByName(again)
    wordless = keyed.join(saved(same.select(F.col("key").alias("__linkrank_k")).distinct()), F.col(at) == F.col("__linkrank_k"), "left_anti")
    return worded.unionByName(wordless).drop(at, ident)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_documents(docs).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
with recursive d as (select row_number() over () r, doc_id, coalesce(doc_id, 9223372036854775807) o,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct r, md5_number(array_to_string(w[i + 1 : i + 3], ' ')) h from (select r, w, unnest(range(greatest(len(w) - 2, 1))) i from d where len(w) > 0)),
n as (select r, count(*) n from s group by r),
p as (select x, y from (select a.r x, b.r y, count(*) c from s a join s b on a.h = b.h and a.r <> b.r group by 1, 2) join n a on a.r = x join n b on b.r = y where 100*c >= 90*(a.n + b.n - c)),
t(r, c) as (select r, r from n union select p.y, t.c from t join p on p.x = t.r),
least_of as (select t.r, min(d.o) c from t join d on d.r = t.c group by t.r)
select doc_id, coalesce(n, 0)::bigint n_shingles, case when n is null then doc_id else nullif(c, 9223372036854775807) end component_id from d left join n using (r) left join least_of using (r)
"""
