"""SimHash near-duplicates by the May-Ozerov nearest-neighbour recursion.

A text's fingerprint has BITS majority bits over its distinct word pairs (its words, if
it has one word). Texts whose fingerprints differ in at most ``radius`` bits are near
duplicates; groups are the connected components, and the least doc_id of a group stays.

Each repetition draws disjoint random coordinate strips. On a strip, random centres
filter a list: a fingerprint passes a centre if their partial distance on the strip is
at most CUT bits. A list of at most ``leaf`` fingerprints is searched by brute force; one
that holds more recurses on the next strip. What is still larger when the strips are used
up (a hot list of fingerprints that pass and fail together) is searched whole as well, in
blocks of ``leaf`` whose pairs are tasks of their own. A table of at most ``leaf``
fingerprints is one such list from the start, searched once.
Repetitions follow from the strip's exact survival probability for two fingerprints at
``radius`` and from ``recall``, at the depth that lists of even size would take; a list
that ends earlier loses less. A list's fingerprints that are known to be in one component
are not compared again, so a list of thousands of near copies takes linear time.

Defined results: equal fingerprints (copies among them) are one node, whatever their
number; a text without a word (null, empty, punctuation only) has no fingerprint and is
alone in its group; ties in doc_id are broken by a hash of the text, then by row; null
doc_ids come last; an empty table gives an empty result. Columns besides doc_id and text
are ignored by ``near_duplicates`` and carried by ``drop_duplicates``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.operators.closure import min_label_components
from tidewake.runtime import arrow, cut, fresh, ship, small

from . import kernels as K

BITS = 256
LANES = BITS // 64
STRIP = 64
#: Partial distance up to which a fingerprint passes a centre; 32 is the mean.
CUT = 24
#: Bits in which near duplicates differ at most.
RADIUS = 52
#: Recall aimed at for pairs that differ in just RADIUS bits; closer pairs have more.
RECALL = 0.95
#: Fingerprints in a list that is searched by brute force.
LEAF = 16_384
#: Centres a level, as a multiple of the inverse survival probability.
COVER = 2.0
_WORDS = [f"w{i}" for i in range(LANES)]


def _binomial(n: int, k: int) -> float:
    return math.comb(n, k) / 2.0**n


PASS = sum(_binomial(STRIP, k) for k in range(CUT + 1))


def both_pass(radius: int) -> float:
    """P(two fingerprints at that distance pass a random centre of one strip)."""
    total = 0.0
    for d in range(min(radius, STRIP) + 1):
        if radius - d > BITS - STRIP:
            continue
        here = math.comb(STRIP, d) * math.comb(BITS - STRIP, radius - d) / math.comb(BITS, radius)
        same = STRIP - d
        # i of the equal bits differ from the centre, j of the d others do in one text and d - j in the other
        both = sum(_binomial(same, i) * _binomial(d, j) for j in range(d + 1) for i in range(max(-1, CUT - max(j, d - j)) + 1) if i <= same)
        total += here * both
    return total


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(LANES words a text, whether it has a fingerprint)."""
    w = K.words(texts)
    rows = len(texts)
    doc, count = K.owner(w.first), np.diff(w.first)
    h = w.hash
    pair = K.mix64(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    joined = doc[:-1] == doc[1:]
    alone = np.flatnonzero(count == 1)
    key = np.concatenate([pair[joined], h[w.first[alone]]])
    of = np.concatenate([doc[:-1][joined], alone]).astype(np.uint64)
    key = np.sort(of << np.uint64(51) | key >> np.uint64(13))  # at most CHUNK_ROWS < 2 ** 12 texts
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    bounds = np.searchsorted(key, np.arange(rows + 1, dtype=np.uint64) << np.uint64(51))
    feature = key & np.uint64((1 << 51) - 1)
    out = np.zeros((rows, LANES), np.uint64)
    has = np.diff(bounds) > 0
    step = 1 << 17
    salts = K.mix64(np.arange(1, LANES + 1, dtype=np.uint64))
    sums = np.zeros((rows, BITS), np.int64)
    for a in range(0, len(key), step):
        f = feature[a : a + step]
        lanes = np.stack([K.mix64(f ^ s) for s in salts], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1)
        for i in range(int(np.searchsorted(bounds, a, "right")) - 1, rows):
            lo, hi = max(bounds[i] - a, 0), min(bounds[i + 1] - a, len(f))
            if lo >= len(f):
                break
            for x in range(lo, hi, 255):
                sums[i] += np.add.reduce(bits[x : min(hi, x + 255)], axis=0, dtype=np.uint8)
    n = np.diff(bounds)[:, None]
    total = np.zeros(rows, np.uint64)
    if has.any():
        total[has] = np.add.reduceat(feature, bounds[:-1][has])
    ties = np.unpackbits(np.ascontiguousarray(np.stack([K.mix64(total ^ s) for s in salts], axis=1)).view(np.uint8), axis=1)
    majority = np.where(2 * sums == n, ties, 2 * sums > n).astype(np.uint8)
    out[:] = np.packbits(majority, axis=1).view(np.uint64)
    return out, has


def _fingerprint_rows(batches):
    for part, texts in K.text_batches(batches):
        fp, has = fingerprints(texts)
        none = ~has
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("ckey"), *[pa.array(fp[:, i].view(np.int64), mask=none) for i in range(LANES)]],
            names=["doc_id", "ckey", *_WORDS],
        )


def _plan(n: int, radius: int, recall: float, leaf: int) -> tuple[int, int, int]:
    """(levels, centres a level, repetitions) for n fingerprints."""
    levels = 0 if n <= leaf else min(BITS // STRIP, math.ceil(math.log(n / leaf) / math.log(1 / PASS)))
    centres = math.ceil(COVER / PASS)
    if not levels:
        return 0, 1, 1
    found = (1 - (1 - both_pass(radius)) ** centres) ** levels
    return levels, centres, max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def _strips(repetition: int) -> np.ndarray:
    """(strip, lane) masks of disjoint random coordinates."""
    order = np.random.default_rng([7, repetition]).permutation(BITS)
    masks = np.zeros((BITS // STRIP, BITS), np.uint8)
    for i in range(BITS // STRIP):
        masks[i, order[i * STRIP : (i + 1) * STRIP]] = 1
    return np.packbits(masks, axis=1).view(np.uint64)


def _centres(repetition: int, level: int, n: int) -> np.ndarray:
    return np.random.default_rng([11, repetition, level]).integers(0, 1 << 64, (n, LANES), dtype=np.uint64)


_LIST = f"rep int, list long, fid long, {', '.join(f'{w} long' for w in _WORDS)}"


def _filtered(level: int, centres: int, repetitions: int):
    """Rows of lists, filtered by the centres of a level's strip; at level 0 each row begins all repetitions."""

    def lists(batches):
        for b in batches:
            fp = np.stack([np.asarray(b.column(w)).view(np.uint64) for w in _WORDS], axis=1)
            fid = np.asarray(b.column("fid"))
            rep = np.asarray(b.column("rep")) if level else None
            lst = np.asarray(b.column("list")).view(np.uint64) if level else None
            for a in range(0, len(fid), 8192):
                for r in range(repetitions) if not level else np.unique(rep[a : a + 8192]).tolist():
                    mine = np.arange(a, min(a + 8192, len(fid)))
                    if level:
                        mine = mine[rep[mine] == r]
                    block = fp[mine]
                    key = lst[mine] if level else np.full(len(mine), r, np.uint64)
                    mask, z = _strips(r)[level], _centres(r, level, centres)
                    at, to, masked = [], [], block & mask
                    for c in range(centres):
                        hit = np.flatnonzero(np.bitwise_count(masked ^ (z[c] & mask)).sum(axis=1, dtype=np.uint8) <= CUT)
                        at.append(hit)
                        to.append(K.mix64(key[hit] * np.uint64(centres) + np.uint64(c)))
                    rows, key = np.concatenate(at), np.concatenate(to)
                    out = block[rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), r, np.int32)), pa.array(key.view(np.int64)), pa.array(fid[mine][rows]), *[pa.array(out[:, i].view(np.int64)) for i in range(LANES)]],
                        names=["rep", "list", "fid", *_WORDS],
                    )

    return lists


def _leaf_lists(nodes: DataFrame, n: int, radius: int, recall: float, leaf: int) -> DataFrame:
    """(list, fid, words): the lists to be searched by brute force, of about ``leaf`` rows at most."""
    levels, centres, repetitions = _plan(n, radius, recall, leaf)
    rows = nodes.select(F.lit(0).alias("rep"), F.lit(0).cast("long").alias("list"), "fid", *_WORDS)
    if not levels:
        return rows.drop("rep")
    done = None
    for level in range(levels):
        rows = cut(arrow(rows, _filtered(level, centres, repetitions), _LIST))
        sizes = rows.groupBy("list").count().where(F.col("count") > leaf).select(F.col("list").alias("of"), F.col("count").alias("size"))
        sizes = cut(sizes)  # a row a list that is too long
        if sizes.isEmpty():
            return rows.drop("rep") if done is None else done.unionByName(rows.drop("rep"))
        big = small(sizes)
        ended = rows.join(big, rows["list"] == big["of"], "left_anti").drop("rep")
        done = ended if done is None else done.unionByName(ended)
        rows = rows.join(big, rows["list"] == big["of"]).select("rep", "list", "fid", *_WORDS, "size")
        if level < levels - 1:
            rows = rows.drop("size")
    # all pairs of blocks: a row is in as many pairs as its list has blocks
    blocks = F.ceil(F.col("size") / F.lit(leaf // 2)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other"))
    return done.unionByName(rows.select(pair.alias("list"), "fid", *_WORDS))


def close_edges(fp: np.ndarray, radius: int, block: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect each component of the graph of pairs within radius.

    Each fingerprint is expanded once, against those that nothing has reached so far and
    those that wait to be expanded, but for those that are known to be in its component.
    """
    rest, frontier, left, right = np.arange(len(fp)), np.zeros(0, np.int64), [], []
    tag, up = np.arange(len(fp)), {}  # a reached row has its leader's tag; tags of joined components lead to one root

    def near(a, b):
        # half of the lanes settle most pairs
        i, j = np.nonzero(sum(np.bitwise_count(fp[a, k][:, None] ^ fp[b, k]).astype(np.uint16) for k in range(LANES // 2)) <= radius)
        ok = sum(np.bitwise_count(fp[a[i], k] ^ fp[b[j], k]).astype(np.uint16) for k in range(LANES)) <= radius
        return i[ok], j[ok]

    def root(x):
        path = []
        while x in up:
            path.append(x)
            x = up[x]
        up.update((y, x) for y in path)
        return x

    def roots(rows):
        tags, index = np.unique(tag[rows], return_inverse=True)
        return np.array([root(x) for x in tags.tolist()], np.int64)[index]

    def join(a, b):
        left.append(a)
        right.append(b)
        x, y = roots(a), roots(b)
        differ = x != y
        for p, q in set(zip(x[differ].tolist(), y[differ].tolist(), strict=True)):
            p, q = root(p), root(q)
            if p != q:
                up[p] = q

    while len(rest) or len(frontier):
        if len(frontier) > block:
            frontier = frontier[np.argsort(roots(frontier), kind="stable")]  # blocks of one component, if it is large
        take, frontier = frontier[:block], frontier[block:]
        if len(take) < block:
            more = block - len(take)
            take, rest = np.concatenate([take, rest[:more]]), rest[more:]
        i, j = near(take, take)
        own = i < j
        join(take[i[own]], take[j[own]])
        if len(frontier):
            mine = np.unique(roots(take))
            others = frontier[roots(frontier) != mine[0]] if len(mine) == 1 else frontier
            if len(others):
                i, j = near(take, others)
                apart = roots(take)[i] != roots(others)[j]
                join(take[i[apart]], others[j[apart]])
        if len(rest):
            i, j = near(take, rest)
            if len(i):
                reached, first = np.unique(j, return_index=True)
                lead = i[first]
                tag[rest[reached]] = tag[take[lead]]
                join(take[lead], rest[reached])
                links = np.unique(lead[np.searchsorted(reached, j)] * block + i)  # rows of the block that meet at a reached one
                join(take[links // block], take[links % block])
                frontier = np.concatenate([frontier, rest[reached]])
                rest = np.delete(rest, reached)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    keep = a != b
    return a[keep], b[keep]


def _search(radius: int):
    def search(table: pa.Table) -> pa.Table:
        fp = np.stack([np.asarray(table.column(w).combine_chunks()).view(np.uint64) for w in _WORDS], axis=1)
        fid = np.asarray(table.column("fid").combine_chunks())
        order = np.argsort(fid)
        a, b = close_edges(fp[order], radius)
        x, y = fid[order][a], fid[order][b]
        return pa.table({"src": np.minimum(x, y), "dst": np.maximum(x, y)})

    return search


def _components(docs: DataFrame, radius: int, recall: float, leaf: int) -> DataFrame:
    """(doc_id, ckey, rid, node): a row a document; node is null without a fingerprint."""
    ship(docs.sparkSession)
    rows = arrow(docs.select("doc_id", F.xxhash64("text").alias("ckey"), "text"), _fingerprint_rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ckey long, {', '.join(f'{w} long' for w in _WORDS)}")
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))
    nodes = cut(rows.where(F.col(_WORDS[0]).isNotNull()).select(*_WORDS).distinct().withColumn("fid", F.monotonically_increasing_id()))
    n = nodes.count()
    lists = _leaf_lists(nodes, n, radius, recall, leaf)
    edges = lists.groupBy("list").applyInArrow(_search(radius), "src long, dst long").distinct()
    labels = min_label_components(cut(edges))  # (id, label) of nodes with an edge
    labelled = nodes.join(labels, nodes["fid"] == labels["id"], "left").select(*_WORDS, F.coalesce("label", "fid").alias("node"))
    return rows.join(labelled, _WORDS, "left").select("doc_id", "ckey", "rid", "node")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """A row for each document: doc_id, group_id (the doc_id that stays), group_size, keep."""
    rows = cut(_components(docs, radius, recall, leaf))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("ckey").alias("c"), F.col("rid").alias("d"))
    groups = rows.where("node is not null").groupBy(F.col("node").alias("of")).agg(F.min(order).alias("lead"), F.count("*").alias("group_size"))
    both = rows.join(groups, rows["node"] == groups["of"], "left")
    return both.select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("lead.b")).alias("group_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("node").isNull(), F.lit(True)).otherwise(F.col("lead.d") == F.col("rid")).alias("keep"), "ckey", "rid",
    )


def drop_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """docs with one document of each group of near duplicates, and its columns.

    Rows that agree in doc_id and text are one document.
    """
    found = cut(near_duplicates(docs, radius, recall, leaf))
    pairs = found.groupBy("doc_id", "ckey").agg(F.max("keep").alias("keep"), F.count("*").alias("n"))
    doc, key, mine = fresh(docs, "tw_doc", "tw_key", "tw_mine")
    gone = pairs.where(~F.col("keep")).select(F.col("doc_id").alias(doc), F.col("ckey").alias(key))
    out = docs.withColumn(mine, F.xxhash64("text"))
    out = out.join(small(gone), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(mine) == F.col(key)), "left_anti")
    if pairs.where("n > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", mine])
    return out.drop(mine)
