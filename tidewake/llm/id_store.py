"""Token ids in a content-addressed store.

Each text becomes a stream of token ids; a rolling hash over WINDOW ids cuts it into
chunks where its low bits are zero, so that an edit changes the chunks around it only.
A chunk is named by the SHA-256 of its bytes and stored once. A document's recipe lists
its chunks in order, with the root of their Merkle tree. Manifests hold the roots of
SHARD_DOCS consecutive doc_ids and the root of the tree over those. ``verify`` checks
chunks against their names, recipes and manifests against their roots, counts of ids
against bytes, and recipes against the manifests' leaves both ways; ``streams`` fails on
a chunk that is missing. The texts themselves aren't in the store to be held against.

One shuffle by key takes chunks, recipes and manifest leaves to where they are merged.

Rows of the store (kind, key, doc_id, position, n_ids, payload, refs, root):
chunk: payload has the ids, little-endian uint16 (uint32 if the vocabulary needs it).
recipe: refs has the chunks' keys end to end, n_ids the ids of the document, position its
place in training order, if ``store`` is told the column that has it.
manifest: payload has the doc_ids, refs the roots, n_ids the documents.

doc_ids that aren't integers are strings here: their manifests are by a hash, as many as
hold about SHARD_DOCS each, and payload has each one's length (4 bytes) before it; of an
integer it has 8 bytes.

Defined results: null and empty texts have a recipe without chunks, whose root is the
hash of nothing; repeated rows keep a recipe each and share chunks; null doc_ids are in
manifests of nulls, by the beginning of the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.runtime import arrow

from . import kernels as K
from .bpe import Encoder, default_ranks

WINDOW = 16
#: A cut where the hash has this many zero bits; chunks have LEAST to MOST ids, but the last of a text.
CUT_BITS = 8
LEAST, MOST = 64, 1024
SHARD_DOCS = 4096
_NAMES = ["kind", "key", "doc_id", "position", "n_ids", "payload", "refs", "root"]
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_EMPTY = hashlib.sha256(b"").digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over leaves; an odd node goes up as it is."""
    level = leaves
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else _EMPTY


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Chunk ends of each text."""
    if not len(ids):
        return [[] for _ in range(len(bounds) - 1)]
    end = np.arange(WINDOW, len(ids) + 1)
    h = K.Rolling(K.mix64(ids.astype(np.uint64) + np.uint64(1))).span(end - WINDOW, end)
    marks = end[h & np.uint64((1 << CUT_BITS) - 1) == 0]
    out = []
    lo, hi = np.searchsorted(marks, bounds[:-1]), np.searchsorted(marks, bounds[1:], "left")
    for a, b, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lo.tolist(), hi.tolist(), strict=True):
        ends, last = [], a
        for m in marks[i:j].tolist():
            if m - WINDOW < a:
                continue
            while m - last > MOST:
                last += MOST
                ends.append(last)
            if m - last >= LEAST:
                ends.append(m)
                last = m
        while b - last > MOST:
            last += MOST
            ends.append(last)
        if last < b:
            ends.append(b)
        out.append(ends)
    return out


def _schema(doc: str) -> str:
    return f"kind string, key binary, doc_id {doc}, position long, n_ids long, payload binary, refs binary, root binary"


def _batch(rows: list[tuple], doc: pa.DataType) -> pa.RecordBatch:
    types = [pa.string(), pa.binary(), doc, pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)


def _shard(doc, root: bytes, bits: int) -> bytes:
    if doc is None:
        return b"null" + root[:2]
    if isinstance(doc, str):
        return b"hash" + (int.from_bytes(hashlib.sha256(doc.encode("utf-8", "surrogatepass")).digest()[:8], "big") >> (64 - bits)).to_bytes(8, "big")
    return (doc // SHARD_DOCS).to_bytes(8, "big", signed=True)


def _packed(docs: list) -> bytes:
    each = [(d or "").encode("utf-8", "surrogatepass") if d is None or isinstance(d, str) else d for d in docs]
    return b"".join(d.to_bytes(8, "big", signed=True) if isinstance(d, int) else len(d).to_bytes(4, "big") + d for d in each)


def _unpacked(key: bytes, data: bytes) -> list | None:
    """The doc_ids of a manifest; None if its bytes don't read as such."""
    if len(key) == 8:
        return [int.from_bytes(data[i : i + 8], "big", signed=True) for i in range(0, len(data), 8)] if len(data) % 8 == 0 else None
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        out.append(None if key.startswith(b"null") else data[at + 4 : at + 4 + n].decode("utf-8", "surrogatepass"))
        at += 4 + n
    return out


def _emit(path: str, bits: int, doc_type: pa.DataType):
    def run(batches):
        encoder, seen = Encoder(path), set()
        small = len(encoder.ranks) <= 1 << 16
        for part, texts in K.text_batches(batches):
            ids, bounds = encoder.encode(texts)
            ends = cuts(ids, bounds)
            raw = memoryview((ids.astype("<u2") if small else ids.astype("<u4")).tobytes())
            width, rows = 2 if small else 4, []
            for doc, place, at, mine in zip(part.column("doc_id").to_pylist(), part.column("position").to_pylist(), bounds[:-1].tolist(), ends, strict=True):
                keys, first = [], at
                for e in mine:
                    data = raw[at * width : e * width]
                    key = hashlib.sha256(data).digest()
                    keys.append(key)
                    if key not in seen:
                        seen.add(key)
                        rows.append(("chunk", key, None, None, e - at, data, None, None))
                    at = e
                if len(seen) > 500_000:
                    seen.clear()
                root = merkle_root(keys)
                rows.append(("recipe", root, doc, place, at - first, None, b"".join(keys), root))
                rows.append(("manifest", _shard(doc, root, bits), doc, None, 1, None, None, root))
            if rows:
                yield _batch(rows, doc_type)

    return run


def _merge(batches, doc_type: pa.DataType):
    seen, shards = set(), defaultdict(list)
    for b in batches:
        kinds, keys = b.column("kind").to_pylist(), b.column("key").to_pylist()
        keep = []
        for i, (kind, key) in enumerate(zip(kinds, keys, strict=True)):
            if kind == "chunk":
                if key in seen:
                    continue
                seen.add(key)
            elif kind == "manifest":
                shards[key].append((b.column("doc_id")[i].as_py(), b.column("root")[i].as_py()))
                continue
            keep.append(i)
        if keep:
            yield b.take(pa.array(keep))
    for key, leaves in shards.items():
        leaves.sort(key=lambda x: (x[0] is not None, x[0], x[1]) if x[0] is not None else (False, x[1]))
        roots = [r for _, r in leaves]
        yield _batch([("manifest", key, None, None, len(leaves), _packed([d for d, _ in leaves]), b"".join(roots), merkle_root(roots))], doc_type)


def store(docs: DataFrame, ranks: str | None = None, position: str | None = None) -> DataFrame:
    """The store's rows for docs(doc_id, text, and a column of positions, if one is named)."""
    path, whole = ranks or default_ranks(), docs.schema["doc_id"].dataType.simpleString() in _WHOLE
    doc, doc_type = ("long", pa.int64()) if whole else ("string", pa.string())
    bits = 0 if whole else max(0, (docs.count() // SHARD_DOCS).bit_length())
    place = F.col(position).cast("long") if position else F.lit(None).cast("long")
    rows = arrow(docs.select(F.col("doc_id").cast(doc).alias("doc_id"), place.alias("position"), "text"), _emit(path, bits, doc_type), _schema(doc))
    # recipes needn't meet others of their key, which the copies of a text share
    where = F.when(F.col("kind") == "recipe", F.xxhash64("key", "doc_id", "position")).otherwise(F.xxhash64("key"))
    return arrow(rows.repartition(where), lambda batches: _merge(batches, doc_type), _schema(doc))


def streams(rows: DataFrame) -> DataFrame:
    """(doc_id, root, ids): each recipe's ids as bytes, put together from chunks."""
    recipes = rows.where("kind = 'recipe'").select(F.monotonically_increasing_id().alias("rid"), "doc_id", "root", "refs")
    at = recipes.select("rid", "doc_id", "root", F.posexplode_outer(F.expr("case when length(refs) = 0 then array() else transform(sequence(0, cast(length(refs) / 32 as int) - 1), i -> substring(refs, i * 32 + 1, 32)) end")).alias("pos", "ref"))
    chunks = rows.where("kind = 'chunk'").select(F.col("key").alias("ref"), "payload")
    parts = at.join(chunks, "ref", "left").groupBy("rid", "doc_id", "root").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("parts"))
    return parts.select("doc_id", "root", F.expr("aggregate(parts, cast('' as binary), (s, p) -> concat(s, coalesce(p.payload, case when p.pos is null then cast('' as binary) else cast(raise_error('a chunk of the recipe is missing') as binary) end)))").alias("ids"))


def _leaves(batches, doc_type: pa.DataType):
    """The (doc_id, root) that manifests hold."""
    for b in batches:
        for key, ids, roots in zip(b.column("key").to_pylist(), b.column("payload").to_pylist(), b.column("refs").to_pylist(), strict=True):
            docs, roots = _unpacked(key, ids or b"") or [], roots or b""
            n = min(len(docs), len(roots) // 32)  # verify tells of other lengths
            yield pa.RecordBatch.from_arrays([pa.array(docs[:n], doc_type), pa.array([roots[i * 32 : i * 32 + 32] for i in range(n)], pa.binary())], names=["doc_id", "root"])


def verify(rows: DataFrame) -> DataFrame:
    """(kind, key, problem) of what doesn't hold: chunks against their keys, recipes and manifests against their roots, parts and counts, and each against the other."""

    def check(batches):
        for b in batches:
            bad = []
            for r in b.to_pylist():
                kind, refs = r["kind"], [r["refs"][i : i + 32] for i in range(0, len(r["refs"] or b""), 32)]
                size = len(r["payload"] or b"")
                if kind == "chunk":
                    if hashlib.sha256(r["payload"] or b"").digest() != r["key"]:
                        bad.append((kind, r["key"], "bytes differ from the key"))
                    if size not in (2 * (r["n_ids"] or 0), 4 * (r["n_ids"] or 0)):
                        bad.append((kind, r["key"], "bytes differ from n_ids"))
                    continue
                if merkle_root(refs) != r["root"] or kind == "recipe" and r["key"] != r["root"]:
                    bad.append((kind, r["key"], "parts differ from the root"))
                if kind == "manifest":
                    ids = _unpacked(r["key"], r["payload"] or b"")
                    if ids is None or not len(refs) == r["n_ids"] == len(ids):
                        bad.append((kind, r["key"], "parts differ from n_ids"))
                    elif any(_shard(i, x, 64) != r["key"] for i, x in zip(ids, refs, strict=True) if not isinstance(i, str)):
                        bad.append((kind, r["key"], "a doc_id of another shard"))
            if bad:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*bad, strict=True), (pa.string(), pa.binary(), pa.string()), strict=True)], names=["kind", "key", "problem"])

    wrong = arrow(rows, check, "kind string, key binary, problem string")
    recipes = rows.where("kind = 'recipe'")
    parts = recipes.select("root", "n_ids", F.expr("case when coalesce(length(refs), 0) = 0 then array() else transform(sequence(0, cast(length(refs) / 32 as int) - 1), i -> substring(refs, i * 32 + 1, 32)) end").alias("refs")).distinct()
    asked = parts.select("root", "n_ids", F.explode_outer("refs").alias("ref"))
    chunks = rows.where("kind = 'chunk'").groupBy(F.col("key").alias("ref")).agg(F.max("n_ids").alias("has"), F.count("*").alias("times"))
    found = asked.join(chunks, "ref", "left")
    sums = found.groupBy("root", "n_ids").agg(F.sum(F.when(F.col("ref").isNotNull() & F.col("has").isNull(), 1).otherwise(0)).alias("lost"), F.coalesce(F.sum("has"), F.lit(0)).alias("has"))
    said = lambda df, kind, key, problem: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.lit(problem).alias("problem"))
    doc = rows.schema["doc_id"].dataType.simpleString()
    leaves = arrow(rows.where("kind = 'manifest'").select("key", "payload", "refs"), lambda batches: _leaves(batches, pa.string() if doc == "string" else pa.int64()), f"doc_id {doc}, root binary")
    both = leaves.select("doc_id", "root", F.lit(1).alias("leaf")).unionByName(recipes.select("doc_id", "root", F.lit(-1).alias("leaf")))
    uneven = both.groupBy("doc_id", "root").agg(F.sum("leaf").alias("more")).where("more <> 0")
    out = wrong.unionByName(said(sums.where("lost > 0"), "recipe", "root", "a chunk is missing"))
    out = out.unionByName(said(sums.where("lost = 0 and not n_ids <=> has"), "recipe", "root", "n_ids differ from the chunks"))
    out = out.unionByName(said(chunks.where("times > 1"), "chunk", "ref", "stands twice"))
    out = out.unionByName(said(uneven.where("more > 0"), "manifest", "root", "a leaf has no recipe"))
    return out.unionByName(said(uneven.where("more < 0"), "recipe", "root", "the recipe isn't in the manifest"))
