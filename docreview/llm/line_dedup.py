"""Repeated lines across documents, found by probing sharded minimal perfect hashes.

The keys of lines that occur in several documents are dealt by their hash into shards. Every shard is a minimal perfect
hash with three arrays in its order: fingerprints, which tell members from strangers, document counts, and the smallest
document of each key. Line hashes are routed to their shard, probe the arrays as a stream, and only the hashes to drop come
back to their document; lines themselves are never joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.llm.common import cut, table, whole

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
KEYS_PER_SHARD = 50_000
MIN_SHARDS_BITS = 10
GAMMA = 1.5
NO_ID = -(1 << 63)
_GOLDEN = 0x9E3779B97F4A7C15


def line_key(line: bytes) -> bytes | None:
    """The line stripped and with A-Z lower-cased; None where it has under ten code points."""
    key = line.strip(BLANK).lower()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return key


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((level + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def build_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bitmaps of a minimal perfect hash over distinct 64-bit keys, and the index of every key.

    Each level keeps the keys that are alone at their position; the others try the next level.
    """
    levels, index = [], np.zeros(len(keys), np.int64)
    left, base = np.arange(len(keys)), 0
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        at = (_mixed(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        index[left[placed]] = base + np.cumsum(alone)[at[placed]] - 1
        base += int(alone.sum())
        left = left[~placed]
        levels.append(alone)
    return levels, index


class Shard:
    """A shard's perfect hash and arrays, as unpacked from its row."""

    def __init__(self, sizes: list[int], bits: bytes, prints: bytes, counts: bytes, firsts: bytes):
        flat, at, base, self.levels = np.frombuffer(bits, np.uint8), 0, 0, []
        for size in sizes:
            n = (size + 7) // 8
            alone = np.unpackbits(flat[at:at + n], count=size).astype(bool)
            rank = np.cumsum(alone) - 1 + base
            self.levels.append((size, alone, rank))
            at, base = at + n, base + int(alone.sum())
        self.prints = np.frombuffer(prints, np.int64)
        self.counts = np.frombuffer(counts, np.int64)
        self.firsts = np.frombuffer(firsts, np.int64)

    def find(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for those that are not members."""
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = alone[at]
            found[left[hit]] = rank[at[hit]]
            left = left[~hit]
        found[found >= 0] = np.where(self.prints[found[found >= 0]] == prints[found >= 0], found[found >= 0], -1)
        return found


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _hash(key: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(key)
    return _signed(value >> 64), _signed(value & 0xFFFFFFFFFFFFFFFF)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, hash, print), once for each distinct key of a document."""
    for batch in batches:
        docs, hashes, prints = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen = {k for line in text.as_py().encode().split(b"\n") if (k := line_key(line)) is not None}
            for key in seen:
                h, p = _hash(key)
                docs.append(doc), hashes.append(h), prints.append(p)
            if len(docs) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, hashes, prints)], ["doc", "hash", "print"])
                docs, hashes, prints = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, hashes, prints)], ["doc", "hash", "print"])


INDEX = "sizes array<int>, bits binary, prints binary, counts binary, firsts binary"


def build_shards(counted: DataFrame) -> DataFrame:
    """One row per shard of `counted(shard, hash, print, n, first)`; a shard holds about KEYS_PER_SHARD keys."""

    def build(group: pa.Table) -> pa.Table:
        keys = group["hash"].to_numpy().view(np.uint64)
        levels, index = build_hash(keys)
        order = np.argsort(index)
        arrays = [pa.array([group["shard"][0].as_py()], pa.int64()), pa.array([[len(x) for x in levels]], pa.list_(pa.int32())),
                  pa.array([b"".join(np.packbits(x).tobytes() for x in levels)])]
        arrays += [pa.array([group[c].to_numpy()[order].tobytes()]) for c in ("print", "n", "first")]
        return pa.Table.from_arrays(arrays, ["shard", "sizes", "bits", "prints", "counts", "firsts"])

    return counted.groupBy("shard").applyInArrow(build, f"shard long, {INDEX}")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, a shard's index ahead of its probes; yields (doc, hash) to drop."""
    shard, current = None, None
    for batch in batches:
        codes = batch.column("shard").to_numpy()
        salts = batch.column("salt").to_numpy()
        index_at = np.flatnonzero(batch.column("is_probe").to_numpy() == 0).tolist()
        docs, hashes, prints = (pc.fill_null(batch.column(c), 0).to_numpy() for c in ("doc", "hash", "print"))
        edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(salts) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if index_at and a <= index_at[0] < b:
                at = index_at.pop(0)
                shard = int(codes[a])
                current = Shard(*(batch.column(c)[at].as_py() for c in ("sizes", "bits", "prints", "counts", "firsts")))
                a = at + 1
            if a == b or current is None or shard != codes[a]:
                continue  # no key of this shard repeats
            doc, h = docs[a:b], hashes[a:b]
            at = current.find(h.view(np.uint64), prints[a:b])
            drop = at >= 0
            drop[drop] = (current.firsts[at[drop]] != doc[drop]) & (current.counts[at[drop]] > 1)
            if drop.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[drop]), pa.array(h[drop])], ["doc", "hash"])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc, hashes) of `docs(doc, text)`: the hashes of the line keys that a document must lose."""
    lines = cut(docs.mapInArrow(_keys, "doc long, hash long, print long"))
    counted = lines.groupBy("hash", "print").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    counted = cut(counted.filter("first < last").drop("last"))
    bits = max(MIN_SHARDS_BITS, (counted.count() // KEYS_PER_SHARD).bit_length())
    of_hash = F.call_function("shiftrightunsigned", F.col("hash"), F.lit(64 - bits))
    counted = counted.withColumn("shard", of_hash)

    # A shard whose keys are asked for very often is copied, so that its probes spread over several tasks. At most 1,024
    # parts arise beyond one a shard, which bounds the broadcast.
    total = lines.count()
    part = max(1000, total // 1024)
    copies = counted.groupBy("shard").agg(F.ceil(F.sum("n") / part).cast("long").alias("copies")).filter("copies > 1")
    probes = lines.withColumn("shard", of_hash).join(F.broadcast(copies), "shard", "left").select(
        "shard", F.pmod(F.xxhash64("doc", "hash"), F.coalesce("copies", F.lit(1))).alias("salt"), F.lit(1).alias("is_probe"),
        "doc", "hash", "print", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in INDEX.split(", "))])
    shards = build_shards(counted).join(F.broadcast(copies), "shard", "left").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("salt"),
        F.lit(0).alias("is_probe"), *[F.lit(None).cast("long").alias(c) for c in ("doc", "hash", "print")],
        "sizes", "bits", "prints", "counts", "firsts")
    stream = shards.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "is_probe")
    replies = stream.mapInArrow(_probe, "doc long, hash long")
    return replies.groupBy("doc").agg(F.collect_list("hash").alias("hashes"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, hashes in zip(batch.column(1), batch.column(2)):
            lines = text.as_py().encode().split(b"\n")
            drop = set(hashes.as_py() or ())
            left = lines if not drop else [x for x in lines if (k := line_key(x)) is None or _hash(k)[0] not in drop]
            n_lines.append(len(lines)), n_dropped.append(len(lines) - len(left)), kept.append(b"\n".join(left).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
            ["row", "n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_dropped, kept): `row` is a struct of all columns but the text, so that no name can clash.

    A line is dropped when its key has ten code points at least, occurs in several documents, and this is not the one with
    the smallest id. A null or empty text is one empty line. A null id counts as the smallest; rows sharing an id are one
    document, so lines repeated only among them stay. A text that loses all its lines is empty.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID).cast("long"))
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), key.alias("doc"),
                       whole(text_col).alias("text"))
    drops = repeated_lines(work.select("doc", "text"))
    joined = work.join(drops, "doc", "left").select("row", "text", "hashes")
    schema = f"row {joined.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept string"
    return joined.mapInArrow(_without, schema)


def op3_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
counted AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN counted USING (k) GROUP BY doc_id
"""
