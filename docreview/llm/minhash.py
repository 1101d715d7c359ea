"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 64-bit words make a whole signature: shingle hashes are permuted once, and coordinate k is the
smallest image under the second permutation, shifted by k places. Documents that agree on a band are candidates. Equal sets
are one class first; each bucket then compares its members with a leader. How the members differ from the leader tells, by
counting, which of them can be linked although the leader does not connect them; only these meet as pairs, so a group of
near copies costs a star instead of all its pairs. Every link is confirmed on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.llm.common import cut, lookup, marked, slices, small_batches, spotted, table, whole

BANDS, ROWS = 20, 4
NO_ID = (1 << 63) - 1
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F))


def _permuted(x: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """A bijection of the 64-bit words."""
    x = (x ^ (x >> _U(30))) * a
    x = (x ^ (x >> _U(27))) * b
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a run of bytes that ends with a blank."""
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    # A word's hash is a difference of prefix sums of a polynomial, moved back to its start.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * _powers(_BASE, len(data)), dtype=np.uint64)))
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64)
    return starts, ends, _permuted(hashes, _FACTORS[2], _FACTORS[3])


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of `words` words of each text; a shorter text is one run."""
    starts, _, hashes = words_of(_LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)])
    first = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = min(words, b - a)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        mixed = np.full(b - a - n + 1, n, np.uint64)
        for i in range(n):
            mixed = (mixed + hashes[a + i:b - n + i + 1]) * _FACTORS[i % 2] + _U(i)
        out.append(np.unique(_permuted(mixed, _FACTORS[0], _FACTORS[1])))
    return out


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of a set that is not empty."""
    places = _permuted(shingles, _FACTORS[2], _FACTORS[1])
    shifts = np.arange(size, dtype=np.uint64)
    best = np.full(size, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(places), 1024):
        best = np.minimum(best, _permuted(places[at:at + 1024, None] + shifts, _FACTORS[0], _FACTORS[3]).min(axis=0))
    return best


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One hash per band, different bands never meeting on purpose."""
    rows = sig.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows.shape[1]):
        key = _permuted(key * _U(_BASE) + rows[:, r], _FACTORS[0], _FACTORS[1])
    return key.view(np.int64)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc, print, n, a, b, keys) of `docs(doc, text, print)`: size and two sums that identify the set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in slices(whole_batch, 1)):
            sets = shingle_sets(_texts(batch, 1), words)
            a = [int(_permuted(s, _FACTORS[3], _FACTORS[0]).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            b = [int(_permuted(s, _FACTORS[1], _FACTORS[2]).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            keys = [band_keys(signature(s, bands * rows), bands) if len(s) else np.zeros(0, np.int64) for s in sets]
            offsets = pa.array(np.cumsum([0, *map(len, keys)], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64()))],
                ["doc", "print", "n", "a", "b", "keys"])

    return docs.mapInArrow(run, "doc long, print long, n long, a long, b long, keys array<long>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(doc, items): the whole shingle set as sorted 64-bit words."""

    def run(batches):
        for batch in (part for whole_batch in batches for part in slices(whole_batch, 1)):
            items = [s.tobytes() for s in shingle_sets(_texts(batch, 1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], ["doc", "items"])

    return docs.mapInArrow(run, "doc long, items binary")


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, linked, n_u, n_v, diff) of `pairs(u, v)`: whether the whole sets are similar enough, and how they differ."""
    left = lookup(pairs, sets.select(F.col("doc").alias("u"), F.col("items").alias("left")), "u", "v")
    both = lookup(left, sets.select(F.col("doc").alias("v"), F.col("items").alias("right")), "v", "u")

    def run(batches):
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            linked, n_u, n_v, diffs = [], [], [], []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                union = np.concatenate((x, y))
                union.sort(kind="stable")
                twice = union[1:] == union[:-1]
                shared = int(twice.sum())
                linked.append(100 * shared >= percent * (len(union) - shared))
                n_u.append(len(x)), n_v.append(len(y))
                diffs.append(union[~(np.append(twice, False) | np.append(False, twice))].view(np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, diffs)], dtype=np.int32))
            diff = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(diffs) if diffs else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_()),
                                              pa.array(n_u, pa.int64()), pa.array(n_v, pa.int64()), diff],
                                             ["u", "v", "linked", "n_u", "n_v", "diff"])

    return both.select("u", "v", "left", "right").mapInArrow(run, "u long, v long, linked boolean, n_u long, n_v long, diff array<long>")


def pairs_beyond(stars: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pairs of members of one star, in different components, that could still be linked.

    `stars(u, v, linked, n_u, n_v, diff)` compares the leader u with each member v. Sets a and b are linked if they differ in
    at most t * (|a| + |b|) elements, t = (100 - percent) / (100 + percent). With A and B what a and b differ in from the
    leader, they differ in |A| + |B| - 2 |A & B|. So members that differ from the leader in different places are refuted by
    sizes alone, and the others must share m elements of A and B; then they share one among the |A| - m + 1 elements of A
    and the |B| - m + 1 of B that are rarest in the star. One of the pair, a, is not linked to the leader, since otherwise
    both are in its component; hence 2m > |B| + t (leader - |b|), and m >= |A| - t (|a| + |b|) because m <= |B|. Elements
    that no other member has need no index entry, so copies with edits of their own meet nobody.
    Stars with one member have no such pairs.
    """
    t = (100 - percent) / (100 + percent)
    size = F.size("diff").cast("long")
    half = size - F.floor((size + t * (F.col("n_u") - F.col("n_v"))) / 2 - 1e-6)
    long = size - F.greatest(F.lit(1), F.ceil(size - t * F.col("n_v") * (1 + 100 / percent) - 1e-6)) + 1
    several = stars.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    members = cut(lookup(stars, several.withColumn("several", F.lit(True)), "u", "v").filter("several").select(
        "u", "v", "linked", "n_v", size.alias("size"), F.greatest(half, F.lit(0)).alias("half"),
                               F.greatest(long, F.lit(0)).alias("long"), "diff")
                  .join(roots.select("v", "root"), "v", "left").withColumn("root", F.coalesce("root", "v")))
    items = members.select("u", "v", F.explode("diff").alias("item")).withColumn("key", F.xxhash64("u", "item"))
    common = items.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    shared = lookup(items, common, "key", "v").filter("df IS NOT NULL").groupBy("u", "v").agg(
        F.array_sort(F.collect_list(F.struct("df", "key"))).alias("shared"))
    indexed = cut(members.drop("diff").join(shared, ["u", "v"]).withColumn("own", F.col("size") - F.size("shared")))

    def entries(rows: DataFrame, prefix: str) -> DataFrame:
        kept = F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.least(F.size("shared"), F.col(prefix) - F.col("own"))).cast("int"))
        return rows.select("v", "n_v", "size", "own", "root", F.posexplode(kept).alias("i", "e")).select(
            "v", "n_v", "size", "root", (F.col("own") + F.col("i") + 1).alias("place"), "e.key")

    any_member = cut(entries(indexed, "half"))
    unlinked = cut(entries(indexed.filter("NOT linked"), "long"))
    mixed = any_member.unionByName(unlinked).groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    a = unlinked.join(mixed.select("key"), "key").alias("a")
    b = any_member.join(mixed.select("key"), "key").alias("b")
    fits = 100 * F.least("a.n_v", "b.n_v") >= percent * F.greatest("a.n_v", "b.n_v")
    need = (F.col("a.size") + F.col("b.size") - t * (F.col("a.n_v") + F.col("b.n_v"))) / 2 - 1e-6
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & fits
                 & (need <= F.col("a.size") - F.col("a.place") + 1) & (need <= F.col("b.size") - F.col("b.place") + 1))
    return met.select(F.least("a.v", "b.v").alias("u"), F.greatest("a.v", "b.v").alias("v")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) for every node of `links(u, v)` but the roots: the smallest node reachable.

    Every round hangs the larger neighbours of each node on the smallest one, then the smaller ones (large and small stars);
    the graph is a set of stars around the roots when a round changes nothing.
    """

    def smallest(edges: DataFrame) -> DataFrame:
        mins = edges.groupBy("at").agg(F.min("other").alias("least"))
        return lookup(edges, mins.withColumn("least", F.least("at", "least")), "at", "other")

    edges, before = cut(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()), None
    for _ in range(rounds):
        both = edges.select(F.col("u").alias("at"), F.col("v").alias("other")).union(edges.select("v", "u"))
        down = cut(smallest(both).filter("other > at").select(F.col("least").alias("u"), F.col("other").alias("v")).filter(
            "u < v").distinct()).select(F.col("v").alias("at"), F.col("u").alias("other"))
        small = smallest(down)
        edges = cut(small.select("least", "other").union(small.select("least", "at")).toDF("u", "v").filter("u < v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select("v", F.col("u").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def centre_stars(compared: DataFrame) -> DataFrame:
    """(u, v): every star of two members at least with the member nearest to its leader as the leader, the old one as a member.

    Two stars may get the same leader; they are one star then, which only adds pairs to look at.
    """
    near = compared.groupBy("u").agg(F.min(F.struct(F.size("diff").alias("d"), "v")).alias("near"), F.count("*").alias("n")).filter("n > 1")
    centre = near.select("u", F.col("near.v").alias("centre"))
    moved = lookup(compared.select("u", "v"), centre, "u", "v").filter("centre IS NOT NULL")
    others = moved.filter("v <> centre").select(F.col("centre").alias("u"), "v")
    return others.union(centre.select("centre", "u")).distinct()


def rest_stars(crowded: DataFrame, compared: DataFrame) -> DataFrame:
    """(u, v): in every bucket, the first member that its leader does not link, and the others like it."""
    unlinked = compared.filter("NOT linked").select(F.col("u").alias("leader"), F.col("v").alias("rep"))
    rest = crowded.select("key", "leader", "rep").join(unlinked, ["leader", "rep"]).select("key", "rep")
    firsts = rest.groupBy("key").agg(F.min("rep").alias("first"))
    return lookup(rest, firsts, "key", "rep").filter("rep <> first").select(F.col("first").alias("u"), F.col("rep").alias("v")).distinct()


def near_rows(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, doc, print, n, root) for every row of `docs(doc, text)`; root is the smallest node reachable over links.

    A node is a row: it gets a number of its own when the signatures are written, so rows that share a doc (or have none,
    read as NO_ID) keep their own texts and links. (doc, print), the doc and a hash of the text, finds the row again in `docs`.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets. Texts without words are linked
    with nothing; null texts are empty. Every pair that agrees on a band is confirmed or refuted, apart from pairs already
    known to be connected; see pairs_beyond().
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce("doc", F.lit(NO_ID)).cast("long").alias("doc"), whole("text").alias("text")).withColumn(
        "print", F.xxhash64("text"))
    sigs = cut(signatures(docs, words, bands, rows).withColumn("node", F.monotonically_increasing_id()))
    shaped = sigs.select("node", "doc", "print", "n", F.struct("n", "a", "b").alias("set"))
    classes = shaped.filter("n > 0").groupBy("set").agg(F.min("node").alias("rep"))
    members = cut(lookup(shaped, classes, "set", "node").select(
        "node", "doc", "print", "n", F.coalesce("rep", "node").alias("rep")))
    reps = cut(sigs.join(classes.select(F.col("rep").alias("node")), "node").select(F.col("node").alias("rep"), "doc", "print", "n", "keys"))
    entries = reps.select("rep", "n", F.explode("keys").alias("key"))
    leaders = entries.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last").drop("last")
    crowded = cut(lookup(entries, leaders, "key", "rep").filter("leader IS NOT NULL"))
    stars = cut(crowded.filter("rep <> leader").select(F.col("leader").alias("u"), F.col("rep").alias("v")).distinct())
    asked = cut(crowded.select("rep").distinct().join(reps.select("rep", "doc", "print"), "rep"))
    mark = F.xxhash64("doc", "print")
    texts = marked(docs.withColumn("mark", mark), "mark", asked.select(mark.alias("mark"))).groupBy("doc", "print").agg(
        F.min("text").alias("text"))
    sets = cut(sets_of(texts.join(asked, ["doc", "print"]).select(F.col("rep").alias("doc"), "text"), words))
    compared = cut(compare(stars, sets, percent))
    links = compared.filter("linked").select("u", "v")
    # The member nearest to its leader is nearest to what all copies come from: it leads the star once more. Members that
    # no leader linked choose one among themselves.
    centred = cut(centre_stars(compared))
    second = cut(rest_stars(crowded, compared).join(centred, ["u", "v"], "left_anti"))
    compared = cut(compare(centred, sets, percent))
    found = compared.filter("linked").select("u", "v").union(compare(second, sets, percent).filter("linked").select("u", "v"))
    roots = components(links.union(found))
    tried = stars.union(second).union(centred.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    pairs = cut(pairs_beyond(compared, roots, percent).join(tried, ["u", "v"], "left_anti"))
    more = compare(pairs, sets, percent).filter("linked").select("u", "v")
    roots = components(roots.select(F.col("root").alias("u"), "v").union(more))
    out = members.join(roots.withColumnRenamed("v", "rep"), "rep", "left")
    return cut(out.select("node", "doc", "print", "n", F.coalesce("root", "rep").alias("root")))


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc, n, root) for every row of `docs(doc, text)`: the set size and the smallest doc reachable over links.

    A null doc comes after all others and is null again in the result. Rows that share a doc are rows of their own: each is
    linked by its own text, so they may end in different components. See near_rows().
    """
    found = near_rows(docs, words, percent, bands, rows)
    first = found.groupBy("root").agg(F.min("doc").alias("least"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias
    return lookup(found, first, "root", "node").select(back("doc")("doc"), "n", back("least")("root"))


def one_of_each(docs: DataFrame, key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without those that an earlier row of their component stands for.

    Of a component the row with the smallest `key` stays (null after all others, ties by a hash of the text, then by the
    other columns as JSON). Rows in no group, texts without words among them, pass by without a shuffle of their texts.
    """
    found = near_rows(docs.select(F.col(key).alias("doc"), "text"), words, percent)
    groups = found.groupBy("root").agg(F.count("*").alias("rows"), F.min(F.struct("doc", "print")).alias("first")).filter("rows > 1")
    member = lookup(found.select("node", "doc", "print", "root"), groups, "root", "node").filter("first IS NOT NULL")
    touched = cut(member.groupBy("doc", "print").agg(
        F.max((F.col("first.doc") == F.col("doc")) & (F.col("first.print") == F.col("print"))).alias("stays")))
    work = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(key, F.lit(NO_ID)).cast("long").alias("doc"),
                       F.xxhash64(whole("text")).alias("print"))
    work = spotted(work.withColumn("mark", F.xxhash64("doc", "print")), "mark", touched.select(F.xxhash64("doc", "print").alias("mark")))
    met = work.filter("spotted").join(touched, ["doc", "print"], "left")
    alone = work.filter("NOT spotted").select("row").union(met.filter("stays IS NULL").select("row"))
    kept = met.filter("stays").groupBy("doc", "print").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return alone.union(kept).select("row.*")


def op6_minhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return near_components(docs, words=3, percent=85).select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"),
        F.col("doc").eqNullSafe(F.col("root")).alias("kept"))
