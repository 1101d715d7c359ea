"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, by sparse products over whole corpora.

A text is cut into units before every blank that follows a character which is no white space. Tokens of neither tokenizer
cross such a place (checked against the vocabulary when it is read), so a unit has the same tokens in every text, and a block
of documents aligns each distinct unit once. On the bytes of a block's units, token-byte incidence matrices A and B are built
in CSR; the row products of A * B^T are the overlap links. Along these a new group begins where both tokens change, which
gives the group incidence matrices, whose product is the shared-group links; equal ids of a group are one entry with a
count, so a group of thousands of repeated tokens costs no pairs.

Blocks are written once, packed. Their distinct id pairs are counted over all blocks by a shuffle on the pair, and what a
block asked for returns to it by a shuffle on the block; no table of pairs is collected or broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docreview.llm.common import shared_dir, table, whole

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20
"""Text of a block; one longer document is a block of its own."""
RUN = 256
"""Units that pass through a tokenizer in one string."""
UNIT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")
BLANK = "▁"
"""Fixed by the piece vocabulary: the mark that stands for a blank, U+2581."""


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes as: visible Latin-1 characters stand for
    themselves, the other bytes follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """One tokenizer: `encode(texts)` gives a list of ids per text that begins with a blank, `bytes_of[id]` what an id covers."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = bytes_of
        self.lengths = np.array([len(b) for b in bytes_of], np.int64)
        self.decimal = {mark: np.array([f"{i}{mark}" for i in range(len(bytes_of))], object) for mark in ",|;"}


class ByteLevel(Side):
    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(data)
        splitter = spec["pre_tokenizer"]
        if spec["normalizer"] or splitter["type"] != "ByteLevel" or not splitter["use_regex"]:
            raise ValueError("units need a byte-level vocabulary without a normalizer")
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = True
        alphabet, size = byte_alphabet(), self.tokenizer.get_vocab_size(with_added_tokens=True)
        found = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            found[i] = bytes(alphabet[c] for c in token)
        super().__init__(found)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(Side):
    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        found = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if BLANK in piece.lstrip(BLANK):
                raise ValueError(f"units need pieces without an inner blank, not {piece!r}")
            found.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(BLANK, " ").encode())
        self.blank = self.model.piece_to_id(BLANK)
        super().__init__(found)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The model puts a blank before what it is given: the one that every text begins with."""
        ids = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [[self.blank] if t == " " else found for t, found in zip(texts, ids)]


def gustavson(row: np.ndarray, idx: np.ndarray, weight: np.ndarray, ptr: np.ndarray, cols: np.ndarray, vals: np.ndarray,
              width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row products: entries (row, idx, weight) of the left matrix, rows ascending, each scale row `idx` of the right one
    (ptr, cols, vals); products that fall on one cell are added. Returns rows, columns and values in order."""
    many = ptr[idx + 1] - ptr[idx]
    at = np.arange(int(many.sum())) + np.repeat(ptr[idx] - np.cumsum(many) + many, many)
    keys = np.repeat(row, many) * width + cols[at]
    found = np.repeat(weight, many) * vals[at]
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, found = keys[order], found[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    cells = keys[first]
    return cells // width, cells % width, np.add.reduceat(found, first) if len(first) else found


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def pointers(sorted_rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_rows, np.arange(n + 1))


def spelt(side: Side, ids: list[int]) -> bytes:
    return b"".join([side.bytes_of[i] for i in ids])


class Aligned:
    """The alignment of a list of units; units whose tokens do not spell them have none (`good` is false)."""

    def __init__(self, units: list[str], a: Side, b: Side):
        # Units that end in a character go through a tokenizer joined, since none of its tokens crosses the next blank.
        runs, open_run = [], False
        for i, unit in enumerate(units):
            if open_run and i - runs[-1] < RUN:
                open_run = not unit[-1].isspace()
            else:
                runs.append(i)
                open_run = not unit[-1].isspace()
        runs.append(len(units))
        joined = ["".join(units[i:j]) for i, j in zip(runs, runs[1:])]
        raw, lists = [x.encode() for x in joined], [side.encode(joined) for side in (a, b)]
        same = [spelt(a, x) == spelt(b, y) == z for x, y, z in zip(*lists, raw)]
        self.good = np.ones(len(units), bool)
        if not all(same):  # a run with a unit that a side does not spell: its units one by one
            parts = [(i, j, ok) for i, j, ok in zip(runs, runs[1:], same)]
            kept: tuple[list, list] = ([], [])
            for (i, j, ok), x, y in zip(parts, *lists):
                for all_ids, side, ids in zip(kept, (a, b), (x, y)):
                    all_ids += [ids] if ok else side.encode(units[i:j])
                for at in [] if ok else range(i, j):
                    back = at - j
                    self.good[at] = spelt(a, kept[0][back]) == spelt(b, kept[1][back]) == units[at].encode()
                    if not self.good[at]:
                        kept[0][back], kept[1][back] = [], []
            lists = list(kept)
        ids_a, ids_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in lists)
        sizes = np.fromiter((len(u) if u.isascii() else len(u.encode()) for u in units), np.int64, len(units)) * self.good
        border = np.cumsum(sizes)
        self.n_a, self.n_b = (np.diff(np.searchsorted(np.cumsum(side.lengths[ids]), border, "right"), prepend=0)
                              for side, ids in ((a, ids_a), (b, ids_b)))
        ends_a = np.concatenate([[0], np.cumsum(a.lengths[ids_a])])
        # A is (tokens x bytes) with one run of bytes per token; in B^T every byte has one token
        byte = np.arange(ends_a[-1])
        token_a = np.repeat(np.arange(len(ids_a)), np.diff(ends_a))
        token_b = np.repeat(np.arange(len(ids_b)), b.lengths[ids_b])
        ones = np.ones(len(byte), np.int64)
        link_a, link_b, self.shared_bytes = gustavson(token_a, byte, ones, np.arange(len(byte) + 1), token_b, ones, max(len(ids_b), 1))
        both = np.ones(len(link_a), bool)
        both[1:] = (link_a[1:] != link_a[:-1]) & (link_b[1:] != link_b[:-1])
        group = np.cumsum(both) - 1
        group_a, group_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        group_a[link_a], group_b[link_b] = group, group
        groups = int(group[-1]) + 1 if len(group) else 0
        unit_a = np.repeat(np.arange(len(units)), self.n_a)
        unit_of = np.zeros(groups, np.int64)
        unit_of[group_a] = unit_a
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        self.n_groups = np.bincount(unit_of, minlength=len(units))
        self.n_links = np.bincount(unit_of, weights=in_a * in_b, minlength=len(units)).astype(np.int64)
        # entries (group, id) with counts on both sides; their product over the groups
        width_a, width_b = len(a.bytes_of), len(b.bytes_of)
        cell_a, times_a = counted(group_a * width_a + ids_a)
        cell_b, times_b = counted(group_b * width_b + ids_b)
        ptr_b = pointers(cell_b // width_b, groups)
        row, id_b, links = gustavson(np.arange(len(cell_a)), cell_a // width_a, times_a, ptr_b, cell_b % width_b, times_b, width_b)
        pair = (cell_a % width_a)[row] * width_b + id_b
        self.pairs, where = np.unique(pair, return_inverse=True)
        unit = unit_of[(cell_a // width_a)[row]]
        # units x pairs: groups of a unit are added up
        key = unit * max(len(self.pairs), 1) + where
        order = np.argsort(key, kind="stable")
        key, links = key[order], links[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        cells = key[first]
        self.links = np.add.reduceat(links, first) if len(first) else links
        self.pair_ptr, self.pair_idx = pointers(cells // max(len(self.pairs), 1), len(units)), cells % max(len(self.pairs), 1)
        self.texts = self._texts(a, b, ids_a, ids_b, group_a, group_b, in_a, in_b)

    def _texts(self, a, b, ids_a, ids_b, group_a, group_b, in_a, in_b) -> list[str]:
        """`a1,a2|b1;...;` of every unit, the last mark included."""
        before = np.cumsum(in_a + in_b) - in_a - in_b
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        out = np.empty(len(ids_a) + len(ids_b), object)
        at_a = before[group_a] + np.arange(len(ids_a)) - first_a[group_a]
        at_b = before[group_b] + in_a[group_b] + np.arange(len(ids_b)) - first_b[group_b]
        last_a = np.arange(len(ids_a)) - first_a[group_a] == in_a[group_a] - 1
        last_b = np.arange(len(ids_b)) - first_b[group_b] == in_b[group_b] - 1
        for at, ids, last, side, mark in ((at_a, ids_a, last_a, a, "|"), (at_b, ids_b, last_b, b, ";")):
            out[at] = side.decimal[","][ids]
            out[at[last]] = side.decimal[mark][ids[last]]
        parts, ptr = out.tolist(), np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return ["".join(parts[i:j]) for i, j in zip(ptr[:-1], ptr[1:])]


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, in two bytes each where they fit."""
    short = not len(values) or int(values.max()) < 1 << 16
    raw = values.astype(np.uint16 if short else np.int64).tobytes()
    return bytes([short]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), "zstd", asbytes=True)
    return np.frombuffer(raw, np.uint16 if data[0] else np.int64).astype(np.int64)


@lru_cache(maxsize=1)
def _sides(byte_level: bytes, pieces: bytes) -> tuple[Side, Side]:
    return ByteLevel(byte_level), Pieces(pieces)


ARRAYS = ("unit_ptr", "unit_idx", "pair_ptr", "pair_idx", "links")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def block_of(texts: list[str], a: Side, b: Side) -> dict:
    """The block's documents as rows of unit numbers, its units as rows of pair numbers, and the pairs it asks for."""
    index: dict[str, int] = {}
    rows = []
    for text in texts:
        units = UNIT.findall(" " + text) if text else []
        rows.append(np.array([index.setdefault(u, len(index)) for u in units], np.int64))
    done = Aligned(list(index), a, b)
    rows = [row if done.good[row].all() else row[:0] for row in rows]
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    flat = np.concatenate([*rows, np.zeros(0, np.int64)])
    out = {name: [int(x[r].sum()) for r in rows] for name, x in ((n, getattr(done, n)) for n in COUNTS)}
    written = ("".join([done.texts[u] for u in r.tolist()])[:-1] for r in rows)
    out["groups_sha256"] = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in written]
    # documents x units times units x pairs: a document holds a pair or not
    doc = np.repeat(np.arange(len(rows)), np.diff(ptr))
    held = np.unique(doc * max(len(index), 1) + flat) if len(flat) else flat
    _, cols, _ = gustavson(held // max(len(index), 1), held % max(len(index), 1), np.ones(len(held), np.int64), done.pair_ptr, done.pair_idx,
                           done.links, max(len(done.pairs), 1))
    holders = np.bincount(cols, minlength=len(done.pairs))
    arrays = dict(zip(ARRAYS, (ptr, flat, done.pair_ptr, done.pair_idx, done.links)))
    return out | {k: packed(v) for k, v in arrays.items()} | {"pairs": done.pairs, "holders": holders}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in runs of BLOCK_BYTES of text, across the borders of Arrow batches."""
    held, size = [], 0
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(1)).to_pylist()
        start = 0
        for i, n in enumerate(lengths):
            if size and size + n > BLOCK_BYTES:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if held and (whole_table := pa.Table.from_batches(held)).num_rows:
        yield whole_table


def align(docs: DataFrame, text_col: str = "text", byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """One row per row of `docs`: `row` (a struct of all other columns, so that no name can clash), n_a, n_b, n_groups,
    n_links, n_best, count_sum (long) and groups_sha256.

    Texts that are null, empty, or not spelt by the joined bytes of either side have zeros and ''. The count of an id pair is
    the number of rows that hold it linked; repeated rows count each. `byte_level` and `pieces` are paths of the vocabularies.
    """
    spark = docs.sparkSession
    files = [open(path or public_tokenizers.path(name), "rb").read() for path, name in ((byte_level, BYTE_LEVEL), (pieces, PIECES))]
    held, width = spark.sparkContext.broadcast(files), len(Pieces(files[1]).bytes_of)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("_none")]
    work = docs.select(F.struct(*others).alias("row"), whole(f"`{text_col}`").alias("text"))
    kind = work.schema["row"].dataType.simpleString()
    fields = {"rows": f"array<{kind}>"} | {c: "array<bigint>" for c in COUNTS} | {"groups_sha256": "array<string>"}
    fields |= {c: "binary" for c in ARRAYS} | {"pairs": "array<bigint>", "holders": "array<bigint>"}

    def run(batches):
        a, b = _sides(*held.value)
        for number, part in enumerate(_blocks(batches)):
            done = block_of(part.column(1).to_pylist(), a, b)
            rows = part.column(0).combine_chunks()
            rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
            columns = [pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                       pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)]
            columns += [pa.array([done[c]], pa.list_(pa.int64())) for c in COUNTS]
            columns += [pa.array([done["groups_sha256"]], pa.list_(pa.string()))]
            columns += [pa.array([done[c]], pa.binary()) for c in ARRAYS]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(done[c])], pa.int32()), pa.array(done[c], pa.int64())) for c in ("pairs", "holders")]
            yield pa.RecordBatch.from_arrays(columns, ["block", *fields])

    folder = f"{shared_dir(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    work.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in {"block": "bigint", **fields}.items())).write.parquet(folder)
    blocks = spark.read.parquet(folder)

    found = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.holders").alias("n"))
    # an id of A meets at most the vocabulary of B, which bounds the window's groups
    best = F.max("n").over(Window.partitionBy(F.expr(f"pair DIV {width}")))
    found = found.select("pair", "n", (F.col("n") == best).alias("best"))
    asked = blocks.select("block", F.posexplode("pairs").alias("pos", "pair"))
    # the size of the packed file says nothing of the exploded rows, so the planner must not broadcast by it
    answers = asked.join(found.hint("merge"), "pair").select("block", "pos", "n", "best")

    def finish(answers: pa.Table, block: pa.Table) -> pa.Table:
        (one,) = block.to_pylist()
        n, best = np.zeros(len(answers), np.int64), np.zeros(len(answers), np.int64)
        pos = answers.column("pos").to_numpy()
        n[pos], best[pos] = answers.column("n").to_numpy(), answers.column("best").to_numpy().astype(np.int64)
        unit_ptr, unit_idx, pair_ptr, pair_idx, links = (unpacked(one[c]) for c in ARRAYS)

        def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(values)])
            return upto[ptr[1:]] - upto[ptr[:-1]]

        rows = block.column("rows").combine_chunks()
        rows = (rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows).flatten()
        columns = {"row": rows} | {c: pa.array(one[c], pa.int64()) for c in COUNTS}
        columns["n_best"] = pa.array(sums(sums(links * best[pair_idx], pair_ptr)[unit_idx], unit_ptr), pa.int64())
        columns["count_sum"] = pa.array(sums(sums(links * n[pair_idx], pair_ptr)[unit_idx], unit_ptr), pa.int64())
        return pa.table(columns | {"groups_sha256": pa.array(one["groups_sha256"], pa.string())})

    given = spark.read.parquet(folder).drop("pairs", "holders")
    schema = f"row {kind}, " + ", ".join(f"{c} bigint" for c in (*COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"
    return answers.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(finish, schema)


def op13_alignment(spark, sf_dir):
    done = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
