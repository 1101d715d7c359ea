"""Language identification by interpolated Kneser-Ney character models, one per language.

The four-grams of all training texts are counted on Spark; the tables of all orders follow from the distinct four-grams.
No n-gram is dropped. A model of bounded size is kept as sorted arrays of n-gram hashes beside a matrix of log probabilities
with a column per language, so one binary search serves all languages. A larger one stays in tables of the shared folder:
the distinct n-grams of each batch of texts are joined with them, and the answers go back to the batch. Both give the same
probabilities. The language with the lowest cross-entropy per letter wins; a text whose best
cross-entropy is far above what texts of that language show is flagged as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreview.llm.common import cut, slices, table, whole

ORDER = 4
CODES = [f"c{i}" for i in range(ORDER)]
LOCAL_CELLS = 1 << 21
"""Four-grams times languages up to which the model is built on the driver and sent to the tasks; above, it stays in tables."""
REPLY_BYTES = 1 << 24
"""Bound on what the tables answer to one batch of texts."""
MAX_LANGS = 64
CALIBRATION_ROWS = 2000
"""Bound on the training texts that set the rejection level and the sharpness of the score."""
UNKNOWN = "und"
BLANK = 32
_P = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case form of every code point that is a letter, blank for the rest."""
    out = np.full(0x110000, BLANK, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, runs of other characters being one blank, and the offset at which each text starts."""
    codes = _letters()[np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)]
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    real = codes != BLANK
    kept = real.copy()
    kept[1:] |= real[:-1]
    kept[starts] = real[starts]  # no text begins with the blank of the one before it
    before = np.concatenate(([0], np.cumsum(kept)))
    return codes[kept], before[starts]


def windows(codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """ORDER arrays: the code at every place and those before it, blanks before the start of a text."""
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    out = [codes]
    for back in range(1, ORDER):
        shifted = np.full(len(codes), BLANK, np.uint32)
        shifted[back:] = codes[:-back] if back < len(codes) else shifted[back:]
        shifted[place < back] = BLANK
        out.append(shifted)
    return out[::-1]


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = (key + c.astype(np.uint64) + np.uint64(1)) * _P
        key ^= key >> np.uint64(29)
    return key


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, c0..c3, n): four-grams of every `docs(lang, text)`, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 1)):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                codes, starts = letters_of([t for t, x in zip(texts, langs) if x == lang])
                grams = windows(codes, starts)
                _, first, n = np.unique(keys_of(grams), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *[pa.array(g[first].astype(np.int32)) for g in grams],
                                                  pa.array(n.astype(np.int64))], ["lang", *[f"c{i}" for i in range(ORDER)], "n"])

    counted = docs.select("lang", "text").mapInArrow(run, f"lang string, {', '.join(f'{g} int' for g in CODES)}, n long")
    return counted.groupBy("lang", *CODES).agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """N-grams of one order: sorted hashes with log probabilities, and their contexts with log back-off weights."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def build_levels(grams: np.ndarray, counts: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """Levels of order 1 to ORDER, and the log probability of an unseen letter.

    `grams` holds distinct four-grams (rows of codes) and `counts` their number per language. Lower orders count the
    distinct letters that precede an n-gram.
    """
    tables = [(grams, counts.astype(float))]
    while tables[-1][0].shape[1] > 1:
        rows, n = tables[-1]
        shorter, at = np.unique(rows[:, 1:], axis=0, return_inverse=True)
        held = np.zeros((len(shorter), n.shape[1]))
        np.add.at(held, at.ravel(), (n > 0).astype(float))
        tables.append((shorter, held))
    levels, below_keys, below = [], None, None
    vocabulary = len(tables[-1][0]) + 1
    for rows, n in tables[::-1]:
        contexts, at = np.unique(rows[:, :-1], axis=0, return_inverse=True) if rows.shape[1] > 1 else (rows[:1, :0], np.zeros(len(rows), int))
        at = at.ravel()
        totals, kinds = np.zeros((len(contexts), n.shape[1])), np.zeros((len(contexts), n.shape[1]))
        np.add.at(totals, at, n)
        np.add.at(kinds, at, (n > 0).astype(float))
        once, twice = (n == 1).sum(axis=0), (n == 2).sum(axis=0)
        discount = np.clip((once + 0.5) / (once + 2 * twice + 1), 0.1, 0.9)
        weight = np.where(totals > 0, discount * kinds / np.maximum(totals, 1), 1.0)
        if below is None:
            lower = np.full(n.shape, 1.0 / vocabulary)
        else:
            lower = below[np.searchsorted(below_keys, keys_of([rows[:, i] for i in range(1, rows.shape[1])]))]
        p = np.where(totals[at] > 0, np.maximum(n - discount, 0) / np.maximum(totals[at], 1), 0) + weight[at] * lower
        keys = keys_of([rows[:, i] for i in range(rows.shape[1])])
        order = np.argsort(keys)
        below_keys, below = keys[order], p[order]
        ckeys = keys_of([contexts[:, i] for i in range(contexts.shape[1])]) if contexts.shape[1] else np.zeros(1, np.uint64)
        corder = np.argsort(ckeys)
        levels.append(Level(below_keys, np.log(below).astype(np.float32), ckeys[corder], np.log(weight[corder]).astype(np.float32)))
    return levels, np.full(counts.shape[1], -np.log(vocabulary), np.float32)


@dataclass
class Model:
    langs: list[str]
    levels: list[Level]
    unseen: np.ndarray
    sharpness: float = 20.0
    usual: np.ndarray | None = None
    """Per language: mean cross-entropy of its texts, variance between texts, variance of one letter."""

    def rejected(self, lang: np.ndarray, entropy: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Cross-entropies 4 standard deviations above what texts of the language and of this length show."""
        mean, between, letter = self.usual[lang].T
        return entropy > mean + 4 * np.sqrt(between + letter / np.maximum(sizes, 1))

    def decide(self, entropy: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        at = entropy.argmin(axis=1)
        low = entropy[np.arange(len(entropy)), at]
        p = 1 / np.exp(-self.sharpness * (entropy - low[:, None])).sum(axis=1)
        best = [self.langs[i] if n else UNKNOWN for i, n in zip(at, sizes)]
        return best, np.where(sizes > 0, p, 0.0), (sizes > 0) & self.rejected(at, low, sizes)

    def log_probabilities(self, grams: list[np.ndarray]) -> np.ndarray:
        """Per place and language."""
        out = np.zeros((len(grams[0]), len(self.langs)), np.float32)
        left = np.arange(len(out))
        for order in range(ORDER, 0, -1):
            level = self.levels[order - 1]
            keys = keys_of([g[left] for g in grams[ORDER - order:]])
            at = np.minimum(np.searchsorted(level.keys, keys), len(level.keys) - 1)
            hit = level.keys[at] == keys
            out[left[hit]] += level.logp[at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            keys = keys_of([g[left] for g in grams[ORDER - order:-1]]) if order > 1 else np.zeros(len(left), np.uint64)
            at = np.minimum(np.searchsorted(level.contexts, keys), len(level.contexts) - 1)
            known = level.contexts[at] == keys
            out[left[known]] += level.backoff[at[known]]
        out[left] += self.unseen
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter and language of each text, and its number of letters and blanks."""
        codes, starts = letters_of(texts)
        sizes = np.diff(np.append(starts, len(codes)))
        sums = np.zeros((len(texts), len(self.langs)))
        if len(codes):
            full = sizes > 0
            sums[full] = -np.add.reduceat(self.log_probabilities(windows(codes, starts)), starts[full], axis=0, dtype=np.float64)
        return sums / np.maximum(sizes, 1)[:, None], sizes


def _index(langs: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int") - 1


def _by_key(rows: DataFrame, codes: list[str], value: Column) -> DataFrame:
    """(*codes, value): a map from the number of each language to its `value`."""
    return rows.groupBy(*codes).agg(F.map_from_entries(F.collect_list(F.struct("lang", value))).alias("value"))


def _interpolated(discounts: Column):
    """Step of one order: from the probability one order below, `seen` and `context`, for language number i."""
    def step(below: Column, i: Column) -> Column:
        discount, context = F.get(discounts, i), F.try_element_at(F.col("context"), i)
        n = F.coalesce(F.try_element_at(F.col("seen"), i), F.lit(0)).cast("double")
        own = (F.greatest(n - discount, F.lit(0.0)) + discount * context["kinds"] * below) / context["total"]
        return F.coalesce(own, below)
    return step


@dataclass
class TableModel:
    """The same model as tables in the shared folder, for any number of n-grams; lists go from order 1 to ORDER."""

    judge: Model
    """Languages and calibration; it has no levels."""
    grams: list[DataFrame] = field(default_factory=list)
    contexts: list[DataFrame | Column] = field(default_factory=list)
    """Per context and language the sum of the counts and the number of n-grams; the empty context is a constant."""
    discounts: list[list[float]] = field(default_factory=list)
    vocabulary: int = 0

    @property
    def langs(self) -> list[str]:
        return self.judge.langs

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """(c0..c3, logp array<float>) of the distinct four-grams `asked(c0..c3)`, by language.

        A key meets at most as many n-grams as there are letters, because those asked are distinct.
        """
        wanted = [asked]
        for order in range(ORDER - 1, 0, -1):
            wanted.append(wanted[-1].select(*CODES[ORDER - order:]).distinct())
        found = wanted[-1].withColumn("p", F.array_repeat(F.lit(1.0 / self.vocabulary), len(self.langs)))
        for order, (grams, contexts, discounts) in enumerate(zip(self.grams, self.contexts, self.discounts), 1):
            codes = CODES[ORDER - order:]
            if order > 1:
                found = wanted[ORDER - order].join(found, codes[1:])
                found = found.join(contexts.withColumnRenamed("value", "context"), codes[:-1], "left")
            else:
                found = found.withColumn("context", contexts)
            found = found.join(grams.withColumnRenamed("value", "seen"), codes, "left")
            found = found.select(*codes, F.transform("p", _interpolated(F.array(*[F.lit(x) for x in discounts]))).alias("p"))
        return found.select(*CODES, F.transform("p", lambda p: F.log(p).cast("float")).alias("logp"))

    def entropies(self, docs: DataFrame) -> DataFrame:
        """(row, entropy array<double>, size) of `docs(row, text)`, as Model.entropies has them."""
        n_langs = len(self.langs)
        packed = cut(_packed(docs, max(1, REPLY_BYTES // (8 * n_langs + 16))))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, leads, pieces in zip(*[batch.column(i) for i in range(3)]):
                    grams, _ = _pieces(leads.as_py(), pieces.as_py())
                    _, first = np.unique(keys_of(grams), return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), number.as_py())), *[pa.array(g[first].astype(np.int32)) for g in grams]],
                                                     ["batch", *CODES])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    grams, sizes = _pieces(batch.column("leads")[i].as_py(), batch.column("pieces")[i].as_py())
                    sums = np.zeros((len(sizes), n_langs))
                    reply = batch.column("reply")[i].values
                    if len(grams[0]):
                        keys = keys_of([reply.field(c).to_numpy(zero_copy_only=False) for c in CODES])
                        logp = reply.field("logp").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_langs)
                        order = np.argsort(keys)
                        at = order[np.searchsorted(keys, keys_of(grams), sorter=order)]
                        full, starts = sizes > 0, np.cumsum([0, *sizes[:-1]])
                        sums[full] = np.add.reduceat(logp[at], starts[full], axis=0, dtype=np.float64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("ids")[i].values, batch.column("rows")[i].values, pa.array(sums.tolist(), pa.list_(pa.float64())),
                         pa.array(sizes.astype(np.int64))], ["id", "row", "sums", "size"])

        asked = cut(packed.select("batch", "leads", "pieces").mapInArrow(ask, f"batch long, {', '.join(f'{c} int' for c in CODES)}"))
        answers = asked.join(self.probabilities(asked.select(*CODES).distinct()), CODES)
        answers = answers.groupBy("batch").agg(F.collect_list(F.struct(*CODES, "logp")).alias("reply"))
        row = docs.schema["row"].dataType.simpleString()
        sums = packed.join(answers, "batch", "left").drop("batch").mapInArrow(add_up, f"id long, row {row}, sums array<double>, size long")
        whole_texts = sums.groupBy("id").agg(F.first("row").alias("row"), F.collect_list("sums").alias("sums"), F.sum("size").alias("size"))
        total = F.aggregate("sums", F.array_repeat(F.lit(0.0), n_langs), lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
        return whole_texts.select("row", F.transform(total, lambda x: -x / F.greatest("size", F.lit(1))).alias("entropy"), "size")


def _packed(docs: DataFrame, limit: int) -> DataFrame:
    """(batch, ids, rows, leads, pieces): `limit` letters of texts at most in a row, longer texts in pieces.

    A piece begins with `lead` letters that belong to the piece before it. Written before use, so that ids stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row = TaskContext.get().partitionId() << 40
        for batch in (part for b in batches for part in slices(b, 1)):
            codes, starts = letters_of(batch.column(1).to_pylist())
            pieces, runs, held = [], [], 0
            for i, (start, end) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(codes)])):
                for at in range(start, max(end, start + 1), limit):
                    lead, stop = min(ORDER - 1, at - start), min(end, at + limit)
                    if pieces and held + stop - at > limit:
                        runs.append(pieces)
                        pieces, held = [], 0
                    pieces.append((i, lead, codes[at - lead:stop].tobytes().decode("utf-32-le")))
                    held += stop - at
            for pieces in (*runs, pieces):
                places, leads, texts = zip(*pieces)
                listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), listed(pa.array([row + i for i in places])), listed(batch.column(0).take(pa.array(places))),
                     listed(pa.array(leads, pa.int32())), listed(pa.array(texts, pa.string()))], ["batch", "ids", "rows", "leads", "pieces"])
                number += 1
            row += batch.num_rows

    work = docs.select("row", whole("text").alias("text"))
    return work.mapInArrow(run, f"batch long, ids array<long>, rows array<{work.schema['row'].dataType.simpleString()}>, "
                                "leads array<int>, pieces array<string>")


def _pieces(leads: list[int], pieces: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Windows of the letters of packed pieces without their leads, and the number of letters of each piece."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
    sizes, leads = np.array([len(p) for p in pieces]), np.array(leads)
    starts = np.cumsum([0, *sizes[:-1]])
    own = np.arange(len(codes)) - np.repeat(starts, sizes) >= np.repeat(leads, sizes)
    return [g[own] for g in windows(codes, starts)], sizes - leads


def build_tables(counted: DataFrame, langs: list[str]) -> TableModel:
    """The model of `counted(lang, c0..c3, n)` in tables; counts as in build_levels."""
    model = TableModel(Model(langs, [], np.zeros(0)))
    n = counted.withColumn("lang", _index(langs))
    for order in range(ORDER, 0, -1):
        codes = CODES[ORDER - order:]
        held = {r["lang"]: r for r in n.groupBy("lang").agg(
            F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), F.sum("n").alias("total"),
            F.count("*").alias("kinds")).collect()}
        model.discounts.insert(0, [float(np.clip((r["once"] + 0.5) / (r["once"] + 2 * r["twice"] + 1), 0.1, 0.9))
                                   for r in (held[i] for i in range(len(langs)))])
        model.grams.insert(0, cut(_by_key(n, codes, F.col("n"))))
        if order == 1:
            model.contexts.insert(0, F.create_map(*[x for i in range(len(langs)) for x in (F.lit(i), F.struct(
                F.lit(held[i]["total"]).alias("total"), F.lit(held[i]["kinds"]).alias("kinds")))]))
            model.vocabulary = model.grams[0].count() + 1
            return model
        sums = n.groupBy("lang", *codes[:-1]).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        model.contexts.insert(0, cut(_by_key(sums, codes[:-1], F.struct("total", "kinds"))))
        n = cut(n.groupBy("lang", *codes[1:]).agg(F.count("*").alias("n")))


def fit(train: DataFrame, local_cells: int = LOCAL_CELLS) -> Model | TableModel | None:
    """Models of all languages of `train(doc_id, text, lang)`; None without rows.

    A tenth of the rows at most, and about CALIBRATION_ROWS, is set aside for the calibration; all others count, whole, with
    all their n-grams. `local_cells` decides only where the model is kept.
    """
    train = train.filter("lang IS NOT NULL").select("doc_id", "lang", whole("text").alias("text"))
    every = max(10, -(-train.count() // CALIBRATION_ROWS))
    aside = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0, F.lit(False))
    counted = cut(count_ngrams(train.filter(~aside)))
    sizes = {r["lang"]: r["rows"] for r in counted.groupBy("lang").agg(F.count("*").alias("rows")).limit(MAX_LANGS + 1).collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    sample = train.filter(aside & F.col("lang").isin(langs)).limit(2 * CALIBRATION_ROWS)
    if sum(sizes.values()) * len(langs) > local_cells:
        model = build_tables(counted, langs)
        found = model.entropies(sample.select(F.struct("lang").alias("row"), "text")).select("row.lang", "entropy", "size").toArrow()
        entropy = np.array(found["entropy"].to_pylist(), float).reshape(-1, len(langs))
        calibrate(model.judge, entropy, found["size"].to_numpy(), found["lang"].to_pylist())
        return model
    wide = counted.select("lang", *CODES, "n").toArrow()
    rows, at = np.unique(np.stack([wide[g].to_numpy() for g in CODES], axis=1), axis=0, return_inverse=True)
    counts = np.zeros((len(rows), len(langs)))
    np.add.at(counts, (at.ravel(), np.searchsorted(langs, wide["lang"].to_numpy())), wide["n"].to_numpy())
    model = Model(langs, *build_levels(rows, counts))
    held = sample.toArrow()
    calibrate(model, *model.entropies(held["text"].to_pylist()), held["lang"].to_pylist())
    return model


def calibrate(model: Model, entropy: np.ndarray, sizes: np.ndarray, langs: list[str]) -> None:
    """Sets the sharpness with the best log loss, and what is usual in each language."""
    model.usual = np.full((len(model.langs), 3), np.inf)
    if not len(langs):
        return
    own = np.searchsorted(model.langs, langs)
    keep = sizes > 0
    entropy, own, sizes = entropy[keep], own[keep], sizes[keep]
    if not len(own):
        return
    losses = {}
    for sharpness in (2.0, 4.0, 8.0, 16.0, 32.0, 64.0):
        p = np.exp(-sharpness * (entropy - entropy.min(axis=1, keepdims=True)))
        losses[sharpness] = -np.log(np.maximum(p[np.arange(len(own)), own] / p.sum(axis=1), 1e-6)).mean()
    model.sharpness = min(losses, key=losses.get)
    for i in range(len(model.langs)):
        mine = entropy[own == i, i]
        if len(mine) > 1:
            model.usual[i] = mine.mean(), max(mine.var(), 0.0025), (sizes[own == i] * (mine - mine.mean()) ** 2).mean()


def predict(docs: DataFrame, model: Model | TableModel | None) -> DataFrame:
    """(row, lang_pred, score, rejected) of `docs(row, text)`.

    Null texts and texts without letters are `und` with score 0; so is everything where no language could be learned. Ties
    go to the first language in alphabetical order. `rejected` marks texts unlike all learned languages.
    """
    tables = isinstance(model, TableModel)
    held = docs.sparkSession.sparkContext.broadcast(model.judge if tables else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches if tables else (part for b in batches for part in slices(b, 1)):
            if own is None:
                n = batch.num_rows
                best, score, rejected = [UNKNOWN] * n, [0.0] * n, [False] * n
            elif tables:
                entropy = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(own.langs))
                best, score, rejected = own.decide(entropy, batch.column(2).to_numpy())
            else:
                best, score, rejected = own.decide(*own.entropies(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(rejected, pa.bool_())], ["row", "lang_pred", "score", "rejected"])

    work = docs.select("row", whole("text").alias("text"))
    row = work.schema["row"].dataType.simpleString()
    return (model.entropies(work) if tables else work).mapInArrow(run, f"row {row}, lang_pred string, score double, rejected boolean")


def remainder(doc_id, of: int):
    """crc32 of the id as text, modulo `of`; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def op7_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(remainder(F.col("doc_id"), 3) != 1))
    found = predict(docs.select(F.struct("doc_id").alias("row"), "text"), model)
    return found.select("row.doc_id", (remainder(F.col("row.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
