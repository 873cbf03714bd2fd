"""Toxicity by class-conditional Kneser-Ney models.

The class is the history: P(word | class) = max(c(class, word) - D(c), 0) / c(class) + backoff(class) * P(word), with
one P(word) for both classes, made of continuation counts (after how many different words a word stands, over all
labelled rows, plus one for the unseen). A rare word therefore says little, whatever class it was seen in. A text is
compared by length-normalised log-likelihood differences of the two classes: over the whole text, and over its most
telling 10, 5, 2, 1 and half percent of words (``SHARES``; a word at least). A piecewise linear logistic calibration
turns these six numbers into the score.

Counts cover every labelled training row and are summed by Spark, by 64-bit hashes of the words; the left words of a
word are counted exactly. The executors get the words that come most often (``vocabulary`` at most) as arrays. All
other words of the texts go, packed by chunks of texts, to slices of the model by hash ranges and their differences
come back, so ``vocabulary`` shifts work and changes no score, and neither a slice nor a chunk grows with the corpus.
Words of no labelled row have the difference 0. The calibration alone is fitted on a bounded sample: about
``calibration_rows`` training rows, those with the smallest hashes. Its features come from models without the row's
own fold, as counts are kept by fold.

Defined results: a null text counts as empty and gets the score of a text without evidence; labels that are null, or
of rows that documents lacks, are not learned from; a document with several labels is toxic if one says so; equal
texts get equal scores; without labels of both classes nothing can be told apart and every score is 0; a null id is
scored and is held out of nothing; label, language, source and id are never inputs of a score; other columns of the
rows stay as they are, whatever their names, and the score comes under the name that is asked for.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import fresh, handing_back, small_side, written

FOLDS = 3
SHARES, HINGES = (0.005, 0.01, 0.02, 0.05, 0.1), (2.0, 3.0, 4.0)
VOCABULARY, CALIBRATION_ROWS, BROADCAST_LABELS = 1 << 18, 20_000, 1_000_000
FLUSH_WORDS, CHUNK_ASKED, SLICE_WORDS = 1_000_000, 1 << 18, 1 << 20
_FOLD = bytes((i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32) for i in range(256))
COUNTS = [f"{kind}{fold}" for kind in ("toxic", "plain") for fold in range(FOLDS)]


def hashes_of(text: bytes | None) -> np.ndarray:
    """The words' hashes, in order."""
    words = (text or b"").translate(_FOLD).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def fold_of(doc_id: int | None) -> int:
    """A training fold, from the id's checksum alone."""
    return zlib.crc32(str(doc_id).encode()) // 4 % FOLDS


def counts(rows: DataFrame) -> DataFrame:
    """(word, toxic0.., plain0.., contexts): hashes of the words of rows (id, text, toxic), how often they come by class
    and fold, and after how many different words; a text's start is one, too. Python only sums what a million words
    have in common; distinct pairs and all sums over the table are Spark's."""
    cells = len(COUNTS)

    def in_chunks(make):
        def run(batches):
            held, size = [], 0
            for batch in batches:
                for key, text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                    own = hashes_of(text.as_py())
                    held.append((own, (0 if toxic else FOLDS) + fold_of(key)))
                    size += len(own)
                    if size >= FLUSH_WORDS:
                        yield make([h for h in held if len(h[0])])
                        held, size = [], 0
            if size:
                yield make([h for h in held if len(h[0])])

        return run

    def totals(held):
        words, at = np.unique(np.concatenate([own for own, _ in held]), return_inverse=True)
        cell = np.repeat([c for _, c in held], [len(own) for own, _ in held])
        n = np.bincount(at * cells + cell, minlength=len(words) * cells).reshape(-1, cells)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *(pa.array(n[:, i]) for i in range(cells))], ["word", *COUNTS])

    def pairs(held):
        words, at = np.unique(np.concatenate([own for own, _ in held]), return_inverse=True)
        left = np.concatenate(([0], at[:-1] + 1))
        left[np.cumsum([0, *(len(own) for own, _ in held[:-1])])] = 0
        key = np.unique(left * len(words) + at)
        return pa.RecordBatch.from_arrays([pa.array(words[key % len(words)].view(np.int64)), pa.array(np.concatenate(([np.uint64(0)], words))[key // len(words)].view(np.int64))], ["word", "left_word"])

    often = rows.mapInArrow(handing_back(in_chunks(totals)), "word long, " + ", ".join(f"{c} long" for c in COUNTS)).withColumn("contexts", F.lit(0).cast("long"))
    after = rows.mapInArrow(handing_back(in_chunks(pairs)), "word long, left_word long").distinct().groupBy("word").agg(F.count("*").alias("contexts"))
    both = often.unionByName(after, allowMissingColumns=True)
    return both.groupBy("word").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTS, "contexts")])


def discounts(often: np.ndarray) -> np.ndarray:
    """What is taken off a count of 0, 1, 2 and 3 or more, by how many words come once, twice, three and four times
    (modified Kneser-Ney): each at least as much as the one before and less than the count."""
    out = [0.0, min(0.95, max(0.5, often[0] / max(often[0] + 2.0 * often[1], 1.0)))]
    for k in (2, 3):
        fit = k - (k + 1) * out[1] * often[k] / often[k - 1] if often[k - 1] else 0.0
        out.append(min(k - 0.05, max(out[-1], fit)))
    return np.array(out)


def differences(n: np.ndarray, continuation: np.ndarray, totals: np.ndarray, types: np.ndarray, often: np.ndarray, all_continuation: float) -> np.ndarray:
    """Log-likelihood differences of words, whole and without each fold, by row. n: words x (class, fold).
    totals, types, often (words seen once to four times): by class, over all words."""
    shared = (continuation + 1.0) / (all_continuation + max(types.sum(), 1) + 1.0)
    values = []
    for left_out in [None, *range(FOLDS)]:
        keep = [f for f in range(FOLDS) if f != left_out]
        logs = []
        for k in range(2):
            c = n[:, k, keep].sum(axis=1).astype(float)
            total = max(float(totals[k, keep].sum()), 1.0)
            discount = discounts(often[k])
            seen = np.array([0, often[k][0], often[k][1], types[k] - often[k][0] - often[k][1]])
            backoff = min(1.0, max(float(discount @ seen) * len(keep) / FOLDS / total, 1e-6))
            logs.append(np.log(np.maximum(c - discount[np.minimum(c, 3).astype(int)], 0) / total + backoff * shared))
        values.append((logs[0] - logs[1]).astype(np.float32))
    return np.array(values)


def valued(batch: pa.RecordBatch | pa.Table, facts: tuple) -> np.ndarray:
    """differences() of rows of counts()."""
    n = np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1).reshape(-1, 2, FOLDS)
    return differences(n, batch.column("contexts").to_numpy().astype(float), *facts)


class Frequent:
    """Hashes of the words that the executors hold, sorted, and their differences: whole and without each fold."""

    def __init__(self, words: np.ndarray, values: np.ndarray):
        order = np.argsort(words, kind="stable")
        self.words, self.values = words[order], values[:, order]

    def look(self, own: np.ndarray, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """The differences of the words of own that are held, and the others."""
        if not len(self.words):
            return np.zeros(0), own
        at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
        held = self.words[at] == own
        return self.values[fold + 1][at[held]].astype(float), own[~held]


def _most(n: int, share: float) -> int:
    return max(1, int(np.ceil(share * n)))


def combined(n: int, total: float, best: np.ndarray) -> list[float]:
    """Length-normalised differences: of the most telling shares of a text of n words, and of all of it. best: its
    largest differences, enough for the largest share."""
    if not n:
        return [0.0] * (len(SHARES) + 1)
    sums = np.cumsum(np.sort(best)[::-1])
    return [*(float(sums[_most(n, s) - 1]) / _most(n, s) for s in SHARES), total / n]


def expanded(x: np.ndarray) -> np.ndarray:
    """Features with hinges, for a curve that is not straight, and 1."""
    return np.concatenate([np.clip(x, -20, 20), *(np.maximum(x - h, 0) for h in HINGES), np.ones((len(x), 1))], axis=1)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


_FACTS = np.dtype([("n", "<i8"), ("total", "<f8"), ("best", "<u4"), ("asked", "<u4")])
_ROWS = "kind int, chunk long, bucket int, fold int, blob binary, more binary, keys array<binary>"
_SCHEMA = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("fold", pa.int32()), ("blob", pa.binary()), ("more", pa.binary()), ("keys", pa.list_(pa.binary()))])
#: In the order in which a bucket's, then a chunk's rows are met.
SLICE, ASKED, ANSWER, TEXTS = range(4)


def _row(kind: int, chunk: int, bucket: int, fold: int, blob: bytes, more: bytes = b"", keys: list | None = None) -> dict:
    return {"kind": kind, "chunk": chunk, "bucket": bucket, "fold": fold, "blob": blob, "more": more, "keys": keys}


def _by_bucket(words: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes; a bucket is a range of hashes."""
    cut = np.searchsorted(((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1)).tolist()
    return [(k, a, z) for k, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if z > a]


class Chunk:
    """Some texts of a fold, with the words whose differences have to be asked for."""

    def __init__(self, number: int, fold: int):
        self.number, self.fold, self.size, self.keys, self.facts, self.best, self.asked = number, fold, 0, [], [], [], []

    def add(self, key: bytes | None, text: bytes | None, frequent: Frequent) -> None:
        own = hashes_of(text)
        known, rest = frequent.look(own, self.fold)
        m = _most(len(own), SHARES[-1])
        best = np.partition(known, len(known) - m)[len(known) - m :] if len(known) > m else known
        self.keys.append(key)
        self.facts.append((len(own), known.sum(), len(best), len(rest)))
        self.best.append(best.astype("<f4"))
        self.asked.append(rest)
        self.size += len(rest) + 16

    def rows(self, buckets: int) -> list[dict]:
        words, at = np.unique(np.concatenate(self.asked), return_inverse=True)
        out = [_row(ASKED, self.number, k, self.fold, words[a:z].astype("<u8").tobytes()) for k, a, z in _by_bucket(words, buckets)]
        return [*out, _row(TEXTS, self.number, -1, self.fold, np.concatenate(self.best).tobytes() + at.astype("<u4").tobytes(), np.array(self.facts, _FACTS).tobytes(), self.keys)]


def _answers(batches):
    """Rows of buckets in order: of each, its slice of the model, then what chunks ask of it."""
    bucket, parts, held = None, [], None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                bucket, parts, held = row["bucket"], [], None
            if row["kind"] == SLICE:
                parts.append((np.frombuffer(row["blob"], "<u8"), np.frombuffer(row["more"], "<f4").reshape(FOLDS + 1, -1)))
                continue
            if held is None:
                held = Frequent(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)) if parts else Frequent(np.zeros(0, np.uint64), np.zeros((FOLDS + 1, 0), np.float32))
                parts = []
            asked = np.frombuffer(row["blob"], "<u8")
            found = np.zeros(len(asked), np.float32)
            if len(held.words):
                at = np.minimum(np.searchsorted(held.words, asked), len(held.words) - 1)
                found = np.where(held.words[at] == asked, held.values[row["fold"] + 1][at], np.float32(0))
            out.append(_row(ANSWER, row["chunk"], bucket, row["fold"], found.astype("<f4").tobytes()))
        if out:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)


def _features(batches):
    """Rows of chunks in order: of each, its answers by bucket, then its texts."""
    chunk, parts = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["chunk"] != chunk:
                chunk, parts = row["chunk"], []
            if row["kind"] == ANSWER:
                parts.append(np.frombuffer(row["blob"], "<f4"))
                continue
            values = np.concatenate(parts).astype(float) if parts else np.zeros(0)
            facts = np.frombuffer(row["more"], _FACTS)
            n_best = int(facts["best"].sum())
            best = np.split(np.frombuffer(row["blob"], "<f4", n_best).astype(float), np.cumsum(facts["best"])[:-1])
            asked = np.split(values[np.frombuffer(row["blob"], "<u4", offset=4 * n_best)] if len(values) else np.zeros(0), np.cumsum(facts["asked"])[:-1])
            x = [combined(int(f["n"]), float(f["total"] + a.sum()), np.concatenate([b, a])) for f, b, a in zip(facts, best, asked, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.binary()), pa.array(x, pa.list_(pa.float64()))], ["key", "x"])


class Model:
    """What scoring needs: the frequent words, the slices with all others as rows, and the number of slices."""

    def __init__(self, frequent: Frequent, slices: DataFrame, buckets: int):
        self.slices, self.buckets = slices, buckets
        self.frequent = slices.sparkSession.sparkContext.broadcast(frequent)

    def features(self, texts: DataFrame) -> DataFrame:
        """(key, x): combined() of each row of texts (key binary, fold, text), with the differences without that fold (-1: whole)."""
        frequent, buckets = self.frequent, self.buckets

        def ask(batches):
            from pyspark import TaskContext

            task, open_chunks, n = TaskContext.get().partitionId() << 32, {}, 0
            for batch in batches:
                for key, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                    if fold not in open_chunks:
                        open_chunks[fold], n = Chunk(task + n, fold), n + 1
                    open_chunks[fold].add(key, text.as_py(), frequent.value)
                    if open_chunks[fold].size >= CHUNK_ASKED:
                        yield pa.RecordBatch.from_pylist(open_chunks.pop(fold).rows(buckets), _SCHEMA)
            for chunk in open_chunks.values():
                yield pa.RecordBatch.from_pylist(chunk.rows(buckets), _SCHEMA)

        asked = written(texts.select(F.col("key").cast("binary"), F.col("fold").cast("int"), F.col("text").cast("string")).mapInArrow(handing_back(ask), _ROWS), "asked")
        to_buckets = self.slices.unionByName(asked.filter(F.col("kind") == ASKED)).repartition("bucket").sortWithinPartitions("bucket", "kind")
        back = to_buckets.mapInArrow(handing_back(_answers), _ROWS).unionByName(asked.filter(F.col("kind") == TEXTS))
        return back.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(handing_back(_features), "key binary, x array<double>")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Newton steps of a ridge logistic regression; the last column is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x))
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-9), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", vocabulary: int = VOCABULARY, calibration_rows: int = CALIBRATION_ROWS, slice_words: int = SLICE_WORDS) -> tuple[Model | None, np.ndarray]:
    """The model and the calibration's weights; no model without labels of both classes. Rows with crc32(id as text) mod
    4 = 2 are not used."""
    known = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("toxic")).filter("label_id is not null and toxic is not null and pmod(crc32(cast(label_id as string)), 4) <> 2").groupBy("label_id").agg((F.max("toxic") > 0).alias("toxic"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(small_side(known, BROADCAST_LABELS), F.col("id") == F.col("label_id")).select("id", "text", "toxic")
    table = written(counts(rows), "counts")
    kinds = {k: sum((F.col(f"{k}{f}") for f in range(1, FOLDS)), F.col(f"{k}0")) for k in ("toxic", "plain")}
    facts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    facts += [F.count(F.when(test(n), 1)).alias(f"{k}_{name}") for k, n in kinds.items() for name, test in (("types", lambda n: n > 0), *((f"often{i}", lambda n, i=i: n == i) for i in range(1, 5)))]
    fact = table.agg(*facts, F.coalesce(F.sum("contexts"), F.lit(0)).alias("continuation"), F.count("*").alias("n_words")).first()
    totals = np.array([fact[c] for c in COUNTS]).reshape(2, FOLDS)
    if not totals[0].sum() or not totals[1].sum():
        return None, np.zeros(0)
    by = lambda name: np.array([fact[f"{k}_{name}"] for k in kinds], float)
    known_facts = (totals, by("types"), np.stack([by(f"often{i}") for i in range(1, 5)], axis=1), float(fact["continuation"]))
    # Words of the upper steps of an eighth of a binary order of frequency are held, as many steps as fit.
    step = F.floor(8 * F.log2((kinds["toxic"] + kinds["plain"]).cast("double"))).cast("int")
    room, least = vocabulary, 1 << 30
    for k, n in sorted(((r[0], r[1]) for r in table.groupBy(step).count().collect()), reverse=True):
        if n > room:
            break
        room, least = room - n, k
    got = table.filter(step >= least).toArrow()
    frequent = Frequent(got.column("word").to_numpy().view(np.uint64), valued(got, known_facts))
    buckets = -(-int(fact["n_words"]) // slice_words)

    def sliced(batches):
        words, values, size = [], [], 0

        def rows_of():
            own, value = np.concatenate(words), np.concatenate(values, axis=1)
            order = np.argsort(own, kind="stable")
            own, value = own[order], value[:, order]
            return pa.RecordBatch.from_pylist([_row(SLICE, -1, k, -1, own[a:z].astype("<u8").tobytes(), value[:, a:z].astype("<f4").tobytes()) for k, a, z in _by_bucket(own, buckets)], _SCHEMA)

        for batch in batches:
            words.append(batch.column("word").to_numpy().view(np.uint64))
            values.append(valued(batch, known_facts))
            size += batch.num_rows
            if size >= FLUSH_WORDS:
                yield rows_of()
                words, values, size = [], [], 0
        if size:
            yield rows_of()

    model = Model(frequent, written(table.filter(step < least).mapInArrow(handing_back(sliced), _ROWS), "slices"), buckets)
    # Of all training rows the share with the smallest hashes that calibration_rows are; nothing is ordered.
    share = min(1.0, calibration_rows / max(known.count(), 1))
    sample = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    fold = F.shiftright(F.crc32(F.col("id").cast("string")), 2) % FOLDS
    fit_on = written(texts.join(F.broadcast(sample), F.col("id") == F.col("label_id")).select(text_key(F.col("text")).alias("key"), "text", fold.cast("int").alias("fold"), "toxic"), "calibration")
    keyed = F.concat("key", F.col("fold").cast("string").cast("binary"))
    fitted = fit_on.select(keyed.alias("key"), "toxic").join(model.features(fit_on.select(keyed.alias("key"), "fold", "text")).dropDuplicates(["key"]), "key").select("x", "toxic").toArrow()
    x, y = np.array(fitted.column("x").to_pylist(), float), fitted.column("toxic").to_numpy(zero_copy_only=False).astype(float)
    return model, logistic(expanded(x), y)


def _judged(texts: DataFrame, model: Model, weights: np.ndarray) -> DataFrame:
    """(key, score) of texts (key, fold, text)."""

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            found = 1 / (1 + np.exp(-np.clip(expanded(x) @ weights, -30, 30))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["key", "score"])

    return model.features(texts).mapInArrow(handing_back(run), "key binary, score double")


def row_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """(id, score): one row per row of docs; texts are not shuffled."""
    model, weights = train(docs, labels, id_col, text_col, label_col, **options)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return own.select("id", F.lit(0.0).alias("score"))
    keyed = own.select(F.col("id").cast("string").cast("binary").alias("key"), F.lit(-1).alias("fold"), "text")
    return _judged(keyed, model, weights).select(F.col("key").cast("string").cast("long").alias("id"), "score")


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", score_col: str = "score", **options) -> DataFrame:
    """docs, all rows and columns, with a column of that name (which docs must not have)."""
    if score_col in docs.columns:
        raise ValueError(f"there is a column {score_col} already; ask for another name")
    model, weights = train(docs, labels, id_col, text_col, label_col, **options)
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))
    own_key, other_key = fresh(docs, "toxicity_key", "scored_key")
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.lit(-1).alias("fold"), F.col(text_col).alias("text"))
    scored = written(_judged(texts, model, weights).groupBy("key").agg(F.first("score").alias(score_col)), "scores").withColumnRenamed("key", other_key)
    return docs.withColumn(own_key, text_key(F.col(text_col))).join(scored, F.col(own_key) == F.col(other_key)).select(*docs.columns, score_col)
