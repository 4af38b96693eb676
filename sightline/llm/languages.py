"""Language identification by a string kernel.

The kernel of two texts is the number of n-grams (of 1 to 3 letters: a blended spectrum) that both have, by presence, over
the root of the product of their own numbers. Kernel ridge regression is fitted one language against the rest in the span
of landmark texts (Nyström), on a bounded sample of labelled rows. As the kernel is a product of presence vectors, the
landmarks' vectors and the coefficients are multiplied once; a batch of texts is then scored by one matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, in_small_batches

#: Most labelled rows of a language that are learned from, and landmark texts of all languages together.
ROWS_A_LANGUAGE = 500
LANDMARKS = 128
#: Weight of the ridge, a share of the number of rows.
RIDGE = 1e-4
#: Letters are told apart by this many classes: 0 is all that is no letter, then the most frequent letters of the sample;
#: the last SHARED classes are shared by all others, by code point.
CLASSES = 64
SHARED = 16
GRAMS = CLASSES + CLASSES**2 + CLASSES**3
#: Texts that one matrix product scores.
TOGETHER = 64
#: Partitions in which the sample is worked through; each sends one sum of products to the driver.
PARTS = 16

UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letter_classes(letters: list[int]) -> np.ndarray:
    """The class of each code point. letters: the code points with a class of their own, at most CLASSES - SHARED - 1."""
    points = np.arange(0x110000)
    out = (CLASSES - SHARED + points % SHARED).astype(np.uint8)
    out[[p for p in range(0x110000) if not chr(p).isalpha()]] = 0
    out[letters] = 1 + np.arange(len(letters), dtype=np.uint8)
    return out


def present(text: str, classes: np.ndarray, flags: np.ndarray) -> None:
    """Sets the flags of a text's n-grams: lower case, with runs of other characters as one, and one before and behind."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    kinds = classes[codes].astype(np.int32)
    kinds = kinds[np.append(True, (kinds[1:] != 0) | (kinds[:-1] != 0))]
    flags[:] = False
    flags[kinds] = True
    if len(kinds) > 1:
        twos = kinds[:-1] * CLASSES + kinds[1:]
        flags[CLASSES + twos] = True
        flags[CLASSES + CLASSES**2 + twos[:-1] * CLASSES + kinds[2:]] = True


class Model:
    """Scores of texts for each language: coefficients of the landmarks' n-grams, already divided by the landmarks' norms."""

    def __init__(self, classes: np.ndarray, grams: np.ndarray, weights: np.ndarray, langs: list[str]):
        self.classes, self.grams, self.weights, self.langs = classes, grams, weights, langs

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row a text."""
        flags = np.zeros(GRAMS, bool)
        x, norms = np.zeros((len(texts), len(self.grams)), np.float32), np.zeros((len(texts), 1))
        for i, text in enumerate(texts):
            present(text, self.classes, flags)
            x[i], norms[i] = flags[self.grams], np.sqrt(np.count_nonzero(flags))
        return (x @ self.weights) / norms


def _letters(batches):
    """(letter, n): how often a batch's texts have each letter, in lower case."""
    for batch in batches:
        codes = np.frombuffer("".join(batch.column(0).to_pylist()).lower().encode("utf-32-le", "replace"), "<u4")
        found = {int(p): int(n) for p, n in zip(*np.unique(codes, return_counts=True)) if chr(p).isalpha()}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["letter", "n"])


def _grams(classes):
    def run(batches):
        flags = np.zeros(GRAMS, bool)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                present(text.as_py(), classes.value, flags)
                rows.append(np.flatnonzero(flags).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["lang", "grams"])

    return run


def _products(shared):
    """One row: the sums over a task's texts of k k' and k y', with k a text's kernels with the landmarks and y its language."""

    def run(batches):
        grams, landmarks, langs = shared.value
        place = np.full(GRAMS, -1, np.int32)
        place[grams] = np.arange(len(grams))
        n = landmarks.shape[1]
        kk, ky, rows = np.zeros((n, n)), np.zeros((n, len(langs))), 0
        for batch in batches:
            for lang, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = own.values.to_numpy()
                at = place[own]
                k = landmarks[at[at >= 0]].sum(axis=0, dtype=np.float64) / np.sqrt(len(own))
                kk += np.outer(k, k)
                ky[:, langs.index(lang)] += k
                rows += 1
        yield pa.RecordBatch.from_arrays([pa.array([kk.tobytes()], pa.binary()), pa.array([ky.tobytes()], pa.binary()), pa.array([rows], pa.int64())], names=["kk", "ky", "n"])

    return run


def labelled_sample(docs: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE) -> DataFrame:
    """(lang, key, text) of at most rows_a_language rows of each language that may be learned from: ids are dealt to so many
    lots by a hash, and the one with the least other hash stands for its lot. Rows with one id are one. Rows without text or
    letters count, but are then left out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("key", F.xxhash64("doc_id"))
    lot = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(rows_a_language)).alias("lot")
    # a minimum a lot: tasks send so many rows of a language at most
    chosen = known.groupBy("lang", lot).agg(F.min("key").alias("key")).select("lang", "key")
    rows = known.join(F.broadcast(cut(chosen)), ["lang", "key"])
    rows = rows.groupBy("lang", "key").agg(F.min("text").alias("text"))
    return rows.filter(F.col("text").rlike(r"\p{L}"))


def fit(docs: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The model of docs (doc_id, text, lang); None if no row may be learned from.

    The driver gets the landmarks' n-grams (at most GRAMS numbers each) and sums of products of the landmarks' size.
    """
    context = docs.sparkSession.sparkContext
    sample = cut(labelled_sample(in_small_batches(docs), rows_a_language).repartition(PARTS, "lang", "key"))
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not langs:
        return None
    counted = sample.select("text").mapInArrow(_letters, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    letters = [r[0] for r in counted.orderBy(F.col("n").desc(), "letter").limit(CLASSES - SHARED - 1).collect()]
    classes = context.broadcast(letter_classes(letters))
    each = max(1, landmarks // len(langs))
    first = sample.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).filter(F.col("nth") <= each)
    kind = "lang string, grams array<int>"
    chosen = [np.asarray(r[0], np.int32) for r in first.select("lang", "text").mapInArrow(_grams(classes), kind).select("grams").collect()]
    grams = np.unique(np.concatenate(chosen))
    matrix = np.zeros((len(grams), len(chosen)), np.float32)
    for j, own in enumerate(chosen):
        matrix[np.searchsorted(grams, own), j] = 1 / np.sqrt(len(own))
    shared = context.broadcast((grams, matrix, langs))
    sums = sample.select("lang", "text").mapInArrow(_grams(classes), kind).mapInArrow(_products(shared), "kk binary, ky binary, n long").collect()
    n = len(chosen)
    kk = sum(np.frombuffer(r["kk"]).reshape(n, n) for r in sums)
    ky = sum(np.frombuffer(r["ky"]).reshape(n, len(langs)) for r in sums)
    rows = sum(r["n"] for r in sums)
    own = matrix.T.astype(np.float64) @ matrix
    # copies among the landmarks make the system singular: a least-squares solution takes the smallest coefficients
    coefficients = np.linalg.lstsq(kk + ridge * rows * own, ky, rcond=1e-12)[0]
    return Model(classes.value, grams, (matrix @ coefficients).astype(np.float32), langs)


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            told = [i for i, text in enumerate(texts) if model is not None and has_letter(text)]
            for a in range(0, len(told), TOGETHER):
                rows = told[a : a + TOGETHER]
                scores = model.scores([texts[i] for i in rows])
                for i, one in zip(rows, scores):
                    best[i], score[i] = model.langs[int(one.argmax())], float(np.clip(one.max(), 0.0, 1.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text): the language with the highest score, by name
    where several have it. A null text, one without letters, and all without a model are `und` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = in_small_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE, landmarks: int = LANDMARKS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang), from its whole text alone.

    Learned from rows with a text, a language and an id that is not held out (see held_out()), at most rows_a_language of
    each language. Repeated rows come back once each; other columns are ignored; an empty table gives no rows.
    """
    slim = docs.select("doc_id", "text", "lang")
    return predict(slim, fit(slim, rows_a_language, landmarks))
