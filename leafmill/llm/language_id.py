"""Language identification by word-first backoff.

A model holds, for each language, log frequencies of words and of character n-grams. A known word
scores by its log frequencies. An unseen word falls back to its n-grams of the longest length, from
``max_n`` down to 1, of which the model knows any; their mean stands for the word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import worker_state, written

UNKNOWN = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
CACHED = 300_000


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, with the marks on them."""
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Words and n-grams, each as one string of lines, with a row of ``logs`` for each, words first."""

    langs: list[str]
    words: str = ""
    grams: str = ""
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    max_n: int = 5

    @property
    def name(self) -> str:
        return f"{len(self.logs)}-{float(self.logs.sum()):.6f}-{','.join(self.langs)}"


class Scorer(dict):
    """Rows of ``scores`` by word: those of known words, and those of unseen ones as they come."""

    def __init__(self, model: Model):
        words, grams = (x.split("\n") if x else [] for x in (model.words, model.grams))
        super().__init__(zip(words, range(len(words)), strict=True))
        self.model, self.words = model, len(words)
        self.grams = dict(zip(grams, range(len(words), len(words) + len(grams)), strict=True))
        self.scores = np.concatenate([model.logs[: len(words)], np.zeros((1024, len(model.langs)), np.float32)])
        self.unseen: list[str] = []

    def backoff(self, word: str) -> np.ndarray:
        for n in range(self.model.max_n, 0, -1):
            known = [self.grams[g] for g in grams_of(word, n) if g in self.grams]
            if known:
                return self.model.logs[known].mean(axis=0)
        return np.zeros(len(self.model.langs), np.float32)

    def __missing__(self, word: str) -> int:
        row = self.words + len(self.unseen)
        if row == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((len(self.unseen), len(self.model.langs)), np.float32)])
        self.scores[row] = self.backoff(word)
        self[word] = row
        self.unseen.append(word)
        return row

    def trim(self, most: int) -> None:
        """Forgets unseen words once there are more than ``most``."""
        if len(self.unseen) > most:
            for w in self.unseen:
                del self[w]
            self.unseen.clear()
            self.scores = self.scores[: self.words + 1024].copy()

    def predict(self, text: str | None) -> tuple[str, float]:
        found = Counter(words_of(text or ""))
        if not found or not self.model.langs:
            return UNKNOWN, 0.0
        rows = [self[w] for w in found]
        total = np.fromiter(found.values(), np.float64, len(found)) @ self.scores[rows]
        p = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def held_out(id_: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_docs: int = 20_000, min_count: int = 2, max_n: int = 5) -> Model:
    """Fits a model on about ``sample_docs`` labelled rows of ``docs``, chosen by a hash of key and text.

    The bound is on the training rows only; fewer labelled rows are all used, whole texts each. Words
    and n-grams are counted in Spark; all that occur at least ``min_count`` times come to the driver, so
    the model's size is bounded by that of the sample. Rows without text or language are left out;
    repeated rows count each. Without any row, or in an empty table, the model knows no language.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = labelled.select(lang_col).count()
    share = F.pmod(F.xxhash64(F.col(key_col), F.col(text_col)), F.lit(1 << 30))
    sample = labelled.where(share < int((1 << 30) * min(1.0, sample_docs / max(n, 1)))) if n > sample_docs else labelled

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                found: Counter = Counter()
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for w, c in Counter(words_of(text)).items():
                        found[lang, w] += c
                grams: Counter = Counter()
                for (lang, w), c in found.items():
                    for k in range(1, max_n + 1):
                        for g in grams_of(w, k):
                            grams[lang, g] += c
                for kind, counts in ((True, found), (False, grams)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(counts), pa.bool_()), pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
                        names=["is_word", "lang", "part", "n"],
                    )

    counts = sample.select(lang_col, text_col).mapInArrow(count, "is_word boolean, lang string, part string, n long").groupBy("is_word", "part", "lang").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # labels of the sample
    if not langs:
        return Model([], max_n=max_n)
    by_part = counts.groupBy("is_word", "part").agg(F.collect_list("lang").alias("langs"), F.collect_list("n").alias("ns"), F.sum("n").alias("total"))
    rows = by_part.where(F.col("total") >= min_count).drop("total").toArrow().sort_by([("is_word", "descending"), ("part", "ascending")])
    is_word, parts = np.array(rows["is_word"].to_pylist(), bool), rows["part"].to_pylist()
    number = {x: i for i, x in enumerate(langs)}
    table = np.full((len(parts), len(langs)), 0.5, np.float32)
    of = np.repeat(np.arange(len(parts)), rows["langs"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
    table[of, [number[x] for x in rows["langs"].combine_chunks().flatten().to_pylist()]] += rows["ns"].combine_chunks().flatten().to_numpy().astype(np.float32)
    kinds = np.where(is_word, 0, np.array([len(p) for p in parts], np.int64))  # 0: words, else the n-gram's length
    for k in range(max_n + 1):  # log frequencies among words, and among n-grams of one length
        own = kinds == k
        if own.any():
            table[own] = np.log(table[own] / table[own].sum(axis=0))
    words = int(is_word.sum())
    return Model(langs, "\n".join(parts[:words]), "\n".join(parts[words:]), table, max_n)


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with ``pred_col`` (string) and ``score_col`` (double from 0 to 1) added.

    The score is the posterior of the predicted language under equal priors. Texts that are null or
    have no letters get ``und`` and 0; so do all texts where the model knows no language. Ties go to
    the language that sorts first. Every row is predicted for itself, repeated ones too, from its whole
    text, however long. Columns of ``docs`` named like the added ones are replaced; pass other names to
    keep them. An empty table gives an empty result.
    """
    docs = docs.drop(pred_col, score_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    name = model.name
    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state("language_id", name, lambda: Scorer(shipped.value))
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                found = [scorer.predict(t) for t in batch.column(at).to_pylist()]
                scorer.trim(CACHED)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=schema.names)

    return docs.mapInArrow(predict, schema)
