"""Language identification, word first.

A known word scores by its log frequency in each language. An unseen word
backs off to its character n-grams, the longest first: the first length of
which the model knows any n-gram of the word gives the score. A document's
language is the one with the largest sum over all its words.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.shared import give_back, take_turn, unused, written

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Entries of a worker's word cache, and scores (entries times labels) in it; it starts afresh when full.
CACHE = 200_000
CELLS = 2_000_000
LONGEST = 40
#: Steps of the sample for each doubling of its size.
STEPS = 8


@dataclass(frozen=True)
class Settings:
    """Documents to learn from, which bound a model, and n-gram lengths. Every language, word and n-gram of these documents is learned."""

    sample: int = 4000
    #: Documents of each label that are learned from at least, so far as it has them, also where `sample` among all labels gives it fewer.
    least: int = 40
    longest_gram: int = 4
    #: What a word or n-gram counts in a language that lacks it.
    unseen: float = 0.2


@dataclass
class Table:
    """Log frequencies of words or n-grams; of each it holds only the languages that have it."""

    row: dict[str, int]
    #: Where each row begins in `at` (numbers of languages) and `value`.
    start: np.ndarray
    at: np.ndarray
    value: np.ndarray
    #: What an item counts in each language that lacks it.
    lack: np.ndarray

    def get(self, item: str) -> np.ndarray | None:
        if (i := self.row.get(item)) is None:
            return None
        out = self.lack.copy()
        own = slice(self.start[i], self.start[i + 1])
        out[self.at[own]] = self.value[own]
        return out

    def total(self, items: list[str]) -> np.ndarray:
        return sum(map(self.get, items))


@dataclass
class Model:
    """Log frequencies per language; a worker keeps the scores of words it has met."""

    languages: list[str]
    prior: list[float]
    words: Table | None
    grams: Table | None
    longest_gram: int
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scores(self, word: str, total: Callable[[list[str]], np.ndarray] | None = None) -> np.ndarray:
        """The word's score in each language; `total` sums the rows of known n-grams."""
        if not self.languages:
            return np.zeros(0)
        if (known := self.words.get(word)) is not None:
            return known
        for n in range(self.longest_gram, 0, -1):
            if found := [g for g in grams_of(word, n) if g in self.grams.row]:
                return (total or self.grams.total)(found) / n
        return np.zeros(len(self.languages))

    def score(self, word: str) -> list[float]:
        return self.scores(word).tolist()


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with a space at either end; single characters without them."""
    spelled = f" {word} " if n > 1 else word
    return [spelled[i : i + n] for i in range(len(spelled) - n + 1)]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The fold that no model learns from: crc32 of the id as text leaves 2 when divided by 4. False for a null id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from documents (doc_id, text, lang) that are not held out, whose lang and doc_id aren't null and whose text has a letter.

    Each label of n documents has at least min(n, q) in the sample, q being the
    greatest of its share of `settings.sample` by number, an equal share, and
    `settings.least`: the first by a hash of the doc_id, up to a step of the
    hash. The steps make it about a tenth more, and documents that repeat a
    doc_id are drawn together. Every label is learned, with all words and
    n-grams of its documents; the driver collects them, 12 bytes each beside the
    items themselves. Without any such document the model has no languages and
    finds all undetermined.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    rows = rows.withColumn("step", F.floor(STEPS * F.log2(1.0 + F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 48) - 1)))).cast("int"))
    steps = written(rows.groupBy("lang", "step").count(), "language-steps")
    per = steps.groupBy("lang").agg(F.sum("count").alias("count")).collect()
    total = sum(r["count"] for r in per)
    if not total:
        return Model([], [], None, None, settings.longest_gram)
    langs = sorted(r["lang"] for r in per)
    n_of = {r["lang"]: r["count"] for r in per}
    label = Window.partitionBy("lang")
    least = F.greatest(F.lit(float(max(settings.least, settings.sample / len(langs)))), F.sum("count").over(label) * (settings.sample / total))
    before = F.sum("count").over(label.orderBy("step")) - F.col("count")
    last = steps.select("lang", "step", least.alias("least"), before.alias("before")).filter("before < least").groupBy("lang").agg(F.max("step").alias("last"))
    rows = rows.join(F.broadcast(last), "lang").filter("step <= last")
    longest, number = settings.longest_gram, {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                words[lang].update(WORD.findall(text.as_py().lower()))
            for lang, found in words.items():
                grams: Counter = Counter()
                for w, n in found.items():
                    for k in range(1, longest + 1):
                        for g in grams_of(w, k):
                            grams[g] += n
                for kind, c in ((0, found), (1, grams)):
                    yield pa.RecordBatch.from_arrays([pa.array([number[lang]] * len(c), pa.int32()), pa.array([kind] * len(c), pa.int32()), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["at", "kind", "item", "n"])

    counts = rows.select("text", "lang").mapInArrow(count, "at int, kind int, item string, n long").groupBy("at", "kind", "item").agg(F.sum("n").alias("n"))
    kept = counts.groupBy("kind", "item").agg(F.collect_list(F.struct("at", "n")).alias("own")).toArrow()
    tables = []
    for kind in (0, 1):
        part = kept.filter(pc.equal(kept["kind"], kind)).combine_chunks()
        items, own = part["item"].to_pylist(), pc.list_flatten(part["own"]).combine_chunks()
        at, n = (own.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        start = np.concatenate([[0], np.cumsum(pc.list_value_length(part["own"]).to_numpy())]).astype(np.int64)
        sums = np.bincount(at, weights=n, minlength=len(langs))
        norm = np.log(np.maximum(sums + settings.unseen * len(items), settings.unseen))
        tables.append(Table({w: i for i, w in enumerate(items)}, start, at.astype(np.int32), np.log(n + settings.unseen) - norm[at], math.log(settings.unseen) - norm))
    del kept, part, own, at, n
    give_back()  # what the driver needed for this stays beside later operators otherwise
    prior = [math.log(n_of[lang] / total) for lang in langs]
    return Model(langs, prior, tables[0], tables[1], longest)


class _Rows(dict):
    """From item to its row in `scores`, as far as CACHE and CELLS allow."""

    def __init__(self, of: Callable[[str], np.ndarray], width: int):
        super().__init__()
        self.of = of
        self.scores = np.zeros((1024, width))
        self.most = max(1, CELLS // max(1, width))
        self.bound = min(CACHE, self.most)

    def __missing__(self, item: str) -> int:
        i = len(self)
        if i == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[i] = self.of(item)
        self[item] = i
        return i

    def total(self, items: list[str]) -> np.ndarray:
        if len(items) > self.most:
            return sum(self.total(items[k : k + self.most]) for k in range(0, len(items), self.most))
        if len(self) > self.bound:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, items), np.int64, len(items))
        return np.add.reduce(self.scores.take(rows, 0))


class _Worker:
    """The rows of words and n-grams met."""

    def __init__(self, model: Model):
        self.model, width = model, len(model.languages)
        self.grams = _Rows(model.grams.get if width else model.scores, width)
        self.words = _Rows(lambda word: model.scores(word, self.grams.total), width)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not self.model.languages or not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0
        total = self.words.total(words) + self.model.prior
        odds = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.languages[best], float(1 / odds.sum())


_workers: dict[str, _Worker] = {}


def worker_of(model: Model) -> _Worker:
    """What this worker keeps for the model; of one model at a time."""
    take_turn("language", _workers.clear)
    if model.token not in _workers:
        _workers.clear()
        _workers[model.token] = _Worker(model)
    return _workers[model.token]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and lang_score to documents with a `text` column, which alone decides.

    The score is the posterior probability of the language. Null, empty and
    letterless texts get `und` and 0. Ties go to the first language by name.
    Other columns are kept; ones named lang_pred or lang_score are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double")
    def each(texts):
        import pandas as pd

        w = worker_of(shared.value)
        return pd.DataFrame([w.predict(t) for t in texts], columns=["lang_pred", "lang_score"])

    own = unused("found", docs.columns)
    # named non-deterministic, or a filter of the result would be pushed below it and predict each text again
    found = docs.withColumn(own, each.asNondeterministic()("text"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(own)["lang_pred"].alias("lang_pred"), F.col(own)["lang_score"].alias("lang_score"))
