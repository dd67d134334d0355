"""Reading level of each document (problem 9).

Gradient-boosted regression trees grade a document by distributions over its sentences: length,
vocabulary, syntax and cohesion. A sentence's vocabulary is summed up by the shares of the levels
its words speak for (word counts by level of the labelled texts, smoothed). Quantiles over
sentences, not means, so that stray sentences count for little. Predictions are cross-validated
with whole sources held out; the held-out predictions give the cut points between the grades, and
the accuracy of a source is measured with the cut points of the others.

Boosting starts from the mean grade. Where labels are so few that trees started from the grade of
the middle sentence's words are better on held-out sources by more than the error of that figure, it starts from that.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.boosted_trees import BoostedTrees
from tallyforge.storage import materialize

LEVELS = 5
#: Labelled documents to train on, at most; where there are more, those with the smallest hash of doc_id.
MAX_LABELS = 5000
#: Characters of labelled texts to train on, at most, in the same order.
MAX_CHARS = 100_000_000
FOLDS = 10
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: Place of the first guess among the features: the middle sentence's level by its words.
FIRST_GUESS = QUANTILES.index(0.5)

_BREAK = re.compile(r"(?<=[.!?])[\s\"'»“”)]+|\n+|</?p>|<br ?/?>")
_TAG = re.compile(r"<[^>]*>")
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,:]\d+)*")
_VOWELS = re.compile(r"[aeiouyäöüáéíóú]+")
# words that tie sentences and clauses together, in the languages of the texts
CONNECTIVES = frozenset(
    "because although however therefore whereas while since unless provided thereby moreover which whenever otherwise before after and but if "
    "weil obwohl jedoch daher während sofern wenn damit sodass weshalb wobei deshalb und aber dass ob bevor nachdem "
    "ker čeprav vendar zato medtem če da in ampak ko".split()
)


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence or line, without markup."""
    t = html.unescape(text) if "&" in text else text
    out = []
    for part in _BREAK.split(t):
        if part:
            ws = _TOKEN.findall(_TAG.sub(" ", part) if "<" in part else part)
            if ws:
                out.append(ws)
    return out


def word_numbers(w: str) -> tuple[str, tuple[float, ...]]:
    """Lower case, and letters, syllables, whether long, connective, a number, in capitals."""
    low = w.lower()
    return low, (len(w), len(_VOWELS.findall(low)), len(w) > 8, low in CONNECTIVES, w[0].isdigit(), len(w) > 1 and w.isupper())


def word_items(low: str, n: tuple[float, ...]) -> list[str]:
    """What a word says about the level: itself and whether in capitals, or that it is a number."""
    return ["#"] if n[4] else (["^", low] if n[5] else [low])


def length_item(words: int) -> str:
    return f"len{min(words // 3, 12)}"


def long_item(long: int, words: int) -> str:
    return f"long{min(9, round(10 * long / words))}"


def vocabulary_items(ws: list[str]) -> list[str]:
    """What a sentence's level is read from: its words, their form, its length and share of long words."""
    items = []
    for w in ws:
        items.extend(word_items(*word_numbers(w)))
    items.append(length_item(len(ws)))
    items.append(long_item(sum(len(w) > 8 for w in ws), len(ws)))
    return items


@dataclass
class Words:
    """log P(level | word) up to smoothing, by word."""

    index: dict[str, int]
    scores: np.ndarray

    @classmethod
    def of(cls, docs: list[list[list[str]]], levels: np.ndarray) -> Words:
        index: dict[str, int] = {}
        cells: list[int] = []
        weights: list[float] = []
        for doc, level in zip(docs, levels):
            share = 1 / max(1, len(doc)) ** 0.5  # long texts speak for more words, but not louder
            for items in doc:
                for w in items:
                    cells.append(index.setdefault(w, len(index)) * LEVELS + int(level))
                    weights.append(share)
        counts = np.bincount(np.array(cells, dtype=int), weights=np.array(weights), minlength=len(index) * LEVELS).reshape(-1, LEVELS)
        total = counts.sum(0) + 1e-9
        rate = (counts + 0.02) / (total + 0.02 * max(1, len(index)))
        scores = np.log(rate / rate.mean(1, keepdims=True))
        return cls(index, scores)

    def scores_of(self, items: list[str]) -> np.ndarray:
        """Sum of the scores of those items that are known."""
        known = [i for w in items if (i := self.index.get(w, -1)) >= 0]
        return self.scores[known].sum(0) if known else np.zeros(LEVELS)


class Lexicon(dict):
    """Numbers and level scores of words by their spelling, worked out once for each spelling met.

    As a mapping it gives the row of a spelling.
    """

    #: Spellings kept between calls.
    MOST = 300_000

    def __init__(self, words: Words) -> None:
        super().__init__()
        self.words = words
        self.by_length = np.array([words.scores_of([f"len{k}"]) for k in range(13)])
        self.by_long = np.array([words.scores_of([f"long{k}"]) for k in range(10)])
        self._begin()

    def _begin(self) -> None:
        self.clear()
        self.low_ids: dict[str, int] = {}
        self.low: list[int] = []
        self.rows: list[tuple[float, ...]] = []
        self.table, self.lows = np.zeros((0, 6 + LEVELS)), np.zeros(0, dtype=np.int64)

    def __missing__(self, w: str) -> int:
        low, n = word_numbers(w)
        self.low.append(self.low_ids.setdefault(low, len(self.low_ids)))
        self.rows.append((*map(float, n), *self.words.scores_of(word_items(low, n))))
        row = self[w] = len(self)
        return row

    def features(self, docs: list[list[list[str]]]) -> np.ndarray:
        """One row of features for each document (a list of sentences, none of them empty)."""
        if len(self) > self.MOST:
            self._begin()
        ids = np.fromiter(map(self.__getitem__, (w for doc in docs for ws in doc for w in ws)), dtype=np.int64)
        if len(self.table) < len(self.rows):
            more = len(self.table)
            self.table = np.vstack([self.table, np.array(self.rows[more:], dtype=float)])
            self.lows = np.concatenate([self.lows, np.array(self.low[more:], dtype=np.int64)])
        per_doc = np.array([len(doc) for doc in docs])
        size = np.array([len(ws) for doc in docs for ws in doc])
        starts, first = np.cumsum(size) - size, np.cumsum(per_doc) - per_doc
        doc_of = np.repeat(np.arange(len(docs)), per_doc)
        sentence_of = np.repeat(np.arange(len(size)), size)
        low, spellings = self.lows[ids], len(self.low_ids)
        # words that the sentence before has too, and different words of a document
        here = sentence_of * spellings + low
        opens = np.zeros(len(size), dtype=bool)
        opens[first] = True
        known = np.sort(here)
        again = known[np.minimum(np.searchsorted(known, here - spellings), len(known) - 1)] == here - spellings
        shared = np.add.reduceat(again & ~opens[sentence_of], starts, dtype=float)
        of_doc = np.sort(doc_of[sentence_of] * spellings + low)
        new = np.append(True, of_doc[1:] != of_doc[:-1])
        distinct = np.bincount(of_doc[new] // max(1, spellings), minlength=len(docs))
        of_words = self.table[ids]
        sums = np.add.reduceat(of_words, starts, axis=0)
        means = sums[:, :6] / size[:, None]
        longest = np.maximum.reduceat(of_words[:, 0], starts)
        # length, word length, syllables, long words, longest word, connectives, digits, capitals, overlap with the sentence before
        numbers = np.column_stack([size, means[:, :3], longest, means[:, 3:], shared / size])
        length = np.minimum(size // 3, 12)
        long = np.minimum(9, np.rint(10 * sums[:, 2] / size)).astype(int)
        logs = sums[:, 6:] + self.by_length[length] + self.by_long[long]
        p = np.exp(logs - logs.max(1, keepdims=True))
        shares = p / p.sum(1, keepdims=True)
        total = np.add.reduceat(size, first).astype(float)
        by_words = np.add.reduceat(shares * size[:, None], first, axis=0) / total[:, None]
        spoken = np.bincount(doc_of * LEVELS + shares.argmax(1), minlength=len(docs) * LEVELS).reshape(-1, LEVELS)
        n = per_doc[:, None]
        return np.column_stack(
            [
                spread((shares @ np.arange(LEVELS))[:, None], doc_of, first, per_doc), np.add.reduceat(shares, first, axis=0) / n, by_words, spoken / n,
                spoken.argmax(1), by_words.argmax(1), by_words.max(1), spread(numbers, doc_of, first, per_doc),
                np.log1p(per_doc), np.log1p(total), distinct / np.maximum(1.0, total**0.7),
            ]
        )


def spread(values: np.ndarray, doc_of: np.ndarray, first: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """The quantiles of each column within each document, by nearest rank: quantile by quantile."""
    at = first[:, None] + np.round(np.array(QUANTILES) * (per_doc[:, None] - 1)).astype(int)
    columns = [values[np.lexsort((values[:, c], doc_of)), c][at] for c in range(values.shape[1])]
    return np.stack(columns, axis=2).reshape(len(first), -1)


@dataclass
class ReadingModel:
    words: Words
    trees: BoostedTrees
    cuts: np.ndarray
    #: Share of labelled documents whose source was held out that got their label, and got within one of it.
    exact: float
    within_one: float

    def grade(self, text: str | None) -> int:
        return int(self.grades([text])[0])

    def grades(self, texts: list[str | None], lexicon: Lexicon | None = None) -> np.ndarray:
        """Levels of texts; 0 where there is no word. A ``lexicon`` of the model's words saves work between calls."""
        out = np.zeros(len(texts), dtype=int)
        lexicon = lexicon or Lexicon(self.words)
        for a in range(0, len(texts), 500):
            split = {k: s for k, t in enumerate(texts[a : a + 500], a) if t and (s := sentences(t))}
            if split:
                x = lexicon.features(list(split.values()))
                out[list(split)] = np.searchsorted(self.cuts, self.trees.predict(x), side="right")
        return out


def best_cuts(predicted: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Cut points between the grades with the fewest wrong grades."""
    cuts = np.arange(LEVELS - 1) + 0.5
    for k in range(LEVELS - 1):
        near = np.concatenate([[k + 0.5], np.linspace(k + 0.2, k + 0.8, 25)])
        wrong = [((predicted >= c) != (labels > k)).sum() + 0.01 * abs(c - k - 0.5) for c in near]
        cuts[k] = near[int(np.argmin(wrong))]
    return np.sort(cuts)


def train(texts: list[str | None], labels: list[int], sources: list[str]) -> ReadingModel:
    """Fit on labelled texts; sources decide the folds of the cross-validation."""
    split = [sentences(t) if t else [] for t in texts]
    keep = [k for k, s in enumerate(split) if s]
    sents = [split[k] for k in keep]
    items = [[vocabulary_items(s) for s in doc] for doc in sents]
    y = np.array([labels[k] for k in keep], dtype=float)
    names = sorted({sources[k] for k in keep})
    fold = np.array([names.index(sources[k]) % FOLDS for k in keep], dtype=int)
    if not len(y):
        return ReadingModel(Words({}, np.zeros((0, LEVELS))), BoostedTrees(edges=[]), np.arange(LEVELS - 1) + 0.5, 0.0, 0.0)
    # each document's features come from words of other sources only, as they will for new documents
    x = np.zeros((len(y), Lexicon(Words.of(items[:1], y[:1])).features(sents[:1]).shape[1]))
    for f in range(FOLDS):
        out = fold == f
        if out.any():
            rest = np.flatnonzero(~out) if (~out).any() else np.arange(len(y))
            words = Words.of([items[k] for k in rest], y[rest])
            x[out] = Lexicon(words).features([sents[k] for k in np.flatnonzero(out)])
    folds = [fold == f for f in range(FOLDS) if (fold == f).any()]

    def held_out(start: int | None) -> np.ndarray:
        held = np.zeros(len(y))
        for out in folds:
            rest = ~out if (~out).any() else out
            held[out] = BoostedTrees(start=start).fit(x[rest], y[rest]).predict(x[out])
        return held

    from_mean, from_words = held_out(None), held_out(FIRST_GUESS)
    gain = (from_mean - y) ** 2 - (from_words - y) ** 2
    start = FIRST_GUESS if gain.mean() > gain.std() / len(y) ** 0.5 else None
    held = from_mean if start is None else from_words
    got = np.zeros(len(y), dtype=int)
    for out in folds:
        rest = ~out if (~out).any() else out
        got[out] = np.searchsorted(best_cuts(held[rest], y[rest]), held[out], side="right")
    return ReadingModel(
        Words.of(items, y), BoostedTrees(start=start).fit(x, y), best_cuts(held, y), float((got == y).mean()), float((abs(got - y) <= 1).mean())
    )


def train_on(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> ReadingModel:
    """The model of the labelled documents; of several labels of a document the middle one counts."""
    one = labels.where("doc_id IS NOT NULL AND reading_level BETWEEN 0 AND 4").groupBy("doc_id").agg(
        F.percentile_approx("reading_level", 0.5).cast("int").alias("reading_level")
    )
    sample = one.orderBy(F.xxhash64("doc_id")).limit(max_labels)  # the bound of the broadcast
    texts = documents.select("doc_id", "text", "source").join(F.broadcast(sample), "doc_id").where("text <> ''")
    texts = materialize(texts, "labelled-texts")
    chosen, chars = set(), 0
    for r in texts.select("doc_id", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id")).collect():  # few rows, no texts
        chars += r.n
        if chars <= MAX_CHARS:
            chosen.add(r.doc_id)
    rows = sorted((r for r in texts.toLocalIterator() if r.doc_id in chosen), key=lambda r: (r.doc_id, r.text))
    return train([r.text for r in rows], [r.reading_level for r in rows], [r.source or "" for r in rows])


def reading_levels(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, reading_level): one row for each document.

    Null texts, and texts without a word, have level 0. A repeated document gets its level
    again. Texts are read whole. Without labels every text has level 0.
    """
    model = train_on(documents, labels, max_labels)

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(model.words)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "reading_level": model.grades(list(b["text"]), lexicon)})

    return documents.select("doc_id", "text").mapInPandas(grade, "doc_id long, reading_level int")
