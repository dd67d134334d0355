"""Evaluation texts leaking into training text (problem 8).

1. Items become plain words; an opening sentence that ``SHARED`` different texts have in common is
   cut off. Equal texts are one, whatever number of items have it.
2. Every run of ``SEED`` words of an item text is a seed, kept as a 64-bit hash in a table. The runs
   of each document are hashed in Arrow batches and joined to the seeds; a table of at most
   ``SEEDS_SENT`` seeds is sent to the documents, a larger one meets them in a shuffle.
3. A passage of twelve words or more with one word in eight damaged keeps at least two seeds of the
   item (16 words with the sixth and eleventh damaged do, any other more), so pairs of document and
   text with a single hit are no candidates. Nothing else is left out, however common a seed is.
4. Around the hits of the candidates, where the document holds enough of the item's words in any
   order, a banded Smith-Waterman alignment of item and document words gives the best local path;
   a passage is reported if some stretch of the path has at least ``PASSAGE`` item words and no
   more than one error in eight.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.storage import materialize

#: Words of a passage, words for each allowed error, words of a seed, and seeds that a passage keeps.
PASSAGE, ERROR_IN, SEED, LEAST_SEEDS = 12, 8, 5, 2
#: An opening that as many different texts share is an instruction.
SHARED = 5
#: Item words that a passage has at least unharmed.
LEAST = PASSAGE - PASSAGE // ERROR_IN
#: The alignment leaves the diagonal of its seed by at most this many words.
BAND = 12
#: Largest table of seeds (16 bytes each), and bytes of candidates with their item texts, that are sent to every task.
SEEDS_SENT, CANDIDATES_SENT = 1_000_000, 64_000_000
#: Numbers with marks inside that a task takes along; of items with more, so many at a time are looked for.
JOINED_SENT = 1_000_000

_HYPHEN_BREAK = re.compile(r"[-‐‑­]\s*\n[\s>|*]*")
_INLINE = re.compile(r"</?(?:b|i|em|strong|span|a|u|s|sub|sup|font|mark|code|small|tt)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^>]*>")
_LINK = re.compile(r"\[([^\]]*)\]\((?:[^()\s]*)\)")
_NO_WORD = re.compile(r"[^\w\s]+|_+")
_MARK_INSIDE = re.compile(r"[\W_]+")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_TWO_NUMBERS = re.compile(r"\d\d")
#: Categories of characters that are not seen by themselves.
HIDDEN = ("Mn", "Cf", "Me", "Cc")
_MARKS = bytes(c for c in range(128) if _NO_WORD.match(chr(c)))
_OTHER_MARK = re.compile(r"[^\w\s\x00-\x7f]+|[‿⁀⁔︳︴﹍﹎﹏＿]+")


@lru_cache(1)
def _hidden() -> re.Pattern:
    """Marks on letters and hidden characters of the basic plane beyond ASCII, which fall away."""
    codes = [c for c in range(128, 0x10000) if unicodedata.category(chr(c)) in HIDDEN]
    runs = [[c for _, c in run] for _, run in groupby(enumerate(codes), lambda x: x[1] - x[0])]
    return re.compile("[" + "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs) + "]+")


def plain(text: str | None) -> str:
    """A text without case, punctuation, markup, accents and hidden characters; blanks stay."""
    if not text:
        return ""
    t = _HYPHEN_BREAK.sub("", text)
    if "<" in t or "&" in t:
        t = html.unescape(t)
        t = _TAG.sub(" ", _INLINE.sub("", t))
    if "](" in t:
        t = _LINK.sub(r"\1", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t.replace("—", " ").replace("…", " "))
        t = _hidden().sub("", t)
        if _BEYOND.search(t):  # a class with such characters would be searched one by one
            t = "".join(c for c in t if c <= "\uffff" or unicodedata.category(c) not in HIDDEN)
    t = t.lower().encode("utf-8", "surrogatepass").translate(None, _MARKS).decode("utf-8", "surrogatepass")
    return t if t.isascii() else _OTHER_MARK.sub("", t)


def words(text: str | None) -> list[str]:
    """The words between blanks in plain form."""
    return plain(text).split()


def document_words(text: str | None, joined: frozenset[str]) -> list[str]:
    """The words of a document, numbers that a blank has cut in one piece again."""
    ws = plain(text).split()
    return rejoined(ws, joined) if joined and _TWO_NUMBERS.search("".join([w[0] for w in ws])) else ws


def _opening(text: str) -> str:
    m = re.match(r"\s*[^.!?]*[.!?]", text)
    return m[0] if m else ""


def with_marks_inside(text: str) -> set[str]:
    """Plain words that begin with a number and have marks inside, which may come with a blank in their place."""
    inside = (x for x in text.split() if len(_MARK_INSIDE.split(x.strip(".,;:?!€$'\"()"))) > 1)
    return {w for x in inside for w in words(x) if w[0].isdigit()}


def rejoined(ws: list[str], joined: frozenset[str]) -> list[str]:
    """Words that a blank in place of a mark has cut, in one piece again."""
    out: list[str] = []
    k, n = 0, len(ws)
    while k < n:
        w = ws[k]
        if w.isdigit() and k + 1 < n and ws[k + 1][:1].isdigit():
            for more in (2, 1):
                if k + more < n and (whole := "".join(ws[k : k + more + 1])) in joined:
                    w = whole
                    k += more
                    break
        out.append(w)
        k += 1
    return out


MATCH, OTHER, GAP = 2, -1, -1


def local_path(item: list[str], doc: list[str], low: int, high: int) -> tuple[int, list[int]]:
    """Smith-Waterman between item and document words, on the diagonals low..high (document minus item).

    Returns where in the item the best local path begins, and its steps: 0 equal words, 1 different words, 2 an item word
    left out, 3 a document word added. Match +2, everything else -1.
    """
    width = high - low + 1
    before = [0] * (width + 2)
    trace: list[list[int]] = []
    best, end = 0, (0, 0)
    n = len(doc)
    for i, w in enumerate(item):
        row = [0] * (width + 2)
        steps = [-1] * (width + 2)
        for d in range(1, width + 1):
            j = i + low + d - 1
            if j < 0 or j >= n:
                continue
            same = w == doc[j]
            score = before[d] + (MATCH if same else OTHER)
            step = 0 if same else 1
            if before[d + 1] + GAP > score:
                score, step = before[d + 1] + GAP, 2
            if row[d - 1] + GAP > score:
                score, step = row[d - 1] + GAP, 3
            if score > 0:
                row[d], steps[d] = score, step
                if score > best:
                    best, end = score, (i, d)
        before = row
        trace.append(steps)
    path: list[int] = []
    i, d = end
    while best and i >= 0 and 0 < d <= width and trace[i][d] >= 0:
        step = trace[i][d]
        path.append(step)
        if step <= 1:
            i -= 1
        elif step == 2:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return i + 1, path[::-1]


def longest_passage(path: list[int]) -> int:
    """Item words of the longest stretch of the path with at most one error in ``ERROR_IN`` of them."""
    best = 0
    for a in range(len(path)):
        length = errors = 0
        for step in path[a:]:
            length += step != 3
            errors += step != 0
            if errors * ERROR_IN <= length:
                best = max(best, length)
    return best


class WordHashes(dict):
    """64-bit hashes of words, worked out once for each word met."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def seeds(self, ws: list[str]) -> np.ndarray:
        """One signed hash for each run of ``SEED`` words."""
        n = len(ws) - SEED + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        ids = np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))
        h = np.zeros(n, dtype=np.uint64)
        for k in range(SEED):
            h = (h ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def passage_of(item: list[str], ws: list[str], item_seeds: np.ndarray, doc_seeds: np.ndarray) -> int:
    """Words of the longest passage of the item that the document's words hold, from PASSAGE up, else 0."""
    at: dict[int, list[int]] = defaultdict(list)
    for j, h in enumerate(item_seeds.tolist()):
        at[h].append(j)
    starts = {int(k) - j for k in np.flatnonzero(np.isin(doc_seeds, item_seeds)) for j in at[int(doc_seeds[k])]}
    longest = 0
    done: int | None = None
    for start in sorted(starts):
        # one alignment serves all seeds within half a band
        if done is not None and start <= done + BAND // 2:
            continue
        done = start
        a = max(0, start - BAND)
        part = ws[a : start + len(item) + 2 * BAND]
        present = set(part)
        if sum(w in present for w in item) < LEAST:
            continue
        begin, path = local_path(item, part, start - a - BAND, start - a + BAND + BAND // 2)
        # the path ends on equal words; damaged ones may stand before and behind it
        after = len(item) - begin - sum(step != 3 for step in path)
        more = len(path) // ERROR_IN + 1
        longest = max(longest, longest_passage([1] * min(begin, more) + path + [1] * min(after, more)))
    return longest if longest >= PASSAGE else 0


def plain_items(eval_items: DataFrame) -> DataFrame:
    """(item_id, plain, joined): the words of each item, and those of ``with_marks_inside``.

    An opening sentence that ``SHARED`` different texts have in common is cut off.
    """

    def openings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            first = [" ".join(words(_opening(t))) for t in b["text"]]
            yield b.assign(opening=first, whole=[" ".join(words(t)) for t in b["text"]])

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t[len(_opening(t)) :] if cut else t for t, cut in zip(b["text"], b["cut"])]
            yield pd.DataFrame({"item_id": b["item_id"], "plain": [" ".join(words(t)) for t in texts], "joined": [sorted(with_marks_inside(t)) for t in texts]})

    items = eval_items.where("text <> ''").select("item_id", "text").distinct().mapInPandas(openings, "item_id long, text string, opening string, whole string")
    items = materialize(items, "leak-items")
    common = items.where("opening <> ''").groupBy("opening").agg(F.count_distinct("whole").alias("n")).where(F.col("n") >= SHARED)
    cut = items.join(common.select("opening", F.lit(True).alias("is_shared")), "opening", "left")
    return cut.select("item_id", "text", F.coalesce("is_shared", F.lit(False)).alias("cut")).mapInPandas(rest, "item_id long, plain string, joined array<string>")


def leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words): each document with the items it holds a passage of.

    Null and empty texts hold none, nor do items that are null or shorter than a passage. A
    repeated document is reported again. Texts are read whole, whatever their length.
    """
    items = materialize(plain_items(eval_items), "leak-words")
    numbers = items.select(F.explode("joined").alias("w")).distinct()
    parts = max(1, -(-numbers.count() // JOINED_SENT))
    found = None
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("plain"), F.lit(parts)) == part)
        now = _leaks_of(documents, some)
        found = now if found is None else found.unionAll(now)
    return found


def _leaks_of(documents: DataFrame, items: DataFrame) -> DataFrame:
    numbers = items.select(F.explode("joined").alias("w")).distinct()
    joined = frozenset(r.w for r in numbers.collect())  # at most JOINED_SENT or so, see ``leaks``
    texts = items.groupBy("plain").agg(F.collect_set("item_id").alias("items")).withColumn("text_no", F.monotonically_increasing_id())
    texts = materialize(texts, "leak-texts")

    def item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            seeds = [hashes.seeds(t.split()) for t in b["plain"]]
            yield pd.DataFrame({"text_no": b["text_no"].repeat([len(s) for s in seeds]), "seed": np.concatenate(seeds)})

    seeds = texts.select("text_no", "plain").mapInPandas(item_seeds, "text_no long, seed long").groupBy("seed", "text_no").agg(F.count("*").alias("n"))
    seeds = materialize(seeds, "leak-seeds")

    def document_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "seeds": [hashes.seeds(document_words(t, joined)) for t in b["text"]]})

    texts_of = documents.where("text IS NOT NULL").select("doc_id", "text")
    runs = texts_of.mapInPandas(document_seeds, "doc_id long, seeds array<long>").select("doc_id", F.explode("seeds").alias("seed"))
    hits = runs.join(F.broadcast(seeds) if seeds.count() <= SEEDS_SENT else seeds, "seed")
    pairs = hits.groupBy("doc_id", "text_no").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEDS)
    # each document with its candidates; a document has few, as each needs words of its own
    candidates = pairs.join(texts.select("text_no", "plain"), "text_no").groupBy("doc_id").agg(F.collect_list(F.struct("text_no", "plain")).alias("candidates"))
    candidates = materialize(candidates, "leak-candidates")
    size = candidates.agg(F.sum(F.expr("aggregate(candidates, 0L, (s, c) -> s + 100 + length(c.plain))"))).first()[0] or 0

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            rows = []
            for doc, text, candidates in zip(b["doc_id"], b["text"], b["candidates"]):
                ws = document_words(text, joined)
                doc_seeds = hashes.seeds(ws)
                for c in candidates:
                    item = c["plain"].split()
                    if n := passage_of(item, ws, hashes.seeds(item), doc_seeds):
                        rows.append((doc, c["text_no"], n))
            yield pd.DataFrame(rows, columns=["doc_id", "text_no", "words"])

    met = texts_of.join(F.broadcast(candidates) if size <= CANDIDATES_SENT else candidates, "doc_id")
    verified = met.mapInPandas(verify, "doc_id long, text_no long, words int")
    return verified.join(texts.select("text_no", F.explode("items").alias("item_id")), "text_no").select("doc_id", "item_id", "words")
