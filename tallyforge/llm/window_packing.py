"""Filling fixed-capacity containers with items (problem 7): vector bin packing.

Texts are measured in tokens of a public tokenizer. Each has three sizes: tokens, one segment, and
loss-bearing tokens (all but those of its opening line, which prompts for the rest). A container is
filled by the dot-product heuristic: of the items that fit under all three limits, the one whose
sizes, weighted by how scarce each is, point most the way of the room that is left. Containers have
the largest capacity; only the last items go where they fill best.

Items are dealt by hash into shards of bounded size that are packed on their own, so a task never
sees more than a shard; containers that a shard leaves badly filled are taken apart and their items
packed again together with those of other shards.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.storage import materialize

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Items of a shard, on average.
SHARD_ITEMS = 4000
#: Containers of the first pass that are filled less are packed again.
GOOD_FILL = 0.995


@dataclass(frozen=True)
class Limits:
    """What a container takes besides tokens: a segment for each so many tokens of its capacity, and loss on a share of it."""

    tokens_a_segment: int = 32
    loss_share: float = 15 / 16

    def of(self, capacity: np.ndarray | int) -> np.ndarray:
        """Tokens, segments and loss-bearing tokens that a container takes."""
        c = np.asarray(capacity, dtype=float)
        return np.stack([c, np.maximum(1, c // self.tokens_a_segment), np.floor(c * self.loss_share)], axis=-1)


class Tokenizer:
    """The public tokenizer; its file is read on the driver and sent to every worker, which builds it once."""

    _built: tuple[str, object] | None = None

    def __init__(self, spark: SparkSession, folder: str, vocabulary: str) -> None:
        content = Path(folder, vocabulary).read_bytes()
        self.name = f"{vocabulary}-{zlib.crc32(content)}"
        self.content = spark.sparkContext.broadcast(content)

    def encoding(self):
        if Tokenizer._built is None or Tokenizer._built[0] != self.name:
            import tiktoken

            # fixed value: the pattern by which byte-level vocabularies of this family cut texts into words
            pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.content.value.splitlines())}
            Tokenizer._built = self.name, tiktoken.Encoding(self.name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return Tokenizer._built[1]


def opening(text: str) -> str:
    """The first line, which prompts for the rest."""
    return text[: text.find("\n") + 1]


def measured(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, prompt_tokens); 0 for null and empty texts, whole texts whatever their length."""

    tokenizer = Tokenizer(documents.sparkSession, folder, vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer.encoding().encode_ordinary
        for b in batches:
            texts = [t or "" for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [len(encode(t)) for t in texts], "prompt_tokens": [len(encode(opening(t))) for t in texts]})

    return documents.select("doc_id", "text").mapInPandas(count, "doc_id long, tokens int, prompt_tokens int")


def _fill(sizes: np.ndarray, top: np.ndarray) -> list[int]:
    """Rows of the items that one container takes: the largest that it can hold, then by dot product."""
    scaled = sizes / top
    alone = sizes[:, 0] <= top[0]
    if not alone.any():
        return []
    first = int(np.argmax(np.where(alone, sizes[:, 0], -1.0)))
    weight = scaled.sum(0)  # what there is most of is scarce
    room = 1.0 - scaled[first]
    chosen = [first]
    free = np.ones(len(sizes), dtype=bool)
    free[first] = False
    while True:
        fits = free & (scaled <= room + 1e-12).all(1)
        if not fits.any():
            return chosen
        score = scaled @ (weight * room)
        score[~fits] = -1.0
        k = int(np.argmax(score))
        chosen.append(k)
        free[k] = False
        room = room - scaled[k]


def pack(tokens: np.ndarray, loss: np.ndarray, capacities: list[int], limits: Limits = Limits()) -> tuple[np.ndarray, list[int]]:
    """Container number of each item, and the capacity of each container.

    Items must be in the order in which ties are to be broken, none larger than the largest
    capacity. An item that fits by its tokens alone may bear more loss than combined texts may.
    The largest capacity is used until what is left would fit into one: then the one that is filled best.
    """
    order = sorted(capacities, reverse=True)
    tops = {c: limits.of(c) for c in order}
    sizes = np.stack([tokens, np.ones(len(tokens)), loss], axis=1).astype(float)
    where = np.full(len(tokens), -1)
    closed: list[int] = []
    index = np.arange(len(tokens))
    while len(index):
        left = sizes[index]
        best: list[int] = []
        used, capacity = -1.0, order[0]
        last = left[:, 0].sum() <= order[0]
        for c in order if last else order[:1]:
            chosen = _fill(left, tops[c])
            share = left[chosen, 0].sum() / c if chosen else -1.0
            if share > used:
                best, used, capacity = chosen, share, c
            if used >= GOOD_FILL:
                break
        at = index[best]
        where[at] = len(closed)
        closed.append(capacity)
        keep = np.ones(len(index), dtype=bool)
        keep[best] = False
        index = index[keep]
    return where, closed


def _packed(items: DataFrame, capacities: list[int], label: str, shards: int, limits: Limits) -> DataFrame:
    """Items with container, its capacity and fill. Shards are dealt by the hash of the item."""

    def one_shard(shard: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["tokens", "loss", "doc_id", "piece_no"], ascending=[False, False, True, True]).reset_index(drop=True)
        where, closed = pack(b["tokens"].to_numpy(), b["loss"].to_numpy(), capacities, limits)
        capacity = np.array(closed)[where]
        used = np.bincount(where, weights=b["tokens"])[where]
        start = b.groupby(where)["tokens"].cumsum() - b["tokens"]
        position = b.groupby(where).cumcount()
        names = [f"{label}{shard[0]}-{n}" for n in where]
        return pd.DataFrame(
            {"doc_id": b["doc_id"], "piece_no": b["piece_no"], "tokens": b["tokens"], "loss": b["loss"], "container": names, "capacity": capacity,
             "position": position, "start_token": start, "fill": used / capacity}
        )

    schema = "doc_id long, piece_no int, tokens int, loss int, container string, capacity int, position int, start_token int, fill double"
    shard = F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(label)), F.lit(shards)).cast("int")
    # a stated number of partitions is not folded together: shards take few bytes and much time
    return items.withColumn("shard", shard).repartition(2 * shards, "shard").groupBy("shard").applyInPandas(one_shard, schema)


def packed_windows(documents: DataFrame, windows: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, piece_no, n_tokens, loss_tokens, window_id, container, position, start_token).

    Each document stands once, uncut, unless it is larger than the largest capacity: then it comes in
    pieces of that capacity and a last, smaller one. A text without tokens, and all texts where
    no capacity is given, stand in no container (null). Of equal capacities the smallest
    window_id is used. Repeated documents are placed again.
    """
    by_capacity: dict[int, int] = {}
    for r in windows.where("capacity_tokens > 0").groupBy("capacity_tokens").agg(F.min("window_id").alias("w")).collect():
        by_capacity[r.capacity_tokens] = r.w
    sized = materialize(measured(documents, folder, vocabulary), "pack-sizes")
    nowhere = sized.where("tokens = 0" if by_capacity else "true").select(
        "doc_id", F.lit(0).alias("piece_no"), F.col("tokens").alias("n_tokens"), (F.col("tokens") - F.col("prompt_tokens")).alias("loss_tokens"),
        F.lit(None).cast("long").alias("window_id"), F.lit(None).cast("string").alias("container"),
        F.lit(None).cast("int").alias("position"), F.lit(None).cast("int").alias("start_token"),
    )
    if not by_capacity:
        return nowhere
    capacities = sorted(by_capacity)
    top = capacities[-1]
    pieces = (
        sized.where("tokens > 0")
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / top).cast("int"))))
        .select(
            "doc_id", "piece_no",
            F.least(F.lit(top), F.col("tokens") - F.col("piece_no") * top).alias("n"),
            F.greatest(F.lit(0), F.col("prompt_tokens") - F.col("piece_no") * top).alias("prompt"),
        )
        .select("doc_id", "piece_no", F.col("n").alias("tokens"), (F.col("n") - F.least("n", "prompt")).alias("loss"))
    )
    n = pieces.count()
    first = materialize(_packed(pieces, capacities, "a", max(1, -(-n // SHARD_ITEMS)), limits), "pack-first")
    again = first.where(F.col("fill") < GOOD_FILL).select("doc_id", "piece_no", "tokens", "loss")
    second = _packed(again, capacities, "b", max(1, -(-again.count() // SHARD_ITEMS)), limits)
    window = documents.sparkSession.createDataFrame([*by_capacity.items()], "capacity int, window_id long")
    placed = first.where(F.col("fill") >= GOOD_FILL).unionAll(second).join(F.broadcast(window), "capacity")
    return placed.select(
        "doc_id", "piece_no", F.col("tokens").alias("n_tokens"), F.col("loss").alias("loss_tokens"),
        "window_id", "container", "position", "start_token",
    ).unionAll(nowhere)


def window_use(assignment: DataFrame, windows: DataFrame) -> DataFrame:
    """Containers, texts, tokens and unused room of each window."""
    per = assignment.where("container IS NOT NULL").groupBy("window_id", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    whole = per.groupBy("window_id").agg(F.count("*").alias("containers"), F.sum("n").alias("segments"), F.sum("used").alias("tokens"))
    return whole.join(windows.select("window_id", "capacity_tokens"), "window_id").withColumn(
        "unused_tokens", F.col("containers") * F.col("capacity_tokens") - F.col("tokens")
    )
