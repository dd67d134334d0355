"""Variant spellings of names typed by people (problem 4).

1. Distinct spellings are split into core word, kind of shop, first name and craft; legal forms,
   branch numbers, places and family words fall away. Places are learned from the data: what
   stands behind a dash in a good part of all names it occurs in. So are kinds that are not
   listed: words that stand beside ``KIND_CORES`` different words.
2. Distinct core words get MinHash bands over padded q-grams. Rows and bands come from the
   collision curve: the similarity that one typing error leaves in a core of six letters must be
   met with the wanted recall. Short words get keys of the word with one letter left out besides,
   which all pairs one error apart share.
3. Pairs that share a band are verified by Monge-Elkan similarity over the words of their best
   pair of forms, with edit similarity (swaps count once) inside.
4. Core words are clustered by stars around the spellings that most names use, so that chains of
   typing errors do not join different words.
5. Within a star, names of one kind of shop or one first name are one entity; names without
   either, or with an initial only, join it where there is just one they can mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.minhash import bands_for, with_bands
from tallyforge.llm.name_parts import PLACE_WORDS, parts, place_suffix, tokens_of
from tallyforge.llm.star_clusters import star_clusters
from tallyforge.storage import materialize

GRAM, ROWS, RECALL = 3, 3, 0.95
#: Jaccard similarity of the padded trigrams of two words of six letters with neighbours swapped.
SIMILARITY = 4 / 12
#: Words of up to so many letters get exact keys; bands meet a swap in longer ones with at least ``RECALL``.
EXACT = 7
#: Least Monge-Elkan similarity of two forms of one entity.
MONGE_ELKAN = 0.8
#: A place stands behind a dash in at least this share of the spellings that hold it.
PLACE_SHARE = 1 / 10
#: A word that is not listed is a kind of shop (or a first name) if it stands beside so many different words.
KIND_CORES = 10
#: Rows of a table of learned words that are sent to every task; a larger one is shuffled.
LEARNED_SENT = 100_000
#: The right spelling has at least this many times the support of a typing error that comes often.
ERROR_RATIO = 3


def may_be_error(n_a: Column, n_b: Column) -> Column:
    """Whether the rarer of two near spellings may be a typing error of the other, by their support.

    Each time it comes again makes an error less likely, up to ``ERROR_RATIO``: 1 beside any, 2
    beside 2, 3 beside 6, n beside 3 n.
    """
    fewer = F.least(n_a, n_b)
    return fewer * F.least(fewer - 1, F.lit(ERROR_RATIO)) <= F.greatest(n_a, n_b)


def _sent(learned: DataFrame) -> DataFrame:
    return F.broadcast(learned) if learned.count() <= LEARNED_SENT else learned


def with_places(names: DataFrame) -> DataFrame:
    """(name, tokens, places): ``names`` (name, tokens, place behind a dash) with the places that each holds."""
    last = F.size("tokens")
    phrases = F.expr(
        f"flatten(transform(sequence(1, least({PLACE_WORDS}, size(tokens))), n -> transform(sequence(1, size(tokens) - n + 1), i -> array_join(slice(tokens, i, n), ' '))))"
    )
    held = names.where(last > 1).select("name", F.explode(F.array_distinct(phrases)).alias("place"))
    dashed = materialize(names.where("place IS NOT NULL").groupBy("place").agg(F.count("*").alias("dashed")), "name-dashed")
    plain = held.join(_sent(dashed.select("place")), "place").groupBy("place").agg(F.count("*").alias("plain"))
    places = dashed.join(plain, "place", "left").where(F.col("dashed") >= PLACE_SHARE * (F.col("dashed") + F.coalesce("plain", F.lit(0))))
    places = materialize(places.select("place"), "name-places")
    per_name = held.join(_sent(places), "place").groupBy("name").agg(F.collect_list("place").alias("places"))
    return names.select("name", "tokens").join(per_name, "name", "left")


def with_learned_kinds(split_names: DataFrame) -> DataFrame:
    """Names with a core of several words, of which those that stand beside many others become the kind."""
    words = F.split("core", " ")
    beside = split_names.where(F.col("core").contains(" ")).select("name", "core", F.explode(words).alias("word"))
    rest = F.array_join(F.array_remove(words, F.col("word")), " ")
    kinds = beside.where(F.length("word") > 1).groupBy("word").agg(F.count_distinct(rest).alias("n")).where(F.col("n") >= KIND_CORES)
    kinds = materialize(kinds.select("word"), "name-kinds")
    found = beside.join(_sent(kinds), "word").groupBy("name").agg(F.array_sort(F.collect_set("word")).alias("kinds"))
    left = F.array_except(words, F.coalesce("kinds", F.array().cast("array<string>")))
    joined = split_names.join(found, "name", "left").withColumn("left", left)
    learned = F.col("kinds").isNotNull() & (F.size("left") > 0)
    return joined.select(
        "name", F.when(learned, F.array_join("left", " ")).otherwise(F.col("core")).alias("core"),
        F.when(learned & (F.col("kind") == "") & (F.col("first") == ""), F.array_join("kinds", " ")).otherwise(F.col("kind")).alias("kind"), "first", "craft",
    )


def edit_similarity(a: str, b: str) -> float:
    """1 - edits / longer length; a swap of neighbours is one edit."""
    if a == b:
        return 1.0
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
    return 1 - rows[-1][-1] / max(len(a), len(b))


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean over the words of the shorter list of the best similarity in the other one."""
    if len(a) > len(b):
        a, b = b, a
    return sum(max(edit_similarity(x, y) for y in b) for x in a) / len(a) if a else 0.0


def exact_keys(cores: DataFrame) -> DataFrame:
    """(core, n, band) for the short cores of letters: themselves, and with each letter left out."""
    left_out = F.expr("array_distinct(transform(sequence(0, length(core)), i -> xxhash64(concat(substring(core, 1, i), substring(core, i + 2)))))")
    return cores.where((F.length("core") <= EXACT) & ~F.col("core").startswith("=")).select("core", "n", F.explode(left_out).alias("band"))


def core_keys(cores: DataFrame) -> DataFrame:
    """(core, n, band): the MinHash bands of each core, and the exact keys of short ones."""
    banded = with_bands(cores.where(F.length("core") > 3).select("core", "n"), "core", GRAM, ROWS, bands_for(SIMILARITY, ROWS, RECALL))
    return banded.unionAll(exact_keys(cores.select("core", "n")))


def verified(pairs: DataFrame) -> DataFrame:
    """Candidate pairs of core words that are one error apart and alike as whole forms.

    ``forms_a`` and ``forms_b`` hold the kinds and first names the core words are used with; the
    words compared are the core and, where both have one, the best pair of these. Of two core words
    that several names use, an error is told by a kind or first name that both have, or, where
    one has none at all, by the share of the names alone.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y, n, m, fx, fy in zip(b.a, b.b, b.n_a, b.n_b, b.forms_a, b.forms_b):
                s = edit_similarity(x, y)
                if round((1 - s) * max(len(x), len(y))) > 1:
                    keep.append(0.0)
                    continue
                fx, fy = list(fx), list(fy)
                named_x, named_y = [f for f in fx if f], [f for f in fy if f]
                best = s
                if min(n, m) > 1 and not any(agree(p, q) for p in named_x for q in named_y):
                    if named_x and named_y or min(n, m) * ERROR_RATIO > max(n, m):
                        keep.append(0.0)
                        continue
                if len(named_x) == len(fx) and len(named_y) == len(fy):  # each use names its kind
                    best = max(0.0 if not agree(p, q) else monge_elkan([x, p], [y, q]) for p in named_x for q in named_y)
                keep.append(best)
            yield b.assign(similarity=keep)[["a", "b", "n_a", "n_b", "similarity"]]

    return pairs.mapInPandas(check, "a string, b string, n_a long, n_b long, similarity double").where(
        F.col("similarity") >= MONGE_ELKAN
    )


def agree(p: str, q: str) -> bool:
    """Same kind (``k:``) or same first name (``f:``); an initial agrees with its names."""
    return p == q or (p[:2] == q[:2] == "f:" and (len(p) == 3 or len(q) == 3) and p[2] == q[2])


def name_entities(receipts: DataFrame) -> DataFrame:
    """(name, entity): each distinct spelling of receipts.store_name with its entity.

    Null and empty names are left out; a name without any letter is an entity of its own. Very long
    names are read whole. Repeated receipts count once.
    """
    names = receipts.where(F.col("store_name") != "").select(F.col("store_name").alias("name")).distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "tokens": [tokens_of(n) for n in b["name"]], "place": [place_suffix(n) for n in b["name"]]})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parts(list(t), frozenset() if p is None else frozenset(p)) for t, p in zip(b["tokens"], b["places"])]
            yield pd.DataFrame({"name": b["name"].to_list()} | {k: [r[i] for r in rows] for i, k in enumerate(("core", "kind", "first", "craft"))})

    names = materialize(names.mapInPandas(cut, "name string, tokens array<string>, place string"), "names")
    split_names = with_places(names).mapInPandas(split, "name string, core string, kind string, first string, craft string")
    split_names = with_learned_kinds(materialize(split_names, "name-words")).withColumn(
        "form",
        F.when(F.col("first") != "", F.concat(F.lit("f:"), "first")).when(F.col("kind") != "", F.concat(F.lit("k:"), "kind")).otherwise(""),
    )
    split_names = materialize(split_names.withColumn("core", F.when(F.col("core") == "", F.concat(F.lit("="), "name")).otherwise(F.col("core"))), "name-parts")
    # forms of a core: one for each kind and first name, of which there are few
    forms = split_names.groupBy("core", "form").agg(F.count("*").alias("n"))
    cores = materialize(forms.groupBy("core").agg(F.sum("n").alias("n"), F.collect_list("form").alias("forms")), "name-cores")
    keyed = materialize(core_keys(cores), "name-bands")
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = (
        a.join(b, F.col("a.band") == F.col("b.band"))
        .where(
            (F.col("a.core") < F.col("b.core"))
            & may_be_error(F.col("a.n"), F.col("b.n"))
            & (F.abs(F.length("a.core") - F.length("b.core")) <= 1)
            & (F.levenshtein("a.core", "b.core", 2) >= 0)
        )
        .select(F.col("a.core").alias("a"), F.col("b.core").alias("b"))
        .distinct()
    )
    side = lambda s: cores.select(F.col("core").alias(s), F.col("n").alias(f"n_{s}"), F.col("forms").alias(f"forms_{s}"))
    edges = verified(pairs.join(side("a"), "a").join(side("b"), "b"))
    centres = star_clusters(edges)
    starred = split_names.join(centres.withColumnRenamed("vertex", "core"), "core", "left").withColumn("centre", F.coalesce("centre", "core"))
    return resolved(starred)


def resolved(starred: DataFrame) -> DataFrame:
    """The entity of each name in its star (name, centre, form, craft)."""
    starred = materialize(starred.select("name", "centre", "form", "craft"), "name-stars")
    sure = starred.where((F.col("form") != "") & ((F.length("form") > 3) | ~F.col("form").startswith("f:")))
    keys = sure.groupBy("centre", "form").agg(F.collect_set("craft").alias("crafts"))
    # what an initial or a bare name can mean; kinds and first names of one core word are few
    per_centre = keys.groupBy("centre").agg(F.collect_list(F.struct("form", "crafts")).alias("known"))
    fits = F.expr("filter(known, k -> form = '' OR substring(k.form, 1, 3) = form)")
    by_craft = F.expr("filter(fits, k -> craft <> '' AND array_contains(k.crafts, craft))")
    vague = (
        starred.where(~((F.col("form") != "") & ((F.length("form") > 3) | ~F.col("form").startswith("f:"))))
        .join(per_centre, "centre", "left")
        .withColumn("fits", F.coalesce(fits, F.array().cast("array<struct<form:string,crafts:array<string>>>")))
        .withColumn("by_craft", by_craft)
        .withColumn(
            "meant",
            F.when(F.size("fits") == 1, F.col("fits")[0]["form"]).when(F.size("by_craft") == 1, F.col("by_craft")[0]["form"]).otherwise(F.col("form")),
        )
        .select("name", "centre", F.col("meant").alias("form"))
    )
    entity = F.concat_ws("|", "centre", "form").alias("entity")
    return sure.select("name", entity).unionAll(vague.select("name", entity))


def name_pairs(entities: DataFrame) -> DataFrame:
    """Every pair of different spellings of one entity, the smaller first in byte order."""
    a, b = entities.alias("a"), entities.alias("b")
    return a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.name") < F.col("b.name"))).select(
        F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b")
    )
