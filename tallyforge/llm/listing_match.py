"""Product listings describing the same item (problem 1).

1. Attributes are parsed out of description and unit into canonical form; units come from the
   conversion graph of the library. Wordings of kinds are learned from lines of one model and maker
   that differ in nothing else. Lines with equal attributes form one class.
2. Classes are compared within blocks of equal size and pack: those of near makers and one kind
   that state the same model or of which one states none, and those of one model of which one
   lacks maker or kind. Makers are near if they share a key: words of up to ``EXACT`` letters have
   one for each way to leave out two letters, which every pair two edits apart has in common,
   longer ones MinHash bands.
3. The comparison (maker, kind, size, colour, model, pack) gets weights by
   expectation-maximisation: m-probabilities from the pairs, u-probabilities from the exact counts
   of values, so a rare maker or model says more. What one side does not state is no evidence.
4. Pairs above the threshold are linked; lines of equal attributes have to pass it too. By the
   definition of an article, colours or models that both state must be equal.
5. Links are clustered by stars around the wordings that most lines use.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.linkage_weights import MISSING, LinkageWeights, fit
from tallyforge.llm.listing_parts import attributes, kind_words, plain
from tallyforge.llm.minhash import bands_for, with_bands
from tallyforge.llm.name_variants import edit_similarity, may_be_error
from tallyforge.llm.star_clusters import star_clusters
from tallyforge.storage import materialize

GRAM, ROWS, RECALL = 3, 3, 0.95
#: Jaccard similarity of the padded trigrams of two words of ``EXACT`` + 1 letters with two errors.
SIMILARITY = 7 / 23
#: Makers of up to so many letters get exact keys.
EXACT = 12
#: Makers with fewer letters are near only if a single edit apart.
TWO_ERRORS = 6
FIELDS = ["maker", "kind", "size", "colour", "model", "pack"]
VECTOR = ["v_maker", "v_kind", "v_size", "v_colour", "v_model", "v_pack"]
#: Start of the m-probabilities. maker: equal, a typing error of one letter, of two, or near although
#: many lines write either; the others: equal, different.
FIRST = ((0.9, 0.07, 0.02, 0.01), (0.98, 0.02), (0.98, 0.02), (0.98, 0.02), (0.98, 0.02), (0.98, 0.02))
#: Chance that a field of two lines agrees, and that two lines are one article, in a table of no
#: lines; so many pairs this counts for beside those of the table.
CHANCE, PRIOR, HELD = (0.002, 0.05, 0.05, 0.12, 0.002, 0.4), 0.005, 2000.0
#: A pair is linked if it is more likely one article than two; a higher bound drops misspelt makers of lines that state little else.
THRESHOLD = 0.5
#: Two wordings are one kind if lines of so many models, and of so many makers, differ in them alone.
WORDING_MODELS, WORDING_MAKERS = 3, 2
#: Texts of more different words (whole sentences) are not split into a name and a wording; they stay as they are.
WORDING_WORDS = 12
#: Added to the rank of classes with maker and kind: a star around one that lacks either could join two articles.
COMPLETE = 1 << 40


def listing_attributes(lines: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """(id, maker, kind, size, colour, model, pack, wording) of the lines with a seller_code.

    ``wording`` is the plain text, equal in copies of a line. The words of a kind that is not listed
    stand with the maker.

    Null texts count as empty; texts of any length are read whole. A line that states neither maker nor
    kind is left out, as nothing tells its article.
    """

    listed = kind_words(kinds)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [attributes(d, u, listed) for d, u in zip(b["description"], b["unit"])]
            wording = [f"{plain(d)}|{plain(u)}" for d, u in zip(b["description"], b["unit"])]
            yield pd.DataFrame({"id": b["id"]} | {k: [r[i] for r in rows] for i, k in enumerate(FIELDS)} | {"wording": wording})

    catalogue = lines.where(F.col("seller_code").isNotNull()).select("id", "description", "unit")
    # a file may hold no such line, and parsing costs the most here: spread the few rows evenly
    parsed = catalogue.repartition(catalogue.sparkSession.sparkContext.defaultParallelism * 2).mapInPandas(
        parse, "id long, maker string, kind string, size string, colour string, model string, pack int, wording string"
    )
    return parsed.where("maker <> '' OR kind <> ''")


def names_and_wordings(texts: DataFrame) -> DataFrame:
    """(maker, name, wording): texts of 2 to ``WORDING_WORDS`` words split into a name and the rest.

    The name is the word that stands beside the fewest different words: a maker makes some kinds, a
    kind has many makers, however many lines either has.
    """
    split = texts.select("maker", F.array_distinct(F.split("maker", " ")).alias("words")).where(F.size("words").between(2, WORDING_WORDS))
    each = split.select("*", F.explode("words").alias("word"))
    beside = each.select("word", F.explode("words").alias("other")).where("word <> other").distinct().groupBy("word").agg(F.count("*").alias("n"))
    names = each.join(beside, "word").groupBy("maker").agg(F.min_by("word", F.struct("n", "word")).alias("name"), F.first("words").alias("words"))
    return names.select("maker", "name", F.array_join(F.array_remove("words", F.col("name")), " ").alias("wording"))


def learned_wordings(named: DataFrame) -> DataFrame:
    """(wording, kind): wordings of unlisted kinds that stand for each other, the most used one as the kind.

    Lines (model, size, pack, name, wording) that state one model, size, pack and name are compared
    with the most used wording among them.
    """
    anchor = ["model", "size", "pack", "name"]
    used = named.where("model <> ''").groupBy(*anchor, "wording").agg(F.count("*").alias("n"))
    top = used.groupBy(*anchor).agg(F.max_by("wording", F.struct("n", "wording")).alias("top"))
    met = used.join(top, anchor).where("wording <> top")
    pairs = met.select("model", "name", F.least("wording", "top").alias("a"), F.greatest("wording", "top").alias("b"))
    support = pairs.groupBy("a", "b").agg(F.count_distinct("model").alias("n"), F.count_distinct("name").alias("makers"))
    sure = support.where((F.col("n") >= WORDING_MODELS) & (F.col("makers") >= WORDING_MAKERS))
    stars = star_clusters(sure.select("a", "b", F.col("n").alias("n_a"), F.col("n").alias("n_b")))
    return stars.select(F.col("vertex").alias("wording"), F.col("centre").alias("kind"))


def with_learned_kinds(parsed: DataFrame) -> DataFrame:
    """``parsed`` with learned wordings taken out of the maker and put in as the kind."""
    unlisted = parsed.where("kind = '' AND maker LIKE '% %'")
    if unlisted.isEmpty():
        return parsed
    names = materialize(names_and_wordings(unlisted.select("maker").distinct()), "listing-names")
    named = unlisted.select("maker", "model", "size", "pack").join(names, "maker")
    found = names.join(materialize(learned_wordings(named), "listing-wordings"), "wording").select(F.col("maker").alias("unlisted"), "name", F.col("kind").alias("learned"))
    joined = parsed.join(found, (F.col("kind") == "") & (F.col("maker") == F.col("unlisted")), "left")
    kept = {"maker": F.coalesce("name", "maker"), "kind": F.coalesce("learned", "kind")}
    # read by three steps of the comparison
    return materialize(joined.select(*(kept[c].alias(c) if c in kept else F.col(c) for c in parsed.columns)), "listing-kinds")


def differing(a: str, b: str) -> tuple[str, str]:
    """Both without what they begin and end with alike: a maker may be a whole long text."""
    start = len(os.path.commonprefix([a, b]))
    a, b = a[start:], b[start:]
    end = len(os.path.commonprefix([a[::-1], b[::-1]]))
    return a[: len(a) - end], b[: len(b) - end]


def exact_keys(makers: DataFrame) -> DataFrame:
    """(maker, band): each maker of up to ``EXACT`` letters with up to two letters left out, of short ones one.

    Two makers that are so many errors apart (swaps among them) share a key.
    """
    one = "transform(sequence(1, length({0})), i -> concat(substring({0}, 1, i - 1), substring({0}, i + 1)))"
    less_one = F.expr(one.format("maker"))
    less_two = F.expr(f"CASE WHEN length(maker) >= {TWO_ERRORS} THEN flatten(transform(less_one, w -> {one.format('w')})) ELSE array() END")
    short = makers.where(F.length("maker") <= EXACT).withColumn("less_one", less_one).withColumn("less_two", less_two)
    keys = F.array_distinct(F.transform(F.concat(F.array("maker"), "less_one", "less_two"), lambda w: F.xxhash64(w)))
    return short.select("maker", F.explode(keys).alias("band"))


def maker_pairs(classes: DataFrame) -> DataFrame:
    """(a, b, edits) of makers one edit apart, or two where both have ``TWO_ERRORS`` letters; each with itself too."""
    makers = materialize(classes.select("maker").distinct(), "makers")
    long = makers.where(F.length("maker") > EXACT - 2)
    keyed = materialize(with_bands(long, "maker", GRAM, ROWS, bands_for(SIMILARITY, ROWS, RECALL)).unionAll(exact_keys(makers)), "maker-bands")
    a, b = keyed.alias("a"), keyed.alias("b")
    near = (
        a.join(b, F.col("a.band") == F.col("b.band"))
        .where((F.col("a.maker") < F.col("b.maker")) & (F.levenshtein("a.maker", "b.maker", 4) >= 0))
        .select(F.col("a.maker").alias("a"), F.col("b.maker").alias("b"))
        .distinct()
    )

    def count_edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(edits=[round((1 - edit_similarity(p, q)) * max(len(p), len(q))) for p, q in map(differing, x.a, x.b)])

    least = F.least(F.length("a"), F.length("b"))
    counted = near.mapInPandas(count_edits, "a string, b string, edits int").where((F.col("edits") <= 1) | ((F.col("edits") == 2) & (least >= TWO_ERRORS)))
    return makers.select(F.col("maker").alias("a"), F.col("maker").alias("b"), F.lit(0).alias("edits")).unionAll(counted)


def maker_errors(makers: DataFrame, near: DataFrame) -> DataFrame:
    """``near`` with ``error``: by the distinct lines (maker_n) of both, one of them may be misspelt.

    Two edits apart, both must be misspellings, of each other or of a third one.
    """
    side = lambda s: makers.select(F.col("maker").alias(s), F.col("maker_n").alias(f"maker_n_{s}"))
    counted = near.join(side("a"), "a").join(side("b"), "b").withColumn("fits", may_be_error(F.col("maker_n_a"), F.col("maker_n_b")))
    fewer = (F.col("edits") == 1) & F.col("fits") & (F.col("maker_n_a") != F.col("maker_n_b"))
    wrong = (
        counted.where(fewer).select(F.when(F.col("maker_n_a") < F.col("maker_n_b"), F.col("a")).otherwise(F.col("b")).alias("maker"))
        .unionAll(makers.where("maker_n = 1").select("maker"))
        .distinct()
    )
    flag = lambda s: wrong.select(F.col("maker").alias(s), F.lit(True).alias(f"wrong_{s}"))
    flagged = counted.join(flag("a"), "a", "left").join(flag("b"), "b", "left")
    both = F.col("wrong_a").isNotNull() & F.col("wrong_b").isNotNull()
    return flagged.select("a", "b", "edits", ((F.col("edits") == 0) | ((F.col("edits") == 1) & F.col("fits")) | both).alias("error"))


def _level(a: str, b: str) -> Column:
    a, b = F.col(a), F.col(b)
    return F.when((a == "") | (b == ""), MISSING).when(a == b, 0).otherwise(1)


def _compared(pairs: DataFrame, maker_level: Column) -> DataFrame:
    """Pairs of classes ``a`` and ``b`` with their comparison vector."""
    return pairs.select(
        F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b"), F.col("a.rank").alias("n_a"), F.col("b.rank").alias("n_b"),
        maker_level.alias("v_maker"), *(_level(f"a.{c}", f"b.{c}").alias(f"v_{c}") for c in ("kind", "size", "colour", "model")), F.lit(0).alias("v_pack"),
    )


def compared(classes: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs of classes of one block, each pair once, with their comparison vector.

    Classes of near makers and equal kind, size and pack meet if they state the same model or one
    of them none: those with a model look for it, those without (one for each colour) look at all
    of the block.
    """
    both = near.select("a", "b", "edits", "error").unionAll(near.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "edits", "error"))
    stated = F.col("model") != ""
    left = classes.where("maker <> ''").join(both, F.col("maker") == F.col("a")).withColumn("key", F.when(stated, F.col("model")).otherwise("*")).alias("a")
    right = classes.withColumn("key", F.explode(F.when(stated, F.array("model", F.lit("*"))).otherwise(F.array(F.lit("*"))))).alias("b")
    block = ["kind", "size", "pack", "key"]
    met = left.join(right, [F.col("a.b") == F.col("b.maker"), *(F.col(f"a.{c}") == F.col(f"b.{c}") for c in block)]).where(
        # of a pair with equal claims on both sides one order, else the order in which the one without model looks
        ((F.col("a.model") == "") & (F.col("b.model") != "")) | (F.col("a.class_id") < F.col("b.class_id"))
    )
    edits = F.when(F.col("edits") == 0, 0).when(F.col("error"), F.col("edits")).otherwise(3)
    near_makers = _compared(met, edits)
    # maker or kind missing on one side: by the model
    named = classes.where("model <> ''")
    equal = lambda c: (F.col(f"a.{c}") != "") & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    open_ = lambda c: (F.col(f"a.{c}") == F.col(f"b.{c}")) | (F.col(f"a.{c}") == "") | (F.col(f"b.{c}") == "")
    part = named.where("maker = '' OR kind = ''").alias("a").join(named.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("size", "pack", "model")]).where(
        (equal("maker") | equal("kind")) & open_("maker") & open_("kind")
        & ~(equal("maker") & (F.col("a.kind") == F.col("b.kind")))  # those met above
        & ((F.col("b.rank") > COMPLETE) | (F.col("a.class_id") < F.col("b.class_id")))
    )
    return near_makers.unionAll(_compared(part, _level("a.maker", "b.maker")))


def chance_levels(classes: DataFrame, near: DataFrame) -> tuple[list[list[float]], float]:
    """How often two classes that both state a field reach each level by chance, and the number of pairs.

    Exact shares, from counts of values; each share is drawn to ``CHANCE`` by ``HELD`` pairs.
    """
    total = float(classes.count())
    pairs = total * (total - 1) / 2
    agree = []
    for field, known in zip(FIELDS, CHANCE):
        sizes = classes.where(F.col(field).cast("string") != "").groupBy(field).agg(F.count("*").cast("double").alias("c"))
        c, squares = sizes.agg(F.sum("c"), F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()
        c = c or 0.0
        agree.append(((squares or 0.0) + HELD * known) / (c * (c - 1) / 2 + HELD))
    per_maker = classes.groupBy("maker").agg(F.count("*").cast("double").alias("c"))
    met = near.where("edits > 0 AND error").join(per_maker.withColumnRenamed("maker", "a").withColumnRenamed("c", "c_a"), "a")
    met = met.join(per_maker.withColumnRenamed("maker", "b").withColumnRenamed("c", "c_b"), "b")
    by_edits = {r.edits: r.s for r in met.groupBy("edits").agg(F.sum(F.col("c_a") * F.col("c_b")).alias("s")).collect()}
    errors = [(by_edits.get(e, 0.0) + HELD * CHANCE[0] / 2) / (pairs + HELD) for e in (1, 2)]
    # what is near although many lines write either counts as another maker
    levels = [[agree[0], *errors, 1 - agree[0] - sum(errors)]]
    return levels + [[p, 1 - p] for p in agree[1:]], pairs


def fitted(pairs: DataFrame, classes: DataFrame, near: DataFrame) -> LinkageWeights:
    """EM over the vectors of the candidate pairs and of the pairs of lines that are equal in all fields."""
    counts = {tuple(r[v] for v in VECTOR): float(r.n) for r in pairs.groupBy(*VECTOR).agg(F.count("*").alias("n")).collect()}
    alike = classes.select(*own_vector(), (F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("n")).groupBy(*VECTOR).agg(F.sum("n").alias("n"))
    for r in alike.collect():
        v = tuple(r[x] for x in VECTOR)
        counts[v] = counts.get(v, 0.0) + r.n
    chance, total = chance_levels(classes, near)
    lines = float(classes.agg(F.sum("n")).first()[0] or 0)
    return fit({v: c for v, c in counts.items() if c}, FIRST, chance, max(total, lines * (lines - 1) / 2), PRIOR, HELD)


def own_vector() -> list[Column]:
    """The comparison of two lines of one class."""
    return [F.when(F.col(c).cast("string") == "", MISSING).otherwise(0).alias(v) for c, v in zip(FIELDS, VECTOR)]


def posterior(weights: LinkageWeights) -> Column:
    """The probability that a pair with this comparison vector is one article."""
    bits = F.lit(0.0)
    for name, ws in zip(VECTOR, weights.weights):
        per = F.lit(0.0)
        for level, w in enumerate(ws):
            per = F.when(F.col(name) == level, w).otherwise(per)
        bits = bits + per
    prior = weights.prior
    return F.lit(1.0) / (F.lit(1.0) + F.lit((1 - prior) / prior) * F.pow(F.lit(2.0), -bits))


def match_listings(lines: DataFrame, threshold: float = THRESHOLD, kinds: dict[str, str] | None = None) -> DataFrame:
    """(id, article): each catalogue line with the id of its article's cluster.

    ``kinds`` may list wordings of kinds, as ``listing_parts.KINDS`` does, for tables too small to learn
    them from: a wording is learned from three models of two makers.

    Lines that come again are lines of their own in the same article. No line, no row.
    """
    parsed = with_learned_kinds(materialize(listing_attributes(lines, kinds), "listings"))
    classes = parsed.groupBy(*FIELDS).agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    rank = F.col("n") + F.when(F.expr("maker <> '' AND kind <> ''"), COMPLETE).otherwise(0)
    classes = materialize(classes.withColumn("rank", rank), "listing-classes")
    makers = parsed.select("maker", "wording").distinct().groupBy("maker").agg(F.count("*").alias("maker_n"))
    makers = materialize(makers, "maker-lines")
    near = materialize(maker_errors(makers, materialize(maker_pairs(classes.where("maker <> ''")), "maker-edits")), "maker-pairs")
    pairs = materialize(compared(classes, near), "listing-pairs")
    p = posterior(fitted(pairs, classes, near))
    links = pairs.where((p >= threshold) & (F.col("v_colour") != 1) & (F.col("v_model") != 1))
    stars = star_clusters(links.select("a", "b", "n_a", "n_b"))
    alone = classes.select("*", *own_vector()).withColumn("alike", p >= threshold).select(*FIELDS, "class_id", "alike")
    with_class = parsed.join(alone, FIELDS)
    article = F.when(F.col("alike"), F.coalesce(F.col("centre").cast("long"), F.col("class_id"))).otherwise(F.col("id"))
    return with_class.join(stars, F.col("class_id") == F.col("vertex"), "left").select("id", article.alias("article"))


def listing_pairs(articles: DataFrame) -> DataFrame:
    """Every pair of lines of one article, the smaller id first."""
    a, b = articles.alias("a"), articles.alias("b")
    return a.join(b, (F.col("a.article") == F.col("b.article")) & (F.col("a.id") < F.col("b.id"))).select(
        F.col("a.id").alias("line_item_id_a"), F.col("b.id").alias("line_item_id_b")
    )
