"""Deduplicating new batches against all history (problem 2): incremental record linkage.

What was accepted is kept as persisted tables of blocking keys in a folder, in slots by the hash of
the key; a new batch is probed against the slots its own keys fall into, and what it adds is
appended. History is neither keyed, compared nor written again, and another session can go on from
the folder (``save``, ``load``).

* the image hash of a user is a key of its own (groups of copies meet in one row, never in pairs);
* pairs with two totals meet in buckets of the total, 0.05 wide (the batch asks for three);
* pairs with a missing total meet in one of four equal 16-bit bands of the perceptual hash, which
  every pair with at most 3 different bits has;
* keys that hold more than ``HOT`` rows are split by further bits: eleven bands, of which every
  pair with at most 10 different bits shares one, or ten pairs of bands out of five, of which
  every pair with at most 3 different bits shares one.

Rows of one user with equal hash and total are one node. Candidate pairs are scored by weights
fitted by expectation-maximisation over the comparison vectors of all batches so far (chance
agreement of hashes is that of random bits), and taken where a repeat is more likely than not. The
project's definition of a repeat is checked after that (``exact``); the bound then is no higher
than the least score of a vector that can keep it, so no repeat is lost. Without the definition the
score alone decides. Whether an upload of the
batch is accepted depends on the uploads before it; nodes are settled in rounds (a node is settled
when all smaller neighbours are), which touch the affected nodes only and end in the
representative of each.
"""

from __future__ import annotations

import json
import math
import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.linkage_weights import LinkageWeights, fit
from tallyforge.storage import materialize, shared_dir

#: Largest difference of totals, in ten-thousandths, and of hashes in bits: with totals, without.
TOTAL_APART, BITS, BITS_NO_TOTAL = 500, 10, 3
#: A key with more rows, and with more than this share of all points, is hot; so of each kind of key at most 1,000 are.
HOT, HOT_SHARE = 2000, 1 / 1000
#: A batch with no more points (each with seven keys of about 60 bytes) is sent to the history, which then is
#: read where it lies; a larger one meets it in a shuffle.
SMALL_BATCH = 20_000
#: Keys of a slot, on average, when the tables are begun; the number of slots is kept from then on.
SLOT_KEYS = 2_000_000
#: Probability from which the score takes a pair for a repeat.
THRESHOLD = 0.5


def hex_text(value: Column) -> Column:
    """A hexadecimal number as text without zeros in front; null where it is none."""
    t = F.regexp_replace(F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " "))), "^0x", "")
    return F.when(t.rlike("^[0-9a-f]+$"), F.regexp_replace(t, "^0+(?=.)", ""))


def upload_fields(uploads: DataFrame, receipts: DataFrame) -> DataFrame:
    """(id, user_id, image, hash, total): total in ten-thousandths, hash as 64 bits.

    A null or unreadable hash, and a total no receipt has, are null and equal nothing.
    """
    totals = (
        receipts.where(F.col("total_amount").isNotNull() & F.col("upload_id").isNotNull())
        .groupBy("upload_id")
        .agg((F.sum("total_amount") * 10000).cast("long").alias("total"))
    )
    short = hex_text(F.col("perceptual_hash"))
    fields = uploads.select(
        "id", "user_id", "batch_no",
        hex_text(F.col("image_hash")).alias("image"),
        F.when(F.length(short) <= 16, F.conv(short, 16, -10).cast("long")).alias("hash"),
    )
    return fields.join(totals, fields.id == totals.upload_id, "left").drop("upload_id")


def _bands(count: int) -> list[tuple[int, int]]:
    """(shift, mask) of so many bands of the 64 bits."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _band(h: Column, band: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(h, band[0]).bitwiseAND(F.lit(band[1]))


def _key(kind: str, *parts: Column) -> Column:
    return F.xxhash64(F.col("user_id"), F.lit(kind), *parts)


FOUR, FIVE, ELEVEN = _bands(4), _bands(5), _bands(11)


KEYS = "key long, kind string, part int, user_id long, id long, hash long, total long"


def block_keys(points: DataFrame, probe: bool) -> DataFrame:
    """(key, kind, part, user_id, id, hash, total): one row for each blocking key of each point.

    ``probe``: the batch's side, which asks for the neighbouring buckets of the total as well.
    """
    bucket = F.floor(F.col("total") / TOTAL_APART)
    buckets = [bucket + i for i in ((-1, 0, 1) if probe else (0,))]
    keys = F.array(
        *(F.struct(F.when(F.col("total").isNotNull(), _key("t", b)).alias("key"), F.lit("t").alias("kind"), F.lit(0).alias("part")) for b in buckets),
        *(F.struct(_key(f"b{i}", _band(F.col("hash"), band)).alias("key"), F.lit("b").alias("kind"), F.lit(i).alias("part")) for i, band in enumerate(FOUR)),
    )
    return points.select(F.inline(keys), "user_id", "id", "hash", "total").where(F.col("key").isNotNull())


def split_hot(keys: DataFrame, hot: dict[str, list[int]]) -> DataFrame:
    """The keys with ``sub``: hot ones replaced by finer ones (numbered by ``sub``), the others as they are (-1)."""
    if not hot["t"] and not hot["b"]:
        return keys.withColumn("sub", F.lit(-1))
    is_hot = lambda kind: (F.col("kind") == kind) & (F.col("key").isin(hot[kind]) if hot[kind] else F.lit(False))
    finer = F.when(
        is_hot("t"),
        F.array(*(F.struct(F.xxhash64(F.col("key"), F.lit(i), _band(F.col("hash"), b)).alias("key"), F.lit(i).alias("sub")) for i, b in enumerate(ELEVEN))),
    ).when(
        is_hot("b"),
        F.array(*(
            F.struct(F.xxhash64(F.col("key"), F.lit(i), _band(F.col("hash"), FIVE[p]), _band(F.col("hash"), FIVE[q])).alias("key"), F.lit(i).alias("sub"))
            for i, (p, q) in enumerate(combinations(range(5), 2))
        )),
    ).otherwise(F.array(F.struct(F.col("key").alias("key"), F.lit(-1).alias("sub"))))
    return keys.withColumn("finer", finer).drop("key").select("*", F.inline("finer")).drop("finer")


def _first_common(x: Column) -> Column:
    """Whether this key is the first that the pair shares, so that each pair comes once."""
    agree = lambda b: _band(x, b) == 0
    earlier_four = [F.lit(False)]
    for i in range(1, 4):
        earlier_four.append(earlier_four[-1] | agree(FOUR[i - 1]))
    four = F.lit(True)
    for i in range(4):
        four = F.when(F.col("l.part") == i, ~earlier_four[i]).otherwise(four)

    def no_earlier(tests: list[Column]) -> Column:
        ok, seen = F.lit(True), F.lit(False)
        for i, t in enumerate(tests):
            ok = F.when(F.col("l.sub") == i, ~seen).otherwise(ok)
            seen = seen | t
        return ok

    eleven = no_earlier([agree(b) for b in ELEVEN])
    ten = no_earlier([agree(FIVE[p]) & agree(FIVE[q]) for p, q in combinations(range(5), 2)])
    return F.when(F.col("l.kind") == "t", (F.col("l.sub") < 0) | eleven).otherwise(four & ((F.col("l.sub") < 0) | ten))


def hash_level(bits: Column) -> Column:
    return F.when(bits == 0, 0).when(bits <= BITS_NO_TOTAL, 1).when(bits <= BITS, 2).otherwise(3)


def total_level(apart: Column) -> Column:
    return F.when(apart.isNull(), 2).when(apart <= TOTAL_APART, 0).otherwise(1)


#: Start of the m-probabilities: hashes equal, within 3 bits, within 10, further; totals near, apart, one missing.
FIRST = ((0.5, 0.3, 0.19, 0.01), (0.8, 0.02, 0.18))
#: Chance of each level for two uploads: so many of 64 random bits differ; totals as they come.
CHANCE = ((*(sum(math.comb(64, k) for k in ks) / 2**64 for ks in ((0,), range(1, BITS_NO_TOTAL + 1), range(BITS_NO_TOTAL + 1, BITS + 1))), 1.0), (0.02, 0.68, 0.3))
#: The comparison vectors under which an upload can repeat another.
ADMITTED = ((0, 0), (1, 0), (2, 0), (0, 2), (1, 2))


class LinkageState:
    """The persisted tables: keys of what was accepted, image hashes, links, and the counts behind the weights.

    All lie below ``folder``, by default a new one in the shared folder. ``exact`` says that the
    project's definition of a repeat is checked; without it the score decides.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, exact: bool = True) -> None:
        self.spark, self.exact = spark, exact
        self.folder = folder or f"{shared_dir(spark)}/dedup-{uuid.uuid4().hex}"
        self.slots = 0
        #: Names of the parts that were written, points among them, and how often each comparison vector came.
        self.parts: dict[str, list[str]] = {"images": [], "keys": [], "links": []}
        self.n_points = 0
        self.counts: dict[tuple[int, int], int] = {}
        self.n_pairs = 0.0
        self.saved = 0

    def save(self) -> None:
        """Write down what the folder holds; ``load`` reads the newest such note."""
        note = {"slots": self.slots, "parts": self.parts, "n_points": self.n_points, "n_pairs": self.n_pairs, "counts": [[*v, c] for v, c in self.counts.items()], "exact": self.exact}
        self.saved += 1
        self.spark.createDataFrame([(self.saved, json.dumps(note))], "no int, note string").coalesce(1).write.mode("append").parquet(f"{self.folder}/notes")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> LinkageState:
        """The state that was saved in ``folder``, in any session."""
        last = spark.read.schema("no int, note string").parquet(f"{folder}/notes").orderBy(F.col("no").desc()).first()
        note = json.loads(last.note)
        state = cls(spark, folder, note["exact"])
        state.slots, state.parts, state.n_points, state.n_pairs, state.saved = note["slots"], note["parts"], note["n_points"], note["n_pairs"], last.no
        state.counts = {(a, b): c for a, b, c in note["counts"]}
        return state

    def _write(self, table: str, rows: DataFrame, by_slot: bool = False) -> DataFrame:
        part = f"{self.folder}/{table}/batch={len(self.parts[table])}-{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy("slot") if by_slot else writer).parquet(part)
        self.parts[table].append(part)
        return self.spark.read.schema(rows.schema).parquet(part)

    def table(self, table: str, schema: str) -> DataFrame:
        parts = self.parts[table]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch string").option("basePath", f"{self.folder}/{table}").parquet(*parts).drop("batch")

    def _slot(self) -> Column:
        return F.pmod("key", F.lit(self.slots)).cast("int").alias("slot")

    def accept(self, fields: DataFrame) -> None:
        """Persist the keys of accepted uploads (appended; what is there stays as it is)."""
        images = fields.where(F.col("image").isNotNull()).groupBy("user_id", "image").agg(F.min("id").alias("id"))
        self._write("images", images)
        points = fields.where(F.col("hash").isNotNull()).groupBy("user_id", "hash", "total").agg(F.min("id").alias("id"))
        points = materialize(points, "dedup-points")
        n = points.count()
        self.n_points += n
        if not self.slots:
            self.slots = max(1, n * 5 // SLOT_KEYS)
        keys = block_keys(points, False)
        if self.slots > 1:
            keys = keys.withColumn("slot", self._slot()).repartition(self.slots, "slot")
        else:
            keys = keys.withColumn("slot", F.lit(0))
        self._write("keys", keys, by_slot=True)

    def probed(self, asked: DataFrame) -> DataFrame:
        """The persisted keys in the slots that the keys ``asked`` for fall into; slots are pruned before reading."""
        keys = self.table("keys", f"{KEYS}, slot int")
        if self.slots > 1:
            wanted = [r.slot for r in asked.select(self._slot()).distinct().collect()]  # at most as many as there are slots
            if len(wanted) < self.slots:
                keys = keys.where(F.col("slot").isin(wanted))
        return keys.drop("slot")

    def hot_keys(self, known: DataFrame, asked: DataFrame, n_known: int, small: bool) -> dict[str, list[int]]:
        """Keys of each kind (of bands, of each band) that hold very many points, of those the batch asks for; at most ``1 / HOT_SHARE``."""
        hot: dict[str, list[int]] = {"t": [], "b": []}
        keys = known.select("kind", "key")
        if small:
            keys = keys.join(F.broadcast(asked.select("kind", "key").distinct()), ["kind", "key"], "left_semi")
        counts = keys.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT, n_known * HOT_SHARE))
        for r in counts.select("kind", "key").collect():
            hot[r.kind].append(r.key)
        return hot

    def candidates(self, batch_points: DataFrame) -> DataFrame:
        """Pairs (p, q, old, bits, apart) of a point of the batch and one of history or batch."""
        new = batch_points.select(F.col("p").alias("id"), "user_id", "hash", "total")
        n_new = new.count()
        self.n_pairs += n_new * (self.n_points + n_new / 2)
        asked = materialize(block_keys(new, True), "dedup-asked")
        known = self.probed(asked).withColumn("old", F.lit(True)).unionAll(block_keys(new, False).withColumn("old", F.lit(False)))
        small = n_new <= SMALL_BATCH
        hot = self.hot_keys(known, asked, self.n_points + n_new, small)
        left = split_hot(asked, hot)
        left = (F.broadcast(left) if small and not (hot["t"] or hot["b"]) else left).alias("l")
        right = split_hot(known, hot).alias("r")
        x = F.col("l.hash").bitwiseXOR(F.col("r.hash"))
        both = F.col("l.total").isNotNull() & F.col("r.total").isNotNull()
        return (
            left.join(right, F.col("l.key") == F.col("r.key"))
            .where(
                (F.col("l.user_id") == F.col("r.user_id"))
                & (F.col("l.kind") == F.col("r.kind"))
                & (F.col("r.old") | (F.col("r.id") < F.col("l.id")))
                & ((F.col("l.kind") == "t") == both)
                & _first_common(x)
            )
            .select(
                F.col("l.id").alias("p"),
                F.col("r.id").alias("q"),
                F.col("r.old").alias("old"),
                F.bit_count(x).alias("bits"),
                F.abs(F.col("l.total") - F.col("r.total")).alias("apart"),
            )
        )

    @property
    def weights(self) -> LinkageWeights:
        return fit(self.counts, FIRST, CHANCE, self.n_pairs, first_prior=1e-5)

    def scored(self, pairs: DataFrame) -> DataFrame:
        """Candidate pairs with enough evidence by the weights, which learn from these pairs too."""
        levelled = pairs.withColumn("a", hash_level(F.col("bits"))).withColumn("b", total_level(F.col("apart")))
        for r in levelled.groupBy("a", "b").agg(F.count("*").alias("n")).collect():
            self.counts[(r.a, r.b)] = self.counts.get((r.a, r.b), 0) + r.n
        weights = self.weights
        vectors = [(a, b) for a in range(len(FIRST[0])) for b in range(len(FIRST[1]))]
        score = F.lit(None).cast("double")
        for v in vectors:
            score = F.when((F.col("a") == v[0]) & (F.col("b") == v[1]), weights.score(v)).otherwise(score)
        levelled = levelled.withColumn("score", score)
        least = min((weights.score(v) for v in vectors if weights.posterior(v) >= THRESHOLD), default=float("inf"))
        if not self.exact:
            return levelled.where(F.col("score") >= least).drop("a", "b")
        least = min(least, *(weights.score(v) for v in ADMITTED))
        rule = F.when(F.col("apart").isNotNull(), (F.col("apart") <= TOTAL_APART) & (F.col("bits") <= BITS)).otherwise(F.col("bits") <= BITS_NO_TOTAL)
        return levelled.where((F.col("score") >= least) & rule).drop("a", "b")

    def add_batch(self, fields: DataFrame) -> DataFrame:
        """Settle new uploads (in order of id) and persist what is accepted.

        Returns the links of the batch (upload_id, representative): each upload that repeats an
        accepted one of its user with a smaller id, with the smallest such. Ids of a batch are
        larger than those accepted before. Rows without a user or without any hash repeat
        nothing; an empty batch gives no links.
        """
        fields = materialize(fields.select("id", "user_id", "image", "hash", "total"), "dedup-batch")
        classes = fields.groupBy("user_id", "image", "hash", "total").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        has_user = F.col("user_id").isNotNull()
        images = classes.where(has_user & F.col("image").isNotNull()).groupBy("user_id", "image").agg(F.min("id").alias("g"), F.count("*").alias("gn"))
        points = classes.where(has_user & F.col("hash").isNotNull()).groupBy("user_id", "hash", "total").agg(F.min("id").alias("p"), F.count("*").alias("pn"))
        points = materialize(points, "dedup-new-points")
        pairs = materialize(self.scored(materialize(self.candidates(points), "dedup-candidates")), "dedup-pairs")
        c = classes.alias("c")
        nodes = (
            c.join(images.alias("i"), (F.col("c.user_id") == F.col("i.user_id")) & (F.col("c.image") == F.col("i.image")), "left")
            .join(
                points.alias("p"),
                (F.col("c.user_id") == F.col("p.user_id")) & (F.col("c.hash") == F.col("p.hash")) & F.col("c.total").eqNullSafe(F.col("p.total")),
                "left",
            )
            .select("c.id", "c.n", "g", "gn", "p", "pn", "c.user_id", "c.image")
        )
        from_image = self.table("images", "user_id long, image string, id long").groupBy("user_id", "image").agg(F.min("id").alias("h_image"))
        from_point = pairs.where("old").groupBy("p").agg(F.min("q").alias("h_point"))
        edges = pairs.where("NOT old").select("p", "q")
        edges = materialize(edges.unionAll(edges.select(F.col("q").alias("p"), F.col("p").alias("q"))), "dedup-edges")
        linked = edges.select("p").distinct().withColumn("linked", F.lit(True))
        affected = (
            nodes.join(from_image, ["user_id", "image"], "left").join(from_point, "p", "left").join(linked, "p", "left")
            .select("id", "g", "p", F.least("h_image", "h_point").alias("h"), (
                (F.col("n") > 1) | (F.col("gn") > 1) | (F.col("pn") > 1) | F.col("linked") | F.col("h_image").isNotNull() | F.col("h_point").isNotNull()
            ).alias("touched"))
            .where((F.col("g").isNotNull() | F.col("p").isNotNull()) & F.col("touched"))
            .select("id", "g", "p", "h", F.when(F.col("h").isNotNull(), "case").otherwise("open").alias("state"))
        )
        settled = self._settle(affected, edges)
        reps = settled.select("id", "representative", "state")
        # rows back from their classes
        keyed = fields.alias("f").join(
            c, (F.col("f.user_id") == F.col("c.user_id")) & F.col("f.image").eqNullSafe(F.col("c.image"))
            & F.col("f.hash").eqNullSafe(F.col("c.hash")) & F.col("f.total").eqNullSafe(F.col("c.total")),
        ).select(F.col("f.id").alias("upload_id"), F.col("c.id").alias("class_id"))
        links = self._write("links", keyed.join(reps, F.col("class_id") == F.col("id")).where("representative < upload_id").select("upload_id", "representative"))
        self.accept(fields.join(links, F.col("id") == F.col("upload_id"), "left_anti"))
        return links

    @staticmethod
    def _settle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Rounds until no node is open; then (id, state, representative)."""
        accepted = lambda: F.min(F.when(F.col("state") == "accepted", F.col("id")))
        still_open = lambda: F.min(F.when(F.col("state") == "open", F.col("id")))
        nodes = materialize(nodes, "dedup-nodes")
        while True:
            g = nodes.where("g IS NOT NULL").groupBy("g").agg(accepted().alias("ga"), still_open().alias("go"))
            p = nodes.where("p IS NOT NULL").groupBy("p").agg(accepted().alias("pa"), still_open().alias("po"))
            e = (
                edges.join(p.select(F.col("p").alias("q"), "pa", "po"), "q").groupBy("p")
                .agg(F.min("pa").alias("ea"), F.min("po").alias("eo"))
            )
            seen = (
                nodes.join(g, "g", "left").join(p, "p", "left").join(e, "p", "left")
                .withColumn("least", F.least("h", "ga", "pa", "ea"))
                .withColumn("waits", F.coalesce(F.least("go", "po", "eo") < F.col("id"), F.lit(False)))
            )
            if nodes.where("state = 'open'").isEmpty():
                return seen.select("id", "state", F.col("least").alias("representative"))
            now = F.when(F.col("state") != "open", F.col("state")).when(F.col("least") < F.col("id"), "case").when(
                ~F.col("waits"), "accepted"
            ).otherwise("open")
            nodes = materialize(seen.select("id", "g", "p", "h", now.alias("state")), "dedup-nodes")


def repeated_uploads(uploads: DataFrame, receipts: DataFrame) -> DataFrame:
    """(accepted_upload_id, duplicate_upload_id): batch 0 is the history, all later uploads are
    looked up in it and in each other. A null batch_no counts as a later batch."""
    fields = upload_fields(uploads, receipts)
    state = LinkageState(uploads.sparkSession)
    state.accept(fields.where("batch_no = 0"))
    links = state.add_batch(fields.where("NOT batch_no <=> 0"))
    return links.select(F.col("representative").alias("accepted_upload_id"), F.col("upload_id").alias("duplicate_upload_id"))
