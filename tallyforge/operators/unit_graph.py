"""Quantities recorded in different units (problem 6).

Conversions are edges of a graph with affine functions ``to = scale * from + offset``. The
shortest composition from every unit to the canonical unit of its dimension is worked out once on
the driver (the graph has one node a unit, so its size does not depend on the data), each edge
that closes a cycle is checked against it, and rows are converted by an equi-join on the unit.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Affine:
    """x -> scale * x + offset, exactly."""

    scale: Fraction
    offset: Fraction = Fraction(0)

    def then(self, after: Affine) -> Affine:
        return Affine(after.scale * self.scale, after.scale * self.offset + after.offset)

    def inverse(self) -> Affine:
        return Affine(1 / self.scale, -self.offset / self.scale)

    def decimal(self) -> Decimal:
        """The scale to 13 places, enough for every unit listed here to be exact."""
        return to_decimal(self.scale)


def to_decimal(x: Fraction) -> Decimal:
    return (Decimal(x.numerator) / Decimal(x.denominator)).quantize(Decimal(1).scaleb(-13))


@dataclass
class ConversionGraph:
    """Units as nodes, conversions as edges in both directions."""

    edges: dict[str, list[tuple[str, Affine]]] = field(default_factory=dict)

    def add(self, unit: str, to: str, scale: str | Fraction, offset: str | Fraction = Fraction(0)) -> None:
        """``to`` = scale * ``unit`` + offset. A scale of 0 is refused."""
        f = Affine(Fraction(scale), Fraction(offset))
        if f.scale == 0:
            raise ValueError(f"conversion of {unit} to {to} can't be inverted")
        self.edges.setdefault(unit, []).append((to, f))
        self.edges.setdefault(to, []).append((unit, f.inverse()))

    def to_canonical(self, canonical: list[str]) -> dict[str, tuple[str, Affine]]:
        """Unit -> (canonical unit, shortest composition). Raises where two paths disagree."""
        found: dict[str, tuple[str, Affine]] = {}
        for goal in canonical:
            if goal in found:
                raise ValueError(f"{goal} and {found[goal][0]} measure the same dimension")
            found[goal] = (goal, Affine(Fraction(1)))
            queue = deque([goal])
            while queue:
                at = queue.popleft()
                for near, from_at in self.edges.get(at, []):
                    whole = from_at.inverse().then(found[at][1])
                    if near not in found:
                        found[near] = (goal, whole)
                        queue.append(near)
                    elif found[near] != (goal, whole):
                        raise ValueError(f"conversions between {at} and {near} contradict another path")
        return found


# fixed values: definitions of the units (metric, international, US liquid)
DEFINITIONS = (
    ("kg", "g", "1000"), ("dag", "g", "10"), ("g", "mg", "1000"), ("lb", "kg", "0.45359237"), ("lb", "oz", "16"),
    ("l", "ml", "1000"), ("l", "cl", "100"), ("l", "dl", "10"), ("hl", "l", "100"), ("cl", "ml", "10"),
    ("gal", "l", "3.785411784"), ("gal", "fl oz", "128"),
    ("m", "cm", "100"), ("m", "mm", "1000"), ("m", "dm", "10"), ("km", "m", "1000"), ("cm", "mm", "10"),
    ("in", "cm", "2.54"), ("ft", "in", "12"), ("yd", "ft", "3"), ("yd", "m", "0.9144"),
)
CANONICAL = ["kg", "l", "m"]

# fixed values: spellings of the units, in lower case, without full stops
SPELLINGS = {
    "kg": "kg kgs kilo kilos kilogram kilograms kilogramm kilogramme kilogrammes kilogramov",
    "g": "g gr gram grams gramm gramme grammes gramov",
    "mg": "mg milligram milligrams milligramm",
    "dag": "dag dkg deka dekagram dekagrams dekagramm",
    "lb": "lb lbs pound pounds",
    "oz": "oz ounce ounces",
    "l": "l lit ltr liter liters litre litres litrov",
    "ml": "ml milliliter milliliters millilitre millilitres mililiter",
    "cl": "cl centiliter centiliters centilitre centilitres",
    "dl": "dl deciliter deciliters decilitre decilitres",
    "hl": "hl hectoliter hectolitre",
    "gal": "gal gallon gallons",
    "fl oz": "fl oz|floz|fluid ounce|fluid ounces",
    "m": "m mtr mtrs meter meters metre metres metrov",
    "cm": "cm centimeter centimeters centimetre centimetres zentimeter",
    "mm": "mm millimeter millimeters millimetre millimetres milimeter",
    "dm": "dm decimeter decimetre",
    "km": "km kilometer kilometre",
    "in": 'in inch inches "',
    "ft": "ft foot feet",
    "yd": "yd yds yard yards",
}


def default_graph() -> ConversionGraph:
    graph = ConversionGraph()
    for unit, to, scale in DEFINITIONS:
        graph.add(unit, to, scale)
    return graph


def spelling_list(names: str) -> list[str]:
    return names.split("|") if "|" in names else names.split(" ")


def conversion_table(
    spark: SparkSession, graph: ConversionGraph | None = None, canonical: list[str] = CANONICAL
) -> DataFrame:
    """(spelling, base_unit, factor, shift): one row a spelling, as large as the unit lists only."""
    found = (graph or default_graph()).to_canonical(canonical)
    rows = [
        (spelling, base, f.decimal(), to_decimal(f.offset))
        for unit, (base, f) in found.items()
        for spelling in spelling_list(SPELLINGS.get(unit, unit))
    ]
    return spark.createDataFrame(rows, "spelling string, base_unit string, factor decimal(17,13), shift decimal(17,13)")


def between(spark: SparkSession, graph: ConversionGraph, canonical: list[str], names: dict[str, str]) -> DataFrame:
    """(unit, target, factor, shift): from every spelling to every unit of its dimension, by way of the canonical one."""
    found = graph.to_canonical(canonical)
    rows = []
    for unit, (base, f) in found.items():
        for target, (other, g) in found.items():
            if base == other:
                whole = f.then(g.inverse())
                rows += [(s, target, float(whole.scale), float(whole.offset)) for s in spelling_list(names.get(unit, unit))]
    return spark.createDataFrame(rows, "unit string, target string, factor double, shift double")


def converted(
    rows: DataFrame, value: str, unit: str, target: str, graph: ConversionGraph | None = None, canonical: list[str] = CANONICAL, names: dict[str, str] = SPELLINGS
) -> DataFrame:
    """``rows`` with ``converted``: the column ``value`` in units of the column ``target`` instead of ``unit``.

    Units may be spelled in any listed way and case; ``target`` holds names of the graph. Null where a
    unit is unknown, of another dimension than its target, or anything is null; no row is lost.
    The table of conversions has a row a spelling and target and is sent to the rows, so they are not shuffled.
    """
    pairs = between(rows.sparkSession, graph or default_graph(), canonical, names)
    spelled = F.trim(F.regexp_replace(F.lower(unit), r"\.", ""))
    pairs = pairs.select(F.struct("unit", "target").alias("from_to"), "factor", "shift")
    joined = rows.withColumn("from_to", F.struct(spelled.alias("unit"), F.lower(target).alias("target"))).join(F.broadcast(pairs), "from_to", "left")
    return joined.withColumn("converted", F.col(value).cast("double") * F.col("factor") + F.col("shift")).drop("from_to", "factor", "shift")


def plain(text: Column) -> Column:
    """Lower case, one form of fractions, multiplication signs, decimal commas, blanks and stops."""
    t = F.lower(text)
    t = F.regexp_replace(t, "½", " 1/2")
    t = F.regexp_replace(t, "¼", " 1/4")
    t = F.regexp_replace(t, "¾", " 3/4")
    t = F.regexp_replace(t, "[×*]", "x")
    t = F.regexp_replace(t, r"(\d),(\d)", "$1.$2")
    t = F.regexp_replace(t, r"(?<!\d)\.|\.(?!\d)", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


NUMBER = r"\d+ \d+/\d+|\d+/\d+|\d+(?:\.\d+)?"


def measure_pattern() -> str:
    """count x size unit [size unit], e.g. ``6x0.25 kg``, ``1 1/2 m``, ``3 lb 7 oz``."""
    # '"' may stand before anything; words must end there
    words = sorted((s for names in SPELLINGS.values() for s in spelling_list(names) if s != '"'), key=len, reverse=True)
    unit = '(?:(?:' + "|".join(words) + r')(?![\p{L}/-])(?!\d+(?!\d*(?:\.\d+)? ?(?:oz|ounce)))|")'
    return rf"(?<![\p{{L}}\d./-])(?:(\d+) ?x ?)?({NUMBER}) ?({unit})(?: ?(\d+(?:\.\d+)?) ?(oz|ounces?)(?![\p{{L}}\d]))?"


def number_of(text: Column) -> Column:
    """``1 1/2``, ``3/4`` or ``0.25`` as a decimal; null where there is none or it is over 0."""
    whole = F.regexp_extract(text, r"^(\d+) \d+/", 1).try_cast("decimal(15,8)")
    top = F.regexp_extract(text, r"(\d+)/\d+$", 1).try_cast("decimal(12,0)")
    low = F.regexp_extract(text, r"/(\d+)$", 1).try_cast("decimal(12,0)")
    part = F.try_divide(top, low).cast("decimal(15,8)")
    return F.when(text.contains("/"), F.coalesce(whole, F.lit(0)) + part).otherwise(text.try_cast("decimal(15,8)")).cast("decimal(15,8)")


def normalised_quantities(line_items: DataFrame, graph: ConversionGraph | None = None, canonical: list[str] = CANONICAL) -> DataFrame:
    """Measured product lines in kilograms, litres or metres.

    Returns (line_item_id, base_unit, quantity, price): ``quantity`` in the base unit and
    ``price`` for one base unit (null where price_per_unit is null), decimals not yet rounded.

    * ``unit`` decides. It is a plain unit (``kgs``), or holds a size (``bag 500 g``) of which
      ``amount`` counts so many, a null amount one.
    * A null or blank ``unit`` is read from ``description`` in the same way; without a measure
      there the row is left out, as are pieces and unknown units.
    * Where ``total_price`` is a thousandth of amount times price, ``amount`` is in g, ml or mm.
    * A row with a plain unit and a null amount, or with a size of 0, has no quantity and is left
      out. Rows that come again come out again; an empty table gives no rows.
    """
    spark = line_items.sparkSession
    table = conversion_table(spark, graph, canonical)
    kept = ["line_item_id", "amount", "price_per_unit", "total_price"]
    # inline() of one struct keeps the long expressions from being copied into each of their uses
    once = lambda **columns: F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    blank = F.coalesce(F.col("unit"), F.lit("")).rlike(r"^(?U)[\s\x{feff}]*$")
    products = (
        line_items.where(F.col("item_type") == "product")
        .select(F.col("id").alias("line_item_id"), "amount", "price_per_unit", "total_price", "unit", "description")
        # a description without a digit or a fraction sign holds no measure
        .where(~blank | F.col("description").rlike(r"[0-9½¼¾]"))
        .select(*kept, once(text=plain(F.when(blank, F.col("description")).otherwise(F.col("unit")))))
    )
    pattern = measure_pattern()
    parsed = products.select(
        *kept,
        "text",
        once(
            measured=F.col("text").rlike(r"\d"),
            found=F.when(F.col("text").rlike(r"\d"), F.array(*(F.regexp_extract("text", pattern, i) for i in range(1, 6)))),
        ),
    ).withColumn("spelling", F.when(F.col("measured"), F.col("found")[2]).otherwise(F.col("text")))
    joined = parsed.join(F.broadcast(table), "spelling")
    ounce = F.lit(default_graph().to_canonical(CANONICAL)["oz"][1].decimal()).cast("decimal(17,13)")
    size = F.coalesce(number_of(F.col("found")[1]), F.lit(1).cast("decimal(15,8)"))
    times = F.coalesce(F.col("found")[0].try_cast("decimal(6,0)"), F.lit(1).cast("decimal(6,0)"))
    ounces = F.coalesce(F.col("found")[3].try_cast("decimal(15,8)"), F.lit(0).cast("decimal(15,8)"))
    # one of what amount counts: of a size, itself in the base unit, else of the unit, whose shift counts once and not a unit
    content = (
        F.when(
            F.col("measured"),
            ((size * F.col("factor")).cast("decimal(26,14)") + F.col("shift") + (ounces * ounce).cast("decimal(26,14)")) * times,
        )
        .otherwise(F.col("factor"))
        .cast("decimal(22,14)")
    )
    shift = F.when(F.col("measured"), F.lit(0).cast("decimal(17,13)")).otherwise(F.col("shift"))
    due = F.col("amount") * F.col("price_per_unit")
    off = lambda x: F.abs(x - F.col("total_price"))
    thousandth = F.coalesce(
        (off(due) > F.lit(Decimal("0.01"))) & (off(due / 1000) <= F.lit(Decimal("0.01"))), F.lit(False)
    )
    count = F.coalesce(F.col("amount"), F.when(F.col("measured"), F.lit(1).cast("decimal(10,3)")))
    return (
        joined.withColumn("content", content)
        .withColumn("offset", shift)
        .withColumn("thousandth", thousandth)
        .select(
            "line_item_id",
            "base_unit",
            F.when(F.col("thousandth"), (F.col("amount") / 1000).cast("decimal(38,18)"))
            .otherwise((count * F.col("content") + F.col("offset")).cast("decimal(38,18)"))
            .alias("quantity"),
            F.when(F.col("thousandth"), F.col("price_per_unit").cast("decimal(38,12)"))
            .otherwise(F.try_divide(F.col("price_per_unit"), F.col("content")).cast("decimal(38,12)"))
            .alias("price"),
        )
        .where(F.col("quantity").isNotNull())
    )


def in_thousandths(quantities: DataFrame) -> DataFrame:
    """The rounded form: thousandths of the base unit and hundredths of the currency."""
    return quantities.select(
        "line_item_id",
        "base_unit",
        F.round(F.col("quantity") * 1000, 0).cast("long").alias("quantity_milli"),
        F.coalesce(F.round(F.col("price") * 100, 0).cast("long"), F.lit(-1).cast("long")).alias("price_cents"),
    )
