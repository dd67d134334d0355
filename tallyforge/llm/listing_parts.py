"""The attributes of an article that a catalogue line states: maker, kind, size, colour, model, pack.

Runs in Arrow batches. Colours and advertising are word lists of the languages of the catalogues. A
list of kinds is only used where the caller gives one; words of other kinds stand with the maker,
from which ``listing_match`` takes them by what it learns.
"""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction

from tallyforge.operators.unit_graph import CANONICAL, SPELLINGS, Affine, default_graph, spelling_list

# a list of kinds that may be given for tables too small to learn from: each with the wordings that name it, in any order of the words
KINDS = {
    "coffee beans": "coffee beans|whole bean coffee|coffee bean",
    "storage box": "storage box|stackable box|box for storage",
    "engine oil": "engine oil|oil for engines|motor oil",
    "dog biscuits": "dog biscuits|biscuits for dogs|dog treats|treats for dogs",
    "hand soap": "hand soap|liquid soap|soap for hands",
    "led bulb": "led bulb|led lamp",
    "dish soap": "dish soap|dish liquid|washing up liquid|dishwashing liquid",
    "plaster filler": "plaster filler|filling plaster|filler",
    "desk lamp": "desk lamp|lamp for desk|table lamp",
    "washing powder": "washing powder|laundry powder|laundry detergent powder",
    "extension cord": "extension cord|extension lead|ext cable|extension cable|ext cord|ext lead",
    "drill bit": "drill bit|drillbit|bit for drill",
    "work gloves": "work gloves|safety gloves",
    "ballpoint pen": "ballpoint pen|ball pen|biro|ballpoint",
    "charging cable": "charging cable|charge lead|charger cable|charge cable|charging lead",
    "hex key": "hex key|hexagon key|allen key",
    "wall paint": "wall paint|paint for walls|interior paint",
    "notebook": "notebook|note book|exercise book",
    "wood varnish": "wood varnish|timber varnish|varnish for wood",
    "masking tape": "masking tape|painters tape",
}
# colours in the languages of the catalogues, short forms among them
COLOURS = {
    "red": "red rot rdeca rdec rd", "black": "black blk schwarz crna crn", "grey": "grey gray gry grau siva siv", "green": "green grn zelena zelen grun",
    "blue": "blue blu modra moder blau", "white": "white wht weiss bela bel", "yellow": "yellow ylw gelb rumena", "brown": "brown brn braun rjava",
}
# advertising, which says nothing about the article
ADVERTISING = (
    "for home & office", "home & office", "super value", "great price", "fast delivery", "must have", "top quality", "special offer", "in stock",
    "free shipping", "best price", "sale", "eco", "original", "bestseller", "limited", "new", "neu", "novo", "akcija", "premium", "angebot",
)


def size_units() -> dict[str, tuple[str, Affine]]:
    """Spelling -> (canonical unit, conversion to it), from the conversion graph, and power besides."""
    graph = default_graph()
    graph.add("kw", "w", "1000")
    more = {"w": "w watt watts", "kw": "kw", "l": f"{SPELLINGS['l']} lt"}
    found = graph.to_canonical([*CANONICAL, "w"])
    return {s: at for unit, at in found.items() for s in spelling_list(more.get(unit, SPELLINGS.get(unit, unit))) if s != '"'}


UNITS = size_units()

KindWords = dict[frozenset[str], str]


def kind_words(kinds: dict[str, str] | None) -> KindWords:
    """The words of each listed wording, with its kind."""
    return {frozenset(w.split()): kind for kind, names in (kinds or {}).items() for w in names.split("|")}


_COLOUR = {w: colour for colour, words in COLOURS.items() for w in words.split()}
_AD = re.compile(r"\*?(?<![a-z0-9])(?:" + "|".join(re.escape(a) for a in sorted(ADVERTISING, key=len, reverse=True)) + r")(?![a-z0-9])[!*]*|-?\d+ ?%")
_NUMBER = r"\d+(?:\.\d+)?"
#: Two letters before three digits are a model, although they may spell a unit.
_SIZE = re.compile(rf"(?<![a-z0-9./-])({_NUMBER}) ?({'|'.join(sorted(UNITS, key=len, reverse=True))})(?![a-z0-9])(?!(?<=[0-9 ][a-z]{{2}})[-/ ]\d{{3}}(?![a-z0-9.]))")
_PACKS = [
    re.compile(p)
    for p in (
        r"(?<![a-z0-9])(?:pack of|set of|box of|set|box ?/|pack ?/|bundle of) ?(\d+)(?![a-z0-9.])",
        r"(?<![a-z0-9./-])(\d+)[- ]?(?:er[- ]?pack|pack|pk|pcs?|pieces?|kos|kom|stk|stuck|ct|count|set)(?![a-z0-9])",
        r"(?<![a-z0-9])x ?(\d+)(?![a-z0-9.])",
        r"(?<![a-z0-9./-])(\d+) ?x(?![a-z0-9])",
    )
]
_MODEL = re.compile(r"(?<![a-z0-9])(?:mod(?:el|\.)?\s*)?([a-z]{2})\s?[-/ ]?\s?(\d{3})(?![a-z0-9.])")


def plain(text: str | None) -> str:
    """Lower case without accents, marks of trade and decimal commas."""
    t = unicodedata.normalize("NFKD", (text or "").replace("®", " ").replace("™", " ").replace("ß", "ss").lower())
    t = "".join(c for c in t if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub(r"(\d),(\d)", r"\1.\2", t)).strip()


def _take(pattern: re.Pattern, text: str) -> tuple[re.Match | None, str]:
    m = pattern.search(text)
    return m, f"{text[: m.start()]} | {text[m.end() :]}" if m else text


def _pack(text: str) -> tuple[int | None, str]:
    for p in _PACKS:
        m, rest = _take(p, text)
        if m:
            return int(m[1]), rest
    m, rest = _take(re.compile(r"(?<![a-z])dozen(?![a-z])"), text)
    return (12, rest) if m else (None, text)


def attributes(description: str | None, unit: str | None, listed: KindWords) -> tuple[str, str, str, str, str, int]:
    """(maker, kind, size, colour, model, pack); empty where the texts do not state it, pack 1."""
    text = _AD.sub(" | ", plain(description))
    unit_text = plain(unit)
    pack_u, unit_text = _pack(unit_text)
    size_u, unit_text = _take(_SIZE, unit_text)
    size, text = _take(_SIZE, text)
    model, text = _take(_MODEL, text)
    pack, text = _pack(text)
    size = size or size_u
    if size:
        unit_of, conversion = UNITS[size[2]]
        stated = f"{Fraction(size[1]) * conversion.scale + conversion.offset} {unit_of}"
    else:
        stated = ""
    words = re.findall(r"[a-z]+", re.sub(r"\bmod\b", " ", text))
    colour = ""
    of_kinds = {w for ws in listed for w in ws}
    named, rest = [], []
    for w in words:
        if w in _COLOUR:
            colour = colour or _COLOUR[w]
        elif w in of_kinds:
            named.append(w)
        else:
            rest.append(w)
    kind = listed.get(frozenset(named), "")
    if not kind and named:  # words of advertising may stand among them
        fits = [(len(ws), k) for ws, k in listed.items() if ws <= set(named)]
        kind = max(fits)[1] if fits else " ".join(sorted(set(named)))
    maker = " ".join(sorted(w for w in rest if len(w) > 2)) or " ".join(sorted(rest))
    return maker, kind, stated, colour, f"{model[1]}{model[2]}" if model else "", pack or pack_u or 1
