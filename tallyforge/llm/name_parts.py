"""The parts of a typed name of a shop, firm or person: core word, kind of shop, first name.

Runs on distinct spellings, in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# kinds of shop by the words that name them, abbreviations among them
KINDS = {
    "bakery": "bakery bkry bky bak", "bookshop": "bookshop bksp bookstore books bkshop", "butchers": "butchers butcher btchrs butch",
    "cafe": "cafe caffe coffee", "cleaning": "cleaning services clng svcs svc cleaners srvcs serv", "electrics": "electrics electrix elec electr electric electrical elect",
    "florist": "florist florists flor flrst flowers", "fuel": "fuel station stn st petrol fl", "furniture": "furniture furn furnit frntr",
    "garage": "garage grg gar autos", "garden": "garden centre gdn center ctr gard", "hardware": "hardware hdw hardw hware hdwe",
    "hotel": "hotel htl hot", "opticians": "opticians optician opt optic optics", "pharmacy": "pharmacy pharm phcy phmcy pharma chemist farmacy",
    "print": "print works printworks wks prnt printing prt printers", "restaurant": "restaurant rstrnt rest restnt resto restaur restaraunt", "shoes": "shoes shoez shoe shs",
    "stationery": "stationery stat stationers stny stnry statny", "supermarket": "supermarket smarket supermkt supm market supermrkt superm",
    "toys": "toys toyz toy tys", "transport": "transport transp trnsp trans haulage trnsprt",
}
# crafts of people who work for themselves
CRAFTS = "carpentry photography plumbing taxi tutoring carp carpenter photo photogr plumb plumber tutor tut photos".split()
# first names and their short forms
SHORT_NAMES = {
    "aleksandra": "aleks sasa sandra", "alexander": "alex sandy xander", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs",
    "benjamin": "ben benny", "catherine": "cathy cath", "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny",
    "dorothea": "dora dorli thea", "edward": "ed eddie ned", "elizabeth": "liz beth lizzie betty eliza lisa", "franziska": "franzi ziska fanny",
    "frederick": "fred freddy", "georgina": "gina georgie", "gregory": "greg", "henry": "harry hank", "james": "jim jimmy", "jennifer": "jen jenny",
    "johannes": "hans hannes", "john": "johnny jack", "jozef": "joze pepi", "joseph": "joe joey", "katherine": "kate kathy katie", "lawrence": "larry",
    "margaret": "peggy maggie meg", "matthew": "matt", "michael": "mike mick", "nicholas": "nick", "nikolai": "kolja niko", "patricia": "pat patty trish",
    "peter": "pete", "rebecca": "becky", "richard": "rick dick", "robert": "rob bob bobby", "samuel": "sam sammy", "stephen": "steve",
    "susanne": "susi sue", "theodore": "ted theo", "thomas": "tom tommy", "valentin": "tine val", "victoria": "vicky", "william": "bill billy will",
    "zacharias": "zach",
}
# legal forms, as they stand behind a name
LEGAL = re.compile(
    r"[\s,]+(d\.?\s?o\.?\s?o|d\.?\s?d|s\.?\s?p|g\.?\s?m\.?\s?b\.?\s?h|k\.?\s?g|l\.?\s?t\.?\s?d|limited|l\.?\s?l\.?\s?c"
    r"|i\.?\s?n\.?\s?c|incorporated|corp|co|a\.?\s?g|e\.?\s?u|p\.?\s?l\.?\s?c)\.?$",
    re.I,
)
FAMILY = {"brothers", "bros", "bro", "brs", "brthrs", "sons", "son", "and", "und", "in", "the", "shop", "store", "co"}
#: Words of a place, at most.
PLACE_WORDS = 3
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def one_edit(word: str) -> set[str]:
    """Everything one insertion, deletion, replacement or swap of neighbours away."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return (
        {a + b[1:] for a, b in cuts if b}
        | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        | {a + c + b[1:] for a, b in cuts if b for c in LETTERS}
        | {a + c + b for a, b in cuts for c in LETTERS}
    )


def short(word: str) -> str:
    """Without the vowels behind the first letter."""
    return word[:1] + re.sub("[aeiouy]", "", word[1:])


@lru_cache(1)
def vocabulary() -> tuple[dict[str, tuple[str, str]], dict[str, tuple[str, str]]]:
    """Word -> (what, canonical): as listed, and with one typing error in words of 4 letters or more."""
    exact: dict[str, tuple[str, str]] = {}
    for kind, words in KINDS.items():
        exact |= {w: ("kind", kind) for w in words.split()}
    exact |= {w: ("craft", w) for w in CRAFTS}
    for name, shorts in SHORT_NAMES.items():
        exact |= {w: ("first", name) for w in [name, *shorts.split()]}
    # words with vowels left out
    for kind, words in KINDS.items():
        for w in words.split():
            if len(short(w)) > 2:
                exact.setdefault(short(w), ("kind", kind))
    # kinds of two words, written in one or with a blank in the wrong place
    exact |= {"fuelstation": ("kind", "fuel"), "gardencentre": ("kind", "garden"), "cleaningservices": ("kind", "cleaning"), "printworks": ("kind", "print")}
    long = {"brothers": ("family", ""), "incorporated": ("family", "")}
    near: dict[str, tuple[str, str]] = {}
    for word, what in sorted((exact | long).items(), key=lambda x: len(x[0])):
        if len(word) >= 4:
            near |= dict.fromkeys(one_edit(word), what)
    return exact, near


def known(t: str, exact: dict, near: dict) -> tuple[str, str]:
    """What a word means: as listed, with some vowels left out, or with one typing error."""
    if t in exact:
        return exact[t]
    if len(t) < 3:
        return "", ""
    if len(short(t)) > 2 and (by_short := exact.get(short(t), ("", "")))[0] == "kind" and len(t) < 7:
        return by_short
    return near.get(t, ("", ""))


def fold(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def place_suffix(name: str) -> str | None:
    """What stands behind a dash between blanks, in lower case."""
    m = re.search(r"\s[-–]\s+([^#]+?)\s*$", fold(name))
    if not m:
        return None
    place = " ".join(re.findall(r"[a-z]+", m[1].lower()))
    exact, near = vocabulary()
    return place if place and not any(w in exact for w in place.split()) else None


def tokens_of(name: str) -> list[str]:
    """The words of a name in lower case, without branch number, legal form and what stands behind a dash."""
    s = re.sub(r"#\s*\d+|\b[Nn]o\.?\s*\d+", " ", fold(name).replace("’", "'"))
    s = re.sub(r"\bs/market\b", "supermarket", re.sub(r"\bh/ware\b", "hardware", s, flags=re.I), flags=re.I)
    s = re.sub(r"\s+", " ", s).strip()
    before = None
    while before != s:
        before, s = s, LEGAL.sub("", s).rstrip(" ,.-")
    if place_suffix(name):
        s = re.sub(r"\s[-–]\s+[^#]+$", "", s)
        before = None
        while before != s:
            before, s = s, LEGAL.sub("", s).rstrip(" ,.-")
    s = re.sub(r"'s\b|'", "", s, flags=re.I)
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s)
    return re.findall(r"[^\W\d_]+", s.lower())


def parts(tokens: list[str], places: frozenset[str]) -> tuple[str, str, str, str]:
    """(core, kind, first, craft) of the words of a name; empty where it has none. ``first`` may be one letter."""
    for n in range(PLACE_WORDS, 0, -1):  # places before or after the rest
        while len(tokens) > n and " ".join(tokens[-n:]) in places:
            tokens = tokens[:-n]
        while len(tokens) > n and " ".join(tokens[:n]) in places:
            tokens = tokens[n:]
    exact, near = vocabulary()
    if any(len(t) == 1 for t in tokens):
        for n in range(len(tokens) - 1, 1, -1):
            if known("".join(tokens[-n:]), exact, near)[0] == "kind":
                tokens = [*tokens[:-n], "".join(tokens[-n:])]
                break
    core, kind, first, craft, initials = [], "", "", "", []
    sure = {w for t in tokens if (w := exact.get(t, ("",))[0])}  # a typing error is not read over a listed word
    for t in sorted(tokens, key=lambda t: t not in exact):
        if t in FAMILY and len(tokens) > 1:
            continue
        what, meaning = known(t, exact, near)
        if t not in exact and what in sure:
            continue
        if what == "family" and len(tokens) > 1:
            continue
        if what == "kind" and not kind:
            kind = meaning
        elif what == "kind" and kind == meaning:
            continue
        elif what == "craft":
            craft = meaning[:4]
        elif what == "first" and not first:
            first = meaning
        elif len(t) == 1:
            initials.append(t)
        else:
            core.append(t)
    if not core:  # the word that looked like a kind or first name is all there is
        core = [t for t in tokens if len(t) > 1 and t not in FAMILY] or tokens
        return " ".join(core), "", "", ""
    if first:
        kind = ""
    elif initials:
        first = initials[0]
    return " ".join(sorted(core)), kind, first, craft
