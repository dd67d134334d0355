import random
from itertools import combinations

from tallyforge.llm.linkage_weights import fit
from tallyforge.llm import listing_match
from tallyforge.llm.listing_match import EXACT, TWO_ERRORS, listing_pairs, maker_pairs
from tallyforge.llm.listing_parts import KINDS, kind_words
from tallyforge.llm.listing_parts import attributes as attributes_of
from tallyforge.llm.name_variants import edit_similarity


def match_listings(lines, **more):
    """With the list of kinds: made cases are too few to learn from."""
    return listing_match.match_listings(lines, kinds=KINDS, **more)


def attributes(description, unit):
    return attributes_of(description, unit, kind_words(KINDS))


ARTICLES = [
    [("HUKOPIS WOOD VARNISH 0.5L BLK PREMIUM", "pc"), ("hukopis - varnish for wood - schwarz", "500 ml"), ("Hukopsi® timber varnish 50 cl black -20%", "ea")],
    [("HUKOPIS WOOD VARNISH 0.5L RED", "pc")],
    [("HUKOPIS WOOD VARNISH 5L BLK", "pc"), ("hukopis wood varnish black", "5 ltr")],
    [("butourkus ball pen Blue 12er Pack", "un"), ("BIRO, DOZEN, MODRA, BUTOURKUS®", "Stk"), ("ballpoint pen butourkus blu", "box/12")],
    [("butourkus ball pen Blue", "un"), ("butourkus biro blue", None)],
    [("Biforaim | 1.5 l | dish soap | bp376 | premium", "kos"), ("Biforaim washing-up liquid BP-376 1500ml", "x")],
    [("Biforaim | 1.5 l | dish soap | bp377", "kos")],
]


def test_articles(spark):
    rows, ids = [], []
    for article in ARTICLES:
        ids.append([])
        for d, u in article:
            ids[-1].append(len(rows) + 1)
            rows.append((len(rows) + 1, d, u, "S-1", "clash", 1))
    rows += [(900, None, None, "S-2", "", 0), (901, "", "", "S-2", "", 0), (902, "HUKOPIS WOOD VARNISH 0.5L RED", "pc", None, "", 0), (903, "word " * 20_000, "pc", "S-3", "", 0)]
    df = spark.createDataFrame(rows, "id long, description string, unit string, seller_code string, maker string, pack int")
    got = {tuple(r) for r in listing_pairs(match_listings(df)).collect()}
    want = {p for group in ids for p in combinations(group, 2)}
    assert got == want, (got - want, want - got)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, description string, unit string, seller_code string")
    assert listing_pairs(match_listings(df)).collect() == []


def test_attributes():
    assert attributes("TAPE, MASKING DOLMURVEV SPECIAL OFFER 100 CM ER 622 SCHWARZ 6ER PACK", "pc") == ("dolmurvev", "masking tape", "1 m", "black", "er622", 6)
    assert attributes("Droundeltal, wood varnish, grn", "1.25 L") == ("droundeltal", "wood varnish", "5/4 l", "green", "", 1)
    assert attributes("ROT PACK OF 12 HL-865 GROULMORVOURD EXERCISE BOOK", "pc") == ("groulmorvourd", "notebook", "", "red", "hl865", 12)


def test_weights_find_the_classes():
    counts = {(0, 0): 900, (0, 1): 50, (1, 0): 60, (1, 1): 8000}
    w = fit(counts, ((0.9, 0.1), (0.9, 0.1)))
    assert w.posterior((0, 0)) > 0.95 > 0.1 > w.posterior((1, 1))
    assert fit({}, ((0.9, 0.1), (0.9, 0.1))).score((0, 0)) > 0


def test_misspelling_that_comes_again(spark):
    """Makers one swap apart: a repeated error is linked by its share or by an equal model; two real makers are not."""
    lines = [f"Grokante storage box {n} l red" for n in range(1, 7)] + ["Grokanet storage box 5 l red", "stackable box Grokanet 5 l rot", "Grokanet storage box 5 l red"]
    lines += [f"Girvodor storage box {n} l red" for n in range(1, 5)] + [f"Grivodor storage box {n} l red" for n in range(1, 5)]
    lines += [f"Svaifoulm liquid soap {n} l" for n in range(1, 4)] + [f"Sbaifoulm liquid soap {n} l" for n in range(11, 14)]
    lines += ["Svaifoulm liquid soap 0.75 l RH856", "Sbaifoulm hand soap 75 cl RH-856"]
    df = spark.createDataFrame([(i, d, "pc", "S-1") for i, d in enumerate(lines)], "id long, description string, unit string, seller_code string")
    got = {tuple(r) for r in listing_pairs(match_listings(df)).collect()}
    assert got == {*combinations([4, 6, 7, 8], 2), (23, 24)}, got


def test_lines_without_listed_kind_or_maker(spark):
    lines = ["Hukopis garden hose 5 m green", "HUKOPIS GARDEN HOSE 5M GRN", "Hukopis hose garden 5 m green", "Hukopsi garden hose 5 m green", "Hukopis garden hose 10 m green"]
    lines += ["led bulb 10 w white AB123", "led bulb 10 w white AB123", "Vrudolm led lamp 10 W AB-123", "Vrudolm AB123 10 w", "led bulb 10 w white"]
    lines += ["led bulb 10 w red CD456", "Vrudolm led bulb 10 w white CD456", "Kestamp led bulb 10 w CD456"]
    df = spark.createDataFrame([(i, d, "pc", "S-1") for i, d in enumerate(lines)], "id long, description string, unit string, seller_code string")
    articles = match_listings(df)
    assert articles.count() == len(lines)
    got = {tuple(r) for r in listing_pairs(articles).collect()}
    assert got == {*combinations([0, 1, 2, 3], 2), *combinations([5, 6, 7, 8], 2), (10, 12)}, got


def errors_of(word, r):
    """The word with one letter left out, added, replaced, or two exchanged."""
    i = r.randrange(len(word) - 1)
    swapped = word[:i] + word[i + 1] + word[i] + word[i + 2 :]
    c = r.choice("bcdfghklmnprstvz")
    return r.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], swapped])


def test_recall_of_near_makers(spark):
    """Of planted errors, one in words of 3 letters or more and two from 6, those found by length of the word."""
    r = random.Random(5)
    words, want = set(), {}
    for length in [*range(3, 13), 14, 16, 20]:
        for _ in range(30):
            word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
            words.add(word)
            for e in (1, 2) if length >= TWO_ERRORS + 2 else (1,):
                other = errors_of(word, r) if e == 1 else errors_of(errors_of(word, r), r)
                if other != word and round((1 - edit_similarity(word, other)) * max(len(word), len(other))) == e:
                    words.add(other)
                    want.setdefault((length, e), set()).add(tuple(sorted((word, other))))
    found = {(x.a, x.b) for x in maker_pairs(spark.createDataFrame([(w,) for w in words], "maker string")).where("edits > 0").collect()}
    recall = {k: len(v & found) / len(v) for k, v in want.items()}
    assert all(x == 1 for (length, _), x in recall.items() if length <= EXACT - 1), recall
    assert min(recall.values()) >= 0.9, recall


def test_a_link_does_not_depend_on_other_lines(spark):
    """Three lines alone are linked as they are among others; every line twice gives the same clusters."""
    lines = [d for d, _ in ARTICLES[0]]
    df = spark.createDataFrame([(i, d, u, "S-1") for i, (d, u) in enumerate(ARTICLES[0])], "id long, description string, unit string, seller_code string")
    assert {tuple(x) for x in listing_pairs(match_listings(df)).collect()} == set(combinations(range(len(lines)), 2))
    rows = [(k, d, u) for k, (d, u) in enumerate(x for article in ARTICLES for x in article)]
    once = spark.createDataFrame([(k, d, u, "S-1") for k, d, u in rows], df.schema)
    twice = once.unionAll(spark.createDataFrame([(k + 100, d, u, "S-2") for k, d, u in rows], df.schema))
    clusters = lambda of: {frozenset(x.id for x in g) for g in groups(match_listings(of)).values()}
    assert {frozenset(i % 100 for i in c) for c in clusters(twice)} == clusters(once)


def groups(articles):
    out = {}
    for x in articles.collect():
        out.setdefault(x.article, []).append(x)
    return out


def test_threshold_decides(spark):
    """A maker misspelt in a line that states little is linked at the default bound and not at a strict one."""
    lines = [f"Hukopis wood varnish {c}" for c in ("black", "blk", "schwarz")] + ["Hukopsi wood varnish black"]
    df = spark.createDataFrame([(i, d, "pc", "S-1") for i, d in enumerate(lines)], "id long, description string, unit string, seller_code string")
    assert len(groups(match_listings(df))) == 1
    assert len(groups(match_listings(df, threshold=0.9999999))) > 1


def test_learned_wordings(spark):
    """Two wordings of a kind are learned from lines of one model and maker, and then hold for lines without a model."""
    makers = ["Hukopis", "Vrudolm", "Kestamp", "Plivorne", "Stakelum", "Brunifax", "Dolmetik", "Farquist"]
    lines = []
    for k, maker in enumerate(makers):
        lines += [f"{maker} garden hose AB{101 + k} 5 m green", f"{maker} garden hose 5m grn AB-{101 + k}", f"water pipe {maker} AB{101 + k} 5 m green"]
    n = len(lines)
    lines += ["Hukopis garden hose 7 m red", "HUKOPIS WATER PIPE 7M ROT", "Hukopis rain barrel 7 m red", "Hukopsi water pipe 7 m red"]
    df = spark.createDataFrame([(i, d, "pc", "S-1") for i, d in enumerate(lines)], "id long, description string, unit string, seller_code string")
    got = {tuple(r) for r in listing_pairs(listing_match.match_listings(df)).collect()}
    assert got == {p for k in range(len(makers)) for p in combinations(range(3 * k, 3 * k + 3), 2)} | {*combinations([n, n + 1, n + 3], 2)}, got


def test_a_list_of_kinds_adds_nothing_to_a_large_table(spark):
    """On 9,000 lines the learned wordings give the clusters that the list gives."""
    lines = spark.read.parquet("/root/testdata/sf0.1/line_items.parquet")
    clusters = lambda df: {frozenset(x.id for x in g) for g in groups(df).values()}
    assert clusters(listing_match.match_listings(lines)) == clusters(match_listings(lines))
