import random
from itertools import combinations

from tallyforge.llm import eval_leaks
from tallyforge.llm.eval_leaks import WordHashes, leaks, longest_passage, passage_of, plain_items, words

ORDER = "Read the note and answer in one short sentence. "
POOL = [f"word{i}" for i in range(400)]


def test_planted_passages(spark):
    r = random.Random(2)
    items = [(i, ORDER + " ".join(r.choice(POOL) for _ in range(40)) + ".", None, "clash") for i in range(30)]
    items += [(100, None, None, ""), (101, "too short", None, "")]
    docs, want = [], set()
    for d in range(200):
        i, length, errors = r.randrange(30), r.choice([12, 13, 16, 24, 40]), r.choice([0, 1, 2, 9])
        ws = items[i][1][len(ORDER) :].rstrip(".").split()
        a = r.randrange(len(ws) - length + 1)
        part = ws[a : a + length]
        at = list(range(1, length - 1))
        r.shuffle(at)
        for k in sorted(at[: min(errors, 2 if errors < 9 else 12)], reverse=True):
            kind = r.choice("sdi")
            part[k : k + 1] = {"s": ["other"], "d": [], "i": [part[k], "more"]}[kind]
        text = " ".join(part)
        text = r.choice([str.upper, str, lambda x: x.replace(" ", ", "), lambda x: x.replace(" ", " \n> "), lambda x: "<p>" + x.replace(" ", " ​") + "</p>"])(text)
        docs.append((d, "before that " * r.randrange(60) + text + " after it " * r.randrange(60), i))
        if errors < 9 and min(errors, 2) * 8 <= length:
            want.add((d, i))
    docs += [(500, None, 0), (501, "", 0), (502, ORDER, 0), (503, "x " * 50_000 + items[3][1], 0), (503, items[3][1], 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    got = [(x.doc_id, x.item_id) for x in leaks(df, spark.createDataFrame(items, "item_id long, text string, task string, words string")).collect()]
    assert want <= set(got)
    # two errors at the edge of what is allowed may hold a shorter passage still
    assert all(docs[d][2] == i for d, i in got if d < 200)
    assert got.count((503, 3)) == 2 and not {500, 501, 502} & {d for d, _ in got}


def test_passage_length():
    assert longest_passage([0] * 11) == 11
    assert longest_passage([0] * 6 + [1] + [0] * 6) == 13
    assert longest_passage([0] * 5 + [1] + [0] * 4) == 9 or longest_passage([0] * 5 + [1] + [0] * 4) == 10
    assert longest_passage([0] * 6 + [1, 1] + [0] * 6) == 6
    assert longest_passage([]) == 0


def test_words():
    assert words('Led-\n> ger <b>4</b>5, "​８７​ cra­tes" 350.11') == ["ledger", "45", "87", "crates", "35011"]
    assert words(None) == words("") == words("— … !") == []


def test_shared_opening_is_no_passage(spark):
    rows = [(i, ORDER + f"alpha{i} beta{i}") for i in range(6)] + [(9, None), (10, "")]
    items = plain_items(spark.createDataFrame(rows, "item_id long, text string")).collect()
    assert sorted(x.plain for x in items) == [f"alpha{i} beta{i}" for i in range(6)]
    docs = spark.createDataFrame([(1, ORDER * 3)], "doc_id long, text string")
    assert leaks(docs, spark.createDataFrame(rows, "item_id long, text string")).collect() == []


def test_large_tables_take_the_other_ways(spark, monkeypatch):
    """Shuffled seeds, shuffled candidates and items in parts give the same rows."""
    r = random.Random(3)
    items = [(i, " ".join([*(r.choice(POOL) for _ in range(20)), f"{i + 1},50", f"{i + 2},75"])) for i in range(20)]
    docs = [(d, "x " + items[d % 20][1].replace(",", " ") + " y") for d in range(40)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d, d % 20) for d in range(40))
    assert sorted((x.doc_id, x.item_id) for x in leaks(df, it).collect()) == want
    for name, value in (("SEEDS_SENT", 0), ("CANDIDATES_SENT", 0), ("JOINED_SENT", 11)):
        monkeypatch.setattr(eval_leaks, name, value)
    assert sorted((x.doc_id, x.item_id) for x in leaks(df, it).collect()) == want


def test_two_seeds_are_always_left():
    """Every way to damage one word in eight of a passage leaves two runs of five words."""
    hashes = WordHashes()
    for length in range(12, 33):
        text = [f"w{k}" for k in range(length)]
        seeds = set(hashes.seeds(text).tolist())
        worst = length
        for at in combinations(range(length), length // 8):
            damaged = ["damaged" if k in at else w for k, w in enumerate(text)]
            # the shortest passages matter: a longer one holds them
            worst = min(worst, len(seeds & set(hashes.seeds(damaged).tolist())))
            if length > 24:
                break
        assert worst >= 2, length


def test_text_of_many_items(spark):
    """A text under many item_ids is found for each, its only sentence being no instruction; so is a passage of many texts."""
    text = " ".join(f"common{k}" for k in range(14)) + "."
    items = [(i, text if i % 2 else text.upper()) for i in range(12)]
    items += [(100 + i, f"Opening of its own {i}. " + " ".join(f"shared{k}" for k in range(12)) + f" end{i}") for i in range(20)]
    shared = " ".join(f"shared{k}" if k != 5 else "damaged" for k in range(12))
    docs = [(1, "before " * 5 + text), (2, "before " + shared + " after"), (3, " ".join(f"shared{k}" for k in range(6)))]
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    assert got == {(1, i) for i in range(12)} | {(2, 100 + i) for i in range(20)}, got


def test_damaged_end_words():
    text = [f"item{k}" for k in range(14)]
    hashes = WordHashes()
    passage = lambda ws, item=text: passage_of(item, ws, hashes.seeds(item), hashes.seeds(ws))
    assert passage(["x", *text[1:12], "y"]) == 12
    assert passage([*text[:11], "damaged"]) == 12
    assert passage(["x", *text[1:11], "y"]) == 0
    # an item of eleven words has no passage
    assert passage(["x", *text[:11], "y"], text[:11]) == 0
