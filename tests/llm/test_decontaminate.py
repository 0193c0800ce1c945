import random
import re
from collections import Counter

from sparkweave.llm import decontaminate as d

ITEM = "A farmer named Walter sold 12 kg of apples to Harriet and kept 30 kg of pears for the long winter months ahead."
CHANGED = "Intro words come first. A farmer named Oswald sold 55 kg of apples to Miriam and kept 71 kg of pears for the long winter months ahead. More follows."
MIXED = ITEM.replace("Harriet", "Walter").replace("sold 12", "sold 30")


def found(spark, docs, items):
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "2 as hash", "3 as item")
    right = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "4 as width")
    return {(r["doc_id"], r["item_id"]): r for r in d.matches(left, right).collect()}


def test_exact_changed_and_clean(spark):
    docs = [(1, "before. " + ITEM + " after"), (2, CHANGED), (3, "nothing of the kind is said in this text at all today"), (4, None), (5, ""), (2, CHANGED)]
    got = found(spark, docs, [(7, ITEM), (8, None), (9, "")])
    assert set(got) == {(1, 7), (2, 7)}
    assert got[1, 7]["leak"] and got[2, 7]["leak"]
    assert got[1, 7]["changed_slots"] == 0 and got[2, 7]["changed_slots"] == 4


def test_inconsistent_slots_do_not_count(spark):
    # Two different names of the item became one, and so did two different numbers.
    assert (1, 7) not in found(spark, [(1, MIXED)], [(7, ITEM)])


def test_short_items_and_ties(spark):
    got = found(spark, [(1, "we saw red green blue today"), (2, "red green blue"), (3, "red blue green")], [(1, "red green blue"), (2, "red green blue")])
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)} and all(r["leak"] for r in got.values())


def test_part_of_an_item_is_no_leak(spark):
    got = found(spark, [(1, "kept saying of pears for the long while and other things that go on")], [(7, ITEM)])
    assert not any(r["leak"] for r in got.values())


def test_clean_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, "fine text stays where it is"), (None, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert [r[0] for r in d.clean(docs, items).collect()] == [2]
    assert d.matches(docs.limit(0), items).count() == 0
    assert d.matches(docs, items.limit(0)).count() == 0


def test_items_short_of_literals(spark):
    items = [(1, "Add 12 15 18 21 24 together"), (2, "12 + 7 = ?"), (3, "Add up now 1 2 3 4 5 6 7 8 9 10")]
    docs = [(1, "x add 12 15 18 21 24 together y"), (2, "add 31 32 33 34 35 together"), (3, "so 12 + 7 = 19"), (4, "so 13 + 8 = 21"), (5, "Add up now 11 12 13 14 15 16 17 18 19 20"), (6, "add 12 15 18 together")]
    got = found(spark, docs, items)
    assert {k for k, r in got.items() if r["leak"]} == {(1, 1), (2, 1), (3, 2), (5, 3)}


def test_names_that_begin_sentences(spark):
    item = "Walter ran home. Harriet ate lunch. Oswald sang songs. Miriam read books."
    other = "Petra ran home. Conrad ate lunch. Ludwig sang songs. Sophie read books."
    got = found(spark, [(1, other), (2, item), (3, other.replace("Conrad", "Petra"))], [(7, item)])
    assert got[1, 7]["leak"] and got[1, 7]["changed_slots"] == 4
    assert got[2, 7]["leak"] and got[2, 7]["changed_slots"] == 0
    assert (3, 7) not in got


def test_items_that_share_an_id(spark):
    docs = [(1, "the old grey cat sat on a mat"), (2, "seven small boats went out to sea")]
    for i in (5, None):
        got = found(spark, docs, [(i, docs[0][1]), (i, docs[1][1])])
        assert set(got) == {(1, i), (2, i)} and all(r["leak"] for r in got.values())


def test_documents_that_share_an_id(spark):
    other = "Nothing of the item stands in this text."
    for i in (1, None):
        docs = [(i, ITEM), (i, CHANGED), (i, other), (i, MIXED), (i, None), (i, ITEM)]
        left = spark.createDataFrame(docs, "doc_id long, text string")
        right = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
        got = d.matches(left, right).collect()
        assert sorted(r["changed_slots"] for r in got) == [0, 4] and all(r["leak"] and r["doc_id"] == i for r in got)
        assert sorted(str(r["text"]) for r in d.clean(left, right).collect()) == sorted([other, MIXED, "None"])


def rewritten(text, rng):
    """The text with every number and every name replaced by another, equal ones by equal ones."""
    new, out = {}, []
    for word in re.findall(r"[\w.,]+|[^\w]+", text):
        bare = word.strip(".,")
        if bare.isdigit() or bare in NAMES:
            if bare not in new:
                new[bare] = str(1000 + len(new) + rng.randrange(900) * 10) if bare.isdigit() else "Q" + "".join(rng.choice("aeiou") for _ in range(5)) + str(len(new)).translate(str.maketrans("0123456789", "bcdfghjklm"))
            word = word.replace(bare, new[bare])
        out.append(word)
    return "".join(out)


NAMES = ["Walter", "Harriet", "Oswald", "Miriam", "Petra", "Conrad"]
COMMON = "the old farm had many fields where sheep and cows went out to eat grass near a river while children sang songs about summer rain".split()


def test_equals_a_plain_search_of_planted_items(spark):
    """Items are sentences of numbers, names and plain words; texts hold them whole, rewritten, mixed up, or not at all."""
    rng = random.Random(9)

    def sentence(n):
        words = [rng.choice(COMMON) if rng.random() < 0.75 else rng.choice(NAMES) if rng.random() < 0.5 else str(rng.randrange(2, 900)) for _ in range(n)]
        return "so " + " ".join(words)

    items = [(i, sentence(rng.randrange(14, 30))) for i in range(30)]
    docs, want = [], set()
    for i in range(200):
        item, kind = rng.choice(items), i % 4
        held = {0: item[1], 1: rewritten(item[1], rng), 2: " ".join(rng.sample(item[1].split(), len(item[1].split()))), 3: sentence(25)}[kind]
        # Every id is used twice, and some rows have none.
        docs.append((None if i % 10 == 9 else i // 2, f"{sentence(20)} {held} {sentence(20)}"))
        if kind < 2:
            want.add((docs[-1], item[0]))
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n"]) for r in d.matches(left, right).where("leak").groupBy("doc_id", "item_id").count().withColumnRenamed("count", "n").collect()}
    count = Counter((doc[0], item) for doc, item in want)
    assert got == {(*k, n) for k, n in count.items()}
    kept = Counter(tuple(r) for r in d.clean(left, right).collect())
    assert kept == Counter(x for x in docs if x not in {doc for doc, _ in want})


def test_long_text(spark):
    docs = [(1, "word and word " * 100_000 + ITEM + " other words " * 100_000), (2, "7 " * 300_000)]
    got = found(spark, docs, [(7, ITEM)])
    assert set(got) == {(1, 7)} and got[1, 7]["leak"]
