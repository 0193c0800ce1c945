import math
import re
from collections import Counter

import numpy as np

from sparkweave.llm import queries, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=10):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n, length = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, tf, own in held:
            m = 100 - 90 + (90 * own * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n", "3 as query", "4 as item", "5 as score")
    return left, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "6 as query", "7 as term", "8 as doc_id")


def some(seed, n):
    rng = np.random.default_rng(seed)
    words = [*(f"w{i}" for i in range(60)), "Äpfel", "ÄPFEL", "naïve", "x", "7", "日本"]
    chance = 1 / np.arange(1, len(words) + 1)
    return [" ".join(rng.choice(words, rng.integers(0, 40), p=chance / chance.sum())) + "." for _ in range(n)]


def test_equals_the_definition(spark):
    texts = some(1, 700)
    docs = [(int(i * 9973 % 70001) - 900, t) for i, t in enumerate(texts)]
    docs += [(5, texts[3])] * 4 + [(None, texts[3]), (None, "w1 w1 x"), (6, None), (7, ""), (8, "..."), (9, "x " * 30000 + "w9"), (2**40, texts[4])]
    items = [(1, texts[3]), (1, "W1, X! w1"), (2, None), (3, ""), (4, "unheard"), (None, texts[5]), (5, " ".join(texts[:50]))]
    got = sorted((tuple(r) for r in ranked.search(*frames(spark, docs, items)).collect()), key=repr)
    want = brute(docs, items)
    # Rows of one id and one score may trade places.
    assert got == want and len(want) == 40


def test_batches_give_the_same(spark):
    docs = list(enumerate(some(2, 300)))
    items = [(i, t) for i, t in enumerate(some(3, 40))]
    got = ranked.search(*frames(spark, docs, items), k=3, batch_terms=100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert ranked.search(*frames(spark, [], [(1, "a")])).count() == 0
    got = ranked.search(*frames(spark, [(1, "a")], []))
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked.search(*frames(spark, [(1, "a b"), (2, "b")], [(1, "zz")])).count() == 0


def test_windows_are_cut_where_ids_repeat():
    batch = ranked.Batch.of(np.array([0, 0, 4]), np.array([10, 11, 11]), np.array([3, 2, 2]), 9, 90)
    rows = [(i // 5, 10, [10, 11] if i % 3 else [11], [1 + i % 2, 2] if i % 3 else [4]) for i in range(50)]
    pack = lambda v, kind: np.array(v, kind).tobytes()
    whole, cut = ranked.Best(batch, 10), ranked.Best(batch, 10)
    for best, step in ((whole, 50), (cut, 7)):
        for a in range(0, 50, step):
            part = rows[a : a + step]
            best.window([r[0] for r in part], np.array([r[1] for r in part]), [pack(r[2], np.int64) for r in part], [pack(r[3], np.int32) for r in part])
    assert sorted(whole.rows()) == sorted(cut.rows()) and len(list(whole.rows())) == 20


def test_query_equals_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op13_windowed_search(spark, sf)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)
