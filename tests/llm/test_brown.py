import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkweave.llm import brown, bytesnp


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


TRAIN = [(i, t) for i, t in enumerate(["The cat sat", "the dog sat on the mat", "A cat and a dog", None, "", "the the the"] * 5)]
TEST = [(100, "the cat sat on a zebra"), (101, None), (102, "Zebra zebra"), (103, "THE cat"), (103, "THE cat"), (None, "dog")]


def test_base_scores_equal_a_count(spark):
    train = spark.createDataFrame(TRAIN, "doc_id long, text string")
    docs = spark.createDataFrame(TEST, "doc_id long, text string").selectExpr("*", "1 as row", "2 as k", "3 as word")
    # A small table of hot words sends the others through the join.
    model, counts = brown.fit(train, classes=3, vocab=3, hot=4)
    seen = Counter(w for _, t in TRAIN for w in tokens(t))
    seen["\n"] = len(TRAIN)
    n, v = sum(seen.values()), len(seen)
    got = brown.score(docs, model, counts).collect()
    assert len(got) == len(TEST)
    texts = sorted(TEST, key=lambda r: (r[0] or 0, r[1] or ""))
    for r, (_, t) in zip(sorted(got, key=lambda r: (r["doc_id"] or 0)), texts, strict=True):
        words = [*tokens(t), "\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in seen for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert r["score"] < 0


def test_the_model_is_a_distribution(spark):
    model, counts = brown.fit(spark.createDataFrame(TRAIN, "doc_id long, text string"), classes=3, vocab=3, hot=4)
    assert (10 ** model.move).sum(1) == pytest.approx(1)
    kept = sorted({w for _, t in TRAIN for w in tokens(t)})
    rows = [(i, w) for i, w in enumerate([*kept, "unseen"])]
    got = {r["doc_id"]: r["score"] for r in brown.score(spark.createDataFrame(rows, "doc_id long, text string"), model, counts).collect()}
    # One word, then the end: summed over all words and one unseen word, less what goes elsewhere, this is P(any word) steps.
    total = sum(10**s for s in got.values())
    assert 0 < total <= 1 + 1e-9


def test_classes_beat_single_words_on_patterned_text(spark):
    rows = [(i, " ".join(f"a{(i + j) % 7} b{(i * j) % 7}" for j in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = brown.fit(docs, classes=4, vocab=50, hot=50)
    got = brown.score(docs, model, counts).selectExpr("avg(score) s", "avg(base_score) b").first()
    assert got["s"] > got["b"]


def test_empty_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model, counts = brown.fit(none)
    got = brown.score(spark.createDataFrame([(1, "x y")], "doc_id long, text string"), model, counts).collect()
    assert got[0]["n_known"] == 0 and got[0]["train_tokens"] == 0
    assert brown.score(none, model, counts).count() == 0


def named(words):
    buf, offs = bytesnp.flat(pa.array(words))
    return bytesnp.span_hash(buf, offs[:-1], offs[1:]).view(np.int64).tolist()


def patterned(n, seed=1):
    rng = random.Random(seed)
    kinds = [[f"n{i}" for i in range(25)], [f"v{i}" for i in range(12)], [f"a{i}" for i in range(40)]]
    return [(i, " ".join(rng.choice(kinds[(j + i) % 3]) for j in range(rng.randint(0, 12)))) for i in range(n)]


def test_scores_and_bigrams_equal_a_plain_count(spark):
    rows = patterned(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    k = 4
    model, known = brown.fit(docs, classes=k, vocab=8, hot=20)
    words = sorted({w for _, t in rows for w in tokens(t)})
    table = {r["word"]: (r["n"], r["cls"]) for r in known.collect()}
    seen = Counter(w for _, t in rows for w in tokens(t))
    of = {}
    for w, h in zip(words, named(words), strict=True):
        assert table[h][0] == seen[w] and (table[h][1] is None) == (seen[w] == 1)
        of[w] = k if table[h][1] is None else table[h][1]
    want = np.zeros((k + 2, k + 2))
    for _, t in rows:
        path = [k + 1, *(of[w] for w in tokens(t)), k + 1]
        for a, b in zip(path, path[1:], strict=False):
            want[a, b] += 1
    got = brown.class_bigrams(docs, model.hot, model.word_class, known.where("cls is not null").select("word", "cls"), k)
    assert (got == want).all() and 10 <= len(model.hot) <= 30
    size = Counter()
    for w, n in seen.items():
        size[of[w]] += n
    rare = sum(1 for w in words if of[w] == k)
    test = [(900, "n1 v1 a1 unseen words a2"), (901, None), (902, "unseen"), (903, "n1"), *rows[:20]]
    for r in brown.score(spark.createDataFrame(test, "doc_id long, text string"), model, known).collect():
        t = tokens(dict(test)[r["doc_id"]])
        path = [k + 1, *(of.get(w, k) for w in t), k + 1]
        total = sum(model.move[a, b] for a, b in zip(path, path[1:], strict=False))
        for w in t:
            c = of.get(w, k)
            total += math.log10(seen[w] / size[c]) if c < k else math.log10((seen[w] + 0.1) / (size[k] + 0.1 * (rare + 1)))
        assert r["score"] == pytest.approx(total)


def test_gain_of_an_exchange_is_the_likelihood_gained():
    rng = np.random.default_rng(2)
    k, v = 3, 9
    classes = np.concatenate([rng.integers(0, k, v), [k, k + 1]])
    bigram = rng.integers(0, 20, (v + 2, v + 2)).astype(float)

    def sides(c):
        member = np.eye(k + 2)[c]
        return bigram @ member, bigram.T @ member

    for w in range(v):
        if bigram[w, w]:
            bigram[w, w] = 0
        movable = np.arange(v + 2) == w
        values = {}
        for c in range(k):
            moved = classes.copy()
            moved[w] = c
            values[c] = brown.likelihood(sides(moved)[0], moved)
        new = brown.exchange(*sides(classes), classes, movable, rest=1.0)
        assert values[new[w]] >= values[classes[w]] - 1e-9


def test_rounds_never_lower_the_likelihood(spark):
    docs = spark.createDataFrame(patterned(200, 3), "doc_id long, text string")
    counts = [h for h in sorted(np.array(named([*(f"n{i}" for i in range(25)), *(f"v{i}" for i in range(12))])).view(np.uint64).tolist())]
    inner = np.array(counts, np.uint64)
    pairs = brown.bigrams(docs, inner)
    start = np.concatenate([np.arange(len(inner)) % 4, [4, 5]])
    now, table = brown._cluster(pairs, start, np.arange(len(start)) < len(inner))
    assert brown.likelihood(brown._contexts(pairs, now)[0], now) > brown.likelihood(brown._contexts(pairs, start)[0], start)
    assert table.sum() == sum(len(tokens(t)) + 1 for _, t in patterned(200, 3))
