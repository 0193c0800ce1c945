import random
import re

import numpy as np
import pytest

from sparkweave.llm import similar

WORDS = [f"w{i}" for i in range(400)]


def components(rows, rule):
    """Brute force: all pairs of sets, components by repeated merging."""
    sets = []
    for _, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.append({tuple(w[i : i + rule.width]) for i in range(max(1, len(w) - rule.width + 1))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rule.den * len(a & b) >= rule.num * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for g, (k, _) in zip(group, rows, strict=True):
        if k is not None:
            low[g] = min(low.get(g, k), k)
    return sorted(((k is None, k or 0), len(s), low.get(g)) for (k, _), s, g in zip(rows, sets, group, strict=True))


def corpus(seed):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(30):
        base = [rng.choice(WORDS) for _ in range(rng.choice([1, 3, 4, 6, 12, 40, 90, 200, 500]))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                own += [rng.choice(WORDS) for _ in range(len(own) // 12)]
            rows.append((at, " ".join(own)))
            at += 3
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rule", [similar.Rule(4, 85, 100), similar.Rule(5, 80, 100)])
def test_same_components_as_all_pairs(spark, rule):
    rows = corpus(rule.width) + [(90001, None), (90002, ""), (90003, "  \t"), (90004, "one"), (90005, "ONE"), (90006, "one"), (90006, "one"), (None, "one"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as cls", "1 as key", "2 as component_id")
    got = similar.join(docs, rule).collect()
    assert sorted(((r[0] is None, r[0] or 0), r[1], r[2]) for r in got) == components(rows, rule)


def test_chain_of_near_copies_is_one_component(spark):
    base = [f"u{i}" for i in range(300)]
    rows = []
    for i in range(12):
        base = [*base[10:], *(f"v{i}-{j}" for j in range(10))]
        rows.append((i, " ".join(base)))
    got = similar.join(spark.createDataFrame(rows, "doc_id long, text string"), similar.Rule(4, 85, 100)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_deduplicate_keeps_one_of_each_group_and_all_columns(spark):
    text = " ".join(WORDS[:60])
    rows = [(5, text, "a"), (2, text, "b"), (9, "another text of its own here", "c"), (9, "another text of its own here", "c"), (None, text, "d"), (11, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = similar.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["source"]) for r in kept.collect()) == [(-1, "d"), (2, "b"), (9, "c"), (11, "e")]


def test_empty_table(spark):
    assert similar.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("rule", [similar.Rule(4, 85, 100), similar.Rule(5, 80, 100), similar.Rule(3, 1, 2)])
def test_linked_sets_of_any_two_sizes_share_a_key(rule):
    members = similar.bytesnp.mix(np.arange(1, 61, dtype=np.uint64))
    first = np.concatenate([[0], np.cumsum(np.arange(1, 61))])
    # The set of size n holds the first n members.
    keys, row = similar._keys(np.concatenate([members[:n] for n in range(1, 61)]), first, rule)
    own = [set(keys[row == i].tolist()) for i in range(60)]
    lost = [(a, b) for b in range(1, 61) for a in range(1, b) if rule.den * a >= rule.num * b and not own[a - 1] & own[b - 1]]
    assert lost == []


def test_two_more_words_on_a_short_text(spark):
    rows = [(1, " ".join(WORDS[:16])), (2, " ".join(WORDS[:18])), (3, " ".join(WORDS[100:112])), (4, " ".join(WORDS[100:114]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in (similar.Rule(4, 85, 100), similar.Rule(5, 80, 100)):
        got = similar.join(docs, rule).collect()
        assert sorted(((r[0] is None, r[0] or 0), r[1], r[2]) for r in got) == components(rows, rule)
