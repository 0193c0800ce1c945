import re

from sparkweave.llm import licences


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        hit = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += hit
        labels |= {label} if hit else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = [
    "Licensed under CC BY-NC 4.0.", "Released under the MIT License. the mit\n-license", "This work is licensed under the GNU General Public License, version 3 or later",
    None, "", "ÉMIT license mitlicense", "acc by cc  byé cc_by", "Apache License, Version 2.0; apache license", "x" * 50000 + " mit license", "All rights reserved.", "cc", "by cc by", "license", "0mit license",
]


def test_base_columns_equal_a_word_scan(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(1, TEXTS[1])], "doc_id long, text string").selectExpr("*", "'x' as labels", "9 as score", "1 as other")
    for r in licences.scan(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(r["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and r["other"] == 1


def test_priority_and_containment():
    def labels(text):
        data = text.lower().encode()
        return [r.label for _, _, r in licences.detect(data, [r for r in licences.rules() if r.keyword in data])]

    assert labels("GNU General Public License version 2 or later") == ["gpl-2.0-or-later"]
    assert labels("the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("GNU Lesser General Public License 2.1") == ["lgpl-2.1"]
    assert labels("Mozilla Public License, v. 2.0") == ["mpl-2.0"]
    assert labels("creativecommons.org/licenses/by-nc-sa/4.0") == ["cc-by-nc-sa-4.0"]
    assert labels("SPDX-License-Identifier: Apache-2.0") == ["apache-2.0"]
    assert labels("nothing to see") == []
    assert len(licences.rules()) > 200


def test_gates_lose_nothing(spark):
    """A text's detections are the same when every rule is tried on it."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in licences.scan(docs, spans=True).collect():
        full = licences.detect((r["text"] or "").lower().encode(), list(licences.rules()))
        assert [(s["start"], s["stop"], s["label"]) for s in r["spans"]] == [(a, b, x.label) for a, b, x in full]


def test_empty_table(spark):
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


POSITIVE = {
    "unauthorized": "Unauthorized copying of this file, via any medium is strictly prohibited",
    "neither": "Neither the name of the copyright holder nor the names of its contributors",
}


def plain(pattern):
    """A text that a written rule stands for: optional parts left out, the first of alternatives taken."""
    import re

    text = pattern.replace("licen[cs]e", "license").replace("[^.]{1,80}?", "acme").replace(".{1,80}?", "acme").replace("f[a-z*]+", "f***")
    text = re.sub(r"\((?:\?:)?[^()]*\)\?", "", text)
    text = re.sub(r"\(\?:([^()|]*)\|?[^()]*\)", r"\1", text)
    return text.replace("d?", "d").replace("-?", "-").replace("beer-ware", "beer-ware")


def test_every_written_rule_has_a_text_that_it_finds():
    for label, text, _, _ in licences._SENTENCES:
        sample = next((v for k, v in POSITIVE.items() if text.startswith(k)), plain(text)).lower().encode()
        tried = [r for r in licences.rules() if r.keyword in sample]
        assert any(r.label == label and r.pattern.search(sample) for r in tried), (label, sample)
    for label, title in licences._PLAIN.items():
        sample = ("the " + plain(title) + ", see").encode()
        assert any(r.label == label and r.pattern.search(sample) for r in licences.rules() if r.keyword in sample), (label, sample)
    for rules in (licences._GNU, licences._VERSIONED):
        for label, (title, _, versions) in rules.items():
            for v in versions:
                sample = f"under the {plain(title)}, version {v}.".encode()
                assert any(r.label == f"{label}-{v}" and r.pattern.search(sample) for r in licences.rules() if r.keyword in sample), (label, v, sample)


def test_suppression_equals_a_scan_of_all_pairs():
    import random
    import re

    rng = random.Random(6)
    data = bytes(rng.choice(b"ab ") for _ in range(400))
    rules = [licences.Rule(f"r{i}", re.compile(p), b"a", 1 + i % 3) for i, p in enumerate([b"a+", b"ab", b"b a", b"[ab]+", b"a.{3}", b"b+ "])]
    found = [(m.start(), m.end(), r) for r in rules for m in r.pattern.finditer(data)]
    kept = []
    for s, e, r in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
        if not any(a <= s and e <= b for a, b, _ in kept):
            kept.append((s, e, r))
    assert licences.detect(data, rules) == sorted(kept, key=lambda d: (d[0], d[1]))


def test_many_notices_in_one_text(spark):
    text = "released under the mit license, all rights reserved. " * 30_000
    got = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_base"] == 30_000 and got["last_word"] > got["first_word"]
