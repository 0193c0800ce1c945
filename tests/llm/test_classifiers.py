import random

import numpy as np
import pytest

from sparkweave.llm import ftrl, langcnn, quality, toxicity

LANGS = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["über", "straße", "größe", "mädchen"], "zz": ["qoqo", "wawa", "zuzu", "jiji"]}
SCHEMA = "doc_id long, text string, lang string, score string"


def language_rows(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(LANGS[k]) for _ in range(rng.randint(3, 80))), k, "old") for i in range(n) for k in [rng.choice(list(LANGS))]]


def test_language(spark):
    net = langcnn.fit(spark.createDataFrame([*language_rows(150, 1), (999, "no label", None, "")], SCHEMA))
    rows = [*language_rows(60, 2), (501, None, "xx", ""), (502, "", "xx", ""), (503, "123 !!", "yy", ""), (504, "alpha " * 20000, "xx", ""), (504, "alpha", "xx", "")]
    got = langcnn.predict(spark.createDataFrame(rows, SCHEMA), net).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == ("und" if r["doc_id"] in (501, 502, 503) else r["lang"]) for r in got)


def test_language_whole_text_counts(spark):
    net = langcnn.fit(spark.createDataFrame(language_rows(150, 1), SCHEMA))
    text = "alpha beta " * 40 + "wawa zuzu qoqo " * 400
    assert langcnn.predict(spark.createDataFrame([(1, text, None, "")], SCHEMA), net).first()["lang_pred"] == "zz"


def test_language_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    net = langcnn.fit(none)
    assert langcnn.predict(none, net).count() == 0
    assert langcnn.predict(spark.createDataFrame([(1, "abc", None, "")], SCHEMA), net).count() == 1


def test_training_pieces_cover_whole_texts(spark, monkeypatch):
    """Below the bound every piece of every labelled text is learned once; above it about as many as the bound, from all places."""
    taught = []
    monkeypatch.setattr(langcnn, "train", lambda texts, languages: taught.extend(zip(texts, languages, strict=True)))
    text = "".join(f"{i:05d}" for i in range(10_000))
    rows = [(1, text[:1030], "aa", ""), (1, text[:1030], "aa", ""), (None, text[1000:1310], "bb", ""), (2, None, "aa", ""), (3, "", "aa", ""), (4, "none", None, "")]
    langcnn.fit(spark.createDataFrame(rows, SCHEMA))
    assert sorted(taught) == sorted([(text[i : min(i + 200, 1030)], "aa") for i in range(0, 1030, 200)] + [(text[1000:1200], "bb"), (text[1200:1310], "bb")])
    taught.clear()
    monkeypatch.setattr(langcnn, "PIECES_PER_LANGUAGE", 50)
    langcnn.fit(spark.createDataFrame([(1, text, "aa", ""), (2, "xyz", "bb", "")], SCHEMA))
    long = [int(t[:5]) for t, x in taught if x == "aa"]
    assert 25 <= len(long) <= 80 and min(long) < 2_000 and max(long) > 8_000 and ("xyz", "bb") in taught


def test_convolution_equals_a_loop():
    net = langcnn.train(["abc def", "ghi"], ["a", "b"], epochs=1)
    kinds = np.random.default_rng(0).integers(0, langcnn.KINDS, (3, langcnn.WINDOW))
    want = [[max(sum(t[j, row[p + j], f] for j in range(w)) for p in range(langcnn.WINDOW - w + 1)) for w, t in zip(langcnn.WIDTHS, net.tables, strict=True) for f in range(langcnn.FILTERS)] for row in kinds]
    assert np.allclose(net.features(kinds), np.maximum(np.array(want) + net.bias, 0), atol=1e-4)


def test_quality(spark):
    rng = random.Random(3)
    good = [(i, " ".join(rng.choice(["the", "of", "house", "river", "green"]) + str(rng.randint(0, 99)) * 0 for _ in range(60)), 1) for i in range(80)]
    bad = [(1000 + i, " ".join(f"{rng.choice(['a', 'bb', 'ccc'])}###" for _ in range(60)), 0) for i in range(80)]
    rows = good + bad + [(5000, None, None), (5001, "", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").selectExpr("*", "7 as at", "'s' as score")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3] + [(1, 1), (None, 0), (77777, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (y == 1) for i, _, y in rows if y is not None and i % 3 == 0]) > 0.95
    assert got[5000] == got[5001]


def test_without_labels_all_score_alike(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    weights = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, weights).collect()} == {0.5}
    assert quality.score(docs.limit(0), weights).count() == 0


def test_sparse_score_equals_a_dot_product():
    w = np.random.default_rng(0).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    buf = np.frombuffer(b"The cat cat sat!! the", np.uint8)
    at, value, first = quality.extract(buf, np.array([0, len(buf)]))
    assert first.tolist() == [0, len(at)]
    assert np.isclose(sum(w[a] * v for a, v in zip(at, value, strict=True)), np.dot(w[at], value), atol=1e-4)
    assert ftrl.sigmoid(np.zeros(1))[0] == 0.5


def test_deobfuscation():
    words = " the cat sat on an idiot and a stupid moron while we wait here for the trash man and the scum of a clown " * 50
    kind = toxicity._KIND[np.frombuffer(words.encode(), np.uint8)]
    k = toxicity.KINDS
    counts = np.bincount((kind[:-2] * k + kind[1:-1]) * k + kind[2:], minlength=k**3).reshape(k, k, k).astype(float)
    decoder = toxicity.Decoder(toxicity.character_model(counts))
    for disguised, plain in ((b"1d1ot", b"idiot"), (b"m0r0n", b"moron"), (b"s t u p i d", b"stupid"), (b"stuuuupid", b"stupid"), (b"tr@sh", b"trash"), (b"s.c.u.m", b"scum"), (b"cat", b"cat")):
        assert decoder.restore(disguised) == plain
    text = "You 1d1ot! m0r0n s t u p i d cat".encode()
    out, offs = toxicity.restore(np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)]), decoder)
    assert out.tobytes()[: offs[1]] == b"you idiot! moron stupid cat" and out.tobytes()[offs[1] :] == out.tobytes()[: offs[1]]


def small_decoder():
    words = " you are a worthless idiot and a loser while we wait here for the trash man and the scum of a clown who sat on the cat " * 50
    kind = toxicity._KIND[np.frombuffer(words.encode(), np.uint8)]
    k = toxicity.KINDS
    counts = np.bincount((kind[:-2] * k + kind[1:-1]) * k + kind[2:], minlength=k**3).reshape(k, k, k).astype(float)
    return toxicity.Decoder(toxicity.character_model(counts))


def restored(text):
    raw = text.encode()
    return toxicity.restore(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), small_decoder())[0].tobytes().decode()


def test_long_spans_are_decoded():
    sentence = "you are a worthless idiot and a loser while we wait here for the trash man and the scum"
    assert {"worthless", "idiot", "loser", "trash", "scum"} <= set(restored(" ".join(sentence.replace(" ", ""))).split())
    assert restored("  ".join(" ".join(w) for w in sentence.split())) == sentence
    assert restored("-".join(["1d1ot", "l0ser"] * 20)).count("idiot") == 20


def test_signs_at_the_ends_of_words():
    assert restored("an !diot, |oser and +rash; worthle$$ idio7") == "an idiot, loser and trash; worthless idiot"
    assert restored("the cat! (sat on) the *man* | while!!! we+ wait") == "the cat! (sat on) the *man* | while!!! we+ wait"


@pytest.mark.parametrize("text", ["scores 3 5 7 9 1", "0 1 5 5 9", "mp3", "3rd", "h2o", "1st", "v1.0", "a+b", "call 555 1 2 3 4", "a 1 b 2 c 3", "p2p and b2b", "4th of 2nd", "x = 3 + 4", "| a | 1 | b | 2 |", "covid-19", "1,000.50", "3.14", "10:30 am", "u2", "f(x)=x2", "a|b"])
def test_numbers_stay(text):
    assert restored(text) == text


def test_only_known_words_are_read():
    from sparkweave.llm import bytesnp, filters

    known = np.zeros(filters.BITS // 8, np.uint8)
    for word in (b"idiot", b"trash", b"you", b"stupid"):
        place = bytesnp.word_hash(word) % filters.BITS
        known[place >> 3] |= 1 << (place & 7)
    decoder = small_decoder()
    decoder.known = known
    raw = b"1d1ot +rash l0ser well-known y o u s t u p i d sooo stuuupid win10s"
    got = toxicity.restore(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), decoder)[0].tobytes()
    assert got.startswith(b"idiot trash l0ser well-known ") and got.endswith(b" sooo stupid win10s")


def test_a_word_hash_is_that_of_its_span():
    from sparkweave.llm import bytesnp

    raw = np.frombuffer("one zwölf 3".encode(), np.uint8)
    spans = bytesnp.span_hash(raw, np.array([0, 4, 11]), np.array([3, 10, 12]))
    assert spans.tolist() == [bytesnp.word_hash(w) for w in (b"one", "zwölf".encode(), b"3")]


def test_toxicity(spark):
    rng = random.Random(8)
    plain = [f"{a}{b}" for a in ["ter", "mon", "lin", "sar", "pol"] for b in ["ona", "ity", "and", "est", "ole"]]
    rows = []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["vilegrump", "nastyblob"]))
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([*((i, t) for i, t, _ in rows), (900, None), (901, ""), (902, "teriti v1legrump monona")], "doc_id long, text string").selectExpr("*", "1 as value", "2 as score")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert np.mean([(got[i] >= 0.5) == (y == 1) for i, _, y in rows if i % 4 == 0]) > 0.97
    assert got[900] == got[901] < 0.5 <= got[902]


def test_labels_of_documents_kept_out_decide_nothing(spark):
    rows = [(i, f"good word{i % 5} house" if i % 2 else f"bad thing{i % 5} ###") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where("doc_id % 3 <> 0")

    def labels(flip):
        return spark.createDataFrame([(i, i % 2 if i % 3 or not flip else 1) for i in range(60)], "doc_id long, quality int")

    assert (quality.fit(train, labels(False)) == quality.fit(train, labels(True))).all()
    one, two = (toxicity.fit(train, labels(f), "quality")[0] for f in (False, True))
    assert (one == two).all()


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(6, 3, replace=False)), rng.random(3)) for _ in range(20)]
    y, weights = rng.integers(0, 2, 20).astype(float), rng.random(20) + 0.5
    alpha, l1, l2 = 0.3, 0.1, 0.2
    z, n = [0.0] * 7, [0.0] * 7

    def w(i):
        small = abs(z[i]) <= l1 and i < 6
        return 0.0 if small else -(z[i] - (l1 if z[i] > 0 else -l1 if z[i] < 0 else 0) * (i < 6)) / ((1 + n[i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(3)
    for _ in range(2):
        for r in order.permutation(20):
            x = [*zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True), (6, 1.0)]
            p = 1 / (1 + np.exp(-sum(w(i) * v for i, v in x)))
            now = {i: w(i) for i, _ in x}
            for i, v in x:
                g = (p - y[r]) * weights[r] * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * now[i]
                n[i] += g * g
    assert np.allclose(ftrl.train(rows, y, weights, 6, alpha, l1, l2, epochs=2), [w(i) for i in range(7)], atol=1e-5)


def test_viterbi_equals_all_readings():
    from itertools import product

    model = toxicity.character_model(np.random.default_rng(4).random((toxicity.KINDS,) * 3) * 50)
    decoder = toxicity.Decoder(model)
    for span in (b"s7up1d", b"i.d.i.o.t", b"h a t e", b"looo5er", b"cla55", b"!d10t", b"a$$"):

        def cost(parts):
            x = y = 0
            total = sum(c for _, c in parts)
            for byte in b"".join(s for s, _ in parts) + b" ":
                k = int(toxicity._KIND[byte])
                total += model[x, y, k]
                x, y = y, k
            return total

        every = list(product(*decoder.lattice(span)))
        got = b"".join(decoder.best(decoder.lattice(span)))
        best = min(map(cost, every))
        assert any(b"".join(s for s, _ in p) == got and abs(cost(p) - best) < 1e-9 for p in every)


def test_character_counts_do_not_depend_on_partitions(spark):
    rows = [(f"text {i} of words" if i % 4 else None,) for i in range(40)]
    one, many = (toxicity.character_counts(spark.createDataFrame(rows, "text string").repartition(n)) for n in (1, 7))
    assert (one == many).all()


def test_columns_of_any_name_pass(spark):
    odd = spark.createDataFrame([(1, "alpha beta", "xx")], "doc_id long, text string, lang string").selectExpr("*", "1 as __letter", "named_struct('content-type', 2) as s")
    from sparkweave.llm import bpe, licences  # noqa: F401

    net = langcnn.train(["abc def", "ghi"], ["a", "b"], epochs=1)
    assert langcnn.predict(odd, net).select("s.`content-type`", "__letter").first() == (2, 1)
    assert licences.scan(odd).select("s.`content-type`").first() == (2,)
    assert ftrl.score(odd, np.zeros((1 << quality.BITS) + 1, np.float32), quality.extract).select("s.`content-type`").first() == (2,)


def test_a_language_of_rows_without_ids_is_sampled(spark):
    rows = [(None, f"alpha beta {i}", "xx") for i in range(3000)] + [(None, "same", "yy")] * 3000
    from pyspark.sql import functions as F

    from sparkweave.llm.sampling import per_value

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = per_value(docs, "lang", 100, F.coalesce(F.col("doc_id").cast("string"), "text")).distinct().groupBy("lang").count().collect()
    assert all(r["count"] < 200 for r in got)


def test_all_labelled_documents_teach(spark, monkeypatch):
    from sparkweave.llm import bytesnp, filters

    rows = [(i, f"term{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)} house " + ("vilegrump" if i % 10 == 0 else "river"), int(i % 10 == 0)) for i in range(2600)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int")
    monkeypatch.setattr(ftrl, "ROWS", 400)
    weights, reader = toxicity.fit(docs, labels)
    words = np.array([bytesnp.word_hash(t.split()[0].encode()) for _, t, _ in rows], np.uint64)
    assert filters.passes(reader.known, words).all()
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, (weights, reader)).collect()}
    assert all((got[i] >= 0.5) == (y == 1) for i, _, y in rows)
    assert (toxicity.fit(docs.repartition(7), labels)[0] == weights).all()


def test_filters_grow_with_their_hashes(spark):
    from sparkweave.llm import filters

    hashes = spark.range(3 * filters.BITS // 16).selectExpr("xxhash64(id) AS term")
    bits = filters.bit_filter(hashes)
    assert len(bits) > filters.BITS // 8
    assert filters.passes(bits, np.array([r[0] for r in hashes.limit(1000).collect()], np.int64).view(np.uint64)).all()
    assert filters.passes(bits, np.random.default_rng(0).integers(0, 1 << 63, 10000, dtype=np.uint64)).mean() < 0.2
