import hashlib
import math
import random
import re

import pytest

from sparkweave.llm import queries, secrets

RULES = {"assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile("[0-9a-f]+"), 0, 16)}


def base(text):
    found = []
    for k, (kind, (rule, group, least)) in enumerate(RULES.items()):
        found += [(m.start(), k, m.end(), kind) for m in rule.finditer(text or "") if len(m[group]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def check(rows):
    for r in rows:
        want = base(r["text"])
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("guess")] == want and r["base_"] == ",".join(want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234567", "deadbeef", "0123456789abcdef", "xyz", ".", "é", "日", "ſecret", "toKen", "==", "\n", "-", "a_b/c+d.e"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert secrets._listed(secrets.base_spans(text)) == ",".join(base(text)), text


@pytest.mark.parametrize("text", ["password=x.token: abcdefghijklmnop", "token=" + "a" * 11, "token=" + "a" * 12, "AKIA" + "B" * 13, "AKIA" + "B" * 14, "f" * 15, "f" * 16, "é" * 9 + "secret: 'aaaaaaaaaaaa'"])
def test_limits(text):
    assert secrets._listed(secrets.base_spans(text)) == ",".join(base(text))


WORDS = {"correct": 4.0, "horse": 3.5, "the": 1.2, "orse": 5.0}


def cheapest(guess, value):
    """All segmentations, one by one."""
    by = {}
    for i, j, cost in guess.segments(value):
        by.setdefault(i, []).append((j, cost))

    def walk(i):
        return 0.0 if i == len(value) else min((cost + walk(j) for j, cost in by.get(i, [])), default=math.inf)

    return walk(0)


@pytest.mark.parametrize("value", ["", "a", "horse", "c0rrecth", "Horse1999", "12/05/1988", "aaaaaa", "abcabcabc", "qwerty", "zxcvfr", "abcdef9", "x9!Kq2#z", "p@ssword", "Admin123", "2021-11-03", "éaé日", "the the1", "7tfc6yhn"])
def test_cost_is_the_least_of_all_segmentations(value):
    guess = secrets.Guess(WORDS)
    assert guess.cost(value) == pytest.approx(cheapest(guess, value))


def test_patterns_are_cheaper_than_brute_force():
    guess = secrets.Guess(WORDS)
    brute = lambda v: sum(map(secrets._brute, v))
    for value in ("c0rrecthorse", "HORSE", "correct1999", "1qaz2wsx", "zxcvbnm", "abcdefgh", "xkxkxkxk", "12051988", "P@ssw0rd"):
        assert guess.cost(value) < 0.8 * brute(value), value
    for value in ("x9Kq2zR8vW", "d4e71e33b54f40bc277a"):
        assert guess.cost(value) > 0.8 * brute(value), value
    assert guess.cost("P@ssw0rd") < secrets.COSTLY < guess.cost("x9Kq2zR8vW")


def test_long_values_take_linear_time():
    guess = secrets.Guess(WORDS)
    assert guess.cost("a1" * 100_000) < 10 and guess.cost("qwertyuiop" * 20_000) > 5
    rng = random.Random(1)
    assert guess.cost("".join(rng.choice("abcdef0123456789") for _ in range(100_000))) > 50_000


def test_values_of_a_context():
    said = lambda t: [t[a:b] for a, b in secrets.values(t)]
    assert said("the pwd is Zx81kk!2, use it") == ["Zx81kk!2"]
    assert said("login at https://bob:q8Vn#29x@example.com/x") == ["q8Vn#29x"]
    assert said('"client-passphrase": "Tr0ub4dor&3"') == ["Tr0ub4dor&3"]
    assert said("Authorization: Bearer abc.def.ghi") == ["abc.def.ghi"] and said("a bearer abc.def.ghi!") == ["abc.def.ghi"]
    assert said("nothing to see here, only words and http://example.com") == []


def rows(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string").selectExpr("*", "1 as key", "2 as base", "3 as texts")
    found = secrets.scan(docs).withColumnRenamed("base", "base_").collect()
    by = dict(texts)
    return [{**r.asDict(), "text": by[r["doc_id"]]} for r in found]


def test_scan_marks_costly_values_only(spark):
    plain = "correct horse battery staple is a phrase of words " * 40
    texts = [(0, plain), (1, "password = correcthorse"), (2, "pwd: x9Kq2zR8vW!f"), (3, None), (4, ""), (5, "é token = d4e71e33b54f40bc277a32011430a66d5e984911 é"), (6, "passphrase is 11111111111111"), (7, "passcode: qwertyuiop"), (8, "w " * 200_000 + "pwd=Jx7!kQz0_wP2")]
    got = {r["doc_id"]: r for r in rows(spark, texts)}
    check(got.values())
    guessed = {i: [s for s in r["spans"].split(",") if s.startswith("guess")] for i, r in got.items()}
    assert guessed == {0: [], 1: [], 2: ["guess:5:17"], 3: [], 4: [], 5: ["guess:10:50"], 6: [], 7: [], 8: ["guess:400004:400016"]}
    assert got[3]["top_cost"] is None and got[1]["top_cost"] < 10 < got[2]["top_cost"]


def test_null_and_repeated_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "token=aaaaaaaaaaaa"), (None, "token=aaaaaaaaaaaa"), (1, "x")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_assign"]) for r in secrets.scan(docs).collect()) == [(0, 1), (0, 1), (1, 0)]
    assert secrets.scan(docs.limit(0)).count() == 0


def test_query_over_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_guess_cost_secrets(spark, sf)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    found = got.collect()
    assert len(found) == len(texts)
    for r in found:
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("guess")] == want
