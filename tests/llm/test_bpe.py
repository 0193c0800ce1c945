import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from sparkweave.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice("aàßñeéè \n\t.,!019日本語😀zqth") for _ in range(80)) for _ in range(200)]
    return [*made, "", "a" * 3000, "ab" * 500, "<|endoftext|> x", "  lead and trail  ", "don't can't"]


def test_same_ids_as_the_library_and_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' as n_tokens", "1 as ids")
    got = bpe.encode(docs, PATH, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode_ordinary(r["text"] or "")
        assert r["bpe_ids"] == ids and r["n_tokens"] == len(ids) and r["ids"] == 1
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def test_append_and_edit_are_exact():
    coder = bpe.encoder(PATH)
    rng = random.Random(9)
    for _ in range(100):
        data = bytes(rng.choice(b"the ationg") for _ in range(rng.randint(1, 30)))
        more = bytes(rng.choice(b"tionsed") for _ in range(rng.randint(0, 9)))
        table = coder.extend(data, [])
        grown, longer = coder.append(data, list(table), more)
        assert longer == coder.extend(data + more, [])
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        edited, again = coder.edit(data, table, a, b, more)
        assert edited == data[:a] + more + data[b:] and again == coder.extend(edited, [])
        assert coder.decode(struct.pack(f"<{len(coder.walk(again, coder.tokens))}I", *coder.walk(again, coder.tokens))) == edited


def test_edit_stops_where_the_tables_agree():
    import random

    ranks = {bytes([b]): b for b in range(256)} | {p: 256 + i for i, p in enumerate([b"ab", b"abab", b"ba", b"bab", b"aa", b"aaa"])}
    coder = bpe.PrefixEncoder(ranks)
    rng = random.Random(2)
    for _ in range(200):
        data = bytes(rng.choice(b"abc") for _ in range(60))
        last = coder.extend(data, [])
        a = rng.randrange(60)
        b, new = min(60, a + rng.randrange(5)), bytes(rng.choice(b"abc") for _ in range(rng.randrange(5)))
        changed, table = coder.edit(data, list(last), a, b, new)
        assert changed == data[:a] + new + data[b:] and table == coder.extend(changed, [])
