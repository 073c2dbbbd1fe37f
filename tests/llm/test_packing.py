import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from llm.conftest import SF
from tokenizers import Tokenizer

from tabprep.llm.packing import byte_bpe, pack_power_of_two, piece_lengths, write_buckets
from tabprep.llm.queries import QUERIES

FILES = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
PLAIN = Tokenizer.from_file(FILES[0])


def ids_of(text):
    return np.array(PLAIN.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check(docs, got):
    whole = sorted(ids_of(r["text"]).tobytes() for r in docs.collect())
    pieces = defaultdict(dict)
    for r in got:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0
        pieces[(r["doc_id"], r["doc_tokens"])].setdefault(r["start"], []).append(r)
    joined = []
    for (_, total), by_start in pieces.items():
        copies = len(by_start[0])
        parts, at = [], 0
        while at < total:
            assert len(by_start[at]) % copies == 0
            parts.append(bytes(by_start[at][0]["ids"]))
            at += by_start[at][0]["length"]
        joined += [b"".join(parts)] * copies
    assert at == total and len({r["sequence_id"] for r in got}) == len(got)
    return sorted(joined) == whole


def test_ids_equal_those_of_the_vocabulary():
    rng = random.Random(2)
    signs = [" ", " ", "  ", "\n", "\t", "\r\n", " ", "a", "The", "é", "漢", "'s", "1", "23", ",", "!", "—", "<|endoftext|>", "<|", "\u0000", "\U0001f600"]
    encode = byte_bpe(*FILES)
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 16)))
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(text)[:-1].tolist(), repr(text)


def test_lengths_are_the_binary_digits():
    for n in (1, 2, 3, 2047, 2048, 2049, 6000):
        got = piece_lengths(n, 2048)
        assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in got)
        assert len([x for x in got if x < 2048]) == len({x for x in got if x < 2048})


def test_odd_rows_round_trip(odd, none):
    unique = odd.filter("doc_id not in (5) and doc_id is not null")
    assert check(unique, pack_power_of_two(unique, *FILES).collect())
    assert pack_power_of_two(odd, *FILES).filter("start = 0").count() == odd.count()
    assert pack_power_of_two(none, *FILES).count() == 0


def test_query_against_the_vocabulary(spark, documents):
    want = {}
    for r in documents.collect():
        ids, at = ids_of(r["text"]), 0
        for n in piece_lengths(len(ids), 2048):
            want[(r["doc_id"], at)] = (n, zlib.crc32(ids[at : at + n].tobytes()), len(ids))
            at += n
    got = QUERIES["op3_packing"](spark, SF).collect()
    assert {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got} == want
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}


def test_buckets_hold_one_length(spark, documents, tmp_path):
    write_buckets(pack_power_of_two(documents.limit(20), *FILES), str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert back.filter("length <> pow(2, bucket) or octet_length(ids) <> 4 * length").count() == 0
