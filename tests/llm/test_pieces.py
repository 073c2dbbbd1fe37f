import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import SF, sample

from tabprep.llm.pieces import CharacterMap, Normalizer, _message, encode_pieces, load_pieces
from tabprep.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
FLAGS = [(a, b, c) for a in (True, False) for b in (True, False) for c in (True, False)]
#: Full-width and combined letters, ligatures, fractions, ideographs, controls and blanks of all kinds.
ODD = st.text(st.sampled_from("ab \t\n　Ａｂ①½ﬁéé日ｶﾞ​\u0000\x07㌔▁�\U0001f600"), max_size=14)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def compiled_map(rule):
    model = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    return dict(_message(next(v for n, v in _message(model) if n == 3)))[2]


def test_documents_and_query_against_the_library(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op13_sentencepiece"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids, r = LIBRARY.encode(text or ""), got[i]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(LIBRARY.decode(ids)) and r["source_bytes"] == len((text or "").encode())


@settings(max_examples=400, deadline=None)
@given(st.one_of(ODD, st.text(max_size=60)))
def test_ids_of_any_text(text):
    ((ids, bounds),) = load_pieces(PATH).encode([text.encode("utf-8", "ignore")])
    text = text.encode("utf-8", "ignore").decode()
    assert ids == LIBRARY.encode(text)
    data = text.encode()
    assert bounds[0] == 0 and bounds[-1] == len(data) and (bounds[1:] >= bounds[:-1]).all() and len(bounds) == len(ids) + 1
    for i, (a, b) in zip(ids, zip(bounds, bounds[1:])):
        surface = data[a:b].replace(b" ", "▁".encode())
        piece = LIBRARY.id_to_piece(i).encode()
        shown = bytes([int(piece[3:5], 16)]) if LIBRARY.is_byte(i) else piece
        assert shown == surface or (a == 0 and shown == "▁".encode() + surface)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix,removed,escaped", FLAGS)
def test_normalisation_and_its_alignment(rule, prefix, removed, escaped):
    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=removed, escape_whitespaces=escaped
    )
    own = Normalizer(CharacterMap(compiled_map(rule)), prefix, removed, escaped)

    @settings(max_examples=150, deadline=None)
    @given(ODD)
    def same(text):
        normal, source = own(text.encode())
        want, offsets = library.normalize(text, with_offsets=True)
        assert normal.decode() == want and len(source) == len(normal) + 1
        begins = [i for i, byte in enumerate(normal) if byte & 0xC0 != 0x80]
        characters = [len(text.encode()[: source[i]].decode()) for i in begins]
        # a character that a rule made of nothing but part of another has the place of that one
        assert characters == offsets[: len(characters)]

    same()


def test_rules_of_the_longest_prefix():
    rules = CharacterMap(compiled_map("nfkc"))
    assert rules.longest("éx".encode(), 0) == ("é".encode(), 3)
    assert rules.longest("ﬁx".encode(), 0) == (b"fi", 3) and rules.longest(b"ex", 0) is None
    assert CharacterMap().firsts == []


def test_symbols_are_left_as_they_are():
    own = Normalizer(CharacterMap(compiled_map("nfkc")), False, False, False, symbols=("ﬁ".encode(), "ﬁﬂ".encode()))
    normal, source = own("aﬁﬂ ﬂ".encode())
    assert normal.decode() == "aﬁﬂ fl" and source.tolist() == [0, 1, 1, 1, 1, 1, 1, 7, 8, 8, 11]


def test_odd_rows(spark, odd, none):
    got = encode_pieces(odd, PATH).collect()
    assert [tuple(r["row"]) for r in got] == [tuple(r) for r in odd.collect()]
    for r in got:
        text = r["row"]["text"] or ""
        assert r["ids"] == LIBRARY.encode(text) and r["decoded"] == LIBRARY.decode(r["ids"])
        assert r["bounds"][0] == 0 and r["bounds"][-1] == len(text.encode()) and len(r["bounds"]) == len(r["ids"]) + 1
    assert encode_pieces(none, PATH).count() == 0


def test_long_texts_stand_alone(spark):
    texts = ["word " * 500_000, "x" * 200_000, "short"]
    got = encode_pieces(sample(spark, texts), PATH, keep=["doc_id"]).collect()
    assert [r["ids"] for r in sorted(got, key=lambda r: r["row"]["doc_id"])] == LIBRARY.encode(texts)
