import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runloom.llm import encoding, wordbpe
from tests.llm.rows import documents

PATH = wordbpe.default_path()
CODER = wordbpe.loaded(PATH, True)
CORE = wordbpe.loaded(PATH, False)
TEXTS = [
    "It's a test 'tis we'll they're  don't!!!'s '' ² 1234 x́ ΣΑΣ <|endoftext|> hi", "", "a", "l'l 'll'll 're've'", "'", "x'", "x'r", "x'v", "İstanbul ß 中文 字 　 ok’s", "a" * 5000, "ab" * 3000 + "!",
    "\x00\x01\x1c\x85 z", "'S'T 'RE", "thisthat" * 700, "é́ ồ がガ", "🙂🙂 a🙂b", "\n\n", "١٢٣ ⅷ ½", "ʼn ǰ ﬁ",
]


def library(text):
    return CODER.library().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("coder", [CODER, CORE])
def test_ids_are_the_library_s(coder):
    for text, ids in zip(TEXTS, coder.encode_all(pa.array(TEXTS)), strict=True):
        assert ids.tolist() == library(text), text[:40]


def test_pieces_of_long_texts_give_the_same_ids():
    long = " ".join(TEXTS) + "\n" + "wordwithoutanyspace" * 30 + " end  "
    for size in (7, 50, 300):
        for coder in (CODER, CORE):
            assert [x.tolist() for x in coder.encode_all(pa.array(["a b", long, None, "c"]), size)] == [library(t) for t in ("a b", long, "", "c")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab'st rel.1é", max_size=40)), max_size=4))
def test_ids_of_any_texts(texts):
    for coder in (CODER, CORE):
        assert [x.tolist() for x in coder.encode_all(pa.array(texts, pa.string()))] == [library(t) for t in texts]


def test_transducer_holds_a_bounded_piece_of_a_long_word():
    t = CODER.transducer
    t.reset()
    symbols, out = "abcab" * 20_000, []
    for k in range(0, len(symbols), 1000):
        out += t.feed(symbols[k : k + 1000])
    most = t.most_held
    out += t.close()
    assert "".join(out) == symbols and most <= 4 * CODER.merges.lookahead
    assert all(CODER.merges.fits(a, b) for a, b in zip(out, out[1:], strict=False))


def test_transducer_equals_brute_force_on_pieces():
    rng = np.random.default_rng(0)
    t = CODER.transducer
    for _ in range(150):
        symbols = "".join(chr(97 + c) for c in rng.integers(0, 5, rng.integers(1, 60)))
        t.reset()
        got = [x for c in symbols for x in t.feed(c)] + t.close()
        assert got == wordbpe.greedy(CODER.merges, symbols)


def test_every_token_is_its_own_encoding_in_the_merge_core():
    core, of_rank = CORE.merge_core
    for token in CORE.merges.parts:
        flat = bytes(ord(c) & 0xFF for c in token) + (b"\xff" if ord(token[-1]) >= wordbpe.END else b"")
        assert [of_rank[r] for r in core.encode_single_piece(flat)] == [CORE.merges.ids[token]]


def test_decoding():
    for text in TEXTS:
        ids = library(text)
        want = CODER.library().decode(ids, skip_special_tokens=False)
        for step in (1, 3, 1000):
            machine = CODER.decoder()
            assert "".join([machine.feed(ids[k : k + step]) for k in range(0, len(ids), step)] + [machine.close()]) == want
    machine = CODER.text_decoder()
    pieces = [machine.feed([i]) for i in library("Ünï cödé 中🙂")] + [machine.close()]
    assert "".join(pieces) == "ünï cödé 中 🙂 "


def test_decoder_holds_what_is_not_complete():
    machine = wordbpe.Decoder([bytes([b]) for b in range(256)])
    assert [machine.feed([b]) for b in "é🙂".encode()] == ["", "é", "", "", "", "🙂"]
    assert machine.feed([0xE2, 0x82]) == "" and machine.close() == "\ufffd" and machine.feed([65]) == "A"


def test_code_points_of_all_planes():
    """Letters, marks, digits, symbols and unassigned ones: classes, normal forms and lower cases are the library's."""
    texts = [f"a{chr(c)}b {chr(c)}1 \u0041{chr(c)}\u0301" for c in range(1, 0x110000, 17) if not 0xD800 <= c < 0xE000]
    texts += [f"{chr(c)}\u0301\u0327 x{chr(c)}\u1161\u11a8" for c in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1100, 0x1113), *range(0x0E00, 0x0E80), *range(0x900, 0xA00), *range(0x5D0, 0x650)]]
    want = CODER.library().encode_batch(texts, add_special_tokens=False)
    for t, ids, w in zip(texts, CORE.encode_all(pa.array(texts)), want, strict=True):
        assert ids.tolist() == w.ids, t


def test_unassigned_characters_and_special_tokens_inside_texts():
    rare = chr(0x1C89)
    assert CODER.kind[0x1C89] == wordbpe.SLOW
    for text in (f"plain words {rare}x and\n{rare} more", f"é<|endoftext|>\u0338<|startoftext|>{rare} z<|endoftext|>", "<|endoftext|>", "<|endoftext|", f"{rare}" * 50):
        assert CODER.encode(text).tolist() == library(text), text


def test_improper_merges_are_refused():
    with pytest.raises(ValueError):
        wordbpe.Merges({"ab": 0, "a": 1, "b": 2, "abc": 3, "c": 4}, [["ab", "c"]])


def test_tables(spark):
    docs = documents(spark, [(1, TEXTS[0]), (2, ""), (3, None), (None, "x"), (1, TEXTS[0])])
    got = sorted(((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoding.digests(docs).collect()))
    want = []
    for i, t in [(0, "x"), (1, TEXTS[0]), (1, TEXTS[0]), (2, ""), (3, "")]:
        ids = library(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(CODER.library().decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    encoded = encoding.encode(documents(spark, [(1, "Hello there"), (2, None)]))
    assert {r.doc_id: r.text for r in encoding.decode(encoded).collect()} == {1: "hello there ", 2: ""}
    assert encoding.digests(documents(spark, [])).count() == 0
