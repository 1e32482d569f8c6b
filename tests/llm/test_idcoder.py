import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabwright.llm.idcoder import decode_ids, encode_ids, pack_block, read_ids, unpack_block, write_ids
from tabwright.llm.tokens import encoder, tokenizer_path
from tabwright.session import scratch_path

PATHS = [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=700), st.booleans())
def test_round_trip(ids, few):
    x = np.array(ids) % 7 if few else np.array(ids)
    words, sizes = encode_ids(x, int(x.max()) + 1)
    assert (decode_ids(words, sizes, len(x), int(x.max()) + 1) == x).all()


def test_skewed_ids_take_few_bits_and_carries_are_right():
    rng = np.random.default_rng(2)
    for x in (np.zeros(30_000, int), rng.zipf(1.3, 60_000) % 50_257, np.tile(np.arange(50), 900)):
        words, sizes = encode_ids(x, int(x.max()) + 1)
        assert (decode_ids(words, sizes, len(x), int(x.max()) + 1) == x).all()
        assert words.nbytes < 1.5 * len(x)


def test_blocks_stand_alone_and_notice_damage():
    ids = np.arange(5000) % 321
    block = pack_block([4, None, 9], [4000, 0, 1000], ids)
    docs, sizes, back = unpack_block(block)
    assert docs == [4, None, 9] and sizes.tolist() == [4000, 0, 1000] and (back == ids).all()
    for at in (3, 40, len(block) // 2, len(block) - 2):
        with pytest.raises(ValueError):
            unpack_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])
    with pytest.raises(ValueError):
        unpack_block(block[:10])


@pytest.mark.parametrize("name,kind", PATHS)
def test_pieces_give_the_ids_of_whole_texts(name, kind, prose):
    whole = Tokenizer.from_file(tokenizer_path(name))
    whole.encode_special_tokens = True
    texts = [r["text"] for r in prose.limit(40).collect()]
    odd = "a  b\n\n c|it's we're O'Neill's, don't!!|Ü-cödé ß÷×é ÀÉ…..|<|endoftext|> x|\t\tx \n y  |12345 3.14,foo|ΟΔΥΣΣΕΥΣ.|A'S 'LL|é É,|\x1c\x85 "
    texts += ["", *odd.split("|"), odd, "x" * 5000]
    got = encoder(tokenizer_path(name), kind).ids(texts)
    assert got == [np.array(e.ids, dtype="<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]


def expected(rows, name):
    whole = Tokenizer.from_file(tokenizer_path(name))
    whole.encode_special_tokens = True
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_files_hold_all_documents_in_order(llm, messy, prose, empty):
    for df, block in ((messy, 500), (prose, 3000), (empty, 100)):
        target = scratch_path(llm, "ids")
        write_ids(df, target, tokenizer_path("byte_bpe_50k.json"), "byte", 2, block)
        rows = [tuple(r) for r in read_ids(llm, target).collect()]
        wanted = expected([(r["doc_id"], r["text"]) for r in df.collect()], "byte_bpe_50k.json")
        assert sorted(rows, key=lambda r: r[1]) == wanted


MARKED = ["end of sample <|endoftext|> next", "<|endoftext|>", "a \n <|startoftext|><|endoftext|>  b", "<|ENDOFTEXT|> no mark", "plain  text"]


@pytest.mark.parametrize("name,kind", PATHS)
def test_strings_of_added_tokens_are_their_tokens(name, kind):
    plain = Tokenizer.from_file(tokenizer_path(name))
    got = encoder(tokenizer_path(name), kind, added=True).ids(MARKED)
    assert got == [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in MARKED]


def test_files_hold_the_ids_of_the_plain_call(llm):
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    wanted, start = [], 0
    for doc, text in enumerate(MARKED):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        wanted.append((doc, start, ids))
        start += len(ids)
    target = scratch_path(llm, "ids")
    write_ids(llm.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string"), target, tokenizer_path("byte_bpe_50k.json"), "byte", 2, 100)
    rows = sorted((r["doc_id"], r["start"], list(r["ids"])) for r in read_ids(llm, target).collect())
    assert rows == wanted and 50256 in rows[0][2]
