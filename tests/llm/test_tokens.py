import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import tokens

#: The library as it is: nothing of the operator's encoder is in it.
LIBRARY = Tokenizer.from_file(tokens.default_tokenizer())
OWN = tokens.Encoder(tokens.default_tokenizer())
ADDED = [t.content for t in LIBRARY.get_added_tokens_decoder().values()]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([*ADDED, " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u180e", "\u200b", "\u2003", "\u2028", "\ufeff", "'s", "'LL", "a", "Zé", "12", "²", "…"])), max_size=12).map("".join))
def test_ids_are_those_of_the_library(text):
    clean = text.encode("utf-8", "ignore").decode()
    assert OWN.encode([clean]) == [OWN.pack(LIBRARY.encode(clean, add_special_tokens=False).ids)]


def test_added_tokens_in_texts():
    assert ADDED
    for a in ADDED:
        for text in (a, f"x{a}", f"{a} y", f"x {a}{a}\n", a[:-1], f"  {a}  "):
            assert OWN.encode([text, "other"]) == [OWN.pack(LIBRARY.encode(t, add_special_tokens=False).ids) for t in (text, "other")]


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_parts_encode_like_whole_texts(texts):
    own = tokens.Encoder(tokens.default_tokenizer())
    odd = ["", " ", "  a  b\n\n c \t d", "a\x1c b \x85c", "it's  we'll don't", "<|endoftext|> x", "² ½ 12a", "हिन्दी भाषा", "👍🏽 ok", "\n \n a", texts(1, 500), "é" * 2000, "Of%%% athe*** [x]"]
    assert own.by_parts
    assert own.encode(odd) == [own.pack(e.ids) for e in LIBRARY.encode_batch(odd, add_special_tokens=False)]


def test_a_block_is_encoded_by_pieces(texts):
    own = tokens.Encoder(tokens.default_tokenizer())
    block = [texts(k, 300) for k in range(20)] + ["so, so. so! (so) 'tis", "", "a  b", " x\x1cy z"]
    want = [own.pack(e.ids) for e in LIBRARY.encode_batch(block, add_special_tokens=False)]
    assert own.encode(block) == want and own.encode(block[::-1]) == want[::-1]
    # what is kept are pieces: a word with another mark after it isn't encoded anew
    assert {" so", ",", ".", "!"} <= set(own.young) and " so," not in own.young
    assert all(len(tokens._PIECES.findall(p)) == 1 for p in own.young if "\x1c" not in p)
    own.lengths[:] = 3  # lengths that tell no ends: each piece is encoded by itself
    own.young, own.old = {}, {}
    assert own.encode(block) == want


def test_file_round_trip_and_damage():
    sink = io.BytesIO()
    writer = tokens.Writer(sink, width=2, frame=64)
    docs = [(k if k else None, np.arange(k * 7, dtype="<u2").tobytes()) for k in range(12)]
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.close()
    reader = tokens.Reader(Source(sink.getvalue()))
    assert list(reader.documents()) == docs and len(reader.frames) > 3
    assert list(reader.documents([11])) == docs[11:]
    hurt = bytearray(sink.getvalue())
    hurt[int(reader.starts[2]) + 10] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        list(tokens.Reader(Source(bytes(hurt))).documents())


def test_written_documents(odd, empty):
    files = tokens.write_tokens(odd, tokens.default_tokenizer())
    rows = tokens.read_index(files).orderBy("start").collect()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32(np.array([*LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in odd.collect())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in rows) == want
    assert [r["start"] for r in rows] == np.r_[0, np.cumsum([r["n_tokens"] for r in rows])][:-1].tolist()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    one = tokens.read_documents(files, [6]).collect()
    assert len(one) == 1 and one[0]["ids"][-1] == 2
    assert tokens.read_index(tokens.write_tokens(empty, tokens.default_tokenizer())).count() == 0
