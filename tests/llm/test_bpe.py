import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ragloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
OWN = bpe.Bpe(PATH, P.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
THEIRS = tiktoken.Encoding("theirs", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def same(text):
    ids = OWN.encode_texts([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == THEIRS.encode_ordinary(text), text
    assert OWN.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text)


def test_spaces_and_scripts():
    for text in ["", " ", "  a\n\n b\t\tc ", "it's WE'LL 12345 ½x", "Ünïcode ñandú x\x1cy\x85z", "日本語テキスト", "<|endoftext|>", "áé", "😀😀 x"]:
        same(text)


def test_long_pieces():
    r = random.Random(3)
    for n in (255, 256, 257, 300, 5000):
        same("a" * n)
        same("".join(r.choice("theand") for _ in range(n)))
        same(" " * n + "x")


def test_heap_equals_matrix():
    r = random.Random(4)
    found = ["".join(r.choice("theandoringé") for _ in range(r.randrange(2, 60))).encode() for _ in range(300)]
    for p, ids in zip(found, OWN.encode_pieces(found), strict=True):
        assert OWN.ranks.get(p, None) is not None or OWN.merge_long(p) == ids.tolist()


def test_query(spark):
    rows = [(1, "the end", "x"), (2, None, None), (2, None, None), (None, "", "y"), (3, "Émentoueau " * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode(df, PATH, P.PATTERN, keep_ids=True).collect()
    assert len(got) == 5
    for r, (i, text, _) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(rows, key=lambda x: (x[0] or 0)), strict=True):
        ids = THEIRS.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens, list(r.ids)) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest() and bytes(r.decoded) == (text or "").encode()
    empty = bpe.encode(df.limit(0), PATH, P.PATTERN)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
