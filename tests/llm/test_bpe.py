import hashlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm import bpe
from tracefold.llm.common import flat
from tracefold.llm.queries import vocabulary_path

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = bpe.load_ranks(vocabulary_path())
OURS = bpe.Tokenizer(RANKS)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("'srevmltdD  \n\t 　aé1Ⅷ!_日😀́"), max_size=40), max_size=5))
def test_as_the_library(texts):
    data, offsets = flat(pa.array(texts, pa.string()))
    ids, ends = OURS.encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [THEIRS.encode_ordinary(t) for t in texts]
    assert OURS.decode(ids).tobytes() == data.tobytes()


def test_long_slices():
    texts = ["x" * 5000, "ab" * 3000, "0123456789" * 500]
    data, offsets = flat(pa.array(texts))
    ids, ends = OURS.encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [THEIRS.encode_ordinary(t) for t in texts]


def test_scan_is_composition():
    rng = np.random.default_rng(1)
    f = bpe.OF_SYMBOL[rng.integers(0, 16, 40_000)]
    state, out = bpe.FRESH, []
    for g in f.tolist():
        out.append(state)
        state = bpe.RESULT[g, state]
    assert (bpe.RESULT[bpe.scan(f), bpe.FRESH] == out).all()


def test_documents(spark, make, corpus):
    got = {(r.doc_id, r.decoded_sha256): (r.n_tokens, r.ids_sha256) for r in bpe.encode_documents(make(corpus), vocabulary_path()).collect()}
    for i, t, *_ in corpus:
        ids = np.array(THEIRS.encode_ordinary(t or ""), "<u4")
        assert got[i, hashlib.sha256((t or "").encode()).hexdigest()] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    assert bpe.encode_documents(make([]), vocabulary_path()).count() == 0
