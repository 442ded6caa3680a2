import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qanat.llm import bpe, queries

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = queries.tokenizer_path()
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH)


def tree(own, text, size):
    out = [np.empty(0, np.int32)]
    for part, special in own.sections(text):
        out.append(np.array([own.added[part]]) if special else own.tree([own.encode_ordinary(part[i : i + size]) for i in range(0, len(part), size)]))
    return np.concatenate(out).tolist()


PIECES = st.sampled_from(["a", "aaaa", "the", " the", "A", "é", "ß", " ", "  ", "\n", "1", "23", ".", "!!", "'", "'s", "'re", "漢", "😀", "\u0301", "\u00a0", SPECIAL, "-=", "ungs"])


@given(st.lists(PIECES, max_size=200).map("".join), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_trees_give_what_the_library_gives(text, size):
    from tokenizers import Tokenizer

    library = test_trees_give_what_the_library_gives.__dict__.setdefault("library", Tokenizer.from_file(PATH))
    own = bpe.codec(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == want
    assert tree(own, text, size) == want
    assert own.decode(np.array(want, np.int32)) == text


@pytest.mark.parametrize("unit", ["a", "ab", "the", "é", "漢字", "1", "=-", " ", "\n", "xq7"])
def test_text_without_any_place_to_cut(own, library, unit):
    text = unit * (6_000 // len(unit))
    assert tree(own, text, 500) == library.encode(text, add_special_tokens=False).ids


def test_random_letters_without_a_break(own, library):
    rng = random.Random(4)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    assert tree(own, text, 1_000) == library.encode(text, add_special_tokens=False).ids


def test_every_row_and_edge_of_the_input(spark, own, library):
    words = "Der Fluß — naïve café, it's 3.14 " + SPECIAL + " \u2003x "
    rows = [(1, None, [7]), (2, "", None), (3, words, None), (3, words, None), (None, words * 90, None), (5, "b" * 5_000, None), (5, "b" * 5_000, None), (6, SPECIAL * 300, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    found = bpe.decode(bpe.encode(df, PATH, long_chars=1_000, piece_chars=300), PATH).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False) == (r.text or "")
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0


def test_query_digests(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = queries.op4_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
