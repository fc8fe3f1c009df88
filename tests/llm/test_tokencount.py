"""Token counts against the library on whole texts."""

import numpy as np
import pytest
import regex

from jobweave.llm import tokencount
from jobweave.llm.tokens import ByteTokenizer
from llm_cases import ODD

FOLDER = "/root/testdata/sf0.001"
HARD = [
    "", " ", "  a", "a  ", "\n\n x\t\ty ", "don't DON'T we'll 'll", "x<|endoftext|>y <|endoftext|>", "<|endoftext|>" * 3,
    "é" * 40 + "文字列、テスト。" * 9, "՘₏ ꟎ \U0001fae8  \u0085 ​", "x" * 70_000, "ab1! " * 40_000,
    "١٢٣ ½²Ⅷ ①", "á ë", "<|endof", "﻿x", " " * 3000 + "z",
]


@pytest.fixture(scope="module")
def exact():
    return ByteTokenizer.shared(ByteTokenizer.default_path()).exact


def counted(exact, text):
    return len((text or "").encode()), len(exact.encode(text or "", add_special_tokens=False).ids)


def test_counts_are_the_librarys(spark, exact):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        size, tokens = counted(exact, r.text)
        assert got[r.doc_id] == (size, tokens, tokens > 512)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_hard_texts_in_blocks_of_any_size(exact, block):
    cutter = tokencount.PreTokens(ByteTokenizer.default_path())
    for begin in range(0, len(HARD), block):
        part, own = HARD[begin : begin + block], tokencount.Block()
        for i, text in enumerate(part):
            own.add(None if i == 1 else -i, text, cutter)
        *lists, (_, _, _, docs, _) = own.rows(7, 5)
        assert [r[2] for r in lists] == sorted(r[2] for r in lists)
        listed = [t for r in lists for t in tokencount.unpack_list(r[4])]
        assert len(set(listed)) == len(listed) == len(own.places)
        ids, sizes, counts = tokencount.summed(docs, np.array(cutter.pieces(listed), np.int64))
        assert ids == [None if i == 1 else -i for i in range(len(part))]
        assert list(zip(sizes, counts)) == [counted(exact, t) for t in part]


def test_each_pre_token_is_counted_in_one_bucket_only():
    cutter = tokencount.PreTokens(ByteTokenizer.default_path())
    bucket = {}
    for texts in (["a b c", "b c d"], ["c d e " * 50]):
        own = tokencount.Block()
        for text in texts:
            own.add(1, text, cutter)
        for _, number, _, _, data in list(own.rows(0, 9))[:-1]:
            for token in tokencount.unpack_list(data):
                assert bucket.setdefault(token, number) == number


def test_agreed_code_points_are_cut_alike(exact):
    import public_tokenizers

    pattern, agreed = regex.compile(public_tokenizers.PATTERN), regex.compile(f"[{tokencount.AGREED}]")
    points = [c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff" and agreed.match(c)]
    assert len(points) > 20_000
    for begin in range(0, len(points), 500):
        text = "".join(f"a{c}1{c}!{c} x" for c in points[begin : begin + 500])
        cut = [span for _, span in exact.pre_tokenizer.pre_tokenize_str(text)]
        assert cut == [m.span() for m in pattern.finditer(text)]


def test_odd_rows(documents, exact):
    rows = ODD + list(enumerate(HARD, 100))
    got = tokencount.count_tokens(documents(rows))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    key = lambda r: (r[0] is None, r)
    expected = sorted(((i, *counted(exact, t)) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()), key=key) == expected
    assert tokencount.count_tokens(documents(ODD).limit(0)).isEmpty()
