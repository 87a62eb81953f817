from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

from velograph.llm.op02_tokens import VOCABULARY, Counter, token_counts

DOCS = "doc_id long, text string, n_tokens long, h long, i long"


def library(texts):
    own = Tokenizer.from_file(VOCABULARY)
    return [len(own.encode(t or "", add_special_tokens=False)) for t in texts]


def texts(seed):
    rng = random.Random(seed)
    odd = ["a", "é", " ", "  ", "\n", "\t ", "'ll", "'re", "<|endoftext|>", "<|endof", "text|>", "12", "漢字", "🙂", " ", "_", "--", "don't", " 's ", "\r\n"]
    out = [None, "", " ", "<|endoftext|>", "x" * 900, " " * 900, "漢" * 900, "a'll b're " * 90, "<|endoftext|>" * 60, "\n \n" * 300]
    return out + ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 700))) for _ in range(120)]


def test_pieces_count_as_the_library_counts():
    own = Counter(VOCABULARY)
    assert own.by_piece and own.count([t or "" for t in texts(1)]) == library(texts(1))


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 1_024), (300, 140)])
def test_spliced_counts_equal_the_library(spark, chunk, overlap):
    rows = [(i, t, 7, 8, 9) for i, t in enumerate(texts(2))] + [(None, "no id", 1, 1, 1), (3, "again " * 200, 1, 1, 1), (3, "again " * 200, 1, 1, 1)]
    got = sorted(map(tuple, token_counts(spark.createDataFrame(rows, DOCS), chunk=chunk, overlap=overlap, limit=100).collect()), key=str)
    want = sorted(((r[0], len((r[1] or "").encode()), n, n > 100) for r, n in zip(rows, library([r[1] for r in rows]), strict=True)), key=str)
    assert got == want


def test_texts_of_several_chunks_of_the_usual_size(spark):
    """Spliced at 32,768 characters: words, runs without a space, white space, other scripts, special strings at the seams."""
    rng = random.Random(5)
    words = ["ab", "don't", "x1y", "漢字", "é", "\n", "  ", "<|endoftext|>", "-", "🙂", "I'll"]
    long = [" ".join(rng.choice(words) for _ in range(30_000)), "x" * 100_000, " " * 70_000 + "a", "漢" * 70_000, "a" * 32_760 + "<|endoftext|>" + "b" * 40_000, "".join(rng.choice("ab \n'") for _ in range(140_000)), "1234567 " * 12_000]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame([(i, t, 7, 8, 9) for i, t in enumerate(long)], DOCS)).collect()}
    assert [got[i] for i in range(len(long))] == library(long)


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], DOCS)).count() == 0
