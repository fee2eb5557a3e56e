"""Texts with runs of white space that the faster coder of ``bpe`` refuses."""

from __future__ import annotations

import hashlib

import numpy as np

from graphloom.llm import bpe
from graphloom.llm.queries import tokenizer_path


def test_texts_of_two_million_spaces_are_encoded(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    run = 2_000_000
    texts = [" " * run, "one" + "\n" * run + "two", "plain text", " " * run + " end"]
    want = {i: lib.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    got = bpe.coder(tokenizer_path()).encode([t.encode() for t in texts])
    assert all(g.tolist() == want[i] for i, g in enumerate(got))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r[0]: (r[1], r[2]) for r in bpe.encode(docs, tokenizer_path()).collect()}
    assert rows == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in want.items()}
