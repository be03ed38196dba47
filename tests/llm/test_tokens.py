"""Pieces remembered by the encoder."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from weftline.llm import token_files
from weftline.llm.common import materialize
from weftline.llm.tokens import END, WORD_VOCABULARY, TextEncoder


def texts(seed: int) -> list:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñ'_.,9") for _ in range(r.randint(1, 24)))
    return [None, "", " ", *(" ".join(r.choice(["the", "of", "house's", word()]) for _ in range(40)) for _ in range(20))]


def test_frequent_pieces_stay_remembered():
    """A piece that every text has is encoded once, however many others come by."""
    tok = TextEncoder(WORD_VOCABULARY, 100)
    learnt = []
    learn = tok._learn
    tok._learn = lambda pieces: (learnt.extend(pieces), learn(pieces))
    for seed in range(20):
        tok.documents(texts(seed))
        assert tok.pieces.count <= 100 + 20 * 40 and len(tok.pieces.odd) <= tok.pieces.count
    assert learnt.count(b"the") == learnt.count(b"house's") == 1


def test_ids_whatever_is_remembered():
    whole = Tokenizer.from_file(WORD_VOCABULARY)
    for remembered in (0, 1, 60, 1000):
        tok = TextEncoder(WORD_VOCABULARY, remembered)
        for seed in range(8):
            some = texts(seed % 5)
            want = [[*whole.encode(t or "", add_special_tokens=False).ids, END] for t in some]
            assert [x.tolist() for x in tok.documents(some)] == want


def test_files_are_told_without_a_table(spark, monkeypatch):
    """A task that writes a table to a local folder starts three processes from an executor's JVM; a row a file needs no table."""
    written = []
    monkeypatch.setattr(token_files, "materialize", lambda df, name: (written.append(name), materialize(df, name))[1])
    docs = spark.createDataFrame([(2, "a b"), (None, None), (1, "c")], "doc_id long, text string")
    folder = token_files.token_folder(spark)
    told = token_files.write_tokens(docs, folder)
    assert written == ["token-ids"]
    assert [part for part, _, _ in told] == list(range(len(told))) and sum(n for _, n, _ in told) == 3
    got = token_files.checksums(token_files.read_tokens(spark, folder, told)).orderBy("start").collect()
    ids = [[*Tokenizer.from_file(WORD_VOCABULARY).encode(t, add_special_tokens=False).ids, END] for t in ("", "c", "a b")]
    starts = [0, len(ids[0]), len(ids[0]) + len(ids[1])]
    assert [tuple(r) for r in got] == [(d, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, a, x in zip((None, 1, 2), starts, ids, strict=True)]
