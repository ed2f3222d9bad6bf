"""The unit tokenizer against the library itself, on texts of every awkward piece."""
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docfields.llm import tokens

PIECES = [" ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "a", "B", "e",
          "É", "é", "́", "̸", "ß", "ª", "µ", "×", "İ", "Σ", "ς", "中", "1", "23", "'s", "'", "’", ".", ",", "***",
          "#", "|", "<|", "|>", "<|endoftext|>", "_", "<", "=", "The", " the", "ciónarrez", "word,", "&&&"]
EDGES = [None, "", " ", "  ", "   ", "\n", "\n\n", "\n\n\n", " \n", "\n ", "a  ", "a\n ", "\xa0a", "a\n  b", "a   b", "a\n\nb"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("store", [10, 700_000])
def test_same_ids_as_the_library(name, store, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_BYTES", 5_000)  # many groups over one store
    monkeypatch.setattr(tokens, "CACHE_PIECES", store)  # starts anew at each group, or never
    rng = random.Random(name)
    texts = EDGES + ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(4_000)]
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    want = [[*x.ids, 1] for x in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = []
    column = pa.array([None, *texts, None], pa.string()).slice(1, len(texts))  # a slice of a larger column
    for at, ids, off in tokens.UnitTokenizer(path).groups(column, 1):
        assert at == len(got)
        got += [ids[x:y].tolist() for x, y in zip(off[:-1], off[1:])]
    assert got == want


def test_no_texts():
    tok = tokens.UnitTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert list(tok.groups(pa.array([], pa.string()), 1)) == []
    ids, off = tok.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and off.tolist() == [0]
