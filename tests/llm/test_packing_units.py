"""The array tokenizer against the tokenizer file itself."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graphloom.llm import packing
from graphloom.llm.textkit import pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def _odd_texts() -> list:
    letters = list("aÉß,.'-x1 \n\t\x00×日Z#")
    fixed = ["", None, "don't Don't DON'T", "-" * 28 + " x---------", "É ÉÀß Ÿ µ ª º × ÷ a×b", "日本語 テキスト x nbsp y", "x" * 100 + " " + "Y" * 17 + "..", "ab12,, 12, (ab) ab)(", "İstanbul ſtraße ǅ", "a'. a'b' '", "a\x00 a \x00 aaaaaaaa aaaaaaaa\x08" + "\x00" * 7]
    return fixed + ["".join(np.random.default_rng(i).choice(letters, 60)) for i in range(500)]


@pytest.mark.parametrize("most", [1 << 20, 100])
@pytest.mark.parametrize("cache", [packing.CACHE_WORDS, 50])
def test_ids_are_those_of_the_whole_text(monkeypatch, most, cache):
    monkeypatch.setattr(packing, "CACHE_WORDS", cache)  # a full table is emptied between pieces
    texts = _odd_texts()
    tokenizer = packing.WordTokenizer(PATH)
    assert tokenizer.by_words and tokenizer.by_model
    got = [ids for p in pieces(pa.array(texts, pa.string()), most=most) for ids in tokenizer.encode(p)]
    whole = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in whole]


def test_table_of_units_grows_and_finds_every_key():
    units = packing.Units(slots=16)
    key1 = np.arange(5000, dtype=np.uint64)
    key2, length = key1 * np.uint64(7), np.full(5000, 9, np.uint64)
    h = packing.Units.mixed(key1, key2, length)
    count = np.arange(5000) % 3
    for lo in range(0, 5000, 700):
        p = slice(lo, lo + 700)
        units.add(h[p], key1[p], key2[p], length[p], count[p], np.repeat(np.arange(5000), count)[count[:lo].sum() : count[: lo + 700].sum()].astype(np.uint32))
    assert (units.find(h, key1, key2, length) == np.arange(5000)).all()
    assert (units.find(h, key1, key2, length + np.uint64(1)) == -1).all()
    assert (units.ids[units.at[4999] : units.at[4999] + units.count[4999]] == 4999).all()
