"""Words that the encoder keeps, and how a word is spelled for the model."""

import public_tokenizers
from tokenizers import Tokenizer

from tallyforge.llm import encoder as encoding
from tallyforge.llm import token_orc


def test_op10_encodes_a_word_twice_at_most(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = encoding.encoder(path, getattr(token_orc, "MOST_WORDS", 80_000))
    calls = []
    monkeypatch.setattr(enc.words, "made", lambda word: calls.append(word) or b"\0\0\0\0")
    text = " ".join(f"{chr(97 + i // 10_000 % 26)}w" * (i // 260_000 + 1) + "".join(chr(97 + int(d)) for d in str(i)) for i in range(170_000))
    for _ in range(4):  # more words than 80,000 and its predecessors hold
        enc.ids(text)
    enc.words.clear(), enc.words.old.clear()
    assert len(calls) <= 2 * 170_000 + 2


def test_spelling_of_words():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, plain = encoding.Encoder(path), Tokenizer.from_file(path)
    for text in ("a", " ", "  ", " a", " 1", "  a b\n c", " é", "é", "ab c1 2 d-e 's 'll\t x", "  x", "_ _a"):
        for _ in range(3):
            assert enc.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
