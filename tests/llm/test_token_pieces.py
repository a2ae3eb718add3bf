"""Plain words are cut into pieces before the tokenizer's merges: the ids stay the library's."""

import random

import public_tokenizers

from pageledger.llm import token_files, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_plain_words_are_made_of_pieces():
    encoder, library = token_files.Encoder(WORDS, 2), tokens.tokenizer(WORDS)
    rnd = random.Random(3)
    signs = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x100))] + ["'"] * 20 + list("stld") * 5
    words = ["".join(rnd.choices(signs, k=rnd.randint(1, 12))) for _ in range(5000)] + ["it's", "'LL", "Ü's", "x<|endoftext|>y", "×÷", "中文a"]
    for w in words:
        assert encoder.word(w) == encoder.packed(library.encode(w, add_special_tokens=False).ids), w
    made = len(encoder.pieces)
    for w in ("it's,", "(it's)", "IT's!", "it's;it's"):
        encoder.word(w)
    assert set(encoder.pieces) >= {"it", "'s"} and len(encoder.pieces) - made <= 6
