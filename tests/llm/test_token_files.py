"""Words of token files are told apart by their bytes: special tokens by case, and words whose polynomial hashes meet."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "<", "|", "É", "É", "Σ", "ΟΔΟΣ", " ", "\n", "\t", " \n ", "don't", "DON'T", "日本", "　", "\x85", "İ", "K", "1", "!?", "x" * 600, "ſ"]


def thue_morse(n, a="ab"):
    """Two words of 2^n letters, each the other with its letters exchanged, that collide under polynomial hashes modulo a power of two."""
    bits = [bin(k).count("1") % 2 for k in range(1 << n)]
    return "".join(a[b] for b in bits), "".join(a[1 - b] for b in bits)


@pytest.mark.parametrize("seed", range(4))
def test_ids_are_those_of_the_tokenizer_in_any_order(seed):
    tokenizer, rng = Tokenizer.from_file(WORDS), random.Random(seed)
    encoder = token_files.WordEncoder(WORDS)
    for _ in range(30):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(20)] + [None, ""]
        ids, at = encoder.encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("swap", [False, True])
def test_case_of_special_tokens_and_colliding_words(swap):
    tokenizer = Tokenizer.from_file(WORDS)
    for texts in (["a <|ENDOFTEXT|> b", "c <|endoftext|> d"], [" ".join(["x", w, "y"]) for w in thue_morse(10)], [*thue_morse(12)]):
        texts = texts[::-1] if swap else texts
        ids, at = token_files.WordEncoder(WORDS).encode(pa.array(texts))
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(2)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
