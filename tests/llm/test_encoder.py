import random

import numpy as np
from tokenizers import Tokenizer

from sievework.llm.token_files import encoder, tokenizer_file


def test_pieces_encode_as_whole_texts_do():
    tok = Tokenizer.from_file(tokenizer_file())
    encode = encoder(tokenizer_file(), "<u2")
    rng = random.Random(1)
    atoms = ["a", "Word", "été", "naïve,", "x.", ".", "'s", "it's", "12", "3rd", "!!", " ", "  ", "\n", "\n\n", "\t", "\0", " ", "\U0001f600", "ß.", "ª", "<|endoftext|>", "-", "Ⅷ", "́e", "don't", "ǅ", "ー"]
    texts = ["", " ", "\n", "a\n", "a ", " a", *("".join(rng.choice(atoms) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(20000))]
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert np.array(e.ids, "<u2").tobytes() == encode(t), repr(t)
