"""Packing: texts that quote the tokenizer's added tokens have the tokenizer's own ids."""

import json
import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

from kinema.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_added_tokens_match_tokenizer():
    chunks, tokenizer, rng = packing.Chunks(TOKENIZER), Tokenizer.from_file(TOKENIZER), random.Random(1)
    assert chunks.ranks is not None
    with open(TOKENIZER, encoding="utf-8") as f:
        added = [x["content"] for x in json.load(f)["added_tokens"]]
    assert chunks.ids(b"a <|endoftext|> b") == struct.pack("<3I", 320, 49407, 321)
    parts = [*added, *(x.upper() for x in added), "<", "|", ">", "<|", "|>", "a", "\u00c9", "e\u0301", "\u0301", "'s", "1", " ", "\n", "\u2003", "\u4e2d", "."]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert chunks.ids(t.encode()) == struct.pack(f"<{len(ids)}I", *ids), repr(t)
