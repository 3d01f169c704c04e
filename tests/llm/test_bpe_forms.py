"""Both forms of chunk reuse against the library; tokenizers of other kinds take its own path."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe

WORDS = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("form", [bpe.encode_decode, bpe.encode_decode_shared])
def test_forms_equal_the_library(docs, form):
    rng = random.Random(6)
    passage = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(900))
    texts = [None, "", " ", "a", "x" * 9000, passage, passage, f"Lead. {passage} Tail é!", passage[3:4000] + "\n" + passage, "<|endoftext|> it's\t" + passage]
    tokenizer = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in form(docs(texts), WORDS).collect()}
    for k, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[k] == (ids, tokenizer.decode(ids, skip_special_tokens=False)), k


def test_other_tokenizers_take_the_library_path():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, tokenizer = bpe.Encoder(path), Tokenizer.from_file(path)
    assert bpe.Encoder(WORDS).by_words and not encoder.by_words
    texts = ["Hello  world\n\n it's", "", "é" * 50]
    ids = encoder.batch([t.encode() for t in texts])
    assert ids.to_pylist() == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] and encoder.decode(ids).to_pylist() == texts


def test_words_of_two_generations(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 40)
    tokenizer, encoder = Tokenizer.from_file(WORDS), bpe.Encoder(WORDS)
    rng = random.Random(8)
    pool = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(300)]
    recalled = 0
    for _ in range(60):
        text = "usual words " + " ".join(rng.choices(pool, k=15)) + " usual end"
        before = set(encoder.words) | set(encoder.older)
        assert encoder.batch([text.encode()]).to_pylist() == [tokenizer.encode(text, add_special_tokens=False).ids]
        recalled += b"usual" in before
        assert len(encoder.words) <= 20 + 20 and len(encoder.older) <= 20 + 20
    assert recalled == 59, "words that are met again stay"
