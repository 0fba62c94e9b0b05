"""The encoder of the token file: chunks of a slice of texts are looked up once each, with the library's own ids."""

import itertools
from collections import defaultdict

from papertrellis.llm import tokenfile


class Counting(defaultdict):
    looked = 0

    def __getitem__(self, key):
        self.looked += 1
        return super().__getitem__(key)


def test_a_chunk_is_looked_up_once():
    own = tokenfile.Encoder(tokenfile.VOCABULARY)
    own.number = Counting(itertools.count().__next__)
    texts = ["some words and some words " * 200 + "end", None, "", " lead", "a  b", "\tx\x7f y\x00", "é à <|x|> b", "end ", "日本 語 a"]
    for given in (texts, [None, ""], [], texts[::-1]):
        want = [x.ids for x in own.tokenizer.encode_batch([t or "" for t in given], add_special_tokens=False)]
        assert [x.tolist() for x in own.encode(given)] == want
    assert own.number.looked < 100


class Counted:
    """A tokenizer whose model counts how often it is called."""

    def __init__(self, own):
        self.own, self.model, self.calls = own, self, 0

    def tokenize(self, text):
        self.calls += 1
        return self.own.model.tokenize(text)

    def encode_batch(self, texts, **named):
        return self.own.encode_batch(texts, **named)


def test_different_parts_go_to_the_model_together():
    own = tokenfile.Encoder(tokenfile.VOCABULARY)
    own.tokenizer = Counted(own.tokenizer)
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "ÿéßklmnopq" for c in "rstuvwxyzÿ"]
    texts = [" ".join(words), "ÿ ÿÿ.ÿ\n\nÿ\x00 \x7f", "日本 " + " 語 ÿ, ".join(words[:40]) + ",\n\n", "a<|b|>c d.\n\ne  f", ""]
    want = [x.ids for x in own.tokenizer.own.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in own.encode(texts)] == want
    assert own.tokenizer.calls < 100
