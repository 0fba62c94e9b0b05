"""Language ID holds the sums of a bounded number of words at a time, with the same results."""

import numpy as np

from papertrellis.llm import langid


def test_words_are_summed_so_many_at_a_time(monkeypatch):
    pieces = langid.Pieces(["▁", "▁a", "a", "b", "ab", "ba", "aba"])
    prob = np.random.default_rng(1).random((pieces.size, 2))
    words = ["▁" + w for w in ("a", "ab", "abab", "bba", "x", "aba" * 30, "baab", "b" * 12, "abx")]
    weight = np.random.default_rng(2).random((len(words), 2))
    logs, counts = pieces.log_sums(words, prob), pieces.expected(words, weight, prob)
    held, forward = [], langid.Pieces.forward
    monkeypatch.setattr(langid.Pieces, "forward", lambda self, some, p: held.append(len(some)) or forward(self, some, p))
    monkeypatch.setattr(langid, "WORDS", 3)
    assert np.array_equal(pieces.log_sums(words, prob), logs)
    assert np.allclose(pieces.expected(words, weight, prob), counts, rtol=1e-12)
    assert max(held) == 3 and sum(held) == 16
