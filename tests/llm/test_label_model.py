"""The label model on simulated voters whose accuracies and correlations are known."""

import numpy as np

from tallyhouse.llm import toxicity
from tallyhouse.llm.label_model import LabelModel

RNG = np.random.default_rng(12)
YES, NO = (0.9, 0.8, 0.7, 0.6), (0.05, 0.1, 0.2, 0.3)


def simulated(n=40_000, prior=0.3, copies=0):
    """Votes of independent voters, and of copies of the third one that repeat it nine times in ten."""
    truth = RNG.random(n) < prior
    votes = [np.where(RNG.random(n) < np.where(truth, y, x), 1, 0) for y, x in zip(YES, NO)]
    for _ in range(copies):
        fresh = np.where(RNG.random(n) < np.where(truth, YES[2], NO[2]), 1, 0)
        votes.append(np.where(RNG.random(n) < 0.9, votes[2], fresh))
    return truth, np.stack(votes, axis=1)


def fitted(votes, prior=0.5):
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    k = votes.shape[1]
    return LabelModel(prior, [(0.7, 0.3)] * k, [(0.3, 0.7)] * k).fit([tuple(map(int, p)) for p in patterns], counts)


def test_accuracies_and_share():
    truth, votes = simulated()
    model = fitted(votes)
    assert np.allclose(model.table[1, :, 2], YES, atol=0.06) and np.allclose(model.table[0, :, 2], NO, atol=0.06)
    assert abs(model.prior - truth.mean()) < 0.06


def test_a_copy_is_found_and_counts_for_less():
    """One copy; a crowd of copies that outvotes all others would pass for the class itself."""
    truth, votes = simulated(copies=1)
    model = fitted(votes)
    assert model.correlation[2, 4] > 0.5 and abs(model.correlation[0, 1]) < 0.2
    assert model.weight[[2, 4]].max() < 0.8 < model.weight[[0, 1, 3]].min()
    right = (model.posterior([tuple(map(int, v)) for v in votes]) >= 0.5) == truth
    assert right.mean() > 0.85


def test_no_patterns_leave_the_start():
    model = LabelModel(0.2, [(0.6, 0.1)], [(0.1, 0.6)]).fit([], [])
    assert model.prior == 0.2 and abs(model.table[1, 0, 2] - 0.6) < 1e-9


def test_terms_of_several_words_and_nested_fronts():
    """A front that several distinct words share is a term of its own; fronts that say the same as a longer term go."""
    found = toxicity.terms_of("Achlicht achlichen achlichen achlichau x")
    assert {"^achl", "2^achlic", "3^achlic"} <= found and "4^achlic" not in found and "achlicht" in found
    kept = toxicity.apart([("3^achl", 9, 0), ("3^achli", 9, 0), ("3^achlic", 9, 0), ("^achl", 12, 1), ("^ount", 6, 0), ("ounting", 6, 0), ("2^achl", 9, 0)])
    assert kept == ["3^achlic", "^achl", "ounting", "2^achl"]
    numbers = {t: k for k, t in enumerate(kept)}
    assert toxicity.features_of("achlicht achlichen achlichau ounting", numbers)[0] == [0, 1, 2, 3]
    assert toxicity.lexicon_of(["a", "b", "c", "d", "^aaaa", "^bbbb", "2^aaaa", "3^aaaa"]) == [0, 1, 2, 3, 4, 5, 6, 7]
