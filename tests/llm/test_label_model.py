"""The label model of weak supervision on planted voters whose accuracies and correlations are known."""

import numpy as np
import pytest

from iotlens.llm.toxicity import label_model

RATES = np.array([[0.002, 0.45], [0.004, 0.4], [0.003, 0.5], [0.002, 0.35], [0.01, 0.5], [0.08, 0.08]])


def planted(seed, n=6000, rates=RATES, share=0.15):
    rng = np.random.default_rng(seed)
    toxic = rng.random(n) < share
    return rng, toxic, (rng.random((n, len(rates))) < np.where(toxic[:, None], rates[:, 1], rates[:, 0])).astype(float)


def by_hand(votes, rates, share):
    """Class posterior of independent voters of known rates."""
    both = [w * np.prod(np.where(votes > 0, rates[:, c], 1 - rates[:, c]), axis=1) for c, w in ((0, 1 - share), (1, share))]
    return both[1] / (both[0] + both[1])


@pytest.mark.parametrize("seed", [1, 2])
def test_rates_and_posteriors_of_independent_voters(seed):
    _, toxic, votes = planted(seed)
    post, rate, corr, share = label_model(votes, toxic)
    assert np.abs(rate[:-1] - RATES).max() < 0.05
    truth = by_hand(votes, RATES, 0.15)
    clear = (truth < 0.02) | (truth > 0.98)
    assert ((post > 0.5) == (truth > 0.5))[clear].mean() > 0.99
    assert np.abs(corr).max() < 0.2 and (share > 0.99).all()


def test_flipped_labels_follow_the_text():
    rng, toxic, votes = planted(3)
    flipped = rng.random(len(toxic)) < 0.1
    post, rate, _, _ = label_model(votes, toxic ^ flipped)
    truth = by_hand(votes, RATES, 0.15)
    clear = flipped & ((truth < 0.02) | (truth > 0.98))
    assert clear.sum() > 300
    assert ((post > 0.5) == (truth > 0.5))[clear].mean() > 0.97
    assert 0.8 < rate[-1, 1] < 0.95 and 0.03 < rate[-1, 0] < 0.2  # the label's own rates show the flips


def test_copies_of_a_voter_count_about_once():
    _, toxic, votes = planted(4)
    noisy = votes[:, [4]]
    copied = np.hstack([votes, *[noisy] * 4])
    post, _, corr, share = label_model(copied, toxic)
    same = [4, 6, 7, 8, 9]
    assert corr[np.ix_(same, same)][~np.eye(5, dtype=bool)].min() > 0.99
    assert share[same].sum() == pytest.approx(5 / (1 + 4 * 0.8), rel=0.02)
    assert (share[[0, 1, 2, 3, 5]] > 0.99).all()
    alone = label_model(votes, toxic)[0]
    assert ((post > 0.5) == (alone > 0.5)).mean() > 0.98


@pytest.mark.parametrize("n, label", [(0, []), (1, [1]), (3, [0, 0, 0]), (4, [1, 1, 0, 0])])
def test_small_and_silent_samples(n, label):
    post, rate, _, _ = label_model(np.zeros((n, 2)), np.array(label, bool))
    assert len(post) == n and np.isfinite(post).all() and np.isfinite(rate).all()
