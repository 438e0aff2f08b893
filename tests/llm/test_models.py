"""The models behind 1 and 10 against plain formulas: kernels from sets, gradients from finite differences."""

import numpy as np
import pytest

from capsift.llm import langid, toxicity

WORDS = {"en": "the cat and dog went to house near river with their friends", "de": "der hund und die katze ging zu dem haus an fluss",
         "fr": "le chat et le chien sont dans la maison avec leurs amis près"}


def texts(n, seed):
    rng = np.random.default_rng(seed)
    labels = np.arange(n) % len(WORDS)
    spoken = [WORDS[lang].split() for lang in sorted(WORDS)]
    return [" ".join(rng.choice(spoken[k], rng.integers(1, 30))) for k in labels], labels


def grams(text):
    """Distinct n-grams of 1 to 4 folded bytes, by their bin."""
    folded = [ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 if b < 128 else b for b in text.encode()]
    return {((int.from_bytes(bytes(folded[i:i + n]), "big") + n) * 2654435769 % 2**32) >> 17
            for n in range(1, 5) for i in range(len(folded) - n + 1)}


def kernel(a, b):
    return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])


def bits_of(lines):
    raw = [line.encode() for line in lines]
    offsets = np.concatenate([[0], np.cumsum([len(line) for line in raw])]).astype(np.int64)
    return langid.presence(np.frombuffer(b"".join(raw), np.uint8), offsets)


def test_margins_equal_ridge_regression_on_set_kernels():
    learned, labels = texts(60, 1)
    landmarks = np.arange(0, 60, 4)
    model = langid.Model(sorted(WORDS), np.packbits(bits_of(learned), axis=1), labels, landmarks)
    sets = [grams(text) for text in learned]
    marks = [sets[i] for i in landmarks]
    k_mm, k_nm = kernel(marks, marks), kernel(sets, marks)
    assert np.linalg.matrix_rank(k_mm) == len(marks)
    wanted = np.where(labels[:, None] == np.arange(3), 1.0, -1.0)
    alpha = np.linalg.solve(k_nm.T @ k_nm + langid.RIDGE * len(sets) * k_mm, k_nm.T @ wanted)
    unseen, answers = texts(40, 2)
    want = kernel([grams(text) for text in unseen], marks) @ alpha
    got = model.margins(bits_of(unseen))
    assert np.allclose(got, want, atol=2e-3)
    assert (got.argmax(1) == want.argmax(1)).all() and (got.argmax(1) == answers).mean() > 0.9


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def objective(theta, p, u, prior, turned):
    """The non-negative risk as it is minimised: the whole risk, or the negative part turned round."""
    p_out, u_out = sigmoid(p @ theta[:-1] + theta[-1]), sigmoid(u @ theta[:-1] + theta[-1])
    negative = u_out.mean() - prior * p_out.mean()
    ridge = toxicity.RIDGE * theta[:-1] @ theta[:-1] / 2
    return (-negative if turned else prior * (1 - p_out).mean() + negative) + ridge, negative


@pytest.mark.parametrize("prior, rate", [(0.1, 0.05), (0.4, 0.6)])
def test_training_follows_the_gradient_of_the_risk(monkeypatch, prior, rate):
    monkeypatch.setattr(toxicity, "STEPS", 40)
    monkeypatch.setattr(toxicity, "RATE", rate)
    rng = np.random.default_rng(3)
    p = [np.flatnonzero(rng.random(12) < [0.7] * 8 + [0.3] * 4) for _ in range(60)]
    u = [np.flatnonzero(rng.random(12) < [0.1] * 8 + [0.3] * 4) for _ in range(300)]
    used = np.flatnonzero(toxicity.telling(p, u, prior))
    assert 4 <= len(used) <= 12
    dense = lambda rows: np.array([np.isin(used, row) for row in rows], float)
    p_all, u_all = dense(p), dense(u)
    theta, first, second = np.append(np.zeros(len(used)), np.log(prior / (1 - prior))), 0.0, 0.0
    draw, turns = np.random.default_rng(7), 0
    p_batch = max(1, min(len(p), toxicity.BATCH // 4))
    for step in range(1, 41):
        p_now = p_all[draw.integers(0, len(p), p_batch)]
        u_now = u_all[draw.integers(0, len(u), min(len(u), toxicity.BATCH))]
        turned = objective(theta, p_now, u_now, prior, False)[1] < 0
        turns += turned
        h = 1e-5
        grad = np.array([(objective(theta + h * e, p_now, u_now, prior, turned)[0] - objective(theta - h * e, p_now, u_now, prior, turned)[0]) / (2 * h)
                         for e in np.eye(len(theta))])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (1 - step / 41) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model = toxicity.train(p, u, prior)
    assert np.allclose(model.weights[used], theta[:-1], atol=1e-3) and abs(model.bias - theta[-1]) < 1e-3
    assert not np.delete(model.weights, used).any()
    assert turns > 0 or prior < 0.2  # the larger prior reaches the turned branch
