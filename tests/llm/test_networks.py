"""The trained models' numbers against scalar loops."""

import math
import random

import numpy as np

from pulsegrid.llm import language_id, toxicity


def scalar_probabilities(net, window):
    """The forward pass, one number at a time: embed, filter at every place, maximum, ReLU, softmax."""
    e, widest = net.embedding.shape[1], net.widest
    hidden = []
    for f in range(net.filters.shape[1]):
        best = -math.inf
        for place in range(len(window) - widest + 1):
            total = 0.0
            for j in range(widest):
                for d in range(e):
                    total += float(net.embedding[window[place + j], d]) * float(net.filters[j * e + d, f])
            best = max(best, total)
        hidden.append(max(0.0, best + float(net.bias[f])))
    logits = [sum(h * float(net.dense[f, k]) for f, h in enumerate(hidden)) + float(net.dense_bias[k]) for k in range(len(net.languages))]
    top = max(logits)
    total = sum(math.exp(x - top) for x in logits)
    return [x - top - math.log(total) for x in logits]


def test_network_equals_a_scalar_forward_pass():
    rng = np.random.default_rng(1)
    net = language_id.ByteConvNet(["a", "b", "c"])
    windows = rng.integers(0, 256, (2, 24)).astype(np.uint8)
    windows[1, 10:] = 0
    net.dense[:] = rng.normal(size=net.dense.shape)
    got = net.log_probabilities(windows)
    for w, row in zip(windows, got, strict=True):
        assert np.allclose(row, scalar_probabilities(net, w.tolist()), atol=1e-4)


def test_network_gradients_equal_differences():
    rng = np.random.default_rng(2)
    net = language_id.ByteConvNet(["a", "b", "c"])
    net.dense[:] = rng.normal(size=net.dense.shape)
    windows, labels = rng.integers(1, 256, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    loss = lambda: -float(np.mean(net.log_probabilities(windows).astype(np.float64)[np.arange(6), labels]))
    for p, g in zip(net.parameters(), net._gradients(windows, labels), strict=True):
        flat = p.reshape(-1)
        order = np.argsort(-np.abs(g.reshape(-1)))[:3]  # the steepest are well above rounding
        for i in order.tolist():
            old, step = flat[i], np.float32(2e-3)
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * float(step)) - float(g.reshape(-1)[i])) <= 0.05 * abs(float(g.reshape(-1)[i])) + 2e-3


def test_ordinal_tails_and_order_equal_the_definition():
    rng = random.Random(3)
    n, features = 300, 5
    x = np.array([[rng.random() < 0.3 for _ in range(features)] for _ in range(n)], dtype=float)
    grade = np.array([min(2, int(row[0]) + int(row[1])) for row in x])
    model = toxicity.OrdinalModel(np.arange(features, dtype=np.uint64), 3)
    model.train(x, grade, np.ones(n))
    assert model.thresholds[0] < model.thresholds[1]
    kept = x[:, model.words.astype(int)] @ model.weights
    for s, row in zip(kept.tolist(), model.tails(kept), strict=True):
        want = [1 / (1 + math.exp(-(s - t))) for t in model.thresholds.tolist()]
        assert np.allclose(row, want) and row[0] >= row[1]
    # the expected severity, the sum of the tails, rises with the grade
    severity = model.tails(kept).sum(axis=1)
    means = [severity[grade == g].mean() for g in range(3)]
    assert means[0] < means[1] < means[2]
    assert set(model.words.tolist()) <= {0, 1}  # chance words have no weight
