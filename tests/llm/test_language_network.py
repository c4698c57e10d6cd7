"""The language network's forward pass and predictions against plain loops."""

import math
import random

import numpy as np

from cityloom.llm import langid


def brute_log_shares(net, window):
    """Every filter at every place, byte by byte."""
    vectors = [net.p["vector"][b] for b in window] + [np.zeros(langid.VECTOR)] * (net.reach - 1)
    hidden = []
    for f in range(len(net.p["bias"])):
        width = langid.WIDTHS[f // langid.FILTERS]
        weights = net.p["filters"][:, f].reshape(net.reach, langid.VECTOR)
        best = max(sum(float(weights[j][k]) * float(vectors[at + j][k]) for j in range(width) for k in range(langid.VECTOR)) for at in range(len(window)))
        hidden.append(max(best + float(net.p["bias"][f]), 0.0))
    z = [sum(h * float(w) for h, w in zip(hidden, net.p["out"][:, c])) + float(net.p["prior"][c]) for c in range(len(net.languages))]
    top = max(z)
    return [x - top - math.log(sum(math.exp(y - top) for y in z)) for x in z]


def test_forward_pass_and_predictions():
    rng = random.Random(4)
    net = langid.ByteConvNet(["aa", "bb", "cc"])
    net.p["bias"] += np.linspace(-0.5, 0.5, len(net.p["bias"])).astype(np.float32)
    words = {0: ["the", "and"], 1: ["über", "schön"], 2: ["ñan", "que"]}
    rows, labels = [], []
    for k in range(90):
        rows.append(langid.windows(" ".join(rng.choices(words[k % 3], k=8)).encode())[0])
        labels.append(k % 3)
    rows, labels = np.array(rows), np.array(labels)
    before = -net.log_shares(rows)[np.arange(90), labels].mean()
    net.fit(rows, labels, epochs=4)
    assert -net.log_shares(rows)[np.arange(90), labels].mean() < 0.5 * before
    short = np.array([np.frombuffer(bytes(rng.randrange(256) for _ in range(12)), np.uint8), np.frombuffer("schön que...".encode()[:12], np.uint8)])
    for row, fast, whole in zip(short, net.log_shares(short), net.forward(short)[0]):
        want = brute_log_shares(net, row.tolist())
        assert np.allclose(fast, want, atol=1e-4) and np.allclose(whole, want, atol=1e-4)
    text = "the and über " * 60
    langs, scores = net.predict([text, "", None, "12 !"])
    logs = net.log_shares(langid.windows(text.encode())).mean(0)
    assert langs == [net.languages[int(logs.argmax())], "und", "und", "und"] and scores[1:] == [0.0, 0.0, 0.0]
    assert abs(scores[0] - float(np.exp(logs[logs.argmax()]) / np.exp(logs).sum())) < 1e-5
