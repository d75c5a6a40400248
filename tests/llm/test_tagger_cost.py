"""The tagger reads all of every text for less than the plain form of its network costs, and finds the same spans."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from leafmill.llm import pii


def plain_states(tagger, ids, d):
    """The recurrence as it is defined: steps x windows -> steps x windows x hidden values, forward in ``ids``."""
    n, size = ids.shape[1], pii.HIDDEN
    h, c, out = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32), []
    for row in ids:
        a = tagger.p[f"{d}x"][row] + h @ tagger.p[f"{d}h"]
        i, f, o = (np.clip(0.25 * a[:, k * size : (k + 1) * size] + 0.5, 0, 1) for k in range(3))
        c = f * c + i * np.clip(a[:, 3 * size :], -1, 1)
        h = o * np.clip(c, -1, 1)
        out.append(h)
    return np.array(out)


def plain_spans(tagger, text):
    """Every window by itself, emissions averaged over windows, one Viterbi pass over the text."""
    ids, step = pii.classes(text), pii.WINDOW - pii.OVERLAP
    sums, weight = np.zeros((len(text), len(pii.LABELS))), np.zeros((len(text), 1))
    for at in range(0, max(1, len(text) - pii.OVERLAP) if text else 0, step):
        part = ids[at : at + pii.WINDOW, None]
        both = np.concatenate([plain_states(tagger, part, "f"), plain_states(tagger, part[::-1], "b")[::-1]], 2)[:, 0]
        tent = np.minimum(np.arange(1, len(part) + 1), np.arange(len(part), 0, -1))[:, None]
        sums[at : at + len(part)] += (both @ tagger.p["out"] + tagger.p["out_b"]) * tent
        weight[at : at + len(part)] += tent
    border = np.where(np.arange(len(pii.LABELS)) == 0, 0.0, -1e4)[None]
    e = sums / weight if text else sums
    e[:, 1::2] -= pii.CAUTION
    (labels,) = tagger.viterbi([np.concatenate([border, e, border]).astype(np.float32)])
    labels, out = labels[1:-1], []
    for start in np.flatnonzero(labels % 2 == 1).tolist():
        end = start + 1
        while end < len(labels) and labels[end] == labels[start] + 1:
            end += 1
        out.append((pii.LABELS[labels[start]][2:], start, end))
    return out


def texts(r, lengths):
    every = "\n".join(t for t, _ in pii.labelled_sentences(400, seed=5))
    starts = [r.randrange(len(every) - n) for n in lengths]
    return [every[a : a + n] for a, n in zip(starts, lengths)]


LENGTHS = [0, 1, 31, 32, 33, 479, 480, 481, 511, 512, 513, 514, 543, 544, 545, 992, 993, 2000, 5000, 40, 300, 1025]


@pytest.mark.parametrize("together", [1, 7, 360])
@pytest.mark.parametrize("seed", range(3))
def test_spans_are_those_of_one_pass_over_all_scores(monkeypatch, seed, together):
    """With any weights, many spans that cross windows' borders among them, and however many windows are read together."""
    monkeypatch.setattr(pii, "TOGETHER", together)
    tagger, r = pii.Tagger(seed), random.Random(seed)
    tagger.p["trans"] = np.random.default_rng(seed).uniform(-1, 1, tagger.p["trans"].shape).astype(np.float32)
    tagger.p["out"] *= 6
    tagger.p["out_b"] = np.random.default_rng(seed).normal(0, 1, len(pii.LABELS)).astype(np.float32)
    tagger.p["out_b"][0] += 2 * seed
    several = texts(r, LENGTHS)
    want = [plain_spans(tagger, t) for t in several]
    crossing = sum(a % 480 < 32 <= b % 480 or a // 480 < b // 480 for spans in want for _, a, b in spans)
    assert sum(map(len, want)) > 100 and crossing > 3
    got = pii.decoded(tagger, several)
    assert sum(len(set(a) ^ set(b)) for a, b in zip(got, want)) <= 0.002 * sum(map(len, want))


def test_trained_spans_and_their_cost(spark):
    """Before, decoding cost half as much again as the plain recurrence does by itself."""
    tagger, r = pii.trained(spark), random.Random(9)
    several = texts(r, LENGTHS)
    assert pii.decoded(tagger, several) == [plain_spans(tagger, t) for t in several]
    prose = [" ".join(r.choice(pii.PROSE) for _ in range(500)) for _ in range(150)]
    size = sum(map(len, prose))
    ids = pii.classes("".join(prose))[: 240 * (size // 240)].reshape(240, -1).T[:512]
    cost, plain = [], []
    for _ in range(4):
        start = time.process_time()
        pii.decoded(tagger, prose)
        middle = time.process_time()
        for d in "fb":
            plain_states(tagger, ids, d)
        cost.append((middle - start) / size)
        plain.append((time.process_time() - middle) / ids.size)
    print(f"decoding {min(cost) * 1e6:.2f}, plain recurrence {min(plain) * 1e6:.2f} CPU microseconds a code point")
    assert min(cost) < 1.2 * min(plain)
