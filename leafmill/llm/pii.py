"""Personal data: exact base patterns, and a character-level bidirectional LSTM with a CRF on top.

The base kinds (email, ip, card, phone) are matched by rule; their spans always stay. The model, trained in
numpy from labelled spans, adds what no rule of this module finds: the base kinds in other notations (``name at host dot
com``, numbers in words, a card inside a longer run of digits), and the further kinds ``ssn``, ``iban``, ``name``,
``address``, ``handle`` and ``birth``.

*Windows.* The network reads the whole of every text, in windows of ``WINDOW`` code points; each overlaps the next by ``OVERLAP``.
*Reconciling.* Where windows overlap, their emission scores are averaged with weights that fall off towards a window's
ends, and one Viterbi pass over the text decodes them, so that a span is never cut at a window's border. Where the label O
leads by more than all transitions together could make up for, the best path surely passes through it; the pass
skips these stretches and gives the same labels.

A decoded span is added if it overlaps no other span. Numbers that carry check digits (cards, IBANs) must pass their
check; there is no other condition on a span's form. The weights are trained once, and kept as a table in the shared folder.

Defined results: null and empty text have no spans. Texts of any length are taken whole. Of overlapping spans the base one
stays, of added ones that of the earlier kind as listed. Repeated rows get equal spans. An empty table gives no rows. Only the
id and the text are read, so further columns may have any name.
"""

from __future__ import annotations

import bisect
import hashlib
import inspect
import itertools
import math
import pickle
import random
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, rows, shared_dir

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "name", "address", "handle", "birth")
BASE = KINDS[:4]
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, OVERLAP = 512, 32
HIDDEN = 16
#: Taken from the score of a span's first label when texts are decoded: clean text is far more common there than among the
#: labelled sentences.
CAUTION = 4.0
#: Windows that go through the network together, about: few enough that the linear algebra library does not share a matrix product among
#: threads, whose waiting costs twice the time, and that what a step works on stays in the processor's cache.
TOGETHER = 360
#: Positions, about, whose scores are summed at once.
CACHED = 8192
#: A span can pay if it gains more: less than nothing by more than sums of single precision can be off.
PAYS = -0.05
#: Labelled sentences for training, and passes over them; code points of a training window.
SENTENCES, PASSES, BATCH, LESSON = 6000, 10, 128, 96

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match in a run of digits starts at the run's start: a later start would fail or succeed alike.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = str.maketrans("0123456789", "0246813579")
    return (sum(map(int, digits[-1::-2])) + sum(map(int, digits[-2::-2].translate(doubled)))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, in linear time: by kind as listed, then start."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# The network -------------------------------------------------------------------------------------


def classes(text: str) -> np.ndarray:
    """Input class of each code point: printable ASCII as it is, two classes for other letters and the rest; 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.where((points >= 32) & (points < 127), points - 31, np.where(points >= 128, 97, 96))
    return out


N_CLASSES = 98


_ROOM: dict[str, np.ndarray] = {}


def room(name: str, *shape: int) -> np.ndarray:
    """An array for a while, in memory kept for the next of that name: pages of fresh memory cost more than what is done in them."""
    size = math.prod(shape)
    if name not in _ROOM or len(_ROOM[name]) < size:
        _ROOM[name] = np.empty(size, np.float32)
    return _ROOM[name][:size].reshape(shape)


class Tagger:
    """A table of input weights, one LSTM in each direction, linear emissions and CRF transitions; float32.

    Sigmoid and tanh are taken in their piecewise linear forms, which cost a fraction of the exact ones.
    """

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        h, k = HIDDEN, len(LABELS)
        self.p = {"out": r.normal(0, 0.2, (2 * h, k)), "out_b": np.zeros(k), "trans": np.zeros((k, k))}
        for d in "fb":  # a class's row: its share of the input, forget and output gates and of the candidate
            self.p[f"{d}x"] = r.normal(0, 0.5, (N_CLASSES, 4 * h)) + np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]
            self.p[f"{d}h"] = r.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}
        #: an I follows only the B or I of its kind
        self.allowed = np.array([[not b.startswith("I") or (a[2:] == b[2:] and a != "O") for b in LABELS] for a in LABELS])
        self.begins = np.array([not b.startswith("I") for b in LABELS])

    def _lstm(self, ids: np.ndarray, d: str, keep: list | None = None, size: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
        """ids: steps x windows -> steps x windows x hidden values of direction ``d``. Windows may be shorter than the longest (falling
        ``size``): each direction starts at a window's own end, and only the windows that have a step take part in it."""
        (steps, n), gates, units = ids.shape, 4, HIDDEN
        # a gate is clip(0.25 x + 0.5, 0, 1) and a candidate 2 clip(0.5 x + 0.5, 0, 1) - 1: scaled beforehand, one clip serves all
        scaled = np.repeat(np.array([0.25, 0.25, 0.25, 0.5], np.float32), units)
        table, wh = self.p[f"{d}x"] * scaled + np.float32(0.5), self.p[f"{d}h"] * scaled
        # each gate has rows of its own, so that sums run over adjacent numbers
        table, whole, wh = table.reshape(-1, units), wh, np.ascontiguousarray(wh.reshape(units, gates, units).swapaxes(0, 1))
        at = np.ascontiguousarray(ids)[:, None] * gates + np.arange(gates)[:, None]
        h, c, new, one = (np.full((n, units), v, table.dtype) for v in (0, 0, 0, 1))
        a, x = np.empty((gates, n, units), table.dtype), np.empty((gates, n, units), table.dtype)
        out = np.empty((steps, n, units), table.dtype) if out is None else out
        live = np.full(steps, n) if size is None else np.searchsorted(-size, -np.arange(steps))
        k, (zero, top) = -1, np.array([0, 1], table.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            if k != live[t]:
                k = int(live[t])
                ak, xk, ck, nk, ok = a[:, :k], x[:, :k], c[:k], new[:k], one[:k]
                i, f, o, g = ak
            if keep is None:
                np.matmul(h[:k], wh, out=ak)
            else:  # one product, whose rounding the weights depend on
                ak[:] = (h @ whole).reshape(n, gates, units).swapaxes(0, 1)
            ak += table.take(at[t, :, :k], axis=0, out=xk, mode="clip")
            ak.clip(zero, top, out=ak)
            before = c.copy() if keep is not None else None
            np.add(g, g, out=nk)
            nk -= ok
            nk *= i
            ck *= f
            ck += nk
            tc = ck.clip(-top, top, out=out[t, :k])
            if keep is not None:
                keep.append((a[:3].swapaxes(0, 1).reshape(n, 3 * units), 2 * g - 1, before, tc.copy(), h))
            tc *= o
            out[t, k:] = 0.0
            h = out[t]
        return out

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """ids: steps x windows -> steps x windows x labels."""
        kf, kb = ([], []) if keep is not None else (None, None)
        there, back = self._lstm(ids, "f", kf), self._lstm(ids, "b", kb)
        if keep is not None:
            keep.update(both=np.concatenate([there, back], 2), f=kf, b=kb)
        out = there @ self.p["out"][:HIDDEN]
        out += back @ self.p["out"][HIDDEN:]
        out += self.p["out_b"]
        return out

    def gains(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For windows of falling ``size``: what each kind's B, then each kind's I, scores over O, with the best that transitions can
        add (``transitions``). As steps x labels x windows."""
        steps, n = ids.shape
        there = self._lstm(ids, "f", size=size, out=room("there", steps, n, HIDDEN))
        back = self._lstm(ids, "b", size=size, out=room("back", steps, n, HIDDEN))
        labels = [*range(1, len(LABELS), 2), *range(2, len(LABELS), 2)]
        over = (self.p["out"] - self.p["out"][:, :1])[:, labels].T
        constant = (self.p["out_b"] - self.p["out_b"][0])[labels] + self.transitions() - np.repeat([CAUTION, 0], len(KINDS))
        wf, wb, constant = over[:, :HIDDEN].copy(), over[:, HIDDEN:].copy(), constant.astype(np.float32)[:, None]
        out, most = room("gains", steps, len(labels), n), max(1, CACHED // 2 // n)
        for t in range(0, steps, most):
            e = np.matmul(wf, there[t : t + most].swapaxes(1, 2), out=out[t : t + most])
            e += np.matmul(wb, back[t : t + most].swapaxes(1, 2), out=room("share", *e.shape))
            e += constant
        return out

    def transitions(self) -> np.ndarray:
        """The best that transitions can add to a span's B, for each kind, and to each I."""
        _, enter, stay, leave = self._gains()
        return np.r_[enter + leave, stay].astype(np.float32)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of the CRF and its gradients: scaled forward and backward sums, then back-propagation through time."""
        keep: dict = {}
        e = self.emissions(ids, keep).astype(np.float64)
        steps, n, k = e.shape
        top = e.max(2)
        x, step = np.exp(e - top[:, :, None]), np.where(self.allowed, np.exp(self.p["trans"].astype(np.float64)), 0.0)
        alpha, beta, scale = np.empty_like(x), np.ones_like(x), np.empty((steps, n))
        for t in range(steps):
            alpha[t] = x[t] * (alpha[t - 1] @ step if t else self.begins)
            scale[t] = alpha[t].sum(1)
            alpha[t] /= scale[t][:, None]
        for t in range(steps - 2, -1, -1):
            beta[t] = (x[t + 1] * beta[t + 1]) @ step.T / scale[t + 1][:, None]
        de = alpha * beta
        dtrans = step * np.einsum("tni,tnj->ij", alpha[:-1], x[1:] * beta[1:] / scale[1:, :, None], optimize=True)
        at, row = np.meshgrid(np.arange(steps), np.arange(n), indexing="ij")
        gold = e[at, row, tags].sum(0) + self.p["trans"][tags[:-1], tags[1:]].sum(0)
        loss = float((np.log(scale).sum(0) + top.sum(0) - gold).mean())
        de[at, row, tags] -= 1
        np.add.at(dtrans, (tags[:-1].ravel(), tags[1:].ravel()), -1)
        de = (de / n).astype(np.float32)
        grads = {"trans": np.where(self.allowed, dtrans / n, 0), "out": np.tensordot(keep["both"], de, ((0, 1), (0, 1))), "out_b": de.sum((0, 1))}
        dboth, size = de @ self.p["out"].T, HIDDEN
        for d, part, seen in (("f", dboth[:, :, :size], ids), ("b", dboth[::-1, :, size:], ids[::-1])):
            wh = self.p[f"{d}h"]
            das = np.empty((steps, n, 4 * size), np.float32)
            dh = dc = np.zeros((n, size), np.float32)
            gh = np.zeros_like(wh)
            for t in range(steps - 1, -1, -1):
                gates, g, before, tc, h = keep[d][t]
                i, f, o = np.split(gates, 3, 1)
                dh = dh + part[t]
                dc = dc + dh * o * (np.abs(tc) < 1)
                da = das[t]
                da[:, :size], da[:, size : 2 * size], da[:, 2 * size : 3 * size] = dc * g, dc * before, dh * tc
                da[:, : 3 * size] *= 0.25 * ((gates > 0) & (gates < 1))
                da[:, 3 * size :] = dc * i * (np.abs(g) < 1)
                gh += h.T @ da
                dh, dc = da @ wh.T, dc * f
            by_class = np.zeros((seen.size, N_CLASSES), np.float32)
            by_class[np.arange(seen.size), seen.ravel()] = 1
            grads[f"{d}h"], grads[f"{d}x"] = gh, by_class.T @ das.reshape(-1, 4 * size)
        return loss, grads

    def fit(self, ids: np.ndarray, tags: np.ndarray, passes: int | None = None) -> list[float]:
        """Adam with gradient clipping over windows x steps arrays; the loss of each pass."""
        r, passes = np.random.default_rng(1), passes or PASSES
        m, v, t, losses = {}, {}, 0, []
        for turn in range(passes):
            order, total = r.permutation(len(ids)), 0.0
            for at in range(0, len(ids), BATCH):
                rows = order[at : at + BATCH]
                loss, grads = self.gradients(ids[rows].T, tags[rows].T)
                total += loss * len(rows)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                t += 1
                rate = 0.02 * (1 - 0.95 * turn / max(1, passes - 1))
                for name, g in grads.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * g * g
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
                np.clip(self.p["trans"], -1, 1, out=self.p["trans"])  # emissions decide; see ``_sure``
            losses.append(total / len(ids))
        return losses

    def viterbi(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels for the emissions of each stretch (length x labels), all stretches step by step together."""
        trans = np.where(self.allowed, self.p["trans"], -1e4).astype(np.float32).T.copy()  # to x from
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
        order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
        at = 0
        while at < len(order):  # of about equal lengths, a few megabytes at a time
            longest = len(parts[order[at]])
            n = at + 1
            while n < len(order) and len(parts[order[n]]) * 2 > longest and (n - at) * longest < 1 << 15:
                n += 1
            these, at = order[at:n], n
            size = np.array([len(parts[k]) for k in these])
            e = np.zeros((longest, len(these), len(LABELS)), np.float32)
            for j, k in enumerate(these):
                e[: size[j], j] = parts[k]
            score = np.where(self.begins, e[0], -1e4)
            back, last, to = np.zeros(e.shape, np.int8), np.empty(len(these), np.int64), np.empty(e.shape[1:], np.int64)
            live = [*np.searchsorted(-size, -np.arange(longest)).tolist(), 0]  # sizes fall
            for t in range(longest):
                k = live[t]
                if t:
                    both = score[:k, None, :] + trans
                    both.argmax(2, out=to[:k])
                    back[t, :k] = to[:k]
                    np.add(both.max(2), e[t, :k], out=score[:k])
                if live[t + 1] < k:
                    last[live[t + 1] : k] = score[live[t + 1] : k].argmax(1)
            labels, nth = np.empty((longest, len(these)), np.int64), np.arange(len(these))
            for t in range(longest - 1, -1, -1):
                if k := live[t + 1]:
                    last[:k] = back[t + 1, nth[:k], last[:k]]
                labels[t] = last
            for j, k in enumerate(these):
                out[k] = labels[: size[j], j]
        return out

    def _gains(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The I labels, and for each kind the best that transitions can add when a span is entered, goes on and is left, over O in its place."""
        trans, n = self.p["trans"].astype(np.float64), len(LABELS)
        inner = np.arange(2, n, 2)
        others = [k for k in range(n) if not LABELS[k].startswith("I")]
        enter = (trans[:, inner - 1] - trans[:, :1]).max(0)
        stay = np.maximum(trans[inner - 1, inner], trans[inner, inner]) - trans[0, 0]
        leave = np.maximum((trans[inner - 1][:, others] - trans[0, others]).max(1), (trans[inner][:, others] - trans[0, others]).max(1))
        return inner, enter, stay, leave

    def _open(self, e: np.ndarray) -> np.ndarray:
        """Positions that a span of a best path can cover.

        A span pays only if its labels' scores, with the best transitions that it can have, exceed those of O in its place; otherwise
        the path with O there is as good. The best span through a position follows from running sums and maxima.
        """
        inner, enter, stay, leave = self._gains()
        over = e.T.astype(np.float64)  # in rows of labels
        over -= over[0]
        sums = np.cumsum(over[inner] + stay[:, None], 1)
        start = np.maximum.accumulate(over[inner - 1] + enter[:, None] - sums, 1)
        rest = np.maximum.accumulate(sums[:, ::-1], 1)[:, ::-1]
        return (start + rest + leave[:, None] > -1e-3).any(0)  # the sums up to the position cancel out

    def best(self, emitted: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each text, as one Viterbi pass over it gives them; stretches that no span can cover are not entered.

        The texts are laid end to end, with a position that only O can have before and after each.
        """
        if not emitted:
            return []
        border = np.full((1, len(LABELS)), -1e4, np.float32)
        border[0, 0] = 0.0
        e = np.concatenate([border, *(x for part in emitted for x in (part, border))])
        # a few texts at a time, whose arrays stay in the processor's cache
        ends, cuts = np.cumsum([len(x) + 1 for x in emitted]), [0]
        for end in ends.tolist():
            if end - cuts[-1] >= CACHED:
                cuts.append(end)
        cuts = [*cuts, len(e)] if cuts[-1] < len(e) else cuts
        open_ = np.concatenate([self._open(e[a:b]) for a, b in zip(cuts, cuts[1:])])
        edge = np.flatnonzero(np.diff(np.r_[False, open_, False].astype(np.int8)))
        ends = [(max(0, a - 1), min(len(e), b + 1)) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        out = np.zeros(len(e), np.int64)
        for (a, b), labels in zip(ends, self.viterbi([e[a:b] for a, b in ends])):
            out[a:b] = labels
        return [x[:-1] for x in np.split(out[1:], np.cumsum([len(x) + 1 for x in emitted])[:-1])]


def covered(begin: np.ndarray, inner: np.ndarray, reached: np.ndarray | float = -np.inf, goes_on: np.ndarray | float = 0.0) -> np.ndarray:
    """Positions (rows) in a span that pays: one that gains ``begin`` at its first position and ``inner`` at the others. Spans may come from
    before with a gain of ``reached``, and go on behind for one of ``goes_on``. Columns are kinds."""
    sums = np.cumsum(inner, 0, dtype=np.float64)
    start = np.maximum(np.maximum.accumulate(begin - sums, 0), reached)
    rest = np.maximum(np.maximum.accumulate(sums[::-1], 0)[::-1], sums[-1] + goes_on)
    return (start + rest > PAYS).any(1)  # the sums up to the position cancel out


def coverable(gains: np.ndarray, own: np.ndarray, before: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps and windows of all positions that a span of a best path can cover, as ``Tagger._open`` finds them in one text.

    Of each window the first ``own`` positions count; it follows window ``before`` (none: -1) and is the ``nth`` of its text. All windows
    and kinds are walked together, there for the best span that reaches a position and back for the most that its rest can gain. Windows
    between which a span can pay are looked at again, with what goes in and out of them.
    """
    steps, _, n = gains.shape
    begin, inner = gains[:, : len(KINDS)], gains[:, len(KINDS) :]
    best, zero = room("best", *begin.shape), np.zeros(begin.shape[1:], np.float32)
    reach, rest, by_end = zero - np.inf, zero.copy(), {}
    for w, end in enumerate(own.tolist()):
        by_end.setdefault(end - 1, []).append(w)
    for t in range(steps):
        reach = np.maximum(np.add(reach, inner[t], out=best[t]), begin[t], out=best[t])
    followed = WINDOW - OVERLAP
    reach = best[min(followed, steps) - 1].copy()
    for t in range(steps - 1, -1, -1):
        if t in by_end:
            rest[:, by_end[t]] = 0.0
        best[t] += rest
        rest += inner[t]
        np.maximum(rest, zero, out=rest)
    open_ = best.max(1) > PAYS
    if nth.any():
        total, reached, goes_on = inner[:followed].sum(0), zero - np.inf, zero.copy()
        by_turn = [np.flatnonzero(nth == k) for k in range(1, nth.max() + 1)]
        for w in by_turn:
            reached[:, w] = np.maximum(reach[:, before[w]], reached[:, before[w]] + total[:, before[w]])
        for w in reversed(by_turn):
            goes_on[:, before[w]] = np.maximum(rest[:, w], goes_on[:, w] + np.where(own[w] == followed, total[:, w], -np.inf))
        later = np.flatnonzero(nth)
        crossed = later[(reached[:, later] + goes_on[:, before[later]] > PAYS).any(0)]
        for w in np.union1d(crossed, before[crossed]).tolist():
            open_[: own[w], w] |= covered(begin[: own[w], :, w], inner[: own[w], :, w], reached[:, w], goes_on[:, w])
    return np.nonzero(open_ & (np.arange(steps)[:, None] < own))


# Labelled spans ----------------------------------------------------------------------------------


# What the sentences are made of (fixed values). Tests hold other names, streets and phrases out.
FIRST = "Anna Peter Maria John Laura Thomas Julia David Sofia Martin Elena Paul Carmen Lukas Emma Hans Claire Pablo Nina Robert Ines Oliver Marta George Sarah Jean Karl Lucia Mark Alice".split()
LAST = "Miller Schmidt Garcia Dupont Brown Weber Lopez Martin Fischer Moreau Jones Becker Ruiz Bernard Wilson Koch Vidal Petit Clark Wolf Serra Roux Adams Braun Costa Girard Evans Keller Blanco Fournier".split()
CUES = {
    "name": "my name is {}|name: {}|Mr. {}|Mrs. {}|Dr. {}|ask for {}|signed, {}|contact {}|ich heiße {}|Frau {}|Herr {}|je m'appelle {}|Madame {}|M. {}|me llamo {}|señora {}|customer: {}|patient {}|{} wrote:|regards, {}|from: {}|sincerely, {}|dear {},|hi {},|hello {}!|Sehr geehrte Frau {}|Sehr geehrter Herr {}|Liebe {},|Mit freundlichen Grüßen {}|Viele Grüße, {}|Cordialement, {}|Bonjour {},|chère {}|Estimado {}|Saludos, {}|Atentamente, {}|{} told us|{} said that|I met {}|spoke with {}|written by {}|thanks to {}|invoice for {}|{} lives in|{} called|our colleague {}|habló con {}|avec {}|mit {} gesprochen|{} hat angerufen|employee: {}|{} signed the form".split("|"),
    "address": "lives at {}|address: {}|ship to {}|moved to {}|wohnt in der {}|Adresse: {}|habite au {}|vive en {}|send it to {}|home address {}|delivered to {}|office at {}".split("|"),
    "handle": "follow {}|twitter: {}|find me as {}|dm {}|instagram {}|telegram: {}|{} on github|ping {}|my handle is {}|user {}".split("|"),
    "birth": "born on {}|date of birth: {}|dob {}|geboren am {}|née le {}|nacido el {}|birthday: {}|DOB: {}|birth date {}|born {}".split("|"),
    "phone": "call {}|phone: {}|tel. {}|ring me on {}|mobile {}|Telefon {}|my number is {}|fax {}|text {}|{}".split("|"),
    "email": "write to {}|mail {}|email: {}|reach me at {}|Mail an {}|contact: {}|e-mail {}|{}".split("|"),
    "ssn": "ssn {}|social security number {}|SSN: {}|{}".split("|"),
    "iban": "iban {}|account {}|Konto {}|IBAN: {}|transfer to {}|{}".split("|"),
    "card": "card {}|visa {}|paid with {}|Karte {}|card number: {}|{}".split("|"),
    "ip": "host {}|from {}|server {}|ip {}|{}".split("|"),
}
NUMBERS = ("zero oh one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun")
STREETS = ("{n} {w} Street", "{n} {w} Road", "{n} {w} Ave", "{n} {w} Lane", "{n} {w} Drive, {w}", "{w}straße {n}", "{w}weg {n}", "{w}str. {n}", "{n} rue de {w}", "{n} avenue {w}", "Calle {w} {n}", "Avenida {w} {n}", "{n} {w} Blvd", "{n} {w} St.", "PO Box {n}")
MONTHS = "January February March April May June July August September October November December Januar März Mai Juni Juli Oktober Dezember janvier février avril juin août enero marzo abril mayo julio".split()
FRAGMENTS = "ein eins zu zwei und un une der die das sich en er ver be ge ung heit keit lich sch ach tz the ing tion at ata on or to do dos dot ado la que con de der deux tre tri one ten two ate ight three five si sie ben acht ne neun null ze ro oh nin four com or net st re ed th an is".split()
PROSE = "the and of to in is was for with that on it as at by this from or be are which not have had were one two three all when there can will more no if out so up about time year day der die das und ist nicht ein eine mit auf für le la les et des un une est dans que pour el los del y en por con una".split()


def labelled_sentences(n: int = SENTENCES, seed: int = 0) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with the spans of personal data in them, among prose of real and invented words and look-alikes that are none."""
    r = random.Random(seed)
    pick = r.choice
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    syllables = "an er on de le ti ou mi ra sen tor bel ha ing ka lo vi che ung ción é ä ö ñ ß st th".split()
    letters = "eeeeaaaiiooutnnsrrldmchpgbvfzkqxjywéèàêçäöüßñóíúá"
    own: list[str] = []

    def language() -> None:
        """Other syllables for each sentence, so that no word form is learned as prose."""
        if r.random() < 0.4:  # of pieces that common words and number words share
            own[:] = r.sample(FRAGMENTS, r.randint(8, 30))
            return
        own[:] = syllables if r.random() < 0.15 else ["".join(r.choices(letters, k=r.randint(1, 4))) for _ in range(r.randint(8, 40))]

    language()
    made = lambda low=1, high=4: "".join(r.choices(own, k=r.randint(low, high)))
    plain = lambda low=1, high=3: "".join(r.choices("an er on de le ti ou mi ra sen tor bel ha ka lo vi".split(), k=r.randint(low, high)))

    upper, tail = 0.12, ""

    def word() -> str:
        w = pick(PROSE) if r.random() < 0.35 else made()
        return w.capitalize() if r.random() < upper else w.upper() if r.random() < 0.04 + 0.5 * (upper > 0.6) else w

    def prose(low: int, high: int) -> str:
        return " ".join(word() + (tail or pick(["", "", "", "", "", ",", ".", ":"])) for _ in range(r.randint(low, high)))

    def person() -> str:
        other = lambda: (plain(2) if r.random() < 0.4 else made(2, 3)).capitalize()
        first = pick(FIRST) if r.random() < 0.5 else other()
        last = pick(LAST) if r.random() < 0.5 else other()
        return pick(["{f} {l}", "{f} {l}", "{f} {l}", "{f} {i}. {l}", "{l}", "{f} {l}-{m}"]).format(f=first, l=last, i=pick("ABCDEFGHJKLMPRST"), m=pick(LAST))

    def card() -> str:
        body = pick("3456") + digits(14)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return pick(["", " ", "-", ".", " . ", "/"]).join(number[i : i + 4] for i in range(0, 16, 4))

    def iban() -> str:
        country, body = pick(["DE", "FR", "ES", "GB", "IT", "NL", "AT"]), digits(r.choice([14, 16, 18, 20]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        flat = f"{country}{check:02d}{body}"
        return flat if r.random() < 0.5 else " ".join(flat[i : i + 4] for i in range(0, len(flat), 4))

    def email() -> str:
        host = plain(2) + pick(["", "", digits(1)])
        top = pick("com org net de fr es io edu".split())
        user = pick(["{a}", "{a}.{b}", "{a}_{b}", "{a}{d}"]).format(a=plain(), b=plain(), d=digits(2))
        return pick(["{u}@{h}.{t}", "{u}@{h}.example.{t}", "{u} @ {h}.{t}", "{u}(at){h}.{t}", "{u} [at] {h} [dot] {t}", "{u} at {h} dot {t}", "{u} AT {h} DOT {t}", "{u}[at]{h}.{t}", "{u} (at) {h} (dot) {t}", "{u}@{h} .{t}"]).format(u=user, h=host, t=top)

    def phone() -> str:
        if r.random() < 0.35:
            names = pick(NUMBERS).split()
            return pick([" ", " ", "-", ", "]).join(pick(names) for _ in range(r.randint(7, 11)))
        return pick(["+1 ({a}) {b}-{c}", "({a}) {b}-{c}", "{a}-{b}-{c}", "+49 {a} {c}{b}", "0{a} / {c}{b}", "{a}.{b}.{c}", "0{a}-{c}{b}", "{a} {b} {c}", "0{p} {p} {q} {p} {q}"]).format(a=digits(3), b=digits(3), c=digits(4), p=digits(1) + pick("123456789"), q=digits(2))

    def birth() -> str:
        d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(1930, 2012)
        return pick([f"{d:02d}.{m:02d}.{y}", f"{m:02d}/{d:02d}/{y}", f"{y}-{m:02d}-{d:02d}", f"{d} {pick(MONTHS)} {y}", f"{pick(MONTHS)} {d}, {y}", f"{d}. {pick(MONTHS)} {y}"])

    makers = {
        "email": email, "ip": lambda: pick([".", ".", " . ", "[.]"]).join(str(r.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone,
        "ssn": lambda: pick(["{a}-{b}-{c}", "{a} {b} {c}"]).format(a=digits(3), b=digits(2), c=digits(4)), "iban": iban, "name": person,
        "address": lambda: pick(STREETS).format(n=r.randint(1, 999), w=plain(2).capitalize()), "handle": lambda: "@" + pick(["{a}", "{a}_{b}", "{a}{d}"]).format(a=plain(2), b=plain(), d=digits(2)), "birth": birth,
    }
    fakes = [
        lambda: digits(r.randint(1, 6)), lambda: f"Version {digits(1)}.{digits(1)}", lambda: f"on {birth()}", lambda: f"since {birth()}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(2)}.{digits(2)} %",
        lambda: "".join(pick("0123456789abcdef") for _ in range(pick([8, 24, 32, 40]))), lambda: f'token = "{digits(5)}ab{digits(9)}f"', lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"#{digits(6)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}",
        lambda: digits(r.randint(20, 40)), lambda: f"{pick(['meet', 'look', 'stop', 'arrive'])} at {made()} {word()}", lambda: f"{pick(PROSE)} at {made()} and {made()}", lambda: f"a dot {made()}", lambda: f"{pick(NUMBERS).split()[r.randint(2, 9)]} or {pick(NUMBERS).split()[r.randint(2, 9)]}",
        lambda: f"{made(2).capitalize()} {made(2).capitalize()}", lambda: f"{digits(2)} {made()}", lambda: f"{digits(3)} {made(2).capitalize()} {made()}", lambda: f"@{pick('media param return override import charset'.split())}", lambda: f"AKIA{digits(6)}", lambda: "https://www." + plain(2) + ".com/" + plain(),
        lambda: "| " + " | ".join(word() for _ in range(3)), lambda: "- " + prose(2, 5), lambda: prose(12, 20), lambda: "&&& $$$ ### !!", lambda: "\n\n", lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(4)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"chapter {digits(2)}.{digits(1)}.{digits(2)}",
    ]
    out: list[tuple[str, list[tuple[str, int, int]]]] = []
    for _ in range(n):
        language()
        upper, tail = pick([0.05, 0.12, 0.12, 0.3, 0.9]), pick([""] * 12 + ["!!", "###", " |", "$$$"])
        text, spans = prose(0, 6), []
        if r.random() < 0.4:  # prose alone, or one word over and over
            out.append((text + " " + (prose(20, 45) if r.random() < 0.7 else pick([" ", " ", ", ", "\n"]).join([" ".join(word() for _ in range(pick([1, 1, 1, 2, 3])))] * r.randint(4, 40))), spans))
            continue
        for _ in range(r.randint(1, 3)):
            text += pick([" ", " ", "\n", ""]) if text else ""
            if r.random() < 0.6:
                kind = pick(KINDS)
                value, (left, right) = makers[kind](), pick(CUES[kind]).split("{}")
                left = left.capitalize() if r.random() < 0.3 else left
                if text and not text[-1].isspace() and left == "":
                    text += " "
                text += left
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + right
                if kind == "card" and value.isdigit() and r.random() < 0.3:
                    text += " " + digits(r.randint(4, 8))  # a longer run, of which the card is a part
            else:
                if text and not text[-1].isspace():
                    text += " "
                text += pick(fakes)()
            text += pick([" ", " ", ". ", ", ", "### ", "\n", "; ", "!! "]) + prose(0, 5)
        out.append((text, spans))
    return out


def training_windows(sentences: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of input classes and labels, cut from the sentences in a row, so that they begin and end anywhere, as those of long
    texts do. A span that a window's start cuts is labelled from a fresh B on."""
    ids = np.concatenate([classes(text + "\n") for text, _ in sentences])
    tags, at = np.zeros(len(ids), np.int64), 0
    for text, spans in sentences:
        for kind, start, end in spans:
            b = LABELS.index(f"B-{kind}")
            tags[at + start], tags[at + start + 1 : at + end] = b, b + 1
        at += len(text) + 1
    starts = np.arange(0, len(ids) - LESSON + 1, LESSON - OVERLAP)[:, None] + np.arange(LESSON)
    x, y = ids[starts], tags[starts]
    cut = (y[:, 0] > 0) & (y[:, 0] % 2 == 0)
    y[cut, 0] -= 1
    return x, y


def _source() -> bytes:
    """The code that weights depend on, so that changed code trains anew."""
    return "".join(map(inspect.getsource, (classes, Tagger, labelled_sentences, training_windows))).encode()


_TRAINED: dict[tuple, Tagger] = {}


def trained(spark: SparkSession, n: int | None = None, seed: int = 0) -> Tagger:
    """A tagger trained on ``n`` labelled sentences, the same each time: by one task, once for a shared folder.

    The weights are a table there, named by what they depend on.
    """
    n = n or SENTENCES
    key = hashlib.sha256(repr((n, seed, PASSES, BATCH, LESSON, HIDDEN, KINDS, labelled_sentences(20, seed))).encode() + _source()).hexdigest()[:16]
    if (spark.sparkContext.applicationId, key) not in _TRAINED:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                tagger, sentences = Tagger(seed), labelled_sentences(n, seed)
                tagger.fit(*training_windows(sentences))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tagger.p)], pa.binary())], names=["p"])

        path = f"{shared_dir(spark)}/leafmill/models/tagger-{key}"
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there):
            # under a name of its own first: of two applications that train at once, one gives its table the name, and both have equal weights
            made = f"{path}-{uuid.uuid4().hex}"
            spark.range(0, 1, 1, 1).mapInArrow(run, "p binary").write.parquet(made)
            fs, as_path = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), spark._jvm.org.apache.hadoop.fs.Path
            if fs.exists(there) or not fs.rename(as_path(made), as_path(path)):
                fs.delete(as_path(made), True)
        tagger = Tagger(seed)
        tagger.p = pickle.loads(spark.read.schema("p binary").parquet(path).first()[0])
        _TRAINED[spark.sparkContext.applicationId, key] = tagger
    return _TRAINED[spark.sparkContext.applicationId, key]


# Decoding ----------------------------------------------------------------------------------------


def tent(n: int | np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weights of positions ``at`` of windows of ``n`` code points."""
    return np.minimum(at + 1, n - at).astype(np.float32)


def stretches(tagger: Tagger, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Text, start and scores (positions x labels) of the stretches that spans of a best path can cover.

    Every code point of each text goes through the network, all windows together; scores over those of O are gathered where a span can pay.
    """
    step, ids = WINDOW - OVERLAP, [classes(t) for t in texts]
    windows = [(k, at, min(WINDOW, len(x) - at)) for k, x in enumerate(ids) if len(x) for at in range(0, max(1, len(x) - OVERLAP), step)]
    if not windows:
        return
    text, at, size = np.array(windows).T
    order = np.argsort(-size, kind="stable")
    column = np.argsort(order)
    text, at, size, before = text[order], at[order], size[order], np.where(at > 0, np.r_[-1, column[:-1]], -1)[order]
    x = np.zeros((len(windows), size[0]), np.int64)
    for row, k, a, n in zip(x, text.tolist(), at.tolist(), size.tolist()):
        row[:n] = ids[k][a : a + n]
    gains = tagger.gains(x.T, size)
    # where windows overlap, the later one gets the average
    later = np.flatnonzero(before >= 0)
    both, own = np.arange(OVERLAP)[:, None], size.copy()
    if len(later):
        own[before[later]] = step
        left, right = tent(WINDOW, both + step)[:, None], tent(size[later], both)[:, None]
        gains[:OVERLAP, :, later] = (gains[step:WINDOW, :, before[later]] * left + gains[:OVERLAP, :, later] * right) / (left + right)
    t, w = coverable(gains, own, before, at // step)
    place = np.cumsum([0, *(len(x) + 1 for x in ids)])  # texts end to end, and a gap after each
    position = place[text[w]] + at[w] + t
    by_place = np.argsort(position)
    t, w, position = t[by_place], w[by_place], position[by_place]
    starts = np.flatnonzero(np.diff(position, prepend=-2) > 1)
    e = np.zeros((len(t), len(LABELS)), np.float32)
    e[:, 1::2], e[:, 2::2] = np.split(gains[t, :, w] - tagger.transitions(), 2, 1)
    yield from zip(text[w[starts]].tolist(), (at[w] + t)[starts].tolist(), np.split(e, starts[1:]))


#: Longer texts are decoded in parts of that many code points, to bound memory, with as many beside them on either side as
#: EDGE says; a part has the spans that start in it. Both are whole numbers of a window's steps.
PART, EDGE = 256 * (WINDOW - OVERLAP), 8 * (WINDOW - OVERLAP)


def decoded(tagger: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans in each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    parts: list[tuple[int, int, int, int, int]] = []  # text, the part's ends, and those between which its spans start
    for k, text in enumerate(texts):
        for at in range(0, len(text), PART):
            end = min(at + PART, len(text))
            parts.append((k, max(0, at - EDGE), min(len(text), end + EDGE), at, end))
    for (k, first, _, at, end), found in zip(parts, decoded_parts(tagger, [texts[k][a:b] for k, a, b, _, _ in parts])):
        out[k] += [(kind, a + first, b + first) for kind, a, b in found if at <= a + first < end]
    return out


def decoded_parts(tagger: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    together, n = [[]], 0
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):  # about equally long ones together
        windows = -(-len(texts[k]) // (WINDOW - OVERLAP))
        if together[-1] and n + windows > TOGETHER:
            together.append([])
            n = 0
        together[-1].append(k)
        n += windows
    found = [(these[k], first, e) for these in together for k, first, e in stretches(tagger, [texts[k] for k in these])]
    for (k, first, _), labels in zip(found, tagger.best([e for _, _, e in found])):
        at = np.flatnonzero(labels)
        for start in at[labels[at] % 2 == 1].tolist():
            end = start + 1
            while end < len(labels) and labels[end] == labels[start] + 1:
                end += 1
            out[k].append((LABELS[labels[start]][2:], first + start, first + end))
    return out


def checks(kind: str, value: str) -> bool:
    """Check digits, for the kinds that have them."""
    if kind == "card":
        digits = re.sub(r"[^0-9]", "", value)
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "iban":
        flat = re.sub(r"[^A-Za-z0-9]", "", value).upper()
        return flat.isascii() and len(flat) > 4 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    return True


def added(text: str, base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of the decoded spans, those that overlap no base span and pass their check; ends trimmed of white space and dots."""
    taken, out = sorted((a, b) for _, a, b in base), []
    starts = [a for a, _ in taken]
    reach = list(itertools.accumulate((b for _, b in taken), max))  # the furthest end of all base spans up to each
    for kind, a, b in found:
        while a < b and text[a] in " .,\n\t":
            a += 1
        while b > a and text[b - 1] in " .,\n\t":
            b -= 1
        before = bisect.bisect_left(starts, b)  # base spans that start before the end
        if a < b and checks(kind, text[a:b]) and not (before and reach[before - 1] > a):
            out.append((kind, a, b))
    return out


def personal_data(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """``id_column`` and ``spans`` (array of kind, start, end) of every row, base spans first; nothing is shuffled."""
    sent = df.sparkSession.sparkContext.broadcast(tagger or trained(df.sparkSession))  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = {k: i for i, k in enumerate(KINDS)}
        for batch in pieces(batches, text_column, 1 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            model = decoded(sent.value, texts)
            found = []
            for t, b, m in zip(texts, base, model):
                both = b + added(t, b, m)
                both.sort(key=lambda s: (kind_of[s[0]], s[1]))
                new = set(both) - set(b)
                found.append([{"kind": k, "start": x, "end": y, "base": (k, x, y) not in new} for k, x, y in both])
            spans = pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=[id_column, "spans"])

    schema = T.StructType([df.schema[id_column], *T._parse_datatype_string("spans array<struct<kind:string,start:int,end:int,base:boolean>>").fields])
    return rows(df, id_column, text_column).mapInArrow(run, schema)


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
