"""Training of the tagger in numpy: python -m quaysift.llm.pii_training FOLDER_OF_TABLES.

Labelled windows come from two sources, both bounded by documented parameters: ``passages`` own sentences with generated
values (pii_templates), set in running text of the tables; and at most ``rows`` rows of each table, labelled by the frames
of pii_labels, with names and numbers varied. The bidirectional LSTM with CRF is fitted by Adam; the gradient of a batch
is the mean over ``workers`` processes.
"""

from __future__ import annotations

import multiprocessing
import os
import random
import string
import sys
import time

import numpy as np

from quaysift.llm import pii
from quaysift.llm.pii_labels import spans
from quaysift.llm.pii_templates import _made, passage

T, K = pii.WINDOW, pii.TAGS
Labelled = tuple[str, list[tuple[int, int, int]]]


def varied(text: str, found: list[tuple[int, int, int]], rng: random.Random) -> Labelled:
    """A copy with some names replaced by invented ones and letters of numbers changed; spans moved along."""
    out, moved, at = [], [], 0
    for a, b, k in found:
        out.append(text[at:a])
        span = text[a:b]
        if k == 0 and rng.random() < 0.35:
            span = " ".join(_made(rng) + ("" if w[-1].isalpha() else w[-1]) if w[:1].isupper() and len(w) > 3 else w for w in span.split(" "))
        if k == 3 and rng.random() < 0.3:
            span = "".join(rng.choice(string.ascii_uppercase) if c.isupper() else c for c in span)
        start = sum(map(len, out))
        out.append(span)
        moved.append((start, start + len(span), k))
        at = b
    out.append(text[at:])
    return "".join(out), moved


def windows(labelled: list[Labelled], rng: random.Random) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character classes, tags and lengths of the windows over the stretches around the cues of the texts, laid within them as in use."""
    xs, ys, sizes = [], [], []
    for text, found in labelled:
        tags = np.zeros(len(text), np.int64)
        for a, b, k in found:
            tags[a:b] = 2 + 2 * k
            tags[a] = 1 + 2 * k
        coded = pii.codes(text)
        for a, b in pii.stretches(text):
            starts = [a] if b - a <= T else [*range(a, b - T, pii.STRIDE), b - T]
            for s in starts:
                x, y = np.zeros(T, np.int64), np.zeros(T, np.int64)
                e = min(b, s + T)
                x[: e - s], y[: e - s] = coded[s:e], tags[s:e]
                if y.any() or rng.random() < 0.6:
                    xs.append(x)
                    ys.append(y)
                    sizes.append(e - s)
    return np.array(xs), np.array(ys), np.array(sizes)


def initial(seed: int, hidden: int = 32, width: int = 16) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    g = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
    b = np.zeros((2, 4 * hidden), np.float32)
    b[:, hidden : 2 * hidden] = 1.0
    return {
        "emb": g(pii.N_CLASSES, width, k=0.3), "wx": g(2, width, 4 * hidden, k=width**-0.5), "wh": g(2, hidden, 4 * hidden, k=hidden**-0.5),
        "b": b, "wo": g(2 * hidden, K, k=(2 * hidden) ** -0.5), "bo": np.zeros(K, np.float32), "trans": g(K, K, k=0.1),
    }


def _squash(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The network's sigmoid-shaped function (see pii.squash) and its slope."""
    x = np.clip(x, -3.0, 3.0)
    q = x * x
    d = 27.0 + 9.0 * q
    return x * (27.0 + q) / d, 9.0 * (q - 9.0) ** 2 / (d * d) * 1.0


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def loss_and_gradient(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log-likelihood of the tags under the CRF, and its gradient by backpropagation through time.

    What lies behind a window's end takes part in nothing: states there are zero, and the CRF ends with the window.
    """
    steps = int(sizes.max())
    x, y = x[:, :steps], y[:, :steps]
    n, h = len(x), w["wh"].shape[1]
    within = (np.arange(steps)[None] < sizes[:, None]).astype(w["wo"].dtype)
    emb = w["emb"][x]
    states, outs = [], []
    for d in range(2):
        pre = emb @ w["wx"][d] + w["b"][d]
        hid, cell = np.zeros((n, h), pre.dtype), np.zeros((n, h), pre.dtype)
        kept, out = [], np.empty((n, steps, h), pre.dtype)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            g = pre[:, t] + hid @ w["wh"][d]
            g[:, : 3 * h] *= 0.5
            act, slope = _squash(g)
            gates, new = 0.5 + 0.5 * act[:, : 3 * h], act[:, 3 * h :]
            slope[:, : 3 * h] *= 0.25
            before, hid_before, m = cell, hid, within[:, t, None]
            cell = (gates[:, h : 2 * h] * cell + gates[:, :h] * new) * m
            th, th_slope = _squash(cell)
            hid = gates[:, 2 * h :] * th * m
            out[:, t] = hid
            kept.append((t, gates, new, slope, before, hid_before, th, th_slope, m))
        states.append(kept)
        outs.append(out)
    feature = np.concatenate(outs, 2)
    score = feature @ w["wo"] + w["bo"]
    # forward and backward of the CRF
    alpha, beta = np.empty((n, steps, K), score.dtype), np.zeros((n, steps, K), score.dtype)
    alpha[:, 0] = score[:, 0]
    for t in range(1, steps):
        alpha[:, t] = np.where(within[:, t, None] > 0, score[:, t] + _lse(alpha[:, t - 1, :, None] + w["trans"], 1), alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        beta[:, t] = np.where(within[:, t + 1, None] > 0, _lse(w["trans"][None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0.0)
    z = _lse(alpha[:, -1], 1)
    rows = np.arange(n)[:, None]
    gold = (score[rows, np.arange(steps)[None], y] * within).sum(1) + (w["trans"][y[:, :-1], y[:, 1:]] * within[:, 1:]).sum(1)
    loss = float((z - gold).mean())
    d_score = np.exp(alpha + beta - z[:, None, None]) * within[:, :, None]
    d_trans = np.zeros((K, K), score.dtype)
    for t in range(1, steps):
        pair = np.exp(alpha[:, t - 1, :, None] + w["trans"] + (score[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
        d_trans += (pair * within[:, t, None, None]).sum(0)
    np.add.at(d_trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), -within[:, 1:].ravel())
    d_score[rows, np.arange(steps)[None], y] -= within
    d_score /= n
    grad = {"trans": d_trans / n, "wo": feature.reshape(-1, 2 * h).T @ d_score.reshape(-1, K), "bo": d_score.sum((0, 1))}
    d_feature = d_score @ w["wo"].T
    d_emb = np.zeros_like(emb)
    grad |= {k: np.zeros_like(w[k]) for k in ("wx", "wh", "b")}
    for d in range(2):
        d_out = d_feature[:, :, d * h : (d + 1) * h]
        dh, dc = np.zeros((n, h), score.dtype), np.zeros((n, h), score.dtype)
        d_pre = np.empty((n, steps, 4 * h), score.dtype)
        for t, gates, new, slope, before, hid_before, th, th_slope, m in reversed(states[d]):
            dh = (dh + d_out[:, t]) * m
            dc = (dc + dh * gates[:, 2 * h :] * th_slope) * m
            g = d_pre[:, t]
            g[:, :h] = dc * new
            g[:, h : 2 * h] = dc * before
            g[:, 2 * h : 3 * h] = dh * th
            g[:, 3 * h :] = dc * gates[:, :h]
            g *= slope
            grad["wh"][d] += hid_before.T @ g
            dh = g @ w["wh"][d].T
            dc = dc * gates[:, h : 2 * h]
        flat = d_pre.reshape(-1, 4 * h)
        grad["wx"][d] = emb.reshape(-1, emb.shape[2]).T @ flat
        grad["b"][d] = flat.sum(0)
        d_emb += d_pre @ w["wx"][d].T
    grad["emb"] = np.zeros_like(w["emb"])
    np.add.at(grad["emb"], x.ravel(), d_emb.reshape(-1, emb.shape[2]))
    return loss, grad


_DATA: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _part(job: tuple[dict[str, np.ndarray], np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    w, pick = job
    return loss_and_gradient(w, *(a[pick] for a in _DATA))


def train(data: tuple[np.ndarray, np.ndarray, np.ndarray], steps: int, batch: int = 256, rate: float = 6e-3, seed: int = 7, workers: int = 8, say: bool = False, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Weights after ``steps`` Adam steps; windows with spans make up six tenths of each batch."""
    global _DATA
    _DATA = data
    r = np.random.default_rng(seed)
    w = start or initial(seed)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    some = data[1].any(1)
    full, empty = np.flatnonzero(some), np.flatnonzero(~some)
    if not len(empty):
        empty = full
    began = time.time()
    with multiprocessing.get_context("fork").Pool(workers) as pool:
        for step in range(1, steps + 1):
            pick = np.concatenate([r.choice(full, batch * 6 // 10), r.choice(empty, batch - batch * 6 // 10)])
            r.shuffle(pick)
            parts = pool.map(_part, [(w, p) for p in np.array_split(pick, workers)])
            grad = {k: sum(g[k] for _, g in parts) / workers for k in w}
            norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
            lr = rate * min(1.0, step / 50) * (1.0 - 0.97 * step / steps)
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if say and step % 100 == 0:
                print(f"{step} loss {sum(x for x, _ in parts) / workers:.3f} {time.time() - began:.0f} s", flush=True)
    return w


def main(folder: str, rows: int = 12_000, passages: int = 80_000, steps: int = 3000, again: int = 0) -> None:
    """Trains and stores the weights; ``again`` goes on from the stored ones, with half the rate.

    The sample is bounded: ``rows`` rows of each table at most, of unlabelled ones the first 3,000 characters, and ``passages`` own sentences.
    """
    import pyarrow.parquet as pq

    rng = random.Random(3)
    labelled: list[Labelled] = []
    around: list[str] = []
    for name, column in (("doc_chunks", "text"), ("evidence_chunks", "quote"), ("financial_evidence", "source_quote")):
        found = [t for t in pq.read_table(f"{folder}/{name}.parquet", columns=[column])[column].to_pylist() if t]
        rng.shuffle(found)
        # rows with spans are few: they are taken first up to half of the bound
        texts = [t for t in found if spans(t)][: rows // 2] + [t[:3000] for t in found[: rows // 4]]
        labelled += [(t, spans(t)) for t in texts]
        labelled += [varied(t, spans(t), rng) for t in texts if spans(t)]
        around += [line for t in texts if not spans(t) for line in t.split("\n") if 20 < len(line) < 200]
    labelled += [passage(rng, around) for _ in range(passages)]
    data = windows(labelled, rng)
    print(len(labelled), "texts", data[0].shape, "windows", int(data[1].any(1).sum()), "with spans", flush=True)
    if again:
        with np.load(pii.WEIGHTS) as f:
            w = train(data, steps, rate=3e-3, say=True, start={k: a.astype(np.float32) for k, a in f.items()})
    else:
        w = train(data, steps, say=True)
    np.savez_compressed(pii.WEIGHTS, **{k: a.astype(np.float16) if k == "emb" else a for k, a in w.items()})


if __name__ == "__main__":
    for variable in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        if variable not in os.environ:  # one thread a process; set before numpy is loaded
            os.environ[variable] = "1"
            os.execv(sys.executable, [sys.executable, "-m", "quaysift.llm.pii_training", *sys.argv[1:]])
    main(*sys.argv[1:2], **{k: int(v) for k, v in (a.split("=") for a in sys.argv[2:])})
