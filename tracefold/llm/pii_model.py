"""A character-level bidirectional LSTM with a CRF over its outputs, in numpy.

Each step of the LSTM takes two characters, by embeddings of their own, and
scores the tags of both; so a text takes half as many steps as it has characters.
"""

from __future__ import annotations

import os

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
#: 0 is outside; 1 + 2k begins kind k, 2 + 2k continues it.
N_TAGS = 1 + 2 * len(KINDS)
EMBED, HIDDEN = 16, 40
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz")

#: Classes of characters: 0 is padding, printable ASCII is itself, then control, Latin lower and upper, other.
N_CHARS = 101


def codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    out = np.where((c >= 32) & (c < 127), c - 31, np.where(c < 32, 96, 99))
    for i in np.flatnonzero(c > 127):
        ch = chr(c[i])
        out[i] = 97 if ch.islower() else 98 if ch.isupper() else 100 if ch.isspace() else 99
    return out


def new_weights(seed: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {"embed": r.normal(0, 0.3, (N_CHARS, EMBED))}
    for d in "fb":
        w[d + "x"] = r.normal(0, 1 / np.sqrt(2 * EMBED), (2 * EMBED, 4 * HIDDEN))
        w[d + "h"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        b = np.zeros(4 * HIDDEN)
        b[HIDDEN : 2 * HIDDEN] = 1
        w[d + "b"] = b
    w["out"] = r.normal(0, 1 / np.sqrt(2 * HIDDEN), (2 * HIDDEN, 2 * N_TAGS))
    w["bias"] = np.zeros(2 * N_TAGS)
    w["move"] = r.normal(0, 0.1, (N_TAGS, N_TAGS))
    w["first"] = np.zeros(N_TAGS)
    return {k: v.astype(np.float32) for k, v in w.items()}


def load(path: str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def _lstm(x: np.ndarray, w: dict, d: str, mask: np.ndarray, keep: bool):
    """Outputs (time, rows, HIDDEN) of one direction; padding leaves the state as it is."""
    t, n, _ = x.shape
    px = (x.reshape(t * n, -1) @ w[d + "x"] + w[d + "b"]).reshape(t, n, -1)
    h = np.zeros((n, HIDDEN), dtype=np.float32)
    c = np.zeros((n, HIDDEN), dtype=np.float32)
    out = np.empty((t, n, HIDDEN), dtype=np.float32)
    tape = []
    for i in range(t) if d == "f" else range(t - 1, -1, -1):
        z = px[i] + h @ w[d + "h"]
        g = np.tanh(z[:, 3 * HIDDEN :])
        s = 0.5 * np.tanh(0.5 * z[:, : 3 * HIDDEN]) + 0.5
        a, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        m = mask[i][:, None]
        c2 = f * c + a * g
        tc = np.tanh(c2)
        h2 = o * tc
        if keep:
            tape.append((i, a, f, o, g, c, tc, h, m))
        c = np.where(m, c2, c)
        h = np.where(m, h2, h)
        out[i] = h
    return out, tape


def _steps(w: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (time, rows) of even length, the inputs (time / 2, rows, 2 * EMBED) and which steps hold a character."""
    ids = ids.T
    if len(ids) % 2:
        ids = np.concatenate((ids, np.zeros((1, ids.shape[1]), dtype=ids.dtype)))
    x = w["embed"][ids]
    t, n, k = x.shape
    return ids, x.reshape(t // 2, 2, n, k).transpose(0, 2, 1, 3).reshape(t // 2, n, 2 * k), ids[::2] > 0


def _by_character(e: np.ndarray) -> np.ndarray:
    """Scores (time / 2, rows, 2 * N_TAGS) as (time, rows, N_TAGS)."""
    t, n, _ = e.shape
    return e.reshape(t, n, 2, N_TAGS).transpose(0, 2, 1, 3).reshape(2 * t, n, N_TAGS)


def emissions(w: dict, ids: np.ndarray) -> np.ndarray:
    """Scores (rows, time, N_TAGS) of character codes (rows, time); code 0 is padding."""
    _, x, mask = _steps(w, ids)
    f, _ = _lstm(x, w, "f", mask, False)
    b, _ = _lstm(x, w, "b", mask, False)
    return _by_character(np.concatenate((f, b), axis=2) @ w["out"] + w["bias"]).transpose(1, 0, 2)[:, : ids.shape[1]]


def _prepared(w: dict) -> dict:
    """Weights laid out for scoring: per direction the input part of the gates for each pair of characters.

    The three sigmoid gates are halved beforehand, so one tanh serves all four; so are
    the weights of the output, which is kept doubled.
    """
    if "ready" not in w:
        half = np.concatenate((np.full(3 * HIDDEN, 0.5, dtype=np.float32), np.ones(HIDDEN, dtype=np.float32)))
        one = lambda x: (w["embed"] @ x) * half
        both = lambda x, b: np.ascontiguousarray((one(x[:EMBED])[:, None] + one(x[EMBED:])[None] + b * half).reshape(-1, 4 * HIDDEN))
        w["ready"] = {d: (both(w[d + "x"], w[d + "b"]), np.ascontiguousarray(w[d + "h"] * half * np.float32(0.5))) for d in "fb"}
    return w["ready"]


def fast_emissions(w: dict, rows: list[np.ndarray]) -> np.ndarray:
    """Scores (time, rows, N_TAGS) of coded windows, as ``emissions`` gives them; places after a window's end mean nothing.

    The backward pass reads each window's steps from its own end, so padding
    comes last for both and no mask is needed.
    """
    n, t = len(rows), (max(len(r) for r in rows) + 1) // 2
    steps = np.array([(len(r) + 1) // 2 for r in rows])
    ids = np.zeros((n, 2 * t), dtype=np.intp)
    for j, r in enumerate(rows):
        ids[j, : len(r)] = r
    pairs = ids[:, ::2] * N_CHARS + ids[:, 1::2]
    back = pairs[np.arange(n)[:, None], np.maximum(steps[:, None] - 1 - np.arange(t), 0)]
    out = np.zeros((t, n, 2 * N_TAGS), dtype=np.float32)
    at, even = np.arange(n), bool((steps == t).all())
    z = np.empty((n, 4 * HIDDEN), dtype=np.float32)
    x = np.empty_like(z)
    one = np.zeros_like(z)
    one[:, : 3 * HIDDEN] = 1
    for k, (d, p) in enumerate((("f", pairs), ("b", back))):
        given, across = _prepared(w)[d]
        p = np.ascontiguousarray(p.T)
        project = np.ascontiguousarray(w["out"][k * HIDDEN : (k + 1) * HIDDEN]) * np.float32(0.5)
        # twice the state and the output, as the gates are: 2 * sigmoid(v) = 1 + tanh(v / 2)
        h = np.zeros((n, HIDDEN), dtype=np.float32)
        c = np.zeros((n, HIDDEN), dtype=np.float32)
        a, f, o, g = (z[:, j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
        for i in range(t):
            np.matmul(h, across, out=z)
            np.take(given, p[i], axis=0, out=x, mode="clip")
            z += x
            np.tanh(z, out=z)
            z += one
            c *= f
            c *= 0.5
            np.multiply(a, g, out=g)
            c += g
            np.multiply(c, 0.5, out=h)
            np.tanh(h, out=h)
            h *= o
            if k == 0:
                np.matmul(h, project, out=out[i])
            else:
                e = h @ project
                if even:
                    out[t - 1 - i] += e
                else:
                    place = steps - 1 - i
                    ok = place >= 0
                    out[place[ok], at[ok]] += e[ok]
    out += w["bias"]
    return _by_character(out)


def viterbi(w: dict, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best tags (rows, time) of scores (time, tags, rows).

    Best scores are kept for every step; on the way back the move that led to a
    tag is found again from them, for the tags of the path only.
    """
    t, k, n = e.shape
    move = w["move"].astype(e.dtype)
    score = np.empty_like(e)
    score[0] = e[0] + w["first"][:, None]
    part = np.empty((k, k, n), dtype=e.dtype)
    moves = np.ascontiguousarray(move[:, :, None])
    # is the best way to 'outside' here outside all along? Rows that end so need no way back
    plain = np.ones(n, dtype=bool)
    todo = np.zeros(n, dtype=bool)
    stops = set((np.unique(lengths) - 1).tolist())

    def close(i: int) -> None:
        ends = lengths - 1 == i
        todo[ends] = ~(plain & (score[i].argmax(axis=0) == 0))[ends]

    if min(stops) <= 0:
        close(0)
    for i in range(1, t):
        last, best = score[i - 1], score[i]
        np.add(last[:, None], moves, out=part)
        part.max(axis=0, out=best)
        plain &= best[0] == last[0] + move[0, 0]
        best += e[i]
        if i in stops:
            close(i)
    tags = np.zeros((n, t), dtype=np.int8)
    rows = np.flatnonzero(todo)
    if len(rows) < n:
        score = np.ascontiguousarray(score[:, :, rows])
    if not len(rows):
        return tags
    size = lengths[rows]
    now = np.zeros(len(rows), dtype=np.int64)
    into = np.ascontiguousarray(move.T)
    for i in range(int(size.max()) - 1, -1, -1):
        ends = size - 1 == i
        if ends.any():
            now = np.where(ends, score[i].argmax(axis=0), now)
        inside = size > i
        tags[rows, i] = np.where(inside, now, 0)
        if i:
            now = np.where(inside, (score[i - 1].T + into[now]).argmax(axis=1), now)
    return tags


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradients(w: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood per row of tags under the CRF, with gradients."""
    n, t = ids.shape
    codes_, x, steps = _steps(w, ids)
    mask = ids.T > 0
    f, tf = _lstm(x, w, "f", steps, True)
    b, tb = _lstm(x, w, "b", steps, True)
    hb = np.concatenate((f, b), axis=2)
    e = _by_character(hb @ w["out"] + w["bias"])[:t]
    y = tags.T
    move = w["move"]
    alpha = np.empty_like(e)
    alpha[0] = e[0] + w["first"]
    for i in range(1, t):
        a = _lse(alpha[i - 1][:, :, None] + move, 1) + e[i]
        alpha[i] = np.where(mask[i][:, None], a, alpha[i - 1])
    z = _lse(alpha[-1], 1)
    beta = np.zeros_like(e)
    for i in range(t - 2, -1, -1):
        a = _lse(move[None] + (e[i + 1] + beta[i + 1])[:, None, :], 2)
        beta[i] = np.where(mask[i + 1][:, None], a, beta[i + 1])
    rows = np.arange(n)
    gold = w["first"][y[0]] + e[0, rows, y[0]]
    de = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    de[np.arange(t)[:, None], rows[None], y] -= mask
    g = {"move": np.zeros_like(move)}
    g["first"] = de[0].sum(0)
    for i in range(1, t):
        m = mask[i]
        gold += np.where(m, move[y[i - 1], y[i]] + e[i, rows, y[i]], 0)
        p = np.exp(alpha[i - 1][:, :, None] + move[None] + (e[i] + beta[i])[:, None, :] - z[:, None, None])
        g["move"] += (p * m[:, None, None]).sum(0)
        np.add.at(g["move"], (y[i - 1][m], y[i][m]), -1)
    if t % 2:
        de = np.concatenate((de, np.zeros((1, *de.shape[1:]), dtype=de.dtype)))
    two = de.reshape(-1, 2, n, N_TAGS).transpose(0, 2, 1, 3).reshape(len(x), n, 2 * N_TAGS)
    g["out"] = hb.reshape(-1, 2 * HIDDEN).T @ two.reshape(-1, 2 * N_TAGS)
    g["bias"] = two.sum((0, 1))
    dh_all = two @ w["out"].T
    dx = np.zeros_like(x)
    for d, tape, part in (("f", tf, dh_all[:, :, :HIDDEN]), ("b", tb, dh_all[:, :, HIDDEN:])):
        dh = np.zeros((n, HIDDEN), dtype=np.float32)
        dc = np.zeros_like(dh)
        gh = np.zeros_like(w[d + "h"])
        dz_all = np.zeros((len(x), n, 4 * HIDDEN), dtype=np.float32)
        for i, a, fo, o, gg, c0, tc, h0, m in reversed(tape):
            dh = dh + part[i]
            dhm, dcm = np.where(m, dh, 0), np.where(m, dc, 0)
            do = dhm * tc * o * (1 - o)
            dct = dcm + dhm * o * (1 - tc * tc)
            dz = np.concatenate((dct * gg * a * (1 - a), dct * c0 * fo * (1 - fo), do, dct * a * (1 - gg * gg)), axis=1)
            dz_all[i] = dz
            gh += h0.T @ dz
            dh = np.where(m, dz @ w[d + "h"].T, dh)
            dc = np.where(m, dct * fo, dc)
        flat = dz_all.reshape(len(x) * n, -1)
        g[d + "h"] = gh
        g[d + "x"] = x.reshape(len(x) * n, -1).T @ flat
        g[d + "b"] = flat.sum(0)
        dx += (flat @ w[d + "x"].T).reshape(x.shape)
    g["embed"] = np.zeros_like(w["embed"])
    np.add.at(g["embed"], codes_.ravel(), dx.reshape(len(x), n, 2, EMBED).transpose(0, 2, 1, 3).reshape(-1, EMBED))
    return float((z - gold).mean()), {k: v / n for k, v in g.items()}
