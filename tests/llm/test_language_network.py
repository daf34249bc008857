"""The recurrent network against the same recurrence written out plainly, in values and in CPU time."""

from __future__ import annotations

import time

import numpy as np

from martlens.llm import language


def plain_states(net: language.ByteGru, x: np.ndarray, d: str) -> np.ndarray:
    """(steps, windows, state), by the definition, a row for each window."""
    h, wx, u = language.HIDDEN, net.w[f"x{d}"], net.w[f"u{d}"]
    out, s = np.empty((*x.shape, h), np.float32), np.zeros((x.shape[1], h), np.float32)
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        a = wx[x[t]]
        g = 0.5 + 0.5 * np.tanh(0.5 * (s @ u[:, : 2 * h] + a[:, : 2 * h]))
        c = np.tanh((g[:, h:] * s) @ u[:, 2 * h :] + a[:, 2 * h :])
        s = out[t] = s + g[:, :h] * (c - s)
    return out


def network(scale: float = 1.0) -> tuple[language.ByteGru, np.ndarray]:
    net = language.ByteGru(["a", "b", "c", "d"])
    net.w = {k: v * np.float32(scale if k[0] == "x" else 1) for k, v in net.w.items()}
    return net, np.random.default_rng(3).integers(0, 256, (language.WINDOW, 1024)).astype(np.uint8)


def test_same_states_and_probabilities():
    for scale in (1.0, 400.0):  # with the latter exp leaves the range of floats
        net, x = network(scale)
        plain = {d: plain_states(net, x, d) for d in "fb"}
        for d in "fb":
            assert np.abs(net.states(x, d).transpose(0, 2, 1) - plain[d]).max() < 1e-4
        p = np.exp(plain["f"] @ net.w["of"] + plain["b"] @ net.w["ob"] + net.w["bias"])
        assert np.abs(net.probabilities(x).transpose(0, 2, 1) - p / p.sum(-1, keepdims=True)).max() < 1e-4


def test_costs_less_than_written_out():
    net, x = network()

    def least(f) -> float:
        took = []
        for _ in range(7):
            began = time.thread_time()
            f()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: net.states(x, "f")) < 0.75 * least(lambda: plain_states(net, x, "f"))
