"""Pattern rules against NumPy on synthetic shapes."""

from __future__ import annotations

import numpy as np
import pytest

from metricloom.operators import patterns as P

RNG = np.random.default_rng(5)


def slope(v):
    return np.polyfit(np.arange(len(v)), v, 1)[0]


def expected(v, name="train_loss"):
    v = np.asarray(v, float)
    n, out = len(v), {}
    if n >= 50:
        d = np.diff(v)
        rate = (np.diff(np.sign(d)) != 0).sum() / len(d)
        size = min(20, n // 5)
        swings = [np.ptp(v[i : i + size]) for i in range(0, n - size, size)]
        relative = np.mean(swings) / (np.abs(v).mean() + 1e-8)
        if rate > 0.3 and relative > 0.1:
            out["oscillation"] = min(1.0, rate * 2)
        if "loss" in name and slope(v[-50:]) > 0.01 and v[-20:].mean() > 1.5 * v[:20].mean():
            out["divergence"] = min(1.0, (v[-20:].mean() / v[:20].mean() - 1) / 2)
    if n >= 100:
        if "loss" in name and slope(v) < 0:
            fit = np.polyval(np.polyfit(np.arange(n), v, 1), np.arange(n))
            noise = (v - fit).std() / (abs(v.mean()) + 1e-8)
            if noise < 0.3:
                out["healthy_convergence"] = max(0.5, 1 - noise)
        relative = v[-50:].std() / (abs(v[-50:].mean()) + 1e-8)
        if relative < 0.01:
            out["saturation"] = max(0.5, 1 - 10 * relative)
        slopes = [slope(v[i : i + 20]) for i in range(0, n - 20, 10)]
        jumps = np.abs(np.diff(slopes))
        if len(slopes) >= 3 and jumps.max() > 3 * jumps.mean() and jumps.max() > 1e-9:
            out["lr_decay_effect"] = 0.7
    return out


SHAPES = {
    "descend": [1 / (1 + 0.01 * i) + 0.01 * np.sin(i) for i in range(200)],
    "ascend": [0.5 + 0.05 * i for i in range(200)],
    "zigzag": [3.0 + (1 if i % 2 else -1) for i in range(200)],
    "kink": [5.0] * 100 + [5.0 - 0.04 * i for i in range(100)],
    "saturated": [2.0 / (1 + i) + 1 for i in range(140)] + list(1 + RNG.normal(0, 1e-5, 60)),
    "noise": list(RNG.exponential(5, 137)),
    "n49": list(RNG.exponential(5, 49)),
    "n50": list(RNG.exponential(5, 50)),
    "n99": list(RNG.exponential(5, 99)),
    "n101": list(RNG.exponential(5, 101)),
}


def test_all_shapes(series):
    metrics = series({f"{k}_loss": v for k, v in SHAPES.items()} | {k: v for k, v in SHAPES.items()})
    got: dict = {}
    for r in P.detect_patterns(metrics).collect():
        got.setdefault(r["name"], {})[r["pattern_type"]] = r["confidence"]
    for k, v in SHAPES.items():
        for name in (f"{k}_loss", k):
            want = expected(v, name)
            assert got.get(name, {}).keys() == want.keys(), name
            for kind, confidence in want.items():
                assert got[name][kind] == pytest.approx(confidence, abs=1e-6), (name, kind)


def test_schedule_steps(series):
    v = SHAPES["kink"]
    steps = [7 * i for i in range(len(v))]
    (row,) = P.schedule_change(P.numbered_series(series({"x": v}, steps={"x": steps})).result()).collect()
    slopes = [slope(np.array(v[i : i + 20])) for i in range(0, len(v) - 20, 10)]
    k = int(np.argmax(np.abs(np.diff(slopes))))
    assert row["start_step"] == steps[10 * k]
    assert row["end_step"] == steps[min(10 * k + 20, len(v) - 1)]


def test_ramp_is_not_a_schedule_change(series):
    ramp = series({"x": [0.1 * i for i in range(200)]})
    assert P.schedule_change(P.numbered_series(ramp).result()).count() == 0


def test_scenarios(series):
    metrics = series({f"{k}_loss": v for k, v in SHAPES.items()})
    rows = {r["name"]: r for r in P.match_scenario(P.detect_patterns(metrics), metrics).collect()}
    assert rows["descend_loss"]["scenario"] == "healthy_training"
    assert rows["zigzag_loss"]["scenario"] == "lr_too_high"
    assert rows["n49_loss"]["scenario"] == "unknown"
    assert rows["zigzag_loss"]["recommendations"][0] == "Reduce learning rate by 2-10x"
