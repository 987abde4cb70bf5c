"""Chains that go in step: roots by secants, and numbers drawn for all chains at once."""

import numpy as np

from strataspark.operators import inversion

RHO, PERIODS = np.array([2.6, 2.8, 3.3]), np.array([8.0, 15, 25, 40])
SIGMA, LOW, HIGH = np.array([0.8, 0.05, 0.05, 0.05]), np.array([5, 2.2, 3.0, 4.0]), np.array([30, 3.6, 4.2, 4.6])


def layers(p):
    return np.column_stack([p[:, 0], np.full(len(p), 20.0), np.zeros(len(p))]), p[:, 1:]


def test_roots_are_followed(monkeypatch):
    rng, asked = np.random.default_rng(5), []
    x = rng.uniform(LOW, HIGH, (80, 4))
    x = x[inversion.prior_ok(x[:, 1:].T, 2)]
    roots = inversion.LoveRoots(RHO, PERIODS)
    roots(*layers(x))
    whole = inversion.love_velocities
    monkeypatch.setattr(inversion, "love_velocities", lambda h, *a: asked.append(len(h)) or whole(h, *a))
    for _ in range(30):
        y = x + rng.normal(size=x.shape) * SIGMA
        x = np.where((((y >= LOW) & (y <= HIGH)).all(axis=1) & inversion.prior_ok(y[:, 1:].T, 2))[:, None], y, x)
        c = roots(*layers(x))
        assert np.allclose(c, whole(*layers(x), RHO, PERIODS), atol=3e-5)
    h, vs = layers(x)
    assert np.allclose(c, [inversion.love_velocity(h[i], vs[i], RHO, PERIODS, 0.001) for i in range(len(x))], atol=2e-6)
    assert sum(asked) < 0.01 * 30 * len(x)
    # velocities that fall are not for secants
    vs = vs.copy()
    vs[0, :2] = vs[0, 1::-1]
    assert np.array_equal(roots(h, vs)[0], whole(h[:1], vs[:1], RHO, PERIODS)[0])


def test_rows_of_models_under_the_prior():
    vs = np.random.default_rng(6).uniform(2.5, 5.0, (3, 500))
    vs[:, :250].sort(axis=0)
    got = inversion.prior_ok(vs, 2)
    assert got.any() and got.tolist() == [inversion.prior_ok(v, 2) for v in vs.T.tolist()]


def test_steps_look_at_all_chains_at_once():
    """Calls follow the steps, not the chains; a chain's samples are its own."""
    start, calls = np.tile([15.0, 3, 3.6, 4.4], (64, 1)), []

    def run(k):
        roots = inversion.LoveRoots(RHO, PERIODS)
        valid = lambda p: calls.append(1) or inversion.prior_ok(p[1:], 2)
        return inversion.sample_chains(k, 300, start[k], SIGMA, LOW, HIGH, lambda p: roots(*layers(p)), np.full((len(k), 4), 3.7), np.full(4, 0.05), valid)

    together = run(list(range(64)))
    assert len(calls) < 299 * 30
    assert np.array_equal(together[7], run([7])[0])
    p = together[:, :, 3:]
    assert ((p >= LOW) & (p <= HIGH)).all() and inversion.prior_ok(p.reshape(-1, 4)[:, 1:].T, 2).all()
