"""The seekable stream of starts: any place of it, from arrays, slices and resampled tasks."""

import numpy as np
import pytest

from tensorloom.operators import blocks, cp, draws, kernel, tensorize


@pytest.mark.parametrize("step", [0, draws.STEP])
def test_any_place_of_the_stream(monkeypatch, step):
    monkeypatch.setattr(draws, "STEP", step)
    for seed in (0, 1, 49, 2**32 - 1):
        whole = np.random.RandomState(seed).random_sample(602_000)
        for at, n in ((0, 5), (1, 0), (155, 3), (311, 2), (312, 700), (9_968, 4), (9_969, 4), (601_000, 1_000)):
            assert np.array_equal(draws.uniform(seed, at, n), whole[at : at + n]), (seed, at)


def test_jumps_add_up():
    """Far beyond what can be stepped over: two jumps give the state of one."""
    key, far = draws._key(9), 10**12
    twice, once = draws._jumped(draws._jumped(key, far), far + 8), draws._jumped(key, 2 * far + 8)
    assert np.array_equal(twice[1:], once[1:]) and twice[0] >> 31 == once[0] >> 31
    assert np.array_equal(draws.uniform(3, far, 9)[4:], draws.uniform(3, far + 4, 5))


def test_polynomial():
    """Of degree 19937; the generator's words satisfy it."""
    whole = draws.characteristic()
    assert whole.bit_length() == draws.BITS + 1 and whole & 1 and draws._reduced(whole) == 0
    assert draws.power(draws.BITS + 5) == draws._reduced(1 << draws.BITS + 5) and draws.power(0) == 1
    words = draws._generator(draws._key(7)).random_raw(draws.BITS + 40)
    terms = np.flatnonzero(np.array(list(f"{whole:b}"[::-1])) == "1")
    assert all(np.bitwise_xor.reduce(words[terms + k]) == 0 for k in range(30))


def test_starts_of_arrays_are_the_stream():
    rng = np.random.RandomState(5)
    for got in kernel.start((7, 4, 3), 3, 5):
        assert np.array_equal(got, rng.random_sample(got.shape))


def slices(df, side, columns):
    rows = sorted((r["b"], np.frombuffer(r["m"]).reshape(-1, columns)) for r in df.select("b", "m").collect())
    assert all(b * side == sum(len(m) for _, m in rows[:k]) for k, (b, _) in enumerate(rows))
    return np.vstack([m for _, m in rows])


@pytest.mark.parametrize("step", [0, draws.STEP])
def test_starts_of_slices_equal_those_of_arrays(spark, monkeypatch, step):
    monkeypatch.setattr(draws, "STEP", step)
    monkeypatch.setattr(blocks, "SIDE", 4)
    shape, rank, seeds = (11, 3, 9), 2, (0, 3)
    tensor = blocks.BlockedTensor.build(tensorize.from_numpy(spark, np.ones(shape)))
    try:
        keys = [("all", s) for s in seeds]
        for mode, side in enumerate(tensor.sides):
            got = slices(cp._starts(tensor, mode, keys, rank, None, {"all": 11}), side, 4)
            assert np.array_equal(got, np.hstack([kernel.start(shape, rank, s)[mode] for s in seeds]))
        own = {"a": [0, 2, 5, 10], "b": list(range(1, 10))}
        members = spark.createDataFrame([(t, k, i) for t, rows in own.items() for k, i in enumerate(rows)], "task string, pos int, sample_idx int")
        keys = [(t, s) for t in own for s in seeds]
        for mode, side in enumerate(tensor.sides):
            got = slices(cp._starts(tensor, mode, keys, rank, members, {t: len(r) for t, r in own.items()}), side, 8)
            for k, (t, s) in enumerate(keys):
                want, mine = kernel.start((len(own[t]), *shape[1:]), rank, s)[mode], got[:, 2 * k : 2 * k + 2]
                assert np.array_equal(mine[own[t]] if mode == 0 else mine, want)
                assert mode or not np.delete(mine, own[t], axis=0).any()
    finally:
        tensor.close()
