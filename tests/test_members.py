import math
import random
from collections import Counter

import numpy as np
import pytest

from lodestar.functions import bits, streams
from lodestar.operators import filters, probing, sampling


@pytest.mark.parametrize("name", sorted(streams.SOURCES))
def test_streams_start_anywhere(spark, monkeypatch, name):
    source = streams.SOURCES[name](7)
    want = [source.next() for _ in range(700)]
    for at in (0, 1, 2, 63, 500):
        there = streams.SOURCES[name](7, at=at)
        assert [there.next() for _ in range(50)] == want[at : at + 50]
    monkeypatch.setattr(streams, "STEP", 64)
    assert [r["u"] for r in streams.stream(spark, name, 7, 130).orderBy("n").collect()] == [streams.signed(u) for u in want[:130]]


def test_bounded_draws_are_even_and_redrawn():
    source = streams.WyRand(1)
    found = Counter(streams.bounded(source, 10) for _ in range(20000))
    assert set(found) == set(range(10)) and all(abs(n - 2000) < 250 for n in found.values())

    class Fixed:
        def __init__(self, values):
            self.values = iter(values)

        def next(self):
            return next(self.values) << 32

    # 3 * 0 lies in the biased part, since 2**32 % 3 is 1
    assert streams.bounded(Fixed([0, 1 << 31]), 3) == 1
    with pytest.raises(ValueError):
        streams.bounded(source, 0)


def test_hilbert_points_come_back_and_are_neighbours():
    rng = np.random.default_rng(0)
    for n, axes in ((32, 2), (21, 3)):
        x = [rng.integers(0, 1 << n, 500).astype(np.uint64) for _ in range(axes)]
        back = bits.unhilbert(bits.hilbert(x, n), n, axes)
        assert all((a == b).all() for a, b in zip(x, back, strict=True))
        path = np.stack(bits.unhilbert(np.arange(4000, dtype=np.uint64), n, axes)).astype(np.int64)
        assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_xor_filter():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000):
        have, other = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, 40000))
        one = filters.Xor(np.concatenate([have, have[:10]]))
        assert one.contains(have).all()
        assert one.contains(other).mean() < 2.5 / 256
        assert not n or abs(one.contains(other).mean() - 1 / 256) < 0.6 / 256 or n < 5000


def test_cuckoo_filter_against_a_multiset():
    rng = random.Random(2)
    one, held = filters.Cuckoo(600), Counter()
    pool = [rng.getrandbits(64) for _ in range(500)]
    for _ in range(3000):
        h = rng.choice(pool)
        if rng.random() < 0.55 and sum(held.values()) < 560 and held[one.entry(h)] < 4:
            assert one.add(h)
            held[one.entry(h)] += 1
        elif held[one.entry(h)]:
            assert one.remove(h)
            held[one.entry(h)] -= 1
        assert one.count == sum(held.values()) and 0 <= one.load <= 1.01
    assert all(one.contains(h) for h in pool if held[one.entry(h)])
    assert np.mean([one.contains(rng.getrandbits(64)) for _ in range(4000)]) < 0.02


def test_cuckoo_is_full_and_unites():
    a, rng = filters.Cuckoo(40), random.Random(3)
    added = []
    while True:
        h = rng.getrandbits(64)
        if not a.add(h):
            break
        added.append(h)
    assert a.full and a.load > 0.8 and all(a.contains(h) for h in added)
    assert a.remove(added[0]) and not a.full and all(a.contains(h) for h in added[1:])
    b, c = filters.Cuckoo(100), filters.Cuckoo(100)
    left, right = ([rng.getrandbits(64) for _ in range(30)] for _ in range(2))
    assert all(b.add(h) for h in left) and all(c.add(h) for h in right)
    assert b.union(c) and all(b.contains(h) for h in left + right) and b.count == 60
    d = filters.Cuckoo(100)
    assert all(d.add(rng.getrandbits(64)) for _ in range(100))
    before = d.table.copy()
    assert not d.union(b) and (d.table == before).all() and d.count == 100
    with pytest.raises(ValueError):
        b.union(filters.Cuckoo(4000))


def test_probes_in_shards(spark, monkeypatch):
    monkeypatch.setattr(filters, "SHARD", 100)
    rng = random.Random(4)
    have = [rng.getrandbits(63) - (1 << 62) for _ in range(700)]
    keys = have + [rng.getrandbits(63) - (1 << 62) for _ in range(3000)]
    asked = spark.createDataFrame([(h, i) for i, h in enumerate(keys)] + [(keys[0], -1)], "h long, i long")
    inserted = spark.createDataFrame([(h,) for h in have + have[:5]] + [(None,)], "h long")
    found = {r["i"]: r["found"] for r in filters.xor_probe(inserted, asked, "h").collect()}
    assert len(found) == len(keys) + 1 and all(found[i] for i in range(-1, 700)) and sum(found.values()) < 760
    removed = spark.createDataFrame([(h,) for h in have[:200]], "h long")
    found = {r["i"]: r["found"] for r in filters.cuckoo_probe(inserted, removed, asked, "h").collect()}
    assert all(found[i] for i in range(200, 700)) and sum(found[i] for i in range(200)) < 20


def simulated(keys, load=0.75):
    size = probing.table_size(len(keys), load)
    slots, moved, far, most, seen = {}, 0, 0, 0, set()
    for k, h in keys:
        if k in seen:
            continue
        seen.add(k)
        at, steps = h % size, 1
        while at in slots:
            at, steps = (at + 1) % size, steps + 1
        slots[at] = k
        far, moved, most = far + steps, moved + (steps > 1), max(most, steps)
    return len(keys), len(seen), len(keys) - len(seen), size, moved, far, most


def test_probing_against_a_simulation(spark, monkeypatch):
    monkeypatch.setattr(probing, "WIDTH", 16)
    rng = random.Random(5)
    for shape in ("even", "clustered", "one home", "end"):
        names = [rng.randint(0, 400) for _ in range(500)]
        home = {"even": lambda k: k * 2654435761 % (1 << 31), "clustered": lambda k: k // 9, "one home": lambda k: 1023, "end": lambda k: 1000 + k % 30}[shape]
        keys = [(k, home(k)) for k in names]
        df = spark.createDataFrame([(k, h, o) for o, (k, h) in enumerate(keys)], "k long, h long, o long").repartition(3)
        assert tuple(probing.probe_statistics(df, "k", "h", "o").first()) == simulated(keys)
    assert tuple(probing.probe_statistics(df.limit(0), "k", "h", "o").first()) == (0, 0, 0, 1, 0, 0, 0)


class Sampler:
    """The same draws, row by row."""

    def __init__(self, k, seed):
        self.k, self.random, self.held, self.seen = k, streams.Pcg32(seed), [], 0

    def unit(self):
        return ((self.random.next() >> 12) + 0.5) * 2.0**-52

    def after(self, at):
        return at + 1 + math.floor(math.log(self.unit()) / math.log1p(-math.exp(self.weight)))

    def add(self, x):
        at, self.seen = self.seen, self.seen + 1
        if len(self.held) < self.k:
            self.held.append(x)
            if len(self.held) == self.k:
                self.weight = math.log(self.unit()) / self.k
                self.next = self.after(at)
        elif at == self.next:
            self.held[streams.bounded(self.random, self.k)] = x
            self.weight += math.log(self.unit()) / self.k
            self.next = self.after(at)


def test_reservoir_against_row_by_row(spark, monkeypatch):
    for n, k, seed in ((0, 5, 1), (3, 5, 1), (5, 5, 1), (1000, 7, 2), (20000, 50, 3), (20000, 1, 4)):
        one = Sampler(k, seed)
        for x in range(n):
            one.add(x)
        assert sampling.sampled_positions(n, k, seed) == one.held
    monkeypatch.setattr(sampling, "CHUNK", 7)
    rows = spark.createDataFrame([(i * 3 - 500, f"r{i}") for i in range(900)], "id long, name string").repartition(4)
    got = {r["place"]: r["name"] for r in sampling.reservoir(rows, "id", 20, 9).collect()}
    assert got == dict(enumerate(f"r{i}" for i in sampling.sampled_positions(900, 20, 9)))


def test_every_row_is_equally_likely():
    hits = Counter(p for seed in range(3000) for p in sampling.sampled_positions(40, 10, seed))
    assert all(abs(hits[p] - 750) < 130 for p in range(40))


def test_rendezvous_weights_and_ties(spark):
    """Each node's best of as many scores as its weight; equal scores go to the first name; null keys have no node."""
    from lodestar.functions.mixers import GOLDEN32
    from lodestar.operators import routing

    def mix(x):
        return streams.splitmix((x) & streams.M64, 1)[0]

    nodes = [("b", 3, 12345), ("a", 1, 999), ("twin", 1, 999), ("c", 2, 2**32 - 1)]
    rng = random.Random(1)
    keys = [rng.randrange(1 << 32) for _ in range(400)] + [0, (1 << 32) - 1]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)] + [(-1, None)], "i long, k long")
    got = {r["i"]: r["node"] for r in routing.rendezvous(df, nodes, "k").collect()}
    assert got.pop(-1) is None

    def score(h, k):
        return mix(h << 32 | k)

    for i, k in enumerate(keys):
        best = {}
        for name, weight, h in nodes:
            best[name] = max(score(h if not r else routing._finalise((h + r * GOLDEN32) & 0xFFFFFFFF), k) for r in range(weight))
        assert got[i] == min(best, key=lambda n: (-best[n], n))
    assert "twin" not in got.values() and set(got.values()) == {"a", "b", "c"}
