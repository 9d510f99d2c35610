"""Growth of the near-duplicate join."""

import random

import numpy as np

from wearline.llm import neardup


def sets_of(*members):
    s = neardup.Sets.__new__(neardup.Sets)
    arrays = [np.unique(np.array(x, np.uint64)) for x in members]
    s.h = np.concatenate(arrays)
    s.n = np.array([len(x) for x in arrays])
    s.doc = np.repeat(np.arange(len(arrays)), s.n)
    s.first = np.concatenate(([0], np.cumsum(s.n)))
    return s


def shared(s, common=None):
    doc, key = s.keys(common)
    return set(key[doc == 0].tolist()) & set(key[doc == 1].tolist())


def test_linked_sets_share_extra_keys_in_any_order():
    rng = random.Random(5)
    for n in [1, 5, 16, 63, 64, 65, 127, 200, 255, 500, 1023, 1024, 1500, 2047] * 4:
        base = [rng.getrandbits(64) for _ in range(n)]
        # the smallest set that still links, by loss alone; or as many exchanged as still link
        other = base[: -(-80 * n // 100)] if rng.random() < 0.5 else base[: n - n // 9] + [rng.getrandbits(64) for _ in range(n // 9)]
        common = len(set(base) & set(other))
        assert 100 * common >= 80 * (len(base) + len(other) - common)
        s = sets_of(base, other)
        every = np.unique(s.keys(offer_all=True)[1].view(np.uint64))
        late = np.sort(every[np.array([rng.random() < 0.3 for _ in every], bool)])
        for order in (None, late):
            found = shared(s, order)
            assert len(found) >= neardup.extra(min(s.n.tolist())) or found & set(neardup.FEW_KEYS)


def test_a_passage_makes_no_candidates_of_large_sets():
    rng = random.Random(6)
    passage = [rng.getrandbits(64) for _ in range(9)]
    s = sets_of(*[passage + [rng.getrandbits(64) for _ in range(1200)] for _ in range(20)])
    doc, key = s.keys()
    by = [set(key[doc == d].tolist()) for d in range(20)]
    pairs = [(a, b) for a in range(20) for b in range(a) if by[a] & by[b]]
    assert pairs  # they share a key, as the passage has parts for itself
    assert all(len(by[a] & by[b]) < neardup.extra(1200) for a, b in pairs)
    every, count = np.unique(s.keys(offer_all=True)[1], return_counts=True)
    late = np.sort(every[count > 1].view(np.uint64))
    assert not np.isin(s.keys(late)[1].view(np.uint64), late).any()  # known to many, they are not offered
