import numpy as np

from tidemark.llm import spotsigs


def _groups(sets, similarity):
    """What near_duplicates deals: for every (signature, partition) the members, with the place of the signature and whether they come from below."""
    count = {x: sum(x in s for s in sets) for s in sets for x in s}
    groups = {}
    for i, s in enumerate(sets):
        part = int(spotsigs.length_partition(np.array([len(s)]), similarity)[0])
        for at, x in enumerate(sorted(s, key=lambda x: (count[x], x))):
            for up in (False, True):
                groups.setdefault((x, part + up), []).append((i, at, up))
    return groups


def test_groups_link_every_alike_pair():
    rng = np.random.default_rng(5)
    base = [set(map(int, rng.choice(300, size=int(rng.integers(8, 60)), replace=False))) for _ in range(60)]
    sets = base + [set(list(b)[int(rng.integers(0, 1 + len(b) // 6)) :]) | set(map(int, rng.choice(300, size=2))) for b in base]
    pair = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert len(pair) > 20
    packed = [np.array(sorted(s), ">u4").tobytes() for s in sets]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for rows in _groups(sets, 0.8).values():
        ids, at, up = (np.array(c) for c in zip(*rows))
        for a, b in spotsigs.linked(at, up, np.array([packed[i] for i in ids], object), 0.8):
            root[find(int(ids[a]))] = find(int(ids[b]))
    want = list(range(len(sets)))
    for _ in range(len(sets)):
        for i, j in pair:
            want[i] = want[j] = min(want[i], want[j])
    same = lambda label: {(i, j) for i in range(len(sets)) for j in range(i) if label(i) == label(j)}
    assert same(find) == same(lambda i: want[i])


def test_sets_of_the_partition_below_are_not_compared_twice():
    packed = np.array([np.arange(10, dtype=">u4").tobytes()] * 3, object)
    assert list(spotsigs.linked(np.zeros(3, int), np.array([True, True, True]), packed, 0.8)) == []
    assert len(list(spotsigs.linked(np.zeros(3, int), np.array([True, False, False]), packed, 0.8))) == 2
    # a signature so late that what follows it cannot suffice: the pair is compared in the group of an earlier one
    assert list(spotsigs.linked(np.array([5, 5, 5]), np.zeros(3, bool), packed, 0.8)) == []
