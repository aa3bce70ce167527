"""Repetitive test items and texts: whole matches in bounded memory, and against trying all pairs."""

import random
import resource

import numpy as np

from recordlake.llm import decontaminate


def spread(texts):
    """Codes of texts with a zero between them and 27 at the end."""
    return np.concatenate([np.concatenate([np.array(t, np.int64), [0]]) for t in texts] + [np.zeros(27, np.int64)])


def suffixes(items):
    first = np.concatenate([[0], np.cumsum([len(i) for i in items])])
    codes = np.concatenate([np.array(i, np.int64) for i in items]) if items else np.zeros(0, np.int64)
    return decontaminate.TestSuffixes([str(i) for i in range(len(items))], np.zeros(0, np.uint64), codes, first, decontaminate.sorted_suffixes(codes, first))


def test_against_all_pairs():
    rng = random.Random(3)
    for _ in range(150):
        letters = rng.choice([1, 2, 3])
        items = [[rng.randint(1, letters) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 5))]
        codes = spread([[rng.randint(0, letters) for _ in range(rng.randint(0, 30))] for _ in range(3)])
        width = rng.choice([2, 4, 6])
        place, length, item, best = decontaminate.shard_matches(codes, suffixes(items), width)
        got = set(zip(place.tolist(), length.tolist(), item.tolist(), strict=True))
        want, longest = set(), {}
        for n, words in enumerate(items):
            k = min(width, len(words))
            for s in range(len(words) - k + 1):
                for at in range(len(codes) - k):
                    if codes[at : at + k].tolist() == words[s : s + k]:
                        want.add((at, k, n))
                        size = k
                        while k == width and s + size < len(words) and codes[at + size] == words[s + size]:
                            size += 1
                        longest[at] = max(longest.get(at, 0), size)
        assert got == want
        mine = {}
        for at, size in zip(place.tolist(), best.tolist(), strict=True):
            mine[at] = max(mine.get(at, 0), size)
        assert mine == longest


def test_equal_words_take_little_memory():
    """An item of 20,000 equal words against a text of 20,000: pairs would be 400 million."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    place, _, _, best = decontaminate.shard_matches(spread([[1] * 20_000]), suffixes([[1] * 20_000, [1] * 500]), 10)
    assert len(place) == 2 * 19_991 and best.max() == 20_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
