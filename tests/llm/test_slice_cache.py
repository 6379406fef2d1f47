import numpy as np

from numweave.llm import bpe


def test_slices_are_looked_up_once_and_resolved_once():
    asked = []

    def resolve(pieces):
        asked.extend(pieces)
        return np.array([len(p) for p in pieces]), iter(b"".join(pieces))

    cache = bpe.SliceCache(resolve)
    gets = []

    class Counted(dict):
        def get(self, k):
            gets.append(k)
            return dict.get(self, k)

        def __contains__(self, k):
            raise AssertionError("a second look")

        __getitem__ = __contains__

    cache.number = Counted()
    raw = b"ab" + b"c" * 20 + b"ab" + b"d"
    for _ in range(2):
        ids, count = cache.lookup(raw, np.array([0, 2, 22, 24, 25]))
        assert bytes(ids.astype(np.uint8)) == raw and count.tolist() == [2, 20, 2, 1]
    assert sorted(asked) == [b"ab", b"c" * 20, b"d"] and len(gets) == 6
