import random

from numweave.llm import overlap


def run(spark, monkeypatch, rows):
    calls = []
    search = overlap.subtree_pairs

    def counted(members, nodes, groups, forest=False):
        calls.append((forest, members.count()))
        return search(members, nodes, groups, forest)

    monkeypatch.setattr(overlap, "subtree_pairs", counted)
    out = {r.doc_id: r.component_id for r in overlap.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return out, calls


def test_only_open_subtrees_are_searched_again(spark, monkeypatch):
    """Texts put together from the same passages meet in their subtrees, but none can link."""
    rng = random.Random(2)
    passages = [" ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(10)) for _ in range(30)]
    rows = [(i, " ".join(rng.sample(passages, 6))) for i in range(60)]
    out, calls = run(spark, monkeypatch, rows)
    assert out == {i: i for i, _ in rows}
    assert calls[0][0] and calls[0][1] >= 10 and calls[1:] == []


def test_links_beyond_a_first_pair_that_is_none_are_found(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10 ** 9)}" for _ in range(60)]
    rows = []
    for i in range(60):
        w = list(words)
        for k in range(i // 6):                        # further and further from the first
            w[59 - 2 * k] = f"x{i // 6}_{k}"
        w[0] = f"y{i}"
        rows.append((i, " ".join(w)))
    out, _ = run(spark, monkeypatch, rows)
    sets = [overlap.sets([t])[1] for _, t in rows]
    up = list(range(60))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(60):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    assert out == {i: find(i) for i in range(60)}


def test_points_travel_deflated(spark):
    import zlib

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(400)) for _ in range(5)]
    rows = overlap.sketch(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", overlap.np.zeros(0, "uint64")).collect()
    for r in rows:
        own, s = overlap.sets([texts[r.key]])
        assert zlib.decompress(r.point) == overlap.points(own, s, 1)[0] and len(r.point) < 512 * 0.45
