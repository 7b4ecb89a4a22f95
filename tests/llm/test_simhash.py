import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.simhash import links, near_duplicates


def brute(rows):
    fps = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for (d, _), l in zip(rows, label):
        if d is not None:
            least[l] = min(d, least.get(l, d))
    return sorted(((d, f, least.get(l)) for (d, _), f, l in zip(rows, fps, label)), key=repr)


def test_classes_are_those_of_brute_force(spark):
    base = "one two three four five six seven eight nine ten eleven twelve " * 9
    rows = [(9, base), (7, base), (7, base), (3, base + "more"), (12, base.upper()), (5, ""), (6, None), (8, " \t\n"), (1, "a"), (2, "A b"), (4, "x y z"), (None, "x y z"), (20, base * 40)]
    df = spark.createDataFrame([(d, t, "u", t) for d, t in rows], "doc_id long, text string, fp string, id string")
    got = sorted(((r[0], r[1] & (2**64 - 1), r[2]) for r in near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_links_lose_nothing_in_split_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 200)}
    for c in list(fps)[:4]:
        for _ in range(60):
            x = np.array(c, np.int64).view(np.uint64)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= np.uint64(1) << np.uint64(b)
            fps.add(int(x.astype(np.int64)))
    fps = sorted(fps)
    got = links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(a)] = find(b)
    want = {x: x for x in fps}

    def look(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                want[look(a)] = look(b)
    classes = lambda f: sorted(sorted(x for x in fps if f(x) == r) for r in {f(x) for x in fps})
    assert classes(find) == classes(look)


def test_components_of_chains_stars_and_rings(spark):
    from tessera.llm.common import connected

    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 50)] + [(i, 700 + (i + 1) % 20) for i in range(700, 720)] + [(7, 7), (8, 9)]
    edges += [tuple(int(x) for x in rng.integers(1000, 1100, 2)) for _ in range(80)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = connected(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
