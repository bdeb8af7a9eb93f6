import itertools

import numpy as np
import pytest

from sigsearch.llm import ann
from sigsearch.operators.joins import shared_folder


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = ann.hilbert_keys(cells, bits)
    order = sorted(range(len(cells)), key=keys.__getitem__)
    assert len(set(keys)) == len(cells)
    assert np.abs(np.diff(cells[order], axis=0)).sum(axis=1).max() == 1


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        score = (x * x[ids.index(q)]).sum(axis=1)
        rows = sorted((-s, i) for s, i in zip(score.tolist(), ids, strict=True) if i != q)[:k]
        out[q] = [(i, -s) for s, i in rows]
    return out


def test_neighbours_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(11)
    centre = rng.standard_normal((6, 12))
    x = np.vstack([c + 0.05 * rng.standard_normal((40, 12)) for c in centre] + [rng.standard_normal((300, 12)) * rng.uniform(0.2, 3, (300, 1))])
    x[100:160] = 4 * x[100]  # one long vector many times
    ids = [int(i) for i in range(len(x))]
    rows = [(i, v.tolist(), 1, "k") for i, v in zip(ids, x, strict=True)]
    odd = [(9000, None, 0, ""), (9020, [0.0] * 12, 0, ""), (9040, [float("nan")] * 12, 0, ""), (9060, [1.0] * 5, 0, ""),
           (9080, [None] + [1.0] * 11, 0, ""), (None, [1.0] * 12, 0, ""), (9100, [float("inf")] * 12, 0, ""), rows[20]]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, curve int, key string")
    found = {}
    for r in ann.nearest(frame, lambda v: v % 20 == 0, k=10).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 10)
    assert found.keys() == want.keys()
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 11)) and q not in [v for _, v, _ in got]
        assert np.allclose([s for _, _, s in got], [x[v] @ x[q] for _, v, _ in got], rtol=1e-12)
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in itertools.pairwise(got))
        hits += len({v for _, v, _ in got} & {v for v, _ in want[q]})
    assert hits / (10 * len(want)) >= 0.9
    assert [v for _, v, _ in found[100]] == list(range(101, 111))  # ties by id, the query itself left out
    assert ann.nearest(frame.limit(0), lambda v: v % 20 == 0).collect() == []
    assert ann.nearest(frame, lambda v: v < 0).collect() == []


def test_few_rows_give_all_of_them(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    found = sorted(map(tuple, ann.nearest(frame, lambda v: v == 0, k=20).collect()))
    assert [(q, r, v) for q, r, v, _ in found] == [(0, 1, 1), (0, 2, 2)]


def test_ties_at_the_border_go_by_id():
    import pandas as pd

    rng = np.random.default_rng(31)
    base = rng.integers(0, 2, (400, 12)).astype(float)
    ids = rng.permutation(400)
    asked = rng.integers(0, 2, (20, 12)).astype(float)
    block = pd.DataFrame({"vec_id": ids, "vector": list(base)})
    found = ann._product(25)(block, pd.DataFrame({"query_id": range(20), "q": list(asked)}))
    for n, q in enumerate(asked):
        want = ids[np.lexsort((ids, -(base @ q)))[:25]]
        assert set(found[found["query_id"] == n]["vec_id"]) == set(want)


@pytest.mark.parametrize("broadcast", [400_000, 0])
def test_stretches_lots_and_rounds_lose_nothing(spark, monkeypatch, broadcast):
    """Windows as wide as the table: whatever is cut, the lists are those of all pairs, equal scores by id."""
    n = 900
    for name, value in (("BLOCK_ROWS", 32), ("TILE", 7), ("TASK_BYTES", 1 << 12), ("QUERY_BYTES", 1 << 14), ("ROUND_BYTES", 0), ("PENDING", 60),
                        ("BROADCAST_ROWS", broadcast)):
        monkeypatch.setattr(ann, name, value)
    monkeypatch.setattr(ann, "measure_window", lambda *_: n)
    rng = np.random.default_rng(41)
    x = rng.integers(-2, 3, (n, 9)).astype(float)
    x[:, 0] = 1  # none is zero
    x[30:90] = x[30]
    ids = [int(i) for i in rng.permutation(n) - 50]
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    again = [(i, (v + (np.arange(9) == 8)).tolist()) for i, v in zip(ids[100:160], x[100:160], strict=True)]  # larger, so they don't count
    frame = spark.createDataFrame(rows + again, "vec_id long, embedding array<float>").repartition(5)
    found = {}
    for r in ann.nearest(frame, lambda v: v % 3 == 0, k=6, curves=3).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == brute(ids, x, [i for i in ids if i % 3 == 0], 6)


def test_scores_closer_than_single_precision():
    import pandas as pd

    rng = np.random.default_rng(43)
    base = rng.standard_normal(20) + 1e-9 * rng.standard_normal((700, 20))
    asked = rng.standard_normal((5, 20))
    found = ann._product(8)(pd.DataFrame({"vec_id": range(700), "vector": list(base)}), pd.DataFrame({"query_id": range(5), "q": list(asked)}))
    for n, q in enumerate(asked):
        score = np.zeros(700)
        for c in range(20):
            score += q[c] * base[:, c]
        want = np.lexsort((np.arange(700), -score))[:8].tolist()
        got = found[found["query_id"] == n]
        assert got["vec_id"].tolist() == want and got["score"].tolist() == score[want].tolist()


def test_disk_holds_vectors_of_one_curve(spark, monkeypatch, tmp_path):
    """Random vectors, whose windows are wide: at most a few copies of them lie on disk at a time, whatever the curves."""
    import os
    import threading

    monkeypatch.setattr(ann, "ROUND_BYTES", 0, raising=False)
    x = np.random.default_rng(47).standard_normal((8_000, 64))
    data = str(tmp_path / "vectors")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4).write.parquet(data)
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    folders = [shared_folder(spark), *(f.getPath() for f in manager.localDirs())]

    def held():
        total = 0
        for folder in folders:
            for at, _, names in os.walk(folder.removeprefix("file:")):
                for name in names:
                    if os.path.exists(f"{at}/{name}"):
                        total += os.stat(f"{at}/{name}").st_size
        return total

    spark.sparkContext._jvm.System.gc()
    floor, seen, over = held(), [0], threading.Event()

    def watch():
        while not over.wait(0.1):
            try:
                seen.append(held() - floor)
            except FileNotFoundError:
                pass

    watcher = threading.Thread(target=watch)
    watcher.start()
    rows = ann.nearest(spark.read.parquet(data), lambda v: v % 20 == 0, k=5).count()
    over.set()
    watcher.join()
    assert rows == 400 * 5
    assert max(seen) < 6 * x.size * 4, max(seen) / x.size / 4
