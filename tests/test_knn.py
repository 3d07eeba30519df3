"""Grid k-NN equals brute force, with tiny cells so every group is split."""

import numpy as np
import pytest

from quarry.operators import knn


def brute(Q, X, qids, xids, k, mask=None):
    out = {}
    for i, q in enumerate(Q):
        s = np.round(((X - q) ** 2).sum(1), 9)
        cand = [(s[j], xids[j]) for j in range(len(X)) if mask is None or mask[i][j]]
        out[qids[i]] = [x for _, x in sorted(cand)[:k]]
    return out


@pytest.mark.parametrize("strategy,fan", [("broadcast", 128), ("grid", 128), ("grid", 2), ("broadcast", 1)])
def test_knn_matches_brute_force(spark, monkeypatch, strategy, fan):
    monkeypatch.setattr(knn, "REDUCE_FAN", fan)
    rng = np.random.default_rng(1)
    X = rng.integers(0, 4, size=(300, 6)).astype(np.float32)      # many exact ties
    Q = rng.integers(0, 4, size=(40, 6)).astype(np.float32)
    idx = spark.createDataFrame([(int(i), X[i].tolist()) for i in range(len(X))], "chunk_id long, embedding array<float>")
    qs = spark.createDataFrame([(int(i), Q[i].tolist()) for i in range(len(Q))], "query_id long, qvec array<float>")
    got = knn.nearest(idx, qs, 7, q_cell=6, i_cell=25, strategy=strategy)
    res = {}
    for r in got.orderBy("query_id", "rank").collect():
        res.setdefault(r.query_id, []).append(r.chunk_id)
    assert res == brute(Q.astype(float), X.astype(float), list(range(40)), list(range(300)), 7)


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
def test_filtered_search_with_hot_key_and_fallback(spark, strategy):
    rng = np.random.default_rng(2)
    n = 400
    X = rng.normal(size=(n, 5)).astype(np.float32)
    model = ["M1" if i % 3 else f"M{i % 7}" for i in range(n)]       # one key holds most rows
    part = [f"PS{i % 11}" for i in range(n)]
    idx = spark.createDataFrame([(i, X[i].tolist(), model[i], part[i]) for i in range(n)],
                                "chunk_id long, embedding array<float>, model_num string, ps_num string")
    qm = ["M1", "M1", "N/A", "M9", "N/A", "M3"]
    qp = ["N/A", "PS3", "PS4", "N/A", "N/A", "PS999"]
    Q = rng.normal(size=(len(qm), 5)).astype(np.float32)
    qs = spark.createDataFrame([(i, Q[i].tolist(), qm[i], qp[i]) for i in range(len(qm))],
                               "query_id long, qvec array<float>, model_num string, ps_num string")
    got = knn.search(idx, qs, 5, 3, q_cell=2, i_cell=40, strategy=strategy)
    res = {}
    for r in got.orderBy("query_id", "rank").collect():
        res.setdefault(r.query_id, []).append((r.chunk_id, r.fallback))
    Xd, Qd = X.astype(float), Q.astype(float)
    for i in range(len(qm)):
        mask = [[(qm[i] == "N/A" or model[j] == qm[i]) and (qp[i] == "N/A" or part[j] == qp[i]) for j in range(n)]]
        want = brute(Qd[i:i + 1], Xd, [i], list(range(n)), 5, mask)[i]
        if not want:
            want = brute(Qd[i:i + 1], Xd, [i], list(range(n)), 3)[i]
            assert res[i] == [(c, True) for c in want]
        else:
            assert res[i] == [(c, False) for c in want]


@pytest.mark.parametrize("text", [False, True])
def test_selection_equals_sorted_pairs(text):
    rng = np.random.default_rng(5)
    s = rng.integers(0, 5, size=(50, 90)).astype(float)                # many exact ties
    ids = np.stack([rng.permutation(90) for _ in range(50)])
    ids = ids.astype(str).astype(object) if text else ids
    for k in (1, 7, 90, 200):
        score, who = knn._select_topk_pairs(s, ids, k, 9)
        for i in range(50):
            assert list(zip(score[i], who[i])) == sorted(zip(s[i], ids[i]))[:k]


def test_rows_without_a_vector_do_not_hide_the_fallback(spark):
    idx = spark.createDataFrame([(0, None, "M1", "PS1"), (1, [1.0], "M2", "PS2")],
                                "chunk_id long, embedding array<float>, model_num string, ps_num string")
    qs = spark.createDataFrame([(0, [0.0], "M1", "N/A")], "query_id long, qvec array<float>, model_num string, ps_num string")
    assert [(r.chunk_id, r.fallback) for r in knn.search(idx, qs, 3, 3).collect()] == [(1, True)]


def test_postfilter_sees_only_fetch_k(spark):
    X = np.array([[float(i)] for i in range(10)], dtype=np.float32)
    idx = spark.createDataFrame([(i, X[i].tolist(), "M1" if i >= 5 else "M2", "PS1") for i in range(10)],
                                "chunk_id long, embedding array<float>, model_num string, ps_num string")
    qs = spark.createDataFrame([(0, [0.0], "M1", "N/A")], "query_id long, qvec array<float>, model_num string, ps_num string")
    assert knn.knn_postfilter(idx, qs, k=3, fetch_k=6).count() == 1            # only chunk 5 is within the nearest 6
    assert sorted(r.chunk_id for r in knn.knn_filtered(idx, qs, 3).collect()) == [5, 6, 7]


def test_auto_strategy_switches_to_grid_beyond_the_broadcast_bound(spark, monkeypatch):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(120, 4)).astype(np.float32)
    Q = rng.normal(size=(30, 4)).astype(np.float32)
    idx = spark.createDataFrame([(int(i), X[i].tolist()) for i in range(len(X))], "chunk_id long, embedding array<float>")
    qs = spark.createDataFrame([(int(i), Q[i].tolist()) for i in range(len(Q))], "query_id long, qvec array<float>")
    want = brute(Q.astype(float), X.astype(float), list(range(30)), list(range(120)), 4)
    for bound in (1 << 30, 16):                          # broadcast, then too large → grid
        monkeypatch.setattr(knn, "BROADCAST_BYTES", bound)
        res = {}
        for r in knn.nearest(idx, qs, 4, q_cell=7, i_cell=30).orderBy("query_id", "rank").collect():
            res.setdefault(r.query_id, []).append(r.chunk_id)
        assert res == want


@pytest.mark.parametrize("bound", [1 << 26, 600])
def test_postfilter_equals_the_literal_order(spark, monkeypatch, bound):
    """Ties, several partitions, every fetch_k; with a small bound the questions go to the tasks in batches."""
    monkeypatch.setattr(knn, "BROADCAST_BYTES", bound)
    rng = np.random.default_rng(11)
    X, Q = rng.integers(0, 3, size=(200, 4)).astype(np.float32), rng.integers(0, 3, size=(9, 4)).astype(np.float32)
    model = [f"M{i % 4}" for i in range(200)]
    idx = spark.createDataFrame([(i, X[i].tolist(), model[i], "PS1") for i in range(200)],
                                "chunk_id long, embedding array<float>, model_num string, ps_num string").repartition(7)
    asked = [("M1", "N/A"), ("N/A", "N/A"), ("M3", "PS1")]
    qs = spark.createDataFrame([(i, Q[i].tolist(), *asked[i % 3]) for i in range(9)], "query_id long, qvec array<float>, model_num string, ps_num string")
    everything = brute(Q.astype(float), X.astype(float), list(range(9)), list(range(200)), 200)
    for fetch_k in (1, 30, 77, 200):
        got = {}
        for r in knn.knn_postfilter(idx, qs, 6, fetch_k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
        for i in range(9):
            want = [c for c in everything[i][:fetch_k] if asked[i % 3][0] in ("N/A", model[c])][:6]
            assert got.get(i, []) == list(enumerate(want, 1))


def test_bounds_of_the_first_wave_thin_out_candidates(spark):
    """Beyond one wave of partitions, candidates follow waves instead of k x partitions, and the result stays."""
    rng = np.random.default_rng(12)
    X, Q = rng.normal(size=(6400, 8)).astype(np.float32), rng.normal(size=(5, 8)).astype(np.float32)
    idx = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "chunk_id long, embedding array<float>").repartition(64)
    qs = spark.createDataFrame([(i, Q[i].tolist()) for i in range(5)], "query_id long, qvec array<float>")
    sent, take = [], knn._final_topk

    def counted(cand, *args):
        sent.append(cand.count())
        return take(cand, *args)

    knn._final_topk = counted
    try:
        rows = knn.nearest(idx, qs, 10).orderBy("query_id", "rank").collect()
    finally:
        knn._final_topk = take
    got = {i: [r.chunk_id for r in rows if r.query_id == i] for i in range(5)}
    assert got == brute(Q.astype(float), X.astype(float), list(range(5)), list(range(len(X))), 10)
    wave = spark.sparkContext.defaultParallelism
    assert sent[0] == 5 * 10 * wave and sent[-1] < 5 * 10 * 64 / 2


def test_blocks_beyond_a_bound_are_known_by_centre_and_radius():
    rng = np.random.default_rng(13)
    Q, X = rng.normal(size=(50, 3)), rng.normal(size=(400, 3)) * 0.1 + 2
    limit = rng.random(50) * 20
    exact = knn._scores(Q, (Q ** 2).sum(1), X, 9).min(axis=1)
    far = knn._out_of_reach(Q, X, limit)
    assert far.any() and (exact[far] > limit[far]).all()


def test_a_large_batch_is_ranked_without_the_driver(spark, monkeypatch):
    """Beyond the broadcast bound no question comes to the driver, neither for the search nor for the ranks; equal keys stay apart."""
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 16)
    monkeypatch.setattr(knn, "Q_CELL", 4)
    monkeypatch.setattr(knn, "I_CELL", 30)
    rng = np.random.default_rng(17)
    X, Q = rng.integers(0, 3, size=(90, 4)).astype(np.float32), rng.integers(0, 3, size=(11, 4)).astype(np.float32)
    idx = spark.createDataFrame([(i, X[i].tolist(), f"M{i % 3}", "PS1") for i in range(90)],
                                "chunk_id long, embedding array<float>, model_num string, ps_num string").repartition(5)
    qs = spark.createDataFrame([(i, Q[i].tolist(), "M1", "N/A") for i in range(11)], "query_id long, qvec array<float>, model_num string, ps_num string")
    kind = type(qs)

    def no(self, *args, **kw):
        raise AssertionError("a batch of questions came to the driver")

    for name in ("toPandas", "toArrow"):
        monkeypatch.setattr(kind, name, no)
    hits = knn.knn_postfilter(idx, qs, 6, 40)
    twice = knn.knn_postfilter(idx, qs.unionByName(qs.filter("query_id = 0")), 6, 90)
    monkeypatch.undo()
    everything = brute(Q.astype(float), X.astype(float), list(range(11)), list(range(90)), 90)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {i: w for i in range(11) if (w := [c for c in everything[i][:40] if c % 3 == 1][:6])}
    assert {r.query_id for r in twice.collect()} == set(range(11))


def test_a_cell_of_many_questions_equals_brute_force():
    """Questions of a cell are scored a block at a time."""
    import pandas as pd

    rng = np.random.default_rng(18)
    X, Q = rng.normal(size=(70, 3)), rng.normal(size=(23, 3))
    qdf = pd.DataFrame({"q": np.arange(23), "__qv": list(Q)})
    xdf = pd.DataFrame({"__id": np.arange(70), "__xv": list(X)})
    got = knn._cell_kernel(["q"], 5, 9, block=16, qblock=4)(qdf, xdf)
    assert {int(q): g["__id"].tolist() for q, g in got.groupby("q")} == brute(Q, X, list(range(23)), list(range(70)), 5)


def test_a_cell_holds_no_array_of_all_its_scores():
    """Memory and order: scores are held a narrow block at a time, and ties, null ids and missing numbers sort as in a full sort."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(21)

    def cell(Q, X, ids):
        qdf, xdf = pd.DataFrame({"q": np.arange(len(Q)), "__qv": list(Q)}), pd.DataFrame({"__id": ids, "__xv": list(X)})
        tracemalloc.start()
        got = knn._cell_kernel(["q"], 5, 9)(qdf, xdf)
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        return got, peak

    Q, X = rng.integers(0, 3, (600, 4)).astype(float), rng.integers(0, 3, (12000, 4)).astype(float)
    got, peak = cell(Q, X, rng.permutation(12000))
    assert peak < 64                                         # 512 x 12,000 scores alone are 47 MB, and several such arrays were held
    order = {i: sorted(zip(got.score[got.q == i], got["__id"][got.q == i])) for i in range(0, 600, 37)}
    ids = rng.permutation(12000).astype(float)
    for missing in (False, True):
        if missing:
            ids[rng.integers(0, 12000, 3000)] = np.nan
            X[::5] *= 1e20                                   # beyond single precision
        got, _ = cell(Q, X, ids)
        for i in range(0, 600, 37):
            s = np.round(((X - Q[i]) ** 2).sum(1), 9)
            want = np.lexsort((ids, s))[:5]
            mine = got[got.q == i].sort_values(["score", "__id"])
            assert mine.score.tolist() == s[want].tolist() and mine["__id"].fillna(-1).tolist() == np.nan_to_num(ids[want], nan=-1).tolist()
    assert len(order) == 17 and all(len(o) == 5 for o in order.values())


def test_a_cells_rows_are_made_ready_once_for_all_questions(monkeypatch):
    """Blocks of questions share the rows' single-precision form; the best so far pass from block to block of rows."""
    import pandas as pd

    seen, ready = [], knn._ready
    monkeypatch.setattr(knn, "_ready", lambda X: seen.append(len(X)) or ready(X))
    rng = np.random.default_rng(23)
    X, Q = rng.normal(size=(3000, 6)).astype(np.float32), rng.normal(size=(40, 6)).astype(np.float32)
    got = knn._cell_kernel(["q"], 5, 9, block=1100, qblock=8)(
        pd.DataFrame({"q": np.arange(40), "__qv": list(Q)}), pd.DataFrame({"__id": np.arange(3000), "__xv": list(X)}))
    assert {int(q): g["__id"].tolist() for q, g in got.groupby("q")} == brute(Q.astype(float), X.astype(float), list(range(40)), list(range(3000)), 5)
    assert seen == [1100, 1100, 800]


def test_few_places_of_a_mask():
    rng = np.random.default_rng(24)
    for shape in ((3, 8), (5, 7), (16, 512), (1, 1)):
        for share in (0, 0.05, 1):
            mask = rng.random(shape) < share
            assert knn._true(mask).tolist() == np.flatnonzero(mask).tolist()


def test_a_groups_first_column_bounds_its_other_cells(spark, monkeypatch):
    """The first column is searched alone, the others send what doesn't exceed its bounds, and the result stays; keys may repeat or be null."""
    rng = np.random.default_rng(25)
    X, Q = rng.normal(size=(1600, 6)).astype(np.float32), rng.normal(size=(30, 6)).astype(np.float32)
    idx = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "chunk_id long, embedding array<float>")
    qs = spark.createDataFrame([(i, Q[i].tolist()) for i in range(30)], "query_id long, qvec array<float>")
    sent, take = [], knn._final_topk
    monkeypatch.setattr(knn, "_final_topk", lambda cand, *args: sent.append(cand.count()) or take(cand, *args))
    rows = knn.nearest(idx, qs, 5, q_cell=10, i_cell=200, strategy="grid").orderBy("query_id", "rank").collect()
    got = {i: [r.chunk_id for r in rows if r.query_id == i] for i in range(30)}
    assert got == brute(Q.astype(float), X.astype(float), list(range(30)), list(range(1600)), 5)
    assert sent[0] == 30 * 5 and sent[-1] < 30 * 5 * 8
    keys = [None if i % 5 == 0 else i // 2 for i in range(30)]
    again = spark.createDataFrame([(keys[i], Q[i].tolist()) for i in range(30)], "query_id int, qvec array<float>")
    each = [sorted((r.query_id is None, r.query_id or 0, r["rank"], r.chunk_id, r.score) for r in knn.nearest(idx, again, 5, i_cell=i, strategy=s).collect())
            for s, i in (("grid", 200), ("broadcast", 200))]
    assert each[0] == each[1]


def test_a_cell_sends_nothing_beyond_a_questions_limit():
    import pyarrow as pa

    rng = np.random.default_rng(26)
    X, Q = rng.integers(0, 4, (900, 5)).astype(np.float32), rng.integers(0, 4, (40, 5)).astype(np.float32)
    limit = [None if i % 7 == 0 else float(i % 4) for i in range(40)]
    vectors = pa.list_(pa.float32())
    ids = rng.permutation(900)
    x = pa.table({"__id": pa.array(ids, pa.int64()), "__xv": pa.array([None if i % 50 == 0 else v.tolist() for i, v in enumerate(X)], vectors)})
    for bounds in (limit, [x or 3.0 for x in limit]):
        q = pa.table({"q": pa.array(range(40), pa.int32()), "__qv": pa.array(Q.tolist(), vectors), "__limit": pa.array(bounds, pa.float64())})
        got = knn._cell_arrow(["q"], 5, 9)(q, x).to_pylist()
        for i in range(40):
            pairs = sorted((float(((X[j] - Q[i]) ** 2).sum()), int(ids[j])) for j in range(900) if j % 50)[:5]
            want = [p for p in pairs if bounds[i] is None or p[0] <= bounds[i]]
            assert sorted((r["score"], r["__id"]) for r in got if r["q"] == i) == want
    q = q.slice(0, 0)
    empty = knn._cell_arrow(["q"], 5, 9)(q, x)
    assert len(empty) == 0 and empty.schema.types == [pa.int32(), pa.int64(), pa.float64()]


def test_a_cells_vectors_are_read_where_arrow_holds_them():
    import pyarrow as pa

    column = pa.chunked_array([pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], pa.list_(pa.float32()))])
    rows = knn._matrix(column)
    assert rows.tolist() == column.to_pylist() and rows.ctypes.data == column.chunk(0).values.buffers()[1].address
    assert knn._matrix(pa.chunked_array([column.chunk(0).slice(1), column.chunk(0)])).tolist() == column.to_pylist()[1:] + column.to_pylist()
    with pytest.raises(ValueError, match="dimensions"):
        knn._matrix(pa.chunked_array([pa.array([[1.0, 2.0], [3.0]], pa.list_(pa.float32()))]))
