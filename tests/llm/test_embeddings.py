import numpy as np

from wavemark.llm import embeddings, hnsw
from wavemark.llm.embeddings import near_duplicates


def brute(rows, least=0.95):
    ids, out = [i for i, _ in rows], {}
    unit = [None if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v) else np.array(v, float) / np.linalg.norm(v) for _, v in rows]
    link = [[a != b and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least for b in range(len(rows))] for a in range(len(rows))]
    label = list(ids)
    for _ in rows:
        label = [min([label[a], *(label[b] for b in range(len(rows)) if link[a][b])]) for a in range(len(rows))]
    for a, i in enumerate(ids):
        out[i] = (sum(link[a]), label[a], label[a] == i)
    return out


def test_same_as_brute_force(spark):
    r = np.random.default_rng(8)
    rows = []
    for k in range(60):
        base = r.normal(size=16)
        for _ in range(r.choice([1, 1, 2, 9])):
            v = base + r.normal(size=16) * r.choice([0, 0.05, 0.2])
            rows.append((int(len(rows) * 3 + 5), [float(x) for x in np.float32(v * r.choice([1, 7]))]))
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [float("inf")] + [1.0] * 15), (1005, [None] + [1.0] * 15), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [1e-30] * 16), (1009, [1e30] * 16)]
    docs = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<float>, size long, links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_a_large_class_and_null_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(3, 203)] + [(None, [1.0, 0.0]), (500, [1.0, 0.001]), (501, [0.0, 1.0])]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[3].n_links == 201 and got[3].kept and got[202].component_id == 3
    assert got[500].n_links == 201 and got[500].component_id == 3 and got[501].n_links == 0
    assert got[None].n_links == 201 and got[None].component_id is None and not got[None].kept
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_graph_recall_and_round_trip():
    r = np.random.default_rng(2)
    base = r.normal(size=(3000, 32))
    v = np.concatenate((base, base[:300] + 0.05 * r.normal(size=(300, 32)), base[:1] + 0.05 * r.normal(size=(700, 32)))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = hnsw.Graph.loads(hnsw.Graph.build(v).dumps(), v)
    truth = v @ v.T >= 0.95
    rows, nodes = graph.within(v, 0.95, 64)
    hit = np.zeros_like(truth)
    hit[rows, nodes] = True
    assert not (hit & ~truth).any() and (hit & truth).sum() >= 0.99 * truth.sum()
    assert (graph.layers[-1].nbr >= 0).sum(1).min() > 0


def both(rows, least=0.95):
    """Links of all pairs of rows, whatever their ids, and the smallest id that each reaches."""
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    link = np.array([[a != b and unit[a] @ unit[b] >= least for b in range(len(rows))] for a in range(len(rows))])
    reach = link | np.eye(len(rows), dtype=bool)
    for _ in rows:
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in np.flatnonzero(reach[a]) if rows[b][0] is not None]
        out.append((-1 if i is None else i, int(link[a].sum()), -1 if i is None or not ids else min(ids), i is not None and i == min(ids)))
    return sorted(out)


def test_vectors_without_ids_and_with_shared_ids(spark):
    cases = [
        [(None, [1.0, 0.0]), (1, [1.0, 0.001])],
        [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [0.001, 1.0])],
        [(None, [1.0, 0.0]), (None, [1.0, 0.01]), (9, [1.0, 0.02]), (4, [1.0, 0.02]), (4, [-1.0, 0.0]), (None, [0.0, -1.0])],
    ]
    for rows in cases:
        got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in got) == both(rows)


def test_recall_of_the_query_and_its_audit(spark):
    """Many shards, chains of near copies across them; compared with brute force."""
    r = np.random.default_rng(6)
    v = []
    for _ in range(300):
        x = r.normal(size=24)
        for _ in range(int(r.choice([1, 2, 4, 30], p=[0.6, 0.2, 0.18, 0.02]))):
            v.append(np.float32(x))
            x = x + 0.12 * r.normal(size=24)
    unit = np.array(v, np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    truth = unit @ unit.T >= 0.95
    np.fill_diagonal(truth, False)
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    for shards in (1, 7):
        got = {x.vec_id: x for x in near_duplicates(docs, least_shards=shards).collect()}
        n = np.array([got[i].n_links for i in range(len(v))])
        assert (n <= truth.sum(1)).all() and n.sum() >= 0.99 * truth.sum()
        assert got[0].audit_recall >= 0.99


def test_audits_leave_out_the_query_itself():
    r = np.random.default_rng(4)
    v = r.normal(size=(400, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = hnsw.Graph.build(v)
    ef, found, there = embeddings.audited(graph, v, 0.999, True)
    assert (found, there) == (0, 0) and ef >= embeddings.BEAM
    graph.layers[-1].nbr[:] = -1  # a broken graph finds nothing but where it starts: the beam widens as far as it can
    assert embeddings.audited(graph, v, 0.999, True)[0] == 400


def test_audits_ask_for_links_not_for_neighbours_far_off():
    """Without links the beam stays as narrow as finds vectors at the threshold, however hard the nearest others are to find."""
    r = np.random.default_rng(9)
    v = r.normal(size=(6000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    which, made = embeddings.planted(v, 0.95 - embeddings.SLACK, 512)
    assert np.allclose((made * v[which]).sum(1), 0.95, atol=1e-6) and np.allclose(np.linalg.norm(made, axis=1), 1, atol=1e-6)
    graph = hnsw.Graph.build(v)
    ef, found, there = embeddings.audited(graph, v, 0.95 - embeddings.SLACK, True)
    assert (ef, found, there) == (embeddings.BEAM, 0, 0)
    rows, nodes = graph.within(made, 0.95 - embeddings.SLACK, ef)
    assert len(np.unique(rows[nodes == which[rows]])) >= 0.995 * len(which)
    assert embeddings.planted(np.ones((1, 1), np.float32), 0.95, 9)[1].shape == (1, 1)
