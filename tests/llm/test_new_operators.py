"""op11 to op13 against brute force, and their odd rows."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest

from lorewright.llm import clustering, secrets, whitening

VECTORS = "vec_id long, embedding array<double>, Vec_Id_ string, x string, n long"


def _vectors(spark, rows, slices=3):
    return spark.createDataFrame([(i, v, "c", "c", 7) for i, v in rows], VECTORS).repartition(slices)


def _usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


# --- whitening
@pytest.mark.parametrize("d", [1, 2, 3, 8, 40])
def test_eigen_solves(d):
    rng = np.random.default_rng(d)
    for rank in {d, max(1, d // 2)}:
        a = rng.normal(size=(d, rank))
        a = a @ a.T
        values, vectors = whitening.eigen(a)
        size = max(np.abs(values).max(), 1.0)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * size) and (np.diff(values) <= 1e-12 * size).all()
        assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * size) and np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)


def test_eigen_of_equal_and_zero_values():
    for a in (np.zeros((4, 4)), np.eye(5), np.diag([3.0, 1, 2, 2]), np.ones((6, 6))):
        values, vectors = whitening.eigen(a)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-12)


def test_states_merge_to_the_whole():
    rng = np.random.default_rng(3)
    rows = rng.integers(-300, 300, (90, 5)) + 100_000
    parts = []
    for piece in (rows[:1], rows[1:40], rows[40:40], rows[40:]):
        state = whitening.State(5)
        state.add(piece)
        parts.append(state)
    total = whitening.State(5)
    for p in parts:
        total.merge(p)
    assert total.n == 90 and total.sums() == rows.sum(axis=0).tolist()
    assert np.allclose(total.covariance(), np.cov(rows.T, bias=True), rtol=1e-11, atol=1e-9)


def _whitened_brute(rows, components=4):
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if _usable(v)]
    wide = max(len(v) for _, v in good)
    good = [(i, v + [0] * (wide - len(v))) for i, v in good]
    fit = np.array(sorted({tuple(v) for _, v in good}))
    n, sums = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(wide, wide))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return [(i, n, int(((n * np.array(v) - sums) ** 2).sum()), np.abs((np.array(v) - sums / n) @ axes / np.sqrt(values)), values) for i, v in good]


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.2] + 4).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(150)]  # a third of the rows are one vector
    rows += [(900, None), (901, [float("nan")] * 6), (902, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (903, [float("inf")] * 6), (None, rows[3][1]), (5, rows[9][1]), (904, [1.0, -0.0])]
    found = defaultdict(list)
    for r in whitening.whitened(_vectors(spark, rows)).collect():
        found[r.vec_id, r.deviation].append(r)
        assert r.identity_error < 1e-9
    want = _whitened_brute(rows)
    assert sum(map(len, found.values())) == 4 * len(want) and {k[0] for k in found} == {w[0] for w in want}
    for i, n, deviation, scores, values in want:
        own = found[i, deviation]
        assert {r.component for r in own} == {1, 2, 3, 4} and all(r.n == n for r in own)
        for r in own:
            assert abs(abs(r.whitened) - scores[r.component - 1]) < 1e-9


def test_whitening_of_few_or_no_rows(spark):
    assert whitening.whitened(_vectors(spark, [])).count() == 0
    assert whitening.whitened(_vectors(spark, [(1, None), (2, [None])])).count() == 0
    one = whitening.whitened(_vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    two = whitening.whitened(_vectors(spark, [(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])])).collect()
    assert sorted((r.component, r.whitened is None) for r in two) == [(1, False)] * 2 + [(2, True)] * 2 + [(3, True)] * 2
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in two if r.component == 1)
    huge = whitening.whitened(_vectors(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0])])).collect()
    assert all(r.deviation is None for r in huge)


# --- clustering
def _cluster_brute(rows, count, rounds, wide):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if _usable(v) and len(v) == wide]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        met = defaultdict(list)
        for _, v in kept:
            met[nearest(v)[1]].append(v)
        for k, own in met.items():
            centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    ends = [(i, *nearest(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, k in ends:
        inertia[k] += d
    return sorted(
        (repr(i), k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in ends
    )


def test_clustering_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (np.round(rng.normal(size=4) * 2) / 4).tolist()) for i in range(200)]  # few values: many ties
    rows += [(300 + i, rows[0][1]) for i in range(100)] + [(7, rows[1][1]), (7, rows[2][1]), (None, rows[3][1])]
    rows += [(500, None), (501, [1.0] * 3), (502, [1.0] * 5), (503, [float("nan")] * 4), (504, [None] * 4)]
    got = clustering.clustered(_vectors(spark, rows), count=9, rounds=3, wide=4).collect()
    assert sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == _cluster_brute(rows, 9, 3, 4)


def test_clustering_of_few_huge_and_no_rows(spark):
    assert clustering.clustered(_vectors(spark, [(1, None)]), wide=2).count() == 0
    few = clustering.clustered(_vectors(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])]), count=5, wide=2).collect()
    assert sorted((r.distance, r.inertia) for r in few) == [(0, 0), (0, 0)] and {r.cluster for r in few} == {0, 1}
    far = [(1, [1e15, 0.0]), (2, [-1e15, 0.0]), (3, [-1e15, 4.0])]
    got = {r.vec_id: r for r in clustering.clustered(_vectors(spark, far), count=1, rounds=1, wide=2).collect()}
    assert all(r.distance is None and r.inertia is None and r.cluster == 0 for r in got.values())


def test_screening_never_drops_the_nearest():
    rng = np.random.default_rng(9)
    for scale in (1, 1000, 2**22, 2**30):  # the last two beyond what float32 holds exactly
        base = rng.integers(-scale, scale + 1, (1, 16))
        centroids = base + rng.integers(-2, 3, (12, 16))
        rows = base + rng.integers(-2, 3, (400, 16))
        exact = ((rows[:, None, :].astype(object) - centroids[None, :, :].astype(object)) ** 2).sum(axis=2)
        cluster, distance, overlapped = clustering.nearest(rows, centroids)
        assert cluster.tolist() == [min(range(12), key=lambda k, e=e: (e[k], k)) for e in exact] and distance.tolist() == exact.min(axis=1).tolist()
    rows = rng.integers(-500, 500, (4000, 16))
    centroids = rows[:20]
    assert clustering.nearest(rows, centroids)[2] < 40  # screening decides nearly all rows by itself


# --- secrets
PATTERN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in PATTERN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'token')[k]}:{a}:{b}" for a, k, b in spans)


def _documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "c", "c") for i, t, s in rows], "doc_id long, text string, source string, TEXT_ string, spans string").repartition(3)


LIVE = "Zq7Kp2Vw9Xb4Tn6Rm3Yc"


def test_secrets_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    parts = ["token", "secret=", "api_key", "API-key", "PassWD", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "deadbeef", ".", "é", "😀", "x", "/+", "-", "\n", "ſecret=abcdefghi"]
    rows = [(i, "".join(rng.choice(parts, rng.integers(0, 60))), f"s{i % 5}") for i in range(400)]
    rows += [(400, "secret=token:abcdefghij token=abc password: 'a.b/c=d+e' AKIAAKIAABCDEFGH12 é token=\"" + "0a" * 20 + '"', "s"), (401, None, "s"), (402, "", None), (None, "password=hunter2hunter2", None), (3, rows[3][1], "s9"), (3, rows[3][1], "s9")]
    rows.append((403, "token=ab1 " * 40_000 + "é token=abcdefgh1", "s"))
    want = sorted((repr(i), listed(base_spans(t)), *(sum(k == x for _, k, _ in base_spans(t)) for x in range(3))) for i, t, _ in rows)
    got = []
    for r in secrets.found(_documents(spark, rows)).collect():
        base = ",".join(s for s in r.spans.split(",") if s and not s.startswith("token:"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        got.append((repr(r.doc_id), base, r.n_assign, r.n_access, r.n_hex))
    assert sorted(got) == want


def test_ownership_tells_copied_from_live(spark):
    rows = [(i, f"run with api_key={'Qd8Lr5Ks1Hf7Gj2M'} now", f"s{i}") for i in range(40)]  # an example that all owners copy
    rows += [(100, f"password: {LIVE}", "s1"), (101, f"see {LIVE} there", "s1"), (102, "see Zq7Kp2Vw9Xb4Tn6Rm3Yd there", "s2"), (103, "token=your_token_example1", "s3"), (104, "in Straßenbahnhaltestellenverzeichnis", "s3")]
    rows += [(105, "in a1b2c3d4e5f6g7h8 only", "s3"), (106, "a1b2c3d4e5f6g7h8", "s4")]
    got = {r.doc_id: r for r in secrets.found(_documents(spark, rows)).collect()}
    assert all(got[i].copied_spans == got[i].spans == "assign:9:33" and got[i].live_spans == "" for i in range(40))
    assert got[100].live_spans == got[100].spans == "assign:0:30"
    assert got[101].spans == got[101].live_spans == "token:4:24"  # known as the value of an assignment
    assert got[102].spans == "token:4:24"  # a generated key
    assert got[103].spans == "assign:0:25" and got[103].live_spans == ""
    assert got[104].spans == got[105].spans == got[106].spans == ""


def test_running_sums(spark):
    for n in (1, 2, 127, 128, 129, 1000):
        steps = [(i * 7) % 11 for i in range(n)]
        row = spark.createDataFrame([(steps,)], "a array<int>").select(secrets.running(secrets.F.col("a")).alias("s")).first()
        assert row.s == np.cumsum(steps).tolist()
