"""Beat evaluation against plain Python: largest matchings by augmenting paths, continuity one prediction at a time."""

import random

import pytest

from timegrid.operators import evaluate, stats


def largest(p, a, tolerance):
    """Size of a largest one-to-one matching, by augmenting paths."""
    pair = {}

    def place(i, seen):
        for j, y in enumerate(a):
            if abs(p[i] - y) <= tolerance and j not in seen:
                seen.add(j)
                if j not in pair or place(pair[j], seen):
                    pair[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(p)))


def test_matches_are_a_largest_matching(spark):
    rng = random.Random(4)
    cases = [(sorted(rng.sample(range(60), rng.randrange(0, 9))), sorted(rng.sample(range(60), rng.randrange(0, 9)))) for _ in range(1000)]
    p = spark.createDataFrame([(k, float(x)) for k, (xs, _) in enumerate(cases) for x in xs], "track_id long, t double")
    a = spark.createDataFrame([(k, float(x)) for k, (_, xs) in enumerate(cases) for x in xs], "track_id long, t double")
    rows = evaluate.matches(p, a, 4.0).collect()
    for k, (xs, ys) in enumerate(cases):
        own = [r for r in rows if r["track_id"] == k]
        assert len(own) == largest(xs, ys, 4.0) == len({r["p"] for r in own}) == len({r["a"] for r in own})
        assert all(abs(r["error"]) <= 4 and r["error"] == r["p"] - r["a"] for r in own)


def test_two_predictions_between_two_annotations(spark):
    p = spark.createDataFrame([("x", 0.05), ("x", 0.11)], "track_id string, t double")
    a = spark.createDataFrame([("x", 0.0), ("x", 0.06)], "track_id string, t double")
    assert [(r["p"], r["a"]) for r in evaluate.matches(p, a, 0.07).orderBy("p").collect()] == [(0.05, 0.0), (0.11, 0.06)]
    assert evaluate.matches(p.limit(0), a, 0.07).count() == 0
    assert evaluate.f_measure(p, a, 0.07).first()["f"] == 1.0


def steps(x):
    out = [x[i] - x[i - 1] for i in range(1, len(x))]
    return [out[0], *out] if out else [None]


def plain(p, a, share):
    if len(p) < 2 or len(a) < 2:
        return 0.0, 0.0
    right, ps, as_ = [], steps(p), steps(a)
    for i, x in enumerate(p):
        j = max(range(len(a)), key=lambda j: (-abs(a[j] - x), j))
        right.append(abs(a[j] - x) <= as_[j] * share and abs(1 - ps[i] / as_[j]) <= share)
    run = best = 0
    for r in right:
        run = run + 1 if r else 0
        best = max(best, run)
    n = max(len(p), len(a))
    return best / n, sum(right) / n


def kinds(a):
    mid = [x + (y - x) * 0.5 for x, y in zip(a, a[1:])]
    thirds = [z for x, y in zip(a, a[1:]) for z in (x + (y - x) / 3.0, x + (y - x) * 2.0 / 3.0)]
    return [mid, sorted(a + mid), sorted(a + thirds), a[0::2], a[1::2], a[0::3], a[1::3], a[2::3]]


@pytest.mark.parametrize("share", [0.175, 0.4])
def test_continuity_on_all_levels(spark, share):
    rng = random.Random(7)
    tracks = {}
    for k in range(150):
        step = rng.choice([1.0, 0.5, 2.0])
        a = [i * step + rng.uniform(-0.02, 0.02) for i in range(rng.choice([0, 1, 2, 5, 12, 20]))]
        mode = rng.choice(["same", "off", "double", "half", "third", "noise", "none", "broken"])
        p = {"same": a, "off": [x + step / 2 for x in a], "double": sorted(a + [x + step / 2 for x in a]), "half": a[::2], "third": a[::3], "noise": [rng.uniform(0, 20) for _ in a], "none": [], "broken": a[:4] + [x + 0.4 * step for x in a[4:7]] + a[7:]}[mode]
        tracks[k] = (sorted(x + rng.uniform(-0.04, 0.04) * step for x in p), a)
    rows = [spark.createDataFrame([(k, x) for k, v in tracks.items() for x in v[side]], "track_id long, t double").repartition(3) for side in (0, 1)]
    got = {r["track_id"]: tuple(r)[1:] for r in evaluate.levels(*rows, share).collect()}
    assert set(got) == {k for k, (_, a) in tracks.items() if a}
    for k, (p, a) in tracks.items():
        if a:
            c, t = plain(p, a, share)
            more = [plain(p, v, share) for v in kinds(a)] if c <= 0.5 else []
            want = (c, t, max([c, *(x for x, _ in more)]), max([t, *(x for _, x in more)]))
            assert got[k] == pytest.approx(want, abs=1e-12), k


def test_downbeats_of_data_sets_without_them(spark):
    rows = spark.createDataFrame([("smc", "beat", 1.0, 2), ("smc", "downbeat", 0.0, 2), ("gtzan", "downbeat", 0.5, 4)], "dataset string, kind string, value double, n long")
    means = {(r["dataset"], r["kind"]): r["mean"] for r in stats.weighted_means(stats.with_downbeats(rows), ["dataset", "kind"]).collect()}
    assert means == {("smc", "beat"): 1.0, ("gtzan", "downbeat"): 0.5}
