import itertools
import math
import pathlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import text
from lexispark.functions.text import stable_score
from lexispark.operators import controls, dedup, interventions, matching, numbering, policy, recovery, structure
from lexispark.operators import statistics as stt
from lexispark.operators.auction import Region, auction_matching
from lexispark.operators.places import line_matching, transport


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = sorted(rng.integers(1, 7, 2).tolist())
        c = rng.integers(0, 20, (n, m)).astype(float)
        got = matching.assignment(c)
        assert len(set(got)) == n
        assert c[np.arange(n), got].sum() == min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def test_planted_keywords_are_recovered():
    rng = np.random.RandomState(90210)
    p = np.array([0.12, 0.22, 0.33, 0.47, 0.6, 0.72, 0.85])
    a, c = (rng.rand(600, 7) < p).astype(float), (rng.rand(600, 7) < p).astype(float)
    labels = np.array([6, 3, 1, 5, 0, 2, 4])
    got = recovery.recover(a.T @ a / 600, (c.T @ c)[np.ix_(labels, labels)], 600, 20, 0.5, 1, [0, 20])
    assert (got[20] == labels).all()
    assert recovery.metrics(np.array([0, 1, 0, 2]), np.array([0, 1, 2, 2])) == (0.75, pytest.approx(5 / 6))
    with pytest.raises(ValueError):
        recovery.recover(a.T @ a / 600, c.T @ c, 600, 0, 0.1, 1, [0])


def _direct_cost(aux, seen, n, free_kw, free_tok, fixed_kw, fixed_tok):
    """Sums pair by pair, zeros replaced within each fixed keyword's own column."""
    out = np.zeros((len(free_tok), len(free_kw)))
    for column, counts in [(np.diag(aux)[free_kw], np.diag(seen)[free_tok])] + [(aux[free_kw, k], seen[free_tok, t]) for k, t in zip(fixed_kw, fixed_tok, strict=True)]:
        some = [x for x in column if x > 0]
        for j, x in enumerate(column):
            x = x if x > 0 else min(some) / 100 if some else 1e-10
            for i, c in enumerate(counts):
                out[i, j] -= c * math.log(x) + (n - c) * math.log1p(-x)
    return out


def test_costs_with_zeros_equal_the_direct_sum(monkeypatch):
    rng = np.random.RandomState(4)
    for _ in range(20):
        a, c = (rng.rand(90, 9) < 0.2).astype(float), (rng.rand(80, 9) < 0.2).astype(float)
        a[:, 8] = 0
        aux, seen = a.T @ a / 90, c.T @ c
        order, names = rng.permutation(9), rng.permutation(9)
        args = aux, seen, 80, order[:5], names[:5], order[5:], names[5:]
        assert np.abs(recovery.cost_matrix(*args) - _direct_cost(*args)).max() < 1e-10 * 1e3
        assert np.allclose(recovery.cost_matrix(*args), _direct_cost(*args), rtol=1e-12)
    # every update of a whole run, and its assignment against the best one
    updates = []

    def audited(*args):
        mine, theirs = cost(*args), _direct_cost(*args)
        assert np.abs(mine - theirs).max() <= 1e-10 * max(1.0, np.abs(mine).max())
        updates.append(mine)
        return mine

    cost = recovery.cost_matrix
    monkeypatch.setattr(recovery, "cost_matrix", audited)
    aux[8, 8] = 0.01
    recovery.recover(aux, seen, 80, 12, 0.5, 3, [12])
    assert len(updates) == 13
    for m in updates[1:]:
        got = matching.assignment(m)
        assert m[np.arange(len(m)), got].sum() <= min(sum(m[i, p[i]] for i in range(len(m))) for p in itertools.permutations(range(m.shape[1]), len(m))) + 1e-9


def test_runs_are_kept_and_resumed(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/runs"
    pairs = spark.createDataFrame([("d", i, j, 3 + i if i == j else 1, 4 + i if i == j else 1, 20, 30) for i in range(5) for j in range(i, 5)], "dataset string, i long, j long, aux long, client long, n_aux long, n_client long")
    tasks = lambda seeds: spark.createDataFrame([("d", "uniform_iid", s) for s in seeds], "dataset string, distribution string, seed long")
    options = {"steps": 3, "free": 0.5, "checkpoints": [0, 3], "multiplier": 4}
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    first = rows(recovery.resume_runs(path, "x", pairs, tasks([1, 2]), **options))
    made = []
    real = recovery.recovery_runs
    monkeypatch.setattr(recovery, "recovery_runs", lambda p, t, **o: made.append(sorted(r.seed for r in t.collect())) or real(p, t, **o))
    every = rows(recovery.resume_runs(path, "x", pairs, tasks([1, 2, 3]), **options))
    assert made == [[3]] and set(first) < set(every) and every == rows(real(pairs, tasks([1, 2, 3]), **options))
    assert rows(recovery.resume_runs(path, "x", pairs, tasks([1, 2, 3]), **options)) == every and made == [[3]]
    with pytest.raises(ValueError):
        recovery.resume_runs(path, "other data", pairs, tasks([1, 2, 3]), **options)
    with pytest.raises(ValueError):
        recovery.resume_runs(path, "x", pairs, tasks([1]), **options)


def test_a_lost_job_keeps_what_it_had_committed(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/runs"
    pairs = spark.createDataFrame([(d, i, j, 3 + i if i == j else 1, 4 + i if i == j else 1, 20, 30) for d in "de" for i in range(5) for j in range(i, 5)], "dataset string, i long, j long, aux long, client long, n_aux long, n_client long")
    tasks = spark.createDataFrame([(d, k, s) for d in "de" for k in ("each", "zipf_iid") for s in range(2)], "dataset string, distribution string, seed long")
    options = {"steps": 3, "free": 0.5, "checkpoints": [3], "multiplier": 4}
    real, calls = recovery.recovery_runs, []

    def dies(p, t, **o):
        calls.append(t.count())
        if len(calls) == 3:
            t = t.withColumn("seed", F.when(F.col("seed") >= 0, F.raise_error(F.lit("executor lost")).cast("long")))
        return real(p, t, **o)

    monkeypatch.setattr(recovery, "recovery_runs", dies)
    with pytest.raises(Exception, match="executor lost"):
        recovery.resume_runs(path, "x", pairs, tasks, at_once=2, **options)
    kept = {tuple(r) for r in recovery.finished_runs(spark, path).drop("digest").collect()}
    assert len(kept) == 4 and calls == [2, 2, 2]
    calls[:] = [0] * 3
    every = {tuple(r) for r in recovery.resume_runs(path, "x", pairs, tasks, at_once=3, **options).collect()}
    assert calls[3:] == [3, 1] and kept < every and every == {tuple(r) for r in real(pairs, tasks, **options).collect()}


def test_draws_follow_their_distributions(spark):
    tasks = spark.createDataFrame([("a", k, s) for k in ("each", "uniform_iid", "zipf_iid") for s in range(3)] + [("b", "each", 1), ("b", "zipf_iid", 1)], "dataset string, distribution string, seed long")
    sizes = spark.createDataFrame([("a", 20), ("b", 1)], "dataset string, k long")
    got = recovery.drawn_queries(tasks, sizes, 400).collect()
    of = lambda d, k, s: [r["keyword"] for r in sorted((r for r in got if (r["dataset"], r["distribution"], r["seed"]) == (d, k, s)), key=lambda r: r["position"])]
    assert [sorted(of("a", "each", s)) for s in range(3)] == [list(range(20))] * 3 and of("a", "each", 0) != of("a", "each", 1)
    harmonic = sum(1 / (i + 1) for i in range(20))
    for s in range(3):
        for kind, share in (("uniform_iid", lambda i: 1 / 20), ("zipf_iid", lambda i: 1 / (i + 1) / harmonic)):
            q = of("a", kind, s)
            assert len(q) == 8000 and all(abs(q.count(i) / 8000 - share(i)) < 5 * math.sqrt(share(i) / 8000) for i in range(20))
    assert of("b", "each", 1) == [0] and of("b", "zipf_iid", 1) == [0] * 400
    with pytest.raises(Exception, match="no such distribution"):
        recovery.drawn_queries(tasks.withColumn("distribution", F.lit("other")), sizes).collect()


def test_prices_of_the_last_step_change_nothing_but_work():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 6):
        for _ in range(40):
            c, price = rng.integers(0, 9, (n, n)).astype(float), rng.normal(size=n) * 20
            best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            for _ in range(2):
                got = matching.assignment(c, price)
                assert sorted(got) == list(range(n)) and c[np.arange(n), got].sum() == best


def test_sparse_matching_is_the_best():
    rnd = random.Random(11)
    for _ in range(400):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        edges = [[(j, float(rnd.randint(0, 9))) for j in range(m) if rnd.random() < 0.5] for _ in range(n)]
        cost = {(i, j): c for i, e in enumerate(edges) for j, c in e}
        got = matching.sparse_matching(m, edges)
        value = lambda p: (-sum(j >= 0 for j in p), sum(cost[i, j] for i, j in enumerate(p) if j >= 0))
        alone = [p for p in itertools.product(*[[-1, *[j for j, _ in e]] for e in edges]) if len({j for j in p if j >= 0}) == sum(j >= 0 for j in p)]
        assert tuple(got) in alone and value(got) == min(map(value, alone))


def test_lengths_are_matched_best(spark):
    rnd = random.Random(3)
    rows = lambda n, o: [(o + i, rnd.randint(0, 40), rnd.randint(1, 40)) for i in range(n)]
    left, right = rows(6, 0), rows(6, 100)
    got = controls.length_matching(*[spark.createDataFrame(x, "id long, a long, b long") for x in (left, right)], 2.0).collect()
    gap = lambda x, y: (abs(math.log(x[1] / y[1])), abs(math.log(x[2] / y[2])))
    fits = {(x[0], y[0]): sum(gap(x, y)) for x in left for y in right if x[1] and y[1] and max(gap(x, y)) <= math.log(2.0) + 1e-12}
    best = (0, 0.0)
    for p in itertools.permutations([y[0] for y in right]):
        taken = [(x[0], y) for x, y in zip(left, p, strict=True) if (x[0], y) in fits]
        # any subset of what fits may be taken, and more pairs are always better
        best = min(best, (-len(taken), sum(fits[t] for t in taken)))
    assert all((r["left"], r["right"]) in fits for r in got)
    assert (-len(got), round(sum(r["cost"] for r in got), 9)) == (best[0], round(best[1], 9))
    edges = spark.createDataFrame([("x", 2, 0.5), ("x", 3, 0.25), ("z", 9, 1.0)], "left string, right long, cost double")
    assert sorted(tuple(r) for r in matching.optimal_matching(edges, most=1).collect()) == [("x", 3, 0.25), ("z", 9, 1.0)]


def test_rows_of_one_place_are_matched_as_one(spark):
    rnd = random.Random(4)
    sides = [[(o + i, rnd.choice([2, 3, 4, 40, 50]), rnd.randint(1, 4)) for i in range(k)] for o, k in ((0, 40), (100, 33))]
    frames = [spark.createDataFrame(x, "id long, a long, b long") for x in sides]
    gap = lambda x, y: [abs(math.log(x[k] / y[k])) for k in (1, 2)]
    fits = {(x[0], y[0]): sum(gap(x, y)) for x in sides[0] for y in sides[1] if max(gap(x, y)) <= math.log(1.5) + 1e-12}
    best = matching.sparse_matching(133, [[(y, c) for (x, y), c in fits.items() if x == i] for i in range(40)])
    want = sum(j >= 0 for j in best), sum(fits[i, j] for i, j in enumerate(best) if j >= 0)
    turned = [(b, a) for a, b in fits]
    for most in (100, 0):
        for flip in (False, True):
            got = controls.length_matching(*(reversed(frames) if flip else frames), 1.5, most=most).collect()
            assert all((r["left"], r["right"]) in (turned if flip else fits) for r in got)
            assert len({r["left"] for r in got}) == len({r["right"] for r in got}) == len(got) == want[0]
            assert sum(r["cost"] for r in got) == pytest.approx(want[1])


def test_units_between_places_go_the_best_way():
    rnd = random.Random(1)
    for _ in range(200):
        sides = [[(a, b, rnd.randint(1, 3)) for a, b in {(rnd.randint(1, 6), rnd.randint(1, 6)) for _ in range(rnd.randint(1, 5))}] for _ in range(2)]
        bound = rnd.choice([0, 1, 2, 3])
        gap = lambda x, y: (abs(x[0] - y[0]), abs(x[1] - y[1]))
        fits = [[(j, float(sum(gap(x, y)))) for j, y in enumerate(sides[1]) if max(gap(x, y)) <= bound] for x in sides[0]]
        near = lambda i: (np.array([j for j, _ in fits[i]], int), np.array([c for _, c in fits[i]], float))
        got = transport([x[2] for x in sides[0]], [y[2] for y in sides[1]], near, 2.0 * bound, [(i, j) for i, e in enumerate(fits) for j, c in e if c == 0])
        rows, cols = ([i for i, x in enumerate(s) for _ in range(x[2])] for s in sides)
        best = matching.sparse_matching(len(cols), [[(k, dict(fits[i])[j]) for k, j in enumerate(cols) if j in dict(fits[i])] for i in rows])
        want = sum(k >= 0 for k in best), sum(dict(fits[i])[cols[k]] for i, k in zip(rows, best, strict=True) if k >= 0)
        assert (sum(k for *_, k in got), sum(k * dict(fits[i])[j] for i, j, k in got)) == want


def test_days_apart_are_matched_along_a_line(spark, monkeypatch):
    rnd = random.Random(6)
    # day 4.25 is near day 4, all others stand alone
    sides = [[(o + i, rnd.choice([1.0, 2.0, 3.0, 4.0, 4.25]), rnd.choice([100.0, 102.0, 104.04, rnd.uniform(90, 120)])) for i in range(40)] for o in (0, 100)]
    frames = [spark.createDataFrame(x, "id long, day double, size double") for x in sides]
    edges = matching.range_edges(*frames, 0.5, 1.02).collect()
    fits = {(r["left"], r["right"]): r["cost"] for r in edges}
    best = matching.sparse_matching(140, [[(y, c) for (x, y), c in fits.items() if x == i] for i in range(40)])
    made = []
    whole = matching.range_edges
    monkeypatch.setattr(matching, "range_edges", lambda a, b, *more: made.extend(r["day"] for r in a.collect()) or whole(a, b, *more))
    got = matching.optimal_range_matching(*frames, 0.5, 1.02).collect()
    assert set(made) <= {4.0, 4.25}
    assert all(fits[r["left"], r["right"]] == r["cost"] for r in got)
    assert len({r["left"] for r in got}) == len({r["right"] for r in got}) == len(got) == sum(j >= 0 for j in best)
    assert sum(r["cost"] for r in got) == pytest.approx(sum(fits[i, j] for i, j in enumerate(best) if j >= 0), abs=1e-4)


def test_a_line_is_matched_best():
    rnd = random.Random(5)
    for _ in range(300):
        x, y = (np.sort(np.array([rnd.randint(0, 30) for _ in range(rnd.randint(1, 8))])) for _ in range(2))
        bound = rnd.choice([0, 1, 3, 6])
        got = line_matching(x, y, np.searchsorted(y, x - bound), np.searchsorted(y, x + bound, "right"), lambda i, run: np.abs(y[run] - x[i]))
        best = matching.sparse_matching(len(y), [[(j, float(abs(u - v))) for j, v in enumerate(y) if abs(u - v) <= bound] for u in x])
        assert (len(got), sum(abs(x[i] - y[j]) for i, j in got)) == (sum(j >= 0 for j in best), sum(abs(x[i] - y[j]) for i, j in enumerate(best) if j >= 0))


def region_value(edges, m, price, held, step, start):
    """A region whose nodes all come in at once, at given prices: what each right node and each single left node is paid."""
    region = Region([sorted(e) for e in edges], list(price), [-1] * m, list(held), step)
    for b in start:
        region.place(b)
    return region


def test_a_region_finds_the_best_at_its_prices():
    rnd = random.Random(8)
    for _ in range(300):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        edges = [[(j, float(rnd.randint(1, 12))) for j in range(m) if rnd.random() < 0.6] for _ in range(n)]
        price, held = [float(rnd.randint(0, 6)) for _ in range(m)], [rnd.random() < 0.5 for _ in range(m)]
        r = region_value(edges, m, price, held, 0.0, range(n))
        worth = [dict(e) for e in edges]
        got = sum(worth[i][j] - price[j] for i, j in enumerate(r.partner) if j >= 0)
        options = itertools.product(*[[-1, *w] for w in worth])
        best = max(sum(worth[i][j] - price[j] for i, j in enumerate(p) if j >= 0) for p in options if len({j for j in p if j >= 0}) == sum(j >= 0 for j in p))
        assert got == best
        # nobody would gain by another partner at the new prices, or by staying single
        for i, w in enumerate(worth):
            own = w[r.partner[i]] - r.price[r.partner[i]] if r.partner[i] >= 0 else 0.0
            assert own >= -1e-9 and all(own >= v - r.price[j] - 1e-9 for j, v in w.items())


@pytest.mark.parametrize(("n", "m", "most"), [(60, 50, 200), (40, 70, 60)])
def test_large_components_are_matched_over_regions(spark, n, m, most):
    rnd = random.Random(n)
    left, right = [(i, rnd.random() * 6) for i in range(n)], [(500 + j, rnd.random() * 6) for j in range(m)]
    edges = [(i, j, round(abs(x - y), 6), x) for i, x in left for j, y in right if abs(x - y) < 0.45]
    df = spark.createDataFrame(edges, "left long, right long, cost double, at double")
    got = auction_matching(df, slack=1e-4, at="at", most=most).collect()
    cost = {(i, j): c for i, j, c, _ in edges}
    assert all(cost[r["left"], r["right"]] == r["cost"] for r in got) and len({r["left"] for r in got}) == len(got) == len({r["right"] for r in got})
    best = matching.sparse_matching(m, [[(j - 500, c) for a, j, c, _ in edges if a == i] for i in range(n)])
    total = sum(cost[i, 500 + j] for i, j in enumerate(best) if j >= 0)
    assert len(got) == sum(j >= 0 for j in best) and total - 1e-9 <= sum(r["cost"] for r in got) <= total + n * 1e-4
    again = matching.optimal_matching(df.drop("at"), most=10**6).collect()
    assert len(again) == len(got) and sum(r["cost"] for r in again) == pytest.approx(total)


def test_greedy_matching_equals_the_scan(spark):
    rnd = random.Random(2)
    edges = [(a, 100 + b, rnd.randint(0, 9)) for a in range(12) for b in range(12) if rnd.random() < 0.4]
    df = spark.createDataFrame(edges, "left long, right long, cost long")
    got = {(r["left"], r["right"]) for r in matching.greedy_matching(df, [F.col("cost"), F.col("left"), F.col("right")]).collect()}
    used, want = set(), set()
    for a, b, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert got == want
    best = matching.optimal_matching(df).collect()
    assert len(best) >= len(want)


def test_sequential_dedup_equals_the_loop(spark):
    rnd = random.Random(5)
    for threshold in (0.0, 0.3, 0.5, 0.85):
        rows = []
        for i in range(40):
            s = sorted({rnd.choice("abcdef") for _ in range(rnd.randint(0, 5))})
            # some records of one set differ in their texts
            rows.append((i, f"r{i}", rnd.choice(["en", "fr"]), "".join(s) + rnd.choice(["", "", "!"]), s))
        reps, want = [], {}
        for i, rid, lang, h, s in rows:
            exact = next((r for r in reps if r[2] == lang and r[3] == h), None)
            if exact:
                want[i] = ("exact", exact[1])
                continue
            best = None
            for r in reps:
                if r[2] == lang:
                    j = 1.0 if not s and not r[4] else len(set(s) & set(r[4])) / len(set(s) | set(r[4]))
                    if j >= threshold and (best is None or j > best[0]):
                        best = (j, r[1])
            if best:
                want[i] = ("near", best[1])
            else:
                want[i] = ("unique", rid)
                reps.append((i, rid, lang, h, s))
        got = dedup.deduplicate(spark.createDataFrame(rows, "pos long, record_id string, lang string, hash string, s array<string>"), threshold).collect()
        assert {r.pos: (r.status, r.canonical_record_id) for r in got} == want


def test_statistics(spark):
    assert stt.t_critical(9) == pytest.approx(2.2621571628, abs=1e-9) and stt.t_critical(1) == pytest.approx(12.7062047364, abs=1e-8)
    d = spark.createDataFrame([("a", i, 0.1) for i in range(10)], "c string, seed long, d double")
    r = stt.sign_flip(d, ["c"], "seed", "d").first()
    assert r.resolution == 2 / 2**10 and r.p == pytest.approx(2 / 2**10) and r["mean"] == pytest.approx(0.1)
    p = spark.createDataFrame([("f", "x", 0.01), ("f", "y", 0.02), ("f", "z", 0.9)], "f string, k string, p double")
    assert [round(r.adjusted, 9) for r in stt.holm(p, ["f"], "p", ["k"]).orderBy("p").collect()] == [0.03, 0.04, 0.9]
    one = stt.summary(spark.createDataFrame([("a", 1.0)], "c string, v double"), ["c"], "v").first()
    assert one.n == 1 and one.sd is None and one.low is None
    assert math.isclose(stt.t_two_sided(2.2621571628, 9), 0.05, abs_tol=1e-9)


def test_sign_flips_equal_enumeration(spark):
    rnd = random.Random(4)
    groups = {f"g{n}{i}": [rnd.choice([rnd.gauss(0.3, 1), 1.0, -1.0, 0.0]) for _ in range(n)] for n in (1, 2, 3, 7, 10, 12) for i in range(2)}
    groups |= {"same": [0.1] * 11, "zero": [0.0] * 5}
    df = spark.createDataFrame([(g, i, x) for g, d in groups.items() for i, x in enumerate(d)], "c string, seed long, d double")
    got = {r.c: r.p for r in stt.sign_flip(df, ["c"], "seed", "d").collect()}
    for g, d in groups.items():
        seen = abs(sum(d)) - 1e-12
        hits = sum(abs(sum(x * s for x, s in zip(d, signs, strict=True))) >= seen for signs in itertools.product((1, -1), repeat=len(d)))
        assert got[g] == hits / 2 ** len(d), g
    with pytest.raises(Exception, match="too many runs"):
        stt.sign_flip(df.withColumn("c", F.lit("all")).withColumn("seed", F.monotonically_increasing_id()), ["c"], "seed", "d").collect()


def test_numbers_in_time_however_crowded(spark):
    import hashlib

    rnd = random.Random(5)
    times = ["2024-01-01T10:00:00Z"] * 150 + [f"2024-01-01T10:00:00.{rnd.randint(0, 3)}Z" for _ in range(100)] + [f"2024-01-0{rnd.randint(1, 3)}T10:{rnd.randint(10, 59)}:00Z" for _ in range(150)] + [None] * 60
    rows = [(t, hashlib.sha256(str(i).encode()).hexdigest()) for i, t in enumerate(times)]
    want = {k: n for n, (_, k) in enumerate(sorted(rows, key=lambda r: (r[0] or "", r[1])))}
    df = spark.createDataFrame(rows, "at string, id string")
    for crowd in (4, 50, 10_000):
        got = {r.id: r.pos for r in numbering.numbered_in_time(df, "pos", "at", "id", crowd).collect()}
        assert got == want, crowd


def test_average_ranks_and_cuts_by_hash(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.choice([rnd.gauss(0, 100), 0.0, 1.5, -1.5, 1e-9, 3e300]), i) for i in range(600)] + [(None, 2.0, 1), ("a", None, 2)]
    df = spark.createDataFrame(rows, "g string, v double, i long")
    got = stt.with_average_rank(df, ["g"], "v", "r").collect()
    assert len(got) == len(rows)
    for r in got:
        own = [v for g, v, _ in rows if g == r.g and v is not None]
        assert r.r == (None if r.v is None else sum(v < r.v for v in own) + (sum(v == r.v for v in own) + 1) / 2)
    scored = df.withColumn("s", F.sha2(F.col("i").cast("string"), 256)).withColumn("n", F.when(F.col("g") == "a", 37).when(F.col("g") == "b", 10_000).otherwise(0))
    for hot in (scored, scored.withColumn("s", F.when(F.col("i") % 2 == 0, F.concat(F.lit("0ab"), "s")).otherwise(F.col("s")))):
        kept = sorted((r.g, r.i) for r in numbering.smallest(hot, "s", F.col("n"), "i", within=["g"]).collect())
        every = {g: sorted((r.s, r.i) for r in hot.collect() if r.g == g) for g in "ab"}
        assert kept == sorted([("a", i) for _, i in every["a"][:37]] + [("b", i) for _, i in every["b"]])


def test_structure_of_a_small_matrix(spark):
    sets = [{0, 1, 3}, {2}, {0, 1, 2, 3}, set(), {3}]
    inc = spark.createDataFrame([("x", d, k) for d, row in enumerate(sets) for k in row], "lang string, doc_id long, rank long")
    docs = spark.createDataFrame([("x", d) for d in range(5)], "lang string, doc_id long")
    kw = spark.createDataFrame([("x", k, f"k{k}", n) for k, n in enumerate([2, 2, 2, 3])], "lang string, rank long, token string, df long")
    p = structure.profile(docs, kw, inc).first()
    assert p.density == round(9 / 20, 6) and p.alternative_share == 0.75 and p.empty_docs == 1 and p.df_q50 == 2.0
    assert structure.jaccard_summary(structure.access_jaccard(kw, structure.cooccurrence(inc))).first().identical_pairs == 1


def test_thinning_nests(spark):
    inc = spark.createDataFrame([(d, k) for k in range(4) for d in range(10 + 10 * k)], "doc long, kw long")
    small, large = ({tuple(r) for r in interventions.thin(inc, rate, 3, 1).collect()} for rate in (0.2, 0.5))
    assert small < large and len([1 for d, k in large if k == 3]) == 20


def test_numbering_equals_one_sort(spark):
    rnd = random.Random(5)
    values = [rnd.randint(-300_000, 300_000) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long").repartition(5)
    got = {r["id"]: r["n"] for r in numbering.numbered(df, "n", numbering.number_range(F.col("v")), "v", "id").collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(500), key=lambda i: (values[i], i)))}
    assert numbering.numbered(df.where("false"), "n", numbering.number_range(F.col("v")), "v").count() == 0


def test_returned_sets(spark):
    issued = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "t string")
    back = spark.createDataFrame([("a", "keep"), ("b", "maybe"), ("c", "keep"), ("c", "keep"), ("x", None)], "t string, decision string")
    got = {tuple(r) for r in policy.set_errors(issued, back, ["t"], F.col("decision").isin("keep", "pending")).collect()}
    assert got == {("d", "missing"), ("x", "unexpected"), ("c", "repeated"), ("b", "invalid"), ("x", "invalid")}
    got = dict(map(tuple, policy.import_decisions(issued, back, ["t"], "decision", ["keep"]).collect()))
    assert got == {"a": "keep", "b": "pending", "c": "pending", "d": "pending"}


def test_cached_runs_are_taken_over(spark):
    families = spark.createDataFrame([("f", "x:k9", "new", ["u"], [0, 1]), ("g", "x:k9", "new", ["u"], [0])], "family string, dataset string, digest string, distributions array<string>, seeds array<long>")
    cache = spark.createDataFrame([("x:k9", "u", 0, "new"), ("x:k9", "u", 0, "new"), ("x:k9", "u", 1, "old")], "dataset string, distribution string, seed long, digest string")
    got = sorted(tuple(r) for r in recovery.expanded_tasks(families, cache).collect())
    assert got == [("f", "x:k9", "u", 0, "reuse"), ("f", "x:k9", "u", 1, "run"), ("g", "x:k9", "u", 0, "reuse")]


def test_level_contrasts_and_shared_keys(spark):
    rows = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 0, 2, 3.0), ("a", 1, 1, 2.0), ("a", 1, 2, 6.0)], "c string, run long, level long, v double")
    assert [tuple(r)[:4] for r in stt.adjacent_contrasts(rows, ["c"], "run", "level", "v").collect()] == [("a", 2, 2, 3.0)]
    assert [tuple(r) for r in stt.shared_keys(rows, rows.where("run = 0"), ["c", "run", "level"], ["c"]).collect()] == [("a", 2, 2, 0)]
    m = spark.createDataFrame([("a", "base", 1.0), ("a", "new", 3.0), ("b", "new", 3.0)], "g string, condition string, x double")
    assert sorted(map(tuple, structure.metric_differences(m, ["g"], "condition", "base", ["x"]).collect())) == [("a", "new", 2.0), ("b", "new", None)]


def test_intervention_flags(spark):
    before = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc long, kw long")
    pairs = spark.createDataFrame([(0, 1)], "donor long, recipient long")
    got = interventions.invariants(before, interventions.collide(before, pairs), pairs).first()
    assert tuple(got) == (0, 1, True, False, True, False)
    assert controls.pair_sample(spark.range(5).select(F.col("id").alias("kw")), 4, 1).count() == 4


def test_p_of_correlations(spark):
    pairs = [(r, n) for r in (0.0, 0.1, -0.55, 0.93, 1.0) for n in (3, 4, 5, 6, 11, 40, 101)]
    df = spark.createDataFrame(pairs, "r double, n long")
    got = [x[0] for x in df.select(stt.correlation_p(F.col("r"), F.col("n"))).collect()]
    for (r, n), p in zip(pairs, got, strict=True):
        want = 0.0 if abs(r) == 1 else stt.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
        assert p == pytest.approx(want, abs=1e-9), (r, n)
    assert spark.createDataFrame([(0.5, 2)], "r double, n long").select(stt.correlation_p(F.col("r"), F.col("n"))).first()[0] is None


def test_numbering_within_groups(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.randint(0, 500_000)) for i in range(300)]
    got = numbering.numbered(spark.createDataFrame(rows, "id long, g string, v long"), "n", numbering.number_range(F.col("v")), "v", "id", within=["g"]).collect()
    want = {}
    for g in ("a", "b", None):
        want |= {r[0]: n for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])))}
    assert {r["id"]: r["n"] for r in got} == want


def test_copies_make_no_pairs(spark, monkeypatch):
    seen = []
    real = dedup.similar_pairs
    monkeypatch.setattr(dedup, "similar_pairs", lambda s, t: seen.append(s.count()) or real(s, t))
    rows = [(i, f"r{i}", "en", "same" if i % 4 else "same!", ["a", "b"]) for i in range(400)] + [(500, "r500", "en", "other", ["c"])]
    got = dedup.deduplicate(spark.createDataFrame(rows, "pos long, record_id string, lang string, hash string, s array<string>"), 0.85).collect()
    assert seen == [2]
    status = {r.pos: (r.status, r.canonical_record_id, r.similarity) for r in got}
    assert status[0] == ("unique", "r0", 1.0) and status[4] == ("exact", "r0", 1.0) and status[1] == ("near", "r0", 1.0) and status[500] == ("unique", "r500", 1.0)


def test_repeated_blocks_equal_the_loop(spark):
    rnd = random.Random(4)
    for size in (3, 12):
        rows = [(i, f"l{rnd.randint(0, size)}", f"r{rnd.randint(0, size)}") for i in range(60)] + [(60, None, "x"), (61, "", "y"), (62, "z", None)]
        left, right, want = set(), set(), set()
        for i, a, b in rows:
            if (a or "") not in left and (b or "") not in right:
                left.add(a or ""), right.add(b or ""), want.add(i)
        got = dedup.drop_repeated_blocks(spark.createDataFrame(rows, "pos long, a string, b string"), "a", "b")
        assert {r.pos for r in got.collect()} == want


def test_too_few_is_an_error(spark):
    inc = spark.createDataFrame([(d, 0) for d in range(8)] + [(d, 1) for d in range(2, 10)], "doc long, kw long")
    docs, pairs = spark.createDataFrame([(d,) for d in range(10)], "doc long"), spark.createDataFrame([(0, 1)], "donor long, recipient long")
    for change in (lambda: interventions.similar_access(inc, docs, pairs, 0.1, 1), lambda: interventions.equalise(inc, docs, pairs, 1)):
        with pytest.raises(Exception):
            change().collect()
    drawn = interventions.similar_access(inc, docs, pairs, 0.9, 1)
    assert drawn.where("kw = 1").count() == 8
    with pytest.raises(Exception):
        controls.shared_terms(spark.createDataFrame([("s", "t", 1)], "source string, token string, df long"), spark.createDataFrame([(1,)], "n long"), 2).collect()
    with pytest.raises(Exception):
        matching.looked_up(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "x")], "id long, v string"), "id").collect()
    with pytest.raises(ValueError):
        controls.similarity_pairs(spark.createDataFrame([(0, 1, 1), (1, 5, 9)], "kw long, aux long, client long"), 1, 0.9)


def test_drawn_recipients_keep_their_frequency(spark):
    rnd = random.Random(2)
    rows = [(d, k) for d in range(60) for k in range(5) if rnd.random() < 0.3]
    inc, docs = spark.createDataFrame(rows, "doc long, kw long"), spark.createDataFrame([(d,) for d in range(60)], "doc long")
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "donor long, recipient long")
    best = controls.cooccurrence_match(inc, docs, pairs, 3, 5)
    after = controls.drawn_incidence(inc, docs, pairs, best, 3, 5).collect()
    count = lambda rows, k: sum(r[1] == k for r in rows)
    for donor, recipient in ((0, 1), (2, 3)):
        assert count(after, recipient) == count(rows, recipient)
        assert not {d for d, k in after if k == recipient} & {d for d, k in rows if k == donor}
    assert {tuple(r) for r in after if r[1] in (0, 2, 4)} == {r for r in rows if r[1] in (0, 2, 4)}


def test_screen_equals_all_pairs(spark):
    rnd = random.Random(6)
    made = lambda n, o: [(o + i, sorted(rnd.sample("abcdefghij", rnd.randint(1, 8)))) for i in range(n)]
    a, b = made(15, 0), made(60, 100)
    frames = [spark.createDataFrame(x, "id long, s array<string>") for x in (a, b)]
    for threshold in (0.3, 0.6, 1.0):
        want = {(i, j) for i, s in a for j, t in b if len(set(s) & set(t)) / len(set(s) | set(t)) >= threshold}
        assert {(r.a, r.b) for r in dedup.cross_screen(*frames, threshold).collect()} == want


def test_a_screen_sends_no_elements_of_the_larger_side(spark):
    """However well they compress: only those of the smaller side travel whole."""
    a, b = [(i, ["x", f"y{i % 3}"]) for i in range(4)], [(100 + i, ["x", f"y{i % 5}", "z"]) for i in range(300)]
    got = dedup.cross_screen(*[spark.createDataFrame(r, "id long, s array<string>") for r in (a, b)], 0.5)
    assert got.count() == sum(f"y{i % 3}" == f"y{j % 5}" for i in range(4) for j in range(300))
    joins = [x for x in got._jdf.queryExecution().toString().split("== Physical Plan ==")[1].splitlines() if "Join" in x]
    assert any("SortMergeJoin [b#" in x for x in joins) and not any("BroadcastHashJoin [b#" in x or "BroadcastHashJoin [a#" in x and "x#" in x for x in joins)


@pytest.mark.parametrize("often", [2, 8])
def test_similar_pairs_equal_all_pairs_and_few_are_compared(spark, monkeypatch, often):
    """Whatever is known of frequencies, no pair is lost; sets that share less than they might are dropped before they travel."""
    monkeypatch.setattr(dedup, "OFTEN", often)
    monkeypatch.setattr(dedup, "FREQUENT", 6)
    seen = []
    real = dedup.settled
    monkeypatch.setattr(dedup, "settled", lambda df: seen.append(df.columns) or (seen.append(df.count()) if df.columns == ["a", "b"] else None) or real(df))
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["en", "fr", None]), sorted(rnd.sample("abcdefghijklmnopqrst", rnd.randint(1, 20)))) for i in range(90)]
    df = spark.createDataFrame(rows, "pos long, lang string, s array<string>")
    for threshold in (0.3, 0.6, 0.85, 1.0):
        want = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if x[1] and x[1] == y[1] and len(set(x[2]) & set(y[2])) / len(set(x[2]) | set(y[2])) >= threshold}
        assert {(r.a, r.b) for r in dedup.similar_pairs(df, threshold).collect()} == want
    # 90 sets have 4,005 pairs; of those of one language, few reach the last step at a high threshold
    compared = [n for n in seen if isinstance(n, int)]
    assert len(compared) == 4 and compared[2] < 150 and compared[3] < 60


def _texts(rnd, n):
    """Documents as words, near copies and copies among them, some of one word, two or none."""
    out = [("en", " ".join(rnd.choice("abcdefg") * rnd.randint(1, 3) for _ in range(rnd.choice([0, 1, 2, 3, 30, 60])))) for _ in range(n)]
    for lang, text in out[: n // 2]:
        t = text.split(" ")
        t[rnd.randrange(len(t))] = rnd.choice(["z", t[0] or "z"])
        out.append((rnd.choice([lang, "fr"]), " ".join(t)))
    return [(i, lang, text) for i, (lang, text) in enumerate(out)]


def test_sets_given_as_words_part_by_part(spark, monkeypatch):
    """The same pairs and annotations as of shingles, when pairs are compared a few at a time and few keys may travel."""
    monkeypatch.setattr(dedup, "COMPARED", 6)
    monkeypatch.setattr(dedup, "COUNTED", 50)
    for few in (1_000_000, 30, 5):  # keys travel, the other keys do, neither
        monkeypatch.setattr(dedup, "FEW_KEYS", few)
        df = spark.createDataFrame(_texts(random.Random(few), 60), "pos long, lang string, w string")
        s = df.withColumn("s", text.word_shingles(F.lit(""), F.col("w"))).drop("w").collect()
        assert [sorted(r.s) for r in df.select("pos", text.shingles_of(F.col("w")).alias("s")).orderBy("pos").collect()] == [sorted(r.s) for r in sorted(s)]
        want = {(x.pos, y.pos) for x, y in itertools.combinations(s, 2) if x.lang == y.lang and x.s and y.s and len(set(x.s) & set(y.s)) / len(set(x.s) | set(y.s)) >= 0.6}
        assert len(want) > 10 and {(r.a, r.b) for r in dedup.similar_pairs(df.where("w <> ''"), 0.6).collect()} == want
        named = df.select("pos", F.concat(F.lit("r"), "pos").alias("record_id"), "lang", F.sha2("w", 256).alias("hash"), "w")
        for threshold in (0.0, 0.6) if few == 30 else ():
            got, shingled = (sorted(map(tuple, dedup.deduplicate(d, threshold).collect())) for d in (named, named.withColumn("s", text.shingles_of(F.col("w"))).drop("w")))
            assert got == shingled and len(got) == 90


def test_similar_pairs_leave_no_sets_on_disk(spark):
    """What one step shuffles is gone before the next: all that stays are counts of rows."""
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    kept = lambda: {f: f.stat().st_size for d in dirs for f in pathlib.Path(d).rglob("shuffle_*.data")}
    df = spark.createDataFrame(_texts(random.Random(3), 200), "pos long, lang string, w string").where("w <> ''")
    df = df.withColumn("s", text.word_shingles(F.lit(""), F.col("w"))).drop("w")
    before = kept()
    assert dedup.similar_pairs(df, 0.6).count() > 50
    time.sleep(1)
    left = {f: n for f, n in kept().items() if f not in before}
    assert sum(left.values()) < 5_000, left


def test_sides_of_a_range_join_travel_few_times(spark):
    """All pairs, also those at the bounds themselves, though a left row goes to less than three cells."""
    rnd = random.Random(21)
    for days, ratio in ((1.0, 1.05), (0.25, 1.2), (0.0, 1.05), (2.0, 1.0)):
        made = lambda n, o: [(o + i, rnd.choice([rnd.randint(-6, 30) * 1.0, rnd.uniform(-6, 30)]), rnd.choice([1000.0 * ratio ** rnd.randint(-20, 20), rnd.uniform(900, 9000)])) for i in range(n)]  # noqa: B023, E731
        left, right = made(300, 0), made(300, 1000)
        a, b = [spark.createDataFrame(r, "id long, day double, size double") for r in (left, right)]
        want = {(x[0], y[0]) for x in left for y in right if abs(x[1] - y[1]) <= days and max(x[2], y[2]) / min(x[2], y[2]) <= ratio}
        got = [(r.left, r.right) for r in matching.range_edges(a, b, days, ratio).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert matching.dealt(a, b, days, ratio)[0].count() < 3 * 300


def test_ranges_are_matched_without_all_their_pairs(spark, monkeypatch):
    """Bands of rising cost, the first pair and the ends, against all admissible pairs: with copies, and rows that have no partner."""
    rnd = random.Random(12)
    made = lambda n, o: [(o + i, float(rnd.randint(0, 4)), rnd.choice([100.0, 101.5, 103.0, 120.0, 0.0, 900.0 + o])) for i in range(n)]
    a, b = [spark.createDataFrame(made(n, o), "id long, day double, size double") for n, o in ((60, 0), (50, 1000))]
    tie = lambda x, y: stable_score(7, x, y)
    every = matching.range_edges(a, b, 1.0, 1.05)
    edges = {(r.left, r.right) for r in every.collect()}
    want = {tuple(r) for r in matching.greedy_matching(every, [F.col("cost"), tie(F.col("left"), F.col("right"))]).select("left", "right", "o0").collect()}
    seen = []
    real = matching.greedy_matching
    monkeypatch.setattr(matching, "greedy_matching", lambda e, *o: seen.append(e.count()) or real(e, *o))
    assert {tuple(r) for r in matching.greedy_range_matching(a, b, 1.0, 1.05, tie).collect()} == want
    assert sum(seen) < len(edges)
    first = every.orderBy("cost", tie(F.col("left"), F.col("right"))).select("left", "right").first()
    assert matching.cheapest_range_edge(a, b, 1.0, 1.05, tie).collect() == [first]
    ends = matching.range_ends(a, b, 1.0, 1.05).collect()
    assert {r.left for r in ends} - {None} == {x for x, _ in edges} and {r.right for r in ends} - {None} == {y for _, y in edges}
    far = b.withColumn("day", F.lit(99.0))
    assert not matching.cheapest_range_edge(a, far, 1.0, 1.05, tie).head(1) and not matching.range_ends(a, far, 1.0, 1.05).head(1)


def test_a_large_block_of_rows_is_dealt_over_the_cores(spark, tmp_path, monkeypatch):
    from lexispark import session

    monkeypatch.setattr(session, "SMALL_SHARE", 4096)
    one, even = str(tmp_path / "one"), str(tmp_path / "even")
    rows = spark.range(20000).withColumn("text", F.sha2(F.col("id").cast("string"), 256))
    rows.coalesce(1).write.parquet(one)
    rows.repartition(8).write.parquet(even)
    share = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    dealt = session.spread(spark.read.parquet(one), "id")
    assert max(share(dealt)) < 20000 / 2 and sum(share(dealt)) == 20000
    assert session.spread(spark.createDataFrame([(1,), (2,)], "id long"), "id").rdd.getNumPartitions() <= 16
    # even parts are not shuffled
    assert "Exchange" not in session.spread(spark.read.parquet(even), "id")._jdf.queryExecution().toString()


def test_a_review_reads_its_keywords_from_one_table(spark):
    from lexispark.plans import audits

    for side in audits._review(spark, "/root/testdata/sf0.001"):
        plan = side._jdf.queryExecution().toString()
        assert "documents.parquet" not in plan and "regexp_extract_all" not in plan


def test_stems_of_a_word_alone_move_no_token(spark):
    from lexispark.functions import stemming as st
    from lexispark.operators import conditions
    from lexispark.plans.corpus import RULES, TOKENISER

    texts = [(1, "en", "the running horses jumped happily"), (2, "de", "die Freiheit machten Sachen"), (3, None, "horses things"), (4, "en", ""), (5, "en", None), (5, "en", "things being things"), (6, "fr", "le changement")]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, body string")
    stemmers = {"en": st.english_stemmer(), "de": st.rule_stemmer(RULES)}
    stop = {"en": {"the"}, "fr": {"le"}}
    settings = TOKENISER | {"indexed_fields": ["body"]}
    got = conditions.Condition(settings, stop, stemmers).documents(docs)
    plan = got._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    # the same stemmers by the table of the vocabulary, whose documents have one row each
    by_table = conditions.Condition(settings, stop, {k: s.word for k, s in stemmers.items()})
    want = by_table.documents(docs.where("doc_id <> 5"))
    rows = lambda df: sorted(tuple(str(r[c]) for c in ("doc_id", "lang", "tokens", "removed", "changed")) for r in df.collect())
    assert got.columns == want.columns and rows(got.where("doc_id <> 5")) == rows(want)
    assert [r["tokens"] for r in got.where("doc_id = 5").orderBy(F.size("tokens")).collect()] == [[], [st.english_stem(w) for w in ("things", "being", "things")]]
    with pytest.raises(Exception, match="empty stem"):
        conditions.Condition(settings, {}, {"en": st.rule_stemmer([st.Rule("things", "", 1)]), "de": st.Stemmer(None, lambda t: F.transform(t, lambda x: F.lit("")))}).documents(docs).collect()


def test_pairs_of_orders_lie_so_that_copies_take_little(spark, tmp_path):
    rng = random.Random(4)
    places = [(float(rng.randrange(12)), round(rng.uniform(90, 110), 2)) for _ in range(120)]
    sides = []
    for side in (0, 1):
        rows = [(1000 * rng.randrange(10**9) + i, *place) for place in places[side::2] for i in range(30)]
        rng.shuffle(rows)
        sides.append(rows)
    made = matching.range_edges(*[spark.createDataFrame(s, "id long, day double, size double") for s in sides], 1.0, 1.05)
    made.write.parquet(str(tmp_path / "pairs"))
    got = spark.read.parquet(str(tmp_path / "pairs"))
    near = [(a, b) for a, *p in sides[0] for b, *q in sides[1] if abs(p[0] - q[0]) <= 1 and max(p[1], q[1]) / min(p[1], q[1]) <= 1.05]
    assert sorted((r["left"], r["right"]) for r in got.select("left", "right").collect()) == sorted(near)
    taken = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert taken < len(near)  # under a byte a pair


def test_pairs_at_the_bounds_are_in_cells_that_meet(spark):
    sizes = [1.05**i for i in range(12)] + [100.0, 105.0, 110.25, 0.0]
    rows = [(i, d, s) for i, (d, s) in enumerate(itertools.product((0.0, 1.0, 2.0, 2.5), sizes))]
    frame = spark.createDataFrame(rows, "id long, day double, size double")
    for days, most in ((1.0, 1.05), (0.0, 1.05), (1.0, 1.0), (0.5, 1.5)):
        got = sorted((r["left"], r["right"]) for r in matching.range_edges(frame, frame, days, most).collect())
        assert got == sorted((a, b) for a, x, s in rows for b, y, t in rows if s and t and abs(x - y) <= days and max(s, t) / min(s, t) <= most)


def test_rounding_by_whole_millionths_is_that_by_decimals(spark):
    rng = random.Random(8)
    values = [rng.uniform(0, 2) for _ in range(3000)] + [round(rng.uniform(0, 2), 7) for _ in range(3000)] + [(n + 0.5) / 1e6 for n in range(2000)] + [n / 2**21 for n in range(3000)] + [0.0, 1e5, 1e12 + 0.3, 1 / 3e7]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    assert frame.where(~matching._rounded(F.col("x")).eqNullSafe(F.bround("x", 6))).count() == 0
