"""Corrections, merging, neighbours, features and learning against loops and hand-made cases."""

import random

import numpy as np
import pytest
from helpers import fragments
from pyspark.sql import functions as F

from ramify.functions import patterns, scalars
from ramify.operators import correct, merge, ml, neighbors, profile
from ramify.operators.compare import TRAITS
from ramify.operators.fragments import connect_candidates
from ramify.plans import flows
from ramify.plans.queries import QUERIES
from ramify.sources import files


def random_fragments(seed, n=60, h=80, w=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y, x = 20 + rng.randrange(h), 20 + rng.randrange(w)
        dy, dx = rng.choice([(1, 0), (0, 1), (1, 1), (1, -1), (-1, 0), (0, -1)])
        seg = [(y + k * dy, x + k * dx) for k in range(rng.randint(6, 14))]
        out.append((i, rng.choice([1, 2, 3, 3, 3, 4]), round(seg[len(seg) // 2][1] / w, 2), seg))
    return out


def overlaps(ref, other):
    ys = [p[0] for p in other[3]]
    return any(min(ys) <= y <= max(ys) for y in (ref[3][0][0], ref[3][-1][0]))


def primary_pass(rows):
    ends = [p for r in rows if r[1] == 1 for p in (r[3][0], r[3][-1])]
    out = []
    for r in rows:
        touch = any(abs(p[0] - q[0]) <= 2 and abs(p[1] - q[1]) <= 2 for p in (r[3][0], r[3][-1]) for q in ends)
        around = [o[2] < 0.625 for o in rows if o[1] in (1, 3) and overlaps(r, o)]
        hit = r[1] == 3 and 0.3 < r[2] < 0.7 and touch and any(around) and not all(around)
        out.append((r[0], 1 if hit else r[1], r[2], r[3]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_primary_fixpoint(spark, seed):
    rows = random_fragments(seed, 90)
    want = rows
    while (after := primary_pass(want)) != want:
        want = after
    got = {r["id"]: r["dendrite_type"] for r in correct.primary_fixpoint(fragments(spark, rows)).collect()}
    assert got == {r[0]: r[1] for r in want}


def test_second_pass_is_needed(spark):
    lines = [(0, 1, 0.4, [(y, 10) for y in range(0, 6)]), (1, 3, 0.5, [(y, 11) for y in range(7, 13)]),
             (2, 3, 0.5, [(y, 12) for y in range(14, 20)]), (3, 3, 0.9, [(y, 50) for y in range(0, 30)])]
    got = {r["id"]: r["dendrite_type"] for r in correct.primary_fixpoint(fragments(spark, lines)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 3}


def test_nothing_to_correct(spark):
    rows = [(0, 2, 0.5, [(0, x) for x in range(8)])]
    assert correct.primary_fixpoint(fragments(spark, rows)).first()["dendrite_type"] == 2


@pytest.mark.parametrize("seed", range(3))
def test_correct_tertiary(spark, seed):
    rows = random_fragments(seed + 10, 80)
    want = {}
    for r in rows:
        others = [o for o in rows if r[1] == 3 and o[1] == 3 and o[0] != r[0] and overlaps(r, o)]
        hit = any((r[2] > .7 and o[2] > .6 and r[2] >= o[2]) or (r[2] < .3 and o[2] < .4 and r[2] <= o[2]) for o in others)
        want[r[0]] = 4 if hit else r[1]
    got = {r["id"]: r["dendrite_type"] for r in correct.correct_tertiary(fragments(spark, rows)).collect()}
    assert got == want


def test_a_containing_fragment_is_not_an_overlap(spark):
    rows = [(0, 3, .5, [(y, 0) for y in range(0, 30)]), (1, 3, .5, [(y, 9) for y in range(10, 20)])]
    got = {r["id"]: r["overlaps"] for r in correct.y_overlap_exists(correct.spans(fragments(spark, rows))).collect()}
    assert got == {0: False, 1: True}


# ---- merging ----

def step(seg):
    return sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(seg, seg[1:])) / (len(seg) - 1) if len(seg) > 1 else 1.0


def greedy(rows, compat=True):
    """The merging rule for one class, stated over all fragments of the class at once."""
    segs = {r[0]: r[3] for r in rows}
    ids = sorted(segs)
    near = {i: [] for i in ids}
    for i in ids:
        for j in ids:
            if i < j:
                for kind, (p, q) in enumerate([(-1, 0), (-1, -1), (0, 0), (0, -1)]):
                    d = ((segs[i][p][0] - segs[j][q][0]) ** 2 + (segs[i][p][1] - segs[j][q][1]) ** 2) ** 0.5
                    if d <= 20 and d <= 10 * max(step(segs[i]), step(segs[j])):
                        near[i].append((d, j, kind))

    def extend(i, forward, barred):
        chain, own, cur = segs[i], {i}, i
        while True:
            opts = sorted(c for c in near[cur] if (c[2] < 2) == forward and c[1] not in own | barred)
            if not opts:
                return chain, own
            _, j, kind = opts[0]
            add = segs[j][::-1] if kind in (1, 2) else segs[j]
            new = chain + add[1:] if forward else add[:-1] + chain
            seam = new[len(chain) - 2:len(chain) + 2]
            bad = len(new) <= len(chain) or any(a == b for a, b in zip(new, new[1:]))
            for a, b, c in zip(seam, seam[1:], seam[2:]):
                u, v = np.subtract(b, a), np.subtract(c, b)
                if np.linalg.norm(u) > 1e-10 and np.linalg.norm(v) > 1e-10:
                    bad |= float(np.dot(u / np.linalg.norm(u), v / np.linalg.norm(v))) < -0.8
            if bad:
                return chain, own
            chain, own, cur = new, own | {j}, j

    used, out = set(), []
    for i in ids:
        if i in used:
            continue
        f, fu = extend(i, True, used)
        b, bu = extend(i, False, used)
        t, tu = f, fu
        opts = sorted(c for c in near[i] if c[2] >= 2 and c[1] not in fu | used)
        if opts:
            j = opts[0][1]
            e, eu = extend(j, True, used | fu | {j})
            t, tu = e + ([] if compat else segs[i]) + f[len(segs[i]):], fu | eu
        best = f, fu
        for c in ((b, bu), (t, tu)):
            if len(c[0]) > len(best[0]):
                best = c
        used |= best[1]
        if len(best[0]) >= 10:
            out.append((i, best[0]))
    return out


@pytest.mark.parametrize("seed,compat", [(0, True), (1, True), (2, True), (3, False)])
def test_merge_fragments(spark, seed, compat):
    rows = random_fragments(seed + 20, 70, 120, 120)
    got = {}
    for r in merge.merge_fragments(fragments(spark, rows), compat=compat).collect():
        got.setdefault(r["dendrite_type"], []).append((r["start"], [(p["y"], p["x"]) for p in r["branch"]]))
    for c in (1, 2, 3, 4):
        want = greedy([r for r in rows if r[1] == c], compat)
        assert sorted(got.get(c, [])) == want


def odd_lines(seed, n):
    """Fragments of one and two points, with repeated points and sharp folds, among usual ones."""
    rng = random.Random(seed)
    out = []
    for i, _, rx, seg in random_fragments(seed, n, 40, 40):
        kind = rng.randrange(6)
        if kind == 0:
            seg = seg[:rng.randint(1, 2)]
        elif kind == 1:
            seg = seg[:4] + [seg[3]] + seg[4:]
        elif kind == 2:
            seg = seg + [seg[-2]]
        elif kind == 3:
            seg = seg[:3]
        out.append((i, 3, rx, seg))
    return out


@pytest.mark.parametrize("seed,compat", [(4, True), (5, False)])
def test_merge_of_groups_wider_than_a_tile(spark, seed, compat):
    """Every group counts as wide, so that all chains come from pointer jumping."""
    rows = odd_lines(seed + 40, 14)
    got = merge.merge_fragments(fragments(spark, rows), tile=0, compat=compat).collect()
    assert sorted((r["start"], [(p["y"], p["x"]) for p in r["branch"]]) for r in got) == greedy(rows, compat)


def test_a_chain_of_many_links_takes_few_writes(spark, monkeypatch):
    """2,000 links in a row, each joined to the next only: one round, its jobs grow with the logarithm."""
    rows = [(i, 3, .5, [(y, 0) for y in range(20 * i, 20 * i + 19)]) for i in range(2001)]
    writes = []
    for module in (merge, patterns):
        monkeypatch.setattr(module, "cut", lambda df, retire=None, cut=patterns.cut: writes.append(1) or cut(df, retire))
    got = merge.merge_fragments(fragments(spark, rows), threshold=2.0, tile=64).collect()
    assert [(r["start"], len(r["branch"])) for r in got] == [(0, 19 + 2000 * 18)]
    assert len(writes) < 90


def test_minimum_along_ways_that_meet(spark):
    rng = random.Random(7)
    edges = sorted({(min(p), max(p)) for p in ((rng.randrange(60), rng.randrange(60)) for _ in range(50)) if p[0] != p[1]}
                   | {(i, i + 1) for i in range(100, 160)} | {(120, 300), (40, 130)})
    nodes = sorted({n for e in edges for n in e})
    value = {n: rng.randrange(1000) for n in nodes}
    want = dict(value)
    for a, b in sorted(edges):  # edges rise, so one pass in order is enough
        want[b] = min(want[b], want[a])
    for _ in nodes:
        for a, b in edges:
            want[b] = min(want[b], want[a])
    got = merge.carried_minimum(spark.createDataFrame([(1, n, value[n]) for n in nodes], "image_id long, id int, m int"),
                                spark.createDataFrame([(1, a, b) for a, b in edges], "image_id long, a int, b int"), "a", "b")
    assert {r["id"]: r["m"] for r in got.collect()} == want


def test_lone_short_fragment_is_dropped(spark):
    rows = [(0, 1, .5, [(0, x) for x in range(9)]), (1, 1, .5, [(60, x) for x in range(10)])]
    assert [r["start"] for r in merge.merge_fragments(fragments(spark, rows)).collect()] == [1]


def test_chains_only_grow_to_higher_ids(spark):
    rows = [(0, 1, .5, [(0, x) for x in range(20, 32)]), (1, 1, .5, [(0, x) for x in range(0, 12)])]
    links = connect_candidates(fragments(spark, rows)).collect()
    assert {(r["a"], r["b"], r["type"]) for r in links} == {(0, 1, "start_to_end")}


# ---- neighbours and features ----

@pytest.mark.parametrize("seed", range(2))
def test_branch_neighbors(spark, seed):
    rows = random_fragments(seed + 30, 60, 40, 40)
    starts, ends = {}, {}
    for i, _, _, seg in rows:
        starts.setdefault(seg[0], i)
        ends.setdefault(seg[-1], i)
    want = {(i, j) for i, _, _, seg in rows for y, x in seg for table in (starts, ends)
            for (py, px), j in table.items() if abs(py - y) <= 2 and abs(px - x) <= 2}
    got = neighbors.branch_neighbors(fragments(spark, rows), line="segment").collect()
    assert {(r["a"], r["b"]) for r in got} == want


def test_contact_seen_only_from_the_larger_id_is_dropped(spark):
    links = spark.createDataFrame([(1, 5, 2), (1, 2, 2), (1, 2, 7)], "image_id long, a int, b int")
    assert [(r["a"], r["b"]) for r in neighbors.unique_pairs(links).collect()] == [(2, 7)]


def test_feature_columns():
    names = [s for _, s in profile.FEATURE_COLUMNS]
    assert len(names) == 78 == len(set(names)) and names[:5] == ["image", "genotype", "length", "cellbody", "prim-ct"]
    assert [c for c, f, _, _ in TRAITS if f not in names] == ["ol"]


def _branch(spark, rows):
    return spark.createDataFrame(
        [(1, i, c, 12, float(o), float(y), 1.0, 0.0, 5.0) for i, (c, o, y) in enumerate(rows)],
        "image_id long, id int, dendrite_type int, length int, orientation double, mean_y double, curvature double, "
        "tortuosity double, intensity double")


def test_orientation_bins(spark):
    row = profile.orientation_hist(_branch(spark, [(1, 0, 1), (1, 10, 1), (1, 180, 1), (1, 180.0001, 1)])).first()
    assert [row[f"angle_dist_bin{k}"] for k in (1, 2, 18)] == [0.25] * 3 and sum(row[1:]) == 0.75


def test_missing_class_gives_null_ratios(spark):
    row = profile.ratios(_branch(spark, [(1, 5, 1), (2, 5, 1), (3, 5, 1)])).first()
    assert row["len_ratio_14"] is None and row["ct_ratio_23"] == 1.0 and row["ct_ratio_42"] == 0.0


def test_ratio_bug_only_on_request(spark):
    b = _branch(spark, [(1, 5, 1)] * 4 + [(2, 5, 1)] * 2 + [(3, 5, 1), (4, 5, 1)])
    assert profile.ratios(b).first()["len_ratio_34"] == 1.0
    assert profile.ratios(b, compat=True).first()["len_ratio_34"] == profile.ratios(b).first()["len_ratio_12"] != 1.0


def test_half_even(spark):
    row = spark.range(1).select(scalars.um(F.lit(1), 0.5).alias("a"), scalars.um(F.lit(3), 0.5).alias("b")).first()
    assert (row["a"], row["b"]) == (0.0, 2.0)


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_exact_quantiles(spark, n):
    rng = random.Random(n)
    groups = {1: [rng.uniform(-50, 50) for _ in range(n)] + [0.5] * (n // 3), 2: [-0.0, 0.0] * n,
              3: [rng.choice([1e-300, -1e300, 7.0, -7.0]) for _ in range(n)], 4: [rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(n)]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [(1, None), (5, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: r for r in patterns.exact_quantiles(df, ["k"], "v", [0.0, 0.01, 0.5, 0.99, 1.0]).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k]["n"] == len(values)
        assert [got[k][f"q{i}"] for i in range(5)] == pytest.approx(list(np.percentile(values, [0, 1, 50, 99, 100])), rel=1e-12)


def test_components_of_random_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(200)]
    boss = {}
    find = lambda v: v if boss.setdefault(v, v) == v else find(boss[v])
    for a, b in edges:
        boss[find(a)] = find(b)
    got = patterns.components(spark.createDataFrame([(1, a, b) for a, b in edges], "image_id long, a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["node"])
    want = {}
    for v in {v for e in edges if e[0] != e[1] for v in e}:
        want.setdefault(find(v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


# ---- files ----

def test_branch_file_round_trip(spark, tmp_path):
    (tmp_path / "e_run_wt_day3_1_branches.csv").write_text(
        ',id,branch,dendrite_type,length,orientation,mean_x,mean_y,curvature,tortuosity,intensity,neighbors\n'
        '0,0,"[(np.int64(3), np.int64(4)), (np.int64(4), np.int64(4))]",2,2,90.0,4.0,3.5,0.0,0.0,7.5,"[0, 4]"\n'
        '1,1,"[(5, 6)]",3,1,90.0,6.0,5.0,0.0,0.0,7.5,[]\n')
    (tmp_path / "other.csv").write_text("x\n")
    rows = files.scan_branches(spark, str(tmp_path)).orderBy("id").collect()
    assert [[tuple(p) for p in r["branch"]] for r in rows] == [[(3, 4), (4, 4)], [(5, 6)]]
    assert [r["neighbors"] for r in rows] == [[0, 4], []] and rows[0]["image"] == "e_run_wt_day3_1"
    key = files.image_keys(spark.createDataFrame([("/x_y_z/e_run_wt_day3_1_branches.csv",)], "path string")).first()
    assert key["genotype"] == "wt-day3" and key["projection"] == "e_run_wt_day3_1_maxProj.tif"
    assert files.image_manifest(spark, str(tmp_path), pattern="*branches.csv", strain="wt").count() == 1


def test_coerce_attr(spark):
    df = spark.createDataFrame([("1.5",), ("7",), ("a.b",), ("um",)], "t string")
    got = [tuple(r["a"]) for r in df.select(files.coerce_attr(F.col("t")).alias("a")).collect()]
    assert got == [(1.5, None, None), (None, 7, None), (None, None, "a.b"), (None, None, "um")]


# ---- learning ----

def test_components_equal_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4))
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(str(i), "g", *map(float, r)) for i, r in enumerate(a)],
                               "image string, genotype string, " + ", ".join(f"{c} double" for c in cols))
    pcs = ml.Components(df, cols)
    z = (a - a.mean(0)) / a.std(0)
    value, vector = np.linalg.eigh(np.cov(z.T))
    value, vector = value[::-1][:2], vector[:, ::-1][:, :2]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), [0, 1]])
    got = {r["image"]: (r["PC_1"], r["PC_2"]) for r in pcs.scores().collect()}
    assert np.allclose([got[str(i)] for i in range(80)], z @ vector)
    ratio = [r["ratio"] for r in pcs.explained_variance().orderBy("component").collect()]
    assert np.allclose(ratio, value / np.trace(np.cov(z.T)))
    load = {r["feature"]: (r["PC_1"], r["PC_2"]) for r in pcs.loadings().collect()}
    assert np.allclose([load[c] for c in cols], vector * np.sqrt(value))


def _vectors(spark, rows):
    from pyspark.ml.functions import array_to_vector
    df = spark.createDataFrame([(1, i, c, [float(x) for x in v] + [0.0] * (9 - len(v))) for i, (c, v) in enumerate(rows)],
                               "image_id long, id int, label int, v array<double>")
    return df.select("image_id", "id", "label", array_to_vector("v").alias("features"))


def test_smote_balances_between_near_neighbours(spark):
    rng = random.Random(5)
    rows = [(1, (rng.uniform(0, 100), rng.uniform(0, 100), rng.random())) for _ in range(60)]
    rows += [(2, (rng.uniform(0, 9), rng.uniform(0, 9), rng.random())) for _ in range(14)]
    rows += [(2, (4.0, 4.0, 0.5))] * 4 + [(3, (1.0, 1.0, 1.0))]
    df = _vectors(spark, rows)
    out = ml.smote(df, ["image_id", "id"])
    assert {r["label"]: r["n"] for r in ml.class_distribution(out).collect()} == {1: 60, 2: 60, 3: 60}
    mine = np.array([v for c, v in rows if c == 2])
    distance = np.linalg.norm(mine[:, None] - mine[None], axis=2)
    segments = []
    for i in range(len(mine)):
        order = [j for j in np.argsort(distance[i], kind="stable") if j != i]
        reach = distance[i][order[4]] + 1e-12
        segments += [(mine[i], mine[j]) for j in order if distance[i][j] <= reach]
    for r in out.filter("id is null and label = 2").collect():
        p = np.array(r["features"].toArray()[:3])
        gaps = [np.linalg.norm(a + np.clip(np.dot(p - a, b - a) / max(np.dot(b - a, b - a), 1e-300), 0, 1) * (b - a) - p)
                for a, b in segments]
        assert min(gaps) < 1e-9


@pytest.mark.parametrize("cell_rows", [7, 40, 10_000])
def test_nearest_same_class_is_exact(spark, cell_rows):
    """Nine features, a dense clump, a grid of ties and a feature of almost one value, in cells of any size."""
    rng = random.Random(9)
    pts = {tuple(rng.gauss(0, 1) * (30 if d == 0 else 5) for d in range(9)) for _ in range(120)}
    pts |= {tuple(rng.gauss(0, 1e-3) for _ in range(9)) for _ in range(150)}
    pts |= {(100.0, *[float(rng.randint(0, 1)) for _ in range(8)]) for _ in range(120)}
    rows = [(1 + i % 2, p) for i, p in enumerate(sorted(pts))] + [(3, (1.0,) * 9), (4, (1.0,) * 9), (4, (2.0,) * 9)]
    pool = spark.createDataFrame([(c, list(p), 1) for c, p in rows], "label int, vec array<double>, copies long")
    got = {(r["label"], tuple(r["vec"])): [(n["gap"], tuple(n["other"])) for n in r["near"] or []]
           for r in ml.nearest_same_class(pool, pool, 5, cell_rows).collect()}
    assert len(got) == len(rows)
    for c, p in rows:
        want = sorted((float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum())), q) for d, q in rows if d == c and q != p)[:5]
        assert [g for g, _ in got[c, p]] == pytest.approx([g for g, _ in want], abs=1e-12)
        assert [q for _, q in got[c, p]] == [q for _, q in want] or len({round(g, 9) for g, _ in want}) < len(want)


def test_cells_from_a_sample_and_shared_out_cells_are_exact(spark, monkeypatch):
    """Few sampled rows a round, so that cells are cut again, few asked rows a task, and values far from the origin."""
    monkeypatch.setattr(ml, "SAMPLED_ROWS", 60)
    monkeypatch.setattr(ml, "ASKED_ROWS", 7)
    rng = random.Random(19)
    pts = sorted({(1e6 + rng.gauss(0, 1e-3), *[float(rng.randint(0, 2)) for _ in range(2)], rng.gauss(0, 1)) for _ in range(260)})
    rows = [(1 + i % 2, p, 1 + i % 3) for i, p in enumerate(pts)] + [(3, (float("nan"),) * 4, 1), (3, (1.0,) * 4, 1), (3, (2.0,) * 4, 1)]
    pool = spark.createDataFrame([(c, list(p), n) for c, p, n in rows], "label int, vec array<double>, copies long").repartition(3)
    asked = pool.filter("vec[3] > -0.5")
    got = {(r["label"], tuple(r["vec"])): [(n["gap"], tuple(n["other"]), n["copies"]) for n in r["near"]]
           for r in ml.nearest_same_class(pool, asked, 4, 40).filter("label < 3").collect()}
    assert set(got) == {(c, p) for c, p, _ in rows if c < 3 and p[3] > -0.5}
    for c, p in got:
        want = sorted((float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum())), q, n) for d, q, n in rows if d == c and q != p)[:4]
        assert got[c, p] == want
    near = {r["vec"][0]: [n["gap"] for n in r["near"]] for r in ml.nearest_same_class(pool, pool, 4, 40).filter("label = 3").collect()}
    assert near[1.0] == near[2.0] == [2.0]


def test_smote_writes_what_it_makes(spark, monkeypatch):
    """Neither the vectors nor the neighbours are written or repeated: one row for every asked one, and a few for the classes."""
    written = []
    real = ml.cut

    def counted(df, **more):
        out = real(df, **more)
        written.append(out.count())
        return out

    monkeypatch.setattr(ml, "cut", counted)
    rng = random.Random(23)
    rows = [(1 if i < 900 else 2, (rng.random(), rng.random(), rng.random())) for i in range(1300)]
    out = ml.smote(_vectors(spark, rows), ["image_id", "id"])
    assert {r["label"]: r["n"] for r in ml.class_distribution(out).collect()} == {1: 900, 2: 900}
    assert sum(written) <= 400 + 10


def test_smote_takes_some_of_equal_keys(spark):
    rows = [(1, (float(i), 1.0)) for i in range(50)] + [(2, (float(i % 7), 2.0)) for i in range(35)]
    df = _vectors(spark, rows).withColumn("id", F.lit(None).cast("int"))
    out = ml.smote(df, ["id"])
    assert {r["label"]: r["n"] for r in ml.class_distribution(out).collect()} == {1: 50, 2: 50}
    assert all(r["features"][1] == r["label"] and 0 <= r["features"][0] <= 49 for r in out.collect())


def test_cells_stay_small_in_a_dense_class(spark):
    """Every cell holds few rows although nearly all rows lie in one spot and one feature hardly varies."""
    rng = np.random.default_rng(3)
    x = rng.normal(scale=1e-6, size=(6000, 9))
    x[:, 4] = 5.0
    x[:30] += rng.normal(scale=100, size=(30, 9))
    pool = spark.createDataFrame([(1, row, 1) for row in x.tolist()], "label int, vec array<double>, copies long")
    rows, boxes = ml.kd_cells(pool, 200)
    sizes = [r["count"] for r in rows.groupBy("label", "path").count().collect()]
    assert max(sizes) <= 200 and sum(sizes) == 6000 and len(boxes) <= 8


def test_forest_learns_and_reloads(spark, tmp_path):
    rows = [(1 + i % 3, (i % 3 + random.Random(i).random() * 0.5, i % 7)) for i in range(240)]
    df = _vectors(spark, rows)
    model = ml.forest_train(df, trees=10, depth=5)
    ml.save_model(model, str(tmp_path / "m"))
    out = ml.forest_predict(ml.load_model(str(tmp_path / "m")), df)
    assert out.filter("label = dendrite_type").count() > 230
    assert ml.feature_importance(model, spark).first()["feature"] == "orientation"


def test_missing_inputs_do_not_end_a_job(spark):
    """NULL and NaN inputs count as 0, beside rows that have everything."""
    row = {c: 1.0 for c in ml.CLASSIFIER_FEATURES}
    rows = [(1, *row.values()), (2, None, *list(row.values())[1:]), (3, *[None] * 8, float("nan"))]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in ml.CLASSIFIER_FEATURES))
    got = {r.id: list(r.features.toArray()) for r in ml.feature_vector(df).collect()}
    assert got == {1: [1.0] * 9, 2: [0.0] + [1.0] * 8, 3: [0.0] * 9}


def test_bound_on_labelled_rows(spark):
    df = spark.range(400).selectExpr("id", "id % 2 + 1 AS label", *[f"double(id % 7) AS {c}" for c in ml.CLASSIFIER_FEATURES])
    rows = ml.feature_vector(df)
    model = ml.forest_train(rows, trees=3, depth=4, key=["id"], max_labelled_rows=50)
    again = ml.forest_train(rows.repartition(7), trees=3, depth=4, key=["id"], max_labelled_rows=50)
    assert model.toDebugString.splitlines()[1:] == again.toDebugString.splitlines()[1:], "the rows do not depend on partitions"


def test_training_reports_all_it_did(spark):
    """Separable classes, one of them rare: balanced counts, a report, a confusion matrix and importances that add to one."""
    rows = []
    for i in range(240):
        kind = 1 if i % 6 == 0 else 2
        rows.append((1, i, [(3 * i, x) for x in range(8)], kind, *[float(kind * 10 + (i * 7 + k) % 5) for k in range(9)]))
    frag = spark.createDataFrame(rows, "image_id long, id int, segment array<struct<y:int,x:int>>, kind int, "
                                 + ", ".join(f"{c} double" for c in ml.CLASSIFIER_FEATURES))
    label = frag.filter("id <> 5").selectExpr("image_id", "segment[4].y AS y", "segment[4].x AS x", "kind AS label")
    done = flows.train_classifier(frag.drop("kind"), label, smote=True, trees=5, depth=4)
    assert {r["label"]: r["n"] for r in done.counts.collect()} == {1: 40, 2: 199}
    balanced = {r["label"]: r["n"] for r in done.balanced.collect()}
    assert balanced[1] == balanced[2] > 120
    n = done.test.count()
    assert sum(r["p1"] + r["p2"] for r in done.confusion.collect()) == n
    assert {r["label"]: r["f1"] for r in done.report.collect()}["accuracy"] == 1.0
    assert abs(sum(r["importance"] for r in done.importance.collect()) - 1) < 1e-9
    few = flows.train_classifier(frag.drop("kind"), label, trees=2, depth=3, max_labelled_rows=50)
    assert sum(r["n"] for r in few.balanced.collect()) == 50


def test_forest_beats_the_largest_class_on_rows_left_out(spark):
    row = QUERIES["M6_forest_train"](spark, "/root/testdata/sf0.001").first()
    assert row["beats_majority"] and row["accuracy"] > row["largest_class"] + 0.1


def test_a_fragment_without_pixels_has_no_intensity(spark):
    """Its classifier input then counts as 0; the fragment itself stays."""
    mask = spark.createDataFrame([(1, 10, x) for x in range(5, 30)] + [(1, 40, x) for x in range(5, 30)], "image_id long, y int, x int")
    image = spark.createDataFrame([(1, 60, 40)], "image_id long, length_px int, width_px int")
    pixel = mask.filter("y < 20").selectExpr("*", "x AS v")
    out = flows.mask_to_fragments(mask, image, pixel, min_object=5, min_spur=3)
    rows = {r["segment"][0]["y"]: r["average_intensity"] for r in out.collect()}
    assert set(rows) == {10, 40} and rows[40] is None and rows[10] is not None
    assert {r["features"][8] for r in ml.feature_vector(out.filter("average_intensity IS NULL")).collect()} == {0.0}


def test_manifest_lists_by_pattern_and_strain(spark, tmp_path):
    for name in ("a_wt_1_branches.csv", "b_mut_2_branches.csv", "a_wt_1_maxProj.tif"):
        (tmp_path / name).write_text("x")
    (tmp_path / "genotype=wt-day3").mkdir()
    (tmp_path / "genotype=wt-day3" / "part-0.csv").write_text("y")
    names = lambda **k: {r["path"].rsplit("/", 1)[-1] for r in files.image_manifest(spark, str(tmp_path), **k).collect()}
    assert names() == {"a_wt_1_branches.csv", "b_mut_2_branches.csv", "a_wt_1_maxProj.tif", "part-0.csv"}
    assert names(pattern="*.csv", strain="wt") == {"a_wt_1_branches.csv", "part-0.csv"}
    assert names(strain="mut") == {"b_mut_2_branches.csv"}
