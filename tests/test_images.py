"""Binary images, skeletons and paths against plain loops on small random pictures."""

import itertools
import random

import numpy as np
import pytest
from helpers import points
from pyspark.sql import functions as F

from ramify.operators import fragments, geometry, morphology, raster, skeleton
from ramify.plans import flows

H, W = 40, 60
RING = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def random_mask(seed, share=0.45):
    rng = random.Random(seed)
    return {(y, x) for y in range(H) for x in range(W) if rng.random() < share}


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def flood(cells, start, ring):
    seen, todo = {start}, [start]
    while todo:
        y, x = todo.pop()
        for dy, dx in ring:
            p = (y + dy, x + dx)
            if p in cells and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def parts(cells, ring=((0, 1), (1, 0), (0, -1), (-1, 0))):
    left, out = set(cells), []
    while left:
        part = flood(left, min(left), ring)
        out.append(part)
        left -= part
    return out


@pytest.mark.parametrize("seed,tile", [(1, 256), (2, 8), (3, 7)])
def test_components_and_small_objects(spark, seed, tile):
    mask = random_mask(seed, 0.6 if tile == 8 else 0.5)
    got = morphology.label_components(points(spark, mask), tile=tile).collect()
    by_label = {}
    for r in got:
        by_label.setdefault(r["label"], set()).add((r["y"], r["x"]))
    assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, parts(mask)))
    assert all(label == (min(p)[0] << 32 | min(p)[1]) for label, p in by_label.items())
    want = {p for part in parts(mask) if len(part) >= 12 for p in part}
    assert rows(morphology.remove_small_objects(points(spark, mask), 12, tile=tile), "y", "x") == want


def test_diagonal_blobs_are_apart(spark):
    got = morphology.label_components(points(spark, [(0, 0), (0, 1), (1, 2), (1, 3)]))
    assert got.select("label").distinct().count() == 2


def test_long_component(spark):
    snake = {(y, x) for y in range(0, H, 2) for x in range(W)} | {(y, (W - 1) * (y // 2 % 2)) for y in range(1, H, 2)}
    for tile in (256, 9):
        assert morphology.label_components(points(spark, snake), tile=tile).select("label").distinct().count() == len(parts(snake))


@pytest.mark.parametrize("seed,tile", [(3, 256), (4, 8), (5, 11)])
def test_fill_holes(spark, image, seed, tile):
    mask = random_mask(seed, 0.6)
    dark = {(y, x) for y in range(H) for x in range(W)} - mask
    holes = {p for part in parts(dark) if all(0 < y < H - 1 and 0 < x < W - 1 for y, x in part) for p in part}
    assert rows(morphology.fill_holes(points(spark, mask), image, tile=tile), "y", "x") == mask | holes


def test_open_line_at_borders(spark, image):
    runs = {0: (0, 7), 1: (0, 6), 2: (5, 19), 3: (5, 18), 4: (52, 59), 5: (53, 59), 6: (0, 59)}
    mask = {(y, x) for y, (a, b) in runs.items() for x in range(a, b + 1)}
    got = rows(morphology.morph_open_line(points(spark, mask), image, axis="x"), "y", "x")
    assert {y for y, _ in got} == {0, 2, 4, 6}
    assert got == {(y, x) for y in (0, 2, 4, 6) for x in range(runs[y][0], runs[y][1] + 1)}


def thin(mask):
    """Zhang and Suen's two sub-iterations, pixel by pixel."""
    mask = set(mask)
    while True:
        gone_any = False
        for first in (True, False):
            gone = set()
            for y, x in mask:
                p = [(q in mask) for q in ((y - 1, x), (y - 1, x + 1), (y, x + 1), (y + 1, x + 1),
                                           (y + 1, x), (y + 1, x - 1), (y, x - 1), (y - 1, x - 1))]
                n, _, e, _, s, _, w, _ = p
                rises = sum(not a and b for a, b in zip(p, p[1:] + p[:1]))
                free = (not (n and e and s) and not (e and s and w)) if first else (
                    not (n and e and w) and not (n and s and w))
                if 2 <= sum(p) <= 6 and rises == 1 and free:
                    gone.add((y, x))
            mask -= gone
            gone_any |= bool(gone)
        if not gone_any:
            return mask


def test_skeletonize_over_tile_borders(spark):
    mask = random_mask(5, 0.75) | {(y, x) for y in range(10, 30) for x in range(10, 50)}
    got = rows(morphology.skeletonize(points(spark, mask), tile=16, passes=3), "y", "x")
    assert got == thin(mask)


@pytest.mark.parametrize("tile,passes", [(8, 2), (8, 4)])
def test_settled_tiles_are_parked_and_fetched_back(spark, tile, passes):
    """A thick block thins for many rounds and wears a two-pixel bar away from its end, tile after tile; thin lines far off settle at once."""
    mask = {(y, x) for y in range(4, 34) for x in range(4, 30)} | {(y, x) for y in (18, 19) for x in range(30, 120)}
    mask |= {(70, x) for x in range(0, 100, 1)} | {(90 + k, 20 + k) for k in range(30)} | {(60, 110), (61, 110), (60, 111), (61, 111)}
    got = rows(morphology.skeletonize(points(spark, mask), tile=tile, passes=passes), "y", "x")
    assert got == thin(set(mask))


def neighbours(cells, p):
    return [(p[0] + dy, p[1] + dx) for dy, dx in RING if (p[0] + dy, p[1] + dx) in cells]


def all_paths(cells):
    """Node-to-node paths through degree-2 pixels, each once, from its first end in scan order."""
    degree = {p: len(neighbours(cells, p)) for p in cells}
    nodes = sorted(p for p in cells if degree[p] not in (0, 2))
    out, seen = [], set()
    for a in nodes:
        for b in neighbours(cells, a):
            path = [a, b]
            while degree[path[-1]] == 2:
                path.append(next(q for q in neighbours(cells, path[-1]) if q != path[-2]))
            if len(path) > 2 and tuple(path[::-1]) not in seen:
                seen.add(tuple(path))
                out.append(path)
    return out, degree


@pytest.mark.parametrize("seed", [6, 7])
def test_trace_fragments(spark, seed):
    cells = thin(random_mask(seed, 0.7))
    paths, _ = all_paths(cells)
    want = [p for p in paths if len(p) > 5]
    got = skeleton.trace_fragments(points(spark, cells)).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(len(want)))
    assert [[(p["y"], p["x"]) for p in r["segment"]] for r in got] == want


def test_trace_crosses_tiles(spark):
    line = {(y, x) for x, y in zip(range(600), itertools.cycle([3, 3, 4, 4]))}
    got = skeleton.trace_fragments(points(spark, line)).collect()
    assert len(got) == 1 and len(got[0]["segment"]) == 600
    assert [p["x"] for p in got[0]["segment"]] == list(range(600))


def test_prune_spurs(spark):
    cells = thin(random_mask(8, 0.7)) | {(70, x) for x in range(12)} | {(75, x) for x in range(40)}
    circle = {(90, 2), (90, 3), (91, 1), (92, 1), (91, 4), (92, 4), (93, 2), (93, 3)}
    cells |= circle
    paths, degree = all_paths(cells)
    gone = set(circle) - {min(circle)}
    for p in paths:
        ends = (degree[p[0]] == 1) + (degree[p[-1]] == 1)
        size = sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(p, p[1:]))
        if (ends == 1 and size < 10) or (ends == 2 and size < 30):
            gone |= set(p[1:-1])
    loops = [part for part in parts({p for p in cells if degree[p] == 2}, RING)
             if all(len([q for q in neighbours(cells, p) if q in part]) == 2 for p in part)]
    for part in loops:
        size = sum(np.hypot(p[0] - q[0], p[1] - q[1]) for p in part for q in neighbours(part, p)) / 2
        if size < 30:
            gone |= part - {min(part)}
    assert rows(skeleton.prune_spurs(points(spark, cells)), "y", "x") == cells - gone


@pytest.mark.parametrize("seed,shift", [(1, 0), (2, -21), (3, 5)])
def test_boards_and_their_rims(spark, seed, shift):
    """Degrees, edges and crosses over many cells, negative coordinates too, against sets of pixels."""
    rng = random.Random(seed)
    cells = {(rng.randrange(40) + shift, rng.randrange(30) + shift) for _ in range(400)}
    around = {p: {(p[0] + dy, p[1] + dx) for dy, dx in itertools.product((-1, 0, 1), repeat=2) if dy or dx} & cells for p in cells}
    df = points(spark, cells)
    assert {(r["y"], r["x"]): r["degree"] for r in skeleton.stencil_degree(df).collect()} == {p: len(n) for p, n in around.items()}
    edges = skeleton.pixel_adjacency(df).collect()
    assert sorted((r["y"], r["x"], r["ny"], r["nx"]) for r in edges) == sorted((*p, *q) for p, n in around.items() for q in n)
    seeds = {p for p in cells if rng.random() < 0.1} | {(cells_y + 1, 99) for cells_y, _ in list(cells)[:3]}
    grown = {(y + dy, x + dx) for y, x in seeds for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))}
    assert rows(morphology.reconstruct_cross(points(spark, seeds), df), "y", "x") == grown & cells


def walk(cells):
    ends = sorted(p for p in cells if len(neighbours(cells, p)) == 1)
    if len(ends) != 2:
        return None
    at, left, out = ends[0], set(cells), []
    while at:
        out.append(at)
        left.discard(at)
        at = next(iter(sorted(neighbours(left, at))), None)
    return out


def test_order_centre_line(spark):
    shapes = {
        1: [(0, 0), (1, 1), (2, 1), (3, 1), (3, 2), (4, 3)],  # a corner pixel with three neighbours
        2: [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (3, 0), (4, 0)],
        3: [(0, 0), (1, 1), (1, 2), (2, 1), (2, 2), (3, 3)],  # a clump of four
        4: [(0, 0), (0, 1), (0, 2), (1, 3), (1, -1 + 1), (2, 3)],
        5: [(y, 5) for y in range(9)] + [(4, 6)],
    }
    df = spark.createDataFrame([(i, y, x) for i, s in shapes.items() for y, x in s], "image_id long, y int, x int")
    got = {}
    for r in skeleton.order_centre_line(df).orderBy("image_id", "i").collect():
        got.setdefault(r["image_id"], []).append((r["y"], r["x"]))
    assert got == {i: walk(set(s)) for i, s in shapes.items() if walk(set(s))}


def test_centre_lines_through_clumps(spark):
    """Thick stretches and a line that comes back beside itself, walked in windows of four pixels."""
    rng = random.Random(3)
    shapes = {}
    for i in range(8):
        x, cells = 50, set()
        for y in range(60):
            x += rng.choice([-1, 0, 1])
            cells.add((y, x))
            if 3 < y < 55 and rng.random() < 0.25:
                cells.add((y, x + 1))
        shapes[i] = cells
    shapes[8] = {(y, 10) for y in range(40)} | {(40, 11), (40, 12)} | {(y, 13) for y in range(20, 40)} | {(30, 11), (31, 12)}
    df = spark.createDataFrame([(i, y, x) for i, s in shapes.items() for y, x in s], "image_id long, y int, x int")
    got = {}
    for r in skeleton.order_centre_line(df, window=4).orderBy("image_id", "i").collect():
        got.setdefault(r["image_id"], []).append((r["y"], r["x"]))
    want = {i: walk(s) for i, s in shapes.items() if walk(s)}
    assert len(want) >= 3 and got == want


def test_local_density(spark, image):
    cells = random_mask(9, 0.2)
    frag = spark.createDataFrame([(1, i, [(y, x)]) for i, (y, x) in enumerate([(0, 0), (5, 58), (20, 30), (39, 59), (17, 8)])],
                                 "image_id long, id int, segment array<struct<y:int,x:int>>")
    got = {r["id"]: r["local_density"] for r in fragments.local_density(frag, points(spark, cells), image, reach=9).collect()}
    for i, (y, x) in enumerate([(0, 0), (5, 58), (20, 30), (39, 59), (17, 8)]):
        y0, y1, x0, x1 = max(0, y - 9), min(H, y + 9), max(0, x - 9), min(W, x + 9)
        n = sum(y0 <= a < y1 and x0 <= b < x1 for a, b in cells)
        assert got[i] == pytest.approx(n / ((y1 - y0) * (x1 - x0)))


def fold(i, n, mode):
    while not 0 <= i < n:
        if mode == "nearest":
            return min(max(i, 0), n - 1)
        i = -i - 1 if i < 0 else 2 * n - 1 - i
    return i


@pytest.mark.parametrize("mode,sigma", [("reflect", 3.0), ("nearest", 0.5)])
def test_blur_over_tile_borders(spark, image, mode, sigma):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1000, (H, W))
    k = raster.gaussian_kernel(sigma)
    r = len(k) // 2
    b = np.array([[sum(k[d + r] * a[fold(y + d, H, mode), x] for d in range(-r, r + 1)) for x in range(W)] for y in range(H)])
    c = np.array([[sum(k[d + r] * b[y, fold(x + d, W, mode)] for d in range(-r, r + 1)) for x in range(W)] for y in range(H)])
    px = spark.createDataFrame([(1, y, x, int(a[y, x])) for y in range(H) for x in range(W)], "image_id long, y int, x int, v int")
    out = raster.gaussian_blur(px, image, sigma, mode=mode, tile=16).collect()
    assert len(out) == H * W
    assert max(abs(r["v"] - c[r["y"], r["x"]]) for r in out) < 1e-9


def test_sliding_mean_over_block_borders(spark, image):
    prof = spark.createDataFrame([(1, y, float(y * y % 17)) for y in range(H)], "image_id long, y int, avg_v double")
    got = {r["y"]: r["smooth"] for r in raster.sliding_mean(prof, image, width=10, block=7).collect()}
    want = {y: np.mean([float(v * v % 17) for v in range(y, y + 10)]) for y in range(H - 10)}
    assert got.keys() == want.keys() and all(got[y] == pytest.approx(want[y]) for y in want)
    order = sorted(got)
    peaks = {y for y in order[1:-1] if got[y] > got[y - 1] + 1e-4 and got[y] > got[y + 1] + 1e-4}
    smooth = spark.createDataFrame([(1, y, got[y]) for y in order], "image_id long, y int, smooth double")
    assert rows(raster.local_peaks(smooth, block=5), "y") == {(y,) for y in peaks}


def test_flat_profile_has_no_cell_body(spark, image):
    px = spark.createDataFrame([(1, y, x, 7) for y in range(H) for x in range(W)], "image_id long, y int, x int, v int")
    row = raster.cell_body(px, image, width=10).first()
    assert row["cellbody_px"] is None and row["cellbody_pct"] is None


def test_odd_last_slice_is_dropped(spark):
    vox = spark.createDataFrame([(1, z, 0, 0, z) for z in range(5)], "image_id long, z int, y int, x int, v int")
    assert rows(raster.pairwise_z_max(vox), "z", "v") == {(0, 1), (1, 3)}


def geometry_of(spark, seg):
    df = spark.createDataFrame([(1, 0, seg)], "image_id long, id int, branch array<struct<y:int,x:int>>")
    r = geometry.branch_geometry(df).first()
    return r["orientation"], r["curvature"], r["tortuosity"]


def test_branch_geometry_by_hand(spark):
    assert geometry_of(spark, [(0, x) for x in range(14)]) == (0.0, 0.0, 0.0)
    assert geometry_of(spark, [(x, x) for x in range(13)])[1:] == (0.0, 0.0)
    zig, y, x = [], 0, 0
    for block in range(4):
        for k in range(7):
            zig.append((y, x))
            y, x = y + (1 if block % 2 else -1), x + 1
    o, curvature, waviness = geometry_of(spark, zig)
    assert curvature == pytest.approx(90) and waviness == pytest.approx(90 * 2 / 28)


def test_one_timepoint_has_no_interval(spark):
    df = spark.sql("select 1L as image_id, 1 as n, timestamp'2024-01-01 00:00:00' as ts")
    assert geometry.mean_interval(df).first()["interval"] is None


def test_otsu_separates_two_levels(spark):
    px = spark.createDataFrame([(1, y, x, 10 + x % 3 if y < 20 else 200 + x % 3) for y in range(H) for x in range(W)],
                               "image_id long, y int, x int, v int")
    assert 12 < raster.otsu_threshold(px).first()["threshold"] < 200 or raster.otsu_threshold(px).first()["threshold"] == pytest.approx(12, abs=1)


def test_results_do_not_depend_on_partitions(spark):
    cells = thin(random_mask(11, 0.7))
    one = skeleton.trace_fragments(points(spark, cells).repartition(1)).select("id", F.size("segment").alias("n"))
    many = skeleton.trace_fragments(points(spark, cells).repartition(13)).select("id", F.size("segment").alias("n"))
    assert rows(one, "id", "n") == rows(many, "id", "n")


@pytest.mark.parametrize("scale", [1.0, 1e-3, 2e-6, 1e6])
def test_otsu_does_not_depend_on_scale(spark, scale):
    """The threshold moves with the values, however small they are."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0.3, 0.05, 1500), rng.normal(0.7, 0.08, 500)])
    df = spark.createDataFrame([(1, i // 50, i % 50, float(x) * scale) for i, x in enumerate(v)], "image_id long, y int, x int, v double")
    got = raster.otsu_threshold(df).first().threshold / scale
    bins = np.clip(((v - v.min()) / ((v.max() - v.min()) / 256)).astype(int), 0, 255)
    c = np.bincount(bins, minlength=256)
    n1, s1 = np.cumsum(c), np.cumsum(c * np.arange(256))
    n, s = n1[-1], s1[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((s1 * n - s * n1) ** 2.0 / (n1 * (n - n1.astype(float))), posinf=0)
    want = v.min() + (between[:-1].argmax() + 0.5) * (v.max() - v.min()) / 256
    assert abs(got - want) < 0.005


def test_resampling_beside_missing_pixels_and_planes(spark):
    """A sparse stack over several tiles: missing pixels count nothing, samples without any pixel are left out."""
    rng = random.Random(8)
    cells = {(z, y, x): rng.randrange(100) for z in (0, 3) for y in range(30) for x in range(25) if rng.random() < (0.8 if z else 0.3) and y != 12}
    samples = [(k, rng.uniform(-2, 31), rng.uniform(-2, 26)) for k in range(300)] + [(300, 12.0, 3.0), (301, 0.0, 0.0), (302, 29.0, 24.0)]
    want = {}
    for k, y, x in samples:
        for z in (0, 3):
            if not (0 <= y <= 29 and 0 <= x <= 24):
                want[k, z] = 0.0
                continue
            total, seen = 0.0, False
            by, bx = int(np.floor(y + .5)), int(np.floor(x + .5))
            for dy, dx in itertools.product((-1, 0, 1), repeat=2):
                w = 1.0
                for d, t in ((dy, y - by), (dx, x - bx)):
                    w *= {-1: .5 * (.5 - t) ** 2, 0: .75 - t * t, 1: .5 * (.5 + t) ** 2}[d]
                cy, cx = abs(by + dy), abs(bx + dx)
                cy, cx = (58 - cy if cy > 29 else cy), (48 - cx if cx > 24 else cx)
                if (z, cy, cx) in cells:
                    total, seen = total + w * cells[z, cy, cx], True
            if seen:
                want[k, z] = total
    grid = spark.createDataFrame([(1, *s) for s in samples], "image_id long, k int, y double, x double")
    stack = spark.createDataFrame([(1, *p, v) for p, v in cells.items()], "image_id long, z int, y int, x int, v int")
    image = spark.createDataFrame([(1, 30, 25)], "image_id long, length_px int, width_px int")
    got = geometry.resample_grid(grid, stack, image, keys=("k",), planes=("z",), tile=8).collect()
    assert {(r["k"], r["z"]): r["v"] for r in got} == pytest.approx(want)


def test_a_bent_body_becomes_straight(spark):
    """The middle of the straightened stack is bright along its whole length, its sides are dark; a forked body gives no line."""
    line = [(y, 40 + round(15 * np.sin(y / 25))) for y in range(10, 110)]
    pixels = {(1, z, y, x): 20 for z in (0, 1) for y in range(120) for x in range(80)}
    for y, x in line:
        for z, d in itertools.product((0, 1), range(-5, 6)):
            pixels[1, z, y, x + d] = 1000 - 100 * abs(d)
    fork = [(60 + k, 40 + k) for k in range(40)] + [(60 + k, 40 - k) for k in range(40)] + [(20 + k, 40) for k in range(40)]
    for z, (y, x) in itertools.product((0, 1), [(y, x) for y in range(120) for x in range(80)]):
        pixels[2, z, y, x] = 20
    for z, (y, x), d in itertools.product((0, 1), fork, range(-2, 3)):
        if 0 <= x + d < 80:
            pixels[2, z, y, x + d] = 900
    stack = spark.createDataFrame([(*k, v) for k, v in pixels.items()], "image_id long, z int, y int, x int, v int")
    image = spark.createDataFrame([(1, 120, 80), (2, 120, 80)], "image_id long, length_px int, width_px int")
    path = flows.centre_line(raster.max_projection(stack), image)
    found = {r["image_id"]: r["n"] for r in path.groupBy("image_id").agg(F.count("*").alias("n")).collect()}
    assert set(found) == {1} and 80 <= found[1] <= 130
    out = flows.straighten(path, stack, image, width=21, subsample=8).toPandas()
    assert set(out["z"]) == {0, 1} and set(out["j"]) == set(range(21))
    n = out["i"].max() + 1
    assert found[1] - 8 <= n <= found[1] + 1 and len(out) == 2 * 21 * n
    middle, far = out[out["j"].between(9, 11)]["v"], out[~out["j"].between(2, 18)]["v"]
    assert middle.min() > 600 and far.max() < 500
    turned = geometry.flip_path(path).filter("i = 0").first()
    last = path.orderBy(F.desc("i")).first()
    assert (turned["y"], turned["x"]) == (last["y"], last["x"])
