"""Steps whose rows grow behind a shuffle: cells of lines, strips of image rows, many partitions, no broadcast of exploded sides."""

import random

from pyspark.sql import functions as F

from ramify.functions.boards import first_of, gathered, line_boards, pixels_of
from ramify.functions import scalars
from ramify.functions.patterns import salted_join, two_level_rank
from ramify.operators import correct, fragments, geometry, merge, morphology, neighbors, skeleton


def lines(spark, rows):
    return spark.createDataFrame(rows, "image_id long, id int, line array<struct<y:int,x:int>>")


def test_lines_come_back_from_cells(spark):
    rnd = random.Random(3)
    rows = [(i % 2, i, [(rnd.randrange(-20, 40), rnd.randrange(-20, 40)) for _ in range(rnd.randrange(0, 150))]) for i in range(30)]
    rows += [(0, 30, [(7, 7), (None, 1), (15, 15)]), (0, 31, None), (1, 32, [])]
    want = {(im, *p) for im, _, line in rows for p in line or () if None not in p}
    got = pixels_of(gathered(line_boards(lines(spark, rows), "line", ["image_id"])), "image_id").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_a_pixel_stays_in_the_first_board(spark):
    df = spark.createDataFrame([([(1, 0b0110), (2, 0b1100), (2, 0b0001), (4, -1)],)], "b array<struct<label:int,bits:bigint>>")
    got = [tuple(b) for b in df.select(first_of(F.col("b")).alias("b")).first()["b"]]
    assert got == [(1, 0b0110), (2, 0b1000), (2, 0b0001), (4, ~0b1111)]


def test_ranked_rows_stay_apart(spark):
    df = spark.range(1000).select((F.col("id") % 40).alias("k"), "id")
    ranked = two_level_rank(df, ["k"], F.floor(F.col("id") / 100), ["id"], "n")
    assert ranked.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r["k"], r["n"], r["id"]) for r in ranked.collect()} == {(i % 40, i // 40, i) for i in range(1000)}


def test_salted_side_is_not_broadcast(spark):
    big, small = spark.range(100).withColumn("v", F.col("id")), spark.range(10)
    plan = salted_join(big, small, ["id"], F.col("v"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert salted_join(big, small, ["id"], F.col("v")).count() == 10


def test_touching_and_cover_against_loops(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(120):
        lo = rnd.randrange(0, 150)
        hi = lo + rnd.randrange(0, 140)
        rows.append((i % 2, i, rnd.choice([1, 3]), lo, rnd.randrange(0, 60), hi, rnd.randrange(0, 60), lo, hi))
    span = spark.createDataFrame(rows, "image_id long, id int, dendrite_type int, y_s int, x_s int, y_e int, x_e int, lo int, hi int")
    ends = lambda r: [(r[3], r[4]), (r[5], r[6])]
    near = lambda a, b: any(abs(p[0] - q[0]) <= 2 and abs(p[1] - q[1]) <= 2 for p in ends(a) for q in ends(b))
    want = {r[:2] for r in rows if r[2] == 3 and any(s[2] == 1 and s[0] == r[0] and near(r, s) for s in rows)}
    assert {tuple(r) for r in correct.touching(span).collect()} == want
    covers = lambda s, r: s[0] == r[0] and s[1] != r[1] and s[2] == 3 and any(s[7] <= y <= s[8] for y in (r[3], r[5]))
    want = {(*r[:2], any(covers(s, r) for s in rows)) for r in rows if r[2] == 3}
    assert {tuple(r) for r in correct.y_overlap_exists(span).collect()} == want


def test_points_and_pixels_lose_none_in_boards(spark):
    """A point or pixel that comes twice counts twice, nulls match nothing, and values stay with their pixels."""
    rnd = random.Random(9)
    rows = [(i % 2, i, [(rnd.randrange(0, 20), rnd.randrange(0, 20)) for _ in range(rnd.randrange(1, 40))]) for i in range(20)]
    rows += [(0, 20, [(3, 3), (3, 4), (3, 3), (None, 2)]), (0, 21, [(90, 90)]), (1, 22, None), (1, 23, [(None, None)])]
    pixel = [(rnd.randrange(2), rnd.randrange(0, 20), rnd.randrange(0, 20), rnd.choice([None, 1, 5, 9])) for _ in range(300)] + [(0, 3, 3, 7)] * 2
    layer = [(im, rnd.choice("vh"), y, x) for im, y, x, _ in pixel]
    df = lines(spark, rows)
    under = {}
    for im, i, line in rows:
        met = [v for p in line or () for jm, y, x, v in pixel if (jm, y, x) == (im, *p)]
        if met:
            known = [v for v in met if v is not None]
            under[im, i] = sum(known) / len(known) if known else None
    got = fragments.sample_intensity(df, spark.createDataFrame(pixel, "image_id long, y int, x int, v int"), line="line")
    assert {(r[0], r[1]): r[2] for r in got.collect()} == under
    share = {}
    for im, i, line in rows:
        on = [n for p in line or () for jm, n, y, x in layer if (jm, y, x) == (im, *p)]
        if line:
            share[im, i] = on.count("h") / len(on) if on else 0.0
    got = fragments.layer_hits(df, spark.createDataFrame(layer, "image_id long, layer string, y int, x int"), line="line")
    assert {(r["image_id"], r["id"]): r["h_share"] for r in got.collect()} == share


def test_density_of_boxes_over_several_tiles(spark):
    rnd = random.Random(11)
    on = {(rnd.randrange(0, 90), rnd.randrange(0, 70)) for _ in range(900)}
    rows = [(1, i, [(rnd.randrange(0, 90), rnd.randrange(0, 70))]) for i in range(40)] + [(1, 40, [(None, 5)]), (1, 41, None)]
    image = spark.createDataFrame([(1, 90, 70)], "image_id long, length_px int, width_px int")
    skeleton = spark.createDataFrame([(1, y, x) for y, x in on], "image_id long, y int, x int")
    want = {}
    for _, i, line in rows:
        y, x = line[0] if line else (None, None)
        (y0, y1), (x0, x1) = ((0, n) if c is None else (max(0, c - 20), min(n, c + 20)) for c, n in ((y, 90), (x, 70)))
        want[i] = sum(y0 <= a < y1 and x0 <= b < x1 for a, b in on) / ((y1 - y0) * (x1 - x0))
    got = fragments.local_density(lines(spark, rows), skeleton, image, reach=20, line="line", tile=24)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["local_density"] for r in got.collect()} == want


def test_openings_travel_as_boards(spark):
    """No shuffle carries pixels: the exchanges hold boards, and runs over tile and image borders come out whole."""
    image = spark.createDataFrame([(1, 60, 50)], "image_id long, length_px int, width_px int")
    runs = {(3, 0, 7), (5, 0, 6), (9, 20, 34), (11, 20, 33), (13, 42, 49), (15, 0, 49)}
    mask = spark.createDataFrame([(1, y, x) for y, lo, hi in runs for x in range(lo, hi + 1)], "image_id long, y int, x int")
    kept = {(y, x) for y, lo, hi in runs if (y, lo) in {(3, 0), (9, 20), (13, 42), (15, 0)} for x in range(lo, hi + 1)}
    got = morphology.morph_open_line(mask, image)
    assert {(r["y"], r["x"]) for r in got.collect()} == kept
    assert "bits" in [l for l in got._jdf.queryExecution().executedPlan().toString().splitlines() if "MapInArrow" in l][0]
    both = morphology.layer_intersect(mask.withColumn("tag", F.lit("a")), got)
    assert {tuple(r) for r in both.collect()} == {(1, y, x, "a") for y, x in kept}
    rest = morphology.layer_subtract(mask, got)
    assert {(r["y"], r["x"]) for r in rest.collect()} == {(y, x) for y, lo, hi in runs for x in range(lo, hi + 1)} - kept


def test_points_of_branches_are_combined_without_sorting(spark):
    """Ties in i go by y and x, nulls come first, and no aggregate has its points sorted."""
    rnd = random.Random(4)
    odd = lambda: rnd.choice([None, -(1 << 31), -1, 0, 1, 7, (1 << 31) - 1])
    rows = [(k % 3, k % 7, odd(), odd(), odd()) for k in range(400)] + [(9, 9, None, None, None), (8, 8, 5, 2, 3)]
    got = geometry.branch_summary(spark.createDataFrame(rows, "image_id long, id int, i int, y int, x int"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    order = lambda p: [(v is not None, v or 0) for v in p]
    mean = lambda vs: sum(vs) / len(vs) if vs else None
    want = {}
    for key in {r[:2] for r in rows}:
        mine = sorted((r[2:] for r in rows if r[:2] == key), key=order)
        ys, xs = ([p[k] for p in mine if p[k] is not None] for k in (1, 2))
        want[key] = (len(mine), mean(xs), mean(ys), *mine[0][1:], *mine[-1][1:])
    assert {tuple(r[:2]): tuple(r[2:]) for r in got.collect()} == want


def test_paths_travel_as_runs(spark):
    """A run of pixels is one row a direction and tile, however long, and paths and loops over tile borders come out whole."""
    line = {(5, x) for x in range(2100)} | {(40, 3), (41, 3), (42, 3), (43, 4), (44, 5), (45, 5), (46, 4), (47, 3)}
    wide = {(y, x) for y, x in ((y, x) for y in range(60, 71) for x in range(1000, 1051)) if y in (60, 70) or x in (1000, 1050)}
    wide -= {(60, 1000), (60, 1050), (70, 1000), (70, 1050)}  # a loop over the border at 1,024, its corners cut
    small = {(90, 2), (90, 3), (91, 1), (92, 1), (91, 4), (92, 4), (93, 2), (93, 3)}
    cells = spark.createDataFrame([(1, y, x) for y, x in line | wide | small] + [(1, None, 3)], "image_id long, y int, x int")
    steps = skeleton._steps(cells)
    assert steps.filter("not ring").count() < 20
    paths, members, loops = skeleton.trace_paths(cells)
    assert sorted(r["hops"] for r in paths.collect()) == [6, 2098]
    assert {(r["b"] >> 32, r["b"] & 0xffffffff) for r in loops.collect()} == wide | small
    got = {tuple((p["y"], p["x"]) for p in r["segment"]) for r in skeleton.trace_fragments(cells).collect()}
    assert got == {tuple((5, x) for x in range(2100)), ((40, 3), (41, 3), (42, 3), (43, 4), (44, 5), (45, 5), (46, 4), (47, 3))}
    left = [(r["y"], r["x"]) for r in skeleton.prune_spurs(cells).collect()]
    ends = {(40, 3), (47, 3), min(small)}
    assert sorted(left, key=str) == sorted([*{(5, x) for x in range(2100)}, *wide, *ends, (None, 3)], key=str)


def test_neighbours_do_not_sort_lines(spark):
    """The cells of all lines meet the ends by hash: neither side is sorted or broadcast."""
    branch = lines(spark, [(1, 0, [(0, x) for x in range(30)]), (1, 1, [(y, 31) for y in range(2, 20)]), (1, 2, [(50, 50)]), (2, 0, [(1, 31)])])
    got = neighbors.branch_neighbors(branch, line="line")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert {tuple(r) for r in got.collect()} == {(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (1, 2, 2), (2, 0, 0)}


def test_lines_are_flat_between_shuffles(spark):
    """Numbers of points come back with their nulls and signs, and fragments without a candidate stay as they are."""
    rows = [(1, 0, [(3, -4), (None, 2), (5, None)]), (1, 1, []), (1, 2, None)]
    flat = scalars.flat_line(lines(spark, rows), "line")
    assert "struct" not in flat.schema.simpleString().removeprefix("struct")
    assert [(r["id"], r["line"]) for r in scalars.whole_line(flat, "line").orderBy("id").collect()] == [r[1:] for r in rows]
    line = [(-5 - k, 7) for k in range(12)]
    frag = spark.createDataFrame([(1, 0, 2, line), (1, 1, 2, [(40, 9)]), (1, 2, 2, [(None, x) for x in range(15)])],
                                 "image_id long, id int, dendrite_type int, segment array<struct<y:int,x:int>>")
    got = {r["start"]: [tuple(p) for p in r["branch"]] for r in merge.merge_fragments(frag).collect()}
    assert got == {0: line, 2: [(None, x) for x in range(15)]}


def test_midpoints_meet_boards_of_labels(spark):
    """Pixels that come twice, two labels of a pixel, null labels, nulls and negative places; pixels are no rows of a shuffle."""
    rnd = random.Random(13)
    place = lambda: rnd.randrange(-12, 20)
    rows = [(i % 2, i, [(place(), place()) for _ in range(rnd.randrange(1, 6))]) for i in range(60)]
    rows += [(0, 60, []), (0, 61, None), (1, 62, [(None, 3)]), (7, 63, [(1, 1)])]
    pixel = [(rnd.randrange(2), place(), place(), rnd.choice([None, 0, 1, 2])) for _ in range(900)] + [(0, 3, 3, 1)] * 2
    pixel += [(0, None, 3, 1), (None, 3, 3, 1)]
    want = []
    for im, i, line in rows:
        mid = line[len(line) // 2] if line else None
        met = [v or 0 for jm, y, x, v in pixel if mid and None not in mid and (jm, y, x) == (im, *mid)]
        want += [(im, i, v) for v in met or [0]]
    got = fragments.label_midpoint(lines(spark, rows), spark.createDataFrame(pixel, "image_id long, y int, x int, label int"), line="line")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning" in row and " y#" in row for row in plan.splitlines())
