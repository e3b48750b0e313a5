"""ANSI SQL for the registered queries, over the same tables, for the DuckDB comparison."""

import re

from ramify.operators.compare import TRAITS
from ramify.operators.profile import FEATURE_COLUMNS

# Named building blocks; each may refer to others.
CTE = {
    "branch": """
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY dendrite_type, l_orderkey,
         l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS id,
       dendrite_type, length, orientation, curvature, tortuosity, intensity, y0, x0, dy, dx, l_partkey
FROM (SELECT l_suppkey AS image_id, CAST(1 + (l_linenumber - 1) % 4 AS INTEGER) AS dendrite_type,
        CAST(l_quantity AS INTEGER) + 9 AS length,
        (CAST(round(l_extendedprice * 100) AS BIGINT) % 18000) / 100.0::DOUBLE AS orientation,
        l_discount * 100 AS curvature, l_tax AS tortuosity, l_extendedprice / l_quantity AS intensity,
        CAST((l_orderkey * 7) % 1900 AS INTEGER) AS y0, CAST(60 + l_partkey % 180 AS INTEGER) AS x0,
        CASE WHEN l_partkey % 4 = 1 THEN 0 ELSE 1 END AS dy,
        CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 3 THEN -1 ELSE 1 END AS dx,
        l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate FROM lineitem)""",
    "pt": """
SELECT image_id, id, dendrite_type, CAST(i AS INTEGER) AS i, CAST(y0 + i * dy AS INTEGER) AS y,
       CAST(x0 + i * dx AS INTEGER) AS x, length
FROM (SELECT *, unnest(range(length)) AS i FROM branch)""",
    "pos": """
SELECT *, y0 + dy * (length - 1) / 2.0::DOUBLE AS mean_y, x0 + dx * (length - 1) / 2.0::DOUBLE AS mean_x,
       y0 + (length - 1) * dy AS y1, x0 + (length - 1) * dx AS x1,
       (y0 + (length // 2) * dy) AS my, (x0 + (length // 2) * dx) AS mx FROM branch""",
    "image": """
SELECT image_id, 'img' || image_id AS image,
       CASE WHEN image_id % 2 = 0 THEN 'wt' ELSE 'mut' END || '-day' || (3 * (1 + image_id % 3)) AS genotype,
       2000 AS length_px, 320 AS width_px, CAST(800 + image_id % 400 AS INTEGER) AS cellbody_px,
       round_even(2000 * 0.1048::DOUBLE, 0) AS length_um,
       round_even((800 + image_id % 400) * 0.1048::DOUBLE, 0) AS ant_um
FROM (SELECT DISTINCT l_suppkey AS image_id FROM lineitem)""",
    "ap": """
SELECT image_id, id, dendrite_type, genotype, mean_y * 100 / length_px AS raw_pct,
       mean_y * 100 / length_px - 100.0::DOUBLE * cellbody_px / length_px AS ap_pct
FROM pos JOIN image USING (image_id)""",
    "oriented": """
SELECT *, CASE WHEN dendrite_type IN (2, 4) AND orientation > 90 THEN orientation - 180 ELSE orientation END AS o
FROM branch""",
    "profile": """
SELECT image_id, dendrite_type, count(*) AS ct, round_even(sum(length) * 0.1048::DOUBLE, 0) AS length_um,
       avg(tortuosity) AS wavy, avg(curvature) AS curve, avg(intensity) AS intensity, avg(o) AS angle,
       stddev_pop(o) AS angle_sd
FROM oriented GROUP BY ALL""",
    "ends": """
SELECT image_id, id, dendrite_type, 's' AS kind, y0 AS y, x0 AS x FROM pos
UNION ALL SELECT image_id, id, dendrite_type, 'e', y1, x1 FROM pos""",
    "links": """
SELECT DISTINCT p.image_id, p.id AS a, e.b FROM pt p
JOIN (SELECT image_id, y + dy AS y, x + dx AS x, b
      FROM (SELECT image_id, kind, y, x, min(id) AS b FROM ends GROUP BY ALL),
           (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)) e
  USING (image_id, y, x)""",
    "looked": """
SELECT l.image_id, l.a, l.b, p.dendrite_type AS type_a, q.dendrite_type AS type_b,
       p.orientation AS orientation_a, q.orientation AS orientation_b,
       least(abs(p.orientation - q.orientation), 360 - abs(p.orientation - q.orientation)) AS d
FROM links l JOIN branch p ON p.image_id = l.image_id AND p.id = l.a
JOIN branch q ON q.image_id = l.image_id AND q.id = l.b WHERE l.a < l.b""",
    "pixel": """
SELECT vec_id // 250 AS image_id, CAST(vec_id % 250 AS INTEGER) AS y, CAST(x AS INTEGER) AS x,
       CAST(floor((e::DOUBLE + 1) * 1000) AS INTEGER) AS v
FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS x FROM embeddings)""",
    "pimage": """
SELECT image_id, max(y) + 1 AS length_px, max(x) + 1 AS width_px FROM pixel GROUP BY ALL""",
    "voxel": """
SELECT vec_id // 100 AS image_id, 0 AS resolution, 0 AS time_point, label AS channel,
       CAST((vec_id % 100) % 4 AS INTEGER) AS z, CAST((vec_id % 100) // 4 AS INTEGER) AS y, CAST(x AS INTEGER) AS x,
       CAST(floor((e::DOUBLE + 1) * 1000) AS INTEGER) AS v,
       greatest(0.0::DOUBLE, least(1.0::DOUBLE, e::DOUBLE)) AS p
FROM (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(64)) AS x FROM embeddings)""",
    "vsize": """
SELECT image_id, max(z) + 1 AS depth_px, max(y) + 1 AS length_px, max(x) + 1 AS width_px FROM voxel GROUP BY ALL""",
    "centre": """
SELECT user_id AS image_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i,
       2.0::DOUBLE * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS y, value AS x, ts
FROM events""",
}



def r(expr, name, digits=6):
    """Rounded like the Spark side: a fixed offset keeps exact ties out of the rounding."""
    return f"round(({expr}) + 1.2345e-7::DOUBLE, {digits}) + 0.0 AS {name}"


CLASSES = {1: "prim", 2: "sec", 3: "tert", 4: "quat"}
PAIRS = [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
SQL = {}

# ---- profile ----
_PROFILE = ["wavy", "curve", "intensity", "angle", "angle_sd"]
SQL["A1_class_profile"] = (
    "SELECT image_id, dendrite_type, ct, length_um, " + ", ".join(r(c, c) for c in _PROFILE) + " FROM profile")
SQL["A2_length_normalized"] = f"""
SELECT image_id, dendrite_type, {r("p.length_um / nullif(i.length_um, 0)", "length_per_um")},
       {r("CASE WHEN dendrite_type = 1 THEN ct / nullif(i.length_um, 0) ELSE ct END", "ct")}
FROM profile p JOIN image i USING (image_id)"""
SQL["A3_ap_position"] = f"SELECT image_id, id, dendrite_type, {r('ap_pct', 'ap_pct')} FROM ap"

CTE["ap_centred"] = """
SELECT *, ap_pct - avg(ap_pct) OVER (PARTITION BY image_id, dendrite_type) AS c FROM ap"""
_CSKEW = "avg(c ** 3) / nullif(avg(c ** 2) ** 1.5, 0)"
CTE["median_skew"] = f"""
SELECT image_id, dendrite_type, median(ap_pct) AS ap_median, {_CSKEW} AS ap_skew
FROM ap_centred WHERE dendrite_type IN (2, 4) GROUP BY ALL"""
SQL["A4_ap_median_skew"] = f"""
SELECT image_id, dendrite_type, {r("ap_median", "ap_median")}, {r("ap_skew", "ap_skew")} FROM median_skew"""
CTE["ap_split"] = """
SELECT image_id, dendrite_type, count(*) FILTER (ap_pct > 0) / nullif(max(length_um - ant_um), 0) AS post,
       count(*) FILTER (ap_pct <= 0) / nullif(max(ant_um), 0) AS ant
FROM ap JOIN image USING (image_id) WHERE dendrite_type > 1 GROUP BY ALL"""
SQL["A5_ap_counts"] = f"SELECT image_id, dendrite_type, {r('post', 'post')}, {r('ant', 'ant')} FROM ap_split"
_pair = lambda a, b: f"count(*) FILTER (least(type_a, type_b) = {a} AND greatest(type_a, type_b) = {b})"
CTE["contacts"] = f"""
SELECT image_id, {", ".join(f"100.0::DOUBLE * {_pair(a, b)} / nullif(count(*) FILTER (type_a <> type_b), 0) AS contacts_{a}{b}" for a, b in PAIRS)}
FROM looked GROUP BY ALL"""
SQL["A6_contact_matrix"] = (
    "SELECT image_id, " + ", ".join(r(f"contacts_{a}{b}", f"contacts_{a}{b}") for a, b in PAIRS) + " FROM contacts")
CTE["iba"] = """
SELECT image_id, avg(d) AS iba_mean, stddev_pop(d) AS iba_sd, avg(c ** 3) / nullif(avg(c ** 2) ** 1.5, 0) AS iba_skew
FROM (SELECT *, d - avg(d) OVER (PARTITION BY image_id) AS c FROM looked) GROUP BY ALL"""
SQL["A7_interbranch_angle"] = (
    "SELECT image_id, " + ", ".join(r(c, c) for c in ("iba_mean", "iba_sd", "iba_skew")) + " FROM iba")
CTE["totals"] = ("SELECT image_id, count(*) AS n, " + ", ".join(
    f"count(*) FILTER (dendrite_type = {c}) AS {n}_n, "
    f"round_even(coalesce(sum(length) FILTER (dendrite_type = {c}), 0) * 0.1048::DOUBLE, 0) AS {n}_um"
    for c, n in CLASSES.items()) + " FROM branch GROUP BY ALL")
_RATIOS = [(f"len_ratio_{a}{b}", f"{CLASSES[a]}_um / nullif({CLASSES[b]}_um, 0)") for a, b in PAIRS]
_RATIOS += [(f"ct_ratio_{a}{b}", f"{CLASSES[a]}_n / nullif({CLASSES[b]}_n, 0)") for a, b in ((2, 3), (4, 2), (4, 3))]
SQL["A8_ratios"] = "SELECT image_id, " + ", ".join(r(e, n) for n, e in _RATIOS) + " FROM totals"
_BINS = [f"count(*) FILTER (orientation >= {10 * k} AND orientation {'<=' if k == 17 else '<'} {10 * (k + 1)}) / count(*)"
         for k in range(18)]
CTE["bins"] = ("SELECT image_id, " + ", ".join(f"{e} AS angle_dist_bin{k + 1}" for k, e in enumerate(_BINS))
               + " FROM branch GROUP BY ALL")
SQL["A9_orientation_hist"] = (
    "SELECT image_id, " + ", ".join(r(f"angle_dist_bin{k}", f"angle_dist_bin{k}") for k in range(1, 19)) + " FROM bins")


def _features():
    cols = [("length", "i.length_um"), ("cellbody", "100.0::DOUBLE * cellbody_px / length_px")]
    joins = ["image i", "JOIN totals t USING (image_id)", "JOIN bins USING (image_id)",
             "LEFT JOIN contacts USING (image_id)", "LEFT JOIN iba USING (image_id)"]
    for c, n in CLASSES.items():
        joins.append(f"LEFT JOIN (SELECT * FROM profile WHERE dendrite_type = {c}) p{c} USING (image_id)")
        cols += [(f"{n}_ct", f"t.{n}_n" + (" / i.length_um" if c == 1 else "")),
                 (f"{n}_length", f"t.{n}_um / i.length_um")]
        cols += [(f"{n}_{m}", f"p{c}.{m}") for m in _PROFILE]
        if c in (2, 4):
            joins.append(f"LEFT JOIN (SELECT * FROM median_skew WHERE dendrite_type = {c}) m{c} USING (image_id)")
            cols += [(f"{n}_median", f"m{c}.ap_median"), (f"{n}_skew", f"m{c}.ap_skew")]
        if c > 1:
            joins.append(f"LEFT JOIN (SELECT * FROM ap_split WHERE dendrite_type = {c}) s{c} USING (image_id)")
            cols += [(f"post_{n}", f"s{c}.post"), (f"ant_{n}", f"s{c}.ant")]
    cols += [(f"contacts_{a}{b}", f"contacts_{a}{b}") for a, b in PAIRS]
    cols += [(c, c) for c in ("iba_mean", "iba_sd", "iba_skew")]
    cols += [(f"angle_dist_bin{k}", f"angle_dist_bin{k}") for k in range(1, 19)] + _RATIOS
    return cols, "\n".join(joins)


_FEATURES, _FROM = _features()
SQL["A10_feature_table"] = "SELECT image, genotype, " + ", ".join(r(e, n) for n, e in _FEATURES) + " FROM " + _FROM
CTE["features"] = ("SELECT image, genotype, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _FEATURES)
                   + " FROM " + _FROM)

# ---- neighbours ----
SQL["J1_companion_join"] = """
SELECT image_id, id, dendrite_type, length, image, genotype, length_px, width_px, cellbody_px
FROM branch JOIN image USING (image_id)"""
SQL["J10_branch_neighbors"] = "SELECT image_id, a, b FROM links"
SQL["J11_unique_pairs"] = "SELECT image_id, a, b FROM links WHERE a < b"
SQL["J12_pair_lookup"] = f"""
SELECT image_id, a, b, type_a, {r("orientation_a", "orientation_a")}, type_b, {r("orientation_b", "orientation_b")}
FROM looked"""

# ---- predicates and projections over branches ----
SQL["P3_class_filter"] = "SELECT image_id, id, length FROM branch WHERE dendrite_type = 3"
SQL["P4_project_reorder"] = f"""
SELECT id, image_id, dendrite_type, length, {r("orientation", "orientation")}, {r("mean_x", "mean_x")},
       {r("mean_y", "mean_y")} FROM pos"""
SQL["P7_um_convert"] = "SELECT image_id, id, round_even(length * 0.1048::DOUBLE, 0) AS length_um FROM branch"
SQL["P8_wrap_axial"] = f"SELECT image_id, id, dendrite_type, {r('o', 'angle')} FROM oriented"

# ---- comparison ----
_ENGINE = {saved: name for name, saved in FEATURE_COLUMNS}
_TRAITS = [(c, _ENGINE[f], t, lab) for c, f, t, lab in TRAITS if f in _ENGINE]
CTE["traits"] = "\nUNION ALL ".join(
    f"SELECT image, genotype, '{c}' AS code, '{t}' AS title, '{lab}' AS label, {f} AS value FROM features"
    for c, f, t, lab in _TRAITS)
SQL["P11_trait_select"] = f"SELECT image, genotype, code, title, label, {r('value', 'value')} FROM traits"
SQL["A18_group_ci"] = f"""
SELECT genotype, code, {r("avg(value)", "mean")},
       {r("1.96::DOUBLE * stddev_pop(value) / sqrt(count(value))", "err")}, count(value) AS n
FROM traits GROUP BY genotype, code"""
SQL["T1_strain_order"] = """
SELECT DISTINCT genotype, CAST(regexp_extract(genotype, 'day([0-9]+)', 1) AS INTEGER) AS age,
       CASE WHEN split_part(genotype, '-', 1) = 'wt' THEN 0 ELSE 1 END AS priority
FROM image ORDER BY age, priority"""
SQL["A25_image_groups"] = "SELECT DISTINCT genotype FROM image"
SQL["A19_ap_histogram"] = f"""
SELECT g.genotype, g.dendrite_type, b.lo, {r("coalesce(c, 0) / (inside * 5)", "density")}, n
FROM (SELECT genotype, dendrite_type, count(*) AS n, count(*) FILTER (raw_pct BETWEEN 0 AND 100) AS inside
      FROM ap GROUP BY ALL) g
CROSS JOIN (SELECT unnest(range(0, 100, 5)) AS lo) b
LEFT JOIN (SELECT genotype, dendrite_type, CAST(least(floor(raw_pct / 5), 19) * 5 AS BIGINT) AS lo, count(*) AS c
           FROM ap WHERE raw_pct BETWEEN 0 AND 100 GROUP BY ALL) h
  ON h.genotype = g.genotype AND h.dendrite_type = g.dendrite_type AND h.lo = b.lo"""
SQL["A20_ap_kde"] = f"""
SELECT genotype, dendrite_type, CAST(grid AS INTEGER) AS grid,
       {r("sum(exp(-(((grid - raw_pct) / h) ** 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi()))", "density")}
FROM ap JOIN (SELECT genotype, dendrite_type, count(*) AS n, stddev_samp(raw_pct) * count(*) ** (-0.2::DOUBLE) AS h
              FROM ap GROUP BY ALL) USING (genotype, dendrite_type),
     (SELECT unnest(range(101)) AS grid)
GROUP BY ALL"""

# ---- raster ----
SQL["P1_stride_downsample"] = """
SELECT image_id, y // 8 AS y, x // 8 AS x, v FROM pixel WHERE y % 8 = 0 AND x % 8 = 0"""
SQL["P2_column_band"] = """
SELECT image_id, y, x, v FROM pixel JOIN pimage USING (image_id)
WHERE x >= round_even(width_px * 0.375::DOUBLE, 0) AND x < round_even(width_px * 0.655::DOUBLE, 0)"""
SQL["P5_threshold_mask"] = "SELECT image_id, z, y, x FROM voxel WHERE p > 0.1::DOUBLE"
CTE["quant"] = """
SELECT image_id, y // 10 AS tile, z, quantile_cont(v, 0.01) AS q0, quantile_cont(v, 0.99) AS q1 FROM voxel GROUP BY ALL"""
SQL["P6_percentile_normalize"] = f"""
SELECT v.image_id, v.z, y, x, v, tile, {r("(v - q0) / nullif(q1 - q0, 0)", "p")}
FROM voxel v JOIN quant q ON q.image_id = v.image_id AND q.z = v.z AND q.tile = v.y // 10"""
SQL["P12_cast_uint"] = "SELECT image_id, y, x, CAST(floor(v * 0.37::DOUBLE) AS INTEGER) AS v FROM pixel"
SQL["A11_max_projection"] = "SELECT image_id, y, x, max(v) AS v FROM voxel GROUP BY ALL"
SQL["A12_pairwise_z_max"] = """
SELECT v.image_id, z // 2 AS z, y, x, max(v) AS v FROM voxel v JOIN vsize s USING (image_id)
WHERE z < 2 * (depth_px // 2) GROUP BY v.image_id, z // 2, y, x"""
SQL["A13_mask_union_z"] = f"SELECT image_id, y, x, {r('max(p)', 'p')} FROM voxel GROUP BY image_id, y, x"
CTE["prof"] = """
SELECT image_id, y, avg(v) AS avg_v FROM pixel JOIN pimage USING (image_id)
WHERE x >= round_even(width_px * 0.375::DOUBLE, 0) AND x < round_even(width_px * 0.655::DOUBLE, 0) GROUP BY ALL"""
SQL["A14_band_profile"] = f"SELECT image_id, y, {r('avg_v', 'avg_v')} FROM prof"
CTE["smoothed"] = """
SELECT image_id, y, smooth FROM (
  SELECT image_id, y, avg(avg_v) OVER (PARTITION BY image_id ORDER BY y ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS smooth
  FROM prof) JOIN pimage USING (image_id) WHERE y < length_px - 100"""
SQL["W1_sliding_mean"] = f"SELECT image_id, y, {r('smooth', 'smooth')} FROM smoothed"
CTE["peaks"] = """
SELECT * FROM (SELECT *, lag(smooth) OVER w AS b, lead(smooth) OVER w AS f FROM smoothed
               WINDOW w AS (PARTITION BY image_id ORDER BY y))
WHERE smooth > b + 0.0001::DOUBLE AND smooth > f + 0.0001::DOUBLE"""
SQL["W2_local_peaks"] = f"SELECT image_id, y, {r('smooth', 'smooth')} FROM peaks"
SQL["W3_cell_body"] = f"""
SELECT i.image_id, min(y) + 50 AS cellbody_px, {r("100.0::DOUBLE * (min(y) + 50) / length_px", "cellbody_pct")}
FROM pimage i LEFT JOIN (SELECT s.image_id, s.y FROM smoothed s
     JOIN (SELECT image_id, max(smooth) AS top FROM peaks GROUP BY ALL) t
       ON t.image_id = s.image_id AND s.smooth >= top - 1e-9::DOUBLE AND s.smooth <= top + 1e-9::DOUBLE) m USING (image_id)
GROUP BY i.image_id, length_px"""
SQL["S8_channel_histogram"] = """
SELECT image_id, resolution, time_point, channel, v // 16 AS bin, count(*) AS n FROM voxel GROUP BY ALL"""
_W = "(hi - lo) / 256.0::DOUBLE"
SQL["A15_otsu_threshold"] = f"""
WITH h AS (SELECT image_id, lo, {_W} AS w, least(floor((v - lo) / ({_W})), 255) AS bin, count(*) AS c
           FROM pixel JOIN (SELECT image_id, min(v) AS lo, max(v) AS hi FROM pixel GROUP BY ALL) USING (image_id)
           GROUP BY ALL),
m AS (SELECT image_id, lo + (bin + 0.5) * w AS centre, bin, c FROM h),
q AS (SELECT image_id, bin, centre, CAST(sum(c) OVER u AS DOUBLE) AS n1, CAST(sum(c * bin) OVER u AS DOUBLE) AS s1,
             CAST(sum(c) OVER a AS DOUBLE) AS n, CAST(sum(c * bin) OVER a AS DOUBLE) AS s
      FROM m WINDOW u AS (PARTITION BY image_id ORDER BY bin), a AS (PARTITION BY image_id)),
b AS (SELECT *, (s1 * n - s * n1) * (s1 * n - s * n1) / (n1 * (n - n1)) AS between_var FROM q WHERE n1 < n)
SELECT image_id, {r("centre", "threshold")}
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY between_var DESC, bin) AS k FROM b) WHERE k = 1"""
SQL["A16_triangle_threshold"] = """
WITH h AS (SELECT image_id, v AS level, count(*) AS c FROM pixel GROUP BY ALL),
s AS (SELECT image_id, min(level) AS lo, max(level) AS hi, max(c) AS top, arg_min(level, (-c, level)) AS peak
      FROM h GROUP BY ALL),
g AS (SELECT s.*, unnest(range(lo, hi + 1)) AS level, peak - lo < hi - peak AS rgt FROM s),
d AS (SELECT g.image_id, g.level, CASE WHEN rgt THEN hi - g.level ELSE g.level - lo END AS step,
             CASE WHEN rgt THEN hi - peak ELSE peak - lo END AS width, top, coalesce(c, 0) AS c
      FROM g LEFT JOIN h ON h.image_id = g.image_id AND h.level = g.level)
SELECT image_id, CAST(level AS INTEGER) AS threshold
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY top * step - width * c DESC, step) AS k
      FROM d WHERE step >= 0 AND step < width) WHERE k = 1"""


def _blur(reach, sigma, fold):
    """Separable blur as two weighted neighbour sums; `fold` brings an index back inside 0..n-1."""
    f = lambda i, n: fold.format(i=i, n=n)
    return f"""
WITH k0 AS (SELECT unnest(range(-{reach}, {reach} + 1)) AS d),
k AS (SELECT d, exp(-0.5::DOUBLE * (d / {sigma}::DOUBLE) ** 2) / (SELECT sum(exp(-0.5::DOUBLE * (d / {sigma}::DOUBLE) ** 2)) FROM k0) AS w FROM k0),
n AS (SELECT image_id, y, x, length_px, width_px FROM pixel JOIN pimage USING (image_id)),
c AS (SELECT n.image_id, n.y, n.x, sum(w * p.v) AS v FROM n, k, pixel p
      WHERE p.image_id = n.image_id AND p.x = n.x AND p.y = {f("(n.y + d)", "length_px")} GROUP BY ALL)
SELECT n.image_id, n.y, n.x, {r("sum(w * c.v)", "v")} FROM n, k, c
WHERE c.image_id = n.image_id AND c.y = n.y AND c.x = {f("(n.x + d)", "width_px")} GROUP BY n.image_id, n.y, n.x"""


_REFLECT = "CASE WHEN ({i} + 2 * {n}) % (2 * {n}) >= {n} THEN 2 * {n} - 1 - ({i} + 2 * {n}) % (2 * {n}) ELSE ({i} + 2 * {n}) % (2 * {n}) END"
SQL["W11_gaussian_blur"] = _blur(40, 10.0, _REFLECT)
SQL["W11_gaussian_blur_small"] = _blur(2, 0.5, "least(greatest({i}, 0), {n} - 1)")
SQL["J15_tile_assign"] = """
WITH s AS (SELECT image_id, channel, z, y, x, v FROM voxel)
SELECT s.image_id, channel, s.z, s.y, s.x, v,
       CAST(z_start AS INTEGER) AS z_start, least(z_start + 3, depth_px) AS z_end,
       CAST(y_start AS INTEGER) AS y_start, least(y_start + 10, length_px) AS y_end,
       CAST(x_start AS INTEGER) AS x_start, least(x_start + 32, width_px) AS x_end
FROM s JOIN vsize USING (image_id), (SELECT unnest(range(0, 4, 2)) AS z_start),
     (SELECT unnest(range(0, 25, 7)) AS y_start), (SELECT unnest(range(0, 64, 24)) AS x_start)
WHERE z BETWEEN z_start AND z_start + 2 AND y BETWEEN y_start AND y_start + 9 AND x BETWEEN x_start AND x_start + 31"""
SQL["U1_tile_union"] = "SELECT image_id, y, x, v FROM pixel"
SQL["F10_pad_to_16"] = """
SELECT image_id, CAST(ceil(length_px / 16) * 16 - length_px AS INTEGER) AS pad_y,
       CAST(ceil(width_px / 16) * 16 - width_px AS INTEGER) AS pad_x FROM pimage"""
SQL["I11_make_small"] = """
SELECT image_id, y // 8 AS y, x // 8 AS x, max(v) AS v FROM voxel WHERE y % 8 = 0 AND x % 8 = 0 GROUP BY ALL"""
SQL["I11_make_squished"] = """
SELECT v.image_id, z // 2 AS z, y // 2 AS y, x // 2 AS x, max(v) AS v FROM voxel v JOIN vsize USING (image_id)
WHERE y % 2 = 0 AND x % 2 = 0 AND z < 2 * (depth_px // 2) GROUP BY v.image_id, z // 2, y // 2, x // 2"""

# ---- paths ----
SQL["A28_path_length"] = """
SELECT image_id, CAST(round_even(coalesce(sum(s), 0), 0) AS BIGINT) AS n_samples
FROM (SELECT image_id, abs(y - lag(y) OVER w) + abs(x - lag(x) OVER w) AS s FROM centre
      WINDOW w AS (PARTITION BY image_id ORDER BY i)) GROUP BY ALL"""
SQL["P13_flip_path"] = f"""
SELECT image_id, CAST(max(i) OVER (PARTITION BY image_id) - i AS INTEGER) AS i, {r("y", "y")}, {r("x", "x")} FROM centre"""
SQL["P14_subsample_path"] = f"SELECT image_id, i, {r('y', 'y')}, {r('x', 'x')} FROM centre WHERE i % 10 = 0"
CTE["frames"] = """
SELECT image_id, i, y, x, vy / sqrt(vy * vy + vx * vx) AS ty, vx / sqrt(vy * vy + vx * vx) AS tx
FROM (SELECT *, coalesce(lead(y) OVER w - y, y - lag(y) OVER w) AS vy, coalesce(lead(x) OVER w - x, x - lag(x) OVER w) AS vx
      FROM centre WINDOW w AS (PARTITION BY image_id ORDER BY i))"""
SQL["W4_path_frames"] = f"""
SELECT image_id, i, {r("y", "y")}, {r("x", "x")}, {r("ty", "ty")}, {r("tx", "tx")}, {r("-tx", "ny")}, {r("ty", "nx")}
FROM frames"""
SQL["W5_sampling_grid"] = f"""
SELECT image_id, i, CAST(j AS INTEGER) AS j, {r("y + (-10.0::DOUBLE + j * 20.0::DOUBLE / 19) * -tx", "y")},
       {r("x + (-10.0::DOUBLE + j * 20.0::DOUBLE / 19) * ty", "x")} FROM frames, (SELECT unnest(range(20)) AS j)"""
CTE["samples"] = """
WITH c AS (SELECT image_id % (SELECT count(*) FROM pimage) AS image_id, image_id AS path, i, y, 16 + x * 0.06::DOUBLE AS x FROM centre),
f AS (SELECT *, coalesce(lead(y) OVER w - y, y - lag(y) OVER w) AS vy, coalesce(lead(x) OVER w - x, x - lag(x) OVER w) AS vx
      FROM c WINDOW w AS (PARTITION BY path ORDER BY i))
SELECT image_id, path, i, CAST(j AS INTEGER) AS j,
       y + (-10.0::DOUBLE + j * 20.0::DOUBLE / 19) * -vx / sqrt(vy * vy + vx * vx) AS y,
       x + (-10.0::DOUBLE + j * 20.0::DOUBLE / 19) * vy / sqrt(vy * vy + vx * vx) AS x
FROM f, (SELECT unnest(range(20)) AS j)"""


def _resample(image, cells, planes=""):
    weight = lambda a: (f"CASE k{a} WHEN -1 THEN 0.5::DOUBLE * (0.5 - t{a}) ** 2 WHEN 0 THEN 0.75 - t{a} ** 2 "
                        f"ELSE 0.5::DOUBLE * (0.5 + t{a}) ** 2 END")
    cell = lambda a, n: (f"CASE WHEN abs(base_{a} + k{a}) > {n} - 1 THEN 2 * {n} - 2 - abs(base_{a} + k{a}) "
                         f"ELSE abs(base_{a} + k{a}) END")
    p = f"p.{planes}, " if planes else ""
    return f"""
WITH s AS (SELECT *, CAST(floor(y + 0.5) AS BIGINT) AS base_y, CAST(floor(x + 0.5) AS BIGINT) AS base_x,
             y - floor(y + 0.5) AS ty, x - floor(x + 0.5) AS tx,
             y BETWEEN 0 AND length_px - 1 AND x BETWEEN 0 AND width_px - 1 AS inside
      FROM samples JOIN {image} USING (image_id)),
w AS (SELECT s.*, {cell("y", "length_px")} AS cy, {cell("x", "width_px")} AS cx, ({weight("y")}) * ({weight("x")}) AS w
      FROM s, (SELECT unnest([-1, 0, 1]) AS ky), (SELECT unnest([-1, 0, 1]) AS kx) WHERE inside)
SELECT p.image_id, {p}path, i, j, sum(w * v) AS v FROM w JOIN {cells} p
  ON p.image_id = w.image_id AND p.y = cy AND p.x = cx GROUP BY ALL
UNION ALL
SELECT p.image_id, {p}path, i, j, 0.0 AS v FROM s JOIN (SELECT DISTINCT image_id{", " + planes if planes else ""} FROM {cells}) p
  ON p.image_id = s.image_id WHERE NOT inside"""


CTE["resampled"] = _resample("pimage", "pixel")
SQL["J16_resample_grid"] = f"SELECT image_id, path, i, j, {r('v', 'v')} FROM resampled"
CTE["straight"] = _resample("pimage", "stack", "z")
CTE["stack"] = "SELECT image_id, y, x, v + 3 * z AS v, z FROM pixel, (SELECT unnest(range(2)) AS z)"
SQL["J17_straighten_stack"] = """
SELECT image_id, CAST(z AS INTEGER) AS z, path, i, j, CAST(floor(greatest(0.0, round(v, 9))) AS INTEGER) AS v FROM straight"""
SQL["A27_mean_interval"] = f"""
SELECT image_id, round(avg(g), 3) + 0.0 AS interval FROM (
  SELECT image_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY image_id ORDER BY i)) / 1e6::DOUBLE AS g FROM centre)
GROUP BY ALL"""

# ---- shape of branches and fragments ----
CTE["wpt"] = """
SELECT image_id, id, CAST(i AS INTEGER) AS i, CAST(y0 + i * dy AS INTEGER) AS y,
       CAST(x0 + i * dx + (i * i) // 40 + ((i // 9) * (l_partkey % 5)) % 4 AS INTEGER) AS x, length
FROM (SELECT *, unnest(range(length)) AS i FROM branch)"""
SQL["A17_branch_summary"] = f"""
SELECT image_id, id, count(*) AS n, {r("avg(x)", "mean_x")}, {r("avg(y)", "mean_y")}, arg_min(y, i) AS y_first,
       arg_min(x, i) AS x_first, arg_max(y, i) AS y_last, arg_max(x, i) AS x_last FROM pt GROUP BY image_id, id"""
SQL["A29_avg_step"] = f"""
SELECT image_id, id, {r("coalesce(avg(d), 1.0)", "step")}
FROM (SELECT image_id, id, sqrt((y - lag(y) OVER w) ** 2 + (x - lag(x) OVER w) ** 2) AS d FROM wpt
      WINDOW w AS (PARTITION BY image_id, id ORDER BY i)) GROUP BY image_id, id"""
SQL["W6_menger_curvature"] = f"""
WITH t AS (SELECT image_id, id, length, lag(y, 10) OVER w - y AS ay, lag(x, 10) OVER w - x AS ax,
             lead(y, 10) OVER w - y AS by_, lead(x, 10) OVER w - x AS bx FROM wpt
           WINDOW w AS (PARTITION BY image_id, id ORDER BY i)),
u AS (SELECT *, (ay / sqrt(ay ** 2 + ax ** 2)) * (by_ / sqrt(by_ ** 2 + bx ** 2))
              + (ax / sqrt(ay ** 2 + ax ** 2)) * (bx / sqrt(by_ ** 2 + bx ** 2)) AS c,
             sqrt((ay - by_) ** 2 + (ax - bx) ** 2) AS chord FROM t)
SELECT image_id, id, {r("CASE WHEN length <= 20 THEN 0 ELSE avg(2 * sin(acos(greatest(-1, least(1, c)))) / chord) END", "curvature")}
FROM u GROUP BY image_id, id, length"""


def _geometry(points):
    """Orientation, curvature and waviness from a table of points."""
    return f"""
WITH b AS (SELECT image_id, id, length, i // 7 AS k, arg_min(y, i) - arg_max(y, i) AS dy, arg_max(x, i) - arg_min(x, i) AS dx
           FROM {points} WHERE i // 7 < length // 7 GROUP BY ALL),
a AS (SELECT *, degrees(atan2(dy, dx)) AS angle FROM b),
d AS (SELECT *, angle - lag(angle) OVER (PARTITION BY image_id, id ORDER BY k) AS t FROM a),
s AS (SELECT *, least(abs(t), 360 - abs(t)) AS turn, (t >= 0) <> lag(t >= 0) OVER (PARTITION BY image_id, id ORDER BY k) AS sw FROM d),
g AS (SELECT image_id, id, length, degrees(atan2(avg(dy), avg(dx))) AS o,
             CASE WHEN length >= 14 THEN avg(turn) ELSE 0 END AS curvature, count(*) FILTER (sw) AS switches
      FROM s GROUP BY image_id, id, length)
SELECT image_id, id, {r("CASE WHEN o < 0 THEN o + 180 ELSE o END", "orientation")}, {r("curvature", "curvature")},
       {r("CASE WHEN length >= 14 THEN curvature * switches / length ELSE 0 END", "tortuosity")} FROM g"""


SQL["W7_branch_geometry"] = _geometry("wpt")
SQL["W8_fragment_features"] = f"""
WITH e AS (SELECT image_id, id, length, arg_min(y, i) AS y0, arg_min(x, i) AS x0, arg_max(y, i) AS y1, arg_max(x, i) AS x1,
             max(y) FILTER (i = length // 2) AS my, max(x) FILTER (i = length // 2) AS mx FROM wpt GROUP BY ALL)
SELECT image_id, id, CAST(length AS INTEGER) AS length, {r("degrees(atan2(y1 - y0, x1 - x0))", "orientation")},
       {r("length / sqrt((y1 - y0) ** 2 + (x1 - x0) ** 2)", "tortuosity")}, {r("mx / 320.0::DOUBLE", "relative_x")},
       {r("my / 2000.0::DOUBLE", "relative_y")}, {r("0.2::DOUBLE * sin(3 * pi() * mx / 320.0::DOUBLE) + 0.5", "quat_filter")} FROM e"""
SQL["W13_assign_ids"] = """
SELECT image_id, 5 - dendrite_type AS dendrite_type, id AS start,
       CAST(row_number() OVER (PARTITION BY image_id ORDER BY 5 - dendrite_type, id) - 1 AS INTEGER) AS id FROM branch"""
SQL["P9_min_size_filter"] = "SELECT image_id, id, length FROM branch WHERE length > 20"
SQL["U4_class_union"] = "SELECT image_id, id, dendrite_type FROM branch"

# ---- scalar functions ----
SQL["F1_angle_deg"] = f"SELECT image_id, id, {r('degrees(atan2(y1 - y0, x1 - x0))', 'angle')} FROM pos"
SQL["F2_wrapped_diff"] = f"""
SELECT image_id, id, {r("least(abs(orientation * 2 - 15), 360 - abs(orientation * 2 - 15))", "diff")} FROM pos"""
SQL["F3_distance"] = f"SELECT image_id, id, {r('sqrt((y1 - y0) ** 2 + (x1 - x0) ** 2)', 'd')} FROM pos"
SQL["F4_near_reversal"] = """
SELECT image_id, id, CASE WHEN v = 0 THEN 0 WHEN (uy * vy + ux * vx) / (sqrt(uy ** 2 + ux ** 2) * sqrt(v)) < -0.8 THEN 1 ELSE 0 END AS reversal
FROM (SELECT *, vy ** 2 + vx ** 2 AS v FROM (SELECT image_id, id, y1 - y0 AS uy, x1 - x0 AS ux,
        y0 + id % 7 - 3 - y1 AS vy, x0 + id % 5 - 2 - x1 AS vx FROM pos))"""
SQL["F5_polyline_access"] = f"""
SELECT image_id, id, {r("mean_y", "mean_y")}, {r("mean_x", "mean_x")}, y0 AS y_first, CAST(x1 AS INTEGER) AS x_last,
       CAST(my AS INTEGER) AS y_mid, CAST(mx AS INTEGER) AS x_mid FROM pos"""
SQL["F6_polyline_edit"] = """
SELECT image_id, id, CAST(length - 1 - i AS INTEGER) AS i, y, x FROM pt
UNION ALL SELECT image_id, id, CAST(length + i - 1 AS INTEGER), y, x FROM pt WHERE i > 0"""
SQL["F7_filters"] = f"""
SELECT image_id, id, {r("0.2::DOUBLE * sin(3 * pi() * ((l_partkey % 320) / 320.0::DOUBLE)) + 0.5", "sine")},
       {r("acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (orientation - 90) / 80.0::DOUBLE)))", "angle")} FROM branch"""
SQL["F8_text_keys"] = """
SELECT image_id, genotype, CAST(regexp_extract(genotype, 'day([0-9]+)', 1) AS INTEGER) AS age FROM image"""
SQL["F9_parse_timestamp"] = "SELECT event_id, epoch_us(ts) AS micros FROM events WHERE event_id % 7 <> 0"

# ---- pixels under fragments ----
CTE["skel"] = "SELECT DISTINCT image_id, y, x FROM pt"
CTE["labels_px"] = """
SELECT image_id, y, x, CASE WHEN (y + x) % 11 = 0 THEN 0 ELSE arg_min(dendrite_type, id) END AS label FROM pt GROUP BY image_id, y, x"""
CTE["labelled"] = """
SELECT p.image_id, p.id, coalesce(label, 0) AS label FROM pos p
LEFT JOIN labels_px l ON l.image_id = p.image_id AND l.y = p.my AND l.x = p.mx"""
SQL["J2_sample_intensity"] = f"""
SELECT image_id, id, {r("avg((y * 31 + x * 17 + image_id) % 4096)", "average_intensity")} FROM pt GROUP BY image_id, id"""
SQL["J3_label_midpoint"] = "SELECT image_id, id, label FROM labelled"
SQL["P10_drop_unlabelled"] = "SELECT image_id, id, label FROM labelled WHERE label <> 0"
SQL["A21_class_distribution"] = "SELECT label, count(*) AS n FROM labelled GROUP BY label ORDER BY label"


def _open(line, axis, size):
    return f"""
SELECT image_id, y, x FROM (
  SELECT *, min({axis}) OVER g AS lo, max({axis}) OVER g AS hi
  FROM (SELECT *, {axis} - row_number() OVER (PARTITION BY image_id, {line} ORDER BY {axis}) AS grp FROM skel)
  WINDOW g AS (PARTITION BY image_id, {line}, grp))
WHERE hi - lo + 1 >= CASE WHEN lo = 0 AND hi = {size} - 1 THEN 1 WHEN lo = 0 OR hi = {size} - 1 THEN 8 ELSE 15 END"""


_CROSS = "(SELECT unnest([0, -1, 1, 0, 0]) AS oy, unnest([0, 0, 0, -1, 1]) AS ox)"
CTE["open_y"] = _open("x", "y", 2000)
CTE["open_x"] = _open("y", "x", 320)
for _a in "yx":
    CTE[f"cross_{_a}"] = f"""
SELECT * FROM skel WHERE (image_id, y, x) IN (SELECT (image_id, y + oy, x + ox) FROM open_{_a}, {_CROSS})"""
CTE["layers"] = """
SELECT image_id, 'v' AS layer, y, x FROM (SELECT * FROM cross_y EXCEPT SELECT * FROM cross_x)
UNION ALL SELECT image_id, 'h', y, x FROM (SELECT * FROM cross_x EXCEPT SELECT * FROM cross_y)"""
SQL["J4_layer_hits"] = f"""
SELECT image_id, id, {r("s", "h_share")}, CASE WHEN s > 0.5 THEN 1 ELSE 0 END AS horizontal_likely
FROM (SELECT p.image_id, p.id, coalesce(count(*) FILTER (layer = 'h') / nullif(count(layer), 0), 0) AS s
      FROM pt p LEFT JOIN layers USING (image_id, y, x) GROUP BY ALL)"""
SQL["J14_local_density"] = f"""
SELECT f.image_id, f.id, {r("count(s.y) / any_value((y_hi - y_lo) * (x_hi - x_lo))", "local_density")}
FROM (SELECT image_id, id, greatest(0, my - 200) AS y_lo, least(2000, my + 200) AS y_hi,
             greatest(0, mx - 200) AS x_lo, least(320, mx + 200) AS x_hi FROM pos) f
JOIN skel s ON s.image_id = f.image_id AND s.y >= y_lo AND s.y < y_hi AND s.x >= x_lo AND s.x < x_hi
GROUP BY f.image_id, f.id"""
CTE["steps"] = """
SELECT image_id, id, list_reduce(list_transform(range(length), lambda k: CASE WHEN k = 0 THEN 0.0::DOUBLE
         ELSE sqrt(CAST(dy * dy + dx * dx AS DOUBLE)) END), lambda a, b: a + b) / (length - 1) AS step FROM branch"""
CTE["cand"] = """
SELECT * FROM (
  SELECT a.image_id, a.dendrite_type, a.id AS a, b.id AS b,
         CASE a.kind WHEN 'e' THEN 'end' ELSE 'start' END || '_to_' || CASE b.kind WHEN 'e' THEN 'end' ELSE 'start' END AS type,
         CASE WHEN a.kind = 'e' AND b.kind = 's' THEN 0 WHEN a.kind = 'e' THEN 1 WHEN b.kind = 's' THEN 2 ELSE 3 END AS ord,
         sqrt(CAST((a.y - b.y) ** 2 + (a.x - b.x) ** 2 AS DOUBLE)) AS distance,
         CASE WHEN a.kind = b.kind THEN 1 ELSE 0 END AS needs_reverse, greatest(sa.step, sb.step) AS step
  FROM (SELECT *, y // 20 + oy AS cy, x // 20 + ox AS cx
        FROM ends, (SELECT unnest([-1, 0, 1]) AS oy), (SELECT unnest([-1, 0, 1]) AS ox)) a
  JOIN (SELECT *, y // 20 AS cy, x // 20 AS cx FROM ends) b
    ON a.image_id = b.image_id AND a.dendrite_type = b.dendrite_type AND a.cy = b.cy AND a.cx = b.cx AND a.id < b.id
  JOIN steps sa ON sa.image_id = a.image_id AND sa.id = a.id JOIN steps sb ON sb.image_id = b.image_id AND sb.id = b.id
  WHERE abs(a.y - b.y) <= 20 AND abs(a.x - b.x) <= 20)
WHERE distance <= 20 AND distance <= 10 * step"""
SQL["J13_connect_candidates"] = f"""
SELECT image_id, dendrite_type, a, b, type, ord, {r("distance", "distance")}, needs_reverse FROM cand"""
SQL["T3_nearest_candidate"] = f"""
SELECT image_id, dendrite_type, a, direction, b, type, {r("distance", "distance")}, needs_reverse
FROM (SELECT *, row_number() OVER (PARTITION BY image_id, dendrite_type, a, direction ORDER BY distance, b, ord) AS k
      FROM (SELECT *, CASE WHEN ord < 2 THEN 'forward' ELSE 'backward' END AS direction FROM cand)) WHERE k = 1"""


def _undone(a, b, c):
    """Whether the step from b to c nearly takes back the one from a to b."""
    norm = lambda p, q: f"sqrt(CAST(({q}.y - {p}.y) ** 2 + ({q}.x - {p}.x) ** 2 AS DOUBLE))"
    along = lambda k: f"(({b}.{k} - {a}.{k}) / nullif({norm(a, b)}, 0)) * (({c}.{k} - {b}.{k}) / nullif({norm(b, c)}, 0))"
    return f"coalesce({along('y')} + {along('x')} < -0.8::DOUBLE, false)"


# The greedy chains, one action a step: 0 load a start, 1 forward, 2 backward, 3 forward from the nearest fragment behind, 4 load that one.
CTE["node"] = """
SELECT p.*, coalesce(f.fl, []) AS fl, coalesce(f.bl, []) AS bl
FROM (SELECT image_id, dendrite_type, id, list({'y': y, 'x': x} ORDER BY i) AS pts FROM pt GROUP BY ALL) p
LEFT JOIN (SELECT image_id, a AS id, list({'b': b, 'o': ord} ORDER BY distance, b, ord) FILTER (ord < 2) AS fl,
                  list({'b': b, 'o': ord} ORDER BY distance, b, ord) FILTER (ord > 1) AS bl FROM cand GROUP BY ALL) f USING (image_id, id)"""
CTE["grown"] = f"""
SELECT image_id, dendrite_type, ids, ids[1] AS start, ids[1] AS here, 0 AS phase, NULL::STRUCT(y INTEGER, x INTEGER)[] AS line,
       []::INTEGER[] AS taken, []::INTEGER[] AS used, NULL::STRUCT(y INTEGER, x INTEGER)[] AS own, NULL::STRUCT(b INTEGER, o INTEGER)[] AS behind,
       NULL::STRUCT(y INTEGER, x INTEGER)[] AS fwd, []::INTEGER[] AS fwd_taken, NULL::STRUCT(y INTEGER, x INTEGER)[] AS bwd,
       []::INTEGER[] AS bwd_taken, NULL::INTEGER AS out_start, NULL::STRUCT(y INTEGER, x INTEGER)[] AS branch
FROM (SELECT image_id, dendrite_type, list(id ORDER BY id) AS ids FROM node GROUP BY ALL)
UNION ALL
SELECT image_id, dendrite_type, ids, CASE WHEN ended THEN next ELSE start END,
       CASE WHEN ended THEN next WHEN go THEN pick.b WHEN phase = 1 THEN start WHEN phase = 2 THEN other ELSE here END,
       CASE WHEN ended THEN 0 WHEN phase = 0 THEN 1 WHEN phase = 4 THEN 3 WHEN go THEN phase WHEN phase = 1 THEN 2 ELSE 4 END,
       CASE WHEN phase IN (0, 4) THEN pts WHEN go THEN laid WHEN phase = 1 THEN own ELSE line END,
       CASE WHEN phase = 0 THEN [here] WHEN phase = 4 THEN list_append(fwd_taken, here) WHEN go THEN list_append(taken, pick.b)
            WHEN phase = 1 THEN [start] ELSE taken END,
       used_after, CASE WHEN phase = 0 THEN pts ELSE own END, CASE WHEN phase = 0 THEN bl ELSE behind END,
       CASE WHEN phase = 1 AND NOT go THEN line ELSE fwd END, CASE WHEN phase = 1 AND NOT go THEN taken ELSE fwd_taken END,
       CASE WHEN phase = 2 AND NOT go THEN line ELSE bwd END, CASE WHEN phase = 2 AND NOT go THEN taken ELSE bwd_taken END,
       CASE WHEN ended THEN start END, CASE WHEN ended THEN best END
FROM (SELECT *, list_filter(ids, lambda k: k > start AND NOT list_contains(used_after, k))[1] AS next
      FROM (SELECT *, CASE WHEN NOT ended THEN used WHEN way = 1 THEN used || fwd_taken
                           WHEN way = 2 THEN used || (CASE WHEN phase = 2 THEN taken ELSE bwd_taken END) ELSE used || taken END AS used_after,
                   CASE way WHEN 1 THEN fwd WHEN 2 THEN (CASE WHEN phase = 2 THEN line ELSE bwd END) ELSE two END AS best
            FROM (SELECT *, CASE WHEN phase = 2 THEN (CASE WHEN len(line) > len(fwd) THEN 2 ELSE 1 END)
                                 WHEN len(two) > greatest(len(fwd), len(bwd)) THEN 3 WHEN len(bwd) > len(fwd) THEN 2 ELSE 1 END AS way,
                         (phase = 2 AND NOT go AND other IS NULL) OR (phase = 3 AND NOT go) AS ended
                  FROM (SELECT *, phase IN (1, 2, 3) AND coalesce(len(laid) > len(line)
                                 AND len(list_filter(range(1, len(laid)), lambda k: laid[k] = laid[k + 1])) = 0
                                 AND NOT (len(line) > 1 AND ({_undone("laid[len(line) - 1]", "laid[len(line)]", "laid[len(line) + 1]")}
                                                             OR {_undone("laid[len(line)]", "laid[len(line) + 1]", "laid[len(line) + 2]")})), false) AS go,
                               line || fwd[len(own) + 1:] AS two,
                               list_filter(behind, lambda c: NOT list_contains(used, c.b) AND NOT list_contains(fwd_taken, c.b))[1].b AS other
                        FROM (SELECT w.*, CASE WHEN w.phase = 2 THEN (CASE WHEN w.pick.o = 2 THEN list_reverse(m.pts) ELSE m.pts END)[:-2] || w.line
                                               ELSE w.line || (CASE WHEN w.pick.o = 1 THEN list_reverse(m.pts) ELSE m.pts END)[2:] END AS laid
                              FROM (SELECT s.*, n.pts, n.bl, CASE WHEN s.phase IN (1, 2, 3) THEN
                                           list_filter(CASE WHEN s.phase = 2 THEN n.bl ELSE n.fl END,
                                                       lambda c: NOT list_contains(s.used, c.b) AND NOT list_contains(s.taken, c.b))[1] END AS pick
                                    FROM grown s JOIN node n ON n.image_id = s.image_id AND n.id = s.here) w
                              LEFT JOIN node m ON m.image_id = w.image_id AND m.id = w.pick.b)))))"""
CTE["chained"] = "SELECT image_id, dendrite_type, out_start AS start, branch FROM grown WHERE len(branch) >= 10"
SQL["I7_merge_fragments"] = """WITH RECURSIVE unused AS (SELECT 1)
SELECT image_id, dendrite_type, start, CAST(i AS INTEGER) AS i, branch[i + 1].y AS y, branch[i + 1].x AS x
FROM (SELECT *, unnest(range(len(branch))) AS i FROM chained)"""
CTE["bpt"] = """
SELECT image_id, id, dendrite_type, CAST(i AS INTEGER) AS i, branch[i + 1].y AS y, branch[i + 1].x AS x, len(branch) AS length
FROM (SELECT *, unnest(range(len(branch))) AS i, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY dendrite_type, start) - 1 AS INTEGER) AS id
      FROM chained)"""
CTE["bgeom"] = _geometry("bpt")
CTE["bends"] = """
SELECT image_id, y, x, min(id) AS b FROM bpt WHERE i IN (0, length - 1) GROUP BY image_id, y, x, i = 0"""
CTE["bpad"] = """
SELECT image_id, CAST(y + oy AS INTEGER) AS y, CAST(x + ox AS INTEGER) AS x, b
FROM bends, (SELECT unnest(range(-2, 3)) AS oy), (SELECT unnest(range(-2, 3)) AS ox)"""
CTE["bnear"] = """
SELECT image_id, id, count(DISTINCT b) AS n_neighbors FROM (
  SELECT image_id, id, unnest(ends) AS b FROM (
    SELECT image_id, unnest(ids) AS id, ends FROM (
      SELECT image_id, list(id) FILTER (id IS NOT NULL) AS ids, list(b) FILTER (b IS NOT NULL) AS ends
      FROM (SELECT image_id, y, x, id, NULL AS b FROM bpt UNION ALL SELECT image_id, y, x, NULL, b FROM bpad) GROUP BY image_id, y, x)))
GROUP BY ALL"""
SQL["I8_reconstruct_branches"] = f"""WITH RECURSIVE unused AS (SELECT 1)
SELECT image_id, id, p.dendrite_type, CAST(p.length AS INTEGER) AS length, orientation, {r("mean_x", "mean_x")}, {r("mean_y", "mean_y")},
       curvature, tortuosity, {r("p.intensity", "intensity")}, CAST(n_neighbors AS INTEGER) AS n_neighbors
FROM (SELECT image_id, id, dendrite_type, any_value(length) AS length, avg(x) AS mean_x, avg(y) AS mean_y,
             avg((y * 31 + x * 17 + image_id) % 4096) AS intensity FROM bpt GROUP BY ALL) p
JOIN bgeom USING (image_id, id) JOIN bnear USING (image_id, id)"""
CTE["pred"] = """
SELECT image_id, id, length, dendrite_type AS true_type,
       CASE WHEN l_partkey % 5 = 0 THEN 1 + dendrite_type % 4 ELSE dendrite_type END AS predicted_type FROM branch"""
SQL["J18_eval_join"] = "SELECT image_id, id, predicted_type, true_type FROM pred"
SQL["A22_confusion_matrix"] = ("SELECT true_type, " + ", ".join(
    f"count(*) FILTER (predicted_type = {c}) AS p{c}" for c in CLASSES) + " FROM pred GROUP BY true_type")
SQL["A24_accuracy"] = f"""
SELECT {r("avg(CASE WHEN true_type = predicted_type THEN 1.0::DOUBLE ELSE 0 END)", "accuracy")},
       {r("sum(length) FILTER (true_type = predicted_type) / sum(length)", "weighted_accuracy")} FROM pred"""
SQL["A23_classification_report"] = f"""
WITH m AS (SELECT c, CAST(count(*) FILTER (true_type = c) AS BIGINT) AS support, count(*) FILTER (predicted_type = c) AS p,
             count(*) FILTER (true_type = c AND predicted_type = c) AS h
           FROM pred, (SELECT unnest([1, 2, 3, 4]) AS c) GROUP BY c),
q AS (SELECT CAST(c AS VARCHAR) AS label, h / p AS "precision", h / support AS recall, 2 * h / (p + support) AS f1, support, h FROM m),
o AS (SELECT label, "precision", recall, f1, support FROM q
UNION ALL SELECT 'accuracy', sum(h) / sum(support), sum(h) / sum(support), sum(h) / sum(support), CAST(sum(support) AS BIGINT) FROM q
UNION ALL SELECT 'macro avg', avg("precision"), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM q
UNION ALL SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM q)
SELECT label, {r('"precision"', '"precision"')}, {r("recall", "recall")}, {r("f1", "f1")}, support FROM o"""

# ---- corrections ----
CTE["frag"] = """
SELECT image_id, id, dendrite_type, mx / 320.0::DOUBLE AS rx, y0 AS ys, x0 AS xs, y1 AS ye, x1 AS xe,
       least(y0, y1) AS lo, greatest(y0, y1) AS hi FROM pos"""
CTE["touch"] = """
SELECT DISTINCT a.image_id, a.id FROM ends a JOIN ends b ON a.image_id = b.image_id
WHERE a.dendrite_type = 3 AND b.dendrite_type = 1 AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2"""
SQL["J6_touching_semi"] = "SELECT image_id, id FROM touch"
_OVER = "f.image_id = g.image_id AND ((f.ys BETWEEN g.lo AND g.hi) OR (f.ye BETWEEN g.lo AND g.hi))"
SQL["J7_y_overlap_exists"] = f"""
SELECT image_id, id, CASE WHEN EXISTS (SELECT 1 FROM frag g WHERE g.dendrite_type = 3 AND g.id <> f.id AND {_OVER})
       THEN 1 ELSE 0 END AS overlaps FROM frag f WHERE dendrite_type = 3"""
SQL["J8_correct_tertiary"] = f"""
SELECT image_id, id, CASE WHEN dendrite_type = 3 AND EXISTS (
         SELECT 1 FROM frag g WHERE g.dendrite_type = 3 AND g.id <> f.id AND {_OVER}
           AND ((f.rx > 0.7 AND g.rx > 0.6 AND f.rx >= g.rx) OR (f.rx < 0.3 AND g.rx < 0.4 AND f.rx <= g.rx)))
       THEN 4 ELSE dendrite_type END AS dendrite_type FROM frag f"""
SQL["J9_correct_primary"] = f"""
WITH hit AS (SELECT f.image_id, f.id FROM frag f JOIN touch t ON t.image_id = f.image_id AND t.id = f.id
             JOIN frag g ON {_OVER}
             WHERE f.dendrite_type = 3 AND f.rx > 0.3 AND f.rx < 0.7 AND g.dendrite_type IN (1, 3)
             GROUP BY ALL HAVING bool_or(g.rx < 0.625) AND bool_or(g.rx >= 0.625))
SELECT f.image_id, f.id, CASE WHEN hit.id IS NULL THEN dendrite_type ELSE 1 END AS dendrite_type,
       CASE WHEN hit.id IS NULL THEN 0 ELSE 1 END AS changed
FROM frag f LEFT JOIN hit ON hit.image_id = f.image_id AND hit.id = f.id"""

_END_PADS = "(SELECT unnest(range(-2, 3)) AS oy), (SELECT unnest(range(-2, 3)) AS ox)"
CTE["able"] = f"""
SELECT f.image_id, f.id FROM frag f JOIN frag g ON {_OVER}
WHERE f.dendrite_type = 3 AND f.rx > 0.3 AND f.rx < 0.7 AND g.dendrite_type IN (1, 3)
GROUP BY ALL HAVING bool_or(g.rx < 0.625) AND bool_or(g.rx >= 0.625)"""
CTE["able_end"] = "SELECT image_id, id, y, x FROM ends SEMI JOIN able USING (image_id, id)"
CTE["able_pad"] = f"SELECT image_id, id AS a, y + oy AS y, x + ox AS x FROM able_end, {_END_PADS}"
CTE["contact"] = "SELECT DISTINCT image_id, a, id AS b FROM able_pad JOIN able_end USING (image_id, y, x) WHERE a <> id"
CTE["spread"] = """
SELECT image_id, id FROM able SEMI JOIN touch USING (image_id, id)
UNION SELECT c.image_id, c.b FROM spread s JOIN contact c ON c.image_id = s.image_id AND c.a = s.id"""
SQL["I1_primary_fixpoint"] = """WITH RECURSIVE unused AS (SELECT 1)
SELECT f.image_id, f.id, CASE WHEN s.id IS NULL THEN dendrite_type ELSE 1 END AS dendrite_type
FROM frag f LEFT JOIN spread s ON s.image_id = f.image_id AND s.id = f.id"""

# ---- binary images ----
SQL["W9_morph_open_line"] = "SELECT *, 'y' AS axis FROM open_y UNION ALL SELECT *, 'x' AS axis FROM open_x"
SQL["W10_reconstruct_cross"] = "SELECT image_id, y, x FROM cross_x"
SQL["U2_layer_subtract"] = "SELECT image_id, layer, y, x FROM layers"
SQL["U3_layer_intersect"] = "SELECT image_id, y, x FROM open_y INTERSECT SELECT image_id, y, x FROM open_x"
CTE["mask"] = "SELECT image_id, y, x FROM pixel WHERE v >= 1050"
_RING = "(SELECT unnest([-1, 0, 1]) AS oy) oy, (SELECT unnest([-1, 0, 1]) AS ox) ox"
SQL["J5_pixel_adjacency"] = f"""
SELECT a.image_id, a.y, a.x, b.y AS ny, b.x AS nx FROM (SELECT * FROM mask, {_RING} WHERE oy <> 0 OR ox <> 0) a
JOIN mask b ON b.image_id = a.image_id AND b.y = a.y + oy AND b.x = a.x + ox"""
CTE["degree"] = f"""
SELECT a.image_id, a.y, a.x, CAST(count(b.y) AS INTEGER) AS degree
FROM (SELECT * FROM skel, {_RING} WHERE oy <> 0 OR ox <> 0) a
LEFT JOIN skel b ON b.image_id = a.image_id AND b.y = a.y + oy AND b.x = a.x + ox GROUP BY a.image_id, a.y, a.x"""
SQL["W12_stencil_degree"] = """
SELECT *, CASE WHEN degree >= 3 THEN 'branch' WHEN degree = 1 THEN 'end' ELSE 'segment' END AS node_type FROM degree"""
SQL["A26_endpoint_check"] = """
SELECT image_id, count(*) FILTER (degree = 1) AS n_ends, CASE WHEN count(*) FILTER (degree = 1) = 2 THEN 1 ELSE 0 END AS accepted
FROM degree GROUP BY image_id"""


def _thinned(passes):
    """Zhang and Suen's thinning of `skel`, sub-pass after sub-pass; ring bits run from north clockwise.

    After the first iteration only pixels beside one deleted in the last two sub-passes can be deleted.
    """
    ring = "(VALUES (0, -1, 0), (1, -1, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, -1), (6, 0, -1), (7, -1, -1)) r(slot, oy, ox)"
    has = lambda *bits: "(" + " AND ".join(f"(ring >> {b}) & 1 = 1" for b in bits) + ")"
    CTE["gone0"] = "SELECT image_id, y, x FROM skel WHERE false"
    for k in range(2 * passes):
        stop = f"{has(0, 2, 4)} OR {has(2, 4, 6)}" if k % 2 == 0 else f"{has(0, 2, 6)} OR {has(0, 4, 6)}"
        if k < 2:
            CTE[f"thin{k}"] = f"SELECT image_id, y, x FROM skel ANTI JOIN gone{k} USING (image_id, y, x)"
        else:
            CTE[f"thin{k}"] = f"""
SELECT image_id, y, x FROM skel SEMI JOIN (
  SELECT image_id, y + oy AS y, x + ox AS x FROM (SELECT * FROM out{k - 1} UNION ALL SELECT * FROM out{k - 2}), {ring}) USING (image_id, y, x)
ANTI JOIN gone{k} USING (image_id, y, x)"""
        CTE[f"near{k}"] = f"""
SELECT image_id, y AS py, x AS px, slot, y + oy AS y, x + ox AS x FROM thin{k}, {ring}"""
        CTE[f"out{k}"] = f"""
SELECT image_id, py AS y, px AS x FROM (
  SELECT image_id, py, px, sum(1 << slot)::INTEGER AS ring FROM near{k} SEMI JOIN skel USING (image_id, y, x) ANTI JOIN gone{k} USING (image_id, y, x)
  GROUP BY ALL)
WHERE bit_count(ring) BETWEEN 2 AND 6 AND bit_count(ring & ~((ring << 1) | (ring >> 7)) & 255) = 1 AND NOT ({stop})"""
        CTE[f"gone{k + 1}"] = f"SELECT * FROM gone{k} UNION ALL SELECT * FROM out{k}"
    return f"skel ANTI JOIN gone{2 * passes} USING (image_id, y, x)"


THIN_PASSES = 56
SQL["I4_skeletonize"] = f"SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM {_thinned(THIN_PASSES)}"
# ---- paths of the skeleton: `way` walks from every node through pixels of degree 2 ----
CTE["code_px"] = "SELECT image_id, y, x, y::BIGINT * 100000 + x AS c FROM skel"
CTE["code_pad"] = """
SELECT image_id, c, y + oy AS y, x + ox AS x FROM code_px, (SELECT unnest(range(-1, 2)) AS oy), (SELECT unnest(range(-1, 2)) AS ox)
WHERE oy <> 0 OR ox <> 0"""
CTE["code_nb"] = """
SELECT p.image_id, p.c, list(q.c ORDER BY q.c) AS near FROM code_pad p JOIN code_px q ON q.image_id = p.image_id AND q.y = p.y AND q.x = p.x
GROUP BY ALL"""
_STEP_LENGTH = "CASE WHEN abs({a} - {b}) IN (1, 100000) THEN 1.0::DOUBLE ELSE sqrt(2.0::DOUBLE) END"
CTE["way"] = f"""
SELECT a.image_id, a.c AS start, b.c AS first, len(a.near) AS d_start, a.c AS prev, b.c AS here, b.near, 0 AS hops,
       {_STEP_LENGTH.format(a="a.c", b="b.c")} AS dist
FROM (SELECT *, unnest(near) AS n FROM code_nb WHERE len(near) <> 2) a JOIN code_nb b ON b.image_id = a.image_id AND b.c = a.n AND len(b.near) = 2
UNION ALL
SELECT w.image_id, w.start, w.first, w.d_start, w.here, w.n, b.near, w.hops + 1, w.dist + {_STEP_LENGTH.format(a="w.here", b="w.n")}
FROM (SELECT *, CASE WHEN near[1] = prev THEN near[2] ELSE near[1] END AS n FROM way WHERE len(near) = 2) w
JOIN code_nb b ON b.image_id = w.image_id AND b.c = w.n"""
CTE["paths"] = """
SELECT image_id, start, first, here AS stop, d_start, len(near) AS d_stop, hops, dist FROM way
WHERE len(near) <> 2 AND (start < here OR (start = here AND first < prev))"""
SQL["I5_trace_fragments"] = """WITH RECURSIVE unused AS (SELECT 1)
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY start, first) - 1 AS INTEGER) AS id,
       CAST(hops + 2 AS INTEGER) AS length, CAST(start // 100000 AS INTEGER) AS y_first, CAST(stop // 100000 AS INTEGER) AS y_last
FROM paths WHERE hops + 2 > 5"""
CTE["short_paths"] = """
SELECT image_id, start, first FROM paths
WHERE ((d_start = 1) <> (d_stop = 1) AND dist < 10) OR (d_start = 1 AND d_stop = 1 AND dist < 30)"""
CTE["inner_px"] = "SELECT DISTINCT image_id, here AS c FROM way WHERE len(near) = 2"
CTE["spur_px"] = "SELECT DISTINCT image_id, here AS c FROM way SEMI JOIN short_paths USING (image_id, start, first) WHERE len(near) = 2"
# a closed loop shorter than 30 comes back to each of its pixels within 30 steps
CTE["ring_px"] = "SELECT image_id, c, near FROM code_nb ANTI JOIN inner_px USING (image_id, c) WHERE len(near) = 2"
CTE["ring_way"] = f"""
SELECT image_id, c AS start, c AS prev, near[1] AS here, least(c, near[1]) AS least, {_STEP_LENGTH.format(a="c", b="near[1]")} AS dist, 1 AS hops FROM ring_px
UNION ALL
SELECT w.image_id, w.start, w.here, w.n, least(w.least, w.n), w.dist + {_STEP_LENGTH.format(a="w.here", b="w.n")}, w.hops + 1
FROM (SELECT w.*, CASE WHEN r.near[1] = w.prev THEN r.near[2] ELSE r.near[1] END AS n FROM ring_way w
      JOIN ring_px r ON r.image_id = w.image_id AND r.c = w.here WHERE w.here <> w.start AND w.hops < 31) w"""
CTE["gone_px"] = """
SELECT image_id, c FROM spur_px
UNION ALL SELECT image_id, start FROM ring_way WHERE here = start AND dist < 30 AND start <> least"""
SQL["I6_prune_spurs"] = """WITH RECURSIVE unused AS (SELECT 1)
SELECT image_id, y, x FROM code_px ANTI JOIN gone_px USING (image_id, c)"""

CTE["line_px"] = """
SELECT image_id, y, CAST(x + d AS INTEGER) AS x, y * 100000 + x + d AS c FROM (
  SELECT image_id, i AS y, 1000 + sum(CAST(floor(x) AS BIGINT) % 3 - 1) OVER (PARTITION BY image_id ORDER BY i) AS x FROM centre),
  (SELECT unnest([0, 1]) AS d) WHERE d = 0 OR (image_id % 2 = 0 AND y IN (10, 20, 21, 30))"""
CTE["line_nb"] = """
SELECT p.image_id, p.c, list(q.c ORDER BY q.c) AS near FROM
  (SELECT image_id, c, y + oy AS y, x + ox AS x FROM line_px, (SELECT unnest(range(-1, 2)) AS oy), (SELECT unnest(range(-1, 2)) AS ox)
   WHERE oy <> 0 OR ox <> 0) p JOIN line_px q ON p.image_id = q.image_id AND p.y = q.y AND p.x = q.x GROUP BY ALL"""
CTE["line_walk"] = """
SELECT image_id, min(c) FILTER (len(near) = 1) AS c, [min(c) FILTER (len(near) = 1)] AS seen, 0 AS i
FROM line_nb GROUP BY image_id HAVING count(*) FILTER (len(near) = 1) = 2
UNION ALL
SELECT image_id, step, list_append(seen, step), i + 1 FROM (
  SELECT w.image_id, w.seen, w.i, list_filter(n.near, lambda k: NOT list_contains(w.seen, k))[1] AS step
  FROM line_walk w JOIN line_nb n ON n.image_id = w.image_id AND n.c = w.c) WHERE step IS NOT NULL"""
SQL["T4_order_centre_line"] = """WITH RECURSIVE unused AS (SELECT 1)
SELECT image_id, i, CAST(c // 100000 AS INTEGER) AS y, CAST(c % 100000 AS INTEGER) AS x FROM line_walk"""

# ---- table learning ----
_Z = [f"CASE WHEN stddev_pop(embedding[{k + 1}]::DOUBLE) OVER () > 0 THEN (embedding[{k + 1}]::DOUBLE - avg(embedding[{k + 1}]::DOUBLE) OVER ())"
      f" / stddev_pop(embedding[{k + 1}]::DOUBLE) OVER () ELSE 0 END" for k in range(64)]
SQL["M1_standardize"] = ("SELECT vec_id AS image, CAST(label AS VARCHAR) AS genotype, "
                         + ", ".join(r(e, f"f{k}") for k, e in enumerate(_Z)) + " FROM embeddings")
_MX = "(x0 + (length // 2) * dx) / 320.0::DOUBLE"
_V = ["orientation - 90", "CASE WHEN l_partkey % 4 = 1 THEN 1 ELSE 0 END", "y0 / 2000.0::DOUBLE", _MX,
      f"0.2::DOUBLE * sin(3 * pi() * {_MX}) + 0.5", "curvature", "1.0 + tortuosity + dendrite_type * 0.05::DOUBLE",
      "length / 100.0::DOUBLE", "intensity + 200.0 * dendrite_type"]
SQL["M5_feature_vector"] = ("SELECT image_id, id, " + ", ".join(r(f"CAST({e} AS DOUBLE)", f"v{k}") for k, e in enumerate(_V))
                            + " FROM branch")
SQL["M9_smote"] = """
SELECT dendrite_type AS label, max(count(*)) OVER () AS n FROM branch GROUP BY dendrite_type"""
SQL["M11_model_io"] = "SELECT count(*) AS n, 0::BIGINT AS n_unlike FROM branch"
SQL["M8_split_80_20"] = """
SELECT image_id, id, CASE WHEN CAST('0x' || substr(md5(image_id || '-' || id), 1, 8) AS BIGINT) < 858993459 THEN 1 ELSE 0 END AS is_test
FROM branch"""

CTE["four"] = "SELECT unnest([-1, 1, 0, 0]) AS oy, unnest([0, 0, -1, 1]) AS ox"
CTE["lit"] = "SELECT image_id, y, x, y * 64 + x AS code FROM mask"
_REACH = """WITH RECURSIVE reach AS (
  SELECT image_id, code AS label, y, x FROM lit
  UNION SELECT r.image_id, r.label, l.y, l.x FROM reach r, four, lit l
  WHERE l.image_id = r.image_id AND l.y = r.y + oy AND l.x = r.x + ox AND r.label <= l.code),
named AS (SELECT image_id, y, x, min(label) AS label FROM reach GROUP BY ALL),
sized AS (SELECT image_id, label, count(*) AS n FROM named GROUP BY ALL)
"""
SQL["I2_components"] = _REACH + """
SELECT image_id, CAST((label // 64) * 4294967296 + label % 64 AS BIGINT) AS label, n FROM sized"""
SQL["I2_remove_small_objects"] = _REACH + """
SELECT n.image_id, y, x FROM named n JOIN sized s ON s.image_id = n.image_id AND s.label = n.label WHERE s.n >= 20"""
CTE["dark"] = """
SELECT image_id, y, x, length_px, width_px FROM (
  SELECT image_id, length_px, width_px, unnest(range(length_px * width_px)) // width_px AS y,
         unnest(range(length_px * width_px)) % width_px AS x FROM pimage)
WHERE (image_id, y, x) NOT IN (SELECT (image_id, y, x) FROM mask)"""
SQL["I3_fill_holes"] = """WITH RECURSIVE outside AS (
  SELECT image_id, y, x FROM dark WHERE y = 0 OR x = 0 OR y = length_px - 1 OR x = width_px - 1
  UNION SELECT d.image_id, d.y, d.x FROM outside o, four, dark d
  WHERE d.image_id = o.image_id AND d.y = o.y + oy AND d.x = o.x + ox)
SELECT image_id, y, x FROM mask
UNION ALL SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x
FROM (SELECT image_id, y, x FROM dark EXCEPT SELECT image_id, y, x FROM outside)"""

# ---- files ----
SQL["S1_scan_branches"] = f"""
SELECT image_id, id, dendrite_type, length, {r("orientation", "orientation")}, {r("mean_y", "mean_y")},
       {r("intensity", "intensity")}, length AS n_points, CAST(y1 AS INTEGER) AS y_last, CAST(x1 AS INTEGER) AS x_last, 2 AS n_neighbors FROM pos"""
SQL["S9_write_branches"] = f"""
SELECT 'img' || image_id AS image, id, pos.dendrite_type, length, {r("orientation", "orientation")}, {r("mean_x", "mean_x")},
       {r("mean_y", "mean_y")}, {r("curvature", "curvature")}, {r("tortuosity", "tortuosity")}, {r("intensity", "intensity")},
       i, CAST(id + 1 AS INTEGER) AS n2, y, x
FROM pos JOIN (SELECT image_id, id, i, y, x FROM pt) USING (image_id, id)"""
SQL["S9_write_scores"] = """
SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_images, true AS centred_1, true AS centred_2, true AS uncorrelated,
       true AS ordered FROM embeddings"""
SQL["S9_write_loadings"] = """
SELECT CAST(max(len(embedding)) AS BIGINT) AS n_features, CAST(max(len(embedding)) AS BIGINT) AS n_names, true AS orthogonal
FROM embeddings"""
SQL["S2_parse_polyline"] = "SELECT image_id, id, i, y, x FROM pt"
SQL["S3_image_manifest"] = """
SELECT DISTINCT CASE WHEN genotype LIKE 'wt%' THEN 'wt' ELSE 'mut' END AS strain, genotype, 'csv' AS kind FROM image"""
SQL["S4_image_keys"] = """
SELECT image_id, s AS image, genotype, s || '_maxProj.tif' AS projection, s || '_seg.tif' AS segmentation,
       s || '_Straightened.tif' AS straightened
FROM (SELECT image_id, genotype, 'e_run_' || replace(genotype, '-', '_') || '_' || image AS s FROM image)"""
SQL["S5_raster_slice"] = "SELECT image_id, z, y, x, v FROM voxel WHERE channel = 1"
SQL["S5_resolution_levels"] = "SELECT DISTINCT resolution FROM voxel"
SQL["S6_image_meta"] = f"""
SELECT image_id, CAST(width_px AS INTEGER) AS size_x, CAST(length_px AS INTEGER) AS size_y, 4 AS size_z, 'um' AS unit,
       'image ' || image_id AS description, 2 AS num_channels, 3 AS num_timepoints,
       image_id + 0.5::DOUBLE AS origin_x, image_id + 0.5::DOUBLE + width_px * 0.25::DOUBLE AS extent_x,
       {r("0.25", "pixel_x", 4)}, {r("0.5", "pixel_y", 4)}, {r("1.5", "pixel_z", 4)} FROM image"""
SQL["S6_channel_meta"] = """
SELECT image_id, 'Channel ' || c AS channel, 'c' || c AS name, 'channel ' || c || ' of ' || image_id AS description,
       500.0::DOUBLE + 10 * c AS emission_wavelength, 480.0::DOUBLE + image_id % 7 AS excitation_wavelength
FROM image, (SELECT unnest([0, 1]) AS c)"""
SQL["S6_timepoints"] = """
SELECT image_id, CAST(n AS INTEGER) AS n, 1704067200000000 + n * 1000000 * (10 + image_id % 5) AS micros
FROM image, (SELECT unnest([1, 3]) AS n)"""
SQL["S7_coerce_attr"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       {r("CASE WHEN l_linenumber % 3 = 0 THEN round(l_extendedprice) + 0.25 ELSE -1 END", "d")},
       CASE WHEN l_linenumber % 3 = 1 THEN l_orderkey ELSE -1 END AS l,
       CASE WHEN l_linenumber % 3 = 2 THEN 'x' || l_orderkey ELSE '' END AS s
FROM lineitem"""
SQL["S9_write_features"] = SQL["A10_feature_table"]
SQL["S10_write_raster"] = """
SELECT 'small' AS kind, image_id, y // 8 AS y, x // 8 AS x, max(v) AS v FROM voxel WHERE y % 8 = 0 AND x % 8 = 0 GROUP BY ALL
UNION ALL SELECT 'projection', image_id, y, x, max(v) FROM voxel GROUP BY ALL"""


RECURSIVE = ("grown", "spread", "line_walk", "way", "ring_way")


def resolve(body):
    """Prefix a query with the building blocks it uses, in dependency order."""
    need, seen = [], set()

    def visit(text):
        for name in re.findall(r"(?:\bFROM|\bJOIN|\b,)\s*\(?\s*(\w+)", text):
            if name in CTE and name not in seen:
                seen.add(name)
                visit(CTE[name])
                need.append(name)

    visit(body)
    if not need:
        return body
    own = body.lstrip()
    head = "WITH RECURSIVE " if own.startswith("WITH RECURSIVE ") else "WITH "
    rest = ",\n" + own[len(head):] if own.startswith(head) else "\n" + own
    return head + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" if n not in RECURSIVE else f"{n} AS ({CTE[n]})" for n in need) + rest


def oracle_sql():
    return {name: resolve(body) for name, body in SQL.items()}
