"""Repeated passages across documents by MinHash banding of paragraphs.

Words are compared without case. Three kinds of units are cut from a text, each of 32 words or more:
  - paragraphs: a line, or lines under 32 words in a row joined up to a blank or a longer line;
  - chunks, for passages inside longer lines or over several: the words between neighbouring 5-word shingles that are
    the least (by hash) of the 63 around them, 63 words on average;
  - windows, for exact copies only: the 32 words from a shingle that is the least of 16 in a row. Two documents that
    share 47 words in a row share a whole window, wherever it stands.

1. Windows: anchors are counted over all documents; windows whose anchor stands in one document only cannot repeat and
   are left out, by a bit table of fixed size (its false positives only cost time). Equal windows are one class.
2. Paragraphs and chunks: equal ones are one class. Every class, whatever its anchors or edits, has a MinHash signature
   over its shingles in `BANDS` bands of `ROWS` values: 1 - (1 - 0.75 ** ROWS) ** BANDS = 0.99 of pairs at similarity
   0.75 collide.
3. In every bucket the classes are compared with one leader, another for each band, and once more among those that are
   still apart. Then all pairs of a bucket that are in unlike components and not yet compared are compared, unless
   their sizes or the parity bits of their shingles rule a link out. Exact Jaccard of the shingles at 0.75 decides.
4. Linked classes form components. A component that occurs in two documents or more is a repeat: its occurrence in the
   document of the smallest id stays, those in other documents are removals. Overlapping units are one passage.

Defined cases: null texts, empty texts and texts under 32 words have no unit. A passage repeated inside one document
only is no repeat. Rows of one id count as one document; rows with a null id are each told apart from others by text and
never kept in favour of a row with an id. Repeated rows with equal id and text give equal passages, reported once. Every
unit has its own keeper, so a removed paragraph may overlap a window kept for other documents. Other columns are
ignored; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ramify.functions.patterns import components, salted_join
from ramify.llm.common import _R, _RINV, GOLD, _power, cut, drop_cut, lowered_wide, mix, ngrams, row_groups, text_buffer, tidy, words

SHINGLE, RUN, WORDS = 5, 16, 32
BANDS, ROWS = 8, 3
PARITY = 4
MANY_PLACES = 10_000
TABLE_BITS = 26
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def _own(g, first):
    """Shingles of each position, or the largest number where they leave the row; and the row of each word."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.where(row[:len(g)] == row[SHINGLE - 1:SHINGLE - 1 + len(g)], g, np.uint64(0xFFFFFFFFFFFFFFFF)), row


def _doubled(least, x, run):
    """Of x, the least (or by np.maximum the largest) of every `run` (a power of two) in a row, by doubling."""
    for k in range(run.bit_length() - 1):
        x = least(x[:-(1 << k)], x[1 << k:])
    return x


def anchors(h, first):
    """Anchored windows of all rows: shingle hashes, anchor positions (words), their rows."""
    g = ngrams(h, SHINGLE)
    if not len(g):
        return g, np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, row = _own(g, first)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    pad = np.full(RUN - 1, top)
    low = _doubled(np.minimum, np.concatenate([pad, own, pad]), RUN)
    low = _doubled(np.maximum, low, RUN)  # the largest such minimum among the runs that hold a position
    is_least = (low == own) & (own != top)
    is_least[:-1] &= own[1:] != own[:-1]  # of a repeated shingle, the last
    pos = np.flatnonzero(is_least)
    pos = pos[pos + WORDS <= first[row[pos] + 1]]
    return g, pos, row[pos]


def units(raw, h, start, first, g):
    """Paragraphs and chunks of all rows: first word, word after the last, row, and whether it is a chunk."""
    if len(h) < WORDS:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))
    # paragraphs
    lines = np.concatenate([[0], np.cumsum(raw == 0x0A)])[start]
    step = np.diff(lines, prepend=lines[0])
    row_start = np.zeros(len(h), bool)
    row_start[first[:-1][first[:-1] < len(h)]] = True
    heads = np.flatnonzero(row_start | (step > 0))
    long = np.diff(np.append(heads, len(h))) >= WORDS
    cuts = row_start[heads] | (step[heads] > 1) | long
    cuts[1:] |= long[:-1]
    a = heads[cuts]
    b = np.append(a[1:], len(h))
    full = b - a >= WORDS
    a, b = a[full], b[full]
    # chunks
    own, row = _own(g, first)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    pad = np.full(WORDS - 1, top)
    low = _doubled(np.minimum, np.concatenate([pad, own, pad]), WORDS)
    low = np.minimum(low[:len(own)], low[WORDS - 1:])  # least of the shingle, WORDS - 1 before it and WORDS - 1 after it
    pos = np.flatnonzero((low == own) & (own != top))
    x, y = pos[:-1], pos[1:]
    inside = (row[x] == row[y]) & (y - x >= WORDS)
    x, y = x[inside], y[inside]
    return np.concatenate([a, x]), np.concatenate([b, y]), np.concatenate([row[a], row[x]]), np.arange(len(a) + len(x)) >= len(a)


def _paragraphs(column):
    """Per block of rows: first row, shingles, window positions, rows, word hashes, starts, ends, row byte offsets, units."""
    raw, offsets = text_buffer(column)
    for a, b in row_groups(offsets):
        o = offsets[a:b + 1]
        low = lowered_wide(raw[o[0]:o[-1]])
        start, end, h, first = words(low, o - o[0])
        g, pos, row = anchors(h, first)
        yield a, g, pos, row, h, start, end, o - o[0], units(low, h, start, first, g)


def _flat(a, size):
    """Positions a .. a + size - 1 of every unit in a row, and where each unit's begin."""
    begin = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(begin - a, size), begin


def band_keys(flat, begin, kind=0):
    """Band keys of sets of 32-bit shingles (in uint64), laid end to end from `begin` on; unlike kinds share none."""
    least = np.stack([np.minimum.reduceat(mix(flat ^ seed), begin) for seed in _SEEDS], 1)
    keys = []
    for b in range(BANDS):
        k = np.full(len(begin), b + 1, np.uint64) + np.uint64(BANDS) * np.asarray(kind, np.uint64)
        for r in range(ROWS):
            k = mix(k ^ least[:, b * ROWS + r])
        keys.append(k)
    return np.stack(keys, 1)


def signatures(sets):
    """Band keys of sets of equal size, given as rows of 32-bit shingles."""
    return band_keys(sets.astype(np.uint64).reshape(-1), np.arange(len(sets)) * sets.shape[1])


def similarities(x, nx, y, ny):
    """Jaccard similarities of pairs of sets of 32-bit shingles, laid end to end; nx and ny are their sizes."""
    def named(v, n):
        return np.unique(np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(32), n) | v.astype(np.uint64))
    x, y = named(x, nx), named(y, ny)
    count = lambda v: np.bincount((v >> np.uint64(32)).astype(np.int64), minlength=len(nx))
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = count(both[1:][both[1:] == both[:-1]])
    return common / np.maximum(1, count(x) + count(y) - common)


def jaccard(x, y):
    """Row-wise Jaccard similarity of two arrays of shingles."""
    return similarities(x.reshape(-1), np.full(len(x), x.shape[1]), y.reshape(-1), np.full(len(y), y.shape[1]))


def parity_bits(s):
    """PARITY * 64 bits, each whether an odd number of the set's members falls on it (as in ngram_join)."""
    odd = np.bincount((mix(s.astype(np.uint64)) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def window_keys(h, pos):
    """64-bit name of the WORDS words from each position."""
    return _span_keys(h, pos, pos + WORDS)


def unit_keys(h, a, b, chunk):
    """64-bit name of units. Paragraphs and chunks are classes of their own: a chunk is not compared with its paragraph."""
    return mix(_span_keys(h, a, b) ^ chunk.astype(np.uint64))


def _span_keys(h, a, b):
    """64-bit name of the words from a to before b."""
    n = len(h)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _power(_R, n), out=sums[1:])
    return mix((sums[b] - sums[a]) * _power(_RINV, n + 1)[a] + (b - a).astype(np.uint64) * GOLD)


def _shared_parts(texts, ranges):
    """Rows (w, bits) of a table of the anchors in two rows or more, and rows (band, key, many) of the unit classes that
    share a bucket with others (many) or occur more than once."""
    bits = np.uint64(ranges.bit_length() - 1)
    kinds = (("anchor", np.uint64), ("n", np.uint8), ("band", np.uint32), ("key", np.uint64))

    def scan(batches):
        found, bands, keys, seen, again = [], [], [], set(), set()
        for batch in batches:
            for _, g, pos, row, h, _, _, _, (x, y, _, chunk) in _paragraphs(batch.column(0)):
                a = g[pos]
                order = np.lexsort((a, row))
                a, r = a[order], row[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
                found.append(_counted(a[new], np.ones(int(new.sum()), np.uint8)))
                key, one, n = np.unique(unit_keys(h, x, y, chunk), return_index=True, return_counts=True)
                fresh = np.array([k not in seen for k in key.tolist()], bool)
                again.update(key[(n > 1) | ~fresh].tolist())
                seen.update(key[fresh].tolist())
                x, y, chunk, key = x[one[fresh]], y[one[fresh]], chunk[one[fresh]], key[fresh]
                if len(key):
                    at, begin = _flat(x, y - x - SHINGLE + 1)
                    bands.append(band_keys(g[at] >> np.uint64(32), begin, chunk).reshape(-1))
                    keys.append(np.repeat(key, BANDS))
        if found:
            a, n = _counted(*(np.concatenate(v) for v in zip(*found, strict=True)))
            twice = np.repeat(np.fromiter(again, np.uint64, len(again)), 2)  # classes that this task alone has twice
            band, key = np.concatenate([*bands, mix(twice)]), np.concatenate([*keys, twice])
            order = np.argsort(band)
            band, key = band[order], key[order]
            edges = np.arange(ranges, dtype=np.uint64) << (np.uint64(64) - bits)
            cuts = [np.append(np.searchsorted(v, edges), len(v)) for v in (a, band)]
            low = (band >> (np.uint64(32) - bits)).astype(np.uint32)
            rows = [r for r in range(ranges) if any(c[r + 1] > c[r] for c in cuts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()),
                 *[pa.array([v[c[r]:c[r + 1]].tobytes() for r in rows], pa.binary())
                   for v, c in ((a, cuts[0]), (n, cuts[0]), (low, cuts[1]), (key, cuts[1]))]], names=["rng", *[k for k, _ in kinds]])

    def told(table):
        rng = np.uint64(table.column("rng")[0].as_py())
        a, n, band, key = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in kinds)
        a, n = _counted(a, n)
        slot = a[n > 1] >> np.uint64(64 - TABLE_BITS)
        word, back = np.unique(slot >> np.uint64(6), return_inverse=True)
        table_bits = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(table_bits, back, np.uint64(1) << (slot & np.uint64(63)))
        order = np.lexsort((key, band))
        band, key = band[order], key[order]
        head = np.ones(len(band), bool)
        head[1:] = band[1:] != band[:-1]
        new = head.copy()
        new[1:] |= key[1:] != key[:-1]
        at = np.flatnonzero(new)
        repeats = np.diff(np.append(at, len(band))) > 1
        group = np.cumsum(head)[at] - 1 if len(at) else at
        many = np.bincount(group, minlength=1)[group] > 1
        keep = at[many | repeats]
        w, m = len(word), len(keep)
        return pa.Table.from_arrays(
            [pa.array(np.append(word.astype(np.int64), np.full(m, -1))), pa.array(np.append(table_bits.view(np.int64), np.zeros(m, np.int64))),
             pa.array(np.append(np.zeros(w, np.int64), ((rng << np.uint64(32)) | band[keep].astype(np.uint64)).view(np.int64))),
             pa.array(np.append(np.zeros(w, np.int64), key[keep].view(np.int64))),
             pa.array(np.append(np.zeros(w, bool), many[many | repeats]))], names=["w", "bits", "band", "key", "many"])

    return (texts.mapInArrow(tidy(scan), "rng int, anchor binary, n binary, band binary, key binary")
            .groupBy("rng").applyInArrow(told, "w long, bits long, band long, key long, many boolean"))


def _counted(a, n):
    """Sorted distinct a, with n summed up to 2."""
    order = np.argsort(a)
    a, n = a[order], n[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]]))
    total = np.add.reduceat(n.astype(np.int64), starts) if len(starts) else n
    return a[starts], np.minimum(total, 2).astype(np.uint8)


def _tables(parts):
    """Three bit tables: anchors in two rows or more, unit classes whose places and those whose shingles are wanted."""
    slot = F.shiftrightunsigned("key", 64 - TABLE_BITS)
    keys = parts.filter("w < 0").select("key", "many").withColumn("s", slot).withColumn("w", F.shiftright("s", 6))
    bit = "shiftleft(1L, int(s & 63))"
    rows = keys.groupBy("w").agg(F.expr(f"bit_or({bit})").alias("b1"), F.expr(f"bit_or(if(many, {bit}, 0L))").alias("b2"))
    tables = np.zeros((3, 1 << (TABLE_BITS - 6)), np.int64)
    # never more rows than the words of the tables, but for anchors of slots that two ranges share
    for r in parts.filter("w >= 0").groupBy("w").agg(F.expr("bit_or(bits)").alias("bits")).toLocalIterator():
        tables[0, r["w"]] = r["bits"]
    for r in rows.toLocalIterator():
        tables[1:, r["w"]] = r["b1"], r["b2"]
    return tables.view(np.uint64)


def _in_table(table, anchor):
    slot = anchor >> np.uint64(64 - TABLE_BITS)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _candidates(rows, tables, id_type):
    """kind 0: (doc_id, mark, key, start, end, at, size in words) per window whose anchor repeats and per wanted unit;
    kind 1: (key, size, shingles, parity bits) per class and task of units that share a bucket."""
    shared = rows.sparkSession.sparkContext.broadcast(tables)  # three times a fixed 2 ** TABLE_BITS bits
    arrow_id = pa.int64() if id_type == "bigint" else pa.string()
    parity = [f"p{i}" for i in range(PARITY)]
    names = ["kind", "doc_id", "mark", "key", "start", "end", "at", "size", "elems", *parity]

    def scan(batches):
        seen = set()
        for batch in batches:
            for base, g, pos, row, h, start, end, offsets, (x, y, unit_row, chunk) in _paragraphs(batch.column(2)):
                hit = _in_table(shared.value[0], g[pos])
                unit_key = unit_keys(h, x, y, chunk)
                met = _in_table(shared.value[1], unit_key)
                x, y, unit_row, unit_key = x[met], y[met], unit_row[met], unit_key[met]
                key = np.concatenate([window_keys(h, pos[hit]), unit_key])
                row = np.concatenate([row[hit], unit_row])
                a, b = np.concatenate([pos[hit], x]), np.concatenate([pos[hit] + WORDS, y])
                n = len(key)
                if not n:
                    continue
                where = pa.array(base + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int8)), batch.column(0).take(where).cast(arrow_id), batch.column(1).take(where),
                     pa.array(key.view(np.int64)), pa.array(start[a] - offsets[row]), pa.array(end[b - 1] - offsets[row]),
                     pa.array(a), pa.array(b - a), pa.nulls(n, pa.binary()), *[pa.nulls(n, pa.int64())] * PARITY], names=names)
                _, one = np.unique(unit_key, return_index=True)
                one = one[_in_table(shared.value[2], unit_key[one])]
                one = np.array([i for i in one if int(unit_key[i]) not in seen], np.int64)
                seen.update(int(unit_key[i]) for i in one)
                m = len(one)
                if m:
                    sets = [np.unique((g[x[i]:y[i] - SHINGLE + 1] >> np.uint64(32)).astype(np.uint32)) for i in one]
                    odd = np.array([parity_bits(s) for s in sets])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ones(m, np.int8)), pa.nulls(m, arrow_id), pa.nulls(m, pa.int64()), pa.array(unit_key[one].view(np.int64)),
                         *[pa.nulls(m, pa.int64())] * 3, pa.array(np.array([len(s) for s in sets])),
                         pa.array([s.tobytes() for s in sets], pa.binary()),
                         *(pa.array(np.ascontiguousarray(odd[:, i])) for i in range(PARITY))], names=names)

    bits = ", ".join(f"{p} long" for p in parity)
    return rows.mapInArrow(tidy(scan), f"kind tinyint, doc_id {id_type}, mark long, key long, start long, end long, at long, "
                                       f"size long, elems binary, {bits}")


def _stars(entries, seed):
    """Distinct pairs of a bucket's leader and its other members; entries (band, key, root), pairs of unlike roots only."""
    lead = F.min(F.struct(F.xxhash64(F.lit(seed), "key", "band").alias("h"), "key", "root"))
    tops = entries.groupBy("band").agg(lead.alias("top"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("band", "top")
    met = entries.join(tops, "band").filter(F.col("root") != F.col("top.root"))
    return met.select(F.least("key", "top.key").alias("a"), F.greatest("key", "top.key").alias("b")).distinct()


def _across(entries, classes, threshold):
    """Distinct pairs of a bucket in unlike components that sizes and parity bits leave able to link; entries (band, key, root)."""
    open_ = entries.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    parity = [f"p{i}" for i in range(PARITY)]
    left = cut(entries.join(open_, "band").join(classes.select("key", "size", *parity), "key"))
    one, two = (left.select("band", *[F.col(c).alias(f"{k}{c}") for c in ("key", "root", "size", *parity)]) for k in "xy")
    differ = sum(F.bit_count(F.col(f"x{p}").bitwiseXOR(F.col(f"y{p}"))) for p in parity)
    total = F.col("xsize") + F.col("ysize")
    met = one.join(two, "band").filter(
        (F.col("xkey") < F.col("ykey")) & (F.col("xroot") != F.col("yroot"))
        & (F.least("xsize", "ysize") >= threshold * F.greatest("xsize", "ysize"))
        & (differ * (1 + threshold) <= total * (1 - threshold) + 1e-6))
    pairs = cut(met.select(F.col("xkey").alias("a"), F.col("ykey").alias("b")).distinct())
    drop_cut(left)
    return pairs


def _verified(pairs, classes, threshold):
    def check(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                packed = [part.column(c).to_pylist() for c in (2, 3)]
                x, y = (np.frombuffer(b"".join(p), np.uint32) for p in packed)
                nx, ny = (np.array([len(e) // 4 for e in p]) for p in packed)
                yield part.select([0, 1]).filter(pa.array(similarities(x, nx, y, ny) >= threshold))
    one, two = (classes.select(F.col("key").alias(k), F.col("elems").alias(f"e{k}")) for k in "ab")
    return cut(pairs.join(one, "a").join(two, "b").select("a", "b", "ea", "eb").mapInArrow(tidy(check), "a long, b long"))


def _linked(entries, classes, threshold):
    """(key, root) of the classes that link: every pair that shares a bucket is compared or already in one component."""
    links, compared, comp, made = None, None, None, []
    rooted = entries.withColumn("root", F.col("key"))
    for seed in (1, 2, None):
        pairs = cut(_stars(rooted, seed)) if seed else _across(rooted, classes, threshold).join(compared, ["a", "b"], "left_anti")
        found = _verified(pairs, classes, threshold)
        made += [pairs, found]
        links = found if links is None else links.union(found)
        compared = pairs if compared is None else compared.union(pairs)
        comp = cut(components(links.select(F.lit(0).alias("g"), "a", "b"), key="g").select(F.col("node").alias("key"), "root"), retire=comp)
        rooted = entries.join(comp, "key", "left").withColumn("root", F.coalesce("root", "key"))
    for t in made:
        drop_cut(t)
    return comp


def repeated_paragraphs(df, text="text", doc_id="doc_id", threshold=0.75):
    """Every occurrence of a unit that two documents or more share: doc_id, mark, start, end, at, size, cluster, keep_mark."""
    id_type = "bigint" if df.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    ident = F.col(doc_id).cast(id_type)
    mark = F.when(ident.isNull(), F.xxhash64(F.lit("null id"), text)).otherwise(F.xxhash64(ident))
    rows = df.select(ident.alias("doc_id"), mark.alias("mark"), F.col(text).alias("_text"))
    ranges = 1 << max(4, (2 * rows.rdd.getNumPartitions()).bit_length())
    parts = cut(_shared_parts(rows.select("_text"), ranges))
    found = cut(_candidates(rows, _tables(parts), id_type))
    classes = cut(found.filter("kind = 1").select("key", "size", "elems", *[f"p{i}" for i in range(PARITY)]).dropDuplicates(["key"]))
    comp = _linked(parts.filter("w < 0 AND many").select("band", "key"), classes, threshold)
    # read twice below, so its two shuffles are not repeated
    places = cut(
        found.filter("kind = 0").select("doc_id", "mark", "key", "start", "end", "at", "size").dropDuplicates(["mark", "key", "start"])
        .join(comp, "key", "left").withColumn("cluster", F.coalesce("root", "key")).drop("root", "key")
    )
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    shared = places.groupBy("cluster").agg(
        F.min(first).alias("first"), F.min("mark").alias("lo"), F.max("mark").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = shared.filter("lo <> hi").select("cluster", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.mark").alias("keep_mark"), "n")
    # places of the few clusters that very many documents share are spread over tasks, the others meet by cluster
    often = (F.col("n") > MANY_PLACES)
    spread = salted_join(places, shared.filter(often).drop("n"), ["cluster"], F.struct("mark", "start"), how="left")
    rest = spread.filter("keep_mark IS NULL").drop("keep_doc_id", "keep_mark").join(shared.filter(~often).drop("n"), "cluster")
    out = cut(spread.filter("keep_mark IS NOT NULL").unionByName(rest))
    for t in (parts, found, classes, comp, places):
        drop_cut(t)
    return out


def repeated_passages(df, text="text", doc_id="doc_id", threshold=0.75):
    """One row per passage: doc_id, start, end (UTF-8 bytes), n_words, keep_doc_id, removed, cluster.

    Overlapping or touching units of a document that are all kept, or all removed, are one passage, named by the
    cluster and keeper of its first unit.
    """
    places = repeated_paragraphs(df, text, doc_id, threshold).withColumn("removed", F.col("mark") != F.col("keep_mark"))
    order = W.partitionBy("mark", "removed").orderBy("start", "end", "cluster")
    so_far = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    parts = places.withColumn("new", (so_far.isNull() | (F.col("start") > so_far + 1)).cast("int"))
    parts = parts.withColumn("nr", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    head = F.min(F.struct("start", "end", "cluster", "keep_doc_id"))
    out = parts.groupBy("doc_id", "mark", "removed", "nr").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("at") + F.col("size")) - F.min("at")).alias("n_words"), head.alias("head"))
    return out.select("doc_id", "start", "end", "n_words", F.col("head.keep_doc_id").alias("keep_doc_id"), "removed",
                      F.col("head.cluster").alias("cluster"))
