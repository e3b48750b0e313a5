"""Exact Jaccard self-join on word shingles with skipping, and its components.

A document's set holds its distinct 5-word shingles; two documents link when their Jaccard similarity is at least
`num / den` (3/4). Every link between different sets counts, none is sampled or capped.

1. Sets. Documents with equal sets are one class. Shingles are counted in a sketch of fixed size, which orders them:
   rarer first, then by hash. The order decides cost only, never results.
2. Index lists. Of a set of n only the first n - ceil(3n/4) + 1 shingles in that order are indexed; linked sets share
   at least one of them. Entries carry set size and position and travel packed, one block per range of shingles. Lists
   of very common shingles are dealt to several blocks by set.
3. Answers from a highly similar set. In each list all sets are first compared with one leader only, the set with the
   fewest rare shingles: among edited copies the least edited one. A set that links to its leader takes the leader's answers over, its component, and needs no others inside it.
4. Skipping. What is left of a list is compared across components only. Lists whose sets are in one component by now are
   skipped whole; others are joined by blocks of like size, so blocks that no size bound admits never meet; single pairs
   are skipped by the parity bits of their sets (too many members differ), by position (too little can follow) and by
   the number of indexed shingles they share.
5. Pairs that survive are verified on their whole sets.

Defined cases: null texts and texts without words have an empty set (n_shingles 0) and link with nothing; fewer than
five words are one shingle. Null ids take part; a component is named by the smallest non-null id in it. Repeated rows
are copies. Other columns are ignored; an empty table gives no rows. Sets and shingles are identified by 64-bit hashes.
"""

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ramify.functions.patterns import components
from ramify.llm.common import arrow_batches, cut, drop_cut, lowered, mix, row_groups, shingle_sets, text_buffer, tidy
from ramify.llm.exact_dedup import one_of

SKETCH_BITS = 23
RANGE_BITS = 16
FLUSH_ENTRIES = 1 << 19
LIST_PART = 4096
FILTER_BITS = 24
PARITY = 16


def need(a, b, num=3, den=4):
    """Least intersection of linked sets of sizes a and b (Python ints, arrays or SQL text alike)."""
    return (num * (a + b) + num + den - 1) // (num + den)


def prefix_length(n, num=3, den=4):
    return n - (num * n + den - 1) // den + 1


def set_key(s):
    """64-bit name of a set of hashes, independent of order."""
    return mix(mix(s).sum(dtype=np.uint64).reshape(1) + np.uint64(len(s)))[0]


def parity_bits(s):
    """PARITY * 64 bits: each tells whether an odd number of the set's members falls on it.

    Two sets differ in at least as many members as their bits differ, which bounds their intersection from above.
    """
    odd = np.bincount((mix(s) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(batch, text_at):
    """Sets of the rows of a batch, a block of rows at a time."""
    raw, offsets = text_buffer(batch.column(text_at))
    for a, b in row_groups(offsets):
        o = offsets[a:b + 1]
        yield from shingle_sets(lowered(raw[o[0]:o[-1]]), o - o[0])


# ---- 1. sets and the sketch -------------------------------------------------

def _scan_sets(docs, id_type):
    """Rows (doc_id, mark, key, n, parity bits) per document and (part, blob) per piece of the sketch."""
    pieces = 1 << (SKETCH_BITS - RANGE_BITS)
    schema = pa.schema([("doc_id", pa.int64() if id_type == "bigint" else pa.string()), ("mark", pa.int64()),
                        ("key", pa.int64()), ("n", pa.int32()), *((f"p{i}", pa.int64()) for i in range(PARITY)),
                        ("part", pa.int32()), ("blob", pa.binary())])

    def scan(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint16)  # of this task, up to 65535

        def count(held):
            slot, n = np.unique(np.concatenate(held), return_counts=True)
            counts[slot] = np.minimum(counts[slot] + n, 65535)

        for batch in batches:
            keys, sizes, bits, held = [], [], [], []
            for s in _sets(batch, 2):
                keys.append(set_key(s))
                sizes.append(len(s))
                bits.append(parity_bits(s))
                held.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                if len(held) == 1000:
                    count(held)
                    held = []
            if held:
                count(held)
            m = len(sizes)
            bits = np.array(bits, np.int64).reshape(m, PARITY)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(schema.field(0).type), batch.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)),
                pa.array(np.array(sizes, np.int32)), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(PARITY)),
                pa.array(np.full(m, -1, np.int32)), pa.nulls(m, pa.binary())], schema=schema)
        used = [(p, c) for p, c in enumerate(counts.reshape(pieces, -1)) if c.any()]
        if used:
            k = len(used)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(k, schema.field(0).type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()),
                *(pa.nulls(k, pa.int64()) for _ in range(PARITY)), pa.array(np.array([p for p, _ in used], np.int32)),
                pa.array([zlib.compress(c.tobytes(), 1) for _, c in used], pa.binary())], schema=schema)

    bits = ", ".join(f"p{i} long" for i in range(PARITY))
    out = f"doc_id {id_type}, mark long, key long, n int, {bits}, part int, blob binary"
    return docs.mapInArrow(tidy(scan), out)


def _levels(scanned, total):
    """Per sketch slot, how common its shingles are: 0 up to what chance brings, then about log2 of the excess.

    And to how many parts (as a power of two) the lists of such shingles are dealt. Two fixed arrays of bytes.
    """
    pieces = 1 << (SKETCH_BITS - RANGE_BITS)
    mean = total / (1 << SKETCH_BITS)
    usual = mean + 4 * np.sqrt(mean) + 8

    def add(batches):
        sums = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.frombuffer(zlib.decompress(blob), np.uint16)
                sums[part] = sums[part] + c if part in sums else c.astype(np.uint64)
        if sums:
            done = []
            for c in sums.values():
                level = np.where(c <= usual, 0, np.ceil(np.log2(np.maximum(c, 1) / (mean + 8))) + 1).astype(np.uint8)
                parts = np.where(c > usual + LIST_PART, np.ceil(np.log2(np.maximum(c, 1) / LIST_PART)), 0).astype(np.uint8)
                done.append(zlib.compress(level.tobytes() + parts.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(done, pa.binary())], names=["part", "blob"])

    told = (scanned.filter("part >= 0").select("part", "blob").repartition(pieces, "part")
            .mapInArrow(tidy(add), "part int, blob binary"))
    out = np.zeros((2, pieces, 1 << RANGE_BITS), np.uint8)
    for r in told.toLocalIterator():
        out[:, r["part"]] = np.frombuffer(zlib.decompress(r["blob"]), np.uint8).reshape(2, -1)
    return out[0].reshape(-1), out[1].reshape(-1)


# ---- 2. index lists ---------------------------------------------------------

def _index_blocks(docs, level, salts, ranges, num, den):
    """Packed entries (shingle, key, size, position, score) of every set's prefix, by range of shingles.

    The score is the share of the set's shingles that are rare: low for the least edited of many copies.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((level, salts))  # two bytes per sketch slot
    bits = np.uint64(ranges.bit_length() - 1)

    def flush(held):
        tok, key, size, pos, score = (np.concatenate(x) for x in zip(*held, strict=True))
        salt = shared.value[1][(tok >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
        part = mix(key) & ((np.uint64(1) << salt) - np.uint64(1))
        where = (mix(tok + part * np.uint64(0x9E3779B97F4A7C15)) >> (np.uint64(64) - bits)).astype(np.int64) if bits else np.zeros(len(tok), np.int64)
        order = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[order], np.arange(ranges + 1))
        rows = [(r, a, b) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        packed = [x[order] for x in (tok, key, part.astype(np.uint32), size, pos, score)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r for r, _, _ in rows], pa.int32()),
             *[pa.array([x[a:b].tobytes() for _, a, b in rows], pa.binary()) for x in packed]],
            names=["rng", "tok", "key", "part", "size", "pos", "score"])

    def scan(batches):
        held, count, seen = [], 0, set()
        for batch in batches:
            for s in _sets(batch, 0):
                if not len(s):
                    continue
                key = set_key(s)
                if int(key) in seen:  # copies inside a task
                    continue
                seen.add(int(key))
                p = prefix_length(len(s), num, den)
                lv = shared.value[0][(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = s[np.argsort(lv, kind="stable")[:p]] if lv.any() else s[:p]
                score = int(65535 * (lv == 0).mean())
                held.append((first, np.full(p, key), np.full(p, len(s), np.uint32),
                             np.minimum(np.arange(p), 65535).astype(np.uint16), np.full(p, score, np.uint16)))
                count += p
                if count >= FLUSH_ENTRIES:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)

    return docs.select("_text").mapInArrow(
        tidy(scan), "rng int, tok binary, key binary, part binary, size binary, pos binary, score binary")


def _lists(blocks, salts, ranges, num, den):
    """Rows of three kinds from the index lists.

    0: a leader and a member, with the number of lists of two sets and of longer lists in which they meet so (c, pos);
    1: the entries of lists of three sets or more, for the comparison across components;
    2: the leader of each part of a dealt list.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(salts)
    kinds = (("tok", np.uint64), ("key", np.uint64), ("part", np.uint32), ("size", np.uint32), ("pos", np.uint16), ("score", np.uint16))
    names = ["kind", "tok", "a", "b", "na", "nb", "c", "pos"]

    def one(table):
        cols = [np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in kinds]
        tok, key, part, _, _, score = cols
        order = np.lexsort((mix(key), score, part, tok))
        tok, key, part, size, pos, score = (c[order] for c in cols)
        other = np.ones(len(tok), bool)
        other[1:] = (tok[1:] != tok[:-1]) | (part[1:] != part[:-1])
        new = other.copy()
        new[1:] |= key[1:] != key[:-1]  # copies from several tasks
        tok, key, part, size, pos, score = tok[new], key[new], part[new], size[new].astype(np.int64), pos[new], score[new]
        head = other[new]
        starts = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        dealt = shared.value[(tok[starts] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] > 0
        long = (np.diff(np.append(starts, len(tok))) > 2) | dealt
        lead = starts[group]
        y = np.flatnonzero(~head)
        x = lead[y]
        fits = np.minimum(size[x], size[y]) * den >= np.maximum(size[x], size[y]) * num
        x, y = x[fits], y[fits]
        order = np.lexsort((key[y], key[x]))
        x, y = x[order], y[order]
        first = np.ones(len(x), bool)
        first[1:] = (key[x][1:] != key[x][:-1]) | (key[y][1:] != key[y][:-1])
        at = np.flatnonzero(first)
        both = np.diff(np.append(at, len(x)))
        in_long = np.add.reduceat(long[group[x]].astype(np.int64), at) if len(at) else both
        x, y = x[at], y[at]
        e, top = np.flatnonzero(long[group]), starts[dealt]
        n0, n1, n2 = len(x), len(e), len(top)
        zero = lambda k: np.zeros(k, np.int64)
        cat = lambda *v: pa.array(np.concatenate([w.view(np.int64) if w.dtype == np.uint64 else w.astype(np.int64) for w in v]))
        return pa.Table.from_arrays([
            cat(zero(n0), zero(n1) + 1, zero(n2) + 2), cat(zero(n0), tok[e], tok[top]), cat(key[x], key[e], key[top]),
            cat(key[y], zero(n1), zero(n2)), cat(size[x], size[e], size[top]), cat(size[y], zero(n1), zero(n2)),
            cat(both - in_long, zero(n1), zero(n2)), cat(in_long, pos[e], score[top])], names=names)

    return blocks.groupBy("rng").applyInArrow(one, ", ".join(f"{c} long" for c in names))


# ---- 5. verification --------------------------------------------------------

def _enough(c, na, nb, num, den, part=1):
    """Pairs of these sizes whose number c of shared indexed shingles still admits a link.

    Beyond the shared prefix at most ceil(num * larger / den) - 1 shingles can be common. With `part` only that part of
    the number is asked for.
    """
    large = F.greatest(na, nb)
    least = F.ceil((F.lit(num) * (na + nb)) / F.lit(num + den))
    return (c * part >= least - F.ceil(F.lit(num) * large / F.lit(den)) + 1) & (F.least(na, nb) * den >= large * num)


def _alike(x, y, nx, ny, num, den):
    """Pairs whose parity bits (columns xp0.., yp0..) differ in no more places than linked sets of these sizes may."""
    differ = sum(F.bit_count(F.col(f"{x}p{i}").bitwiseXOR(F.col(f"{y}p{i}"))) for i in range(PARITY))
    least = F.ceil(F.lit(num) * (F.col(nx) + F.col(ny)) / F.lit(num + den))
    return differ <= F.col(nx) + F.col(ny) - 2 * least


def _wanted(pairs, classes):
    """A fixed-size bit filter of the marks of one document per class that occurs in a pair."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    slot = F.shiftrightunsigned("mark", 64 - FILTER_BITS)
    found = (
        keys.join(classes, "key").select(slot.alias("s"))
        .groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(s & 63)))").alias("bits"))
    )
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in found.toLocalIterator():  # at most 2 ** (FILTER_BITS - 6) rows, whatever the input
        words[r["w"]] = r["bits"]
    return words.view(np.uint64)


def _fetch_sets(docs, wanted):
    """(key, packed set) of the documents that pass the filter; a few extra ones may."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def scan(batches):
        seen = set()
        for batch in batches:
            s = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            hit = (shared.value[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1)
            rows = np.flatnonzero(hit)
            if not len(rows):
                continue
            keys, packed = [], []
            for s in _sets(batch.take(pa.array(rows)), 2):
                key = set_key(s) if len(s) else None
                if key is not None and int(key) not in seen:
                    seen.add(int(key))
                    keys.append(key)
                    packed.append(s.tobytes())
                if sum(map(len, packed[-50:])) > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(packed, pa.binary())], names=["key", "elems"])
                    keys, packed = [], []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(packed, pa.binary())], names=["key", "elems"])

    return docs.mapInArrow(tidy(scan), "key long, elems binary")


def _verify(docs, pairs, classes, num, den):
    """The pairs (a, b) that link, by their whole sets."""
    sets = cut(_fetch_sets(docs, _wanted(pairs, classes)))

    def check(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            hit = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if (num + den) * common >= num * (len(x) + len(y)):
                    hit.append(i)
            yield batch.select([0, 1]).take(pa.array(hit, pa.int64()))

    joined = (
        pairs.select("a", "b")
        .join(sets.select(F.col("key").alias("b"), F.col("elems").alias("eb")), "b")
        .join(sets.select(F.col("key").alias("a"), F.col("elems").alias("ea")), "a")
        .select("a", "b", "ea", "eb")
    )
    links = cut(joined.mapInArrow(tidy(check), "a long, b long").distinct())
    drop_cut(sets)
    return links


# ---- the join ---------------------------------------------------------------

BATCH_ROWS = 500


def similar_classes(df, text="text", doc_id="doc_id", num=3, den=4):
    """(documents, links): documents (doc_id, mark, key, n) with the class of equal sets, links (a, b) between class keys.

    `mark` is a hash of id and text.

    `links` connects every pair of linked classes through links, directly or through other linked classes; every
    row of it is a verified link.
    """
    with arrow_batches(df.sparkSession, BATCH_ROWS):
        return _similar_classes(df, text, doc_id, num, den)


def _similar_classes(df, text, doc_id, num, den):
    spark = df.sparkSession
    id_type = df.schema[doc_id].dataType.simpleString()
    wide = "bigint" if id_type in ("tinyint", "smallint", "int", "bigint") else "string"
    docs = df.select(F.col(doc_id).cast(wide).alias("_id"), F.xxhash64(F.col(doc_id).cast(wide), text).alias("_mark"),
                     F.col(text).alias("_text"))
    scanned = cut(_scan_sets(docs, wide))
    documents = scanned.filter("part < 0").drop("part", "blob")
    parity = [f"p{i}" for i in range(PARITY)]
    classes = (
        documents.filter("n > 0").groupBy("key").agg(F.min(F.struct("doc_id", "mark", *parity)).alias("one"))
        .select("key", "one.mark", *[f"one.{p}" for p in parity])
    )
    total = documents.agg(F.sum("n")).first()[0] or 0
    level, salts = _levels(scanned, total)
    ranges = 1 << max(4, int(total * (1 - num / den) / (1 << 18)).bit_length())
    lists = cut(_lists(_index_blocks(docs, level, salts, ranges, num, den), salts, ranges, num, den))

    # one leader per list, and one over the parts of a dealt list
    stars = lists.filter("kind = 0").select("a", "b", "na", "nb", F.col("c").alias("c2"), F.col("pos").alias("cn"))
    leaders = lists.filter("kind = 2").select("tok", "a", "na", "pos")
    top = leaders.groupBy("tok").agg(F.min(F.struct("pos", F.xxhash64("a").alias("h"), "a", "na")).alias("top"))
    heads = leaders.join(top, "tok").filter("a <> top.a").select(
        F.col("top.a").alias("x"), F.col("a").alias("b"), F.col("top.na").alias("nx"), F.col("na").alias("nb"))
    heads = heads.select(F.col("x").alias("a"), "b", F.col("nx").alias("na"), "nb", F.lit(0).cast("long"), F.lit(1).cast("long"))
    stars = stars.union(heads)
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb", "c2", "cn")
    stars = stars.groupBy("a", "b").agg(F.sum("c2").alias("c2"), F.sum("cn").alias("cn"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    stars = cut(stars)
    sides = [classes.select(F.col("key").alias(k), *[F.col(p).alias(f"{k}{p}") for p in parity]) for k in "ab"]
    # a member may meet its leader in some of their common lists only; a third of the number is enough to look closer
    close = _enough(F.col("c2") + F.col("cn"), F.col("na"), F.col("nb"), num, den, part=3)
    pairs = stars.filter(close).join(sides[0], "a").join(sides[1], "b").filter(_alike("a", "b", "na", "nb", num, den))
    pairs = cut(pairs.select("a", "b"))
    links = _verify(docs, pairs, classes, num, den)

    # what is left, across components
    comp = components(links.select(F.lit(0).alias("g"), "a", "b"), key="g").select(F.col("node").alias("a"), "root")
    comp = cut(comp)
    entries = (
        lists.filter("kind = 1").select("tok", "a", "na", "pos")
        .join(comp, "a", "left").withColumn("root", F.coalesce("root", "a"))
    )
    open_lists = entries.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("tok")
    entries = entries.join(open_lists, "tok").join(classes.select(F.col("key").alias("a"), *parity), "a")
    left = cut(entries)
    size_block = F.floor(F.log(F.col("na").cast("double")) / float(np.log(den / num) + 1e-9))
    one = left.select("tok", F.col("a").alias("x"), F.col("na").alias("nx"), F.col("pos").alias("px"), F.col("root").alias("rx"), size_block.alias("blk"),
                      *[F.col(p).alias(f"x{p}") for p in parity])
    two = left.select("tok", F.col("a").alias("y"), F.col("na").alias("ny"), F.col("pos").alias("py"), F.col("root").alias("ry"),
                      F.explode(F.array(size_block, size_block - 1)).alias("blk"), *[F.col(p).alias(f"y{p}") for p in parity])
    ordered = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    least = F.ceil(F.lit(num) * (F.col("nx") + F.col("ny")) / F.lit(num + den))
    met = one.join(two, ["tok", "blk"]).filter(
        ordered & (F.col("rx") != F.col("ry")) & (F.col("nx") * den >= F.col("ny") * num)
        & _alike("x", "y", "nx", "ny", num, den))
    left_over = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    admits = (left_over >= least).cast("int")
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb"),
                     F.lit(1).cast("long").alias("c"), admits.alias("ok"))
    # lists of two sets were compared above; they count among the shared ones
    short = stars.filter("c2 > 0").select("a", "b", "na", "nb", F.col("c2").alias("c"), F.lit(1).alias("ok"))
    met = met.union(short).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("ok").alias("ok"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    met = met.filter((F.col("ok") == 1) & _enough(F.col("c"), F.col("na"), F.col("nb"), num, den)).select("a", "b")
    more = cut(met.join(pairs, ["a", "b"], "left_anti"))
    links = links.union(_verify(docs, more, classes, num, den))
    for t in (lists, left, stars, pairs, more, comp):
        drop_cut(t)
    return documents.select("doc_id", "mark", "key", "n"), links


def linked_documents(df, text="text", doc_id="doc_id", num=3, den=4):
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable through links)."""
    documents, links = similar_classes(df, text, doc_id, num, den)
    comp = cut(components(links.select(F.lit(0).alias("g"), "a", "b"), key="g").select(F.col("node").alias("key"), "root"))
    classes = (
        documents.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
        .join(comp, "key", "left").withColumn("root", F.coalesce("root", "key"))
    )
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "root").select("key", "component_id")
    out = documents.join(named, "key", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def drop_linked(df, text="text", doc_id="doc_id", num=3, den=4):
    """df without near copies: of each component one document stays, the one of the smallest id (then mark).

    Documents with an empty set link with nothing and all stay. Of rows equal in id and text one stays. Columns as in df.
    """
    documents, links = similar_classes(df, text, doc_id, num, den)
    comp = cut(components(links.select(F.lit(0).alias("g"), "a", "b"), key="g").select(F.col("node").alias("key"), "root"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    classes = (
        documents.filter("n > 0").groupBy("key").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("c"))
        .join(comp, "key", "left").withColumn("root", F.coalesce("root", "key"))
    )
    groups = classes.groupBy("root").agg(F.min("first").alias("first"), F.sum("c").alias("c"))
    groups = groups.filter("c > 1").select("root", F.col("first.mark").alias("stays"))
    copies = classes.join(groups, "root").select("key", "stays")
    dropped = cut(documents.join(copies, "key").filter("mark <> stays").select(F.col("mark").alias("_mark")).distinct())
    tag = uuid.uuid4().hex[:8]
    wide = "bigint" if df.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    rows = df.withColumn(f"_m_{tag}", F.xxhash64(F.col(f"`{doc_id}`").cast(wide), F.col(f"`{text}`")))
    kept = rows.join(dropped, F.col(f"_m_{tag}") == F.col("_mark"), "left_anti")
    if not documents.filter("n > 0").groupBy("mark").count().filter("count > 1").isEmpty():
        full = F.length(F.trim(F.coalesce(F.col(f"`{text}`"), F.lit("")))) > 0
        kept, alone = one_of(kept, [f"_m_{tag}"], f"_m_{tag}", F.lit(True), tag)
        kept = kept.filter(alone | ~full)
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
