"""Benchmark decontamination: seeds of word pairs, then Smith-Waterman alignment.

Words are lower-cased runs of ASCII letters and digits and non-ASCII signs, so punctuation and capitals never hide a copy.
1. Seeds are pairs of an item's words, neighbours or with one word between, that a document holds as neighbours or with
   one word between. Neighbours in both weigh 2, others 1. Between two matched words of an alignment that are no seed lie
   at least two edits, between those of weight 1 one edit. So with match 2, mismatch and gap -1, an alignment of score
   `threshold` of a perfect one has seeds of weight 2 * threshold * words - 2 at least, whichever words are edited.
2. Such an alignment covers at most 3 - 2 * threshold times the item's words. Windows of twice that, each half over the
   next, whose seeds weigh enough are aligned with the item; no other can reach the threshold. The score is the best
   local alignment over a perfect one; pairs at `threshold` or more are contaminated. Reordered or edited words lower the
   score, they do not end the match.

Test items are the stated query set and are taken in blocks of bounded size, each a pass over all documents; a block's
pairs are what is broadcast. Documents are never shuffled.

Defined cases: null and empty documents match nothing. Items that are null or shorter than n words match nothing, as
they cannot be told from common phrases. Equal items, equal ids and repeated rows each give their own rows. An empty
table on either side gives no pairs. Other columns are ignored, or carried along by `drop_contaminated`.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ramify.llm.common import _STEP, lowered_wide, mix, row_groups, text_buffer, tidy, words

N = 3
THRESHOLD = 0.5
BLOCK_GRAMS = 1 << 20
_TABLE_BITS = 20

_WORD = np.full(256, 0x20, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _WORD[_b] = _b


def _words(column):
    """Per block of rows: first row, word starts, ends, hashes, first word of each row, row byte offsets."""
    raw, offsets = text_buffer(column)
    for a, b in row_groups(offsets):
        o = offsets[a:b + 1]
        start, end, h, first = words(_WORD[lowered_wide(raw[o[0]:o[-1]])], o - o[0])
        yield a, start, end, h, first, o - o[0]


def item_blocks(items, item_id="item_id", text="text", n=N, block_grams=BLOCK_GRAMS):
    """Test items as blocks of word hashes: (ids, list of hash arrays)."""
    ids, hashes, held = [], [], 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        _, _, _, h, _, _ = next(_words(pa.array([row["t"] or ""])), (0,) * 6)
        if np.ndim(h) == 0 or len(h) < n:
            continue
        ids.append(row["i"])
        hashes.append(h)
        held += len(h)
        if held >= block_grams:
            yield ids, hashes
            ids, hashes, held = [], [], 0
    if ids:
        yield ids, hashes


class _Lookup:
    """Sorted n-gram hashes behind a bit table."""

    def __init__(self, grams):
        self.grams = grams
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def find(self, g):
        """Positions in g that hold a known n-gram, and its index."""
        maybe = np.flatnonzero(self.table[(g >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        at = np.searchsorted(self.grams, g[maybe])
        hit = (at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == g[maybe])
        return maybe[hit], at[hit]


def _pairs(h, gap):
    """Hash of every word with the word `gap` later."""
    x, y = h[:max(0, len(h) - gap)], h[gap:]
    return mix(x * _STEP[0] + (y ^ (y >> np.uint64(29))) * _STEP[1])


def align(item, window, match=2, miss=-1, gap=-1):
    """Best local alignment of two hash arrays: its score, and first and last window word (inclusive)."""
    def table(a, b):
        steps = -gap * np.arange(len(b) + 1)
        prev, best, where = np.zeros(len(b) + 1, np.int64), 0, (0, 0)
        for i, x in enumerate(a):
            cur = np.zeros(len(b) + 1, np.int64)
            cur[1:] = np.maximum(prev[:-1] + np.where(b == x, match, miss), prev[1:] + gap)
            cur = np.maximum(np.maximum.accumulate(np.maximum(cur, 0) + steps) - steps, 0)
            j = int(cur.argmax())
            if cur[j] > best:
                best, where = int(cur[j]), (i, j)
            prev = cur
        return best, where
    best, (i, j) = table(item, window)
    if best == 0:
        return 0, 0, -1
    _, (_, back) = table(item[:i + 1][::-1], window[:j][::-1])
    return best, j - back, j - 1


def plan(ids, hashes):
    """What a task needs to find one block's items: seeds, their places in items, and the items."""
    parts = [(k, gap, _pairs(h, gap)) for k, h in enumerate(hashes) for gap in (1, 2)]
    gram = np.concatenate([g for _, _, g in parts])
    item = np.concatenate([np.full(len(g), k) for k, _, g in parts])
    gaps = np.concatenate([np.full(len(g), gap) for _, gap, g in parts])
    place = np.concatenate([np.arange(len(g)) for _, _, g in parts])
    order = np.argsort(gram, kind="stable")
    seeds, start = np.unique(gram[order], return_index=True)
    return {"seeds": seeds, "start": np.append(start, len(gram)), "item": item[order], "gap": gaps[order], "place": place[order],
            "ids": ids, "hashes": hashes, "size": np.array([len(h) for h in hashes])}


def _seeds_of(h, row, p, look):
    """Seeds of a block of rows: row, item, place in the item, word, weight."""
    found = []
    for gap in (1, 2):
        at, which = look.find(_pairs(h, gap))
        same = row[at] == row[at + gap]
        at, which = at[same], which[same]
        reach = p["start"][which + 1] - p["start"][which]
        hit = np.repeat(at, reach)
        entry = np.arange(len(hit)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(p["start"][which], reach)
        weight = np.where((p["gap"][entry] == 1) & (gap == 1), 2, 1)
        found.append((row[hit], p["item"][entry], p["place"][entry], hit, weight))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _heavy(cell, place, weight, least):
    """Cells whose seeds, the heaviest at every place of the item, weigh `least` or more, by the index of one seed each."""
    order = np.lexsort((-weight, place, cell))
    cell, place, weight = cell[order], place[order], weight[order]
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]
    best = new.copy()
    best[1:] |= place[1:] != place[:-1]
    heads = np.flatnonzero(new)
    total = np.add.reduceat(weight * best, heads) if len(heads) else heads
    return order[heads[total >= least[order[heads]]]]


def matches(column, p, threshold=THRESHOLD):
    """Contaminations of a text column: rows, item numbers, scores and byte spans."""
    look = _Lookup(p["seeds"])
    span = np.ceil((3 - 2 * min(threshold, 1)) * p["size"]).astype(np.int64)
    need = np.maximum(1, np.ceil(2 * threshold * p["size"] - 2 - 1e-9)).astype(np.int64)
    for base, start, end, h, first, offsets in _words(column):
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        rows, items, place, at, weight = _seeds_of(h, row, p, look)
        # first over whole rows, without regard to places
        _, back = np.unique(rows * len(need) + items, return_inverse=True)
        able = np.bincount(back, weight, minlength=1)[back] >= need[items] if len(rows) else np.zeros(0, bool)
        rows, items, place, at, weight = (v[able] for v in (rows, items, place, at, weight))
        tile = (at - first[rows]) // span[items]
        rows, items, place, weight = (np.tile(v, 2) for v in (rows, items, place, weight))
        tile = np.concatenate([tile, tile - 1])
        tiles = len(h) + 2
        one = _heavy((rows * len(need) + items) * tiles + tile + 1, place, weight, need[items])
        best = {}
        for r, k, t in zip(rows[one].tolist(), items[one].tolist(), tile[one].tolist(), strict=True):
            item, lo = p["hashes"][k], int(first[r]) + max(0, t * int(span[k]))
            hi = min(int(first[r + 1]), int(first[r]) + (t + 2) * int(span[k]) + 2)
            score, x, y = align(item, h[lo:hi])
            score /= 2 * len(item)
            if score >= threshold and score > best.get((r, k), (0,))[0]:
                best[r, k] = (score, int(start[lo + x] - offsets[r]), int(end[lo + y] - offsets[r]))
        for (r, k), (score, x, y) in best.items():
            yield base + r, k, score, x, y


def contaminations(docs, items, text="text", doc_id="doc_id", item_id="item_id", n=N, threshold=THRESHOLD):
    """One row per contaminated pair: doc_id, item_id, score, and its span in the document (UTF-8 bytes)."""
    sc, out = docs.sparkSession.sparkContext, None
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    types = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {types[0]}, item_id {types[1]}, score double, span_start long, span_end long"
    for ids, hashes in item_blocks(items, item_id, "text", n):
        shared = sc.broadcast(plan(ids, hashes))  # one block of items

        def find(batches, shared=shared):
            for batch in batches:
                found = list(matches(batch.column(1), shared.value, threshold))
                if found:
                    r, k, score, x, y = (list(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(r)), pa.array([shared.value["ids"][i] for i in k]),
                         pa.array(score), pa.array(x, pa.int64()), pa.array(y, pa.int64())],
                        names=["doc_id", "item_id", "score", "span_start", "span_end"])

        part = rows.mapInArrow(tidy(find), schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs, items, text="text", item_id="item_id", n=N, threshold=THRESHOLD):
    """docs without the rows that hold a copy of a test item; columns as they are."""
    sc, out = docs.sparkSession.sparkContext, docs
    at = docs.columns.index(text)
    for ids, hashes in item_blocks(items, item_id, "text", n):
        shared = sc.broadcast(plan(ids, hashes))  # one block of items

        def keep(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for r, *_ in matches(batch.column(at), shared.value, threshold):
                    clean[r] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(tidy(keep), docs.schema)
    return out
