"""Toxicity by multiple-instance learning: labels of documents teach scores of sentences.

A sentence has the probability sigmoid(bias + sum of the weights of its words and word beginnings), and a document 1 - product(1 - sentence)
(noisy-or): toxic as soon as one sentence is. Only documents are labelled, so bias and weights are fitted to the
document likelihood by gradient steps, with a pull of the weights to zero; the sentences then show where a document offends.

The fit uses at most `per_class` labelled texts of each class (the only bound here), weighted by the true class
counts. Every whole text is scored; labels and other columns play no part in a score.

Defined cases: null and empty texts, and texts without words, have no sentence and score 0. With labels of one
class only, or none, nothing is learned and every score is 0. Words are runs of letters, digits and non-ASCII bytes;
a sentence ends at . ! ? or a line end.
"""

import numpy as np
import pyarrow as pa

from ramify.llm.common import lowered_wide, map_texts, prefixes, row_groups, sigmoid, text_buffer, words

PER_CLASS = 2000
SLOTS = 1 << 18
PREFIXES = (5, 6, 7)

_WORD = np.full(256, 0x20, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _WORD[_b] = _b
_BREAK = np.zeros(256, bool)
_BREAK[[ord("."), ord("!"), ord("?"), ord("\n")]] = True


def sentences(raw, offsets):
    """Features and their sentences, the row of every sentence, and each sentence's byte span.

    A word gives itself and its first 5, 6 and 7 bytes, each as a slot number.
    """
    low = _WORD[lowered_wide(raw)]
    start, end, h, first = words(low, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    after = np.cumsum(_BREAK[raw], dtype=np.int64)
    group = after[start] if len(start) else np.zeros(0, np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (group[1:] != group[:-1]) | (row[1:] != row[:-1])
    sent = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(start)) - 1 if len(heads) else heads
    slots, owners = [h >> np.uint64(46)], [sent]
    for length in PREFIXES:
        longer, part = prefixes(low, start, end, length)
        slots.append(part >> np.uint64(46))
        owners.append(sent[longer])
    return np.concatenate(slots).astype(np.int64), np.concatenate(owners), row[heads], start[heads], end[tails]


def _telling(pairs, y, least, z_least):
    """Slots whose documents are toxic more often than others by at least `z_least` standard errors."""
    slot, doc = pairs % SLOTS, pairs // SLOTS
    n1, n0 = y.sum(), (1 - y).sum()
    in1 = np.bincount(slot, y[doc], SLOTS)
    in0 = np.bincount(slot, 1 - y[doc], SLOTS)
    p1, p0 = (in1 + 0.5) / (n1 + 1), (in0 + 0.5) / (n0 + 1)
    z = (p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    return np.flatnonzero((in1 + in0 >= least) & (z >= z_least))


def fit(sample, sizes, steps=400, rate=0.1, ridge=1e-5, least=4, z_least=4.0):
    """Weights from (text, label) pairs, label 1 toxic.

    Features weigh something only if their documents are toxic significantly more often than other documents.
    """
    y = np.array([c for _, c in sample], float)
    if len(y) == 0 or y.min() == y.max():
        return None
    raw, offsets = text_buffer(pa.array([t for t, _ in sample], pa.string()))
    slot, sent, doc, _, _ = sentences(raw, offsets)
    used = _telling(np.unique(doc[sent] * SLOTS + slot), y, least, z_least)
    index = np.full(SLOTS, -1)
    index[used] = np.arange(len(used))
    f = index[slot]
    sent, f = sent[f >= 0], f[f >= 0]
    n_sent, n_doc = len(doc), len(y)
    share = sizes.get(1, 0) / max(1, sizes.get(0, 0) + sizes.get(1, 0))
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (n_doc - y.sum()))
    theta = np.zeros(len(used) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(sent, theta[f], n_sent)
        clean = np.minimum(-np.bincount(doc, np.logaddexp(0, z), n_doc), -1e-12)  # log of P(no sentence is toxic)
        slope = np.where(y == 1, np.exp(clean) / np.expm1(clean), 1.0) * weight
        g_z = sigmoid(z) * slope[doc]
        grad = np.append(np.bincount(f, g_z[sent], len(used)) + ridge * theta[:-1], g_z.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-10)
    weights = np.zeros(SLOTS, np.float32)
    weights[used] = theta[:-1]
    return {"bias": float(theta[-1]), "weights": weights}


def sentence_logits(raw, offsets, model):
    """Logit of every sentence with its row and byte span."""
    slot, sent, row, start, end = sentences(raw, offsets)
    heavy = np.flatnonzero(model["weights"][slot])
    return model["bias"] + np.bincount(sent[heavy], model["weights"][slot[heavy]], len(row)), row, start, end


def score_column(column, model):
    """Document scores, and for each document its worst sentence's score and byte span (-1 without one)."""
    raw, offsets = text_buffer(column)
    n = len(offsets) - 1
    score, worst = np.zeros(n), np.zeros(n)
    span = np.full((n, 2), -1, np.int64)
    if model is None:
        return score, worst, span
    for a, b in row_groups(offsets):
        o = offsets[a:b + 1]
        z, row, start, end = sentence_logits(raw[o[0]:o[-1]], o - o[0], model)
        score[a:b] = -np.expm1(-np.bincount(row, np.logaddexp(0, z), b - a))
        order = np.lexsort((-start, z, row))
        last = np.ones(len(order), bool)
        last[:-1] = row[order][1:] != row[order][:-1]
        top = order[last]
        worst[a + row[top]] = sigmoid(z[top])
        base = o[:-1][row[top]] - o[0]
        span[a + row[top], 0], span[a + row[top], 1] = start[top] - base, end[top] - base
    return np.clip(score, 0, 1), worst, span


def score_texts(df, model, text="text", keep=("doc_id",)):
    """The columns `keep` of df with `score`, `worst_score`, `worst_start`, `worst_end` (UTF-8 bytes)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # one weight per slot
    fields = [df.schema[c] for c in keep]
    names = [*keep, "score", "worst_score", "worst_start", "worst_end"]

    def part(batch):
        score, worst, span = score_column(batch.column(batch.num_columns - 1), shared.value)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(score), pa.array(worst), pa.array(span[:, 0]), pa.array(span[:, 1])], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields),
                        "score double, worst_score double, worst_start long, worst_end long"])
    return map_texts(df.select(*[f"`{c}`" for c in keep], df[text].alias("_text")), part, schema)
