"""Quality by compression: dictionaries of good and of bad text, and the difference they make.

Two pairs of zstandard dictionaries are built from labelled texts, one pair from the bytes and one from the shape
of the bytes (letters, capitals and digits each written as one sign), so that layout counts apart from words. A
text is compressed with either dictionary of a pair; the difference of the two sizes over its size without a
dictionary, with the plain compression ratios and the length, is turned into a probability by a logistic curve
fitted on labelled texts that no dictionary has seen.

The fit uses at most `per_class` labelled texts of each class (the only bound here), weighted by the true class
counts. Every whole text is scored; labels and other columns play no part in a score.

Defined cases: null and empty texts get the probability of an empty text under the curve, moved to the share of
good labels if nothing could be learned. With labels of one class only, or none, every score is the share of good
labels (0.5 without any).
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard

from ramify.llm.common import kept, logistic, map_texts, sigmoid

PER_CLASS = 1500
DICT_BYTES = 65_536


def _shape_table():
    t = bytearray(range(256))
    for b in range(256):
        ch = chr(b)
        if "a" <= ch <= "z" or b >= 128:
            t[b] = ord("a")
        elif "A" <= ch <= "Z":
            t[b] = ord("A")
        elif "0" <= ch <= "9":
            t[b] = ord("0")
    return bytes(t)


SHAPE = _shape_table()


def _dictionary(texts, size):
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its end serves as it is
        return b"".join(texts)[-size:]


class _Sizes:
    """Compressors of one model, opened once per Python worker."""

    def __init__(self, dicts):
        def opened(data):
            d = {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}
            return zstandard.ZstdCompressor(level=3, write_checksum=False, write_dict_id=False,
                                            write_content_size=False, **d)
        self.sets = [(opened(good), opened(bad), opened(None)) for good, bad in dicts]

    def features(self, raw):
        n = max(1, len(raw))
        out = []
        for (good, bad, plain), data in zip(self.sets, (raw, raw.translate(SHAPE)), strict=True):
            own = max(1, len(plain.compress(data)))
            out += [(len(bad.compress(data)) - len(good.compress(data))) / own, np.log(own / n)]
        return [*out, np.log(n)]


def fit(sample, sizes, dict_bytes=DICT_BYTES):
    """Model from (text, label) pairs, label 1 good; `sizes` are the label counts they stand for."""
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    by = {c: [t.encode() for t, y in sample if y == c] for c in (0, 1)}
    if min(len(by[0]), len(by[1])) < 8:
        return {"prior": prior}
    third = {c: max(4, len(by[c]) // 3) for c in by}
    seen = {c: by[c][:third[c]] for c in by}
    dicts = [(_dictionary(seen[1], dict_bytes), _dictionary(seen[0], dict_bytes)),
             (_dictionary([t.translate(SHAPE) for t in seen[1]], dict_bytes // 4),
              _dictionary([t.translate(SHAPE) for t in seen[0]], dict_bytes // 4))]
    known = set(seen[0]) | set(seen[1])
    rest = [(t, c) for c in by for t in by[c][third[c]:] if t not in known]
    if len({c for _, c in rest}) < 2:
        return {"prior": prior}
    comp = _Sizes(dicts)
    x = np.array([comp.features(t) for t, _ in rest])
    y = np.array([c for _, c in rest], float)
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    mean, sd = x.mean(0), x.std(0) + 1e-6
    return {"prior": prior, "dicts": dicts, "key": hashlib.sha256(b"".join(b"".join(d) for d in dicts)).digest(), "mean": mean, "sd": sd, "w": logistic(_terms(x, mean, sd), y, weight)}


def _terms(x, mean, sd):
    z = np.clip((x - mean) / sd, -6, 6)
    return np.c_[np.ones(len(z)), z, z * z]


def scores(texts, model):
    """Probability of label 1 for every text (None: empty)."""
    if "w" not in model:
        return np.full(len(texts), model["prior"])
    sizes = kept("compressors", model["key"], lambda: _Sizes(model["dicts"]))
    x = np.array([sizes.features((t or "").encode()) for t in texts]).reshape(len(texts), -1)
    return sigmoid(_terms(x, model["mean"], model["sd"]) @ model["w"])


def score_texts(df, model, text="text", keep=("doc_id",)):
    """The columns `keep` of df with `score`."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # four dictionaries of fixed size
    fields = [df.schema[c] for c in keep]
    cols = [*keep, "score"]

    def part(batch):
        p = scores(batch.column(batch.num_columns - 1).to_pylist(), shared.value)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], names=cols)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"])
    return map_texts(df.select(*[f"`{c}`" for c in keep], df[text].alias("_text")), part, schema)


def keep_good(df, model, text="text", threshold=0.5):
    """df's rows whose text scores `threshold` or more; columns as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # four dictionaries of fixed size
    at = df.columns.index(text)

    def part(batch):
        return batch.filter(pa.array(scores(batch.column(at).to_pylist(), shared.value) >= threshold))

    return map_texts(df, part, df.schema)
