"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE_WORDS`` words. A passage goes in as the hashed counts
of its words and word pairs, ``BUCKETS`` each, and as shares and ratios of its characters and
words. A learned layer encodes it; its weights on the hashed counts are an embedding of words
and pairs. Gated attention weighs the encodings (a tanh and a sigmoid branch, multiplied), and
the weighted sum is scored. Encoder, attention and scorer are learned together from document
labels.

The model is fitted on the driver from at most ``FIT_ROWS`` labelled documents, those of the
smallest hashes of doc_id, and at most ``FIT_PASSAGES`` passages of each, evenly spread over
the text: both bounds are parameters of ``learn``. Everything else covers all rows and whole
texts. Scoring is one pass without a shuffle, many bags at once; a very long text is a bag of
many passages, some 600 bytes each. Labels, lang, source and doc_id are never inputs of a score.

Null and empty texts are one passage without words. With no labelled rows, or with one class
only, every score is that class's share (a half without rows). Rows repeated in the labels
count once, with the lower label. Repeated documents are scored alike; no documents give no
scores. Extra columns are carried along; columns named score or predicted are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import guarded, per_text, read, text_or_empty

PASSAGE_WORDS = 80
#: Labelled documents that the model is fitted on at most, and passages of each.
FIT_ROWS, FIT_PASSAGES = 3_000, 16
ENCODED, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 12, 8, 40, 200, 0.01, 1e-3
#: Hash buckets of words, and of pairs of words.
BUCKETS = 64
CACHED_WORDS = 100_000

_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_STOPS = b".,;:?'\"()-"
_ODD = bytes(b for b in _MARKS if b not in _STOPS)
RATIOS = 8
FEATURES = RATIOS + 2 * BUCKETS
#: Odd multiplier that mixes the hash of a word with that of the next.
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def ratios(part: list[bytes]) -> tuple:
    n, joined = len(part), b"".join(part)
    size = len(joined)
    again = sum(map(bytes.__eq__, part[1:], part)) if n > 1 else 0
    return (
        size / n / 10,
        len(set(part)) / n,
        again / n,
        (size - len(joined.translate(None, _UPPER))) / size,
        (size - len(joined.translate(None, _STOPS))) / size,
        (size - len(joined.translate(None, _ODD))) / size,
        (size - len(joined.translate(None, _DIGITS))) / size,
        n / PASSAGE_WORDS,
    )


def passages(text: str, known: WordHashes, most: int | None = None) -> np.ndarray:
    """A row of features for each passage, or for ``most`` of them, evenly spread; one row of
    zeros where there is no word. Pairs do not reach over the end of a passage."""
    words = text.encode().split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    n = -(-len(words) // PASSAGE_WORDS)
    chosen = range(n) if most is None or n <= most else (np.arange(most) * n // most).tolist()
    parts = [words[i * PASSAGE_WORDS : (i + 1) * PASSAGE_WORDS] for i in chosen]
    sizes = np.array([len(part) for part in parts])
    of = np.repeat(np.arange(len(parts)), sizes)
    h = np.fromiter((known[word] for part in parts for word in part), np.uint64, len(of))
    pair = (h[:-1] * MIX + h[1:]) * MIX >> np.uint64(32)
    inside = of[:-1] == of[1:]
    slot = np.r_[of * 2 * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), (of[:-1] * 2 * BUCKETS + BUCKETS + (pair % np.uint64(BUCKETS)).astype(np.int64))[inside]]
    counts = np.bincount(slot, minlength=len(parts) * 2 * BUCKETS).reshape(len(parts), 2 * BUCKETS)
    out = np.empty((len(parts), FEATURES), np.float32)
    out[:, :RATIOS] = [ratios(part) for part in parts]
    out[:, RATIOS:] = np.sqrt(counts / sizes[:, None])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Standardised features, encoder, gated attention and scorer."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, spread: np.ndarray, share: float | None = None):
        self.w, self.mean, self.spread, self.share = weights, mean, spread, share

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        sizes = np.diff(np.r_[starts, len(x)])
        of = np.repeat(np.arange(len(starts)), sizes)
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"] + w["v"]), _sigmoid(h @ w["U"] + w["u"])
        e = (t * g) @ w["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[of])
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        return {"x": x, "of": of, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.share is not None or not bags:
            return np.full(len(bags), self.share or 0.0)
        starts = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]]
        return self.forward(np.concatenate(bags), starts)["p"]

    def gradient(self, f: dict[str, np.ndarray], starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """That of the mean cross-entropy of the bags that ``f`` is the forward pass of."""
        w, of, h, t, g, a = self.w, f["of"], f["h"], f["t"], f["g"], f["a"]
        ds = (f["p"] - labels) / len(labels)
        dz = ds[:, None] * w["c"]
        da = (h * dz[of]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[of])
        dt, dg = np.outer(de, w["a"]) * g * (1 - t * t), np.outer(de, w["a"]) * t * g * (1 - g)
        dh = (a[:, None] * dz[of] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "v": dt.sum(axis=0), "U": h.T @ dg, "u": dg.sum(axis=0), "a": (t * g).T @ de, "c": f["z"].T @ ds, "d": np.array([ds.sum()])}


def fitted(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model after ``EPOCHS`` passes over the bags in batches, with Adam's steps."""
    if not len(labels) or labels.min() == labels.max():
        zero = np.zeros(FEATURES)
        return Model({}, zero, zero + 1, float(labels[0]) if len(labels) else 0.5)
    every = np.concatenate(bags)
    rng = np.random.default_rng(0)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"W": draw(FEATURES, ENCODED), "b": np.zeros(ENCODED), "V": draw(ENCODED, ATTENTION), "v": np.zeros(ATTENTION), "U": draw(ENCODED, ATTENTION), "u": np.zeros(ATTENTION), "a": draw(ATTENTION), "c": draw(ENCODED), "d": np.zeros(1)}
    # the hashed counts are many and weak beside the ratios, so they begin at nought
    w["W"][RATIOS:] = 0
    model = Model(w, every.mean(axis=0, dtype=np.float64), every.std(axis=0, dtype=np.float64) + 0.01)
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(len(bags))
        for i in range(0, len(bags), BATCH):
            some = [bags[j] for j in mixed[i : i + BATCH]]
            starts = np.r_[0, np.cumsum([len(b) for b in some])[:-1]]
            grad = model.gradient(model.forward(np.concatenate(some), starts), starts, labels[mixed[i : i + BATCH]])
            step += 1
            for k, v in grad.items():
                v = v + DECAY * w[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out():
    """The rows that no label is learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS, fit_passages: int = FIT_PASSAGES) -> Model:
    """The model fitted on the bounded sample of ``labels`` (doc_id, quality)."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", text_or_empty(text).alias("_text")).join(F.broadcast(sample), "doc_id")  # fit_rows rows at most

    def make():
        hashes = WordHashes()
        return lambda value: (passages(value, hashes, fit_passages).tobytes(),)

    made = per_text(rows.dropDuplicates(["doc_id", "_text"]), "_text", make, [("bag", pa.binary())], "bag binary")
    bags = made.orderBy(F.xxhash64("doc_id"), "doc_id", "bag").limit(fit_rows).collect()  # rows of one doc_id may be many
    return fitted([np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in bags], np.array([r.quality for r in bags], np.float64))


def scored(docs: DataFrame, model: Model, text: str = "text", carry_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``; without
    ``carry_text`` the text itself is left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own, back = guarded(docs, ["score", "predicted", *([] if carry_text else [text])])

    def make():
        model, hashes = shared.value, WordHashes()
        return lambda texts: [(float(p),) for p in model.scores([passages(value, hashes) for value in texts])]

    rows = per_text(docs.select(*own, text_or_empty(text).alias("_text")), "_text", make, [("score", pa.float64())], "score double", together=True, step_chars=500_000)
    return rows.select(*back, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, read(spark, sf_dir, "labels"))
    rows = scored(docs, model, carry_text=False)
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
