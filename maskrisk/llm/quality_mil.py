"""A document quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ship

ASCII_WORD = re.compile(WORD)
#: Words of a passage.
PASSAGE = 64
#: Labelled documents that the model is fitted on, at most; each teaches with all its passages.
TRAIN_ROWS = 8000
#: Hash buckets that a passage's words are counted in, and words whose bucket a Python worker remembers.
BUCKETS, REMEMBERED = 128, 500_000
#: Score from which a document is accepted.
ACCEPT = 0.3

#: Characters counted each on its own; the rest falls in classes of letters, digits, punctuation and others.
ALONE = b"#*$%&|<>!?.,:;\"'()-_/@=+{}[]\\\n\t"


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = 0 if b == 32 else 1 if c in "aeiou" else 2 if "a" <= c <= "z" else 3 if "A" <= c <= "Z" else 4 if c.isdigit() and b < 128 else 5 if b >= 128 else 6
    for i, b in enumerate(ALONE):
        out[b] = 7 + i
    return out


CLASS = _classes()
CLASSES = int(CLASS.max()) + 1
RATIOS = 6
FEATURES = CLASSES + RATIOS + BUCKETS

_buckets: dict[str, int] = {}


def bucket(word: str) -> int:
    """The hash bucket of a word without regard to case; the same in every worker."""
    out = crc32(word.lower().encode("utf-8", "replace")) % BUCKETS
    if len(_buckets) < REMEMBERED and len(word) < 40:
        _buckets[word] = out
    return out


def passages(text: str) -> np.ndarray:
    """One row of features for each passage of the whole text: shares of kinds of characters, ratios of its words, and
    how often its words fall in each hash bucket. A text without a word has one row of zeros."""
    words = ASCII_WORD.findall(text)
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    n = -(-len(words) // PASSAGE)
    out = np.zeros((n, FEATURES), np.float32)
    parts = [words[i * PASSAGE : (i + 1) * PASSAGE] for i in range(n)]
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    passage = np.zeros(len(raw), np.int64)
    marks = starts[PASSAGE::PASSAGE][: n - 1]
    passage[marks] = 1
    passage = np.minimum(np.cumsum(passage), n - 1)
    counts = np.bincount(passage * CLASSES + CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES)
    size = np.maximum(counts.sum(axis=1), 1)
    out[:, :CLASSES] = counts / size[:, None]
    of = [b if b is not None else bucket(w) for w, b in zip(words, map(_buckets.get, words), strict=True)]
    found = np.bincount(np.arange(len(words)) // PASSAGE * BUCKETS + np.array(of), minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, CLASSES + RATIOS :] = np.sqrt(found / PASSAGE)
    for i, part in enumerate(parts):
        k = len(part)
        same = sum(map(str.__eq__, part, part[1:]))
        out[i, CLASSES : CLASSES + RATIOS] = (len(set(part)) / k, same / k, sum(map(len, part)) / k / 10, np.log1p(k) / 4, sum(map(str.isupper, part)) / k, k < 8)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(model: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> tuple:
    """Scores of the bags that start at rows ``first`` of the passages ``x``, with what the gradients need."""
    sizes = np.diff(np.append(first, len(x)))
    h = np.tanh(x @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    e = (t * g) @ model["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
    a = e / np.repeat(np.add.reduceat(e, first), sizes)
    z = np.add.reduceat(a[:, None] * h, first)
    return _sigmoid(z @ model["c"] + model["c0"]), z, a, h, t, g, sizes


class Packed:
    """Bags of passages as compressed bytes, about a fifth of their size; each is unpacked when it is looked at."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> np.ndarray:
        return np.frombuffer(decompress(self.packed[i]), np.float32).reshape(-1, FEATURES)


def fit(bags: list[np.ndarray] | Packed, labels: np.ndarray, hidden: int = 16, attention: int = 8, steps: int = 500, batch: int = 256, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights learned by Adam from document labels alone: passages carry no labels, attention finds those that tell.

    Features are scaled by their mean and spread over documents, so that a very long one counts as any other.
    """
    rng = np.random.default_rng(seed)
    n, d = len(bags), bags[0].shape[1]
    mean = sum(bags[i].mean(axis=0, dtype=np.float64) for i in range(n)) / n
    sd = np.sqrt(sum(((bags[i] - mean) ** 2).mean(axis=0) for i in range(n)) / n) + 1e-3
    p = {"W": rng.normal(0, d**-0.5, (d, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, attention)), "U": rng.normal(0, 0.3, (hidden, attention)), "w": rng.normal(0, 0.3, attention), "c": rng.normal(0, 0.3, hidden), "c0": np.zeros(1)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.choice(n, min(batch, n), replace=False)
        some = [bags[i] for i in pick]
        x, y = ((np.concatenate(some) - mean) / sd).clip(-8, 8), labels[pick]
        first = np.concatenate(([0], np.cumsum(list(map(len, some)))[:-1]))
        score, z, a, h, t, g, sizes = forward(p, x, first)
        dl = (score - y) / len(pick)
        dz = np.repeat(dl[:, None] * p["c"], sizes, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), sizes))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        grad = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dl, "c0": dl.sum(keepdims=True)}
        for k in p:
            q = grad[k] + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.999 * v[k] + 0.001 * q * q
            p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | {"mean": mean, "sd": sd}


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves no rest by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """The model of at most ``rows`` labelled documents that are not held out, the first by a hash of the id, with all
    their passages. The driver holds those compressed, about a third of the texts' own bytes.

    Ids with no label, a null label or no document teach nothing; of several labels of an id the largest counts.
    Without any label, or with one kind only, the model is that constant (0.5 without any).
    """
    known = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = ship(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # ``rows`` rows of two numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [compress(passages(x.as_py() or "").tobytes(), 1) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "y", "x"])

    read = found.select(F.col("doc_id").cast("long"), "y", F.col("text").cast("string")).mapInArrow(run, "doc_id long, y double, x binary")
    got = read.orderBy("doc_id", "x").limit(rows).collect()  # ``rows`` rows at most, also where ids repeat
    y = np.array([r.y for r in got])
    if len(set(y.tolist())) < 2:
        return {"constant": float(y[0]) if len(y) else 0.5}
    return fit(Packed([bytes(r.x) for r in got]), y)


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    bags = [passages(x) for x in texts]
    first = np.concatenate(([0], np.cumsum([len(x) for x in bags])[:-1]))
    x = ((np.concatenate(bags) - model["mean"]) / model["sd"]).clip(-8, 8)
    return forward(model, x, first)[0]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for every row: 0 to 1, higher where label 1 is likelier; null and empty texts are scored too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts([x or "" for x in part.column(1).to_pylist()], model), pa.float64())], ["doc_id", "score"])

    return ship(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); no other column is read."""
    scored = score(docs, train(docs, labels, rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score is at least the accepting one, with all their columns."""
    model = train(docs, labels, rows)
    schema, names = docs.schema, docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                keep = score_texts([x or "" for x in part.column(at).to_pylist()], model) >= ACCEPT
                yield part.filter(pa.array(keep))

    return ship(docs).mapInArrow(run, schema)
