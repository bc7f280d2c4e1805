"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of the text's characters (code points, in lower
case), each present or absent. Over labelled texts, a feature's ratio is the log of
its smoothed document rate among label 1 over that among label 0. A logistic
regression is trained on the features times their ratios; its weights times
the ratios are one fixed-size table, by which every text is scored. Scale and intercept
are last set by a logistic fit of the label on the score.

The fit uses at most ``SAMPLE`` labelled texts of each label, those of least
hash of doc_id among the texts of up to ``LONGEST`` characters, which bounds what
comes to the driver; labels are weighted to their rate over all training labels.
Labels with null doc_id or toxic, and labels without a document, count for
nothing; of several labels of one document the largest counts, of several rows
of a document each is a text. Null and empty texts have no features: their score
is the intercept's. Every row is scored, whole, also if its doc_id is repeated or
null; a row without a doc_id counts as held out. Other columns are not looked
at (``clean`` keeps them). Without labelled texts of both kinds, every score is the
rate of label 1 (0 if there are no labels).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import chunks, plain, release, stored

#: Labelled texts of each label that the fit uses at most.
SAMPLE = 1000
#: Characters of a text that the fit may use.
LONGEST = 1 << 20
ORDERS = (3, 4, 5)
BITS = 18
SMOOTH = 1.0
#: Documents that must hold a feature for it to count.
LEAST_DOCS = 3
PENALTY = 2e-4
ROUNDS = 40
#: Features that the fit works on at a time, or one document's (at most 2 ** BITS).
BLOCK = 1 << 18


def folds(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


class Features:
    """Hashed n-grams that are present in a text."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        h, parts = np.zeros(len(raw), np.uint32), []
        for n in range(1, max(ORDERS) + 1):
            if len(raw) < n:
                break
            h = h[: len(raw) - n + 1] * np.uint32(0x01000193) + raw[n - 1 :] + np.uint32(n)
            if n in ORDERS:
                g = h ^ (h >> np.uint32(15))
                g = g * np.uint32(0x2C1B3C6D)
                parts.append(g >> np.uint32(32 - BITS))
        if not parts:
            return np.zeros(0, np.uint32)
        found = np.concatenate(parts)
        place = np.arange(len(found), dtype=np.int32)
        self.seen[found] = place
        return found[self.seen[found] == place]


def _kept(held: bytearray, lengths: np.ndarray, good: np.ndarray) -> tuple[bytearray, np.ndarray]:
    """Features (of four bytes) of documents of ``lengths``, moved up in place over those that aren't good."""
    at = to = 0
    lengths = lengths.copy()
    for i, n in enumerate(lengths.tolist()):
        found = np.frombuffer(held, np.uint32, n, at)
        found, at = found[good[found]].tobytes(), at + 4 * n
        held[to : to + len(found)] = found
        to, lengths[i] = to + len(found), len(found) // 4
    del held[to:]
    return held, lengths


def fit(texts: list[str], labels: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
    """Weights of the features and the intercept."""
    logit = lambda p: float(np.log(p / (1 - p)))
    size = 1 << BITS
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        return np.zeros(size, np.float32), logit(min(max(rate, 1e-6), 1 - 1e-6))
    # the driver holds four bytes a feature, and what a block of documents takes beside it
    features, held, lengths = Features(), bytearray(), np.zeros(len(texts), np.int64)
    in1, in0 = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for i, text in enumerate(texts):
        found = features(text)
        (in1 if labels[i] == 1 else in0)[found] += 1
        held += found.data
        lengths[i] = len(found)
    ratio = np.log((in1 + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((in0 + SMOOTH) / (n0 + 2 * SMOOTH))
    ratio[in1 + in0 < LEAST_DOCS] = 0
    held, lengths = _kept(held, lengths, ratio != 0)
    col, scales = np.frombuffer(held, np.uint32), ratio.astype(np.float32)
    ends = np.concatenate([[0], np.cumsum(lengths)])

    def blocks():
        """Of each block: its documents, and the document (from 0), column and scale of its features."""
        at = 0
        while at < len(lengths):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
            cols = col[ends[at] : ends[to]].astype(np.int64)
            yield slice(at, to), np.repeat(np.arange(to - at), lengths[at:to]), cols, scales[cols]
            at = to

    def summed(w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(doc, scale * w[cols], rows.stop - rows.start) for rows, doc, cols, scale in blocks()])

    weight = np.ones(len(labels)) * np.where(labels == 1, 0.5 / n1, 0.5 / n0)
    # accelerated gradient descent; the step follows the largest squared norm of a row
    norm = summed(scales) + 1
    step = 4.0 / float(np.sum(norm * weight))
    w, b, last_w, last_b = np.zeros(size), 0.0, np.zeros(size), 0.0
    for k in range(ROUNDS):
        pull = k / (k + 3)
        at, at_b = w + pull * (w - last_w), b + pull * (b - last_b)
        at32, slope, slope_b = at.astype(np.float32), np.zeros(size), []
        for rows, doc, cols, scale in blocks():
            z = np.bincount(doc, scale * at32[cols], rows.stop - rows.start) + at_b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) * weight[rows]
            np.add.at(slope, cols, (scale * error.astype(np.float32)[doc]).astype(np.float64))
            slope_b.append(error)
        last_w, last_b = w, b
        w = at - step * (slope + PENALTY * at)
        b = at_b - step * np.concatenate(slope_b).sum()
    # the scale and intercept at which the scores are probabilities, with the labels at their rate
    z = summed(w.astype(np.float32))
    share = np.where(labels == 1, rate / n1, (1 - rate) / n0) * len(labels)
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, b
    x = np.stack([z, np.ones(len(z))], 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (share * (p - target)))
        a, c = np.array([a, c]) - move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
    return (a * w * ratio).astype(np.float32), float(c)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fits on ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks.

    The sample's ids are at most 2 * ``sample`` rows, which bounds what is broadcast."""
    sizes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("size"))
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).join(sizes, "doc_id")
    marked = stored(marked, "marked")
    count = marked.agg(F.count("*").alias("n"), F.sum("toxic").alias("ones")).first()
    rate = (count["ones"] or 0) / count["n"] if count["n"] else 0.0
    short = marked.where(F.coalesce("size", F.lit(0)) <= LONGEST)
    chosen = [short.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]).select("doc_id", "toxic"))
    got = plain(docs).join(chosen, "doc_id").toArrow()
    release(docs.sparkSession, marked)
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    texts = [got.column("text")[i].as_py() for i in order]
    return fit(texts, got.column("toxic").to_numpy()[order], rate)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (0 or 1) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        (weights, intercept), features = shared.value, Features()
        for chunk in chunks(batches):
            z = np.array([weights[features(t)].sum(dtype=np.float64) for t in chunk.column("text").to_pylist()]) + intercept
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return plain(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Scores every document by labels of the documents that fold 0 of 5 leaves: doc_id,
    held_out, score, predicted."""
    model = train(docs, labels.where(folds(F.col("doc_id"), 5) != 0), sample)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(folds(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the documents that are predicted toxic; all columns stay."""
    model = train(docs, labels.where(folds(F.col("doc_id"), 5) != 0), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        (weights, intercept), features = shared.value, Features()
        for chunk in chunks(batches):
            keep = [weights[features(t or "")].sum(dtype=np.float64) + intercept < 0 for t in chunk.column("text").to_pylist()]
            yield chunk.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
