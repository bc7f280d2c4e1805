"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a segment's bytes from both ends and gives every position a
distribution over the languages; it is trained in numpy by backpropagation
through time and Adam. Segments are stretches of ``SEGMENT`` bytes of the text,
words and what stands between them, so that a position sees its neighbouring
words and long texts need no long recurrence. A segment's log-probabilities are the
mean of its positions'; a document's are the sum over all its segments, a
shorter last one in proportion, normalised.

Training uses at most ``SAMPLE_DOCS`` documents of each language that has one,
those of least hash of doc_id among the texts of up to ``LONGEST`` bytes, and
all segments of these. Null texts and texts without a letter are ``und`` with
score 0, and so is everything if no language could be learned. Every row is
labelled, whole, also if its doc_id is repeated or null; a row without a doc_id
counts as held out. Columns beside doc_id, text and lang are not looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import chunks, flat, plain, release, stored
from .toxicity import folds

HIDDEN = 12
SEGMENT = 48
SAMPLE_DOCS = 400
#: Bytes of a text that training may use.
LONGEST = 1 << 20
STEPS = 700
BATCH = 128
RATE = 0.01
#: Tasks that draw the sample of one language at first.
SPREAD = 64
UNKNOWN = "und"


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters: for each direction ``w`` (256 x 3H: update, reset, candidate), ``u`` (H x 3H);
    then the output layer ``v`` (2H x languages) and ``c``."""

    def __init__(self, languages: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        shapes = [(256, 3 * hidden), (hidden, 3 * hidden)] * 2 + [(2 * hidden, languages), (languages,)]
        self.values = [rng.normal(0, 0.3 if s[0] == 256 else (1 / s[0]) ** 0.5, s).astype(np.float32) for s in shapes]
        self.values[5][:] = 0
        self.hidden = hidden

    def direction(self, x: np.ndarray, k: int) -> list[tuple]:
        """States after each column of the bytes ``x``, with what the way back needs."""
        w, u = self.values[2 * k : 2 * k + 2]
        n = self.hidden
        h, out = np.zeros((len(x), n), np.float32), []
        for t in range(x.shape[1]):
            a = w[x[:, t]]
            b = h @ u
            gates = _sigmoid(a[:, : 2 * n] + b[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :])
            before, h = h, h + z * (c - h)
            out.append((before, z, r, c, b[:, 2 * n :], h))
        return out

    def forward(self, x: np.ndarray):
        ahead = self.direction(x, 0)
        back = self.direction(x[:, ::-1], 1)[::-1]
        states = np.stack([np.concatenate([f[-1], b[-1]], 1) for f, b in zip(ahead, back, strict=True)], 1)
        logits = states @ self.values[4] + self.values[5]
        logits -= logits.max(-1, keepdims=True)
        return ahead, back, states, logits - np.log(np.exp(logits).sum(-1, keepdims=True))

    def gradients(self, x: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over all positions."""
        ahead, back, states, logp = self.forward(x)
        n, (rows, length) = self.hidden, x.shape
        error = np.exp(logp)
        error[np.arange(rows), :, label] -= 1
        error /= rows * length
        out = [np.zeros_like(v) for v in self.values]
        out[4] = np.tensordot(states, error, ([0, 1], [0, 1]))
        out[5] = error.sum((0, 1))
        at_state = error @ self.values[4].T
        for k, (steps, bytes_, at) in enumerate(((ahead, x, at_state[:, :, :n]), (back[::-1], x[:, ::-1], at_state[:, ::-1, n:]))):
            u = self.values[2 * k + 1]
            dh = np.zeros((rows, n), np.float32)
            for t in range(length - 1, -1, -1):
                before, z, r, c, bc, _ = steps[t]
                dh = dh + at[:, t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - before) * z * (1 - z)
                dr = dc * bc * r * (1 - r)
                da = np.concatenate([dz, dr, dc], 1)
                db = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(out[2 * k], bytes_[:, t], da)
                out[2 * k + 1] += before.T @ db
                dh = dh * (1 - z) + db @ u.T
        return out

    def train(self, segments: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> None:
        """Adam over batches of segments of one length, languages equally often."""
        rng = np.random.default_rng(seed)
        sizes = np.array([len(s) for s in segments])
        weight = 1 / np.bincount(labels)[labels]
        by_size = {}
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            p = weight[rows]
            by_size[int(n)] = (np.frombuffer(b"".join(segments[i] for i in rows), np.uint8).reshape(len(rows), n), labels[rows], p.sum() * n, np.cumsum(p / p.sum()))
        lengths = list(by_size)
        chance = np.array([by_size[n][2] for n in lengths])
        m = [np.zeros_like(v) for v in self.values]
        s = [np.zeros_like(v) for v in self.values]
        for step in range(1, steps + 1):
            x, y, _, cdf = by_size[lengths[rng.choice(len(lengths), p=chance / chance.sum())]]
            rows = np.minimum(np.searchsorted(cdf, rng.random(BATCH)), len(y) - 1)
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for v, g, a, b in zip(self.values, self.gradients(x[rows], y[rows]), m, s, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def states(self, x: np.ndarray, k: int) -> np.ndarray:
        """The states of ``direction`` after each column, kept alone: (columns, rows, H)."""
        n = self.hidden
        w, u = self.values[2 * k : 2 * k + 2]
        half = np.float32(0.5)  # of the gates' arguments, as sigmoid(a) is (tanh(a / 2) + 1) / 2
        tables = [np.ascontiguousarray(w[:, i * n : (i + 1) * n] * (half if i < 2 else np.float32(1))) for i in range(3)]
        wings = [np.ascontiguousarray(u[:, i * n : (i + 1) * n] * (half if i < 2 else np.float32(1))) for i in range(3)]
        out = np.empty((x.shape[1], len(x), n), np.float32)
        h = np.zeros((len(x), n), np.float32)
        z, r, c, own = (np.empty_like(h) for _ in range(4))
        for t in range(x.shape[1]):
            column = x[:, t]
            for gate, table, wing in ((z, tables[0], wings[0]), (r, tables[1], wings[1])):
                np.matmul(h, wing, out=gate)
                gate += table[column]
                np.tanh(gate, out=gate)
                gate += 1
                gate *= half
            np.matmul(h, wings[2], out=c)
            c *= r
            c += tables[2][column]
            np.tanh(c, out=c)
            c -= h
            c *= z
            np.add(h, c, out=out[t])
            h = out[t]
        return out

    def segments(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, batch: int = 1024) -> np.ndarray:
        """Mean log-probabilities over the positions of each segment."""
        n, languages = self.hidden, len(self.values[5])
        out = np.zeros((len(start), languages), np.float32)
        order = np.argsort(size, kind="stable")
        borders = [0, *(np.flatnonzero(np.diff(size[order])) + 1), len(order)]
        ahead, back = self.values[4][:n], self.values[4][n:]
        for a, b in zip(borders, borders[1:], strict=False):
            for at in range(a, b, batch):
                rows = order[at : min(b, at + batch)]
                x = data[start[rows][:, None] + np.arange(size[rows[0]])]
                logits = self.states(x, 0) @ ahead
                logits += (self.states(x[:, ::-1], 1) @ back)[::-1]
                logits += self.values[5]
                logits -= logits.max(-1, keepdims=True)
                out[rows] = (logits - np.log(np.exp(logits).sum(-1, keepdims=True))).mean(0)
        return out


def _cut(off: np.ndarray):
    """Starts and ends of the segments of texts at ``off``, and the text that each belongs to."""
    size = np.diff(off)
    pieces = -(-size // SEGMENT)
    row = np.repeat(np.arange(len(size)), pieces)
    first = off[row] + SEGMENT * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return first, np.minimum(first + SEGMENT, off[row + 1]), row


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[Network, list[str]] | None:
    """Trains on ``docs`` with text and lang; None if there is nothing to learn from."""
    known = docs.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    ids = known.where(F.octet_length("text").between(1, LONGEST)).select("doc_id", "lang").distinct().withColumn("part", F.pmod(F.hash("doc_id"), F.lit(SPREAD)))
    for by in (("lang", "part"), ("lang",)):  # so that one language's documents don't meet in one task
        order = Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_docs).drop("n")
    ids = stored(ids.select("doc_id", "lang"), "sample")  # Spark sees its size and sends it to the texts if that is small
    got = known.where(F.octet_length("text") <= LONGEST).join(ids, ["doc_id", "lang"]).distinct().toArrow()
    release(docs.sparkSession, ids)
    if not got.num_rows:
        return None
    languages = sorted(set(got.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    segments, labels = [], []
    for doc, text, lang in sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True)):
        raw = text.encode()
        for at in range(0, len(raw), SEGMENT):
            segments.append(raw[at : at + SEGMENT])
            labels.append(number[lang])
    network = Network(len(number))
    if len(number) > 1:
        network.train(segments, np.array(labels))
    return network, languages


def predict(docs: DataFrame, model: tuple[Network, list[str]] | None) -> DataFrame:
    """doc_id, lang_pred and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model and (model[0].values, model[1]))

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}").search
        network = languages = None
        if shared.value:
            values, languages = shared.value
            network = Network(len(languages), values[1].shape[0])
            network.values = values
        for chunk in chunks(batches):
            known = np.array([bool(letter(t)) for t in chunk.column("text").to_pylist()]) & bool(languages)
            names, score = np.full(len(chunk), UNKNOWN, object), np.zeros(len(chunk))
            if known.any():
                data, off = flat(chunk.column("text"))
                first, last, row = _cut(off)
                logp = network.segments(data, first, last - first) * ((last - first) / SEGMENT)[:, None]
                total = np.stack([np.bincount(row, logp[:, c], len(chunk)) for c in range(len(languages))], 1)
                total -= total.max(1, keepdims=True)
                p = np.exp(total) / np.exp(total).sum(1, keepdims=True)
                best = p.argmax(1)
                names[known] = np.array(languages, object)[best[known]]
                score[known] = p[np.arange(len(p)), best][known]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return plain(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learns from the documents outside fold 0 of 5 and predicts all: doc_id, held_out, lang_pred, score."""
    held = F.coalesce(folds(F.col("doc_id"), 5) == 0, F.lit(True))
    out = predict(docs, learn(docs.where(~held), sample_docs))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
