"""Language-model scores by online logistic context mixing.

Texts are sequences of tokens: words (runs of bytes between ASCII white space,
A-Z in lower case), then one end. The model predicts a text bit by bit: a word's
bytes and then a space, the end as a line feed. Each of several predictors tells
by a context, its last ``ORDERS`` bytes or all that the unit holds so far, and by
the byte's bits so far how often the next bit was 0 and 1 in training. Their logits
are mixed by weights that a gate selects: how long a context has been seen, and how
often. Weights are learned online, by gradient steps over the training units with
the unit itself left out of the counts; the mixed probability is refined by a table
that adapts to what came true at that probability and gate.

A *unit* is what is predicted at a time: the first byte of a token, whose contexts
reach back into the word before it (its last two bytes and the space), or the rest of
a word, whose contexts reach back to the word's first byte. So every token has a
probability given its past, the text's is their product, and equal units of the
whole corpus are counted, learned and scored once.

What is gathered grows with the corpus: counts of tokens and of whole contexts are
exact, for all training texts, and stay distributed; units that share a context (the
same two bytes before, or a word's first bytes) are dealt to one group, which counts it.
Where over ``GROUP // 4`` words share their first bytes, they are dealt by one byte more,
as often as it takes, and the contexts that their groups share, the *trunk*, are counted
over all of them. So whole contexts count the whole corpus, however it is dealt: no score
knows which group its word is in. What is broadcast has a bound: the predictors of one to
four bytes (hashed to a fixed number of slots), weights, refinement, and the trunk (at
most one context of a length for every ``GROUP // 4`` different words, with up to 256 next
bytes). A slice of the corpus is a *block*: its distinct units leave it once and their
scores come back.

Groups and blocks are made by the data alone, so scores don't depend on the cluster.
There is a group for every ``GROUP`` units, about; each learns weights from its own, and
the average counts. Null and empty texts are a lone end. Texts are scored whole. Every
row is a text of its own, also if its doc_id is repeated; a row with a null doc_id counts
as held out. Without training texts every token has the score of an untrained model; an
empty table gives no rows. Other columns are not looked at.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Spans, chunks, flat, mix, release, signed, stored, word_hashes, word_spans

#: Context lengths in bytes of the predictors with a fixed number of slots.
ORDERS = (1, 2, 3, 4)
#: Predictors: those, and the whole unit so far.
INPUTS = len(ORDERS) + 1
#: Slots of a predictor, as a power of two.
BITS = 20
#: Rows of a predictor's table travel in so many parts, and are added up by so many tasks a part at first.
PARTS = 16
FAN = 32
BLOCK_BYTES = 7 << 20
#: A block's words are found in slices of so many bytes, as a word takes some 100 bytes on the way.
SLICE_BYTES = 1 << 20
#: Units that are learned and scored at a time, about.
GROUP = 100_000
#: Of which contexts are held at a time for so many units.
PIECE = 10_000
#: Bytes whose whole contexts are counted at a time, about.
SECTION = 1 << 16
#: Gates tell a context's count apart at 1, 4, 16, ...: so many levels.
LEVELS = 8
GATES = LEVELS * INPUTS + 1
STEPS = 33
END = b"\n"
DELTA = 0.1
RATE = 0.05


# ---- units and blocks of texts
#
# As bytes, the rest of a word is the word itself. A first byte is a space, up to two bytes of
# the word before, a space, and the byte: no word holds a space.


def split(unit: bytes) -> tuple[bytes, bytes]:
    """What a unit's contexts begin with, and what is predicted."""
    return (unit[1:-1], unit[-1:]) if unit[:1] == b" " else (unit[:1], unit[1:] + b" ")


def _firsts(data: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray):
    """Code of the first byte and two bytes before of every token (ends last in each row), and its row."""
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds) + 1)
    place = np.arange(len(row)) - row  # the word that begins the token; at a row's end the next row's
    is_end = np.zeros(len(row), bool)
    is_end[bounds[1:] + np.arange(rows)] = True
    first = np.full(len(row), END[0], np.int64)
    first[~is_end] = data[start]
    before = place - 1
    has = place > bounds[row]
    one, two = np.full(len(row), 256, np.int64), np.full(len(row), 256, np.int64)
    last = end[before[has]] - 1
    one[has] = data[last]
    long = last > start[before[has]]
    two[np.flatnonzero(has)[long]] = data[last[long] - 1]
    return (two * 257 + one) * 256 + first, row


def _first_unit(code: int) -> bytes:
    tail = [code // 256 // 257, code // 256 % 257]
    return b" " + bytes(b for b in tail if b < 256) + b" " + bytes([code % 256])


def _planes(x: np.ndarray) -> bytes:
    """Small whole numbers, compressed byte plane by byte plane."""
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _bags(texts: pa.RecordBatch, lower: np.ndarray):
    """Hashes of the distinct words of ``texts``, these words, the distinct codes of first bytes; of every
    text how many units, each unit's place among both and times; and the text's bytes."""
    data, off = flat(texts.column("text"))
    data = lower[data]
    start, end, bounds = word_spans(data, off)
    size = np.bincount(np.repeat(np.arange(len(texts)), np.diff(bounds)), end - start + 1, len(texts)).astype(np.int64) + 1
    hashes, first, place = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
    words = [data[i:j].tobytes() for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    found, row = _firsts(data, start, end, bounds)
    codes, place2 = np.unique(found, return_inverse=True)
    n = len(hashes) + len(codes)
    bag = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(bounds)) * n + place, row * n + (place2 + len(hashes))])
    bag, times = np.unique(bag, return_counts=True)
    of, unit = np.divmod(bag, n)
    return hashes, words, codes, np.bincount(of, minlength=len(texts)), unit.astype(np.int32), times.astype(np.int32), size


def _blocks(docs: DataFrame) -> DataFrame:
    """A row for each block: its units (their lengths, bytes and training occurrences; ``words`` of them
    are words, the others first bytes), and its texts (doc_id, held out, bytes) as bags (unit's place, times)."""

    def run(batches):
        from pyspark import TaskContext

        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        number = TaskContext.get().partitionId() << 32
        for chunk in chunks(batches, limit=BLOCK_BYTES):
            held = chunk.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            slices = [_bags(texts, lower) for texts in chunks([chunk], limit=SLICE_BYTES)]
            hashes, words, codes, inside, unit, times, size = zip(*slices, strict=True)
            _, first, word_at = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            known, code_at = np.unique(np.concatenate(codes), return_inverse=True)
            words = [w for some in words for w in some]
            units = [words[i] for i in first.tolist()] + [_first_unit(c) for c in known.tolist()]
            n, w, c, row = len(units), 0, 0, 0
            trained, steps = np.zeros(n, np.int64), []
            for h, k, held_units, at, many in zip(hashes, codes, inside, unit, times, strict=True):
                # places keep their order: words by their hashes, then first bytes by their codes
                places = np.concatenate([word_at[w : w + len(h)], code_at[c : c + len(k)] + len(first)])[at]
                taught = np.repeat(~held[row : row + len(held_units)], held_units)
                trained += np.bincount(places[taught], many[taught], n).astype(np.int64)
                step = np.diff(places, prepend=0)
                begins = (np.cumsum(held_units) - held_units)[held_units > 0]
                step[begins] = places[begins]
                steps.append(step.astype(np.int32))
                w, c, row = w + len(h), c + len(k), row + len(held_units)
            texts = [np.concatenate(x) for x in (size, inside, steps, times)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number]), pa.array([len(first)]),
                    pa.array([_planes(np.array([len(u) for u in units]))], pa.binary()), pa.array([zlib.compress(b"".join(units), 1)], pa.binary()), pa.array([_planes(trained)], pa.binary()),
                    pa.array([chunk.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())),
                    pa.array([[_planes(x) for x in texts]], pa.list_(pa.binary())),
                ],
                ["block", "words", "lengths", "units", "trained", "doc_id", "held_out", "texts"],
            )
            number += 1

    return docs.mapInArrow(run, "block long, words long, lengths binary, units binary, trained binary, doc_id array<long>, held_out array<boolean>, texts array<binary>")


def _units(blocks: DataFrame) -> DataFrame:
    """block, place, hash, unit and trained of the units of all blocks."""

    def run(batches):
        for batch in batches:
            for block, lengths, units, trained in zip(*(batch.column(c).to_pylist() for c in ("block", "lengths", "units", "trained")), strict=True):
                size, data = _numbers(lengths), np.frombuffer(zlib.decompress(units), np.uint8)
                edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                h = word_hashes(data, edge[:-1].astype(np.int64), edge[1:].astype(np.int64))
                bytes_ = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edge), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), block)), pa.array(np.arange(len(size), dtype=np.int32)), pa.array(signed(h)), bytes_, pa.array(_numbers(trained))], ["block", "place", "hash", "unit", "trained"])

    return blocks.select("block", "lengths", "units", "trained").mapInArrow(run, "block long, place int, hash long, unit binary, trained long")


# ---- the model


class Tokens:
    """Contexts and bits of the predicted bytes of some units."""

    def __init__(self, units: list[bytes]):
        parts = [split(u) for u in units]
        lead = np.array([len(a) for a, _ in parts])
        size = lead + np.array([len(b) for _, b in parts])
        data = np.frombuffer(b"".join(a + b for a, b in parts), np.uint8)
        start = np.repeat(np.cumsum(size) - size, size)
        at = np.flatnonzero(np.arange(len(data)) - start >= np.repeat(lead, size))
        start = start[at]
        self.units = len(units)
        self.token = np.repeat(np.arange(len(units)), size)[at]
        self.data = data[at]
        spans = Spans(data)
        begins = np.uint64(0x632BE59BD9B4E019)
        self.contexts = [spans(low := np.maximum(start, at - k), at) + (low == start).astype(np.uint64) * begins for k in ORDERS]
        # the two kinds of units never share a whole context
        kind = np.array([u[:1] == b" " for u in units])[self.token]
        self.whole = mix(spans(start, at) + kind.astype(np.uint64) * begins)

    def node(self, bit: int) -> np.ndarray:
        """The bits of the byte above ``bit``, after a leading 1."""
        return (self.data.astype(np.uint64) | np.uint64(256)) >> np.uint64(bit + 1)

    def y(self, bit: int) -> np.ndarray:
        return (self.data >> bit) & 1

    def slots(self, bit: int) -> list[np.ndarray]:
        """The slot in each predictor's table."""
        salt = self.node(bit) * np.uint64(0x9E3779B97F4A7C15)
        return [((c ^ salt) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64) for c in self.contexts]

    def counted(self, trained: np.ndarray, trunk: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """(bits, 2, bytes): how often 0 and 1 came after each whole context, by ``trained`` of the units.
        The contexts of ``trunk`` (contexts, next bytes, how often) are counted by it alone."""
        return _counted(self.whole, self.data, trained.astype(np.float64)[self.token], trunk)


def _counted(whole: np.ndarray, byte: np.ndarray, mass: np.ndarray, trunk: tuple[np.ndarray, ...] | None) -> np.ndarray:
    """``Tokens.counted`` of whole contexts and next bytes that occur ``mass`` times."""
    bytes_ = len(byte)
    if trunk is not None and len(trunk[0]):
        known = np.unique(trunk[0])
        hit = known[np.minimum(np.searchsorted(known, whole), len(known) - 1)] == whole
        mass = np.where(hit, 0, mass)
        met = np.isin(trunk[0], whole[hit])
        whole, byte, mass = (np.concatenate([own, more[met]]) for own, more in zip((whole, byte, mass), trunk, strict=True))
    # by context and byte: what shares a context and the upper bits of the byte then stands together
    order = np.lexsort((byte, whole))
    out = np.empty((8, 2, len(byte)), np.float32)
    for rows in _sections(whole, order):
        own = byte[rows]
        fresh = np.concatenate([[True], whole[rows[1:]] != whole[rows[:-1]]])
        upto = np.concatenate([[0.0], np.cumsum(mass[rows])])
        for b in range(8):
            upper = own >> b  # with the bit itself
            edge = np.flatnonzero(fresh | np.concatenate([[True], upper[1:] != upper[:-1]]))
            sums = np.diff(upto[np.append(edge, len(rows))])
            bit = upper[edge] & 1
            node = np.cumsum(fresh[edge] | np.concatenate([[True], (upper[edge][1:] >> 1) != (upper[edge][:-1] >> 1)])) - 1
            sizes = np.diff(np.append(edge, len(rows)))
            for y in (0, 1):
                out[b, y, rows] = np.repeat(np.bincount(node, sums * (bit == y))[node], sizes)
    return out[:, :, :bytes_]


def _sections(whole: np.ndarray, order: np.ndarray):
    """``order``, by which equal contexts stand together, in sections that part none, of about ``SECTION`` or one context."""
    at = 0
    while at < len(order):
        to = min(at + SECTION, len(order))
        last = whole[order[to - 1]]
        while to < len(order) and whole[order[to]] == last:
            more = whole[order[to : to + SECTION]] == last
            to += len(more) if more.all() else int(more.argmin())
        yield order[at:to]
        at = to


def _pieces(units: list[bytes], counts: np.ndarray, size: int):
    """Place, tokens and counts of about ``size`` units at a time: contexts are held for these alone."""
    for at in range(0, len(units), size):
        yield at, Tokens(units[at : at + size]), counts[at : at + size].astype(np.float64)


def _trunk(children: list[tuple[bytes, int]]) -> tuple[np.ndarray, ...]:
    """Contexts, next bytes and how often, of beginnings of words (a space after each word) of two bytes or more."""
    if not children:
        return np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0)
    tokens = Tokens([c for c, _ in children])
    at = np.cumsum([len(c) for c, _ in children], dtype=np.int64) - 2
    return tokens.whole[at], tokens.data[at], np.array([n for _, n in children], np.float64)


class Mixer:
    """``tables``: (orders, slots) counts of 0 and 1, two 16-bit floats each. ``trunk``: contexts that groups share. ``weights``: (gates, inputs). ``refined``: (gates,
    steps, 2), how often a bit came and was 1 at a mixed logit near a step."""

    def __init__(self, tables: np.ndarray, trunk: tuple[np.ndarray, ...] | None = None):
        self.tables, self.trunk = tables, trunk
        self.weights = np.full((GATES, INPUTS), 0.35)
        self.squares = np.full((GATES, INPUTS), 1e-3)
        self.refined = np.zeros((GATES, STEPS, 2))

    def inputs(self, slots: list[np.ndarray], whole: np.ndarray, y: np.ndarray, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the predictors, and the gate; ``leave_out``: with one y less in the counts."""
        logits = np.empty((INPUTS, len(y)), np.float32)
        bit = y.astype(np.float32)
        gate = np.zeros(len(y), np.int32)
        for k in range(INPUTS):
            if k < len(ORDERS):
                pairs = np.take(self.tables[k], slots[k]).view(np.float16).reshape(-1, 2).astype(np.float32)
                zeros, ones = pairs[:, 0], pairs[:, 1]
            else:
                zeros, ones = whole
            if leave_out:
                zeros, ones = np.maximum(zeros - (1 - bit), 0), np.maximum(ones - bit, 0)
            total = np.ascontiguousarray(zeros + ones)
            logits[k] = np.log((ones + np.float32(DELTA)) / (zeros + np.float32(DELTA)))
            power = (total.view(np.int32) >> 23) - 127  # of two, as the float's exponent
            gate = np.where(power >= 0, LEVELS * k + 1 + np.minimum(power >> 1, LEVELS - 1), gate)
        return logits, gate

    def mixed(self, logits: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(len(gate), np.float32)
        for w, x in zip(self.weights.T.astype(np.float32), logits, strict=True):
            z += np.take(w, gate) * x
        return np.clip(z, -16, 16)

    @staticmethod
    def step(z: np.ndarray):
        x = (z + 16) * ((STEPS - 1) / 32)
        low = np.minimum(x.astype(np.int64), STEPS - 2)
        return low, x - low

    def whole(self, units: list[bytes], counts: np.ndarray) -> np.ndarray:
        """``Tokens.counted`` of units that occur ``counts`` times."""
        pieces = [(tokens.whole, tokens.data, mass[tokens.token]) for _, tokens, mass in _pieces(units, counts, PIECE)]
        whole, byte, mass = (np.concatenate(x) for x in zip(*pieces, strict=True))
        del pieces
        return _counted(whole, byte, mass, self.trunk)

    def learn(self, units: list[bytes], counts: np.ndarray) -> None:
        """One online pass over units that occur ``counts`` times."""
        whole, done = self.whole(units, counts), 0
        for _, tokens, mass in _pieces(units, counts, 2000):
            mass, rows = mass[tokens.token], slice(done, done + len(tokens.data))
            done = rows.stop
            for b in range(7, -1, -1):
                y = tokens.y(b)
                logits, gate = self.inputs(tokens.slots(b), whole[b][:, rows], y, True)
                z = self.mixed(logits, gate)
                error = 1 / (1 + np.exp(-z)) - y
                weight = np.bincount(gate, mass, GATES)
                for k in range(INPUTS):
                    slope = np.bincount(gate, mass * error * logits[k], GATES) / np.maximum(weight, 1e-9)
                    self.squares[:, k] += slope * slope
                    self.weights[:, k] -= RATE * slope / np.sqrt(self.squares[:, k])
                low, share = self.step(z)
                for at, part_mass in ((low, mass * (1 - share)), (low + 1, mass * share)):
                    self.refined[:, :, 0] += np.bincount(gate * STEPS + at, part_mass, GATES * STEPS).reshape(GATES, STEPS)
                    self.refined[:, :, 1] += np.bincount(gate * STEPS + at, part_mass * y, GATES * STEPS).reshape(GATES, STEPS)

    def scores(self, units: list[bytes], counts: np.ndarray) -> np.ndarray:
        """log10 probability of each unit. ``counts``: how often it occurs in training."""
        centre = 1 / (1 + np.exp(-np.linspace(-16, 16, STEPS)))
        adapted = (self.refined[:, :, 1] + 8 * centre) / (self.refined[:, :, 0] + 8)
        whole, done, out = self.whole(units, counts), 0, np.empty(len(units))
        for first, tokens, _ in _pieces(units, counts, PIECE):
            rows, total = slice(done, done + len(tokens.data)), np.zeros(len(tokens.data))
            done = rows.stop
            for b in range(7, -1, -1):
                y = tokens.y(b)
                logits, gate = self.inputs(tokens.slots(b), whole[b][:, rows], y, False)
                z = self.mixed(logits, gate)
                low, share = self.step(z)
                refined = adapted[gate, low] * (1 - share) + adapted[gate, low + 1] * share
                p = np.clip(0.5 / (1 + np.exp(-z)) + 0.5 * refined, 1e-7, 1 - 1e-7)
                total += np.log10(np.where(y == 1, p, 1 - p))
            out[first : first + tokens.units] = np.bincount(tokens.token, total, tokens.units)
        return out


def halved(tables: np.ndarray) -> np.ndarray:
    """Counts (orders, slots, 2) as pairs of 16-bit floats; those of large counts keep their ratio."""
    most = tables.max(-1, keepdims=True)
    return (tables * np.minimum(1, 60000 / np.maximum(most, 1))).astype(np.float16).view(np.uint32)[..., 0]


def _tables(counts: DataFrame) -> np.ndarray:
    """The fixed predictors' counts, over all training occurrences of ``counts`` (unit, trained)."""
    part_slots = (1 << BITS) // PARTS

    def gather(batches):
        from pyspark import TaskContext

        tables = None
        for batch in batches:
            units, trained = batch.column("unit").to_pylist(), batch.column("trained").to_numpy()
            if tables is None:
                tables = np.zeros((len(ORDERS), 2 << BITS), np.float32)
            for at in range(0, len(units), 50_000):
                tokens = Tokens(units[at : at + 50_000])
                mass = trained[at : at + 50_000].astype(np.float64)[tokens.token]
                slots = [tokens.slots(b) for b in range(8)]
                for k in range(len(ORDERS)):
                    where = np.concatenate([2 * slots[b][k] + tokens.y(b) for b in range(8)])
                    tables[k] += np.bincount(where, np.tile(mass, 8), 2 << BITS)
        if tables is not None:
            near = TaskContext.get().partitionId() % FAN
            for k in range(len(ORDERS)):
                for p, piece in enumerate(tables[k].reshape(PARTS, -1)):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([k * PARTS + p], pa.int32()), "near": pa.array([near], pa.int32()), "counts": [zlib.compress(piece.tobytes(), 1)]})

    def merge(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *at, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "near", "counts")), strict=True):
                got = np.frombuffer(zlib.decompress(raw), np.float32)
                sums[tuple(at)] = sums.get(tuple(at), 0) + got.astype(np.float64)
        for (part, near), x in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "near": pa.array([near], pa.int32()), "counts": [zlib.compress(x.astype(np.float32).tobytes(), 1)]})

    kind = "part int, near int, counts binary"
    parts = counts.where("trained > 0").mapInArrow(gather, kind).repartition("part", "near").mapInArrow(merge, kind)
    parts = parts.withColumn("near", F.lit(0)).repartition("part").mapInArrow(merge, kind)
    tables = np.zeros((len(ORDERS), PARTS, part_slots, 2), np.float32)
    for row in parts.collect():  # of a fixed size, whatever the input
        tables[row["part"] // PARTS, row["part"] % PARTS] = np.frombuffer(zlib.decompress(row["counts"]), np.float32).reshape(part_slots, 2)
    return halved(tables.reshape(len(ORDERS), 1 << BITS, 2))


def _grouped(counts: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, ...]]:
    """``counts`` with ``part``, and the trunk: units that share a whole context have the same part, but
    for the trunk's contexts."""
    is_first = F.substring("unit", 1, 1) == F.lit(b" ")
    word = F.concat("unit", F.lit(b" "))
    words = counts.where(~is_first)
    under, size, length, children = words, 1, F.lit(1), []
    while True:
        heads = under.groupBy(F.substring(word, 1, size).alias("head")).agg(F.count("*").alias("times"), F.sum("trained").alias("trained"))
        rows = heads.collect()  # at most 256 for each hot head of a byte less
        if size > 1:
            children += [(bytes(r["head"]), r["trained"]) for r in rows if r["trained"]]
        hot = [bytes(r["head"]) for r in rows if r["times"] > max(1, GROUP // 4)]
        if not hot:
            break
        is_hot = F.substring(word, 1, size).isin(hot)
        under, length, size = words.where(is_hot), length + is_hot.cast("int"), size + 1
    key = F.when(is_first, F.expr("substring(unit, 1, length(unit) - 1)")).otherwise(F.substring(word, F.lit(1), length))
    parts = max(1, math.ceil(counts.count() / GROUP))
    return counts.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts))), _trunk(children)


def train(counts: DataFrame, trunk: tuple[np.ndarray, ...]) -> Mixer:
    """The model of ``counts`` (hash, unit, trained, part) and their ``trunk``: predictor counts, then weights and
    refinement learned online by each group over its units, in the order of their hashes, and
    averaged by the units' number."""
    tables = _tables(counts)
    shared = counts.sparkSession.sparkContext.broadcast((tables, trunk))

    def learn(table):
        table = table.sort_by([("hash", "ascending"), ("unit", "ascending")])
        mixer, trained = Mixer(*shared.value), table.column("trained").to_numpy()
        mixer.learn(table.column("unit").to_pylist(), trained)
        mass = float(trained.sum())
        values = np.concatenate([[mass], (mass * mixer.weights).ravel(), mixer.refined.ravel()])
        return pa.table({"values": pa.array([values], pa.list_(pa.float64()))})

    learned = counts.where("trained > 0").groupBy("part").applyInArrow(learn, "values array<double>")
    sums = learned.select(F.posexplode("values").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    mixer = Mixer(tables, trunk)
    got = {r["at"]: r["value"] for r in sums.collect()}  # as many numbers as a mixer has, whatever the input
    if got:
        values = np.array([got[i] for i in range(len(got))])
        weights = mixer.weights.size
        mixer.weights = (values[1 : 1 + weights] / values[0]).reshape(mixer.weights.shape)
        mixer.refined = values[1 + weights :].reshape(mixer.refined.shape)
    mixer.shared = shared
    return mixer


def scored(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (of the
    words, a space after each, and the end) of every text, learned from the rows that the column
    ``held_out`` doesn't mark."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    blocks = stored(_blocks(rows), "blocks")
    ends = blocks.agg(F.sum(F.size(F.filter("held_out", lambda x: ~x)))).first()[0] or 0
    counts = stored(_units(blocks).groupBy("hash", "unit").agg(F.sum("trained").alias("trained")), "counts")
    words = counts.where((F.col("trained") > 0) & (F.substring("unit", 1, 1) != F.lit(b" ")))
    facts = words.agg(F.sum("trained").alias("n"), F.count("*").alias("v")).first()
    n, v = (facts["n"] or 0) + ends, facts["v"] + (ends > 0)
    dealt, trunk = _grouped(counts)
    dealt = stored(dealt, "units")
    release(spark, counts)
    mixer = train(dealt, trunk)
    shared, weights, refined = mixer.shared, mixer.weights, mixer.refined

    def score(table):
        model = Mixer(*shared.value)
        model.weights, model.refined = weights, refined
        units, c = table.column("unit").to_pylist(), table.column("trained").to_numpy()
        word = np.array([u[:1] != b" " for u in units])
        base = np.where(word, np.log10((c + 0.1) / (n + 0.1 * (v + 1))), 0.0)
        return pa.table({"hash": table.column("hash"), "check": table.column("check"), "known": pa.array(word & (c > 0)), "base": pa.array(base), "score": pa.array(model.scores(units, c))})

    # a unit's answer is known by 96 bits of hashes
    known = stored(dealt.withColumn("check", F.hash("unit")).groupBy("part").applyInArrow(score, "hash long, check int, known boolean, base double, score double"), "scores")
    release(spark, dealt)
    end_base = float(np.log10((ends + 0.1) / (n + 0.1 * (v + 1))))
    asked = _units(blocks).select("block", "place", "hash", F.hash("unit").alias("check"))
    answers = asked.join(known, ["hash", "check"]).select("block", "place", "known", "base", "score")

    def put_together(answers, texts):
        place = answers.column("place").to_numpy()
        unit = {}
        for name in ("known", "base", "score"):
            unit[name] = np.zeros(len(place))
            unit[name][place] = answers.column(name).to_numpy(zero_copy_only=False)
        parts = []
        for words, doc_id, held, raw in zip(*(texts.column(c).to_pylist() for c in ("words", "doc_id", "held_out", "texts")), strict=True):
            k = len(doc_id)
            size, held_units, steps, times = map(_numbers, raw)
            row = np.repeat(np.arange(k), held_units)
            at = np.cumsum(steps)
            begins = np.cumsum(held_units) - held_units
            at -= np.repeat(np.where(begins > 0, at[np.maximum(begins - 1, 0)], 0), held_units)
            total = lambda x, row=row, k=k: np.bincount(row, x, k)
            score = total(times * unit["score"][at])
            parts.append(pa.table({
                "doc_id": pa.array(doc_id, pa.int64()), "held_out": pa.array(held, pa.bool_()),
                "n_tokens": pa.array(total(times * (at < words)).astype(np.int64) + 1),
                "n_known": pa.array(total(times * unit["known"][at]).astype(np.int64) + (ends > 0)),
                "train_tokens": pa.array(np.full(k, n, np.int64)),
                "base_score": pa.array(total(times * unit["base"][at]) + end_base),
                "score": pa.array(score),
                "bits_per_byte": pa.array(-score * math.log2(10) / size),
            }))
        return pa.concat_tables(parts)

    bags = blocks.select(F.col("block").alias("of"), "words", "doc_id", "held_out", "texts")
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return answers.groupBy("block").cogroup(bags.groupBy("of")).applyInArrow(put_together, kind)
