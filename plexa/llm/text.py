"""Vectorised text kernels on Arrow batches, and the shared storage of intermediate tables.

A *chunk* is a run of rows of one batch with a bounded number of text bytes
(a longer single text is a chunk of its own), seen as one byte array plus
row offsets. Null texts count as empty.
"""

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one chunk holds (unless one text is longer).
CHUNK_BYTES = 2 << 20

#: Bytes that are hashed at a time.
HASHED = 1 << 20

#: Keys that hold more than one row in so many are hot.
HOT = 4096

#: Spark removes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Separators between words, as a character class for Java and Python patterns.
SPACE = r"\x20\x09-\x0D"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share.

    ``spark.checkpoint.dir`` of the session; where that is unset, a temporary
    folder if driver and executors are one machine (local tests), else an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + os.path.join(tempfile.gettempdir(), "plexa-checkpoints")
    spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut and
    lost executors cost nothing. The shuffle files of the write go with it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/plexa-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], times: str) -> DataFrame:
    """``rows`` left joined by ``keys`` with ``facts``, a stored table of one row a key, where ``times`` is
    how many rows have the key.

    The facts of hot keys are broadcast (there are fewer than ``HOT``), so a key that holds a
    third of all rows stays where its rows are; only the other rows are dealt by key. Where no key
    is hot, or all are, that is one join: each further one costs the driver memory."""
    total, most = (n or 0 for n in facts.agg(F.sum(times), F.max(times)).first())
    if most <= total // HOT:
        return rows.join(facts, keys, "left")
    if total < HOT:
        return rows.join(F.broadcast(facts), keys, "left")
    more = [c for c in facts.columns if c not in keys]
    known = fresh("_hot", rows)
    hot = facts.where(F.col(times) > total // HOT).withColumn(known, F.lit(True))
    tried = rows.join(F.broadcast(hot), keys, "left")
    cold = tried.where(F.col(known).isNull()).drop(known, *more).join(facts, keys, "left")
    return tried.where(F.col(known).isNotNull()).drop(known).unionByName(cold)


def plain(docs: DataFrame, *more: str) -> DataFrame:
    """Columns doc_id, text (null: empty) and ``more`` of ``docs``."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def fresh(name: str, docs: DataFrame) -> str:
    """A column name like ``name`` that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of record batches with at most ``limit`` bytes in ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(off) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray):
    """Starts and ends (byte positions) of all words, and word offsets of the rows."""
    is_word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.zeros(len(data), bool)
    before[1:] = is_word[:-1]
    start = np.flatnonzero(is_word & ~(before & ~edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = is_word[1:]
    end = np.flatnonzero(is_word & ~(after & ~edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Spans:
    """Hashes of any span of a sequence, by prefix sums of a polynomial modulo 2**64.

    Each element is first mixed with ``seed``. Two spans of equal content get
    equal hashes wherever they stand; others differ but for chances of 2**-64.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, values: np.ndarray, seed: int = 1):
        n = len(values)
        base = np.uint64(self.BASE)
        inverse = np.uint64(pow(self.BASE, -1, 1 << 64))
        powers = np.full(n, base, np.uint64)
        inverses = np.full(n + 1, inverse, np.uint64)
        inverses[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(inverses, out=inverses)
        self.inverses = inverses
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(values.astype(np.uint64) + np.uint64(seed)) * powers, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverses[start])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes (the length is part of the hash)."""
    if len(data) > HASHED and len(start) > 1:  # by and by, as the sums take 8 bytes a byte
        out, low = np.empty(len(start), np.uint64), 0
        while low < len(start):
            high = max(low + 1, int(np.searchsorted(start, start[low] + HASHED)))
            first = start[low]
            out[low:high] = _hashes(data[first : end[high - 1]], start[low:high] - first, end[low:high] - first)
            low = high
        return out
    return _hashes(data, start, end)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    table = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
    powers = np.full(len(data), Spans.BASE, np.uint64)
    inverses = np.full(len(data) + 1, pow(Spans.BASE, -1, 1 << 64), np.uint64)
    inverses[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverses, out=inverses)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers, out=sums[1:])
    return mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(np.uint64))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) if h.dtype == np.uint64 else h.astype(np.int64)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes stored tables that nothing needs any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        files = table.inputFiles()
        folder = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0])) if files else None
        if folder is not None and folder.getName().startswith("plexa-"):
            folder.getFileSystem(conf).delete(folder, True)


class Units:
    """What a tokenizer makes of texts, worked out once for each unit that recurs.

    Tokenizers whose pattern lets a single space begin a piece, and no piece hold
    a space otherwise, always part a text before a single space between other
    characters. So the parts between such spaces (units) are encoded by themselves and
    remembered. Texts with other white space beside a space are encoded whole.
    ``encode`` turns a list of texts into a list of values; a call gives the
    values that a text's value is the concatenation of. At most ``limit`` units
    are remembered.
    """

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit
        self.heads: dict = {}
        self.known: dict = {}

    def _learn(self, known: dict, units: set, lead: str, good) -> None:
        fresh = [u for u in units if u not in known]
        if len(known) + len(fresh) > self.limit:
            known.clear()
            fresh = list(units)
        known.update(dict.fromkeys(fresh))
        fresh = [u for u in fresh if good(u)]
        known.update(zip(fresh, self.encode([lead + u for u in fresh]), strict=True))

    def __call__(self, texts: list[str]) -> list[list]:
        split = [t.split(" ") for t in texts]
        heads = [s.pop(0) for s in split]
        self._learn(self.heads, set(heads), "", lambda u: not u[-1:].isspace())
        self._learn(self.known, set().union(*split), " ", lambda u: u and not u[0].isspace() and not u[-1].isspace())
        out, known = [], self.known
        for text, head, rest in zip(texts, heads, split, strict=True):
            values = [known[u] for u in rest]
            first = self.heads[head]
            out.append(self.encode([text]) if first is None or None in values else [first, *values])
        return out
