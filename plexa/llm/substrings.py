"""Exact substring deduplication by level-wise doubling of repeated windows.

A word that stands in a window of ``words`` consecutive words is removed if the
window's word sequence also starts in a document with a smaller doc_id.

Lengths double level by level up to ``words``: for 50 words 13, 25 and 50. At the
first two levels the window is known by a seed, the part of the level's length
in it of least hash, so that neighbouring windows share a seed and a stretch of
windows with one seed, a *run*, is one row. Windows whose 13-word seed stands in
one document alone are done; the others' documents are read again and the
surviving windows extended to 25-word seeds, with the same test. At the last
level a run whose whole span occurs in an earlier document is covered as it is;
the runs of a seed that occurs in different spans are taken apart into their
windows, and these are compared one by one. No candidates are left then, as
longer windows hold no word that these don't.

Spans are compared by two independent 64-bit hashes of their word sequences.
Null texts have no words; texts are read whole. Rows of one doc_id with
different texts are judged apart, each against smaller doc_ids only; repeated
rows get the same result. Rows without a doc_id are kept as they are and make no
others go. An empty table gives no rows. Other columns are left alone.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Spans, chunks, flat, fresh, looked_up, release, signed, stored, word_hashes, word_spans

WORDS = 50
INDEX_BITS = 30


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, tag (tells rows of one doc_id apart) and text of ``docs``."""
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), F.coalesce("text", F.lit("")).alias("text"), *more)


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    return np.minimum(keys[: len(keys) - (width - done)], keys[width - done :]) if width > done else keys


def _sequence(chunk):
    """Word offsets of the rows, and two kinds of hashes of spans of words."""
    data, off = flat(chunk.column("text"))
    start, end, bounds = word_spans(data, off)
    h = word_hashes(data, start, end)
    return bounds, Spans(h), Spans(h, 0x5851F42D4C957F2D)


def _chosen(chunk, bounds: np.ndarray, name: str):
    """Row and first word (in the chunk) of each window of the runs in column ``name``."""
    runs = chunk.column(name)
    at, n = (runs.flatten().field(k).to_numpy() for k in ("at", "n"))
    row = np.repeat(np.repeat(np.arange(len(chunk)), np.diff(runs.offsets.to_numpy())), n)
    start = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, bounds[row] + start


def _runs(docs: DataFrame, words: int, part: int, left: DataFrame | None = None) -> DataFrame:
    """Each run of windows with one seed of ``part`` words: its first window, their number, and
    hashes of the seed and of the whole span. ``left``: doc_id, tag and the windows to look at
    (array ``left`` of first window and number of windows); all without."""

    every = left is None

    def run(batches):
        mask = np.uint64((1 << INDEX_BITS) - 1)
        for chunk in chunks(batches):
            bounds, seeds, spans = _sequence(chunk)
            count = int(bounds[-1])
            if count < words:
                continue
            at = np.arange(count - part + 1)
            seed = seeds(at, at + part)
            least = _lowest((seed & ~mask) | at.astype(np.uint64), words - part + 1)
            if every:
                inside = np.arange(len(least))
                row = np.searchsorted(bounds, inside, "right") - 1
                fits = inside + words <= bounds[row + 1]
                inside, row = inside[fits], row[fits]
            else:
                row, inside = _chosen(chunk, bounds, "left")
                order = np.argsort(inside, kind="stable")
                row, inside = row[order], inside[order]
            if not len(inside):
                continue
            place = (least[inside] & mask).astype(np.int64)
            border = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(inside, prepend=-2) != 1) | (np.diff(row, prepend=-1) != 0))
            first, row = inside[border], row[border]
            number = np.diff(border, append=len(inside))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(seed[place[border]])), pa.array(signed(spans(first, first + number + words - 1))),
                    chunk.column("doc_id").take(pa.array(row)), chunk.column("tag").take(pa.array(row)),
                    pa.array((first - bounds[row]).astype(np.int32)), pa.array(number.astype(np.int32)),
                ],
                ["seed", "span", "doc_id", "tag", "at", "n"],
            )

    rows = _rows(docs.where("doc_id is not null"))
    if not every:
        rows = rows.join(left, ["doc_id", "tag"])
    return rows.mapInArrow(run, "seed long, span long, doc_id long, tag long, at int, n int")


def _windows(docs: DataFrame, open_runs: DataFrame, words: int) -> DataFrame:
    """Hashes of each window of the open runs of the documents that have some."""

    def run(batches):
        for chunk in chunks(batches):
            bounds, one, two = _sequence(chunk)
            row, first = _chosen(chunk, bounds, "open")
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(one(first, first + words))), pa.array(signed(two(first, first + words))), chunk.column("doc_id").take(pa.array(row)), chunk.column("tag").take(pa.array(row)), pa.array((first - bounds[row]).astype(np.int32))],
                ["one", "two", "doc_id", "tag", "at"],
            )

    return _rows(docs).join(open_runs, ["doc_id", "tag"]).mapInArrow(run, "one long, two long, doc_id long, tag long, at int")


def repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, tag, covered (array of first window and number of windows) of each document
    with windows that also start in a document of smaller doc_id. A stored table."""
    spark = docs.sparkSession
    places = F.collect_list(F.struct("at", "n"))
    half = max(1, words // 2)
    quarter = -(-half // 2)

    # the first level: seeds that stand in several documents
    runs = stored(_runs(docs, words, quarter).drop("span"), "short")
    again = runs.groupBy("seed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("times"))
    again = stored(again.where("first < last").select("seed", "times"), "seeds")
    left = looked_up(runs, again, ["seed"], "times").where("times is not null").groupBy("doc_id", "tag").agg(places.alias("left"))
    left = stored(left, "left")
    release(spark, runs, again)

    # twice as long: what survived, by spans and by longer seeds
    runs = stored(_runs(docs, words, half, left), "runs")
    kinds = runs.groupBy("seed", "span").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("times"))
    kinds = stored(kinds, "kinds")
    again = stored(kinds.where("first < last").select("seed", "span", "first", "times"), "again")
    mixed = kinds.groupBy("seed").agg(F.count("*").alias("spans"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("times").alias("times"))
    mixed = stored(mixed.where("spans > 1 and first < last").select("seed", "times"), "mixed")
    told = looked_up(runs, again, ["seed", "span"], "times").select("seed", "doc_id", "tag", "at", "n", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("covered"))
    told = stored(told, "told")
    covered = stored(told.where("covered").groupBy("doc_id", "tag").agg(places.alias("covered")), "covered")
    open_runs = looked_up(told.where("not covered"), mixed, ["seed"], "times").where("times is not null").groupBy("doc_id", "tag").agg(places.alias("open"))
    open_runs = stored(open_runs, "open")
    release(spark, left, runs, kinds, again, mixed, told)

    # the full length: window by window
    single = stored(_windows(docs, open_runs, words), "windows")
    first = single.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("times"))
    first = stored(first.where("first < last").select("one", "two", "first", "times"), "first")
    more = looked_up(single, first, ["one", "two"], "times").where("doc_id > first").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"))).alias("covered"))
    both = covered.unionAll(more).groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("covered")).alias("covered"))
    out = stored(both, "repeats")
    release(spark, single, first, open_runs, covered)
    return out


def _kept(words: int, n_words: int, covered) -> np.ndarray:
    """Which words stay."""
    gone = np.zeros(n_words + 1, np.int64)
    if covered is not None and len(covered):
        at, n = covered
        np.add.at(gone, at, 1)
        np.add.at(gone, at + n + words - 1, -1)
    return np.cumsum(gone[:-1]) == 0


def _spans_of(chunk, name: str = "covered"):
    """Covered runs of each row, as arrays, or None."""
    column = chunk.column(name)
    at, n = (column.flatten().field(k).to_numpy() for k in ("at", "n"))
    sizes = np.diff(column.offsets.to_numpy()) * np.array(column.is_valid())
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return [(at[a:b], n[a:b]) if b > a else None for a, b in zip(ends, ends[1:], strict=False)]


def digests(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    found = repeats(docs, words)

    def run(batches):
        for chunk in chunks(batches):
            rows = []
            for text, covered in zip(chunk.column("text").to_pylist(), _spans_of(chunk), strict=True):
                all_words = text.encode().split()
                kept = all_words if covered is None else [w for w, k in zip(all_words, _kept(words, len(all_words), covered).tolist(), strict=True) if k]
                rows.append((len(all_words), len(all_words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            a, b, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _rows(docs).join(found, ["doc_id", "tag"], "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with the covered words, and the white space after each, cut out of the texts;
    n_chars, if there, follows. Null texts stay null."""
    found = repeats(docs, words)
    columns, tag, runs = docs.columns, fresh("_tag", docs), fresh("_covered", docs)

    def run(batches):
        for chunk in chunks(batches):
            texts = chunk.column("text").to_pylist()
            data, off = flat(chunk.column("text"))
            start, _, bounds = word_spans(data, off)
            for i, covered in enumerate(_spans_of(chunk, runs)):
                if covered is not None:
                    own = np.append(start[bounds[i] : bounds[i + 1]], off[i + 1])
                    kept = np.flatnonzero(_kept(words, len(own) - 1, covered))
                    raw = data[off[i] : off[i + 1]].tobytes()
                    texts[i] = b"".join([raw[: own[0] - off[i]], *(raw[own[k] - off[i] : own[k + 1] - off[i]] for k in kept.tolist())]).decode()
            at = chunk.schema.get_field_index("text")
            out = chunk.set_column(at, "text", pa.array(texts, pa.string()))
            yield out.select(columns)

    tagged = docs.withColumn(tag, F.xxhash64("text"))
    found = found.select("doc_id", F.col("tag").alias(tag), F.col("covered").alias(runs))
    joined = tagged.join(found, ["doc_id", tag], "left").select(*columns, runs)
    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
