"""Best-fit packing of tokenised documents by minimum bin slack.

For each bin, subset sums over the lengths still available are built as a
bitset (one big integer, a shift-or for each length); the fullest feasible
combination is read back and removed. Equal lengths are interchangeable, so
the plan works on the histogram of lengths and uses a combination as often as
the histogram allows: its work follows the number of distinct combinations.

Pieces are dealt by hash into groups of bounded size, each planned by one task;
a group wastes at most about one bin more than a plan over all pieces would.

Null and empty texts are a lone end token. A text of any length is encoded
whole; only documents over the capacity are cut. No pieces give no rows. Every
row is a document of its own, also if its doc_id is repeated or null; documents
of equal length take each other's places. Other columns are not looked at.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, plain, stored

CAPACITY = 2048
#: Pieces that one task plans at a time.
GROUP = 1 << 16


def engine(tokenizer_file: str, pattern: str):
    """The file's byte-level BPE as a tiktoken encoding: ids are the file's, and a merge's rank is
    its product's id, which must grow along the file's list of merges. The file's added tokens are
    special tokens, to be allowed where a text is encoded."""
    import json

    import tiktoken

    with open(tokenizer_file, encoding="utf-8") as f:
        held = json.load(f)
    model, added = held["model"], held.get("added_tokens") or []
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("an added token takes in or asks for what stands beside it")
    specials = {t["content"]: t["id"] for t in added}
    # a byte's character: itself if it can be printed, else the next free one from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("the merges aren't in the order of their ids")
    ranks = {bytes(byte[c] for c in token): vocabulary[token] for token in vocabulary if all(c in byte for c in token)}
    made = set(merged)
    ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i in made}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)


def tokenized(docs: DataFrame, tokenizer_file: str, pattern: str, end: int = 0, ids: bool = True, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids of the pieces of every document.

    A document is its text's ids (by the vocabulary, merges and added tokens of the ``tokenizers``
    file; an added token stands where the text holds it, none is put around the text) and then ``end``. The merges are run by tiktoken's engine, which gives the
    ids that the tokenizers library gives, at a fraction of its time (see the README).
    """

    def run(batches):
        encode = engine(tokenizer_file, pattern).encode_to_numpy
        last = np.array([end], "<u4").tobytes()
        for chunk in chunks(batches):
            rows = []
            for doc, text in zip(chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist(), strict=True):
                raw = encode(text, allowed_special="all").astype("<u4", copy=False).tobytes() + last
                n = len(raw) // 4
                first = n % capacity or capacity
                for piece, to in enumerate(range(first, n + 1, capacity)):
                    start = max(0, to - capacity) if piece else 0
                    part = raw[4 * start : 4 * to]
                    rows.append((doc, piece, start, to - start, zlib.crc32(part), np.frombuffer(part, "<u4") if ids else None))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)][: 5 + ids], names[: 5 + ids])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return plain(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Combinations of lengths, and how many bins each fills, that use up ``counts``."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c}
    if left and (max(left) > capacity or min(left) < 1):
        raise ValueError(f"lengths must be 1 to {capacity}")
    out = []
    while left:
        longest = next(iter(left))
        room = capacity - longest
        fits = (1 << (room + 1)) - 1
        sums, layers = 1, []  # bit s: the lengths so far can add up to s
        if room:
            for n, c in left.items():
                c = min(c - (n == longest), room // n)
                step = 1
                while c > 0:  # c copies, as 1, 2, 4, ... and the rest
                    step = min(step, c)
                    layers.append((n, step, sums))
                    sums |= (sums << (n * step)) & fits
                    c -= step
                    step *= 2
                if sums >> room & 1:
                    break
        want, use = sums.bit_length() - 1, {longest: 1}
        for n, step, below in reversed(layers):
            if not below >> want & 1:
                want -= n * step
                use[n] = use.get(n, 0) + step
        times = min(left[n] // k for n, k in use.items())
        out.append(([n for n, k in use.items() for _ in range(k)], times))
        for n, k in use.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (a stored table with doc_id, piece, length, ids_crc32) plus sequence_id and offset.

    Pieces without a doc_id are dealt by what they hold, so only equal ones meet."""
    groups = max(1, math.ceil(pieces.count() / group))

    def run(key, table):
        length = table.column("length").to_numpy()
        order = np.argsort(length, kind="stable")
        sizes, first, count = np.unique(length[order], return_index=True, return_counts=True)
        at = dict(zip(sizes.tolist(), first.tolist(), strict=True))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        number = 0
        for lengths, times in plan(dict(zip(sizes.tolist(), count.tolist(), strict=True)), capacity):
            place = 0
            for n in lengths:
                rows = order[at[n] : at[n] + times]
                sequence[rows] = np.arange(number, number + times)
                offset[rows] = place
                at[n] += times
                place += n
            number += times
        sequence += key[0].as_py() << 40
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(groups)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(run, schema)


def packed(docs: DataFrame, tokenizer_file: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Each piece's place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(tokenized(docs, tokenizer_file, pattern, ids=False, capacity=capacity), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer_file: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids, doc_ids."""
    pieces = stored(tokenized(docs, tokenizer_file, pattern, capacity=capacity), "pieces")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        pack(pieces, capacity).groupBy("sequence_id").agg(ordered.alias("p"), F.sum("length").alias("n_tokens"))
        .select("sequence_id", "n_tokens", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
    )
