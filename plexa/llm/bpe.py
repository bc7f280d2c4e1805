"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a slice of the corpus are split into byte tokens that
stand in one long linked list. An inverted index maps each merge rank to the
positions whose pair makes it. Ranks are replayed in order; a merge touches
only its two neighbours, whose new pairs enter the index. Every piece is
replayed once for the slice, however often it occurs; documents are put
together from the replayed pieces.

Null and empty texts have no tokens. A text of any length is encoded whole.
Every row gets a result, also if its doc_id is repeated or null; an empty table
gives none. Columns beside doc_id and text are not looked at.
"""

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import Units, chunks, plain

#: Units that a task remembers before it starts anew.
REMEMBERED = 800_000
#: Distinct pieces of one replay at most.
SLICE = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes and decodes with the merges that ``ranks`` implies."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.bytes = np.array([*(ranks[bytes([i])] for i in range(256)), -1])
        self.byte_pairs = np.full((257, 257), -1, np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank
        self.keys, self.made = (np.array(x) for x in zip(*sorted(pairs.items()), strict=True))

    def _made(self, left, right) -> np.ndarray:
        """Ranks that pairs of tokens make; -1: none."""
        key = np.bitwise_or(np.left_shift(left, 32), right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (np.minimum(left, right) >= 0), self.made[at], -1)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece, after replaying the merges over all of them."""
        return [ids for at in range(0, len(pieces), SLICE) for ids in self._replayed(pieces[at : at + SLICE])]

    def _replayed(self, pieces: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        spans, parts, at = [], [], 1
        ranks = self.ranks
        for k, piece in enumerate(pieces):
            raw = piece.encode("utf-8", "surrogatepass")
            if (rank := ranks.get(raw)) is not None:
                out[k] = [rank]
                continue
            parts.append(raw)
            spans.append((k, at, at + len(raw)))
            at += len(raw) + 1
        # positions: a border, then the bytes of a piece and a border, and so on
        code = np.full(at, 256)
        inside = np.ones(at, bool)
        inside[[0, *(end for _, _, end in spans)]] = False
        code[inside] = np.frombuffer(b"".join(parts), np.uint8)
        token = self.bytes[code]  # -1: a border; -2: merged into an earlier one
        makes = np.append(self.byte_pairs[code[:-1], code[1:]], -1)  # rank of the pair begun here; -1: none
        after, before = np.arange(1, at + 1), np.arange(-1, at - 1)
        index: dict[int, list] = {}
        order: list[int] = []

        def enter(ranks, places):
            by_rank = np.argsort(ranks, kind="stable")
            ranks, places = ranks[by_rank], places[by_rank]
            first = np.flatnonzero(np.diff(ranks, prepend=-1))
            for rank, some in zip(ranks[first].tolist(), np.split(places, first[1:]), strict=False):
                if (known := index.get(rank)) is None:
                    index[rank] = [some]
                    heapq.heappush(order, rank)
                else:
                    known.append(some)

        where = np.flatnonzero(makes >= 0)
        enter(makes[where], where)
        taken = np.zeros(at, bool)
        while order:
            rank = heapq.heappop(order)
            i = index.pop(rank)
            i = i[0] if len(i) == 1 else np.unique(np.concatenate(i))
            i = i[makes[i] == rank]  # else an earlier merge took one of the two
            if not len(i):
                continue
            j = after[i]
            taken[i] = True
            overlaps = taken[j].any()
            taken[i] = False
            if overlaps:  # from left to right, as "aaa" is "aa", "a"
                keep, last = np.ones(len(i), bool), -1
                for n, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                    keep[n] = x != last
                    last = y if x != last else -1
                i, j = i[keep], j[keep]
            k = after[j]
            token[i], token[j] = rank, -2
            makes[j] = -1
            after[i], before[k] = k, i
            h = before[i]
            left, right = token[h], token[k]
            makes[i] = onward = self._made(rank, right)
            behind = self._made(left, rank)
            inside = left >= 0
            makes[h[inside]] = behind[inside]
            new, places = np.concatenate([onward, behind]), np.concatenate([i, h])
            some = new >= 0
            if some.any():
                enter(new[some], places[some])
        tokens = token.tolist()
        for k, start, end in spans:
            out[k] = [t for t in tokens[start:end] if t >= 0]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        distinct = list(dict.fromkeys(p for pieces in split for p in pieces))
        ids = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
        return [[i for p in pieces for i in ids[p]] for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    return _mapped(docs, rank_file, pattern, False)


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes of every text."""
    return _mapped(docs, rank_file, pattern, True)


def _mapped(docs: DataFrame, rank_file: str, pattern: str, digest: bool) -> DataFrame:
    def run(batches):
        replay = MergeReplay(read_ranks(rank_file), pattern)

        def made(texts):
            ids = replay.encode(texts)
            return [("".join([f" {i}" for i in x]), replay.decode(x)) for x in ids] if digest else ids

        units = Units(made, REMEMBERED)
        for chunk in chunks(batches, limit=6 << 20):
            out = []
            for found in units(chunk.column("text").to_pylist()):
                if digest:
                    ids = "".join([x[0] for x in found])
                    raw = b"".join([x[1] for x in found])
                    out.append((ids.count(" "), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
                else:
                    out.append([i for ids in found for i in ids])
            if digest:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(a, pa.int64()), pa.array(b), pa.array(c)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>"
    return plain(docs).mapInArrow(run, schema)
