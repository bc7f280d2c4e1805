"""Near-duplicate classes by order MinHash and banded alignment.

A text's k-mers are its runs of ``K`` consecutive words, each labelled with how
often it has occurred before in the text. Each of ``SKETCHES`` hash functions
picks the ``PICKED`` labelled k-mers of least hash; these, in text order, make
a key. Texts that share a key are candidates. The similarity of two texts is
m / (n1 + n2 - m), where m is the length of the longest common subsequence of
their k-mer sequences within the band that the threshold leaves; texts of
similarity ``SIMILARITY`` or more are linked. Linked texts form classes.

Texts with equal word sequences are one text from the start. What counts is which
texts hang together, so a pair is aligned only while its texts are in different
classes. Texts are first aligned to the leaders (least texts) of their buckets (texts
with one key), one leader a text and then the others, and classes are formed after
each: a family of n near copies takes about n alignments, however many buckets they
share. Texts outside of their leader's class then get the least of them as leader.
What then stands in buckets of several classes is joined exactly, not pair by pair: a
text's k-mers are ordered by how many of these texts hold them, and two similar
texts have one in common among the rarest fifth of each. The texts with such a k-mer
are led by one of them in turn, like those of a bucket, the one whose k-mers are the
commonest first. Pairs that are still of
different classes and that bounds by size, shared k-mers and k-mer parities don't
rule out are aligned, the most promising of each two classes first, and the others
only if the classes are still apart. So no link between classes is lost, and nothing is capped.

A text of under ``K`` words has one k-mer, all its words. Texts without words
(null, empty) and rows without a doc_id are each a class of their own (the latter
without an id). The class id is its least doc_id. Repeated rows of a doc_id are one
document, with the text of least digest. An empty table gives no rows. Columns beside doc_id and text are not looked at (``dedup`` keeps them).
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Spans, chunks, flat, looked_up, mix, plain, release, signed, stored, word_hashes, word_spans

K = 5
PICKED = 3
SKETCHES = 14
SIMILARITY = 0.8
PLACE_BITS = 24
#: Leaders in turn of a bucket, and of the texts with a rare k-mer, before the rest is joined; a turn
#: that joins no classes is the last.
LEADERS = (2, 4)
#: Pairs of two classes that the rounds after that align at most; the last takes all that are left.
TRIES = (1, 30)
PARITY = 32
FOLDED = 4
#: Bounds that rule a pair out give way by so much, so that rounding rules out no pair at the threshold.
SLACK = 1e-6


def _kmers(words: np.ndarray, bounds: np.ndarray, k: int):
    """Hashes of the k-mers of all texts, and their offsets by text."""
    sizes = np.diff(bounds)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(sizes)), counts)
    start = bounds[row] + np.arange(offsets[-1]) - offsets[row]
    return Spans(words)(start, np.minimum(start + k, bounds[row + 1])), offsets, row


def _occurrence(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each k-mer has occurred before in its text."""
    key = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - np.repeat(fresh, np.diff(fresh, append=len(h)))
    return out


def sketch(docs: DataFrame, k: int = K, picked: int = PICKED, sketches: int = SKETCHES) -> DataFrame:
    """doc_id, digest (of the words), size (k-mers) and keys of every text; no keys without words."""

    def run(batches):
        seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        mask = np.uint64((1 << PLACE_BITS) - 1)
        for chunk in chunks(batches):
            data, off = flat(chunk.column("text"))
            start, end, bounds = word_spans(data, off)
            h, offsets, row = _kmers(word_hashes(data, start, end), bounds, k)
            full = np.flatnonzero(np.diff(offsets))
            keys = np.zeros((len(full), sketches), np.uint64)
            if len(full):
                labelled = mix(h + _occurrence(h, row).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                place = np.arange(len(h), dtype=np.uint64)
                for s in range(sketches):
                    v = (mix(labelled ^ seeds[s]) & ~mask) | place
                    found = np.empty((len(full), picked), np.int64)
                    for p in range(picked):
                        least = np.minimum.reduceat(v, offsets[full])
                        found[:, p] = np.where(least == np.uint64(0xFFFFFFFFFFFFFFFF), len(h), (least & mask).astype(np.int64))
                        v[found[found[:, p] < len(h), p]] = np.uint64(0xFFFFFFFFFFFFFFFF)
                    found.sort(1)
                    value = np.append(h, np.uint64(0))[found]
                    key = np.full(len(full), seeds[s])
                    for p in range(picked):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + value[:, p])
                    keys[:, s] = key
            ends = np.zeros(len(chunk) + 1, np.int32)
            ends[full + 1] = sketches
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(_digests(data, off), pa.binary()), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(signed(keys.ravel())))],
                ["doc_id", "digest", "size", "keys"],
            )

    return plain(docs).mapInArrow(run, "doc_id long, digest binary, size long, keys array<long>")


def common(x: list, y: list, band: int) -> int:
    """Length of the longest common subsequence with partners at most ``band`` apart.

    Bit-parallel: bit i of ``free`` is 0 where the best length grows at x[i]. Only
    the bits inside the band are kept."""
    places: dict = {}
    for i, c in enumerate(x):
        places.setdefault(c, []).append(i)
    low = high = done = free = 0
    for j, c in enumerate(y):
        to = min(len(x), j + band + 1)
        if to > high:
            free |= ((1 << (to - high)) - 1) << (high - low)
            high = to
        if (gone := min(j - band, high) - low) > 0:
            done += gone - (free & ((1 << gone) - 1)).bit_count()
            free >>= gone
            low += gone
        match = 0
        for i in places.get(c, ()):
            if low <= i < high:
                match |= 1 << (i - low)
        if match := free & match:
            free = ((free + match) | (free - match)) & ((1 << (high - low)) - 1)
    return done + (high - low) - free.bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two k-mer sequences reach the similarity."""
    need = int(np.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[::-1][: n - head] != b[::-1][: n - head])
    tail = int(differ[0]) if len(differ) else n - head
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    rest = need - head - tail
    if rest <= 0:
        return True
    if np.isin(x, y).sum() < rest or np.isin(y, x).sum() < rest:
        return False
    return common(x.tolist(), y.tolist(), len(x) + len(y) - 2 * rest) >= rest


def _aligned(pairs: DataFrame, words: DataFrame, k: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar."""

    def run(batches):
        for batch in batches:
            keep = []
            for wa, wb in zip(batch.column("wa"), batch.column("wb"), strict=True):
                x, y = (np.frombuffer(w.as_buffer(), np.uint32).astype(np.uint64) for w in (wa, wb))
                keep.append(similar(*(_kmers(w, np.array([0, len(w)]), k)[0] for w in (x, y)), least))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    one = words.select(F.col("doc_id").alias("a"), F.col("words").alias("wa"), F.col("parity").alias("aparity"))
    two = words.select(F.col("doc_id").alias("b"), F.col("words").alias("wb"), F.col("parity").alias("bparity"))
    count = lambda w: F.greatest(F.octet_length(w) / 4 - (k - 1), F.lit(1.0))
    able = pairs.join(one, "a").join(two, "b").where(_even(count("wa") + count("wb"), least))
    return able.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def _fits(x, y, similarity: float):
    """Whether two texts of x and y k-mers can reach the similarity."""
    return F.least(x, y) >= similarity * F.greatest(x, y) - SLACK


def _open(x: DataFrame, y: DataFrame, similarity: float) -> DataFrame:
    """aid, bid, gap (the share of cells of the parities that differ) of the pairs of different classes that meet
    at a k-mer (token) and that no bound rules out there. Texts list their k-mers in one order; ``before``
    of them come before the token, ``shared`` there are. If the token is the first that the two have in
    common, they have at most as many as come from there on; so a similar pair is not ruled out at its first."""
    both = F.col("asize") + F.col("bsize")
    able = (F.col("aclass_id") != F.col("bclass_id")) & (F.col("aid") < F.col("bid")) & _fits(F.col("asize"), F.col("bsize"), similarity)
    rest = F.least(F.col("ashared") - F.col("abefore"), F.col("bshared") - F.col("bbefore"))
    able &= rest * (1 + similarity) >= similarity * both - SLACK
    able &= _even(both, similarity, _differ("fold", FOLDED))  # few words first, as most pairs end there
    able &= _even(both, similarity)
    return x.join(y, "token").where(able).select("aid", "bid", (_differ() / both).alias("gap"))


def _differ(column: str = "parity", words: int = PARITY):
    """In how many cells the parities aparity and bparity differ: at most as many k-mers as are not common."""
    return sum((F.bit_count(F.get(f"a{column}", F.lit(i)).bitwiseXOR(F.get(f"b{column}", F.lit(i)))) for i in range(words)), F.lit(0))


def _even(both, least: float, differ=None):
    """Whether parities let two texts of ``both`` k-mers together reach the similarity."""
    return (_differ() if differ is None else differ) * (1 + least) <= (1 - least) * both + SLACK


def _folded(parity: str, i: int):
    """Word i of a parity folded to ``FOLDED`` words: the parity of fewer, larger cells, with the same bound."""
    out = F.get(parity, F.lit(i))
    for k in range(i + FOLDED, PARITY, FOLDED):
        out = out.bitwiseXOR(F.get(parity, F.lit(k)))
    return out


def _parity(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, ``PARITY`` words of 64 bits: whether an odd number of its k-mers fall there."""
    n, bits = len(offsets) - 1, 64 * PARITY
    out = np.zeros((n, PARITY), np.int64)
    for at in range(0, n, 1000):
        to = min(n, at + 1000)
        row = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))
        cell = row * bits + (h[offsets[at] : offsets[to]] % np.uint64(bits)).astype(np.int64)
        odd = (np.bincount(cell, minlength=(to - at) * bits) & 1).astype(np.uint8)
        out[at:to] = np.packbits(odd.reshape(to - at, bits), axis=1).view(np.int64)
    return out


def _digests(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Of each text's words."""
    return [hashlib.md5(b" ".join(data[a:b].tobytes().split()), usedforsecurity=False).digest() for a, b in zip(off, off[1:], strict=False)]


def _words(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id, words (32-bit hashes, as binary) and parity (of the k-mers) of the texts in ``ids`` (doc_id, digest)."""

    def run(batches):
        for chunk in chunks(batches):
            data, off = flat(chunk.column("text"))
            same = np.array([a == b for a, b in zip(_digests(data, off), chunk.column("digest").to_pylist(), strict=True)])
            start, end, bounds = word_spans(data, off)
            h = word_hashes(data, start, end)
            parity = _parity(*_kmers(h, bounds, k)[:2])
            h = (h >> np.uint64(32)).astype(np.uint32)
            rows = [h[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(rows, pa.binary()), pa.array(list(parity), pa.list_(pa.int64()))], ["doc_id", "words", "parity"]).filter(pa.array(same))

    # a merge join at every size: ids grow with the documents
    return plain(docs).join(ids.hint("merge"), "doc_id").select("doc_id", "text", "digest").mapInArrow(run, "doc_id long, words binary, parity array<long>")


def _tokens(words: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, token: the k-mers, labelled by occurrence, of the texts in ``ids`` (id)."""

    def run(batches):
        for batch in batches:
            for id_, raw in zip(batch.column("doc_id").to_pylist(), batch.column("words").to_pylist(), strict=True):
                w = np.frombuffer(raw, np.uint32).astype(np.uint64)
                h = _kmers(w, np.array([0, len(w)]), k)[0]
                h = mix(h + _occurrence(h, np.zeros(len(h), np.int64)).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), id_)), pa.array(signed(h))], ["id", "token"])

    return words.join(ids, words["doc_id"] == ids["id"], "left_semi").mapInArrow(run, "id long, token long")


def components(links: DataFrame) -> DataFrame:
    """id and class_id (least id) of every end of ``links`` (a, b): least labels spread over
    the links, then over the labels themselves, until nothing changes."""
    both = stored(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("class_id")), "labels")
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("class_id").alias("near"))
        step = label.join(near, label["id"] == near["a"]).select("id", F.col("class_id").alias("was"), F.least("class_id", "near").alias("to"))
        jump = label.select(F.col("id").alias("to"), F.col("class_id").alias("next"))
        new = stored(step.join(jump, "to").select("id", "was", F.least("to", "next").alias("class_id")), "labels")
        moved = not new.where("class_id != was").isEmpty()
        release(links.sparkSession, label)
        label = new.select("id", "class_id")
        if not moved:
            release(links.sparkSession, both)
            return label


def classes(docs: DataFrame, k: int = K, picked: int = PICKED, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_links (links found between the document's text and different texts;
    enough to join the class, not all there are) of every document. A stored table."""
    spark = docs.sparkSession
    every = stored(sketch(docs, k, picked, sketches), "sketches")
    full = every.where("size > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("digest", "size", "keys")).alias("t")).select("doc_id", "t.*")
    full = stored(full, "full")
    texts = full.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    texts = stored(texts, "texts")
    held = texts.select("id", "size", F.explode("keys").alias("key"))
    shared = stored(held.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "keys")
    member = looked_up(held, shared, ["key"], "times").where("times is not null").select("key", "id", "size")
    member = stored(member, "buckets")
    ids = texts.select(F.col("id").alias("doc_id"), "digest").join(member.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    words = stored(_words(docs, ids, k), "words")
    fits = lambda x, y: _fits(x, y, similarity)

    links = spark.createDataFrame([], "a long, b long")
    tried, made = links, []
    label = spark.createDataFrame([], "id long, class_id long")

    def align(pairs: DataFrame) -> bool:
        """Aligns ``pairs`` (a, b), which are new and stored; whether classes were joined."""
        nonlocal links, tried, label
        moved = False
        made.append(pairs)
        if not pairs.isEmpty():
            found = stored(_aligned(pairs, words, k, similarity), "aligned")
            links, tried = links.unionAll(found), tried.unionAll(pairs)
            made.append(found)
            joined = stored(apart(found, "a", "b").select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).distinct(), "joined")
            moved = not joined.isEmpty()
            if moved:  # links between classes, one of each two, are all that moves labels
                to = components(joined)
                ids = label.unionAll(found.select(F.col("a").alias("id"), F.col("a").alias("class_id"))).unionAll(found.select("b", F.col("b").alias("class_id")))
                ids = ids.groupBy("id").agg(F.min("class_id").alias("class_id"))
                to = to.select(F.col("id").alias("class_id"), F.col("class_id").alias("to"))
                old, label = label, stored(ids.join(to, "class_id", "left").select("id", F.coalesce("to", "class_id").alias("class_id")), "labels")
                release(spark, old, to)
            release(spark, joined)
        return moved

    def apart(rows: DataFrame, *ends: str) -> DataFrame:
        """``rows`` of different classes at the columns ``ends``, with the classes as a_class, b_class."""
        for end, name in zip(ends, ("a_class", "b_class"), strict=True):
            rows = rows.join(label.select(F.col("id").alias(end), F.col("class_id").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
        return rows.where("a_class != b_class")

    def lead(groups: DataFrame, rounds: int) -> None:
        """Aligns the texts of ``groups`` (key, id, size, place) to their group's leaders, those of least
        place. At first to the nearest in size of a text's leaders, then to all others."""
        left = groups
        for step in range(rounds):
            leader = left.groupBy("key").agg(F.min(F.struct("place", "id", "size")).alias("first"), F.count("*").alias("times")).where("times > 1")
            leader = stored(leader.select("key", F.col("first.id").alias("a"), F.col("first.size").alias("a_size"), "times"), "leaders")
            led = stored(looked_up(left, leader, ["key"], "times").where("a != id").drop("times"), "led")
            star = led.where(fits(F.col("size"), F.col("a_size"))).select("a", F.col("id").alias("b"), F.abs(F.col("size") - F.col("a_size")).alias("gap")).distinct()
            star = stored(apart(star.join(tried, ["a", "b"], "left_anti"), "a", "b").select("a", "b", "gap"), "stars")
            moved = False
            if not step and not star.isEmpty():
                one = stored(star.groupBy("b").agg(F.min_by("a", F.struct("gap", "a")).alias("a")).select("a", "b"), "pairs")
                moved = align(one)
                star, old = stored(apart(star, "a", "b").select("a", "b", "gap").join(one, ["a", "b"], "left_anti"), "stars"), star
                release(spark, old)
            moved |= align(star.select("a", "b"))
            old, last = left, not moved or step + 1 == rounds
            if not last:
                left = stored(apart(led.withColumnRenamed("id", "b"), "a", "b").select("key", F.col("b").alias("id"), "size", "place"), "left")
            release(spark, leader, led)
            if old is not groups:
                release(spark, old)
            if last:
                break

    lead(member.withColumn("place", F.lit(0.0)), LEADERS[0])

    def settle() -> None:
        """What is left: texts in buckets of several classes. A step that leaves none ends it, as
        plans over empty tables take driver memory too."""
        named = member.select("key", "id", "size").join(label, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
        several = named.groupBy("key").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y"), F.count("*").alias("times")).where("x != y")
        several = stored(several.select("key", "times"), "several")
        mixed = looked_up(named, several, ["key"], "times").where("times is not null").select("id", "size", "class_id").distinct()
        mixed = stored(mixed, "members")
        made.extend((several, mixed))
        if mixed.isEmpty():
            return
        tokens = stored(_tokens(words, mixed.select("id"), k), "tokens")
        texts_with = stored(tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1"), "frequencies")
        made.extend((tokens, texts_with))
        held = looked_up(tokens, texts_with, ["token"], "times").where("times is not null")
        held = held.groupBy("id").agg(F.count("*").alias("shared"), F.array_sort(F.collect_list(F.struct("times", "token"))).alias("tokens"), F.sum(F.log("times")).alias("common"))
        able = mixed.join(held, "id").where(F.col("shared") >= similarity * F.col("size") - SLACK)
        # of a text's rarest k-mers those that no other text holds come first; they can't be common to two
        first = F.col("shared") - F.ceil(similarity * F.col("size") - SLACK) + 1
        able = able.select("id", "size", "shared", "class_id", (-F.col("common") / F.col("size")).alias("place"), F.posexplode(F.slice("tokens", 1, first.cast("int"))["token"]).alias("before", "token"))
        able = stored(able, "able")
        made.append(able)
        # first whose k-mers the most texts hold: of edits of one text it is the one least edited
        lead(able.select(F.col("token").alias("key"), "id", "size", "place"), LEADERS[1])
        able = able.drop("class_id").join(label, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
        several = able.groupBy("token").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y")).where("x != y").select("token")
        some = able.join(several, "token", "left_semi").join(words.select(F.col("doc_id").alias("id"), "parity", F.array(*(_folded("parity", i) for i in range(FOLDED))).alias("fold")), "id")
        some = stored(some.select("token", "id", "size", "shared", "before", "class_id", "parity", "fold"), "some")
        made.append(some)
        if some.isEmpty():
            return
        x, y = (some.select("token", *(F.col(c).alias(n + c) for c in ("id", "size", "shared", "before", "class_id", "parity", "fold"))) for n in "ab")
        open_ = _open(x, y, similarity)
        open_ = open_.groupBy(F.col("aid").alias("a"), F.col("bid").alias("b")).agg(F.min("gap").alias("gap"))
        left = stored(open_.join(tried, ["a", "b"], "left_anti"), "open")
        made.append(left)
        for most in (*TRIES, None):
            if left.isEmpty():
                return
            now = apart(left, "a", "b")
            if most is not None:  # of each two classes the pair of least bounds, then about ``most`` by hash
                ends = [F.least("a_class", "b_class").alias("u"), F.greatest("a_class", "b_class").alias("v")]
                now = now.select(*ends, F.struct("gap", "a", "b").alias("p"))
                if most == 1:
                    now = now.groupBy("u", "v").agg(F.min("p").alias("p"))
                else:
                    size = stored(now.groupBy("u", "v").agg(F.count("*").alias("times")), "sizes")
                    made.append(size)
                    now = looked_up(now, size, ["u", "v"], "times").where(F.pmod(F.xxhash64("p"), F.lit(1 << 30)) * F.col("times") < (most << 30))
                now = now.select("p.a", "p.b")
            now = stored(now.select("a", "b"), "pairs")
            align(now)
            if most is not None:
                old, left = left, stored(apart(left, "a", "b").select("a", "b", "gap").join(now, ["a", "b"], "left_anti"), "open")
                made.append(left)
                release(spark, old)

    settle()
    ends = links.select("a").unionAll(links.select("b")).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_links"))
    named = texts.select("digest", "id").join(label, "id", "left").join(ends, "id", "left")
    named = full.select("doc_id", "digest").join(named, "digest").select("doc_id", F.coalesce("class_id", "id").alias("class_id"), "n_links")
    out = every.select(F.col("doc_id").alias("of"), "size").join(named, F.col("of") == F.col("doc_id"), "left").select(
        F.col("of").alias("doc_id"), F.coalesce("class_id", "of").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    out = stored(out, "classes")
    release(spark, every, full, texts, shared, member, words, label, *made)
    return out


def dedup(docs: DataFrame, **more) -> DataFrame:
    """``docs`` with the least doc_id of each class; rows without a doc_id stay."""
    gone = classes(docs, **more).where("doc_id != class_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)
