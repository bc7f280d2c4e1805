"""Quality rules over documents, and cross-document line frequency. DataFrame functions only.

Base rules look at one text. The line rule normalises every line (lower case,
white space squeezed), hashes it with its host (``source``), and counts the
host's documents that hold it. A line is boilerplate if those are at least
``least_docs`` and more than ``growth`` times the square root of the host's
documents: the limit grows with a host, but far slower than the host does.
Boilerplate lines are removed; a document left with under ``least_words`` words,
or under ``least_kept`` of its words, is depleted and rejected.

Null texts have no words. Null hosts are one host of their own. Documents are
told apart by doc_id: rows of one doc_id count once for a line, and rows
without a doc_id for none. Every row gets a result, from its own text; equal
rows get equal ones. Texts are read whole, in one row; columns beside doc_id,
text and source are not looked at. An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, fresh, stored

LEAST_DOCS = 20
GROWTH = 1.0
LEAST_WORDS = 5
LEAST_KEPT = 0.3
WINDOW = 8
BLANKS = " \t\n\x0b\x0c\r"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once for a row, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _covered(windows: Column, n: int) -> Column:
    """Positions that repeated windows cover; a window is known by its 64-bit hash."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(p: Column) -> Column:
        hash_at = lambda k: F.get(p, k)["h"]
        shared = lambda x, k: x["h"].eqNullSafe(hash_at(k - 1)) | x["h"].eqNullSafe(hash_at(k + 1))
        return F.array_sort(F.transform(F.filter(p, shared), lambda x: x["i"]))

    return F.aggregate(
        _let(placed, positions),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + n - F.greatest(i, s["end"])).alias("n"), (i + n).alias("end")),
        lambda s: s["n"],
    )


def _repeated(words: Column, n: int) -> Column:
    """Words covered by windows of ``n`` words that stand twice or more in ``words``."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n))))
    found = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w, n)))
    return F.when(F.size(words) <= n, F.lit(0)).otherwise(found).cast("long")


def base(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the
    columns ``more`` of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    blank = lambda x: F.length(F.translate(x, BLANKS, "")) == 0
    lines = F.filter(F.split(text, "\n"), lambda x: ~blank(x))
    measured = _let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w, WINDOW).alias("n_repeat_words")))
    return docs.select(
        "doc_id",
        measured.alias("m"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.struct(F.lit(0).alias("none"), *more).alias("more"),
    ).select(
        "doc_id", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words",
        ((F.col("m.n_words") < 20) | (100 * F.col("m.n_repeat_words") > 30 * F.col("m.n_words"))).alias("base_failed"),
        "more.*",
    ).drop("none")


def _host() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _lines() -> Column:
    """The normalised lines of a text that are not blank, with repeats."""
    squeezed = lambda x: F.trim(F.regexp_replace(F.lower(x), f"[{SPACE}]+", " "))
    return F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), squeezed), lambda x: x != "")


def boilerplate(docs: DataFrame, least_docs: int = LEAST_DOCS, growth: float = GROWTH) -> DataFrame:
    """host, line (hashes of the host, and of host and line) and docs, of the lines above the limits."""
    hosts = docs.groupBy(F.xxhash64(_host()).alias("host")).agg(F.count_distinct("doc_id").alias("host_docs"))
    once = docs.where("doc_id is not null").select("doc_id", _host().alias("h"), F.explode(F.array_distinct(_lines())).alias("line"))
    counts = (
        once.select("doc_id", F.xxhash64("h").alias("host"), F.xxhash64("h", "line").alias("line"))
        .groupBy("host", "line").agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") >= least_docs)
    )
    return counts.join(hosts, "host").where(F.col("docs") > growth * F.sqrt("host_docs")).select("host", "line", "docs")


def _row() -> list[Column]:
    """Hashes that tell rows of one doc_id apart by text and host."""
    return [F.xxhash64(F.lit(n), F.coalesce("text", F.lit("")), _host(), F.col("text").isNull()).alias(f"row{n}") for n in (0, 1)]


def _of_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` left joined with ``right`` (id, row0, row1 and more) by doc_id and row hashes; null ids meet."""
    on = left["doc_id"].eqNullSafe(right["id"]) & (left["row0"] == right["r0"]) & (left["row1"] == right["r1"])
    return left.join(right, on, "left").drop("id", "r0", "r1", "row0", "row1")


def judge(docs: DataFrame, least_docs: int = LEAST_DOCS, growth: float = GROWTH, least_words: int = LEAST_WORDS, least_kept: float = LEAST_KEPT) -> DataFrame:
    """The base columns, n_removed_words and kept of every document.

    The boilerplate lines are stored first, so that Spark knows their size and
    broadcasts them only if it is under its threshold.
    """
    common = stored(boilerplate(docs, least_docs, growth), "lines").select("host", "line")
    held = docs.select("doc_id", *_row(), _host().alias("h"), F.posexplode(_lines()).alias("at", "text")).select(
        F.col("doc_id").alias("id"), F.col("row0").alias("r0"), F.col("row1").alias("r1"), "at",
        F.xxhash64("h").alias("host"), F.xxhash64("h", "text").alias("line"), F.size(F.split("text", " ")).cast("long").alias("n"),
    )
    lost = held.join(common, ["host", "line"]).groupBy("id", "r0", "r1", "at").agg(F.max("n").alias("n"))  # equal rows' lines count once
    lost = lost.groupBy("id", "r0", "r1").agg(F.sum("n").alias("n_removed_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        _of_row(base(docs, *_row()), lost).fillna(0, ["n_removed_words"])
        .withColumn("kept", ~F.col("base_failed") & ((F.col("n_removed_words") == 0) | (left >= least_words) & (left >= least_kept * F.col("n_words"))))
    )


def cleaned(docs: DataFrame, least_docs: int = LEAST_DOCS, growth: float = GROWTH) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the texts. Null texts stay null.

    Line places are kept as an array beside the text; only hashes travel.
    """
    gone, names = fresh("_drop", docs), docs.columns
    common = stored(boilerplate(docs, least_docs, growth), "lines").select("host", "line")
    squeezed = lambda x: F.trim(F.regexp_replace(F.lower(x), f"[{SPACE}]+", " "))
    lines = docs.select(F.col("doc_id").alias("id"), *_row(), _host().alias("h"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("id", F.col("row0").alias("r0"), F.col("row1").alias("r1"), "at", F.xxhash64("h").alias("host"), F.xxhash64("h", squeezed(F.col("line"))).alias("line"))
    drop = lines.join(common, ["host", "line"]).groupBy("id", "r0", "r1").agg(F.collect_set("at").alias(gone))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("all"), "doc_id", *_row())
    kept = F.array_join(F.filter(F.split("all.text", "\n"), lambda x, i: ~F.coalesce(F.array_contains(gone, i), F.lit(False))), "\n")
    return _of_row(rows, drop).select(*(kept.alias(c) if c == "text" else F.col(f"all.`{c}`").alias(c) for c in names))
