"""Every corpus query on empty tables, and on nulls, ties, repeated rows and clashing columns."""

import hashlib
import zlib

import pytest

from plexa.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _write(spark, folder, docs, labels, vectors, more=()):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(docs, DOCS)
    for name in more:
        d = d.withColumn(name, F.lit("extra"))
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    docs = [(i, t, lang, source, 1) for i, (t, lang, source) in enumerate([(None, "en", None), ("", None, "s"), ("a", "en", "s"), (long, "de", "s"), (long, "de", "s"), ("x" * 100_000, None, None), ("é\x00\x1c 　", "fr", "")])]
    docs += [docs[2], docs[3], (None, "no id", "en", "s", 5)]
    return _write(spark, tmp_path_factory.mktemp("awkward"), docs, [(0, 1, 1), (0, 1, 0), (3, 1, None), (None, 1, 1), (99, 0, 0), *((i, 1, 0) for i in (1, 2, 5, 6))], [(0, None, 1), (50, [1.0, None], 1), (100, [1.0, 2.0], 1), (101, [1.0, 2.0], 1), (102, [], 1)], ("tag", "_tag", "covered", "keys", "score", "h"))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", queries.QUERIES)
def test_awkward(spark, awkward, name):
    rows = queries.QUERIES[name](spark, awkward).collect()
    if name.startswith("op9"):
        assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(100, 1, 101, 327680), (100, 2, 102, 0)]
    elif name.startswith("op7"):
        assert len({(r["doc_id"], r["piece"]) for r in rows}) >= 8
    else:
        assert len(rows) == 10


def _results(spark, folder, name):
    """doc_id -> the row's other values, as equal rows have equal ones."""
    out = {}
    for r in queries.QUERIES[name](spark, folder).collect():
        values = {k: v for k, v in r.asDict().items() if k != "doc_id"}
        assert out.setdefault(r["doc_id"], values) == values, (name, r["doc_id"])
    assert set(out) == {0, 1, 2, 3, 4, 5, 6, None}
    return out


#: Words of the documents by id: null, empty, one letter, a long text and its copy, a long word, odd characters, and the one without an id.
WORDS = {0: 0, 1: 0, 2: 1, 3: 30_000, 4: 30_000, 5: 1, 6: 2, None: 2}
TEXTS = {0: "", 1: "", 2: "a", 3: " ".join(f"w{i % 977}" for i in range(30_000)), 5: "x" * 100_000, 6: "é\x00\x1c \u3000", None: "no id"}
TEXTS[4] = TEXTS[3]


def _held(doc_id, of):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % of == 0


def test_values_of_op1(spark, awkward):
    got = _results(spark, awkward, "op1_substrings")
    assert {i: r["n_words"] for i, r in got.items()} == WORDS
    assert {i: r["n_removed"] for i, r in got.items() if r["n_removed"]} == {4: 30_000}
    assert all(r["kept_sha256"] == hashlib.sha256(b" ".join(TEXTS[i].encode().split()) if i != 4 else b"").hexdigest() for i, r in got.items())


def test_values_of_op2(spark, awkward):
    got = _results(spark, awkward, "op2_toxicity")
    assert got[0]["score"] == got[1]["score"] and got[3]["score"] == got[4]["score"]
    assert all(r["held_out"] == _held(i, 5) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())


def test_values_of_op3(spark, awkward):
    got = _results(spark, awkward, "op3_bpe")
    assert all(r["decoded_sha256"] == hashlib.sha256(TEXTS[i].encode()).hexdigest() and (r["n_tokens"] == 0) == (TEXTS[i] == "") for i, r in got.items())


def test_values_of_op4(spark, awkward):
    got = _results(spark, awkward, "op4_neardup")
    assert {i: r["class_id"] for i, r in got.items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, None: None}


def test_values_of_op5(spark, awkward):
    got = _results(spark, awkward, "op5_secrets")
    nothing = hashlib.sha256(b"").hexdigest()
    assert all((r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (0, 0, 0, nothing) for r in got.values())


def test_values_of_op6(spark, awkward):
    got = _results(spark, awkward, "op6_mixing")
    assert {i: r["n_tokens"] - 1 for i, r in got.items()} == WORDS
    assert all(r["held_out"] == _held(i, 10) for i, r in got.items()) and got[0]["score"] == got[1]["score"] and got[3]["score"] == got[4]["score"]
    trained = [i for i in (0, 1, 2, 3, 4, 5, 6, 2, 3) if not _held(i, 10)]
    assert {r["train_tokens"] for r in got.values()} == {sum(WORDS[i] + 1 for i in trained)}


def test_values_of_op7(spark, awkward):
    rows = queries.QUERIES["op7_packing"](spark, awkward).collect()
    sizes = {}
    for r in rows:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes[0] == sizes[1] == 1 and sizes[2] == 2 * 2 and sizes[3] == 2 * sizes[4] and sizes[None] > 1
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sorted(b)[-1][0] + sorted(b)[-1][1] == sum(n for _, n in b) <= 2048 for b in bins.values())


def test_values_of_op8(spark, awkward):
    got = _results(spark, awkward, "op8_lines")
    assert {i: r["n_words"] for i, r in got.items()} == WORDS
    assert got[3]["n_repeat_words"] == got[4]["n_repeat_words"] == 30_000 and all(r["base_failed"] and not r["kept"] for r in got.values())
    assert got[5]["word_chars"] == 100_000 and got[6]["word_chars"] == 4


def test_values_of_op10(spark, awkward):
    got = _results(spark, awkward, "op10_langid")
    assert all(r["held_out"] == _held(i, 5) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == "und" and got[3] | {"held_out": 0} == got[4] | {"held_out": 0}


@pytest.mark.parametrize("which", ["empty", "awkward"])
def test_pipeline(spark, request, which):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, request.getfixturevalue(which))
    assert (out.count() == 0) == (which == "empty")
