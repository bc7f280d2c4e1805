"""Operators against brute force on small and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plexa.llm import bpe, langid, lines, mixing, nearest, neardup, packing, secrets, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage = words(rng, 60)
    out = [None, "", "  \n\t ", "one", "x" * 5000, "ñandú 日本 \x85 \x1c"]
    for _ in range(12):
        out.append(" ".join(words(rng, 120)))
    out += [" ".join(words(rng, 40) + passage + words(rng, 30)) for _ in range(3)]
    out += [out[8], out[8]]  # copies
    near = out[9].split()
    near[50] = "changed"
    out.append(" ".join(near))
    out.append("\n".join(["same line here"] * 30))
    return out


def test_substrings(spark, texts):
    got = {r["doc_id"]: r for r in substrings.digests(table(spark, texts)).collect()}
    seen = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        grams = [tuple(w[p : p + 50]) for p in range(len(w) - 49)]
        gone = set()
        for p, g in enumerate(grams):
            if seen.get(g, i) < i:
                gone.update(range(p, p + 50))
        for g in grams:
            seen.setdefault(g, i)
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert substrings.digests(table(spark, texts).limit(0)).count() == 0


def test_substrings_of_hot_passages(spark, monkeypatch):
    """A passage that most documents share, at shifting places, and rows that share a doc_id or have none."""
    from plexa.llm import text as kernels

    monkeypatch.setattr(kernels, "HOT", 8)
    rng = random.Random(12)
    passage, other = words(rng, 130), words(rng, 55)
    rows = []
    for i in range(60):
        low = rng.randrange(0, 60)
        mine = words(rng, rng.randrange(5, 60)) + (passage[low : low + rng.randrange(45, 75)] if i % 3 else other) + words(rng, 20)
        rows.append((i, " ".join(mine), "en", "s", 1))
    rows += [rows[3], (5, " ".join(passage), "en", "s", 1), (None, " ".join(passage), "en", "s", 1), (-4, " ".join(other), "en", "s", 1)]
    rng.shuffle(rows)
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digests(spark.createDataFrame(rows, SCHEMA)).collect() if r["doc_id"] is not None)
    first = {}
    for i, t, *_ in rows:
        w = t.split()
        for p in range(len(w) - 49):
            if i is not None:
                first[tuple(w[p : p + 50])] = min(i, first.get(tuple(w[p : p + 50]), i))
    want = []
    for i, t, *_ in rows:
        w = t.split()
        gone = {q for p in range(len(w) - 49) if i is not None and first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        if i is not None:
            want.append((False, i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    assert got == sorted(want) and sum(x[3] for x in want) > 1000


def test_substring_dedup_keeps_other_columns(spark, texts):
    from pyspark.sql import functions as F

    docs = table(spark, texts).withColumns({"_tag": F.lit("mine"), "covered": F.lit(1), "_covered": F.lit(2)})
    out = {r["doc_id"]: r for r in substrings.dedup(docs).collect()}
    assert len(out) == len(texts) and out[0]["text"] is None
    assert out[21]["text"] == "" and out[21]["n_chars"] == 0 and out[8]["text"] == texts[8]
    assert all((r["_tag"], r["covered"], r["_covered"]) == ("mine", 1, 2) for r in out.values())


@pytest.fixture(scope="module")
def public():
    return pytest.importorskip("public_tokenizers")


def test_bpe(spark, public, texts):
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    more = [*texts, "aaaaaaa  b\n\n c don't   ", " lead", "a\n b"]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(table(spark, more), path, public.PATTERN).collect()}
    assert [got[i] for i in range(len(more))] == [encoding.encode_ordinary(t or "") for t in more]
    replay = bpe.MergeReplay(bpe.read_ranks(path), public.PATTERN)
    assert all(replay.decode(got[i]) == (t or "").encode() for i, t in enumerate(more))


def test_packing(spark, public, texts):
    tokenizers = pytest.importorskip("tokenizers")
    docs = table(spark, [*texts, " ".join(["word"] * 5000)])
    rows = packing.packed(docs, public.path("byte_bpe_50k.json"), public.PATTERN).collect()
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    bins, parts = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for i, text in enumerate([*texts, " ".join(["word"] * 5000)]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(parts[i])):
            assert (piece, start) == (k, at) and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)


def test_packing_keeps_added_tokens(spark, public):
    tokenizers = pytest.importorskip("tokenizers")
    held = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y", "<|endoftext| >", "word <|endoftext|> " * 1500]
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = {}
    for r in packing.tokenized(table(spark, held), public.path("byte_bpe_50k.json"), public.PATTERN).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert [got[i] for i in range(len(held))] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in held]
    assert got[1] == [50256, 0]


def test_plan_is_full_where_it_can_be():
    plan = packing.plan({5: 4, 3: 4, 2: 4}, 10)
    assert sum(n for _, n in plan) == 4 and all(sum(lengths) <= 10 for lengths, _ in plan)
    assert packing.plan({}) == []
    with pytest.raises(ValueError):
        packing.plan({packing.CAPACITY + 1: 1})


def test_secrets_against_re():
    rng = random.Random(1)
    parts = ["password", "ToKen", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abcdef", "AKIA", "0123456789ABCDEFGH", "deadbeef0123456789abcdef", "é", "\n", "x"]
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    scanner = secrets.Scanner()
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        want = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        got = [s for s in scanner.find(text) if s[0] in ("assign", "access", "hex")]
        assert sorted(got) == sorted(want), text


def test_redaction(spark):
    out = secrets.redact(table(spark, [None, "my password=hunter22 ok", ""])).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == [None, "my [assign] ok", ""] and out[1]["n_chars"] == 14


def test_near_duplicates(spark, texts):
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(table(spark, texts)).collect()}
    assert got[21] == got[22] == got[8] == 8 and got[23] == got[9] == 9
    grams = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        if w:
            grams[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))}
    for a in grams:
        for b in grams:
            j = len(grams[a] & grams[b]) / len(grams[a] | grams[b])
            if a < b and j >= 0.85:
                assert got[a] == got[b]
            if a < b and j < 0.5:
                assert got[a] != got[b]
    assert [got[i] for i in (0, 1, 2)] == [0, 1, 2]
    assert neardup.classes(table(spark, texts).limit(0)).count() == 0


def test_near_duplicates_at_the_threshold(spark):
    """Two texts of similarity 40 / 50 = 0.8 in buckets that are led by texts unlike both."""
    rng = random.Random(11)
    text = [f"base{i}" for i in range(49)]
    other = [*text[:24], "changed", *text[25:]]
    docs = []
    for i in range(250):
        lead = list(text)
        for low in (5, 15, 26, 37):
            lead[low + rng.randrange(6)] = f"own{i}x{low}"
        docs.append(" ".join(lead))
    got = {r["doc_id"]: r for r in neardup.classes(table(spark, [*docs, " ".join(text), " ".join(other)])).collect()}
    assert got[250]["class_id"] == got[251]["class_id"] == 250 and got[251]["n_links"] == 1


def exact_classes(texts, least=neardup.SIMILARITY):
    """Components of all pairs whose banded alignment reaches the similarity, by plain dynamic programming."""
    grams = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        if w:
            grams[i] = [tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))]
    group = {i: i for i in range(len(texts))}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in grams:
        for b in grams:
            if a < b and len(set(grams[a]) & set(grams[b])) >= 0.5 * len(set(grams[a])):
                x, y = grams[a], grams[b]
                row = [0] * (len(y) + 1)
                for p in x:
                    new = [0]
                    for j, q in enumerate(y):
                        new.append(row[j] + 1 if p == q else max(row[j + 1], new[-1]))
                    row = new
                if row[-1] / (len(x) + len(y) - row[-1]) >= least - 1e-9:
                    u, v = sorted((root(a), root(b)))
                    group[v] = u
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("hot", [4096, 4])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, hot):
    """Families of edits, chains of them, templates with other fillings, and exact copies: the classes of all pairs."""
    from plexa.llm import text as kernels

    monkeypatch.setattr(kernels, "HOT", hot)
    rng = random.Random(21)
    texts = []
    for f in range(6):
        base = [f"f{f}w{j}" for j in range(100)]
        now = list(base)
        for _ in range(8):  # a chain: each like the last, the ends less like each other
            now = list(now)
            now[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(now))
        for _ in range(4):
            far = list(base)
            for j in range(0, 100, 12):
                far[j] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(far))
    texts += [texts[0]] * 3 + ["short text", "short text", "another one", None, ""]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == exact_classes(texts)


def test_near_duplicates_of_repeated_rows(spark):
    rng = random.Random(22)
    a, b = " ".join(words(rng, 60, 10**6)), " ".join(words(rng, 60, 10**6))
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (9, a, "en", "s", 1), (10, b, "en", "s", 1), (5, a, "en", "s", 1), (None, a, "en", "s", 1), (11, "", "en", "s", 1)]
    got = [(r["doc_id"], r["class_id"]) for r in neardup.classes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 7 and (None, None) in got and (11, 11) in got and got.count((5, 5)) == 3
    assert sorted(c for i, c in got if i in (9, 10)) in ([5, 9], [5, 10])
    kept = neardup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["doc_id"] is None for r in kept) == 1 and sum(r["doc_id"] == 5 for r in kept) == 3


def test_common_against_table():
    rng = random.Random(2)
    for _ in range(200):
        x, y = [rng.randrange(6) for _ in range(rng.randrange(12))], [rng.randrange(6) for _ in range(rng.randrange(12))]
        band = 30
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        assert neardup.common(x, y, band) == best[-1][-1]


def test_line_rules(spark):
    rows = [(i, f"Common line\nown text number {i} with some words of its own " + " ".join(f"v{i}x{j}" for j in range(20)), "en", "host", 1) for i in range(30)]
    rows += [(30, None, "en", None, 0), (31, "", "en", "host", 0), (32, "Common  LINE\n" * 12, "en", "host", 1)]
    got = {r["doc_id"]: r for r in lines.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0]["kept"] and got[0]["n_removed_words"] == 2
    assert not got[32]["kept"] and got[32]["n_repeat_words"] == 24 and got[32]["n_dup_lines"] == 11
    assert got[30]["n_words"] == 0 and got[30]["base_failed"]


def brute_lines(rows, least=lines.LEAST_DOCS):
    """{(doc_id, text, source)}: (n_removed_words, kept) by plain Python."""
    norm = lambda t: [x for x in (" ".join(y.lower().split()) for y in (t or "").split("\n")) if x]
    docs, hosts = {}, {}
    for i, t, _, host, _ in rows:
        if i is not None:
            hosts.setdefault(host, set()).add(i)
            for x in norm(t):
                docs.setdefault((host, x), set()).add(i)
    out = {}
    for i, t, _, host, _ in rows:
        gone = sum(len(x.split()) for x in norm(t) if len(docs.get((host, x), ())) >= least and len(docs[host, x]) > lines.GROWTH * len(hosts[host]) ** 0.5)
        w = (t or "").split()
        grams = [tuple(w[p : p + 8]) for p in range(len(w) - 7)]
        repeated = len({q for p, g in enumerate(grams) if grams.count(g) > 1 for q in range(p, p + 8)})
        failed = len(w) < 20 or 100 * repeated > 30 * len(w)
        left = len(w) - gone
        out[i, t, host] = (gone, not failed and (not gone or left >= lines.LEAST_WORDS and left >= lines.LEAST_KEPT * len(w)))
    return out


def test_line_frequency_against_brute_force(spark):
    """Lines of 5 to 10% of a host's documents go; repeated rows and missing ids change nothing."""
    rng = random.Random(8)
    own = lambda i: " ".join(f"v{i}x{j}" for j in range(30))
    rows = [(i, "\n".join([*(["Shared  Line of the host"] if i % 12 == 0 else []), own(i), *(["twice here"] * 2 if i % 5 == 0 else [])]), "en", "big", 1) for i in range(400)]
    rows += [(400 + i, f"Shared line of the host\n{own(400 + i)}", "en", ("small", None)[i % 2], 1) for i in range(30)]
    rows += [(7, rows[7][1], "en", "big", 1)] * 25  # one document, given 26 times
    rows += [(None, f"lonely line here\n{own(9999)}", "en", "big", 1)] * 30
    rows += [rows[0], (0, "another text of document 0\ntwice here", "en", "big", 1), (500, None, "en", "big", 1), (501, "", None, None, 1), (502, "twice here\n" * 40, "en", "big", 1)]
    rng.shuffle(rows)
    want = brute_lines(rows)
    assert want[0, rows[[r[0] for r in rows].index(0)][1], "big"] and want[12, next(r[1] for r in rows if r[0] == 12), "big"][0] == 5
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lines.judge(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["n_removed_words"], r["kept"]))
    for (i, _, _), v in want.items():
        assert v in by[i]
    assert all(len(v) == len({x for (j, _, _), x in want.items() if j == i}) for i, v in by.items())
    clean = {r["doc_id"]: r["text"] for r in lines.cleaned(docs.where("doc_id = 12 or doc_id in (500, 13)")).collect()}
    assert clean[500] is None and "Shared  Line" in clean[12]
    clean = {r["doc_id"]: r["text"] for r in lines.cleaned(docs).collect() if r["doc_id"] in (12, 13)}
    assert clean[12] == own(12) and clean[13] == own(13)


def test_repeated_words_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 9, 30, 60)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in lines.base(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[p : p + 8]) for p in range(len(w) - 7)]
        assert got[i] == len({q for p, g in enumerate(grams) if grams.count(g) > 1 for q in range(p, p + 8)})


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (300, 6)) / 8
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [0.5])]
    got = nearest.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    y = {i: np.floor(256 * np.array(r + [0.0] * (6 - len(r)))) for i, r in rows if r is not None and not any(v is None or v != v for v in r)}
    for q in (i for i in y if i % 50 == 0):
        best = sorted(((-int(y[q] @ y[i]), i) for i in y if i != q))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert mine == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert nearest.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_top_k_of_repeated_rows(spark, monkeypatch):
    """Rows given twice, ids with two vectors, and queries in several blocks."""
    monkeypatch.setattr(nearest, "BLOCK", 4)
    monkeypatch.setattr(nearest, "PART", 60)
    rng = np.random.default_rng(9)
    x = rng.integers(-3, 4, (200, 4)) / 8
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [rows[0], rows[6], rows[6], rows[13], (20, [1.0, 1.0, 1.0, 1.0]), (20, [-1.0, 0.0, 0.0, 0.0])]
    rows = [(10 * i if i % 7 == 0 else i, r) for i, r in rows]
    got = nearest.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    vectors = {}
    for i, r in rows:
        vectors.setdefault(i, set()).add(tuple(int(np.floor(256 * v)) for v in r))
    for q in (i for i in vectors if i % 50 == 0):
        own = min(vectors[q])
        best = sorted((-max(sum(a * b for a, b in zip(own, v, strict=True)) for v in vs), i) for i, vs in vectors.items() if i != q)[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert mine == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_toxicity(spark):
    rng = random.Random(6)
    texts = [" ".join(words(rng, 30) + (["idiotic"] if i % 4 == 0 else [])) for i in range(400)] + [None, ""]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classified(docs, labels).collect()}
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in range(400)) > 390
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held) > 60
    assert toxicity.classified(docs, labels.limit(0)).where("predicted = 1").count() == 0
    nameless = docs.unionAll(spark.createDataFrame([(None, "idiotic", "en", "s", 1)], SCHEMA))
    assert toxicity.classified(nameless, labels).where("doc_id is null").first()["held_out"]


def test_features_against_plain_python():
    """Present n-grams of characters, in any script and case."""
    text = "Ab\u00c9\u65e5\u672c\u8a9e ab\u00e9\u65e5\u672c"
    found = set(toxicity.Features()(text).tolist())
    want = set()
    low = [ord(c) for c in text.lower()]
    for n in toxicity.ORDERS:
        for at in range(len(low) - n + 1):
            h = 0
            for k, c in enumerate(low[at : at + n]):
                h = (h * 0x01000193 + c + k + 1) % 2**32
            h ^= h >> 15
            want.add((h * 0x2C1B3C6D % 2**32) >> (32 - toxicity.BITS))
    assert found == want


def test_score_is_the_fitted_sum():
    rng = random.Random(3)
    texts = [" ".join(words(rng, 12) + (["vile"] if i % 3 == 0 else [])) for i in range(90)]
    labels = np.array([int(i % 3 == 0) for i in range(90)])
    weights, intercept = toxicity.fit(texts, labels, labels.mean())
    again = toxicity.fit(texts, labels, labels.mean())
    assert (weights == again[0]).all() and intercept == again[1]
    z = [weights[list(set(toxicity.Features()(t).tolist()))].sum(dtype=float) + intercept for t in texts]
    assert ((np.array(z) >= 0) == (labels == 1)).mean() > 0.95


def test_language(spark):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        lang = ("aa", "bb")[i % 2]
        letters = "abcde" if lang == "aa" else "vwxyz"
        rows.append((i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(20)), lang, "s", 1))
    rows += [(200, None, "aa", "s", 0), (201, "123 456", None, "s", 0)]
    got = {r["doc_id"]: r for r in langid.identified(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["lang_pred"] == ("aa", "bb")[i % 2] for i in held) >= 0.97 * len(held) > 25
    assert sum(got[i]["lang_pred"] == ("aa", "bb")[i % 2] for i in range(200)) > 195
    assert got[200]["lang_pred"] == got[201]["lang_pred"] == "und"


def test_prediction_is_the_trained_networks():
    """The lean path over a text's segments gives what the training path gives, position by position."""
    net = langid.Network(3, seed=5)
    text = np.frombuffer(("Wörter und words, palabras " * 9).encode(), np.uint8)
    first, last, row = langid._cut(np.array([0, 0, 100, len(text)]))
    assert row.tolist() == [1] * 3 + [2] * -(-(len(text) - 100) // langid.SEGMENT)
    got = net.segments(text, first, last - first)
    for a, b, g in zip(first, last, got, strict=True):
        assert g == pytest.approx(net.forward(text[None, a:b])[3][0].mean(0), abs=1e-5)


def test_recurrent_gradients():
    net = langid.Network(3, hidden=4, seed=1)
    net.values = [v.astype(np.float64) for v in net.values]
    x, y = np.random.default_rng(0).integers(0, 256, (5, 6)), np.array([0, 1, 2, 1, 0])
    loss = lambda: -net.forward(x)[3][np.arange(5), :, y].mean()
    for v, g in zip(net.values, net.gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = loss()
        v[at] = old - 1e-5
        slope = (up - loss()) / 2e-5
        v[at] = old
        assert slope == pytest.approx(g[at], rel=1e-2)


def test_mixing(spark, texts):
    from pyspark.sql import functions as F

    docs = table(spark, [*texts, "THE the w1 unseenword"])
    got = {r["doc_id"]: r for r in mixing.scored(docs, toxicity.folds(F.col("doc_id"), 10) == 0).collect()}
    counts, every = {}, {}
    for i, t in enumerate([*texts, "THE the w1 unseenword"]):
        every[i] = ["\n", *(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split())]
        if zlib.crc32(str(i).encode()) % 10:
            for w in every[i]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, w in every.items():
        assert got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(x in counts for x in w) and got[i]["train_tokens"] == n
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert got[i]["score"] < 0 and got[i]["bits_per_byte"] == pytest.approx(-got[i]["score"] * np.log2(10) / (sum(len(x) + 1 for x in w[1:]) + 1))


def test_scores_do_not_depend_on_the_cluster(spark, texts):
    """Other partitions, other slices of the shuffle: the same scores. And a text's score is that of its tokens in order."""
    from pyspark.sql import functions as F

    held = toxicity.folds(F.col("doc_id"), 10) == 0
    docs = table(spark, [*texts, "w1 w2 w3", "w3 w2 w1", "W1  w2\tw3"])
    one = {r["doc_id"]: r for r in mixing.scored(docs.coalesce(1), held).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        two = {r["doc_id"]: r for r in mixing.scored(docs.repartition(5), held).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one.keys() == two.keys() and all(one[i]["score"] == pytest.approx(two[i]["score"], rel=1e-6) for i in one)
    n = len(texts)
    assert one[n]["score"] == pytest.approx(one[n + 2]["score"]) and one[n]["score"] != pytest.approx(one[n + 1]["score"], rel=1e-9)
    assert one[n]["bits_per_byte"] == pytest.approx(-one[n]["score"] * np.log2(10) / 10)


def test_first_bytes_see_the_word_before():
    data = np.frombuffer(b"ab c" + b"xyz" + b"", np.uint8)
    off = np.array([0, 4, 7, 7])
    start, end, bounds = mixing.word_spans(data, off)
    codes, row = mixing._firsts(data, start, end, bounds)
    assert [mixing._first_unit(c) for c in codes.tolist()] == [b"  a", b" ab c", b" c \n", b"  x", b" yz \n", b"  \n"]
    assert row.tolist() == [0, 0, 0, 1, 1, 2]
    assert mixing.split(b" ab c") == (b"ab ", b"c") and mixing.split(b"word") == (b"w", b"ord ")


def test_whole_contexts_against_plain_counts():
    units, counts = [b"abc", b"abd", b"b", b" ab c", b" ab d", b"  a"], np.array([3, 2, 0, 5, 1, 4])
    tokens = mixing.Tokens(units)
    got = tokens.counted(counts)
    seen = {}
    for u, c in zip(units, counts, strict=True):
        lead, body = mixing.split(u)
        for i, byte in enumerate(body):
            for b in range(7, -1, -1):
                seen.setdefault((u[:1] == b" ", lead + body[:i], b, byte >> (b + 1)), [0, 0])[byte >> b & 1] += c
    at = 0
    for u in units:
        lead, body = mixing.split(u)
        for i, byte in enumerate(body):
            for b in range(8):
                assert got[b][:, at].tolist() == seen[u[:1] == b" ", lead + body[:i], b, byte >> (b + 1)]
            at += 1
    assert at == len(tokens.data)


def test_whole_contexts_count_the_corpus_however_it_is_dealt(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    words = {w for n in (3, 4, 6, 9, 12) for w in ("".join(x) for x in rng.choice(list("ab"), (60, n)))} | {f"abab{a}bb{b}" for a in "abcdefghijklmnop" for b in "abcdefgh"} | {"abab", "ababa"}
    words = sorted(words | {f"https://www.{i}" for i in range(40)})
    texts = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    docs = table(spark, texts)
    # the model before it learns from its groups: what contexts count is all that its scores depend on
    def untaught(counts, *trunk):
        mixer = mixing.Mixer(mixing._tables(counts), *trunk)
        mixer.shared = spark.sparkContext.broadcast((mixer.tables, *trunk) if trunk else mixer.tables)
        return mixer

    monkeypatch.setattr(mixing, "train", untaught)
    score = lambda: {r["doc_id"]: r["score"] for r in mixing.scored(docs, F.col("doc_id") % 10 == 0).collect()}
    one = score()
    monkeypatch.setattr(mixing, "GROUP", 1)
    assert score() == pytest.approx(one, rel=1e-9)
    # and by brute force, unit by unit
    units = [(w.encode(), i % 5) for i, w in enumerate(words)] + [(b" " + w[-2:].encode() + b" a", 1) for w in words[:9]]
    dealt, trunk = mixing._grouped(spark.createDataFrame([(i, bytearray(u), n) for i, (u, n) in enumerate(units)], "hash long, unit binary, trained long"))
    seen = {}
    for u, n in units:
        lead, body = mixing.split(u)
        for i, byte in enumerate(body):
            for b in range(8):
                seen.setdefault((u[:1] == b" ", lead + body[:i], b, byte >> (b + 1)), [0, 0])[byte >> b & 1] += n
    parts = {}
    for r in dealt.collect():
        parts.setdefault(r["part"], []).append((bytes(r["unit"]), r["trained"]))
    assert len(trunk[0]) and len({p for p, us in parts.items() if any(u.startswith(b"https://www.") for u, _ in us)}) > 1
    for us in parts.values():
        got, at = mixing.Tokens([u for u, _ in us]).counted(np.array([n for _, n in us]), trunk), 0
        for u, _ in us:
            lead, body = mixing.split(u)
            for i, byte in enumerate(body):
                for b in range(8):
                    assert got[b][:, at].tolist() == seen[u[:1] == b" ", lead + body[:i], b, byte >> (b + 1)]
                at += 1


def _peak(f):
    """What ``f`` returns, and the most bytes it held on the way."""
    import tracemalloc

    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_blocks_are_read_in_slices(monkeypatch):
    """A block's texts take less than 14 bytes a byte on the way, and its units and bags are those of one slice."""
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    rng = np.random.default_rng(2)
    words = np.array(["".join(x) for x in rng.choice(list("abcdEFGH,."), (3000, 6))])
    texts = [None, "", *(" ".join(x) for x in rng.choice(words, (2000, 500))), " \n", "one", "", " ".join(words[:200])]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": texts, "held_out": [i % 10 == 0 for i in range(len(texts))]})
    run = mixing._blocks(SimpleNamespace(mapInArrow=lambda run, kind: run))
    assert 6 << 20 < batch.nbytes < mixing.BLOCK_BYTES
    (got,), most = _peak(lambda: list(run([batch])))
    assert most < 14 * batch.nbytes
    monkeypatch.setattr(mixing, "SLICE_BYTES", mixing.BLOCK_BYTES)
    (one,) = run([batch])
    assert got.equals(one)
    # and by plain counting: units, their training occurrences, and two texts
    size, trained = mixing._numbers(got["lengths"][0].as_py()), mixing._numbers(got["trained"][0].as_py())
    raw, ends = zlib.decompress(got["units"][0].as_py()), np.cumsum(size)
    units = [raw[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    tokens = [(t or "").lower().encode().split() for t in texts]
    pairs = [[b"", *t] for t in tokens]
    bags = [Counter([*t, *(b" " + a[-2:] + b" " + b[:1] for a, b in zip(p, [*t, b"\n"], strict=True))]) for t, p in zip(tokens, pairs, strict=True)]
    seen = sum((b for i, b in enumerate(bags) if i % 10), Counter())
    assert len(set(units)) == len(units) and set(units) == set().union(*bags) and [seen[u] for u in units] == trained.tolist()
    _, held_units, steps, times = map(mixing._numbers, got["texts"][0].as_py())
    at = 0
    for n, bag in zip(held_units.tolist(), bags, strict=True):
        places = np.cumsum(steps[at : at + n].astype(np.uint32)).astype(np.uint32)
        assert {units[p]: k for p, k in zip(places.tolist(), times[at : at + n].tolist(), strict=True)} == bag
        at += n


def test_groups_are_learned_and_scored_in_pieces():
    """Less than 120 bytes for each byte that is predicted, whatever the contexts' number."""
    rng = np.random.default_rng(1)
    units = sorted({bytes(rng.integers(97, 120, n).tolist()) for n in rng.integers(3, 14, 50_000)})
    counts = rng.integers(1, 50, len(units))
    mixer = mixing.Mixer(mixing.halved(np.zeros((len(mixing.ORDERS), 1 << mixing.BITS, 2), np.float32)))
    predicted = sum(map(len, units))
    assert _peak(lambda: mixer.learn(units, counts))[1] < 120 * predicted
    assert _peak(lambda: mixer.scores(units, counts))[1] < 120 * predicted


def _distribution(mixer, units, counts, others):
    """Of all bytes in place of the last one of ``others``' first unit, by the model of ``units``."""
    return mixer.scores([*units, *others], np.array([*counts, *[0] * len(others)]))[len(units) :]


def test_bits_are_a_distribution():
    mixer = mixing.Mixer(mixing.halved(np.zeros((len(mixing.ORDERS), 1 << mixing.BITS, 2), np.float32)))
    units, counts = [b"  a", b" ab c", b" ab d"], [4, 3, 1]
    mixer.learn(units, np.array(counts))
    others = [b" ab " + bytes([a]) for a in range(256)]
    assert sum(10 ** _distribution(mixer, units, counts, others)) == pytest.approx(1)
    best = _distribution(mixer, units, counts, others).argmax()
    assert best == ord("c")


def test_pairs_are_ruled_out_where_they_meet(spark):
    """Of texts that share rare k-mers the join gives those that all bounds let be similar, at fewer k-mers than they share."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 200)
    texts = [np.where(rng.random(200) < rate, rng.integers(0, 1 << 62, 200), base) for rate in [0.5] * 30 + [0.03] * 4]
    hashes = np.concatenate(texts).astype(np.uint64)
    offsets = np.arange(len(texts) + 1) * 200
    parity = neardup._parity(hashes, offsets)
    times = {k: n for k, n in zip(*np.unique(hashes, return_counts=True), strict=True)}
    rows = []
    for i, t in enumerate(texts):
        held = sorted((times[k], int(k)) for k in t.astype(np.uint64) if times[k] > 1)
        fold = [int(np.bitwise_xor.reduce(parity[i][j :: neardup.FOLDED])) for j in range(neardup.FOLDED)]
        rows += [(k, i, 200, len(held), at, i, parity[i].tolist(), fold) for at, (_, k) in enumerate(held[: max(0, len(held) - 159)])]
    some = spark.createDataFrame(rows, "token long, id long, size long, shared long, before int, class_id long, parity array<long>, fold array<long>")
    x, y = (some.select("token", *(F.col(c).alias(n + c) for c in some.columns[1:])) for n in "ab")
    found = [(r["aid"], r["bid"]) for r in neardup._open(x, y, 0.8).collect()]
    alike = {(i, j) for i in range(34) for j in range(i + 1, 34) if len(np.intersect1d(texts[i], texts[j])) * 1.8 >= 0.8 * 400}
    assert alike <= set(found) and set(found) - alike == set() and len(alike) >= 6
    meet = x.join(y, "token").where("aid < bid and aclass_id != bclass_id").count()
    assert len(found) < meet / 2
