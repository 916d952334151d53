"""Collocations, toxicity and whitening against brute force and held-out labels."""

import math
import os
import re
from collections import Counter, defaultdict
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from markloom.llm import catalog, collocations, sql, toxicity, whitening

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="given tables are absent")
TEXT = "doc_id bigint, text string, lang string"

# 11


def brute_collocations(docs, least, top, most=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, n, out = defaultdict(Counter), Counter(), []
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                counts[lang or "und"].update(zip(*(w[i:] for i in range(k))))
    for lang, f in counts.items():
        several = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p in several for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f[p] >= f[p[i:j]]}
        rows = []
        for p, a in several.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@needs_tables
@pytest.mark.parametrize("shard_words", [3000, 2_000_000])
def test_collocations_table(spark, shard_words):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = found(collocations.collocations(docs, least=8, top=150, shard_words=shard_words))
    assert len(got) > 200 and got == brute_collocations([(r.text, r.lang) for r in docs.collect()], 8, 150)


@needs_tables
def test_collocations_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(con.execute(sql._collocations(least=8, top=150)).fetchall())
    assert found(collocations.collocations(spark.read.parquet(f"{SMALL}/documents.parquet"), least=8, top=150)) == want


def test_collocations_edges(spark):
    rows = [(None, None, None), (1, "", "en"), (2, " \t.\n;", "en"), (3, "A b c. a B c, a b\tc d", None), (3, "A b c. a B c, a b\tc d", None),
            (4, "a b c", "und"), (5, "x x x x x x x x", "en"), (6, "Ä ä Ä ä ä ä", "de"), (7, "solo", "fr"), (8, "p q r s t u v w " * 3000, "es"), (None, "a b", "en")]
    docs = spark.createDataFrame(rows, TEXT).withColumns({"word": F.lit("clash"), "n": F.lit(1), "shard": F.lit(2), "id": F.lit(0)})
    for shard_words in (5, 1000):
        got = found(collocations.collocations(docs, least=2, top=50, shard_words=shard_words))
        assert got == brute_collocations([(t, lang) for _, t, lang in rows], 2, 50)
    assert collocations.collocations(docs.where("false"), least=2).count() == 0
    assert collocations.collocations(docs, least=10**9).count() == 0


def test_collocations_beyond_64_bits(spark):
    big = spark.createDataFrame([(3 * 10**9, 4 * 10**12, 7 * 10**9, 11)], "a bigint, n bigint, l bigint, r bigint")
    out = big.select(F.expr("(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    assert out.collect()[0][0] == 1000 * 3 * 10**9 * 4 * 10**12 // (7 * 10**9 * 11)


def test_index_intervals():
    """Counts and places of all pairs and triples in a random text, from the index of both directions."""
    text = np.concatenate([[0], np.random.default_rng(3).integers(0, 4, 400), [0]]).astype(np.int32)
    text, _ = collocations.compact(text)
    for depth in (1, 2, 3):
        places = {i: tuple(text[i:i + depth + 1].tolist()) for i in range(len(text) - depth) if 0 not in text[i:i + depth + 1]}
        given = np.array([i for i in range(len(text) - depth + 1) if 0 not in text[i:i + depth]])
        place, count = collocations.longer_phrases(text, depth, given)
        assert {places[p]: c for p, c in zip(place, count)} == Counter(places.values())


def test_filter_has_every_phrase(spark):
    rows = [(i * 7, i << 40) for i in range(3000)]
    bits = collocations.phrase_filter(spark.createDataFrame(rows, "w0 bigint, w1 bigint"))
    with np.errstate(over="ignore"):
        at = collocations.bits_of([np.array(c) for c in zip(*rows)])
    assert (bits[at >> 3] >> (at & 7) & 1).all() and np.unpackbits(bits).sum() == len(np.unique(at))


# 12


@needs_tables
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="given tables are absent")
def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = catalog.op12_toxicity(spark, folder).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    bad = [r for r in rows if r.toxic]
    assert len(bad) > 20 and sum(r.predicted for r in bad) >= 0.9 * len(bad)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


TOXIC = [(i, f"you are {'such a vile wretch' if i % 4 == 0 else 'a very kind friend'} number {i}", "en") for i in range(200)]


def test_toxicity_edges(spark):
    extra = [(None, "you vile wretch", "en"), (1000, None, None), (1001, "", "en"), (1002, "v1le wr3tch " * 20_000, "en"), (0, TOXIC[0][1], "de")]
    docs = spark.createDataFrame(TOXIC + extra, TEXT).withColumns({"toxic": F.lit("clash"), "features": F.lit(1), "fold": F.lit(1), "score": F.lit(2), "probability": F.lit(0)})
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(4, 0, 0), (5, 1, None), (None, 1, 1), (1000, 1, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(TOXIC + extra)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == (i % 4 == 0) for i in range(200))
    assert by[None].predicted == 1 and not by[None].held_out and by[1000].score == by[1001].score < 0.5 and by[1002].predicted == 1
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}


def test_toxicity_labels_of_the_held_out_do_not_teach(spark):
    docs, labels = spark.createDataFrame(TOXIC, TEXT), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.toxicity(docs, labels).collect()) == sorted(toxicity.toxicity(docs, turned).collect())


def test_toxicity_words():
    assert [toxicity.plain(w)[0] for w in ("Idiot!!", "1d1ot", "st*pid", "stuuupid", "s&cum", "...", "éàü,", "42")] == ["idiot", "idiot", "stpid", "stupid", "scum", "", "éàü", "42"]
    words = toxicity._Words({"idiot": 3.0, "lowe*": 2.0})
    row = dict(zip(toxicity.FEATURES, toxicity.features("YOU 1d1ot and loweit some more words until the end", words)))
    assert row["term_density"] == 0.2 and row["top_weight"] == 3 and row["near_share"] == 1 and row["disguised_words"] == 0.1 and row["disguised_terms"] == 0.5


# 13


def brute_whitening(vectors, components=32):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(Decimal(n * a - s) / n) for a, s in zip(r, sums)] for r in x])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    return n, [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x], centred @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def check_whitening(rows, ids, vectors, components=32):
    n, deviation, whitened, share = brute_whitening(vectors, components)
    c = whitened.shape[1]
    place = {i: p for p, i in enumerate(ids)}
    assert len(rows) == n * c and {r.n for r in rows} == {n}
    got = np.zeros((n, c))
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[place[r.vec_id]]
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert np.abs(got * np.sign((got * whitened).sum(0)) - whitened).max() < 1e-6


@needs_tables
def test_whitening_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    check_whitening(catalog.op13_embedding_whitening(spark, SMALL).collect(), [r.vec_id for r in table], [r.embedding for r in table])


def test_whitening_edges(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(0, 3, 3).astype(np.float32).tolist()) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [0.0, float("inf"), 0.0]), (104, [1.0]), (105, [])]
    table = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<float>").withColumns({"component": F.lit(9), "v": F.lit("clash"), "n": F.lit(0)})
    check_whitening(whitening.whiten(table).collect(), [i for i, _ in good], [v for _, v in good])
    twice = whitening.whiten(table.union(table.withColumn("vec_id", F.lit(None).cast("bigint")))).collect()
    assert len(twice) == 2 * 40 * 3 and sum(r.vec_id is None for r in twice) == 40 * 3 and {r.n for r in twice} == {80}
    assert whitening.whiten(table.where("false")).count() == 0 and whitening.whiten(table.where("vec_id >= 100 AND vec_id < 104")).count() == 0
    assert whitening.whiten(table.where("vec_id = 105")).count() == 0
    alone = whitening.whiten(table.where("vec_id = 7")).collect()
    assert [(r.whitened, r.deviation, r.explained, r.identity_error) for r in alone] == [(None, 0, 0.0, 0.0)] * 3
    flat = spark.createDataFrame([(i, [float(i), float(i), 1.0]) for i in range(5)], "vec_id bigint, embedding array<double>")
    assert {(r.component, r.whitened is None) for r in whitening.whiten(flat).collect()} == {(1, False), (2, True), (3, True)}


def test_whitening_far_values_are_exact(spark):
    rows = [(i, [2.0**40 + i * 2.0**20, -(2.0**50) + (i % 3) * 2.0**30]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    _, deviation, _, _ = brute_whitening([v for _, v in rows])
    assert all(r.deviation == deviation[r.vec_id] for r in got) and max(deviation) > 2**63
    with pytest.raises(Exception, match="fit into a long"):
        whitening.whiten(spark.createDataFrame([(1, [1e30])], "vec_id bigint, embedding array<double>")).count()
