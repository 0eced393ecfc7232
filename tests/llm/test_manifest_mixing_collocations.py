"""Manifest, mixing and collocations against SQL on odd tables, and against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import collocations, manifest, mixing, queries

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, place long, members long, tree string, "
          "subtree long, phrase string, a long, h long, edge long, `a.b` string, _range long")


def odd_rows(n=1400, langs=600):
    """Many languages with few rows, one with most; nulls, ties, repeated rows and ids."""
    rng = random.Random(12)
    rows = []
    for k in range(n):
        lang = rng.choice([None, "", "en", "en", "en", "en", "zh", "é"]) if k > langs else f"l{k}"
        text = rng.choice([None, "", " \t", "One TWO three", "a b " * rng.randint(1, 40), "Ünï Çödé x\x1cy\x85z", "WORDS. " * 3])
        rows.append((rng.choice([None, k, k, k, k, 7, -k]), text, lang, rng.choice([None, "", "s0", "s0", "s1", "ß", "z\U0001f600"]),
                     rng.choice([None, k]), k, 1, "t", 2, "p", 3, 4, 5, "dot", 6))
    return rows + rows[-40:]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_source_mixing", "op13_collocations"])
def test_odd_tables_equal_sql(spark, odd, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    want = connection.execute(queries.ANSWERS[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, odd)
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want.fetchall(), key=repr) and rows


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_a_proof_by_hand(spark):
    rows = [(k, f"T{k}", "en") for k in range(9)] + [(100, None, None)]
    docs = spark.createDataFrame([(*r, "s", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = [digest(field(k) + field("s") + field(lang) + field(2) + field(text)) for k, text, lang in rows]
    first, last = digest("".join(leaf[:8])), digest(leaf[8])
    english = digest(first + last)
    root = digest(leaf[9] + english)
    got = {r.doc_id: r for r in manifest.verify(docs, F.lower("text")).collect()}
    assert got[8].proof_sha256 == digest(first + leaf[9]) and got[8].subroot == english and got[8].root == root
    assert got[100].leaf == got[100].subroot == leaf[9] and got[100].proof_sha256 == digest(english)
    assert {k for k, r in got.items() if not r.verified} == {k for k in range(9) if zlib.crc32(str(k).encode()) % 3 == 0}
    roots = manifest.Manifest(manifest.leaves(docs)).roots().collect()
    assert {(r.lang, r.subroot, r.root) for r in roots} == {("en", english, root), (None, leaf[9], root)}


def test_stored_levels_are_few(spark):
    docs = spark.range(1300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"),
                                    F.lit(1).alias("n_chars"))
    kept = manifest.Manifest(manifest.leaves(docs))
    assert [level.count() for level in kept.levels] == [1300, 3, 1]
    nodes = [r.digest for r in kept.levels[0].orderBy("place").collect()]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[k:k + 8])) for k in range(0, len(nodes), 8)]
    assert kept.levels[-1].first().digest == nodes[0] and all(r.verified for r in kept.proofs().collect())


def test_mix_meets_targets_and_is_nested(spark):
    rng = random.Random(3)
    rows = [(k, f"s{rng.choice([0, 0, 0, 0, 0, 0, 1, 2, 3])}", "w " * rng.randint(0, 50)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    own = dict((k, s) for k, s, _ in rows)
    taken, sizes, targets = Counter(), Counter(), {}
    for r in got:
        taken[own[r.doc_id]] += r.taken
        sizes[own[r.doc_id]] += r.size
        targets[own[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size + r.part
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes) and abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    assert sum(0 < r.part < r.size for r in got) <= len(sizes)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    rows_of = mixing.sized(docs)
    edges = [mixing.thresholds(rows_of, spark.createDataFrame([("s0", b)], "source string, budget long")).first() for b in (50, 5000, 20000)]
    assert edges[0].edge < edges[1].edge < edges[2].edge
    below = rows_of.filter((F.col("source") == "s0") & (F.col("h") < edges[1].edge)).agg(F.sum("size")).first()[0]
    assert below == edges[1].below < 5000 <= edges[1].below + edges[1]["at"]


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 0, 3), ("d", 97, 1)], "source string, source_size long, weight long")
    assert {r.source: r.target for r in mixing.targets(sizes).collect()} == {"a": 3.0, "b": 6.0, "c": 0.0, "d": 91.0}
    assert mixing.targets(sizes.limit(0)).count() == 0


def brute(texts, least, top):
    by = {}
    for lang, text in texts:
        lowered = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for ch in ".,;:!?\n\x0b\x0c\r":
            lowered = lowered.replace(ch, ".")
        for piece in lowered.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            counts = by.setdefault(lang or "und", Counter())
            counts.update(tuple(words[k:k + m]) for m in range(1, 6) for k in range(len(words) - m + 1))
    out = []
    for lang, f in by.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = [p for p, c in f.items() if len(p) > 1 and c >= least]
        inside = Counter()
        for p in found:
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    inside[p[k:k + m]] = max(inside[p[k:k + m]], f[p])
        rows = []
        for p in found:
            if inside[p] < f[p]:
                score, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, r[2].decode(), -r[1], r[3], r[4], n, -r[0]) for rank, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_collocations_equal_brute_force(spark):
    rng = random.Random(6)
    words = ["a", "B", "c", "dé", "É", "\x1cx", "y z", "a"]
    texts = [(None, None), ("en", ""), ("en", "..."), (None, "a a a a a a a a"), ("en", " "), ("en", "one")]
    for _ in range(300):
        parts = [rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "?!"]) for _ in range(rng.randint(1, 30))]
        texts.append((rng.choice(["en", "en", "und", None, "fr"]), "".join(parts)))
    docs = spark.createDataFrame([(k, lang, text) for k, (lang, text) in enumerate(texts)], "doc_id long, lang string, text string").repartition(4)
    for least, top in ((3, 40), (12, 2000)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least, top).collect())
        assert got == brute(texts, least, top) and got


def test_scores_beyond_64_bits(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 10**12), rng.randint(1, 10**14), rng.randint(1, 10**13), rng.randint(1, 10**13)) for _ in range(200)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", F.expr(collocations.SCORE).alias("score")).collect()
    assert all(r.score == 1000 * r.a * r.n // (r.l * r.r) for r in got)


def test_cut_texts_lose_no_window(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdefgh") for _ in range(900)) + ". q r s"
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "x y"])], ["lang", "text"])
    whole = next(collocations.chunks(batch, 4))[1]
    monkeypatch.setattr(collocations, "CHUNK", 50)
    for overlap in (1, 2, 4):
        said = []
        for _, part, again in collocations.chunks(batch, overlap):
            assert len(part) <= 50 and again in (0, overlap)
            said += part[:len(part) - again]
        assert said == whole
