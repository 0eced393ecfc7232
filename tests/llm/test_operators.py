"""Operators against brute force, exact round trips and held-out accuracy on small inputs."""

import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from riskloom.llm import chat, contamination, copies, language, neighbours, packing, queries, simhash, suffixes, tokens
from riskloom.llm.components import components

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "same words here " * 30), (7, "same words here " * 30),
        (8, "1234 !! ..."), (9, "längere wörter, ço même déjà vu " * 400), (10, "<|endoftext|> x  <|endoftext|>"), (10, "repeated id")]


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def documents(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(k, t, "en", "src0", len(t or ""), 7) for k, t in EDGE] + [(None, "no id at all", None, None, 12, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def encode(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_of_all_prefixes(library):
    counter = tokens.PrefixCounter(VOCABULARY)
    rng = random.Random(5)
    parts = [*"ab 's'tre\n\t    é12½²_-中😀\x1c\x85ßⅧ ", "<|endoftext|>", "the", " ing", "'ll", "<|"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = [len(encode(library, text[:k])) for k in range(len(text) + 1)]
        assert counter.prefixes(text) == want
        assert counter.count(text) == want[-1]


def test_token_counts_and_truncation(spark, small, documents, edge, library):
    got = queries.op1_token_counts(spark, small).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(encode(library, t)) for k, t in documents.items()}
    assert all(r.n_bytes == len(documents[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 512) for r in got)
    assert sorted(r.n_tokens for r in tokens.token_counts(edge, VOCABULARY, 5).collect()) == sorted(
        [len(encode(library, t)) for _, t in EDGE] + [len(encode(library, "no id at all"))])
    cut = tokens.prefix_counts(edge.filter("doc_id = 9"), VOCABULARY).select(tokens.longest_prefix(F.col("counts"), 20)).first()[0]
    assert len(encode(library, EDGE[8][1][:cut])) <= 20 < len(encode(library, EDGE[8][1][:cut + 1]))


def _windows(texts):
    """Words of each text that an earlier document repeats for 50 words."""
    words = {k: (t or "").encode().split() for k, t in texts.items()}
    first, out = {}, {}
    for k in sorted(words):
        for at in range(len(words[k]) - 49):
            first.setdefault(tuple(words[k][at:at + 50]), k)
    for k, w in words.items():
        out[k] = {p for at in range(len(w) - 49) if first[tuple(w[at:at + 50])] < k for p in range(at, at + 50)}
    return out


def test_every_repeated_passage_is_found(spark, small, documents):
    got = queries.op2_repeated_passages(spark, small).filter("not kept").collect()
    covered = {}
    for r in got:
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        assert r.end - r.start >= suffixes.PASSAGE and r.first_doc_id < r.doc_id
    for doc, words in _windows(documents).items():
        assert words == covered.get(doc, set())


def test_passages_of_unequal_overlap(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    fill = lambda n: [word() for _ in range(n)]
    docs = {}
    for k in range(60):
        whole = fill(rng.choice([43, 45, 49, 50, 51, 57, 70]))
        left = rng.randint(0, len(whole) - 43)
        middle = whole[left:left + 43]
        # The smallest document shares the middle only, the next ones share the whole, with other words around it.
        for part in (middle, whole, whole, whole[:50] + fill(9) + whole):
            docs[len(docs)] = fill(rng.randint(0, 70)) + part + fill(rng.randint(0, 70))
    texts = {k: " ".join(w) for k, w in docs.items()}
    got = {}
    for r in suffixes.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        assert r.end - r.start >= suffixes.PASSAGE
        got.setdefault((r.doc_id, r.kept), set()).update(range(r.start, r.end))
    want = {k: w for k, w in _windows(texts).items() if w}
    assert {k: w for (k, kept), w in got.items() if not kept} == want and len(want) > 50
    first, several = {}, set()
    for k, w in docs.items():
        for at in range(len(w) - 49):
            if first.setdefault(tuple(w[at:at + 50]), (k, at))[0] < k:
                several.add(tuple(w[at:at + 50]))
    kept = {}
    for run in several:
        k, at = first[run]
        kept.setdefault(k, set()).update(range(at, at + 50))
    assert {k: w for (k, is_kept), w in got.items() if is_kept} == kept


def test_passages_planted_in_other_text(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(7))
    shared = [word() for _ in range(60)]
    rows = []
    for k in range(12):
        own = [word() for _ in range(rng.randint(60, 200))]
        at = rng.randint(0, len(own))
        rows.append((k, " ".join(own[:at] + (shared if k % 3 == 0 else shared[:40] if k % 3 == 1 else []) + own[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {(r.doc_id, r.kept): r.end - r.start for r in suffixes.repeated_passages(docs).collect()}
    assert spans == {(0, True): 60, (3, False): 60, (6, False): 60, (9, False): 60}
    left = {r.doc_id: r.text for r in suffixes.deduplicated(docs).collect()}
    assert sum(" ".join(shared) in t for t in left.values()) == 1 and len(left) == 12


def test_language_accuracy(spark, small, duck):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = queries.op3_language_id(spark, small).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert len(got) == len(lang) and sum(held) >= 0.97 * len(held)


def test_labels_accuracy(spark, small, duck):
    for name, label in (("op5_toxicity", "toxic"), ("op8_quality", "quality")):
        want = dict(duck.execute(f"SELECT doc_id, {label} FROM labels").fetchall())
        got = [r for r in queries.QUERIES[name](spark, small).collect() if r.doc_id in want]
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert sum(r.predicted == want[r.doc_id] for r in got) >= 0.85 * len(got)


def test_sample_counts_different_texts(spark):
    texts = [f"text {word}" for word in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta")]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    lowest = docs.orderBy(F.xxhash64("text")).first().text
    many = docs.union(spark.range(100, 700).select("id", F.lit(lowest), F.lit("en")))
    train = many.filter(~language.held_out(F.col("doc_id")) & F.col("text").isNotNull())
    want = {"text"} | {r.text.split()[1] for r in train.select("text").distinct().orderBy(F.xxhash64("text")).limit(4).collect()}
    assert len(want) == 5 and language.fit(many, rows=4) == (("en",), (tuple(sorted(want)),))


def test_toxic_grammar_reads_clauses():
    from riskloom.llm.toxicity import KINDS, Grammar

    found = lambda text: {KINDS[k]: int(n) for k, n in enumerate(Grammar(()).clauses(text)) if n}
    assert found("you idiot. fine") == {(1, 0, 1, 0): 1}
    assert found("he is not an idiot") == {(2, 0, 0, 0): 1}
    assert found("she said idiot; moron!") == {(1, 0, 0, 1): 1, (1, 0, 0, 0): 1}
    assert found("not a word that far away from an idiot") == {(1, 0, 0, 0): 1}
    assert found("") == found("plain") == {}


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "a", 1.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "c", 5.0), (1, 4, 3, "user", "d", 1.0),
            (1, 5, 3, "user", "e", 9.0), (2, 1, 2, "user", "x", 0.0), (2, 2, 1, "user", "y", 0.0), (3, 7, 99, None, None, 0.0)]
    messages = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double").fillna("")
    best = chat.paths(messages, 2).orderBy("tree", "rank", "depth").collect()
    assert [(r.tree, r.rank, r.id) for r in best] == [(1, 1, 1), (1, 1, 3), (1, 1, 5), (1, 2, 1), (1, 2, 3), (1, 2, 4), (3, 1, 7)]


def test_escapes_read_back(spark):
    texts = ["<|im_end|>", "<\\|x", "<\\\\|", "a<|b<\\|c", "\n<|im_start|>user\n", "", "\\n"]
    rows = [(k, 0, role, t) for k, t in enumerate(texts) for role in ("assistant", "us\ner\\n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = chat.reply_chain(turns)
    pieces = chat.formatted(messages, chat.paths(messages))
    for r in chat.read_back(pieces).collect():
        said = [("assistant", texts[r.tree]), ("us\ner\\n", texts[r.tree])]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(texts[r.tree].encode()).hexdigest() and r.n_turns == 2


@pytest.mark.parametrize("name", sorted(queries.ANSWERS))
def test_query_equals_sql(spark, small, duck, name):
    want = duck.execute(queries.ANSWERS[name]).fetchdf()
    got = queries.QUERIES[name](spark, small).toPandas()[list(want.columns)]
    order = list(want.columns[:2])
    assert (len(want) or name.startswith("op13")) and (got.sort_values(order).to_numpy() == want.sort_values(order).to_numpy()).all()


def _components(bits, distance):
    root = list(range(len(bits)))
    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= distance:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash_components(spark, small, documents):
    ids = sorted(documents)
    bits = [simhash.fingerprint(documents[k]) for k in ids]
    want = {ids[k]: ids[r] for k, r in enumerate(_components(bits, 2))}
    got = queries.op6_simhash(spark, small).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {k: format(b, "016x") for k, b in zip(ids, bits)}


@pytest.mark.parametrize("crowd", [1000, 3])
def test_links_connect_what_is_near(spark, crowd):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    bits = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(40)}
    signed = sorted(b - (1 << 64) if b >> 63 else b for b in bits)
    found = simhash.links(spark.createDataFrame([(b,) for b in signed], "fp long"), crowd=crowd).select(
        F.col("fp").alias("u"), F.col("other").alias("v"))
    got = {r.node: r.root for r in components(found).collect()}
    want = _components([b % (1 << 64) for b in signed], 2)
    assert [got.get(b, b) for b in signed] == [signed[r] for r in want]


def _near_texts():
    """Texts of a few hundred words, copies of them with some words changed, and unlike texts with one common line."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    line = rng.sample(words, 12)
    texts = []
    for base in (rng.choices(words, k=300) for _ in range(6)):
        for _ in range(8):
            copy = list(base)
            for at in rng.sample(range(300), rng.choice([1, 2, 4, 5, 6, 7, 9])):
                copy[at] = rng.choice(words)
            texts.append(copy)
    texts += [rng.choices(words, k=rng.randint(3, 60)) + line for _ in range(30)] + [line, line + ["end"], ["w1"], ["w1"], []]
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("crowd", [200, 3])
def test_stage_finds_all_near_copies(spark, small, crowd):
    texts = _near_texts()
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    root, far = list(range(len(texts))), 0
    for i, j in ((i, j) for j in range(len(texts)) for i in range(j)):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            far += (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 2
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert far and 10 < len(set(root)) < len(texts) - 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in copies.near_copies(docs, crowd=crowd).collect()} == dict(enumerate(root))
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, small).collect()} == set(root)


def test_stages_keep_odd_columns(spark, small):
    """Extra columns with the names that stages use, dots and repeated ids."""
    kinds = "doc_id long, text string, lang string, _going long, _again long, _doc string, _leak long, _spans int, `a.b` string, count int, row string"
    text = "The river of the north was long and the people of it were many. " * 3
    rows = [(k % 5, f"{text} {k} {'x y z ' * k}", "en", k, k, "d", k, 1, "dot", 2, "r") for k in range(8)] + [(2, None, None, *[None] * 8)]
    docs = spark.createDataFrame(rows, kinds)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.kept(stage(spark, docs, small))
        assert after.columns == docs.columns
        docs = after
    assert docs.count() > 0 and docs.filter("`a.b` = 'dot'").count() == docs.count()


def test_null_and_large_conversation_ids(spark):
    big = 9007199254740993
    turns = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 2, "user", "c"), (big, 0, "user", "d")],
                                  "conv_id long, turn long, role string, text string")
    messages = chat.reply_chain(turns)
    got = {r.tree: r for r in chat.read_back(chat.formatted(messages, chat.paths(messages)).coalesce(1)).collect()}
    assert set(got) == {None, big} and got[None].n_turns == 3 and got[None].loss_chars == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {**dict.fromkeys(range(1, 301), 0), 1001: 1000}


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(6000, 32))
    rows[500:900] = rows[0]  # a crowd of equal vectors
    odd = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [1.0] * 5), (9004, [None] * 32)]
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)] + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(vectors, F.col("id") % 50 == 0, block=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        score = np.round(unit @ unit[q], 12)
        score[q] = -2
        best = np.lexsort((np.arange(6000), -score))[:5].tolist()
        hits += len(set(best) & set(got[q]))
        assert q != 0 or best == got[0] == [500, 501, 502, 503, 504]
    assert hits >= 0.9 * 5 * 120 and 9001 not in got


def _exact(rows, k=5):
    """(query id, rank, id) of the nearest by brute force; ``rows`` are (id, vector) and ids may repeat."""
    out = []
    for q, v in rows:
        if q % 50 == 0:
            v = np.array(v)
            score = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12), i) for i, w in rows if i != q]
            out += [(q, at + 1, i) for at, (_, i) in enumerate(sorted(score)[:k])]
    return out


def test_neighbours_with_few_candidates_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    few = [(0, rng.normal(size=16).tolist()), (7, [1.0] * 16), (7, [1.0] * 16), (7, [2.0] * 16), (8, [-1.0] * 16)]
    opposite = [(k, (rng.normal(size=16) * 0.01 + (1 if k else -1)).tolist()) for k in range(40)]  # far from what is asked
    for rows in (few, few[:1], opposite, []):
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        for probes in (1, neighbours.PROBES):
            got = neighbours.nearest(vectors, F.col("id") % 50 == 0, tables=1, probes=probes).collect()
            want = _exact(rows)
            assert len(got) == len(want)
            if probes > 1 or len(rows) < 6 or rows is opposite:
                assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(want)


def test_neighbours_recall_on_small_tables(spark, small, duck):
    rows = [(i, [float(x) for x in v]) for i, v in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()]
    got = {(r.query_id, r.vec_id) for r in queries.op7_nearest(spark, small).collect()}
    want = {(q, i) for q, _, i in _exact(rows)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_packing(spark, small, documents, library):
    rows = queries.op9_best_fit_packing(spark, small).collect()
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        assert sum(n for _, n in parts) <= 2048
        assert [a for a, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist()
    for doc, text in documents.items():
        ids, at = [*encode(library, text), 0], 0
        for r in sorted(docs[doc], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            assert r.piece == 0 or r.length == 2048
            at += r.length
        assert at == len(ids)
    assert len(sequences) <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_bounds_hold_and_partitions_exchange(spark):
    rng = np.random.default_rng(8)
    for _ in range(50):
        lengths = rng.integers(1, 100, rng.integers(0, 60))
        assert packing.lower_bound(lengths, 100) <= packing.best_fit(lengths, 100)[2]
    assert packing.lower_bound(np.array([60] * 7), 100) == 7
    cut = spark.range(600).select(F.col("id").alias("doc_id"), F.col("id").alias("copy"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                                  (F.pmod(F.hash("id"), F.lit(99)) + 1).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    out = packing.pack(cut, 100, per_partition=100).collect()
    whole = packing.best_fit(np.array([r.length for r in out]), 100)[2]  # all in one partition
    assert len({r.doc_id for r in out}) == 600
    assert packing.lower_bound(np.array([r.length for r in out]), 100) <= len({r.sequence_id for r in out}) <= whole + 6  # one a partition


def test_containment_in_short_and_long(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, ("noise " * 5000) + item.upper() + "! end"), (2, item[:30]), (3, None), (4, "tiny item"), (None, item)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, "tiny item"), (4, None), (5, "--")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_items, r.containment) for r in contamination.contaminated(docs, bench).collect())
    assert got == [(1, 1, 2, 1.0), (4, 3, 1, 1.0)]


def test_edge_rows_and_empty_tables(spark, small, edge, tmp_path):
    tables = {name: spark.read.parquet(f"{small}/{name}.parquet") for name in ("labels", "benchmark", "conversations", "embeddings")}
    for kind, docs in (("edge", edge), ("none", edge.limit(0))):
        folder = str(tmp_path / kind)
        docs.write.parquet(f"{folder}/documents.parquet")
        for name, frame in tables.items():
            (frame if kind == "edge" else frame.limit(0)).write.parquet(f"{folder}/{name}.parquet")
        for name, query in queries.QUERIES.items():
            rows = query(spark, folder).collect()
            if kind == "none":
                assert len(rows) == (1 if name.startswith("op4") else 0)
            elif name.split("_")[0] in ("op1", "op3", "op5", "op6", "op8", "op11", "op12"):
                assert len(rows) == len(EDGE) + 1
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.kept(stage(spark, docs, folder))
        assert docs.count() == 0 if kind == "none" else docs.count() > 0


def test_pipeline_keeps_clean_documents(spark, small, documents):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.kept(stage(spark, docs, small))
        assert after.columns == docs.columns and after.select("doc_id").distinct().count() == after.count()
        docs = after
    left = {r.doc_id: r.text for r in docs.collect()}
    assert not any(words for words in _windows(left).values())
    assert set(corpus_pipeline.run(spark, small).toPandas().doc_id) == set(left)
