"""Classifiers, near-duplicates, searches and the pipeline against brute force, held-out rows, and edge cases."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorelane.llm import lang_id, minhash, permutation_index, queries, toxicity, vector_dedup
from scorelane.llm.common import Scratch, small_batches
from scorelane.llm.components import connected
from scorelane.llm.tiles import unit


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(100, 180)] + [(random.randint(0, 60), random.randint(0, 60)) for _ in range(40)] + [(200, i) for i in range(201, 260)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    want = least_reachable({x for e in edges for x in e}, edges)
    assert all(got.get(i, i) == c for i, c in want.items())
    assert connected(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def plain_sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute_duplicates(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, plain_sets(t, k))
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, least_reachable(ids, links)


def texts_with_copies():
    random.seed(7)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    out = []
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(random.randint(30, 120))]
        out.append(base)
        for _ in range(random.randint(0, 12)):
            copy = list(base)
            for _ in range(random.randint(0, 6)):
                copy[random.randrange(len(copy))] = word()
            out.append(copy)
    out += [passage + [word() for _ in range(random.randint(10, 40))] for _ in range(30)]
    random.shuffle(out)
    texts = [" ".join(x) for x in out] + [None, "", " \t\n", "one", "One", "one two three", "ONE  two\tthree"]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_against_all_pairs(spark, words):
    rows = texts_with_copies()
    sizes, want = brute_duplicates(rows, words)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, band string")
    got = minhash.near_duplicates(docs, words=words).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (sizes[i], want[i], want[i] == i) for i, _ in rows}


def test_pairs_left_to_blocks_are_found(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "STARS", 1)
    rows = texts_with_copies()
    _, want = brute_duplicates(rows, 4)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_duplicate_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "A B C D E F"), (3, "é b c")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted([(1, 1, True), (1, 1, True), (None, None, True), (None, None, True), (2, 1, False), (3, 3, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    base = unit(rng.normal(size=(60, 16)))
    near = [base[i % 10] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.13]) for i in range(120)]
    x = [*base, *near, base[0] * 5, base[0], base[0]]
    return [(i * 7, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]


ODD = [(10_001, None), (10_002, []), (10_003, [0.0] * 16), (10_004, [float("nan")] * 16), (10_005, [float("inf")] + [0.0] * 15), (10_006, [None] + [1.0] * 15), (10_007, [1.0, 2.0])]
VECTOR = "vec_id long, embedding array<float>, v binary, n long, d int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, b"", 0, 0) for i, v in rows], VECTOR)


def test_near_duplicate_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "STRIP", 32)
    rows = vectors()
    x = unit(np.array([v for _, v in rows]))
    links = (x @ x.T) >= 0.9
    np.fill_diagonal(links, False)
    ids = [i for i, _ in rows]
    want = least_reachable(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(links), strict=True)])
    for block in (1000, 40):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(frame(spark, rows + ODD), block=block).collect()}
        assert {i: got[i] for i in ids} == {i: (int(n), want[i], want[i] == i) for i, n in zip(ids, links.sum(1), strict=True)}
        assert all(got[i] == (0, i, True) for i, _ in ODD)
    assert vector_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_pairs_within_the_bound_are_recomputed():
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(1, 32)) + rng.normal(size=(300, 32)) * 0.24)
    left, right, sure = vector_dedup.tile_pairs(vector_dedup.quantise(x), None, 0.95)
    true = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)), strict=True)}
    found = set(zip(left.tolist(), right.tolist(), strict=True))
    assert true <= found and {p for p, s in zip(zip(left.tolist(), right.tolist(), strict=True), sure, strict=True) if s} <= true
    linked = vector_dedup.exact(x, x, left[~sure], right[~sure], 0.95)
    assert 0 < linked.sum() < len(linked)


def test_near_duplicate_vector_edges(spark):
    got = sorted((tuple(r) for r in vector_dedup.near_duplicates(frame(spark, [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0])])).collect()), key=str)
    assert got == sorted([(5, 1, 5, True), (5, 1, 5, True), (None, 0, None, True), (7, 0, 7, True)], key=str)


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    x, y = unit(rng.normal(size=(200, 24))), unit(rng.normal(size=(200, 24)))
    (q, s, e), (r, t, f) = vector_dedup.quantise(x), vector_dedup.quantise(y)
    estimate = (q.astype(int) @ r.astype(int).T) * np.outer(s, t)
    assert (np.abs(x @ y.T - estimate) <= e[:, None] + (1 + e[:, None]) * f[None, :] + 1e-12).all()


def test_search_is_exact_when_all_are_reranked(spark):
    rows = vectors()
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    for block in (1000, 50):
        got = permutation_index.search(frame(spark, rows + ODD), F.col("vec_id") % 5 == 0, reranked=1000.0, pivots=20, prefix=10, window=4, block=block).collect()
        by = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        want = {}
        for i, y in zip(ids.tolist(), x, strict=True):
            if i % 5 == 0:
                s = permutation_index.cosines(x, y)
                s[ids == i] = -2
                want[i] = [(int(ids[k]), float(s[k])) for k in np.lexsort((ids, -s))[:5]]
        assert by == want


def test_equal_vectors_have_equal_scores_and_go_by_id(spark):
    rng = np.random.default_rng(11)
    same = [float(x) for x in np.float32(rng.normal(size=64))]
    rows = [(i, same if i % 3 == 1 else [float(x) for x in np.float32(rng.normal(size=64))]) for i in range(120)]
    got = permutation_index.search(frame(spark, rows), F.col("vec_id") == 0, block=16).orderBy("rank").collect()
    tied = permutation_index.search(frame(spark, rows), F.col("vec_id") == 4, block=16).orderBy("rank").collect()
    assert [r["vec_id"] for r in tied] == [1, 7, 10, 13, 16] and len({r["score"] for r in tied}) == 1
    assert len(got) == 5


def test_search_recall_on_the_table(spark):
    data = "/root/testdata/sf0.1"
    got = queries.QUERIES["op6_permutation_search"](spark, data).toPandas()
    t = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    x, ids = unit(np.array(t["embedding"].tolist(), float)), t["vec_id"].to_numpy()
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -2
        hits += len(set(ids[np.argsort(-s)[:5]]) & set(got[got.query_id == q].vec_id))
        total += 5
    assert hits / total >= 0.9


def test_search_edges(spark):
    few = permutation_index.search(frame(spark, [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [2.0, 0.0])]), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(1, 2), (2, 3)]
    assert permutation_index.search(frame(spark, [(0, [1.0, 0.0])]), F.col("vec_id") == 0).count() == 0
    assert permutation_index.search(frame(spark, []), F.col("vec_id") == 0).count() == 0
    assert permutation_index.search(frame(spark, ODD[:5]), F.col("vec_id") > 0).count() == 0


def test_inverted_files_give_the_footrule():
    rng = np.random.default_rng(2)
    x, pivots = unit(rng.normal(size=(30, 8))), unit(rng.normal(size=(12, 8)))
    order = permutation_index.orders(x, pivots, 5)
    assert (order == np.argsort(-(x @ pivots.T), axis=1)[:, :5]).all()
    files = permutation_index.InvertedFiles(order, 12)
    for window in (0, 1, 2, 9):
        near = files.nearness(order[3], window)
        want = [sum(min(window + 1, abs(list(o).index(p) - i) if p in o else window + 1) for i, p in enumerate(order[3])) for o in order]
        assert (5 * (window + 1) - near).tolist() == want


def test_language_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = queries.QUERIES["op10_language_id"](spark, data).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, t, lang, 0) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("привет мир как дела", "ru"), ("lost", None)] * 5)]
    model = lang_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"))
    texts = [None, "", "123 !? \u0301\u0308 456", "the dog", "die katze", "как дела мир", "the dog " * 300_000]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r["p"] for r in asked.orderBy("i").select("i", lang_id.predict(model, F.col("text")).alias("p")).orderBy("i").collect()]
    assert [g["lang"] for g in got] == ["und", "und", "und", "en", "de", "ru", "en"]
    assert got[0]["score"] == 0 and got[6]["score"] == pytest.approx(got[3]["score"], abs=0.1)
    none = lang_id.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert asked.select(lang_id.predict(none, F.col("text")).alias("p")).where("p.lang <> 'und'").count() == 0


def test_bundles_against_single_ngrams():
    letters = np.random.default_rng(1).choice(np.float32([-1, 1]), (lang_id.ALPHABET, 64))
    texts = ["Über 12 Wölfe, ja!", "a", "x y", " привет  мир "]
    got = dict(lang_id.Bundler(3, 64, 1).vectors(texts))
    for t, text in enumerate(texts):
        codes = [0]
        for c in text.lower():
            code = int(lang_id._codes()[ord(c)])
            codes += [code] if code or codes[-1] else []
        codes += [0] * (codes[-1] != 0)
        want = sum(np.prod([np.roll(letters[codes[i + k]], 2 - k) for k in range(3)], axis=0) for i in range(len(codes) - 2))
        assert np.allclose(got[t], want)


@pytest.mark.parametrize("name", ["op5_minhash_dedup", "op8_vector_dedup"])
def test_near_duplicate_queries_match_sql(spark, name):
    data, c = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = sorted(c.sql(queries.SQL[name]).fetchall())
    assert sorted(map(tuple, queries.QUERIES[name](spark, data).collect())) == want


def test_pieces_of_long_texts_bundle_like_the_whole(monkeypatch):
    text = "Überall flogen Vögel, 12 davon; and the others sang. " * 30
    whole = dict(lang_id.Bundler(3, 64, 1).vectors([text]))[0]
    monkeypatch.setattr(lang_id, "PIECE", 37)
    assert np.allclose(dict(lang_id.Bundler(3, 64, 1).vectors([text]))[0], whole)


@pytest.mark.parametrize("kind", ["both", "one of two"])
def test_toxicity_learns_pairs(spark, kind):
    random.seed(1)
    filler = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(1600):
        insult, group = random.random() < 0.5, random.random() < 0.5
        words = random.sample(filler, 6) + ["rotten"] * insult + ["martians"] * group
        random.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group if kind == "both" else insult != group)))
    docs = spark.createDataFrame([(i, t, "x", 0, 0) for i, t, _ in rows], "doc_id long, text string, _text string, _y int, toxic int")
    model = toxicity.learn(docs, spark.createDataFrame([(i, y, 1) for i, _, y in rows[:1200]], "doc_id long, toxic int, _key int"))
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in rows[1200:]) >= 0.95 * 400
    a, b = [np.flatnonzero(model.terms == np.uint32(toxicity._hashes(w)[0]))[0] for w in ("rotten", "martians")]
    assert model.v[a] @ model.v[b] > 0.3 if kind == "both" else model.v[a] @ model.v[b] < -0.5


def test_toxicity_logits_against_all_pairs():
    rng = np.random.default_rng(4)
    w, v, ids = rng.normal(size=30), rng.normal(size=(30, 3)), [rng.choice(30, k, replace=False) for k in (0, 1, 2, 9)]
    of, flat = np.repeat(np.arange(4), [len(x) for x in ids]), np.concatenate(ids).astype(int)
    plain = [0.5 + sum(w[i] for i in x) + sum(v[i] @ v[j] for n, i in enumerate(x) for j in x[:n]) for x in ids]
    assert np.allclose(toxicity._logits(flat, of, 4, w, v, 0.5)[0], plain)


def test_toxicity_of_long_repeated_and_clashing_rows(spark):
    rows = [(i % 300, ("vile " if i % 2 else "kind ") + "so it goes " * 5, int(i % 2), "clash") for i in range(600)]
    docs = spark.createDataFrame([(i, t, c) for i, t, _, c in rows], "doc_id long, text string, _key string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, y, c) for i, _, y, c in rows], "doc_id long, toxic int, _y string"))
    asked = spark.createDataFrame([("so it goes " * 200_000 + "vile", "x"), ("vile", "x"), ("vile", "x"), ("kind", "x")], "text string, score string")
    a, b, c, d = (r[0] for r in asked.select(toxicity.score(model, F.col("text"))).collect())
    assert b == c and min(a, b) > 0.5 > d


def test_toxicity_held_out_and_edges(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    got = queries.QUERIES["op4_toxicity"](spark, data)
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (held.toxic == held.predicted).mean() >= 0.9 and held.score.between(0, 1).all()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.limit(50).collect())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    none = toxicity.learn(odd, spark.createDataFrame([(1, 1), (None, 0), (9, None)], "doc_id long, toxic int"))
    assert [r[0] < 1e-9 for r in odd.select(toxicity.score(none, F.col("text"))).collect()] == [True] * 3
    both = toxicity.learn(odd, spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0)], "doc_id long, toxic int"))
    assert len({round(r[0], 9) for r in odd.where("doc_id < 3").select(toxicity.score(both, F.col("text"))).collect()}) == 1


def test_pipeline_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = [(900_001, "the same words stand here in this order again and again " * 3, "en", "s", 1), (900_002, "the same words stand here in this order again and again " * 3, "en", "s", 1), (None, "password=hunter22xyz the of and", None, None, None), (900_003, None, "en", "s", 0), (900_004, "123 456", "en", "s", 7)]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = Scratch(spark, "t").put(stage(spark, rows, data), name)
        if name != "packing":
            assert rows.columns == docs.columns
            kept[name] = {r["doc_id"]: r["text"] for r in rows.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    clean = [i for i, y in labels.items() if not y]
    assert len([i for i in clean if i in kept["toxicity"]]) >= 0.98 * len(clean)
    assert not {900_003, 900_004} & set(kept["language"]) and set(kept["language"]) <= set(kept["toxicity"])
    assert len({900_001, 900_002} & set(kept["near_duplicates"])) == 1
    assert set(kept["secrets"]) == set(kept["near_duplicates"]) and kept["secrets"][None] == "[secret] the of and"
    assert {r["doc_id"] for r in rows.collect()} == set(kept["secrets"])


def test_near_duplicate_stage_drops_near_copies_only(spark, data, tmp_path):
    random.seed(4)
    a, b, c, d = (" ".join(f"w{random.randint(0, 999)}" for _ in range(60)) for _ in range(4))
    rows = [(7, a), (7, b), (7, b), (9, a), (3, a + " more"), (None, c), (None, c), (None, c + " more"), (None, d), (8, d), (None, "12 words")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/in")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{tmp_path}/in"), data).collect()]
    of_c = [x for x in got if x[0] is None and x[1].startswith(c)]
    assert len(of_c) == 1
    assert sorted((x for x in got if x not in of_c), key=str) == sorted([(7, b), (3, a + " more"), (8, d), (None, "12 words")], key=str)


STRANGE = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin.",
    "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. Mọi người đều được hưởng tất cả những quyền và tự do nêu trong bản tuyên ngôn này.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej Deklaracji.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек должен обладать всеми правами и всеми свободами, провозглашенными настоящей Декларацией.",
]


def test_language_stage_parts_gibberish_and_unlearned_languages_from_clean_documents(spark):
    random.seed(8)
    noise = ["".join(random.choice(letters) for _ in range(size)) for letters in ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz     ", "абвгдежзийклмнопрстуфхцчшщъыьэюя") for size in (300, 800, 3000) for _ in range(30)]
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = [(900_000 + i, t, None, "s", len(t)) for i, t in enumerate([*noise, *STRANGE])]
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs.unionByName(spark.createDataFrame(extra, docs.schema)), data).collect()}
    assert [i for i in kept if i >= 900_000] == []
    assert kept == {r["doc_id"] for r in docs.collect()}


def test_pipeline_keeps_columns_that_clash(spark, data, tmp_path):
    clash = ["score", "_score", "p", "words", "size", "key", "_key", "id", "doc", "row", "base", "live", "cut", "least"]
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumns({c: F.lit(f"my {c}") for c in clash})
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = Scratch(spark, "t").put(stage(spark, rows, data), name)
        assert rows.columns == docs.columns and rows.count() > 100
        assert [tuple(r) for r in rows.select(*clash).distinct().collect()] == [tuple(f"my {c}" for c in clash)]
    (name, stage), n = corpus_pipeline.STAGES[-1], rows.count()
    assert stage(spark, rows, data).select("doc_id").distinct().count() == n


def test_pipeline_runs_on_no_rows(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        rows = Scratch(spark, "t").put(stage(spark, rows, data), name)
        assert rows.count() == 0


def test_near_duplicates_take_small_batches_of_texts(spark, monkeypatch):
    name, seen, put = "spark.sql.execution.arrow.maxRecordsPerBatch", [], Scratch.put
    before = spark.conf.get(name, None)
    monkeypatch.setattr(Scratch, "put", lambda self, *a, **b: seen.append(spark.conf.get(name, None)) or put(self, *a, **b))
    minhash.near_duplicates(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string"), words=4)
    assert seen and set(seen) == {"1000"} and spark.conf.get(name, None) == before
    spark.conf.set(name, "10")
    with small_batches(spark):
        assert spark.conf.get(name) == "10"
    spark.conf.unset(name)


def test_bundles_copy_few_vectors_at_once(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    docs, peak, made = [rng.integers(0, lang_id.ALPHABET**3, 3000) for _ in range(3)], {}, {}
    for size in (64, 1 << 30):
        monkeypatch.setattr(lang_id, "SLICE", size)
        bundler = lang_id.Bundler(3, 512, 1)
        bundler.bundle(docs)
        tracemalloc.start()
        made[size] = bundler.bundle(docs)
        peak[size] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert (made[64] == made[1 << 30]).all() and peak[64] < peak[1 << 30] / 4
