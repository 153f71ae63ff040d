import itertools
import math
import random

import numpy as np
import pyarrow as pa
from sampleloom.llm import decontaminate, hidden_markov, language_id
from sampleloom.llm.text_arrays import words_of
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
EDGE = [None, "", " \n", "12 34 !!", "x" * 100_000, "ß", "the and", "the and"]


def edge_frame(spark):
    return spark.createDataFrame([(k if k else None, t, None if k % 2 else "en", "c") for k, t in enumerate(EDGE)], "doc_id long, text string, lang string, score string")


def test_words_are_those_of_bytes_split():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["A", "z", " ", "\n", "\t", "\x0b", "é", " ", "😀", "."]) for _ in range(rng.randrange(30))) for _ in range(500)]
    seen = {}
    for w in words_of(pa.array(texts), 300):
        for r in range(w.hi - w.lo):
            span = slice(w.first[r], w.first[r + 1])
            words = [w.data[a:b].tobytes() for a, b in zip(w.starts[span], w.ends[span])]
            assert words == texts[w.lo + r].encode().lower().split()
            for word, h in zip(words, w.hashes[span]):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.op7_query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_edges(spark):
    docs = edge_frame(spark)
    model = language_id.fit(language_id.train_rows(docs))
    got = [(r["lang_pred"], r["score"] > 0, r["rejected"]) for r in language_id.identify(docs, model).collect()]
    assert got[:4] == [("und", False, True)] * 4 and [g[0] for g in got[4:]] == ["en"] * 4
    nothing = language_id.fit(language_id.train_rows(docs.limit(0)))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    kept = language_id.drop_unidentified(docs, model)
    assert kept.columns == docs.columns and kept.where("text IS NULL").count() == 0


def test_texts_of_unseen_languages_are_rejected(spark):
    """Although the training rows hold texts without letters and of a single word."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    langs = [r["lang"] for r in docs.select("lang").distinct().orderBy("lang").collect() if r["lang"]]
    empty = [(80_000 + k, t, x) for k, (t, x) in enumerate(itertools.product(["", " ", "12 34", "..."], langs))]
    model = language_id.fit(language_id.train_rows(docs.union(spark.createDataFrame(empty, docs.schema))))
    assert (model.floors > 0).all()
    alien = [
        "Это совершенно другой текст на русском языке, которого нет в обучении",
        "これは全く別の言語で書かれた文章です",
        "το κείμενο αυτό είναι γραμμένο στα ελληνικά",
        "qzxv wkjq xxzq vvkq jqzx zzxq kkwq",
        "To jest zupełnie inny tekst napisany po polsku, którego nie ma",
    ]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(alien)], "doc_id long, text string")
    assert all(r["rejected"] for r in language_id.identify(rows, model).collect())
    own = language_id.identify(docs.where("text RLIKE '[a-zA-Z]'"), model)
    assert own.where("rejected").count() == 0


def brute_forward(p, classes):
    total = 0.0
    for path in itertools.product(range(len(p.start)), repeat=len(classes)):
        prob = p.start[path[0]]
        for k, c in enumerate(classes):
            prob *= p.emission[c, path[k]] * (p.transition[path[k - 1], path[k]] if k else 1)
        total += prob
    return math.log10(total)


def test_forward_is_the_sum_over_all_paths():
    p = hidden_markov.Params.initial(3)
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, hidden_markov.CLASSES + 1, n) for n in (1, 4, 2, 6)]
    edges = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    got = hidden_markov.forward(p, np.concatenate(rows), edges)
    assert np.allclose(got, [brute_forward(p, r) for r in rows])


def test_expected_counts_add_up_and_training_never_hurts():
    rng = np.random.default_rng(2)
    rows = [rng.choice([3, 7], n, p=[0.8, 0.2]) if k % 2 else rng.choice([50, 90], n) for k, n in enumerate(rng.integers(1, 700, 40))]
    classes, edges = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    p, last = hidden_markov.Params.initial(2), -np.inf
    for _ in range(5):
        counts = hidden_markov.Counts(2)
        counts.add(p, classes, edges, piece=1000)
        assert np.isclose(counts.emission.sum(), len(classes)) and np.isclose(counts.start.sum(), len(rows))
        assert np.isclose(counts.transition.sum(), len(classes) - len(rows))
        now = hidden_markov.forward(p, classes, edges).sum()
        assert now >= last - 1e-6
        p, last = counts.params(), now


def test_every_round_reads_the_whole_of_all_texts(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ab", "cd"]) for _ in range(1100)) + " " + " ".join(rng.choice(["ef", "gh", "ij"]) for _ in range(900)) for _ in range(12)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "key long, text string")
    got = hidden_markov.train(frame, states=2, rounds=3)
    want = hidden_markov.Params.initial(2)
    w = next(words_of(pa.array(texts), 1 << 30))
    for _ in range(3):
        counts = hidden_markov.Counts(2)
        counts.add(want, *hidden_markov.class_sequences(w.hashes, w.first))
        want = counts.params()
    assert np.allclose(got.emission, want.emission) and np.allclose(got.transition, want.transition)


def test_scores_of_texts(spark):
    docs = edge_frame(spark)
    got = hidden_markov.score_texts(docs, F.lit(False)).collect()
    assert len(got) == len(EDGE) and all(r["train_tokens"] == sum(len((t or "").split()) + 1 for t in EDGE) for r in got)
    assert sorted(r["n_tokens"] for r in got) == sorted(len((t or "").split()) + 1 for t in EDGE)
    assert all(r["n_known"] == r["n_tokens"] and r["score"] < 0 for r in got)
    untrained = hidden_markov.score_texts(docs, F.lit(True)).collect()
    assert all((r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0) for r in untrained)
    assert hidden_markov.score_texts(docs.limit(0), F.lit(False)).count() == 0


def test_base_score_and_known_words_match_the_formula(spark):
    """Over several blocks, with a word that every block holds."""
    rng = random.Random(9)
    words = [f"Word{k}" for k in range(300)]
    texts = ["the " + " ".join(rng.choice(words[: rng.choice([5, 300])]) for _ in range(rng.randrange(80))) for _ in range(120)] + [None, "", "new words only", "THE the"]
    held = [k % 7 == 2 or k > 120 for k in range(len(texts))]
    docs = spark.createDataFrame([(k, t, h) for k, (t, h) in enumerate(zip(texts, held))], "doc_id long, text string, h boolean")
    tokens = [[*(t or "").lower().split(), "\n"] for t in texts]
    counts = {}
    for own, h in zip(tokens, held):
        for x in [] if h else own:
            counts[x] = counts.get(x, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    got = {r["id"]: r for r in hidden_markov.score_texts(docs, F.col("h"), rounds=2, block_bytes=4000).collect()}
    for k, own in enumerate(tokens):
        base = sum(math.log10((counts.get(x, 0) + 1) / (total + kinds + 1)) for x in own)
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (len(own), sum(x in counts for x in own), total)
        assert abs(got[k]["base_score"] - base) < 1e-6 and got[k]["held_out"] == held[k]


def test_model_beats_its_base_on_held_out_texts(spark):
    out = hidden_markov.op9_query(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 80)), rng.integers(0, 5, rng.integers(0, 120))
        assert decontaminate.common_subsequence(a, b) == brute_lcs(a.tolist(), b.tolist())


def test_latent_vectors_span_the_leading_directions():
    """On a matrix of low rank the single-pass decomposition is exact."""
    rng = np.random.default_rng(4)
    c = rng.poisson(2.0, (500, 6)) @ rng.poisson(0.3, (6, 300))
    idf = rng.uniform(1, 3, 300)
    z = c.T @ (c @ decontaminate.sketch_matrix(300, 12).astype(float))
    v = decontaminate.latent_vectors(z, idf) / idf[:, None]
    a = c * idf
    unit = v / np.maximum(np.linalg.norm(v, axis=0), 1e-12)
    unit = unit[:, np.linalg.norm(v, axis=0) > 0]
    assert np.allclose(a @ unit @ unit.T, a, atol=1e-2 * np.abs(a).max())


def test_leaks_are_found_and_clean_documents_stay(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    true = {k: sorted(i for i, x in items.items() if x in (t or "")) for k, t in texts.items()}
    got = {r["id"]: list(r["item_ids"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert all(set(true[k]) <= set(got[k]) for k in texts)
    assert sum(len(got[k]) > len(true[k]) for k in texts) <= 1


def test_paraphrase_needs_its_answer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(100).select("doc_id", "text")
    words = [f"rare{k}" for k in range(40)]
    half = [w if k >= 28 or k % 4 else f"new{k}" for k, w in enumerate(words)]
    changed = [f"new{k}" if k % 3 == 0 or k > 30 else w for k, w in enumerate(words)]
    rows = [(9001, "before it " + " ".join(half) + " after"), (9002, "before it " + " ".join(changed) + " after"), (9003, "tiny item"), (9004, None)]
    docs = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "Tiny, item!"), (3, None), (4, "")], "item_id long, text string")
    got = {r["id"]: r["item_ids"] for r in decontaminate.contaminated(docs, bench).where("id > 9000").collect()}
    assert got == {9001: [1], 9002: [], 9003: [2], 9004: []}
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).where("doc_id > 9000").collect()}
    assert kept == {9002, 9004}
    assert {tuple(r["item_ids"]) for r in decontaminate.contaminated(docs, bench.limit(0)).collect()} == {()}


def test_edits_at_both_ends_of_an_item_do_not_hide_it(spark):
    """The middle is intact; the words changed are near the head and the tail."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    pool = " ".join(r["text"] or "" for r in docs.limit(50).collect()).split()
    rng, made = random.Random(3), {}
    for r in bench.collect():
        words = r["text"].split()
        n = len(words)
        if n >= 36:
            for k in (*range(0, 12, 2), *range(n - 17, n - 5, 2)):
                words[k] = rng.choice(pool)
            at = rng.randrange(len(pool) - 40)
            made[r["item_id"]] = " ".join(pool[at : at + rng.randrange(30)] + words + pool[at + 30 : at + 40])
    rows = spark.createDataFrame([(90_000 + k, t) for k, t in made.items()], "doc_id long, text string")
    got = {r["id"]: r["item_ids"] for r in decontaminate.contaminated(docs.select("doc_id", "text").union(rows), bench).where("id >= 90000").collect()}
    assert len(made) > 10 and [k for k in made if k not in got[90_000 + k]] == []


def test_items_come_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(k, "x" * 10) for k in range(7)] + [(9, "y" * 100), (8, None)], "item_id long, text string")
    sizes = [[i for i, _ in b] for b in decontaminate.item_blocks(bench, 3, 35)]
    assert sizes == [[0, 1, 2], [3, 4, 5], [6], [9]]
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "six")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "two three"), (2, "four five")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 1)
    got = {r["id"]: r["item_ids"] for r in decontaminate.contaminated(docs, two).collect()}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, two).collect()] == [3]
    assert got == {1: [1], 2: [2], 3: []}


def test_rows_do_not_depend_on_the_size_of_the_benchmark(spark, monkeypatch):
    """Rows that repeat an id or have none stay apart, with one block, several blocks, and several passes; columns may have any name."""
    item = " ".join(f"i{k}" for k in range(30))
    texts = [(9006, "clean text"), (9006, "x " + item), (None, item + " tail"), (None, "clean text"), (9006, "clean text"), (None, None), (7, "other words " + item.upper()), (8, "")]
    docs = spark.createDataFrame([(i, t, k, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, item_ids int, row int")
    bench = spark.createDataFrame([(1, item), (2, "never seen at all by anyone"), (3, None), (4, item + " and more")], "item_id long, text string")
    seen = []
    for items, group in ((2000, 4), (1, 4), (1, 1)):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", items)
        monkeypatch.setattr(decontaminate, "GROUP_BLOCKS", group)
        for limit in (1_000_000, 0):
            monkeypatch.setattr(decontaminate, "BROADCAST_NUMBERS", limit)
            rows = sorted((str(r["id"]), tuple(r["item_ids"]), round(r["share"], 6)) for r in decontaminate.contaminated(docs, bench).collect())
            kept = decontaminate.drop_contaminated(docs, bench)
            assert kept.columns == docs.columns and sorted(r["item_ids"] for r in kept.collect()) == [0, 3, 4, 5, 7]
            seen.append(rows)
    assert all(s == seen[0] for s in seen) and len(seen[0]) == len(texts)
    assert [s[1] for s in seen[0]].count(()) == 5 and (1, 4) in {s[1] for s in seen[0]}


def test_leaks_anywhere_in_an_item_are_found(spark):
    """Long items with a fifth of their words replaced at both ends, at one end, or anywhere: of those whose share passes, nine in ten are found at least."""
    rng = random.Random(8)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    pool = " ".join(r["text"] or "" for r in docs.limit(60).collect()).split()
    items = {k: [rng.choice(pool) for _ in range(240)] for k in range(45)}
    passes, rows = set(), []
    for k, words in items.items():
        copy = list(words)
        at = [*range(24), *range(216, 240)] if k % 3 == 0 else range(44) if k % 3 == 1 else rng.sample(range(240), 45)
        for j in at:
            copy[j] = rng.choice(pool)
        if brute_lcs([w.lower() for w in words], [w.lower() for w in copy]) / 240 >= decontaminate.SURE:
            passes.add(k)
        lead = rng.randrange(200)
        rows.append((90_000 + k, " ".join(pool[lead : lead + rng.randrange(60)] + copy + pool[:20])))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    both = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["id"]: r["item_ids"] for r in decontaminate.contaminated(both, bench).where("id >= 90000").collect()}
    assert len(passes) > 20 and sum(k in got[90_000 + k] for k in passes) >= 0.9 * len(passes)


def test_common_subsequences_side_by_side():
    rng = np.random.default_rng(7)
    pairs = [(rng.integers(0, 6, rng.choice([1, 12, 40, 63, 64])), rng.integers(0, 8, rng.integers(0, 150))) for _ in range(120)]
    bits = [np.array([sum(1 << k for k in np.flatnonzero(a == x).tolist()) for x in b.tolist()], dtype=np.uint64) for a, b in pairs]
    got = decontaminate.common_subsequences(np.array([len(a) for a, _ in pairs]), np.concatenate(bits), np.array([len(b) for b in bits]))
    assert got.tolist() == [brute_lcs(a.tolist(), b.tolist()) for a, b in pairs]


def plain_hits(w, items, space):
    """Every window of every row against every item, without any bound."""
    hits = {}
    for r in range(w.hi - w.lo):
        lo, hi = int(w.first[r]), int(w.first[r + 1])
        for at in range(lo, hi, decontaminate.STEP):
            own = w.hashes[at : min(at + decontaminate.WINDOW, hi)]
            v = space[decontaminate.feature_of(own)].sum(axis=0)
            for k, item in enumerate(items.words):
                if len(item) < decontaminate.WINDOW or np.isin(own, item).sum() < decontaminate.SHARED * len(own):
                    continue
                to = items.windows[items.window_first[k] : items.window_first[k] + items.window_count[k]]
                near = w.hashes[max(lo, at - len(item)) : min(hi, at + decontaminate.WINDOW + len(item))]
                share, answer = decontaminate.common_subsequence(item, near) / len(item), item[-decontaminate.ANSWER_WORDS :].tolist()
                stands = share >= decontaminate.SURE or share >= decontaminate.LIKELY and any(near[j : j + len(answer)].tolist() == answer for j in range(len(near)))
                if stands and (to @ v).max() >= decontaminate.COSINE * np.linalg.norm(v):
                    hits[r, k] = max(share, hits.get((r, k), 0))
    return [(r, k, share) for (r, k), share in sorted(hits.items())]


def test_bounds_lose_nothing(monkeypatch):
    """Items of all sizes, shared answers, edits of up to 60 %, few and many kinds of words, and pieces of every size."""
    rng, found, likely = random.Random(12), 0, 0
    space = np.random.default_rng(3).standard_normal((decontaminate.FEATURES, decontaminate.RANK)).astype(np.float32)
    for kinds, pieces in itertools.product((8, 60, 2000), (False, True)):
        monkeypatch.setattr(decontaminate, "CELLS", 40 if pieces else 1 << 22)
        monkeypatch.setattr(decontaminate, "PAIRS", 3 if pieces else 1 << 13)
        monkeypatch.setattr(decontaminate, "NEAR_WORDS", 100 if pieces else 1 << 19)
        some = lambda n, kinds=kinds: [f"w{min(int(rng.expovariate(4 / kinds)), kinds)}" for _ in range(n)]
        items = [some(n) for n in (12, 13, 20, 40, 63, 64, 65, 130)]
        items[3][-5:] = items[2][-5:]
        texts = [None, "", "..."]
        for item in items * 3:
            part, keep = rng.choice([0, 0.15, 0.3, 0.45, 0.6]), len(item) - rng.choice([0, 5, 8])
            copy = [x if k >= keep or rng.random() >= part else rng.choice(["new", some(1)[0]]) for k, x in enumerate(item)]
            texts.append(" ".join(some(rng.randrange(60)) + copy + some(rng.randrange(60))))
        block = decontaminate.Items([(k, " ".join(x)) for k, x in enumerate(items)], space)
        for w in words_of(pa.array(texts, pa.string()), 3000, decontaminate.SYMBOLS):
            got, want = decontaminate.find_hits(w, block, space), plain_hits(w, block, space)
            assert got == want
            found, likely = found + len(got), likely + sum(share < decontaminate.SURE for _, _, share in got)
    assert found > 100 and likely > 10


def test_windows_that_cannot_stand_are_not_compared(monkeypatch):
    """Six in ten words of an item are too few without its answer, so these windows reach neither the cosine nor the subsequence."""
    space = np.random.default_rng(3).standard_normal((decontaminate.FEATURES, decontaminate.RANK)).astype(np.float32)
    words, compared, plain = [f"w{k}" for k in range(40)], [], decontaminate._nearest
    monkeypatch.setattr(decontaminate, "_nearest", lambda *a: compared.append(len(a[-1])) or plain(*a))
    part = [x if k % 5 < 3 else f"new{k}" for k, x in enumerate(words)]
    block = decontaminate.Items([(1, " ".join(words))], space)
    for tail, stands in ((part[35:], False), (words[35:], True)):
        text = " ".join(["before", "it", *part[:35], *tail, "after"])
        hits = decontaminate.find_hits(next(words_of(pa.array([text]), 1 << 20, decontaminate.SYMBOLS)), block, space)
        assert (bool(hits), sum(compared) > 0) == (stands, stands)


def test_sums_of_passages_are_the_products(monkeypatch):
    """C'C W and the document frequencies, with few and with all words in the dense part and passages in pieces."""
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(300))) for _ in range(30)] + [None, "", "..."]
    c = []
    for w in words_of(pa.array(texts, pa.string()), 1 << 30, decontaminate.SYMBOLS):
        for a, b in itertools.pairwise(w.first.tolist()):
            own = decontaminate.feature_of(w.hashes[a:b])
            c += [np.bincount(own[k : k + decontaminate.PASSAGE], minlength=decontaminate.FEATURES) for k in range(0, len(own), decontaminate.PASSAGE)]
    c = np.array(c)
    for dense, passages in ((1, 4096), (20, 7), (256, 4096)):
        monkeypatch.setattr(decontaminate, "DENSE", dense)
        monkeypatch.setattr(decontaminate, "PASSAGES", passages)
        got = next(decontaminate._summed(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])])))
        assert got.column(1).to_pylist() == [*(c > 0).sum(axis=0), len(c)]
        z = np.stack([x.to_numpy()[:-1] for x in got.columns[2:]], axis=1)
        assert np.allclose(z, c.T @ (c @ decontaminate.sketch_matrix().astype(float)), rtol=1e-4, atol=1e-3)
