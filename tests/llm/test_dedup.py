import random
import re
from collections import Counter, defaultdict

import pytest
from sampleloom.llm import exact_dedup, line_dedup, near_dedup
from sampleloom.llm.components import components

TEXTS = [None, "", "a", "A", "same text here", "same text here", "same text here", " \n\t", "é", "x" * 200_000, "word " * 5000]


def frame(spark, texts, first=0):
    rows = [(first + k, t, "x", k, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n int, bucket string")


def test_exact_groups_match_brute_force(spark):
    got = {r["id"]: r for r in exact_dedup.exact_duplicates(frame(spark, TEXTS)).collect()}
    groups = defaultdict(list)
    for k, t in enumerate(TEXTS):
        groups[t or ""].append(k)
    assert len(got) == len(TEXTS)
    for ids in groups.values():
        for k in ids:
            assert (got[k]["winner"], got[k]["copies"]) == (max(ids), len(ids))


def test_index_is_minimal_and_perfect(spark):
    rows = frame(spark, [f"text {k}" for k in range(3000)]).select("doc_id", "text")
    digests = rows.select(rows.doc_id.alias("id"), exact_dedup.digest_of("text").alias("digest"))
    index, n = exact_dedup.build_index(digests)
    slots = sorted(r["slot"] for r in exact_dedup.lookup(digests, index, n).collect())
    assert slots == list(range(3000))
    strangers = frame(spark, [f"other {k}" for k in range(500)])
    probe = strangers.select(strangers.doc_id.alias("id"), exact_dedup.digest_of("text").alias("digest"))
    assert exact_dedup.lookup(probe, index, n).where("slot IS NOT NULL").count() == 0


def test_large_bucket_is_split():
    keys = [{"digest": bytes([k]) * 32, "winner": k, "copies": 1} for k in range(60)]
    split, starts, seeds, slots = exact_dedup.solve_bucket(keys)
    assert sorted(s["winner"] for s in slots) == list(range(60))
    assert max(b - a for a, b in zip(starts, starts[1:])) <= exact_dedup.KEYS_PER_SEED


def test_repeats_of_history_are_removed_and_the_rest_groups(spark):
    history = frame(spark, ["old", "older", "old"])
    batch = frame(spark, ["old", "new", "new", None], first=10)
    got = {r["id"]: (r["winner"], r["copies"], r["member"]) for r in exact_dedup.exact_duplicates(batch, history).collect()}
    assert got == {10: (2, 3, True), 11: (12, 2, False), 12: (12, 2, False), 13: (13, 1, False)}
    assert [r["doc_id"] for r in exact_dedup.drop_exact_copies(batch, history).orderBy("doc_id").collect()] == [12, 13]


def test_exact_nulls_repeats_and_empty_table(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (3, "a"), (3, "a")], "doc_id long, text string")
    got = Counter((r["id"], r["winner"], r["copies"]) for r in exact_dedup.exact_duplicates(rows).collect())
    assert got == {(None, 3, 3): 1, (None, None, 1): 1, (3, 3, 3): 2}
    assert exact_dedup.exact_duplicates(rows.limit(0)).count() == 0
    assert exact_dedup.drop_exact_copies(rows).columns == rows.columns


REPEATS = [(3, "x"), (3, "same"), (9, "same"), (7, "twice"), (7, "twice"), (None, "n1"), (None, "same"), (None, None), (5, ""), (None, "n2"), (None, "n2")]


def test_exact_stage_leaves_one_row_of_each_text(spark):
    rows = spark.createDataFrame([(i, t, k, "c") for k, (i, t) in enumerate(REPEATS)], "doc_id long, text string, m int, key string")
    kept = exact_dedup.drop_exact_copies(rows)
    assert kept.columns == rows.columns
    best = {}
    for i, t in REPEATS:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    got = sorted((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect())
    assert got == sorted(best.items())
    assert [r["m"] for r in kept.where("text IN ('twice', 'n2')").orderBy("m").collect()] == [3, 10]  # in the order of their JSON


def brute_components(texts, words, percent):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_groups_match_brute_force(spark, words):
    rng = random.Random(words)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = {}
    for base in range(25):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 6, 40, 120]))]
        for _ in range(rng.choice([1, 2, 8])):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(copy) // 10)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(copy).title() if rng.random() < 0.3 else "\n".join(copy)
    texts[len(texts)] = None
    texts[len(texts)] = " \t\n"
    rows = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, component int")
    got = {r["id"]: (r["n"], r["component"]) for r in near_dedup.near_duplicates(rows, words=words).collect()}
    assert got == brute_components(texts, words, 80)


def test_hub_with_spokes_is_found_in_blocks(spark):
    """Variants that are near one base but not near each other."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(300)]
    texts = {0: " ".join(base)}
    for k in range(1, 60):
        copy = list(base)
        for at in rng.sample(range(300), 14 if k % 2 else 40):
            copy[at] = f"v{rng.randrange(30)}"
        texts[k] = " ".join(copy)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: (r["n"], r["component"]) for r in near_dedup.near_duplicates(rows, words=2).collect()}
    assert got == brute_components(texts, 2, 80)


def test_near_edge_rows(spark):
    rows = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (7, None)], "doc_id long, text string")
    got = Counter((r["id"], r["component"]) for r in near_dedup.near_duplicates(rows).collect())
    assert got == {(None, 4): 1, (4, 4): 2, (7, 7): 1}
    assert near_dedup.near_duplicates(rows.limit(0)).count() == 0
    assert near_dedup.drop_near_copies(rows).columns == rows.columns
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.drop_near_copies(rows).collect()) == [(4, "a b c"), (7, None)]


def test_near_rows_of_one_id_are_documents_of_their_own(spark):
    words = [f"w{k}" for k in range(60)]
    base, near, other = " ".join(words), " ".join([*words[:-1], "z"]), " ".join(f"u{k}" for k in range(60))
    rows = [(1, base), (1, base), (2, near), (2, other), (None, other + " more"), (None, "lone text without any id"), (5, other.upper()), (5, "t5"), (1, "t1"), (None, "lone text without any id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["id"], r["component"], r["kept"]) for r in near_dedup.near_duplicates(frame).collect())
    assert got == {(1, 1, True): 3, (2, 1, False): 1, (2, 2, True): 1, (None, 2, False): 1, (None, None, True): 2, (5, 2, False): 1, (5, 5, True): 1}
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.drop_near_copies(frame).collect()]
    assert Counter(kept) == Counter([(1, base), (2, other), (None, "lone text without any id"), (5, "t5"), (1, "t1")])


def test_words_of_one_polynomial_hash_are_not_linked(spark):
    thue = lambda a, b: "".join((a, b)[bin(k).count("1") & 1] for k in range(1024))
    rows = spark.createDataFrame([(1, thue("a", "b")), (2, thue("b", "a"))], "doc_id long, text string")
    assert {r["id"]: r["component"] for r in near_dedup.near_duplicates(rows, words=2).collect()} == {1: 1, 2: 2}


def test_densified_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    pool = np.unique(rng.integers(0, 1 << 63, 600).astype(np.uint64))
    a, b = pool[:30], np.concatenate([pool[:24], pool[100:106]])
    rate = []
    for salt in range(60):
        from sampleloom.llm.text_arrays import mix

        sa, sb = (near_dedup.signature(np.unique(mix(x + np.uint64(salt))), 200) for x in (a, b))
        rate.append((sa == sb).mean())
    assert abs(np.mean(rate) - 24 / 36) < 0.05


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(10, 40)] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 10 for k in range(11, 41)) and all(got[k] == 100 for k in range(101, 160)) and 5 not in got


def brute_lines(texts):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for k, t in texts.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(k)
    out = {}
    for k, t in texts.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or k == min(holders[key(x)])]
        out[k] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


def test_lines_match_brute_force(spark):
    texts = dict(enumerate([None, "", "\n\n", "the same long line\nown line of one", "x\n THE SAME LONG LINE\t\ny", "short\nshort", "short",
                            "the same long line", "twice in one document\ntwice in one document", "ÉÉÉÉÉÉÉÉÉÉ", "éééééééééé", " the same long line"]))
    rows = spark.createDataFrame([(k, t, "c", 0) for k, t in texts.items()], "doc_id long, text string, key string, pos int")
    got = {r["id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_repeated_lines(rows).collect()}
    assert got == brute_lines(texts)
    assert line_dedup.drop_repeated_lines(rows.limit(0)).count() == 0


def test_lines_of_rows_that_repeat_an_id(spark):
    """Holders are ids; each row loses its own lines only."""
    a, b, c = "shared line one\nown line of A", "first line of B\nshared line one", "shared line one\nshared line two"
    rows = [(1, "shared line one\nshared line two"), (2, a), (2, b), (None, c), (None, "own line of N\nother line of N"), (2, b)]
    holders = defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            holders[line].add(i)
    first = {k: min(i for i in v if i is not None) for k, v in holders.items() if len(v) > 1}
    want = sorted((i or 0, "\n".join(x for x in t.split("\n") if x not in first or i == first[x])) for i, t in rows)
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"] or 0, r["text"]) for r in out) == want
    assert all(r["n_dropped"] == r["n_lines"] - (r["text"].count("\n") + 1 if r["text"] else 0) for r in out)


def test_line_threshold_and_native_plan(spark):
    rows = spark.createDataFrame([(k, "one long line here\nunique line no %d" % k) for k in range(4)] + [(9, "another long line"), (10, "another long line")], "doc_id long, text string")
    out = line_dedup.drop_repeated_lines(rows, min_docs=3)
    assert {r["id"]: r["n_dropped"] for r in out.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 9: 0, 10: 0}
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
