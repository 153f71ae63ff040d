import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from sampleloom.llm import packing, token_counts, training_order
from sampleloom.llm.shared import new_path

SF = "/root/testdata/sf0.001"
ODD = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\xa0", "\u3000", "\u0301", "é", "é", "A", "Σ", "ς", "İ", "ß", "的", "가", "😀", "-", ".", "'s", "'", "&", "I'm", "th", "er", "ing", "▁",
       "ﬁ", "\x00", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "aaaa", "____", "123", "the", "a.b", ",x"]


def odd_texts(n, seed=0):
    rng = random.Random(seed)
    return [None, "", " ", "\n"] + ["".join(rng.choice(ODD) for _ in range(rng.randrange(16))) for _ in range(n)]


def plain_best_fit(lengths, window):
    """Windows opened and the capacities left, one rest at a time."""
    capacities, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(capacities, n)
        if at == len(capacities):
            opened, left = opened + 1, window - n
        else:
            left = capacities.pop(at) - n
        if left:
            bisect.insort(capacities, left)
    return opened, capacities


@pytest.mark.parametrize("window", [16, 100, 4096])
def test_runs_equal_plain_best_fit_decreasing(window):
    rng = random.Random(window)
    for _ in range(60):
        lengths = [rng.randint(1, window - 1) if rng.random() < 0.7 else rng.choice([1, 2, 3, window // 3]) for _ in range(rng.randint(1, 300))]
        runs, opened = packing.best_fit(Counter(lengths), window)
        placed = defaultdict(list)
        for length, _, count, first, offset in runs:
            for k in range(count):
                placed[first + k].append((offset, length))
        assert sorted(n for rows in placed.values() for _, n in rows) == sorted(lengths)
        left = []
        for rows in placed.values():
            at = 0
            for offset, length in sorted(rows):
                assert offset == at
                at += length
            left.append(window - at)
        n, capacities = plain_best_fit(lengths, window)
        assert (opened, sorted(c for c in left if c)) == (n, capacities)


def test_word_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path(packing.TOKENIZER)
    library, coder, texts = Tokenizer.from_file(path), packing.WordTokenizer(path, cache_words=500), odd_texts(3000)
    for (_, ids), text in zip(coder.encode(pa.array(texts)), texts):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_pieces_cover_all_ids_and_sequences_are_gapless(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    texts = odd_texts(60) + ["word " * 9000, "the same", "the same"]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(None, "x", 0), (5, texts[5], 0)], "doc_id long, text string, length int")
    pieces = packing.pack_documents(docs, window=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert len(by_doc) == len(texts) + 1
    for k, text in enumerate(texts):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        own = sorted(by_doc[k], key=lambda p: p["start"])[:: 2 if k == 5 else 1]
        assert [p["start"] for p in own] == list(range(0, len(ids), 64))
        for p in own:
            assert p["crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    for rows in by_sequence.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_counts_equal_the_library():
    import sentencepiece

    path = packing.tokenizer_path(token_counts.MODEL)
    library, texts = sentencepiece.SentencePieceProcessor(model_file=path), odd_texts(4000, 1) + ["x" * 3000, "的" * 500, "ab" * 700 + " " * 300]
    counter = token_counts.TokenCounter(path, memory_units=400)
    assert counter.counts(pa.array(texts)).tolist() == [len(x) for x in library.encode([t or "" for t in texts])]


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(k).count("1") & 1] for k in range(n))


def test_long_units_equal_the_library_in_bounded_memory():
    """Chunks of a text without spaces compose to the library's count, whatever their first guess."""
    import resource

    import sentencepiece

    path = packing.tokenizer_path(token_counts.MODEL)
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(4)
    words = " " + " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 12))) for _ in range(5000))
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(20_000))
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(300_000))
    texts = [cjk + words, noise + words, "x" * 50_001, "ab" * 3000 + "a", thue_morse(5000), "".join(rng.choice(["the", "in", "ing", "a"]) for _ in range(9000)), "😀é" * 2000, "x" * 1024, "x" * 1025]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert token_counts.TokenCounter(path).counts(pa.array(texts)).tolist() == [len(x) for x in library.encode(texts)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 * 1024


def test_wrong_guesses_of_chunks_are_run_again(monkeypatch):
    import sentencepiece

    path = packing.tokenizer_path(token_counts.MODEL)
    monkeypatch.setattr(token_counts, "CHUNK", 40)
    monkeypatch.setattr(token_counts, "WARM", 16)
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(5)
    texts = ["".join(rng.choice(["the", "ing", "a", "x", "xx", "er", "é", "的", "😀"]) for _ in range(rng.randrange(20, 200))) for _ in range(150)] + ["x" * 999, "ab" * 333]
    assert token_counts.TokenCounter(path).counts(pa.array(texts)).tolist() == [len(x) for x in library.encode(texts)]


def test_words_that_a_polynomial_hash_confuses():
    import sentencepiece
    from tokenizers import Tokenizer

    from sampleloom.llm.text_arrays import words_of

    pair = [thue_morse(1024), thue_morse(1024, "b", "a")]
    w = next(words_of(pa.array([" ".join(pair)])))
    assert w.hashes[0] != w.hashes[1]
    path = packing.tokenizer_path(token_counts.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    text = " ".join(pair * 2)
    assert token_counts.TokenCounter(path).counts(pa.array([text])).tolist() == [len(library.encode(text))]
    path = packing.tokenizer_path(packing.TOKENIZER)
    ids = [x.tolist() for _, x in packing.WordTokenizer(path).encode(pa.array([text]))]
    assert ids == [Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids]


def test_spans_of_one_hash_keep_their_own_values():
    from sampleloom.llm.text_arrays import SpanMemory

    spans = [0, 1, 2, 0, 1, 3]
    hashes, checks = np.array([5, 5, 6, 5, 5, 7], np.uint64), np.array([1, 2, 3, 1, 2, 4], np.uint64)
    compute = lambda k: (np.repeat([spans[i] for i in k], [spans[i] for i in k]).astype(np.int32), np.array([spans[i] for i in k], np.int64))
    memory = SpanMemory(100)
    assert memory.resolve(hashes[:1], checks[:1], lambda k: (np.array([9], np.int32), np.array([1])))[0].tolist() == [9]
    for _ in range(2):
        values, lo, length = memory.resolve(hashes, checks, compute)
        runs = [values[a : a + n].tolist() for a, n in zip(lo, length)]
        assert runs == [[0] * 0, [1], [2, 2], [], [1], [3, 3, 3]]


def test_token_counts_of_edge_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "é x", 1)], "doc_id long, text string, n_tokens int")
    got = sorted((r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs).collect())
    assert got[:2] == [(0, 0), (0, 0)] and got[2][0] == 4
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_ids_that_do_not_fit_a_record_are_an_error(monkeypatch):
    class Wide:
        def encode(self, column):
            yield 0, np.array([1, 65_536], np.int32)

    monkeypatch.setattr(packing, "word_tokenizer", lambda path: Wide())
    monkeypatch.setattr(training_order.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["x"])], names=["id", "text"])
    with pytest.raises(ValueError, match="65536"):
        list(training_order._sequencer(None, 2, 2)(iter([batch])))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 5000])
def test_slots_are_a_permutation(n):
    slots = training_order.permute(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 64 or (slots != training_order.permute(np.arange(n), n, key=1)).any()


def test_shards_round_trip_and_resume(spark):
    texts = odd_texts(40) + ["word " * 3000]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, slot int").repartition(3)
    path = new_path(spark, "test-order")
    n = training_order.write_training_order(docs, path, window=32, shard_rows=8)
    rows = training_order.read_shards(spark, path, 32, 8, with_ids=True).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(n)) and all(r["sound"] for r in rows)
    coder = packing.word_tokenizer()
    ids = Counter(i for _, x in coder.encode(pa.array(texts)) for i in [*x.tolist(), 2])
    assert Counter(i for r in rows for i in r["ids"]) == ids
    assert all(r["byte_offset"] == r["slot"] % 8 * training_order.stride_of(32) for r in rows)
    rest = training_order.read_shards(spark, path, 32, 8, from_slot=n // 2).orderBy("slot").collect()
    assert [r["slot"] for r in rest] == list(range(n // 2, n))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("shard", "path").collect()
    assert sorted(r["shard"] for r in files) == list(range(-(-n // 8)))  # one file each
    by_task = defaultdict(list)
    for r in files:
        by_task[r["path"].rsplit("/part-", 1)[1].split("-")[0]].append(r["shard"])
    assert len(by_task) == 4 and all(sorted(x) == list(range(min(x), max(x) + 1)) for x in by_task.values())
    empty = new_path(spark, "test-order")
    assert training_order.write_training_order(docs.limit(0), empty) == 0
