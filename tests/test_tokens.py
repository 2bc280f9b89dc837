"""Vocabularies, encoding, byte-pair training and denoising."""

from __future__ import annotations

import json
import os
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import ByteLevelBPETokenizer, pre_tokenizers

from lingweave.functions import arrays as A
from lingweave.functions.rng import drawn, uniform
from lingweave.functions.tokens import pretokenize
from lingweave.functions.whitespace import ws_tokens
from lingweave.operators import bpe, denoise, encode, indexing, vocab
from lingweave.plans import queries, tables as T
from lingweave.session import shared_dir

SENTENCES = [
    "kal ka weather kaisa hai?",
    "I don't pienso que it's   OK…  de verdad!!",
    "aaaa aaa aa a  bbbb abababab",
    "नमस्ते 你好 \U0001f600\U0001f600 x​y é1234 ½",
    "tabs\tand\nlines \n\n end ",
    "",
] * 3


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(SENTENCES)), "row_id long, text string").repartition(3)


def library(texts, merges):
    tok = ByteLevelBPETokenizer()
    tok.train_from_iterator(
        texts, vocab_size=260 + merges, min_frequency=1, special_tokens=A.SPECIAL_TOKENS, show_progress=False
    )
    return tok


def library_merges(tok):
    merges = json.loads(tok.to_str())["model"]["merges"]
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]


def learnt_pairs(merges, spark):
    return [(r["left"], r["right"]) for r in bpe.merge_table(merges, spark).orderBy("rank").collect()]


def test_pieces_equal_the_library(spark, sf, texts):
    pre = pre_tokenizers.ByteLevel(add_prefix_space=False)
    docs = T.docs(spark, sf).select("text").unionByName(texts.select("text"))
    for text, pieces in docs.select("text", pretokenize(F.col("text"))).collect():
        assert pieces == [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]


def test_training_equals_the_library(spark, texts):
    merges = bpe.train(bpe.piece_freq(texts, F.col("text")), 60)
    tok = library(SENTENCES, 60)
    assert learnt_pairs(merges, spark) == library_merges(tok)
    ids = texts.select("text", bpe.bpe_ids(F.col("text"), merges, spark)).collect()
    assert all(list(got) == tok.encode(text).ids for text, got in ids)
    table = {r["token"]: r["id"] for r in bpe_vocab(spark, merges).collect()}
    assert {t: i for t, i in tok.get_vocab().items()} == {t: i for t, i in table.items() if t != A.MASK_TOKEN}


def test_long_words_are_split_fast_and_right(spark, texts):
    merges = bpe.train(bpe.piece_freq(texts, F.col("text")), 60)
    tok = library(SENTENCES, 60)
    long = ["ab" * 50_000, "a" * 99_999, "abababa" * 9_999]
    df = spark.createDataFrame([(t,) for t in long], "text string")
    for text, ids in df.select("text", bpe.bpe_ids(F.col("text"), merges, spark)).collect():
        assert list(ids) == tok.encode(text).ids


def bpe_vocab(spark, merges):
    return vocab.byte_vocab(bpe.token_texts(merges), spark)


def test_training_on_documents_equals_the_library(spark, sf):
    docs = T.docs(spark, sf).where("split <> 'train'")
    merges = bpe.train(bpe.piece_freq(docs, F.col("text")), 40)
    assert learnt_pairs(merges, spark) == library_merges(library([r["text"] for r in docs.collect()], 40))


def test_training_stops_without_pairs(spark):
    words = spark.createDataFrame([("ab", 3), ("c", 9)], "word string, freq long")
    assert [(m.rank, m.merged) for m in bpe.train(words, 50)] == [(0, bpe.FIRST_MERGE)]
    assert bpe.train(words, 50, min_frequency=4) == []


def test_incremental_training_keeps_merges(spark, texts):
    old = bpe.piece_freq(texts.where("row_id % 2 = 0"), F.col("text"))
    new = bpe.piece_freq(texts.where("row_id % 2 = 1"), F.col("text"))
    first = bpe.train(old, 12)
    more = bpe.train(vocab.add_freqs(old, new), 25, known=first)
    assert more[:12] == first and len(more) == 25
    # what follows equals brute-force greedy training on all words from the saved state
    words = Counter({r["word"]: r["freq"] for r in vocab.add_freqs(old, new).collect()})
    state = Counter()
    for w, n in words.items():
        state[tuple(bpe_bytes(spark, w))] += n
    for k in range(25):
        if k < 12:
            best = (first[k].left, first[k].right)
        else:
            pairs = Counter()
            for w, n in state.items():
                for p in zip(w, w[1:]):
                    pairs[p] += n
            best = min(pairs, key=lambda p: (-pairs[p], p))
            assert best == (more[k].left, more[k].right)
        merged = Counter()
        for w, n in state.items():
            out, i = [], 0
            while i < len(w):
                if w[i : i + 2] == best:
                    out.append(bpe.FIRST_MERGE + k)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            merged[tuple(out)] += n
        state = merged


def bpe_bytes(spark, word):
    from lingweave.functions.tokens import byte_alphabet, byte_characters

    ids, chars = byte_alphabet(bpe.FIRST_BYTE), byte_characters()
    return [ids[chars[b]] for b in word.encode("utf-8")]


def test_merges_can_be_stored(spark, texts, tmp_path):
    merges = bpe.train(bpe.piece_freq(texts, F.col("text")), 8)
    bpe.save_merges(merges, spark, str(tmp_path / "m"))
    assert bpe.load_merges(spark, str(tmp_path / "m")) == merges


def test_word_vocab_styles(spark):
    freq = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", 1), ("<s>", 99)], "word string, freq long")
    base = vocab.ranked_vocab(freq, 3)
    tokens = lambda df: [r["token"] for r in df.orderBy("id").collect()]
    assert tokens(base) == [*A.SPECIAL_TOKENS, "c", "a", "b", A.MASK_TOKEN]
    assert tokens(vocab.ranked_vocab(freq, 3, mask=False)) == [*A.SPECIAL_TOKENS, "c", "a", "b"]
    trained = spark.createDataFrame([(0, "zz"), (1, "a"), (2, "aa")], "id int, token string")
    assert vocab.style_vocab("DEFAULT", base) is base
    assert vocab.style_vocab("SCRATCH", base, trained) is trained
    appended = vocab.style_vocab("APPEND", base, trained)
    assert tokens(appended) == [*A.SPECIAL_TOKENS, "c", "a", "b", A.MASK_TOKEN, "zz", "aa"]
    assert [r["id"] for r in appended.orderBy("id").collect()] == list(range(10))
    with pytest.raises(ValueError):
        vocab.style_vocab("APPEND", base)


@pytest.fixture(scope="module")
def lookup(spark):
    words = [(f"w{i}", 100 - i) for i in range(50)]
    return vocab.TokenLookup(vocab.ranked_vocab(spark.createDataFrame(words, "word string, freq long"), 50))


def test_encode_and_decode(spark, lookup):
    texts = ["w0 w1  nope", "", None, " ".join(f"w{i}" for i in range(40))]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "row_id long, hi_en string, en string")
    rows = encode.encode_pairs(df, "hi_en", "en", lookup, lookup).orderBy("row_id").collect()
    assert rows[0]["input_ids"] == [0, 4, 5, 3, 2] + [1] * 25
    assert rows[0]["attention_mask"] == [1] * 5 + [0] * 25
    assert rows[0]["labels"] == [0, 4, 5, 3, 2] + [-100] * 25
    assert rows[1]["input_ids"] == [0, 2] + [1] * 28
    assert rows[3]["input_ids"] == [0, *range(4, 32), 2]
    assert rows[2]["input_ids"] == rows[1]["input_ids"]
    labels = encode.encode_pairs(df, "hi_en", "en", lookup, lookup)
    got = encode.decode_ids(labels, "labels", lookup, "decoded").orderBy("row_id").select("decoded").collect()
    assert [r[0] for r in got] == ["w0 w1", "", "", " ".join(f"w{i}" for i in range(28))]
    with pytest.raises(ValueError, match="missing columns"):
        encode.encode_text(df, "nope", lookup)


def test_windows_cover_whole_texts(spark, lookup):
    texts = ["", None, " ".join(f"w{i % 50}" for i in range(28)), " ".join(f"w{i % 50}" for i in range(75))]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    rows = encode.encode_windows(df, "text", lookup).orderBy("row_id", "part").collect()
    assert [(r["row_id"], r["part"]) for r in rows] == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2)]
    assert [x for r in rows[3:] for x in r["input_ids"] if x > 3] == [4 + i % 50 for i in range(75)]
    assert all(len(r["input_ids"]) == 30 and r["input_ids"][0] == 0 for r in rows)


def test_lookup_by_join_equals_broadcast(spark, lookup):
    joined = vocab.TokenLookup(lookup.vocab, limit=5)
    assert joined.special_ids() == lookup.special_ids() and joined.id_of(A.MASK_TOKEN) == lookup.id_of(A.MASK_TOKEN)
    texts = ["w3 x w3", "", None, "w1", "w1", " ".join(f"w{i % 60}" for i in range(100))]
    df = spark.createDataFrame([(i // 2, t, {"k": "v"}) for i, t in enumerate(texts)], "row_id long, text string, `a.b` map<string,string>")
    shown = lambda frame: sorted(map(str, frame.collect()))
    for most in (None, 28):
        sent, far = (x.encoded(df, "text", "ids", most) for x in (lookup, joined))
        assert shown(sent) == shown(far.select(*[f"`{c}`" for c in sent.columns]))
    ids = lookup.encoded(df, "text", "ids").drop("a.b")
    back = [encode.decode_ids(ids, "ids", x, "back").select("row_id", "text", "back") for x in (lookup, joined)]
    assert shown(back[0]) == shown(back[1])


@pytest.fixture(scope="module")
def thousand(spark):
    """A thousand merges on the smallest documents, by the library and here."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [r.text for r in docs.collect()]
    return docs, rows, library(rows, 1000), bpe.train(bpe.piece_freq(docs, F.col("text")), 1000)


def test_thousand_merges_equal_the_library(spark, thousand):
    docs, rows, tok, merges = thousand
    tokenizer = bpe.BpeTokenizer(merges, spark)
    got = {r.doc_id: (r.text, r.ids) for r in tokenizer.encoded(docs, "text", "ids").collect()}
    assert all(ids == tok.encode(text).ids for text, ids in got.values())


def test_training_goes_on_from_known_merges(spark, thousand, monkeypatch):
    docs, _, _, merges = thousand
    rounds = []
    best = bpe.best_pairs
    monkeypatch.setattr(bpe, "best_pairs", lambda *a: rounds.append(1) or best(*a))
    assert bpe.train(bpe.piece_freq(docs, F.col("text")), 1000, known=merges[:998]) == merges
    assert len(rounds) <= 2


def test_byte_pairs_of_pairs_and_back(spark, thousand):
    _, _, tok, merges = thousand
    tokenizer = bpe.BpeTokenizer(merges, spark)
    texts = [*dict.fromkeys(SENTENCES), "中" * 20, None]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "row_id long, hi_en string, en string")
    rows = encode.encode_pairs(df, "hi_en", "en", tokenizer, tokenizer)
    decoded = encode.decode_ids(rows, "labels", tokenizer, "decoded").orderBy("row_id").collect()
    for r in decoded:
        ids = tok.encode(r.en or "").ids[:28]
        assert r.input_ids == [0, *ids, 2] + [1] * (28 - len(ids))
        assert r.labels == [0, *ids, 2] + [-100] * (28 - len(ids))
        # a character cut by the length limit decodes to the replacement character, as in the library
        assert r.decoded == tok.decode(ids, skip_special_tokens=True)
    totals = vocab.token_totals(df.withColumn("split", F.lit("s")), "split", ["en"], tokenizer.count).first()
    assert totals.tokens == sum(len(tok.encode(t or "").ids) for t in texts)
    windows = encode.encode_windows(df.drop("hi_en"), "en", tokenizer).collect()
    assert len(windows) == sum(max(1, -(-len(tok.encode(t or "").ids) // 28)) for t in texts)


def test_training_leaves_no_tables(spark, tmp_path):
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    bpe.train(bpe.piece_freq(spark.createDataFrame([("abab abc",)], "text string"), F.col("text")), 12)
    assert set(os.listdir(folder)) - before <= {d for d in os.listdir(folder) if not d.startswith("bpe")}


def test_vocabulary_is_stored(spark, tmp_path):
    table = spark.createDataFrame([(1, "b"), (0, "a")], "id int, token string")
    bpe.save_vocabulary(table, str(tmp_path / "v"))
    assert [tuple(r) for r in bpe.load_vocabulary(spark, str(tmp_path / "v")).collect()] == [(0, "a"), (1, "b")]


def test_pad_batch(spark):
    df = spark.createDataFrame([(0, [0, 2]), (0, [0, 5, 6, 2]), (1, [0, 2])], "batch_id int, ids array<int>")
    got = encode.pad_batch(df, "ids").orderBy("batch_id", F.size("ids"), "ids").collect()
    assert sorted((r["batch_id"], r["ids"], r["attention_mask"]) for r in got) == [
        (0, [0, 2, 1, 1], [1, 1, 0, 0]),
        (0, [0, 5, 6, 2], [1, 1, 1, 1]),
        (1, [0, 2], [1, 1]),
    ]


def test_array_helpers(spark):
    df = spark.createDataFrame([([0, 7, 3, 9, 2, 1, 1], [0.1, 0.9, 0.9, 0.2])], "ids array<int>, logits array<double>")
    row = df.select(
        A.special_mask(F.col("ids"), [0, 1, 2, 3]),
        A.pad_positions(F.col("ids")),
        A.argmax_decode(A.steps(F.col("logits"), 2)),
        A.restore_ignored(F.array(F.lit(5), F.lit(-100))),
    ).first()
    assert [list(c) for c in row] == [[1, 0, 1, 0, 1, 1, 1], [5, 6], [1, 0], [5, 2]]


NOISE = denoise.Noise([0, 1, 2, 3, 99], 99)


@pytest.fixture(scope="module")
def encoded(spark):
    """Rows with 0 to 28 free tokens, some unknown ids in between."""
    rows = []
    for i in range(2000):
        n = i % 29
        ids = [0, *[3 if (i + k) % 11 == 0 else 10 + k for k in range(n)], 2]
        rows.append((i, i // 32, ids + [1] * (30 - len(ids))))
    return spark.createDataFrame(rows, "row_id long, batch_id long, ids array<int>").repartition(4)


def spans(mask):
    on = [i for i, m in enumerate(mask) if m]
    return (on[0], len(on), on == list(range(on[0], on[-1] + 1))) if on else (0, 0, True)


def test_unit_and_span_masks(encoded):
    rows = denoise.mask_tokens(encoded, "ids", "row_id", "batch_id", NOISE).collect()
    hits = total = 0
    for r in rows:
        assert len(r["mask"]) == 30
        for x, m, d, label in zip(r["ids"], r["mask"], r["denoised"], r["mask_labels"]):
            assert (d, label) == ((99, x) if m else (x, -100))
    for r in denoise.mask_tokens(
        encoded, "ids", "row_id", "batch_id", denoise.Noise([0, 1, 2, 3, 99], 99, group_mask=False)
    ).collect():
        for x, m in zip(r["ids"], r["mask"]):
            assert not (m and x in NOISE.special_ids)
            total += x not in NOISE.special_ids
            hits += m
    assert 0.13 < hits / total < 0.17


def test_span_masks_follow_the_window_rules(encoded):
    rows = denoise.group_mask(encoded, "ids", "row_id", NOISE).collect()
    sizes = Counter()
    for r in rows:
        start, size, whole = spans(r["mask"])
        free = [i for i, x in enumerate(r["ids"]) if x not in NOISE.special_ids]
        sizes[size] += 1
        if size:
            assert whole and size <= 5 and start >= free[0] and start + size <= free[-1]
    assert set(sizes) == set(range(6)) and 0.08 < 1 - sizes[0] / len(rows) < 0.16


def test_permutation_keeps_tokens(encoded):
    rows = denoise.permute_tokens(encoded, "ids", "row_id", NOISE).collect()
    moved = 0
    for r in rows:
        start, size, whole = spans(r["mask"])
        assert whole and size in (0, 2, 3, 4, 5)
        assert sorted(r["denoised"]) == sorted(r["ids"])
        outside = [i for i in range(30) if not r["mask"][i]]
        assert all(r["ids"][i] == r["denoised"][i] for i in outside)
        moved += r["ids"] != r["denoised"]
        free = [i for i, x in enumerate(r["ids"]) if x not in NOISE.special_ids]
        if len(free) <= 2 and (not free or free[-1] - free[0] < 2):
            assert size == 0
    assert moved > 400


def test_mixed_task_is_fixed_per_batch(encoded):
    rows = denoise.denoise_mixed(encoded, "ids", "row_id", "batch_id", NOISE).collect()
    again = denoise.denoise_mixed(encoded.repartition(7), "ids", "row_id", "batch_id", NOISE).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    tasks = {(r["batch_id"], r["task"]) for r in rows}
    assert len(tasks) == len({b for b, _ in tasks}) and {t for _, t in tasks} == {"mask", "permute"}
    assert len({r["row_id"] for r in rows}) == 2000


def test_mixed_task_equals_the_single_tasks(encoded):
    for noise in (NOISE, denoise.Noise([0, 1, 2, 3, 99], 99, group_mask=False)):
        columns = ["row_id", "denoised", "mask", "mask_labels"]
        single = {
            "mask": denoise.mask_tokens(encoded, "ids", "row_id", "batch_id", noise),
            "permute": denoise.permute_tokens(encoded, "ids", "row_id", noise),
        }
        expected = {(task, r["row_id"]): r for task, df in single.items() for r in df.select(columns).collect()}
        for r in denoise.denoise_mixed(encoded, "ids", "row_id", "batch_id", noise).collect():
            assert all(r[c] == expected[r["task"], r["row_id"]][c] for c in columns)


def test_drawn_equals_the_uniform_number(spark):
    df = spark.range(3000).withColumn("u", uniform(7, "t", F.col("id")))
    for p in (-1.0, 0.0, 0.15, 1 / 3, 0.5, 1 - 2**-40, 1.0, 2.0):
        assert df.where(drawn(7, "t", p, F.col("id")) != (F.col("u") < p)).count() == 0
    edge = df.first()["u"]
    assert df.where(drawn(7, "t", edge, F.col("id")) != (F.col("u") < edge)).count() == 0


def test_noise_input_reads_and_cleans_every_text_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    words = [" ".join(f"w{(i * k) % 41}" for k in range(i)) for i in range(60)]
    rows = [(i, words[i] or None, "train" if i % 3 else "test") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, split string")
    monkeypatch.setattr(queries.T, "docs", lambda *_: table.withColumn("text", counted("text")))
    got, noise = queries._noise_input(spark, "")
    assert got.count() == sum(max(1, -(-len(w.split()) // 28)) for w in words)
    assert noise.special_ids[:4] == [0, 1, 2, 3] and noise.mask_id == noise.special_ids[4]
    assert seen.value == len(rows)


def test_noise_windows_of_repeated_and_missing_keys(spark, lookup):
    """Windows of equal key and part share their places, each with every one; rows without key keep theirs but are not returned."""
    sizes = [(5, 0), (None, 30), (3, 57), (3, 29), (3, 57), (9, 28), (1, 1)]
    docs = spark.createDataFrame([(k, " ".join(["kal"] * n)) for k, n in sizes] + [(k, "ki " * 70) for k in range(20, 60)], "doc_id long, text string")
    rows, _ = queries._noise_windows(docs, lookup)
    got = Counter((r["doc_id"], r["part"], r["batch_id"], tuple(r["input_ids"])) for r in rows.collect())
    windows = encode.encode_windows(docs, "text", lookup).collect()
    places = {}
    for i, (k, part) in enumerate(sorted((-1 if r["doc_id"] is None else r["doc_id"], r["part"]) for r in windows)):
        places.setdefault((k, part), []).append(i // 32)
    expected = Counter(
        (r["doc_id"], r["part"], b, tuple(r["input_ids"]))
        for r in windows if r["doc_id"] is not None for b in places[r["doc_id"], r["part"]]
    )
    assert got == expected and len({k[2] for k in got}) > 3


def test_noise_off(encoded):
    for rows in (
        denoise.mask_tokens(encoded, "ids", "row_id", "batch_id", NOISE, enabled=False),
        denoise.permute_tokens(encoded, "ids", "row_id", NOISE, enabled=False),
    ):
        r = rows.first()
        assert r["denoised"] == r["ids"] and set(r["mask"]) == {0} and set(r["mask_labels"]) == {-100}


def test_counts(spark, texts):
    words = Counter(w for t in SENTENCES for w in t.split())
    got = vocab.word_freq(texts, ws_tokens(F.col("text"))).collect()
    assert {r["word"]: r["freq"] for r in got} == words
    chars = {r[0] for r in vocab.char_vocab(texts, F.col("text")).collect()}
    assert chars == set("".join(SENTENCES))
    assert indexing.split_stats(texts.withColumn("split", F.lit("t"))).first()["batches"] == 1


def test_lookup_takes_tokens_in_batches_of_some_megabytes(spark, lookup):
    @F.arrow_udf("long")
    def sizes(words: pa.Array) -> pa.Array:
        return pa.array([words.nbytes] * len(words), pa.int64())

    rows = spark.range(0, 1500, 1, 1).select(F.repeat(F.lit("some words "), 1000).alias("text"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    encoded = lookup.encoded(rows, "text", "ids")
    assert encoded.agg(F.max(sizes(ws_tokens(F.col("text"))))).first()[0] < 6_000_000
    assert encoded.agg(F.sum(F.size("ids"))).first()[0] == 3_000_000
