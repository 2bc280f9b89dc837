"""Ready vocabularies, styles and stored training against the tokenizers library."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lingweave.functions.tokens import byte_characters
from lingweave.operators import bpe, encode, vocab
from lingweave.operators.tokenizers import AppendedTokenizer, build_tokenizer
from lingweave.plans import tables as T
from lingweave.sources import vocabularies as V

JSON = "/opt/tokenizers/byte_bpe_50k.json"
TEXTS = ["plain words", "", None, "naïve Ġnam 👅 ok\n\n end ", "abcabc abcd abcde xabc", "a1abcd \U0010ffff a1 bca1", "don't  stop"]


@pytest.fixture(scope="module")
def ready(spark):
    return V.read_ranks(spark, T.VOCABULARY_FILE)


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    return tok


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def test_three_formats_are_one_vocabulary(spark, ready, tmp_path):
    assert len(ready) == 50_000
    assert V.read_tokenizer(spark, f"file://{JSON}") == ready
    some = ready[:700]
    for write, read in ((V.write_ranks, V.read_ranks), (V.write_merge_list, V.read_merge_list)):
        write(some, spark, str(tmp_path / write.__name__))
        (part,) = (tmp_path / write.__name__).glob("part-*")
        assert read(spark, str(part)) == some


def test_files_that_are_no_byte_vocabulary(spark, tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        V.read_tokenizer(spark, "/opt/tokenizers/word_bpe_49k.json")
    with pytest.raises(ValueError, match="256 bytes"):
        bpe.merges_of_tokens([b"a", b"b"])
    letters = [bytes([b]) for b in range(256)]
    with pytest.raises(ValueError, match="no merge"):
        bpe.merges_of_tokens([*letters, b"abc"])
    (tmp_path / "twice").write_text("a b\nb c\na bc\nab c\n")
    with pytest.raises(ValueError, match="two merges"):
        V.read_merge_list(spark, str(tmp_path / "twice"))


def test_ready_vocabulary_equals_the_library(spark, ready, library):
    """Every document of the tables of the correctness run."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    tokenizer = bpe.BpeTokenizer(ready, spark)
    rows = tokenizer.encoded(docs.repartition(8), "text", "ids")
    rows = encode.decode_ids(rows, "ids", tokenizer, "back").collect()
    expected = library.encode_batch([r.text for r in rows], add_special_tokens=False)
    assert all([i - bpe.FIRST_BYTE for i in r.ids] == e.ids and r.back == r.text for r, e in zip(rows, expected))


def test_appended_tokens_equal_the_library(spark, ready):
    added = ["abc", "abcd", "Ġnam", "👅 ok", "bca", "\n\n", "words"]
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    lacking = [t for t in added if library.token_to_id(t) is None]
    library.add_tokens(lacking)
    first = library.token_to_id(lacking[0])
    tokenizer = AppendedTokenizer(ready, added, spark)
    assert tokenizer.added == lacking and "words" not in lacking
    rows = tokenizer.encoded(frame(spark), "text", "ids").withColumn("n", tokenizer.count(F.col("text")))
    rows = tokenizer.decoded(rows, "ids", "back").collect()
    place = lambda i: i - tokenizer.mask_id - 1 + first if i > tokenizer.mask_id else i - bpe.FIRST_BYTE
    for r in rows:
        assert [place(i) for i in r.ids] == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n == len(r.ids) and r.back == (r.text or "")
    table = {r.token: r.id for r in tokenizer.vocabulary().collect()}
    assert [table[t] for t in lacking] == [tokenizer.mask_id + 1 + i for i in range(len(lacking))]


def test_styles(spark, ready, tmp_path):
    words = bpe.piece_freq(frame(spark, ["zqzq zqzq zqzqx", "zqzq"]), F.col("text"))
    assert build_tokenizer(spark, base=ready).merges == ready
    path = str(tmp_path / "merges")
    scratch = build_tokenizer(spark, "SCRATCH", words=words, merges=3, path=path)
    assert scratch.merges == bpe.train(words, 3)
    # what is stored is loaded, also without words
    assert build_tokenizer(spark, "SCRATCH", merges=50, path=path).merges == scratch.merges
    both = build_tokenizer(spark, "APPEND", ready, path=path)
    assert both.merges == ready and both.added == [t for t in bpe.token_texts(scratch.merges) if t not in set(bpe.token_texts(ready))] != []
    with pytest.raises(ValueError, match="needs words"):
        build_tokenizer(spark, "APPEND", ready, path=str(tmp_path / "none"))
    with pytest.raises(ValueError, match="unknown style"):
        build_tokenizer(spark, "OTHER")
    # nothing is kept without a path
    assert build_tokenizer(spark, "SCRATCH", words=words, merges=2).merges == scratch.merges[:2]


def test_training_goes_on_from_its_state(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(4)
    old, new = (bpe.piece_freq(docs.where(F.col("doc_id") % 2 == k), F.col("text")) for k in (0, 1))
    training = bpe.Training.start(old, str(tmp_path / "training"))
    first = training.learn(300)
    assert first == bpe.train(old, 300) and training.version() == 1
    training.add(new)
    again = bpe.Training(spark, str(tmp_path / "training"))
    assert again.merges() == first
    more = again.learn(500)
    assert more == bpe.train(vocab.add_freqs(old, new), 500, known=first) and len(more) == 500
    # a version without merges does not count
    again.words().write.parquet(str(tmp_path / "training" / "version-000009" / "words"))
    assert again.version() == 3 and again.merges() == more


@pytest.mark.parametrize("leading, symbols", [(1, 10_000), (4, 40), (1 << 16, 1_000_000), (7, 300)])
def test_rounds_of_any_size_learn_the_same(spark, monkeypatch, leading, symbols):
    """One pair at a time, runs that do not fit, and everything at once."""
    texts = ["abab abab cdcd aaaa aaaaa aaa", "ababcd cdab zz zzzz aaaaaaaaab", "low lower lowest newer wider", "–––– …… 中中中"]
    words = bpe.piece_freq(frame(spark, texts), F.col("text"))
    counts = {tuple(r.word.encode()): r.freq for r in words.collect()}
    monkeypatch.setattr(bpe, "LEADING_PAIRS", leading)
    monkeypatch.setattr(bpe, "SEGMENT_SYMBOLS", symbols)
    for least in (1, 2, 3):
        learnt = bpe.train(words, 60, least)
        assert [(m.left, m.right) for m in learnt] == one_by_one(counts, 60, least)


def one_by_one(counts, most, least):
    alphabet = bpe.byte_alphabet(bpe.FIRST_BYTE)
    ids = [alphabet[ch] for ch in bpe.byte_characters()]
    rows = {tuple(ids[b] for b in w): f for w, f in counts.items()}
    found = []
    while len(found) < most:
        pairs = {}
        for row, f in rows.items():
            for p in zip(row, row[1:]):
                pairs[p] = pairs.get(p, 0) + f
        best = min(((-f, p) for p, f in pairs.items() if f >= least), default=None)
        if best is None:
            break
        found.append(best[1])
        rows = {tuple(bpe._merge_once(r, best[1], bpe.FIRST_MERGE + len(found) - 1)): f for r, f in rows.items()}
    return found


def test_ids_and_texts_pass_in_batches_of_some_megabytes(spark, ready):
    """40 MB of ids in one partition never stand in a task at once; null rows, unknown ids and cut characters as before."""
    sizes = F.arrow_udf(_batch_bytes, "long")
    tokenizer = build_tokenizer(spark, base=ready)
    text = F.concat(F.lit("naïve ok "), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" né ")), 1000))
    rows = tokenizer.encoded(spark.range(0, 2000, 1, 1).select("id", text.alias("text")), "text", "ids")
    assert rows.agg(F.max(sizes("ids"))).first()[0] < 10_000_000
    back = encode.decode_ids(rows, "ids", tokenizer)
    assert back.where(F.col("text") != text).count() == 0
    odd = [(0, [4, 3, 60_000, -7, 4 + ready[0].rank]), (1, None), (2, []), (3, [ready[0].left, 194, 4])]
    got = tokenizer.decoded(spark.createDataFrame(odd, "i int, ids array<int>").coalesce(1), "ids", "text").orderBy("i").collect()
    texts = [bytes([b]) for b in range(256)]
    order = sorted(range(256), key=lambda b: byte_characters()[b])
    one = lambda ids: b"".join(texts[order[i - 4]] for i in ids if 4 <= i < 260).decode("utf-8", "replace")
    assert [r.text for r in got] == [None if ids is None else one(ids) for _, ids in odd]


def _batch_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([batch.nbytes] * len(batch), pa.int64())
