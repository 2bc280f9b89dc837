"""The registered queries: small plans over the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lingweave.functions import arrays as A, clean as C
from lingweave.functions.tokens import pretokenize as pieces_of
from lingweave.functions.whitespace import collapsed_tokens, ws_tokens as tokens_of
from lingweave.operators import bpe, cleaning, dedupe, denoise, encode, groups, indexing, infer, joins, metrics, vocab
from lingweave.operators.embedding import with_embedding_prf
from lingweave.operators.tokenizers import build_tokenizer
from lingweave.plans import tables as T
from lingweave.session import scratch_path, spread, stored
from lingweave.sources import corpus, pairs as P, vocabularies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
VOCABULARY_QUERIES: dict[str, Query] = {}  # byte pairs of a whole vocabulary, ready or trained; too many merges for SQL

MERGES = 20
MORE_MERGES = 30
VOCABULARY_MERGES = 8000
MORE_VOCABULARY_MERGES = 9000
KEYS = ("text", "lang")
SPLITS = ("train", "validation", "test")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_query(fn: Callable[..., DataFrame]) -> Query:
    """Register a byte-pair query twice: with the few merges that SQL can follow, and as ``_vocabulary`` with a whole vocabulary."""

    def whole(spark: SparkSession, sf: str) -> DataFrame:
        return fn(spark, sf, True)

    whole.__name__, whole.__doc__ = f"{fn.__name__}_vocabulary", fn.__doc__
    VOCABULARY_QUERIES[whole.__name__] = whole
    return query(fn)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- corpus build -------------------------------------------------------------------


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Clean, deduplicate, remove leaks, count rows and tokens per split and source."""
    cleaned = cleaning.clean_columns(T.docs(spark, sf), ["text"])
    kept = dedupe.leak_free_splits(cleaned.withColumn("tokens", F.size(tokens_of(F.col("text")))), KEYS, ["doc_id"])
    return kept.groupBy("split", "source").agg(
        F.count("*").alias("rows"), F.sum(F.col("tokens").cast("long")).alias("tokens")
    )


QUERIES["corpus_summary"] = flagship


@query
def build_splits(spark, sf):
    kept = dedupe.leak_free_splits(T.docs(spark, sf), KEYS, ["doc_id"])
    return kept.groupBy("split", "source").agg(F.count("*").alias("rows"))


@query
def dedupe_pairs(spark, sf):
    return dedupe.keep_first(T.docs(spark, sf), KEYS, ["doc_id"]).select("doc_id")


@query
def leak_removal(spark, sf):
    docs = T.docs(spark, sf)
    return dedupe.remove_leaks(docs.where("split = 'train'"), docs.where("split <> 'train'"), KEYS).select("doc_id")


@query
def duplicate_profile(spark, sf):
    return dedupe.duplicate_profile(T.docs(spark, sf), KEYS, "lang")


# ---- sources and sinks --------------------------------------------------------------


def _pair_splits(spark, sf):
    """Pairs with a split per conversation group, so that all files together hold all pairs."""
    split = F.when(F.col("source") == "c0", "test").when(F.col("source") == "c1", "validation").otherwise("train")
    return T.pairs(spark, sf).withColumn("split", split)


def _write_by_split(df: DataFrame, path: str, write) -> dict[str, list[str]]:
    for split in SPLITS:
        write(df.where(F.col("split") == split), f"{path}/{split}")
    return {split: [f"{path}/{split}"] for split in SPLITS}


@query
def scan_tsv_pairs(spark, sf):
    """The cleaned pairs as TSV with a header and a third column, read back by split.

    Beside every good record stand one that is short, one with too many fields and one
    without its first text; all three go.
    """
    cleaned = cleaning.clean_columns(_pair_splits(spark, sf), ["hi_en", "en"])
    rows = cleaned.select(
        F.col("en").alias("en_query"), F.col("hi_en").alias("cs_query"), F.col("source").alias("domain"), "split", "row_id"
    )
    ragged = [[F.col("row_id")], [F.col("row_id")] * 5, [F.lit(""), F.col("row_id"), F.lit("x")]]

    def write(part: DataFrame, path: str) -> None:
        part.drop("split", "row_id").write.csv(
            path, sep="\t", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
        lines = F.explode(F.array(*[F.concat_ws("\t", *fields) for fields in ragged]))
        part.select(lines).write.mode("append").text(path)

    files = _write_by_split(rows, scratch_path(spark, "tsv"), write)
    read = P.load_splits(
        lambda paths: P.read_tsv_pairs(spark, paths, ["en_query", "cs_query", "domain"], "tsv"), files
    )
    return read.select("hi_en", "en", "source", "split")


@query
def scan_tsv_multiline(spark, sf):
    """Raw pairs with line breaks, tabs and quotes inside their texts, as TSV and back."""
    rows = _pair_splits(spark, sf).select(
        F.concat("en", F.lit('\n"'), "hi_en", F.lit('"\n\n\tend')).alias("en_query"), F.concat(F.lit("a\n"), "hi_en").alias("cs_query"), F.lit("x").alias("domain")
    )
    path = scratch_path(spark, "tsv")
    rows.write.csv(path, sep="\t", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = P.read_tsv_pairs(spark, [path], ["en_query", "cs_query", "domain"], "tsv", multiline=True)
    return read.select("hi_en", "en", "source")


@query
def scan_line_pairs(spark, sf):
    """The cleaned pairs as tab-separated lines, each beside a short line that goes, read back by split."""
    rows = cleaning.clean_columns(_pair_splits(spark, sf), ["hi_en", "en"])

    def write(part: DataFrame, path: str) -> None:
        part.select(F.explode(F.array(F.concat_ws("\t", "en", "hi_en"), F.col("row_id")))).write.text(path)

    files = _write_by_split(rows, scratch_path(spark, "lines"), write)
    return P.load_splits(lambda paths: P.read_line_pairs(spark, paths, "lines"), files).select(
        "hi_en", "en", "source", "split"
    )


@query
def extract_translation(spark, sf):
    """Two nested datasets with different keys: a struct and a map."""
    pairs = T.pairs(spark, sf)
    odd = F.col("source").isin("c1", "c3")
    struct = F.struct("en", "hi_en")
    mapped = F.create_map(F.lit("en"), "en", F.lit("hi_ng"), "hi_en")
    first = pairs.where(~odd).select("row_id", struct.alias("translation"))
    second = pairs.where(odd).select("row_id", mapped.alias("translation"))
    both = P.merge_sources(
        {
            "first": P.extract_translation(first, ("en", "hi_en"), "first"),
            "second": P.extract_translation(second, ("en", "hi_ng"), "second"),
        }
    )
    return both.select("row_id", "hi_en", "en", "source", "dataset_ord")


@query
def corpus_roundtrip(spark, sf):
    path = scratch_path(spark, "corpus")
    kept = dedupe.leak_free_splits(T.docs(spark, sf), KEYS, ["doc_id"])
    corpus.write_corpus(kept, path)
    back = corpus.read_corpus(spark, path, "doc_id long, text string, lang string, source string, split string")
    return back.select("doc_id", "text", "lang", "source", "split")


def reversed_words() -> infer.Translator:
    """A stand-in translator: the words in reverse order."""
    return lambda texts: [" ".join(reversed(t.split())) for t in texts]


@query
def translate_batch(spark, sf):
    return infer.translate(T.pairs(spark, sf), lambda: reversed_words(), "hi_en").select("row_id", "translations")


@query
def response_log(spark, sf):
    """Answers appended in two runs, then read back."""
    path = scratch_path(spark, "log")
    pairs = T.pairs(spark, sf)
    for run in (F.col("source") < "c2", F.col("source") >= "c2"):
        corpus.append_answers(pairs.where(run), path, "en")
    return corpus.read_answers(spark, path)


@query
def translate_resume(spark, sf):
    """A stopped translation goes on: logged answers stay, pending rows are translated, the
    predictions are attached, written as CSV and read back."""
    pairs = T.pairs(spark, sf)
    path = scratch_path(spark, "log")
    first = infer.translate(pairs.where("source < 'c2'"), lambda: reversed_words(), "hi_en")
    corpus.append_answers(first, path, "translations")
    answered = corpus.read_answers(spark, path)
    rest = infer.translate_pending(pairs, answered, lambda: reversed_words(), "hi_en")
    corpus.append_answers(rest, path, "translations")
    answers = corpus.read_answers(spark, path).select("row_id", F.col("line").alias("preds"))
    predictions = scratch_path(spark, "predictions")
    corpus.write_predictions(joins.attach_predictions(pairs.select("row_id", "hi_en"), answers), predictions)
    schema = "row_id string, hi_en string, preds string"
    back = spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(predictions)
    return infer.source_target(back, "hi_en", "preds")


@query
def translate_slices(spark, sf):
    """Answers in four slices, by a translator that fails on its first call in every task and is asked again."""

    def make() -> infer.Translator:
        failed = []

        def answer(texts: list[str]) -> list[str]:
            if not failed:
                failed.append(1)
                raise ConnectionError("try again")
            return [" ".join(reversed(t.split())) for t in texts]

        return answer

    patient = infer.patient_translator(make, wait=0.01)
    answers = infer.translate_slices(T.pairs(spark, sf), patient, "hi_en", scratch_path(spark, "slices"), 4)
    return answers.select("row_id", F.col("line").alias("translations"))


# ---- projections and cleaning -------------------------------------------------------


@query
def pair_view(spark, sf):
    """Both modes of the mode table over the pairs."""
    pairs = T.pairs(spark, sf)
    modes = {"translate": {"src": "hi_en", "tgt": "en"}, "denoise": {"src": "hi_en", "tgt": "hi_en"}}
    views = [P.mode_view(pairs, m, modes).withColumn("mode", F.lit(m)) for m in modes]
    return views[0].unionByName(views[1])


@query
def clean_rules(spark, sf):
    lengths = [F.length(rule(F.col("text"))).alias(name) for name, rule in C.clean_rules()]
    return T.messy(spark, sf).select("origin", "id", *lengths)


@query
def clean_rules_retain(spark, sf):
    cleaned = C.clean_text(F.col("text"), retain_hashtag_text=True)
    return T.messy(spark, sf).select("origin", "id", cleaned.alias("cleaned"))


@query
def clean_text_alpha(spark, sf):
    return T.messy(spark, sf).select("origin", "id", C.clean_text_alpha(F.col("text")).alias("cleaned"))


@query
def clean_corpus(spark, sf):
    return cleaning.clean_columns(T.messy(spark, sf), ["text"]).select("origin", "id", F.col("text").alias("cleaned"))


@query
def clean_report(spark, sf):
    return cleaning.clean_report(T.messy(spark, sf), "text", "source")


@query
def ws_tokens(spark, sf):
    return T.docs(spark, sf).select("doc_id", F.size(tokens_of(F.col("text"))).alias("n_tokens"))


# ---- filters and joins --------------------------------------------------------------


@query
def eval_by_source_filter(spark, sf):
    """Equality filter on the source is the operator here; it reaches the scan."""
    rows = T.evaluation(spark, sf).where("source = 'src16'")
    return _rounded(metrics.bleu(rows, "hyp", "ref", "source"), "score")


@query
def row_range(spark, sf):
    """Inclusive label slices that together cover the table."""
    indexed = indexing.row_index(T.pairs(spark, sf).select("row_id"), ["row_id"], name="label")
    sliced = indexing.label_ranges(indexed, [0, 100, 125, 500], "label")
    return sliced.groupBy("range_no").agg(
        F.count("*").alias("rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row")
    )


@query
def enrich_source(spark, sf):
    docs = T.docs(spark, sf)
    lookup = docs.select("text", F.col("source").alias("found"))
    return joins.enrich(docs.select("doc_id", "text"), lookup, "text", ["found"]).select("doc_id", "found", "copies")


@query
def attach_predictions(spark, sf):
    pairs = T.pairs(spark, sf)
    answers = pairs.select("row_id", F.array_join(F.reverse(tokens_of(F.col("hi_en"))), " ").alias("preds"))
    return joins.attach_predictions(pairs.select("row_id", "en"), answers)


@query
def pending_rows(spark, sf):
    answered = T.read(spark, sf, "labels").select(F.col("doc_id"))
    return joins.pending_rows(T.docs(spark, sf).select("doc_id"), answered, "doc_id")


# ---- counts, indexes, batches -------------------------------------------------------


@query
def token_totals(spark, sf):
    docs = T.docs(spark, sf).select("split", "text", C.clean_text(F.col("text")).alias("cleaned"))
    return vocab.token_totals(docs, "split", ["text", "cleaned"])


@query
def split_stats(spark, sf):
    return indexing.split_stats(T.docs(spark, sf))


@query
def word_freq(spark, sf):
    return vocab.word_freq(T.docs(spark, sf), tokens_of(F.col("text")))


@query
def char_vocab(spark, sf):
    return vocab.char_vocab(T.docs(spark, sf), F.col("text"))


@query
def row_index(spark, sf):
    """Index of the rows sorted by text, as after a key-sorted merge."""
    rows = T.docs(spark, sf).select("doc_id", "split", "text")
    return indexing.row_index(rows, ["text", "doc_id"], ["split"], keep=["doc_id", "split"])


def _doc_batches(spark, sf) -> DataFrame:
    return indexing.with_batches(
        indexing.row_index(T.docs(spark, sf).select("doc_id", "split"), ["doc_id"], ["split"])
    )


@query
def batch_assign(spark, sf):
    return _doc_batches(spark, sf)


@query
def shuffle_batches(spark, sf):
    order = indexing.loader_order("split", "doc_id", T.SEED)
    return indexing.with_batches(indexing.row_index(T.docs(spark, sf).select("doc_id", "split"), order, ["split"]))


@query
def overfit_subset(spark, sf):
    """The first batch of every split: the limit is the operator."""
    return indexing.first_rows(_doc_batches(spark, sf)).select("doc_id", "split", "row_index")


@query
def group_apply(spark, sf):
    rows = T.docs(spark, sf).select("source", F.length("text").alias("chars"))
    return groups.apply_by_group(
        rows,
        ["source"],
        lambda pdf: {"rows": len(pdf), "chars": int(pdf["chars"].sum())},
        {"rows": "long", "chars": "long"},
        {"rows": F.col("rows"), "mean_len": F.round(F.col("chars") / F.col("rows"), 6)},
    )


def _stretch_start() -> dict:
    return {"rows": 0, "changes": 0, "best": 0}


def _stretch_step(state: dict, rows) -> dict:
    """Add rows to the numbers of a stretch: changes of role and the longest run of growing lengths."""
    role, size = rows["role"].to_numpy(), rows["chars"].to_numpy()
    breaks = [i for i, grows in enumerate(size[1:] > size[:-1], 1) if not grows]
    runs = [e - s for s, e in zip([0, *breaks], [*breaks, len(size)])]
    ends = {"first": (role[0], int(size[0])), "last": (role[-1], int(size[-1]))}
    own = {"rows": len(size), "changes": int((role[1:] != role[:-1]).sum()), "best": max(runs), "head": runs[0], "tail": runs[-1]}
    return _stretch_join(state, own | ends)


def _stretch_join(a: dict, b: dict) -> dict:
    if not a["rows"]:
        return b
    grows = b["first"][1] > a["last"][1]
    return {
        "rows": a["rows"] + b["rows"],
        "changes": a["changes"] + b["changes"] + (a["last"][0] != b["first"][0]),
        "best": max(a["best"], b["best"], a["tail"] + b["head"] if grows else 0),
        # runs at the borders, which a neighbour may continue
        "head": a["head"] + (b["head"] if grows and a["head"] == a["rows"] else 0),
        "tail": b["tail"] + (a["tail"] if grows and b["tail"] == b["rows"] else 0),
        "first": a["first"],
        "last": b["last"],
    }


@query
def group_fold_ordered(spark, sf):
    """Per conversation, turns in order: changes of speaker, and the longest run of texts that get longer."""
    size = F.coalesce(F.length("text"), F.lit(0)).alias("chars")
    rows = spread(T.read(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", size)
    fold = groups.Fold(_stretch_start, _stretch_step, _stretch_join, lambda s: {"rows": s["rows"], "changes": s["changes"], "longest": s["best"]})
    return groups.fold_by_group(rows, ["conv_id"], ["turn", "role", "chars"], fold, {"rows": "long", "changes": "long", "longest": "long"})


@query
def collate_apply(spark, sf):
    """A collate function of the caller's over every batch of encoded pairs: padded ids and their length."""
    pairs, lookup = _encoded_pairs(spark, sf)
    rows = encode.encode_text(pairs, "hi_en", lookup, mask=None, padded=False).select("row_id", "input_ids")
    batched = rows.join(_batch_ids(pairs, "row_id"), "row_id")

    def collate(batch):
        width = max(map(len, batch["input_ids"]))
        padded = [[*ids, *[A.PAD] * (width - len(ids))] for ids in batch["input_ids"]]
        return batch.assign(place=range(len(batch)), width=width, input_ids=[" ".join(map(str, p)) for p in padded])

    return groups.apply_by_batch(batched, "batch_id", ["row_id"], collate, "row_id string, batch_id long, place int, width int, input_ids string")


# ---- vocabularies and BPE -----------------------------------------------------------


@query
def pretokenize(spark, sf):
    pieces = T.docs(spark, sf).select("doc_id", pieces_of(F.col("text")).alias("p"))
    return pieces.select("doc_id", F.size("p").alias("n_pieces"), F.md5(F.array_join("p", "\x01")).alias("pieces"))


def _chars(spark, sf) -> DataFrame:
    """Words with one symbol per character."""
    return vocab.word_freq(T.docs(spark, sf), tokens_of(F.col("text"))).withColumnRenamed("word", "symbols")


@query
def bpe_pair_freqs(spark, sf):
    pair = F.col("pair")
    return bpe.pair_freqs(_chars(spark, sf)).select(
        F.substring(pair, 1, 1).alias("left"), F.substring(pair, 2, 1).alias("right"), "freq"
    )


@query
def bpe_merge_step(spark, sf):
    """Every word after the best character pair is merged once."""
    words = stored(_chars(spark, sf), "words")
    best, _ = bpe.best_pairs(bpe.pair_freqs(words), 1)[0]
    merged = ""
    after = F.split(F.replace(F.col("symbols"), F.lit(best), F.lit(merged)), "")
    shown = F.replace(F.array_join(F.array_remove(after, ""), " "), F.lit(merged), F.lit(best))
    return words.select(F.col("symbols").alias("word"), shown.alias("merged"))


def _train_text(spark, sf) -> DataFrame:
    return T.docs(spark, sf).select("doc_id", "text")


@vocabulary_query
def bpe_train(spark, sf, whole=False):
    """Merges learnt from the documents, stored as a table and loaded again."""
    path = scratch_path(spark, "merges")
    learnt = bpe.train(bpe.piece_freq(_train_text(spark, sf), F.col("text")), VOCABULARY_MERGES if whole else MERGES)
    bpe.save_merges(learnt, spark, path)
    return bpe.merge_table(bpe.load_merges(spark, path), spark)


@vocabulary_query
def bpe_incremental(spark, sf, whole=False):
    """Training goes on from its stored state with the conversations added; earlier merges stay."""
    training = bpe.Training.start(bpe.piece_freq(_train_text(spark, sf), F.col("text")), scratch_path(spark, "training"))
    training.learn(VOCABULARY_MERGES if whole else MERGES)
    training.add(bpe.piece_freq(T.read(spark, sf, "conversations"), F.col("text")))
    return bpe.merge_table(training.learn(MORE_VOCABULARY_MERGES if whole else MORE_MERGES), spark)


def _bpe(spark, sf, whole) -> bpe.BpeTokenizer:
    """A tokenizer: the ready vocabulary, or a few merges learnt from the documents."""
    if whole:
        return build_tokenizer(spark, base=vocabularies.read_ranks(spark, T.VOCABULARY_FILE))
    return build_tokenizer(spark, "SCRATCH", words=bpe.piece_freq(_train_text(spark, sf), F.col("text")), merges=MERGES)


@vocabulary_query
def bpe_tokenize(spark, sf, whole=False):
    tokenizer = _bpe(spark, sf, whole)
    return _train_text(spark, sf).select("doc_id", tokenizer.count(F.col("text")).alias("n_tokens"))


@vocabulary_query
def bpe_encode_pairs(spark, sf, whole=False):
    """Pairs as byte-pair ids of fixed length."""
    tokenizer = _bpe(spark, sf, whole)
    rows = encode.encode_pairs(T.pairs(spark, sf), "hi_en", "en", tokenizer, tokenizer)
    return rows.select("row_id", *_shown(rows, "input_ids", "attention_mask", "labels"))


@vocabulary_query
def bpe_decode(spark, sf, whole=False):
    """Whole documents to ids and back."""
    tokenizer = _bpe(spark, sf, whole)
    ids = tokenizer.encoded(_train_text(spark, sf), "text", "ids")
    return encode.decode_ids(ids, "ids", tokenizer).select("doc_id", "text")


@vocabulary_query
def bpe_token_totals(spark, sf, whole=False):
    """Tokens per split, by the tokenizer."""
    docs = T.docs(spark, sf).select("split", "text")
    return vocab.token_totals(docs, "split", ["text"], _bpe(spark, sf, whole).count)


@vocabulary_query
def bpe_denoise(spark, sf, whole=False):
    """Masked windows of byte-pair ids over all documents."""
    rows, noise = _noise_windows(T.docs(spark, sf).select("doc_id", "text"), _bpe(spark, sf, whole))
    return _noise_output(denoise.mask_tokens(rows, "input_ids", "window", "batch_id", noise))


@vocabulary_query
def bpe_vocab_styles(spark, sf, whole=False):
    """The three vocabulary styles: base, trained and stored, base plus trained. The base is the ready vocabulary, or the commonest words."""
    path = scratch_path(spark, "vocab")
    words = bpe.piece_freq(_train_text(spark, sf), F.col("text"))
    scratch = build_tokenizer(spark, "SCRATCH", words=words, merges=VOCABULARY_MERGES if whole else MERGES)
    bpe.save_vocabulary(scratch.vocabulary(), path)
    base = _bpe(spark, sf, whole).vocabulary() if whole else stored(word_vocab(spark, sf), "vocab")
    trained = bpe.load_vocabulary(spark, path)
    styles = [vocab.style_vocab(s, base, trained).withColumn("style", F.lit(s)) for s in ("DEFAULT", "SCRATCH", "APPEND")]
    return styles[0].unionByName(styles[1]).unionByName(styles[2])


def bpe_append_vocabulary(spark, sf):
    """Documents by the ready vocabulary with the tokens added that training on the conversations found beyond it."""
    words = bpe.piece_freq(T.read(spark, sf, "conversations"), F.col("text"))
    ready = vocabularies.read_ranks(spark, T.VOCABULARY_FILE)
    tokenizer = build_tokenizer(spark, "APPEND", ready, words, VOCABULARY_MERGES, path=scratch_path(spark, "merges"))
    ids = tokenizer.encoded(_train_text(spark, sf), "text", "ids")
    added = F.size(F.filter("ids", lambda i: i > tokenizer.mask_id))
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), added.alias("n_added"), F.md5(F.array_join("ids", ",")).alias("ids"))


VOCABULARY_QUERIES["bpe_append_vocabulary"] = bpe_append_vocabulary


def word_vocab(spark, sf) -> DataFrame:
    """Commonest words of the cleaned training text, between the specials and the mask."""
    train = T.docs(spark, sf).where("split = 'train'").select(C.clean_text(F.col("text")).alias("text"))
    return vocab.ranked_vocab(vocab.word_freq(train, tokens_of(F.col("text"))), T.VOCAB_SIZE)


@query
def vocab_append(spark, sf):
    """The word vocabulary plus every word of the conversations it lacks."""
    turns = T.read(spark, sf, "conversations").select(tokens_of(F.col("text")).alias("t"))
    words = vocab.word_freq(turns, F.col("t")).select(F.col("word").alias("token"))
    return vocab.append_tokens(word_vocab(spark, sf), words)


# ---- encoding -----------------------------------------------------------------------


def _encoded_pairs(spark, sf):
    lookup = vocab.TokenLookup(word_vocab(spark, sf))
    pairs = cleaning.clean_columns(T.pairs(spark, sf), ["hi_en", "en"])
    return pairs, lookup


def _batch_ids(df: DataFrame, row: str, *per: str) -> DataFrame:
    """Batch of every row. Ids alone are ranged, since ranging samples its input first
    and would compute encoded rows or row scores twice."""
    return indexing.with_batches(indexing.row_index(df.select(row, *per), [row], per)).drop("row_index")


def _shown(df: DataFrame, *arrays: str) -> list:
    return [A.joined(F.col(a)).alias(a) for a in arrays]


@query
def encode_pairs(spark, sf):
    pairs, lookup = _encoded_pairs(spark, sf)
    rows = encode.encode_pairs(pairs, "hi_en", "en", lookup, lookup)
    return rows.select("row_id", *_shown(rows, "input_ids", "attention_mask", "labels"))


@query
def encode_batch(spark, sf):
    pairs, lookup = _encoded_pairs(spark, sf)
    rows = encode.encode_batch(pairs, "hi_en", "en", lookup, lookup)
    shown = _shown(rows, "src_tokenized", "src_attention_mask", "tgt_tokenized", "tgt_attention_mask")
    return rows.select("row_id", "hi_en", "en", *shown)


@query
def decode_ids(spark, sf):
    pairs, lookup = _encoded_pairs(spark, sf)
    rows = encode.encode_pairs(pairs, "hi_en", "en", lookup, lookup)
    return encode.decode_ids(rows, "labels", lookup).select("row_id", "text")


@query
def special_mask(spark, sf):
    pairs, lookup = _encoded_pairs(spark, sf)
    rows = encode.encode_text(pairs, "hi_en", lookup)
    mask = A.special_mask(F.col("input_ids"), lookup.special_ids())
    return rows.select(
        "row_id", A.joined(mask).alias("special"), A.joined(A.pad_positions(F.col("input_ids"))).alias("pads")
    )


@query
def pad_batch(spark, sf):
    pairs, lookup = _encoded_pairs(spark, sf)
    rows = encode.encode_text(pairs, "hi_en", lookup, mask=None, padded=False).select("row_id", "input_ids")
    padded = encode.pad_batch(rows.join(_batch_ids(pairs, "row_id"), "row_id"), "input_ids")
    return padded.select("row_id", "batch_id", *_shown(padded, "input_ids", "attention_mask"))


@query
def argmax_decode(spark, sf):
    """Every vector read as four steps of logits over sixteen ids."""
    steps = A.steps(F.col("embedding"), 16)
    return T.vectors(spark, sf).select("vec_id", A.joined(A.argmax_decode(steps)).alias("token_ids"))


# ---- denoising ----------------------------------------------------------------------


def _noise_input(spark, sf) -> tuple[DataFrame, denoise.Noise]:
    """Whole documents as windows of ids, in batches of consecutive windows, and the noise settings.

    The cleaned texts are stored, since both the vocabulary and the ids are made of them.
    """
    cleaned = stored(T.docs(spark, sf).select("doc_id", "split", C.clean_text(F.col("text")).alias("text")), "cleaned")
    words = vocab.word_freq(cleaned.where("split = 'train'"), collapsed_tokens(F.col("text")))
    lookup = vocab.TokenLookup(vocab.ranked_vocab(words, T.VOCAB_SIZE), words=collapsed_tokens)
    return _noise_windows(cleaned.select("doc_id", "text"), lookup)


def _noise_windows(docs, tokenizer) -> tuple[DataFrame, denoise.Noise]:
    """Windows with their batch, numbered by ``doc_id`` and ``part``.

    Places are counted per document, so no window is sorted or joined. Windows of equal ``doc_id``
    and ``part`` share their places, each with every one; without ``doc_id`` none is returned.
    """
    ids = tokenizer.encoded(docs, "text", "ids").drop("text")
    ids = stored(ids.withColumn("_parts", encode.window_count(F.col("ids"))), "ids")
    keys = ids.groupBy("doc_id").agg(F.collect_list("_parts").alias("_copies"), F.sum("_parts").alias("_n"))
    starts = indexing.run_starts(keys, "doc_id", "_n", "_start").drop("_n")
    rows = encode.cut_windows(ids.drop("_parts").join(starts, "doc_id"), "ids")
    part = F.col("part")
    first = F.col("_start") + F.aggregate("_copies", F.lit(0).cast("long"), lambda n, parts: n + F.least(parts, part))
    equal = F.size(F.filter("_copies", lambda parts: parts > part))
    places = F.when(F.size("_copies") == 1, F.array(F.col("_start") + part)).otherwise(F.sequence(first, first + equal - 1))
    rows = indexing.with_batches(rows.select("doc_id", "part", "input_ids", F.explode(places).alias("row_index"))).drop("row_index")
    rows = rows.withColumn("window", F.concat_ws(":", "doc_id", "part"))
    return rows, denoise.Noise(tokenizer.special_ids(), tokenizer.id_of(A.MASK_TOKEN), T.SEED)


def _noise_output(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("doc_id", "part", "batch_id", *extra, *_shown(df, "input_ids", "denoised", "mask", "mask_labels"))


@query
def denoise_mlm(spark, sf):
    rows, noise = _noise_input(spark, sf)
    return _noise_output(denoise.mask_tokens(rows, "input_ids", "window", "batch_id", noise))


@query
def group_mask(spark, sf):
    rows, noise = _noise_input(spark, sf)
    masked = denoise.group_mask(rows, "input_ids", "window", noise)
    return masked.select("doc_id", "part", "batch_id", *_shown(masked, "input_ids", "mask"))


@query
def denoise_plm(spark, sf):
    rows, noise = _noise_input(spark, sf)
    return _noise_output(denoise.permute_tokens(rows, "input_ids", "window", noise))


@query
def denoise_mixed(spark, sf):
    rows, noise = _noise_input(spark, sf)
    return _noise_output(denoise.denoise_mixed(rows, "input_ids", "window", "batch_id", noise), "task")


@query
def denoise_off(spark, sf):
    rows, noise = _noise_input(spark, sf)
    return _noise_output(denoise.mask_tokens(rows, "input_ids", "window", "batch_id", noise, enabled=False))


# ---- evaluation ---------------------------------------------------------------------


@query
def bleu_by_source(spark, sf):
    return _rounded(metrics.bleu(T.evaluation(spark, sf), "hyp", "ref", "source"), "score")


@query
def bleu_plain(spark, sf):
    return _rounded(metrics.plain_bleu(T.evaluation(spark, sf), "hyp", "ref", "source"), "score")


@query
def chrf_by_source(spark, sf):
    return _rounded(metrics.chrf(T.evaluation(spark, sf), "hyp", "ref", "source"), "score")


@query
def bleu_batch_mean(spark, sf):
    rows = T.evaluation(spark, sf)
    stats = metrics.with_bleu_stats(rows, "hyp", "ref").drop("hyp", "ref")
    batched = stats.join(_batch_ids(rows, "doc_id", "source"), ["doc_id", "source"])
    return _rounded(metrics.batch_mean_bleu(batched, ["batch_id"], "source"), "score")


def _with_vector_ids(df: DataFrame, vectors: DataFrame) -> DataFrame:
    count = vectors.count()
    texts = [c for c in ("hyp", "ref", "generated") if c in df.columns]
    return df.withColumns({f"{c}_ids": T.vector_ids(tokens_of(F.col(c)), count) for c in texts})


@query
def embedding_score(spark, sf):
    vectors = T.vectors(spark, sf)
    rows = _with_vector_ids(T.evaluation(spark, sf), vectors)
    scored = with_embedding_prf(rows, "hyp_ids", "ref_ids", vectors)
    return scored.groupBy("source").agg(*[F.round(F.avg(c), 6).alias(c) for c in metrics.PRF])


@query
def metrics_report(spark, sf):
    """Two hypotheses: BLEU and chrF of the letters-only text, embedding match of the raw one."""
    vectors = T.vectors(spark, sf)
    rows = _with_vector_ids(T.systems(spark, sf).select("source", "ref", F.col("letters").alias("hyp"), F.col("raw").alias("generated")), vectors)
    scores = metrics.report(rows, "hyp", "generated", "ref", "generated_ids", "ref_ids", vectors)
    return _rounded(scores, "bleu", "chrf", *metrics.PRF)


@query
def system_compare(spark, sf):
    return _rounded(metrics.compare_systems(T.systems(spark, sf), ["letters", "raw"], "ref"), "bleu", "chrf")
