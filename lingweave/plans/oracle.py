"""The registered queries as DuckDB SQL, written from the definitions.

Only constants are shared with the Spark side. Rules are spelt differently where
possible (windows instead of joins, n-gram joins instead of array kernels), so an
error on one side shows.
"""

from __future__ import annotations

from lingweave.functions.clean import EMOJI_RANGES
from lingweave.functions.tokens import byte_alphabet, byte_characters
from lingweave.functions.whitespace import WS
from lingweave.plans.queries import MERGES, MORE_MERGES
from lingweave.plans.tables import SEED, VOCAB_SIZE
from lingweave.sources.pairs import NA_TEXTS

ORACLE: dict[str, str] = {}

# ---- scalar expressions --------------------------------------------------------------


def _re(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def strip(x: str) -> str:
    return _re(_re(x, f"^[{WS}]+"), f"[{WS}]+$")


def urls(x: str) -> str:
    return _re(x, f"http[^{WS}]+")


def usernames(x: str) -> str:
    return strip(f"replace({x}, '<user>', '')")


def rt(x: str) -> str:
    return strip(f"replace({x}, 'RT :', '')")


def tags(x: str, retain: bool = False) -> str:
    return f"replace({x}, '#', '')" if retain else _re(_re(x, f"#[^{WS}]+"), f"@[^{WS}]+")


def emojis(x: str) -> str:
    return _re(x, "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI_RANGES) + "]+")


def punctuation(x: str) -> str:
    return _re(_re(_re(x, "!+", "!"), r"\.+", "."), r"\?+", "?")


def lowercase(x: str) -> str:
    return f"lower({x})"


def spaces(x: str) -> str:
    return _re(strip(x), f"[{WS}]+", " ")


RULES = {
    "urls": urls,
    "usernames": usernames,
    "rt": rt,
    "tags": tags,
    "emojis": emojis,
    "punctuation": punctuation,
    "lowercase": lowercase,
    "spaces": spaces,
}


def clean(x: str, retain: bool = False) -> str:
    x = tags(rt(usernames(urls(x))), retain)
    return spaces(lowercase(punctuation(emojis(x))))


def clean_alpha(x: str) -> str:
    x = _re(tags(rt(usernames(urls(x)))), f"[^a-zA-Z{WS}]")
    return spaces(lowercase(punctuation(x)))


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda t: t <> '')"


def u(tag: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{SEED}|{tag}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def show(x: str) -> str:
    return f"array_to_string({x}, ' ')"


# ---- common tables -------------------------------------------------------------------

DOCS = """docs AS (
  SELECT doc_id, text, lang, source,
         CASE WHEN CAST(substr(source, 4) AS INT) < 16 THEN 'train'
              WHEN CAST(substr(source, 4) AS INT) < 18 THEN 'validation' ELSE 'test' END AS split
  FROM documents)"""

PAIRS = """pairs AS (
  SELECT row_id, hi_en, en, source FROM (
    SELECT conv_id || '-' || turn AS row_id, text AS hi_en, role, 'c' || (conv_id % 4) AS source,
           lead(text) OVER w AS en, lead(role) OVER w AS next_role
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

PAIR_SPLITS = """pair_splits AS (
  SELECT *, CASE source WHEN 'c0' THEN 'test' WHEN 'c1' THEN 'validation' ELSE 'train' END AS split FROM pairs)"""

MESSY = """messy AS (
  SELECT 'doc' AS origin, doc_id AS id, source,
         '<user> RT : ' || text || ' #' || lang || ' @' || source || ' ' || chr(128069) || '  ok!!' AS text
  FROM documents
  UNION ALL
  SELECT 'page', page_id, 'pages', url || ' ' || html FROM pages)"""

KEPT = """kept AS (
  SELECT doc_id, text, lang, source, split FROM (
    SELECT *, row_number() OVER (PARTITION BY split, text, lang ORDER BY doc_id) AS copy FROM docs)
  WHERE copy = 1),
clean_train AS (
  SELECT * FROM kept t WHERE split = 'train' AND NOT EXISTS (
    SELECT 1 FROM kept o WHERE o.split <> 'train'
    AND o.text IS NOT DISTINCT FROM t.text AND o.lang IS NOT DISTINCT FROM t.lang)),
clean_test AS (
  SELECT * FROM kept t WHERE split = 'test' AND NOT EXISTS (
    SELECT 1 FROM kept o WHERE o.split = 'validation'
    AND o.text IS NOT DISTINCT FROM t.text AND o.lang IS NOT DISTINCT FROM t.lang)),
final AS (
  SELECT * FROM clean_train UNION ALL SELECT * FROM clean_test
  UNION ALL SELECT * FROM kept WHERE split = 'validation')"""

EVAL = f"ev AS (SELECT doc_id, source, {clean('text')} AS ref, {clean_alpha('text')} AS hyp FROM documents)"

# ---- corpus build --------------------------------------------------------------------

ORACLE["corpus_summary"] = f"""
WITH {DOCS.replace('doc_id, text,', f"doc_id, {clean('text')} AS text,")},
{KEPT}
SELECT split, source, count(*) AS rows, CAST(sum(len({toks('text')})) AS BIGINT) AS tokens
FROM final GROUP BY split, source"""

ORACLE["build_splits"] = f"WITH {DOCS}, {KEPT} SELECT split, source, count(*) AS rows FROM final GROUP BY split, source"

ORACLE["dedupe_pairs"] = "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang"

ORACLE["leak_removal"] = f"""
WITH {DOCS}
SELECT doc_id FROM docs t WHERE split = 'train' AND NOT EXISTS (
  SELECT 1 FROM docs o WHERE o.split <> 'train'
  AND o.text IS NOT DISTINCT FROM t.text AND o.lang IS NOT DISTINCT FROM t.lang)"""

ORACLE["duplicate_profile"] = """
SELECT lang, count(*) AS keys, count(*) FILTER (n > 1) AS dup_keys, max(n) AS max_copies
FROM (SELECT lang, text, count(*) AS n FROM documents GROUP BY lang, text) GROUP BY lang"""

# ---- sources and sinks ---------------------------------------------------------------

MISSING = ", ".join(f"'{t}'" for t in NA_TEXTS)
ORACLE["scan_tsv_pairs"] = f"""
WITH {PAIRS}, {PAIR_SPLITS},
cleaned AS (SELECT {clean('hi_en')} AS hi_en, {clean('en')} AS en, split FROM pair_splits)
SELECT hi_en, en, 'tsv' AS source, split FROM cleaned WHERE hi_en NOT IN ({MISSING}) AND en NOT IN ({MISSING})"""

ORACLE["scan_tsv_multiline"] = f"""
WITH {PAIRS}
SELECT 'a' || chr(10) || hi_en AS hi_en, en || chr(10) || '"' || hi_en || '"' || chr(10) || chr(10) || chr(9) || 'end' AS en, 'tsv' AS source
FROM pairs WHERE hi_en IS NOT NULL AND en IS NOT NULL"""

ORACLE["scan_line_pairs"] = f"""
WITH {PAIRS}, {PAIR_SPLITS}
SELECT {clean('hi_en')} AS hi_en, {clean('en')} AS en, 'lines' AS source, split FROM pair_splits"""

ORACLE["extract_translation"] = f"""
WITH {PAIRS}
SELECT row_id, hi_en, en, CASE WHEN source IN ('c1', 'c3') THEN 'second' ELSE 'first' END AS source,
       CASE WHEN source IN ('c1', 'c3') THEN 1 ELSE 0 END AS dataset_ord FROM pairs"""

ORACLE["corpus_roundtrip"] = f"WITH {DOCS}, {KEPT} SELECT doc_id, text, lang, source, split FROM final"

REVERSED = show(f"list_reverse({toks('hi_en')})")
ORACLE["translate_batch"] = f"WITH {PAIRS} SELECT row_id, {REVERSED} AS translations FROM pairs"
ORACLE["translate_slices"] = f"WITH {PAIRS} SELECT row_id, {REVERSED} AS translations FROM pairs WHERE hi_en IS NOT NULL"
ORACLE["translate_resume"] = f"WITH {PAIRS} SELECT hi_en AS src, {REVERSED} AS translation FROM pairs"
ORACLE["response_log"] = (
    f"WITH {PAIRS} SELECT row_id, " + strip("replace(en, chr(10), '')") + " AS line FROM pairs"
)

# ---- projections and cleaning --------------------------------------------------------

ORACLE["pair_view"] = f"""
WITH {PAIRS}
SELECT row_id, hi_en AS src, en AS tgt, 'translate' AS mode FROM pairs
UNION ALL SELECT row_id, hi_en, hi_en, 'denoise' FROM pairs"""

ORACLE["clean_rules"] = f"WITH {MESSY} SELECT origin, id, " + ", ".join(
    f"CAST(length({rule('text')}) AS INT) AS {name}" for name, rule in RULES.items()
) + " FROM messy"

ORACLE["clean_rules_retain"] = f"WITH {MESSY} SELECT origin, id, {clean('text', True)} AS cleaned FROM messy"
ORACLE["clean_text_alpha"] = f"WITH {MESSY} SELECT origin, id, {clean_alpha('text')} AS cleaned FROM messy"
ORACLE["clean_corpus"] = f"WITH {MESSY} SELECT origin, id, {clean('text')} AS cleaned FROM messy"


def _clean_report() -> str:
    stages = ["s0 AS (SELECT source, text AS t0 FROM messy)"]
    for i, rule in enumerate(RULES.values()):
        stages.append(f"s{i + 1} AS (SELECT *, {rule(f't{i}')} AS t{i + 1} FROM s{i})")
    parts = [
        f"SELECT source, '{name}' AS rule, CAST(sum(CASE WHEN t{i} <> t{i + 1} THEN 1 ELSE 0 END) AS BIGINT) AS rows_changed, "
        f"CAST(sum(length(t{i}) - length(t{i + 1})) AS BIGINT) AS chars_removed FROM s{len(RULES)} GROUP BY source"
        for i, name in enumerate(RULES)
    ]
    return f"WITH {MESSY}, {', '.join(stages)} {' UNION ALL '.join(parts)}"


ORACLE["clean_report"] = _clean_report()
ORACLE["ws_tokens"] = f"SELECT doc_id, CAST(len({toks('text')}) AS INT) AS n_tokens FROM documents"

# ---- filters and joins ---------------------------------------------------------------

ORACLE["row_range"] = f"""
WITH {PAIRS}, numbered AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS label FROM pairs)
SELECT CASE WHEN label <= 99 THEN 0 WHEN label <= 124 THEN 1 WHEN label <= 499 THEN 2 ELSE 3 END AS range_no,
       count(*) AS rows, min(row_id) AS first_row, max(row_id) AS last_row
FROM numbered GROUP BY 1"""

ORACLE["enrich_source"] = """
SELECT d.doc_id, l.source AS found, count(*) AS copies
FROM documents d LEFT JOIN documents l ON d.text = l.text GROUP BY d.doc_id, l.source"""

ORACLE["attach_predictions"] = f"WITH {PAIRS} SELECT row_id, en, {REVERSED} AS preds FROM pairs"
ORACLE["pending_rows"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"

# ---- counts, indexes, batches --------------------------------------------------------

ORACLE["token_totals"] = f"""
WITH {DOCS}
SELECT split, 'text' AS "column", CAST(sum(len({toks('text')})) AS BIGINT) AS tokens FROM docs GROUP BY split
UNION ALL
SELECT split, 'cleaned', CAST(sum(len({toks(clean('text'))})) AS BIGINT) FROM docs GROUP BY split"""

ORACLE["split_stats"] = f"""
WITH {DOCS} SELECT split, count(*) AS rows, (count(*) + 31) // 32 AS batches FROM docs GROUP BY split"""

WORDS = f"words AS (SELECT word, count(*) AS freq FROM (SELECT unnest({toks('text')}) AS word FROM documents) GROUP BY word)"
ORACLE["word_freq"] = f"WITH {WORDS} SELECT word, freq FROM words"
ORACLE["char_vocab"] = (
    "SELECT DISTINCT ch FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents)"
)


def _index(order: str, columns: str = "doc_id, split, row_index", where: str = "") -> str:
    return f"""
WITH {DOCS}, numbered AS (
  SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY {order}) - 1 AS row_index FROM docs),
batched AS (SELECT *, row_index // 32 AS batch_id FROM numbered)
SELECT {columns} FROM batched {where}"""


ORACLE["row_index"] = _index("text, doc_id")
ORACLE["batch_assign"] = _index("doc_id", "doc_id, split, row_index, batch_id")
ORACLE["shuffle_batches"] = _index(
    f"CASE WHEN split = 'train' THEN md5('{SEED}|shuffle|' || doc_id) ELSE '' END, doc_id",
    "doc_id, split, row_index, batch_id",
)
ORACLE["overfit_subset"] = _index("doc_id", where="WHERE row_index < 32")
ORACLE["group_fold_ordered"] = """
WITH turns AS (SELECT conv_id, turn, role, coalesce(length(text), 0) AS chars FROM conversations),
placed AS (
  SELECT *, lag(role) OVER w AS role_before, lag(chars) OVER w AS chars_before, row_number() OVER w AS i
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, chars)),
islands AS (
  SELECT *, sum(CASE WHEN chars > chars_before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) AS island FROM placed),
runs AS (SELECT conv_id, island, count(*) AS n, sum(CASE WHEN i > 1 AND role IS DISTINCT FROM role_before THEN 1 ELSE 0 END) AS c FROM islands GROUP BY 1, 2)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(c) AS BIGINT) AS changes, max(n) AS longest FROM runs GROUP BY conv_id"""

ORACLE["group_apply"] = """
SELECT source, count(*) AS rows, round(sum(length(text)) / CAST(count(*) AS DOUBLE), 6) AS mean_len
FROM documents GROUP BY source"""

# ---- vocabularies and BPE ------------------------------------------------------------

# Unicode whitespace as the pre-tokeniser sees it. RE2 has no look-ahead: a marker set
# before the last blank of a run that a word follows has the same effect.
BLANK = WS.replace(r"\x1c-\x20", r"\x20")


def pieces(x: str) -> str:
    marked = _re(x, f"([{BLANK}])([{BLANK}][^{BLANK}])", "\\1\\x01\\2").replace("\\x01", "\x01")
    pattern = (
        f"''s|''t|''re|''ve|''m|''ll|''d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{BLANK}\\p{{L}}\\p{{N}}\\x01]+|[{BLANK}]+"
    )
    return f"regexp_extract_all({marked}, '{pattern}')"


ORACLE["pretokenize"] = f"""
SELECT doc_id, CAST(len(p) AS INT) AS n_pieces, md5(array_to_string(p, chr(1))) AS pieces
FROM (SELECT doc_id, {pieces('text')} AS p FROM documents)"""

CHAR_PAIRS = f"""{WORDS},
symbols AS (SELECT word, freq, regexp_extract_all(word, '(?s).') AS s FROM words),
places AS (SELECT word, freq, s, unnest(range(1, len(s))) AS i FROM symbols),
char_pairs AS (SELECT s[i] AS l, s[i + 1] AS r, sum(freq) AS freq FROM places GROUP BY 1, 2)"""
ORACLE["bpe_pair_freqs"] = (
    f'WITH {CHAR_PAIRS} SELECT l AS "left", r AS "right", CAST(freq AS BIGINT) AS freq FROM char_pairs'
)
ORACLE["bpe_merge_step"] = f"""
WITH {CHAR_PAIRS},
pair AS MATERIALIZED (SELECT l || r AS p FROM char_pairs ORDER BY freq DESC, l, r LIMIT 1),
cut AS MATERIALIZED (SELECT word, regexp_extract_all(replace(word, p, chr(57344)), '(?s).') AS parts, p FROM words CROSS JOIN pair)
SELECT word, replace(array_to_string(parts, ' '), chr(57344), p) AS merged FROM cut"""


def _training(merges: int, more: int = 0, also: bool = False) -> str:
    """Greedy merges one at a time; a symbol is its id as ``<0071>``.

    ``also`` splits the pieces of the conversations too, without learning from them.
    """
    ids = byte_alphabet(4)
    names = [f"<{ids[ch]:05d}>" for ch in byte_characters()]
    names_list = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    new = "SELECT unnest(" + pieces("text") + ") AS piece, 0 AS old FROM conversations"
    union = f" UNION ALL {new}" if more or also else ""
    return f"""
pieces AS (SELECT unnest({pieces('text')}) AS piece, 1 AS old FROM documents{union}),
words AS (
  SELECT piece, CAST(sum(old) AS BIGINT) AS f_old, count(*) AS f_all,
         array_to_string(list_transform(regexp_extract_all(hex(encode(piece)), '..'),
           lambda h: ({names_list})[CAST(('0x' || h) AS INT) + 1]), '') AS w
  FROM pieces GROUP BY piece),
steps AS (
  SELECT 0 AS k, piece, f_old, f_all, w, '' AS pair FROM words
  UNION ALL
  SELECT s.k + 1, s.piece, s.f_old, s.f_all,
         replace(s.w, b.pair, '<' || lpad(CAST(260 + s.k AS VARCHAR), 5, '0') || '>'), b.pair
  FROM steps s, (
    SELECT substr(w, i * 7 + 1, 14) AS pair FROM (
      SELECT w, unnest(range(0, length(w) // 7 - 1)) AS i,
             CASE WHEN k < {merges} THEN f_old ELSE f_all END AS f FROM steps)
    GROUP BY 1 ORDER BY sum(f) DESC, 1 LIMIT 1) b
  WHERE s.k < {merges + more}),
learnt AS MATERIALIZED (SELECT DISTINCT k - 1 AS rank, CAST(substr(pair, 2, 5) AS INT) AS l, CAST(substr(pair, 9, 5) AS INT) AS r
           FROM steps WHERE k > 0)"""


def _merge_table(merges: int, more: int = 0) -> str:
    chars = "[" + ", ".join("chr(%d)" % ord(ch) for ch in sorted(byte_characters())) + "]"
    return f"""
WITH RECURSIVE {_training(merges, more)},
spelt AS (
  SELECT -1 AS rank, {chars} AS texts, '' AS "left", '' AS "right", '' AS merged
  UNION ALL
  SELECT m.rank, list_append(s.texts, s.texts[m.l - 3] || s.texts[m.r - 3]),
         s.texts[m.l - 3], s.texts[m.r - 3], s.texts[m.l - 3] || s.texts[m.r - 3]
  FROM spelt s JOIN learnt m ON m.rank = s.rank + 1)
SELECT rank, "left", "right", merged FROM spelt WHERE rank >= 0"""


ORACLE["bpe_train"] = _merge_table(MERGES)
ORACLE["bpe_incremental"] = _merge_table(MERGES, MORE_MERGES - MERGES)
ORACLE["bpe_tokenize"] = f"""
WITH RECURSIVE {_training(MERGES)},
sizes AS (SELECT piece, length(w) // 7 AS n FROM steps WHERE k = {MERGES}),
placed AS (SELECT doc_id, unnest({pieces('text')}) AS piece FROM documents)
SELECT d.doc_id, CAST(coalesce(sum(n), 0) AS INT) AS n_tokens
FROM documents d LEFT JOIN placed p ON p.doc_id = d.doc_id LEFT JOIN sizes s ON s.piece = p.piece GROUP BY d.doc_id"""

PIECE_IDS = f"""
piece_ids AS (SELECT piece, list_transform(regexp_extract_all(w, '<(\\d+)>', 1), lambda x: CAST(x AS INT)) AS ids
              FROM steps WHERE k = {MERGES})"""


def bpe_of(name: str, table: str, key: str, text: str) -> str:
    """All byte-pair ids of every row of a table."""
    return f"""
{name}_s AS (SELECT {key}, {pieces(text)} AS p FROM {table}),
{name}_p AS (SELECT {key}, unnest(p) AS piece, unnest(range(0, len(p))) AS i FROM {name}_s),
{name}_l AS (SELECT {key}, flatten(list(ids ORDER BY i)) AS ids FROM {name}_p JOIN piece_ids USING (piece) GROUP BY {key}),
{name} AS (SELECT {key}, coalesce(ids, CAST([] AS INT[])) AS ids FROM {name}_s LEFT JOIN {name}_l USING ({key}))"""


def framed30(ids: str) -> str:
    return f"list_concat(list_concat([0], list_slice({ids}, 1, 28)), [2])"


def padded30(ids: str, pad: int) -> str:
    return f"list_concat({ids}, list_transform(range(0, 30 - len({ids})), lambda i: {pad}))"


ORACLE["bpe_encode_pairs"] = f"""
WITH RECURSIVE {_training(MERGES, also=True)}, {PIECE_IDS}, {PAIRS},
{bpe_of('s', 'pairs', 'row_id', 'hi_en')}, {bpe_of('t', 'pairs', 'row_id', 'en')},
both_sides AS (SELECT row_id, {framed30('s.ids')} AS a, {framed30('t.ids')} AS b FROM s JOIN t USING (row_id))
SELECT row_id, {show(padded30('a', 1))} AS input_ids,
       {show("list_transform(range(0, 30), lambda i: CASE WHEN i < len(a) THEN 1 ELSE 0 END)")} AS attention_mask,
       {show(padded30('b', -100))} AS labels
FROM both_sides"""
ORACLE["bpe_decode"] = "SELECT doc_id, text FROM documents"
ORACLE["bpe_token_totals"] = f"""
WITH RECURSIVE {_training(MERGES)}, {DOCS},
sizes AS (SELECT piece, length(w) // 7 AS n FROM steps WHERE k = {MERGES}),
placed AS (SELECT split, unnest({pieces('text')}) AS piece FROM docs)
SELECT split, 'text' AS "column", CAST(sum(n) AS BIGINT) AS tokens FROM placed JOIN sizes USING (piece) GROUP BY split"""

VOCAB = f"""
train_words AS (
  SELECT word, count(*) AS freq FROM (
    SELECT unnest({toks(clean('text'))}) AS word FROM docs WHERE split = 'train') GROUP BY word),
vocab AS (
  SELECT CAST(3 + row_number() OVER (ORDER BY freq DESC, word) AS INT) AS id, word AS token
  FROM train_words WHERE word NOT IN ('<s>', '<pad>', '</s>', '<unk>', '<mask>')
  QUALIFY row_number() OVER (ORDER BY freq DESC, word) <= {VOCAB_SIZE}
  UNION ALL SELECT * FROM (VALUES (0, '<s>'), (1, '<pad>'), (2, '</s>'), (3, '<unk>')))
"""
MASKED_VOCAB = f"""{VOCAB},
full_vocab AS (SELECT * FROM vocab UNION ALL SELECT max(id) + 1, '<mask>' FROM vocab)"""

ORACLE["bpe_vocab_styles"] = f"""
WITH RECURSIVE {_merge_table(MERGES).split("WITH RECURSIVE", 1)[1].rsplit("SELECT rank", 1)[0]},
{DOCS}, {MASKED_VOCAB},
trained AS (
  SELECT CAST(3 + i AS INT) AS id, t AS token FROM (
    SELECT unnest(texts) AS t, unnest(range(1, len(texts) + 1)) AS i FROM spelt WHERE rank = {MERGES - 1})
  UNION ALL SELECT * FROM (VALUES (0, '<s>'), (1, '<pad>'), (2, '</s>'), (3, '<unk>'), ({260 + MERGES}, '<mask>'))),
lacking AS (SELECT token, row_number() OVER (ORDER BY id) AS i FROM trained WHERE token NOT IN (SELECT token FROM full_vocab))
SELECT 'DEFAULT' AS style, id, token FROM full_vocab
UNION ALL SELECT 'SCRATCH', id, token FROM trained
UNION ALL SELECT 'APPEND', id, token FROM full_vocab
UNION ALL SELECT 'APPEND', CAST((SELECT max(id) FROM full_vocab) + i AS INT), token FROM lacking"""

ORACLE["vocab_append"] = f"""
WITH {DOCS}, {MASKED_VOCAB},
new_words AS (
  SELECT DISTINCT w FROM (SELECT unnest({toks('text')}) AS w FROM conversations)
  WHERE w NOT IN (SELECT token FROM full_vocab))
SELECT id, token FROM full_vocab
UNION ALL
SELECT CAST((SELECT max(id) FROM full_vocab) + row_number() OVER (ORDER BY w) AS INT), w FROM new_words"""

# ---- encoding ------------------------------------------------------------------------


def encoded(name: str, table: str, key: str, text: str) -> str:
    """Framed ids of the first 28 tokens of every row of a table."""
    return f"""
{name}_t AS (SELECT {key}, list_slice({toks(text)}, 1, 28) AS t FROM {table}),
{name}_p AS (SELECT {key}, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS pos FROM {name}_t),
{name}_i AS (SELECT {key}, list(coalesce(id, 3) ORDER BY pos) AS ids
             FROM {name}_p LEFT JOIN full_vocab USING (token) GROUP BY {key}),
{name}_f AS (SELECT {key}, list_concat(list_concat([0], coalesce(ids, CAST([] AS INT[]))), [2]) AS framed
             FROM {name}_t LEFT JOIN {name}_i USING ({key})),
{name} AS (SELECT {key}, framed,
             list_concat(framed, list_transform(range(0, 30 - len(framed)), lambda i: 1)) AS ids,
             list_transform(range(0, 30), lambda i: CASE WHEN i < len(framed) THEN 1 ELSE 0 END) AS att
           FROM {name}_f)"""


ENC = f"{DOCS}, {PAIRS}, {MASKED_VOCAB}, {encoded('src', 'pairs', 'row_id', clean('hi_en'))}, " + encoded(
    "tgt", "pairs", "row_id", clean("en")
)
MASK_ID = "(SELECT max(id) FROM full_vocab)"

ORACLE["encode_pairs"] = f"""
WITH {ENC}
SELECT row_id, {show('src.ids')} AS input_ids, {show('src.att')} AS attention_mask,
       {show("list_transform(tgt.ids, lambda x: CASE WHEN x = 1 THEN -100 ELSE x END)")} AS labels
FROM src JOIN tgt USING (row_id)"""

ORACLE["encode_batch"] = f"""
WITH {ENC}
SELECT row_id, {clean('hi_en')} AS hi_en, {clean('en')} AS en,
       {show('src.ids')} AS src_tokenized, {show('src.att')} AS src_attention_mask,
       {show('tgt.ids')} AS tgt_tokenized, {show('tgt.att')} AS tgt_attention_mask
FROM src JOIN tgt USING (row_id) JOIN pairs USING (row_id)"""

ORACLE["decode_ids"] = f"""
WITH {ENC},
places AS (SELECT row_id, unnest(ids) AS id, unnest(range(0, 30)) AS pos FROM tgt)
SELECT row_id, coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (token NOT IN
         ('<s>', '<pad>', '</s>', '<unk>', '<mask>')), '') AS text
FROM places JOIN full_vocab USING (id) GROUP BY row_id"""

SPECIAL = f"x IN (0, 1, 2, 3) OR x = {MASK_ID}"
ORACLE["special_mask"] = f"""
WITH {ENC},
places AS (SELECT row_id, unnest(ids) AS x, unnest(range(0, 30)) AS pos FROM src)
SELECT row_id, string_agg(CASE WHEN {SPECIAL} THEN '1' ELSE '0' END, ' ' ORDER BY pos) AS special,
       coalesce(string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) FILTER (x = 1), '') AS pads
FROM places GROUP BY row_id"""

ORACLE["pad_batch"] = f"""
WITH {ENC},
batched AS (SELECT row_id, framed, (row_number() OVER (ORDER BY row_id) - 1) // 32 AS batch_id FROM src),
longest AS (SELECT *, max(len(framed)) OVER (PARTITION BY batch_id) AS n FROM batched)
SELECT row_id, batch_id,
       {show("list_concat(framed, list_transform(range(0, n - len(framed)), lambda i: 1))")} AS input_ids,
       {show("list_transform(range(0, n), lambda i: CASE WHEN i < len(framed) THEN 1 ELSE 0 END)")} AS attention_mask
FROM longest"""

ORACLE["collate_apply"] = f"""
WITH {ENC},
batched AS (SELECT row_id, framed, row_number() OVER (ORDER BY row_id) - 1 AS i FROM src),
longest AS (SELECT *, i // 32 AS batch_id, max(len(framed)) OVER (PARTITION BY i // 32) AS n FROM batched)
SELECT row_id, batch_id, CAST(i % 32 AS INT) AS place, CAST(n AS INT) AS width,
       {show("list_concat(framed, list_transform(range(0, n - len(framed)), lambda i: 1))")} AS input_ids
FROM longest"""

ORACLE["argmax_decode"] = """
WITH cells AS (
  SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
best AS (SELECT vec_id, i // 16 AS step, i % 16 AS id, row_number() OVER (
           PARTITION BY vec_id, i // 16 ORDER BY x DESC, i) AS place FROM cells)
SELECT vec_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY step) AS token_ids FROM best WHERE place = 1 GROUP BY vec_id"""

# ---- denoising -----------------------------------------------------------------------


def _window(tag: str, p: float, most: int, least: int, name: str) -> str:
    """Start ``s`` and size ``z`` of the span of every window of ids; size 0 for none."""
    return f"""
{tag}_span AS (
  SELECT win, min(pos) FILTER (free) AS a, max(pos) FILTER (free) AS b, count(*) FILTER (free) AS n
  FROM cells GROUP BY win),
{tag}_size AS (
  SELECT *, CASE WHEN {u(tag + '-row', 'win')} < {p} AND n > 1 THEN greatest({least},
    CAST(floor({u(tag + '-size', 'win')} * (least({most}, b - a + 1) + 1)) AS INT)) ELSE 0 END AS z0
  FROM {tag}_span),
{name} AS (
  SELECT win, CASE WHEN z0 > 0 AND b - z0 >= a THEN z0 ELSE 0 END AS z,
         CASE WHEN z0 > 0 AND b - z0 >= a
              THEN a + CAST(floor({u(tag + '-start', 'win')} * (b - z0 - a + 1)) AS INT) ELSE 0 END AS s
  FROM {tag}_size)"""


WORD_IDS = f"""{DOCS}, {MASKED_VOCAB},
e_t AS (SELECT doc_id, {toks(clean('text'))} AS t FROM docs),
e_p AS (SELECT doc_id, unnest(t) AS token, unnest(range(0, len(t))) AS i FROM e_t),
e_l AS (SELECT doc_id, list(coalesce(id, 3) ORDER BY i) AS ids FROM e_p LEFT JOIN full_vocab USING (token) GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(ids, CAST([] AS INT[])) AS ids FROM e_t LEFT JOIN e_l USING (doc_id))"""


def noise(mask_id: str) -> str:
    """Masks and permutations of all windows of 28 ids of ``e(doc_id, ids)``."""
    return f"""
parts AS (SELECT doc_id, ids, unnest(range(0, greatest(1, CAST(ceil(len(ids) / 28.0) AS BIGINT)))) AS part FROM e),
windows AS (
  SELECT doc_id, part, doc_id || ':' || part AS win, list_concat(list_concat([0], list_slice(ids, part * 28 + 1, part * 28 + 28)), [2]) AS f
  FROM parts),
batched AS (SELECT doc_id, part, win, {padded30('f', 1)} AS ids, (row_number() OVER (ORDER BY doc_id, part) - 1) // 32 AS batch_id FROM windows),
raw_cells AS (SELECT doc_id, part, win, batch_id, unnest(ids) AS x, unnest(range(0, 30)) AS pos FROM batched),
cells AS (SELECT *, NOT (x IN (0, 1, 2, 3) OR x = {mask_id}) AS free FROM raw_cells),
{_window('group', 0.15, 5, 0, 'spans')}, {_window('permute', 0.5, 5, 2, 'permute')},
unit_cells AS (
  SELECT c.*, CASE WHEN free AND {u('unit', 'win', 'pos')} < 0.15 THEN 1 ELSE 0 END AS unit,
         CASE WHEN pos >= g.s AND pos < g.s + g.z THEN 1 ELSE 0 END AS grp,
         CASE WHEN pos >= p.s AND pos < p.s + p.z THEN 1 ELSE 0 END AS per
  FROM cells c JOIN spans g USING (win) JOIN permute p USING (win)),
styles AS (SELECT DISTINCT batch_id, {u('style', 'batch_id')} < 0.15 AS spanned, {u('task', 'batch_id')} < 0.5 AS masks FROM batched),
mlm_out AS (
  SELECT doc_id, part, batch_id, pos, x, m, CASE WHEN m = 1 THEN {mask_id} ELSE x END AS d
  FROM (SELECT *, CASE WHEN spanned THEN grp ELSE unit END AS m FROM unit_cells JOIN styles USING (batch_id))),
sources AS (
  SELECT win, x, row_number() OVER (PARTITION BY win ORDER BY {u('permute-place', 'win', 'pos')}, pos) AS place
  FROM unit_cells WHERE per = 1),
targets AS (
  SELECT win, pos, row_number() OVER (PARTITION BY win ORDER BY pos) AS place FROM unit_cells WHERE per = 1),
moved AS (SELECT t.win, t.pos, s.x AS y FROM targets t JOIN sources s USING (win, place)),
plm_out AS (
  SELECT c.doc_id, c.part, c.batch_id, c.pos, c.x, c.per AS m, coalesce(y, c.x) AS d
  FROM unit_cells c LEFT JOIN moved USING (win, pos))"""


NOISE = f"{WORD_IDS}, {noise(MASK_ID)}"


def _lists(x: str) -> str:
    return f"string_agg(CAST({x} AS VARCHAR), ' ' ORDER BY pos)"


def _noise_rows(table: str, extra: str = "", group: str = "") -> str:
    return f"""SELECT doc_id, part, batch_id{extra}, {_lists('x')} AS input_ids, {_lists('d')} AS denoised, {_lists('m')} AS mask,
       {_lists('CASE WHEN m = 1 THEN x ELSE -100 END')} AS mask_labels
FROM {table} GROUP BY doc_id, part, batch_id{group}"""


ORACLE["denoise_mlm"] = f"WITH {NOISE} {_noise_rows('mlm_out')}"
ORACLE["denoise_plm"] = f"WITH {NOISE} {_noise_rows('plm_out')}"
ORACLE["group_mask"] = f"""
WITH {NOISE} SELECT doc_id, part, batch_id, {_lists('x')} AS input_ids, {_lists('grp')} AS mask
FROM unit_cells GROUP BY doc_id, part, batch_id"""
ORACLE["denoise_mixed"] = f"""
WITH {NOISE}, chosen AS (
  SELECT m.*, 'mask' AS task FROM mlm_out m JOIN styles USING (batch_id) WHERE masks
  UNION ALL SELECT p.*, 'permute' FROM plm_out p JOIN styles USING (batch_id) WHERE NOT masks)
{_noise_rows('chosen', ', task', ', task')}"""
ORACLE["denoise_off"] = f"""
WITH {NOISE}, quiet AS (SELECT doc_id, part, batch_id, pos, x, x AS d, 0 AS m FROM cells)
{_noise_rows('quiet')}"""
ORACLE["bpe_denoise"] = f"""
WITH RECURSIVE {_training(MERGES)}, {PIECE_IDS}, {bpe_of('e', 'documents', 'doc_id', 'text')}, {noise(str(260 + MERGES))}
{_noise_rows('mlm_out')}"""

# ---- evaluation ----------------------------------------------------------------------


def words_13a(x: str) -> str:
    for old, new in [("<skipped>", "''"), ("-' || chr(10) || '", "''"), ("&quot;", "'\"'"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'")]:
        x = f"replace({x}, '{old}', {new})"
    x = f"' ' || replace({x}, chr(10), ' ') || ' '"
    x = _re(x, r"([\{-~\[-\x60 -&\(-\+:-@/])", r" \1 ")
    x = _re(x, r"([^0-9])([.,])", r"\1 \2 ")
    x = _re(x, r"([.,])([^0-9])", r" \1 \2")
    x = _re(x, r"([0-9])(-)", r"\1 \2 ")
    return toks(x)


def ngram_counts(name: str, table: str, key: str, by: str, orders: int, units) -> str:
    """Per ``by`` group and order: matches, hypothesis grams, reference grams."""
    leads = ", ".join(f"lead(c, {n - 1}) OVER w AS c{n}" for n in range(1, orders + 1))
    grams = " UNION ALL ".join(
        f"SELECT {key}, side, {n} AS n, "
        + " || chr(1) || ".join(f"c{i}" for i in range(1, n + 1))
        + f" AS g FROM {name}_l WHERE c{n} IS NOT NULL"
        for n in range(1, orders + 1)
    )
    return f"""
{name}_u AS (SELECT {key}, 'h' AS side, {units('hyp')} AS us FROM {table}
             UNION ALL SELECT {key}, 'r', {units('ref')} FROM {table}),
{name}_c AS (SELECT {key}, side, unnest(us) AS c, unnest(range(0, len(us))) AS pos FROM {name}_u),
{name}_l AS (SELECT {key}, side, {leads} FROM {name}_c WINDOW w AS (PARTITION BY {key}, side ORDER BY pos)),
{name}_g AS (SELECT {key}, n, g, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r
             FROM ({grams}) GROUP BY {key}, n, g),
{name}_row AS (SELECT {key}, n, sum(least(h, r)) AS m, sum(h) AS h, sum(r) AS r FROM {name}_g GROUP BY {key}, n),
{name}_n AS (SELECT {by}, n, CAST(sum(m) AS DOUBLE) AS m,
               CAST(sum(CASE WHEN r > 0 OR {orders} = 4 THEN h ELSE 0 END) AS DOUBLE) AS h, CAST(sum(r) AS DOUBLE) AS r
             FROM {name}_row JOIN (SELECT DISTINCT {key}, {by} FROM {table}) USING ({key}) GROUP BY {by}, n)"""


def _over(x: str, n: int, kind: str) -> str:
    return f"coalesce(max({kind}) FILTER (n = {n}), 0)"


def bleu_of(name: str, by: str, smooth: bool = True) -> str:
    """``by..., bleu`` from the counts of :func:`ngram_counts`."""
    wide = ", ".join(f"{_over('', n, k)} AS {k}{n}" for n in range(1, 5) for k in ("m", "h", "r"))
    if smooth:
        zeros = ["0"]
        for n in range(1, 5):
            zeros.append(f"{zeros[-1]} + CASE WHEN m{n} = 0 THEN 1 ELSE 0 END")
        logs = " + ".join(
            f"ln(CASE WHEN m{n} = 0 THEN 100.0 / (2 ** ({zeros[n]}) * h{n}) ELSE 100.0 * m{n} / h{n} END)" for n in range(1, 5)
        )
        defined = "h1 > 0 AND h2 > 0 AND h3 > 0 AND h4 > 0 AND m1 + m2 + m3 + m4 > 0"
    else:
        logs = " + ".join(f"ln(m{n} / h{n})" for n in range(1, 5))
        defined = "m1 > 0 AND m2 > 0 AND m3 > 0 AND m4 > 0"
    return f"""
{name}_w AS (SELECT {by}, {wide} FROM {name}_n GROUP BY {by}),
{name}_s AS (SELECT {by}, CASE WHEN {defined} THEN
    (CASE WHEN h1 >= r1 THEN 1.0 ELSE exp(1.0 - r1 / h1) END) * exp(({logs}) / 4) ELSE 0.0 END AS score FROM {name}_w)"""


def chrf_of(name: str, by: str) -> str:
    return f"""
{name}_a AS (SELECT {by}, avg(m / h) AS p, avg(m / r) AS q FROM {name}_n WHERE h > 0 AND r > 0 GROUP BY {by}),
{name}_s AS (SELECT {by}, CASE WHEN p + q > 0 THEN 500.0 * p * q / (4 * p + q) ELSE 0.0 END AS score FROM {name}_a)"""


def chars(x: str) -> str:
    return f"regexp_extract_all({_re(x, f'[{WS}]')}, '(?s).')"


def _score(kind: str, table: str = "ev", cte: str = EVAL, by: str = "source") -> str:
    if kind == "chrf":
        body = ngram_counts("x", table, "doc_id", by, 6, chars) + "," + chrf_of("x", by)
    else:
        units = words_13a if kind == "bleu" else toks
        body = ngram_counts("x", table, "doc_id", by, 4, units) + "," + bleu_of("x", by, kind == "bleu")
    return f"WITH {cte}, {body} SELECT {by}, round(score, 6) AS score FROM x_s"


ORACLE["bleu_by_source"] = _score("bleu")
ORACLE["bleu_plain"] = _score("plain")
ORACLE["chrf_by_source"] = _score("chrf")
ORACLE["eval_by_source_filter"] = _score("bleu", cte=EVAL.replace("FROM documents", "FROM documents WHERE source = 'src16'"))
ORACLE["bleu_batch_mean"] = (
    _score(
        "bleu",
        "evb",
        f"{EVAL}, evb AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 32 AS batch_id FROM ev)",
        "source, batch_id",
    ).rsplit("SELECT source, batch_id", 1)[0]
    + "SELECT source, round(avg(score), 6) AS score FROM x_s GROUP BY source"
)

PRF = f"""
n_vectors AS (SELECT count(*) AS n FROM embeddings),
v_tokens AS (
  SELECT doc_id, source, 'h' AS side, unnest({toks('hyp')}) AS t FROM ev
  UNION ALL SELECT doc_id, source, 'r', unnest({toks('ref')}) FROM ev),
v_ids AS (
  SELECT doc_id, side, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % (SELECT n FROM n_vectors) AS v, count(*) AS c
  FROM v_tokens GROUP BY ALL),
unit AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x) AS e FROM embeddings),
cosines AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM unit a, unit b),
same AS (SELECT x.* FROM v_ids x JOIN v_ids y ON x.doc_id = y.doc_id AND x.side <> y.side AND x.v = y.v),
other AS (SELECT x.* FROM v_ids x ANTI JOIN v_ids y ON x.doc_id = y.doc_id AND x.side <> y.side AND x.v = y.v),
-- a vector found on both sides has cosine 1 with itself, which no other vector can beat
matches AS (
  SELECT doc_id, side, v, c, 1.0 AS s FROM same
  UNION ALL
  SELECT x.doc_id, x.side, x.v, x.c, max(s) AS s
  FROM other x JOIN v_ids y ON x.doc_id = y.doc_id AND x.side <> y.side
  JOIN cosines ON a = x.v AND b = y.v GROUP BY ALL),
pq AS (SELECT doc_id, sum(c * s) FILTER (side = 'h') / sum(c) FILTER (side = 'h') AS p,
              sum(c * s) FILTER (side = 'r') / sum(c) FILTER (side = 'r') AS r FROM matches GROUP BY doc_id),
prf AS (SELECT ev.doc_id, ev.source, coalesce(p, 0) AS p, coalesce(r, 0) AS r,
               CASE WHEN coalesce(p + r, 0) = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM ev LEFT JOIN pq USING (doc_id))"""
MEANS = "round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1"
ORACLE["embedding_score"] = f"WITH {EVAL}, {PRF} SELECT source, {MEANS} FROM prf GROUP BY source"

ORACLE["metrics_report"] = f"""
WITH {EVAL.replace('AS hyp FROM', 'AS hyp, text AS generated FROM')}, {PRF.replace(toks('hyp'), toks('generated'))},
{ngram_counts('b', 'ev', 'doc_id', 'source', 4, words_13a)},
{ngram_counts('k', 'ev', 'doc_id', 'source', 6, chars)},
bo_n AS (SELECT source, n, m, h, r FROM b_n UNION ALL SELECT NULL, n, sum(m), sum(h), sum(r) FROM b_n GROUP BY n),
ko_n AS (SELECT source, n, m, h, r FROM k_n UNION ALL SELECT NULL, n, sum(m), sum(h), sum(r) FROM k_n GROUP BY n),
{bleu_of('bo', 'source')}, {chrf_of('ko', 'source')},
means AS (SELECT source, {MEANS} FROM prf GROUP BY ROLLUP (source))
SELECT bo_s.source, round(bo_s.score, 6) AS bleu, round(ko_s.score, 6) AS chrf, precision, recall, f1
FROM bo_s JOIN ko_s ON bo_s.source IS NOT DISTINCT FROM ko_s.source JOIN means ON means.source IS NOT DISTINCT FROM bo_s.source"""

SYSTEMS = f"""base AS (SELECT doc_id AS id, source, text, {clean('text')} AS ref FROM documents),
sys AS (SELECT id * 2 AS doc_id, 'letters' AS system, source, ref, {clean_alpha('text')} AS hyp FROM base
        UNION ALL SELECT id * 2 + 1, 'raw', source, ref, text FROM base)"""
ORACLE["system_compare"] = f"""
WITH {SYSTEMS},
{ngram_counts('b', 'sys', 'doc_id', 'system, source', 4, words_13a)}, {bleu_of('b', 'system, source')},
{ngram_counts('k', 'sys', 'doc_id', 'system, source', 6, chars)}, {chrf_of('k', 'system, source')}
SELECT system, source, round(b_s.score, 6) AS bleu, round(k_s.score, 6) AS chrf FROM b_s JOIN k_s USING (system, source)"""
