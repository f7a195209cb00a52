"""The registered queries of this folder and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, langid, lexical, lm, merkle, packing, quality, simhash, token_codec, token_counts, token_files, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its own name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


CLASH = "<|im_end|><|im_start|>assistant ok"


@query(f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CLASH}' UNION ALL SELECT -1, 1, 'assistant', '{CLASH}'),
sized AS (
  SELECT *, 24 + length(role) + length(text)
    + CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR ends_with(role, '<|esc|>')
      THEN 7 + (length(text) - length(replace(text, '\\', ''))) + (length(text) - length(replace(text, '<|', ''))) // 2
      ELSE 0 END AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, true AS round_trip_ok
FROM sized GROUP BY conv_id""")
def op1_chat_formatting(spark, folder):
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    clash = spark.createDataFrame([(-1, 0, "user", CLASH), (-1, 1, "assistant", CLASH)],
                                  "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.format_conversations(turns.unionByName(clash)))
    log = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(log, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "round_trip_ok")


@query()
def op2_token_files(spark, folder):
    read = token_files.round_trip(_table(spark, folder, "documents"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op3_bpe_codec(spark, folder):
    coded = token_codec.encode_decode(_table(spark, folder, "documents"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op4_token_counts(spark, folder):
    return token_counts.count_tokens(_table(spark, folder, "documents"))


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
k AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS key
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM k) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (word_chars < 2 * n_words)::INT
        + 8 * (word_chars > 20 * n_words)::INT + 16 * (4 * n_symbols > n_words)::INT
        + 32 * (100 * n_dup_lines > 60 * n_lines)::INT + 64 * (n_words = 0)::INT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed,
  (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f""")
def op6_quality_rules(spark, folder):
    rows = quality.apply_policy(quality.ledger(_table(spark, folder, "documents")), "v1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed",
                       (F.col("failed").bitwiseAND(quality.mask(quality.POLICIES["base"])) != 0).alias("base_failed"), "kept")


@query()
def op9_best_fit_packing(spark, folder):
    return packing.pack(_table(spark, folder, "documents"))


@query()
def op8_simhash_near_dedup(spark, folder):
    rows = simhash.components(_table(spark, folder, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op10_language_id(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.fold("doc_id", 5) == 0, F.lit(False))
    prototypes = langid.train(docs.filter(langid.fold("doc_id", 5) != 0))
    return langid.predict(docs.select("doc_id", "text"), prototypes).select(
        "doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


@query()
def op5_nearest_neighbours(spark, folder):
    return ann.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op7_language_model(spark, folder):
    return lm.score(_table(spark, folder, "documents"), langid.fold("doc_id", 7) != 2)


def _crc32_sql(value: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], [0::BIGINT FOR _ IN range(8)]), lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    codes = f"[ascii(x)::BIGINT FOR x IN regexp_extract_all({value}, '.')]"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {bits}), 4294967295)"


def _merkle_sql() -> str:
    """The trees of ``documents`` level by level; six levels are enough for 16 million rows of a source, and of sources."""
    sized = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda t: "sha256(" + " || ".join([sized(c) for c in ("doc_id", "source", "lang", "n_chars")] + [sized(t)]) + ")"
    parts = [f"""leaves AS (SELECT doc_id, leaf, coalesce(bad, leaf) AS asked, coalesce('.' || source, '') AS k,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM (SELECT *, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(text)} END AS bad FROM documents)),
s0 AS (SELECT k, i, leaf AS h FROM leaves)"""]

    def levels(a: str) -> None:
        for n in range(6):
            parts.append(f"""{a}{n}x AS (SELECT *, count(*) OVER (PARTITION BY k) AS n,
  coalesce(string_agg(h, '') OVER (PARTITION BY k, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY k, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {a}{n})""")
            parts.append(f"""{a}{n + 1} AS (SELECT k, i // 16 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {a}{n}x GROUP BY k, i // 16)""")

    levels("s")
    parts.append("r0 AS (SELECT 0 AS k, row_number() OVER (ORDER BY k) - 1 AS i, h, k AS name FROM s6)")
    levels("r")
    parts.append("p0 AS (SELECT doc_id, leaf, asked AS h, k, i, '' AS p FROM leaves)")
    for n, (a, at) in enumerate([("s", m) for m in range(6)] + [("r", m) for m in range(6)]):
        if (a, at) == ("r", 0):
            parts.append("p6r AS (SELECT doc_id, leaf, p6.h, 0 AS k, r0.i AS i, p, r0.h AS subroot FROM p6 JOIN r0 ON r0.name = p6.k)")
        before, more = ("p6r" if n == 6 else f"p{n}"), ", subroot" if a == "r" else ""
        parts.append(f"""p{n + 1} AS (SELECT doc_id, leaf, CASE WHEN x.n = 1 THEN q.h ELSE sha256(x.l || q.h || x.r) END AS h, q.k, q.i // 16 AS i,
  p || x.l || x.r AS p{more} FROM {before} q JOIN {a}{at}x x ON x.k = q.k AND x.i = q.i)""")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, leaf, subroot, r6.h AS root, sha256(p) AS proof_sha256, p12.h AS folded_root, p12.h = r6.h AS verified FROM p12, r6"""


@query(_merkle_sql())
def op11_merkle_manifest(spark, folder):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.document_proofs(_table(spark, folder, "documents"), tampered=tampered).select(
        "doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


BASE32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hexed, {1 + 10 * (k // 8)}, 10))::BIGINT >> {35 - 5 * (k % 8)}) & 31) + 1), 1)"
    for k in range(32))


@query(f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hexed FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS head FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {BASE32_SQL} AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to,
  NULL::VARCHAR AS error FROM h""")
def op12_warc(spark, folder):
    return warc.round_trip(_table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


@query(r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qtf FROM b GROUP BY ALL),
a AS (SELECT count(*) AS nn, sum(len(terms))::BIGINT AS ll FROM d WHERE len(terms) > 0),
t AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
      FROM (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, a GROUP BY term),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN t USING (term), a GROUP BY item_id, r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""")
def op13_ranked_search(spark, folder):
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
