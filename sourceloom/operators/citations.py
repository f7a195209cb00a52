"""Bibliographic citations: grounding of clues, formal joins, candidates and proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.claims import author_match
from ..functions.text import content_hash, contains_phrase, is_blank, word_norm
from ..functions.times import capture_ts, month_day_present, names_a_day, prose_dates
from ..functions.urls import doi_identifiers, url_identifiers
from .admission import reason_codes

# Words that make a quotation a citation, and headings of a primary body.
CONTEXT = r"(?i)\b(study|studies|published|paper|research|report|article|journal)\b"
BODY_HEADING = r"(?im)^\s*(results|methods|materials and methods|methodology|discussion)\s*$"
ARCHIVE = r"^https://web\.archive\.org/web/(\d{14})(?:id_)?/(https?://.+)$"
FRONT_CHARS = 24000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in as many partitions as shuffles have: quotes and contents shrink so much in a shuffle that partitions merged by their
    size in bytes would hold far more in memory."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def quote_rows(clues: DataFrame) -> DataFrame:
    """One row per supplied quote with what it carries; a clue set holds at most a few quotes."""
    rows = clues.select("clue_id", "source_url", "author", "journal", "keywords", F.posexplode("quotes").alias("pos", "quote"))
    norm = word_norm(F.col("quote"))
    has = lambda c: contains_phrase(norm, word_norm(c))
    prose = F.regexp_replace(F.regexp_replace("quote", r"https?://[^\s<>\[\]\"']+", ""), r"(?iU)(?<!\w)10\.\d{4,9}/[^\s<>\[\]\"']+", "")
    for name in ("author", "journal"):
        anchor = S.literal_anchor(prose, F.col(name))
        prose = F.replace(prose, F.coalesce(anchor, F.lit("\x00")), F.lit(""))
    identity = has(F.col("author")) & has(F.col("journal"))
    return rows.withColumns({
        "identity": identity, "keyword_hits": F.size(F.filter("keywords", lambda k: has(k))),
        "narrative": identity & prose.rlike(CONTEXT), "context": F.col("quote").rlike(CONTEXT),
        "dates": prose_dates(F.col("quote")), "dois": doi_identifiers(F.col("quote")), "urls": url_identifiers(F.col("quote"))})


def formal_joins(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """Reference blocks next to their dated notices: one shared DOI, else a shared URL, else adjacency.

    Equi join on the clue set, whose quotes are few; two identities on one side,
    or two different ones, never join.
    """
    c = F.col
    cols = ["clue_id", "source_url", "quote", "dois", "urls", "dates"]
    block = quotes.filter(c("identity") & (c("keyword_hits") >= 2)).select("clue_id", "source_url", c("quote").alias("block"), c("dois").alias("bd"), c("urls").alias("bu"))
    notice = quotes.filter(c("context") & (F.size("dates") > 0)).select(*cols).select(
        "clue_id", c("quote").alias("notice"), c("dois").alias("nd"), c("urls").alias("nu"), c("dates").alias("notice_dates"))
    pairs = dealt(block, "clue_id").join(notice, "clue_id").filter("block <> notice").filter((F.size("bd") <= 1) & (F.size("nd") <= 1))
    same_doi = (F.size("bd") == 1) & (F.size("nd") == 1) & (c("bd") == c("nd"))
    clash = (F.size("bd") > 0) & (F.size("nd") > 0) & (c("bd") != c("nd"))
    no_doi = (F.size("bd") == 0) & (F.size("nd") == 0)
    shared_urls = F.array_intersect("bu", "nu")
    url_clash = no_doi & (F.size("bu") > 0) & (F.size("nu") > 0) & (F.size(shared_urls) == 0)
    common = F.when(same_doi, F.transform("bd", lambda d: F.concat(F.lit("doi:"), d))).when(no_doi, shared_urls).otherwise(F.array().cast("array<string>"))
    rows = pairs.filter(~clash & ~url_clash).withColumn("identifiers", F.array_sort(common)).join(
        dealt(documents.select(c("url").alias("source_url"), "content"), "source_url"), "source_url")
    adjacent = S.adjacent_quotes(c("block"), c("notice"), c("content"))
    return rows.withColumn("join_basis", F.when(F.size("identifiers") > 0, "shared_identifier").when(adjacent, "adjacent_spans")).filter(
        "join_basis IS NOT NULL").select("clue_id", "block", "notice", "join_basis", "identifiers", "notice_dates")


def clue_codes(clues: DataFrame, documents: DataFrame, cutoff: Column) -> DataFrame:
    """Grounding of citation clues in their source, as reason codes.

    ``clues(clue_id, source_url, quotes, author, journal, publication_date, keywords)``,
    ``documents(url, content, available_at, published_at)``.
    """
    c = F.col
    quotes = quote_rows(clues)
    day = F.to_date(F.try_to_timestamp(c("publication_date"), F.lit("yyyy-MM-dd")))
    days = dealt(clues.select("clue_id", day.alias("_day")), "clue_id")
    bound = quotes.select("clue_id", "quote", "narrative", "dates").join(days, "clue_id")
    joins = formal_joins(quotes, documents).select("clue_id", "notice_dates", "identifiers").join(days, "clue_id")
    formal = joins.groupBy("clue_id").agg(F.count(F.lit(1)).alias("_formal"), F.count_if(F.array_contains("notice_dates", c("_day"))).alias("_dated"),
                                          F.count_distinct(F.get("identifiers", F.lit(0))).alias("_ids"))
    near = month_day_present(c("quote"), c("_day")) | F.array_contains("dates", c("_day"))
    per = bound.groupBy("clue_id").agg(
        F.count_if("narrative").alias("_narrative"), F.bool_or(F.array_contains("dates", c("_day"))).alias("_quoted_day"),
        F.bool_or(names_a_day(c("quote")) | (F.size("dates") > 0)).alias("_names_day"), F.bool_or(near).alias("_near_day"))
    docs = dealt(documents.select(c("url").alias("source_url"), "content", "available_at", "published_at"), "source_url")
    rows = clues.join(docs, "source_url", "left").join(per, "clue_id", "left").join(formal, "clue_id", "left").fillna(0, ["_narrative", "_formal", "_dated", "_ids"])
    joined = word_norm(F.array_join("quotes", "\n"))
    n_author, keys = word_norm(c("author")), F.transform("keywords", word_norm)
    size_ok = lambda x, lo, hi: F.length(x).between(lo, hi)
    return rows.select("clue_id", reason_codes(
        (is_blank(c("content")), "missing_source_text"), (F.coalesce(c("available_at") > cutoff, F.lit(True)), "source_after_cutoff"),
        (~F.size("quotes").between(1, 6), "invalid_source_quotes"),
        (F.exists("quotes", lambda q: is_blank(q) | (F.length(q) > 3000) | ~F.coalesce(F.contains(c("content"), q), F.lit(False))), "quote_not_exact"),
        (F.aggregate("quotes", F.lit(0), lambda a, q: a + F.length(q)) > 6000, "source_quote_budget"),
        (~size_ok(c("author"), 3, 160) | ~size_ok(c("journal"), 3, 160) | (word_norm(c("journal")) == ""), "invalid_bibliographic_clue"),
        (F.size(F.split(n_author, " ")) < 2, "author_needs_given_and_family_name"),
        (~F.size("keywords").between(2, 6) | F.exists("keywords", lambda k: ~size_ok(k, 3, 64)), "invalid_subject_keywords"),
        (F.size(F.array_distinct(keys)) != F.size("keywords"), "duplicate_subject_keywords"),
        (F.exists(keys, lambda k: ~contains_phrase(joined, k)), "keyword_not_in_quotes"),
        ((c("_narrative") == 0) & (c("_formal") == 0), "missing_citation_context"),
        (day.isNull(), "invalid_publication_date"), (F.coalesce(day > F.to_date(cutoff), F.lit(False)), "publication_after_cutoff"),
        ((c("_narrative") == 0) & (c("_formal") > 0) & (c("_dated") == 0), "formal_date_not_bound"),
        (c("_ids") > 1, "ambiguous_formal_identifier"),
        (~F.coalesce(c("_quoted_day"), F.lit(False)) & ~F.coalesce((F.to_date("published_at") == day) & c("_near_day"), F.lit(False)), "publication_date_not_bound"),
        (F.coalesce(c("_names_day") & ~c("_near_day"), F.lit(False)), "citation_day_not_bound")).alias("reasons"))


def _topic_key(phrase: Column) -> Column:
    """The first two words of a normal phrase: a title holds the phrase only if it holds them."""
    return F.substring_index(phrase, " ", 2)


def bibliography_candidates(clues: DataFrame, works: DataFrame, cutoff: Column) -> DataFrame:
    """Works that fit a clue: journal, author, publication month, title topic, known by the cutoff.

    Equi join on journal, month, the last word of the family name, which closes the clue's author, and the first two words of a keyword,
    which stand in the title; the rest filters row by row.  A work that several keywords of a clue fit is found under the first of them.
    ``works(doi, title, journal, authors ARRAY<STRUCT<given, family>>, published, created_at, publisher_url)``.
    """
    c = F.col
    day = F.to_date(F.try_to_timestamp(c("publication_date"), F.lit("yyyy-MM-dd")))
    ask = clues.select("clue_id", word_norm(c("journal")).alias("_j"), F.trunc(day, "month").alias("_m"), word_norm(c("author")).alias("_a"),
                       F.transform("keywords", word_norm).alias("_k"), c("formal_dois").alias("_dois"))
    last = lambda name: F.substring_index(name, " ", -1)
    ask = ask.withColumn("_l", last(c("_a"))).withColumn("_key", F.explode(F.array_distinct(F.transform("_k", _topic_key))))
    families = F.array_distinct(F.transform("authors", lambda a: last(word_norm(a["family"]))))
    known = (c("created_at") <= cutoff) & (c("published") <= F.to_date(cutoff)) & c("doi").rlike(r"(?i)^10\.\d{4,9}/[^\s<>\"?#]+$")
    have = works.filter(known).select("doi", "title", "journal", "authors", "published", "publisher_url", word_norm(c("journal")).alias("_j"),
                                      F.trunc("published", "month").alias("_m"), F.split(word_norm(c("title")), " ").alias("_w"), families.alias("_f"))
    pairs = F.transform("_w", lambda w, i: F.concat_ws(" ", w, F.get("_w", i + 1)))
    have = have.withColumn("_l", F.explode("_f")).drop("_f").withColumn("_key", F.explode(F.array_distinct(F.concat("_w", pairs))))
    rows = ask.join(have, ["_j", "_m", "_l", "_key"])
    named = F.exists("authors", lambda a: author_match(c("_a"), word_norm(a["given"]), word_norm(a["family"])))
    title = F.array_join("_w", " ")
    topical = _topic_key(F.get(F.filter("_k", lambda k: contains_phrase(title, k)), F.lit(0))) == c("_key")
    doi_ok = (F.size("_dois") == 0) | F.array_contains("_dois", F.lower("doi"))
    return rows.filter(topical & doi_ok & named).select("clue_id", F.lower("doi").alias("doi"), "title", "journal", "published", "publisher_url")


PROOF_CHECKS = ["source_context_bound", "source_unchanged", "formal_identifier_matches", "archive_identity", "publisher_url",
                "page_title_matches", "identity_in_front", "topics_in_primary", "primary_body_present"]


def citation_proofs(candidates: DataFrame, documents: DataFrame, archived: DataFrame, cutoff: Column,
                    front_chars: int = FRONT_CHARS) -> DataFrame:
    """Nine named checks over source, candidate and archived target; valid is their conjunction.

    Identity must stand in the first ``front_chars`` characters, the front matter; ``beyond_front`` marks longer texts.

    ``candidates(clue_id, source_url, source_sha256, author, keywords, formal_dois, citation_quotes, doi, title, journal, publisher_url)``,
    ``archived(url, content, title, capture_at, available_at, archive_url)``.
    """
    c = F.col
    source = documents.select(c("url").alias("source_url"), c("content").alias("_source"))
    target = archived.select(F.rtrim(c("url"), F.lit("/")).alias("_key"), c("content").alias("text"), c("title").alias("page_title"),
                             "capture_at", "available_at", "archive_url", c("url").alias("target_url"))
    rows = candidates.withColumn("_key", F.rtrim(c("publisher_url"), F.lit("/"))).join(source, "source_url", "left").join(target, "_key", "left")
    front = F.left("text", F.lit(front_chars))
    stamp = capture_ts(F.regexp_extract("archive_url", ARCHIVE, 1))
    original = F.rtrim(F.regexp_extract("archive_url", ARCHIVE, 2), F.lit("/"))
    text_norm = word_norm(c("text"))
    checks = {
        "source_context_bound": F.size("citation_quotes") > 0, "source_unchanged": content_hash(c("_source")) == c("source_sha256"),
        "formal_identifier_matches": (F.size("formal_dois") == 0) | F.array_contains("formal_dois", c("doi")),
        "archive_identity": (stamp == c("capture_at")) & (c("capture_at") == c("available_at")) & (c("capture_at") <= cutoff) & (original == c("_key")),
        "publisher_url": c("target_url").isNotNull(), "page_title_matches": contains_phrase(word_norm(c("page_title")), word_norm(c("title"))),
        "identity_in_front": S.doi_anchor(front, c("doi")).isNotNull() & S.literal_anchor(front, c("title")).isNotNull()
        & S.literal_anchor(front, c("author")).isNotNull() & S.literal_anchor(front, c("journal")).isNotNull(),
        "topics_in_primary": F.size(F.filter("keywords", lambda k: contains_phrase(text_norm, word_norm(k)))) >= 2,
        "primary_body_present": c("text").rlike(BODY_HEADING)}
    out = rows.select("clue_id", "doi", F.coalesce(F.length("text") > front_chars, F.lit(False)).alias("beyond_front"),
                      *[F.coalesce(v, F.lit(False)).alias(k) for k, v in checks.items()])
    valid = F.lit(True)
    for k in PROOF_CHECKS:
        valid = valid & F.col(k)
    return out.withColumn("valid", valid)
