"""Row admission: every rejected row keeps the codes that say why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.text import content_hash, is_blank, norm_ws, record_fingerprint, sentence_passages
from ..functions.times import age_hours, aware_ts, capture_ts
from ..functions.urls import canonical_url, host_of, public_url, url_key
from .skew import split_lookup

# Closed vocabularies of the record formats.
STANCES = ["supports", "contradicts", "neutral"]
EVIDENCE_FIELDS = ["id", "url", "publisher_group", "origin_id", "published_at", "retrieved_at",
                   "content", "quote", "stance", "claim_id"]
VERDICTS = ["supported", "contradicted", "conflicting", "unresolved"]
LABELS = ["true", "false", "disputed", "unverifiable"]
GAP_STAGES = ["provenance", "verification"]
GAP_DIMENSIONS = ["auto", "provenance", "evidence", "world"]
GAP_ACTIONS = ["fetch", "search", "reanalyse"]
CLAIM_SCOPES = ["source_attribution", "real_world_provenance", "other_factual"]
RISK_LEVELS = ["high", "low"]
CAPTURE_STATUS = ["200", "301", "302", "303", "307", "308"]
RESOURCES = ["retrieval_calls", "model_tokens", "wall_seconds"]


def reason_codes(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))


def missing_fields(fields: list[str] = EVIDENCE_FIELDS) -> Column:
    return reason_codes(*[(is_blank(F.col(f)), f"missing_or_empty_{f}") for f in fields])


def validate_evidence(evidence: DataFrame, claims: DataFrame, max_age_hours: float = 72) -> DataFrame:
    """Evidence policy. ``searched_claim`` names the claim a row was returned for.

    Adds ``reasons``; a row with a missing field lists only those.  All tests
    stay row-local next to one equi join on the claim.
    """
    asked = claims.select(F.col("id").alias("searched_claim"), F.col("as_of").alias("_as_of"))
    rows = evidence.join(asked, "searched_claim", "left")
    published, retrieved, as_of = aware_ts(F.col("published_at")), aware_ts(F.col("retrieved_at")), F.col("_as_of")
    yes = lambda c: F.coalesce(c, F.lit(False))
    checks = reason_codes(
        (F.col("claim_id") != F.col("searched_claim"), "claim_id_mismatch"),
        (~F.col("stance").isin(STANCES), "invalid_stance"),
        (canonical_url(F.col("url")).isNull(), "invalid_url"),
        (published.isNull(), "invalid_published_at"),
        (retrieved.isNull(), "invalid_retrieved_at"),
        (yes(published > as_of), "future_published_at"),
        (yes(retrieved > as_of), "future_retrieved_at"),
        (yes(age_hours(as_of, published) > max_age_hours), "stale_published_at"),
        (yes(retrieved < published), "retrieved_before_published"),
        (~S.quote_in_content(F.col("quote"), F.col("content")), "quote_not_in_content"))
    missing = missing_fields()
    return rows.withColumn("reasons", F.when(F.size(missing) > 0, missing).otherwise(checks)).drop("_as_of")


def eligibility_codes(published: Column, available: Column, retrieved: Column, basis: Column, cutoff: Column) -> Column:
    """Six reason codes of a version against a cutoff; an empty array means eligible."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    unsure = available.isNotNull() & is_blank(basis)
    return reason_codes(
        (yes(published > retrieved), "published_after_retrieval"),
        (yes(published > cutoff), "published_after_as_of"),
        (available.isNull(), "version_availability_unknown"),
        (unsure, "version_availability_unsubstantiated"),
        (~unsure & yes(available > cutoff), "version_available_after_as_of"),
        (yes(available > retrieved), "available_after_retrieval"))


def with_eligibility(rows: DataFrame, cutoff: str = "as_of") -> DataFrame:
    c = F.col
    return rows.withColumn("reasons", eligibility_codes(
        c("published_at"), c("available_at"), c("retrieved_at"), c("availability_basis"), c(cutoff)))


def version_facts(materials: DataFrame) -> DataFrame:
    """What rules need to know of a version's text, taken once per version: hash, length and whether all its fields are filled.

    The text itself stays behind, so joins of targets and versions carry a few bytes per pair.
    """
    c = F.col
    filled = ~is_blank(c("version_id")) & ~is_blank(c("url")) & ~is_blank(c("issuer")) & ~is_blank(c("content")) & ~is_blank(c("availability_basis"))
    return materials.withColumns({"content_sha256": content_hash(c("content")), "content_chars": F.length("content").cast("long"),
                                  "filled": F.coalesce(filled, F.lit(False))}).drop("content")


def strictly_eligible(cutoff: Column) -> Column:
    """One boolean over rows of ``version_facts``, written independently for audits."""
    c = F.col
    filled = c("filled")
    times = (c("available_at") <= cutoff) & (c("available_at") <= c("retrieved_at"))
    published = c("published_at").isNull() | ((c("published_at") <= cutoff) & (c("published_at") <= c("retrieved_at")))
    return F.coalesce(filled & times & published, F.lit(False))


def available_by(cutoff: Column) -> Column:
    return F.coalesce(F.col("available_at") <= cutoff, F.lit(False))


def material_fingerprint(with_id: bool = True) -> Column:
    """Immutable publisher fields; the retrieval time is an observation and stays out."""
    names = ["url", "content", "issuer", "published_at", "available_at", "availability_basis"]
    return record_fingerprint(**{n: F.col(n) for n in names + (["version_id"] if with_id else [])})


def classify_arrivals(rows: DataFrame, key: str, fingerprint: str, order: str) -> DataFrame:
    """Mark each arrival as first, duplicate or collision against the first row of its id."""
    first = rows.groupBy(key).agg(
        F.min_by(fingerprint, order).alias("_fp"), F.min(order).alias("_at"), F.count(F.lit(1)).alias("_n"))
    out = split_lookup(rows, first, [key], "_n")
    kind = F.when(F.col(order) == F.col("_at"), "first").when(
        F.col(fingerprint) == F.col("_fp"), "duplicate").otherwise("collision")
    return out.withColumn("arrival", kind).drop("_fp", "_at", "_n")


def duplicate_keys(rows: DataFrame, batch: list[str], key: str) -> DataFrame:
    """Keys used more than once inside one batch."""
    return rows.groupBy(*batch, key).agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")


def owner_conflicts(findings: DataFrame, key: str, owner: str, fingerprint: str) -> DataFrame:
    """Ids that several owners define differently."""
    return findings.groupBy(key).agg(
        F.count_distinct(owner).alias("owners"), F.count_distinct(fingerprint).alias("definitions")
    ).filter("owners > 1 AND definitions > 1")


def gap_codes() -> Column:
    """Reason codes of one gap row."""
    c = F.col
    explicit = c("dimension").isin("evidence", "world") & c("blocking")
    return reason_codes(
        (is_blank(c("gap_id")), "empty_id"), (is_blank(c("question")), "empty_question"),
        (~c("stage").isin(GAP_STAGES), "invalid_stage"),
        (~c("dimension").isin(GAP_DIMENSIONS), "invalid_dimension"),
        (c("dimension").isin(GAP_DIMENSIONS) & (c("dimension") != "auto")
         & ((c("dimension") == "provenance") != (c("stage") == "provenance")), "stage_dimension_disagree"),
        (~c("action").isin(GAP_ACTIONS), "invalid_action"),
        (c("action").isin("fetch", "reanalyse") & is_blank(c("locator")), "missing_locator"),
        (c("probe_id").isNotNull() & is_blank(c("probe_id")), "empty_probe_id"),
        (explicit & is_blank(c("decision_impact")), "missing_decision_impact"),
        (explicit & (c("basis_count") == 0), "missing_basis"))


def gap_dimension(stage: Column, dimension: Column) -> Column:
    return F.when(dimension == "auto", F.when(stage == "provenance", "provenance").otherwise("world")).otherwise(dimension)


def mask_blocked(verdicts: DataFrame, gaps: DataFrame) -> DataFrame:
    """A blocking gap makes only its own dimension unresolved; other dimensions keep their verdict.

    ``verdicts`` has (target_id, dimension, verdict); gaps are active ones.
    """
    blockers = gaps.filter("blocking").select(
        "target_id", gap_dimension(F.col("stage"), F.col("dimension")).alias("dimension"), "gap_id"
    ).groupBy("target_id", "dimension").agg(F.count_distinct("gap_id").alias("blocking_gaps"))
    out = verdicts.join(blockers, ["target_id", "dimension"], "left").fillna(0, ["blocking_gaps"])
    return out.withColumn("decision", F.when(F.col("blocking_gaps") > 0, "unresolved").otherwise(F.col("verdict")))


def decision_label(verdict: Column, valid: Column) -> Column:
    """Presented label; an invalid assessment or an unchecked fact is unverifiable."""
    return (F.when(~F.coalesce(valid, F.lit(False)), "unverifiable").when(verdict == "supported", "true")
            .when(verdict == "contradicted", "false").when(verdict == "conflicting", "disputed")
            .otherwise("unverifiable"))


def usage_codes(usage: DataFrame, budget: DataFrame) -> DataFrame:
    """One row per exceeded, negative or non-integer resource of a case."""
    rows = usage.join(budget, "run")
    checks = []
    for r in RESOURCES:
        value, limit = F.col(r), F.col(f"{r}_budget")
        bad = value.isNull() | F.isnan(value.cast("double")) | (value < 0) | (value > limit)
        if r != "wall_seconds":
            bad = bad | (value.cast("double") != F.floor(value.cast("double")))
        checks.append((bad, r))
    return rows.withColumn("violations", reason_codes(*checks))


def valid_probabilities(p: Column, tolerance: float = 1e-9) -> Column:
    """A map of exactly the four labels to numbers in [0, 1] that sum to one."""
    values = F.map_values(p)
    keys = F.array_sort(F.map_keys(p)) == F.array_sort(F.array(*[F.lit(x) for x in LABELS]))
    inside = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.coalesce(keys & inside & (F.abs(total - 1) <= tolerance), F.lit(False))


def risk_codes() -> Column:
    """Invariants that keep a risk forecast from becoming a factual finding."""
    c = F.col
    return reason_codes(
        (~c("claim_scope").isin(CLAIM_SCOPES), "invalid_claim_scope"),
        (~c("fact_verdict").isin(VERDICTS), "invalid_fact_verdict"),
        (~c("fraud_risk").isin(RISK_LEVELS), "invalid_fraud_risk"),
        (c("fact_verdict").isin("supported", "contradicted") & (c("evidence_count") == 0), "settled_needs_evidence"),
        ((c("claim_scope") == "real_world_provenance") & ~c("independent_authentication")
         & ~((c("fact_verdict") == "unresolved") & (c("fraud_risk") == "high")), "unauthenticated_must_stay_open"),
        ((c("claim_scope") == "source_attribution") & (c("fact_verdict") == "supported")
         & (c("fraud_risk") != "low"), "attribution_must_be_low_risk"))


def usable_captures(captures: DataFrame, cutoff: Column) -> DataFrame:
    """Captures with a served or redirect status and a real stamp at or before the cutoff."""
    stamp = F.col("timestamp")
    return captures.filter(F.col("statuscode").isin(CAPTURE_STATUS) & stamp.rlike(r"^\d{14}$")
                           & (stamp <= F.date_format(cutoff, "yyyyMMddHHmmss")))


def replay_codes() -> Column:
    """Identity of an archived page: stamp, header time, original address, digest and size agree."""
    c = F.col
    pattern = r"^https://web\.archive\.org/web/(\d{14})(?:id_)?/(https?://.+)$"
    stamp = capture_ts(F.regexp_extract("archive_url", pattern, 1))
    original = public_url(F.regexp_extract("archive_url", pattern, 2))
    return reason_codes(
        (~c("archive_url").rlike(pattern), "non_archive_address"),
        (stamp.isNull(), "invalid_archive_timestamp"),
        (F.coalesce(stamp > c("cutoff"), F.lit(False)), "post_cutoff_capture"),
        (F.coalesce(stamp != c("header_time"), F.lit(True)), "timestamp_mismatch"),
        (~F.coalesce(original == public_url(c("final_url")), F.lit(False)), "identity_mismatch"),
        ((content_hash(c("body")) != c("sha256")) | (F.octet_length("body") != c("decoded_bytes")), "digest_mismatch"))


def publisher_fields(materials: DataFrame) -> DataFrame:
    """Fields of the publisher's version only."""
    return materials.drop("retrieved_at")


def delta_projection(pairs: DataFrame, versions: DataFrame, seen: DataFrame) -> DataFrame:
    """Full text for versions a target has not seen before; hash and length for the others.

    ``pairs(target_id, version_id)``; ``versions`` are materials with unique ids.  Pairs are parted on ids alone: hash and length are
    taken once per version and joined to seen pairs, texts are joined to unseen pairs only.
    """
    flag = seen.select("target_id", "version_id").distinct().withColumn("seen", F.lit(True))
    rows = pairs.select("target_id", "version_id").join(flag, ["target_id", "version_id"], "left").fillna(False, ["seen"])
    facts = version_facts(versions).select("version_id", "content_sha256", "content_chars")
    none = F.lit(None)
    old = rows.filter("seen").join(facts, "version_id").select(
        "target_id", "version_id", "seen", none.cast("string").alias("content"), "content_sha256", "content_chars")
    new = rows.filter("NOT seen").join(versions.select("version_id", "content"), "version_id").select(
        "target_id", "version_id", "seen", "content", none.cast("string").alias("content_sha256"), none.cast("long").alias("content_chars"))
    return old.unionByName(new)


def known_proposals(proposals: DataFrame, documents: DataFrame) -> DataFrame:
    """Proposals flagged by whether their address belongs to a fetched document."""
    known = documents.select(url_key(F.col("url")).alias("_k")).filter("_k <> ''").groupBy("_k").agg(
        F.count(F.lit(1)).alias("_n"))
    keyed = proposals.withColumn("_k", url_key(F.col("url")))
    return keyed.join(known, "_k", "left").withColumn("known", F.col("_n").isNotNull()).drop("_k", "_n")


def first_rejects(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Ineligible rows, one per key: the first by arrival."""
    bad = rows.filter(F.size("reasons") > 0)
    return bad.groupBy(key).agg(F.min_by("reasons", order).alias("reasons"), F.count(F.lit(1)).alias("rejected_rows"))


def claim_packets(targets: DataFrame, materials: DataFrame) -> DataFrame:
    """Counts that decide whether a target has exactly one eligible source version.

    ``targets`` and ``materials`` share ``pool_id``.  The inventory is counted
    and hashed in aggregate form; its rows stay a table of their own.
    """
    rows = targets.join(materials, "pool_id").filter(available_by(F.col("as_of")))
    own = F.col("version_id") == F.col("source_version_id")
    packet = rows.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("inventory"), F.count_if(own).alias("origin_versions"),
        F.max(F.when(own, F.col("version_id"))).alias("origin_version_id"))
    out = targets.select("target_id").join(packet, "target_id", "left").fillna(0, ["inventory", "origin_versions"])
    return out.withColumn("packet_ok", F.col("origin_versions") == 1)


def packet_inventory(targets: DataFrame, materials: DataFrame) -> DataFrame:
    """The rows behind ``claim_packets``: every version a target may see, and which one is its own source."""
    rows = targets.join(materials, "pool_id").filter(available_by(F.col("as_of")))
    return rows.select("target_id", "version_id", F.coalesce(F.col("version_id") == F.col("source_version_id"), F.lit(False)).alias("is_source"))


def packet_passages(targets: DataFrame, materials: DataFrame) -> DataFrame:
    """Sentence passages of the one source version of every complete packet, blanks collapsed.

    Texts are cut once per version, whatever the number of targets, and no text enters the join that decides the packets.
    """
    ok = claim_packets(targets, materials.drop("content")).filter("packet_ok").select("target_id", F.col("origin_version_id").alias("version_id"))
    texts = materials.select("version_id", "content").join(ok.select("version_id").distinct(), "version_id", "left_semi")
    cut_up = sentence_passages(texts, "version_id", "content").select("version_id", "passage_id", norm_ws(F.col("text")).alias("text"))
    return ok.join(cut_up, "version_id").select("target_id", "version_id", "passage_id", "text")


def scope_rows(cases: DataFrame, materials: DataFrame, initial: DataFrame) -> DataFrame:
    """The rows behind ``scope_packets``: eligible versions and excluded ones with their reasons, initial ones marked."""
    marked = materials.join(initial.withColumn("_first", F.lit(True)), ["pool_id", "version_id"], "left")
    return with_eligibility(cases.join(marked, "pool_id")).select(
        "case_id", "version_id", F.coalesce("_first", F.lit(False)).alias("initial"), "reasons")


def scope_packets(cases: DataFrame, materials: DataFrame, initial: DataFrame) -> DataFrame:
    """Eligible and excluded counts per case for the whole pool and for its initial versions."""
    marked = materials.join(initial.withColumn("_first", F.lit(True)), ["pool_id", "version_id"], "left")
    rows = with_eligibility(cases.join(marked, "pool_id"))
    good = F.size("reasons") == 0
    first = F.coalesce(F.col("_first"), F.lit(False))
    return rows.groupBy("case_id").agg(
        F.count_if(good).alias("pool_eligible"), F.count_if(~good).alias("pool_excluded"),
        F.count_if(good & first).alias("initial_eligible"), F.count_if(~good & first).alias("initial_excluded"))


def closure_codes(closures: DataFrame, gaps: DataFrame, receipts: DataFrame) -> DataFrame:
    """A closure names a known gap, stays in its stage and cites a return attributed to that gap."""
    known = gaps.select("target_id", "gap_id", F.col("stage").alias("_stage"),
                        gap_dimension(F.col("stage"), F.col("dimension")).alias("_dim"))
    cited = receipts.select("target_id", "gap_id", F.col("version_id").alias("basis_version")).distinct() \
        .withColumn("_cited", F.lit(True))
    rows = closures.join(known, ["target_id", "gap_id"], "left").join(cited, ["target_id", "gap_id", "basis_version"], "left")
    return rows.withColumn("reasons", reason_codes(
        (F.col("_stage").isNull(), "unknown_gap"),
        ((F.col("closed_by") == "verification") & F.col("_stage").isNotNull()
         & ~((F.col("_stage") == "verification") & F.col("_dim").isin("evidence", "world")), "verifier_closes_provenance"),
        (F.col("_cited").isNull(), "basis_not_attributed"))).drop("_stage", "_dim", "_cited")


def clean_gap_batch(new: DataFrame, active: DataFrame, prior: DataFrame, resolved: DataFrame) -> DataFrame:
    """New gaps without reserved or restated ids, plus the owner's omitted open gaps."""
    key = ["target_id", "gap_id"]
    reserved = F.col("gap_id").isin([]) | (F.col("gap_id") == F.concat(F.lit("origin:"), F.col("target_id"))) \
        | (F.col("gap_id") == F.concat(F.lit("lineage:"), F.col("target_id")))
    own = new.filter(~reserved)
    kept = own.join(active.select(*key, F.col("owner").alias("_owner")), key, "left") \
        .filter(F.col("_owner").isNull() | (F.col("_owner") == F.col("owner"))).drop("_owner")
    carried = (prior.filter(~reserved).join(active.select(*key), key, "left_semi")
               .join(resolved.select(*key), key, "left_anti").join(own.select(*key), key, "left_anti"))
    return kept.select(*key, "owner", F.lit("new").alias("kind")).unionByName(
        carried.select(*key, "owner", F.lit("carried").alias("kind")))


def admit_references(refs: DataFrame, pool: DataFrame, scope: list[str]) -> DataFrame:
    """References flagged by membership of the supplied pool; blank addresses are logged too."""
    known = pool.select(*scope, "url").distinct().withColumn("_in", F.lit(True))
    return refs.join(known, [*scope, "url"], "left").withColumn(
        "admitted", F.coalesce(F.col("_in"), F.lit(False)) & (F.col("url") != "")).drop("_in")


def _trimmed(c: Column) -> Column:
    """Without the space separators of Unicode at both ends, as SQL's trim; Spark's trim knows the ASCII blank alone."""
    return F.regexp_replace(c, r"\A\p{Zs}++|(?<!\p{Zs})\p{Zs}++\z", "")


def bounded_text(c: Column, limit: int) -> tuple[Column, Column]:
    """Trimmed text of at most ``limit`` characters and the flag that something was cut."""
    return _trimmed(F.left(c, F.lit(limit))), F.length(c) > limit


def bounded_list(c: Column, limit: int) -> tuple[Column, Column]:
    """First distinct non-blank items within ``limit`` positions and the truncation flag."""
    head = F.slice(c, 1, limit)
    return F.array_distinct(F.filter(F.transform(head, _trimmed), lambda x: x != "")), F.array_size(c) > limit


def task_codes() -> Column:
    """Validity of one proposed task against its own row context.

    Expects action, locator, basis_quote, probe_terms, lead_terms, url_visible
    and version_available on the row.
    """
    c = F.col
    absolute = c("locator").rlike(r"^https?://[^/?#]+")
    return reason_codes(
        ((c("action") == "fetch") & ~absolute, "locator_not_absolute"),
        ((c("action") == "fetch") & c("url_visible"), "visible_url_needs_reanalysis"),
        ((c("action") == "fetch") & ~F.contains(c("basis_quote"), c("locator")), "locator_not_in_basis"),
        ((c("action") == "reanalyse") & ~c("version_available"), "version_not_available"),
        ((c("action") == "search") & ~F.arrays_overlap(c("lead_terms"), c("probe_terms")), "no_grounded_term"))


def material_from_document(documents: DataFrame) -> DataFrame:
    """Fetched document to material version: availability is the capture time, issuer the host."""
    return documents.select(
        F.concat(F.lit("news-"), F.substring(F.sha2("url", 256), 1, 16)).alias("version_id"),
        "url", "content", host_of(F.col("url")).alias("issuer"), "retrieved_at", "published_at",
        F.col("retrieved_at").alias("available_at"),
        F.lit("Text captured at retrieval; publication metadata proves no earlier availability.").alias("availability_basis"))
