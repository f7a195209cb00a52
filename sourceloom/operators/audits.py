"""Audits of spans, outputs, packets, logs and dataset contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spans as S
from ..functions.let import let
from ..functions.text import content_hash, is_blank, norm_ws
from .admission import VERDICTS, reason_codes


# Keys that would reveal an answer to an inference input.
ANSWER_KEYS = ["answer", "decision", "expected", "expected_decision", "gold", "label", "truth",
               "ground_truth", "verdict", "adjudication_source_version_ids"]


def check_spans(spans: DataFrame, materials: DataFrame) -> DataFrame:
    """Each span next to its version: does it cut out exactly its quote."""
    texts = materials.select("version_id", "content")
    rows = spans.join(texts, "version_id", "left")
    return rows.withColumn("span_ok", S.span_ok(F.col("start"), F.col("end"), F.col("quote"), F.col("content"))).drop("content")


def basis_codes(findings: DataFrame, checked: DataFrame, side: str) -> DataFrame:
    """A basis has at least one span, only valid ones, and one from the named side."""
    own = findings.select("finding_id", F.col(side).alias("_side"))
    per = own.join(checked, "finding_id", "left").groupBy("finding_id").agg(
        F.count("quote").alias("spans"), F.coalesce(F.bool_and("span_ok"), F.lit(False)).alias("_all"),
        F.coalesce(F.bool_or(F.col("version_id") == F.col("_side")), F.lit(False)).alias("_own"))
    return per.select("finding_id", "spans", reason_codes(
        (F.col("spans") == 0, "empty_basis"), ((F.col("spans") > 0) & ~F.col("_all"), "invalid_span"),
        ((F.col("spans") > 0) & ~F.col("_own"), "no_span_from_side")).alias("reasons"))


def citation_audit(outputs: DataFrame, spans: DataFrame, materials: DataFrame) -> DataFrame:
    """Per output: cited, exact, unique, eligible and offset-valid spans and the overall verdict.

    ``outputs(output_id, verdict, visible_verdict, rationale)``,
    ``spans(output_id, version_id, quote, start, end)``, ``materials(version_id, content, eligible)``.
    """
    c = F.col
    rows = spans.join(materials.select("version_id", "content", "eligible"), "version_id", "left")
    first = S.first_index(c("quote"), c("content"))
    stated = c("start").isNotNull() | c("end").isNotNull()
    offsets = ~stated | F.coalesce((c("start") == first) & (c("end") == first + F.length("quote")), F.lit(False))
    flags = rows.select(
        "output_id", F.coalesce(first >= 0, F.lit(False)).alias("exact"), S.occurs_once(c("quote"), c("content")).alias("unique"),
        F.coalesce("eligible", F.lit(False)).alias("eligible"), offsets.alias("offsets"))
    per = flags.groupBy("output_id").agg(
        F.count(F.lit(1)).alias("spans"), F.count_if("exact").alias("exact"), F.count_if("unique").alias("unique"),
        F.count_if("eligible").alias("eligible"), F.count_if("offsets").alias("offsets_valid"),
        F.bool_and(c("unique") & c("eligible") & c("offsets")).alias("_all"))
    out = outputs.join(per, "output_id", "left").fillna(0, ["spans", "exact", "unique", "eligible", "offsets_valid"])
    open_both = (c("verdict") == "unresolved") & (c("visible_verdict") == "unresolved")
    passed = ~is_blank(c("rationale")) & F.when(c("spans") == 0, open_both).otherwise(c("_all"))
    return out.withColumn("passed", F.coalesce(passed, F.lit(False))).select(
        "output_id", "spans", "exact", "unique", "eligible", "offsets_valid", "passed")


def output_shape_ok(raw: Column, double_loop: Column) -> Column:
    """Strict shape of one raw JSON output: exact fields, verdict enum, span keys."""
    top = F.from_json(raw, "map<string,string>")
    base = F.array(*[F.lit(x) for x in ("basis", "rationale", "verdict")])
    loop = F.array(*[F.lit(x) for x in ("basis", "gaps", "rationale", "resolutions", "round", "verdict")])
    keys = F.array_sort(F.map_keys(top)) == F.when(double_loop, loop).otherwise(base)
    v = F.try_parse_json(raw)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    is_list = lambda path: F.startswith(kind(path), F.lit("ARRAY"))
    number = F.try_variant_get(v, "$.round", "int")
    spans = F.from_json(F.try_variant_get(v, "$.basis", "string"), "array<map<string,string>>")
    allowed = F.array(*[F.lit(x) for x in ("version_id", "quote", "start", "end")])
    needed = F.array(F.lit("version_id"), F.lit("quote"))
    span_ok = F.forall(F.coalesce(spans, F.array().cast("array<map<string,string>>")), lambda s: F.coalesce(
        (F.size(F.array_except(F.map_keys(s), allowed)) == 0) & (F.size(F.array_except(needed, F.map_keys(s))) == 0), F.lit(False)))
    loop_ok = ~double_loop | (F.startswith(kind("$.round"), F.lit("BIGINT")) & (number >= 0) & is_list("$.gaps") & is_list("$.resolutions"))
    ok = keys & F.try_variant_get(v, "$.verdict", "string").isin(VERDICTS) & is_list("$.basis") \
        & (kind("$.rationale") == "STRING") & spans.isNotNull() & span_ok & loop_ok
    return F.coalesce(ok, F.lit(False))


def conform_codes(raw: Column, schema: dict, path: str = "$") -> Column:
    """Reason codes of one raw JSON record against a closed record description.

    The description (type, properties, items, enum, minLength, maxLength,
    minItems, maxItems, minimum, maximum) is turned into Column predicates once,
    so a log of any length is one scan.  Array items are checked one level deep.
    """
    v = F.try_parse_json(raw)
    checks: list[tuple[Column, str]] = [(v.isNull(), "$:not_json")]
    _object_checks(v, raw, schema, path, checks)
    return reason_codes(*[(F.coalesce(cond, F.lit(False)), code) for cond, code in checks])


_KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def _object_checks(v: Column, raw: Column, schema: dict, path: str, checks: list) -> None:
    text = raw if path == "$" else F.try_variant_get(v, path, "string")
    keys = F.map_keys(F.from_json(text, "map<string,string>"))
    want = F.array(*[F.lit(k) for k in schema["properties"]])
    checks.append((F.size(F.array_except(want, keys)) > 0, f"{path}:missing_field"))
    checks.append((F.size(F.array_except(keys, want)) > 0, f"{path}:unknown_field"))
    for name, field in schema["properties"].items():
        at = f"{path}.{name}"
        kind = F.schema_of_variant(F.try_variant_get(v, at, "variant"))
        fits = F.startswith(kind, F.lit(_KINDS[field["type"]])) if field["type"] != "number" else kind.rlike("^(BIGINT|DOUBLE|DECIMAL)")
        checks.append((kind.isNotNull() & ~fits, f"{at}:type"))
        text = F.try_variant_get(v, at, "string")
        if "enum" in field:
            checks.append((fits & ~text.isin(field["enum"]), f"{at}:enum"))
        for bound, cond in (("minLength", lambda b: F.length(text) < b), ("maxLength", lambda b: F.length(text) > b)):
            if bound in field:
                checks.append((fits & cond(field[bound]), f"{at}:{bound}"))
        value = F.try_variant_get(v, at, "double")
        for bound, cond in (("minimum", lambda b: value < b), ("maximum", lambda b: value > b)):
            if bound in field:
                checks.append((fits & cond(field[bound]), f"{at}:{bound}"))
        if field["type"] == "array":
            items = F.from_json(text, "array<string>")
            for bound, cond in (("minItems", lambda b: F.size(items) < b), ("maxItems", lambda b: F.size(items) > b)):
                if bound in field:
                    checks.append((fits & cond(field[bound]), f"{at}:{bound}"))
            if "enum" in field.get("items", {}):
                checks.append((fits & F.exists(items, lambda x: ~x.isin(field["items"]["enum"])), f"{at}[]:enum"))
        if field["type"] == "object":
            _object_checks(v, raw, field, at, checks)


def leaked_keys(raw: Column) -> Column:
    """Forbidden answer keys at any depth of raw JSON text, distinct and sorted."""
    keys = F.transform(F.regexp_extract_all(raw, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), 1), F.lower)
    return F.array_sort(F.array_intersect(keys, F.array(*[F.lit(k) for k in ANSWER_KEYS])))


def leaked_years(raw: Column, first_forbidden: int, exempt_key: str = "retrieved_at") -> Column:
    """Four-digit years from ``first_forbidden`` on, outside the exempt field; distinct and sorted."""
    visible = F.regexp_replace(raw, rf'(?i)"{exempt_key}"\s*:\s*"(?:[^"\\]|\\.)*"', "")
    years = F.transform(F.regexp_extract_all(visible, F.lit(r"(?<!\d)(\d{4})(?!\d)"), 1), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y >= first_forbidden)))


def draft_codes(citations: DataFrame, materials: DataFrame) -> DataFrame:
    """Citation drafts: locator inside the quote, quote unique in the source, not itself, no repeat."""
    c = F.col
    texts = materials.select("version_id", "url", "content")
    uses = citations.groupBy("version_id", "locator", "kind").agg(F.count(F.lit(1)).alias("_uses"))
    rows = citations.join(texts, "version_id", "left").join(uses, ["version_id", "locator", "kind"])
    return rows.select("citation_id", reason_codes(
        (~F.contains(c("quote"), c("locator")), "locator_not_in_quote"),
        (~S.occurs_once(c("quote"), c("content")), "quote_not_unique"),
        ((c("locator") == c("url")) | (c("locator") == c("version_id")), "cites_itself"),
        (c("_uses") > 1, "duplicate_citation")).alias("reasons"))


def contained_pairs(quotes: DataFrame, documents: DataFrame, grams: int = 3) -> DataFrame:
    """Pairs (quote_id, doc_id) where the normalised quote occurs in the normalised document.

    A quote of at least ``grams + 2`` words is anchored on one run of its inner
    words, which must be whole words of any text that holds it; shorter quotes
    are anchored on their first three characters or fewer.  Only ids and anchors
    are exploded and joined; a text is fetched once per candidate.
    """
    q = quotes.select("quote_id", norm_ws(F.col("quote")).alias("q")).filter("q <> ''").withColumn("w", F.split("q", " "))
    d = documents.select("doc_id", norm_ws(F.col("text")).alias("d"))

    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (grams - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, grams), " "))

    def matches(posted: DataFrame, anchors: DataFrame) -> DataFrame:
        ids = posted.join(anchors.drop("q"), "anchor").select("quote_id", "doc_id").distinct()
        return ids.join(anchors.select("quote_id", "q"), "quote_id").join(d, "doc_id").filter(
            F.contains("d", F.col("q"))).select("quote_id", "doc_id")

    # The longest inner run is the most selective one that needs no corpus statistics.
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    longest = let(inner, lambda words: F.array_max(F.transform(runs(words), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"])
    anchored = q.filter(F.size("w") >= grams + 2).select("quote_id", "q", longest.alias("anchor"))
    posted = d.select("doc_id", F.explode(F.array_distinct(let(F.split("d", " "), runs))).alias("anchor"))
    hits = matches(posted, anchored)
    short = q.filter(F.size("w") < grams + 2)
    sizes = short.select(F.least(F.length("q"), F.lit(3)).alias("n")).distinct()
    for size in sorted(r["n"] for r in sizes.collect()):  # at most the three values 1, 2, 3
        head = short.filter(F.least(F.length("q"), F.lit(3)) == size).select("quote_id", "q", F.substring("q", 1, size).alias("anchor"))
        chars = d.filter(F.length("d") >= size).select("doc_id", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length("d") - (size - 1)), lambda i: F.col("d").substr(i, F.lit(size))))).alias("anchor"))
        hits = hits.unionByName(matches(chars, head))
    return hits.distinct()


def repeated_exposures(packets: DataFrame) -> DataFrame:
    """Versions sent in full more than once to one stage."""
    return packets.groupBy("stage", "content_hash").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def packet_exposure(packets: DataFrame, pool: DataFrame) -> DataFrame:
    """Per packet: full texts, previews, excerpts and entries that differ from the registered pool.

    ``packets(packet_id, version_id, form, text)``, form full / preview / excerpt; ``pool(version_id, content)``.
    """
    c = F.col
    rows = packets.join(pool, "version_id", "left")
    same = F.when(c("form") == "full", c("text") == c("content")).when(
        c("form") == "preview", c("text") == F.left("content", F.lit(800))).otherwise(
        F.startswith(c("content"), c("text")) & (F.length("text") > 0))
    return rows.groupBy("packet_id").agg(
        F.count_if(c("form") == "full").alias("full"), F.count_if(c("form") == "preview").alias("previews"),
        F.count_if(c("form") == "excerpt").alias("excerpts"), F.count_if(c("content").isNull()).alias("unregistered"),
        F.count_if(c("content").isNotNull() & ~same).alias("changed"),
        F.bool_and(F.coalesce(same, F.lit(False))).alias("all_registered"))


def exposure_lists(packets: DataFrame, pool: DataFrame) -> DataFrame:
    """The entries behind ``packet_exposure``, each distinct one once: full and preview ids, excerpts with place, size and hash.

    ``packets(packet_id, version_id, form, start, text)``; ``start`` counts the characters before an excerpt in its version.
    ``registered`` is false for an unknown version and for text that the pool does not hold there; null texts are not registered.
    Texts are compared once per entry and only digests go on.
    """
    c = F.col
    sent = F.when(c("form") == "full", c("content")).when(c("form") == "preview", F.left("content", F.lit(800))).otherwise(
        c("content").substr((c("start") + 1).cast("int"), F.length("text")))
    excerpt = c("form") == "excerpt"
    same = F.coalesce((c("text") == sent) & (~excerpt | (F.length("text") > 0)), F.lit(False))
    return packets.join(pool, "version_id", "left").select(
        "packet_id", "form", "version_id", F.when(excerpt, c("start")).alias("start"), F.length("text").cast("long").alias("characters"),
        F.when(excerpt, content_hash(c("text"))).alias("text_sha256"), same.alias("registered")).distinct()


def scope_coverage(targets: DataFrame, eligible: DataFrame, cited: DataFrame) -> DataFrame:
    """Scoped versions that are missing and cited versions outside the scope, per target.

    ``targets(target_id, evidence_scope ARRAY)``.
    """
    key = ["target_id", "version_id"]
    scope = targets.select("target_id", F.explode("evidence_scope").alias("version_id"))
    missing = scope.join(eligible.select(*key).distinct(), key, "left_anti").groupBy("target_id").agg(F.count(F.lit(1)).alias("missing"))
    outside = cited.select(*key).distinct().join(scope, key, "left_anti").groupBy("target_id").agg(F.count(F.lit(1)).alias("outside"))
    out = targets.select("target_id", F.size("evidence_scope").alias("scoped")).join(missing, "target_id", "left") \
        .join(outside, "target_id", "left").fillna(0, ["missing", "outside"])
    return out.withColumn("covered", (F.col("scoped") == 0) | ((F.col("missing") == 0) & (F.col("outside") == 0)))


def cached_responses(requests: DataFrame, log: DataFrame, key: list[str], order: str) -> DataFrame:
    """Pair the nth equal request with the nth logged response of the same key.

    A hot key is ranked within order buckets first, so its rows do not meet in
    one task; both sides then join on (key, ordinal).
    """
    from .state import sequence_numbers
    bucketed = lambda df: df.withColumn("_block", F.floor(F.col(order) / 100_000))
    a = sequence_numbers(bucketed(requests), key, "_block", [F.col(order)])
    b = sequence_numbers(bucketed(log), key, "_block", [F.col(order)]).select(*key, "sequence", "response_id")
    return a.join(b, [*key, "sequence"], "left").drop("_block").withColumn("cached", F.col("response_id").isNotNull())


def call_binding(calls: DataFrame, lineage: DataFrame) -> DataFrame:
    """Trace lineage against the call log: sequence, response id and output digest agree."""
    key = ["trace_id", "sequence"]
    a = calls.select(*key, F.col("response_id").alias("_r"), content_hash(F.col("output")).alias("_d"))
    b = lineage.select(*key, F.col("response_id").alias("_lr"), F.col("output_sha256").alias("_ld"))
    problem = (F.when(F.col("_lr").isNull(), "missing_in_trace").when(F.col("_r").isNull(), "missing_in_log")
               .when(F.col("_r") != F.col("_lr"), "response_differs").when(F.col("_d") != F.col("_ld"), "digest_differs"))
    return a.join(b, key, "full_outer").select(*key, problem.alias("problem")).filter("problem IS NOT NULL")


def dataset_contract(inputs: DataFrame, sources: DataFrame, gold: DataFrame, cutoff: Column) -> DataFrame:
    """Violations between inputs, source metadata and gold, one row per (case, version, code).

    ``inputs(case_id, version_id, url, content, published_at, available_at)``,
    ``sources(case_id, event_id, version_id, role, source_url, content_sha256, observed_at, deadline)``,
    ``gold(case_id, event_id, version_id, quote)``.
    """
    c = F.col
    key = ["case_id", "version_id"]
    i = inputs.withColumn("_in", F.lit(True))
    s = sources.withColumn("_src", F.lit(True))
    both = i.join(s, key, "full_outer")
    claim_at = both.groupBy("case_id").agg(
        F.max(F.when(c("role") == "claim", c("available_at"))).alias("_claim_available"),
        F.count_if(c("role") == "claim").alias("_claims"), F.count_if(c("role") == "outcome").alias("_outcomes"))
    rows = both.join(claim_at, "case_id")
    outcome = c("role") == "outcome"
    pairs = [(c("_src").isNull(), "no_source_metadata"), (c("_in").isNull(), "no_input_material"),
             (c("source_url") != c("url"), "url_mismatch"), (content_hash(c("content")) != c("content_sha256"), "content_mismatch"),
             (c("observed_at") != c("available_at"), "proof_time_mismatch"),
             ((c("published_at") > cutoff) | (c("available_at") > cutoff), "after_cutoff"),
             (outcome & ~(c("_claim_available") < c("published_at")), "outcome_not_after_claim"),
             (outcome & ((c("published_at") > c("deadline")) | (c("available_at") > c("deadline"))), "after_deadline"),
             (c("_claims") != 1, "not_one_claim"), (c("_outcomes") == 0, "no_outcome")]
    material = rows.select(*key, F.explode(reason_codes(*[(F.coalesce(p, F.lit(False)), n) for p, n in pairs])).alias("code"))
    g = gold.join(sources.select(*key, "role", c("event_id").alias("_event")), key, "left").join(inputs.select(*key, "content"), key, "left")
    gold_rows = g.select(*key, F.explode(reason_codes(
        (F.coalesce(c("role") != "outcome", F.lit(True)), "gold_cites_non_outcome"),
        (F.coalesce(c("_event") != c("event_id"), F.lit(False)), "gold_event_mismatch"),
        (~S.occurs_once(c("quote"), c("content")), "gold_quote_not_unique"))).alias("code"))
    uncovered = sources.filter("role = 'outcome'").select(*key).join(gold.select(*key), key, "left_anti").withColumn("code", F.lit("outcome_not_in_gold"))
    return material.unionByName(gold_rows).unionByName(uncovered)


def corpus_contract(cases: DataFrame, materials: DataFrame, files: DataFrame, quotes: DataFrame) -> DataFrame:
    """Corpus rules: eligible materials, known start, text equals its file, gold quotes unique, withheld quotes absent.

    ``quotes(case_id, version_id, quote, withheld)``; materials carry ``reasons``.
    """
    key = ["case_id", "version_id"]
    bad = materials.filter(F.size("reasons") > 0).select(*key, F.lit("ineligible_material").alias("code"))
    start = cases.select("case_id", F.col("source_version_id").alias("version_id")).join(materials.select(*key), key, "left_anti") \
        .withColumn("code", F.lit("start_not_in_pool"))
    text = materials.join(files.select("version_id", "file_sha256"), "version_id", "left").filter(
        F.coalesce(content_hash(F.col("content")) != F.col("file_sha256"), F.lit(True))).select(*key, F.lit("text_differs_from_file").alias("code"))
    q = quotes.join(materials.select(*key, "content"), key, "left")
    once = S.occurs_once(F.col("quote"), F.col("content"))
    present = F.coalesce(F.contains("content", F.col("quote")), F.lit(False))
    marks = q.select(*key, F.when(~F.col("withheld") & ~once, "gold_quote_not_unique").when(
        F.col("withheld") & present, "withheld_quote_present").alias("code")).filter("code IS NOT NULL")
    return bad.unionByName(start).unionByName(text).unionByName(marks)


def registration_contract(registered: DataFrame, actual: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """Schedule equality by position: rows whose fields differ or exist on one side only."""
    a = registered.select(order, F.struct(*fields).alias("_a"))
    b = actual.select(order, F.struct(*fields).alias("_b"))
    return a.join(b, order, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        order, F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("differs").alias("problem"))


def superset_packets(base: Column, wider: Column) -> Column:
    """The wider packet starts with exactly the base packet's items."""
    return F.slice(wider, 1, F.greatest(F.size(base), F.lit(1))) == base


def trace_invariants(history: DataFrame, operations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Violations of incremental mode per trace.

    One accepted analysis per version, no accepted revisit, no revisit
    operation, no alias admitted.
    """
    c = F.col
    accepted = history.filter("accepted")
    twice = accepted.groupBy("trace_id", "version_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("repeated_versions"))
    revisits = accepted.groupBy("trace_id").agg(F.count_if(c("revisit") | c("duplicate")).alias("accepted_revisits"), F.count(F.lit(1)).alias("accepted"))
    ops = operations.groupBy("trace_id").agg(F.count_if(c("action").isin("upstream_arrival_reanalysis", "revisit_requested")).alias("revisit_operations"))
    forged = aliases.select("trace_id", "version_id").distinct().join(accepted.select("trace_id", "version_id").distinct(), ["trace_id", "version_id"], "left_semi") \
        .groupBy("trace_id").agg(F.count(F.lit(1)).alias("admitted_aliases"))
    names = ["repeated_versions", "accepted_revisits", "revisit_operations", "admitted_aliases"]
    out = revisits.join(twice, "trace_id", "left").join(ops, "trace_id", "left").join(forged, "trace_id", "left").fillna(0, names)
    clean = c(names[0]) + c(names[1]) + c(names[2]) + c(names[3]) == 0
    return out.select("trace_id", "accepted", *names, clean.alias("clean"))


def merged_spans(spans: DataFrame, contents: DataFrame, max_gap: int) -> DataFrame:
    """Adjacent spans of one version joined across short whitespace; text is cut from the source.

    Gaps and islands over the spans of one version of one finding.
    """
    c = F.col
    rows = spans.select("finding_id", "version_id", "start", "end").distinct().join(contents.select("version_id", "content"), "version_id")
    w = W.partitionBy("finding_id", "version_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_reach", reach)
    gap = c("content").substr(c("_reach") + 1, c("start") - c("_reach"))
    joins = (c("start") <= c("_reach")) | ((c("start") - c("_reach") <= max_gap) & ~gap.rlike(r"(?U)[^\s\x1c-\x1f]"))
    rows = rows.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy("finding_id", "version_id", "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.any_value("content").alias("content"))
    return out.select("finding_id", "version_id", "start", "end", c("content").substr(c("start") + 1, c("end") - c("start")).alias("quote"))


def fold_verdicts(contradicted: Column, conflicting: Column, all_supported: Column) -> Column:
    return F.when(contradicted, "contradicted").when(conflicting, "conflicting").when(all_supported, "supported").otherwise("unresolved")


def target_verdicts(probes: DataFrame) -> DataFrame:
    """Probe verdicts to one verdict per target."""
    v = F.col("verdict")
    return probes.groupBy("target_id").agg(F.count(F.lit(1)).alias("probes"), fold_verdicts(
        F.bool_or(v == "contradicted"), F.bool_or(v == "conflicting"), F.bool_and(v == "supported")).alias("verdict"))


def probe_verdicts(checks: DataFrame) -> DataFrame:
    """Dimension verdicts to one verdict per probe, gated on actor, scope and predicate."""
    v, d = F.col("verdict"), F.col("dimension")
    at = lambda name: F.max(F.when(d == name, v))
    per = checks.groupBy("probe_id").agg(
        at("actor_subject").alias("actor"), at("scope_location").alias("scope"), at("predicate_object").alias("predicate"),
        F.bool_or(v == "contradicted").alias("any_contra"), F.bool_or(v == "conflicting").alias("any_conf"), F.bool_and(v == "supported").alias("all_sup"))
    c = F.col
    gate = F.coalesce((c("actor") == "supported") & (c("scope") == "supported") & c("predicate").isin("supported", "contradicted", "conflicting"), F.lit(False))
    verdict = (F.when(~gate, "unresolved").when(c("predicate") == "contradicted", "contradicted").when(c("predicate") == "conflicting", "conflicting")
               .otherwise(fold_verdicts(c("any_contra"), c("any_conf"), c("all_sup"))))
    return per.select("probe_id", verdict.alias("verdict"))


def source_pool(rows: DataFrame) -> DataFrame:
    """Sources merged by address: first non-empty field in arrival order, originals or-ed, conflicts and facts counted.

    Rows without an address stay on their own.  ``rows(position, url, outlet, publish_time, source_type, is_original, fact)``.
    """
    c = F.col
    fields = ["outlet", "publish_time", "source_type"]
    keyed = rows.withColumn("_key", F.when(c("url") == "", F.concat(F.lit("row:"), c("position"))).otherwise(F.concat(F.lit("url:"), c("url"))))
    filled = lambda f: F.when(c(f) != "", c(f))
    firsts = [F.coalesce(F.min_by(filled(f), F.when(c(f) != "", c("position"))), F.lit("")).alias(f) for f in fields]
    variants = [F.count_distinct(filled(f)).alias(f"_n_{f}") for f in fields]
    out = keyed.groupBy("_key").agg(
        F.max("url").alias("url"), F.min("position").alias("position"), *firsts, *variants, F.bool_or("is_original").alias("is_original"),
        F.count_distinct(F.when(c("fact") != "", c("fact"))).alias("facts"), F.count(F.lit(1)).alias("rows"))
    conflicts = sum((F.greatest(c(f"_n_{f}") - 1, F.lit(0)) for f in fields), F.lit(0))
    return out.withColumn("conflicting_values", conflicts.cast("long")).drop("_key", *[f"_n_{f}" for f in fields])


def source_conflicts(rows: DataFrame) -> DataFrame:
    """Values of a merged source that differ from the first one of their field: (url, field, first, additional)."""
    fields = ["outlet", "publish_time", "source_type"]
    cells = rows.filter("url <> ''").select("url", "position", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("c")).select("url", "position", "c.*").filter("value <> ''")
    first = cells.groupBy("url", "field").agg(F.min_by("value", "position").alias("first"), F.count_distinct("value").alias("_n")).filter("_n > 1")
    return cells.join(first, ["url", "field"]).filter("value <> first").select("url", "field", "first", F.col("value").alias("additional")).distinct()


def credibility(pool: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts of sources, types, agreeing and disputed facts, and grounded tree nodes."""
    a = pool.agg(F.count(F.lit(1)).alias("source_count"), F.count_distinct(F.when(F.col("source_type") != "", F.col("source_type"))).alias("source_types"))
    b = facts.agg(F.count_if(F.col("agreement") == "consistent").alias("consistent"), F.count_if(F.col("agreement") == "disputed").alias("disputed"))
    n = nodes.filter("depth > 0").agg(F.count(F.lit(1)).alias("causal_nodes"), F.count_if("grounded").alias("grounded"))
    return a.join(F.broadcast(b)).join(F.broadcast(n))


def timeline_rows(events: DataFrame, refs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Timeline events with admitted distinct sources counted; the proposed count is kept apart."""
    from .admission import admit_references
    marked = admit_references(refs, allowed, [])
    per = marked.groupBy("event_id").agg(F.count_distinct(F.when(F.col("admitted"), F.col("url"))).alias("unique_sources"),
                                         F.count_if(~F.col("admitted") & (F.col("url") != "")).alias("rejected_refs"))
    return events.join(per, "event_id", "left").fillna(0, ["unique_sources", "rejected_refs"])


def label_census(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("cases"))


def batch_conflicts(reopened: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps that one batch both reopens and resolves."""
    return reopened.select(*keys).distinct().join(resolved.select(*keys).distinct(), keys, "left_semi")


SPAN = T.StructType([T.StructField("version_id", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType()), T.StructField("quote", T.StringType())])
