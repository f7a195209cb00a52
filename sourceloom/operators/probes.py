"""Claims to probes, and grounding of probe dimensions in passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import claims as C
from ..functions.text import evidence_terms, is_blank

# Separators, and the words and marks that keep a compound whole.
_SENTENCE = r"[;；。!?！？]+|(?<!\d)\.(?!\d)"
_CLAUSE = r"(?i)\s+(?:and|as well as)\s+|并且|且"
_CONDITION = r"(?i)\b(?:if|unless|provided that|when)\b|如果|若|除非"
_HAN = r"[㐀-䶿一-鿿]{2,}"
_REPORTS_THAT = (r"(?i)\b(?:allege[ds]?|say|says|said|report(?:s|ed)?|claim(?:s|ed)?|state[ds]?|announce[ds]?|believe[ds]?|"
                 r"expect(?:s|ed)?)\s+that\b")
_LEADING_SCOPE = (r"(?i)^(?:\s*(?:in|at|on|near|within|outside|across|under|over|before|after|according\s+to)\b|\s*(?:在|于|截至|据))")
_SHARED_DIMENSIONS = ["time", "negation", "modality", "comparison_baseline"]


def has_predicate(c):
    return c.rlike(r"(?i)" + C.PREDICATE) | c.rlike(_HAN)


def _pieces(text, pattern):
    """Pieces between separators with their offsets, outer whitespace and commas trimmed.

    A separator run is kept behind a marker, so the original length of every
    piece is known and offsets are exact.
    """
    marked = F.split(F.regexp_replace(text, f"({pattern})", "\x01$1\x02"), "\x01")
    cells = F.transform(marked, lambda m: F.struct(
        F.when(F.contains(m, F.lit("\x02")), F.regexp_extract(m, "(?s)^(.*?)\x02", 1)).otherwise(F.lit("")).alias("sep"),
        F.regexp_replace(m, "(?s)^.*?\x02", "").alias("body")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(acc, cell):
        start = acc["at"] + F.length(cell["sep"])
        lead = F.length(cell["body"]) - F.length(F.regexp_replace(cell["body"], r"(?U)^[\s,，]+", ""))
        body = F.regexp_replace(F.regexp_replace(cell["body"], r"(?U)^[\s,，]+", ""), r"(?U)[\s,，]+$", "")
        row = F.struct((start + lead).cast("int").alias("start"), body.alias("text"))
        return F.struct((start + F.length(cell["body"])).cast("int").alias("at"),
                        F.when(body == "", acc["out"]).otherwise(F.array_append(acc["out"], row)).alias("out"))

    return F.aggregate(cells, zero, step, lambda acc: acc["out"])


def _spans(text, pattern):
    return F.transform(_pieces(text, pattern), lambda p: F.struct(
        p["start"].alias("start"), (p["start"] + F.length(p["text"])).cast("int").alias("end")))


def _cut(text, span):
    return text.substr(span["start"] + 1, span["end"] - span["start"])


def _merge_fragments(text, spans):
    """Extend a span without a predicate over the next one; trailing ones extend the last span that has one."""
    span = "struct<start:int,end:int>"
    zero = F.struct(F.array().cast(f"array<{span}>").alias("out"), F.lit(None).cast("int").alias("pending"))

    def step(acc, p):
        merged = F.struct(F.coalesce(acc["pending"], p["start"]).alias("start"), p["end"].alias("end"))
        body = _cut(text, merged)
        alone = ~has_predicate(body) | body.rlike(r"(?:^|[.\s])[A-Za-z]$")
        return F.struct(F.when(alone, acc["out"]).otherwise(F.array_append(acc["out"], merged)).alias("out"),
                        F.when(alone, merged["start"]).alias("pending"))

    def close(acc):
        end = F.element_at(spans, -1)["end"]
        last = F.element_at(acc["out"], -1)
        longer = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))
        return F.when(acc["pending"].isNull(), acc["out"]).when(F.size(acc["out"]) > 0, longer).otherwise(
            F.array(F.struct(acc["pending"].alias("start"), end.alias("end"))))

    return F.aggregate(spans, zero, step, close)


def _shares_scope(chunk, parts):
    """Whether splitting a compound could detach a reporting verb, a leading phrase, a comma phrase or a shared dimension."""
    before = F.regexp_extract(chunk, "(?is)^(.*?)(?:" + _CLAUSE.removeprefix("(?i)") + ")", 1)
    wanted = F.array_intersect(C.required_dimensions(chunk), F.array(*[F.lit(d) for d in _SHARED_DIMENSIONS]))
    return (before.rlike(_REPORTS_THAT) | chunk.rlike(_LEADING_SCOPE) | before.rlike("[,，]")
            | F.exists(parts, lambda p: F.size(F.array_except(wanted, C.required_dimensions(_cut(chunk, p)))) > 0))


def _has_subject(body):
    return ~body.rlike("[A-Za-z]") | F.regexp_extract(body, rf"(?is)^(.*?)(?={C.PREDICATE})", 1).rlike("[A-Za-z]")


def _clause_like(body):
    words = F.regexp_extract_all(body, F.lit("[A-Za-z]+"), 0)
    han = F.size(F.regexp_extract_all(body, F.lit("[㐀-䶿一-鿿]"), 0))
    return F.when(F.size(words) >= 2, F.element_at(words, -1).rlike("^[a-z]{3,}$")).otherwise(han >= 4)


def probe_rows(claims: DataFrame, max_probes: int | None = None) -> DataFrame:
    """Claims to independently checkable probes, rejects among them: (claim_id, start, end, text, over_limit, probe_id, reason).

    A rejected claim is one row with a reason and no probe; every text is read once.  A probe's text is a slice of its claim.  A sentence without a predicate joins
    the next one, a trailing one the sentence before.  A conditional sentence and
    a compound that shares a scope stay whole; another compound is split when
    every part has a subject and a predicate, and its claim is a reject when the
    parts only look like clauses.  Probes of claims with more than ``max_probes``
    are kept and marked ``over_limit``.
    """
    text = F.col("text")
    base = claims.filter(~is_blank(text)).select("claim_id", "text", _spans(text, _SENTENCE).alias("_s"))
    rows = base.select("claim_id", "text", F.posexplode(
        F.when(F.size("_s") <= 1, F.col("_s")).otherwise(_merge_fragments(text, F.col("_s")))).alias("s", "sentence"))  # one span has nothing to join
    rows = rows.withColumn("chunk", _cut(text, F.col("sentence")))
    chunk, parts = F.col("chunk"), F.col("parts")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(chunk).alias("end")))
    rows = rows.withColumn("parts", F.when(chunk.rlike(_CONDITION) | ~chunk.rlike(_CLAUSE), whole).otherwise(_spans(chunk, _CLAUSE)))
    many = F.size(parts) > 1
    rows = rows.withColumn("shared", F.when(many, _shares_scope(chunk, parts)).otherwise(F.lit(False)))
    complete = F.forall(parts, lambda p: has_predicate(_cut(chunk, p)) & _has_subject(_cut(chunk, p)))
    rows = rows.withColumn("split", many & ~F.col("shared") & complete)
    rows = rows.withColumn("ambiguous", many & ~F.col("shared") & ~F.col("split") & F.forall(parts, lambda p: _clause_like(_cut(chunk, p))))
    spans = rows.select("claim_id", "text", "ambiguous", F.col("sentence.start").alias("_at"),
                        F.explode(F.when(F.col("split"), parts).otherwise(whole)).alias("part")).select(
        "claim_id", "ambiguous", (F.col("_at") + F.col("part.start")).alias("start"), (F.col("_at") + F.col("part.end")).alias("end"), "text")
    body = F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    claim = W.partitionBy("claim_id")
    found = spans.withColumn("text", body).select(
        "claim_id", "start", "end", "text", F.count(F.lit(1)).over(claim).alias("_n"), F.bool_or("ambiguous").over(claim).alias("_bad"),
        F.row_number().over(claim.orderBy("start", "end")).alias("_k"))
    good = lambda c: F.when(~F.col("_bad"), c)
    return found.filter(F.when(F.col("_bad"), F.col("_k") == 1).otherwise(F.col("claim_id").isNotNull())).select(
        "claim_id", good(F.col("start")).alias("start"), good(F.col("end")).alias("end"), good(F.col("text")).alias("text"),
        good(F.col("_n") > max_probes if max_probes else F.lit(False)).alias("over_limit"),
        good(F.concat(F.col("claim_id").cast("string"), F.lit(":probe:"), F.substring(
            F.sha2(F.concat_ws("|", "claim_id", "start", "text"), 256), 1, 20))).alias("probe_id"),
        F.when(F.col("_bad"), "ambiguous_compound").alias("reason"))


def claim_probes(claims: DataFrame, max_probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``probe_rows`` as (probes, rejects); a plan that reads both cuts every claim twice."""
    rows = probe_rows(claims, max_probes)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL").select("claim_id", "reason")


# What counts as a signal in a passage beside the signals of a probe.
MORE_SIGNALS = {
    "quantity_unit_denominator": C.QUANTITY_SIGNAL, "time": r"\b(?:19|20)\d{2}\b", "modality": r"(?=[ioc])\b(?:implemented|occurred|confirmed)\b",
    "comparison_baseline": r"\d|(?=[hl])\b(?:higher|lower)\b", "attribution_causality": r"(?=s)\b(?:source|statement)\b"}
SIGNALS = ["quantity_unit_denominator", "time", "modality", "comparison_baseline", "attribution_causality", "negation", "condition"]


NEGATION = "(?i)" + C.DIMENSION_SIGNALS["negation"]


def text_marks(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Everything the pair rules need, extracted once per text instead of once per pair; ``<prefix>kinds`` and ``<prefix>timed`` spare searches."""
    x, c = F.col(text), lambda name: F.col(f"{prefix}{name}")
    kinds = C.Kinds(c("kinds"))
    # what several marks are made from is a column of its own, which is evaluated once
    base = df.withColumn(f"{prefix}kinds", C.Kinds.bits(x)).withColumn(f"{prefix}timed", C.tells_time(x, kinds)).withColumns({
        f"{prefix}time": C.temporal_markers(x, kinds, c("timed")), f"{prefix}quantity": C.quantity_markers(x, kinds),
        f"{prefix}bare": F.when(c("timed"), C.without_time(x)).otherwise(x)})
    return base.withColumns({
        f"{prefix}terms": evidence_terms(x),
        f"{prefix}event_time": F.when(F.contains(x, F.lit("\n")), C.temporal_markers(C.below_heading(x))).otherwise(c("time")),
        f"{prefix}units": C.unit_markers(c("quantity")), f"{prefix}numbers": C.bare_numbers(c("bare")), f"{prefix}compare": C.comparison_constraint(x, kinds),
        f"{prefix}line": F.concat(F.lit(" "), F.array_join(C.bare_tokens(c("bare")), " "), F.lit(" ")),
        f"{prefix}tokens": F.transform(C.bare_tokens(c("bare")), C.low_forms),
        f"{prefix}negated": kinds.told("negation", x.rlike(NEGATION))}).drop(f"{prefix}bare")


def _signals(x, kinds: C.Kinds, timed):
    """The dimensions a passage has signals of, by ``SIGNALS``."""
    told = lambda k: (timed if k == "time" else kinds.told(k, x.rlike("(?i)" + C.DIMENSION_SIGNALS[k])) if k in C.DIMENSION_SIGNALS else F.lit(False))
    more = lambda k: x.rlike("(?i)" + MORE_SIGNALS[k]) if k in MORE_SIGNALS else F.lit(False)
    return F.array_compact(F.array(*[F.when(told(k) | more(k), F.lit(k)) for k in SIGNALS]))


def _in_order():
    """Whether the words of the probe's line stand in the passage's in their order, in any of their forms.

    The whole line in the passage is in order; a word without an ending that no stem of the passage equals is not; the rest is walked.
    """
    forms = lambda line: F.transform(F.array_remove(F.split(line, " "), ""), C.low_forms)
    plain = F.regexp_extract_all("p_line", F.lit("(?<= )[a-z]{2,}[a-cefh-rt-z](?= )"), 0)
    return plain, F.when(F.contains("b_line", "p_line"), True).when(F.size(F.array_except("p_plain", "stems")) > 0, False).otherwise(
        C.ordered_forms(forms(F.col("p_line")), forms(F.col("b_line"))))


def grounding(probes: DataFrame, passages: DataFrame, scope: list[str]) -> DataFrame:
    """Which passages carry a probe's dimensions, as supported or contradicted flags.

    Markers are extracted per text first.  Probes then meet the passages of their
    scope, one shuffle of each side, and pairs without a shared grounding term are
    dropped where they meet: pairs are judged on terms, word order, time, quantity
    and comparison as they arise, and never shuffled.
    """
    c = F.col
    plain, order = _in_order()
    stems = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.lower("basis"), F.lit("[a-z]{3,}"), 0), C.low_forms)))
    p = text_marks(probes.filter("probe_id IS NOT NULL").select(*scope, "probe_id", c("text").alias("probe")), "probe", "p_").withColumns({
        "verb": C.predicate_markers(c("probe")), "dimensions": C.required_dimensions(c("probe"), C.Kinds(c("p_kinds")), c("p_timed")),
        "p_plain": plain}).drop("probe", "p_kinds", "p_timed")
    b = text_marks(passages.filter("passage_id IS NOT NULL").select(*scope, "passage_id", c("text").alias("basis")), "basis", "b_").withColumns({
        "stems": stems, "signals": _signals(c("basis"), C.Kinds(c("b_kinds")), c("b_timed"))}).drop("basis", "b_kinds", "b_timed")
    # coalesce: a null filter derived from the overlap would extract every term twice; merge: marks are far larger than their estimate
    rows = p.hint("merge").join(b, scope).filter(F.coalesce(F.arrays_overlap("p_terms", "b_terms"), F.lit(False)))
    negated = c("b_negated") & ~c("p_negated")
    compares = F.coalesce(c("p_compare")["direction"] != "hedged", F.lit(False))
    rows = rows.withColumn("order", order).withColumns({
        "clash": F.when(
            (F.size("p_time") > 0) & (F.size("b_event_time") > 0), C.time_clash(c("p_time"), c("b_event_time"))).otherwise(F.lit(False)),
        "outcome": C.comparison_decision(c("p_compare"), c("b_compare"), c("p_numbers"), c("b_numbers"), c("p_units"), c("b_units")),
        "negation_added": negated, "verb_ok": c("order") & ((F.size("verb") == 0) | F.arrays_overlap("verb", "stems")),
        "time_held": (F.size("p_time") == 0) | (F.size(F.array_except("p_time", "b_time")) == 0), "compares": compares,
        "quantity_held": ~compares & (F.size(F.array_except("p_quantity", "b_quantity")) == 0),
        "numbers_apart": ~compares & (F.size("p_numbers") > 0) & (F.size("b_numbers") > 0) & ~F.arrays_overlap("p_numbers", "b_numbers")})
    # outer: every probe has dimensions, and a filter derived from a plain explode would find them twice
    rows = rows.select(*scope, "probe_id", "passage_id", F.explode_outer("dimensions").alias("dimension"), "signals", "order", "clash", "outcome",
                       "negation_added", "verb_ok", "time_held", "quantity_held", "numbers_apart", "compares")
    d = c("dimension")
    signal = d.isin(C.CORE_DIMENSIONS) | F.array_contains("signals", d)
    supported = (F.when(d.isin("actor_subject", "scope_location"), c("order")).when(d == "predicate_object", c("verb_ok") & ~c("negation_added"))
                 .when(d == "time", c("time_held") & ~c("clash"))
                 .when(d == "quantity_unit_denominator", F.when(c("compares"), c("outcome") == "supported").otherwise(c("quantity_held")))
                 .when(d == "comparison_baseline", c("outcome") == "supported").otherwise(F.lit(True)))
    contradicted = (F.when(d == "predicate_object", c("negation_added") & c("order")).when(d == "time", c("clash"))
                    .when(d == "quantity_unit_denominator", F.when(c("compares"), c("outcome") == "contradicted").otherwise(c("numbers_apart")))
                    .when(d == "comparison_baseline", c("outcome") == "contradicted").otherwise(F.lit(False)))
    return rows.select(*scope, "probe_id", "passage_id", "dimension", (signal & supported).alias("supported"), (signal & contradicted).alias("contradicted"))
