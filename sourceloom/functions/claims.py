"""Column helpers for claim text: probes' dimensions, time, quantity and comparison markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let


def _starting(firsts: str, pattern: str) -> str:
    """``pattern``, tried only at words that begin with one of ``firsts``, at signs beyond ASCII and at a year before 年.

    The look ahead drops no match: no alternative of the patterns below starts anywhere else.  It spares the
    alternatives at all other places, which is most of a text.
    """
    return rf"(?=[{firsts}[^\x00-\x7F]])(?:\b|(?=[^\x00-\x7F]|\d{{4}}年))(?:{pattern})"


# The patterns that decide whether a text carries a signal, and the first characters of their words.
TIME_FIRSTS = r"abdfijmnoqstuwy\d"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
WEEKDAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
YEAR = r"(?:19|20)\d{2}"
QUARTER = (rf"(?:(?:first|second|third|fourth|1st|2nd|3rd|4th)\s+quarter(?:\s+of)?\s+{YEAR}"
           rf"|q[1-4]\s+{YEAR})")
YEAR_PERIOD = rf"(?:in|during|by|through|throughout)\s+{YEAR}"
CLOCK = (r"\b\d{4}[-/]\d{1,2}(?:[-/]\d{1,2})?\b|\b\d{1,2}:\d{2}(?:\s*[ap]m)?\b|\b\d{1,2}\s*[ap]m\b")
CJK_DATE = r"\d{4}年(?:\d{1,2}月(?:\d{1,2}日)?)?"
TIME_SIGNAL = _starting(TIME_FIRSTS, rf"\b(?:before|after|until|since|today|tomorrow|yesterday|as of|{WEEKDAYS}|{MONTHS}|"
                        rf"{QUARTER}|{YEAR_PERIOD})\b|{CLOCK}|截至|之前|之后|直到|今天|明天|昨日|周[一二三四五六日天]|{CJK_DATE}")
TEMPORAL_VALUE = _starting(TIME_FIRSTS, rf"\b(?:{QUARTER}|{YEAR_PERIOD})\b|\b(?:{MONTHS})(?:\s+\d{{1,2}}(?:,?\s+\d{{4}})?|\s+{YEAR})\b|"
                           rf"{CLOCK}|{CJK_DATE}")
QUANTITY_SIGNAL = r"[\d%％$€£¥￥]|(?=p)\bpercent\b|百分之"
DIMENSION_SIGNALS = {
    "negation": _starting("nw", r"\b(?:not|no|never|without|neither)\b|未|没有|并非|不得|无"),
    "condition": _starting("iupw", r"\b(?:if|unless|provided that|when)\b|如果|若|除非"),
    "modality": _starting("mcspea", r"\b(?:may|might|could|must|should|planned|expected|alleged)\b|可能|必须|应当|计划|预计|据称"),
    "comparison_baseline": _starting("mltvcid", r"\b(?:more|less|than|versus|compared|increase|decrease)\b|相比|高于|低于|增加|减少"),
    "attribution_causality": _starting("asrbc", r"\b(?:according to|said|reported|because|caused by)\b|据|表示|报道|因为|导致"),
}
RELATION_WORDS = rf"(?=[abdfjmnostuwy])\b(?:before|after|until|since|today|tomorrow|yesterday|{WEEKDAYS}|{MONTHS})\b"
CJK_TIMES = rf"(?=[^\x00-\x7F]|\d{{4}}年)(?:截至|之前|之后|直到|今天|明天|昨日|周[一二三四五六日天]|{CJK_DATE})"
QUARTER_WORDS = r"(?=[fst1-4])\b(first|second|third|fourth|1st|2nd|3rd|4th)\s+quarter\b"
QUARTER_SHORT = r"(?=q)\bq([1-4])\b"
NUMBER = r"(?<![A-Za-z])[-+]?\d[\d,]*(?:\.\d+)?"
PERCENT = r"[%％]|(?=p)\bpercent(?:age)?\b|百分之"
DENOMINATOR = r"\bper\s+[a-z]+|/\s*[a-z]+|\beach\s+[a-z]+"
COMPARISONS = [  # pattern, direction, inclusive; the first that occurs decides
    (r"(?=[an])\b(?:approximately|about|around|nearly|almost)\b", "hedged", False),
    (r"(?=[aun])\b(?:at\s+most|up\s+to|no\s+more\s+than)\b", "less", True),
    (r"(?=[an])\b(?:at\s+least|no\s+less\s+than)\b", "greater", True),
    (r"(?=[moag])\b(?:more\s+than|over|above|greater\s+than)\b", "greater", False),
    (r"(?=[lubf])\b(?:less\s+than|under|below|fewer\s+than)\b", "less", False)]
CORE_DIMENSIONS = ["actor_subject", "predicate_object", "scope_location"]
UNITS = ("thousand|million|billion|trillion|kg|kilogram|kilograms|gram|grams|lb|lbs|pound|pounds|ounce|ounces|"
         "km|kilometer|kilometers|meter|meters|centimeter|centimeters|mile|miles|inch|inches|foot|feet|liter|"
         "liters|gallon|gallons|watt|watts|kilowatt|kilowatts|volt|volts|amp|amps|hour|hours|day|days|people|"
         "persons|users|shares|votes")
UNIT_WORDS = rf"(?=[abcdfghiklmopstuvw])\b(?:{UNITS})\b"
CURRENCIES = {"$": "usd", "usd": "usd", "dollar": "usd", "€": "eur", "eur": "eur", "euro": "eur",
              "£": "gbp", "gbp": "gbp", "pound": "gbp", "¥": "yen-yuan", "￥": "yen-yuan",
              "yuan": "yen-yuan", "yen": "yen-yuan"}
CURRENCY_SIGNAL = "(?=[$€£¥￥udegpy])(?:[$€£¥￥]|usd|dollar|eur|gbp|pound|yuan|yen)"
CLOCK_LIKE = r"\d(?:[-/:]|\s*[ap]m)"
# Words that settle a kind of signal in an ASCII text, and words without any of which (or of those) a pattern of the kind finds nothing.
SETTLING = {
    "time": ["before", "after", "until", "since", "today", "tomorrow", "yesterday", *MONTHS.split("|"), *WEEKDAYS.split("|")],
    "negation": ["not", "no", "never", "without", "neither"], "condition": ["if", "unless", "when"],
    "modality": ["may", "might", "could", "must", "should", "planned", "expected", "alleged"],
    "comparison_baseline": ["more", "less", "than", "versus", "compared", "increase", "decrease"],
    "attribution_causality": ["said", "reported", "because"]}
HINTING = {
    "time": "as in during by through throughout quarter q1 q2 q3 q4".split(), "quarter": "quarter q1 q2 q3 q4".split(),
    "condition": ["provided"], "attribution_causality": ["according", "caused"],
    "limit": "approximately about around nearly almost most up more least less over above greater under below fewer".split(),
    "unit": UNITS.split("|"), "percent": ["percent", "percentage"], "per": ["per", "each"]}
AUXILIARIES = ["is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did",
               "will", "would", "can", "could", "may", "might", "must", "should"]
IRREGULAR = ("arose|ate|became|began|broke|brought|built|bought|burst|came|caught|chose|cost|cut|did|drew|drove|"
             "fell|felt|found|gave|got|grew|had|heard|held|hit|hurt|kept|knew|led|left|let|lost|made|meant|met|"
             "paid|put|ran|read|said|saw|sent|set|shut|sold|spoke|spread|stood|taught|thought|told|took|"
             "understood|went|won|wrote")
PREDICATE = rf"\b(?:{'|'.join(AUXILIARIES)}|{IRREGULAR}|[a-z]{{3,}}(?:ed|ing|s))\b"
TAIL_IGNORED = ["not", "never", "before", "after", "until", "since", "today", "tomorrow",
                "yesterday", "than", "with", "from"]
ARTICLES = ["the", "a", "an"]
CONTENT_IGNORED = [
    "the", "and", "that", "this", "with", "from", "before", "after", "until", "since", "today", "tomorrow",
    "yesterday", "well", "also", "for", "into", "onto", "over", "under", "between", "during", "about", "will",
    "would", "can", "could", "may", "might", "must", "should", "has", "have", "had", "was", "were", "are",
    "does", "did", "not"]

_I = "(?i)"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


class Kinds:
    """Kinds of signals by the words of a text, from its ``Kinds.bits``; without them, every pattern is searched.

    One look at the words spares most texts most patterns: a settling word is a match, and without a hinting one there is none.
    """

    FLAGS = [*(("settled", k) for k in SETTLING), *(("hinted", k) for k in HINTING), ("beyond ASCII", "")]

    def __init__(self, bits: Column | None = None):
        self._bits = bits

    @staticmethod
    def bits(c: Column) -> Column:
        """Settled and hinted kinds of a text; one beyond ASCII has all hints and nothing settled."""
        words = [*SETTLING.values(), *HINTING.values()]
        known = F.filter(_all(F.lower(c), r"\w+"), lambda w: w.isin(sorted({w for some in words for w in some})))

        def seen(bits, word):
            for k, some in enumerate(words):
                bits = bits.bitwiseOR(F.when(word.isin(some), F.lit(1 << k)).otherwise(F.lit(0)))
            return bits
        hints = sum(1 << k for k, (how, _) in enumerate(Kinds.FLAGS) if how != "settled")
        return F.when(F.octet_length(c) != F.length(c), F.lit(hints)).otherwise(F.aggregate(known, F.lit(0), seen))

    def _flag(self, how: str, kind: str) -> Column:
        return self._bits.bitwiseAND(F.lit(1 << self.FLAGS.index((how, kind)))) != 0

    def hinted(self, kind: str) -> Column:
        return F.lit(True) if self._bits is None else self._flag("hinted", kind)

    def told(self, kind: str, searched: Column) -> Column:
        """``searched``, the search for a pattern of the kind, only where the words leave it open."""
        if self._bits is None:
            return searched
        left_open = self._flag("hinted", kind) if kind in HINTING else self._flag("beyond ASCII", "")
        return self._flag("settled", kind) | (left_open & searched)


ANY_KIND = Kinds()


def tells_time(c: Column, kinds: Kinds = ANY_KIND) -> Column:
    """Whether a text carries a time signal."""
    signal = c.rlike(_I + TIME_SIGNAL)
    return kinds.told("time", signal) | (F.lower(c).rlike(CLOCK_LIKE) & signal)


def required_dimensions(c: Column, kinds: Kinds = ANY_KIND, timed: Column | None = None) -> Column:
    """Dimensions a probe must have settled: three core ones plus those its text signals; ``timed`` is ``tells_time``."""
    timed = tells_time(c, kinds) if timed is None else timed
    bare = F.when(timed, F.regexp_replace(c, _I + TEMPORAL_VALUE, "")).otherwise(c)
    flags = [F.lit(d) for d in CORE_DIMENSIONS]
    flags.append(F.when(bare.rlike(_I + QUANTITY_SIGNAL), F.lit("quantity_unit_denominator")))
    flags.append(F.when(timed, F.lit("time")))
    flags += [F.when(kinds.told(d, c.rlike(_I + p)), F.lit(d)) for d, p in DIMENSION_SIGNALS.items()]
    return F.array_compact(F.array(*flags))


def word_forms(token: Column) -> Column:
    """The token plus its stems under the endings ing, ed, es and s."""
    return let(F.lower(token), low_forms)


def low_forms(t: Column) -> Column:
    """``word_forms`` of a token in lower case; most have no ending to take off."""
    ends = F.endswith(t, F.lit("s")) | F.endswith(t, F.lit("ed")) | F.endswith(t, F.lit("ing"))
    return F.when(ends, _forms(t)).otherwise(F.array(t))


def _forms(t: Column) -> Column:
    n = F.length(t)
    cut = lambda k: t.substr(F.lit(1), n - k)
    none = F.array().cast("array<string>")
    ing = F.when(F.endswith(t, F.lit("ing")) & (n > 5), F.array(cut(3), F.concat(cut(3), F.lit("e")))).otherwise(none)
    ed = F.when(F.endswith(t, F.lit("ed")) & (n > 4), F.array(cut(2), F.concat(cut(2), F.lit("e")))).otherwise(none)
    plural = (F.when(F.endswith(t, F.lit("es")) & (n > 4), F.array(cut(2), F.concat(cut(2), F.lit("e")), cut(1)))
              .when(F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("es")) & (n > 3), F.array(cut(1)))
              .when(F.endswith(t, F.lit("es")) & (n == 4), F.array(cut(1))).otherwise(none))
    return F.array_distinct(F.concat(F.array(t), ing, ed, plural))


def content_tokens(c: Column) -> Column:
    return F.filter(_all(F.lower(c), "[a-z]{3,}"), lambda t: ~t.isin(CONTENT_IGNORED))


def without_time(c: Column) -> Column:
    """Blank recognised time expressions together with a preceding linker word."""
    linker = r"(?:\b(?:in|during|by|through|throughout|on|at)\s+(?:the\s+)?)?"
    return F.regexp_replace(c, _I + _starting(TIME_FIRSTS, rf"{linker}(?:{TEMPORAL_VALUE}|{TIME_SIGNAL})"), " ")


def claim_tokens(c: Column) -> Column:
    """Surface tokens in order, time expressions and articles left out."""
    return bare_tokens(without_time(c))


def bare_tokens(bare: Column) -> Column:
    """``claim_tokens`` of a text that went through ``without_time``."""
    words = _all(F.lower(bare), "[a-z]+")
    for article in ARTICLES:
        words = F.array_remove(words, article)
    return words


def ordered_match(target: Column, basis: Column) -> Column:
    """Every target token finds a word-form match in the basis, in the same order."""
    return ordered_forms(F.transform(target, word_forms), F.transform(basis, word_forms))


def ordered_forms(target: Column, basis: Column) -> Column:
    """``ordered_match`` over arrays that already hold each token's forms; a token that is nowhere in the basis decides first."""
    def step(cursor, forms):
        hits = F.transform(basis, lambda b, i: (i >= cursor) & F.arrays_overlap(forms, b))
        found = let(F.array_position(hits, True), lambda h: F.when(h > 0, h.cast("int")).otherwise(F.lit(-1)))
        return F.when(cursor < 0, cursor).otherwise(found)
    held = let(F.flatten(basis), lambda flat: F.forall(target, lambda forms: F.arrays_overlap(forms, flat)))
    return F.when(held, F.aggregate(target, F.lit(0), step) >= 0).otherwise(F.lit(False))


def temporal_markers(c: Column, kinds: Kinds = ANY_KIND, timed: Column | None = None) -> Column:
    """Distinct time markers: relation words, calendar values, years and quarters; a text that tells no time (``timed``) and no quarter has none."""
    low, signal = F.lower(c), tells_time(c, kinds) if timed is None else timed
    held = signal | (kinds.hinted("quarter") & low.rlike(f"{QUARTER_WORDS}|{QUARTER_SHORT}"))
    return F.when(held, _time_markers(c, low, signal)).when(c.isNotNull(), _no_strings())


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _time_markers(c: Column, low: Column, signal: Column) -> Column:
    words = _all(low, RELATION_WORDS)
    values = F.filter(F.transform(F.filter(_all(low, TEMPORAL_VALUE), lambda v: ~v.rlike(rf"^(?:{QUARTER}|{YEAR_PERIOD})$")),
                                  lambda v: F.regexp_replace(v, r"(?U)\W+", "")), lambda v: v != "")
    cjk = _all(c, CJK_TIMES)
    years = F.when(signal, F.transform(
        _all(low, rf"\b({YEAR})\b", 1), lambda y: F.concat(F.lit("year:"), y))).otherwise(_no_strings())
    named = F.transform(_all(low, QUARTER_WORDS, 1),
                        lambda q: F.concat(F.lit("quarter:"), F.when(q.isin("first", "1st"), "1").when(
                            q.isin("second", "2nd"), "2").when(q.isin("third", "3rd"), "3").otherwise("4")))
    short = F.transform(_all(low, QUARTER_SHORT, 1), lambda q: F.concat(F.lit("quarter:"), q))
    months = F.transform(_all(low, rf"\b({MONTHS})\b", 1), lambda m: F.concat(
        F.lit("quarter:"), F.when(m.isin("january", "february", "march"), "1").when(
            m.isin("april", "may", "june"), "2").when(m.isin("july", "august", "september"), "3").otherwise("4")))
    return F.array_distinct(F.concat(words, values, cjk, years, named, short, months))


def numeric_values(c: Column) -> Column:
    """Numbers in order of appearance; thousands separators dropped, time text blanked."""
    return bare_numbers(without_time(c))


def bare_numbers(bare: Column) -> Column:
    """``numeric_values`` of a text that went through ``without_time``."""
    values = F.transform(_all(bare, NUMBER), lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double"))
    return F.filter(values, lambda v: v.isNotNull())


def quantity_markers(c: Column, kinds: Kinds = ANY_KIND) -> Column:
    """Distinct number, currency, unit and denominator markers."""
    low = F.lower(c)
    only = lambda held, markers: F.when(held, markers).otherwise(_no_strings())
    numbers = F.transform(_all(low, r"\d+(?:\.\d+)?"), lambda t: F.concat(F.lit("number:"), t))
    money = only(low.rlike(CURRENCY_SIGNAL), F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit("currency:" + v))
                                                                      for k, v in CURRENCIES.items()])))
    percent = only((kinds.hinted("percent") | F.contains(low, F.lit("%"))) & low.rlike(PERCENT), F.array(F.lit("unit:percent")))
    units = only(kinds.hinted("unit"), F.transform(_all(low, UNIT_WORDS),
                                                   lambda u: F.concat(F.lit("unit:"), F.regexp_replace(u, "s+$", ""))))
    per = only(kinds.hinted("per") | F.contains(low, F.lit("/")), F.transform(_all(low, DENOMINATOR), lambda d: F.concat(
        F.lit("denominator:"), F.regexp_replace(F.regexp_extract(d, "([a-z]+)$", 1), "s+$", ""))))
    return F.array_distinct(F.concat(numbers, money, percent, units, per))


def comparison_constraint(c: Column, kinds: Kinds = ANY_KIND) -> Column:
    """Struct (direction, inclusive): greater, less or hedged; null when none is stated."""
    low = F.lower(c)
    return F.when(kinds.hinted("limit"), F.coalesce(*[F.when(low.rlike(pattern), F.struct(F.lit(direction).alias("direction"), F.lit(inclusive).alias("inclusive")))
                                                      for pattern, direction, inclusive in COMPARISONS]))


def comparison_decision(want: Column, seen: Column, limits: Column, values: Column, want_units: Column, seen_units: Column) -> Column:
    """``supported``, ``contradicted`` or ``undecided`` for a threshold claim, from extracted columns.

    Decided only when each side holds exactly one number and equal units.
    """
    limit, value = F.get(limits, F.lit(0)), F.get(values, F.lit(0))
    usable = (want.isNotNull() & (want["direction"] != "hedged") & (F.size(limits) == 1) & (F.size(values) == 1)
              & (want_units == seen_units) & F.coalesce(seen["direction"] != "hedged", F.lit(True)))
    up = want["direction"] == "greater"
    beyond = F.when(up, value > limit).otherwise(value < limit)
    reaches = F.when(up, value >= limit).otherwise(value <= limit)
    same_way = seen["direction"] == want["direction"]
    stated = (F.when(same_way & F.when(seen["inclusive"], beyond).otherwise(reaches), F.lit("supported"))
              .when(~same_way & F.when(up, value <= limit).otherwise(value >= limit), F.lit("contradicted")))
    plain = F.when(beyond, F.lit("supported")).otherwise(F.lit("contradicted"))
    return F.coalesce(F.when(usable, F.when(seen.isNull(), plain).otherwise(stated)), F.lit("undecided"))


def unit_markers(quantity: Column) -> Column:
    return F.array_sort(F.filter(quantity, lambda m: ~F.startswith(m, F.lit("number:"))))


def comparison_outcome(probe: Column, basis: Column) -> Column:
    """The comparison decision straight from two texts."""
    side = lambda c: F.struct(comparison_constraint(c).alias("c"), numeric_values(c).alias("n"), unit_markers(quantity_markers(c)).alias("u"))
    return let(F.struct(side(probe).alias("p"), side(basis).alias("b")), lambda s: comparison_decision(
        s["p"]["c"], s["b"]["c"], s["p"]["n"], s["b"]["n"], s["p"]["u"], s["b"]["u"]))


def predicate_markers(c: Column) -> Column:
    """Stems of the claim's verb; for auxiliaries, stems of the content words after it."""
    verb = F.lower(F.regexp_extract(c, _I + "(" + PREDICATE + ")", 1))
    tail = _all(F.lower(F.regexp_extract(c, rf"(?is){PREDICATE}(.*)$", 1)), "[a-z]{3,}")
    stems = F.array_distinct(F.flatten(F.transform(F.filter(tail, lambda t: ~t.isin(TAIL_IGNORED)), low_forms)))
    return let(verb, lambda v: F.when(v == "", _no_strings()).when(~v.isin(AUXILIARIES), low_forms(v)).otherwise(
        let(stems, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(v)))))


def _kind(markers: Column, kind: str) -> Column:
    return F.filter(markers, lambda m: F.startswith(m, F.lit(kind)))


def time_clash(p: Column, b: Column) -> Column:
    """Years or quarters are both stated and share nothing, or the relation words clash; on marker arrays."""
    apart = lambda kind: ((F.size(_kind(p, kind)) > 0) & (F.size(_kind(b, kind)) > 0)
                          & (F.size(F.array_intersect(_kind(p, kind), _kind(b, kind))) == 0))
    directions = F.array(*[F.lit(x) for x in ("before", "after", "until", "since")])
    shared = F.size(F.array_intersect(F.array_except(p, directions), F.array_except(b, directions))) > 0
    has = F.array_contains
    clash = ((has(p, "before") & (has(b, "after") | has(b, "until")))
             | (has(p, "after") & has(b, "before")) | (has(p, "until") & has(b, "after")))
    return apart("year:") | apart("quarter:") | (shared & clash)


def time_contradiction(probe: Column, basis: Column) -> Column:
    """Explicit time contradiction between a text and a passage; a heading line of the passage is no evidence."""
    return let(F.struct(temporal_markers(probe).alias("p"), temporal_markers(below_heading(basis)).alias("b")), lambda s: time_clash(s["p"], s["b"]))


def below_heading(c: Column) -> Column:
    """What follows the first line break, or the whole text without one."""
    return F.regexp_replace(c, r"\A[^\n]*\n", "")


def author_match(clue_norm: Column, given_norm: Column, family_norm: Column) -> Column:
    """Family name closes the clue and the given name agrees in full or by initial."""
    parts, family, given = (F.split(c, " ") for c in (clue_norm, family_norm, given_norm))
    tail = F.slice(parts, F.greatest(F.size(parts) - F.size(family) + 1, F.lit(1)), F.size(family))
    first, own = F.get(parts, F.lit(0)), F.get(given, F.lit(0))
    initial = lambda a, b: (F.length(a) == 1) & (a == F.substring(b, 1, 1))
    ok = ((family_norm != "") & (given_norm != "") & (F.size(parts) > F.size(family)) & (tail == family)
          & ((first == own) | initial(first, own) | initial(own, first)))
    return F.coalesce(ok, F.lit(False))
