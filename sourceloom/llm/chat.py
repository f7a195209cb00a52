"""Chat formatting: render turns, parse the rendered text again, escape what does not come back.

Grammar::

    conversation := turn*
    turn         := "<|im_start|>" role ["<|esc|>"] LF text "<|im_end|>" LF

A turn is rendered plainly first.  If the parser does not return exactly its role and text, it is rendered once more with
its role and text escaped and the header marked ``<|esc|>``.  Escaping writes a backslash in front of every backslash,
splits ``<|`` into ``<\\|`` and writes line breaks of a role as ``\\n``, so no control string is left and the original is
read back exactly.  Everything is a Column expression; one shuffle brings the turns of a conversation together.

Defined cases: null role or text is the empty string; a null turn number sorts first and ties sort by role, then text;
repeated turns are kept; rows with a null conversation id form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.let import let

START, END, ESCAPED = "<|im_start|>", "<|im_end|>", "<|esc|>"
END_LINE = END + "\n"


def _literal(text: str) -> str:
    return rf"\Q{text}\E"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    """Inverse of ``escape``: doubled backslashes are taken from the left, single ones belong to a mark."""
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\|"), F.lit("|"))), "\\")


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(
        F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))), "\\")


def _render(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        return F.concat(F.lit(START), _escape_role(role), F.lit(ESCAPED + "\n"), escape(text), F.lit(END_LINE))
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END_LINE))


def _turn(piece: Column) -> Column:
    """One parsed turn of the text between two start marks; ``ok`` is false where it breaks the grammar."""
    def parts(p: Column) -> Column:
        header = F.substring_index(p, "\n", 1)
        marked = header.endswith(ESCAPED)
        name = F.when(marked, F.substring(header, F.lit(1), F.length(header) - len(ESCAPED))).otherwise(header)
        body_len = F.length(p) - F.length(header) - 1 - len(END_LINE)
        body = F.substring(p, F.length(header) + 2, body_len)
        ok = p.endswith(END_LINE) & (body_len >= 0) & ~body.contains(END) & ~name.contains(ESCAPED)
        return F.struct(name.alias("name"), body.alias("body"), marked.alias("marked"), F.coalesce(ok, F.lit(False)).alias("ok"))

    return let(let(piece, parts), lambda t: F.struct(
        F.when(t["marked"], _unescape_role(t["name"])).otherwise(t["name"]).alias("role"),
        F.when(t["marked"], unescape(t["body"])).otherwise(t["body"]).alias("text"),
        t["ok"].alias("ok"), t["body"].alias("body"), F.length(t["name"]).alias("name_chars"), t["marked"].alias("marked")))


def pieces(formatted: Column) -> Column:
    """The rendered turns without their start marks."""
    cut = F.split(formatted, _literal(START), -1)
    return F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))


def parse(formatted: Column) -> Column:
    """Array of turns (role, text, ok, ...) read back from rendered text."""
    return F.transform(pieces(formatted), _turn)


def _returns(rendered: Column, role: Column, text: Column) -> Column:
    """True where the parser gives exactly this one turn back."""
    return let(parse(rendered), lambda ts: (F.size(ts) == 1) & F.get(ts, F.lit(0))["ok"]
               & (F.get(ts, F.lit(0))["role"] == role) & (F.get(ts, F.lit(0))["text"] == text))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, round_trip_ok.

    ``spans`` has for every turn the code-point offsets of the turn and of its text in ``formatted`` (ends exclusive) and
    ``loss``: whether the text counts in training.  ``round_trip_ok`` compares each parsed turn with its source.
    """
    source = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                          F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = _render(F.col("role"), F.col("text"), False)
    rendered = source.withColumn("plain", plain).withColumn("rendered", F.when(
        _returns(F.col("plain"), F.col("role"), F.col("text")), F.col("plain")).otherwise(
        _render(F.col("role"), F.col("text"), True))).drop("plain")
    checked = rendered.withColumn("ok", _returns(F.col("rendered"), F.col("role"), F.col("text")))
    before = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    chars = F.length("rendered").cast("long")
    placed = checked.select(
        "conv_id", "turn", "role", "rendered", "ok", chars.alias("chars"),
        F.coalesce(F.sum(chars).over(before), F.lit(0)).alias("start"),
        (F.length(F.substring_index("rendered", "\n", 1)) + 1).cast("long").alias("head"))
    one = F.struct("start", (F.col("start") + F.col("head")).alias("text_start"),
                   (F.col("start") + F.col("chars") - len(END_LINE)).alias("text_end"),
                   (F.col("start") + F.col("chars")).alias("end"), (F.col("role") == learn_from).alias("loss"), "rendered", "ok")
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    return grouped.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["start"], x["text_start"], x["text_end"], x["end"], x["loss"])).alias("spans"),
        F.forall("t", lambda x: x["ok"]).alias("round_trip_ok"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_texts, from ``formatted`` and ``spans`` alone.

    A loss text is cut out of its rendered turn at the span's place and unescaped if the turn's header says so.
    """
    both = formatted.select("conv_id", "formatted", "spans", "round_trip_ok", pieces(F.col("formatted")).alias("p"))
    parsed = both.withColumn("parsed", F.transform("p", _turn))

    def under_mask(piece: Column, i: Column) -> Column:
        span, t = F.get(F.col("spans"), i), F.get(F.col("parsed"), i)
        cut = F.substring(piece, (span["text_start"] - span["start"] - len(START) + 1).cast("int"),
                          (span["text_end"] - span["text_start"]).cast("int"))
        return F.when(span["loss"], F.when(t["marked"], unescape(cut)).otherwise(cut)).otherwise("")

    return parsed.select(
        "conv_id", "formatted", "round_trip_ok", F.transform("parsed", lambda t: F.struct(t["role"], t["text"])).alias("turns"),
        F.transform("p", under_mask).alias("loss_texts"))
