"""Operator 4 [native]: chat formatting by a finite-state machine over roles.

A declarative template names each role's opening and closing control string,
whether its text is trained on, which roles may follow it, and where a
conversation may start and end. The role of the turn before is the machine's
state; a turn that its state doesn't admit is marked, not dropped, and the
machine goes on from it. Turns become text segments with a loss flag each;
control strings inside a text are escaped by one more backslash behind their
first character, which ``unescape`` takes away again, so whatever a text holds
can be read back.

Only DataFrame functions are used. Segments come from one window over
(conversation, turn), which sorts and may spill; only ``formatted`` gathers a
conversation, whose text it has to return in one value.

Defined results: null texts and roles read as empty; turns with equal numbers are
ordered by role, then text (null turns first); repeated rows are turns of their
own; rows with a null conversation id form one conversation; a role the template
doesn't know gets control strings that carry its name in hex, no loss, and is
never admitted; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEMPLATE = {
    "begin": "<s>",
    "roles": {
        "system": {"open": "[SYS]", "close": "[/SYS]", "loss": False, "next": ["user"]},
        "user": {"open": "[INST]", "close": "[/INST]", "loss": False, "next": ["assistant"]},
        "assistant": {"open": "[OUT]", "close": "</s>", "loss": True, "next": ["user"]},
    },
    "start": ["system", "user"],
    "end": ["assistant"],
}
_OTHER = r"ROLE:[0-9A-F]*\]|/ROLE\]"


def _tails(template) -> str:
    """Pattern of what follows a control string's first character."""
    marks = [template["begin"]] + [m for r in template["roles"].values() for m in (r["open"], r["close"])]
    for m in marks:
        if m[0] not in "[<" or any(c in m[1:] for c in "[<\\"):
            raise ValueError(f"a control string begins with [ or < and has neither, nor a backslash, further on: {m}")
    return "|".join([*("\\Q" + m[1:] + "\\E" for m in dict.fromkeys(marks)), _OTHER])


def escape(text: Column, template=TEMPLATE) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)(" + _tails(template) + ")", r"$1$2\\$3")


def unescape(text: Column, template=TEMPLATE) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)(" + _tails(template) + ")", r"$1$2$3")


def _by_role(role: Column, known: dict, other: Column) -> Column:
    out = other
    for name, value in known.items():
        out = F.when(role == F.lit(name), F.lit(value)).otherwise(out)
    return out


def segments(conversations: DataFrame, template=TEMPLATE) -> DataFrame:
    """``(conv_id, place, part, text, loss, admitted, role)``: a conversation's segments in the order (place, part).

    ``place`` counts turns from 1; part 0 is the beginning of the conversation,
    then a turn's opening string, text and closing string.
    """
    roles = template["roles"]
    turns = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    state = F.lag("role").over(w)
    turns = turns.select("*", F.row_number().over(w).cast("long").alias("place"), state.alias("state"),
                         F.lead("role").over(w).isNull().alias("last"))
    allowed = F.when(F.col("state").isNull(), F.col("role").isin(template["start"]))
    for name, r in roles.items():
        allowed = allowed.when(F.col("state") == F.lit(name), F.col("role").isin(r["next"]))
    admitted = allowed.otherwise(F.col("role").isin(list(roles))) & (~F.col("last") | F.col("role").isin(template["end"]))
    hexed = F.hex(F.col("role").cast("binary"))
    begin = F.concat(_by_role(F.col("role"), {n: r["open"] for n, r in roles.items()},
                              F.concat(F.lit("[ROLE:"), hexed, F.lit("]"))), F.lit(" "))
    close = F.concat(F.lit(" "), _by_role(F.col("role"), {n: r["close"] for n, r in roles.items()}, F.lit("[/ROLE]")))
    loss = _by_role(F.col("role"), {n: r["loss"] for n, r in roles.items()}, F.lit(False))
    no = F.lit(False)

    def part(i, text, flag):
        return F.struct(F.lit(i).alias("part"), text.alias("text"), flag.alias("loss"))

    parts = F.concat(
        F.when(F.col("place") == 1, F.array(part(0, F.lit(template["begin"]), no))).otherwise(
            F.array().cast("array<struct<part:int,text:string,loss:boolean>>")),
        F.array(part(1, begin, no), part(2, escape(F.col("text"), template), loss), part(3, close, no)))
    return turns.select("conv_id", "place", "role", admitted.alias("admitted"), F.explode(parts).alias("s")) \
        .select("conv_id", "place", F.col("s.part").alias("part"), F.col("s.text").alias("text"),
                F.col("s.loss").alias("loss"), "admitted", "role")


def formatted(conversations: DataFrame, template=TEMPLATE) -> DataFrame:
    """``(conv_id, segments, text, valid)``: per conversation its segments ``(text, loss)`` in order and their text."""
    got = segments(conversations, template).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "part", "text", "loss"))).alias("s"),
        F.bool_and("admitted").alias("valid"))
    return got.select("conv_id", F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["loss"].alias("loss")))
                      .alias("segments"), "valid") \
        .select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("text"), "valid")


def turns_read_back(text: Column, template=TEMPLATE) -> Column:
    """Array of ``(role, text)`` parsed from a formatted conversation alone."""
    roles = template["roles"]
    opens = "|".join("\\Q" + r["open"] + "\\E" for r in roles.values())
    closes = "|".join("\\Q" + c + "\\E" for c in dict.fromkeys(r["close"] for r in roles.values()))
    turn = r"(?s)(" + opens + r"|\[ROLE:[0-9A-F]*\]) (.*?) (?:" + closes + r"|\[/ROLE\])"
    mark = lambda x: F.regexp_extract(x, turn, 1)
    other = lambda x: F.unhex(F.regexp_extract(x, r"^\[ROLE:([0-9A-F]*)\]", 1)).cast("string")

    def role(x):
        out = other(x)
        for name, r in roles.items():
            out = F.when(mark(x) == F.lit(r["open"]), F.lit(name)).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(text, F.lit(turn), F.lit(0)), lambda x: F.struct(
        role(x).alias("role"), unescape(F.regexp_extract(x, turn, 2), template).alias("text")))


PLANTED = "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') " \
    "AS t(conv_id, turn, role, text)"


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7, read back from the formatted output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text") \
        .unionByName(spark.sql(PLANTED))
    out = formatted(rows)
    back = out.select("conv_id", "valid", F.length("text").cast("long").alias("formatted_chars"),
                      turns_read_back(F.col("text")).alias("turns"),
                      F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])).alias("loss"))
    whole = F.array_join(F.flatten(F.transform("turns", lambda t: F.array(
        t["role"], F.lit("\n"), t["text"], F.lit("\n")))), "")
    loss = F.array_join("loss", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
                       "formatted_chars", "valid")


# The digests read the texts themselves; the format's own length and validity follow from the template.
_ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER w AS place, lag(role) OVER w AS state, lead(role) OVER w IS NULL AS last,
        text || repeat('x', len(regexp_extract_all(text,
          '[\[<]\\*(s>|SYS\]|/SYS\]|INST\]|/INST\]|OUT\]|/s>|ROLE:[0-9A-F]*\]|/ROLE\])'))) AS escaped
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(escaped) + 2 + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
    ELSE 14 + 2 * strlen(role) END) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN state IS NULL THEN role IN ('system', 'user') WHEN state = 'system' THEN role = 'user'
    WHEN state = 'user' THEN role = 'assistant' WHEN state = 'assistant' THEN role = 'user'
    ELSE role IN ('system', 'user', 'assistant') END AND (NOT last OR role = 'assistant')) AS valid
FROM t GROUP BY conv_id
"""
QUERIES = {"op4_chat_format": op4_chat_format}
ORACLES = {"op4_chat_format": _ORACLE}
