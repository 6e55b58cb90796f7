"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A conversation becomes one text, a turn after the other:

    turn    := "### " label ": " body " </turn>\\n"
    label   := "System" | "User" | "Assistant" | "=" role, in which a backslash stands before each of \\ : # <
    body    := text without a bare control string

`### ` and `</turn>` are the control strings; one that no backslash precedes is bare. The parser is deterministic:
it cuts at the ends of turns, takes the label up to the first colon that no backslash hides, refuses a body with a bare
control string, and takes one backslash from each run of them that stands before a control string.

Each turn is rendered as it is and parsed again. Where the parser does not give back the source, the text's conflicting
places, which are its control strings with the backslashes before them, get one more backslash, and the turn is parsed
again; the first form that comes back identical stands. Turns end in a string that overlaps with no part of itself,
so conversations parse as their turns do; each is parsed as a whole too, and a difference is an error.

All of that is done row by row before the one shuffle, by conversation. A conversation is one row of the
output, so its whole text has to fit into a row (2 GB); Spark gathers it from parts that each task has put together.

Defined results: a null role or text is empty; rows follow each other by turn (null first), rows of one turn by
their rendered form, repeated rows each count; rows with a null conv_id are one conversation; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles with a label of their own; others are spelled out.
LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
_RUN = r"(?<!\\)(\\*+(?:### |</turn>))"
_ESCAPED = r"(?<!\\)\\(\\*+(?:### |</turn>))"
_BARE = r"(?<!\\)(?:### |</turn>)"
_HEAD = r"(?s)^### ((?:[^:\\]|\\.)*+): "


def escape(text: Column) -> Column:
    """text with one more backslash before each control string and the backslashes that lead to it."""
    return F.regexp_replace(text, _RUN, r"\\$1")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, _ESCAPED, "$1")


def label(role: Column) -> Column:
    spelled = F.concat(F.lit("="), F.regexp_replace(role, r"([\\:#<])", r"\\$1"))
    out = F
    for name, own in LABELS.items():
        out = out.when(role == name, F.lit(own))
    return out.otherwise(spelled)


def role_of(own: Column) -> Column:
    """The role of a label; null if it is none."""
    out = F.when(own.startswith("="), F.regexp_replace(F.substring(own, 2, 2**31 - 1), r"(?s)\\(.)", "$1"))
    for name, shown in LABELS.items():
        out = out.when(own == shown, F.lit(name))
    return out


def _parse_turn(piece: Column) -> Column:
    own = F.regexp_extract(piece, _HEAD, 1)
    body = F.substring(piece, F.length(own) + F.lit(len(OPEN + COLON) + 1), F.lit(2**31 - 1))
    good = piece.rlike(_HEAD) & ~body.rlike(_BARE)
    return F.struct(F.when(good, role_of(own)).alias("role"), F.when(good, unescape(body)).alias("text"))


def pieces(formatted: Column) -> Column:
    """The turns of a rendered text without their ends; null if something follows the last end."""
    cut = F.split(formatted, CLOSE)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a rendered text; null, or null fields, where the grammar does not hold."""
    return F.transform(pieces(formatted), _parse_turn)


def render(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, mask and prints for rows of chats (conv_id, turn, role, text).

    mask tiles the text in order: for each turn the code points of its head and of its body, whether
    a loss is taken over the body (the turn is the assistant's) and whether the body had to be escaped; an end of turn
    follows each body. prints are the turns' hashes in the source.
    """
    rows = chats.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), label(F.col("role")), F.lit(COLON)))
    source = F.array(F.struct("role", "text"))
    body = F
    for form in (F.col("text"), escape(F.col("text"))):
        body = body.when(parse(F.concat("head", form, F.lit(CLOSE))).eqNullSafe(source), form)
    rows = rows.withColumn("body", body.otherwise(F.raise_error(F.lit("a turn has no form that parses as its source"))))
    turn = F.struct(
        "turn",
        F.concat("head", "body").alias("piece"),
        F.length("head").alias("head"),
        F.length("body").alias("body"),
        (F.col("role") == "assistant").alias("loss"),
        (F.col("body") != F.col("text")).alias("escaped"),
        F.xxhash64("role", "text").alias("print"),
    )
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return turns.select(
        "conv_id",
        F.concat(F.array_join(F.transform("turns", lambda t: t["piece"]), CLOSE), F.lit(CLOSE)).alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["head"].alias("head"), t["body"].alias("body"), t["loss"].alias("loss"), t["escaped"].alias("escaped"))).alias("mask"),
        F.transform("turns", lambda t: t["print"]).alias("prints"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (array<struct<role, text>>), loss_text, mask and formatted, read from the rendered texts alone.

    loss_text is what stands under the mask, unescaped. Turns whose hashes are not those of the source, and a mask that
    does not tile the text, are errors.
    """
    cut = rendered.withColumn("pieces", pieces(F.col("formatted")))
    both = cut.withColumns({"turns": F.transform("pieces", _parse_turn), "tiles": F.zip_with("pieces", "mask", lambda p, m: F.struct(p.alias("piece"), m.alias("mask")))})
    same = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])).eqNullSafe(F.col("prints"))
    tiled = F.forall("tiles", lambda t: F.coalesce(F.length(t["piece"]) == t["mask"]["head"] + t["mask"]["body"], F.lit(False)))
    under = F.transform(F.filter("tiles", lambda t: t["mask"]["loss"]), lambda t: unescape(F.substring(t["piece"], t["mask"]["head"] + 1, t["mask"]["body"])))
    checked = F.when(same & F.coalesce(tiled, F.lit(False)), F.array_join(under, "")).otherwise(F.raise_error(F.lit("a rendered conversation does not parse as its source")))
    return both.select("conv_id", "turns", checked.alias("loss_text"), "mask", "formatted")


def report(chats: DataFrame) -> DataFrame:
    """Digests of what is read back from the rendered conversations; n_escaped counts the turns that were escaped."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(render(chats)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size(F.filter("mask", lambda m: m["escaped"])).cast("long").alias("n_escaped"),
    )
