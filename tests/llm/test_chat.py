"""Chat formatting: the round trip against a parser written by hand, and rows of every kind."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarn.llm import chat
from tarn.llm.queries import HARD_TURN, op11_chat_format

LABELS = {"System": "system", "User": "user", "Assistant": "assistant"}
CONTROLS = ("### ", "</turn>")


def plain_parse(s):
    """The turns of a rendered text, sign by sign."""
    out, i = [], 0
    while i < len(s):
        assert s.startswith("### ", i)
        i += 4
        own = ""
        while s[i] != ":":
            if s[i] == "\\":
                own, i = own + s[i], i + 1
            own, i = own + s[i], i + 1
        assert s[i : i + 2] == ": "
        end = s.index(" </turn>\n", i + 1)
        body, i = s[i + 2 : end], end + 9
        text, j = "", 0
        while j < len(body):
            run = 0
            while j + run < len(body) and body[j + run] == "\\":
                run += 1
            control = next((c for c in CONTROLS if body.startswith(c, j + run)), "")
            assert run or not control, "a bare control string"
            text += "\\" * (run - bool(control)) + control
            j += run + len(control)
            if not control and not run:
                text, j = text + body[j], j + 1
        if own in LABELS:
            role = LABELS[own]
        else:
            assert own[0] == "="
            role, k = "", 1
            while k < len(own):
                k += own[k] == "\\"
                role, k = role + own[k], k + 1
        out.append((role, text))
    return out


def check(rows, spark):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t, r or "", x or ""))
    rendered = {r.conv_id: r for r in chat.render(df).collect()}
    back = {r.conv_id: r for r in chat.read_back(chat.render(df)).collect()}
    digests = {r.conv_id: r for r in chat.report(df).collect()}
    assert set(rendered) == set(back) == set(digests) == set(want)
    for c, turns in want.items():
        # rows of one turn are ordered by their rendered form, which the parser gives back
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0))
        parsed = plain_parse(rendered[c].formatted)
        assert sorted(parsed) == sorted(t[1:] for t in turns)
        if len({t[0] for t in turns}) == len(turns):
            assert parsed == [t[1:] for t in turns]
        assert [tuple(t) for t in back[c].turns] == parsed
        loss = "".join(x for r, x in parsed if r == "assistant")
        at, spans = 0, ""
        for m in rendered[c].mask:
            if m.loss:
                spans += rendered[c].formatted[at + m.head : at + m.head + m.body]
            at += m.head + m.body + len(chat.CLOSE)
        assert at == len(rendered[c].formatted) and back[c].loss_text == loss and len(spans) >= len(loss)
        d = digests[c]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(turns), len(loss), len(rendered[c].formatted))
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in parsed).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    return digests


def test_hard_texts(spark):
    texts = [HARD_TURN, "", None, "### ", "</turn>", "\\", "\\\\### \\</turn>", " </turn>\n", " </turn>\n### User: x", "#### ### ###", "a\\", "### \\### </turn></turn>", "\\" * 5000 + "### ", "é日本🙂 </turn>", "##", " ", "\n", "###", "$1 \\1"]
    roles = ["user", "assistant", "system", None, "", "User", "=user", "tool: x", "a\\b", "### ", "</turn>", "\n", " </turn>\n", "x" * 20_000, ":"]
    rows = [(i, 0, "assistant", x) for i, x in enumerate(texts)] + [(100 + i, t, r, x) for i, r in enumerate(roles) for t, x in enumerate(texts[:6])]
    got = check(rows, spark)
    assert got[0].n_escaped == 1 and got[1].n_escaped == 0 and got[10].n_escaped == 0


def test_random_texts(spark):
    rng = random.Random(5)
    parts = ["### ", "</turn>", "\\", " ", "\n", "#", "<", ":", "Assistant", "=", "a", "é", "turn>"]
    make = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
    check([(c, t, rng.choice(["user", "assistant", make()]), make()) for c in range(150) for t in range(rng.randrange(1, 5))], spark)


def test_rows_of_every_kind(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (1, None, "user", "first"), (None, 1, "user", "x"), (None, 2, "assistant", "y"), (2, -5, "user", "m"), (2, 3, "assistant", "n"), (3, 0, "user", "long " * 100_000)]
    got = check(rows, spark)
    assert got[1].n_turns == 4 and got[None].n_turns == 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = df.withColumns({c: F.lit("z") for c in ("head", "body", "piece", "turns", "mask", "formatted", "print", "t", "label")})
    assert sorted(map(str, chat.report(more).collect())) == sorted(map(str, chat.report(df).collect()))
    assert chat.report(df.limit(0)).count() == 0


def test_a_conversation_of_very_many_turns(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), (F.lit(n) - F.col("id")).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t</turn>"), F.col("id")).alias("text"))
    d = chat.report(rows.repartition(8)).first()
    want = [("user" if i % 2 == 0 else "assistant", f"t</turn>{i}") for i in reversed(range(n))]
    assert d.n_turns == d.n_escaped == n
    assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in want).encode()).hexdigest()


def test_another_text_is_an_error(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "a"), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    for broken in (F.lit("### User: a </turn>\n"), F.concat("formatted", F.lit("x")), F.regexp_replace("formatted", "a </turn>", "c </turn>"), F.regexp_replace("formatted", "Assistant", "Nobody")):
        with pytest.raises(Exception, match="does not parse"):
            chat.read_back(chat.render(df).withColumn("formatted", broken)).collect()


def test_no_python_worker(spark, sf_dir):
    plan = op11_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    assert plan.count("Exchange hashpartitioning") == 1
