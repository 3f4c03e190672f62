import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palaver.llm import chat
from palaver.llm.chat import INSTRUCT, Template, Turn

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n string, row string, chunk int, after string"


def plain(rows):
    """By conversation: turns in order with the verdict of a simple loop over the machine."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, r or "", x or "") for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        state, turns = "start", []
        for _, role, text in own:
            to = INSTRUCT.steps.get((state or "start", role))
            fine = to is not None
            state = to if fine else INSTRUCT.steps.get(("start", role))
            turns.append((role, text, fine, state))
        out[conv] = turns
    return out


def formatted(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, "a", "b", 1, "c") for r in rows], SCHEMA).repartition(parts)
    return chat.format_conversations(docs)


def check(spark, rows):
    read = {}
    for r in sorted(chat.read_back(formatted(spark, rows)).collect(), key=lambda r: r.n):
        read.setdefault(r.conv_id, []).append((r.role, r.text, r.allowed, r.state))
    assert read == plain(rows)


@pytest.fixture
def many_chunks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_orders_and_roles(spark, many_chunks):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "u")]
    rows += [(2, 0, "assistant", "first"), (2, 1, "user", "u"), (2, 2, "user", "again"), (2, 3, "assistant", "a")]
    rows += [(3, 0, "tool", "x"), (3, 1, None, None), (3, None, "user", ""), (3, 2, "[SAYS]", "[SAYS][/SAYS]")]
    rows += [(None, 0, "user", "u"), (None, 1, "assistant", "a"), (4, 0, "user", "tie"), (4, 0, "assistant", "tie"), (4, 0, "user", "tie")]
    check(spark, rows)


def test_conversation_over_many_chunks(spark, many_chunks):
    rng = random.Random(5)
    rows = [(9, t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), "x") for t in range(400)]
    rows += [(c, t, ["user", "assistant"][t % 2], "y") for c in range(20) for t in range(4)]
    walked = formatted(spark, rows, 5)
    assert walked.where("conv_id = 9").select(F.shiftright("n", 33)).distinct().count() > 1
    check(spark, rows)


def test_control_strings_are_taken_back(spark):
    rng = random.Random(3)
    pieces = [*INSTRUCT.controls, "\\", "<", "[", "s>", "INST]", "/", " ", "ü", "\n", "[\\INST]", "<\\\\s>", "[ROLE"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(300)] + ["", "[INST] " * 50_000]
    rows = [(i, t, r, x) for i, x in enumerate(texts) for t, r in enumerate(["user", "assistant", x[:20]])]
    check(spark, rows)
    for r in formatted(spark, rows[:600]).collect():
        inner = r.segments[1].text
        assert not any(c in inner for c in INSTRUCT.controls)
        assert [s.loss for s in r.segments] == [False, r.role == "assistant", False]


def test_digests_of_whole_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "<s>b"), (1, 2, "assistant", "c"), (None, 0, "user", None)]
    read = chat.read_back(formatted(spark, rows)).withColumn("size", F.length("loss_text").cast("long"))
    found = {r.conv_id: r for r in chat.digests(read, "conv_id", "n", {"d": "loss_text"}, ["size"], ["state"]).collect()}
    assert found[1].d == hashlib.sha256(b"<s>bc").hexdigest() and found[1]["size"] == 5 and found[1].n == 3
    assert found[None].d == hashlib.sha256(b"").hexdigest() and found[None].state == "asked"


def test_empty_table(spark):
    empty = chat.format_conversations(spark.createDataFrame([], SCHEMA))
    assert chat.read_back(empty).count() == 0
    assert chat.digests(chat.read_back(empty), "conv_id", "n", {"d": "text"}, [], []).count() == 0


@pytest.mark.parametrize("controls", [("<a>", "<a>b"), ("<a<",), ("\\a",), ("<a\\>",), ("<",)])
def test_templates_that_could_not_be_read_back(controls):
    with pytest.raises(ValueError):
        Template(controls, {"user": Turn(controls[0], controls[0])}, (controls[-1],) * 3, {})
