"""Chat formatting against formatting one turn at a time, with parts of any size."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from doctables.llm import chat
from doctables.llm.queries import QUERIES

DDL = "conv_id long, turn long, role string, text string"
SIGNS = ["<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[/TURN]", "\\", "<", "[", "/", " ", "\n", "é", "漢", "😀", "s>", "INST]", "<\\", "word", ""]


def template(role, text):
    def plain(s):
        for sign in chat.CONTROL:
            for n in range(9, -1, -1):
                s = s.replace(sign[0] + "\\" * n + sign[1:], sign[0] + "\x00" * (n + 1) + sign[1:])
        return s.replace("\x00", "\\")

    if role == "user":
        return f"[INST] {plain(text)} [/INST]"
    if role == "assistant":
        return f" {plain(text)}</s>"
    return "[TURN] " + plain(role).replace("\\", "\\\\").replace("\n", "\\n") + f"\n{plain(text)} [/TURN]"


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: t[:2])
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        chars = sum(len(template(r, t)) for *_, r, t in turns)
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in (said, learned)]
        out[conv] = (len(turns), digests[0], len(learned), digests[1], chars)
    return out


def random_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 6)):
            text = "".join(rng.choices(SIGNS, k=rng.randint(0, 12)))
            role = rng.choice(["user", "assistant", "system", "to\\ol\n", "</s>", "", "User"])
            rows.append((conv, turn, role, text))
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", None), (n, None, None, None), (n, 0, "assistant", "x" * 3_000_000)]
    rng.shuffle(rows)
    return rows


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_equal_to_one_turn_at_a_time(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "SLICE", size)
    rows = random_rows(60, size)
    df = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("x") for c in ("part", "place", "loss", "whole", "mixed")}).repartition(5)
    assert found(chat.read_back(chat.formatted(df))) == expected(rows)


def test_text_and_loss_spans(spark):
    rows = [(1, 0, "user", "é </s>"), (1, 1, "assistant", "漢 [INST]"), (1, 2, "tool", None)]
    parts = chat.formatted(spark.createDataFrame(rows, DDL).coalesce(1)).orderBy("part").collect()
    text = "".join(p.text for p in parts)
    assert text == "[INST] é <\\/s> [/INST] 漢 [\\INST]</s>[TURN] tool\n [/TURN]"
    assert [p.text[s.start : s.end] for p in parts for s in p.loss] == ["漢 [\\INST]"]
    assert chat.turns_of(text) == [("user", "é </s>"), ("assistant", "漢 [INST]"), ("tool", "")]
    with pytest.raises(ValueError):
        chat.turns_of("[INST] no end")


def test_one_conversation_in_many_tasks(spark):
    """A conversation of a third of the rows, with repeated rows and ties, is cut by ranges and whole again."""
    rows = [(7, t // 2, "assistant", f"t{t // 2}") for t in range(4_000)] + [(c, t, "user", "q") for c in range(2_000) if c != 7 for t in range(4)]
    parts = chat.formatted(spark.createDataFrame(rows, DDL).repartition(6)).cache()
    assert parts.filter("conv_id = 7").count() > 1
    assert found(chat.read_back(parts)) == expected(rows)


def test_empty_table(spark):
    assert chat.read_back(chat.formatted(spark.createDataFrame([], DDL))).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert found(QUERIES["op11_chat"](spark, sf)) == expected(rows)
