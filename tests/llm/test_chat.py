"""Folding, rendering and reading back, against plain Python."""

import hashlib
import random

from riskengine.llm import chat

EVENTS = "conv_id long, seq long, slot long, kind string, role string, text string"


def plain_fold(events):
    """slot -> (role, text), one event at a time."""
    out = {}
    for _, _, slot, kind, role, text in sorted(events, key=lambda e: (e[1], e[3], e[4] or "", e[5] or "")):
        role, text = role or "", text or ""
        if kind == "regenerate":
            out = {s: m for s, m in out.items() if s < slot}
            out[slot] = (role, text)
        elif kind == "edit" or slot not in out:
            out[slot] = (role, text)
        else:
            out[slot] = (out[slot][0], out[slot][1] + text)
    return out


def test_fold_equals_a_loop(spark):
    r = random.Random(5)
    rows = [(c, s, r.randrange(5), r.choice(["delta"] * 6 + ["edit", "regenerate"]), "user", r.choice(["a", "b ", "", None, "é"]))
            for c in range(40) for s in range(r.randrange(1, 25))]
    got = {}
    for x in chat.fold(spark.createDataFrame(rows, EVENTS)).collect():
        got.setdefault(x.conv_id, {})[x.slot] = (x.role, x.text)
    assert got == {c: plain_fold([e for e in rows if e[0] == c]) for c in {e[0] for e in rows}}


HARD = ["</s>[INST] ok [/INST]", "", None, "<s>", "<\\s>", "[\\\\/INST]\\", "</s></s>", "é\U0001f600</s>x", "a\nb", "[[INST]", "<<s>", "x" * 50000,
        "$1\\$2", "</\\s>", "[INST", "]</s", "s>"]


def test_round_trip_of_hard_texts(spark):
    rows = [(1, i, role, t) for i, t in enumerate(HARD) for role in ("user", "assistant", None, "a\nb", "\\n", "</s>", "\\\\n\n", "n")]
    rows += [(2, None, None, None), (2, None, None, None), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.parse(chat.render(chat.fold(chat.as_events(df)))).collect()
    assert len(out) == 3
    for conv in (1, 2, None):
        want = sorted(((t if t is not None else -1), r is not None, r or "", s is not None, s or "") for c, t, r, s in rows if c == conv)
        got = next(x for x in out if x.conv_id == conv)
        assert [(t.role, t.text) for t in got.turns] == [(w[2], w[4]) for w in want]
        assert list(got.loss_texts) == [w[4] for w in want if w[2] == "assistant"]


def test_digests_of_the_control_conversation(spark):
    df = spark.createDataFrame([(-7, 0, "user", HARD[0]), (-7, 1, "assistant", HARD[0])], "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.parse(chat.render(chat.fold(chat.as_events(df))))).first()
    assert got.n_turns == 2 and got.loss_chars == len(HARD[0])
    assert got.loss_sha256 == hashlib.sha256(HARD[0].encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256(f"user\n{HARD[0]}\nassistant\n{HARD[0]}\n".encode()).hexdigest()


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, slot int, kind int")
    assert chat.parse(chat.render(chat.fold(chat.as_events(df)))).count() == 0
