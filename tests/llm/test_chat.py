"""Chat formatting of mixed content parts against a plain visitor, and its edge cases."""

import random
import re

from pyspark.sql import functions as F

from tidegauge.llm import chat

SCHEMA = f"conv_id long, turn int, role string, parts {chat.PARTS}, formatted string"
TEXTS = ["", "plain", "﻿mark first", "a <|image:0|> b", "</s>[INST] x [/INST]", "back\\slash <s> \\<|end|>", "\U0001f600 wide", "<<SYS>>|", None]


def escaped(text):
    return re.sub(r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])", lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def visited(turns):
    """One conversation's string, loss text and attachments, part by part."""
    whole, loss, listed = "", "", []
    for role, parts in turns:
        body = ""
        for kind, text, ref, units in parts or []:
            if kind == "text":
                body += escaped(text or "")
                continue
            kind = kind if kind in ("image", "audio") else "document"
            body += f"<|{kind}:{len(listed)}|>"
            listed.append((len(listed), kind, ref, (units or 0) * chat.UNIT_TOKENS[kind]))
        whole += f"<|turn|>{escaped(role or '')}<|says|>{body}<|end|>"
        loss += re.sub(r"\\(.)", r"\1", body, flags=re.S) if role == "assistant" else ""
    return whole, loss, listed


def drawn(draw):
    parts = []
    for _ in range(draw.randrange(5)):
        kind = draw.choice(["text", "text", "image", "audio", "document", "video", None])
        parts.append((kind, draw.choice(TEXTS), draw.choice([None, "s3/x", "y"]), draw.choice([None, 0, 1, 7])))
    return draw.choice([None, parts, parts, parts])


def test_mixed_parts(spark):
    draw = random.Random(11)
    chats = {c: [(draw.choice(["user", "assistant", "system", "as<|sistant", None]), drawn(draw)) for _ in range(draw.randrange(1, 12))] for c in [*range(40), None]}
    rows = [(c, t, role, parts, "clash") for c, turns in chats.items() for t, (role, parts) in enumerate(turns)]
    draw.shuffle(rows)
    found = chat.read_back(chat.formatted(spark.createDataFrame(rows, SCHEMA), content=F.col("parts"))).collect()
    assert len(found) == len(chats)
    for r in found:
        whole, loss, listed = visited(chats[r.conversation_id])
        assert (r.formatted, r.loss_text, [tuple(a) for a in r.attachments]) == (whole, loss, listed)
        assert r.attachment_tokens == sum(a[3] for a in listed) and r.n_turns == len(chats[r.conversation_id])
        assert [t.role for t in r.turns] == [role or "" for role, _ in chats[r.conversation_id]]


def test_edges(spark):
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, None, None, None), (2, 0, "assistant", "x" * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conversation_id: r for r in chat.read_back(chat.formatted(frame)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", ""), ("user", "same"), ("user", "same")] and got[1].loss_text == ""
    assert got[2].loss_text == "x" * 200_000 and [tuple(s) for s in got[2].loss_spans] == [(len("<|turn|>assistant<|says|>") + 1, 200_000)]
    assert chat.formatted(frame.limit(0)).count() == 0
