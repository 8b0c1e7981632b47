"""Operator 2: fixed patterns against plain regular expressions, and disguises."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spoorline.llm import pii


def plain(text):
    """The fixed patterns as they are written."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


PARTS = ["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "..", "a@b", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-5555", "+12", "+1 555 555 5555 ", " ", "\n", "é", "5", "-", "+", "(", "user@@x.y", "a@b.c@d.e"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12))
def test_fixed_patterns(parts):
    text = "".join(parts)
    assert sorted(pii.scan(text)[0]) == plain(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail jo.doe [at] example [dot] com now", 0, "jo.doe [at] example [dot] com"),
        ("mail jo(at)mail.example.com", 0, "jo(at)mail.example.com"),
        ("write to jo at example dot com please", 0, "jo at example dot com"),
        ("jоhn@exаmple.com", 0, "jоhn@exаmple.com"),
        ("jo＠example．com", 0, "jo＠example．com"),
        ("call plus one five five five five five five five five five five now", 3, "plus one five five five five five five five five five five"),
        ("card four one one one one one one one one one one one one one one one end", 2, "four one one one one one one one one one one one one one one one"),
        ("ip １２７.0.0.1 here", 1, "１２７.0.0.1"),
        ("at 4111​1111​1111​1111.", 2, "4111​1111​1111​1111"),
        ("jo at mail.example dot com", 0, "jo at mail.example dot com"),
        ("jo&#64;example.com", 0, "jo&#64;example.com"),
        ("so joe @ example . com, yes", 0, "joe @ example . com"),
        ("joe @ example.com. Then", 0, "joe @ example.com"),
        ("jo     [at]      example.com", 0, "jo     [at]      example.com"),
        ("call + one 555 123 4567 now", 3, "+ one 555 123 4567"),
        ("plus one five five five one two\nthree four five six seven", 3, "plus one five five five one two\nthree four five six seven"),
        ("plus four nine double five one two three four triple six", 3, "plus four nine double five one two three four triple six"),
        ("+٤٩ ٣٠ ١٢٣٤٥٦٧ x", 3, "+٤٩ ٣٠ ١٢٣٤٥٦٧"),
        ("pay 4111 1111 1111 llll", 2, "4111 1111 1111 llll"),
        ("1O.0.0.12", 1, "1O.0.0.12"),
        ("one dot two dot 3 dot 4", 1, "one dot two dot 3 dot 4"),
    ],
)
def test_disguises(text, kind, found):
    base, more = pii.scan(text)
    assert base == plain(text)
    spans = [text[a:b] for k, a, b in [*base, *more] if k == kind]
    assert spans == [found]


@pytest.mark.parametrize("text", ["We met at noon. The dot on the map.", "one two three four", "look at this (at last) and wait", "Привет, мир", "at dot at dot", "İstanbul dot", "[at] [dot]", "élan at naïve dot"])
def test_clean_texts_stay_clean(text):
    assert pii.scan(text) == ([], [])


def test_long_runs_take_linear_time():
    for x in ("1" * 200_000, "1." * 100_000, "a@" * 100_000, "one " * 50_000, "(" * 100_000, "+1 " * 70_000, "a" * 300_000, " " * 200_000 + "at"):
        pii.scan(x)


def test_spark(spark):
    r = random.Random(4)
    docs = [(None, "a@b.c"), (1, None), (2, ""), *((i, "".join(r.choices(PARTS, k=9))) for i in range(3, 60)), (5, "x"), (5, "x")]
    got = pii.pii_spans(spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, spans string").repartition(3)).collect()
    want = []
    for d, t in docs:
        base, more = plain(t or ""), pii.scan(t or "")[1]
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        want.append((d, *(sum(x[0] == k for x in base) for k in range(4)), len(more), hashlib.sha256(said.encode()).hexdigest(), pii.said(base + more)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pii.pii_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def disguised(kind, r):
    """An identifier, written in a way that no fixed pattern finds, made without the operator's tables."""
    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    way = r.randrange(3)
    if kind == "email":
        user, host = (r.choice(["jo", "ann.lee", "x-1"]), r.choice(["example", "mail2", "a-b"]))
        at, dot = [(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot ")][way]
        return user + at + host + dot + "com"
    digits = {"ip": "10.20.130.4", "card": "4111111111111111", "phone": "15551234567"}[kind]
    if way == 0:
        body = " ".join("dot" if c == "." else names[int(c)] for c in digits)
        return ("plus " if kind == "phone" else "") + body
    body = "".join(chr(0x0660 + int(c)) if c != "." and way == 1 else chr(0xFF10 + int(c)) if c != "." else c for c in digits)
    return ("+" if kind == "phone" else "") + body


@pytest.mark.parametrize("kind", pii.KINDS)
def test_disguised_identifiers_come_back_with_their_places(kind):
    r = random.Random(kind)
    for _ in range(60):
        hidden = disguised(kind, r)
        before = r.choice(["", "Ask Zoë; ", "naïve — "])
        text = before + hidden + r.choice(["", "; thanks", "\n\nYours"])
        spans = [(k, a, b) for found in pii.scan(text) for k, a, b in found if pii.KINDS[k] == kind]
        assert spans == [(pii.KINDS.index(kind), len(before), len(before) + len(hidden))]


def test_piece_of_an_identifier():
    """A fixed pattern finds what follows the look-alike; the whole is a span besides."""
    for text, piece, whole in (("write to j\u03bfhn@example.com now", "hn@example.com", "j\u03bfhn@example.com"), ("r\u0261b@example.com", "b@example.com", "r\u0261b@example.com")):
        base, more = pii.scan(text)
        assert [text[a:b] for _, a, b in base] == [piece] and [text[a:b] for _, a, b in more] == [whole]
    assert pii.outermost([(5, 9), (0, 4), (1, 3), (6, 9), (5, 9)]) == ([0, 5], [4, 9])
