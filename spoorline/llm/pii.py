"""Operator 2: personal data, also where it is disguised, with offsets into the source text.

Fixed patterns find emails, IP addresses, card and phone numbers. A transducer then rewrites disguises (look-alike
letters, digits of other scripts, full-width forms, zero-width characters, spelled digits, letters among digits, "[at]" and
"[dot]" and their like, character references, blanks around an @) and keeps for every character it emits the source span it came from. The same detectors read its output; what they find across a rewritten
character is mapped back and added, unless a fixed pattern has found that place already; where one has found only a piece of
it, the whole is added besides.

Defined results: null and empty texts have no spans; repeated rows are scanned alike; null doc_ids are carried; an empty
table gives an empty table; a very long text is scanned whole, in time that grows with its length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats and the look-behind keep the leftmost matches and make long runs of digits take linear time.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Look-alikes and what they stand for.
_LIKE = dict(zip("АВЕКМНОРСТХУІЈЅаеорсухіјѕԁɡ", "ABEKMHOPCTXYIJSaeopcyxijsdg", strict=True))
_LIKE |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναι", "ABEZHIKMNOPTYXovai", strict=True))
_LIKE |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
_LIKE |= {c: "" for c in "​‌‍⁠﻿­"}
_LIKE |= {c: "-" for c in "‐‑‒–−"}
# Decimal digits of all scripts, and letters and digits in mathematical or circled form.
_LIKE |= {c: str(unicodedata.decimal(c)) for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) == "Nd"}
_LIKE |= {c: plain for c in map(chr, (*range(0x1D400, 0x1D800), *range(0x24B6, 0x24EA))) if (plain := unicodedata.normalize("NFKC", c)).isascii()}
# Spelled digits, how often one is meant, and letters that stand for digits.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_TIMES = {"double": 2, "triple": 3}
_LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1"}
_DIGIT = "(?:" + "|".join(_DIGITS) + ")"
_SAID = rf"(?:(?:{'|'.join(_TIMES)})[\x20-]++)?{_DIGIT}"
_PLUS = r"(?:((?<![A-Za-z])plus[\x20-]++|\+[\x20-]*+))?(?<![A-Za-z])"
_GAP = r"[\x20\t\r\n,-]++"
_SPELLED = re.compile(rf"{_PLUS}{_SAID}(?:(?:{_GAP}|\x20*+(?:dot|point)\x20*+){_SAID})+(?![A-Za-z])", re.I | re.A)
# Words and figures by turns; figures are joined by blanks and hyphens only.
_TURNS = re.compile(rf"{_PLUS}(?:{_SAID}|(?<![0-9])[0-9]++)(?:(?:{_GAP}|\x20*+(?:dot|point)\x20*+){_SAID}|(?:[\x20-]++|\x20*+(?:dot|point)\x20*+)[0-9]++)+(?![A-Za-z])", re.I | re.A)
_SPELLED_PART = re.compile(rf"(?:({'|'.join(_TIMES)})[\x20-]++)?({_DIGIT})|dot|point|[0-9]++", re.I | re.A)
# Cheap tests for texts in lower case, without which the two patterns above cannot match.
_PAIR = re.compile(rf"{_DIGIT}(?:{_GAP}|\x20*+(?:dot|point)\x20*+)(?:{'|'.join(_TIMES)}|{_DIGIT})")
_FIGURE_WORD = re.compile(rf"[0-9](?:{_GAP}|\x20*+)(?:{'|'.join(_TIMES)}|{_DIGIT}|dot|point)")
_WORD_FIGURE = re.compile(r"(?<=[a-z])[\x20-]*+[0-9]")
_ENDS = (*_DIGITS, "dot", "point")
_ANY_SAID = re.compile(_DIGIT, re.I | re.A)
_FIGURE = re.compile(r"[0-9]")
_LETTERED = re.compile(r"(?<![A-Za-z0-9])[0-9OolI](?:[\x20.-]?[0-9OolI]){3,}+(?![A-Za-z0-9])")
# A disguise starts where no blank precedes its blanks, so that long runs of blanks are read once.
_OPEN, _CLOSE = r"(?<!\x20)\x20*+[\[({<]\x20*+", r"\x20*+[\])}>]\x20*+"
_LABELS = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
_RULES = re.compile(
    rf"(?P<at>{_OPEN}(?:at|@){_CLOSE}|&(?:#64|#x40|commat);|(?<=[A-Za-z0-9])\x20++at\x20++(?={_LABELS}(?:\x20++dot\x20++|\x20*+[\[({{<]\x20*+dot{_CLOSE})[A-Za-z]))"
    rf"|(?P<dot>{_OPEN}(?:dot|\.){_CLOSE}|&(?:#46|#x2e|period);|(?<=[A-Za-z0-9])\x20++dot\x20++(?=[A-Za-z0-9]))"
    r"|(?P<wide>(?<=[A-Za-z0-9])\x20*+@\x20*+[A-Za-z0-9-]++(?:(?:\.|\x20++\.\x20++)[A-Za-z0-9-]++)++)",
    re.I | re.A,
)
_BLANKS = re.compile(r"\x20++")
_ODD = re.compile(r"[^\x00-\x7f]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)  # no local part reaches over an @
        at = text.find("@", max(at + 1, last))
    return out


def detect(text: str) -> list[tuple[int, int, int]]:
    """(index of kind, start, end) of all fixed patterns."""
    found = [(0, *x) for x in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) < 4 and int(p or 0) <= 255 for g in m.groups()):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, *m.span()))
    return found


def _spelled(plain: str, pattern: re.Pattern) -> list[tuple[int, int, str]]:
    """Edits that turn spelled digits into figures and join them; of words and figures by turns, only where both stand."""
    edits = []
    for m in pattern.finditer(plain):
        first = m.end(1) if m[1] else m.start()
        if pattern is _TURNS and not (_ANY_SAID.search(plain, first, m.end()) and _FIGURE.search(plain, first, m.end())):
            continue
        if m[1]:
            edits.append((m.start(), first, "+"))
        last = first
        for part in _SPELLED_PART.finditer(plain, first, m.end()):
            if part.start() > last:
                edits.append((last, part.start(), ""))
            if part[2]:
                edits.append((*part.span(), _DIGITS[part[2].lower()] * _TIMES.get((part[1] or "").lower(), 1)))
            elif not part[0][0].isdigit():
                edits.append((*part.span(), "."))
            last = part.end()
    return edits


def rewrite(text: str, turns: bool = False) -> tuple[str, list[int], list[int], list[bool]] | None:
    """The rewritten text, and for each of its characters the source span and whether it was rewritten; None if nothing was.

    turns: read spelled digits together with the figures beside them; None where there are no such places.
    """
    low = text.lower() if text.isascii() else text.translate(_TABLE).lower()
    if len(low) == len(text):  # some letters change length in lower case; those texts are searched as they are
        plain = low
    else:
        plain = text
    if turns:
        beside = _FIGURE_WORD.search(low) or any(low.endswith(_ENDS, 0, m.start()) for m in _WORD_FIGURE.finditer(low))
        edits = _spelled(plain, _TURNS) if beside else []
        if not edits:
            return None
    else:
        edits = _spelled(plain, _SPELLED) if _PAIR.search(low) else []
    if not text.isascii():
        edits += [(m.start(), m.end(), _LIKE[m[0]]) for m in _ODD.finditer(text) if m[0] in _LIKE]
    if "dot" in plain or any(c in plain for c in "[({<&@"):
        for m in _RULES.finditer(plain):
            if m["wide"] is None:
                edits.append((m.start(), m.end(), "@" if m["at"] else "."))
            else:
                edits += [(*blank.span(), "") for blank in _BLANKS.finditer(plain, m.start(), m.end())]
    for m in _LETTERED.finditer(text):
        places = [i for i in range(m.start(), m.end()) if text[i] in _LETTERS]
        if places and 3 * len(places) <= sum(c.isdigit() for c in m[0]) + len(places):
            edits += [(i, i + 1, _LETTERS[text[i]]) for i in places]
    if not edits:
        return None
    out, begin, end, new, done = [], [], [], [], 0
    for a, b, to in sorted(edits, key=lambda e: (e[0], -e[1])):
        if a < done:
            continue
        out.append(text[done:a])
        begin += range(done, a)
        end += range(done + 1, a + 1)
        new += [False] * (a - done)
        out.append(to)
        begin += [a] * len(to)
        end += [b] * len(to)
        new += [True] * len(to)
        done = b
    out.append(text[done:])
    begin += range(done, len(text))
    end += range(done + 1, len(text) + 1)
    new += [False] * (len(text) - done)
    return "".join(out), begin, end, new


#: Look-alikes as single characters, for searching without moving offsets.
_TABLE = {ord(k): v or " " for k, v in _LIKE.items()}


def outermost(spans) -> tuple[list[int], list[int]]:
    """Starts and ends, in order, of the spans that lie in no other one."""
    starts, ends = [], []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not ends or b > ends[-1]:
            starts.append(a)
            ends.append(b)
    return starts, ends


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the fixed patterns, and the spans that the method adds."""
    base = detect(text)
    more: list[tuple[int, int, int]] = []
    for turns in (False, True):
        if changed := rewrite(text, turns):
            plain, begin, end, new = changed
            taken = [outermost((s, e) for k, s, e in (*base, *more) if k == kind) for kind in range(len(KINDS))]
            for kind, a, b in detect(plain):
                x, y = begin[a], end[b - 1]
                starts, ends = taken[kind]
                first, beyond = bisect_right(ends, x), bisect_left(starts, y)
                # Spans that overlap this one: none, or only pieces of it.
                apart = first >= beyond or (x <= starts[first] and ends[beyond - 1] <= y and (x, y) != (starts[first], ends[beyond - 1]))
                # Characters dropped inside count as rewritten too: then source and output differ in length.
                if apart and (y - x != b - a or any(new[a:b])):
                    more.append((kind, x, y))
    return base, more


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (fixed patterns), n_more, base_sha256 and spans for every document."""

    def rows(batches):
        for batch in batches:
            out = [scan(x or "") for x in batch["text"].to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in out], pa.int64()) for k in range(4)]
            sha = [hashlib.sha256(said(base).encode()).hexdigest() for base, _ in out]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *counts, pa.array([len(m) for _, m in out], pa.int64()), pa.array(sha, pa.string()), pa.array([said(b + m) for b, m in out], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_more", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_more long, base_sha256 string, spans string")
