r"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus
signs, digits, url schemes and identifier cues. A local parser expands each
anchor to the left and right, and validates what it got. The base kinds equal
the leftmost non-overlapping matches of these patterns:

* email: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
* ip: four runs of digits with dots between, each at most 255
* card: ``[0-9]([ -]?[0-9])+`` with 12 to 19 digits that pass Luhn
* phone: ``\+[0-9][ ().0-9-]+[0-9]`` with 9 to 15 digits

A match that fails its test is dropped, and not tried again from inside. Two
more kinds come from schemes and cues and never change the base ones:

* url: an address that carries a person's name or password before an at-sign
  (``https://user:pass@host``), or ``mailto:`` and ``tel:`` addresses
* account: an identifier with at least five digits after a cue such as
  ``account no.``, ``iban``, ``passport`` or ``ssn``

Nulls count as empty; spans are in code points, end exclusive. Every row is
searched alone and whole, at any length; ties, repeated rows and other columns
do no harm. A table without rows gives one without rows.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_batches, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = _LETTERS | _DIGITS | frozenset("._%+-")
_DOMAIN = _LETTERS | _DIGITS | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_IDENTIFIER = _LETTERS | _DIGITS | frozenset("-")
_URL = _LETTERS | _DIGITS | frozenset("-._~:/?#[]@!$&'()*+,;=%")
_SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
_CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "national id", "tax id", "driver license", "driving licence", "konto", "cuenta", "compte")
_FILLERS = ("number", "no.", "no", "nr.", "nr", "num", "id", "#", ":", "=", "is", " ")
_CUE_DIGITS = 5


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+":
        found.add_word(sign, (sign, 1))
    for digit in _DIGITS:
        found.add_word(digit, ("0", 1))
    for word in _SCHEMES + _CUES:
        kind = "scheme" if word in _SCHEMES else "cue"
        for spelling in {word, word.upper(), word.capitalize(), word.title()}:
            found.add_word(spelling, (kind, len(spelling)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """Around the at-sign at ``at``, starting at ``least`` or after."""
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _DOMAIN)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (more := _run(text, end + 1, _DOMAIN)) > end + 1:
        end, dots = more, dots + 1
    return (start, end) if dots else None


def _ip(text: str, start: int) -> tuple[int, bool] | None:
    """From the first digit of a run: the end of four numbers, and whether each is at most 255."""
    at, good = start, True
    for k in range(4):
        if k:
            if at >= len(text) or text[at] != ".":
                return None
            at += 1
        end = _run(text, at, _DIGITS)
        if end == at:
            return None
        good = good and len(part := text[at:end].lstrip("0")) <= 3 and int(part or "0") <= 255
        at = end
    return at, good


def _card(text: str, start: int) -> int:
    """The end of digits with at most one space or hyphen between."""
    at = start + 1
    while at < len(text):
        if text[at] in _DIGITS:
            at += 1
        elif text[at] in " -" and at + 1 < len(text) and text[at + 1] in _DIGITS:
            at += 2
        else:
            break
    return at


def _phone(text: str, at: int) -> int | None:
    """From the plus sign: the end."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at and text[end - 1] not in _DIGITS:
        end -= 1
    return end if end >= at + 4 else None


def _address(text: str, start: int, body: int) -> tuple[int, int, bool]:
    """From a scheme at ``start`` whose address begins at ``body``: its end, the end of what was read, and whether it names a person."""
    read = end = _run(text, body, _URL)
    while end > body and text[end - 1] in ".,;:!?)'":
        end -= 1
    scheme = text[start:body].lower()
    if scheme == "tel:":
        return end, read, sum(c in _DIGITS for c in text[body:end]) >= 7
    if scheme == "mailto:":
        return end, read, "@" in text[body:end]
    authority = text[body:end].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0]
    name, sign, host = authority.rpartition("@")
    return end, read, bool(sign and name and "." in host)


def _account(text: str, start: int, at: int) -> tuple[int, int] | None:
    """The identifier after a cue in text[start:at], if the cue is a whole word."""
    if (start and text[start - 1] in _LETTERS) or (at < len(text) and text[at] in _LETTERS):
        return None
    while at < len(text):
        filler = next((f for f in _FILLERS if text[at : at + len(f)].lower() == f and not (f[-1] in _LETTERS and text[at + len(f) : at + len(f) + 1] in _LETTERS | _DIGITS)), None)
        if filler is None:
            break
        at += len(filler)
    end = _run(text, at, _IDENTIFIER)
    while end > at and end < len(text) and text[end] == " " and 0 < _run(text, end + 1, _DIGITS) - end - 1 <= 4 == len(text[at:end].split(" ")[-1]):  # groups of four
        end = _run(text, end + 1, _DIGITS)
    while end > at and text[end - 1] == "-":
        end -= 1
    return (at, end) if sum(c in _DIGITS for c in text[at:end]) >= _CUE_DIGITS else None


def find_spans(text: str, machine: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of start, then of kind."""
    out: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = run_end = url_end = account_end = 0
    for last, (sign, size) in machine.iter(text):
        at = last - size + 1
        if sign == "0":
            if at >= card_end:
                card_end = _card(text, at)
                digits = text[at:card_end].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, card_end))
            if at >= run_end:  # the first digit of a run, or of what a match left of it
                run_end = _run(text, at, _DIGITS)
                if at >= ip_end and run_end < len(text) and text[run_end] == "." and (ip := _ip(text, at)):
                    ip_end = ip[0]
                    if ip[1]:
                        out.append(("ip", at, ip_end))
        elif sign == "@":
            if found := _email(text, at, email_end):
                email_end = found[1]
                out.append(("email", *found))
        elif sign == "+":
            if at >= phone_end and (end := _phone(text, at)):
                phone_end = end
                if 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                    out.append(("phone", at, end))
        elif sign == "scheme":
            if at >= url_end and not (at and text[at - 1] in _LETTERS):
                end, url_end, personal = _address(text, at, at + size)
                if personal:
                    out.append(("url", at, end))
        elif at >= account_end and (found := _account(text, at, at + size)) and found[0] >= account_end:
            account_end = found[1]
            out.append(("account", *found))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id and spans (array of kind, start, end)."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        machine = automaton()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t, machine)] for t in batch.column(1).to_pylist()]
            struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(struct))], names=["doc_id", "spans"])

        return step

    rows = df.select(df[id_col].alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_batches(rows, make, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first is named."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
