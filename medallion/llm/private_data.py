"""Personal data by anchors.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues in one
pass over a text. From every anchor a small parser walks to both ends of what may be an email
address, a network address, a card or phone number, an address with a user in it or an account
identifier, and checks it. No parser looks at a character more than a fixed number of times, so
the work is linear in the text, whatever it holds.

Texts are parsed whole, one after the other, where they are; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

BASE = ("email", "ip", "card", "phone")  # in the order of the spans
KINDS = (*BASE, "account", "address")

# Characters of the parts of an address, and the words that announce one.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "smb://", "imap://", "redis://",
           "mongodb://", "mysql://", "postgres://", "postgresql://", "amqp://")
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "customer id", "user id",
        "member id", "token", "api_key", "api key", "apikey", "access_key", "secret_key")
# End of the fixed values.

# Where a part ends: the first character that can't belong to it.
_LABELS_END = re.compile(r"[^A-Za-z0-9.-]|\.(?:[^A-Za-z0-9-]|\Z)|\Z")
_NUMBERS_END = re.compile(r"[^0-9.]|\.(?:[^0-9]|\Z)|\Z")
_DIGITS_END = re.compile(r"[^0-9 -]|[ -](?:[^0-9]|\Z)|\Z")
_CALL_END = re.compile(r"[^ ().0-9-]|\Z")
_AUTHORITY_END = re.compile(r"[\s/?#\"'<>|\\]|\Z")
_LINK = re.compile(r"[ \t]{0,3}(?:(?:no|number|nr|id)\b\.?[ \t]{0,3})?(?:[:=#]{1,2}[ \t]{0,3})?[\"']?",
                   re.ASCII | re.IGNORECASE)
_IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,79}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_HOST = re.compile(r"(?:\[[0-9A-Fa-f:.]{2,45}\]|[A-Za-z0-9.-]{1,253})(?::[0-9]{1,5})?")

Span = tuple[str, int, int]


def automaton() -> ahocorasick.Automaton:
    """The anchors. Cues are known in lower and upper case and with a capital letter."""
    found = ahocorasick.Automaton()
    for mark, kind in (("@", "email"), ("+", "phone"), *((d, "digits") for d in "0123456789")):
        found.add_word(mark, (kind, 1))
    for scheme in SCHEMES:
        for form in (scheme, scheme.upper()):
            found.add_word(form, ("address", len(form)))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize(), cue.title()):
            found.add_word(form, ("account", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    twice = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(twice) + sum(int(d) for d in digits[::-2])) % 10 == 0


def iban(text: str) -> bool:
    """Whether the check digits of an international account number are right."""
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The address around the at-sign ``at``, of which nothing lies before ``least``."""
    begin = least + len(text[least:at].rstrip(LOCAL))
    end = _LABELS_END.search(text, at + 1).start()
    domain = text[at + 1:end]
    return (begin, end) if begin < at and "." in domain and domain[0] != "." else None


def _addresses(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Four numbers up to 255 at a time of a chain of numbers with points between them."""
    parts, starts, at = text[begin:end].split("."), [], begin
    for part in parts:
        starts.append(at)
        at += len(part) + 1
    for i in range(0, len(parts) - 3, 4):
        four = [p.lstrip("0") for p in parts[i:i + 4]]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in four):
            yield starts[i], starts[i + 3] + len(parts[i + 3])


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    if not ("0" <= text[plus + 1:plus + 2] <= "9"):
        return None
    run = text[plus + 2:_CALL_END.search(text, plus + 2).start()].rstrip(" ().-")
    digits = 1 + sum(map(run.count, "0123456789"))
    return (plus, plus + 2 + len(run)) if len(run) > 1 and 9 <= digits <= 15 else None


def _authority(text: str, begin: int) -> tuple[int, int] | None:
    """User, host and port behind a scheme, if a user is named and the host may exist."""
    end = _AUTHORITY_END.search(text, begin).start()
    user, sign, host = text[begin:end].rpartition("@")
    whole = _HOST.match(host)
    if not (sign and user and whole):
        return None
    name = whole.group()
    plain = name.rpartition(":")[0] if ":" in name and name[0] != "[" else name
    if name[0] != "[" and any(not label for label in plain.rstrip(".").split(".")):
        return None
    return begin, begin + len(user) + 1 + len(name.rstrip(".-"))


def _account(text: str, begin: int, end: int) -> tuple[int, int] | None:
    """The identifier behind the cue at ``begin``: linked to it by a sign or a word, with four
    digits at least; an international account number has right check digits."""
    if (begin and text[begin - 1].isalnum()) or text[end:end + 1].isalnum():
        return None
    link = _LINK.match(text, end)
    at = link.end()
    international = _IBAN.match(text, at)
    if international:
        for stop in range(international.end(), at + 14, -1):
            if text[stop - 1] != " " and not text[stop:stop + 1].isalnum() \
                    and iban(text[at:stop]):
                return at, stop
    found = _IDENTIFIER.match(text, at)
    if not (link.group().strip() and found):
        return None
    name = found.group().rstrip("_-")
    digits = sum(map(name.count, "0123456789"))
    whole = not text[found.end():found.end() + 1].isalnum()
    return (at, at + len(name)) if whole and 6 <= len(name) <= 64 and digits >= 4 else None


def spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans of a text as (kind, start, end), in code points, by kind and start.

    Spans of the base kinds are the leftmost matches that do not overlap, of those the ones that
    pass their check; a match that fails is used up. Spans of different kinds may overlap.
    """
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    last_at = email = numbers = digits = account = address = 0
    for at, (kind, length) in anchors.iter(text):
        if kind == "digits":
            if at >= digits:
                digits = _DIGITS_END.search(text, at).start()
                chain = text[at:digits].replace(" ", "").replace("-", "")
                if 13 <= len(chain) <= 19 and luhn(chain):
                    found["card"].append((at, digits))
            if at >= numbers:
                numbers = _NUMBERS_END.search(text, at).start()
                if numbers - at >= 7:
                    found["ip"].extend(_addresses(text, at, numbers))
        elif kind == "email":
            span = _email(text, at, max(email, last_at))
            last_at = at + 1
            if span:
                email = span[1]
                found["email"].append(span)
        elif kind == "phone":
            span = _phone(text, at)
            if span:
                found["phone"].append(span)
        elif kind == "address":
            if at + 1 >= address:
                span = _authority(text, at + 1)
                address = max(at + 1, _AUTHORITY_END.search(text, at + 1).start())
                if span:
                    found["address"].append(span)
        elif at + 1 - length >= account:
            span = _account(text, at + 1 - length, at + 1)
            if span:
                account = span[1]
                found["account"].append(span)
    return [(kind, begin, end) for kind in KINDS for begin, end in found[kind]]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def detected(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans) for every row: ``spans`` lists kind, start and end of what was found.

    Starts and ends count code points, ends are exclusive; the list is ordered by kind, as in
    ``KINDS``, and start. A null or empty text has no spans; rows equal in all columns each get
    their own row; an empty table gives no rows.
    """
    def run(batches):
        anchors = automaton()
        for batch in batches:
            rows = [[{"kind": k, "start": b, "end": e} for k, b, e in spans(t, anchors)] if t
                    else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(SPAN))], ["id", "spans"])

    kind = docs.schema[identity].dataType.simpleString()
    return docs.select(F.col(identity).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, spans array<struct<kind: string, start: int, end: int>>")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the kind, in angle brackets, in the place of everything found in ``text``.

    Spans that overlap become one place, named after the first. Other columns, null and empty
    texts are kept as they are.
    """
    place, = fresh(docs.columns, "_masked")

    def cover(whole: str, anchors) -> str:
        kept, at = [], 0
        for begin, end, kind in sorted((b, -e, k) for k, b, e in spans(whole, anchors)):
            if begin >= at:
                kept += [whole[at:begin], f"<{kind}>"]
            at = max(at, -end)
        return "".join([*kept, whole[at:]])

    def run(batches):
        anchors = automaton()
        for batch in batches:
            texts = [t and cover(t, anchors) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, place])

    changed = docs.mapInArrow(run, docs.withColumn(place, F.col(text)).schema)
    return changed.select(*[F.col(place).alias(c) if c == text else F.col(c)
                            for c in docs.columns])
