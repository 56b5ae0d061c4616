"""Personal data in texts by anchor expansion.

Method: an Aho-Corasick automaton finds anchors in one pass over a text:
at-signs, plus signs, digits, schemes and identifier cues.  From an anchor a
deterministic local parser expands to both sides and validates what it finds.
Every parser is linear: it never reads a character twice for one kind.
"""

from __future__ import annotations

import hashlib
import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ready

#: Kinds in the order that breaks ties of position; the first four have the base definitions.
KINDS = ("email", "ip", "card", "phone", "account", "masked", "url", "secret")
#: Words that announce an account number, key or document number.
CUES = ("iban", "account", "acct", "konto", "kontonummer", "cuenta", "compte", "ssn", "routing number", "passport")
#: Words that announce a secret.
SECRETS = ("api_key", "api-key", "api key", "apikey", "secret", "secret_key", "client_secret", "token", "access_token", "auth_token", "bearer", "password", "passwd", "private_key")
#: Characters of a secret at least, and different ones among them: what a word or a number has not.
SECRET_LENGTH, SECRET_SIGNS = 12, 8
#: What known keys begin with, and their whole form.
PREFIXES = {"AKIA": r"AKIA[A-Z0-9]{16}", "ghp_": r"ghp_[A-Za-z0-9]{36}", "sk_live_": r"sk_live_[A-Za-z0-9]{16,}", "-----BEGIN ": r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"}
#: Cues after which, with = or : at once, any value of so many characters is a secret.
PASSWORDS, PASSWORD_LENGTH = frozenset(["password", "passwd"]), 6
#: Bracketed at-signs of masked addresses.
MASKS = ("[at]", "(at)", "{at}")

_DIGITS = frozenset(string.digits)
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_RUN = re.compile(r"[0-9.]+")
_CARD_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE_RUN = re.compile(r"\+[0-9][\x20().0-9-]+")
_VALUE = re.compile(r"\W{0,4}(?:(?:no|nr|number|is)\b\W{0,3})?([A-Za-z0-9][A-Za-z0-9-]*(?: [A-Z0-9]{2,4}\b)*)")
_SECRET = re.compile(r"['\"]?(?:[\x20\t]{0,3}[=:][\x20\t]{0,3}|[\x20\t]{1,3}(?:is[\x20\t]{1,3})?)['\"]?([A-Za-z0-9_+/.=~-]+)")
_PASSWORD = re.compile(r"[=:]['\"]?([^\s'\"&;,<>]+)")
_KEYS = {k.lower(): re.compile(v + r"(?![A-Za-z0-9])") for k, v in PREFIXES.items()}
_FOLD = {c: c + 32 for c in range(65, 91)}
_MASKED = re.compile(r"[\[({]at[\])}] ?([A-Za-z0-9-]+(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]+)+)", re.I)
_SCHEME = frozenset(string.ascii_letters + string.digits + "+.-")
_URL_END = re.compile(r"[\s<>\"'`{}|\\^]")

Span = tuple[int, int, int]  # start, kind as an index of KINDS, end


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn checksum."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def automaton():
    """The automaton over all anchors; its values say which parser an anchor starts."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in string.digits:
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for cue in CUES:
        a.add_word(cue, ("cue", len(cue)))
    for cue in SECRETS:
        a.add_word(cue, ("secret", len(cue)))
    for prefix in _KEYS:
        a.add_word(prefix, ("key", len(prefix)))
    for mask in MASKS:
        a.add_word(mask, ("mask", len(mask)))
    a.make_automaton()
    return a


def _ips(text: str, start: int, stop: int) -> list[Span]:
    """Addresses within a maximal run of digits and dots: four parts each, taken from the left."""
    found, parts, at = [], [], start
    for part in [*text[start:stop].split("."), ""]:
        if part:
            parts.append((at, at + len(part)))
        if len(parts) == 4:
            if all(int(text[a:b].lstrip("0")[:4] or 0) <= 255 for a, b in parts):
                found.append((parts[0][0], 1, parts[3][1]))
            parts = []
        elif not part:
            parts = []
        at += len(part) + 1
    return found


def _iban(value: str) -> bool:
    """Whether the remainder of an IBAN's number by 97 is 1; it has 15 to 34 signs."""
    if not 15 <= len(value) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _valid(cue: str, value: str) -> bool:
    """Whether an account value keeps the rules of its kind, where the cue or its form names one."""
    plain = value.replace(" ", "").replace("-", "").upper()
    if cue == "iban" or re.match(r"[A-Z]{2}[0-9]{2}", plain) and 15 <= len(plain) <= 34 and cue != "passport":
        return plain[:2].isalpha() and _iban(plain)
    if cue == "ssn":
        return len(plain) == 9 and plain.isdigit() and plain[:3] not in ("000", "666") and plain[0] != "9" and plain[3:5] != "00" and plain[5:] != "0000"
    if cue == "routing number":
        return len(plain) == 9 and plain.isdigit() and plain != "0" * 9 and sum(int(c) * w for c, w in zip(plain, (3, 7, 1) * 3, strict=True)) % 10 == 0
    return True


def _account(text: str, end: int, cue: str) -> Span | None:
    m = _VALUE.match(text, end)
    if not m:
        return None
    value = m.group(1)
    if len(value) < 6 or sum(c in _DIGITS for c in value) < 4 or not _valid(cue, value):
        return None
    return m.start(1), 4, m.end(1)


def _secret(text: str, end: int, cue: str) -> Span | None:
    """A value after a cue that mixes letters and digits as no word does; a password's need not."""
    if cue in PASSWORDS and (m := _PASSWORD.match(text, end)) and len(m.group(1).rstrip(".")) >= PASSWORD_LENGTH:
        return m.start(1), 7, m.start(1) + len(m.group(1).rstrip("."))
    m = _SECRET.match(text, end)
    if not m:
        return None
    value = m.group(1).rstrip(".")
    if len(value) < SECRET_LENGTH or len(set(value)) < SECRET_SIGNS or value.isdigit() or not any(c in _DIGITS for c in value):
        return None
    return m.start(1), 7, m.start(1) + len(value)


def spans(text: str, anchors) -> list[Span]:
    """All spans of a text by start, then kind."""
    found: list[Span] = []
    email_end = ip_end = card_end = url_end = secret_end = account_end = 0
    folded = text.translate(_FOLD)  # A-Z only, so places stay
    for last, (what, length) in anchors.iter(folded):
        at = last - length + 1
        if what == "digit":
            if at >= ip_end:
                m = _IP_RUN.match(text, at)
                ip_end = m.end()
                if ip_end - at >= 7:
                    found += _ips(text, at, ip_end)
            if at >= card_end:
                m = _CARD_RUN.match(text, at)
                card_end = m.end()
                if card_end - at >= 14:
                    digits = "".join(c for c in m.group() if c in _DIGITS)
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append((at, 2, card_end))
        elif what == "at":
            left = at
            while left > email_end and text[left - 1] in _LOCAL:
                left -= 1
            if left < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found.append((left, 0, email_end))
        elif what == "plus":
            if m := _PHONE_RUN.match(text, at):
                end = m.end()
                while text[end - 1] not in _DIGITS:
                    end -= 1
                if end - at >= 4 and 10 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                    found.append((at, 3, end))
        elif what == "cue":
            before, after = text[at - 1 : at], text[last + 1 : last + 2]
            if not before.isalnum() and not after.isalnum() and last >= account_end and (s := _account(text, last + 1, folded[at : last + 1])):
                found.append(s)
                account_end = s[2]
        elif what == "secret":
            before, after = text[at - 1 : at], text[last + 1 : last + 2]
            if not before.isalnum() and not after.isalnum() and after not in ("_", "-") and last >= secret_end and (s := _secret(text, last + 1, folded[at : last + 1])):
                found.append(s)
                secret_end = s[2]
        elif what == "key":
            if at >= secret_end and not text[at - 1 : at].isalnum() and (m := _KEYS[folded[at : last + 1]].match(text, at)):
                found.append((at, 7, m.end()))
                secret_end = m.end()
        elif what == "mask":
            left = at - (text[at - 1 : at] == " ")
            start = left
            while start > 0 and text[start - 1] in _LOCAL:
                start -= 1
            if start < left and (m := _MASKED.match(text, at)):
                found.append((start, 5, m.end()))
        elif at >= url_end:
            left = at
            while left > 0 and text[left - 1] in _SCHEME:
                left -= 1
            m = _URL_END.search(text, last + 1)
            end = m.start() if m else len(text)
            while end > last + 1 and text[end - 1] in ".,;:!?)]":
                end -= 1
            if left < at and end > last + 1:
                found.append((left, 6, end))
            url_end = max(end, last + 1)
    return sorted(set(found))


def _joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


_COLUMNS = ["doc_id", *[f"n_{k}" for k in KINDS[:4]], "base_sha256", "spans", *[f"n_{k}" for k in KINDS[4:]]]


def _run(batches):
    anchors = automaton()
    for batch in batches:
        counts, base, every = [[] for _ in KINDS], [], []
        for text in batch.column(1).to_pylist():
            found = spans(text, anchors) if text else []
            own = [s for s in found if s[1] < 4]
            for k in range(len(KINDS)):
                counts[k].append(sum(s[1] == k for s in found))
            base.append(hashlib.sha256(_joined(own).encode()).hexdigest())
            every.append(_joined(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts[:4]], pa.array(base, pa.string()), pa.array(every, pa.string()), *[pa.array(c, pa.int64()) for c in counts[4:]]], _COLUMNS)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_account, n_masked, n_url, n_secret) for every row of ``docs``.

    Base kinds are leftmost and do not overlap within a kind:
    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``;
    ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of at most 255;
    card ``[0-9]([\\x20-]?[0-9])+`` with 14 to 19 digits that pass Luhn;
    phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 10 to 15 digits.  The method
    adds accounts and secrets after a cue word (in any case), keys by their
    prefix, addresses with a bracketed at, and URLs.  An IBAN must pass its
    remainder by 97, a routing number its checksum, an SSN its rules of parts.
    ``spans`` joins kind:start:end (code points, end exclusive) by comma, by
    start, then kind; base_sha256 is the SHA-256 of the base ones so joined.
    Null and empty texts have no span.  One pass, no shuffle; repeated rows
    give repeated results; a null doc_id stays null; other columns are ignored;
    an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_run, ", ".join(f"{c} {'string' if c in ('base_sha256', 'spans') else 'long'}" for c in _COLUMNS))
