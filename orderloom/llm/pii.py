"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Each proposer yields spans of one kind; a validator (octet range, Luhn, mod-97, digit count) drops the false ones;
words near a span raise its score. Kinds whose pattern alone is proof enough (email, ip, card, phone, iban, keys of known
form) are always above the threshold; a bare local phone number, social-security-like number or secret needs a context word.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import slices, tidy


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


BASE_KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, so later starts inside the run are not tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
#: Keys and tokens by the prefixes that their issuers publish, private keys and signed tokens; KEY_MARKS tells most texts apart.
KEY = re.compile(
    r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9-]{10,250}|[sr]k[-_][A-Za-z0-9_-]{20,250}"
    r"|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,1000})(?![A-Za-z0-9_-])|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
)
KEY_MARKS = ("AKIA", "ASIA", "_", "xox", "k-", "AIza", "eyJ", "-----BEGIN ")
SECRET = re.compile(r"(?<![^\s=:\"'(\[{])(?=[^\s\"',;]{0,40}[0-9!@#$%^&*])[A-Za-z0-9][^\s\"',;=:]{5,127}")
SECRET_WORD = re.compile(r"(?:password|passwd|pwd|passphrase|secret|api[ _-]?key|token)[\"']?(?: is)?\s{0,3}[:=]?\s{0,3}[\"']?", re.IGNORECASE)
NOT_DIGIT = re.compile(r"[^0-9]+")
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "tarjeta", "carte", "karte"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "telefon", "tél", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "national_id": ("ssn", "social", "security"),
    "local_phone": ("call", "phone", "tel", "mobile", "fax", "telefon", "tél", "teléfono"),
    "key": ("key", "token", "secret", "credential", "credentials"),
    "secret": ("password", "passwd", "pwd", "passphrase", "secret", "key", "token"),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.75, "iban": 0.9, "national_id": 0.4, "local_phone": 0.4, "key": 0.9, "secret": 0.4}
THRESHOLD, CONTEXT_BONUS, CONTEXT_CHARS = 0.5, 0.2, 40
WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the country and check digits go to the end, letters count as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As a scan with the whole pattern would, but found from the at signs, so that long runs stay linear."""
    done = last = 0
    at = text.find("@")
    while at >= 0:
        head = text[max(done, last) : at]
        start = at - len(head) + len(head.rstrip(LOCAL))
        last = at + 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Validated spans of every kind, in the order of kinds, then start."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", *m.span()
    for m in IBAN.finditer(text):
        if 15 <= len(s := m[0].replace(" ", "")) <= 34 and mod97(s):
            yield "iban", *m.span()
    for m in NATIONAL.finditer(text):
        yield "national_id", *m.span()
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", *m.span()
    if any(x in text for x in KEY_MARKS):
        for m in KEY.finditer(text):
            yield "key", *m.span()
    for word in SECRET_WORD.finditer(text):
        if m := SECRET.match(text, word.end()):
            yield "secret", *m.span()


class Covered:
    """Disjoint stretches in order; tells whether a span meets one."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def add(self, start: int, end: int) -> bool:
        """False if the span meets a stretch; otherwise it becomes one."""
        at = bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def find_spans(text: str | None) -> list[Span]:
    """Spans over the threshold. Base kinds are never dropped; others must not overlap a base span or one another."""
    found: list[Span] = []
    if not text:
        return found
    covered = None
    for kind, start, end in proposals(text):
        near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS // 2]
        score = min(1.0, PRIOR[kind] + CONTEXT_BONUS * (not set(WORD.findall(near.lower())).isdisjoint(CONTEXT[kind])))
        if kind in BASE_KINDS:
            found.append(Span(kind, start, end, score))
        elif score >= THRESHOLD:
            covered = covered or Covered([(s.start, s.end) for s in found])
            if covered.add(start, end):
                found.append(Span(kind, start, end, score))
    return found


SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id and its spans (kind, start, end in code points, score).

    Null and empty texts have no spans; repeated rows give repeated rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                spans = [[s._asdict() for s in find_spans(t)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets, other columns unchanged."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cleaned(texts):
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for s in sorted(find_spans(text), key=lambda s: (s.start, -s.end)):
                if s.start >= at:
                    out += [text[at : s.start], f"<{s.kind}>"]
                    at = s.end
            return "".join([*out, text[at:]])

        return texts.map(one, na_action=None)

    return docs.withColumn(text_col, cleaned(F.col(text_col)))


def op6_pii(docs: DataFrame) -> DataFrame:
    """The digest of the spans that pii_spans finds; n_spans counts all kinds, scores are in the order of spans."""
    spans = pii_spans(docs)
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return spans.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(F.concat_ws(",", F.transform(base, text)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", text)).alias("spans"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.concat_ws(",", F.transform("spans", lambda s: F.format_number(s["score"], 2))).alias("scores"),
    )
