"""Personal data in texts: expressions propose spans, checksums confirm them, words nearby move their score.

The base kinds (email, ip, card, phone) are found leftmost and without overlap within a kind, and every match that passes its
check stays whatever its score.  The other kinds need more than their form: a checksum (Luhn for cards, mod 97 for IBANs), a word nearby
that names them, or both, until their score reaches ``THRESHOLD``; a word nearby that names something else takes from it.
Every expression is written so that its work grows with the length of a text, whatever the text is.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farstray.llm.common import small_batches, tidy

THRESHOLD = 0.6
#: What a word nearby that names a kind adds to a score, and what one that names something else takes away.
NEARBY, CONTRARY = 0.3, 0.3
#: So many code points before and after a span are looked at for such words.
BEFORE, AFTER = 48, 24

# Lengths of IBANs by country
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: An email's part from the at sign on.  What stands before it is looked up from there, as searching for it would begin anew at
#: each letter of a long word.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Matches of the next two begin where a chain of digits does, as one that begins within it would have begun there.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
PAN = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")
TEL = re.compile(r"(?<![0-9A-Za-z+._-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ ./-])[0-9]{2,5}(?:[ .-][0-9]{2,5}){0,4}(?![0-9A-Za-z])")
SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: the first four characters go to the end, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str):
    """Spans of the leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``."""
    done = 0
    for m in DOMAIN.finditer(text):
        head = text[max(done, text.rfind("@", done, m.start()) + 1) : m.start()]
        start = m.start() - len(head) + len(head.rstrip(LOCAL))
        if start < m.start():
            yield start, m.end()
            done = m.end()


def ips(text: str):
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            yield m.span()


def cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group()) if m.end() - m.start() <= 37 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            yield m.span()


def _ibans(text: str):
    for m in IBAN.finditer(text):
        least = IBAN_LENGTH.get(m.group()[:2])
        if least is None:
            continue
        at = [i for i, c in enumerate(m.group()) if c != " "]
        if len(at) < least:
            continue
        end = m.start() + at[least - 1] + 1
        if not text[end : end + 1].isalnum() and mod97(text[m.start() : end].replace(" ", "").upper()):
            yield m.start(), end, True


def _pans(text: str):
    for m in PAN.finditer(text):
        if luhn(_digits(m.group())):
            yield m.start(), m.end(), True


def _tels(text: str):
    for m in TEL.finditer(text):
        if 7 <= len(_digits(m.group())) <= 12:
            yield m.start(), m.end(), False


def _ssns(text: str):
    for m in SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.start(), m.end(), False


@dataclass(frozen=True)
class Kind:
    name: str
    find: Callable
    prior: float  # score of the form alone
    confirmed: float  # what a checksum adds
    words: str  # words nearby that name the kind
    others: str = ""  # words nearby that name something else of this form


NUMBERED = "order|invoice|isbn|issn|version|serial|ticket|part|sku|bestellung|rechnung|commande|facture|pedido|factura"
CARD_WORDS = "card|cards|credit|debit|visa|mastercard|amex|karte|kreditkarte|kartennummer|carte|tarjeta"
PHONE_WORDS = "phone|telephone|tel|call|mobile|cell|fax|telefon|handy|anruf|téléphone|portable|teléfono|móvil|llamar"

#: In the order in which spans are written; the first four are the base.
KINDS = (
    Kind("email", emails, 0.9, 0.0, "mail|email|e-mail|contact|correo|courriel"),
    Kind("ip", ips, 0.6, 0.0, "ip|host|server|address|adresse|dirección", "version|release|section|kapitel"),
    Kind("card", cards, 0.2, 0.5, CARD_WORDS, NUMBERED),
    Kind("phone", phones, 0.7, 0.0, PHONE_WORDS, NUMBERED),
    Kind("iban", _ibans, 0.2, 0.6, "iban|account|konto|bank|compte|cuenta|bic|swift", NUMBERED),
    Kind("pan", _pans, 0.1, 0.5, CARD_WORDS, NUMBERED),
    Kind("tel", _tels, 0.3, 0.0, PHONE_WORDS, NUMBERED),
    Kind("ssn", _ssns, 0.3, 0.0, "ssn|social|security|taxpayer", NUMBERED),
)
BASE = 4
_near = [re.compile(rf"(?<!\w)(?:{k.words})(?!\w)") for k in KINDS]
_contrary = [re.compile(rf"(?<!\w)(?:{k.others})(?!\w)") if k.others else None for k in KINDS]


def score(text: str, kind: int, start: int, end: int, confirmed: bool) -> float:
    """Between 0 and 1, in hundredths."""
    k, found = KINDS[kind], KINDS[kind].prior
    around = (text[max(0, start - BEFORE) : start] + " \0 " + text[end : end + AFTER]).lower()
    found += k.confirmed if confirmed else 0
    found += NEARBY if _near[kind].search(around) else 0
    found -= CONTRARY if _contrary[kind] and _contrary[kind].search(around) else 0
    return round(min(1.0, max(0.0, found)), 2)


def spans(text: str) -> list[tuple[int, int, int, float]]:
    """(place in ``KINDS``, start, end, score) of all spans in that order; added ones overlap no other span."""
    out, taken = [], []  # taken: disjoint (start, end) in order, of all kinds so far
    for kind, k in enumerate(KINDS[:BASE]):
        out += [(kind, *s, score(text, kind, *s, True)) for s in k.find(text)]
    for start, end in sorted(s[1:3] for s in out):
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))
    for kind in range(BASE, len(KINDS)):
        new = []
        for start, end, confirmed in KINDS[kind].find(text):
            i = bisect_left(taken, (end,))
            if (not i or taken[i - 1][1] <= start) and (s := score(text, kind, start, end, confirmed)) >= THRESHOLD:
                new.append((kind, start, end, s))
        out += new
        if new:
            taken = sorted(taken + [s[1:3] for s in new])
    return out


def written(found) -> str:
    return ",".join(f"{KINDS[s[0]].name}:{s[1]}:{s[2]}" for s in found)


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans and scores of every text.

    Places are code points, ends exclusive; ``scores`` has a number for each of ``spans``.  Null and empty texts have no spans
    (counts 0, the digest of nothing, empty strings).  Rows are independent, so there is no shuffle; repeated rows stay
    repeated, null keys stay null, and other columns are ignored whatever their names.
    """
    kind = docs.schema[key].dataType.simpleString()
    counts = [f"n_{k.name}" for k in KINDS[:BASE]]
    schema = f"`{key}` {kind}, {' long, '.join(counts)} long, base_sha256 string, spans string, scores string"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for value in batch.column(1):
                found = spans(value.as_py() or "")
                base = [s for s in found if s[0] < BASE]
                numbers = [sum(s[0] == i for s in base) for i in range(BASE)]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((*numbers, digest, written(found), ",".join(f"{s[3]:.2f}" for s in found)))
            columns = [pa.array([r[i] for r in rows], pa.int64() if i < BASE else pa.string()) for i in range(BASE + 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *counts, "base_sha256", "spans", "scores"])

    small_batches(docs.sparkSession)
    return docs.select(key, "text").mapInArrow(tidy(run), schema)


def redacted(text: str, mark: str = "[{kind}]") -> str:
    """``text`` with its spans replaced; of overlapping ones the first, the longest if they begin together, gives the mark."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], mark.format(kind=KINDS[kind].name)]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """``docs`` with personal data of text replaced by marks that name its kind.  Null stays null; all rows and columns stay."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redacted(t, mark))

    return docs.withColumn("text", clean(F.col("text")))
