"""Personal data: expressions propose spans, checks confirm them, nearby words adjust their score.

Base kinds are e-mail and IP addresses, card numbers (Luhn's check) and
international phone numbers; a span of theirs that passes its check is always
reported. Further kinds are IBANs (remainder by 97), bank routing numbers
(weights 3, 7, 1), social security numbers and national phone numbers; these
are reported from a score of `LEAST` on, which all but IBANs reach only beside
a word that speaks for them, and where no other span lies.

Expressions are matched leftmost, without overlaps, one kind apart from the
others. Each is put so that its time grows with the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks

BASE = ("email", "ip", "card", "phone")
#: Score from which further kinds are reported; code points before and after a span in which words count; what a word for or against it adds.
LEAST, NEAR, FOR, AGAINST = 0.5, 48, 0.25, -0.3
#: Bytes of text that a worker looks at together (one text at least).
BATCH_BYTES = 4_000_000

_NOT_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`.

    Found from each @ backwards, as the expression itself takes a time that
    grows with the square of a run of its first characters.
    """
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def luhn(digits: str) -> bool:
    """Luhn's check: every second digit from the right doubled, digits of all summed, divisible by 10."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    """The IBAN's check: the first four characters at the end, letters as 10 to 35, remainder 1 by 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def routing_sum(digits: str) -> bool:
    """The check of nine-digit routing numbers: weights 3, 7, 1, divisible by 10."""
    return any(c != "0" for c in digits) and sum(w * int(d) for w, d in zip((3, 7, 1) * 3, digits, strict=True)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))


def _is_card(found: str) -> bool:
    d = _digits(found)
    return 13 <= len(d) <= 19 and luhn(d)


def _is_phone(found: str) -> bool:
    return 9 <= len(_digits(found)) <= 15


def _is_ssn(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


#: Lengths of IBANs by country. Fixed values.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,28}")


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """IBANs in capitals, single spaces allowed, cut to their country's length; letters or digits may not follow."""
    for m in _IBAN.finditer(text):
        need, end, seen = IBAN_LENGTHS.get(m[0][:2], 0), m.start(), ""
        while end < m.end() and len(seen) < need:
            seen += text[end].strip()
            end += 1
        if need and len(seen) == need and not (end < len(text) and text[end].isalnum()) and mod_97(seen):
            yield m.start(), end


def _matches(pattern: str, check: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    known = re.compile(pattern)
    return lambda text: (m.span() for m in known.finditer(text) if check(m[0]))


@dataclass(frozen=True)
class Kind:
    """How spans of a kind are found, the score of one that passed its check, and words that speak for or against it."""

    name: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    score: float
    words: frozenset[str]
    against: frozenset[str] = frozenset()


#: Kinds in the order in which spans are listed. A digit run is entered at its first digit alone.
KINDS = (
    Kind("email", emails, 0.9, frozenset("mail email e-mail contact correo courriel kontakt".split())),
    Kind("ip", _matches(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _is_ip), 0.6, frozenset("ip address host server adresse".split()), frozenset("version release chapter section".split())),
    Kind("card", _matches(r"[0-9](?:[ -]?[0-9])+", _is_card), 0.7, frozenset("card credit visa mastercard karte carte tarjeta".split()), frozenset("isbn order tracking serial".split())),
    Kind("phone", _matches(r"\+[0-9][ ().0-9-]+[0-9]", _is_phone), 0.7, frozenset("phone tel call mobile fax telefon mobil".split())),
    Kind("iban", ibans, 0.9, frozenset("iban account konto compte cuenta".split())),
    Kind("routing", _matches(r"(?<![0-9A-Za-z.+-])[0-9]{9}(?![0-9A-Za-z-])", routing_sum), 0.3, frozenset("routing aba bank account".split()), frozenset("order invoice".split())),
    Kind("ssn", _matches(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", _is_ssn), 0.4, frozenset("ssn social security".split()), frozenset("part order".split())),
    Kind("national_phone", _matches(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /-])[0-9]{3,4}[ -]?[0-9]{3,5}(?![0-9A-Za-z-])", _is_phone), 0.3, frozenset("phone tel call mobile fax telefon mobil".split())),
)
_NAMES = tuple(k.name for k in KINDS)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def _scored(kind: Kind, text: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start]) + _WORD.findall(text[end : end + NEAR])}
    return round(min(1.0, max(0.0, kind.score + FOR * bool(near & kind.words) + AGAINST * bool(near & kind.against))), 6)


def spans_of(text: str) -> list[tuple[int, int, int, float]]:
    """(index of its kind, start, end, score) of the text's spans, in code points, by kind, then start."""
    out: list[tuple[int, int, int, float]] = []
    has_digits = bool(text.encode("utf-8", "surrogatepass").translate(None, _NOT_DIGITS))
    for i, kind in enumerate(KINDS):
        if not ("@" in text if kind.name == "email" else has_digits):
            continue
        base, taken = kind.name in BASE, list(out)
        for start, end in kind.find(text):
            score = _scored(kind, text, start, end)
            free = base or kind.name == "iban" or not any(a < end and start < b for _, a, b, _ in taken)
            if base or (free and score >= LEAST):
                out.append((i, start, end, score))
    return out


def _worker(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in blocks(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False) + 1, BATCH_BYTES):
                part = batch.slice(i, j - i)
                found = [spans_of(t or "") for t in part.column(1).to_pylist()]
                rows = [s for spans in found for s in spans]
                kinds, starts, ends, scores = zip(*rows, strict=True) if rows else ((), (), (), ())
                fields = [pa.array([_NAMES[k] for k in kinds], pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(scores, pa.float64())]
                offsets = [0]
                for spans in found:
                    offsets.append(offsets[-1] + len(spans))
                spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "start", "end", "score"]))
                yield pa.RecordBatch.from_arrays([part.column(0), spans], [key, "spans"])

    return run


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `spans` (array of `kind`, `start`, `end`, `score`; by kind as in `KINDS`, then start) for each row.

    Places are code points, the end exclusive. Spans of different kinds may
    overlap. Null and empty texts have no spans; repeated rows and null keys
    stay. Texts count whole at any length; further columns are ignored. An
    empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_worker(key), f"`{key}` {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, of the kind of the first and longest. A null text stays null."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["end"] == b["end"], 0).otherwise(F.when(a["end"] > b["end"], -1).otherwise(1)))
    begin = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, s: Column) -> Column:
        cut = F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        added = F.struct(F.concat(done["text"], cut, F.lit("["), s["kind"], F.lit("]")).alias("text"), s["end"].alias("at"))
        longer = F.struct(done["text"].alias("text"), F.greatest(done["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= done["at"], added).otherwise(longer)

    return F.aggregate(ordered, begin, step, lambda x: F.concat(x["text"], F.substring(text, (x["at"] + 1).cast("int"), F.length(text))))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key`, the number of spans of each base kind, a hash of these spans, and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(key, *map(count, BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
