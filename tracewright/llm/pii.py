"""Personal data, also where it is disguised, with spans in the text as it was given.

Small transducers rewrite a text: homoglyphs to ASCII, runs of spelled digits to digits, "(at)" and "dot" to their
signs. Each rewritten character remembers which characters it came from, so that what the detectors find in the
rewritten text maps back to a span of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .common import over_texts, rewrite_texts, table

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+` finds, in time linear in the text: from sign to sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = max(done, at)
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40 and 12 <= len(digits := DIGITS.findall(m[0])) <= 19:
            values = [int(d) for d in reversed(digits)]
            if (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0:
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m[0])) <= 15:
            yield m.span()


DETECTORS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))
Span = tuple[int, int, int]


def detect(text: str) -> list[Span]:
    """start, number of the kind, end of all plain identifiers, in this order."""
    return sorted((start, k, end) for k, kind in enumerate(KINDS) for start, end in DETECTORS[kind](text))


#: Letters of other scripts that look like ASCII ones.
LOOKALIKES = {
    **dict(zip("аеорсхуіјѕһԁԛԝАВЕКМНОРСТХІЅЈ", "aeopcxyijshdqwABEKMHOPCTXISJ", strict=True)),
    **dict(zip("οανικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavikptuxABEZHIKMNOPTYX", strict=True)),
    **dict(zip("․。｡﹒﹫﹢‐‑‒–—−", "....@+------", strict=True)),
}
HOMOGLYPH = re.compile("[" + re.escape("".join(LOOKALIKES)) + "٠-٩۰-۹०-९！-～\U0001d400-\U0001d7ff]")
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
DIGIT_WORD = "(?:" + "|".join(SPELLED) + ")"
#: At least three spelled digits in a row, joined by at most two blanks, commas, dots or hyphens, perhaps with a spelled
#: "dot" among them, perhaps after "plus".
SPELLED_RUN = re.compile(rf"\b(?:plus[ ,-]{{1,2}})?{DIGIT_WORD}(?:[ ,.-]{{1,2}}(?:dot[ ,.-]{{1,2}})?{DIGIT_WORD}){{2,}}\b", re.I)
SPELLED_SIGN = {**SPELLED, "plus": "+", "dot": "."}
SPELLED_PART = re.compile(rf"plus|{DIGIT_WORD}|dot", re.I)
#: Signs spelled in brackets, or plainly where an address follows: "name at host dot com".
BRACKETED = re.compile(r" ?([\[({<]) ?(at|dot) ?([\])}>]) ?", re.I)
PLAIN_ADDRESS = re.compile(r"(?<=[A-Za-z0-9])( at )(?=[A-Za-z0-9-]+(?: dot | ?[\[({<] ?dot ?[\])}>] ?|\.)[A-Za-z0-9-]{2,})", re.I)
PLAIN_DOT = re.compile(r"(?<=[A-Za-z0-9])( dot )(?=[A-Za-z0-9-]{1,63})", re.I)
#: What each of the three needs at least.
HINT = re.compile(r"\bdot\b| at |[\[({<] ?at ?[\])}>]", re.I)


def _plain_letter(c: str) -> str:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    digit = unicodedata.decimal(c, None)
    plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else c


class Rewritten:
    """A text after some transducers; first[i] and last[i]: the source span of its i-th character."""

    def __init__(self, text: str) -> None:
        self.text, self.first, self.last = text, range(len(text)), range(1, len(text) + 1)

    def put(self, pieces: list[tuple[int, int, str]]) -> None:
        """Replace spans of the present text. Each replacement comes from its whole span, or letter by letter if as long."""
        if not pieces:
            return
        out, first, last, at = [], [], [], 0
        for start, end, new in pieces:
            out += [self.text[at:start], new]
            first += self.first[at:start]
            last += self.last[at:start]
            if len(new) == end - start:
                first += self.first[start:end]
                last += self.last[start:end]
            else:
                first += [self.first[start]] * len(new)
                last += [self.last[end - 1]] * len(new)
            at = end
        out.append(self.text[at:])
        self.first, self.last, self.text = [*first, *self.first[at:]], [*last, *self.last[at:]], "".join(out)


def rewrite(text: str) -> Rewritten | None:
    """The text without disguises; None if it has none."""
    out = Rewritten(text)
    if not text.isascii():
        out.put([(m.start(), m.end(), _plain_letter(m[0])) for m in HOMOGLYPH.finditer(text)])
    runs = []
    for m in SPELLED_RUN.finditer(out.text):
        for part in SPELLED_PART.finditer(m[0]):
            # What parts two spelled digits goes with the first.
            end = part.end()
            while end < len(m[0]) and m[0][end] in " ,":
                end += 1
            runs.append((m.start() + part.start(), m.start() + end, SPELLED_SIGN[part[0].lower()]))
    out.put(runs)
    if HINT.search(out.text):
        out.put([(m.start(), m.end(), "@" if m[2].lower() == "at" else ".") for m in BRACKETED.finditer(out.text)])
        out.put([(m.start(), m.end(), "@") for m in PLAIN_ADDRESS.finditer(out.text)])
        # Plain dots count after a sign that stands for "at", and between numbers.
        dots = []
        for m in PLAIN_DOT.finditer(out.text):
            before = out.text[max(0, m.start() - 80) : m.start()].rpartition(" ")[2]
            if "@" in before or (before[-1:].isdigit() and out.text[m.end()].isdigit()) or (dots and dots[-1][1] + 64 > m.start() and " " not in out.text[dots[-1][1] : m.start()]):
                dots.append((m.start(), m.end(), "."))
        out.put(dots)
    return out if out.text != text else None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Plain identifiers; and all: those and the disguised ones that touch none of their own kind."""
    base = detect(text)
    changed = rewrite(text)
    if changed is None:
        return base, base
    more = set(base)
    taken = {k: [(s, e) for s, kind, e in base if kind == k] for k in range(len(KINDS))}
    for start, k, end in detect(changed.text):
        a, b = changed.first[start], changed.last[end - 1]
        # Blanks that a replacement took along aren't part of the find.
        while b > a and text[b - 1] in " ,":
            b -= 1
        while a < b and text[a] == " ":
            a += 1
        if all(e <= a or b <= s for s, e in taken[k]):
            more.add((a, k, b))
    return base, sorted(more)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of kind, start, end (code points, end exclusive), plain (whether undisguised).

    A null or empty text has none; each row stands for itself; other columns are ignored; an empty table gives no rows.
    """

    def make():
        def work(keys: list, texts: list[str]) -> dict:
            out = []
            for text in texts:
                base, every = find(text)
                plain = set(base)
                out.append([{"kind": KINDS[s[1]], "start": s[0], "end": s[2], "plain": s in plain} for s in every])
            return {"doc_id": keys, "spans": out}

        return work

    return over_texts(docs, make, "doc_id long, spans array<struct<kind:string,start:long,end:long,plain:boolean>>")


def masked(text: str) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    out, at = [], 0
    for start, k, end in find(text)[1]:
        if start >= at:
            out += [text[at:start], f"[{KINDS[k]}]"]
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def mask(docs: DataFrame) -> DataFrame:
    """docs with all identifiers of each text masked."""
    return rewrite_texts(docs, lambda: lambda texts: [masked(t) for t in texts])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        def work(keys: list, texts: list[str]) -> dict:
            out: dict[str, list] = {"doc_id": keys, **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
            for text in texts:
                base, every = find(text)
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(every))
            return out

        return work

    return over_texts(table(spark, sf_dir, "documents"), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
