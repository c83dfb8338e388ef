r"""Personal data by weak supervision.

Base spans come from fixed patterns (e-mail, IP address, card, phone) and always
stay.  Looser patterns give further candidates of all four kinds: e-mail and IP
addresses with bracketed, spelled or spaced signs; cards that ran into another
number, stand in other separators or have 13 to 15 digits; phones without a
plus, with trunk zeros, or run into another number.  Seven labelling functions
vote on each candidate, for or against, or not at all: form (check digit, ranges,
area codes, known endings), a gazetteer of cue words near it, one of words for
numbers that are nobody's (orders, versions, dates), table cells, numbers beside
it, clean borders, and how plainly it is marked.  Expectation-maximisation over
the counts of all vote patterns of the corpus estimates each labeller's
reliability and each kind's share of true candidates without labels; its
posteriors train a logistic span classifier on votes and span features, which
decides on the candidates.  Base spans take no part in this: they are certain.

Texts are read once.  What is aggregated is a count per vote pattern, a number
bounded by the labellers, not by the corpus.

n_email, n_ip, n_card and n_phone count base spans; ``spans`` lists base spans
and those that the classifier adds.

Defined cases: null and empty texts have no spans; offsets are code points, end
exclusive; candidates that overlap a base span are dropped; rows that repeat are
reported each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import apply, fit_logistic, sigmoid
from .shared import materialize

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never starts inside a run of digits, so the look-behind changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_OPEN, _SHUT = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_AT = re.compile(rf"{_OPEN}(?:at|@){_SHUT}|\sat\s|\s@\s?|@\s|＠", re.I)
_DOT = rf"(?:{_OPEN}(?:dot|\.){_SHUT}|\sdot\s|\.)"
_LABELS = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}", re.I)
#: A text without this has no disguised sign.
_HINT = re.compile(r"[\[({<]\s?(?:at|@|dot|\.)\s?[\])}>]|\sdot\s|\s@|@\s|＠|[0-9] ?\. ?[0-9]{1,3} ?\. ?[0-9]", re.I)
_OTHER_IP = re.compile(rf"(?<![0-9.])([0-9]{{1,3}})({_OPEN}(?:dot|\.){_SHUT}|\sdot\s|\s\.\s|\.\s|\s\.)([0-9]{{1,3}})\2([0-9]{{1,3}})\2([0-9]{{1,3}})(?![0-9])", re.I)
_OTHER_CARD = re.compile(r"(?<![0-9])[0-9]{4}([./_]|[ ]{2})[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_GROUP = re.compile(r"[0-9]+")
_AMERICAN = re.compile(r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
_BARE_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-])")
_TRUNK_PHONE = re.compile(r"(?<![0-9A-Za-z+.,/-])(?:00[1-9][0-9]{0,2}[ -]|\(?0[1-9][0-9]{1,4}\)?[ /-])[0-9]{2,8}(?:[ -][0-9]{2,8}){0,3}(?![0-9A-Za-z-])")
#: Digits of the groups in which cards are written.
SHAPES = ((16,), (15,), (14,), (13,), (19,), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))

#: Cue words, by kind, and words for numbers that are nobody's.
GAZETTEER = {
    "email": ("mail", "email", "e-mail", "contact", "write", "reach", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login", "client", "adresse", "serveur"),
    "card": ("card", "visa", "credit", "mastercard", "amex", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "dial", "telefon", "móvil", "téléphone"),
}
NOBODYS = frozenset(
    "order invoice isbn issn sku version release build section chapter page date serial tracking reference ref part model item total sum lines rows score".split()
)
ENDINGS = frozenset("com org net edu gov info biz io dev app".split())
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_NUMBERY = re.compile(r"[0-9][0-9 .,/-]*$")
_NUMBERS_AFTER = re.compile(r"[ .,/-]{0,2}[0-9]")
NEAR = 40

SCAN = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind:int,start:int,end:int>>, found array<struct<kind:int,start:int,end:int,votes:string>>"
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their at-signs in linear time."""
    out, lo = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > lo and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = lo = m.end()
            out.append((start, end))
        elif start < at:
            lo = max(lo, start)
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, in order of kind, then start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def _disguised_emails(text: str) -> Iterator[tuple[int, int, int]]:
    for m in _AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in _LOCAL and m.start() - start < 64:
            start -= 1
        end = _LABELS.match(text, m.end())
        if start == m.start() or not end:
            continue
        # a bare word "at" is a sign only before a disguised dot
        if m[0].strip().lower() != "at" or not re.fullmatch(r"[A-Za-z0-9.-]+", end[0]):
            yield 0, start, end.end()


def _cards(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Cards inside runs of digits that are no base span; and whole runs of a card's length without one."""
    inside, whole = [], []
    for run in _CARD.finditer(text):
        if run.end() - run.start() < 13:
            continue
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, *run.span())]
        sizes = [e - s for s, e in groups]
        at, found = 0, False
        while at < len(groups):
            for shape in SHAPES:
                if tuple(sizes[at : at + len(shape)]) == shape:
                    s, e = groups[at][0], groups[at + len(shape) - 1][1]
                    if luhn(re.sub("[ -]", "", text[s:e])):
                        inside.append((2, s, e))
                        at, found = at + len(shape) - 1, True
                        break
            at += 1
        if not found and 13 <= sum(sizes) <= 19:
            whole.append((2, *run.span()))
    inside += [(2, *m.span()) for m in _OTHER_CARD.finditer(text)]
    return inside, whole


def _phones(text: str) -> Iterator[tuple[int, int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if sum(c in "0123456789" for c in m[0]) > 15:
                if one := _AMERICAN.match(text, m.start(), m.end()):
                    yield 3, *one.span()
                    continue
                end, digits = m.start(), 0
                for g in _GROUP.finditer(text, *m.span()):
                    digits += g.end() - g.start()
                    if digits > 12:
                        break
                    end = g.end()
                if sum(c in "0123456789" for c in text[m.start() : end]) >= 8:
                    yield 3, m.start(), end
    for pattern in (_BARE_PHONE, _TRUNK_PHONE):
        for m in pattern.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                yield 3, *m.span()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser spans that overlap no base span and none of each other; the leftmost, then the longest, goes first.

    Runs of digits that only have a card's length come after all others.
    """
    out: list[tuple[int, int, int]] = []
    last: list[tuple[int, int, int]] = []
    if _HINT.search(text):
        out += _disguised_emails(text)
        out += [(1, *m.span()) for m in _OTHER_IP.finditer(text)]
    if _DIGIT.search(text):
        inside, last = _cards(text)
        out += inside
        out += _phones(text)
    free: list[tuple[int, int, int]] = []
    for some in (out, last):
        taken = sorted((s, e) for _, s, e in [*base, *free])
        starts, end = [s for s, _ in taken], -1
        for k, s, e in sorted(some, key=lambda x: (x[1], -x[2])):
            i = bisect_left(starts, e)
            if s >= end and not (i and taken[i - 1][1] > s):
                free.append((k, s, e))
                end = e
    return free


def _plain(span: str) -> bool:
    """An e-mail address in words alone, without any sign or digit."""
    return re.fullmatch(r"[A-Za-z -]+", span) is not None


def _issued(digits: str) -> bool:
    """Whether an issuer has cards that begin like this and are as long."""
    n, head = len(digits), int(digits[:2])
    return (n in (13, 16, 19) and 40 <= head <= 49) or (n == 16 and (51 <= head <= 55 or head in (22, 23, 24, 25, 26, 27, 35, 60, 62, 64, 65))) or (
        n == 15 and head in (34, 37)
    ) or (n == 14 and head in (30, 36, 38))


def _form(kind: int, span: str) -> str:
    """Whether the span is built as its kind is."""
    if kind == 0:
        last = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]}> "))[-1].lower()
        country = len(last) == 2 and last.isalpha()
        if _plain(span):
            return "+" if last in ENDINGS else "0" if country else "-"
        return "+" if last in ENDINGS or country else "0" if last.isalpha() else "-"
    numbers = [int(g) for g in _GROUP.findall(span)]
    if kind == 1:
        return "-" if max(numbers) > 255 or not numbers[0] else "+" if max(numbers) > 31 else "0"
    digits = "".join(_GROUP.findall(span))
    if kind == 2:
        return "-" if not luhn(digits) else "+" if _issued(digits) else "0"
    if span[0] == "+" or digits.startswith("0"):
        return "+" if 9 <= len(digits) <= 14 else "-"
    return "+" if digits[0] not in "01" and digits[3] not in "01" else "-"


def _mark(kind: int, span: str) -> str:
    """How plainly the writing says what it is."""
    if kind < 2:
        return "+" if any(c in "[({<＠" for c in span) else "-" if not kind and _plain(span) else "0"
    if kind == 2:
        return "+" if [len(g) for g in _GROUP.findall(span)] in ([4, 4, 4, 4], [4, 6, 5]) else "0"
    return "+" if span[0] in "+(" or span[:2] == "00" else "0" if any(c in "-/." for c in span) or span[0] == "0" else "-"


def votes(text: str, kind: int, s: int, e: int) -> str:
    """One character per labeller: + for, - against, 0 no vote; then the span's features."""
    span, before, after = text[s:e], text[max(0, s - NEAR) : s], text[e : e + NEAR]
    cues = {w.lower() for w in _WORD.findall(before)} | {w.lower() for w in _WORD.findall(after[: NEAR // 2])}
    gazetteer = "+" if cues & set(GAZETTEER[KINDS[kind]]) else ("-" if any(cues & set(v) for k, v in GAZETTEER.items() if k != KINDS[kind]) else "0")
    nobodys = "-" if cues & NOBODYS else "0"
    table = "-" if "|" in before[-3:] or "|" in after[:3] else "0"
    # a card that ran into another number is what its pattern looks for
    numbers = "-" if kind in (1, 3) and (_NUMBERY.search(before.rstrip()[-8:]) or _NUMBERS_AFTER.match(after)) else "0"
    clean = "+" if (not before or before[-1].isspace() or before[-1] in "(:,") and (not after or after[0].isspace() or after[0] in ").,;:") else "-"
    digits = sum(c.isdigit() for c in span)
    return _form(kind, span) + gazetteer + nobodys + table + numbers + clean + _mark(kind, span) + ("+" if " " in span else "0") + ("+" if digits >= 10 else "0")


#: Of the vote string, the first seven are labellers, the rest features of the span only.
LABELLERS = 7


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])]
    types.append(pa.struct([*types[0], pa.field("votes", pa.string())]))
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for lo in range(0, batch.num_rows, 500):
            counts, digest, bases, found = [], [], [], []
            for value in texts.slice(lo, 500):
                text = value.as_py() or ""
                base = base_spans(text)
                extra = candidates(text, base)
                n = [0] * len(KINDS)
                for k, _, _ in base:
                    n[k] += 1
                counts.append(n)
                digest.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                found.append([{"kind": k, "start": s, "end": e, "votes": votes(text, k, s, e)} for k, s, e in extra])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, 500),
                    *(pa.array([c[k] for c in counts], type=pa.int64()) for k in range(len(KINDS))),
                    pa.array(digest, type=pa.string()),
                    pa.array(bases, type=pa.list_(types[0])),
                    pa.array(found, type=pa.list_(types[1])),
                ],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"],
            )


#: Votes (against, none, for) that false and true candidates are taken to have had before any is seen.
PRIOR = np.array([[3.0, 3.0, 1.0], [1.0, 3.0, 3.0]])
#: Votes of all kinds that count with those of one kind.
LEAN = 20.0
#: No vote alone counts for more than odds of e**SURE, so that one labeller never decides against all others.
SURE = 3.0


class SpanModel:
    """Posteriors by expectation-maximisation over vote patterns, and the classifier that they train."""

    def __init__(self, patterns: list[tuple[int, str, int]], rounds: int = 50):
        self.accept: dict[tuple[int, str], float] = {}
        self.reliability = np.zeros((LABELLERS, 2, 3))
        if not patterns:
            return
        code = {"-": 0, "0": 1, "+": 2}
        v = np.array([[code[c] for c in p] for _, p, _ in patterns])
        n = np.array([c for _, _, c in patterns], dtype=float)
        lab = v[:, :LABELLERS]
        kinds = np.array([k for k, _, _ in patterns])
        # start from the balance of votes
        q = sigmoid((lab - 1).sum(axis=1) * 1.5)
        for _ in range(rounds):
            # a kind with few candidates leans on the share of all
            share = (n * q).sum() / n.sum()
            held, true = np.bincount(kinds, weights=n, minlength=len(KINDS)), np.bincount(kinds, weights=n * q, minlength=len(KINDS))
            prior = np.clip((true + 4 * share) / (held + 4), 0.01, 0.99)[kinds]
            log = np.log(np.stack([1 - prior, prior], axis=1))
            for j in range(LABELLERS):
                own = np.empty((2, len(KINDS), 3))
                for c, w in ((0, n * (1 - q)), (1, n * q)):
                    table = np.bincount(kinds * 3 + lab[:, j], weights=w, minlength=3 * len(KINDS)).reshape(len(KINDS), 3)
                    self.reliability[j, c] = (table.sum(axis=0) + PRIOR[c]) / (table.sum() + PRIOR[c].sum())
                    # a labeller may be better at one kind; with few votes it is taken to be as it is at all
                    own[c] = table + LEAN * self.reliability[j, c]
                    own[c] /= own[c].sum(axis=1, keepdims=True)
                # a vote against is never taken as a sign for, nor the other way round
                ratio = np.clip(np.log(own[1] / own[0]), -SURE, SURE)
                ratio = np.stack([np.minimum(ratio[:, 0], 0.0), ratio[:, 1] * 0.25, np.maximum(ratio[:, 2], 0.0)], axis=1)
                log[:, 1] += ratio[kinds, lab[:, j]]
            q = sigmoid(log[:, 1] - log[:, 0])
        x = self.inputs(kinds, v)
        w = fit_logistic(np.r_[x, x], np.r_[np.ones(len(q)), np.zeros(len(q))], 1.0, np.r_[n * q, n * (1 - q)])
        p = sigmoid(apply(w, x))
        self.accept = {(int(k), t): float(s) for (k, t, _), s in zip(patterns, p, strict=True)}

    @staticmethod
    def inputs(kinds: np.ndarray, v: np.ndarray) -> np.ndarray:
        kind, signs = np.eye(len(KINDS))[kinds], np.hstack([v == 0, v == 2]).astype(float)
        # a vote may weigh more for one kind than for another
        return np.hstack([kind, signs, (kind[:, :, None] * signs[:, None, :]).reshape(len(v), -1)])


def _write(accepted: list[tuple[int, str]]):
    good = set(accepted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, found in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                own = {(b["kind"], b["start"], b["end"]) for b in base}
                own |= {(f["kind"], f["start"], f["end"]) for f in found if (f["kind"], f["votes"]) in good}
                spans.append(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(own)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(spans, type=pa.string())], names=[*batch.schema.names[:6], "spans"])

    return run


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans for every row of ``docs``."""
    scanned = materialize(docs.select("doc_id", "text").mapInArrow(_scan, SCAN), "pii-scan")
    patterns = scanned.select(F.explode("found").alias("f")).groupBy("f.kind", "f.votes").count().orderBy("kind", "votes").collect()  # at most 4 * 3**7 * 2**2
    model = SpanModel([(r[0], r[1], r[2]) for r in patterns])
    good = [k for k, p in model.accept.items() if p >= threshold]
    return scanned.mapInArrow(_write(good), SCHEMA)
