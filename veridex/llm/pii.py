"""Personal data by weak supervision.

Base spans come from fixed patterns and always stay. Beyond them, looser candidates are judged: a regex, a gazetteer
and a context labeler vote (1 personal, -1 not, 0 abstains). Every candidate of every document counts: votes and
span features are discrete, so their joint counts are a table of bounded size, on which expectation-maximisation
estimates the labelers' reliabilities and a logistic span classifier is trained with the posteriors as soft labels.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Probability from which the classifier adds a candidate.
ADD_FROM = 0.9

# Patterns of the base kinds. The ip and card patterns can only begin at a digit run's start, so the
# look-behind changes no match; it keeps long digit runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Looser patterns that only nominate candidates.
_AT = re.compile(r" ?[\[(]at[\])] ?", re.I)
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]+)+", re.I)
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
_SECRET = re.compile(r"(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']? {0,3}[=:] {0,3}[\"']?([A-Za-z0-9_/+-]{16,})", re.I)
_CUES = re.compile(r"token|secret|passw|api[_-]?key|access[_-]?key", re.I)
_SEEN = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)

# Gazetteers. Top-level domains without those of countries, which are the ISO codes that Java knows;
# ranges of card issuers; calling codes of two digits, as those of one are 1 and 7 and the rest by zone have three.
_GENERIC = frozenset("com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post app dev page blog shop store online site tech cloud email xyz uk eu su ac".split())
_ISSUERS = (("2221", "2720"), ("300", "305"), ("34", "34"), ("3528", "3589"), ("36", "39"), ("4", "4"), ("50", "50"), ("51", "55"), ("56", "58"), ("60", "69"))
_CALLING = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_ZONES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
_RESERVED = ("0.", "127.", "255.", "224.")
_FOR = {
    "email": re.compile(r"e-?mail|contact|write|mailto|address", re.I),
    "ip": re.compile(r"\bip\b|server|host|address|login|client", re.I),
    "card": re.compile(r"card|visa|master|credit|debit|pay", re.I),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|contact|whatsapp", re.I),
    "secret": re.compile(r"token|secret|passw|key", re.I),
}
_AGAINST = re.compile(r"version|isbn|release|section|chapter|figure|invoice|order no|serial", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k & 1:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Per kind the leftmost non-overlapping matches that pass their check, in code points; what fails is not tried again."""
    return {k: [s for s, good in v if good] for k, v in _matches(text).items()}


def _loose_emails(text: str):
    """Addresses written with (at) or [at]; no part has a greatest length."""
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _LOOSE_DOMAIN.match(text, m.end()) if start < m.start() else None
        if found:
            end = found.end()
            yield start, end


def country_domains(spark) -> frozenset[str]:
    """Top-level domains of countries, from the ISO codes of the Java library."""
    return frozenset(c.lower() for c in spark._jvm.java.util.Locale.getISOCountries())


def _issued(digits: str) -> bool:
    return any(a <= digits[: len(a)] <= b for a, b in _ISSUERS)


def _callable(digits: str) -> bool:
    return digits[:1] in ("1", "7") or digits[:2] in _CALLING or digits[:2] in _ZONES


def _matches(text: str) -> dict[str, list[tuple[tuple[int, int], bool]]]:
    out: dict[str, list[tuple[tuple[int, int], bool]]] = {k: [] for k in BASE_KINDS}
    out["email"] = [(s, True) for s in _emails(text)]
    # a part's value is compared as text, because its digit run may be very long
    out["ip"] = [(m.span(), all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in m[0].split("."))) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            out["card"].append((m.span(), 16 <= len(d) <= 19 and _luhn(d)))
    if "+" in text:
        out["phone"] = [(m.span(), 8 <= len(_digits(m[0])) <= 15) for m in _PHONE.finditer(text)]
    return out


def _side(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "letter" if c.isalnum() else "other"


def _votes(text: str, kind: str, start: int, end: int, good: bool, countries: frozenset[str]) -> tuple:
    """(kind, regex, gazetteer, context, features...) of a candidate."""
    span, digits = text[start:end], _digits(text[start:end])
    regex = 1 if good else -1
    if kind == "email":
        top = re.split(r"[.\])]", span)[-1].strip().lower()
        gazetteer = 1 if top in _GENERIC or top in countries else -1 if top.isdigit() else 0
    elif kind == "ip":
        gazetteer = -1 if span.startswith(_RESERVED) else 0
    elif kind == "card":
        gazetteer = 1 if _issued(digits) else -1
    elif kind == "phone":
        gazetteer = 1 if span[0] != "+" and "2" <= digits[:1] <= "9" else 1 if span[0] == "+" and _callable(digits) else -1
    else:
        gazetteer = 1 if len(set(span)) >= 10 else -1
    before = text[max(0, start - 40) : start]
    context = -1 if _AGAINST.search(before) else 1 if _FOR[kind].search(before) else 0
    mixed = "mixed" if digits and any(c.isalpha() for c in span) else "plain"
    return (kind, regex, gazetteer, context, min(len(digits), 20), mixed, _side(text[start - 1 : start]), _side(text[end : end + 1]))


def candidates(text: str, countries: frozenset[str] = frozenset()) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[tuple[int, int], tuple]]]:
    """Base spans, and every other candidate, of any length, with its votes and features."""
    if not _SEEN.search(text):
        return {k: [] for k in BASE_KINDS}, []
    found = _matches(text)
    base = {k: [s for s, good in v if good] for k, v in found.items()}
    others = [((s, e), _votes(text, k, s, e, False, countries)) for k, v in found.items() for (s, e), good in v if not good]
    more = [("email", s) for s in _loose_emails(text)] if "(" in text or "[" in text else []
    more += [("phone", m.span()) for m in _LOOSE_PHONE.finditer(text)]
    if _CUES.search(text):
        more += [("secret", m.span(1)) for m in _SECRET.finditer(text) if any("0" <= c <= "9" for c in m[1])]
    if not more:
        return base, others
    taken = sorted(s for v in base.values() for s in v)
    starts = [s for s, _ in taken]
    furthest = list(accumulate((e for _, e in taken), max))  # the greatest end among the first spans
    for kind, (s, e) in more:
        k = bisect_left(starts, e)
        if k and furthest[k - 1] > s:
            continue  # a base span already covers it
        others.append(((s, e), _votes(text, kind, s, e, True, countries)))
    return base, others


# --- reliabilities and classifier ------------------------------------------------------


def expectation_maximisation(counts: dict[tuple, int], rounds: int = 50) -> tuple[dict[tuple, float], np.ndarray]:
    """Posterior of each pattern being personal data, and the labelers' vote probabilities [class, labeler, vote]."""
    patterns = list(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([[v + 1 for v in p[1:4]] for p in patterns])
    weight = np.array([2.0, 1.0, 1.0])
    post = 1 / (1 + np.exp(-((votes - 1) * weight).sum(1)))
    kinds = np.array([KINDS.index(p[0]) for p in patterns])
    rates = np.zeros((2, 3, 3))
    for _ in range(rounds):
        for y, w in ((1, post * n), (0, (1 - post) * n)):
            for j in range(3):
                # the prior says that labelers are better than chance, so the classes keep their meaning
                prior = np.array([0.5, 1.0, 2.0]) if y else np.array([2.0, 1.0, 0.5])
                seen = np.bincount(votes[:, j], w, 3) + prior * (2.0 if j == 0 else 1.0)
                rates[y, j] = seen / seen.sum()
        share = np.array([((post * n)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2) for k in range(len(KINDS))])[kinds]
        odds = np.log(share / (1 - share)) + sum(np.log(rates[1, j, votes[:, j]] / rates[0, j, votes[:, j]]) for j in range(3))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(patterns, post)), rates


def _features(pattern: tuple) -> list[tuple]:
    kind = pattern[0]
    return [("kind", kind), *((kind, k, v) for k, v in enumerate(pattern[1:]))]


def train(counts: dict[tuple, int], rounds: int = 300) -> dict[tuple, float]:
    """Weights of a logistic classifier of span features, labelled by the posteriors; empty without candidates."""
    if not counts:
        return {}
    post, _ = expectation_maximisation(counts)
    patterns = sorted(counts)
    names = {f: i for i, f in enumerate(sorted({f for p in patterns for f in _features(p)}, key=repr))}
    x = np.zeros((len(patterns), len(names)))
    for i, p in enumerate(patterns):
        x[i, [names[f] for f in _features(p)]] = 1
    y, n = np.array([post[p] for p in patterns]), np.array([counts[p] for p in patterns], float)
    n, w, g2 = n / n.sum(), np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(rounds):
        g = x.T @ ((1 / (1 + np.exp(-(x @ w))) - y) * n) + 1e-5 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return {f: float(w[i]) for f, i in names.items()}


def probability(weights: dict[tuple, float], pattern: tuple) -> float:
    return float(1 / (1 + np.exp(-sum(weights.get(f, 0.0) for f in _features(pattern)))))


def vote_counts(docs: DataFrame) -> dict[tuple, int]:
    """Joint counts of votes and features over all base spans and candidates of all documents: at most a few thousand patterns."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                if t := text.as_py():
                    base, others = candidates(t, countries)
                    seen.update(p for _, p in others)
                    seen.update(_votes(t, k, *span, True, countries) for k, spans in base.items() for span in spans)
        if seen:
            columns = [*zip(*seen), tuple(seen.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) if isinstance(c[0], str) else pa.array(c, pa.int64()) for c in columns], names)

    countries = country_domains(docs.sparkSession)
    names = ["kind", "regex", "gazetteer", "context", "digits", "mixed", "left_side", "right_side", "n"]
    schema = "kind string, regex long, gazetteer long, context long, digits long, mixed string, left_side string, right_side string, n long"
    rows = docs.select("text").mapInArrow(run, schema).groupBy(*names[:-1]).agg(F.sum("n").alias("n")).collect()
    return {tuple(r)[:-1]: r["n"] for r in rows}


def _all_spans(text: str, weights: dict, keep: dict, add_from: float, countries: frozenset[str]):
    base, others = candidates(text, countries)
    added = []
    for span, pattern in others:
        if pattern not in keep:
            keep[pattern] = probability(weights, pattern) >= add_from
        if keep[pattern]:
            added.append((KINDS.index(pattern[0]), *span))
    first = [(KINDS.index(k), *s) for k in BASE_KINDS for s in base[k]]
    return base, first, sorted({*first, *added})


def find(docs: DataFrame, add_from: float = ADD_FROM) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end).

    A null or empty text has no spans; without candidates nothing is added. Spans and texts may have any length.
    Repeated rows and null ids give rows of their own, an empty table none. Other columns are not read.
    """
    weights, countries = train(vote_counts(docs)), country_domains(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]

    def run(batches):
        keep: dict = {}
        show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, first, every = _all_spans(text.as_py() or "", weights, keep, add_from, countries)
                rows.append((*(len(base[k]) for k in BASE_KINDS), hashlib.sha256(show(first).encode()).hexdigest(), show(every)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, add_from: float = ADD_FROM) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans become one. Null stays null.

    Every row and every column stays, whatever its name; n_chars, if there is one, follows the new text.
    """
    weights, countries = train(vote_counts(docs)), country_domains(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        keep: dict = {}
        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                every = sorted(_all_spans(text, weights, keep, add_from, countries)[2], key=lambda x: (x[1], -x[2])) if text else []
                out, end = [], 0
                for kind, s, e in every:
                    if s >= end:
                        out += [text[end:s], f"<{KINDS[kind].upper()}>"]
                    end = max(end, e)
                texts.append("".join([*out, text[end:]]) if every else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
