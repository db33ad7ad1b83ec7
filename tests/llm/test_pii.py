import hashlib
import random
import re
from collections import Counter

import numpy as np

from tests.llm.conftest import EDGES, docs_of
from veridex.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = digits[-1::-2]
    even = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def brute(text):
    """The contract, read literally."""
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out[kind].append(m.span())
    return out


def test_base_spans_against_the_patterns():
    rng = random.Random(11)
    alphabet = ["a", "b.", "@", "x.com", ".", "1", "25", "256", "4111111111111111", " ", "-", "+", "+1 (555) 010-9999", "é", "@@", "1.2.3.4", "\n", "0000", "4111 1111 1111 1111", "🎉"]
    for _ in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_are_linear():
    for text in ("1" * 200000, "a" * 200000 + "@", "1." * 100000, "+1(" * 50000, "a@" * 100000, "@" * 200000):
        pii.candidates(text)


def shown(text):
    b = brute(text)
    return ",".join(f"{k}:{s}:{e}" for k in pii.BASE_KINDS for s, e in b[k])


def check(rows, texts):
    for r in rows:
        b = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(b[k]) for k in pii.BASE_KINDS]
        assert r.base_sha256 == hashlib.sha256(shown(texts[r.doc_id]).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(filter(None, shown(texts[r.doc_id]).split(","))) <= set(every)
        keys = [(pii.KINDS.index(k), int(s)) for k, s, _ in (x.split(":") for x in every)]
        assert keys == sorted(keys)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pii.find(docs).collect()
    check(rows, {r.doc_id: r.text or "" for r in docs.collect()})
    assert len(rows) == docs.count()


def test_edges(spark, edges, nothing):
    assert Counter(r.doc_id for r in pii.find(edges).collect()) == Counter(i for i, _ in EDGES)
    assert pii.find(nothing).count() == 0 and pii.redact(nothing).count() == 0
    out = pii.redact(edges)
    assert out.columns == edges.columns and sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((i or 0, t or "") for i, t in EDGES)


def test_added_spans_and_redaction(spark):
    lines = []
    for k in range(40):
        lines += [f"call us, phone (212) 555-01{k:02d} today", f'the token = "a1b2c3d4e5f6a7b8c9d0{k:02d}" was set', f"mail bob{k}@mail.example.com or 10.0.0.{k}", f"in version 1234567890123{k:03d} nothing"]
    docs = docs_of(spark, lines)
    rows = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert all(rows[4 * k].startswith("phone:") for k in range(40)) and all(rows[4 * k + 1].startswith("secret:") for k in range(40))
    assert all(rows[4 * k + 3] == "" or "card" in rows[4 * k + 3] and brute(lines[4 * k + 3])["card"] for k in range(40))
    texts = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert texts[0] == "call us, phone <PHONE> today" and texts[2] == "mail <EMAIL> or <IP>"


def test_reliabilities_are_found():
    rng = np.random.default_rng(2)
    rates = [0.95, 0.75, 0.6]  # how often each labeler is right
    counts = Counter()
    for _ in range(20000):
        y = rng.random() < 0.4
        votes = tuple(int(1 if (rng.random() < r) == y else -1) for r in rates)
        counts["phone", *votes, 9, "plain", "space", "space"] += 1
    post, found = pii.expectation_maximisation(counts)
    right = [(found[1, j, 2] + found[0, j, 0]) / 2 for j in range(3)]
    assert all(abs(a - b) < 0.08 for a, b in zip(right, rates))
    assert post["phone", 1, 1, 1, 9, "plain", "space", "space"] > 0.9 > 0.2 > post["phone", -1, -1, -1, 9, "plain", "space", "space"]
    assert pii.train({}) == {} and pii.probability({}, ("phone", 1, 1, 1, 9, "plain", "space", "space")) == 0.5


def test_a_long_secret_is_one_span():
    key = "Ab3" * 700
    others = pii.candidates(f"the api_key = {key} ends here")[1]
    assert [span for span, votes in others if votes[0] == "secret"] == [(14, 14 + len(key))]


def test_no_span_has_a_greatest_length():
    local, label = "a" * 300, "b" * 200
    for text in (f"x {local}[At]{label}.{label} dot", f"x {local} (aT) " + ".".join([label] * 12)):
        (span, votes), *_ = pii.candidates(text)[1]
        assert votes[0] == "email" and span[0] == 2 and span[1] >= len(text) - 4
    digits = "4" + "-1" * 90
    assert [s for s, v in pii.candidates(f"card {digits} end")[1] if v[0] == "card"] == [(5, 5 + len(digits))]


def test_every_overlap_is_seen():
    # one long base span under the candidate, and many short ones that begin later
    text = "+1 " + ("0" * 3 + " ") * 3 + "(212) 555-0100"
    for seed in range(200):
        rng = random.Random(seed)
        text = "".join(rng.choice(["1.2.3.4 ", "+1 555 0100 22 ", "a@b.cc ", "(212) 555-0100 ", "x(at)y.z ", "4111111111111111 "]) for _ in range(30))
        base, others = pii.candidates(text)
        taken = [s for v in base.values() for s in v]
        assert not any(v[1] == 1 and s < e2 and e > s2 for (s, e), v in others for s2, e2 in taken)


def planted(seed, n):
    """Documents with one hidden item each that no base pattern finds, in varied wording, and as many without."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9)))
    filler = lambda: " ".join(word() for _ in range(rng.randrange(5, 30)))
    kinds = {
        "email": lambda: f"{rng.choice(['write to', 'contact', 'e-mail', ''])} {word()}.{word()}{rng.choice([' [at] ', '(at)', ' (AT) '])}{word()}{rng.choice(['.', ' [dot] ', '(dot)'])}{rng.choice(['com', 'org', 'de', 'se'])}",
        "phone": lambda: f"{rng.choice(['call', 'phone', 'my mobile is', ''])} ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}",
        "secret": lambda: f"{rng.choice(['api_key', 'token', 'password', 'Secret'])}{rng.choice([': ', '=', ' = '])}{''.join(rng.choices('abcdefXYZ0123456789', k=rng.randrange(20, 60)))}1",
    }
    rows = [(kind, f"{filler()} {make()} {filler()}") for kind, make in kinds.items() for _ in range(n)]
    return rows + [("", f"{filler()} version {rng.randrange(10)}.{rng.randrange(30)} of {rng.randrange(1900, 2030)} {filler()}") for _ in range(3 * n)]


def test_recall_of_planted_items(spark):
    rows = planted(4, 200)
    found = {r.doc_id: r.spans for r in pii.find(docs_of(spark, [t for _, t in rows])).collect()}
    for kind in ("email", "phone", "secret"):
        own = [k for k, (want, _) in enumerate(rows) if want == kind]
        assert sum(f"{kind}:" in found[k] for k in own) >= 0.9 * len(own), kind
    assert not any(found[k] for k, (want, _) in enumerate(rows) if not want)


def test_a_text_beyond_one_batch(spark):
    text = "lorem ipsum " * 450_000 + "mail a@b.com"
    r = pii.find(docs_of(spark, [text])).first()
    assert r.n_email == 1 and r.spans == f"email:{len(text) - 7}:{len(text)}"
