import random
import re

from prefixloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "a@b.c", "x a@b.co%foo@x.yz.w é🙂 me@mail.example.com.", "1.2.3.4.5.6.7.8 and 256.1.1.1 001.002.003.0004 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111-4111-1111",
    "+1 (743) 555-3824.", "+1+1 555 123 4567 +44 20 7946 0958 12345", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "4994226020900891 4316522678525456 4379362835490466",
    "🙂" * 30 + "user.name+tag@sub-domain.example.org" + "é" * 9, "9" * 5000, "a" * 5000 + "@x.y", ".a" * 3000 + "@b" + ".c" * 4000, "1.1.1." * 800 + "1", "jane [at] example [dot] org", "call 743-555-3824 now",
]


def rows(spark):
    rng = random.Random(6)
    bits = ["@", ".", "1", "23", "456", "-", " ", "+", "(", ")", "a", "b.c", "é", "255", "4111111111111111", "\n", "+1 555 123 4567"]
    texts = TEXTS + ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(300)]
    return texts, spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


def test_base_spans_match_brute_force(spark):
    texts, docs = rows(spark)
    got = {r.doc_id: r for r in pii.searched(docs).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base_spans == ",".join(f"{k}:{a}:{b}" for k, a, b in want), t
        assert tuple(got[i][f"n_{k}"] for k in pii.BASE) == tuple(sum(k == w[0] for w in want) for k in pii.BASE)
        every = [s.split(":") for s in got[i].spans.split(",") if s]
        assert set(got[i].base_spans.split(",")) - {""} <= {":".join(s) for s in every}
        added = [s for s in every if ":".join(s) not in got[i].base_spans.split(",")]
        assert not [1 for s in added for _, a, b in want if int(s[1]) < b and a < int(s[2])]


def test_classifier_adds_secrets_and_redacts(spark):
    rng = random.Random(7)
    hexes = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    texts = [f"words before token = \"{hexes()}\" and after" for _ in range(60)]
    texts += [f"mail me: user{i}@mail.example.com or call +1 (555) 123-4{i:03}" for i in range(60)]
    texts += [f"numbers {rng.randint(10**11, 10**12 - 1)}x and 300.1.2.{i}" for i in range(60)]
    texts += [None, "nothing here", "nothing"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.searched(docs).collect()}
    assert all(got[i].spans.startswith("secret:") for i in range(60))
    assert all(got[i].n_email == got[i].n_phone == 1 for i in range(60, 120))
    assert all(not got[i].spans for i in range(120, len(texts)))
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[60] == "mail me: [EMAIL] or call [PHONE]"
    assert clean[0] == 'words before token = "[SECRET]" and after'
    assert [clean[i] for i in range(120, len(texts))] == texts[120:]


def test_redaction_of_overlaps(spark):
    docs = spark.createDataFrame([(1, "x +4111 1111 1111 1111 y 1.2.3.4"), (2, ""), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert out[2] == "" and out[3] is None
    assert "4111" not in out[1] and "1.2.3.4" not in out[1] and out[1].startswith("x ") and " y [IP]" in out[1]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.searched(none).count() == pii.redacted(none).count() == 0


def redact_plainly(text, spans):
    """Spans (label, start, end) that overlap are one place, named by the first (of one start: the first kind); all other characters stay."""
    out, done = [], 0
    for label, a, b in sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0]))):
        if a >= done:
            out += [text[done:a], f"[{label.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def test_redaction_takes_nothing_but_the_spans(spark):
    rng = random.Random(9)
    secret = lambda: "".join(rng.choices("abcdefghijkl0123456789", k=28)) + "a1b2"
    parts = [lambda: "token: " + secret(), lambda: secret() + "[at]example.com", lambda: "key " + secret() + " [at] mail.example.org", lambda: "call 743-555-3824", lambda: "x@" + secret() + ".com", lambda: "word", lambda: "1.2.3.4"]
    texts = ["token: abcdefghijklmnopqrstuvwx12345[at]example.com trailing words"]
    texts += [rng.choice(["", " ", ", "]).join(rng.choice(parts)() for _ in range(rng.randint(1, 6))) for _ in range(300)] + ["token: " + secret() + " " for _ in range(100)]
    texts += [(parts[1]() + " ") * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = {r.doc_id: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)] for r in pii.searched(docs).collect()}
    out = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    for i, t in enumerate(texts):
        assert out[i] == redact_plainly(t, spans[i])
        added = [s for s in spans[i] if s[0] in pii.ADDED]
        assert all(a[2] <= b[1] or b[2] <= a[1] for n, a in enumerate(added[:60]) for b in added[:n])
    assert "trailing words" in out[0] and sum(k in pii.ADDED for own in spans.values() for k, *_ in own) > 100
