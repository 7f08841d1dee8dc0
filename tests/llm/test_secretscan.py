import hashlib
import random
import re

from eventsieve.llm import secretscan
from eventsieve.llm.automaton import compile_rules

BASE = (
    ("assign", r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    ("access", r"(AKIA[A-Z0-9]+)", 20),
    ("hex", r"([0-9a-f]+)", 24),
)


def brute(text):
    found = []
    for number, (_, pattern, least) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            if len(m.group(1)) >= least:
                found.append((m.start(), number, m.end()))
    return sorted(found)


def soup(seed, size=40):
    draw = random.Random(seed)
    parts = [
        "token", "=", "password", " ", ":", "'", '"', "AKIA", "ABCDEF0123456789", "abc", "0", "deadbeefdeadbeefdeadbeef",
        "a", "é", "secret", "API_KEY", "apikey", "passwd", "x.y", "\n", "TOKEN", "ſecret", "日", "-----BEGIN ", "ghp_",
    ]
    return "".join(draw.choices(parts, k=draw.randint(0, size)))


def test_base_spans_match_regexes():
    scanner = secretscan.Scanner().open()
    for seed in range(3000):
        text = soup(seed)
        raw = text.encode()
        points = lambda at: len(raw[:at].decode())
        found = [(points(s), r, points(e)) for s, r, e in scanner(raw) if r < 3]
        assert found == brute(text), text


def test_automaton_equals_regexes():
    patterns = [r"ab*c", r"(?i:key)[0-9]{2,3}", r"x(y|zz)+", r"[^a]b?"]
    automaton = compile_rules(patterns)
    for seed in range(2000):
        draw = random.Random(seed)
        text = "".join(draw.choices("abcxyzkeyKEY019", k=draw.randint(0, 7))).encode()
        state = automaton.start
        for byte in text:
            state = automaton.next[state][automaton.kinds[byte]]
        for rule, pattern in enumerate(patterns):
            expected = re.fullmatch(pattern.encode(), text) is not None
            assert bool(automaton.accepts[state] >> rule & 1) == expected, (pattern, text)


def test_more_rules_and_redaction(spark):
    text = "é -----BEGIN RSA PRIVATE KEY----- https://bob:hunter2@example.com ghp_" + "Zk9" * 12 + " token=abcdef end"
    docs = spark.createDataFrame([(1, text, len(text)), (2, None, None)], "doc_id long, text string, n_chars long")
    spans = secretscan.scan(docs).first().spans
    assert [s.kind for s in spans] == ["pem", "url_login", "github", "assign"]
    assert text[spans[3].start : spans[3].end] == "token=abcdef"
    out = secretscan.redacted(docs, length_col="n_chars").collect()
    assert out[0].text == "é [SECRET] https[SECRET]example.com [SECRET] [SECRET] end"
    assert out[0].n_chars == len(out[0].text)
    assert out[1].text is None and out[1].n_chars is None


def test_awkward_rows(awkward, empty):
    found = secretscan.digest(secretscan.scan(awkward)).collect()
    assert len(found) == awkward.count()
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == nothing and r.spans == "" and r.n_hex == 0 for r in found)
    assert secretscan.digest(secretscan.scan(empty)).count() == 0
    assert secretscan.redacted(awkward).columns == awkward.columns
    assert sorted(map(str, secretscan.redacted(awkward).collect())) == sorted(map(str, awkward.collect()))


def test_digest_columns(spark):
    text = "token=abcdef " + "0a" * 12
    found = secretscan.digest(secretscan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (found.n_assign, found.n_access, found.n_hex) == (1, 0, 1)
    assert found.spans == "assign:0:12,hex:13:37"
    assert found.base_sha256 == hashlib.sha256(b"assign:0:12,hex:13:37").hexdigest()
