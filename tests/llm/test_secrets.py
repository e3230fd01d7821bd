import hashlib
import random
import re
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from cellsift.llm import secrets as S

PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
    "access": r"(AKIA[A-Z0-9]+)",
    "hex": r"([0-9a-f]+)",
}


def brute(text: str) -> list[tuple[int, str, int]]:
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda x: (x[0], list(PATTERNS).index(x[1])))


def test_scan_equals_regular_expressions():
    rng = random.Random(5)
    bits = ["token", "Secret", "api_key", "APIKEY", "passwd", "password", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "abc", "deadbeef", "0123456789abcdef", "é", "ß", "\n", "-", ".", "zz", "tok", "to", "ken=x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 30, 400]))) for _ in range(600)]
    scanner = S.Scanner([*S.BASE, *S.ADDED])
    raw = [t.encode() for t in texts]
    for t, r, spans in zip(texts, raw, scanner.scan(raw), strict=True):
        got = [(a, scanner.rules[k].kind, b) for a, k, b in S.in_points(r, spans) if k < 3]
        assert got == brute(t), t


def test_added_rules():
    scanner = S.Scanner([*S.BASE, *S.ADDED])
    text = "x ghp_" + "a1B2" * 9 + " y -----BEGIN RSA PRIVATE KEY-----"
    assert [scanner.rules[k].kind for _, k, _ in scanner.scan([text.encode()])[0]] == ["github", "pem"]


def test_private_keys_are_masked_whole(spark):
    lines = ["MIIEpAIBAAKCAQEA" + "aB3/" * 12, "q+Z9" * 16, "xY12=="]
    head, foot = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    extra = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF", ""]
    bodies = [gap.join([*more, *lines]) for gap in ("\n", "\r\n", "\\n") for more in ([], extra) if not (more and gap == "\\n")]
    texts = [f"é a {head}\n{b}\n{foot} b" for b in bodies] + [f"é a {head}\n{b}" for b in bodies] + [f"é a {head}\n\n -- see b"]
    texts.append(f"é a {head}\n{bodies[0]}\n{head}\n{bodies[0]}\n{foot} b")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = len(bodies)
    want = ["é a [pem] b"] * n + ["é a [pem]"] * n + ["é a [pem]\n\n -- see b", "é a [pem]\n[pem] b"]
    assert [r.text for r in S.redact(docs).orderBy("doc_id").collect()] == want
    first = {r.doc_id: r.spans for r in S.find_secrets(docs).collect()}[0]
    assert [(s.start, s.end) for s in first if s.kind == "pem"] == [(4, len(texts[0]) - 2)]


def test_lanes_meet(monkeypatch):
    scanner = S.Scanner(S.BASE)
    text = ("0123456789abcdef" * 400 + "g") * 3 + "token" + " " * 3000 + "=" + "A" * 5000
    spans = scanner.scan([text.encode(), b"", b"secret=abcdef"])
    assert [(a, scanner.rules[k].kind, b) for a, k, b in spans[0]] == brute(text)
    assert spans[1] == [] and len(spans[2]) == 1


def test_windows_meet(monkeypatch):
    monkeypatch.setattr(S, "WINDOW", 700)
    scanner = S.Scanner([*S.BASE, *S.ADDED])
    rng = random.Random(8)
    bits = ["token", "=", ":", " ", "AKIA", "ABCDEFGH1234", "abc", "deadbeef" * 40, "0123456789abcdef", "é", "ß", "\n", "ken=x", "漢" * 50]
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(400))
        raw = text.encode()
        got = [(a, scanner.rules[k].kind, b) for a, k, b in S.in_points(raw, scanner.scan([raw])[0]) if k < 3]
        assert got == brute(text)


def test_query_equals_regular_expressions(spark, tmp_path):
    """All columns of the query, from Python's regular expressions, over documents with secrets put into them."""
    from cellsift.llm.queries import queries

    rng = random.Random(3)
    secrets = ["token: abcdefgh1", "AKIA" + "AB12" * 5, "0123456789abcdef" * 2, "ghp_" + "a1B2" * 9, "xoxb-" + "12ab-" * 4, "AIza" + "Ab_9" * 10, "-----BEGIN RSA PRIVATE KEY-----\n" + "QUJD" * 16 + "\n-----END RSA PRIVATE KEY-----", 'api_key="x/y+z=1"', "é漢"]
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    rows = docs.to_pylist()
    for r in rows:
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(r["text"] or "") + 1)
            r["text"] = (r["text"] or "")[:at] + rng.choice(["", " "]) + rng.choice(secrets) + " " + (r["text"] or "")[at:]
    pq.write_table(pa.Table.from_pylist(rows, docs.schema), tmp_path / "documents.parquet")
    sf = str(tmp_path)
    more = {
        "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:-{0,4}[^-])*-----END [A-Z ]*PRIVATE KEY-----|(?:(?:[ \t\r\n]|\\[rn])+[A-Za-z-]+:[^\n]*)*(?:(?:[ \t\r\n]|\\[rn])*[A-Za-z0-9+/=]{16,})+(?:(?:[ \t\r\n]|\\[rn])+[A-Za-z0-9+/=]+)?)?",
        "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
        "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
        "google": r"AIza[A-Za-z0-9_-]{35,}",
    }
    order = [*PATTERNS, *more]
    rows = {r.doc_id: r for r in queries()["op8_secret_scan"](spark, sf).collect()}
    found = 0
    for d in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        base = brute(d["text"] or "")
        whole = sorted(base + [(m.start(), k, m.end()) for k, p in more.items() for m in re.finditer(p, d["text"] or "")], key=lambda x: (x[0], order.index(x[1])))
        r = rows[d["doc_id"]]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, k, b in whole)
        found += len(whole)
    assert found > 200


def test_long_text_in_bounded_memory():
    """200 MB are scanned and masked in less than 1 GB."""
    code = """
import resource, pyarrow as pa, numpy as np
from cellsift.llm import secrets as S
text = pa.array(["é token=abcdefgh " + "some words " * (19 << 20) + " token=abcdefgh"]).cast(pa.large_string())
batch = pa.RecordBatch.from_arrays([text], names=["text"])
rules = [*S.BASE, *S.ADDED]
scanner = S.Scanner(rules)
raw = S.raw_texts(batch)
spans = scanner.scan(raw)[0]
n = 17 + 11 * (19 << 20)
assert S.in_points(raw[0], spans) == [(2, 0, 16), (n + 1, 0, n + 15)], S.in_points(raw[0], spans)
assert len(S.masked(raw[0], spans, rules, "[{kind}]")) == len(raw[0]) - 2 * 6
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])


def test_rows_and_redaction(spark):
    docs = spark.createDataFrame([(1, "say token: abcdefg!"), (2, None), (3, ""), (1, "say token: abcdefg!")], "doc_id long, text string")
    rows = {(r.doc_id, len(r.spans)) for r in S.find_secrets(docs).collect()}
    assert rows == {(1, 1), (2, 0), (3, 0)}
    clean = S.redact(docs.selectExpr("doc_id", "text", "1 AS spans")).collect()
    assert sorted((r.doc_id, r.text or "-", r.spans) for r in clean) == [(1, "say [assign]!", 1), (1, "say [assign]!", 1), (2, "-", 1), (3, "-", 1)]
    assert S.find_secrets(docs.limit(0)).count() == 0
