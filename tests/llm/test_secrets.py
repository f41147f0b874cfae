"""Secret scans against Python's re and a plain version of the test battery."""

import base64
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from wiretrace.llm import secrets as S
from wiretrace.llm.secrets import battery, find_all, find_secrets, redacted, rejected_from, span_text

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def tail(z):
    return max(math.erfc(z / math.sqrt(2)) / 2, 1e-12)


def plain_battery(token, alphabet):
    n, size = len(token), len(alphabet)
    v = [alphabet.index(c) + 1 for c in token]
    df = size - 1
    chi = sum((v.count(k) - n / size) ** 2 / (n / size) for k in range(1, size + 1))
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    mean = sum(v) / n
    serial = abs(sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / max(sum((a - mean) ** 2 for a in v), 1e-9) + 1 / n) * math.sqrt(n)
    high = [a > (size + 1) / 2 for a in v]
    pairs = 2 * sum(high) * (n - sum(high))
    runs = abs(sum(a != b for a, b in zip(high, high[1:])) - pairs / n) / math.sqrt(max(pairs * (pairs - n) / (n * n * (n - 1)), 1e-9))
    half = -(math.log(tail(z)) + math.log(min(1, 2 * tail(serial))) + math.log(min(1, 2 * tail(runs))))
    return math.exp(-half) * (1 + half + half * half / 2)


def texts(seed):
    rng = random.Random(seed)
    key = lambda n: "".join(rng.choice("ABCxyz0189+/_.=-") for _ in range(n))
    parts = [
        lambda: f'{rng.choice(["password", "PassWd", "SECRET", "token", "api_key", "ApiKey", "tokens"])}{rng.choice(["", chr(34), chr(39)])}{" " * rng.randrange(3)}{rng.choice(":=")}{" " * rng.randrange(2)}{rng.choice(["", chr(34)])}{key(rng.randrange(1, 20))}',
        lambda: "AKIA" + "".join(rng.choice("AKI019Z") for _ in range(rng.randrange(20))),
        lambda: rng.randbytes(rng.randrange(1, 30)).hex(),
        lambda: rng.choice(["wörd 😀", "\n", "a b", "ſecret=abcdefgh1", "toKen=abcdefgh1", "token=", "x" * 30]),
        lambda: base64.b64encode(rng.randbytes(24)).decode(),
    ]
    return ["".join(rng.choice(parts)() + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(12))) for _ in range(300)] + [None, "", "token=abcdefgh" * 900, "0" * 5000]


def test_base_finds_equal_re(spark):
    data = [(k, t, "x") for k, t in enumerate(texts(1))] + [(None, "password=12345678", ""), (1, None, ""), (1, None, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, base string")
    got = sorted((r.doc_id is None, r.doc_id or 0, [tuple(s) for s in r.secrets if s.kind < 3]) for r in find_secrets(docs).collect())
    assert got == sorted((k is None, k or 0, base_spans(t)) for k, t, _ in data)
    assert find_secrets(docs.limit(0)).collect() == []


def test_battery_equals_plain(spark):
    rng = random.Random(2)
    rows = []
    for _, _, alphabet in S.ENCODINGS.values():
        rows += [("".join(rng.choice(alphabet) for _ in range(n)), alphabet) for n in (2, 20, 33, 64, 300)]
        rows += [((alphabet * 20)[:n], alphabet) for n in (20, 70)] + [(alphabet[0] * 25, alphabet)]
    df = spark.createDataFrame(rows, "t string, a string")
    for r in df.select("t", "a", battery(F.col("t"), F.col("a")).alias("p")).collect():
        assert r.p == pytest.approx(plain_battery(r.t, r.a), rel=1e-3, abs=1e-7), (r.t, r.a)


def test_false_discovery_rule(spark):
    rng = random.Random(3)
    counts = [(s, b, rng.randrange(1, 9)) for s in "ab" for b in sorted(rng.sample(range(200), 60))]
    got = rejected_from(spark.createDataFrame(counts, "stratum string, bin int, n long"))
    for s in "ab":
        own = sorted(((b, n) for t, b, n in counts if t == s), reverse=True)
        m, k, cut = sum(n for _, n in own), 0, None
        for b, n in own:
            k += n
            if math.exp(-b / S.BINS_A_UNIT) <= S.FDR * k / m:
                cut = b
        assert got.get(s) == cut


def test_random_strings_stay_and_words_go(spark):
    rng = random.Random(4)
    keys = [rng.randbytes(20).hex().upper() for _ in range(80)] + [base64.b64encode(rng.randbytes(30)).decode() for _ in range(80)]
    plain = ["AbcAbcAbcAbcAbcAbc1Abc1Abc" * 2, "aaaaaaaaaaBBBBBBBBBB11111111112222222222", "A0A0A0A0A0A0A0A0A0A0A0A0A0A0A0A0A0A0A0A0"] * 20
    docs = spark.createDataFrame([(k, f"see {t} here") for k, t in enumerate(keys + plain)], "doc_id long, text string")
    got = {r.doc_id: any(s.kind == 3 for s in r.secrets) for r in find_secrets(docs).collect()}
    assert sum(got[k] for k in range(160)) >= 155 and not any(got[k] for k in range(160, len(got)))


def test_every_candidate_is_tested(spark):
    rng = random.Random(5)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [lower + upper + digits, lower + digits, upper + digits, lower + "234567", lower + upper, lower, upper]
    rows, spans = [], []
    for before in ("see ", "STRIPE_KEY=", "https://h.example/a?sid=", "export A_NAME_OF_MORE_THAN_TWENTY="):
        for alphabet in alphabets:
            for _ in range(6):
                token = "".join(rng.choice(alphabet) for _ in range(32))
                rows.append((len(rows), f"{before}{token} end"))
                spans.append((len(before), len(before) + 32))
    plain = ["ab" * 20, "a" * 40, "a1" * 20, "A-b-" * 10, "ABCABCABC" * 5]
    rows += [(k, f"see {t} end") for k, t in enumerate(plain * 20, len(rows))]
    got = {r.doc_id: {(s.start, s.end) for s in r.secrets if s.kind == 3} for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(span in got[k] for k, span in enumerate(spans)) >= 0.95 * len(spans)
    assert not any(got[k] for k in range(len(spans), len(rows)))


def test_texts_of_spans(spark):
    data = [("a token=abcdefgh1 😀 " + "ab01" * 10 + "!", [(2, 0, 17), (20, 2, 60)]), ("xyz", [(0, 0, 2), (1, 2, 3)]), ("xyz", []), (None, [])]
    df = spark.createDataFrame(data, "text string, s array<struct<start: long, kind: int, end: long>>")
    rows = df.select(redacted(F.col("text"), F.col("s")).alias("r"), span_text(F.col("s")).alias("t")).collect()
    assert [r.r for r in rows] == ["a [secret] 😀 [secret]!", "[secret]", "xyz", None]
    assert [r.t for r in rows] == ["assign:2:17,hex:20:60", "assign:0:2,hex:1:3", "", ""]
    found = spark.createDataFrame([("é1a22b",)], "t string").select(find_all(F.col("t"), "[0-9]+").alias("f")).first().f
    assert [tuple(f) for f in found] == [(1, 2, "1"), (3, 5, "22")]


def test_query_digest(spark):
    from wiretrace.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op5_random_secrets"](spark, folder).collect():
        own = base_spans(text[r.doc_id])
        joined = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in own)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in own) for i in range(3))
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
