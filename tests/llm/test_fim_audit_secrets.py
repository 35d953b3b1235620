"""Fill-in-the-middle, filter audit and secret scan against plain versions, with nulls, empty and long texts, repeats, clashing names."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kiln.llm import fill_in_middle as fim
from kiln.llm import filter_audit, queries, secret_scan

DOCS = "doc_id long, text string, lang string, n long, form string, part string, fails int, digest string, good int, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x", "y", 3, "z", 1, "k") for i, t, g in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé😀中AB") for _ in range(rnd.randrange(1, 9)))
    out = [
        (1, None, "en"),
        (2, "", "en"),
        (3, "", None),
        (4, " \t\n ", ""),
        (None, "same text", "en"),
        (5, "same text", "fr"),
        (6, "same text", "en"),
        (5, "same text", "fr"),
        (7, "has <P> inside", "en"),
        (8, "<S", "de"),
        (9, "<M<P", "de"),
        (10, "é‍😀\x00x", "de"),
        (11, "é" * 70_000 + "😀" * 3, "en"),
        (2**60 + 1, "large id", "en"),
    ]
    out += [(20 + i, " ".join(word() for _ in range(rnd.randrange(400))) + rnd.choice(["", "$", "ABCDEF" * 40]), "en") for i in range(120)]
    out += [(500 + i, f"copy {i % 3} " * (1 + 100 * (i % 2)), rnd.choice(["en", "es", None])) for i in range(40)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def plain_fim(doc_id, text, epoch="1"):
    text = text or ""
    h = hashlib.sha256(f"{epoch}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", i, j - i, "<S>" + text[j:] + "<P>" + text[:i] + "<M>" + text[i:j]
    return n, "psm", i, j - i, "<P>" + text[:i] + "<S>" + text[j:] + "<M>" + text[i:j]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fim_equals_plain(spark, docs, rows):
    made = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect()), key=key)
    want = sorted(((i, *plain_fim(i, t), t or "") for i, t, _ in rows), key=key)
    assert got == want and {r[2] for r in want} == {"plain", "psm", "spm"}
    for r in made.collect():
        assert r.output_sha256 == sha(r.output) and r.restored_sha256 == sha(r.back)
    short = fim.transform(docs, keep_text=False)
    assert short.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert fim.transform(docs.limit(0)).count() == 0


def test_fim_units(spark):
    text = "one  two\nthree four five six seven"
    units = fim.Units(r"\S+\s*")
    assert [text[: e] for e in units.ends(text)][:2] == ["one  ", "one  two\n"]
    assert list(fim.Units(r"\X").ends("éx")) == [2, 3]
    assert list(fim.Units("b").ends("abab")) == [2, 4]
    assert len(fim.Units().ends("x" * 5000)) == 5000 and list(fim.Units().ends("a\nb")) == [1, 2, 3]
    df = spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string")
    rates = fim.Rates(rearranged=100, suffix_first=50)
    found = fim.transform(df, unit=r"\S+\s*", rates=rates, epoch=7, sentinels=("[a]", "[b]", "[c]"))
    for r in found.collect():
        assert r.n == 7 and r.form in ("psm", "spm")
        assert text[: r.prefix_chars] in {"", *(text[:e] for e in units.ends(text))}
        assert fim.restore(r.output, r.form, ("[a]", "[b]", "[c]")) == text
    for bad in (("<P>", "<P>x", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("", "b", "c"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.checked(bad)
    with pytest.raises(ValueError):
        fim.Units("a*")


@given(st.text(st.sampled_from("<PSM>ab\n😀"), max_size=30), st.integers(0, 10**6))
@settings(max_examples=400, deadline=None)
def test_fim_round_trip(text, doc_id):
    n, form, i, length, output = fim.rearrange(text, str(doc_id), fim.Units(), fim.Rates(), 1, fim.SENTINELS)
    assert (n, form, i, length, output) == plain_fim(doc_id, text) and fim.restore(output, form) == text


def fails(rows):
    """The filters that each row fails, by a plain reading."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _ in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        yield "".join(
            name
            for name, bad in zip(
                "ABCDE",
                (
                    len(w) < 200,
                    100 * len(set(w)) < 50 * len(w),
                    100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                    any(c in t for c in "#$%&*|"),
                    i is not None and i > least[t],
                ),
            )
            if bad
        )


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    out, shapley = {}, Counter()
    bad = list(fails(rows))
    parts = {g or "" for _, _, g in rows}
    for order in permutations("ABCDE"):
        for part in parts:
            mine = [(i, b) for (i, _, g), b in zip(rows, bad) if (g or "") == part]
            for step, f in enumerate(order):
                gone = [any(x in b for x in order[:step]) for _, b in mine]
                removed = [i for (i, b), g in zip(mine, gone) if not g and f in b]
                shapley[part, f] += len(removed)
                out[part, "".join(order), step + 1] = [
                    sum(not g and f not in b for (_, b), g in zip(mine, gone)),
                    len(removed),
                    sum(g and f in b for (_, b), g in zip(mine, gone)),
                    sum(b == f for _, b in mine),
                    sum(i in good and i is not None for i in removed),
                    sum(i in toxic and i is not None for i in removed),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_plain(spark, docs, rows):
    labels = [(5, 1, 0), (5, 0, 1), (20, 1, 1), (None, 1, 1), (6, None, 1), (501, 1, None), (999_999, 1, 1)]
    labels += [(i, i % 2, i % 3 == 0) for i in range(30, 90)]
    table = spark.createDataFrame([(i, q, int(x) if x is not None else None, "p", 9) for i, q, x in labels], "doc_id long, quality long, toxic long, part string, n long")
    got = filter_audit.audit(docs, table).collect()
    assert len(got) == 600 * len({g or "" for _, _, g in rows})
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), table).count() == 0
    assert filter_audit.audit(docs, table.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_of_own_filters(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    own = {"x": F.col("doc_id") > 30, "y": F.col("text").isNull()}
    got = {(r.filter_order, r.step): r for r in filter_audit.audit(docs.withColumn("lang", F.lit("one")), none, own, copies=None).collect()}
    assert len(got) == 4
    assert got["xy", 1].removed == sum(i is not None and i > 30 for i, _, _ in rows) and got["yx", 1].removed == 1
    with pytest.raises(ValueError):
        filter_audit.audit(docs, none, {"ab": F.lit(True)})


def test_audit_of_a_hot_text(spark):
    """One text has all but a few of 30,000 rows, some of which repeat an id as well."""
    df = spark.range(30_000).select((F.col("id") % 20_000).alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    first = filter_audit.audit(df, none).where("filter_order = 'EABCD' AND step = 1").first()
    assert (first.kept, first.removed) == (2, 29_998)


#: The base, as the contract has it.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)


def plain_base(text):
    found = [
        (m.start(), k, m.end(), name)
        for k, (name, rule, group, least) in enumerate(RULES)
        for m in rule.finditer(text)
        if len(m[group]) >= least
    ]
    return [f"{name}:{begin}:{end}" for begin, _, end, name in sorted(found)]


def own_base(text):
    return [f"{s['kind']}:{s['begin']}:{s['end']}" for s in secret_scan.find_secrets(text) if s["kind"] in secret_scan.BASE]


PIECES = ["password", "PassWD", "secret", "ſecret", "toKen", "toen", "token", "api_key", "APIKEY", "apikey", "=", ":", " ", "  ", '"', "'", "abcdefgh", "x1+/", "é", "😀", "AKIA", "AKIA0123456789AB", "0" * 31, "f" * 33, "9f", "F", "\n", "-", "ghp_", "eyJ", "."]


@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
@settings(max_examples=1500, deadline=None)
def test_base_spans_equal_search(text):
    assert own_base(text) == plain_base(text)


def base62(value):
    return "".join(chr(secret_scan.BASE62[value // 62**k % 62]) for k in range(5, -1, -1))


def base58(raw):
    value, out = int.from_bytes(raw, "big"), ""
    while value:
        value, digit = divmod(value, 58)
        out = chr(secret_scan.BASE58[digit]) + out
    return out


def bech32(name, data):
    """By the published rule: six digits make the polynomial one."""
    def polymod(values):
        value = 1
        for v in values:
            top = value >> 25
            value = (value & 0x1FFFFFF) << 5 ^ v
            for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
                value ^= g if (top >> i) & 1 else 0
        return value

    spread = [ord(c) >> 5 for c in name] + [0] + [ord(c) & 31 for c in name]
    check = polymod(spread + data + [0] * 6) ^ 1
    digits = data + [(check >> 5 * (5 - i)) & 31 for i in range(6)]
    return name + "1" + "".join(chr(secret_scan.BECH32[d]) for d in digits)


def planted():
    body = "a1B2" * 7 + "zZ"
    check = base62(zlib.crc32(body.encode()))
    raw = bytes.fromhex("0488ade4") + bytes(range(74))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    der = b"\x30\x82\x01\x00" + bytes(256)
    lines = base64.encodebytes(der).decode()
    return {
        "github": f"ghp_{body}{check}",
        "npm": f"npm_{body}{check}",
        "xprv": base58(raw),
        "age": bech32("age-secret-key-", [i % 32 for i in range(52)]).upper(),
        "nsec": bech32("nsec", [7 * i % 32 for i in range(52)]),
        "jwt": f"{part({'alg': 'HS256'})}.{part({'sub': '1'})}.c2ln",
        "pem": f"-----BEGIN RSA PRIVATE KEY-----\n{lines}-----END RSA PRIVATE KEY-----",
    }


@pytest.mark.parametrize("kind", sorted(planted()))
def test_proofs(kind):
    secret = planted()[kind]
    text = f"😀 before {secret} after"
    assert {"kind": kind, "begin": 9, "end": 9 + len(secret)} in secret_scan.find_secrets(text)
    at = len(secret) // 2 if kind not in ("jwt", "pem") else 40
    for other in "qZ":
        broken = secret[:at] + other + secret[at + 1 :] if kind != "pem" else secret.replace("\n-----END", "AAAA\n-----END")
        if broken != secret and kind != "jwt":
            assert kind not in {s["kind"] for s in secret_scan.find_secrets(f"x {broken} y")}
    assert kind not in {s["kind"] for s in secret_scan.find_secrets("x " + secret[:-8] + " y")} or kind == "jwt"
    if kind == "jwt":
        assert not secret_scan.find_secrets(secret.replace("eyJ", "eyJ!"))
        assert not secret_scan.find_secrets("eyJub3Rfanc.eyJub3Q.x")


def test_xprv_begins_with_its_keyword():
    assert planted()["xprv"].startswith("xprv") and len(planted()["xprv"]) == 111


def test_secret_scan_of_a_table(spark, tmp_path):
    token = planted()["github"]
    rows = [
        (1, None, "en"),
        (2, "", "en"),
        (3, f"é password = {'x' * 9} and {token}", "en"),
        (3, f"é password = {'x' * 9} and {token}", "en"),
        (None, "token: " + "0af9" * 10, "en"),
        (4, "eyJ" * 100_000 + "password" * 50_000 + " " * 300_000 + "-----BEGIN " * 20_000, "en"),
        (5, "passwd=" + "z" * 200_000, "en"),
        (6, "plain prose about a secret and a token", "en"),
    ]
    df = frame(spark, rows)
    got = sorted(((r.doc_id or -1, [f"{s.kind}:{s.begin}:{s.end}" for s in r.spans]) for r in secret_scan.scan(df).collect()), key=str)
    want = sorted(((i or -1, [f"{s['kind']}:{s['begin']}:{s['end']}" for s in secret_scan.find_secrets(t)]) for i, t, _ in rows), key=str)
    assert got == want
    spans = {i: s for i, s in got}
    assert spans[3] == ["assign:2:22", "github:27:67"] and spans[-1] == ["assign:0:47", "hex:7:47"] and spans[5] == ["assign:0:200007"]
    assert spans[1] == spans[2] == spans[4] == spans[6] == []
    clean = {r.doc_id: r.text for r in secret_scan.redacted(df).collect()}
    assert clean[3] == "é <assign> and <github>" and clean[1] is None and clean[None] == "<assign>" and clean[6] == rows[-1][1]
    assert secret_scan.redacted(df).columns == df.columns
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_op13_equals_search(spark, sf):
    sf = sf.replace("0.001", "0.01")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_secret_scan(spark, sf).collect()
    assert len(got) == len(texts) and any(r.n_assign for r in got)
    for r in got:
        base = plain_base(texts[r.doc_id])
        counts = Counter(s.split(":")[0] for s in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(counts[k] for k in secret_scan.BASE)
        assert r.base_sha256 == sha(",".join(base)) and set(base) <= {*r.spans.split(",")}
