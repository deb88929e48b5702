"""Personal data, divergence of sources and the filter audit against plain Python."""

import hashlib
import random
import re
import time
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import divergence, filter_audit, personal
from tests.conftest import same_rows


@pytest.mark.parametrize("name", ["op11_personal_data", "op12_source_divergence", "op13_filter_audit"])
def test_query_matches_sql(name, spark, sf, duck):
    from ledgerline.llm import registry

    same_rows(registry.queries()[name](spark, sf), duck.execute(registry.oracle_sql()[name]))


# --- personal data ----------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in sorted(out))


def with_check_digit(body):
    return body + next(c for c in "0123456789" if luhn(body + c))


def texts_of(rng, n):
    parts = [
        "a.b@c.de", "x@y", "x@y..z", "a@b.c@d.e", "a@b.cd%x@e.f", "@a.b", "é@b.c", "192.168.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "00255.0.0.01", "999999999999.1.1.1", "1.2.3", with_check_digit("400000000000000"),
        "4000 0000-0000 0002", with_check_digit("1" * 13), with_check_digit("7" * 19), "12  34", "+1 (212) 555-0100", "+44", "+1 2", "+123456789012345678", "++49 30 1234567 ", "+5((((((", "日本", "😀", " ", "\n", "tel", "-", ".", "+", "7",
    ]
    return ["".join(rng.choice(parts) + rng.choice(["", "", " ", "x", "9"]) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_base_spans_are_those_of_the_patterns(spark):
    texts = texts_of(random.Random(1), 1500)
    rows = personal.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]]
        assert set(want.split(",")) - {""} <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in BASE] == [want.count(f"{k}:") for k in BASE]


def test_validators_and_context(spark):
    cases = {
        "Konto DE89 3704 0044 0532 0130 00 IS MINE": ["iban"], "GB82WEST12345698765432": ["iban"], "DE89 3704 0044 0532 0130 01": [], "XDE89370400440532013000": [], "NO9386011117947": ["iban"],
        "ssn 123-45-6789": ["ssn"], "123-45-6789": [], "ssn 000-45-6789": [], "ssn 123-00-6789": [], "order no ssn 123-45-6789": [], "ssn 1123-45-6789": [],
        "call 212-555-0100": ["local"], "(212) 555-0100": [], "Call me: (212) 555-0100!": ["local"], "call +1 (212) 555-0100": ["phone"],
    }
    found = personal.find_personal(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    got = {}
    for r in found:
        text = list(cases)[r["doc_id"]]
        assert text[r["start_pos"] : r["end_pos"]] == r["hit"]
        got.setdefault(text, []).append(r["kind"])
    assert {t: k for t, k in cases.items() if k} == got
    scores = {r["kind"]: r["score"] for r in found if r["doc_id"] == 0}
    assert scores == {"iban": 1.0}


def test_long_texts_stay_linear(spark):
    n = 400_000
    texts = ["a" * n, "1" * n, "a@" + "b." * n, "1." * n, "+" * n, "+1" + "(" * n, "ssn 123-45-6789 " * 20_000, "a@b.cd " * 50_000, "DE89" * 50_000]
    began = time.time()
    rows = {r["doc_id"]: r for r in personal.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert time.time() - began < 120
    assert rows[6]["n_ssn"] == 20_000 and rows[7]["n_email"] == 50_000 and rows[7]["spans"].endswith(f"email:{7 * 49_999}:{7 * 49_999 + 6}")


def test_odd_documents(spark, odd_docs, no_docs):
    rows = personal.scan_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r["spans"] for r in rows if r["doc_id"] in (3, 4, 5)} == {""}
    assert personal.scan_documents(no_docs).collect() == [] and personal.find_personal(no_docs).collect() == []


# --- divergence of sources --------------------------------------------------------------------


def test_divergence_on_odd_documents(spark, odd_docs, no_docs):
    rows = divergence.audit(odd_docs, min_docs=2).collect()
    assert {(r["lang"], r["source"]) for r in rows} <= {("en", "s"), ("", ""), ("fr", "s"), ("de", ""), ("ja", "s"), ("el", "s"), ("xx", "s")}
    assert divergence.audit(no_docs).collect() == []


def by_hand(docs, min_docs, top):
    counts, seen, groups = {}, {}, {}
    for lang, source, text in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.setdefault(lang or "", set()).add(source or "")
        for t in terms:
            counts[lang or "", source or "", t] = counts.get((lang or "", source or "", t), 0) + 1
        for t in set(terms):
            seen[lang or "", t] = seen.get((lang or "", t), 0) + 1
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for (lg, t), n in seen.items() if lg == lang and n >= min_docs), key=str.encode)
        n = {s: [counts.get((lang, s, t), 0) for t in kept] for s in sources}
        n_lang = [sum(n[s][i] for s in sources) for i in range(len(kept))]
        share = lambda c: [1 + 10**9 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]  # noqa: B023, E731
        p, q = {s: share(c) for s, c in n.items()}, share(n_lang)
        for s in sources:
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode(), o) for o in sources - {s}))
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            terms = sorted((-(a - b), t.encode(), t) for a, b, t, c in zip(p[s], q, kept, n[s], strict=True) if c > 0 and a > b)
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])}
    return out


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 7, "TILE": 2, "BAND_ROWS": 1}])
def test_divergence_by_hand(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "abcÉΩ日Z" for b in "xyzÀß"]
    docs = [
        (rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", None, "lone"]), None if rng.random() < 0.05 else " ".join(rng.choices(words, weights=[1 / (i + 1 + k % 5) for i in range(len(words))], k=rng.randrange(40))))
        for k in range(300)
    ] + [("it", "only", "ab ab"), ("zz", "a", ""), ("zz", "b", None)]
    frame = spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)
    got = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(frame, min_docs=8, top=6).collect()}
    assert got == by_hand(docs, 8, 6) and len({g for g in got if g[2] == "term"}) > 40


@pytest.mark.parametrize("sizes", [{}, {"BAND_ROWS": 1, "BUFFERED": 20}])
def test_terms_that_only_one_source_has_are_ranked(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(4)
    shared, own = [f"common{a}" for a in "abcdefgh"], {s: [f"{s}{a}{b}" for a in "abcd" for b in "xyz"] for s in ("left", "right", "mid")}
    docs = [(lang, s, " ".join(rng.choices(shared, k=8) + rng.choices(own[s], k=12) + ["evenly"])) for lang in ("en", "de") for s in own for _ in range(12)] + [("en", "empty", "")]
    docs += [("fr", "all", "seul seule")] * 9 + [("fr", "none", None)]  # of the whole language in one source p is q
    frame = spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)
    got = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(frame, min_docs=4, top=6).collect()}
    assert got == by_hand(docs, 4, 6)
    for lang in ("en", "de"):
        for s in own:
            assert [g[3] in own[s] for g in got if g[:3] == (lang, s, "term") and g[5] == 1] == [True]


def test_buffers_lose_no_term_that_may_rank(monkeypatch):
    for name, value in {"SLICE": 20, "BAND_ROWS": 12, "BUFFERED": 60}.items():
        monkeypatch.setattr(divergence, name, value)
    text = "Ab cde9fgh É日本 " * 9 + "x" * 50 + " end"
    assert sum(divergence.term_slices(text.encode()), []) == [t.encode() for t in re.findall("[a-z\x80-\U0010ffff]+", text.lower().replace("é", "É"))]
    rng, rows = random.Random(5), []
    for i in range(900):
        n = rng.randrange(1, 40)
        rows.append((rng.choice("ab"), rng.choice("xyz"), f"t{i}", n, n + rng.choice([0, 1, 40])))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[at : at + 100], strict=True), schema, strict=True)], schema=schema) for at in range(0, 900, 100)]
    left = [tuple(r.values()) for b in divergence.bands(iter(batches), schema, 3) for r in b.to_pylist()]
    assert len(left) == len(set(left)) < 900 and set(left) <= set(rows)
    for r in rows:
        above = sum(o[:2] == r[:2] and o[3] >= r[3] and o[4] <= r[4] and o[2] < r[2] for o in rows)
        assert above >= 3 or r in set(left)


def test_skyband_holds_every_term_that_may_rank():
    rng = np.random.default_rng(3)
    for k in (1, 3, 50):
        n, low, term = rng.integers(0, 30, 700), rng.integers(0, 30, 700), np.array([f"t{i:04d}" for i in rng.permutation(700)], object)
        above = (n[:, None] >= n) & (low[:, None] <= low) & (term[:, None] < term)
        assert sorted(divergence.band(n, low, term, k)) == list(np.flatnonzero(above.sum(axis=0) < k))


def test_shares_are_exact(spark):
    cases = [(0, 0, 7), (10**12, 3 * 10**12 + 1, 10**7), (9_223_372_036, 9_223_372_037, 1), (1, 3, 0)]
    rows = spark.createDataFrame(cases, "n long, total long, v long").select("*", divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert [r["p"] for r in rows] == [1 + 10**9 * (n + 5) // (total + 5 * v) for n, total, v in cases]


# --- filter audit -----------------------------------------------------------------------------


def audited_by_hand(docs, labels):
    texts = {}
    for doc, text, _ in docs:
        if doc is not None:
            texts[text or ""] = min(doc, texts.get(text or "", doc))
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    parts = {}
    for doc, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {x for x, yes in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)), ("D", any(c in "#$%&*|" for c in t)), ("E", doc is not None and doc > texts[t])) if yes}
        parts.setdefault(lang or "", []).append((fails, doc in good, doc in toxic))
    out = {}
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = list(rows)
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                out[part, order, step] = [len(left), len(gone), sum(x in r[0] for r in rows) - len(gone), sum(r[0] == {x} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for x in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == x)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == x:
                    v.append(total)
    return out


def test_audit_by_hand(spark):
    rng = random.Random(6)
    long = " ".join(f"w{i}" for i in range(250))
    pool = [long, long + " #", long.upper(), "x " * 300, "", None, "Aa", long + " é" * 400, "a b\x1cc " * 120, "$"]
    docs = [(rng.choice([None, *range(200)]), rng.choice(pool), rng.choice(["en", "de", None, ""])) for _ in range(400)]
    labels = [(rng.choice([None, *range(200)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(frame, told).collect()
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in rows} == audited_by_hand(docs, labels) and len(rows) == 3 * 600


def test_audit_of_odd_and_no_documents(spark, odd_docs, no_docs, odd_labels):
    rows = filter_audit.audit(odd_docs, odd_labels).collect()
    assert len(rows) == 600 * odd_docs.select(F.coalesce("lang", F.lit(""))).distinct().count()
    assert filter_audit.audit(no_docs, odd_labels).collect() == [] and len(filter_audit.audit(odd_docs, odd_labels.where("false")).collect()) == len(rows)


def test_intervals_are_the_orders():
    names = sorted("".join(p) for p in permutations("ABCDE"))
    assert [filter_audit.lehmer_rank(n) for n in names] == list(range(120))
    removed = {(m, r): [] for m in range(32) for r in range(120)}
    for mask, step, lo, hi in filter_audit.removal_intervals():
        for r in range(lo, hi):
            removed[mask, r].append(step)
    for (mask, r), steps in removed.items():
        hit = [s for s, x in enumerate(names[r], 1) if mask >> "ABCDE".index(x) & 1]
        assert steps == hit[:1]
