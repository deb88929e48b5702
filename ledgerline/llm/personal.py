"""Personal data in texts, by DataFrame functions only.

Regular expressions propose spans, validators confirm them (parts of an address, numbers of digits, the Luhn sum of
cards, the remainder by 97 of bank accounts), and words near a span adjust its score. Kinds email, ip, card and phone
are found wherever their pattern and validator say so; iban, ssn and local (a telephone number without country) are
spans only from the score LEAST on: a bank account scores by its checksum, the other two need a word that tells them.

A span's context is the CONTEXT characters on either side, as far as the neighbouring proposals of its kind.
Places are code points, ends exclusive. A text is split at its proposals, so places are sums of lengths, made by
running sums in two levels: a text of n proposals costs n * sqrt(n) small additions, and never a search from its start.
The patterns are written so that Java's matcher neither recurses nor tries a run of characters again from within.

Null and empty texts have no spans; each row gets its own result, repeated rows and rows without an id too; an empty
table gives none. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_or_empty

CONTEXT, LEAST, STEP = 48, 0.6, 0.3
# Characters of a bank account number by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
IBAN = "|".join(f"(?:{'|'.join(c for c in IBAN_LENGTHS if IBAN_LENGTHS[c] == n)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTHS.values())))
#: In the order in which spans at one place are listed. The look-behinds and possessive marks change no match: a run that
#: fails from its first character fails from all others.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": IBAN,
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}",
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span, words nearby that raise it by STEP and that lower it by STEP.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local": 0.4}
RAISED_BY = {
    "email": r"\b(?:e-?mail|contact|write)", "ip": r"\b(?:ip|address|host|server)\b", "card": r"\b(?:card|visa|mastercard|credit|debit|karte|carte|tarjeta)",
    "phone": r"\b(?:tel|phone|call|mobile|fax)", "iban": r"\b(?:iban|account|bank|konto|compte|cuenta)", "ssn": r"\b(?:ssn|social security|taxpayer)",
    "local": r"\b(?:tel|phone|call|mobile|cell|fax)",
}
LOWERED_BY = r"\b(?:order|invoice|isbn|part no|serial|version|ticket)"
#: What may not stand right before and right after.
NOT_BEFORE = {"iban": "[A-Za-z0-9]$", "ssn": "[A-Za-z0-9-]$", "local": r"(?:[A-Za-z]|[0-9+][\x20().-]*)$"}
NOT_AFTER = {"iban": "^[A-Za-z0-9]", "ssn": "^[A-Za-z0-9-]", "local": "^[A-Za-z0-9-]"}
#: Cheap to look for, and in every text with a proposal.
HINTS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
KINDS = tuple(PATTERNS)


def held(value: Column, use) -> Column:
    """``use(value)``, with the value computed once: what a lambda mentions is otherwise computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column) -> Column:
    """The sum of ``values`` (an array of int) up to and including each place, by chunks of about sqrt(n)."""
    zero, add = F.lit(0), lambda a, x: a + x

    def by_chunks(v: Column, c: Column) -> Column:
        chunk_of = lambda i: F.floor(i / c).cast("int")
        places = F.sequence(zero, F.floor((F.size(v) - 1) / c).cast("int"))
        of_chunks = F.transform(places, lambda j: F.aggregate(F.slice(v, j * c + 1, c), zero, add))
        before = held(of_chunks, lambda sums: F.transform(sums, lambda _, j: F.aggregate(F.slice(sums, F.lit(1), j), zero, add)))
        return held(before, lambda b: F.transform(v, lambda _, i: F.get(b, chunk_of(i)) + F.aggregate(F.slice(v, chunk_of(i) * c + 1, i % c + 1), zero, add)))

    length = lambda v: F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
    sums = held(values, lambda v: held(length(v), lambda c: by_chunks(v, c)))
    return F.when(F.size(values) > 0, sums).otherwise(F.array().cast("array<int>"))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def is_account(hit: Column) -> Column:
    """Whether a bank account number leaves 1 when divided by 97, its first four characters put last and letters as 10 to 35."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "")
    add = lambda rest, x: F.when(x >= "A", rest * 100 + F.ascii(x) - 55).otherwise(rest * 10 + F.ascii(x) - 48) % 97
    return F.aggregate(moved, F.lit(0), add) == 1


def confirmed(kind: str, hit: Column) -> Column:
    """Whether a proposal is what its pattern makes it look like."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        number = digits(hit)
        return F.when(F.length(number).between(14, 19), passes_luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(hit)).between(10, 15)
    if kind == "iban":
        return is_account(hit)
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


def proposals(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with an array for each kind: place, hit and what is around it, of every match of its pattern."""
    none = F.array().cast("array<string>")
    found = {f"{k}_hits": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    found |= {f"{k}_hits": F.when(F.contains(F.col(text), F.lit(h)), found[f"{k}_hits"]).otherwise(none) for k, h in HINTS.items()}
    rows = rows.withColumns(found)
    rows = rows.withColumns({f"{k}_gaps": F.when(F.size(f"{k}_hits") > 0, F.split(text, p, -1)).otherwise(none) for k, p in PATTERNS.items()}).drop(text)

    def sizes(k: str) -> Column:
        return held(F.col(f"{k}_gaps"), lambda gaps: F.transform(f"{k}_hits", lambda h, i: F.length(h) + F.length(F.get(gaps, i))))

    rows = rows.withColumns({f"{k}_sizes": sizes(k) for k in KINDS})
    rows = rows.withColumns({f"{k}_ends": running_sums(F.col(f"{k}_sizes")) for k in KINDS})

    def spans(k: str) -> Column:
        make = lambda ends, gaps: F.transform(f"{k}_hits", lambda h, i: F.struct(
            (F.get(ends, i) - F.length(h)).alias("start_pos"), F.get(ends, i).alias("end_pos"), h.alias("hit"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"),
        ))
        return held(F.col(f"{k}_ends"), lambda ends: held(F.col(f"{k}_gaps"), lambda gaps: make(ends, gaps)))

    used = [f"{k}_{part}" for k in KINDS for part in ("hits", "gaps", "sizes", "ends")]
    return rows.withColumns({k: spans(k) for k in KINDS}).drop(*used)


def scored(kind: str) -> Column:
    """The spans among the proposals of a kind: start_pos, kind's number, end_pos, hit and score."""
    told = f"(?i){RAISED_BY[kind]}"

    def make(p: Column) -> Column:
        around = F.concat_ws(" ", p["before"], p["after"])
        score = F.lit(SCORES[kind]) + F.when(around.rlike(told), STEP).otherwise(0.0) - F.when(around.rlike(f"(?i){LOWERED_BY}"), STEP).otherwise(0.0)
        return F.struct(p["start_pos"].alias("start_pos"), F.lit(KINDS.index(kind)).alias("kind"), p["end_pos"].alias("end_pos"), p["hit"].alias("hit"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

    rule = lambda p: confirmed(kind, p["hit"])
    if kind not in BASE:
        rule = lambda p: ~p["before"].rlike(NOT_BEFORE[kind]) & ~p["after"].rlike(NOT_AFTER[kind]) & confirmed(kind, p["hit"])
    spans = F.transform(F.filter(F.col(kind), rule), make)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LEAST)


def with_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with the spans of each kind in place of the text."""
    rows = proposals(rows)
    return rows.withColumns({k: scored(k) for k in KINDS})


def joined(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind as listed, with commas between."""
    named = F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start_pos"], s["end_pos"]))
    return F.array_join(named, ",")


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start_pos, end_pos, hit (the matched string) and score."""
    rows = with_spans(source(docs, id_col, text_col)).select("doc_id", F.inline(F.concat(*KINDS)))
    return rows.withColumn("kind", F.get(F.array(*map(F.lit, KINDS)), F.col("kind"))).select("doc_id", "kind", "start_pos", "end_pos", "hit", "score")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the number of spans of each kind, a digest of the base kinds' spans, and all spans."""
    rows = with_spans(source(docs, id_col, text_col))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    places = {k: F.transform(k, lambda s: F.struct(s["start_pos"].alias("start_pos"), s["kind"].alias("kind"), s["end_pos"].alias("end_pos"))) for k in KINDS}
    base = F.sha2(joined(F.concat(*(places[k] for k in BASE))), 256)
    every = joined(F.concat(*places.values()))
    return rows.select("doc_id", *counts[: len(BASE)], base.alias("base_sha256"), every.alias("spans"), *counts[len(BASE) :])


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read(spark, sf_dir, "documents"))


def personal_sql() -> str:
    """The same in DuckDB, with the patterns as they are without the marks for Java, and places by sums over lists."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": IBAN, "ssn": PATTERNS["ssn"], "local": PATTERNS["local"],
    }
    luhn = """list_sum(list_transform(range(length(d)), lambda j: CASE WHEN j % 2 = 0 THEN substr(d, (length(d) - j)::BIGINT, 1)::INTEGER
      ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(d, (length(d) - j)::BIGINT, 1)::INTEGER + 1] END)) % 10 = 0"""
    moved = "regexp_replace(substr(replace(hit, ' ', ''), 5) || substr(replace(hit, ' ', ''), 1, 4), '^', '')"
    mod97 = f"""list_reduce(list_prepend(0::BIGINT, list_transform(string_split({moved}, ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END::BIGINT)),
      lambda a, b: CASE WHEN b > 9 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1"""
    rules = {
        "email": "true", "ip": "list_max(list_transform(string_split(hit, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE coalesce(nullif(ltrim(x, '0'), ''), '0')::INTEGER END)) <= 255",
        "card": f"CASE WHEN length(d) BETWEEN 14 AND 19 THEN {luhn} ELSE false END", "phone": "length(d) BETWEEN 10 AND 15", "iban": mod97,
        "ssn": "NOT regexp_matches(hit, '^(?:000|666|9)|-00-|0000$')", "local": "true",
    }

    def of(k: str) -> str:
        p, edges = plain[k], ""
        if k not in BASE:
            edges = f" AND NOT regexp_matches(before, '{NOT_BEFORE[k]}') AND NOT regexp_matches(after, '{NOT_AFTER[k]}')"
        score = f"round(least(1, {SCORES[k]} + CASE WHEN regexp_matches(before || ' ' || after, '(?i){RAISED_BY[k]}') THEN {STEP} ELSE 0 END - CASE WHEN regexp_matches(before || ' ' || after, '(?i){LOWERED_BY}') THEN {STEP} ELSE 0 END), 2)"
        least = f" AND {score} >= {LEAST}" if k not in BASE else ""
        return f"""SELECT rid, {KINDS.index(k)} AS k, '{k}' AS kind, start, start + length(hit) AS stop FROM (
  SELECT rid, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS d, right(gaps[i], {CONTEXT}) AS before, left(gaps[i + 1], {CONTEXT}) AS after,
    list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT rid, hits, gaps, unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM texts) WHERE len(hits) > 0)) WHERE {rules[k]}{edges}{least}"""

    parts = " UNION ALL ".join(of(k) for k in KINDS)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS)
    base = ", ".join(f"'{k}'" for k in BASE)
    listed = "string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k)"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), spans AS ({parts}),
facts AS (SELECT rid, {counts}, sha256(coalesce({listed} FILTER (WHERE kind IN ({base})), '')) AS base_sha256, {listed} AS spans FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN facts USING (rid)
"""

