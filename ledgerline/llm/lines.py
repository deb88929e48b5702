"""Line dedup with a log-template tree, by DataFrame functions only.

A line's words are its tokens; tokens with a digit are variable fields. The tree has a fixed
depth: token count, then the first DEPTH tokens. In a leaf with several different lines, each
further position is constant if one token holds more than half of the leaf's different lines and
variable otherwise; lines that agree with the leaf on SIMILAR of all positions share the leaf's
template. The lines left over are grouped by the token, shared by two of them at least but not by all, that
most of them have (the earlier place if equal), and each group is treated like a leaf, for LEVELS levels in all. What
is left then is its own template. A template that occurs in two or more documents is
dropped everywhere but in the document with the smallest doc_id among them (with ``everywhere``, there too).

Lines of fewer than ``min_tokens`` tokens are kept, as they are no passages. Null texts stay null, empty ones
empty; rows without doc_id are kept as they are and make no template recur; rows of one doc_id count as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, read, sized, written
from .personal import held

DEPTH, MIN_TOKENS, SIMILAR, LEVELS = 4, 4, 0.7, 3
FIELD = "<*>"


def normal_text(text: Column) -> Column:
    """One space between the tokens of each line; most texts are so already."""
    odd = text.contains("\t") | text.contains("\r") | text.contains("  ")
    return F.when(odd, F.regexp_replace(text, "[ \t\r]{2,}|[\t\r]", " ")).otherwise(text)


def masked(line: Column) -> Column:
    """Tokens with a digit are FIELD. A match starts where a token does and never steps back, so long tokens cost no more."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(line)


def template_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, line_no, n_tokens, norm (the line with single spaces) and lead (the hash of the leading tokens, masked) of
    lines that can be templates."""
    text = normal_text(F.col("text").cast("string"))
    lines = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    lines = lines.select("doc_id", "line_no", F.trim("line").alias("norm"))
    if min_tokens > 1:  # looks at the first tokens only, as Spark computes what a filter uses once more below it
        lines = lines.where(F.octet_length(F.substring_index("norm", " ", min_tokens - 1)) < F.octet_length("norm"))
    tokens = F.octet_length("norm") - F.octet_length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) + 1
    return lines.select("doc_id", "line_no", tokens.alias("n_tokens"), "norm", F.xxhash64(masked(F.substring_index("norm", " ", DEPTH))).alias("lead"))


def hashes() -> list[Column]:
    """A masked line's two hashes: 128 bits together."""
    return [F.xxhash64("masked").alias("h1"), F.xxhash64(F.lit(1), "masked").alias("h2")]


LEAF, LINE = ["n_tokens", "lead"], ["h1", "h2"]


def shared_templates(tokens: DataFrame, level: int) -> DataFrame:
    """h1, h2, t1 and t2 of the lines that share their group's template. ``tokens``: LEAF, part, LINE, place, token."""
    group = [*LEAF, "part"]
    counts = tokens.groupBy(*group, "place", "token").agg(F.count("*").alias("n"))
    sizes = counts.where("place = 0").groupBy(*group).agg(F.sum("n").alias("n_lines")).where("n_lines > 1")
    # more than half of the lines: at most one token of a place
    constant = counts.join(sizes, group).where(F.col("n") * 2 > F.col("n_lines")).select(*group, "place", "token")
    agree = tokens.join(constant, [*group, "place", "token"], "left_semi").groupBy(*group, *LINE).agg(F.count("*").alias("agree"))
    agree = agree.where(F.col("agree") >= F.lit(SIMILAR) * F.col("n_tokens"))
    return agree.select(*LINE, F.col("lead").alias("t1"), F.xxhash64("n_tokens", F.lit(level), "part").alias("t2"))


def parted(tokens: DataFrame) -> DataFrame:
    """``tokens`` with their groups parted by the token that most lines of a group share; lines that share none go."""
    group = [*LEAF, "part"]
    counts = tokens.groupBy(*group, "place", "token").agg(F.count("*").alias("n"))
    sizes = counts.where("place = 0").groupBy(*group).agg(F.sum("n").alias("n_lines"))
    choices = counts.where("n > 1").join(sizes, group).where("n < n_lines").select(*group, "place", "token", "n")
    best = F.max(F.struct("n", (-F.col("place")).alias("first"), "token")).alias("best")
    chosen = tokens.join(choices, [*group, "place", "token"]).groupBy(*LINE).agg(best)
    chosen = chosen.select(*LINE, F.col("best.first").alias("first"), F.col("best.token").alias("by"))
    return tokens.join(chosen, LINE).withColumn("part", F.xxhash64("part", "first", "by")).drop("first", "by")


def leaf_templates(docs: DataFrame, different: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """h1, h2, t1, t2 of the lines that share a template with others of their leaf. The texts are read again for
    the lines of leaves that hold several different ones, one copy of each."""
    shared = written(different.groupBy(*LEAF).agg(F.count("*").alias("n_lines")).where("n_lines > 1").select(*LEAF), "leaves")
    rows = template_lines(docs, min_tokens).join(sized(shared), LEAF).withColumn("masked", masked(F.col("norm"))).select(*LEAF, "masked", *hashes())
    rows = rows.groupBy(*LINE).agg(F.any_value("masked").alias("masked"), *(F.any_value(c).alias(c) for c in LEAF))
    tokens = rows.select(*LEAF, F.lit(0).cast("bigint").alias("part"), *LINE, F.posexplode(F.split("masked", " ")).alias("place", "token"))
    tokens = written(tokens.withColumn("token", F.xxhash64("token")), "tokens")
    found = written(shared_templates(tokens, 0), "shared")
    out = found
    for level in range(1, LEVELS):
        tokens = written(parted(tokens.join(found, LINE, "left_anti")), "tokens")
        found = written(shared_templates(tokens, level), "shared")
        out = out.unionByName(found)
    return out


def recurring_lines(docs: DataFrame, everywhere: bool = False, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id and line_no of every line whose template recurs, except in the first document that has it."""
    lines = template_lines(docs, min_tokens).withColumn("masked", masked(F.col("norm")))
    lines = written(lines.select("doc_id", "line_no", "n_tokens", "lead", *hashes()), "lines")
    different = lines.groupBy(*LINE).agg(
        F.max("n_tokens").alias("n_tokens"), F.max("lead").alias("lead"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )
    different = written(different, "different")
    shared = leaf_templates(docs, different, min_tokens)
    # A template is shared or a line of its own: both are two numbers, told apart by a third.
    own = F.col("t1").isNull()
    template = [own.alias("own"), F.when(own, F.col("h1")).otherwise(F.col("t1")).alias("t1"), F.when(own, F.col("h2")).otherwise(F.col("t2")).alias("t2")]
    templates = written(different.select(*LINE, "first_doc", "last_doc").join(shared, LINE, "left").select(*LINE, "first_doc", "last_doc", *template), "templates")
    spread = templates.groupBy("own", "t1", "t2").agg(F.min("first_doc").alias("keeper"), F.max("last_doc").alias("last")).where("keeper < last")
    dropped = templates.join(spread, ["own", "t1", "t2"]).select(*LINE, "last_doc", (F.lit(None).cast("bigint") if everywhere else F.col("keeper")).alias("keeper"))
    dropped = dropped.where("keeper IS NULL OR last_doc > keeper").drop("last_doc")
    return lines.select("doc_id", "line_no", *LINE).join(dropped, LINE).where("keeper IS NULL OR doc_id > keeper").select("doc_id", "line_no")


def drop_recurring_lines(docs: DataFrame, counts: bool = False, everywhere: bool = False, min_tokens: int = MIN_TOKENS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with text reduced to the lines that stay; with ``counts`` also n_lines and n_dropped,
    which replace columns of these names."""
    doc, gone_lines = free_name(docs, "line_doc"), free_name(docs, "line_gone")
    gone = written(recurring_lines(docs, everywhere, min_tokens).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line_no").alias(gone_lines)), "gone")
    # what a broadcast would hold is the lines, not the documents
    n_gone = gone.agg(F.sum(F.size(gone_lines))).first()[0] or 0
    gone = F.broadcast(gone) if n_gone <= broadcast_rows else gone
    out = docs.join(gone, docs["doc_id"].cast("bigint") == F.col(doc), "left")
    text = F.col("text").cast("string")
    some = F.col(doc).isNotNull() & F.col("text").isNotNull()
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_lines))
    left = held(F.split(text, "\n", -1), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))
    kept = F.when(some, left).otherwise(F.col("text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    n_dropped = F.when(some, F.size(gone_lines)).otherwise(0).cast("bigint")
    more = {"n_lines": n_lines, "n_dropped": n_dropped} if counts else {}
    columns = [kept.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in more]
    return out.select(*columns, *(c.alias(n) for n, c in more.items()))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def line_dedup_sql(docs: str = "documents") -> str:
    """The same in DuckDB, over the relation ``docs``: doc_id, text, n_lines, n_dropped."""
    group, levels = "n_tokens, lead, part", []
    for k in range(LEVELS):
        if k == 0:
            source = "SELECT n_tokens, lead, '' AS part, masked, unnest(string_split(masked, ' ')) AS token, unnest(range(n_tokens)) AS place FROM different JOIN leaves USING (n_tokens, lead)"
            levels.append("leaves AS (SELECT n_tokens, lead FROM different GROUP BY n_tokens, lead HAVING count(*) > 1)")
        else:
            levels += [
                f"rest{k} AS (SELECT * FROM places{k - 1} ANTI JOIN shared{k - 1} USING (masked))",
                f"choice{k} AS (SELECT *, count(*) AS n FROM (SELECT {group}, place, token FROM rest{k}) GROUP BY ALL)",
                f"chosen{k} AS (SELECT masked, arg_max(place || ' ' || token, (n, -place)) AS pick FROM rest{k} JOIN choice{k} USING ({group}, place, token) JOIN (SELECT {group}, sum(n) AS size FROM choice{k} WHERE place = 0 GROUP BY ALL) USING ({group}) WHERE n > 1 AND n < size GROUP BY masked)",
            ]
            source = f"SELECT n_tokens, lead, part || '/' || pick AS part, masked, token, place FROM rest{k} JOIN chosen{k} USING (masked)"
        levels += [
            f"places{k} AS ({source})",
            f"size{k} AS (SELECT {group}, count(*) AS n_lines FROM places{k} WHERE place = 0 GROUP BY ALL HAVING count(*) > 1)",
            f"constant{k} AS (SELECT {group}, place, token FROM places{k} JOIN size{k} USING ({group}) GROUP BY {group}, n_lines, place, token HAVING count(*) * 2 > n_lines)",
            f"shared{k} AS (SELECT masked, {k} || part AS part FROM places{k} JOIN constant{k} USING ({group}, place, token) GROUP BY masked, {group} HAVING count(*) >= {SIMILAR}::DOUBLE * n_tokens)",
        ]
    return rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM {docs} WHERE text IS NOT NULL),
normed AS (SELECT doc_id, line_no, trim(regexp_replace(line, '[ \t\r]+', ' ', 'g')) AS norm FROM raw),
lines AS (
  SELECT doc_id, line_no, regexp_replace(norm, '[^ 0-9]*[0-9][^ ]*', '{FIELD}', 'g') AS masked,
         length(norm) - length(replace(norm, ' ', '')) + 1 AS n_tokens
  FROM normed WHERE length(norm) - length(replace(norm, ' ', '')) + 1 >= {MIN_TOKENS}),
different AS (
  SELECT masked, n_tokens, array_to_string(string_split(masked, ' ')[1:{DEPTH}], ' ') AS lead,
         min(doc_id) AS first_doc, max(doc_id) AS last_doc
  FROM lines GROUP BY masked, n_tokens),
{", ".join(levels)},
shared AS ({" UNION ALL ".join(f"SELECT * FROM shared{k}" for k in range(LEVELS))}),
templates AS (
  SELECT d.masked, d.first_doc, d.last_doc,
         CASE WHEN s.masked IS NULL THEN 'line ' || d.masked ELSE 'leaf ' || d.n_tokens || ' ' || d.lead || ' ' || s.part END AS template
  FROM different d LEFT JOIN shared s ON d.masked = s.masked),
spread AS (SELECT template, min(first_doc) AS keeper FROM templates GROUP BY template HAVING min(first_doc) < max(last_doc)),
gone AS (
  SELECT doc_id, line_no FROM lines JOIN templates USING (masked) JOIN spread USING (template) WHERE doc_id > keeper),
kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.line_no) AS text
  FROM raw r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = r.doc_id AND g.line_no = r.line_no) GROUP BY r.doc_id),
n AS (SELECT doc_id, count(*) AS n_dropped FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(n.n_dropped, 0) AS n_dropped
FROM {docs} d LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
