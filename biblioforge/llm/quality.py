"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger row holds the measurements and
one failure bit per rule. A policy is a named, versioned bit mask: applying one, or
asking what each of its rules costs, reads only the ledger, never the texts.

All of it is DataFrame expressions on one row, so nothing is shuffled to build a ledger
and a document of any length is one row's work.

Defined cases: a null or empty text has no words and fails ``few_words``; repeated rows
and rows with a null id are each judged on their own; columns beside the id and the text
are dropped, so clashing names do no harm; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

WS = r"[\x20\x09-\x0D]+"

#: Rule name -> bit. Bits are never reused, so ledgers of all versions can be read together.
BITS = {"few_words": 0, "repeated_windows": 1, "symbols": 2, "shouting": 3, "stutter": 4, "repeated_lines": 5}


@dataclass(frozen=True)
class Policy:
    """Which rules reject a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BITS[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
CORPUS = Policy("corpus", 1, ("few_words", "repeated_windows", "symbols", "shouting", "stutter", "repeated_lines"))
#: Headings and acronyms in capitals stay.
CORPUS_2 = Policy("corpus", 2, ("few_words", "repeated_windows", "symbols", "stutter", "repeated_lines"))
POLICIES = (CORPUS, CORPUS_2)


def measure(docs: DataFrame, head: Column | str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """One row of counts per document, in three projections over its word array. ``head`` is
    the one column that goes along, the id or a struct of more."""
    head = (F.col(head) if isinstance(head, str) else head).alias("_head")
    words = docs.select(head, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).select(
        "_head", "_t", F.filter(F.split("_t", WS), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l")
    )
    hashed = words.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    windows = hashed.withColumn(
        "_g",
        F.when(F.size("_h") >= window, F.transform(F.sequence(F.lit(1), F.size("_h") - (window - 1)), lambda i: F.xxhash64(F.slice("_h", i, window)))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    return windows.select(
        "_head",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(0)).otherwise(_covered(F.col("_g"), window)).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size(F.filter("_h", lambda h, i: (i > 0) & (h == F.get("_h", i - 1)))).cast("long").alias("n_stutter"),
    )


def _covered(grams: Column, window: int) -> Column:
    """Words inside windows whose hash occurs twice: sort (hash, start), keep starts that
    equal a neighbour's hash, sort those starts, add up the union of their windows."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    # (hash, start) beside the one before and the one after, in one pass each
    same = F.zip_with(pairs, F.slice(pairs, F.lit(2), F.size(pairs)), lambda a, b: F.struct(a["i"].alias("i"), (a["g"] == b["g"]).alias("n")))
    # a start counts if it equals the next one or the one before does
    flags = F.zip_with(
        same, F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(False).alias("n"))), same), lambda a, p: F.when(F.coalesce(a["n"], F.lit(False)) | F.coalesce(p["n"], F.lit(False)), a["i"])
    )
    starts = F.sort_array(F.filter(flags, lambda x: x.isNotNull()))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + s + window - F.greatest(acc["end"], s)).cast("int").alias("n"), (s + window).cast("int").alias("end")),
        lambda acc: acc["n"],
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, measurements and ``rule_bits`` per document."""
    return rule_bits(measure(docs, id_col, text_col)).withColumnRenamed("_head", "doc_id")


def rule_bits(m: DataFrame) -> DataFrame:
    """Every rule once, as a bit of one column."""
    fails = {
        "few_words": F.col("n_words") < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 3 * F.col("word_chars"),
        "shouting": 100 * F.col("n_upper") > 25 * F.col("word_chars"),
        "stutter": 100 * F.col("n_stutter") > 20 * F.col("n_words"),
        "repeated_lines": 100 * F.col("n_dup_lines") > 40 * F.col("n_lines"),
    }
    bits = F.lit(0).cast("long")
    for name, fail in fails.items():
        bits = bits.bitwiseOR(F.when(fail, F.lit(1 << BITS[name])).otherwise(F.lit(0)).cast("long"))
    return m.withColumn("rule_bits", bits)


def failed(policy: Policy) -> Column:
    return F.col("rule_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: Policy = CORPUS) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to ledger rows."""
    return rows.withColumn("base_failed", failed(BASE)).withColumn("kept", ~F.col("base_failed") & ~failed(policy))


def ablation(rows: DataFrame, policy: Policy = CORPUS) -> DataFrame:
    """What each rule of a policy does: documents that fail it, and documents that only it
    rejects (which would come back without it). One aggregate over the bits."""
    masked = rows.select(F.col("rule_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("b")).groupBy("b").count()
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in policy.rules])
    return (
        masked.select("b", "count", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("b").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only"),
        )
    )


def keep_good(docs: DataFrame, policy: Policy = CORPUS) -> DataFrame:
    """The rows of ``docs`` (any columns, a text) that a policy keeps. A row is exploded into
    itself or nothing: a filter would be pushed below the projections and every rule's
    expression be copied into it."""
    judged = apply_policy(rule_bits(measure(docs, F.struct("*"))), policy)
    return judged.select(F.explode(F.when(F.col("kept"), F.array("_head")).otherwise(F.array())).alias("_head")).select("_head.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), toks AS (
  SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), prev AS (
  SELECT rid, i, word, lag(word) OVER x AS before,
         CASE WHEN count(*) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) = 8
              THEN string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS gram
  FROM toks WINDOW x AS (PARTITION BY rid ORDER BY i)
), flagged AS (
  SELECT rid, i, gram IS NOT NULL AND count(gram) OVER (PARTITION BY rid, gram) > 1 AS f FROM prev
), covered AS (
  SELECT rid, count(*) FILTER (c) AS n_repeat_words FROM (
    SELECT rid, max(f::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) = 1 AS c FROM flagged
  ) GROUP BY rid
), stutter AS (
  SELECT rid, count(*) FILTER (word = before) AS n_stutter FROM prev GROUP BY rid
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper,
         coalesce(n_stutter, 0)::BIGINT AS n_stutter
  FROM w LEFT JOIN covered USING (rid) LEFT JOIN stutter USING (rid)
), b AS (
  SELECT *, ((n_words < 20)::INT + (100 * n_repeat_words > 30 * n_words)::INT * 2 + (100 * n_symbols > 3 * word_chars)::INT * 4
     + (100 * n_upper > 25 * word_chars)::INT * 8 + (100 * n_stutter > 20 * n_words)::INT * 16
     + (100 * n_dup_lines > 40 * n_lines)::INT * 32)::BIGINT AS rule_bits FROM m
)
SELECT *, (rule_bits & 3) <> 0 AS base_failed, rule_bits = 0 AS kept FROM b
"""



def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy's ablation, and what its version keeps, from one stored ledger."""
    stored = materialize(ledger(table(spark, sf_dir, "documents")).select("doc_id", "rule_bits"))
    out = None
    for p in POLICIES:
        kept = stored.agg(F.count_if(~failed(p))).first()[0]
        part = ablation(stored, p).select(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), "rule", "n_failed", "n_only", F.lit(kept).cast("long").alias("n_kept"))
        out = part if out is None else out.unionByName(part)
    return out


def _ablation_sql() -> str:
    parts = []
    for p in POLICIES:
        for r in p.rules:
            parts.append(
                f"SELECT '{p.name}' AS policy, {p.version}::INT AS version, '{r}' AS rule, count(*) FILTER ((rule_bits & {1 << BITS[r]}) <> 0)::BIGINT AS n_failed, "
                f"count(*) FILTER ((rule_bits & {p.mask}) = {1 << BITS[r]})::BIGINT AS n_only, count(*) FILTER ((rule_bits & {p.mask}) = 0)::BIGINT AS n_kept FROM ledger"
            )
    return f"WITH ledger AS ({ORACLE_SQL})" + " UNION ALL ".join(parts)


QUERIES = {"op4_quality_rules": op4_quality_rules, "quality_ablation": quality_ablation}
ORACLES = {"op4_quality_rules": ORACLE_SQL, "quality_ablation": _ablation_sql()}
