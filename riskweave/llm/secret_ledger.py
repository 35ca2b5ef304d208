"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by the SHA-256 of its content (its blob). The
ledger is a Parquet table of the (blob, rule version) pairs scanned so far, with the
spans found. A scan reads only blobs with unseen pairs, once each however many paths
hold them, appends to the ledger and joins findings back to all paths and versions. A
scan that is repeated, or that runs beside another one, may append a pair again: equal
spans of a pair count once when the ledger is read.

Positions come from the JVM's regex functions alone: ``split`` gives what stands
between matches, ``regexp_extract_all`` the matches, and a running sum of their
lengths (a window inside one blob) the start and end of each, in code points.

Defined results: null texts count as empty; a version without findings has no spans;
repeated rows and equal texts under several paths or versions each get the findings of
their blob; empty tables give empty results; other columns but ``version`` are ignored;
null paths are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.llm import common


@dataclass(frozen=True)
class Rule:
    """A pattern (Java syntax) whose matches are tried left to right without overlap.

    Matches stay if group ``group`` has ``least`` characters or more.
    """

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which spans with one start are listed.
BASE_RULES = (
    Rule("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=1, least=8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}", least=32),  # a run of 32 or more is one match of [0-9a-f]+ that is long enough
)
SCHEMA = "blob binary, rule string, spans array<struct<start:int,end:int>>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(path, blob, todo): one path that holds each blob, and the rule versions it still needs."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = versions.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        return blobs.withColumn("todo", keys)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.when(F.col("seen").isNull(), keys).otherwise(F.array_except(keys, "seen"))
    return blobs.join(seen, "blob", "left").withColumn("todo", todo).drop("seen").where(F.size("todo") > 0)


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of ``blobs`` (path, blob, todo, text): one for each rule still to do."""
    pieces = []
    for rule in rules:
        text, hit = F.col("text"), F.lit(rule.pattern)
        found = F.arrays_zip(
            F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p)).alias("gap"),
            F.transform(F.regexp_extract_all(text, hit, 0), lambda p: F.length(p)).alias("size"),
            F.transform(F.regexp_extract_all(text, hit, rule.group), lambda p: F.length(p)).alias("own"),
        )
        needed = F.array_contains("todo", rule.key)
        pieces.append(F.when(needed, F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.least).alias("least"), F.when(text.rlike(rule.pattern), found).alias("found"))))
    each = blobs.select("path", "blob", F.explode(F.array_compact(F.array(*pieces))).alias("x")).select("path", "blob", "x.rule", "x.least", F.posexplode_outer("x.found").alias("nth", "m"))
    order = Window.partitionBy("path", "blob", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.coalesce(F.col("m.size"), F.lit(0))).over(order).cast("int")
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("m.size"))
    good = F.col("m.own") >= F.col("least")
    return placed.groupBy("path", "blob", "rule").agg(F.sort_array(F.collect_list(F.when(good, F.struct("start", "end")))).alias("spans")).select("blob", "rule", "spans")


def is_ledger(spark: SparkSession, ledger_dir: str) -> bool:
    """Whether a scan has written to the folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger_dir}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def scan_versions(spark: SparkSession, versions: DataFrame, ledger_dir: str, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Bring the ledger in ``ledger_dir`` up to date for ``versions`` (path, text, and version if given); return (path, version, blob, spans).

    A path may have any number of versions; without the column all have version null.
    ``spans`` is an array of struct(start, rank, kind, end) ordered by start, then by the
    order of ``rules``; one row for each row of ``versions``.
    """
    version = F.col("version").cast("string") if "version" in versions.columns else F.lit(None).cast("string")
    versions = versions.select("path", version.alias("version"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = common.written(spark, versions.select("path", "version", blob_id(F.col("text")).alias("blob")), "secret-paths")
    ledger = spark.read.schema(SCHEMA).parquet(ledger_dir) if is_ledger(spark, ledger_dir) else None
    todo = unseen(keyed, ledger, rules)
    texts = versions.select("path", "text", blob_id(F.col("text")).alias("blob"))
    # a path may hold several versions, and null paths hold some too: blob and path name one text together
    held = todo.withColumnRenamed("path", "at").hint("merge").join(texts, F.col("path").eqNullSafe(F.col("at")) & (todo["blob"] == texts["blob"])).select("path", todo["blob"], "todo", "text")
    if keyed.groupBy("path", "blob").count().where("count > 1").limit(1).count():  # one of several equal texts of a path is scanned
        held = held.dropDuplicates(["path", "blob"])
    scan(held, rules).write.mode("append").parquet(ledger_dir)
    ledger = spark.read.schema(SCHEMA).parquet(ledger_dir)
    rank = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))]), F.col("rule"))
    kind = F.regexp_extract("rule", "^(.*)@", 1)
    found = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).select("blob", rank.alias("rank"), kind.alias("kind"), F.explode("spans").alias("s"))
    findings = found.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct(F.col("s.start").alias("start"), "rank", "kind", F.col("s.end").alias("end")))).alias("spans"))
    return keyed.join(findings, "blob", "left").select("path", "version", "blob", F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents, found through a ledger that starts empty."""
    docs = common.table(spark, sf_dir, "documents")
    found = scan_versions(spark, docs.select(F.col("doc_id").alias("path"), "text"), common.new_folder(spark, "secret-ledger"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    kinds = F.transform("spans", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select(F.col("path").alias("doc_id"), *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


#: The same result by a recursive walk over each text: start at the first match, cut, and go on behind it.
OP1_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), rules(kind, rank, pat, least) AS (VALUES
  ('assign', 0, '((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)', 8),
  ('access', 1, '()(AKIA[A-Z0-9]+)', 16),
  ('hex', 2, '()([0-9a-f]{32,})', 32)
), walk(rid, kind, rank, pat, least, rest, stop, start, own) AS (
  SELECT rid, kind, rank, pat, least, text, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM docs, rules
  UNION ALL
  SELECT rid, kind, rank, pat, least, substr(rest, p + length(m)), stop + p - 1 + length(m), stop + p - 1, length(regexp_extract(m, pat, 2))
  FROM (SELECT *, strpos(rest, m) AS p FROM (SELECT *, regexp_extract(rest, pat, 0) AS m FROM walk)) WHERE m <> ''
), spans AS (
  SELECT rid, kind, rank, start, stop FROM walk WHERE own >= least
), per AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (rid)
"""
