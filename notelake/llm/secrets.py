"""Secret scans over an incremental ledger of content-addressed blobs.

A version is any historical text of any path. Equal texts are one blob, named by the SHA-256 of its bytes.
The ledger holds, for each blob, the rule versions it was scanned with and what they found; a run scans
only blob and rule-version pairs that the ledger lacks, appends them, and joins the findings back to all
paths. Work therefore follows new contents and new rules, not the number of copies or runs.

Everything is DataFrame operations. ``split`` and ``regexp_extract_all`` cut a text at the same leftmost
matches, so running sums of the pieces' lengths give each match's place in code points.

Null texts count as empty. Extra columns are not read. Repeated rows are repeated paths of one blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.shared import table, written


@dataclass(frozen=True)
class Rule:
    """pattern is a Java pattern that never matches an empty text; the group's text has shortest characters at least.

    needs: pieces of text (in lower case) without any of which the pattern cannot match; a cheap test first.
    """

    kind: str
    version: int
    pattern: str
    shortest: int
    group: int = 0
    needs: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Word characters of a quoted or bare value, as in the base patterns.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, 0, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 24),
)
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----", 60, 0, ("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30, 0, ("eyj",)),
    Rule("forge", 1, r"(?:ghp|gho|ghs|glpat|xox[abp])[_-][A-Za-z0-9_-]{20,}", 24, 0, ("gh", "glpat", "xox")),
    Rule("hexup", 1, r"(?<![0-9A-Za-z])[0-9A-F]{32,}(?![0-9A-Za-z])", 32),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:bigint,end:bigint>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """Places of the rule's matches in code points, end exclusive, in order."""
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x).cast("bigint"))
    between = lengths(F.split(text, rule.pattern, -1))
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), lengths(whole).alias("len"), lengths(value).alias("size"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["size"] >= rule.shortest, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(steps, start, step, lambda acc: acc["found"])
    low = F.lower(text)
    maybe = [low.contains(n) for n in rule.needs]
    test = F.lit(False)
    for m in maybe:
        test = test | m
    test = test if maybe else text.rlike(rule.pattern)
    return F.when(test, found).otherwise(F.array().cast(SPANS))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"blob string, findings map<string,{SPANS}>")


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Ledger rows for the blob and rule-version pairs that ledger lacks: (blob, findings by rule version)."""
    seen = ledger.select("blob", F.explode(F.map_keys("findings")).alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    blobs = versions.select(F.coalesce(F.col(text), F.lit("")).alias("text")).distinct().withColumn("blob", blob_id(F.col("text")))
    todo = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    entries = [F.when(~F.array_contains("seen", r.name), F.struct(F.lit(r.name).alias("key"), spans_of(F.col("text"), r).alias("value"))) for r in rules]
    wanted = F.array(*[F.lit(r.name) for r in rules])
    fresh = todo.filter(F.size(F.array_except(wanted, F.col("seen"))) > 0)
    return fresh.select("blob", F.map_from_entries(F.array_compact(F.array(*entries))).alias("findings"))


def known_findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """One row per blob: the spans by the current version of each rule."""
    current = F.array(*[F.lit(r.name) for r in rules])
    pairs = ledger.select("blob", F.explode("findings").alias("rule", "spans")).filter(F.array_contains(current, F.col("rule")))
    kind = F.element_at(F.split("rule", "@"), 1)
    flat = pairs.filter(F.size("spans") > 0).select("blob", F.transform("spans", lambda s: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    return flat.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def findings_by_path(versions: DataFrame, ledger: DataFrame, path: str, text: str = "text", rules=RULES) -> DataFrame:
    """(path, blob, spans) for every version; spans is empty where nothing was found."""
    paths = versions.select(F.col(path).alias("path"), blob_id(F.col(text)).alias("blob"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return paths.join(known_findings(ledger, rules), "blob", "left").withColumn("spans", F.coalesce("spans", none))


def scan(versions: DataFrame, ledger: DataFrame, path: str, text: str = "text", rules=RULES) -> tuple[DataFrame, DataFrame]:
    """The grown ledger (its new rows written to the shared folder) and the findings of every version's path."""
    grown = ledger.unionByName(written(scan_unseen(versions, ledger, rules, text), "secret-ledger"))
    return grown, findings_by_path(versions, grown, path, text, rules)


def span_text(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of the spans of these kinds, by start, then kind as listed, joined by commas."""
    order = F.array(*[F.lit(k) for k in kinds])
    mine = F.filter(spans, lambda s: F.array_contains(order, s["kind"]))
    keyed = F.array_sort(F.transform(mine, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, found = scan(docs, empty_ledger(spark), "doc_id")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in BASE_RULES]
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(k) for k in base],
        F.sha2(span_text(F.col("spans"), base), 256).alias("base_sha256"),
        span_text(F.col("spans"), [r.kind for r in RULES]).alias("spans"),
    )
