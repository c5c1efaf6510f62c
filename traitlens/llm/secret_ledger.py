"""Secret scans over an incremental ledger of content-addressed blobs.

A version is a row with a path and a text.  The text's SHA-256 is its blob
address.  The ledger, three Parquet tables in one folder, remembers which (blob,
rule version) pairs were scanned, what was found in each blob, and which
versions hold it.  A scan takes each blob once however many paths share it, only
for rule versions it has not seen, and joins findings back to all paths.

Findings come from built-in functions alone: the gaps and the matches of a
pattern, ``split`` and ``regexp_extract_all`` over the same text, give every
position as a running sum of lengths.

Defined results: a NULL text is the empty blob, without findings; repeated rows
get the same findings each; a NULL path is kept; an empty table gives no rows;
further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from traitlens.llm.common import let, settle, text_or_empty
from traitlens.sources.store import join_small


@dataclass(frozen=True)
class SecretRule:
    """A pattern; ``group`` (0: the whole match) must have ``least`` characters or the match is dropped.

    ``hint`` is a cheap pattern that any text with a kept match contains.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1

    @property
    def address(self) -> str:
        return f"{self.kind}@{self.version}"


# Forms of the most common credentials.
BASE_RULES: tuple[SecretRule, ...] = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)password|passwd|secret|token|api_?key"),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    SecretRule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
MORE_RULES: tuple[SecretRule, ...] = (
    SecretRule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, r"xox[abprs]-"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 20, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]+:[^\s:/@]+@", 0, 8, r"://[^\s:/@]+:[^\s:/@]+@"),
)
RULES = BASE_RULES + MORE_RULES


def spans_of(text: Column, rule: SecretRule, order: int) -> Column:
    """Array of (start, end, order, kind) of one rule's matches, in code points, end exclusive."""
    found = lambda group: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))
    lengths = F.arrays_zip(
        F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found(0))), lambda x: F.length(x)).alias("gap"),
        F.transform(found(0), lambda x: F.length(x)).alias("whole"),
        F.transform(found(rule.group), lambda x: F.length(x)).alias("part"),
    )
    span = "struct<start:int,end:int,ord:int,kind:string>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["whole"]
        here = F.struct(start.alias("start"), end.alias("end"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"))
        kept = F.when(x["part"] >= rule.least, F.concat(acc["spans"], F.array(here))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    hit = let(lengths, lambda ls: F.aggregate(ls, state, step, lambda acc: acc["spans"]))
    return F.when(text.rlike(rule.hint), hit).otherwise(F.array().cast(f"array<{span}>"))


SPANS = "array<struct<start:int,end:int,ord:int,kind:string>>"


def with_blob(versions: DataFrame, text_col: str = "text", name: str = "blob") -> DataFrame:
    """The rows with their text's address."""
    return versions.withColumn(name, F.unhex(F.sha2(text_or_empty(text_col), 256)))


class BlobLedger:
    """What was scanned and found, and who holds it, as Parquet tables under one folder.

    ``scans`` has a row for each scan of a blob: (blob, rules, spans).  The rules
    scanned and their findings are one row, so a blob never counts as scanned
    without its findings.  ``versions`` has (path, blob).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def scans(self) -> DataFrame | None:
        return self._read("scans", f"blob binary, rules array<string>, spans {SPANS}")

    def scan(self, versions: DataFrame, text_col: str = "text", rules: Sequence[SecretRule] = RULES) -> None:
        """Scan every blob of ``versions`` for the rule versions it was not scanned for yet.

        Texts of one blob meet after map-side reduction, so a blob that a third
        of all paths share moves once per task.
        """
        texts = with_blob(versions.select(text_or_empty(text_col).alias("text")))
        todo = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("rules", F.array(*[F.lit(r.address) for r in rules]))
        before = self.scans()
        if before is not None:
            done = before.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
            todo = todo.join(done, "blob", "left").withColumn("rules", F.expr("array_except(rules, coalesce(done, array()))"))
            todo = todo.where(F.size("rules") > 0)
        none = F.array().cast(SPANS)
        each = [F.when(F.array_contains("rules", r.address), spans_of(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
        found = todo.select("blob", "rules", F.array_sort(F.flatten(F.array(*each))).alias("spans"))
        found.write.mode("append").parquet(f"{self.folder}/scans")

    def record(self, versions: DataFrame, path_col: str, text_col: str = "text") -> None:
        """Remember which path held which blob."""
        rows = with_blob(versions.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text")))
        rows.select("path", "blob").write.mode("append").parquet(f"{self.folder}/versions")

    def findings(self, rules: Sequence[SecretRule] = RULES) -> DataFrame:
        """(blob, spans) of blobs with findings under these rule versions, spans by start, then rule order."""
        addresses = [r.address for r in rules]
        order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
        # A blob scanned under a newer version of a rule keeps the row of the older one; only rows that scanned it now count.
        scans = self.scans()
        wanted = scans.select("blob", F.array_intersect("rules", F.array(*[F.lit(a) for a in addresses])).alias("rules"), "spans")
        kinds = F.transform("rules", lambda a: F.regexp_replace(a, "@[0-9]+$", ""))
        mine = wanted.where(F.size("spans") > 0).withColumn("kinds", kinds)
        spans = mine.select("blob", F.filter("spans", lambda x: F.array_contains("kinds", x["kind"])).alias("spans"))
        ranked = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), order[x["kind"]].alias("ord"), x["kind"].alias("kind")))
        merged = spans.select("blob", ranked.alias("spans")).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        by_place = F.transform("spans", lambda x: F.struct(x["start"], x["ord"], x["end"], x["kind"]))
        ordered = F.transform(F.array_sort(by_place), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["ord"].alias("ord"), x["kind"].alias("kind")))
        return merged.where(F.size("spans") > 0).select("blob", ordered.alias("spans"))

    def joined(self, versions: DataFrame, text_col: str = "text", rules: Sequence[SecretRule] = RULES) -> DataFrame:
        """All rows of ``versions`` with their ``spans``; a row without findings has an empty array.

        Only blobs with findings are on the other side: broadcast while they are
        few, else joined by a shuffle in which adaptive execution can split a blob
        that many rows share.
        """
        found = settle(self.findings(rules).select(F.col("blob").alias("__own"), F.col("spans").alias("__spans")))
        rows = join_small(with_blob(versions, text_col, "__own"), found, ["__own"], "left").drop("__own")
        return rows.withColumn("__spans", F.coalesce("__spans", F.array().cast(SPANS)))

    def held_by(self, rules: Sequence[SecretRule] = RULES) -> DataFrame:
        """Findings of every blob joined to all recorded paths: (path, kind, start, end)."""
        versions = self._read("versions", "path string, blob binary")
        rows = versions.join(self.findings(rules), "blob").select("path", F.explode("spans").alias("s"))
        return rows.select("path", "s.kind", "s.start", "s.end")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each span replaced by the mark; overlapping spans are replaced once."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    whole = F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
