"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a document is a path whose text is a blob, addressed by its
SHA-256. The ledger holds what was found in which blob by which version of
which rule. A scan reads only (blob, rule version) pairs that the ledger lacks,
appends what it finds (an empty list too), and joins findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import may_hold, new_path, only, stash
from .spans import counted, joined, masked, matches, spans


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, its version and the least length of a match or of its value."""

    kind: str
    pattern: str
    version: int = 1
    least: int = 0
    value: int = 0

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"

#: A run of at least 20 or 24 characters is what the open pattern finds and its length test keeps.
BASE = (Rule("assign", _ASSIGN, least=6, value=2), Rule("access", r"AKIA[A-Z0-9]{16,}"), Rule("hex", r"[0-9a-f]{24,}+"))
#: Beyond the base: keys in PEM armour, and tokens whose issuers give them a fixed prefix.
MORE = (Rule("issued", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),)
RULES = BASE + MORE

_FOUND = "array<struct<start:long,end:long>>"


def _scan(text: Column, found: Column, rule: Rule) -> Column:
    at = spans(text, found, rule.pattern)
    if rule.least:
        at = F.filter(at, lambda s: F.char_length(F.regexp_extract(s["match"], rule.pattern, rule.value)) >= rule.least)
    return F.transform(at, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).cast(_FOUND)


class BlobLedger:
    """Findings by blob and rule version, as Parquet in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or new_path(spark, "ledger")

    def read(self) -> DataFrame:
        """Rows (blob, rule, found), in which two scans at a time may repeat a pair; none if nothing was scanned yet."""
        schema = f"blob string, rule string, found {_FOUND}"
        if not self._exists():
            return self.spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (("blob", "string"), ("rule", "string"), ("found", _FOUND))])
        return self.spark.read.schema(schema).parquet(self.path)

    def _exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> int:
        """Scan what the ledger lacks of the texts of docs; the number of (blob, rule version) pairs read.

        Copies of a text are put together before the shuffle. Texts that the
        ledger has by all rules don't meet it, but for the few that a filter of
        the others lets through.
        """
        texts = _texts(docs).select("blob", "text")
        none = F.expr("CAST(array() AS array<string>)")
        if self._exists():
            seen = self.read().where(F.col("rule").isin([r.id for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
            todo = texts.select("blob").distinct().join(seen, "blob", "left").select("blob", F.coalesce("seen", none).alias("seen"))
            todo = stash(todo.where(F.size("seen") < len(rules)), "unseen")
            rows = may_hold(texts, todo, "blob").where("may").groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
        else:
            rows = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("seen", none)
        got = rows.select("blob", "text", "seen", *[F.when(~F.array_contains("seen", r.id), matches(F.col("text"), r.pattern)).alias(r.kind) for r in rules])
        each = got.select("blob", *[F.when(F.col(r.kind).isNotNull(), _scan(F.col("text"), F.col(r.kind), r)).alias(r.kind) for r in rules])
        long = each.select("blob", F.explode(F.array(*[F.struct(F.lit(r.id).alias("rule"), F.col(r.kind).alias("found")) for r in rules])).alias("x")).select("blob", "x.*").where("found IS NOT NULL")
        read = Observation()
        long.observe(read, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(self.path)
        return read.get["n"]

    def findings(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Rows (doc_id, spans) for all rows of docs; spans are kind, start, end by start, then by kind as listed."""
        at = {r.id: k for k, r in enumerate(rules)}
        rows = self.read().where(F.col("rule").isin(list(at)))
        order = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.id, at[r.id])]), F.col("rule"))
        kind = F.split_part(F.col("rule"), F.lit("@"), F.lit(1))
        each = rows.select("blob", F.transform("found", lambda s: F.struct(s["start"].alias("start"), order.alias("k"), s["end"].alias("end"), kind.alias("kind"))).alias("s"))
        # an array's places name its rule, so a set of arrays holds every pair once; texts without a finding are no rows here
        blobs = stash(each.where(F.size("s") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("s"))).alias("spans")), "found")
        paths = _texts(docs).select("doc_id", "blob")
        none = F.lit(None).cast(blobs.schema["spans"].dataType)
        maybe = may_hold(paths, blobs, "blob")
        met = maybe.where("may").join(blobs, "blob", "left").select("doc_id", "spans").unionAll(maybe.where("NOT may").select("doc_id", none.alias("spans")))
        return met.select("doc_id", F.coalesce("spans", F.array().cast(blobs.schema["spans"].dataType)).alias("spans"))


def _texts(docs: DataFrame) -> DataFrame:
    rows = only(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("blob", F.sha2("text", 256))


def find_secrets(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """Rows (doc_id, spans) for every row of docs, null texts as empty; by a new ledger if none is given.

    Equal texts are read once. Repeated rows and null ids come out as they
    come in; an empty table gives no rows; other columns are ignored. A very
    long text is searched whole.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.scan(docs)
    return ledger.findings(docs)


def secret_report(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """find_secrets with the counts and digest of the base kinds."""
    rows = find_secrets(docs, ledger)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    counts = [counted(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, ledger: BlobLedger | None = None, mask: str = "[secret]") -> DataFrame:
    """docs, with every span of a secret in text replaced by mask; n_chars, if there is one, follows the new text.

    Overlapping spans are replaced once; a very long text is masked whole. All
    columns, whatever their names, the row count and null texts stay; repeated
    rows and null ids come out as they come in; an empty table gives no rows.
    Rows whose text has no finding don't meet the join, but for the few that a
    filter of the blobs with findings lets through.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.scan(docs)
    hit = ledger.read().where(F.col("rule").isin([r.id for r in RULES])).where(F.size("found") > 0)
    blobs = stash(hit.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found")), "hits")
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the row is kept whole in a struct, so that no name of its own can clash
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.sha2(whole, 256).alias("blob"))
    maybe = may_hold(packed, blobs, "blob")
    rows = maybe.where("may").join(blobs, "blob", "left").select("row", "found")
    text = F.col("row.text")
    changed = rows.where("found IS NOT NULL").select("row", masked(text.cast("string"), F.col("found"), mask).cast(docs.schema["text"].dataType).alias("new"))
    same = rows.where("found IS NULL").select("row").unionAll(maybe.where("NOT may").select("row"))
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("new").cast(docs.schema["n_chars"].dataType)
    cell = lambda c: F.col("row").getField(c)
    return same.select(*[cell(c).alias(c) for c in docs.columns]).unionAll(changed.select(*[new.get(c, cell(c)).alias(c) for c in docs.columns]))
