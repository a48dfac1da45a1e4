"""Secret scans over a content-addressed, incremental blob ledger (DataFrame operations only).

A *version* is a row (path, text); its blob is addressed by the SHA-256 of the text's UTF-8
bytes. The ledger is a Parquet table of ``blob, rule, rule_version, spans`` in a shared folder.
``scan`` collapses equal blobs map-side and by hash, leaves out the blob and rule-version pairs the
ledger already has, scans the rest, appends them (with empty findings too: a clean blob is not
read twice), and joins findings back to every path. Raising a rule's version makes exactly that rule run again.

Positions are code points, end exclusive. They are found without Python: ``split`` gives the
stretches between the matches of a pattern and ``regexp_extract_all`` the matches, and running
lengths of both give the positions, ``CHUNK`` matches at a time, so a text's cost is in proportion to its matches.

Defined results: null text is an empty text without findings; rows that repeat a path are each
returned; an empty table gives an empty table and an empty ledger; other columns are ignored by ``scan`` and
passed on by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch, whole


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if group ``group`` has ``least`` or more characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The rules, in the order of their kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
CHUNK = 128
LEDGER = "blob string, rule string, rule_version int, spans array<struct<start:long,end:long>>"
SPAN = "struct<start:bigint,end:bigint>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (a lambda's variable), where ``body`` reads it in lambdas of its own."""
    return F.transform(F.array(value), body)[0]


def chunked(rows: Column, total: Callable[[Column], Column], step: Callable[[Column, Column], Column], rest: Callable[[Column, Column], Column], start: Column, width: int = CHUNK) -> Column:
    """The flattened ``rest(state, chunk)`` of the chunks of an array, ``state`` being the sum (``step``) of the ``total`` of the chunks before.

    Within a chunk work may be in proportion to its square; over all it is in proportion to the number of rows.
    """

    def of_chunks(chunks: Column) -> Column:
        states = F.aggregate(F.transform(chunks, total), F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
        return let(states, lambda s: F.flatten(F.transform(chunks, lambda c, i: rest(F.get(s, i), c))))

    n = lambda r: F.floor((F.size(r) - 1) / width).cast("int")
    return let(rows, lambda r: let(F.transform(F.sequence(F.lit(0), n(r)), lambda i: F.slice(r, i * width + 1, F.lit(width))), of_chunks))


def find(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of a rule's matches in ``text``: leftmost, non-overlapping, failing ones dropped."""
    pattern = F.lit(rule.pattern)
    size = lambda x: F.char_length(F.coalesce(x, F.lit(""))).cast("long")
    zipped = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    hits = F.transform(zipped, lambda x: F.struct(size(x["gap"]).alias("gap"), size(x["hit"]).alias("hit"), F.coalesce(F.char_length(x["value"]) >= rule.least, F.lit(False)).alias("ok")))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        got = F.when(x["ok"], F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(none)
        return F.struct(end.alias("at"), F.concat(acc["out"], got).alias("out"))

    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x["gap"] + x["hit"])
    spans = chunked(hits, total, lambda a, b: a + b, lambda at, c: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"]), F.lit(0).cast("long"))
    return F.when(text.rlike(rule.pattern), spans).otherwise(none)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, empty if there is none yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def pending(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each blob (``blob, text``) with the names of the rules that have not seen it yet (``todo``)."""
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = versions.select("blob", "text").distinct()
    if ledger is None:
        return blobs.withColumn("todo", names)
    seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "rule_version")).alias("seen"))
    todo = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").withColumn("todo", todo).where(F.size("todo") > 0).select("blob", "text", "todo")


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of pending blobs."""
    found = [
        F.when(
            F.array_contains("todo", r.name),
            F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version"), find(F.col("text"), r).alias("spans")),
        )
        for r in rules
    ]
    return blobs.select("blob", F.explode(F.array_compact(F.array(*found))).alias("f")).select("blob", "f.*")


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at ``path`` lacks, appends it and returns the ledger."""
    spark = versions.sparkSession
    ledger = open_ledger(spark, path)
    new = not ledger.take(1)
    scan_blobs(pending(versions, None if new else ledger, rules), rules).write.mode("append").parquet(path)
    return open_ledger(spark, path)


def versions_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("path"), whole(text_col).alias("text"), F.sha2(whole(text_col), 256).alias("blob"))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings under the current rule versions: ``blob, found array<struct<start,rank,end,kind>>``, sorted."""
    rank = {r.name: i for i, r in enumerate(rules)}
    kinds = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(rank[r.name]))])
    current = ledger.withColumn("rank", kinds[F.concat_ws("@", "rule", "rule_version")]).where(F.col("rank").isNotNull() & (F.size("spans") > 0))
    # A rule-version pair that two runs scanned at once is in the ledger twice; a set takes it once.
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank"), s["end"].alias("end"), F.col("rule").alias("kind")))
    return current.select("blob", spans.alias("s")).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("found"))


def scan(docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version: ``id, blob, found`` (sorted array of start, rank, end, kind)."""
    versions = versions_of(docs, id_col, text_col)
    ledger = update_ledger(versions, ledger_path or scratch(docs.sparkSession, "secret-ledger"), rules)
    none = F.array().cast(f"array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    joined = versions.select("path", "blob").join(findings(ledger, rules), "blob", "left")
    return joined.select(F.col("path").alias(id_col), "blob", F.coalesce("found", none).alias("found"))


def redact(docs: DataFrame, ledger_path: str | None = None, text_col: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each found secret, overlapping ones as one, replaced by ``mask`` in the text."""
    spark = docs.sparkSession
    versions = docs.select(whole(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
    ledger = update_ledger(versions, ledger_path or scratch(spark, "secret-ledger"), rules)
    found = findings(ledger, rules).select(F.col("blob").alias("_blob"), F.col("found").alias("_found"))
    text = whole(text_col)
    zero = F.lit(0).cast("long")
    last = lambda c: F.aggregate(c, zero, lambda at, s: F.greatest(at, s["end"]))

    def pieces(at: Column, chunk: Column) -> Column:
        """What is left of the text from ``at`` to the chunk's last start, with masks; positions count from ``at`` in the stretch of text that the chunk needs."""

        def step(acc: Column, s: Column) -> Column:
            gap = F.when(s["start"] < acc["at"], F.lit("")).otherwise(F.concat(F.substring(acc["text"], acc["at"] - at + 1, s["start"] - acc["at"]), F.lit(mask)))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["text"].alias("text"), F.concat(acc["out"], F.array(gap)).alias("out"))

        here = F.substring(text, at + 1, F.greatest(F.element_at(chunk, -1)["start"] - at, zero))
        return F.aggregate(chunk, F.struct(at.alias("at"), here.alias("text"), F.array().cast("array<string>").alias("out")), step, lambda a: a["out"])

    cut = F.concat(F.array_join(chunked(F.col("_found"), last, F.greatest, pieces, zero), ""), F.substring(text, last(F.col("_found")) + 1, F.char_length(text)))
    joined = docs.withColumn("_blob", F.sha2(text, 256)).join(found, "_blob", "left")
    return joined.withColumn(text_col, F.when(F.col("_found").isNull(), F.col(text_col)).otherwise(cut)).select(*docs.columns)
