"""Problem 2: new batches against all history.

What has been accepted lives in a folder, and a manifest in it names its tables,
so that another session can go on: ``records`` (a row per record: keys of the
article and the text, the day), ``texts`` (words of each text), ``runs``
(sorted-neighbourhood keys of the texts) and ``links`` between texts. Runs and
texts are kept in ranges of their key, sorted, with more ranges the more rows
they have. A batch is read once; of a run only the ranges that its keys fall into
are read, and of those only the equal keys are shuffled. The window around a new
record is the run of equal keys it falls into; a run of very many keys is met in
blocks. Words of old texts are read for the candidates' ranges only. A batch adds
a run of its own; when there are more than ``max_runs``, the smaller ones are
merged, so that a key is rewritten a number of times that grows with the logarithm
of the history.

Keys: the article's id (equal keys are the same paper), the normalised text
(likewise), and Order MinHash keys of the text, whose neighbours are kept where
the exact share of common three-word sequences reaches the threshold.

Defined results: a null, blank or unreadable id matches nothing; a record with
neither id nor text is a paper of its own; a day that no calendar has is
unreadable; repeated rows of one record_id count once; an empty batch changes
nothing.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.graph import block_join, connected_components
from foliospark.llm.near_duplicates import LEAST_FIELDS, THRESHOLD, agreeing_fields, record_text, sketcher, verify
from foliospark.llm.words import normalised, word_hashes
from foliospark.session import drop_table, materialise, names_in, new_table_path, read_text, temporary_path, write_new_text

GRAM, ELL, KEYS, BLOCK = 5, 2, 10, 512
#: Rows of one paper are ordered in chunks of so many record_ids.
CHUNK = 1 << 16
#: Rows that a range of a run or of the texts has on average, and the most ranges.
RANGE_ROWS, MOST_BITS = 50_000, 14

SKETCHED = "id bigint, ik bigint, tx bigint, day date, fp bigint, keys array<bigint>, words array<int>"
RECORDS, RUN, TEXTS, LINKS = "id bigint, ik bigint, tx bigint, day date", "key bigint, tx bigint, fp bigint", "tx bigint, words array<int>", "a bigint, b bigint"


def article_id(c: Column) -> Column:
    """An article's id apart from version, case, prefix and address; else null."""
    c = F.regexp_replace(F.lower(c), r"(?U)\s+", "")
    c = F.regexp_replace(c, r"^.*/(?:abs|pdf|html)/|^arxiv:", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\.pdf$", ""), r"^arxiv:", "")
    c = F.regexp_replace(c, r"v\d+$", "")
    return F.when(c.rlike(r"^(?:\d{4}\.\d{4,5}|[a-z][a-z.\-]*/\d{7})$"), c)


def day_of(c: Column) -> Column:
    """The day written in any of the known ways; else null."""
    c = F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+$", "")
    iso = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1)
    formats = [(iso, "yyyy-MM-dd"), (c, "yyyy/MM/dd"), (c, "yyyyMMdd"), (c, "d MMM yyyy"), (c, "MMM d, yyyy"), (c, "d MMMM yyyy"), (c, "MMMM d, yyyy")]
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)).cast("date") for x, f in formats])


def _range(key: str | Column, bits: int) -> Column:
    """The number of a key's range, of 2 ** bits ranges."""
    return F.shiftrightunsigned(F.col(key) if isinstance(key, str) else key, 64 - bits).cast("int") if bits else F.lit(0)


class History:
    """Accepted records, their key runs and the links among them, in a folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, threshold: float = THRESHOLD, max_runs: int = 4, range_rows: int = RANGE_ROWS):
        self.spark, self.threshold, self.max_runs, self.range_rows = spark, threshold, max_runs, range_rows
        self.path = (path or temporary_path(spark, "history")).rstrip("/")
        self.version, self.tables = 0, {"records": [], "texts": [], "runs": [], "links": []}
        kept = [n for n in names_in(spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        if kept:
            self.version = int(max(kept)[len("manifest-") : -len(".json")])
            self.tables = json.loads(read_text(spark, f"{self.path}/{max(kept)}"))

    def _commit(self) -> None:
        """Name the tables as they are now; a reader sees all of a batch or nothing."""
        self.version += 1
        write_new_text(self.spark, f"{self.path}/manifest-{self.version:09d}.json", json.dumps(self.tables))

    def _write(self, kind: str, df: DataFrame, key: str | None = None, rows: int = 0) -> None:
        """Add a table; with a key, in sorted ranges."""
        entry = {"name": f"{kind}-{self.version + 1:09d}-{len(self.tables[kind])}", "rows": rows, "bits": 0}
        if key:
            per_range = max(1, self.range_rows if kind == "runs" else self.range_rows // KEYS)
            entry["bits"] = bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, rows) / per_range))))
            # a range that a hot key makes large is split, small ones share a task
            ranged = df.withColumn("range", _range(key, bits)).hint("rebalance", F.col("range"))
            ranged.sortWithinPartitions("range", *[c for c in df.columns if c != "words"]).write.partitionBy("range").parquet(f"{self.path}/{entry['name']}")
        else:
            df.write.parquet(f"{self.path}/{entry['name']}")
        self.tables[kind].append(entry)

    def _read(self, kind: str, schema: str, touched: set[int] | None = None) -> DataFrame:
        """All tables of a kind; of ranged ones only the ranges that hold any of the
        ``touched`` numbers, which are those of 2 ** MOST_BITS ranges."""
        out = self.spark.createDataFrame([], schema)
        for entry in self.tables[kind]:
            ranged = kind in ("runs", "texts")
            df = self.spark.read.schema(schema + (", range int" if ranged else "")).parquet(f"{self.path}/{entry['name']}")
            if ranged and touched is not None:
                here = sorted({t >> (MOST_BITS - entry["bits"]) for t in touched})
                df = df.where(F.col("range").isin(here)) if len(here) < 2 ** entry["bits"] else df
            out = out.unionByName(df.drop("range") if ranged else df)
        return out

    def _touched(self, df: DataFrame, key: str) -> set[int]:
        """At most 2 ** MOST_BITS numbers of ranges."""
        return {r[0] for r in df.select(_range(key, MOST_BITS).alias("r")).distinct().collect()}

    def ingest(self, batch: DataFrame) -> None:
        """Accept a batch: (record_id, arxiv_id, title, summary, updated)."""
        usable = record_text(F.col("title"), F.col("summary"))
        rows = batch.where("record_id is not null").select(
            F.col("record_id").cast("bigint").alias("id"), F.xxhash64(F.lit("id"), article_id(F.col("arxiv_id"))).alias("ik"), article_id(F.col("arxiv_id")).isNotNull().alias("has"), day_of(F.col("updated")).alias("day"), F.nullif(normalised(usable), F.lit("")).alias("norm")
        )
        rows = rows.select("id", F.when(F.col("has"), F.col("ik")).alias("ik"), F.when(F.col("norm").isNotNull(), F.xxhash64("norm")).alias("tx"), "day", word_hashes(F.col("norm")).alias("words"))
        path = new_table_path(self.spark, "batch")
        table = materialise(rows.mapInArrow(sketcher(GRAM, ELL, KEYS, ["id", "ik", "tx", "day"], count=False), SKETCHED), "batch", path)
        counted = table.agg(F.count(F.lit(1)), F.count("keys")).first()
        if not counted[0]:
            return
        texts = table.where("keys is not null").select("tx", "words")
        keys = table.where("keys is not null").select(F.explode("keys").alias("key"), "tx", "fp")
        new = keys.withColumn("new", F.lit(True))
        if self.tables["runs"]:
            old = self._read("runs", RUN, self._touched(keys, "key"))
            old = old.join(keys.select("key"), "key", "left_semi").withColumn("new", F.lit(False))
            new = new.unionByName(old)
        # a text stands under a key once; one seen before is not new
        new = new.groupBy("key", "tx").agg(F.first("fp").alias("fp"), F.min("new").alias("new"))
        met_path = new_table_path(self.spark, "met")
        met = materialise(new, "met", met_path)
        fresh = met.where("new").select("key", F.col("tx").alias("a"), F.col("fp").alias("fp_a"))
        pairs = block_join(fresh, met.select("key", F.col("tx").alias("b"), F.col("fp").alias("fp_b"), "new"), "key", "a", "b", BLOCK)
        pairs = pairs.where("a != b and (a < b or not new)").where(agreeing_fields(F.col("fp_a"), F.col("fp_b")) >= LEAST_FIELDS)
        pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
        words = texts
        if self.tables["texts"]:
            asked = pairs.select(F.explode(F.array("a", "b")).alias("tx")).distinct()
            words = words.unionByName(self._read("texts", TEXTS, self._touched(asked, "tx")).join(asked, "tx", "left_semi"))
        self._write("links", verify(pairs, words, self.threshold).select("a", "b"))
        self._write("records", table.select("id", "ik", "tx", "day"), rows=counted[0])
        self._write("texts", texts, "tx", counted[1])
        self._write("runs", met.where("new").select("key", "tx", "fp"), "key", counted[1] * KEYS)
        self._commit()
        for done in (path, met_path):
            drop_table(self.spark, done)
        if len(self.tables["runs"]) > self.max_runs:
            self.compact()

    def compact(self) -> None:
        """Merge the smaller runs, and texts likewise: as many as together are no
        larger than the next one, two at least."""
        stale = []
        for kind, schema, key in (("runs", RUN, "key"), ("texts", TEXTS, "tx")):
            by_size = sorted(self.tables[kind], key=lambda e: e["rows"])
            n, total = 0, 0
            while n < len(by_size) and (n < 2 or by_size[n]["rows"] <= total):
                total += by_size[n]["rows"]
                n += 1
            if n < 2:
                continue
            rest = by_size[n:]
            self.tables[kind] = by_size[:n]
            stale += by_size[:n]
            whole = self._read(kind, schema)
            if kind == "texts":  # of runs only one has a text
                whole = whole.dropDuplicates(["tx"])
            self.tables[kind] = rest
            self._write(kind, whole, key, total)
        if stale:
            self._commit()
            for entry in stale:
                drop_table(self.spark, f"{self.path}/{entry['name']}")

    def papers(self) -> DataFrame:
        """(id, first_id, day) of every accepted record."""
        rows = self._read("records", RECORDS).dropDuplicates(["id"])
        of_id = rows.where("ik is not null").groupBy("ik").agg(F.min("id").alias("first"))
        of_text = rows.where("tx is not null").groupBy("tx").agg(F.min("id").alias("first"))
        edges = rows.join(of_id, "ik").select("id", "first").unionByName(rows.join(of_text, "tx").select("id", "first")).where("id != first")
        a = self._read("links", LINKS).join(of_text.select(F.col("tx").alias("a"), F.col("first").alias("id")), "a")
        edges = edges.unionByName(a.join(of_text.select(F.col("tx").alias("b"), "first"), "b").select("id", "first"))
        linked = connected_components(edges, "id", "first")
        out = rows.select("id", "day").join(linked.withColumnRenamed("node", "id"), "id", "left")
        return out.select("id", F.coalesce("root", "id").alias("first_id"), "day")

    def repeats(self) -> DataFrame:
        """(first_id, record_id) of records that bring nothing new."""
        rows = materialise(self.papers().where("id is not null"), "papers").withColumn("chunk", F.floor(F.col("id") / CHUNK))
        # the latest day before each chunk, then within it: no task holds a hot paper
        per_chunk = rows.groupBy("first_id", "chunk").agg(F.max("day").alias("top"))
        before = Window.partitionBy("first_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        per_chunk = per_chunk.select("first_id", "chunk", F.max("top").over(before).alias("earlier"))
        within = Window.partitionBy("first_id", "chunk").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("within", F.max("day").over(within)).join(per_chunk, ["first_id", "chunk"])
        latest = F.greatest("within", "earlier")
        return rows.where(F.col("id") != F.col("first_id")).where(F.col("day").isNull() | (F.col("day") <= latest)).select("first_id", F.col("id").alias("record_id"))


def arrivals(papers: DataFrame, parts: int) -> list[DataFrame]:
    """The table in ``parts`` arrivals of whole batches, in order."""
    cuts = papers.approxQuantile("batch_no", [i / parts for i in range(1, parts)], 0.02) if parts > 1 else []
    low, out = None, []
    for cut in [*sorted(set(cuts)), None]:
        here = F.lit(True) if low is None else F.col("batch_no") > low
        if low is None:
            here = F.col("batch_no").isNull() | F.lit(True)
        out.append(papers.where(here if cut is None else here & (F.coalesce("batch_no", F.lit(-(2**31))) <= cut)))
        low = cut
    return out


def find_repeats(papers: DataFrame, parts: int = 4) -> DataFrame:
    """The table's batches as ``parts`` arrivals, one after the other."""
    history = History(papers.sparkSession, max_runs=2)
    for batch in arrivals(papers, parts):
        history.ingest(batch)
    return history.repeats()
