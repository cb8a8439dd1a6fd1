"""Text sources: meshes, operation logs, machine descriptions, result logs; and the log's writer."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import unit_bytes


def read_mesh(spark: SparkSession, path: str, fields: list[tuple[str, str]]) -> DataFrame:
    """Rows of white-space separated fields; comments, empty lines and the line of counts (which is no row of ``fields``) are left out.

    The line of counts is the one with another number of fields, or the first line of its file.
    """
    line = F.trim(F.regexp_replace("value", r"#.*$", ""))
    lines = spark.read.text(path).select(line.alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where("line <> ''")
    first = lines.groupBy("file").agg(F.min("at").alias("first"))
    parts = lines.join(F.broadcast(first), "file").where("at <> first").withColumn("f", F.split("line", r"\s+"))
    return parts.where(F.size("f") >= len(fields)).select(*[F.get("f", F.lit(i)).cast(k).alias(n) for i, (n, k) in enumerate(fields)])


NODES = [("id", "long"), ("x", "double"), ("y", "double"), ("flag", "int")]
ELEMENTS = [("id", "long"), ("n1", "long"), ("n2", "long"), ("n3", "long")]


#: What stands before the words of a line: node and thread, level and category. Lines without it are read too.
PREFIX = r"(?:\[[0-9]+ - [0-9a-f]+\] \{\w+\}\{\w+\}: )?"
#: Kinds of fields; those without a kind are decimal numbers.
KINDS = {"": r"[0-9]+", "hex": r"[0-9a-f]+", "word": r"\w+", "text": r".*", "words": r"[\w ]+", "numbers": r"[0-9 ]+"}


@dataclass(frozen=True)
class RecordType:
    """One line type of a log: a template of words and <field> or <field:kind>."""

    name: str
    template: str

    @property
    def _parts(self) -> list[str]:
        return re.split(r"<(\w+)(?::(\w+))?>", self.template)  # words, field, kind, words, ...

    @property
    def fields(self) -> tuple[tuple[str, str], ...]:
        p = self._parts
        return tuple((n, "string" if k else "long") for n, k in zip(p[1::3], p[2::3], strict=True))

    @property
    def words(self) -> str:
        """The words before the first field; they stand in every line of the type."""
        return self._parts[0]

    @property
    def pattern(self) -> str:
        p = self._parts
        return "^" + PREFIX + p[0] + "".join(f"({KINDS[k or '']}){words}" for k, words in zip(p[2::3], p[3::3], strict=True)) + r"\s*$"

    def line(self) -> Column:
        """Null where a field is null."""
        p = self._parts
        return F.concat(F.lit(p[0]), *[c for n, words in zip(p[1::3], p[3::3], strict=True) for c in (F.col(n).cast("string"), F.lit(words))])


def _types(lines: str) -> dict[str, RecordType]:
    return {n: RecordType(n, t) for n, t in (x.strip().split(": ", 1) for x in lines.strip().splitlines())}


#: The 19 line types of operation logs. Events are (id, generation) pairs.
RECORDS = _types("""
    index_space: Index Space <uid>
    index_partition: Index Partition <pid> <uid> <disjoint> <color>
    index_subspace: Index Subspace <pid> <uid> <color>
    field_space: Field Space <uid>
    field: Field Creation <uid> <fid>
    region: Region <iid> <fid> <tid>
    top_task: Top Task <uid> <tid>
    task: Task Operation <uid> <tid> <pid> <ctx>
    mapping: Mapping Operation <uid> <pid> <ctx>
    deletion: Deletion Operation <uid> <pid> <ctx>
    task_name: Task Name <uid> <name:text>
    requirement: Logical Requirement <uid> <index> <is_reg> <ispace> <fspace> <tid> <priv> <coher> <redop>
    req_field: Logical Requirement Field <uid> <index> <fid>
    mapping_dep: Mapping Dependence <pid> <ctx> <prev_id> <pidx> <next_id> <nidx> <dtype>
    event_event: Event Event <id1> <gen1> <id2> <gen2>
    task_events: Task Events <uid> <index_space> <point> <start_id> <start_gen> <term_id> <term_gen>
    index_term: Index Termination <uid> <term_id> <term_gen>
    copy_events: Copy Events <src> <dst> <srcloc> <dstloc> <index> <field> <tree> <start_id> <start_gen> <term_id> <term_gen> <mask:text>
    map_events: Map Events <uid> <start_id> <start_gen> <term_id> <term_gen>
""")

#: The 16 line types of older logs, whose handles and event ids are hexadecimal.
LEGACY = _types("""
    task_name: Task ID <uid> <name:words>
    top_task: Top Task <uid> <tid>
    task: Task <uid> <name:word> Task ID <tid> Parent Context <parent>
    mapping: Map <uid> Parent <parent>
    region_usage: Context <context> Task <uid> Region <index> Handle <handle:hex> Parent <parent:hex> Privilege <privilege> Coherence <coherence>
    partition_usage: Context <context> Task <uid> Partition <index> Handle <handle:hex> Parent <parent:hex> Privilege <privilege> Coherence <coherence>
    mapping_dep: Mapping Dependence <context> <prev_id> <pidx> <next_id> <nidx> <dtype>
    region: Region <handle:hex>
    partition: Partition <handle> Parent <parent:hex> Disjoint <disjoint>
    subregion: Region <handle:hex> Parent <parent:hex>
    event_event: Event Event <id1:hex> <gen1> <id2:hex> <gen2>
    copy: Event Copy Event <src_id:hex> <src_gen> <src_inst:hex> <src_handle:hex> <src_loc:hex> <dst_inst:hex> <dst_handle:hex> <dst_loc:hex> <dst_id:hex> <dst_gen>
    task_launch: Task Launch <tid> <uid> <start_id:hex> <start_gen> <term_id:hex> <term_gen>
    index_launch: Index Task Launch <tid> <uid> <start_id:hex> <start_gen> <term_id:hex> <term_gen> <point_term_id:hex> <point_term_gen> <point_size> <points:numbers>
    index_space_size: Index Space <uid> Context <context> Size <size>
    map_launch: Mapping Performed <uid> <start_id:hex> <start_gen> <term_id:hex> <term_gen>
""")


def read_log(spark: SparkSession, path: str, types: dict[str, RecordType] = RECORDS) -> dict[str, DataFrame]:
    """A table for each record type; lines of no type are in ``other``. Older logs are read with ``LEGACY``."""
    return split_log(spark.read.text(path).withColumnRenamed("value", "line"), types)


def split_log(lines: DataFrame, types: dict[str, RecordType] = RECORDS) -> dict[str, DataFrame]:
    """As ``read_log``, of the column ``line``; null lines are in no table, numbers beyond 64 bits are null."""
    out, known = {}, F.lit(False)
    for r in types.values():
        is_one = F.col("line").contains(r.words) & F.col("line").rlike(r.pattern)  # most lines are of another type: a cheap test first
        out[r.name] = lines.where(is_one).select(*[F.regexp_extract("line", r.pattern, i + 1).try_cast(k).alias(n) for i, (n, k) in enumerate(r.fields)])
        known = known | is_one
    out["other"] = lines.where(~known)
    return out


def log_lines(rows: DataFrame, kind: str, types: dict[str, RecordType] = RECORDS, prefix: str = "[0 - 0] {2}{log}: ") -> DataFrame:
    """The lines of one record type, for a text sink; a row with a null field has none."""
    return rows.select(F.concat(F.lit(prefix), types[kind].line()).alias("value")).where("value IS NOT NULL")


def index_points(launches: DataFrame) -> DataFrame:
    """The rows of the older logs' ``index_launch`` with the array ``point``: as many of the numbers as the point has dimensions."""
    numbers = F.filter(F.split(F.trim("points"), r"\s+"), lambda x: x != "")
    return launches.withColumn("point", F.slice(F.transform(numbers, lambda x: x.try_cast("long")), F.lit(1), F.col("point_size").cast("int"))).drop("points")


def dot_lines(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges as lines of a graph description; its first and last line are added by ``dot``."""
    return edges.select(F.format_string('  "%s" -> "%s";', F.col(src).cast("string"), F.col(dst).cast("string")).alias("value"))


def read_machine(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """processors (name, kind, speed), memories (name, bytes), affinities (processor, memory, bandwidth, latency).

    Lines begin with processor, memory and affinity, or with proc and mem for short; other lines are passed over.
    """
    f = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"#.*$", "")), r"\s+").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    return {
        "processors": f.where(at(0).isin("processor", "proc")).select(at(1).alias("name"), at(2).alias("kind"), at(3).try_cast("long").alias("speed")),
        "memories": f.where(at(0).isin("memory", "mem")).select(at(1).alias("name"), unit_bytes(at(2)).alias("bytes")),
        "affinities": f.where(at(0) == "affinity").select(at(1).alias("processor"), at(2).alias("memory"), at(3).try_cast("double").alias("bandwidth"), at(4).try_cast("double").alias("latency")),
    }


def read_results(spark: SparkSession, path: str, pattern: str = r"(?i)elapsed[^0-9]*([0-9.]+)") -> DataFrame:
    """(file, value) of the numbers that result logs report."""
    return spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.regexp_extract("value", pattern, 1).alias("v")).where("v <> ''").select(
        "file", F.col("v").cast("double").alias("value"))
