"""Public-safety predicates, corpus leak scan and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlane.functions import constants as C
from pactlane.functions import text as T
from pactlane.operators.common import union_all

LINE_BREAK = "\r\n|[\n\u000b\f\r\u001c\u001d\u001e\u0085  ]"
# ---- fixed values: category, pattern, detail, in report order
LINE_RULES = (
    ("private_path", C.PRIVATE_PATH, "local absolute path"),
    ("secret", C.SECRET, "secret-like token"),
    ("private_ip", C.PRIVATE_IP, "private IP address"),
    ("ssh_detail", C.SSH_DETAIL, "SSH command or key detail"),
)


def first_unsafe(text: Column) -> Column:
    """First violated public-safety rule of a text, NULL when clean."""
    out = F.lit(None).cast("string")
    for name, pattern, _detail in reversed(LINE_RULES[:3]):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


FINDING = "array<struct<line:int,category:string,detail:string>>"


def _finding(line, category, detail) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_column(line).cast("int").alias("line"), as_column(category).alias("category"), as_column(detail).alias("detail"))


def _line_hits(lines: Column) -> Column:
    """One finding per line and violated rule."""
    of_line = lambda body, n: F.array_compact(F.array(*[F.when(body.rlike(p), _finding(n + 1, c, d)) for c, p, d in LINE_RULES]))
    return F.flatten(F.transform(lines, of_line))


def _may_hit(text: Column) -> Column:
    """No line can violate a rule unless the whole text holds the rule's pattern somewhere; anchors to
    the start of a line are left out here."""
    anywhere = [p.replace(r"^\s*", "") for _c, p, _d in LINE_RULES]
    out = F.lit(False)
    for p in anywhere:
        out = out | text.rlike(p)
    return out


def _path_hits(path: Column) -> Column:
    """Findings that follow from the path alone."""
    suffix = F.concat(F.lit("."), F.substring_index(path, ".", -1))
    private = F.exists(F.split(path, "/"), lambda p: p.isin(*C.PRIVATE_ARTIFACT_PARTS) | p.startswith("checkpoint-"))
    return F.array_compact(
        F.array(
            F.when(suffix.isin(*C.MODEL_ARTIFACT_SUFFIXES), _finding(0, "model_artifact", "model/checkpoint artifact")),
            F.when(suffix == ".log", _finding(0, "raw_log", "raw log artifact")),
            F.when(private, _finding(0, "private_artifact_dir", "private training artifact directory")),
        )
    )


def _row_hits(lines: Column, max_rows: int) -> Column:
    """Row files: rows marked private, and a file with too many rows."""
    blank = lambda b: b.rlike(r"(?U)^\s*$")
    marked = F.transform(lines, lambda b, n: F.when(F.get_json_object(b, "$.provenance.public_safe") == "false", _finding(n + 1, "raw_private_row", "public JSONL row marked private")))
    rows = F.size(F.filter(lines, lambda b: ~blank(b)))
    large = F.when(rows > max_rows, _finding(0, "oversized_public_corpus", F.concat(rows, F.lit(f" rows exceeds {max_rows}"))))
    return F.array_compact(F.concat(marked, F.array(large)))


def missing_paths(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Requested paths under which nothing was scanned."""
    prefixes = files.select(
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
        ).alias("path")
    ).distinct()
    return requested.join(prefixes, "path", "left_anti").select(
        "path", F.lit(0).alias("line"), F.lit("missing_path").alias("category"), F.lit("scan input path does not exist").alias("detail")
    )


def scan(files: DataFrame, requested: DataFrame | None = None, max_rows: int = 5000) -> DataFrame:
    """All findings over a (path, text) table, in one pass over it: every file yields one array."""
    lines, none = F.split("text", LINE_BREAK), F.array().cast(FINDING)
    found = F.concat(
        _path_hits(F.col("path")),
        F.when(_may_hit(F.col("text")), _line_hits(lines)).otherwise(none),
        F.when(F.col("path").endswith(".jsonl"), _row_hits(lines, max_rows)).otherwise(none),
    )
    out = files.select("path", F.explode(found).alias("h")).select("path", "h.*")
    return out if requested is None else union_all([out, missing_paths(requested, files)])


def redacted(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("redacted", T.redact(F.col(column)))
