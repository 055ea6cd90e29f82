"""Python sources as a table of their definitions: docstring coverage, style findings, and pages of an API reference."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detections import narrowest

_DEFINITION = "path string, module string, kind string, name string, private boolean, start int, end int, documented boolean, signature string, doc string"
#: Codes of findings that say that a docstring is missing.
MISSING = ("D100", "D101", "D102", "D103", "D104", "D105", "D106", "D107")


def _definitions(path: str, source: bytes) -> list[tuple]:
    try:
        tree = ast.parse(source.decode("utf-8"))
    except (SyntaxError, UnicodeDecodeError, ValueError):
        return []
    module = PurePosixPath(path).stem
    text = ast.get_docstring(tree)
    out = [(path, module, "module", module, False, 1, max(1, source.count(b"\n")), text is not None, "", text)]

    def walk(node: ast.AST, within: str) -> None:
        for x in ast.iter_child_nodes(node):
            here = within
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                function, here = not isinstance(x, ast.ClassDef), f"{within}{x.name}."
                head = f"{x.name}({ast.unparse(x.args)})" + (f" -> {ast.unparse(x.returns)}" if x.returns else "") if function else x.name
                doc = ast.get_docstring(x)
                out.append((path, module, "function" if function else "class", f"{within}{x.name}", x.name.startswith("_"), x.lineno, x.end_lineno, doc is not None, head, doc))
            walk(x, here)

    walk(tree, "")
    return out


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """A row for each module, class and function of the .py files under a path; files that don't parse have none."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [r for p, c in zip(pdf.path, pdf.content, strict=True) for r in _definitions(p, bytes(c))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _DEFINITION.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(path)
    return files.select("path", "content").mapInPandas(read, _DEFINITION)


def _category() -> Column:
    return F.when(F.col("kind") == "module", "modules").when(F.col("kind") == "class", "classes").when(F.col("private"), "private functions").otherwise("public functions")


def coverage(found: DataFrame) -> DataFrame:
    """Per category: how many definitions there are, and how many of them have a docstring."""
    return found.groupBy(_category().alias("category")).agg(F.count("*").alias("total"), F.count_if("documented").alias("documented"))


def findings(spark: SparkSession, path: str) -> DataFrame:
    """A linter's JSON findings: path, row, code."""
    rows = [(str(Path(r["filename"]).resolve()), int((r.get("location") or {}).get("row") or 0), str(r.get("code"))) for r in json.loads(Path(path).read_text())]
    return spark.createDataFrame(rows, "path string, row int, code string").where("row > 0")


def compliance(found: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per category the documented definitions and those without a finding; and the functions without a docstring or with a finding (problem, path, name).

    A finding belongs to the narrowest documented definition around its row.
    """
    documented = found.where("documented")
    # files are laid one after the other on one axis, so that a row's place names its file
    base = F.pmod(F.xxhash64("file"), F.lit(1 << 40)) * (1 << 21)
    plain = lambda df: df.withColumn("file", F.regexp_replace("path", r"^file:/*", "/"))
    spans = plain(documented).withColumn("base", base).select((F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"), F.struct("path", "kind", "name", "start").alias("span_id"))
    points = plain(told.where(~F.col("code").isin(*MISSING))).withColumn("at", base + F.col("row")).select(F.monotonically_increasing_id().alias("ord"), "at")
    hit = narrowest(points, spans, 1 << 10).where("span_id IS NOT NULL").select("span_id.*").distinct().withColumn("wrong", F.lit(True))
    judged = documented.join(hit, ["path", "kind", "name", "start"], "left").withColumn("wrong", F.coalesce("wrong", F.lit(False)))
    per = judged.groupBy(_category().alias("category")).agg(F.count("*").alias("total"), F.count_if(~F.col("wrong")).alias("compliant"))
    bad = found.where("kind = 'function' AND NOT documented").select(F.lit("undocumented").alias("problem"), "path", "name")
    return per, bad.unionAll(judged.where("wrong AND kind = 'function'").select(F.lit("style"), "path", "name")).distinct()


def write_pages(found: DataFrame, out: Path) -> int:
    """A Markdown page for each module, of its public definitions, and an index of them, by the executors; the number of pages."""
    out.mkdir(parents=True, exist_ok=True)
    folder = str(out)
    item = F.struct("start", "kind", "name", "signature", "doc")
    shown = found.where("kind = 'module' OR NOT private AND name NOT RLIKE '(^|[.])_'")
    pages = shown.groupBy("path", "module").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            names, about = [], []
            for p in pdf.itertuples():
                name = "-".join(PurePosixPath(p.path).with_suffix("").parts[-2:])
                parts = [f"# {p.module}"]
                for d in p.items:
                    if d["kind"] != "module":
                        parts.append(f"{'##' if '.' not in d['name'] else '###'} {d['name']}\n\n```python\n{'class ' if d['kind'] == 'class' else ''}{d['signature']}\n```")
                    if d["doc"]:
                        parts.append(d["doc"])
                Path(folder, f"{name}.md").write_text("\n\n".join(parts) + "\n")
                first = next((d["doc"] for d in p.items if d["kind"] == "module" and d["doc"]), "")
                names.append(name)
                about.append(first.split("\n")[0])
            yield pd.DataFrame({"name": names, "about": about})

    listed = pages.mapInPandas(save, "name string, about string").orderBy("name").collect()
    (out / "index.md").write_text("# API\n\n" + "".join(f"- [{r['name']}]({r['name']}.md): {r['about']}\n" for r in listed))
    return len(listed)
