"""File sources: text corpora, JSON lines, nested JSON, profiles and mixed document formats."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import strip


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Text and Markdown files as (source_file, text), text stripped, broken bytes replaced; in no order,
    which ``corpus_files`` gives without the contents."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), strip(F.expr("decode(content, 'UTF-8')")).alias("text"))


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, length) sorted by name; the files' contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "length").orderBy("source_file")


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Number of files and bytes; the files' contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").load(folder)
    return found.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def seed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Concepts (with defaults) and relationships of a seed file {concepts, relationships}."""
    both = spark.read.schema(f"concepts array<struct<{_as_struct(schemas.CONCEPTS)}>>, relationships array<struct<{_as_struct(schemas.RELATIONSHIPS)}>>").json(path, multiLine=True)
    empty = F.array().cast("array<string>")
    concepts = both.select(F.inline("concepts")).withColumns({"category": F.coalesce("category", F.lit("Concept")), "difficulty": F.coalesce("difficulty", F.lit("intermediate"))} | {c: F.coalesce(c, empty) for c in ("example_use_cases", "related_tools", "source_references")})
    return concepts, both.select(F.inline("relationships"))


def communities(spark: SparkSession, path: str) -> DataFrame:
    """Communities of a JSON array or of JSON lines; a missing path or broken text gives no rows."""
    one = f"struct<{_as_struct(schemas.COMMUNITIES)}>"
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.COMMUNITIES)
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, one))
    entries = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", f"array<{one}>")).otherwise(lines)
    return raw.select(F.explode(entries).alias("entry")).where("entry.community_id IS NOT NULL").select("entry.*")


def dialogue(spark: SparkSession, folder: str) -> DataFrame:
    """Dialogue files in order of their names, entries in order within each: (file, pos, ...)."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.from_json("value", f"array<struct<{_as_struct(schemas.DIALOGUE)}>>").alias("entries"))
    return raw.select("file", F.posexplode("entries").alias("pos", "entry")).select("file", "pos", "entry.*")


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One profile per character; of several files the last by name counts."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.from_json("value", f"struct<{_as_struct(schemas.PROFILE)}>").alias("p"))
    return raw.groupBy(F.col("p.character").alias("character")).agg(F.max_by("p", "file").alias("p")).select("p.*")


def _as_struct(ddl: str) -> str:
    return ", ".join(":".join(f.split(" ", 1)) for f in ddl.split(", "))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, error) of .txt, .rtf, .rtfd and .pdf files; ``error`` says why a text is null.

    An .rtfd is a folder; its text is the TXT.rtf within, and it goes by the folder's path.
    """
    import pandas as pd

    def decode(frames):
        for frame in frames:
            read = [_read(p, c) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame({"path": [re.sub(r"\.rtfd/TXT\.rtf$", ".rtfd", p) for p in frame["path"]], "text": [r[0] for r in read], "error": [r[1] for r in read]}, dtype=object)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,rtf,pdf}").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "content").mapInPandas(decode, "path string, text string, error string")


def _read(path: str, content: bytes) -> tuple[str | None, str | None]:
    if path.endswith(".txt"):
        return content.decode("utf-8", "replace"), None
    try:
        if path.endswith(".rtf"):
            try:
                from striprtf.striprtf import rtf_to_text
            except ImportError:
                return rtf_text(content), None
            return rtf_to_text(content.decode("latin-1")), None
        import io

        from pypdf import PdfReader

        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages), None
    except ImportError as e:
        return None, f"no parser: {e.name}"


#: Groups whose text isn't part of an RTF document's body.
RTF_SKIPPED = ["fonttbl", "colortbl", "stylesheet", "info", "pict", "expandedcolortbl", "listtable", "listoverridetable", "generator", "header", "footer"]
_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)


def rtf_text(content: bytes) -> str:
    """The body text of an RTF file: paragraphs, tabs, escaped bytes and code points; the rest is left out."""
    out, skipping, levels, pending = [], False, [], 0
    for word, number, byte, sign, brace, plain in _RTF.findall(content.decode("cp1252", "replace")):
        if brace == "{":
            levels.append(skipping)
        elif brace == "}":
            skipping = levels.pop() if levels else False
        elif word in RTF_SKIPPED or sign == "*":
            skipping = True
        elif skipping:
            continue
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word == "u":
            out.append(chr(int(number) % 65536))
            pending = 1
        elif byte:
            if not pending:
                out.append(bytes([int(byte, 16)]).decode("cp1252", "replace"))
            pending = 0
        elif sign:
            out.append("\n" if sign in "\r\n" else {"~": " "}.get(sign, sign if sign in "\\{}" else ""))
        elif plain:
            out.append(plain[pending:])
            pending = 0
    return "".join(out)


def feed_entries(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """(title, summary) of Atom feeds: the feed's own title dropped, white space collapsed."""
    from ..functions.text import collapse_spaces, xml_elements

    titles = F.transform(xml_elements(F.col(column), "title"), collapse_spaces)
    summaries = F.transform(xml_elements(F.col(column), "summary"), collapse_spaces)
    pairs = F.arrays_zip(F.slice(titles, 2, F.greatest(F.size(titles) - 1, F.lit(0))).alias("title"), summaries.alias("summary"))
    return feeds.select(F.inline(F.filter(pairs, lambda p: p["title"].isNotNull() & p["summary"].isNotNull())))
