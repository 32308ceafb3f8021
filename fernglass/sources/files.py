"""Sources: the manifest, folders, plain files and transcripts, and the registry of extractors."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..operators.report import DOMAIN_TIERS

#: Kinds of sources, those not built, what is never read, and the suffixes of texts.
TYPES, NOT_BUILT = ("local", "transcripts", "git", "web"), ("git", "web")
ALWAYS_EXCLUDED = ("*.tmp", "*.swp", "*~", "*.lock")
SUFFIXES = {"markdown": (".md", ".markdown", ".mdx"), "text": (".txt", ".rst", ".log", ".csv"), "cc-transcript": (".jsonl",), "pdftotext": (".pdf",)}
LARGEST, PROBED = 5 * 1024 * 1024, 2048
#: Records of a transcript without conversation, and the fields a tool call is known by.
DROPPED_RECORDS = ("attachment", "queue-operation", "atis-latch", "last-prompt", "cost-state", "file-history-snapshot", "file-history-delta", "bridge-session", "mode", "system")
TOOL_FIELDS = ("command", "file_path", "pattern", "query", "url", "path", "prompt")
CALL_CHARS, ERROR_CHARS = 200, 500


class SourceError(ValueError):
    """A manifest that can't be used."""


@dataclass(frozen=True)
class Source:
    id: str
    type: str
    domain: str
    path: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    enabled: bool = True
    cadence: str | None = None
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def tier(self) -> str:
        return DOMAIN_TIERS[self.domain]


def read_manifest(entries: list[dict]) -> list[Source]:
    """Sources of a parsed manifest; missing keys, unknown types and domains, missing paths and repeated ids raise."""
    out: dict[str, Source] = {}
    for n, raw in enumerate(entries):
        lacking = [k for k in ("id", "type", "domain") if not raw.get(k)]
        if lacking:
            raise SourceError(f"source {n}: missing {', '.join(lacking)}")
        name, kind, domain = raw["id"], raw["type"], raw["domain"]
        if kind not in TYPES:
            raise SourceError(f"{name}: unknown type {kind!r}")
        if kind in NOT_BUILT:
            raise SourceError(f"{name}: type {kind!r} is not built")
        if domain not in DOMAIN_TIERS:
            raise SourceError(f"{name}: unknown domain {domain!r}")
        if not raw.get("path"):
            raise SourceError(f"{name}: a {kind} source needs a path")
        if name in out:
            raise SourceError(f"{name}: defined twice")
        include = tuple(raw.get("include") or (("*.jsonl",) if kind == "transcripts" else ()))
        known = {"id", "type", "domain", "path", "include", "exclude", "enabled", "cadence"}
        out[name] = Source(name, kind, domain, raw["path"], include, tuple(raw.get("exclude") or ()), raw.get("enabled", True), raw.get("cadence"), {k: v for k, v in raw.items() if k not in known})
    return list(out.values())


def inbox_sources(root: str) -> list[Source]:
    """A source for each folder of the inbox, named by its domain; an unknown name raises, hidden folders are passed over."""
    if not os.path.isdir(root):
        return []
    names = sorted(n for n in os.listdir(root) if os.path.isdir(os.path.join(root, n)) and not n.startswith("."))
    return read_manifest([{"id": f"inbox:{n}", "type": "local", "domain": n, "path": os.path.join(root, n)} for n in names])


def all_sources(manifest: list[dict], inbox: str | None = None) -> list[Source]:
    """Enabled sources, the inbox's first."""
    return [s for s in (*(inbox_sources(inbox) if inbox else ()), *read_manifest(manifest)) if s.enabled]


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression that matches a path or any end of it after a slash."""
    return f"(?:^|/){fnmatch.translate(glob).removesuffix(chr(92) + 'Z').removesuffix(chr(92) + 'z')}$"


def wanted(path: Column, source: Source) -> Column:
    """Whether a path is of the source: excludes win, no include means all, hidden names are out."""
    hit = ~F.regexp_extract(path, r"([^/]*)$", 1).startswith(".")
    for glob in (*ALWAYS_EXCLUDED, *source.exclude):
        hit = hit & ~path.rlike(glob_pattern(glob))
    if source.include:
        some = F.lit(False)
        for glob in source.include:
            some = some | path.rlike(glob_pattern(glob))
        hit = hit & some
    return hit


def _content(path: str) -> bytes:
    """The bytes of a file named as a listing names it."""
    if path.startswith("file:"):
        with open(re.sub("^file:/+", "/", path), "rb") as file:
            return file.read()
    system, inside = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@"))
    with system.open_input_stream(unquote(inside)) as stream:
        return stream.read()


def scan_files(spark: SparkSession, source: Source) -> tuple[DataFrame, bool]:
    """``(files, complete)``: ``rel_uri, mtime, size_bytes, content`` of a source; a root that can't be listed is empty and incomplete.

    The listing is filtered before any content is read: files that are left out are not opened, and the content of one that is too large is null."""
    empty = spark.createDataFrame([], "rel_uri string, mtime double, size_bytes long, content binary")
    if not source.path or (source.path.startswith("/") and not os.path.isdir(source.path)):
        return empty, False
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source.path)
    root = source.path.rstrip("/") + "/"
    relative = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root), "")
    listed = files.select("path", relative.alias("rel_uri"), (F.unix_millis("modificationTime") / 1000).alias("mtime"), F.col("length").alias("size_bytes"))
    listed = listed.filter(wanted(F.col("rel_uri"), source))
    small = F.col("size_bytes") <= LARGEST

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):  # one file of at most LARGEST bytes at a time
                row = batch.slice(k, 1)
                yield pa.record_batch([row.column("rel_uri"), row.column("mtime"), row.column("size_bytes"), pa.array([_content(path)], pa.binary())], ["rel_uri", "mtime", "size_bytes", "content"])

    opened = listed.filter(small).mapInArrow(read, "rel_uri string, mtime double, size_bytes long, content binary")
    return opened.unionByName(listed.filter(~small).select("rel_uri", "mtime", "size_bytes", F.lit(None).cast("binary").alias("content"))), True


#: Extractors by name: a predicate on the suffix and a mapping of files to documents. ``register`` adds to it.
_REGISTRY: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = {}


def register(name: str, suffixes: tuple[str, ...], extract: Callable[[DataFrame], DataFrame]) -> None:
    """Add an extractor; where two match a suffix, the first registered does."""
    _REGISTRY.setdefault(name, (suffixes, extract))


def extractor_of(path: Column) -> Column:
    """The name of the extractor for a path's suffix, null if there is none."""
    lower, out = F.lower(path), None
    for name, (suffixes, _) in _REGISTRY.items():
        hit = F.lit(False)
        for suffix in suffixes:
            hit = hit | lower.endswith(suffix)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def extract_texts(files: DataFrame) -> DataFrame:
    """``rel_uri, title, text, status, extractor, mtime, size_bytes`` of plain and markdown files; large, binary and blank ones are empty."""
    text = stripped(F.decode(F.col("content"), "UTF-8"))
    heading = F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*#*\s*$", 1)
    stem = F.regexp_replace(F.regexp_replace("rel_uri", "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    binary = F.expr(f"instr(hex(substring(content, 1, {PROBED})), '00') % 2 = 1")
    bad = (F.col("size_bytes") > LARGEST) | binary | (text == "")
    markdown = F.lower("rel_uri").rlike(r"\.(?:md|markdown|mdx)$")
    return files.select("rel_uri", F.when(heading != "", heading).otherwise(stem).alias("title"), F.when(~bad, text).alias("text"), F.when(bad, "empty").otherwise("ok").alias("status"), F.when(markdown, "markdown").otherwise("text").alias("extractor"), "mtime", "size_bytes")


def extract_transcripts(files: DataFrame) -> DataFrame:
    """As ``extract_texts``, of transcripts: turns in order, apart by blank lines, under the title that the transcript gives itself or its file's name."""
    content = F.when(F.col("size_bytes") <= LARGEST, F.decode(F.col("content"), "UTF-8"))
    lines = files.select(F.col("rel_uri").alias("path"), F.posexplode(F.split(content, r"\r?\n")).alias("line", "value"))
    turns = transcript_blocks(lines).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part", "text"))), lambda b: b["text"]), "\n\n").alias("text"))
    named = transcript_facts(lines).select("path", F.col("title").alias("_said"))
    stem = F.regexp_replace(F.regexp_replace("rel_uri", "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    rows = files.select("rel_uri", "mtime", "size_bytes").join(turns.withColumnRenamed("path", "rel_uri"), "rel_uri", "left").join(named.withColumnRenamed("path", "rel_uri"), "rel_uri", "left")
    return rows.select("rel_uri", F.coalesce("_said", stem).alias("title"), "text", F.when(F.col("text").isNull(), "empty").otherwise("ok").alias("status"), F.lit("cc-transcript").alias("extractor"), "mtime", "size_bytes")


def extract(files: DataFrame) -> DataFrame:
    """Documents of files by the extractor of their suffix; files without one are left out. Each extractor sees its own files alone."""
    named = files.withColumn("_extractor", extractor_of(F.col("rel_uri")))
    parts = [run(named.filter(F.col("_extractor") == name).drop("_extractor")) for name, (_, run) in _REGISTRY.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


register("markdown", SUFFIXES["markdown"], extract_texts)
register("text", SUFFIXES["text"], extract_texts)

_CONTENT = "array<struct<type:string,text:string,thinking:string,name:string,input:map<string,string>,is_error:boolean,content:string>>"


_RECORD = "type string, isMeta string, isSidechain string, message struct<role:string,content:string>, aiTitle string, sessionId string, cwd string, gitBranch string, timestamp string"


def _records(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects with what is read of them, parsed once; a content that is a list stays JSON text."""
    return lines.filter(F.col("value").rlike(r"^\s*\{")).withColumn("_r", F.from_json("value", _RECORD)).filter("_r is not null")


def transcript_blocks(lines: DataFrame, thinking: bool = False, sidechains: bool = False) -> DataFrame:
    """``path, line, part, kind, text`` of transcript lines ``path, line, value``: turns, tool calls in one line, and errors of tools.

    Lines that are no JSON object, bookkeeping records, meta and side-chain rows are left out."""
    rows = _records(lines)
    get = lambda f: F.col(f"_r.{f}")
    rows = rows.withColumns({"_role": F.coalesce(get("message.role"), get("type")), "_content": get("message.content")})
    rows = rows.filter(~F.coalesce(get("type").isin("ai-title", *DROPPED_RECORDS), F.lit(False)) & (F.coalesce(get("isMeta"), F.lit("false")) != "true"))
    if not sidechains:
        rows = rows.filter(F.coalesce(get("isSidechain"), F.lit("false")) != "true")
    plain = rows.filter(F.col("_content").isNotNull() & ~F.col("_content").rlike(r"^\s*\[\s*\{"))
    plain = plain.select("path", "line", F.lit(0).alias("part"), F.col("_role").alias("kind"), F.concat(F.col("_role"), F.lit(": "), stripped(F.col("_content"))).alias("text"), stripped(F.col("_content")).alias("_own"))
    parts = rows.filter(F.col("_content").rlike(r"^\s*\[\s*\{")).select("path", "line", "_role", F.posexplode(F.from_json("_content", _CONTENT)).alias("part", "b"))
    values = [F.trim(F.try_element_at("b.input", F.lit(f))) for f in TOOL_FIELDS]
    known = F.coalesce(*(F.when(v != "", v) for v in values))
    names = F.array_join(F.slice(F.array_sort(F.map_keys("b.input")), 1, 5), ", ")
    call = F.trim(F.concat(F.lit("["), F.coalesce("b.name", F.lit("tool")), F.lit("] "), F.substring(F.coalesce(known, names, F.lit("")), 1, CALL_CHARS)))
    nested = F.array_join(F.from_json("b.content", "array<struct<text:string>>").getField("text"), "\n")
    error = F.substring(F.trim(F.coalesce(nested, "b.content", F.lit(""))), 1, ERROR_CHARS)
    kind = F.col("b.type")
    own = F.when(kind == "text", stripped(F.col("b.text"))).when((kind == "thinking") & F.lit(thinking), stripped(F.col("b.thinking"))).when(kind == "tool_use", call).when((kind == "tool_result") & F.col("b.is_error"), error)
    label = F.when(kind == "text", F.col("_role")).when(kind == "tool_result", "tool_error").otherwise(kind)
    shown = F.when(kind == "text", F.concat(F.col("_role"), F.lit(": "), own)).when(kind == "thinking", F.concat(F.lit("thinking: "), own)).when(kind == "tool_result", F.concat(F.lit("error: "), own)).otherwise(own)
    parts = parts.select("path", "line", "part", label.alias("kind"), shown.alias("text"), own.alias("_own"))
    return plain.unionByName(parts).filter("_own <> ''").drop("_own")


def transcript_facts(lines: DataFrame) -> DataFrame:
    """``path, title, session_id, cwd, git_branch, first_ts, last_ts`` of each transcript: the last title and the first of the others, by line."""
    get = lambda f: F.col(f"_r.{f}")
    first = lambda f: F.min_by(get(f), F.when(F.coalesce(get(f), F.lit("")) != "", F.col("line")))
    rows = _records(lines)
    return rows.groupBy("path").agg(
        F.max_by(get("aiTitle"), F.when(F.coalesce(get("aiTitle"), F.lit("")) != "", F.col("line"))).alias("title"),
        first("sessionId").alias("session_id"), first("cwd").alias("cwd"), first("gitBranch").alias("git_branch"), first("timestamp").alias("first_ts"),
        F.max_by(get("timestamp"), F.when(F.coalesce(get("timestamp"), F.lit("")) != "", F.col("line"))).alias("last_ts"),
    )


register("cc-transcript", SUFFIXES["cc-transcript"], extract_transcripts)
