"""Scanning a folder as a Python data source, for batches and for streams.

`spark.read.format("vault")` lists what a scan keeps without entering folders that it leaves out, and opens nothing
else; filters on paths and times narrow the listing. `spark.readStream.format("vault")` gives the pages that came,
changed or went between two listings. The driver lists, executors read; both by pyarrow's file systems, so the folder is
one that all of them can reach.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith

from ..functions.names import glob_regex

#: Folders that are never scanned, whatever the options, and the endings of pages.
NEVER = (".git", "node_modules")
ENDINGS = (".md", ".fountain", ".spl")
#: Bytes and files of one task.
PART_BYTES, PART_FILES = 32 << 20, 5_000

SCHEMA = "path string, content string, mtime timestamp"
STREAM_SCHEMA = "path string, seq long, content string"


@dataclass(frozen=True)
class Rules:
    """What a scan keeps, by relative path; the same as vault.scanned()."""

    exclude: tuple[str, ...] = ()
    include_hidden: bool = False
    whitelist: tuple[str, ...] = ()
    nested: tuple[str, ...] = ()
    marker: str | None = None

    def _left_out(self) -> list[tuple[re.Pattern, bool]]:
        """Each exclusion, and whether what matches a folder matches all below it."""
        every = [p + "**" if p.endswith("/") else p for p in ("assets/", *self.exclude)]
        return [(re.compile(glob_regex(p), re.DOTALL), p.endswith("**")) for p in every]

    def enters(self, folder: str) -> bool:
        """Whether anything below a folder can be kept."""
        name = folder.rsplit("/", 1)[-1]
        if name in NEVER or name == self.marker or any(folder + "/" == n.rstrip("/") + "/" for n in self.nested):
            return False
        if name.startswith(".") and not self.include_hidden:
            listed = [w.rstrip("/") + "/" for w in self.whitelist]
            if not any((folder + "/").startswith(w) or w.startswith(folder + "/") for w in listed):
                return False
        return not any(below and r.search(folder + "/") for r, below in self._left_out())

    def keeps(self, path: str) -> bool:
        """Whether a file in a folder that is entered is kept."""
        if not path.endswith(ENDINGS):
            return False
        folders = path.split("/")[:-1]
        if not self.include_hidden and any(f.startswith(".") and len(f) > 1 for f in folders) and not any(path.startswith(w.rstrip("/") + "/") for w in self.whitelist):
            return False
        return not any(r.search(path) for r, _ in self._left_out())


@dataclass
class Asked:
    """Filters that the listing itself applies."""

    prefixes: list[str] = field(default_factory=list)
    paths: set[str] | None = None
    after: int | None = None

    def take(self, f: Filter) -> bool:
        """Whether this filter is fully applied here."""
        if getattr(f, "attribute", None) == ("path",):
            if isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
                return True
            if isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = own if self.paths is None else self.paths & own
                return True
        if getattr(f, "attribute", None) == ("mtime",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and isinstance(f.value, datetime):
            # files just before the time are left to Spark's own filter
            self.after = max(self.after or 0, int(f.value.replace(tzinfo=f.value.tzinfo or timezone.utc).timestamp()) - 1)
        return False

    def enters(self, folder: str) -> bool:
        inside = lambda p: (folder + "/").startswith(p) or p.startswith(folder + "/")
        return all(map(inside, self.prefixes)) and (self.paths is None or any(p.startswith(folder + "/") for p in self.paths))

    def keeps(self, path: str, mtime_ns: int) -> bool:
        return all(path.startswith(p) for p in self.prefixes) and (self.paths is None or path in self.paths) and (self.after is None or mtime_ns >= self.after * 10**9)


def listing(root: str, rules: Rules, asked: Asked | None = None, entered: list[str] | None = None) -> Iterator[tuple[str, int, int]]:
    """(path, mtime in ns, size) of the files that a scan keeps, folder by folder; entered collects the folders listed."""
    system, base = pafs.FileSystem.from_uri(root)
    asked, todo = asked or Asked(), [""]
    while todo:
        folder = todo.pop()
        if entered is not None:
            entered.append(folder)
        for info in sorted(system.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base)), key=lambda i: i.path):
            path = f"{folder}/{info.base_name}" if folder else info.base_name
            if info.type == pafs.FileType.Directory:
                if rules.enters(path) and asked.enters(path):
                    todo.append(path)
            elif rules.keeps(path) and asked.keeps(path, info.mtime_ns or 0):
                yield path, info.mtime_ns or 0, info.size or 0


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, int]], gone: list[str] = (), seq: int = 0):
        self.files, self.gone, self.seq = files, list(gone), seq


def parts(files: Iterator[tuple[str, int, int]], seq: int = 0) -> list[Part]:
    out, held, size = [], [], 0
    for path, mtime, n in files:
        held.append((path, mtime))
        size += n
        if size >= PART_BYTES or len(held) >= PART_FILES:
            out.append(Part(held, seq=seq))
            held, size = [], 0
    return [*out, Part(held, seq=seq)] if held else out


def _text(system: pafs.FileSystem, path: str) -> str | None:
    """A file's text; none if it has gone since it was listed."""
    try:
        with system.open_input_stream(path) as f:
            return f.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return None


class VaultReader(DataSourceReader):
    def __init__(self, root: str, rules: Rules, content: bool):
        self.root, self.rules, self.content, self.asked = root, rules, content, Asked()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.asked.take(f):
                yield f

    def partitions(self) -> list[Part]:
        return parts(listing(self.root, self.rules, self.asked)) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, base = pafs.FileSystem.from_uri(self.root)
        for path, mtime in partition.files:
            text = _text(system, f"{base}/{path}") if self.content else None
            if text is not None or not self.content:
                yield path, text, datetime.fromtimestamp(mtime / 1e9, timezone.utc)


class VaultStreamReader(DataSourceStreamReader):
    """An offset is the number of a listing, which is kept in a file of the state folder until the next one is done."""

    def __init__(self, root: str, rules: Rules, state: str):
        self.root, self.rules = root, rules
        self.system, self.state = pafs.FileSystem.from_uri(state)
        self.system.create_dir(self.state, recursive=True)
        known = self._numbers()
        self.last = known[-1] if known else 0

    def _numbers(self) -> list[int]:
        names = [i.base_name for i in self.system.get_file_info(pafs.FileSelector(self.state))]
        return sorted(int(x[5:-5]) for x in names if re.fullmatch(r"scan-\d+\.json", x))

    def _load(self, n: int) -> dict[str, list[int]]:
        if not n:
            return {}
        with self.system.open_input_stream(f"{self.state}/scan-{n}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        now = {p: [t, n] for p, t, n in listing(self.root, self.rules)}
        if now != self._load(self.last):
            path = f"{self.state}/scan-{self.last + 1}.json"
            with self.system.open_output_stream(path + ".part") as f:
                f.write(json.dumps(now).encode())
            self.system.move(path + ".part", path)
            self.last += 1
        return {"scan": self.last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        old, new = self._load(start["scan"]), self._load(end["scan"])
        changed = ((p, t, n) for p, (t, n) in new.items() if old.get(p) != [t, n])
        gone = [p for p in old if p not in new]
        return [*parts(changed, end["scan"]), *([Part([], gone, end["scan"])] if gone else [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, base = pafs.FileSystem.from_uri(self.root)
        for path, _ in partition.files:
            yield path, partition.seq, _text(system, f"{base}/{path}")
        for path in partition.gone:
            yield path, partition.seq, None

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["scan"]:
                self.system.delete_file(f"{self.state}/scan-{n}.json")


class VaultSource(DataSource):
    """Options: path; exclude, whitelist and nested, lists with commas between; hidden, marker; content (false lists only); state for streams."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return STREAM_SCHEMA if self.options.get("state") else SCHEMA

    def _rules(self) -> Rules:
        listed = lambda k: tuple(x for x in self.options.get(k, "").split(",") if x)
        return Rules(listed("exclude"), self.options.get("hidden", "false") == "true", listed("whitelist"), listed("nested"), self.options.get("marker") or None)

    def reader(self, schema) -> VaultReader:
        return VaultReader(self.options["path"], self._rules(), self.options.get("content", "true") == "true")

    def streamReader(self, schema) -> VaultStreamReader:
        return VaultStreamReader(self.options["path"], self._rules(), self.options["state"])


def _with_options(reader, rules: Rules):
    chosen = {"exclude": ",".join(rules.exclude), "hidden": str(rules.include_hidden).lower(), "whitelist": ",".join(rules.whitelist), "nested": ",".join(rules.nested), "marker": rules.marker or ""}
    return reader.format("vault").options(**chosen)


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VaultSource)


def scan(spark: SparkSession, root: str, rules: Rules = Rules(), content: bool = True) -> DataFrame:
    """(path, content, mtime) of the files that a scan keeps, content null with content=False, which opens no file."""
    _register(spark)
    return _with_options(spark.read, rules).option("content", str(content).lower()).load(root)


def scan_stream(spark: SparkSession, root: str, state: str, rules: Rules = Rules()) -> DataFrame:
    """(path, seq, content) of files as they come, change or go, which is a null content: what VaultWatch takes."""
    _register(spark)
    return _with_options(spark.readStream, rules).option("state", state).load(root)


def reachable(root: str) -> bool:
    """Whether pyarrow has a file system for this place."""
    try:
        pafs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True
