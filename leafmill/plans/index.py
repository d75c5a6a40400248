"""A searchable index of a folder as Parquet tables, kept up to date by set operations.

Tables: files, documents, chunks, postings, vectors, and ``gone``. A build diffs the folder against ``files``, extracts
what changed in parallel, and appends *segments*: the rows of the files that are new or changed, and the paths whose
earlier rows no longer count (``gone``). A table is the union of its segments in the manifest's order; of each path only the
rows of the last segment that holds or removes it count, an anti join with a short list. So a sync costs what changed, not
what the index holds. When there are SEGMENTS of them, they are merged into one.

A build becomes visible by one small file, the manifest of the next number, which names its segments, what each of them
holds, the settings, and the corpus's statistics. Readers take the newest manifest. Segments have names of their own, so builders
never write where another one writes; a build that dies leaves folders that no manifest names.

*Two builders.* A manifest is put only where its number is free. A builder that finds it taken puts its segments on top of the other's,
if the other one has not settled any of its paths differently; if it has, the build is refused and its segments are deleted.

*Statistics.* The number of chunks and of their terms is a sum over the files' rows, so a build adds those of its files and
subtracts those of the paths that it replaces; no text is read again. A term's document frequency is the number of its
postings, which a search reads anyway.

Vectors are int8 codes with a scale. A chunk's text is embedded once, whatever the files and builds it occurs in; an embedder is a
function from texts to vectors, called in Arrow batches. If it fails, the build ends with keyword search alone.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import answers, chunking, ingest, search
from ..sources import assets as visuals
from ..sources import files as source
from ..sources.filters import Rules
from ..sources.legacy import legacy_tables

VERSION = 6
#: Segments that a build merges into one.
SEGMENTS = 8
#: Chunks and documents at most that carry a document's visual assets (a fixed value).
DOCUMENT_ASSETS = 24
SCHEMAS = {
    "files": "relative_path string, status string, size bigint, mtime double, parser string, chunks int, terms bigint, content_hash string, error_reason string",
    "documents": f"relative_path string, parser string, size bigint, mtime double, content_hash string, chunks int, token_estimate bigint, summary string, section_hints array<string>, structure {source.STRUCTURE}, assets {source.ASSETS}",
    "chunks": f"chunk_id string, relative_path string, ordinal int, text string, chunk_hash string, has_visual boolean, chunk_type string, sheet_name string, row_number int, assets {source.ASSETS}, dl int",
    "postings": "term string, chunk_id string, relative_path string, tf bigint, dl int",
    "vectors": "chunk_id string, relative_path string, chunk_hash string, dim int, scale double, codes array<tinyint>",
    "gone": "relative_path string",
}
Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


#: Winners whose texts are fetched by their ids; more are joined.
FETCHED = 1000


class SearchError(ValueError):
    """A search that this index cannot answer; the message says why."""


@dataclass(frozen=True)
class Embedder:
    """What turns texts into vectors: a function that workers can load, the model's key, and texts in a call."""

    embed: Embed
    key: str
    batch: int = 96


def hashed_words(texts: Sequence[str], dim: int = 64) -> list[list[float]]:
    """An embedder without a model: words hashed into ``dim`` places, the same everywhere."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * dim
        for w in tx.folded(t.lower()).split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
        out.append(v)
    return out


#: Chunks with their terms in order, between spaces, as a build holds them.
CUT = f"{SCHEMAS['chunks']}, words string"
#: A term with its postings in some megabytes of chunks.
BLOCKS = "term string, rows array<struct<chunk_id:string,relative_path:string,tf:bigint,dl:int>>"


def _cut(texts: list[list], arrow: pa.Schema) -> pa.RecordBatch:
    """CUT rows of documents (relative_path, text, chunks, assets)."""
    rows = []
    for path, text, given, assets in texts:
        for ordinal, c in enumerate(given or [{"text": t} for t in chunking.split_text(text)]):
            t = c["text"] or ""
            digest = hashlib.sha256(t.encode()).hexdigest()
            held = [a for a in assets or () if a["anchor"] and a["anchor"] in t]
            found = tx.terms_of(t)
            tail = hashlib.sha256(f"{path}{ordinal}{digest}".encode()).hexdigest()[:8]
            rows.append((f"{path}:{ordinal}:{tail}", path, ordinal, t, digest, bool(held), c.get("chunk_type"), c.get("sheet_name"), c.get("row_number"), held or None, len(found), " ".join(found)))
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _inverted(chunks: pa.Table, arrow: pa.Schema) -> pa.RecordBatch:
    """BLOCKS rows of chunks (chunk_id, relative_path, dl, words): terms are numbered, and (term, chunk) pairs counted in arrays."""
    ids, paths, lengths = (chunks.column(n).combine_chunks() for n in ("chunk_id", "relative_path", "dl"))
    words = pa.array([" ".join(w for w in chunks.column("words").to_pylist() if w)], pa.large_string())
    coded = pc.split_pattern(words, " ").flatten().dictionary_encode()
    n = chunks.num_rows
    owner = np.repeat(np.arange(n), lengths.to_numpy(zero_copy_only=False))
    pairs, times = np.unique(coded.indices.to_numpy().astype(np.int64) * n + owner, return_counts=True)
    at, of = pa.array(pairs % n), pairs // n
    ends = np.searchsorted(of, np.arange(len(coded.dictionary) + 1)).astype(np.int32)
    kind = arrow.field("rows").type
    held = pa.StructArray.from_arrays([ids.take(at), paths.take(at), pa.array(times.astype(np.int64)), lengths.take(at)], fields=list(kind.value_type))
    return pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.ListArray.from_arrays(pa.array(ends), held, type=kind)], schema=arrow)


class Index:
    def __init__(self, spark: SparkSession, root: str, folder: str, rules: Rules = Rules(), max_mb: float = 50.0, embedder: Embedder | None = None):
        self.spark, self.root, self.folder, self.rules, self.max_mb, self.embedder = spark, root.rstrip("/"), folder.rstrip("/"), rules, max_mb, embedder
        self._cancelled, self._group = threading.Event(), f"leafmill-{uuid.uuid4().hex}"

    # Storage ------------------------------------------------------------------------------------

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _manifests(self) -> list[int]:
        path, fs = self._fs()
        if not fs.exists(path(f"{self.folder}/manifests")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.folder}/manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self) -> dict:
        """The newest manifest: its number, segments, totals and settings; empty for a new index."""
        path, fs = self._fs()
        for _ in range(3):  # the newest one may be deleted while it is read, when two builds follow at once
            found = self._manifests()
            if not found:
                break
            try:
                stream = fs.open(path(f"{self.folder}/manifests/{found[-1]}.json"))
            except Exception as e:
                if "FileNotFoundException" not in str(e):
                    raise
                continue
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return {"number": 0, "segments": [], "totals": {"chunks": 0, "terms": 0}, "version": str(VERSION), "mode": "keyword", "engine": None, "model": None, "dim": None}

    def _put(self, manifest: dict) -> bool:
        """Put the manifest under its number if that is free: one file appears, whole or not at all.

        A local disk has links that fail where a name is taken, other file systems a rename that does.
        """
        path, fs = self._fs()
        jvm, folder = self.spark._jvm, f"{self.folder}/manifests"
        fs.mkdirs(path(folder))
        made, name = fs.makeQualified(path(f"{folder}/new-{uuid.uuid4().hex}")), fs.makeQualified(path(f"{folder}/{manifest['number']}.json"))
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                at = jvm.java.nio.file.Path.of
                jvm.java.nio.file.Files.createLink(at(name.toUri()), at(made.toUri()))
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), fs.getConf()).rename(made, name, options)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
        finally:
            if fs.exists(made):
                fs.delete(made, False)

    def _commit(self, before: dict, manifest: dict) -> dict:
        """Make ``manifest``, built on ``before``, visible, on top of what other builders have made visible meanwhile; returns what was put."""
        own = [s for s in manifest["segments"] if s not in before["segments"]]
        base = before
        while True:
            manifest = manifest | {"number": base["number"] + 1}
            if self._put(manifest):
                return manifest
            other = self.manifest()
            appended = manifest["segments"] == [*base["segments"], *own]
            settings = ("version", "mode", "engine", "model", "dim")
            if not appended or any(other[k] != before[k] for k in settings) or self._settled_otherwise(before, other, own):
                self._delete(own)
                raise OSError(f"another build has written manifest {base['number'] + 1} and settled files of this one otherwise; the index is as that build left it")
            base = other
            manifest = manifest | {"segments": [*other["segments"], *own], "totals": self._totals(other, own)}

    def _settled_otherwise(self, before: dict, other: dict, own: list[dict]) -> bool:
        """Whether ``other`` has changed a path of ``own`` segments since ``before`` to something else than they have."""
        ours = self._files(own).select("relative_path", F.struct("status", "content_hash", "error_reason").alias("ours"))
        touched = self._of(own, "gone").select("relative_path").union(ours.select("relative_path")).distinct()
        row = lambda m, name: self._files(m["segments"]).join(touched, "relative_path", "left_semi").select("relative_path", F.struct("status", "content_hash", "error_reason").alias(name))
        both = touched.join(ours, "relative_path", "left").join(row(before, "old"), "relative_path", "left").join(row(other, "new"), "relative_path", "left")
        return not both.where(~F.col("old").eqNullSafe(F.col("new")) & ~F.col("ours").eqNullSafe(F.col("new"))).isEmpty()

    def _totals(self, base: dict, own: list[dict]) -> dict:
        """Chunks and terms of ``base`` with ``own`` segments on top: by adding theirs and subtracting those of the paths that they replace."""
        part = lambda df, sign: df.select((sign * F.col("chunks")).alias("chunks"), (sign * F.col("terms")).alias("terms"))
        replaced = self._files(base["segments"]).join(self._of(own, "gone").select("relative_path").distinct(), "relative_path", "left_semi")
        row = part(self._files(own), 1).unionByName(part(replaced, -1)).agg(F.sum("chunks"), F.sum("terms")).first()
        return {"chunks": base["totals"]["chunks"] + (row[0] or 0), "terms": base["totals"]["terms"] + (row[1] or 0)}

    def _delete(self, segments: list[dict]) -> None:
        path, fs = self._fs()
        for s in segments:
            fs.delete(path(f"{self.folder}/{s['name']}"), True)

    def _drop_unused(self, *manifests: dict) -> None:
        """Delete segments and manifests that none of the given ones (the last two) names.

        Folders of other builders are left alone: only what an older manifest names is deleted, and what a dead build left for a day.
        """
        path, fs = self._fs()
        keep, numbers = {s["name"] for m in manifests for s in m["segments"]}, {m["number"] for m in manifests}
        old: set[str] = set()
        for n in self._manifests():
            if n not in numbers and n < max(numbers):
                stream = fs.open(path(f"{self.folder}/manifests/{n}.json"))
                old |= {s["name"] if isinstance(s, dict) else f"s{s}" for s in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["segments"]}
                stream.close()
                fs.delete(path(f"{self.folder}/manifests/{n}.json"), False)
        yesterday = (time.time() - 86_400) * 1000
        for status in fs.listStatus(path(self.folder)):
            name = status.getPath().getName()
            if name != "manifests" and name not in keep and (name in old or status.getModificationTime() < yesterday):
                fs.delete(status.getPath(), True)

    def exists(self) -> bool:
        return bool(self._manifests())

    def _of(self, segments: list[dict], name: str) -> DataFrame:
        """A table's rows in ``segments``, with the place of their segment; none where no segment has the table."""
        parts = [(k, s) for k, s in enumerate(segments) if name in s["tables"]]
        rows = None
        for k, s in parts:
            part = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{s['name']}/{name}").withColumn("__at", F.lit(k))
            rows = part if rows is None else rows.unionByName(part)
        return rows if rows is not None else self.spark.createDataFrame([], f"{SCHEMAS[name]}, __at int")

    def _visible(self, segments: list[dict], name: str) -> DataFrame:
        """A table: rows whose path no later segment has replaced or removed."""
        rows = self._of(segments, name)
        if any("gone" in s["tables"] for s in segments[1:]):
            gone = self._of(segments, "gone").groupBy(F.col("relative_path").alias("__path")).agg(F.max("__at").alias("__gone"))
            rows = rows.join(gone, (F.col("relative_path") == F.col("__path")) & (F.col("__at") < F.col("__gone")), "left_anti")
        return rows.drop("__at")

    def _files(self, segments: list[dict]) -> DataFrame:
        return self._visible(segments, "files")

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table as the manifest shows it."""
        return self._visible((manifest or self.manifest())["segments"], name)

    # Building -----------------------------------------------------------------------------------

    def cancel(self) -> None:
        """Stop a build that is running: its Spark jobs, and what would come after them."""
        self._cancelled.set()
        self.spark.sparkContext.cancelJobGroup(self._group)

    def build(self, force: bool = False, mode: str = "keyword", rounds: int = 1, retain: bool = False) -> dict:
        """Bring the index up to date and return the number of files in each category.

        ``mode`` is keyword or vector. Changed files are extracted in ``rounds``, each a segment; a cancelled build keeps nothing,
        or with ``retain`` the rounds that were done, beside the earlier rows of the files that it did not reach.
        """
        self._cancelled.clear()
        context = self.spark.sparkContext
        context.setJobGroup(self._group, "index build", True)
        try:
            return self._build(force, mode, max(1, rounds), retain)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    def _build(self, force: bool, mode: str, rounds: int, retain: bool) -> dict:
        before = self.manifest()
        wanted = {"version": str(VERSION), "mode": mode, "engine": "codes" if mode == "vector" else before.get("engine"), "model": self.embedder.key if mode == "vector" and self.embedder else before.get("model")}
        if mode == "vector" and not self.embedder:
            raise SearchError("An embedder is required for an index with vectors.")
        if before.get("version") != str(VERSION):  # built anew from the files
            before = before | {"segments": [], "totals": {"chunks": 0, "terms": 0}}
        known = self.read("files", before)
        stage = f"{self.folder}/build-{uuid.uuid4().hex}"
        made: list[dict] = []
        try:
            # the folder is listed once for a build; every later step reads the list
            found = self._kept(source.discover(self.spark, self.root, self.rules, self.max_mb), f"{stage}/found")
            planned = ingest.plan(found, known if not force else known.withColumn("mtime", F.lit(-1.0)), int(self.max_mb * 1024 * 1024))
            return self._staged(stage, before, wanted, known, found, planned, force, mode, rounds, retain, made)
        except Exception:
            self._delete(made)
            raise
        finally:
            path, fs = self._fs()
            fs.delete(path(stage), True)

    def _staged(self, stage: str, before: dict, wanted: dict, known: DataFrame, found: DataFrame, planned: DataFrame, force: bool, mode: str, rounds: int, retain: bool, made: list[dict]) -> dict:
        planned = self._kept(planned, f"{stage}/plan")
        stats: dict = dict.fromkeys(("added", "updated", "removed", "unchanged", "excluded", "too_large", "failed"), 0)
        counted = {r[0]: r[1] for r in planned.groupBy("category").count().collect()}  # a row for each category
        stats |= {k: counted.get(k, 0) for k in ("removed", "unchanged", "excluded", "too_large")}
        drop_vectors = bool(before.get("model")) and wanted["model"] != before.get("model")
        if counted.get("added") or counted.get("changed"):
            todo = planned.where(F.col("category").isin("added", "changed")).select("relative_path")
            work = self._kept(found.join(todo, "relative_path", "left_semi"), f"{stage}/work")
            for nth in range(rounds):
                part = work if rounds == 1 else work.where(F.pmod(F.xxhash64("relative_path"), F.lit(rounds)) == nth)
                try:
                    done = self._kept(source.extracted(self.spark, part), f"{stage}/extracted{nth}")
                    if self._cancelled.is_set():
                        break
                    settled = self._kept(self._settled(planned.join(part.select("relative_path"), "relative_path", "left_semi"), done, known, force), f"{stage}/settled{nth}")
                    here = {r[0]: r[1] for r in settled.groupBy("category").count().collect()}
                    for name in ("added", "updated", "unchanged"):
                        stats[name] += here.get(name, 0)
                    stats["failed"] += done.where("status = 'failed'").count()
                    if any(here.get(name) for name in ("added", "updated", "unchanged")):
                        made.append(self._segment(f"{stage}/cut{nth}", before, settled, done, found, known, bool(here.get("unchanged"))))
                except Exception:
                    if self._cancelled.is_set():
                        break
                    raise
        cancelled = self._cancelled.is_set()
        if cancelled:
            stats["cancelled"] = True
            if not retain or not made:
                self._delete(made)
                return stats
        elif swept := self._sweep(planned, found, known):
            made.append(swept)
        manifest = before | wanted | {"segments": [*before["segments"], *made]}
        if drop_vectors and mode != "vector":
            manifest["model"] = None
        changed = bool(made)
        if mode == "vector" and not cancelled:
            changed = self._embed(manifest, drop_vectors, stats, made) or changed
        if not changed and answers.same_settings(before, manifest) and self.exists() and not force:
            return stats  # nothing is written, and the index keeps its number
        manifest["totals"] = self._totals(before, made) if manifest["segments"] == [*before["segments"], *made] else self._counted(manifest["segments"])
        put = self._commit(before, manifest)
        self._drop_unused(before, put)
        if len(put["segments"]) >= SEGMENTS:
            self._merge(put)
        return stats

    def _counted(self, segments: list[dict]) -> dict:
        row = self._files(segments).agg(F.sum("chunks"), F.sum("terms")).first()
        return {"chunks": row[0] or 0, "terms": row[1] or 0}

    def _kept(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def _settled(planned: DataFrame, done: DataFrame, known: DataFrame, force: bool) -> DataFrame:
        if force:
            return planned.withColumn("category", F.when(F.col("category") == "changed", "updated").otherwise(F.col("category")))
        return ingest.settled(planned, done.select("relative_path", "content_hash"), known)

    def _write(self, tables: dict[str, DataFrame], name: str | None = None, in_order: Sequence[str] = ()) -> dict:
        """Write a segment's tables, side by side, under a name of its own; those in ``in_order`` are sorted already."""
        name = name or f"s-{uuid.uuid4().hex}"

        def write(table: str, df: DataFrame) -> None:
            # postings are sorted by term and chunks by id within their files, so that terms and ids prune row groups
            # (a term that very many chunks hold is dealt to several files)
            by = {"postings": ["term", "chunk_id"], "chunks": ["chunk_id"]}.get(table)
            df = df.repartitionByRange(*by).sortWithinPartitions(by[0]) if by and table not in in_order else df
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{table}")

        with ThreadPoolExecutor(len(tables) or 1) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(write), *t) for t in tables.items()]:
                done.result()
        return {"name": name, "tables": sorted(tables)}

    def _segment(self, stage: str, before: dict, settled: DataFrame, done: DataFrame, found: DataFrame, known: DataFrame, carry: bool) -> dict:
        """Rows of the files that are new or changed; of files whose content is the known one only their size and time (``carry``)."""
        fresh = settled.where(F.col("category").isin("added", "updated")).select("relative_path")
        new = done.join(fresh, "relative_path", "left_semi") if carry else done
        texts = new.where("status = 'indexed'")
        same = settled.where("category = 'unchanged'").select("relative_path")
        of_same = lambda table: self.read(table, before).join(same, "relative_path", "left_semi")
        both = lambda df, table: df.unionByName(of_same(table)) if carry else df
        # texts are cut into chunks and terms once; what follows reads them where they are
        cut = self._kept(self._chunks(texts), stage)
        per_file = cut.groupBy("relative_path").agg(F.count("*").cast("int").alias("n"), F.sum("dl").alias("terms"))
        stat = found.select("relative_path", "size", "mtime")
        names = F.coalesce(F.col("structure.sheet_names"), F.array().cast("array<string>"))
        columns = F.coalesce(F.col("structure.column_hints"), F.array().cast("array<string>"))
        is_sheet = F.col("structure").isNotNull()
        hints = F.slice(F.flatten(F.transform("structure.sheets", lambda s: F.filter(F.array(F.concat(F.lit("Sheet: "), s["name"]), F.when(F.size(s["header_hints"]) > 0, F.concat(F.lit("Columns: "), F.array_join(F.slice(s["header_hints"], 1, 4), " | ")))), lambda x: x.isNotNull()))), 1, 6)
        note = answers.header_note(F.col("relative_path"), F.col("structure.sheet_count"), F.col("structure.row_count"), names, columns)
        shown = texts.select(
            "relative_path", "parser", "content_hash", tx.token_estimate(F.col("text")).alias("token_estimate"),
            F.when(is_sheet, note).otherwise(tx.summary(F.col("text"), 420)).alias("summary"), F.when(is_sheet, hints).otherwise(tx.section_hints(F.col("text"))).alias("section_hints"),
            "structure", F.slice("assets", 1, DOCUMENT_ASSETS).alias("assets"),
        )
        # joined without texts
        documents = shown.join(stat, "relative_path").join(per_file, "relative_path", "left").withColumn("chunks", F.coalesce("n", F.lit(0))).select(*T._parse_datatype_string(SCHEMAS["documents"]).fieldNames())
        own = new.drop("chunks").join(stat, "relative_path").join(per_file, "relative_path", "left").select("relative_path", "status", "size", "mtime", "parser", F.coalesce("n", F.lit(0)).alias("chunks"), F.coalesce("terms", F.lit(0)).alias("terms"), "content_hash", "error_reason")
        touched = ingest.refreshed(known.join(same, "relative_path", "left_semi"), stat, "relative_path", "size", "mtime")
        blocks = self._kept(self._blocks(cut), f"{stage}-blocks")
        if carry:
            blocks = blocks.unionByName(of_same("postings").select("term", F.array(F.struct("chunk_id", "relative_path", "tf", "dl")).alias("rows")))
        # blocks are sorted, not postings; a term that very many chunks hold is dealt to several files
        sorted_blocks = blocks.repartitionByRange("term", F.col("rows")[0]["chunk_id"]).sortWithinPartitions("term")
        postings = sorted_blocks.select("term", F.explode("rows").alias("r")).select("term", "r.*")
        tables = {
            "chunks": both(cut.drop("words"), "chunks"),
            "files": own.unionByName(touched) if carry else own, "documents": both(documents, "documents"), "postings": postings,
            "gone": settled.where(F.col("category").isin("added", "updated", "unchanged")).select("relative_path"),
        }
        if carry and any("vectors" in s["tables"] for s in before["segments"]):
            tables["vectors"] = of_same("vectors")
        return self._write(tables, in_order=("postings",))

    @staticmethod
    def _blocks(cut: DataFrame) -> DataFrame:
        """The postings of chunks, by term within some megabytes of text."""
        schema = T._parse_datatype_string(BLOCKS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            held, size = [], 0
            for batch in batches:
                # a batch may be large itself, so it is taken in parts
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    held.append(part)
                    size += pc.sum(pc.binary_length(part.column(3))).as_py() or 0
                    if size >= 4 * source.BATCH:
                        yield _inverted(pa.Table.from_batches(held), arrow)
                        held, size = [], 0
            if size:
                yield _inverted(pa.Table.from_batches(held), arrow)

        return cut.select("chunk_id", "relative_path", "dl", "words").mapInArrow(run, schema)

    @staticmethod
    def _chunks(texts: DataFrame) -> DataFrame:
        """A document's chunks: those that its format gives, else its text in windows; each with the visual assets whose anchor it holds, and
        its terms. One pass, no shuffle."""
        schema = T._parse_datatype_string(CUT)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            for batch in batches:
                at = 0
                while at < batch.num_rows:  # a few texts at a time
                    part, size = [], 0
                    while at < batch.num_rows and size < source.BATCH:
                        part.append([batch.column(c)[at].as_py() for c in range(4)])
                        size += len(part[-1][1])
                        at += 1
                    yield _cut(part, arrow)

        return texts.select("relative_path", "text", "chunks", "assets").mapInArrow(run, schema)

    def _sweep(self, planned: DataFrame, found: DataFrame, known: DataFrame) -> dict | None:
        """A segment for files that went, and for the list of those that a rule skips; None where neither changed."""
        removed = planned.where(F.col("category").isin("removed", "excluded", "too_large")).select("relative_path").join(known, "relative_path", "left_semi")
        skipped = found.where(F.col("reason").isNotNull()).select("relative_path", F.lit("skipped").alias("status"), "size", "mtime", F.lit(None).cast("string").alias("parser"), F.lit(0).alias("chunks"), F.lit(0).cast("long").alias("terms"), F.lit(None).cast("string").alias("content_hash"), F.col("reason").alias("error_reason"))
        listed = known.where("status = 'skipped'")
        columns = ["relative_path", "error_reason", "size"]
        new = skipped.join(listed.select(*columns), columns, "left_anti")
        gone = removed.join(skipped.join(new, "relative_path", "left_anti"), "relative_path", "left_anti").union(new.select("relative_path")).distinct()
        if gone.isEmpty():
            return None
        return self._write({"files": new, "gone": gone})

    def _embed(self, manifest: dict, drop: bool, stats: dict, made: list[dict]) -> bool:
        """Vectors for the chunks that have none: those of equal chunks are taken over, each other text is embedded once.

        Vectors of another model are dropped, chunks stay. If the embedder fails, the build goes on without vectors, once with a warning.
        """
        chunks = self.read("chunks", manifest).select("chunk_id", "relative_path", "chunk_hash", "text")
        old = self.read("vectors", manifest)
        old = old.limit(0) if drop else old
        lacking = chunks.join(old.select("chunk_id"), "chunk_id", "left_anti")
        if lacking.isEmpty():
            return drop
        name = f"s-{uuid.uuid4().hex}"
        best = old.groupBy("chunk_hash").agg(F.min_by(F.struct("dim", "scale", "codes"), "chunk_id").alias("v"))
        texts = lacking.groupBy("chunk_hash").agg(F.first("text").alias("text")).join(best.select("chunk_hash"), "chunk_hash", "left_anti")
        embed, size = self.embedder.embed, self.embedder.batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    got = [[float(x) for x in v] for v in embed(part.column(1).to_pylist())]
                    if len(got) != part.num_rows:
                        raise ValueError("The embedder returned an unexpected number of vectors.")
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.float64()))], names=["chunk_hash", "vector"])

        try:
            embedded = self._kept(texts.mapInArrow(run, "chunk_hash string, vector array<double>"), f"{self.folder}/{name}/embedded")
            sizes = [r[0] for r in embedded.select(F.size("vector").alias("n")).union(old.select(F.col("dim").alias("n"))).distinct().limit(3).collect()]
            if len(sizes) > 1:
                raise ValueError(f"Vectors of {' and '.join(map(str, sorted(sizes)))} dimensions; rebuild required.")
        except Exception as e:
            if self._cancelled.is_set():
                raise
            self._delete([{"name": name}])
            manifest["mode"] = "keyword"
            stats["warning"] = str(e).strip().splitlines()[-1][:300]
            return False
        fresh = embedded.select("chunk_hash", F.struct(F.size("vector").alias("dim"), vx.scale(F.col("vector")).alias("scale"), vx.codes(F.col("vector")).alias("codes")).alias("v"))
        rows = lacking.select("chunk_id", "relative_path", "chunk_hash").join(best.unionByName(fresh), "chunk_hash").select("chunk_id", "relative_path", "chunk_hash", "v.*")
        if drop:  # all tables once more, without the old model's vectors
            tables = {n: self.read(n, manifest) for n in SCHEMAS if n not in ("vectors", "gone")}
            made.append(self._write(tables | {"vectors": rows}, name))
            manifest["segments"] = [made[-1]]
        else:
            made.append(self._write({"vectors": rows}, name))
            manifest["segments"].append(made[-1])
        manifest["dim"] = sizes[0] if sizes else None
        return True

    def _merge(self, manifest: dict) -> None:
        """Put all segments into one, as a manifest of its own; if another builder comes first, the segments stay as they are."""
        held = {n for s in manifest["segments"] for n in s["tables"]} - {"gone"}
        merged = self._write({n: self.read(n, manifest) for n in SCHEMAS if n in held})
        after = manifest | {"segments": [merged], "number": manifest["number"] + 1}
        if self._put(after):
            self._drop_unused(manifest, after)
        else:
            self._delete([merged])

    # Reading ------------------------------------------------------------------------------------

    def files(self, status: str | None = None) -> DataFrame:
        df = self.read("files")
        return (df.where(F.col("status") == status) if status else df).orderBy(F.lower("relative_path"))

    def documents(self) -> DataFrame:
        return self.read("documents").orderBy(F.lower("relative_path"))

    def status(self) -> dict:
        m = self.manifest()
        row = self.read("files", m).agg(F.count("*"), F.count_if(F.col("status") == "indexed"), F.count_if(F.col("status") == "failed"), F.sum("chunks")).first()
        return {"version": VERSION, "number": m["number"], "mode": m["mode"], "model": m["model"], "files": row[0], "indexed": row[1], "failed": row[2], "chunks": row[3] or 0}

    def import_legacy(self, folder: str) -> dict:
        """Take over an index of an older JSON format: its files, documents, chunks and vectors, so that nothing is extracted or embedded again."""
        tables, settings = legacy_tables(self.spark, folder)
        lengths = F.size(tx.index_terms(F.col("text"))).alias("dl")
        tables["chunks"] = tables["chunks"].select("*", lengths)
        named = lambda n, without=(): [f for f in T._parse_datatype_string(SCHEMAS[n]).fieldNames() if f not in without]
        tables = {n: df.toDF(*named(n, ("terms",))) for n, df in tables.items()}
        chunks = tables["chunks"]
        per_file = chunks.groupBy("relative_path").agg(F.sum("dl").alias("terms"))
        tables["files"] = tables["files"].join(per_file, "relative_path", "left").withColumn("terms", F.coalesce("terms", F.lit(0))).select(*named("files"))
        tables["postings"] = search.postings(chunks).join(chunks.select("chunk_id", "relative_path"), "chunk_id").select("term", "chunk_id", "relative_path", "tf", "dl")
        before, made = self.manifest(), [self._write(tables)]
        manifest = self._commit(before, before | settings | {"version": str(VERSION), "segments": made, "totals": self._counted(made)})
        self._drop_unused(before, manifest)
        return manifest

    def visual_assets(self, document_ids: list[str] | None = None, most: int | None = None) -> DataFrame:
        """The visual assets of the documents, opened: their bytes, formats, sizes and hashes (see ``assets.resolve``)."""
        documents = self.read("documents")
        documents = documents.where(F.col("relative_path").isin(*document_ids)) if document_ids else documents
        listed = documents.select("relative_path", F.posexplode("assets").alias("at", "a")).select("a.kind", "relative_path", "a.page", "a.media")
        return visuals.resolve(self.spark, self.root, listed, most)

    def missing_documents(self) -> DataFrame:
        return ingest.missing(self.read("files"), self.read("documents"), "relative_path")

    def missing_vectors(self) -> DataFrame:
        return ingest.without_vectors(self.read("chunks"), self.read("vectors"))

    def statistics(self, manifest: dict | None = None) -> DataFrame:
        """One row, from the manifest: number of chunks and their mean length in terms."""
        totals = (manifest or self.manifest())["totals"]
        mean = totals["terms"] / totals["chunks"] if totals["chunks"] else None
        return self.spark.range(1).select(F.lit(totals["chunks"]).alias("n_chunks"), F.lit(mean).cast("double").alias("avgdl"))

    def search(self, query: str, k: int | None = 8, document_ids: list[str] | None = None, mode: str = "keyword") -> DataFrame:
        """The best ``k`` chunks (None: all that match): by keywords with path and visual bonus, or by the cosine of their vectors.

        Ranking reads postings, paths and sizes alone; only the winners' texts are read.
        """
        m = self.manifest()
        if mode == "vector":
            return self._vector_search(m, query, k)
        only = self.spark.createDataFrame([(d,) for d in document_ids], "relative_path string") if document_ids else None
        best = search.ranked(self.read("chunks", m), self.read("postings", m), self.statistics(m), query, k, only, self._files(m["segments"]))
        return self._fetched(m, best, k)

    def _fetched(self, m: dict, best: DataFrame, k: int | None) -> DataFrame:
        """Ranked chunks (chunk_id, score) with their path and text: few of them by their ids, which prune row groups, more by a join."""
        chunks = self.read("chunks", m)
        if k is not None and k <= FETCHED:
            rows = best.collect()  # k rows
            best = self.spark.createDataFrame(rows, best.schema)
            chunks = chunks.where(F.col("chunk_id").isin([r.chunk_id for r in rows]))
        return chunks.join(best, "chunk_id").select("chunk_id", "relative_path", "score", tx.snippet(F.col("text")).alias("snippet"), "text").orderBy(F.desc("score"), "chunk_id")

    def _vector_search(self, m: dict, query: str, k: int) -> DataFrame:
        if m["mode"] != "vector":
            raise SearchError("Semantic search is not available for this index yet; sync to finish embedding.")
        if not self.embedder:
            raise SearchError("An embedder is required for semantic search.")
        if m["model"] and m["model"] != self.embedder.key:
            names = self.spark.range(1).select(answers.model_label(F.lit(m["model"])), answers.model_label(F.lit(self.embedder.key))).first()
            raise SearchError(f"Index was built with {names[0]} but search uses {names[1]}; rebuild required.")
        (vector,) = self.embedder.embed([query])
        if m["dim"] and len(vector) != m["dim"]:
            raise SearchError(f"The query has {len(vector)} dimensions but the index has {m['dim']}; rebuild required.")
        return self._fetched(m, search.code_top(self.read("vectors", m), vector, k), k)

    def search_or_keywords(self, query: str, k: int = 8, document_ids: list[str] | None = None) -> tuple[list, str | None]:
        """Rows of a semantic search, or if that fails of a keyword search, of the whole index where the documents have none; and why it failed."""
        reason = None
        try:
            return self.search(query, k, mode="vector").collect(), None
        except Exception as e:
            reason = str(e).splitlines()[0][:300]
        rows = self.search(query, k, document_ids).collect()  # k rows
        return rows or self.search(query, k).collect(), reason

    def rows_matching(self, query: str, document_ids: list[str]) -> DataFrame:
        """Every matching row chunk of the given spreadsheets, sorted in parallel; nothing is cut off."""
        return self.search(query, None, document_ids)
