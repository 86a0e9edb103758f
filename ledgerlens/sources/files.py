"""File sources and sinks: audit records, manifests, nested JSON, binary hashes, reports, change cursors."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from functools import reduce
from itertools import islice
from urllib.parse import quote, unquote, urlparse

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.extract import confirmed_codes
from ledgerlens.operators.blocks import first_per_key
from ledgerlens.session import cut, spread

# Field names of the audit records and manifests.
AUDIT = (
    "created_at string, message_created_at string, message_id long, file_unique_id string, media_group_id string, image_file string, "
    "source struct<chat_id: long, chat_title: string, user_id: long, username: string>, raw_text string, "
    "raw_cards array<string>, raw_short_cards array<string>, raw_psn_cards array<string>, final_cards array<string>, final_short_cards array<string>, "
    "final_psn_cards array<string>, uncertain_count int, batch_id string, sequence_index int, status string, error string"
)
CASE = (
    "struct<case_id: string, name: string, profile: string, status: string, error_types: array<string>, image: string, image_hash: string, image_sha256: string, "
    "expected_long: array<string>, expected_short: array<string>, expected_pubg: array<string>, expected_psn: array<string>>"
)
MANIFEST = f"profile string, cases array<{CASE}>"
#: A file up to this size may be one document over many lines; larger ones hold a record a line.
DOCUMENT_BYTES = 64 << 20
_BROKEN = "_broken"


def json_documents(
    spark: SparkSession, path: str | list[str], schema: str, recursive: bool = False, document_bytes: int = DOCUMENT_BYTES, texts: DataFrame | None = None
) -> DataFrame:
    """JSON objects of many files: ``record_path``, ``pos`` in the file, ``record`` by the schema, and ``problem``.

    A file holds one document, on one line or indented over many, or a record on each line. Whatever cannot be read is
    a row without a record that names the problem and carries the text in ``rejected``: a whole file none of whose lines
    is an object, single lines among good ones, and objects with a field of another type than the schema's. Blank files
    have no rows. Partition columns pass through. ``texts`` are the whole files where they have been listed already.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    size, at = F.col("_metadata.file_size"), F.col("_metadata.file_path").alias("record_path")
    whole = (reader.text(path, wholetext=True) if texts is None else texts).where(size <= document_bytes).select("*", at)
    large = reader.text(path).where(size > document_bytes).where(F.trim("value") != "")
    return _documents(whole, schema, large.select("*", at, F.monotonically_increasing_id().alias("pos")))


def _documents(whole: DataFrame, schema: str, large: DataFrame | None = None) -> DataFrame:
    """``json_documents`` of files read whole (``record_path``, ``value``) and of the lines of large ones (with ``pos``)."""
    kind = f"{schema}, {_BROKEN} string"

    def is_object(text):
        # The typed reader takes a text that ends early for a whole one; the variant reader does not.
        return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))

    def parsed(text):
        return F.from_json(text, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})

    record_type = whole.sparkSession.range(0).select(parsed(F.lit("{}")).alias("r")).schema["r"].dataType
    none = F.lit(None).cast(record_type)

    def entry(record, problem, text):
        return F.struct(record.alias("record"), problem.cast("string").alias("problem"), text.cast("string").alias("rejected"))

    def typed(text):
        found = F.transform(F.array(parsed(text)), lambda r: F.when(r[_BROKEN].isNull(), entry(r, F.lit(None), F.lit(None))))
        return F.coalesce(F.get(found, F.lit(0)), entry(none, F.lit("field of another type"), text))

    def of_line(line):
        return F.when(is_object(line), typed(line)).otherwise(entry(none, F.lit("unreadable line"), line))

    lines = F.filter(F.split(F.regexp_replace("value", "^\ufeff", ""), "\r?\n"), lambda x: F.trim(x) != "")
    whole = whole.withColumn("__lines", lines).where(F.size("__lines") > 0).withColumn("__text", F.array_join("__lines", "\n"))
    each = F.transform("__lines", of_line)
    # A first line that is an object by itself opens a file of lines; a parser would stop after it.
    rows = (
        F.when(is_object(F.get("__lines", F.lit(0))), each).when(is_object(F.col("__text")), F.array(typed(F.col("__text"))))
        .when(F.exists("__lines", is_object), each).otherwise(F.array(entry(none, F.lit("unreadable document"), F.col("__text"))))
    )
    parts = [c for c in whole.columns if c not in ("value", "record_path", "__lines", "__text")]
    found = whole.select(*parts, "record_path", F.posexplode(rows).alias("pos", "__x")).withColumn("pos", F.col("pos").cast("long"))
    if large is not None:
        found = found.unionByName(large.select(*parts, "record_path", "pos", of_line(F.col("value")).alias("__x")))
    return found.select(*parts, "record_path", "pos", F.col("__x.record").dropFields(_BROKEN).alias("record"), "__x.problem", "__x.rejected")


def rejected(documents: DataFrame) -> DataFrame:
    """The side output of ``json_documents``: where, what, and the text."""
    return documents.where("problem IS NOT NULL").select("record_path", "pos", "problem", "rejected")


def reject_counts(documents: DataFrame) -> DataFrame:
    return rejected(documents).groupBy("problem").agg(F.count(F.lit(1)).alias("rejects"))


def mounted(spark: SparkSession, path: str) -> str | None:
    """Where a path lies on a mounted disk, which Python reaches too; None in any other store."""
    scheme, host, place = re.fullmatch(r"(?:([A-Za-z][\w+.-]*):)?(?://([^/]*))?(.*)", path, re.S).groups()
    store = scheme or spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").split(":")[0]
    return os.path.normpath("/" + place.strip("/")) if store == "file" and not host and place.startswith("/") else None


def _entries(folder: str):
    """Paths in a mounted folder with their length, None for folders, without the hidden ones of Spark's readers."""
    with os.scandir(folder) as entries:
        for entry in entries:
            name = entry.name
            if (name.startswith((".", "_")) or name.endswith("._COPYING_")) and not (name.startswith("_") and "=" in name):
                continue
            try:
                yield entry.path, None if entry.is_dir() else entry.stat().st_size
            except FileNotFoundError:  # a link to nothing
                continue


def _walk(folder: str):
    """``_entries`` at any depth."""
    for path, length in _entries(folder):
        yield path, length
        if length is None:
            yield from _walk(path)


def _url(path: str) -> str:
    """A mounted path as Spark names it."""
    return "file:" + re.sub(r'["#%<>?\[\\\]^`{|}\s\x00-\x1f\x7f-\x9f\udc80-\udcff]', lambda c: quote(c[0], safe="", errors="surrogateescape"), path)


def _place(url: str) -> str:
    return unquote(urlparse(url).path, errors="surrogateescape")


#: Folders a task lists.
TASK_FOLDERS = 1 << 8


def list_files(spark: SparkSession, folder: str, keep: Column) -> DataFrame:
    """Files below a mounted folder, ``record_path`` and ``length``, listed in tasks, one level of folders after the other.

    ``keep`` is a condition on ``record_path`` that no file below a folder meets unless the folder does. Neither the
    driver nor a task ever holds the list.
    """

    def opened(batches):
        import pyarrow as pa

        for batch in batches:
            for at in batch.column(0).to_pylist():
                entries = _entries(_place(at))
                while some := list(islice(entries, 1 << 13)):
                    paths, lengths = pa.array([_url(p) for p, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())
                    yield pa.RecordBatch.from_arrays([paths, lengths], names=["record_path", "length"])

    level, found = spark.createDataFrame([(_url(folder),)], "record_path string"), []
    while not level.isEmpty():
        entries = cut(spread(level, TASK_FOLDERS).mapInArrow(opened, "record_path string, length long").where(keep))
        found.append(entries.where("length IS NOT NULL"))
        level = entries.where("length IS NULL").select("record_path")
    return reduce(DataFrame.unionByName, found)


#: Files and bytes a task reads whole, about, and bytes that leave it at once.
READ_FILES, READ_BYTES, READ_BATCH = 1 << 12, 128 << 20, 8 << 20


def read_files(files: DataFrame) -> DataFrame:
    """Mounted files ``record_path``, ``length`` with their whole content as text ``value``, read in tasks that are dealt evenly."""
    found = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-found["files"] // READ_FILES), -(-found["bytes"] // READ_BYTES))

    def read(batches):
        import pyarrow as pa

        def together(names, bodies):
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["record_path", "value"])

        for batch in batches:
            names, bodies, held = [], [], 0
            for name in batch.column(0).to_pylist():
                with open(_place(name), "rb") as handle:
                    bodies.append(handle.read())
                names.append(name)
                held += len(bodies[-1])
                if held >= READ_BATCH:
                    yield together(names, bodies)
                    names, bodies, held = [], [], 0
            yield together(names, bodies)

    contents = files.select("record_path").repartition(tasks).mapInArrow(read, "record_path string, value binary")
    return contents.withColumn("value", F.col("value").cast("string"))


#: Characters that Spark's readers expand in a path, and names of files they unpack.
_GLOB, _PACKED = re.compile(r"[{}\[\]*?\\]"), r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd|xz)$"
#: Entries of a mounted folder up to which Spark's reader lists it, which takes about 2 KB of the driver's memory a file.
LISTED = 1 << 14


def audit_documents(spark: SparkSession, root: str, day: str | None = None, listed: int = LISTED, document_bytes: int = DOCUMENT_BYTES) -> DataFrame:
    """All audit files below ``root``, in directories ``dt=<day>`` or ``<day>/<record>``, with ``dt``.

    The driver lists a mounted folder of up to ``listed`` entries; a larger one is listed and read in tasks, of it only
    what lies in ``day``, and other partition columns than ``dt`` stay in ``record_path``. Folders of other stores are
    always listed by Spark's reader.
    """
    dated = r"/(\d{4}-\d{2}-\d{2})/"
    tree = mounted(spark, root)
    if tree and os.path.isdir(tree) and not _GLOB.search(root) and not os.path.exists(f"{tree}/_spark_metadata"):
        if sum(1 for _ in islice(_walk(tree), listed + 1)) > listed:
            first = next((path for path, length in _walk(tree) if length is not None), tree)
            if "/dt=" in os.path.dirname(first[len(tree):]):
                dated = f"^{re.escape(_url(tree))}/(?:.*?/)?dt=([^/]*)/"
            return _audit_in_tasks(spark, tree, dated, day, document_bytes)
    texts = spark.read.text(root, wholetext=True)
    if "dt" in texts.columns:
        return json_documents(spark, root, AUDIT, document_bytes=document_bytes, texts=texts)
    found = F.regexp_extract("record_path", dated, 1)
    return json_documents(spark, root, AUDIT, recursive=True, document_bytes=document_bytes).withColumn("dt", F.try_to_date(F.nullif(found, F.lit(""))))


def _audit_in_tasks(spark: SparkSession, tree: str, dated: str, day: str | None, document_bytes: int) -> DataFrame:
    """``audit_documents`` of a mounted folder, the days by a pattern; large and packed files are left to Spark's reader, which lists them."""

    def found(path):
        return F.regexp_extract(path, dated, 1)

    dt = F.try_to_date(F.nullif(found("record_path"), F.lit("")))
    if day is None:
        files = list_files(spark, tree, F.lit(True))
    else:
        above = found(F.concat("record_path", F.lit("/")))
        asked = F.lit(day).cast("date")
        files = list_files(spark, tree, (above == "") | (F.try_to_date(F.nullif(above, F.lit(""))) == asked)).where(dt == asked)
    others = (F.col("length") > document_bytes) | F.col("record_path").rlike(_PACKED)
    documents = _documents(read_files(files.where(~others)), AUDIT)
    left = ["file:" + _GLOB.sub(r"\\\g<0>", _place(r["record_path"])) for r in files.where(others).select("record_path").collect()]
    if left:
        documents = documents.unionByName(json_documents(spark, left, AUDIT, document_bytes=document_bytes))
    return documents.withColumn("dt", dt)


def read_audit(spark: SparkSession, root: str, day: str | None = None) -> DataFrame:
    """Audit records, one document a file or one record a line; unreadable ones are skipped (see ``rejected``).

    Only the partition of the asked day is read. Short codes are found under both of their names.
    """
    rows = audit_documents(spark, root, day)
    if day is not None:
        rows = rows.where(F.col("dt") == F.lit(day).cast("date"))
    rows = rows.where("problem IS NULL").select("record.*", "dt", "record_path")
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "chat_id": F.coalesce("source.chat_id", F.lit(0)), "chat_title": F.coalesce("source.chat_title", F.lit("")),
        "user_id": F.coalesce("source.user_id", F.lit(0)), "username": F.coalesce("source.username", F.lit("")),
        "final_long": F.coalesce("final_cards", none), "final_short": F.coalesce("final_short_cards", "final_psn_cards", none),
    })


def write_audit(records: DataFrame, root: str, mode: str = "append") -> None:
    """Audit records as JSON, one directory per local day."""
    records.write.mode(mode).partitionBy("dt").json(root)


#: Files a task writes, in a folder of its own.
TASK_FILES = 1 << 10


def write_each(records: DataFrame, key: str, parts: list[str], root: str, task_files: int = TASK_FILES) -> None:
    """Texts ``value`` as one file a key, those of a repeated key after one another, in directories of ``parts``.

    Each task fills a folder of its own, which the commit moves as one. A directory a file would cost the commit a move
    and the next reader a partition value for each. On a mounted disk Python writes the files; Spark's writer would start
    other programs to set the mode of each.
    """
    cores = records.sparkSession.sparkContext.defaultParallelism
    texts = records.groupBy(*parts, key).agg(F.array_join(F.collect_list("value"), "\n").alias("value"))
    dealt = texts.repartition(max(cores, -(-records.count() // task_files)), key)
    place = mounted(records.sparkSession, root)
    if place is None:
        placed = dealt.select("value", *parts, F.spark_partition_id().alias("folder"))
        placed.write.partitionBy(*parts, "folder").option("maxRecordsPerFile", 1).text(root)
        return
    os.makedirs(place)
    stage = f"{place}/_temporary-{uuid.uuid4().hex}"

    def fill(batches):
        import pyarrow as pa

        task, files = TaskContext.get(), {}
        own = f"{stage}/{task.taskAttemptId()}"
        for batch in batches:
            bodies, *values = (c.to_pylist() for c in batch.columns)
            for body, *within in zip(bodies, *values, strict=True):
                folder = "/".join([_folder_name(p, v) for p, v in zip(parts, within, strict=True)] + [f"folder={task.partitionId()}"])
                if folder not in files:
                    os.makedirs(f"{own}/{folder}")
                files[folder] = files.get(folder, 0) + 1
                with open(f"{own}/{folder}/part-{files[folder]:05d}.txt", "wb") as handle:
                    handle.write(body + b"\n")
        yield pa.RecordBatch.from_arrays([pa.array([own] * len(files), pa.string()), pa.array(list(files), pa.string())], names=["attempt", "folder"])

    try:
        bodies = dealt.select(F.col("value").cast("binary"), *[F.col(p).cast("string") for p in parts])
        for done in bodies.mapInArrow(fill, "attempt string, folder string").collect():  # of attempts that Spark accepted
            os.makedirs(os.path.dirname(f"{place}/{done['folder']}"), exist_ok=True)
            os.rename(f"{done['attempt']}/{done['folder']}", f"{place}/{done['folder']}")
        open(f"{place}/_SUCCESS", "wb").close()
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def _folder_name(column: str, value: str | None) -> str:
    """A partition directory as Spark's writer names it."""
    column, value = (re.sub(r'[\x01-\x1f"#%\'*/:=?\\\x7f{\[\]^]', lambda c: f"%{ord(c[0]):02X}", x or "") for x in (column, value))
    return f"{column}={value or '__HIVE_DEFAULT_PARTITION__'}"


def manifest_documents(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark, path, MANIFEST)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Cases of many manifest files, indented or not, one row per case with its file and its place there.

    Unreadable files are skipped (see ``rejected`` of ``manifest_documents``); hashes and expected codes are found under
    both of their names.
    """
    rows = manifest_documents(spark, path).where("problem IS NULL")
    flat = rows.select("record_path", "pos", F.col("record.profile").alias("file_profile"), F.posexplode("record.cases").alias("place", "c"))
    both = {"image_hash": ("c.image_hash", "c.image_sha256"), "expected_long": ("c.expected_long", "c.expected_pubg"), "expected_short": ("c.expected_short", "c.expected_psn")}
    return flat.select(
        F.coalesce("c.profile", "file_profile").alias("profile"), *[f"c.{n}" for n in ("case_id", "name", "status", "error_types", "image")],
        *[F.coalesce(*names).alias(n) for n, names in both.items()], "record_path", "pos", "place",
    )


def require_cases(cases: DataFrame) -> DataFrame:
    """A benchmark without cases is an error."""
    if cases.isEmpty():
        raise ValueError("a benchmark needs at least one case")
    return cases


def first_filled(sources: list[DataFrame]) -> DataFrame:
    """Rows of the first source that has any, in the given order."""
    ranked = None
    for rank, rows in enumerate(sources):
        tagged = rows.withColumn("__rank", F.lit(rank))
        ranked = tagged if ranked is None else ranked.unionByName(tagged)
    best = ranked.agg(F.min("__rank").alias("__rank"))
    return ranked.join(F.broadcast(best), "__rank").drop("__rank")


# The keys whose strings are read, the keys that are gone into, and the font of strings without one.
LEAF_KEYS = ("card", "best_candidate", "ocr_result", "value")
NESTED_KEYS = ("cards", "ocr_cards", "candidate_list", "results")
UNKNOWN_FONT = "unknown_font"


#: Levels of nesting walked before the rows are written.
LEVELS = 8


def nested_codes(records: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Codes anywhere in nested JSON: ``records(record_id, body)`` to one row per code, first sighting first.

    Only the known keys count, at any depth, in objects, lists and lists of lists, from any kind of root. Strings under
    a leaf key bear the font of their own object, other strings none. The walk goes down ``levels`` levels of all records
    in one pass over the rows, until nothing is left to go into; a path of places keeps the order of the text.
    Bodies that are no JSON give no rows.
    """
    none = F.lit(None).cast("string")
    parsed = records.select("record_id", F.try_parse_json("body").alias("value")).where("value IS NOT NULL")
    text = _text(F.col("value"))
    level = parsed.select(
        "record_id", F.array().cast("array<int>").alias("path"), F.lit(UNKNOWN_FONT).alias("font_hash"), none.alias("font_template"),
        text.alias("text"), F.when(text.isNull(), F.col("value")).alias("v"),
    )
    found = []
    while True:
        for _ in range(levels):
            level = _deeper(level)
        codes = F.when(F.col("text").isNotNull(), confirmed_codes(F.col("text")))
        rows = level.select("record_id", "path", "font_hash", "font_template", codes.alias("codes"), "v")
        rows = cut(rows.where((F.size("codes") > 0) | F.col("v").isNotNull()))
        found.append(rows.where("v IS NULL").select("record_id", "path", "font_hash", "font_template", F.posexplode("codes").alias("nth", "code")))
        level = rows.where("v IS NOT NULL").select("record_id", "path", "font_hash", "font_template", none.alias("text"), "v")
        if level.isEmpty():
            break
    # One exchange serves both windows.
    firsts = first_per_key(reduce(DataFrame.unionByName, found).repartition("record_id"), ["record_id", "code"], ["path", "nth"])
    pos = F.row_number().over(Window.partitionBy("record_id").orderBy("path", "nth")) - 1
    return firsts.select("record_id", "font_hash", "font_template", pos.alias("pos"), "code")


def _deeper(rows: DataFrame) -> DataFrame:
    """Texts as they are; of lists every element, and of objects the values of the known keys."""
    opened = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    place = F.when(F.col("key").isNull(), F.col("pos"))
    for at, key in enumerate(LEAF_KEYS + NESTED_KEYS):
        place = place.when(F.col("key") == key, at)
    known = opened.where(F.col("text").isNotNull() | (F.col("value").isNotNull() & place.isNotNull()))
    leaf = F.coalesce(F.col("key").isin(*LEAF_KEYS), F.lit(False))
    template = _text(F.try_variant_get("v", "$.font_template", "variant"))
    down = known.select(
        "record_id", F.when(F.col("value").isNull(), F.col("path")).otherwise(F.concat("path", F.array(place.cast("int")))).alias("path"),
        F.when(leaf, F.coalesce(_truthy("v", "$.font_hash"), F.lit(UNKNOWN_FONT))).otherwise(F.col("font_hash")).alias("font_hash"),
        F.when(leaf, template).otherwise(F.col("font_template")).alias("font_template"),
        F.coalesce("text", _text(F.col("value"))).alias("text"), F.when(~leaf, F.col("value")).alias("v"),
    )
    down = down.withColumn("v", F.when(F.col("text").isNull(), F.col("v")))
    return down.where("text IS NOT NULL OR v IS NOT NULL")


def _text(column: Column):
    """A JSON string as text; null for anything else."""
    return F.when(F.schema_of_variant(column) == "STRING", F.try_variant_get(column, "$", "string"))


def _truthy(column: str, path: str):
    """A scalar as text; null where it is missing, empty, zero or false."""
    value = F.try_variant_get(column, path, "string")
    return F.when(~value.isin("", "0", "false"), value)


#: Bytes hashed at a time.
PIECE = 1 << 20


def hash_files(spark: SparkSession, path: str, pattern: str = "*", piece: int = PIECE) -> DataFrame:
    """Content hash of every file below a path; the bytes never leave the reading task.

    Files of mounted folders stream through the hash in pieces, however large they are. Files of other stores come
    through Spark's reader, which takes up to 2 GB a file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    # A condition on the metadata leaves files out of the listing; one on ``path`` would meet them after their bytes were read.
    mounted = F.col("_metadata.file_path").startswith("file:")
    there = files.where(~mounted).select("path", "length", F.sha2("content", 256).alias("content_hash"))

    def stream(batches):
        import hashlib
        from urllib.parse import unquote, urlparse

        import pyarrow as pa

        for batch in batches:
            hashes = []
            for name in batch.column(0).to_pylist():
                state = hashlib.sha256()
                with open(unquote(urlparse(name).path), "rb") as handle:
                    while part := handle.read(piece):
                        state.update(part)
                hashes.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())], names=["path", "length", "content_hash"])

    here = files.where(mounted).select("path", "length").mapInArrow(stream, "path string, length long, content_hash string")
    return here.unionByName(there)


def write_json(rows: DataFrame, path: str) -> None:
    """Report rows as JSON; the commit replaces the folder as a whole."""
    rows.write.mode("overwrite").json(path)


def write_training(split: DataFrame, path: str) -> None:
    """Labels as ``path<TAB>label``, metadata and the annotation queue from one split."""
    labels = split.where("target = 'label'")
    named = labels.select(F.concat(F.lit("images/"), "content_hash", F.lit(".png")).alias("file"), "label")
    named.write.mode("overwrite").option("sep", "\t").csv(f"{path}/labels")
    labels.select("case_id", "content_hash", "profile", "label").write.mode("overwrite").json(f"{path}/metadata")
    split.where("target = 'annotate'").select("case_id", "content_hash", "profile", "reason").write.mode("overwrite").json(f"{path}/annotate")
