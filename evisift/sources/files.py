"""Folders of files as a documents table.

Plain text and markdown are decoded here. Texts of other formats come from outside as
an ``extractions`` table, possibly several per file, of which the best one is chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.functions.text import clean, quality_hundredths, strip
from evisift.sources.folder import MAX_BYTES, names, with_content

# Fixed values.
SUPPORTED = [".pdf", ".docx", ".txt", ".md"]
DECODED = [".txt", ".md"]
ARCHIVE_FOLDER = "__MACOSX"
EMPTY_ERROR = "no extractable text (possibly image-only/scanned)"
BETTER_PERCENT = 115


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(?<=.)(\.[^.]+)$", 1))


def visible(files: DataFrame) -> DataFrame:
    """Without hidden files and those of an archive's bookkeeping folder."""
    return files.filter(
        ~F.col("filename").startswith(".") & ~F.array_contains(F.split("source_file", "/"), ARCHIVE_FOLDER)
    )


def scan_folder(spark: SparkSession, folder: str, recursive: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(source_file, filename, extension, error, content)`` of all visible files of a supported kind or not.

    A missing folder raises. Names are listed apart from contents; files of kinds that are not read keep a
    null ``content``, and a file that can't be read, or has more than ``max_bytes``, is a row with an ``error``.
    """
    named = visible(names(spark, folder, recursive)).withColumn("extension", extension(F.col("filename")))
    wanted = named["extension"].isin(SUPPORTED)
    read = with_content(named.filter(wanted), max_bytes).withColumn("extension", extension(F.col("filename")))
    other = named.filter(~wanted).withColumn("content", F.lit(None).cast("binary"))
    return read.unionByName(other).select("source_file", "filename", "extension", "error", "content")


def kept(files: DataFrame) -> DataFrame:
    return files.filter(F.col("extension").isin(SUPPORTED))


def skipped(files: DataFrame) -> DataFrame:
    """Names of files with an extension that is not read."""
    return files.filter(~F.col("extension").isin(SUPPORTED)).select("filename")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 when valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def best_extractions(extractions: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, extractor, text, quality_hundredths, error)``: the best text per file.

    Blank texts are dropped. In order of ``pri``, a later text wins only when its
    quality is more than 1.15 times the best so far. Files without any text get the
    joined errors instead. ``extractions`` holds one row per file and extractor; rows without a key are left out.
    A column ``page_count``, where given, is that of the chosen extraction.

    The choice is made on narrow rows: quality is worked out where the text is read, and a text is
    known by its hash from then on. Only usable texts go on to meet the choice, already dealt
    by the same key; none is collected into a list, and no second exchange follows.
    """
    blank = F.length(strip(F.coalesce("text", F.lit("")))) == 0
    pages = F.col("page_count").cast("int") if "page_count" in extractions.columns else F.lit(None).cast("int")
    given = extractions.filter(F.col(key).isNotNull())
    tried = given.select(
        key,
        F.struct(
            "pri", "extractor",
            F.when(~blank, F.xxhash64("text")).alias("at"),
            F.when(~blank, quality_hundredths(F.col("text"))).alias("quality"),
            F.concat("extractor", F.lit(": "), F.coalesce("error", F.lit("no text"))).alias("error"),
            pages.alias("page_count"),
        ).alias("attempt"),
    )
    grouped = tried.groupBy(key).agg(F.array_sort(F.collect_list("attempt")).alias("_all"))
    usable = grouped.withColumn("_usable", F.filter("_all", lambda a: a["at"].isNotNull()))
    best = F.aggregate(
        "_usable",
        F.get("_usable", F.lit(0)),
        lambda best, a: F.when(a["quality"] * 100 > best["quality"] * BETTER_PERCENT, a).otherwise(best),
    )
    chosen = usable.select(
        key, best.alias("_best"),
        F.when(
            F.size("_usable") == 0, F.array_join(F.transform("_all", lambda a: a["error"]), "; ")
        ).alias("error"),
    )
    texts = given.filter(~blank).select(
        F.col(key).alias("_key"), F.struct("pri", "extractor", F.xxhash64("text").alias("at")).alias("_address"), "text"
    )
    address = F.struct("_best.pri", "_best.extractor", "_best.at")
    # not written as an equality, so that both sides are dealt by the key alone, as the choice already is
    met = (address <= F.col("_address")) & (address >= F.col("_address"))
    return (
        chosen.join(texts, (F.col(key) == F.col("_key")) & met, "left")
        .dropDuplicates([key])  # a row that was landed twice
        .select(
            key,
            F.col("_best.extractor").alias("extractor"),
            "text",
            F.col("_best.quality").alias("quality_hundredths"),
            "error",
            *([F.col("_best.page_count").alias("page_count")] if "page_count" in extractions.columns else []),
        )
    )


def with_status(files: DataFrame) -> DataFrame:
    """Clean ``raw_text`` and add ``text``, ``parse_status`` and ``error``; rows are never lost."""
    text = files.withColumn("text", clean(F.coalesce("raw_text", F.lit(""))))
    supported = F.col("extension").isin(SUPPORTED)
    unread = F.col("error").startswith("unreadable") | F.col("error").startswith("file too large")
    error = (
        F.when(~supported & ~F.coalesce(unread, F.lit(False)), F.concat(F.lit("unsupported extension: "), "extension"))
        .otherwise(F.col("error"))
    )
    return text.withColumns({
        "error": F.when(error.isNotNull(), error).when(F.length("text") == 0, EMPTY_ERROR),
        "parse_status": F.when(error.isNotNull(), "failed")
        .when(F.length("text") == 0, "empty").otherwise("ok"),
        "text": F.when(error.isNull(), F.col("text")).otherwise(""),
    })


def documents(files: DataFrame, extractions: DataFrame | None = None) -> DataFrame:
    """``(doc_id, source_file, filename, text, page_count, parse_status, error, content_hash)`` from scanned files.

    ``extractions`` is keyed by ``source_file``. Duplicates are marked later, on the
    narrow hash column (:func:`evisift.operators.dedupe.mark_duplicates`). A file that could not be read has the status
    ``failed``, its error and a blank hash, so it is nobody's duplicate.
    """
    plain = F.col("extension").isin(DECODED)
    unread = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    read = files.select(
        "source_file", "filename", "extension", unread.alias("_unread"),
        F.coalesce(F.sha2("content", 256), F.lit("")).alias("content_hash"),
        F.when(plain, decoded(F.col("content"))).alias("raw_text"),
    )
    missing = F.concat(F.lit("no text supplied for "), "extension")
    if extractions is None:
        found = read.withColumns({"_text": F.lit(None).cast("string"), "_error": F.lit(None).cast("string"), "page_count": F.lit(None).cast("int")})
    else:
        best = best_extractions(extractions, "source_file")
        pages = F.col("page_count") if "page_count" in best.columns else F.lit(None).cast("int")
        found = read.join(
            best.select("source_file", F.col("text").alias("_text"), F.col("error").alias("_error"), pages.alias("page_count")),
            "source_file", "left",
        )
    told = found.withColumns({
        "raw_text": F.coalesce("raw_text", "_text"),
        "error": F.coalesce(
            "_unread", F.when(F.col("raw_text").isNull() & F.col("_text").isNull(), F.coalesce("_error", missing))
        ),
        "page_count": F.when(F.col("raw_text").isNull() & F.col("_unread").isNull(), F.col("page_count")),
    })
    return with_status(told).select(
        F.col("source_file").alias("doc_id"), "source_file", "filename", "text", "page_count", "parse_status",
        "error", "content_hash",
    )
