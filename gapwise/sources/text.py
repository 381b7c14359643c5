"""Readers and writers of the text formats: BED, bedGraph, GFF3, genome sizes, name maps, FASTA, and what is exported.

Every reader gives ord, which follows the order of lines (files in order of path). on_bad says what a coordinate that is
no number does: "error", "zero" (it is 0) or "skip" (the row goes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_NUMBER, _SIGNED = r"^[+]?[0-9]+$", r"^[+-]?[0-9]+$"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, ord): a line's ord grows along each file, and from file to file; one \\r at the end goes."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    # A block's lines are fewer than its bytes, so its start plus a line's number in it is in order and unique.
    blocks = raw.groupBy("_f", "_b").agg(F.min("_i").alias("_first"))
    files = blocks.groupBy("_f").agg(F.lit(1).alias("_one")).withColumn("_k", F.row_number().over(W.orderBy("_f")) - 1).drop("_one")
    placed = raw.join(F.broadcast(blocks) if blocks.count() <= 200_000 else blocks, ["_f", "_b"]).join(files, "_f")
    return placed.select("line", (F.col("_k").cast("long") * (1 << 44) + F.col("_b") + F.col("_i") - F.col("_first")).alias("ord"))


def records(lines: DataFrame, skip_track: bool = False) -> DataFrame:
    """Lines that are no comment and not blank (nor, if asked, begin with track or browser), with f, their fields."""
    keep = (F.trim("line") != "") & ~F.col("line").startswith("#")
    if skip_track:
        keep = keep & ~F.col("line").startswith("track") & ~F.col("line").startswith("browser")
    return lines.where(keep).withColumn("f", F.split("line", "\t", -1))


def _coordinate(i: int, on_bad: str, signed: bool = False) -> Column:
    cell = F.get("f", F.lit(i))
    number = F.when(cell.rlike(_SIGNED if signed else _NUMBER), F.expr(f"try_cast(get(f, {i}) as bigint)"))
    if on_bad == "zero":
        return F.coalesce(number, F.lit(0).cast("long"))
    if on_bad == "error":
        return F.coalesce(number, F.raise_error(F.concat(F.lit("no coordinate: "), F.col("line"))).cast("long"))
    return number


def parse_bed(lines: DataFrame, on_bad: str = "error", skip_track: bool = True, short_is_bad: bool = False, signed: bool = False) -> DataFrame:
    """chrom, start, stop, name, score, strand, rest (all fields after the third), ord of lines (line, ord).

    Rows of fewer than three fields go, or are an error if short_is_bad. signed: coordinates may be negative.
    """
    if on_bad not in ("error", "zero", "skip"):
        raise ValueError("on_bad: error, zero or skip")
    rows = records(lines, skip_track)
    enough = F.size("f") >= 3
    if short_is_bad:
        rows = rows.where(F.when(enough, True).otherwise(F.raise_error(F.concat(F.lit("fewer than 3 fields: "), F.col("line"))).cast("boolean")))
    rows = rows.where(enough)
    out = rows.select(F.col("f")[0].alias("chrom"), _coordinate(1, on_bad, signed).alias("start"), _coordinate(2, on_bad, signed).alias("stop"), *[F.get("f", F.lit(i)).alias(c) for i, c in ((3, "name"), (4, "score"), (5, "strand"))], F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0))).alias("rest"), "ord")
    return out.where("start is not null and stop is not null")


def parse_ends(lines: DataFrame) -> DataFrame:
    """As parse_bed, but the end is no number: `end` has it as it was written, and stop is null."""
    rows = records(lines).where(F.size("f") >= 3)
    return rows.select(F.col("f")[0].alias("chrom"), _coordinate(1, "error").alias("start"), F.lit(None).cast("long").alias("stop"), F.col("f")[2].alias("end"), *[F.get("f", F.lit(i)).alias(c) for i, c in ((3, "name"), (4, "score"), (5, "strand"))], "ord")


def read_bed(spark: SparkSession, path: str | list[str], on_bad: str = "error", skip_track: bool = True) -> DataFrame:
    """The rows of files (see parse_bed)."""
    return parse_bed(read_lines(spark, path), on_bad, skip_track)


def read_bedgraph(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, start, stop, value (as written; "0" if there is none), ord."""
    return read_bed(spark, path, "skip").select("chrom", "start", "stop", F.coalesce(F.rtrim("name"), F.lit("0")).alias("value"), "ord")


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """chrom, size, ord; rows of fewer than two fields go, a bad size is an error."""
    return records(read_lines(spark, path)).where(F.size("f") >= 2).select(F.col("f")[0].alias("chrom"), _coordinate(1, "error").alias("size"), "ord")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """old, new, ord."""
    return records(read_lines(spark, path)).where(F.size("f") >= 2).select(F.col("f")[0].alias("old"), F.col("f")[1].alias("new"), "ord")


def features(rows: DataFrame, ftype: str = "gene", key: str = "gene_name") -> DataFrame:
    """Rows (chrom, ftype, start, stop, attributes, ord) of the type, with name, their attribute; without it they go."""
    found = F.regexp_extract("attributes", rf'(?:^|;)\s*{key}[= ]"?([^";]*)"?', 1)
    return rows.where(F.col("ftype") == ftype).withColumn("name", found).where("name <> ''").select("chrom", "start", "stop", "name", "ord")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """chrom, ftype, start, stop (as written: from 1, inclusive), attributes, ord; rows of fewer than nine fields go."""
    return records(read_lines(spark, path)).where(F.size("f") >= 9).select(F.col("f")[0].alias("chrom"), F.col("f")[2].alias("ftype"), _coordinate(3, "zero").alias("start"), _coordinate(4, "zero").alias("stop"), F.col("f")[8].alias("attributes"), "ord")


def read_fasta_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Sequences in blocks (see operators.sequences): name (the header up to its first blank), rec, block, seq, header, width (of the first line), ord.

    Lines are placed in their record by running sums over stretches of the file and dealt by block, so that neither a row nor a
    task holds a record. Blanks within lines go; lines before the first header belong to none. Not for gzip, which can't be split.
    """
    from ..operators.scan import running
    from ..operators.sequences import BLOCK

    lines = read_lines(spark, path)
    head = F.col("line").startswith(">")
    lines = lines.select("ord", head.alias("_head"), F.when(head, F.col("line")).alias("line"), F.when(head, "").otherwise(F.regexp_replace("line", r"\s", "")).alias("_body"))
    placed = running(lines, [], ["ord"], "ord", rec=("max", F.when(F.col("_head"), F.struct("ord", "line")), "upto"), _at=("sum", F.length("_body"), "before")).where("rec is not null")
    placed = placed.withColumn("_at", F.coalesce("_at", F.lit(0)).cast("long"))
    placed = running(placed, [], ["ord"], "ord", _from=("max", F.when(F.col("_head"), F.col("_at")), "upto"))
    rows = placed.select(F.col("rec.ord").alias("ord"), "rec.line", "_head", "_body", (F.col("_at") - F.col("_from")).alias("_at"))
    # The header stands for the first block, which an empty record has too; the first line's length is that of the line at 0.
    end = F.col("_at") + F.greatest(F.length("_body"), F.lit(1)) - 1
    cut = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("_at") / BLOCK), F.floor(end / BLOCK))))
    skip = F.greatest(F.col("block") * BLOCK - F.col("_at"), F.lit(0))
    cut = cut.withColumn("_piece", F.substring("_body", (skip + 1).cast("int"), ((F.col("block") + 1) * BLOCK - F.col("_at") - skip).cast("int"))).withColumn("_place", F.col("_at") + skip)
    kept = cut.where("_head or _body <> ''")
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_piece"))), lambda x: x["_piece"]), "")
    first = F.max(F.when(~F.col("_head") & (F.col("_at") == 0), F.length("_body")))
    blocks = kept.groupBy("ord", "block").agg(F.first("line").alias("line"), seq.alias("seq"), first.alias("width"))
    widths = blocks.where("block = 0").select("ord", F.coalesce("width", F.lit(0)).alias("width"))
    header = F.substring("line", 2, 1 << 30)
    return blocks.drop("width").join(widths, "ord").select(F.split(header, r"\s")[0].alias("name"), F.col("ord").alias("rec"), "block", "seq", header.alias("header"), "width", "ord")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (the header up to its first blank), header, seq, width (of its first line), ord: whole sequences, for records that fit into a row."""
    from ..operators.sequences import whole

    return whole(read_fasta_blocks(spark, path)).select("name", "header", "seq", "width", "ord")


def validate(lines: DataFrame) -> DataFrame:
    """(ord, error) of each fault: few fields, bad start, bad end, start after end. Blank, comment and track lines are fine."""
    rows = records(lines, True)
    ok = lambda i: F.coalesce(F.get("f", F.lit(i)).rlike(_NUMBER), F.lit(False))
    few = F.size("f") < 3
    a, b = F.expr("try_cast(get(f, 1) as bigint)"), F.expr("try_cast(get(f, 2) as bigint)")
    faults = F.array(F.when(few, F.lit("fewer than 3 fields")), F.when(~few & ~ok(1), F.lit("bad start")), F.when(~few & ~ok(2), F.lit("bad end")), F.when(~few & ok(1) & ok(2) & (a > b), F.lit("start after end")))
    return rows.select("ord", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("error"))


def to_gff(df: DataFrame, source: str = "gapwise", ftype: str = "region", id_key: str = "Name", end: str = "stop") -> DataFrame:
    """(ord, line) of GFF3, with its header line at ord -1; end: the column that is printed as the end, as it is."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    body = df.select("ord", F.concat_ws("\t", "chrom", F.lit(source), F.lit(ftype), (F.col("start") + 1).cast("string"), F.col(end).cast("string"), cell("score"), cell("strand"), F.lit("."), F.concat(F.lit(f"{id_key}="), cell("name"))).alias("line"))
    return _headed(body, "##gff-version 3")


def to_gff3(df: DataFrame) -> DataFrame:
    return to_gff(df, "BED", "region", "ID")


def to_igv(df: DataFrame) -> DataFrame:
    body = df.select("ord", F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"), F.coalesce("name", F.lit(".")), F.coalesce(F.col("score").cast("string"), F.lit("0"))).alias("line"))
    return _headed(body, "Chromosome\tStart\tEnd\tFeature\tScore")


def _headed(body: DataFrame, header: str) -> DataFrame:
    return body.sparkSession.createDataFrame([(-1, header)], "ord long, line string").unionByName(body)


def to_wig(df: DataFrame) -> DataFrame:
    """(ord, k, line): a variableStep line (k = 0) where the chromosome changes, and start+1 with the score (k = 1)."""
    from ..operators.scan import running

    rows = running(df, [], ["ord"], "ord", _p=("max", F.struct("ord", "chrom"), "before"))
    head = F.when(F.col("_p").isNull() | (F.col("_p.chrom") != F.col("chrom")), F.concat(F.lit("variableStep chrom="), F.col("chrom")))
    value = F.concat_ws(" ", (F.col("start") + 1).cast("string"), F.coalesce(F.col("score").cast("string"), F.lit("1")))
    return rows.select("ord", F.posexplode(F.array(head, value)).alias("k", "line")).where("line is not null")


def write_text(lines: DataFrame, path: str) -> None:
    """Write the lines in order of ord (and k)."""
    lines.orderBy(*[c for c in ("ord", "k") if c in lines.columns]).select("line").write.text(path)
