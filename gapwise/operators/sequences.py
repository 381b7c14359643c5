"""Sequences under intervals, in blocks, so that no row holds a whole sequence.

Sequences are whole (name, seq, and more columns) or in blocks: name, rec (a number of the record), block (0, 1, ...), seq (BLOCK characters, fewer
in the last), and more columns of the record such as ord and width. Whole ones are cut where they lie. A region meets the
blocks it covers, takes its piece of each, and the pieces are put together; counts are summed, without the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialize, pinned, small_side
from .islands import merge

COUNTED = "ACGTN"
#: Characters of a block.
BLOCK = 1 << 16


def in_blocks(fasta: DataFrame) -> DataFrame:
    """Whole sequences in blocks; those in blocks stay. An empty sequence has one empty block, a null one counts as empty.

    A record's number is its ord, which is unique; without one the numbered blocks are written, so that all who read them agree.
    """
    if "block" in fasta.columns:
        return fasta
    more = [c for c in fasta.columns if c not in ("name", "seq")]
    last = F.greatest(F.ceil(F.length("seq") / BLOCK) - 1, F.lit(0))
    rows = fasta.withColumn("seq", F.coalesce("seq", F.lit(""))).withColumn("rec", F.col("ord") if "ord" in more else F.monotonically_increasing_id())
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.select("name", "rec", "block", F.substring("seq", (F.col("block") * BLOCK + 1).cast("int"), F.lit(BLOCK)).alias("seq"), *more)
    return rows if "ord" in more else materialize(rows, "blocks")


def whole(blocks: DataFrame) -> DataFrame:
    """Sequences in blocks put together: one row for each record. Only for records that fit into a row."""
    more = [c for c in blocks.columns if c not in ("name", "rec", "block", "seq")]
    parts = blocks.groupBy("rec").agg(F.first("name").alias("name"), _joined("block", "seq"), *[F.first(c).alias(c) for c in more])
    return parts.select("name", "seq", *more)


def _joined(place: str, piece: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, piece))), lambda x: x[piece]), "").alias("seq")


def lengths(blocks: DataFrame) -> DataFrame:
    """name and len of each record."""
    return blocks.groupBy("rec").agg(F.first("name").alias("name"), F.sum(F.length("seq")).alias("len"))


def _sized(bed: DataFrame, blocks: DataFrame, how: str) -> DataFrame:
    """bed's rows with len, the length of their sequence, and rec, its record."""
    sizes, small = pinned(lengths(blocks).select(F.col("name").alias("chrom"), "rec", "len"), "lengths")
    return bed.join(small_side(sizes, small), "chrom", how)


def _pieces(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """ord, block and piece: what each region (rec, start, stop within the sequence, ord) takes of each block it covers."""
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("stop") - 1) / BLOCK)
    asked = regions.where("start < stop").select("rec", "start", "stop", "ord", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0))
    end = F.least(F.col("stop") - F.col("block") * BLOCK, F.lit(BLOCK))
    return asked.join(blocks.select("rec", "block", "seq"), ["rec", "block"]).select("ord", "block", F.substring("seq", (begin + 1).cast("int"), (end - begin).cast("int")).alias("piece"))


def _clipped() -> list[Column]:
    return [F.least("start", "len").alias("start"), F.least("stop", "len").alias("stop")]


def fits(bed: DataFrame, fasta: DataFrame, strict: bool = False) -> DataFrame:
    """chrom, start, stop, ord, rec and len of bed's rows, with fit: whether get_fasta takes the row (len is null for an unknown name; strict: that is an error)."""
    rows = _sized(bed.select("chrom", "start", "stop", "ord"), in_blocks(fasta), "left")
    if strict:
        rows = rows.withColumn("len", F.coalesce("len", F.raise_error(F.concat(F.lit("no sequence called "), F.col("chrom"))).cast("long")))
    return rows.withColumn("fit", F.coalesce((F.col("start") < F.col("stop")) & (F.col("stop") <= F.col("len")), F.lit(False)))


def get_fasta(bed: DataFrame, fasta: DataFrame, strict: bool = False) -> DataFrame:
    """header (chrom:start-stop) and seq of rows (unique ord) that lie within their sequence; strict: an unknown name is an error."""
    fasta = in_blocks(fasta)
    rows = fits(bed, fasta, strict).where("fit")
    found = _pieces(rows, fasta).groupBy("ord").agg(_joined("block", "piece"))
    return rows.join(found, "ord").select("ord", F.format_string("%s:%d-%d", "chrom", "start", "stop").alias("header"), "seq")


def to_fasta(bed: DataFrame, fasta: DataFrame) -> DataFrame:
    """header (chrom:start-stop_name) and seq of rows (unique ord), cut at the sequence's end; unknown names are left out."""
    fasta = in_blocks(fasta)
    rows = _sized(bed.select("chrom", "start", "stop", "name", "ord"), fasta, "inner")
    found = _pieces(rows.select("rec", *_clipped(), "ord"), fasta).groupBy("ord").agg(_joined("block", "piece"))
    header = F.format_string("%s:%d-%d_%s", "chrom", "start", "stop", F.coalesce("name", F.lit("."))).alias("header")
    return rows.join(found, "ord", "left").select("ord", header, F.coalesce("seq", F.lit("")).alias("seq"))


def nuc(bed: DataFrame, fasta: DataFrame) -> DataFrame:
    """chrom, start, stop, ord, pct_at, pct_gc, the numbers of A, C, G, T, N and others, and seq_len of each row (unique ord); 0 for unknown names.

    Each block gives the counts of its piece, which are added up: no region is put together.
    """
    fasta, rows = in_blocks(fasta), bed.select("chrom", "start", "stop", "ord")
    asked = _sized(rows, fasta, "inner").select("rec", *_clipped(), "ord")
    piece = F.upper("piece")
    each = {f"n_{b.lower()}": F.length("piece") - F.length(F.replace(piece, F.lit(b))) for b in COUNTED} | {"seq_len": F.length("piece")}
    found = _pieces(asked, fasta).groupBy("ord").agg(*[F.sum(c).alias(k) for k, c in each.items()])
    rows = rows.join(found, "ord", "left").na.fill(0, list(each))
    share = lambda a, b: F.when(F.col("seq_len") > 0, (F.col(a) + F.col(b)) / F.col("seq_len")).otherwise(0.0)
    other = F.col("seq_len") - sum((F.col(f"n_{b.lower()}") for b in COUNTED), F.lit(0))
    return rows.select("chrom", "start", "stop", "ord", share("n_a", "n_t").alias("pct_at"), share("n_g", "n_c").alias("pct_gc"), *[f"n_{b.lower()}" for b in COUNTED], other.alias("n_other"), "seq_len")


def mask_fasta(fasta: DataFrame, bed: DataFrame, soft: bool = False, mask: str = "N") -> DataFrame:
    """fasta with the stretches under bed replaced by the mask character, or in lower case; in blocks if it came in blocks."""
    if len(mask) != 1:
        raise ValueError("the mask is one character")
    blocks = in_blocks(fasta)
    spans = merge(bed).where("start < stop").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("stop") - 1) / BLOCK))))
    at = lambda c: F.least(F.greatest(F.col(c) - F.col("block") * BLOCK, F.lit(0)), F.lit(BLOCK)).cast("int")
    held = spans.groupBy(F.col("chrom").alias("name"), "block").agg(F.array_sort(F.collect_list(F.struct(at("start").alias("a"), at("stop").alias("b")))).alias("_m"))
    n = F.length("seq")
    # Bytes are cut out in place; a block with wider characters is cut by characters, with a walk to each.
    plain = F.octet_length("seq") == n
    cut = lambda a, b: F.when(plain, F.substring(F.col("seq").cast("binary"), a + 1, F.greatest(b - a, F.lit(0))).cast("string")).otherwise(F.substring(F.col("seq"), a + 1, F.greatest(b - a, F.lit(0))))
    stop = lambda m: F.least(m["b"], n)
    hidden = lambda m: F.lower(cut(m["a"], stop(m))) if soft else F.repeat(F.lit(mask), F.greatest(stop(m) - m["a"], F.lit(0)))
    ends = F.concat(F.array(F.lit(0)), F.transform("_m", lambda m: m["b"]))  # one more than masks: the last is where the rest begins
    parts = F.zip_with("_m", F.slice(ends, F.lit(1), F.size("_m")), lambda m, before: F.concat(cut(before, m["a"]), hidden(m)))
    masked = F.concat(F.array_join(parts, ""), cut(F.element_at(ends, -1), n))
    out = blocks.join(held, ["name", "block"], "left").withColumn("seq", F.when(F.col("_m").isNull(), F.col("seq")).otherwise(masked)).select(*blocks.columns)
    return out if "block" in fasta.columns else whole(out).select(*fasta.columns)


def wrapped(fasta: DataFrame) -> DataFrame:
    """(ord, k, line): header and lines of each sequence, of its own width (60 without one), k in order from 0, the header.

    A line that two blocks share is put together from both.
    """
    blocks = in_blocks(fasta)
    width = F.greatest(F.coalesce("width", F.lit(60)), F.lit(1)).cast("long") if "width" in fasta.columns else F.lit(60).cast("long")
    rows = blocks.select("ord", "rec", "block", "seq", width.alias("w"), (F.col("block") * BLOCK).alias("at"))
    first, last = F.floor(F.col("at") / F.col("w")), F.floor((F.col("at") + F.greatest(F.length("seq"), F.lit(1)) - 1) / F.col("w"))
    lines = rows.where("seq <> ''").withColumn("k", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("k") * F.col("w") - F.col("at"), F.lit(0))
    end = (F.col("k") + 1) * F.col("w") - F.col("at")
    pieces = lines.select("ord", "rec", "k", "block", F.substring("seq", (begin + 1).cast("int"), (end - begin).cast("int")).alias("piece"))
    body = pieces.groupBy("rec", "k").agg(F.first("ord").alias("ord"), _joined("block", "piece")).select("ord", (F.col("k") + 1).alias("k"), F.col("seq").alias("line"))
    heads = blocks.where("block = 0").select("ord", F.lit(0).cast("long").alias("k"), F.concat(F.lit(">"), F.col("name")).alias("line"))
    return heads.unionByName(body)
