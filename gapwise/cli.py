"""A command line over text files: python -m gapwise.cli OPERATOR FILE ... [-o FOLDER]; lines go to stdout without -o.

Files are read as each operator reads them: what a bad coordinate does, whether track lines are records, and how many
fields a row needs differ (see READS). A row's fields after the third are printed as they were read. "-" is stdin, whose
lines pass through the driver. Lines come in the operator's own order.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats as fmt
from .operators import aggregates, islands, nearest, randomness, rangejoin, rows, sequences, sweep
from .operators.scan import running
from .sources import text
from .tables import release


class Printed(NamedTuple):
    """Rows, what is printed of each (tab-separated, "." for null), their order, lines before them, and lines for stderr."""

    rows: DataFrame
    cells: list[Column | str]
    order: list[Column | str]
    head: list[str] = []
    notes: Iterable[str] = ()
    code: int = 0


#: How coordinates that are no numbers are taken, by operator (all others: zero); "error" also for rows of fewer than three fields where SHORT.
READS = {
    **dict.fromkeys(["sort", "merge", "complement", "intersect", "subtract", "fisher", "jaccard", "slop", "flank", "shift", "stats", "len", "genomecov", "cluster", "to-gff", "getfasta"], "error"),
    **dict.fromkeys(["closest", "multiinter", "unionbedg", "reldist", "maskfasta", "shuffle"], "skip"),
}
SHORT = {"fisher", "jaccard", "intersect", "subtract"}
SIGNED = {"cluster", "shift", "reldist"}
SKIPS_TRACKS = {"intersect", "subtract", "fisher", "jaccard", "unionbedg", "sort", "merge", "complement"}


def formatted(c: Column | str, how: Callable[[float], str]) -> Column:
    """A number as text; null stays null."""
    return F.pandas_udf(lambda x: x.map(lambda v: None if pd.isna(v) else how(v)), "string")(F.col(c) if isinstance(c, str) else c)


def _lines(s: SparkSession, path: str) -> DataFrame:
    if path != "-":
        return text.read_lines(s, path)
    return s.createDataFrame([(x.rstrip("\n").removesuffix("\r"), i) for i, x in enumerate(sys.stdin)], "line string, ord long")


class Command:
    """One call: the files as its operator reads them, and what it prints."""

    def __init__(self, spark: SparkSession, a: argparse.Namespace):
        self.s, self.a, self.op = spark, a, a.operator

    def bed(self, i: int) -> DataFrame:
        return text.parse_bed(_lines(self.s, self.a.files[i]), READS.get(self.op, "zero"), self.op in SKIPS_TRACKS, self.op in SHORT, self.op in SIGNED)

    def records(self, i: int) -> DataFrame:
        return text.records(_lines(self.s, self.a.files[i]))

    def genome(self, i: int) -> DataFrame:
        return text.read_genome(self.s, self.a.files[i])

    def fasta(self, i: int) -> DataFrame:
        return text.read_fasta_blocks(self.s, self.a.files[i])

    def names(self, default: str = "{}") -> list[str]:
        return self.a.names.split(",") if self.a.names else [default.format(i + 1) for i in range(len(self.a.files))]

    def run(self) -> Printed:
        made = getattr(self, "do_" + self.op.replace("-", "_"), None)
        if made is None:
            raise SystemExit(f"no operator called {self.op}")
        return made()

    # Rows as they were read, in order of the file or of a sort.

    def _kept(self, df: DataFrame, *order: Column | str) -> Printed:
        return Printed(df, ["chrom", "start", "stop", "rest"], list(order) or ["ord"])

    def _three(self, df: DataFrame, *order: Column | str) -> Printed:
        return Printed(df, ["chrom", "start", "stop"], list(order) or ["ord", "start"])

    def do_sort(self) -> Printed:
        return self._kept(self.bed(0), "chrom", "start", "ord")

    def do_sort_size(self) -> Printed:
        size = F.greatest(F.col("stop") - F.col("start"), F.lit(0))
        return self._kept(self.bed(0), size.desc() if self.a.descending else size, "ord")

    def do_sort_name(self) -> Printed:
        return Printed(self.records(0), ["line"], [F.coalesce(F.get("f", F.lit(3)), F.lit("")), "ord"])

    def do_slop(self) -> Printed:
        return self._three(rows.slop(self.bed(0), self.genome(1), self.a.left, self.a.right))

    def do_flank(self) -> Printed:
        return self._three(rows.flank(self.bed(0), self.genome(1), self.a.left, self.a.right))

    def do_shift(self) -> Printed:
        return self._three(rows.shift(self.bed(0), self.genome(1), self.a.size))

    def do_flank_bp(self) -> Printed:
        return self._kept(rows.flank_bp(self.bed(0), self.a.size))

    def do_resize(self) -> Printed:
        return self._kept(rows.resize(self.bed(0), self.a.size))

    def do_midpoint(self) -> Printed:
        return self._three(rows.midpoint(self.bed(0)))

    def do_promoters(self) -> Printed:
        return self._kept(rows.promoters(self.bed(0), self.a.upstream, self.a.downstream))

    def do_len(self) -> Printed:
        return Printed(rows.lengths(self.bed(0)), ["len"], ["ord"])

    def do_rename(self) -> Printed:
        """Comments and blank lines pass through."""
        lines = _lines(self.s, self.a.files[0])
        first = F.split_part("line", F.lit("\t"), F.lit(1))
        plain = (F.trim("line") == "") | F.col("line").startswith("#")
        out = rows.rename(lines.withColumn("chrom", F.when(~plain, first)), text.read_names(self.s, self.a.files[1]))
        return Printed(out.withColumn("line", F.when(plain, F.col("line")).otherwise(F.concat("chrom", F.substr("line", F.length(first) + 1)))), ["line"], ["ord"])

    def do_makewindows(self) -> Printed:
        g = self.genome(0)
        return self._three(rows.makewindows(g, self.a.size, self.a.step).join(g.select("chrom", "ord"), "chrom"))

    def do_tail(self) -> Printed:
        """Lines that begin with # first, then the last records."""
        lines = _lines(self.s, self.a.files[0])
        heads = lines.where(F.col("line").startswith("#")).withColumn("k", F.lit(0))
        last = rows.tail(text.records(lines).select("line", "ord"), self.a.n).withColumn("k", F.lit(1))
        return Printed(heads.unionByName(last), ["line"], ["k", "ord"])

    def do_unique(self) -> Printed:
        r = self.records(0)
        cells = r.select("line", "ord", *[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(("chrom", "start", "stop"))])
        out = rows.unique(cells)
        return Printed(out, ["line"], ["ord"], notes=[f"{r.count()} total, {out.count()} unique"])

    def do_sample(self) -> Printed:
        return Printed(rows.sample_exact(self.records(0).select("line", "ord"), self.a.n, self.a.seed), ["line"], ["place"])

    # Joins.

    def do_intersect(self) -> Printed:
        return self._kept(rangejoin.intersect(self.bed(0), self.bed(1)), "ord", "start", "stop")

    def do_subtract(self) -> Printed:
        return self._kept(rangejoin.subtract(self.bed(0), self.bed(1)), "ord", "start")

    def _pairs(self, df: DataFrame, *cells: Column | str) -> Printed:
        return Printed(df, ["a_chrom", "a_start", "a_stop", "a_rest", *cells], ["a_ord", "b_start", "b_ord"])

    def do_window(self) -> Printed:
        return self._pairs(rangejoin.window(self.bed(0), self.bed(1), self.a.size), "b_chrom", "b_start", "b_stop", "b_rest")

    def do_closest(self) -> Printed:
        b = self.bed(1)
        found = nearest.closest(self.bed(0), b).join(b.select(F.col("ord").alias("b_ord"), F.col("rest").alias("b_rest")), "b_ord", "left")
        return self._pairs(found, "b_chrom", "b_start", "b_stop", "b_rest")

    def do_annotate(self) -> Printed:
        out = nearest.annotate(self.bed(0), text.features(text.read_gff(self.s, self.a.files[1]), self.a.type or "gene", self.a.attribute))
        return Printed(out, ["chrom", "start", "stop", "rest", "feature", "dist"], ["ord"])

    def do_map(self) -> Printed:
        b = self.bed(1).withColumn("v", F.expr(f"try_cast(get(rest, {self.a.column - 4}) as double)"))
        out = rangejoin.map_values(self.bed(0), b, self.a.op or "mean", "v")
        return Printed(out.withColumn("value", formatted("value", lambda v: fmt.g(v, 10))), ["chrom", "start", "stop", "rest", "value"], ["ord"])

    def do_reldist(self) -> Printed:
        out = nearest.reldist(self.bed(0), self.bed(1))
        return Printed(out, [formatted("reldist", "{:.2f}".format), "count", "total", formatted("fraction", "{:.3f}".format)], ["reldist"], ["reldist\tcount\ttotal\tfraction"])

    def _one(self, df: DataFrame, lines: Callable[[dict], list[str]]) -> Printed:
        """A result of one row, as lines."""
        held = df.first().asDict()
        return Printed(self.s.createDataFrame([], "line string"), ["line"], ["line"], lines(held))

    def do_jaccard(self) -> Printed:
        return self._one(rangejoin.jaccard(self.bed(0), self.bed(1)), lambda r: ["intersection\tunion\tjaccard\tn_intersections", f"{r['intersection']}\t{r['union']}\t{fmt.stripped(r['jaccard'])}\t{r['n_intersections']}"])

    def do_overlap(self) -> Printed:
        import json

        return self._one(rangejoin.overlap_stats(self.bed(0), self.bed(1)), lambda r: json.dumps(r, indent=2).split("\n"))

    def do_fisher(self) -> Printed:
        def report(r: dict) -> list[str]:
            n11, n12, n21, n22 = (r[k] for k in ("n11", "n12", "n21", "n22"))
            query, db, every = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
            ratio = "inf" if r["ratio"] == float("inf") else f"{r['ratio']:.3f}"
            rule = "#" + "_" * 41
            return [
                f"# Number of query intervals: {query}", f"# Number of db intervals: {db}", f"# Number of overlaps: {n11}", f"# Number of possible intervals (estimated): {every}",
                f"# phyper({n11} - 1, {query}, {every} - {query}, {db}, lower.tail=F)", "# Contingency Table Of Counts", rule,
                f"#           | {' in -b':<12} | {'not in -b':<12} |", f"#     in -a | {n11:<12} | {n12:<12} |", f"# not in -a | {n21:<12} | {n22:<12} |", rule,
                "# p-values for fisher's exact test", "left\tright\ttwo-tail\tratio", "\t".join([*(fmt.g(r[k], 5) for k in ("left", "right", "two_tail")), ratio]),
            ]

        return self._one(rangejoin.fisher(self.bed(0), self.bed(1), self.genome(2)), report)

    # Summaries.

    def do_count(self) -> Printed:
        return self._one(aggregates.count(self.records(0)), lambda r: [str(r["n"])])

    def do_stats(self) -> Printed:
        names = [("count", "n", "{}"), ("total_bases",) * 2 + ("{}",), ("mean_len",) * 2 + ("{:.1f}",), ("median_len",) * 2 + ("{:.1f}",), ("min_len",) * 2 + ("{}",), ("max_len",) * 2 + ("{}",)]
        return self._one(aggregates.stats(self.bed(0)), lambda r: [f"{name}\t{how.format(r[k])}" for name, k, how in names])

    def do_coverage_hist(self) -> Printed:
        more = lambda r: [f"min\t{r['min_len']}", f"max\t{r['max_len']}", f"mean\t{r['mean_len']:.1f}", f"median\t{r['median_len']}"] if r["n_rows"] else []
        return self._one(aggregates.coverage_hist(self.bed(0)), lambda r: [f"count\t{r['n_rows']}", f"total_bp\t{r['total_bp']}", *more(r)])

    def do_total_bp(self) -> Printed:
        return self._one(aggregates.total_bp(self.bed(0)), lambda r: [str(r["total_bp"])])

    def do_total_span(self) -> Printed:
        df = self.bed(0)
        each = df.groupBy("chrom").agg((F.max("stop") - F.min("start")).alias("span"), F.lit(0).alias("k"))
        total = each.agg(F.coalesce(F.sum("span"), F.lit(0)).alias("span")).select(F.lit("total").alias("chrom"), "span", F.lit(1).alias("k"))
        return Printed(each.unionByName(total), ["chrom", "span"], ["k", "chrom"])

    def do_chroms(self) -> Printed:
        return Printed(aggregates.chroms(self.records(0).select(F.col("f")[0].alias("chrom"))), ["chrom"], ["chrom"])

    def do_chroms_sizes(self) -> Printed:
        return Printed(aggregates.chroms_sizes(self.bed(0)), ["chrom", "bases"], ["chrom"])

    def do_merge_by_name(self) -> Printed:
        return Printed(aggregates.merge_by_name(self.bed(0)), ["chrom", "start", "stop", "name"], [F.concat_ws("\t", "chrom", "name")])

    def do_groupby(self) -> Printed:
        """Columns count from 1, as in "1,3-5"; --by has as many as --op has names."""

        def places(spec: str) -> list[int]:
            ends = [[int(x) for x in part.split("-")] for part in spec.split(",")]
            return [i for e in ends for i in range(e[0], e[-1] + 1)]

        keys, by, ops = places(self.a.keys), places(self.a.by), (self.a.op or "sum").split(",")
        if len(by) != len(ops):
            raise SystemExit("--by and --op differ in length")
        cells = {i: F.coalesce(F.get("f", F.lit(i - 1)), F.lit("")).alias(f"c{i}") for i in {*keys, *by}}
        out = aggregates.group_runs(self.records(0).select("ord", *cells.values()), [f"c{i}" for i in keys], [(f"c{i}", op) for i, op in zip(by, ops, strict=True)])
        shown = lambda i, op: formatted(f"{op}_c{i}", lambda v: fmt.g(v, 10)) if op in ("sum", "mean", "min", "max", "stdev") else F.col(f"{op}_c{i}")
        return Printed(out, [*(f"c{i}" for i in keys), *(shown(i, op) for i, op in zip(by, ops, strict=True))], ["run"])

    def do_genomecov(self) -> Printed:
        g = self.genome(1)
        out = sweep.genomecov(self.bed(0), g).join(g.select("chrom", "ord"), "chrom", "left")
        return Printed(out, ["chrom", "depth", "bases", "size", formatted("fraction", lambda v: fmt.g(v, 6))], ["scope", "ord", "depth"])

    # Interval sets.

    def do_merge(self) -> Printed:
        return self._three(islands.merge(self.bed(0)), "chrom", "start")

    do_merge_overlaps = do_merge

    def do_union(self) -> Printed:
        return self._three(islands.union(self.bed(0), self.bed(1)), "chrom", "start")

    def do_complement(self) -> Printed:
        g = self.genome(1)
        return self._three(islands.complement(self.bed(0), g).join(g.select("chrom", "ord"), "chrom"))

    def do_cluster(self) -> Printed:
        return Printed(islands.cluster(self.bed(0), self.a.distance), ["chrom", "start", "stop", "rest", "cluster"], ["ord"])

    def do_spacing(self) -> Printed:
        return Printed(islands.spacing(self.bed(0)), ["chrom", "start", "stop", "gap"], ["chrom", "start"])

    def do_multiinter(self) -> Printed:
        own = [f"f{i}" for i in range(len(self.a.files))]
        out = sweep.multiinter([self.bed(i) for i in range(len(own))], own)
        listed = F.concat_ws(",", *[F.when(F.col(c) > 0, F.lit(x)) for c, x in zip(own, self.names(), strict=True)])
        return Printed(out, ["chrom", "start", "stop", "n", listed, *own], ["chrom", "start"])

    def do_unionbedg(self) -> Printed:
        """Chromosomes in the order in which the files first name them."""
        own = [f"f{i}" for i in range(len(self.a.files))]
        files = [text.read_bedgraph(self.s, f) for f in self.a.files]
        seen = None
        for i, f in enumerate(files):
            x = f.groupBy("chrom").agg(F.min(F.struct(F.lit(i).alias("i"), "ord")).alias("at"))
            seen = x if seen is None else seen.unionByName(x)
        out = sweep.unionbedg(files, own).join(seen.groupBy("chrom").agg(F.min("at").alias("at")), "chrom")
        head = ["\t".join(["chrom", "start", "end", *self.names()])] if self.a.header else []
        return Printed(out, ["chrom", "start", "stop", *own], ["at", "start"], head)

    # Random places.

    def do_random(self) -> Printed:
        return self._three(randomness.random_intervals(self.s, self.genome(0), self.a.n, self.a.size, self.a.seed))

    def do_shuffle(self) -> Printed:
        out = text.parse_bed(_lines(self.s, self.a.files[2]), "skip") if len(self.a.files) > 2 else None
        return self._kept(randomness.shuffle(self.bed(0), self.genome(1), self.a.seed, out, self.a.chrom))

    # Sequences and other formats.

    def do_getfasta(self) -> Printed:
        bed, fa = self.bed(0), self.fasta(1)
        out = sequences.get_fasta(bed, fa, strict=True)
        bare = F.format_string("Feature (%s:%d-%d) has length = 0, Skipping.", "chrom", "start", "stop")
        beyond = F.format_string("Feature (%s:%d-%d) beyond the length of %s size (%d bp).  Skipping.", "chrom", "start", "stop", "chrom", "len")
        left = sequences.fits(bed, fa, strict=True).where("not fit").orderBy("ord").select(F.when(F.col("start") >= F.col("stop"), bare).otherwise(beyond).alias("line"))
        lines = out.select("ord", F.posexplode(F.array(F.concat(F.lit(">"), "header"), F.col("seq"))).alias("k", "line"))
        return Printed(lines, ["line"], ["ord", "k"], notes=(r["line"] for r in left.toLocalIterator()))

    def do_to_fasta(self) -> Printed:
        out = sequences.to_fasta(self.bed(0), self.fasta(1))
        return Printed(out.select("ord", F.posexplode(F.array(F.concat(F.lit(">"), "header"), F.col("seq"))).alias("k", "line")), ["line"], ["ord", "k"])

    def do_nuc(self) -> Printed:
        bed = self.bed(0)
        width = max(3, 3 + (bed.agg(F.max(F.size("rest")).alias("n")).first()["n"] or 0))
        out = sequences.nuc(bed, self.fasta(1)).join(bed.select("ord", "rest"), "ord")
        padded = F.transform(F.sequence(F.lit(0), F.lit(width - 4)), lambda i: F.coalesce(F.get("rest", i), F.lit(""))) if width > 3 else F.array().cast("array<string>")
        names = [f"{i + 1}_usercol" for i in range(width)] + [f"{width + 1 + i}_{x}" for i, x in enumerate(("pct_at", "pct_gc", "num_A", "num_C", "num_G", "num_T", "num_N", "num_oth", "seq_len"))]
        shares = [formatted(c, "{:.6f}".format) for c in ("pct_at", "pct_gc")]
        return Printed(out.withColumn("rest", padded), ["chrom", "start", "stop", "rest", *shares, "n_a", "n_c", "n_g", "n_t", "n_n", "n_other", "seq_len"], ["ord"], ["#" + "\t".join(names)])

    def do_maskfasta(self) -> Printed:
        bed = text.parse_bed(_lines(self.s, self.a.files[1]), "skip")
        return Printed(sequences.wrapped(sequences.mask_fasta(self.fasta(0), bed, self.a.soft, self.a.mask)), ["line"], ["ord", "k"])

    def do_to_gff(self) -> Printed:
        return Printed(text.to_gff(text.parse_ends(_lines(self.s, self.a.files[0])), self.a.source, self.a.type or "region", end="end"), ["line"], ["ord"])

    def do_to_gff3(self) -> Printed:
        return Printed(text.to_gff3(self.bed(0)), ["line"], ["ord"])

    def do_to_igv(self) -> Printed:
        return Printed(text.to_igv(self.bed(0)), ["line"], ["ord"])

    def do_to_wig(self) -> Printed:
        return Printed(text.to_wig(self.bed(0)), ["line"], ["ord", "k"])

    def do_validate(self) -> Printed:
        """Faults by line number to stderr; the exit code says whether there are any."""
        lines = running(_lines(self.s, self.a.files[0]), [], ["ord"], "ord", number=("sum", F.lit(1), "upto"))
        faults = text.validate(lines.drop("ord").withColumnRenamed("number", "ord")).orderBy("ord").collect()
        n = text.records(lines, True).where(F.size("f") >= 3).count()
        notes = [f"INVALID: {n} records, {len(faults)} errors:", *(f"  line {r['ord']}: {r['error']}" for r in faults)] if faults else [f"OK: {n} records, no errors"]
        return Printed(self.s.createDataFrame([], "line string"), ["line"], ["line"], notes=notes, code=1 if faults else 0)


OPERATORS = sorted(x[3:].replace("_", "-") for x in vars(Command) if x.startswith("do_"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gapwise", description="Operators: " + " ".join(OPERATORS))
    p.add_argument("operator", choices=OPERATORS, metavar="operator")
    p.add_argument("files", nargs="+")
    p.add_argument("-o", "--output", default="-")
    for name, kind, default in (("left", int, 0), ("right", int, 0), ("size", int, 1000), ("step", int, 0), ("n", int, 10), ("seed", int, 42), ("distance", int, 0), ("column", int, 4), ("upstream", int, 2000), ("downstream", int, 200), ("op", str, ""), ("keys", str, "1"), ("by", str, "5"), ("type", str, ""), ("source", str, "gapwise"), ("attribute", str, "gene_name"), ("names", str, ""), ("mask", str, "N")):
        p.add_argument(f"--{name}", type=kind, default=default)
    for name in ("descending", "soft", "chrom", "header"):
        p.add_argument(f"--{name}", action="store_true")
    a = p.parse_args(argv)
    own = SparkSession.getActiveSession() is None
    spark = SparkSession.builder.appName("gapwise").getOrCreate()
    try:
        return printed(spark, a)
    finally:
        if own:
            release(spark)
            spark.stop()


def printed(spark: SparkSession, a: argparse.Namespace) -> int:
    """Run one call and print or write what it gives; its exit code."""
    out = Command(spark, a).run()
    for note in out.notes:
        print(note, file=sys.stderr)
    kinds = dict(out.rows.dtypes)
    cell = lambda c: F.col(c) if isinstance(c, str) and kinds[c].startswith("array") else F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("."))
    ordered = out.rows.orderBy(*out.order).select(F.concat_ws("\t", *map(cell, out.cells)).alias("line"))
    if a.output == "-":
        for line in out.head:
            print(line)
        for r in ordered.toLocalIterator():
            print(r["line"])
    else:
        head = spark.createDataFrame([(i, x) for i, x in enumerate(out.head)], "k int, line string")
        if out.head:
            ordered = head.orderBy("k").select("line").unionByName(ordered)
        ordered.write.mode("error").text(a.output)
    return out.code


if __name__ == "__main__":
    sys.exit(main())
