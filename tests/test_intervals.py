"""Small fixtures with results worked out by hand from the rules, and edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gapwise.functions.stats import fisher_tails, g, stripped
from gapwise.operators import aggregates, islands, nearest, randomness, rangejoin, rows, scan, sequences, sweep
from gapwise.sources import text

SMALL = [("chr1", 10, 30, "geneA", 100, "+", 0), ("chr1", 20, 50, "geneB", 200, "-", 1), ("chr1", 80, 100, "geneC", 300, "+", 2), ("chr2", 0, 40, "geneD", 150, "+", 3), ("chr2", 60, 90, "geneE", 250, "-", 4), ("chr2", 60, 90, "geneE", 250, "-", 5)]
B = [("chr1", 25, 45, "feat1", 0, "+", 0), ("chr2", 50, 70, "feat2", 0, "-", 1)]
KIND = "chrom string, start long, stop long, name string, score long, strand string, ord long"


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(SMALL, KIND).cache()


@pytest.fixture(scope="module")
def b(spark):
    return spark.createDataFrame(B, KIND).cache()


@pytest.fixture(scope="module")
def genome(spark):
    return spark.createDataFrame([("chr1", 1000, 0), ("chr2", 500, 1)], "chrom string, size long, ord long").cache()


def spans(df, *more):
    return sorted(tuple(r) for r in df.select("chrom", "start", "stop", *more).collect())


def test_merge_union_complement(small, b, genome):
    assert spans(islands.merge(small)) == [("chr1", 10, 50), ("chr1", 80, 100), ("chr2", 0, 40), ("chr2", 60, 90)]
    assert spans(islands.union(small, b)) == [("chr1", 10, 50), ("chr1", 80, 100), ("chr2", 0, 40), ("chr2", 50, 90)]
    assert spans(islands.complement(small, genome)) == [("chr1", 0, 10), ("chr1", 50, 80), ("chr1", 100, 1000), ("chr2", 40, 60), ("chr2", 90, 500)]


def test_merge_fuses_neighbours_and_keeps_empty_tables_empty(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 5, 9), ("c", 11, 12)], "chrom string, start long, stop long")
    assert spans(islands.merge(df)) == [("c", 0, 9), ("c", 11, 12)]
    assert islands.merge(df.limit(0)).count() == 0
    same = spark.createDataFrame([("c", s, s + 3) for s in (0, 10, 20, 30) for _ in range(25)], "chrom string, start long, stop long").repartition(4)
    assert spans(islands.merge(same)) == [("c", s, s + 3) for s in (0, 10, 20, 30)]


def test_spacing_cluster(spark, small):
    assert spans(islands.spacing(small), "gap") == [("chr1", 50, 80, 30), ("chr2", 40, 60, 20)]
    mixed = spark.createDataFrame([("c1", 0, 5, 0), ("c2", 0, 5, 1), ("c1", 10, 20, 2), ("c1", 25, 30, 3), ("c1", 28, 40, 4)], "chrom string, start long, stop long, ord long")
    assert spans(islands.spacing(mixed), "gap") == [("c1", 20, 25, 5)]
    df = spark.createDataFrame([("a", 0, 10, 0), ("a", 5, 20, 1), ("a", 30, 40, 2), ("b", 0, 10, 3), ("b", 25, 30, 4)], "chrom string, start long, stop long, ord long")
    assert [r["cluster"] for r in islands.cluster(df).orderBy("ord").collect()] == [1, 1, 2, 3, 4]
    assert [r["cluster"] for r in islands.cluster(df, 20).orderBy("ord").collect()] == [1, 1, 1, 2, 2]


def test_intersect_subtract_window(small, b):
    assert spans(rangejoin.intersect(small, b), "name") == [("chr1", 25, 30, "geneA"), ("chr1", 25, 45, "geneB"), ("chr2", 60, 70, "geneE"), ("chr2", 60, 70, "geneE")]
    assert spans(rangejoin.subtract(small, b), "name") == [("chr1", 10, 25, "geneA"), ("chr1", 20, 25, "geneB"), ("chr1", 45, 50, "geneB"), ("chr1", 80, 100, "geneC"), ("chr2", 0, 40, "geneD"), ("chr2", 70, 90, "geneE"), ("chr2", 70, 90, "geneE")]
    assert rangejoin.window(small, b, 500).count() == 6


def test_long_intervals_use_coarser_bins(spark):
    a = spark.createDataFrame([("c", i * 10, i * 10 + 3, i) for i in range(500)] + [("c", 0, 1_000_000, 999)], "chrom string, start long, stop long, ord long")
    pairs = rangejoin.overlap_pairs(a, a, levels=[8, 512, 32768])
    assert pairs.count() == pairs.distinct().count() == 501 + 2 * 500


def test_overlap_jaccard_fisher(small, b, genome):
    r = rangejoin.overlap_stats(small, b).first()
    assert (r["a_count"], r["b_count"], r["a_with_overlap"], r["b_with_overlap"], r["a_bases"], r["b_bases"], r["overlap_bases"]) == (6, 2, 4, 2, 170, 40, 45)
    j = rangejoin.jaccard(small, b).first()
    assert (j["intersection"], j["union"], stripped(j["jaccard"]), j["n_intersections"]) == (30, 140, "0.214286", 2)
    f = rangejoin.fisher(small, b, genome).first()
    assert (f["n11"], f["n12"], f["n21"], f["n22"], g(f["left"], 5), g(f["right"], 5), g(f["two_tail"], 5), f["ratio"]) == (4, 2, 0, 23, "1", "0.00063155", "0.00063155", math.inf)
    assert [g(x, 5) for x in fisher_tails(2, 4, 2, 16)] == ["0.96471", "0.25127", "0.25127"]


def test_closest_ties_and_missing(spark):
    a = spark.createDataFrame([("c", 100, 200, 0), ("d", 1, 2, 1), ("c", 60, 61, 2)], "chrom string, start long, stop long, ord long")
    near = spark.createDataFrame([("c", 50, 90, 0), ("c", 210, 220, 1), ("c", 300, 310, 2)], "chrom string, start long, stop long, ord long")
    got = sorted((r["a_ord"], r["b_chrom"], r["b_start"], r["b_stop"]) for r in nearest.closest(a, near).collect())
    assert got == [(0, "c", 50, 90), (0, "c", 210, 220), (1, ".", -1, -1), (2, "c", 50, 90)]


def test_annotate(spark, small):
    f = spark.createDataFrame([("chr1", 15, 35, "BRCA1", 0), ("chr2", 55, 85, "TP53", 1)], "chrom string, start long, stop long, name string, ord long")
    got = [(r["feature"], r["dist"]) for r in nearest.annotate(small, f).orderBy("ord").collect()]
    assert got == [("BRCA1", 0), ("BRCA1", 0), ("BRCA1", 55), ("TP53", 35), ("TP53", 0), ("TP53", 0)]


def test_genomecov(small, genome):
    got = sorted((r["chrom"], r["depth"], r["bases"]) for r in sweep.genomecov(small, genome).collect())
    assert got == [("chr1", 0, 940), ("chr1", 1, 50), ("chr1", 2, 10), ("chr2", 0, 430), ("chr2", 1, 40), ("chr2", 2, 30), ("genome", 0, 1370), ("genome", 1, 90), ("genome", 2, 40)]


def test_unionbedg_neighbours(spark):
    kind = "chrom string, start long, stop long, value string"
    x = spark.createDataFrame([("c", 0, 10, "1.0"), ("c", 10, 20, "2.5")], kind)
    y = spark.createDataFrame([("c", 5, 15, "7")], kind)
    assert spans(sweep.unionbedg([x, y], ["x", "y"]), "x", "y") == [("c", 0, 5, "1.0", "0"), ("c", 5, 10, "1.0", "7"), ("c", 10, 15, "2.5", "7"), ("c", 15, 20, "2.5", "0")]
    assert spans(sweep.multiinter([x, y], ["x", "y"]), "n", "list") == [("c", 0, 5, 1, "x"), ("c", 5, 15, 2, "x,y"), ("c", 15, 20, 1, "x")]


def test_shuffle_keeps_lengths_bounds_chromosomes_and_exclusions(spark, genome):
    rows_ = spark.createDataFrame([("chr1" if i % 2 else "chr2", 5, 5 + i % 90, i) for i in range(400)], "chrom string, start long, stop long, ord long")
    out = spark.createDataFrame([("chr1", 100, 700), ("chr1", 120, 130), ("chr2", 0, 200)], "chrom string, start long, stop long")
    for kept in (False, True):
        got = randomness.shuffle(rows_, genome, 7, out, kept).collect()
        assert sorted(r["ord"] for r in got) == list(range(400)) and got == randomness.shuffle(rows_, genome, 7, out, kept).collect()
        for r in got:
            assert 0 <= r["start"] and r["stop"] <= {"chr1": 1000, "chr2": 500}[r["chrom"]] and r["stop"] - r["start"] == r["ord"] % 90
            assert not any(r["chrom"] == c and a < r["stop"] and r["start"] < b for c, a, b in (("chr1", 100, 700), ("chr2", 0, 200)))
            assert not kept or r["chrom"] == ("chr1" if r["ord"] % 2 else "chr2")
    starts = [r["start"] for r in randomness.shuffle(rows_, genome, 7).where("chrom = 'chr1'").collect()]
    assert 150 < len(starts) and 350 < sum(starts) / len(starts) < 600
    with pytest.raises(Exception, match="no chromosome has room"):
        randomness.shuffle(rows_.withColumn("stop", rows_.stop + 2000), genome).collect()


def plain_shuffle(n, seed):
    """Every swap of the shuffle, one after another."""
    x, order = seed, list(range(n))
    for i in range(n - 1, 0, -1):
        x = (x ^ (x << 13)) % 2**64
        x = x ^ (x >> 7)
        x = (x ^ (x << 17)) % 2**64
        order[i], order[x % (i + 1)] = order[x % (i + 1)], order[i]
    return order


def test_sample_exact_is_the_whole_shuffle(spark, monkeypatch):
    df = spark.range(300).selectExpr("id * 7 as ord", "id as x")
    got = {r["place"]: r["x"] for r in rows.sample_exact(df, 40, 9).collect()}
    assert [got[p] for p in range(40)] == plain_shuffle(300, 9)[:40]
    for n, first, seed in ((0, 5, 1), (1, 1, 1), (2, 1, 3), (50, 50, 4), (50, 80, 4), (3000, 1, 42), (20_000, 300, 42)):
        assert rows.permuted(spark, n, first, seed) == plain_shuffle(n, seed)[:first]
    draws = rows.XorShift(42)
    assert draws.numbers(5001, 3000).tolist() == draws.numbers(1, 8000).tolist()[5000:]
    monkeypatch.setattr(rows, "OWN", 1000)  # ranges are drawn by tasks
    monkeypatch.setattr(rows, "DRAWN", 700)
    assert rows.permuted(spark, 20_000, 60, 42) == plain_shuffle(20_000, 42)[:60]


def test_subtract_closest_jaccard_against_brute_force(spark):
    import random

    rng = random.Random(3)
    make = lambda n: [(f"c{rng.randrange(3)}", s, s + rng.randrange(0 if k % 5 == 0 else 1, 30), k) for k in range(n) for s in [rng.randrange(400)]]
    a, b = make(60), make(40)
    b = [x for x in b if x[0] != "c2"]
    da, db = (spark.createDataFrame(x, "chrom string, start long, stop long, ord long") for x in (a, b))
    held = {(c, p) for c, s, e, _ in b for p in range(s, e)}
    want = []
    for c, s, e, o in a:
        free = [p for p in range(s, e) if (c, p) not in held]
        want += [(c, p, o) for p in free]
    got = [(r["chrom"], p, r["ord"]) for r in rangejoin.subtract(da, db).collect() for p in range(r["start"], r["stop"])]
    assert sorted(got) == sorted(want)
    near = []
    for c, s, e, o in a:
        hits = [k for d, x, y, k in b if d == c and (s <= x < e or x < s < y)]
        gaps = {k: (s - y if y <= s and x < s else x - e if x >= e else None) for d, x, y, k in b if d == c}
        gaps = {k: g for k, g in gaps.items() if g is not None}
        near += [(o, k) for k in hits or [k for k, g in gaps.items() if g == min(gaps.values())] or [None]]
    assert sorted(near, key=str) == sorted(((r["a_ord"], r["b_ord"]) for r in nearest.closest(da, db).collect()), key=str)
    one = {(c, p) for c, s, e, _ in a for p in range(s, e)}
    j = rangejoin.jaccard(da, db).first()
    both = one & held
    assert (j["intersection"], j["union"], j["n_intersections"]) == (len(both), len(one | held), sum((c, p - 1) not in both for c, p in both))


def test_rows(small, genome):
    assert rows.unique(small).count() == 5
    assert rows.makewindows(genome, 100).count() == 15
    assert [r["len"] for r in rows.lengths(small).orderBy("ord").collect()] == [20, 30, 20, 40, 30, 30]
    assert sorted(plain_shuffle(20, 7)) == list(range(20))
    assert [r["ord"] for r in rows.sample(small, 3).collect()] == [r["ord"] for r in rows.sample(small, 3).collect()]


def test_stats_and_groups(small):
    s = aggregates.stats(small).first()
    assert (s["n"], s["total_bases"], round(s["mean_len"], 1), s["median_len"], s["min_len"], s["max_len"]) == (6, 170, 28.3, 30.0, 20, 40)
    wanted = [("score", "sum"), ("score", "collapse"), ("name", "first"), ("name", "count_distinct")]
    got = [tuple(r)[1:] for r in aggregates.group_runs(small, ["chrom"], wanted).orderBy("run").collect()]
    assert got == [("chr1", 600.0, "100,200,300", "geneA", 3), ("chr2", 650.0, "150,250,250", "geneD", 2)]
    with pytest.raises(ValueError, match="no such operation"):
        aggregates.group_runs(small, ["chrom"], [("score", "mode")])


def test_text_round_trip(spark, tmp_path):
    p = tmp_path / "x.bed"
    p.write_bytes(b"track a\n# c\nchr1\t5\t9\tn\t1\t+\r\nchr1\t7\tx\nchr2\t1\n\nchr3\t+4\t6\n")
    got = [(r["chrom"], r["start"], r["stop"], r["name"], r["strand"]) for r in text.read_bed(spark, str(p), "skip").orderBy("ord").collect()]
    assert got == [("chr1", 5, 9, "n", "+"), ("chr3", 4, 6, None, None)]
    assert text.read_bed(spark, str(p), "zero").count() == 3
    with pytest.raises(Exception, match="no coordinate"):
        text.read_bed(spark, str(p)).collect()
    assert [r["error"] for r in text.validate(text.read_lines(spark, str(p))).orderBy("ord").collect()] == ["bad end", "fewer than 3 fields"]


def test_sequences(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">s1 words\nACGT\nacgt\nNN\n>s2\nTTTT\n")
    fa = text.read_fasta(spark, str(p))
    assert [(r["name"], r["seq"], r["width"]) for r in fa.orderBy("ord").collect()] == [("s1", "ACGTacgtNN", 4), ("s2", "TTTT", 4)]
    bed = spark.createDataFrame([("s1", 2, 6, "a", 0), ("s1", 4, 8, "b", 1), ("s2", 3, 9, "c", 2), ("s9", 0, 1, "d", 3)], "chrom string, start long, stop long, name string, ord long")
    assert sorted(r["header"] for r in sequences.get_fasta(bed, fa).collect()) == ["s1:2-6", "s1:4-8"]
    assert {r["name"]: r["seq"] for r in sequences.mask_fasta(fa, bed).collect()} == {"s1": "ACNNNNNNNN", "s2": "TTTN"}
    assert {r["name"]: r["seq"] for r in sequences.mask_fasta(fa, bed, soft=True).collect()} == {"s1": "ACgtacgtNN", "s2": "TTTt"}
    assert [r["n_g"] for r in sequences.nuc(bed, fa).orderBy("ord").collect()] == [1, 1, 0, 0]
    assert [r["line"] for r in sequences.wrapped(fa).orderBy("ord", "k").collect()] == [">s1", "ACGT", "acgt", "NN", ">s2", "TTTT"]


def brute_cluster(lines, distance):
    """The reach of one cluster, line by line."""
    out, last, reach, n = [], None, 0, 0
    for chrom, start, stop in lines:
        if chrom != last or start > reach + distance:
            n, reach, last = n + 1, stop, chrom
        else:
            reach = max(reach, stop)
        out.append(n)
    return out


def test_cluster_in_line_order(spark, monkeypatch):
    assert brute_cluster([("c1", 10, 20), ("c2", 5, 9), ("c1", 15, 25)], 0) == [1, 2, 3]
    monkeypatch.setattr(scan, "WIDTH", 8)
    rng = random.Random(5)
    for seed, distance in ((1, 0), (2, 7), (3, -5), (4, -40)):
        lines = []
        for _ in range(150):
            chrom = lines[-1][0] if lines and rng.random() < 0.85 else rng.choice(["c1", "c2", "c3"])
            start = rng.randrange(-60, 200)
            lines.append((chrom, start, start + rng.choice([-3, 0, 4, 30, 90])))
        ords = sorted(rng.sample(range(-300, 900), len(lines)))
        df = spark.createDataFrame([(*x, o, "kept") for x, o in zip(lines, ords, strict=True)], "chrom string, start long, stop long, ord long, _reach string").repartition(5, "start")
        got = [r["cluster"] for r in islands.cluster(df, distance).orderBy("ord").collect()]
        assert got == brute_cluster(lines, distance), (seed, distance)
    assert islands.cluster(df.limit(0)).count() == 0


def test_running_in_both_directions_over_many_stretches(spark):
    """Each kind of running value, with and without a key, over stretches of stretches, against plain loops."""
    rng = random.Random(6)
    rows = [(rng.choice("xy"), p, rng.randrange(-9, 10)) for p in rng.sample(range(-500, 5000), 300)]
    df = spark.createDataFrame(rows, "chrom string, pos long, v long").repartition(6)
    kinds = {f"{fn}_{where}": (fn, "v", where) for fn in ("sum", "max", "min") for where in ("upto", "before", "from", "after")}
    for by, fan in ((["chrom"], 4), ([], 4), ([], 1)):
        old, scan.FAN = scan.FAN, fan
        got = scan.running(df, by, ["pos"], "pos", 16, **kinds).collect()
        scan.FAN = old
        assert len(got) == len(rows)
        for r in got:
            same = [(p, v) for c, p, v in rows if not by or c == r["chrom"]]
            for name, (fn, _, where) in kinds.items():
                inside = {"upto": lambda p: p <= r["pos"], "before": lambda p: p < r["pos"], "from": lambda p: p >= r["pos"], "after": lambda p: p > r["pos"]}[where]  # noqa: B023
                found = [v for p, v in same if inside(p)]
                assert r[name] == ({"sum": sum, "max": max, "min": min}[fn](found) if found else None)


def test_scans_read_their_input_once(spark, small, b, genome):
    """An operator's plan reads written tables, not its input again and again."""
    from gapwise.operators import sweep

    for made in (islands.merge(small), islands.complement(small, genome), sweep.multiinter([small, b, b], ["x", "y", "z"]), sweep.genomecov(small, genome), islands.cluster(small)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") + plan.count("LocalRelation") + plan.count("LogicalRDD") <= 8, plan


def test_a_hot_locus_is_one_row_of_a_scan(spark, monkeypatch):
    """However many rows lie or ask at one position, a stretch holds the position once."""
    held = []
    real = scan.materialize
    monkeypatch.setattr(scan, "materialize", lambda df, *a: held.append(df) or real(df, *a))
    many = spark.range(20_000).select(F.lit("c").alias("chrom"), F.lit(500).cast("long").alias("start"), (F.lit(600) + F.col("id") % 3).alias("stop"), F.col("id").alias("ord"))
    got = scan.around(many, F.col("start"), many, (F.col("stop"), F.col("stop")), (F.col("start"), F.col("start")))
    assert got.count() == 20_000 and {(r["left"], r["right"]) for r in got.select("left", "right").distinct().collect()} == {(None, 500)}
    assert max(h.count() for h in held) <= 6


def test_sequences_over_many_blocks(spark, tmp_path, monkeypatch):
    """Regions, masks, counts and lines that cross blocks equal plain slicing; no row is above the block size."""
    monkeypatch.setattr(sequences, "BLOCK", 7)
    rng = random.Random(8)
    seqs = {f"s{i}": "".join(rng.choice("ACGTNacgtn-é") for _ in range(n)) for i, n in enumerate((0, 1, 6, 7, 8, 50, 200))}
    p = tmp_path / "x.fa"
    width = {n: rng.choice([3, 7, 10, 60]) for n in seqs}
    p.write_text("no record\n" + "".join(f">{n} more words\n" + "".join(s[i : i + width[n]] + rng.choice(["\n", "\r\n", " \n"]) for i in range(0, len(s), width[n])) + "\n" * (len(s) % 2) for n, s in seqs.items()))
    fa = text.read_fasta_blocks(spark, str(p))
    assert max(r["n"] for r in fa.select(F.length("seq").alias("n")).collect()) == 7
    assert {r["name"]: (r["seq"], r["header"]) for r in text.read_fasta(spark, str(p)).collect()} == {n: (s, f"{n} more words") for n, s in seqs.items()}
    bed = []
    for i in range(120):
        a = rng.randrange(0, 210)
        bed.append((rng.choice([*seqs, "s9"]), a, a + rng.choice([0, 1, 3, 7, 20, 100, -2]), f"r{i}", i))
    df = spark.createDataFrame(bed, "chrom string, start long, stop long, name string, ord long").repartition(3)
    for source in (fa, spark.createDataFrame([(n, s, i, width[n]) for i, (n, s) in enumerate(seqs.items())], "name string, seq string, ord long, width int")):
        want = {o: seqs[c][a:b] for c, a, b, _, o in bed if c in seqs and a < b <= len(seqs[c])}
        assert {r["ord"]: r["seq"] for r in sequences.get_fasta(df, source).collect()} == want
        assert {r["ord"]: r["seq"] for r in sequences.to_fasta(df, source).collect()} == {o: seqs[c][a : max(a, b)] for c, a, b, _, o in bed if c in seqs}
        counted = {r["ord"]: (r["n_a"], r["n_n"], r["n_other"], r["seq_len"]) for r in sequences.nuc(df, source).collect()}
        cut = {o: seqs.get(c, "")[a : max(a, b)].upper() for c, a, b, _, o in bed}
        assert counted == {o: (s.count("A"), s.count("N"), sum(x not in "ACGTN" for x in s), len(s)) for o, s in cut.items()}
        for soft in (False, True):
            held = {n: "".join((x.lower() if soft else "N") if any(c == n and a <= i < b for c, a, b, *_ in bed) else x for i, x in enumerate(s)) for n, s in seqs.items()}
            masked = sequences.mask_fasta(source, df, soft)
            got = {r["name"]: r["seq"] for r in (sequences.whole(masked) if source is fa else masked).collect()}
            assert got == held
        lines = [r["line"] for r in sequences.wrapped(source).orderBy("ord", "k").collect()]
        assert lines == [x for n, s in seqs.items() for x in [f">{n}", *(s[i : i + width[n]] for i in range(0, len(s), width[n]))]]
    assert sequences.get_fasta(df.limit(0), fa).count() == 0 and sequences.nuc(df.where("chrom = 's9'"), fa).where("seq_len > 0").count() == 0


def test_ranks_against_pairs(spark, monkeypatch):
    """Counts, sums and shared bases by ranks, with empty rows, repeated ones and equal starts, over many stretches."""
    monkeypatch.setattr(scan, "WIDTH", 16)
    rng = random.Random(9)
    for size in (0, 60):
        made = lambda n: [(rng.choice("xyz"), s, s + rng.choice([0, 0, 1, 5, 40]), rng.randrange(-9, 9), i) for i in range(n) for s in [rng.randrange(-20, 90)]]  # noqa: E731, B023
        a, b = made(80), made(size)
        kind = "chrom string, start long, stop long, score long, ord long"
        da, db = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
        met = {x[4]: [y for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]] for x in a}
        for op, fn in (("count", len), ("sum", sum), ("mean", lambda v: sum(v) / len(v)), ("min", min)):
            got = {r["ord"]: r["value"] for r in rangejoin.map_values(da, db, op).collect()}
            assert got == {o: float(fn([y[3] for y in ys])) if ys else None for o, ys in met.items()}, op
        r = rangejoin.overlap_stats(da, db).first()
        assert (r["a_count"], r["b_count"]) == (len(a), len(b))
        assert r["overlap_bases"] == sum(min(x[2], y[2]) - max(x[1], y[1]) for x in a for y in met[x[4]])
        assert (r["a_with_overlap"], r["b_with_overlap"]) == (sum(map(bool, met.values())), len({y[4] for ys in met.values() for y in ys}))
        n = sum(x[0] == y[0] and (x[1] == y[1] or x[1] < y[2] and y[1] < x[2]) for x in a for y in b)
        g = spark.createDataFrame([("x", 1000), ("y", 1000), ("z", 1000)], "chrom string, size long")
        assert rangejoin.fisher(da, db, g).first()["n11"] == n


def test_binned_table_is_met_where_it_lies(spark):
    rng = random.Random(10)
    made = lambda n, most: [(rng.choice("xyz"), s, s + rng.choice([0, 1, 30, most]), i) for i in range(n) for s in [rng.randrange(0, 100_000)]]
    a, b = made(400, 50_000), made(500, 3000)
    kind = "chrom string, start long, stop long, ord long"
    da, db = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    table = rangejoin.BinnedTable.write(db, "b_in_bins", 6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):
            pairs = rangejoin.overlap_pairs(da, rangejoin.BinnedTable(spark, "b_in_bins"))
            plan = pairs._jdf.queryExecution().executedPlan().toString()
            below = plan.split("FileScan parquet")[0].rsplit("Join", 1)[1]
            assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and below.count("Exchange") == 1, plan
            want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
            assert sorted((r["a_ord"], r["b_ord"]) for r in pairs.collect()) == want
        assert sorted(map(tuple, rangejoin.intersect(da, table).collect())) == sorted(map(tuple, rangejoin.intersect(da, db).collect()))
        assert rangejoin.window(da, table, 50).count() == rangejoin.window(da, db, 50).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE b_in_bins")
    with pytest.raises(Exception, match="b_in_bins|not found"):
        rangejoin.BinnedTable(spark, "b_in_bins")


def test_row_wise_operators_on_a_stream(spark, tmp_path, genome):
    """Lines that arrive as files, parsed and changed row by row, give what the same lines give at once."""
    (tmp_path / "in").mkdir()
    lines = [f"chr{1 + i % 2}\t{i * 7}\t{i * 7 + 20}\tn{i}\t5\t{'+-'[i % 2]}" for i in range(20)]
    for k in range(2):
        (tmp_path / "in" / f"{k}.bed").write_text("# head\n" + "\n".join(lines[k * 10 : k * 10 + 10]) + "\n")
    read = spark.readStream.text(str(tmp_path / "in")).select(F.col("value").alias("line"), F.xxhash64("value").alias("ord"))
    once = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.xxhash64("line").alias("ord"))
    operators = {"slop": lambda d: rows.slop(d, genome, 5, 9), "flank": lambda d: rows.flank(d, genome, 5, 9), "shift": lambda d: rows.shift(d, genome, 30), "resize": lambda d: rows.resize(d, 11), "midpoint": rows.midpoint, "promoters": rows.promoters, "len": rows.lengths, "flank_bp": lambda d: rows.flank_bp(d, 3)}
    for name, op in operators.items():
        bed = text.parse_bed(read)
        assert bed.isStreaming
        query = op(bed).writeStream.format("memory").queryName(f"streamed_{name}").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"at-{name}")).start()
        query.awaitTermination(60)
        got = sorted(map(str, spark.table(f"streamed_{name}").collect()))
        assert got == sorted(map(str, op(text.parse_bed(once)).collect())) and got, name


def test_bed_source_is_read_bed(spark, tmp_path, genome):
    from gapwise.sources import bed

    spark.dataSource.register(bed.BedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rng = random.Random(11)
    folder = tmp_path / "beds"
    folder.mkdir()
    for k in range(3):
        body = [f"chr{c}\t{s}\t{s + 9}" + rng.choice(["", "\tn", f"\tn{s}\t5\t+\textra\té"]) + rng.choice(["", "\r"]) for c in range(1, 5) for s in sorted(rng.sample(range(900), 40))]
        (folder / f"{k}.bed").write_text("track x\n# head\n\n" + "\n".join(body) + ("" if k else "\n") + "\nfew\tcells" * (k == 1))
    columns = ["chrom", "start", "stop", "name", "score", "strand", "rest"]
    told = lambda df: list(map(tuple, df.orderBy("ord").select(columns).collect()))
    want = told(text.read_bed(spark, str(folder)))
    read = lambda **o: spark.read.format("bed").options(**o).load(str(folder))
    assert told(read(splitbytes=900)) == want and len(want) == 480
    for path, n in bed._files(str(folder)):  # every line is of one split, with its place, wherever splits begin
        body = (folder / path).read_bytes()
        for size in (1, 2, 7, 100, 1 << 20):
            lines = [(x, p) for lo in range(0, n, size) for held, at in bed._lines(bed.Split(path, 0, lo, min(lo + size, n))) for x, p in zip(held, at, strict=True) if x]
            assert [x for x, _ in lines] == [x for x in body.split(b"\n") if x] and all(body[p : p + len(x)] == x for x, p in lines)
    two = read(splitbytes=250, sorted="true").where("chrom in ('chr2', 'chr4') and start > 100")
    assert told(two) == [r for r in want if r[0] in ("chr2", "chr4") and r[1] > 100]
    assert told(read().where("chrom = 'chr3'")) == [r for r in want if r[0] == "chr3"]
    assert two.rdd.getNumPartitions() < read(splitbytes=250).rdd.getNumPartitions() * 0.8
    assert rows.slop(read(), genome, 5, 5).count() == 480

    (tmp_path / "bad").write_text("chr1\tx\t5\nchr1\t1\t5\nchr1\t2\n")
    bad = lambda how: [(r["start"], r["stop"]) for r in spark.read.format("bed").option("onbad", how).load(str(tmp_path / "bad")).orderBy("ord").collect()]
    assert bad("skip") == [(1, 5)] and bad("zero") == [(0, 5), (1, 5)]
    with pytest.raises(Exception, match="no coordinate"):
        bad("error")
    (tmp_path / "none").mkdir()
    assert spark.read.format("bed").load(str(tmp_path / "none")).count() == 0

    at = tmp_path / "at"
    for turn in range(2):  # a second file comes between two runs
        stream = rows.slop(spark.readStream.format("bed").load(str(tmp_path / "none")), genome, 5, 9)
        (tmp_path / "none" / f"{turn}.bed").write_text("".join(f"chr1\t{20 + i}\t{30 + i}\n" for i in range(5 + turn)))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(at)).trigger(availableNow=True).start().awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out"))
        assert got.count() == (5, 11)[turn] and got.agg(F.min("start"), F.max("stop")).first() == ((15, 43), (15, 44))[turn]


def test_many_files_in_one_state(spark, monkeypatch):
    """Sets and values of many files equal those of a column for each; the plan's size does not depend on the number of files."""
    rng = random.Random(13)

    def made(n):
        out = []
        for f in range(n):
            at = -30
            for _ in range(25):
                at += rng.choice([0, 1, 5, 400])
                out.append((rng.choice("xy"), at, at + rng.choice([0, 3, 50, 900]), str(rng.randrange(4)), f))
                at = out[-1][2]
        return out

    def apart(rows):  # in each file and chromosome
        return [r for r in rows if not any(o[4] == r[4] and o[0] == r[0] and o[1] < r[2] and r[1] < o[2] for o in rows if o is not r)]

    kind = "chrom string, start long, stop long, value string, f int"
    rows_ = apart(made(5))
    files = [spark.createDataFrame([r for r in rows_ if r[4] == f], kind) for f in range(5)]
    names = list("abcde")
    told = lambda df: sorted(map(tuple, df.collect()))
    real = sweep._states
    want = told(sweep.multiinter(files, names)), told(sweep.unionbedg(files, names))
    monkeypatch.setattr(sweep, "WIDE", 2)
    monkeypatch.setattr(sweep, "_states", lambda turns: real(turns, 32))
    assert (told(sweep.multiinter(files, names)), told(sweep.unionbedg(files, names))) == want and want[0] and want[1]
    sizes = []
    for n in (20, 200):
        df = spark.createDataFrame(made(n), kind)
        on = sweep.covers(df)
        sizes.append(len(on._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        deepest = on.agg(F.max(F.size("files"))).first()[0]
    assert sizes[0] == sizes[1] and deepest > 20
    assert sweep.covers(df.limit(0)).count() == 0


def odd(n, most, seed, chroms="xyz"):
    """Rows with and without length, some that touch, some long."""
    rng = random.Random(seed)
    return [(rng.choice(chroms), s, s + rng.choice([0, 1, 5, 30, most]), i) for i in range(n) for s in [rng.randrange(0, 3000)]]


KIND_4 = "chrom string, start long, stop long, ord long"


def joined(df):
    """The columns of each side of each join below, as they are shuffled."""
    found, left = [], [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        kids = node.children()
        kids = [kids.apply(i) for i in range(kids.size())]
        if node.nodeName() == "Join":
            found += [[x.output().apply(i).name() for i in range(x.output().size())] for x in kids]
        left += kids
    return found


def test_window_shuffles_each_column_once_and_is_whole(spark):
    for seed, most in ((4, 40), (5, 2500)):
        a, b = odd(150, most, seed), odd(100, 2 * most, seed + 10)
        da, db = spark.createDataFrame(a, KIND_4), spark.createDataFrame(b, KIND_4)
        for w in (0, 70):
            want = sorted((x[3], x[1], x[2], y[3]) for x in a for y in b if x[0] == y[0] and max(x[1] - w, 0) < y[2] and y[1] < x[2] + w)
            for levels in (None, [8, 512, 32768]):
                found = rangejoin.window(da, db, w, levels)
                assert sorted((r["a_ord"], r["a_start"], r["a_stop"], r["b_ord"]) for r in found.collect()) == want
    sides = joined(rangejoin.window(da, db, 70, [4096]))
    assert sorted(sides) == [["a_chrom", "a_start", "a_stop", "a_ord", "_ja"], ["b_chrom", "b_start", "b_stop", "b_ord", "_jb"]], sides


def nearest_plainly(a, b):
    """Pairs of ord as closest has them."""
    out = []
    for c, s, e, o in a:
        own = [(x, y, k) for d, x, y, k in b if d == c]
        hits = [k for x, y, k in own if s <= x < e or x < s < y]
        gaps = [(s - y, k) for x, y, k in own if y <= s and x < s] + [(x - e, k) for x, y, k in own if x >= e]
        out += [(o, k) for k in hits or [k for g_, k in gaps if g_ == min(gaps)[0]] or [None]]
    return sorted(set(out), key=str)


@pytest.mark.parametrize("most_rows", [200_000, 3])
def test_closest_shuffles_no_pairs_and_is_right_beside_islands(spark, monkeypatch, most_rows):
    from gapwise import tables

    monkeypatch.setattr(tables.pinned, "__defaults__", (most_rows,))
    for seed, n in ((1, 60), (2, 12), (3, 3)):
        a, b = odd(150, 200, seed, "xyzw"), odd(n, 40, seed + 10)
        a += [("x", s, s, 1000 + s) for s in (10, 20)]
        b += [("x", 0, 10, 1000), ("x", 10, 20, 1001), ("x", 20, 20, 1002)]  # they touch where a has rows without length
        da, db = spark.createDataFrame(a, KIND_4), spark.createDataFrame(b, KIND_4)
        found = nearest.closest(da, db)
        assert sorted(((r["a_ord"], r["b_ord"]) for r in found.collect()), key=str) == nearest_plainly(a, b)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan, plan
    alone = spark.createDataFrame(a, KIND_4)
    none = nearest.closest(alone, db.limit(0)).collect()
    assert sorted((r["a_ord"], r["b_chrom"], r["b_start"], r["b_ord"]) for r in none) == sorted((x[3], ".", -1, None) for x in a)


def test_intersect_shuffles_and_sorts_by_little(spark):
    a, b = odd(150, 900, 6), odd(100, 40, 16)
    da, db = spark.createDataFrame(a, KIND_4), spark.createDataFrame(b, KIND_4)
    want = sorted((x[0], max(x[1], y[1]), min(x[2], y[2]), x[3]) for x in a for y in b if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2]))
    for levels in (None, [16, 1024]):
        assert sorted(map(tuple, rangejoin.intersect(da, db, levels).collect())) == want
    found = rangejoin.intersect(da, db, [4096])
    assert sorted(joined(found)) == [["a_chrom", "a_start", "a_stop", "a_ord", "_ja"], ["b_chrom", "b_start", "b_stop", "_jb"]]


def test_binned_table_holds_a_row_once_for_each_bin_and_meets_long_rows(spark):
    a, b = odd(150, 60_000, 7), odd(200, 40, 17)
    b += [("x", 100, 90_000, 5000), ("y", 0, 30_000, 5001)]  # of a coarser level
    da, db = spark.createDataFrame(a, KIND_4), spark.createDataFrame(b, KIND_4)
    table = rangejoin.BinnedTable.write(db, "b_once", 4)
    try:
        assert len(table.levels) == 2 and table.rows().groupBy("b_ord").agg(F.count_distinct("_level").alias("n")).where("n > 1").count() == 0
        short = [x for x in a if x[2] - x[1] < 1000]
        for rows_ in (a, short):
            for w in (0, 70):
                want = sorted((x[3], y[3]) for x in rows_ for y in b if x[0] == y[0] and max(x[1] - w, 0 if w else x[1]) < y[2] and y[1] < x[2] + w)
                found = rangejoin.window(spark.createDataFrame(rows_, KIND_4), table, w)
                assert sorted((r["a_ord"], r["b_ord"]) for r in found.collect()) == want
        plain = [x for x in b if x[3] < 5000]
        assert joined(rangejoin.window(spark.createDataFrame(short, KIND_4), rangejoin.BinnedTable.write(spark.createDataFrame(plain, KIND_4), "b_plain", 4), 70))[0][-2:] == ["_othera", "_ja"]
    finally:
        spark.sql("DROP TABLE IF EXISTS b_once")
        spark.sql("DROP TABLE IF EXISTS b_plain")
