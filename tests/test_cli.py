"""The command line on hand-made files: what each operator prints, in order."""

import io

import pytest

from gapwise import cli

SMALL = "chr1\t10\t30\tgeneA\t100\t+\nchr1\t20\t50\tgeneB\t200\t-\nchr1\t80\t100\tgeneC\t300\t+\nchr2\t0\t40\tgeneD\t150\t+\nchr2\t60\t90\tgeneE\t250\t-\nchr2\t60\t90\tgeneE\t250\t-\n"
B = "chr1\t25\t45\tfeat1\t0\t+\nchr2\t50\t70\tfeat2\t0\t-\n"
FILES = {
    "small": "# head\n" + SMALL, "b": B, "genome": "chr1\t1000\nchr2\t500\n", "map": "chr1\tone\n", "mixed": "chr2\t5\t9\tx\t1\t+\tmore\nchr1\t10\t12\nchr1\t2\t30\ta\n",
    "fa": ">chr1 first\nACGTACGT\nACGTNNNN\n>chr2\nTTTTTTTT\n", "reg": "chr1\t2\t6\tr1\nchr2\t1\t3\tr2\textra\n", "bad": "chr1\t5\t2\nchr1\tx\t4\nchr1\t1\n", "gff": "\t".join(["chr1", "s", "gene", "15", "35", ".", "+", ".", "gene_name=BRCA1"]) + "\n",
    "lines": "c1\t10\t20\nc2\t5\t9\nc1\t15\t25\nc1\t-30\t-20\nc3\t-9\t-5\tx\n", "ends": "chr1\t5\tten\nchr2\t0\t07\tn\t3\t+\n", "past": "chr1\t3\t3\nchr2\t2\t9\nchr2\t0\t8\n" + "chr1\t20\t21\n" * 150,
    "g1": "chr2\t0\t10\t1.0\nchr1\t0\t5\t2.5\n", "g2": "chr1\t3\t8\t7\n",
}
CASES = [
    (["sort", "mixed"], ["chr1\t2\t30\ta", "chr1\t10\t12", "chr2\t5\t9\tx\t1\t+\tmore"]),
    (["sort-name", "mixed"], ["chr1\t10\t12", "chr1\t2\t30\ta", "chr2\t5\t9\tx\t1\t+\tmore"]),
    (["sort-size", "mixed", "--descending"], ["chr1\t2\t30\ta", "chr2\t5\t9\tx\t1\t+\tmore", "chr1\t10\t12"]),
    (["merge", "small"], ["chr1\t10\t50", "chr1\t80\t100", "chr2\t0\t40", "chr2\t60\t90"]),
    (["complement", "small", "genome"], ["chr1\t0\t10", "chr1\t50\t80", "chr1\t100\t1000", "chr2\t40\t60", "chr2\t90\t500"]),
    (["intersect", "small", "b"], ["chr1\t25\t30\tgeneA\t100\t+", "chr1\t25\t45\tgeneB\t200\t-", *["chr2\t60\t70\tgeneE\t250\t-"] * 2]),
    (["closest", "mixed", "b"], ["chr2\t5\t9\tx\t1\t+\tmore\tchr2\t50\t70\tfeat2\t0\t-", "chr1\t10\t12\tchr1\t25\t45\tfeat1\t0\t+", "chr1\t2\t30\ta\tchr1\t25\t45\tfeat1\t0\t+"]),
    (["annotate", "small", "gff"], [f"{x}\t{y}" for x, y in zip(SMALL.splitlines(), ["BRCA1\t0", "BRCA1\t0", "BRCA1\t55", ".\t.", ".\t.", ".\t."], strict=True)]),
    (["map", "b", "small", "--column", "5"], ["chr1\t25\t45\tfeat1\t0\t+\t150", "chr2\t50\t70\tfeat2\t0\t-\t250"]),
    (["stats", "small"], ["count\t6", "total_bases\t170", "mean_len\t28.3", "median_len\t30.0", "min_len\t20", "max_len\t40"]),
    (["coverage-hist", "small"], ["count\t6", "total_bp\t170", "min\t20", "max\t40", "mean\t28.3", "median\t30"]),
    (["jaccard", "small", "b"], ["intersection\tunion\tjaccard\tn_intersections", "30\t140\t0.214286\t2"]),
    (["overlap", "small", "b"], ["{", '  "a_count": 6,', '  "b_count": 2,', '  "a_with_overlap": 4,', '  "b_with_overlap": 2,', '  "a_bases": 170,', '  "b_bases": 40,', '  "overlap_bases": 45,', f'  "jaccard": {45 / 165}', "}"]),
    (["genomecov", "small", "genome"], ["chr1\t0\t940\t1000\t0.94", "chr1\t1\t50\t1000\t0.05", "chr1\t2\t10\t1000\t0.01", "chr2\t0\t430\t500\t0.86", "chr2\t1\t40\t500\t0.08", "chr2\t2\t30\t500\t0.06", "genome\t0\t1370\t1500\t0.913333", "genome\t1\t90\t1500\t0.06", "genome\t2\t40\t1500\t0.0266667"]),
    (["groupby", "small", "--keys", "1", "--by", "5,4", "--op", "mean,collapse"], ["chr1\t200\tgeneA,geneB,geneC", "chr2\t216.6666667\tgeneD,geneE,geneE"]),
    (["total-span", "small"], ["chr1\t90", "chr2\t90", "total\t180"]),
    (["tail", "small", "--n", "1"], ["# head", "chr2\t60\t90\tgeneE\t250\t-"]),
    (["rename", "small", "map"], ["# head", *(x.replace("chr1", "one") for x in SMALL.splitlines())]),
    (["unionbedg", "g1", "g2", "--header", "--names", "x,y"], ["chrom\tstart\tend\tx\ty", "chr2\t0\t10\t1.0\t0", "chr1\t0\t3\t2.5\t0", "chr1\t3\t5\t2.5\t7", "chr1\t5\t8\t0\t7"]),
    (["multiinter", "small", "b"], ["chr1\t10\t25\t1\t1\t1\t0", "chr1\t25\t45\t2\t1,2\t1\t1", "chr1\t45\t50\t1\t1\t1\t0", "chr1\t80\t100\t1\t1\t1\t0", "chr2\t0\t40\t1\t1\t1\t0", "chr2\t50\t60\t1\t2\t0\t1", "chr2\t60\t70\t2\t1,2\t1\t1", "chr2\t70\t90\t1\t1\t1\t0"]),
    (["getfasta", "reg", "fa"], [">chr1:2-6", "GTAC", ">chr2:1-3", "TT"]),
    (["nuc", "reg", "fa"], ["#1_usercol\t2_usercol\t3_usercol\t4_usercol\t5_usercol\t6_pct_at\t7_pct_gc\t8_num_A\t9_num_C\t10_num_G\t11_num_T\t12_num_N\t13_num_oth\t14_seq_len", "chr1\t2\t6\tr1\t\t0.500000\t0.500000\t1\t1\t1\t1\t0\t0\t4", "chr2\t1\t3\tr2\textra\t1.000000\t0.000000\t0\t0\t0\t2\t0\t0\t2"]),
    (["maskfasta", "fa", "reg"], [">chr1", "ACNNNNGT", "ACGTNNNN", ">chr2", "TNNTTTTT"]),
    (["getfasta", "past", "fa"], [">chr2:0-8", "TTTTTTTT"]),
    (["to-fasta", "reg", "fa"], [">chr1:2-6_r1", "GTAC", ">chr2:1-3_r2", "TT"]),
    (["cluster", "lines"], ["c1\t10\t20\t1", "c2\t5\t9\t2", "c1\t15\t25\t3", "c1\t-30\t-20\t3", "c3\t-9\t-5\tx\t4"]),
    (["cluster", "lines", "--distance", "-12"], ["c1\t10\t20\t1", "c2\t5\t9\t2", "c1\t15\t25\t3", "c1\t-30\t-20\t3", "c3\t-9\t-5\tx\t4"]),
    (["shift", "lines", "genome", "--size", "40"], ["c1\t50\t60", "c2\t45\t49", "c1\t55\t65", "c1\t10\t20", "c3\t31\t35"]),
    (["to-gff", "ends", "--source", "own", "--type", "peak"], ["##gff-version 3", "chr1\town\tpeak\t6\tten\t.\t.\t.\tName=.", "chr2\town\tpeak\t1\t07\t3\t+\t.\tName=n"]),
    (["reldist", "small", "b"], ["reldist\tcount\ttotal\tfraction"]),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    for name, body in FILES.items():
        (d / name).write_text(body)
    return d


def told(folder, capsys, args):
    code = cli.main([args[0], *(str(folder / x) if x in FILES else x for x in args[1:])])
    return code, capsys.readouterr()


@pytest.mark.parametrize(("args", "want"), CASES, ids=lambda x: x[0] if isinstance(x, list) and len(x[0]) < 20 else "")
def test_prints(folder, capsys, args, want):
    code, out = told(folder, capsys, args)
    assert code == 0 and out.out.splitlines() == want


def test_fisher_report(folder, capsys):
    out = told(folder, capsys, ["fisher", "small", "b", "genome"])[1].out.splitlines()
    assert len(out) == 14 and out[3].endswith(": 29") and out[8] == "#     in -a | 4            | 2            |" and out[-1] == "1\t0.00063155\t0.00063155\tinf"


def test_validate_tells_lines_and_fails(folder, capsys):
    code, out = told(folder, capsys, ["validate", "bad"])
    assert code == 1 and out.err.splitlines() == ["INVALID: 2 records, 3 errors:", "  line 1: start after end", "  line 2: bad start", "  line 3: fewer than 3 fields"]
    code, out = told(folder, capsys, ["validate", "small"])
    assert code == 0 and out.err.splitlines() == ["OK: 6 records, no errors"]


def test_leniency_by_operator(folder, capsys):
    assert told(folder, capsys, ["total-bp", "bad"])[1].out.splitlines() == ["4"]  # x counts as 0
    assert told(folder, capsys, ["count", "bad"])[1].out.splitlines() == ["3"]
    with pytest.raises(Exception, match="no coordinate"):
        told(folder, capsys, ["slop", "bad", "genome"])
    with pytest.raises(Exception, match="no coordinate|fewer than 3"):
        told(folder, capsys, ["intersect", "bad", "b"])


def test_stdin_and_output_folder(folder, capsys, monkeypatch, tmp_path):
    monkeypatch.setattr("sys.stdin", io.StringIO(FILES["mixed"]))
    assert told(folder, capsys, ["sort", "-"])[1].out.splitlines()[0] == "chr1\t2\t30\ta"
    cli.main(["sort", str(folder / "mixed"), "-o", f"file://{tmp_path}/out"])
    assert "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*"))) == "chr1\t2\t30\ta\nchr1\t10\t12\nchr2\t5\t9\tx\t1\t+\tmore\n"


def test_getfasta_tells_every_region_left_out(folder, capsys):
    _, out = told(folder, capsys, ["getfasta", "past", "fa"])
    assert out.err.splitlines()[-152:] == ["Feature (chr1:3-3) has length = 0, Skipping.", "Feature (chr2:2-9) beyond the length of chr2 size (8 bp).  Skipping.", *["Feature (chr1:20-21) beyond the length of chr1 size (16 bp).  Skipping."] * 150]
