"""Secret scans: character Markov models of random strings and of ordinary identifiers, by log-likelihood ratio.

Everything here is DataFrame and SQL functions. A regular expression's matches are placed by splitting the text at
them: a match begins after all pieces and matches before it. The models are one table of log ratios, a number for
each pair of neighbouring characters of the alphabet, counted from labelled samples; a candidate's score is the
sum over its pairs.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed

#: Base patterns (fixed values of the contract), their kinds in order, and what a match must have.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
BASE = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)]
#: The last two with their least lengths put in: their runs are maximal, so what these leave out would fail anyway.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: Candidates of the method: runs of so many characters of the alphabet, longer ones in parts; a stretch has LEAST at least.
LEAST, RUN = 12, 4096
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},{RUN}}}"
#: Characters from "+" to "z"; model cells are pairs of them.
FIRST, SPAN = 43, 80
#: Natural logarithms: what each pair's log ratio must have over 0 to count as gain; the gain of a stretch at least; of
#: labelled ordinary strings held out of the counts the share whose best stretch must stay under the least gain.
LLR_EACH, LEAST_GAIN, CLEAN = 0.35, 6.0, 0.999
#: Labelled samples: documents of the corpus read for them (in expectation, chosen by hash), generated random strings.
SAMPLE_DOCS, SAMPLE_RANDOM, HELD_OUT = 300, 4000, 0.3
#: Elements of a block in running sums over arrays.
BLOCK = 64
MODEL = "markov"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(numbers: Column, fn: str) -> Column:
    """array<int>: at each place the "sum" or "max" of the numbers (0 or more) before it; 0 at the first.

    In two levels, blocks and within them, as an array that grows by one element at a time is copied each time.
    """
    plus = (lambda a, x: a + x) if fn == "sum" else (lambda a, x: F.greatest(a, x))

    def running(own: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(plus(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))
        return F.aggregate(own, F.struct(start.alias("now"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def levels(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda i: F.slice(x, i * BLOCK + 1, F.lit(BLOCK)))
        sums = lambda b: running(F.transform(b, lambda own: F.aggregate(own, F.lit(0), plus)), F.lit(0))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, sums(b), running)))

    return let(numbers, lambda x: F.when(F.size(x) > 0, levels(x)).otherwise(F.array().cast("array<int>")))


SPAN_ARRAY = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def placed(text: Column, pattern: str, kind: str, rank: int, holds=None) -> Column:
    """array<struct(start, rank, stop, kind)> of the pattern's matches, leftmost and apart, for which holds(match), if given."""
    whole = lambda m: F.array(F.struct(F.lit(0).alias("a"), F.length(m).alias("b")))
    return placed_parts(text, pattern, kind, rank, (lambda m: F.filter(whole(m), lambda _: holds(m))) if holds else whole)


def placed_parts(text: Column, pattern: str, kind: str, rank: int, parts) -> Column:
    """As placed, of the parts (array of struct a, b: places in the match) that parts(match) gives."""

    def made(found: Column, pieces: Column) -> Column:
        # A match begins after all pieces and matches before it, and the piece beside it.
        lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
        starts = let(lengths, lambda x: F.zip_with(before(F.transform(x, lambda y: y["p"] + y["m"]), "sum"), x, lambda at, y: at + y["p"]))
        own = lambda m, at: F.transform(parts(m), lambda p: F.struct((at + p["a"]).alias("start"), F.lit(rank).alias("rank"), (at + p["b"]).alias("stop"), F.lit(kind).alias("kind")))
        return F.flatten(F.zip_with(found, starts, own))

    all_ = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda pieces: made(found, pieces)))
    return F.when(text.rlike(pattern), all_).otherwise(F.array().cast(SPAN_ARRAY))


def base_spans(text: Column) -> Column:
    """All base spans of the text, in order of start, then kind."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    parts = [placed(text, ASSIGN, "assign", 0, value), placed(text, LONG_ACCESS, "access", 1), placed(text, LONG_HEX, "hex", 2)]
    return F.array_sort(F.concat(*parts))


def apart(more: Column, base: Column) -> Column:
    """Those of the spans `more` that overlap none of `base`: the furthest stop before each, and the first start after it, tell."""
    far = (1 << 31) - 1
    both = F.array_sort(F.concat(base, more))
    own = lambda x: x["rank"] < len(BASE)

    def kept(x: Column) -> Column:
        stops = before(F.transform(x, lambda y: F.when(own(y), y["stop"]).otherwise(0)), "max")
        starts = F.reverse(before(F.transform(F.reverse(x), lambda y: F.when(own(y), F.lit(far) - y["start"]).otherwise(0)), "max"))
        free = F.zip_with(stops, starts, lambda a, b: F.struct(a.alias("a"), (F.lit(far) - b).alias("b")))
        told = F.zip_with(x, free, lambda y, f: F.struct(y.alias("y"), (~own(y) & (f["a"] <= y["start"]) & (y["stop"] <= f["b"])).alias("ok")))
        return F.transform(F.filter(told, lambda t: t["ok"]), lambda t: t["y"])

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(let(both, kept))


def codes(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)


def cells(token: Column) -> Column:
    """The model's cells of a token's neighbouring characters."""
    c = codes(token)
    return F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: a * SPAN + b)


def corpus_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, random_strings: int = SAMPLE_RANDOM) -> DataFrame:
    """(token, random) labelled samples: base matches and generated strings are random, other words are ordinary.

    The `sample_docs` distinct texts of the least hashes are read for them (see least_hashed), however many there are.
    """
    picked = least_hashed(docs.select(F.col("text").alias("t")), "t", sample_docs).select("t")
    strip = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9+/_=-]", "")
    secret = [picked.select(F.explode(F.regexp_extract_all("t", F.lit(p), F.lit(g))).alias("m")) for p, g in ((ASSIGN, 2), (LONG_ACCESS, 0), (LONG_HEX, 0))]
    rest = F.col("t")
    for p in (ASSIGN, LONG_ACCESS, LONG_HEX):
        rest = F.regexp_replace(rest, p, " ")
    words = picked.select(F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z_-]{5,}"), F.lit(0))).alias("w"))
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256))
    generated = spark.range(random_strings).select(F.explode(F.array(strip(F.base64(digest)), F.lower(F.hex(digest)), F.upper(F.conv(F.substring(F.hex(digest), 1, 15), 16, 36)))).alias("token"))
    # Identifiers join words by "_", "-", a slash or a capital, or are written in capitals.
    forms = F.array(F.col("w"), F.upper("w"), F.initcap("w"), F.concat(F.lower("w"), F.lit("_name")), F.concat(F.lit("get"), F.initcap("w")), F.concat(F.lower("w"), F.lit("/"), F.lower("w"), F.lit("-"), F.lower("w")), F.concat(F.lower("w"), F.lit("_2024")))
    ordinary = words.select(F.explode(forms).alias("token"), F.lit(False).alias("random"))
    # Numbers and dates are ordinary too: digits alone must not look random.
    numeral = F.conv(F.substring(F.hex(digest), 1, 15), 16, 10)
    dated = F.concat_ws("-", F.substring(numeral, 1, 4), F.substring(numeral, 5, 2), F.substring(numeral, 7, 2))
    ordinary = ordinary.unionByName(spark.range(random_strings).select(F.explode(F.array(numeral, F.reverse(numeral), dated)).alias("token"), F.lit(False).alias("random")))
    found = secret[0].unionByName(secret[1]).unionByName(secret[2]).select(strip(F.col("m")).alias("token")).where("length(token) >= 12")
    return found.unionByName(generated).withColumn("random", F.lit(True)).unionByName(ordinary)


def log_ratios(samples: DataFrame) -> list[float]:
    """Log ratios of all cells (SPAN * SPAN numbers), random over ordinary, each row smoothed towards its letters' mix.

    samples: token, random (boolean). Characters outside the alphabet end a pair.
    """
    pairs = samples.select("random", F.explode(cells(F.col("token"))).alias("cell")).where(F.col("cell").between(0, SPAN * SPAN - 1))
    rows = pairs.groupBy("cell").agg(F.sum(F.when(F.col("random"), 1).otherwise(0)).alias("r"), F.sum(F.when(F.col("random"), 0).otherwise(1)).alias("o")).collect()  # SPAN * SPAN at most
    table = {int(x["cell"]): (x["r"], x["o"]) for x in rows}
    out = [0.0] * (SPAN * SPAN)
    kept = [i for i in range(SPAN) if chr(FIRST + i).isalnum() or chr(FIRST + i) in "+/_=-"]
    logs = []
    for side in (0, 1):
        columns = [sum(table.get(a * SPAN + b, (0, 0))[side] for a in kept) + 1.0 for b in kept]
        total = sum(columns)
        share = dict(zip(kept, (c / total for c in columns), strict=True))
        side_logs = {}
        for a in kept:
            n = sum(table.get(a * SPAN + b, (0, 0))[side] for b in kept)
            for b in kept:
                side_logs[a * SPAN + b] = math.log((table.get(a * SPAN + b, (0, 0))[side] + 20 * share[b]) / (n + 20))
        logs.append(side_logs)
    for cell in logs[0]:
        out[cell] = round(logs[0][cell] - logs[1][cell], 6)
    return out


def train(samples: DataFrame) -> tuple[list[float], float]:
    """(log ratios, least gain): ratios from most of the samples, the least gain from ordinary ones that are held out.

    samples: token, random (boolean). The least gain is that over which the best stretch of 1 - CLEAN of the ordinary
    strings held out lies, LEAST_GAIN at least. Without ordinary words among the samples it is infinite: the method then
    finds nothing.
    """
    if not samples.where(~F.col("random") & F.col("token").rlike("[A-Za-z]")).limit(1).count():
        return [0.0] * (SPAN * SPAN), math.inf
    held = F.pmod(F.xxhash64("token"), F.lit(1000)) < int(1000 * HELD_OUT)
    ratios = log_ratios(samples.where(~held))
    tokens = samples.where(held & ~F.col("random")).select("token").distinct()
    found = tokens.select(best_gain(F.col("token"), ratios).alias("g")).agg(F.percentile("g", CLEAN).alias("q")).first()["q"]
    return ratios, max(LEAST_GAIN, round(found or 0.0, 6))


def pair_ratios(token: Column, ratios: list[float]) -> Column:
    """The log ratio of each pair of the token."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # folded into one constant
    return F.transform(cells(token), lambda x: F.coalesce(F.get(table, x), F.lit(0.0)))


def best_gain(token: Column, ratios: list[float]) -> Column:
    """The highest gain of any stretch of the token: pairs' log ratios less LLR_EACH each."""
    step = lambda acc, x: F.struct(F.greatest(acc["now"] + x - LLR_EACH, F.lit(0.0)).alias("now"), F.greatest(acc["best"], acc["now"] + x - LLR_EACH).alias("best"))
    return F.aggregate(pair_ratios(token, ratios), F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("best")), step, lambda acc: acc["best"])


def stretches(token: Column, model: tuple[list[float], float]) -> Column:
    """array<struct(a, b)>: places of the token's likely random stretches, each drawn out to the next / _ = - or end.

    A stretch gains each pair's log ratio less LLR_EACH. It ends where the gain has fallen to 0, or by the least gain from
    its best; its best must reach the least gain, with LEAST characters up to there.
    """
    ratios, least = model
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("now"), F.lit(0).alias("a"), F.lit(0.0).alias("best"), F.lit(0).alias("b"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
    enough = lambda acc: (acc["b"] - acc["a"] >= LEAST) & (acc["best"] >= least)
    closed = lambda acc: F.when(enough(acc), F.concat(acc["out"], F.array(F.struct(acc["a"], acc["b"])))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        gain, i = x - LLR_EACH, acc["i"]
        now = acc["now"] + gain
        over = (now <= 0) | (now < acc["best"] - least)
        ended = F.struct((i + 1).alias("i"), F.lit(0.0).alias("now"), (i + 1).alias("a"), F.lit(0.0).alias("best"), (i + 1).alias("b"), closed(acc).alias("out"))
        better = now > acc["best"]
        longer = F.struct((i + 1).alias("i"), now.alias("now"), acc["a"].alias("a"), F.greatest(now, acc["best"]).alias("best"), F.when(better, i + 2).otherwise(acc["b"]).alias("b"), acc["out"].alias("out"))
        return F.when(over, ended).otherwise(longer)

    found = F.aggregate(pair_ratios(token, ratios), start, step, closed)
    # The pair into or out of a separator may open or close a stretch: its one outer character is no part.
    own = lambda p: F.substring(token, p["a"] + 1, p["b"] - p["a"])
    lead = lambda p: F.length(F.regexp_extract(own(p), "^[^/_=-]?[/_=-]+", 0))
    tail = lambda p: F.length(F.regexp_extract(own(p), "[/_=-]+[^/_=-]?$", 0))
    found = F.transform(found, lambda p: F.struct((p["a"] + lead(p)).alias("a"), (p["b"] - tail(p)).alias("b")))
    before = lambda p: F.length(F.regexp_extract(F.substring(token, F.lit(1), p["a"]), "[^/_=-]*$", 0))
    after = lambda p: F.length(F.regexp_extract(F.substring(token, p["b"] + 1, F.length(token)), "^[^/_=-]*", 0))
    return F.transform(found, lambda p: F.struct((p["a"] - before(p)).alias("a"), (p["b"] + after(p)).alias("b")))


def spans(text: Column, model: tuple[list[float], float]) -> Column:
    """struct(base, spans): the base spans, and those with the method's apart from them, by start, then kind.

    A span is struct(start, rank, stop, kind), in code points, stop exclusive. Null text has none.
    """
    text = F.coalesce(text, F.lit(""))
    more = placed_parts(text, CANDIDATE, MODEL, len(BASE), lambda m: stretches(m, model))
    every = lambda base: F.struct(base.alias("base"), let(more, lambda m: F.array_sort(F.concat(base, apart(m, base)))).alias("spans"))
    return let(base_spans(text), every)


def scan(docs: DataFrame, model: tuple[list[float], float]) -> DataFrame:
    """docs with base and spans (see spans); rows and other columns stay as they are, columns of these names are replaced."""
    out = docs.drop("base", "spans").withColumn("_found", spans(F.col("text"), model))
    return out.select("*", "_found.base", "_found.spans").drop("_found")


def render(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, model: tuple[list[float], float], mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by the mark (spans that meet or overlap by one); other rows, and all other columns, untouched."""

    def without(found: Column) -> Column:
        # Four bytes for each code point, so that a piece is cut out without a walk through the text.
        wide = F.encode("text", "UTF-32")
        piece = lambda w, a, b: F.decode(F.substring(w, a * 4 + 1, (b - a) * 4), "UTF-32")
        part = lambda w: lambda s, at: F.when(s["start"] >= at, F.concat(piece(w, at, s["start"]), F.lit(mark))).otherwise("")
        stops = F.transform(found, lambda s: s["stop"])
        return let(wide, lambda w: F.concat(F.array_join(F.zip_with(found, before(stops, "max"), part(w)), ""), piece(w, F.array_max(stops), F.length("text"))))

    out = docs.withColumn("_spans", spans(F.col("text"), model)["spans"])
    return out.withColumn("text", F.when(F.size("_spans") > 0, without(F.col("_spans"))).otherwise(F.col("text"))).select(*docs.columns)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): counts and digest of base spans, and all spans.

    Null text: as empty, no span. Null doc_id and repeated rows are scanned like any row. An empty table gives an
    empty result. Extra columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = scan(rows, train(corpus_samples(rows)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k, _ in BASE], F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
