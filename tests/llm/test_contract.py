"""The queries' columns, row by row, against plain Python, the tokenizers library and DuckDB; the pipeline's stages and run() against plain rules."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from test_operators import KIND, ODD, SF, brute_pii, brute_secrets, same_as_sql

from gapwise.llm import mixing, packing, pii, quality, secrets, sharding, simhash, tokens, wavelet

public_tokenizers = pytest.importorskip("public_tokenizers")
CLASHING = ["h", "key", "fp", "rank", "shard", "base", "spans", "lang_pred", "score", "grp", "row", "page", "n", "_key", "_size", "_h"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, KIND)
    return rows.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    bits = Counter(b for g in grams for h in [xxhash.xxh64(g.encode(), seed=42).intdigest()] for b in range(64) if h >> b & 1)
    return f"{sum(1 << b for b, n in bits.items() if 2 * n > len(grams)):016x}"


def test_fingerprints(docs, odd, texts):
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: brute_fingerprint(t) for d, t in texts.items()} and len(got) == len(texts)
    got = Counter((r["doc_id"], r["fingerprint"]) for r in simhash.near_duplicates(odd).collect())
    assert got == Counter((d, brute_fingerprint(t)) for d, t, *_ in ODD)


def test_quality_is_what_sql_counts(spark):
    same_as_sql(quality.op6_quality(spark, SF), quality.OP6_SQL, "documents")


def test_quality_of_odd_rows(odd):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside), failed

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter((r["doc_id"], *(r[k] for k in names)) for r in quality.judge(odd).collect())
    assert got == Counter((d, *brute(t)) for d, t, *_ in ODD)


def spans_of(text):
    return [tuple(x.rsplit(":", 2)) for x in text.split(",")] if text else []


def test_pii_columns(docs, odd, texts):
    names, got = ["email", "ip", "card", "phone"], pii.find(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = brute_pii(texts[r["doc_id"]] or "")
        said = [f"{names[k]}:{a}:{e}" for a, k, e in base]
        assert [r[f"n_{k}"] for k in names] == [sum(x[1] == i for x in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = spans_of(r["spans"])
        assert set(said) <= set(r["spans"].split(",")) | {""}
        order = [(int(a), names.index(k)) for k, a, _ in spans]
        assert order == sorted(order) and len(set(spans)) == len(spans)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty for r in pii.find(odd).collect())


def test_secrets_columns(docs, odd, texts):
    names, got = ["assign", "access", "hex"], secrets.find(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = brute_secrets(texts[r["doc_id"]] or "")
        kinds = [x.split(":")[0] for x in base.split(",")]
        assert [r[f"n_{k}"] for k in names] == [kinds.count(k) for k in names]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(r["spans"].split(",")) | {""}
        starts = [int(a) for _, a, _ in spans_of(r["spans"])]
        assert starts == sorted(starts)
    assert len(secrets.find(odd).collect()) == len(ODD)


def test_packed_ids_of_each_document(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = tokens.Encoder(path).lib
    got = packing.pack(docs, path, ids=True).toPandas()
    for d, own in got.sort_values("piece").groupby("doc_id"):
        want = np.array([*lib.encode(texts[d] or "", add_special_tokens=False).ids, 2], "<u4")
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert b"".join(own.ids) == want.tobytes() and own.length.max() <= 1024
        assert len(want) > 1024 or len(own) == 1
        assert (own.length.iloc[1:] == 1024).all()
    assert got.doc_id.nunique() == len(texts)
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 1024 + 2


def test_token_stats_of_each_document(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = tokens.Encoder(path).lib
    got = wavelet.token_stats(docs, path).toPandas().sort_values("doc_id")
    ids = [np.array([*lib.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4") for d in sorted(texts)]
    assert got.doc_id.tolist() == sorted(texts) and got.n_tokens.tolist() == [len(x) for x in ids]
    assert got.start.tolist() == [0, *np.cumsum([len(x) for x in ids])[:-1]]
    assert got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in ids]


def test_shard_columns(docs, odd, texts):
    for r in sharding.assign(docs).collect():
        own = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(own) + 8, zlib.crc32(own), "bytes", None)
    got = Counter((r["doc_id"], r["size"]) for r in sharding.assign(odd).collect())
    assert got == Counter((d, len((t or "").encode()) + 8) for d, t, *_ in ODD)


def test_columns_that_clash(odd):
    """Columns called like the operators' own change nothing."""
    import corpus_pipeline as p

    assert mixing.mix(odd).agg(F.sum("taken")).first()[0] == mixing.mix(odd.drop(*CLASHING)).agg(F.sum("taken")).first()[0]
    for stage in (p.language, p.near_dedup, p.secret_scan, p.mix):
        assert stage(odd.sparkSession, odd, SF).columns == p.COLUMNS


def brute_mix(rows):
    """Copies of each of rows (doc_id, text, source): by weights of sources, then within a source by hash up to the nearest running sum."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sums = Counter()
    for n, (_, _, s) in zip(size, rows, strict=True):
        sums[s] += n
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sums[s]}
        for s in full or free:
            target[s] = 2.0 * sums[s] if full else level * weight[s]
            left -= target[s] if full else 0
        free = free - full if full else set()
    copies = [0] * len(rows)
    for s in order:
        own = [i for i, r in enumerate(rows) if r[2] == s]
        own.sort(key=lambda i: int(hashlib.md5(f"{rows[i][0]}|{rows[i][1] or ''}".encode()).hexdigest()[:15], 16))
        whole = int(target[s] // sums[s]) if sums[s] else 0
        rest, run = target[s] - whole * sums[s], 0
        for i in own:
            copies[i] = whole + (rest > 0 and (run + size[i] <= rest or (run <= rest and run + size[i] - rest < rest - run)))
            run += size[i]
    return {(r[0], s): int(c) for r, s, c in zip(rows, size, copies, strict=True)}, target, sums


def test_pipeline_mix_is_brute_force(spark, docs):
    import corpus_pipeline as p

    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want, target, _ = brute_mix(rows)
    got = Counter(r["doc_id"] for r in p.mix(spark, docs, SF).collect())
    assert got == Counter({d: c if n else 1 for (d, n), c in want.items() if c or not n})
    told = mixing.mix(docs).collect()
    assert all(r["taken"] == r["size"] * want[r["doc_id"], r["size"]] for r in told)
    assert {round(x, 6) for x in target.values()} == {round(r["target"], 6) for r in told}


def test_pipeline_secret_scan_is_the_spans(spark, docs, texts):
    import corpus_pipeline as p

    found = {r["doc_id"]: spans_of(r["spans"]) for r in secrets.find(docs).collect()}
    rows = p.secret_scan(spark, docs, SF).collect()
    old = {r["doc_id"]: r["n_chars"] for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        t, at, out = texts[r["doc_id"]], 0, ""
        for _, a, e in found[r["doc_id"]]:
            if int(a) >= at:
                out += t[at : int(a)] + "[SECRET]"
            at = max(at, int(e))
        if found[r["doc_id"]]:
            assert (r["text"], r["n_chars"]) == (out + t[at:], len(out + t[at:]))
        else:
            assert (r["text"], r["n_chars"]) == (t, old[r["doc_id"]])


def test_pipeline_run_is_its_stages(spark, docs, monkeypatch):
    """run() packs what the stage before kept, as it was written: every document, as often as it was taken, with the library's count of ids."""
    import corpus_pipeline as p

    written, write = {}, p.materialize
    monkeypatch.setattr(p, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    got = p.run(spark, SF).toPandas()
    n = [docs.count(), *(written[f"stage-{k}"].count() for k, _ in p.STAGES[:3])]
    assert n == sorted(n, reverse=True) and n[2] == n[3]  # only language and near_dedup drop documents
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = tokens.Encoder(path).lib
    want = Counter()
    for r in written["stage-mix"].collect():
        want[r["doc_id"]] += len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert got.groupby("doc_id").length.sum().to_dict() == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
    assert 0.5 * n[0] < got.doc_id.nunique() <= n[3]


def test_pipeline_of_odd_and_no_rows(spark, odd, tmp_path):
    import corpus_pipeline as p

    rows = odd.drop("size", *CLASHING)
    rows.write.parquet(f"{tmp_path}/odd/documents.parquet")
    rows.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = p.run(spark, f"{tmp_path}/odd").toPandas()
    assert set(got.doc_id.dropna().astype(int)) <= {3, 5} and len(got) and pd.notna(got.ids_crc32).all()
    assert p.run(spark, f"{tmp_path}/none").count() == 0
