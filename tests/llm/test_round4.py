"""Near-duplicates amid many candidates that are none: no candidate is left out."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers

from gapwise.llm import simhash, tokens


def crowd(rng, n):
    """A text and its one partner (11 of 100 shingles lost each, 0.802), each and their base amid n texts of 0.786 to it (12 lost)."""

    def cut(words, run, at=None):
        at = int(rng.integers(4, 100 - run)) if at is None else at
        return words[:at] + [f"n{rng.integers(1 << 40)}" for _ in range(run)] + words[at + run :]

    base = [f"n{rng.integers(1 << 40)}" for _ in range(104)]
    text = cut(base, 8, 10)
    partner = cut(text, 7, 60)
    return [" ".join(x) for x in [text, partner, *(cut(own, 8) for own in (text, partner, base) for _ in range(n))]]


def test_near_dedup_finds_a_partner_behind_many_candidates(spark):
    """The partner is behind the 32 likeliest candidates of either text, in every shard."""
    texts = crowd(np.random.default_rng(10), 400)
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in simhash.drop_similar(rows).select("doc_id").collect()}
    assert set(range(len(texts))) - kept == {1}


def test_connections_join_what_all_pairs_join():
    """Groups from one tree, or from several that are visited, are those of all candidate pairs by brute force; some are told at first."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = []
    for _ in range(120):
        x = base.copy()
        x[rng.choice(60, rng.integers(2, 9), replace=False)] += np.uint64(rng.integers(1, 1 << 40))
        sets.append(np.unique(x))
    n = len(sets)
    sketches = simhash.bands(sets)[1]
    fps = np.array([simhash.majority(x) for x in sets], np.uint64)
    groups = np.where(np.arange(n) < 6, 0, np.arange(n))
    held = np.empty(n, object)
    held[:] = [x.tobytes() for x in sets]
    items = (np.arange(n), fps, sketches, groups, held)
    near, least = simhash.reach(0.8), simhash.least_agreeing(0.8)

    def joined(pairs):
        label = groups.tolist()
        for a, b in pairs:
            x, y = sorted((label[a], label[b]))
            label = [x if k == y else k for k in label]
        return label

    alike = lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= near and simhash.agreements(sketches[i : i + 1], sketches[j])[0] >= least
    want = joined((i, j) for i in range(n) for j in range(i) if alike(i, j) and simhash.similar(sets[i], sets[j], 0.8))
    assert 5 < len(set(want)) < n - 10
    one = list(simhash.connections(items, items, near, least, 0.8))
    assert joined(one) == want and len(one) <= n
    own = np.arange(n) % 3
    trees = [tuple(x[own == k] for x in items) for k in range(3)]
    asks = [tuple(x[own >= k] for x in items) for k in range(3)]
    assert joined(p for t, a in zip(trees, asks, strict=True) for p in simhash.connections(t, a, near, least, 0.8)) == want


def test_words_are_split_by_kinds_of_bytes():
    """Ids are the library's whatever stands together, and a word with other marks around it is not learned again."""
    enc = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(8)
    parts = [*"aAstdmLVRE''''!_-. \t\n\r\v\0\x1c09éßσІ²中", "'s", "'ll", "'re", "don't", "café", "<|endoftext|>"]
    texts = ["", " ", "'", "''s", "'stuff'll've", "x'", *("".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3000))]
    for most in (600_000, 20):
        enc.spans.most = most
        for t, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == enc.lib.encode(t, add_special_tokens=False).ids
    assert enc.encode([]) == []
    enc = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    enc.encode(["word, (word) WORD word. word! word; 'word' word-word"])
    assert not enc.pieces and "word" in enc.spans and "word," not in enc.spans


def test_the_pipelines_batches_and_caches_are_bounded(spark, monkeypatch):
    """A batch to Python has few rows where rows are long, and a worker keeps no more words than PACK_CACHES says; the ids are the same."""
    held = []
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda docs, path, **more: held.append(more) or docs)
    docs = spark.range(0, 1000, 1, 1).selectExpr("id doc_id", "repeat('abcdefgh', 2000) text", "'en' lang", "'s' source", "16000L n_chars")
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        out = dict(corpus_pipeline.STAGES)["pack"](spark, docs, "")

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

        assert max(r["n"] for r in out.mapInArrow(sizes, "n long").collect()) < 2 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    pieces, words = held[0]["caches"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    small, large = tokens.Encoder(path, 50, 50), tokens.Encoder(path)
    texts = [" ".join(f"w{i * k}" for i in range(200)) for k in range(20)]
    assert small.encode(texts) == large.encode(texts) and len(small.pieces) <= 50 and len(small.words) <= 50
    assert (tokens.encoder(path, pieces, words).pieces.most, tokens.encoder(path, pieces, words).words.most) == (pieces, words)
    assert pieces < tokens.CACHE and words < tokens.WORD_CACHE


def test_byte_level_words_are_split_by_kinds_of_bytes():
    """Ids are the library's for every character up to U+07FF and whatever stands together; each word is learned once, whatever marks are around it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = np.random.default_rng(9)
    parts = [*"aAstdmLVRE''''!_-.   \t\n\r\v\f\0\x1c09éßσІ²٣́\xa0\x85中", "'s", "'ll", "'re", "don't", "café", "  ", "\n\n", " x", "<|endoftext|>"]
    texts = ["", " ", "  ", "\n", " \n", "a ", "a  ", "a\n", " 's", "  's", "\n's", "!'s", "'stuff'll've", "''s", "x'", "'", "'l"]
    texts += [f"{c}{c}a{c}1{c} {c}! {c}'s\n{c}" for c in map(chr, range(1 << 11))]
    texts += ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(4000)]
    want = [e.ids for e in tokens.Encoder(path).lib.encode_batch(texts, add_special_tokens=False)]
    for most in (600_000, 10):
        enc = tokens.Encoder(path, most, most)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in enc.encode(texts)] == want
        assert [np.frombuffer(enc.encode([t])[0], "<u4").tolist() for t in texts] == want
        assert enc.lengths(texts) == [len(ids) for ids in want]
        assert len(enc.byte_words) <= 2 * most
    assert enc.encode([]) == [] and enc.encode(["", ""]) == [b"", b""]
    enc = tokens.Encoder(path)
    enc.encode(["a word, (word) word. word! word; word###"])
    assert not enc.pieces and b" word" in enc.byte_words and b" word," not in enc.byte_words


def test_words_of_every_character_are_the_librarys():
    """Also where the library and regex differ on what a letter is."""
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = tokens.Encoder(public_tokenizers.path(name))
        texts = [f"a{c} {c}'s" for c in map(chr, range(1 << 11))]
        want = [e.ids for e in enc.lib.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in enc.encode(texts)] == want
        assert enc.lengths(texts) == [len(ids) for ids in want]
