"""Large ids, batches and groups, repetitive and repeated texts."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swathe.llm import bpe, decontaminate, licenses, maxent, neardup, quality, toxicity, urls, windows

LARGE = 2 ** 60 + 1
PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = [f"w{i}" for i in range(5000)]


@pytest.fixture(scope="module")
def large_ids(spark):
    rows = [(LARGE, "a text of some words", "http://a.net/x"), (None, "another text", None), (LARGE + 2, "more", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, url string").coalesce(1)


def test_ids_stay_as_they_are(large_ids, spark):
    labels = spark.createDataFrame([(LARGE, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(LARGE, "some words"), (None, "another text")], "item_id long, text string")
    wanted = {LARGE, None, LARGE + 2}
    for rows in (maxent.score_documents(large_ids), licenses.scan_licenses(large_ids), neardup.near_duplicates(large_ids),
                 bpe.encoding_digests(large_ids, PATH, with_ids=True), toxicity.score_documents(large_ids, labels),
                 quality.judge(large_ids), windows.repeat_digests(large_ids), windows.cut_repeats(large_ids)):
        assert {r["doc_id"] for r in rows.collect()} == wanted
    pages = urls.filter_urls(large_ids.withColumnRenamed("doc_id", "page_id"))
    assert {r["page_id"] for r in pages.collect()} == wanted
    found = decontaminate.contaminated(large_ids, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(LARGE, LARGE), (None, None)}


def plain_repeats(rows, length=13):
    first = {}
    for i, text in rows:
        words = text.split()
        for k in range(len(words) - length + 1):
            gram = tuple(words[k:k + length])
            first[gram] = min(first.get(gram, i), i)
    out = set()
    for i, text in rows:
        words = text.split()
        gone = {k + j for k in range(len(words) - length + 1) if first[tuple(words[k:k + length])] < i for j in range(length)}
        out.add((i, len(words), len(gone)))
    return out


@pytest.mark.parametrize("chunk", [40, 1 << 21])
def test_windows_in_chunks_and_large_batches(spark, monkeypatch, chunk):
    monkeypatch.setattr(windows, "CHUNK", chunk)
    rng = random.Random(3)
    passage = WORDS[:400]
    rows = [(i, " ".join(rng.choices(WORDS[:30], k=8) + passage[i % 300:i % 300 + 20 + i % 80]
                         + (["rep"] * 30 if i % 7 == 0 else []))) for i in range(150)]
    rows += [(5, rows[9][1]), (9, rows[5][1]), (20, rows[20][1]), (200, " ".join(WORDS * 2)), (201, " ".join(WORDS[100:900]))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # Rows that repeat an id are told apart by their lengths here.
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in windows.repeat_digests(docs).collect()} == plain_repeats(rows)
    many = spark.range(70_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).unionByName(
        spark.createDataFrame([(70_001, " ".join(passage[:20])), (70_002, " ".join(passage[:20]))], "doc_id long, text string"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        gone = windows.repeat_digests(many.coalesce(1)).where("n_removed > 0").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["doc_id"], r["n_removed"]) for r in gone] == [(70_002, 20)]


def test_places_round_trip():
    rng = np.random.default_rng(1)
    docs = [np.sort(rng.choice(3000, n, replace=False)) for n in (1, 5, 400, 2)] + [np.array([0, 255, 510, 100_000])]
    first = np.concatenate([np.arange(len(d)) == 0 for d in docs])
    packed = windows.pack_places(np.concatenate(docs), first)
    assert (windows.unpack_places(packed, np.array([len(d) for d in docs])) == np.concatenate(docs)).all()


def test_long_texts_hash_in_segments(monkeypatch):
    from swathe.llm import common

    text = " ".join(random.Random(2).choices(WORDS, k=3000)) + "\n" + "x" * 500 + " end"
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "SEGMENT", 100)
    assert (common.word_hashes(text) == whole).all() and len(whole) == 3002


def test_repetitive_text_against_repetitive_item():
    item = "na " * 250 + "x" + " na" * 250
    table = decontaminate.Benchmark([(1, item), (2, "na " * 500)])
    found = table.search("na " * 1_000_000)
    assert found[2][0] == 0 and found[1][0] in (1, 2)
    assert table.search("no " * 100_000) == {}


def plain_classes(sets):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in range(len(sets))}


def test_crowded_buckets_equal_all_pairs(spark, monkeypatch):
    """Copies of one text under more and more edits: pairs on both sides of the bound, many holders a bucket."""
    monkeypatch.setattr(neardup, "BLOCK", 50)
    rng = random.Random(6)
    base = rng.choices(WORDS, k=150)
    texts = []
    for i in range(330):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = rng.choice(WORDS[:20 + i])
        texts.append(" ".join(words[:150 - i % 25]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(neardup.shingles(t)[0].tolist()) for t in texts]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == plain_classes(sets)


def test_crowded_bucket_of_unlike_texts(spark):
    """1,500 texts that share a passage and are not similar stay apart; what is similar among them is found."""
    rng = random.Random(8)
    shared = WORDS[:120]
    rows = [(i, " ".join(shared + rng.choices(WORDS, k=100))) for i in range(1500)]
    rows += [(1500 + k, rows[k * 7][1] + " tail") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    classes = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert {i for i, c in classes.items() if c != i} == set(range(1500, 1520))
    assert all(classes[1500 + k] == k * 7 for k in range(20))


def test_repeated_id_is_one_document(spark):
    texts = [" ".join(random.Random(k).choices(WORDS, k=60)) for k in range(3)]
    rows = [(5, texts[0]), (5, texts[1]), (3, texts[1] + " more"), (9, texts[0]), (4, texts[2])]
    got = {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (4, 4)}


def test_stages_decide_by_row(spark):
    labels = spark.createDataFrame([(i, 0, int(i >= 40)) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, "plain words here " * 3) for i in range(40)] + [(i, "vileness words here") for i in range(40, 60)]
    rows += [(None, "vileness vileness"), (None, "plain words"), (3, "vileness again vileness")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = toxicity.keep_harmless(docs, labels)
    assert kept.where("text like '%vile%'").count() == 0 and kept.count() == 41
    items = spark.createDataFrame([(1, "the secret passage of words")], "item_id long, text string")
    rows = [(None, "here is the secret passage of words."), (None, "clean"), (1, "the secret passage of words"), (1, "clean too")]
    kept = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(r["text"] for r in kept.collect()) == ["clean", "clean too"]


def test_license_chains_are_weighed():
    automaton = licenses.LicenseAutomaton()
    template = automaton.templates[0][0]
    stray = template[18:23]
    words = template[:9] + stray + template[9:]
    places, stretches = automaton.scan(words)
    share = max(s[3] for s in automaton.chain(stretches) if s[0] == 0)
    assert share >= 0.8
    _, stretches = automaton.scan(template * 300)
    assert sum(s[3] >= 0.99 for s in automaton.chain(stretches) if s[0] == 0) == 300


def test_classes_of_the_language_model_are_all_used():
    for n in (0, 3, maxent.OWN):
        own = {w: i for i, w in enumerate(WORDS[:n])}
        assert set(maxent.classes_of(np.array(WORDS, dtype=object), own).tolist()) == set(range(maxent.CLASSES))


def test_a_chunk_and_a_bucket_of_windows_stay_small():
    """The workers of an executor share what its heap leaves: some 100 MB each."""
    words = np.random.default_rng(1).integers(0, 10_000, (1000, 1200)).astype(str)
    ids = np.arange(1000)
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "key": ids, "text": [" ".join(row) for row in words]})
    tracemalloc.start()
    rows = pd.concat([b.to_pandas() for b in windows._listing(windows.LENGTH, 1)(iter([batch] * 3))])
    listed = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    late = windows._later_holders(rows)
    grouped = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert late["doc_id"].is_unique and len(late) == 0
    assert listed < 150e6 and grouped < 220e6


def test_contexts_have_rows_of_their_own_and_training_rows_follow_the_input():
    bits = maxent.feature_bits(len(WORDS))
    after = maxent.Batch([WORDS], {}, bits).features[0]
    assert len(np.unique(after)) > 0.95 * len(WORDS)
    # Rows emitted at most, for partitions of four million tokens.
    rows = []
    for partitions in 4 ** np.arange(3, 12):
        bits = maxent.feature_bits(int(partitions) << 22)
        rows.append((maxent.shard_count(int(partitions), bits) << bits) / partitions)
    assert max(rows) <= min(rows)


def test_shards_train_a_table_over_all_texts(spark):
    docs = spark.createDataFrame([(" ".join(WORDS[i:i + 40]),) for i in range(0, 400, 40)], "text string").repartition(8)
    bits = maxent.LEAST_BITS + 2
    table = maxent.train(docs, {}, bits)
    held = maxent.Batch([maxent.tokens(r["text"]) for r in docs.collect()], {}, bits)
    assert table[np.unique(held.features)].any(axis=1).all()
    chances = held.log_chances(table, slice(None))
    assert np.allclose(np.exp(chances).sum(axis=1), 1, atol=1e-4)
    assert chances[np.arange(len(held.target)), held.target].mean() > -np.log(maxent.CLASSES)


def plain_rate(fitted: list[bytes], url: bytes) -> float:
    """Log10 likelihood a character by counting over all fitted urls, order by order."""
    padded = lambda u: b"\x02" * urls.ORDER + u + b"\x03"
    counts = {}
    for u in map(padded, fitted):
        for i in range(urls.ORDER, len(u)):
            for k in range(urls.ORDER + 1):
                after = counts.setdefault(u[i - k:i] if k else b"", {})
                after[u[i]] = after.get(u[i], 0) + 1
    data, total = padded(url), 0.0
    for i in range(urls.ORDER, len(data)):
        chance = 1.0 / urls.ALPHABET
        for k in range(urls.ORDER + 1):
            after = counts.get(data[i - k:i] if k else b"")
            if after is None:
                break
            chance = (after.get(data[i], 0) + len(after) * chance) / (sum(after.values()) + len(after))
        total += np.log10(chance)
    return total / (len(data) - urls.ORDER)


def test_every_labelled_url_is_counted(spark, monkeypatch):
    monkeypatch.setattr(urls, "CHARS", 500)
    rng = random.Random(5)
    rows = [("".join(rng.choices("abcdé/" if i % 2 else "cdexyz/", k=rng.randint(0, 30))), ("allow", "block")[i % 2])
            for i in range(120)] + [("long/" * 700, "allow"), ("tail" * 900, "block"), ("", "block")]
    labelled = spark.createDataFrame(rows, "text string, verdict string").repartition(4)
    models, threshold = urls.fit_ratio(labelled)
    marked = labelled.select("text", "verdict", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held")).collect()
    fitted = {v: [r["text"].encode() for r in marked if r["verdict"] == v and not r["held"]] for v in ("allow", "block")}
    for model, says in zip(models.value, ("allow", "block"), strict=True):
        assert model.totals[model.contexts == 0].sum() == sum(len(u) + 1 for u in fitted[says])
    asked = [r["text"] for r in marked] + ["never/seen?", "ab"]
    found = urls.with_ratio(spark.createDataFrame([(t,) for t in asked], "text string"), ["text"], models).collect()
    plain = {t: plain_rate(fitted["allow"], t.encode()) - plain_rate(fitted["block"], t.encode()) for t in asked}
    assert all(r["ratio"] == pytest.approx(plain[r["text"]], abs=1e-9) for r in found)
    held = [plain[r["text"]] for r in marked if r["verdict"] == "allow" and r["held"]]
    assert threshold <= 0 and sum(x < threshold for x in held) <= urls.FALSE_REJECTS * len(held)
