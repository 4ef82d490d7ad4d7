"""Operators beyond SQL against plain versions, on whole small tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from swathe.llm import bpe, decontaminate, licenses, maxent, neardup, quality, queries, toxicity
from swathe.llm.common import split_words, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"] or "") for r in table(spark, FOLDER, "documents").collect()]


def test_bpe_equals_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.Transducer(path)
    rng = random.Random(1)
    texts = ["a<|endoftext|>B ΑΣ İx 'S it's", "a" * 3000, "ééé 1234 !!\x1c?? 　z", "ﬁ Å é", ""]
    texts += ["".join(rng.choices("abtheinΣé '!1\n中", k=300)) for _ in range(100)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(own.encode(text)) == ids
        assert "".join(own.decode(ids)) == library.decode(ids, skip_special_tokens=False)


def test_language_model(spark, rows):
    seen = Counter()
    for doc_id, text in rows:
        if zlib.crc32(str(doc_id).encode()) % 5 != 1:
            seen.update(maxent.tokens(text))
    total, kinds = sum(seen.values()), len(seen)
    got = {r["doc_id"]: r for r in queries.op3_lm_scoring(spark, FOLDER).collect()}
    for doc_id, text in rows:
        words = maxent.tokens(text)
        base = sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        r = got[doc_id]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in seen for w in words), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_licenses(spark, rows):
    got = {r["doc_id"]: r for r in queries.op4_license_scans(spark, FOLDER).collect()}
    for doc_id, text in rows:
        words = licenses.WORD.findall(text.translate(licenses.ASCII_LOWER))
        places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words))
                  if words[i:i + len(phrase.split())] == phrase.split()]
        assert (got[doc_id]["n_base"], got[doc_id]["base_labels"]) == (
            len(places), ",".join(sorted({label for _, label in places})))
    automaton = licenses.LicenseAutomaton()
    notice = "Redistribution and use in source and binary forms, with or without modification, are permitted."
    assert automaton.labels(notice)[5] == "bsd" and automaton.labels("mit mit license cc by")[1] == 2


def test_near_duplicates(spark, rows):
    bags = {i: set(neardup.shingles(t)[0].tolist()) for i, t in rows}
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b] and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["class_id"] for r in queries.op5_minhash_near_dedup(spark, FOLDER).collect()}
    assert got == {i: root(i) for i in bags}


def test_crowded_bucket_keeps_links(spark):
    """A run of texts, each near the next but far from the first, is one class."""
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame(
        [(i, " ".join(words[i * 4:i * 4 + 200])) for i in range(45)], "doc_id long, text string")
    assert neardup.near_duplicates(docs).select("class_id").distinct().count() == 1


def test_signatures_agree_as_often_as_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(1, 1 << 62, 60).astype("uint64")
    a, b = rng.random(60) * 3 + 0.1, rng.random(60) * 3 + 0.1
    same = np.mean(neardup.signature(elements, a, 2048) == neardup.signature(elements, b, 2048))
    assert same == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.05)


def test_edited_items_are_found():
    rng = random.Random(5)
    item = "".join(rng.choices("abcdefghij ", k=240))
    bench = decontaminate.Benchmark([(1, item)])
    size = len(decontaminate.normal(item))
    for edits in (0, 5, decontaminate.budget(size)):
        text = list(decontaminate.normal(item))
        for at in rng.sample(range(5, len(text) - 5), edits):
            text[at] = "z"
        found = bench.search("some words before " + "".join(text) + " and some after")
        assert found[1][0] == edits, edits
    text = decontaminate.normal(item)
    assert bench.search("before " + text[:50] + text[55:120] + "qqq" + text[120:] + " after")[1][0] == 8
    assert bench.search("before " + text[:100]) == {}


def test_toxicity_held_out(spark):
    assert toxicity.LexiconTrie({"worthless": 1.0, "idiot": 1.0}).closest("wortthles") == ("worthless", 2)
    trie = toxicity.LexiconTrie({"idiot": 2.0})
    assert trie.closest("idoot") == ("idiot", 1) and trie.closest("edict") is None
    assert trie.evidence('he said "idiot"') < trie.evidence("you idiot")
    folder = FOLDER.replace("0.001", "0.01")
    marks = {r["doc_id"]: r["toxic"] for r in table(spark, folder, "labels").collect()}
    held = [r for r in queries.op7_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in marks]
    caught = [r for r in held if r["predicted"]]
    assert all(marks[r["doc_id"]] for r in caught)
    assert len(caught) >= 0.6 * sum(marks[r["doc_id"]] for r in held)


def test_lexicon_keeps_all_terms_at_every_size(spark):
    forms = {a + b + c + "zzz" for a in "abcdefghi" for b in "abcdefghi" for c in "abcdefghi"}
    rows = [(f"plain {' '.join(forms)}", 1)] * 10 + [(f"plain word{chr(97 + i % 26)}", 0) for i in range(200)]
    assert set(toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))) == forms
    rows = [("a vile text", 1)] * 4 + [("a text", 1)] + [("a text once", 0)] * 40
    assert set(toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))) == {"vile"}
    # Three words that a third of the texts hold each, whatever their label, are none.
    rows = [(f"w{'xyz'[i % 3]}", int(i % 7 == 0)) for i in range(60)]
    assert toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int")) == {}
    tails = toxicity.chance_tails(3, 6, 46)
    assert tails[0] == pytest.approx(1) and tails[3] == pytest.approx(math.comb(6, 3) / math.comb(52, 3))


def test_near_word_filter_loses_no_term():
    rng = random.Random(2)
    terms = {"".join(rng.choices("abc", k=rng.randint(3, 11))) for _ in range(60)}
    trie = toxicity.LexiconTrie(dict.fromkeys(terms, 1.0))
    for _ in range(400):
        word = "".join(rng.choices("abc", k=rng.randint(4, 11)))
        assert word in terms or trie._walk(word) is None or trie.may_be_near(word)


def test_repeated_words(spark, rows):
    got = {r["doc_id"]: r for r in quality.measures(table(spark, FOLDER, "documents")).collect()}
    for doc_id, text in rows:
        words = split_words(text)
        grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
        lines = [s for s in text.split("\n") if split_words(s)]
        r = got[doc_id]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["word_chars"]) == (
            len(words), len(covered), len(lines) - len(set(lines)), sum(map(len, words)))
