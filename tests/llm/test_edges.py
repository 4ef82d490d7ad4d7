"""Every operator and stage on odd and on empty tables."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from swathe.llm import bpe, chat, decontaminate, licenses, maxent, neardup, quality, toxicity, urls, windows

PATH = public_tokenizers.path("word_bpe_49k.json")
PER_ROW = {
    "maxent": lambda d, l: maxent.score_documents(d),
    "licenses": lambda d, l: licenses.scan_licenses(d),
    "neardup": lambda d, l: neardup.near_duplicates(d),
    "bpe": lambda d, l: bpe.encoding_digests(d, PATH),
    "toxicity": lambda d, l: toxicity.score_documents(d, l),
    "quality": lambda d, l: quality.judge(d),
    "windows": lambda d, l: windows.repeat_digests(d),
    "cut": lambda d, l: windows.cut_repeats(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(name, odd_docs, no_docs, labels):
    rows = PER_ROW[name](odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert PER_ROW[name](no_docs, labels.limit(0)).count() == 0


def test_stages_keep_columns(odd_docs, no_docs, labels, benchmark):
    for stage in (lambda d: toxicity.keep_harmless(d, labels), neardup.keep_first, windows.cut_repeats,
                  lambda d: decontaminate.decontaminate(d, benchmark)):
        assert stage(odd_docs).columns == odd_docs.columns
        assert stage(no_docs).count() == 0


def test_decontamination(odd_docs, benchmark):
    found = decontaminate.contaminated(odd_docs, benchmark)
    # The item without an id is found like any other.
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in found.collect()} == {
        (6, 1, 0), (7, 1, 0), (1, None, 0), (2, None, 0), (12, None, 0), (None, None, 0)}
    assert decontaminate.contaminated(odd_docs, benchmark.limit(0)).count() == 0
    kept = [r["doc_id"] for r in decontaminate.decontaminate(odd_docs, benchmark).collect()]
    assert kept.count(None) == 1 and not {1, 2, 6, 7, 12} & set(kept) and len(kept) == odd_docs.count() - 7


def test_windows_and_classes(odd_docs):
    digests = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in windows.repeat_digests(odd_docs).collect()}
    assert {(1, 45, 0), (2, 45, 45), (12, 46, 45), (3, 0, 0), (6, 16, 0), (7, 16, 15), (9, 3000, 0)} <= digests
    classes = {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(odd_docs).collect()}
    assert {(1, 1), (2, 1), (12, 1), (3, 3), (4, 4), (5, 5), (None, None)} <= classes


def test_urls(spark):
    rows = [(1, None, 0), (2, "no scheme", 0), (3, "http://A.Example.NET/en/x?q#f", 0), (4, "http://net/", 0),
            (5, "http://sub.org/fr/é", 0), (6, "http://example.com/de/", 0), (6, "http://example.com/de/", 0),
            (7, "http://notnet/", 0), (8, "http://h" + "x" * 9000, 0), (None, "http://x.org#/fr/", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    got = {(r["page_id"], r["host"][:20], r["path"], r["rule"]): r["verdict"] for r in urls.filter_urls(pages).collect()}
    assert got[(3, "a.example.net", "/en/x", "example.net/en/")] == "allow"
    assert got[(4, "net", "/", "net/")] == "block"
    assert got[(5, "sub.org", "/fr/é", "org/fr/")] == "allow"
    assert got[(6, "example.com", "/de/", "example.com/de/")] == "block"
    assert {(1, "", "", None), (2, "", "", None), (7, "notnet", "/", None), (None, "x.org", "", None)} <= set(got)
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_chat_events(spark):
    rows = [
        ("c", 1, "m1", "message", "user", "hi </s> [x] &lt;"), ("c", 2, "m2", "message", "assistant", "no"),
        ("c", 3, "m2", "regenerate", None, None), ("c", 4, "m2", "delta", None, "yes"),
        ("c", 5, "m2", "delta", None, "!"), ("c", 6, "m1", "edit", "user", "hello </s>"),
        (None, None, "m3", None, None, None), ("d", 1, "m4", "message", "a]b", "")]
    events = spark.createDataFrame(
        rows, "conv_id string, seq long, message_id string, kind string, role string, text string")
    rendered = chat.render(chat.fold_events(events))
    got = {r["conv_id"]: r for r in chat.read_back(rendered).collect()}
    assert [tuple(t) for t in got["c"]["turns"]] == [("user", "hello </s>"), ("assistant", "yes!")]
    assert got["c"]["loss_text"] == "yes!"
    assert [tuple(t) for t in got[None]["turns"]] == [("", "")]
    assert [tuple(t) for t in got["d"]["turns"]] == [("a]b", "")]
    digest = chat.conversation_digests(chat.read_back(rendered)).where("conv_id = 'c'").first()
    assert digest["turns_sha256"] == hashlib.sha256(b"user\nhello </s>\nassistant\nyes!\n").hexdigest()
    assert chat.conversation_digests(chat.read_back(chat.render(chat.fold_events(events.limit(0))))).count() == 0


def test_bpe_round_trip(odd_docs):
    decoded = bpe.decode_documents(bpe.encode_documents(odd_docs, PATH), PATH)
    assert decoded.where(F.col("text") == "").count() == 4
