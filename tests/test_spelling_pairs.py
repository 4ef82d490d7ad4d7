"""Few pairs of words are left to measure exactly."""

from swathe.operators import spelling


def test_pairs_that_cannot_be_within_two_edits_are_left_out(spark):
    vocabulary = spelling.vocabulary_frame(spark, ["runway"])
    # Three substitutions that drop three letters: near enough by plain edits or by letters, not by both.
    tokens = spark.createDataFrame([("rrnnaa",), ("runwya",), ("urnwya",), ("runwaxz",), ("runwa",)], "token string")
    pairs = {r["token"] for r in spelling._pairs_by_length(tokens, vocabulary, 2).collect()}
    assert pairs == {"runwya", "urnwya", "runwaxz", "runwa"}
    found = {r["token"]: r["distance"] for r in spelling.damerau_levenshtein_join(tokens, vocabulary).collect()}
    assert found == {"runwya": 1, "urnwya": 2, "runwaxz": 2, "runwa": 1}
