"""Near names: how many pairs meet, and names of few grams."""

from __future__ import annotations

import hashlib

from tallyloom.operators import review


def test_names_meet_in_about_as_many_pairs_as_there_are_names(spark):
    """Names of one word and a random code share single grams by the thousand, but hardly three at once."""
    known = ["canada " + hashlib.md5(str(i).encode()).hexdigest()[:12] for i in range(3000)]
    given = [k[:9] + "z" + k[10:] for k in known]
    frames = [spark.createDataFrame([(n,) for n in side], "n string") for side in (given, known)]
    met = review.meeting_names(*frames, "n", "n")
    assert met.count() < 2 * len(known)
    assert {(r["name"], r["candidate"]) for r in met.collect()} >= {(g, k) for g, k in zip(given, known) if g != k}


def test_names_of_few_grams_meet_in_single_ones(spark):
    frames = [spark.createDataFrame([(n,) for n in side], "n string") for side in (["aaaaaaaaa", "abab", "aaab"], ["aaaaaaaa", "abbb", "abcb"])]
    got = {tuple(r) for r in review.near_names(*frames, "n", "n").collect()}
    assert got == {("aaaaaaaaa", "aaaaaaaa", 1), ("abab", "abbb", 1), ("abab", "abcb", 1)}


def test_exploded_names_are_never_broadcast(spark):
    """Grams and signatures are many times the rows whose size Spark estimates, so the driver must not gather them."""
    frames = [spark.createDataFrame([(f"canada {i:012d}{end}",) for i in range(50)], "n string") for end in ("", "x")]
    met = review.meeting_names(*frames, "n", "n")
    assert met.count() >= 50
    met.collect()
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
