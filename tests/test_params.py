"""Parameter files and test specifications."""

import pytest

from radloom import params


def test_defaults_and_groups(spark):
    lines = ["==** head"] + [""] * 38 + ["==== groups"]
    lines[8], lines[6], lines[28], lines[27] = "10   ## 8. depth", "CAGC,AATT ## 6.", "5,20 ## 27.", "40"
    p = params.parse_params("\n".join([*lines, "g1 2 a1,a2", "g2 1 b*"]))
    assert p["mindepth"] == p["lowcounts"] == 10 and p["cut"] == "CAGC,AATT" and p["max_indels"] == (5, 20) and p["max_snps"] == (40, 40)
    assert p["similarity"] == 0.88 and p["seed"] == 112233 and p["error_het"] == (0.001, 0.01)
    got = params.group_table(spark, p, ["a1", "a2", "a3", "b1", "b2", "c"]).collect()
    assert sorted(map(tuple, got)) == [("g1", 2, "a1"), ("g1", 2, "a2"), ("g2", 1, "b1"), ("g2", 1, "b2")]
    lines[11] = "other"
    with pytest.raises(ValueError):
        params.parse_params("\n".join(lines))


def test_test_file(spark):
    head = "200 ## n\nx.loci ## f\nout ## o\n4 ## which\n2\n0\n1\n-----\n"
    settings, rows = params.parse_tests(head + "a b [c,d] e ## first\n\n## only a note\na b c e\n")
    assert settings["replicates"] == 200 and settings["list_boots"] == 1 and settings["loci"] == "x.loci"
    assert [r[:3] for r in rows] == [(0, "p1", "a"), (0, "p2", "b"), (0, "p3", "c"), (0, "p3", "d"), (0, "o", "e"), (1, "p1", "a"), (1, "p2", "b"), (1, "p3", "c"), (1, "o", "e")]
    assert params.test_table(spark, rows).where("note = 'first'").count() == 5
    with pytest.raises(ValueError):
        params.parse_tests(head + "a b c\n")
