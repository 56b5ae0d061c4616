"""The seven steps on planted loci; what a second run does."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from radloom.assembly import Assembly, Ledger, input_files
from radloom.params import parse_params
from radloom.sources.text import read_loci

CODES = {"a": "AACCGG", "b": "TTGGCC", "c": "ACACAC", "d": "GTGTGT"}
IUPAC = {frozenset(p): c for c, p in {"R": "GA", "K": "GT", "S": "GC", "Y": "TC", "W": "TA", "M": "CA"}.items()}


def planted(folder, loci=12, depth=12):
    """FASTQ files of reads of four samples, some sites heterozygous; the genotypes."""
    rng, truth, reads = random.Random(3), {}, []
    for locus in range(loci):
        base = rng.choices("ACGT", k=40)
        snp, het = rng.sample(range(40), 2)
        other = rng.choice([b for b in "ACGT" if b != base[snp]])
        second = rng.choice([b for b in "ACGT" if b != base[het]])
        for k, sample in enumerate("abcd"):
            one = list(base)
            if k % 2:
                one[snp] = other
            two = list(one)
            if k == locus % 4:
                two[het] = second
            truth[locus, sample] = "".join(IUPAC.get(frozenset(p), p[0]) for p in zip(one, two))
            for j in range(depth):
                code = list(CODES[sample])
                if j == 5:
                    code[2] = "T" if code[2] != "T" else "A"
                reads.append("".join(code) + "TGCAG" + "".join(one if j % 2 else two))
    reads += ["GGGGGGTGCAG" + "".join(rng.choices("ACGT", k=40)) for _ in range(2)]  # of no sample
    rng.shuffle(reads)
    os.makedirs(folder / "raw")
    for f in range(2):
        own = reads[f::2]
        (folder / "raw" / f"x{f}.fastq").write_text("".join(f"@r{f}_{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(own)))
    (folder / "raw" / "empty.fastq").write_text("")
    (folder / "codes.txt").write_text("".join(f"{s}\t{c.lower()}\n" for s, c in CODES.items()))
    lines = ["== parameters"] + [""] * 40
    for at, value in {2: folder / "raw", 3: folder / "codes.txt", 8: 6, 12: 4, 21: 33, 22: 1, 30: "0,0"}.items():
        lines[at] = str(value)
    return parse_params("\n".join(lines)), truth


def files(root, table, *samples):
    return {p: p.stat().st_mtime_ns for s in samples for p in sorted((root / table / f"sample_id={s}").rglob("*.parquet"))}


def test_from_reads_to_loci_and_again(spark, tmp_path, monkeypatch):
    params, truth = planted(tmp_path)
    root = tmp_path / "run"
    made = []

    def dies(self, rows):
        made.append(sorted(r[0] for r in rows.select("sample_id").distinct().collect()))
        if len(made) == 3:
            raise RuntimeError("lost")
        return Assembly.edits(self, rows)

    class Mortal(Assembly):
        edits = dies

    with pytest.raises(RuntimeError, match="lost"):
        Mortal(spark, params, str(root), wave=1).run()
    before = files(root, "edits", 0, 1)
    assert made == [[0], [1], [2]] and before
    run = Assembly(spark, params, str(root))
    sites = run.run()
    assert files(root, "edits", 0, 1) == before and files(root, "edits", 2, 3)
    got = {}
    for r in sites.collect():
        got.setdefault(r["xlocus"], {}).setdefault(r["taxon"], {})[r["pos"]] = r["base"]
    got = sorted(tuple("".join(v[p] for p in sorted(v)).upper() for _, v in sorted(x.items())) for x in got.values())
    assert got == sorted(tuple(truth[k, s] for s in "abcd") for k in range(12))
    run.write_loci(str(tmp_path / "out"))
    text = read_loci(spark, str(tmp_path / "out"))
    assert text.count() == 48 and sorted(r[0] for r in text.select("xlocus").distinct().collect()) == list(range(1, 13))
    run.write_reports(str(tmp_path / "reports"))
    lines = lambda name: [r["value"] for r in spark.read.text(str(tmp_path / "reports" / name)).orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect()]
    got = lines("sorting")
    raw = [t.split("\n")[1][:6] for f in (0, 1) for t in (tmp_path / "raw" / f"x{f}.fastq").read_text().split("@")[1:]]
    seen = Counter(raw)
    want = []
    for name, code in sorted(CODES.items(), key=lambda x: x[1]):
        near = [c for c in seen if sum(x != y for x, y in zip(c, code)) <= 1]
        want += [f"{name}    \t{code}    \t{c}\t{seen.pop(c)}" for c in sorted(near, key=lambda c: (-seen[c], c))]
    assert got == ["sample\ttrue_bar\tobs_bars\tN_obs", *want, "", "nomatch  \tGGGGGG    \t2"] and seen == {"GGGGGG": 2}
    assert [r.split("\t")[:3] for r in lines("clusters")[1:5]] == [[s, "12", "12.0"] for s in "abcd"]
    got = lines("estimates")
    assert got[0] == "taxa\tH\tE" and [r.split("\t")[0] for r in got[1:]] == list("abcd")
    got = lines("statistics")
    assert [r.split()[0] for r in got[:3]] == ["12"] * 3 and [r.split() for r in got[5:9]] == [[s, "12"] for s in "abcd"] and "4\t12\t*\t12" in got
    # nothing is left to do
    stamps = {t: files(root, t, 0, 1, 2, 3) for t in ("reads", "edits", "stacks", "consensus")}
    Assembly(spark, params, str(root)).run()
    assert stamps == {t: files(root, t, 0, 1, 2, 3) for t in stamps}
    # a changed limit runs the steps from it on
    params.values["max_h"] = 0
    fewer = Assembly(spark, params, str(root)).run().select("xlocus").distinct().count()
    assert files(root, "stacks", 0, 1, 2, 3) == stamps["stacks"] and files(root, "consensus", 0, 1, 2, 3) != stamps["consensus"] and fewer == 0


def test_files_and_ledger(spark, tmp_path):
    planted(tmp_path)
    rows = input_files(spark, str(tmp_path / "raw"))
    assert sorted(r["item"].rsplit("/", 1)[1] for r in rows.collect()) == ["x0.fastq", "x1.fastq"]
    assert input_files(spark, str(tmp_path / "raw" / "*"), "x1").count() == 1
    ledger = Ledger(spark, str(tmp_path / "l"))
    assert ledger.pending("s", rows).count() == 2
    ledger.commit("s", rows.where("item like '%x0%'"))
    assert [r["item"].rsplit("/", 1)[1] for r in ledger.pending("s", rows).collect()] == ["x1.fastq"] and ledger.pending("t", rows).count() == 2
    (tmp_path / "raw" / "x0.fastq").write_text("@a\nA\n+\nI\n")
    assert ledger.pending("s", input_files(spark, str(tmp_path / "raw"))).count() == 2


def test_unknown_datatype(spark, tmp_path):
    params, _ = planted(tmp_path)
    params.values["datatype"] = "pairddrad"
    with pytest.raises(ValueError, match="pairddrad"):
        Assembly(spark, params, str(tmp_path / "r"))
