"""Parameter files and test specifications, read on the driver: a few dozen lines each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# The parameters by line of the file, with their defaults. Line 0 is a head; line 15 parts the optional ones.
FIELDS = (
    (1, "workdir", "./"), (2, "raw", "./*.fastq.gz"), (3, "barcodes", "./*.barcodes"), (4, "cluster_command", "vsearch"), (5, "align_command", "muscle"),
    (6, "cut", "TGCAG"), (7, "processors", 2), (8, "mindepth", 6), (9, "most_low_quality", 4), (10, "similarity", 0.88), (11, "datatype", "rad"),
    (12, "min_samples", 4), (13, "max_shared_het", 3), (14, "name", "c88d6m4p3"), (16, "subset", ""), (17, "outgroup", ""), (18, "exclude", ""),
    (19, "sorted_data", ""), (20, "mismatches", 1), (21, "phred", 33), (22, "strict", 0), (23, "error_het", (0.001, 0.01)), (24, "max_n", 5),
    (25, "max_h", 5), (26, "ploidy", 2), (27, "max_snps", (100, 100)), (28, "max_indels", (3, 99)), (29, "seed", 112233), (30, "overhang", (0, 0)),
    (31, "formats", ""), (32, "lowcounts", None), (33, "keep_trimmed", 0), (34, "max_stack", None), (35, "min_uniques", 1), (36, "hierarchical", 0),
    (37, "masking", 1), (38, "threads", 6),
)
DATATYPES = ("rad", "gbs", "ddrad", "pairgbs", "pairddrad", "merged", "2brad")


@dataclass(frozen=True)
class Params:
    """``values`` by name; ``groups`` is rows (gid, minhits, taxon or prefix*)."""

    values: dict = field(default_factory=dict)
    groups: tuple = ()

    def __getitem__(self, name: str):
        return self.values[name]


def _typed(text: str, default):
    if isinstance(default, tuple):
        parts = [type(default[0])(x) for x in text.split(",")]
        return tuple(parts * len(default)) if len(parts) == 1 else tuple(parts)
    return int(text) if default is None else type(default)(text)


def parse_params(text: str) -> Params:
    """Parameters of a file: what stands before ``##`` on each line; blank ones take defaults, absent lines too.

    A single value of a pair holds for both.  ``lowcounts`` is ``mindepth`` where
    blank.  An unknown datatype raises ValueError.
    """
    lines = text.strip("\n").split("\n")
    at = lambda i: lines[i].split("##")[0].strip() if i < len(lines) else ""
    values = {name: _typed(at(i), default) if at(i) else default for i, name, default in FIELDS}
    if values["lowcounts"] is None:
        values["lowcounts"] = values["mindepth"]
    if values["datatype"] not in DATATYPES:
        raise ValueError(f"unknown datatype {values['datatype']}")
    rows = [at(i).split() for i in range(39, len(lines))]
    return Params(values, tuple((gid, int(least), taxon) for gid, least, taxa in (r for r in rows if len(r) == 3 and not r[0].startswith("=")) for taxon in taxa.split(",")))


def group_table(spark: SparkSession, params: Params, taxa: list[str]) -> DataFrame:
    """(gid, minhits, taxon) of the groups, prefixes expanded over ``taxa``."""
    rows = [(g, n, t) for g, n, p in params.groups for t in taxa if (t.startswith(p[:-1]) if p.endswith("*") else t == p)]
    return spark.createDataFrame(rows, "gid string, minhits int, taxon string")


# The settings of a test file, by line; line 7 is a rule, tests follow.
SETTINGS = ("replicates", "loci", "output", "test", "processors", "list_loci", "list_boots")
ROLES = {"4": ("p1", "p2", "p3", "o"), "part": ("p1", "p2", "p3a", "p3b", "o"), "foil": ("p1", "p2", "p3", "p4", "o"), "foilalt": ("p1", "p2", "p3", "p4", "o")}


def parse_tests(text: str) -> tuple[dict, list[tuple[int, str, str, str]]]:
    """Settings, and rows (test_id, role, taxon, note); ``[a,b]`` names several taxa of a role, tests count from 0."""
    lines = text.strip("\n").split("\n")
    settings = {k: lines[i].split("##")[0].strip() for i, k in enumerate(SETTINGS)}
    settings |= {k: int(settings[k]) for k in ("replicates", "processors", "list_loci", "list_boots")}
    roles, rows, n = ROLES[settings["test"]], [], 0
    for line in lines[8:]:
        taxa, _, note = line.partition("##")
        if names := taxa.split():
            if len(names) != len(roles):
                raise ValueError(f"a test of {settings['test']} needs {len(roles)} taxa: {line}")
            rows += [(n, role, t, note.strip()) for role, name in zip(roles, names, strict=True) for t in name.strip("[]").split(",")]
            n += 1
    return settings, rows


def test_table(spark: SparkSession, rows: list) -> DataFrame:
    """(test_id, role, taxon, note)."""
    return spark.createDataFrame(rows, "test_id int, role string, taxon string, note string")


test_table.__test__ = False
