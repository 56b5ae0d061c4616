"""License notices in texts as an exact set-similarity join of text blocks with templates.

Method: the tokens of the templates are ordered by how many documents of the
corpus hold them, rarest first.  A block that reaches the containment threshold
of a template must hold one of the template's rarest tokens (prefix filter),
must have enough tokens at all (length filter), and from the first shared token
on both orders must leave enough tokens (positional filter).  What is left is
counted exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ready

# Phrases of the base definition and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Share of a template's distinct tokens that a block must hold.
THRESHOLD = Fraction(9, 10)

# Public license notices; a template of one sentence is sought in sentences, another in paragraphs.
# Where one word tells licenses apart a template has nine tokens at most, all of which the threshold asks for.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at the address below. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "gpl": (
        "Licensed under the GNU General Public License.",
        "Licensed under the GNU GPL.",
        "Released under the GPL License.",
    ),
    "gpl-3.0": (
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "gpl-2.0": (
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License.",
        "Licensed under the GNU LGPL.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License.",
        "Licensed under the GNU AGPL.",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
    ),
    "public-domain": (
        "This work has been released into the public domain.",
        "This work is in the public domain.",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal.",
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "cc-by": (
        "Licensed under CC BY.",
        "Creative Commons Attribution License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA.",
        "Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC.",
        "Creative Commons Attribution-NonCommercial License.",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND.",
        "Creative Commons Attribution-NoDerivatives License.",
    ),
    "cc-by-nc-sa": (
        "Licensed under CC BY-NC-SA.",
        "Creative Commons Attribution-NonCommercial-ShareAlike License.",
    ),
    "cc-by-nc-nd": (
        "Licensed under CC BY-NC-ND.",
        "Creative Commons Attribution-NonCommercial-NoDerivatives License.",
    ),
}

#: Byte table: A-Z to a-z, and everything but digits, letters and non-ASCII bytes to a space.
_PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
#: Byte table that lower-cases only.
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_SENTENCE = re.compile(rb"[\n\r]+|[.!?;][ \t\n\r]+")
_PARAGRAPH = re.compile(rb"\n[ \t\n\r]*\n")


def words_of(text: str | bytes | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and characters beyond ASCII."""
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_PLAIN).split()


def sentences(text: bytes) -> list[bytes]:
    """Lines, cut behind full stops and their like."""
    return _SENTENCE.split(text)


def paragraphs(text: bytes) -> list[bytes]:
    """What blank lines part."""
    return _PARAGRAPH.split(text)


@dataclass
class Template:
    label: str
    tokens: tuple[bytes, ...]  # rarest first
    need: int
    whole: bool  # sought in paragraphs
    yields_to: frozenset[int] = field(default_factory=frozenset)  # templates that hold all its tokens


@dataclass
class Index:
    """Templates under one order of tokens, with postings of their prefixes for either kind of block."""

    templates: list[Template]
    rank: dict[bytes, int]
    postings: tuple[dict[bytes, list[tuple[int, int]]], dict[bytes, list[tuple[int, int]]]]
    least: tuple[int, int]
    phrases: list[tuple[list[bytes], int, str]]  # words, place of the rarest, label


def build(counts: dict[bytes, int], threshold: Fraction = THRESHOLD, templates: dict[str, tuple[str, ...]] | None = None) -> Index:
    """The index for tokens that ``counts`` documents hold."""
    texts = [(label, text) for label, several in (TEMPLATES if templates is None else templates).items() for text in several]
    vocabulary = sorted(vocabulary_of(templates), key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    made = []
    for label, text in texts:
        tokens = tuple(sorted(set(words_of(text)), key=rank.__getitem__))
        made.append(Template(label, tokens, -(-len(tokens) * threshold.numerator // threshold.denominator), len(sentences(text.strip().encode().rstrip(b"."))) > 1))
    for t in made:
        t.yields_to = frozenset(i for i, o in enumerate(made) if o.whole == t.whole and set(t.tokens) < set(o.tokens))
    postings: tuple[dict, dict] = ({}, {})
    for i, t in enumerate(made):
        for at, w in enumerate(t.tokens[: len(t.tokens) - t.need + 1]):
            postings[t.whole].setdefault(w, []).append((i, at))
    least = tuple(min((t.need for t in made if t.whole == kind), default=0) for kind in (False, True))
    phrases = [(ws := p.encode().split(), min(range(len(ws)), key=lambda i: rank[ws[i]]), label) for p, label in PHRASES.items()]
    return Index(made, rank, postings, least, phrases)


def vocabulary_of(templates: dict[str, tuple[str, ...]] | None = None) -> frozenset[bytes]:
    """Tokens of templates and phrases."""
    several = (TEMPLATES if templates is None else templates).values()
    return frozenset(w for texts in [*several, tuple(PHRASES)] for text in texts for w in words_of(text))


def join_block(words: list[bytes], index: Index, whole: bool) -> dict[int, int]:
    """Shared tokens of each template of the kind that the block reaches the threshold of."""
    block = sorted({w for w in words if w in index.rank}, key=index.rank.__getitem__)
    n, found, passed = len(block), {}, set()
    for j in range(n - index.least[whole] + 1):  # the rest is too short for any template
        for i, at in index.postings[whole].get(block[j], ()):
            t = index.templates[i]
            if i in passed or n < t.need:
                continue
            passed.add(i)  # the first shared token: none of those before it in either order is shared
            if 1 + min(len(t.tokens) - at - 1, n - j - 1) < t.need:
                continue
            held = set(block)
            shared = sum(w in held for w in t.tokens)
            if shared >= t.need:
                found[i] = shared
    return {i: c for i, c in found.items() if not (index.templates[i].yields_to & found.keys())}


def places(words: list[bytes], present: set[bytes], index: Index) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand together."""
    found = []
    for phrase, at, label in index.phrases:
        if not present.issuperset(phrase):
            continue
        i = -1
        while True:
            try:
                i = words.index(phrase[at], i + 1)
            except ValueError:
                break
            if i >= at and words[i - at : i - at + len(phrase)] == phrase:
                found.append((i - at, label))
    return found


def blocks_of(text: str, index: Index) -> list[tuple[int, int, int, int, bool]]:
    """(first word, words, template, shared tokens, paragraph) of every block that reaches a template."""
    raw, found = text.encode().translate(_LOWER), []
    for whole, cut in ((False, sentences), (True, paragraphs)):
        at = 0
        for block in cut(raw):
            words = words_of(block)
            if len(words) >= index.least[whole] > 0:
                found += [(at, len(words), i, c, whole) for i, c in join_block(words, index, whole).items()]
            at += len(words)
    return sorted(found)


def scan(text: str | None, index: Index) -> tuple:
    """The result columns of one text."""
    words = words_of(text)
    present = set(words)
    base = places(words, present, index)
    hit = any(not present.isdisjoint(p) for p in index.postings)
    blocks = [(a, n, index.templates[i].label, c, len(index.templates[i].tokens)) for a, n, i, c, _ in blocks_of(text, index)] if hit else []
    own = {label for _, label in base}
    score = max([1.0] * bool(base) + [c / of for *_, c, of in blocks], default=0.0)
    starts = [a for a, _ in base]
    joined = lambda labels: ",".join(sorted(labels))
    return len(words), len(base), min(starts, default=None), max(starts, default=None), joined(own), joined(own | {b[2] for b in blocks}), score, [{"first": a, "words": n, "label": label, "shared": c, "tokens": of} for a, n, label, c, of in blocks]


_COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "blocks": pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("shared", pa.int64()), ("tokens", pa.int64())]))}
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<first: long, words: long, label: string, shared: long, tokens: long>>"


def _count(batches):
    """Documents of a task that hold each token of the templates."""
    vocabulary, counts = vocabulary_of(), Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(vocabulary.intersection(words_of(text)))
    yield pa.RecordBatch.from_pydict({"token": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})


def token_counts(docs: DataFrame) -> dict[bytes, int]:
    """Documents that hold each token of the templates, over the whole corpus: at most a row a token of them."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "token binary, n long")
    return {bytes(r["token"]): r["n"] for r in counts.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) for every row of ``docs``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower case of A-Z,
    numbered from 0.  Base: places where the words of a phrase stand together;
    n_base counts all, first_word and last_word are their first words.  The
    method adds blocks that hold ``threshold`` of a template's distinct tokens:
    sentences (lines, cut behind . ! ? ; and white space) for templates of one
    sentence, what blank lines part for the others.  A template all of whose
    tokens another match of the block has gives way.  labels are those of both,
    score is 1 with a base place, else the greatest share of a template, else 0.
    Null and empty texts have no words and score 0; a null doc_id stays null;
    repeated rows give repeated results; other columns are ignored; an empty
    table gives an empty result.  Two passes over the texts, the first for the
    order of tokens; no row is shuffled.
    """
    ready(docs.sparkSession)
    index = build(token_counts(docs), threshold)

    def run(batches):
        for batch in batches:
            rows = [scan(t, index) for t in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, _COLUMNS.values(), strict=True)]], ["doc_id", *_COLUMNS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def license_blocks(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, first, words, label, shared, tokens): each block that reaches a template, by its words in the text."""
    return scan_licenses(docs, threshold).select("doc_id", F.inline("blocks"))


def _sql() -> str:
    """The query in DuckDB SQL: every block against every template."""
    index = build({})
    listed = lambda ws: "[" + ", ".join(f"'{w.decode()}'" for w in ws) + "]"
    rows = ", ".join(f"({i}, '{t.label}', {t.whole}, {t.need}, {listed(t.tokens)}, [{', '.join(map(str, sorted(t.yields_to)))}]::int[])" for i, t in enumerate(index.templates))
    tokens = lambda x: f"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    place = lambda p: " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
    found = " || ".join(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {place(p)}), lambda i: {{'a': i - 1, 'l': '{label}'}})" for p, label in PHRASES.items())
    return f"""select doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score from (with
template(id, label, whole, need, tokens, yields_to) as (values {rows}),
docs as materialized (select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents),
block as materialized (select row_id, row_number() over () as block_id, whole, list_distinct({tokens("x")}) as b from (select row_id, false as whole, unnest(string_split_regex(text, '[\\n\\r]+|[.!?;][ \\t\\n\\r]+')) as x from docs union all select row_id, true, unnest(string_split_regex(text, '\\n[ \\t\\n\\r]*\\n')) from docs)),
hit as materialized (select row_id, block_id, id, label, yields_to, len(list_intersect(b, tokens)) as shared, len(tokens) as of from block join template using (whole) where len(b) >= need and len(list_intersect(b, tokens)) >= need),
kept as (select h.row_id, h.label, h.shared / h.of as share from hit h where not exists (select 1 from hit o where o.block_id = h.block_id and list_contains(h.yields_to, o.id))),
more as (select row_id, list(distinct label) as labels, max(share) as share from kept group by 1),
base as (select row_id, doc_id, len(w) as n_words, {found} as f from (select row_id, doc_id, {tokens("text")} as w from docs))
select doc_id, n_words::bigint as n_words, len(f)::bigint as n_base, list_min(list_transform(f, lambda x: x.a))::bigint as first_word, list_max(list_transform(f, lambda x: x.a))::bigint as last_word, coalesce(array_to_string(list_sort(list_distinct(list_transform(f, lambda x: x.l))), ','), '') as base_labels, coalesce(array_to_string(list_sort(list_distinct(list_transform(f, lambda x: x.l) || coalesce(labels, []))), ','), '') as labels, case when len(f) > 0 then 1.0::double else coalesce(share, 0)::double end as score from base left join more using (row_id))"""


OP13_SQL = _sql()
