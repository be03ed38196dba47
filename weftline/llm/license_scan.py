"""License scanning by conditional compression.

A paragraph that holds a cue is a candidate, whole. Every template has a word that tells it apart and that no notice of
it may lack; around each place of that word in the paragraph, a window as long as the
template is compressed with the template as a raw zstandard dictionary. Where that saves enough bytes and the wording
differs in no word that tells licenses apart, the notice is confirmed. Of notices that overlap the longest is reported.
"""

from __future__ import annotations

import difflib
import re
from functools import cache
from itertools import groupby

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import bounded_batches, text_of

#: Customary notices by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
)
#: Fixed value: words that make a paragraph worth compressing; a line may end within a cue.
CUE = r"(?i)licen[cs]e|copyright|permission|redistribut|free\W+software|public\W+domain|rights\W+reserved|creative\W+commons"
#: Share of a wording that may differ, and the least saving.
SLACK, SAVING = 0.12, 0.2
#: Names and conditions that tell licenses apart, besides all words with digits.
TELLING = frozenset("mit apache gnu general lesser affero gpl lgpl agpl cc by nc nd sa creative commons attribution noncommercial sharealike noderivatives bsd mozilla mpl isc unlicense public domain reserved waived permission redistribution version not no".split())
#: Telling words that are too common to look for a template by.
_COMMON = frozenset("by no not version general public".split())

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_cue = re.compile(CUE)
_FOUND = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("saved", T.DoubleType()), T.StructField("missing", T.StringType()), T.StructField("extra", T.StringType())]))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _plain(own: list[str]) -> bytes:
    """What is compressed of these words; case, wrapping and punctuation don't count."""
    return (" ".join(own) + " . ").encode()


@cache
def _compressors() -> tuple:
    options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    make = lambda text=None: zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(19, **options), **({"dict_data": zstandard.ZstdCompressionDict(_plain(words(text)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if text else {}))
    return make(), [make(text) for _, text in TEMPLATES], [words(text) for _, text in TEMPLATES]


def _saving(data: bytes, i: int) -> float:
    alone, conditional, _ = _compressors()
    return 1 - len(conditional[i].compress(data)) / len(alone.compress(data))


def ranked(block: str) -> list[tuple[float, int]]:
    """(share of bytes saved, template) by falling share; ties go to the earlier template."""
    data = _plain(words(block))
    return sorted(((_saving(data, i), i) for i in range(len(TEMPLATES))), key=lambda x: (-x[0], x[1]))


@cache
def _anchors() -> tuple[tuple[str, int], ...]:
    """Of each template a telling word that few other texts hold, and its place."""
    return tuple(next((w, j) for j, w in enumerate(template) if w in TELLING and w not in _COMMON) for template in _compressors()[2])


def _aligned(template: list[str], block: list[str]) -> tuple[list[str], list[str], range]:
    """differences, and the places of the block within the wording."""
    matched = [m for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not matched:
        return list(template), [], range(0)
    in_template = {i for m in matched for i in range(m.a, m.a + m.size)}
    in_block = {i for m in matched for i in range(m.b, m.b + m.size)}
    inside = range(matched[0].b, matched[-1].b + matched[-1].size)
    return [w for i, w in enumerate(template) if i not in in_template], [block[i] for i in inside if i not in in_block], inside


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the block lacks, and words that the block has within the wording."""
    return _aligned(template, block)[:2]


def confirmed(own: list[str]) -> list[tuple[int, int, str, float, list[str], list[str]]]:
    """First and last place, license, saving, missing and extra words of every notice that these words hold."""
    places: dict[str, list[int]] = {}
    for at, w in enumerate(own):
        if w in TELLING:
            places.setdefault(w, []).append(at)
    met = []
    for i, (anchor, j) in enumerate(_anchors()):
        template = _compressors()[2][i]
        spare = int(SLACK * len(template))
        for at in places.get(anchor, ()):
            start = max(0, at - j - spare)
            window = own[start : max(0, at - j + len(template) + spare)]
            saved = _saving(_plain(window), i)
            if saved < SAVING:
                continue
            missing, extra, inside = _aligned(template, window)
            telling = any(w in TELLING or any(c.isdigit() for c in w) for w in missing + extra)
            if not telling and len(missing) + len(extra) <= SLACK * len(template):
                met.append((start + inside[0], start + inside[-1], TEMPLATES[i][0], saved, missing, extra))
    out: list[tuple] = []
    taken: set[int] = set()
    for x in sorted(met, key=lambda x: (x[0] - x[1], -x[3])):
        if taken.isdisjoint(span := range(x[0], x[1] + 1)):
            taken.update(span)
            out.append(x)
    return sorted(out, key=lambda x: x[0])


def findings(text: str) -> list[tuple[int, str, float, str, str]]:
    """(line, license, saving, missing, extra) in the order of the text; the line is that of the notice's first word."""
    lines, out = text.split("\n"), []
    for blank, group in groupby(enumerate(lines), lambda x: not x[1].strip()):
        paragraph = list(group)
        if blank or not _cue.search("\n".join(line for _, line in paragraph)):
            continue
        own = [(w, n) for n, line in paragraph for w in words(line)]
        for first, _, license_id, saved, missing, extra in confirmed([w for w, _ in own]):
            out.append((own[first][1], license_id, float(saved), " ".join(missing), " ".join(extra)))
    return out


@F.pandas_udf(_FOUND)
def _scan(texts: pd.Series) -> pd.Series:
    names = ("line", "license", "saved", "missing", "extra")
    return pd.Series([[dict(zip(names, x, strict=True)) for x in findings(t)] if t else [] for t in texts])


def license_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with findings appended: an array of struct(line, license, saved, missing, extra), in the order of the
    text, lines from 0, one for every notice. A null or empty text has none, repeated rows are scanned alike and an empty table stays empty. Texts without any cue
    stay in the JVM. An input column named findings is replaced; all others pass through.
    """
    bounded_batches(docs.sparkSession)
    text = text_of(text_col)
    return docs.drop("findings").withColumn("findings", _scan(F.when(text.rlike(CUE), text)))
