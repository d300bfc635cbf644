"""Operator 1: licence scan by a trained paragraph classifier.

Units are the lines of a text and, for notices wrapped over lines, the runs of
lines within a paragraph (lines up to a blank one) that share word runs, also
across line ends, with a family's templates. Punctuation around words does not
count, so comment marks vanish. Their features are hashed word n-grams
(n = 1 to 3), sparse; a softmax regression over the licence families and
``unknown`` is fitted in numpy. Its training rows are the templates below with
seeded variations (words left out, neighbouring text added) and, as unknown, a
bounded sample of the corpus's own paragraphs (of ``SAMPLE`` documents by hash of
doc_id) that share no run of words with a template. A quarter of the rows is
held back to calibrate: a temperature by likelihood, and the least probability at
which at most ``FALSE`` of the held-back unknown rows pass for a licence.

A predicted family is confirmed by comparing the paragraph with the family's
templates: the share of a template's word trigrams that the paragraph contains
must reach ``OVERLAP``. Families of nearly the same wording (versions, Affero and
Lesser, the Creative Commons conditions, the number of clauses) are classes of
their own, and the paragraph must also hold what tells its family from them
(``MARKS``): a notice of a version that no class knows stays unknown. A paragraph that shares no trigram with any template can
never be confirmed, so it is not classified at all; that is exact.

Scanning is a narrow map over whole texts; the model (``2**BITS`` weights a family
and the templates' trigrams) has a fixed size. A null or empty text has no
paragraphs. Repeated rows each get their row; doc_id may be null; more columns are
ignored. Words and hashes are those of ``shingles``, without punctuation around them.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shingles import mix, words

BITS = 14
SAMPLE = 2000
VARIANTS = 24
FALSE = 0.002
OVERLAP = 0.5
EPOCHS = 100
UNKNOWN = "unknown"

# How licences are usually named or begun in running text.
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only"],
    "Apache-1.1": [
        "Licensed under the Apache Software License, Version 1.1.",
        "SPDX-License-Identifier: Apache-1.1"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "Released under the Simplified BSD License.",
        "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only"],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only"],
    "MIT": [
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0"],
}
# What tells families of nearly the same wording apart, as patterns
# over the lower-cased paragraph. A family needs all of the first and none of the second.
_GNU3, _GNU2 = r"(?:version |v\. ?|v|gpl-|license )3(?:\.0)?(?![.\d])", r"(?:version |v\. ?|v|gpl-|license )2(?:\.0)?(?![.\d])"
_NC, _ND, _SA = (r"noncommercial|non-commercial|\bnc\b", r"noderiv|no-deriv|no deriv|\bnd\b", r"sharealike|share-alike|share alike|\bsa\b")
MARKS = {
    "AGPL-3.0": ([r"affero|agpl", _GNU3], ["lesser"]),
    "Apache-1.1": ([r"1\.1"], [r"2\.0"]),
    "Apache-2.0": ([r"2\.0|version 2\b"], [r"1\.[01]"]),
    "BSD-2-Clause": ([r"(?:2|two)[- ]clause|simplified|freebsd"], [r"(?:[34]|three|four)[- ]clause"]),
    "BSD-3-Clause": ([], [r"(?:[0124]|one|two|four|zero)[- ]clause|simplified|freebsd|original"]),
    "CC-BY": ([], [_NC, _ND, _SA]),
    "CC-BY-NC": ([_NC], [_ND, _SA]),
    "CC-BY-NC-ND": ([_NC, _ND], [_SA]),
    "CC-BY-NC-SA": ([_NC, _SA], [_ND]),
    "CC-BY-ND": ([_ND], [_NC, _SA]),
    "CC-BY-SA": ([_SA], [_NC, _ND]),
    "EPL-2.0": ([r"eclipse|epl", r"2\.0"], [r"1\.0"]),
    "GPL-2.0": ([_GNU2], ["affero|agpl", "lesser|lgpl|library general"]),
    "GPL-3.0": ([_GNU3], ["affero|agpl", "lesser|lgpl|library general"]),
    "LGPL-2.1": ([r"lesser|lgpl", r"2\.1"], ["affero"]),
    "LGPL-3.0": ([r"lesser|lgpl", _GNU3], ["affero"]),
    "MIT": ([], [r"\bmit-0\b|no attribution"]),
    "MPL-2.0": ([r"mozilla|mpl", r"2\.0"], [r"1\.[01]"]),
}
# Sentences about rights that name no licence.
RIGHTS = [
    "All rights reserved.", "Copyright by the authors.", "Please read the terms of use before you continue.",
    "You need a licence to drive a car in this country.", "The licence fee is due every year.",
    "This work is dedicated to my parents.", "Released in the spring of that year.",
    "The general public was admitted free of charge."]

_WEIGHT = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)


#: Punctuation before and after words.
AROUND = re.compile(r"(?<![^\w\s])[^\w\s]++(?=\s|\Z)|(?<!\S)[^\w\s]+")
#: A run of lines goes on over a line without shared words.
GAP = 2


def _bare(lines: list[str]) -> pa.Array:
    return pa.array(AROUND.sub("", "\n".join(lines)).split("\n") if lines else [], pa.string())


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = hashes[:count] * _WEIGHT[0]
    for k in range(1, n):
        total = total + hashes[k:k + count] * _WEIGHT[k]
    return mix(total + np.uint64(n))


def _paragraph_hashes(lines: list[str]) -> list[np.ndarray]:
    out = []
    for _, hashes, bounds in words(_bare(lines)):
        out += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def _features(hashes: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([grams(hashes, n) for n in (1, 2, 3)]) >> np.uint64(64 - BITS)).astype(np.int32)


def _template_grams() -> dict[str, list[np.ndarray]]:
    """Trigrams of each template (of the whole template, if it is shorter)."""
    return {family: [np.unique(grams(h, min(3, len(h)))) for h in _paragraph_hashes(texts)]
            for family, texts in TEMPLATES.items()}


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(paragraphs: list[str]) -> dict:
    """The model, from the templates and paragraphs of the corpus."""
    rng = np.random.default_rng(1)
    names = [*sorted(TEMPLATES), UNKNOWN]
    sharing = {k for k, _ in _sharing(paragraphs, _known(_template_grams()))}
    plain = [p for k, p in enumerate(paragraphs) if k not in sharing and AROUND.sub("", p).split()]
    texts, target = [], []
    for family, templates in sorted(TEMPLATES.items()):
        for text in templates:
            for k in range(VARIANTS):
                kept = [w for w in text.split() if not k or rng.random() > 0.08]
                beside = plain[rng.integers(len(plain))].split()[:12] if plain and k % 3 == 2 else []
                near = " ".join([*kept, *beside] if k % 2 else [*beside, *kept])
                texts.append(near if AROUND.sub("", near).split() else text)
                target.append(names.index(family))
    others = [*plain, *(s for s in RIGHTS for _ in range(VARIANTS))]
    texts += others
    target += [len(names) - 1] * len(others)
    target = np.array(target)
    feats = [_features(h) for h in _paragraph_hashes(texts)]
    held = rng.random(len(texts)) < 0.25
    row = np.repeat(np.arange(len(feats)), list(map(len, feats)))
    col = np.concatenate(feats)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(feats))))
    weight, bias = np.zeros((1 << BITS, len(names))), np.zeros(len(names))

    first = np.cumsum([0, *map(len, feats)])[:-1]  # every row has words, so none is empty

    def logits():
        return np.add.reduceat(weight[col], first, axis=0) * scale[:, None] + bias

    share = np.where(held, 0.0, 1 / np.bincount(target[~held], minlength=len(names))[target].clip(1))
    share /= share.sum()  # every class counts alike
    order = np.argsort(col, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(col[order]) > 0])
    speed_w, speed_b = np.zeros_like(weight), np.zeros_like(bias)
    for _ in range(EPOCHS):
        error = _softmax(logits())
        error[np.arange(len(target)), target] -= 1
        error *= share[:, None]
        pull = np.add.reduceat((error * scale[:, None])[row[order]], starts, axis=0)
        speed_w *= 0.9
        speed_w[col[order][starts]] += pull
        speed_b = 0.9 * speed_b + error.sum(axis=0)
        weight -= 20 * (speed_w + 1e-6 * weight)
        bias -= speed_b
    z, y = logits()[held], target[held]
    heats = np.array([0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0])
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y].clip(1e-12)).mean() if len(y) else 0.0 for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    wrong = np.sort(_softmax(z / heat)[y == len(names) - 1][:, :-1].max(axis=1)) if (y == len(names) - 1).any() else np.zeros(1)
    least = max(0.5, min(0.999, float(wrong[min(len(wrong) - 1, int(np.ceil(len(wrong) * (1 - FALSE))))])))
    return {"names": names, "weight": weight.astype(np.float32), "bias": bias, "heat": heat, "least": least}


def _sharing(lines: list[str], known: dict[int, np.ndarray]):
    """(line, word hashes) of the lines that share a run of words with a template."""
    for first, hashes, bounds in words(_bare(lines)):
        hit = set()
        for n, every in known.items():
            own = grams(hashes, n)
            at = np.flatnonzero(every[np.searchsorted(every, own).clip(max=len(every) - 1)] == own)
            line = np.searchsorted(bounds, at, side="right") - 1
            hit.update(line[at + n <= bounds[line + 1]].tolist())
        for k in sorted(hit):
            yield first + k, hashes[bounds[k]:bounds[k + 1]]


def _marked(family: str, lines: list[str]) -> bool:
    """Whether the lines hold what tells the family from its like."""
    text = " ".join(AROUND.sub("", "\n".join(lines)).lower().split())
    needs, never = MARKS[family]
    return all(re.search(p, text) for p in needs) and not any(re.search(p, text) for p in never)


def _known(templates: dict[str, list[np.ndarray]]) -> dict[int, np.ndarray]:
    sizes: dict[int, list[np.ndarray]] = {}
    for family, texts in TEMPLATES.items():
        for h, g in zip(_paragraph_hashes(texts), templates[family]):
            sizes.setdefault(min(3, len(h)), []).append(g)
    return {n: np.unique(np.concatenate(g)) for n, g in sizes.items()}


def classify(lines: list[str], model: dict, templates: dict[str, list[np.ndarray]],
             known: dict[int, np.ndarray] | None = None, starts=()) -> list[tuple[int, str, float, float]]:
    """(line, family, probability, overlap) of the confirmed lines and runs of
    lines (by their first); ``starts`` are lines that begin another text."""
    known = known or _known(templates)
    found = [(h, b) for _, h, b in words(_bare(lines))]
    if not found:
        return []
    hashes = np.concatenate([h for h, _ in found])
    ends = np.cumsum(np.concatenate([np.diff(b) for _, b in found]))
    bounds = np.concatenate([[0], ends])
    line_of = np.repeat(np.arange(len(lines)), np.diff(bounds))
    new = np.diff(bounds) == 0
    new[list(starts)] = True
    part = np.cumsum(new)  # the paragraph of each line
    shared = []  # first line, last line, run of words
    for n, every in known.items():
        own = grams(hashes, n)
        at = np.flatnonzero(every[np.searchsorted(every, own).clip(max=len(every) - 1)] == own)
        first, last = line_of[at], line_of[at + n - 1]
        same = part[first] == part[last]
        shared.append((first[same], last[same], own[at[same]]))
    first, last, shared = (np.concatenate(x) for x in zip(*shared))
    out = []

    def judge(a, b):
        own = hashes[bounds[a]:bounds[b + 1]]
        seen = _features(own)
        z = model["weight"][seen].sum(axis=0) / np.sqrt(len(seen)) + model["bias"]
        chance = _softmax(z[None, :] / model["heat"])[0]
        best = int(chance.argmax())
        if model["names"][best] == UNKNOWN or chance[best] < model["least"]:
            return False
        own = np.concatenate([grams(own, n) for n in known])
        overlap = max(float(np.isin(g, own).mean()) for g in templates[model["names"][best]])
        confirmed = overlap >= OVERLAP and _marked(model["names"][best], lines[a:b + 1])
        if confirmed:
            out.append((a, model["names"][best], float(chance[best]), overlap))
        return confirmed

    sure = {k for k in np.unique(first[first == last]).tolist() if judge(k, k)}
    runs = set()
    for family in templates.values():
        hit = np.isin(shared, np.concatenate(family))
        rest = sorted(set(np.concatenate([first[hit], last[hit]]).tolist()) - sure)
        run = []
        for k in [*rest, len(lines)]:
            if run and (k == len(lines) or k - run[-1] > GAP or part[k] != part[run[-1]] or sure & set(range(run[-1], k))):
                if run[0] < run[-1]:
                    runs.add((run[0], run[-1]))
                run = []
            run.append(k)
    for a, b in sorted(runs):
        judge(a, b)
    return sorted({(k, f): (k, f, c, o) for k, f, c, o in sorted(out, key=lambda x: x[2])}.values())


def train(docs: DataFrame) -> dict:
    """The model, fitted in one task on the paragraphs of ``SAMPLE`` documents."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text", F.lit(0).alias("one"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(2)
        lines = sorted({line for text in frame["text"].dropna() for line in text.split("\n") if line.strip()})
        # three times as many as the templates' rows; long ones weigh no more than short ones
        lines = [lines[k] for k in rng.permutation(len(lines))[:3 * VARIANTS * sum(map(len, TEMPLATES.values()))]]
        return pd.DataFrame({"model": [pickle.dumps(fit(lines))]})

    found = rows.groupBy("one").applyInPandas(run, "model binary").first()
    return pickle.loads(bytes(found["model"])) if found else fit([])


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, n_licensed, families, found): lines that are
    not blank, lines and runs of lines with a confirmed licence, the sorted distinct families, and
    ``line:family:probability:overlap`` of each (lines from 0)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches):
        templates = _template_grams()
        known = _known(templates)
        for batch in batches:
            held, size, first = [], 0, 0
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                held.append((text or "").split("\n"))
                size += len(text or "")
                if size < 1 << 20 and i < len(texts) - 1:
                    continue
                lines = [line for own in held for line in own]
                owner = np.repeat(np.arange(len(held)), list(map(len, held)))
                start = np.cumsum([0, *map(len, held)])
                found = [[] for _ in held]
                for k, family, chance, overlap in classify(lines, model.value, templates, known, start[:-1]):
                    found[owner[k]].append((k - start[owner[k]], family, chance, overlap))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(held)),
                    pa.array([sum(bool(line.strip()) for line in own) for own in held], pa.int64()),
                    pa.array(map(len, found), pa.int64()),
                    pa.array([",".join(sorted({f[1] for f in own})) for own in found], pa.string()),
                    pa.array([",".join(f"{k}:{f}:{p:.3f}:{o:.3f}" for k, f, p, o in own) for own in found], pa.string())],
                    ["doc_id", "n_paragraphs", "n_licensed", "families", "found"])
                held, size, first = [], 0, i + 1

    return docs.mapInArrow(run, "doc_id long, n_paragraphs long, n_licensed long, families string, found string")
