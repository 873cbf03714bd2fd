"""License scans: a trained paragraph classifier whose predictions templates confirm.

Paragraphs are lines; longer ones are cut into overlapping windows. A multinomial logistic regression over hashed word
1- and 2-grams, scaled to length 1, tells licence families from an unknown class. It is trained here on seeded variants
of the templates below (words dropped, doubled, swapped for strange ones, embedded in ordinary text) against ordinary
words, template words out of order and a bounded sample of the corpus' own paragraphs without a licence word
(``corpus_rows`` paragraphs, the first ``LONG`` words of each). A temperature calibrates the probabilities; it is fitted
on other variants and on a quarter of the sample that nothing was trained on. A paragraph whose best family stays below
``least`` is unknown. A prediction counts as confirmed if a template of that family has at least ``cover`` of its word
2-grams in the paragraph. Every paragraph of every text is classified, many at a time.

Defined results: a null text counts as empty; a text without paragraphs has no licence; equal rows get equal results;
of paragraphs with equal probability the first counts; a null id is kept; a text of any length is scanned whole; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]")
LONG, STEP, BITS, UNKNOWN = 60, 30, 14, "unknown"
DIM, TOGETHER, ROWS_TOGETHER = 1 << BITS, 50_000, 256
#: Phrases that name a licence, by family, as licence notices state them.
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the mit license", "this project is available under the terms of the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "spdx-license-identifier mit"],
    "apache-2.0": ["licensed under the apache license version 2.0", "released under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache.org", "spdx-license-identifier apache-2.0"],
    "bsd": ["licensed under the bsd license", "released under the 3-clause bsd license", "redistribution and use in source and binary forms with or without modification are permitted", "spdx-license-identifier bsd-3-clause"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 2", "you can redistribute it and or modify it under the terms of the gnu general public license", "spdx-license-identifier gpl-3.0-or-later"],
    "lgpl": ["licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license version 2.1", "spdx-license-identifier lgpl-2.1-or-later"],
    "agpl": ["licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license", "spdx-license-identifier agpl-3.0-only"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license version 2.0", "spdx-license-identifier mpl-2.0"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc0": ["released into the public domain under cc0 1.0 universal", "to the extent possible under law the author has waived all copyright and related rights"],
    "proprietary": ["all rights reserved no part of this publication may be reproduced without prior written permission", "this software is proprietary and confidential"],
}
FAMILIES = [UNKNOWN, *TEMPLATES]
ORDINARY = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through".split()


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def paragraphs(text: str) -> list[list[str]]:
    out = []
    for line in text.split("\n"):
        words = words_of(line)
        out += [words[i : i + LONG] for i in range(0, max(1, len(words) - STEP), STEP)] if len(words) > LONG else [words] if words else []
    return out


def matrix(rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row (of one word at least) begins, feature numbers by row, and their values: roots of how often the
    row's 1- and 2-grams come, scaled to length 1."""
    size = np.array([len(r) for r in rows])
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for r in rows for w in r), np.uint64, int(size.sum()))
    row = np.repeat(np.arange(len(rows)), size)
    pair = np.flatnonzero(row[1:] == row[:-1])
    two = (words[pair] * np.uint64(0x9E3779B97F4A7C15) + words[pair + 1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    feature = np.concatenate((words, two)) >> np.uint64(64 - BITS)
    key = np.sort(np.concatenate((row, row[pair])) * DIM + feature.astype(np.int64))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(first, len(key)))
    at = key[first] // DIM
    value = np.sqrt(n / (2 * size - 1)[at])
    return np.searchsorted(at, np.arange(len(rows))), key[first] % DIM, value


def examples(seed: int, variants: int, corpus: list[list[str]]) -> tuple[list[list[str]], list[int]]:
    """Seeded variants of all templates, and as many paragraphs without licence."""
    rnd = random.Random(seed)
    pool = sorted({w for texts in TEMPLATES.values() for t in texts for w in words_of(t)})
    strange = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "es", "ver", "lich", "eux", "que"]) for _ in range(rnd.randint(1, 4)))
    filler = lambda n: [rnd.choice(ORDINARY) if rnd.random() < 0.5 else strange() for _ in range(n)]
    rows, classes = [], []
    for family, texts in TEMPLATES.items():
        for text in texts:
            for _ in range(variants):
                words = [strange() if rnd.random() < 0.03 else w for w in words_of(text) if rnd.random() > 0.04]
                rows.append([*filler(rnd.choice((0, 0, 0, 2, 6, 15))), *words, *filler(rnd.choice((0, 0, 0, 2, 6, 15)))])
                classes.append(FAMILIES.index(family))
    for _ in range(len(rows) // 2):
        mixed = filler(rnd.randint(3, 40))
        for _ in range(rnd.randint(0, 5)):
            mixed.insert(rnd.randint(0, len(mixed)), rnd.choice(pool))
        rows.append(mixed)
        classes.append(0)
    for words in corpus:
        rows.append(words)
        classes.append(0)
    return rows, classes


class Classifier:
    def __init__(self, corpus: list[list[str]] = (), seed: int = 7, variants: int = 40, steps: int = 300):
        held_back = list(corpus)[::4]
        rows, classes = examples(seed, variants, [c for i, c in enumerate(corpus) if i % 4])
        start, feature, value = matrix(rows)
        value = value.astype(np.float32)[:, None]
        used, column = np.unique(feature, return_inverse=True)
        row = np.repeat(np.arange(len(rows)), np.diff(np.append(start, len(feature))))
        by_column = np.argsort(column, kind="stable")
        column_start = np.searchsorted(column[by_column], np.arange(len(used)))
        truth = np.eye(len(FAMILIES), dtype=np.float32)[np.array(classes)]
        w, b = np.zeros((len(used), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
        for _ in range(steps):
            gap = (self._softmax(np.add.reduceat(w[column] * value, start) + b) - truth) / len(rows)
            slope = np.add.reduceat((gap[row] * value)[by_column], column_start)
            speed_w, speed_b = 0.9 * speed_w + slope + 1e-6 * w, 0.9 * speed_b + gap.sum(0)
            w, b = w - 12 * speed_w, b - 2 * speed_b
        self.weights, self.bias = np.zeros((DIM, len(FAMILIES)), np.float32), b
        self.weights[used] = w
        apart, apart_classes = examples(seed + 1, max(4, variants // 5), held_back)
        z, t = self.logits(apart), np.array(apart_classes)
        loss = lambda s: -np.log(self._softmax(z * s)[np.arange(len(t)), t] + 1e-12).mean()
        self.scale = min((0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0), key=loss)
        self.pairs = {f: [{*zip(w, w[1:], strict=False)} for w in map(words_of, texts)] for f, texts in TEMPLATES.items()}

    @staticmethod
    def _softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def logits(self, rows: list[list[str]]) -> np.ndarray:
        if not rows:
            return np.zeros((0, len(FAMILIES)), np.float32)
        start, feature, value = matrix(rows)
        return np.add.reduceat(self.weights[feature] * value.astype(np.float32)[:, None], start) + self.bias

    def covered(self, family: str, words: list[str]) -> float:
        """The best share of a template's word pairs that the paragraph has."""
        own = {*zip(words, words[1:], strict=False)}
        return max(len(t & own) / len(t) for t in self.pairs[family])

    def judge(self, rows: list[list[str]], least: float, cover: float) -> list[tuple[int, str, float, bool]]:
        """(row, family, probability, confirmed) of each paragraph that is not unknown."""
        p = self._softmax(self.scale * self.logits(rows))
        best = p.argmax(axis=1)
        sure = np.flatnonzero((best > 0) & (p.max(axis=1) >= least)).tolist()
        return [(k, FAMILIES[best[k]], float(p[k, best[k]]), self.covered(FAMILIES[best[k]], rows[k]) >= cover) for k in sure]

    def scan(self, texts: list[str], least: float, cover: float) -> list[tuple[list[tuple[int, str, float, bool]], int]]:
        """Of each text, (paragraph, family, probability, confirmed) of each paragraph that is not unknown, and the number
        of paragraphs. Some ``TOGETHER`` words are classified at once."""
        out: list[tuple[list, int]] = []
        rows, owner, words = [], [], 0

        def flush():
            for k, *found in self.judge(rows, least, cover):
                out[owner[k][0]][0].append((owner[k][1], *found))
            rows.clear()
            owner.clear()

        for i, text in enumerate(texts):
            own = paragraphs(text)
            out.append(([], len(own)))
            for k, line in enumerate(own):
                rows.append(line)
                owner.append((i, k))
                words += len(line)
                if words >= TOGETHER:
                    flush()
                    words = 0
        flush()
        return out


def corpus_paragraphs(docs: DataFrame, text_col: str, corpus_rows: int) -> list[list[str]]:
    """At most corpus_rows paragraphs of docs without a licence word: of each class of their hashes, the one with the
    smallest hash; cut to their first LONG words."""
    line = F.explode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")).alias("line")
    lines = docs.select(line).select(F.xxhash64("line").alias("h"), F.array_join(F.slice(F.split(F.lower("line"), " "), 1, LONG), " ").alias("line"))
    plain = lines.filter((F.trim("line") != "") & ~F.col("line").rlike("licen[sc]e|copyright|creative|public domain|spdx"))
    rows = plain.groupBy(F.pmod("h", F.lit(corpus_rows)).alias("class")).agg(F.min(F.struct("h", "line")).alias("least")).orderBy("class").collect()
    return [w[:LONG] for r in rows if (w := words_of(r.least.line))]


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, cover: float = 0.6, corpus_rows: int = 500) -> DataFrame:
    """Per row: id, license (family of the likeliest confirmed paragraph, else unknown if one is not confirmed, else none),
    probability, families (all confirmed), n_paragraphs, n_license (confirmed), n_unconfirmed."""
    model = docs.sparkSession.sparkContext.broadcast(Classifier(corpus_paragraphs(docs, text_col, corpus_rows)))
    schema = pa.schema([("id", pa.int64()), ("license", pa.string()), ("probability", pa.float64()), ("families", pa.list_(pa.string())), ("n_paragraphs", pa.int64()), ("n_license", pa.int64()), ("n_unconfirmed", pa.int64())])

    def judge(key, found, n):
        sure = [f for f in found if f[3]]
        best = max(sure or found, key=lambda f: (f[2], -f[0]), default=None)
        return {"id": key, "license": "none" if best is None else best[1] if sure else UNKNOWN, "probability": best[2] if best else 0.0, "families": sorted({f[1] for f in sure}), "n_paragraphs": n, "n_license": len(sure), "n_unconfirmed": len(found) - len(sure)}

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_TOGETHER):
                batch = whole.slice(at, ROWS_TOGETHER)
                scanned = model.value.scan([t or "" for t in batch.column(1).to_pylist()], least, cover)
                yield pa.RecordBatch.from_pylist([judge(k, *found) for k, found in zip(batch.column(0).to_pylist(), scanned, strict=True)], schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, license string, probability double, families array<string>, n_paragraphs long, n_license long, n_unconfirmed long")
