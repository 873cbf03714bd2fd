"""Merkle manifest, ranked search and embedding links against brute force, and repeated rows in the older operators."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import decontaminate, embeddings, fingerprint, lexical, merkle, mixing, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, digest string, pos int, tree string, `rank` int, row string, score double, node string"
EXTRA = ("x", "y", 1, "z", 2, "r", 0.5, "n")


def sentence(rnd, n):
    return " ".join("".join(rnd.choice(["th", "er", "on", "É", "re", "in", "Ed", "7"]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- 11 Merkle manifest ---


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text=False):
    return h(*map(field, (r[0], r[3], r[2], r[4], r[1] if text is False else text)))


def climbed(nodes):
    """Levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    for nodes in levels[:-1]:
        first = at - at % 3
        yield nodes[first:at], nodes[at + 1 : first + 3]
        at //= 3


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([leaf(r) for r in sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in names}
    crown = climbed([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, r in enumerate(sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            path = [*siblings(trees[s], at), *siblings(crown, k)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            fold = leaf(r, r[1].replace("\n", "")) if changed else leaf(r)
            for a, b in path:
                fold = h(*a, fold, *b)
            out.append((str(r[0]), leaf(r), trees[s][-1][0], crown[-1][0], h(*(x for a, b in path for x in (*a, *b))), fold, fold == crown[-1][0]))
    return sorted(out)


def manifest_of(df):
    when = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], altered={"text": F.replace("text", F.lit("\n"), F.lit(""))}, when=when)
    return sorted((str(r.id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect())


@pytest.mark.parametrize("deep", [1, 2, 6])
def test_manifest(spark, monkeypatch, deep):
    monkeypatch.setattr(merkle, "DEEP", deep)
    rnd = random.Random(deep)
    rows = [(i, sentence(rnd, 5).replace(" ", rnd.choice([" ", "\n"])), rnd.choice(["en", None]), "hot" if i % 3 else f"s{i % 11}", i) for i in range(150)]
    rows += [(7, "other\ntext", "en", "hot", None), (7, None, None, "hot", None), (None, "a", "en", "hot", 1), (None, "b", "en", "hot", 1), (-5, "", "en", None, 0), (8, "é" * 5000 + "\n", "en", None, 2), (9, "x", "en", "", 1), (10, "x", "en", "ü", 1), (11, "\n", "en", "Z", 1)]
    rows += [rows[0], rows[0], rows[-1]]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(5)
    got, want = manifest_of(df), plain_manifest(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    # Rows that are equal in all fields differ by their places only, so results are compared as a whole.
    assert got == want and {g[-1] for g in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = [(3, "a\nb", "en", "s", 3)]
    assert manifest_of(spark.createDataFrame([(*one[0], *EXTRA)], SCHEMA)) == plain_manifest(one)
    assert plain_manifest(one)[0][4] == hashlib.sha256(b"").hexdigest()
    assert manifest_of(spark.createDataFrame([], SCHEMA)) == []


# --- 12 Ranked search ---


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain_search(docs, items, k):
    bags = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n, length = sum(x[2] > 0 for x in bags), sum(x[2] for x in bags)
    df = Counter(w for _, c, _ in bags for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, counts, size in bags:
            m = 25 + (75 * size * n) // max(length, 1)
            score = sum(q * weight[w] * ((10**9 * counts[w]) // (1000 * counts[w] + 8 * m)) for w, q in Counter(words(text)).items() if w in counts)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library():
    rnd = random.Random(6)
    docs = [(i, sentence(rnd, rnd.randint(1, 60))) for i in range(250)]
    copied = sentence(rnd, 30)
    docs += [(300 + i, copied) for i in range(25)] + [(None, copied), (None, copied), (5, copied), (5, copied), (400, None), (401, ""), (402, "-- ,"), (403, " ".join(["thth"] * 3000) + " only"), (404, "only")]
    items = [(i, sentence(rnd, rnd.randint(1, 20))) for i in range(25)] + [(30, copied), (31, None), (32, ""), (33, "notthere"), (34, "only notthere"), (35, "th th th er"), (30, "only"), (None, copied[:40])]
    return docs, items


@pytest.mark.parametrize(("slack", "wanted", "k"), [(0.4, 200_000, 10), (1.0, 200_000, 3), (0.0, 0, 10), (0.7, 0, 1)])
def test_search(spark, library, monkeypatch, slack, wanted, k):
    monkeypatch.setattr(lexical, "WANTED", wanted)
    monkeypatch.setattr(lexical, "FLUSH", 50)
    docs, items = library
    df = spark.createDataFrame([(i, t, "en", "s", 1, *EXTRA) for i, t in docs], SCHEMA).repartition(4)
    asked = spark.createDataFrame([(i, t, 0.1, 2, 3) for i, t in items], "item_id bigint, text string, score double, term int, `row` int")
    got = sorted(((r.item_id, r.rank, r.id, r.score) for r in lexical.top_documents(df, asked, k, slack=slack).collect()), key=str)
    assert got == plain_search(docs, items, k)


def test_search_without_rows(spark, library):
    docs = spark.createDataFrame([(*d, "en", "s", 1, *EXTRA) for d in library[0]], SCHEMA)
    asked = spark.createDataFrame([(1, "th er")], "item_id bigint, text string")
    assert lexical.top_documents(docs.limit(0), asked).count() == 0
    assert lexical.top_documents(docs, asked.limit(0)).count() == 0


# --- 13 Embedding links ---


def plain_links(rows, threshold=0.9):
    """(id, links, component) of each row, by the whole matrix."""
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64) / np.abs(v).max()) / np.abs(v).max() if ok else None for (_, v), ok in zip(rows, good, strict=True)]
    n, up, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return sorted(((key, links[i], least.get(top(i))) for i, (key, _) in enumerate(rows)), key=str)


def vectors(seed=0, size=16):
    rnd = np.random.default_rng(seed)
    out = [rnd.standard_normal(size) for _ in range(150)]
    centre = rnd.standard_normal(size)
    for spread, n in ((0.02, 60), (0.1, 60), (0.16, 60)):  # near copies, some of which link only with some
        out += [centre + spread * rnd.standard_normal(size) for _ in range(n)]
    chain = np.zeros(size)
    for i in range(12):
        angle = i * 0.3
        chain[0], chain[1] = math.cos(angle), math.sin(angle)
        out.append(chain.copy())
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(out)]
    odd = [[math.nan, *[1.0] * (size - 1)], [None, *[1.0] * (size - 1)], [math.inf] * size, [0.0] * size, [], None, rows[0][1], rows[0][1], rows[200][1], rows[0][1][:5], rows[0][1][:5], [2 * x for x in rows[1][1]], [-x for x in rows[2][1]]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)] + [(None, rows[3][1]), (None, rows[3][1]), (None, None), (None, [9.0, 1.0]), (3, rows[3][1]), (4, rows[5][1]), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize(("crowd", "chunk"), [(32, 2000), (3, 7)])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_links(spark, monkeypatch, crowd, chunk, kind):
    monkeypatch.setattr(embeddings, "CROWD", crowd)
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], f"vec_id bigint, embedding array<{kind}>, label int, node string, size int").repartition(4)
    got = sorted(((r.id, r.n_links, r.component) for r in embeddings.links(df, recall=0.999).collect()), key=str)
    assert got == plain_links(rows)


def test_links_of_few_dimensions_and_of_nothing(spark):
    schema = "vec_id bigint, embedding array<double>"
    for size in (1, 2, 3):
        rnd = np.random.default_rng(size)
        rows = [(i, rnd.standard_normal(size).tolist()) for i in range(60)] + [(100, [1e200] * size), (101, [1e-200] * size)]
        got = {r.id: r.n_links for r in embeddings.links(spark.createDataFrame(rows, schema), recall=0.999).collect()}
        want = {key: n for key, n, _ in plain_links(rows)}
        assert all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.9 * sum(want.values()) > 0
    assert embeddings.links(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in embeddings.links(spark.createDataFrame([(1, None), (None, [0.0])], schema)).orderBy("id").collect()] == [(None, 0, None), (1, 0, 1)]


def test_recall_of_the_tables(spark):
    """Pairs at exactly the threshold, the hardest ones, among many unlike vectors."""
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((1500, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rnd.standard_normal((1500, 48))
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    y = 0.9005 * x + math.sqrt(1 - 0.9005**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id bigint, embedding array<double>")
    assert sum(r.n_links for r in embeddings.links(df).collect()) >= 0.9 * 3000


# --- Repeated rows, equal ids and large groups in older operators ---


def test_repeated_rows_over_several_query_blocks(spark):
    rnd = random.Random(1)
    texts = [sentence(rnd, 30) for _ in range(10)]
    rows = [(i % 5, texts[i % 10]) for i in range(20)]
    bench = spark.createDataFrame([(i, texts[i]) for i in range(6)], "item_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    twice = docs.unionByName(docs)  # two equal segments
    form = lambda found: sorted((r.id, r.n_words, tuple(r.starts), tuple(r.ends), tuple(r["items"])) for r in found.collect())
    one, many = form(decontaminate.matches(twice, bench)), form(decontaminate.matches(twice, bench, block_words=1))
    assert len(one) == 40 and one == many and sum(bool(r[4]) for r in one) == 24


def test_colliding_texts_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda canon: "d")
    rows = [(2, "aa"), (2, "cc dd"), (3, "CC dd"), (1, "aa"), (2, "bb"), (None, "bb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(r.fingerprint for r in fingerprint.fingerprints(docs).collect())
    assert sorted(got.values()) == [2, 2, 2]


def test_rows_that_differ_in_one_column_stay_themselves(spark):
    rnd = random.Random(1)
    rows = [(1, sentence(rnd, 200), "s", n) for n in ("x1", "x2", None)]
    rows[1], rows[2] = (1, rows[0][1], "s", "x2"), (1, rows[0][1], "s", None)
    out = mixing.mixed_documents(spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, source string, notes string"), share=1.0).collect()
    assert Counter(r.notes for r in out) == {"x1": 2, "x2": 1, None: 1} and all(r.text == rows[0][1] for r in out)


def components_of(n, a, b):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a, b, strict=True):
        up[max(top(x), top(y))] = min(top(x), top(y))
    return [top(x) for x in range(n)]


def test_large_groups_keep_every_connection():
    rnd = np.random.default_rng(9)
    for case in range(12):
        flips = [3, 10, 25, 40][case % 4]
        centres = rnd.integers(0, 1 << 63, (4, 8), dtype=np.uint64)
        prints = centres[rnd.integers(0, 4, 150)]
        for row in prints:
            for bit in rnd.integers(0, 512, flips):
                row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=np.int64)
        for most in (12, 30, 60):
            x, y = np.nonzero(np.triu(far <= most, 1))
            a, b = simhash.held_together(prints, most)
            assert all(far[i, j] <= most for i, j in zip(a, b, strict=True))
            assert components_of(150, a.tolist(), b.tolist()) == components_of(150, x.tolist(), y.tolist()) and len(a) < 150


def test_a_large_group_of_unlike_texts_takes_seconds():
    prints = np.random.default_rng(1).integers(0, 1 << 63, (10_000, 8), dtype=np.uint64)
    start = time.time()
    a, _ = simhash.close_pairs(np.zeros(10_000, np.int64), prints, 80)
    assert not len(a) and time.time() - start < 60
