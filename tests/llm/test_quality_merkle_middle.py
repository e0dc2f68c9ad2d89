"""Quality scores, the Merkle manifest and fill-in-the-middle against plain versions and on odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, n int, form string, score double, row string, fim string, u int, g string"
REST = ("p", 1, "f", 0.5, "r", "f", 2, "g")
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, "the quick brown fox", "en", "a", 19, *REST),
    (2, "the quick brown fox", "en", "a", 19, *REST),
    (2, "the quick brown fox", "en", "a", 19, *REST),
    (2, "another text of the same number", "en", "a", 19, *REST),
    (3, None, None, None, None, *[None] * 8),
    (4, "", "", "b", 0, *REST),
    (None, "without an id", "en", "b", 2**63 - 1, *REST),
    (None, "without an id", "en", "b", 2**63 - 1, *REST),
    (5, LONG, "de", "b", len(LONG), *REST),
    (7, "a <P> in a text", "fr", "c", 7, *REST),
    (8, "𝒳 ünïcödé\n\n  spaces\t日本語 x̣́ <", "fr", "c", 0, *REST),
    (-9, "negative", "fr", None, None, *REST),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 12
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, m):
    """Root of a list of digests, and of each the siblings and places level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + m]) for k in range(0, len(levels[-1]), m)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for nodes in levels[:-1]:
            start = i // m * m
            path.append((i - start, "".join(nodes[start : i] + nodes[i + 1 : start + m])))
            i //= m
        paths.append(path)
    return levels[-1][0] if leaves else None, paths


def brute_manifest(rows, m):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(None if r[2] is None else r[2].encode(), []).append((r[0], H(*map(field, (r[0], r[3], r[2], r[4], r[1])))))
    order = sorted(groups, key=lambda g: (g is not None, g))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = brute_tree([x[1] for x in groups[g]], m)
    root, over = brute_tree([trees[g][0] for g in order], m)
    return [(i, leaf, tuple(map(tuple, path + over[k])), trees[g][0], root) for k, g in enumerate(order) for (i, leaf), path in zip(groups[g], trees[g][1])]


def got_manifest(frame):
    return [(r.doc_id, r.leaf, tuple((s.pos, s.siblings) for s in r.path), r.subroot, r.root) for r in frame.collect()]


@pytest.mark.parametrize("fanout", [2, 3, 7])
def test_manifest_of_odd_rows(docs, none, fanout):
    from tamarisk.llm.merkle import manifest

    got = manifest(docs, fanout=fanout)
    assert got.columns == ["doc_id", "lang", "leaf", "path", "subroot", "root"]
    assert sorted(got_manifest(got), key=repr) == sorted(brute_manifest(ROWS, fanout), key=repr)
    assert manifest(none, fanout=fanout).count() == 0
    with pytest.raises(ValueError, match="fanout"):
        manifest(docs, fanout=1)


def test_manifest_of_several_rounds(spark, monkeypatch):
    from tamarisk.llm import merkle

    monkeypatch.setattr(merkle, "BLOCK", 4)
    rng = random.Random(5)
    rows = [(i, f"text {rng.random()}", rng.choice(["en"] * 8 + ["de", "", None, "é", "z"]), "s", i) for i in rng.sample(range(10**6), 150)]
    rows += [(10**7 + i, "x", f"group {i:02d}", None, None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for fanout in (2, 3):
        assert sorted(got_manifest(merkle.manifest(docs.repartition(5), fanout=fanout)), key=repr) == sorted(brute_manifest(rows, fanout), key=repr)


def test_audit_finds_what_was_tampered_with(docs):
    from tamarisk.llm.merkle import audited

    got = audited(docs).collect()
    hit = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
    some = {r.doc_id for r in got if not r.verified}
    assert len(got) == len(ROWS) and some == {r.doc_id for r in got if hit(r)} - {3, -9}
    assert all((r.folded_root == r.root) == r.verified for r in got)
    one = audited(docs.where("doc_id = 7")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_changes_against_a_manifest(spark, docs):
    from tamarisk.llm.merkle import changes, manifest

    once = docs.where("doc_id in (1, 4, 5, 7, 8)")
    made = manifest(once)
    now = once.where("doc_id != 1").withColumn("text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text"))).unionByName(docs.where("doc_id = 3"))
    assert {(r.doc_id, r.state) for r in changes(now, made).collect()} == {(1, "missing"), (3, "added"), (4, "same"), (5, "same"), (7, "changed"), (8, "same")}


# 13
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute_middle(i, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    t = UNIT.findall(text)
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_of_odd_rows(docs, none):
    from tamarisk.llm.fill_middle import digests, filled, restored

    made = filled(docs)
    got = made.select("row.*", F.col("fim").alias("made"), restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert tuple(r.made) == brute_middle(r.doc_id, r.text) and r.back == (r.text or "")
    assert made.select("row.*").columns == docs.columns and filled(none).count() == 0 and digests(filled(none)).count() == 0


def test_middle_against_brute_force(spark):
    from tamarisk.llm.fill_middle import digests, filled

    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abYZ09 <>PSM\né日𝒳") for _ in range(rng.randint(0, 40)))) for i in range(3000)]
    got = {r.doc_id: r for r in digests(filled(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    forms = set()
    for i, text in rows:
        n, form, p, m, output = brute_middle(i, text)
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_offsets_of_every_cut():
    from tamarisk.llm.fill_middle import Runs

    for text in ("", "a", "abc", "1", "12 ab", "ab 12", "a1b2", "𝒳é ab<cd>"):
        t, runs = UNIT.findall(text), Runs(text)
        assert [runs.offset(k) for k in range(len(runs) + 1)] == [len("".join(t[:k])) for k in range(len(t) + 1)]


# 11
def plain_counts(text):
    """The n-grams of a text, as tuples, by a regular expression."""
    words, shapes, before = [], [], None
    for x in re.finditer(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+", text):
        w = x[0]
        glued = x.start() > 0 and not text[x.start() - 1].isspace()
        if w[0].isalpha():
            up = sum(c != c.lower() for c in w)
            form = "lower" if not up else "caps" if up == len(w) > 1 else "title" if w[0] != w[0].lower() and up == 1 else "mixed"
        else:
            form = "digits" if w[0].isdigit() else w
        shapes.append((form, glued, w.lower() == before))
        words.append(w.lower())
        before = w.lower()
    from collections import Counter

    return Counter([("w", *words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)] + [("s", *shapes[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(shapes) - n + 1)])


@pytest.mark.parametrize("slice_", [1 << 18, 16])
def test_counted_grams(monkeypatch, slice_):
    from tamarisk.llm import quality

    monkeypatch.setattr(quality, "SLICE", slice_)
    quality._powers.cache_clear()
    texts = ["", "one", "The the THE thE, and 12 !! end", "a a a a\nb  b é É ## ## x1y", "Of### and&&& a|b | c"]
    for t in texts:
        want = sorted(plain_counts(t).values())
        buckets, values = quality.counted(t)
        norm = np.sqrt(sum(c * c for c in want)) or 1
        assert np.allclose(sorted(values * norm), want) and len(set(buckets.tolist())) == len(buckets)
    quality._powers.cache_clear()


def test_words_alike_hash_alike():
    from tamarisk.llm.quality import counted

    a, b = counted("The cat sat"), counted("\t The   cat\nsat ")
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])
    assert not np.array_equal(counted("the cat")[0], counted("the dog")[0])


def test_leader_follows_the_formula():
    """Weights after each update against the closed form: the least of all linear terms, past strong terms and the regularisation."""
    from tamarisk.llm.quality import Leader

    rng, leader = np.random.default_rng(1), Leader(alpha=0.7, beta=1.0, l1=0.05, l2=0.2)
    at, seen, w = np.arange(3), [], np.zeros(4)
    for _ in range(30):
        x, y = rng.random(3), int(rng.random() < 0.5)
        full = np.append(x, 1.0)
        p = 1 / (1 + np.exp(-(w @ full)))
        leader.learn(at, x, y)
        seen.append(((p - y) * full, w.copy()))
        g, root = np.array([s[0] for s in seen]), np.sqrt(np.cumsum([s[0] ** 2 for s in seen], 0)) / 0.7
        sigma = np.diff(np.vstack((np.zeros(4), root)), axis=0)
        z = (g - sigma * np.array([s[1] for s in seen])).sum(0)
        l1, l2 = np.array([0.05, 0.05, 0.05, 0]), np.array([0.2, 0.2, 0.2, 0])
        w = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / (1.0 / 0.7 + root[-1] + l2))
        assert np.allclose(leader.weights(np.array([0, 1, 2, (1 << 20)])), w)


def test_quality_on_held_out_rows(spark):
    from tamarisk.llm.queries import op11_quality

    sf = "/root/testdata/sf0.01"
    got = op11_quality(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.99
    assert np.mean([g >= 0.5 for g in good]) > 0.99 and np.mean([b < 0.5 for b in bad]) > 0.8


def test_quality_of_odd_rows(spark, docs, none):
    from tamarisk.llm.quality import counted, keep, scores, train

    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (2, 1, "x"), (5, None, "x"), (None, 1, "x"), (99, 0, "x"), (8, 1, "x")], "doc_id long, quality int, text string")
    got = scores(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1 and not any(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in scores(docs, labels.limit(0)).collect()} == {0.5} and scores(none, labels).count() == 0
    kept = keep(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert len(counted("x" * 600_000)[0]) and len(counted("語" * 600_000)[0])
    assert len(train(docs, labels, sample_rows=1).buckets) >= 0
