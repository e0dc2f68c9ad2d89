"""Every operator on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

tok = pytest.importorskip("public_tokenizers")

LONG = "lorem ipsum dolor sit amet " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, removed string, key string, part int"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, "x", "k", 3),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, "x", "k", 3),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, "x", "k", 3),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, None, None, None),
    (None, "a text without an id and some more words here", "en", "b", 0, None, None, None),
    (5, LONG, "en", "b", 0, None, None, None),
    (7, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich\nthe quick brown fox jumps over the lazy dog again and again", "de", "c", 0, None, None, None),
    (8, "𝒳 ünïcödé\n\n  spaces\t日本語 x̣́", "fr", "c", 0, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def path(name):
    return str(tok.path(name))


# 1
@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_lines_and_paragraphs(docs, none, unit):
    from tamarisk.llm.substring_dedup import dedup, dedup_documents

    got = {(r.doc_id, r.text) for r in dedup(docs, unit, 5).select("row.doc_id", "kept.text").collect()}
    line = ROWS[0][1]
    assert (1, line) in got and (2, "") in got and (3, "") in got and (4, "") in got and (5, LONG) in got
    assert (7, ROWS[7][1].split("\n")[0] if unit == "line" else ROWS[7][1]) in got
    spans = {r.doc_id: r.removed_spans for r in dedup(docs, unit, 5).select("row.doc_id", "kept.removed_spans").collect()}
    if unit == "line":
        a, b = map(int, spans[7].split("-"))
        assert ROWS[7][1][a:b] == line
    kept = dedup_documents(docs, unit, 5)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert {r.n_chars for r in kept.collect() if r.doc_id == 2} == {0}
    assert dedup_documents(none, unit).count() == 0


def test_lines_against_brute_force(spark):
    from tamarisk.llm.substring_dedup import dedup

    rng = random.Random(3)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    seen, want = set(), {}
    for i, t in rows:
        kept = []
        for u in t.split("\n"):
            if len(u.split()) < 5 or u not in seen:
                kept.append(u)
                seen.add(u)
        want[i] = "\n".join(kept)
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string"), "line", 5).select("row.doc_id", "kept.text").collect()
    assert {r.doc_id: r.text for r in got} == want


def test_runs_of_odd_rows(docs, none):
    from tamarisk.llm.substring_dedup import dedup, dedup_documents

    got = {r.doc_id: r for r in dedup(docs).select("row.doc_id", "kept.*").collect()}
    assert (got[3].text, got[3].n_units, got[3].n_removed, got[3].removed_spans) == ("", 0, 0, "")
    # the long text is one sentence of five words again and again: what its own first run doesn't overlap goes
    assert got[5].text == " ".join(LONG.split()[:50]) + " " and got[5].n_units == 100_000 and got[5].n_removed == 99_950
    assert all(got[i].n_removed == 0 and got[i].text == next(r[1] for r in ROWS if r[0] == i) for i in (1, 2, 7, 8))
    kept = dedup_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) and dedup_documents(none).count() == 0
    assert [r.text for r in kept.collect() if r.doc_id == 3] == [None]


def test_runs_against_brute_force(spark):
    from corpus_pipeline import repeated_lines
    from tamarisk.llm.substring_dedup import RUN, dedup

    rng = random.Random(4)
    some = lambda n: [f"W{rng.randrange(10**6)}" for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 70, 210)]
    chinese, thai = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(60)), "วันนี้อากาศดีมากเราไปเดินเล่นที่สวนสาธารณะ" * 2
    rows = [(i, " ".join(sum((some(rng.randint(1, 40)) + rng.choice(passages) for _ in range(3)), []) + some(5))) for i in range(40)]
    rows += [(40, " ".join(["a", "b", "c"] * 60)), (41, f"前{chinese}後\n{thai}"), (42, f"x{chinese}y\n{thai}\nz"), (43, ""), (44, None), (None, rows[0][1]), (0, rows[0][1])]
    seen, want = {}, {}
    for i, t in sorted(((i, t or "") for i, t in set(rows)), key=lambda r: (r[0] is not None, r[0] or 0)):
        w, gone = list(t.replace("\n", "")) if i in (41, 42) else t.split(), set()
        for k in range(len(w) - RUN + 1):
            run = tuple(x.lower() for x in w[k : k + RUN])
            j, at = seen.setdefault(run, (i, k))
            gone |= set(range(k, k + RUN)) if j != i or at + RUN <= k else set()
        want[i] = ("".join if i in (41, 42) else " ".join)(x for k, x in enumerate(w) if k not in gone), len(gone)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup(docs).select("row.doc_id", "row.text", F.col("kept.text").alias("left"), "kept.n_removed", "kept.removed_spans").collect()
    assert len(got) == len(rows) and {r.doc_id: (r.left.replace("\n", ""), r.n_removed) for r in got} == want
    assert want[42] == ("xyz", 60 + len(thai)) and len(want[40][0].split()) == 51
    for r in got:
        spans = [tuple(map(int, x.split("-"))) for x in r.removed_spans.split(",") if x]
        words = sum(len(list(r.text[a:b].replace("\n", "")) if r.doc_id in (41, 42) else r.text[a:b].split()) for a, b in spans)
        assert words == r.n_removed and all(x == x.strip() for x in (r.text[a:b] for a, b in spans))
    p = " ".join(passages[4])
    lined = [(1, f"one {p} two"), (2, f"three {p.replace(' ', chr(10), 1)} four\nfive"), (3, f"{p}\nsix"), (4, f"seven\n{p}\neight "), (5, f"nine\n{p} ten")]
    got = repeated_lines(spark, spark.createDataFrame(lined, "doc_id long, text string"), "").collect()
    assert {r.doc_id: r.text for r in got} == {1: lined[0][1], 2: "three\nfour\nfive", 3: "six", 4: "seven\neight ", 5: "nine\nten"}


# 2
def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids, label = sorted(sets), {i: i for i in sets}
    for x in ids:
        for y in ids:
            if x < y and (sets[x] or sets[y]) and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = label[x], label[y]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return {(i, len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join_against_brute_force(spark, n, percent):
    from tamarisk.llm.jaccard_join import near_duplicates

    rng, rows = random.Random(5), []
    for base in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([2, 5, 9, 20, 60, 200, 700]))]
        for _ in range(8):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            rows.append((len(rows), " ".join(w) if base else ""))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert {tuple(r) for r in got} == brute_components(rows, n, percent)


def test_jaccard_join_odd_rows(docs, none):
    from tamarisk.llm.jaccard_join import near_duplicates

    got = [tuple(r) for r in near_duplicates(docs).collect()]
    assert len(got) == len(ROWS) and near_duplicates(none).count() == 0
    assert {g[2] for g in got if g[0] in (1, 2)} == {1} and (3, 0, 3) in got and (4, 0, 4) in got
    assert [g for g in got if g[0] is None][0][2] is None


def test_segments_never_miss_a_link():
    from tamarisk.llm.jaccard_join import differ, signatures, sketch

    rng = np.random.default_rng(1)
    for size in (3, 7, 12, 40, 150, 900):
        for _ in range(40):
            s = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            drop = rng.integers(0, differ(len(s), len(s), 85) + 1)
            extra = rng.integers(0, 1 << 63, rng.integers(0, drop + 1)).astype(np.uint64)
            t = np.unique(np.concatenate((rng.permutation(s)[drop - len(extra) :], extra)))
            i = len(np.intersect1d(s, t))
            if 100 * i >= 85 * (len(s) + len(t) - i):
                (ks, ps), (kt, pt) = signatures(s, 85), signatures(t, 85)
                assert set(ks[ps].tolist()) & set(kt.tolist()) or set(kt[pt].tolist()) & set(ks.tolist())
                a, b = sketch(s), sketch(t)
                while len(a) != len(b):
                    a, b = (a, b) if len(a) > len(b) else (b, a)
                    a = a[: len(a) // 2] ^ a[len(a) // 2 :]
                assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= len(s) + len(t) - 2 * i


def test_components_of_a_long_chain(spark):
    from tamarisk.llm.components import components

    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(900, 901), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(200)} | {900: 900, 901: 900}


# 3
def test_sentencepiece_against_a_library(docs):
    from tokenizers import Tokenizer, models

    from tamarisk.llm.sentencepiece_codec import PieceCodec

    rng = random.Random(2)
    pieces = [("<unk>", 0.0), *[(c, -3.0 - rng.random()) for c in "▁abcde"]]
    pieces += [("".join(rng.choice("▁abcde") if k == 0 else rng.choice("abcde") for k in range(rng.randint(2, 4))), -1.0 - 4 * rng.random()) for _ in range(60)]
    pieces = list(dict(pieces).items())
    mine, theirs = PieceCodec(pieces, {}, 0), Tokenizer(models.Unigram(pieces, 0, False))
    assert mine.by_word
    for _ in range(300):
        t = "▁" + "".join(rng.choice("aabbcde▁x") for _ in range(rng.randint(1, 30)))
        ids, score = mine.viterbi(t)
        want = theirs.encode(t, add_special_tokens=False).ids
        value = lambda x: sum(pieces[i][1] if i else mine.gap for i in x)
        if 0 not in want:
            assert abs(value(want) - score) < 1e-6 and "".join(pieces[i][0] for i in ids) == t
        assert abs(mine.encode(t[1:].replace("▁", " "))[1] - mine.viterbi(mine.normalised(t[1:].replace("▁", " ")))[1]) < 1e-9


def test_sentencepiece_round_trip(docs, none):
    from tamarisk.llm.sentencepiece_codec import decode_documents, encode_documents

    m = path("piece_bpe_32k.model")
    got = sorted((r.doc_id or 0, r.text) for r in decode_documents(encode_documents(docs, m), m).collect())
    assert got == sorted((r[0] or 0, r[1] or "") for r in ROWS)
    assert encode_documents(none, m).count() == 0


# 4
def test_media_round_trip(docs, none):
    import hashlib

    from tamarisk.llm.media import padded, text_media

    got = {(r.name, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in text_media(docs).collect()}
    want = set()
    for r in ROWS:
        raw = (r[1] or "").encode()
        p = padded(raw)
        want.add((r[0], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == want and text_media(none).count() == 0
    same = text_media(docs.where("doc_id in (3, 4)")).drop("name").distinct()
    assert same.count() == 1


def test_media_filters_ranges_and_retries(tmp_path, monkeypatch):
    import struct

    from tamarisk.llm import media

    rng = np.random.default_rng(4)
    img = rng.integers(0, 256, (6, 64)).astype(np.uint8)
    raw = bytearray()
    for y in range(6):
        kind, row = y % 5, img[y].astype(int)
        up = img[y - 1].astype(int) if y else np.zeros(64, int)
        left, corner = np.concatenate(([0], row[:-1])), np.concatenate(([0], up[:-1]))
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [np.zeros(64, int), left, up, (left + up) // 2, near][kind]
        raw += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
    png = media.PNG + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 6, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(bytes(raw))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png)[0] == img).all()
    p = str(tmp_path / "a.arc")
    with media.writer(p) as out:
        w = media.ArchiveWriter(out)
        for i in range(50):
            w.add(i if i else None, media.encode_png(media.padded(bytes([i]) * i * 40), i * 40))
        w.close()
    source = media.ArchiveReader({"path": str(tmp_path), "rangeBytes": "700"})
    assert len(source.partitions()) > 3
    rows = [r for part in source.partitions() for b in source.read(part) for r in b.to_pylist()]
    assert sorted(r["name"] or 0 for r in rows) == list(range(50))
    calls, real = [], media.reader

    class Flaky:
        def __init__(self, f):
            self.f = f

        def seek(self, *a):
            return self.f.seek(*a)

        def close(self):
            self.f.close()

        def read(self, n):
            calls.append(n)
            if len(calls) == 4:
                raise OSError("lost")
            return self.f.read(n)

    monkeypatch.setattr(media, "reader", lambda x: Flaky(real(x)))
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    assert sum(b.num_rows for b in source.read(media.Range(p, 0, 1 << 40))) == 50


# 5
def test_token_store(spark, docs, none):
    from tokenizers import Tokenizer

    from tamarisk.llm.common import new_folder
    from tamarisk.llm.token_store import lookup, read_shards, write_shards

    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    manifest = write_shards(docs, new_folder(spark, "t"), path("word_bpe_49k.json"), 1, shard_bytes=1000)
    got = read_shards(spark, manifest).collect()
    want, start = [], 0
    for i, text in sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    shards = sorted((bytes(r.min_key), r.path, bytes(r.max_key)) for r in manifest.collect())
    listed = [(p, a, b) for a, p, b in shards]
    assert lookup(listed, 7).tolist() == [*t.encode(ROWS[7][1], add_special_tokens=False).ids, 1]
    assert lookup(listed, 6) is None and lookup(listed, 99) is None and lookup(listed, None) is not None
    assert read_shards(spark, write_shards(none, new_folder(spark, "t"), path("word_bpe_49k.json"), 1)).count() == 0


def test_shard_lookup_in_many_blocks(tmp_path):
    from tamarisk.llm.token_store import Shard, ShardWriter, key_of

    ids = sorted(random.Random(1).sample(range(-(1 << 40), 1 << 40), 4000))
    with open(tmp_path / "s", "wb") as f:
        w = ShardWriter(f)
        for i in ids:
            w.add(key_of(i), np.full(i % 90, i % 60_000, "<u2").tobytes())
        w.close()
    with open(tmp_path / "s", "rb") as f:
        s = Shard(f)
        assert len(s.index) > 4 and s.n_docs == 4000
        for i in ids[::37]:
            assert s.get(key_of(i)).tolist() == [i % 60_000] * (i % 90)
        assert all(s.get(key_of(i + 1)) is None for i in ids[::37] if i + 1 not in ids)
        assert sum(s.may_have(key_of(i)) for i in range(5000)) < 200 and all(s.may_have(key_of(i)) for i in ids[::11])


@pytest.mark.parametrize(("kind", "file"), [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_encoders_equal_the_library(spark, small, kind, file):
    from tokenizers import Tokenizer

    from tamarisk.llm.tokens import encoder

    t = Tokenizer.from_file(path(file))
    t.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += [r[1] or "" for r in ROWS] + [" ", "a  b", "x \n", "\x1c\x1da", "it's I'LL", "ΣΑΣ", "<|endoftext|>", "a b", "🎉🎉 x", "﻿x", "é ́a"]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder(kind, path(file)).encode(text), "<u2").tolist() == want.ids


# 6
def test_winnowing_guarantee_and_brute_force():
    from tamarisk.llm import fingerprints as fp

    rng = random.Random(8)
    for n in (0, 1, 5, 23, 24, 30, 151, 152, 700):
        t = "".join(rng.choice("abc ") for _ in range(n))
        h, p = fp.winnow(t)
        points = np.frombuffer(t.encode("utf-32-le"), "<u4")
        grams = fp.gram_hashes(points) >> np.uint64(32)
        want = {}
        w = min(fp.WINDOW, len(grams))
        for i in range(len(grams) - w + 1 if len(grams) else 0):
            best = min(range(i, i + w), key=lambda j: (int(grams[j]), -j))
            want[best] = int(grams[best])
        assert dict(zip(p.tolist(), h.tolist())) == want
    shared = "".join(rng.choice("abcdefgh") for _ in range(fp.K + fp.WINDOW - 1))
    a, b = (fp.winnow("".join(rng.choice("xyz") for _ in range(300)) + shared + "".join(rng.choice("uvw") for _ in range(200)))[0] for _ in range(2))
    assert set(a.tolist()) & set(b.tolist())


def test_half_edits_of_short_texts_show():
    from tamarisk.llm import fingerprints as fp

    rng = random.Random(6)
    for n in range(78, 303):
        a, b = ("".join(rng.choice("abcdefghij ") for _ in range(n)) for _ in range(2))
        assert 0 < fp.likeness(fp.winnow(a)[0], fp.winnow(fp.edited(a, b))[0]) < 1


def test_winnow_in_blocks(monkeypatch):
    from tamarisk.llm import fingerprints as fp

    t = "".join(random.Random(9).choice("ab") for _ in range(3000))
    whole = fp.winnow(t)
    monkeypatch.setattr(fp, "BLOCK", 500)
    parts = fp.winnow(t)
    assert whole[1].tolist() == parts[1].tolist() and whole[0].tolist() == parts[0].tolist()


def test_edited_pairs(docs, none):
    import hashlib

    from tamarisk.llm.fingerprints import edited, edited_pairs

    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = []
    for r, s in zip(order, [*order[1:], order[0]]):
        t = r[1] or ""
        want.append((r[0] or 0, len(t), hashlib.sha256(edited(t, s[1] or "").encode()).hexdigest()))
    got = [(r.doc_id or 0, r.n_chars, r.edited_sha256) for r in edited_pairs(docs).collect()]
    assert sorted(got) == sorted(want) and edited_pairs(none).count() == 0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in edited_pairs(docs).collect())


# 7
def test_packing(spark, docs, none):
    from tamarisk.llm.packing import digests, packed_documents, pieces, sequences

    out = packed_documents(docs, path("byte_bpe_50k.json"), 0, 64)
    rows = digests(out).collect()
    total = {}
    for r in rows:
        assert 0 < r.length <= 64
        total.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in total.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64
    made = {(r.doc_id, r.piece, r.start, r.length) for r in pieces(docs, path("byte_bpe_50k.json"), 0, 64).collect()}
    assert made == {(r.doc_id, r.piece, r.start, r.length) for r in rows}
    assert len(total) <= -(-sum(n for s in total.values() for _, n in s) // 64) + 3
    assert all(len(r.ids) // 2 == sum(m.length for m in r.members) for r in sequences(out).collect())
    assert digests(packed_documents(none, path("byte_bpe_50k.json"), 0)).count() == 0


def test_best_fit_rules():
    from tamarisk.llm.packing import BestFit, cut

    f = BestFit(10, 2)
    assert f.place(6) == (0, 0) and f.place(5) == (1, 0)
    assert f.place(4) == (0, 6)  # the tightest fit
    assert f.place(9) == (2, 0) and f.place(7) == (3, 0)  # the fullest (nine) closed
    assert f.place(1)[0] == 3
    assert cut(10, 10) == [(0, 10)] and cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and cut(20, 10) == [(0, 10), (10, 10)]


# 8
def test_language(spark, small, docs, none):
    from tamarisk.llm.langid import fit, identify_pages, known_language, sampled, visible

    d = spark.read.parquet(f"{small}/documents.parquet")
    m = fit(sampled(d))
    pages = spark.read.parquet(f"{small}/pages.parquet").withColumnRenamed("page_id", "page_id")
    got = identify_pages(pages, m).collect()
    assert len(got) == pages.count() and sum(r.lang == r.declared for r in got) >= 0.9 * len(got)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "", "", "y"), (None, "http://h.example.com/a", '<html lang="de"><p>и да не е</p>', "z")], "page_id long, url string, html string, host string")
    assert [r.lang for r in identify_pages(odd, m).orderBy("page_id").collect()] == ["und"] * 3
    german = next(r.text for r in d.where("lang = 'de' and n_chars > 1500").orderBy("doc_id").collect())
    junk = spark.createDataFrame([(900, "%%% ### 123 456", "en", "s", 1), (901, None, None, None, 0), (902, "щдфжгк ывапр олдж йцукен " * 9, "en", "s", 1), (903, german, "fr", "s", 1)], d.schema)
    kept = known_language(d.unionByName(junk), m)
    left = {r.doc_id for r in kept.collect()}
    assert kept.columns == d.columns and not left & {900, 901, 902, 903} and len(left) >= 0.98 * d.count()
    assert known_language(none, m).count() == 0 and visible("<a href='x'>b</a><script>c</script><!-- d -->e").split() == ["b", "e"]


# 9
def test_preferences(spark):
    from tamarisk.llm.chat_format import paired, placed, preference_rows, reply_swapped

    sides = [(1, s, t, r, x) for s, last in (("chosen", "yes"), ("rejected", "no")) for t, r, x in ((0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "q"), (3, "assistant", last))]
    sides += [(2, "chosen", None, None, None), (2, "rejected", None, None, None), (3, "chosen", 0, "user", "only"), (3, "chosen", 0, "user", "only")]
    sides += [(4, s, 7, r, x) for s in ("chosen", "rejected") for r, x in (("user", "b"), ("user", "a"), ("assistant", s), ("assistant", "x" * 5000))]
    sides += [(None, "chosen", t, "assistant", f"long {t} " * 20) for t in range(3000)]
    spark_rows = spark.createDataFrame([(*s, "odd") for s in sides], "pair_id long, side string, turn long, role string, text string, part string")
    rows = preference_rows(spark_rows)
    got = {r.pair_id: r for r in paired(rows).collect()}
    assert len(got) == 5 and {r.segment for r in got.values()} == {0}
    assert got[1].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nq<|end|>\n"
    assert got[1].chosen == "<|assistant|>\nyes<|end|>\n" and got[1].rejected == "<|assistant|>\nno<|end|>\n"
    assert got[1].chosen_mask == f"0-{len(got[1].chosen)}" and got[1].rejected_mask == f"0-{len(got[1].rejected)}"
    assert got[2].prompt == "<|user|>\n<|end|>\n" and got[2].chosen == "" and got[3].chosen == "<|user|>\nonly<|end|>\n" and got[3].rejected == "" and got[3].chosen_mask == ""
    assert got[4].prompt == "" and got[4].chosen.index("chosen") < got[4].chosen.index("xxxx") < got[4].chosen.index("|>\na") < got[4].chosen.index("|>\nb")
    whole = "".join(f"<|assistant|>\n{x}<|end|>\n" for _, _, _, _, x in sides[-3000:])
    assert got[None].chosen == whole and placed(rows).count() == rows.count()
    parts = sorted((r.segment, r.chosen, r.chosen_mask) for r in paired(rows, 10_000).where("pair_id is null").collect())
    assert len(parts) > 30 and "".join(p[1] for p in parts) == whole and max(len(p[1]) for p in parts) < 11_000
    assert all(b.split(",")[-1].split("-")[1] == str(len(a)) for _, a, b in parts)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, part string")
    assert paired(preference_rows(reply_swapped(empty))).count() == 0


# 10
def test_toxicity_learns_and_ignores_groups(spark):
    from tamarisk.llm.toxicity import Model, clean, fit, scores, told, words_of

    rng = random.Random(6)
    filler = [f"w{chr(97 + i)}x" for i in range(26)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(filler) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words += ["scumlord", rng.choice(["nasty", "vileness"])]
        if (bad and rng.random() < 0.9) or rng.random() < 0.05:
            words.append("muslim")  # a biased sample
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    sample = [(y, words_of(t), told(t)) for (_, t), (_, y) in zip(rows, labels)]
    vocabulary = ["muslim", "scumlord", "nasty", "vileness", *filler]
    gap = lambda m: abs(m.logit({"muslim"}) - m.logit({"christian"}))
    fair, plain = fit(sample, vocabulary, counterfactual=20.0), fit(sample, vocabulary, counterfactual=0.0)
    assert gap(fair) < 0.3 * gap(plain) and fair.logit({"scumlord", "nasty"}) > 0
    docs = spark.createDataFrame([*rows, (None, None), (1000, None), (1001, ""), (0, rows[0][1])], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5000, 1), (None, 1), (3, None)], "doc_id long, toxic long")
    got = scores(docs, marks).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.predicted for r in got if r.doc_id in (1000, 1001)} == {0}
    assert clean(docs, marks).columns == docs.columns
    assert scores(docs, marks.limit(0)).where("score > 0.001").count() == 0
    assert Model({}, 0.0).score("") == 0.5


# pipeline
def test_pipeline(spark, small):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{small}/documents.parquet")
    docs = d
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == d.columns, name
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before
        if name == "near_copies":
            want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert after == {i for i, _, c in want if i == c}
        if name == "repeated_lines":
            runs: dict = {}
            for r in out.orderBy("doc_id").collect():
                words = r.text.lower().split()
                for k in range(len(words) - 49):
                    assert runs.setdefault(tuple(words[k : k + 50]), r.doc_id) == r.doc_id
            same = {r.doc_id: r.text for r in docs.collect()}
            assert after == before and sum(same[r.doc_id] != r.text for r in out.collect()) < 0.3 * len(before)
        docs = out
        if name == "toxicity":
            marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
            # a few dozen labels tell half of the toxic texts; what larger samples do is held in tests of the operator
            assert 2 * len(after & {i for i, y in marks.items() if y}) <= sum(marks.values()) + 1 and {i for i, y in marks.items() if not y} <= after
    packed = p.run(spark, small)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_near_copies_by_text_and_odd_rows(spark, docs, none):
    from corpus_pipeline import near_copies

    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, text, "a"), (5, text, "b"), (5, other, "c"), (None, text, "d"), (7, text, "e"), (7, text, "e"), (8, None, "f"), (9, "", "g"), (None, None, "h")]
    got = near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, gone string"), "")
    assert {r.gone for r in got.collect()} == {"a", "c", "f", "g", "h"} and got.columns == ["doc_id", "text", "gone"]
    assert near_copies(spark, none, "").count() == 0 and near_copies(spark, docs, "").count() == len(ROWS) - 2


def test_pipeline_on_odd_and_empty_tables(spark, docs, none, tmp_path):
    import corpus_pipeline as p

    labels = spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int")
    for name, rows in (("odd", docs), ("none", none)):
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = p.run(spark, f"{tmp_path}/{name}")
        assert {r.doc_id for r in got.collect()} <= {r[0] for r in ROWS}
        assert (got.count() > 0) == (name == "odd")


# the queries that have no SQL, against plain versions
def test_media_query_against_a_plain_version(spark, docs):
    import hashlib

    from tamarisk.llm import media

    got = {r.name or 0: r for r in media.text_media(docs.dropDuplicates(["doc_id"])).collect()}
    for i, text in {(r[0] or 0, r[1] or "") for r in ROWS}:
        raw = text.encode()
        png = media.encode_png(media.padded(raw), len(raw))
        samples = np.frombuffer(media.padded(raw), np.uint8).reshape(-1, 64)
        means = []
        for k in range(8):
            rows = np.array_split(samples, 8)[k] if len(samples) >= 8 else samples[k * len(samples) // 8 : k * len(samples) // 8 + 1]
            means += [rows[:, 8 * c : 8 * c + 8].mean() for c in range(8)]
        bits = "".join(str(int(m > sum(means) / 64)) for m in means)
        want = (len(png), hashlib.sha256(png).hexdigest(), f"{samples.mean():.3f}:{samples.std():.3f}:{int(bits, 2):016x}")
        assert (got[i].media_bytes, got[i].media_sha256, got[i].feature) == want


def test_fingerprint_likeness_against_a_plain_version(spark, small):
    from tamarisk.llm import fingerprints as fp
    from tamarisk.llm.queries import op6_fingerprints

    def plain(t):
        points = np.frombuffer(t.encode("utf-32-le"), "<u4")
        h = [int(x) >> 32 for x in fp.gram_hashes(points).tolist()]
        w = min(fp.WINDOW, len(h))
        return {min(h[i : i + w]) for i in range(len(h) - w + 1)} if h else set()

    rows = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 4000").orderBy(F.desc("doc_id")).limit(40).collect()
    got = {r.doc_id: r for r in fp.edited_pairs(spark.createDataFrame(rows)).collect()}
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for a, b in zip(rows, [*rows[1:], rows[0]]):
        x, y = a.text or "", b.text or ""
        other = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        assert abs(got[a.doc_id].near_edited - like(plain(x), plain(other))) < 1e-12
        assert abs(got[a.doc_id].near_next - like(plain(x), plain(y))) < 1e-12
    assert op6_fingerprints(spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_packing_at_its_real_size(spark, small, monkeypatch):
    import zlib as z

    from tamarisk.llm import packing
    from tamarisk.llm.queries import op7_best_fit_packing
    from tamarisk.llm.tokens import encoder

    rows = op7_best_fit_packing(spark, small).collect()
    total = sum(r.length for r in rows)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 2048 and sorted(s)[0][0] == 0 for s in sequences.values()) and len(sequences) <= -(-total // 2048) * 1.05 + 1
    enc = encoder("byte", path("byte_bpe_50k.json"))
    for d in spark.read.parquet(f"{small}/documents.parquet").limit(30).collect():
        ids = np.concatenate((np.frombuffer(enc.encode(d.text or ""), "<u2"), [0])).astype("<u4")
        for r in sorted((r for r in rows if r.doc_id == d.doc_id), key=lambda r: r.piece):
            assert z.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    monkeypatch.setattr(packing, "GROUP_DOCS", 40)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    many = packing.digests(packing.packed_documents(docs, path("byte_bpe_50k.json"), 0)).collect()
    assert len({r.sequence_id >> 40 for r in many}) > 2 and sorted((r.doc_id, r.piece, r.ids_crc32) for r in many) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


def test_rows_that_differ_in_text_only(spark):
    from tamarisk.llm.packing import digests, packed_documents
    from tamarisk.llm.token_store import store

    d = spark.createDataFrame([(1, "one text", "x"), (1, "another text", "y"), (1, "one text", "x")], "doc_id long, text string, ids string")
    got = store(d, path("word_bpe_49k.json"), 1).collect()
    assert len(got) == 3 and sorted(r.start for r in got) == [0, got[0].n_tokens, got[0].n_tokens + sorted(got, key=lambda r: r.start)[1].n_tokens]
    assert len(digests(packed_documents(d, path("byte_bpe_50k.json"), 0)).collect()) == 3


def test_language_fusion_against_a_plain_version(spark, small):
    import math
    from urllib.parse import urlparse

    from tamarisk.llm import langid as L

    m = L.fit(L.sampled(spark.read.parquet(f"{small}/documents.parquet")))
    pages = spark.read.parquet(f"{small}/pages.parquet")
    odd = [(9001, "http://a.example.net/x", '<html lang="de">' + "the and of " * 20_000), (9002, None, None), (9002, None, None), (9003, "nonsense", "<p>\u0449\u0434\u0444</p>")]
    rows = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("host", F.lit("clash")).withColumn("lang", F.lit("zz"))
    k, own, meta = len(m.languages) + 1, [], []
    for r in rows.collect():
        words = re.findall(r"[^\W\d_]+", L.visible(r.html or "").lower())
        ll, n = [0.0] * k, 0
        for w in words:
            for g in L.grams(w):
                for i, x in enumerate(m.unseen):
                    ll[i] += x + dict(m.table.get(g, ())).get(i, 0.0)
                ll[-1] += L.BACKGROUND
                n += 1
        x = np.array(ll) / 3
        p = np.exp(x - x.max())
        host = (urlparse(r.url).hostname or "") if r.url and "://" in r.url else ""
        tag = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z][\w-]*)", r.html or "")
        said = re.match(r"[A-Za-z]{2,3}(?=[-_]|$)", tag[1]) if tag else None
        parts = host.split(".")
        meta.append((r.page_id, host, ".".join(parts[-3:]) if len(parts) > 2 else host, parts[-1] if len(parts) > 1 else "", said[0].lower() if said else "", x, n))
        own.append(p / p.sum())
    own = np.array(own)
    of = lambda j, v: own[[i for i, y in enumerate(meta) if y[j] == v]].sum(0)
    named = own[[i for i, y in enumerate(meta) if y[4]]].sum(0)
    want = []
    for mine, (page, host, domain, suffix, said, x, n) in zip(own, meta):
        share = own.sum(0) - mine
        share = (share + 1) / (share.sum() + k)
        for j, v in ((3, suffix), (2, domain), (1, host)):
            level = np.maximum(of(j, v) - mine, 0)
            share = (level + L.PSEUDO * share) / (level.sum() + L.PSEUDO)
        z = x + np.log(share) + (np.log((np.maximum(of(4, said) - mine, 0) + 0.5) / (np.maximum(named - mine, 0) + 10)) if said else 0)
        p = np.exp(z - z.max())
        p /= p.sum()
        want.append((page, [*m.languages, "und"][int(p.argmax())] if n else "und", round(float(p.max()), 4)))
    got = [(r.page_id, r.lang, round(r.confidence, 4)) for r in L.identify_pages(rows, m).collect()]
    assert len(got) == len(want) and all(a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=2e-4) for a, b in zip(sorted(got), sorted(want)))
    assert L.identify_pages(rows.limit(0), m).count() == 0


def test_many_declared_languages_and_very_long_words(spark, monkeypatch):
    from tamarisk.llm import langid as L

    rng = random.Random(11)
    # each language writes with six letters of its own
    letters = [[chr(0x4E00 + 6 * i + k) for k in range(6)] for i in range(120)]
    text = lambda i, n: " ".join("".join(rng.choice(letters[i]) for _ in range(rng.randint(2, 6))) for _ in range(n))
    code = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(120)]
    rows = [(10 * i + k, text(i, 30), code[i], "s") for i in range(120) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = L.fit(L.sampled(docs))
    assert len(m.languages) == 120
    best = lambda t: m.languages[int(np.argmax(m.log_likelihoods(t)[0][:-1]))]
    assert all(best(text(i, 20)) == code[i] for i in range(0, 120, 7))
    assert L.known_language(docs, m).count() == len(rows)
    long = "".join(rng.choice(letters[5]) for _ in range(300_000))
    before = len(m._at)
    assert best(long) == code[5] and m.log_likelihoods(long)[1] == 300_000 and len(m._at) == before
    monkeypatch.setattr(L, "LANGUAGES", 100)
    with pytest.raises(ValueError, match="languages"):
        L.sampled(docs)


def test_a_range_reads_its_own_entries(tmp_path, monkeypatch):
    from tamarisk.llm import media

    monkeypatch.setattr(media, "ENTRY_BLOCK", 8)
    p = str(tmp_path / "a.arc")
    with media.writer(p) as out:
        w = media.ArchiveWriter(out)
        for i in range(3000):
            w.add(i, bytes([i % 251]) * (i % 7 + 1))
        w.close()
    f = media.reader(p)
    at, n = media.tail(f)
    every = media.entries(f, at, n, 0, 1 << 40)
    assert [e[0] for e in every] == list(range(3000))
    read, real = [], f

    class Counting:
        def seek(self, x):
            real.seek(x)

        def read(self, size):
            read.append(size)
            return real.read(size)

    for first, end in ((0, 1), (500, 560), (5000, 5001), (11_000, 1 << 40), (1 << 40, 1 << 41), (0, 0)):
        read.clear()
        got = media.entries(Counting(), at, n, first, end)
        assert got == [e for e in every if first <= e[1] < end]
        assert sum(read) <= (len(got) + 8 + 8 + 13) * media.ENTRY.size


def test_toxicity_scores_against_a_plain_version(spark):
    import math

    from tamarisk.llm import toxicity as X

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = X.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in X.scores(docs, labels).collect()}
    for i, t in texts.items():
        words = set(re.findall(r"[^\W\d_]+", t.lower()))
        features = words | {w[:k] + "*" for k in (4, 5, 6) for w in words if len(w) > k}
        z = m.bias + sum(m.weights.get(f, 0.0) for f in features)
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-max(-30, min(30, z)))), abs_tol=1e-9)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.5)
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    fitted = [i for i in truth if not got[i].held_out]
    assert not any(got[i].predicted for i in fitted if not truth[i]) and sum(got[i].predicted for i in fitted if truth[i]) >= 0.75 * sum(truth[i] for i in fitted)


def test_toxicity_of_odd_rows(docs, none):
    from tamarisk.llm.toxicity import clean, scores

    marks = docs.sparkSession.createDataFrame([(1, 0, "x"), (7, 1, "y")], "doc_id long, toxic int, text string")
    got = scores(docs, marks).collect()
    assert len(got) == len(ROWS) and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1 and scores(none, marks).count() == 0 and clean(none, marks).columns == none.columns
    assert clean(docs, marks.limit(0)).count() == len(ROWS)


def test_the_penalty_has_pairs_and_makes_groups_alike(spark):
    from tamarisk.llm import toxicity as X

    neutral = [(0, X.words_of(t), X.told(t)) for t in ("A quiet day. The women sang.", *["nothing to see here at all"] * 16)]
    pairs = X.pairs_of(neutral)
    assert ({"the", "women", "sang"}, {"the", "men", "sang"}) in pairs and any("see" in a and a != b for a, b in pairs)
    rng = random.Random(3)
    rows = []
    for i in range(300):
        y = int(i % 5 == 0)
        words = {f"w{rng.randrange(40)}" for _ in range(12)} | ({"scum"} if y else set()) | ({"muslim"} if (y and rng.random() < 0.8) or rng.random() < 0.03 else set())
        rows.append((y, words, [words]))
    fair, plain = (X.fit(rows, ["scum", "muslim", *[f"w{i}" for i in range(40)]], counterfactual=c) for c in (20.0, 0.0))
    mention = {"w1", "w2", "muslim"}
    assert plain.logit(mention) - plain.logit({"w1", "w2", "hindu"}) > 1 > 0.3 > fair.logit(mention) - fair.logit({"w1", "w2", "hindu"})
    assert fair.logit({"scum", "w3"}) > 0


def test_the_penalty_acts_where_no_text_names_a_group(spark):
    from tamarisk.llm import toxicity as X

    rng = random.Random(5)
    # "christ*" and "musl*" begin ordinary words of one class, so terms share features with weighted words
    rows = []
    for i in range(600):
        y = int(i % 4 == 0)
        words = {f"w{rng.randrange(40)}" for _ in range(10)} | ({"scum", "muslxyz"} if y else {"christmas"} if i % 3 == 0 else set())
        rows.append((y, words, [words]))
    vocabulary = ["scum", "musl*", "christ*", *[f"w{i}" for i in range(40)]]
    on, off = (X.fit(rows, vocabulary, counterfactual=c) for c in (1.0, 0.0))
    widest = lambda m: max(b - a for a, b in m.spreads())
    assert widest(off) > 0.5 and widest(on) < 0.5 * widest(off)
    frame = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "s double")
    gaps = lambda m: [r.g for r in frame.select(X.group_gap(m, F.col("s")).alias("g")).collect()]
    assert all(0 < a < b for a, b in zip(gaps(on), gaps(off)))
    s = 0.5
    z = np.log(s / (1 - s))
    want = max(1 / (1 + np.exp(-(z + b))) - 1 / (1 + np.exp(-(z + a))) for a, b in off.spreads())
    assert abs(gaps(off)[1] - want) < 1e-12
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    models = [X.train(docs, labels, counterfactual=c) for c in (1.0, 0.0)]
    assert 0 < widest(models[0]) < widest(models[1])
    assert len(X.named([(1, {"a"}, [{"a"}])] * 40 + [(0, {"men"}, [{"men"}])])) == 3


def test_fit_against_plain_gradients():
    """The fitted loss is that of many plain steps down the same slope."""
    from tamarisk.llm import toxicity as X

    rng, vocabulary = random.Random(9), ["aa", "bb", "cc", "men"]
    rows = [(int(rng.random() < 0.5), w, [w]) for w in ({v for v in vocabulary if rng.random() < 0.5} for _ in range(60))]
    all_rows, pairs, features = [*rows, *X.named(rows)], X.pairs_of([*rows, *X.named(rows)]), list(dict.fromkeys([*vocabulary, *X._OTHERS]))
    matrix = lambda sets: np.array([[float(f in X.features_of(s)) for f in features] for s in sets])
    x, y, d = matrix([r[1] for r in all_rows]), np.array([r[0] for r in all_rows]), matrix([a for a, _ in pairs]) - matrix([b for _, b in pairs])
    l2 = 1e-3 / len(features)

    def loss(w, b):
        z = x @ w + b
        return float(np.mean(np.log1p(np.exp(z)) - y * z) + l2 / 2 * w @ w + np.mean((d @ w) ** 2))

    w, b = np.zeros(len(features)), 0.0
    for _ in range(4000):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        w, b = w - 0.5 * (x.T @ e + l2 * w + 2 * d.T @ (d @ w) / len(d)), b - 0.5 * e.sum()
    m = X.fit(rows, vocabulary)
    assert loss(np.array([m.weights.get(f, 0.0) for f in features]), m.bias) < loss(w, b) + 2e-3


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op3_sentencepiece", "op4_media_columns", "op5_token_store", "op6_fingerprints", "op10_toxicity"])
def test_queries_return_a_row_a_document(spark, small, name):
    from tamarisk.llm.queries import queries

    got = queries()[name](spark, small)
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == ids


def test_passages_inside_lines_are_caught_and_short_lines_stay(spark, small):
    from tamarisk.llm.queries import op1_substring_dedup

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    first, wanted = {}, set()
    for i in sorted(texts):
        words = texts[i].lower().split()
        for k in range(len(words) - 49):
            j, at = first.setdefault(tuple(words[k : k + 50]), (i, k))
            if j != i or at + 50 <= k:
                wanted.add(i)
    assert {r.doc_id for r in op1_substring_dedup(spark, small).where("n_removed > 0").collect()} == wanted
