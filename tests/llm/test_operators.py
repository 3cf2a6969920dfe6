"""The numbered operators against brute force, round trips and awkward input."""

import gzip
import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import op1_decontaminate as op1
from lodestone.llm import op2_warc as op2
from lodestone.llm import op3_licenses as op3
from lodestone.llm import op4_packing as op4
from lodestone.llm import op5_exact_dedup as op5
from lodestone.llm import op6_minhash as op6
from lodestone.llm import op7_mixing as op7
from lodestone.llm import op8_toxicity as op8
from lodestone.llm import op9_quality as op9
from lodestone.llm import op10_substring as op10
from lodestone.llm import words as W

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
UPPER = {v: chr(k) for k, v in ((k, ord(v)) for k, v in LOWER.items())}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_sha256 string, component_id int, rep int"


def words(text):
    return SPLIT.findall(text or "")


def documents(spark, texts):
    """Rows with every column null now and then, and columns that clash with the operators' own."""
    rows = [(k, t, [None, "en", "de", "fr"][k % 4], [None, "src0", "src0", "src1", "src2"][k % 5], None, "clash", 7, 8) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 160))) for _ in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    out = [None, "", " \t\n", "one", "One two three", "ONE two\tthree", "x" * 70_000, "Straße " * 6000, *base]
    for t in base[:20]:  # exact copies, copies with other spaces, near copies
        w = t.split()
        out += [t, "  ".join(w) + "\n", " ".join(w[: len(w) // 2] + ["changed"] + w[len(w) // 2 + 1 :]), " ".join(w[5:])]
    hot = base[30].split()
    for k in range(60):  # a group of near copies, each other in two words
        w = hot.copy()
        w[k % len(w)], w[(7 * k) % len(w)] = f"n{k}", f"m{k}"
        out.append(" ".join(w))
    for k in range(40):  # a passage that many documents share
        out.append(" ".join(rng.choice(vocab) for _ in range(30)) + " " + passage + " " + " ".join(rng.choice(vocab) for _ in range(30)))
    return out


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# -- words --------------------------------------------------------------------------------------------------


def test_words_are_whole_and_hashed_alike():
    column = pa.array(["ab cd", None, "", "cd", "ab", " ab\x0bcd ", "Ä ä ab"])
    w = W.words_of(column)
    assert np.diff(w.first).tolist() == [2, 0, 0, 1, 1, 2, 3]
    h = w.hashes
    assert h[0] == h[3 + 0] != h[1] or h[1] == h[2]
    assert (h[0], h[1]) == (h[3], h[2]) and (h[4], h[5]) == (h[0], h[1]) and h[6] != h[7]
    assert np.array_equal(W.words_of(column.slice(3)).hashes, h[2:])
    long = pa.array(["w" * (W.SLICE_BYTES + 5) + " tail", "tail"])
    x = W.words_of(long).hashes
    assert len(x) == 3 and x[1] == x[2]


# -- 1 --------------------------------------------------------------------------------------------------------


def items(spark, texts):
    return spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "item_id bigint, text string, doc_id string")


def low(text):
    return words((text or "").translate(LOWER))


def grams_of(w, n):
    n = min(n, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def decontaminated(docs, bench, threshold=op1.THRESHOLD, overlap=op1.OVERLAP, most=op1.PART_WORDS):
    """Every passage against every item by BM25, then both overlaps: doc, item, at, score, overlaps."""
    known = sorted({(i, tuple(low(t))) for i, t in bench if low(t)}, key=repr)
    if not known:
        return []
    df, mean = Counter(x for _, w in known for x in set(w)), sum(len(w) for _, w in known) / len(known)
    parts = []
    for k, (_, w) in enumerate(known):
        n = -(-len(w) // most)
        cuts = [int(len(w) * c / n) for c in range(n + 1)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            tf = Counter(w[x:y])
            impact = {t: math.log(1 + (len(known) - df[t] + 0.5) / (df[t] + 0.5)) * c * (op1.K1 + 1) / (c + op1.K1 * (1 - op1.B + op1.B * (y - x) / mean)) for t, c in tf.items()}
            parts.append((k, {t: v / sum(impact.values()) for t, v in impact.items()}))
    size = max(op1.MIN_PASSAGE, 2 * min(most, max(len(w) for _, w in known)))
    out = []
    for doc, text in docs:
        w, best = low(text), {}
        for at in range(0, max(1, len(w) - size // 2), size // 2) if w else ():
            passage = w[at : at + size]
            inside = set(passage)
            for k, impact in parts:
                score = sum(v for t, v in impact.items() if t in inside)
                if score < threshold - 1e-9:
                    continue
                item = known[k][1]
                more, cut = max(0, len(item) - most), -(-2 * len(item) // 3)
                reach = w[max(0, at - more) : at + len(passage) + more]
                q, a = (len(g & grams_of(reach, min(3, len(x)))) / len(g) if (g := grams_of(x, 3)) else 1.0 for x in (item[:cut], item[cut:]))
                if q >= overlap and a >= overlap and (k not in best or (round(score, 9), round(q + a, 9)) > (round(best[k][1], 9), round(sum(best[k][2:]), 9))):
                    best[k] = (at, score, q, a)
        out += [(doc, known[k][0], v[0], *(round(x, 6) for x in v[1:])) for k, v in best.items()]
    return sorted(out, key=repr)


MATCH = ("doc_id", "item_id", "at", "score", "question_overlap", "answer_overlap")


def found(df):
    return sorted(((*r[:3], *(round(x, 6) for x in r[3:])) for r in df.select(*MATCH).collect()), key=repr)


@pytest.fixture(scope="module")
def leaks():
    """Documents (null ids, repeated rows, nulls, long texts) and items of 1 to 600 words (ties, repeated
    rows, shared and null ids)."""
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    bench = [[f"only{n}-{k}" for k in range(n)] for n in range(1, 10)]
    bench += [text(n) for n in (10, 12, 15, 16, 24, 40, 41, 60, 90, 130, 255, 256, 257, 300, 513, 600)]
    near = bench[15].copy()
    near[3] = "changed"
    listed = [*enumerate(" ".join(b) for b in bench), (3, " ".join(bench[3])), (4, " ".join(bench[14])), (None, " ".join(text(20))), (None, None), (70, ""), (71, " ".join(near)), (72, " ".join(bench[15]).translate(UPPER))]
    docs = [(0, None), (1, ""), (2, " \t"), (3, " ".join(text(300)))]
    for k, b in enumerate(bench):
        around = [text(rng.randint(0, 150)) for _ in range(2)]
        docs += [(10 + k, " ".join([*around[0], *b, *around[1]]).translate(UPPER if k % 2 else {})), (50 + k, " ".join([*around[0], *b[: len(b) // 2]])), (100 + k, " ".join([*b[len(b) // 2 :], *around[1], *b[: len(b) // 2]]))]
        w = b.copy()
        for at in range(0, len(w), 6):
            w[at] = "x"
        docs.append((150 + k, " ".join([*around[1], *w])))
    long = text(30_000)
    long[20_000:20_000] = bench[13]
    docs += [(None, docs[50][1]), (None, docs[50][1]), (5, docs[60][1]), (5, docs[60][1]), (5, docs[70][1]), (6, " ".join(long)), (7, listed[-5][1])]
    return docs, listed


def test_decontamination_equals_brute_force(spark, leaks):
    docs, bench = leaks
    held, items_ = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int"), spark.createDataFrame([(*b, "c") for b in bench], "item_id bigint, text string, doc_id string")
    want = decontaminated(docs, bench)
    got = found(op1.matches(held, items_))
    assert got == want and {n - 1 for n in range(1, 10)} <= {r[1] for r in want if r[1] is not None} and len(want) > 40
    # several indexes, in one pass and in several
    assert found(op1.matches(held, items_, shard_bytes=9000)) == want == found(op1.matches(held, items_, shard_bytes=4000, pass_shards=1))
    for size, at_once in ((op1.SHARD_BYTES, 4), (4000, 1)):
        left = op1.clean_rows(held, items_, shard_bytes=size, pass_shards=at_once)
        clean = [d for d in docs if not decontaminated([d], bench)]
        assert left.columns == held.columns and rows(left, "doc_id", "text") == sorted(clean, key=repr)


@pytest.mark.parametrize("n", range(1, 10))
def test_short_items_are_found(spark, n):
    item = [f"w{k}" for k in range(n)]
    cut = -(-2 * n // 3)
    other = [f"o{k}" for k in range(40)]
    held = [[*other, *item, *other], item, other]
    if cut < n:
        held.append([*other, *item[:cut]])  # a question without its answer is none
    got = rows(op1.matches(documents(spark, [" ".join(t) for t in held]), items(spark, [" ".join(item), "another of the items here"])), "doc_id", "item_id", "question_overlap", "answer_overlap")
    assert got == [(0, 0, 1.0, 1.0), (1, 0, 1.0, 1.0)]


def test_wand_equals_full_scores():
    rng = np.random.default_rng(5)
    lists = [(k, rng.integers(1, 60, rng.integers(6, 30)).astype(np.uint64)) for k in range(70)]
    df = Counter(int(t) for _, h in lists for t in set(h.tolist()))
    index = op1.build_index(lists, df, len(lists), float(np.mean([len(h) for _, h in lists])))
    for _ in range(60):
        terms = np.unique(rng.integers(0, len(index.terms), 25))
        full = Counter()
        for t in terms.tolist():
            for k in range(index.begin[t], index.begin[t + 1]):
                full[int(index.parts[k])] += index.impacts[k]
        want = {k: s for k, s in full.items() if s >= 0.45}
        got = dict(op1.wand(index, terms, 0.45))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        ids = np.concatenate([terms, [-1]])
        kept = op1.candidates(index, ids, np.array([0]), np.array([len(ids)]), 0.45)
        assert [p for p, _ in kept] == [0] if want else len(kept) <= 1


def test_no_items_or_documents(spark, texts):
    docs, bench = documents(spark, texts[8:30]), items(spark, texts[20:50])
    assert op1.matches(empty(spark), bench).count() == op1.matches(docs, items(spark, [])).count() == op1.clean_rows(empty(spark), bench).count() == 0
    assert op1.clean_rows(docs, items(spark, [None, ""])).count() == docs.count()


def test_long_items_are_whole(spark):
    rng = random.Random(2)
    text = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    item, longer, around = text(400), text(900), text(300)
    held = [item[:256], [*around, *item[:256], *around], item, [*around, *item, *around], [*around, *longer, *around], [*longer[:300], *around, *around, *around], [*longer[:560], *longer[620:]]]
    docs = documents(spark, [" ".join(t) for t in held])
    bench = items(spark, [" ".join(t) for t in (item, longer, *(text(30) for _ in range(40)))])
    columns = ("doc_id", "item_id", "question_overlap", "answer_overlap")
    got = rows(op1.matches(docs, bench), *columns)
    # a part of an item, without its answer, is none
    assert [r[:2] for r in got] == [(2, 0), (3, 0), (4, 1), (6, 1)] and {r[2:] for r in got[:3]} == {(1.0, 1.0)}
    for size in (9000, 2000):  # no pair comes twice
        assert rows(op1.matches(docs, bench, shard_bytes=size), *columns, "at") == rows(op1.matches(docs, bench), *columns, "at")


# -- 2 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("file_bytes", "broadcast_rows"), [(op2.FILE_BYTES, 10), (1, 10), (700, 0)])
def test_archives_round_trip(spark, tmp_path, file_bytes, broadcast_rows):
    long = "é" * 60 + "\r\n\r\nWARC/1.1 inside\r\n\r\n"
    pages = [(5, "http://a", long), (3, "http://b", long), (9, None, long), (1, "http://c", "short"), (2, "http://d", "short"), (4, "u", None), (6, "u", ""), (None, "n", "x" * 200), (7, "u", "y" * 300_000), (7, "u", "y" * 300_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, refers_to int")
    op2.write_archives(df, f"file://{tmp_path}/w", file_bytes, broadcast_rows)
    back = op2.resolved_archives(spark, f"file://{tmp_path}/w", payloads=True)
    assert rows(back, "page_id", "url", "html") == sorted([(p, u, h or "") for p, u, h in pages], key=repr)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in back.collect()}
    size = len(long.encode())
    assert got[3] == ("response", None, size) and got[5] == ("revisit", 3, size) and got[9] == ("revisit", 3, size)
    assert got[1] == ("response", None, 5) and got[2] == ("response", None, 5) and got[4] == ("response", None, 0)
    assert all(r.payload_digest == hashlib.sha256(r.html.encode()).hexdigest() for r in back.collect())
    assert op2.round_trip(df.limit(0)).count() == 0
    # each file is gzip members of a record each, bounded by bytes unless one is longer
    for file in (tmp_path / "w").glob("part-*"):
        members = list(op2.unzipped(file.read_bytes()))
        assert gzip.decompress(file.read_bytes()) == b"".join(members) and all(m.startswith(b"WARC/1.1") for m in members)
        assert len(members) == 1 or file.stat().st_size - len(op2.EMPTY_MEMBER) <= file_bytes


def test_equal_payloads_without_ids(spark):
    df = spark.createDataFrame([(None, "a", "x" * 200), (None, "b", "x" * 200), (3, "c", "y" * 200), (None, "d", "y" * 200), (3, "c", "y" * 200)], "page_id bigint, url string, html string")
    got = rows(op2.round_trip(df), "page_id", "url", "record_type", "refers_to")
    assert got == sorted([(None, "a", "response", None), (None, "b", "response", None), (3, "c", "response", None), (3, "c", "response", None), (None, "d", "revisit", 3)], key=repr)


# -- 3 --------------------------------------------------------------------------------------------------------


def licenses(rows_):
    """Every unit of every text against every template."""
    grams = {n: set(op3.template_bigrams(t)) for n, t in op3.TEMPLATES.items()}
    plain = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip().split()
    dice = lambda g, t: 2 * len(g & t) / (len(g) + len(t))
    want = []
    for doc, text in dict.fromkeys(rows_):
        for kind, parts in (("line", re.split(r"\r?\n", text or "")), ("paragraph", re.split(r"\r?\n[ \t]*\r?\n", text or "")), ("whole", [text or ""])):
            for k, part in enumerate(parts):
                g = set(op3.template_bigrams(part))
                best = max(((dice(g, t), [-ord(c) for c in n], n) for n, t in grams.items() if g), default=(0, "", ""))
                if best[0] >= op3.THRESHOLD:
                    want.append((doc, kind, k, best[2], round(best[0], 9)))
        w, top = plain(text), []
        for n, t in grams.items():
            size, windows = len(plain(op3.TEMPLATES[n])), []
            for at in range(len(w) - 1):
                if f"{w[at]} {w[at + 1]}" in t:
                    part = w[at : at + size]
                    g = {f"{x} {y}" for x, y in zip(part, part[1:], strict=False)}
                    windows.append((-dice(g, t), at, -len(g & t)))
            if windows and -min(windows)[0] >= op3.THRESHOLD:
                d, at, common = min(windows)
                top.append((common, d, n, at, at + size))
        want += [(doc, "passage", p[3], p[2], round(-p[1], 9)) for p in top if not any(q[:3] < p[:3] and q[3] < p[4] and p[3] < q[4] for q in top)]
    return sorted(want, key=repr)


def test_licenses_as_brute_force(spark, texts):
    mit, T = op3.TEMPLATES["MIT"], op3.TEMPLATES  # noqa: N806
    prose = " ".join(w for t in texts[8:14] for w in words(t))
    laid_out = {
        "Apache-2.0 header": T["Apache-2.0 header"].replace(" You may obtain", "\n\n You may obtain").replace("LICENSE-2.0. Unless", "LICENSE-2.0\n\nUnless"),
        "GPL header": T["GPL header"].replace(" This program is distributed", "\n\n This program is distributed"),
        "BSD-2-Clause": T["BSD-2-Clause"].replace(" 1. Redis", "\n\n1. Redis").replace(" 2. Redis", "\n\n2. Redis"),
        "MIT": mit.replace(", ", ",\n * "),
    }
    notes = [T["MIT notice"], "some words\nLicensed under the Apache License, version 1.1\nmore", "intro\n\n" + mit.replace(", ", ",\n") + "\n\nend", mit.lower(), "Released under no license at all", "x\n" + T["GPL-2.0 notice"]]
    notes += [f"{prose} {x}\n\n{prose}" for x in laid_out.values()]
    notes += [f"We know it is. {x} And so on." for x in T.values()]
    notes += [f"As said: Released under\nthe MIT License. {prose}", f"{prose} {mit} {prose} {T['ISC']} {mit}"]
    listed = [*enumerate([*notes, *texts[:20]]), (None, T["MIT"]), (None, T["BSD notice"]), (None, T["BSD notice"]), (5, T["MPL-2.0"]), (5, T["Unlicense"]), (5, T["Unlicense"]), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in listed], "doc_id bigint, text string, unit int, license int")
    got = sorted(((*r[:4], round(r.dice, 9)) for r in op3.scan(docs).select("doc_id", "kind", "unit", "license", "dice").collect()), key=repr)
    want = licenses(listed)
    assert got == want
    # a notice laid out in paragraphs of a longer text is found
    assert {(6 + k, n) for k, n in enumerate(laid_out)} <= {(r[0], r[3]) for r in want if r[1] == "passage"}
    assert {None, 5} <= {r[0] for r in want} and len({r[3] for r in want if r[0] == 5}) == 3
    assert op3.scan(empty(spark)).count() == 0


# -- 4 --------------------------------------------------------------------------------------------------------


def test_packing_is_lossless_and_best_fit(spark, texts):
    docs = documents(spark, texts)
    packed = op4.pack(docs, row_tokens=128, group_tokens=3000)
    out = packed.collect()
    assert all(r.cu_seqlens[-1] == r.n_tokens <= 128 and len(r.token_ids) == 256 and r.position_resets == r.cu_seqlens[:-1] for r in out)
    assert len({r.pack_id for r in out}) == len(out)
    back = {r.doc_id: r.text for r in op4.unpack(packed, row_tokens=128).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert op4.pack(empty(spark)).count() == 0
    odd = [(None, "one two"), (None, None), (3, "a b c"), (3, "a b c"), (3, "word " * 90_000)]
    df = spark.createDataFrame([(*r, 1) for r in odd], "doc_id bigint, text string, piece int")
    assert rows(op4.unpack(op4.pack(df)), "doc_id", "text") == sorted([(k, t or "") for k, t in odd], key=repr)


def test_rows_are_full(spark):
    """All rows but the last of a group hold no room for the shortest piece of another."""
    rng = random.Random(4)
    docs = documents(spark, [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(3, 300))) for _ in range(400)]).coalesce(1)
    out = op4.pack(docs, row_tokens=256).collect()
    assert sum(r.n_tokens for r in out) > 0.97 * 256 * len(out)


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.randint(1, 40)
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 60))]
        rooms, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fit = [r for r in rooms if r >= lengths[i]]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - lengths[i])
            else:
                rooms.append(size - lengths[i])
            want.append(i)
        got = op4.best_fit_decreasing(np.array(lengths, int), size)
        assert sorted(i for r in got for i in r) == sorted(want)
        assert sorted(size - sum(lengths[i] for i in r) for r in got) == sorted(rooms)


# -- 5 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("bits", "ids"), [(64, 10**6), (6, 10**6), (64, 0)])
def test_exact_dedup(spark, texts, monkeypatch, bits, ids):
    """With hashes of six bits nearly all chunks collide and are told apart by themselves. Also without
    any broadcast."""
    monkeypatch.setattr(op5, "BROADCAST_IDS", ids)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op5.deduplicate(documents(spark, texts), bits, 16, 64).collect()}
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(k)
    want = {}
    for t, ids in groups.items():
        keep = min(ids, key=lambda k: (-len(texts[k] or ""), k))
        want |= {k: (keep, len(ids), k == keep, hashlib.sha256(t.encode()).hexdigest()) for k in ids}
    assert got == want


def test_exact_dedup_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (2, "ab"), (2, "ab"), (1, "a  b"), (1, "a b"), (1, "a  b")], "doc_id bigint, text string")
    assert rows(op5.deduplicate(df), "doc_id", "keep_id", "group_size", "kept") == sorted([(None, 1, 6, False), (2, 1, 6, False), (2, 1, 6, False), (1, 1, 6, True), (1, 1, 6, False), (1, 1, 6, True)], key=repr)
    lone = spark.createDataFrame([(None, "a"), (None, None), (4, ""), (5, "b" * 300_000), (6, "b" * 299_999)], "doc_id bigint, text string")
    assert rows(op5.deduplicate(lone), "doc_id", "keep_id", "kept") == sorted([(None, None, True), (None, 4, False), (4, 4, True), (5, 5, True), (6, 6, True)], key=repr)
    assert op5.deduplicate(empty(spark)).count() == 0


# -- 6 --------------------------------------------------------------------------------------------------------


def near(texts, size=5, percent=75):
    sets = []
    for t in texts:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return [(k, len(s), find(k), find(k) == k) for k, s in enumerate(sets)]


@pytest.mark.parametrize("pair_rows", [1000, 7])
def test_near_duplicates(spark, texts, monkeypatch, pair_rows):
    """Also with hot documents dealt into many groups."""
    monkeypatch.setattr(op6, "PAIR_ROWS", pair_rows)
    got = rows(op6.near_duplicates(documents(spark, texts)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(near(texts), key=repr)


def test_pairs_of_mixed_buckets_lose_none(spark):
    """Copies at many distances from one text: links near the bound, in many components."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for k in range(120):
        w = base.copy()
        for n in range(k % 9):
            w[rng.randrange(90)] = f"v{k % 13}-{n}"
        texts.append(" ".join(w))
    got = rows(op6.near_duplicates(documents(spark, texts)), "doc_id", "n_shingles", "component_id", "kept")
    want = near(texts)
    assert got == sorted(want, key=repr) and len({r[2] for r in want}) > 1
    members = spark.createDataFrame([(k, k) for k in range(120)], "rep bigint, component bigint")
    pairs = {tuple(sorted(r)) for r in op6.pairs_apart(members, documents(spark, texts)).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(86)} for t in texts]
    links = {(a, b) for a in range(120) for b in range(a + 1, 120) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert links <= pairs


def test_holders_of_a_shingle_meet_by_size_in_parts(spark, monkeypatch):
    """Prefixes of one text, of many sizes, so that a shingle has holders in several classes and parts."""
    monkeypatch.setattr(op6, "HOLDERS", 7)
    texts = [" ".join(f"w{k}" for k in range(n)) for n in range(5, 125)]
    members = spark.createDataFrame([(k, k) for k in range(120)], "rep bigint, component bigint")
    found = [tuple(sorted(r)) for r in op6.pairs_apart(members, documents(spark, texts)).collect()]
    links = {(a, b) for a in range(120) for b in range(a + 1, 120) if 100 * (a + 1) >= 75 * (b + 1)}
    assert links <= set(found) and len(found) == len(set(found))


def test_bitmaps_bound_differences():
    rng = np.random.default_rng(4)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        a, b = W.mix(a), W.mix(b)
        assert op6.least_difference(op6.parity_bitmap(np.sort(a)).tobytes(), op6.parity_bitmap(np.sort(b)).tobytes()) <= len(np.setxor1d(a, b))


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (0, "A B c d e f"), (7, None)], "doc_id bigint, text string")
    assert rows(op6.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == sorted([(None, 2, None, True), (1, 2, 0, False), (1, 2, 0, False), (0, 2, 0, True), (7, 0, 7, True)], key=repr)
    assert op6.near_duplicates(empty(spark)).count() == 0
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (103, 101)], "a bigint, b bigint")
    assert {r.component for r in op6.components(links).collect()} == {0, 100}


# -- 7 --------------------------------------------------------------------------------------------------------


def test_water_filling(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 1000), ("web", "de", "c", 10), ("books", "en", "d", 5000), ("books", "en", "e", 0)]
    got = {r.source: (r.quota, r.epochs, r.rest) for r in op7.quotas(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint"), 50, 1).collect()}
    # 3055 tokens, web 5 : books 3; web can give 1110, so books take 1945; de gives its 10, then a its 100
    assert got == {"a": (100, 1, 0), "b": (1000, 1, 0), "c": (10, 1, 0), "d": (1945, 0, 1945), "e": (0, 0, 0)}


def test_mix(spark, texts):
    docs = documents(spark, texts)
    got = op7.mix(docs, budget_percent=60, max_epochs=2).collect()
    total = sum(len(words(t)) for t in texts)
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.doc_id)] == [len(words(t)) for t in texts]
    assert 0 < sum(r.n_tokens * r.copies for r in got) <= total * 60 // 100
    leaves = {}
    for r in got:
        leaves.setdefault((r.domain, r.lang, r.source), []).append(r)
    sums = [(d, la, s, sum(r.n_tokens for r in x)) for (d, la, s), x in leaves.items()]
    plan = {(r.domain, r.lang, r.source): r for r in op7.quotas(spark.createDataFrame(sums, "domain string, lang string, source string, tokens bigint"), 60, 2).collect()}
    for leaf, x in leaves.items():
        p, used = plan[leaf], 0
        order = lambda r: int(hashlib.md5(f"{op7.SEED}:{p.epochs}:{r.doc_id}".encode()).hexdigest()[:15], 16)  # noqa: E731, B023
        for r in sorted(x, key=order):
            used += r.n_tokens
            assert r.copies == p.epochs + (used <= p.rest < p.tokens)
    again = op7.mixed_rows(docs, budget_percent=60, max_epochs=2)
    assert again.columns == docs.columns and Counter(r.doc_id for r in again.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert op7.mix(empty(spark)).count() == op7.mixed_rows(empty(spark)).count() == 0
    odd = [(None, "a b c"), (None, "d e"), (7, "f g h i"), (7, "f g h i"), (8, None), (9, "x " * 50_000)]
    both = spark.createDataFrame([(*r, "en", None) for r in odd], "doc_id bigint, text string, lang string, source string")
    taken = Counter({(r.doc_id, r.n_tokens): r.copies for r in op7.mix(both, budget_percent=60).collect()})
    assert len(op7.mix(both).collect()) == 6 and taken == Counter({(r.doc_id, len(words(r.text))): 1 for r in op7.mixed_rows(both, budget_percent=60).distinct().collect()})


# -- 8 --------------------------------------------------------------------------------------------------------


def test_segments_are_maximal():
    rng = random.Random(6)
    for _ in range(200):
        s = [rng.choice([-3, -2, -1, 1, 2, 4]) for _ in range(rng.randint(0, 25))]
        want = []

        def find(lo, hi):  # the definition: the best segment, then what is left and right of it
            best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] > 0:
                find(lo, best[3])
                want.append((best[3], best[4], best[0]))
                find(best[4], hi)

        find(0, len(s))
        got = sorted(op8.segments(np.array(s, float)))
        assert got == sorted(want)


@pytest.mark.parametrize("scores", [[1, -3], [3, -1], [1, -3, 2, -1]])
def test_segments_take_linear_time(scores):
    hits, steps = 1000, Counter()

    def trace(frame, event, _):
        steps[frame.f_code.co_name] += event == "line"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        op8.segments(np.tile(np.array(scores, float), hits))
    finally:
        sys.settrace(before)
    assert steps["segments"] < 20 * len(scores) * hits


def toxic(spark, n=900):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 200))]
        bad = k % 6 == 0
        if bad:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(["vilest", "rotten", "zz" + rng.choice("abc") + "x", "Zzqq" + rng.choice(vocab)]) for _ in range(rng.randint(1, 4))]
        docs.append((k, " ".join(w), 0))
        labels.append((k, int(bad), 1))
    return spark.createDataFrame(docs, "doc_id bigint, text string, toxic int"), spark.createDataFrame(labels, "doc_id bigint, toxic int, text int")


def test_toxicity_on_held_out(spark):
    docs, labels = toxic(spark)
    got = {r.doc_id: r for r in op8.scores(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for k, r in got.items())
    held = [(r.predicted, int(k % 6 == 0)) for k, r in got.items() if r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in op8.scores(docs, flipped).collect()} == {k: r.score for k, r in got.items()}
    assert op8.clean_rows(docs, labels).count() == sum(1 - r.predicted for r in got.values())


def segments_by_definition(s):
    """The best segment, then what is left and right of it."""
    out, todo = [], [(0, len(s))]
    while todo:
        lo, hi = todo.pop()
        best, least, start, upto = (0.0, 0, 0), 0.0, lo, 0.0
        for i in range(lo, hi):
            upto += s[i]
            if upto - least > best[0]:
                best = (upto - least, start, i + 1)
            if upto <= least:
                least, start = upto, i + 1
        if best[0] > 0:
            out.append(best)
            todo += [(lo, best[1]), (best[2], hi)]
    return out


def test_toxicity_equals_brute_force(spark):
    docs, labels = toxic(spark, 700)
    got = {r.doc_id: r for r in op8.scores(docs, labels).collect()}
    texts_ = {r.doc_id: words(r.text.translate(LOWER)) for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    fold = {k: zlib.crc32(str(k).encode()) % 4 for k in texts_}
    vocab = sorted({w for t in texts_.values() for w in t})
    at = np.stack(list(op8.levels(W.words_of(pa.array(vocab), lower=True, gaps=W.PUNCTUATION))), 1)
    buckets = {w: at[i].tolist() for i, w in enumerate(vocab)}
    corpus, bad, clean = Counter(), Counter(), Counter()
    for k, t in texts_.items():
        held = {b for w in t for b in buckets[w]}
        corpus.update(held)
        if fold[k] not in (op8.HELD_OUT, op8.CALIBRATION):
            (bad if known[k] else clean).update(held)
    level = lambda b: b >> op8.BITS
    total = lambda c: Counter({n: sum(v for b, v in c.items() if level(b) == n) for n in range(4)})
    all_, all_bad, all_clean, odds = total(corpus), total(bad), total(clean), {}
    for b, n in corpus.items():
        prior = op8.PRIOR * n / all_[level(b)]
        x, y = bad[b] + prior, clean[b] + prior
        o = math.log(x / (all_bad[level(b)] + op8.PRIOR - x)) - math.log(y / (all_clean[level(b)] + op8.PRIOR - y))
        z = o / math.sqrt(1 / x + 1 / y)
        if abs(z) >= op8.Z_LEAST and (z < 0 or bad[b] >= op8.LEAST_TOXIC):
            odds[b] = o
    hist = Counter()
    for b, o in odds.items():
        if level(b) == 0:
            hist[math.floor(abs(o) * 10 + 0.5) / 10 * (1 if o > 0 else -1) - op8.DRIFT] += corpus[b] / all_[0]
    hist[-op8.DRIFT] += 1 - sum(hist.values())
    low, high = 0.0, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(p * math.exp(mid * x) for x, p in hist.items()) < 1 else (low, mid)
    stats = {}
    for k, t in texts_.items():
        seen, scored = Counter(), []
        for w in t:
            x = next((odds[b] for b in buckets[w] if b in odds), 0.0)
            seen[w] += x > 0
            scored.append((x / seen[w] if x > 0 else x) - op8.DRIFT)
        worth = [low * v - math.log(len(t)) for v, _, _ in segments_by_definition(scored)]
        stats[k] = (sum(v for v in worth if v > 0) or max(worth)) if worth else None
    bin_of = lambda v: 0 if v is None else max(1, min(op8.BINS, 1 + math.floor((v - op8.LOWEST) / op8.BIN)))
    assert sum(stats[k] is None or abs(stats[k] - got[k].statistic) < 1e-3 for k in stats) == len(stats) and all((stats[k] is None) == (got[k].statistic is None) for k in stats)
    tell = [(bin_of(stats[k]), known[k]) for k in stats if fold[k] == op8.CALIBRATION]
    # a rising rate: for each bin the greatest over lower starts of the least mean up to a higher end
    mean = lambda a, b: (sum(y for x, y in tell if a <= x <= b), sum(1 for x, _ in tell if a <= x <= b))
    used = sorted({x for x, _ in tell})
    rate = {x: max(min(mean(a, b)[0] / mean(a, b)[1] for b in used if b >= x) for a in used if a <= x) for x in used}
    same = [abs(got[k].score - rate[bin_of(stats[k])]) < 1e-9 for k in stats if bin_of(stats[k]) in rate]
    assert len(same) > 0.9 * len(stats) and sum(same) >= 0.99 * len(same)


def test_toxicity_edges(spark, texts):
    docs, labels = toxic(spark, 60)
    none = labels.limit(0)
    assert {r.score for r in op8.scores(documents(spark, texts), none).collect()} == {0.0}
    assert op8.scores(empty(spark), labels).count() == 0
    odd = spark.createDataFrame([(None, None), (None, "vilest rotten"), (1, "")], "doc_id bigint, text string")
    bad = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (6, 1, 0)], "doc_id bigint, toxic int, text int"))
    assert op8.scores(docs.drop("toxic").unionByName(odd), bad).count() == 63
    docs, labels = toxic(spark)
    vile = docs.where("doc_id = 0").first().text + " vilest rotten vilest zzax rotten"
    more = spark.createDataFrame([(None, vile, 1), (1, vile, 1), (1, vile, 1), (2, "plain", 1), (2, "plain", 1), (3, "w " * 60_000 + "vilest rotten zzbx", 1)], "doc_id bigint, text string, toxic int")
    kept = {(r.doc_id, r.text) for r in op8.clean_rows(docs.where("doc_id > 3").unionByName(more), labels).collect() if r.doc_id is None or r.doc_id < 4}
    assert (None, vile) not in kept and (1, vile) not in kept and (2, "plain") in kept
    again = [r.score for r in op8.scores(more.unionByName(docs.where("doc_id > 3")), labels).where("doc_id = 1").collect()]
    assert len(again) == 2 and len(set(again)) == 1


# -- 9 --------------------------------------------------------------------------------------------------------


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.8
    votes = np.zeros((len(y), len(op9.LABELLERS)), np.int8)
    for j, accuracy in enumerate(np.linspace(0.65, 0.95, len(op9.LABELLERS))):
        right, says = rng.random(len(y)) < accuracy, rng.random(len(y)) < 0.7
        votes[:, j] = np.where(says, np.where(y == right, op9.GOOD, op9.JUNK), op9.ABSTAIN)
    patterns, at, count = np.unique(op9.code(votes), return_inverse=True, return_counts=True)
    post, shares = op9.expectation_maximisation(patterns, count.astype(float))
    told = shares[:, 0, op9.GOOD] / (shares[:, 0, op9.GOOD] + shares[:, 0, op9.JUNK])
    assert np.abs(told - np.linspace(0.65, 0.95, len(op9.LABELLERS))).max() < 0.03
    assert ((post[at] > 0.5) == y).mean() > 0.95


def test_quality(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in (rng.choice(vocab) for _ in range(n)))

    good = [prose(rng.randint(60, 200)) for _ in range(300)]
    junk = [" ".join(w + "###" for w in prose(80).split()) for _ in range(20)] + [prose(80).upper() + "!!" for _ in range(20)] + [" | ".join(prose(80).split()) for _ in range(20)] + [" ".join([rng.choice(vocab)] * 120) for _ in range(20)]
    got = {r.doc_id: r.kept for r in op9.classify(documents(spark, [*good, *junk, None, ""])).collect()}
    assert sum(got[k] for k in range(300)) >= 294 and sum(got[k] for k in range(300, 380)) <= 8 and len(got) == 382
    assert op9.classify(empty(spark)).count() == 0
    odd = [(None, good[0], 1), (None, good[0], 1), (5, junk[0], 1), (5, good[1], 1), (6, f"{good[2]} " * 400, 1), (7, None, 1)]
    both = documents(spark, [*good, *junk]).select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string, posterior int").drop("posterior"))
    found = Counter((r.doc_id, r.kept) for r in op9.classify(both.withColumns({"score": F.lit("x"), "kept": F.lit(0)})).collect())
    assert found[None, True] == 2 and sum(found.values()) == 386 and found[5, True] == 2 and found[5, False] == 1


def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = op9.classify(docs).join(labels.where("quality is not null"), "doc_id").select("kept", "quality").collect()
    assert len(found) > 300 and sum(r.kept == (r.quality == 1) for r in found) >= 0.97 * len(found)


# -- 10 -------------------------------------------------------------------------------------------------------


def without_repeats(texts, n=13):
    first, out = {}, []
    for k, t in enumerate(texts):
        w = words(t)
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), k)
    for k, t in enumerate(texts):
        w, gone = words(t), set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < k:
                gone.update(range(i, i + n))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("group_rows", "filter_bits", "nodes"), [((1000, 2000), 29, 10**6), ((5, 5), 29, 10**6), ((1000, 2000), 16, 10**6), ((1, 3), 16, 10**6), ((3, 3), 16, 10)])
def test_repeats(spark, texts, monkeypatch, group_rows, filter_bits, nodes):
    """Also with lengthened prefixes, with full filters, and with nodes joined."""
    monkeypatch.setattr(op10, "NODES", nodes)
    got = rows(op10.remove_repeats(documents(spark, texts), group_rows, filter_bits), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == sorted(without_repeats(texts), key=repr)


def test_repeats_edges(spark):
    same = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(None, same), (4, same), (4, same), (9, same), (2, None)], "doc_id bigint, text string")
    assert rows(op10.remove_repeats(df), "doc_id", "n_words", "n_removed") == sorted([(None, 20, 0), (4, 20, 0), (4, 20, 0), (9, 20, 20), (2, 0, 0)], key=repr)
    # rows that share a doc_id and differ in their texts
    two = spark.createDataFrame([(1, same), (4, f"a b c {same}"), (4, f"{same} d e"), (4, "x " * 30), (3, "x " * 30)], "doc_id bigint, text string")
    assert rows(op10.remove_repeats(two), "doc_id", "kept_text") == sorted([(1, same), (4, "a b c"), (4, "d e"), (4, ""), (3, " ".join(["x"] * 30))], key=repr)
    assert op10.remove_repeats(empty(spark)).count() == 0


def test_deep_nodes():
    """Nodes are the groups of suffixes that share a window, each with its longest common prefixes."""
    rng = random.Random(3)
    n = op10.CODE
    said = [[rng.randrange(1, 4) for _ in range(rng.randint(13, 21))] for _ in range(60)]
    said += [x[:17] + [9] for x in said[:20] if len(x) > 17]
    column = pa.array([b"".join(w.to_bytes(n, "big") for w in x) for x in said], pa.binary())
    run, place, node, shared = op10.deep_nodes(column)
    suffixes = [tuple(said[r][p:]) for r, p in zip(run, place, strict=True)]
    assert sorted((r, p) for r, p in zip(run.tolist(), place.tolist(), strict=True)) == [(r, p) for r, x in enumerate(said) for p in range(len(x) - 12)]
    for k in range(1, len(suffixes)):
        common = next((i for i, (a, b) in enumerate(zip(suffixes[k - 1], suffixes[k], strict=False)) if a != b), min(len(suffixes[k - 1]), len(suffixes[k])))
        assert shared[k] == common and (node[k] == node[k - 1]) == (common >= 13)
    assert len(set(node.tolist())) == len({x[:13] for x in suffixes})
