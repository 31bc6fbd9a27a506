"""Phrases, fingerprints and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import fingerprints, phrases, variants
from ledgerloom.llm.wavelet import WaveletMatrix
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(25)] + ["New", "YORK", "x×y"]
    long_words = ["Abcdefgh", "abcdefgi", "abcdefghi", "abcdegh", "aabcdefgh", "éàabcdefg", "zzzzzzzz", "zzzzzzz"]

    def text(n):
        return "".join(rng.choice([*words, *long_words, "new york city", "the end"]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", ",", "\x0b"]) for _ in range(n))

    out = [(k, text(rng.randint(0, 150)), rng.choice(["en", "en", "de", None]), "s", 1) for k in range(40)]
    out += [(40 + k, out[3][1], "en", "s", 1) for k in range(30)]
    out += [(80, None, "en", None, 1), (81, "", None, None, None), (82, " \t\n", "en", None, 1), (83, "one", "fr", None, 1), (84, "z" * 50_000 + " " + "new york " * 9000, "en", None, 1)]
    return out + [(85, "z" * 50_000 + " " + "z" * 49_999, "en", None, 1), (86, ("z" * 50_000 + " ") * 30, "en", None, 1), (5, out[5][1], "en", "s", 1), (None, out[6][1], None, None, None), (None, None, None, None, None), (2**62, "the end", "en", None, 1), (-5, "new york", "en", None, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def clashing(docs):
    names = ("id", "chunk", "word", "n", "key", "bucket", "digest", "phrase", "rank", "fingerprint", "edited", "to", "at", "base", "a", "z", "extra", "following", "size")
    return docs.selectExpr("*", *(f"'x' AS {c}" for c in names))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def mined(rows, least, top, share):
    counts, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            counts.update((lang or "und", tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    known = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in known.items():
        if len(p) == 2 and any(100 * b >= share * a for (other, q), b in known.items() if other == lang and len(q) == 3 and p in (q[:2], q[1:])):
            continue
        score, k = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], n[lang], score))
    found = []
    for lang in {x[0] for x in out}:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        found += [(lang, k + 1, *x[1:]) for k, x in enumerate(best)]
    return sorted(found)


@pytest.mark.parametrize(("least", "top", "share"), [(10, 2000, 50), (2, 15, 80), (1, 400, 100)])
def test_phrases_equal_plain_counting(docs, rows, least, top, share):
    assert sorted(tuple(r) for r in phrases.mine(docs, least, top, share).collect()) == mined(rows, least, top, share)


def test_phrases_of_clashing_columns_and_of_nothing(docs, clashing, nothing):
    assert sorted(phrases.mine(clashing, 3).collect()) == sorted(phrases.mine(docs, 3).collect())
    empty = phrases.mine(nothing)
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and empty.count() == 0


def test_bitmaps_cross_blocks_and_not_pieces():
    slots = np.array([0, 15, 16, 31, 32, 40])
    words = phrases.Bitmaps.of(np.array([0, 0, 1, 0, 1, 0]), slots)
    found = phrases.ByBlock(words, 3).extended(words, 2)
    items, counts = phrases._summed(found)
    assert dict(zip(items.tolist(), counts.tolist(), strict=True)) == {1: 2}


def test_a_shard_extends_pairs_once_a_round_and_triples_once(docs, rows, monkeypatch):
    """The rounds in one process: a list of chunks in place of rows of chunks, of their answers in place of rows of blobs."""
    calls = Counter()

    def counted(cls, name, n):
        made = getattr(cls, name)

        def run(self, *args):
            out = made(self, *args)
            calls[name] += n(self)
            return out

        monkeypatch.setattr(cls, name, run)

    def packed(df):
        chunks = {}
        for r in df.collect():
            chunks.setdefault(r.chunk, []).append((r.id, bytes(r.text)))
        return [tuple(map(list, zip(*sorted(x), strict=True))) for _, x in sorted(chunks.items())]

    def ask(chunks, make, answer, places, before=()):
        sent, out = [make(*c, [b[i] for b in before]) for i, c in enumerate(chunks)], [{} for _ in chunks]
        for k in range(places):
            own = [i for i, blobs in enumerate(sent) if k in blobs]
            for i, blob in zip(own, answer([sent[i][k] for i in own], k) if own else [], strict=True):
                out[i][k] = blob
        return out

    def finish(chunks, make, schema, answers):
        return [r for i, c in enumerate(chunks) for r in make(*c, [b[i] for b in answers]).to_pylist()]

    for name, f in (("packed", packed), ("ask", ask), ("finish", finish)):
        monkeypatch.setattr(phrases._exchange, name, f)
    counted(phrases.Shard, "read", lambda s: len(s.numbers) > 0)
    counted(phrases.ByBlock, "extended", lambda _: 1)
    found = phrases.candidates(docs, 2)
    # Three rounds read numbers of words. Each extends words once; one of them extends pairs.
    assert calls["read"] > 0 and 3 * calls["extended"] == 4 * calls["read"]
    counts = Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            counts.update((lang or "und", " ".join(words[i : i + k])) for k in (2, 3) for i in range(len(words) - k + 1))
    assert sorted((r["lang"], r["phrase"], r["a"]) for r in found) == sorted((*x, a) for x, a in counts.items() if a >= 2)


@pytest.mark.parametrize("top", [3, 2**20, 2**40])
def test_phrase_owners_sum_exactly_whatever_the_numbers(top):
    rng = np.random.default_rng(5)
    near = np.unique(rng.integers(0, 4, (60, 3)), axis=0)
    shards = [np.unique(np.where(x < 2, x, top - x), axis=0) for x in (near[:30], near[10:], near)]
    sent = [phrases._phrases_sent(list(x.T), np.arange(len(x)) + 1, 1)[0] for x in shards]
    total = Counter()
    for x in shards:
        total.update({tuple(t): k + 1 for k, t in enumerate(x.tolist())})
    seen, read = set(), [phrases._triples_read({0: a}) for a in phrases._triple_owner(20)(sent, 0)]
    for x, got in zip(shards, read, strict=True):
        own = {tuple(t) for t in x.tolist()} - seen
        seen |= own
        assert dict(zip(zip(*(c.tolist() for c in got[:3]), strict=True), got[3].tolist(), strict=True)) == {t: total[t] for t in own if total[t] >= 20}


def test_order_is_stable_also_for_large_numbers():
    x = np.random.default_rng(6).integers(0, 9, 500)
    for shift in (0, 40, 59):
        assert (phrases._order(x << shift) == np.argsort(x, kind="stable")).all()
    assert len(phrases._order(x[:0])) == 0


def shingled(text, n=5):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {hashlib.md5(" ".join(words[i : i + n]).encode()).hexdigest() for i in range(max(1, len(words) - n + 1))} if words else set()


def printed(text):
    bins = {}
    for h in sorted(shingled(text), reverse=True):
        bins[int(h[:2], 16)] = h[-1]
    if not bins:
        return ""

    def probe(j):
        for t in range(fingerprints.PROBES):
            d = hashlib.md5(str(t).encode()).hexdigest()
            if (s := (j * (int(d[:2], 16) | 1) + int(d[2:4], 16)) % 256) in bins:
                return bins[s]
        return bins[min(bins, key=lambda s: hashlib.md5(f"{j}~{s}".encode()).hexdigest())]

    return "".join(bins[j] if j in bins else probe(j) for j in range(256))


def test_fingerprints_equal_plain_ones(docs, rows):
    found = fingerprints.edited(docs).select("*", fingerprints.printed(F.col("fingerprint")).alias("f"), fingerprints.printed(F.col("next_fingerprint")).alias("g")).collect()
    ids = [r.doc_id for r in found]
    assert sorted(ids, key=repr) == sorted((r[0] for r in rows), key=repr)
    assert all(r.f == printed(r.text) and r.n_chars == len(r.text) for r in found)
    # In ascending order; the two rows without an id and those of the same id in any order of their own.
    order = sorted({r[0] for r in rows if r[0] is not None}) + [None]
    texts = {i: {r[1] or "" for r in rows if r[0] == i} for i in order}
    for r in found:
        follow = order[(order.index(r.doc_id) + 1) % len(order)]
        half = len(r.text) // 2
        edits = {r.text[: len(r.text) - half] + t[:half] for t in texts[follow] | (texts[r.doc_id] if r.doc_id in (5, None) else set())}
        assert r.edited in edits and r.g in {printed(t) for t in texts[follow] | texts[r.doc_id]}


def test_likeness_estimates_the_shared_part(spark):
    rng = random.Random(2)
    words = [str(rng.random()) for _ in range(3000)]
    pairs = [(k, " ".join(words[:1500]), " ".join(words[k : 1500 + k])) for k in (0, 100, 400, 750, 1500)] + [(2000, "", ""), (2001, "", "a"), (2002, "a b", "a b"), (2003, "a b", "c")]
    df = spark.createDataFrame(pairs, "k int, a string, b string").select("k", fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    found = {r.k: r.near for r in df.select("k", fingerprints.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    for k in (0, 100, 400, 750, 1500):
        same = max(0, 1496 - k)
        assert found[k] == pytest.approx(same / (2 * 1496 - same), abs=0.12)
    assert (found[2000], found[2001], found[2002]) == (1.0, 0.0, 1.0) and found[2003] < 0.2


def test_fingerprints_over_many_buckets(spark, monkeypatch):
    """Cut evenly between quantiles, and by the hash within an id that many rows share."""
    monkeypatch.setattr(fingerprints, "QUANTILES", 8)
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 64)
    rows = [(k if k % 3 else 7, f"t{k} " * 5) for k in range(300)]
    found = fingerprints.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = Counter(r.text for r in found)
    assert seen == Counter(t for _, t in rows)
    following = {}
    for r in found:
        following[r.text] = r.edited[len(r.text) - len(r.text) // 2 :]
    ids = sorted({i for i, _ in rows})
    for i, text in rows:
        if i != 7:
            after = [t for j, t in rows if j == ids[(ids.index(i) + 1) % len(ids)]]
            assert any(t.startswith(following[text][: len(t)]) for t in after)
    assert len({r.edited for r in found}) == 300


def test_fingerprints_of_clashing_columns_of_one_row_and_of_nothing(spark, docs, clashing, nothing):
    key = lambda df: sorted((r.text, r.edited) for r in df.collect())
    assert key(fingerprints.edited(clashing)) == key(fingerprints.edited(docs))
    assert fingerprints.edited(nothing).count() == 0
    (one,) = fingerprints.edited(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one.edited == "abab" and one.fingerprint == one.next_fingerprint
    assert fingerprints.fingerprints(clashing).columns[-1] == "fingerprint_"


def edits(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    if len(y) - len(x) != 1:
        return False
    k = next((k for k in range(len(x)) if x[k] != y[k]), len(x))
    return x[k:] == y[k + 1 :]


def grouped(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [u for u in n if u != w and edits(w, u)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w] or "", n.get(form[w]) or 0, root(w)) for w in n)


def found_variants(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in variants.group_variants(df).collect())


def test_variants_equal_plain_search(docs, rows, monkeypatch):
    assert found_variants(docs) == grouped(rows)


def test_variants_of_hot_groups_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(variants, "GROUP", 6)
    monkeypatch.setattr(variants, "SHARD", 64)
    monkeypatch.setattr(variants, "HOT_ROWS", 3)
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([7, 7, 8, 9]))) for _ in range(350)]
    rows = [(k, " ".join([w] * rng.choice([2, 3, 30, 400])), "en", None, 1) for k, w in enumerate(words)]
    assert found_variants(spark.createDataFrame(rows, SCHEMA)) == grouped(rows)


def test_variants_of_clashing_columns_and_of_nothing(docs, clashing, nothing):
    assert found_variants(clashing) == found_variants(docs)
    assert variants.group_variants(nothing).count() == 0


def test_near_pairs_come_once():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    asked, start, end = [], [], []
    for k, w in enumerate(words):
        cut = rng.randint(0, len(w) + 1)
        asked, start, end = asked + [k, k], start + [0, cut], end + [cut, len(w) + 1]
    i, j = variants.near_pairs(words, np.array(asked), np.array(start), np.array(end))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted((p, q) for p, x in enumerate(words) for q, y in enumerate(words) if p != q and edits(x, y))


def test_wavelet_matrix_reports_rectangles():
    rng = np.random.default_rng(4)
    ys = rng.permutation(300)
    x0, x1, y0, y1 = (rng.integers(0, 301, 80) for _ in range(4))
    which, y = WaveletMatrix(ys).report(x0, x1, y0, y1)
    want = [(k, v) for k in range(80) for v in ys[x0[k] : max(x0[k], x1[k])].tolist() if y0[k] <= v < y1[k]]
    assert sorted(zip(which.tolist(), y.tolist(), strict=True)) == sorted(want)
