"""The ten operators and the pipeline on small fixtures, against plain Python."""

import base64
import hashlib
import io
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import _exchange, count_min, exact_dedup, jaccard_join, lm_scoring, mixing, packing, quality, substring_dedup, topk_search, toxicity, warc
from ledgerloom.llm._components import components
from ledgerloom.llm.elias_fano import EliasFano

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage = prose(rng, 40)
    texts = [prose(rng, rng.randint(0, 120)) for _ in range(60)]
    texts += [f"{prose(rng, 20)} {passage}  {prose(rng, 9)}" for _ in range(8)]
    base = prose(rng, 80).split()
    for _ in range(8):
        own = base[:]
        own[rng.randrange(80)] = "changed"
        texts.append(" ".join(own))
    texts += [texts[0], texts[0].replace(" ", "\n "), texts[61], None, None, "", "   \t", "one two", "One  TWO", passage * 30, "İ ß ñ 12 x's", "<|endoftext|> don't. A—b."]
    out = [(k, t, rng.choice(["en", None]), "hot" if k % 3 else rng.choice(["a", "b", None]), len(t or "")) for k, t in enumerate(texts)]
    return out + [(7, texts[7], "en", "a", 1), (None, texts[62], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def clashing(docs):
    """With more columns, named as the operators name their own."""
    more = ("id", "text_", "chunk", "bucket", "digest", "score", "label", "rid", "n", "ids", "__id", "rate", "keep_id")
    return docs.selectExpr("*", *(f"'x' AS {c}" for c in more))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_is_a_partition_of_the_stream(docs, rows):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(TOKENIZER)
    found = packing.pack(docs, TOKENIZER, window=64).collect()
    want = sorted((-1 if i is None else i, [*known.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in rows)
    by_place = sorted(found, key=lambda r: r.sequence_id * 64 + r.offset)
    at, whole, own = 0, [], []
    for r in by_place:
        assert r.sequence_id * 64 + r.offset == at and r.length <= 64
        ids = np.frombuffer(r.ids, dtype="<u2").tolist()
        assert zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(ids) == r.length and r.start == len(own)
        own += ids
        at += r.length
        if len(own) == r.doc_tokens:
            whole.append((-1 if r.doc_id is None else r.doc_id, own))
            own = []
    assert sorted(whole) == want
    joined = sorted(packing.sequences(docs, TOKENIZER, window=64).collect())
    assert [s.sequence_id for s in joined] == list(range(len(joined))) and [s.length for s in joined][:-1] == [64] * (len(joined) - 1)
    assert b"".join(bytes(s.ids) for s in joined) == b"".join(bytes(r.ids) for r in by_place)
    assert [(s.sequence_id, p.id, p.offset, p.length) for s in joined for p in s.pieces] == [(r.sequence_id, r.doc_id, r.offset, r.length) for r in by_place]
    last = max(packing.sequences(docs, TOKENIZER, window=64, pad_id=7).collect())
    assert np.frombuffer(last.ids, dtype="<u2").tolist() == np.frombuffer(joined[-1].ids, dtype="<u2").tolist() + [7] * (64 - last.length)


def test_word_tokenizer_equals_the_plain_one_for_every_code_point():
    """Alone, before and after a mark, inside a word, after a capital, and after a space.
    Of what isn't assigned, of ideographs and of Hangul syllables, which are alike, one in 211."""
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(TOKENIZER), packing.WordTokenizer(TOKENIZER)
    assert own.by_word
    alike = lambda k: 0x3400 <= k < 0xA000 or 0xAC00 <= k < 0xD800 or k >= 0x17000 or unicodedata.category(chr(k)) in ("Cn", "Co")
    points = [chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000 and (k % 211 == 0 or not alike(k))]
    for k in range(0, len(points), 40_000):
        texts = [f"{c} ab{c}, .{c}x H{c} T{c}. {c}" for c in points[k : k + 40_000]]
        want = plain.encode_batch_fast(texts, add_special_tokens=False)
        for text, found, w in zip(texts, own.encode([t.encode() for t in texts]), want, strict=True):
            assert np.frombuffer(found, dtype="<u2").tolist() == w.ids, repr(text)


def test_marks_and_capitals_equal_the_plain_tokenizer(monkeypatch):
    """Words with each mark, capitals that lower in several ways, empty ids, very long words; with a cache that is cleared all the time too."""
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(TOKENIZER), random.Random(3)
    words = ("ab", "AB", "É", "Ñandú", "ΣΑΣ", "İx", "ǅ", "it's", "d'l", "x<|", "<|endoftext|>", "á", "a\u0301", "5", "\u3000")
    texts = [f"{w}{m} {w}{m}{m}. É{w}{m}" for m in packing.WordTokenizer.MARKS.decode() for w in words]
    texts += ["".join(rng.choice("abAB éÉÑßİıΣς'*$&#/\\()<|>.,!\u0338\u0301 \t\u3000१2한") for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    texts += ["W" * 100_000 + "*** é" + "Ä" * 50_000 + "$$", ""]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for cached in (packing.CACHED_WORDS, 50):
        monkeypatch.setattr(packing, "CACHED_WORDS", cached)
        own = packing.WordTokenizer(TOKENIZER)
        assert [np.frombuffer(x, dtype="<u2").tolist() for x in own.encode([t.encode() for t in texts])] == want
        assert max(map(len, own.known)) <= packing.CACHED_BYTES


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["two  words.", "", " ñandú\n<|endoftext|> x"]
    own = packing.WordTokenizer(path)
    plain = Tokenizer.from_file(path)
    assert not own.by_word
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in own.encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def kept_words(rows, n=13):
    first = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, math.inf), math.inf if i is None else i)
    out = []
    for i, t, *_ in rows:
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (math.inf if i is None else i):
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup_matches_brute_force(clashing, rows):
    found = substring_dedup.dedup_substrings(clashing).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found), key=repr) == kept_words(rows)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in found)


def test_sketch_never_loses_a_repeated_key():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.int64).view(np.uint64)
    chunks = np.array_split(rng.permutation(np.concatenate([keys, keys[:700]])), 6)
    slices, width = 7, 3000
    touched = [count_min.Touched(c, slices, width) for c in chunks]
    answers = [{} for _ in chunks]
    for k in range(slices):
        sent = [(c, parts[k]) for c, parts in enumerate(t.parts() for t in touched) if k in parts]
        for (c, _), bits in zip(sent, count_min.merged([part for _, part in sent], width), strict=True):
            answers[c][k] = bits
    maybe = np.concatenate([t.repeated(a) for t, a in zip(touched, answers, strict=True)])
    again = np.isin(np.concatenate(chunks), keys[:700])
    assert maybe[again].all() and maybe[~again].mean() < 0.25


@pytest.mark.parametrize("places", [1, 5, 64, 200])
def test_relays_bring_every_blob_to_its_place(spark, monkeypatch, places):
    """Each chunk asks each bucket; rows stay within FAN_OUT for each place and step."""
    monkeypatch.setattr(_exchange, "FAN_OUT", 8)
    monkeypatch.setattr(_exchange, "trimmed", lambda x: x)
    docs = _exchange.packed(spark.range(places).selectExpr("CAST(id AS int) AS chunk", "id", "CAST(CAST(id AS string) AS binary) AS text"))
    send = lambda ids, texts, before: {b: b"%d>%d" % (ids[0], b) for b in range(places)}
    answers = _exchange.ask(docs, send, lambda blobs, bucket: [b"%s=%d" % (x, bucket) for x in blobs], places)
    steps, base = _exchange.steps_for(places)
    assert base <= 8 and answers.count() <= places * base and (base - 1) ** steps < places <= base**steps
    read = lambda ids, texts, found: pa.table({"id": pa.array(ids), "right": pa.array([found[0] == {b: b"%d>%d=%d" % (ids[0], b, b) for b in range(places)}])})
    assert _exchange.finish(docs, read, "id long, right boolean", [answers]).where("right").count() == places


def test_exact_dedup_matches_brute_force(clashing, rows):
    def norm(t):
        return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")

    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t, *_ in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(tuple, exact_dedup.group_copies(clashing).collect()), key=repr) == sorted(want, key=repr)
    kept = exact_dedup.drop_copies(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(groups)


def test_exact_dedup_splits_a_heavy_digest(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot  text' ELSE concat('t', id) END AS text")
    found = exact_dedup.group_copies(df)
    assert found.where("group_size = 1000 AND keep_id = 0").count() == 1000 and found.where("kept").count() == 2001


def linked(rows, n, per_cent):
    sets = []
    for _, t, *_ in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = sets[a] == sets[b]
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]) and (same or (rows[a][0] is not None and rows[b][0] is not None)):
                root[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), math.inf), i)
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, ((i, *_), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("block", [1 << 17, 300])
def test_jaccard_join_matches_brute_force(clashing, rows, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    found = jaccard_join.join_similar(clashing)
    assert sorted(map(tuple, found.collect()), key=repr) == linked(rows, 4, 85)


def test_search_finds_the_components_of_all_pairs():
    rng = np.random.default_rng(8)
    for _ in range(20):
        base = [rng.choice(400, 60, replace=False) for _ in range(4)]
        sets = []
        for _ in range(50):
            own = set(base[rng.integers(4)].tolist())
            for x in rng.choice(sorted(own), rng.integers(0, 9), replace=False):
                own -= {x}
                own |= {int(rng.integers(400))}
            sets.append(np.array(sorted(own), dtype=np.uint64))
        sizes = np.array([len(s) for s in sets])
        links = jaccard_join.search(np.arange(50), sizes, sets, np.arange(50), 85)
        groups = jaccard_join._Groups(50)
        for a, b in links:
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= 85 * (sizes[a] + sizes[b] - both)
            groups.join(a, b)
        for a in range(50):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 85 * (sizes[a] + sizes[b] - both):
                    assert groups.label[a] == groups.label[b]


@pytest.mark.parametrize("block", [1 << 17, 300])
def test_jaccard_join_counts_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    rng = random.Random(12)
    bases, texts = [prose(rng, 200).split() for _ in range(3)], []
    for k in range(60):
        own = bases[k % 3][:]
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(200)] = rng.choice(["some", "other", "words"])
        texts.append(" ".join(own))
    rows = [(k, t) for k, t in enumerate([*texts, texts[0], "", "alone"])]
    sets = {}
    for k, t in rows:
        w = t.split()
        sets.setdefault(frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else (), k)
    ids = {k: s for s, k in sets.items() if s}
    found = jaccard_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), links=True).collect()
    component = {r.doc_id: r.component_id for r in found}
    want = Counter(component[a] for a in ids for b in ids if a < b and 100 * len(ids[a] & ids[b]) >= 85 * len(ids[a] | ids[b]))
    assert sum(want.values()) > len(rows)  # more than any spanning forest has
    assert {r.doc_id: r.n_links for r in found} == {k: want[component[k]] for k, _ in rows}
    plain = jaccard_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in plain.collect()} == component


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 80)] + [(5, 5), (None, 3)]
    random.Random(1).shuffle(edges)
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert found == {**{k: 0 for k in range(1, 51)}, **{1000 + k: 1000 for k in range(1, 80)}}


def test_lm_scores_match_a_plain_model(clashing, rows):
    tokens = [[*(x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")), None] for _, t, *_ in rows]
    trains = [zlib.crc32((b"" if i is None else str(i).encode())) % 10 != 0 for i, *_ in rows]
    count, pairs, mass = Counter(), Counter(), Counter()
    for ws, own in zip(tokens, trains, strict=True):
        if own:
            count.update(ws)
            pairs.update(zip(["<s>", *ws[:-1]], ws, strict=True))
    total, distinct = sum(count.values()), len(count)
    count["<s>"] = sum(trains)
    for (v, _), n in pairs.items():
        mass[v] += n - 0.75 if n >= 2 else 0
    want = []
    for (i, *_), ws, own in zip(rows, tokens, trains, strict=True):
        base = full = 0.0
        for v, w in zip(["<s>", *ws[:-1]], ws, strict=True):
            p = (count[w] + 0.1) / (total + 0.1 * (distinct + 1))
            base += math.log10(p)
            n = pairs[v, w]
            full += math.log10(((n - 0.75 if n >= 2 else 0) + (count[v] - mass[v]) * p) / count[v] if count[v] else p)
        want.append((repr(i), not own, len(ws), sum(count[w] > 0 for w in ws), total, base, full))
    found = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scoring.score(clashing, order=2, discounts=lm_scoring.PRUNED).collect())
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-9) and a[6] == pytest.approx(b[6], abs=1e-3 * b[2])


def test_lm_of_three_words_keeps_what_was_met_once(clashing, rows):
    tokens = [[*(x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")), None] for _, t, *_ in rows]
    trains = [zlib.crc32((b"" if i is None else str(i).encode())) % 10 != 0 for i, *_ in rows]
    count, grams = Counter(), [Counter(), Counter()]
    for ws, own in zip(tokens, trains, strict=True):
        if own:
            count.update(ws)
            grams[0].update(zip(["<s>", *ws[:-1]], ws, strict=True))
            grams[1].update(zip(["<s>", *ws[:-2]], ws[:-1], ws[1:], strict=False))
    total, distinct = sum(count.values()), len(count)
    taken, seen = Counter(), Counter()
    discounts = []
    for level in grams:
        discounts.append(lm_scoring.chen_goodman(*(sum(n == k for n in level.values()) for k in (1, 2, 3, 4))))
        for g, n in level.items():
            taken[g[:-1]] += discounts[-1][min(n, 3) - 1]
            seen[g[:-1]] += n

    def raised(gram, p):
        n, d = grams[len(gram) - 2][gram], discounts[len(gram) - 2]
        return ((n - d[min(n, 3) - 1] if n else 0) + taken[gram[:-1]] * p) / seen[gram[:-1]] if seen[gram[:-1]] else p

    want = []
    for (i, *_), ws in zip(rows, tokens, strict=True):
        full = 0.0
        for k, w in enumerate(ws):
            before = ["<s>", *ws[:k]]
            p = raised((before[-1], w), (count[w] + 0.1) / (total + 0.1 * (distinct + 1)))
            full += math.log10(raised((*before[-2:], w), p) if k else p)
        want.append((repr(i), len(ws), full))
    found = sorted((repr(r.doc_id), r.n_tokens, r.score) for r in lm_scoring.score(clashing).collect())
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-3 * b[1])
    met = {g for g, n in grams[0].items() if n == 1}
    assert met and discounts[0][0] < 1


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (7, 7), (900, 1 << 40), (3000, 3500)])
def test_elias_fano_gets_and_succeeds(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n).astype(np.uint64))
    coded = EliasFano.of(values, universe)
    assert n == 0 or (coded[np.arange(n)] == values).all()
    asked = np.concatenate([values, rng.integers(0, universe, 300).astype(np.uint64)])
    at, equal = coded.successor(asked)
    assert (at == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(900)]
    vectors += [(900 + k, vectors[3][1]) for k in range(40)] + [(2000, None), (2100, []), (2200, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2300, [math.nan] * 6), (2400, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (2500, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    own = [(k, [math.floor(1024 * x) for x in v]) for k, v in vectors if k is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in own:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in own if c != q)[:10]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert sorted(map(tuple, topk_search.search_top(df).collect())) == sorted(want)
    assert topk_search.search_top(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(0, []), (1, []), (200, [1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk_search.search_top(empty).collect())) == [(0, 1, 1, 0)]


@pytest.mark.parametrize("root_bytes", [1 << 20, 0])
def test_topk_over_many_trees(spark, monkeypatch, root_bytes):
    for name, value in (("PIVOT_ROWS", 60), ("BLOCK_ROWS", 50), ("LEAF", 8), ("QUERY_ROWS", 3), ("ROOT_BYTES", root_bytes)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 5)) * 3
    vectors = [(k, [float(x) for x in centers[k % 8] + rng.normal(size=5) * 0.2]) for k in range(700)] + [(800, [1e6, 0.0, 0.0, 0.0, -1e6]), (801, [1e6] * 5)]
    own = [(k, [math.floor(1024 * x) for x in v]) for k, v in vectors]
    want = []
    for q, v in own:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in own if c != q)[:10]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert sorted(map(tuple, topk_search.search_top(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect())) == sorted(want)


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", None, "", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n", "ñ" * 5000, "<p>a</p>"]
    pages = [(k, f"http://x/{k}\r\nX: y", html[k % 6]) for k in range(40)] + [(3, "u", html[3]), (None, None, "only"), (None, "u", html[0])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    # The place of a row is part of record ids: the rows come from files.
    df.write.parquet(f"{tmp_path}/pages")
    found = warc.with_payload_size(warc.captures(spark.read.parquet(f"{tmp_path}/pages")))
    found = found.select(warc.source_id(F.col("capture_id")).cast("long").alias("i"), "response", "request", warc.source_id(F.col("response.refers_to")).cast("long").alias("r"), F.col("payload_bytes").alias("n")).collect()
    first = {}
    for i, _, h in pages:
        first[h or ""] = min((x for x in (first.get(h or "", i), i) if x is not None), default=None)
    want = sorted((repr(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""]) for i, _, h in pages)
    assert sorted((repr(x.i), x.n, x.response.digest, x.response.type, x.r) for x in found) == want
    bodies = Counter(bytes(x.response.body) for x in found if x.response.type == "response")
    assert bodies == Counter((h or "").encode() for i, _, h in pages if i == first[h or ""]) and all(bytes(x.request.body).startswith(b"GET ") for x in found)


def test_warc_skips_what_is_malformed():
    good = lambda k: b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" % k
    data = good(1) + b"junk\r\nmore\r\n" + good(2) + b"WARC/1.1\r\nWARC-Type: request\r\n\r\nno length\r\n" + good(3) + b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <4>\r\nContent-Length: 99\r\n\r\nshort"
    found = list(warc.parse(io.BytesIO(data)))
    assert [r.get("WARC-Record-ID", r["WARC-Type"]) for r in found] == ["<1>", "malformed", "<2>", "malformed", "<3>", "malformed"]
    assert list(warc.parse(io.BytesIO(b""))) == []


def test_mixing_meets_rates_and_keeps_rows(clashing, rows, spark):
    mixed = mixing.mix_sources(clashing, {"hot": 1.0, "a": 3.0}, rows=4000.0).collect()
    counts = Counter(r.source for r in mixed)
    assert set(counts) == {"hot", "a"} and counts["hot"] == pytest.approx(1000, rel=0.2) and counts["a"] == pytest.approx(3000, rel=0.2)
    again = mixing.mix_sources(clashing, {"hot": 1.0, "a": 3.0}, rows=4000.0).collect()
    assert Counter((r.doc_id, r.copy_no) for r in mixed) == Counter((r.doc_id, r.copy_no) for r in again)
    draws = mixing.mix_sources(spark.range(20000).selectExpr("id AS doc_id", "'s' AS source"), rows=30000.0).groupBy("doc_id").count().groupBy("count").count().collect()
    for k, n in ((1, 20000 * 1.5 * math.exp(-1.5)), (3, 20000 * 1.5**3 / 6 * math.exp(-1.5))):
        assert dict(draws)[k] == pytest.approx(n, rel=0.08)


def labelled(spark, make):
    rng = random.Random(4)
    rows = [(k, *make(rng, k)) for k in range(600)]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t, _ in rows] + [(None, None, None, None, None), (9000, "", None, None, 0)], SCHEMA)
    return docs, spark.createDataFrame([(k, v, v) for k, _, v in rows] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), {k: v for k, _, v in rows}


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark, lambda rng, k: (prose(rng, 150), 1) if k % 4 else (" ".join([rng.choice(["BUY", "%%%", "win!!"]) for _ in range(150)]), 0))
    model = quality.fit(docs, labels)
    found = quality.score(docs, model).collect()
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(found) == 602 and sum(r.predicted == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    assert quality.keep_good(docs, model).columns == docs.columns


def test_toxicity_on_held_out_rows(spark):
    def make(rng, k):
        bad = k % 3 == 0
        w = prose(rng, 60).split()
        for _ in range(3 if bad else 0):
            w[rng.randrange(60)] = rng.choice(["horridword", "vileterm", "Vileterm!", "horridwurd"])
        return " ".join(w), int(bad)

    docs, labels, truth = labelled(spark, make)
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(found) == 602 and sum(r.predicted == truth[r.doc_id] for r in held) > 0.97 * len(held)


@pytest.fixture(scope="module")
def toxic_model():
    """Rows with three terms each, some quoted in clean ones, and a clean word that is near a term."""
    rng = random.Random(12)
    texts, y = [], []
    for k in range(900):
        w = prose(rng, 60).split()
        for _ in range(3 if k % 3 == 0 else 0):
            w[rng.randrange(60)] = rng.choice(["disgusting", "idiot", "Idiot!", "scum", "grumpf" + rng.choice(["en", "est", "lich", "a", "o", "ung"])])
        if k % 3 == 1:
            w[rng.randrange(60)] = "idiom"
        texts.append(" ".join(w).encode())
        y.append(float(k % 3 == 0))
    return toxicity.ToxicityModel(texts, np.array(y))


def test_misspelt_terms_count_and_quoted_ones_do_not(toxic_model):
    clean = prose(random.Random(3), 80)
    scanner = toxic_model.scanner()

    def score(more):
        text = f"{clean} {more}".encode()
        return float(toxic_model.calibration(scanner.features([text], [scanner.hits(text)]))[0])

    base = score("")
    for one in ("idiut", "disgustung", "scvm", "scumm", "idiot", "grumpfxy", "disgastung"):
        assert score(one) > 2 * base, one
    assert score("idiom") == base
    for quoted, same in (('"you idiot" he said', "you idiot he said"), ("“idiut scvm” x", "idiut scvm x"), ("« idiot » x", "idiot x"), ("„so idiot“ y", "so idiot y")):
        assert score(quoted) < score(same), quoted
    open_between = ('he said "hello" you idiot moron "bye"', '"hello" he said you idiot man "bye"', "“good” you idiot thing “nice”", 'he said "you idiot')
    for text in open_between:
        assert score(text) == pytest.approx(score(re.sub("[\"“”]", "", text)), rel=1e-2)


def test_hits_and_features_equal_plain_ones(toxic_model):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i, *row[1:]], row
            for j, z in enumerate(b, 1):
                row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != z))
        return row[-1]

    terms, stems, allowances, ordinary, _ = toxic_model.known
    assert {"idiot", "disgusting", "scum"} <= set(terms) and any(s.startswith("grum") for s in stems) and "idiom" in ordinary
    rng = random.Random(13)
    some = ["idiot", "idiut", '"idiot"', "scum,", "scvm", "disgusting", "disgastung", "idiom", "plain", "grumpfxx", '"', "«", "»", "(idiot)", '"so', 'then"', "“", "”x"]
    scanner = toxic_model.scanner()
    for _ in range(300):
        words = [rng.choice(some) for _ in range(rng.randint(0, 40))]
        want = []
        for k, w in enumerate(words):
            token = toxicity.cleaned(w)
            near = min((d for t in terms if (d := distance(token, t)) <= allowances[t]), default=-1)
            if near and any(token.startswith(s) for s in stems):
                near = 0
            if near > 0 and token in ordinary:
                near = -1
            if near >= 0:
                want.append((k, token, near))
        found = scanner.hits(" ".join(words).encode())
        assert [h[:3] for h in found] == want
        row = scanner.features([" ".join(words).encode()], [found])[0]
        free = [h for h in found if not h[3]]
        crowd = max((sum(0 <= b[0] - a[0] < 2 * toxicity.WINDOW for b in free) for a in free), default=0)
        assert row[1] == pytest.approx(math.log1p(sum(h[2] == 0 for h in free))) and row[3] == pytest.approx(math.log1p(len(found) - len(free))) and row[4] == pytest.approx(math.log1p(crowd))


def test_quotations_are_followed_by_kind():
    shown = lambda text: "".join("q" if q else "." for q in toxicity.quoted_words(text.split()))
    assert shown('a "b c" d') == ".qq." and shown('"a" b "c"') == "q.q" and shown('a " b c " d') == ".qqqq." and shown('a "b c d') == "...."
    assert shown("“a b” c ”d“") == "qq.." and shown("„a b“ c „d”") == "qq.q" and shown("« a b » c »d«") == "qqqq.q" and shown('a "b “c d” e" f') in (".qqqq.", "..qq..")
    assert shown('"' + "a " * 100 + 'b" c "d"') == "." * 102 + "q" or not toxicity.quoted_words(('"' + "a " * 100 + 'b" c "d"').split())[:100].any()


def test_lm_pairs_beyond_any_packing():
    """Items past 2**23 and words past 2**40, which don't fit one number together."""
    outer, inner = np.array([5, 1 << 23, 5, (1 << 23) + 1, 1 << 23, 5]), np.array([7, 3, 7, 3, 1 << 41, 2])
    a, b, which = lm_scoring._distinct(outer, inner)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == sorted(set(zip(outer.tolist(), inner.tolist(), strict=True)))
    assert (a[which] == outer).all() and (b[which] == inner).all()
    small = lm_scoring._distinct(np.array([2, 1, 2]), np.array([1, 9, 1]))
    assert [x.tolist() for x in small] == [[1, 2], [9, 1], [1, 0, 1]]


def test_fuzzy_lexicon_matches_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
        return row[-1]

    rng = random.Random(6)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 12))) for _ in range(40)]
    lexicon = toxicity.FuzzyLexicon(terms)
    for _ in range(1500):
        token = list(rng.choice(terms)) if rng.random() < 0.7 else [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(token) + 1)
            token[at : at + rng.randint(0, 1)] = rng.choice([[], ["a"], ["b"]])
        token = "".join(token)
        near = [d for t in terms if (d := distance(token, t)) <= toxicity.edits_allowed(len(t))]
        assert lexicon.edits(token) == min(near, default=-1), token


def test_models_without_labels_and_empty_tables(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, none)).count() == docs.count()
    assert toxicity.score(docs, toxicity.fit(docs, none)).count() == docs.count()
    assert packing.pack(nothing, TOKENIZER).count() == 0
    assert substring_dedup.dedup_substrings(nothing).count() == 0
    assert exact_dedup.group_copies(nothing).count() == 0
    assert jaccard_join.join_similar(nothing).count() == 0
    assert lm_scoring.score(nothing).count() == 0
    assert mixing.mix_sources(nothing).count() == 0
    assert warc.captures(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert quality.score(nothing, quality.fit(nothing, none)).count() == 0


def test_pipeline_stages(spark, tmp_path, rows):
    import corpus_pipeline

    rng = random.Random(9)
    good = [(1000 + k, prose(rng, 100), "en", "s", 1) for k in range(120)]
    docs = good + [(2000 + k, "%%% !!! " * 60, "en", "s", 1) for k in range(60)] + [(3000, good[0][1], "en", "s", 1), (3001, f"{good[0][1]} more", "en", "s", 1)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 2000 or i >= 3000), 0) for i, *_ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {i for i, *_ in good}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < 4:
            assert out.columns == df.columns
        df = spark.createDataFrame(out.collect(), out.schema)
        left = {r.doc_id for r in df.collect()}
        assert left == [ids | {3000, 3001}, ids | {3001}, ids, left & ids, left & ids][k]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_very_long_texts(spark):
    """A text of megabytes and one huge word, through operators that cut, hash, compress or scan."""
    long, word = "one two three four five six " * 60_000, "x" * 1_500_000
    rows = [(1, long, "en", "s", 1), (2, word, "en", "s", 1), (3, long + "more", "en", "s", 1), (4, "plain text", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.kept for r in exact_dedup.group_copies(docs).collect()} == {1: True, 2: True, 3: True, 4: True}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect()} == {1: (360_000, 0), 2: (1, 0), 3: (360_001, 360_000), 4: (2, 0)}
    assert {r.doc_id: r.component_id for r in jaccard_join.join_similar(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    assert {r.doc_id: r.n_tokens for r in lm_scoring.score(docs, order=3, discounts=None).collect()} == {1: 360_001, 2: 2, 3: 360_002, 4: 3}
    assert mixing.mix_sources(docs, rows=4.0).select("doc_id").distinct().count() <= 4


def test_stages_keep_clashing_columns_and_take_nulls_and_empty_tables(spark, tmp_path, clashing, nothing):
    import corpus_pipeline

    odd = clashing.selectExpr("*", "'x' AS __key", "'x' AS __source", "'x' AS copy", "'x' AS star", "'x' AS mix_rate")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and all(r["__key"] == "x" for r in out.collect()), name
        assert stage(spark, nothing, str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, str(tmp_path)).count() == 0


def test_rows_without_ids_draw_by_their_text(spark):
    df = spark.createDataFrame([(None, f"text {k}", "s") for k in range(400)], "doc_id long, text string, source string")
    kept = mixing.mix_sources(df).select("text").distinct().count()
    assert 200 < kept < 300


def test_topk_packs_vectors_and_broadcasts_none(spark):
    """What queries ask of trees was broadcast by the size of the queries alone."""
    for vectors in (np.array([[1, -32768], [32767, 0]]), np.array([[-32769, 5]]), np.array([[1 << 40, -1]]), np.array([[-(1 << 63), (1 << 63) - 1]]), np.zeros((2, 0), dtype=np.int64), np.zeros((0, 3), dtype=np.int64)):
        assert topk_search.unpacked(topk_search.packed(vectors), *vectors.shape).tolist() == vectors.tolist()
    assert [len(topk_search.packed(np.array([[x]]))) for x in (32767, -32768, 32768, 1 << 31)] == [2, 2, 4, 8]
    df = spark.createDataFrame([(k, [k % 7 - 3.0, k % 5 - 2.0]) for k in range(300)], "vec_id long, embedding array<double>")
    assert "strategy=merge" in topk_search.search_top(df)._jdf.queryExecution().optimizedPlan().toString()


def test_lm_discounts_come_from_all_counts(spark, clashing, monkeypatch):
    """They came from a part of the n-grams by hash where a level has over FITTED."""
    scores = lambda: sorted((repr(r.doc_id), r.n_tokens, r.train_tokens, r.score) for r in lm_scoring.score(clashing).collect())
    whole = scores()
    monkeypatch.setattr(lm_scoring, "FITTED", 1, raising=False)
    assert scores() == whole


def test_codes_of_counts():
    counts = np.array([0, 1, 3, 4095, 4096, 4097, 10**6, 10**12])
    found = lm_scoring._decoded(lm_scoring._coded(counts))
    assert found[:5].tolist() == counts[:5].tolist() and (abs(found / np.maximum(counts, 1) - 1)[1:] < 4e-4).all()
    assert lm_scoring._following(np.array([0, 0, 2, 2, 2]), np.array([1, 2, 0, 3, 9]), 3).tolist() == [[1, 1, 0], [0, 0, 0], [0, 0, 2]]


def test_tokenizer_remembers_the_words_of_a_corpus():
    """The memory of words was cleared at 200,000, which a partition's vocabulary passes, and all were encoded again."""
    tokenizer = packing.WordTokenizer(TOKENIZER)
    words = ["".join(chr(97 + (k // 26**i) % 26) for i in range(4)).encode() for k in range(250_000)]
    tokenizer.encode([b" ".join(words[a : a + 1000]) for a in range(0, len(words), 1000)])
    assert tokenizer.known.keys() >= set(words)
