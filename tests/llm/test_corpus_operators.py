"""Corpus operators against brute force, exact round trips and held-out accuracy, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from strandloom.llm import exact_dedup, language_id, license_scan, mixing, overlap, packing, quality, registry, simhash, syncmers, toxicity, training, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, fp string, h long, node long, id long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def docs_of(spark, texts, ids=None, sources=None, langs=None):
    """A table with columns whose names clash with those that operators make."""
    n = len(texts)
    rows = [((ids[i] if ids else i), texts[i], langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(texts[i] or ""), "k", "f", 1, 2, 3) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward():
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today".split()
    rng = random.Random(5)
    long = " ".join(rng.choice(base) + str(rng.randint(0, 500)) for _ in range(20_000))
    texts = [None, "", "   \t\n", "one", "One", "one two", "a b c", "a  b\tc", "a b c ", long, long, long + " end", " ".join(base), " ".join(base), " ".join(base[:-1] + ["tomorrow"]), "1234 5678", "é à ü", "\x1c\u00a0x"]
    for k in range(40):
        t = [rng.choice(base) + str(rng.randint(0, 50)) for _ in range(60)]
        texts.append(" ".join(t))
        if k % 3 == 0:
            t[7] = "changed"
            texts.append(" ".join(t))
    return texts


@pytest.fixture(scope="module")
def rough(spark):
    texts = awkward()
    ids = list(range(len(texts)))
    ids[5] = None
    ids[8] = 7  # a repeated id
    return docs_of(spark, texts, ids), list(zip(ids, texts))


def brute_fingerprint(text, k=3):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, linked):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(items))]


def check_simhash(rows, got):
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, roots)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_simhash_brute(spark, rough):
    docs, rows = rough
    check_simhash(rows, simhash.simhash_components(docs).collect())


def test_simhash_table_brute(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_simhash(rows, registry.op1_simhash(spark, SF).collect())


def test_covering_masks_meet_every_pair():
    rng = random.Random(1)
    for r in (1, 2, 3, 5):
        masks = simhash.covering_masks(r)
        assert len(masks) == 2 ** (r + 1) - 1
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), r))
            assert any(not m & d for m in masks)
            m = next(m for m in masks if not m & d)
            assert any(not f & d for f in simhash.finer(m, r))


def test_hot_runs_are_dealt_to_finer_tables(spark):
    rng = random.Random(2)
    center = rng.getrandbits(64)
    fps = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    points = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    got = simhash.links(points, 3, run_most=4).collect()
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    mine = brute_components(range(len(fps)), lambda a, b, e={(x.src, x.dst) for x in got}: (a, b) in e or (b, a) in e)
    assert roots == mine


def test_simhash_empty_table(spark):
    docs = docs_of(spark, ["x"]).where("false")
    assert simhash.simhash_components(docs).count() == 0
    assert simhash.near_duplicate_filter(docs).count() == 0


def test_near_duplicate_filter(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, copies = [], []
    for i in range(40):
        t = [rng.choice(vocabulary) for _ in range(200)]
        rows.append(" ".join(t))
    for i in range(20):
        t = rows[i].split()
        t[rng.randint(0, 199)] = "other"
        copies.append(" ".join(t))
    texts = rows + copies + [None, "", "  "]
    kept = {r.doc_id for r in simhash.near_duplicate_filter(docs_of(spark, texts)).collect()}
    assert set(range(40)) | {60, 61, 62} <= kept
    assert len(kept & set(range(40, 60))) <= 1
    assert simhash.near_duplicate_filter(docs_of(spark, texts)).columns == docs_of(spark, texts).columns


def brute_near_groups(texts, k=5, least=0.8):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (t.lower().split() for t in texts)]
    return set(brute_components(sets, lambda a, b: len(a & b) >= least * len(a | b)))


def test_near_duplicates_cut_and_extended(spark):
    rng = random.Random(6)
    texts = [" ".join(f"v{rng.randrange(3000)}" for _ in range(rng.randint(20, 300))) for _ in range(60)]
    for t in texts[:60]:
        w, part = t.split(), rng.random()
        texts += [" ".join(w[: int(len(w) * (0.75 + 0.25 * part))]), " ".join(w + [f"e{rng.randrange(999)}" for _ in range(int(len(w) * 0.3 * part))])]
    texts += ["a b", "a  B", "a b c"] * 3
    assert {r.doc_id for r in simhash.near_duplicate_filter(docs_of(spark, texts)).collect()} == brute_near_groups(texts)


def test_near_duplicates_around_one_text(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(300):
        t = list(base)
        for p in rng.sample(range(400), 7):
            t[p] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(t))
    assert brute_near_groups(texts) == {0}
    assert [r.doc_id for r in simhash.near_duplicate_filter(docs_of(spark, texts)).collect()] == [0]


@pytest.mark.parametrize("radius", [3, 6, 7, 8])
def test_covering_masks_are_distinct(radius):
    rng = random.Random(radius)
    masks = simhash.covering_masks(radius)
    assert len(set(masks)) == 2 ** (radius + 1) - 1 and 0 not in masks
    for _ in range(200):
        d = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not m & d for m in masks)


def test_near_duplicates_with_repeated_passages(spark):
    rng = random.Random(8)
    texts = [" ".join(f"v{rng.randrange(3000)}" for _ in range(300)) for _ in range(30)]
    texts = [" ".join([t, *[" ".join(t.split()[:30])] * n]) for n in (1, 12) for t in texts]
    assert brute_near_groups(texts) == set(range(30))
    assert {r.doc_id for r in simhash.near_duplicate_filter(docs_of(spark, texts)).collect()} == set(range(30))


def test_equal_words_in_another_order_are_no_near_duplicates(spark):
    rng = random.Random(12)
    tail = [f"w{i}" for i in range(30)]
    texts = ["na " * 200 + " ".join(rng.sample(tail, 30)) for _ in range(2)] + ["na " * 200 + " ".join(tail)]
    texts.append(texts[2].replace("na na", "na  na", 1))
    want = brute_near_groups(texts)
    assert {r.doc_id for r in simhash.near_duplicate_filter(docs_of(spark, texts)).collect()} == want == {0, 1, 2}


def test_near_duplicates_with_hot_passages_and_groups(spark):
    """A third of the rows are copies of one text, many share a passage, some link only through others."""
    rng = random.Random(13)
    fresh = lambda n: [f"u{rng.randrange(5000)}" for _ in range(n)]
    base, passage = fresh(120), fresh(60)
    texts = []
    for _ in range(120):
        t = list(base)
        for p in rng.sample(range(120), 2):
            t[p] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(t))
    texts += [" ".join([*passage, *fresh(rng.choice([3, 8, 14, 40]))]) for _ in range(120)]
    chain = fresh(100)
    for _ in range(40):
        chain = chain[4:] + fresh(4)
        texts.append(" ".join(chain))
    texts += [" ".join(fresh(50)) for _ in range(60)]
    rng.shuffle(texts)
    assert {r.doc_id for r in simhash.near_duplicate_filter(docs_of(spark, texts)).collect()} == brute_near_groups(texts)


def test_differences_miss_no_similar_pair():
    """Two similar sets of a run share a key that no bound leaves out, or both are in the star of sure pairs, whatever the core is."""
    rng = np.random.default_rng(11)
    part, met = 0.2 / 1.8, 0
    for k in range(12):
        base = np.unique(rng.integers(0, 1 << 63, 150, dtype=np.uint64))
        variants = [np.unique(np.r_[rng.permutation(base)[20:], rng.integers(0, 1 << 63, 20, dtype=np.uint64)]) for _ in range(3)]
        made = [(base, *variants)[rng.integers(4)] for _ in range(40)]
        sets = [np.unique(np.r_[rng.permutation(m)[(n := rng.integers(0, 25)) :], rng.integers(0, 1 << 63, n, dtype=np.uint64)]) for m in made]
        core = (overlap.common(sets), sets[0], np.zeros(0, np.uint64))[k % 3]
        often = [rng.integers(0, 1 << 63, 8, dtype=np.uint64) for _ in range(2)]  # any filters give an order
        keys, at, size = zip(*(overlap.difference_keys(s, core, 7, 5, often, 0.8) for s in sets))
        excess = [d - part * len(s) for d, s in zip(size, sets)]
        centre = int(np.argmin(excess))
        for i, j in combinations(range(len(sets)), 2):
            x, y = sets[i], sets[j]
            both = len(np.intersect1d(x, y))
            similar = both >= 0.8 * (len(x) + len(y) - both) - overlap.SLACK
            if excess[i] + excess[j] <= overlap.SLACK:
                assert similar and excess[centre] + max(excess[i], excess[j]) <= overlap.SLACK
            elif similar:
                place = dict(zip(keys[j].tolist(), at[j].tolist()))
                least = (size[i] + size[j] - part * (len(x) + len(y))) / 2 - overlap.SLACK
                assert any(h in place and min(size[i] - a, size[j] - place[h]) >= least for h, a in zip(keys[i].tolist(), at[i].tolist()))
                met += 1
    assert met > 300


def test_copies_changed_in_different_places_are_not_compared(spark, monkeypatch):
    """Hundreds of copies, each changed in three places or one: changes of the hub are no changes of the others."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(300):
        t = list(base)
        for p in rng.sample(range(10, 140), 3 if i % 10 else 1):
            t[p] = f"x{i}_{p}"
        texts.append(" ".join(t))
    rng.shuffle(texts)
    compared = []
    possible = simhash.possible_pairs
    monkeypatch.setattr(simhash, "possible_pairs", lambda pairs, *more: compared.append(pairs.count()) or possible(pairs, *more))
    assert {r.doc_id for r in simhash.near_duplicate_filter(docs_of(spark, texts)).collect()} == brute_near_groups(texts)
    assert sum(compared) < len(texts) * (len(texts) - 1) // 8  # a quarter of all pairs


def test_sketches_never_bound_too_low():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 2500))) for _ in range(2))
        both, most = len(np.intersect1d(x, y)), overlap.shared_at_most(overlap.sketch(x), overlap.sketch(y), len(x), len(y))
        assert both <= most <= min(len(x), len(y))
    alike = np.arange(300, dtype=np.uint64) << np.uint64(40)
    assert overlap.sketch(alike) == b"" and overlap.shared_at_most(b"", overlap.sketch(x), 300, len(x)) == min(300, len(x))


def test_simhash_candidates_meet_all_near_fingerprints(spark):
    rng = random.Random(14)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for f in fps for _ in range(4)]
    nodes = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    got = {(r.src, r.dst) for r in simhash.simhash_candidates(nodes, 3).collect()}
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in got)
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert brute_components(range(len(fps)), lambda a, b: (a, b) in got or (b, a) in got) == want


def test_exact_groups_brute(spark, rough):
    docs, rows = rough
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    want = sorted(((i, min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm)), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_exact_dedup_keeps_columns_and_one_of_each(spark, rough):
    docs, rows = rough
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    norm = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows}
    got = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in out.collect()]
    assert set(got) == norm
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0


def test_exact_dedup_keeps_one_row_of_each_group(spark):
    texts = ["a b", "a  b", "a b", "c", "c", "d", "d", "d", "e"]
    docs = docs_of(spark, texts, [1, 2, 1, None, None, 5, 5, 4, None]).repartition(5)
    got = sorted(((r.doc_id, re.sub(" +", " ", r.text)) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    assert got == sorted([(1, "a b"), (None, "c"), (4, "d"), (None, "e")], key=str)


def test_exact_dedup_of_a_hot_group(spark):
    texts = ["hot text"] * 300 + [f"t {i}" for i in range(200)] + [f"t {i}  " for i in range(0, 200, 4)]
    docs = docs_of(spark, texts).repartition(6)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(exact_dedup, "HOT", 5)
        got = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert len(got) == 550 and all((got[i].keep_id, got[i].group_size, got[i].kept) == (0, 300, i == 0) for i in range(300))
    assert sum(r.kept for r in got.values()) == 201 + 50  # "t 0" and "t 0 " differ
    kept = exact_dedup.exact_dedup(docs).collect()
    assert len(kept) == 251 and {r._key for r in kept} == {"k"}


def test_exact_groups_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(registry.OP6_SQL).fetchall())
    got = sorted(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in registry.op6_exact_dedup(spark, SF).collect())
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_golomb_round_trip(n):
    rng = np.random.default_rng(n)
    for high in (1 << 10, 1 << 40, (1 << 64) - 1):
        v = np.unique(rng.integers(0, high, n, dtype=np.uint64, endpoint=True))
        assert (exact_dedup.golomb_decode(len(v), *exact_dedup.golomb_encode(v)) == v).all()


def test_suspects_are_the_repeated_hashes(spark):
    rng = random.Random(4)
    pool = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    h = pool + rng.sample(pool, 200) + [pool[0]] * 2000
    rng.shuffle(h)
    df = spark.createDataFrame([(x,) for x in h], "h long").repartition(7)
    seen = defaultdict(int)
    for x in h:
        seen[x] += 1
    want = {x for x, n in seen.items() if n > 1}
    assert {r.h for r in exact_dedup.suspect_hashes(df, len(h)).collect()} == want
    assert {r.h for r in exact_dedup.suspect_hashes(df, exact_dedup.OWNED * 8).collect()} == want


def test_url_filter(spark):
    urls = [
        ("http://WWW.example.com/en/1", "www.example.com/en/", "allow"), ("https://a.example.com/en/1?x", "example.com/en/", "block"), ("https://a.example.com/de/1", "com/", "allow"), ("https://x.net/es/", "net/es/", "block"),
        ("https://x.net/en/1", None, "block"), ("https://x.org/1", None, "block"), ("https://x.org/2#top", None, "allow"), (None, None, "allow"), ("no scheme", None, "allow"), ("ftp://net", None, "allow"), ("https://b.com", None, "allow"), ("https://t.com/en/x://y/z", "com/", "allow"),
    ]
    html = {4: '<head><LINK href="/es/q" rel=canonical></head>', 5: '<meta http-equiv="refresh" content="0; url=https://a.example.com/en/1?x#f">', 2: '<link rel="canonical" href="https://x.net/es/">'}
    rows = [(i, u, html.get(i), "dup") for i, (u, _, _) in enumerate(urls)] + [(0, urls[0][0], None, "dup")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(registry.RULES, "host string, path string, verdict string")
    got = url_filter.url_filter(pages, rules, url_filter.page_edges(pages)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.rule, r.verdict) == urls[r.page_id][1:], r
    by = {r.page_id: r for r in got}
    assert (by[0].host, by[0].path, by[7].host, by[10].path) == ("www.example.com", "/en/1", "", "")
    assert url_filter.url_filter(pages.where("false"), rules, url_filter.page_edges(pages)).count() == 0


def test_page_edges(spark):
    src = "https://A.com/x/y/z.html?q=1#f"
    want = {"b": "https://A.com/x/y/b", "../b": "https://A.com/x/b", "./b/./c": "https://A.com/x/y/b/c", "../../../b": "https://A.com/b", "/r/../s?u=../v": "https://A.com/s?u=../v", "?p=2": "https://A.com/x/y/z.html?p=2", "//o.net/k": "https://o.net/k", "http://o.net/a?b&amp;c=1": "http://o.net/a?b&c=1", "..": "https://A.com/x/", "#top": src}
    html = "".join(f'<link rel="canonical" href="{t}">' for t in want) + '<META http-equiv=refresh content="3; URL=/one"><meta http-equiv="refresh" content="0;url=/two">'
    pages = spark.createDataFrame([(src, html), (None, html), ("https://b.com", '<link rel="canonical" href="c">'), ("https://c.com", None), ("https://d.com", "<p>none</p>")], "url string, html string")
    got = sorted((r.src, r.dst) for r in url_filter.page_edges(pages).collect())
    assert got == sorted([(src, x) for x in [*want.values(), "https://A.com/one", "https://A.com/two"]] + [("https://b.com", "https://b.com/c")])


def test_url_filter_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cols = ("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(str, con.sql(f"SELECT {', '.join(cols)} FROM ({registry.OP2_SQL})").fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in registry.op2_url_filter(spark, SF).collect())


def test_packing_round_trip(spark, rough):
    from tokenizers import Tokenizer

    docs, rows = rough
    t = Tokenizer.from_file(registry.vocabulary_path())
    want = sorted(tuple(t.encode(x or "", add_special_tokens=False).ids + [1]) for _, x in rows)
    got = packing.pack(docs, registry.vocabulary_path()).collect()
    room = defaultdict(list)
    for r in got:
        room[r.sequence_id].append((r.offset, r.length))
        assert 0 < r.length <= 4096 and r.start == r.piece * 4096
    for parts in room.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(len(x) for x in want)
    assert sum(r.length for r in got) == total
    assert len(room) <= -(-total // 4096) + 1
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows if i not in (None, 7)}
    for r in got:
        if r.doc_id in ids:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r.length
    assert packing.pack(docs.where("false"), registry.vocabulary_path()).count() == 0


def test_marks_behind_any_character():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.vocabulary_path())
    own = packing.WordTokenizer(registry.vocabulary_path())
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"x{c}. {c}.." for c in every]
    texts += [f"AL{c}{m} x" for c in every if c != c.lower() or c.lower() != c.upper() for m in packing.WordTokenizer.MARKS.decode()]
    for lo in range(0, len(texts), 50_000):
        part = texts[lo : lo + 50_000]
        for x, w, g in zip(part, t.encode_batch(part, add_special_tokens=False), own.many([x.encode() for x in part])):
            assert np.frombuffer(g, "<u4").tolist() == w.ids, x


def test_word_lookup_equals_whole_text_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.vocabulary_path())
    own = packing.WordTokenizer(registry.vocabulary_path())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["İstanbul ΣΑΣ ΟΔΟΣ. it's we'LL <|endoftext|> x<|startoftext|>y", "a\u0301 e\u0301 \u0301x", "a\x1cb\u00a0c\u2003d\x85e", "日本語 テスト 123 ½ ﬁ"]
    for x in texts:
        assert own(x.encode()).tolist() == t.encode(x, add_special_tokens=False).ids


def test_words_in_capitals_beside_special_tokens():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.vocabulary_path())
    own = packing.WordTokenizer(registry.vocabulary_path())
    for x in ("The <|endoftext|> Fox", "N <|", "<|x|> É ÉTÉ.", "A<|endoftext|>B C"):
        assert own(x.encode()).tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_common_words_outlive_rare_ones(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBERED", 400)
    monkeypatch.setattr(packing, "CORES", 400, raising=False)
    t = Tokenizer.from_file(registry.vocabulary_path())
    own = packing.WordTokenizer(registry.vocabulary_path())
    encode, new = own._encode, []
    monkeypatch.setattr(own, "_encode", lambda words: (new.extend(words), encode(words))[1])
    for k in range(40):
        texts = [f"the fox. {k}x{i} the fox {i % 7}, É{k}!" for i in range(90)]
        for x, ids in zip(texts, own.many([x.encode() for x in texts])):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert len(new) > 3600 and new.count(b"the") == new.count(b"fox") == 1
    assert len(getattr(own, "met", ())) + len(getattr(own, "earlier", ())) < 1000


def test_best_fit_packs_tightly():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 4097, 3000)
    bins, offsets, fill = packing.best_fit(n, 4096)
    assert fill.max() <= 4096 and np.bincount(bins, n).tolist() == fill.tolist()
    assert len(fill) <= 1.02 * n.sum() / 4096 + 1
    for b in range(0, len(fill), 37):
        at = np.flatnonzero(bins == b)
        order = at[np.argsort(offsets[at])]
        assert offsets[order].tolist() == (np.cumsum(n[order]) - n[order]).tolist()


def brute_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        w = sum(weight[s] for s in names if s not in fixed)
        share = {s: rest * weight[s] / w for s in names if s not in fixed} if w else {}
        over = {s: most * sizes[s] for s in share if share[s] > most * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def test_mixing_targets_and_copies(spark):
    rng = random.Random(9)
    texts, sources = [], []
    for i in range(300):
        s = rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot", "\u00e9", "Z"])
        texts.append(rng.choice([None, "", *[" ".join(["w"] * rng.randint(1, 40))] * 8]) if s != "c" else "few")
        sources.append(s)
    docs = docs_of(spark, texts, sources=sources)
    got = mixing.mix(docs).collect()
    assert len(got) == 300
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += len(words(t))
    want, taken = brute_targets(dict(sizes)), defaultdict(int)
    for r in got:
        assert r.size == len(words(texts[r.doc_id])) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        assert list(r.position) == sorted(r.position) and all(0 <= p <= 1 for p in r.position)
        assert len(r.position) == r.whole + (r.part > 0) or r.size == 0
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = {r.doc_id: (r.taken, r.position) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: (r.taken, r.position) for r in got}
    assert mixing.mix(docs.where("false")).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {(r._key, r.fp, r.h, r.node, r.id) for r in mixed.collect()} == {("k", "f", 1, 2, 3)}
    odd = docs.withColumnsRenamed({"fp": "size", "h": "_src", "node": "position"})
    assert {r.doc_id: r.taken for r in mixing.mix(odd).collect()} == {r.doc_id: r.taken for r in got}
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_mixing_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, size, source_size, target, taken, position FROM ({registry.OP4_SQL}) ORDER BY doc_id").fetchall()
    got = sorted(registry.op4_mixing(spark, SF).collect(), key=lambda r: r.doc_id)
    assert [tuple(r[c] for c in ("doc_id", "size", "source_size", "target", "taken")) for r in got] == [w[:5] for w in want]
    for r, w in zip(got, want):
        assert r.position == pytest.approx(w[5], abs=1e-12)


def test_demand_inversion(spark):
    knots = mixing.SCHEDULES[1]
    got = spark.range(101).select(mixing.invert_demand((mixing.F.col("id") / 100).cast("double"), knots).alias("t")).collect()
    fine = np.linspace(0, 1, 100_001)
    demand = np.cumsum(np.interp(fine, *zip(*knots)))
    demand /= demand[-1]
    for i, r in enumerate(got):
        assert abs(np.interp(r.t, fine, demand) - i / 100) < 1e-3


def brute_syncmers(text, k=syncmers.K, s=syncmers.S):
    """Positions of k-mers whose least inner s-mer (by the same hash, in plain integers) stands first or last."""
    m = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 31) * int(syncmers._Q)) & m
        return x ^ x >> 29

    def of(i):
        h = ord(text[i]) + 1
        for c in text[i + 1 : i + s]:
            h = (h * int(syncmers._P) + ord(c) + 1) & m
        return mix(h)

    small = [of(i) for i in range(len(text) - s + 1)]
    inner = k - s + 1
    return [i for i in range(len(text) - k + 1) if min(small[i : i + inner]) in (small[i], small[i + inner - 1])]


def test_syncmers(spark, rough):
    docs, rows = rough
    got = syncmers.document_fingerprints(docs, ranges=5).collect()
    assert len(got) == len(rows)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], 0)) + [r for r in rows if r[0] is None]
    plain = [r for r in order if r[0] not in (None, 6, 7)]
    by = {r.doc_id: r for r in got}
    for (i, t), (j, nxt) in zip(order, order[1:] + order[:1]):
        if i in (None, 6, 7) or j == 7:
            continue
        t, nxt = t or "", nxt or ""
        e = syncmers.edited(t, nxt)
        r = by[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == syncmers.fingerprint(t) and r.edited_fingerprint == syncmers.fingerprint(e)
        assert r.near_next == syncmers.likeness(r.fingerprint, syncmers.fingerprint(nxt)) and 0 <= r.near_edited <= 1
    assert plain and syncmers.document_fingerprints(docs.where("false")).count() == 0


def test_syncmer_likeness_brute():
    """Against all anchors held as sets; with a part of them, near that."""
    rng = random.Random(15)
    fresh = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    for n in (5, 60, 900, 9000):
        a = fresh(n)
        for b in (a[: n // 2] + fresh(n // 2), fresh(n // 3) + a, syncmers.edited(a, fresh(n)), fresh(n)):
            x, y = (dict(reversed(list(zip(h.tolist(), p.tolist())))) for h, p in (syncmers.anchors(a), syncmers.anchors(b)))
            shifts = sorted(x[h] - y[h] for h in x.keys() & y.keys())
            slack = max(2 * syncmers.K, max([*x.values(), *y.values()]) // 50)
            agree = sum(abs(s - shifts[len(shifts) // 2]) <= slack for s in shifts)
            want = agree / len(x.keys() | y.keys())
            assert syncmers.likeness(syncmers.fingerprint(a, share=1), syncmers.fingerprint(b, share=1)) == pytest.approx(want)
            assert syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b)) == pytest.approx(want, abs=0.2)


def test_syncmers_with_string_ids(spark):
    texts = [f"text number {i} " * (i % 7) for i in range(60)]
    docs = docs_of(spark, texts).withColumn("doc_id", mixing.F.format_string("d%03d", "doc_id"))
    got = {r.doc_id: r for r in syncmers.document_fingerprints(docs, ranges=4).collect()}
    for i, t in enumerate(texts):
        assert got[f"d{i:03d}"].edited_sha256 == hashlib.sha256(syncmers.edited(t, texts[(i + 1) % 60]).encode()).hexdigest()


def test_syncmers_are_context_free():
    rng = random.Random(8)
    a = "".join(rng.choice("abcdefgh ") for _ in range(500))
    h, at = syncmers.anchors(a)
    shifted, at2 = syncmers.anchors("xyz" + a)
    assert set(zip(h.tolist(), (at + 3).tolist())) <= set(zip(shifted.tolist(), at2.tolist()))
    assert syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(a)) == 1.0
    assert syncmers.likeness(syncmers.fingerprint(""), syncmers.fingerprint("")) == 1.0
    assert syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint("")) == 0.0
    for t in (a, "é" * 40, "ab" * 50, a[:13], "".join(rng.choice("ab\u4e2d\U0001f600") for _ in range(200))):
        want = brute_syncmers(t)
        assert not want or syncmers.anchors(t)[1].tolist() == want


def test_fitting_uses_only_unheld_rows(spark):
    got = registry.op7_language_id(spark, SF)
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    merged = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").selectExpr("avg(cast(lang = lang_pred as int)) as a").first()
    assert merged.a > 0.97


def test_ftrl_brute():
    """One coordinate and class at a time, from the published update."""
    rng, model = np.random.default_rng(9), language_id.Ftrl(6, 3, alpha=0.4, beta=0.9, l1=0.02, l2=0.03)
    z, n = [[0.0] * 3 for _ in range(6)], [[0.0] * 3 for _ in range(6)]

    def weight(i, k):
        if abs(z[i][k]) <= 0.02:
            return 0.0
        return -(z[i][k] - (0.02 if z[i][k] > 0 else -0.02)) / ((0.9 + n[i][k] ** 0.5) / 0.4 + 0.03)

    for _ in range(60):
        at, label = np.sort(rng.choice(6, 3, replace=False)), int(rng.integers(3))
        v = rng.random(3)
        w = [[weight(i, k) for k in range(3)] for i in at]
        e = np.exp([sum(v[j] * w[j][k] for j in range(3)) for k in range(3)])
        for j, i in enumerate(at):
            for k in range(3):
                g = v[j] * (e[k] / e.sum() - (k == label))
                sigma = ((n[i][k] + g * g) ** 0.5 - n[i][k] ** 0.5) / 0.4
                z[i][k] += g - sigma * w[j][k]
                n[i][k] += g * g
        model.learn(at, v, label)
    assert np.allclose(model.weights(), [[weight(i, k) for k in range(3)] for i in range(6)])


def test_tf_idf_brute(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df, n = language_id.document_frequencies(docs, "text")
    texts = [r.text or "" for r in docs.collect()]
    want = np.zeros(language_id.DIM, int)
    for t in texts:
        want[list(set(language_id.grams(t).tolist()))] += 1
    assert n == len(texts) and (df == want).all()
    idf = np.log((1 + n) / (1 + df)) + 1
    for t in ("", "Abc abc", "x" * 5000, texts[0]):
        low, tf = t.lower(), defaultdict(int)
        for k in (1, 2, 3):
            for i in range(len(low) - k + 1):
                tf[int(language_id.grams(low[i : i + k])[-1])] += 1  # the last is the gram of all k characters
        raw = {g: (1 + np.log(c)) * idf[g] for g, c in tf.items()}
        norm = sum(x * x for x in raw.values()) ** 0.5
        at, v = language_id.vector(t, idf)
        assert dict(zip(at.tolist(), v.tolist())) == pytest.approx({g: x / norm for g, x in raw.items()})


def test_language_awkward(spark, rough):
    docs, rows = rough
    got = language_id.language_id(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
    none = [r for r in got if r.doc_id in (0, 1, 2, 15)]
    assert all(r.lang_pred == "und" for r in none) and len(none) == 4
    assert language_id.language_id(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs.withColumn("lang", mixing.F.lit(None).cast("string"))).collect()} == {"und"}
    out = language_id.language_filter(docs, least=0.0)
    assert out.columns == docs.columns and {0, 1, 2, 15}.isdisjoint({r.doc_id for r in out.collect()})


def test_toxicity(spark, rough):
    docs, rows = rough
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    none = toxicity.toxicity(docs, labels.where("false")).collect()
    assert len(none) == len(rows) and all(r.score == 0 and r.predicted == 0 for r in none)
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
    insults = ["idiot", "moron", "scum", "loser"]
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for i in range(400):
        t = [rng.choice(plain) for _ in range(50)]
        if i % 4 == 0:
            for _ in range(4):
                t.insert(rng.randint(0, 50), rng.choice(insults))
        texts.append(" ".join(t))
        y.append(int(i % 4 == 0))
    marks = spark.createDataFrame([(i, v, "x") for i, v in enumerate(y)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, score string")
    got = toxicity.toxicity(docs_of(spark, texts), marks).collect()
    assert np.mean([r.predicted == y[r.doc_id] for r in got if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def brute_toxic_features(text, learned):
    low = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    fixed, second = set(toxicity.LEXICON), set(toxicity.SECOND_PERSON)
    hits = [i for i, w in enumerate(low) if w in fixed]
    near = sum(any(w in second for w in low[max(0, i - 6) : i + 7]) for i in hits)
    odd = masked = 0
    for w in text.split():
        if any(a.isalpha() and b.isalpha() and m and all(c in "0134578@$!|*.-_" for c in m) for a, m, b in ((w[i], w[i + 1 : j], w[j]) for i in range(len(w)) for j in range(i + 2, len(w)))):
            odd += 1
            clear = "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}.get(c, c) for c in w.lower() if c not in "*.-_")
            known = lambda x: any(p in fixed or p in learned for p in re.split(r"[\W_]+", x))
            masked += known(clear) and not known(w.lower())
    m, chars = max(1, len(low)), max(1, len(text))
    more = sum(w in learned for w in low)
    gap = min((b - a for a, b in zip(hits, hits[1:])), default=1e4)
    upper = sum(c.isupper() for c in text)
    marks, symbols = sum(c in "!?" for c in text), sum(c in "#$%&*|" for c in text)
    return [len(hits), len(hits) / m, len({low[i] for i in hits}), more, more / m, near, near / m, gap, upper / chars, marks / chars, symbols / chars, odd / m, masked, masked / m, np.log1p(len(low)), len(set(low)) / m]


def test_toxicity_features_brute(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", "!", "You ID1OT, you m0r0n", "st*pid s.c.u.m idi0t. trash", "idiot " * 600 + "your you", "É" * 80, "wordy " * 700 + "wordy2 x-y"]
    learned = frozenset(["wordy", "plain", *texts[0].lower().split()[:3]])
    for t in texts:
        assert toxicity.features(t, learned) == pytest.approx(brute_toxic_features(t, learned)), t[:80]


def test_one_tree_brute():
    """Depth 2 on few rows: the splits of greatest gain over all columns and thresholds, and Newton leaves."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (rng.random(60) < 0.1)).astype(float)
    got = toxicity.Trees(rounds=1, depth=2, rate=1.0, reg=1.0).fit(x, y)
    p = np.full(60, y.mean())
    g, h = y - p, p * (1 - p)
    score = lambda at: g[at].sum() ** 2 / (h[at].sum() + 1)

    def split(at):
        best = None
        for j in range(3):
            for t in got.edges[j]:
                lo, hi = at & (x[:, j] <= t), at & (x[:, j] > t)
                if h[lo].sum() >= 1 and h[hi].sum() >= 1:
                    gain = score(lo) + score(hi) - score(at)
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, j, t
        return best if best and best[0] > 1e-6 else None

    def leaves(at, depth):
        s = split(at) if depth and at.sum() >= 10 else None
        if s is None:
            return np.where(at, g[at].sum() / (h[at].sum() + 1) if at.any() else 0, 0.0)
        return leaves(at & (x[:, s[1]] <= s[2]), depth - 1) + leaves(at & (x[:, s[1]] > s[2]), depth - 1)

    assert got.score(x) == pytest.approx(got.base + leaves(np.ones(60, bool), 2))


def test_bounded_samples_are_bounded(spark):
    rows = spark.createDataFrame([(None, "a", "x" if i % 50 else "rare") for i in range(4000)], "id long, text string, lang string")
    assert training.bounded_sample(rows, 100).count() <= 100
    mixed = spark.range(5000).selectExpr("id", "if(id % 1000 = 0, 'rare', if(id % 2 = 0, 'x', 'y')) as lang")
    drawn = training.bounded_sample(mixed, 400, of="lang").collect()
    assert len(drawn) <= 400 and sum(r.lang == "rare" for r in drawn) == 5
    assert sorted(drawn) == sorted(training.bounded_sample(mixed.repartition(7), 400, of="lang").collect())


def test_fitted_classifiers_on_awkward_rows(spark, rough):
    """Null, empty, very long and repeated rows among documents that models are fitted on."""
    _, rows = rough
    real = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    every = rows + real + [real[0], (None, None), (None, "x"), (1000, None)]
    docs = docs_of(spark, [t for _, t in every], [i for i, _ in every])
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id + 1000 as doc_id", "quality", "toxic")
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (7, None, None), (1000, 0, 1)], labels.schema))
    toxic, good = toxicity.toxicity(docs, labels).collect(), quality.quality(docs, labels).collect()
    lang = language_id.language_id(docs.withColumn("lang", mixing.F.expr("if(doc_id % 2 = 0, 'a', null)"))).collect()
    for got in (toxic, good, lang):
        assert len(got) == len(every) and all(0 <= r.score <= 1 for r in got)
        by = defaultdict(set)
        for r in got:
            by[r.doc_id].add(r.score)
        assert len(by[real[1][0]]) == 1
    assert all(r.predicted == (r.score >= 0.7) for r in toxic) and all(r.predicted == (r.score >= 0.3) for r in good)
    assert license_scan.license_scan(docs).count() == len(every)


def test_isotonic_is_the_monotone_fit():
    rng = np.random.default_rng(2)
    s = rng.random(400)
    y = (rng.random(400) < s).astype(float)
    x, r = training.isotonic(s, y)
    assert (np.diff(r) >= 0).all() and (np.diff(x) >= 0).all()
    assert abs(np.interp(s, x, r).mean() - y.mean()) < 1e-9


def brute_marginals(emit, trans):
    from itertools import product

    n, z, p = len(emit), 0.0, np.zeros(len(emit))
    for ys in product((0, 1), repeat=n):
        s = np.exp(sum(emit[i] * ys[i] for i in range(n)) + sum(trans[ys[i], ys[i + 1]] for i in range(n - 1)))
        z += s
        p += s * np.array(ys)
    return p / z


def test_forward_backward_brute():
    rng = np.random.default_rng(3)
    count = np.array([3, 0, 1, 5, 4])
    emit, trans = rng.normal(size=13), rng.normal(size=(2, 2))
    want = np.concatenate([brute_marginals(e, trans) for e in np.split(emit, np.cumsum(count)[:-1]) if len(e)])
    assert np.allclose(quality.marginals(emit, trans, count), want)


def test_quality(spark, rough):
    docs, rows = rough
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert len(quality.quality(docs, labels.where("false")).collect()) == len(rows)
    assert quality.quality(docs.where("false"), labels).count() == 0
    got = registry.op9_quality(spark, "/root/testdata/sf0.01")
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    d = got.join(y, "doc_id").collect()
    assert np.mean([r.predicted == r["quality"] for r in d if r.held_out]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in d)


def test_license_scan(spark, rough):
    docs, rows = rough
    assert license_scan.license_scan(docs).count() == len(rows)
    assert license_scan.license_scan(docs.where("false")).count() == 0
    texts = ["intro words\nReleased under the MIT License.", "x\n\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "the license of the driver was under the table", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", None, ""]
    got = {r.doc_id: r for r in license_scan.license_scan(docs_of(spark, texts)).collect()}
    assert [got[i].licenses for i in range(7)] == ["MIT", "Apache-2.0,MIT", None, "CC-BY-NC-4.0", "GPL-3.0", None, None]
    assert got[0].paragraph == 1 and got[1].n_paragraphs == 2


NOTICES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in it without restriction.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as written in version 3 of it.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
}


def brute_licenses(text, model, least=0.5, confirm=0.6):
    """(families, paragraphs) of one text, paragraph by paragraph in plain Python."""
    lines = [license_scan._words(x) for x in re.split(r"\r\n?|\n", text or "")]
    reach = max(len(license_scan._words(t)) for ts in license_scan.TEMPLATES.values() for t in ts)
    place, gate, hits = {g: i for i, g in enumerate(model["grams"])}, set(model["gate"]), []
    for s in range(len(lines)):
        for e in range(s, len(lines)):
            if not lines[e] or sum(map(len, lines[s + 1 : e])) >= reach:
                break
            if not any(gate & set(x) for x in lines[s : e + 1]):
                continue
            w = [x for line in lines[s : e + 1] for x in line]
            z = (sum((model["w"][place[g]] for g in license_scan._grams(w) if g in place), model["b"] * 0.0) + model["b"]) / model["t"]
            p = np.exp(z - z.max())
            k = int(p.argmax())
            family, p = model["classes"][k], float(p[k] / p.sum())
            pairs = {" ".join(w[i : i + 2]) for i in range(len(w) - 1)}
            like = max((len(pairs & x) / len(x) for t in license_scan.TEMPLATES.get(family, []) for x in [license_scan._shingles(license_scan._words(t))]), default=0)
            if family != "unknown" and p >= least and like >= confirm:
                hits.append((like, p, s - e, -s, family, e))
    minimal = [h for h in hits if not any(o != h and o[4] == h[4] and -o[3] >= -h[3] and o[5] <= h[5] for o in hits)]
    best = {max(h for h in minimal if -h[3] <= line <= h[5]) for m in minimal for line in range(-m[3], m[5] + 1)}
    islands = 0
    for f in {h[4] for h in best}:
        end = -1
        for s, e in sorted((-h[3], h[5]) for h in best if h[4] == f):
            islands += s > end
            end = max(end, e)
    return ",".join(sorted({h[4] for h in best})) or None, islands


def test_license_scan_brute(spark):
    import textwrap

    texts, want = [], []
    for f, t in NOTICES.items():
        for width in (18, 40, 60, 76, 300):
            for lead in ("", "# ", " * ", "// "):
                texts.append("some words before\n\n" + "\n".join(lead + x for x in textwrap.wrap(t, width)) + "\n\nint main(void)")
                want.append(f)
    texts.append("#" + "\n#".join(textwrap.wrap(NOTICES["MIT"], 60) + textwrap.wrap(NOTICES["BSD-3-Clause"], 60)))
    want.append("BSD-3-Clause,MIT")
    texts += ["\r\n".join(textwrap.wrap(NOTICES["BSD-3-Clause"], 50)), "Released under the MIT License.\nReleased under the MIT License.\n\nfor permission ask the author of this work", "the terms of the public were free\nunder the law", None, "", "\n\n", "licensed " * 3000]
    want += ["BSD-3-Clause", "MIT", None, None, None, None, None]
    plain = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    docs = docs_of(spark, texts + plain)
    model = {}

    def kept(sample, confirm, fit=license_scan.fit):
        model.update(fit(sample, confirm))
        return model

    with pytest.MonkeyPatch.context() as m:
        m.setattr(license_scan, "fit", kept)
        got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert len(got) == len(texts + plain)
    for i, t in enumerate(texts + plain):
        assert (got[i].licenses, got[i].n_paragraphs) == brute_licenses(t, model), t
    assert [(i, got[i].licenses) for i, w in enumerate(want) if got[i].licenses != w] == []


def test_license_scan_finds_every_planted_line(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r.licenses for r in registry.op10_license_scan(spark, "/root/testdata/sf0.01").collect()}
    for i, t in docs.items():
        assert (got[i] is not None) == bool(re.search(r"(?m)^(Released under|Licensed under|This work is licensed under) .*", t)), i


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        if name != "source_mixing":
            assert 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() and rows
    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() and packed.columns[0] == "doc_id"


def test_repeated_hashes_where_batches_have_none(spark):
    held = [[], [], [], [5, 1 << 63], [5], [5, 7], [1 << 63]]
    hashes = lambda column: [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
    rows = spark.createDataFrame([(np.array(h, np.uint64).tobytes(),) for h in held], "x binary")
    for part, want in ((rows, [(-(1 << 63), 2), (5, 3)]), (rows.where("length(x) = 0"), []), (rows.where("false"), [])):
        assert sorted(map(tuple, simhash.repeated(part, hashes, 2, len(held)).collect())) == want


def test_pipeline_stages_on_awkward_rows(spark, rough):
    """Each stage by brute force on what the one before kept, over rows with nulls, repeats, long texts and clashing columns."""
    import corpus_pipeline

    docs, _ = rough
    real = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = docs.union(docs_of(spark, [t for _, t in real] + [real[0][1]], [i for i, _ in real] + [real[0][0]]))
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language_id"](spark, docs, SF)
    assert spoken.columns == docs.columns
    assert all(re.search(r"[^\W\d_]", r.text or "") for r in spoken.collect())
    # every later stage starts from all rows, so that the awkward ones reach it
    once = stages["exact_dedup"](spark, docs, SF)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert once.columns == docs.columns and sorted(norm(r.text) for r in once.collect()) == sorted({norm(r.text) for r in docs.collect()})
    rows = [r for r in once.collect() if words(r.text)]
    near = stages["simhash_near_dedup"](spark, once, SF)
    texts = [r.text for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.encode().lower().split() for x in texts)]
    groups = brute_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    least = {}
    for r, g in zip(rows, groups):
        least[g] = min(least.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    got = [r for r in near.collect() if words(r.text)]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(least.values())
    mixed = stages["source_mixing"](spark, near, SF)
    assert mixed.columns == docs.columns and {r._key for r in mixed.collect()} == {"k"}
    packed = stages["best_fit_packing"](spark, mixed, SF).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) >= mixed.count()
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
