"""Each operator on a small table of hard cases, and on an empty one, against brute force."""

import hashlib
import itertools
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, kd_shards, language_id, line_dedup, media_jpeg, mixing, quality_rules, simhash_neardup, substring_dedup, token_files
from plumbline.llm.common import Scratch, components
from plumbline.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, kept string, _pattern int, n_lines string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["The", "sharp", "river", "ran", "over", "Ärger", "été", "niño", "cold,", "stones.", "and", "found", "every", "quiet", "harbour"]) + r.choice(["", "er", "ing"]) for _ in range(n))


def hard_rows():
    long_, base = prose(1, 5000), prose(2, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [None, "", " \t\n ", "one", "two words", base, base, " ".join(near), base + "\nA line that comes twice here.\nA line that comes twice here.", long_, prose(3, 80), "日本語 テキスト", "x y <|endoftext|> Z", "###*** $$$ %%% " * 40, "A line that comes twice here.", "a  line THAT comes\ttwice here.", base]
    rows = [(k, t, [None, "en", "fr"][k % 3], [None, "a", "b"][k % 3], None if t is None else len(t), 7, "no", 1, "?") for k, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, base, "en", "a", 3, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "hard")
    spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "empty")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def words(text):
    return (text or "").encode().split()


def test_components_join_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(Scratch(spark, "t"), edges).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100}


# 1


def brute_measures(text):
    text = text or ""
    w = words(text)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    hit = set()
    for k, t in enumerate(tri):
        if tri.count(t) > 1:
            hit |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_measures(docs):
    for r in docs.where("doc_id <> 9 or doc_id is null").collect():
        assert quality_rules.measures(r.text)[:5] == brute_measures(r.text)


def test_quality_scores(docs, empty):
    rows = quality_rules.score(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.kept for r in rows if r.base_failed)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows) > 0
    assert quality_rules.score(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.7
    right = [0.9, 0.8, 0.95, 0.85, 0.7]
    votes = np.stack([np.where(rng.random(20_000) < 0.2, 0, np.where(rng.random(20_000) < a, 1, -1) * np.where(good, 1, -1)) for a in right], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(patterns, counts)
    assert abs(model.prior - 0.7) < 0.03
    assert np.abs(model.accuracies() - np.array(right)).max() < 0.05
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.95


# 2


def brute_fingerprint(text):
    w = words((text or "").encode().lower().decode()) if text else []
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_neardup_components(docs, empty):
    rows = simhash_neardup.near_duplicates(docs).collect()
    source = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    assert sorted(map(str, [(r.doc_id, r.fingerprint) for r in rows])) == sorted(map(str, [(d, f"{f:016x}") for d, f in source]))
    fps = {f for _, f in source}
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            root[top(a)] = top(b)
    least = {}
    for d, f in source:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    assert all(r.component_id == least[top(int(r.fingerprint, 16))] for r in rows)
    kept = simhash_neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert simhash_neardup.near_duplicates(empty).count() == 0 and simhash_neardup.keep_one(empty).count() == 0


@pytest.mark.parametrize("most", [20_000, 1])
def test_shards_lose_no_link(spark, most):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:100]:
        fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(3)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash_neardup.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), most)
    roots = {r.node: r.root for r in components(Scratch(spark, "t"), links).collect()}
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
            assert roots[a] == roots[b]
    for r in links.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(5)
    values = [rng.getrandbits(12) for _ in range(400)]
    tree = simhash_neardup.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.near(v, 2)) == [k for k, x in enumerate(values) if (x ^ v).bit_count() <= 2]


# 3


def test_media_round_trip(docs, empty):
    stored = media_jpeg.store(docs)
    rows = media_jpeg.read_back(stored).collect()
    raw = {}
    for r in docs.collect():
        b = (r.text or "").encode()
        raw[len(b)] = b + bytes(-len(b) % 64 if b else 64)
    for r in rows:
        p = raw[r.n_bytes]
        assert r.payload_bytes == len(p)
    pad = lambda b: b + bytes(-len(b) % 64 if b else 64)
    want = Counter()
    for d in docs.collect():
        p = pad((d.text or "").encode())
        (m,) = media_jpeg.encode([p])
        images = media_jpeg.parse(m)
        feature = ";".join(f"{i.width}x{i.height}-{media_jpeg.hashes(x)}" for i, x in zip(images, media_jpeg.thumbnails(images), strict=True))
        want[d.doc_id, len((d.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature] += 1
    assert want == Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in rows)
    digests = {hashlib.sha256((lambda b: b + bytes(-len(b) % 64 if b else 64))((r.text or "").encode())).hexdigest() for r in docs.collect()}
    assert {r.payload_sha256 for r in rows} == digests
    assert all(r.payload_bytes % 64 == 0 and r.payload_bytes > 0 for r in rows)
    assert media_jpeg.read_back(media_jpeg.store(empty)).count() == 0


def test_media_any_bytes():
    payloads = [os.urandom(64 * n) for n in (1, 2, 33)] + [bytes(64), b"\xff" * 640, b"\0\xff" * 320, os.urandom(64 * 8192)]
    for p, m in zip(payloads, media_jpeg.encode(payloads), strict=True):
        images = media_jpeg.parse(m)
        assert b"".join(x.tobytes() for x in media_jpeg.thumbnails(images)) == p
        assert len(images) == 1 + (len(p) > 64 * 8191)


def bits_of(pairs):
    s = "".join(f"{v:0{n}b}" for v, n in pairs if n)
    s += "1" * (-len(s) % 8)
    return bytes(int(s[k : k + 8], 2) for k in range(0, len(s), 8)).replace(b"\xff", b"\xff\0")


def test_media_reads_colour_with_sampling_and_coefficients():
    dc = {s: 4 for s in range(12)}
    ac = {0: 2, 0x01: 2, 0xF0: 3, 0x23: 4}
    dc_body, dc_codes = media_jpeg.canonical(dc)
    ac_body, ac_codes = media_jpeg.canonical(ac)
    rng = random.Random(6)
    out, last, grid = [], [0, 0, 0], {}
    for unit in range(6):  # 3 x 2 units of 16 x 16
        for comp, blocks in ((0, 4), (1, 1), (2, 1)):
            for b in range(blocks):
                value = rng.randrange(-100, 100)
                d = value - last[comp]
                last[comp] = value
                size = abs(d).bit_length()
                out += [dc_codes[size], ((d if d >= 0 else d + (1 << size) - 1), size), ac_codes[0x01], (1, 1), ac_codes[0xF0], ac_codes[0x23], (5, 3), ac_codes[0]]
                if comp == 0:
                    grid[unit // 3 * 2 + b // 2, unit % 3 * 2 + b % 2] = value
    seg = media_jpeg._segment
    file = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([16]) + bytes([1] * 63)) + seg(0xC0, b"\x08\x00\x20\x00\x2c\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00") + seg(0xC4, b"\0" + dc_body) + seg(0xC4, b"\x10" + ac_body) + seg(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + bits_of(out) + b"\xff\xd9"
    (image,) = media_jpeg.parse(file)
    (thumb,) = media_jpeg.thumbnails([image])
    assert (image.width, image.height, thumb.shape) == (44, 32, (4, 6))
    for (y, x), v in grid.items():
        assert thumb[y, x] == min(255, max(0, 2 * v + 128))


def test_media_refuses_what_it_cannot_read():
    whole = media_jpeg.encode([bytes(range(64))])[0]
    with pytest.raises(ValueError):
        media_jpeg.parse(b"GIF89a")
    with pytest.raises(ValueError):
        media_jpeg.parse(whole.replace(b"\xff\xc0", b"\xff\xc2"))
    with pytest.raises(ValueError):
        media_jpeg.thumbnails(media_jpeg.parse(whole[:-20]))


# 4 and 10


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_bpe_same_as_the_library(docs, empty, tokenizer):
    rows = bpe.digests(docs, vocabulary()).collect()
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)
    full = bpe.encode(docs, vocabulary())
    assert full.columns == [*docs.columns, "token_ids", "decoded"]
    assert bpe.digests(empty, vocabulary()).count() == 0 and bpe.encode(empty, vocabulary()).count() == 0


def test_bpe_and_files_on_odd_characters(tokenizer):
    rng, codec = random.Random(2), bpe.Codec(vocabulary())
    letters = [*"aAbB'sStT ré\t\n\x85\xa0\x1c12٣Σσςİıßﬁ日é😀ǅͅ?!.,​\x00", "<|endoftext|>", "'ll", "'RE", "foo.", "<|"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(3000)]
    found, wide = token_files._encode(vocabulary(), texts)
    for t, raw in zip(texts, found, strict=True):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert codec.text(t)[1] == " ".join(map(str, ids)) and codec.ids(t) == ids
        assert np.frombuffer(raw, f"<u{wide}").tolist() == [*ids, token_files.END_ID]
        assert codec.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_token_files(docs, empty, tokenizer):
    rows = token_files.read_files(token_files.write_files(docs, vocabulary())).collect()
    assert len(rows) == docs.count()
    rows.sort(key=lambda r: (r.start, r.n_tokens))
    keys = [r.doc_id for r in rows]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows[:-1])]
    want = {}
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert all(want[r.doc_id] == (r.n_tokens, r.ids_crc32) for r in rows)
    assert token_files.read_files(token_files.write_files(empty, vocabulary())).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, most in ((1, 0), (1, 9), (5, 3), (3000, 10**6), (1000, 1000), (700, 2**40)):
        values = np.sort(rng.integers(0, most + 1, n))
        ef, at = token_files.EliasFano.from_bytes(token_files.EliasFano.of(values).to_bytes())
        assert (ef.all() == values).all() and [ef[k] for k in range(n)] == values.tolist()
        if n >= 700:
            assert 8 * at / n < 3.5 + max(0, np.log2(most / n))


# 5


def test_suffix_automaton_holds_all_substrings():
    text = "abracadabra and a banana"
    a = language_id.SuffixAutomaton(text)
    every = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(a.phrases(s) == 1 for s in every)

    def brute(s):
        n = 0
        while s:
            k = 1
            while k < len(s) and s[: k + 1] in every:
                k += 1
            s, n = s[k:], n + 1
        return n

    rng = random.Random(3)
    for _ in range(300):
        s = "".join(rng.choice("abrcdn xz") for _ in range(rng.randrange(1, 15)))
        assert a.phrases(s) == brute(s)


def test_language_edge_cases(docs, empty):
    rows = language_id.identify(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[k].lang_pred == "und" for k in (0, 1, 2)) and by[13].lang_pred == "und"
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert language_id.identify(empty).count() == 0


def test_language_predictions_against_brute_parsing(spark):
    """Fitted on whole texts of rows that aren't held out; each prediction by parsing word after word with plain substring search."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    languages, samples = language_id.fit(docs)
    texts = {r.text for r in docs.collect() if r.text and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    held = {r.text for r in docs.collect()} - texts
    for lang, sample in zip(languages, samples, strict=True):
        own = sorted((r.text for r in docs.where(docs.lang == lang).collect() if r.text in texts), key=len, reverse=True)
        left = sample
        for t in own:  # nothing but whole texts
            left = left.replace(t, "", 1) if t in left else left
        assert not left.strip() and not any(t in sample for t in held if len(t) > 200)
    learned = [" " + " ".join(w for w in (language_id.only_letters(x) for x in s.split()) if w) + " " for s in samples]

    def phrases(word, sample):
        n, at = 0, 0
        while at < len(word):
            k = 1
            while at + k < len(word) and word[at : at + k + 1] in sample:
                k += 1
            at, n = at + k, n + 1
        return n

    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for r in docs.where("length(text) between 1 and 400").limit(12).collect():
        w = [x for x in (language_id.only_letters(b.decode()) for b in r.text.encode().split()) if x]
        if w:
            cost = [sum(phrases(f" {x} ", s) for x in w) for s in learned]
            assert got[r.doc_id].lang_pred == languages[int(np.argmin(cost))]


@pytest.mark.parametrize("tiny", ["a", "e t", "abc", "12 hello 345"])
def test_a_label_with_hardly_a_text_wins_no_text(spark, tiny):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(next(k for k in range(10**9, 10**9 + 50) if zlib.crc32(str(k).encode()) % 5), tiny, "xx")], docs.schema)
    languages, samples = language_id.fit(docs.unionByName(extra))
    assert "xx" in languages
    model = language_id.Model(languages, samples)
    assert not [r.doc_id for r in docs.where("length(text) > 40").collect() if model.predict(r.text)[0] == "xx"]


def test_every_label_is_learned_and_long_texts_are_bounded(spark):
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    rows = [(k, f"{word(k % 300)} " * 5, f"l{k % 300}") for k in range(3000)] + [(5000 + k, "lange texte " * 2000 + str(k), "long") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, samples = language_id.fit(docs)
    assert len(languages) == 301
    assert language_id.SAMPLE_CHARS * 0.6 < len(samples[languages.index("long")]) < language_id.SAMPLE_CHARS + 25_000


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


# 6


def test_shards_hold_nearly_equal_bytes(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = kd_shards.shard(table).collect()
    sizes, slots = {}, {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r.slot)
    assert set(sizes) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sizes.values()) / 24, max(r["size"] for r in rows)
    assert max(abs(s - mean) for s in sizes.values()) <= 2 * largest
    few = kd_shards.shard(docs)
    assert few.count() == docs.count() and sorted(map(str, [r.doc_id for r in few.collect()])) == sorted(map(str, [r.doc_id for r in docs.collect()]))
    null = few.where("doc_id = 0").first()
    assert (null["size"], null.text_crc32) == (8, 0)
    assert kd_shards.shard(empty).count() == 0


def test_shards_are_a_tree_of_cuts(spark):
    """Any two halves of the tree are apart along one dimension, and hold their share of the bytes but for one group of equal order."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    dims = kd_shards.default_dimensions()
    place = {r.doc_id: r for r in table.select("doc_id", *(c.alias(d) for d, c in dims.items())).collect()}
    rows = kd_shards.shard(table).collect()
    assert sorted((r.doc_id, r["shard"], r.slot) for r in rows) == sorted((r.doc_id, r["shard"], r.slot) for r in kd_shards.shard(table).collect())
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in rows:
        assert (r["size"], r.text_crc32) == (8 + len((texts[r.doc_id] or "").encode()), zlib.crc32((texts[r.doc_id] or "").encode()))
    largest = max(r["size"] for r in rows)

    def check(first, n):
        if n == 1:
            return
        left, right = ([r for r in rows if a <= r["shard"] < b] for a, b in ((first, first + n // 2), (first + n // 2, first + n)))
        step = {d: (max(p[d] for p in place.values()) - min(p[d] for p in place.values())) / ((1 << 20) - 1) for d in dims}
        assert any(max(place[r.doc_id][d] for r in left) <= min(place[r.doc_id][d] for r in right) + step[d] for d in dims)
        whole, own = sum(r["size"] for r in left + right), sum(r["size"] for r in left)
        assert abs(own - whole * (n // 2) / n) <= largest
        check(first, n // 2)
        check(first + n // 2, n - n // 2)

    check(0, 24)


def test_shards_of_string_keys(spark, tmp_path):
    spark.createDataFrame([(f"k{k}", prose(k, 20), "a long label" + " of a kind" * (k % 2)) for k in range(60)] + [(None, None, None)], "doc_id string, text string, lang string").write.parquet(str(tmp_path / "s"))
    rows = kd_shards.shard(spark.read.parquet(str(tmp_path / "s"))).collect()
    assert len(rows) == 61 and len({r["shard"] for r in rows}) == 24


def test_large_group_of_copies_is_split(spark, tmp_path):
    spark.createDataFrame([(k, "same text here") for k in range(600)] + [(1000 + k, prose(k, 30)) for k in range(100)], "doc_id long, text string").selectExpr("*", "'en' lang").write.parquet(str(tmp_path / "t"))
    rows = kd_shards.shard(spark.read.parquet(str(tmp_path / "t"))).collect()
    sizes = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(abs(s - mean) for s in sizes.values()) < 0.3 * mean


# 7


def test_passages_across_documents(spark, tmp_path, empty, docs):
    shared, other = prose(50, 60), prose(51, 70).split(" ")
    edited = list(other)
    edited[35] = "swapped"
    unlike = lambda seed, n: " ".join(f"w{random.Random(seed * 1000 + k).randrange(10**9)}" for k in range(n))
    texts = [f"{unlike(1, 80)} {shared} {unlike(2, 10)}", f"{unlike(3, 5)} {shared} {unlike(4, 200)}", unlike(5, 300), unlike(6, 20) + " " + " ".join(other), " ".join(edited) + " " + unlike(7, 60), None, "", shared.split(" ")[0], unlike(8, 40)]
    path = str(tmp_path / "p")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(path)
    rows = substring_dedup.find_passages(spark.read.parquet(path)).collect()
    spans = {r.doc_id: (r.start_word, r.end_word, r.partner, r.class_id) for r in rows}
    assert spans[0] == (80, 140, 1, 0) and spans[1] == (5, 65, 0, 0)
    assert spans[3][2:] == (4, 3) and spans[4][2:] == (3, 3) and set(spans) == {0, 1, 3, 4}
    assert substring_dedup.find_passages(empty).count() == 0
    copies = {r.doc_id for r in substring_dedup.find_passages(docs).collect()}
    assert {5, 6, 7, 8, 16, None} <= copies and not copies & {0, 1, 2, 3, 4, 10, 11, 14}


def test_passages_catch_all_long_repeats(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: words(r.text.lower()) for r in table.collect()}
    where = {}
    for d, w in docs.items():
        for k in range(len(w) - 50):
            where.setdefault(tuple(w[k : k + 51]), set()).add(d)
    truth = set().union(*(x for x in where.values() if len(x) > 1))
    rows = substring_dedup.find_passages(table).collect()
    assert truth <= {r.doc_id for r in rows}
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for r in rows:
        a = shingles(docs[r.doc_id][r.start_word : r.end_word])
        b = shingles(docs[r.partner][r.partner_start : r.partner_start + r.end_word - r.start_word])
        assert r.end_word - r.start_word >= 50 and len(a & b) / len(a | b) >= 0.8


def test_compact_windows_stand_for_every_run():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 30, 60)
    windows = substring_dedup.compact_windows(values, 5)
    for i in range(60):
        for j in range(i + 5, 61):
            assert sum(lo <= i and j <= hi and i <= c < j for lo, c, hi in windows) == 1


# 8


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left, open_ = total - sum(3 * sizes[s] for s in full), [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        over = {s for s, t in share.items() if t > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] for s in full} | share
        full |= over


def test_mixing(spark, docs, empty):
    for table in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        source = {(r.doc_id, r.source, len(words(r.text))) for r in table.collect()}
        rows = mixing.plan(table).collect()
        assert len(rows) == table.count() and {(r.doc_id, r.source, r["size"]) for r in rows} == source
        sizes, taken, largest = {}, {}, {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + r["size"]
            taken[r.source] = taken.get(r.source, 0) + r.taken
            largest[r.source] = max(largest.get(r.source, 0), r["size"])
            assert r.taken == r.copies * r["size"] <= 3 * r["size"] and len(r.positions) == r.copies
            assert all(0 < p <= 1 for p in r.positions)
        want = brute_targets(sizes)
        assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) for r in rows)
        assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
        again = mixing.training_order(table)
        assert again.columns == table.columns and again.count() == sum(r.copies for r in rows)
    assert mixing.plan(empty).count() == 0 and mixing.training_order(empty).count() == 0


# 9


def test_line_dedup(docs, empty):
    out = line_dedup.dedup_lines(docs)
    rows = {r.doc_id: r for r in out.where("doc_id not in (5)").collect()}
    assert out.count() == docs.count()
    assert rows[0].text is None and rows[1].text == "" and rows[2].text == " \t\n "
    assert rows[6].text == "" and rows[6].n_removed == 1
    assert rows[8].text == "A line that comes twice here." and rows[14].text == "" and rows[15].text == ""
    assert rows[9].text == hard_rows()[9][1]
    again = line_dedup.dedup_documents(docs)
    assert again.columns == docs.columns and again.where("doc_id = 6").first().n_chars == 0
    assert again.where("n_lines = '?'").count() == docs.where("n_lines = '?'").count()
    assert line_dedup.dedup_lines(empty).count() == 0


def edit_groups(forms):
    """Of each form the first in order that edit similarity alone links it to."""

    bags = [Counter(f) for f in forms]

    def alike(a, b):
        most = int(0.2 * max(len(forms[a]), len(forms[b])) + 1e-9)
        if max(sum((bags[a] - bags[b]).values()), sum((bags[b] - bags[a]).values())) > most:
            return False  # each edit mends one word on either side
        a, b = forms[a], forms[b]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1] <= most

    root = list(range(len(forms)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in itertools.combinations(range(len(forms)), 2):
        if abs(len(forms[i]) - len(forms[j])) <= 0.2 * max(len(forms[i]), len(forms[j])) + 1e-9 and alike(i, j):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(k) for k in range(len(forms))]


def lines_left(spark, path, lines):
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(lines)], "doc_id long, text string").repartition(3).write.parquet(path)
    return {r.doc_id for r in line_dedup.dedup_lines(spark.read.parquet(path)).where("n_removed = 0").collect()}


def test_lines_of_a_table_against_edit_similarity_alone(spark):
    """All lines of all texts, each held against each whose length and words leave a chance."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    lines = [[x.decode() for x in words(raw.lower())] for r in table.orderBy("doc_id").collect() for raw in (r.text or "").split("\n")]
    lines = [w for w in lines if w]
    forms = [list(x) for x in dict.fromkeys(map(tuple, lines))]
    kept = len(set(edit_groups(forms)))
    out = line_dedup.dedup_lines(table).collect()
    assert sum(r.n_removed for r in out) == len(lines) - kept and kept < len(forms)


def test_lines_of_unlike_order(spark, tmp_path):
    """A line, the same with two neighbours swapped, the same from end to start: the first two are alike, whichever comes first."""
    rng, lines = random.Random(95), []
    for k in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(20)]
        swapped = base[:7] + [base[8], base[7]] + base[9:]
        triple = [base, swapped, base[::-1]]
        rng.shuffle(triple)
        lines += triple
    assert len(lines_left(spark, str(tmp_path / "l"), lines)) == 40


def test_words_of_one_letter_are_told_apart(spark):
    """Lines of words that share a letter are similar by letters, and not by words."""
    rows = spark.range(20_000).selectExpr("concat('w', id) w", "pmod(xxhash64(concat('w', id)), 1920) h").groupBy("h").agg({"w": "collect_list"}).where("size(`collect_list(w)`) >= 10").limit(5).collect()
    for r in rows:
        w = r[1][:10]
        pair = spark.createDataFrame([(" ".join(w[:5]), " ".join(w[5:])), (" ".join(w), " ".join(w[:8] + ["x", "y"])), (" ".join(w), " ".join(w[:7] + ["x", "y", "z"]))], "a string, b string")
        exact = pair.select(line_dedup.similar_words(pair.a, pair.b).alias("s")).collect()
        letters = pair.select(line_dedup.similar(line_dedup.as_letters(pair.a), line_dedup.as_letters(pair.b)).alias("s")).collect()
        assert [x.s for x in exact] == [False, True, False] and letters[0].s


def test_lines_against_edit_similarity_alone(spark, tmp_path):
    rng = random.Random(91)
    lines = []
    for n in [4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16, 19, 20, 24, 25, 31, 60]:
        for most in (n // 5, n // 5, n // 5 + 1):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other = list(base)
            for k in rng.sample(range(n), most):
                other[k] = f"v{rng.randrange(10**6)}"
            shifted = list(base)
            for k in sorted(rng.sample(range(n), most), reverse=True):
                if rng.random() < 0.5:
                    del shifted[k]
                else:
                    shifted.insert(k, f"u{rng.randrange(10**6)}")
            lines += [base, other, shifted]
    lines = [list(x) for x in dict.fromkeys(map(tuple, lines))]
    groups = edit_groups(lines)
    assert lines_left(spark, str(tmp_path / "l"), lines) == set(groups) and len(set(groups)) < len(lines) - 40


def test_lines_of_one_common_word_against_edit_similarity(spark, tmp_path):
    rng = random.Random(92)
    lines = []
    for _ in range(12):  # over half of each line is one word
        cells = [f"c{rng.randrange(10**6)}" for _ in range(5)]
        base = ["|"] * 7 + cells[:3] + ["|"] + cells[3:]
        other = list(base)
        other[rng.choice((7, 8, 9))] = f"d{rng.randrange(10**6)}"
        lines += [base, other]
    groups = edit_groups(lines)
    assert lines_left(spark, str(tmp_path / "l"), lines) == set(groups)
    assert len(set(groups)) == 12


def test_stage_near_duplicates_against_brute_jaccard(spark, tmp_path):
    rng = random.Random(93)
    texts = []
    for n, changed in ((60, 1), (100, 1), (100, 2), (200, 3), (200, 8), (300, 4), (30, 2), (400, 6)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        other = list(base)
        for k in rng.sample(range(n), changed):
            other[k] = f"v{rng.randrange(10**6)}"
        texts += [base, other]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            group = [group[i] if g == group[j] else g for g in group]
    path = str(tmp_path / "k")
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(2).write.parquet(path)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.read.parquet(path), SF).collect()} == set(group)
    assert len(set(group)) < len(texts) - 4


def test_passage_at_two_places_of_one_text(spark, tmp_path):
    unlike = lambda seed, n: " ".join(f"w{random.Random(seed * 1000 + k).randrange(10**9)}" for k in range(n))
    passage = unlike(94, 60)
    texts = [f"{unlike(95, 20)} {passage} {unlike(96, 100)} {passage} {unlike(97, 30)}", passage]
    path = str(tmp_path / "p")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    rows = substring_dedup.find_passages(spark.read.parquet(path)).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in rows} == {(0, 20, 80), (0, 180, 240), (1, 0, 60)}


def test_one_hash_finds_every_passage_with_a_changed_word():
    rng = random.Random(98)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for k in range(500):
        passage = some(50)
        edited = passage[: k % 50] + ["changed"] + passage[k % 50 + 1 :]
        a, b = ({x[0]: x for x in zip(*(c.tolist() for c in substring_dedup.signatures(substring_dedup.tokens(" ".join(some(60) + w + some(60))))), strict=True)} for w in (passage, edited))
        assert any(min(a[key][5], b[key][5]) - max(a[key][4], b[key][4]) >= 21 for key in a.keys() & b.keys())


@pytest.mark.parametrize("order", range(6))
def test_passage_found_with_a_quoting_third_text(spark, tmp_path, order):
    """Two texts share 50 words; others quote the words around every signature of it, in contexts of their own."""
    rng = random.Random(99)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = some(50)
    texts = [some(80) + passage + some(30), some(10) + passage + some(70)]
    for _ in range(12):  # pieces of 15 to 24 words, with unlike words between them
        texts.append([w for k in range(0, 50, 12) for w in passage[max(0, k - rng.randrange(3)) : k + rng.randrange(15, 22)] + some(rng.randrange(1, 9))] + some(40))
    ids = list(range(len(texts)))
    random.Random(order).shuffle(ids)
    path = str(tmp_path / "p")
    spark.createDataFrame([(k, " ".join(texts[k])) for k in ids], "doc_id long, text string").repartition(3).write.parquet(path)
    found = {r.doc_id: (r.start_word, r.end_word) for r in substring_dedup.find_passages(spark.read.parquet(path)).collect()}
    assert found[0] == (80, 130) and found[1] == (10, 60)


def longest_alike(a, b):
    """Whether the texts' words have runs of 50 with shingles alike to 0.8, at one shift."""
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    where = {}
    for k in range(len(b) - 4):
        where.setdefault(tuple(b[k : k + 5]), []).append(k)
    shifts = Counter(k - j for k in range(len(a) - 4) for j in where.get(tuple(a[k : k + 5]), ())) if where else Counter()
    for shift, n in shifts.items():
        if n >= 41:
            for i in range(max(0, shift), min(len(a), len(b) + shift) - 49):
                x, y = shingles(a[i : i + 50]), shingles(b[i - shift : i - shift + 50])
                if len(x & y) >= 0.8 * len(x | y):
                    return True
    return False


def test_passages_recall_against_brute_force(spark):
    """All pairs of texts that share a rare shingle, measured on every run of 50 words at every shift; at least 99 of 100 documents are found."""
    docs = {r.doc_id: words(r.text.lower()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text}
    holders = {}
    for d, w in docs.items():
        for t in {tuple(w[k : k + 5]) for k in range(len(w) - 4)}:
            holders.setdefault(t, []).append(d)
    common = Counter(p for h in holders.values() if len(h) > 1 for p in itertools.combinations(sorted(h), 2))
    truth = {d for (a, b), n in common.items() if n >= 41 and longest_alike(docs[a], docs[b]) for d in (a, b)}
    found = {r.doc_id for r in substring_dedup.find_passages(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert len(truth) > 20 and len(truth & found) >= 0.99 * len(truth)


@pytest.mark.parametrize("carriers", [30, 300])
def test_pairs_found_around_a_quoted_passage(spark, tmp_path, carriers):
    """100 pairs of passages of 50 words with one word changed, around 40 words that many other texts quote, and those texts left alone."""
    rng = random.Random(1)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    common, rows = some(40), []
    for k in range(100):
        passage = some(5) + common + some(5)
        edited = list(passage)
        edited[rng.randrange(5, 45)] = "changed"
        rows += [(2 * k + j, " ".join(some(60) + w + some(60))) for j, w in enumerate((passage, edited))]
    rows += [(1000 + k, " ".join(some(60) + common + some(60))) for k in range(carriers)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    classes = {}
    for r in substring_dedup.find_passages(spark.read.parquet(str(tmp_path / "t"))).collect():
        classes.setdefault(r.doc_id, set()).add(r.class_id)
    assert sum(bool(classes.get(2 * k, set()) & classes.get(2 * k + 1, set())) for k in range(100)) >= 99
    assert max(classes) < 1000


def test_lines_deal_out_their_rarest_runs_alone(spark, monkeypatch):
    """Two fifths of a line's words and two more, and whatever the order of the runs, lines of few words, repeats among them, are joined as all pairs join them."""
    rng, lines = random.Random(9), []
    for k in range(240):
        n = rng.randrange(4, 24)
        base = [rng.choice(["|", "a", "b", "c", *(f"w{rng.randrange(30)}" for _ in range(3))]) for _ in range(n)]
        other = list(base)
        for _ in range(rng.randrange(n // 5 + 2)):
            at = rng.randrange(len(other))
            other[at : at + rng.randrange(2)] = [[], ["|"], [f"v{k}"]][rng.randrange(3)]
        lines += [base, other]
    forms = [list(x) for x in dict.fromkeys(map(tuple, lines)) if len(x) > 3]
    table = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(forms)], "_id long, _form string")
    made = line_dedup.blocks(table, line_dedup.rarities(table))
    assert all(r["count"] <= 2 * len(forms[r._id]) / 5 + 2 for r in made.groupBy("_id").count().collect())
    truth = edit_groups(forms)

    def groups():
        label = list(range(len(forms)))
        for r in line_dedup.near_lines(Scratch(spark, "order"), table).collect():
            x, y = sorted((label[r.a], label[r.b]))
            label = [x if v == y else v for v in label]
        return label

    assert len(set(truth)) < len(forms) and groups() == truth
    usual = line_dedup.rarities
    monkeypatch.setattr(line_dedup, "rarities", lambda x: tuple(F.transform(c, lambda v: F.lit(20 << 56) - v % F.lit(64 << 56)) for c in usual(x)))
    monkeypatch.setattr(line_dedup, "PAIRS", 500)
    monkeypatch.setattr(line_dedup, "BUCKETS", 64)
    monkeypatch.setattr(line_dedup, "PART", 3)
    assert groups() == truth


def test_tables_between_lines_and_links_go_once_used(spark):
    """Letters and the links of both rounds are all that is left on the disk."""
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join([*words[k % 7 : k % 7 + 20], f"x{k}"])) for k in range(30)]
    scratch = Scratch(spark, "left")
    assert line_dedup.near_lines(scratch, spark.createDataFrame(rows, "_id long, _form string")).count()
    assert len([x for x in os.listdir(scratch.root.removeprefix("file:")) if x.isdigit()]) == 3


def test_pairs_found_among_carriers_of_each_half(spark, tmp_path):
    """Passages of 50 words with one changed, inserted or left out in the middle, and other texts that quote the words before it or after it in contexts of their own; the last pair has more of these than one part holds."""
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(9):
        passage = some(50)
        edited = passage[:25] + [["changed"], ["changed", passage[25]], []][k % 3] + passage[26:] + some(1)
        rows += [(2 * k + j, " ".join(some(60) + w + some(60))) for j, w in enumerate((passage, edited))]
        for half in (passage[:25], passage[26 if k % 3 == 0 else 25 :]):
            rows += [(1000 * (k + 1) + len(rows), " ".join(some(60) + half + some(60))) for _ in range(200 if k == 8 else 20)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    found = {r.doc_id: (r.partner, r.class_id) for r in substring_dedup.find_passages(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert found == {2 * k + j: (2 * k + 1 - j, 2 * k) for k in range(9) for j in (0, 1)}


def test_groups_join_all_alike_windows():
    """Of random groups, among them repeats and texts' ends, the links kept join just what the alike pairs join, measured run by run."""
    rng = np.random.default_rng(6)
    base = rng.integers(1, 60, substring_dedup.AROUND)
    cuts = []
    for k in range(60):
        x = base.copy() if k % 2 else rng.integers(1, 2**32, substring_dedup.AROUND)
        x[30:55] = base[30:55]
        for p in rng.integers(0, substring_dedup.AROUND, k % 9):
            x[p] = rng.integers(1, 2**32)
        x[: k % 30 if k % 5 == 0 else 0] = 0
        cuts.append(x)
    n = len(cuts)
    c = {"id": np.arange(n), "row": np.arange(n), "at": np.full(n, 100), "lo": np.zeros(n, np.int64), "hi": np.full(n, 300), "cut": np.array(cuts, np.uint32)}
    c["earlier"], c["sizes"] = substring_dedup._sets(c["cut"])
    a, b = substring_dedup._pairs_within(np.array([0]), np.array([n]))
    pairs = list(zip(a.tolist(), b.tolist(), strict=True))
    assert sorted(pairs) == list(itertools.combinations(range(n), 2))

    def alike(x, y):
        e = np.flatnonzero((x != y) | (x == 0))
        on, back = min(e[e >= 35], default=81) - 35, 34 - max(e[e < 35], default=-1)
        if on + back < 21:
            return False
        runs = [(set(x[s : s + 46].tolist()), set(y[s : s + 46].tolist())) for s in range(36)]
        return any(0 not in p | q and len(p & q) >= 0.8 * len(p | q) for p, q in runs)

    truth = {(i, j) for i, j in pairs if alike(c["cut"][i], c["cut"][j])}
    links = substring_dedup._held_against(c, a, b)
    kept = {tuple(sorted(x)) for x in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True)}

    def joined(edges):
        label = list(range(n))
        for i, j in edges:
            label = [label[i] if v == label[j] else v for v in label]
        return {frozenset(k for k in range(n) if label[k] == v) for v in label}

    assert 10 < len(truth) and kept <= truth and joined(kept) == joined(truth)
