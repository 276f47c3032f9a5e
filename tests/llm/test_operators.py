"""The first ten operators on awkward tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flipwise.llm import (exact_dedup, mixing, near_dedup, packing, pii, pii_model, pii_rules, quality_model, quality_rules,
                          token_counts, token_index, tokens, warc)
from flipwise.llm.common import scratch_folder
from flipwise.llm.components import components

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, keep_id long, rest string, epochs int, "
          "key string, size int, item string, component string, class_id long, __id string, fail_bits string")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


def rows():
    body = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (3, None), (4, ""), (5, " \n\t "),
            (6, LONG), (7, LONG + " tail"), (8, "x"), (None, None), (9, "mail joe@mail.example.com or +1 (555) 555-2485 ok 4539578763621486"),
            (10, "zz\nzz\nzz\nzz q r s t"), (11, "<|endoftext|> a  b \n c  "), (12, "é" * 3000), (13, "a b c d e f g h")]
    return [(i, t, "en" if k % 3 else None, f"src{k % 2}" if k % 5 else None, 7, True, 0, "r", 1, "k", 2, "i", "c", 3, "x", "f")
            for k, (i, t) in enumerate(body)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts():
    return [(r[0], r[1] or "") for r in rows()]


def ids_of(text):
    return tokens.encoder().tokenizer.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ------------------------------------------------------------ token ids

def test_encoder_equals_the_library():
    rng = random.Random(5)
    parts = ["a", "B", "'s", "1", "22", " ", "  ", "\n", "\t", "é", "!", "<|endoftext|>", "🙂", "\x1c", "\x85", " ", "᠎", "word", "\r\n"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [LONG, "  y " * 60_000, "x" * 100_000]
    enc = tokens.encoder()
    got = []
    for _, ids, n in enc.slices(pa.array(cases)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [ids_of(c) for c in cases]
    assert enc.lengths(pa.array(cases)).tolist() == [len(g) for g in got]


def test_other_vocabularies_are_encoded_whole(docs):
    enc = tokens.encoder("word_bpe_49k.json")
    cases = [t for _, t in texts()] + ["It's  A\ttest , of <|endoftext|> odd\u2003spaces", "Caf\u0065\u0301 " * 20_000]
    plain = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in cases]
    assert not enc.by_piece and tokens.encoder().by_piece
    assert enc.lengths(pa.array(cases)).tolist() == [len(x) for x in plain]
    assert np.concatenate([ids for _, ids, _ in enc.slices(pa.array(cases))]).tolist() == sum(plain, [])
    got = token_counts.token_counts(docs, vocabulary="word_bpe_49k.json").collect()
    assert sorted(r.n_tokens for r in got) == sorted(map(len, plain[:-2]))


def test_encoder_table_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 50)
    enc = tokens.Encoder()
    for a in range(0, 3000, 300):
        case = " ".join(f"w{i}" for i in range(a, a + 300)) + " the the"
        (_, ids, _), = enc.slices(pa.array([case]))
        assert ids.tolist() == ids_of(case)
        assert len(enc.place) <= 50 + 302


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-2**62, 2**62, 20_000))
    index = token_index.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))


def test_token_shards(spark, docs, empty):
    folder = scratch_folder(spark, "t")
    manifest = token_index.write_token_shards(docs, folder, shards=3)
    got = [tuple(r)[:4] for r in token_index.read_token_shards(manifest, folder).collect()]
    assert collections.Counter((a, n, c) for a, _, n, c in got) == \
        collections.Counter((i, len(ids_of(t)) + 1, crc(ids_of(t) + [2])) for i, t in texts())
    end = 0
    for doc_id, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == end
        end += n
    keys = [r[0] for r in sorted(got, key=lambda r: r[1]) if r[0] is not None]
    assert keys == sorted(keys)
    found = token_index.look_up(spark, manifest, folder, spark.createDataFrame([(2,), (6,), (99,), (None,)], "doc_id long")).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in found) == sorted([(2, len(ids_of("a b c d e f g")) + 1)] * 2 + [(6, len(ids_of(LONG)) + 1)])
    assert token_index.token_shards(spark, empty).collect() == []


def test_token_shards_end_at_their_bytes(spark, docs):
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        folder = scratch_folder(spark, "t")
        manifest = token_index.write_token_shards(docs, folder, shards=1, shard_bytes=40)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    shards = token_index.shard_list(manifest)
    assert len(shards) > 3 and [r["shard"] for r in shards] == list(range(len(shards)))
    longest = sum(sorted(len(ids_of(t)) + 1 for _, t in texts())[-2:])  # one slice of two rows goes beyond the bound at most
    assert all(2 * r["n_tokens"] < 40 + 2 * longest for r in shards)
    got = sorted(token_index.read_token_shards(manifest, folder).collect(), key=lambda r: r.start)
    one = sorted(token_index.token_shards(spark, docs, shards=1).collect(), key=lambda r: r.start)
    assert [tuple(r)[:4] for r in got] == [tuple(r)[:4] for r in one]
    # a key whose records lie in two shards is found whole
    found = token_index.look_up(spark, manifest, folder, docs.select("doc_id").where("doc_id is not null")).collect()
    assert collections.Counter((r.doc_id, len(r.ids)) for r in found) == \
        collections.Counter((i, len(ids_of(t)) + 1) for i, t in texts() if i is not None)


def test_token_counts(docs, empty):
    got = collections.Counter(tuple(r) for r in token_counts.token_counts(docs).collect())
    assert got == collections.Counter((i, len(t.encode()), len(ids_of(t)), len(ids_of(t)) > 1024) for i, t in texts())
    assert token_counts.token_counts(empty).collect() == []


# ------------------------------------------------------------ packing

def check_packed(out, capacity, want):
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    return len(bins)


def want_pieces(pairs, capacity, end_id=0):
    out = collections.Counter()
    for i, t in pairs:
        ids = ids_of(t) + [end_id]
        head = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[(i, k, a, b - a, crc(ids[a:b]))] += 1
    return out


@pytest.mark.parametrize("group_items", [2, 1000])
def test_packing(docs, empty, group_items):
    check_packed(packing.pack(docs, 512, group_items=group_items).collect(), 512, want_pieces(texts(), 512))
    assert packing.pack(empty).collect() == []


def test_best_fit_takes_the_fullest_bin_with_room():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    left, want = [], []
    for s in sizes:
        fits = [(room, b) for b, room in enumerate(left) if room >= s]
        if not fits:
            left.append(100)
            fits = [(100, len(left) - 1)]
        room = min(fits)[0]
        b = next(b for r, b in fits if r == room)
        left[b] -= s
        want.append(room - s)
    bins, offsets = packing.best_fit(sizes, 100)
    assert max(bins) + 1 == len(left)
    assert sorted(100 - o - s for o, s in zip(offsets, sizes)) == sorted(want)


def test_packing_merges_underfull_sequences(spark):
    pairs = [(i, "a " * (30 + 13 * (i % 37))) for i in range(300)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    want = want_pieces(pairs, 512)
    alone = max(packing.best_fit(sorted((k[3] for k in want), reverse=True), 512)[0]) + 1
    for items, most in ((300, 1.0), (60, 1.05), (10, 1.2)):
        found = check_packed(packing.pack(docs, 512, group_items=items).collect(), 512, want)
        assert found <= most * alone, (items, found, alone)


# ------------------------------------------------------------ exact dedup, near dedup

def test_exact_groups(docs, empty, monkeypatch):
    for least in (500, 2):  # with 2, the repeated texts are dealt out by id
        monkeypatch.setattr(exact_dedup, "LEAST_HOT_ROWS", least)
        got = exact_dedup.exact_groups(docs).collect()
        groups = collections.defaultdict(list)
        for i, t in texts():
            groups[t].append(i)
        want = collections.Counter()
        for t, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            for k, i in enumerate(sorted(ids, key=lambda i: -1 if i is None else i, reverse=True)):
                want[(i, keep, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
        assert collections.Counter(tuple(r) for r in got) == want
        kept = exact_dedup.exact_dedup(docs)
        assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(empty).collect() == []
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_exact_dedup_keeps_null_apart_from_empty_in_the_row(spark):
    docs = spark.createDataFrame([(1, None), (0, "")], "doc_id long, text string")
    assert [tuple(r) for r in exact_dedup.exact_dedup(docs).collect()] == [(1, None)]


def shingle_set(text):
    words = text.encode().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_classes(pairs):
    sets, root = [shingle_set(t) for _, t in pairs], list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if pairs[i][1] == pairs[j][1] or (a and b and len(a & b) >= 0.8 * len(a | b)):
                root[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(pairs)):
        members[find(i)].append(i)
    return list(members.values())


def check_classes(got, pairs):
    want = collections.Counter()
    for members in brute_classes(pairs):
        least = min((pairs[i][0] for i in members if pairs[i][0] is not None), default=None)
        for i in members:
            want[(pairs[i][0], least, len(members))] += 1
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(brute_classes(pairs)) and all(r.doc_id == r.class_id for r in kept)


def test_near_classes_on_awkward_rows(docs, empty):
    check_classes(near_dedup.near_classes(docs).collect(), texts())
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(brute_classes(texts()))
    assert near_dedup.near_classes(empty).collect() == []


@pytest.mark.parametrize("block", [4, 512])
def test_near_classes_of_a_large_group_equal_brute_force(spark, block):
    """Copies of one text, each with a few changed words: most reach the class through the original only."""
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    pairs = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 10**6)}"
        pairs.append((i, " ".join(copy)))
    pairs += [(100 + i, " ".join(f"u{rng.randint(0, 5000)}" for _ in range(80))) for i in range(40)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    check_classes(near_dedup.near_classes(docs, block_texts=block).collect(), pairs)


def test_near_classes_of_copies_with_repeated_lines_equal_brute_force(spark):
    """Near copies (set Jaccard about 0.85) whose extra line repeats 100 times in one of them, and one whose own lines do."""
    rng = random.Random(11)
    pairs = []
    for i in range(40):
        body = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        line = " ".join(f"j{rng.randint(0, 10**6)}" for _ in range(30))
        pairs += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(body) + ("\n" + line) * 100)]
    lines = [" ".join(f"r{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(5)]
    pairs += [(100, "\n".join(lines)), (101, "\n".join([*lines, lines[0]])), (102, "\n".join([*lines, *lines[:2] * 100]))]
    check_classes(near_dedup.near_classes(spark.createDataFrame(pairs, "doc_id long, text string")).collect(), pairs)


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    x, y = rng.integers(1, 6, 200).astype(float), rng.integers(1, 6, 200).astype(float)
    x[:40], y[-40:] = 0, 0
    true = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(200)) for i in range(200) if x[i] and y[i])
    element = near_dedup._mix(np.arange(1, 201).astype(np.uint64))
    owner = np.concatenate([np.zeros((x > 0).sum(), np.int64), np.ones((y > 0).sum(), np.int64)])
    sig = near_dedup.signatures(owner, np.concatenate([element[x > 0], element[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"{a:03d}", f"{b:03d}") for a, b in [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201)]]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{i:03d}": "000" for i in range(61)} | {f"{100 + i:03d}": "100" for i in range(30)} | {"200": "200", "201": "200"}
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


# ------------------------------------------------------------ WARC

def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "<p>one</p>", "k"), (2, None, "<p>one</p>", "k"), (3, "u", None, "k"), (4, "u", "", "k"),
                                   (None, "u", "<p>one</p>", "k"), (2, None, "<p>one</p>", "k"), (5, "u", "é" * 50_000, "k"), (None, "u", "only null", "k")],
                                  "page_id long, url string, html string, digest string").repartition(2)
    folder = scratch_folder(spark, "w")
    manifest = warc.write_bundles(pages, folder, frame_bytes=2_000)
    got = collections.Counter(tuple(r)[:5] for r in warc.read_bundles(manifest, folder).collect())

    def row(i, text, refers=None):
        import base64
        data = text.encode()
        return (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers else "response", refers)

    one = "<p>one</p>"
    assert got == collections.Counter([row(1, one, 2), row(2, one), row(2, one), row(None, one, 2), row(3, "", 4), row(4, ""),
                                       row(5, "é" * 50_000), row(None, "only null")])
    for r in manifest.collect():
        bundle = warc.Bundle(folder, r.file)
        assert len(bundle.records) == r.records
        if "urn:page:5" in bundle.by_id:
            head, block = warc.parse_record(bundle.fetch("urn:page:5")[0])
            assert block.endswith(("é" * 50_000).encode()) and head["warc-type"] == "response"
        if "urn:page:1" in bundle.by_id:
            head, _ = warc.parse_record(bundle.fetch("urn:page:1")[0])
            assert head["warc-target-uri"] == "http://a/%0D%0AX: y" and "x" not in head
        # every bundle is a plain Zstandard file: all frames unpack to the records in order
        import zstandard
        bundle.file.seek(0)
        plain = zstandard.ZstdDecompressor().stream_reader(bundle.file.read(), read_across_frames=True).read()
        assert plain == b"".join(data for _, data in bundle)
        bundle.close()
    assert warc.archive(spark, pages.limit(0)).collect() == []
    small = scratch_folder(spark, "w")
    split = warc.write_bundles(pages, small, bundle_bytes=600)
    assert split.count() > manifest.count() and split.agg(F.sum("records")).first()[0] == 8
    assert collections.Counter(tuple(r)[:5] for r in warc.read_bundles(split, small).collect()) == got


# ------------------------------------------------------------ personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(s))) % 10 == 0

    return [[m.span() for m in EMAIL.finditer(t)], [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
            [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
            [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = list("ab1290.@-+ ()%_\n") + ["@x.y", "1.2.3.4", "255.", "4539578763621486 ", "é", "٣"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert pii_rules.base_spans(t) == plain_spans(t)
    for t in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 100_000):  # linear time
        pii_rules.base_spans(t)


def test_tagger_gradient():
    rng = np.random.default_rng(0)
    model = pii_model.Tagger(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    chars = rng.integers(0, pii_model.CLASSES, (4, 7))
    gold = np.zeros((4, 7), np.int64)
    gold[1, 2:5] = [1, 2, 2]

    def loss():
        emission, *_ = model._emission(np.ascontiguousarray(chars.T))
        move = np.where(model.ok, np.exp(model.p["trans"]), 0)
        ahead, total = np.exp(emission[0]), 0.0
        for t in range(1, 7):
            ahead = (ahead @ move) * np.exp(emission[t])
        total += np.log(ahead.sum(axis=1)).sum()
        g = gold.T
        total -= np.take_along_axis(emission, g[:, :, None], 2).sum() + model.p["trans"][g[:-1], g[1:]].sum()
        return total

    emission, state, kept_f, kept_b = model._emission(np.ascontiguousarray(chars.T))
    marginal, moved = model._crf(emission)
    assert np.allclose(marginal.sum(axis=2), 1)
    error = marginal.copy()
    np.put_along_axis(error, gold.T[:, :, None], np.take_along_axis(error, gold.T[:, :, None], 2) - 1, 2)
    grad = {k: np.zeros_like(v) for k, v in model.p.items()}
    dstate = error @ model.p["out"].T
    model._lstm_back(np.ascontiguousarray(chars.T), "f", kept_f, dstate[:, :, :pii_model.HIDDEN], grad)
    model._lstm_back(np.ascontiguousarray(chars.T), "b", kept_b, dstate[:, :, pii_model.HIDDEN:], grad)
    np.subtract.at(moved, (gold.T[:-1].ravel(), gold.T[1:].ravel()), 1)
    grad["trans"] = np.where(model.ok, moved, 0)
    for name in ("wh_f", "wx_b", "emb", "trans"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        old, step = model.p[name][at], 1e-2
        model.p[name][at] = old + step
        up = loss()
        model.p[name][at] = old - step
        down = loss()
        model.p[name][at] = old
        assert abs((up - down) / (2 * step) - grad[name][at]) < 0.03 * abs(grad[name][at]) + 1e-2, name


def test_personal_data(spark, docs, empty):
    got = pii.find_personal_data(docs, None).collect()
    want = collections.Counter()
    for i, t in texts():
        base = plain_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, found in zip(pii_rules.KINDS, base) for a, b in found)
        want[(i, *map(len, base), hashlib.sha256(joined.encode()).hexdigest(), joined, 0, 0, sum(map(len, base)))] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert pii.personal_data(empty).collect() == []
    assert pii.fit(spark.createDataFrame([(1, "no anchor")], "doc_id long, text string")) is None


class _WordTagger:
    """Sees an e-mail address in every word of more than 20 characters, and in every word that a window cuts."""

    ok = pii_model.allowed()
    p = {"trans": np.zeros((pii_model.TAGS, pii_model.TAGS), np.float32)}

    def read(self, windows):
        seen = self.marginals(windows)
        return seen, np.log(seen)

    def marginals(self, windows):
        out = np.full((*windows.shape, pii_model.TAGS), 1e-4, np.float32)
        for w, chars in enumerate(windows):
            words = re.finditer("x+", "".join("x" if c > 1 and c != 97 else " " for c in chars))
            out[w, :, 0] = 1
            for a, b in (m.span() for m in words if m.end() - m.start() > 20 or m.start() == 0 or m.end() == len(chars)):
                out[w, a:b, 0], out[w, a:b, 2] = 1e-4, 1
                if a:
                    out[w, a, 1], out[w, a, 2] = 1, 1e-4
        return out


@pytest.mark.parametrize("shift", range(0, 64, 7))
def test_added_spans_keep_their_whole_word(shift):
    address = "first.of.very.many.names." * 6 + "last[@]" + "host.of.many.parts." * 6 + "example.com"
    text = "w " * 60 + "v" * shift + " " + address + " and" * 40 + " end" * 30
    begin = text.index("first")
    starts = pii.window_starts(text)
    assert starts[0] < begin and starts[-1] + pii.WINDOW > begin + len(address)
    assert starts == sorted(set(starts)) and all(a % pii.STRIDE == 0 for a in starts)
    added = pii.added_spans(text, pii_rules.base_spans(text), pii.likely_spans([text], _WordTagger())[0])
    assert added[0] == [(begin, begin + len(address))]


def test_tagger_learns_and_adds_rewritten_spans():
    rng = random.Random(4)
    words = ["the", "ondre", "stion", "key7ab2", "in", "2024", "heble"]

    def body():
        text, spans = [], []
        for _ in range(30):
            text.append(rng.choice(words))
        card = "".join(rng.choice("0123456789") for _ in range(15))
        card += next(d for d in "0123456789" if pii_rules.luhn(card + d))
        text.insert(rng.randint(0, 29), rng.choice([f"{rng.choice(['joe', 'ann', 'kim'])}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com",
                                                    f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", card]))
        return " ".join(text)

    train, held = [body() for _ in range(250)], [body() for _ in range(60)]
    windows = sorted({w for t in train for w in pii.training_windows(t)})
    chars, tags = np.zeros((len(windows), pii.WINDOW), np.int64), np.zeros((len(windows), pii.WINDOW), np.int64)
    for i, (w, t) in enumerate(windows):
        chars[i, :len(w)] = pii_model.char_classes(w)
        tags[i, :len(t)] = np.frombuffer(t, np.int8)
    model = pii_model.Tagger(0).train(chars, tags, epochs=20)
    seen = pii.likely_spans(held, model)
    hits = total = 0
    for t, found in zip(held, seen):
        base = {(k, a, b) for k, x in enumerate(pii_rules.base_spans(t)) for a, b in x}
        total += len(base)
        hits += len(base & {(k, a, b) for k, a, b, _ in found})
    assert hits >= 0.8 * total
    for t in held:  # what is added touches no base span, base spans are never lost
        base = pii_rules.base_spans(t)
        for x in pii.added_spans(t, base, pii.likely_spans([t], model)[0]):
            assert not any(a < d and c < b for a, b in x for kind in base for c, d in kind)


def test_production_tagger_adds_held_out_rewritten_spans(spark):
    """``fit`` with its own parameters, trained on base forms; rewritten forms planted in texts that it has not seen."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9)))

    def forms(kind):
        card = "".join(rng.choice("0123456789") for _ in range(15))
        card += next(d for d in "0123456789" if pii_rules.luhn(card + d))
        address = [str(rng.randint(1, 254)) for _ in range(4)]
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        name, phone = f"{word()}.{rng.randint(10, 99)}", f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        return {"email": (f"{name}@mail{rng.randint(1, 9)}.example.com", f"{name}[@]mail{rng.randint(1, 9)}.example.com"),
                "ip": (".".join(address), "[.]".join(address)), "phone": (f"+1 {phone}", phone),
                "card": (card, ".".join(re.findall("....", card))),
                "secret": (f'token = "{secret}"', f"{rng.choice(['secret', 'api_key', 'token'])} = '{secret.upper()}'")}[kind]

    def body(form):
        return " ".join(word() for _ in range(rng.randint(10, 40))) + " " + form + " " + " ".join(word() for _ in range(30))

    train = [(i, body(forms(pii_rules.LABELS[i % 5])[0])) for i in range(750)]
    model = pii.fit(spark.createDataFrame(train, "doc_id long, text string"))
    recall = {}
    for k, kind in enumerate(pii_rules.LABELS):
        found = 0
        for _ in range(100):
            form = forms(kind)[1]
            text = body(form)
            form = form.split("'")[1] if kind == "secret" else form
            added = pii.added_spans(text, pii_rules.base_spans(text), pii.likely_spans([text], model)[0])
            found += (text.index(form), text.index(form) + len(form)) in added[k]
        recall[kind] = found / 100
    assert min(recall.values()) >= 0.8, recall


# ------------------------------------------------------------ quality

def test_ledger_equals_brute_force(docs, empty):
    def measures(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup, lines = set(), 0, 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                lines += 1
                dup += line in seen
                seen.add(line)
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] >= 2 for k in range(3)}
        return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), lines, dup, len(hit))

    book = quality_rules.ledger(docs, carry=("source",))
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in book.collect())
    assert got == collections.Counter((i, *measures(t)) for i, t in texts())
    for version in quality_rules.POLICIES:
        judged = quality_rules.apply_policy(book, version).collect()
        for r in judged:
            n = measures_of = (r.n_words, r.n_repeat_words)
            assert r.base_failed == (n[0] < 50 or 100 * measures_of[1] > 50 * n[0])
            assert not (r.kept and r.base_failed)
        kept = sum(r.kept for r in judged)
        for a in quality_rules.ablations(book, version).collect():
            others = set(quality_rules.POLICIES[version]) - {a.rule}
            assert a.n_kept == kept
            assert a.n_kept_without == sum(not r.fail_bits & quality_rules.mask(others) for r in judged)
    assert quality_rules.ledger(empty).collect() == []


def ordinal_corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2])
        words = [rng.choice(plain) for _ in range(rng.randint(30, 200))]
        if grade == 0:
            words = [w + rng.choice(["%%%", "$$$", "###"]) for w in words]
        if grade == 1:
            for _ in range(max(2, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(["badone", "badtwo", "badthree"])
        out.append((i, " ".join(words), grade))
    return out


def test_ordinal_model_on_held_out_texts(spark, docs, empty):
    train, held = ordinal_corpus(900, 1), ordinal_corpus(300, 2)
    table = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in train] + [(None, 1), (5, None), (9999, 2)], "doc_id long, grade int")
    model = quality_model.fit(table, labels, F.col("grade"), 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality_model.with_scores(spark.createDataFrame([r[:2] for r in held], "doc_id long, text string"), model, 2).collect()}
    right = sum((got[i]["__tail"] >= 0.5) == (g == 2) for i, _, g in held)
    assert right >= 0.95 * len(held)
    mean = lambda g: np.mean([got[i]["__expected_grade"] for i, _, x in held if x == g])
    assert mean(0) < mean(1) < mean(2)
    odd = quality_model.with_scores(docs, model, 2)
    assert odd.columns == [*docs.columns, "__expected_grade", "__tail"] and odd.count() == len(rows())
    assert all(r["__tail"] == 0 for r in odd.collect() if not (r.text or "").strip())
    assert quality_model.with_scores(empty, model, 2).collect() == []
    none = quality_model.fit(empty.select("doc_id", "text"), labels, F.col("grade"), 3)
    assert all(r["__tail"] > 0.99 for r in quality_model.with_scores(docs, none, 2).collect() if (r.text or "").strip())


def test_score_equals_the_sum_over_hashed_features():
    cases = pa.array([t for _, t in texts()])
    weights = np.random.default_rng(0).standard_normal(quality_model.DIMENSIONS).astype(np.float32)
    got = quality_model.OrdinalModel(weights, np.array([0.0])).score(cases)
    for (_, text), feature, value, s in zip(texts(), *quality_model.sparse_rows(cases), got):
        assert (not text.split() and s == -np.inf) or abs((weights[feature] * value).sum() - s) < 1e-2 * max(1, abs(s))


# ------------------------------------------------------------ mixing

def test_mixing_budgets_redistribute_among_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 100), ("a", "y", 1000), ("b", "x", 10_000)], "__level_0 string, __level_1 string, available long")
    got = {(r["__level_0"], r["__level_1"]): r.budget for r in
           mixing.leaf_budgets(leaves, ["__level_0", "__level_1"], {"a": 1, "b": 1}, 1600, None, 1).collect()}
    assert got == {("a", "x"): 100, ("a", "y"): 700, ("b", "x"): 800}  # the shortage of a/x stays in a
    got = {(r["__level_0"], r["__level_1"]): r.budget for r in
           mixing.leaf_budgets(leaves, ["__level_0", "__level_1"], {"a": 1, "b": 1}, 4000, None, 1).collect()}
    assert got == {("a", "x"): 100, ("a", "y"): 1000, ("b", "x"): 2900}  # a is full: its shortage goes to b


@pytest.mark.parametrize("budget", [0, 5_000, 60_000, 10 ** 9])
def test_mixing_budgets_of_many_siblings_equal_a_plain_loop(spark, budget):
    rng = random.Random(3)
    leaves = [(lang, f"s{k}", rng.choice([0, 1, 7, 50, rng.randint(1, 400)])) for lang, n in (("en", 900), ("de", 40), ("fr", 1)) for k in range(n)]
    weights = {"en": 5, "de": 2, **{f"{a}/{b}": rng.choice([0, 1, 2, 9]) for a, b, _ in leaves if rng.random() < 0.4}}

    def shares(total, children):  # (capacity, weight) by name
        out, open_ = {}, sorted(children, key=lambda c: (children[c][0] / children[c][1] if children[c][1] else 1e308, c))
        while open_ and children[open_[0]][1] and children[open_[0]][0] * sum(children[c][1] for c in open_) <= (total - sum(out.values())) * children[open_[0]][1]:
            full = open_.pop(0)
            out[full] = children[full][0]
        left, rest = total - sum(out.values()), sum(children[c][1] for c in open_)
        return out | {c: left * children[c][1] // rest if children[c][1] else 0 for c in open_}

    capacity = collections.Counter()
    for lang, _, n in leaves:
        capacity[lang] += 2 * n
    upper = shares(min(budget, sum(capacity.values())), {k: (c, weights.get(k, 1)) for k, c in capacity.items()})
    expected = {}
    for lang in capacity:
        below = shares(upper[lang], {s: (2 * n, weights.get(f"{lang}/{s}", 1)) for a, s, n in leaves if a == lang})
        expected |= {(lang, s): b for s, b in below.items()}
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges per parent
    try:
        table = spark.createDataFrame(leaves, "__level_0 string, __level_1 string, available long")
        got = {(r["__level_0"], r["__level_1"]): r.budget for r in
               mixing.leaf_budgets(table, ["__level_0", "__level_1"], weights, budget, None, 2).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert got == expected


@pytest.mark.parametrize("epochs", [1, 3])
def test_mixing_takes_prefixes_within_budget(spark, docs, empty, epochs):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = mixing.mix(docs, levels, {"en": 3}, fraction=0.6 * epochs, max_epochs=epochs, seed=3)
    out = got.collect()
    assert got.columns == [*docs.columns, "__n_tokens", "__epochs"]
    total = sum((len(t.encode()) + 3) // 4 for _, t in texts())
    assert 0 < sum(r["__n_tokens"] * r["__epochs"] for r in out) <= 0.6 * epochs * total
    assert max(r["__epochs"] for r in out) <= epochs
    again = mixing.mix(docs.repartition(7), levels, {"en": 3}, fraction=0.6 * epochs, max_epochs=epochs, seed=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    assert mixing.mix(empty, levels, {}, fraction=0.5).collect() == []


def test_native_operators_run_no_python(docs):
    for df in (exact_dedup.exact_groups(docs), mixing.mix(docs, {"lang": F.col("lang")}, {}, fraction=0.5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_scratch_can_be_cleared(spark):
    from flipwise.llm.common import clear_scratch, open_folder, stored
    df = stored(spark.range(3).toDF("a"), "probe")
    assert df.count() == 3
    folder = df.inputFiles()[0].rsplit("/", 2)[0]
    assert clear_scratch(spark) >= 1
    fs, path = open_folder(folder)
    assert fs.get_file_info(path).type.name == "NotFound"


def test_quotes_are_no_part_of_an_added_span():
    text = "key = 'ab12cd34ef56' and \"9f8e7d6c5b\""
    seen = [(4, 6, 20, 0.99), (4, 25, 37, 0.99)]
    assert pii.added_spans(text, [[], [], [], []], seen)[4] == [(7, 19), (26, 36)]


def test_rewritten_forms_lie_at_every_offset_of_the_grid():
    starts = set()
    for lead in range(60, 60 + pii.STRIDE):
        text = "x " * (lead // 2) + " " * (lead % 2) + "4111111111111111 end"
        spans = [*pii_rules.base_spans(text), []]
        starts |= {found[2][0][0] % pii.STRIDE for _, found in pii._rewritten(text, spans) if found[2]}
    assert len(starts) == pii.STRIDE
