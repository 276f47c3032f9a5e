"""Spelling variants, suffix dedup and tokenizer alignment against brute force; clashing column names of every operator."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from flipwise.llm import alignment, exact_dedup, induced_sort, mixing, near_dedup, quality_model, spelling, suffix_dedup


def plain(df):
    return sorted(map(str, map(tuple, df.collect())))


# ------------------------------------------------------------ spelling variants

def near(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def brute_variants(rows, least_count=3, least_length=5, modulus=97):
    count = collections.Counter()
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for i, text in rows:
        run = ""
        for c in (text or "").translate(lower) + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                k = h % len(run)
                count[run[:k] + run[k + 1:] if h % modulus == 0 else run] += 1
            run = ""
    n = {w: c for w, c in count.items() if c >= least_count and len(w) >= least_length}
    form, out = {}, []
    found = {w: [x for x in n if near(w, x)] for w in n}
    for w, others in found.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append(str((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None)))
    return sorted(out)


def variant_rows():
    rng = random.Random(8)
    words = ["".join(rng.choice("abeé") for _ in range(rng.randint(3, 7))) for _ in range(60)] + ["Ärger", "÷×÷×÷", "l" * 90, "l" * 91, "listen", "silent"]
    rows = [(k if k % 11 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    return rows + [(1, None), (2, ""), (3, "a1b-c ' "), (3, "Ärger ärger ärgert ärgert ärgert"), (3, "Ärger ärger ärgert ärgert ärgert")]


@pytest.mark.parametrize("shard_words", [8000, 7])
@pytest.mark.parametrize("modulus", [97, 3])
def test_variants_equal_brute_force(spark, shard_words, modulus):
    rows = variant_rows()
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, word string, n int, form string").repartition(3)
    got = spelling.spelling_variants(docs, typo_modulus=modulus, shard_words=shard_words)
    assert plain(got) == brute_variants(rows, modulus=modulus)
    assert spelling.spelling_variants(docs.limit(0)).collect() == []


def test_trie_finds_every_near_pair():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(500)} | {"a" * 70, "a" * 71, "b" + "a" * 70})
    vocabulary = spelling.Vocabulary(words)
    pairs = set()
    for q, h in spelling.FrequencyTrie(vocabulary, np.arange(len(words))).search(np.arange(len(words))):
        pairs |= set(zip(q.tolist(), h.tolist()))
    assert pairs == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}


# ------------------------------------------------------------ suffix dedup

def brute_order(text):
    order = sorted(range(len(text) - 1), key=lambda i: text[i:], reverse=True)
    shared = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while text[a + k] == text[b + k]:
            k += 1
        shared.append(k)
    return order, shared[:len(order)]


@pytest.mark.parametrize("small", [False, True])
def test_suffixes_and_common_prefixes(small, monkeypatch, tmp_path):
    if small:  # many bins, batches and spilled blocks
        monkeypatch.setattr(induced_sort, "BIN", 3)
        monkeypatch.setattr(induced_sort, "COARSE", 2)
        monkeypatch.setattr(induced_sort, "BATCH", 5)
    rng = random.Random(1)
    for n in range(600):
        symbols = rng.choice([1, 2, 3, 30, 250])
        text = [rng.randint(1, symbols) for _ in range(rng.randint(0, 60))]
        text = text[:3] * (n % 7) + text + [0]
        order, shared = induced_sort.sort_suffixes(np.array(text), symbols + 1, induced_sort.Disk(None)).all()
        assert (order.tolist(), shared.tolist()) == brute_order(text)


def test_sort_spills_and_leaves_no_files(tmp_path):
    rng = np.random.default_rng(3)
    block = rng.integers(1, 9, 4000)
    text = np.concatenate([block, rng.integers(1, 9, 30_000), block, [0]])
    disk = induced_sort.Disk(str(tmp_path), memory=50_000)
    spilled = induced_sort.sort_suffixes(text, 9, disk).all()
    assert disk.spilled > 10_000
    disk.close()
    assert not any(p.is_file() for p in tmp_path.rglob("*"))
    whole = induced_sort.sort_suffixes(text, 9, induced_sort.Disk(None)).all()
    assert all((a == b).all() for a, b in zip(spilled, whole))
    assert whole[1].max() == 4000 + (text[4000:4100] == text[-1 - 100:-1]).cumprod().sum() or whole[1].max() >= 4000


def brute_dedup(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            string = data[s:s + length]
            if string in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(string)
        spans = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append(str((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def dedup_rows(length):
    rng = random.Random(4)
    base = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 4 * length))) for _ in range(30)]
    rows = [(k if k != 7 else None, "".join(rng.choice(base)[rng.randint(0, length):] for _ in range(rng.randint(0, 4)))) for k in range(200)]
    return rows + [(1000, None), (1001, ""), (1002, "a" * 3000), (1003, "ab" * 900), (1004, "x" * (length - 1)), (1005, base[0]), (1006, base[0])]


@pytest.mark.parametrize("length", [5, 20, 100])
@pytest.mark.parametrize("shard_bytes", [8_000_000, 9_000])
def test_suffix_dedup_equals_brute_force(spark, length, shard_bytes):
    rows = dedup_rows(length)
    docs = spark.createDataFrame([(*r, "f", b"x", 3) for r in rows], "doc_id long, text string, file string, kept binary, shard int").repartition(3)
    got = suffix_dedup.suffix_dedup(docs, length=length, shard_bytes=shard_bytes, memory=100_000)
    assert plain(got.drop("kept")) == brute_dedup(rows, length)
    assert {r.kept_sha256 for r in got.collect()} == {hashlib.sha256(r.kept).hexdigest() for r in got.collect()}
    assert suffix_dedup.suffix_dedup(docs.limit(0)).collect() == []


def test_frequent_grams_are_posted_singly(spark):
    """A line that most documents hold amid ever different text; its grams fill cells of their own."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij ") for _ in range(90))
    line = word() + word()
    rows = [(k, word() + (line[:60] if k % 2 else line) + word()) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = [c for c in suffix_dedup.suffix_dedup(docs, shard_bytes=20_000).drop("kept").collect()]
    assert sorted(map(str, map(tuple, found))) == brute_dedup(rows, 100)
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    first = np.cumsum([0] + [len(t) for _, t in rows])
    found = suffix_dedup.passages(data, first, 100)
    single = suffix_dedup._singly(data, found, np.ones(len(found.gram), bool), 100)
    assert len(single.begin) == sum(max(0, len(t) - 99) for _, t in rows) and (single.end - single.begin == 100).all()


# ------------------------------------------------------------ alignment

def brute_alignment(rows):
    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a, b = alignment.encoders()
    count, links, out = collections.Counter(), {}, {}
    for k, (i, text) in enumerate(rows):
        links[k], out[k] = [], [i, 0, 0, 0, 0, 0, 0, ""]
        if not text:
            continue
        ids = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        data = [[enc.token_bytes[x] for x in side] for enc, side in zip((a, b), ids)]
        if any(b"".join(d) != (" " + text).encode() for d in data):
            continue
        ends = []
        for d in data:
            at, where = 0, {}
            for t, x in enumerate(d):
                at += len(x)
                where[at] = t
            ends.append(where)
        groups, x, y = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0][cut], ends[1][cut]
            groups.append(",".join(map(str, ids[0][x:p + 1])) + "|" + ",".join(map(str, ids[1][y:q + 1])))
            links[k].append((ids[0][p], ids[1][q]))
            x, y = p + 1, q + 1
        count.update(links[k])
        out[k][1:5] = len(ids[0]), len(ids[1]), len(groups), len(links[k])
        out[k][7] = hashlib.sha256(";".join(groups).encode()).hexdigest()
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    for k in out:
        out[k][5:7] = sum(count[p] == best[p[1]] for p in links[k]), sum(count[p] for p in links[k])
    return sorted(str(tuple(r)) for r in out.values())


def test_alignment_equals_brute_force(spark):
    rng = random.Random(3)
    parts = ["a", "B", "'s", "22", " ", "  ", "\n", "é", "!", "<|endoftext|>", "🙂", "\x85", "▁", "<0x41>", "<s>", "word", "\x00", " the", " of", "ﬁ"]
    rows = [(k, "".join(rng.choice(parts[:-8] if k % 2 else parts) for _ in range(rng.randint(0, 30)))) for k in range(400)]
    rows += [(None, None), (1005, ""), (1005, ""), (1006, "word1 two " * 2000), (1007, "  y " * 3000), (1008, "x" * 3000), (1009, " ")]
    docs = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], "doc_id long, text string, block int, count int, links string").repartition(3)
    assert plain(alignment.alignment_digest(docs)) == brute_alignment(rows)
    assert alignment.alignment_digest(docs.limit(0)).collect() == []
    listed = {r.doc_id: r for r in alignment.alignments(docs).collect()}
    assert len(listed[1006].a_ids) > 4000 and listed[1006].a_last[-1] == len(listed[1006].a_ids) - 1 and listed[1006].b_last[-1] == len(listed[1006].b_ids) - 1
    assert listed[1005].a_ids == [] and alignment.alignments(docs.limit(0)).collect() == []


def test_alignment_on_the_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert plain(alignment.alignment_digest(docs)) == brute_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


# ------------------------------------------------------------ clashing names, and near dedup by weighted bands

NAMES = [["__epochs", "__n_tokens", "__whole", "__rest", "__end", "__tokens", "__level_0", "__row", "__identity", "__score", "__tail", "__kept",
          "__expected_grade", "row", "score", "expected", "tail", "__id", "__content", "__keep", "__nth"],
         ["__Epochs", "__N_tokens", "__Level_0", "__Kept", "__TAIL", "__Expected_grade", "Row", "Label"]]


def named(spark, names):
    rows = [(k, f"word{k} some plain text of its own number {k}", "en", f"src{k % 2}", 9, *[f"{n}:{k}" for n in names]) for k in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))


def unchanged(docs, out, names):
    assert out.columns[:len(docs.columns)] == docs.columns
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert rows and all(r[n] == f"{n}:{r.text.split()[-1]}" for r in rows for n in names)


@pytest.mark.parametrize("names", NAMES)
def test_clashing_names_keep_their_values(spark, names):
    docs = named(spark, names)
    model = quality_model.OrdinalModel(np.zeros(quality_model.DIMENSIONS, np.float32), np.array([-1.0, 1.0]))
    for out in (mixing.mix(docs, mixing.document_levels(), mixing.WEIGHTS, fraction=0.5), quality_model.with_scores(docs, model, 1),
                exact_dedup.exact_dedup(docs), near_dedup.near_dedup(docs)):
        unchanged(docs, out, names)


@pytest.mark.parametrize("names", NAMES[1:])
def test_stages_keep_clashing_columns_null_ids_and_repeated_rows(spark, sf_small, names):
    docs = named(spark, names)
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(
        docs.where("doc_id < 2").withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string")))
    assert quality_model.judged(docs, spark.read.parquet(f"{sf_small}/labels.parquet")).columns[-1] == "__kept_"
    for stage, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf_small)
        assert out.columns == docs.columns, stage
        if stage != "quality":
            unchanged(docs, out, names)


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_links_do_not_depend_on_occurrences(spark):
    """Near copies with lines that repeat 100 times in one of them: far as bags, near as sets; and the other way round."""
    rng = random.Random(9)
    rows = []
    for k in range(60):
        base = [f"w{k}x{i}" for i in range(200)]
        tail = [f"t{k}x{i}" for i in range(rng.randint(5, 60))]
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(base + tail * 100)), (3 * k + 2, " ".join(base[:40] * 30 + tail))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    parent = list(range(len(rows)))
    for k in range(60):
        for a, b in ((0, 1), (0, 2), (1, 2)):
            if jaccard(rows[3 * k + a][1], rows[3 * k + b][1]) >= 0.8:
                x, y = sorted((parent[3 * k + a], parent[3 * k + b]))
                parent = [x if p == y else p for p in parent]
    assert got == dict(enumerate(parent)) and sum(p != i for i, p in enumerate(parent)) > 10


def test_weighted_bands_follow_occurrences():
    """Weighted registers agree by the probability Jaccard of the bags, unit registers by that of the sets."""
    import pyarrow as pa

    base = [f"w{i}" for i in range(300)]
    many = " ".join(base[:30] * 50 + base[30:165])
    other = " ".join(base[:30] * 50 + base[165:])
    plain_, same = np.array(near_dedup.band_hashes(pa.array([many, other]), 400, 1, 5)), 400
    unit = (plain_[0, :same] == plain_[1, :same]).mean()
    weighted = (plain_[0, same:] == plain_[1, same:])
    assert plain_.shape[1] == 400 + near_dedup.WEIGHTED_BANDS
    assert unit < 0.35 and weighted.mean() >= 0.5


# ------------------------------------------------------------ the ordinal fit by brute force

def test_fit_equals_a_plain_fit_with_numeric_gradients(monkeypatch):
    monkeypatch.setattr(quality_model, "DIMENSIONS", 8)
    monkeypatch.setattr(quality_model, "STEPS", 25)
    rng = np.random.default_rng(1)
    x = np.where(rng.random((30, 8)) < 0.6, rng.random((30, 8)) + 0.2, 0.0)
    grades = rng.integers(0, 3, 30)
    rows = [np.flatnonzero(r).astype(np.int32) for r in x]
    model = quality_model.fit_rows(rows, [r[i].astype(np.float32) for r, i in zip(x, rows)], grades, 3)

    held = (x > 0).sum(axis=0)
    scale = np.sqrt((x.astype(np.float32)**2).sum(axis=0) / np.maximum(1, held))
    z = x.astype(np.float32) / scale
    each = ((30 / 3 / np.bincount(grades, minlength=3)) ** quality_model.BALANCE)[grades]
    each = each / each.mean()

    def loss(p):
        theta = np.array([-np.inf, p[8], p[8] + np.exp(p[9]), np.inf])
        s = z @ p[:8]
        at_most = lambda k: 1 / (1 + np.exp(s - theta[k]))
        prob = np.array([(at_most(g + 1) - at_most(g))[i] for i, g in enumerate(grades)])
        return -(each * np.log(prob)).sum() / 30 + quality_model.RIDGE / 2 * (p[:8]**2).sum()

    share = np.cumsum(np.bincount(grades, each, minlength=3))[:-1] / 30
    cuts = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(8), [cuts[0], np.log(max(cuts[1] - cuts[0], 0.05))]])
    m, v = np.zeros(10), np.zeros(10)
    for step in range(1, 26):
        grad = np.array([(loss(p + 1e-6 * e) - loss(p - 1e-6 * e)) / 2e-6 for e in np.eye(10)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        rate = quality_model.RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        p = p - rate * m / (1 - 0.9**step)
        p[:8] = np.sign(p[:8]) * np.maximum(np.abs(p[:8]) - rate[:8] * quality_model.SPARSITY * np.sqrt(held) / 30, 0)
    assert np.allclose(model.weights, p[:8] / scale, atol=2e-3)
    assert np.allclose(model.thresholds, [p[8], p[8] + np.exp(p[9])], atol=2e-3)
