"""The registered queries that no SQL checks, against plain Python on the whole documents table of sf0.001."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flipwise.llm import registry

CAPACITY = 2048


@pytest.fixture(scope="module")
def texts(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


def rows_of(spark, sf_small, name):
    got = registry.QUERIES[name](spark, sf_small).collect()
    assert got
    return got


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def test_token_shards(spark, sf_small, ids):
    start, expected = 0, {}
    for d in sorted(ids):
        whole = [*ids[d], 2]
        expected[d] = (start, len(whole), crc(whole))
        start += len(whole)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows_of(spark, sf_small, "op1_token_shards")} == expected


def test_token_counts(spark, sf_small, ids, texts):
    expected = {d: (len(texts[d].encode()), len(v), len(v) > 1024) for d, v in ids.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows_of(spark, sf_small, "op10_token_counts")} == expected


def test_packing(spark, sf_small, ids):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows_of(spark, sf_small, "op4_best_fit_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for d, found in pieces.items():
        whole, at = [*ids[d], 0], 0
        assert len(found) == -(-len(whole) // CAPACITY)
        for k, r in enumerate(sorted(found, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == CAPACITY)
            assert r.ids_crc32 == crc(whole[at:at + r.length])
            at += r.length
        assert at == len(whole)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= CAPACITY
    total = sum(len(v) + 1 for v in ids.values())
    assert len(sequences) <= -(-total // CAPACITY) + 1


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)]
    return {kind: [(m.start(), m.end()) for m in re.finditer(p, text) if good(m.group())] for kind, p, good in kinds}


def test_personal_data(spark, sf_small, texts):
    got = {r.doc_id: r for r in rows_of(spark, sf_small, "op3_personal_data")}
    assert set(got) == set(texts)
    for d, text in texts.items():
        found = base_spans(text)
        assert (got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone) == tuple(len(found[k]) for k in ("email", "ip", "card", "phone"))
        listed = [f"{k}:{a}:{b}" for k in found for a, b in found[k]]
        assert got[d].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(got[d].spans.split(","))


def test_near_classes(spark, sf_small, texts):
    sets = {}
    for d, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets[d] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(texts)
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            common = len(sets[a] & sets[b])
            if texts[a] == texts[b] or (common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common)):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    size = collections.Counter(find(d) for d in order)
    expected = {d: (find(d), size[find(d)], find(d) == d) for d in order}
    assert {r.doc_id: (r.class_id, r.class_size, r.kept) for r in rows_of(spark, sf_small, "op8_near_dedup")} == expected


def rule_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    again = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(again)


def test_quality_rules(spark, sf_small, texts):
    got = {r.doc_id: r for r in rows_of(spark, sf_small, "op9_quality_rules")}
    assert set(got) == set(texts)
    for d, text in texts.items():
        n, *rest = rule_counts(text)
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words) == (n, *rest)
        failed = n < 50 or 100 * rest[-1] > 50 * n
        assert got[d].base_failed == failed and not (failed and got[d].kept)


def test_quality_classifier(spark, sf_small, texts):
    got = {r.doc_id: r for r in rows_of(spark, sf_small, "op5_quality_classifier")}
    assert set(got) == set(texts)
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 and r.kept == (r.tail_probability >= 0.5) for r in got.values())
    labels = spark.read.parquet(f"{sf_small}/labels.parquet").collect()
    right = [got[r.doc_id].kept == bool(r.quality and not r.toxic) for r in labels]
    assert sum(right) >= 0.9 * len(right)
