"""Grouping of spelling variants by a frequency-vector trie.

Words are arranged by how often they hold the letters of each group, group
after group: a trie whose levels are the letter groups and whose branches are
counts.  Two words one edit apart have vectors that differ by at most one
surplus and one deficit (an inserted code point is a surplus, a deleted one a
deficit, a replaced one both or neither), so a depth-first search that may
spend one of each reaches every near word; the words of the leaves that it
reaches are verified by their common beginning and end.

The upper levels of the trie deal the vocabulary out to tasks: the depth is
the least at which no branch is too large.  A word searches its own branch
and visits those that its budget can reach and that come after its own, so
each pair is met once.  A branch that stays too large is searched in blocks.
Tasks return one row per word (near words found, the best of them), never a
row per pair.

Counting words is a map-side aggregation over the rows of all texts; a word
that holds a third of all runs is one row of each task.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, whole_text

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, TYPO_MODULUS = 5, 3, 97
#: Letter groups, in the order of the trie's levels; a letter beyond a-z belongs to the group of its code point modulo their number.
LETTERS = ("e", "t", "a", "o", "i", "n", "s", "r", "hz", "djl", "cmqux", "bfgkpvwy")
GROUPS = tuple(g + "".join(chr(c) for c in range(0xC0, 0x100) if c % len(LETTERS) == k) for k, g in enumerate(LETTERS))
#: Words of one task's trie, and the deepest level by which the vocabulary is dealt out.
SHARD_WORDS, DEEPEST = 8_000, 8
#: (query, node) pairs that the search expands at a time, and candidates verified at a time.
CHUNK = 1 << 16
#: Words up to this length are verified as a matrix, longer ones singly.
WIDTH = 64


def words_of(docs: DataFrame, id_col: str, text_col: str, least_length: int, least_count: int, typo_modulus: int) -> DataFrame:
    """(word, n): the runs of letters of all texts, a few with one letter deleted, that occur often enough."""
    lower = F.translate(whole_text(text_col), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_length)
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % typo_modulus == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") >= least_count)


def _counts(depth: int) -> list[Column]:
    return [F.length("word") - F.length(F.translate("word", g, "")) for g in GROUPS[:depth]]


def _branch(counts: list[Column]) -> Column:
    return F.concat_ws(".", *(c.cast("string") for c in counts))


def _depth(words: DataFrame, shard_words: int) -> int:
    """Least depth at which no branch holds more than ``shard_words`` words, ``DEEPEST`` if there is none."""
    counts = _counts(DEEPEST)
    each = F.array(*(F.struct(F.lit(d).alias("depth"), _branch(counts[:d]).alias("branch")) for d in range(1, DEEPEST + 1)))
    sizes = words.select(F.inline(each)).groupBy("depth", "branch").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("depth").agg(F.max("size").alias("size")).where(F.col("size") <= shard_words)
    return largest.agg(F.min("depth")).first()[0] or DEEPEST


def _placed(words: DataFrame, depth: int, shard_words: int) -> DataFrame:
    """(branch, block, visits, word, n): every word where it lives, and where it searches besides."""
    counts = [F.col(f"c{k}") for k in range(depth)]
    here = words.select("word", "n", *(c.alias(f"c{k}") for k, c in enumerate(_counts(depth)))).withColumn("branch", _branch(counts))
    shards = here.groupBy("branch").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_words)).cast("int").alias("blocks"))
    lives = here.select("word", "n", "branch").join(shards, "branch") \
        .withColumn("block", F.pmod(F.hash("word"), F.col("blocks")))
    after = []
    for i in range(depth):
        more = [c + 1 if k == i else c for k, c in enumerate(counts)]
        after.append(_branch(more))
        after += [F.when(counts[j] > 0, _branch([c - 1 if k == j else c for k, c in enumerate(more)])) for j in range(i + 1, depth)]
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    visits = here.select("word", "n", F.explode(F.array(*after)).alias("branch")).where("branch IS NOT NULL") \
        .join(shards, "branch").select("branch", blocks, F.lit(True).alias("visits"), "word", "n")
    within = lives.where("block < blocks - 1") \
        .select("branch", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visits"), "word", "n")
    return lives.select("branch", "block", F.lit(False).alias("visits"), "word", "n").unionByName(visits).unionByName(within)


class Vocabulary:
    """Words of one task as arrays: count vectors, padded letters, hashes of their halves."""

    def __init__(self, words: list[str]):
        self.raw = [w.encode("latin-1") for w in words]
        self.length = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        group = np.zeros(256, np.int64)
        for k, letters in enumerate(GROUPS):
            group[list(letters.encode("latin-1"))] = k
        flat = np.frombuffer(b"".join(self.raw), np.uint8)
        owner = np.repeat(np.arange(len(self.raw)), self.length)
        self.vector = np.bincount(owner * len(GROUPS) + group[flat], minlength=len(self.raw) * len(GROUPS)).reshape(-1, len(GROUPS))
        width = int(min(WIDTH, self.length.max(initial=1)))
        short = [w if len(w) <= width else b"" for w in self.raw]
        self.left = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in short), np.uint8).reshape(-1, width)
        self.right = np.frombuffer(b"".join(w[::-1].ljust(width, b"\0") for w in short), np.uint8).reshape(-1, width)
        # of (m - 1) // 2 letters at either end, for near words of one letter less, as many, one more
        self.head = np.array([[hash(w[:max(0, len(w) + d - 1) // 2]) for d in (-1, 0, 1)] for w in self.raw], np.int64).reshape(-1, 3)
        self.tail = np.array([[hash(w[len(w) - max(0, len(w) + d - 1) // 2:]) for d in (-1, 0, 1)] for w in self.raw], np.int64).reshape(-1, 3)

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the words x and y are one edit apart, by their common beginning and end."""
        longest = np.maximum(self.length[x], self.length[y])
        least = np.minimum(self.length[x], self.length[y])
        common = np.zeros(len(x), np.int64)
        for letters in (self.left, self.right):
            differ = letters[x] != letters[y]
            common += np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), longest), least)
        out = (longest - least <= 1) & (common >= longest - 1) & (x != y)
        for k in np.flatnonzero(longest > self.left.shape[1]):
            out[k] = x[k] != y[k] and self._long(self.raw[x[k]], self.raw[y[k]])
        return out

    @staticmethod
    def _long(a: bytes, b: bytes) -> bool:
        a, b = sorted((a, b), key=len)
        if len(b) - len(a) > 1:
            return False
        k = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), len(a))
        return a[k + (len(a) == len(b)):] == b[k + 1:]


class FrequencyTrie:
    """Trie over count vectors: per level the branches as sorted (parent node, count), per leaf its words."""

    def __init__(self, words: Vocabulary, hosts: np.ndarray):
        vector = words.vector[hosts]
        order = np.lexsort(vector.T[::-1])
        vector = vector[order]
        self.words = words
        self.base = int(words.vector.max(initial=0)) + 3
        self.level: list[np.ndarray] = []
        node = np.zeros(len(order), np.int64)
        for k in range(vector.shape[1]):
            key = node * self.base + vector[:, k]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            self.level.append(key[new])
            node = np.cumsum(new) - 1
        self.leaf_length = np.zeros(int(node[-1]) + 1 if len(node) else 0, np.int64)
        host = hosts[order]
        self.leaf_length[node] = words.length[host]
        self.halves = []  # words of a leaf by their first half, and by their last
        for half in (words.head, words.tail):
            key = self._half(half[host, 1], node)
            sort = np.argsort(key, kind="stable")
            self.halves.append((key[sort], host[sort]))

    @staticmethod
    def _half(value: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        return value.view(np.uint64) ^ (leaf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def search(self, queries: np.ndarray):
        """Yields (query, host) arrays of verified near pairs, depth first with one surplus and one deficit to spend."""
        stack = [(0, queries[a:a + CHUNK], np.zeros(len(queries[a:a + CHUNK]), np.int64), np.ones((2, len(queries[a:a + CHUNK])), bool))
                 for a in range(0, len(queries), CHUNK)]
        while stack:
            depth, query, node, budget = stack.pop()
            if depth == len(self.level):
                yield from self._verified(query, node)
                continue
            keys, wanted = self.level[depth], self.words.vector[query, depth]
            parts = []
            for step, spends in ((0, None), (1, 0), (-1, 1)):  # the host has as many, one more (surplus), one less (deficit)
                may = wanted + step >= 0 if spends is None else budget[spends] & (wanted + step >= 0)
                at = np.searchsorted(keys, (node * self.base + wanted + step)[may])
                hit = at < len(keys)
                hit[hit] = keys[at[hit]] == (node * self.base + wanted + step)[may][hit]
                left = budget[:, may][:, hit]
                if spends is not None:
                    left[spends] = False
                parts.append((query[may][hit], at[hit], left))
            query, node = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            budget = np.concatenate([p[2] for p in parts], axis=1)
            stack += [(depth + 1, query[a:a + CHUNK], node[a:a + CHUNK], budget[:, a:a + CHUNK]) for a in range(0, len(query), CHUNK)]

    def _verified(self, query: np.ndarray, leaf: np.ndarray):
        """Near words among those of each leaf that share the query's first half, or else its last."""
        words, apart = self.words, self.leaf_length[leaf] - self.words.length[query] + 1
        for k, half in enumerate((words.head, words.tail)):
            keys, host = self.halves[k]
            wanted = self._half(np.ascontiguousarray(half[query, apart]), leaf)
            begin, end = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
            upto = np.cumsum(end - begin)
            for a in range(0, int(upto[-1]) if len(upto) else 0, CHUNK):
                at = np.arange(a, min(a + CHUNK, int(upto[-1])))
                row = np.searchsorted(upto, at, "right")
                x, y = query[row], host[end[row] - (upto[row] - at)]
                if k:  # those that share the first half too were met before
                    other = words.head[x, apart[row]] != words.head[y, 1]
                    x, y = x[other], y[other]
                good = words.near(x, y)
                yield x[good], y[good]


def near_in_shard(shard: pa.Table) -> pa.Table:
    """One block of a branch: per word the near words found here, and the most frequent (ties: first in code-point order)."""
    words = shard.column("word").to_pylist()
    n = shard.column("n").to_numpy()
    visits = shard.column("visits").to_numpy().astype(bool)
    vocabulary = Vocabulary(words)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=vocabulary.raw.__getitem__)] = np.arange(len(words))
    found, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    for query, host in FrequencyTrie(vocabulary, np.flatnonzero(~visits)).search(np.arange(len(words))):
        once = visits[query] | (query < host)  # two hosts meet twice
        query, host = query[once], host[once]
        me, other = np.concatenate([query, host]), np.concatenate([host, query])
        found += np.bincount(me, minlength=len(words))
        order = np.lexsort((rank[other], -n[other], me))
        me, other = me[order], other[order]
        first = np.ones(len(me), bool)
        first[1:] = me[1:] != me[:-1]
        me, other = me[first], other[first]
        now = best[me]
        better = (now < 0) | (n[other] > n[now]) | ((n[other] == n[now]) & (rank[other] < rank[now]))
        best[me[better]] = other[better]
    at = np.flatnonzero(found)
    column = shard.column("word").combine_chunks()
    return pa.table({"word": column.take(pa.array(at)), "found": pa.array(found[at]),
                     "best": column.take(pa.array(best[at])), "best_n": pa.array(n[best[at]])})


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) for each word of (word, n) that has near ones."""
    ship(words.sparkSession)
    found = _placed(words, _depth(words, shard_words), shard_words).groupBy("branch", "block") \
        .applyInArrow(near_in_shard, "word string, found long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return found.groupBy("word").agg(F.sum("found").alias("n_near"), best.alias("top")) \
        .select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of forms.  Counts at least double along a chain, so it is short and has no cycle."""
    now = stored(forms.select("word", F.col("form").alias("up"), F.lit(True).alias("open")), "spelling-roots")
    while not now.where("open").isEmpty():
        above = now.select(F.col("word").alias("at"), F.col("up").alias("next"))
        now = stored(now.join(above, now["up"] == above["at"], "left")
                     .select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("open")), "spelling-roots")
    return now.select("word", F.col("up").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                      least_count: int = LEAST_COUNT, typo_modulus: int = TYPO_MODULUS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Runs of letters of all texts, A-Z lower-cased; where ``typo_modulus``
    divides the crc32 of "<id>:<run>" the run loses one letter.  Null texts
    have no runs, a null id counts as the empty string in the crc32, repeated
    rows count each; other columns change nothing; a table without such words
    gives no rows.  ``form`` is the near word of largest n (ties: smallest in
    code-point order) if that n is at least twice the word's.
    """
    words = stored(words_of(docs, id_col, text_col, least_length, least_count, typo_modulus), "spelling-words")
    near = near_words(words, shard_words)
    judged = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best_n")).alias("form_n")), "spelling-forms")
    root = _roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_sql() -> str:
    """The contract's query in DuckDB SQL: crc32 by its table, near words by a join on each word with one letter masked or deleted."""
    letters = string.ascii_uppercase, string.ascii_lowercase
    return f"""WITH RECURSIVE step(t) AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{letters[0]}', '{letters[1]}'), '{RUN}')) AS run FROM documents),
few AS (SELECT id, run, count(*) AS c, hex(id || ':' || run) AS x FROM runs WHERE length(run) >= 5 GROUP BY id, run),
coded AS (SELECT run, c, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM few, step),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM coded),
words AS (SELECT word, sum(c)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
masked AS (SELECT word, n, i, word[:i] || '*' || word[i + 2:] AS m, word[:i] || word[i + 2:] AS d FROM places),
pairs AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM masked a JOIN masked b ON a.m = b.m AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM masked a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM masked a JOIN words b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS top, max(n) AS top_n FROM pairs GROUP BY word),
judged AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top_n >= 2 * w.n THEN b.top END AS form,
  CASE WHEN b.top_n >= 2 * w.n THEN b.top_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
chain(word, top) AS (SELECT word, word FROM judged UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON c.top = j.word WHERE j.form IS NOT NULL),
ends AS (SELECT c.word, c.top AS root FROM chain c JOIN judged j ON c.top = j.word WHERE j.form IS NULL)
SELECT j.word, j.form, e.root, j.n, j.n_near, j.form_n FROM judged j JOIN ends e ON j.word = e.word"""
